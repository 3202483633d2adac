"""Main text of web pages by line-block distribution.

A page is stripped to lines: markup, scripts, styles and comments go, and so
do elements that are boilerplate by their kind (menus, page headers, footers,
sidebars, forms, hidden parts).  Every block element is a line of its own, with
character references decoded and white space collapsed; the part of a line that
is link text is counted.

Class and id names only nominate a block.  What is decided is the distribution of
text outside links, summed over sliding windows of WINDOW lines:

* A block named as a menu, advert, notice, reader comment or the like goes, unless
  no window of the other lines reaches BLOCK characters (in a marked article: there
  are no others) and one of its own does.  Then it wraps the article.
* A block whose name only holds such a word (``related-work``) goes where link text
  is half of it or more; on a page without marks also where none of its windows
  reaches BLOCK.

Where the page marks its article (``article``, ``main``), all other lines inside
these elements are kept, in page order.  Elsewhere a surge is the first line of
which some window reaches the threshold (at most BLOCK), a dive the last one
before no window does; every run from a surge to its dive is kept, and the lines
between two runs that are not further apart than a window.  The first run begins
at the first heading from which only text, no link lines, leads to it.

One pass over the page, in time linear in its length.  Null or empty html gives
an empty text.  Unclosed and stray tags are tolerated, a quote that is never closed
is a plain character of its tag; a tag, comment or script cut off by the end of
the page is dropped.  Repeated rows stay rows.  An empty table gives no rows.
Only the named columns are read.
"""

from __future__ import annotations

import html as _html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlog.llm.common import ship, table

WINDOW = 3
BLOCK = 86

_TOKEN = re.compile(r"""(?s)<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""")
_ATTRIBUTE = re.compile(r"""([A-Za-z_:@][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Element kinds of HTML.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
           "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
           "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_DROP = {"head", "nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "option", "datalist", "svg",
         "canvas", "object", "audio", "video", "template", "applet"}
_DROP_OUTSIDE = {"header"}
# Start tags that end an open element of these kinds.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "blockquote", "aside", "nav",
           "footer", "header", "form", "td", "th"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_KEEP = {"html", "body", "main"} | _HEADINGS
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu",
          "menubar", "toolbar", "form"}
_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored",
          "promo", "promos", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification",
          "popup", "modal", "overlay", "sidebar", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb",
          "breadcrumbs", "footer", "masthead", "topbar", "toolbar", "comment", "comments", "reply", "replies",
          "respond", "disqus", "discussion", "share", "sharing", "social", "related", "recommended",
          "recommendations", "newsletter", "subscribe", "subscription", "signup", "login", "search", "pagination",
          "pager", "widget", "widgets", "banner", "copyright"}
# Names that a part of an article may well have, too.
_UNSURE = {"adv", "sponsor", "promotion", "consent", "discussion", "related", "search", "subscription", "recommended"}
_COMMENTS = {"comment", "comments", "respond", "disqus"}
# Words that say nothing beside one of the names.
_GENERIC = {"box", "block", "section", "list", "area", "wrapper", "wrap", "container", "content", "bar", "top", "bottom",
            "left", "right", "main", "item", "items", "links", "link", "buttons", "form", "unit", "slot", "panel",
            "header", "title", "body", "text", "inner", "outer", "site", "page", "thread", "primary", "secondary"}
_NEGATED = {"with", "has", "no", "without"}
PLAIN, MAYBE, NAMED = 0, 1, 2


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), _html.unescape(value.strip("\"'")))
    return out


def _nominated(names: str, anchor: bool, inside: bool) -> int:
    """MAYBE or NAMED if a class or id names boilerplate; anchor: it is the id
    of a section."""
    most = PLAIN
    for token in names.split():
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", token).lower()) if w]
        if not words or words[0] in _NEGATED:
            continue
        sure = _COMMENTS if anchor else _NAMES - _UNSURE
        if words == ["header"] and not inside:
            return NAMED
        if (any(w in sure for w in words)
                and all(w in _NAMES or w in _GENERIC or w.isdigit() for w in words)):
            return NAMED
        if words[0] in _NAMES or words[-1] in _NAMES:
            most = MAYBE
    return most


def _judged(name: str, attributes: str, inside: bool) -> tuple[bool, int]:
    """(boilerplate by kind, nomination by name); inside: within the article."""
    if name in _DROP or (name in _DROP_OUTSIDE and not inside):
        return True, PLAIN
    if name in _KEEP or "=" not in attributes and "hidden" not in attributes:
        return False, PLAIN
    a = _attributes(attributes)
    if a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True, PLAIN
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True, PLAIN
    return False, max(_nominated(a.get("class", ""), False, inside),
                      _nominated(a.get("id", ""), name == "section", inside))


class Line(NamedTuple):
    text: str
    link: int  # characters of it that are link text
    article: bool  # inside ``article`` or ``main``
    block: int  # number of the nominated block that it is in, 0 for none
    sure: int  # that block's nomination
    heading: bool


def lines_of(page: str) -> list[Line]:
    lines: list[Line] = []
    buffer: list[str] = []
    # name, dropped, (article, block, sure) before it
    stack: list[tuple[str, bool, tuple[bool, int, int]]] = []
    where: dict[str, list[int]] = {}  # open elements by name, as places in the stack
    blocks: list[int] = []  # open elements that are no inline ones
    scopes: list[int] = []
    dropped, link, at, numbered = 0, 0, 0, 0
    state = (False, PLAIN, PLAIN)

    def text(piece: str) -> None:
        nonlocal link
        buffer.append(piece)
        if where.get("a"):
            link += len("".join(piece.split()))

    def flush() -> None:
        nonlocal link
        if buffer:
            line = " ".join("".join(buffer).split())
            buffer.clear()
            if line:
                lines.append(Line(line, link, *state, any(where.get(h) for h in _HEADINGS)))
        link = 0

    def push(name: str, drop: bool) -> None:
        k = len(stack)
        where.setdefault(name, []).append(k)
        if name not in _INLINE:
            blocks.append(k)
        if name in _SCOPES:
            scopes.append(k)
        stack.append((name, drop, state))

    def pop() -> None:
        nonlocal dropped, state
        name, was, before = stack[-1]
        if name not in _INLINE or was or before != state:
            flush()
        stack.pop()
        where[name].pop()
        if name not in _INLINE:
            blocks.pop()
        if name in _SCOPES:
            scopes.pop()
        dropped -= was
        state = before

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not dropped:
            text(_html.unescape(page[at:m.start()]))
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                buffer.append(" ")
            own = where.get(name)
            if not own:
                if name == "p":
                    flush()
                continue
            # an inline end tag does not reach out of its block
            if not (name in _INLINE and blocks and blocks[-1] > own[-1]):
                k = own[-1]
                while len(stack) > k:
                    pop()
            continue
        if not m[0].endswith(">"):
            break  # cut off by the end of the page
        if name in _RAW:
            end = re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*(?:>|\Z)").search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            if not dropped:
                buffer.append("\n")
            continue
        if name in _INLINE and not m[3]:
            if name not in _VOID:
                push(name, False)
            continue
        if name not in _INLINE:
            flush()
            # block starts end an open paragraph, and items their predecessor
            k = max([where[e][-1] for e in _ENDS.get(name, set()) | {"p"} if where.get(e)], default=-1)
            if k >= 0 and not (scopes and scopes[-1] > k):
                while len(stack) > k:
                    pop()
        if name in _VOID:
            continue
        article, block, sure = state
        drop, named = _judged(name, m[3], article)
        if (drop or named > sure) and not dropped:
            flush()
        push(name, drop)
        dropped += drop
        if not dropped:
            if named > sure:
                numbered += 1
                block, sure = numbered, named
            state = (article or name in ("article", "main") and sure < NAMED, block, sure)
    if not dropped and at < len(page):
        text(_html.unescape(page[at:]))
    flush()
    return lines


def _reach(lines: list[Line], window: int) -> int:
    """The greatest window sum of text outside links."""
    sizes = [len(x.text) - x.link for x in lines]
    return max((sum(sizes[i:i + window]) for i in range(len(sizes))), default=0)


def _runs(lengths: list[int], threshold: int, window: int) -> list[list[int]]:
    """[surge, dive) of every run; runs that are not further apart than a
    window are one."""
    n = len(lengths)
    sums = [sum(lengths[i:i + window]) for i in range(n)]
    runs: list[list[int]] = []
    for i in range(n):
        if max(sums[max(0, i - window + 1):i + 1]) >= threshold:
            if runs and i - runs[-1][1] <= window:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
    return runs


def main_text(page: str | None, window: int = WINDOW, block: int = BLOCK) -> str:
    if not page:
        return ""
    every = lines_of(page)
    marked = any(x.article for x in every)
    own = [x for x in every if x.article] if marked else every
    nominees: dict[int, list[Line]] = {}
    for x in own:
        if x.block:
            nominees.setdefault(x.block, []).append(x)
    if nominees:
        plain = [x for x in own if not x.block]
        elsewhere = bool(plain) if marked else _reach(plain, window) >= block
        stays = {0}
        for k, part in nominees.items():
            reaches = _reach(part, window) >= block
            if part[0].sure == NAMED:
                stay = reaches and not elsewhere
            else:
                stay = 2 * sum(x.link for x in part) < sum(len(x.text) for x in part) and (marked or reaches)
            if stay:
                stays.add(k)
        own = [x for x in own if x.block in stays]
    if marked:
        return " ".join(x.text for x in own)
    lengths = [len(x.text) - x.link for x in own]
    if not any(lengths):
        lengths = [len(x.text) for x in own]
    most = max((sum(lengths[i:i + window]) for i in range(len(lengths))), default=0)
    runs = _runs(lengths, max(1, min(block, most // 2)), window)
    if runs:
        first = runs[0][0]
        for i in range(first - 1, -1, -1):
            if 2 * own[i].link >= len(own[i].text):
                break
            if own[i].heading:
                first = i
        runs[0][0] = first
    return " ".join(x.text for surge, dive in runs for x in own[surge:dive])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""
    ship(pages.sparkSession)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                s = b.slice(lo, 500)
                texts = [main_text(h) for h in s.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), s.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr(f"CAST(`{page_id}` AS BIGINT) AS page_id", f"CAST(`{url}` AS STRING) AS url",
                            f"CAST(`{html}` AS STRING) AS html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


def op8_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
