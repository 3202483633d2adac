"""HTML extraction on the page table and on awkward markup."""

import html
import re

import pytest

from fleetlog.llm import html_text
from fleetlog.llm.html_text import main_text

ARTICLE = "long words of the story go on here " * 8


def test_pages_of_the_table(spark, sf_small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()}
    rows = html_text.op8_html(spark, sf_small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        own = re.search(r"(?s)<article>(.*?)(</article>|<footer>|\Z)", pages[r["page_id"]])[1]
        own = re.sub("<[^>]*$", "", re.sub("</?b>", "", re.sub("</?(p|h1|br)>", " \n ", own)))
        assert r["text"] == " ".join(html.unescape(own).split())
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("plain text only", "plain text only"),
    ("a < b &amp; c &lt;p&gt; 3<4", "a < b & c <p> 3<4"),
    ("<article><p>one<p>two</article>", "one two"),
    ("<article><p>x<script>if (a<b) { \"</p>\" }</script>y<style>p{}</style>z</article>", "xyz"),
    ("<article><p>abc<!-- never closed", "abc"), ("<article><p>abc</p", "abc"), ("<article><p>abc<script>x", "abc"),
    ("<article>a<b>b</b>c<br>d<i>e</i>\n f&nbsp;g&#233;&#x41;&eacute;&am</article>", "abc de f géAé&am"),
    ("<main><nav>menu</nav><article><header><h1>T</h1></header><p>body<p class=ad>buy<p>next<ul><li>1<li>2</ul>"
     "<section id='comments'><article class='comment'><p>hi</article></section></article></main><footer>f</footer>",
     "T body next 1 2"),
    ("<body class='has-sidebar'><header>site</header><div id='cookie-notice'>We use</div><main><p>Of.</p><p>" + ARTICLE +
     "</p><p>End.</p></main><aside>s</aside><form><p>q</form>", "Of. " + ARTICLE.strip() + " End."),
    ("<div class=sidebarMenu>m</div><div><p>" + ARTICLE + "</p><p>short.</p><p>" + ARTICLE + "</p></div>",
     ARTICLE.strip() + " short. " + ARTICLE.strip()),
    ("<article></p></div>kept</span> text</article>", "kept text"),
    ("<article><p hidden>no</p><div style='display: none'>no</div><div role=dialog>no</div>yes</article>", "yes"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b c"),
    ("<article><p>tail</article><div class='comments'>c</div>", "tail"),
])
def test_markup(page, text):
    assert main_text(page) == text


def test_lines_far_from_the_text_are_cut():
    links = "".join(f"<div>link {i}</div>" for i in range(12))
    body = "".join(f"<p>{ARTICLE}</p>" for _ in range(4))
    got = main_text(f"<body><div>{links}</div><div>{body}</div><div>{links}</div></body>")
    assert got.count("story") == 32 and got.count("link") <= 2 * html_text.WINDOW


def test_edge_rows(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (None, None, "<article>x</article>"), (3, "u", "<article>" + ARTICLE * 3000 + "</article>"),
            (3, "u", "<p>a"), (3, "u", "<p>a")]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS text", "'y' AS n_chars", "'z' AS lines").write.parquet(str(tmp_path / "pages.parquet"))
    got = html_text.op8_html(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == sorted(
        [(1, 0), (2, 0), (0, 1), (3, len((ARTICLE * 3000).strip())), (3, 1), (3, 1)])
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(empty).count() == 0


@pytest.mark.parametrize("page,text", [
    ("<main><h1>T</h1><p>intro</p><article><p>long body text</p></article><p>end</p></main>",
     "T intro long body text end"),
    ("<nav>m</nav><article><p>part one is longer</p></article><div class=ad>a</div><article><p>part two</article>x",
     "part one is longer part two"),
    (f"<div><p>{ARTICLE}</p>" + "<div class=ad>buy</div>" * 4 + f"<p>{ARTICLE}</p></div>", f"{ARTICLE}{ARTICLE}".strip()),
    (f"<div><p>{ARTICLE}</p>" + "<div>a b</div>" * 12 + f"<p>{ARTICLE * 2}</p></div>",
     f"{ARTICLE}a b a b a b a b {ARTICLE * 2}".strip()),
])
def test_every_part_of_a_page_is_kept(page, text):
    assert main_text(page) == text


SECTIONS = ("<article><h1>T</h1><p>plain</p><section id='discussion'><p>one of us</p></section><h2 id='related-work'>Two</h2>"
            "<p class='notice-of-intent'>three</p><div class='search-results-table'><p>four</p></div>"
            "<p>x <math><mi>y</mi></math></p>{}</article>")


@pytest.mark.parametrize("extra,text", [
    ("", ""), ("<div class='ad'>buy</div><div class='comments-list'><p>" + ARTICLE + "</div><section id=comments>c</section>", ""),
    ("<div class='related-links'><a href=a>all of it</a> <a href=b>is links</a></div>", ""),
    ("<div class='related-links'>much more text than <a href=a>links</a></div>", " much more text than links"),
])
def test_names_only_nominate(extra, text):
    assert main_text(SECTIONS.format(extra)) == "T plain one of us Two three four x y" + text


@pytest.mark.parametrize("page,text", [
    (f"<div class='modal'><p>{ARTICLE}</p><p>end</p></div>", f"{ARTICLE}end"),
    (f"<article><div class='modal'><p>{ARTICLE}</p></div></article><p>s</p>", ARTICLE.strip()),
    (f"<div><a href=x>home</a></div><h1>Title</h1><p>a</p><p>b</p><p>c</p><p>d</p><p>{ARTICLE}</p>", f"Title a b c d {ARTICLE}".strip()),
    ("<article><p title=\"never closed>one</p><p>two</p></article>", "one two"),
    ("<article><p title='a>b' class=\"x>y\">one</p></article>", "one"),
])
def test_wrappers_titles_and_quotes(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("unit", ["<b>", "<b><i class=x>", "<div>", "<p>", "</b>", "<li>", "<a href=\"", "<", "<!--", "<div class=ad>"])
def test_time_is_linear_in_the_page(unit):
    import time
    start = time.process_time()
    main_text("<article>" + unit * (500_000 // len(unit)) + "x")
    assert time.process_time() - start < 4
