"""Language identification with a bidirectional gated recurrent network.

The network reads bytes: a forward and a backward GRU of HIDDEN units each see
a window of STEPS bytes, and at every position a linear layer over both states
gives the probabilities of the languages.  It is trained in numpy by
backpropagation through time (Adam), with the document's language as the label
of every position.  A document's probabilities are the mean over all positions
of all its windows, which tile the whole text.

Every language of the training rows is a class.  Training uses a bounded sample:
up to DOCS_PER_LANGUAGE documents of each, or, with many languages, so many that
they are about SAMPLE_DOCS in all (but at least one each), chosen by hash of id
and text after equal documents are removed, and WINDOWS_PER_DOC windows of each
at hashed places.  Prediction covers every byte
of every text; language, source and id are never inputs.

``und`` (score 0) is returned for a null text and one without a letter, or when
nothing could be learned.  Rows are predicted one by one, so repeated rows give
equal results.  An empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.llm.common import ship, stored, table

HIDDEN = 8
STEPS = 64
BATCH = 2048  # windows predicted at once
DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 4
SAMPLE_DOCS = 25_600  # of all languages
WIDE = 64  # classes up to which batches have their whole size
EPOCHS = 8
TRAIN_BATCH = 128
LOW = 0.01
UNKNOWN = "und"


def batch_of(rows: int, classes: int) -> int:
    """Rows to work on at once: fewer where there are many classes, so that
    memory does not grow with them."""
    return max(1, rows * WIDE // max(WIDE, classes))


class BiGRU:
    """Parameters, forward pass and gradients.  Both directions are held in
    one array (axis 0: forward, backward) and run in the same steps.

    Shapes, with H units and L classes: x (2, 256, 3H) input weights with bias,
    u (2, H, 3H) recurrent weights, v (2H, L), c (L).  Gates are in the order
    update, reset, candidate.
    """

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 1):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {"x": r.normal(0, 0.3, (2, 256, 3 * hidden)), "u": r.normal(0, hidden ** -0.5, (2, hidden, 3 * hidden)),
                  "v": r.normal(0, 0.3, (2 * hidden, classes)), "c": np.zeros(classes)}
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}

    def states(self, w: np.ndarray, keep: list | None = None) -> np.ndarray:
        """w (n, T) bytes -> states (T, 2H, n), those of the backward GRU in
        text order."""
        n, steps = w.shape
        hid = self.h
        x = np.ascontiguousarray(self.p["x"].transpose(0, 2, 1))
        u = np.ascontiguousarray(self.p["u"].transpose(0, 2, 1))
        h = np.zeros((2, hid, n), dtype=x.dtype)
        out = np.empty((steps, 2 * hid, n), dtype=x.dtype)
        cols = np.ascontiguousarray(w.T).astype(np.intp)
        g = np.empty((2, 3 * hid, n), dtype=x.dtype)
        rec = np.empty_like(g)
        for t in range(steps):
            np.take(x[0], cols[t], axis=1, out=g[0], mode="clip")
            np.take(x[1], cols[steps - 1 - t], axis=1, out=g[1], mode="clip")
            np.matmul(u, h, out=rec)
            zr = g[:, :2 * hid]
            zr += rec[:, :2 * hid]
            zr *= 0.5  # the logistic function by tanh
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :hid], zr[:, hid:]
            raw = rec[:, 2 * hid:]
            cand = r * raw
            cand += g[:, 2 * hid:]
            np.tanh(cand, out=cand)
            if keep is not None:
                keep.append((h, zr.copy(), cand, raw.copy()))
            h = h - cand
            h *= z
            h += cand
            out[t, :hid] = h[0]
            out[steps - 1 - t, hid:] = h[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(T, 2H, n) -> (T, L, n)."""
        a = self.p["v"].T @ states
        a += self.p["c"][:, None]
        np.exp(a, out=a)  # states are within -1..1, so this stays finite
        a /= a.sum(axis=1, keepdims=True)
        return a

    def gradients(self, w: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients by
        backpropagation through time."""
        n, steps = w.shape
        hid = self.h
        keep: list = []
        s = self.states(w, keep)
        p = self.probabilities(s)
        rows = np.arange(n)
        loss = float(-np.log(p[:, y, rows] + 1e-12).mean())
        p[:, y, rows] -= 1
        p /= n * steps
        g = {k: np.zeros_like(a) for k, a in self.p.items()}
        g["v"] = np.einsum("thn,tln->hl", s, p, optimize=True)
        g["c"] = p.sum(axis=(0, 2))
        ds = self.p["v"] @ p
        u = self.p["u"]
        back = np.zeros((2, hid, n), dtype=s.dtype)
        for t in range(steps - 1, -1, -1):
            h, zr, cand, raw = keep[t]
            z, r = zr[:, :hid], zr[:, hid:]
            back[0] += ds[t, :hid]
            back[1] += ds[steps - 1 - t, hid:]
            dz = back * (h - cand) * z * (1 - z)
            dc = back * (1 - z) * (1 - cand * cand)
            dr = dc * raw * r * (1 - r)
            da = np.concatenate((dz, dr, dc), axis=1)
            np.add.at(g["x"][0], w[:, t], da[0].T)
            np.add.at(g["x"][1], w[:, steps - 1 - t], da[1].T)
            da[:, 2 * hid:] *= r
            g["u"] += h @ da.transpose(0, 2, 1)
            back = back * z + u @ da
        return loss, g

    def train(self, w: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = TRAIN_BATCH,
              rate: float = 0.02, seed: int = 2) -> list[float]:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(a) for k, a in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        losses, step = [], 0
        for epoch in range(epochs):
            order = r.permutation(len(w))
            for lo in range(0, len(order), batch):
                loss, g = self.gradients(w[order[lo:lo + batch]], y[order[lo:lo + batch]])
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                now = rate * 0.5 ** (epoch / 2) * min(1.0, 1.0 / (norm + 1e-12))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    fix = now / (1 - 0.9 ** step)
                    self.p[k] -= (fix * m[k] / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return losses


def windows_of(texts: list[bytes], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """All texts (none empty) cut into windows, the last of each filled with
    zero bytes; and the first window of each text."""
    counts = np.array([-(-len(t) // steps) for t in texts])
    padded = b"".join([t + b"\0" * (-len(t) % steps) for t in texts])
    return np.frombuffer(padded, dtype=np.uint8).reshape(-1, steps), np.concatenate(([0], np.cumsum(counts)[:-1]))


class Identifier:
    """A trained network with its languages."""

    def __init__(self, model: BiGRU | None, languages: list[str]):
        self.model, self.languages = model, languages

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): position probabilities pooled over whole texts."""
        w, first = windows_of(texts)
        batch = batch_of(BATCH, len(self.languages))
        sums = np.empty((len(w), len(self.languages)), dtype=np.float32)
        for lo in range(0, len(w), batch):
            p = self.model.probabilities(self.model.states(w[lo:lo + batch]))
            sums[lo:lo + batch] = p.sum(axis=0).T
        # the last window of a text: only its own bytes count
        sizes = np.array([len(t) for t in texts])
        for_last = np.flatnonzero(sizes % STEPS)
        if len(for_last):
            last = np.append(first, len(w))[for_last + 1] - 1
            for lo in range(0, len(last), batch):
                own = last[lo:lo + batch]
                p = self.model.probabilities(self.model.states(w[own]))
                inside = np.arange(STEPS)[:, None] < (sizes[for_last[lo:lo + batch]] % STEPS)[None, :]
                sums[own] = (p * inside[:, None, :]).sum(axis=0).T
        return np.add.reduceat(sums.astype(np.float64), first, axis=0) / sizes[:, None]

    def position_labels(self, text: bytes) -> list[str]:
        """The language of every byte of one text."""
        if not text:
            return []
        w, _ = windows_of([text])
        p = self.model.probabilities(self.model.states(w)).transpose(2, 0, 1).reshape(-1, len(self.languages))
        return [self.languages[i] for i in p[:len(text)].argmax(axis=1)]

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        if some and self.languages:
            p = self.document_probabilities([texts[i] for i in some])
            for i, row in zip(some, p):
                k = int(row.argmax())
                out[i] = (self.languages[k], float(min(1.0, max(0.0, row[k]))))
        return out


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _labelled(docs: DataFrame, doc_id: str, text: str, lang: str, held: bool, *more: Column) -> DataFrame:
    """(i, t, l, h): rows with a language and a letter, h a hash of id and text."""
    inside = held_out(F.col("i"))
    return (docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t"),
                        F.col(f"`{lang}`").cast("string").alias("l"), *more)
            .where(F.col("i").isNotNull() & (inside if held else ~inside) & F.col("l").isNotNull()
                   & F.col("t").rlike(r"\p{L}")).withColumn("h", F.xxhash64("i", "t")))


def _sampled(rows: DataFrame, per_language: int, in_all: int) -> tuple[list[str], int, DataFrame | None]:
    """The languages of labelled rows, how many documents of each to keep, and
    rows of somewhat more, equal ones included."""
    # the classes and about how many different documents each has
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return [], 0, None
    each = max(1, min(per_language, in_all // len(counts)))
    # more than are kept, so that chance leaves no language without
    share = rows.sparkSession.createDataFrame(
        [(k, min(1.0, (2 * each + 20) / n)) for k, n in counts.items()], "l string, share double")
    return sorted(counts), each, rows.join(F.broadcast(share), "l").where(
        (F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)) < F.col("share"))


def _first(picked: DataFrame, each: int) -> DataFrame:
    """``each`` rows of every language."""
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    return picked.withColumn("rank", rank).where(F.col("rank") <= each)


def train_identifier(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                     per_language: int = DOCS_PER_LANGUAGE, seed: int = 1, in_all: int = SAMPLE_DOCS) -> Identifier:
    languages, each, rows = _sampled(_labelled(docs, doc_id, text, lang, False), per_language, in_all)
    if not languages:
        return Identifier(None, [])
    places = [F.substring(F.col("t"), (F.pmod(F.xxhash64("i", F.lit(k)), F.greatest(
        F.length("t") - STEPS, F.lit(1)).cast("bigint")) + 1).cast("int"), F.lit(STEPS)) for k in range(WINDOWS_PER_DOC)]
    picked = (_first(rows.groupBy("l", "h").agg(F.first(F.array(*places)).alias("w")), each)
              .select("l", "h", F.explode("w").alias("w")).orderBy("h", "l", "w").collect())
    w = np.zeros((len(picked), STEPS), dtype=np.uint8)
    for i, r in enumerate(picked):
        b = np.frombuffer(r["w"].encode()[:STEPS], dtype=np.uint8)
        w[i, :len(b)] = b
    at = {k: i for i, k in enumerate(languages)}
    y = np.array([at[r["l"]] for r in picked])
    model = BiGRU(len(languages), seed=seed)
    model.train(w, y)
    return Identifier(model, languages)


def low_quantiles(scores: DataFrame, low: float = LOW) -> dict[str, float]:
    """Per ``l`` the exact ``low`` quantile of ``score`` (0 to 1), interpolated
    between the two scores next to it, over all rows of a stored table (l, score).

    Their ranks are looked up in counts of ever finer bins, of which only those
    two are looked into, so that no task or group holds the scores of a language."""
    at = F.col("lo") + F.col("t")  # the quantile's place among the sorted scores, from 0
    bins = (scores.groupBy("l").agg(((F.count(F.lit(1)) - 1) * F.lit(low)).alias("place"))
            .select("l", F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("base"),
                    F.floor("place").alias("lo"), (F.col("place") - F.floor("place")).alias("t")))
    before = 0
    for bits in (16, 32, 53):
        finer = F.floor(F.col("score") * float(1 << bits)).cast("bigint")
        inside = (scores.withColumn("bin", F.when(F.lit(before > 0), F.floor(F.col("score") * float(1 << before)))
                                    .otherwise(F.lit(0)).cast("bigint"))
                  .join(F.broadcast(bins), ["l", "bin"])
                  .groupBy("l", "bin", "base", "lo", "t", finer.alias("finer"))
                  .agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")))
        below = F.col("base") + F.coalesce(F.sum("n").over(
            Window.partitionBy("l", "bin").orderBy("finer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = (inside.withColumn("below", below).where((F.col("below") <= F.ceil(at)) & (F.col("below") + F.col("n") > F.col("lo")))
                .select("l", F.col("finer").alias("bin"), F.col("below").alias("base"), "lo", "t", "n", "score").collect())
        bins = scores.sparkSession.createDataFrame([r[:5] for r in rows], "l string, bin long, base long, lo long, t double")
        before = bits
    found: dict[str, dict[int, tuple[float, float]]] = {}
    for r in rows:
        own = found.setdefault(r["l"], {})
        for k in (r["lo"], r["lo"] + 1):
            if r["base"] <= k < r["base"] + r["n"]:
                own[k] = (r["score"], r["t"])
    out = {}
    for k, own in found.items():
        (x, t), (y, _) = own[min(own)], own[max(own)]
        out[k] = x + (y - x) * t
    return out


def least_scores(scored: DataFrame, identifier: Identifier, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                 lang_pred: str = "lang_pred", score: str = "score", name: str = "language") -> dict[str, float]:
    """Per language a score that its documents hardly stay under: midway between
    chance (one over the number of languages) and the LOW quantile of the scores
    of all held-out documents rightly predicted as it, equal rows counted once
    (``scored``: rows of ``predicted``).  A language without such documents takes
    the quantile of all, and chance is the least score where nothing is held out."""
    chance = 1 / max(1, len(identifier.languages))
    if not identifier.languages:
        return {}
    right = stored(_labelled(scored, doc_id, text, lang, True, F.col(lang_pred).alias("said"), F.col(score).alias("score"))
                   .where("l = said").groupBy("l", "h").agg(F.min("score").alias("score")).select("l", "score"),
                   f"{name}/right")
    own = low_quantiles(right)
    if own.keys() >= set(identifier.languages):
        every = chance
    else:
        every = low_quantiles(right.withColumn("l", F.lit(""))).get("", chance)
    return {k: (chance + own.get(k, every)) / 2 for k in identifier.languages}


def known(scored: DataFrame, least: dict[str, float], lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Rows of ``predicted`` whose language is known with at least its score of
    ``least``, without these two columns."""
    from_ = scored.sparkSession.createDataFrame(list(least.items()), "__language string, __least double")
    return (scored.join(F.broadcast(from_), F.col(lang_pred) == F.col("__language"))
            .where((F.col(lang_pred) != UNKNOWN) & (F.col(score) >= F.col("__least")))
            .drop(lang_pred, score, "__language", "__least"))


def predicted(docs: DataFrame, identifier: Identifier, text: str = "text",
              keep_from: float | dict[str, float] | None = None,
              lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with lang_pred and score for every whole text (columns of these
    names are replaced).

    With ``keep_from``, instead, the rows of ``docs`` whose language is known
    with at least that score (or that of the language), unchanged.
    """
    ship(docs.sparkSession)
    if keep_from is None:
        docs = docs.drop(lang_pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(
        (identifier.languages, identifier.model.p if identifier.model else None))
    least = keep_from if isinstance(keep_from, dict) else dict.fromkeys(identifier.languages, keep_from)
    wanted = docs.withColumn("__letters", F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"\p{L}"), F.lit(False)))
    at = docs.columns.index(text)
    names = [*docs.columns, *([] if keep_from is not None else [lang_pred, score])]

    def run(batches):
        languages, p = shared.value
        model = None
        if p is not None:
            model = BiGRU(len(languages))
            model.p = p
        who = Identifier(model, languages)
        rows = batch_of(250, len(languages))
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                s = b.slice(lo, rows)
                texts = s.column(at).cast(pa.string()).cast(pa.binary()).to_pylist()
                letters = s.column(s.num_columns - 1).to_pylist()
                said = who.predict([t if ok else b"" for t, ok in zip(texts, letters)])
                columns = [s.column(i) for i in range(s.num_columns - 1)]
                if keep_from is not None:
                    kept = pa.array([x != UNKNOWN and y >= least[x] for x, y in said], pa.bool_())
                    yield pa.RecordBatch.from_arrays(columns, names=names).filter(kept)
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array([x for x, _ in said], pa.string()),
                         pa.array([y for _, y in said], pa.float64())], names=names)

    schema = docs.schema if keep_from is not None else docs.limit(0).withColumns(
        {lang_pred: F.lit(""), score: F.lit(0.0)}).schema
    return wanted.mapInArrow(run, schema)


def op2_language(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    who = train_identifier(docs)
    return (predicted(docs.select("doc_id", "text"), who)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))
