"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each category's logistic model
sees the text features and the probabilities of the categories before it.  In
training those probabilities are out of fold: FOLDS models per category, each
applied to the rows it was not fitted on.  The models used for prediction are
fitted on all sampled rows.

Features are words, their beginnings (PREFIXES bytes, marked ``^``) and a few
style measures.  The words and beginnings that tell most about any category
(chi-square of document frequencies) are chosen from the sample; their values
are square roots of their shares of the text.

The sample is bounded in documents: up to ROWS_PER_CLASS labelled documents of
each value of the label that is being learned most of all (``toxic``), chosen by
hash of id and text among the different ones, so neither a copied document nor
an id of many documents counts for more than it has.  Prediction covers all
words of all texts.

Categories of the query, in chain order: ``junk`` (labelled quality 0),
``toxic`` (labelled toxic), ``severe`` (labelled toxic, with at least the
median number of toxic feature occurrences among toxic rows).

Null or blank text: no features; its probabilities are 0 and it is not toxic.
Documents without a label are only predicted.  Labels without a document, with
a null id or null values are left out of the sample; equal ones, and equal
documents of one id, count once.  With no toxic or no clean labelled row nothing can be learned: all
probabilities are 0.  An empty table gives no rows.  Only the named columns are
read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.llm.common import ship, stored, table
from fleetlog.llm.decontaminate import words_of

CATEGORIES = ["junk", "toxic", "severe"]
ROWS_PER_CLASS = 3000
FEATURES = 600
PREFIXES = (5, 6, 7, 8)
FOLDS = 5
STEPS = 250
RIDGE = 1e-3
KNOWN_WORDS = 500_000


def word_features(word: bytes) -> list[bytes]:
    return [word, *(b"^" + word[:k] for k in PREFIXES if len(word) > k)]


def style(text: bytes, n_words: int, n_distinct: int) -> list[float]:
    """Measures of 0 to about 1, whatever the length."""
    n = max(1, len(text))
    a = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) if text else np.zeros(256)
    upper, digits = a[65:91].sum() / n, a[48:58].sum() / n
    marks = (a[33:48].sum() + a[58:65].sum() + a[91:97].sum() + a[123:127].sum()) / n
    return [float(upper), float(digits), float(marks), n_distinct / max(1, n_words), min(1.0, np.log1p(n_words) / 10),
            float(a[10] / n)]


class Chain:
    """Vocabulary, one weight vector per category and the toxic threshold."""

    def __init__(self, vocabulary: dict[bytes, int], weights: list[np.ndarray], threshold: float):
        self.vocabulary, self.weights, self.threshold = vocabulary, weights, threshold
        self._known: dict[bytes, tuple[int, ...]] = {}

    def counts(self, text: bytes) -> tuple[dict[int, int], int, int]:
        """(feature -> occurrences, words, distinct words) of one whole text."""
        known, vocabulary = self._known, self.vocabulary
        words = Counter(words_of(text))
        out: dict[int, int] = {}
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w, n in words.items():
            at = known.get(w)
            if at is None:
                at = known[w] = tuple(vocabulary[f] for f in word_features(w) if f in vocabulary)
            for i in at:
                out[i] = out.get(i, 0) + n
        return out, sum(words.values()), len(words)

    def row(self, text: bytes) -> np.ndarray:
        found, n, distinct = self.counts(text)
        x = np.zeros(len(self.vocabulary) + STYLE, dtype=np.float32)
        for i, c in found.items():
            x[i] = _value(c, n)
        x[len(self.vocabulary):] = style(text, n, distinct)
        return x

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """(texts, categories) probabilities."""
        out = np.zeros((len(texts), len(self.weights)))
        some = [i for i, t in enumerate(texts) if t.strip()]
        if some and self.weights:
            x = np.stack([self.row(texts[i]) for i in some])
            before = np.zeros((len(some), 0), dtype=np.float32)
            for k, w in enumerate(self.weights):
                p = _probability(_with(x, before), w)
                out[some, k] = p
                before = np.column_stack((before, p))
        return out


STYLE = len(style(b"", 0, 0))


def _value(count: float, words: int) -> float:
    return 5 * (count / (words + 10)) ** 0.5


def _with(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.column_stack((x, before, np.ones(len(x), dtype=np.float32))).astype(np.float32)


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights by gradient descent with momentum; both classes weigh alike."""
    w = np.zeros(x.shape[1], dtype=np.float32)
    pos = float(y.mean())
    if pos in (0.0, 1.0):
        w[-1] = 8 if pos else -8
        return w
    weigh = np.where(y > 0, 0.5 / pos, 0.5 / (1 - pos)).astype(np.float32)
    u = np.ones(x.shape[1], dtype=np.float32)  # largest eigenvalue of the Gram matrix
    for _ in range(12):
        u = x.T @ (weigh * (x @ u))
        top = float(np.linalg.norm(u))
        u /= top
    rate = 1 / (0.25 * top / len(y) + ridge)
    v = np.zeros_like(w)
    for _ in range(steps):
        g = x.T @ (weigh * (_probability(x, w) - y)) / len(y) + ridge * w
        v = 0.9 * v - 0.9 * rate * g.astype(np.float32)
        w = w + v
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights per category and the out-of-fold probabilities (rows, categories)."""
    before = np.zeros((len(x), 0), dtype=np.float32)
    weights = []
    for k in range(labels.shape[1]):
        own, y = _with(x, before), labels[:, k].astype(np.float32)
        out = np.zeros(len(x), dtype=np.float32)
        for f in range(FOLDS):
            inside = folds == f
            if inside.any() and not inside.all():
                out[inside] = _probability(own[inside], fit_logistic(own[~inside], y[~inside]))
        weights.append(fit_logistic(own, y))
        before = np.column_stack((before, out))
    return weights, before


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1 on out-of-fold probabilities, midway to the
    next lower probability."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(1, y.sum()))
    i = int(f1.argmax())
    low = p[order[i + 1]] if i + 1 < len(p) else 0.0
    return float((p[order[i]] + low) / 2)


def sample(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, doc_id: str = "doc_id",
           text: str = "text", name: str = "toxicity") -> DataFrame:
    """(doc_id, text_hash, junk, toxic, text) of the sampled labelled documents."""
    flags = labels.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
                          (F.col("quality") == 0).cast("int").alias("junk"),
                          (F.col("toxic") == 1).cast("int").alias("toxic")).dropna().distinct()
    texts = (docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
                         F.col(f"`{text}`").cast("string").alias("text"))
             .where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
             .withColumn("text_hash", F.xxhash64("doc_id", "text")))
    # narrow rows: no text is shuffled here
    pairs = stored(texts.select("doc_id", "text_hash").distinct().join(flags, "doc_id"), f"{name}/pairs")
    n = {r["toxic"]: r["n"] for r in pairs.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # more than are kept, so that chance leaves no class short
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, 1.5 * rows_per_class / max(1, n.get(1, 0))))).otherwise(
        F.lit(min(1.0, 1.5 * rows_per_class / max(1, n.get(0, 0)))))
    first = Window.partitionBy("toxic").orderBy("text_hash", "doc_id", "junk")
    picked = (pairs.where(F.pmod("text_hash", F.lit(1 << 30)) / float(1 << 30) < share)
              .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= rows_per_class).drop("rank"))
    # at most 2 * rows_per_class narrow rows
    return texts.join(F.broadcast(picked), ["doc_id", "text_hash"]).dropDuplicates(
        ["doc_id", "text_hash", "junk", "toxic"])


def choose_features(rows: DataFrame, features: int = FEATURES) -> list[bytes]:
    """The features that tell most about junk and about toxic, half each, by
    chi-square over the sample; document frequencies are counted per task."""
    ship(rows.sparkSession)

    def run(batches):
        seen: dict[bytes, list[int]] = {}
        for b in batches:
            for t, junk, toxic in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(),
                                      b.column(2).to_pylist()):
                own = {f for w in set(words_of(t)) for f in word_features(w)}
                for f in own:
                    c = seen.setdefault(f, [0, 0, 0])
                    c[0] += 1
                    c[1] += junk
                    c[2] += toxic
        keys = list(seen)
        for lo in range(0, len(keys), 50_000):
            part = keys[lo:lo + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), *(pa.array([seen[k][i] for k in part], pa.int64()) for i in range(3))],
                names=["feature", "n", "junk", "toxic"])

    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("junk").alias("junk"), F.sum("toxic").alias("toxic")).first()
    freq = (rows.select("text", "junk", "toxic").mapInArrow(run, "feature binary, n long, junk long, toxic long")
            .groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "junk", "toxic")]).where("n >= 3"))
    freq = stored(freq, "toxicity/frequencies")
    out: dict[bytes, None] = {}
    for kind in ("toxic", "junk"):
        base = (total[kind] or 0) / max(1, total["n"] or 0)
        if not 0 < base < 1:
            continue
        expected = F.col("n") * base
        score = (F.col(kind) - expected) * (F.col(kind) - expected) / expected / (1 - base)
        for r in (freq.where(F.col(kind) > expected).orderBy(F.desc(score), "feature").limit(features // 2).collect()):
            out[bytes(r["feature"])] = None
    return list(out)


def train_chain(docs: DataFrame, labels: DataFrame, name: str = "toxicity", **columns) -> Chain:
    rows = stored(sample(docs, labels, name=name, **columns), f"{name}/sample")
    vocabulary = {f: i for i, f in enumerate(choose_features(rows))}
    shape = Chain(vocabulary, [], 1.0)

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            found = [shape.counts(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), b.column(3), pa.array([list(f) for f, _, _ in found], pa.list_(pa.int32())),
                pa.array([list(f.values()) for f, _, _ in found], pa.list_(pa.int64())),
                pa.array([n for _, n, _ in found], pa.int64()),
                pa.array([style(t, n, d) for t, (_, n, d) in zip(texts, found)], pa.list_(pa.float64())),
                b.column(4)],
                names=["doc_id", "junk", "toxic", "at", "counts", "words", "style", "text_hash"])

    got = (rows.select("doc_id", "text", "junk", "toxic", "text_hash")
           .mapInArrow(run, "doc_id long, junk int, toxic int, at array<int>, counts array<long>, words long, "
                            "style array<double>, text_hash long")
           .orderBy("doc_id", "text_hash", "junk", "toxic").collect())  # the bounded sample
    toxic = np.array([r["toxic"] for r in got], dtype=np.int64)
    if not len(got) or toxic.all() or not toxic.any():
        return Chain({}, [], 1.0)
    x = np.zeros((len(got), len(vocabulary) + STYLE), dtype=np.float32)
    hits = np.zeros(len(got))
    half = FEATURES // 2  # features of toxic come first
    for k, r in enumerate(got):
        for i, c in zip(r["at"], r["counts"]):
            x[k, i] = _value(c, r["words"])
            hits[k] += c * (i < half)
        x[k, len(vocabulary):] = r["style"]
    severe = toxic * (hits >= max(1.0, np.median(hits[toxic > 0])))
    y = np.column_stack([[r["junk"] for r in got], toxic, severe])
    folds = np.array([(r["doc_id"] * 2654435761 >> 7) % FOLDS for r in got])
    weights, out = fit_chain(x, y, folds)
    return Chain(vocabulary, weights, best_threshold(out[:, 1], toxic))


def toxicity(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, toxic, p_junk, p_toxic, p_severe) of every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((chain.vocabulary, chain.weights, chain.threshold))

    def run(batches):
        own = Chain(*shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                s = b.slice(lo, 500)
                p = own.predict([t or b"" for t in s.column(1).cast(pa.binary()).to_pylist()])
                if not p.shape[1]:
                    p = np.zeros((len(p), len(CATEGORIES)))
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array((p[:, 1] >= own.threshold) & (p[:, 1] > 0)),
                     *(pa.array(p[:, k]) for k in range(len(CATEGORIES)))],
                    names=["doc_id", "toxic", *(f"p_{c}" for c in CATEGORIES)])

    return (docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
            .mapInArrow(run, "doc_id long, toxic boolean, " + ", ".join(f"p_{c} double" for c in CATEGORIES)))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    chain = train_chain(docs, table(spark, sf_dir, "labels"), "op10")
    return toxicity(docs, chain)
