"""Operator 2: toxicity by a character n-gram linear classifier with naive Bayes scaled features.

Features are the hashed character n-grams that a text contains (presence, not
count). Each is scaled by its naive Bayes log-count ratio
``log((p / |p|) / (q / |q|))``, and a logistic regression is trained on the
scaled features. The fold of ratio and weight is one vector of fixed size, which
is all that scoring needs: one scan of the corpus, no shuffle.

Defined results: a null or empty text scores the bias alone and is not toxic; a
null label isn't used for training; a document labelled more than once is
trained on once per label row; extra columns are kept by ``reject`` and ignored
by ``score``. With fewer than three labelled rows of a class nothing is toxic (each
fold of the threshold's choice needs one). Texts of one to three characters have
no feature and score the bias alone; a score equal to the threshold isn't toxic;
long texts are read whole; repeated rows score alike; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K
from ._spark import table

ORDERS = (4, 5, 6)
BITS = 20
#: Bound on the labelled rows that the classifier is fitted on, per class.
MAX_TOXIC, MAX_CLEAN = 1500, 3000
#: A feature must occur in so many training documents.
LEAST_DOCS = 8


def _features(texts: list[str]) -> Iterator[np.ndarray]:
    """The distinct hashed n-grams of every text, over lower-cased text with white space folded to one kind."""
    codes, offsets = K.codepoints(texts)
    codes = K.lower(codes)
    codes = np.where(K.is_kind(codes, "space"), np.uint32(32), codes)
    span = K.SpanHash(codes)
    n = len(codes)
    ids = []
    for order in ORDERS:
        at = np.arange(max(0, n - order + 1))
        ids.append((span(at, at + order) >> np.uint64(64 - BITS)).astype(np.int32))
    seen = np.full(1 << BITS, -1, np.int32)
    for d in range(len(texts)):
        s, e = offsets[d], offsets[d + 1]
        own = np.concatenate([x[s : max(s, e - o + 1)] for x, o in zip(ids, ORDERS)])
        mark = np.arange(len(own), dtype=np.int32)
        seen[own] = mark
        yield own[seen[own] == mark]


class Model:
    """The folded weights, the bias and the threshold on the log-odds."""

    def __init__(self, weights: np.ndarray, bias: float, threshold: float):
        self.weights, self.bias, self.threshold = weights, bias, threshold

    def score(self, texts: list[str]) -> np.ndarray:
        return np.array([self.weights[x].sum(dtype=np.float64) + self.bias for x in _features(texts)])


def _solve(rows: list[np.ndarray], toxic: np.ndarray, train: np.ndarray, epochs: int, alpha: float, ridge: float) -> tuple[np.ndarray, float]:
    """Weights on the raw features (ratio times regression weight) and the bias, from the rows in ``train``."""
    size = 1 << BITS
    p, q, docs = (np.zeros(size) for _ in range(3))
    for i in np.flatnonzero(train):
        (p if toxic[i] else q)[rows[i]] += 1
        docs[rows[i]] += 1
    share = toxic[train].mean()
    ratio = np.log((p + alpha) / (q + alpha)) - np.log((toxic[train].sum() + alpha) / ((1 - toxic[train]).sum() + alpha))
    ratio[docs < min(LEAST_DOCS, max(2, train.sum() // 100))] = 0
    z = np.abs(p - docs * share) / np.sqrt(np.maximum(docs, 1) * share * (1 - share))
    ratio[z < min(4, 0.5 * np.sqrt(train.sum()))] = 0  # not told apart from chance; a few rows can't give more than the root of their number
    keep = ratio != 0
    ids = np.cumsum(keep) - 1
    some = np.flatnonzero(train)
    cols = [ids[rows[i][keep[rows[i]]]] for i in some]
    y, r = toxic[some], ratio[keep]
    flat = np.concatenate([*cols, np.zeros(0, np.int64)]).astype(np.int64)
    row_of = np.repeat(np.arange(len(some)), [len(c) for c in cols])
    w, b, x = np.zeros(len(r)), 0.0, r[flat]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    gw, gb = np.full(len(w), 1e-8), 1e-8
    for _ in range(epochs):  # full-batch steps with a rate for every weight
        z = np.bincount(row_of, x * w[flat], len(some)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        dw, db = np.bincount(flat, x * g[row_of], len(w)) + ridge * w, g.sum()
        gw += dw * dw
        gb += db * db
        w -= 0.1 * dw / np.sqrt(gw)
        b -= 0.1 * db / np.sqrt(gb)
    out = np.zeros(size, np.float32)
    out[keep] = r * w
    return out, float(b)


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 60, alpha: float = 0.5, ridge: float = 1e-4) -> Model:
    """Train on labelled texts; the threshold of best F1 comes from scores that three folds give each other."""
    toxic = np.asarray(toxic, np.float64)
    if min(toxic.sum(), (1 - toxic).sum()) < 3:
        return Model(np.zeros(1 << BITS, np.float32), -1.0, 0.0)
    rows = []
    for i in range(0, len(texts), 100):
        rows += list(_features(texts[i : i + 100]))
    fold = np.zeros(len(rows), np.int64)
    for y in (0, 1):
        fold[toxic == y] = np.arange((toxic == y).sum()) % 3
    z = np.zeros(len(rows))
    for k in range(3):
        w, b = _solve(rows, toxic, fold != k, epochs, alpha, ridge)
        for i in np.flatnonzero(fold == k):
            z[i] = w[rows[i]].sum(dtype=np.float64) + b
    order = np.argsort(-z)
    hit = np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(hit) + 1) + toxic.sum())
    best = int(np.argmax(f1))
    below = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1
    w, b = _solve(rows, toxic, np.ones(len(rows), bool), epochs, alpha, ridge)
    return Model(w, b, float((z[order][best] + below) / 2))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on at most ``max_toxic`` and ``max_clean`` labelled documents, taken by a hash of their id."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic")
    ordered = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("_o"))
    some = ordered.where("toxic = 1").orderBy("_o").limit(max_toxic).union(ordered.where("toxic = 0").orderBy("_o").limit(max_clean))
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where("text is not null").select("text", "toxic", "_o").toPandas().sort_values("_o")
    return fit(got["text"].tolist(), got["toxic"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, toxic)`` for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in K.chunks(batch):
                z = sent.value.score(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(z), pa.array(z > sent.value.threshold)], ["doc_id", "score", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, toxic boolean")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that aren't toxic, all columns kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in K.chunks(batch):
                yield part.filter(pa.array(sent.value.score(texts) <= sent.value.threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents: ``(doc_id, score)``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).where("toxic").select("doc_id", "score")
