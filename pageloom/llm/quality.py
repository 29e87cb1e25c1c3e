"""Operator 9: quality classification by a factorisation machine.

Features are hashed words (presence, scaled to unit length), structure
statistics of the text cut into steps, and metadata (language, source, length).
``y = b + w.x + sum_{i<j} <v_i, v_j> x_i x_j``; the pair term is scored in linear
time as ``(|sum v_i x_i|**2 - sum |v_i x_i|**2) / 2``. Training is AdaGrad in
numpy on a bounded sample of labelled rows; scoring is one scan.

Defined results: a null or empty text has no words and is scored by structure
and metadata alone; null metadata is a value of its own; null labels aren't used;
without both classes among the labels everything is kept; extra columns are
ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K
from ._spark import table

BITS = 18
RANK = 8
#: Bound on the labelled rows that the model is fitted on, per class.
MAX_GOOD, MAX_POOR = 2500, 2500
_EDGES = np.array([0.0, 0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])
_META = ("lang", "source")


def _salted(name: str, value: object) -> int:
    codes, at = K.codepoints([f"{name}\x00{value}"])
    return int(K.SpanHash(codes)(at[:-1], at[1:])[0] >> np.uint64(64 - BITS))


def _steps(codes: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashed steps of the structure statistics, one row per text."""
    n = np.maximum(np.diff(offsets), 1)
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    alpha, digit, space = K.is_kind(codes, "alpha"), K.is_kind(codes, "digit"), K.is_kind(codes, "space")
    count = np.diff(at)
    distinct, top, edge = (np.zeros(len(count)) for _ in range(3))
    odd = ~(alpha | digit | space)
    tail = np.concatenate(([0], np.cumsum(odd[end - 1]))) if len(end) else np.zeros(1)
    for i, (s, e) in enumerate(zip(at[:-1], at[1:])):
        if e > s:
            c = np.unique(words[s:e], return_counts=True)[1]
            distinct[i], top[i] = len(c) / (e - s), c.max() / (e - s)
            edge[i] = (tail[e] - tail[s]) / (e - s)
    stats = [total(alpha) / n, total(digit) / n, total(space) / n, total(odd) / n, total(K.is_kind(codes, "upper")) / np.maximum(total(alpha), 1), distinct, top, edge, np.minimum(1, (n / np.maximum(count, 1)) / 20), total(codes == 10) / n * 5, np.log2(np.diff(offsets) + 1) / 24]
    made = np.stack([np.searchsorted(_EDGES, s, "right") + 64 * k for k, s in enumerate(stats)], axis=1).astype(np.uint64)
    return (K.mix(made + np.uint64(0x517CC1B7)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: list[str], meta: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids and values of all texts, and the offsets per text."""
    codes, offsets = K.codepoints(texts)
    codes = K.lower(raw := codes)
    start, end, at = K.split_words(codes, offsets)
    words = K.SpanHash(codes)(start, end)
    steps = _steps(raw, offsets, start, end, words, at)
    hashed = (words >> np.uint64(64 - BITS)).astype(np.int64)
    ids, values = [], []
    known: dict[tuple, int] = {}
    for i, (s, e) in enumerate(zip(at[:-1], at[1:])):
        own = np.unique(hashed[s:e])
        extra = [known.setdefault((k, v), -1) for k, v in zip(_META, meta[i])]
        for j, (k, v) in enumerate(zip(_META, meta[i])):
            if extra[j] < 0:
                extra[j] = known[(k, v)] = _salted(k, v)
        ids.append(np.concatenate([own, steps[i], np.array(extra, np.int64)]))
        values.append(np.concatenate([np.full(len(own), 1 / np.sqrt(max(1, len(own)))), np.full(steps.shape[1] + len(extra), 0.3)]))
    out = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=out[1:])
    return np.concatenate(ids), np.concatenate(values), out


class Model:
    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray, threshold: float):
        self.bias, self.linear, self.factors, self.threshold = bias, linear, factors, threshold

    def raw(self, ids: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores by the sum-of-squares identity; every text has features."""
        vx = self.factors[ids] * values[:, None].astype(np.float32)
        total = np.add.reduceat(vx, at[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), at[:-1])
        return self.bias + np.add.reduceat(self.linear[ids] * values, at[:-1]) + 0.5 * ((total * total).sum(axis=1) - squares)

    def score(self, texts: list[str], meta: list[tuple]) -> np.ndarray:
        return self.raw(*features(texts, meta))


def fit(texts: list[str], meta: list[tuple], good: np.ndarray, epochs: int = 15, rate: float = 0.1, ridge: float = 1e-4, seed: int = 7) -> Model:
    """AdaGrad on logistic loss with balanced classes; the threshold gives the best balanced accuracy on a held-out fifth."""
    y = np.asarray(good, np.float64)
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(1 << BITS), rng.normal(0, 0.02, (1 << BITS, RANK)).astype(np.float32), -np.inf)
    if len(y) == 0 or y.min() == y.max():
        return model
    parts = [features(texts[i : i + 100], meta[i : i + 100]) for i in range(0, len(texts), 100)]
    rows = [(ids[s:e], values[s:e]) for ids, values, at in parts for s, e in zip(at[:-1], at[1:])]
    held = np.zeros(len(y), bool)
    for k in (0, 1):
        held[np.flatnonzero(y == k)[::5]] = True
    if len(set(y[~held])) < 2:
        held[:] = False
    weight = np.where(y == 1, 0.5 / (y[~held] == 1).mean(), 0.5 / (y[~held] == 0).mean())
    gw, gv, gb = np.full(1 << BITS, 1e-6), np.full((1 << BITS, RANK), 1e-6, np.float32), 1e-6
    train = np.flatnonzero(~held)
    pack = lambda some: (np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some]), np.concatenate(([0], np.cumsum([len(rows[i][0]) for i in some]))))
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            ids, x, at = pack(some)
            row = np.repeat(np.arange(len(some)), np.diff(at))
            g = (1 / (1 + np.exp(-np.clip(model.raw(ids, x, at), -30, 30))) - y[some]) * weight[some] / len(some)
            v = model.factors[ids]
            vx = v * x[:, None].astype(np.float32)
            total = np.add.reduceat(vx, at[:-1], axis=0)
            each = (g[row] * x)[:, None] * (total[row] - vx)
            at_id, back = np.unique(ids, return_inverse=True)
            dw = np.bincount(back, g[row] * x, len(at_id)) + ridge * model.linear[at_id]
            dv = np.stack([np.bincount(back, each[:, f], len(at_id)) for f in range(RANK)], axis=1) + ridge * model.factors[at_id]
            gw[at_id] += dw * dw
            gv[at_id] += dv * dv
            gb += g.sum() ** 2
            model.linear[at_id] -= rate * dw / np.sqrt(gw[at_id])
            model.factors[at_id] -= (0.5 * rate * dv / np.sqrt(gv[at_id])).astype(np.float32)
            model.bias -= rate * g.sum() / np.sqrt(gb)
    check = np.flatnonzero(held) if held.any() else train
    z, yz = model.raw(*pack(check)), y[check]
    order = np.argsort(z)
    poor, kept = np.cumsum(yz[order] == 0), (yz == 1).sum() - np.cumsum(yz[order] == 1)
    balanced = np.concatenate(([0.5], (poor / (yz == 0).sum() + kept / (yz == 1).sum()) / 2))
    best = int(np.argmax(balanced))
    model.threshold = float((z[order][best - 1] + z[order][min(best, len(z) - 1)]) / 2) if best else float(z.min()) - 1
    return model


def train(docs: DataFrame, labels: DataFrame, max_good: int = MAX_GOOD, max_poor: int = MAX_POOR) -> Model:
    """Fit on at most so many labelled documents of either class, taken by a hash of their id."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality", F.xxhash64("doc_id").alias("_o"))
    some = known.where("quality = 1").orderBy("_o").limit(max_good).union(known.where("quality = 0").orderBy("_o").limit(max_poor))
    got = docs.select("doc_id", "text", *_META).join(F.broadcast(some), "doc_id").toPandas().sort_values("_o")
    return fit([t or "" for t in got["text"]], list(zip(*(got[c] for c in _META))), got["quality"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, keep)`` for every document; a score above 0 leans to good."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in K.chunks(batch):
                z = sent.value.score(texts, list(zip(part.column(2).to_pylist(), part.column(3).to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(z, pa.float64()), pa.array(z > sent.value.threshold)], ["doc_id", "score", "keep"])

    return docs.select("doc_id", "text", *_META).mapInArrow(run, "doc_id long, score double, keep boolean")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of good quality with their scores."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).where("keep").select("doc_id", "score")
