import numpy as np
import pytest
from cases import CLASH, D2
from pyspark.sql import functions as F

from pageloom.llm import ann
from pageloom.llm._spark import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, v, k):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i, row in zip(ids, v):
        sim = v @ row
        out[i] = [j for _, j in sorted((-s, j) for s, j in zip(sim, ids) if j != i)][:k]
    return out


def recall(got, want):
    mine = {}
    for r in got:
        mine.setdefault(r["vec_id"], set()).add(r["neighbour"])
    return np.mean([len(mine.get(i, set()) & set(w)) / len(w) for i, w in want.items()])


def test_recall_on_embeddings(spark):
    v = table(spark, D2, "embeddings")
    rows = v.orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)
    want = {i: n for i, n in brute(ids, x, ann.K_NEAREST).items() if i % ann.EVERY == 0}
    got = ann.neighbours(v).collect()
    assert recall(got, want) >= 0.9 and len(got) == ann.K_NEAREST * len(want)
    assert {r["vec_id"] for r in got} == set(want) and all(r["vec_id"] != r["neighbour"] for r in got)


@pytest.mark.parametrize(("n", "block"), [(2500, None), (12_000, None), (12_000, 3000)])
def test_recall_without_clusters(spark, n, block, monkeypatch):
    if block:
        monkeypatch.setattr(ann, "BLOCK", block)
    v = np.random.default_rng(5).normal(size=(n, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA).repartition(4)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    near = unit[:: ann.EVERY] @ unit.T
    near[np.arange(len(near)), np.arange(len(near)) * ann.EVERY] = -2
    want = {i * ann.EVERY: np.argsort(-x)[: ann.K_NEAREST].tolist() for i, x in enumerate(near)}
    assert recall(ann.neighbours(df).collect(), want) >= 0.9


def test_footrule_gain_orders_like_footrule():
    rng = np.random.default_rng(1)
    q, m = (np.stack([rng.permutation(20)[:8] for _ in range(n)]).astype(np.uint16) for n in (3, 40))
    files = ann.inverted_files(m, 20)

    def footrule(x, y):
        """Over all pivots; those outside a prefix stand right after it."""
        place = lambda p, z: np.flatnonzero(p == z)[0] if z in p else len(p)
        return sum(abs(place(x, z) - place(y, z)) for z in range(20))

    for i in range(len(q)):
        d = np.array([footrule(q[i], y) for y in m])
        assert len({int(a + 2 * b) for a, b in zip(d, ann.footrule_gain(q[i], files).astype(int))}) == 1


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, base), (2, base), (3, [2.0, 0.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0, 0.0]), (5, None), (6, []), (7, [0.0] * 4), (8, [nan, 1.0, 0.0, 0.0]), (9, [inf, 0.0, 0.0, 0.0]), (10, [1.0, None, 0.0, 0.0]), (11, [1.0, 2.0]), (None, base), (12, [0.0, 0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    for c in ("file", "at", "id", "v", "perm", "len", "d", *CLASH[:5]):
        df = df.withColumn(c, F.lit("x"))
    got = {}
    for r in ann.neighbours(df, every=1).orderBy("vec_id", "rank").collect():
        got.setdefault(r["vec_id"], []).append(r["neighbour"])
    assert set(got) == {1, 2, 3, 4, 12} and all(len(x) == 4 for x in got.values())
    assert got[1][:2] == [2, 3] and got[2][:2] == [1, 3] and got[3][:2] == [1, 2]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)]])
def test_nothing_to_find(spark, rows):
    assert ann.neighbours(spark.createDataFrame(rows, SCHEMA), every=1).count() == 0
