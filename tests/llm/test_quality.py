import itertools

import numpy as np
import pytest
from cases import D2, D3, ODD
from pyspark.sql import functions as F

from pageloom.llm import quality
from pageloom.llm._spark import table


def test_held_out_accuracy(spark):
    docs, labels = table(spark, D3, "documents"), table(spark, D3, "labels")
    model = quality.train(docs, labels.where("doc_id % 3 > 0"), 800, 800)
    held = labels.where("doc_id % 3 = 0")
    got = quality.score(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").toPandas()
    keep, gold = got["keep"].to_numpy(bool), got["quality"].to_numpy() == 1
    assert keep[gold].mean() >= 0.85 and (~keep)[~gold].mean() >= 0.85


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.normal(size=1 << quality.BITS), rng.normal(size=(1 << quality.BITS, quality.RANK)).astype(np.float32), 0.0)
    ids, x = rng.integers(0, 1 << quality.BITS, 14), rng.normal(size=14)
    at = np.array([0, 5, 14])
    want = [0.3 + sum(model.linear[ids[i]] * x[i] for i in range(s, e)) + sum(model.factors[ids[i]].astype(float) @ model.factors[ids[j]].astype(float) * x[i] * x[j] for i, j in itertools.combinations(range(s, e), 2)) for s, e in zip(at, at[1:])]
    assert np.allclose(model.raw(ids, x, at), want, rtol=1e-4)


def test_pairs_are_learnt():
    """Neither word tells alone, only both together: the interaction must."""
    rng = np.random.default_rng(1)
    texts, good = [], []
    for _ in range(800):
        a, b = rng.integers(0, 2, 2)
        texts.append(f"{'red' if a else 'blue'} {'square' if b else 'circle'}")
        good.append(int(a == b))
    model = quality.fit(texts, [("en", "s")] * 800, np.array(good), epochs=60)
    z = model.score(["red square", "blue circle", "red circle", "blue square"], [("en", "s")] * 4) > model.threshold
    assert z.tolist() == [True, True, False, False]


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 1), (5, None, None), (2, 0, 1), (3, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    got = quality.score(odd, model)
    assert got.count() == len(ODD) and got.where("score is null or isnan(score)").count() == 0
    assert quality.score(nothing, model).count() == 0
    assert quality.score(odd, quality.train(nothing, labels.limit(0))).where("keep").count() == len(ODD)


@pytest.mark.parametrize("value", [0, 1])
def test_one_class_only_keeps_everything(make, value):
    docs = make([(i, f"text number {i}") for i in range(20)])
    assert quality.score(docs, quality.train(docs, docs.select("doc_id", F.lit(value).alias("quality")))).where("keep").count() == 20


def test_query(spark):
    from pageloom.llm.registry import QUERIES

    got = QUERIES["op9_quality"](spark, D2).toPandas()
    gold = table(spark, D2, "labels").toPandas()
    kept = gold["doc_id"].isin(got["doc_id"])
    assert got["doc_id"].is_unique and kept[gold["quality"] == 1].mean() >= 0.85 and (~kept)[gold["quality"] == 0].mean() >= 0.85
