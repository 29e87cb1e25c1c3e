import numpy as np
import pytest
from cases import D2, D3, ODD
from pyspark.sql import functions as F

from pageloom.llm import toxicity
from pageloom.llm._spark import table


def test_held_out_accuracy(spark):
    """About one in fourteen of the toxic labels is on a text like any clean one, which no classifier finds."""
    docs, labels = table(spark, D3, "documents"), table(spark, D3, "labels")
    model = toxicity.train(docs, labels.where("doc_id % 3 > 0"))
    held = labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "gold")
    got = toxicity.score(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").toPandas()
    hit, gold = got["toxic"].to_numpy(bool), got["gold"].to_numpy() == 1
    assert (hit & gold).sum() >= 0.85 * gold.sum()
    assert (hit & ~gold).sum() <= 0.01 * (~gold).sum()


def test_ratio_scales_the_features():
    texts = ["you foul beast"] * 6 + ["a kind friend"] * 6
    model = toxicity.fit(texts, np.array([1] * 6 + [0] * 6))
    bad, good = model.score(["foul beast", "kind friend"])
    assert bad > model.threshold > good


def test_features_equal_brute_force():
    texts = ["Ab c\td", "", "aaaa aaaa", "xyz"]
    for text, got in zip(texts, toxicity._features(texts)):
        folded = "".join(" " if c.isspace() else c for c in text.lower())
        want = {folded[i : i + n] for n in toxicity.ORDERS for i in range(len(folded) - n + 1)}
        assert len(got) == len(want) == len(set(got.tolist()))


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 1), (5, None, None), (2, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).where("toxic").count() == 0
    assert toxicity.score(odd, model).count() == len(ODD)
    kept = toxicity.reject(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    none = toxicity.train(nothing, labels.limit(0))
    assert toxicity.score(nothing, none).count() == 0 and toxicity.reject(nothing, none).count() == 0


@pytest.mark.parametrize("side", ["toxic", "clean"])
def test_one_class_only_rejects_nothing(spark, make, side):
    docs = make([(i, f"text number {i}") for i in range(20)])
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(int(side == "toxic")).alias("toxic"))
    assert toxicity.reject(docs, toxicity.train(docs, labels)).count() == 20


def test_query(spark):
    """Fifty toxic rows to learn from in four languages; the held-out test has more."""
    from pageloom.llm.registry import QUERIES

    got = QUERIES["op2_toxicity"](spark, D2).toPandas()
    gold = table(spark, D2, "labels").where("toxic = 1").toPandas()["doc_id"]
    assert got["doc_id"].is_unique and set(gold) & set(got["doc_id"]) and len(set(gold) - set(got["doc_id"])) <= 0.3 * len(gold)
