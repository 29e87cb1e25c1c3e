import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from cases import D1, D2, ODD, row

import corpus_pipeline as cp
from pageloom.llm._spark import table

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stage_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]


def test_run_equals_its_stages(spark, tmp_path):
    docs = table(spark, D1, "documents")
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, D1)
        if i + 1 < len(cp.STAGES):
            assert out.columns == table(spark, D1, "documents").columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    key = lambda df: sorted((r["doc_id"], r["text"], tuple(r["tokens"])) for r in df.collect())
    assert key(docs) == key(cp.run(spark, D1)) != []


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The small tables with planted documents: toxic, near copies, a repeated line, a benchmark item, and clean ones."""
    rng = np.random.default_rng(8)
    docs = table(spark, D2, "documents").toPandas()
    words = sorted({w for t in docs.loc[docs["lang"] == "en", "text"].iloc[:60] for w in t.lower().split() if w.isalpha()})
    fresh = lambda n: " ".join(rng.choice(words, n))
    item = table(spark, D2, "benchmark").orderBy("item_id").first()["text"]
    line, base = fresh(20), fresh(120)
    bad = "idiot moron worthless stupid pathetic loser trash scum clown disgusting".split()
    toxic = fresh(60).split()
    for i, w in enumerate(bad * 2):
        toxic.insert(3 * i, w)
    more = {9001: " ".join(toxic), 9101: base, 9102: base + " " + fresh(4), 9201: fresh(40) + "\n" + line, 9202: fresh(40) + "\n" + line.capitalize(), 9301: fresh(30) + "\n" + item + "\n" + fresh(30), 9401: fresh(80), 9402: fresh(150)}
    folder = str(tmp_path_factory.mktemp("planted"))
    full = spark.createDataFrame([*docs.itertuples(index=False, name=None), *(row(i, t) for i, t in more.items())], table(spark, D2, "documents").schema)
    full.write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{D2}/{t}.parquet", f"{folder}/{t}.parquet")
    return folder, line


def test_planted_cases(spark, planted):
    folder, line = planted
    got = {r["doc_id"]: r["text"] for r in cp.run(spark, folder).collect() if r["doc_id"] > 9000}
    assert set(got) == {9101, 9201, 9202, 9401, 9402}
    assert line in got[9201] and line.capitalize() not in got[9202]


@pytest.mark.parametrize("rows", [ODD, []])
def test_every_stage_takes_odd_rows(spark, make, rows):
    for _, stage in cp.STAGES[1:]:
        docs = make(rows, wide=True)
        out = stage(spark, docs, D1)
        assert out.count() <= len(rows) and set(docs.columns) <= set(out.columns)


def test_the_rest_works_without_this_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [k for k in q if k.startswith('op')] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})
