import duckdb
import pytest

import __spark_entry__ as entry
from pageloom import queries
from pageloom.plans import commands, planner

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    """Rows as text, columns by name; values keep their types (through pandas, nulls would make floats of integers)."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, D), duck.sql(queries.ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    got = entry.entry(spark).toPandas()
    assert len(got) == 200 and set(got["status"]) == {"ok", "end_beyond_last", "no_file_name", "no_intent"}
    assert (got["pages_out"] == got["pages_made"]).all()


def test_a_file_without_an_action(spark):
    asked = commands.parse(spark.createDataFrame([(1, "rapor.pdf dosyasını aç")], "cmd_id long, raw_text string"))
    counts = spark.createDataFrame([(1, 3)], "doc_id long, n_pages int")
    assert planner.report(asked.withColumn("doc_id", asked["cmd_id"]), counts).first()["status"] == "no_action"


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_pipeline_query(spark):
    got = queries.QUERIES["scan_pipeline"](spark, D).toPandas()
    assert got["error"].isna().all() and set(got["n_bytes"]) == {32 * 48}
