"""The page model, and adapters that derive it from tables at hand.

``doc_pages`` has one row per page with a dense 1-based ``page_no`` per document;
row order means nothing. Every page operator maps doc_pages to doc_pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OVERLAY = "struct<kind:string,text:string,opacity:double,angle:int,size:int,x:double,y:double,w:double,h:double>"
A4, LETTER = (595.0, 842.0), (612.0, 792.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_doc_pages(rows: DataFrame, doc_id: str | Column, page_no: str | Column, body: str | Column) -> DataFrame:
    """Give rows the doc_pages schema: no rotation, no overlays, A4."""
    to = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(
        to(doc_id).cast("long").alias("doc_id"),
        to(page_no).cast("int").alias("page_no"),
        to(doc_id).cast("long").alias("src_doc"),
        to(page_no).cast("int").alias("src_page"),
        to(body).alias("body"),
        F.lit(0).alias("rotation"),
        F.lit(A4[0]).alias("w"),
        F.lit(A4[1]).alias("h"),
        F.expr(f"cast(array() as array<{OVERLAY}>)").alias("overlays"),
    )


def pages_of_documents(docs: DataFrame) -> DataFrame:
    """One page per line of a document; a null text has no pages."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return as_doc_pages(lines, "doc_id", F.col("pos") + 1, "line")


def pages_of_lineitem(lineitem: DataFrame) -> DataFrame:
    """One page per order line, numbered over a total order, as line numbers repeat."""
    order = Window.partitionBy("l_orderkey").orderBy(*[F.col(c) for c in lineitem.columns if c != "l_orderkey"])
    numbered = lineitem.withColumn("_page", F.row_number().over(order))
    return as_doc_pages(numbered, "l_orderkey", "_page", F.col("l_returnflag"))
