"""Text sinks: one string per document from its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_END = "\n--- Sayfa Sonu ---\n"


def _assembled(pages: DataFrame, line: Column, separator: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("page_no", line.alias("line"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), separator).alias("content"))


def export_text(pages: DataFrame, separator: str = PAGE_END) -> DataFrame:
    """Pages with text, joined by a page end; empty pages are left out, so numbers can't be recovered."""
    return _assembled(pages.where("body <> ''"), F.col("body"), separator)


def export_ocr(pages: DataFrame) -> DataFrame:
    """Every page under a heading with its number."""
    return _assembled(pages, F.concat(F.lit("--- Sayfa "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.coalesce("body", F.lit(""))), "\n")


def recognise(pages: DataFrame, recogniser, language: str = "tur") -> DataFrame:
    """Fill ``body`` by ``recogniser(image_bytes, language) -> str`` over a column ``image``.

    One failing page fails its document: all its pages get a null body and the first error by page.
    """
    import pandas as pd
    from pyspark.sql import Window

    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for x in batch["image"]:
                try:
                    texts.append(recogniser(bytes(x), language))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  (each page's error is data)
                    texts.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "page_no": batch["page_no"], "body": pd.Series(texts, dtype=object, index=batch.index), "error": pd.Series(errors, dtype=object, index=batch.index)})

    read = pages.select("doc_id", "page_no", "image").mapInPandas(run, "doc_id long, page_no int, body string, error string")
    failed = F.min(F.when(F.col("error").isNotNull(), F.struct("page_no", "error"))).over(Window.partitionBy("doc_id"))
    return read.withColumn("_f", failed).select("doc_id", "page_no", F.when(F.col("_f").isNull(), F.col("body")).alias("body"), F.col("_f.error").alias("error"))
