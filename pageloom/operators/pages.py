"""Page algebra: range, delete, rotate, reorder, concatenate.

Validation never raises inside a task. The ``*_status`` functions give one row per
document with ``ok`` or the error; the operators return pages of valid documents
only, and ``strict`` turns a status into an exception on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.spec import parse_order

_COLUMNS = ("doc_id", "page_no", "src_doc", "src_page", "body", "rotation", "w", "h", "overlays")


def page_count(pages: DataFrame) -> DataFrame:
    """``(doc_id, n_pages)``; only doc_id is read."""
    return pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"))


def select_range(pages: DataFrame, start: int, end: int) -> DataFrame:
    """Pages start..end of every document, renumbered by subtraction, so the filter reaches the scan."""
    return pages.where(F.col("page_no").between(start, end)).withColumn("page_no", F.col("page_no") - F.lit(start - 1))


def range_status(counts: DataFrame, start: Column | int, end: Column | int) -> DataFrame:
    """First failing check per document: start below 1, end beyond the last page, start after end."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return counts.withColumn("status", F.when(a < 1, "start_below_1").when(b > F.col("n_pages"), "end_beyond_last").when(a > b, "start_after_end").otherwise("ok"))


def select_range_checked(pages: DataFrame, start: int, end: int) -> DataFrame:
    """``select_range`` on documents that pass the checks."""
    valid = range_status(page_count(pages), start, end).where("status = 'ok'").select("doc_id")
    return select_range(pages, start, end).join(valid, "doc_id", "left_semi")


def delete_pages(pages: DataFrame, numbers: list[int]) -> DataFrame:
    """Drop pages by number; numbers out of range are ignored.

    The new number is the old one less the deleted numbers below it: no window, no shuffle.
    """
    gone = F.array(*[F.lit(n).cast("int") for n in sorted({n for n in numbers if n >= 1})]).cast("array<int>")
    below = F.size(F.filter(gone, lambda n: n < F.col("page_no")))
    return pages.where(~F.array_contains(gone, F.col("page_no"))).withColumn("page_no", F.col("page_no") - below)


def delete_status(counts: DataFrame, numbers: list[int]) -> DataFrame:
    """``(doc_id, n_pages, remaining, status)``; an error where nothing would remain."""
    gone = F.array(*[F.lit(n).cast("int") for n in sorted(set(numbers))]).cast("array<int>")
    hit = F.size(F.filter(gone, lambda n: (n >= 1) & (n <= F.col("n_pages"))))
    left = counts.withColumn("remaining", F.col("n_pages") - hit)
    return left.withColumn("status", F.when(F.col("remaining") <= 0, "nothing_remains").otherwise("ok"))


def rotate_pages(pages: DataFrame, numbers: list[int] | None, angle: int) -> DataFrame:
    """Turn the listed pages clockwise (all when None or empty); rotation adds up modulo 360."""
    turned = F.pmod(F.col("rotation") + F.lit(angle), F.lit(360))
    if not numbers:
        return pages.withColumn("rotation", turned)
    return pages.withColumn("rotation", F.when(F.col("page_no").isin(sorted(set(numbers))), turned).otherwise(F.col("rotation")))


def reorder_status(counts: DataFrame, order: str) -> DataFrame:
    """``bad_order`` for a malformed order, ``out_of_range`` where a number has no page."""
    wanted = parse_order(F.lit(order))
    worst = F.exists(wanted, lambda n: (n < 1) | (n > F.col("n_pages")))
    return counts.withColumn("status", F.when(wanted.isNull(), "bad_order").when(worst, "out_of_range").otherwise("ok"))


def reorder_pages(pages: DataFrame, order: str) -> DataFrame:
    """Pages in the order given, which may drop and repeat pages; documents that fail the checks are left out.

    The order is a small literal list, exploded beside each page that it names: no join.
    """
    valid = reorder_status(page_count(pages), order).where("status = 'ok'").select("doc_id")
    wanted = parse_order(F.lit(order))
    spots = F.filter(F.transform(wanted, lambda n, i: F.when(n == F.col("page_no"), i + 1)), lambda i: i.isNotNull())
    placed = pages.where(F.array_contains(wanted, F.col("page_no"))).withColumn("_to", F.explode(spots))
    return placed.withColumn("page_no", F.col("_to").cast("int")).select(*_COLUMNS).join(valid, "doc_id", "left_semi").select(*_COLUMNS)


def merge_documents(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Concatenate documents: ``plan(out_id, file_pos, doc_id)`` gives each output's inputs in order, repeats allowed.

    Page offsets are running sums over the plan's files, so the pages themselves
    are joined once and never sorted.
    """
    counts = page_count(pages.join(plan.select("doc_id").distinct(), "doc_id", "left_semi"))
    order = Window.partitionBy("out_id").orderBy("file_pos")
    placed = plan.join(counts, "doc_id").withColumn("_before", (F.sum("n_pages").over(order) - F.col("n_pages")).cast("int"))
    joined = pages.join(placed.select("doc_id", "out_id", "_before"), "doc_id")
    return joined.withColumn("page_no", F.col("_before") + F.col("page_no")).withColumn("doc_id", F.col("out_id")).select(*_COLUMNS)


def strict(status: DataFrame) -> None:
    """Raise on the first document, by id, whose status isn't ok."""
    bad = status.where("status <> 'ok'").orderBy("doc_id").first()
    if bad:
        raise ValueError(f"document {bad['doc_id']}: {bad['status']}")


def size_report(pages: DataFrame, edited: DataFrame) -> DataFrame:
    """Megabytes of text before and after an operator, per document, to two decimals."""
    total = lambda df, name: df.groupBy("src_doc").agg(F.sum(F.octet_length("body")).alias(name))
    both = total(pages, "before").join(total(edited, "after"), "src_doc", "left")
    show = lambda c: names.decimal(names.size_mb(F.coalesce(F.col(c), F.lit(0))), 2)
    return both.select(F.col("src_doc").alias("doc_id"), show("before").alias("mb_before"), show("after").alias("mb_after"))
