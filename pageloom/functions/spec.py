"""Page specifications such as ``"1, 3-5, 8"`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names  # noqa: F401  (one import surface for expressions)


def _trimmed_parts(spec: Column) -> Column:
    return F.transform(F.split(spec, ","), lambda p: F.trim(p))


def _part(p: Column, total: Column) -> Column:
    """Pages of one part, null if it is malformed or out of range."""
    dash = F.instr(p, "-")
    low = F.when(dash > 0, F.trim(F.substring(p, F.lit(1), dash - 1))).otherwise(p).try_cast("int")
    high = F.when(dash > 0, F.trim(F.substring(p, dash + 1, F.length(p)))).otherwise(p).try_cast("int")
    return F.when((low >= 1) & (high <= total) & (low <= high), F.sequence(low, high))


def parse_pages(spec: Column, total: Column) -> Column:
    """Sorted distinct page numbers; null for a malformed, out-of-range or empty specification.

    Blank parts are skipped. ``a-b`` is inclusive, so ``-3`` fails on its empty
    start. Digits must be ASCII without separators.
    """
    parts = F.filter(_trimmed_parts(spec), lambda p: p != "")
    pages = F.flatten(F.transform(parts, lambda p: _part(p, total)))
    return F.when(F.size(parts) > 0, F.array_sort(F.array_distinct(pages)))


def page_spec_status(spec: Column, total: Column) -> Column:
    """``ok``, ``empty`` or ``invalid``."""
    parts = F.filter(_trimmed_parts(spec), lambda p: p != "")
    return F.when(spec.isNull() | (F.size(parts) == 0), "empty").when(parse_pages(spec, total).isNull(), "invalid").otherwise("ok")


def parse_order(spec: Column) -> Column:
    """Page numbers in the order given, repeats kept; null if any part isn't a whole number (an empty part too)."""
    numbers = F.transform(_trimmed_parts(spec), lambda p: p.try_cast("int"))
    return F.when(~F.exists(numbers, lambda n: n.isNull()), numbers)
