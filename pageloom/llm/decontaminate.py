"""Operator 8: benchmark decontamination by template canonicalisation.

Numbers, capitalised names and units after numbers become typed placeholders;
every window of ``WINDOW`` template tokens is hashed and joined with the windows
of the benchmark, so a question with other names and figures still meets its
original. A window of placeholders alone, and an item of fewer than ``WINDOW``
words (one window of its own width), are matched by their words instead. The
placeholders' values must then map one to one between the question and the
document over the matched windows: over all of them, or over those of one
alignment (places in the document less places in the item, ``SLACK`` words apart
at most), so that several versions of an item in one document don't spoil each
other. An item leaks into a document if consistent windows cover at least
``COVER`` of the item's windows.

Only windows that the benchmark may have leave the scan (a bitmap sized by the
benchmark decides; it has no false rejections), so whole documents are never
shuffled.

Defined results: words are split at white space and trimmed of punctuation; null
and empty texts match nothing; an item without words is never found; repeated
benchmark rows of one item_id count as one item, the least text standing; rows of
one doc_id count as one document; long texts are read whole; rows with null ids
are ignored by ``leaks``; ``apply`` keeps every row that isn't named as leaking,
with all columns; empty tables give no row; other columns, whatever their names,
are ignored by ``leaks``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K
from ._spark import Bitmap, Store, table

WINDOW = 6
COVER = 0.5
#: Words between the alignments of one copy of an item.
SLACK = 3
UNITS = ("%", "m", "cm", "mm", "km", "kg", "g", "mg", "l", "ml", "s", "ms", "h", "hr", "hrs", "min", "mins", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "mile", "miles", "meter", "meters", "metre", "metres", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "pound", "pounds", "lb", "lbs", "ounce", "ounces", "oz", "gallon", "gallons", "liter", "liters", "litre", "litres", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees", "ton", "tons", "mph", "kmh", "usd", "eur")
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0xA5A5A5A5A5A5A501, 0xA5A5A5A5A5A5A502, 0xA5A5A5A5A5A5A503))


def _unit_hashes() -> np.ndarray:
    codes, at = K.codepoints([u for u in UNITS if u != "%"])
    return np.sort(K.SpanHash(codes)(at[:-1], at[1:]))


def templates(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens and slot values (0: literal) of all texts, and the token offsets per text."""
    codes, offsets = K.codepoints(texts)
    start, end, _ = K.split_words(codes, offsets)
    solid = np.flatnonzero(K.is_kind(codes, "alpha") | K.is_kind(codes, "digit"))
    lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end)
    full = hi > lo
    if not full.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start, end = solid[lo[full]], solid[hi[full] - 1] + 1
    value = K.SpanHash(K.lower(codes))(start, end)
    upper = K.is_kind(codes, "upper")
    number = K.is_kind(codes[start], "digit")
    name = upper[start] & (end - start > 1) & ~upper[np.minimum(start + 1, len(codes) - 1)]
    before = np.zeros(len(start), bool)
    before[1:] = number[:-1]
    unit = before & np.isin(value, _unit_hashes()) & ~number
    token = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    return token, np.where(number | name | unit, value, np.uint64(0)), np.searchsorted(start, offsets)


def windows(texts: list[str], widths: tuple[int, ...] | None = None) -> tuple[np.ndarray, ...]:
    """Hash, text index, position and slot values of every window.

    ``widths`` are those to look for, ``WINDOW`` or less; without them a text has
    windows of ``WINDOW`` tokens, or one of all its tokens if it has fewer.
    """
    token, slot, at = templates(texts)
    value = np.where(slot == 0, token, slot)
    count = np.diff(at)
    literal = np.concatenate(([0], np.cumsum(slot == 0)))
    parts = []
    for width in range(1, WINDOW + 1) if widths is None else widths:
        many = np.maximum(count - width + 1, 0) if widths is not None or width == WINDOW else (count == width).astype(np.int64)
        first, offsets = K.ragged(at[:-1], many)
        if not len(first):
            continue
        text = np.repeat(np.arange(len(texts)), many)
        alike = (literal[first + width] > literal[first]) if width == WINDOW else np.zeros(len(first), bool)
        key = np.where(alike, np.uint64(0), np.uint64(width))
        slots = np.zeros((len(first), WINDOW), np.uint64)
        for k in range(width):
            key = (key ^ np.where(alike, token[first + k], value[first + k])) * np.uint64(0x9E6C63D0876A9A47) + np.uint64(k + 1)
            slots[:, k] = np.where(alike, slot[first + k], np.uint64(0))
        parts.append((K.mix(key), text, first - at[text], slots))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WINDOW), np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _windows_of(id_name: str, sent=None, widths: tuple[int, ...] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in K.chunks(batch):
                key, text, place, slots = windows(texts, widths)
                if sent is not None:
                    hit = sent.value(key)
                    key, text, place, slots = key[hit], text[hit], place[hit], slots[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(K.int_column(part, id_name)[text]), pa.array(place.astype(np.int32)), pa.array([s.tobytes() for s in slots], pa.binary())],
                    ["win", id_name, "place", "slots"],
                )

    return run


def _item_widths(texts: DataFrame) -> tuple[int, ...]:
    """The window widths of the benchmark, ``WINDOW`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.minimum(np.diff(templates([t or "" for t in batch.column(0).to_pylist()])[2]), WINDOW)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(count[count > 0]).astype(np.int32))], ["w"])

    return tuple(sorted(r["w"] for r in texts.mapInArrow(run, "w int").distinct().collect()))


def _consistent(split: list[tuple[int, int, list[int], list[int]]]) -> set[int]:
    votes: dict[int, Counter] = defaultdict(Counter)
    back: dict[int, Counter] = defaultdict(Counter)
    for _, _, x, y in split:
        for a, b in zip(x, y):
            if a:
                votes[a][b] += 1
                back[b][a] += 1
    pick = lambda c: min(c.items(), key=lambda kv: (-kv[1], kv[0]))[0]
    to, fro = {a: pick(c) for a, c in votes.items()}, {b: pick(c) for b, c in back.items()}
    return {place for place, _, x, y in split if all(not a or (to[a] == b and fro[b] == a) for a, b in zip(x, y))}


def consistent_windows(found: list[tuple[int, int, bytes, bytes]]) -> set[int]:
    """The item's window positions whose slot values follow one mapping that is one to one: most over all windows, or over those of one alignment."""
    split = [(place, at - place, np.frombuffer(x, np.uint64).tolist(), np.frombuffer(y, np.uint64).tolist()) for place, at, x, y in found]
    best = _consistent(split)
    split.sort(key=lambda w: w[1])
    begin = 0
    for i in range(1, len(split) + 1):
        if i == len(split) or split[i][1] > split[i - 1][1] + SLACK:
            if i - begin < len(split) and i - begin > len(best):
                best = max(best, _consistent(split[begin:i]), key=len)
            begin = i
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, store: Store | None = None) -> DataFrame:
    """``(doc_id, item_id, coverage)`` of every benchmark item found in a document."""
    spark = docs.sparkSession
    store = store or Store(spark)
    items = benchmark.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    widths = _item_widths(items.select("text"))
    wanted = store.keep(items.mapInArrow(_windows_of("item_id"), "win long, item_id long, place int, slots binary"))
    sent = spark.sparkContext.broadcast(Bitmap(wanted, "win"))
    hits = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(_windows_of("doc_id", sent, widths), "win long, doc_id long, place int, slots binary")
    joined = hits.select("win", "doc_id", F.col("place").alias("at"), F.col("slots").alias("ds")).join(wanted, "win")
    total = wanted.groupBy("item_id").agg(F.count_distinct("place").alias("total"))
    found = joined.groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("place", "at", F.col("slots").alias("x"), F.col("ds").alias("y"))).alias("w"))
    found = found.join(total, "item_id").where(F.size(F.array_distinct(F.col("w.place"))) >= COVER * F.col("total"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cover = [len(consistent_windows([(r["place"], r["at"], r["x"], r["y"]) for r in w])) / n for w, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cover, pa.float64())], ["doc_id", "item_id", "coverage"])

    return found.select("doc_id", "item_id", "w", "total").mapInArrow(check, "doc_id long, item_id long, coverage double").where(F.col("coverage") >= COVER)


def apply(docs: DataFrame, leaking: DataFrame) -> DataFrame:
    """The documents into which no item leaks, all columns kept."""
    return docs.join(leaking.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that leaks into a document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
