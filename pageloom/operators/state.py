"""Settings, recently used files and translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULTS = {"language": "en", "theme": "light", "sounds": True, "recent_files": []}
CONFIG = "struct<language:string,theme:string,sounds:boolean,recent_files:array<string>>"
RECENT = 10


def read_config(text: Column) -> Column:
    """A JSON text over the defaults, field by field; text that isn't JSON gives the defaults."""
    got = F.from_json(text, CONFIG)
    default = {"language": F.lit("en"), "theme": F.lit("light"), "sounds": F.lit(True), "recent_files": F.expr("cast(array() as array<string>)")}
    return F.struct(*[F.coalesce(got[k], v).alias(k) for k, v in default.items()])


def write_config(config: Column) -> Column:
    return F.to_json(config)


def recent_files(opened: DataFrame, keep: int = RECENT) -> DataFrame:
    """``opened(user_id, path, at)`` to the last ``keep`` distinct paths per user: ``(user_id, pos, path)``.

    Ties in time go to the lesser path.
    """
    last = opened.groupBy("user_id", "path").agg(F.max("at").alias("at"))
    order = Window.partitionBy("user_id").orderBy(F.desc("at"), "path")
    return last.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= keep).select("user_id", "pos", "path")


def push_recent(files: Column, path: Column, keep: int = RECENT) -> Column:
    """A list with a path moved, or put, to its front."""
    return F.slice(F.array_prepend(F.array_remove(files, path), path), 1, keep)


def translate(requests: DataFrame, catalogue: DataFrame, languages: tuple[str, ...] = ("tr", "en")) -> DataFrame:
    """``requests(lang, key)`` with ``text``: an unknown language is English, a missing key is itself."""
    asked = requests.withColumn("_lang", F.when(F.col("lang").isin(*languages), F.col("lang")).otherwise("en"))
    known = catalogue.select(F.col("lang").alias("_lang"), "key", "template").dropDuplicates(["_lang", "key"])
    return asked.join(known, ["_lang", "key"], "left").select(*requests.columns, F.coalesce("template", "key").alias("text"))


def move_item(items: Column, index: int, by: int) -> Column:
    """A list with item ``index`` (from 0) swapped with its neighbour; at the ends nothing changes."""
    to = index + by
    swapped = F.transform(items, lambda x, i: F.when(i == index, F.get(items, F.lit(to))).when(i == to, F.get(items, F.lit(index))).otherwise(x))
    return F.when((F.lit(to) >= 0) & (F.lit(to) < F.size(items)), swapped).otherwise(items)


def remove_items(items: Column, indices: list[int]) -> Column:
    return F.filter(items, lambda x, i: ~i.isin(indices)) if indices else items
