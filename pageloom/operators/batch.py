"""Directory batches: one row per item with its status, and one summary row.

Listing order is by folder and name (the sequence numbers of a rename follow it), names that
would overwrite each other are reported, and an unknown mode is an error status.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names

PROFILES = ("screen", "ebook", "printer", "prepress")
#: Conversions of the batch layer: accepted extensions.
MODES = {"pdf2img": (".pdf",), "img2pdf": (".png", ".jpg", ".jpeg")}
LARGE = 50 * 1024 * 1024
SEARCHED = ("Desktop", "Documents", "Downloads")


def list_files(files: DataFrame, extensions: list[str] = [".pdf"]) -> DataFrame:  # noqa: B006
    """Rows of ``files(path, ...)`` by case-insensitive suffix, once for each suffix that fits."""
    suffixes = F.array(*[F.lit(e.lower()) for e in extensions])
    fits = F.filter(suffixes, lambda e: F.endswith(F.lower("path"), e))
    return files.withColumn("suffix", F.explode(fits))


def lookup_files(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """``requests(name)`` found in ``listing(dir, name)``: ``(name, found)``, null where there is none.

    Folders are tried in order; in each an exact name comes before one that
    differs in case (the least by name, where several do).
    """
    rank = F.array_position(F.array(*[F.lit(d) for d in SEARCHED]), F.col("dir"))
    known = listing.select("dir", F.col("name").alias("file"), rank.alias("_rank")).where("_rank > 0").withColumn("_key", F.lower("file"))
    asked = requests.select("name").distinct().withColumn("_key", F.lower("name"))
    best = F.min(F.when(F.col("file").isNotNull(), F.struct("_rank", (F.col("file") != F.col("name")).alias("_other"), "file", "dir")))
    found = asked.join(known, "_key", "left").groupBy("name").agg(best.alias("b"))
    return found.select("name", F.concat_ws("/", "b.dir", "b.file").alias("found")).withColumn("found", F.nullif("found", F.lit("")))


def compress_items(files: DataFrame, profile: str) -> DataFrame:
    """``(seq, path, out_name, status, error)`` of a batch compression.

    Pixels aren't recompressed here; an item fails if its profile is unknown or its size unreadable.
    """
    items = list_files(files).withColumn("base", names.basename(F.col("path")))
    error = F.when(~F.lit(profile).isin(*PROFILES), F.concat("base", F.lit(": unknown profile"))).when(F.col("size_bytes").isNull(), F.concat("base", F.lit(": unreadable")))
    return _numbered(items).select("seq", "path", F.concat(F.lit("compressed_"), "base").alias("out_name"), F.when(error.isNull(), "ok").otherwise("error").alias("status"), error.alias("error"))


def convert_items(files: DataFrame, mode: Column) -> DataFrame:
    """``(path, mode, out_name, status)``: items routed by mode and extension."""
    base, ext = names.basename(F.col("path")), names.extension(names.basename(F.col("path")))
    takes = [F.when(mode == m, ext.isin(*exts)) for m, exts in MODES.items()]
    out = F.when(mode == "pdf2img", F.concat(names.stem(base), F.lit("/"))).when(mode == "img2pdf", F.concat(names.stem(base), F.lit(".pdf")))
    status = F.when(~mode.isin(*MODES), "unknown_mode").when(F.coalesce(*takes), "ok").otherwise("skipped")
    routed = files.select("path", mode.alias("mode"), out.alias("_out"), status.alias("status"))
    return routed.select("path", "mode", F.when(F.col("status") == "ok", F.col("_out")).alias("out_name"), "status")


def _numbered(items: DataFrame, prefix: int = 6) -> DataFrame:
    """Sequence numbers over the whole listing, by folder and then by name.

    Rows are numbered within buckets of a folder and a name prefix; only the
    buckets' sizes pass through a single ordering, never the items.
    """
    base = names.basename(F.col("path"))
    named = items.withColumns({"_base": base, "_dir": F.left("path", F.length("path") - F.length(base))}).withColumn("_head", F.substring("_base", 1, prefix))
    order = Window.partitionBy("_dir", "_head").orderBy("_base", "path")
    sizes = named.groupBy("_dir", "_head").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_dir", "_head")) - F.col("_n")).drop("_n")
    numbered = named.withColumn("_in", F.row_number().over(order)).join(before, ["_dir", "_head"])
    return numbered.withColumn("seq", (F.col("_before") + F.col("_in")).cast("int")).drop("_base", "_dir", "_head", "_in", "_before")


def rename_items(files: DataFrame, rule: str, as_of: Column) -> DataFrame:
    """``(seq, path, out_name, status)``: names from a rule with tokens, replaced one kind after another.

    ``files(path, size_bytes, n_pages)``; a file without a page count is unreadable,
    yet uses up its number. Signs that file systems refuse become ``_``.
    """
    base = names.basename(F.col("path"))
    values = {
        "ORIJINAL_AD": names.stem(base),
        "SAYFA_SAYISI": F.concat(F.col("n_pages").cast("string"), F.lit("pp")),
        "BOYUT": F.concat(names.decimal(names.size_mb(F.col("size_bytes")), 1), F.lit("MB")),
        "SIRA": F.format_string("%03d", "seq"),
        "TARIH": F.date_format(as_of, "yyyy-MM-dd"),
    }
    filled = reduce(lambda t, kv: F.replace(t, F.lit(f"[{kv[0]}]"), kv[1]), values.items(), F.lit(rule))
    clean = F.concat(F.translate(filled, '<>:"/\\|?*', "_" * 9), F.lit(".pdf"))
    bad = F.col("n_pages").isNull() | F.col("size_bytes").isNull()
    return _numbered(list_files(files)).select("seq", "path", F.when(~bad, clean).alias("out_name"), F.when(bad, "error").otherwise("ok").alias("status"))


def summary(items: DataFrame) -> DataFrame:
    """One row ``(total, success, errors, error_lines)``; no row for an empty batch."""
    got = items.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("success"), F.count_if(F.col("status") != "ok").alias("errors"), F.sort_array(F.collect_list(F.when(F.col("status") != "ok", F.struct("seq", F.coalesce("error", "status").alias("line"))))).alias("_lines"))
    return got.where("total > 0").select("total", "success", "errors", F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("error_lines"))


def report_text(summed: DataFrame, title: str, as_of: Column) -> DataFrame:
    """The summary as a text file's content."""
    rule = F.lit("=" * 50)
    lines = F.when(F.col("errors") > 0, F.concat(F.lit("Errors:\n- "), F.replace("error_lines", F.lit("\n"), F.lit("\n- ")))).otherwise("No errors.")
    head = [F.lit(title), F.concat(F.lit("Date: "), F.date_format(as_of, "yyyy-MM-dd HH:mm:ss")), rule]
    return summed.select(F.concat_ws("\n", *head, F.concat(F.lit("Total: "), "total"), F.concat(F.lit("Successful: "), "success"), F.concat(F.lit("Failed: "), "errors"), rule, lines).alias("report"))


def collisions(items: DataFrame) -> DataFrame:
    """Output names that several items would write: ``(out_name, n, paths)``."""
    return items.where("out_name is not null").groupBy("out_name").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("path")), "|").alias("paths")).where("n > 1")


def large_files(files: DataFrame, limit: int = LARGE) -> DataFrame:
    """Adds ``large``; an unreadable size isn't."""
    return files.withColumn("large", F.coalesce(F.col("size_bytes") > limit, F.lit(False)))


def parallel_map(items: DataFrame, function, result: str = "string") -> DataFrame:
    """``function`` over a column ``item`` in Arrow batches; its errors become rows: ``(item, result, error)``."""
    import pandas as pd

    kind = items.schema["item"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out, errors = [], []
            for x in batch["item"]:
                try:
                    out.append(function(x))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  (each item's error is data)
                    out.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"item": batch["item"], "result": pd.Series(out, dtype=object, index=batch.index), "error": pd.Series(errors, dtype=object, index=batch.index)})

    return items.select("item").mapInPandas(run, f"item {kind}, result {result}, error string")
