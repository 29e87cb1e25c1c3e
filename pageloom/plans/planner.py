"""Executing intents: one Spark plan for all documents and commands, no files between steps.

A chain is first rewritten (ranges composed, rotations added, deletions united,
encryption last) and folded over the page operators by ``run_chain``; ``execute``
takes the arguments of many commands as columns, so that thousands of different
chains still are a single join of pages with intents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

NON_PDF = ("ocr", "pdf_to_image", "pdf_to_word", "pdf_to_text")
ACTION_NAMES = dict(zip(("rotate", "ocr", "split", "encrypt", "watermark", "compress", "pdf_to_text", "pdf_to_word", "delete_pages", "pdf_to_image"), ("Döndürme", "OCR", "Kesme", "Şifreleme", "Filigran ekleme", "Sıkıştırma", "Metin çıkarma", "Word'e dönüştürme", "Sayfa silme", "Resme dönüştürme")))
TARGET_NAMES = {"Downloads": "İndirilenler klasörüne", "Documents": "Belgelerim klasörüne", "Desktop": "Masaüstüne"}
SIDE_OUTPUT = {"ocr": "_ocr.txt", "pdf_to_image": "_resimler/", "pdf_to_word": ".docx", "pdf_to_text": ".txt"}
SUFFIX = "_sonuc"


def optimize(chain: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
    """Rewrite a chain without changing its pages.

    Adjacent ranges compose, adjacent rotations of all pages add up, adjacent
    deletions become one (later numbers translated to earlier ones), a rotation by
    0 goes, and encryption moves to the end.
    """
    out: list[tuple[str, dict]] = []
    for action, kw in chain:
        before = out[-1] if out else (None, {})
        if action == "rotate" and before[0] == "rotate":
            out[-1] = ("rotate", {"angle": (before[1]["angle"] + kw["angle"]) % 360})
        elif action == "split" and before[0] == "split" and before[1]["start"] + kw["end"] - 1 <= before[1]["end"]:
            out[-1] = ("split", {"start": before[1]["start"] + kw["start"] - 1, "end": before[1]["start"] + kw["end"] - 1})
        elif action == "delete_pages" and before[0] == "delete_pages":
            gone = sorted({p for p in before[1]["pages"] if p > 0})
            moved = []
            for p in sorted({p for p in kw["pages"] if p > 0}):
                for g in gone:
                    p += g <= p
                moved.append(p)
            out[-1] = ("delete_pages", {"pages": sorted({*gone, *moved})})
        else:
            out.append((action, dict(kw)))
    out = [x for x in out if x[0] != "rotate" or x[1]["angle"] % 360]
    return [x for x in out if x[0] != "encrypt"] + [x for x in out if x[0] == "encrypt"]


def run_chain(pages: DataFrame, chain: list[tuple[str, dict]]) -> DataFrame:
    """Fold a chain over pages, for one chain on many documents."""
    from ..operators import annotate
    from ..operators import pages as ops

    for action, kw in optimize(chain):
        if action == "split":
            pages = ops.select_range_checked(pages, kw["start"], kw["end"])
        elif action == "delete_pages":
            pages = ops.delete_pages(pages, kw["pages"])
        elif action == "rotate":
            pages = ops.rotate_pages(pages, None, kw["angle"])
        elif action == "watermark":
            pages = annotate.overlay_text(pages, kw["text"])
        elif action == "encrypt":
            pages = annotate.encrypt(pages, kw["password"])
    return pages


def _argument(action: str, key: str) -> Column:
    """An argument of the chain's action, null if the chain doesn't have it."""
    hit = F.filter("action_chain", lambda a: a["action"] == action)
    return F.try_element_at(F.get(hit, 0)["kwargs"], F.lit(key))


def _has(action: str) -> Column:
    return F.exists("action_chain", lambda a: a["action"] == action)


def with_arguments(intents: DataFrame) -> DataFrame:
    """The arguments of each chain as columns."""
    return intents.withColumns(
        {
            "_start": _argument("split", "start").cast("int"),
            "_end": _argument("split", "end").cast("int"),
            "_gone": F.when(_has("delete_pages"), F.array_distinct(F.transform(F.split(_argument("delete_pages", "pages"), ","), lambda x: x.cast("int")))),
            "_angle": _argument("rotate", "angle").cast("int"),
            "_text": _argument("watermark", "text"),
            "_encrypt": _has("encrypt"),
            "_password": _argument("encrypt", "password"),
        }
    )


def statuses(intents: DataFrame, counts: DataFrame) -> DataFrame:
    """``intents`` with doc_id (null: file not found), joined to page counts, with the status ladder and pages out.

    no_intent, no_file_name, file_not_found, no_action, then the first invalid argument.
    """
    j = with_arguments(intents).join(counts, "doc_id", "left")
    kept = F.when(F.col("_start").isNotNull(), F.col("_end") - F.col("_start") + 1).otherwise(F.col("n_pages"))
    left = kept - F.when(F.col("_gone").isNotNull(), F.size(F.filter("_gone", lambda p: (p >= 1) & (p <= kept)))).otherwise(0)
    status = (
        F.when(F.col("raw_text").isNull(), "no_intent")
        .when(F.col("input_file") == "", "no_file_name")
        .when(F.col("n_pages").isNull(), "file_not_found")
        .when(F.size("action_chain") == 0, "no_action")
        .when(F.col("_start") < 1, "start_below_1")
        .when(F.col("_end") > F.col("n_pages"), "end_beyond_last")
        .when(F.col("_start") > F.col("_end"), "start_after_end")
        .when(left <= 0, "nothing_remains")
        .when(F.col("_encrypt") & F.col("_password").isNull(), "no_password")
        .otherwise("ok")
    )
    return j.withColumn("status", status).withColumn("pages_out", F.when(F.col("status") == "ok", left).otherwise(0).cast("int"))


def message(chain: Column, target: Column) -> Column:
    """The sentence that reports a chain that ran."""
    known = F.create_map(*[F.lit(x) for kv in ACTION_NAMES.items() for x in kv])
    said = F.array_join(F.transform(chain, lambda a: F.coalesce(F.try_element_at(known, a["action"]), a["action"])), ", ")
    place = F.create_map(*[F.lit(x) for kv in TARGET_NAMES.items() for x in kv])
    return F.concat(said, F.lit(": tamam, "), F.coalesce(F.try_element_at(place, target), F.lit("bulunduğu klasöre")))


def execute(intents: DataFrame, pages: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Apply every command's chain to its document's pages: doc_pages with ``cmd_id``, ``encrypted`` and ``cipher``.

    ``intents`` carry doc_id. Deleted pages are counted by arithmetic on the
    argument array, so there is no window; pages are joined once. An encrypted
    page has a cipher under the command's password in place of its body. ``counts``
    are the documents' page counts; without them pages are counted.
    """
    from ..operators.annotate import seal
    from ..operators.pages import page_count

    counts = page_count(pages) if counts is None else counts
    ready = statuses(intents, counts).where("status = 'ok'").select("cmd_id", "doc_id", "_start", "_end", "_gone", "_angle", "_text", "_encrypt", "_password")
    j = pages.join(ready, "doc_id").where("_start is null or page_no between _start and _end")
    j = j.withColumn("page_no", F.col("page_no") - F.coalesce(F.col("_start") - 1, F.lit(0)))
    j = j.where(F.col("_gone").isNull() | ~F.array_contains("_gone", F.col("page_no")))
    below = F.size(F.filter("_gone", lambda p: (p >= 1) & (p < F.col("page_no"))))
    j = j.withColumn("page_no", F.col("page_no") - F.when(F.col("_gone").isNotNull(), below).otherwise(0))
    j = j.withColumn("rotation", F.pmod(F.col("rotation") + F.coalesce("_angle", F.lit(0)), F.lit(360)))
    mark = F.struct(F.lit("text").alias("kind"), F.col("_text").alias("text"), F.lit(0.3).alias("opacity"), F.lit(45).alias("angle"), F.lit(60).alias("size"), F.lit(297.5).alias("x"), F.lit(421.0).alias("y"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("h"))
    j = j.withColumn("overlays", F.when(F.col("_text").isNotNull(), F.array_append("overlays", mark)).otherwise(F.col("overlays")))
    j = j.withColumn("cipher", F.when(F.col("_encrypt"), seal(F.col("body"), F.col("_password")))).withColumn("body", F.when(~F.col("_encrypt"), F.col("body"))).withColumn("encrypted", F.col("_encrypt"))
    return j.drop("_start", "_end", "_gone", "_angle", "_text", "_encrypt", "_password")


def text_outputs(done: DataFrame, intents: DataFrame) -> DataFrame:
    """The text files that chains with ``pdf_to_text`` make of the pages they leave: ``(cmd_id, out_name, text)``; a sealed page has no text."""
    from ..sources.text import export_text

    wanted = side_outputs(intents).where("action = 'pdf_to_text'").select("cmd_id", "out_name")
    pages = done.join(wanted.select("cmd_id"), "cmd_id", "left_semi")
    made = export_text(pages.drop("doc_id").withColumnRenamed("cmd_id", "doc_id")).withColumnRenamed("doc_id", "cmd_id")
    return wanted.join(made, "cmd_id", "left").select("cmd_id", "out_name", F.coalesce("content", F.lit("")).alias("text"))


def steps(intents: DataFrame, *columns: str) -> DataFrame:
    """A row for each action ``a`` of a chain, with these columns.

    The outer form and a filter after it: for the inner one Spark adds a filter on
    the size of the chain, into which the whole parse is written out, many times over.
    """
    return intents.select(*columns, F.explode_outer("action_chain").alias("a")).where("a is not null")


def side_outputs(intents: DataFrame) -> DataFrame:
    """Outputs of actions that don't make a PDF, one row each: ``(cmd_id, action, out_name)``."""
    suffix = F.create_map(*[F.lit(x) for kv in SIDE_OUTPUT.items() for x in kv])
    each = steps(intents, "cmd_id", "input_file").where(F.col("a.action").isin(*NON_PDF))
    return each.select("cmd_id", F.col("a.action").alias("action"), F.concat(names.stem(F.col("input_file")), F.try_element_at(suffix, F.col("a.action"))).alias("out_name"))


def report(intents: DataFrame, counts: DataFrame) -> DataFrame:
    """Per command: document, pages in and out, status and message."""
    s = statuses(intents, counts)
    return s.select("cmd_id", "doc_id", F.coalesce("n_pages", F.lit(0)).alias("pages_in"), "pages_out", "status", F.when(F.col("status") == "ok", message(F.col("action_chain"), F.col("output_target"))).otherwise(F.col("status")).alias("message"))
