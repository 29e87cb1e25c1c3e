"""Output names, sizes, progress figures and routing by extension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MB = 1048576.0
#: Suffix that each tool gives its output.
TOOL_SUFFIX = {"edit": "_düzenlenmiş", "merge": "_birleşik", "encrypt": "_şifreli", "decrypt": "_şifresiz", "watermark": "_filigranlı", "images": "_resimler", "scan": "_tarandi", "compress": "_compressed"}
#: Extensions that each conversion takes.
ROUTES = {"pdf_to_image": (".pdf",), "image_to_pdf": (".png", ".jpg", ".jpeg"), "pdf_to_word": (".pdf",), "word_to_pdf": (".docx",), "ppt_to_pdf": (".ppt", ".pptx"), "excel_to_pdf": (".xls", ".xlsx"), "pdf_to_text": (".pdf",)}


def size_mb(size_bytes: Column) -> Column:
    return size_bytes / F.lit(MB)


def decimal(x: Column, places: int) -> Column:
    """Fixed places, halves to even as binary fractions round."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(name: Column) -> Column:
    """Name without its last extension; a leading dot isn't one."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))


def with_suffix(name: Column, suffix: Column) -> Column:
    """Put a suffix before the last extension, ``.pdf`` if there is none."""
    ext = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    return F.concat(stem(name), suffix, F.when(ext == "", ".pdf").otherwise(ext))


def compressed_name(name: Column) -> Column:
    return with_suffix(name, F.lit("_compressed"))


def range_name(name: Column, start: Column, end: Column) -> Column:
    return with_suffix(name, F.concat(F.lit("_sayfa_"), start.cast("string"), F.lit("-"), end.cast("string")))


def tool_name(name: Column, tool: Column) -> Column:
    """Suffix by tool; an unknown tool leaves the name alone."""
    known = F.create_map(*[F.lit(x) for kv in TOOL_SUFFIX.items() for x in kv])
    return with_suffix(name, F.coalesce(F.try_element_at(known, tool), F.lit("")))


def image_name(page_no: Column, fmt: Column) -> Column:
    """``sayfa_001.png``; anything but png is jpg."""
    return F.concat(F.format_string("sayfa_%03d", page_no), F.when(F.lower(fmt) == "png", ".png").otherwise(".jpg"))


def compress_progress(size_now: Column, input_size: Column) -> Column:
    """Percent done from the size of the growing output, taking 60 % as its final size, 90 at most."""
    return F.least(size_now / F.greatest(input_size * 0.6, F.lit(1.0)) * 90, F.lit(90.0)).cast("int")


def progress_percent(current: Column, total: Column) -> Column:
    return (current / F.when(total <= 0, 1.0).otherwise(total) * 100).cast("int")


def short_message(message: Column) -> Column:
    return F.when(F.length(message) >= 40, F.concat(F.substring(message, 1, 37), F.lit("..."))).otherwise(message)


def accepts(mode: Column, name: Column) -> Column:
    """Whether a conversion takes a file; unknown modes take none."""
    cases = [F.when(mode == m, extension(name).isin(*exts)) for m, exts in ROUTES.items()]
    return F.coalesce(*cases, F.lit(False))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{key}`` marks one after another."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1].cast("string")), values.items(), template)


def fit_to_page(w: Column, h: Column, size: Column) -> Column:
    """Struct of the size that fits A4 or Letter (enlarging too); any other size name keeps the original."""
    tw, th = F.when(size == "A4", 595).when(size == "Letter", 612), F.when(size == "A4", 842).when(size == "Letter", 792)
    ratio = F.least(tw / w, th / h)
    return F.struct(F.coalesce((w * ratio).cast("int"), w.cast("int")).alias("w"), F.coalesce((h * ratio).cast("int"), h.cast("int")).alias("h"))


def scan_resolution(w: Column, h: Column) -> Column:
    """Dots per inch that put an image on A4."""
    return F.greatest(w / (210 / 25.4), h / (297 / 25.4))
