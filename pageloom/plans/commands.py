"""The command language: a Turkish sentence to an intent, as column expressions.

All patterns carry ``(?iU)`` so that letters such as ü and ş count as letters and
fold case whatever the JDK. Capitals fold by Unicode rules, not Turkish ones: a
sentence in capitals with I for ı isn't recognised.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Number words in the order they are replaced; a compound stays two numbers.
NUMBERS = tuple(zip("bir iki üç dört beş altı yedi sekiz dokuz on yirmi otuz kırk elli altmış yetmiş seksen doksan yüz".split(), (*range(1, 11), *range(20, 101, 10))))
LETTERS = "a-zA-ZçğıöşüÇĞİÖŞÜ0-9"
PLACES = (r"masa\s*üstündeki\s*", r"masaüstündeki\s*", r"belgelerim(?:deki)?\s*", r"belgelerdeki\s*", r"indirilenler(?:deki)?\s*", r"desktop(?:teki)?\s*")
OCR_WORDS = "ocr|ojr|osr|ogr|o.c.r|metin tanı|karakter tanı|yazı çıkar".split("|")
IMAGE_WORDS = "png|jpg|fotoğraf|resim|resme|görsel|görsele".split("|")
WORD_WORDS = ("kelime", "docx", "word")
DEFAULT_PASSWORD = "123456"
KWARGS = "map<string,string>"


def normalize(text: Column) -> Column:
    """Spoken ``nokta pdf`` and ``alt çizgi`` as signs, blanks around them eaten."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s*nokta\s*(?:pdf|PDF)\s*", ".pdf"), r"(?U)\s*alt\s*çizgi\s*", "_")


def numbers(text: Column) -> Column:
    """Number words as digits, whole words only."""
    return reduce(lambda t, wn: F.regexp_replace(t, rf"(?iU)\b{wn[0]}\b", str(wn[1])), NUMBERS, text)


def input_file(text: Column) -> Column:
    """The file a sentence names, '' if none: an explicit .pdf, else the word before "dosya", else before "p d f"."""
    found = lambda p: F.regexp_extract(text, "(?iU)" + p, 1)
    plain = found(r"([\w_-]+\.pdf)")
    before = [found(rf"([{LETTERS}_-]+)\s+{after}") for after in ("dosya", r"p\s*d\s*f")]
    name = F.when(plain != "", plain).when(before[0] != "", F.concat(before[0], F.lit(".pdf"))).when(before[1] != "", F.concat(before[1], F.lit(".pdf"))).otherwise("")
    return reduce(lambda n, p: F.trim(F.regexp_replace(n, "(?iU)" + p, "")), PLACES, name)


def output_target(text: Column) -> Column:
    """Folder to write to, null for that of the input; the first rule that fits."""
    low = F.lower(text)
    has = lambda *w: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in w])
    return (
        F.when(has("masaüstü", "masa üstü", "desktop"), "Desktop")
        .when(low.rlike(r"(?U)belge(?:ler)?(?:im)?'?(?:e|ye)\s+(?:at|koy|kaydet|yükle)"), "Documents")
        .when(has("indir") & has("klasör", "kaydet"), "Downloads")
    )


def _kw(**values: Column) -> Column:
    if not values:
        return F.expr(f"cast(map() as {KWARGS})")
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def actions(text: Column, default_password: str | None = DEFAULT_PASSWORD, strict_delete: bool = False) -> Column:
    """``array<struct<ord, action, kwargs>>`` in fixed rule order.

    Deletion takes every number of the sentence; ``strict_delete`` takes those
    before "sayfa" only. With ``default_password`` None an encryption without a
    password has a null one, which the planner refuses.
    """
    low = F.lower(text)
    has = lambda *w: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in w])
    group = lambda p, g=1, of=low: F.regexp_extract(of, "(?U)" + p, g)
    number = lambda c: F.ltrim(c, F.lit("0"))
    canonical = lambda c: F.when(number(c) == "", "0").otherwise(number(c))

    first, between, single = group(r"ilk\s+(\d+)"), r"(\d+)\s*(?:ve|ile|[-–])\s*(\d+)", group(r"(\d+)\.?\s*sayfa")
    low_end, high_end = group(between, 1), group(between, 2)
    split = (
        F.when(first != "", _kw(start=F.lit("1"), end=canonical(first)))
        .when(low_end != "", _kw(start=canonical(low_end), end=canonical(high_end)))
        .when(single != "", _kw(start=canonical(single), end=canonical(single)))
        .otherwise(_kw(start=F.lit("1"), end=F.lit("1")))
    )
    written = F.regexp_extract(text, rf"(?iU)([{LETTERS}]+)\s+yazılı", 1)
    secret = group(r"([a-z0-9]+)\s+(?:ile|diye|şifresiyle)\s+şifre")
    listed = F.regexp_extract_all(low, F.lit(r"(\d+)\.?\s*sayfa" if strict_delete else r"(\d+)"), 1)
    pages = F.filter(F.transform(listed, lambda n: n.try_cast("int")), lambda n: (n > 0) & (n < 10000))
    angle = group(r"(\d+)\s*derece").try_cast("int")
    ocr = has(*OCR_WORDS)
    convert = has("dönüştür")
    rules = [
        ("split", has("kes", "böl"), split),
        ("watermark", has("filigran"), _kw(text=F.when(written != "", F.upper(written)).otherwise("GİZLİ"))),
        ("compress", has("kompres", "küçült", "sıkıştır"), _kw(quality=F.lit("ebook"))),
        ("encrypt", has("parola", "şifrele", "şifre ekle"), _kw(password=F.when(secret != "", secret).otherwise(F.lit(default_password)))),
        ("delete_pages", has("sil") & has("sayfa") & (F.size(pages) > 0), _kw(pages=F.array_join(pages, ","))),
        ("rotate", has("döndür") | (has("çevir") & ~convert), _kw(angle=F.when(angle.isin(90, 180, 270), angle.cast("string")).otherwise("90"))),
        ("ocr", ocr, _kw()),
        ("pdf_to_image", has(*IMAGE_WORDS) & convert, _kw(format=F.when(has("jpeg", "jpg"), "jpg").otherwise("png"))),
        ("pdf_to_word", has(*WORD_WORDS) & convert, _kw()),
        ("pdf_to_text", has("metin") & (has("çıkar") | convert) & ~ocr, _kw()),
    ]
    made = [F.when(fits, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("action"), args.cast(KWARGS).alias("kwargs"))) for i, (name, fits, args) in enumerate(rules, 1)]
    return F.filter(F.array(*made), lambda a: a.isNotNull())


def parse(commands: DataFrame, **options) -> DataFrame:
    """``commands(cmd_id, raw_text)`` to intents; an empty or null sentence has a null intent."""
    text = numbers(normalize(F.col("raw_text")))
    there = F.coalesce(F.col("raw_text"), F.lit("")) != ""
    ready = commands.select("cmd_id", F.when(there, text).alias("raw_text"))
    t = F.col("raw_text")
    return ready.select("cmd_id", input_file(t).alias("input_file"), output_target(t).alias("output_target"), actions(t, **options).alias("action_chain"), "raw_text")


def kwargs_text(kwargs: Column) -> Column:
    """Arguments as ``a=1;b=2`` by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(kwargs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
