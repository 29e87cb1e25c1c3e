"""Overlays, stamps, encryption and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import A4, OVERLAY


def overlay_text(pages: DataFrame, text: str, opacity: float = 0.3, angle: int = 45, size: int = 60) -> DataFrame:
    """Text across every page, centred on A4 whatever the page's size; empty text is refused."""
    if not text:
        raise ValueError("overlay text is empty")
    made = F.struct(F.lit("text").alias("kind"), F.lit(text).alias("text"), F.lit(opacity).alias("opacity"), F.lit(angle).alias("angle"), F.lit(size).alias("size"), F.lit(A4[0] / 2).alias("x"), F.lit(A4[1] / 2).alias("y"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("h"))
    return pages.withColumn("overlays", F.array_append("overlays", made.cast(OVERLAY)))


def stamp_image(pages: DataFrame, image: str, page_no: int, x: float, y: float, px_w: int, px_h: int, scale: float = 1.0) -> DataFrame:
    """An image on one page, a fifth of its pixels in points, from the lower left; other pages pass through."""
    made = F.struct(F.lit("image").alias("kind"), F.lit(image).alias("text"), F.lit(1.0).alias("opacity"), F.lit(0).alias("angle"), F.lit(0).alias("size"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(px_w * scale * 0.2).alias("w"), F.lit(px_h * scale * 0.2).alias("h"))
    return pages.withColumn("overlays", F.when(F.col("page_no") == page_no, F.array_append("overlays", made.cast(OVERLAY))).otherwise(F.col("overlays")))


def stamp_status(counts: DataFrame, page_no: int) -> DataFrame:
    return counts.withColumn("status", F.when(F.lit(page_no).between(1, F.col("n_pages")), "ok").otherwise("page_out_of_range"))


def _key(password: str | Column) -> Column:
    return F.unhex(F.md5((password if isinstance(password, Column) else F.lit(password)).cast("binary")))


def seal(body: Column, password: str | Column) -> Column:
    """AES-GCM under a key that is the unsalted MD5 of the password: it keeps pages from being read in passing, no more."""
    return F.aes_encrypt(body.cast("binary"), _key(password))


def unseal(cipher: Column, password: str | Column) -> Column:
    """The sealed body; null under a wrong password."""
    return F.try_aes_decrypt(cipher, _key(password)).cast("string")


def encrypt(pages: DataFrame, password: str) -> DataFrame:
    """Add ``cipher`` in place of body. AES-GCM by Spark; not compatible with PDF encryption."""
    return pages.withColumn("cipher", seal(F.col("body"), password)).withColumn("body", F.lit(None).cast("string")).withColumn("encrypted", F.lit(True))


def decrypt(pages: DataFrame, password: str) -> DataFrame:
    """Restore body; ``status`` is ``not_encrypted``, ``wrong_password`` or ``ok``."""
    plain = unseal(F.col("cipher"), password)
    state = F.when(~F.coalesce(F.col("encrypted"), F.lit(False)), "not_encrypted").when(F.col("cipher").isNotNull() & plain.isNull(), "wrong_password").otherwise("ok")
    return pages.withColumn("status", state).withColumn("body", F.when(F.col("encrypted"), plain).otherwise(F.col("body"))).drop("cipher")


READ_KEYS = ("Title", "Author", "Subject", "Creator", "Producer")


def read_metadata(meta: Column) -> list[Column]:
    """One column per key that is shown; a missing one is ''."""
    return [F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit("")).alias(k.lower()) for k in READ_KEYS]


def update_metadata(meta: Column, changes: dict[str, Column | str | None], as_of: Column, clean: bool = False) -> Column:
    """Existing entries (none if ``clean``) overridden by the changes; None leaves a key alone, '' is a value.

    ``ModDate`` is always set to ``as_of``, which callers pass in.
    """
    new = {k: (v if isinstance(v, Column) else F.lit(v)) for k, v in changes.items() if v is not None}
    new["ModDate"] = F.date_format(as_of, "'D:'yyyyMMddHHmmss")
    made = F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)])
    if clean:
        return made
    old = F.map_filter(F.coalesce(meta, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*new))
    return F.map_concat(old, made)
