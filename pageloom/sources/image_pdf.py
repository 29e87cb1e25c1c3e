"""Images as PDF pages and image files: every photo a page, pixels by Flate."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .files import encode_png

PAGE_SIZES = {"A4": (595, 842), "Letter": (612, 792)}


def image_pdf(images: list[np.ndarray], size: str = "original", dpi: float | None = None) -> bytes:
    """One page per image, fitted to a page size or at a resolution (72 dpi if neither is given)."""
    objects: list[bytes] = [b"<</Type/Catalog/Pages 2 0 R>>", b""]
    kids = []
    for img in images:
        h, w, c = img.shape
        if size in PAGE_SIZES:
            tw, th = PAGE_SIZES[size]
            k = min(tw / w, th / h)
            pw, ph = int(w * k), int(h * k)
        else:
            pw, ph = w * 72 / (dpi or 72), h * 72 / (dpi or 72)
        rgb = np.ascontiguousarray(img[:, :, ::-1] if c == 3 else img).tobytes()
        n, pixels = len(objects), zlib.compress(rgb)
        draw = f"q {pw:g} 0 0 {ph:g} 0 0 cm /I Do Q".encode()
        kids.append(n + 1)
        objects.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 {pw:g} {ph:g}]/Contents {n + 2} 0 R/Resources<</XObject<</I {n + 3} 0 R>>>>>>".encode())
        objects.append(b"<</Length %d>>stream\n%s\nendstream" % (len(draw), draw))
        objects.append(b"<</Type/XObject/Subtype/Image/Width %d/Height %d/ColorSpace/%s/BitsPerComponent 8/Filter/FlateDecode/Length %d>>stream\n%s\nendstream" % (w, h, b"DeviceRGB" if c == 3 else b"DeviceGray", len(pixels), pixels))
    objects[1] = f"<</Type/Pages/Count {len(kids)}/Kids[{' '.join(f'{k} 0 R' for k in kids)}]>>".encode()
    out = bytearray(b"%PDF-1.5\n")
    for i, body in enumerate(objects, 1):
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    return bytes(out + b"trailer<</Size %d/Root 1 0 R>>\n%%%%EOF" % (len(objects) + 1))


def images_to_pdf(photos: DataFrame, size: str = "original") -> DataFrame:
    """``photos(doc_id, position, h, w, c, px)`` to ``(doc_id, pdf)``, pages by position; one resolution, the first photo's."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("position")
        images = [np.frombuffer(r.px, np.uint8).reshape(r.h, r.w, r.c) for r in part.itertuples()]
        first = images[0]
        dpi = max(first.shape[1] / (210 / 25.4), first.shape[0] / (297 / 25.4))
        return pd.DataFrame({"doc_id": [part["doc_id"].iloc[0]], "pdf": [image_pdf(images, size, dpi)]})

    return photos.where("px is not null").groupBy("doc_id").applyInPandas(one, "doc_id long, pdf binary")


def images_to_png(photos: DataFrame) -> DataFrame:
    """``(img_id, png)``; null where the pixels don't fit their size."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    out.append(encode_png(np.frombuffer(r.px, np.uint8).reshape(r.h, r.w, r.c)))
                except (TypeError, ValueError):
                    out.append(None)
            yield pd.DataFrame({"img_id": batch["img_id"], "png": pd.Series(out, dtype=object, index=batch.index)})

    return photos.select("img_id", "h", "w", "c", "px").mapInPandas(run, "img_id long, png binary")
