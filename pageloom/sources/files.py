"""Directory listings, images and file facts."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators.batch import list_files


def list_directory(spark: SparkSession, directory: str, extensions: list[str] = [".pdf"]) -> DataFrame:  # noqa: B006
    """``(path, size_bytes, suffix)`` of files below a directory; contents aren't read.

    A directory that isn't there has no files.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(directory)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], "path string, size_bytes long, suffix string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return list_files(found.select("path", F.col("length").alias("size_bytes")), extensions)


def preview_facts(documents: DataFrame) -> DataFrame:
    """``(doc_id, name, n_pages, size_mb)``."""
    return documents.select("doc_id", names.basename(F.col("path")).alias("name"), "n_pages", F.round(names.size_mb(F.col("size_bytes")), 4).alias("size_mb"))


def route_dropped(paths: Column, mode: Column) -> Column:
    """The first dropped file if the active conversion takes it, else null."""
    first = F.get(paths, F.lit(0))
    return F.when(names.accepts(mode, names.basename(first)), first)


def decode_image(data: bytes) -> np.ndarray | None:
    """PNG (8-bit, not interlaced), PPM/PGM and 24-bit BMP to ``uint8[h, w, c]`` in BGR(A) or gray; None for anything else."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while not data[end : end + 1].isspace():
                    end += 1
                fields.append(int(data[at:end]))
                at = end
            w, h, _ = fields
            c = 3 if data[1:2] == b"6" else 1
            return np.frombuffer(data, np.uint8, h * w * c, at + 1).reshape(h, w, c)[:, :, ::-1].copy()
        if data[:2] == b"BM":
            start, w, h, bits = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<ii", data, 18), struct.unpack_from("<H", data, 28)[0]
            if bits == 24:
                row = (w * 3 + 3) // 4 * 4
                img = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * 3].reshape(abs(h), w, 3)
                return (img[::-1] if h > 0 else img).copy()
    except (ValueError, IndexError, struct.error, zlib.error):
        pass
    return None


def _png(data: bytes) -> np.ndarray | None:
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, depth, color, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or interlace or channels is None:
        return None
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    for y in range(h):
        line, up = raw[y, 1:].astype(np.int64), out[y - 1].astype(np.int64) if y else np.zeros(w * channels, np.int64)
        kind = raw[y, 0]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            done = np.zeros(w * channels, np.int64)
            for x in range(w * channels):
                a = done[x - channels] if x >= channels else 0
                b, c = up[x], up[x - channels] if x >= channels else 0
                p = a + b - c
                near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                done[x] = (line[x] + (a if kind == 1 else (a + b) // 2 if kind == 3 else near)) & 255
            out[y] = done
    img = out.reshape(h, w, channels)
    return img[:, :, [2, 1, 0, 3]] if channels == 4 else img[:, :, ::-1] if channels == 3 else img


def encode_png(img: np.ndarray) -> bytes:
    """8-bit PNG of a gray, BGR or BGRA image."""
    h, w, c = img.shape
    rgb = img[:, :, [2, 1, 0, 3]] if c == 4 else img[:, :, ::-1] if c == 3 else img
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb).reshape(h, -1)], axis=1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def flatten(img: np.ndarray) -> np.ndarray:
    """Three colour channels: alpha is blended on white, gray is repeated."""
    if img.shape[2] in (2, 4):
        a = img[:, :, -1:].astype(float) / 255
        img = np.floor(img[:, :, :-1] * a + 255 * (1 - a) + 0.5).astype(np.uint8)
    return np.repeat(img, 3, axis=2) if img.shape[2] == 1 else img


def read_images(files: DataFrame) -> DataFrame:
    """``files(path, content)`` decoded to ``(path, h, w, c, px)``; nulls where decoding fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"]):
                img = None if data is None else decode_image(bytes(data))
                out.append((path, None, None, None, None) if img is None else (path, *(flat := flatten(img)).shape, np.ascontiguousarray(flat).tobytes()))
            yield pd.DataFrame(out, columns=["path", "h", "w", "c", "px"]).astype({"h": "Int32", "w": "Int32", "c": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, h int, w int, c int, px binary")
