"""Image operators: quads and tiles as array expressions, filters and warps as numpy in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import scan_resolution

A4_PIXELS = (2480, 3508)
MODES = ("original", "bw", "grayscale", "clean_doc", "sharp")


# --- expressions -----------------------------------------------------------------------------
def order_quad(points: Column) -> Column:
    """TL, TR, BR, BL of four ``struct<x,y>``: least and greatest x+y, least and greatest y-x; first on ties."""
    keyed = F.transform(points, lambda p, i: F.struct((p["x"] + p["y"]).alias("s"), (p["y"] - p["x"]).alias("d"), i.alias("i"), p.alias("p")))
    least = lambda k, sign: F.array_min(F.transform(keyed, lambda q: F.struct((q[k] * sign).alias("k"), q["i"].alias("i"), q["p"].alias("p"))))["p"]
    return F.array(least("s", 1), least("d", 1), least("s", -1), least("d", -1))


def rotate_quad(points: Column, w: Column, h: Column, clockwise: bool) -> Column:
    """Corners after a quarter turn of a w x h image."""
    turn = (lambda p: F.struct((h - p["y"]).alias("x"), p["x"].alias("y"))) if clockwise else (lambda p: F.struct(p["y"].alias("x"), (w - p["x"]).alias("y")))
    return F.transform(points, turn)


def inset_quad(w: Column, h: Column, share: float = 0.05) -> Column:
    """The fallback quad, inset by a share of either side."""
    mx, my = (w * share).cast("int"), (h * share).cast("int")
    return _corners(mx, my, w, h)


def reset_quad(w: Column, h: Column, margin: int = 20) -> Column:
    return _corners(F.lit(margin), F.lit(margin), w, h)


def _corners(mx: Column, my: Column, w: Column, h: Column) -> Column:
    at = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    return F.array(at(mx, my), at(w - mx, my), at(w - mx, h - my), at(mx, h - my))


def clamp_quad(points: Column, w: Column, h: Column) -> Column:
    """Corners kept within the image, then truncated."""
    within = lambda v, top: F.greatest(F.lit(0), F.least(v, top)).cast("int")
    return F.transform(points, lambda p: F.struct(within(p["x"], w).alias("x"), within(p["y"], h).alias("y")))


def canvas_fit(w: Column, h: Column, cw: Column, ch: Column) -> Column:
    """Scale and offsets that centre an image on a canvas."""
    k = F.least(cw / w, ch / h)
    return F.struct(k.alias("scale"), ((cw - w * k) / 2).alias("dx"), ((ch - h * k) / 2).alias("dy"))


def canvas_to_image(x: Column, y: Column, fit: Column) -> Column:
    return F.struct(((x - fit["dx"]) / fit["scale"]).alias("x"), ((y - fit["dy"]) / fit["scale"]).alias("y"))


def rotate_tile(tiles: DataFrame, angle: int) -> DataFrame:
    """Turn ``(h, w, px)`` clockwise by a multiple of 90; any other angle changes nothing. An index permutation."""
    turn = angle % 360
    h, w, px = F.col("_tile_h"), F.col("_tile_w"), F.col("px")
    get = lambda i: F.get(px, i.cast("int"))
    spots = F.sequence(F.lit(0), h * w - 1)
    quotient = lambda i, n: F.floor(i / n)
    if turn == 180:
        return tiles.withColumn("px", F.reverse(px))
    if turn not in (90, 270):
        return tiles
    spot = (lambda i: (h - 1 - i % h) * w + quotient(i, h)) if turn == 90 else (lambda i: (i % h) * w + (w - 1 - quotient(i, h)))
    # Inside a lambda "h" would be the turned tile's, by lateral alias; the sides as they were have names of their own.
    turned = {"px": F.transform(spots, lambda i: get(spot(i))), "h": w, "w": h}
    named = tiles.select("*", F.col("h").alias("_tile_h"), F.col("w").alias("_tile_w"))
    return named.select(*[turned[c].alias(c) if c in turned else F.col(f"`{c}`") for c in tiles.columns])


def normalize_tile(tiles: DataFrame) -> DataFrame:
    """Stretch pixels to 0..255 (0 for a flat tile), rounded half up."""
    lo, hi = F.array_min("px"), F.array_max("px")
    return tiles.withColumn("px", F.transform("px", lambda p: F.when(hi > lo, F.floor((p - lo) * 255 / (hi - lo) + 0.5)).otherwise(0).cast("int")))


def threshold_tile(tiles: DataFrame, cut: int = 128) -> DataFrame:
    """255 above the cut, else 0."""
    return tiles.withColumn("px", F.transform("px", lambda p: F.when(p > cut, 255).otherwise(0)))


def blend_on_white(tiles: DataFrame) -> DataFrame:
    """Flatten ``px`` with ``alpha`` on white."""
    both = F.zip_with("px", "alpha", lambda p, a: F.floor((p * a + 255 * (255 - a)) / 255 + 0.5).cast("int"))
    return tiles.withColumn("px", both).drop("alpha")


# --- numpy kernels ---------------------------------------------------------------------------
def _gauss(sigma: float, size: int) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x**2) / (2 * sigma * sigma))
    return k / k.sum()


def _pad(img: np.ndarray, r: int, mode: str) -> np.ndarray:
    return np.pad(img, [(r, r), (r, r)] + [(0, 0)] * (img.ndim - 2), mode=mode)


def blur(img: np.ndarray, sigma: float, size: int) -> np.ndarray:
    """Separable Gaussian blur, reflected at the border."""
    r, k = size // 2, _gauss(sigma, size)
    padded = _pad(img.astype(np.float64), r, "reflect" if min(img.shape[:2]) > r else "edge")
    rows = sum(w * padded[i : i + img.shape[0]] for i, w in enumerate(k))
    return sum(w * rows[:, i : i + img.shape[1]] for i, w in enumerate(k))


def _windows(img: np.ndarray, size: int, rows: slice = slice(None)) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(_pad(img, size // 2, "edge"), (size, size))[rows]


def _strips(height: int, rows: int = 16) -> list[slice]:
    """Rows handled at once where a filter copies whole windows: 16 rows of A4 at 300 dpi are 18 MB of 21 x 21 windows."""
    return [slice(i, min(i + rows, height)) for i in range(0, height, rows)]


def _slide(img: np.ndarray, size: int, best) -> np.ndarray:
    """Running minimum or maximum of a square, one axis at a time."""
    padded = _pad(img, size // 2, "edge")
    rows = best.reduce([padded[i : i + img.shape[0]] for i in range(size)])
    return best.reduce([rows[:, i : i + img.shape[1]] for i in range(size)])


def gray(img: np.ndarray) -> np.ndarray:
    """Luma of a BGR image; one channel is luma already."""
    if img.ndim == 2 or img.shape[2] == 1:
        return img.reshape(img.shape[:2])
    return np.floor(img[:, :, :3] @ np.array([0.114, 0.587, 0.299]) + 0.5).astype(np.uint8)


def equalize(img: np.ndarray, clip: float, grid: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation, bilinear between tile centres."""
    h, w = img.shape
    th, tw = -(-h // grid), -(-w // grid)
    padded = np.pad(img, ((0, th * grid - h), (0, tw * grid - w)), mode="edge" if min(h, w) < max(th, tw) * grid - min(h, w) + 1 else "reflect")
    maps = np.zeros((grid, grid, 256))
    limit = max(1, int(clip * th * tw / 256))
    for i in range(grid):
        for j in range(grid):
            hist = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            spare = np.maximum(hist - limit, 0).sum()
            hist = np.minimum(hist, limit) + spare / 256
            maps[i, j] = np.cumsum(hist) * 255 / (th * tw)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    at = lambda a, b: maps[np.clip(a, 0, grid - 1)[:, None], np.clip(b, 0, grid - 1)[None], img]
    out = at(y0, x0) * (1 - fy) * (1 - fx) + at(y0, x0 + 1) * (1 - fy) * fx + at(y0 + 1, x0) * fy * (1 - fx) + at(y0 + 1, x0 + 1) * fy * fx
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def scan_filter(img: np.ndarray, mode: str) -> np.ndarray:
    """The five scan modes; an unknown one is the identity. Shape is kept."""
    if mode not in MODES or mode == "original":
        return img
    plane = gray(img)
    if mode == "bw":
        mean = np.floor(blur(plane, 0.3 * (25 - 1) + 0.8, 51) + 0.5)
        plane = np.where(plane > mean - 15, 255, 0).astype(np.uint8)
    elif mode == "grayscale":
        plane = equalize(plane, 2.0)
    elif mode == "clean_doc":
        ground = _slide(_slide(plane, 25, np.maximum), 25, np.minimum)
        ground = np.concatenate([np.median(_windows(ground, 21, rows), axis=(2, 3)) for rows in _strips(len(ground))])
        flat = np.where(ground > 0, np.minimum(np.floor(plane * 255.0 / np.maximum(ground, 1) + 0.5), 255), 0)
        span = flat.max() - flat.min()
        plane = (np.floor((flat - flat.min()) * 255 / span + 0.5) if span else flat * 0).astype(np.uint8)
    else:
        strong = equalize(plane, 3.0).astype(np.float64)
        plane = np.clip(np.floor(1.5 * strong - 0.5 * blur(strong, 3.0, 19) + 0.5), 0, 255).astype(np.uint8)
    return plane if img.ndim == 2 else np.repeat(plane[:, :, None], img.shape[2], axis=2)


def rotate_image(img: np.ndarray, angle: int) -> np.ndarray:
    turn = angle % 360
    return np.rot90(img, -turn // 90) if turn % 90 == 0 else img


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The projective map that sends four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def _lanczos(t: np.ndarray, lobes: int = 4) -> np.ndarray:
    taps = np.arange(-lobes + 1, lobes + 1)
    x = t[..., None] - taps
    k = np.sinc(x) * np.sinc(x / lobes)
    return k / k.sum(axis=-1, keepdims=True)


def warp(img: np.ndarray, corners: np.ndarray, size: tuple[int, int] = A4_PIXELS) -> np.ndarray:
    """The quad TL, TR, BR, BL as a width x height image; Lanczos over 8 x 8 pixels, edges repeated."""
    width, height = size
    back = homography(np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float), np.asarray(corners, float))
    flat = img if img.ndim == 3 else img[:, :, None]
    h, w = flat.shape[:2]
    out = np.empty((height, width, flat.shape[2]), np.uint8)
    for top in range(0, height, 64):  # strips bound the memory of the taps
        y, x = np.mgrid[top : min(top + 64, height), 0:width]
        u, v, z = np.tensordot(back, np.stack([x, y, np.ones_like(x)]).astype(float), 1)
        u, v = u / z, v / z
        iu, iv = np.floor(u).astype(int), np.floor(v).astype(int)
        ku, kv = _lanczos(u - iu), _lanczos(v - iv)
        total = np.zeros((*u.shape, flat.shape[2]))
        for a in range(8):
            rows = np.clip(iv + a - 3, 0, h - 1)
            line = sum(ku[..., b, None] * flat[rows, np.clip(iu + b - 3, 0, w - 1)] for b in range(8))
            total += kv[..., a, None] * line
        out[top : top + y.shape[0]] = np.clip(np.floor(total + 0.5), 0, 255)
    return out if img.ndim == 3 else out[:, :, 0]


def detect_quad(img: np.ndarray) -> list[tuple[int, int]]:
    """Corners of a page on a photo: strong edges, their largest outlines, the first convex four-corner one.

    Works at 1000 pixels at most. Without an outline of more than a tenth of the
    image, the fallback is a 5 % inset.
    """
    h, w = img.shape[:2]
    step = max(1, -(-max(h, w) // 1000))
    small = blur(gray(img)[::step, ::step], 1.1, 5)
    gy, gx = np.gradient(small * 4)
    strength = np.abs(gx) + np.abs(gy)
    edges = _slide((strength > 100).astype(np.uint8), 3, np.maximum)
    for outline in sorted(_outlines(edges), key=lambda o: -_area(o))[:10]:
        hull = _simplify(outline, 0.02 * np.sum(np.hypot(*np.diff(np.vstack([outline, outline[:1]]), axis=0).T)))
        if len(hull) == 4 and _area(hull) > 0.1 * small.size:
            return order_points(np.array(hull, float) * step)
    mx, my = int(w * 0.05), int(h * 0.05)
    return [(mx, my), (w - mx, my), (w - mx, h - my), (mx, h - my)]


def order_points(points: np.ndarray) -> list[tuple[int, int]]:
    s, d = points.sum(axis=1), points[:, 1] - points[:, 0]
    return [(int(points[i][0]), int(points[i][1])) for i in (s.argmin(), d.argmin(), s.argmax(), d.argmax())]


def _area(p: np.ndarray) -> float:
    p = np.asarray(p, float)
    x, y = p[:, 0], p[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def _outlines(mask: np.ndarray) -> list[np.ndarray]:
    """Convex hulls of the connected parts of a mask, by label propagation over runs of rows."""
    label = np.where(mask > 0, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        grown = np.where(mask > 0, _slide(label, 3, np.maximum), 0)
        if (grown == label).all():
            break
        # pointer jumping: every pixel takes the label of its label's pixel
        flat = grown.ravel()
        jump = flat[np.maximum(flat - 1, 0)]
        label = np.where(mask > 0, np.maximum(grown, jump.reshape(mask.shape)), 0)
    out = []
    ids, counts = np.unique(label[label > 0], return_counts=True)
    for i in ids[np.argsort(-counts)][:10]:
        y, x = np.nonzero(label == i)
        out.append(_hull(np.stack([x, y], axis=1)))
    return [o for o in out if len(o) > 2]


def _hull(points: np.ndarray) -> np.ndarray:
    points = np.unique(points, axis=0)
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(some):
        out = []
        for p in some:
            while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points.tolist()) + half(points.tolist()[::-1]))


def _simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring, split at its two farthest points."""

    def reduce(p):
        if len(p) < 3:
            return p
        a, b = p[0].astype(float), p[-1].astype(float)
        span = np.hypot(*(b - a)) or 1.0
        off = np.abs((b[0] - a[0]) * (a[1] - p[:, 1]) - (a[0] - p[:, 0]) * (b[1] - a[1])) / span
        k = int(off.argmax())
        return np.vstack([p[[0]], p[[-1]]]) if off[k] <= tolerance else np.vstack([reduce(p[: k + 1])[:-1], reduce(p[k:])])

    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    return np.vstack([reduce(ring[: far + 1])[:-1], reduce(np.vstack([ring[far:], ring[:1]]))[:-1]])


# --- the scan pipeline -----------------------------------------------------------------------
def scan(photos: DataFrame, mode: str, size: tuple[int, int] = A4_PIXELS, rotate_first: bool = False) -> DataFrame:
    """``photos(img_id, h, w, c, px binary, rotation[, corners])`` warped, rotated and filtered.

    Library order is warp, rotate, filter; ``rotate_first`` turns the photo (and
    its corners) before the warp. Output adds ``dpi`` and ``error``; a photo that
    can't be handled gets null pixels and its error.
    """
    schema = "img_id long, h int, w int, c int, px binary, error string"
    given = "corners" in photos.columns

    def one(r) -> tuple:
        img = np.frombuffer(r.px, np.uint8).reshape(r.h, r.w, r.c)
        turn = int(r.rotation or 0)
        quad = [(p["x"], p["y"]) for p in r.corners] if given and r.corners is not None else None
        if rotate_first and turn:
            for _ in range(turn % 360 // 90):
                quad = [(img.shape[0] - y, x) for x, y in quad] if quad else None
                img = rotate_image(img, 90)
            quad = order_points(np.array(quad, float)) if quad else None
            turn = 0
        flat = scan_filter(rotate_image(warp(img, quad or detect_quad(img), size), turn), mode)
        return flat.shape[0], flat.shape[1], flat.shape[2], np.ascontiguousarray(flat).tobytes(), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    out.append((r.img_id, *one(r)))
                except Exception as e:  # noqa: BLE001  (each photo's error is data)
                    out.append((r.img_id, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["img_id", "h", "w", "c", "px", "error"]).astype({"h": "Int32", "w": "Int32", "c": "Int32"})

    return photos.mapInPandas(run, schema).withColumn("dpi", scan_resolution(F.col("w"), F.col("h")))


def assemble(photos: DataFrame) -> DataFrame:
    """Page numbers for photos by position; one resolution for all, that of the first."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("position")
    return photos.withColumn("page_no", F.row_number().over(order)).withColumn("dpi", F.first(scan_resolution(F.col("w"), F.col("h"))).over(order))
