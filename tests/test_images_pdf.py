import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom import model
from pageloom.operators import images as im
from pageloom.sources import files, image_pdf, pdf


def photo():
    img = np.full((300, 220, 3), 40, np.uint8)
    img[40:260, 30:190] = 235
    return img


def test_quads(spark):
    df = spark.createDataFrame([([(9, 9), (0, 1), (8, 0), (1, 8)],)], "q array<struct<x:int,y:int>>")
    at = lambda c: [tuple(p) for p in df.select(c).first()[0]]
    assert at(im.order_quad(F.col("q"))) == [(0, 1), (8, 0), (9, 9), (1, 8)] == im.order_points(np.array([(9, 9), (0, 1), (8, 0), (1, 8)], float))
    back = im.rotate_quad(im.rotate_quad(F.col("q"), F.lit(10), F.lit(20), True), F.lit(20), F.lit(10), False)
    assert at(back) == [(9, 9), (0, 1), (8, 0), (1, 8)]
    assert at(im.inset_quad(F.lit(100), F.lit(50))) == [(5, 2), (95, 2), (95, 48), (5, 48)]
    assert at(im.reset_quad(F.lit(100), F.lit(50)))[2] == (80, 30)
    assert at(im.clamp_quad(F.array(F.struct(F.lit(-5.5).alias("x"), F.lit(99.9).alias("y"))), F.lit(10), F.lit(20))) == [(0, 20)]
    fit = im.canvas_fit(F.lit(100), F.lit(50), F.lit(50), F.lit(50))
    assert tuple(df.select(im.canvas_to_image(F.lit(25.0), F.lit(25.0), fit).alias("p")).first()["p"]) == (50.0, 25.0)


@pytest.mark.parametrize("angle", [0, 90, 180, 270, 450, 45])
def test_tile_rotation_is_numpy(spark, angle):
    a = np.arange(6).reshape(2, 3)
    got = im.rotate_tile(spark.createDataFrame([(1, 2, 3, a.ravel().tolist())], "img_id long, h int, w int, px array<int>"), angle).first()
    want = im.rotate_image(a, angle)
    assert (got["h"], got["w"]) == want.shape and got["px"] == want.ravel().tolist()


def test_tiles(spark):
    df = spark.createDataFrame([(1, 1, 3, [10, 20, 30]), (2, 1, 2, [7, 7])], "img_id long, h int, w int, px array<int>")
    assert [r["px"] for r in im.normalize_tile(df).orderBy("img_id").collect()] == [[0, 128, 255], [0, 0]]
    assert im.threshold_tile(df, 15).first()["px"] == [0, 255, 255]
    flat = im.blend_on_white(spark.createDataFrame([([0, 100], [0, 255])], "px array<int>, alpha array<int>")).first()
    assert flat["px"] == [255, 100]


def test_detection_and_fallback():
    quad = im.detect_quad(photo())
    assert np.abs(np.array(quad) - np.array([(30, 40), (190, 40), (190, 260), (30, 260)])).max() <= 6
    assert im.detect_quad(np.full((100, 200, 3), 9, np.uint8)) == [(10, 5), (190, 5), (190, 95), (10, 95)]


def test_warp_identity_and_size():
    img = np.random.default_rng(0).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    same = im.warp(img, np.array([(0, 0), (29, 0), (29, 19), (0, 19)]), (30, 20))
    assert np.abs(same.astype(int) - img).max() <= 1
    assert im.warp(photo(), np.array(im.detect_quad(photo())), (248, 350)).shape == (350, 248, 3)
    assert im.A4_PIXELS == (2480, 3508)


@pytest.mark.parametrize("mode", [*im.MODES, "other"])
def test_filters_keep_shape(mode):
    img = photo()
    out = im.scan_filter(img, mode)
    assert out.shape == img.shape and out.dtype == np.uint8
    if mode in ("original", "other"):
        assert out is img
    if mode == "bw":
        assert set(np.unique(out)) <= {0, 255}


def test_scan_orders_and_errors(spark):
    img = photo()
    rows = [(1, 300, 220, 3, img.tobytes(), 90), (2, 5, 5, 3, b"short", 0)]
    df = spark.createDataFrame(rows, "img_id long, h int, w int, c int, px binary, rotation int")
    lib = {r["img_id"]: r for r in im.scan(df, "bw", (60, 90)).collect()}
    gui = {r["img_id"]: r for r in im.scan(df, "bw", (60, 90), rotate_first=True).collect()}
    assert (lib[1]["h"], lib[1]["w"]) == (60, 90) and (gui[1]["h"], gui[1]["w"]) == (90, 60) and lib[2]["px"] is None and lib[2]["error"]
    assert im.assemble(spark.createDataFrame([(1, 2, 10, 10), (1, 1, 210, 297)], "doc_id long, position int, w int, h int")).orderBy("page_no").first()["position"] == 1


@pytest.mark.parametrize("c", [1, 3, 4])
def test_png_round_trip(c):
    img = np.random.default_rng(c).integers(0, 256, (7, 5, c)).astype(np.uint8)
    assert (files.decode_image(files.encode_png(img)) == img).all()
    assert files.decode_image(b"nothing") is None and files.decode_image(b"P6\n1 1\n255\nabc").tolist() == [[[99, 98, 97]]]


def test_read_images(spark):
    img = np.array([[[0, 0, 0, 0], [10, 20, 30, 255]]], np.uint8)
    df = spark.createDataFrame([("a", files.encode_png(img)), ("b", b"x"), ("c", None)], "path string, content binary")
    got = {r["path"]: r["px"] and bytes(r["px"]) for r in files.read_images(df).collect()}
    assert got == {"a": bytes([255, 255, 255, 10, 20, 30]), "b": None, "c": None}


def test_pdf_round_trip():
    pages = [("satır bir\nğüşİ (2)", 90, 595.0, 842.0), ("", 0, 612.0, 792.0)]
    assert pdf.read_pdf(pdf.make_pdf(pages)) == pages
    with pytest.raises(ValueError):
        pdf.read_pdf(b"no")
    assert pdf.page_text(rb"BT /F1 9 Tf 1 0 0 1 0 0 Tm (a\)b) Tj T* [(c) -20 (\144)] TJ ET") == "a)b\ncd"


def test_pdf_source(spark, tmp_path):
    book = model.pages_of_documents(spark.createDataFrame([(1, "a\nb\nc"), (2, "ş")], "doc_id long, text string"))
    pdf.write_pdfs(book, str(tmp_path / "out"))
    got = spark.read.format("pdfpages").load(str(tmp_path / "out"))
    assert sorted((r["path"].rsplit("/", 1)[1], r["page_no"], r["body"]) for r in got.collect()) == [("doc_1.pdf", 1, "a"), ("doc_1.pdf", 2, "b"), ("doc_1.pdf", 3, "c"), ("doc_2.pdf", 1, "ş")]
    assert got.where("page_no >= 2 and page_no <= 2").count() == 1


def test_image_pdf(spark):
    img = photo()
    got = pdf.read_pdf(image_pdf.image_pdf([img, img], "A4"))
    assert len(got) == 2 and got[0][2:] == (595.0, 811.0)
    df = spark.createDataFrame([(1, 1, 300, 220, 3, img.tobytes()), (1, 0, 300, 220, 3, img.tobytes())], "doc_id long, position int, h int, w int, c int, px binary")
    assert len(pdf.read_pdf(bytes(image_pdf.images_to_pdf(df).first()["pdf"]))) == 2
    one = image_pdf.images_to_png(df.selectExpr("doc_id as img_id", "h", "w", "c", "px")).first()
    assert (files.decode_image(bytes(one["png"])) == img).all()
