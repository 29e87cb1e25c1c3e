import datetime

import pytest
from pyspark.sql import functions as F

from pageloom.operators import batch, state
from pageloom.sources import files, text

FILES = [("/in/b/x.pdf", 10, 2), ("/in/a/X.PDF", None, 1), ("/in/a/n.png", 5, None), ("/in/a/a.v1.pdf", 3 << 20, 12), ("/in/b/y.pdf", 60 << 20, None)]


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame(FILES, "path string, size_bytes long, n_pages int")


def test_listing_repeats_by_suffix(listed):
    got = sorted((r["path"], r["suffix"]) for r in batch.list_files(listed, [".png", "G"]).collect())
    assert got == [("/in/a/n.png", ".png"), ("/in/a/n.png", "g")]


def test_compress_summary_and_report(listed):
    items = batch.compress_items(listed, "ebook")
    row = batch.summary(items).first()
    assert (row["total"], row["success"], row["errors"], row["error_lines"]) == (4, 3, 1, "X.PDF: unreadable")
    said = batch.report_text(batch.summary(items), "Batch", F.expr("timestamp '2024-01-02 03:04:05'")).first()[0]
    assert "Total: 4" in said and "- X.PDF: unreadable" in said and "2024-01-02 03:04:05" in said
    assert batch.summary(batch.compress_items(listed.where("false"), "ebook")).count() == 0
    assert batch.summary(batch.compress_items(listed, "best")).first()["success"] == 0


def test_rename(listed):
    got = {r["path"]: (r["seq"], r["out_name"], r["status"]) for r in batch.rename_items(listed, "[SIRA]:[ORIJINAL_AD]-[SAYFA_SAYISI]-[BOYUT]-[TARIH]", F.expr("timestamp '2024-01-02 03:04:05'")).collect()}
    assert got["/in/a/a.v1.pdf"] == (2, "002_a.v1-12pp-3.0MB-2024-01-02.pdf", "ok")
    assert got["/in/a/X.PDF"] == (1, None, "error") and got["/in/b/y.pdf"][2] == "error" and sorted(v[0] for v in got.values()) == [1, 2, 3, 4]


def test_collisions(spark):
    df = spark.createDataFrame([("/a/x.pdf", 1), ("/b/x.pdf", 1), ("/b/z.pdf", 1)], "path string, size_bytes long")
    assert [tuple(r) for r in batch.collisions(batch.compress_items(df, "screen")).collect()] == [("compressed_x.pdf", 2, "/a/x.pdf|/b/x.pdf")]


def test_convert_routes(listed):
    got = {r["path"]: (r["out_name"], r["status"]) for r in batch.convert_items(listed, F.when(F.col("n_pages") == 12, "zip").otherwise("pdf2img")).collect()}
    assert got["/in/b/x.pdf"] == ("x/", "ok") and got["/in/a/n.png"] == (None, "skipped") and got["/in/a/a.v1.pdf"] == (None, "unknown_mode")


def test_lookup(spark):
    listing = spark.createDataFrame([("Downloads", "a.pdf"), ("Documents", "A.PDF"), ("Documents", "a.Pdf"), ("Desktop", "c.pdf"), ("Else", "d.pdf"), ("Documents", "c.pdf"), ("Documents", "b.pdf"), ("Documents", "B.pdf")], "dir string, name string")
    asked = spark.createDataFrame([("a.pdf",), ("c.pdf",), ("d.pdf",), ("b.pdf",)], "name string")
    assert {r["name"]: r["found"] for r in batch.lookup_files(asked, listing).collect()} == {"a.pdf": "Documents/A.PDF", "c.pdf": "Desktop/c.pdf", "d.pdf": None, "b.pdf": "Documents/b.pdf"}


def test_large(listed):
    assert [r["large"] for r in batch.large_files(listed).orderBy("path").collect()] == [False, False, False, False, True]


def test_parallel_map(spark):
    def half(x):
        if x % 2:
            raise ValueError("odd")
        return str(x // 2)

    got = {r["item"]: (r["result"], r["error"]) for r in batch.parallel_map(spark.createDataFrame([(2,), (3,)], "item long"), half).collect()}
    assert got == {2: ("1", None), 3: (None, "odd")}


def test_registered_parallel_map_is_a_loop(spark):
    from pageloom import queries

    d = "/root/testdata/sf0.001"
    got = sorted((r["item"], r["result"], r["error"]) for r in queries.QUERIES["parallel_map"](spark, d).collect())
    want = []
    for r in spark.read.parquet(f"{d}/documents.parquet").select("lang", "n_chars").collect():
        item = f"{r['lang']}:{r['n_chars']}"
        want.append((item, None, "no fr") if r["lang"] == "fr" else (item, str(r["n_chars"] + 1), None))
    assert sorted(want, key=str) == sorted(got, key=str)


def test_directory_listing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PDF").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"x")
    got = files.list_directory(spark, str(tmp_path)).collect()
    assert [(r["path"].endswith("a.PDF"), r["size_bytes"]) for r in got] == [(True, 3)]
    assert files.list_directory(spark, str(tmp_path / "none")).count() == 0


def test_text_exports(spark):
    from pageloom import model

    p = model.pages_of_documents(spark.createDataFrame([(1, "a\n\nb")], "doc_id long, text string"))
    assert text.export_text(p, "|").first()["content"] == "a|b"
    assert text.export_ocr(p).first()["content"] == "--- Sayfa 1 ---\na\n--- Sayfa 2 ---\n\n--- Sayfa 3 ---\nb"


def test_recogniser_fails_whole_document(spark):
    def read(image, language):
        if image == b"bad":
            raise ValueError("blurred")
        return f"{language}:{image.decode()}"

    df = spark.createDataFrame([(1, 1, b"x"), (1, 2, b"bad"), (2, 1, b"y")], "doc_id long, page_no int, image binary")
    got = {(r["doc_id"], r["page_no"]): (r["body"], r["error"]) for r in text.recognise(df, read).collect()}
    assert got == {(1, 1): (None, "blurred"), (1, 2): (None, "blurred"), (2, 1): ("tur:y", None)}


def test_recent_and_lists(spark):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    opened = spark.createDataFrame([(1, f"f{i}", t(i)) for i in range(12)] + [(1, "f0", t(30))], "user_id long, path string, at timestamp")
    got = [r["path"] for r in state.recent_files(opened).orderBy("pos").collect()]
    assert got == ["f0", *(f"f{i}" for i in range(11, 2, -1))]
    lists = spark.createDataFrame([(["a", "b", "c"],)], "x array<string>")
    row = lists.select(state.push_recent(F.col("x"), F.lit("b")), state.push_recent(F.col("x"), F.lit("d"), 3), state.move_item(F.col("x"), 0, 1), state.move_item(F.col("x"), 0, -1), state.remove_items(F.col("x"), [0, 2])).first()
    assert list(row) == [["b", "a", "c"], ["d", "a", "b"], ["b", "a", "c"], ["a", "b", "c"], ["b"]]


def test_config_and_translation(spark):
    df = spark.createDataFrame([('{"theme": "dark"}',), (None,), ("[",)], "t string").select(state.read_config(F.col("t")).alias("c"))
    assert [(r["c"]["theme"], r["c"]["language"], r["c"]["recent_files"]) for r in df.collect()] == [("dark", "en", []), ("light", "en", []), ("light", "en", [])]
    assert df.select(state.write_config(F.col("c"))).first()[0].startswith('{"language":"en"')
    cat = spark.createDataFrame([("en", "k", "K"), ("tr", "k", "T")], "lang string, key string, template string")
    asked = spark.createDataFrame([("tr", "k"), ("xx", "k"), (None, "k"), ("tr", "z")], "lang string, key string")
    assert sorted(r["text"] for r in state.translate(asked, cat).collect()) == ["K", "K", "T", "z"]


def test_dropped_file(spark):
    df = spark.createDataFrame([(["/a/x.PNG", "/a/y.pdf"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(files.route_dropped(F.col("p"), F.lit("image_to_pdf"))).collect()] == ["/a/x.PNG", None]
