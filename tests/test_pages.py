import pytest
from pyspark.sql import functions as F

from pageloom import model
from pageloom.functions import names, spec
from pageloom.operators import annotate, pages
from pageloom.plans import planner


@pytest.fixture(scope="module")
def book(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x"), (3, "p\n\nq"), (4, None)]
    return model.pages_of_documents(spark.createDataFrame(rows, "doc_id long, text string")).cache()


def shown(df, doc=1):
    return [r["body"] for r in df.where(F.col("doc_id") == doc).orderBy("page_no").collect()]


def dense(df):
    got = df.groupBy("doc_id").agg(F.min("page_no").alias("a"), F.max("page_no").alias("b"), F.count("*").alias("n"), F.count_distinct("page_no").alias("d")).collect()
    return all(r["a"] == 1 and r["b"] == r["n"] == r["d"] for r in got)


def test_counts(book):
    assert {r["doc_id"]: r["n_pages"] for r in pages.page_count(book).collect()} == {1: 5, 2: 1, 3: 3}


def test_range(book):
    got = pages.select_range_checked(book, 2, 3)
    assert shown(got) == ["b", "c"] and shown(got, 2) == [] and dense(got)
    assert shown(pages.select_range(book, 1, 99)) == list("abcde")


def test_range_status_order(book):
    at = lambda a, b: {r["doc_id"]: r["status"] for r in pages.range_status(pages.page_count(book), a, b).collect()}
    assert at(0, 9)[1] == "start_below_1" and at(3, 9)[1] == "end_beyond_last" and at(3, 2)[1] == "start_after_end" and at(1, 5)[1] == "ok"
    with pytest.raises(ValueError, match="document 2"):
        pages.strict(pages.range_status(pages.page_count(book), 1, 3))


def test_delete(book):
    got = pages.delete_pages(book, [2, 2, 4, 99, 0, -1])
    assert shown(got) == ["a", "c", "e"] and dense(got)
    status = {r["doc_id"]: (r["remaining"], r["status"]) for r in pages.delete_status(pages.page_count(book), [1, 7]).collect()}
    assert status == {1: (4, "ok"), 2: (0, "nothing_remains"), 3: (2, "ok")}
    assert shown(pages.delete_pages(book, [])) == list("abcde")


def test_delete_and_keep_make_all(book):
    rest = shown(pages.delete_pages(book, [1, 3]))
    assert sorted(rest + shown(pages.reorder_pages(book, "1,3"))) == list("abcde")


def test_rotate_four_times_is_identity(book):
    turned = book
    for _ in range(4):
        turned = pages.rotate_pages(turned, None, 90)
    assert {r["rotation"] for r in turned.collect()} == {0}
    some = pages.rotate_pages(book, [2], 270)
    assert [r["rotation"] for r in some.where("doc_id = 1").orderBy("page_no").collect()] == [0, 270, 0, 0, 0]


def test_reorder(book):
    got = pages.reorder_pages(book, "3, 1,1")
    assert shown(got) == ["c", "a", "a"] and shown(got, 3) == ["q", "p", "p"] and shown(got, 2) == [] and dense(got)
    assert shown(pages.reorder_pages(book, "1,2,3,4,5")) == list("abcde")
    state = {r["doc_id"]: r["status"] for r in pages.reorder_status(pages.page_count(book), "1,,2").collect()}
    assert set(state.values()) == {"bad_order"}


def test_merge_keeps_order_and_repeats(spark, book):
    plan = spark.createDataFrame([(9, 1, 3), (9, 2, 1), (9, 3, 3), (8, 1, 2)], "out_id long, file_pos int, doc_id long")
    got = pages.merge_documents(book, plan)
    assert shown(got, 9) == ["p", "", "q", *"abcde", "p", "", "q"] and shown(got, 8) == ["x"] and dense(got)
    assert shown(pages.select_range(got, 4, 8), 9) == list("abcde")  # merge, then split, is the original


SPECS = [("1, 3-5, 8", 9, [1, 3, 4, 5, 8]), ("", 9, None), (" , ,2", 9, [2]), ("5-3", 9, None), ("-3", 9, None), ("2-2,2,1 - 4", 9, [1, 2, 3, 4]), ("x", 9, None), ("10", 9, None), ("0", 9, None), ("1-2-3", 9, None), (None, 9, None), ("3,1,2", 3, [1, 2, 3])]


def test_page_spec(spark):
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(SPECS)], "i int, s string, t int")
    got = {r["i"]: r["p"] for r in df.select("i", spec.parse_pages(F.col("s"), F.col("t")).alias("p")).collect()}
    assert [got[i] for i in range(len(SPECS))] == [p for _, _, p in SPECS]
    again = spark.createDataFrame([(",".join(map(str, p)), t) for _, t, p in SPECS if p], "s string, t int")
    assert [r[0] for r in again.select(spec.parse_pages(F.col("s"), F.col("t"))).collect()] == [p for _, _, p in SPECS if p]


def test_spec_status(spark):
    df = spark.createDataFrame([("1", 2), ("", 2), (None, 2), ("3", 2), (" ,", 2)], "s string, t int")
    assert [r[0] for r in df.select(spec.page_spec_status(F.col("s"), F.col("t"))).collect()] == ["ok", "empty", "empty", "invalid", "empty"]


def test_names(spark):
    df = spark.createDataFrame([("a.b.pdf",), ("noext",), (".hidden",), ("ş.PDF",)], "n string")
    got = df.select(names.stem(F.col("n")), names.compressed_name(F.col("n")), names.extension(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("a.b", "a.b_compressed.pdf", ".pdf"), ("noext", "noext_compressed.pdf", ""), (".hidden", ".hidden_compressed.pdf", ""), ("ş", "ş_compressed.PDF", ".pdf")]
    nums = spark.createDataFrame([(0.25, 7), (0.35, 1234)], "x double, n int").select(names.decimal(F.col("x"), 1), names.image_name(F.col("n"), F.lit("tiff"))).collect()
    assert [tuple(r) for r in nums] == [("0.2", "sayfa_007.jpg"), ("0.3", "sayfa_1234.jpg")]


def test_progress(spark):
    df = spark.createDataFrame([(30.0, 100.0), (1e9, 1.0), (5.0, 0.0)], "a double, b double")
    assert [tuple(r) for r in df.select(names.compress_progress(F.col("a"), F.col("b")), names.progress_percent(F.least("a", F.lit(99.0)), F.col("b"))).collect()] == [(45, 30), (90, 9900), (90, 500)]


def test_overlay_and_stamp(book):
    marked = annotate.stamp_image(annotate.overlay_text(book, "X"), "s.png", 2, 1, 2, 100, 50)
    rows = {r["page_no"]: r["overlays"] for r in marked.where("doc_id = 1").collect()}
    assert [o["kind"] for o in rows[2]] == ["text", "image"] and len(rows[1]) == 1 and rows[2][1]["w"] == 20.0
    assert {r["doc_id"]: r["status"] for r in annotate.stamp_status(pages.page_count(book), 2).collect()}[2] == "page_out_of_range"
    with pytest.raises(ValueError):
        annotate.overlay_text(book, "")


def test_encryption(book):
    sealed = annotate.encrypt(book, "pw")
    assert {r["body"] for r in sealed.collect()} == {None}
    assert shown(annotate.decrypt(sealed, "pw")) == list("abcde")
    assert {r["status"] for r in annotate.decrypt(sealed, "no").collect()} == {"wrong_password"}
    plain = annotate.decrypt(book.withColumn("cipher", F.lit(None).cast("binary")).withColumn("encrypted", F.lit(False)), "pw")
    assert {r["status"] for r in plain.collect()} == {"not_encrypted"} and shown(plain) == list("abcde")


def test_metadata(spark):
    df = spark.createDataFrame([({"Title": "t", "Keywords": "k"},), (None,)], "m map<string,string>")
    at = F.expr("timestamp '2024-01-02 03:04:05'")
    read = [tuple(r) for r in df.select(*annotate.read_metadata(F.col("m"))).collect()]
    assert read == [("t", "", "", "", ""), ("", "", "", "", "")]
    new = [r[0] for r in df.select(annotate.update_metadata(F.col("m"), {"Title": "", "Author": None, "Subject": "s"}, at)).collect()]
    assert new == [{"Keywords": "k", "Title": "", "Subject": "s", "ModDate": "D:20240102030405"}, {"Title": "", "Subject": "s", "ModDate": "D:20240102030405"}]
    clean = df.select(annotate.update_metadata(F.col("m"), {}, at, clean=True)).first()[0]
    assert clean == {"ModDate": "D:20240102030405"}


CHAINS = [
    [("split", {"start": 1, "end": 4}), ("split", {"start": 2, "end": 3})],
    [("rotate", {"angle": 90}), ("rotate", {"angle": 270})],
    [("delete_pages", {"pages": [1]}), ("delete_pages", {"pages": [1, 3]})],
    [("split", {"start": 1, "end": 4}), ("delete_pages", {"pages": [2]}), ("rotate", {"angle": 180}), ("split", {"start": 2, "end": 2})],
]


@pytest.mark.parametrize("chain", CHAINS)
def test_optimized_chain_is_the_naive_fold(book, chain):
    naive = book
    for step in chain:
        naive = planner.run_chain(naive, [step])
    both = [[(r["page_no"], r["body"], r["rotation"]) for r in x.where("doc_id = 1").orderBy("page_no").collect()] for x in (naive, planner.run_chain(book, chain))]
    assert both[0] == both[1] and both[0]


def test_rewrites():
    assert planner.optimize(CHAINS[0]) == [("split", {"start": 2, "end": 3})]
    assert planner.optimize(CHAINS[1]) == []
    assert planner.optimize(CHAINS[2]) == [("delete_pages", {"pages": [1, 2, 4]})]
    assert planner.optimize([("encrypt", {"password": "p"}), ("rotate", {"angle": 90})])[-1][0] == "encrypt"


def test_range_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 as doc_id", "cast(id % 20 + 1 as int) as page_no", "'t' as body").write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    plan = pages.select_range(stored, 2, 3)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(page_no,2)" in plan and "LessThanOrEqual(page_no,3)" in plan and "Exchange" not in plan
