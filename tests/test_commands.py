import pytest
from pyspark.sql import functions as F

from pageloom.plans import commands, planner

G = "GİZLİ"
EXPECTED = [
    ("Masaüstündeki rapor.pdf dosyasını sıkıştır", "rapor.pdf", "Desktop", [("compress", {"quality": "ebook"})]),
    ("Masaüstündeki sunum.pdf dosyasının ilk 3 sayfasını kes", "sunum.pdf", "Desktop", [("split", {"start": "1", "end": "3"})]),
    ("test.pdf dosyasını 2 ile 5 arası kes", "test.pdf", None, [("split", {"start": "2", "end": "5"})]),
    (f"rapor.pdf dosyasına {G} yazılı filigran ekle", "rapor.pdf", None, [("watermark", {"text": G})]),
    ("belge.pdf dosyasını abc123 ile şifrele", "belge.pdf", None, [("encrypt", {"password": "abc123"})]),
    ("rapor.pdf dosyasının 3. sayfasını sil", "rapor.pdf", None, [("delete_pages", {"pages": "3"})]),
    ("sunum.pdf dosyasını 90 derece döndür", "sunum.pdf", None, [("rotate", {"angle": "90"})]),
    ("rapor.pdf dosyasını resme dönüştür", "rapor.pdf", None, [("pdf_to_image", {"format": "png"})]),
    ("belge.pdf dosyasını word formatına dönüştür", "belge.pdf", None, [("pdf_to_word", {})]),
    ("tarama.pdf dosyasına OCR yap", "tarama.pdf", None, [("ocr", {})]),
    (f"Masaüstündeki finansal_rapor.pdf dosyasının ilk 5 sayfasını kes ve {G} yazılı filigran ekle", "finansal_rapor.pdf", "Desktop", [("split", {"start": "1", "end": "5"}), ("watermark", {"text": G})]),
    ("rapor.pdf dosyasını sıkıştır ve test123 ile şifrele", "rapor.pdf", None, [("compress", {"quality": "ebook"}), ("encrypt", {"password": "test123"})]),
    # further cases of the rules
    ("sunum nokta pdf yi ilk beş kes", "sunum.pdf", None, [("split", {"start": "1", "end": "5"})]),
    ("rapor p d f ini 7. sayfa böl", "rapor.pdf", None, [("split", {"start": "7", "end": "7"})]),
    ("test dosyasını keskinleştir", "test.pdf", None, [("split", {"start": "1", "end": "1"})]),
    ("a.pdf yi 45 derece çevir belgelerime kaydet", "a.pdf", "Documents", [("rotate", {"angle": "90"})]),
    ("a.pdf den metin çıkar, klasöre indir", "a.pdf", "Downloads", [("pdf_to_text", {})]),
    ("a.pdf metin tanı ve metin çıkar", "a.pdf", None, [("ocr", {})]),
    ("a.pdf parola ekle", "a.pdf", None, [("encrypt", {"password": "123456"})]),
    ("rapor2.pdf 3 ve 4. sayfayı sil 99999", "rapor2.pdf", None, [("delete_pages", {"pages": "2,3,4"})]),
    ("merhaba", "", None, []),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, s) for i, (s, *_) in enumerate(EXPECTED)] + [(100, ""), (101, None)]
    return {r["cmd_id"]: r for r in commands.parse(spark.createDataFrame(rows, "cmd_id long, raw_text string")).collect()}


@pytest.mark.parametrize("i", range(len(EXPECTED)))
def test_sentence(parsed, i):
    _, file, target, chain = EXPECTED[i]
    r = parsed[i]
    assert (r["input_file"], r["output_target"], [(a["action"], a["kwargs"]) for a in r["action_chain"]]) == (file, target, chain)


def test_nothing_said(parsed):
    assert parsed[100]["raw_text"] is None and parsed[101]["raw_text"] is None


def test_numbers(spark):
    said = [("yirmi beş", "20 5"), ("Üç üç ÜÇ", "3 3 3"), ("onda", "onda"), ("on", "10"), ("iki, bir.", "2, 1.")]
    got = spark.createDataFrame(said, "a string, b string").select(commands.numbers(F.col("a")), "b").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_options(spark):
    df = spark.createDataFrame([(1, "a7.pdf şifrele"), (2, "a7.pdf 3. sayfa sil")], "cmd_id long, raw_text string")
    got = {r["cmd_id"]: r["action_chain"] for r in commands.parse(df, default_password=None, strict_delete=True).collect()}
    assert got[1][0]["kwargs"] == {"password": None} and got[2][0]["kwargs"] == {"pages": "3"}


def test_report_and_execution(spark):
    from pageloom import model

    said = [(1, "a.pdf ilk 2 sayfa kes", 1), (2, "a.pdf 9. sayfa kes", 1), (3, "a.pdf 1. sayfayı sil", 2), (4, "merhaba", 1), (5, "a.pdf", 1), (6, "a.pdf 90 derece döndür", None), (7, "", 1), (8, "a.pdf 2. sayfayı sil, 180 derece döndür, x yazılı filigran", 1), (9, "a.pdf şifrele", 1)]
    df = spark.createDataFrame(said, "cmd_id long, raw_text string, doc_id long")
    intents = commands.parse(df.select("cmd_id", "raw_text"), default_password=None).join(df.select("cmd_id", "doc_id"), "cmd_id")
    pages = model.pages_of_documents(spark.createDataFrame([(1, "a\nb\nc"), (2, "z")], "doc_id long, text string"))
    counts = spark.createDataFrame([(1, 3), (2, 1)], "doc_id long, n_pages int")
    got = {r["cmd_id"]: (r["status"], r["pages_out"]) for r in planner.report(intents, counts).collect()}
    assert got == {1: ("ok", 2), 2: ("end_beyond_last", 0), 3: ("nothing_remains", 0), 4: ("no_file_name", 0), 5: ("no_action", 0), 6: ("file_not_found", 0), 7: ("no_intent", 0), 8: ("ok", 2), 9: ("no_password", 0)}
    made = planner.execute(intents, pages).orderBy("cmd_id", "page_no").collect()
    assert [(r["cmd_id"], r["page_no"], r["body"], r["rotation"]) for r in made] == [(1, 1, "a", 0), (1, 2, "b", 0), (8, 1, "a", 180), (8, 2, "c", 180)]
    assert made[2]["overlays"][0]["text"] == "X"


@pytest.mark.parametrize("name", ["cmd_actions", "cmd_side_outputs", "cmd_file", "cmd_target"])
def test_a_sentence_is_parsed_once(spark, name):
    """No filter over the parsed columns holds the parse once more."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 20 < plan.count("regexp_") < 70
