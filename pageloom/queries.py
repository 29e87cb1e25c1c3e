"""The registered queries: each operator over whole tables, and its equivalent DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .functions import names, spec
from .model import table
from .operators import annotate, batch, images, pages, state
from .plans import commands, planner
from .sources import files, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "TIMESTAMP '2024-03-05 14:07:09'"

DOC_PAGES = "(SELECT doc_id, CAST(unnest(range(1, len(s) + 1)) AS INTEGER) AS page_no, unnest(s) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
LINE_PAGES = "(SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INTEGER) AS page_no, l_returnflag AS body FROM lineitem)"
COUNTS = "(SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_pages FROM documents)"
#: Files derived from orders; both engines run these expressions.
PATH = "concat('/in/', o_orderstatus, '/', CAST(floor(o_orderkey / 100) AS BIGINT), '/Fatura_', o_orderkey % 100, CASE o_orderkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.png' ELSE '.v2.Pdf' END)"
SIZE = "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(floor(o_totalprice * 500) AS BIGINT) END"
N_PAGES = "CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE CAST(o_orderkey % 30 + 1 AS INT) END"
FILES_SQL = f"(SELECT {PATH} AS path, {SIZE} AS size_bytes, {N_PAGES} AS n_pages FROM orders)"
#: Sentences over every document; {} is its number.
SENTENCES = (
    "Masaüstündeki rapor_{}.pdf dosyasını sıkıştır", "Masaüstündeki sunum_{}.pdf dosyasının ilk iki sayfasını kes", "test_{}.pdf dosyasını 2 ile 4 arası kes", "rapor_{}.pdf dosyasına gizli yazılı filigran ekle",
    "belge_{}.pdf dosyasını abc123 ile şifrele", "rapor.pdf dosyasının 3. sayfasını sil ve 180 derece döndür", "sunum_{}.pdf dosyasını 90 derece döndür", "rapor_{}.pdf dosyasını jpg resme dönüştür", "belge_{} nokta pdf yi word formatına dönüştür",
    "tarama_{}.pdf dosyasına ocr yap", "ozet.pdf dosyasının ilk beş sayfasını kes, taslak yazılı filigran ekle ve 270 derece çevir", "rapor_{} dosyasını kompres et ve belgelere kaydet", "dosyayı aç", "merhaba", "test_{}.pdf dosyasından metin çıkar ve klasöre indir", "alt çizgi üç üç üç yirmi beş on", "",
)
RAW_TEXT = f"CASE CAST(doc_id % {len(SENTENCES)} AS INT) " + " ".join(f"WHEN {i} THEN concat(" + ", doc_id, ".join("'" + p.replace("'", "''") + "'" for p in s.split("{}")) + (", ''" if "{}" not in s else "") + ")" for i, s in enumerate(SENTENCES)) + " END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = re.sub(r"\b(\w+) -> ", r"lambda \1: ", sql)
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return model.pages_of_documents(table(spark, d, "documents"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return model.pages_of_lineitem(table(spark, d, "lineitem"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Page counts without exploding pages."""
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n_pages"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.expr(PATH).alias("path"), F.expr(SIZE).alias("size_bytes"), F.expr(N_PAGES).alias("n_pages"))


def _commands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("cmd_id"), F.expr(RAW_TEXT).alias("raw_text"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Commands that have an intent, told before they are parsed: a filter over what is parsed would parse once more."""
    return _commands(spark, d).where("raw_text <> ''")


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    px = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 1) * 127.5))).cast("int"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("img_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), px.alias("px"))


TILES = "(SELECT vec_id AS img_id, list_transform(embedding, v -> CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 1) * 127.5))) AS INTEGER)) AS px FROM embeddings)"


def _join(values: Column | str) -> Column:
    return F.array_join(values, ",")


# --- sources and page algebra ------------------------------------------------------------
@query(f"SELECT doc_id, CAST(count(*) AS INTEGER) AS n_pages FROM {LINE_PAGES} GROUP BY doc_id")
def page_count(spark, d):
    return pages.page_count(_lines(spark, d))


@query(f"SELECT path, suffix FROM {FILES_SQL}, (VALUES ('.pdf'), ('.png'), ('f')) AS e(suffix) WHERE ends_with(lower(path), suffix)")
def dir_listing(spark, d):
    return batch.list_files(_files(spark, d).select("path"), [".pdf", ".png", "F"]).select("path", "suffix")


LISTED = "CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'Downloads' WHEN 1 THEN 'Desktop' WHEN 2 THEN 'Documents' ELSE 'Other' END"
LISTED_NAME = "CASE CAST(floor(c_custkey / 4) AS BIGINT) % 3 WHEN 0 THEN concat('Rapor_', c_custkey % 700, '.pdf') WHEN 1 THEN concat('rapor_', c_custkey % 700, '.PDF') ELSE concat('RAPOR_', c_custkey % 700, '.pdf') END"
ASKED = "concat('rapor_', p_partkey % 900, '.pdf')"


@query(
    f"""WITH l AS (SELECT {LISTED} AS dir, {LISTED_NAME} AS file FROM customer), a AS (SELECT DISTINCT {ASKED} AS name FROM part),
    j AS (SELECT name, dir, file, list_position(['Desktop', 'Documents', 'Downloads'], dir) AS r FROM a LEFT JOIN l ON lower(a.name) = lower(l.file) AND dir <> 'Other')
    SELECT name, CASE WHEN file IS NOT NULL THEN dir || '/' || file END AS found FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY r, file <> name, file) AS k FROM j) WHERE k = 1"""
)
def file_lookup_ci(spark, d):
    listing = table(spark, d, "customer").select(F.expr(LISTED).alias("dir"), F.expr(LISTED_NAME).alias("name"))
    return batch.lookup_files(table(spark, d, "part").select(F.expr(ASKED).alias("name")), listing)


@query(f"SELECT doc_id, CAST(page_no - 1 AS INTEGER) AS page_no, page_no AS src_page, body FROM {LINE_PAGES} WHERE page_no BETWEEN 2 AND 3")
def page_range(spark, d):
    return pages.select_range(_lines(spark, d), 2, 3).select("doc_id", "page_no", "src_page", "body")


@query(f"SELECT doc_id, n_pages, CASE WHEN 4 > n_pages THEN 'end_beyond_last' ELSE 'ok' END AS status FROM {COUNTS}")
def page_range_status(spark, d):
    return pages.range_status(_counts(spark, d), 2, 4)


@query(f"SELECT p.doc_id, CAST(page_no - 1 AS INTEGER) AS page_no, body FROM {DOC_PAGES} p JOIN {COUNTS} c USING (doc_id) WHERE page_no BETWEEN 2 AND 4 AND n_pages >= 4")
def page_range_checked(spark, d):
    return pages.select_range_checked(_docs(spark, d), 2, 4).select("doc_id", "page_no", "body")


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS INTEGER) AS page_no, page_no AS src_page, body FROM {DOC_PAGES} WHERE page_no NOT IN (1, 3, 99999)")
def page_delete(spark, d):
    return pages.delete_pages(_docs(spark, d), [3, 1, 99999, 3]).select("doc_id", "page_no", "src_page", "body")


@query(f"SELECT doc_id, n_pages, CAST(greatest(n_pages - 2, 0) AS INTEGER) AS remaining, CASE WHEN n_pages <= 2 THEN 'nothing_remains' ELSE 'ok' END AS status FROM {COUNTS}")
def page_delete_all_error(spark, d):
    return pages.delete_status(_counts(spark, d), [1, 2])


@query(f"SELECT doc_id, page_no, CASE WHEN page_no IN (1, 3) THEN 90 ELSE 0 END AS rotation FROM {LINE_PAGES}")
def page_rotate(spark, d):
    turned = pages.rotate_pages(pages.rotate_pages(_lines(spark, d), [1, 3], 270), [1, 3], 180)
    return turned.select("doc_id", "page_no", "rotation")


@query(f"SELECT p.doc_id, CAST(i AS INTEGER) AS page_no, page_no AS src_page, body FROM (SELECT unnest([3, 1, 1, 2]) AS n, unnest(range(1, 5)) AS i) o JOIN {DOC_PAGES} p ON p.page_no = o.n JOIN {COUNTS} c ON c.doc_id = p.doc_id WHERE n_pages >= 3")
def page_reorder(spark, d):
    return pages.reorder_pages(_docs(spark, d), "3, 1, 1, 2").select("doc_id", "page_no", "src_page", "body")


@query(
    f"""WITH f AS (SELECT CAST(floor(doc_id / 100) AS BIGINT) AS out_id, row_number() OVER (PARTITION BY floor(doc_id / 100) ORDER BY k, doc_id DESC) AS file_pos, doc_id FROM documents, (VALUES (1), (2)) AS t(k) WHERE k = 1 OR doc_id % 3 = 0)
    SELECT out_id AS doc_id, CAST(row_number() OVER (PARTITION BY out_id ORDER BY file_pos, page_no) AS INTEGER) AS page_no, f.doc_id AS src_doc, page_no AS src_page, body FROM f JOIN {DOC_PAGES} p ON p.doc_id = f.doc_id"""
)
def doc_merge(spark, d):
    """Outputs of a hundred documents each, last first; every third document goes in twice."""
    from pyspark.sql import Window

    twice = table(spark, d, "documents").select("doc_id").withColumn("k", F.explode(F.expr("if(doc_id % 3 = 0, array(1, 2), array(1))")))
    order = Window.partitionBy("out_id").orderBy("k", F.desc("doc_id"))
    plan = twice.withColumn("out_id", F.floor(F.col("doc_id") / 100)).withColumn("file_pos", F.row_number().over(order)).select("out_id", "file_pos", "doc_id")
    return pages.merge_documents(_docs(spark, d), plan).select("doc_id", "page_no", "src_doc", "src_page", "body")


SPEC = "CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN '1, 3-5, 8' WHEN 1 THEN '' WHEN 2 THEN ' , ,2' WHEN 3 THEN '5-3' WHEN 4 THEN '-3' WHEN 5 THEN '2-2,2,1 - 4' WHEN 6 THEN 'x' WHEN 7 THEN '7' WHEN 8 THEN '4,3,2-4' WHEN 9 THEN '1-99' ELSE '1.5' END"
TOTAL = "CAST(o_orderkey % 9 + 1 AS INT)"


@query(
    f"""WITH s AS (SELECT o_orderkey AS spec_id, {SPEC} AS spec, {TOTAL} AS total FROM orders),
    q AS (SELECT *, list_filter(list_transform(string_split(spec, ','), p -> trim(p)), p -> p <> '') AS parts FROM s),
    r AS (SELECT *, list_transform(parts, p -> CASE WHEN contains(p, '-') THEN [CASE WHEN regexp_matches(trim(left(p, instr(p, '-') - 1)), '^[0-9]+$') THEN CAST(trim(left(p, instr(p, '-') - 1)) AS INTEGER) END, CASE WHEN regexp_matches(trim(substr(p, instr(p, '-') + 1)), '^[0-9]+$') THEN CAST(trim(substr(p, instr(p, '-') + 1)) AS INTEGER) END] WHEN regexp_matches(p, '^[0-9]+$') THEN [CAST(p AS INTEGER), CAST(p AS INTEGER)] ELSE [NULL, NULL] END) AS b FROM q),
    t AS (SELECT *, len(list_filter(b, x -> coalesce(x[1] >= 1 AND x[2] <= total AND x[1] <= x[2], FALSE))) = len(b) AS good FROM r)
    SELECT spec_id, CASE WHEN len(parts) = 0 THEN 'empty' WHEN good THEN 'ok' ELSE 'invalid' END AS status, CASE WHEN len(parts) > 0 AND good THEN array_to_string(list_sort(list_distinct(flatten(list_transform(b, x -> range(x[1], x[2] + 1))))), ',') END AS pages FROM t"""
)
def page_spec_parse(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("spec_id"), F.expr(SPEC).alias("spec"), F.expr(TOTAL).alias("total"))
    return s.select("spec_id", spec.page_spec_status(F.col("spec"), F.col("total")).alias("status"), _join(spec.parse_pages(F.col("spec"), F.col("total"))).alias("pages"))


# --- names and sizes ---------------------------------------------------------------------
BASE = "regexp_extract(path, '([^/]*)$', 1)"
_SPLIT = r"regexp_extract(base, '^(.*)(\.[^.]*)$', {})"


@query(
    f"""WITH b AS (SELECT path, {BASE} AS base, o % 50 AS k FROM (SELECT {PATH} AS path, o_orderkey AS o FROM orders))
    SELECT path, {_SPLIT.format(1)} || '_compressed' || {_SPLIT.format(2)} AS compressed, {_SPLIT.format(1)} || '_sayfa_' || k || '-' || (k + 2) || {_SPLIT.format(2)} AS ranged,
    {_SPLIT.format(1)} || CASE CAST(k % 4 AS INT) WHEN 0 THEN '_düzenlenmiş' WHEN 1 THEN '_birleşik' WHEN 2 THEN '_tarandi' ELSE '' END || {_SPLIT.format(2)} AS tool FROM b"""
)
def output_names(spark, d):
    f = table(spark, d, "orders").select(F.expr(PATH).alias("path"), (F.col("o_orderkey") % 50).alias("k"))
    base, tool = names.basename(F.col("path")), F.element_at(F.array(*[F.lit(x) for x in ("edit", "merge", "scan", "other")]), (F.col("k") % 4 + 1).cast("int"))
    return f.select("path", names.compressed_name(base).alias("compressed"), names.range_name(base, F.col("k"), F.col("k") + 2).alias("ranged"), names.tool_name(base, tool).alias("tool"))


@query(f"SELECT doc_id, printf('%.2f', sum(octet_length(encode(body))) / 1048576.0::DOUBLE) AS mb_before, printf('%.2f', coalesce(sum(CASE WHEN page_no > 1 THEN octet_length(encode(body)) END), 0) / 1048576.0::DOUBLE) AS mb_after FROM {DOC_PAGES} GROUP BY doc_id")
def size_report(spark, d):
    p = _docs(spark, d)
    return pages.size_report(p, pages.delete_pages(p, [1]))


@query(f"SELECT path, size_bytes, coalesce(size_bytes > 52428800, FALSE) AS large FROM {FILES_SQL}")
def large_files(spark, d):
    return batch.large_files(_files(spark, d).select("path", "size_bytes"))


@query(f"SELECT doc_id, page_no, printf('sayfa_%03d', page_no) || CASE WHEN page_no % 2 = 0 THEN '.png' ELSE '.jpg' END AS image FROM {DOC_PAGES}")
def page_image_names(spark, d):
    fmt = F.when(F.col("page_no") % 2 == 0, "PNG").otherwise("jpeg")
    return _docs(spark, d).select("doc_id", "page_no", names.image_name(F.col("page_no"), fmt).alias("image"))


@query("SELECT event_id, CAST(least(CAST(trunc(value * 1000 / greatest(user_id * 100 * 0.6::DOUBLE, 1) * 90) AS INTEGER), 90) AS INTEGER) AS percent FROM events")
def progress_estimate(spark, d):
    return table(spark, d, "events").select("event_id", names.compress_progress(F.col("value") * 1000, F.col("user_id") * 100).alias("percent"))


@query("SELECT event_id, CAST(trunc(value / (CASE WHEN user_id % 50 <= 0 THEN 1 ELSE user_id % 50 END)::DOUBLE * 100) AS INTEGER) AS percent, CASE WHEN length(props) >= 40 THEN substr(props, 1, 37) || '...' ELSE props END AS message FROM events")
def progress_percent(spark, d):
    return table(spark, d, "events").select("event_id", names.progress_percent(F.col("value"), F.col("user_id") % 50).alias("percent"), names.short_message(F.col("props")).alias("message"))


_ROUTED = " UNION ALL ".join(f"SELECT path, '{m}' AS mode, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ({', '.join(repr(e) for e in x)}) AS accepted FROM {FILES_SQL}" for m, x in names.ROUTES.items())


@query(_ROUTED)
def ext_route(spark, d):
    modes = F.explode(F.array(*[F.lit(m) for m in names.ROUTES])).alias("mode")
    return _files(spark, d).select("path", modes).withColumn("accepted", names.accepts(F.col("mode"), names.basename(F.col("path"))))


@query(
    """WITH s AS (SELECT p_partkey AS id, CAST(p_size * 37 + 1 AS INTEGER) AS w, CAST(p_size * p_partkey % 997 + 1 AS INTEGER) AS h, CASE p_partkey % 3 WHEN 0 THEN 'A4' WHEN 1 THEN 'Letter' ELSE 'Original' END AS size FROM part),
    r AS (SELECT *, CASE size WHEN 'A4' THEN least(595 / w::DOUBLE, 842 / h::DOUBLE) WHEN 'Letter' THEN least(612 / w::DOUBLE, 792 / h::DOUBLE) END AS k FROM s)
    SELECT id, size, CAST(coalesce(trunc(w * k), w) AS INTEGER) AS w, CAST(coalesce(trunc(h * k), h) AS INTEGER) AS h FROM r"""
)
def fit_to_page(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 37 + 1).cast("int").alias("w"), (F.col("p_size") * F.col("p_partkey") % 997 + 1).cast("int").alias("h"), F.expr("case p_partkey % 3 when 0 then 'A4' when 1 then 'Letter' else 'Original' end").alias("size"))
    fit = names.fit_to_page(F.col("w"), F.col("h"), F.col("size"))
    return s.select("id", "size", fit["w"].alias("w"), fit["h"].alias("h"))


# --- annotation, security, metadata ------------------------------------------------------
@query(f"SELECT doc_id, page_no, 1 AS n, 'text' AS kind, 'TASLAK' AS text, 0.3::DOUBLE AS opacity, 45 AS angle, 60 AS size, 297.5::DOUBLE AS x, 421.0::DOUBLE AS y FROM {LINE_PAGES}")
def overlay_text(spark, d):
    o = annotate.overlay_text(_lines(spark, d), "TASLAK").withColumn("o", F.get("overlays", F.lit(0)))
    return o.select("doc_id", "page_no", F.size("overlays").alias("n"), "o.kind", "o.text", "o.opacity", "o.angle", "o.size", "o.x", "o.y")


@query(f"SELECT doc_id, page_no, CASE WHEN page_no = 2 THEN 'imza.png' END AS image, CASE WHEN page_no = 2 THEN 120.0::DOUBLE END AS w, CASE WHEN page_no = 2 THEN 60.0::DOUBLE END AS h FROM {LINE_PAGES}")
def overlay_stamp(spark, d):
    o = annotate.stamp_image(_lines(spark, d), "imza.png", 2, 30, 40, 400, 200, 1.5).withColumn("o", F.get("overlays", F.lit(0)))
    return o.select("doc_id", "page_no", F.col("o.text").alias("image"), "o.w", "o.h")


@query(f"SELECT doc_id, page_no, body, 'ok' AS status, 'wrong_password' AS other FROM {DOC_PAGES}")
def encrypt_roundtrip(spark, d):
    sealed = annotate.encrypt(_docs(spark, d), "s3cret")
    wrong = annotate.decrypt(sealed.withColumn("kept", F.col("cipher")), "other").withColumnsRenamed({"status": "other", "kept": "cipher"})
    return annotate.decrypt(wrong, "s3cret").select("doc_id", "page_no", "body", "status", "other")


META = "map('Title', concat('Doc ', doc_id), 'Author', source, 'Subject', CASE WHEN doc_id % 2 = 0 THEN lang END, 'Keywords', 'a')"


@query("SELECT doc_id, 'Doc ' || doc_id AS title, coalesce(source, '') AS author, CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, '') ELSE '' END AS subject, '' AS creator, '' AS producer FROM documents")
def metadata_read(spark, d):
    return table(spark, d, "documents").select("doc_id", *annotate.read_metadata(F.expr(META)))


@query("SELECT doc_id, 'Author=|Keywords=a|ModDate=D:20240305140709|Subject=' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE '-' END || '|Title=T' || doc_id AS entries FROM documents")
def metadata_update(spark, d):
    new = annotate.update_metadata(F.expr(META), {"Title": F.concat(F.lit("T"), "doc_id"), "Author": "", "Subject": None}, F.expr(AS_OF))
    shown = F.transform(F.array_sort(F.map_entries(new)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))
    return table(spark, d, "documents").select("doc_id", F.array_join(shown, "|").alias("entries"))


@query(f"SELECT doc_id, string_agg(body, chr(10) || '--- Sayfa Sonu ---' || chr(10) ORDER BY page_no) AS content FROM {DOC_PAGES} WHERE body <> '' GROUP BY doc_id")
def text_export(spark, d):
    return text.export_text(_docs(spark, d))


@query(f"SELECT doc_id, string_agg('--- Sayfa ' || page_no || ' ---' || chr(10) || body, chr(10) ORDER BY page_no) AS content FROM {DOC_PAGES} GROUP BY doc_id")
def ocr_export(spark, d):
    return text.export_ocr(_docs(spark, d))


# --- images -------------------------------------------------------------------------------
def _rotated(angle: int):
    def run(spark, d):
        return images.rotate_tile(_tiles(spark, d), angle).select("img_id", _join("px").alias("px"))

    run.__name__ = f"tile_rotate_{angle}"
    at = {90: "(7 - i % 8) * 8 + i // 8", 180: "63 - i", 270: "(i % 8) * 8 + (7 - i // 8)"}[angle]
    query(f"SELECT img_id, array_to_string(list_transform(range(0, 64), i -> px[CAST({at} AS INTEGER) + 1]), ',') AS px FROM {TILES}")(run)


for _angle in (90, 180, 270):
    _rotated(_angle)


@query(f"SELECT img_id, array_to_string(list_transform(px, p -> CASE WHEN list_max(px) > list_min(px) THEN CAST(floor((p - list_min(px)) * 255 / (list_max(px) - list_min(px))::DOUBLE + 0.5) AS INTEGER) ELSE 0 END), ',') AS px FROM {TILES}")
def tile_normalize(spark, d):
    return images.normalize_tile(_tiles(spark, d)).select("img_id", _join("px").alias("px"))


@query(f"SELECT img_id, array_to_string(list_transform(px, p -> CASE WHEN p > 128 THEN 255 ELSE 0 END), ',') AS px FROM {TILES}")
def tile_threshold(spark, d):
    return images.threshold_tile(_tiles(spark, d)).select("img_id", _join("px").alias("px"))


def _quads(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.get("px", F.lit(i))
    return _tiles(spark, d).select("img_id", F.array(*[F.struct(at(i).alias("x"), at(i + 4).alias("y")) for i in range(4)]).alias("q"), (at(8) + 50).alias("w"), (at(9) + 40).alias("h"))


QUADS = f"(SELECT img_id, unnest([1, 2, 3, 4]) AS i, unnest(px[1:4]) AS x, unnest(px[5:8]) AS y, px[9] + 50 AS w, px[10] + 40 AS h FROM {TILES})"


def _corners(q: Column) -> Column:
    return F.array_join(F.transform(q, lambda p: F.concat(p["x"].cast("string"), F.lit(":"), p["y"].cast("string"))), "|")


@query(f"SELECT img_id, " + " || '|' || ".join(f"first(x || ':' || y ORDER BY {k}, i)" for k in ("x + y", "y - x", "-(x + y)", "-(y - x)")) + f" AS corners FROM {QUADS} GROUP BY img_id")  # noqa: F541
def quad_order(spark, d):
    return _quads(spark, d).select("img_id", _corners(images.order_quad(F.col("q"))).alias("corners"))


@query(f"SELECT img_id, string_agg((h - y) || ':' || x, '|' ORDER BY i) AS right_turn, string_agg(y || ':' || (w - x), '|' ORDER BY i) AS left_turn FROM {QUADS} GROUP BY img_id")
def quad_rotate(spark, d):
    turn = lambda c: _corners(images.rotate_quad(F.col("q"), F.col("w"), F.col("h"), c))
    return _quads(spark, d).select("img_id", turn(True).alias("right_turn"), turn(False).alias("left_turn"))


@query("WITH s AS (SELECT p_partkey AS id, p_size * 41 AS w, p_size * 29 + 7 AS h FROM part), m AS (SELECT *, CAST(trunc(w * 0.05::DOUBLE) AS INTEGER) AS a, CAST(trunc(h * 0.05::DOUBLE) AS INTEGER) AS b FROM s) SELECT id, concat(a, ':', b, '|', w - a, ':', b, '|', w - a, ':', h - b, '|', a, ':', h - b) AS corners FROM m")
def quad_fallback(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 41).alias("w"), (F.col("p_size") * 29 + 7).alias("h"))
    return s.select("id", _corners(images.inset_quad(F.col("w"), F.col("h"))).alias("corners"))


@query(f"SELECT img_id, string_agg(greatest(0, least(x * 2 - 150, w)) || ':' || greatest(0, least(y * 2 - 150, h)), '|' ORDER BY i) AS corners FROM {QUADS} GROUP BY img_id")
def quad_clamp(spark, d):
    far = F.transform("q", lambda p: F.struct((p["x"] * 2 - 150).alias("x"), (p["y"] * 2 - 150).alias("y")))
    return _quads(spark, d).select("img_id", _corners(images.clamp_quad(far, F.col("w"), F.col("h"))).alias("corners"))


@query()
def scan_pipeline(spark, d):
    """Every tile as a photo through warp, rotation and a filter; tested in numpy."""
    photos = _tiles(spark, d).select("img_id", "h", "w", F.lit(1).alias("c"), F.unhex(F.array_join(F.transform("px", lambda p: F.lpad(F.hex(p), 2, "0")), "")).alias("px"), F.lit(90).alias("rotation"))
    return images.scan(photos, "grayscale", (32, 48)).select("img_id", "h", "w", "c", "dpi", F.length("px").alias("n_bytes"), "error")


# --- batch ---------------------------------------------------------------------------------
@query(
    f"""WITH i AS (SELECT *, {BASE} AS base, row_number() OVER (ORDER BY left(path, length(path) - length({BASE})), {BASE}) AS seq FROM {FILES_SQL} WHERE ends_with(lower(path), '.pdf'))
    SELECT count(*) AS total, count(*) FILTER (size_bytes IS NOT NULL) AS success, count(*) FILTER (size_bytes IS NULL) AS errors, coalesce(string_agg(CASE WHEN size_bytes IS NULL THEN base || ': unreadable' END, chr(10) ORDER BY seq), '') AS error_lines FROM i"""
)
def batch_compress_report(spark, d):
    return batch.summary(batch.compress_items(_files(spark, d), "ebook"))


@query(
    f"""WITH f AS (SELECT path, {BASE} AS base, CASE CAST(length(path) % 3 AS INT) WHEN 0 THEN 'pdf2img' WHEN 1 THEN 'img2pdf' ELSE 'other' END AS mode FROM {FILES_SQL}),
    s AS (SELECT *, CASE WHEN mode = 'other' THEN 'unknown_mode' WHEN mode = 'pdf2img' AND ends_with(lower(base), '.pdf') OR mode = 'img2pdf' AND ends_with(lower(base), '.png') THEN 'ok' ELSE 'skipped' END AS status FROM f)
    SELECT path, mode, CASE WHEN status = 'ok' THEN {_SPLIT.format(1)} || CASE mode WHEN 'pdf2img' THEN '/' ELSE '.pdf' END END AS out_name, status FROM s"""
)
def batch_convert_route(spark, d):
    mode = F.element_at(F.array(*[F.lit(x) for x in ("pdf2img", "img2pdf", "other")]), F.length("path") % 3 + 1)
    return batch.convert_items(_files(spark, d), mode)


@query(f"SELECT out_name, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths FROM (SELECT path, 'compressed_' || {BASE} AS out_name FROM {FILES_SQL} WHERE ends_with(lower(path), '.pdf')) GROUP BY out_name HAVING count(*) > 1")
def batch_collisions(spark, d):
    return batch.collisions(batch.compress_items(_files(spark, d), "screen"))


@query(
    f"""WITH i AS (SELECT *, {BASE} AS base, CAST(row_number() OVER (ORDER BY left(path, length(path) - length({BASE})), {BASE}) AS INTEGER) AS seq FROM {FILES_SQL} WHERE ends_with(lower(path), '.pdf'))
    SELECT seq, path, CASE WHEN size_bytes IS NULL OR n_pages IS NULL THEN 'error' ELSE 'ok' END AS status, CASE WHEN size_bytes IS NULL OR n_pages IS NULL THEN NULL ELSE 'A_' || {_SPLIT.format(1)} || '_' || n_pages || 'pp_' || printf('%.1f', size_bytes / 1048576.0::DOUBLE) || 'MB_' || printf('%03d', seq) || '_2024-03-05_q.pdf' END AS out_name FROM i"""
)
def batch_rename(spark, d):
    return batch.rename_items(_files(spark, d), "A:[ORIJINAL_AD]/[SAYFA_SAYISI]_[BOYUT]_[SIRA]_[TARIH]?q", F.expr(AS_OF))


@query()
def parallel_map(spark, d):
    """A Python function over every document; one language fails. Tested against a loop."""
    items = table(spark, d, "documents").select(F.concat("lang", F.lit(":"), "n_chars").alias("item"))
    return batch.parallel_map(items, _length_of)


def _length_of(item: str) -> str:
    lang, n = item.split(":")
    if lang == "fr":
        raise ValueError(f"no {lang}")
    return str(int(n) + 1)


# --- command language ----------------------------------------------------------------------
_W, _B, _E = r"[\p{L}\p{N}_]", r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_NORMAL = r"regexp_replace(regexp_replace(raw_text, '\s*nokta\s*(?:pdf|PDF)\s*', '.pdf', 'g'), '\s*alt\s*çizgi\s*', '_', 'g')"


def _numbered_sql(text_: str) -> str:
    for word, n in commands.NUMBERS:
        for _ in range(2):
            text_ = f"regexp_replace({text_}, '(?i){_B}{word}{_E}', '\\1{n}\\2', 'g')"
    return text_


COMMANDS = f"(SELECT doc_id AS cmd_id, {RAW_TEXT} AS raw_text FROM documents)"
READY = f"(SELECT cmd_id, {_numbered_sql(_NORMAL)} AS t FROM {COMMANDS} WHERE raw_text <> '')"
_FILE = rf"""CASE WHEN regexp_extract(t, '(?i)([\p{{L}}\p{{N}}_-]+\.pdf)', 1) <> '' THEN regexp_extract(t, '(?i)([\p{{L}}\p{{N}}_-]+\.pdf)', 1)
 WHEN regexp_extract(t, '(?i)([{commands.LETTERS}_-]+)\s+dosya', 1) <> '' THEN regexp_extract(t, '(?i)([{commands.LETTERS}_-]+)\s+dosya', 1) || '.pdf'
 WHEN regexp_extract(t, '(?i)([{commands.LETTERS}_-]+)\s+p\s*d\s*f', 1) <> '' THEN regexp_extract(t, '(?i)([{commands.LETTERS}_-]+)\s+p\s*d\s*f', 1) || '.pdf' ELSE '' END"""
for _p in commands.PLACES:
    _FILE = f"trim(regexp_replace({_FILE}, '(?i){_p}', '', 'g'))"
_L = "lower(t)"
_any = lambda *w: "(" + " OR ".join(f"contains({_L}, '{x}')" for x in w) + ")"
_TARGET = rf"CASE WHEN {_any('masaüstü', 'masa üstü', 'desktop')} THEN 'Desktop' WHEN regexp_matches({_L}, 'belge(?:ler)?(?:im)?''?(?:e|ye)\s+(?:kaydet|yükle|at|koy)') THEN 'Documents' WHEN {_any('indir')} AND {_any('klasör', 'kaydet')} THEN 'Downloads' END"
_int = lambda p, g=1: f"CAST(CAST(regexp_extract({_L}, '{p}', {g}) AS BIGINT) AS VARCHAR)"
_has = lambda p: f"regexp_matches({_L}, '{p}')"
_PAIR = r"(\d+)\s*(?:ile|ve|[-–])\s*(\d+)"
_PAGES = rf"list_filter(list_transform(regexp_extract_all({_L}, '(\d+)', 1), n -> TRY_CAST(n AS INTEGER)), n -> n > 0 AND n < 10000)"
_ACTIONS = (
    ("split", _any("kes", "böl"), rf"CASE WHEN {_has(r'ilk\s+\d+')} THEN 'end=' || {_int(r'ilk\s+(\d+)')} || ';start=1' WHEN {_has(_PAIR)} THEN 'end=' || {_int(_PAIR, 2)} || ';start=' || {_int(_PAIR)} WHEN {_has(r'\d+\.?\s*sayfa')} THEN 'end=' || {_int(r'(\d+)\.?\s*sayfa')} || ';start=' || {_int(r'(\d+)\.?\s*sayfa')} ELSE 'end=1;start=1' END"),
    ("watermark", _any("filigran"), rf"'text=' || CASE WHEN regexp_extract(t, '(?i)([{commands.LETTERS}]+)\s+yazılı', 1) <> '' THEN upper(regexp_extract(t, '(?i)([{commands.LETTERS}]+)\s+yazılı', 1)) ELSE 'GİZLİ' END"),
    ("compress", _any("sıkıştır", "küçült", "kompres"), "'quality=ebook'"),
    ("encrypt", _any("şifrele", "parola", "şifre ekle"), rf"'password=' || coalesce(nullif(regexp_extract({_L}, '([a-z0-9]+)\s+(?:ile|şifresiyle|diye)\s+şifre', 1), ''), '123456')"),
    ("delete_pages", f"{_any('sil')} AND {_any('sayfa')} AND len({_PAGES}) > 0", f"'pages=' || array_to_string({_PAGES}, ',')"),
    ("rotate", f"({_any('döndür')} OR ({_any('çevir')} AND NOT {_any('dönüştür')}))", rf"'angle=' || CASE WHEN regexp_extract({_L}, '(\d+)\s*derece', 1) IN ('90', '180', '270') THEN regexp_extract({_L}, '(\d+)\s*derece', 1) ELSE '90' END"),
    ("ocr", _any(*commands.OCR_WORDS), "''"),
    ("pdf_to_image", f"{_any(*commands.IMAGE_WORDS)} AND {_any('dönüştür')}", f"'format=' || CASE WHEN {_any('jpg', 'jpeg')} THEN 'jpg' ELSE 'png' END"),
    ("pdf_to_word", f"{_any(*commands.WORD_WORDS)} AND {_any('dönüştür')}", "''"),
    ("pdf_to_text", f"{_any('metin')} AND {_any('çıkar', 'dönüştür')} AND NOT {_any(*commands.OCR_WORDS)}", "''"),
)
ACTIONS = f"(WITH r AS MATERIALIZED (SELECT * FROM {READY}) " + " UNION ALL ".join(f"SELECT cmd_id, {i} AS ord, '{n}' AS action, {a} AS args FROM r WHERE {c}" for i, (n, c, a) in enumerate(_ACTIONS, 1)) + ")"


@query(f"SELECT cmd_id, {_NORMAL} AS text FROM {COMMANDS}")
def cmd_normalize(spark, d):
    return _commands(spark, d).select("cmd_id", commands.normalize(F.col("raw_text")).alias("text"))


@query(f"SELECT cmd_id, {_numbered_sql('raw_text')} AS text FROM {COMMANDS}")
def cmd_numbers(spark, d):
    return _commands(spark, d).select("cmd_id", commands.numbers(F.col("raw_text")).alias("text"))


@query(f"SELECT cmd_id, {_FILE} AS input_file FROM {READY}")
def cmd_file(spark, d):
    return commands.parse(_sentences(spark, d)).select("cmd_id", "input_file")


@query(f"SELECT cmd_id, {_TARGET} AS output_target FROM {READY}")
def cmd_target(spark, d):
    return commands.parse(_sentences(spark, d)).select("cmd_id", "output_target")


@query(f"SELECT cmd_id, ord, action, args FROM {ACTIONS}")
def cmd_actions(spark, d):
    return planner.steps(commands.parse(_sentences(spark, d)), "cmd_id").select("cmd_id", "a.ord", "a.action", commands.kwargs_text(F.col("a.kwargs")).alias("args"))


INTENTS = f"(SELECT r.cmd_id, {_FILE} AS input_file, {_TARGET} AS output_target, coalesce(c.chain, '') AS chain, t AS raw_text FROM {READY} r LEFT JOIN (SELECT cmd_id, string_agg(action || '(' || args || ')', '|' ORDER BY ord) AS chain FROM {ACTIONS} GROUP BY cmd_id) c ON c.cmd_id = r.cmd_id)"


@query(f"SELECT c.cmd_id, input_file, output_target, chain, i.raw_text FROM {COMMANDS} c LEFT JOIN {INTENTS} i ON i.cmd_id = c.cmd_id")
def cmd_intent(spark, d):
    chain = F.array_join(F.transform("action_chain", lambda a: F.concat(a["action"], F.lit("("), commands.kwargs_text(a["kwargs"]), F.lit(")"))), "|")
    there = F.col("raw_text").isNotNull()
    got = commands.parse(_commands(spark, d)).select("cmd_id", F.when(there, F.col("input_file")).alias("input_file"), "output_target", F.when(there, chain).alias("chain"), "raw_text")
    return got


def intents_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """A command for each document, on that document."""
    return commands.parse(_commands(spark, d)).withColumn("doc_id", F.col("cmd_id"))


_SPLIT_ARG = lambda k: rf"TRY_CAST(regexp_extract(s.args, '{k}=(\d+)', 1) AS INTEGER)"
_CASES = lambda m, c: f"CASE {c} " + " ".join("WHEN '{}' THEN '{}'".format(a, b.replace("'", "''")) for a, b in m.items())


@query(
    f"""WITH a AS MATERIALIZED (SELECT * FROM {ACTIONS}), c AS (SELECT doc_id AS cmd_id, doc_id FROM documents),
    b AS (SELECT c.cmd_id, c.doc_id, i.cmd_id IS NULL AS empty, {_FILE.replace("(t,", "(i.t,")} AS input_file, {_TARGET.replace("(t)", "(i.t)")} AS target, n.n_pages, {_SPLIT_ARG("start")} AS s, {_SPLIT_ARG("end")} AS e, g.args AS gone
      FROM c LEFT JOIN {READY} i ON i.cmd_id = c.cmd_id LEFT JOIN {COUNTS} n ON n.doc_id = c.doc_id LEFT JOIN a s ON s.cmd_id = c.cmd_id AND s.action = 'split' LEFT JOIN a g ON g.cmd_id = c.cmd_id AND g.action = 'delete_pages'),
    k AS (SELECT *, CASE WHEN s IS NULL THEN n_pages ELSE e - s + 1 END AS kept FROM b),
    l AS (SELECT *, kept - CASE WHEN gone IS NULL THEN 0 ELSE len(list_filter(list_distinct(list_transform(string_split(substr(gone, 7), ','), x -> CAST(x AS INTEGER))), x -> x >= 1 AND x <= kept)) END AS rest FROM k),
    names AS (SELECT cmd_id, string_agg({_CASES(planner.ACTION_NAMES, "action")} END, ', ' ORDER BY ord) AS said FROM a GROUP BY cmd_id),
    z AS (SELECT l.*, said, CASE WHEN empty THEN 'no_intent' WHEN input_file = '' THEN 'no_file_name' WHEN n_pages IS NULL THEN 'file_not_found' WHEN said IS NULL THEN 'no_action' WHEN s < 1 THEN 'start_below_1' WHEN e > n_pages THEN 'end_beyond_last' WHEN s > e THEN 'start_after_end' WHEN rest <= 0 THEN 'nothing_remains' ELSE 'ok' END AS status FROM l LEFT JOIN names USING (cmd_id))
    SELECT cmd_id, doc_id, coalesce(n_pages, 0) AS pages_in, CAST(CASE WHEN status = 'ok' THEN rest ELSE 0 END AS INTEGER) AS pages_out, status, CASE WHEN status = 'ok' THEN said || ': tamam, ' || {_CASES(planner.TARGET_NAMES, "target")} ELSE 'bulunduğu klasöre' END ELSE status END AS message FROM z"""
)
def cmd_chain(spark, d):
    return planner.report(intents_of_documents(spark, d), _counts(spark, d))


_EXECUTED = f"""WITH a AS MATERIALIZED (SELECT * FROM {ACTIONS}), n AS (SELECT {COUNTS[1:-1].replace("SELECT ", "", 1).replace(" FROM documents", "")} FROM documents),
    q AS (SELECT n.doc_id, n_pages, (SELECT {_SPLIT_ARG("start")} FROM a s WHERE s.cmd_id = n.doc_id AND action = 'split') AS s, (SELECT {_SPLIT_ARG("end")} FROM a s WHERE s.cmd_id = n.doc_id AND action = 'split') AS e,
      (SELECT list_distinct(list_transform(string_split(substr(args, 7), ','), x -> CAST(x AS INTEGER))) FROM a g WHERE g.cmd_id = n.doc_id AND action = 'delete_pages') AS gone, (SELECT CAST(substr(args, 7) AS INTEGER) FROM a r WHERE r.cmd_id = n.doc_id AND action = 'rotate') AS angle,
      (SELECT substr(args, 6) FROM a w WHERE w.cmd_id = n.doc_id AND action = 'watermark') AS mark, (SELECT count(*) > 0 FROM a w WHERE w.cmd_id = n.doc_id AND action = 'encrypt') AS encrypted, (SELECT count(*) FROM a w WHERE w.cmd_id = n.doc_id) AS steps FROM n),
    f AS (SELECT cmd_id FROM (SELECT cmd_id, {_FILE} AS file FROM {READY}) WHERE file <> ''),
    v AS (SELECT q.* FROM q JOIN f ON f.cmd_id = q.doc_id WHERE steps > 0 AND (s IS NULL OR s >= 1 AND e <= n_pages AND s <= e)),
    p AS (SELECT v.*, body, page_no AS src_page, page_no - coalesce(s - 1, 0) AS p FROM v JOIN {DOC_PAGES} d ON d.doc_id = v.doc_id WHERE s IS NULL OR page_no BETWEEN s AND e)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) AS INTEGER) AS page_no, src_page, coalesce(angle, 0) AS rotation, mark, encrypted, body FROM p WHERE gone IS NULL OR NOT list_contains(gone, p)"""


@query(_EXECUTED.replace("encrypted, body FROM p", "encrypted, CASE WHEN NOT encrypted THEN body END AS body FROM p"))
def cmd_execute(spark, d):
    """Every document's command carried out on its pages; encrypted pages have no body."""
    done = planner.execute(intents_of_documents(spark, d), _docs(spark, d), _counts(spark, d))
    return done.select("doc_id", "page_no", "src_page", "rotation", F.get("overlays", F.lit(0))["text"].alias("mark"), "encrypted", "body")


@query(_EXECUTED)
def cmd_execute_decrypt(spark, d):
    """The same, encrypted pages opened again with their command's password."""
    intents = intents_of_documents(spark, d)
    done = planner.execute(intents, _docs(spark, d), _counts(spark, d))
    opened = annotate.unseal(F.col("cipher"), F.col("_password"))
    joined = done.join(planner.with_arguments(intents).select("cmd_id", "_password"), "cmd_id")
    return joined.select("doc_id", "page_no", "src_page", "rotation", F.get("overlays", F.lit(0))["text"].alias("mark"), "encrypted", F.when(F.col("encrypted"), opened).otherwise(F.col("body")).alias("body"))


@query(f"SELECT a.cmd_id, action, regexp_replace(input_file, '\\.[^.]*$', '') || CASE action WHEN 'ocr' THEN '_ocr.txt' WHEN 'pdf_to_image' THEN '_resimler/' WHEN 'pdf_to_word' THEN '.docx' ELSE '.txt' END AS out_name FROM {ACTIONS} a JOIN {INTENTS} i ON i.cmd_id = a.cmd_id WHERE ord >= 7")
def cmd_side_outputs(spark, d):
    return planner.side_outputs(commands.parse(_sentences(spark, d)))


# --- state ---------------------------------------------------------------------------------
@query("SELECT user_id, CAST(pos AS INTEGER) AS pos, path FROM (SELECT user_id, path, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, path) AS pos FROM (SELECT user_id, event_type || '_' || CAST(event_id % 9 AS VARCHAR) || '.pdf' AS path, max(ts) AS t FROM events GROUP BY ALL)) WHERE pos <= 10")
def recent_files(spark, d):
    opened = table(spark, d, "events").select("user_id", F.concat("event_type", F.lit("_"), (F.col("event_id") % 9).cast("string"), F.lit(".pdf")).alias("path"), F.col("ts").alias("at"))
    return state.recent_files(opened)


CATALOGUE = [("tr", "greeting", "Merhaba"), ("en", "greeting", "Hello"), ("en", "done", "Done"), ("tr", "done", "Bitti"), ("tr", "only_tr", "Yalnız"), ("en", "pages", "{n} pages")]
_LANG = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'tr' WHEN 1 THEN 'en' WHEN 2 THEN lang ELSE NULL END"
_KEY = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'greeting' WHEN 1 THEN 'done' WHEN 2 THEN 'only_tr' WHEN 3 THEN 'pages' ELSE 'missing_key' END"


@query(f"WITH c(lang, key, template) AS (VALUES {', '.join(map(str, CATALOGUE))}), r AS (SELECT doc_id, {_LANG} AS lang, {_KEY} AS key FROM documents) SELECT doc_id, r.lang, r.key, coalesce(template, r.key) AS text FROM r LEFT JOIN c ON c.key = r.key AND c.lang = CASE WHEN r.lang IN ('tr', 'en') THEN r.lang ELSE 'en' END")
def translate(spark, d):
    asked = table(spark, d, "documents").select("doc_id", F.expr(_LANG).alias("lang"), F.expr(_KEY).alias("key"))
    return state.translate(asked, spark.createDataFrame(CATALOGUE, "lang string, key string, template string"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'tr' ELSE 'en' END AS language, CASE WHEN event_id % 3 = 1 THEN 'dark' ELSE 'light' END AS theme, event_id % 3 <> 1 AS sounds FROM events")
def config_read(spark, d):
    given = F.expr("""case event_id % 3 when 0 then '{"language": "tr", "other": 1}' when 1 then '{"theme": "dark", "sounds": false}' else 'not json' end""")
    c = state.read_config(given)
    return table(spark, d, "events").select("event_id", c["language"].alias("language"), c["theme"].alias("theme"), c["sounds"].alias("sounds"))


@query(f"SELECT doc_id, {COUNTS[1:-1].split('AS n_pages')[0].split('doc_id, ')[1]} AS n_pages, source || '_' || doc_id || '.pdf' AS name, round(octet_length(encode(text)) / 1048576.0::DOUBLE, 4) AS size_mb FROM documents")
def preview_facts(spark, d):
    return files.preview_facts(table(spark, d, "documents").select("doc_id", F.concat(F.lit("/d/"), "source", F.lit("_"), "doc_id", F.lit(".pdf")).alias("path"), F.size(F.split("text", "\n")).alias("n_pages"), F.octet_length("text").alias("size_bytes")))


# --- smaller pieces: orders, lists, canvas, resolutions, drops, reports, settings -----------
ORDER = "CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN '5, 3, 1' WHEN 1 THEN '2,2' WHEN 2 THEN '' WHEN 3 THEN '1,,2' WHEN 4 THEN '1-2' WHEN 5 THEN ' 4 ' ELSE 'x' END"


@query(f"WITH s AS (SELECT o_orderkey AS spec_id, list_transform(string_split({ORDER}, ','), p -> trim(p)) AS parts FROM orders) SELECT spec_id, CASE WHEN len(list_filter(parts, p -> NOT regexp_matches(p, '^[0-9]+$'))) = 0 THEN array_to_string(parts, ',') END AS pages FROM s")
def page_order_parse(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("spec_id"), _join(spec.parse_order(F.expr(ORDER))).alias("pages"))


@query(f"SELECT doc_id, n_pages, CASE WHEN n_pages >= 3 THEN 'ok' ELSE 'page_out_of_range' END AS status FROM {COUNTS}")
def stamp_status(spark, d):
    return annotate.stamp_status(_counts(spark, d), 3)


_ITEMS = "string_split(text, ' ')"


@query(
    f"""WITH s AS (SELECT doc_id, {_ITEMS} AS x FROM documents)
    SELECT doc_id, array_to_string(CASE WHEN len(x) >= 3 THEN list_concat([x[1], x[3], x[2]], x[4:]) ELSE x END, ' ') AS moved, array_to_string(x, ' ') AS kept, array_to_string(x[2:2] || x[4:], ' ') AS removed FROM s"""
)
def list_edit(spark, d):
    x = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", F.array_join(state.move_item(x, 1, 1), " ").alias("moved"), F.array_join(state.move_item(x, 0, -1), " ").alias("kept"), F.array_join(state.remove_items(x, [0, 2]), " ").alias("removed"))


@query("WITH s AS (SELECT p_partkey AS id, p_size * 64 AS w, p_size * 32 AS h FROM part), k AS (SELECT *, least(640 / w::DOUBLE, 480 / h::DOUBLE) AS scale FROM s) SELECT id, scale, (640 - w * scale) / 2 AS dx, (480 - h * scale) / 2 AS dy, (100 - (640 - w * scale) / 2) / scale AS x, (200 - (480 - h * scale) / 2) / scale AS y FROM k")
def canvas_fit(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), images.canvas_fit(F.col("p_size") * 64, F.col("p_size") * 32, F.lit(640), F.lit(480)).alias("f"))
    back = images.canvas_to_image(F.lit(100), F.lit(200), F.col("f"))
    return s.select("id", "f.scale", "f.dx", "f.dy", back["x"].alias("x"), back["y"].alias("y"))


@query("SELECT p_partkey AS id, round(greatest(p_size * 41 / (210 / 25.4::DOUBLE), (p_size * 29 + 7) / (297 / 25.4::DOUBLE)), 6) AS dpi FROM part")
def scan_resolution(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(names.scan_resolution(F.col("p_size") * 41, F.col("p_size") * 29 + 7), 6).alias("dpi"))


@query(
    f"""SELECT o_orderkey AS id, mode, CASE WHEN lower(regexp_extract({PATH}, '(\\.[^./]*)$', 1)) IN ({", ".join(repr(e) for m, x in names.ROUTES.items() for e in x if m == "pdf_to_image")}) AND mode = 'pdf_to_image' THEN {PATH} END AS taken
    FROM orders, (VALUES ('pdf_to_image'), ('unknown')) AS t(mode)"""
)
def drop_route(spark, d):
    from .sources import files

    dropped = F.array(F.expr(PATH), F.lit("/in/second.pdf"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(PATH), dropped.alias("dropped"), F.explode(F.array(F.lit("pdf_to_image"), F.lit("unknown"))).alias("mode"))
    return asked.select("id", "mode", files.route_dropped(F.col("dropped"), F.col("mode")).alias("taken"))


@query(
    f"""WITH r AS ({ORACLE_SQL["batch_compress_report"]})
    SELECT concat_ws(chr(10), 'Batch', 'Date: 2024-03-05 14:07:09', repeat('=', 50), 'Total: ' || total, 'Successful: ' || success, 'Failed: ' || errors, repeat('=', 50), CASE WHEN errors > 0 THEN 'Errors:' || chr(10) || '- ' || replace(error_lines, chr(10), chr(10) || '- ') ELSE 'No errors.' END) AS report FROM r WHERE total > 0"""
)
def batch_report(spark, d):
    return batch.report_text(batch_compress_report(spark, d), "Batch", F.expr(AS_OF))


@query("""SELECT event_id, '{"language":"' || CASE WHEN event_id % 2 = 0 THEN 'tr' ELSE 'en' END || '","theme":"light","sounds":true,"recent_files":["' || event_type || '.pdf","a.pdf"]}' AS config FROM events""")
def config_write(spark, d):
    c = state.read_config(F.expr("""if(event_id % 2 = 0, '{"language": "tr"}', '{}')"""))
    recent = state.push_recent(F.array(F.lit("a.pdf"), F.concat("event_type", F.lit(".pdf"))), F.concat("event_type", F.lit(".pdf")))
    return table(spark, d, "events").select("event_id", state.write_config(F.struct(c["language"].alias("language"), c["theme"].alias("theme"), c["sounds"].alias("sounds"), recent.alias("recent_files"))).alias("config"))


@query(f"SELECT img_id, array_to_string(list_transform(px, p -> CAST(floor((p * 100 + 255 * (255 - 100)) / 255::DOUBLE + 0.5) AS INTEGER)), ',') AS px FROM {TILES}")
def alpha_flatten(spark, d):
    return images.blend_on_white(_tiles(spark, d).withColumn("alpha", F.transform("px", lambda _: F.lit(100)))).select("img_id", _join("px").alias("px"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Parse a command for each document, carry it out on the pages, and report per document."""
    intents = intents_of_documents(spark, d)
    done = planner.execute(intents, _docs(spark, d)).groupBy("cmd_id").agg(F.count("*").cast("int").alias("pages_made"))
    return planner.report(intents, _counts(spark, d)).join(done, "cmd_id", "left").withColumn("pages_made", F.coalesce("pages_made", F.lit(0)))
