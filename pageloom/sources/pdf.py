"""PDF files as a Spark data source, with the standard library only.

``spark.dataSource.register(PdfPages)`` gives ``format("pdfpages")`` for reading
(one row per page, text by the page's text operators) and writing (one file per
document). Encrypted files, exotic filters and fonts with codes of their own
aren't decoded: such a page has a null body.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, page_no int, body string, rotation int, w double, h double"
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_REF = rb"(\d+)\s+\d+\s+R"


def make_pdf(pages: list[tuple[str, int, float, float]]) -> bytes:
    """A PDF of text pages ``(body, rotation, w, h)``; text is stored as UTF-16 strings."""
    objects: list[bytes] = [b"<</Type/Catalog/Pages 2 0 R>>", b"", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"]
    kids = []
    for body, rotation, w, h in pages:
        lines = "\n".join(f"<FEFF{line.encode('utf-16-be').hex().upper()}> Tj T*" for line in (body or "").split("\n"))
        stream = zlib.compress(f"BT /F1 10 Tf 12 TL 36 {h - 48:.0f} Td\n{lines}\nET".encode())
        kids.append(len(objects) + 1)
        objects.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 {w:g} {h:g}]/Rotate {rotation}/Contents {len(objects) + 2} 0 R/Resources<</Font<</F1 3 0 R>>>>>>".encode())
        objects.append(b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(stream), stream))
    objects[1] = f"<</Type/Pages/Count {len(kids)}/Kids[{' '.join(f'{k} 0 R' for k in kids)}]>>".encode()
    out, offsets = bytearray(b"%PDF-1.5\n"), []
    for i, body in enumerate(objects, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % o for o in offsets)
    out += b"xref\n0 %d\n0000000000 65535 f \n%strailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table, len(objects) + 1, len(out))
    return bytes(out)


def _stream(body: bytes) -> bytes | None:
    m = re.search(rb"stream\r?\n(.*)endstream", body, re.S)
    if not m:
        return None
    head, data = body[: m.start()], m.group(1)
    if b"FlateDecode" in head:
        try:
            return zlib.decompressobj().decompress(data)
        except zlib.error:
            return None
    return None if b"/Filter" in head else data


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m.group(1)): m.group(2) for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body and (inner := _stream(body)) is not None:
            n, first = (int(re.search(k + rb"\s+(\d+)", body).group(1)) for k in (rb"/N", rb"/First"))
            heads = list(map(int, inner[:first].split()[: 2 * n]))
            spots = heads[1::2] + [len(inner) - first]
            for number, a, b in zip(heads[::2], spots, spots[1:]):
                found.setdefault(number, inner[first + a : first + b])
    return found


_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[^\s\[\]()<>]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1].isdigit() else _ESCAPES.get(m.group(1), m.group(1)), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def page_text(content: bytes) -> str:
    """What the text operators of a content stream show, a new line for each move to the next."""
    out, line, strings, fresh = [], [], [], True
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<":
            strings.append(_string(token))
            continue
        if token in (b"T*", b"Td", b"TD", b"Tm", b"'", b'"') and not (fresh and token in (b"Td", b"TD", b"Tm")):
            if token in (b"T*", b"'", b'"') or line:
                out.append("".join(line))
                line = []
        if token in (b"Tj", b"TJ", b"'", b'"'):
            line += strings
            fresh = False
        if token not in (b"[", b"]") and not re.fullmatch(rb"[-+.\d]+", token):
            strings = []
    if line:
        out.append("".join(line))
    return "\n".join(out)


def read_pdf(data: bytes) -> list[tuple[str | None, int, float, float]]:
    """Pages of a PDF as ``(body, rotation, w, h)``."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    objects = _objects(data)
    root = next((n for n, o in objects.items() if re.search(rb"/Type\s*/Pages\b", o) and not re.search(rb"/Parent\b", o)), None)
    pages: list[tuple[str | None, int, float, float]] = []

    def visit(number: int, box: tuple[float, float], turn: int, depth: int) -> None:
        body = objects.get(number, b"")
        if m := re.search(rb"/MediaBox\s*\[([^\]]*)\]", body):
            x0, y0, x1, y1 = map(float, m.group(1).split())
            box = (x1 - x0, y1 - y0)
        if m := re.search(rb"/Rotate\s+(-?\d+)", body):
            turn = int(m.group(1)) % 360
        if depth < 64 and (kids := re.search(rb"/Kids\s*\[([^\]]*)\]", body)):
            for k in re.findall(_REF, kids.group(1)):
                visit(int(k), box, turn, depth + 1)
            return
        m = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|" + _REF + rb")", body)
        streams = [_stream(objects.get(int(k), b"")) for k in (re.findall(_REF, m.group(1)) if m.group(1) is not None else [m.group(2)])] if m else []
        text = None if any(s is None for s in streams) else page_text(b"\n".join(streams))
        pages.append((text, turn, *box))

    if root is not None:
        visit(root, (595.0, 842.0), 0, 0)
    return pages


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.root = path

    def partitions(self):
        if os.path.isfile(self.root):
            return [_File(self.root)]
        found = (os.path.join(top, f) for top, _, files in os.walk(self.root) for f in files if f.lower().endswith(".pdf"))
        return [_File(p) for p in sorted(found)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            pages = read_pdf(f.read())
        for number, page in enumerate(pages, 1):
            yield (partition.path, number, *page)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    """Rows clustered by path; files appear under their names when the job commits."""

    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator):
        os.makedirs(self.root, exist_ok=True)
        made, name, pages = [], None, []

        def close() -> None:
            if name is not None:
                temporary = os.path.join(self.root, f".{uuid.uuid4().hex}.tmp")
                with open(temporary, "wb") as f:
                    f.write(make_pdf(pages))
                made.append((temporary, os.path.join(self.root, os.path.basename(name))))

        for r in rows:
            if r.path != name:
                close()
                name, pages = r.path, []
            pages.append((r.body, r.rotation or 0, r.w or 595.0, r.h or 842.0))
        close()
        return _Written(made)

    def commit(self, messages):
        for m in messages:
            for temporary, final in m.files if m else []:
                os.replace(temporary, final)

    def abort(self, messages):
        for m in messages:
            for temporary, _ in m.files if m else []:
                if os.path.exists(temporary):
                    os.remove(temporary)


class PdfPages(DataSource):
    """``path`` is a file or a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "pdfpages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"].removeprefix("file://"))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"].removeprefix("file://"))


def write_pdfs(pages: DataFrame, folder: str) -> None:
    """One ``doc_<id>.pdf`` for each document of doc_pages."""
    from pyspark.sql import functions as F

    pages.sparkSession.dataSource.register(PdfPages)
    named = pages.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), "page_no", "body", "rotation", "w", "h")
    named.repartition("path").sortWithinPartitions("path", "page_no").write.format("pdfpages").mode("append").save(folder)
