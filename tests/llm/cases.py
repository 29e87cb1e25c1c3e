import pytest
from pyspark.sql import types as T

D1, D2, D3 = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"

#: Names that the operators use inside; a table may have columns so named.
CLASH = ("bucket", "n", "payload", "kind", "a", "b", "root", "line", "line_no", "win", "item_id", "place", "slots", "found", "anchor", "first", "count", "grams", "doc", "agree", "score", "keep", "words", "seq", "ord", "license", "tokens", "n_tokens", "round_trip", "_dropped_lines", "_row", "_at", "_s", "_id", "_o", "with space")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WIDE = T.StructType([*DOCS.fields, *(T.StructField(c, T.StringType()) for c in CLASH)])


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) pairs or whole rows."""

    def run(rows, wide=False):
        full = [r if len(r) == 5 else row(*r) for r in rows]
        if wide:
            return spark.createDataFrame([(*r, *CLASH) for r in full], WIDE)
        return spark.createDataFrame(full, DOCS)

    return run


LONG = " ".join(f"word{i % 997}x{i % 89}" for i in range(40_000))
#: Nulls everywhere, empty and blank texts, one long text, repeated rows, control signs, no spaces.
ODD = [
    (1, "A plain text of a few words, nothing else to see."), (2, None), (3, ""), (4, " \n\t \n"), (None, "A plain text of a few words, nothing else to see."), (None, None), (5, LONG), (6, "x" * 50_000), (7, "\x00\x1c   ퟿ \U0001f600"),
    (8, "twice the same row"), (8, "twice the same row"), (9, "line one\r\nline two\r\n\r\nline one"), (10, "é" * 3000 + " " + "İstanbul"), (11, "A plain text of a few words, nothing else to see.", None, None, None), (12, "!!! ... ???"),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD, wide=True)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
