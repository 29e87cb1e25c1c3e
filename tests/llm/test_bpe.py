import base64

import numpy as np
import pytest
import tiktoken
from cases import D1, ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import bpe
from pageloom.llm._spark import table


@pytest.fixture(scope="module")
def whole():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines()) if a}
    return tiktoken.Encoding("whole", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tool():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.Codec(f.read(), leaf=8)


PARTS = st.sampled_from(["a", "the", " ", "  ", "\n", "\r\n", "\t", "'s", "'ll", "12", "é", "中文", "\U0001f600", "!?", "\x1c", "\x85", " ", "　", "​", "﻿", "<|endoftext|>", "x" * 30, " " * 40])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(PARTS, max_size=60).map("".join), st.text(max_size=200)))
def test_tree_equals_whole(tool, whole, text):
    ids = tool.encode(text)
    assert ids.tolist() == whole.encode(text, disallowed_special=())
    assert tool.decode(ids) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(PARTS, max_size=20).map("".join), st.lists(PARTS, max_size=20).map("".join), st.lists(PARTS, max_size=20).map("".join))
def test_join_is_associative(tool, a, b, c):
    e = tool.encode
    left = tool.join(a + b, tool.join(a, e(a), b, e(b)), c, e(c))
    right = tool.join(a, e(a), b + c, tool.join(b, e(b), c, e(c)))
    assert left.tolist() == right.tolist()


def test_documents_equal_whole(spark, whole):
    docs = table(spark, D1, "documents")
    got = {r["doc_id"]: r for r in bpe.apply(docs).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["tokens"] == whole.encode(r["text"], disallowed_special=())
        assert got[r["doc_id"]]["text"] == r["text"] and got[r["doc_id"]]["round_trip"] and got[r["doc_id"]]["n_tokens"] == len(got[r["doc_id"]]["tokens"])


def test_odd_rows(odd, nothing):
    got = bpe.apply(odd)
    rows = got.collect()
    assert len(rows) == len(ODD) and set(odd.columns) == set(got.columns)
    for r in rows:
        if r["text"] is None:
            assert r["tokens"] is None and r["n_tokens"] is None and r["round_trip"] is None
        else:
            assert r["round_trip"] and r["n_tokens"] == len(r["tokens"])
    assert [r["tokens"] for r in rows if r["text"] == ""] == [[]]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((d or 0, t or "") for d, t, *_ in ODD)
    assert bpe.apply(nothing).count() == 0


def test_a_lone_surrogate_free_byte_soup(tool):
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(0, 256, 5000, np.uint8)).decode("utf-8", "replace")
    assert tool.decode(tool.encode(text)) == text
