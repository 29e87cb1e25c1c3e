"""Operator 4: byte-level BPE encoding and decoding as a monoid tree reduction.

A long text is halved until it is a leaf; leaves are encoded on their own and
neighbours are joined by re-encoding a window about the boundary. The window
grows until both its ends lie between a non-space and a space. No piece of the
pre-tokenising pattern holds a space after a non-space, so such a place ends a
piece whatever stands on either side: tokens outside the window can't change,
and the join equals the encoding of the whole. Join is associative, so any tree
gives the same tokens. Decoding concatenates bytes up the tree.

Merge ranks are read once on the driver and broadcast (a vocabulary of fixed
size); nothing is shuffled.

Defined results: a null text has null tokens and counts; an empty text has no
tokens; text that looks like a special token is ordinary text; a text without
any space is one window, encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._spark import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 2048
_CACHE: dict[bytes, Codec] = {}


class Codec:
    """Encodes and decodes by tree reduction over a leaf encoder."""

    def __init__(self, ranks: bytes, leaf: int = LEAF):
        import tiktoken

        merge = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self._leaf = leaf
        self._tool = tiktoken.Encoding("loaded", pat_str=PATTERN, mergeable_ranks=merge, special_tokens={})
        self._bytes = np.zeros(max(merge.values()) + 1, np.int64)
        for token, rank in merge.items():
            self._bytes[rank] = len(token)

    def _encode_leaf(self, text: str) -> np.ndarray:
        return np.asarray(self._tool.encode_to_numpy(text, disallowed_special=()), np.int32)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self._leaf:
            return self._encode_leaf(text)
        at = len(text) // 2
        return self.join(text[:at], self.encode(text[:at]), text[at:], self.encode(text[at:]))

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """The encoding of ``left + right`` from those of both."""
        i, j = _last_break(left), _first_break(right)
        head, tail = left[i:], right[:j]
        return np.concatenate([left_ids[: len(left_ids) - self._tokens_in(left_ids[::-1], head)], self._encode_leaf(head + tail), right_ids[self._tokens_in(right_ids, tail) :]])

    def _tokens_in(self, ids: np.ndarray, text: str) -> int:
        size = len(text.encode())
        if not size:
            return 0
        return int(np.searchsorted(np.cumsum(self._bytes[ids[:size]]), size)) + 1

    def decode(self, ids: np.ndarray) -> str:
        return self._decode(ids).decode()

    def _decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self._leaf:
            return self._tool.decode_bytes(ids.tolist())
        at = len(ids) // 2
        return self._decode(ids[:at]) + self._decode(ids[at:])


def _last_break(text: str) -> int:
    """The last place between a non-space and a space, 0 if there is none; looks at a window that doubles."""
    size = 32
    while True:
        low = max(0, len(text) - size)
        for i in range(len(text) - 1, low, -1):
            if text[i].isspace() and not text[i - 1].isspace() and text[i] in _SPACES and text[i - 1] not in _DOUBTFUL:
                return i
        if not low:
            return 0
        size *= 2


def _first_break(text: str) -> int:
    for i in range(1, len(text)):
        if text[i] in _SPACES and not text[i - 1].isspace() and text[i - 1] not in _DOUBTFUL:
            return i
    return len(text)


#: Spaces in every definition, and characters that only some definitions call a space.
_SPACES = frozenset(" \n\t\r")
_DOUBTFUL = frozenset("\x1c\x1d\x1e\x1f\x85᠎​﻿")


def codec(ranks: bytes) -> Codec:
    """One codec per worker and vocabulary."""
    if ranks not in _CACHE:
        _CACHE[ranks] = Codec(ranks)
    return _CACHE[ranks]


def apply(docs: DataFrame, vocabulary: str = VOCABULARY, text_back: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``tokens`` and ``round_trip`` (replacing columns so named); ``text`` becomes the decoded text."""
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    made = ("n_tokens", "tokens", "round_trip")
    kept = [c for c in docs.columns if c not in made]
    out = [c for c in kept if text_back or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(sent.value)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                texts = batch.column(kept.index("text")).to_pylist()
                ids = [None if t is None else tool.encode(t) for t in texts]
                back = [None if x is None else tool.decode(x) for x in ids]
                null = np.array([x is None for x in ids])
                count = np.array([0 if x is None else len(x) for x in ids], np.int32)
                offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32), mask=np.append(null, False))
                flat = np.concatenate([np.zeros(0, np.int32), *[x for x in ids if x is not None]])
                columns = [pa.array(back, pa.string()) if c == "text" else batch.column(kept.index(c)) for c in out]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(count, mask=null), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array([None if t is None else t == b for t, b in zip(texts, back)], pa.bool_())],
                    [*out, *made],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in out)
    return docs.select(*kept).mapInArrow(run, schema + ", n_tokens int, tokens array<int>, round_trip boolean")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, and whether decoding gives its text back."""
    return apply(table(spark, sf_dir, "documents").select("doc_id", "text"), text_back=False)
