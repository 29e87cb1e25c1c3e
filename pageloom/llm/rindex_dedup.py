"""Operator 1: repeated passages by a run-length index (r-index).

Every window of ``LEAST`` words has an anchor, the least hashed ``KMER``-word
gram in it, so equal windows have equal anchors at equal places. The windows of an
anchor in which it stands at one of ``STEP`` neighbouring places share a core, the
words around it that all of them hold. Cores that occur in two or
more documents bring the windows they stand for together, and each such block of
contexts, equal ones once, is indexed: suffix array by prefix doubling,
Burrows-Wheeler transform, its runs, and suffix samples at the run ends only.
A core alone with more than ``BLOCK`` words of different contexts is too much for
one index; its windows are compared by 64-bit hashes, with the same results.
Matching statistics then stream backwards through the contexts: inside a run, LF-mapping carries a match
with the neighbouring suffix on and lengthens it by one; at a run's start the
sampled end of the previous run of that word is the new neighbour. Rows joined
by matches of ``LEAST`` words or more form blocks; blocks with more than one
document are repeated passages.

This is exact: a window is reported if and only if the same words occur in
another document. A document's words are read whole; nothing is sampled away.

Defined results: words are split at white space and compared as they are; texts
under ``LEAST`` words (so null and empty ones too) hold no passage; repetition
within one document alone isn't reported, nor between rows of one doc_id; rows
with a null doc_id are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _kernels as K
from ._spark import PACKED, IdBitmap, Packer, Store, partitions, runs, table, unpack

LEAST = 50
KMER = 8
#: Neighbouring places of an anchor in its windows that have one core, of ``LEAST - STEP + 1`` words.
STEP = 22
#: Words indexed at once, or hashed at once for a core with more.
BLOCK = 250_000
_PLACE = np.uint64((1 << 28) - 1)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes, offsets = K.codepoints(texts)
    start, end, at = K.split_words(codes, offsets)
    return K.SpanHash(codes)(start, end), at


def anchors(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Core hash, text index, first window and number of windows for every run of windows with one core."""
    none = np.zeros(0, np.int64)
    n = len(words)
    if n < LEAST:
        return none.astype(np.uint64), none, none, none
    gram = np.zeros(n - KMER + 1, np.uint64)
    for k in range(KMER):
        gram = (gram ^ words[k : k + len(gram)]) * np.uint64(0x9E6C63D0876A9A47) + np.uint64(k + 1)
    gram = K.mix(gram)
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width, span = 1, LEAST - KMER + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - LEAST + 1], least[span - width : span - width + n - LEAST + 1])
    count = np.maximum(np.diff(at) - LEAST + 1, 0)
    start, offsets = K.ragged(at[:-1], count)
    if not len(start):
        return none.astype(np.uint64), none, none, none
    place = (least[start] & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(count)), count)
    group = (place - start) // STEP
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (group[1:] != group[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    core = place[first] - STEP * group[first]
    return K.SpanHash(words)(core, core + LEAST - STEP + 1), text[first], start[first] - at[text[first]], np.diff(np.append(first, len(start)))


def _anchor_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for batch in batches:
            for part, texts in K.chunks(batch):
                key, text, first, count = anchors(*_words(texts))
                yield from packer.add(key, K.int_column(part, "doc_id")[text], first.astype(np.int32), count.astype(np.int32))
        yield from packer.flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cores of a partition that two documents have."""
    key, doc, first, count = unpack(batches, np.uint64, np.int64, np.int32, np.int32)
    order = np.lexsort((doc, key))
    key, doc, first, count = key[order], doc[order], first[order], count[order]
    cut = runs(key)
    if len(key):
        keep = np.repeat(doc[cut[:-1]] != doc[cut[1:] - 1], np.diff(cut))
        key, doc, first, count = key[keep], doc[keep], first[keep], count[keep]
    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key.view(np.int64)), pa.array(first), pa.array(count)], ["doc_id", "core", "first", "count"])


def _context_rows(buckets: int):
    """Each core with the words of its windows, packed by core; equal contexts are sent once with all their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, size = Packer(buckets), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            bucket = packer.bucket(np.array([h[0] for h in held], np.uint64))
            order = np.argsort(bucket, kind="stable")
            cut = runs(bucket[order])
            for s, e in zip(cut[:-1], cut[1:]):
                some: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
                for i in order[s:e]:
                    key, doc, first, words = held[i]
                    some.setdefault((int(key), words.tobytes()), []).append((doc, first))
                places = np.array([x for each in some.values() for x in each], np.int64)
                head = [np.array([k for k, _ in some], np.uint64), np.array([len(w) // 4 for _, w in some], np.int32), np.array([len(x) for x in some.values()], np.int32), places[:, 0], places[:, 1].astype(np.int32)]
                blob = b"".join([*(x.tobytes() for x in head), *(w for _, w in some)])
                yield pa.RecordBatch.from_arrays([pa.array([bucket[order[s]]], pa.int32()), pa.array([len(some)], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "n", "payload"])

        for batch in batches:
            names = batch.schema.names
            found, docs = batch.column(names.index("found")), K.int_column(batch, "doc_id")
            cut, each = found.offsets.to_numpy() - found.offsets[0].as_py(), found.flatten()
            key, first, count = (each.field(k).to_numpy() for k in range(3))
            row = 0
            for _, texts in K.chunks(batch):
                words, at = _words(texts)
                words = (words >> np.uint64(32)).astype(np.uint32)
                for i in range(len(texts)):
                    for x in range(cut[row], cut[row + 1]):
                        s = at[i] + first[x]
                        held.append((key.view(np.uint64)[x], docs[row], first[x], words[s : s + count[x] + LEAST - 1].copy()))
                        size += int(count[x]) + LEAST
                    row += 1
                if size > 1_000_000:
                    yield from flush()
                    held.clear()
                    size = 0
        if held:
            yield from flush()

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; all suffixes must differ (unique end marks)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = new
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


class RunIndex:
    """Run-compressed BWT of contexts, each closed by a mark of its own, with suffix samples at run ends."""

    def __init__(self, contexts: list[np.ndarray]):
        self.m = len(contexts)
        self.length = np.array([len(c) for c in contexts], np.int64)
        self.end = np.cumsum(self.length + 1) - 1
        self.text = np.empty(int(self.end[-1]) + 1, np.int64)
        mark = np.zeros(len(self.text), bool)
        mark[self.end] = True
        self.text[~mark] = np.concatenate(contexts).astype(np.int64) + self.m
        self.text[mark] = np.arange(self.m)
        sa = suffix_array(self.text)
        bwt = self.text[sa - 1]
        self.start = np.concatenate(([0], np.flatnonzero(bwt[1:] != bwt[:-1]) + 1))
        size = np.diff(np.append(self.start, len(bwt)))
        symbol = bwt[self.start]
        by_symbol = np.lexsort((np.arange(len(symbol)), symbol))
        self.lf = np.empty(len(symbol), np.int64)
        self.lf[by_symbol] = np.cumsum(size[by_symbol]) - size[by_symbol]
        before = np.full(len(symbol), -1)
        same = symbol[by_symbol][1:] == symbol[by_symbol][:-1]
        before[by_symbol[1:][same]] = by_symbol[:-1][same]
        last = sa[self.start + size - 1]
        #: Where the word before the last suffix of the previous run of the same word stands in the text.
        self.neighbour = np.where(before >= 0, last[before] - 1, -1)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b; end marks never agree."""
        out = np.zeros(len(a), np.int64)
        on = np.arange(len(a))
        k = 0
        while len(on):
            on = on[self.text[a[on] + k] == self.text[b[on] + k]]
            k += 1
            out[on] = k
        return out

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every row: match with the row before, the context, and the place in it."""
        n = len(self.text)
        match, context, place = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
        who = np.argsort(-self.length, kind="stable")
        row, length = who.copy(), np.zeros(self.m, np.int64)
        lengths = self.length[who]
        for t in range(int(self.length.max())):
            live = int(np.searchsorted(-lengths, -t, "left"))
            row, length = row[:live], length[:live]
            run = np.searchsorted(self.start, row, "right") - 1
            inside = row - self.start[run]
            row = self.lf[run] + inside
            length = length + 1
            at = np.flatnonzero(inside == 0)
            other = self.neighbour[run[at]]
            length[at] = 0
            some = other >= 0
            length[at[some]] = self._common(self.end[who[at[some]]] - t - 1, other[some])
            match[row], context[row], place[row] = length, who[:live], lengths[:live] - t - 1
        return match, context, place


def repeated(contexts: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, window start and least document of every window of ``LEAST`` words that two documents have.

    A context stands for all its copies; ``low`` and ``high`` are the least and greatest document with one.
    """
    match, context, place = RunIndex(contexts).matching_statistics()
    rows = np.arange(len(contexts), len(match))
    cut = np.concatenate(([0], np.flatnonzero(match[rows][1:] < LEAST) + 1, [len(rows)]))
    row, offsets = rows, cut
    block = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    least = np.minimum.reduceat(low[context[row]], offsets[:-1])
    most = np.maximum.reduceat(high[context[row]], offsets[:-1])
    # A suffix shorter than a window is a block of its own, whose context may have copies.
    keep = (least != most)[block] & (place[row] <= np.array([len(c) for c in contexts])[context[row]] - LEAST)
    return context[row][keep], place[row][keep], least[block][keep]


def hashed(contexts: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``repeated`` finds, by hashes of the windows; needs no index over all words."""
    length = np.array([len(c) for c in contexts], np.int64)
    count = length - LEAST + 1
    window = np.empty(int(count.sum()), np.uint64)
    done = 0
    for part in np.split(np.arange(len(contexts)), np.flatnonzero(np.diff(np.cumsum(length) // BLOCK)) + 1):
        at, _ = K.ragged(np.cumsum(length[part]) - length[part], count[part])
        window[done : done + len(at)] = K.SpanHash(np.concatenate([contexts[i] for i in part]))(at, at + LEAST)
        done += len(at)
    order = np.argsort(window)
    cut = runs(window[order])
    context = np.repeat(np.arange(len(contexts)), count)[order]
    least = np.minimum.reduceat(low[context], cut[:-1])
    keep = np.repeat(least != np.maximum.reduceat(high[context], cut[:-1]), np.diff(cut))
    least = np.repeat(least, np.diff(cut))
    return context[keep], (order - (np.cumsum(count) - count)[context])[keep], least[keep]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Equal contexts of a core are held and indexed once, however many documents have them.
    known: dict[tuple[int, bytes], int] = {}
    kinds, docs, firsts = [], [], []
    for batch in batches:
        for n, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
            view, at = blob.as_buffer(), 0
            head = []
            for dtype in (np.uint64, np.int32, np.int32):
                head.append(np.frombuffer(view, dtype, n, at))
                at += head[-1].nbytes
            key, length, copies = head
            total = int(copies.sum())
            # Copied, so that what has been read isn't held.
            docs.append(np.frombuffer(view, np.int64, total, at).copy())
            firsts.append(np.frombuffer(view, np.int32, total, at + 8 * total).copy())
            words = np.split(np.frombuffer(view, np.uint32, int(length.sum(dtype=np.int64)), at + 12 * total), np.cumsum(length, dtype=np.int64)[:-1])
            kinds.append(np.repeat([known.setdefault((k, w.tobytes()), len(known)) for k, w in zip(key.tolist(), words)], copies))
    if not known:
        return
    kind, doc, first = np.concatenate(kinds), np.concatenate(docs), np.concatenate(firsts).astype(np.int64)
    key = np.array([k for k, _ in known], np.uint64)
    contexts = [np.frombuffer(w, np.uint32) for _, w in known]
    by_kind = np.lexsort((doc, kind))
    members = runs(kind[by_kind])
    low, high = doc[by_kind[members[:-1]]], doc[by_kind[members[1:] - 1]]
    order = np.argsort(key, kind="stable")
    cut = runs(key[order])
    words = np.add.reduceat(np.array([len(c) for c in contexts], np.int64)[order], cut[:-1])
    pieces: list[tuple] = [(hashed, order[cut[i] : cut[i + 1]]) for i in np.flatnonzero(words > BLOCK)]
    small = np.flatnonzero(words <= BLOCK)
    for some in np.split(small, np.flatnonzero(np.diff(np.cumsum(words[small]) // BLOCK)) + 1):
        pieces.append((repeated, order[K.ragged(cut[some], np.diff(cut)[some])[0]]))
    for find, some in pieces:
        if not len(some):
            continue
        which, place, least = find([contexts[i] for i in some], low[some], high[some])
        by = np.lexsort((place, which))
        which, place, least = which[by], place[by], least[by]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1)
        at = np.flatnonzero(new)
        if not len(at):
            continue
        which, start, least, width = some[which[at]], place[at], np.minimum.reduceat(least, at), np.diff(np.append(at, len(which)))
        # Back to every copy.
        copies, offsets = K.ragged(members[which], members[which + 1] - members[which])
        each = np.repeat(np.arange(len(which)), np.diff(offsets))
        begins = first[by_kind[copies]] + start[each]
        yield pa.RecordBatch.from_arrays([pa.array(doc[by_kind[copies]]), pa.array(begins), pa.array(begins + width[each] - 1 + LEAST), pa.array(least[each])], ["doc_id", "start_word", "end_word", "first_doc_id"])


def passages(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """``(doc_id, start_word, end_word, first_doc_id)``: maximal word ranges made of windows that other documents have.

    ``first_doc_id`` is the least document that has one of the range's windows.
    """
    spark = docs.sparkSession
    store, n = store or Store(spark), partitions(spark)
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = store.keep(docs.mapInArrow(_anchor_rows(n), PACKED).repartitionById(n, "bucket").mapInArrow(_shared, "doc_id long, core long, first int, count int"))
    sent = spark.sparkContext.broadcast(IdBitmap(found.select("doc_id").distinct(), "doc_id"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.ids(K.int_column(batch, "doc_id"))))

    per = found.groupBy("doc_id").agg(F.collect_list(F.struct("core", "first", "count")).alias("found"))
    joined = docs.mapInArrow(some, "doc_id long, text string").join(per, "doc_id")
    pieces = joined.mapInArrow(_context_rows(n), PACKED).repartitionById(n, "bucket").mapInArrow(_match, "doc_id long, start_word long, end_word long, first_doc_id long")
    order = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = pieces.withColumn("_new", F.when(F.col("start_word") <= reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order))
    return island.groupBy("doc_id", "_island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("first_doc_id").alias("first_doc_id")).drop("_island")


def op1_rindex_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the documents that another document has too."""
    return passages(table(spark, sf_dir, "documents"))
