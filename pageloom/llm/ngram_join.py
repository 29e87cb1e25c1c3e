"""Operator 3: exact n-gram Jaccard join by T-occurrence search with DivideSkip.

Documents of one set of word n-grams are one class, told by a hash of the whole
set; classes are searched, and no copy is ever expanded into pairs. Two sets of
Jaccard ``THRESHOLD`` or more have an n-gram in common at least
``T = ceil(THRESHOLD * n)`` times, n being the size of the larger one. So

1. one exchange of all n-grams finds the inverted lists of two classes or more;
   a class with fewer than T n-grams on such lists has no partner;
2. a class's lists are ordered by length; its T-1 longest are set aside, and a
   partner must occur on one of the other, short ones. Short lists are merged (a
   distributed sort): their classes meet in pairs, after filters on sizes and on
   what can still be shared behind the list. A posting also names ``MARKS`` of its
   class's short lists, the least by as many hashes; two classes of one mark meet
   on that list and on no other, so a pair is told about once however many lists
   it shares, and a list most of whose classes have one mark isn't written out;
3. proposals are verified: all n-grams of one set, those of the long lists too,
   are looked up among those of the other, and the pair stays if it reaches the
   overlap. Sets are sent once for a block of a family, not for
   each pair.

Nothing is sampled, capped or estimated: every pair of classes that reaches the
threshold is found (up to collisions of 64-bit hashes). Components of the pairs
are the groups.

Hot cases: n-grams whose cell of a counter table of fixed size is far fuller than
the mean are taken as long without an exchange; of a class with very many copies
only the least document posts, of any other at most one of a task's million
n-grams; a list of more than ``BIG`` classes is cut into blocks, and every two
blocks meet in a task of their own. The pairs of a family of m different texts
are m squared, as each may be a link of its own.

Defined results: a text without words (null, empty, blank) belongs to no group;
a text of fewer than ``N`` words is a single n-gram; texts of equal n-gram sets
are in one class and one group; ``links`` counts a class's partner classes, so it
is 0 where copies alone make a group; the least doc_id of a group is the one kept;
rows with a null doc_id are ignored by the join and kept by ``apply``; repeated
rows of one doc_id count as one document (of different texts: all their groups
are one, the least class and the most links stand), and stay together in
``apply``; other columns are ignored by the join and kept by ``apply``; an empty
table has no groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K
from ._spark import Store, buckets, components, runs, table

N = 3
THRESHOLD = 0.5
CELLS = 1 << 18
#: A cell is hot if it holds so many times the mean, and so many n-grams at least; only the way of its lists depends on it.
HOT, HOT_LEAST = 8, 64
#: Classes with more copies than this are told apart beforehand (the largest ``HOT_CLASSES`` of them).
COPIES, HOT_CLASSES = 1000, 65_536
#: Classes of a short list that meet in one go.
BIG = 4096
#: Sets in a block of verification.
BLOCK = 256
#: Short lists that a class names with each posting.
MARKS = 3
FLUSH = 1_000_000
#: Pairs of a list's classes looked at in one go.
PAIRS = 2_000_000
_LOW = np.uint64((1 << 32) - 1)
_SEEDS = [np.uint64(int(x)) for x in np.random.default_rng(23).integers(1, 1 << 62, 64)]
_ROWS = "kind int, bucket int, n int, m int, payload binary"
_NAMES = ["kind", "bucket", "n", "m", "payload"]


def _gram_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of every text."""
    codes, offsets = K.codepoints(texts)
    codes = K.lower(codes)
    start, end, words = K.split_words(codes, offsets)
    grams, at = K.word_grams(K.SpanHash(codes)(start, end), words, N)
    for s, e in zip(at[:-1], at[1:]):
        yield np.unique(grams[s:e])


def _class(grams: np.ndarray) -> int:
    return int(K.mix(np.add.reduce(K.mix(grams ^ np.uint64(0x9E3779B97F4A7C15)), keepdims=True) + np.uint64(len(grams))).view(np.int64)[0])


def needed(size: int | np.ndarray) -> int | np.ndarray:
    """T: the n-grams that a set of this size shares with any partner at least."""
    return np.ceil(THRESHOLD * size - 1e-9).astype(np.int64) if isinstance(size, np.ndarray) else int(np.ceil(THRESHOLD * size - 1e-9))


# ---- classes and counters ----


def _classes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: each document's class and set size (kind 0), and counters of its n-grams (kind 1)."""
    total = np.zeros(CELLS, np.int64)
    names = ["kind", "doc", "class", "size", "counts"]
    for batch in batches:
        for part, texts in K.chunks(batch):
            made = list(_gram_sets(texts))
            some = [i for i, g in enumerate(made) if len(g)]
            if not some:
                continue
            total += np.bincount((np.concatenate(made) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            k = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(K.int_column(part, "doc_id")[some]), pa.array([_class(made[i]) for i in some], pa.int64()), pa.array([len(made[i]) for i in some], pa.int32()), pa.nulls(k, pa.binary())], names)
    if total.any():
        block = CELLS // 64
        blobs = [np.minimum(total[i * block : (i + 1) * block], (1 << 31) - 1).astype(np.int32).tobytes() for i in range(64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(64, np.int32)), pa.array(np.arange(64, dtype=np.int64)), pa.nulls(64, pa.int64()), pa.nulls(64, pa.int32()), pa.array(blobs, pa.binary())], names)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[c] = held.get(c, 0) + np.frombuffer(blob, np.int32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["cell", "counts"])


def hot_levels(scanned: DataFrame) -> np.ndarray:
    """A table of fixed size: 0 for a cell that isn't hot, else an order by fullness."""
    blobs = scanned.where("kind = 1").select(F.col("doc").cast("int").alias("cell"), "counts").repartitionById(64, "cell").mapInArrow(_add_up, "cell int, counts binary").collect()
    counts = np.zeros(CELLS, np.int64)
    for r in blobs:
        own = np.frombuffer(r["counts"], np.int64)
        counts[r["cell"] * len(own) : (r["cell"] + 1) * len(own)] = own
    hot = counts > HOT * counts.mean() + HOT_LEAST
    return np.where(hot, 1 + 8 * np.log2(np.maximum(counts, 1)), 0).astype(np.uint16)


# ---- inverted lists ----


class _Out:
    """Values grouped by class, written as one blob per bucket: classes, how many values each has, and the values."""

    def __init__(self, kind: int, n: int):
        self.kind, self.n = kind, n

    def rows(self, bucket: np.ndarray, owner: np.ndarray, heads: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        """``owner`` numbers the class of each value, in runs; ``heads`` are per class, ``values`` per value."""
        order = np.argsort(bucket, kind="stable")
        bucket, owner, values = bucket[order], owner[order], [v[order] for v in values]
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(bucket))).astype(np.int32)
        heads = [h[owner[first]] for h in heads]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
        runs_at = np.searchsorted(first, cut)
        blobs = [b"".join([*(h[x:y].tobytes() for h in heads), count[x:y].tobytes(), *(v[s:e].tobytes() for v in values)]) for s, e, x, y in zip(cut[:-1], cut[1:], runs_at[:-1], runs_at[1:])]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), self.kind, np.int32)), pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(np.diff(cut).astype(np.int32)), pa.array(np.diff(runs_at).astype(np.int32)), pa.array(blobs, pa.binary())], _NAMES)


def _read(batch: pa.RecordBatch, kind: int, heads: tuple[type, ...], values: tuple[type, ...]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, list[np.ndarray]]]:
    """Bucket, heads, values per head and values of each blob of a kind."""
    for k, bucket, n, m, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
        if k != kind:
            continue
        at, view = 0, blob.as_buffer()

        def take(dtype: type, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, dtype, count, at)
            at += out.nbytes
            return out

        h = [take(d, m) for d in heads]
        yield bucket, h, take(np.int32, m), [take(d, n) for d in values]


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def _named(grams: np.ndarray, n: int) -> np.ndarray:
    """An n-gram's name: its bucket and the low half of its hash."""
    return (_bucket(grams, n).astype(np.uint64) << np.uint64(32)) | (grams & _LOW)


def _post(n: int, levels, hot_classes):
    """The n-grams of each class for the exchange by n-gram (kind 0); set sizes and n-grams of hot lists for the one by class (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            name = np.array(list(held), np.int64).view(np.uint64)
            width = np.array([len(g) for g in held.values()], np.int64)
            grams, owner = np.concatenate(list(held.values())), np.repeat(np.arange(len(name)), width)
            hot = levels.value[(grams & np.uint64(CELLS - 1)).astype(np.int64)] > 0
            light = grams[~hot]
            yield _Out(0, n).rows(_bucket(light, n), owner[~hot], (name,), ((light & _LOW).astype(np.uint32),))
            # Every class sends its size; a hot n-gram of name 0 stands for none.
            own = np.concatenate((owner[hot], np.arange(len(name))))
            value = np.concatenate((_named(grams[hot], n), np.zeros(len(name), np.uint64)))
            order = np.argsort(own, kind="stable")
            yield _Out(1, n).rows(_bucket(name, n)[own[order]], own[order], (name, width.astype(np.int32)), (value[order],))

        for batch in batches:
            for part, texts in K.chunks(batch):
                for doc, grams in zip(K.int_column(part, "doc_id").tolist(), _gram_sets(texts)):
                    if not len(grams):
                        continue
                    name = _class(grams)
                    if hot_classes.value.get(name, doc) == doc and name not in held:
                        held[name] = grams
                        size += len(grams)
                if size >= FLUSH:
                    yield from flush()
                    held.clear()
                    size = 0
        if held:
            yield from flush()

    return run


def _level(length: np.ndarray) -> np.ndarray:
    """List lengths on a scale of 8 bits."""
    return np.minimum(255, 8 * np.log2(length)).astype(np.uint8)


def _lists(n: int):
    """Of the inverted lists of a partition, those of two classes or more go back to their classes, with the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for batch in batches:
            other = batch.filter(pa.array(batch.column(0).to_numpy() == 1))
            if other.num_rows:
                yield other
            for bucket, (name,), count, (key,) in _read(batch, 0, (np.uint64,), (np.uint32,)):
                keys, names = held.setdefault(bucket, ([], []))
                keys.append(key)
                names.append(np.repeat(name, count))
        for bucket, (keys, names) in held.items():
            key, name = np.concatenate(keys), np.concatenate(names)
            keys.clear()
            names.clear()
            order = np.argsort(key, kind="stable")
            key, name = key[order], name[order]
            many = np.zeros(len(key), bool)
            many[1:] = key[1:] == key[:-1]
            many[:-1] |= many[1:].copy()
            key, name = key[many], name[many]
            order = np.lexsort((name, key))
            key, name = key[order], name[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
            key, name = key[new], name[new]
            length = np.diff(runs(key))
            length = np.repeat(length, length) if len(key) else np.zeros(0, np.int64)
            key, name, length = key[length > 1], name[length > 1], length[length > 1]
            order = np.argsort(name, kind="stable")
            for s in range(0, len(order), FLUSH):
                some = order[s : s + FLUSH]
                classes, owner = np.unique(name[some], return_inverse=True)
                yield _Out(2, n).rows(_bucket(classes, n)[owner], owner, (classes, np.full(len(classes), bucket, np.int32)), (key[some], _level(length[some])))

    return run


def _search(levels):
    """Each class that may have a partner: set size, how many lists are short, and its n-grams on lists, shortest lists first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, grams, level, heads, sizes = [], [], [], [], []
        for batch in batches:
            for _, (name, bucket), count, (key, own) in _read(batch, 2, (np.uint64, np.int32), (np.uint32, np.uint8)):
                names.append(np.repeat(name, count))
                grams.append((np.repeat(bucket, count).astype(np.uint64) << np.uint64(32)) | key)
                level.append(own.astype(np.uint16))
            for _, (name, size), count, (value,) in _read(batch, 1, (np.uint64, np.int32), (np.uint64,)):
                heads.append(name)
                sizes.append(size)
                true = value > 0
                names.append(np.repeat(name, count)[true])
                grams.append(value[true])
                level.append(256 + levels.value[(value[true] & np.uint64(CELLS - 1)).astype(np.int64)])
        if not heads:
            return
        name, gram, rank = np.concatenate(names), np.concatenate(grams), np.concatenate(level)
        heads, at = np.unique(np.concatenate(heads), return_index=True)
        size = np.concatenate(sizes)[at]
        order = np.lexsort((gram, rank, name))
        name, gram = name[order], gram[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (gram[1:] != gram[:-1])
        name, gram = name[new], gram[new]
        lo, hi = np.searchsorted(name, heads), np.searchsorted(name, heads, "right")
        short = hi - lo - needed(size) + 1
        for s in range(0, len(heads), 1000):
            some = [i for i in range(s, min(s + 1000, len(heads))) if short[i] > 0 and hi[i] > lo[i]]
            yield pa.RecordBatch.from_arrays([pa.array(heads[some].view(np.int64)), pa.array(size[some]), pa.array(short[some].astype(np.int32)), pa.array([gram[lo[i] : hi[i]].tobytes() for i in some], pa.binary())], ["class", "size", "short", "grams"])

    return run


def _marks(key: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """``MARKS`` lists of each class: the least of its short lists by each hash; ``key`` in runs of ``count``."""
    begin = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(count)), count)
    out = []
    for seed in _SEEDS[:MARKS]:
        h = K.mix(key ^ seed)
        at = np.flatnonzero(h == np.minimum.reduceat(h, begin)[owner])
        out.append(key[at[np.unique(owner[at], return_index=True)[1]]])
    return out


def _short(n: int):
    """The short lists' postings: class, set size, its lists in all, its marks, and how many of its lists stand from this one on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            name, size, short, total = (np.array([h[k] for h in held]) for k in range(4))
            gram = np.concatenate([np.frombuffer(h[4], np.uint64, h[2]) for h in held])
            owner = np.repeat(np.arange(len(held)), short)
            place = np.arange(len(gram)) - np.repeat(np.cumsum(short) - short, short)
            key = K.mix(gram)
            return _Out(0, n).rows(_bucket(key, n), owner, (name.astype(np.int64), size.astype(np.int32), total.astype(np.int32), *(_named(m, n) for m in _marks(key, short))), ((key & _LOW).astype(np.uint32), (np.repeat(total, short) - place).astype(np.int32)))

        for batch in batches:
            for name, size, short, grams in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((name, size, short, len(grams) // 8, grams))
                count += short
                if count > FLUSH:
                    yield flush()
                    held.clear()
                    count = 0
        if held:
            yield flush()

    return run


def _may(size_x: np.ndarray, size_y: np.ndarray, rest_x: np.ndarray, rest_y: np.ndarray) -> np.ndarray:
    """Whether two classes can reach the threshold if this is the first list that they share."""
    overlap = THRESHOLD / (1 + THRESHOLD) * (size_x.astype(np.int64) + size_y) - 1e-6
    return (np.minimum(size_x, size_y) >= THRESHOLD * np.maximum(size_x, size_y)) & (np.minimum(rest_x, rest_y) >= overlap)


class Postings:
    """Postings of lists, those of a list together and in order of first mark."""

    KINDS = (np.int64, np.int32, np.int32, np.int32)

    def __init__(self, name: np.ndarray, size: np.ndarray, total: np.ndarray, rest: np.ndarray, *marks: np.ndarray):
        """The first of ``marks`` is the posting's own list, the others those of its class."""
        self.name, self.size, self.total, self.rest, self.at, self.marks = name, size, total, rest, marks[0], marks[1:]

    def pick(self, some: np.ndarray) -> Postings:
        return Postings(*(c[some] for c in self.columns()))

    def columns(self) -> list[np.ndarray]:
        return [self.name, self.size, self.total, self.rest, self.at, *self.marks]

    def pack(self) -> bytes:
        return b"".join(c.tobytes() for c in self.columns())

    @classmethod
    def unpack(cls, n: int, view: pa.Buffer) -> Postings:
        out, at = [], 0
        for kind in (*cls.KINDS, *[np.uint64] * (1 + MARKS)):
            out.append(np.frombuffer(view, kind, n, at))
            at += out[-1].nbytes
        return cls(*out)

    def met(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of two postings of a list: whether their classes may reach the threshold and no other list tells them."""
        ok, told = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for m in self.marks:
            same = ~told & (m[x] == m[y])
            ok |= same & (m[x] == self.at[x])
            told |= same
        rest = [np.where(told, self.total[z], self.rest[z]) for z in (x, y)]
        return (ok | ~told) & _may(self.size[x], self.size[y], *rest) & (self.name[x] != self.name[y])


def _meet(p: Postings, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of the postings of each list, which goes to ``end``; repeats are told again only where there are very many pairs."""
    n = len(p.name)
    here = np.arange(n)
    new = np.ones(n + 1, bool)
    if n:
        new[1:-1] = (p.marks[0][1:] != p.marks[0][:-1]) | (end[1:] != end[:-1])
    cut = np.flatnonzero(new)
    # Of one first mark meet on its list only.
    begin = np.where(p.marks[0] == p.at, here + 1, np.repeat(cut[1:], np.diff(cut)))
    later = end - begin
    done = np.cumsum(later)
    found, held, i = [], 0, 0
    while i < n:
        stop = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + PAIRS, "right")))
        y, offsets = K.ragged(begin[i:stop], later[i:stop])
        x = np.repeat(np.arange(i, stop), np.diff(offsets))
        ok = p.met(x, y)
        x, y = p.name[x[ok]], p.name[y[ok]]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
        held, i = held + len(x), stop
        if held > 2 * PAIRS or i >= n:
            a, b = _distinct(np.concatenate(found, axis=1))
            found, held = [np.stack([a, b])], len(a)
            if held > PAIRS or i >= n:
                yield a, b
                found, held = [], 0


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((pairs[1], pairs[0]))
    a, b = pairs[0][order], pairs[1][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


_MET = "a long, b long, n int, m int, block binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the short lists of a partition: pairs that may reach the threshold, and blocks of the lists of more than ``BIG`` classes."""
    held: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        for bucket, heads, count, (key, rest) in _read(batch, 0, (np.int64, np.int32, np.int32, *[np.uint64] * MARKS), (np.uint32, np.int32)):
            held.setdefault(bucket, []).append([key, rest, *(np.repeat(h, count) for h in heads)])
    for bucket, own in held.items():
        key, rest, name, size, total, *marks = (np.concatenate(x) for x in zip(*own))
        own.clear()
        order = np.lexsort((name, marks[0], key))
        key, (name, size, total, rest, *marks) = key[order], (c[order] for c in (name, size, total, rest, *marks))
        cut = runs(key)
        length = np.diff(cut)
        p = Postings(name, size, total, rest, np.uint64(bucket << 32) | key, *marks)
        for s, e in zip(cut[:-1][length > BIG].tolist(), cut[1:][length > BIG].tolist()):
            parts = np.array_split(np.arange(s, e), -(-2 * (e - s) // BIG))
            for i, x in enumerate(parts):
                for y in parts[i:] if i + 1 == len(parts) else parts[i + 1 :]:
                    both = x if x is y else np.concatenate((x, y))
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([len(both)], pa.int32()), pa.array([0], pa.int32()), pa.array([p.pick(both).pack()], pa.binary())], ["a", "b", "n", "m", "block"])
        some = (length > 1) & (length <= BIG)
        p, length = p.pick(np.repeat(some, length)), length[some]
        for a, b in _meet(p, np.repeat(np.cumsum(length), length)):
            yield _pair_rows(a, b)


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    k = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], ["a", "b", "n", "m", "block"])


def _meet_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            for a, b in _meet(Postings.unpack(n, blob.as_buffer()), np.full(n, n)):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


# ---- verification ----


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact Jaccard within cells: sets come before pairs, and those by ``a``; the n-grams of each ``b`` are looked up among the marked ones of ``a``."""
    cell, sets, made = None, {}, None
    for batch in batches:
        root, i, j, kind, a, b, size = (pc.fill_null(batch.column(k), 0).to_numpy(zero_copy_only=False) for k in range(7))
        new = np.ones(len(root) + 1, bool)
        new[1:-1] = (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (kind[1:] != kind[:-1])
        cut = np.flatnonzero(new)
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if (root[s], i[s], j[s]) != cell:
                cell, sets, made = (root[s], i[s], j[s]), {}, None
            if kind[s] == 0:
                for k in range(s, e):
                    sets[int(a[k])] = (int(size[k]), np.frombuffer(batch.column(7)[k].as_buffer(), np.uint64).copy())
                continue
            made = made or _Cell(sets)
            yield from made.probe(a[s:e], b[s:e])


class _Cell:
    """The sets of a cell, their n-grams numbered."""

    def __init__(self, sets: dict[int, tuple[int, np.ndarray]]):
        self.name = np.array(sorted(sets), np.int64)
        own = [sets[k] for k in self.name.tolist()]
        self.size = np.array([x[0] for x in own], np.int64)
        self.length = np.array([len(x[1]) for x in own], np.int64)
        self.start = np.cumsum(self.length) - self.length
        grams, at = np.unique(np.concatenate([x[1] for x in own]), return_inverse=True)
        self.grams, self.mark = at.astype(np.int32), np.zeros(len(grams), np.uint8)
        sets.clear()

    def probe(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = np.searchsorted(self.name, a), np.searchsorted(self.name, b)
        both = np.zeros(len(x), np.int64)
        cut = runs(x)
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own = self.grams[self.start[x[s]] : self.start[x[s]] + self.length[x[s]]]
            self.mark[own] = 1
            done = np.cumsum(self.length[y[s:e]])
            k = s
            while k < e:
                stop = min(e, max(k + 1, s + int(np.searchsorted(done, (done[k - s - 1] if k > s else 0) + PAIRS, "right"))))
                at, offsets = K.ragged(self.start[y[k:stop]], self.length[y[k:stop]])
                both[k:stop] = np.add.reduceat(self.mark[self.grams[at]], offsets[:-1], dtype=np.int64)
                k = stop
            self.mark[own] = 0
        either = self.size[x] + self.size[y] - both
        ok = both >= THRESHOLD * either - 1e-9
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(both[ok] / either[ok])], ["a", "b", "jaccard"])


def _verify(store: Store, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that reach the threshold. A family of proposals is cut into blocks; a set goes to the cells of two blocks that ask for it."""
    roots = components(store, pairs)
    blocks = roots.join(roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")), "root").select("node", "root", F.expr("cast(pmod(xxhash64(node), k) as int)").alias("block"))
    blocks = store.keep(blocks)
    side = lambda c: blocks.select(F.col("node").alias(c), *([F.col("root")] if c == "a" else []), F.col("block").alias(f"in_{c}"))
    placed = store.keep(pairs.join(side("a"), "a").join(side("b"), "b").select("root", F.least("in_a", "in_b").alias("i"), F.greatest("in_a", "in_b").alias("j"), "a", "b"))
    asked = placed.select("root", "i", "j", "a").union(placed.select("root", "i", "j", F.col("b").alias("a"))).distinct()
    sent = asked.join(sets.select(F.col("class").alias("a"), "size", "grams"), "a").select("root", "i", "j", F.lit(0).alias("kind"), "a", F.lit(None).cast("long").alias("b"), "size", "grams")
    rows = sent.union(placed.select("root", "i", "j", F.lit(1), "a", "b", F.lit(None).cast("int"), F.lit(None).cast("binary")))
    out = store.keep(rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "kind", "a").mapInArrow(_probe, "a long, b long, jaccard double"))
    store.drop(blocks, placed)
    return out


def links(docs: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """All documents with their class, ``(doc, class, size)``, and all pairs of classes that reach the threshold, ``(a, b, jaccard)``."""
    spark, n = docs.sparkSession, buckets(docs)
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    scanned = store.keep(docs.mapInArrow(_classes_of, "kind int, doc long, class long, size int, counts binary"))
    known = scanned.where("kind = 0").select("doc", "class", "size")
    hot = known.groupBy("class").agg(F.count("*").alias("c"), F.min("doc").alias("least")).where(F.col("c") > COPIES).orderBy(F.desc("c"), "class").limit(HOT_CLASSES).collect()
    levels = spark.sparkContext.broadcast(hot_levels(scanned))
    hot_classes = spark.sparkContext.broadcast({r["class"]: r["least"] for r in hot})
    # Kept, so that the postings are gone before the lists that they made move.
    listed = store.keep(docs.mapInArrow(_post(n, levels, hot_classes), _ROWS).repartitionById(n, "bucket").mapInArrow(_lists(n), _ROWS))
    sets = store.keep(listed.repartitionById(n, "bucket").mapInArrow(_search(levels), "class long, size int, short int, grams binary"))
    store.drop(listed)
    met = store.keep(sets.mapInArrow(_short(n), _ROWS).repartitionById(n, "bucket").mapInArrow(_merge, _MET))
    blocks = met.where("block is not null").select("n", "block").repartition(n).mapInArrow(_meet_blocks, "a long, b long")
    pairs = store.keep(met.where("block is null").select("a", "b").union(blocks).distinct())
    store.drop(met)
    found = _verify(store, pairs, sets)
    store.drop(pairs, sets)
    return known, found


def groups(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """``(doc_id, group_id, class_id, links, kept)`` of every document that has a copy or a link.

    ``class_id`` is the least document of the same n-gram set, ``links`` how many
    other classes reach the threshold with it, ``group_id`` the least document that
    links lead to.
    """
    store = store or Store(docs.sparkSession)
    known, found = links(docs, store)
    degree = found.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    least = known.groupBy("class").agg(F.min("doc").alias("rep"), F.max("doc").alias("most"))
    classes = store.keep(least.join(degree, "class", "left").where("rep <> most or links is not null").select("class", "rep", F.coalesce("links", F.lit(0)).alias("links")))
    members = store.keep(known.join(classes, "class").select("doc", "rep", "links").distinct())
    side = lambda c: classes.select(F.col("class").alias(c), F.col("rep").alias(f"r{c}"))
    both = members.groupBy("doc").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("doc", "lo")
    edges = found.join(side("a"), "a").join(side("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).union(members.join(both, "doc").select("lo", "rep"))
    roots = components(store, edges)
    store.drop(classes, found)
    placed = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc").agg(F.min(F.coalesce("root", "rep")).alias("group_id"), F.min("rep").alias("class_id"), F.max("links").alias("links"))
    return placed.select(F.col("doc").alias("doc_id"), "group_id", "class_id", "links", (F.col("doc") == F.col("group_id")).alias("kept"))


def apply(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One document of each group, and all that are in none; all columns are kept."""
    return docs.join(grouped.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate groups among all documents."""
    return groups(table(spark, sf_dir, "documents"))
