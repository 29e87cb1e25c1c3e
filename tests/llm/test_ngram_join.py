import itertools
import time
from collections import Counter

import numpy as np
import pytest
from cases import D1, D2, ODD

from pageloom.llm import ngram_join as nj
from pageloom.llm._spark import Store, table


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + nj.N]) for i in range(max(1, len(words) - nj.N + 1))} if words else set()


def brute(rows):
    """All pairs that reach the threshold, and the least document reachable from each document in one."""
    sets = {d: grams(t) for d, t in rows}
    pairs = {(x, y) for x, y in itertools.combinations(sorted(sets), 2) if sets[x] and sets[y] and (n := len(sets[x] & sets[y])) and n >= nj.THRESHOLD * (len(sets[x]) + len(sets[y]) - n)}
    root = {d: d for d in sets}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in sorted(pairs):
        a, b = sorted((up(x), up(y)))
        root[b] = a
    many = {d for p in pairs for d in p}
    return pairs, {d: up(d) for d in many}


def check(docs, rows):
    """Groups, classes and links equal brute force, and so do the pairs of classes."""
    pairs, want = brute(rows)
    sets = {d: grams(t) for d, t in rows}
    first: dict = {}
    for d in sorted(sets):
        first.setdefault(frozenset(sets[d]), d)
    rep = {d: first[frozenset(s)] for d, s in sets.items()}
    linked = {(rep[x], rep[y]) for x, y in pairs if rep[x] != rep[y]}
    linked = {tuple(sorted(p)) for p in linked}
    degree = Counter(d for p in linked for d in p)
    got = nj.groups(docs).collect()
    assert {r["doc_id"]: (r["group_id"], r["class_id"], r["links"], r["kept"]) for r in got} == {d: (g, rep[d], degree[rep[d]], d == g) for d, g in want.items()}
    assert len(got) == len(want)
    return linked


@pytest.mark.parametrize("folder", [D1, D2])
def test_equals_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    assert check(docs, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("small", [{"BIG": 6}, {"COPIES": 1, "FLUSH": 400}, {"HOT": 0.5, "HOT_LEAST": 2}, {"BLOCK": 3, "PAIRS": 50}])
def test_hot_cases_change_nothing(make, monkeypatch, small):
    """Long lists in blocks, classes of many copies, hot cells, families in blocks of verification."""
    for name, value in small.items():
        monkeypatch.setattr(nj, name, value)
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(400)]
    fresh = lambda n: " ".join(rng.choice(vocab, n))
    rows, passage = [], fresh(12)
    for _ in range(4):
        base = fresh(int(rng.integers(10, 60)))
        rows += [(len(rows) + i, changed(rng, base, int(rng.integers(1, 5)))) for i in range(25)]
        rows += [(len(rows) + i, base) for i in range(6)]
    rows += [(len(rows) + i, f"{fresh(6)} {passage} {fresh(6)}") for i in range(40)]
    assert len(check(make(rows).repartition(5), rows)) > 100


def changed(rng, text, k):
    words = text.split()
    for i in rng.integers(0, len(words), k):
        words[i] = f"new{rng.integers(1000)}"
    return " ".join(words)


def test_planted_groups_and_a_shared_passage(make):
    """Large groups of near copies, and a passage that every other document has too."""
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(3000)]
    fresh = lambda n: " ".join(rng.choice(vocab, n))
    passage, rows, want = fresh(60), [], {}
    for g in range(6):
        base = fresh(int(rng.integers(40, 400)))
        for _ in range(int(rng.integers(2, 60))):
            want[len(rows)] = g
            rows.append((len(rows), changed(rng, base, max(1, len(base.split()) // 40))))
    alone = range(len(rows), len(rows) + 150)
    rows += [(i, f"{fresh(150)} {passage} {fresh(50)}") for i in alone]
    check(make(rows), rows)
    got = {r["doc_id"]: r["group_id"] for r in nj.groups(make(rows)).collect()}
    assert not set(alone) & set(got)
    assert all(want[d] == want[g] for d, g in got.items())


def test_partners_meet_in_lists_headed_by_unlike_lower_documents(make):
    """Each passage of the last two texts stands in an earlier, unlike document of about their size."""
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(50_000)]
    fresh = lambda n: " ".join(rng.choice(vocab, n))
    rows, want = [], set()
    for k in range(8):
        parts = [fresh(15) for _ in range(6)]
        base = 100 * k
        rows += [(base + i, f"{fresh(38)} {p} {fresh(37)}") for i, p in enumerate(parts)]
        rows += [(base + 50, " ".join(parts)), (base + 51, " ".join(parts)), (base + 52, f"{' '.join(parts)} {fresh(1)}")]
        want |= {(base + i, base + 50) for i in (50, 51, 52)}
    assert {(r["doc_id"], r["group_id"]) for r in nj.groups(make(rows)).collect()} == want


def test_needed_overlap():
    assert [nj.needed(n) for n in (1, 2, 3, 10, 64, 65)] == [1, 1, 2, 5, 32, 33]
    assert nj.needed(np.array([1, 2, 3, 10])).tolist() == [1, 1, 2, 5]


def test_rows_of_one_id_with_different_texts(make):
    """The document belongs to both groups, which are one then."""
    rows = [(5, "one two three four five"), (2, "one two three four five"), (5, "six seven eight nine ten"), (9, "six seven eight nine ten"), (5, "one two three four five")]
    got = {(r["doc_id"], r["group_id"], r["class_id"], r["links"]) for r in nj.groups(make(rows)).collect()}
    assert got == {(2, 2, 2, 0), (5, 2, 2, 0), (9, 2, 5, 0)}
    assert [r["doc_id"] for r in nj.apply(make(rows), nj.groups(make(rows))).collect()] == [2]


def test_long_texts(make):
    long = " ".join(f"w{i * i % 100_003}" for i in range(120_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 3]), (4, "short")]
    assert {(r["doc_id"], r["group_id"], r["links"]) for r in nj.groups(make(rows)).collect()} == {(1, 1, 1), (2, 1, 1)}


def test_odd_rows(odd, nothing):
    got = {r["doc_id"]: (r["group_id"], r["kept"]) for r in nj.groups(odd).collect()}
    assert got == {1: (1, True), 11: (1, False)}
    kept = nj.apply(odd, nj.groups(odd))
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert nj.groups(nothing).count() == 0 and nj.apply(nothing, nj.groups(nothing)).count() == 0


def test_all_rows_equal(make):
    docs = make([(i, "the very same words in every one of these rows") for i in range(50)])
    kept = nj.apply(docs, nj.groups(docs)).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_a_pair_is_told_about_once_however_many_lists_it_shares(spark, make):
    """Near copies of one text share most of their lists, which are spread over all tasks."""
    rng = np.random.default_rng(5)
    base, n = " ".join(f"w{i}" for i in rng.permutation(3000)[:300]), 16
    docs = make([(i, changed(rng, base, 4)) for i in range(60)])
    cold, none = spark.sparkContext.broadcast(np.zeros(nj.CELLS, np.uint16)), spark.sparkContext.broadcast({})
    listed = docs.select("doc_id", "text").repartition(2).mapInArrow(nj._post(n, cold, none), nj._ROWS).repartitionById(n, "bucket").mapInArrow(nj._lists(n), nj._ROWS)
    sets = listed.repartitionById(n, "bucket").mapInArrow(nj._search(cold), "class long, size int, short int, grams binary")
    met = sets.mapInArrow(nj._short(n), nj._ROWS).repartitionById(n, "bucket").mapInArrow(nj._merge, nj._MET).select("a", "b").collect()
    assert len({tuple(r) for r in met}) == 60 * 59 // 2 and len(met) < 1.2 * 60 * 59 // 2


def test_shuffle_files_go_with_the_table_that_they_made(spark):
    """Postings, lists and proposals don't lie on disk together until the driver happens to collect its garbage."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for f in files.getAllFiles().mkString("\n").split("\n") if (n := f.rpartition("/")[2]).startswith("shuffle_")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    store, before, was = Store(spark), shuffles(), spark.conf.get(setting, "false")
    kept = store.keep(spark.range(1000).repartition(7, "id"))
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before
    assert kept.count() == 1000 and spark.conf.get(setting) == was
