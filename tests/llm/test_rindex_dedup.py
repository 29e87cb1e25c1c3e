import numpy as np
import pyarrow as pa
import pytest
from cases import D1, D2, LONG

from pageloom.llm import rindex_dedup as ri
from pageloom.llm._spark import table


def brute(rows):
    """Word ranges covered by windows that another document has too, with the least such document."""
    where = {}
    for doc, text in rows:
        words = (text or "").split()
        for i in range(len(words) - ri.LEAST + 1):
            where.setdefault(tuple(words[i : i + ri.LEAST]), set()).add(doc)
    out = set()
    for doc, text in {(d, t) for d, t in rows}:
        words, begin, end, low = (text or "").split(), None, None, None
        for i in range(len(words) - ri.LEAST + 1):
            docs = where[tuple(words[i : i + ri.LEAST])]
            if len(docs) < 2:
                continue
            if begin is not None and i <= end:
                end, low = i + ri.LEAST, min(low, *docs)
            else:
                if begin is not None:
                    out.add((doc, begin, end, low))
                begin, end, low = i, i + ri.LEAST, min(docs)
        if begin is not None:
            out.add((doc, begin, end, low))
    return out


def found(df):
    return [(r["doc_id"], r["start_word"], r["end_word"], r["first_doc_id"]) for r in ri.passages(df).collect()]


@pytest.mark.parametrize("folder", [D1, D2])
def test_equals_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    got = found(docs)
    assert len(got) == len(set(got)) > 0
    assert merged(got) == merged(brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))


def merged(ranges):
    """Ranges without what depends on how touching ones are joined: the words covered, by document."""
    return {(d, i) for d, s, e, _ in ranges for i in range(s, e)}


def test_planted_passages(make):
    rng = np.random.default_rng(6)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    passage, longer = fresh(51), fresh(300)
    rows = [(i, f"{fresh(60)} {passage} {fresh(40)}") for i in range(30)] + [(100 + i, f"{fresh(10)} {longer}") for i in range(3)] + [(200, fresh(500)), (201, " ".join([fresh(60)] * 2)), (202, passage.rsplit(" ", 2)[0])]
    got = found(make(rows))
    assert sorted(got) == sorted(brute(rows))
    assert {d for d, *_ in got} == {*range(30), 100, 101, 102}


def test_repetitive_texts(make):
    """Runs of one word and of a short cycle: matches overlap themselves."""
    rows = [(1, "ha " * 400), (2, "ha " * 120), (3, "ab cd " * 90), (4, "ab cd " * 50), (5, "cd ab " * 30), (6, "xy " * 90)]
    assert merged(found(make(rows))) == merged(brute(rows)) and 6 not in {d for d, *_ in found(make(rows))}


def met(texts):
    """Keys that two of the texts have."""
    key, text, _, _ = ri.anchors(*ri._words(texts))
    return {k for k in key.tolist() if len(set(text[key == k].tolist())) > 1}


def test_a_common_phrase_gathers_nothing():
    """Texts with a phrase of ``KMER`` words in common, often the least hashed, and no window."""
    rng = np.random.default_rng(8)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    for length, some in ((ri.KMER, False), (ri.LEAST, True)):
        for _ in range(30):
            phrase = fresh(length)
            assert bool(met([f"{fresh(60)} {phrase} {fresh(60)}" for _ in range(5)])) == some


@pytest.mark.parametrize("block", [60, 3000])
def test_no_index_exceeds_its_block(monkeypatch, block):
    """One short passage in many documents with other words around it, besides longer ones and equal copies."""
    rng = np.random.default_rng(9)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    short, longer = fresh(ri.LEAST + 5), fresh(200)
    texts = [f"{fresh(30)} {short} {fresh(30)}" for _ in range(150)] + [f"{fresh(20)} {longer}" for _ in range(4)] + ["ha " * 120, "ha " * 90] + [fresh(90)] * 3
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    shared = pa.Table.from_batches(ri._shared(ri._anchor_rows(1)(iter([docs])))).to_pydict()
    rows = [dict(zip(list(shared)[1:], x)) for x in zip(*list(shared.values())[1:])]
    per = [[r for r, d in zip(rows, shared["doc_id"]) if d == i] for i in range(len(texts))]
    joined = docs.append_column("found", pa.array(per, pa.list_(pa.struct([(c, t) for c, t in zip(list(shared)[1:], (pa.int64(), pa.int32(), pa.int32()))]))))
    sizes = []
    build = ri.RunIndex.__init__
    monkeypatch.setattr(ri.RunIndex, "__init__", lambda self, contexts: (sizes.append(sum(map(len, contexts))), build(self, contexts))[1])
    monkeypatch.setattr(ri, "BLOCK", block)
    got = [tuple(r.values())[:3] + (0,) for b in ri._match(ri._context_rows(1)(iter([joined]))) for r in b.to_pylist()]
    assert merged(got) == merged(brute(list(enumerate(texts)))) and max(sizes, default=0) <= 2 * block


def test_hashed_windows_equal_the_index():
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 32, 400).astype(np.uint32)
    contexts = [base[s : s + int(n)].copy() for s, n in zip(rng.integers(0, 300, 40), rng.integers(ri.LEAST, 100, 40))] + [np.full(n, 7, np.uint32) for n in (70, 90)]
    low = rng.integers(0, 30, len(contexts))
    high = low + rng.integers(0, 2, len(contexts))
    rows = lambda f: sorted(zip(*(x.tolist() for x in f(contexts, low, high))))
    assert rows(ri.hashed) == rows(ri.repeated)


def test_matching_statistics_equal_naive():
    rng = np.random.default_rng(7)
    contexts = [rng.integers(0, 3, int(n)).astype(np.uint32) for n in rng.integers(1, 40, 12)]
    index = ri.RunIndex(contexts)
    match, context, place = index.matching_statistics()
    suffixes = sorted((tuple(int(w) + len(contexts) for w in c[p:]) + (i,), i, p) for i, c in enumerate(contexts) for p in range(len(c)))
    rows = np.arange(len(contexts), len(match))
    assert [(context[r], place[r]) for r in rows] == [(i, p) for _, i, p in suffixes]
    for k in range(1, len(rows)):
        x, y = suffixes[k - 1][0], suffixes[k][0]
        common = next(j for j in range(len(x)) if j >= len(y) or x[j] != y[j])
        assert match[rows[k]] == common
    assert len(index.start) < len(index.text)


def test_odd_rows(odd, nothing, make):
    assert found(odd) == [] and found(nothing) == []
    twice = make([(1, LONG), (1, LONG), (2, None), (3, "")], wide=True)
    assert found(twice) == []
    two = found(make([(1, LONG), (1, LONG), (2, LONG), (None, LONG)], wide=True))
    assert merged(two) == {(d, i) for d in (1, 2) for i in range(len(LONG.split()))}
