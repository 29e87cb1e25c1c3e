import re
from collections import Counter, defaultdict

import numpy as np
from cases import D1, ODD

from pageloom.llm import decontaminate as dc
from pageloom.llm._spark import table

ITEM = "A farmer named Alice has 12 apples and gives 5 of them to Robert on the way to the old market near the river"


def slots(text):
    """Template tokens and slot values, token by token."""
    out, before = [], False
    for word in text.split():
        letters = [i for i, c in enumerate(word) if c.isalpha() or c in "0123456789"]
        if not letters:
            continue
        w = word[letters[0] : letters[-1] + 1]
        number = w[0] in "0123456789"
        unit = before and w.lower() in dc.UNITS and not number
        name = len(w) > 1 and w[0].isupper() and not w[1].isupper()
        out.append(("#NUM", w.lower()) if number else ("#UNIT", w.lower()) if unit else ("#NAME", w.lower()) if name else (w.lower(), None))
        before = number
    return out


def windows(text, widths=None):
    t = slots(text)
    for size in widths or [min(len(t), dc.WINDOW)]:
        for i in range(len(t) - size + 1 if t else 0):
            part = t[i : i + size]
            if size == dc.WINDOW and any(v is None for _, v in part):
                yield tuple(k for k, _ in part), i, tuple(v for _, v in part)
            else:
                yield ("=", *(k if v is None else v for k, v in part)), i, (None,) * size


def consistent(found):
    to, fro = defaultdict(Counter), defaultdict(Counter)
    for _, _, x, y in found:
        for a, b in zip(x, y):
            if a is not None:
                to[a][b] += 1
                fro[b][a] += 1
    top = lambda c, k: {v for v, n in c[k].items() if n == max(c[k].values())}
    return len({i for i, _, x, y in found if all(a is None or (b in top(to, a) and a in top(fro, b)) for a, b in zip(x, y))})


def brute(docs, items):
    index, total, widths = defaultdict(list), {}, set()
    for item, text in items:
        own = list(windows(text))
        widths.add(min(len(slots(text)), dc.WINDOW))
        total[item] = len({i for _, i, _ in own})
        for key, i, values in own:
            index[key].append((item, i, values))
    out = {}
    for doc, text in docs:
        found = defaultdict(set)
        for key, at, values in windows(text, sorted(widths - {0})):
            for item, i, mine in index[key]:
                found[item].add((i, at - i, mine, values))
        for item, f in found.items():
            parts, one = [f], []
            for w in sorted(f, key=lambda w: w[1]):
                if one and w[1] > one[-1][1] + dc.SLACK:
                    parts.append(one)
                    one = []
                one.append(w)
            good = max(consistent(x) for x in [*parts, one])
            if good >= dc.COVER * total[item]:
                out[doc, item] = good / total[item]
    return out


def test_equals_brute_force(spark):
    docs, items = table(spark, D1, "documents"), table(spark, D1, "benchmark")
    want = brute(docs.select("doc_id", "text").collect(), items.collect())
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, items).collect()}
    assert got == set(want) and len(got) > 0


def leaks(make, items, docs):
    spark = items[0]
    bench = spark.createDataFrame(items[1], "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in dc.leaks(make(docs), bench).collect()}


def test_other_names_and_numbers_are_found(spark, make):
    filler = "and then some quite unrelated words follow here "
    same = ITEM.replace("Alice", "Zoe").replace("12", "340").replace("5", "77").replace("Robert", "Igor")
    mixed = re.sub("Robert", "Alice", ITEM)  # two slots of the item become one
    docs = [(1, filler + ITEM + filler), (2, filler + same), (3, filler * 9), (4, same.upper()), (5, mixed)]
    got = leaks(make, (spark, [(7, ITEM), (7, ITEM), (8, None), (None, ITEM), (9, ""), (10, "too short")]), docs)
    assert {(1, 7), (2, 7)} <= got and not {d for d, _ in got} & {3}


def test_slots_must_be_consistent():
    item = "x = A plus B gives C when A meets B"
    win = list(windows(item))
    same = lambda m: [(i, i, np.array([0 if v is None else hash(v) % 1000 + 1 for v in vs], np.uint64).tobytes(), np.array([0 if v is None else m(v) for v in vs], np.uint64).tobytes()) for _, i, vs in win]
    assert dc.consistent_windows(same(lambda v: hash(v) % 1000 + 5000)) == {i for _, i, _ in win}


def test_arithmetic_short_items_and_several_versions(spark, make):
    filler = "and then some quite unrelated words follow here "
    sums = "12 + 7 = 19 , 14 + 8 = 22 , 15 + 9 = 24"
    pens = "Anna bought 3 red pens, Boris sold 4 blue cups, Carla lost 5 green hats"
    other = "Dora bought 6 red pens, Emil sold 9 blue cups, Frida lost 8 green hats"
    items = [(1, sums), (2, "water boils quickly"), (3, pens)]
    docs = [(1, filler + sums + " " + filler), (2, filler + "the Water boils quickly, " + filler), (3, filler + pens + " " + filler), (4, f"{other} {filler} {pens} {filler} {other}"), (5, filler + sums.replace("7", "6").replace("9", "3") + filler), (6, filler * 3), (7, f"{filler * 400}{other}")]
    assert leaks(make, (spark, items), docs) == {(1, 1), (2, 2), (3, 3), (4, 3), (7, 3)}


def test_repeated_rows(spark, make):
    half = len(ITEM) // 2
    docs = [(1, ITEM), (1, ITEM), (2, ITEM[:half]), (2, ITEM[half:])]
    assert (1, 7) in leaks(make, (spark, [(7, ITEM), (7, ITEM)]), docs)


def test_odd_rows(spark, odd, nothing):
    bench = table(spark, D1, "benchmark")
    assert dc.leaks(odd, bench).count() == 0
    kept = dc.apply(odd, dc.leaks(odd, bench))
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert dc.leaks(odd, bench.limit(0)).count() == 0
    assert dc.leaks(nothing, bench).count() == 0 and dc.apply(nothing, dc.leaks(nothing, bench)).count() == 0
    wide = bench.withColumn("win", dc.F.lit("x")).withColumn("place", dc.F.lit("y")).withColumn("total", dc.F.lit(1))
    assert dc.leaks(odd, wide).count() == 0
