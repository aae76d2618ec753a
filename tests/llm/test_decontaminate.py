import random

import numpy as np

from oosgauge.llm.decontaminate import Settings, align, clean, contaminated, folded
from oosgauge.llm.text import WordNames


def brute(docs, items, s=Settings()):
    """Every item against every whole document."""
    names, out = WordNames(), set()
    for d, t in docs:
        for i, x in items:
            a, b = names(folded((x or "").encode())), names(folded((t or "").encode()))
            if len(a) >= s.min_words and len(b) and align(a, b, s)[0] >= s.threshold * s.match * len(a):
                out.add((d, i))
    return out


def data():
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice(["", "q", "rs"])
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, prose(rng.randrange(20, 60))) for i in range(12)]
    docs = []
    for i in range(60):
        w = prose(rng.randrange(0, 200))
        if i % 3 == 0:
            copy = list(items[i % 12][1])
            for _ in range(rng.randrange(0, 1 + len(copy) // 5)):  # a fifth of the words changed, dropped or added
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice(([word()], [], [copy[at], word()]))
            w = w[:40] + copy + w[40:]
        docs.append((i, (", ".join(w)).upper() if i % 2 else "\n".join(w)))
    return docs, [(i, " ".join(w)) for i, w in items]


def test_against_brute_force(spark):
    docs, items = data()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    for s in (Settings(), Settings(slice_chars=500)):
        got = {(r.doc_id, r.item_id) for r in contaminated(df, bench, s).collect()}
        assert got == brute(docs, items)
        dirty = {d for d, _ in got}
        assert sorted(r.doc_id for r in clean(df, bench, s).collect()) == [d for d, _ in docs if d not in dirty]


def test_alignment():
    a, s = np.arange(10, dtype=np.uint64), Settings()
    assert align(a, a, s) == (20, 10, 0, 9)
    assert align(a, np.concatenate([a[:5], a[6:]]), s)[0] == 17
    assert align(a, a + np.uint64(100), s)[0] == 0


def test_odd_rows(spark):
    _, items = data()
    text = "before " + items[0][1] + " after"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "w " * 30_000 + items[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame([(0, items[0][1]), (0, items[0][1]), (5, "too short"), (6, None), (None, items[1][1])], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id, r.score, r.first_word) for r in contaminated(docs, bench).collect()))
    assert got == [(0, 0, 1.0, 1), (1, 0, 1.0, 1), (1, 0, 1.0, 1), (4, 0, 1.0, 30_000)]
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0
    assert clean(docs, bench.limit(0)).count() == 6 and clean(docs, bench).columns == ["doc_id", "text"]
