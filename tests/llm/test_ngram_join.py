import random
import re
from dataclasses import replace

from oosgauge.llm.ngram_join import Settings, jaccard_components


def shingles(text, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows):
    """Component of every row by comparing all pairs."""
    sets, top = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if a and 100 * inter >= 75 * (len(a) + len(sets[j]) - inter) and sets[j]:
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(n=160, seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") * rng.randrange(1, 3)
    prose = lambda k: [word() for _ in range(k)]
    hub, line, texts = prose(120), prose(30), []
    for i in range(n):
        w = list(hub) if i % 4 == 0 else prose(rng.randrange(3, 140)) + (line if i % 3 == 0 else [])
        if i % 4 != 1 or not texts:
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = word()
        else:  # a changed copy of an earlier one, so that chains arise
            w = texts[rng.randrange(len(texts))].split()
            for _ in range(rng.randrange(0, 1 + len(w) // 18)):
                w[rng.randrange(len(w))] = word()
        texts.append((" \n"[i % 2]).join(w))
    texts += [texts[0].upper(), texts[0], "one", "ONE", "one two", "", None, " \t", "a b c d e", "a b c d e f", "a b c d e f g"]
    return list(enumerate(texts, 100))


def check(spark, rows, s=Settings()):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, set int").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, s).collect()), key=str)
    assert got == brute(rows)


def test_against_brute_force(spark):
    check(spark, corpus())


def test_small_blocks_and_hot_ngrams(spark):
    from oosgauge.llm import ngram_join

    held = ngram_join.HOT
    ngram_join.HOT = 3
    try:
        check(spark, corpus(seed=9), replace(Settings(), block=600, per_segment=50))
    finally:
        ngram_join.HOT = held


def test_lone_copy_of_a_hot_passage_whose_first_posting_misfits(spark):
    passage, licence = [f"p{i}" for i in range(60)], [f"l{i}" for i in range(60)]
    edited = lambda i, at: " ".join([*passage[:at], f"x{i}", *passage[at + 1 :]])
    hot = [(0, " ".join(passage + licence))] + [(i, edited(i, 0)) for i in range(1, 80)]
    more = [(i, " ".join([*licence, *(f"y{i}_{j}" for j in range(80))])) for i in range(100, 220)]
    rows = [*hot, (500, edited(500, 59)), *more]
    parts = spark.sparkContext.parallelize([hot, rows[len(hot) :]], 2).flatMap(lambda part: part)
    df = spark.createDataFrame(parts, "doc_id long, text string")
    assert df.rdd.getNumPartitions() == 2
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == sorted(brute(rows))


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (None, "q r s t u v"), (9, "q r s t u v"), (None, "alone in here"), (3, None), (None, None)]
    check(spark, rows)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_of_a_block_join_what_all_pairs_join():
    import numpy as np

    from oosgauge.llm.ngram_join import ORDER_BITS, Settings, links_between

    rng, s = np.random.default_rng(5), Settings()
    for trial in range(60):
        m = int(rng.integers(2, 40))
        texts = [rng.choice(2**62, int(rng.integers(4, 30)), replace=False) for _ in range(4)]
        sets, seen = [], set()
        while len(sets) < m:
            t = texts[rng.integers(4)].copy()
            t[rng.integers(0, len(t), rng.integers(0, 6))] = rng.integers(0, 50)
            x = np.unique(t[: len(t) - rng.integers(0, 3)]).astype(np.uint64)
            if x.tobytes() not in seen:
                seen.add(x.tobytes())
                sets.append(x)
        labels = [int(x) for x in rng.integers(0, m, m)] if trial % 2 else list(range(m))
        probe = [bool(x) for x in rng.random(m) < 0.4] if trial % 3 else [True] * m
        order = rng.integers(0, 9, 1 << ORDER_BITS)

        def parts(links, by_label):
            top = list(range(m))
            find = lambda i: i if top[i] == i else find(top[i])
            for a, b in [*links, *((i, labels.index(x)) for i, x in enumerate(labels) if by_label)]:
                top[find(a)] = find(b)
            return [min(j for j in range(m) if find(j) == find(i)) for i in range(m)]

        alike = {(i, j) for i in range(m) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
        got = list(links_between(list(range(m)), sets, labels, probe, order, s))
        assert all((max(g), min(g)) in alike for g in got)
        must = parts([p for p in alike if probe[p[0]] or probe[p[1]]], True)
        may = parts(alike, True)
        joined = parts(got, True)
        assert all(joined[i] == joined[x] for i, x in enumerate(must)) and all(may[i] == may[x] for i, x in enumerate(joined))


def test_a_large_group_of_unlike_sets_is_settled_in_time():
    import time

    import numpy as np

    from oosgauge.llm.ngram_join import ORDER_BITS, Settings, links_between

    rng = np.random.default_rng(6)
    base = rng.choice(2**62, 60, replace=False).astype(np.uint64)
    sets = []
    for i in range(2500):  # half of a common passage each: no two are similar enough
        x = base.copy()
        x[rng.choice(60, 25, replace=False)] = rng.choice(2**62, 25).astype(np.uint64)
        sets.append(np.unique(x))
    began = time.process_time()
    got = list(links_between(list(range(2500)), sets, list(range(2500)), [True] * 2500, np.zeros(1 << ORDER_BITS, np.int64), Settings()))
    assert not got and time.process_time() - began < 20
