import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np

from oosgauge.llm.lm_score import SIZE, Settings, levels, lm_scores


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def docs():
    rng = random.Random(11)
    vocab = ["The", "a", "É", "x1", "of", "rare%d", "and", "B"]
    rows = [(i, " ".join(rng.choice(vocab).replace("%d", str(rng.randrange(60))) for _ in range(rng.randrange(0, 120)))) for i in range(150)]
    return [*rows, (7, "dup dup"), (7, "dup dup"), (None, "no id\tThe"), (500, None), (501, "")]


def brute(rows, prior):
    train = Counter(w for d, t in rows if not held(d) for w in words(t))
    pairs = Counter(p for d, t in rows if not held(d) for p in zip([None, *words(t)], words(t)))
    n, v = sum(train.values()), len(train)
    rough = lambda c: SIZE[levels(np.array([c]))[0]] if c else 0.0
    p1 = lambda w: (rough(train[w]) + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for d, t in rows:
        toks = words(t)
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks)
        score = sum(math.log10(min(1, (rough(pairs[p]) + prior * p1(p[1])) / (rough(train[p[0]]) + prior))) for p in zip([None, *toks], toks))
        out.append((d, held(d), len(toks), sum(train[w] > 0 for w in toks), n, base, score))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-6
        assert abs(g[6] - w[6]) < 1e-6


#: so many bits that nothing is found that is not there
SURE = Settings(bits=64, probes=8)


def test_against_brute_force(spark):
    rows = docs()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int").repartition(3)
    close(lm_scores(df, SURE).collect(), brute(rows, SURE.prior))


def test_rare_tokens_by_join_and_filters_in_slices(spark):
    rows = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    close(lm_scores(df, replace(SURE, frequent=5)).collect(), brute(rows, SURE.prior))


def test_slices_cover_every_segment(spark):
    from oosgauge.llm import lm_score

    rows = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lm_score._slices
    lm_score._slices = lambda model, kind, segments, s: [(0, 20), (20, 21), (21, segments)] if kind else [(0, 40), (40, segments)]
    try:
        close(lm_scores(df, SURE).collect(), brute(rows, SURE.prior))
    finally:
        lm_score._slices = kept


def test_default_filter_is_close(spark):
    rows = docs()
    got = {(r.doc_id, r.n_tokens): r.score for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, _, n, _, _, _, score in brute(rows, Settings().prior):
        assert abs(got[d, n] - score) <= 0.05 * abs(score) + 1


def test_empty_table(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
