import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oosgauge.llm.hard_negatives import EXACT, PRIMES, TILE, Settings, best, exact_scores, hard_negatives, primes_for, residues

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, row string"


def slow(rows, every=10, s=Settings()):
    """All pairs in Python integers."""
    live = [
        (i, [int(np.floor(256 * x)) for x in v], lab)
        for i, v, lab in rows
        if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for at, (anchor, a, lab) in enumerate(live):
        if anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), i, other) for k, (i, b, other) in enumerate(live) if k != at]
        scored.sort(key=lambda x: x[:2])
        for p, pid, _ in [x for x in scored if x[2] == lab][: s.positives]:
            near = [x for x in scored if x[2] != lab and s.low * -p <= 100 * -x[0] <= s.high * -p][: s.negatives]
            out += [(anchor, pid, r + 1, n[1], -p, -n[0]) for r, n in enumerate(near)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 10 == 0, **kw).collect())


def test_primes():
    assert len(set(PRIMES)) == len(PRIMES) and all(TILE * ((p - 1) // 2) ** 2 < EXACT for p in PRIMES)
    assert np.prod([float(p) for p in primes_for(70_000)]) > 140_000 and len(primes_for(70_000)) == 2


@pytest.mark.parametrize("top", [3, 300, 1 << 20, 1 << 40, 1e30, 1e200])
def test_residues_give_the_integers(rng, top):
    a, b = np.floor(rng.uniform(-top, top, (7, 150))), np.floor(rng.uniform(-top, top, (9, 150)))
    want = [[sum(int(x) * int(y) for x, y in zip(r, q)) for q in b] for r in a]
    primes = primes_for(max(abs(x) for r in want for x in r))
    got = exact_scores({p: residues(a, p) for p in primes}, {p: residues(b, p) for p in primes}, primes)
    assert [[int(x) for x in r] for r in got] == want


def test_best_takes_the_first_of_equals():
    rows, cols = best(np.array([[5, 7, 7, 7, 1], [0, 0, 0, 0, 0]]), np.array([[1, 1, 0, 1, 1], [0, 0, 0, 0, 1]], bool), 2)
    assert sorted(zip(rows.tolist(), cols.tolist())) == [(0, 1), (0, 3), (1, 4)]


def test_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i, [round(rng.uniform(-0.4, 0.6), 1) for _ in range(6)], rng.randrange(3)) for i in range(260)]
    rows += [(i, [0.5] * 6, 1) for i in range(300, 420)] + [(i, rows[0][1], 2) for i in range(420, 440)]  # copies, ties
    assert run(spark, rows) == slow(rows)
    assert run(spark, rows, settings=Settings(block=7, step=3)) == slow(rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [], 2), (3, [0.9, 1.9, 5.0], 2), (4, None, 1), (5, [None, 1.0], 1), (6, [float("nan")], 1), (7, [float("inf")], 2),
        (None, [1.0, 2.0], 1), (8, [1.0, 2.0], None), (10, [3e9, 4e9], 3), (11, [3e9, 3e9], 3), (12, [2.9e9, 3e9], 4), (20, [-1.0, 0.0], 5), (21, [1.0, 0.0], 5), (30, [0.0], 6), (31, [0.0], 6),
    ]
    assert run(spark, rows) == [(a, p, r, n, min(max(x, -(2**63) + 1), 2**63 - 1), min(max(y, -(2**63) + 1), 2**63 - 1)) for a, p, r, n, x, y in slow(rows)]
    assert run(spark, rows[:0]) == []
    assert run(spark, [(1, [1.0], 1)]) == []
