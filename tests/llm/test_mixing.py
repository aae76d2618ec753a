import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from oosgauge.llm.mixing import Mix, mix_sources


def fill(budget, caps, weights):
    """Deal by weight in rounds, a shortage back to the siblings that still have room."""
    got, open_ = dict.fromkeys(caps, 0.0), {k for k in caps if weights[k] > 0}
    while open_ and budget > 1e-9:
        share = sum(weights[k] for k in open_)
        given = {k: min(caps[k] - got[k], budget * weights[k] / share) for k in open_}
        for k, x in given.items():
            got[k] += x
        spent = sum(given.values())
        budget -= spent
        open_ = {k for k in open_ if caps[k] - got[k] > 1e-9}
    return got


def brute(rows, mix):
    tokens = defaultdict(int)
    for _, path, n in rows:
        tokens[path] += n
    total = sum(tokens.values()) * mix.budget

    def deal(budget, prefix):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        caps = defaultdict(float)
        for path, n in tokens.items():
            if path[:depth] == prefix:
                caps[path[depth]] += n * mix.epochs
        weights = {k: mix.weights[depth].get(k, mix.default) for k in caps}
        out = {}
        for k, x in fill(budget, caps, weights).items():
            out |= deal(x, (*prefix, k))
        return out

    want = []
    for path, x in deal(total, ()).items():
        mine = [(i, n) for i, p, n in rows if p == path]
        whole = min(mix.epochs, int(x / tokens[path] + 1e-9)) if tokens[path] else 0
        rest = x - whole * tokens[path] + 1e-3
        key = lambda i: hashlib.md5(f"{mix.seed}:{whole}:{'' if i is None else i}".encode()).hexdigest()
        upto = defaultdict(int)
        for i, n in mine:
            upto[key(i)] += n
        run, sums = 0, {}
        for k in sorted(upto):
            run += upto[k]
            sums[k] = run
        want += [(i, *path, n, whole + (sums[key(i)] <= rest) if n else 0) for i, n in mine]
    return sorted(want, key=str)


def check(spark, data, mix):
    df = spark.createDataFrame(data, "doc_id long, text string, a string, b string, c string, level_1 string")
    got = mix_sources(df, (F.col("a"), F.col("b"), F.col("c")), mix)
    rows = [(r[0], tuple(x or "" for x in r[2:5]), len((r[1] or "").split())) for r in data]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, mix)


def test_against_brute_force(spark):
    rng = random.Random(3)
    data = [
        (i, " ".join("w" * rng.randrange(1, 60)), rng.choice("pq"), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3"]), "own")
        for i in range(400)
    ]
    data += [(7, "a b", "p", "en", "s1", "x"), (7, "a b", "p", "en", "s1", "x"), (None, "c d e", "p", "en", "s1", None), (900, None, "p", "en", "s2", "x"), (901, "", "r", "x", "y", "z")]
    weights = ({"p": 9.0, "q": 1.0}, {"en": 1.0, "de": 3.0}, {"s2": 30.0, "s3": 0.0})
    for budget, epochs in ((0.3, 1), (0.6, 2), (1.7, 2), (5.0, 3), (0.0, 2)):
        check(spark, data, Mix(seed=5, epochs=epochs, budget=budget, weights=weights))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert mix_sources(df, (F.lit("x"), F.col("lang"), F.lit(None).cast("string"))).count() == 0
