"""Hard negatives by exact inner products in residue arithmetic.

Integer vectors are multiplied modulo several small primes. Centred residues are so small that
``TILE`` products of them add up exactly in float32, so each residue matrix is one fast float32
product; Chinese remaindering of the residues gives the signed integer scores back. How many
primes a meeting of rows needs follows from the lengths of its vectors, so the scores are exact
whatever the components are.

Anchors are dealt to blocks and all rows to stripes; each (block, stripe) is one stream: its
anchors first, then the stripe's rows in batches. A stream keeps the best few rows per anchor, so
what leaves it does not grow with the stripe. The first pass finds each anchor's positives, the
second the rows in the window of each positive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oosgauge.session import parallelism, stable

#: inner dimensions of one float32 product
TILE = 64
#: below it, sums of float32 integers are exact
EXACT = 1 << 24
#: the largest scaled component; the primes reach to the square of it
LARGEST = 1e200


def primes_below(top: int) -> Iterator[int]:
    for p in range(top - 1, 2, -1):
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            yield p


#: the largest primes whose centred residues add up exactly: TILE * ((p - 1) / 2) ** 2 < EXACT
PRIMES = [p for p in primes_below(2 * math.isqrt((EXACT - 1) // TILE) + 2) if TILE * ((p - 1) // 2) ** 2 < EXACT]


def primes_for(bound: int) -> list[int]:
    """So many primes that every integer of absolute value up to ``bound`` has residues of its own."""
    out, product = [], 1
    while not out or product <= 2 * bound:
        if len(out) == len(PRIMES):
            raise ValueError("vectors too large for the residue system")
        out.append(PRIMES[len(out)])
        product *= out[-1]
    return out


def residues(m: np.ndarray, p: int) -> np.ndarray:
    """Centred residues of integer-valued doubles, as float32. ``fmod`` is exact at any size."""
    r = np.fmod(m, p)
    half = (p - 1) // 2
    return np.where(r > half, r - p, np.where(r < -half, r + p, r)).astype(np.float32)


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p`` in 0..p-1, from residue matrices, ``TILE`` dimensions at a time."""
    out = None
    for s in range(0, a.shape[1], TILE):
        part = (a[:, s : s + TILE] @ b[:, s : s + TILE].T).astype(np.int32)
        out = part % p if out is None else (out + part) % p
    return np.zeros((len(a), len(b)), np.int32) if out is None else out


def exact_scores(a: dict[int, np.ndarray], b: dict[int, np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed inner products from the residues by mixed radix digits: int64, or Python ints beyond it."""
    total = math.prod(primes)
    value, weight = product_mod(a[primes[0]], b[primes[0]], primes[0]).astype(np.int64 if total < 1 << 62 else object), primes[0]
    for p in primes[1:]:
        digit = (product_mod(a[p], b[p], p) - (value % p).astype(np.int64)) * pow(weight, -1, p) % p
        value = value + (digit if value.dtype != object else digit.astype(object)) * weight
        weight *= p
    return np.where(value > total // 2, value - total, value)


class Rows:
    """A batch of vectors: ids, labels, row keys, and integer components in ascending order of (id, key)."""

    def __init__(self, cols: dict[str, list]):
        self.key = np.array(cols["row"], np.int64)
        self.id = np.array(cols["vec_id"], np.int64)
        self.label = np.array(cols["label"], np.int64)
        small, large = cols["small"], cols["large"]
        width = max((len(s) // 2 if s is not None else len(t) // 8 for s, t in zip(small, large)), default=0)
        self.m = np.zeros((len(self.id), width))
        for i, (s, t) in enumerate(zip(small, large)):
            v = np.frombuffer(s, np.int16) if s is not None else np.frombuffer(t, np.float64)
            self.m[i, : len(v)] = v
        self._take(self, np.lexsort((self.key, self.id)))

    def _take(self, of: Rows, at) -> Rows:
        self.key, self.id, self.label, self.m, self.kept = of.key[at], of.id[at], of.label[at], of.m[at], {}
        self.length = self._length()
        return self

    def part(self, at: slice) -> Rows:
        return object.__new__(Rows)._take(self, at)

    def _length(self) -> int:
        """At least the largest Euclidean length."""
        if not self.m.size:
            return 0
        top = int(np.abs(self.m).max())
        if top < 1 << 20:
            return math.isqrt(int((self.m * self.m).sum(axis=1).max())) + 1
        return top * (math.isqrt(self.m.shape[1]) + 1)

    def widened(self, width: int) -> Rows:
        if self.m.shape[1] < width:
            self.m, self.kept = np.pad(self.m, ((0, 0), (0, width - self.m.shape[1]))), {}
        return self

    def residue(self, p: int) -> np.ndarray:
        if p not in self.kept:
            self.kept[p] = residues(self.m, p)
        return self.kept[p]


def scores(a: Rows, b: Rows) -> np.ndarray:
    """All inner products of two batches; a shorter vector is zero beyond its end."""
    width = max(a.m.shape[1], b.m.shape[1])
    a, b = a.widened(width), b.widened(width)
    primes = primes_for(a.length * b.length)
    return exact_scores({p: a.residue(p) for p in primes}, {p: b.residue(p) for p in primes}, primes)


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest allowed scores of each row, the earlier column first in ties."""
    n = score.shape[1]
    if score.dtype != object and max(abs(int(score.max(initial=0))), abs(int(score.min(initial=0)))) >= (1 << 61) // max(n, 1):
        score = score.astype(object)
    rank = score * n + (n - 1 - np.arange(n))
    low = -(1 << 62) if rank.dtype != object else int(rank.min()) - 1
    rank = np.where(allowed, rank, low)
    k = min(k, n)
    if rank.dtype == object:
        cols = np.argsort(-rank, axis=1, kind="stable")[:, :k]
    else:
        cols = np.argpartition(-rank, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(rank), 1))
    rows = np.repeat(np.arange(len(score)), k)
    cols = cols.ravel()
    use = allowed[rows, cols]
    return rows[use], cols[use]


@dataclass(frozen=True)
class Settings:
    """``positives`` and ``negatives`` per anchor; negatives score from ``low`` to ``high`` hundredths of the positive."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    #: anchors of one block, and of one product
    block: int = 4096
    step: int = 128


class Tops:
    """The best rows so far of each (anchor, slot) of a block."""

    def __init__(self, k: int):
        self.k = k
        self.slot, self.score, self.id, self.key = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, slot, score, ids, keys) -> None:
        kind = object if object in (score.dtype, self.score.dtype) else np.int64
        slot, ids, keys = np.concatenate([self.slot, slot]), np.concatenate([self.id, ids]), np.concatenate([self.key, keys])
        score = np.concatenate([self.score.astype(kind), score.astype(kind)])
        by = np.lexsort((keys, ids, -score, slot)) if kind is not object else np.array(sorted(range(len(slot)), key=lambda i: (slot[i], -score[i], ids[i], keys[i])), np.int64)
        slot = slot[by]
        start = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        place = np.arange(len(slot)) - np.repeat(start, np.diff(np.concatenate([start, [len(slot)]])))
        use = place < self.k
        self.slot, self.score, self.id, self.key = slot[use], score[by][use], ids[by][use], keys[by][use]


def _positives(a: Rows, b: Rows, s: Settings, _slots) -> Iterator[tuple]:
    got = scores(a, b)
    rows, cols = best(got, (a.label[:, None] == b.label[None, :]) & (a.key[:, None] != b.key[None, :]), s.positives)
    yield rows, 0, got[rows, cols], b.id[cols], b.key[cols]


def _negatives(a: Rows, b: Rows, s: Settings, slots) -> Iterator[tuple]:
    got = scores(a, b)
    other = a.label[:, None] != b.label[None, :]
    if got.size and got.dtype != object and max(abs(int(got.max())), abs(int(got.min()))) * max(s.low, s.high, 100) >= 1 << 62:
        got = got.astype(object)
    hundred = 100 * got
    for j in range(s.positives):
        goal = slots[:, j]
        has = np.array([x is not None for x in goal])
        if not has.any():
            continue
        goal = np.array([0 if x is None else x for x in goal], object if got.dtype == object or max(abs(x or 0) for x in goal) * max(s.low, s.high) >= 1 << 62 else np.int64)
        inside = other & has[:, None] & (hundred >= s.low * goal[:, None]) & (hundred <= s.high * goal[:, None])
        rows, cols = best(got, inside.astype(bool), s.negatives)
        yield rows, j, got[rows, cols], b.id[cols], b.key[cols]


_FOUND = "anchor long, slot int, score string, id long, row long"


def _streams(work: Callable, k: int, s: Settings):
    """Rows arrive by group, anchors first; the best ``k`` of each anchor and slot leave."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        group, anchors, parts, goals, tops = None, [], [], [], None

        def flush():
            if tops is None or not len(tops.slot):
                return
            block, slot = np.divmod(tops.slot, s.positives)
            found = [pa.array(anchors.key[block]), pa.array(slot.astype(np.int32)), pa.array([str(x) for x in tops.score]), pa.array(tops.id), pa.array(tops.key)]
            yield pa.RecordBatch.from_arrays(found, ["anchor", "slot", "score", "id", "row"])

        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in b.schema.names}
            groups, kinds, at = cols["_group"], cols["_anchor"], 0
            while at < b.num_rows:
                to = at
                while to < b.num_rows and groups[to] == groups[at] and kinds[to] == kinds[at]:
                    to += 1
                if groups[at] != group:
                    yield from flush()
                    group, anchors, goals, tops = groups[at], [], [], None
                part = {c: v[at:to] for c, v in cols.items()}
                if kinds[at] == 0:
                    anchors.append(part)
                elif anchors:
                    if tops is None:
                        whole = {c: [x for p in anchors for x in p[c]] for c in part}
                        goals = {r: g for r, g in zip(whole["row"], whole["goals"])}
                        anchors, tops = Rows(whole), Tops(k)
                        goals = np.array([[*((int(x) for x in goals[r] or ())), *[None] * s.positives][: s.positives] for r in anchors.key.tolist()], object)
                        parts = [(i, anchors.part(slice(i, i + s.step))) for i in range(0, len(anchors.id), s.step)]
                    rows = Rows(part)
                    for i, some in parts:
                        for r, slot, score, ids, keys in work(some, rows, s, goals[i : i + s.step]):
                            tops.add((r + i) * s.positives + slot, score, ids, keys)
                at = to
        yield from flush()

    return run


def _pass(rows: DataFrame, anchors: DataFrame, count: int, work: Callable, k: int, s: Settings) -> DataFrame:
    """``anchor, slot, score, id, row``: the best ``k`` of every anchor and slot, over all stripes."""
    spark = rows.sparkSession
    slots = parallelism(spark)
    blocks = max(1, -(-count // s.block))
    stripes = max(1, -(-4 * slots // blocks))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("_block", deal(blocks)).withColumn("_stripe", many(stripes)).withColumn("_anchor", F.lit(0))
    right = rows.withColumn("goals", F.lit(None).cast("array<string>")).withColumn("_stripe", deal(stripes)).withColumn("_block", many(blocks)).withColumn("_anchor", F.lit(1))
    both = left.unionByName(right).withColumn("_group", F.col("_block") * stripes + F.col("_stripe")).drop("_block", "_stripe")
    both = both.repartition(min(blocks * stripes, 4 * slots), "_group").sortWithinPartitions("_group", "_anchor")
    found = both.mapInArrow(_streams(work, k, s), _FOUND)
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*_descending("score"), "id", "row"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def _descending(c: str) -> list[Column]:
    """Order of integers written as text, of any length: sign and digits, then the digits."""
    below = F.col(c).startswith("-")
    return [F.when(below, -F.length(c)).otherwise(F.length(c)).desc(), F.when(~below, F.col(c)).desc(), F.when(below, F.col(c)).asc()]


def _long(c: str) -> Column:
    """The nearest long of an integer written as text."""
    below, most = F.col(c).startswith("-"), (1 << 63) - 1
    return F.when(F.length(c) < 19, F.col(c).cast("long")).otherwise(F.coalesce(F.col(c).try_cast("long"), F.when(below, F.lit(-most)).otherwise(F.lit(most))))


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """``row, vec_id, label, small, large``: components floor(scale * x), as int16 where all fit, else doubles.

    Rows without id or label, without vector, or with a null or non-finite component take no
    part, nor do those with a scaled component over ``LARGEST``.
    """
    picked = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vec).cast("array<double>").alias("v")
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    schema = "vec_id long, label long, small binary, large binary"

    def run(batches):
        for b in batches:
            column = b.column("v")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(scale * np.asarray(flat, np.float64))
            ends = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
            odd = np.concatenate([[0], np.cumsum(~(np.abs(flat) <= LARGEST))])
            big = np.concatenate([[0], np.cumsum(~(np.abs(flat) < 1 << 15))])
            use = np.flatnonzero(odd[ends[1:]] == odd[ends[:-1]])
            small, large = [], []
            for i in use:
                v = flat[ends[i] : ends[i + 1]]
                fits = big[ends[i]] == big[ends[i + 1]]
                small.append(v.astype(np.int16).tobytes() if fits else None)
                large.append(None if fits else v.tobytes())
            keep = pa.array(use)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(keep), b.column("label").take(keep), pa.array(small, pa.binary()), pa.array(large, pa.binary())],
                ["vec_id", "label", "small", "large"],
            )

    return picked.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", settings: Settings | None = None
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` holds.

    ``anchor`` is a condition on ``vec_id`` and ``label``. Scores are integer inner products of floor(256 * x); higher ones
    come first, ties by smaller id, then in any fixed order. A positive is another row of the anchor's label, also one with
    equal id or vector. Rows without label, id, vector or a finite component take no part; a
    shorter vector counts as zero beyond its end, so an empty one scores 0 with all. Anchors
    without positives, and positives without negatives, give no rows; an empty table none.
    Further columns are left out. Scores beyond a long are exact in order and written as the
    nearest long.
    """
    s = settings or Settings()
    rows = stable(integer_rows(vectors, id_col, vec, label))
    bare = rows.filter(anchor).withColumn("goals", F.lit(None).cast("array<string>"))
    count = bare.count()
    positives = stable(_pass(rows, bare, count, _positives, s.positives, s))
    goals = positives.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("goals"))
    ready = rows.filter(anchor).join(goals, F.col("row") == F.col("anchor")).drop("anchor")
    found = _pass(rows, ready, count, _negatives, s.negatives, s)
    names = rows.filter(anchor).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    chosen = positives.select("anchor", (F.col("place") - 1).alias("slot"), F.col("id").alias("positive_id"), _long("score").alias("positive_score"))
    return found.select("anchor", "slot", F.col("place").alias("rank"), F.col("id").alias("negative_id"), _long("score").alias("negative_score")).join(
        chosen, ["anchor", "slot"]
    ).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
