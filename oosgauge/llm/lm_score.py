"""Language-model scores from a log-frequency Bloom filter.

Training counts of single tokens and pairs are merged by name in segments. A count c enters the
filter as the members (name, 1) ... (name, 1 + floor(log2 c)); asking for level after level
until one is missing gives the count's size back. The filter goes to all workers in slices
of bounded size, and each position of a text is scored in the one pass that holds its pair and
both its tokens; with room for the whole filter that is one pass.

The base score needs exact counts: frequent tokens come from a bounded table that all
workers hold, the rest by a join on the token.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oosgauge.llm.text import M1, M2, U64, WordNames, mix, per_batch, pick, raw
from oosgauge.session import stable

END = U64(0x656E64)
ONE, PAIR = 0, 1
#: tokens counted in memory before they are handed on
FLUSH = 1_000_000


@dataclass(frozen=True)
class Settings:
    bits: int = 8  # of the filter for each member
    probes: int = 4
    prior: float = 4.0  # weight of the single-token probability in a pair's
    slice_mb: int = 192  # most of a filter sent at once
    frequent: int = 250_000  # most tokens in the exact table sent to all; the others are joined
    per_segment: int = 1_000_000


def tokens(names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a group of texts, each one's predecessor, and the texts' bounds; the end stands before the first too."""
    tok, prev = np.insert(names, bounds[1:], END), np.insert(names, bounds[:-1], END)
    return tok, prev, bounds + np.arange(len(bounds))


def pair_names(prev: np.ndarray, tok: np.ndarray) -> np.ndarray:
    return mix(prev * M1 + (tok ^ (tok >> U64(31))) * M2)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


#: the middle of the counts of a level; level 0 is none
SIZE = np.array([0.0] + [(2.0 ** (q - 1) + 2.0**q - 1) / 2 for q in range(1, 64)])


def _lower(b: pa.RecordBatch) -> list[bytes]:
    return [(t or b"").lower() for t in raw(b.column("text"))]


def counted(rows: DataFrame, segments: int) -> DataFrame:
    """``kind, seg, names, counts`` of training texts, summed within tasks; arrays are packed."""
    shift = U64(64 - int(segments).bit_length() + 1)

    class Count:
        def __init__(self):
            self.names, self.held, self.n = WordNames(), ([], []), 0

        def __call__(self, b):
            for _, names, bounds in self.names.grouped(_lower(b)):
                tok, prev, _ = tokens(names, bounds)
                self.held[ONE].append(tok)
                self.held[PAIR].append(pair_names(prev, tok))
                self.n += len(tok)
                if self.n > FLUSH:
                    yield from self.close()

        def close(self):
            for kind in (ONE, PAIR):
                if self.held[kind]:
                    u, n = np.unique(np.concatenate(self.held[kind]), return_counts=True)
                    seg = (u >> shift).astype(np.int64) if segments > 1 else np.zeros(len(u), np.int64)
                    cut = np.searchsorted(seg, np.arange(segments + 1))
                    full = np.flatnonzero(np.diff(cut))
                    cols = [[x[cut[i] : cut[i + 1]].tobytes() for i in full] for x in (u, n.astype(np.uint32))]
                    arrays = [pa.array(np.full(len(full), kind)), pa.array(full), *(pa.array(c, pa.binary()) for c in cols)]
                    yield pa.RecordBatch.from_arrays(arrays, ["kind", "seg", "names", "counts"])
            self.held, self.n = ([], []), 0

    return per_batch(rows, "kind long, seg long, names binary, counts binary", Count)


def _merge(s: Settings):
    """A segment's counts, its part of the filter, and how many names each level has."""

    def run(key, t):
        names = np.concatenate([np.frombuffer(x, U64) for x in t.column("names").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("counts").to_pylist()])
        names, where = np.unique(names, return_inverse=True)
        counts = np.bincount(where, counts).astype(np.int64)
        level = levels(counts)
        bits = 64 * -(-int(level.sum()) * s.bits // 64)
        table = np.zeros(bits, bool)
        for q in range(1, int(level.max()) + 1):
            for at in probes(names[level >= q], q, U64(bits), s.probes):
                table[at] = True
        exact = key[0].as_py() == ONE
        return pa.table(
            {
                "kind": key[:1], "seg": key[1:], "distinct": [len(names)], "total": [int(counts.sum())], "bits": [bits],
                "filter": [np.packbits(table, bitorder="little").tobytes()],
                "names": [names.tobytes() if exact else b""], "counts": [counts.tobytes() if exact else b""],
                "by_level": [np.bincount(level, minlength=64).tolist()],
            },
            schema=pa.schema([("kind", pa.int64()), ("seg", pa.int64()), ("distinct", pa.int64()), ("total", pa.int64()), ("bits", pa.int64()),
                              ("filter", pa.binary()), ("names", pa.binary()), ("counts", pa.binary()), ("by_level", pa.list_(pa.int64()))]),
        )

    return run


MODEL = "kind long, seg long, distinct long, total long, bits long, filter binary, names binary, counts binary, by_level array<long>"


def probes(names: np.ndarray, level: int, bits, k: int):
    """Bit positions of (name, level), ``k`` arrays; ``bits`` may differ by name and is under 2^32."""
    h = mix(names + U64(level) * M2)
    step = mix(h) | U64(1)
    for _ in range(k):
        yield ((h >> U64(32)) * bits) >> U64(32)
        h = h + step


class Filter:
    """Some segments of one kind's filter, from the first to before the last."""

    def __init__(self, segments: int, first: int, parts: list[tuple[int, int, bytes]], k: int):
        self.shift, self.first, self.k = U64(64 - int(segments).bit_length() + 1), first, k
        self.one = segments == 1
        self.last = first + len(parts)
        self.bits = np.array([p[1] for p in parts], U64)
        self.start = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])])[:-1].astype(U64)
        self.data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)

    def seg(self, names: np.ndarray) -> np.ndarray:
        return np.zeros(len(names), np.int64) if self.one else (names >> self.shift).astype(np.int64)

    def has(self, names: np.ndarray) -> np.ndarray:
        seg = self.seg(names)
        return (self.first <= seg) & (seg < self.last)

    def size(self, names: np.ndarray) -> np.ndarray:
        """Estimated counts by repeated probes."""
        seg = self.seg(names) - self.first
        bits, start = self.bits[seg], self.start[seg]
        level, alive, q = np.zeros(len(names), np.int64), np.arange(len(names)), 0
        left = [names, bits, start, alive]
        while len(left[3]):
            q += 1
            names, bits, start, alive = left
            h = mix(names + U64(q) * M2)
            step = mix(h) | U64(1)
            for _ in range(self.k):
                at = ((h >> U64(32)) * bits) >> U64(32)
                hit = (self.data[start + (at >> U64(3))] >> (at & U64(7)).astype(np.uint8)) & 1 > 0
                names, bits, start, alive, h, step = (x[hit] for x in (names, bits, start, alive, h, step))
                h += step
            level[alive] = q
            left = [names, bits, start, alive]
        return SIZE[level]


def fit(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, int]:
    """The model table of ``doc_id, text`` rows, a row per kind and segment, and the number of segments."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()[0]
    segments = 64
    while segments * s.per_segment < size // 5:
        segments *= 2
    return stable(counted(docs, segments).groupBy("kind", "seg").applyInArrow(_merge(s), MODEL)), segments


def _slices(model: DataFrame, kind: int, segments: int, s: Settings) -> list[tuple[int, int]]:
    """Ranges of segments whose filters are under the limit together; every segment is in one."""
    size = {r.seg: r.bits // 8 for r in model.filter(F.col("kind") == kind).select("seg", "bits").collect()}
    out, first, held = [], 0, 0
    for seg in range(segments):
        if held and held + size.get(seg, 0) > s.slice_mb << 20:
            out.append((first, seg))
            first, held = seg, 0
        held += size.get(seg, 0)
    return [*out, (first, segments)]


def _load(model: DataFrame, kind: int, part: tuple[int, int], segments: int, k: int) -> Filter:
    rows = model.filter((F.col("kind") == kind) & (F.col("seg") >= part[0]) & (F.col("seg") < part[1])).select("seg", "bits", "filter")
    got = {r.seg: (r.seg, r.bits, bytes(r.filter)) for r in rows.toLocalIterator()}
    return Filter(segments, part[0], [got.get(i, (i, 0, b"")) for i in range(*part)], k)


def _flat(model: DataFrame, least: int, most: int) -> DataFrame:
    """``name, n``: exact counts of tokens whose level is from ``least`` to ``most``."""

    def make():
        def step(b):
            for names, counts in zip(b.column("names").to_pylist(), b.column("counts").to_pylist()):
                n, c = np.frombuffer(names, np.int64), np.frombuffer(counts, np.int64)
                level = levels(c)
                keep = (level >= least) & (level <= most)
                yield pa.RecordBatch.from_arrays([pa.array(n[keep]), pa.array(c[keep])], ["name", "n"])

        return step

    return per_batch(model.filter(F.col("kind") == ONE).select("names", "counts"), "name long, n long", make)


def _packed(model: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens' names in order and counts; as many as the settings allow."""

    def make():
        def step(b):
            n, c = (b.column(x).to_numpy(zero_copy_only=False) for x in ("name", "n"))
            yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["names", "counts"])

        return step

    rows = per_batch(_flat(model, least, 64), "names binary, counts binary", make).collect()
    names = np.concatenate([np.frombuffer(r[0], U64) for r in rows] or [np.zeros(0, U64)])
    counts = np.concatenate([np.frombuffer(r[1], np.int64) for r in rows] or [np.zeros(0, np.int64)])
    order = np.argsort(names)
    return names[order], counts[order]


def _score(docs: DataFrame, table, filters, base: bool) -> DataFrame:
    """Of each row: the log probabilities of the positions that these slices cover (``part``).

    With ``base`` also token counts, the base score over frequent tokens, and the other tokens
    with their times.
    """
    carried = ("doc_id", "held_out", "key") if base else ("key",)

    def make():
        names_of = WordNames()
        known, counts, total, distinct = table.value
        pairs, words, before = filters.value
        all_of = total + 0.1 * (distinct + 1)

        def exact(tok, edge):
            uniq, where = np.unique(tok, return_inverse=True)
            at = np.minimum(np.searchsorted(known, uniq), max(0, len(known) - 1))
            hit = known[at] == uniq if len(known) else np.zeros(len(uniq), bool)
            value = np.zeros(len(uniq))
            value[hit] = np.log10(counts[at[hit]] + 0.1) - np.log10(all_of)
            value, seen = value[where], hit[where]
            for a, z in zip(edge, edge[1:]):
                rest, times = np.unique(tok[a:z][~seen[a:z]], return_counts=True)
                yield z - a, int(seen[a:z].sum()), float(value[a:z].sum()), rest.view(np.int64), times

        def smoothed(tok, prev, edge):
            pair = pair_names(prev, tok)
            at = np.flatnonzero(pairs.has(pair) & words.has(tok) & before.has(prev))
            uniq, where = np.unique(tok[at], return_inverse=True)
            one = ((words.size(uniq) + 0.1) / all_of)[where]
            uniq, where = np.unique(prev[at], return_inverse=True)
            context = before.size(uniq)[where]
            value = np.zeros(len(tok))
            value[at] = np.log10(np.minimum(1.0, (pairs.size(pair[at]) + filters.prior * one) / (context + filters.prior)))
            return [float(value[a:z].sum()) for a, z in zip(edge, edge[1:])]

        def step(b):
            part, rows = [], []
            for _, names, bounds in names_of.grouped(_lower(b)):
                tok, prev, edge = tokens(names, bounds)
                part += smoothed(tok, prev, edge)
                if base:
                    rows += exact(tok, edge)
            cols = [b.column(c) for c in carried] + [pa.array(part, pa.float64())]
            names = [*carried, "part"]
            if base:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                cols += [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)]
                names += ["n_tokens", "known", "base", "rest", "times"]
            yield pa.RecordBatch.from_arrays(cols, names)

        return step

    schema = "doc_id long, held_out boolean, key long, part double, n_tokens long, known long, base double, rest array<long>, times array<long>"
    return per_batch(docs.select(*carried, "text"), schema if base else "key long, part double", make)


class Filters:
    """What one pass sends: the pairs, the tokens, the predecessors."""

    def __init__(self, value, prior: float):
        self.shared, self.prior = value, prior

    @property
    def value(self):
        return self.shared.value


def lm_scores(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with both scores.

    A row is held out of training when crc32 of its id as text (null: '') is a multiple of
    ten. Null and empty texts are one end token. Repeated rows count and are scored each. With
    no training rows no token is known; the base score is then the one of N = V = 0.
    """
    rows = pick(docs, id_col, text_col).withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0)
    model, segments = fit(rows.filter(~F.col("held_out")).select("doc_id", "text"), s)
    words = model.filter(F.col("kind") == ONE)
    total, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    by_level = np.sum([r[0] for r in words.select("by_level").collect()] or [[0] * 64], axis=0)
    above = np.cumsum(by_level[::-1])[::-1]
    least = int(np.argmax(above <= s.frequent))
    send = docs.sparkSession.sparkContext.broadcast
    table = send((*_packed(model, least), total, distinct))

    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    cuts = {kind: _slices(model, kind, segments, s) for kind in (ONE, PAIR)}
    main, more = None, []
    for i, j, k in product(cuts[PAIR], cuts[ONE], cuts[ONE]):
        pairs, of_word = _load(model, PAIR, i, segments, s.probes), _load(model, ONE, j, segments, s.probes)
        before = of_word if k == j else _load(model, ONE, k, segments, s.probes)
        one = _score(rows, table, Filters(send((pairs, of_word, before)), s.prior), base=main is None)
        if main is None:
            main = stable(one.withColumn("row", F.monotonically_increasing_id()))
        else:
            more.append(one.groupBy("key").agg(F.max("part").alias("part")))  # equal rows have equal parts

    rest = main.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("name"), F.col("x.times").alias("times"))
    log_all = float(np.log10(total + 0.1 * (distinct + 1)))
    joined = rest.join(_flat(model, 1, least - 1), "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    joined = joined.groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.col("n") + 0.1) - log_all)).alias("rest_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
    )
    out = main.drop("rest", "times").join(joined, "row", "left")
    if more:
        parts = more[0]
        for m in more[1:]:
            parts = parts.unionByName(m)
        out = out.join(parts.groupBy("key").agg(F.sum("part").alias("others")), "key", "left")
    else:
        out = out.withColumn("others", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"), (F.col("part") + F.coalesce("others", F.lit(0.0))).alias("score"),
    )
