"""N-gram Jaccard join over prefix trees.

The n-grams of all documents have one global order, rare ones first. Two sets that are similar
enough must meet in their first n-grams, so each set is filed under the n-grams of that
prefix; the sets under one n-gram form a group. In a group the ordered sets are stored
in a trie, each n-gram of a shared prefix once. A probe looks up every node and takes over
the overlap it has counted along a shared prefix, for all sets of the group at once.

Only connectivity is asked for, so sets of the largest component so far are not probes. Groups
of any size are cut into blocks; blocks meet only where a group is not one component yet.
Equal sets are one node throughout.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oosgauge.llm.sieve import bit_table, passing
from oosgauge.llm.text import U64, WordNames, and_row, per_batch, pick, raw, shingle_set, whole_row
from oosgauge.operators.graph import connected_components
from oosgauge.session import stable

#: buckets of the table of document frequencies that sets the order; a fixed size
ORDER_BITS = 20
#: n-grams of prefixes held by a task before they are handed on
FLUSH = 1_000_000
#: postings of one n-gram in a flush from which on they go around the merge
HOT = 64
POSTING = np.dtype([("gram", "<u8"), ("set", "<i8"), ("n", "<i4"), ("at", "<i4")])
#: bytes of each field of a posting that are sent; the upper six of an n-gram's name group sets, they do not compare them
SENT = {"gram": (2, 8), "set": (0, 8), "n": (0, 4), "at": (0, 4)}
#: bytes of an n-gram's name in a set, which is compared: all
WHOLE = (0, 8)
#: digests of sets that a task remembers, to send copies once
REMEMBERED = 1 << 17


@dataclass(frozen=True)
class Settings:
    n: int = 5
    over: int = 75  # similarity as a fraction, linked from over / below on
    below: int = 100
    block: int = 1_000_000  # n-grams of the sets in one block of a group
    per_segment: int = 1_000_000
    sieve_bits: int = 1 << 27

    def prefix(self, size):
        """N-grams of a set of ``size`` of which a similar one must hold one."""
        return size - -(-size * self.over // self.below) + 1

    def need(self, a, b):
        """Least overlap of similar sets of these sizes."""
        return -(-self.over * (a + b) // (self.over + self.below))


def planes(values: np.ndarray, a: int, z: int) -> bytes:
    """Bytes ``a`` to ``z`` of each value, one place after the other: small or sorted numbers compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)[:, a:z].T.tobytes()


def from_planes(data: bytes, a: int, z: int, kind: str) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(z - a, -1).T
    out = np.zeros((len(part), np.dtype(kind).itemsize), np.uint8)
    out[:, a:z] = part
    return out.view(kind).ravel()


def pack(rows: np.ndarray) -> bytes:
    return b"".join(planes(rows[f], *SENT[f]) for f in SENT)


def unpack(data: bytes) -> np.ndarray:
    n, at = len(data) // sum(z - a for a, z in SENT.values()), 0
    out = np.empty(n, POSTING)
    for f, (a, z) in SENT.items():
        size = n * (z - a)
        out[f] = from_planes(data[at : at + size], a, z, POSTING[f].str)
        at += size
    return out


def set_id(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(b: pa.RecordBatch, names: WordNames, s: Settings):
    """The shingle set of each row of a batch, in order."""
    for _, words, bounds in names.grouped([(t or b"").lower() for t in raw(b.column("text"))]):
        for a, z in zip(bounds, bounds[1:]):
            yield shingle_set(words[a:z], s.n)


def read_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """Rows ``doc_id, n, set`` of the documents, and rows ``piece, counts`` of document frequencies by bucket."""
    piece = 1 << 14

    class Read:
        def __init__(self):
            self.names, self.seen = WordNames(), np.zeros(1 << ORDER_BITS, np.int64)

        def __call__(self, b):
            size, ids = [], []
            for grams in _sets(b, self.names, s):
                size.append(len(grams))
                ids.append(set_id(grams) if len(grams) else None)
                np.add.at(self.seen, grams >> U64(64 - ORDER_BITS), 1)
            none = pa.nulls(len(size), pa.int64()), pa.nulls(len(size), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(ids, pa.int64()), *none], ["doc_id", "n", "set", "piece", "counts"])

        def close(self):
            parts = self.seen.astype(np.uint32).reshape(-1, piece)
            none = [pa.nulls(len(parts), pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(len(parts)), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "n", "set", "piece", "counts"])

    return per_batch(docs, "doc_id long, n long, set long, piece long, counts binary", Read)


def bucket_order(read: DataFrame) -> np.ndarray:
    """Document frequencies by bucket over all documents."""

    def add(key, t):
        total = np.sum([np.frombuffer(x, np.uint32).astype(np.int64) for x in t.column("counts").to_pylist()], axis=0)
        return pa.table({"piece": [key[0].as_py()], "counts": [total.tobytes()]})

    rows = read.filter("piece is not null").select("piece", "counts").groupBy("piece").applyInArrow(add, "piece long, counts binary").collect()
    out = np.zeros(1 << ORDER_BITS, np.int64)
    for i, x in rows:
        x = np.frombuffer(x, np.int64)
        out[i * len(x) : (i + 1) * len(x)] = x
    return out


def in_order(grams: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Sorted n-grams in global order: frequency of the bucket, then name."""
    return grams[np.argsort(order[grams >> U64(64 - ORDER_BITS)], kind="stable")]


def postings(docs: DataFrame, s: Settings, shared, segments: int) -> DataFrame:
    """Packed prefix postings by segment of the n-gram; pieces of hot n-grams have a negative segment each, to be kept as they are."""
    shift = U64(64 - int(segments).bit_length() + 1)

    class Post:
        def __init__(self):
            self.names, self.order, self.held, self.size, self.done = WordNames(), shared.value, [], 0, set()

        def __call__(self, b):
            for grams in _sets(b, self.names, s):
                if not len(grams) or (me := set_id(grams)) in self.done:
                    continue
                self.done.add(me)  # copies in this task
                k = s.prefix(len(grams))
                rows = np.empty(k, POSTING)
                rows["gram"], rows["set"], rows["n"], rows["at"] = in_order(grams, self.order)[:k], me, len(grams), np.arange(k)
                self.held.append(rows)
                self.size += k
                if self.size > FLUSH:
                    yield from self.close()
            if len(self.done) > REMEMBERED:
                self.done.clear()

        def close(self):
            if self.held:
                rows = np.concatenate(self.held)
                rows = rows[np.argsort(rows["gram"], kind="stable")]
                first = np.flatnonzero(np.concatenate([[True], rows["gram"][1:] != rows["gram"][:-1]]))
                count = np.diff(np.concatenate([first, [len(rows)]]))
                hot = np.repeat(count > HOT, count)
                out = [rows[hot][i : i + FLUSH // 10] for i in range(0, int(hot.sum()), FLUSH // 10)]
                out = [(-1 - (set_id(x) >> 2 & (1 << 60) - 1), x) for x in out]
                sign = rows[first[count > HOT]]  # tells the merge that these n-grams have postings it does not see
                sign["n"] = 0
                rest = np.concatenate([rows[~hot], sign])
                rest = rest[np.argsort(rest["gram"], kind="stable")]
                seg = (rest["gram"] >> shift).astype(np.int64)
                cut = np.searchsorted(seg, np.arange(segments + 1))
                out += [(i, rest[cut[i] : cut[i + 1]]) for i in np.flatnonzero(np.diff(cut))]
                for i in range(0, len(out), 64):
                    segs, packed = zip(*out[i : i + 64])
                    yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array([pack(x) for x in packed], pa.binary())], ["seg", "packed"])
            self.held, self.size = [], 0

    return per_batch(docs, "seg long, packed binary", Post)


def shared_postings(rows: np.ndarray, s: Settings) -> np.ndarray:
    """Postings of n-grams that two sets share, where sizes and places allow enough overlap with some other set.

    A sign (``n = 0``) stands for postings that went around the merge, of any size and place: all of its n-gram stay.
    """
    rows = np.unique(rows)  # copies from several tasks
    first = np.flatnonzero(np.concatenate([[True], rows["gram"][1:] != rows["gram"][:-1]])) if len(rows) else np.zeros(0, np.int64)
    keep = np.zeros(len(rows), bool)
    for a, z in zip(first, [*first[1:], len(rows)]):
        if z - a < 2:
            continue
        if z - a > HOT or not rows["n"][a:z].all():
            keep[a:z] = rows["n"][a:z] > 0
            continue
        n, left = rows["n"][a:z].astype(np.int64), (rows["n"][a:z] - rows["at"][a:z]).astype(np.int64)
        fits = np.minimum(left[:, None], left) >= s.need(n[:, None], n)
        fits &= np.minimum(n[:, None], n) * s.below >= np.maximum(n[:, None], n) * s.over
        np.fill_diagonal(fits, False)
        keep[a:z] = fits.any(axis=1)
    return rows[keep]


def _columns(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows["gram"].view(np.int64)), pa.array(rows["set"]), pa.array(rows["n"].astype(np.int64))], ["gram", "set", "n"])


def _merged(packed: DataFrame, s: Settings) -> DataFrame:
    """``gram, set, n`` of postings that may meet another set."""

    def merge(key, t):
        rows = np.concatenate([unpack(x) for x in t.column("packed").to_pylist()])
        return pa.Table.from_batches([_columns(rows if key[0].as_py() < 0 else shared_postings(rows, s))])

    return packed.groupBy("seg").applyInArrow(merge, "gram long, set long, n long")


class Trie:
    """Ordered sets as a prefix tree: sets in lexicographic order, each n-gram of a shared prefix one node.

    The sets below a node are a run of that order, from the set that adds the node to its ``leaves``.
    """

    def __init__(self, ranked: list[np.ndarray], members: np.ndarray):
        self.members = np.array(sorted(members, key=lambda i: ranked[i].astype(">u4").tobytes()))
        shared, tails, open_, at = 0, [], [], 0  # open: (first node, its depth) of parts of the path to the last set
        leaves, starts = np.full(sum(len(ranked[i]) for i in members), len(members), np.int64), [0]
        before = None
        for k, i in enumerate(self.members):
            y = ranked[i]
            if before is not None:
                m = min(len(before), len(y))
                differ = np.flatnonzero(before[:m] != y[:m])
                shared, end = int(differ[0]) if len(differ) else m, len(before)
                while open_ and end > shared:
                    node, depth = open_[-1]
                    cut = max(depth, shared)
                    leaves[node + cut - depth : node + end - depth] = k
                    end = cut
                    if cut == depth:
                        open_.pop()
            open_.append((at, shared))
            tails.append(y[shared:])
            at += len(y) - shared
            starts.append(at)
            before = y
        self.nodes, self.starts, leaves = np.concatenate(tails), np.array(starts), leaves[:at]
        self.by_end = np.argsort(leaves, kind="stable")
        self.ends = np.searchsorted(leaves[self.by_end], np.arange(len(self.members) + 1))

    def overlaps(self, held: np.ndarray) -> np.ndarray:
        """N-grams that each of ``members`` has among the ``held`` ones; a node is looked up once for all sets below it."""
        hit = held[self.nodes]
        enter = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[self.starts]
        leave = np.concatenate([[0], np.cumsum(hit[self.by_end], dtype=np.int64)])[self.ends]
        return enter[1:] - leave[1:]


def ranks(sets: list[np.ndarray], order: np.ndarray) -> list[np.ndarray]:
    """The sets as ascending big-endian ranks in the global order, so that bytes compare as ranks do."""
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(len(every), ">u4")
    rank[np.argsort(order[every >> U64(64 - ORDER_BITS)], kind="stable")] = np.arange(len(every))
    cut = np.cumsum([len(x) for x in sets])[:-1]
    return [np.sort(x) for x in np.split(rank[where], cut)]


def links_between(ids: list[int], sets: list[np.ndarray], labels: list[int], probe: list[bool], order: np.ndarray, s: Settings):
    """Links that join what is not joined yet, of all pairs with a probe.

    Two sets that are not joined are not both in the largest component, so it does to ask either
    all probes or all sets outside of it; whichever are fewer go next.
    """
    ranked = [r.astype(np.int64) for r in ranks(sets, order)]
    size, probe = np.array([len(r) for r in ranked]), np.array(probe)
    comp = np.unique(labels, return_inverse=True)[1]
    asked, held = np.zeros(len(ids), bool), np.zeros(max(int(r[-1]) for r in ranked) + 1, np.uint8)
    trie = Trie(ranked, np.arange(len(ids)))
    while True:
        count = np.bincount(comp)
        left, outside = np.flatnonzero(probe & ~asked), np.flatnonzero((comp != count.argmax()) & ~asked)
        left = left if len(left) <= len(outside) else outside
        if not len(left):
            return
        i = left[0]
        held[ranked[i]] = 1
        overlap, j = trie.overlaps(held), trie.members
        held[ranked[i]] = 0
        asked[i] = True
        found = j[(overlap * (s.over + s.below) >= s.over * (size[i] + size[j])) & (comp[j] != comp[i])]
        if len(found):
            for j in found[np.unique(comp[found], return_index=True)[1]]:
                yield ids[i], ids[j]
            comp[np.isin(comp, comp[found])] = comp[i]
        open_ = np.flatnonzero(~asked)  # a set that was asked has met all others
        if 0 < 2 * len(open_) < len(trie.members):
            trie = Trie(ranked, open_)


def _blocks(rows: DataFrame, shared, s: Settings) -> DataFrame:
    """Links in each (lead, block) from rows ``lead, block, set, label, probe, grams``."""
    keys = ("lead", "block")

    def make():
        order = shared.value

        class Walk:
            def __init__(self):
                self.now, self.held = None, []

            def __call__(self, b):
                for lead, block, me, label, probe, grams in zip(*(b.column(c).to_pylist() for c in (*keys, "set", "label", "probe", "grams"))):
                    if self.now != (lead, block):
                        yield from self.close()
                        self.now = (lead, block)
                    self.held.append((me, from_planes(grams, *WHOLE, "<u8"), label, probe))

            def close(self):
                if len(self.held) > 1:
                    ids, sets, labels, probe = zip(*self.held)
                    got = list(links_between(ids, sets, labels, probe, order, s))
                    if got:
                        a, z = zip(*got)
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], ["src", "dst"])
                self.held = []

        return Walk()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("probe"), "set")
    return per_batch(dealt, "src long, dst long", make)


def with_sets(docs: DataFrame, places: DataFrame, s: Settings, sent: list) -> DataFrame:
    """``places`` (rows with ``set``) with the packed n-grams of their sets, read from the texts again.

    A bit table keeps most other texts' sets from being sent; the join does the rest. ``sent``
    gets what the caller is to release once the rows are written.
    """
    table, bits = bit_table(places.select("set").distinct(), "set", s.sieve_bits)
    send = docs.sparkSession.sparkContext.broadcast(table)
    sent.append(send)

    def make():
        names, done, sieve = WordNames(), set(), np.frombuffer(send.value, np.uint8)

        def step(b):
            ids, out = [], []
            for grams in _sets(b, names, s):
                if len(grams) and passing(sieve, bits, np.array([me := set_id(grams)]).view(U64))[0] and me not in done:
                    done.add(me)
                    ids.append(me)
                    out.append(planes(grams, *WHOLE))
            if len(done) > REMEMBERED:
                done.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["set", "grams"])

        return step

    cols = [c for c in places.columns if c != "set"]
    of_set = places.groupBy("set").agg(F.collect_list(F.struct(*cols)).alias("at"))
    sets = per_batch(docs, "set long, grams binary", make).join(of_set, "set").dropDuplicates(["set"])
    return sets.select("set", "grams", F.explode("at").alias("at")).select("set", "grams", "at.*")


def components(docs: DataFrame, s: Settings, read: DataFrame) -> DataFrame:
    """``set, component`` of sets that are linked with another, as a written table."""
    sent: list = []
    try:
        return _components(docs, s, read, sent)
    finally:
        for x in sent:  # links and components are written
            x.unpersist()


def _components(docs: DataFrame, s: Settings, read: DataFrame, sent: list) -> DataFrame:
    spark = docs.sparkSession
    order = bucket_order(read)
    shared = spark.sparkContext.broadcast(order)
    sent.append(shared)
    segments, size = 64, read.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    while segments * s.per_segment < size // 4:
        segments *= 2
    met = stable(_merged(postings(docs, s, shared, segments), s))
    lead = stable(met.groupBy("gram").agg(F.min("set").alias("lead")))  # so that the join can split a hot n-gram
    groups = stable(met.join(lead, "gram").select("lead", "set", "n").distinct())

    blocks = groups.groupBy("lead").agg(F.ceil(F.sum("n") / s.block).cast("long").alias("blocks"))
    sized = groups.join(blocks, "lead").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")))
    own = blocks.filter("blocks > 1").select("lead", F.col("lead").alias("set"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    once = sized.select("lead", "set", "block").unionByName(own).distinct()
    work = with_sets(docs, once.select("lead", "block", "set", F.col("set").alias("label"), F.lit(True).alias("probe")), s, sent)
    links = stable(_blocks(work, shared, s))

    def joined(links):
        nodes = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
        return connected_components(nodes, links.withColumn("w", F.lit(1.0))).withColumnRenamed("id", "set")

    found = joined(links)
    wide = sized.filter("blocks > 1")
    if wide.isEmpty():
        return found
    label = F.coalesce("component", "set")
    wide = stable(wide.join(found, "set", "left").withColumn("label", label).drop("component"))
    lead_label = wide.filter("lead = set").select("lead", F.col("label").alias("lead_label"))
    other = wide.join(lead_label, "lead").filter("label <> lead_label")
    probes = other.groupBy("lead").agg(F.ceil(F.sum("n") / s.block).cast("long").alias("parts"))
    other = other.join(probes, "lead").withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")))
    pair = F.col("part") * F.col("blocks") + F.col("block")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    left = other.withColumn("_n", F.col("blocks")).drop("block").withColumn("block", every).select("lead", "set", "label", pair.alias("block"), F.lit(True).alias("probe"))
    right = wide.join(probes, "lead").withColumn("_n", F.col("parts")).withColumn("part", every).select("lead", "set", "label", pair.alias("block"), F.lit(False).alias("probe"))
    cross = left.unionByName(right).groupBy("lead", "block", "set", "label").agg(F.max("probe").alias("probe"))
    more = stable(_blocks(with_sets(docs, stable(cross), s, sent), shared, s))
    return found if more.isEmpty() else joined(links.unionByName(more))


def jaccard_components(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id`` (the least id reachable by links).

    Null and empty texts, and those without words, have no set and no links. Equal texts are
    one set; rows that repeat an id are documents of their own. Rows with a null id take part,
    and their component's id is the least one there is, or null. Sets are told apart by a
    64-bit digest, n-grams by 64-bit names.
    """
    rows = pick(docs, id_col, text_col)
    read = stable(read_sets(rows, s))
    one = read.filter("piece is null").select("doc_id", "n", "set")
    linked = components(rows.select("text"), s, read.filter("piece is not null or n > 0"))
    known = stable(one.filter("n > 0").join(linked, "set", "left").withColumn("label", F.coalesce("component", "set")).select("doc_id", "n", "label"))
    least = stable(known.groupBy("label").agg(F.min("doc_id").alias("component_id")))  # so that the join can split a hot label
    out = known.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(one.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component, unchanged: that of the least id, then the least set.

    Of rows that repeat both id and set one stays. Rows without words are in no component and
    all stay. A null id loses to any other.
    """
    rows = pick(docs, id_col, text_col)
    read = stable(read_sets(rows, s))
    linked = components(rows.select("text"), s, read.filter("piece is not null or n > 0"))
    one = read.filter("n > 0").select("doc_id", "set").distinct()
    label = one.join(linked, "set", "left").select(F.coalesce("component", "set").alias("label"), F.col("doc_id").isNull().alias("last"), "doc_id", "set")
    best = label.groupBy("label").agg(F.min(F.struct("last", "doc_id", "set")).alias("b"))
    best = stable(best.select(F.col("b.set").alias("set"), F.col("b.doc_id").alias("winner"), F.lit(True).alias("wins")))

    def make():
        names = WordNames()

        def step(b):
            ids = [set_id(g) if len(g) else None for g in _sets(b, names, s)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.int64()), b.column("carry")], ["doc_id", "set", "carry"])

        return step

    wide = per_batch(pick(docs, id_col, text_col, whole_row(docs)), and_row("doc_id long, set long", docs), make)
    wide = wide.withColumn("alone", F.when(F.col("set").isNull(), F.monotonically_increasing_id()))
    kept = wide.join(best, "set", "left").filter(F.col("set").isNull() | (F.col("wins") & F.col("winner").eqNullSafe(F.col("doc_id"))))
    return kept.dropDuplicates(["set", "alone"]).select("carry.*")
