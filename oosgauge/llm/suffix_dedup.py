"""Removal of long repeated byte strings by bucket-pointer refinement.

A suffix array sorts all positions; here only the question matters whether the ``length``
bytes from a position also start elsewhere. Positions fall into buckets by their first q
bytes, and a bucket is refined by the bucket identifier of the position q bytes later: q,
2q, 4q, ... up to ``length``. Identifiers are 64-bit names of the bytes, so that refinement
needs no exchange, and each level reuses the last one's.

Across documents, buckets are refined in two steps. Each position is filed under an anchor
within its string (the position with the least q-byte identifier), which equal strings
share; the run of positions under one anchor is a block. Blocks meet in the bucket of the
``length / 2`` bytes at their anchor, and those alone there are done. A block that equals another
has all its positions repeated. The rest of a bucket is cut into cells of a sixteenth, by the distance to
the anchor, which meet in the bucket of the bytes that all strings of the cell hold, and are
settled in the same way. What is left then, mostly the edges of copies, is refined position
by position.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oosgauge.llm.sieve import bit_table, passing
from oosgauge.llm.text import M1, M2, U64, per_batch, pick, raw
from oosgauge.session import stable

#: bytes of texts named together
GROUP = 1 << 17


@dataclass(frozen=True)
class Settings:
    length: int = 400  # bytes; sixteen times the first bucket's q
    sieve_bits: int = 1 << 27  # at most, of the table of contested buckets sent to all tasks


def refine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of two strings in a row from theirs."""
    x = a * M1
    x ^= x >> U64(29)
    x += b
    x *= M2
    x ^= x >> U64(32)
    return x


def ladder(data: np.ndarray, length: int) -> list[np.ndarray]:
    """Bucket identifiers of all positions at q = length / 16, then at twice that, up to ``length``."""
    q = length // 16
    x = data.astype(U64)
    size = 1
    while 2 * size <= min(q, 8):  # bytes side by side, exact
        x = x[:-size] | (x[size:] << U64(8 * size))
        size *= 2
    while 2 * size <= q:
        x = refine(x[:-size], x[size:])
        size *= 2
    if size < q:  # the last step overlaps itself
        x = refine(x[: len(x) - (q - size)], x[q - size :])
    out = [x]
    for _ in range(4):
        out.append(refine(out[-1][:-q], out[-1][q:]))
        q *= 2
    return out


@dataclass
class Blocks:
    """Runs of positions under one anchor, with identifiers; positions count from the start of the group."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    half: np.ndarray  # identifiers of length / 2 bytes, by position
    full: np.ndarray  # and of length bytes

    @property
    def bucket(self) -> np.ndarray:
        return self.half[self.anchor]

    def body(self) -> np.ndarray:
        return refine(self.full[self.first], self.full[self.last]) + (self.last - self.first).astype(U64)

    def of(self, which: np.ndarray) -> Blocks:
        return Blocks(self.first[which], self.last[which], self.anchor[which], self.half, self.full)

    def cells(self, length: int) -> tuple[Blocks, np.ndarray]:
        """The blocks cut at distances of whole sixteenths from the anchor, and the cells' buckets."""
        w = length // 16
        near, far = (self.anchor - self.last) // w, (self.anchor - self.first) // w
        n = far - near + 1
        of = np.repeat(np.arange(len(n)), n)
        j = near[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        anchor = self.anchor[of]
        end = anchor - j * w
        cut = Blocks(np.maximum(self.first[of], end - w + 1), np.minimum(self.last[of], end), anchor, self.half, self.full)
        # from the last start of the cell to the end of the string of its first
        return cut, refine(self.half[end], self.half[end + length // 2 - w + 1])


def blocks(texts: list[bytes], length: int) -> Blocks | None:
    """Blocks of a group of texts; strings across two texts are left out."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data) - length + 1
    if n <= 0:
        return None
    steps = ladder(data, length)
    low = (steps[0] & U64(0xFFFFFFFF00000000)) | np.arange(len(steps[0]), dtype=U64)
    reach, size = length // 2, 1
    while 2 * size <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[reach - size : reach - size + n])
    anchor = (low & U64(0xFFFFFFFF)).astype(np.int64)
    at = 0
    for t in texts:
        anchor[max(at, at + len(t) - length + 1) : at + len(t)] = -1
        at += len(t)
    edge = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [n]])
    first, last = edge[:-1], edge[1:] - 1
    real = anchor[first] >= 0
    first, last = first[real], last[real]
    return Blocks(first, last, anchor[first], steps[3], steps[4])


def grouped(texts: list[bytes]):
    """Index of the first text and texts of groups that are named together."""
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= GROUP:
            size += len(texts[last])
            last += 1
        yield first, texts[first:last]
        first = last


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def ticket(bucket: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    return bucket ^ row.view(U64) ^ (first.astype(U64) << U64(32))


NAMES = ("bucket", "body", "row", "first", "last")


def _level(rows: DataFrame, s: Settings, depth: int, tables: list, known=None, only: tuple = NAMES) -> DataFrame:
    """Rows of a level: blocks (0), cells of contested blocks (1), positions of contested cells (2).

    Of equal blocks or cells one is taken down to the next level. ``known``, a table of bits of
    buckets, drops most rows of others; ``only`` names the columns that are wanted.
    """

    def make():
        sieves = [(np.frombuffer(t.value, np.uint8), bits) for t, bits in tables]
        wanted = known and (np.frombuffer(known[0].value, np.uint8), known[1])

        def level(got: Blocks, place):
            if depth == 0:
                return got.bucket, got.body(), got.first, got.last
            got = got.of(passing(*sieves[0], ticket(got.bucket, *place(got.first))))
            cells, bucket = got.cells(s.length)
            if depth == 1:
                return bucket, cells.body(), cells.first, cells.last
            hit = passing(*sieves[1], ticket(bucket, *place(cells.first)))
            cells, bucket = cells.of(hit), bucket[hit]
            size = cells.last - cells.first + 1
            at = np.repeat(cells.first - np.cumsum(size) + size, size) + np.arange(size.sum())
            return np.repeat(bucket, size), cells.full[at], at, at

        def step(b):
            rows = b.column("row").to_numpy(zero_copy_only=False)
            for i, texts in grouped([t or b"" for t in raw(b.column("text"))]):
                got = blocks(texts, s.length)
                if got is None:
                    continue
                start = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

                def place(at, start=start, i=i):
                    of = np.searchsorted(start, at, "right") - 1
                    return rows[i + of], at - start[of]

                bucket, body, first, last = level(got, place)
                if wanted and len(first):
                    hit = passing(*wanted, bucket)
                    bucket, body, first, last = bucket[hit], body[hit], first[hit], last[hit]
                if len(first):
                    row, at = place(first)
                    made = dict(zip(NAMES, (bucket, body, row, at, at + last - first)))
                    yield pa.RecordBatch.from_arrays([_i64(made[c]) for c in only], list(only))

        return step

    return per_batch(rows, ", ".join(f"{c} long" for c in only), make)


def _bodies(found: DataFrame) -> DataFrame:
    """``bucket, body, n, ticket, contested``; contested: some body of the bucket is alone, among others.

    The ticket names one member of each body, which stands for all of them on the next level.
    Counts come first, so that a bucket that many documents hold is a few rows for each task.
    """
    of_row = F.col("bucket").bitwiseXOR(F.col("row")).bitwiseXOR(F.shiftleft("first", 32))
    sizes = found.groupBy("bucket", "body").agg(F.count(F.lit(1)).alias("n"), F.min(of_row).alias("ticket"))
    of_bucket = stable(sizes.groupBy("bucket").agg((F.min("n") == 1).alias("contested")))
    return sizes.join(of_bucket, "bucket")


def repeated_starts(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``row, first, last``: ranges of positions whose ``length`` bytes also start elsewhere, from ``row, text``."""
    tables, whole, send = [], None, rows.sparkSession.sparkContext.broadcast
    for depth in range(3):
        if depth < 2:
            # buckets are counted before any row is written: most are alone, and the texts are cheap to read again
            counts = _level(rows, s, depth, tables, only=("bucket",)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
            shared = stable(counts.filter("n > 1").select("bucket"))  # written, so that the join can split a bucket that many documents hold
            table, bits = bit_table(shared, "bucket", s.sieve_bits)
            known = (send(table), bits)
            found = stable(_level(rows, s, depth, tables, known).join(shared, "bucket"))  # all else is over what is shared
            known[0].unpersist()
            bodies = stable(_bodies(found))
        else:
            found = stable(_level(rows, s, depth, tables))
            bodies = stable(found.groupBy("bucket", "body").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        twice = found.join(bodies.filter("n > 1").select("bucket", "body"), ["bucket", "body"]).select("row", "first", "last")
        whole = twice if whole is None else whole.unionByName(twice)
        if depth < 2:
            table, bits = bit_table(bodies.filter("contested"), "ticket", s.sieve_bits)
            tables = [*tables, (send(table), bits)]
    for t, _ in tables:
        t.unpersist()  # the last level is written
    return whole


def _spans(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(last[order] + length)
    new = np.concatenate([[True], first[1:] > end[:-1]])
    return first[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]


def _cut(length: int, keep_text: bool):
    def make():
        def step(b):
            n_removed, n_spans, digest, sizes, kept = [], [], [], [], []
            for text, marks in zip(raw(b.column("text")), b.column("marks").to_pylist()):
                t = text or b""
                sizes.append(len(t))
                if marks:
                    pairs = np.frombuffer(b"".join(marks), ">i8").reshape(-1, 2)
                    a, z = _spans(pairs[:, 0], pairs[:, 1], length)
                    edges = [0, *np.column_stack([a, z]).ravel().tolist(), len(t)]
                    t = b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2]))
                    n_spans.append(len(a))
                else:
                    n_spans.append(0)
                n_removed.append(sizes[-1] - len(t))
                digest.append(hashlib.sha256(t).hexdigest())
                kept.append(t)
            cols = [pa.array(c, pa.int64()) for c in (sizes, n_removed, n_spans)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            out = [b.column("doc_id"), *cols, pa.array(digest, pa.string())]
            if keep_text:
                out, names = [*out, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(out, names)

        return step

    return make


def drop_repeats(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: sizes in bytes, removed runs, digest of what is left and, if asked, the bytes left (``kept``).

    Every byte covered by a ``length``-byte string that also starts elsewhere goes, in all its
    places. Null and empty texts have no bytes. Repeated rows are places of their own, so both
    lose what they share. Rows are told apart by a 64-bit digest of id and text.
    """
    rows = pick(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    starts = repeated_starts(rows.select("row", "text").filter(F.octet_length("text") >= s.length), s)
    eight = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    marks = starts.select("row", F.concat(eight("first"), eight("last")).alias("m")).groupBy("row").agg(F.collect_list("m").alias("marks"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return per_batch(rows.join(marks, "row", "left").select("doc_id", "text", "marks"), schema, _cut(s.length, keep_text))
