"""Block passes: all-against-all work that never emits the pairs.

Rows are hashed into blocks of bounded bytes, every needed (left block, right
block) meets once in a cogroup, and a numpy kernel reduces the meeting to a few
numbers per row before anything is shuffled again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oosgauge.session import parallelism, ship

BLOCK_BYTES = 16 << 20
MAX_BLOCK_ROWS = 32768
MIN_BLOCK_ROWS = 128
#: cells of the matrices that a kernel makes at once; a meeting with more goes by strips of its left block
TILE_CELLS = 1 << 21
#: cells of matrices that are made and used up at once
PIECE_CELLS = 1 << 16
#: rows of a block where the kernel hands on every cell
CELL_BLOCK_ROWS = 2048
#: bytes of a table's vectors that a task may hold whole
HELD_BYTES = 256 << 20


@dataclass(frozen=True)
class Shape:
    rows: int
    width: int
    distinct: int


def shape_of(df: DataFrame, vec: str) -> Shape:
    """Row count, vector length and approximate number of distinct vectors, one scan."""
    ship(df.sparkSession)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size(vec)).alias("w"),
        F.approx_count_distinct(F.xxhash64(vec)).alias("u"),
    ).first()
    return Shape(int(row["n"]), int(row["w"] or 0), int(row["u"] or 0))


def block_count(rows: int, width: int, slots: int) -> int:
    """Blocks of at most BLOCK_BYTES, and enough of them to keep the slots busy."""
    by_bytes = max(MIN_BLOCK_ROWS, min(MAX_BLOCK_ROWS, BLOCK_BYTES // (8 * max(width, 1))))
    needed = math.ceil(rows / by_bytes)
    spread = min(math.ceil(math.sqrt(2 * slots)), math.ceil(rows / MIN_BLOCK_ROWS))
    return max(1, needed, spread)


def tiled(left: dict, right: dict, kernel: Callable[[dict], pa.Table | None]) -> list[pa.Table]:
    """Results of ``kernel(strip of left)`` over strips of so few rows that a matrix against ``right`` stays small."""
    rows, cells = (len(next(iter(x.values()))) for x in (left, right))
    step = max(1, TILE_CELLS // max(1, cells))
    parts = (kernel({c: x[s : s + step] for c, x in left.items()}) for s in range(0, rows, step))
    return [t for t in parts if t is not None]


def pieces(rows: int, cells: int) -> list[slice]:
    """Rows whose ``cells`` of some matrices stay in a core's cache together."""
    step = max(1, PIECE_CELLS // max(1, cells))
    return [slice(s, s + step) for s in range(0, rows, step)]


def counts_packed(m: np.ndarray) -> list[bytes]:
    """Rows of small counts, a byte each; told from packed doubles by their length, which ends in the number of counts."""
    pad = bytes(-m.shape[1] % 8) + np.uint32(m.shape[1]).tobytes()
    return [row.tobytes() + pad for row in m.astype(np.uint8)]


def counts_unpacked(raw: np.ndarray) -> np.ndarray:
    return raw[:, : int(np.frombuffer(raw[0, -4:].tobytes(), np.uint32)[0])]


def unpacked(row: bytes) -> np.ndarray:
    return counts_unpacked(np.frombuffer(row, np.uint8)[None, :])[0] if len(row) % 8 == 4 else np.frombuffer(row)


def in_slices(m: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of a matrix as doubles, so few at a time that they stay small."""
    step = max(1, TILE_CELLS // max(1, m.shape[1]))
    for s in range(0, len(m), step):
        yield slice(s, s + step), m[s : s + step].astype(float, copy=False)


def decode(table: pa.Table) -> dict[str, np.ndarray]:
    """Arrow columns to numpy; list columns become 2-D arrays, short lists padded with -1, binary ones rows of doubles or ``counts_packed``."""
    out = {}
    for name in table.column_names:
        col = table.column(name).combine_chunks()
        if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
            flat = col.flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(col.offsets.to_numpy())
            width = int(lengths.max(initial=0))
            if (lengths == width).all():
                out[name] = flat.reshape(len(col), width)
            else:
                out[name] = np.full((len(col), width), -1, dtype=flat.dtype)
                out[name][np.arange(width)[None, :] < lengths[:, None]] = flat
        elif pa.types.is_binary(col.type) and len(col):
            ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
            raw = np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(col), -1)
            out[name] = counts_unpacked(raw) if raw.shape[1] % 8 == 4 else raw.reshape(-1).view(np.float64).reshape(len(col), -1)
        else:
            out[name] = col.to_numpy(zero_copy_only=False)
    return out


def cross_blocks(
    left: DataFrame,
    right: DataFrame,
    left_blocks: int,
    right_blocks: int,
    kernel: Callable[[dict, dict, int, int], pa.Table | None],
    schema: str,
    half: bool = False,
    id_col: str = "id",
) -> DataFrame:
    """Run ``kernel(left columns, right columns, left block, right block)`` per block pair,
    once for each strip of the left block, so that no matrix exceeds ``TILE_CELLS``.

    ``half`` keeps only left block <= right block, for symmetric work on one table.
    """
    spark = left.sparkSession

    def keyed(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        df = df.toDF(*df.columns)  # fresh column identities: both sides may come from one table
        own_block = F.pmod(F.xxhash64(F.col(id_col)), F.lit(own_n)).cast("int")
        return df.withColumn(own, own_block).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))
        )

    lk = keyed(left, "_lb", left_blocks, "_rb", right_blocks)
    rk = keyed(right, "_rb", right_blocks, "_lb", left_blocks)
    if half:
        lk, rk = lk.filter("_lb <= _rb"), rk.filter("_lb <= _rb")
    meetings = left_blocks * right_blocks
    # a numbered repartition is not coalesced by AQE: these tasks are heavy in
    # arithmetic, not in bytes
    parts = min(meetings, max(4 * parallelism(spark), meetings // 8))
    lk = lk.repartition(parts, "_lb", "_rb")
    rk = rk.repartition(parts, "_lb", "_rb")
    empty = _empty_table(schema)

    def run(key, lt: pa.Table, rt: pa.Table) -> pa.Table:
        if lt.num_rows == 0 or rt.num_rows == 0:
            return empty
        right, lb, rb = decode(rt), key[0].as_py(), key[1].as_py()
        out = tiled(decode(lt), right, lambda strip: kernel(strip, right, lb, rb))
        return pa.concat_tables(out) if out else empty

    return lk.groupBy("_lb", "_rb").cogroup(rk.groupBy("_lb", "_rb")).applyInArrow(run, schema)


def against_all(left: DataFrame, base: DataFrame, rows: int, step: int, kernel: Callable[[dict, dict], pa.Table], schema: str) -> DataFrame:
    """``kernel(strip of left, all of base in id order)`` for strips of ``step`` of the ``rows`` left rows.

    Rows are dealt to groups, and every group meets a copy of ``base``, which a task must be able to hold
    (``HELD_BYTES``): what a row needs of all others at once is never put together by a shuffle.
    """
    groups = max(1, min(-(-rows // step), 4 * parallelism(left.sparkSession)))
    lk = left.withColumn("_g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).repartition(groups, "_g")
    base = base.toDF(*base.columns)
    rk = base.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "_g")
    empty = _empty_table(schema)

    def run(lt: pa.Table, rt: pa.Table) -> pa.Table:
        if lt.num_rows == 0 or rt.num_rows == 0:
            return empty
        x, right = decode(lt.drop_columns("_g")), decode(rt.drop_columns("_g"))
        order = np.argsort(right["id"], kind="stable")
        right = {c: v[order] for c, v in right.items()}
        return pa.concat_tables([kernel({c: v[s : s + step] for c, v in x.items()}, right) for s in range(0, lt.num_rows, step)])

    return lk.groupBy("_g").cogroup(rk.groupBy("_g")).applyInArrow(run, schema)


def _empty_table(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema)).empty_table()


def gram_squared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by the inner-product identity, with a bound on their rounding."""
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    sq = na[:, None] + nb[None, :] - 2.0 * (a @ b.T)
    slack = 8.0 * (a.shape[1] + 8) * np.finfo(float).eps * (na + nb.max(initial=0.0)) + 1e-300
    return sq, slack


def row_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Direct distance of matching rows; the value every comparison is settled by."""
    gap = a - b
    return np.sqrt((gap * gap).sum(axis=1))


def pair_distance(a: np.ndarray, b: np.ndarray, step: int = 256) -> np.ndarray:
    """Direct distances of every row of ``a`` to every row of ``b``, in slices."""
    out = np.zeros((len(a), len(b)))
    if a.shape[1] < 8:  # numpy sums so few in order, too
        for x, y in zip(a.T, b.T):
            gap = x[:, None] - y[None, :]
            out += np.multiply(gap, gap, out=gap)
        return np.sqrt(out, out=out)
    step = max(1, min(step, (4 << 20) // max(1, b.size)))
    for s in range(0, len(a), step):
        gap = a[s : s + step, None, :] - b[None, :, :]
        out[s : s + step] = np.sqrt((gap * gap).sum(axis=2))
    return out


def close_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances good to nine digits, for sums: by inner products, and directly where those cancel."""
    if a.shape[1] < 8:
        return pair_distance(a, b)
    sq, slack = gram_squared(a, b)
    rows, cols = np.nonzero(~(sq >= 1e9 * slack[:, None]))
    if 4 * len(rows) > sq.size:
        return pair_distance(a, b)
    out = np.sqrt(np.maximum(sq, 0.0, out=sq), out=sq)
    step = max(1, (4 << 20) // a.shape[1])
    for s in range(0, len(rows), step):
        r, c = rows[s : s + step], cols[s : s + step]
        out[r, c] = row_distance(a[r], b[c])
    return out


def list_column(counts: np.ndarray, fields: dict[str, np.ndarray]) -> pa.ListArray:
    """``array<struct<...>>`` from flat per-entry arrays and a length per row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
