"""Nearest neighbours through Voronoi cells: exact with distance bounds, or by probing.

Pivots are a seeded sample. Every row belongs to the cell of its nearest pivot.
A query first meets its own cell, which bounds its k-th distance; it then visits
only cells that can still hold something closer. Cells and query groups larger
than a block are cut by id hash, so no task holds more than two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oosgauge.functions.draws import mix
from oosgauge.operators import blocks as B
from oosgauge.operators.knn import NEIGHBOURS, _merge, nearest_in_block
from oosgauge.session import parallelism, stable

PIVOT_BYTES = 64 << 20
PIVOT_SEED = 4001
#: rows with vectors handed on at once
SENT_ROWS = 8192


def choose_pivots(base: DataFrame, shape: B.Shape, cell_rows: int) -> np.ndarray:
    """A seeded sample of distinct rows, at most PIVOT_BYTES of them."""
    wanted = max(1, math.ceil(shape.rows / cell_rows))
    limit = max(1, PIVOT_BYTES // (8 * max(shape.width, 1)))
    rows = base.orderBy(mix("id", PIVOT_SEED), "id").select("v").limit(min(wanted, limit)).collect()
    return np.unique(np.array([r["v"] for r in rows], dtype=float), axis=0)


def assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``cell`` (nearest pivot) and ``r`` (distance to it)."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        piv = shared.value
        for batch in batches:
            cols = B.decode(pa.Table.from_batches([batch]))
            if not len(cols["id"]):
                continue
            step = max(1, (16 << 20) // (8 * len(piv)))
            cell = np.empty(len(cols["id"]), dtype=np.int32)
            for s in range(0, len(cell), step):
                cell[s : s + step] = np.argmin(B.gram_squared(cols["v"][s : s + step], piv)[0], axis=1)
            r = B.row_distance(cols["v"], piv[cell])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(cell), pa.array(r)], ["id", "v", "cell", "r"]
            )

    return df.select("id", "v").mapInArrow(run, "id bigint, v array<double>, cell int, r double")


def _cut(sizes: DataFrame, count: str, name: str, rows: int) -> DataFrame:
    return sizes.withColumn(name, F.greatest(F.ceil(F.col(count) / F.lit(rows)), F.lit(1)).cast("int"))


def _visit(targets: DataFrame, base: DataFrame, k: int, skip: bool, rows: int) -> DataFrame:
    """Meet each query (``id, v, cell``) with the base rows of that cell; partial lists."""
    nq = _cut(targets.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")), "_n", "_nq", rows).drop("_n")
    nb = _cut(base.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")), "_n", "_nb", rows).drop("_n")
    cuts = nq.join(nb, "cell")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = targets.select("id", "v", "cell").join(cuts, "cell").withColumn("_q", part("_nq")).withColumn("_b", every("_nb"))
    b = base.select("id", "v", "cell").join(cuts, "cell").withColumn("_b", part("_nb")).withColumn("_q", every("_nq"))
    q, b = q.drop("_nq", "_nb"), b.drop("_nq", "_nb")
    q, b = q.toDF(*q.columns), b.toDF(*b.columns)
    parts = 4 * parallelism(base.sparkSession)
    q = q.repartition(parts, "cell", "_q", "_b")
    b = b.repartition(parts, "cell", "_q", "_b")
    schema = f"id bigint, neighbors {NEIGHBOURS}"
    empty = B._empty_table(schema)

    def run(key, lt: pa.Table, rt: pa.Table) -> pa.Table:
        if lt.num_rows == 0 or rt.num_rows == 0:
            return empty
        left, right = B.decode(lt.select(["id", "v"])), B.decode(rt.select(["id", "v"]))

        def kernel(strip):
            found, cols, dist = nearest_in_block(strip["id"], strip["v"], right["id"], right["v"], k, skip)
            counts = np.bincount(found, minlength=len(strip["id"]))
            return pa.table(
                {"id": strip["id"], "neighbors": B.list_column(counts, {"d": dist, "j": right["id"][cols]})}
            )

        return pa.concat_tables(B.tiled(left, right, kernel))

    return q.groupBy("cell", "_q", "_b").cogroup(b.groupBy("cell", "_q", "_b")).applyInArrow(run, schema)


def _open_cells(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray, dry: bool = False) -> DataFrame:
    """``id, v, cell`` for every other cell that may hold a row within ``bound`` of the query;
    with ``dry`` only their numbers ``n``.

    A row x of cell c is no nearer than |q - p_c| - radius_c, and, as x is nearer
    to p_c than to the query's own pivot p, no nearer than the plane between them.
    """
    gap = np.sqrt(np.maximum(B.gram_squared(pivots, pivots)[0], 1e-300)) if len(pivots) <= 4096 else None
    shared = queries.sparkSession.sparkContext.broadcast((pivots, radius, gap))

    def run(batches):
        piv, rad, apart = shared.value
        for batch in batches:
            cols = B.decode(pa.Table.from_batches([batch]))
            step = max(1, (16 << 20) // (8 * len(piv)))
            for s in range(0, len(cols["id"]), step):
                own, bound = cols["cell"][s : s + step], cols["bound"][s : s + step]
                sq, slack = B.gram_squared(cols["v"][s : s + step], piv)
                sq = np.maximum(sq, 0.0)
                d = np.sqrt(sq)
                low = d - rad[None, :]
                if apart is not None:
                    rows = np.arange(len(own))
                    plane = (sq - sq[rows, own][:, None]) / (2.0 * apart[own])
                    low = np.maximum(low, plane)
                room = np.sqrt(slack) + 1e-9 * (1.0 + d.max(axis=1, initial=0.0))
                go = (low <= (bound + room)[:, None]) & (rad >= 0)[None, :]
                go[np.arange(len(own)), own] = False
                if dry:
                    yield pa.RecordBatch.from_arrays([pa.array([int(go.sum())])], ["n"])
                    continue
                r, c = np.nonzero(go)
                for a in range(0, len(r), SENT_ROWS):
                    src = pa.array(r[a : a + SENT_ROWS] + s)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(src), batch.column("v").take(src), pa.array(c[a : a + SENT_ROWS].astype(np.int32))],
                        ["id", "v", "cell"],
                    )

    return queries.mapInArrow(run, "n bigint" if dry else "id bigint, v array<double>, cell int")


def _too_many(visits: DataFrame, most: int | None) -> bool:
    return most is not None and (visits.agg(F.sum("n")).first()[0] or 0) > most


def pruned_knn(
    q: DataFrame, b: DataFrame, k: int, skip: bool, shape: B.Shape, cell_rows: int = 2000, most: int | None = None
) -> DataFrame | None:
    """Exact kNN visiting only cells the bounds leave open; None when one cell is all there is,
    or when over ``most`` visits stay open."""
    pivots = choose_pivots(b, shape, cell_rows)
    if len(pivots) < 2:
        return None
    base = stable(assign(b, pivots))
    own = q is b
    queries = base if own else stable(assign(q, pivots))
    rows = max(B.MIN_BLOCK_ROWS, min(B.MAX_BLOCK_ROWS, B.BLOCK_BYTES // (8 * max(shape.width, 1))))
    first = stable(_merge(_visit(queries, base, k, skip, rows), ["id"], k))
    radius = np.full(len(pivots), -1.0)  # -1: empty cell
    for r in base.groupBy("cell").agg(F.max("r").alias("r")).collect():
        radius[r["cell"]] = r["r"]
    kth = first.select(
        F.col("id").alias("_id"),
        F.when(F.size("neighbors") >= k, F.element_at("neighbors", -1)["d"]).alias("bound"),
    )
    bounded = queries.join(kth, F.col("id") == F.col("_id"), "left").select(
        "id", "v", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound")
    )
    if _too_many(_open_cells(bounded, pivots, radius, dry=True), most):
        return None
    targets = stable(_open_cells(bounded, pivots, radius))
    more = _visit(targets, base, k, skip, rows)
    return _merge(first.unionByName(more), ["id"], k)


def probed_knn(b: DataFrame, k: int, probes: int = 4, cell_rows: int = 256) -> DataFrame:
    """Approximate kNN without self: search only the ``probes`` nearest cells."""
    shape = B.shape_of(b, "v")
    pivots = choose_pivots(b, shape, cell_rows)
    base = stable(assign(b, pivots))
    shared = b.sparkSession.sparkContext.broadcast(pivots)
    take = min(probes, len(pivots))

    def run(batches):
        piv = shared.value
        for batch in batches:
            cols = B.decode(pa.Table.from_batches([batch]))
            if not len(cols["id"]):
                continue
            near = np.argsort(B.gram_squared(cols["v"], piv)[0], axis=1, kind="stable")[:, :take]
            src = pa.array(np.repeat(np.arange(len(near)), take))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(src), batch.column("v").take(src), pa.array(near.reshape(-1).astype(np.int32))],
                ["id", "v", "cell"],
            )

    targets = base.select("id", "v").mapInArrow(run, "id bigint, v array<double>, cell int")
    rows = max(B.MIN_BLOCK_ROWS, min(B.MAX_BLOCK_ROWS, B.BLOCK_BYTES // (8 * max(shape.width, 1))))
    return _merge(_visit(targets, base, k, True, rows), ["id"], k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``recall``: share of the true neighbours that were found."""
    t = truth.select("id", F.col("neighbors.j").alias("_t"))
    f = found.select("id", F.col("neighbors.j").alias("_f"))
    hit = F.size(F.array_intersect("_t", F.coalesce("_f", F.array().cast("array<bigint>"))))
    return t.join(f, "id", "left").agg((F.sum(hit) / F.sum(F.size("_t"))).alias("recall"))


# --- ranks by cell ----------------------------------------------------------


def pruned_ranks(
    left: DataFrame, base: DataFrame, shape: B.Shape, cell_rows: int = 2000, most: int | None = None
) -> DataFrame | None:
    """``i, j, rank`` for rows ``id, v, tj, td``: closer rows counted cell by cell.

    A cell wholly inside the distance to the nearest target adds its size, one
    wholly beyond the farthest target adds nothing; only the rest is visited. None when
    one cell is all there is, or when over ``most`` visits are left.
    """
    from oosgauge.operators.knn import closer_counts

    pivots = choose_pivots(base, shape, cell_rows)
    if len(pivots) < 2:
        return None
    rows = max(B.MIN_BLOCK_ROWS, min(B.MAX_BLOCK_ROWS, B.BLOCK_BYTES // (8 * max(shape.width, 1))))
    cells = stable(assign(base, pivots))
    radius, size = np.full(len(pivots), -1.0), np.zeros(len(pivots), dtype=np.int64)
    for r in cells.groupBy("cell").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], size[r["cell"]] = r["r"], r["n"]
    shared = base.sparkSession.sparkContext.broadcast((pivots, radius, size))

    def sort_cells(batches, dry=False):
        piv, rad, n = shared.value
        for batch in batches:
            c = B.decode(pa.Table.from_batches([batch]))
            if not len(c["id"]):
                continue
            real = c["tj"] >= 0
            near = np.where(real, c["td"], np.inf).min(axis=1)
            far = np.where(real, c["td"], -np.inf).max(axis=1)
            step = max(1, (16 << 20) // (8 * len(piv)))
            for s in range(0, len(near), step):
                sq, slack = B.gram_squared(c["v"][s : s + step], piv)
                d = np.sqrt(np.maximum(sq, 0.0))
                room = (np.sqrt(slack) + 1e-9 * (1.0 + d.max(axis=1, initial=0.0)))[:, None]
                inside = (rad >= 0) & (d + rad + room < near[s : s + step, None])
                visit = (rad >= 0) & ~inside & (d - rad - room <= far[s : s + step, None])
                if dry:
                    yield pa.RecordBatch.from_arrays([pa.array([int(visit.sum())])], ["n"])
                    continue
                # the row itself is closer than any target but never counted
                own = (inside & (np.arange(len(piv))[None, :] == c["cell"][s : s + step, None])).any(axis=1)
                whole = inside @ n - own
                r, col = np.nonzero(visit)
                empty = np.nonzero(~visit.any(axis=1))[0]
                first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
                src = np.r_[r, empty] + s
                cell = np.r_[col, np.full(len(empty), -1)].astype(np.int32)
                # whole cells are credited once per row, with its first visit
                credit = np.r_[np.where(first, whole[r], 0), whole[empty]].astype(np.int64)
                for a in range(0, len(src), SENT_ROWS):
                    part = slice(a, a + SENT_ROWS)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(x).take(pa.array(src[part])) for x in ("id", "v", "tj", "td")]
                        + [pa.array(cell[part]), pa.array(credit[part])],
                        ["id", "v", "tj", "td", "cell", "whole"],
                    )

    placed = left.join(cells.select(F.col("id").alias("_id"), F.col("cell")), F.col("id") == F.col("_id")).drop("_id")
    schema = "id bigint, v array<double>, tj array<bigint>, td array<double>, cell int, whole bigint"
    placed = placed.select("id", "v", "tj", "td", "cell")
    if most is not None:
        placed = stable(placed)
        if _too_many(placed.mapInArrow(lambda batches: sort_cells(batches, dry=True), "n bigint"), most):
            return None
    targets = stable(placed.mapInArrow(sort_cells, schema))

    nq = _cut(targets.filter("cell >= 0").groupBy("cell").agg(F.count(F.lit(1)).alias("_n")), "_n", "_nq", rows).drop("_n")
    nb = _cut(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")), "_n", "_nb", rows).drop("_n")
    cuts = nq.join(nb, "cell")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = targets.join(cuts, "cell").withColumn("_q", part("_nq")).withColumn("_b", every("_nb")).drop("_nq", "_nb", "whole")
    b = cells.select("id", "v", "cell").join(cuts, "cell").withColumn("_b", part("_nb")).withColumn("_q", every("_nq")).drop("_nq", "_nb")
    q, b = q.toDF(*q.columns), b.toDF(*b.columns)
    parts = 4 * parallelism(base.sparkSession)
    q, b = q.repartition(parts, "cell", "_q", "_b"), b.repartition(parts, "cell", "_q", "_b")
    out_schema = "i bigint, j bigint, closer bigint"
    empty_out = B._empty_table(out_schema)

    def run(key, lt: pa.Table, rt: pa.Table) -> pa.Table:
        if lt.num_rows == 0 or rt.num_rows == 0:
            return empty_out
        lc, rc = B.decode(lt.select(["id", "v", "tj", "td"])), B.decode(rt.select(["id", "v"]))

        def kernel(strip):
            cnt = closer_counts(strip["id"], strip["v"], rc["id"], rc["v"], strip["tj"], strip["td"])
            flat = strip["tj"].reshape(-1)
            keep = flat >= 0
            return pa.table(
                {"i": np.repeat(strip["id"], strip["tj"].shape[1])[keep], "j": flat[keep], "closer": cnt.reshape(-1)[keep]}
            )

        return pa.concat_tables(B.tiled(lc, rc, kernel))

    visited = q.groupBy("cell", "_q", "_b").cogroup(b.groupBy("cell", "_q", "_b")).applyInArrow(run, out_schema)
    whole = targets.filter("whole > 0 or cell < 0").select(F.col("id").alias("i"), F.explode("tj").alias("j"), F.col("whole").alias("closer"))
    return visited.unionByName(whole).groupBy("i", "j").agg((F.sum("closer") + 1).cast("bigint").alias("rank"))
