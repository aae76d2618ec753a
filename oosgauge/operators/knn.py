"""Exact nearest neighbours, ranks of given pairs, and the approximate join.

Neighbour order is ``(distance, id)`` everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oosgauge.operators import blocks as B
from oosgauge.session import parallelism

NEIGHBOURS = "array<struct<d:double,j:bigint>>"


def nearest_in_block(qid, q, bid, b, k: int, skip_self: bool):
    """Flat (row, column, distance) of the k best of ``b`` for each row of ``q``."""
    want = min(k + int(skip_self), len(bid))
    sq, slack = B.gram_squared(q, b)
    kth = np.partition(sq, want - 1, axis=1)[:, want - 1]
    rows, cols = np.nonzero(sq <= (kth + 2 * slack)[:, None])
    dist = np.empty(len(rows))
    step = max(1, (4 << 20) // max(1, q.shape[1]))
    for s in range(0, len(rows), step):
        e = s + step
        dist[s:e] = B.row_distance(q[rows[s:e]], b[cols[s:e]])
    if skip_self:
        keep = qid[rows] != bid[cols]
        rows, cols, dist = rows[keep], cols[keep], dist[keep]
    order = np.lexsort((bid[cols], dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep], dist[keep]


def _merge(partial: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = F.slice(F.array_sort(F.flatten(F.collect_list("neighbors"))), 1, k)
    return partial.groupBy(*keys).agg(best.alias("neighbors"))


def _block_knn(queries: DataFrame, base: DataFrame, k: int, skip_self: bool, nq: int, nb: int) -> DataFrame:
    def kernel(lt, rt, _l, _r):
        rows, cols, dist = nearest_in_block(lt["id"], lt["v"], rt["id"], rt["v"], k, skip_self)
        counts = np.bincount(rows, minlength=len(lt["id"]))
        return pa.table(
            {"id": pa.array(lt["id"]), "neighbors": B.list_column(counts, {"d": dist, "j": rt["id"][cols]})}
        )

    partial = B.cross_blocks(queries, base, nq, nb, kernel, f"id bigint, neighbors {NEIGHBOURS}")
    return _merge(partial, ["id"], k)


def _frame(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("v"))


def knn(
    base: DataFrame,
    k: int,
    queries: DataFrame | None = None,
    include_self: bool = False,
    id_col: str = "id",
    vec: str = "features",
    collapse: bool | None = None,
    prune_from: int = 200_000,
) -> DataFrame:
    """``id, neighbors`` with the k nearest rows of ``base``, nearest first.

    Without ``queries`` the table is matched with itself and each row skips
    itself unless ``include_self``. Equal vectors are collapsed before the block
    pass when there are many of them (``collapse``); from ``prune_from`` rows on,
    blocks that provably hold no neighbour are skipped.
    """
    own = queries is None
    skip = own and not include_self
    b = _frame(base, id_col, vec)
    q = b if own else _frame(queries, id_col, vec)
    shape = B.shape_of(b, "v")
    qshape = shape if own else B.shape_of(q, "v")
    if collapse is None:
        collapse = min(shape.distinct / max(shape.rows, 1), qshape.distinct / max(qshape.rows, 1)) < 0.8
    if collapse:
        return _collapsed(b, q, k, skip, shape, qshape, prune_from)
    return _search(b, q, k, skip, shape, qshape, prune_from)


def _search(b, q, k, skip, shape, qshape, prune_from) -> DataFrame:
    from oosgauge.operators.cells import pruned_knn

    slots = parallelism(b.sparkSession)
    nq = B.block_count(qshape.rows, qshape.width, slots)
    nb = B.block_count(shape.rows, shape.width, slots)
    if shape.rows >= prune_from:
        # where the bounds leave more open than the block pass moves, that pass is the cheaper
        found = pruned_knn(q, b, k, skip, shape, most=nb * qshape.rows + nq * shape.rows)
        if found is not None:
            return found
    return _block_knn(q, b, k, skip, nq, nb)


def _collapsed(b, q, k, skip, shape, qshape, prune_from) -> DataFrame:
    """Search among distinct vectors only, exact under any number of copies.

    A row needs at most k+1 rows of any group of copies, and by the tie order
    those are the ones with the lowest ids; every copy shares one answer list.
    """
    keep = k + 1 if skip else k
    by_vec = Window.partitionBy("v").orderBy("id")
    lowest = b.withColumn("_r", F.row_number().over(by_vec)).filter(F.col("_r") <= keep).drop("_r")
    firsts = q.withColumn("_r", F.row_number().over(by_vec)).filter(F.col("_r") == 1).drop("_r")
    found = _search(lowest, firsts, keep, False, B.shape_of(lowest, "v"), B.shape_of(firsts, "v"), prune_from)
    answers = firsts.join(found, "id").select(F.col("v").alias("_v"), "neighbors")
    rows = q.join(answers, F.col("v") == F.col("_v")).select("id", "neighbors")
    if not skip:
        return rows
    others = F.filter("neighbors", lambda n: n["j"] != F.col("id"))
    return rows.select("id", F.slice(others, 1, k).alias("neighbors"))


def edges(neighbors: DataFrame, src: str = "i", dst: str = "j") -> DataFrame:
    """``i, j, d, pos`` from a neighbour table, pos starting at 1."""
    return neighbors.select(F.col("id").alias(src), F.posexplode("neighbors").alias("_p", "_n")).select(
        src, F.col("_n.j").alias(dst), F.col("_n.d").alias("d"), (F.col("_p") + 1).cast("int").alias("pos")
    )


def rank_of(
    pairs: DataFrame, points: DataFrame, id_col: str = "id", vec: str = "features", prune_from: int = 200_000
) -> DataFrame:
    """``i, j, rank``: place of j among all other rows ordered by distance from i.

    ``pairs`` holds ``i, j``. Only counts are shuffled: for each pair the number
    of rows closer than j, found block by block.
    """
    p = _frame(points, id_col, vec)
    ends = pairs.select("i", "j").join(p.select(F.col("id").alias("j"), F.col("v").alias("_vj")), "j")
    # one row per i: targets are a neighbour list, bounded by k
    grouped = ends.groupBy("i").agg(F.collect_list(F.struct("j", "_vj")).alias("_t"))
    left = grouped.join(p.select(F.col("id").alias("i"), "v"), "i").select(
        F.col("i").alias("id"),
        "v",
        F.col("_t.j").alias("tj"),
        F.transform("_t", lambda t: _l2(t["_vj"], F.col("v"))).alias("td"),
    )
    return count_closer(left, p, prune_from)


def _l2(a: Column, b: Column) -> Column:
    from oosgauge.functions.vectors import euclidean

    return euclidean(a, b)


def closer_counts(qid, q, bid, b, tj, td):
    """Per (row, target): rows of ``b`` before the target in (distance, id) order."""
    sq, slack = B.gram_squared(q, b)
    out = np.zeros(td.shape, dtype=np.int64)
    own = qid[:, None] == bid[None, :]
    sq = np.where(own, np.inf, sq)
    step = max(1, (4 << 20) // max(1, q.shape[1]))
    for t in range(td.shape[1]):
        limit = (td[:, t] ** 2)[:, None]
        room = slack[:, None] + 1e-12 * limit
        out[:, t] = (sq < limit - room).sum(axis=1)
        rows, cols = np.nonzero(np.abs(sq - limit) <= room)
        for s in range(0, len(rows), step):  # among copies every cell may be a tie
            r, c = rows[s : s + step], cols[s : s + step]
            d = B.row_distance(q[r], b[c])
            cut = td[r, t]
            near = np.abs(d - cut) <= 1e-14 * np.maximum(d, cut)
            before = np.where(near, bid[c] < tj[r, t], d < cut) & (bid[c] != tj[r, t])
            np.add.at(out[:, t], r[before], 1)
    return out


def count_closer(left: DataFrame, base: DataFrame, prune_from: int = 200_000) -> DataFrame:
    """``i, j, rank`` for left rows ``id, v, tj, td`` (targets and their distances)."""
    from oosgauge.operators.cells import pruned_ranks

    shape = B.shape_of(base, "v")
    n = B.block_count(shape.rows, shape.width, parallelism(base.sparkSession))
    if shape.rows >= prune_from:
        found = pruned_ranks(left, base, shape, most=2 * n * shape.rows)
        if found is not None:
            return found

    def kernel(lt, rt, _l, _r):
        cnt = closer_counts(lt["id"], lt["v"], rt["id"], rt["v"], lt["tj"], lt["td"])
        k = lt["tj"].shape[1]
        return pa.table(
            {
                "i": np.repeat(lt["id"], k),
                "j": lt["tj"].reshape(-1),
                "closer": cnt.reshape(-1),
            }
        ).filter(pc.greater_equal(pc.field("j"), 0))

    partial = B.cross_blocks(left, base, n, n, kernel, "i bigint, j bigint, closer bigint")
    return partial.groupBy("i", "j").agg((F.sum("closer") + 1).cast("bigint").alias("rank"))
