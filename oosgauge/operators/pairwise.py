"""Distances between rows: per-row summaries of the whole matrix, and values on given pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oosgauge.operators import blocks as B
from oosgauge.operators.knn import _frame
from oosgauge.session import parallelism, stable


def row_distance_stats(
    points: DataFrame, base: DataFrame | None = None, id_col: str = "id", vec: str = "features", floor: float = 0.0
) -> DataFrame:
    """``id, n, d_sum, d2_sum, d_max, d_min``: each row against all others (or all of ``base``).

    The distance matrix exists only inside block kernels. ``floor`` sends smaller
    distances to 0; within one table the row itself is left out.
    """
    own = base is None
    q = _frame(points, id_col, vec)
    b = q if own else _frame(base, id_col, vec)
    qs = B.shape_of(q, "v")
    bs = qs if own else B.shape_of(b, "v")
    slots = parallelism(q.sparkSession)

    def kernel(lt, rt, _l, _r):
        d = B.close_distance(lt["v"], rt["v"])
        if floor:
            d[d < floor] = 0.0
        use = lt["id"][:, None] != rt["id"][None, :] if own else np.ones(d.shape, bool)
        z = np.where(use, d, 0.0)
        return pa.table(
            {
                "id": lt["id"],
                "n": use.sum(axis=1),
                "d_sum": z.sum(axis=1),
                "d2_sum": (z * z).sum(axis=1),
                "d_max": z.max(axis=1),
                "d_min": np.where(use, d, np.inf).min(axis=1),
            }
        )

    out = B.cross_blocks(
        q,
        b,
        B.block_count(qs.rows, qs.width, slots),
        B.block_count(bs.rows, bs.width, slots),
        kernel,
        "id bigint, n bigint, d_sum double, d2_sum double, d_max double, d_min double",
    )
    return out.groupBy("id").agg(
        *[F.sum(c).alias(c) for c in ("n", "d_sum", "d2_sum")], F.max("d_max").alias("d_max"), F.min("d_min").alias("d_min")
    )


def with_vectors(pairs: DataFrame, points: DataFrame, id_col: str = "id", vec: str = "features") -> DataFrame:
    """Attach ``vi, vj`` to ``i, j`` pairs."""
    p = _frame(points, id_col, vec)
    a = p.select(F.col("id").alias("i"), F.col("v").alias("vi"))
    b = p.select(F.col("id").alias("j"), F.col("v").alias("vj"))
    return pairs.join(a, "i").join(b, "j")


# --- Gaussian kernel --------------------------------------------------------


def kernel_width(points: DataFrame, id_col: str = "id", vec: str = "features", top: int = 10) -> float:
    """Median of the ``top`` largest matrix entries over sqrt(-2 ln 0.6).

    Each unordered pair is two entries, so the largest top/2 pairs decide.
    """
    p = _frame(points, id_col, vec)
    shape = B.shape_of(p, "v")
    nb = B.block_count(shape.rows, shape.width, parallelism(p.sparkSession))

    def kernel(lt, rt, lb, rb):
        d = B.close_distance(lt["v"], rt["v"])
        if lb == rb:
            d = d[lt["id"][:, None] < rt["id"][None, :]]
        d = d.reshape(-1)
        return pa.table({"d": np.partition(d, len(d) - top)[-top:] if len(d) > top else d})

    big = B.cross_blocks(p, p, nb, nb, kernel, "d double", half=True)
    pairs = [r["d"] for r in big.orderBy(F.desc("d")).limit(top).collect()]
    entries = sorted([v for d in pairs for v in (d, d)] + [0.0] * min(shape.rows, top), reverse=True)[:top]
    return float(np.median(entries)) / math.sqrt(-2.0 * math.log(0.6))


def kernel_sums(
    queries: DataFrame, base: DataFrame, sigma: float, weights: str | None = None, id_col: str = "id", vec: str = "features"
) -> DataFrame:
    """``id, k_sum[, kx, ky]``: row sums of exp(-d^2 / 2 sigma^2), and the sums weighted
    by a two-number column of ``base``."""
    cols = [F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("v")]
    q = queries.select(*cols)
    b = base.select(*cols, *([F.col(weights).alias("w")] if weights else []))
    qs, bs = B.shape_of(q, "v"), B.shape_of(b, "v")
    slots = parallelism(q.sparkSession)

    def kernel(lt, rt, _l, _r):
        d = B.close_distance(lt["v"], rt["v"])
        k = np.exp(-(d * d) / (2.0 * sigma * sigma))
        out = {"id": lt["id"], "k_sum": k.sum(axis=1)}
        if weights:
            kw = k @ rt["w"]
            out |= {"kx": kw[:, 0], "ky": kw[:, 1]}
        return pa.table(out)

    schema = "id bigint, k_sum double" + (", kx double, ky double" if weights else "")
    out = B.cross_blocks(
        q, b, B.block_count(qs.rows, qs.width, slots), B.block_count(bs.rows, bs.width, slots), kernel, schema
    )
    names = ["k_sum"] + (["kx", "ky"] if weights else [])
    return out.groupBy("id").agg(*[F.sum(c).alias(c) for c in names])


def gaussian_kernel_rows(pairs: DataFrame, points: DataFrame, sigma: float, id_col: str = "id", vec: str = "features") -> DataFrame:
    """``i, j, k``: kernel values on given pairs, normalised over the whole row of the matrix."""
    sums = kernel_sums(points, points, sigma, id_col=id_col, vec=vec).select(F.col("id").alias("i"), "k_sum")
    from oosgauge.functions.vectors import squared_euclidean

    raw = with_vectors(pairs, points, id_col, vec).withColumn(
        "k", F.exp(-squared_euclidean("vi", "vj") / F.lit(2.0 * sigma * sigma))
    )
    return raw.join(sums, "i").select("i", "j", (F.col("k") / F.col("k_sum")).alias("k"))


def double_centred(points: DataFrame, id_col: str = "id", vec: str = "features") -> DataFrame:
    """``i, j, b``: every entry of -1/2 J D^2 J, the diagonal too; null where a vector is missing. Rows leave a block pass as they are made."""
    p = _frame(points, id_col, vec)
    shape = B.shape_of(p, "v")
    nb = max(B.block_count(shape.rows, shape.width, parallelism(p.sparkSession)), -(-shape.rows // B.CELL_BLOCK_ROWS))
    stats = stable(row_distance_stats(points, points, id_col, vec).select("id", (F.col("d2_sum") / F.col("n")).alias("m")))
    grand = stats.agg(F.avg("m")).first()[0]

    def kernel(lt, rt, lb, rb):
        b = -0.5 * (B.pair_distance(lt["v"], rt["v"]) ** 2 - lt["m"][:, None] - rt["m"][None, :] + grand)
        i, j, b = np.repeat(lt["id"], len(rt["id"])), np.tile(rt["id"], len(lt["id"])), b.ravel()
        none = ~(lt["whole"][:, None] & rt["whole"][None, :]).ravel()
        if lb != rb:
            i, j, b, none = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([b, b]), np.concatenate([none, none])
        return pa.table({"i": i, "j": j, "b": pa.array(b, mask=none)})

    rows = p.join(stats, "id").withColumn("whole", F.coalesce(~F.exists("v", lambda x: x.isNull()), F.lit(False)))
    return B.cross_blocks(rows, rows, nb, nb, kernel, "i bigint, j bigint, b double", half=True)
