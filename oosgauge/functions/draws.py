"""Deterministic draws keyed by row id, the same under any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oosgauge.session import parallelism

PRIME = 2147483647  # 2**31 - 1; squares stay inside BIGINT
_A, _B = 48271, 69621


def mix(key: Column | str, seed: int) -> Column:
    """Integer in [0, PRIME) scrambled from a non-negative id and a seed."""
    if isinstance(key, str):
        # one parsed expression instead of a dozen column objects
        h = f"(((CAST(`{key}` AS BIGINT) % {PRIME}L) * {_A}L + {seed}L) % {PRIME}L)"
        return F.expr(f"((({h} * {h}) % {PRIME}L) * {_B}L + {seed}L) % {PRIME}L")
    p, s = F.lit(PRIME).cast("bigint"), F.lit(seed).cast("bigint")
    h = ((key.cast("bigint") % p) * F.lit(_A).cast("bigint") + s) % p
    h = (h * h) % p
    return (h * F.lit(_B).cast("bigint") + s) % p


def unit(key: Column | str, seed: int) -> Column:
    """Uniform draw in [0, 1)."""
    return mix(key, seed).cast("double") / F.lit(float(PRIME))


def gauss(key: Column | str, seed: int) -> Column:
    """Standard normal draw by the Box-Muller transform of two uniforms."""
    u1 = (mix(key, seed).cast("double") + F.lit(1.0)) / F.lit(float(PRIME) + 1.0)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * unit(key, seed + 7919))


def mix_sql(key: str, seed: int) -> str:
    """The same integer as :func:`mix`, as SQL text."""
    h = f"((({key})::BIGINT % {PRIME}) * {_A} + {seed}) % {PRIME}"
    h = f"(({h}) * ({h})) % {PRIME}"
    return f"((({h}) * {_B} + {seed}) % {PRIME})"


def unit_sql(key: str, seed: int) -> str:
    return f"({mix_sql(key, seed)}::DOUBLE / {float(PRIME)})"


def gauss_sql(key: str, seed: int) -> str:
    u1 = f"(({mix_sql(key, seed)}::DOUBLE + 1.0::DOUBLE) / {float(PRIME) + 1.0})"
    return f"(sqrt(-2.0::DOUBLE * ln({u1})) * cos({2.0 * math.pi!r}::DOUBLE * {unit_sql(key, seed + 7919)}))"


def shuffled_position(
    df: DataFrame, id_col: str, seed: int, group: list[str] | None = None, name: str = "pos"
) -> DataFrame:
    """1-based place of each row in the ``(mix, id)`` order, overall or per group.

    ``mix`` is uniform, so equal slices of its range hold equal shares of any
    group, however large: rows are numbered inside a slice and shifted by the
    number of rows in the earlier slices. No window ever spans a whole group.
    """
    group = list(group or [])
    slices = parallelism(df.sparkSession)
    sliced = df.withColumn("_h", mix(id_col, seed)).withColumn(
        "_slice", F.floor(F.col("_h") * F.lit(slices) / F.lit(PRIME)).cast("int")
    )
    counts = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_slice").alias("_oslice"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*group, "_slice").orderBy("_h", id_col)
    numbered = sliced.withColumn("_rn", F.row_number().over(inside))
    cond = F.col("_slice") == F.col("_oslice")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = numbered.join(offsets, cond)
    drop = ["_h", "_slice", "_oslice", "_rn", "_before"] + [f"_g_{g}" for g in group]
    return joined.withColumn(name, (F.col("_rn") + F.col("_before")).cast("bigint")).drop(*drop)


def group_sizes(df: DataFrame, group: list[str], name: str = "n_group") -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias(name))
