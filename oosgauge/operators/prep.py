"""Row preparation: scaling, splitting, batching, sampling, shifting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oosgauge.functions.draws import mix, shuffled_position
from oosgauge.session import sized

# --- scaling ----------------------------------------------------------------


def dimension_stats(df: DataFrame, vec: str = "features") -> DataFrame:
    """Per dimension mean, population deviation, min and max: d rows."""
    long = df.select(F.posexplode(vec).alias("dim", "v"))
    return long.groupBy("dim").agg(
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )


def _stat_arrays(stats: DataFrame) -> tuple[list[float], ...]:
    """The d rows of statistics as driver lists; d is a vector length, not a row count."""
    rows = sorted(stats.collect(), key=lambda r: r["dim"])
    return tuple([r[c] for r in rows] for c in ("mean", "std", "min", "max"))


def _literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def standard_scale(fit_on: DataFrame, *apply_to: DataFrame, vec: str = "features") -> list[DataFrame]:
    """z-score by the population deviation of ``fit_on``; constant dimensions divide by 1."""
    mean, std, _, _ = _stat_arrays(dimension_stats(fit_on, vec))
    m = _literal(mean)
    s = _literal([v if v > 0 else 1.0 for v in std])
    scaled = F.zip_with(F.zip_with(F.col(vec), m, lambda x, a: x - a), s, lambda x, b: x / b)
    return [df.withColumn(vec, scaled) for df in (apply_to or (fit_on,))]


def minmax_scale(fit_on: DataFrame, *apply_to: DataFrame, vec: str = "features") -> list[DataFrame]:
    """Each dimension of ``fit_on`` to [0, 1]; constant dimensions divide by 1."""
    _, _, low, high = _stat_arrays(dimension_stats(fit_on, vec))
    lo = _literal(low)
    span = _literal([h - l if h > l else 1.0 for l, h in zip(low, high)])
    scaled = F.zip_with(F.zip_with(F.col(vec), lo, lambda x, a: x - a), span, lambda x, b: x / b)
    return [df.withColumn(vec, scaled) for df in (apply_to or (fit_on,))]


def global_minmax(df: DataFrame, vec: str = "proj", by: list[str] | None = None) -> DataFrame:
    """One min and max over all coordinates of a batch (of each ``by`` group)."""
    by = by or []
    lim = df.groupBy(*by).agg(F.min(F.array_min(vec)).alias("_lo"), F.max(F.array_max(vec)).alias("_hi"))
    joined = df.join(sized(lim), by) if by else df.join(F.broadcast(lim))  # one row
    span = F.col("_hi") - F.col("_lo")
    return joined.withColumn(
        vec, F.transform(vec, lambda x: F.try_divide(x - F.col("_lo"), span))
    ).drop("_lo", "_hi")


# --- splitting --------------------------------------------------------------


def random_split(df: DataFrame, fraction: float, seed: int, id_col: str = "id") -> DataFrame:
    """Adds ``split``: the first round(fraction * n) rows of the shuffled order are E."""
    n = df.count()
    placed = shuffled_position(df, id_col, seed)
    cut = F.round(F.lit(float(fraction)) * F.lit(float(n)))
    return placed.withColumn("split", F.when(F.col("pos") <= cut, "E").otherwise("O")).drop("pos")


def stratified_split(
    df: DataFrame, fraction: float | Column, seed: int, label: str = "label", id_col: str = "id"
) -> DataFrame:
    """Adds ``split``, taking the same share of every label for E."""
    frac = F.lit(float(fraction)) if not isinstance(fraction, Column) else fraction
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    placed = shuffled_position(df, id_col, seed, [label])
    joined = placed.join(sized(sizes.withColumnRenamed(label, "_l")), F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
    cut = F.round(frac * F.col("_size").cast("double"))
    return joined.withColumn("split", F.when(F.col("pos") <= cut, "E").otherwise("O")).drop("pos", "_size")


#: training shares of the staged tables (fixed values)
PROPORTIONS = (0.9, 0.7, 0.5, 0.3, 0.1)


def proportion_stages(
    df: DataFrame, seed: int, label: str | None = "label", fractions=PROPORTIONS, id_col: str = "id"
) -> DataFrame:
    """One stage per fraction: adds ``stage, split``. Rows are numbered once for all stages."""
    group = [label] if label else []
    placed = shuffled_position(df, id_col, seed, group)
    if label:
        sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size")).withColumnRenamed(label, "_l")
        placed = placed.join(sized(sizes), F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
    else:
        placed = placed.withColumn("_size", F.lit(df.count()))
    fr = F.array(*[F.lit(float(f)) for f in fractions])
    staged = placed.select("*", F.posexplode(fr).alias("stage", "_f"))
    cut = F.round(F.col("_f") * F.col("_size").cast("double"))
    return staged.withColumn("split", F.when(F.col("pos") <= cut, "E").otherwise("O")).drop("pos", "_size", "_f")


def distribution_shift(df: DataFrame, shifts: DataFrame, vec: str = "features", cluster: str = "label") -> DataFrame:
    """Move the O rows: per cluster and axis, ``v * scale + offset``; E rows stay.

    ``shifts`` holds ``cluster, axis, scale, offset``, one row per moved axis.
    """
    spec = shifts.groupBy("cluster").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("axis").cast("int"), F.struct("scale", "offset")))
        ).alias("_m")
    )
    joined = df.join(spec.withColumnRenamed("cluster", "_c"), F.col(cluster) == F.col("_c"), "left").drop("_c")

    def move(x, i):
        s = F.element_at(F.col("_m"), i.cast("int"))
        return F.when(s.isNotNull(), x * s["scale"] + s["offset"]).otherwise(x)

    moved = F.when((F.col("split") == "O") & F.col("_m").isNotNull(), F.transform(vec, move)).otherwise(F.col(vec))
    return joined.withColumn(vec, moved).drop("_m")


def union_splits(e: DataFrame, o: DataFrame) -> DataFrame:
    return e.unionByName(o)


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


# --- batches and samples ----------------------------------------------------


def shuffled_batches(df: DataFrame, batch_size: int, seed: int, id_col: str = "id", full_only: bool = True) -> DataFrame:
    """Adds ``batch``: consecutive runs of the shuffled order, the last short run dropped."""
    placed = shuffled_position(df, id_col, seed)
    batched = placed.withColumn("batch", F.floor((F.col("pos") - 1) / F.lit(batch_size)).cast("bigint"))
    if full_only:
        batched = batched.filter(F.col("batch") < F.lit(df.count() // batch_size))
    return batched.drop("pos")


def sequential_batches(df: DataFrame, batch_size: int, id_col: str = "id") -> DataFrame:
    """Batches in id order, full ones only."""
    from oosgauge.operators.quality import row_places

    places = row_places(df.select(F.col(id_col).cast("bigint").alias("id")))
    batched = places.withColumn("batch", F.floor(F.col("s") / F.lit(batch_size)).cast("bigint"))
    full = batched.filter(F.col("batch") < F.lit(df.count() // batch_size))
    return df.join(full.select(F.col("id").alias("_id"), "batch"), F.col(id_col) == F.col("_id")).drop("_id")


MIN_PINNED = 400


def pinned_sample(df: DataFrame, links: DataFrame, ratio: float, seed: int, minimum: int = MIN_PINNED, id_col: str = "id") -> DataFrame:
    """``id``: max(floor(ratio n), minimum) shuffled rows, and every linked row."""
    size = max(int(df.count() * ratio), minimum)
    drawn = shuffled_position(df.select(id_col), id_col, seed).filter(F.col("pos") <= size).select(id_col)
    linked = links.select(F.explode(F.array("head", "tail")).alias(id_col))
    return drawn.unionByName(linked).distinct()


def subsample(df: DataFrame, size: int, seed: int, id_col: str = "id") -> DataFrame:
    """The first ``size`` rows of the shuffled order, exactly, without a global sort."""
    return df.orderBy(mix(id_col, seed), id_col).limit(size)
