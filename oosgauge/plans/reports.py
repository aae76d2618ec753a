"""Comparison grids and summaries over long result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def experiment_grid(*axes: DataFrame) -> DataFrame:
    """Every combination of small configuration tables."""
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(F.broadcast(a))  # configuration tables: tens of rows
    return out


def grid_select(available: DataFrame, wanted: list[str] | None, column: str) -> DataFrame:
    """Rows of the named entries; none or 'all' means every row; unknown names are refused."""
    if not wanted or "all" in wanted:
        return available
    names = available.sparkSession.createDataFrame([(w,) for w in wanted], f"{column} string")
    unknown = [r[0] for r in names.join(available.select(column).distinct(), column, "left_anti").collect()]
    if unknown:
        raise ValueError(f"unknown {column}: {sorted(unknown)}")
    return available.join(F.broadcast(names), column, "left_semi")


def weighted_mean_runtime(train: DataFrame, test: DataFrame, props: list[int]) -> DataFrame:
    """``method, prop, train, test``: sample-weighted mean seconds; absent cells are null."""

    def mean(df: DataFrame, time: str, name: str) -> DataFrame:
        w = F.col("n_samples").cast("double")
        return df.groupBy("method", "prop").agg((F.sum(w * F.col(time)) / F.sum(w)).alias(name))

    spark = train.sparkSession
    cells = experiment_grid(
        train.select("method").distinct(), spark.createDataFrame([(p,) for p in props], "prop int")
    )
    return cells.join(mean(train, "train_time", "train"), ["method", "prop"], "left").join(
        mean(test, "test_time", "test"), ["method", "prop"], "left"
    )


def structure_grid(results: DataFrame, methods: list[str], stage: int = 1) -> DataFrame:
    """manifold x method at diff 'prop', one row per metric and manifold."""
    cells = results.filter((F.col("diff") == "prop") & (F.col("stage") == stage))
    return cells.groupBy("metric", "manifold").pivot("method", methods).agg(F.first("result"))


def shift_pairs(results: DataFrame) -> DataFrame:
    """Per metric, manifold, method: without shift (prop, stage 1) against with (dist, stage 0)."""
    key = ["metric", "manifold", "method"]
    plain = results.filter("diff = 'prop' and stage = 1").select(*key, F.col("result").alias("no_shift"))
    moved = results.filter("diff = 'dist' and stage = 0").select(*key, F.col("result").alias("shift"))
    return plain.join(moved, key, "full").withColumn("delta", F.col("shift") - F.col("no_shift"))


def proportion_grid(results: DataFrame, methods: list[str], by: str = "manifold") -> DataFrame:
    """stage x method per metric and manifold (or dataset)."""
    cells = results.filter("diff = 'prop'") if "diff" in results.columns else results
    return cells.groupBy("metric", by, "stage").pivot("method", methods).agg(F.first("result"))


def missing_mask(results: DataFrame, axes: list[DataFrame]) -> DataFrame:
    """The full grid with ``missing`` where no result exists."""
    grid = experiment_grid(*axes)
    keys = grid.columns
    seen = results.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return grid.join(seen, keys, "left").select(*keys, F.col("_seen").isNull().alias("missing"))


def best_method(results: DataFrame, by: list[str], large_is_best: bool = True) -> DataFrame:
    """Per row of the grid the winning method; ties to the first name."""
    sign = F.col("result") if large_is_best else -F.col("result")
    best = F.min(F.struct((-sign).alias("k"), F.col("method").alias("m"), F.col("result").alias("r")))
    return results.filter("result is not null").groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col("_b.m").alias("method"), F.col("_b.r").alias("result")
    )


def delta_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per pair midpoint and delta, with the group's overall min, max and range."""
    span = pairs.groupBy(*by).agg(
        F.min(F.least("no_shift", "shift")).alias("total_min"), F.max(F.greatest("no_shift", "shift")).alias("total_max")
    )
    return (
        pairs.join(span, by)
        .withColumn("total_delta", F.col("total_max") - F.col("total_min"))
        .withColumn("middle", (F.col("shift") + F.col("no_shift")) * 0.5)
        .withColumn("delta", F.col("shift") - F.col("no_shift"))
    )


def metric_matrix(results: DataFrame, metrics: list[str]) -> DataFrame:
    return results.groupBy("method").pivot("metric", metrics).agg(F.first("result"))


def distinct_values(results: DataFrame, column: str) -> DataFrame:
    return results.select(column).distinct()


def axis_limits(projections: DataFrame, cell: list[str]) -> DataFrame:
    """Frame of the E projection of each cell, for drawing its O projection."""
    e = projections.filter("split = 'E'")
    return e.groupBy(*cell).agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")
    )


def projection_with_label(projections: DataFrame, staged: DataFrame, label_columns: dict[str, str]) -> DataFrame:
    """Projection rows with the label column configured for their dataset; others are left out."""
    choice = None
    for dataset, column in label_columns.items():
        here = F.when(F.col("dataset") == dataset, F.col(column).cast("double"))
        choice = here if choice is None else F.coalesce(choice, here)
    labels = staged.filter(F.col("dataset").isin(list(label_columns))).select(
        "dataset", "stage", "split", "id", choice.alias("label")
    )
    return projections.join(labels, ["dataset", "stage", "split", "id"])


# --- dataset description ----------------------------------------------------


def n_samples(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("double").alias("n"), F.max(F.size("features")).cast("double").alias("d"))


def sparsity_ratio(df: DataFrame) -> DataFrame:
    """1 - nonzero share; counted inside each vector."""
    filled = F.size(F.filter("features", lambda v: v != 0))
    return df.agg((F.lit(1.0) - F.sum(filled) / F.sum(F.size("features"))).cast("double").alias("sp"))


def n_classes(df: DataFrame) -> DataFrame:
    return df.agg(F.nullif(F.countDistinct("label"), F.lit(0)).cast("double").alias("cl"))


def dataset_profile(df: DataFrame, intrinsic: bool = True, ratio: float = 0.95) -> DataFrame:
    """Long rows ``metric, result`` for n, d, id, sp, cl of E and O together."""
    from oosgauge.operators.linear import intrinsic_dims

    wide = n_samples(df).join(sparsity_ratio(df)).join(n_classes(df))  # one row each
    names = ["n", "d", "sp", "cl"]
    long = wide.select(F.expr("stack(4, " + ", ".join(f"'{m}', {m}" for m in names) + ") as (metric, result)"))
    if intrinsic:
        long = long.unionByName(
            df.sparkSession.createDataFrame([("id", float(intrinsic_dims(df, ratio)))], "metric string, result double")
        )
    return long.filter("result is not null")
