"""Named queries over the given tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oosgauge.functions.draws import mix_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its oracle, if SQL can express it."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, features, proj, label``: the projection is the first two coordinates."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), v.alias("features"), F.slice(v, 1, 2).alias("proj"), "label"
    )


SPLIT_SEED = 11
E_SHARE = 0.7


def split_embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Seeded 70/30 split of the whole table into E and O."""
    from oosgauge.operators.prep import random_split

    return halves(random_split(embeddings(spark, sf_dir), E_SHARE, SPLIT_SEED))


def halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("split = 'E'").drop("split"), df.filter("split = 'O'").drop("split")


def r6(c: Column | str) -> Column:
    """Sums depend on their order; results are compared to six decimals."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


PTS = (
    "pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, "
    "[embedding[1]::DOUBLE, embedding[2]::DOUBLE] AS p, label FROM embeddings)"
)
#: every ordered pair of different rows with both distances
PAIRS = (
    "pr AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS dh, list_distance(a.p, b.p) AS dl, "
    "a.label AS li, b.label AS lj FROM pts a JOIN pts b ON a.id <> b.id)"
)
#: both ranks of j seen from i
RANKS = (
    "rk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dh, j) AS rh, "
    "row_number() OVER (PARTITION BY i ORDER BY dl, j) AS rl FROM pr)"
)
#: the same split as ``split_embeddings``
EO = (
    "eo AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY "
    f"{mix_sql('id', SPLIT_SEED)}, id) <= round({E_SHARE}::DOUBLE * (SELECT count(*) FROM pts)) "
    "THEN 'E' ELSE 'O' END AS split FROM pts)"
)
