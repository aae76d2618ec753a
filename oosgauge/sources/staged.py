"""Staged tables, projections, results and other files, as Spark sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAGE_KEYS = ["dataset", "stage", "split"]


def write_staged(df: DataFrame, path: str, mode: str = "append") -> None:
    """Persist ``dataset, stage, split, id, features[, label, ...]``, one directory per part.

    Rows are spread inside each part by id, so a large split is many files and a
    task never writes into more than a few directories.
    """
    spread = F.pmod(F.xxhash64("id"), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    df.repartition(*STAGE_KEYS, spread).write.mode(mode).partitionBy(*STAGE_KEYS).parquet(path)


def staged_schema(df_schema: T.StructType) -> T.StructType:
    return T.StructType([f for f in df_schema.fields if f.name not in STAGE_KEYS])


def read_staged(spark: SparkSession, path: str, dataset: str, stage: int | None = None, labelled: bool = True) -> DataFrame:
    """One dataset (one stage) with its E and O rows; partition filters prune the scan."""
    df = spark.read.parquet(path).filter(F.col("dataset") == dataset)
    if stage is not None:
        df = df.filter(F.col("stage") == stage)
    if not labelled and "label" in df.columns:
        df = df.withColumn("label", F.lit(None).cast("int"))
    return df


PROJECTION_SCHEMA = "id bigint, x double, y double, label int"


def write_projection(df: DataFrame, path: str, vec: str = "proj", extra: list[str] | None = None) -> None:
    """CSV of the first two dimensions as x, y with an optional label and further columns."""
    cols: list[Column] = [F.col("id"), F.col(vec)[0].alias("x"), F.col(vec)[1].alias("y")]
    cols += [F.col(c) for c in (["label"] if "label" in df.columns else []) + list(extra or [])]
    df.select(*cols).write.mode("errorifexists").option("header", True).csv(path)


def read_projection(spark: SparkSession, path: str, schema: str = PROJECTION_SCHEMA) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def projection_name(dataset: str, method: str, stage: int, split: str, diff: str | None = None) -> str:
    head = f"{dataset}_{diff}" if diff else dataset
    return f"{head}_{method}_{stage}_{'train' if split == 'E' else 'test'}.csv"


def projection_catalog(spark: SparkSession, root: str, synth: bool = False) -> DataFrame:
    """``dataset, stage, method, n_train, n_test`` from names
    ``dataset[_diff]_method_stage_split.csv`` below ``root`` and the rows inside."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("header", True)
    rows = text.schema("id bigint").csv(root).select("_metadata.file_path")
    stem = F.regexp_extract("file_path", r"([^/]+)\.csv(/[^/]*)?$", 1)
    parts = F.split(stem, "_")
    dataset = F.concat_ws("_", parts[0], parts[1]) if synth else parts[0]
    parsed = rows.select(
        dataset.alias("dataset"),
        F.element_at(parts, -2).cast("int").alias("stage"),
        F.element_at(parts, -3).alias("method"),
        F.element_at(parts, -1).alias("part"),
    )
    wide = parsed.groupBy("dataset", "stage", "method").pivot("part", ["train", "test"]).count()
    return wide.select(
        "dataset", "stage", "method", F.coalesce("train", F.lit(0)).alias("n_train"), F.coalesce("test", F.lit(0)).alias("n_test")
    )


def write_manifest(spark: SparkSession, path: str, methods: list[str], datasets: list[dict]) -> None:
    row = [(methods, [(d["name"], d["n_samples"], d["n_stages"], d["labelled"]) for d in datasets])]
    schema = (
        "methods array<string>, datasets array<struct<name:string,n_samples:bigint,n_stages:int,labelled:boolean>>"
    )
    spark.createDataFrame(row, schema).write.mode("errorifexists").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per (method, dataset) of a saved run, to score the same grid again."""
    schema = (
        "methods array<string>, datasets array<struct<name:string,n_samples:bigint,n_stages:int,labelled:boolean>>"
    )
    m = spark.read.schema(schema).json(path)
    return m.select(F.explode("methods").alias("method"), "datasets").select("method", F.explode("datasets").alias("d")).select(
        "method", F.col("d.name").alias("dataset"), "d.n_samples", "d.n_stages", "d.labelled"
    )


RESULT_SCHEMA = "method string, metric string, dataset_name string, stage int, result double"


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_delimited(spark: SparkSession, path: str, width: int, sep: str = " ") -> DataFrame:
    """Text rows ``name v1 .. vd label``: drop the first field, the last is the label."""
    fields = [T.StructField("_name", T.StringType())]
    fields += [T.StructField(f"_v{i}", T.DoubleType()) for i in range(width)]
    fields += [T.StructField("label", T.DoubleType())]
    raw = spark.read.option("sep", sep).schema(T.StructType(fields)).csv(path)
    return raw.select(F.array(*[f"_v{i}" for i in range(width)]).alias("features"), F.col("label").cast("int").alias("label"))


GENERATOR_SCHEMA = (
    "samples bigint, dims int, generators array<struct<type:string,weight:double,params:struct<"
    "pdf:string,dimensions:array<int>,labeled:int,manifold:string,rotations:array<double>,"
    "scale:array<double>,translate:array<double>,rot_axis:string>>>"
)


def read_generator_spec(spark: SparkSession, path: str) -> DataFrame:
    """One row per generator of a JSON spec; ``pdf`` stays JSON as it is 1-D or 2-D."""
    spec = spark.read.option("multiLine", True).schema(GENERATOR_SCHEMA).json(path)
    return spec.select("samples", "dims", F.posexplode("generators").alias("pos", "g")).select(
        "samples", "dims", "pos", F.col("g.type").alias("type"), F.col("g.weight").alias("weight"), "g.params.*"
    )


def write_generator_spec(spark: SparkSession, path: str, spec: dict) -> None:
    """One JSON document, as a one-row text table."""
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


# --- configuration ----------------------------------------------------------

#: parameter values by name and method (fixed values)
METHOD_PARAMETERS = {
    "knn": {"pumap": 15, "cdr": 15, "dlmp-umap": 15, "mi-mds": 15, "lisomap": 15, "kisomap": 15, "oos-isomap": 15},
    "perplexities": {"ptsne": 30, "ptsne_new": 30, "ptsne22": 30, "dlmp-tsne": 30, "ktsne": 30},
    "epochs": {
        "ptsne": 1000, "ptsne_new": 300, "ptsne22": 1000, "autoencoder": 1000, "cdr": 1000,
        "dlmp-tsne": 1000, "dlmp-umap": 1000, "mi-mds": 1000,
    },
    "lr": {
        "ptsne": 0.001, "ptsne_new": 0.01, "autoencoder": 0.001, "cdr": 0.001, "dlmp-tsne": 0.001, "dlmp-umap": 0.001,
    },
}

#: methods of the comparison grid (fixed values)
METHODS = [
    "pca", "ae", "cdr", "oos-mds", "lmds", "kmds", "mimds", "oos-isomap", "lisomap", "kisomap", "ktsne",
    "ptsne", "ptsne22", "dlmp-tsne", "pumap", "dlmp-umap",
]


def parameter(name: str, method: str, table: dict | None = None):
    table = METHOD_PARAMETERS if table is None else table
    if name not in table:
        raise ValueError(f"unknown parameter {name!r}")
    if method not in table[name]:
        raise ValueError(f"unknown method {method!r} for parameter {name!r}")
    return table[name][method]


def parameter_table(spark: SparkSession, table: dict | None = None) -> DataFrame:
    table = METHOD_PARAMETERS if table is None else table
    rows = [(p, m, float(v)) for p, by in table.items() for m, v in by.items()]
    return spark.createDataFrame(rows, "param string, method string, value double")
