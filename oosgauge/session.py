"""Session defaults and the few session-dependent helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_oosgauge_shipped", False):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="oosgauge-"), "oosgauge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("oosgauge", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._oosgauge_shipped = True
    return spark


def local_session(cores: str | int = 8, app: str = "oosgauge", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {**CONF, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", **extra}
    for key, value in settings.items():
        b = b.config(key, value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def parallelism(spark: SparkSession) -> int:
    """Task slots worth filling: the larger of cores and shuffle partitions."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(spark.sparkContext.defaultParallelism, shuffle)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    A session on one machine may go without: it gets a temporary folder. On a cluster that
    would be a folder per machine, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="oosgauge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: rows of a table that may be sent to every task
MOST_SENT = 100_000


def sized(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most ``MOST_SENT`` rows; otherwise as it is, joined by shuffle."""
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df


def stable(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    Survives the loss of any executor, gives later joins a known size, and pins
    anything that would differ between two evaluations. With ``by`` a filter on that column
    reads its rows alone.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/oosgauge-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
