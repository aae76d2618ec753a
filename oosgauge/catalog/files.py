import uuid

from pyspark.sql import functions as F

from oosgauge.catalog.base import EO, PTS, SPLIT_SEED, embeddings, query, r6, table
from oosgauge.catalog.prep import _strat
from oosgauge.operators import prep as P
from oosgauge.session import scratch_root
from oosgauge.sources import staged as S


def _path(spark, what):
    return f"{scratch_root(spark).rstrip('/')}/oosgauge-{what}-{uuid.uuid4().hex}"


def _staged(spark, d):
    pts = P.random_split(embeddings(spark, d), 0.7, SPLIT_SEED)
    return pts.select(F.lit("emb").alias("dataset"), F.lit(0).alias("stage"), "split", "id", "features", "label")


@query(
    "write_staged",
    f"WITH {PTS}, {EO} SELECT 'emb' AS dataset, 0 AS stage, split, count(*) AS n, round(sum(v[1]), 6) AS s, count(label) AS labels FROM eo GROUP BY split",
)
def write_staged(spark, d):
    path = _path(spark, "staged")
    S.write_staged(_staged(spark, d), path)
    back = S.read_staged(spark, path, "emb")
    return back.groupBy("dataset", "stage", "split").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("features")[0])).alias("s"), F.count("label").alias("labels")
    )


@query(
    "read_staged",
    f"SELECT c_custkey AS id, c_acctbal AS v, split FROM (SELECT c_custkey, c_acctbal, {_strat('0.5::DOUBLE', 9)} FROM customer)",
)
def read_staged(spark, d):
    """Stage 2 of a five-stage table; the scan reads that stage's directories only."""
    cu = table(spark, d, "customer").select(
        F.lit("cust").alias("dataset"),
        F.col("c_custkey").alias("id"),
        F.array("c_acctbal").alias("features"),
        F.col("c_mktsegment").alias("label"),
    )
    path = _path(spark, "stages")
    S.write_staged(P.proportion_stages(cu, 9), path)
    back = S.read_staged(spark, path, "cust", stage=2)
    return back.select("id", F.col("features")[0].alias("v"), "split")


@query("read_projection", f"WITH {PTS} SELECT id, round(p[1], 6) AS x, round(p[2], 6) AS y FROM pts")
def read_projection(spark, d):
    path = _path(spark, "proj")
    S.write_projection(embeddings(spark, d), path)
    return S.read_projection(spark, path).select("id", r6("x").alias("x"), r6("y").alias("y"))


@query("write_projection", f"WITH {PTS} SELECT id, round(p[1], 6) AS x, round(p[2], 6) AS y, label, round(v[3], 6) AS z FROM pts")
def write_projection(spark, d):
    path = _path(spark, "proj")
    S.write_projection(embeddings(spark, d).withColumn("z", F.col("features")[2]), path, vec="features", extra=["z"])
    back = S.read_projection(spark, path, S.PROJECTION_SCHEMA + ", z double")
    return back.select("id", r6("x").alias("x"), r6("y").alias("y"), "label", r6("z").alias("z"))


@query(
    "projection_catalog",
    f"WITH {PTS}, {EO}, n AS (SELECT count(*) FILTER (split = 'E') AS e, count(*) FILTER (split = 'O') AS o FROM eo) "
    "SELECT 'emb_dist' AS dataset, 0 AS stage, 'axes' AS method, e AS n_train, o AS n_test FROM n "
    "UNION ALL SELECT 'emb_dist', 0, 'tail', 0, o FROM n",
)
def projection_catalog(spark, d):
    root = _path(spark, "projections")
    pts = P.random_split(embeddings(spark, d), 0.7, SPLIT_SEED)
    for method, split, vec in (("axes", "E", "proj"), ("axes", "O", "proj"), ("tail", "O", "features")):
        name = S.projection_name("emb", method, 0, split, diff="dist")
        S.write_projection(pts.filter(F.col("split") == split), f"{root}/{name}", vec=vec)
    return S.projection_catalog(spark, root, synth=True)


_PARAMS = ", ".join(f"('{p}', '{m}', {float(v)}::DOUBLE)" for p, by in S.METHOD_PARAMETERS.items() for m, v in by.items())
_NAMES = "[" + ", ".join(f"'{m}'" for m in S.METHODS) + "]"


@query(
    "grid_config",
    f"WITH c AS (SELECT * FROM (VALUES {_PARAMS}) t(param, method, value)), "
    f"r AS (SELECT {_NAMES}[user_id % 16 + 1] AS method, count(*) AS runs FROM events GROUP BY 1) "
    "SELECT r.method, r.runs, c.param, c.value FROM r JOIN c ON c.method = r.method",
)
def grid_config(spark, d):
    runs = runs_by_method(table(spark, d, "events")).groupBy("method").agg(F.count(F.lit(1)).alias("runs"))
    return runs.join(S.parameter_table(spark), "method").select("method", "runs", "param", "value")


def runs_by_method(events):
    names = F.array(*[F.lit(m) for m in S.METHODS])
    return events.withColumn("method", F.element_at(names, (F.col("user_id") % 16 + 1).cast("int")))


@query(
    "run_manifest",
    f"WITH m AS (SELECT DISTINCT {_NAMES}[user_id % 16 + 1] AS method FROM events), "
    "ds AS (SELECT event_type AS dataset, count(*) AS n_samples FROM events GROUP BY event_type) "
    "SELECT method, dataset, n_samples, 1 AS n_stages, true AS labelled FROM m, ds",
)
def run_manifest(spark, d):
    ev = runs_by_method(table(spark, d, "events"))
    # the grid's method and dataset names: a few configured values
    methods = [r[0] for r in ev.select("method").distinct().orderBy("method").collect()]
    sizes = ev.groupBy("event_type").count().orderBy("event_type").collect()
    path = _path(spark, "manifest")
    S.write_manifest(
        spark, path, methods, [{"name": r[0], "n_samples": r[1], "n_stages": 1, "labelled": True} for r in sizes]
    )
    return S.read_manifest(spark, path)


@query(
    "result_sink",
    f"SELECT {_NAMES}[user_id % 16 + 1] AS method, event_type AS metric, 'ev' AS dataset_name, (event_id % 4)::INT AS stage, "
    "round(avg(value), 6) AS result FROM events GROUP BY ALL",
)
def result_sink(spark, d):
    ev = runs_by_method(table(spark, d, "events"))
    rows = ev.groupBy("method", F.col("event_type").alias("metric"), F.lit("ev").alias("dataset_name"), (F.col("event_id") % 4).cast("int").alias("stage")).agg(F.avg("value").alias("result"))
    path = _path(spark, "results")
    S.write_results(rows, path)
    return S.read_results(spark, path).withColumn("result", r6("result"))


@query(
    "delimited_scan",
    "SELECT (n_nationkey % 5)::INT AS label, count(*) AS n, round(sum(c_acctbal), 6) AS s, round(sum(c_custkey), 6)::DOUBLE AS k "
    "FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
)
def delimited_scan(spark, d):
    cu = table(spark, d, "customer")
    path = _path(spark, "text")
    line = F.concat_ws(" ", F.regexp_replace("c_name", " ", ""), "c_acctbal", "c_custkey", F.col("c_nationkey") % 5)
    cu.select(line.alias("value")).write.text(path)
    back = S.read_delimited(spark, path, 2)
    return back.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("features")[0])).alias("s"), r6(F.sum(F.col("features")[1])).alias("k")
    )
