from pyspark.sql import functions as F

from oosgauge.catalog.base import EO, PTS, SPLIT_SEED, embeddings, query, r6, table
from oosgauge.catalog.files import _NAMES, runs_by_method
from oosgauge.operators import prep as P
from oosgauge.plans import reports as R
from oosgauge.sources.staged import METHODS

#: long result rows from the event table, one per (metric, manifold, diff, stage, method)
RES = (
    f"res AS (SELECT event_type AS metric, 'syn' || (user_id % 3 + 1) AS manifold, "
    "CASE WHEN event_id % 5 = 4 THEN 'dist' ELSE 'prop' END AS diff, (CASE WHEN event_id % 5 = 4 THEN 0 ELSE event_id % 5 END)::INT AS stage, "
    f"{_NAMES}[user_id % 16 + 1] AS method, avg(value) AS result FROM events GROUP BY ALL)"
)


def results(spark, d):
    e = runs_by_method(table(spark, d, "events"))
    five = F.col("event_id") % 5
    return e.groupBy(
        F.col("event_type").alias("metric"),
        F.concat(F.lit("syn"), (F.col("user_id") % 3 + 1).cast("string")).alias("manifold"),
        F.when(five == 4, "dist").otherwise("prop").alias("diff"),
        F.when(five == 4, 0).otherwise(five).cast("int").alias("stage"),
        "method",
    ).agg(F.avg("value").alias("result"))


def _pivot_sql(keys, where):
    cells = ", ".join(f"round(max(result) FILTER (method = '{m}'), 6) AS \"{m}\"" for m in METHODS)
    return f"WITH {RES} SELECT {keys}, {cells} FROM res WHERE {where} GROUP BY {keys}"


def _wide(df, keys):
    return df.select(*keys, *[r6(f"`{m}`").alias(m) for m in METHODS])


@query("structure_grid", _pivot_sql("metric, manifold", "diff = 'prop' AND stage = 1"))
def structure_grid(spark, d):
    return _wide(R.structure_grid(results(spark, d), METHODS), ["metric", "manifold"])


@query("proportion_grid", _pivot_sql("metric, manifold, stage", "diff = 'prop'"))
def proportion_grid(spark, d):
    return _wide(R.proportion_grid(results(spark, d), METHODS), ["metric", "manifold", "stage"])


SHIFT = (
    f"WITH {RES}, a AS (SELECT * FROM res WHERE diff = 'prop' AND stage = 1), b AS (SELECT * FROM res WHERE diff = 'dist' AND stage = 0), "
    "sp AS (SELECT coalesce(a.metric, b.metric) AS metric, coalesce(a.manifold, b.manifold) AS manifold, coalesce(a.method, b.method) AS method, "
    "a.result AS no_shift, b.result AS shift, b.result - a.result AS delta FROM a FULL JOIN b ON a.metric = b.metric AND a.manifold = b.manifold AND a.method = b.method) "
)


@query("shift_pairs", SHIFT + "SELECT metric, manifold, method, round(no_shift, 6) AS no_shift, round(shift, 6) AS shift, round(delta, 6) AS delta FROM sp")
def shift_pairs(spark, d):
    return R.shift_pairs(results(spark, d)).select("metric", "manifold", "method", *[r6(c).alias(c) for c in ("no_shift", "shift", "delta")])


@query(
    "delta_summary",
    SHIFT + "SELECT metric, manifold, method, round(min(least(no_shift, shift)) OVER w, 6) AS total_min, round(max(greatest(no_shift, shift)) OVER w, 6) AS total_max, "
    "round(max(greatest(no_shift, shift)) OVER w - min(least(no_shift, shift)) OVER w, 6) AS total_delta, round((shift + no_shift) * 0.5::DOUBLE, 6) AS middle, "
    "round(delta, 6) AS delta FROM sp WINDOW w AS (PARTITION BY metric, manifold)",
)
def delta_summary(spark, d):
    out = R.delta_summary(R.shift_pairs(results(spark, d)), ["metric", "manifold"])
    return out.select("metric", "manifold", "method", *[r6(c).alias(c) for c in ("total_min", "total_max", "total_delta", "middle", "delta")])


@query(
    "missing_mask",
    f"WITH {RES}, g AS (SELECT * FROM (SELECT DISTINCT metric FROM res), (SELECT DISTINCT method FROM res), (SELECT unnest(['dist', 'prop']) AS diff), "
    "(SELECT unnest([0, 1, 2, 3]) AS stage)), s AS (SELECT DISTINCT metric, method, diff, stage FROM res) "
    "SELECT g.metric, g.method, g.diff, g.stage, s.metric IS NULL AS missing FROM g LEFT JOIN s ON s.metric = g.metric AND s.method = g.method AND s.diff = g.diff AND s.stage = g.stage",
)
def missing_mask(spark, d):
    res = results(spark, d)
    axes = [
        res.select("metric").distinct(),
        res.select("method").distinct(),
        spark.createDataFrame([("dist",), ("prop",)], "diff string"),
        spark.createDataFrame([(s,) for s in range(4)], "stage int"),
    ]
    return R.missing_mask(res, axes)


@query(
    "best_method",
    f"WITH {RES}, o AS (SELECT *, row_number() OVER (PARTITION BY metric, manifold, diff, stage ORDER BY result DESC, method) AS r FROM res) "
    "SELECT metric, manifold, diff, stage, method, round(result, 6) AS result FROM o WHERE r = 1",
)
def best_method(spark, d):
    return R.best_method(results(spark, d), ["metric", "manifold", "diff", "stage"]).withColumn("result", r6("result"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "metric_matrix",
    f"WITH m AS (SELECT {_NAMES}[user_id % 16 + 1] AS method, event_type AS metric, avg(value) AS result FROM events GROUP BY ALL) SELECT method, "
    + ", ".join(f"round(max(result) FILTER (metric = '{t}'), 6) AS {t}" for t in _TYPES)
    + " FROM m GROUP BY method",
)
def metric_matrix(spark, d):
    e = runs_by_method(table(spark, d, "events"))
    m = e.groupBy("method", F.col("event_type").alias("metric")).agg(F.avg("value").alias("result"))
    return R.metric_matrix(m, _TYPES).select("method", *[r6(t).alias(t) for t in _TYPES])


@query("distinct_values", f"WITH {RES} SELECT DISTINCT manifold FROM res")
def distinct_values(spark, d):
    return R.distinct_values(results(spark, d), "manifold")


@query(
    "experiment_grid",
    "SELECT p.p_type AS dataset, s.stage, m.method, p.n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type) p, "
    f"(SELECT unnest([0, 1, 2, 3]) AS stage) s, (SELECT unnest({_NAMES}) AS method) m",
)
def experiment_grid(spark, d):
    sets = table(spark, d, "part").groupBy(F.col("p_type").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    stages = spark.createDataFrame([(s,) for s in range(4)], "stage int")
    methods = spark.createDataFrame([(m,) for m in METHODS], "method string")
    return R.experiment_grid(sets, stages, methods).select("dataset", "stage", "method", "n")


@query(
    "grid_select",
    "SELECT p_brand AS dataset, p_type AS method, count(*) AS n, round(avg(p_retailprice), 6) AS price FROM part "
    "WHERE p_brand IN ('Brand#2', 'Brand#17') GROUP BY ALL",
)
def grid_select(spark, d):
    cells = table(spark, d, "part").select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("method"), "p_retailprice")
    picked = R.grid_select(cells, ["Brand#2", "Brand#17"], "dataset")
    picked = R.grid_select(picked, ["all"], "method")
    return picked.groupBy("dataset", "method").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p_retailprice")).alias("price"))


@query(
    "weighted_mean_runtime",
    f"WITH r AS (SELECT {_NAMES}[user_id % 16 + 1] AS method, (event_id % 5)::INT AS prop, (user_id + 1)::DOUBLE AS n, value AS tr, value / 10 AS te FROM events), "
    "g AS (SELECT * FROM (SELECT DISTINCT method FROM r), (SELECT unnest([0, 1, 2, 3, 4, 5]) AS prop)), "
    "m AS (SELECT method, prop, sum(n * tr) / sum(n) AS train, sum(n * te) / sum(n) AS test FROM r GROUP BY ALL) "
    "SELECT g.method, g.prop, round(train, 6) AS train, round(test, 6) AS test FROM g LEFT JOIN m ON m.method = g.method AND m.prop = g.prop",
)
def weighted_mean_runtime(spark, d):
    e = runs_by_method(table(spark, d, "events"))
    base = e.select(
        "method", (F.col("event_id") % 5).cast("int").alias("prop"), (F.col("user_id") + 1).alias("n_samples"),
        F.col("value").alias("train_time"), (F.col("value") / 10).alias("test_time"),
    )
    out = R.weighted_mean_runtime(base, base, list(range(6)))
    return out.select("method", "prop", r6("train").alias("train"), r6("test").alias("test"))


@query(
    "projection_with_label",
    f"WITH {PTS}, {EO} SELECT 'emb' AS dataset, 0 AS stage, split, id, round(p[1], 6) AS x, round(p[2], 6) AS y, round(v[3], 6) AS label FROM eo",
)
def projection_with_label(spark, d):
    pts = P.random_split(embeddings(spark, d), 0.7, SPLIT_SEED).withColumn("stage", F.lit(0))
    staged = pts.select(F.lit("emb").alias("dataset"), "stage", "split", "id", "label", F.col("features")[2].alias("z"))
    staged = staged.withColumn("y", F.col("label").cast("double"))
    proj = pts.select("stage", "split", "id", r6(F.col("proj")[0]).alias("x"), r6(F.col("proj")[1]).alias("y"))
    proj = proj.withColumn("dataset", F.lit("emb")).unionByName(proj.withColumn("dataset", F.lit("unconfigured")))
    out = R.projection_with_label(proj, staged, {"emb": "z", "other": "y"})
    return out.select("dataset", "stage", "split", "id", "x", "y", r6("label").alias("label"))


@query(
    "axis_limits",
    f"WITH {PTS}, {EO} SELECT label, round(min(p[1]), 6) AS x_min, round(max(p[1]), 6) AS x_max, round(min(p[2]), 6) AS y_min, round(max(p[2]), 6) AS y_max "
    "FROM eo WHERE split = 'E' GROUP BY label",
)
def axis_limits(spark, d):
    pts = P.random_split(embeddings(spark, d), 0.7, SPLIT_SEED)
    flat = pts.select("split", "label", F.col("proj")[0].alias("x"), F.col("proj")[1].alias("y"))
    out = R.axis_limits(flat, ["label"])
    return out.select("label", *[r6(c).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])


# --- dataset description ----------------------------------------------------


def line_features(spark, d):
    """The four numeric line-item columns as vectors with the return flag as label."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return table(spark, d, "lineitem").select(F.array(*cols).alias("features"), F.col("l_returnflag").alias("label"))


@query("n_samples", "SELECT count(*)::DOUBLE AS n, 4.0::DOUBLE AS d FROM lineitem")
def n_samples(spark, d):
    return R.n_samples(line_features(spark, d))


_SP = (
    "1 - sum((l_quantity <> 0)::INT + (l_extendedprice <> 0)::INT + (l_discount <> 0)::INT + (l_tax <> 0)::INT)::DOUBLE / (4 * count(*))"
)


@query("sparsity_ratio", f"SELECT round({_SP}, 6) AS sp FROM lineitem")
def sparsity_ratio(spark, d):
    return R.sparsity_ratio(line_features(spark, d)).select(r6("sp").alias("sp"))


@query("n_classes", "SELECT count(DISTINCT l_returnflag)::DOUBLE AS cl FROM lineitem")
def n_classes(spark, d):
    return R.n_classes(line_features(spark, d))


@query(
    "dataset_profile",
    "SELECT 'n' AS metric, count(*)::DOUBLE AS result FROM lineitem UNION ALL SELECT 'd', 4 UNION ALL "
    f"SELECT 'sp', round({_SP}, 6) FROM lineitem UNION ALL SELECT 'cl', count(DISTINCT l_returnflag) FROM lineitem",
)
def dataset_profile(spark, d):
    return R.dataset_profile(line_features(spark, d), intrinsic=False).select("metric", r6("result").alias("result"))
