from pyspark.sql import functions as F

from oosgauge.catalog.base import EO, PAIRS, PTS, RANKS, SPLIT_SEED, embeddings, query, r6, split_embeddings, table
from oosgauge.functions.draws import mix_sql
from oosgauge.operators import prep as P
from oosgauge.operators.knn import edges, knn

_LONG = "lg AS (SELECT id, split, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS dim FROM eo)"


def _long(df):
    return df.select("id", F.posexplode("features").alias("dim", "v")).select("id", "dim", r6("v").alias("v"))


@query(
    "standard_scale",
    f"WITH {PTS}, {EO}, {_LONG}, st AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM lg WHERE split = 'E' GROUP BY dim) "
    "SELECT id, lg.dim::INT AS dim, round((v - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS v FROM lg JOIN st ON st.dim = lg.dim",
)
def standard_scale(spark, d):
    e, o = split_embeddings(spark, d)
    se, so = P.standard_scale(e, e, o)
    return _long(P.union_splits(se, so))


@query(
    "minmax_scale",
    f"WITH {PTS}, {EO}, {_LONG}, st AS (SELECT dim, min(v) AS a, max(v) AS b FROM lg WHERE split = 'E' GROUP BY dim) "
    "SELECT id, lg.dim::INT AS dim, round((v - a) / CASE WHEN b > a THEN b - a ELSE 1 END, 6) AS v FROM lg JOIN st ON st.dim = lg.dim",
)
def minmax_scale(spark, d):
    e, o = split_embeddings(spark, d)
    se, so = P.minmax_scale(e, e, o)
    return _long(P.union_splits(se, so))


@query(
    "global_minmax",
    f"WITH {PTS}, {EO}, lim AS (SELECT split, min(least(p[1], p[2])) AS a, max(greatest(p[1], p[2])) AS b FROM eo GROUP BY split) "
    "SELECT id, eo.split, round((p[1] - a) / (b - a), 6) AS x, round((p[2] - a) / (b - a), 6) AS y FROM eo JOIN lim ON lim.split = eo.split",
)
def global_minmax(spark, d):
    pts = P.random_split(embeddings(spark, d), 0.7, SPLIT_SEED)
    out = P.global_minmax(pts, "proj", ["split"])
    return out.select("id", "split", r6(F.col("proj")[0]).alias("x"), r6(F.col("proj")[1]).alias("y"))


@query(
    "random_split",
    "SELECT o_orderkey AS id, CASE WHEN row_number() OVER (ORDER BY "
    f"{mix_sql('o_orderkey', 5)}, o_orderkey) <= round(0.7::DOUBLE * (SELECT count(*) FROM orders)) THEN 'E' ELSE 'O' END AS split FROM orders",
)
def random_split(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return P.random_split(orders, 0.7, 5)


def _strat(frac, seed):
    return (
        "CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY "
        f"{mix_sql('c_custkey', seed)}, c_custkey) <= round({frac} * (count(*) OVER (PARTITION BY c_mktsegment))::DOUBLE) THEN 'E' ELSE 'O' END AS split"
    )


@query("stratified_split", f"SELECT c_custkey AS id, c_mktsegment AS label, {_strat('0.7::DOUBLE', 3)} FROM customer")
def stratified_split(spark, d):
    cu = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    return P.stratified_split(cu, 0.7, 3)


@query(
    "proportion_stages",
    "WITH f AS (SELECT * FROM (VALUES (0, 0.9::DOUBLE), (1, 0.7::DOUBLE), (2, 0.5::DOUBLE), (3, 0.3::DOUBLE), (4, 0.1::DOUBLE)) t(stage, fr)), "
    "n AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY "
    f"{mix_sql('c_custkey', 9)}, c_custkey) AS rn, (count(*) OVER (PARTITION BY c_mktsegment))::DOUBLE AS n FROM customer) "
    "SELECT c_custkey AS id, c_mktsegment AS label, stage, CASE WHEN rn <= round(fr * n) THEN 'E' ELSE 'O' END AS split FROM n, f",
)
def proportion_stages(spark, d):
    cu = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    return P.proportion_stages(cu, 9)


@query(
    "distribution_shift",
    f"WITH {PTS}, {EO}, {_LONG.replace('id, split', 'id, split, label')}, sh AS (SELECT label AS c, label // 2 AS axis, "
    "round(avg(v[label // 2 + 1]), 3) AS off, 1 + label / 10 AS sc FROM pts WHERE label % 2 = 0 GROUP BY label) "
    "SELECT id, dim::INT AS dim, round(CASE WHEN split = 'O' AND sc IS NOT NULL THEN v * sc + off ELSE v END, 6) AS v "
    "FROM lg LEFT JOIN sh ON sh.c = lg.label AND sh.axis = lg.dim",
)
def distribution_shift(spark, d):
    """Each even cluster is stretched by a tenth of its number and moved by its own mean along one axis."""
    all_points = embeddings(spark, d)
    axis = F.floor(F.col("label") / 2).cast("int")
    spec = all_points.filter("label % 2 = 0").groupBy(F.col("label").alias("cluster"), axis.alias("axis")).agg(
        (1 + F.first("label") / 10).alias("scale"), F.round(F.avg(F.get("features", axis)), 3).alias("offset")
    )
    return _long(P.distribution_shift(P.random_split(all_points, 0.7, SPLIT_SEED), spec))


@query("union_splits", f"WITH {PTS} SELECT id, label, (generate_subscripts(v, 1) - 1)::INT AS dim, round(unnest(v), 6) AS x FROM pts")
def union_splits(spark, d):
    both = P.union_splits(*split_embeddings(spark, d))
    return both.select("id", "label", F.posexplode("features").alias("dim", "x")).withColumn("x", r6("x"))


@query("label_counts", "SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def label_counts(spark, d):
    return P.label_counts(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label")))


@query(
    "shuffled_batches",
    f"SELECT id, batch FROM (SELECT event_id AS id, (row_number() OVER (ORDER BY {mix_sql('event_id', 21)}, event_id) - 1) // 256 AS batch "
    "FROM events) WHERE batch < (SELECT count(*) FROM events) // 256",
)
def shuffled_batches(spark, d):
    return P.shuffled_batches(table(spark, d, "events").select(F.col("event_id").alias("id")), 256, 21)


@query(
    "sequential_batches",
    "SELECT id, batch FROM (SELECT event_id AS id, (row_number() OVER (ORDER BY event_id) - 1) // 300 AS batch FROM events) "
    "WHERE batch < (SELECT count(*) FROM events) // 300",
)
def sequential_batches(spark, d):
    return P.sequential_batches(table(spark, d, "events").select(F.col("event_id").alias("id")), 300)


def mutual_links(pts, k=1):
    """Constraint links from the data: mutual nearest rows, must if the labels agree."""
    first = edges(knn(pts, k)).select("i", "j")
    back = first.select(F.col("j").alias("i"), F.col("i").alias("j"))
    both = first.join(back, ["i", "j"]).filter("i < j")
    lab = pts.select("id", "label")
    named = both.join(lab.select(F.col("id").alias("i"), F.col("label").alias("li")), "i").join(
        lab.select(F.col("id").alias("j"), F.col("label").alias("lj")), "j"
    )
    return named.select(
        F.col("i").alias("link_id"),
        F.col("i").alias("head"),
        F.col("j").alias("tail"),
        F.when(F.col("li") == F.col("lj"), 1).otherwise(0).alias("type"),
        F.lit(1).alias("active"),
    )


LINKS = (
    "ln AS (SELECT a.i AS link_id, a.i AS head, a.j AS tail, (a.li = a.lj)::INT AS type, 1 AS active "
    "FROM rk a JOIN rk b ON a.i = b.j AND a.j = b.i WHERE a.rh = 1 AND b.rh = 1 AND a.i < a.j)"
)


@query(
    "pinned_sample",
    f"WITH {PTS}, {PAIRS}, {RANKS}, {LINKS}, s AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {mix_sql('id', 31)}, id) AS r FROM pts) "
    "WHERE r <= greatest(floor(0.5::DOUBLE * (SELECT count(*) FROM pts)), 400)) "
    "SELECT id FROM s UNION SELECT head FROM ln UNION SELECT tail FROM ln",
)
def pinned_sample(spark, d):
    pts = embeddings(spark, d)
    return P.pinned_sample(pts, mutual_links(pts), 0.5, 31)
