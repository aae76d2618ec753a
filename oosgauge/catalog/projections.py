from pyspark.sql import functions as F

from oosgauge.catalog.base import EO, PAIRS, PTS, RANKS, embeddings, query, r6, split_embeddings, table
from oosgauge.operators import graph as G
from oosgauge.operators import landmarks as L
from oosgauge.operators import linear as A
from oosgauge.operators.knn import knn
from oosgauge.operators.prep import subsample, union_splits
from oosgauge.functions.draws import mix_sql

_XY = ("id", "x", "y")


def xy(df, vec="proj"):
    return df.select("id", r6(F.col(vec)[0]).alias("x"), r6(F.col(vec)[1]).alias("y"))


#: centred scores on the two leading axes of E, for the two-coordinate vectors
PLANE = (
    f"WITH {PTS}, {EO}, c AS (SELECT avg(p[1]) AS mx, avg(p[2]) AS my, var_samp(p[1]) AS a, covar_samp(p[1], p[2]) AS b, var_samp(p[2]) AS c FROM eo WHERE split = 'E'), "
    "l AS (SELECT *, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS lam FROM c), "
    "u AS (SELECT *, b / sqrt(b * b + (lam - a) * (lam - a)) AS ux, (lam - a) / sqrt(b * b + (lam - a) * (lam - a)) AS uy FROM l), "
    "s AS (SELECT *, CASE WHEN (CASE WHEN abs(ux) >= abs(uy) THEN ux ELSE uy END) < 0 THEN -1 ELSE 1 END AS s1, "
    "CASE WHEN (CASE WHEN abs(uy) >= abs(ux) THEN -uy ELSE ux END) < 0 THEN -1 ELSE 1 END AS s2 FROM u) "
    "SELECT id, round(s1 * ((p[1] - mx) * ux + (p[2] - my) * uy), 6) AS x, round(s2 * ((p[2] - my) * ux - (p[1] - mx) * uy), 6) AS y FROM eo, s"
)


@query("pca", PLANE)
def pca(spark, d):
    """Fit on E, score E and O, on the two-coordinate vectors."""
    e, o = split_embeddings(spark, d)
    model = A.fit_pca(e, 2, "proj")
    return xy(model.project(union_splits(e, o), "proj", "s"), "s")


@query("oos_mds", PLANE)
def oos_mds(spark, d):
    e, o = split_embeddings(spark, d)
    model = A.fit_oos_mds(e, 2, "proj")
    return xy(model.project(union_splits(e, o), "proj", "s"), "s")


@query("pca_wide")
def pca_wide(spark, d):
    """The same on the full vectors."""
    e, o = split_embeddings(spark, d)
    return xy(A.fit_pca(e, 2).project(union_splits(e, o)))


@query(
    "pca_lineitem",
    "WITH c AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount * 100) AS b, var_samp(l_discount * 100) AS c FROM lineitem) "
    "SELECT round((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2, 6) AS v1, round((a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2, 6) AS v2 FROM c",
)
def pca_lineitem(spark, d):
    """Explained variances over the whole line-item table."""
    li = table(spark, d, "lineitem").select(F.array("l_quantity", F.col("l_discount") * 100).alias("features"))
    m = A.fit_pca(li, 2)
    return spark.createDataFrame([(round(float(m.variance[0]), 6), round(float(m.variance[1]), 6))], "v1 double, v2 double")


@query("principal_reduce")
def principal_reduce(spark, d):
    out = A.principal_reduce(embeddings(spark, d), 16)
    return out.select("id", F.posexplode("features").alias("dim", "v")).select("id", "dim", r6("v").alias("v"))


@query("intrinsic_dims")
def intrinsic_dims(spark, d):
    pts = embeddings(spark, d)
    m = A.intrinsic_dims(pts)
    return spark.createDataFrame([(m, m / 64.0)], "intrinsic_dims int, ratio double")


# --- samples and graphs -----------------------------------------------------

FPS_M = 6


def _fps_sql(start, m, src="pts", vec="v"):
    q = [f"{start}"]
    for s in range(1, m):
        q.append(
            f"s{s} AS (SELECT c.id, least(c.cur, pow(list_distance(p.{vec}, q.{vec}), 2)) AS cur FROM s{s - 1} c JOIN {src} p ON p.id = c.id, "
            f"(SELECT {vec} FROM {src} WHERE id = (SELECT id FROM p{s - 1})) q), "
            f"p{s} AS (SELECT id FROM s{s} ORDER BY cur DESC, id LIMIT 1)"
        )
    picks = " UNION ALL ".join(f"SELECT {s + 1} AS pos, id FROM p{s}" for s in range(m))
    return ", ".join(q) + " " + picks


@query(
    "farthest_point_sample",
    f"WITH {PTS}, bc AS (SELECT list(m ORDER BY dim) AS v FROM (SELECT dim, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM pts) GROUP BY dim)), "
    "p0 AS (SELECT id FROM pts, bc ORDER BY list_distance(pts.v, bc.v) DESC, id LIMIT 1), "
    + _fps_sql("s0 AS (SELECT id, 1e300::DOUBLE AS cur FROM pts)", FPS_M),
)
def farthest_point_sample(spark, d):
    return L.farthest_table(spark, L.farthest_points(embeddings(spark, d), FPS_M))


@query(
    "fps_landmarks",
    f"WITH {PTS}, {EO}, od AS (SELECT * FROM eo WHERE split = 'O'), p0 AS (SELECT min(id) AS id FROM od), "
    + _fps_sql("s0 AS (SELECT id, 1e300::DOUBLE AS cur FROM od)", 8, "od"),
)
def fps_landmarks(spark, d):
    """Landmarks of O from a given start."""
    _, o = split_embeddings(spark, d)
    first = o.agg(F.min("id")).first()[0]
    return L.farthest_table(spark, L.farthest_points(o, 8, first_id=first))


def _sym(k):
    return (
        f"ed AS (SELECT i, j FROM rk WHERE rh <= {k} UNION SELECT j, i FROM rk WHERE rh <= {k}), "
        "reach AS (SELECT id AS id, id AS x FROM pts UNION SELECT r.id, e.j FROM reach r JOIN ed e ON r.x = e.i)"
    )


_R = f"WITH RECURSIVE {PTS}, {PAIRS}, {RANKS}"
_COMP = f"{_sym(1)}, comp AS (SELECT id, min(x) AS component FROM reach GROUP BY id)"


@query("connected_components", f"{_R}, {_COMP} SELECT id, component FROM comp")
def connected_components(spark, d):
    pts = embeddings(spark, d)
    return G.connected_components(pts, G.knn_graph(pts, 1))


@query(
    "bridge_components",
    f"{_R}, {_COMP}, x AS (SELECT a.component AS ci, b.component AS cj, dh, i, j, row_number() OVER (PARTITION BY a.component, b.component ORDER BY dh, i, j) AS r "
    "FROM pr JOIN comp a ON a.id = i JOIN comp b ON b.id = j WHERE a.component < b.component) "
    "SELECT ci, cj, i AS src, j AS dst, round(dh, 6) AS w FROM x WHERE r = 1",
)
def bridge_components(spark, d):
    pts = embeddings(spark, d)
    comps = G.connected_components(pts, G.knn_graph(pts, 1))
    return G.bridge_components(pts, comps).withColumn("w", r6("w"))


_SRC = f"src AS (SELECT id FROM pts ORDER BY {mix_sql('id', 77)}, id LIMIT 12)"
_HOPS = (
    "ed AS (SELECT i, j FROM rk WHERE rh <= 7 UNION SELECT j, i FROM rk WHERE rh <= 7), {src}, "
    "walk AS (SELECT id AS source, id AS node, 0 AS dist FROM src UNION SELECT w.source, e.j, w.dist + 1 FROM walk w JOIN ed e ON e.i = w.node WHERE w.dist < 14), "
    "sp AS (SELECT source, node, min(dist)::DOUBLE AS dist FROM walk GROUP BY ALL)"
)


@query("geodesic", f"{_R}, {_HOPS.format(src=_SRC)} SELECT * FROM sp")
def geodesic(spark, d):
    """Hop counts from twelve seeded landmarks to every row."""
    pts = embeddings(spark, d)
    return G.geodesic(G.knn_graph(pts, 7), subsample(pts.select("id"), 12, 77))


_E_ONLY = (
    f"WITH RECURSIVE {PTS}, {EO}, ee AS (SELECT * FROM eo WHERE split = 'E'), "
    "rk AS (SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rh FROM ee a JOIN ee b ON a.id <> b.id)"
)


@query(
    "oos_geodesic",
    f"{_E_ONLY}, {_HOPS.format(src=_SRC.replace('pts', 'ee'))}, "
    "nb AS (SELECT a.id AS o, b.id AS n, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r "
    "FROM eo a JOIN ee b ON a.split = 'O') "
    "SELECT o AS id, source, round(min(d + dist), 6) AS dist FROM nb JOIN sp ON sp.node = n WHERE r <= 10 GROUP BY o, source",
)
def oos_geodesic(spark, d):
    e, o = split_embeddings(spark, d)
    paths = G.geodesic(G.knn_graph(e, 7), subsample(e.select("id"), 12, 77))
    return G.oos_geodesic(knn(e, 10, queries=o), paths).withColumn("dist", r6("dist"))


# --- spectral and landmark methods ------------------------------------------


@query(
    "classical_mds",
    "WITH lg AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), "
    "m AS (SELECT label, dim, avg(x) AS m FROM lg GROUP BY ALL) "
    "SELECT a.label::BIGINT AS i, b.label::BIGINT AS j, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) AS d "
    "FROM m a JOIN m b ON a.dim = b.dim AND a.label < b.label GROUP BY a.label, b.label",
)
def classical_mds(spark, d):
    """Class means embedded from their distances; all positive axes give the distances back."""
    from oosgauge.functions.vectors import euclidean

    lg = embeddings(spark, d).select("label", F.posexplode("features").alias("dim", "x"))
    m = lg.groupBy("label", "dim").agg(F.avg("x").alias("m"))
    a = m.select(F.col("label").cast("bigint").alias("i"), "dim", F.col("m").alias("a"))
    b = m.select(F.col("label").cast("bigint").alias("j"), "dim", F.col("m").alias("b"))
    gap = F.col("a") - F.col("b")
    pairs = a.join(b, "dim").filter("i <> j").groupBy("i", "j").agg(F.sqrt(F.sum(gap * gap)).alias("d"))
    c = L.classical_mds(pairs)
    ci = c.select(F.col("id").alias("i"), F.col("coords").alias("vi"))
    cj = c.select(F.col("id").alias("j"), F.col("coords").alias("vj"))
    return pairs.filter("i < j").join(ci, "i").join(cj, "j").select("i", "j", r6(euclidean("vi", "vj")).alias("d"))


@query("lmds")
def lmds(spark, d):
    e, o = split_embeddings(spark, d)
    m = L.LandmarkMDS().fit(e)
    return xy(m.transform().select("id", "proj").unionByName(m.transform_oos(o).select("id", "proj")))


@query("oos_isomap")
def oos_isomap(spark, d):
    e, o = split_embeddings(spark, d)
    m = L.OosIsomap().fit(e)
    return xy(m.transform().select("id", "proj").unionByName(m.transform_oos(o).select("id", "proj")))


@query("lisomap")
def lisomap(spark, d):
    e, o = split_embeddings(spark, d)
    m = L.LandmarkIsomap().fit(e)
    return xy(m.transform().select("id", "proj").unionByName(m.transform_oos(o).select("id", "proj")))


@query("isomap_base")
def isomap_base(spark, d):
    return xy(L.isomap_base(embeddings(spark, d), 15))
