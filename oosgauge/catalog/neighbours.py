from pyspark.sql import functions as F

from oosgauge.catalog.base import EO, PAIRS, PTS, RANKS, embeddings, query, r6, split_embeddings
from oosgauge.functions import vectors as V
from oosgauge.operators import graph as G
from oosgauge.operators import pairwise as P
from oosgauge.operators.cells import probed_knn, recall
from oosgauge.operators.knn import edges, knn, rank_of

K = 7
_W = f"WITH {PTS}, {PAIRS}, {RANKS} "

# --- neighbours -------------------------------------------------------------

_EDGE_COLS = "i, j, round(dh, 6) AS d, rh::INT AS pos"


def _edges(df):
    return edges(df).select("i", "j", r6("d").alias("d"), "pos")


@query("knn_exact", f"{_W} SELECT {_EDGE_COLS} FROM rk WHERE rh <= {K}")
def knn_exact(spark, d):
    return _edges(knn(embeddings(spark, d), K))


@query(
    "knn_with_self",
    f"WITH {PTS}, al AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS dh FROM pts a, pts b), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dh, j) AS rh FROM al) "
    f"SELECT {_EDGE_COLS} FROM rk WHERE rh <= {K}",
)
def knn_with_self(spark, d):
    return _edges(knn(embeddings(spark, d), K, include_self=True))


_CROSS = (
    f"WITH {PTS}, {EO}, al AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS dh "
    "FROM eo a JOIN eo b ON a.split = 'O' AND b.split = 'E'), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dh, j) AS rh FROM al) "
)


@query("knn_cross", f"{_CROSS} SELECT {_EDGE_COLS} FROM rk WHERE rh <= 15")
def knn_cross(spark, d):
    e, o = split_embeddings(spark, d)
    return _edges(knn(e, 15, queries=o))


@query("knn_pruned", f"WITH ev AS (SELECT event_id AS id, user_id::DOUBLE AS u, value AS v FROM events), "
    "ob AS (SELECT c_custkey AS i, c_nationkey::DOUBLE * 10 AS u, c_acctbal / 100 AS v FROM customer), "
    "al AS (SELECT i, id AS j, sqrt((ev.u - ob.u) * (ev.u - ob.u) + (ev.v - ob.v) * (ev.v - ob.v)) AS dh FROM ob, ev), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dh, j) AS rh FROM al) "
    f"SELECT {_EDGE_COLS} FROM rk WHERE rh <= {K}")
def knn_pruned(spark, d):
    """Bounded cell search: customers against the event cloud in the plane."""
    from oosgauge.catalog.base import table

    ev = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.array(F.col("user_id").cast("double"), F.col("value")).alias("features")
    )
    cu = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.array(F.col("c_nationkey").cast("double") * 10, F.col("c_acctbal") / 100).alias("features"),
    )
    return _edges(knn(ev, K, queries=cu, collapse=False, prune_from=1))


@query("knn_approx")
def knn_approx(spark, d):
    """Probed cells against the exact table: one row with the share found."""
    pts = embeddings(spark, d)
    base = pts.select("id", F.col("features").alias("v"))
    found = probed_knn(base, K, probes=4, cell_rows=128)
    return recall(found, knn(pts, K)).select(r6("recall").alias("recall"))


@query("rank_table", f"{_W} SELECT i, j, rh AS rank FROM rk WHERE rl <= {K}")
def rank_table(spark, d):
    """Original-space rank of each projected neighbour."""
    pts = embeddings(spark, d)
    return rank_of(edges(knn(pts, K, vec="proj")), pts)


@query(
    "snn_similarity",
    f"{_W}, e AS (SELECT i, j FROM rk WHERE rh <= {K}), n AS (SELECT i, list(j) AS ns FROM e GROUP BY i) "
    f"SELECT e.i, e.j, len(list_intersect(a.ns, b.ns))::DOUBLE / {K} AS snn "
    "FROM e JOIN n a ON a.i = e.i JOIN n b ON b.i = e.j",
)
def snn_similarity(spark, d):
    return G.snn_similarity(knn(embeddings(spark, d), K))


@query("knn_graph", f"{_W} SELECT i AS src, j AS dst, 1.0::DOUBLE AS w FROM rk WHERE rh <= {K}")
def knn_graph(spark, d):
    return G.knn_graph(embeddings(spark, d), K)


# --- distances --------------------------------------------------------------


@query(
    "pairwise_euclidean",
    f"WITH {PTS}, {PAIRS}, z AS (SELECT i, CASE WHEN dh < 1e-12 THEN 0 ELSE dh END AS d FROM pr) "
    "SELECT i AS id, count(*) AS n, round(sum(d), 6) AS d_sum, round(sum(d * d), 6) AS d2_sum, "
    "round(max(d), 6) AS d_max, round(min(d), 6) AS d_min FROM z GROUP BY i",
)
def pairwise_euclidean(spark, d):
    s = P.row_distance_stats(embeddings(spark, d), floor=1e-12)
    return s.select("id", "n", *[r6(c).alias(c) for c in ("d_sum", "d2_sum", "d_max", "d_min")])


@query(
    "cross_euclidean",
    f"WITH {PTS}, {EO} SELECT a.id, count(*) AS n, round(sum(list_distance(a.v, b.v)), 6) AS d_sum, "
    "round(sum(list_distance(a.v, b.v) * list_distance(a.v, b.v)), 6) AS d2_sum, "
    "round(max(list_distance(a.v, b.v)), 6) AS d_max, round(min(list_distance(a.v, b.v)), 6) AS d_min "
    "FROM eo a JOIN eo b ON a.split = 'O' AND b.split = 'E' GROUP BY a.id",
)
def cross_euclidean(spark, d):
    e, o = split_embeddings(spark, d)
    s = P.row_distance_stats(o, e)
    return s.select("id", "n", *[r6(c).alias(c) for c in ("d_sum", "d2_sum", "d_max", "d_min")])


_VEC = (
    f"{_W}, e AS (SELECT rk.i, rk.j, a.v AS a, b.v AS b FROM rk JOIN pts a ON a.id = rk.i JOIN pts b ON b.id = rk.j "
    f"WHERE rh <= {K}) "
)
_BIN = (
    f"{_W}, e AS (SELECT rk.i, rk.j, [(x > 0)::INT::DOUBLE for x in a.v] AS a, "
    "[(x > 0)::INT::DOUBLE for x in b.v] AS b FROM rk JOIN pts a ON a.id = rk.i JOIN pts b ON b.id = rk.j "
    f"WHERE rh <= {K}) "
)
_ABS = _BIN.replace("(x > 0)::INT::DOUBLE", "abs(x)")


def _on_edges(spark, d, make, prepare=None):
    pts = embeddings(spark, d)
    pairs = edges(knn(pts, K)).select("i", "j")
    if prepare is not None:
        pts = pts.withColumn("features", F.transform("features", prepare))
    return P.with_vectors(pairs, pts).select("i", "j", *[r6(c).alias(n) for n, c in make().items()])


@query("squared_euclidean", f"{_VEC} SELECT i, j, round(list_distance(a, b) * list_distance(a, b), 6) AS d2 FROM e")
def squared_euclidean(spark, d):
    return _on_edges(spark, d, lambda: {"d2": V.squared_euclidean("vi", "vj")})


_JB = "(1 - list_inner_product(a, b) / (list_sum(a) + list_sum(b) - list_inner_product(a, b)))"


@query("jaccard_binary", f"{_BIN} SELECT i, j, round({_JB}, 6) AS d, round({_JB} * {_JB}, 6) AS d2 FROM e")
def jaccard_binary(spark, d):
    make = lambda: {"d": V.jaccard("vi", "vj"), "d2": V.DISTANCES["jaccard"]("vi", "vj")}
    return _on_edges(spark, d, make, lambda x: (x > 0).cast("double"))


_MIN = "list_sum([least(a[t], b[t]) for t in range(1, len(a) + 1)])"
_JG = f"(1 - {_MIN} / {_MIN.replace('least', 'greatest')})"


@query("jaccard_general", f"{_ABS} SELECT i, j, round({_JG}, 6) AS d, round({_JG} * {_JG}, 6) AS d2 FROM e")
def jaccard_general(spark, d):
    make = lambda: {"d": V.jaccard_general("vi", "vj"), "d2": V.DISTANCES["jaccard_general"]("vi", "vj")}
    return _on_edges(spark, d, make, F.abs)


@query("cosine_similarity", f"{_VEC} SELECT i, j, round(greatest(list_cosine_similarity(a, b), 1e-7), 6) AS sim, "
       "round((1 - greatest(list_cosine_similarity(a, b), 1e-7)) * (1 - greatest(list_cosine_similarity(a, b), 1e-7)), 6) AS d2 FROM e")
def cosine_similarity(spark, d):
    return _on_edges(spark, d, lambda: {"sim": V.cosine_similarity("vi", "vj"), "d2": V.DISTANCES["cosine"]("vi", "vj")})


def _sim(name, sql):
    @query(f"{name}", f"{_VEC} SELECT i, j, round({sql}, 6) AS sim FROM e")
    def run(spark, d, _n={"student_t_similarity": "tsne", "exp_similarity": "exp", "umap_similarity": "umap"}[name]):
        return _on_edges(spark, d, lambda: {"sim": V.similarity_function(_n)("vi", "vj")})


_D2 = "(list_distance(a, b) * list_distance(a, b))"
_sim("student_t_similarity", f"1 / (1 + {_D2})")
_sim("exp_similarity", f"exp(-{_D2})")
_sim("umap_similarity", f"1 / (1 + {V.UMAP_A} * pow(list_distance(a, b), {2.0 * V.UMAP_B}::DOUBLE))")

SIGMA = (
    "sg AS (SELECT median(d) / sqrt(-2 * ln(0.6::DOUBLE)) AS s FROM (SELECT dh AS d FROM pr ORDER BY dh DESC LIMIT 10))"
)


@query(
    "gaussian_kernel_rows",
    f"{_W}, {SIGMA}, n AS (SELECT i, 1 + sum(exp(-dh * dh / (2 * s * s))) AS z FROM pr, sg GROUP BY i) "
    f"SELECT rk.i, rk.j, round(exp(-dh * dh / (2 * s * s)) / z, 6) AS k FROM rk JOIN n ON n.i = rk.i, sg WHERE rh <= {K}",
)
def gaussian_kernel_rows(spark, d):
    pts = embeddings(spark, d)
    sigma = P.kernel_width(pts)
    out = P.gaussian_kernel_rows(edges(knn(pts, K)).select("i", "j"), pts, sigma)
    return out.select("i", "j", r6("k").alias("k"))


@query(
    "double_centre",
    f"WITH {PTS}, al AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS dh FROM pts a, pts b), "
    "m AS (SELECT i, sum(dh * dh) / count(*) AS m FROM al GROUP BY i), g AS (SELECT avg(m) AS g FROM m) "
    "SELECT al.i, al.j, round(-0.5::DOUBLE * (dh * dh - a.m - b.m + g), 6) AS b FROM al JOIN m a ON a.i = al.i "
    "JOIN m b ON b.i = al.j, g",
)
def double_centre(spark, d):
    """The whole matrix."""
    return P.double_centred(embeddings(spark, d)).select("i", "j", r6("b").alias("b"))
