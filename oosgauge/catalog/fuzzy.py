from pyspark.sql import functions as F

from oosgauge.catalog.base import PAIRS, PTS, RANKS, embeddings, query, r6
from oosgauge.catalog.prep import LINKS, mutual_links
from oosgauge.functions.draws import mix_sql
from oosgauge.operators import fuzzy as Z
from oosgauge.operators.knn import knn
from oosgauge.session import stable

K = 15
_W = f"WITH {PTS}, {PAIRS}, {RANKS}"
#: directed weights from plain bandwidths: rho the nearest, sigma the mean distance
DW = (
    f"nb AS (SELECT i, j, dh AS d FROM rk WHERE rh <= {K}), bw AS (SELECT i, min(d) AS rho, avg(d) AS sigma FROM nb GROUP BY i), "
    "dw AS (SELECT nb.i, nb.j, d, CASE WHEN d - rho <= 0 THEN 1 ELSE exp(-(d - rho) / sigma) END AS w FROM nb JOIN bw ON bw.i = nb.i)"
)


def _union(expr, name="un"):
    return (
        f"{name} AS (SELECT * FROM (SELECT coalesce(x.i, y.j) AS i, coalesce(x.j, y.i) AS j, {expr} AS w, greatest(coalesce(x.d, 0), coalesce(y.d, 0)) AS d "
        "FROM dw x FULL JOIN dw y ON x.i = y.j AND x.j = y.i) WHERE w <> 0)"
    )


_A, _B = "coalesce(x.w, 0)", "coalesce(y.w, 0)"
UN = _union(f"({_A} + {_B} - {_A} * {_B})")


def directed(spark, d):
    n = knn(embeddings(spark, d), K)
    dist = F.transform("neighbors", lambda s: s["d"])
    mean = F.aggregate(dist, F.lit(0.0), lambda a, x: a + x) / F.size(dist)
    return Z.membership_strength(n.select("id", "neighbors", mean.alias("sigma"), F.array_min(dist).alias("rho")))


def union(spark, d):
    return Z.fuzzy_union(directed(spark, d), "UMAP")


@query("smooth_knn_dist", f"{_W} SELECT i AS id, round(log2({K}::DOUBLE), 3) AS mass, round(min(dh), 6) AS rho FROM rk WHERE rh <= {K} GROUP BY i")
def smooth_knn_dist(spark, d):
    """Membership mass of each row at its bandwidth, the first neighbour left out: the target log2 k; and the nearest distance."""
    out = Z.smooth_knn_dist(knn(embeddings(spark, d), K), K)
    rest = F.slice(F.transform("neighbors", lambda s: s["d"]), 2, K)
    mass = F.aggregate(rest, F.lit(0.0), lambda a, x: a + F.exp(-F.greatest(x - F.col("rho"), F.lit(0.0)) / F.col("sigma")))
    return out.select("id", F.round(mass, 3).alias("mass"), r6("rho").alias("rho"))


@query("membership_strength", f"{_W}, {DW} SELECT i, j, round(w, 6) AS w, round(d, 6) AS d FROM dw")
def membership_strength(spark, d):
    return directed(spark, d).select("i", "j", r6("w").alias("w"), r6("d").alias("d"))


@query(
    "fuzzy_union",
    f"{_W}, {DW}, {UN}, {_union(f'({_A} + {_B}) / 2', 'ut')} SELECT un.i, un.j, round(un.w, 6) AS w_umap, round(ut.w, 6) AS w_tsne, round(un.d, 6) AS d "
    "FROM un JOIN ut ON un.i = ut.i AND un.j = ut.j",
)
def fuzzy_union(spark, d):
    w = stable(directed(spark, d))
    u = Z.fuzzy_union(w, "UMAP").select("i", "j", r6("w").alias("w_umap"), r6("d").alias("d"))
    t = Z.fuzzy_union(w, "TSNE").select("i", "j", r6("w").alias("w_tsne"))
    return u.join(t, ["i", "j"])


@query("neighbor_weights", f"{_W}, {DW}, {UN} SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 6) AS weight, round(w, 6) AS raw FROM un")
def neighbor_weights(spark, d):
    return Z.neighbor_weights(union(spark, d)).select("i", "j", r6("weight").alias("weight"), r6("raw").alias("raw"))


@query("min_degree", f"{_W}, {DW}, {UN} SELECT min(least(n, {K})) AS min_neighbors FROM (SELECT i, count(*) AS n FROM un GROUP BY i)")
def min_degree(spark, d):
    return Z.min_degree(embeddings(spark, d), union(spark, d), K)


_PRUNED = "pn AS (SELECT i, j, w FROM un WHERE w >= (SELECT max(w) FROM un) / 10.0::DOUBLE)"


@query("prune_edges", f"{_W}, {DW}, {UN}, {_PRUNED.replace("10.0", "2.0")} SELECT i, j, round(w, 6) AS w FROM pn")
def prune_edges(spark, d):
    return Z.prune_edges(union(spark, d), 2).select("i", "j", r6("w").alias("w"))


_EPS = f"{_PRUNED}, ep AS (SELECT i, j, 10.0::DOUBLE / (10.0::DOUBLE * (w / (SELECT max(w) FROM pn))) AS eps FROM pn)"


@query("epochs_per_sample", f"{_W}, {DW}, {UN}, {_EPS} SELECT i, j, round(eps, 6) AS eps, round(eps / 5, 6) AS eps_negative FROM ep")
def epochs_per_sample(spark, d):
    out = Z.epochs_per_sample(Z.prune_edges(union(spark, d), 10), 10)
    return out.select("i", "j", r6("eps").alias("eps"), r6("eps_negative").alias("eps_negative"))


@query(
    "edge_expand",
    f"{_W}, {DW}, {UN}, {_EPS}, x AS (SELECT i, j, unnest(range(1, floor(round(eps, 6))::BIGINT + 1)) AS copy FROM ep) "
    f"SELECT x.i, x.j, copy::INT AS copy, {mix_sql('x.i * 1000003 + x.j * 8191 + copy', 17)} AS place, round(a.v[1], 6) AS from_x, round(b.v[1], 6) AS to_x "
    "FROM x JOIN pts a ON a.id = x.i JOIN pts b ON b.id = x.j",
)
def edge_expand(spark, d):
    """Repeats of every edge with the first coordinate of both ends attached."""
    from oosgauge.operators.pairwise import with_vectors

    sampled = Z.epochs_per_sample(Z.prune_edges(union(spark, d), 10), 10).withColumn("eps", r6("eps"))
    rows = with_vectors(Z.edge_expand(sampled, 17), embeddings(spark, d))
    return rows.select("i", "j", "copy", "place", r6(F.col("vi")[0]).alias("from_x"), r6(F.col("vj")[0]).alias("to_x"))


_R = 20


@query(
    "neighbor_repository",
    f"{_W}, {DW}, {UN}, s AS (SELECT i, j, ceil(w / sum(w) OVER (PARTITION BY i) * {_R} - 1e-9::DOUBLE)::INT AS n FROM un), "
    f"t AS (SELECT i, j, CASE WHEN sum(n) OVER (PARTITION BY i) < {_R} THEN {-(-_R // K)} ELSE n END AS n FROM s), "
    "c AS (SELECT i, j, unnest(range(1, n + 1)) AS c FROM t), "
    f"o AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY {mix_sql('i * 1000003 + j * 8191 + c', 23)}, j, c) AS slot FROM c) "
    f"SELECT i, slot::INT AS slot, j FROM o WHERE slot <= {_R}",
)
def neighbor_repository(spark, d):
    return Z.neighbor_repository(union(spark, d), _R, K, 23)


# --- constraint links -------------------------------------------------------


_BOTH = "bl AS (SELECT head AS i, tail AS j, type FROM ln UNION ALL SELECT tail, head, type FROM ln)"


def _links_sql(spread):
    drop = "" if spread else " AND un.i NOT IN (SELECT i FROM bl WHERE type = 1)"
    return (
        f"{_W}, {DW}, {UN}, {LINKS}, {_BOTH}, kp AS (SELECT un.i, un.j, un.w AS raw FROM un WHERE NOT EXISTS (SELECT 1 FROM bl WHERE type = 0 AND bl.i = un.i AND bl.j = un.j){drop}), "
        "al AS (SELECT * FROM kp UNION ALL SELECT i, j, 1.0::DOUBLE FROM bl WHERE type = 1) "
        "SELECT i, j, round(raw, 6) AS raw, round(raw / sum(raw) OVER (PARTITION BY i), 6) AS w FROM al"
    )


@query("apply_links", _links_sql(True))
def apply_links(spark, d):
    out = Z.apply_links(union(spark, d), mutual_links(embeddings(spark, d)))
    return out.select("i", "j", r6("raw").alias("raw"), r6("w").alias("w"))


@query("apply_links_replace", _links_sql(False))
def apply_links_replace(spark, d):
    out = Z.apply_links(union(spark, d), mutual_links(embeddings(spark, d)), spread=False)
    return out.select("i", "j", r6("raw").alias("raw"), r6("w").alias("w"))


_GEN = (
    "cur AS (SELECT * FROM ln), prv AS (SELECT a.i AS link_id, a.i AS head, a.j AS tail, (a.li = a.lj)::INT AS type, (a.rh = 1)::INT AS active, 2.0::DOUBLE AS weight "
    "FROM rk a JOIN rk b ON a.i = b.j AND a.j = b.i WHERE a.rl <= 40 AND a.i < a.j AND a.rh <= 2 AND b.rh <= 2 QUALIFY row_number() OVER (PARTITION BY a.i ORDER BY a.rh, a.j) = 1)"
)


def _previous(spark, d):
    """An earlier generation of links: mutual two-nearest pairs, the farther one inactive."""
    from oosgauge.operators.knn import edges, rank_of

    pts = embeddings(spark, d)
    two = edges(knn(pts, 2)).select("i", "j", "pos")
    back = two.select(F.col("j").alias("i"), F.col("i").alias("j"))
    pairs = stable(two.join(back, ["i", "j"]).filter("i < j"))
    seen = rank_of(pairs.select("i", "j"), pts, vec="proj").filter("rank <= 40")
    lab = pts.select("id", "label")
    named = (
        pairs.join(seen.select("i", "j"), ["i", "j"])
        .join(lab.select(F.col("id").alias("i"), F.col("label").alias("li")), "i")
        .join(lab.select(F.col("id").alias("j"), F.col("label").alias("lj")), "j")
    )
    first = named.groupBy("i").agg(F.min(F.struct("pos", "j", "li", "lj")).alias("b"))
    return first.select(
        F.col("i").alias("link_id"), F.col("i").alias("head"), F.col("b.j").alias("tail"),
        (F.col("b.li") == F.col("b.lj")).cast("int").alias("type"), (F.col("b.pos") == 1).cast("int").alias("active"),
        F.lit(2.0).alias("weight"),
    )


@query(
    "link_lifecycle",
    f"{_W}, {LINKS}, {_GEN} SELECT c.link_id, coalesce(p.head, c.head) AS head, coalesce(p.tail, c.tail) AS tail, coalesce(p.type, c.type) AS type, c.active, "
    "CASE WHEN p.link_id IS NULL THEN 2.0::DOUBLE WHEN p.active = 1 AND c.active = 1 THEN p.weight * 0.5::DOUBLE WHEN c.active = 0 THEN 0 ELSE 1 END AS weight, "
    "CASE WHEN p.link_id IS NULL THEN 'added' ELSE 'kept' END AS state FROM cur c LEFT JOIN prv p ON p.link_id = c.link_id",
)
def link_lifecycle(spark, d):
    return Z.link_lifecycle(_previous(spark, d), mutual_links(embeddings(spark, d)))


_BATCH = f"bt AS (SELECT id FROM (SELECT id, (row_number() OVER (ORDER BY {mix_sql('id', 41)}, id) - 1) // 100 AS b FROM pts) WHERE b < (SELECT count(*) FROM pts) // 100 GROUP BY id, b HAVING b = 0)"


@query(
    "link_partners",
    f"{_W}, {LINKS}, {_BATCH}, ends AS (SELECT head AS id, tail AS partner, type, 2.0::DOUBLE AS weight FROM ln UNION ALL SELECT tail, head, type, 2.0::DOUBLE FROM ln), "
    "t AS (SELECT * FROM ends WHERE id IN (SELECT id FROM bt)) SELECT * FROM t WHERE partner NOT IN (SELECT id FROM t)",
)
def link_partners(spark, d):
    """Partners of the rows in the first shuffled batch."""
    from oosgauge.operators.prep import shuffled_batches

    pts = embeddings(spark, d)
    batch = shuffled_batches(pts.select("id"), 100, 41).filter("batch = 0").select("id")
    return Z.link_partners(batch, mutual_links(pts).withColumn("weight", F.lit(2.0)))
