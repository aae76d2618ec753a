import math

from pyspark.sql import functions as F

from oosgauge.catalog.base import EO, PAIRS, PTS, RANKS, embeddings, query, r6, split_embeddings
from oosgauge.operators import affinity as A
from oosgauge.operators.knn import knn

K = 30
_W = f"WITH {PTS}, {PAIRS}, {RANKS}"
#: conditional and joint probabilities at precision 1 / mean squared neighbour distance
CP = (
    f"nb AS (SELECT i, j, dh AS d FROM rk WHERE rh <= {K}), bt AS (SELECT i, 1 / avg(d * d) AS b FROM nb GROUP BY i), "
    "cp AS (SELECT nb.i, j, exp(-b * d * d) / sum(exp(-b * d * d)) OVER (PARTITION BY nb.i) AS p FROM nb JOIN bt ON bt.i = nb.i)"
)


def _both(expr, name, src="cp"):
    return (
        f"{name} AS (SELECT coalesce(x.i, y.j) AS i, coalesce(x.j, y.i) AS j, {expr} AS p FROM {src} x FULL JOIN {src} y ON x.i = y.j AND x.j = y.i)"
    )


_N = "(SELECT count(*) FROM pts)::DOUBLE"
JP = _both(f"(coalesce(x.p, 0) + coalesce(y.p, 0)) / (2 * {_N})", "jp")
QQ = "qk AS (SELECT i, j, 1 / (1 + dl * dl) AS w FROM pr), qq AS (SELECT i, j, w / (SELECT sum(w) FROM qk) AS q FROM qk)"


def given(spark, d):
    n = knn(embeddings(spark, d), K)
    d2 = F.transform("neighbors", lambda s: s["d"] * s["d"])
    mean = F.aggregate(d2, F.lit(0.0), lambda a, x: a + x) / F.size(d2)
    return A.conditional_p(n.withColumn("param", F.lit(1.0) / mean), "beta")


def joint(spark, d):
    pts = embeddings(spark, d)
    return A.joint_p(given(spark, d), pts.count())


def _p(df, *keys):
    return df.select(*(keys or ("i", "j")), r6("p").alias("p"))


def _p8(df):
    return df.select("i", "j", F.round(F.col("p") * 1000.0, 6).alias("p1000"))


#: form -> value asked for, entropy in the form's unit
ASKED = {"beta": (10.0, math.log(10.0)), "sigma": (3.0, 3.0), "root": (10.0, math.log2(10.0))}


@query(
    "perplexity_calibrate",
    f"WITH {PTS} SELECT id, how, round(h, 2) AS entropy, true AS positive FROM pts, (VALUES "
    + ", ".join(f"('{how}', {h!r}::DOUBLE)" for how, (_, h) in ASKED.items())
    + ") t(how, h)",
)
def perplexity_calibrate(spark, d):
    """Entropy of each row at its calibrated width, taken anew from the distances: the target."""
    n, out = knn(embeddings(spark, d), K), None
    for how, (value, _) in ASKED.items():
        c = A.calibrate(n, value, how).select("id", "param", F.transform("neighbors", lambda s: s["d"]).alias("d"))
        if how == "beta":
            c = c.withColumn("d", F.concat(F.array(F.lit(0.0)), "d"))
        scale = {"beta": F.col("d") * F.col("d") * F.col("param"), "sigma": F.col("d") * F.col("d") / (2 * F.col("param")), "root": F.col("d") * F.col("param")}[how]
        e = c.select("id", "param", F.explode("d").alias("d")).withColumn("w", F.exp(-scale))
        e = e.groupBy("id", "param").agg(F.log(F.sum("w")).alias("z"), (F.sum(scale * F.col("w")) / F.sum("w")).alias("m"))
        h = (F.col("z") + F.col("m")) / (1.0 if how == "beta" else math.log(2.0))
        c = e.select("id", F.lit(how).alias("how"), F.round(h, 2).alias("entropy"), (F.col("param") > 0).alias("positive"))
        out = c if out is None else out.unionByName(c)
    return out


@query("conditional_p", f"{_W}, {CP} SELECT i, j, round(p, 6) AS p FROM cp")
def conditional_p(spark, d):
    return _p(given(spark, d))


@query("joint_p", f"{_W}, {CP}, {JP} SELECT i, j, round(p * 1000, 6) AS p1000 FROM jp")
def joint_p(spark, d):
    return _p8(joint(spark, d))


@query("half_sum_p", f"{_W}, {CP}, {_both('(coalesce(x.p, 0) + coalesce(y.p, 0)) * 0.5::DOUBLE', 'hs')} SELECT i, j, round(p, 6) AS p FROM hs")
def half_sum_p(spark, d):
    return _p(A.half_sum_p(given(spark, d)))


@query(
    "column_normalised_p",
    f"{_W}, {CP}, cn AS (SELECT i, j, p / (sum(p) OVER (PARTITION BY j) + 1e-7::DOUBLE) AS p FROM cp), "
    f"{_both('(coalesce(x.p, 0) + coalesce(y.p, 0)) * 0.5::DOUBLE', 'hs', 'cn')} SELECT i, j, round(p, 6) AS p FROM hs",
)
def column_normalised_p(spark, d):
    return _p(A.column_normalised_p(given(spark, d)))


@query(
    "exaggerate_p",
    f"{_W}, {CP}, {JP} SELECT step::INT AS step, round(sum(p * CASE WHEN step < 4 THEN 5 ELSE 1 END), 6) AS total FROM jp, (SELECT unnest([0, 3, 4]) AS step) GROUP BY step",
)
def exaggerate_p(spark, d):
    p = joint(spark, d)
    out = None
    for step in (0, 3, 4):
        s = A.exaggerate_p(p, A.EXAGGERATION["ptsne_batches"], step, 4).agg(r6(F.sum("p")).alias("total")).withColumn("step", F.lit(step))
        out = s if out is None else out.unionByName(s)
    return out.select("step", "total")


@query("multiscale_p")
def multiscale_p(spark, d):
    pts = embeddings(spark, d)
    # entropies a neighbour list of this length can reach
    levels = [h for h in A.multiscale_entropies(50) if 2**h < K]
    return _p8(A.multiscale_p(knn(pts, K), pts.count(), levels))


@query("stacked_p")
def stacked_p(spark, d):
    return _p(A.stacked_p(knn(embeddings(spark, d), K), A.multiscale_perplexities(100)), "perplexity", "i", "j")


#: the ranked pairs are read once; no second join of all pairs
@query("student_q", f"{_W}, qk AS MATERIALIZED (SELECT i, j, rh, 1 / (1 + dl * dl) AS w FROM rk), t AS (SELECT sum(w) AS s FROM qk) SELECT i, j, round(w / s * 1000, 6) AS q1000 FROM qk CROSS JOIN t WHERE rh <= 7")
def student_q(spark, d):
    from oosgauge.operators.knn import edges

    pts = embeddings(spark, d)
    q = A.student_q(edges(knn(pts, 7)), pts)
    return q.select("i", "j", F.round(F.col("q") * 1000.0, 6).alias("q1000"))


_KL = "{0} * (ln({0} + 1e-7::DOUBLE) - ln({1} + 1e-7::DOUBLE))"
_M = "((x + y) * 0.5::DOUBLE)"
_TERM = {
    "kl_divergence": ("kl", _KL.format("x", "y")),
    "kl_reverse": ("kl_reverse", _KL.format("y", "x")),
    "js_divergence": ("js", f"0.5::DOUBLE * ({_KL.format('x', _M)}) + 0.5::DOUBLE * ({_KL.format('y', _M)})"),
    "frobenius_gap": ("frobenius", "(x - y) * (x - y)"),
    "total_variation": ("total_variation", "abs(x - y)"),
}


def _divergence(name, kind, term):
    scale = 1000.0 if kind == "frobenius" else 1.0

    @query(
        name,
        f"{_W}, {CP}, {JP}, {QQ}, c AS (SELECT coalesce(p, 0) AS x, coalesce(q, 0) AS y FROM qq FULL JOIN jp ON jp.i = qq.i AND jp.j = qq.j) "
        f"SELECT round(sum({term}) * {scale}::DOUBLE, 6) AS value FROM c",
    )
    def run(spark, d, _k=kind, _s=scale):
        out = A.embedding_divergence(joint(spark, d), embeddings(spark, d), _k)
        return out.select(r6(F.col("value") * F.lit(_s)).alias("value"))


for _name, (_kind, _term) in _TERM.items():
    _divergence(_name, _kind, _term)


@query("row_entropy", f"{_W}, {CP} SELECT i, round(-sum(p * log2(p)), 6) AS bits FROM cp GROUP BY i")
def row_entropy(spark, d):
    return A.row_entropy(given(spark, d)).select("i", r6("bits").alias("bits"))


@query(
    "submatrix",
    f"{_W}, {CP}, {JP}, {EO}, k AS (SELECT id FROM eo WHERE split = 'O'), s AS (SELECT * FROM jp WHERE i IN (SELECT id FROM k) AND j IN (SELECT id FROM k)) "
    "SELECT i, j, round(p / (SELECT sum(p) FROM s), 6) AS p FROM s",
)
def submatrix(spark, d):
    _, o = split_embeddings(spark, d)
    return _p(A.submatrix(joint(spark, d), o))


@query("calibrate_rows")
def calibrate_rows(spark, d):
    """Precision of each row over its distances to all rows, at perplexity 30, and the entropy reached."""
    got = A.calibrate_rows(embeddings(spark, d), 30.0)
    return got.select("id", r6("param").alias("param"), r6("entropy").alias("entropy"))
