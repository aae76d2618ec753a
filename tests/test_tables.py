import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import check
from __spark_entry__ import entry, oracle_sql, queries
from oosgauge.functions.draws import shuffled_position
from oosgauge.operators import affinity as Y
from oosgauge.operators import fuzzy as Z
from oosgauge.operators import prep as P
from oosgauge.operators import synth as S
from oosgauge.operators.knn import knn
from oosgauge.plans import reports as R

SF = "/root/testdata/sf0.001"
QUICK = [
    "knn_exact", "snn_similarity", "jaccard_general", "standard_scale", "random_split", "proportion_stages", "shuffled_batches",
    "write_staged", "projection_catalog", "delimited_scan", "structure_grid", "delta_summary", "best_method", "pca",
    "farthest_point_sample", "fuzzy_union", "apply_links", "link_lifecycle", "joint_p", "js_divergence", "sample_pdf_2d",
    "hole_sample", "cluster_blobs", "mlp_score", "stream_project",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    assert check.compare(df, rows, duck, oracle_sql()[name]) == ""


def test_entry_and_catalogue(spark):
    assert {r["metric"] for r in entry(spark).collect()} == {"t", "c", "lc"}
    assert set(oracle_sql()) <= set(queries())


def test_shuffled_positions_are_a_permutation_in_hot_groups(spark):
    df = spark.range(900).withColumn("g", F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 3))
    for rows in (df.repartition(1), df.repartition(7)):
        got = shuffled_position(rows, "id", 3, ["g"]).groupBy("g").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()
        assert all(r["p"] == list(range(1, len(r["p"]) + 1)) for r in got)


def test_scalers_on_constant_dimensions(make, rng):
    x = rng.normal(size=(30, 3))
    x[:, 1] = 4.0
    (z,) = P.standard_scale(make(x))
    m = np.array([r["features"] for r in z.collect()])
    assert np.allclose(m.std(axis=0), [1, 0, 1]) and np.allclose(m[:, 1], 0)
    (u,) = P.minmax_scale(make(x))
    m = np.array([r["features"] for r in u.collect()])
    assert m.min() == 0 and np.allclose(m.max(axis=0), [1, 0, 1])


def test_bandwidths_reach_their_target(make, rng):
    x = rng.normal(size=(60, 4))
    rows = Z.smooth_knn_dist(knn(make(x), 10), 10).collect()
    for r in rows:
        d = np.array([n["d"] for n in r["neighbors"]])
        mass = np.exp(-np.maximum(d[1:] - r["rho"], 0) / r["sigma"]).sum()
        assert r["rho"] == pytest.approx(d[0])
        assert mass == pytest.approx(math.log2(10), abs=1e-4)


def test_bandwidth_floor_and_zero_rows():
    d = np.array([[0.0, 0.0, 0.0, 0.0], [0.0, 1.0, 1.0, 1.0]])
    sigma, rho = Z.smooth_bandwidths(d, 4.0, d.mean())
    assert rho.tolist() == [0.0, 1.0]
    assert (sigma >= 1e-3 * d.mean() - 1e-15).all()


@pytest.mark.parametrize("how,value,unit", [("beta", 6.0, "nat"), ("sigma", 2.5, "bit"), ("root", 6.0, "bit")])
def test_calibrated_rows_have_the_asked_entropy(make, rng, how, value, unit):
    rows = Y.calibrate(knn(make(rng.normal(size=(50, 3))), 15), value, how).collect()
    for r in rows:
        d = np.array([n["d"] for n in r["neighbors"]])
        x = {"beta": np.r_[0, d * d] * r["param"], "sigma": d * d / (2 * r["param"]), "root": d * r["param"]}[how]
        p = np.exp(-x) / np.exp(-x).sum()
        h = -(p * np.log(p)).sum()
        want = value if how == "sigma" else (math.log(value) if unit == "nat" else math.log2(value))
        # the doubling search takes one more half step after it has met its tolerance
        assert (h if unit == "nat" else h / math.log(2)) == pytest.approx(want, abs=2e-2 if how == "beta" else 2e-3)
        assert r["entropy"] == pytest.approx(want, abs=2e-4)


def test_affinity_properties(make, rng):
    x = rng.normal(size=(50, 3))
    df = make(x)
    p = Y.joint_p(Y.conditional_p(Y.calibrate(knn(df, 12), 5.0)), 50)
    cells = {(r["i"], r["j"]): r["p"] for r in p.collect()}
    assert all(cells[j, i] == pytest.approx(v) for (i, j), v in cells.items())
    assert sum(cells.values()) == pytest.approx(1.0)
    for kind in ("kl", "js", "frobenius", "total_variation"):
        assert Y.embedding_divergence(p, df, kind).first()["value"] >= 0
    same = p.withColumnRenamed("p", "q")
    assert Y.divergence(p, same, "kl").first()["value"] == pytest.approx(0.0)
    with pytest.raises(ValueError):
        Y.divergence(p, same, "nope")
    assert Y.multiscale_perplexities(100) == [4.0, 8.0]


def test_links_with_a_hub(spark):
    star = [(0, j, 0.5) for j in range(1, 200)] + [(j, 0, 0.5) for j in range(1, 200)]
    graph = spark.createDataFrame(star, "i bigint, j bigint, w double")
    repo = Z.neighbor_repository(graph, 10, 5, 3).groupBy("i").count().filter("i = 0").first()[1]
    assert repo == 10
    w = Z.neighbor_weights(graph).filter("i = 0").agg(F.sum("weight")).first()[0]
    assert w == pytest.approx(1.0)


def test_grid_selection(spark):
    t = spark.createDataFrame([("a",), ("b",)], "dataset string")
    assert R.grid_select(t, None, "dataset").count() == 2
    with pytest.raises(ValueError, match="unknown"):
        R.grid_select(t, ["a", "z"], "dataset")


def test_mixture_of_generators(spark):
    from oosgauge.catalog.synth import spec

    rows = S.mixture_rows(spark.range(400), spec(0), 5).collect()
    x = np.array([r["features"] for r in rows], dtype=float)
    assert x.shape == (400, 5) and np.isfinite(x).all()
    assert {r["label"] for r in rows} <= {0, 1, 2, 3}
    assert (np.abs(x[:, 4]) <= 0.5 + 1 / 11).all()
    bad = spec(0)
    bad["generators"][0]["params"]["dimensions"] = [0, 1, 9]
    with pytest.raises(ValueError, match="undefined"):
        S.check_spec(bad)


def test_rotations():
    assert np.allclose(S.euler_matrix("z", 90) @ [1, 0, 0], [0, 1, 0])
    assert np.allclose(S.euler_matrix("xyz", (90, 0, 90)) @ [0, 1, 0], [0, 0, 1])
    assert np.allclose(S.euler_matrix("XYZ", (90, 0, 90)), S.euler_matrix("zyx", (90, 0, 90)))
