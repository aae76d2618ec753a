import numpy as np
import pytest
from reference import dist, order, shortest

from oosgauge.operators import graph as G
from oosgauge.operators import pairwise as P
from oosgauge.operators.cells import probed_knn, recall
from oosgauge.operators.knn import edges, knn, rank_of


def lists(df):
    return {r["id"]: [n["j"] for n in r["neighbors"]] for r in df.collect()}


def clumped(rng, n=240, d=3):
    """A third of the rows are copies of one vector, some more lie on a grid with ties."""
    x = rng.normal(size=(n, d))
    x[: n // 3] = x[0]
    x[n // 3 : n // 2] = np.round(x[n // 3 : n // 2])
    return x[rng.permutation(n)]


@pytest.mark.parametrize("collapse", [True, False])
@pytest.mark.parametrize("prune_from", [1, 10**9])
def test_exact_neighbours_with_copies_and_ties(make, rng, collapse, prune_from):
    x = clumped(rng)
    df = make(x)
    got = lists(knn(df, 5, collapse=collapse, prune_from=prune_from))
    want = order(dist(x))
    assert {i: list(w[:5]) for i, w in enumerate(want)} == got


def test_pruned_cells_equal_blocks_on_clusters(spark, make, rng):
    from oosgauge.operators.blocks import shape_of
    from oosgauge.operators.cells import pruned_knn

    x = np.concatenate([rng.normal(c, 0.3, size=(150, 2)) for c in (0, 5, 40)])
    base = make(x).selectExpr("id", "features as v")
    found = pruned_knn(base, base, 6, True, shape_of(base, "v"), cell_rows=30)
    want = order(dist(x))
    assert lists(found) == {i: list(w[:6]) for i, w in enumerate(want)}


def test_cross_and_self(make, rng):
    e, o = rng.normal(size=(90, 4)), rng.normal(size=(40, 4))
    got = lists(knn(make(e), 7, queries=make(o), prune_from=1))
    want = order(dist(o, e), skip_self=False)
    assert got == {i: list(w[:7]) for i, w in enumerate(want)}
    own = lists(knn(make(e), 3, include_self=True))
    assert all(js[0] == i for i, js in own.items())


def test_fewer_rows_than_k(make):
    got = lists(knn(make(np.eye(3)), 10))
    assert got == {0: [1, 2], 1: [0, 2], 2: [0, 1]}


def test_same_result_under_any_partitioning(make, rng):
    df = make(clumped(rng, 90))
    assert lists(knn(df.repartition(1), 4)) == lists(knn(df.repartition(7), 4))


@pytest.mark.parametrize("prune_from", [1, 10**9])
def test_ranks_count_ties_by_id(make, rng, prune_from, monkeypatch):
    from oosgauge.operators import cells

    whole = cells.choose_pivots
    monkeypatch.setattr(cells, "choose_pivots", lambda b, s, _rows: whole(b, s, 8))
    x = clumped(rng, 120)
    p = rng.normal(size=(120, 2))
    df = make(x, p)
    got = {(r["i"], r["j"]): r["rank"] for r in rank_of(edges(knn(df, 6, vec="proj")), df, prune_from=prune_from).collect()}
    want = order(dist(x))
    place = [{j: r + 1 for r, j in enumerate(o)} for o in want]
    assert len(got) == 120 * 6
    assert all(place[i][j] == r for (i, j), r in got.items())


def test_probing_finds_most(make, rng):
    df = make(rng.normal(size=(600, 3)))
    found = probed_knn(df.selectExpr("id", "features as v"), 7, probes=5, cell_rows=60)
    assert recall(found, knn(df, 7)).first()["recall"] > 0.85


def test_components_bridges_and_paths(spark, make, rng):
    x = np.concatenate([rng.normal(c, 0.2, size=(25, 2)) for c in (0, 6, 20)])
    df = make(x)
    graph = G.knn_graph(df, 3)
    comp = {r["id"]: r["component"] for r in G.connected_components(df, graph).collect()}
    raw = [(r["src"], r["dst"], r["w"]) for r in graph.collect()]
    from reference import shortest

    reach = np.isfinite(shortest(75, raw))
    assert comp == {i: int(np.nonzero(reach[i])[0].min()) for i in range(75)}
    comps = spark.createDataFrame(list(comp.items()), "id bigint, component bigint")
    bridges = G.bridge_components(df, comps).collect()
    d = dist(x)
    for b in bridges:
        a = [i for i in comp if comp[i] == b["ci"]]
        c = [i for i in comp if comp[i] == b["cj"]]
        assert b["w"] == pytest.approx(d[np.ix_(a, c)].min())
    k = len(set(comp.values()))
    assert len(bridges) == k * (k - 1) // 2
    whole = G.connected_knn_graph(df, 3)
    want = shortest(75, [(r["src"], r["dst"], r["w"]) for r in whole.collect()])
    paths = G.geodesic(whole, df.filter("id in (0, 30, 74)").select("id")).collect()
    assert len(paths) == 3 * 75
    assert all(r["dist"] == pytest.approx(want[r["source"], r["node"]]) for r in paths)


def test_long_chain_components(spark):
    nodes = spark.range(60)
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(59)], "src bigint, dst bigint, w double")
    got = G.connected_components(nodes, chain).select("component").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_kernel_width_is_median_of_ten_largest_entries(make, rng):
    x = rng.normal(size=(50, 3))
    top = np.sort(dist(x).ravel())[-10:]
    assert P.kernel_width(make(x)) == pytest.approx(np.median(top) / np.sqrt(-2 * np.log(0.6)))


def test_kernel_rows_sum_to_one(make, rng):
    x = rng.normal(size=(30, 3))
    df = make(x)
    pairs = df.selectExpr("id as i").crossJoin(df.selectExpr("id as j"))
    k = P.gaussian_kernel_rows(pairs, df, 0.8).groupBy("i").sum("k").collect()
    assert all(r[1] == pytest.approx(1.0) for r in k)


def test_strips_bound_the_cells_of_a_kernel():
    import pyarrow as pa

    from oosgauge.operators import blocks as B

    left, right = {"id": np.arange(103)}, {"id": np.arange(B.TILE_CELLS // 10)}
    strips = []
    got = pa.concat_tables(B.tiled(left, right, lambda t: strips.append(len(t["id"])) or pa.table(t)))
    assert max(strips) == 10 and got.column("id").to_pylist() == list(range(103))


def test_distances_for_sums_agree_with_direct_ones(rng):
    from oosgauge.operators import blocks as B

    x = rng.normal(size=(200, 30)) + 1e4
    y = np.concatenate([x[:20], x[20:40] + 1e-7, rng.normal(size=(300, 30)) + 1e4])
    direct = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert (B.pair_distance(x, y) == direct).all() and (B.pair_distance(x[:, :3], y[:, :3]) == dist(x[:, :3], y[:, :3])).all()
    assert np.allclose(B.close_distance(x, y), direct, rtol=1e-9, atol=0) and (B.close_distance(x, y)[np.arange(20), np.arange(20)] == 0).all()


def test_search_leaves_the_cells_where_they_prune_nothing(spark, make, rng):
    from oosgauge.operators.blocks import shape_of
    from oosgauge.operators.cells import pruned_knn

    x = rng.normal(size=(150, 20))
    base = make(x).selectExpr("id", "features as v")
    assert pruned_knn(base, base, 4, True, shape_of(base, "v"), cell_rows=15, most=100) is None
    want = order(dist(x))
    assert {i: list(w[:4]) for i, w in enumerate(want)} == lists(knn(make(x), 4, prune_from=1))


@pytest.mark.parametrize("most_links", [0, 1 << 20])
def test_path_rows_from_entries(spark, most_links, monkeypatch):
    """Final rows only, from entries at given distances, by vectors and by tables; no path is infinite."""
    monkeypatch.setattr(G.B, "TILE_CELLS", 64)  # many spans of links
    links = [(0, 10, 1.5), (10, 20, 1.0), (20, 0, 4.0), (30, 40, 1.0), (40, 30, 0.5)]
    graph = spark.createDataFrame(links, "src bigint, dst bigint, w double")
    starts = [(i, i, 0.0) for i in (0, 10, 20, 30, 40)] + [(7, 0, 2.0), (7, 20, 0.25), (7, 20, 9.0)]
    nodes = np.array([0, 10, 20, 30, 40])
    rows = G.geodesic_rows(graph, spark.createDataFrame(starts, "id bigint, node bigint, dist double"), nodes, most_links).collect()
    inf = np.inf
    assert {r["id"]: np.frombuffer(r["d"]).tolist() for r in rows} == {
        0: [0, 1.5, 2.5, inf, inf], 10: [1.5, 0, 1, inf, inf], 20: [2.5, 1, 0, inf, inf],
        30: [inf, inf, inf, 0, 0.5], 40: [inf, inf, inf, 0.5, 0], 7: [2.0, 1.25, 0.25, inf, inf],
    }


def test_kernel_width_takes_the_largest_of_every_block(make, rng):
    x = rng.normal(size=(60, 9))
    x[5] = x[6] * 30  # the largest distances all lie in one row
    largest = np.sort(dist(x)[np.triu_indices(60, 1)])[::-1][:5]
    assert np.isclose(P.kernel_width(make(x)), np.median(np.repeat(largest, 2)) / np.sqrt(-2 * np.log(0.6)), rtol=1e-9)


def test_ranks_among_copies_settle_ties_in_parts():
    import tracemalloc

    from oosgauge.operators.knn import closer_counts

    ids, x = np.arange(500), np.ones((500, 64))
    tracemalloc.start()
    got = closer_counts(ids, x, ids, x, np.full((500, 1), 250), np.zeros((500, 1)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all 250,000 distances tie: rows before the target by id, the row itself left out
    np.testing.assert_array_equal(got[:, 0], 250 - (ids < 250))
    assert peak < 200e6


def test_double_centring_gives_the_whole_matrix(spark, make, rng, monkeypatch):
    from oosgauge.catalog import neighbours as C

    x = rng.normal(size=(40, 3))
    x[5] = x[6]
    df = make(x)
    monkeypatch.setattr(C, "embeddings", lambda *_: df)
    monkeypatch.setattr(P.B, "CELL_BLOCK_ROWS", 16)  # blocks meet in both directions
    d2 = dist(x) ** 2
    want = -0.5 * (d2 - d2.mean(axis=0)[None, :] - d2.mean(axis=1)[:, None] + d2.mean())
    got = {(r["i"], r["j"]): r["b"] for r in C.double_centre(spark, "").collect()}
    assert len(got) == 1600  # 7 partners a row before
    assert all(b == pytest.approx(want[i, j], abs=2e-6) for (i, j), b in got.items())
    again = df.unionByName(df.limit(1)).unionByName(spark.createDataFrame([(99, None, None, None)], df.schema))
    rows = C.P.double_centred(again).collect()
    assert len(rows) == 42 * 42
    assert all((r["b"] is None) == (99 in (r["i"], r["j"])) for r in rows)


def test_hops_are_counted_in_bits(spark, rng):
    n = 90
    links = [(i, i + 1) for i in range(n - 1)] + [tuple(int(v) for v in rng.integers(0, n, 2)) for _ in range(8)]
    want = shortest(n, [(i, j, 1.0) for i, j in links if i != j])
    graph = spark.createDataFrame([(i, j, 1.0) for i, j in links], "src bigint, dst bigint, w double")
    starts = spark.range(n).selectExpr("id", "id as node", "0.0D as dist")
    rows = G.geodesic_rows(graph, starts, np.arange(n), counts=True).collect()
    assert len(rows) == n and all(len(r["d"]) < 8 * n // 4 for r in rows)  # a number was 8 bytes
    assert all((G.B.unpacked(r["d"]) == want[r["id"]]).all() for r in rows)
    cut = graph.filter("src <> 40 and dst <> 40")
    assert all(r["d"] is None for r in G.geodesic_rows(cut, starts, np.arange(n), counts=True).collect())


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("weighted", [False, True])
def test_isomap_places_new_rows_as_their_own_paths_do(make, rng, monkeypatch, apart, weighted):
    from oosgauge.operators import landmarks as L

    x = rng.normal(size=(70, 3))
    if apart:  # two components, joined by a bridge of another length
        x[:30] += 40.0
    e, o = make(x), make(rng.normal(size=(9, 3)), first=500)
    place = lambda df: np.array([r["proj"] for r in df.orderBy("id").collect()])
    m = L.OosIsomap(n_neighbors=5, weighted=weighted).fit(e)
    new, old = place(m.transform_oos(o)), place(m.transform())
    monkeypatch.setattr(L, "MOST_ENTRIES", 0)
    assert np.allclose(place(m.transform_oos(o)), new, atol=1e-9)
    monkeypatch.setattr(G, "MOST_HOPS", 0)  # paths as doubles
    assert np.allclose(place(L.OosIsomap(n_neighbors=5, weighted=weighted).fit(e).transform()), old, atol=1e-9)
