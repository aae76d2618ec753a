"""Neighbour graphs: adjacency, shared neighbours, components, bridges, geodesics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oosgauge.operators import blocks as B
from oosgauge.operators.knn import _frame, edges, knn
from oosgauge.session import parallelism, stable


def knn_graph(points: DataFrame, k: int, weighted: bool = False, id_col: str = "id", vec: str = "features") -> DataFrame:
    """``src, dst, w``: every weight 1 (hops), or the distance when ``weighted``."""
    e = edges(knn(points, k, id_col=id_col, vec=vec), "src", "dst")
    return e.select("src", "dst", F.col("d").alias("w") if weighted else F.lit(1.0).alias("w"))


def snn_similarity(neighbors: DataFrame) -> DataFrame:
    """``i, j, snn``: share of neighbours the two ends of each edge have in common."""
    lists = neighbors.select("id", F.col("neighbors.j").alias("ns"))
    pairs = lists.select(F.col("id").alias("i"), F.explode("ns").alias("j"), F.col("ns").alias("a"))
    other = lists.select(F.col("id").alias("j"), F.col("ns").alias("b"))
    shared = F.size(F.array_intersect("a", "b")) / F.size("a")
    return pairs.join(other, "j").select("i", "j", shared.cast("double").alias("snn"))


def undirected(graph: DataFrame) -> DataFrame:
    """Both directions of every edge, the lighter of duplicates kept."""
    both = graph.select("src", "dst", "w").unionByName(
        graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    )
    return both.filter("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))


def connected_components(nodes: DataFrame, graph: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``id, component``: the lowest id reachable, ignoring direction.

    Each round takes the lowest neighbouring label and then the label of that
    label, so long chains shrink geometrically.
    """
    links = stable(undirected(graph).select("src", "dst"))
    labels = stable(nodes.select(F.col("id").cast("bigint").alias("id"), F.col("id").cast("bigint").alias("component")))
    for _ in range(max_rounds):
        reach = (
            links.join(labels.select(F.col("id").alias("src"), "component"), "src")
            .groupBy(F.col("dst").alias("_d"))
            .agg(F.min("component").alias("_m"))
        )
        low = labels.join(reach, F.col("id") == F.col("_d"), "left").select(
            "id", F.col("component").alias("_was"), F.least("component", F.coalesce("_m", "component")).alias("component")
        )
        # only labels in use need a jump target, one row per label
        jump = low.filter("component <> id").select(F.col("id").alias("_l"), F.col("component").alias("_to"))
        stepped = low.join(jump, F.col("component") == F.col("_l"), "left").select(
            "id", "_was", F.coalesce("_to", "component").alias("component")
        )
        stepped = stable(stepped)
        done = stepped.filter("component <> _was").isEmpty()
        labels = stepped.select("id", "component")
        if done:
            return labels
    raise RuntimeError(f"components still moving after {max_rounds} rounds")


def bridge_components(points: DataFrame, components: DataFrame, id_col: str = "id", vec: str = "features") -> DataFrame:
    """``ci, cj, src, dst, w``: the closest pair of rows of every two components."""
    # a small component lies in one block, so two of them meet once; a large one is dealt by row
    small = components.groupBy("component").agg((F.count(F.lit(1)) <= B.MIN_BLOCK_ROWS).alias("_small"))
    at = F.when(F.col("_small"), F.col("component")).otherwise(F.col("id")).alias("_at")
    p = stable(_frame(points, id_col, vec).join(components, "id").join(small, "component").select("id", "v", "component", at))
    shape = B.shape_of(p, "v")
    nb = max(B.block_count(shape.rows, shape.width, parallelism(p.sparkSession)), -(-shape.rows // B.CELL_BLOCK_ROWS))

    def kernel(lt, rt, lb, rb):
        lo, ro = np.argsort(lt["component"], kind="stable"), np.argsort(rt["component"], kind="stable")
        lc, rc = lt["component"][lo], rt["component"][ro]
        li, ri = lt["id"][lo], rt["id"][ro]
        sq, slack = B.gram_squared(lt["v"][lo], rt["v"][ro])
        sq[lc[:, None] == rc[None, :]] = np.inf
        lu, ls, linv = np.unique(lc, return_index=True, return_inverse=True)
        ru, rs, rinv = np.unique(rc, return_index=True, return_inverse=True)
        low = np.minimum.reduceat(np.minimum.reduceat(sq, ls, axis=0), rs, axis=1)
        r, c = np.nonzero((sq <= low[linv][:, rinv] + 2 * slack.max()) & np.isfinite(sq))
        d = np.empty(len(r))
        step = max(1, (4 << 20) // max(1, lt["v"].shape[1]))
        for s in range(0, len(r), step):
            d[s : s + step] = B.row_distance(lt["v"][lo[r[s : s + step]]], rt["v"][ro[c[s : s + step]]])
        a, b = lc[r], rc[c]
        i, j = li[r], ri[c]
        swap = a > b
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pa.table({"ci": a, "cj": b, "d": d, "i": i, "j": j})

    found = B.cross_blocks(p, p, nb, nb, kernel, "ci bigint, cj bigint, d double, i bigint, j bigint", half=True, id_col="_at")
    best = found.groupBy("ci", "cj").agg(F.min(F.struct("d", "i", "j")).alias("b"))
    return best.select("ci", "cj", F.col("b.i").alias("src"), F.col("b.j").alias("dst"), F.col("b.d").alias("w"))


def connected_knn_graph(points: DataFrame, k: int, weighted: bool = False, id_col: str = "id", vec: str = "features") -> DataFrame:
    """kNN graph, its components joined by bridges when there are several."""
    graph = stable(knn_graph(points, k, weighted, id_col, vec))
    nodes = points.select(F.col(id_col).alias("id"))
    comps = connected_components(nodes, graph)
    if len(comps.select("component").distinct().limit(2).collect()) < 2:
        return graph
    return graph.unionByName(bridge_components(points, comps, id_col, vec).select("src", "dst", "w"))


def geodesic(graph: DataFrame, sources: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``source, node, dist``: undirected shortest paths from the given ids.

    Only pairs improved in the last round are relaxed, and each round is written
    out, so the plan does not grow.
    """
    start = sources.select(F.col("id").cast("bigint").alias("source"))
    return _settled(stable(undirected(graph)), start.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist")), max_rounds)


def _settled(links: DataFrame, start: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``source, node, dist`` relaxed over ``links`` until nothing improves."""
    state = stable(start.select("source", "node", "dist", F.lit(True).alias("fresh")))
    for _ in range(max_rounds):
        moved = (
            state.filter("fresh")
            .join(links, F.col("node") == F.col("src"))
            .groupBy("source", F.col("dst").alias("node"))
            .agg(F.min(F.col("dist") + F.col("w")).alias("_new"))
        )
        better = F.col("dist").isNull() | (F.col("_new") < F.col("dist"))
        state = stable(
            state.drop("fresh")
            .join(moved, ["source", "node"], "full")
            .select(
                "source",
                "node",
                F.least("dist", "_new").alias("dist"),
                F.coalesce(better, F.lit(False)).alias("fresh"),
            )
        )
        if state.filter("fresh").isEmpty():
            return state.drop("fresh")
    raise RuntimeError(f"paths still improving after {max_rounds} rounds")


#: links of a graph that a task of ``geodesic_rows`` holds; longer paths of larger graphs are settled as tables
MOST_LINKS = 1 << 23
#: rows whose paths are relaxed together, and bytes of distances that a task hands on at once
TOGETHER, ROW_BYTES = 64, 64 << 20


def relaxed(dist: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Shortest distances from those given (nodes x rows), in place; links are ordered by ``dst``."""
    ends, first = np.unique(dst, return_index=True)
    cut = np.append(first, len(dst))
    most = max(1, B.TILE_CELLS // (8 * dist.shape[1]))
    spans, a = [], 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(cut, cut[a] + most, "right")) - 1)
        spans.append((ends[a:b], slice(cut[a], cut[b]), first[a:b] - cut[a]))
        a = b
    moved = True
    while moved:
        moved = False
        for nodes, of, at in spans:
            new, old = np.minimum.reduceat(dist[src[of]] + w[of, None], at, axis=0), dist[nodes]
            if (new < old).any():
                dist[nodes], moved = np.minimum(new, old), True
    return dist


#: steps that a byte can count
MOST_HOPS = 254


def hops(entry: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Least numbers of links (rows x nodes) from each row's entry nodes (nodes x rows, 64 at most), a bit for each row.

    None if a node is out of reach or farther than ``MOST_HOPS``. Links are ordered by ``dst``, in both directions.
    """
    size, rows = entry.shape
    bits = np.zeros((size, 64), np.uint8)
    bits[:, :rows] = entry
    front = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0].copy()
    seen, out = front.copy(), np.zeros((size, 64), np.uint8)
    ends, first = np.unique(dst, return_index=True)
    all_rows = np.uint64((1 << rows) - 1)
    for _ in range(MOST_HOPS):
        open_ = ~seen & all_rows
        if not open_.any():
            return out[:, :rows].T
        out += np.unpackbits(open_.view(np.uint8), bitorder="little").reshape(size, 64)
        if not len(ends):
            return None
        new = np.zeros(size, np.uint64)
        new[ends] = np.bitwise_or.reduceat(front[src], first)
        front = new & ~seen
        if not front.any():
            return None
        seen |= front
    return None if (~seen & all_rows).any() else out[:, :rows].T


def geodesic_rows(
    graph: DataFrame, starts: DataFrame, nodes: np.ndarray, most_links: int = MOST_LINKS, counts: bool = False
) -> DataFrame:
    """``id, d``: shortest undirected paths of each row of ``starts`` to all ``nodes`` (ascending ids), in their order.

    ``starts`` holds ``id, node, dist``: where a row enters the graph, and at what distance. Rows are
    dealt to groups, every group meets the links and keeps its distances in memory until they are
    final, so only final ones are written. ``d`` is packed, the bytes of its doubles; no path: infinity.
    With ``counts`` all weights must be 1 and all entries at distance 0: ``d`` is a byte a node, null where ``hops`` gives none.
    """
    links = stable(undirected(graph))
    entry = starts.select(F.col("id").cast("bigint").alias("id"), F.col("node").cast("bigint").alias("node"), "dist").dropna()
    starts = stable(entry.groupBy("id", "node").agg(F.min("dist").alias("dist")))
    spark = links.sparkSession
    shared = spark.sparkContext.broadcast(nodes)
    if not counts and links.count() > most_links:
        return _as_rows(_settled(links, starts.withColumnRenamed("id", "source")), nodes)
    n = starts.select("id").distinct().count()
    groups = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-(1 if counts else 8) * n * len(nodes) // ROW_BYTES))))
    lk = starts.withColumn("_g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).repartition(groups, "_g")
    once = links.filter("src < dst").withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    schema = "id bigint, d binary"
    empty = B._empty_table(schema)

    def run(lt: pa.Table, rt: pa.Table) -> pa.Table:
        if not lt.num_rows:
            return empty
        s, e = B.decode(lt.select(["id", "node", "dist"])), B.decode(rt.select(["src", "dst", "w"]))
        a, b = (np.searchsorted(shared.value, e[c]) for c in ("src", "dst"))
        src, dst, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([e["w"], e["w"]])
        order = np.argsort(dst, kind="stable")
        src, dst, w = src[order], dst[order], w[order]
        ids, row = np.unique(s["id"], return_inverse=True)
        at, size = np.searchsorted(shared.value, s["node"]), len(shared.value)
        packed, out = [], np.empty((0 if counts else len(ids), size))
        for first in range(0, len(ids), TOGETHER):
            here = (row >= first) & (row < first + TOGETHER)
            if counts:
                entry = np.zeros((size, min(TOGETHER, len(ids) - first)), bool)
                entry[at[here], row[here] - first] = True
                found = hops(entry, src, dst)
                packed += [None] * entry.shape[1] if found is None else B.counts_packed(found)
                continue
            dist = np.full((size, min(TOGETHER, len(ids) - first)), np.inf)
            np.minimum.at(dist, (at[here], row[here] - first), s["dist"][here])
            out[first : first + TOGETHER] = relaxed(dist, src, dst, w).T
        return pa.table({"id": pa.array(ids, pa.int64()), "d": pa.array(packed if counts else [d.tobytes() for d in out], pa.binary())})

    return lk.groupBy("_g").cogroup(once.repartition(groups, "_g").groupBy("_g")).applyInArrow(run, schema)


def _as_rows(paths: DataFrame, nodes: np.ndarray) -> DataFrame:
    """``id, d`` of ``geodesic_rows`` from a table ``source, node, dist``."""
    shared = paths.sparkSession.sparkContext.broadcast(nodes)
    schema = "id bigint, d binary"

    def run(table: pa.Table) -> pa.Table:
        d = np.full(len(shared.value), np.inf)
        d[np.searchsorted(shared.value, table.column("node").to_numpy())] = table.column("dist").to_numpy()
        return pa.table({"id": table.column("source").slice(0, 1), "d": pa.array([d.tobytes()], pa.binary())})

    return paths.groupBy(F.col("source")).applyInArrow(run, schema)


def oos_geodesic(neighbors: DataFrame, paths: DataFrame) -> DataFrame:
    """``id, source, dist``: path length through the best of a new row's neighbours."""
    via = edges(neighbors, "id", "node").select("id", "node", "d")
    return (
        via.join(paths, "node")
        .groupBy("id", "source")
        .agg(F.min(F.col("d") + F.col("dist")).alias("dist"))
    )
