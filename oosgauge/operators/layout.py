"""Plane layouts of neighbour graphs: attraction along edges, repulsion between all rows.

The edges are dealt to the tasks of a barrier stage by their first row, and stay there. A step
needs the places of neighbours anywhere, so tasks exchange the places they moved: two numbers a
row, the only thing that is exchanged. A job runs ``SPAN`` epochs and writes rows with their places
and momenta; a lost executor costs one span. Every task does its sums in the order of ids, so
that the layout does not depend on how many tasks there are.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oosgauge.operators.training import Exchange, meeting_place, spread
from oosgauge.session import ship, stable

SPAN = 250
#: edges of a task; more edges make more tasks
TASK_EDGES = 1 << 22
#: rows whose places (16 bytes each) every task holds; a larger table raises, it is never cut
MOST_ROWS = 1 << 22
STATE = "id bigint, y array<double>, v array<double>, gain array<double>, j bigint, p double, gap double, loss double"


# --- repulsion between all rows ------------------------------------------------


def _smooth(n: int) -> int:
    """The least number from ``n`` on without prime factors over 5, which transforms fast."""
    while True:
        rest = n
        for f in (2, 3, 5):
            while rest % f == 0:
                rest //= f
        if rest == 1:
            return n
        n += 1


@dataclass(frozen=True)
class Grid:
    """Sums of Student kernels over all points by interpolation on a grid.

    Points spread their charge to ``order`` nodes a side of their cell, kernels between nodes are
    one convolution, and points read the potentials back with the same weights. Cells are at most
    ``width`` wide, which bounds the error whatever the number of points (under 1 % of the dense
    sums); there are at least ``least`` a side, and more than ``most`` raise, since a task holds their square.
    """

    width: float = 0.8
    order: int = 4
    least: int = 16
    most: int = 640

    def _weights(self, t: np.ndarray) -> np.ndarray:
        """Lagrange polynomials of equally spaced nodes at ``t`` in [0, 1]."""
        nodes = (np.arange(self.order) + 0.5) / self.order
        out = np.ones((len(t), self.order))
        for k in range(self.order):
            for m in range(self.order):
                if m != k:
                    out[:, k] *= (t - nodes[m]) / (nodes[k] - nodes[m])
        return out

    def __call__(self, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Sum over j of w_ij^2 (y_i - y_j) for each i, and the sum of w over pairs of different rows; w = 1 / (1 + d^2)."""
        low = y.min(axis=0)
        span = float((y.max(axis=0) - low).max()) or 1e-12
        cells = max(self.least, math.ceil(span / self.width))
        if cells > self.most:
            raise ValueError(f"a layout {span:.0f} wide needs over {self.most} cells a side")
        h, n = span / cells, cells * self.order
        at = (y - low) / h
        cell = np.clip(np.floor(at).astype(np.int64), 0, cells - 1)
        wx, wy = (self._weights(at[:, c] - cell[:, c]) for c in (0, 1))
        combos = list(itertools.product(range(self.order), repeat=2))
        place = [(cell[:, 0] * self.order + a) * n + cell[:, 1] * self.order + b for a, b in combos]
        share = [wx[:, a] * wy[:, b] for a, b in combos]
        size = _smooth(2 * n)
        step = np.minimum(np.arange(size), size - np.arange(size)) * (h / self.order)
        w = 1.0 / (1.0 + step[:, None] ** 2 + step[None, :] ** 2)
        one, two = np.fft.rfft2(w), np.fft.rfft2(w * w)
        centred = y - y.mean(axis=0)

        def potential(charge: np.ndarray, kernel: np.ndarray) -> np.ndarray:
            grid = np.zeros(n * n)
            for p, s in zip(place, share):
                grid += np.bincount(p, weights=s * charge, minlength=n * n)
            wave = np.fft.rfft2(grid.reshape(n, n), s=(size, size)) * kernel
            read = np.fft.irfft2(wave, s=(size, size))[:n, :n].ravel()
            return sum(s * read[p] for p, s in zip(place, share))

        ones = np.ones(len(y))
        mass = potential(ones, two)
        pull = np.column_stack([potential(centred[:, c], two) for c in (0, 1)])
        return mass[:, None] * centred - pull, float(potential(ones, one).sum()) - len(y)


# --- one step of each kind -----------------------------------------------------


@dataclass(frozen=True)
class StudentStep:
    """Descent on KL(P | Q), Q Student kernels over their sum, with momentum and gains for each coordinate."""

    lr: float
    early: int = 250
    factor: float = 12.0
    grid: Grid = field(default_factory=Grid)
    rounds: int = 1

    def __call__(self, step, all_y, own, head, tail, ids, edge, state):
        y = all_y[own]
        gap = y[head] - all_y[tail]
        d = (gap * gap).sum(axis=1)
        w = 1.0 / (1.0 + d)
        force = (edge["p"] * w)[:, None] * gap
        near = np.column_stack([np.bincount(head, weights=force[:, c], minlength=len(y)) for c in (0, 1)])
        push, total = self.grid(all_y)
        raised = self.factor if step < self.early else 1.0
        g = 4.0 * (raised * near - push[own] / total)
        v, gain = state["v"], state["gain"]
        if step == self.early:  # the second phase starts at rest: the first one's gains and momentum throw the groups apart
            v, gain = np.zeros_like(v), np.ones_like(gain)
        gain = np.maximum(np.where(v * g < 0, gain + 0.2, gain * 0.8), 0.01)
        v = (0.5 if step < self.early else 0.8) * v - self.lr * gain * g
        state["v"], state["gain"] = v, gain
        p = edge["p"]
        loss = float((p * np.log(np.maximum(p, 1e-300) * total / w)).sum())
        return y + v, loss


@dataclass(frozen=True)
class SampledStep:
    """Cross-entropy of edge memberships by drawn edges: each edge moves its ends every ``gap`` epochs and meets ``negatives`` drawn rows.

    Both directions of an edge are rows, so a first row moves twice as far and the second one not
    at all. The edges due in an epoch are dealt to ``rounds`` rounds; moves are summed by row and
    round, in the order of ids, and each is at most ``clip`` long in a coordinate.
    """

    epochs: int
    a: float
    b: float
    lr: float = 1.0
    negatives: int = 5
    rounds: int = 8
    clip: float = 4.0
    seed: int = 42

    def __call__(self, step, all_y, own, head, tail, ids, edge, state):
        epoch, part = divmod(step, self.rounds)
        gap = edge["gap"]
        due = np.floor((epoch + 1) / gap) > np.floor(epoch / gap)
        i, j = ids[head], edge["j"]
        both = np.minimum(i, j) * np.int64(1000003) + np.maximum(i, j) * np.int64(8191)
        due &= np.floor(spread(both, self.seed + epoch) * self.rounds) == part
        h, t, key = head[due], tail[due], i[due] * np.int64(1000003) + j[due] * np.int64(8191)
        y, alpha = all_y[own], self.lr * (1.0 - epoch / self.epochs)
        away = y[h] - all_y[t]
        d = (away * away).sum(axis=1)
        on = d > 0
        safe = np.where(on, d, 1.0)
        pull = np.where(on, -2.0 * self.a * self.b * safe ** (self.b - 1.0) / (1.0 + self.a * safe**self.b), 0.0)
        move = 2.0 * np.clip(pull[:, None] * away, -self.clip, self.clip)
        moved = [np.bincount(h, weights=move[:, c], minlength=len(y)) for c in (0, 1)]
        for k in range(self.negatives):
            other = np.minimum((spread(key + np.int64(k), self.seed + 7919 * (epoch + 1)) * len(all_y)).astype(np.int64), len(all_y) - 1)
            away = y[h] - all_y[other]
            d = (away * away).sum(axis=1)
            push = np.where(other == own[h], 0.0, 2.0 * self.b / ((0.001 + d) * (1.0 + self.a * d**self.b)))
            move = np.clip(push[:, None] * away, -self.clip, self.clip)
            moved = [m + np.bincount(h, weights=move[:, c], minlength=len(y)) for c, m in enumerate(moved)]
        d = ((y[head] - all_y[tail]) ** 2).sum(axis=1)
        loss = float((edge["p"] * np.log1p(self.a * d**self.b)).sum())
        return y + alpha * np.clip(np.column_stack(moved), -self.clip, self.clip), loss


# --- the exchange --------------------------------------------------------------


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * 2), pa.array(m.ravel()))


def _span(move, first: int, last: int, folder: str | None):
    def run(batches):
        from pyspark import BarrierTaskContext

        exchange = Exchange(BarrierTaskContext.get(), folder)

        def together(own: np.ndarray) -> list[np.ndarray]:
            return [np.frombuffer(x, dtype=own.dtype) for x in exchange(own.tobytes())]

        tables = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(tables) if tables else None
        ids, y, state = np.zeros(0, np.int64), np.zeros((0, 2)), {"v": np.zeros((0, 2)), "gain": np.ones((0, 2))}
        edge = {"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "p": np.zeros(0), "gap": np.zeros(0)}
        if table is not None:
            is_node = pc.is_null(table.column("j"))
            nodes, links = table.filter(is_node), table.filter(pc.invert(is_node))
            ids = nodes.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            pair = lambda c: nodes.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)[order]
            ids, y, state = ids[order], pair("y"), {"v": pair("v"), "gain": pair("gain")}
            edge = {"i": links.column("id").to_numpy(), **{c: links.column(c).to_numpy() for c in ("j", "p", "gap")}}
            by = np.lexsort((edge["j"], edge["i"]))
            edge = {c: x[by] for c, x in edge.items()}
        everyone = np.concatenate(together(ids))
        rank = np.argsort(everyone, kind="stable")
        whole = everyone[rank]
        own, head, tail = np.searchsorted(whole, ids), np.searchsorted(ids, edge["i"]), np.searchsorted(whole, edge["j"])
        loss = 0.0
        all_y = np.concatenate(together(y.ravel())).reshape(-1, 2)[rank]
        for step in range(first, last):
            y, loss = move(step, all_y, own, head, tail, ids, edge, state)
            all_y = np.concatenate(together(y.ravel())).reshape(-1, 2)[rank]
            if step == last - 1:
                loss = float(sum(x[0] for x in together(np.array([loss]))))
        y = all_y[own] - all_y.mean(axis=0) if len(own) else y
        n = len(ids)
        none = [pa.nulls(n, t) for t in (pa.int64(), pa.float64(), pa.float64())]
        if n:
            columns = [pa.array(ids), _lists(y), _lists(state["v"]), _lists(state["gain"]), *none, pa.array(np.full(n, loss))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "y", "v", "gain", "j", "p", "gap", "loss"])

    return run


def lay_out(start: DataFrame, edges: DataFrame, steps: int, move: Callable) -> tuple[DataFrame, list[float]]:
    """``id, proj`` after ``steps`` moves of ``start`` (``id, proj``) over ``edges`` (``i, j, p, gap``), and the loss at the end of each span.

    Edges whose ends are not both rows of ``start`` must not occur. An empty table gives an empty layout.
    """
    sc = ship(start.sparkSession).sparkContext
    links = stable(edges.select(F.col("i").alias("id"), F.lit(None).cast("array<double>").alias("y"), F.lit(None).cast("array<double>").alias("v"),
                                F.lit(None).cast("array<double>").alias("gain"), "j", "p", "gap", F.lit(None).cast("double").alias("loss")))
    pair = lambda x: F.array(F.lit(x), F.lit(x))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("j", "bigint"), ("p", "double"), ("gap", "double"), ("loss", "double"))]
    nodes = stable(start.select("id", F.col("proj").alias("y"), pair(0.0).alias("v"), pair(1.0).alias("gain"), *empty))
    rows, count = nodes.count(), links.count()
    if rows > MOST_ROWS:
        raise ValueError(f"{rows} rows: every task would hold the places of more than {MOST_ROWS}")
    tasks = max(1, min(sc.defaultParallelism, -(-max(count, rows) // TASK_EDGES)))
    losses: list[float] = []
    span, folder = SPAN * move.rounds, meeting_place(start.sparkSession)
    for first in range(0, steps if rows else 0, span):
        run = _span(move, first, min(steps, first + span), folder)
        nodes = stable(nodes.unionByName(links).repartition(tasks, "id").mapInArrow(run, STATE, barrier=True))
        losses.append(float(nodes.agg(F.max("loss")).first()[0]))
    return nodes.select("id", F.col("y").alias("proj")), losses


# --- the two layouts -----------------------------------------------------------


def _principal(e: DataFrame, size: float, by_largest: bool) -> DataFrame:
    """The first two principal components, scaled so that the first deviates by ``size`` (or reaches it at most)."""
    from oosgauge.operators.linear import fit_pca

    placed = stable(fit_pca(e).project(e).select("id", "proj"))
    x, y = F.col("proj")[0], F.col("proj")[1]
    seen = placed.agg(F.stddev_pop(x).alias("s"), F.greatest(F.max(F.abs(x)), F.max(F.abs(y))).alias("m")).first()
    scale = size / ((seen["m"] if by_largest else seen["s"]) or 1.0)
    return placed.select("id", F.transform("proj", lambda c: c * F.lit(scale)).alias("proj"))


def tsne(e: DataFrame, perplexity: float = 30.0, steps: int = 1000, early: int = 250, factor: float = 12.0, lr: float | None = None) -> tuple[DataFrame, list[float]]:
    """``id, proj``: the t-SNE layout of E, and the divergence at the end of each span.

    P comes from the 3 * perplexity nearest rows, precisions at the perplexity, both directions
    averaged. It starts from principal components. Tables of two rows or fewer get that start.
    """
    from oosgauge.operators.affinity import calibrate, conditional_p, joint_p
    from oosgauge.operators.knn import knn

    n = e.count()
    start = _principal(e, 1e-4, False) if n > 1 else e.select("id", F.array(F.lit(0.0), F.lit(0.0)).alias("proj"))
    if n <= 2:
        return start, []
    reach = min(float(perplexity), max(1.0, (n - 1) / 3))
    near = knn(e, max(1, min(n - 1, int(3 * reach))))
    p = joint_p(conditional_p(calibrate(near, math.log2(reach), "sigma"), "sigma"), n)
    edges = p.select("i", "j", "p", F.lit(0.0).alias("gap"))
    return lay_out(start, edges, steps, StudentStep(max(n / factor / 4.0, 50.0) if lr is None else lr, early, factor))


def curve(min_dist: float = 0.1, scale: float = 1.0) -> tuple[float, float]:
    """(a, b) with 1 / (1 + a x^2b) nearest, by least squares on 300 points, to 1 up to ``min_dist`` and an exponential from there."""
    x = np.linspace(0.0, 3.0 * scale, 300)[1:]
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / scale))
    at, damp = np.zeros(2), 1e-3  # logarithms of a and b

    def miss(q):
        power = x ** (2.0 * math.exp(q[1]))
        return 1.0 / (1.0 + math.exp(q[0]) * power) - want, power

    err, power = miss(at)
    for _ in range(200):
        top = -math.exp(at[0]) * power / (1.0 + math.exp(at[0]) * power) ** 2
        j = np.column_stack([top, top * 2.0 * math.exp(at[1]) * np.log(x)])
        hessian = j.T @ j
        move = np.linalg.solve(hessian + damp * np.diag(np.diag(hessian)), j.T @ err)
        new, new_power = miss(at - move)
        if new @ new < err @ err:
            at, err, power, damp = at - move, new, new_power, damp / 3.0
            if np.abs(move).max() < 1e-10:
                break
        elif damp > 1e12:
            break
        else:
            damp *= 4.0
    return math.exp(at[0]), math.exp(at[1])


def umap(e: DataFrame, n_neighbors: int = 15, min_dist: float = 0.1, epochs: int | None = None, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """``id, proj``: the UMAP layout of E, and the attraction's share of the loss at the end of each span.

    The fuzzy graph of ``n_neighbors`` rows with the row itself among them; edges too light for one
    draw in all epochs go. It starts from principal components within 10 of the middle.
    """
    from oosgauge.operators.fuzzy import default_epochs, epochs_per_sample, fuzzy_graph, prune_edges
    from oosgauge.operators.knn import knn

    n = e.count()
    start = _principal(e, 10.0, True) if n > 1 else e.select("id", F.array(F.lit(0.0), F.lit(0.0)).alias("proj"))
    if n <= 2:
        return start, []
    epochs = default_epochs(n) if epochs is None else epochs
    k = min(n_neighbors, n)
    graph = fuzzy_graph(knn(e, k, include_self=True), k)
    drawn = epochs_per_sample(prune_edges(graph, epochs), epochs).select("i", "j", F.col("w").alias("p"), F.col("eps").alias("gap"))
    step = SampledStep(epochs, *curve(min_dist), seed=seed)
    return lay_out(start, drawn, epochs * step.rounds, step)
