"""Feed-forward networks: data-parallel training and scoring of frozen weights.

Fitting runs in barrier stages (``training``); scoring is a map over rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oosgauge.operators import training as T
from oosgauge.operators.linear import map_vectors
from oosgauge.operators.prep import minmax_scale, standard_scale

#: name -> (function, derivative from the output)
ACTIVATIONS = {
    "linear": (lambda z: z, lambda a: np.ones_like(a)),
    "tanh": (np.tanh, lambda a: 1.0 - a * a),
    "sigmoid": (lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))), lambda a: a * (1.0 - a)),
    "relu": (lambda z: np.maximum(z, 0.0), lambda a: (a > 0).astype(float)),
    "lrelu": (lambda z: np.where(z > 0, z, 0.01 * z), lambda a: np.where(a > 0, 1.0, 0.01)),
    "softplus": (lambda z: np.logaddexp(0.0, z), lambda a: 1.0 - np.exp(-a)),
}


@dataclass
class Layer:
    weight: np.ndarray  # in x out
    bias: np.ndarray
    activation: str = "linear"
    norm: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None  # scale, shift, mean, variance

    def forward(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weight + self.bias
        if self.norm is not None:
            scale, shift, mean, var = self.norm
            z = (z - mean) / np.sqrt(var + 1e-5) * scale + shift
        return ACTIVATIONS[self.activation][0](z)


def run_layers(layers: list[Layer], x: np.ndarray) -> list[np.ndarray]:
    out = [x]
    for layer in layers:
        out.append(layer.forward(out[-1]))
    return out


def mlp_score(df: DataFrame, layers: list[Layer], vec: str = "features", out: str = "proj") -> DataFrame:
    """Project rows through frozen layers; works on batch and streaming tables."""
    shared = df.sparkSession.sparkContext.broadcast(layers)
    return map_vectors(df, vec, lambda m: run_layers(shared.value, m)[-1], out)


def init_layers(sizes: list[int], activations: list[str], how: str, seed: int) -> list[Layer]:
    """``he``: uniform by fan-in with bias 1e-4; ``fan``: uniform within 1/sqrt(fan-in)."""
    rng = np.random.default_rng(seed)
    layers = []
    for i, o, a in zip(sizes, sizes[1:], activations):
        limit = np.sqrt(6.0 / i) if how == "he" else 1.0 / np.sqrt(i)
        w = rng.uniform(-limit, limit, (i, o))
        b = np.full(o, 1e-4) if how == "he" else rng.uniform(-limit, limit, o)
        layers.append(Layer(w, b, a))
    return layers


def gradients(layers: list[Layer], x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], float]:
    """Summed gradients and summed squared error of a batch."""
    outs = run_layers(layers, x)
    err = outs[-1] - y
    grads: list = [None] * len(layers)
    back = 2.0 * err
    for i in range(len(layers) - 1, -1, -1):
        back = back * ACTIVATIONS[layers[i].activation][1](outs[i + 1])
        grads[i] = (outs[i].T @ back, back.sum(axis=0))
        back = back @ layers[i].weight.T
    return grads, float((err * err).sum())


@dataclass
class Trainer:
    """Mean-squared-error training with Adam in barrier stages."""

    layers: list[Layer]
    lr: float = 1e-3
    losses: list[float] = field(default_factory=list)

    def fit(
        self, pairs: DataFrame, epochs: int, batches: int = 1, validation: float = 0.0, patience: int = 10,
        min_delta: float = 1e-5, seed: int = 13,
    ) -> Trainer:
        """``pairs``: ``id, x, y``. ``batches`` steps per epoch, rows dealt anew each epoch.

        With a ``validation`` share, training stops after ``patience`` epochs
        without gain and the best weights are restored.
        """
        plan = T.Plan(epochs, self.lr, batches, validation=validation, patience=patience, min_delta=min_delta, seed=seed)
        self.losses += T.train(pairs.select("id", F.concat("x", "y").alias("z")), self.layers, T.SquaredError(), plan)
        return self


# --- methods ----------------------------------------------------------------


@dataclass
class RegressedProjection:
    """Network regressing scaled vectors onto a min-max-scaled target embedding."""

    epochs: int = 1000
    lr: float = 1e-3
    batches: int = 10
    hidden: tuple[int, ...] = (256, 512, 256)
    seed: int = 0

    def fit(self, e: DataFrame, target: DataFrame) -> RegressedProjection:
        """``target`` holds ``id, proj``."""
        self.e = e
        (scaled,) = standard_scale(e)
        (goal,) = minmax_scale(target.select("id", "proj"), vec="proj")
        self.target = goal
        pairs = scaled.select("id", F.col("features").alias("x")).join(goal.select("id", F.col("proj").alias("y")), "id")
        width = int(e.select(F.max(F.size("features"))).first()[0])
        layers = init_layers([width, *self.hidden, 2], ["relu"] * len(self.hidden) + ["sigmoid"], "he", self.seed)
        self.trainer = Trainer(layers, self.lr).fit(pairs, self.epochs, self.batches, validation=0.05)
        return self

    def transform(self) -> DataFrame:
        return self.e.drop("proj").join(self.target, "id")

    def transform_oos(self, o: DataFrame) -> DataFrame:
        (so,) = standard_scale(self.e, o)
        return mlp_score(so, self.trainer.layers)


@dataclass
class AutoEncoder:
    """Projection by the two-number code of an autoencoder trained on full batches."""

    epochs: int = 1000
    lr: float = 1e-3
    hidden: tuple[int, ...] = (256, 64, 16, 2)
    seed: int = 0

    def fit(self, e: DataFrame) -> AutoEncoder:
        self.e = e
        (scaled,) = standard_scale(e)
        width = int(e.select(F.max(F.size("features"))).first()[0])
        h = list(self.hidden)
        sizes = [width, *h, *h[-2::-1], width]
        acts = ["tanh", "tanh"] + ["linear"] * (len(h) - 2) + ["tanh"] * (len(h) - 1) + ["sigmoid"]
        pairs = scaled.select("id", F.col("features").alias("x"), F.col("features").alias("y"))
        self.trainer = Trainer(init_layers(sizes, acts, "fan", self.seed), self.lr).fit(pairs, self.epochs)
        return self

    def _code(self, df: DataFrame) -> DataFrame:
        (scaled,) = standard_scale(self.e, df)
        return mlp_score(scaled, self.trainer.layers[: len(self.hidden)])

    def transform(self) -> DataFrame:
        return self._code(self.e)

    def transform_oos(self, o: DataFrame) -> DataFrame:
        return self._code(o)


@dataclass
class ParametricTSNE:
    """Network whose outputs keep the neighbourhoods of each batch: KL between Gaussian and Student kernels.

    Precisions come from each row's distances to all rows, at the perplexity. Batches are a tenth
    of the rows, at most ``most_rows``, whose square a task holds.
    """

    perplexity: float = 30.0
    epochs: int = 1000
    lr: float = 1e-3
    hidden: tuple[int, ...] = (500, 500, 2000)
    alpha: float = 1.0
    most_rows: int = 2048
    seed: int = 42

    def fit(self, e: DataFrame) -> ParametricTSNE:
        from oosgauge.operators.affinity import calibrate_rows

        self.e = e
        (scaled,) = standard_scale(e)
        scaled = scaled.select("id", "features")
        beta = calibrate_rows(scaled, self.perplexity, "beta").select("id", "param")
        rows = scaled.join(beta, "id").select("id", F.concat("features", F.array("param")).alias("z"))
        n, width = scaled.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
        self.layers = _glorot([width, *self.hidden, 2], ["sigmoid"] * len(self.hidden) + ["linear"], self.seed)
        plan = T.Plan(self.epochs, self.lr, batch_rows=_tenth(n, self.most_rows), seed=self.seed)
        self.losses = T.train(rows, self.layers, T.BatchKL(self.alpha), plan)
        return self

    def transform(self) -> DataFrame:
        return self.transform_oos(self.e)

    def transform_oos(self, o: DataFrame) -> DataFrame:
        (x,) = standard_scale(self.e, o)
        return mlp_score(x, self.layers)


@dataclass
class NeighbourTSNE:
    """Network trained on the joint neighbour probabilities of all rows; outputs are scaled to 0..1 by their own extremes."""

    perplexity: float = 30.0
    epochs: int = 1000
    lr: float = 1e-3
    hidden: tuple[int, ...] = (1024, 512, 256, 128)
    most_rows: int = 2048
    seed: int = 42

    def fit(self, e: DataFrame) -> NeighbourTSNE:
        from oosgauge.operators.affinity import calibrate, conditional_p, joint_p
        from oosgauge.operators.knn import knn

        self.e = e
        n, width = e.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
        near = knn(e, max(1, min(n - 1, int(3 * self.perplexity))))
        p = joint_p(conditional_p(calibrate(near, min(self.perplexity, max(1.0, (n - 1) / 3)), "beta")), n)
        links = p.groupBy(F.col("i").alias("id")).agg(F.collect_list(F.struct("j", "p")).alias("near"))
        rows = e.select("id", F.col("features").alias("z")).join(links, "id", "left")
        self.layers = init_layers([width, *self.hidden, 2], ["lrelu"] * len(self.hidden) + ["linear"], "fan", self.seed)
        plan = T.Plan(self.epochs, self.lr, batch_rows=_tenth(n, self.most_rows), seed=self.seed, clip=4.0, lowest_lr=1e-7)
        self.losses = T.train(rows, self.layers, T.SparseKL(), plan)
        return self

    def transform(self) -> DataFrame:
        return self.transform_oos(self.e)

    def transform_oos(self, o: DataFrame) -> DataFrame:
        out = mlp_score(o, self.layers)
        ends = out.agg(F.min(F.array_min("proj")).alias("low"), F.max(F.array_max("proj")).alias("high")).first()
        low, span = ends["low"] or 0.0, (ends["high"] or 0.0) - (ends["low"] or 0.0)
        return out.withColumn("proj", F.transform("proj", lambda x: (x - low) / (span or 1.0)))


def _tenth(n: int, most: int, small: int = 256) -> int:
    return max(1, min(most, n // 10 if n > small else n))


def _glorot(sizes: list[int], activations: list[str], seed: int) -> list[Layer]:
    rng = np.random.default_rng(seed)
    return [Layer(rng.uniform(-1, 1, (i, o)) * np.sqrt(6.0 / (i + o)), np.zeros(o), a) for i, o, a in zip(sizes, sizes[1:], activations)]
