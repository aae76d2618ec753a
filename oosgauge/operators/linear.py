"""Linear projections: distributed covariance, driver eigenvectors of d x d, JVM or Arrow scoring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oosgauge.operators import blocks as B
from oosgauge.operators.prep import dimension_stats
from oosgauge.session import ship

MAX_COVARIANCE_DIMS = 4096


def map_vectors(df: DataFrame, vec: str, fn: Callable[[np.ndarray], np.ndarray], out: str = "proj") -> DataFrame:
    """Add (or replace) vector column ``out`` = fn(batch matrix); other columns pass through."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    need = keep if vec in keep else [*keep, vec]

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            m = B.decode(pa.table({"v": pa.chunked_array([batch.column(vec)])}))["v"]
            y = np.ascontiguousarray(fn(m), dtype=float)
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            col = pa.ListArray.from_arrays(offsets, pa.array(y.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [col], [*keep, out])

    return df.select(*need).mapInArrow(run, schema)


def sum_rows(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], vec: str, rows: int) -> np.ndarray:
    """Sum over all batches of a (rows x m) matrix ``fn(batch)``; one partial per partition."""

    ship(df.sparkSession)

    def run(batches):
        acc = None
        for batch in batches:
            if batch.num_rows:
                m = fn(B.decode(pa.table({"v": pa.chunked_array([batch.column(0)])}))["v"])
                acc = m if acc is None else acc + m
        if acc is not None:
            offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * acc.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(acc).reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), lists], ["r", "g"])

    partial = df.select(vec).mapInArrow(run, "r int, g array<double>")
    # one reducer row per matrix row, so no task receives every partial matrix
    total = partial.groupBy("r").agg(Summarizer.sum(array_to_vector("g")).alias("s"))
    got = {x["r"]: x["s"] for x in total.select("r", vector_to_array("s").alias("s")).collect()}
    return np.array([got[r] for r in range(rows)])


@dataclass(frozen=True)
class LinearModel:
    mean: np.ndarray
    components: np.ndarray  # d x k
    variance: np.ndarray
    total_variance: float

    def project(self, df: DataFrame, vec: str = "features", out: str = "proj") -> DataFrame:
        mean, comp = self.mean, self.components
        return map_vectors(df, vec, lambda m: (m - mean) @ comp, out)


def orient(components: np.ndarray) -> np.ndarray:
    """Flip each column so its largest-magnitude entry is positive."""
    peak = components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])]
    return components * np.where(peak < 0, -1.0, 1.0)


def _centre(df: DataFrame, vec: str) -> tuple[int, np.ndarray]:
    stats = dimension_stats(df, vec).collect()
    if not stats:
        raise ValueError("no rows to fit")
    mean = np.array([r["mean"] for r in sorted(stats, key=lambda r: r["dim"])])
    return df.count(), mean


def covariance(df: DataFrame, vec: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and sample covariance."""
    n, mean = _centre(df, vec)
    if len(mean) > MAX_COVARIANCE_DIMS:
        raise ValueError(f"{len(mean)} dimensions need the subspace route, not a full covariance")
    gram = sum_rows(df, lambda m: (m - mean).T @ (m - mean), vec, len(mean))
    return n, mean, gram / max(n - 1, 1)


def fit_pca(df: DataFrame, k: int = 2, vec: str = "features") -> LinearModel:
    """Centred principal components, eigenvalues descending."""
    n, mean = _centre(df, vec)
    d = len(mean)
    if d <= MAX_COVARIANCE_DIMS:
        cov = sum_rows(df, lambda m: (m - mean).T @ (m - mean), vec, d) / max(n - 1, 1)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1]
        return LinearModel(mean, orient(vectors[:, order[:k]]), values[order[:k]], float(np.trace(cov)))
    return _fit_subspace(df, k, vec, n, mean)


def _fit_subspace(df: DataFrame, k: int, vec: str, n: int, mean: np.ndarray, rounds: int = 2000, tol: float = 1e-8) -> LinearModel:
    """Block power iteration for very wide vectors: only d x (k + 8) numbers move per round.

    It ends when the residuals of the k vectors are under ``tol`` of the largest value.
    """
    d = len(mean)
    width = min(d, k + 8)
    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((d, width)))
    for _ in range(rounds):
        basis = q
        w = sum_rows(df, lambda m: (m - mean).T @ ((m - mean) @ basis), vec, d) / max(n - 1, 1)
        values, rot = np.linalg.eigh(basis.T @ w)
        order = np.argsort(values)[::-1]
        vectors, values = basis @ rot[:, order], values[order]
        if np.linalg.norm(w @ rot[:, order[:k]] - vectors[:, :k] * values[:k], axis=0).max() <= tol * max(values[0], 1e-300):
            break
        q, _ = np.linalg.qr(w)
    else:
        raise RuntimeError(f"components not converged after {rounds} rounds")
    spread = sum_rows(df, lambda m: np.array([[((m - mean) ** 2).sum()]]), vec, 1)
    return LinearModel(mean, orient(vectors[:, :k]), values[:k], float(spread[0, 0]) / max(n - 1, 1))


def fit_oos_mds(df: DataFrame, k: int = 2, vec: str = "features") -> LinearModel:
    """Classical MDS with its kernel extension to new rows.

    For Euclidean input the double-centred kernel is the centred inner product,
    so both the stored embedding and the extension are principal-component
    scores: no n x n matrix is formed.
    """
    return fit_pca(df, k, vec)


def intrinsic_dims(df: DataFrame, ratio: float = 0.95, vec: str = "features") -> int:
    """First number of components whose cumulative explained variance reaches ``ratio``."""
    _, _, cov = covariance(df, vec)
    values = np.sort(np.maximum(np.linalg.eigvalsh(cov), 0.0))[::-1]
    share = np.cumsum(values) / values.sum()
    return int(np.nonzero(share >= ratio - 1e-12)[0][0]) + 1


def principal_reduce(df: DataFrame, target: int = 16, vec: str = "features") -> DataFrame:
    """Vectors of at most ``target`` dimensions: unchanged when short, else leading scores."""
    width = df.select(F.max(F.size(vec)).alias("w")).first()["w"]
    if width <= target:
        return df
    return fit_pca(df, target, vec).project(df, vec, vec)
