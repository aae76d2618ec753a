"""Column builders over ``array<double>`` vectors, and the registries that name them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def squared_euclidean(a, b) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a, b, floor: float = 0.0) -> Column:
    """Distance; values below ``floor`` become 0."""
    d = F.sqrt(squared_euclidean(a, b))
    return F.when(d < F.lit(floor), F.lit(0.0)).otherwise(d) if floor > 0 else d


def jaccard(a, b) -> Column:
    """1 - shared ones over ones in either, for 0/1 vectors; two empty vectors give null."""
    both = dot(a, b)
    return F.lit(1.0) - F.try_divide(both, total(_col(a)) + total(_col(b)) - both)


def jaccard_general(a, b) -> Column:
    """1 - sum of minima over sum of maxima, for real vectors."""
    a, b = _col(a), _col(b)
    low = total(F.zip_with(a, b, lambda x, y: F.least(x, y)))
    high = total(F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return F.lit(1.0) - F.try_divide(low, high)


def cosine_similarity(a, b, floor: float = 1e-7) -> Column:
    return F.greatest(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(floor))


def squared_cosine_distance(a, b) -> Column:
    gap = F.lit(1.0) - cosine_similarity(a, b)
    return gap * gap


def student_t(d: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + d * d)


def exp_similarity(d: Column) -> Column:
    return F.exp(-(d * d))


def umap_similarity(d: Column, a: float, b: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.lit(a) * F.pow(d, F.lit(2.0 * b)))


def _squared(f: Callable) -> Callable:
    def apply(a, b) -> Column:
        v = f(a, b)
        return v * v

    return apply


#: name -> pair distance used by the affinity operators
DISTANCES: dict[str, Callable[..., Column]] = {
    "euc": squared_euclidean,
    "jaccard": _squared(jaccard),
    "jaccard_general": _squared(jaccard_general),
    "cosine": squared_cosine_distance,
}

#: Curve parameters of the low-dimensional kernel for min_dist 0.1, spread 1 (fixed values)
UMAP_A, UMAP_B = 1.5769434603113077, 0.8950608779109733

#: name -> similarity of two vectors
SIMILARITIES: dict[str, Callable[..., Column]] = {
    "umap": lambda a, b: umap_similarity(euclidean(a, b), UMAP_A, UMAP_B),
    "tsne": lambda a, b: student_t(euclidean(a, b)),
    "exp": lambda a, b: exp_similarity(euclidean(a, b)),
    "cosine": cosine_similarity,
}


def distance_function(name: str) -> Callable[..., Column]:
    if name not in DISTANCES:
        raise ValueError(f"unknown distance {name!r}")
    return DISTANCES[name]


def similarity_function(name: str) -> Callable[..., Column]:
    if name not in SIMILARITIES:
        raise ValueError(f"unknown similarity {name!r}")
    return SIMILARITIES[name]
