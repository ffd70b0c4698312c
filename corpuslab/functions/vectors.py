"""Vector columns: native expressions, and Arrow functions for the hot paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of the distance choices.
METRICS = {"EUCLIDEAN": "l2", "COSINE": "cosine", "IP": "ip"}
TINY = 1e-12


def metric_of(similarity: str) -> str:
    """l2 is the squared distance, cosine 1 - cos, ip 1 - dot."""
    if similarity not in METRICS:
        raise ValueError(f"similarity method {similarity!r} is not one of {sorted(METRICS)}")
    return METRICS[similarity]


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_doubles(a), lambda x: x * x)))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays zero."""
    length = F.greatest(norm(a), F.lit(TINY))
    return F.transform(as_doubles(a), lambda x: x / length)


def native_distance(a: Column, b: Column, metric: str) -> Column:
    """Row-by-row form, used as the yardstick of the kernels in the tests."""
    if metric == "l2":
        return squared_l2(a, b)
    if metric == "ip":
        return 1.0 - dot(a, b)
    if metric == "cosine":
        return 1.0 - dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-30))
    raise ValueError(metric)


def exact_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of aligned rows. Each row is summed alone, so equal rows give equal
    results wherever they stand in a block."""
    if metric == "l2":
        return ((a - b) ** 2).sum(axis=1)
    products = (a * b).sum(axis=1)
    if metric == "ip":
        return 1.0 - products
    lengths = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return 1.0 - products / np.maximum(lengths, 1e-30)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.zeros((0, 1))


def pair_distance(a: Column, b: Column, metric: str) -> Column:
    """Distance of two vector columns, whole Arrow batches at a time.

    Declared non-deterministic, as all Arrow functions here: Spark then keeps it in one place
    and does not run it again inside a filter on its result.
    """

    @F.pandas_udf("double")
    def distance(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(exact_distances(_matrix(left), _matrix(right), metric))

    return distance.asNondeterministic()(a, b)
