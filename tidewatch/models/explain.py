"""Signed contributions per alert and feature for a tree ensemble.

The contributions are the Shapley values of the path-dependent game: a feature outside the coalition follows both
branches by their training share. They add up to the margin minus its expected value.

A leaf's share of the game only depends on the features of its path. Its weights per coalition size are kept as a vector that
grows with each feature of the path; a feature's contribution follows from the vector with that feature taken out again. Rows
that meet the conditions of the same features of a path share all this, so it is worked out per pattern and looked up per row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewatch.models.trees import Ensemble, matrix, pack
from tidewatch.operators.ranking import top_k


@dataclass(frozen=True)
class Path:
    """A leaf: its value, the different features on the way with the training share that stays on it, and their conditions.

    All conditions of a feature come to one interval: a row stays if ``low`` is met and ``high`` is not passed."""

    value: float
    features: np.ndarray
    share: np.ndarray
    low: np.ndarray
    high: np.ndarray


def leaf_paths(trees: list[dict[str, np.ndarray]]) -> list[Path]:
    out = []
    for t in trees:
        todo = [(0, {})]
        while todo:
            at, path = todo.pop()
            f = int(t["feature"][at])
            if f < 0:
                names = sorted(path)
                out.append(Path(float(t["value"][at]), np.array(names, int), *(np.array([path[j][k] for j in names]) for k in range(3))))
                continue
            share, low, high = path.get(f, (1.0, -np.inf, np.inf))
            cut, cover = float(t["threshold"][at]), float(t["cover"][at])
            for child, bounds in ((t["left"][at], (low, min(high, cut))), (t["right"][at], (max(low, cut), high))):
                part = float(t["cover"][child]) / cover if cover else 0.0
                todo.append((child, {**path, f: (share * part, *bounds)}))
    return out


def _pattern(path: Path, columns: np.ndarray, strict: bool) -> np.ndarray:
    """Per row (of features × rows) one bit for each feature of the path: 1 where the row meets all conditions of the feature.
    NaN goes right at every node."""
    code = np.zeros(columns.shape[1], np.int64)
    for k, (f, low, high) in enumerate(zip(path.features, path.low, path.high)):
        v = columns[f]
        met = np.ones(len(v), bool)
        if not np.isneginf(low):
            met &= ~(v < low) if strict else ~(v <= low)
        if not np.isposinf(high):
            met &= (v < high) if strict else (v <= high)
        code |= met.astype(np.int64) << k
    return code


def _extend(weights: np.ndarray, share: float, follows: np.ndarray) -> np.ndarray:
    """Weights per coalition size (sizes × rows) with one more feature."""
    n = len(weights)
    sizes = np.arange(n)[:, None]
    out = np.zeros((n + 1, weights.shape[1]))
    out[:-1] = share * weights * (n - sizes) / (n + 1)
    out[1:] += follows * weights * (sizes + 1) / (n + 1)
    return out


def _sum_without(weights: np.ndarray, share: float, follows: np.ndarray) -> np.ndarray:
    """Sum of the weights with one feature taken out again. A feature that a row meets is undone from the largest coalition
    down; one that it does not meet only shrank the weights by its share."""
    n = len(weights) - 1
    carried, met = weights[n], np.zeros(weights.shape[1])
    for i in range(n - 1, -1, -1):
        one = carried * (n + 1) / (i + 1)
        met += one
        carried = weights[i] - one * share * (n - i) / (n + 1)
    if share > 0:
        left_out = (weights[:n] * (n + 1) / (share * (n - np.arange(n))[:, None])).sum(axis=0)
    else:
        left_out = np.zeros_like(met)          # no training row stays on the path: such a row gives it no weight either way
    return np.where(follows > 0, met, left_out)


def _shares(path: Path, patterns: np.ndarray) -> np.ndarray:
    """Features of the path × patterns: contribution of each feature to rows with these bits."""
    d = len(path.features)
    follows = (patterns >> np.arange(d)[:, None] & 1).astype(np.float64)
    weights = np.ones((1, len(patterns)))
    for k in range(d):
        weights = _extend(weights, path.share[k], follows[k])
    return np.stack([_sum_without(weights, path.share[k], follows[k]) * (follows[k] - path.share[k]) * path.value for k in range(d)])


#: Paths of up to so many features get a table of all their patterns; longer ones only of those that the rows have.
TABLE = 10


def contributions(paths: Sequence[Path], x: np.ndarray, strict: bool) -> np.ndarray:
    """Rows × features. What a path gives a row depends on the row's pattern only, so it is worked out once per pattern."""
    columns = np.ascontiguousarray(x.T)
    phi = np.zeros_like(columns)
    for path in paths:
        d = len(path.features)
        if not d:
            continue
        code = _pattern(path, columns, strict)
        if d <= TABLE:
            shares = _shares(path, np.arange(1 << d))
        else:
            patterns, code = np.unique(code, return_inverse=True)
            shares = _shares(path, patterns)
        for k in range(d):
            phi[path.features[k]] += shares[k].take(code)
    return phi.T


def base_value(ens: Ensemble) -> float:
    """Expected margin of the ensemble over its training rows."""
    return ens.base + sum(p.value * float(np.prod(p.share)) for p in leaf_paths(pack(ens)))


def explain_trees(alerts: DataFrame, ens: Ensemble, ids: Sequence[str]) -> DataFrame:
    """Long rows (ids, feature, raw_value, contribution) for every alert; contributions are in margin units.

    Only the features go through Python; the node table (trees × nodes) is broadcast."""
    shared = alerts.sparkSession.sparkContext.broadcast(leaf_paths(pack(ens)))
    features, strict = list(ens.features), ens.strict

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def explain(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            phi = contributions(shared.value, matrix(columns), strict)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(phi) + 1) * len(features), pa.int32()), pa.array(phi.ravel()))

    values = [F.col(f).cast("double") for f in features]
    rows = alerts.select(*ids, F.array(*values).alias("_x"), explain(*values).alias("_phi"))
    named = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("_x").alias("raw_value"), F.col("_phi").alias("contribution"))
    return rows.select(*ids, F.inline(named))


def top_contributions(contributions: DataFrame, ids: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` largest contributions by absolute value per id, with direction and rank."""
    out = top_k(contributions, ids, [F.abs("contribution").desc(), F.col("feature")], k)
    return out.withColumn("direction", F.when(F.col("contribution") > 0, "attack").otherwise("benign"))
