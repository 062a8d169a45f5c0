"""Isolation forest: trees grown in parallel on small samples, scoring over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewatch.models.trees import matrix
from tidewatch.operators.quantiles import exact_percentiles
from tidewatch.operators.ranking import hash_key, smallest_per_group
from tidewatch.session import cut_lineage

NODE = "tree int, node int, left int, right int, feature int, threshold double, length double"


def mean_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Random splits until a node is single, constant or at the depth limit."""
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            p = list(nodes[parent])
            p[1 + side] = at
            nodes[parent] = tuple(p)
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or len(open_features) == 0:
            nodes.append((at, -1, -1, -1, 0.0, depth + float(mean_path(len(rows)))))
            continue
        f = int(rng.choice(open_features))
        cut = rng.uniform(lo[f], hi[f])
        left = x[rows, f] <= cut
        nodes.append((at, -1, -1, f, float(cut), 0.0))
        todo += [(rows[~left], depth + 1, at, 1), (rows[left], depth + 1, at, 0)]
    return nodes


@dataclass(frozen=True)
class IsolationForest:
    features: tuple[str, ...]
    nodes: pd.DataFrame
    sample: int
    threshold: float | None = None
    meta: dict = field(default_factory=dict)


def fit_isolation_forest(df: DataFrame, features: Sequence[str], trees: int = 200, sample: int = 256, key: str = "row_key",
                         seed: int = 42) -> IsolationForest:
    """Grow ``trees`` trees on ``sample`` rows each.

    The pool is the ``trees × sample`` rows with the smallest hash, shuffled by hash and dealt out in blocks; a table
    smaller than that is shuffled and dealt again until every tree has its rows. Pool, groups and node table are
    bounded by these two numbers.
    """
    pool_rows = trees * sample
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], hash_key(key, seed=seed).alias("_h"))
    pool = cut_lineage(smallest_per_group(rows, [], "_h", pool_rows))
    n = pool.count()
    sample = min(sample, n)
    per_pass = n // sample
    passes = -(-trees // per_pass)
    spread = pool.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    order = F.md5(F.concat_ws("|", F.col("_pass").cast("string"), "_h"))
    place = F.row_number().over(W.partitionBy("_pass").orderBy(order)) - 1
    tree = (F.col("_pass") * per_pass + F.floor(F.col("_place") / sample)).cast("int")
    dealt = spread.withColumn("_place", place).filter(F.col("_place") < per_pass * sample).withColumn("tree", tree).filter(
        F.col("tree") < trees)
    names = list(features)
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", *names])
        t = int(pdf["tree"].iloc[0])
        got = _grow(pdf[names].to_numpy(float), limit, np.random.default_rng([seed, t]))
        out = pd.DataFrame(got, columns=["node", "left", "right", "feature", "threshold", "length"])
        return out.assign(tree=t)[["tree", "node", "left", "right", "feature", "threshold", "length"]]

    nodes = dealt.groupBy("tree").applyInPandas(grow, NODE).toPandas()
    return IsolationForest(tuple(names), nodes, sample)


def _full_tree(nodes: pd.DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and threshold per inner place of a full binary tree, and the length per place of its last level. All places below a
    leaf have its length."""
    n = nodes.set_index("node")
    left, right, feature, threshold, length = (n[c].to_dict() for c in ("left", "right", "feature", "threshold", "length"))
    inner = (1 << depth) - 1
    features, cuts, lengths = np.zeros(inner, np.int64), np.full(inner, np.nan), np.zeros(1 << depth)
    todo = [(0, 0, 0)]
    while todo:
        at, node, level = todo.pop()
        if feature[node] >= 0:
            features[at], cuts[at] = feature[node], threshold[node]
            todo += [(2 * at + 1, left[node], level + 1), (2 * at + 2, right[node], level + 1)]
        else:
            first = ((at + 1) << (depth - level)) - 1 - inner
            lengths[first:first + (1 << (depth - level))] = length[node]
    return features, cuts, lengths


#: Rows walked down at a time: few enough for the arrays of a step to stay in the processor's cache.
BLOCK = 8192


def _path_lengths(trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray, depth: int) -> np.ndarray:
    """Sum of the path lengths of each row, in tree order. NaN goes right at every split."""
    columns = np.ascontiguousarray(x.T)
    flat, rows, total = columns.ravel(), np.arange(len(x)), np.zeros(len(x))
    for feature, cut, length in trees:
        offset = feature * len(x)
        at = np.zeros(len(x), np.int64)
        if depth:
            at = 2 - (columns[feature[0]] <= cut[0]).astype(np.int64)
        for _ in range(1, depth):
            left = flat.take(offset.take(at) + rows) <= cut.take(at)
            at += at
            at += 2
            at -= left
        total += length.take(at - len(feature))
    return total


def score_isolation_forest(df: DataFrame, forest: IsolationForest, column: str = "if_score") -> DataFrame:
    """``-2 ** (-mean path / expected path)``: lower is stranger. With a threshold also the anomaly label.

    Only the feature columns go through Python; the node table (trees × nodes) is broadcast."""
    expected = float(mean_path(forest.sample))
    depth = int(np.ceil(np.log2(max(forest.sample, 2))))
    trees = [_full_tree(n, depth) for _, n in forest.nodes.groupby("tree", sort=True)]
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            x = matrix(columns)
            total = np.concatenate([_path_lengths(shared.value, x[at:at + BLOCK], depth) for at in range(0, max(len(x), 1), BLOCK)])
            yield pa.array(-np.exp2(-(total / len(shared.value)) / expected))

    out = df.withColumn(column, run(*[F.col(f).cast("double") for f in forest.features]))
    if forest.threshold is None:
        return out
    odd = F.col(column) < forest.threshold
    return out.withColumns({"is_anomaly": odd, "if_label": F.when(odd, "anomaly_candidate").otherwise("known_pattern")})


def train_anomaly_detector(df: DataFrame, features: Sequence[str], benign: Column, key: str = "row_key", trees: int = 200,
                           sample: int = 256, validation: float = 0.2, max_fpr: float = 0.05, seed: int = 42) -> IsolationForest:
    """Fit on benign rows; threshold = 5th percentile of training scores, the 4th when validation exceeds ``max_fpr``."""
    slot = F.conv(F.substring(hash_key(key, seed=seed + 1), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    rows = df.select(*features, key, benign.alias("_b"), (slot < validation).alias("_v"))
    forest = fit_isolation_forest(rows.filter("_b and not _v"), features, trees, sample, key, seed)
    scored = cut_lineage(score_isolation_forest(rows, forest).select("_b", "_v", "if_score"))
    cuts = {r["prob"]: r["value"] for r in exact_percentiles(
        scored.filter("_b and not _v"), [], ["if_score"], [0.01, 0.04, 0.05, 0.10]).collect()}
    below = lambda p: F.avg((F.col("if_score") < cuts[p]).cast("double"))
    fpr = scored.filter("_b and _v").agg(below(0.05).alias("p5"), below(0.04).alias("p4")).first()
    p = 0.04 if (fpr["p5"] or 0.0) > max_fpr else 0.05
    recall = scored.filter("not _b").agg(below(p).alias("r")).first()["r"]
    meta = {"threshold_p1": cuts[0.01], "threshold_p4": cuts[0.04], "threshold_p5": cuts[0.05], "threshold_p10": cuts[0.10],
            "val_benign_fpr": fpr["p4"] if p == 0.04 else fpr["p5"], "attack_recall": recall}
    return IsolationForest(forest.features, forest.nodes, forest.sample, cuts[p], meta)


def anomaly_fpr(df: DataFrame, forest: IsolationForest, groups: Sequence[str] = ()) -> DataFrame:
    """Share of rows flagged as anomalies (false alarms, on foreign benign rows)."""
    return score_isolation_forest(df, forest).groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_rate"))
