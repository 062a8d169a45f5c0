"""Toxicity scores from a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of the normalised text. The log-count ratio of a feature compares its share
among toxic and other training texts; features are its multiples, and logistic regression learns one weight for each. Both labels weigh
the same in the fit, so a score of 0.5 means equal odds under equal shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import LOWER, NOT_WORD, prefix_hash, slices, span_hash, spare_name, stage

GRAMS = (4, 5, 6)
BITS = 18
#: Text bytes whose n-grams are held at a time (about 130 bytes of arrays for each; a longer text comes alone).
SLICE = 1 << 18
_CLEAN = np.where(NOT_WORD, 32, LOWER).astype(np.uint8)


@dataclass(frozen=True)
class Model:
    """Weight of each hashed n-gram (regression weight × log-count ratio; 2^18 numbers) and the intercept."""

    weights: np.ndarray
    intercept: float


def grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram, one pair of arrays for each n. Letters A-Z are lowered, runs of ASCII bytes other
    than letters and digits count as one space, and each text starts and ends with a space."""
    clean = _CLEAN[data]
    lens = np.diff(off)
    # a space before and after each row
    at = np.arange(len(clean)) + 2 * np.repeat(np.arange(len(lens)), lens) + 1
    padded = np.full(len(clean) + 2 * len(lens), 32, np.uint8)
    padded[at] = clean
    row = np.repeat(np.arange(len(lens)), lens + 2)
    blank = padded == 32
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
    padded, row = padded[keep], row[keep]
    pre = prefix_hash(padded)
    for n in GRAMS:
        start = np.flatnonzero(row[n - 1:] == row[:len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
        yield row[start], (span_hash(pre, start, start + n) >> np.uint64(64 - BITS)).astype(np.int64)


def present(data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs, of the buckets marked in ``wanted`` only."""
    found = []
    for row, bucket in grams(data, off):
        if wanted is not None:
            hit = wanted[bucket]
            row, bucket = row[hit], bucket[hit]
        found.append(np.unique((row << BITS) | bucket))
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def training_rows(docs: DataFrame, labels: DataFrame, use: Column, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled ids, half of them of each label where there are as many, in order of a hash."""
    rows = labels.filter(use & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    picked = [rows.filter(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(max_rows // 2) for y in (0, 1)]
    return picked[0].unionByName(picked[1])


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_rows: int = 16_000, n_features: int = 4_096, reg: float = 1e-3) -> Model:
    """Fit on labelled rows (``use`` selects those that may be learnt from).

    ``max_rows`` bounds the labelled rows read, ``n_features`` the n-grams kept (the strongest log-count ratios in units
    of their standard error). Null labels are ignored; of several labels of one id the larger counts. With one label only
    or none, the model is a constant: the share of toxic rows (0.5 without rows).
    """
    use = F.lit(True) if use is None else use
    picked = stage(training_rows(docs, labels, use, id_col, label_col, max_rows), "labelled")
    count = {r.y: r.n for r in picked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(1 << BITS)
    if len(count) < 2:
        return Model(none, 0.0 if not count else 20.0 if 1 in count else -20.0)
    # at most max_rows ids of a few bytes, so the texts need not move
    text = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(picked), id_col).select("y", "text")
    text = stage(text, "labelled-text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for batch, data, off in slices(batches, "text", SLICE):
            row, bucket = present(data, off)
            y = np.asarray(batch.column(0)).astype(np.int64)
            for k in (0, 1):
                seen[k] += np.bincount(bucket[y[row] == k], minlength=1 << BITS)
        at = np.flatnonzero(seen.sum(0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0][at]), pa.array(seen[1][at])], ["bucket", "n0", "n1"])

    counts = (text.repartition(16).mapInArrow(tally, "bucket bigint, n0 bigint, n1 bigint")
              .groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    share = lambda n, k: (F.col(n) + 1) / F.lit(count[k] + 2)                              # noqa: E731
    ratio = F.log(share("n1", 1) / share("n0", 0))
    ratios = counts.select("bucket", ratio.alias("r"), F.abs(ratio * F.sqrt(1 / (1 / (F.col("n0") + 1) + 1 / (F.col("n1") + 1)))).alias("z"))
    best = ratios.orderBy(F.desc("z"), "bucket").limit(n_features).collect()                # n_features rows
    place = {r.bucket: i for i, r in enumerate(best)}
    r = np.array([x.r for x in best])
    wanted = np.zeros(1 << BITS, bool)
    wanted[list(place)] = True
    slot = np.full(1 << BITS, -1, np.int64)
    slot[list(place)] = np.arange(len(place))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in slices(batches, "text", SLICE):
            row, bucket = present(data, off, wanted)
            order = np.lexsort((slot[bucket], row))
            row, at = row[order], slot[bucket][order].astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at))], ["label", "at"])

    size = len(best)
    vector = F.udf(lambda at: Vectors.sparse(size, at, r[at].tolist()), VectorUDT())
    rows = stage(text.mapInArrow(features, "label double, at array<int>"), "features").select("label", vector("at").alias("features"))
    each = {y: (count[0] + count[1]) / (2 * n) for y, n in count.items()}                  # both labels weigh the same
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, each[1]).otherwise(each[0]))
    lr = LogisticRegression(regParam=reg, maxIter=60, standardization=False, aggregationDepth=2, weightCol="weight").fit(rows)
    w = np.zeros(1 << BITS)
    w[list(place)] = lr.coefficients.toArray() * r
    return Model(w, float(lr.intercept))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability ``out`` of being toxic; null and empty texts score as a text without n-grams but its
    spaces. A column of that name is replaced."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((model.weights, model.weights != 0, model.intercept))

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        weights, wanted, intercept = shipped.value
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        total = [np.zeros(0)]
        for part, data, off in slices(iter([batch]), "text", SLICE):
            row, bucket = present(data, off, wanted)
            total.append(np.bincount(row, weights[bucket], part.num_rows))
        return pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(total) + intercept, -60, 60))))

    return docs.withColumn(out, run(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` that score below ``threshold``; all columns pass through."""
    out = spare_name(docs, "_toxic")
    return score(docs, model, text_col, out).filter(F.col(out) < threshold).select(*docs.columns)
