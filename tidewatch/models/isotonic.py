"""Monotone calibration by pooling adjacent violators, range by range.

Scores are cut into ranges. Each range pools its distinct scores on its own; then only neighbouring blocks at the edge of two
ranges can still be out of order. Ranges whose edge is out of order are put together and pooled again, from their blocks,
until no edge is. Blocks pooled early are parts of the final ones, so the order of pooling does not change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.session import drop_folder, new_folder

_BLOCK = "part int, lo double, hi double, total double, n bigint"


def _pool(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one range; the rows of a range are blocks already."""
    t = pa.Table.from_batches(list(batches)).sort_by("lo")
    blocks: list[list] = []
    for lo, hi, total, n in zip(*(t.column(c).to_pylist() for c in ("lo", "hi", "total", "n"))):
        blocks.append([lo, hi, total, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, total, n = blocks.pop()
            blocks[-1][1:] = [hi, blocks[-1][2] + total, blocks[-1][3] + n]
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(blocks), pa.int32()), *(pa.array([b[k] for b in blocks], kind) for k, kind in enumerate(
        (pa.float64(), pa.float64(), pa.float64(), pa.int64())))], ["part", "lo", "hi", "total", "n"])


def _written(df: DataFrame, before: list[str]) -> DataFrame:
    spark, path = df.sparkSession, new_folder(df.sparkSession, "isotonic")
    df.write.parquet(path)
    while before:
        drop_folder(spark, before.pop())
    before.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _range(score, cuts: list[float]):
    """Number of the range of a score."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= score)).cast("int") if cuts else F.lit(0)


def fit_isotonic(scored: DataFrame, score: str = "score", label: str = "is_attack", ranges: int = 64) -> DataFrame:
    """Blocks (lo, hi, value, n) of the monotone fit of the mean label; rows without score or label are left out.

    ``ranges`` tasks pool side by side; at most that many edges are looked at on the driver."""
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    per = scored.filter(s.isNotNull() & ~F.isnan(s) & y.isNotNull()).groupBy(s.alias("lo")).agg(F.sum(y).alias("total"), F.count("*").alias("n"))
    made: list[str] = []
    per = _written(per, made)
    distinct = made.pop()
    cuts = sorted(set(per.agg(F.percentile_approx("lo", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []))
    blocks = per.select(_range(F.col("lo"), cuts).alias("part"), "lo", F.col("lo").alias("hi"), "total", "n")
    while True:
        blocks = _written(blocks.groupBy("part").applyInArrow(_pool, _BLOCK), made)
        mean = F.col("total") / F.col("n")
        edge = blocks.groupBy("part").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last")).orderBy("part").collect()
        joined, into = {}, None
        for left, right in zip([None, *edge], edge):
            into = into if left is not None and left["last"] >= right["first"] else right["part"]
            joined[right["part"]] = into
        if all(k == v for k, v in joined.items()):
            break
        part = F.create_map(*[F.lit(x).cast("int") for kv in joined.items() for x in kv])[F.col("part")]
        blocks = blocks.withColumn("part", part)
    drop_folder(scored.sparkSession, distinct)
    return blocks.select("lo", "hi", (F.col("total") / F.col("n")).alias("value"), "n")


def apply_isotonic(df: DataFrame, blocks: DataFrame, score: str = "score", column: str = "calibrated", ranges: int = 64) -> DataFrame:
    """Value of the block of each score; between two blocks on the straight line, beyond the ends the end value, null for null.

    Distinct scores and blocks meet range by range; a range also gets the nearest block on either side, so no range waits for another."""
    spark, made = df.sparkSession, []
    wanted = _written(df.select(F.col(score).cast("double").alias("s")).filter("s IS NOT NULL AND NOT isnan(s)").distinct(), made)
    cuts = sorted(set(wanted.agg(F.percentile_approx("s", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []))
    held = _written(blocks.select("lo", "hi", "value", _range(F.col("lo"), cuts).alias("a"), _range(F.col("hi"), cuts).alias("b")), [])
    # the last block that starts in or before each range, and the first that ends in or after it: at most two per range
    ends = held.groupBy("a").agg(F.max_by(F.struct("lo", "hi", "value"), "lo").alias("last")).collect(), held.groupBy("b").agg(
        F.min_by(F.struct("lo", "hi", "value"), "hi").alias("first")).collect()
    near = []
    for r in range(len(cuts) + 1):
        before = [x["last"] for x in ends[0] if x["a"] < r]
        after = [x["first"] for x in ends[1] if x["b"] > r]
        near += [(r, *max(before))] if before else []
        near += [(r, *min(after, key=lambda x: x["hi"]))] if after else []
    inside = held.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("r"), "lo", "hi", "value")
    every = inside.unionByName(spark.createDataFrame(near, "r int, lo double, hi double, value double")).distinct()

    def look(scores: pa.Table, some: pa.Table) -> pa.Table:
        b, s = some.sort_by("lo"), scores.column("s").to_numpy()
        lo, hi, value = (b.column(c).to_numpy() for c in ("lo", "hi", "value"))
        found = np.interp(s, np.column_stack([lo, hi]).ravel(), np.repeat(value, 2)) if len(lo) else np.full(len(s), np.nan)
        return pa.table({"s": pa.array(s), "v": pa.array(found, mask=np.isnan(found))})

    table = wanted.withColumn("r", _range(F.col("s"), cuts)).groupBy("r").cogroup(every.groupBy("r")).applyInArrow(look, "s double, v double")
    found = _written(table, made).select(F.col("s").alias("_iso_score"), F.col("v").alias("_iso_value"))
    return (df.drop(column).join(found, F.col(score).cast("double") == F.col("_iso_score"), "left")
            .withColumn(column, F.col("_iso_value")).drop("_iso_score", "_iso_value"))


def calibrate_isotonic(scored: DataFrame, score: str = "score", label: str = "is_attack", column: str = "calibrated") -> DataFrame:
    """Scores with their monotone calibration, fitted to the same rows."""
    return apply_isotonic(scored, fit_isotonic(scored, score, label), score, column)
