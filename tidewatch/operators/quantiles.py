"""Exact interpolated percentiles that stay bounded for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature",
         value: str = "value") -> DataFrame:
    """Wide → long, all values as double."""
    if len(columns) == 1:
        return df.select(*ids, F.lit(columns[0]).alias(name), F.col(columns[0]).cast("double").alias(value))
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), name, value)


#: Buckets per factor of two, as powers of two: fine ones, and how many of them make up a coarse one.
FINE_BITS, COARSE_BITS = 20, 12


def _bucket(v: Column) -> Column:
    """Order-preserving number of a bucket of constant relative width (2^-20 of a factor of two)."""
    size = F.floor((F.log2(F.abs(v)) + 1100.0) * float(1 << FINE_BITS))
    return F.when(v == 0, F.lit(0)).otherwise(F.when(v < 0, -size).otherwise(size)).cast("bigint")


def exact_percentiles(df: DataFrame, groups: Sequence[str], columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Percentiles with linear interpolation → rows (groups, feature, prob, value); null and NaN are left out.

    Equal values are merged before anything moves. Counts per coarse and per fine bucket of values tell how many values lie
    before each fine bucket; only the fine buckets that hold a wanted rank are looked into. Nothing is counted before the plan
    is made, the source is read once, and no sort group holds more than the values of a fine bucket, the fine buckets of a
    coarse one, or the coarse buckets of a group."""
    long = melt(df, groups, columns).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    keys = [*groups, "feature"]
    values = long.groupBy(*keys, "value").agg(F.count("*").alias("_n")).withColumn("_fine", _bucket(F.col("value"))).withColumn(
        "_coarse", F.shiftright("_fine", COARSE_BITS))
    fine = values.groupBy(*keys, "_coarse", "_fine").agg(F.sum("_n").alias("_n"))
    coarse = fine.groupBy(*keys, "_coarse").agg(F.sum("_n").alias("_m"))
    upto = W.partitionBy(*keys).orderBy("_coarse").rowsBetween(W.unboundedPreceding, 0)
    coarse = coarse.withColumn("_before", F.sum("_m").over(upto) - F.col("_m")).withColumn("_total", F.sum("_m").over(W.partitionBy(*keys)))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("prob"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("pos")) for p in probs])
    touches = lambda lo, n: lambda w: (F.ceil(w["pos"]) >= lo) & (F.floor(w["pos"]) < lo + n)
    hit = coarse.withColumn("_want", F.filter(wanted, touches(F.col("_before"), F.col("_m")))).filter(F.size("_want") > 0)
    inside = W.partitionBy(*keys, "_coarse").orderBy("_fine").rowsBetween(W.unboundedPreceding, 0)
    fine = fine.join(hit.select(*keys, "_coarse", F.col("_before").alias("_base"), "_want"), [*keys, "_coarse"]).withColumn(
        "_start", F.col("_base") + F.sum("_n").over(inside) - F.col("_n"))
    fine = fine.withColumn("_want", F.filter("_want", touches(F.col("_start"), F.col("_n")))).filter(F.size("_want") > 0)
    at = W.partitionBy(*keys, "_fine").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    found = values.join(fine.select(*keys, "_fine", "_start", "_want"), [*keys, "_fine"]).withColumn("_lo", F.col("_start") + F.sum("_n").over(at) - F.col("_n"))
    found = found.select(*keys, "value", "_lo", "_n", F.explode(F.filter("_want", touches(F.col("_lo"), F.col("_n")))).alias("_w"))
    ends = found.groupBy(*keys, F.col("_w.prob").alias("prob"), F.col("_w.pos").alias("_pos")).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    share = F.col("_pos") - F.floor("_pos")
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * share
    return ends.select(*keys, "prob", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias("value"))


def percentile_table(df: DataFrame, groups: Sequence[str], columns: Sequence[str], named: dict[str, float]) -> DataFrame:
    """Same, one column per named probability → (groups, feature, *names)."""
    long = exact_percentiles(df, groups, columns, sorted(set(named.values())))
    return long.groupBy(*groups, "feature").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in named.items()])
