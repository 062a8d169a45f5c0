"""Category codes with one code for everything unseen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidewatch.session import cut_lineage


def dense_codes(train: DataFrame, column: str, output: str, ranges: int | None = None) -> DataFrame:
    """Distinct values of ``column`` with codes 0, 1, … in ascending order (null is no value).

    Sorted distinct values lie in ranges; a value's code is the count of values in the ranges before plus its place in its
    own. Only the counts per range meet in one place."""
    spark = train.sparkSession
    values = train.select(F.col(column).alias("_value")).filter("_value IS NOT NULL").distinct()
    parted = values.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), "_value")
    placed = cut_lineage(parted.withColumn("_part", F.spark_partition_id()))
    inside = F.row_number().over(W.partitionBy("_part").orderBy("_value")) - 1
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))                  # one row per range
    return placed.withColumn("_at", inside).join(starts, "_part").select("_value", (F.col("_start") + F.col("_at")).cast("double").alias(output))


def encode_with_unknown(train: DataFrame, df: DataFrame, column: str, output: str) -> DataFrame:
    """Code of each value by its order among the values of ``train``; unseen and null values get the number of values."""
    codes = cut_lineage(dense_codes(train, column, output))
    unknown = float(codes.count())
    return df.join(codes, df[column] == codes["_value"], "left").drop("_value").withColumn(output, F.coalesce(output, F.lit(unknown)))
