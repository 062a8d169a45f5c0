"""Sinks: features, scores, reports and published alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter


def write_features(features: DataFrame, path: str, fmt: str = "parquet", partition: str = "day",
                   mode: str = "overwrite") -> None:
    """5-tuple, raw features and score, partitioned by day for later labelling."""
    w = features.write.mode(mode)
    w = w.partitionBy(partition) if partition in features.columns else w
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def score_lines(alerts: DataFrame, features: list[str]) -> DataFrame:
    """Alerts with their features as one nested array, ready for JSON lines."""
    return alerts.select("engine", "src_ip", "score", F.array(*[F.col(f).cast("double") for f in features]).alias("features"))


def write_scores(alerts: DataFrame, path: str, features: list[str], checkpoint: str | None = None):
    """Score JSON lines; a streaming frame returns the query that writes them."""
    out = score_lines(alerts, features)
    if not alerts.isStreaming:
        out.write.mode("append").json(path)
        return None
    return out.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode(
        "append").trigger(availableNow=True).start()


def write_report(table: DataFrame, path: str, fmt: str = "json") -> None:
    """A diagnostic table as one folder of JSON or CSV."""
    w = table.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.json(path)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Current state of published alerts: per alert id, the newest version."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c != "alert_id"]
    return log.groupBy("alert_id").agg(F.max_by(F.struct(*rest), "version").alias("_a")).select("alert_id", "_a.*")


def publish_alerts(alerts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Fan out alerts without their feature array as an upsert log keyed by alert id.

    Each micro-batch goes to its own ``batch`` folder, overwritten when the batch is repeated, so a retry cannot
    publish twice. A later score for a known id is a new version of it; ``read_published`` gives the current state.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.drop("features", "raw_features").withColumn("version", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
