"""Stream helpers: windowed aggregates, late rows, alert enrichment, running a bounded stream to its end."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from heapq import nlargest

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from tidewatch.functions.labels import WINDOW_ENGINES, enrich_alert
from tidewatch.operators.joins import attach_scores, lookup_ip_label, lookup_label
from tidewatch.session import drop_folder, new_folder, with_fields

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The stateful processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def window_counts(packets: DataFrame, window: str = "60 seconds", slide: str | None = None, lateness: str = "60 seconds") -> DataFrame:
    """Tumbling or sliding counts per source on a stream, in append mode: packets, SYNs and different destination ports.

    Counted per (window, source, port) first and added up in a second stateful step, so the ports are exact and a source that
    holds most packets is spread over its ports."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    per_port = packets.withWatermark("ts", lateness).groupBy(w.alias("w"), "src_ip", "dst_port").agg(
        F.count("*").alias("n"), F.count_if((F.col("proto") == 6) & (F.col("flags").bitwiseAND(0x12) == 0x02)).alias("s"))
    return (per_port.groupBy("w", "src_ip").agg(F.sum("n").alias("packets"), F.sum("s").alias("syns"), F.count("*").alias("distinct_ports"))
            .select(F.unix_seconds("w.start").alias("win_start"), "src_ip", "packets", "syns", "distinct_ports"))


def split_late(packets: DataFrame, lateness: str = "60 seconds", shards: int = 64) -> DataFrame:
    """Every row with ``late`` (it lies behind the watermark that held when its batch began) and ``watermark_ms``.

    Stateful operators drop late rows unseen; this keeps them as a side output: write the rows that are not late to one place
    and the others to another. Rows are dealt out by a hash of ``event_id``, so no source gathers in one task; the state holds
    one watermark per shard."""
    kept = packets.columns
    # the copy of the time carries no watermark itself, so its late rows reach the processor
    rows = packets.withWatermark("ts", lateness).select(F.pmod(F.xxhash64("event_id"), F.lit(shards)).alias("_shard"), *[
        F.timestamp_micros(F.unix_micros("ts")).alias("ts") if c == "ts" else F.col(c) for c in kept])
    schema = with_fields(packets.schema, ("late", T.BooleanType()), ("watermark_ms", T.LongType()))
    return rows.groupBy("_shard").transformWithStateInPandas(LateRows(), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class LateRows(StatefulProcessor):
    """Flags rows older than the last watermark seen."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("watermark", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.seen.get()[0] if self.seen.exists() else 0
        mark = max(before, timerValues.getCurrentWatermarkInMs())
        self.seen.update((mark,))
        for frame in rows:
            ms = frame["ts"].astype("datetime64[us]").astype("int64") // 1000
            yield frame.drop(columns="_shard", errors="ignore").assign(late=ms < mark, watermark_ms=mark)

    def close(self) -> None:
        pass


def count_late(packets: DataFrame, ts: str, upto: str, name: str = "late") -> tuple[DataFrame, Observation]:
    """Pass rows through and count those older than a bound (timestamp text)."""
    seen = Observation(name)
    late = F.count_if(F.col(ts) < F.lit(upto).cast("timestamp"))
    return packets.observe(seen, F.count("*").alias("rows"), late.alias("late_rows")), seen


# ---------------------------------------------------------------- bounded history

_CHANGE = "engine string, alert_id bigint, ts_us bigint, change int"


class LastAlerts(StatefulProcessor):
    """The last ``keep`` alerts of an engine as a list state; what enters and what leaves the list comes out as changes."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.ring = handle.getListState("ring", "ts_us bigint, alert_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(map(int, r)) for r in self.ring.get()] if self.ring.exists() else []
        last = before
        for frame in rows:                               # never more than the ring and one frame
            last = nlargest(self.keep, [*last, *zip(frame["ts_us"].tolist(), frame["alert_id"].tolist())])
        self.ring.put(last)
        old, new = set(before), set(last)
        changes = [(key[0], i, t, 1) for t, i in new - old] + [(key[0], i, t, -1) for t, i in old - new]
        if changes:
            yield pd.DataFrame(changes, columns=[c.split()[0] for c in _CHANGE.split(", ")])

    def close(self) -> None:
        pass


def bounded_history_stream(alerts: DataFrame, keep: int = 1000) -> DataFrame:
    """Changes of the last ``keep`` alerts of each engine. ``read_history`` makes the history of them and of the window-level
    alerts, which always stay and need no state. Alert ids are unique."""
    a = alerts.select("engine", F.col("alert_id").cast("bigint").alias("alert_id"), F.col("ts_us").cast("bigint").alias("ts_us"))
    return a.groupBy("engine").transformWithStateInPandas(LastAlerts(keep), outputStructType=_CHANGE, outputMode="Append", timeMode="None")


def read_history(changes: DataFrame, window_alerts: DataFrame, keep: int = 1000) -> DataFrame:
    """The last ``keep`` alerts over all engines, and every window-level alert. A list of an engine holds all of its alerts that
    can be among them."""
    held = changes.groupBy("engine", "alert_id", "ts_us").agg(F.sum("change").alias("n")).filter("n > 0")
    last = held.orderBy(F.col("ts_us").desc(), F.col("alert_id").desc()).limit(keep).select("engine", "alert_id")
    return window_alerts.filter(F.col("engine").isin(*WINDOW_ENGINES)).select("engine", "alert_id").union(last).distinct()


def enrich_batch(alerts: DataFrame, flow_idx: DataFrame, ip_idx: DataFrame, scores: DataFrame) -> DataFrame:
    """Engine, label (by address for window engines, by flow otherwise) and latest score of typed alerts."""
    a = enrich_alert(alerts)
    window = F.col("engine").isin(*WINDOW_ENGINES)
    by_ip = attach_scores(lookup_ip_label(a.filter(window), ip_idx), scores.select("src_ip", "score", "seq"))
    by_flow = lookup_label(a.filter(~window), flow_idx).withColumn("score", F.lit(None).cast("double"))
    return by_ip.unionByName(by_flow)


def enrich_alert_stream(alerts: DataFrame, flow_idx: DataFrame, ip_idx: DataFrame, scores: DataFrame, path: str, checkpoint: str):
    """parse → engine → label → score per micro-batch; a repeated batch overwrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        enrich_batch(batch, flow_idx, ip_idx, scores).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def one_part_per_core(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in one part per core where the session asks for more parts than cores.

    A micro-batch loads and commits every part of every stateful step, and starts Python for it, whatever rows it has, and state
    is not subject to adaptive merging of small parts. What a part holds lies in the state store, not in memory."""
    name = "spark.sql.shuffle.partitions"
    asked = spark.conf.get(name)
    spark.conf.set(name, str(min(int(asked), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, asked)


def run_to_end(stream: DataFrame, spark: SparkSession, name: str = "stream", checkpoint: str | None = None) -> DataFrame:
    """Drain a bounded stream into a table in the shared folder and read it back."""
    path, checkpoint = new_folder(spark, name), checkpoint or new_folder(spark, f"{name}-cp")
    with one_part_per_core(spark):
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(
            "append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def state_left(spark: SparkSession, checkpoint: str, names: Sequence[str], operator: int = 0) -> DataFrame:
    """Keys that each named state still holds, read from the state store of a finished stream → (state, keys)."""
    read = lambda n: spark.read.format("statestore").option("operatorId", operator).option("stateVarName", n).load(checkpoint)
    left = [read(n).select("key").distinct().agg(F.count("*").alias("keys")).select(F.lit(n).alias("state"), "keys") for n in names]
    return reduce(DataFrame.unionByName, left)


def pack_ranges(counts: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Runs of neighbouring parts, as first and last number, that hold up to ``most`` rows or a single part."""
    out, held = [], 0
    for part, n in counts:
        if out and held + n <= most:
            out[-1], held = (out[-1][0], part), held + n
        else:
            out.append((part, part))
            held = n
    return out


def replay(spark: SparkSession, table: DataFrame, name: str = "replay", slices: int = 3, files: int = 2,
           stop_after_us: int = 0, max_rows: int = 1_000_000, order: tuple[str, ...] = ("ts_us", "event_id")) -> DataFrame:
    """A bounded table written as time slices, one after the other, and read back as a stream, one slice per batch.

    Slices follow the columns of ``order`` and hold ``max_rows`` rows or little more, also where many rows share a time;
    there are more than ``slices`` of them where the table needs it. With ``stop_after_us`` a last marker row of no known
    protocol follows that much later; it moves the watermark past every open window.
    """
    path, parts = new_folder(spark, name), new_folder(spark, f"{name}-parts")
    slices = max(slices, -(-table.count() // max_rows))
    # Four ranges a slice, so that sampled bounds make up slices of nearly equal size.
    table.repartitionByRange(4 * slices, *order).withColumn("_part", F.spark_partition_id()).write.partitionBy(
        "_part").parquet(parts)
    ranged = spark.read.schema(T.StructType([*table.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(parts)
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    for lo, hi in pack_ranges(counts, -(-sum(n for _, n in counts) // slices)):
        ranged.filter(F.col("_part").between(lo, hi)).drop("_part").repartition(files).write.mode("append").parquet(path)
    drop_folder(spark, parts)
    if stop_after_us:
        last = table.agg(*[F.max(c).alias(c) for c in table.columns]).withColumns({
            "ts_us": F.col("ts_us") + stop_after_us, "event_id": F.col("event_id") + 1, "proto": F.lit(0), "flags": F.lit(4)})
        last = last.withColumn("ts", F.timestamp_micros("ts_us"))
        last.select(*[F.col(c).cast(table.schema[c].dataType) for c in table.columns]).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)
