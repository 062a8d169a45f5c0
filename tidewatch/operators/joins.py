"""Joins between alerts, flows, labels, windows and score logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.addresses import flow_id, flow_id_candidates, map_ip, proto_num, reverse_flow_id, is_valid_ip
from tidewatch.operators.ranking import running_number


def alerts_to_flows(flows: DataFrame, alert_ids: DataFrame) -> DataFrame:
    """Flow rows any alert points at."""
    return flows.join(alert_ids.select("flow_id").distinct(), "flow_id", "left_semi")


def unalerted_flows(flows: DataFrame, alert_ids: DataFrame, benign_only: bool = True) -> DataFrame:
    base = flows.filter(F.col("label") == "BENIGN") if benign_only else flows
    return base.join(alert_ids.select("flow_id").distinct(), "flow_id", "left_anti")


def lookup_label(alerts: DataFrame, index: DataFrame) -> DataFrame:
    """Label each alert by the first of its candidate ids present in ``index``; null when none is or ports are 0.

    Looked up once per distinct five-tuple, then joined back, so repeated alerts do not repeat the lookup.
    """
    five = ["src_ip", "dst_ip", "src_port", "dst_port", "proto_no"]
    rows = alerts.withColumn("proto_no", proto_num("proto"))
    ok = (is_valid_ip("src_ip") & is_valid_ip("dst_ip") & (F.col("proto_no") != 0)
          & ((F.col("proto_no") == 1) | ((F.col("src_port") != 0) & (F.col("dst_port") != 0))))
    asked = rows.filter(ok).select(*five).distinct().select(
        *five, F.posexplode(flow_id_candidates(*five)).alias("pos", "flow_id"))
    verdict = F.when(F.col("attack_rows") > 0, "attack").otherwise("benign")
    found = asked.join(index, "flow_id").groupBy(*five).agg(F.min_by(verdict, "pos").alias("ground_truth"))
    return rows.join(found, five, "left").drop("proto_no")


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Left join with a table that is unique per ``key``, for keys that may hold a large part of ``rows``.

    The rows are counted down to their distinct keys first; only those of ``lookup`` are repeated, once per salt, and a key's
    rows are dealt over the salts."""
    met = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    copies = lookup.join(met, key, "left_semi").withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(copies, [key, "_salt"], "left").drop("_salt")


def lookup_ip_label(alerts: DataFrame, index: DataFrame) -> DataFrame:
    """Label by source address."""
    lab = index.select(F.col("ip").alias("src_ip"),
                       F.when(F.col("is_attack") == 1, "attack").otherwise("benign").alias("ground_truth"))
    return spread_join(alerts, lab, "src_ip")


def latest_scores(scores: DataFrame, key: str = "src_ip", seq: str = "seq") -> DataFrame:
    """Last entry per source; ``seq`` is the explicit order of the entries."""
    rest = [c for c in scores.columns if c != key]
    return scores.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_s")).select(key, "_s.*")


def attach_scores(alerts: DataFrame, scores: DataFrame, key: str = "src_ip") -> DataFrame:
    """Alert ← latest window score of its source, kept only for sources that have one."""
    last = latest_scores(scores, key).drop("seq")
    return spread_join(alerts.drop("score"), last, key)


def attach_nth_log(alerts: DataFrame, log: DataFrame, groups: Sequence[str] = (), alert_id: str = "alert_id",
                   log_id: str = "log_id") -> DataFrame:
    """N-th alert ↔ N-th log line, both numbered by their ids."""
    a = running_number(alerts, alert_id, groups)
    b = running_number(log, log_id, groups)
    return a.join(b, [*groups, "seq"], "left")


def label_dump(dump: DataFrame, flows: DataFrame) -> DataFrame:
    """Feature dump rows get label 1 when their id, in either direction, is an attack id."""
    attack = flows.filter(F.col("label") != "BENIGN").select("flow_id").distinct()
    both = attack.select(F.explode(F.array("flow_id", reverse_flow_id("flow_id"))).alias("_id")).distinct().withColumn(
        "_hit", F.lit(1))
    src, dst = map_ip("src_ip"), map_ip("dst_ip")
    # the attack set holds both directions, so one probe per row is enough
    own = dump.withColumn("_id", flow_id(src, dst, "src_port", "dst_port", "proto"))
    return own.join(both, "_id", "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_id", "_hit")


def label_windows(windows: DataFrame, flows: DataFrame, window_sec: int = 60, key: str = "src_ip",
                  rule: Column | None = None) -> DataFrame:
    """(source, window) label = max over the flow rows of that window; 0 where no row exists."""
    hit = (F.col("label") == "PortScan") if rule is None else rule
    lab = flows.groupBy(key, F.floor(F.col("ts_us") / (window_sec * 1_000_000)).cast("bigint").alias("window_id")).agg(
        F.max(hit.cast("int")).alias("label"))
    return windows.drop("label").join(lab, [key, "window_id"], "left").na.fill(0, ["label"])


def label_endpoints(windows: DataFrame, victims: DataFrame, min_positive: int = 5, min_total: int = 100,
                    max_src_ratio: float = 0.3) -> DataFrame:
    """Label endpoint windows by victim address; with fewer than ``min_positive`` hits, volume and ratio add to it.

    The number of hits is a scalar subquery of the same plan, not a driver value.
    """
    hit = victims.select("dst_ip").distinct().withColumn("_hit", F.lit(1))
    rows = windows.join(hit, "dst_ip", "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    hits = rows.agg(F.coalesce(F.sum("_hit"), F.lit(0))).scalar()
    by_shape = (F.col("total") > min_total) & (F.col("src_ratio") < max_src_ratio)
    label = F.when((hits < min_positive) & by_shape, 1).otherwise(F.col("_hit"))
    return rows.withColumn("label", label).drop("_hit")


def label_endpoints_by_key(windows: DataFrame, victims: DataFrame, on: Sequence[str] = ("dst_ip",),
                           min_rate: float | None = None) -> DataFrame:
    """By destination address or exact endpoint, optionally only from a rate upwards."""
    hit = victims.select(*on).distinct().withColumn("_hit", F.lit(1))
    ok = F.col("_hit").isNotNull()
    if min_rate is not None:
        ok = ok & (F.col("rate") >= min_rate)
    return windows.join(hit, list(on), "left").withColumn("label", F.when(ok, 1).otherwise(0)).drop("_hit")


def suppress_listed(alerts: DataFrame, allow: DataFrame, key: str = "src_ip", keep_reason: bool = False) -> DataFrame:
    """Drop alerts of listed sources, or keep them with ``suppress_reason`` 'whitelist'."""
    listed = allow.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_listed", F.lit(1))
    marked = spread_join(alerts, listed, key)
    if not keep_reason:
        return marked.filter("_listed IS NULL").drop("_listed")
    return marked.withColumn("suppress_reason", F.when(F.col("_listed") == 1, "whitelist")).drop("_listed")


def slice_universe(index: DataFrame, ips: DataFrame, slice_ids: DataFrame, slice_ips: DataFrame) -> DataFrame:
    """Label totals of the flows and addresses seen in a capture slice, as one row."""
    f = index.join(slice_ids.select("flow_id").distinct(), "flow_id", "left_semi").agg(
        F.count("*").alias("matched_flows"), F.coalesce(F.sum("attack_rows"), F.lit(0)).alias("attack_rows"),
        F.coalesce(F.sum("benign_rows"), F.lit(0)).alias("benign_rows"))
    seen = slice_ips.select("ip").distinct()
    i = seen.join(ips, "ip", "left").agg(
        F.count("*").alias("src_ips_seen"), F.count_if(F.col("is_attack") == 1).alias("attack_ips"),
        F.count_if(F.col("is_attack") == 0).alias("benign_ips"))
    return f.withColumn("_i", i.select(F.struct(*i.columns)).scalar()).select(*f.columns, "_i.*")
