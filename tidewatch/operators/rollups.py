"""Dashboard roll-ups over alerts, and windows against alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewatch.functions.features import ratio
from tidewatch.operators.ranking import top_k

US = 1_000_000


def alerts_per_second(alerts: DataFrame, window_sec: int = 60) -> DataFrame:
    """Counts per second and engine over the trailing window, zero filled, with the peak second marked.

    The window ends at the last alert; it starts at the first one while the replay is younger than the window.
    """
    sec = F.floor(F.col("ts_us") / US).cast("bigint")
    per = alerts.groupBy(sec.alias("sec"), "engine").agg(F.count("*").alias("n"))
    # the engines are a handful of names, so one row can carry them
    span = per.agg(F.min("sec").alias("_first"), F.max("sec").alias("_last"), F.collect_set("engine").alias("_engines"))
    begin = F.greatest(F.col("_first"), F.col("_last") - window_sec + 1)
    axis = span.select("_engines", F.explode(F.sequence(begin, F.col("_last"))).alias("sec")).select(
        "sec", F.explode("_engines").alias("engine"))
    out = axis.join(per, ["sec", "engine"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(W.partitionBy("sec"))
    out = out.withColumn("total", total)
    first_peak = F.min_by("sec", F.struct(-F.col("total"), F.col("sec"))).over(W.partitionBy(F.lit(0)))
    return out.withColumn("is_peak", (F.col("sec") == first_peak).cast("int"))


def first_alert(alerts: DataFrame) -> DataFrame:
    """First time each engine fires, in seconds after the first alert of all."""
    per = alerts.groupBy("engine").agg(F.min("ts_us").alias("first_us"), F.count("*").alias("alerts"))
    start = F.min("first_us").over(W.partitionBy(F.lit(0)))
    return per.withColumn("after_sec", (F.col("first_us") - start) / float(US))


def group_by_source(alerts: DataFrame, seq: str = "alert_id") -> DataFrame:
    """First alert of each source with its number of windows."""
    rest = [c for c in alerts.columns if c != "src_ip"]
    return alerts.groupBy("src_ip").agg(F.min_by(F.struct(*rest), seq).alias("_a"), F.count("*").alias("windows")).select(
        "src_ip", "windows", "_a.*")


def recent_alerts(alerts: DataFrame, k: int = 50, community_k: int | None = None, seq: str = "alert_id") -> DataFrame:
    """Newest ``k`` per engine, detection engines before community rules → ``position``."""
    newest = [F.col("ts_us").desc(), F.col(seq).desc()]
    limit = F.when(F.col("engine") == "community", community_k or k).otherwise(k)
    out = top_k(alerts, ["engine"], newest, max(k, community_k or k)).filter(F.col("rank") <= limit)
    order = W.partitionBy(F.lit(0)).orderBy((F.col("engine") == "community").cast("int"), *newest)
    return out.withColumn("position", F.row_number().over(order))


def technique_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per technique and tactic with the share of the largest."""
    out = alerts.filter("mitre_technique is not null").groupBy("mitre_tactic", "mitre_technique").agg(
        F.count("*").alias("n"))
    return out.withColumn("share_of_max", F.col("n") / F.max("n").over(W.partitionBy(F.lit(0))))


def triage_savings(baselines: DataFrame, minutes: float = 3.0) -> DataFrame:
    """Alert gap between community rules and detectors as analyst time; ``baselines(scenario, ml, community)``."""
    gap = F.greatest(F.col("community") - F.col("ml"), F.lit(0))
    return baselines.withColumn("alert_gap", gap).withColumns({
        "hours": F.round(F.col("alert_gap") * minutes / 60).cast("bigint"),
        "days": F.round(F.col("alert_gap") * minutes / 60 / 8).cast("bigint"),
        "saved_pct": 100 * F.col("alert_gap") / F.greatest(F.col("community"), F.lit(1)),
        "multiplier": F.when(F.col("ml") > 0, F.col("community") / F.col("ml"))})


def alert_dedup(alerts: DataFrame, key: str = "alert_id", skip_benign: bool = True) -> DataFrame:
    """One row per alert id, the first by time; benign-labelled rows are skipped."""
    rows = alerts.filter(F.coalesce(F.col("ground_truth"), F.lit("")) != "benign") if skip_benign else alerts
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), "ts_us").alias("_a")).select(key, "_a.*")


def live_counters(alerts: DataFrame) -> DataFrame:
    """Alerts and distinct sources per engine."""
    per = alerts.groupBy("engine", "src_ip").agg(F.count("*").alias("n"))
    return per.groupBy("engine").agg(F.sum("n").alias("total"), F.count("*").alias("unique_src"))


def rule_id_counts(alerts: DataFrame, groups: Sequence[str] = ("day", "gid"), listed: DataFrame | None = None,
                   key: str = "src_ip") -> DataFrame:
    """Alerts per day and detector id; with ``listed(src_ip)`` also per listed address."""
    if listed is not None:
        alerts = alerts.join(listed.select(key).distinct(), key, "left_semi")
        groups = [*groups, key]
    return alerts.groupBy(*groups).agg(F.count("*").alias("alerts"))


def max_score_by_ip(scores: DataFrame, key: str = "src_ip") -> DataFrame:
    """Best score per address with the day it was reached (first day on ties)."""
    order = F.struct(F.col("score"), -F.col("ts_us"))
    return scores.groupBy(key).agg(F.max("score").alias("best_score"), F.max_by("day", order).alias("day"))


def source_profile(packets: DataFrame, source: str, k: int = 10) -> DataFrame:
    """One source: totals as rows (kind, item, n), with its top ports and addresses."""
    syn = packets.filter((F.col("src_ip") == source) & (F.col("flags").bitwiseAND(0x12) == 0x02) & (F.col("proto") == 6))
    counts = syn.select("ts_us", F.explode(F.array(
        F.struct(F.lit("port").alias("kind"), F.col("dst_port").cast("string").alias("item")),
        F.struct(F.lit("ip").alias("kind"), F.col("dst_ip").alias("item")))).alias("_x")).groupBy(
        "_x.kind", "_x.item").agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"),
                                  F.max("ts_us").alias("last_us"))
    totals = counts.groupBy("kind").agg(F.count("*").alias("distinct_items"), F.sum("n").alias("syns"),
                                        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    top = top_k(counts.drop("first_us", "last_us"), ["kind"], [F.col("n").desc(), F.col("item")], k)
    return top.join(totals, "kind")


def alert_noise(alerts: DataFrame, attack_ips: DataFrame) -> DataFrame:
    """Alerts in total, those touching an attack address at either end, and the share of the rest.

    Alerts are counted per address pair first, so the two joins see pairs rather than alerts.
    """
    pairs = alerts.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("n"))
    bad = attack_ips.select("ip").distinct()
    s = bad.select(F.col("ip").alias("src_ip"), F.lit(1).alias("_s"))
    d = bad.select(F.col("ip").alias("dst_ip"), F.lit(1).alias("_d"))
    rows = pairs.join(s, "src_ip", "left").join(d, "dst_ip", "left")
    hit = F.col("_s").isNotNull() | F.col("_d").isNotNull()
    out = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_alerts"),
                   F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("on_attack_ips"))
    out = out.withColumn("benign_alerts", F.col("total_alerts") - F.col("on_attack_ips"))
    return out.withColumn("noise_share", ratio("benign_alerts", "total_alerts"))


def window_recall(windows: DataFrame, attackers: DataFrame, min_events: int = 1) -> DataFrame:
    """Window recall and SYN coverage of the attackers; windows carry syn_count and ``alerted``."""
    hit = attackers.select("src_ip").distinct().withColumn("_k", F.lit(1))
    rows = windows.join(hit, "src_ip", "left")
    k, ok, fired = F.col("_k").isNotNull(), F.col("syn_count") >= min_events, F.col("alerted")
    out = rows.agg(
        F.count_if(k & ok).alias("eligible_windows"), F.count_if(k & ok & fired).alias("alerted_windows"),
        F.coalesce(F.sum(F.when(k, F.col("syn_count"))), F.lit(0)).alias("attack_syns"),
        F.coalesce(F.sum(F.when(k & fired, F.col("syn_count"))), F.lit(0)).alias("covered_syns"),
        F.count_if(~k & fired).alias("fp_windows"))
    return out.withColumns({"window_recall": ratio("alerted_windows", "eligible_windows"),
                            "syn_coverage": ratio("covered_syns", "attack_syns")})


def alert_windows_by_ip(windows: DataFrame, attackers: DataFrame) -> DataFrame:
    """Evaluated and alerted windows per address, mean score of the alerted ones, false-positive flag."""
    hit = attackers.select("src_ip").distinct().withColumn("_k", F.lit(1))
    per = windows.groupBy("src_ip").agg(
        F.count("*").alias("evaluated"), F.count_if(F.col("alerted")).alias("alert_windows"),
        F.coalesce(F.avg(F.when(F.col("alerted"), F.col("score"))), F.lit(0.0)).alias("mean_score"))
    return per.join(hit, "src_ip", "left").withColumn(
        "is_fp", (F.col("_k").isNull() & (F.col("alert_windows") > 0)).cast("int")).drop("_k")


def window_totals_by_day(windows: DataFrame, attackers: DataFrame) -> DataFrame:
    """Windows, attacker windows, alerts and non-attacker alerts per day, with a row for all days (day null)."""
    hit = attackers.select("src_ip").distinct().withColumn("_k", F.lit(1))
    per = windows.groupBy("day", "src_ip").agg(F.count("*").alias("w"), F.count_if(F.col("alerted")).alias("a"))
    k = F.col("_k").isNotNull()
    return per.join(hit, "src_ip", "left").rollup("day").agg(
        F.sum("w").alias("windows"), F.sum(F.when(k, F.col("w")).otherwise(0)).alias("attacker_windows"),
        F.sum("a").alias("alerts"), F.sum(F.when(k, F.col("a")).otherwise(0)).alias("attacker_alerts"),
        F.sum(F.when(~k, F.col("a")).otherwise(0)).alias("other_alerts"))


def union_sources(parts: dict[str, DataFrame], column: str = "csv_source") -> DataFrame:
    """Concatenate tables by column name, with the part's name in ``column``."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(column, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def alert_set_algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of union, intersection and both differences of two id sets."""
    col = a.columns[0]
    both = a.distinct().withColumn("_a", F.lit(1)).join(b.distinct().withColumn("_b", F.lit(1)), col, "full")
    ia, ib = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(F.count("*").alias("either"), F.count_if(ia & ib).alias("common"),
                    F.count_if(ia & ~ib).alias("only_a"), F.count_if(~ia & ib).alias("only_b"))


def rollup_totals(df: DataFrame, groups: Sequence[str], **aggs: Column) -> DataFrame:
    """Aggregates per part plus the total (null groups)."""
    return df.rollup(*groups).agg(*[c.alias(n) for n, c in aggs.items()])
