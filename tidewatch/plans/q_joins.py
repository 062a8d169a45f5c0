"""Joins, sampling, splits and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import confusion as CF, joins as J, sampling as SM, windows as WN
from tidewatch.plans import q_common as C
from tidewatch.plans.q_eval import LIVE_SQL, live
from tidewatch.plans.registry import query


@query("alerts_to_flows", "row_key label", "SELECT row_key, label FROM flows WHERE flow_id IN (SELECT flow_id FROM alert_ids)", "alert_ids")
def alerts_to_flows(spark, sf):
    return J.alerts_to_flows(C.flows(spark, sf), C.alert_ids(spark, sf))


@query("unalerted_flows", "row_key label", "SELECT row_key, label FROM flows WHERE label = 'BENIGN' AND flow_id NOT IN (SELECT flow_id FROM alert_ids)", "alert_ids")
def unalerted_flows(spark, sf):
    return J.unalerted_flows(C.flows(spark, sf), C.alert_ids(spark, sf))


@query("lookup_label", "pkt_num:i src_ip src_port:i ground_truth", """, idx AS (SELECT flow_id, max(CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END) AS bad FROM flows GROUP BY flow_id),
a AS (SELECT *, CASE proto WHEN 'TCP' THEN 6 ELSE 17 END AS pn, src_port <> 0 AND src_ip NOT LIKE '224.%' AS ok FROM alerts)
--result
SELECT pkt_num, src_ip, src_port, CASE WHEN ok THEN CASE coalesce(r.bad, f.bad) WHEN 1 THEN 'attack' WHEN 0 THEN 'benign' END END AS ground_truth
  FROM a LEFT JOIN idx r ON r.flow_id = concat(dst_ip,'-',src_ip,'-',dst_port,'-',src_port,'-',pn)
  LEFT JOIN idx f ON f.flow_id = concat(src_ip,'-',dst_ip,'-',src_port,'-',dst_port,'-',pn)""", "alerts")
def lookup_label(spark, sf):
    return J.lookup_label(C.alerts(spark, sf), CF.flow_index(C.flows(spark, sf)))


@query("lookup_ip_label", "pkt_num:i src_ip ground_truth", """, x AS (SELECT src_ip, max(CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END) AS bad FROM flows GROUP BY src_ip)
--result
SELECT pkt_num, src_ip, CASE bad WHEN 1 THEN 'attack' WHEN 0 THEN 'benign' END AS ground_truth FROM alerts LEFT JOIN x USING (src_ip)""", "alerts")
def lookup_ip_label(spark, sf):
    return J.lookup_ip_label(C.alerts(spark, sf), CF.ip_index(C.flows(spark, sf)))


@query("attach_scores", "alert_id:i src_ip score:d", f""", {LIVE_SQL}, s AS (SELECT src_ip, arg_max(payload_len / 64, event_id) AS score FROM packets WHERE flags = 24 GROUP BY src_ip)
--result
SELECT alert_id, src_ip, score FROM live LEFT JOIN s USING (src_ip)""", "packets")
def attach_scores(spark, sf):
    s = C.packets(spark, sf).filter("flags = 24").select("src_ip", (F.col("payload_len") / 64).alias("score"), F.col("event_id").alias("seq"))
    return J.attach_scores(live(spark, sf), s)


@query("attach_nth_log", "engine alert_id:i seq:i log_id:i log_score:d", f""", {LIVE_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY alert_id) - 1 AS seq FROM live WHERE ground_truth IS NOT NULL),
l AS (SELECT engine, alert_id AS log_id, payload_len / 64 AS log_score, row_number() OVER (PARTITION BY engine ORDER BY alert_id) - 1 AS seq
  FROM (SELECT * REPLACE (CASE engine WHEN 'bot' THEN 'portscan' ELSE 'community' END AS engine) FROM live WHERE engine IN ('bot', 'dos_agg')))
--result
SELECT engine, alert_id, seq, log_id, log_score FROM a LEFT JOIN l USING (engine, seq)""", "packets")
def attach_nth_log(spark, sf):
    """The N-th scan alert meets the N-th line of one log, the N-th community alert that of another."""
    a = live(spark, sf)
    log = a.filter(F.col("engine").isin("bot", "dos_agg")).select(
        F.when(F.col("engine") == "bot", "portscan").otherwise("community").alias("engine"), F.col("alert_id").alias("log_id"),
        (F.col("payload_len") / 64).alias("log_score"))
    return J.attach_nth_log(a.filter("ground_truth is not null"), log, ["engine"])


@query("label_dump", "row_key label:i", """, att AS (SELECT DISTINCT flow_id FROM flows WHERE label <> 'BENIGN'),
d AS (SELECT row_key, pkt_num % 2 = 0 AS turn, flow_id FROM flows)
--result
SELECT row_key, CASE WHEN flow_id IN (SELECT flow_id FROM att) THEN 1 ELSE 0 END AS label FROM d""", "flows")
def label_dump(spark, sf):
    """A dump whose rows are written in either direction."""
    f = C.flows(spark, sf)
    turn = F.col("pkt_num") % 2 == 0
    pick = lambda a, b: F.when(turn, F.col(a)).otherwise(F.col(b))
    dump = f.select("row_key", pick("src_ip", "dst_ip").alias("src_ip"), pick("dst_ip", "src_ip").alias("dst_ip"),
                    pick("src_port", "dst_port").alias("src_port"), pick("dst_port", "src_port").alias("dst_port"), "proto")
    return J.label_dump(dump, f)


@query("label_windows", "src_ip window_id:i total_flows:i label:i", f"""SELECT src_ip, ts_us // 1000000 // {C.WEEK} AS window_id, count(*) AS total_flows,
  max(CASE WHEN label = 'PortScan' THEN 1 ELSE 0 END) AS label FROM flows GROUP BY src_ip, window_id""", "flows")
def label_windows(spark, sf):
    f = C.flows(spark, sf)
    return J.label_windows(WN.flow_window_features_4(f, C.WEEK), f, C.WEEK)


ENDPOINTS_SQL = f""", ep AS (SELECT dst_ip, dst_port, ts_us // 1000000 // {C.WEEK} * {C.WEEK} AS win_start, sum(CASE WHEN s THEN 2 ELSE 1 END) AS total,
  count(DISTINCT CASE WHEN s THEN src_ip END) / sum(CASE WHEN s THEN 2 ELSE 1 END) AS src_ratio
  FROM (SELECT *, proto = 6 AND flags & 18 = 2 AS s FROM packets WHERE proto = 17 OR flags & 18 = 2) GROUP BY ALL)"""


@query("label_endpoints", "dst_ip dst_port:i win_start:i label:i", ENDPOINTS_SQL + """
--result
SELECT dst_ip, dst_port, win_start, CASE WHEN (SELECT count(*) FROM ep WHERE dst_ip IN (SELECT dst_ip FROM packets WHERE proto = 17 AND flags = 24 AND payload_len > 60)) < 1000000
    AND total > 10 AND src_ratio < 0.5 THEN 1 WHEN dst_ip IN (SELECT dst_ip FROM packets WHERE proto = 17 AND flags = 24 AND payload_len > 60) THEN 1 ELSE 0 END AS label FROM ep""", "packets")
def label_endpoints(spark, sf):
    """Victims are few against ``min_positive``, so volume and ratio decide beside them."""
    victims = C.packets(spark, sf).filter("proto = 17 and flags = 24 and payload_len > 60")
    return J.label_endpoints(WN.endpoint_window_features(C.packets(spark, sf), C.WEEK), victims, min_positive=1_000_000, min_total=10, max_src_ratio=0.5)


@query("label_endpoints_victims", "dst_ip dst_port:i win_start:i label:i", ENDPOINTS_SQL + """
--result
SELECT dst_ip, dst_port, win_start, CASE WHEN dst_ip IN (SELECT dst_ip FROM packets WHERE flags = 41) THEN 1 ELSE 0 END AS label FROM ep""", "packets")
def label_endpoints_victims(spark, sf):
    p = C.packets(spark, sf)
    return J.label_endpoints(WN.endpoint_window_features(p, C.WEEK), p.filter("flags = 41"))


@query("label_endpoints_by_key", "dst_ip dst_port:i win_start:i label:i", ENDPOINTS_SQL + f"""
--result
SELECT dst_ip, dst_port, win_start, CASE WHEN (dst_ip, dst_port) IN (SELECT (dst_ip, dst_port) FROM packets WHERE flags = 41) AND total / {C.WEEK} >= 0.00002 THEN 1 ELSE 0 END AS label FROM ep""", "packets")
def label_endpoints_by_key(spark, sf):
    p = C.packets(spark, sf)
    return J.label_endpoints_by_key(WN.endpoint_window_features(p, C.WEEK), p.filter("flags = 41"), ["dst_ip", "dst_port"], 0.00002)


@query("suppress_listed", "pkt_num:i src_ip suppress_reason", """SELECT pkt_num, src_ip, CASE WHEN src_ip IN (SELECT src_ip FROM flows WHERE swin > 29900) THEN 'whitelist' END AS suppress_reason FROM alerts""", "alerts")
def suppress_listed(spark, sf):
    return J.suppress_listed(C.alerts(spark, sf), C.flows(spark, sf).filter("swin > 29900"), keep_reason=True)


@query("suppress_listed_drop", "pkt_num:i src_ip", "SELECT pkt_num, src_ip FROM alerts WHERE src_ip NOT IN (SELECT src_ip FROM flows WHERE swin > 29900)", "alerts")
def suppress_listed_drop(spark, sf):
    return J.suppress_listed(C.alerts(spark, sf), C.flows(spark, sf).filter("swin > 29900"))


# ------------------------------------------------------------------ sampling

H = "md5(concat_ws('|', '42', row_key))"


@query("stratified_split", "row_key label split", f"""SELECT row_key, label, CASE WHEN r <= floor(n * 0.15) THEN 'test' WHEN r <= floor(n * 0.3) THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT row_key, label, rank() OVER (PARTITION BY label ORDER BY {H}) AS r, count(*) OVER (PARTITION BY label) AS n FROM flows)""", "flows")
def stratified_split(spark, sf):
    return SM.stratified_split(C.flows(spark, sf), parts={"test": 0.15, "validation": 0.15, "train": 0.7})


@query("group_split", "row_key src_ip split", """SELECT row_key, src_ip, CASE WHEN CAST(concat('0x', md5(concat_ws('|', '42', src_ip))[1:8]) AS BIGINT) < 858993459 THEN 'validation' ELSE 'train' END AS split FROM flows""", "flows")
def group_split(spark, sf):
    return SM.group_split(C.flows(spark, sf), label=F.col("label") != "BENIGN")


@query("cap_per_class", "row_key label", f"""SELECT row_key, label FROM flows QUALIFY row_number() OVER (PARTITION BY label ORDER BY {H}) <= CASE label WHEN 'BENIGN' THEN 5000 WHEN 'PortScan' THEN 1000 ELSE 500 END""", "flows")
def cap_per_class(spark, sf):
    return SM.cap_per_class(C.flows(spark, sf), {"BENIGN": 5000, "PortScan": 1000}, 500)


@query("hard_half_benign", "row_key csv_source is_problem:i", f"""SELECT row_key, day AS csv_source, is_problem FROM (SELECT *, CASE WHEN dbytes = 0 OR dur < 10000 OR spkts = 1 THEN 1 ELSE 0 END AS is_problem FROM flows WHERE label = 'BENIGN')
  QUALIFY row_number() OVER (PARTITION BY day, is_problem ORDER BY {H}) <= 500""", "flows")
def hard_half_benign(spark, sf):
    problem = (F.col("dbytes") == 0) | (F.col("dur") < 10000) | (F.col("spkts") == 1)
    return SM.hard_half_benign(C.flows(spark, sf).withColumn("csv_source", F.col("day")), 1000, problem)


@query("downsample_ratio", "row_key label", f"""SELECT row_key, label FROM flows WHERE label <> 'BENIGN' UNION ALL SELECT row_key, label FROM (SELECT row_key, label, row_number() OVER (ORDER BY {H}) AS r FROM flows WHERE label = 'BENIGN')
  WHERE r <= 3 * (SELECT count(*) FROM flows WHERE label <> 'BENIGN')""", "flows")
def downsample_ratio(spark, sf):
    return SM.downsample_ratio(C.flows(spark, sf), 3.0)


@query("row_cap", "row_key", f"SELECT row_key FROM flows QUALIFY row_number() OVER (ORDER BY {H}) <= 4000", "flows")
def row_cap(spark, sf):
    return SM.row_cap(C.flows(spark, sf), 4000)


@query("oversample", "row_key copy:i", "SELECT row_key, unnest(CASE WHEN src_ip = '172.16.0.5' THEN [1,2,3] ELSE [1] END) AS copy FROM flows", "flows")
def oversample(spark, sf):
    return SM.oversample(C.flows(spark, sf), F.col("src_ip") == "172.16.0.5", 3)


@query("hard_negative_weight", "row_key weight:d", """SELECT row_key, CASE WHEN label <> 'BENIGN' THEN 1 WHEN src_ip = '172.16.0.7' AND day = 'Friday' THEN 5 WHEN src_ip IN ('172.16.0.7', '172.16.0.9') THEN 3 ELSE 1 END AS weight FROM flows""", "flows")
def hard_negative_weight(spark, sf):
    return SM.hard_negative_weight(C.flows(spark, sf), {"172.16.0.7": 3, "172.16.0.9": 3}, {("172.16.0.7", "Friday"): 5})


@query("class_weight", "positives:i negatives:i scale_pos_weight:d", """SELECT p AS positives, n AS negatives, n / p AS scale_pos_weight FROM (SELECT count(*) FILTER (WHERE label <> 'BENIGN') AS p, count(*) FILTER (WHERE label = 'BENIGN') AS n FROM flows)""", "flows")
def class_weight(spark, sf):
    return SM.class_weight(C.flows(spark, sf))


@query("source_weight", "row_key weight:d", "SELECT row_key, CASE WHEN proto = 6 AND label <> 'BENIGN' THEN 3 ELSE 1 END AS weight FROM flows", "flows")
def source_weight(spark, sf):
    return SM.source_weight(C.flows(spark, sf), F.col("proto") == 6, 3.0)
