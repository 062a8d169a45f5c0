"""Confusion matrices, sweeps, diagnostics and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import confusion as CF, diagnostics as D, joins as J, rollups as R, sweeps as SW, windows as WN
from tidewatch.plans import q_common as C
from tidewatch.plans.q_common import RATE_COLS, RATES_SQL
from tidewatch.plans.q_windows import SYN_SQL
from tidewatch.plans.registry import query

CELLS = "tp:i fp:i tn:i fn:i"


def _cells(hit: str, attack: str = "label <> 'BENIGN'") -> str:
    return (f"count(*) FILTER (WHERE {attack} AND {hit}) AS tp, count(*) FILTER (WHERE NOT ({attack}) AND {hit}) AS fp, "
            f"count(*) FILTER (WHERE NOT ({attack}) AND NOT ({hit})) AS tn, count(*) FILTER (WHERE {attack} AND NOT ({hit})) AS fn")


TAG_CELLS = ", ".join(f"count(*) FILTER (WHERE tag = '{t}') AS {t.lower()}" for t in ("TP", "FP", "TN", "FN"))


@query("flow_index", "flow_id attack_rows:i benign_rows:i", """SELECT flow_id, count(*) FILTER (WHERE label <> 'BENIGN') AS attack_rows,
  count(*) FILTER (WHERE label = 'BENIGN') AS benign_rows FROM flows GROUP BY flow_id""", "flows")
def flow_index(spark, sf):
    return CF.flow_index(C.flows(spark, sf))


@query("ip_index", "ip is_attack:i", "SELECT src_ip AS ip, max(CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END) AS is_attack FROM flows GROUP BY src_ip", "flows")
def ip_index(spark, sf):
    return CF.ip_index(C.flows(spark, sf))


@query("flow_confusion", f"{CELLS} total:i {RATE_COLS}", f"SELECT *, tp + fp + tn + fn AS total, {RATES_SQL} FROM (SELECT {TAG_CELLS} FROM tagged)", "tagged")
def flow_confusion(spark, sf):
    return CF.flow_confusion(CF.flow_index(C.flows(spark, sf)), C.alert_ids(spark, sf))


SLICE_SQL = """, slice_f AS (SELECT * FROM flows WHERE day IN ('Monday', 'Tuesday', 'Wednesday')),
slice_ids AS (SELECT DISTINCT flow_id FROM slice_f),
uni AS (SELECT count(*) FILTER (WHERE label <> 'BENIGN') AS ua, count(*) FILTER (WHERE label = 'BENIGN') AS ub FROM flows WHERE flow_id IN (SELECT flow_id FROM slice_ids)),
ipx AS (SELECT src_ip AS ip, max(CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END) AS is_attack FROM flows GROUP BY src_ip)"""


def _slice(spark, sf):
    f = C.flows(spark, sf)
    s = f.filter(F.col("day").isin("Monday", "Tuesday", "Wednesday"))
    return J.slice_universe(CF.flow_index(f), CF.ip_index(f), s.select("flow_id"), s.select(F.col("src_ip").alias("ip")))


@query("slice_universe", "matched_flows:i attack_rows:i benign_rows:i src_ips_seen:i attack_ips:i benign_ips:i", SLICE_SQL + """
--result
SELECT (SELECT count(*) FROM slice_ids) AS matched_flows, ua AS attack_rows, ub AS benign_rows,
  (SELECT count(DISTINCT src_ip) FROM slice_f) AS src_ips_seen,
  (SELECT count(*) FROM ipx WHERE is_attack = 1 AND ip IN (SELECT src_ip FROM slice_f)) AS attack_ips,
  (SELECT count(*) FROM ipx WHERE is_attack = 0 AND ip IN (SELECT src_ip FROM slice_f)) AS benign_ips FROM uni""", "flows")
def slice_universe(spark, sf):
    return _slice(spark, sf)


@query("flow_confusion_slice", f"{CELLS} total:i {RATE_COLS}", SLICE_SQL + f"""
--result
SELECT *, tp + fp + tn + fn AS total, {RATES_SQL} FROM (SELECT tp, fp, greatest(ub - fp, 0) AS tn, greatest(ua - tp, 0) AS fn
  FROM (SELECT {TAG_CELLS} FROM tagged), uni)""", "tagged")
def flow_confusion_slice(spark, sf):
    return CF.flow_confusion(CF.flow_index(C.flows(spark, sf)), C.alert_ids(spark, sf), _slice(spark, sf))


ALERTED_IPS = "SELECT DISTINCT src_ip AS ip FROM alerts WHERE src_ip NOT LIKE '224.%'"


@query("ip_confusion", f"{CELLS} total:i {RATE_COLS}", f""", ipx AS (SELECT src_ip AS ip, max(CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END) AS is_attack FROM flows GROUP BY src_ip),
hit AS ({ALERTED_IPS})
--result
SELECT *, tp + fp + tn + fn AS total, {RATES_SQL} FROM (SELECT {_cells("ip IN (SELECT ip FROM hit)", "is_attack = 1")} FROM ipx)""", "alerts")
def ip_confusion(spark, sf):
    return CF.ip_confusion(CF.ip_index(C.flows(spark, sf)), CF.alerted_ips(C.alerts(spark, sf)))


@query("ip_confusion_slice", f"{CELLS} total:i {RATE_COLS}", SLICE_SQL + f""", hit AS ({ALERTED_IPS}),
tot AS (SELECT count(*) FILTER (WHERE is_attack = 1) AS na, count(*) FILTER (WHERE is_attack = 0) AS nb FROM ipx WHERE ip IN (SELECT src_ip FROM slice_f))
--result
SELECT *, tp + fp + tn + fn AS total, {RATES_SQL} FROM (SELECT tp, fp, greatest(nb - fp, 0) AS tn, greatest(na - tp, 0) AS fn FROM (
  SELECT least(count(*) FILTER (WHERE is_attack = 1), any_value(na)) AS tp, least(count(*) FILTER (WHERE is_attack = 0), any_value(nb)) AS fp,
  any_value(na) AS na, any_value(nb) AS nb FROM ipx, tot WHERE ip IN (SELECT ip FROM hit)))""", "alerts")
def ip_confusion_slice(spark, sf):
    return CF.ip_confusion(CF.ip_index(C.flows(spark, sf)), CF.alerted_ips(C.alerts(spark, sf)), _slice(spark, sf))


KNOWN_SQL = """, best AS (SELECT day, src_ip AS ip, max(score) AS score FROM flows WHERE alerted GROUP BY ALL),
known AS (SELECT DISTINCT day, src_ip AS ip FROM flows WHERE label = 'PortScan' AND day IN ('Tuesday', 'Friday') AND score >= 0.5)"""


def _known(spark, sf):
    return C.flows(spark, sf).filter("label = 'PortScan' AND day IN ('Tuesday', 'Friday') AND score >= 0.5").select(
        "day", F.col("src_ip").alias("ip")).distinct()


def _best(spark, sf):
    return C.flows(spark, sf).filter("alerted").select("day", F.col("src_ip").alias("ip"), "score")


@query("known_ip_confusion", "day tp:i fp:i fn:i precision:d recall:d f1:d", KNOWN_SQL + """
--result
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1
  FROM (SELECT coalesce(b.day, k.day) AS day, count(*) FILTER (WHERE b.ip IS NOT NULL AND k.ip IS NOT NULL) AS tp,
  count(*) FILTER (WHERE k.ip IS NULL) AS fp, count(*) FILTER (WHERE b.ip IS NULL) AS fn
  FROM best b FULL JOIN known k ON b.day = k.day AND b.ip = k.ip GROUP BY 1)""", "flows")
def known_ip_confusion(spark, sf):
    return CF.known_ip_confusion(_best(spark, sf), _known(spark, sf))


@query("engine_confusion", f"engine metric_level {CELLS} total:i accuracy:d4 precision:d4 recall:d4 f1:d4 fpr:d4", f""", engines AS (SELECT DISTINCT gid FROM alerts),
ipx AS (SELECT src_ip AS ip, max(CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END) AS is_attack FROM flows GROUP BY src_ip),
fl AS (SELECT gid, {_cells("EXISTS (SELECT 1 FROM alert_ids a WHERE a.gid = e.gid AND a.flow_id = f.flow_id)")} FROM flows f, engines e WHERE gid IN (301, 1) GROUP BY gid),
il AS (SELECT gid, {_cells("EXISTS (SELECT 1 FROM alerts a WHERE a.gid = e.gid AND a.src_ip = ip)", "is_attack = 1")} FROM ipx, engines e WHERE gid NOT IN (301, 1) GROUP BY gid)
--result
SELECT CASE gid WHEN 301 THEN 'xgboost' WHEN 302 THEN 'portscan' WHEN 303 THEN 'dos_agg' WHEN 304 THEN 'ddos' WHEN 306 THEN 'bot' WHEN 307 THEN 'bruteforce' ELSE 'community' END AS engine,
  CASE WHEN gid IN (301, 1) THEN 'flow' ELSE 'ip' END AS metric_level, tp, fp, tn, fn, tp + fp + tn + fn AS total, {RATES_SQL}
  FROM (SELECT * FROM fl UNION ALL SELECT * FROM il)""", "alert_ids")
def engine_confusion(spark, sf):
    return CF.engine_confusion(C.flows(spark, sf), C.enriched(spark, sf), digits=None)


@query("ensemble_confusion", f"combo {CELLS} total:i {RATE_COLS}", f""", fl AS (SELECT f.label, EXISTS (SELECT 1 FROM alert_ids a WHERE a.flow_id = f.flow_id AND gid IN (302, 303)) AS a,
  EXISTS (SELECT 1 FROM alert_ids a WHERE a.flow_id = f.flow_id AND gid IN (304, 306)) AS b,
  EXISTS (SELECT 1 FROM alert_ids a WHERE a.flow_id = f.flow_id AND gid IN (301, 307, 1)) AS c FROM flows f),
combos AS (SELECT 'LSTM' AS combo, label, a AS hit FROM fl UNION ALL SELECT 'XGBoost', label, b FROM fl UNION ALL SELECT 'Community', label, c FROM fl
  UNION ALL SELECT 'ML Ensemble', label, a OR b FROM fl UNION ALL SELECT 'LSTM+Community', label, a OR c FROM fl
  UNION ALL SELECT 'XGB+Community', label, b OR c FROM fl UNION ALL SELECT 'Full Ensemble', label, a OR b OR c FROM fl)
--result
SELECT *, tp + fp + tn + fn AS total, {RATES_SQL} FROM (SELECT combo, {_cells("hit")} FROM combos GROUP BY combo)""", "alert_ids")
def ensemble_confusion(spark, sf):
    member = F.when(F.col("gid").isin(302, 303), "a").when(F.col("gid").isin(304, 306), "b").otherwise("c")
    ids = CF.alert_flow_ids(C.alerts(spark, sf).withColumn("member", member), ["member"])
    return CF.ensemble_confusion(CF.flow_index(C.flows(spark, sf)), ids)


@query("confusion_by_file", f"csv_source {CELLS} total:i {RATE_COLS}", f"""SELECT *, tp + fp + tn + fn AS total, {RATES_SQL} FROM (SELECT concat(day, '.csv') AS csv_source, {TAG_CELLS}
  FROM tagged GROUP BY day UNION ALL SELECT NULL, {TAG_CELLS} FROM tagged)""", "tagged")
def confusion_by_file(spark, sf):
    return CF.confusion_by(C.tagged(spark, sf).withColumn("csv_source", F.concat("day", F.lit(".csv"))), "csv_source", with_total=True)


@query("confusion_by_day", f"day {CELLS} total:i {RATE_COLS}", f"SELECT *, tp + fp + tn + fn AS total, {RATES_SQL} FROM (SELECT day, {TAG_CELLS} FROM tagged GROUP BY day)", "tagged")
def confusion_by_day(spark, sf):
    return CF.confusion_by(C.tagged(spark, sf), "day")


@query("detection_by_label", "day label detected:i total:i rate:d", """SELECT day, label, count(*) FILTER (WHERE tag IN ('TP', 'FP')) AS detected, count(*) AS total,
  count(*) FILTER (WHERE tag IN ('TP', 'FP')) / count(*) AS rate FROM tagged GROUP BY ALL""", "tagged")
def detection_by_label(spark, sf):
    return CF.detection_by_label(C.tagged(spark, sf), "day")


@query("confusion_by_category", f"category {CELLS} attacks:i recall:d passed:i", f"""SELECT *, tp + fn AS attacks, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN tp + fn > 0 THEN CASE WHEN tp / (tp + fn) >= 0.5 THEN 1 ELSE 0 END END AS passed
  FROM (SELECT concat(label, '/', proto) AS category, {_cells("score >= 0.5")} FROM flows GROUP BY ALL)""", "flows")
def confusion_by_category(spark, sf):
    s = C.scored(spark, sf).withColumn("category", F.concat_ws("/", "label", F.col("proto").cast("string")))
    return CF.confusion_by_category(s, 0.5, floor=0.5)


@query("master_table", "model day tp:i fp:i tn:i fn:i precision:d recall:d f1:d", KNOWN_SQL + f"""
--result
SELECT 'per_flow' AS model, day, tp, fp, tn, fn, precision, recall, f1 FROM (SELECT *, {RATES_SQL} FROM (SELECT day, {TAG_CELLS} FROM tagged GROUP BY day))
UNION ALL SELECT 'portscan', day, tp, fp, NULL, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END,
  CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END
  FROM (SELECT coalesce(b.day, k.day) AS day, count(*) FILTER (WHERE b.ip IS NOT NULL AND k.ip IS NOT NULL) AS tp,
  count(*) FILTER (WHERE k.ip IS NULL) AS fp, count(*) FILTER (WHERE b.ip IS NULL) AS fn
  FROM best b FULL JOIN known k ON b.day = k.day AND b.ip = k.ip GROUP BY 1)""", "tagged")
def master_table(spark, sf):
    return CF.master_table({"per_flow": CF.confusion_by(C.tagged(spark, sf), "day"),
                            "portscan": CF.known_ip_confusion(_best(spark, sf), _known(spark, sf))})


GRID = [round(0.05 * i, 2) for i in range(1, 20)]
SWEEP_SQL = f""", grid AS (SELECT unnest({GRID}) AS threshold),
sweep AS (SELECT *, tp + fp + tn + fn AS total, {RATES_SQL} FROM (SELECT CAST(threshold AS DOUBLE) AS threshold, {_cells("score >= threshold")} FROM flows, grid GROUP BY threshold))"""


@query("threshold_sweep", f"threshold:d {CELLS} total:i {RATE_COLS}", SWEEP_SQL + "\n--result\nSELECT * FROM sweep", "flows")
def threshold_sweep(spark, sf):
    return SW.threshold_sweep(C.scored(spark, sf), GRID)


@query("threshold_sweep_by_ip", "threshold:d tp:i fp:i fn:i benign_fp:i precision:d recall:d f1:d", KNOWN_SQL.replace("WHERE alerted ", "") + f""", grid AS (SELECT unnest({GRID}) AS threshold),
x AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE b.score >= threshold AND k.ip IS NOT NULL) AS tp,
  count(*) FILTER (WHERE b.score >= threshold AND k.ip IS NULL) AS fp, count(*) FILTER (WHERE coalesce(b.score < threshold, true) AND k.ip IS NOT NULL) AS fn,
  count(*) FILTER (WHERE b.score >= threshold AND b.day NOT IN ('Tuesday', 'Friday')) AS benign_fp
  FROM best b FULL JOIN known k ON b.day = k.day AND b.ip = k.ip, grid GROUP BY threshold)
--result
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM x""", "flows")
def threshold_sweep_by_ip(spark, sf):
    return SW.threshold_sweep_by_ip(C.flows(spark, sf).select("day", F.col("src_ip").alias("ip"), "score"), _known(spark, sf), GRID)


@query("best_threshold", "rule threshold:d tp:i fp:i", SWEEP_SQL + """
--result
(SELECT 'f1' AS rule, threshold, tp, fp FROM sweep ORDER BY f1 DESC, threshold LIMIT 1)
UNION ALL (SELECT 'precision', threshold, tp, fp FROM sweep WHERE recall >= 0.5 ORDER BY precision DESC, threshold LIMIT 1)
UNION ALL (SELECT 'low_fp', threshold, tp, fp FROM sweep WHERE recall >= 1.0 ORDER BY fp, threshold LIMIT 1)""", "flows")
def best_threshold(spark, sf):
    s = SW.threshold_sweep(C.scored(spark, sf), GRID)
    pick = lambda rule: SW.best_threshold(s, rule, 0.5).withColumn("rule", F.lit(rule))
    return pick("f1").unionByName(pick("precision")).unionByName(pick("low_fp"))


def _scored_windows(spark, sf):
    """Weekly SYN windows with a rule score and the days' alerts."""
    w = WN.syn_window_features(C.packets(spark, sf), C.WEEK)
    return w.withColumn("score", F.least(F.lit(1.0), F.col("dst_ports") / 8.0)).withColumn(
        "is_attack", (F.col("dst_ips") >= 3).cast("int")).withColumn("alerted", F.col("score") > 0.3).withColumn(
        "day", F.date_format(F.timestamp_seconds("win_start"), "yyyy-MM-dd"))


WINDOWS_SQL = SYN_SQL + """, sw AS (SELECT *, least(1.0, dst_ports / 8.0) AS score, CASE WHEN dst_ips >= 3 THEN 1 ELSE 0 END AS is_attack,
  least(1.0, dst_ports / 8.0) > 0.3 AS alerted, strftime(make_timestamp(win_start * 1000000), '%Y-%m-%d') AS day FROM syn7),
attackers AS (SELECT DISTINCT src_ip FROM sw WHERE is_attack = 1)"""


def _attackers(spark, sf):
    return _scored_windows(spark, sf).filter("is_attack = 1").select("src_ip").distinct()


@query("gate_sweep", "min_ports:i threshold:d tp:i fp:i attack_windows:i recall:d status", WINDOWS_SQL + """, g AS (SELECT p AS min_ports, CAST(t AS DOUBLE) AS threshold FROM (SELECT unnest([1,2,3,4]) AS p), (SELECT unnest([0.1, 0.2, 0.3]) AS t))
--result
SELECT *, tp / attack_windows AS recall, CASE WHEN tp / attack_windows >= 0.85 AND fp = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT min_ports, threshold, count(*) FILTER (WHERE is_attack = 1 AND dst_ports >= min_ports AND score > threshold) AS tp,
  count(*) FILTER (WHERE is_attack = 0 AND dst_ports >= min_ports AND score > threshold) AS fp,
  count(*) FILTER (WHERE is_attack = 1) AS attack_windows FROM sw, g GROUP BY ALL)""", "packets")
def gate_sweep(spark, sf):
    return SW.gate_sweep(_scored_windows(spark, sf), (1, 2, 3, 4), (0.1, 0.2, 0.3))


@query("window_recall", "eligible_windows:i alerted_windows:i attack_syns:i covered_syns:i fp_windows:i window_recall:d syn_coverage:d", WINDOWS_SQL + """
--result
SELECT *, alerted_windows / eligible_windows AS window_recall, covered_syns / attack_syns AS syn_coverage FROM (
  SELECT count(*) FILTER (WHERE k AND syn_count >= 2) AS eligible_windows, count(*) FILTER (WHERE k AND syn_count >= 2 AND alerted) AS alerted_windows,
  sum(syn_count) FILTER (WHERE k) AS attack_syns, sum(syn_count) FILTER (WHERE k AND alerted) AS covered_syns, count(*) FILTER (WHERE NOT k AND alerted) AS fp_windows
  FROM (SELECT *, src_ip IN (SELECT src_ip FROM attackers) AS k FROM sw))""", "packets")
def window_recall(spark, sf):
    return R.window_recall(_scored_windows(spark, sf), _attackers(spark, sf), 2)


@query("alert_windows_by_ip", "src_ip evaluated:i alert_windows:i mean_score:d is_fp:i", WINDOWS_SQL + """
--result
SELECT src_ip, count(*) AS evaluated, count(*) FILTER (WHERE alerted) AS alert_windows, coalesce(avg(score) FILTER (WHERE alerted), 0) AS mean_score,
  CASE WHEN src_ip NOT IN (SELECT src_ip FROM attackers) AND count(*) FILTER (WHERE alerted) > 0 THEN 1 ELSE 0 END AS is_fp FROM sw GROUP BY src_ip""", "packets")
def alert_windows_by_ip(spark, sf):
    return R.alert_windows_by_ip(_scored_windows(spark, sf), _attackers(spark, sf))


@query("window_totals_by_day", "day windows:i attacker_windows:i alerts:i attacker_alerts:i other_alerts:i", WINDOWS_SQL + """, m AS (SELECT *, src_ip IN (SELECT src_ip FROM attackers) AS k FROM sw)
--result
SELECT day, count(*) AS windows, count(*) FILTER (WHERE k) AS attacker_windows, count(*) FILTER (WHERE alerted) AS alerts,
  count(*) FILTER (WHERE k AND alerted) AS attacker_alerts, count(*) FILTER (WHERE NOT k AND alerted) AS other_alerts FROM m GROUP BY ROLLUP (day)""", "packets")
def window_totals_by_day(spark, sf):
    return R.window_totals_by_day(_scored_windows(spark, sf), _attackers(spark, sf))


@query("scan_detection", f"{CELLS} total:i {RATE_COLS}", SYN_SQL + f""", attackers AS (SELECT DISTINCT src_ip FROM packets WHERE proto = 6 AND flags IN (0, 41)),
hit AS (SELECT DISTINCT src_ip FROM syn7 WHERE syn_count >= 2 AND dst_ports >= 2 AND port_entropy > 0.5)
--result
SELECT *, tp + fp + tn + fn AS total, {RATES_SQL} FROM (SELECT {_cells("src_ip IN (SELECT src_ip FROM hit)", "src_ip IN (SELECT src_ip FROM attackers)")}
  FROM (SELECT DISTINCT src_ip FROM packets WHERE proto = 6))""", "packets")
def scan_detection(spark, sf):
    """Which sources scanned, and how often were we right? Truth here: sources that also sent NULL or XMAS probes."""
    p = C.packets(spark, sf).filter("proto = 6")
    alerts = WN.syn_window_features(p, C.WEEK, min_syns=2).filter("dst_ports >= 2 AND port_entropy > 0.5")
    truth = p.groupBy(F.col("src_ip").alias("ip")).agg(F.max(F.col("flags").isin(0, 41).cast("int")).alias("is_attack"))
    return CF.ip_confusion(truth, alerts.select(F.col("src_ip").alias("ip")))


@query("near_threshold", "score:d windows:i sources:i", "SELECT score, count(*) AS windows, count(DISTINCT src_ip) AS sources FROM flows WHERE score >= 0.6 AND score < 0.85 GROUP BY score", "flows")
def near_threshold(spark, sf):
    return SW.near_threshold(C.flows(spark, sf), 0.6, 0.85)


@query("alert_noise", "total_alerts:i on_attack_ips:i benign_alerts:i noise_share:d", """, bad AS (SELECT DISTINCT src_ip AS ip FROM flows WHERE label = 'PortScan')
--result
SELECT *, benign_alerts / total_alerts AS noise_share FROM (SELECT count(*) AS total_alerts, count(*) FILTER (WHERE h) AS on_attack_ips, count(*) FILTER (WHERE NOT h) AS benign_alerts
  FROM (SELECT src_ip IN (SELECT ip FROM bad) OR dst_ip IN (SELECT ip FROM bad) AS h FROM alerts WHERE gid = 1))""", "alerts")
def alert_noise(spark, sf):
    bad = C.flows(spark, sf).filter("label = 'PortScan'").select(F.col("src_ip").alias("ip")).distinct()
    return R.alert_noise(C.alerts(spark, sf).filter("gid = 1"), bad)


# ------------------------------------------------------------------ diagnostics

@query("tag_flows", "row_key tag", "SELECT row_key, tag FROM tagged", "tagged")
def tag_flows(spark, sf):
    return C.tagged(spark, sf)


@query("fp_artifacts", "total_fp:i short_1pkt:i short_2pkt:i one_pkt:i two_pkt:i short:i pct_strict:d pct_loose:d", """SELECT count(*) AS total_fp,
  count(*) FILTER (WHERE dur < 10000 AND spkts + dpkts <= 1) AS short_1pkt, count(*) FILTER (WHERE dur < 10000 AND spkts + dpkts <= 2) AS short_2pkt,
  count(*) FILTER (WHERE spkts + dpkts <= 1) AS one_pkt, count(*) FILTER (WHERE spkts + dpkts <= 2) AS two_pkt, count(*) FILTER (WHERE dur < 10000) AS short,
  round(100 * count(*) FILTER (WHERE dur < 10000 AND spkts + dpkts <= 1) / count(*), 1) AS pct_strict, round(100 * count(*) FILTER (WHERE dur < 10000) / count(*), 1) AS pct_loose
  FROM tagged WHERE tag = 'FP'""", "tagged")
def fp_artifacts(spark, sf):
    return D.fp_artifacts(C.tagged(spark, sf))


@query("fp_top_ports", "dst_port:i n:i share:d rank:i", """SELECT dst_port, count(*) AS n, count(*) / sum(count(*)) OVER () AS share,
  row_number() OVER (ORDER BY count(*) DESC, dst_port) AS rank FROM tagged WHERE tag = 'FP' GROUP BY dst_port QUALIFY rank <= 5""", "tagged")
def fp_top_ports(spark, sf):
    return D.fp_top_ports(C.tagged(spark, sf), 5)


@query("top_ports", "label dst_port:i n:i share:d rank:i", """SELECT label, dst_port, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY label) AS share,
  row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, dst_port) AS rank FROM flows GROUP BY label, dst_port QUALIFY rank <= 3""", "flows")
def top_ports(spark, sf):
    return D.top_ports(C.flows(spark, sf), 3, ["label"])


BUCKET = "CASE WHEN p = 1 THEN '1' WHEN p = 2 THEN '2' WHEN p BETWEEN 3 AND 5 THEN '3-5' WHEN p BETWEEN 6 AND 10 THEN '6-10' WHEN p BETWEEN 11 AND 50 THEN '11-50' ELSE '50+' END"


@query("packet_buckets", "bucket n:i share:d", f"SELECT bucket, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM (SELECT {BUCKET} AS bucket FROM (SELECT spkts + dpkts AS p FROM tagged WHERE tag = 'FP')) GROUP BY bucket", "tagged")
def packet_buckets(spark, sf):
    return D.packet_buckets(C.tagged(spark, sf).filter("tag = 'FP'"))


@query("packet_cohorts", "bucket n:i share:d", "SELECT bucket, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM (SELECT CASE WHEN p <= 3 THEN 'short' WHEN p <= 20 THEN 'medium' ELSE 'long' END AS bucket FROM (SELECT spkts + dpkts AS p FROM tagged WHERE tag = 'FP')) GROUP BY bucket", "tagged")
def packet_cohorts(spark, sf):
    return D.packet_buckets(C.tagged(spark, sf).filter("tag = 'FP'"), D.COHORTS)


FOUR = ["dur", "sbytes", "dpkts", "swin"]


@query("cohort_medians", "feature median_a:d median_b:d ratio:d", f"""SELECT feature, a AS median_a, b AS median_b, CASE WHEN b <> 0 THEN a / b END AS ratio FROM (
  SELECT feature, quantile_cont(value, 0.5) FILTER (WHERE tag = 'FP') AS a, quantile_cont(value, 0.5) FILTER (WHERE tag = 'TN') AS b
  FROM ({C.long_sql('tagged', 'tag', FOUR)}) GROUP BY feature)""", "tagged")
def cohort_medians(spark, sf):
    return D.cohort_medians(C.tagged(spark, sf), FOUR)


@query("label_medians", "label feature median:d", f"SELECT label, feature, quantile_cont(value, 0.5) AS median FROM ({C.long_sql('flows', 'label', FOUR)}) GROUP BY ALL", "flows")
def label_medians(spark, sf):
    return D.label_medians(C.flows(spark, sf), FOUR)


@query("group_profile", "tag n:i min:d max:d mean:d p25:d median:d p75:d band_0:d band_1:d band_2:d", """SELECT tag, count(*) AS n, min(swin) AS min, max(swin) AS max, avg(swin) AS mean, quantile_cont(swin, 0.25) AS p25,
  quantile_cont(swin, 0.5) AS median, quantile_cont(swin, 0.75) AS p75, avg(CASE WHEN swin < 5000 THEN 1 ELSE 0 END) AS band_0,
  avg(CASE WHEN swin >= 5000 AND swin < 15000 THEN 1 ELSE 0 END) AS band_1, avg(CASE WHEN swin >= 15000 THEN 1 ELSE 0 END) AS band_2 FROM tagged GROUP BY tag""", "tagged")
def group_profile(spark, sf):
    return D.group_profile(C.tagged(spark, sf), "swin", bands=(5000, 15000))


@query("flag_profile", "tag syn:d fin:d rst:d ack:d psh:d syn_only:d", """SELECT tag, avg(syn_cnt) AS syn, avg(fin_cnt) AS fin, avg(rst_cnt) AS rst, avg(ack_cnt) AS ack, avg(psh_cnt) AS psh,
  avg(CASE WHEN syn_cnt > 0 AND fin_cnt = 0 AND rst_cnt = 0 AND ack_cnt - 1 = 0 THEN 1 ELSE 0 END) AS syn_only FROM tagged GROUP BY tag""", "tagged")
def flag_profile(spark, sf):
    # the flows carry at least one ACK each, so the handshake one is taken off first
    t = C.tagged(spark, sf)
    p = D.flag_profile(t.withColumn("ack_cnt", F.col("ack_cnt") - 1))
    return p.withColumn("ack", F.col("ack") + 1)


@query("separability", "feature n_a:i n_b:i mean_a:d5 mean_b:d5 d:d", f"""SELECT feature, n_a, n_b, mean_a, mean_b, abs(mean_a - mean_b) / sqrt((s_a * s_a + s_b * s_b) / 2) AS d FROM (
  SELECT feature, count(*) FILTER (WHERE tag = 'FP') AS n_a, count(*) FILTER (WHERE tag = 'TP') AS n_b, avg(value) FILTER (WHERE tag = 'FP') AS mean_a,
  avg(value) FILTER (WHERE tag = 'TP') AS mean_b, stddev_samp(value) FILTER (WHERE tag = 'FP') AS s_a, stddev_samp(value) FILTER (WHERE tag = 'TP') AS s_b
  FROM ({C.long_sql('tagged', 'tag', FOUR + ['score', 'syn_cnt'])}) GROUP BY feature)""", "tagged")
def separability(spark, sf):
    return D.separability(C.tagged(spark, sf), FOUR + ["score", "syn_cnt"])


@query("enrichment", "rate_a:d rate_b:d enrichment:d", """SELECT a AS rate_a, b AS rate_b, a / b AS enrichment FROM (SELECT avg(CASE WHEN swin > 1020 THEN 1 ELSE 0 END) FILTER (WHERE tag = 'FP') AS a,
  avg(CASE WHEN swin > 1020 THEN 1 ELSE 0 END) FILTER (WHERE tag = 'TN') AS b FROM tagged)""", "tagged")
def enrichment(spark, sf):
    return D.enrichment(C.tagged(spark, sf), "swin", 1020)


@query("point_biserial", "r:d n:i", "SELECT corr(swin, CASE WHEN tag = 'FP' THEN 1 ELSE 0 END) AS r, count(*) AS n FROM tagged WHERE tag IN ('FP', 'TN')", "tagged")
def point_biserial(spark, sf):
    return D.point_biserial(C.tagged(spark, sf), "swin")


@query("dominant_pattern", "total_fp:i top_port:i top_port_pct:d short_pct:d pattern", """, p AS (SELECT dst_port, count(*) AS n, count(*) FILTER (WHERE spkts + dpkts <= 2) AS s FROM tagged WHERE tag = 'FP' GROUP BY dst_port)
--result
SELECT *, CASE WHEN top_port_pct >= 60 THEN 'P1 port concentration' WHEN short_pct >= 70 THEN 'P2 short-flow concentration' ELSE 'P4 mixed' END AS pattern
  FROM (SELECT sum(n) AS total_fp, (SELECT dst_port FROM p ORDER BY n DESC, dst_port LIMIT 1) AS top_port, 100 * max(n) / sum(n) AS top_port_pct, 100 * sum(s) / sum(n) AS short_pct FROM p)""", "tagged")
def dominant_pattern(spark, sf):
    return D.dominant_pattern(C.tagged(spark, sf))


@query("postfilter_simulation", "rule fp_removed:i tp_lost:i remaining_fp:i remaining_fpr:d remaining_recall:d is_best:i", f""", t AS (SELECT {TAG_CELLS} FROM tagged),
r AS (SELECT 'Rule 1' AS rule, dst_port = 53 AS h, tag FROM tagged UNION ALL SELECT 'Rule 2', dst_port IN (53, 137), tag FROM tagged
  UNION ALL SELECT 'Rule 3', dst_port IN (53, 137, 389), tag FROM tagged UNION ALL SELECT 'Rule 4', dst_port IN (53, 137, 389) AND spkts + dpkts <= 5, tag FROM tagged),
c AS (SELECT rule, count(*) FILTER (WHERE h AND tag = 'FP') AS fp_removed, count(*) FILTER (WHERE h AND tag = 'TP') AS tp_lost FROM r GROUP BY rule),
x AS (SELECT rule, fp_removed, tp_lost, fp - fp_removed AS remaining_fp, (fp - fp_removed) / (fp + tn) AS remaining_fpr, (tp - tp_lost) / (tp + fn) AS remaining_recall FROM c, t)
--result
SELECT *, CASE WHEN tp_lost = 0 AND row_number() OVER (ORDER BY tp_lost > 0, remaining_fpr, rule) = 1 THEN 1 ELSE 0 END AS is_best FROM x""", "tagged")
def postfilter_simulation(spark, sf):
    return D.postfilter_simulation(C.tagged(spark, sf))


@query("score_profile", "tag n:i mean:d above_90:i above_95:i above_99:i p10:d p25:d p50:d p75:d p90:d", """SELECT tag, count(*) AS n, avg(score) AS mean, count(*) FILTER (WHERE score >= 0.9) AS above_90,
  count(*) FILTER (WHERE score >= 0.95) AS above_95, count(*) FILTER (WHERE score >= 0.99) AS above_99, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.25) AS p25,
  quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.75) AS p75, quantile_cont(score, 0.9) AS p90 FROM tagged GROUP BY tag""", "tagged")
def score_profile(spark, sf):
    return SW.score_profile(C.tagged(spark, sf), "tag")


@query("score_histogram", "bin:i lo:d hi:d n:i", """, e AS (SELECT unnest([0,1,2,3,4,5]) AS bin, CAST(unnest([0,0.5,0.8,0.9,0.95,0.99]) AS DOUBLE) AS lo, CAST(unnest([0.5,0.8,0.9,0.95,0.99,1.0]) AS DOUBLE) AS hi)
--result
SELECT bin, lo, hi, count(f.score) AS n FROM e LEFT JOIN flows f ON f.score >= lo AND (f.score < hi OR (bin = 5 AND f.score <= hi)) GROUP BY ALL""", "flows")
def score_histogram(spark, sf):
    return SW.score_histogram(C.flows(spark, sf))


@query("class_score_stats", "label n:i sources:i mean:d std:d min:d max:d share_high:d share_low:d", """SELECT label, count(*) AS n, count(DISTINCT src_ip) AS sources, avg(score) AS mean, stddev_samp(score) AS std, min(score) AS min, max(score) AS max,
  avg(CASE WHEN score > 0.95 THEN 1 ELSE 0 END) AS share_high, avg(CASE WHEN score < 0.5 THEN 1 ELSE 0 END) AS share_low FROM flows GROUP BY label""", "flows")
def class_score_stats(spark, sf):
    return SW.class_score_stats(C.flows(spark, sf), "label")


@query("constant_features", "feature distinct_values:i mean:d status", f"""SELECT feature, count(DISTINCT value) AS distinct_values, avg(value) AS mean, CASE WHEN count(DISTINCT value) = 1 THEN 'CONSTANT' ELSE 'VARIES' END AS status
  FROM ({C.long_sql('(SELECT *, 0 AS reserved FROM flows)', '', ['spkts', 'dpkts', 'syn_cnt', 'reserved'])}) GROUP BY feature""", "flows")
def constant_features(spark, sf):
    return D.constant_features(C.flows(spark, sf).withColumn("reserved", F.lit(0)), ["spkts", "dpkts", "syn_cnt", "reserved"])


@query("class_mean_ratio", "feature positive_mean:d5 other_mean:d5 ratio:d", f"""SELECT feature, p AS positive_mean, o AS other_mean, CASE WHEN o > 0 THEN p / o END AS ratio FROM (
  SELECT feature, avg(value) FILTER (WHERE label <> 'BENIGN') AS p, avg(value) FILTER (WHERE label = 'BENIGN') AS o FROM ({C.long_sql('flows', 'label', FOUR)}) GROUP BY feature)""", "flows")
def class_mean_ratio(spark, sf):
    return D.class_mean_ratio(C.flows(spark, sf), FOUR, F.col("label") != "BENIGN")


@query("feature_summary", "label feature mean:d4 std:d4 min:d max:d", f"SELECT label, feature, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM ({C.long_sql('flows', 'label', FOUR)}) GROUP BY ALL", "flows")
def feature_summary(spark, sf):
    return D.feature_summary(C.flows(spark, sf), FOUR, ["label"])


@query("packet_percentiles", "label p10:d p25:d p50:d p75:d p90:d p95:d", "SELECT label, " + ", ".join(
    f"quantile_cont(CAST(greatest(spkts + dpkts, 1) AS DOUBLE), 0.{p}) AS p{p}" for p in (10, 25, 50, 75, 90, 95)) + " FROM flows GROUP BY label", "flows")
def packet_percentiles(spark, sf):
    return D.packet_percentiles(C.flows(spark, sf))


@query("coverage_at", "label n:i max_pkt:i coverage:d chosen:i", """, c AS (SELECT label, count(*) AS n, max_pkt, avg(CASE WHEN greatest(spkts + dpkts, 1) <= max_pkt THEN 1 ELSE 0 END) AS coverage
  FROM flows, (SELECT unnest([2,4,6,8,10,14,20]) AS max_pkt) GROUP BY label, max_pkt)
--result
SELECT *, min(CASE WHEN coverage >= 0.3 THEN max_pkt END) OVER (PARTITION BY label) AS chosen FROM c""", "flows")
def coverage_at(spark, sf):
    return D.coverage_at(C.flows(spark, sf), target=0.3)


SKEW_PARAMS = {"syn_count": (0.7, 0.5), "dst_ports": (0.7, 0.5), "dst_ips": (0.7, 0.0), "port_entropy": (0.5, 1.0), "src_port_range": (100.0, 4000.0),
               "port_ratio": (0.9, 0.2), "rate": (0.000002, 0.000001)}


@query("train_serve_skew", "feature mean_diff:d max_diff:d verdict", SYN_SQL + """, d AS (
  SELECT 'syn_count' AS feature, 0.0 AS x FROM syn7 UNION ALL SELECT 'dst_ports', 0.0 FROM syn7 UNION ALL SELECT 'dst_ips', 0.0 FROM syn7 UNION ALL SELECT 'rate', 0.0 FROM syn7
  UNION ALL SELECT 'port_entropy', abs(ln(1 + port_entropy) - port_entropy) FROM syn7
  UNION ALL SELECT 'src_port_range', abs(ln(1 + src_port_range) - src_port_range) / 4000 FROM syn7
  UNION ALL SELECT 'port_ratio', abs(ln(1 + port_ratio) - port_ratio) / 0.2 FROM syn7)
--result
SELECT feature, avg(x) AS mean_diff, max(x) AS max_diff, CASE WHEN avg(avg(x)) OVER () > 0.05 THEN 'FIX_REQUIRED' WHEN avg(avg(x)) OVER () > 0.01 THEN 'FIX_RECOMMENDED' ELSE 'ACCEPTABLE' END AS verdict
  FROM d GROUP BY feature""", "packets")
def train_serve_skew(spark, sf):
    w = WN.syn_window_features(C.packets(spark, sf), C.WEEK)
    return D.train_serve_skew(w, list(SKEW_PARAMS), ("syn_count", "dst_ports", "dst_ips", "rate"), list(SKEW_PARAMS), SKEW_PARAMS)


CONTRIB_SQL = """, contrib AS (SELECT row_key, 'spkts' AS feature, CAST(spkts AS DOUBLE) AS raw_value, (spkts - 25) * 0.02 AS contribution, label FROM flows
  UNION ALL SELECT row_key, 'sbytes', sbytes, (sbytes - 38000) / 50000, label FROM flows UNION ALL SELECT row_key, 'dpkts', dpkts, (3 - dpkts) * 0.1, label FROM flows)"""


def _long(f):
    """A linear score split into its parts, in the long form the attribution job also writes."""
    parts = {"spkts": (F.col("spkts") - 25) * 0.02, "sbytes": (F.col("sbytes") - 38000) / 50000, "dpkts": (3 - F.col("dpkts")) * 0.1}
    return f.select("row_key", "label", F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("raw_value"), c.cast("double").alias("contribution"))
        for n, c in parts.items()])).alias("x")).select("row_key", "label", "x.*")


def _contributions(spark, sf):
    return _long(C.flows(spark, sf))


@query("shap_summary", "label feature mean_abs:d relative_pct:d rank:i", CONTRIB_SQL + """
--result
SELECT *, 100 * mean_abs / max(mean_abs) OVER (PARTITION BY label) AS relative_pct, row_number() OVER (PARTITION BY label ORDER BY mean_abs DESC, feature) AS rank
  FROM (SELECT label, feature, avg(abs(contribution)) AS mean_abs FROM contrib GROUP BY ALL)""", "flows")
def shap_summary(spark, sf):
    return D.shap_summary(_contributions(spark, sf), ["label"])


@query("shap_by_bin", "feature bin:i lo:d hi:d n:i mean_contribution:d", CONTRIB_SQL + """, q AS (SELECT feature, quantile_cont(raw_value, [0, 0.25, 0.5, 0.75, 1.0]) AS e FROM contrib GROUP BY feature),
b AS (SELECT feature, bin, e[bin] AS lo, e[bin + 1] AS hi FROM q, (SELECT unnest([1,2,3,4]) AS bin))
--result
SELECT b.feature, bin, lo, hi, count(*) AS n, avg(contribution) AS mean_contribution FROM b JOIN contrib c ON c.feature = b.feature AND raw_value BETWEEN lo AND hi GROUP BY ALL""", "flows")
def shap_by_bin(spark, sf):
    return D.shap_by_bin(_contributions(spark, sf))


@query("top_contributions", "row_key feature contribution:d rank:i", CONTRIB_SQL + """
--result
SELECT row_key, feature, contribution, row_number() OVER (PARTITION BY row_key ORDER BY abs(contribution) DESC, feature) AS rank
  FROM (SELECT DISTINCT row_key, feature, contribution FROM contrib) QUALIFY rank <= 2""", "flows")
def top_contributions(spark, sf):
    """Every flow has each feature once, so one flow per key is one row per key and feature. Keys meet before the features are
    spread out, as one short row each; ranking them then needs no further shuffle."""
    from tidewatch.models.explain import top_contributions as top
    one = C.flows(spark, sf).select("row_key", "label", "spkts", "sbytes", "dpkts").dropDuplicates(["row_key"])
    return top(_long(one), ["row_key"], 2)


@query("resource_summary", "run samples:i cpu_avg:d cpu_peak:d rss_avg_mb:d rss_peak_mb:d alerts:i alerts_per_sec:d", """SELECT day AS run, count(*) AS samples, avg(score * 100) AS cpu_avg, max(score * 100) AS cpu_peak, avg(swin) / 1024 AS rss_avg_mb,
  max(swin) / 1024 AS rss_peak_mb, count(*) FILTER (WHERE alerted) AS alerts, count(*) FILTER (WHERE alerted) / 86400 AS alerts_per_sec FROM flows GROUP BY day""", "flows")
def resource_summary(spark, sf):
    f = C.flows(spark, sf)
    samples = f.select(F.col("day").alias("run"), (F.col("score") * 100).alias("cpu"), F.col("swin").alias("rss_kb"))
    runs = f.groupBy(F.col("day").alias("run")).agg(F.count_if("alerted").alias("alerts")).withColumn("seconds", F.lit(86400))
    return D.resource_summary(samples, runs)


# ------------------------------------------------------------------ roll-ups

ENGINE = "CASE gid WHEN 301 THEN 'xgboost' WHEN 302 THEN 'portscan' WHEN 303 THEN 'dos_agg' WHEN 304 THEN 'ddos' WHEN 306 THEN 'bot' WHEN 307 THEN 'bruteforce' ELSE 'community' END"
LIVE_SQL = """live AS (SELECT event_id AS alert_id, ts_us, src_ip, dst_ip, dst_port, CASE flags WHEN 2 THEN 'portscan' WHEN 4 THEN 'community' WHEN 24 THEN 'bot' WHEN 18 THEN 'xgboost' ELSE 'dos_agg' END AS engine,
  payload_len, CASE flags WHEN 4 THEN 'benign' WHEN 2 THEN 'attack' END AS ground_truth FROM packets)"""


def live(spark, sf):
    """An alert stream with unique ids: every packet as one alert of the detector its flags stand for."""
    fl = F.col("flags")
    engine = F.when(fl == 2, "portscan").when(fl == 4, "community").when(fl == 24, "bot").when(fl == 18, "xgboost").otherwise("dos_agg")
    return C.packets(spark, sf).select(
        F.col("event_id").alias("alert_id"), "ts_us", "ts", "src_ip", "dst_ip", "dst_port", engine.alias("engine"), "payload_len",
        F.when(fl == 4, "benign").when(fl == 2, "attack").alias("ground_truth"))


@query("alerts_per_second", "sec:i engine n:i total:i is_peak:i", f""", {LIVE_SQL}, last AS (SELECT max(ts_us // 1000000) AS t, min(ts_us // 1000000) AS f FROM live),
axis AS (SELECT unnest(range(greatest(f, t - 7200 + 1), t + 1)) AS sec FROM last),
g AS (SELECT sec, engine, count(alert_id) AS n FROM (SELECT sec, engine FROM axis, (SELECT DISTINCT engine FROM live)) LEFT JOIN (SELECT ts_us // 1000000 AS sec, engine, alert_id FROM live) USING (sec, engine) GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY sec) AS total FROM g)
--result
SELECT *, CASE WHEN sec = (SELECT sec FROM t ORDER BY total DESC, sec LIMIT 1) THEN 1 ELSE 0 END AS is_peak FROM t""", "packets")
def alerts_per_second(spark, sf):
    return R.alerts_per_second(live(spark, sf), 7200)


@query("first_alert", "engine first_us:i alerts:i after_sec:d", f", {LIVE_SQL}\n--result\nSELECT engine, min(ts_us) AS first_us, count(*) AS alerts, (min(ts_us) - (SELECT min(ts_us) FROM live)) / 1e6 AS after_sec FROM live GROUP BY engine", "packets")
def first_alert(spark, sf):
    return R.first_alert(live(spark, sf))


@query("group_by_source", "src_ip windows:i alert_id:i engine dst_ip", f", {LIVE_SQL}\n--result\nSELECT src_ip, count(*) AS windows, min(alert_id) AS alert_id, arg_min(engine, alert_id) AS engine, arg_min(dst_ip, alert_id) AS dst_ip FROM live GROUP BY src_ip", "packets")
def group_by_source(spark, sf):
    return R.group_by_source(live(spark, sf))


@query("recent_alerts", "position:i rank:i engine alert_id:i", f""", {LIVE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY ts_us DESC, alert_id DESC) AS rank FROM live)
--result
SELECT *, row_number() OVER (ORDER BY CASE WHEN engine = 'community' THEN 1 ELSE 0 END, ts_us DESC, alert_id DESC) AS position FROM r WHERE rank <= CASE WHEN engine = 'community' THEN 20 ELSE 50 END""", "packets")
def recent_alerts(spark, sf):
    return R.recent_alerts(live(spark, sf), 50, 20)


@query("bounded_history", "engine alert_id:i", f""", {LIVE_SQL}
--result
SELECT engine, alert_id FROM live WHERE engine IN ('dos_agg', 'portscan', 'bruteforce', 'bot') UNION SELECT engine, alert_id FROM (SELECT * FROM live ORDER BY ts_us DESC, alert_id DESC LIMIT 1000)""", "packets")
def bounded_history(spark, sf):
    """The last 1000 alerts, and every window-level alert."""
    from tidewatch.functions.labels import WINDOW_ENGINES
    a = live(spark, sf).select("engine", "alert_id", "ts_us")
    last = a.orderBy(F.col("ts_us").desc(), F.col("alert_id").desc()).limit(1000)
    return a.filter(F.col("engine").isin(*WINDOW_ENGINES)).union(last).distinct()


@query("technique_counts", "mitre_tactic mitre_technique n:i share_of_max:d", """, m AS (SELECT CASE gid WHEN 301 THEN 'TA0040' WHEN 302 THEN 'TA0043' WHEN 303 THEN 'TA0040' WHEN 304 THEN 'TA0040' WHEN 306 THEN 'TA0011' WHEN 307 THEN 'TA0006' ELSE 'TA0001' END AS mitre_tactic,
  CASE gid WHEN 301 THEN 'T1499' WHEN 302 THEN 'T1046' WHEN 303 THEN 'T1498' WHEN 304 THEN 'T1498' WHEN 306 THEN 'T1071' WHEN 307 THEN 'T1110' ELSE 'T1190' END AS mitre_technique FROM alerts)
--result
SELECT mitre_tactic, mitre_technique, count(*) AS n, count(*) / max(count(*)) OVER () AS share_of_max FROM m GROUP BY ALL""", "alerts")
def technique_counts(spark, sf):
    return R.technique_counts(C.enriched(spark, sf))


@query("triage_savings", "scenario ml:i community:i alert_gap:i hours:i days:i saved_pct:d multiplier:d", """, b AS (SELECT day AS scenario, count(*) FILTER (WHERE alerted) AS ml, count(*) FILTER (WHERE score >= 0.3) AS community FROM flows GROUP BY day)
--result
SELECT scenario, ml, community, community - ml AS alert_gap, round((community - ml) * 3.0 / 60) AS hours, round((community - ml) * 3.0 / 60 / 8) AS days, 100 * (community - ml) / community AS saved_pct, community / ml AS multiplier FROM b""", "flows")
def triage_savings(spark, sf):
    b = C.flows(spark, sf).groupBy(F.col("day").alias("scenario")).agg(F.count_if("alerted").alias("ml"), F.count_if(F.col("score") >= 0.3).alias("community"))
    return R.triage_savings(b)


@query("alert_dedup", "alert_id:i engine ts_us:i", f", {LIVE_SQL}\n--result\nSELECT alert_id, engine, ts_us FROM live WHERE coalesce(ground_truth, '') <> 'benign'", "packets")
def alert_dedup(spark, sf):
    """Alerts delivered twice, the second copy a minute later."""
    a = live(spark, sf)
    return R.alert_dedup(a.unionByName(a.withColumn("ts_us", F.col("ts_us") + 60_000_000)))


@query("live_counters", "engine total:i unique_src:i", f", {LIVE_SQL}\n--result\nSELECT engine, count(*) AS total, count(DISTINCT src_ip) AS unique_src FROM live GROUP BY engine", "packets")
def live_counters(spark, sf):
    return R.live_counters(live(spark, sf))


@query("rule_id_counts", "month gid:i alerts:i", "SELECT ts_text[1:2] AS month, gid, count(*) AS alerts FROM alerts GROUP BY ALL", "alerts")
def rule_id_counts(spark, sf):
    return R.rule_id_counts(C.alerts(spark, sf).withColumn("month", F.substring("ts_text", 1, 2)), ["month", "gid"])


@query("rule_id_counts_listed", "gid:i src_ip alerts:i", "SELECT gid, src_ip, count(*) AS alerts FROM alerts WHERE src_ip IN (SELECT src_ip FROM flows WHERE label = 'PortScan') GROUP BY ALL", "alerts")
def rule_id_counts_listed(spark, sf):
    return R.rule_id_counts(C.alerts(spark, sf), ["gid"], C.flows(spark, sf).filter("label = 'PortScan'"))


@query("max_score_by_ip", "src_ip best_score:d day", "SELECT src_ip, max(score) AS best_score, arg_max(day, (score, -ts_us)) AS day FROM flows GROUP BY src_ip", "flows")
def max_score_by_ip(spark, sf):
    return R.max_score_by_ip(C.flows(spark, sf))


@query("union_sources", "csv_source n:i days:i", "SELECT csv_source, count(*) AS n, count(DISTINCT day) AS days FROM (SELECT 'early' AS csv_source, day FROM flows WHERE day IN ('Monday', 'Tuesday', 'Wednesday') UNION ALL SELECT 'late', NULL FROM flows WHERE day NOT IN ('Monday', 'Tuesday', 'Wednesday')) GROUP BY csv_source", "flows")
def union_sources(spark, sf):
    f = C.flows(spark, sf)
    early = F.col("day").isin("Monday", "Tuesday", "Wednesday")
    u = R.union_sources({"early": f.filter(early), "late": f.filter(~early).drop("day")})
    return u.groupBy("csv_source").agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"))


@query("alert_set_algebra", "either:i common:i only_a:i only_b:i", """, a AS (SELECT DISTINCT flow_id FROM alert_ids WHERE gid IN (301, 302, 303)), b AS (SELECT DISTINCT flow_id FROM alert_ids WHERE gid IN (303, 304, 306, 307, 1))
--result
SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS common,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b""", "alert_ids")
def alert_set_algebra(spark, sf):
    ids = CF.alert_flow_ids(C.alerts(spark, sf), ["gid"])
    return R.alert_set_algebra(ids.filter(F.col("gid").isin(301, 302, 303)).select("flow_id"), ids.filter(F.col("gid").isin(303, 304, 306, 307, 1)).select("flow_id"))


@query("rollup_totals", "day label n:i packets:i", "SELECT day, label, count(*) AS n, sum(spkts) AS packets FROM flows GROUP BY ROLLUP (day, label)", "flows")
def rollup_totals(spark, sf):
    return R.rollup_totals(C.flows(spark, sf), ["day", "label"], n=F.count("*"), packets=F.sum("spkts"))


@query("score_by_attack", "label n:i hits:i min:d max:d median:d recall:d precision:d status", """, b AS (SELECT count(*) FILTER (WHERE score > 0.55) AS fp FROM flows WHERE label = 'BENIGN')
--result
SELECT *, hits / n AS recall, hits / (hits + fp) AS precision, CASE WHEN hits / n >= 0.5 THEN 'good' WHEN hits / n >= 0.1 THEN 'medium' ELSE 'poor' END AS status FROM (
  SELECT label, count(*) AS n, count(*) FILTER (WHERE score > 0.55) AS hits, min(score) AS min, max(score) AS max, quantile_cont(score, 0.5) AS median FROM flows WHERE label <> 'BENIGN' GROUP BY label), b""", "flows")
def score_by_attack(spark, sf):
    return SW.score_by_attack(C.flows(spark, sf))


@query("calibration_curve", "bin:i n:i mean_score:d positive_share:d", """, s AS (SELECT sbytes / 110000 AS score, CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END AS y FROM flows),
e AS (SELECT list_distinct(quantile_cont(score, [i / 20 for i in range(21)])) AS e FROM s),
inner_edges AS (SELECT unnest(list_sort(e)[2:-2]) AS v FROM e),
x AS (SELECT score, y, (SELECT count(*) FROM inner_edges WHERE v < score) AS bin FROM s)
--result
SELECT bin, count(*) AS n, avg(score) AS mean_score, avg(y) AS positive_share FROM x GROUP BY bin""", "flows")
def calibration_curve(spark, sf):
    return SW.calibration_curve(C.scored(spark, sf).withColumn("score", F.col("sbytes") / 110000))


@query("roc_auc", "positives:i negatives:i auc:d", """, s AS (SELECT dbytes / 11000 AS score, CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END AS y FROM flows),
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM s)
--result
SELECT sum(y) AS positives, count(*) - sum(y) AS negatives, (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM r""", "flows")
def roc_auc(spark, sf):
    return SW.roc_auc(C.scored(spark, sf).withColumn("score", F.col("dbytes") / 11000))


@query("evaluate_model", f"{CELLS} total:i {RATE_COLS} benign_precision:d benign_recall:d benign_f1:d", f"""SELECT *, tp + fp + tn + fn AS total, {RATES_SQL}, tn / (tn + fn) AS benign_precision, tn / (tn + fp) AS benign_recall, 2 * tn / (2 * tn + fp + fn) AS benign_f1
  FROM (SELECT {_cells("score > 0.4")} FROM flows)""", "flows")
def evaluate_model(spark, sf):
    s = C.scored(spark, sf).withColumn("prediction", CF.score_at("score", 0.4).cast("int"))
    return CF.evaluate_model(s, "is_attack")


@query("score_at", "strict:i loose:i", "SELECT count(*) FILTER (WHERE score > 0.9) AS strict, count(*) FILTER (WHERE score >= 0.9) AS loose FROM flows", "flows")
def score_at(spark, sf):
    return C.flows(spark, sf).agg(F.count_if(CF.score_at("score", 0.9)).alias("strict"), F.count_if(CF.score_at("score", 0.9, strict=False)).alias("loose"))


@query("suppress_single_client", "dst_ip dst_port:i src_ips:i src_ports:i", """SELECT dst_ip, dst_port, src_ips, src_ports FROM (SELECT dst_ip, dst_port, count(DISTINCT src_ip) AS src_ips, count(DISTINCT src_port) AS src_ports
  FROM packets WHERE proto = 6 AND flags & 18 = 2 GROUP BY ALL) WHERE NOT (src_ips = 1 AND src_ports < 10) AND src_ports > 0""", "packets")
def suppress_single_client(spark, sf):
    from tidewatch.functions.labels import suppress_single_client as rule
    p = C.packets(spark, sf).filter("proto = 6 AND flags = 2")
    counts = WN.spread_axes(p, ["dst_ip", "dst_port"], {"ip": F.col("src_ip"), "port": F.col("src_port")})
    return rule(counts.groupBy("dst_ip", "dst_port").agg(WN.axis_distinct("ip").alias("src_ips"), WN.axis_distinct("port").alias("src_ports")))
