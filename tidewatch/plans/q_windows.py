"""Keyed aggregations to feature rows, and order-dependent rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.config import FLOW_FEATURES_11, FLOW_FEATURES_15
from tidewatch.functions import labels
from tidewatch.operators import flow_features as FF, rollups as R, sequence as S, windows as WN
from tidewatch.plans import q_common as C
from tidewatch.plans.registry import query

W = C.WEEK

# gap statistics of time lists, in SQL: cv over gaps >= lo, index quantiles over gaps >= qlo
GAPS_SQL = """gap_rows AS (SELECT {k}, ts_us - lag(ts_us) OVER (PARTITION BY {k} ORDER BY ts_us) AS g FROM ev),
gap_cv AS (SELECT {k}, CASE WHEN count(*) >= 2 THEN sqrt(greatest(avg(CAST(g AS DOUBLE) * g) - avg(g) * avg(g), 0)) / avg(g)
  ELSE 0 END AS iat_cv FROM gap_rows WHERE g >= {lo} GROUP BY {k}),
gap_sorted AS (SELECT {k}, g, row_number() OVER (PARTITION BY {k} ORDER BY g) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS n
  FROM gap_rows WHERE g >= {qlo}),
gap_q AS (SELECT {k}, max(CASE WHEN i = 9 * n // 10 THEN g END) / max(CASE WHEN i = n // 10 THEN g END) AS iat_q90_q10
  FROM gap_sorted WHERE n >= 4 GROUP BY {k})"""


def gaps_sql(k: str, lo: int = 1, qlo: int = 2) -> str:
    return GAPS_SQL.format(k=k, lo=lo, qlo=qlo)


SYN_SQL = f""", syn AS (SELECT *, ts_us // 1000000 // {W} * {W} AS win_start FROM packets WHERE proto = 6 AND flags & 22 = 2),
ports AS (SELECT src_ip, win_start, dst_port, count(*) AS c FROM syn GROUP BY ALL),
ent AS (SELECT src_ip, win_start, -sum(c / t * log2(c / t)) AS port_entropy FROM
  (SELECT *, sum(c) OVER (PARTITION BY src_ip, win_start) AS t FROM ports) GROUP BY ALL),
syn7 AS (SELECT src_ip, win_start, count(*) AS syn_count, count(DISTINCT dst_port) AS dst_ports, count(DISTINCT dst_ip) AS dst_ips,
  any_value(port_entropy) AS port_entropy, max(src_port) - min(src_port) AS src_port_range,
  count(DISTINCT dst_port) / count(*) AS port_ratio, count(*) / {W} AS rate
  FROM syn JOIN ent USING (src_ip, win_start) GROUP BY src_ip, win_start)"""


@query("syn_window_features", "src_ip win_start:i syn_count:i dst_ports:i dst_ips:i port_entropy:d src_port_range:d port_ratio:d rate:d9",
       SYN_SQL + "\n--result\nSELECT * FROM syn7", "packets")
def syn_window_features(spark, sf):
    return WN.syn_window_features(C.packets(spark, sf), W)


@query("endpoint_window_features", "dst_ip dst_port:i win_start:i total:i src_ips:i src_ports:i ports_per_src:d reserved:d src_ratio:d rate:d9",
       f"""SELECT dst_ip, dst_port, ts_us // 1000000 // {W} * {W} AS win_start, sum(CASE WHEN s THEN 2 ELSE 1 END) AS total,
  count(DISTINCT CASE WHEN s THEN src_ip END) AS src_ips, count(DISTINCT CASE WHEN s THEN src_port END) AS src_ports,
  CASE WHEN count(DISTINCT CASE WHEN s THEN src_ip END) > 0 THEN count(DISTINCT CASE WHEN s THEN src_port END) / count(DISTINCT CASE WHEN s THEN src_ip END) ELSE 0 END AS ports_per_src,
  0 AS reserved, count(DISTINCT CASE WHEN s THEN src_ip END) / sum(CASE WHEN s THEN 2 ELSE 1 END) AS src_ratio,
  sum(CASE WHEN s THEN 2 ELSE 1 END) / {W} AS rate
  FROM (SELECT *, proto = 6 AND flags & 18 = 2 AS s FROM packets WHERE proto = 17 OR flags & 18 = 2) GROUP BY ALL""", "packets")
def endpoint_window_features(spark, sf):
    return WN.endpoint_window_features(C.packets(spark, sf), W)


ROLES_SQL = f""", tcp AS (SELECT *, ts_us // 1000000 // {W} * {W} AS win_start FROM packets WHERE proto = 6),
ev AS (SELECT src_ip AS ip, win_start, ts_us, dst_port, dst_ip AS peer FROM tcp WHERE flags & 18 = 2 PRIVATE),
{gaps_sql('ip, win_start')},
pe AS (SELECT ip, win_start, sum(-c / t * log2(c / t)) AS port_entropy, max(c / t) AS top_port_share FROM (SELECT ip, win_start, count(*) AS c,
  sum(count(*)) OVER (PARTITION BY ip, win_start) AS t FROM ev GROUP BY ip, win_start, dst_port) GROUP BY ALL),
ie AS (SELECT ip, win_start, sum(-c / t * log2(c / t)) AS ip_entropy, max(c / t) AS ip_conc FROM (SELECT ip, win_start, count(*) AS c,
  sum(count(*)) OVER (PARTITION BY ip, win_start) AS t FROM ev GROUP BY ip, win_start, peer) GROUP BY ALL),
sy AS (SELECT ip, win_start, count(*) AS syn_count, count(DISTINCT peer) AS dst_ips, count(DISTINCT dst_port) AS dst_ports,
  count(DISTINCT ts_us // 1000000) AS secs, count(*) FILTER (WHERE peer LIKE '10.%' OR peer LIKE '192.168.%') AS internal
  FROM ev GROUP BY ALL),
o AS (SELECT src_ip AS ip, win_start, count(*) FILTER (WHERE flags & 4 <> 0) AS rst, count(*) FILTER (WHERE flags & 1 <> 0) AS fin,
  count(*) FILTER (WHERE flags & 8 <> 0) AS psh FROM tcp GROUP BY ALL),
inn AS (SELECT dst_ip AS ip, win_start, count(*) AS inp, sum(payload_len) AS inb, count(*) FILTER (WHERE flags & 18 = 18) AS hs,
  sum(tcp_win) FILTER (WHERE flags & 18 = 18) AS win FROM tcp GROUP BY ALL),
j AS (SELECT sy.*, pe.port_entropy, top_port_share, ip_entropy, ip_conc, coalesce(iat_cv, 0) AS iat_cv, coalesce(iat_q90_q10, 0) AS iat_q90_q10,
  coalesce(rst, 0) AS rst, coalesce(fin, 0) AS fin, coalesce(psh, 0) AS psh, coalesce(inp, 0) AS inp, coalesce(inb, 0) AS inb,
  coalesce(hs, 0) AS hs, coalesce(win, 0) AS win FROM sy JOIN pe USING (ip, win_start) JOIN ie USING (ip, win_start)
  LEFT JOIN gap_cv USING (ip, win_start) LEFT JOIN gap_q USING (ip, win_start) LEFT JOIN o USING (ip, win_start)
  LEFT JOIN inn USING (ip, win_start))"""


@query("auth_window_features", "ip win_start:i syn_count:i dst_ips:i dst_ports:i port_ratio:d top_port_share:d rate:d9 iat_cv:d handshake_ratio:d rst_per_handshake:d bytes_per_syn:d",
       ROLES_SQL.replace("PRIVATE", "") + f"""
--result
SELECT ip, win_start, syn_count, dst_ips, dst_ports, dst_ports / syn_count AS port_ratio, top_port_share, syn_count / {W} AS rate, iat_cv,
  hs / syn_count AS handshake_ratio, CASE WHEN hs > 0 THEN rst / hs ELSE 0 END AS rst_per_handshake, inb / syn_count AS bytes_per_syn FROM j""", "packets")
def auth_window_features(spark, sf):
    return WN.auth_window_features(C.packets(spark, sf), W)


@query("client_window_features", "ip win_start:i syn_count:i dst_ips:i dst_ports:i iat_cv:d port_entropy:d port_ratio:d rate:d9 ip_conc:d ip_ratio:d ip_entropy:d iat_q90_q10:d time_density:d port_ip_ratio:d handshake_ratio:d inc_ratio:d data_density:d rst_rate:d internal_ratio:d bytes_per_syn:d fin_ratio:d push_ratio:d mean_window:d",
       ROLES_SQL.replace("PRIVATE", "AND (src_ip LIKE '192.168.%' OR src_ip LIKE '10.%')") + f"""
--result
SELECT ip, win_start, syn_count, dst_ips, dst_ports, iat_cv, port_entropy, dst_ports / syn_count AS port_ratio, syn_count / {W} AS rate, ip_conc,
  dst_ips / syn_count AS ip_ratio, ip_entropy, iat_q90_q10, CASE WHEN syn_count >= 2 THEN secs / syn_count ELSE 0 END AS time_density,
  dst_ports / dst_ips AS port_ip_ratio, hs / syn_count AS handshake_ratio, inp / (syn_count + inp) AS inc_ratio, inp / syn_count AS data_density,
  rst / syn_count AS rst_rate, internal / syn_count AS internal_ratio, inb / syn_count AS bytes_per_syn, fin / syn_count AS fin_ratio,
  psh / syn_count AS push_ratio, CASE WHEN hs > 0 THEN win / hs ELSE 0 END AS mean_window FROM j""", "packets")
def client_window_features(spark, sf):
    return WN.client_window_features(C.packets(spark, sf), W)


@query("auth_suppress_reason", "ip win_start:i reason", ROLES_SQL.replace("PRIVATE", "") + """
--result
SELECT ip, win_start, CASE WHEN least(syn_count / 4, 1.0) <= 0.3 THEN NULL WHEN dst_ips = 1 THEN 'whitelist'
  WHEN hs / syn_count > 0.8 AND CASE WHEN hs > 0 THEN rst / hs ELSE 0 END < 0.3 AND inb / syn_count > 1000 THEN 'clean_conn' END AS reason FROM j""", "packets")
def auth_suppress_reason(spark, sf):
    """Reasons of the authentication detector over its windows; sources with one peer stand for listed ones."""
    f = WN.auth_window_features(C.packets(spark, sf), W).withColumn("score", F.least(F.col("syn_count") / 4, F.lit(1.0)))
    return f.withColumn("reason", labels.auth_suppress_reason(threshold=0.3, listed=F.col("dst_ips") == 1))


@query("client_suppress_reason", "ip win_start:i reason", ROLES_SQL.replace("PRIVATE", "AND (src_ip LIKE '192.168.%' OR src_ip LIKE '10.%')") + """
, s AS (SELECT *, CASE WHEN syn_count % 2 = 1 THEN 0.15 ELSE 0.5 END AS score FROM j)
--result
SELECT ip, win_start, CASE WHEN rst / syn_count > 5 AND syn_count >= 3 THEN 'high_rst' WHEN inp = 0 AND syn_count >= 3 AND score < 0.3 THEN 'no_incoming'
  WHEN internal / syn_count > 0.6 AND score < 0.3 AND syn_count >= 3 THEN 'high_int_ratio' WHEN hs / syn_count < 0.1 AND score < 0.2 AND syn_count >= 3 THEN 'no_handshake'
  WHEN hs = 0 AND inb < 10 THEN 'no_data' WHEN dst_ips = 1 THEN 'whitelist' END AS reason FROM s""", "packets")
def client_suppress_reason(spark, sf):
    """Reasons of the client detector over its windows, in their order, at scores on either side of its limits."""
    f = WN.client_window_features(C.packets(spark, sf), W).withColumn("score", F.when(F.col("syn_count") % 2 == 1, 0.15).otherwise(0.5))
    return f.withColumn("reason", labels.client_suppress_reason(threshold=0.1, listed=F.col("dst_ips") == 1))


@query("dual_role", "event_id:i role ip peer_ip", """SELECT event_id, 'src' AS role, src_ip AS ip, dst_ip AS peer_ip FROM packets WHERE proto = 6
  UNION ALL SELECT event_id, 'dst', dst_ip, src_ip FROM packets WHERE proto = 6""", "packets")
def dual_role(spark, sf):
    return WN.dual_role(C.packets(spark, sf))


def _axis(spark, sf, *axes):
    """Counts per weekly source window of the SYNs, for the single-statistic queries."""
    syn = C.packets(spark, sf).filter("proto = 6 AND flags = 2").withColumn("win_start", WN.window_start("ts_us", W))
    cols = {"port": F.col("dst_port"), "sec": F.floor(F.col("ts_us") / 1_000_000)}
    return WN.spread_axes(syn, ["src_ip", "win_start"], {a: cols[a] for a in axes}).groupBy("src_ip", "win_start")


@query("entropy", "src_ip win_start:i port_entropy:d", SYN_SQL + "\n--result\nSELECT src_ip, win_start, port_entropy FROM ent", "packets")
def entropy(spark, sf):
    return _axis(spark, sf, "port").agg(WN.entropy("port").alias("port_entropy"))


@query("top_share", "src_ip win_start:i share:d", SYN_SQL + "\n--result\nSELECT src_ip, win_start, max(c) / sum(c) AS share FROM ports GROUP BY ALL", "packets")
def top_share(spark, sf):
    return _axis(spark, sf, "port").agg(WN.top_share("port").alias("share"))


@query("time_density", "src_ip win_start:i density:d", SYN_SQL + """
--result
SELECT src_ip, win_start, CASE WHEN count(*) >= 2 THEN count(DISTINCT ts_us // 1000000) / count(*) ELSE 0 END AS density FROM syn GROUP BY ALL""", "packets")
def time_density(spark, sf):
    return _axis(spark, sf, "sec").agg(WN.time_density("sec").alias("density"))


GAP_QUERY = f""", ev AS (SELECT src_ip, ts_us // 1000000 // {W} * {W} AS win_start, ts_us FROM packets WHERE proto = 6),
{gaps_sql('src_ip, win_start')}"""


def _gaps(spark, sf):
    rows = C.packets(spark, sf).filter("proto = 6").withColumn("win_start", WN.window_start("ts_us", W))
    keys = ["src_ip", "win_start"]
    return WN.gap_features(WN.gap_counts(rows, keys, span_sec=W), keys)


@query("iat_cv", "src_ip win_start:i iat_cv:d", GAP_QUERY + "\n--result\nSELECT * FROM gap_cv WHERE iat_cv > 0", "packets")
def iat_cv(spark, sf):
    return _gaps(spark, sf).filter("iat_cv > 0")


@query("iat_q90_q10", "src_ip win_start:i iat_q90_q10:d", GAP_QUERY + "\n--result\nSELECT * FROM gap_q", "packets")
def iat_q90_q10(spark, sf):
    return _gaps(spark, sf).filter("iat_q90_q10 > 0")


@query("flow_window_features_4", "src_ip window_id:i unique_dst_ports:i unique_dst_ips:i total_flows:i flow_rate:d9 label:i", f"""SELECT src_ip,
  ts_us // 1000000 // {W} AS window_id, count(DISTINCT dst_port) AS unique_dst_ports, count(DISTINCT dst_ip) AS unique_dst_ips,
  count(*) AS total_flows, count(*) / {W} AS flow_rate, max(CASE WHEN label = 'PortScan' THEN 1 ELSE 0 END) AS label FROM flows GROUP BY ALL""", "flows")
def flow_window_features_4(spark, sf):
    return WN.flow_window_features_4(C.flows(spark, sf), W)


BATCH_SQL = f""", fl AS (SELECT * FROM flows FILTERED),
ev AS (SELECT src_ip, WIN AS win_start, ts_us, dst_port, dst_ip, dpkts, sbytes, label FROM fl),
{gaps_sql('src_ip, win_start', 2, 2)},
pe AS (SELECT src_ip, win_start, sum(-c / t * log2(c / t)) AS port_entropy FROM (SELECT src_ip, win_start, count(*) AS c,
  sum(count(*)) OVER (PARTITION BY src_ip, win_start) AS t FROM ev GROUP BY src_ip, win_start, dst_port) GROUP BY ALL),
ie AS (SELECT src_ip, win_start, sum(-c / t * log2(c / t)) AS ip_entropy, max(c / t) AS ip_conc FROM (SELECT src_ip, win_start, count(*) AS c,
  sum(count(*)) OVER (PARTITION BY src_ip, win_start) AS t FROM ev GROUP BY src_ip, win_start, dst_ip) GROUP BY ALL),
sy AS (SELECT src_ip, win_start, count(*) AS syn_count, count(DISTINCT dst_ip) AS dst_ips, count(DISTINCT dst_port) AS dst_ports,
  count(DISTINCT ts_us // 1000000) AS secs, sum(dpkts) AS bwd, sum(sbytes) AS fwdb,
  max(CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END) AS bot FROM ev GROUP BY ALL),
j AS (SELECT sy.*, port_entropy, ip_entropy, ip_conc, coalesce(iat_cv, 0) AS iat_cv, coalesce(iat_q90_q10, 0) AS iat_q90_q10,
  dst_ports / syn_count AS port_ratio, syn_count / WIDTH AS rate, dst_ips / syn_count AS ip_ratio, secs / syn_count AS time_density,
  dst_ports / dst_ips AS port_ip_ratio, 1.0 AS internal_ratio
  FROM sy JOIN pe USING (src_ip, win_start) JOIN ie USING (src_ip, win_start)
  LEFT JOIN gap_cv USING (src_ip, win_start) LEFT JOIN gap_q USING (src_ip, win_start))"""
TUMBLE = BATCH_SQL.replace("FILTERED", "").replace("WIN AS", f"ts_us // 1000000 // {W} * {W} AS").replace("WIDTH", str(W))
SLIDE_W, SLIDE_S = 4 * W, W
SLIDE = BATCH_SQL.replace("FILTERED", "").replace(
    "WIN AS", f"unnest(range(greatest(CAST(floor((ts_us / 1e6 - {SLIDE_W} + {SLIDE_S}) / {SLIDE_S}) AS BIGINT) * {SLIDE_S}, 0), "
    f"ts_us // 1000000 // {SLIDE_S} * {SLIDE_S} + 1, {SLIDE_S})) AS").replace("WIDTH", str(SLIDE_W))
SEVEN = "syn_count:i dst_ips:i dst_ports:i iat_cv:d port_entropy:d port_ratio:d rate:d9"
WIDE = "ip_conc:d ip_ratio:d ip_entropy:d iat_q90_q10:d time_density:d port_ip_ratio:d internal_ratio:d"


def _bots(spark, sf):
    return C.flows(spark, sf).filter("label = 'PortScan'").select("src_ip").distinct()


BOT_LABEL = "CASE WHEN src_ip IN (SELECT src_ip FROM flows WHERE label = 'PortScan') THEN 1 ELSE 0 END AS label"


@query("client_window_batch_7", f"src_ip win_start:i {SEVEN} label:i", TUMBLE + f"\n--result\nSELECT *, {BOT_LABEL} FROM j", "flows")
def client_window_batch_7(spark, sf):
    return WN.client_window_batch(C.flows(spark, sf), W, 7, bots=_bots(spark, sf))


@query("client_window_batch_18", f"src_ip win_start:i {SEVEN} {WIDE} handshake_ratio:d inc_ratio:d data_density:d rst_rate:d label:i",
       TUMBLE + f"\n--result\nSELECT *, 0 AS handshake_ratio, 0 AS inc_ratio, 0 AS data_density, 0 AS rst_rate, {BOT_LABEL} FROM j", "flows")
def client_window_batch_18(spark, sf):
    return WN.client_window_batch(C.flows(spark, sf), W, 18, bots=_bots(spark, sf))


@query("client_window_batch_22", f"src_ip win_start:i {SEVEN} {WIDE} handshake_ratio:d inc_ratio:d data_density:d rst_rate:d bytes_per_syn:d7 fin_ratio:d push_ratio:d mean_window:d",
       TUMBLE + """
--result
SELECT *, 0 AS handshake_ratio, bwd / (syn_count + bwd) AS inc_ratio, bwd / syn_count AS data_density, 0 AS rst_rate, fwdb / syn_count AS bytes_per_syn,
  0 AS fin_ratio, 0 AS push_ratio, 0 AS mean_window FROM j WHERE syn_count >= 3""", "flows")
def client_window_batch_22(spark, sf):
    return WN.client_window_batch(C.flows(spark, sf), W, 22, min_rows=3)


@query("client_window_sliding", f"src_ip win_start:i {SEVEN} label:i", SLIDE + f"\n--result\nSELECT *, {BOT_LABEL} FROM j", "flows")
def client_window_sliding(spark, sf):
    return WN.client_window_sliding(C.flows(spark, sf), SLIDE_W, SLIDE_S, bots=_bots(spark, sf))


BOTH_FLOWS = """SELECT src_ip, dst_ip, dst_port, ts_us, dpkts, sbytes, label FROM flows UNION ALL
  SELECT dst_ip, src_ip, src_port, ts_us + 3600000000, spkts, dbytes, label FROM flows WHERE dst_port = 80"""


@query("client_window_sliding_inbound", f"src_ip win_start:i {SEVEN} inbound:i inbound_ratio:d label:i",
       SLIDE.replace("FROM flows ),", f"FROM ({BOTH_FLOWS})),", 1) + f""", inb AS (SELECT src_ip, win_start, count(*) AS inbound FROM (SELECT dst_ip AS src_ip, unnest(range(
    greatest(CAST(floor((ts_us / 1e6 - {SLIDE_W} + {SLIDE_S}) / {SLIDE_S}) AS BIGINT) * {SLIDE_S}, 0), ts_us // 1000000 // {SLIDE_S} * {SLIDE_S} + 1, {SLIDE_S})) AS win_start
  FROM fl) GROUP BY ALL)
--result
SELECT j.*, coalesce(inbound, 0) AS inbound, coalesce(inbound, 0) / (syn_count + coalesce(inbound, 0)) AS inbound_ratio, bot AS label
  FROM j LEFT JOIN inb USING (src_ip, win_start) WHERE syn_count >= 2""", "flows")
def client_window_sliding_inbound(spark, sf):
    """Flows plus answers in the other direction, so that sources have inbound flows."""
    f = C.flows(spark, sf)
    cols = ["src_ip", "dst_ip", "dst_port", "ts_us", "dpkts", "sbytes", "label"]
    back = f.filter("dst_port = 80").select(
        F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), F.col("src_port").alias("dst_port"),
        (F.col("ts_us") + 3_600_000_000).alias("ts_us"), F.col("spkts").alias("dpkts"), F.col("dbytes").alias("sbytes"), "label")
    return WN.client_window_sliding_inbound(f.select(*cols).unionByName(back), SLIDE_W, SLIDE_S)


@query("inbound_join", "src_ip win_start:i inbound:i", f"""SELECT dst_ip AS src_ip, ts_us // 1000000 // {W} * {W} AS win_start, count(*) AS inbound
  FROM packets GROUP BY ALL""", "packets")
def inbound_join(spark, sf):
    return WN.inbound_counts(C.packets(spark, sf), W, W)


@query("window_counts_by_source", "src_ip flows:i hit_flows:i windows:i hit_windows:i mean_rows:d max_rows:i", f"""SELECT src_ip, sum(n) AS flows, sum(h) AS hit_flows,
  count(*) AS windows, count(*) FILTER (WHERE h > 0) AS hit_windows, avg(n) AS mean_rows, max(n) AS max_rows FROM
  (SELECT src_ip, ts_us // 1000000 // {W} AS w, count(*) AS n, count(*) FILTER (WHERE label <> 'BENIGN') AS h FROM flows GROUP BY ALL) GROUP BY src_ip""", "flows")
def window_counts_by_source(spark, sf):
    return WN.window_counts_by_source(C.flows(spark, sf), W)


FLOW_SQL = """fl AS (SELECT flow_key, (max(ts_us) - min(ts_us)) / 1e6 AS dur, count(*) FILTER (WHERE from_client) AS spkts,
  count(*) FILTER (WHERE NOT from_client) AS dpkts, coalesce(sum(payload_len) FILTER (WHERE from_client), 0) AS sbytes,
  coalesce(sum(payload_len) FILTER (WHERE NOT from_client), 0) AS dbytes,
  coalesce(arg_min(tcp_win, (ts_us, event_id)) FILTER (WHERE from_client AND proto = 6), 0) AS swin,
  coalesce(arg_min(tcp_win, (ts_us, event_id)) FILTER (WHERE NOT from_client AND proto = 6), 0) AS dwin,
  CASE WHEN count(*) FILTER (WHERE from_client) > 1 THEN (max(ts_us) FILTER (WHERE from_client) - min(ts_us) FILTER (WHERE from_client)) / (count(*) FILTER (WHERE from_client) - 1) / 1000.0 ELSE 0 END AS sintpkt,
  CASE WHEN count(*) FILTER (WHERE NOT from_client) > 1 THEN (max(ts_us) FILTER (WHERE NOT from_client) - min(ts_us) FILTER (WHERE NOT from_client)) / (count(*) FILTER (WHERE NOT from_client) - 1) / 1000.0 ELSE 0 END AS dintpkt,
  count(*) FILTER (WHERE proto = 6 AND flags & 1 <> 0) AS fin_cnt, count(*) FILTER (WHERE proto = 6 AND flags & 16 <> 0) AS ack_cnt,
  count(*) FILTER (WHERE proto = 6 AND flags & 2 <> 0) AS syn_cnt FROM SOURCE GROUP BY flow_key)
--result
SELECT *, CASE WHEN spkts > 0 THEN sbytes / spkts ELSE 0 END AS smeansz, CASE WHEN dpkts > 0 THEN dbytes / dpkts ELSE 0 END AS dmeansz,
  CASE WHEN spkts > 0 THEN sbytes / spkts ELSE 0 END AS fwd_pkt_mean, CASE WHEN dpkts > 0 THEN dbytes / dpkts ELSE 0 END AS bwd_pkt_mean,
  dintpkt AS bwd_iat FROM fl"""


@query("flow_features_11", "flow_key " + " ".join(f"{c}:d4" for c in FLOW_FEATURES_11), ", " + FLOW_SQL.replace("SOURCE", "packets"), "packets")
def flow_features_11(spark, sf):
    return FF.flow_features_11(C.packets(spark, sf))


@query("flow_features_15", "flow_key " + " ".join(f"{c}:d4" for c in FLOW_FEATURES_15), ", " + FLOW_SQL.replace("SOURCE", "packets"), "packets")
def flow_features_15(spark, sf):
    return FF.flow_features_15(C.packets(spark, sf))


PREFIX_SQL = """, numbered AS (SELECT *, row_number() OVER (PARTITION BY flow_key ORDER BY ts_us, event_id) AS pkt_no FROM packets),
ends AS (SELECT flow_key, min(pkt_no) AS stop FROM numbered WHERE flags & 5 <> 0 GROUP BY flow_key),
prefix AS (SELECT numbered.*, stop FROM numbered LEFT JOIN ends USING (flow_key) WHERE pkt_no <= 8 AND pkt_no <= coalesce(stop, 8))"""


@query("flow_prefix", "flow_key event_id:i pkt_no:i", PREFIX_SQL + "\n--result\nSELECT * FROM prefix", "packets")
def flow_prefix(spark, sf):
    return FF.flow_prefix(C.packets(spark, sf), 8)


@query("flow_prefix_features", "flow_key " + " ".join(f"{c}:d4" for c in FLOW_FEATURES_15), PREFIX_SQL + ", " + FLOW_SQL.replace("SOURCE", "prefix"), "packets")
def flow_prefix_features(spark, sf):
    return FF.flow_features_15(FF.flow_prefix(C.packets(spark, sf), 8))


@query("first_n_per_flow", "flow_key event_id:i rank:i", """SELECT flow_key, event_id, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY flow_key ORDER BY ts_us, event_id) AS rank FROM packets) WHERE rank <= 3""", "packets")
def first_n_per_flow(spark, sf):
    from tidewatch.operators.ranking import top_k
    return top_k(C.packets(spark, sf), ["flow_key"], [F.col("ts_us"), F.col("event_id")], 3)


@query("running_close", "flow_key event_id:i pkt_no:i", """, numbered AS (SELECT *, row_number() OVER (PARTITION BY flow_key ORDER BY ts_us, event_id) AS pkt_no FROM packets
  QUALIFY pkt_no <= 50)
--result
SELECT flow_key, event_id, pkt_no FROM numbered n WHERE NOT EXISTS (SELECT 1 FROM numbered m WHERE m.flow_key = n.flow_key
  AND m.pkt_no < n.pkt_no AND m.pkt_no >= 2 AND m.flags & 5 <> 0)""", "packets")
def running_close(spark, sf):
    """The sequence detector's rule: a closing packet counts from the second packet on."""
    return FF.flow_prefix(C.packets(spark, sf), 50, min_close=2)


@query("event_gaps", "src_ip ts_us:i events:i gap_sec:d", """SELECT src_ip, ts_us, events, (ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us)) / 1e6 AS gap_sec
  FROM (SELECT src_ip, ts_us, count(*) AS events FROM packets GROUP BY ALL)""", "packets")
def event_gaps(spark, sf):
    return S.event_gaps(C.packets(spark, sf), ["src_ip"])


CHAIN_SQL = """, ev AS (SELECT DISTINCT {k} AS k, ts_us FROM {src}),
starts AS (SELECT k, min(ts_us) AS s FROM ev GROUP BY k
  UNION ALL SELECT p.k, min(e.ts_us) AS s FROM starts p JOIN ev e ON e.k = p.k AND e.ts_us >= p.s + {w} GROUP BY p.k)"""


@query("anchored_windows", "event_id:i src_ip win_start_us:i", CHAIN_SQL.format(k="src_ip", src="packets", w=C.DAY * 1_000_000) + """
--result
SELECT event_id, src_ip, (SELECT max(s) FROM starts WHERE k = src_ip AND s <= ts_us) AS win_start_us FROM packets""", "packets", recursive=True)
def anchored_windows(spark, sf):
    return S.anchored_windows(C.packets(spark, sf), ["src_ip"], C.DAY)


@query("cooldown", "event_id:i src_ip ts_us:i", """, syn AS (SELECT * FROM packets WHERE flags = 2 AND proto = 6)""" +
       CHAIN_SQL.format(k="src_ip", src="syn", w=C.DAY * 2_000_000) + """
--result
SELECT min(event_id) AS event_id, src_ip, ts_us FROM syn WHERE (src_ip, ts_us) IN (SELECT (k, s) FROM starts) GROUP BY src_ip, ts_us""", "packets", recursive=True)
def cooldown(spark, sf):
    return S.cooldown(C.packets(spark, sf).filter("flags = 2 AND proto = 6"), ["src_ip"], 2 * C.DAY)


@query("spread_timestamps", "src_ip ts_us:i spread_us:i", """SELECT src_ip, ts_us, ts_us + CASE WHEN n > 1 THEN CAST(floor((i + 0.5) / n * 60000000) AS BIGINT) ELSE 0 END AS spread_us
  FROM (SELECT src_ip, ts_us, row_number() OVER (PARTITION BY src_ip, ts_us ORDER BY row_key) - 1 AS i,
  count(*) OVER (PARTITION BY src_ip, ts_us) AS n FROM flows)""", "flows")
def spread_timestamps(spark, sf):
    return S.spread_timestamps(C.flows(spark, sf), ["src_ip"])


@query("syn_rate_gate", "src_ip win_start:i syn_count:i ip_ratio:d port_ratio:d attack_pattern:i", SYN_SQL + """
--result
SELECT src_ip, win_start, syn_count, dst_ips / syn_count AS ip_ratio, port_ratio,
  CASE WHEN syn_count >= 4 AND dst_ips / syn_count < 0.9 AND port_ratio < 0.9 THEN 1 ELSE 0 END AS attack_pattern FROM syn7""", "packets")
def syn_rate_gate(spark, sf):
    return WN.syn_rate_gate(C.packets(spark, sf), W, 4, 0.9, 0.9)


@query("source_profile", "kind item n:i rank:i distinct_items:i syns:i first_us:i last_us:i", """, busiest AS (SELECT src_ip FROM packets WHERE flags = 2 AND proto = 6 GROUP BY src_ip
  ORDER BY count(*) DESC, src_ip LIMIT 1),
syn AS (SELECT * FROM packets WHERE flags = 2 AND proto = 6 AND src_ip IN (SELECT src_ip FROM busiest)),
items AS (SELECT 'port' AS kind, CAST(dst_port AS VARCHAR) AS item, count(*) AS n FROM syn GROUP BY ALL UNION ALL SELECT 'ip', dst_ip, count(*) FROM syn GROUP BY ALL)
--result
SELECT kind, item, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, item) AS rank, count(*) OVER (PARTITION BY kind) AS distinct_items,
  sum(n) OVER (PARTITION BY kind) AS syns, (SELECT min(ts_us) FROM syn) AS first_us, (SELECT max(ts_us) FROM syn) AS last_us FROM items QUALIFY rank <= 10""", "packets")
def source_profile(spark, sf):
    p = C.packets(spark, sf)
    busiest = (p.filter("flags = 2 AND proto = 6").groupBy("src_ip").count().orderBy(F.desc("count"), "src_ip").first())
    return R.source_profile(p, busiest["src_ip"])
