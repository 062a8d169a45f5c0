"""Streaming queries over the packet table replayed as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import config, fixtures
from tidewatch.operators import confusion as CF
from tidewatch.plans import q_common as C
from tidewatch.plans.q_eval import LIVE_SQL, live
from tidewatch.plans.q_windows import CHAIN_SQL
from tidewatch.plans.registry import query
from tidewatch.session import new_folder
from tidewatch.sinks import writers
from tidewatch.sources import logs
from tidewatch.streaming import detectors as DT, pipelines as PL
from tidewatch.streaming.scoring import LinearScore

FITS_COLS, FITS_SQL = "key fits:i", "SELECT DISTINCT src_ip AS key, 1 AS fits FROM packets"
# packets are days apart in the test table, so windows are days long
DAYS = 7 * C.DAY


def _stream(spark, sf, after=3 * DAYS * 1_000_000):
    PL.use_rocksdb(spark)
    return PL.replay(spark, C.packets(spark, sf), stop_after_us=after)


def _run(spark, sf, cfg, score):
    return PL.run_to_end(DT.detect_stream(_stream(spark, sf), cfg, score), spark, cfg.engine)


def _fits(spark, sf, found):
    """Every source with what must hold of its scored windows: no window twice, no more SYNs than it sent, scores that are
    probabilities, an alert only where nothing suppresses it. A key that sent nothing would come out as a further row."""
    syn = F.count_if((F.col("proto") == 6) & (F.col("flags").bitwiseAND(18) == 2))
    sent = C.packets(spark, sf).groupBy(F.col("src_ip").alias("key")).agg(syn.alias("sent"))
    per = found.groupBy("key").agg(F.sum("syn_count").alias("counted"), F.count("*").alias("n"), F.countDistinct("win_start_us", "detected_at_us").alias("windows"),
                                   F.bool_and(F.col("score").between(0, 1) & ~(F.col("alert") & F.col("suppress_reason").isNotNull())).alias("sound"))
    fits = F.col("n").isNull() | ((F.col("counted") <= F.col("sent")) & (F.col("n") == F.col("windows")) & F.col("sound"))
    return sent.join(per, "key", "full").select("key", F.coalesce(fits, F.lit(False)).cast("int").alias("fits"))


@query("detect_scan_stream", FITS_COLS, FITS_SQL, "packets")
def detect_scan_stream(spark, sf):
    return _fits(spark, sf, _run(spark, sf, config.SCAN.with_(window_sec=DAYS, min_events=2, min_dst_ports=2), LinearScore({1: 1.0}, -1.0)))


WINDOW_COLS = "key win_start_us:i syn_count:i score:d alert:i suppress_reason reason"
SYN_WHERE = "proto = 6 AND flags & 18 = 2"


@query("detect_flood_stream", WINDOW_COLS, f""", syn AS (SELECT * FROM packets WHERE {SYN_WHERE})""" + CHAIN_SQL.format(k="src_ip", src="syn", w=DAYS * 1_000_000) + """
, n AS (SELECT src_ip AS key, (SELECT max(s) FROM starts WHERE k = src_ip AND s <= ts_us) AS win_start_us, count(*) AS syn_count FROM syn GROUP BY ALL),
sc AS (SELECT *, CAST(1 / (1 + exp(1.0 - 0.5 * syn_count)) AS FLOAT) AS score FROM n WHERE syn_count >= 2)
--result
SELECT *, CASE WHEN score > CAST(0.3 AS FLOAT) THEN 1 ELSE 0 END AS alert, CAST(NULL AS VARCHAR) AS suppress_reason, CAST(NULL AS VARCHAR) AS reason FROM sc""", "packets", recursive=True)
def detect_flood_stream(spark, sf):
    return _run(spark, sf, config.FLOOD.with_(window_sec=DAYS, min_events=2), LinearScore({0: 0.5}, -1.0))


@query("detect_endpoint_stream", WINDOW_COLS, f""", seen AS (SELECT *, concat(dst_ip, ':', dst_port) AS endpoint, {SYN_WHERE} AS syn FROM packets WHERE ({SYN_WHERE}) OR proto = 17)""" + CHAIN_SQL.format(k="endpoint", src="seen", w=DAYS * 1_000_000) + f"""
, n AS (SELECT endpoint AS key, dst_port, (SELECT max(s) FROM starts WHERE k = endpoint AND s <= ts_us) AS win_start_us, count(*) FILTER (WHERE syn) AS syn_count, count(*) AS total,
  count(DISTINCT src_ip) FILTER (WHERE syn) AS clients, count(DISTINCT src_port) FILTER (WHERE syn) AS sports FROM seen GROUP BY ALL),
sc AS (SELECT *, CAST(1 / (1 + exp(1.0 - 0.1 * (syn_count + total))) AS FLOAT) AS score FROM n WHERE syn_count + total >= 3),
why AS (SELECT *, CASE WHEN score <= CAST(0.5 AS FLOAT) THEN NULL WHEN dst_port IN ({', '.join(map(str, config.ENDPOINT.suppress_ports))}) THEN 'port'
  WHEN clients = 1 AND sports < 10 THEN 'single_client' END AS suppress_reason FROM sc)
--result
SELECT *, CASE WHEN score > CAST(0.5 AS FLOAT) AND suppress_reason IS NULL THEN 1 ELSE 0 END AS alert, CAST(NULL AS VARCHAR) AS reason FROM why""", "packets", recursive=True)
def detect_endpoint_stream(spark, sf):
    return _run(spark, sf, config.ENDPOINT.with_(window_sec=DAYS), LinearScore({0: 0.1}, -1.0))


@query("detect_auth_stream", FITS_COLS, FITS_SQL, "packets")
def detect_auth_stream(spark, sf):
    cfg = config.AUTH.with_(window_sec=DAYS, early_seconds=3.0 * C.DAY, idle_seconds=5.0 * C.DAY, threshold=0.5, cooldown_sec=10 * C.DAY)
    return _fits(spark, sf, _run(spark, sf, cfg, LinearScore({0: 0.5}, -1.0)))


@query("detect_client_stream", FITS_COLS, FITS_SQL, "packets")
def detect_client_stream(spark, sf):
    cfg = config.CLIENT.with_(window_sec=DAYS, early_seconds=3.0 * C.DAY, idle_seconds=5.0 * C.DAY, threshold=0.5, cooldown_sec=10 * C.DAY)
    return _fits(spark, sf, _run(spark, sf, cfg, LinearScore({0: 0.5}, -1.0)))


SCORED_SQL = """numbered AS (SELECT *, row_number() OVER w AS i, count(*) FILTER (WHERE from_client) OVER w AS spkts,
  sum(CASE WHEN from_client THEN payload_len ELSE 0 END) OVER w AS sbytes FROM packets WINDOW w AS (PARTITION BY flow_key ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)),
scored AS (SELECT flow_key AS key, i AS packets, ts_us, 1 / (1 + exp(1.0 - 0.8 * spkts - 0.01 * sbytes)) AS score FROM numbered WHERE i >= 8 OR (proto = 6 AND flags & 5 <> 0)
  QUALIFY row_number() OVER (PARTITION BY flow_key ORDER BY i) = 1)"""


@query("score_flow_stream", "key packets:i detected_at_us:i score:d alert:i", SCORED_SQL + f"""
--result
SELECT key, packets, ts_us AS detected_at_us, score, CASE WHEN score > 0.5 AND split_part(key, '-', 3) NOT IN ({', '.join(f"'{p}'" for p in config.FLOW.suppress_ports)}) THEN 1 ELSE 0 END AS alert FROM scored""", "packets")
def score_flow_stream(spark, sf):
    """A scored flow is remembered for longer than the table lasts, so none is scored twice."""
    s = DT.score_flow_stream(_stream(spark, sf), LinearScore({1: 0.8, 3: 0.01}, -1.0), config.FLOW.with_(threshold=0.5), forget_sec=400 * DAYS)
    return PL.run_to_end(s, spark, "flowscores")


@query("syn_rate_gate_stream", "key ts_us:i syn_rate:i attack_pattern:i", f"""run AS (SELECT src_ip AS key, ts_us, event_id, count(*) OVER w AS n, count(DISTINCT dst_ip) OVER w AS ips,
  count(DISTINCT dst_port) OVER w AS ports FROM packets WHERE {SYN_WHERE} WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, n >= 3 AND ips / n < 0.9 AND ports / n < 0.9 AS hit FROM run),
c AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY key ORDER BY ts_us, event_id), false) AS before FROM g)
--result
SELECT key, ts_us, n AS syn_rate, CASE WHEN hit THEN 1 ELSE 0 END AS attack_pattern FROM c WHERE hit <> before""", "packets")
def syn_rate_gate_stream(spark, sf):
    """Changes of the gate. The window holds the whole table, so no source grows stale in between."""
    s = DT.syn_rate_gate_stream(_stream(spark, sf), 60 * DAYS, min_rate=3, max_ip_ratio=0.9, max_port_ratio=0.9)
    return PL.run_to_end(s, spark, "gate")


@query("gated_flows_stream", "key detected_at_us:i score:d class", SCORED_SQL + """,
gate AS (SELECT s.key, s.ts_us, s.score, count(p.event_id) AS n, count(DISTINCT p.dst_ip) AS ips, count(DISTINCT p.dst_port) AS ports FROM scored s
  LEFT JOIN packets p ON p.src_ip = split_part(s.key, '-', 1) AND p.ts_us <= s.ts_us AND p.proto = 6 AND p.flags & 18 = 2 GROUP BY ALL)
--result
SELECT key, ts_us AS detected_at_us, score, CASE WHEN score <= 0.5 THEN 'benign' WHEN n >= 3 AND ips / n < 0.9 AND ports / n < 0.9 THEN 'attack' ELSE 'held' END AS class FROM gate""", "packets")
def gated_flows_stream(spark, sf):
    """Scores and gate come from streams of their own and are joined as streams. The window holds the whole table, so no source grows stale."""
    window, far = 60 * DAYS, 400 * DAYS
    flows = DT.score_flow_stream(_stream(spark, sf), LinearScore({1: 0.8, 3: 0.01}, -1.0), config.FLOW.with_(threshold=0.5), forget_sec=far)
    scores = PL.run_to_end(flows, spark, "scores")
    pieces = PL.run_to_end(DT.open_gate_stream(_stream(spark, sf, 3 * window * 1_000_000), window, min_rate=3, max_ip_ratio=0.9, max_port_ratio=0.9), spark, "pieces")
    end = C.packets(spark, sf).agg((F.max("ts_us") + 8 * window * 1_000_000).alias("ts_us"))

    def stream(rows, *at):
        """The rows as a stream; a last one of no flow moves the watermark past all others."""
        last = end.select(F.lit("end").alias("key"), *[F.col("ts_us").alias(c) for c in at], "ts_us")
        return PL.replay(spark, rows.withColumn("ts_us", F.col(at[0])).unionByName(last, allowMissingColumns=True), order=("ts_us", "key"))

    out = DT.gated_flows_stream(stream(scores, "detected_at_us"), stream(pieces, "until_us", "from_us"), 0.5, window)
    return PL.run_to_end(out, spark, "gated")


@query("tumbling_stream", "src_ip win_start:i packets:i syns:i distinct_ports:i", f"""SELECT src_ip, ts_us // 1000000 // {C.WEEK} * {C.WEEK} AS win_start, count(*) AS packets,
  count(*) FILTER (WHERE {SYN_WHERE}) AS syns, count(DISTINCT dst_port) AS distinct_ports FROM packets GROUP BY ALL""", "packets")
def tumbling_stream(spark, sf):
    """The marker row's own window never closes, so the output is that of the packets."""
    return PL.run_to_end(PL.window_counts(_stream(spark, sf), "7 days", lateness="1 day"), spark, "tumbling")


@query("sliding_stream", "src_ip win_start:i packets:i syns:i distinct_ports:i", f"""SELECT src_ip, win_start, count(*) AS packets, count(*) FILTER (WHERE {SYN_WHERE}) AS syns,
  count(DISTINCT dst_port) AS distinct_ports FROM (SELECT *, unnest(range(ts_us // 1000000 // {C.WEEK} * {C.WEEK} - {C.WEEK}, ts_us // 1000000 // {C.WEEK} * {C.WEEK} + 1, {C.WEEK})) AS win_start FROM packets) GROUP BY ALL""", "packets")
def sliding_stream(spark, sf):
    return PL.run_to_end(PL.window_counts(_stream(spark, sf), "14 days", "7 days", "1 day"), spark, "sliding")


@query("late_rows", "event_id:i seen:i some_late:i some_used:i", "SELECT event_id, 1 AS seen, 1 AS some_late, 1 AS some_used FROM packets", "packets")
def late_rows(spark, sf):
    """Packets of clients with even port arrive 20 days after their time. Rows used and rows behind the watermark are all rows, each once."""
    PL.use_rocksdb(spark)
    p = C.packets(spark, sf)
    delayed = p.withColumn("arrived", F.col("ts_us") + F.when(F.col("src_port") % 2 == 0, 20 * C.DAY * 1_000_000).otherwise(0))
    out = PL.run_to_end(PL.split_late(PL.replay(spark, delayed, slices=4, order=("arrived", "event_id")), "1 day"), spark, "late")
    n = out.groupBy("event_id").agg(F.count("*").alias("seen"))
    late, used = (out.agg(F.max(c.cast("int"))).scalar() for c in (F.col("late"), ~F.col("late")))
    return n.withColumns({"some_late": late, "some_used": used})


@query("flush_idle", "state keys:i", "SELECT unnest(['profile', 'ports', 'ips', 'sports', 'times']) AS state, 0 AS keys FROM (SELECT count(*) AS n FROM packets) WHERE n > 0", "packets")
def flush_idle(spark, sf):
    """After the last packet timers score and forget every source, those that sent probes only as well: no state is left."""
    checkpoint = new_folder(spark, "idle-cp")
    cfg = config.SCAN.with_(window_sec=DAYS, min_events=2, min_dst_ports=2)
    PL.run_to_end(DT.detect_scan_stream(_stream(spark, sf), LinearScore({1: 1.0}, -1.0), cfg), spark, "idle", checkpoint)
    return PL.state_left(spark, checkpoint, ["profile", "ports", "ips", "sports", "times"])


@query("bounded_history_stream", "engine alert_id:i", f""", {LIVE_SQL}
--result
SELECT engine, alert_id FROM live WHERE engine IN ('dos_agg', 'portscan', 'bruteforce', 'bot') UNION SELECT engine, alert_id FROM (SELECT * FROM live ORDER BY ts_us DESC, alert_id DESC LIMIT 300)""", "packets")
def bounded_history_stream(spark, sf):
    """The last 300 alerts and every window-level alert, kept up to date by a stream."""
    PL.use_rocksdb(spark)
    a = live(spark, sf).select("engine", "alert_id", "ts_us")
    changes = PL.run_to_end(PL.bounded_history_stream(PL.replay(spark, a, slices=5, order=("ts_us", "alert_id")), 300), spark, "history")
    return PL.read_history(changes, a, 300)


def _alert_stream(spark, sf):
    path = new_folder(spark, "landing")
    fixtures.alert_lines(spark, sf).repartition(3).write.text(path)
    return logs.tail_alerts(spark, path, max_files=1)


@query("tail_alerts", "ts_text pkt_num:i src_ip dst_ip gid:i", "SELECT * FROM alerts", "alerts")
def tail_alerts(spark, sf):
    return PL.run_to_end(_alert_stream(spark, sf), spark, "tailed")


@query("enrich_alert_stream", "engine ground_truth n:i scored:i", """, fi AS (SELECT flow_id, max(CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END) AS bad FROM flows GROUP BY flow_id),
ii AS (SELECT src_ip, max(CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END) AS bad FROM flows GROUP BY src_ip),
a AS (SELECT *, CASE gid WHEN 301 THEN 'xgboost' WHEN 302 THEN 'portscan' WHEN 303 THEN 'dos_agg' WHEN 304 THEN 'ddos' WHEN 306 THEN 'bot' WHEN 307 THEN 'bruteforce' ELSE 'community' END AS engine FROM alerts),
x AS (SELECT a.*, CASE WHEN engine IN ('portscan', 'dos_agg', 'bot', 'bruteforce') THEN ii.bad WHEN src_port <> 0 AND a.src_ip NOT LIKE '224.%' THEN fi.bad END AS bad,
  CASE WHEN engine IN ('portscan', 'dos_agg', 'bot', 'bruteforce') AND ii.src_ip IS NOT NULL THEN 1 ELSE 0 END AS s
  FROM a LEFT JOIN ii ON a.src_ip = ii.src_ip LEFT JOIN fi ON fi.flow_id = concat(a.src_ip,'-',dst_ip,'-',src_port,'-',dst_port,'-',CASE proto WHEN 'TCP' THEN 6 ELSE 17 END))
--result
SELECT engine, CASE bad WHEN 1 THEN 'attack' WHEN 0 THEN 'benign' END AS ground_truth, count(*) AS n, sum(s) AS scored FROM x GROUP BY ALL""", "alerts")
def enrich_alert_stream(spark, sf):
    f = C.flows(spark, sf)
    scores = f.groupBy("src_ip").agg(F.max("score").alias("score"), F.max("pkt_num").alias("seq"))
    path = new_folder(spark, "enriched")
    PL.enrich_alert_stream(_alert_stream(spark, sf), CF.flow_index(f), CF.ip_index(f), scores, path, new_folder(spark, "enriched-cp")).awaitTermination()
    return spark.read.parquet(path).groupBy("engine", "ground_truth").agg(F.count("*").alias("n"), F.count("score").alias("scored"))


@query("publish_alerts", "alert_id:i score:d", "SELECT event_id AS alert_id, CASE WHEN flags = 2 THEN payload_len / 64 END AS score FROM packets WHERE flags IN (2, 4)", "packets")
def publish_alerts(spark, sf):
    """Alerts are published without a score first; scan alerts get it later as an update of the same id."""
    p = C.packets(spark, sf).filter("flags in (2, 4)").select(F.col("event_id").alias("alert_id"), "ts_us", (F.col("payload_len") / 64).alias("score"), "flags")
    first = p.withColumn("score", F.lit(None).cast("double"))
    later = p.filter("flags = 2").withColumn("ts_us", F.col("ts_us") + 40 * 86_400_000_000)
    s = PL.replay(spark, first.unionByName(later), slices=6, order=("ts_us", "alert_id"))
    path = new_folder(spark, "published")
    writers.publish_alerts(s, path, new_folder(spark, "published-cp")).start().awaitTermination()
    return writers.read_published(spark, path)
