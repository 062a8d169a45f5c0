"""Sources and sinks: tables are written in the foreign formats first, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import fixtures, schemas
from tidewatch.config import FLOW_FEATURES_15
from tidewatch.plans import q_common as C
from tidewatch.plans.registry import query
from tidewatch.session import new_folder
from tidewatch.sinks import writers
from tidewatch.sources import logs, tables


def _csv(df, path, header=True, **options):
    w = df.write.option("header", header).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False)
    for k, v in options.items():
        w = w.option(k, v)
    w.csv(path)
    return path


@query("read_flow_table", "flow_id label dst_port:i dur:d spkts:d", "SELECT flow_id, label, dst_port, dur, spkts FROM flows", "flows")
def read_flow_table(spark, sf):
    """Two day files with blanks around header names and labels."""
    f = C.flows(spark, sf)
    def day_file(rows, name):
        out = rows.select(F.col("flow_id").alias("Flow ID"), F.col("dst_port").alias(" Destination Port"),
                          F.col("dur").alias(" Flow Duration"), F.col("spkts").alias(" Total Fwd Packets"),
                          F.concat(F.lit(" "), "label").alias(" Label"))
        return _csv(out, new_folder(spark, name))
    early = F.col("day").isin("Monday", "Tuesday", "Wednesday")
    t = tables.read_flow_table(spark, [day_file(f.filter(early), "early"), day_file(f.filter(~early), "late")])
    return t.select(F.col("Flow ID").alias("flow_id"), F.col("Label").alias("label"),
                    F.col("Destination Port").alias("dst_port"), F.col("Flow Duration").alias("dur"),
                    F.col("Total Fwd Packets").alias("spkts"))


@query("read_flow_table_encoding", "src_ip label", "SELECT src_ip, concat(label, ' é') AS label FROM flows", "flows")
def read_flow_table_encoding(spark, sf):
    f = C.flows(spark, sf).select(F.col("src_ip").alias(" Source IP"), F.col("sbytes").alias("unused"),
                                  F.concat("label", F.lit(" é")).alias(" Label"))
    path = _csv(f, new_folder(spark, "latin"), encoding="ISO-8859-1")
    t = tables.read_flow_table(spark, path, ["Source IP", "Label"], "windows-1252", id_column=None)
    return t.select(F.col("Source IP").alias("src_ip"), F.col("Label").alias("label"))


@query("read_headerless_flows", "srcip dsport dur:d sbytes:d Spkts:d attack_cat label:i",
       """SELECT src_ip AS srcip, CAST(dst_port AS VARCHAR) AS dsport, dur / 1e6 AS dur, sbytes, spkts AS "Spkts",
  CASE WHEN label = 'BENIGN' THEN NULL ELSE label END AS attack_cat, CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END AS label
  FROM flows WHERE spkts % 7 <> 3""", "flows")
def read_headerless_flows(spark, sf):
    f = C.feature_frame(spark, sf, "src_ip", "dst_ip", "src_port", "dst_port", "label", "proto")
    given = {"srcip": "src_ip", "dstip": "dst_ip", "sport": "src_port", "dsport": "dst_port", "proto": "proto",
             "dur": "dur", "sbytes": "sbytes", "dbytes": "dbytes", "smeansz": "smeansz", "dmeansz": "dmeansz",
             "swin": "swin", "dwin": "dwin", "Spkts": "spkts", "Dpkts": "dpkts", "Dintpkt": "dintpkt"}
    cols = {n: F.col(given[n]).cast("string") if n in given else F.lit("0") for n in schemas.HEADERLESS_COLUMNS}
    cols["Sintpkt"] = F.when(F.col("spkts") % 7 == 3, "-").otherwise(F.col("sintpkt").cast("string"))
    cols["attack_cat"] = F.when(F.col("label") != "BENIGN", F.concat(F.lit(" "), "label"))
    cols["label"] = F.when(F.col("label") == "BENIGN", "0").otherwise("1")
    out = f.select(*[c.alias(n) for n, c in cols.items()])
    path = _csv(out, new_folder(spark, "headerless"), header=True)   # every part opens with a header row
    return tables.read_headerless_flows(spark, path)


@query("read_netflow_csv", "src_ip dst_ip dst_port:i ts_us:i label", """SELECT src_ip, dst_ip, dst_port, ts_us,
  CASE WHEN label = 'PortScan' THEN 'flow=From-Botnet-V1' ELSE 'flow=Background' END AS label FROM flows
  WHERE src_ip IN (SELECT src_ip FROM flows WHERE label = 'PortScan')""", "flows")
def read_netflow_csv(spark, sf):
    f = C.flows(spark, sf).select(
        F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("x"), "*").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("StartTime"), F.lit("tcp").alias("Proto"),
        F.col("src_ip").alias("SrcAddr"), F.col("src_port").alias("Sport"), F.col("dst_ip").alias("DstAddr"),
        F.concat(F.lit("0x"), F.hex("dst_port")).alias("Dport"),
        F.when(F.col("label") == "PortScan", "flow=From-Botnet-V1").otherwise("flow=Background").alias("Label"))
    return tables.read_netflow_csv(spark, _csv(f, new_folder(spark, "netflow")))


@query("parse_alert_lines", "ts_text pkt_num:i proto src_ip src_port:i dst_ip dst_port:i gid:i sid:i ts_us:i", """SELECT *,
  epoch_us(strptime('2000/' || ts_text, '%Y/%m/%d-%H:%M:%S.%f')) AS ts_us FROM alerts""", "alerts")
def parse_alert_lines(spark, sf):
    return logs.parse_alert_lines(fixtures.alert_lines(spark, sf))


@query("alert_drop_report", "total:i filtered:i few_fields:i bad_address_or_id:i invalid_ip:i port_zero:i unknown_protocol:i",
       """SELECT count(*) AS total, count(*) FILTER (WHERE bad <> '') AS filtered,
  count(*) FILTER (WHERE bad = 'few') AS few_fields, count(*) FILTER (WHERE bad = 'v6') AS bad_address_or_id,
  count(*) FILTER (WHERE bad = 'ip') AS invalid_ip, count(*) FILTER (WHERE bad = 'zero') AS port_zero,
  0 AS unknown_protocol
  FROM (SELECT CASE WHEN len(p) < 9 THEN 'few' WHEN p[7] LIKE 'fe80%' THEN 'v6' WHEN p[7] LIKE '224.%' THEN 'ip'
    WHEN p[7] LIKE '%:0' THEN 'zero' ELSE '' END AS bad FROM alert_fields)""", "alerts")
def alert_drop_report(spark, sf):
    return logs.alert_drop_report(fixtures.alert_lines(spark, sf))


@query("parse_feature_log", "pkt_num:i " + " ".join(f"{c}:d3" for c in FLOW_FEATURES_15) + " score:d", """SELECT pkt_num,
  dur / 1e6 AS dur, spkts, dpkts, CAST(sbytes AS BIGINT) AS sbytes, CAST(floor(dbytes) AS BIGINT) AS dbytes, spkts AS smeansz, dpkts AS dmeansz,
  line / 8 AS sintpkt, line / 4 AS dintpkt, spkts AS fwd_pkt_mean, dpkts AS bwd_pkt_mean, fin_cnt, ack_cnt, syn_cnt, line / 4 AS bwd_iat,
  score FROM (SELECT * REPLACE (floor(sbytes) AS sbytes) FROM flows) WHERE dpkts <> 3""", "flows")
def parse_feature_log(spark, sf):
    f = C.flows(spark, sf)
    keys = {"dur": F.col("dur") / 1e6, "sp": "spkts", "dp": "dpkts", "sb": F.floor("sbytes"), "db": F.floor("dbytes"),
            "smsz": "spkts", "dmsz": "dpkts", "si": F.col("line") / 8, "di": F.col("line") / 4, "fwd": "spkts",
            "bwd": "dpkts", "fin": "fin_cnt", "ack": "ack_cnt", "syn": "syn_cnt", "biat": F.col("line") / 4}
    body = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), (F.col(v) if isinstance(v, str) else v).cast("string"))
                              for k, v in keys.items()])
    text = F.concat(F.lit("[dos_inspector] s1-high pkts=8 score="), F.col("score").cast("string"), F.lit(" | "), body,
                    F.when(F.col("dpkts") == 3, "").otherwise(" sid=1"))
    path = new_folder(spark, "featurelog")
    f.select("pkt_num", text.alias("value")).write.parquet(path)
    return logs.parse_feature_log(spark.read.parquet(path), keep=("pkt_num",))


@query("parse_score_log", "src_ip windows:i alert_windows:i syns:i alert_syns:i best_score:d", """SELECT src_ip, count(*) AS windows,
  count(*) FILTER (WHERE score >= 0.55) AS alert_windows, sum(spkts) AS syns,
  coalesce(sum(spkts) FILTER (WHERE score >= 0.55), 0) AS alert_syns, max(score) AS best_score
  FROM flows WHERE dpkts <> 3 GROUP BY src_ip""", "flows")
def parse_score_log(spark, sf):
    f = C.flows(spark, sf)
    text = F.format_string("%s[portscan] %s syn=%d/%d fnx=%d score=%.4f", F.when(F.col("dpkts") == 3, "x").otherwise("y"),
                           "src_ip", "spkts", "ack_cnt", "fin_cnt", "score")
    text = F.when(F.col("dpkts") == 3, F.replace(text, F.lit("score="), F.lit("pending="))).otherwise(text)
    return logs.score_log_summary(logs.parse_score_log(f.select(text.alias("value")), "portscan"), 0.55)


@query("read_score_stream", "src_ip seq:i score:d first_feature:d", """SELECT src_ip, event_id AS seq, payload_len / 64 AS score,
  payload_len AS first_feature FROM packets QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY event_id DESC) = 1""", "packets")
def read_score_stream(spark, sf):
    p = C.packets(spark, sf).select(F.lit("portscan").alias("engine"), "src_ip", (F.col("payload_len") / 64).alias("score"),
                                    F.array(F.col("payload_len").cast("double"), F.col("tcp_win").cast("double")).alias("features"),
                                    F.col("event_id").alias("seq"))
    path = new_folder(spark, "scores")
    p.write.json(path)
    return tables.read_score_stream(spark, path, "seq").withColumn("first_feature", F.get("features", F.lit(0)))


@query("read_score_stream_by_line", "src_ip score:d first_feature:d", """SELECT src_ip, payload_len / 64 AS score,
  payload_len AS first_feature FROM packets QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY ts_us DESC, event_id DESC) = 1""", "packets")
def read_score_stream_by_line(spark, sf):
    """Lines without a sequence column: the last one of the file counts. The file is split over several tasks."""
    p = C.packets(spark, sf).orderBy("ts_us", "event_id").select(F.lit("portscan").alias("engine"), "src_ip", (F.col("payload_len") / 64).alias("score"),
                                                                F.array(F.col("payload_len").cast("double"), F.col("tcp_win").cast("double")).alias("features"))
    path = new_folder(spark, "score-lines")
    p.coalesce(1).write.json(path)
    return tables.read_score_stream(spark, path, latest=True).withColumn("first_feature", F.get("features", F.lit(0)))


@query("read_flow_table_orders", "flow_id label dst_port:i dur:d", "SELECT flow_id, label, dst_port, dur FROM flows", "flows")
def read_flow_table_orders(spark, sf):
    """One folder whose files have two column orders, one of them with a further column."""
    f, path = C.flows(spark, sf), new_folder(spark, "orders")
    one = {"Flow ID": "flow_id", " Destination Port": "dst_port", " Flow Duration": "dur", " Label": "label"}
    two = {" Label": "label", " Flow Duration": "dur", " Protocol": "proto", "Flow ID": "flow_id", " Destination Port": "dst_port"}
    for names, rows in ((one, f.filter("line <= 3")), (two, f.filter("line > 3"))):
        rows.select(*[F.col(c).alias(n) for n, c in names.items()]).write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    t = tables.read_flow_table(spark, path)
    return t.select(F.col("Flow ID").alias("flow_id"), F.col("Label").alias("label"), F.col("Destination Port").alias("dst_port"), F.col("Flow Duration").alias("dur"))


DUMP = ("lb", "spkts", "dpkts", "swin", "score", "src_ip")


@query("read_feature_dump", "lb:i spkts:d dpkts:d swin:d score:d src_ip:i", """SELECT 0 AS lb, spkts, dpkts, swin, score,
  CASE WHEN ack_cnt = 7 THEN NULL ELSE 2886729728 + CAST(string_split(src_ip,'.')[4] AS BIGINT) END AS src_ip FROM flows WHERE dpkts <> 5""", "flows")
def read_feature_dump(spark, sf):
    """Wide and narrow rows, rows that are too short, and comment lines."""
    from tidewatch.functions.addresses import ip_to_long
    f = C.flows(spark, sf)
    head = F.concat_ws("  ", F.lit(" 0"), F.col("spkts").cast("string"), F.col("dpkts").cast("string"),
                       F.col("swin").cast("string"), F.col("score").cast("string"))
    line = F.when(F.col("dpkts") == 5, F.lit("# 0 1 2 3")).when(F.col("ack_cnt") == 7, head).otherwise(
        F.concat_ws(" ", head, ip_to_long("src_ip").cast("string")))
    path = new_folder(spark, "dump")
    f.select(line.alias("value")).write.text(path)
    return tables.read_feature_dump(spark, path, DUMP, 5)


@query("read_packet_export", "src_ip dst_ip src_port:i dst_port:i proto:i", """SELECT src_ip, dst_ip, src_port, dst_port, proto
  FROM packets WHERE flags <> 4""", "packets")
def read_packet_export(spark, sf):
    p = C.packets(spark, sf)
    def port(name, proto):
        return F.when(F.col("proto") == proto, F.col(name).cast("string")).otherwise("")
    proto = F.when(F.col("flags") == 4, F.when(F.col("src_port") % 2 == 0, "1").otherwise("x")).otherwise(
        F.col("proto").cast("string"))
    out = p.select("src_ip", "dst_ip", port("src_port", 6), port("dst_port", 6), port("src_port", 17),
                   port("dst_port", 17), proto)
    return tables.read_packet_export(spark, _csv(out, new_folder(spark, "export"), header=False, sep="\t"))


@query("load_registry", "scenario active_engine metric_level ml_alerts:i tp:i fp:i fpr:d attack_rows:i benign_rows:i", """SELECT lower(day) AS scenario,
  'xgboost' AS active_engine, 'flow' AS metric_level, count(*) FILTER (WHERE alerted) AS ml_alerts,
  count(*) FILTER (WHERE alerted AND label <> 'BENIGN') AS tp, count(*) FILTER (WHERE alerted AND label = 'BENIGN') AS fp,
  count(*) FILTER (WHERE alerted AND label = 'BENIGN') / count(*) FILTER (WHERE label = 'BENIGN') AS fpr,
  count(*) FILTER (WHERE label <> 'BENIGN') AS attack_rows, count(*) FILTER (WHERE label = 'BENIGN') AS benign_rows
  FROM flows GROUP BY day""", "flows")
def load_registry(spark, sf):
    """A registry document with one scenario per week day of the flows."""
    a, hit = F.col("label") != "BENIGN", F.col("alerted")
    per = C.flows(spark, sf).groupBy(F.lower("day").alias("k")).agg(
        F.count_if(hit).alias("alerts"), F.count_if(hit & a).alias("tp"), F.count_if(hit & ~a).alias("fp"),
        F.count_if(a).alias("ar"), F.count_if(~a).alias("br"))
    blob = F.struct(
        F.col("k").alias("pcap_name"), F.lit("xgboost").alias("active_engine"), F.lit("flow").alias("metric_level"),
        F.struct("alerts", F.create_map(F.lit("TP"), "tp", F.lit("FP"), "fp").alias("confusion"),
                 (F.col("fp") / F.col("br")).alias("fpr")).alias("ml"),
        F.create_map(F.lit("flow_level"), F.create_map(F.lit("attack_rows"), "ar", F.lit("benign_rows"), "br")).alias("slice_universe"))
    # at most seven scenarios, so one map holds them
    doc = per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", blob)))).alias("value"))
    path = new_folder(spark, "registry")
    doc.coalesce(1).write.text(path)
    return tables.load_registry(spark, path).select("*")


@query("write_features", "day rows:i spkts:d", "SELECT day, count(*) AS rows, sum(spkts) AS spkts FROM flows GROUP BY day", "flows")
def write_features(spark, sf):
    path = new_folder(spark, "features")
    writers.write_features(C.feature_frame(spark, sf, "day", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "score"), path)
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("rows"), F.sum("spkts").alias("spkts"))


@query("write_scores", "src_ip rows:i best:d width:i", """SELECT src_ip, count(*) AS rows, max(score) AS best, 11 AS width FROM flows
  WHERE alerted GROUP BY src_ip""", "flows")
def write_scores(spark, sf):
    path = new_folder(spark, "scorelines")
    f = C.feature_frame(spark, sf, "src_ip", "score", "alerted").filter("alerted").withColumn("engine", F.lit("xgboost"))
    writers.write_scores(f, path, C.ELEVEN)
    return tables.read_score_stream(spark, path).groupBy("src_ip").agg(
        F.count("*").alias("rows"), F.max("score").alias("best"), F.max(F.size("features")).alias("width"))


@query("write_report", "label n:i", "SELECT label, count(*) AS n FROM flows GROUP BY label", "flows")
def write_report(spark, sf):
    path = new_folder(spark, "report")
    writers.write_report(C.flows(spark, sf).groupBy("label").agg(F.count("*").alias("n")), path, "csv")
    return spark.read.option("header", True).csv(path)
