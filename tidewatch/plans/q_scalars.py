"""Projections, predicates and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import fixtures
from tidewatch.functions import addresses as A, features as X, labels as L, packets as P
from tidewatch.operators.diagnostics import PACKET_SWEEP
from tidewatch.session import literal_table
from tidewatch import config
from tidewatch.plans import q_common as C
from tidewatch.plans.registry import query


@query("classify_packet", "event_id:i kind", """SELECT event_id, CASE WHEN flags & 22 = 2 THEN 'S' ELSE 'F' END AS kind
  FROM packets WHERE proto = 6 AND (flags & 22 = 2 OR flags = 0 OR (flags & 22 = 0 AND flags & 41 <> 0))""", "packets")
def classify_packet(spark, sf):
    return C.packets(spark, sf).withColumn("kind", P.classify_packet("flags")).filter("kind is not null")


@query("is_syn", "event_id:i src_ip", "SELECT event_id, src_ip FROM packets WHERE flags & 2 <> 0 AND flags & 16 = 0",
       "packets")
def is_syn(spark, sf):
    return C.packets(spark, sf).filter(P.is_syn("flags"))


@query("packet_role", "event_id:i syn:i syn_ack:i rst:i fin:i psh:i", """SELECT event_id,
  CASE WHEN flags & 2 <> 0 AND flags & 16 = 0 THEN 1 ELSE 0 END AS syn,
  CASE WHEN flags & 18 = 18 THEN 1 ELSE 0 END AS syn_ack, (flags & 4) // 4 AS rst, flags & 1 AS fin,
  (flags & 8) // 8 AS psh FROM packets""", "packets")
def packet_role(spark, sf):
    return C.packets(spark, sf).select("event_id", P.packet_role("flags").alias("r")).select("event_id", "r.*")


@query("ip_to_long", "event_id:i src_long:i", """SELECT event_id, CAST(p[1] AS BIGINT) * 16777216 + CAST(p[2] AS BIGINT) * 65536
  + CAST(p[3] AS BIGINT) * 256 + CAST(p[4] AS BIGINT) AS src_long
  FROM (SELECT event_id, string_split(src_ip, '.') AS p FROM packets)""", "packets")
def ip_to_long(spark, sf):
    return C.packets(spark, sf).select("event_id", A.ip_to_long("src_ip").alias("src_long"))


@query("long_to_ip", "event_id:i src_ip dst_ip", "SELECT event_id, src_ip, dst_ip FROM packets", "packets")
def long_to_ip(spark, sf):
    return C.packets(spark, sf).select("event_id", A.long_to_ip(A.ip_to_long("src_ip")).alias("src_ip"),
                                       A.long_to_ip(A.ip_to_long("dst_ip")).alias("dst_ip"))


@query("is_private_ip", "flow_id src:i dst:i", """SELECT flow_id,
  CASE WHEN src_ip LIKE '10.%' OR src_ip LIKE '192.168.%' OR regexp_matches(src_ip, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') THEN 1 ELSE 0 END AS src,
  CASE WHEN dst_ip LIKE '10.%' OR dst_ip LIKE '192.168.%' THEN 1 ELSE 0 END AS dst
  FROM (SELECT flow_id, src_ip, dst_ip FROM flows UNION ALL SELECT flow_key, src_ip, dst_ip FROM packets)""",
       "packets flows")
def is_private_ip(spark, sf):
    f = C.flows(spark, sf).select("flow_id", "src_ip", "dst_ip").union(
        C.packets(spark, sf).select("flow_key", "src_ip", "dst_ip"))
    return f.select("flow_id", A.is_private_ip("src_ip").alias("src"), A.is_private_ip("dst_ip", True).alias("dst"))


@query("is_valid_ip", "pkt_num:i src_ip valid:i", """SELECT pkt_num, src_ip,
  CASE WHEN src_ip LIKE '224.%' OR src_ip LIKE '239.%' OR src_ip = '' THEN 0 ELSE 1 END AS valid FROM alerts""", "alerts")
def is_valid_ip(spark, sf):
    return C.alerts(spark, sf).withColumn("valid", A.is_valid_ip("src_ip"))


@query("map_ip", "flow_id dst_ip", """SELECT flow_id,
  CASE WHEN dst_ip = '192.168.10.3' THEN '192.168.10.200' ELSE dst_ip END AS dst_ip FROM flows""", "flows")
def map_ip(spark, sf):
    alias = literal_table(spark, [("192.168.10.3", "192.168.10.200")], "alias string, address string")
    return A.map_ip_table(C.flows(spark, sf).select("flow_id", "dst_ip"), "dst_ip", alias)


@query("proto_num", "pkt_num:i proto proto_no:i", """SELECT pkt_num, proto,
  CASE proto WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 WHEN 'ICMP' THEN 1 ELSE 0 END AS proto_no FROM alerts""", "alerts")
def proto_num(spark, sf):
    return C.alerts(spark, sf).withColumn("proto_no", A.proto_num("proto"))


@query("split_addr", "addr ip port:i", """SELECT addr, CASE WHEN addr LIKE 'fe80%' THEN NULL ELSE string_split(addr,':')[1] END AS ip,
  CASE WHEN addr LIKE 'fe80%' THEN NULL ELSE CAST(string_split(addr,':')[2] AS INTEGER) END AS port
  FROM (SELECT trim(string_split(value, ',')[7]) AS addr FROM alert_lines)""", "alert_lines")
def split_addr(spark, sf):
    a = fixtures.alert_lines(spark, sf).select(F.trim(F.get(F.split("value", ","), F.lit(6))).alias("addr"))
    return a.withColumn("x", A.split_addr("addr")).select("addr", "x.ip", "x.port")


@query("flow_id_candidates", "pkt_num:i pos:i flow_id", """, c AS (SELECT *, CASE proto WHEN 'TCP' THEN 6 ELSE 17 END AS pn,
  CASE WHEN dst_ip = '192.168.10.3' THEN '192.168.10.200' ELSE dst_ip END AS md FROM alerts)
--result
SELECT pkt_num, 0 AS pos, concat(dst_ip,'-',src_ip,'-',dst_port,'-',src_port,'-',pn) AS flow_id FROM c
  UNION ALL SELECT pkt_num, 1, concat(src_ip,'-',dst_ip,'-',src_port,'-',dst_port,'-',pn) FROM c
  UNION ALL SELECT pkt_num, 2, concat(md,'-',src_ip,'-',dst_port,'-',src_port,'-',pn) FROM c WHERE md <> dst_ip
  UNION ALL SELECT pkt_num, 3, concat(src_ip,'-',md,'-',src_port,'-',dst_port,'-',pn) FROM c WHERE md <> dst_ip""", "alerts")
def flow_id_candidates(spark, sf):
    alias = {"192.168.10.3": "192.168.10.200"}
    a = C.alerts(spark, sf).withColumn("pn", A.proto_num("proto"))
    return a.select("pkt_num", F.posexplode(A.flow_id_candidates("src_ip", "dst_ip", "src_port", "dst_port", "pn",
                                                                 alias)).alias("pos", "flow_id"))


@query("reverse_flow_id", "flow_id reversed", """SELECT flow_id,
  concat(dst_ip,'-',src_ip,'-',dst_port,'-',src_port,'-',proto) AS reversed FROM flows""", "flows")
def reverse_flow_id(spark, sf):
    return C.flows(spark, sf).select("flow_id", A.reverse_flow_id("flow_id").alias("reversed"))


def table_a(spark, sf):
    """Flows under the header names of label table A."""
    return C.flows(spark, sf).select(
        F.col("flow_id").alias("Flow ID"), F.col("dur").alias("Flow Duration"),
        F.col("spkts").alias("Total Fwd Packets"), F.col("dpkts").alias("Total Backward Packets"),
        F.col("sbytes").alias("Total Length of Fwd Packets"), F.col("dbytes").alias("Total Length of Bwd Packets"),
        F.col("smeansz").alias("Fwd Packet Length Mean"), F.col("dmeansz").alias("Bwd Packet Length Mean"),
        (F.col("swin") - 15000).alias("Init_Win_bytes_forward"), F.col("dwin").alias("Init_Win_bytes_backward"),
        F.col("fwd_iat").alias("Fwd IAT Mean"), F.col("bwd_iat").alias("Bwd IAT Mean"),
        F.col("fin_cnt").alias("FIN Flag Count"), F.col("ack_cnt").alias("ACK Flag Count"),
        F.col("syn_cnt").alias("SYN Flag Count"))


@query("to_unified_flow", "flow_id dur:d spkts:d dpkts:d sbytes:d dbytes:d smeansz:d dmeansz:d swin:d dwin:d sintpkt:d dintpkt:d",
       """SELECT flow_id, dur / 1e6 AS dur, spkts, dpkts, sbytes, dbytes, smeansz, dmeansz, swin - 15000 AS swin, dwin,
  fwd_iat / 1e3 AS sintpkt, bwd_iat / 1e3 AS dintpkt FROM flows""", "flows")
def to_unified_flow(spark, sf):
    return X.to_unified_flow(table_a(spark, sf), 11, [F.col("Flow ID").alias("flow_id")])


FLOW_SQL = {"dur": "dur / 1e6", "spkts": "spkts", "dpkts": "dpkts", "sbytes": "sbytes", "dbytes": "dbytes", "smeansz": "smeansz", "dmeansz": "dmeansz",
            "swin": "greatest(swin - 15000, 0)", "dwin": "dwin", "sintpkt": "fwd_iat / 1e3", "dintpkt": "bwd_iat / 1e3", "fwd_pkt_mean": "smeansz",
            "bwd_pkt_mean": "dmeansz", "fin_cnt": "fin_cnt", "ack_cnt": "ack_cnt", "syn_cnt": "syn_cnt", "bwd_iat": "bwd_iat / 1e3"}
FOREIGN_SQL = FLOW_SQL | {"swin": "0", "dwin": "0", "fwd_pkt_mean": "sbytes / greatest(spkts, 1)", "bwd_pkt_mean": "dbytes / greatest(dpkts, 1)",
                          "fin_cnt": "0", "ack_cnt": "0", "syn_cnt": "0"}


def _flow_query(names, sql):
    return f"flow_id {' '.join(n + ':d' for n in names)}", f"SELECT flow_id, {', '.join(f'{sql[n]} AS {n}' for n in names)} FROM flows", "flows"


@query("to_unified_flow_17", *_flow_query(config.FLOW_FEATURES_17, FLOW_SQL))
def to_unified_flow_17(spark, sf):
    return X.to_unified_flow(table_a(spark, sf), 17, [F.col("Flow ID").alias("flow_id")])


@query("to_unified_flow_15", *_flow_query(config.FLOW_FEATURES_15, FLOW_SQL))
def to_unified_flow_15(spark, sf):
    return X.to_unified_flow(table_a(spark, sf), 15, [F.col("Flow ID").alias("flow_id")])


@query("align_foreign_flow", *_flow_query(config.FLOW_FEATURES_17, FOREIGN_SQL))
def align_foreign_flow(spark, sf):
    return X.align_foreign_flow(C.feature_frame(spark, sf, "flow_id"), 17, ["flow_id"])


@query("first_available", "flow_id packets:d missing:d", "SELECT flow_id, spkts AS packets, -1 AS missing FROM flows", "flows")
def first_available(spark, sf):
    df = table_a(spark, sf)
    return df.select(F.col("Flow ID").alias("flow_id"),
                     X.first_available(df, ["Fwd Packets", "Total Fwd Packets"]).alias("packets"),
                     X.first_available(df, ["Dst Port", "dst_port"], -1).alias("missing"))


@query("clean_numeric", "flow_id rate:d", """SELECT flow_id, dpkts / spkts AS rate FROM flows
  WHERE dpkts > 0 AND spkts % 7 <> 3""", "flows")
def clean_numeric(spark, sf):
    """Texts as found in label tables: 'Infinity', 'NaN' and words beside numbers."""
    f = C.flows(spark, sf)
    text = F.when(F.col("dpkts") == 0, F.when(F.col("spkts") % 2 == 0, "Infinity").otherwise("NaN")).when(
        F.col("spkts") % 7 == 3, "n/a").otherwise((F.col("dpkts") / F.col("spkts")).cast("string"))
    return X.clean_numeric(f.select("flow_id", text.alias("rate")), ["rate"])


@query("log1p_cols", "flow_id sbytes:d dbytes:d swin:d", """SELECT flow_id, ln(1 + sbytes) AS sbytes, ln(1 + dbytes) AS dbytes,
  ln(1 + greatest(swin - 15000, 0)) AS swin FROM flows""", "flows")
def log1p_cols(spark, sf):
    f = C.flows(spark, sf).withColumn("swin", F.col("swin") - 15000)
    return X.log1p_cols(f, ["sbytes", "dbytes", "swin"])


@query("clamp", "flow_id swin:d dwin:d", "SELECT flow_id, least(swin, 1020) AS swin, least(dwin, 1020) AS dwin FROM flows", "flows")
def clamp(spark, sf):
    return C.flows(spark, sf).select("flow_id", X.clamp("swin").alias("swin"), X.clamp("dwin").alias("dwin"))


@query("binarize_label", "flow_id not_benign:i portscan:i dos:i", """SELECT flow_id, CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END AS not_benign,
  CASE WHEN label = 'PortScan' THEN 1 ELSE 0 END AS portscan, CASE WHEN label LIKE 'DoS%' THEN 1 ELSE 0 END AS dos FROM flows""", "flows")
def binarize_label(spark, sf):
    return C.flows(spark, sf).select("flow_id", *[L.binarize_label("label", r).alias(r)
                                                  for r in ("not_benign", "portscan", "dos")])


@query("match_label", "flow_id hulk:i scan:i", """SELECT flow_id, CASE WHEN label = 'DoS Hulk' THEN 1 ELSE 0 END AS hulk,
  CASE WHEN label = 'PortScan' THEN 1 ELSE 0 END AS scan FROM flows""", "flows")
def match_label(spark, sf):
    return C.flows(spark, sf).select("flow_id", L.match_label("label", "dos  HULK").alias("hulk"),
                                     L.match_label("label", "Port Scan (nmap)").alias("scan"))


@query("day_from_name", "name day", """SELECT name, CASE WHEN scenario THEN 'friday' WHEN d IN ('Monday','Tuesday','Thursday','Friday') THEN lower(d)
  ELSE 'wednesday' END AS day FROM (SELECT day AS d, pkt_num % 5 = 0 AS scenario,
  concat(day, CASE WHEN pkt_num % 5 = 0 THEN '-scenario_bot.pcap' ELSE '-WorkingHours.pcap_ISCX.csv' END) AS name FROM flows)""", "flows")
def day_from_name(spark, sf):
    f = C.flows(spark, sf)
    name = F.concat("day", F.when(F.col("pkt_num") % 5 == 0, "-scenario_bot.pcap").otherwise("-WorkingHours.pcap_ISCX.csv"))
    return f.select(name.alias("name"), L.day_from_name(name).alias("day"))


PARTIAL = "dur spkts dpkts sbytes dbytes smeansz dmeansz swin dwin sintpkt dintpkt".split()


@query("partial_flow", "row_key max_pkt:i " + " ".join(f"{c}:d" for c in PARTIAL), f""", {C.FEATURES_SQL},
base AS (SELECT *, unnest([2,4,6,8,10,14,20]) AS max_pkt FROM features),
share AS (SELECT *, greatest(1.0, round_even(spkts * least(1.0, max_pkt / greatest(f_spkts + f_dpkts, 1.0)), 0)) AS fwd,
  least(1.0, max_pkt / greatest(f_spkts + f_dpkts, 1.0)) AS part FROM base),
both_ways AS (SELECT *, greatest(0.0, max_pkt - fwd) AS bwd FROM share)
--result
SELECT row_key, max_pkt, CASE WHEN max_pkt <= 2 THEN 0 ELSE f_dur * part END AS dur, fwd AS spkts, bwd AS dpkts,
  f_sbytes * (fwd / greatest(f_spkts, 1.0)) AS sbytes,
  CASE WHEN f_dpkts > 0 THEN f_dbytes * (bwd / greatest(f_dpkts, 1.0)) ELSE 0 END AS dbytes, f_smeansz AS smeansz,
  f_dmeansz AS dmeansz, f_swin AS swin, f_dwin AS dwin, CASE WHEN max_pkt <= 2 THEN 0 ELSE f_sintpkt END AS sintpkt,
  CASE WHEN max_pkt > 2 AND bwd >= 2 THEN f_dintpkt ELSE 0 END AS dintpkt FROM both_ways""", "flows")
def partial_flow(spark, sf):
    f = C.feature_frame(spark, sf, "row_key").withColumn("total_pkts", F.col("spkts") + F.col("dpkts"))
    f = f.withColumn("max_pkt", F.explode(F.array(*[F.lit(n) for n in PACKET_SWEEP])))
    return f.select("row_key", "max_pkt", *[c.alias(n) for n, c in X.partial_flow("max_pkt").items()])


@query("suppress_port", "flow_id dst_port:i", "SELECT flow_id, dst_port FROM flows WHERE alerted AND dst_port NOT IN (53,137,389)", "flows")
def suppress_port(spark, sf):
    return L.suppress_port(C.flows(spark, sf).filter("alerted"), (53, 137, 389))


@query("classify_dos", "row_key kind", f""", {C.FEATURES_SQL},
gate AS (SELECT src_ip, count(*) AS n FROM flows GROUP BY src_ip)
--result
SELECT row_key, CASE WHEN g.n > 700 THEN 'volumetric' WHEN f_spkts + f_dpkts > 6 AND f_sintpkt < 0.001 AND f_dur < 1.0 THEN 'volumetric'
  WHEN f_dur * 100 > 5.0 AND f_spkts + f_dpkts <= 6 AND f_sintpkt > 0.5 THEN 'slow_rate' ELSE 'generic' END AS kind
  FROM features JOIN gate g USING (src_ip)""", "flows")
def classify_dos(spark, sf):
    f = C.feature_frame(spark, sf, "row_key", "src_ip").withColumn(
        "dur", F.when(F.col("spkts") + F.col("dpkts") <= 6, F.col("dur") * 100).otherwise(F.col("dur")))
    gate = C.flows(spark, sf).groupBy("src_ip").agg((F.count("*") > 700).alias("high"))
    return f.join(gate, "src_ip").select("row_key", X.classify_dos(high_syn_rate="high").alias("kind"))


@query("enrich_alert", "pkt_num:i gid:i engine msg mitre_technique mitre_tactic", """SELECT pkt_num, gid,
  CASE gid WHEN 301 THEN 'xgboost' WHEN 302 THEN 'portscan' WHEN 303 THEN 'dos_agg' WHEN 304 THEN 'ddos' WHEN 306 THEN 'bot'
    WHEN 307 THEN 'bruteforce' ELSE 'community' END AS engine,
  CASE gid WHEN 301 THEN 'DoS detected (per-flow)' WHEN 302 THEN 'Port scan detected' WHEN 303 THEN 'DoS flood detected'
    WHEN 304 THEN 'DDoS HTTP flood detected' WHEN 306 THEN 'Bot client detected' WHEN 307 THEN 'Brute force detected'
    ELSE concat('Community rule ', gid, ':', sid) END AS msg,
  CASE gid WHEN 301 THEN 'T1499' WHEN 302 THEN 'T1046' WHEN 303 THEN 'T1498' WHEN 304 THEN 'T1498' WHEN 306 THEN 'T1071'
    WHEN 307 THEN 'T1110' WHEN 1 THEN 'T1190' END AS mitre_technique,
  CASE gid WHEN 301 THEN 'TA0040' WHEN 302 THEN 'TA0043' WHEN 303 THEN 'TA0040' WHEN 304 THEN 'TA0040' WHEN 306 THEN 'TA0011'
    WHEN 307 THEN 'TA0006' WHEN 1 THEN 'TA0001' END AS mitre_tactic FROM alerts""", "alerts")
def enrich_alert(spark, sf):
    return C.enriched(spark, sf)


@query("encode_with_unknown", "row_key label_code:i flow_code:i", """, tl AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM flows WHERE proto = 6)),
ti AS (SELECT flow_id, row_number() OVER (ORDER BY flow_id) - 1 AS code FROM (SELECT DISTINCT flow_id FROM flows WHERE proto = 6))
--result
SELECT row_key, coalesce(tl.code, (SELECT count(*) FROM tl)) AS label_code, coalesce(ti.code, (SELECT count(*) FROM ti)) AS flow_code
FROM flows LEFT JOIN tl USING (label) LEFT JOIN ti USING (flow_id)""", "flows")
def encode_with_unknown(spark, sf):
    """Codes learned on the TCP flows; labels and flow ids first seen elsewhere share the unknown code."""
    from tidewatch.models.encode import encode_with_unknown as encode
    f = C.flows(spark, sf)
    tcp = f.filter("proto = 6")
    return encode(tcp, encode(tcp, f, "label", "label_code"), "flow_id", "flow_code")


NARRATE_ITEMS = ("spkts", "dpkts", "ack_cnt", "score")


@query("narrate", "row_key text", """, item AS (
  SELECT row_key, 'spkts' AS feature, CAST(spkts AS DOUBLE) AS raw, spkts - 25.5 AS c FROM flows
  UNION ALL SELECT row_key, 'dpkts', dpkts, (dpkts - 3.1) * 8 FROM flows
  UNION ALL SELECT row_key, 'ack_cnt', ack_cnt, (ack_cnt - 4.2) * 7 FROM flows
  UNION ALL SELECT row_key, 'score', score, (score - 0.53) * 50 FROM flows),
ranked AS (SELECT DISTINCT ON (row_key, feature) row_key, feature, raw, c,
  CASE WHEN raw = floor(raw) THEN CAST(CAST(raw AS BIGINT) AS VARCHAR) ELSE CAST(raw AS VARCHAR) END AS shown FROM item),
top AS (SELECT *, row_number() OVER (PARTITION BY row_key, c > 0 ORDER BY abs(c) DESC, feature) AS side_rank,
  row_number() OVER (PARTITION BY row_key ORDER BY abs(c) DESC, feature) AS all_rank,
  max(c) OVER (PARTITION BY row_key) > 0 AS any_up, min(c) OVER (PARTITION BY row_key) <= 0 AS any_down FROM ranked)
--result
SELECT row_key, concat('Why flagged: ', string_agg(concat(feature, '=', shown), ', ' ORDER BY abs(c) DESC, feature)
    FILTER (WHERE (any_up AND c > 0 AND side_rank <= 3) OR (NOT any_up AND all_rank <= 2)),
  coalesce(max(CASE WHEN any_up AND any_down AND c <= 0 AND side_rank = 1 THEN concat('; low ', feature, ' (', shown, ') reduces confidence') END), '')) AS text
  FROM top GROUP BY row_key""", "flows")
def narrate(spark, sf):
    f = C.flows(spark, sf).dropDuplicates(["row_key"])
    parts = {"spkts": F.col("spkts") - 25.5, "dpkts": (F.col("dpkts") - 3.1) * 8,
             "ack_cnt": (F.col("ack_cnt") - 4.2) * 7, "score": (F.col("score") - 0.53) * 50}
    items = F.array(*[F.struct((-F.abs(c)).alias("size"), F.lit(n).alias("feature"),
                               F.col(n).cast("double").alias("raw_value"), c.cast("double").alias("contribution"))
                      for n, c in parts.items()])
    return f.select("row_key", L.narrate(F.array_sort(items)).alias("text"))
