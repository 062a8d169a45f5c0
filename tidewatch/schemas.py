"""Schemas of the tables and streams the library reads."""

from __future__ import annotations

from pyspark.sql import types as T

PACKET = ("ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, proto int, flags int, "
          "payload_len int, tcp_win int, from_client boolean, flow_key string, event_id bigint, ts_us bigint")

# Fixed: the 49 column names of the headerless label table, in file order.
HEADERLESS_COLUMNS = (
    "srcip sport dstip dsport proto state dur sbytes dbytes sttl dttl sloss dloss service Sload Dload Spkts Dpkts "
    "swin dwin stcpb dtcpb smeansz dmeansz trans_depth res_bdy_len Sjit Djit Stime Ltime Sintpkt Dintpkt tcprtt "
    "synack ackdat is_sm_ips_ports ct_state_ttl ct_flw_http_mthd is_ftp_login ct_ftp_cmd ct_srv_src ct_srv_dst "
    "ct_dst_ltm ct_src_ltm ct_src_dport_ltm ct_dst_sport_ltm ct_dst_src_ltm attack_cat label").split()
HEADERLESS = T.StructType([T.StructField(c, T.StringType()) for c in HEADERLESS_COLUMNS])
HEADERLESS_BASE = ("dur", "Spkts", "Dpkts", "sbytes", "dbytes", "smeansz", "dmeansz", "swin", "dwin", "Sintpkt",
                   "Dintpkt")

NETFLOW = "StartTime string, Proto string, SrcAddr string, Sport string, DstAddr string, Dport string, Label string"
SCORE_STREAM = "engine string, src_ip string, score double, features array<double>"
PACKET_EXPORT = ("src_ip string, dst_ip string, tcp_src string, tcp_dst string, udp_src string, udp_dst string, "
                 "proto string")
ALERT = ("ts_text string, pkt_num bigint, proto string, src_ip string, src_port int, dst_ip string, dst_port int, "
         "gid int, sid int")
DAY_SCORE = "day string, model string, threshold double"

# Fixed: scenario registry document (scenario → engine, level, day, published baselines).
REGISTRY = T.StructType([
    T.StructField("pcap_name", T.StringType()),
    T.StructField("active_engine", T.StringType()),
    T.StructField("metric_level", T.StringType()),
    T.StructField("gt_loader_day", T.StringType()),
    T.StructField("ml", T.StructType([
        T.StructField("alerts", T.LongType()),
        T.StructField("confusion", T.MapType(T.StringType(), T.LongType())),
        T.StructField("accuracy", T.DoubleType()), T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()), T.StructField("f1", T.DoubleType()),
        T.StructField("fpr", T.DoubleType()), T.StructField("avg_score", T.DoubleType()),
        T.StructField("window_recall", T.DoubleType()), T.StructField("syn_coverage", T.DoubleType()),
    ])),
    T.StructField("community", T.StructType([
        T.StructField("alerts_total_day", T.LongType()),
        T.StructField("alerts_on_attackers", T.LongType()),
        T.StructField("fpr", T.DoubleType()),
        T.StructField("confusion", T.MapType(T.StringType(), T.LongType())),
    ])),
    T.StructField("slice_universe", T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType()))),
])
