"""Traffic tables derived from the test parquet: packets from ``events``, flows from ``lineitem``.

``SQL`` holds the same definitions for the SQL cross-check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions.addresses import flow_id
from tidewatch.session import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_from_events(e: DataFrame) -> DataFrame:
    k = F.col("k")
    e = e.withColumn("k", F.regexp_replace("props", "[^0-9]", "").cast("int"))
    port = F.lit(1000) + k
    for digit, number in enumerate((21, 22, 53, 80, 137, 389, 443, 445)):
        port = F.when(k % 10 == digit, number).otherwise(port)
    flags = (F.when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 18)
             .when(F.col("event_type") == "error", 4).when(F.col("event_type") == "purchase", 24)
             .when(k % 4 == 0, 0).when(k % 4 == 1, 41).otherwise(17))
    e = e.select(
        "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "k",
        F.concat(F.lit("192.168.10."), (F.col("user_id") % 250).cast("string")).alias("client_ip"),
        F.concat(F.when(k % 3 == 0, "10.0.0.").otherwise("23.0.0."), (k % 16).cast("string")).alias("server_ip"),
        port.cast("int").alias("server_port"),
        (F.lit(40000) + F.col("event_id") % 20000).cast("int").alias("client_port"),
        F.when(k % 10 == 9, 17).otherwise(6).alias("proto"), flags.alias("flags"),
        F.col("event_type").isin("click", "error", "signup").alias("from_client"),
        F.floor("value").cast("int").alias("payload_len"), (F.lit(1024) + 10 * k).cast("int").alias("tcp_win"))
    fc = F.col("from_client")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "ts_us",
        F.when(fc, F.col("client_ip")).otherwise(F.col("server_ip")).alias("src_ip"),
        F.when(fc, F.col("server_ip")).otherwise(F.col("client_ip")).alias("dst_ip"),
        F.when(fc, F.col("client_port")).otherwise(F.col("server_port")).alias("src_port"),
        F.when(fc, F.col("server_port")).otherwise(F.col("client_port")).alias("dst_port"),
        "proto", "flags", "payload_len", "tcp_win", "from_client",
        F.concat_ws("-", "client_ip", "server_ip", F.col("server_port").cast("string"),
                    F.col("proto").cast("string")).alias("flow_key"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    dst_port = F.lit(389)
    for number, port in enumerate((80, 443, 22, 21, 53, 137), start=1):
        dst_port = F.when(F.col("l_linenumber") == number, port).otherwise(dst_port)
    label = (F.when((F.col("l_returnflag") == "N") | (F.col("l_suppkey") % 5 != 0), "BENIGN")
             .when(F.col("l_returnflag") == "R", "DoS Hulk").otherwise("PortScan"))
    li = li.select(
        "*",
        F.concat(F.lit("172.16.0."), (F.col("l_suppkey") % 256).cast("string")).alias("src_ip"),
        F.concat(F.lit("192.168.10."), (F.col("l_partkey") % 16).cast("string")).alias("dst_ip"),
        (F.lit(1024) + F.col("l_orderkey") % 8).cast("int").alias("src_port"),
        dst_port.cast("int").alias("dst_port"),
        F.when(F.col("l_linestatus") == "O", 6).otherwise(17).alias("proto"),
        F.col("l_quantity").cast("int").alias("spkts"),
        (F.col("l_orderkey") % 7).cast("int").alias("dpkts"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("dbytes"))
    day = F.col("l_shipdate").cast("timestamp")
    return li.select(
        flow_id("src_ip", "dst_ip", "src_port", "dst_port", "proto").alias("flow_id"),
        "src_ip", "dst_ip", "src_port", "dst_port", "proto", label.alias("label"), "spkts", "dpkts",
        F.col("l_extendedprice").alias("sbytes"), "dbytes",
        (F.col("l_quantity") * 1000 * F.col("l_linenumber")).alias("dur"),
        F.col("l_extendedprice").alias("fwd_iat"), (F.col("l_extendedprice") * F.col("l_tax")).alias("bwd_iat"),
        (F.col("l_partkey") * 37 % 30000).cast("int").alias("swin"),
        (F.col("l_suppkey") * 53 % 30000).cast("int").alias("dwin"),
        (F.col("l_extendedprice") / F.col("spkts")).alias("smeansz"),
        F.when(F.col("dpkts") > 0, F.col("dbytes") / F.col("dpkts")).otherwise(0.0).alias("dmeansz"),
        (F.col("l_orderkey") % 3).cast("int").alias("syn_cnt"), (F.col("l_partkey") % 2).cast("int").alias("fin_cnt"),
        (F.col("l_suppkey") % 2).cast("int").alias("rst_cnt"), F.col("l_linenumber").cast("int").alias("ack_cnt"),
        (F.col("l_orderkey") % 5).cast("int").alias("psh_cnt"),
        F.round(F.col("l_discount") * 10, 2).alias("score"), day.alias("ts"),
        F.unix_micros(day).alias("ts_us"), F.date_format(day, "EEEE").alias("day"),
        ((F.col("l_discount") * 10 > 0.8) & (F.col("l_suppkey") % 3 != 0)).alias("alerted"),
        F.concat_ws("|", *[F.col(c).cast("bigint").cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")],
                    F.unix_micros(day).cast("string")).alias("row_key"),
        F.col("l_orderkey").alias("pkt_num"), F.col("l_linenumber").alias("line"))


_ALERT_FILES: dict[tuple[str, str], str] = {}


def alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert text of the alerted flows as text files, written once per application and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ALERT_FILES:
        path = new_folder(spark, "alert-lines")
        render_alert_lines(spark, sf_dir).write.text(path)
        _ALERT_FILES[key] = path
    return spark.read.text(_ALERT_FILES[key])


def render_alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert text, with some lines a parser must reject."""
    f = flows(spark, sf_dir).filter("alerted")
    gid = F.lit(1)
    for digit, number in enumerate((301, 302, 303, 304, 306, 307)):
        gid = F.when(F.col("line") % 7 == digit, number).otherwise(gid)
    odd = F.col("pkt_num") % 97
    src = F.when(odd == 2, "fe80::1").when(odd == 5, "224.0.0.5").otherwise(F.col("src_ip"))
    sport = F.when(odd == 4, 0).otherwise(F.col("src_port"))
    head = F.concat_ws(", ", F.date_format("ts", "MM/dd-HH:mm:ss.SSSSSS"), F.col("pkt_num").cast("string"),
                       F.when(F.col("proto") == 6, "TCP").otherwise("UDP"), F.lit("raw"),
                       F.col("spkts").cast("string"), F.lit("C2S"),
                       F.concat_ws(":", src, sport.cast("string")),
                       F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string")))
    full = F.concat_ws(", ", head, F.concat(gid.cast("string"), F.lit(":1:1")), F.lit("allow"))
    return f.select(F.when(odd == 1, head).when(odd == 3, F.concat(F.lit("# "), full)).otherwise(full).alias("value"))


SQL = {
    "packets": """packets AS (
  SELECT event_id, ts, ts_us,
    CASE WHEN from_client THEN client_ip ELSE server_ip END AS src_ip,
    CASE WHEN from_client THEN server_ip ELSE client_ip END AS dst_ip,
    CASE WHEN from_client THEN client_port ELSE server_port END AS src_port,
    CASE WHEN from_client THEN server_port ELSE client_port END AS dst_port,
    proto, flags, payload_len, tcp_win, from_client,
    concat(client_ip,'-',server_ip,'-',server_port,'-',proto) AS flow_key
  FROM (SELECT event_id, ts, epoch_us(ts) AS ts_us,
    concat('192.168.10.', user_id % 250) AS client_ip,
    concat(CASE WHEN k % 3 = 0 THEN '10.0.0.' ELSE '23.0.0.' END, k % 16) AS server_ip,
    CASE k % 10 WHEN 0 THEN 21 WHEN 1 THEN 22 WHEN 2 THEN 53 WHEN 3 THEN 80 WHEN 4 THEN 137 WHEN 5 THEN 389
      WHEN 6 THEN 443 WHEN 7 THEN 445 ELSE 1000 + k END AS server_port,
    CAST(40000 + event_id % 20000 AS INTEGER) AS client_port,
    CASE WHEN k % 10 = 9 THEN 17 ELSE 6 END AS proto,
    CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 18 WHEN 'error' THEN 4 WHEN 'purchase' THEN 24
      ELSE CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 41 ELSE 17 END END AS flags,
    event_type IN ('click','error','signup') AS from_client,
    CAST(floor(value) AS INTEGER) AS payload_len, 1024 + 10 * k AS tcp_win
    FROM (SELECT *, CAST(regexp_replace(props,'[^0-9]','','g') AS INTEGER) AS k FROM events)))""",
    "flows": """flows AS (
  SELECT concat(src_ip,'-',dst_ip,'-',src_port,'-',dst_port,'-',proto) AS flow_id, * FROM (
  SELECT concat('172.16.0.', l_suppkey % 256) AS src_ip, concat('192.168.10.', l_partkey % 16) AS dst_ip,
    CAST(1024 + l_orderkey % 8 AS INTEGER) AS src_port,
    CASE l_linenumber WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 22 WHEN 4 THEN 21 WHEN 5 THEN 53 WHEN 6 THEN 137
      ELSE 389 END AS dst_port,
    CASE WHEN l_linestatus = 'O' THEN 6 ELSE 17 END AS proto,
    CASE WHEN l_returnflag = 'N' OR l_suppkey % 5 <> 0 THEN 'BENIGN' WHEN l_returnflag = 'R' THEN 'DoS Hulk'
      ELSE 'PortScan' END AS label,
    CAST(l_quantity AS INTEGER) AS spkts, CAST(l_orderkey % 7 AS INTEGER) AS dpkts, l_extendedprice AS sbytes,
    l_extendedprice * l_discount AS dbytes, l_quantity * 1000 * l_linenumber AS dur, l_extendedprice AS fwd_iat,
    l_extendedprice * l_tax AS bwd_iat, CAST(l_partkey * 37 % 30000 AS INTEGER) AS swin,
    CAST(l_suppkey * 53 % 30000 AS INTEGER) AS dwin,
    l_extendedprice / CAST(l_quantity AS INTEGER) AS smeansz,
    CASE WHEN l_orderkey % 7 > 0 THEN l_extendedprice * l_discount / (l_orderkey % 7) ELSE 0.0 END AS dmeansz,
    CAST(l_orderkey % 3 AS INTEGER) AS syn_cnt, CAST(l_partkey % 2 AS INTEGER) AS fin_cnt,
    CAST(l_suppkey % 2 AS INTEGER) AS rst_cnt, l_linenumber AS ack_cnt, CAST(l_orderkey % 5 AS INTEGER) AS psh_cnt,
    round(l_discount * 10, 2) AS score, l_shipdate AS ts, epoch_us(l_shipdate) AS ts_us, dayname(l_shipdate) AS day,
    (l_discount * 10 > 0.8 AND l_suppkey % 3 <> 0) AS alerted,
    concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
      epoch_us(l_shipdate)) AS row_key,
    l_orderkey AS pkt_num, l_linenumber AS line FROM lineitem))""",
    "alert_lines": """alert_lines AS (
  SELECT CASE pkt_num % 97 WHEN 1 THEN head WHEN 3 THEN '# ' || line_text ELSE line_text END AS value FROM (
  SELECT pkt_num, head, concat(head, ', ', CASE line % 7 WHEN 0 THEN 301 WHEN 1 THEN 302 WHEN 2 THEN 303
      WHEN 3 THEN 304 WHEN 4 THEN 306 WHEN 5 THEN 307 ELSE 1 END, ':1:1, allow') AS line_text FROM (
  SELECT pkt_num, line, concat_ws(', ', strftime(ts, '%m/%d-%H:%M:%S.%f'), pkt_num,
    CASE WHEN proto = 6 THEN 'TCP' ELSE 'UDP' END, 'raw', spkts, 'C2S',
    concat(CASE pkt_num % 97 WHEN 2 THEN 'fe80::1' WHEN 5 THEN '224.0.0.5' ELSE src_ip END, ':',
           CASE WHEN pkt_num % 97 = 4 THEN 0 ELSE src_port END),
    concat(dst_ip, ':', dst_port)) AS head FROM flows WHERE alerted)))""",
    # typed alerts, written against the text independently of the Spark parser
    "alerts": """alert_fields AS (SELECT string_split(value, ', ') AS p FROM alert_lines WHERE value NOT LIKE '#%'),
alerts AS (SELECT p[1] AS ts_text, CAST(p[2] AS BIGINT) AS pkt_num,
    CASE WHEN p[3] IN ('TCP','UDP','ICMP') THEN p[3] ELSE 'TCP' END AS proto,
    string_split(p[7], ':')[1] AS src_ip, CAST(string_split(p[7], ':')[2] AS INTEGER) AS src_port,
    string_split(p[8], ':')[1] AS dst_ip, CAST(string_split(p[8], ':')[2] AS INTEGER) AS dst_port,
    CAST(string_split(p[9], ':')[1] AS INTEGER) AS gid, CAST(string_split(p[9], ':')[2] AS INTEGER) AS sid
  FROM alert_fields WHERE len(p) >= 9 AND p[7] NOT LIKE '%::%')""",
    "alert_ids": """usable AS (SELECT *, CASE proto WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 ELSE 1 END AS pn FROM alerts
    WHERE src_port <> 0 AND dst_port <> 0 AND src_ip NOT LIKE '224.%' AND src_ip NOT LIKE '239.%'),
alert_ids AS (SELECT DISTINCT gid, unnest([concat(dst_ip,'-',src_ip,'-',dst_port,'-',src_port,'-',pn),
    concat(src_ip,'-',dst_ip,'-',src_port,'-',dst_port,'-',pn)]) AS flow_id FROM usable)""",
    "tagged": """alerted_ids AS (SELECT DISTINCT flow_id FROM alert_ids),
tagged AS (SELECT f.*, CASE WHEN f.label <> 'BENIGN' THEN CASE WHEN a.flow_id IS NOT NULL THEN 'TP' ELSE 'FN' END
    ELSE CASE WHEN a.flow_id IS NOT NULL THEN 'FP' ELSE 'TN' END END AS tag
    FROM flows f LEFT JOIN alerted_ids a ON f.flow_id = a.flow_id)""",
}
_ORDER = ("packets", "flows", "alert_lines", "alerts", "alert_ids", "tagged")
_NEEDS = {"alert_lines": ["flows"], "alerts": ["flows", "alert_lines"],
          "alert_ids": ["flows", "alert_lines", "alerts"],
          "tagged": ["flows", "alert_lines", "alerts", "alert_ids"]}


def sql_with(names: str, body: str) -> str:
    """Prefix ``body`` with the named fixture definitions; ``body`` may start with further ones after 'WITH'."""
    want = set()
    for n in names.split():
        want |= {n, *_NEEDS.get(n, [])}
    ctes = ",\n".join(SQL[n] for n in _ORDER if n in want)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}" if ctes else body
