"""Parsers for alert text and detector logs. Each takes a DataFrame with a ``value`` text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions.addresses import is_valid_ip, proto_num


# Fixed line layout: nine comma-separated fields; host:port in the 7th and 8th, detector:rule in the 9th.
_HOST = r"[^:,\s][^:,]*"
_INT = r"\s*[+-]?[0-9]{1,9}\s*"
ALERT_LINE = rf"^([^,]*,){{6}}\s*{_HOST}:{_INT},\s*{_HOST}:{_INT},{_INT}:{_INT}(:[^,]*)?(,|$)"


def _lines(lines: DataFrame) -> DataFrame:
    text = F.trim("value")
    return lines.filter((text != "") & ~F.startswith(text, F.lit("#")))


def _part(i: int) -> Column:
    return F.trim(F.get("p", F.lit(i)))


def parse_alert_lines(lines: DataFrame, year: int = 2000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw alert text → typed rows; lines with fewer than 9 fields, IPv6 or bad addresses or ids are dropped.

    Unknown protocols become TCP. ``ts`` is the packet time of field 0 (which has no year) and ``ingested_at`` the
    time of the run. One pattern decides on a line before anything is split.
    """
    ok = _lines(lines).filter(F.col("value").rlike(ALERT_LINE)).withColumn("p", F.split("value", ","))
    proto = F.upper(_part(2))

    def host(i: int) -> Column:
        return F.substring_index(_part(i), ":", 1)

    def number(col: Column) -> Column:
        return F.trim(col).cast("int")

    out = ok.select(
        *keep, _part(0).alias("ts_text"), _part(1).try_cast("bigint").alias("pkt_num"),
        F.when(proto.isin("TCP", "UDP", "ICMP"), proto).otherwise("TCP").alias("proto"),
        host(6).alias("src_ip"), number(F.substring_index(_part(6), ":", -1)).alias("src_port"),
        host(7).alias("dst_ip"), number(F.substring_index(_part(7), ":", -1)).alias("dst_port"),
        number(F.substring_index(_part(8), ":", 1)).alias("gid"),
        number(F.get(F.split(_part(8), ":"), F.lit(1))).alias("sid"))
    ts = F.try_to_timestamp(F.concat(F.lit(f"{year}/"), F.col("ts_text")), F.lit("yyyy/MM/dd-HH:mm:ss.SSSSSS"))
    return out.withColumn("ts", ts).withColumns(
        {"ts_us": F.unix_micros("ts"), "ingested_at": F.current_timestamp()})


DROP_REASONS = ("few_fields", "other_detector", "bad_address_or_id", "invalid_ip", "port_zero", "unknown_protocol")


def alert_drop_report(lines: DataFrame, gids: tuple[int, ...] | None = None) -> DataFrame:
    """Counts of total and filtered lines under the strict rules for flow matching, one reason per line."""
    rows = _lines(lines).select("value", F.split("value", ",").alias("p"))
    ends = [F.substring_index(_part(i), ":", 1) for i in (6, 7)]
    zero = r"^([^,]*,){6}([^,]*:\s*[+-]?0+\s*,|[^,]*,[^,]*:\s*[+-]?0+\s*,)"
    wrong_gid = F.lit(False)
    if gids is not None:
        wrong_gid = ~F.coalesce(F.substring_index(_part(8), ":", 1).try_cast("int").isin(list(gids)), F.lit(False))
    reason = (F.when(F.size("p") < 9, "few_fields").when(wrong_gid, "other_detector")
              .when(~F.col("value").rlike(ALERT_LINE), "bad_address_or_id")
              .when(~is_valid_ip(ends[0]) | ~is_valid_ip(ends[1]), "invalid_ip")
              .when(F.col("value").rlike(zero), "port_zero")
              .when(proto_num(_part(2)) == 0, "unknown_protocol"))
    per = rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    r, n = F.col("reason"), F.col("n")
    return per.agg(F.sum(n).alias("total"), F.coalesce(F.sum(F.when(r.isNotNull(), n)), F.lit(0)).alias("filtered"),
                   *[F.coalesce(F.sum(F.when(r == k, n)), F.lit(0)).alias(k) for k in DROP_REASONS])


def read_alerts(spark: SparkSession, path, **kw) -> DataFrame:
    return parse_alert_lines(spark.read.text(path), **kw)


# Fixed: keys of the feature log line in feature order.
FEATURE_LOG_KEYS = {"dur": "dur", "sp": "spkts", "dp": "dpkts", "sb": "sbytes", "db": "dbytes", "smsz": "smeansz",
                    "dmsz": "dmeansz", "si": "sintpkt", "di": "dintpkt", "fwd": "fwd_pkt_mean", "bwd": "bwd_pkt_mean",
                    "fin": "fin_cnt", "ack": "ack_cnt", "syn": "syn_cnt", "biat": "bwd_iat"}


def parse_feature_log(lines: DataFrame, tag: str = "[dos_inspector]", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key=value`` log lines → 15 features and score; lines without the tag, an id or any feature are dropped."""
    def num(key: str) -> Column:
        # the first occurrence anywhere in the line, up to the next blank
        return F.regexp_extract("value", rf"{key}=([^ ]*)", 1).try_cast("double")
    rows = lines.filter(F.col("value").contains(tag) & F.col("value").contains("sid="))
    out = rows.select(*keep, *[num(k).alias(n) for k, n in FEATURE_LOG_KEYS.items()], num("score").alias("score"))
    return out.na.drop(subset=list(FEATURE_LOG_KEYS.values()))


# Fixed log patterns: address, then named groups.
SCORE_PATTERNS = {
    "portscan": r"\[portscan\] ([0-9.]+) syn=(\d+)/(\d+) fnx=(\d+) score=([0-9.]+)",
    "dos_agg": r"\[dos_agg\] ([0-9.]+) syns=(\d+) .*? ?score=([0-9.]+)",
    "bot": r"\[botcl\] ([0-9.]+) syns=(\d+).*score=([0-9.]+)",
    "bruteforce": r"\[bfc\] ([0-9.]+) syns=(\d+).*score=([0-9.]+)",
    "alert": r"ALERT: ([0-9.]+)(?::\d+)? score=([0-9.]+)",
}
SCORE_FIELDS = {
    "portscan": ("src_ip", "syn_count", "dst_ports", "fnx_count", "score"),
    "dos_agg": ("src_ip", "syn_count", "score"), "bot": ("src_ip", "syn_count", "score"),
    "bruteforce": ("src_ip", "syn_count", "score"), "alert": ("src_ip", "score"),
}


def parse_score_log(lines: DataFrame, pattern: str = "portscan", keep: tuple[str, ...] = ()) -> DataFrame:
    """Detector log lines → (address, counts, score); lines that do not match are dropped."""
    regex, fields = SCORE_PATTERNS[pattern], SCORE_FIELDS[pattern]
    rows = lines.filter(F.col("value").rlike(regex))
    kind = {"src_ip": "string", "score": "double"}
    return rows.select(*keep, *[F.regexp_extract("value", regex, i).try_cast(kind.get(n, "bigint")).alias(n)
                                for i, n in enumerate(fields, start=1)])


def score_log_summary(scores: DataFrame, threshold: float) -> DataFrame:
    """Windows and alerted windows per address, with their SYN counts and best score."""
    hit = F.col("score") >= threshold
    return scores.groupBy("src_ip").agg(
        F.count("*").alias("windows"), F.count_if(hit).alias("alert_windows"), F.sum("syn_count").alias("syns"),
        F.coalesce(F.sum(F.when(hit, F.col("syn_count"))), F.lit(0)).alias("alert_syns"),
        F.max("score").alias("best_score"))


def tail_alerts(spark: SparkSession, path: str, max_files: int = 100, year: int = 2000) -> DataFrame:
    """Follow a landing folder of alert files; only files not yet seen are parsed (offsets live in the checkpoint)."""
    return parse_alert_lines(spark.readStream.option("maxFilesPerTrigger", max_files).text(path), year)
