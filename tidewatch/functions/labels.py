"""Label rules, alert dimensions, suppression predicates and plain-text explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.session import literal_table


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def binarize_label(label="label", rule: str = "not_benign") -> Column:
    """Text label → 0/1. Rules: not_benign, portscan, dos (``DoS*`` or Heartbleed)."""
    t = F.trim(_c(label))
    hit = {
        "not_benign": t != "BENIGN",
        "portscan": t == "PortScan",
        "dos": t.startswith("DoS") | (t == "Heartbleed"),
    }[rule]
    return F.coalesce(hit, F.lit(False)).cast("int")


def squash(text) -> Column:
    return F.replace(F.lower(_c(text)), F.lit(" "), F.lit(""))


def match_label(text, wanted: str) -> Column:
    """Either text contains the other, ignoring case and blanks."""
    a, b = squash(text), wanted.lower().replace(" ", "")
    return F.coalesce(a.contains(b) | F.lit(b).contains(a), F.lit(False))


# Fixed: scenario tags and week days looked for in a capture name, in this order.
SCENARIO_DAYS = {
    "scenario_dos": "wednesday", "scenario_portscan": "friday", "scenario_bruteforce": "tuesday",
    "scenario_bot": "friday", "scenario_ddos": "friday",
}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday")


def day_from_name(name) -> Column:
    """File name → day; Wednesday when nothing matches."""
    low = F.lower(_c(name))
    rules = list(SCENARIO_DAYS.items()) + [(d, d) for d in WEEKDAYS]
    out = F.when(low.contains(rules[0][0]), rules[0][1])
    for tag, day in rules[1:]:
        out = out.when(low.contains(tag), day)
    return out.otherwise("wednesday")


# Fixed: detector id → engine, message, technique, tactic, evaluation level.
ALERT_DIMENSION = [
    (1, "community", None, "T1190", "TA0001", "flow"),
    (301, "xgboost", "DoS detected (per-flow)", "T1499", "TA0040", "flow"),
    (302, "portscan", "Port scan detected", "T1046", "TA0043", "ip"),
    (303, "dos_agg", "DoS flood detected", "T1498", "TA0040", "ip"),
    (304, "ddos", "DDoS HTTP flood detected", "T1498", "TA0040", "ip"),
    (306, "bot", "Bot client detected", "T1071", "TA0011", "ip"),
    (307, "bruteforce", "Brute force detected", "T1110", "TA0006", "ip"),
]
WINDOW_ENGINES = ("dos_agg", "portscan", "bruteforce", "bot")


def alert_dimension(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, ALERT_DIMENSION, "gid int, engine string, dim_msg string, mitre_technique string, mitre_tactic string, "
                                "metric_level string")


def enrich_alert(alerts: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Add engine, message, technique and tactic by detector id; unknown ids count as community rules."""
    dim = alert_dimension(alerts.sparkSession) if dimension is None else dimension
    message = F.coalesce("dim_msg", F.concat_ws(":", F.concat(F.lit("Community rule "), F.col("gid").cast("string")),
                                                F.col("sid").cast("string")))
    return (alerts.join(dim, "gid", "left")
            .withColumn("msg", message)
            .withColumn("engine", F.coalesce("engine", F.lit("community")))
            .withColumn("metric_level", F.coalesce("metric_level", F.lit("flow")))
            .drop("dim_msg"))


def suppress_port(df: DataFrame, ports: Sequence[int], column: str = "dst_port") -> DataFrame:
    return df.filter(~F.col(column).isin(list(ports)))


def suppress_single_client(df: DataFrame, min_ports: int = 10) -> DataFrame:
    """One source with few source ports is an ordinary client, not a distributed attack."""
    return df.filter(~((F.col("src_ips") == 1) & (F.col("src_ports") < min_ports)))


def auth_suppress_reason(score="score", threshold: float = 0.95, listed=None) -> Column:
    """allow-list first, then clean connections that moved data."""
    alert = _c(score) > threshold
    listed = F.lit(False) if listed is None else _c(listed)
    clean = (F.col("handshake_ratio") > 0.8) & (F.col("rst_per_handshake") < 0.3) & (F.col("bytes_per_syn") > 1000)
    return F.when(alert & listed, "whitelist").when(alert & clean, "clean_conn")


def client_suppress_reason(score="score", threshold: float = 0.85, listed=None) -> Column:
    """Ordered rules of the client detector; the reset rule can replace an allow-list reason, as it does there."""
    s = _c(score)
    alert = s > threshold
    listed = F.lit(False) if listed is None else _c(listed)
    enough = F.col("syn_count") >= 3
    later = (F.when((F.col("rst_rate") > 5.0) & enough, "high_rst")
             .when((F.col("data_density") == 0) & enough & (s < 0.3), "no_incoming")
             .when((F.col("internal_ratio") > 0.6) & (s < 0.3) & enough, "high_int_ratio")
             .when((F.col("handshake_ratio") < 0.1) & (s < 0.2) & enough, "no_handshake")
             .when((F.col("handshake_ratio") == 0) & (F.col("bytes_per_syn") * F.col("syn_count") < 10), "no_data"))
    return F.when(alert, F.coalesce(later, F.when(listed, "whitelist")))


def short_number(value) -> Column:
    """Whole numbers without decimals, others with three significant digits."""
    v = _c(value).cast("double")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e6)
    mag = F.when(v != 0, F.floor(F.log10(F.abs(v)))).otherwise(F.lit(0))
    scaled = F.round(v / F.pow(F.lit(10.0), mag - 2)) * F.pow(F.lit(10.0), mag - 2)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", scaled), r"0+$", ""), r"\.$", "")
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(text)


def narrate(items, max_attack: int = 3) -> Column:
    """``array<struct(feature, raw_value, contribution)>`` sorted by size → 'Why flagged: …' text."""
    items = _c(items)
    up = F.filter(items, lambda c: c["contribution"] > 0)
    down = F.filter(items, lambda c: c["contribution"] <= 0)
    shown = F.when(F.size(up) > 0, F.slice(up, 1, max_attack)).otherwise(F.slice(items, 1, 2))
    parts = F.transform(shown, lambda c: F.concat(c["feature"], F.lit("="), short_number(c["raw_value"])))
    low = F.get(down, F.lit(0))
    tail = F.when((F.size(up) > 0) & (F.size(down) > 0),
                  F.concat(F.lit("; low "), low["feature"], F.lit(" ("), short_number(low["raw_value"]),
                           F.lit(") reduces confidence"))).otherwise(F.lit(""))
    return F.concat(F.lit("Why flagged: "), F.concat_ws(", ", parts), tail)
