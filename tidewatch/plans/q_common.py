"""Frames several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch import fixtures
from tidewatch.functions.labels import enrich_alert
from tidewatch.operators.confusion import alert_flow_ids, tag_flows
from tidewatch.sources.logs import parse_alert_lines

WEEK = 604_800
DAY = 86_400


def packets(spark, sf):
    return fixtures.packets(spark, sf)


def flows(spark, sf):
    return fixtures.flows(spark, sf)


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return parse_alert_lines(fixtures.alert_lines(spark, sf))


def enriched(spark, sf):
    return enrich_alert(alerts(spark, sf))


def alert_ids(spark, sf, **kw):
    return alert_flow_ids(alerts(spark, sf), **kw)


def tagged(spark, sf):
    return tag_flows(flows(spark, sf), alert_ids(spark, sf))


def scored(spark, sf):
    """Flows with their score and truth."""
    return flows(spark, sf).withColumn("is_attack", (F.col("label") != "BENIGN").cast("int"))


def feature_frame(spark, sf, *keep):
    """The 11 model features of the flows in model units, with the columns to keep."""
    f = flows(spark, sf)
    return f.select(*keep, (F.col("dur") / 1e6).alias("dur"), F.col("spkts").cast("double").alias("spkts"),
                    F.col("dpkts").cast("double").alias("dpkts"), "sbytes", "dbytes", "smeansz", "dmeansz",
                    F.col("swin").cast("double").alias("swin"), F.col("dwin").cast("double").alias("dwin"),
                    (F.col("fwd_iat") / 1e3).alias("sintpkt"), (F.col("bwd_iat") / 1e3).alias("dintpkt"))


FEATURES_SQL = """features AS (SELECT *, dur / 1e6 AS f_dur, CAST(spkts AS DOUBLE) AS f_spkts,
  CAST(dpkts AS DOUBLE) AS f_dpkts, sbytes AS f_sbytes, dbytes AS f_dbytes, smeansz AS f_smeansz,
  dmeansz AS f_dmeansz, CAST(swin AS DOUBLE) AS f_swin, CAST(dwin AS DOUBLE) AS f_dwin, fwd_iat / 1e3 AS f_sintpkt,
  bwd_iat / 1e3 AS f_dintpkt FROM flows)"""
ELEVEN = ["dur", "spkts", "dpkts", "sbytes", "dbytes", "smeansz", "dmeansz", "swin", "dwin", "sintpkt", "dintpkt"]


def long_sql(source: str, ids: str, cols, prefix: str = "") -> str:
    """UNION ALL long form for the SQL side."""
    lead = f"{ids}, " if ids else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS feature, CAST({prefix}{c} AS DOUBLE) AS value FROM {source}" for c in cols)


RATES_SQL = """CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr"""
RATE_COLS = "accuracy:d precision:d recall:d f1:d fpr:d"
