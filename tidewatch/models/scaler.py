"""Robust scaling parameters as a small table: feature, idx, log1p, median, iqr."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions.features import log1p_cols, robust_scale
from tidewatch.operators.quantiles import percentile_table
from tidewatch.session import literal_table

SCHEMA = "feature string, idx int, log1p boolean, median double, iqr double"


def fit_robust_scaler(df: DataFrame, features: Sequence[str], log1p: Sequence[str] = (), benign: Column | None = None,
                      unit_iqr: bool = False) -> DataFrame:
    """Exact median and interquartile range per feature, after log1p where named.

    ``benign`` restricts the rows, ``unit_iqr`` turns a zero range into 1.
    """
    rows = df if benign is None else df.filter(benign)
    rows = log1p_cols(rows.select(*features), log1p)
    q = percentile_table(rows, [], features, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    if unit_iqr:
        iqr = F.when(iqr == 0, 1.0).otherwise(iqr)
    order = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")) - 1
    return q.select("feature", order.cast("int").alias("idx"), F.col("feature").isin(list(log1p)).alias("log1p"),
                    "median", iqr.alias("iqr"))


def scaler_params(scaler: DataFrame) -> tuple[dict[str, tuple[float, float]], list[str]]:
    """One row per feature, so reading it on the driver is bounded by the number of columns."""
    rows = scaler.orderBy("idx").collect()
    return {r["feature"]: (r["median"], r["iqr"]) for r in rows}, [r["feature"] for r in rows if r["log1p"]]


def apply_scaler(df: DataFrame, scaler: DataFrame, zero_iqr: str = "zero") -> DataFrame:
    params, logged = scaler_params(scaler)
    return robust_scale(log1p_cols(df, logged), params, zero_iqr)


def inverse_scale(df: DataFrame, scaler: DataFrame, undo_log: bool = False) -> DataFrame:
    """Scaled columns back to the values the scaler was fitted on (log values unless ``undo_log``)."""
    params, logged = scaler_params(scaler)
    def back(name: str) -> Column:
        median, iqr = params[name]
        v = F.col(name) * F.lit(iqr or 1.0) + F.lit(median)
        return F.expm1(v) if undo_log and name in logged else v
    return df.withColumns({c: back(c) for c in params})


def merge_and_refit(old_scaled: DataFrame, old_scaler: DataFrame, new_raw: DataFrame, features: Sequence[str]) -> DataFrame:
    """Undo an old scaling, add new rows in the same log space, fit again."""
    _, logged = scaler_params(old_scaler)
    both = inverse_scale(old_scaled, old_scaler).select(*features).unionByName(log1p_cols(new_raw.select(*features), logged))
    return fit_robust_scaler(both, features)


def read_scaler_json(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Scaler sidecar ``{median[], iqr[], log1p_indices?, feature_names?}`` → scaler table."""
    schema = "median array<double>, iqr array<double>, log1p_indices array<int>, feature_names array<string>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    given = F.array(*[F.lit(n) for n in names]) if names else F.lit(None).cast("array<string>")
    rows = raw.select("*", F.posexplode(F.arrays_zip("median", "iqr")).alias("idx", "z"))
    return rows.select(
        F.coalesce(F.get("feature_names", F.col("idx")), F.get(given, F.col("idx")),
                   F.concat(F.lit("f"), F.col("idx").cast("string"))).alias("feature"), "idx",
        F.coalesce(F.array_contains("log1p_indices", F.col("idx")), F.lit(False)).alias("log1p"),
        F.col("z.median").alias("median"), F.col("z.iqr").alias("iqr"))


def fixed_scaler(spark: SparkSession, rows: Sequence[tuple[str, bool, float, float]]) -> DataFrame:
    return literal_table(spark, [(f, i, lg, float(m), float(q)) for i, (f, lg, m, q) in enumerate(rows)], SCHEMA)


# Fixed: built-in scan scaler used when no sidecar is given.
SCAN_MEDIAN = (2.0794415417, 1.0986122887, 1.0986122887, 0.5940327422, 1.7917594692, 0.2876820725, 0.1103480572)
SCAN_IQR = (2.5649493575, 0.6931471806, 1.0986122887, 0.8632909694, 7.7916225259, 0.3053816496, 0.5663954749)
