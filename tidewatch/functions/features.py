"""Feature projections: unit conversion, schema alignment, cleaning and scaling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.config import FLOW_FEATURES_11, FLOW_FEATURES_15, FLOW_FEATURES_17


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def ratio(num, den, otherwise: float = 0.0) -> Column:
    """Division guarded against an empty denominator."""
    return F.when(_c(den) > 0, _c(num).cast("double") / _c(den)).otherwise(F.lit(otherwise))


def first_available(df: DataFrame, names: Sequence[str], default: float = 0.0) -> Column:
    """First of the alias names present in ``df`` as a number; ``default`` when none is or the text is bad."""
    for name in names:
        if name in df.columns:
            return F.coalesce(F.col(f"`{name}`").try_cast("double"), F.lit(float(default)))
    return F.lit(float(default))


def clean_numeric(df: DataFrame, columns: Iterable[str], on_bad: str = "drop") -> DataFrame:
    """Text → double; bad text, NaN and ±infinity become null, then are dropped or set to 0."""
    columns = list(columns)

    def fix(name: str) -> Column:
        v = F.col(name).try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)

    out = df.withColumns({c: fix(c) for c in columns})
    return out.na.drop(subset=columns) if on_bad == "drop" else out.na.fill(0.0, subset=columns)


def to_unified_flow(df: DataFrame, n: int = 11, keep: Sequence[str] = ()) -> DataFrame:
    """Label table A → 11, 15 or 17 model features: µs → s for duration, µs → ms for gaps.

    The wide forms clip negatives to 0 and repeat the packet means and the backward gap under their own names.
    """
    def num(*names):
        return first_available(df, names)

    cols = {
        "dur": num("Flow Duration") / 1e6,
        "spkts": num("Total Fwd Packets"),
        "dpkts": num("Total Backward Packets"),
        "sbytes": num("Total Length of Fwd Packets"),
        "dbytes": num("Total Length of Bwd Packets"),
        "smeansz": num("Fwd Packet Length Mean"),
        "dmeansz": num("Bwd Packet Length Mean"),
        "swin": num("Init_Win_bytes_forward"),
        "dwin": num("Init_Win_bytes_backward"),
        "sintpkt": num("Fwd IAT Mean") / 1e3,
        "dintpkt": num("Bwd IAT Mean") / 1e3,
    }
    names = {11: FLOW_FEATURES_11, 15: FLOW_FEATURES_15, 17: FLOW_FEATURES_17}[n]
    if n > 11:
        cols |= {
            "fwd_pkt_mean": cols["smeansz"], "bwd_pkt_mean": cols["dmeansz"], "bwd_iat": cols["dintpkt"],
            "fin_cnt": num("FIN Flag Count"), "ack_cnt": num("ACK Flag Count"), "syn_cnt": num("SYN Flag Count"),
        }
        cols = {k: F.greatest(F.lit(0.0), v) for k, v in cols.items()}
    return df.select(*keep, *[cols[c].alias(c) for c in names])


def align_foreign_flow(df: DataFrame, n: int = 17, keep: Sequence[str] = ()) -> DataFrame:
    """Label table B in the same schema: packet means derived, missing flag counts and windows set to 0."""
    low = {c.lower(): c for c in df.columns}

    def num(name):
        return F.col(low[name]).cast("double") if name in low else F.lit(0.0)

    cols = {c: num(c) for c in ("dur", "spkts", "dpkts", "sbytes", "dbytes", "smeansz", "dmeansz",
                                "sintpkt", "dintpkt")}
    cols |= {
        "swin": F.lit(0.0), "dwin": F.lit(0.0),
        "fwd_pkt_mean": cols["sbytes"] / F.greatest(cols["spkts"], F.lit(1.0)),
        "bwd_pkt_mean": cols["dbytes"] / F.greatest(cols["dpkts"], F.lit(1.0)),
        "fin_cnt": F.lit(0.0), "ack_cnt": F.lit(0.0), "syn_cnt": F.lit(0.0),
        "bwd_iat": cols["dintpkt"],
    }
    names = {15: FLOW_FEATURES_15, 17: FLOW_FEATURES_17}[n]
    return df.select(*keep, *[cols[c].alias(c) for c in names])


def log1p_cols(df: DataFrame, columns: Iterable[str], clip: bool = True) -> DataFrame:
    def f(name):
        v = F.col(name).cast("double")
        return F.log1p(F.greatest(v, F.lit(0.0)) if clip else v)
    return df.withColumns({c: f(c) for c in columns})


def clamp(col, hi: float = 1020.0) -> Column:
    """Cap from above (TCP windows by default)."""
    return F.least(_c(col).cast("double"), F.lit(float(hi)))


def robust_scale(df: DataFrame, params: dict[str, tuple[float, float]], zero_iqr: str = "zero") -> DataFrame:
    """``(x - median) / iqr`` per column; a zero iqr gives 0 ('zero', serving) or divides by 1 ('one', explain)."""
    def f(name):
        median, iqr = params[name]
        if iqr == 0.0 and zero_iqr == "zero":
            return F.lit(0.0)
        return (F.col(name) - F.lit(float(median))) / F.lit(float(iqr or 1.0))
    return df.withColumns({c: f(c) for c in params})


def partial_flow(max_pkt, total="total_pkts") -> dict[str, Column]:
    """Features of a finished flow as they would look after its first ``max_pkt`` packets.

    Packet counts shrink by the share seen, bytes follow their packets, sizes and windows stay, times are 0 for
    one or two packets.
    """
    m = _c(max_pkt).cast("double")
    tot = F.greatest(_c(total).cast("double"), F.lit(1.0))
    share = F.least(F.lit(1.0), m / tot)
    spkts, dpkts = F.col("spkts").cast("double"), F.col("dpkts").cast("double")
    fwd = F.greatest(F.lit(1.0), F.bround(spkts * share))
    bwd = F.greatest(F.lit(0.0), m - fwd)
    few = m <= 2
    return {
        "dur": F.when(few, 0.0).otherwise(F.col("dur") * share),
        "spkts": fwd,
        "dpkts": bwd,
        "sbytes": F.col("sbytes") * (fwd / F.greatest(spkts, F.lit(1.0))),
        "dbytes": F.when(dpkts > 0, F.col("dbytes") * (bwd / F.greatest(dpkts, F.lit(1.0)))).otherwise(0.0),
        "smeansz": F.col("smeansz"), "dmeansz": F.col("dmeansz"),
        "swin": F.col("swin"), "dwin": F.col("dwin"),
        "sintpkt": F.when(few, 0.0).otherwise(F.col("sintpkt")),
        "dintpkt": F.when(few, 0.0).when(bwd >= 2, F.col("dintpkt")).otherwise(0.0),
    }


def classify_dos(staged=None, high_syn_rate=None) -> Column:
    """volumetric / slow_rate / generic from flow features; the SYN-rate gate overrides.

    ``staged`` false marks a first-stage score, which is always generic.
    """
    packets = F.col("spkts") + F.col("dpkts")
    shape = (F.when((packets > 6) & (F.col("sintpkt") < 0.001) & (F.col("dur") < 1.0), "volumetric")
             .when((F.col("dur") > 5.0) & (packets <= 6) & (F.col("sintpkt") > 0.5), "slow_rate")
             .otherwise("generic"))
    if staged is not None:
        shape = F.when(_c(staged), shape).otherwise("generic")
    return shape if high_syn_rate is None else F.when(_c(high_syn_rate), "volumetric").otherwise(shape)
