"""Per-flow features from packets, and the prefix of a flow a detector looks at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewatch.functions.features import ratio
from tidewatch.functions.packets import ACK, FIN, RST, SYN


def flow_prefix(packets: DataFrame, max_packets: int = 8, closing: Column | None = None, min_close: int = 1,
                key: str = "flow_key") -> DataFrame:
    """Packets of each flow up to the ``max_packets``-th, or to the first closing packet if that comes earlier.

    ``min_close`` is the position from which a closing packet ends the prefix. The rank limit is applied per task
    before the shuffle, so a flow holding a large share of the packets costs ``max_packets`` rows per task.
    """
    closing = (F.col("flags").bitwiseAND(FIN | RST) != 0) if closing is None else closing
    order = W.partitionBy(key).orderBy("ts_us", "event_id")
    first = packets.withColumn("pkt_no", F.row_number().over(order)).filter(F.col("pkt_no") <= max_packets)
    return running_close(first, closing, min_close, key)


def running_close(df: DataFrame, closing: Column, min_close: int = 1, key: str = "flow_key") -> DataFrame:
    """Keep rows up to and including the first closing one (numbered by ``pkt_no``)."""
    before = W.partitionBy(key).orderBy("pkt_no").rowsBetween(W.unboundedPreceding, -1)
    done = F.max((closing & (F.col("pkt_no") >= min_close)).cast("int")).over(before)
    return df.withColumn("_done", done).filter(F.coalesce("_done", F.lit(0)) == 0).drop("_done")


def _mean_gap_ms(side: Column, n: Column) -> Column:
    """Ordered times telescope: mean gap = (last - first) / (n - 1)."""
    span = F.max(F.when(side, F.col("ts_us"))) - F.min(F.when(side, F.col("ts_us")))
    return F.when(n > 1, span / (n - 1) / 1000.0).otherwise(F.lit(0.0))


def flow_features(packets: DataFrame, width: int = 11, key: str = "flow_key") -> DataFrame:
    """One row per flow: 11 features (with TCP windows) or 15 (with flag counts)."""
    fwd, bwd = F.col("from_client"), ~F.col("from_client")
    n_f, n_b = F.count_if(fwd), F.count_if(bwd)
    tcp = F.col("proto") == 6
    first = F.struct("ts_us", "event_id")

    def first_window(side: Column) -> Column:
        return F.coalesce(F.min_by("tcp_win", F.when(side & tcp & (F.col("tcp_win") >= 0), first)).cast("double"),
                          F.lit(0.0))

    def flag(bit: int) -> Column:
        return F.count_if(tcp & (F.col("flags").bitwiseAND(bit) != 0)).cast("double")

    aggs = {
        "dur": (F.max("ts_us") - F.min("ts_us")) / 1e6,
        "spkts": n_f.cast("double"), "dpkts": n_b.cast("double"),
        "sbytes": F.coalesce(F.sum(F.when(fwd, F.col("payload_len"))), F.lit(0)).cast("double"),
        "dbytes": F.coalesce(F.sum(F.when(bwd, F.col("payload_len"))), F.lit(0)).cast("double"),
        "swin": first_window(fwd), "dwin": first_window(bwd),
        "sintpkt": _mean_gap_ms(fwd, n_f), "dintpkt": _mean_gap_ms(bwd, n_b),
        "fin_cnt": flag(FIN), "ack_cnt": flag(ACK), "syn_cnt": flag(SYN),
    }
    wanted = [c for c in aggs if width == 11 and not c.endswith("_cnt") or width == 15 and c not in ("swin", "dwin")]
    out = packets.groupBy(key).agg(*[aggs[c].alias(c) for c in wanted])
    out = out.withColumns({"smeansz": ratio("sbytes", "spkts"), "dmeansz": ratio("dbytes", "dpkts")})
    if width == 15:
        out = out.withColumns({"fwd_pkt_mean": F.col("smeansz"), "bwd_pkt_mean": F.col("dmeansz"),
                               "bwd_iat": F.col("dintpkt")})
    return out


def flow_features_11(packets: DataFrame) -> DataFrame:
    return flow_features(packets, 11)


def flow_features_15(packets: DataFrame) -> DataFrame:
    return flow_features(packets, 15)
