"""Keyed aggregations: packets and flow rows → one feature row per key and window.

Every feature set is built the same way. Each row is spread over a few *axes* (its port, its address, its second),
counts per (key, window, axis, value) are combined before the shuffle, and one more grouping folds the counts into
features. A key that holds a large share of the rows is therefore spread over its ports, addresses and seconds, and
no task ever sees the raw rows of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewatch.functions.addresses import is_private_ip
from tidewatch.functions.features import ratio
from tidewatch.functions.packets import FIN, PSH, RST, SYN, ACK, has, is_syn, is_syn_ack
from tidewatch.operators.edges import neighbour

US = 1_000_000


def window_start(ts_us, window_sec: int) -> Column:
    """Start (epoch seconds) of the aligned window a time falls in."""
    c = ts_us if isinstance(ts_us, Column) else F.col(ts_us)
    return (F.floor(c / F.lit(window_sec * US)) * window_sec).cast("bigint")


def spread_axes(df: DataFrame, keys: Sequence[str], axes: dict[str, Column], extra: Sequence[Column] = ()) -> DataFrame:
    """Counts per (keys, axis, value); ``extra`` aggregates ride along on each count row."""
    rows = df.withColumn("_axes", F.explode(F.array(*[
        F.struct(F.lit(name).alias("axis"), col.cast("string").alias("val")) for name, col in axes.items()])))
    return rows.groupBy(*keys, F.col("_axes.axis").alias("axis"), F.col("_axes.val").alias("val")).agg(
        F.count("*").alias("n"), *extra)


def on(axis: str, col) -> Column:
    return F.when(F.col("axis") == axis, col)


def axis_distinct(axis: str) -> Column:
    return F.count_if(F.col("axis") == axis)


def axis_total(axis: str) -> Column:
    return F.coalesce(F.sum(on(axis, F.col("n"))), F.lit(0))


def entropy(axis: str) -> Column:
    """Shannon entropy (bits) of the counts of one axis; 0 when there is at most one event.

    ``log2(N) - sum(n log2 n) / N`` needs no total beforehand, so it is a plain aggregate.
    """
    n = F.col("n").cast("double")
    total = F.sum(on(axis, n))
    value = F.log2(total) - F.sum(on(axis, n * F.log2(n))) / total
    return F.when(total > 1, F.greatest(value, F.lit(0.0))).otherwise(F.lit(0.0))


def top_share(axis: str) -> Column:
    """Largest group over the total of one axis."""
    return F.coalesce(F.max(on(axis, F.col("n"))) / F.sum(on(axis, F.col("n"))), F.lit(0.0))


def time_density(axis: str = "sec") -> Column:
    """Distinct whole seconds over events; 0 below two events."""
    return F.when(axis_total(axis) >= 2, axis_distinct(axis) / axis_total(axis)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- gaps between events

def gap_counts(df: DataFrame, keys: Sequence[str], ts_us: str = "ts_us", span_sec: int = 60, pieces: int = 64,
               origin: str | None = None) -> DataFrame:
    """Counts of each positive gap (µs) between consecutive distinct times per key → (keys, gap_us, n).

    Equal times are merged first, then the gaps are taken inside short pieces of time and across their edges, so the
    rows of one sort group are limited by the clock (``span_sec`` / ``pieces`` microseconds), not by the traffic.
    """
    piece = max(1, span_sec * US // pieces)
    base = F.col(ts_us) if origin is None else F.col(ts_us) - F.col(origin)
    times = df.select(*keys, F.col(ts_us).alias("_t"), F.floor(base / piece).alias("_piece")).distinct()
    times = times.repartition(*keys, "_piece")     # one exchange serves the lag and the edges
    inside = times.withColumn("_prev", F.lag("_t").over(W.partitionBy(*keys, "_piece").orderBy("_t")))
    edges = times.groupBy(*keys, "_piece").agg(F.min("_t").alias("_t"), F.max("_t").alias("_last"))
    across = edges.withColumn("_prev", F.lag("_last").over(W.partitionBy(*keys).orderBy("_piece")))
    both = inside.select(*keys, "_t", "_prev").unionByName(across.select(*keys, "_t", "_prev"))
    return (both.filter(F.col("_prev").isNotNull())
            .groupBy(*keys, (F.col("_t") - F.col("_prev")).alias("gap_us")).agg(F.count("*").alias("n")))


def gap_pairs(df: DataFrame, keys: Sequence[str], ts_us: str = "ts_us", piece_us: int = US) -> DataFrame:
    """Consecutive distinct times of a key → (keys, _prev, _t); same pieces as ``gap_counts``."""
    times = df.select(*keys, F.col(ts_us).alias("_t"), F.floor(F.col(ts_us) / piece_us).alias("_piece")).distinct()
    times = times.repartition(*keys, "_piece")
    inside = times.withColumn("_prev", F.lag("_t").over(W.partitionBy(*keys, "_piece").orderBy("_t")))
    edges = times.groupBy(*keys, "_piece").agg(F.min("_t").alias("_t"), F.max("_t").alias("_last"))
    across = neighbour(edges, keys, "_piece", "_last", "_prev")
    cols = [*keys, "_prev", "_t"]
    return inside.select(*cols).unionByName(across.select(*cols)).filter(F.col("_prev").isNotNull())


def gap_features(gaps: DataFrame, keys: Sequence[str], min_gap_us: int = 1, quantile_min_gap_us: int = 2) -> DataFrame:
    """``iat_cv`` and ``iat_q90_q10`` from gap counts.

    cv: population deviation over mean, at least two gaps. Ratio: sorted gaps at index ``9n//10`` over ``n//10``, at
    least four gaps. Distinct gaps of one window add up to at most its length, which bounds the sort per key.
    """
    q = F.when(F.col("gap_us") >= quantile_min_gap_us, F.col("n")).otherwise(0)
    by_gap = W.partitionBy(*keys).orderBy("gap_us").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    ranked = (gaps.withColumn("_q", q).withColumn("_hi", F.sum("_q").over(by_gap))
              .withColumn("_lo", F.col("_hi") - F.col("_q")).withColumn("_nq", F.sum("_q").over(whole)))

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= index) & (index < F.col("_hi")), F.col("gap_us")))

    d, n = F.col("gap_us").cast("double"), F.when(F.col("gap_us") >= min_gap_us, F.col("n")).otherwise(0)
    agg = ranked.groupBy(*keys).agg(
        F.sum(n).alias("_n"), F.sum(n * d).alias("_s1"), F.sum(n * d * d).alias("_s2"), F.max("_nq").alias("_nq"),
        at(F.floor(F.col("_nq") / 10)).alias("_q10"), at(F.floor(F.col("_nq") * 9 / 10)).alias("_q90"))
    mean = F.col("_s1") / F.col("_n")
    var = F.greatest(F.col("_s2") / F.col("_n") - mean * mean, F.lit(0.0))
    return agg.select(
        *keys,
        F.when((F.col("_n") >= 2) & (F.col("_s1") > 0), F.sqrt(var) / mean).otherwise(0.0).alias("iat_cv"),
        F.when((F.col("_nq") >= 4) & (F.col("_q10") > 0), F.col("_q90") / F.col("_q10")).otherwise(0.0)
        .alias("iat_q90_q10"))


def _with_gaps(base: DataFrame, gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(gaps, list(keys), "left").na.fill(0.0, ["iat_cv", "iat_q90_q10"])


# ---------------------------------------------------------------- packet windows

def syn_window_features(packets: DataFrame, window_sec: int = 60, min_syns: int = 1, key: str = "src_ip") -> DataFrame:
    """The 7 SYN features per source and aligned window."""
    syn = packets.filter((F.col("proto") == 6) & (F.col("flags").bitwiseAND(SYN | RST | ACK) == SYN)).withColumn(
        "win_start", window_start("ts_us", window_sec))
    return _syn_features(syn, [key, "win_start"], window_sec, min_syns)


def _syn_features(syn: DataFrame, keys: Sequence[str], window_sec: int, min_syns: int) -> DataFrame:
    counts = spread_axes(syn, keys, {"port": F.col("dst_port"), "ip": F.col("dst_ip")},
                         [F.min("src_port").alias("lo"), F.max("src_port").alias("hi")])
    out = counts.groupBy(*keys).agg(
        axis_total("port").alias("syn_count"), axis_distinct("port").alias("dst_ports"),
        axis_distinct("ip").alias("dst_ips"), entropy("port").alias("port_entropy"),
        (F.max("hi") - F.min("lo")).cast("double").alias("src_port_range"))
    out = out.filter(F.col("syn_count") >= min_syns)
    return out.withColumns({"port_ratio": ratio("dst_ports", "syn_count"),
                            "rate": F.col("syn_count") / F.lit(float(window_sec))})


def endpoint_window_features(packets: DataFrame, window_sec: int = 60, min_events: int = 1) -> DataFrame:
    """The 7 endpoint features per (dst_ip, dst_port) and window. A SYN counts twice, a UDP packet once."""
    syn = (F.col("proto") == 6) & is_syn("flags")
    rows = packets.filter(syn | (F.col("proto") == 17)).select(
        "dst_ip", "dst_port", window_start("ts_us", window_sec).alias("win_start"), "src_ip", "src_port",
        syn.alias("syn"))
    keys = ["dst_ip", "dst_port", "win_start"]
    counts = spread_axes(rows, [*keys, "syn"], {"ip": F.col("src_ip"), "port": F.col("src_port")})
    s = F.col("syn")
    out = counts.groupBy(*keys).agg(
        F.sum(on("ip", F.col("n") * F.when(s, 2).otherwise(1))).alias("total"),
        F.count_if(s & (F.col("axis") == "ip")).alias("src_ips"),
        F.count_if(s & (F.col("axis") == "port")).alias("src_ports"))
    out = out.filter(F.col("total") >= min_events)
    return out.withColumns({"ports_per_src": ratio("src_ports", "src_ips"), "reserved": F.lit(0.0),
                            "src_ratio": ratio("src_ips", "total"),
                            "rate": F.col("total") / F.lit(float(window_sec))})


def dual_role(packets: DataFrame) -> DataFrame:
    """Each TCP packet twice: once for its source's profile, once for its destination's."""
    return both_ends(packets.filter(F.col("proto") == 6))


def both_ends(packets: DataFrame) -> DataFrame:
    return packets.withColumn("_r", F.explode(F.array(
        F.struct(F.lit("src").alias("role"), F.col("src_ip").alias("ip"), F.col("dst_ip").alias("peer_ip")),
        F.struct(F.lit("dst").alias("role"), F.col("dst_ip").alias("ip"), F.col("src_ip").alias("peer_ip"))))
    ).select("_r.role", "_r.ip", "_r.peer_ip", *[c for c in packets.columns if c not in ("src_ip", "dst_ip")])


def _role_features(packets: DataFrame, window_sec: int, min_syns: int, private_only: bool) -> DataFrame:
    rows = dual_role(packets).withColumn("win_start", window_start("ts_us", window_sec))
    src, dst = F.col("role") == "src", F.col("role") == "dst"
    syn = src & is_syn("flags")
    if private_only:
        syn = syn & is_private_ip("ip")
    ack = dst & is_syn_ack("flags")
    rows = rows.select("ip", "win_start", "ts_us", "dst_port", "peer_ip", *[c.cast("bigint").alias(a) for a, c in {
        "syn": syn, "hs": ack, "rst": src & has("flags", RST), "fin": src & has("flags", FIN),
        "psh": src & has("flags", PSH), "inp": dst,
        "inb": F.when(dst, F.greatest(F.col("payload_len"), F.lit(0))).otherwise(0),
        "win": F.when(ack, F.col("tcp_win")).otherwise(0)}.items()])
    keys = ["ip", "win_start"]
    s = F.col("syn") == 1
    counts = spread_axes(
        rows, keys,
        {"port": F.when(s, F.col("dst_port")), "ip": F.when(s, F.col("peer_ip")),
         "sec": F.when(s, F.floor(F.col("ts_us") / US))},
        [F.sum(c).alias(c) for c in ("syn", "hs", "rst", "fin", "psh", "inp", "inb", "win")])
    # the other counters are repeated on every axis: take them from the port axis, null row included
    once = F.col("_first")
    live = counts.withColumn("_first", F.col("axis") == "port").withColumn(
        "axis", F.when(F.col("val").isNotNull(), F.col("axis")))
    inside = is_private_ip("val")
    agg = live.groupBy(*keys).agg(
        axis_total("port").alias("syn_count"), axis_distinct("ip").alias("dst_ips"),
        axis_distinct("port").alias("dst_ports"), entropy("port").alias("port_entropy"),
        entropy("ip").alias("ip_entropy"), top_share("port").alias("top_port_share"),
        top_share("ip").alias("ip_conc"), time_density("sec").alias("time_density"),
        F.coalesce(F.sum(on("ip", F.when(inside, F.col("n")))), F.lit(0)).alias("_internal"),
        *[F.sum(F.when(once, F.col(c))).alias(f"_{c}") for c in ("hs", "rst", "fin", "psh", "inp", "inb", "win")])
    agg = agg.filter(F.col("syn_count") >= min_syns)
    syn_rows = rows.filter(s)
    gaps = gap_features(gap_counts(syn_rows, keys, span_sec=window_sec), keys)
    return _with_gaps(agg, gaps, keys)


def auth_window_features(packets: DataFrame, window_sec: int = 120, min_syns: int = 1) -> DataFrame:
    """The 10 authentication-attack features per source and window."""
    f = _role_features(packets, window_sec, min_syns, private_only=False)
    n = F.col("syn_count")
    return f.select(
        "ip", "win_start", "syn_count", "dst_ips", "dst_ports", ratio("dst_ports", n).alias("port_ratio"),
        "top_port_share", (n / F.lit(float(window_sec))).alias("rate"), "iat_cv",
        ratio("_hs", n).alias("handshake_ratio"), ratio("_rst", "_hs").alias("rst_per_handshake"),
        ratio("_inb", n).alias("bytes_per_syn"))


def client_window_features(packets: DataFrame, window_sec: int = 300, min_syns: int = 1,
                           private_only: bool = True) -> DataFrame:
    """The 22 client features per (private) source and window."""
    f = _role_features(packets, window_sec, min_syns, private_only)
    n = F.col("syn_count")
    return f.select(
        "ip", "win_start", "syn_count", "dst_ips", "dst_ports", "iat_cv", "port_entropy",
        ratio("dst_ports", n).alias("port_ratio"), (n / F.lit(float(window_sec))).alias("rate"), "ip_conc",
        ratio("dst_ips", n).alias("ip_ratio"), "ip_entropy", "iat_q90_q10", "time_density",
        ratio("dst_ports", "dst_ips").alias("port_ip_ratio"), ratio("_hs", n).alias("handshake_ratio"),
        ratio("_inp", n + F.col("_inp")).alias("inc_ratio"), ratio("_inp", n).alias("data_density"),
        ratio("_rst", n).alias("rst_rate"), ratio("_internal", n).alias("internal_ratio"),
        ratio("_inb", n).alias("bytes_per_syn"), ratio("_fin", n).alias("fin_ratio"),
        ratio("_psh", n).alias("push_ratio"), ratio("_win", "_hs").alias("mean_window"))


# ---------------------------------------------------------------- flow-row windows

def flow_window_features_4(flows: DataFrame, window_sec: int = 60, rule: Column | None = None) -> DataFrame:
    """Distinct ports and addresses, flow count, rate and label = max, per source and window of flow rows."""
    hit = (F.col("label") == "PortScan") if rule is None else rule
    keys = ["src_ip", "window_id"]
    rows = flows.withColumn("window_id", F.floor(F.col("ts_us") / (window_sec * US)).cast("bigint"))
    counts = spread_axes(rows, keys, {"port": F.col("dst_port"), "ip": F.col("dst_ip")},
                         [F.max(hit.cast("int")).alias("hit")])
    out = counts.groupBy(*keys).agg(
        axis_distinct("port").alias("unique_dst_ports"), axis_distinct("ip").alias("unique_dst_ips"),
        axis_total("port").alias("total_flows"), F.max("hit").alias("label"))
    return out.withColumn("flow_rate", F.col("total_flows") / F.lit(float(window_sec)))


def _batch_features(rows: DataFrame, keys: Sequence[str], window_sec: int, min_rows: int, extra: dict[str, Column],
                    min_gap_us: int = 2, loopback: bool = False) -> DataFrame:
    counts = _batch_counts(rows, keys, extra)
    gaps = gap_features(gap_counts(rows, keys, span_sec=window_sec), keys, min_gap_us, min_gap_us)
    return _batch_fold(counts, gaps, keys, window_sec, min_rows, extra, loopback)


def _batch_counts(rows: DataFrame, keys: Sequence[str], extra: dict[str, Column]) -> DataFrame:
    return spread_axes(rows, keys, {"port": F.col("dst_port"), "ip": F.col("dst_ip"), "sec": F.floor(F.col("ts_us") / US)},
                       [F.sum(c).alias(f"_{a}") for a, c in extra.items()])


def _batch_fold(counts: DataFrame, gaps: DataFrame, keys: Sequence[str], window_sec: int, min_rows: int, extra,
                loopback: bool = False) -> DataFrame:
    agg = counts.groupBy(*keys).agg(
        axis_total("port").alias("syn_count"), axis_distinct("ip").alias("dst_ips"),
        axis_distinct("port").alias("dst_ports"), entropy("port").alias("port_entropy"),
        entropy("ip").alias("ip_entropy"), top_share("ip").alias("ip_conc"),
        (axis_distinct("sec") / axis_total("sec")).alias("time_density"),
        F.coalesce(F.sum(on("ip", F.when(is_private_ip("val", loopback), F.col("n")))), F.lit(0)).alias("_internal"),
        *[F.sum(on("port", F.col(f"_{a}"))).alias(f"_{a}") for a in extra])
    agg = agg.filter(F.col("syn_count") >= min_rows)
    n = F.col("syn_count")
    return _with_gaps(agg, gaps, keys).withColumns({
        "port_ratio": ratio("dst_ports", n), "rate": n / F.lit(float(window_sec)),
        "ip_ratio": ratio("dst_ips", n), "port_ip_ratio": ratio("dst_ports", "dst_ips"),
        "internal_ratio": ratio("_internal", n)})


def _sliding_features(rows: DataFrame, key: str, window_sec: int, stride_sec: int, min_rows: int,
                      extra: dict[str, Column], min_gap_us: int = 2) -> DataFrame:
    """Sliding windows from panes of one stride.

    Rows are counted per pane before they are repeated for the ``window / stride`` windows a pane belongs to, and a
    gap is taken once and given to the windows that hold both of its ends. Needs a window that is a multiple of the
    stride; other windows repeat the rows themselves.
    """
    keys = [key, "win_start"]
    if window_sec % stride_sec:
        spread = rows.withColumn("win_start", F.explode(sliding_starts("ts_us", window_sec, stride_sec)))
        return _batch_features(spread, keys, window_sec, min_rows, extra, min_gap_us)
    pane = window_start("ts_us", stride_sec)
    panes = _batch_counts(rows.withColumn("_pane", pane), [key, "_pane"], extra)
    first = F.greatest(F.col("_pane") - window_sec + stride_sec, F.lit(0))
    starts = F.explode(F.sequence(first, F.col("_pane"), F.lit(stride_sec).cast("bigint")))
    counts = panes.withColumn("win_start", starts).groupBy(*keys, "axis", "val").agg(
        F.sum("n").alias("n"), *[F.sum(f"_{a}").alias(f"_{a}") for a in extra])
    pairs = gap_pairs(rows, [key], piece_us=max(1, window_sec * US // 64)).filter(
        F.col("_t") - F.col("_prev") < window_sec * US)
    low = F.greatest(window_start("_t", stride_sec) - window_sec + stride_sec, F.lit(0))
    high = window_start("_prev", stride_sec)
    pairs = pairs.filter(low <= high).withColumn("win_start", F.explode(F.sequence(low, high, F.lit(stride_sec).cast("bigint"))))
    gaps = pairs.groupBy(*keys, (F.col("_t") - F.col("_prev")).alias("gap_us")).agg(F.count("*").alias("n"))
    return _batch_fold(counts, gap_features(gaps, keys, min_gap_us, min_gap_us), keys, window_sec, min_rows, extra)


_SEVEN = ["syn_count", "dst_ips", "dst_ports", "iat_cv", "port_entropy", "port_ratio", "rate"]


def client_window_batch(flows: DataFrame, window_sec: int = 300, width: int = 7, min_rows: int = 1,
                        bots: DataFrame | None = None) -> DataFrame:
    """Tumbling client windows from flow rows with 7, 18 or 22 features.

    ``bots(src_ip)`` labels the sources. The 18-wide form fixes four packet-only features at 0 and counts 127/8 as
    internal; the 22-wide form uses backward packets and forward bytes for the inbound features and fixes five at 0.
    """
    keys = ["src_ip", "win_start"]
    rows = flows.withColumn("win_start", window_start("ts_us", window_sec))
    extra = {"bwd": F.col("dpkts").cast("bigint"), "fwdb": F.col("sbytes")} if width == 22 else {}
    f = _batch_features(rows, keys, window_sec, min_rows, extra, loopback=width == 18)
    n, zero = F.col("syn_count"), F.lit(0.0)
    wide = ["ip_conc", "ip_ratio", "ip_entropy", "iat_q90_q10", "time_density", "port_ip_ratio"]
    if width == 7:
        out = f.select(*keys, *_SEVEN)
    elif width == 18:
        out = f.select(*keys, *_SEVEN, *wide, *[zero.alias(c) for c in (
            "handshake_ratio", "inc_ratio", "data_density", "rst_rate")], "internal_ratio")
    else:
        out = f.select(*keys, *_SEVEN, *wide, zero.alias("handshake_ratio"),
                       ratio("_bwd", n + F.col("_bwd")).alias("inc_ratio"), ratio("_bwd", n).alias("data_density"),
                       zero.alias("rst_rate"), "internal_ratio", ratio("_fwdb", n).alias("bytes_per_syn"),
                       *[zero.alias(c) for c in ("fin_ratio", "push_ratio", "mean_window")])
    return label_sources(out, bots) if bots is not None else out


def label_sources(df: DataFrame, sources: DataFrame, key: str = "src_ip") -> DataFrame:
    """Label 1 for rows whose key is in ``sources``, else 0."""
    hit = sources.select(key).distinct().withColumn("_hit", F.lit(1))
    return df.join(hit, key, "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def sliding_starts(ts_us, window_sec: int, stride_sec: int) -> Column:
    """Starts of all sliding windows over a time; the first is clipped at 0."""
    t = (ts_us if isinstance(ts_us, Column) else F.col(ts_us)) / F.lit(float(US))
    first = F.greatest(F.floor((t - window_sec + stride_sec) / stride_sec) * stride_sec, F.lit(0)).cast("bigint")
    last = (F.floor(t / stride_sec) * stride_sec).cast("bigint")
    return F.sequence(first, last, F.lit(stride_sec).cast("bigint"))


def client_window_sliding(flows: DataFrame, window_sec: int = 300, stride_sec: int = 60, min_rows: int = 1,
                          bots: DataFrame | None = None) -> DataFrame:
    """7 features over overlapping windows."""
    keys = ["src_ip", "win_start"]
    f = _sliding_features(flows, "src_ip", window_sec, stride_sec, min_rows, {}).select(*keys, *_SEVEN)
    return label_sources(f, bots) if bots is not None else f


def client_window_sliding_inbound(flows: DataFrame, window_sec: int = 300, stride_sec: int = 60, min_rows: int = 2,
                                  is_bot_flow: Column | None = None) -> DataFrame:
    """Sliding windows of at least ``min_rows`` rows with the count of flows towards the source in the same window.

    Positive only if the window itself holds a bot-labelled flow of that source.
    """
    hit = F.col("label") != "BENIGN" if is_bot_flow is None else is_bot_flow
    keys = ["src_ip", "win_start"]
    rows = flows.withColumn("_bot", hit.cast("bigint"))
    out = _sliding_features(rows, "src_ip", window_sec, stride_sec, min_rows, {"bot": F.col("_bot")})
    inbound = inbound_counts(flows, window_sec, stride_sec)
    n = F.col("syn_count")
    return (out.join(inbound, keys, "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))
            .select(*keys, *_SEVEN, "inbound", ratio("inbound", n + F.col("inbound")).alias("inbound_ratio"),
                    (F.col("_bot") > 0).cast("int").alias("label")))


def inbound_counts(flows: DataFrame, window_sec: int, stride_sec: int) -> DataFrame:
    """Flows whose destination is the profiled source, per sliding window."""
    # rows with equal sets of windows are counted before they are repeated
    per = flows.groupBy(F.col("dst_ip").alias("src_ip"), sliding_starts("ts_us", window_sec, stride_sec).alias("_w")).agg(
        F.count("*").alias("_n"))
    return per.select("src_ip", F.explode("_w").alias("win_start"), "_n").groupBy("src_ip", "win_start").agg(
        F.sum("_n").alias("inbound"))


def window_counts_by_source(flows: DataFrame, window_sec: int = 300, is_hit: Column | None = None) -> DataFrame:
    """Windows and labelled windows per source, with mean and largest rows per window."""
    hit = F.col("label") != "BENIGN" if is_hit is None else is_hit
    per = (flows.withColumn("win_start", window_start("ts_us", window_sec)).groupBy("src_ip", "win_start")
           .agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")))
    return per.groupBy("src_ip").agg(
        F.sum("n").alias("flows"), F.sum("hits").alias("hit_flows"), F.count("*").alias("windows"),
        F.count_if(F.col("hits") > 0).alias("hit_windows"), F.avg("n").alias("mean_rows"),
        F.max("n").alias("max_rows"))


def syn_rate_gate(packets: DataFrame, window_sec: int = 60, min_rate: int = 30, max_ip_ratio: float = 0.5,
                  max_port_ratio: float = 0.3) -> DataFrame:
    """Batch twin of the SYN-rate gate: sources with many SYNs towards few addresses and ports per window."""
    f = syn_window_features(packets, window_sec)
    n = F.col("syn_count")
    return f.select("src_ip", "win_start", "syn_count", ratio("dst_ips", n).alias("ip_ratio"), "port_ratio").withColumn(
        "attack_pattern", (n >= min_rate) & (F.col("ip_ratio") < max_ip_ratio) & (F.col("port_ratio") < max_port_ratio))
