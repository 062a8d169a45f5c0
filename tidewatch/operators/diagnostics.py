"""False-positive diagnostics and feature profiles over tagged flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewatch.functions.features import ratio
from tidewatch.operators.quantiles import exact_percentiles, melt, percentile_table


def total_packets() -> Column:
    return (F.col("spkts") + F.col("dpkts")).cast("double")


def fp_artifacts(tagged: DataFrame, short_us: float = 10_000) -> DataFrame:
    """Counts and shares of short or tiny false positives (durations in µs)."""
    short, one, two = F.col("dur") < short_us, total_packets() <= 1, total_packets() <= 2
    out = tagged.filter("tag = 'FP'").agg(
        F.count("*").alias("total_fp"), F.count_if(short & one).alias("short_1pkt"),
        F.count_if(short & two).alias("short_2pkt"), F.count_if(one).alias("one_pkt"),
        F.count_if(two).alias("two_pkt"), F.count_if(short).alias("short"))
    return out.withColumns({"pct_strict": F.round(100 * ratio("short_1pkt", "total_fp"), 1),
                            "pct_loose": F.round(100 * ratio("short", "total_fp"), 1)})


def top_ports(df: DataFrame, k: int = 3, groups: Sequence[str] = (), port: str = "dst_port") -> DataFrame:
    """Most frequent valid ports with their share; ties by port number."""
    valid = df.filter((F.col(port) > 0) & (F.col(port) < 65536))
    counts = valid.groupBy(*groups, port).agg(F.count("*").alias("n"))
    whole = W.partitionBy(*(groups or [F.lit(0)]))
    ranked = counts.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn(
        "rank", F.row_number().over(whole.orderBy(F.col("n").desc(), F.col(port))))
    return ranked.filter(F.col("rank") <= k)


def fp_top_ports(tagged: DataFrame, k: int = 15) -> DataFrame:
    return top_ports(tagged.filter("tag = 'FP'"), k)


# Fixed bucket edges: name, first and last packet count (None = open).
PACKET_BUCKETS = (("1", 1, 1), ("2", 2, 2), ("3-5", 3, 5), ("6-10", 6, 10), ("11-50", 11, 50), ("50+", 51, None))
COHORTS = (("short", 0, 3), ("medium", 4, 20), ("long", 21, None))


def packet_buckets(df: DataFrame, buckets: Sequence[tuple] = PACKET_BUCKETS) -> DataFrame:
    """Rows per packet-count bucket with their share of all rows."""
    p = total_packets()
    b = None
    for name, lo, hi in buckets:
        inside = (p >= lo) if hi is None else p.between(lo, hi)
        b = F.when(inside, name) if b is None else b.when(inside, name)
    out = df.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))).filter("bucket is not null")


def cohort_medians(tagged: DataFrame, features: Sequence[str], group: str = "tag", a: str = "FP",
                   b: str = "TN") -> DataFrame:
    """Medians of two cohorts per feature and their ratio (null when the second is 0)."""
    m = exact_percentiles(tagged.filter(F.col(group).isin(a, b)), [group], features, [0.5])
    out = m.groupBy("feature").agg(F.max(F.when(F.col(group) == a, F.col("value"))).alias("median_a"),
                                   F.max(F.when(F.col(group) == b, F.col("value"))).alias("median_b"))
    return out.withColumn("ratio", F.when(F.col("median_b") != 0, F.col("median_a") / F.col("median_b")))


def label_medians(df: DataFrame, features: Sequence[str], group: str = "label") -> DataFrame:
    return percentile_table(df, [group], features, {"median": 0.5})


def group_profile(df: DataFrame, column: str, group: str = "tag", bands: Sequence[float] = (100, 500)) -> DataFrame:
    """min, quartiles, max, mean per group and the share of rows per value band."""
    v = F.col(column).cast("double")
    edges = [None, *bands, None]
    shares = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = F.lit(True) if lo is None else v >= lo
        inside = inside if hi is None else inside & (v < hi)
        shares.append(F.avg(inside.cast("double")).alias(f"band_{i}"))
    base = df.groupBy(group).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
                                 F.avg(v).alias("mean"), *shares)
    q = percentile_table(df, [group], [column], {"p25": 0.25, "median": 0.5, "p75": 0.75}).drop("feature")
    return base.join(q, group)


def flag_profile(tagged: DataFrame, group: str = "tag") -> DataFrame:
    """Mean flag counts per tag and the share of flows with SYN only."""
    syn_only = (F.col("syn_cnt") > 0) & (F.col("fin_cnt") == 0) & (F.col("rst_cnt") == 0) & (F.col("ack_cnt") == 0)
    return tagged.groupBy(group).agg(
        *[F.avg(f"{f}_cnt").alias(f) for f in ("syn", "fin", "rst", "ack", "psh")],
        F.avg(syn_only.cast("double")).alias("syn_only"))


def separability(tagged: DataFrame, features: Sequence[str], group: str = "tag", a: str = "FP", b: str = "TP",
                 min_rows: int = 10) -> DataFrame:
    """|Cohen's d| per feature between two cohorts, largest first.

    Mean and deviation are plain aggregates per cohort; only (cohorts × features) rows are turned afterwards.
    """
    cols = [agg for f in features for agg in (
        F.count(f).alias(f"{f}__n"), F.avg(F.col(f).cast("double")).alias(f"{f}__m"),
        F.stddev_samp(F.col(f).cast("double")).alias(f"{f}__s"))]
    per = tagged.filter(F.col(group).isin(a, b)).groupBy(group).agg(*cols)
    long = per.select(group, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}__n").alias("n"), F.col(f"{f}__m").alias("m"),
                 F.col(f"{f}__s").alias("s")) for f in features])).alias("_x")).select(group, "_x.*")
    def of(tag: str, c: str) -> Column:
        return F.max(F.when(F.col(group) == tag, F.col(c)))
    wide = long.groupBy("feature").agg(of(a, "n").alias("n_a"), of(b, "n").alias("n_b"), of(a, "m").alias("mean_a"),
                                       of(b, "m").alias("mean_b"), of(a, "s").alias("s_a"), of(b, "s").alias("s_b"))
    pooled = F.sqrt((F.col("s_a") * F.col("s_a") + F.col("s_b") * F.col("s_b")) / 2)
    out = wide.filter((F.col("n_a") >= min_rows) & (F.col("n_b") >= min_rows)).withColumn("_p", pooled).filter("_p > 0")
    out = out.withColumn("d", F.abs(F.col("mean_a") - F.col("mean_b")) / F.col("_p"))
    return out.select("feature", "n_a", "n_b", "mean_a", "mean_b", "d").orderBy(F.col("d").desc(), "feature")


def enrichment(tagged: DataFrame, column: str, cut: float, group: str = "tag", a: str = "FP",
               b: str = "TN") -> DataFrame:
    """Rate above a cut in two cohorts and the ratio of the rates (null when the second is 0)."""
    above = (F.col(column) > cut).cast("double")
    out = tagged.agg(F.avg(F.when(F.col(group) == a, above)).alias("rate_a"),
                     F.avg(F.when(F.col(group) == b, above)).alias("rate_b"))
    return out.withColumn("enrichment", F.when(F.col("rate_b") > 0, F.col("rate_a") / F.col("rate_b")))


def point_biserial(tagged: DataFrame, column: str, group: str = "tag", a: str = "FP", b: str = "TN") -> DataFrame:
    two = tagged.filter(F.col(group).isin(a, b))
    return two.agg(F.corr(F.col(column).cast("double"), (F.col(group) == a).cast("double")).alias("r"),
                   F.count("*").alias("n"))


def dominant_pattern(tagged: DataFrame) -> DataFrame:
    """Decision label from the share of the top port and of very short flows among the false positives."""
    fp = tagged.filter("tag = 'FP'")
    per_port = fp.groupBy("dst_port").agg(F.count("*").alias("n"), F.count_if(total_packets() <= 2).alias("s"))
    out = per_port.agg(F.sum("n").alias("total_fp"), F.sum("s").alias("short"), F.max("n").alias("top"),
                       F.min_by("dst_port", F.struct(-F.col("n"), F.col("dst_port"))).alias("top_port"))
    out = out.withColumns({"top_port_pct": 100 * ratio("top", "total_fp"), "short_pct": 100 * ratio("short", "total_fp")})
    return out.select("total_fp", "top_port", "top_port_pct", "short_pct",
                      F.when(F.col("top_port_pct") >= 60, "P1 port concentration")
                      .when(F.col("short_pct") >= 70, "P2 short-flow concentration").otherwise("P4 mixed")
                      .alias("pattern"))


# Fixed candidate rules: name, suppressed ports, largest packet count (None = any).
POSTFILTER_RULES = (("Rule 1", (53,), None), ("Rule 2", (53, 137), None), ("Rule 3", (53, 137, 389), None),
                    ("Rule 4", (53, 137, 389), 5))


def postfilter_simulation(tagged: DataFrame, rules: Sequence[tuple] = POSTFILTER_RULES) -> DataFrame:
    """What each rule would remove: false positives, true positives, remaining rates; best rule without loss."""
    cells = [F.count_if(F.col("tag") == t).alias(t.lower()) for t in ("TP", "FP", "TN", "FN")]
    marks = []
    for i, (_, ports, most) in enumerate(rules):
        hit = F.col("dst_port").isin(list(ports))
        hit = hit if most is None else hit & (total_packets() <= most)
        marks += [F.count_if((F.col("tag") == "FP") & hit).alias(f"_f{i}"),
                  F.count_if((F.col("tag") == "TP") & hit).alias(f"_t{i}")]
    one = tagged.agg(*cells, *marks)
    rows = one.select("tp", "fp", "tn", "fn", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"_f{i}").alias("fp_removed"), F.col(f"_t{i}").alias("tp_lost"))
        for i, (name, _, _) in enumerate(rules)])).alias("_r")).select("tp", "fp", "tn", "fn", "_r.*")
    rows = rows.withColumns({
        "remaining_fp": F.col("fp") - F.col("fp_removed"),
        "remaining_fpr": ratio(F.col("fp") - F.col("fp_removed"), F.col("fp") + F.col("tn")),
        "remaining_recall": ratio(F.col("tp") - F.col("tp_lost"), F.col("tp") + F.col("fn"))})
    order = W.partitionBy(F.lit(0)).orderBy(F.col("tp_lost") > 0, "remaining_fpr", "rule")
    best = (F.row_number().over(order) == 1) & (F.col("tp_lost") == 0)
    return rows.withColumn("is_best", best.cast("int")).select(
        "rule", "fp_removed", "tp_lost", "remaining_fp", "remaining_fpr", "remaining_recall", "is_best")


def constant_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distinct count and mean per feature; CONSTANT or VARIES."""
    long = melt(df, [], features).groupBy("feature", "value").agg(F.count("*").alias("n"))
    out = long.groupBy("feature").agg(F.count("value").alias("distinct_values"),
                                      (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    return out.withColumn("status", F.when(F.col("distinct_values") == 1, "CONSTANT").otherwise("VARIES"))


def class_mean_ratio(df: DataFrame, features: Sequence[str], positive: Column) -> DataFrame:
    """Mean per feature in the positive and the other class, and the ratio (null when the other mean is not > 0)."""
    one = df.agg(*[F.avg(F.when(c, F.col(f).cast("double"))).alias(f"{f}__{s}")
                   for f in features for s, c in (("p", positive), ("n", ~positive))])
    out = one.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}__p").alias("positive_mean"),
                 F.col(f"{f}__n").alias("other_mean")) for f in features])).alias("_x")).select("_x.*")
    return out.withColumn("ratio", F.when(F.col("other_mean") > 0, F.col("positive_mean") / F.col("other_mean")))


def feature_summary(df: DataFrame, features: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """mean, std, min, max per feature, overall or by class."""
    aggs = [fn(F.col(f).cast("double")).alias(f"{f}__{n}") for f in features for n, fn in (
        ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    wide = df.groupBy(*groups).agg(*aggs)
    return wide.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}__{n}").alias(n) for n in ("mean", "std", "min", "max")])
        for f in features])).alias("_x")).select(*groups, "_x.*")


# Fixed packet limits tried for early scoring.
PACKET_SWEEP = (2, 4, 6, 8, 10, 14, 20)


def packet_percentiles(flows: DataFrame, group: str = "label") -> DataFrame:
    rows = flows.withColumn("total_pkts", F.greatest(total_packets(), F.lit(1.0)))
    named = {f"p{int(p * 100)}": p for p in (0.10, 0.25, 0.50, 0.75, 0.90, 0.95)}
    return percentile_table(rows, [group], ["total_pkts"], named).drop("feature")


def coverage_at(flows: DataFrame, limits: Sequence[int] = PACKET_SWEEP, group: str = "label",
                target: float = 0.60) -> DataFrame:
    """Share of flows seen whole within N packets, and the smallest N reaching the target (null when none does)."""
    p = F.greatest(total_packets(), F.lit(1.0))
    per = flows.groupBy(group).agg(F.count("*").alias("n"), *[F.avg((p <= m).cast("double")).alias(f"_c{m}")
                                                             for m in limits])
    rows = per.select(group, "n", F.explode(F.array(*[
        F.struct(F.lit(m).alias("max_pkt"), F.col(f"_c{m}").alias("coverage")) for m in limits])).alias("_x")).select(
        group, "n", "_x.*")
    first = F.min(F.when(F.col("coverage") >= target, F.col("max_pkt"))).over(W.partitionBy(group))
    return rows.withColumn("chosen", first)


def train_serve_skew(df: DataFrame, features: Sequence[str], train_log1p: Sequence[str], serve_log1p: Sequence[str],
                     params: dict[str, tuple[float, float]]) -> DataFrame:
    """Mean and largest difference of two scalings per column, with a verdict over all columns."""
    def scaled(f: str, logged: Sequence[str]) -> Column:
        median, iqr = params[f]
        v = F.log1p(F.col(f).cast("double")) if f in logged else F.col(f).cast("double")
        return F.lit(0.0) if iqr == 0 else (v - median) / iqr
    diffs = {f: F.abs(scaled(f, serve_log1p) - scaled(f, train_log1p)) for f in features}
    one = df.agg(*[fn(c).alias(f"{f}__{n}") for f, c in diffs.items() for n, fn in (("m", F.avg), ("x", F.max))])
    rows = one.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}__m").alias("mean_diff"), F.col(f"{f}__x").alias("max_diff"))
        for f in features])).alias("_x")).select("_x.*")
    overall = F.avg("mean_diff").over(W.partitionBy(F.lit(0)))
    return rows.withColumn("verdict", F.when(overall > 0.05, "FIX_REQUIRED").when(overall > 0.01, "FIX_RECOMMENDED")
                           .otherwise("ACCEPTABLE"))


def shap_summary(contributions: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean absolute contribution per feature (and class), relative to the largest, ranked."""
    out = contributions.groupBy(*groups, "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    whole = W.partitionBy(*(groups or [F.lit(0)]))
    return out.withColumns({
        "relative_pct": 100 * F.col("mean_abs") / F.max("mean_abs").over(whole),
        "rank": F.row_number().over(whole.orderBy(F.col("mean_abs").desc(), "feature"))})


def shap_by_bin(contributions: DataFrame) -> DataFrame:
    """Mean contribution per quartile bin of the feature value; bins are closed at both ends.

    ``contributions(feature, raw_value, contribution)``. Rows are summed per distinct value before meeting the bins.
    """
    q = _bins_of(contributions)
    per = contributions.groupBy("feature", "raw_value").agg(F.count("*").alias("_n"), F.sum("contribution").alias("_s"))
    rows = per.join(q, "feature").withColumn("_b", F.explode("_bins")).filter(
        (F.col("raw_value") >= F.col("_b.lo")) & (F.col("raw_value") <= F.col("_b.hi")))
    return rows.groupBy("feature", F.col("_b.bin").alias("bin")).agg(
        F.first("_b.lo").alias("lo"), F.first("_b.hi").alias("hi"), F.sum("_n").alias("n"),
        (F.sum("_s") / F.sum("_n")).alias("mean_contribution"))


def _bins_of(contributions: DataFrame) -> DataFrame:
    src = contributions.select(F.col("feature").alias("_f"), "raw_value")
    q = exact_percentiles(src, ["_f"], ["raw_value"], [0.0, 0.25, 0.5, 0.75, 1.0]).groupBy("_f").agg(
        F.sort_array(F.collect_list(F.struct("prob", "value"))).alias("_q"))
    bins = F.array(*[F.struct(F.lit(i + 1).alias("bin"), F.element_at("_q", i + 1)["value"].alias("lo"),
                              F.element_at("_q", i + 2)["value"].alias("hi")) for i in range(4)])
    return q.select(F.col("_f").alias("feature"), bins.alias("_bins"))


def resource_summary(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Average and peak of CPU and memory samples per run, and alerts per second of ``runs(run, alerts, seconds)``."""
    s = samples.groupBy("run").agg(F.count("*").alias("samples"), F.avg("cpu").alias("cpu_avg"),
                                   F.max("cpu").alias("cpu_peak"), F.avg("rss_kb").alias("rss_avg"),
                                   F.max("rss_kb").alias("rss_peak"))
    seconds = F.greatest(F.col("seconds").cast("double"), F.lit(1.0))
    return s.join(runs, "run").select("run", "samples", "cpu_avg", "cpu_peak", (F.col("rss_avg") / 1024).alias("rss_avg_mb"),
                                      (F.col("rss_peak") / 1024).alias("rss_peak_mb"), "alerts",
                                      (F.col("alerts") / seconds).alias("alerts_per_sec"))
