"""Alert ids, label indexes and confusion matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewatch.functions.addresses import flow_id_candidates, is_valid_ip, map_ip, proto_num
from tidewatch.functions.features import ratio

MEASURES = ("accuracy", "precision", "recall", "f1", "fpr")


def rates(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Add ``total`` and the five rates to tp / fp / tn / fn; empty denominators give 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    df = df.withColumn("total", tp + fp + tn + fn)
    df = df.withColumns({
        "accuracy": ratio(tp + tn, "total"), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "fpr": ratio(fp, fp + tn)})
    p, r = F.col("precision"), F.col("recall")
    df = df.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    return df if digits is None else df.withColumns({m: F.round(m, digits) for m in MEASURES})


def usable_alerts(alerts: DataFrame, drop_port_zero: bool = True, drop_unknown_proto: bool = True) -> DataFrame:
    """Alerts that can be matched to flows: valid addresses, non-zero ports, known protocol."""
    out = alerts.withColumn("proto_no", proto_num("proto")).filter(is_valid_ip("src_ip") & is_valid_ip("dst_ip"))
    if drop_port_zero:
        out = out.filter((F.col("src_port") != 0) & (F.col("dst_port") != 0))
    return out.filter("proto_no <> 0") if drop_unknown_proto else out


def alert_flow_ids(alerts: DataFrame, by: Sequence[str] = (), **flags) -> DataFrame:
    """Distinct candidate flow ids of the alerts, optionally per ``by`` columns."""
    five = ["src_ip", "dst_ip", "src_port", "dst_port", "proto_no"]
    tuples = usable_alerts(alerts, **flags).select(*by, *five).distinct()
    return tuples.select(*by, F.explode(flow_id_candidates(*five)).alias("flow_id")).distinct()


def alerted_ips(alerts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return alerts.filter(is_valid_ip("src_ip")).select(*by, map_ip("src_ip").alias("ip")).distinct()


def flow_index(flows: DataFrame, attack: Column | None = None) -> DataFrame:
    """Per flow id: attack rows and benign rows. Empty ids are dropped."""
    hit = (F.col("label") != "BENIGN") if attack is None else attack
    return flows.filter(F.col("flow_id") != "").groupBy("flow_id").agg(
        F.count_if(hit).alias("attack_rows"), F.count_if(~hit).alias("benign_rows"))


def ip_index(flows: DataFrame, attack: Column | None = None) -> DataFrame:
    """Per source address: attack if any of its rows is."""
    hit = (F.col("label") != "BENIGN") if attack is None else attack
    return flows.filter(is_valid_ip("src_ip")).groupBy(F.col("src_ip").alias("ip")).agg(
        F.max(hit.cast("int")).alias("is_attack"))


def _cells(attack: Column, alerted: Column, weight: Column | None = None) -> list[Column]:
    w = F.lit(1) if weight is None else weight
    return [F.coalesce(F.sum(F.when(c, w)), F.lit(0)).cast("bigint").alias(n) for n, c in (
        ("tp", attack & alerted), ("fp", ~attack & alerted), ("tn", ~attack & ~alerted), ("fn", attack & ~alerted))]


def flow_confusion(index: DataFrame, alert_ids: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Row-weighted confusion: a matched id adds its attack rows to TP and its benign rows to FP.

    Both sides are unique per id, so the join cannot be skewed. ``universe(attack_rows, benign_rows)`` replaces the
    totals, e.g. by those of a capture slice; negatives are floored at 0.
    """
    marked = index.join(alert_ids.select("flow_id").distinct().withColumn("_a", F.lit(1)), "flow_id", "left")
    hit = F.col("_a").isNotNull()
    sums = marked.agg(
        F.coalesce(F.sum(F.when(hit, F.col("attack_rows"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("benign_rows"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum("attack_rows"), F.lit(0)).alias("_attack"),
        F.coalesce(F.sum("benign_rows"), F.lit(0)).alias("_benign"))
    if universe is not None:
        def total(c: str) -> Column:
            return universe.agg(F.max(c)).scalar()
        sums = sums.withColumns({"_attack": F.coalesce(total("attack_rows"), F.col("_attack")),
                                 "_benign": F.coalesce(total("benign_rows"), F.col("_benign"))})
    zero = F.lit(0)
    out = sums.select("tp", "fp", F.greatest(F.col("_benign") - F.col("fp"), zero).alias("tn"),
                      F.greatest(F.col("_attack") - F.col("tp"), zero).alias("fn"))
    return rates(out)


def ip_confusion(index: DataFrame, ips: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Set form over labelled addresses; ``universe(attack_ips, benign_ips)`` clips to a slice."""
    marked = index.join(ips.select("ip").distinct().withColumn("_a", F.lit(1)), "ip", "left")
    out = marked.agg(*_cells(F.col("is_attack") == 1, F.col("_a").isNotNull()))
    if universe is not None:
        out = out.withColumns({"_ua": universe.agg(F.max("attack_ips")).scalar(),
                               "_ub": universe.agg(F.max("benign_ips")).scalar()})
        tp, fp = F.least("tp", "_ua"), F.least("fp", "_ub")
        out = out.select(
            tp.alias("tp"), fp.alias("fp"), F.greatest(F.col("_ub") - fp, F.lit(0)).alias("tn"),
            F.greatest(F.col("_ua") - tp, F.lit(0)).alias("fn"))
    return rates(out)


def known_ip_confusion(alerts: DataFrame, known: DataFrame) -> DataFrame:
    """Per day: alerted addresses against ``known(day, ip)``; without a known attacker every alert is false."""
    a = alerts.select("day", "ip").distinct().withColumn("_a", F.lit(True))
    k = known.select("day", "ip").distinct().withColumn("_k", F.lit(True))
    both = a.join(k, ["day", "ip"], "full")
    alerted, listed = F.coalesce("_a", F.lit(False)), F.coalesce("_k", F.lit(False))
    out = both.groupBy("day").agg(F.count_if(alerted & listed).alias("tp"), F.count_if(alerted & ~listed).alias("fp"),
                                  F.count_if(~alerted & listed).alias("fn"))
    out = out.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp")),
                           "recall": ratio("tp", F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def engine_confusion(flows: DataFrame, alerts: DataFrame, digits: int | None = 4) -> DataFrame:
    """All engines at once: flow level for per-flow and community engines, address level for the window engines.

    Flow ids and addresses are one kind of key. Labels are counted once per key, alerts come down to the engines that met a
    key (a handful), and both meet in one join; every key then counts for its engines and for the total of its level.
    ``alerts`` must be enriched (engine, metric_level).
    """
    bad = F.col("label") != "BENIGN"
    keys = F.array(F.struct(F.lit("flow").alias("level"), F.when(F.col("flow_id") != "", F.col("flow_id")).alias("key")),
                   F.struct(F.lit("ip").alias("level"), F.when(is_valid_ip("src_ip"), F.col("src_ip")).alias("key")))
    truth = flows.select(bad.alias("_bad"), F.explode(keys).alias("_k")).select("_bad", "_k.level", "_k.key").filter("key IS NOT NULL")
    truth = truth.groupBy("level", "key").agg(F.count_if("_bad").alias("_attack"), F.count_if(~F.col("_bad")).alias("_benign"))
    address = F.col("level") == "ip"                     # an address counts once, as attack if any of its rows is
    truth = truth.select("level", "key", F.when(address, (F.col("_attack") > 0).cast("bigint")).otherwise(F.col("_attack")).alias("_attack"),
                         F.when(address, (F.col("_attack") == 0).cast("bigint")).otherwise(F.col("_benign")).alias("_benign"))
    ids = usable_alerts(alerts.filter("metric_level = 'flow'")).select("engine", F.lit("flow").alias("level"), F.explode(
        flow_id_candidates("src_ip", "dst_ip", "src_port", "dst_port", "proto_no")).alias("key"))
    addresses = alerts.filter((F.col("metric_level") == "ip") & is_valid_ip("src_ip")).select("engine", F.lit("ip").alias("level"), map_ip("src_ip").alias("key"))
    present = alerts.select("engine", F.col("metric_level").alias("level"), F.lit("").alias("key"))       # engines without a hit
    met = ids.unionByName(addresses).unionByName(present).groupBy("level", "key").agg(F.collect_set("engine").alias("_engines"))
    each = F.array_append(F.coalesce("_engines", F.array().cast("array<string>")), F.lit("*"))
    sums = truth.join(met, ["level", "key"], "full").select("level", "_attack", "_benign", F.explode(each).alias("engine")).groupBy("level", "engine").agg(
        F.coalesce(F.sum("_attack"), F.lit(0)).alias("tp"), F.coalesce(F.sum("_benign"), F.lit(0)).alias("fp"))
    total = lambda c: F.max(F.when(F.col("engine") == "*", F.col(c))).over(W.partitionBy("level"))
    out = sums.withColumns({"_attack": total("tp"), "_benign": total("fp")}).filter("engine <> '*'")
    zero = F.lit(0)
    out = out.select("engine", F.col("level").alias("metric_level"), "tp", "fp", F.greatest(F.col("_benign") - F.col("fp"), zero).alias("tn"),
                     F.greatest(F.col("_attack") - F.col("tp"), zero).alias("fn"))
    return rates(out, digits)


# Fixed: the seven unions of the three alert sets.
COMBINATIONS = {
    "LSTM": ("a",), "XGBoost": ("b",), "Community": ("c",), "ML Ensemble": ("a", "b"),
    "LSTM+Community": ("a", "c"), "XGB+Community": ("b", "c"), "Full Ensemble": ("a", "b", "c"),
}


def ensemble_confusion(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Confusion of every union of three alert sets; ``ids(flow_id, member)`` with member a, b or c.

    One row per flow id carries its three flags; ids with the same flags are added up before the combinations are
    spread out, so eight rows are repeated rather than the table.
    """
    flags = ids.groupBy("flow_id").agg(*[F.max((F.col("member") == m).cast("int")).alias(m) for m in "abc"])
    sums = (index.join(flags, "flow_id", "left").na.fill(0, ["a", "b", "c"]).groupBy("a", "b", "c")
            .agg(F.sum("attack_rows").alias("attack"), F.sum("benign_rows").alias("benign")))
    combos = F.explode(F.array(*[
        F.struct(F.lit(name).alias("combo"), F.greatest(*[F.col(m) for m in members], F.lit(0)).alias("hit"))
        for name, members in COMBINATIONS.items()]))
    rows = sums.withColumn("_c", combos).select("attack", "benign", "_c.combo", "_c.hit")
    h = F.col("hit") == 1
    out = rows.groupBy("combo").agg(*[F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0)).alias(n) for n, c, v in (
        ("tp", h, "attack"), ("fp", h, "benign"), ("tn", ~h, "benign"), ("fn", ~h, "attack"))])
    return rates(out)


def tag_flows(flows: DataFrame, alert_ids: DataFrame) -> DataFrame:
    """``tag`` TP / FP / TN / FN per flow row."""
    hit = alert_ids.select("flow_id").distinct().withColumn("_a", F.lit(1))
    attack, alerted = F.col("label") != "BENIGN", F.col("_a").isNotNull()
    tag = F.when(attack, F.when(alerted, "TP").otherwise("FN")).otherwise(F.when(alerted, "FP").otherwise("TN"))
    return flows.join(hit, "flow_id", "left").withColumn("tag", tag).drop("_a")


def confusion_by(tagged: DataFrame, *groups: str, with_total: bool = False) -> DataFrame:
    """Confusion per group (file, day, category); ``with_total`` adds a row for all with null groups."""
    grouped = tagged.rollup(*groups) if with_total else tagged.groupBy(*groups)
    return rates(grouped.agg(*[F.count_if(F.col("tag") == t).alias(t.lower()) for t in ("TP", "FP", "TN", "FN")]))


def detection_by_label(tagged: DataFrame, *groups: str) -> DataFrame:
    """Detected and total rows per label."""
    return tagged.groupBy(*groups, "label").agg(
        F.count_if(F.col("tag").isin("TP", "FP")).alias("detected"), F.count("*").alias("total")).withColumn(
        "rate", ratio("detected", "total"))


def confusion_by_category(scored: DataFrame, threshold: float, category: str = "category", floor: float = 0.81,
                          strict: bool = False) -> DataFrame:
    """Per category with a pass flag on recall (null where there is no attack)."""
    hit = score_at("score", threshold, strict)
    out = scored.groupBy(category).agg(*_cells(F.col("is_attack") == 1, hit))
    out = rates(out).withColumn("attacks", F.col("tp") + F.col("fn"))
    return out.withColumn("passed", F.when(F.col("attacks") > 0, (F.col("recall") >= floor).cast("int")))


def score_at(score, threshold, strict: bool = True) -> Column:
    """Score over the cut: strict at serving, inclusive in evaluation scripts."""
    s = score if isinstance(score, Column) else F.col(score)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return s > t if strict else s >= t


def evaluate_model(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Confusion of predictions plus precision, recall and f1 of the benign class."""
    out = rates(predictions.agg(*_cells(F.col(label) == 1, F.col(prediction) == 1)))
    out = out.withColumns({"benign_precision": ratio("tn", F.col("tn") + F.col("fn")),
                           "benign_recall": ratio("tn", F.col("tn") + F.col("fp"))})
    p, r = F.col("benign_precision"), F.col("benign_recall")
    return out.withColumn("benign_f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def master_table(tables: dict[str, DataFrame], order: Sequence[str] = ("model", "day")) -> DataFrame:
    """Confusion rows of several models in one table; measures a model lacks are null."""
    out = None
    for model, df in tables.items():
        df = df.withColumn("model", F.lit(model))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.orderBy(*order)
