"""Scalers, detectors, anomaly scores, attributions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window, functions as F

from tidewatch.models import boosting as B, explain as E, iforest as IF, isotonic as ISO, scaler as SC, trees as TR
from tidewatch.operators.sampling import row_cap
from tidewatch.operators.sweeps import roc_auc
from tidewatch.plans import q_common as C
from tidewatch.plans.boost_sql import boosting_sql
from tidewatch.plans.registry import query
from tidewatch.session import cut_lineage

FOUR = ["dur", "sbytes", "dpkts", "swin"]
SCALER_SQL = """, b AS (SELECT ln(1 + dur) AS dur, ln(1 + sbytes) AS sbytes, dpkts, swin, 1.0 AS flat FROM flows WHERE label = 'BENIGN'),
l AS (""" + C.long_sql("b", "", FOUR + ["flat"]) + """),
scaler AS (SELECT feature, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM l GROUP BY feature)"""


def _scaler(spark, sf):
    f = C.flows(spark, sf).withColumn("flat", F.lit(1.0))
    return f, SC.fit_robust_scaler(f, FOUR + ["flat"], ["dur", "sbytes"], F.col("label") == "BENIGN")


@query("fit_robust_scaler", "feature median:d iqr:d", SCALER_SQL + "\n--result\nSELECT * FROM scaler", "flows")
def fit_robust_scaler(spark, sf):
    return _scaler(spark, sf)[1]


H = "md5(concat_ws('|', '42', row_key))"


@query("fit_robust_scaler_capped", "feature median:d iqr:d", f""", b AS (SELECT dur, sbytes FROM flows WHERE label = 'BENIGN' QUALIFY row_number() OVER (ORDER BY {H}) <= 10000)
--result
SELECT feature, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM ({C.long_sql("b", "", ["dur", "sbytes"])}) GROUP BY feature""", "flows")
def fit_robust_scaler_capped(spark, sf):
    """A scaler of a capped table: the cap is the sampling operator's, not the scaler's."""
    return SC.fit_robust_scaler(row_cap(C.flows(spark, sf).filter("label = 'BENIGN'"), 10000), ["dur", "sbytes"])


def _p(f, what):
    return f"(SELECT {what} FROM scaler WHERE feature = '{f}')"


SCALED = ", ".join(f"({e} - {_p(f, 'median')}) / {_p(f, 'iqr')} AS {f}" for f, e in (
    ("dur", "ln(1 + dur)"), ("sbytes", "ln(1 + sbytes)"), ("dpkts", "dpkts"), ("swin", "swin")))


@query("robust_scale", "row_key dur:d sbytes:d dpkts:d swin:d flat:d", SCALER_SQL + f"\n--result\nSELECT row_key, {SCALED}, 0 AS flat FROM flows", "flows")
def robust_scale(spark, sf):
    f, s = _scaler(spark, sf)
    return SC.apply_scaler(f, s)


@query("robust_scale_unit", "row_key dur:d sbytes:d dpkts:d swin:d flat:d", SCALER_SQL + f"\n--result\nSELECT row_key, {SCALED}, 0 AS flat FROM flows", "flows")
def robust_scale_unit(spark, sf):
    """A zero range divides by one: the constant column is 0 because it equals its median."""
    f, s = _scaler(spark, sf)
    return SC.apply_scaler(f, s, "one")


@query("inverse_scale", "row_key dur:d sbytes:d4 dpkts:d swin:d4", "SELECT row_key, dur, sbytes, dpkts, swin FROM flows", "flows")
def inverse_scale(spark, sf):
    f, s = _scaler(spark, sf)
    return SC.inverse_scale(SC.apply_scaler(f, s), s, undo_log=True)


# A fixed three-tree ensemble over four flow columns: tree, node, left, right, feature, threshold, value, cover.
ENSEMBLE_ROWS = [
    (0, 0, 1, 2, 0, 60000.0, 0.0, 100.0), (0, 1, -1, -1, -1, 0.0, -0.4, 40.0), (0, 2, 3, 4, 1, 40000.0, 0.0, 60.0),
    (0, 3, -1, -1, -1, 0.0, 0.1, 35.0), (0, 4, -1, -1, -1, 0.0, 0.7, 25.0),
    (1, 0, 1, 2, 2, 3.0, 0.0, 100.0), (1, 1, -1, -1, -1, 0.0, 0.3, 43.0), (1, 2, 3, 4, 3, 15000.0, 0.0, 57.0),
    (1, 3, -1, -1, -1, 0.0, -0.2, 30.0), (1, 4, -1, -1, -1, 0.0, 0.25, 27.0),
    (2, 0, 1, 2, 1, 20000.0, 0.0, 100.0), (2, 1, 3, 4, 0, 20000.0, 0.0, 30.0), (2, 2, -1, -1, -1, 0.0, 0.05, 70.0),
    (2, 3, -1, -1, -1, 0.0, -0.6, 20.0), (2, 4, -1, -1, -1, 0.0, 0.15, 10.0)]


def fixed_ensemble() -> TR.Ensemble:
    cols = [c.split()[0] for c in TR.NODE.split(", ")]
    return TR.Ensemble(tuple(FOUR), pd.DataFrame(ENSEMBLE_ROWS, columns=cols), base=-0.1, scale=1.0, strict=True)


TREES_SQL = """1.0 / (1.0 + exp(-(-0.1 + CASE WHEN dur < 60000 THEN -0.4 WHEN sbytes < 40000 THEN 0.1 ELSE 0.7 END
  + CASE WHEN dpkts < 3 THEN 0.3 WHEN swin < 15000 THEN -0.2 ELSE 0.25 END
  + CASE WHEN sbytes >= 20000 THEN 0.05 WHEN dur < 20000 THEN -0.6 ELSE 0.15 END)))"""


@query("score_trees", "row_key score:d", f"SELECT row_key, {TREES_SQL} AS score FROM flows", "flows")
def score_trees(spark, sf):
    return TR.score_trees(C.flows(spark, sf), fixed_ensemble(), form="expression")


@query("score_trees_batches", "row_key score:d", f"SELECT row_key, {TREES_SQL} AS score FROM flows", "flows")
def score_trees_batches(spark, sf):
    """The form for ensembles of any size."""
    return TR.score_trees(C.flows(spark, sf), fixed_ensemble())


def _labelled(spark, sf):
    return C.feature_frame(spark, sf, "row_key", "src_ip", "day", "score", "label").withColumn(
        "is_attack", (F.col("label") != "BENIGN").cast("int"))


def _area(scored, column, label="is_attack"):
    """Area under the curve as a scalar of the same plan."""
    return roc_auc(scored, column, label).select("auc").scalar()


@query("train_detector", "row_key in_range:i better_than_chance:i", "SELECT row_key, 1 AS in_range, 1 AS better_than_chance FROM flows", "flows")
def train_detector(spark, sf):
    """Every flow scored by the fitted model. What SQL can hold the fit to: probabilities, and an area above 0.6."""
    df = _labelled(spark, sf)
    from tidewatch.operators.sampling import with_class_weight
    model = TR.train_detector(with_class_weight(df), C.ELEVEN, weight="weight")
    scored = cut_lineage(TR.score_model(model, df, "p").select("row_key", "is_attack", "p"))
    return scored.withColumns({"in_range": F.col("p").between(0, 1).cast("int"), "better_than_chance": (_area(scored, "p") > 0.6).cast("int")})


@query("train_detector_two_sources", "row_key in_range:i fits_second:i", "SELECT row_key, 1 AS in_range, 1 AS fits_second FROM flows", "flows")
def train_detector_two_sources(spark, sf):
    """150 rounds on the other days, then 150 smaller ones on Wednesday from the margins of the first part. Held to: probabilities,
    and a larger area than the first part's on the rows of the second corpus."""
    df = _labelled(spark, sf)
    wed = F.col("day") == "Wednesday"
    first, second = B.train_two_sources(df.filter(~wed), df.filter(wed), C.ELEVEN, params=B.Boosting(rows=0.8), more=B.Boosting(step=0.02, l2=1.5, rows=0.8),
                                        row_id=["row_key"])
    scored = TR.score_trees(TR.score_trees(df, first, "p_base"), second, "p").select("row_key", "day", "is_attack", "p_base", "p")
    scored = cut_lineage(scored)
    own = scored.filter(wed)
    return scored.withColumns({"in_range": (F.col("p").between(0, 1) & F.col("p_base").between(0, 1)).cast("int"),
                               "fits_second": (_area(own, "p") > _area(own, "p_base")).cast("int")})


MARGIN_SQL = """-0.1 + CASE WHEN dur < 60000 THEN -0.4 WHEN sbytes < 40000 THEN 0.1 ELSE 0.7 END
  + CASE WHEN dpkts < 3 THEN 0.3 WHEN swin < 15000 THEN -0.2 ELSE 0.25 END
  + CASE WHEN sbytes >= 20000 THEN 0.05 WHEN dur < 20000 THEN -0.6 ELSE 0.15 END"""


def _attacks(spark, sf):
    return C.flows(spark, sf).withColumn("is_attack", (F.col("label") != "BENIGN").cast("int"))


@query("continued_no_round", "row_key margin:d9", f"SELECT row_key, {MARGIN_SQL} AS margin FROM flows", "flows")
def continued_no_round(spark, sf):
    """No further round leaves the margins of the first model."""
    f = _attacks(spark, sf)
    same, = B.fit(f, FOUR, params=B.Boosting(rounds=0), start=fixed_ensemble())
    return f.withColumn("margin", TR.tree_margin(f, same))


@query("continued_round", "row_key margin:d", ", " + boosting_sql("flows", FOUR, MARGIN_SQL, 1, 3, 16, 0.1, 1.0) + "\n--result\nSELECT row_key, m AS margin FROM boosted", "flows")
def continued_round(spark, sf):
    """One round of depth 3 from the margins of the fixed ensemble, on four features."""
    f = _attacks(spark, sf)
    more, = B.fit(f, FOUR, params=B.Boosting(rounds=1, depth=3), start=fixed_ensemble(), bins=16)
    return f.withColumn("margin", TR.tree_margin(f, more))


@query("feature_importance", "feature share_ok:i total:d ranked:i", f"SELECT unnest({C.ELEVEN}) AS feature, 1 AS share_ok, 1.0 AS total, 1 AS ranked FROM (SELECT count(*) AS n FROM flows) WHERE n > 0", "flows")
def feature_importance(spark, sf):
    """Importances of a fitted model: shares that sum to 1, ranked without gaps by size."""
    found = TR.feature_importance(TR.train_detector(_labelled(spark, sf), C.ELEVEN), spark)
    every, by_size = Window.partitionBy(), Window.orderBy(F.desc("importance"), "feature")           # one row per feature
    return found.select("feature", F.col("importance").between(0, 1).cast("int").alias("share_ok"), F.sum("importance").over(every).alias("total"),
                        (F.row_number().over(by_size) == F.col("rank")).cast("int").alias("ranked"))


def _days(df):
    return [r["day"] for r in df.select("day").distinct().orderBy("day").collect()]


@query("leave_one_day_out", "day addresses:i attackers:i rates_ok:i", """SELECT day, count(*) AS addresses, sum(bad) AS attackers, 1 AS rates_ok FROM (
  SELECT day, src_ip, max(CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END) AS bad FROM flows GROUP BY ALL) GROUP BY day""", "flows")
def leave_one_day_out(spark, sf):
    """150 rounds, all features, seven models. SQL holds the addresses and attackers of each confusion and its rates; the twin of the
    whole confusion is that of ``leave_one_day_out_short``."""
    df = _labelled(spark, sf)
    out = B.leave_one_day_out(df, C.ELEVEN, _days(df), params=B.Boosting(rows=0.8), row_id=["row_key"])
    ok = (F.abs(F.col("recall") * (F.col("tp") + F.col("fn")) - F.col("tp")) < 1e-6) & (F.abs(F.col("fpr") * (F.col("fp") + F.col("tn")) - F.col("fp")) < 1e-6)
    return out.select("day", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("addresses"), (F.col("tp") + F.col("fn")).alias("attackers"),
                      ok.cast("int").alias("rates_ok"))


@query("leave_one_day_out_short", "day tp:i fp:i tn:i fn:i recall:d precision:d fpr:d", ", " + boosting_sql("flows", FOUR, "0.0", 3, 2, 16, 0.5, 1.0, "day") + f"""
, per AS (SELECT j AS day, src_ip, max(1.0 / (1.0 + exp(-m))) AS s, max(y) AS y FROM boosted WHERE NOT train GROUP BY ALL),
c AS (SELECT day, count(*) FILTER (WHERE y = 1 AND s > 0.3) AS tp, count(*) FILTER (WHERE y = 0 AND s > 0.3) AS fp, count(*) FILTER (WHERE y = 0 AND s <= 0.3) AS tn,
  count(*) FILTER (WHERE y = 1 AND s <= 0.3) AS fn FROM per GROUP BY day)
--result
SELECT day, tp, fp, tn, fn, {C.RATES_SQL} FROM c""", "flows")
def leave_one_day_out_short(spark, sf):
    """Three rounds of depth 2 on four features: few enough for a SQL twin of all models."""
    f = _attacks(spark, sf)
    return B.leave_one_day_out(f, FOUR, _days(f), params=B.Boosting(rounds=3, depth=2, step=0.5), bins=16)


@query("calibrate_isotonic", "row_key score:d calibrated:d", """, d AS (SELECT score AS s, CAST(sum(CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END) AS DOUBLE) AS y, count(*) AS n FROM flows GROUP BY score),
c AS (SELECT s, sum(y) OVER (ORDER BY s) AS cy, sum(n) OVER (ORDER BY s) AS cn, sum(y) OVER (ORDER BY s) - y AS by, sum(n) OVER (ORDER BY s) - n AS bn FROM d),
low AS (SELECT a.s AS a, x.s AS x, min((b.cy - a.by) / (b.cn - a.bn)) AS v FROM c a JOIN c x ON a.s <= x.s JOIN c b ON b.s >= x.s GROUP BY ALL),
iso AS (SELECT x, max(v) AS v FROM low GROUP BY x)
--result
SELECT row_key, score, v AS calibrated FROM flows JOIN iso ON x = score""", "flows")
def calibrate_isotonic(spark, sf):
    """The monotone fit at x is the greatest, over the starts up to x, of the least mean over the ends from x on."""
    return ISO.calibrate_isotonic(_labelled(spark, sf))


@query("isotonic_blocks", "lo:d hi:d value:d n:i", """, d AS (SELECT spkts AS s, CAST(sum(CASE WHEN label <> 'BENIGN' THEN 1 ELSE 0 END) AS DOUBLE) AS y, count(*) AS n FROM flows GROUP BY spkts),
c AS (SELECT s, n, sum(y) OVER (ORDER BY s) AS cy, sum(n) OVER (ORDER BY s) AS cn, sum(y) OVER (ORDER BY s) - y AS by, sum(n) OVER (ORDER BY s) - n AS bn FROM d),
low AS (SELECT a.s AS a, x.s AS x, x.n AS n, min((b.cy - a.by) / (b.cn - a.bn)) AS v FROM c a JOIN c x ON a.s <= x.s JOIN c b ON b.s >= x.s GROUP BY ALL),
iso AS (SELECT x, any_value(n) AS n, max(v) AS v FROM low GROUP BY x)
--result
SELECT min(x) AS lo, max(x) AS hi, v AS value, sum(n) AS n FROM iso GROUP BY v""", "flows")
def isotonic_blocks(spark, sf):
    """Pooled blocks over the packet counts; seven ranges pool side by side."""
    return ISO.fit_isotonic(_labelled(spark, sf), "spkts", ranges=7)


def _game_sql(tree: int, known: frozenset, node: int = 0) -> str:
    """Value of a coalition: features outside it follow both branches by their training share."""
    rows = {r[1]: r for r in ENSEMBLE_ROWS if r[0] == tree}
    _, _, left, right, f, cut, value, cover = rows[node]
    if f < 0:
        return repr(value)
    a, b = _game_sql(tree, known, left), _game_sql(tree, known, right)
    return f"(CASE WHEN {FOUR[f]} < {cut} THEN {a} ELSE {b} END)" if FOUR[f] in known else f"(({a} * {rows[left][7]} + {b} * {rows[right][7]}) / {cover})"


def _shapley_sql(tree: int) -> dict[str, str]:
    """Half the gain over nobody and half the gain over the other feature; every tree has two."""
    a, b = sorted({FOUR[r[4]] for r in ENSEMBLE_ROWS if r[0] == tree and r[4] >= 0})
    v = lambda *known: _game_sql(tree, frozenset(known))
    return {x: f"0.5 * ({v(x)} - {v()} + {v(a, b)} - {v(y)})" for x, y in ((a, b), (b, a))}


_PHI = [_shapley_sql(t) for t in range(3)]
PHI_SQL = " UNION ALL ".join(f"SELECT row_key, '{f}' AS feature, CAST({' + '.join(p[f] for p in _PHI if f in p)} AS DOUBLE) AS contribution FROM flows WHERE alerted" for f in FOUR)


@query("explain_trees", "row_key feature contribution:d", PHI_SQL, "flows")
def explain_trees(spark, sf):
    f = C.flows(spark, sf).filter("alerted").select("row_key", *FOUR)
    return E.explain_trees(f, fixed_ensemble(), ["row_key"])


@query("explain_fitted", "row_key off:d9", "SELECT row_key, 0.0 AS off FROM flows WHERE alerted", "flows")
def explain_fitted(spark, sf):
    """A fitted model of 150 trees of depth 4: contributions and base value give back the margin of every alert."""
    f = _labelled(spark, sf)
    ens, = B.fit(f, C.ELEVEN, params=B.Boosting(rows=0.8), row_id=["row_key"])
    alerts = f.join(C.flows(spark, sf).filter("alerted").select("row_key").distinct(), "row_key", "left_semi")
    alerts = alerts.withColumn("margin", TR.tree_margin(alerts, ens)).withColumn("_n", F.monotonically_increasing_id())
    sums = E.explain_trees(alerts, ens, ["row_key", "_n", "margin"]).groupBy("row_key", "_n", "margin").agg(F.sum("contribution").alias("c"))
    return sums.select("row_key", F.abs(F.round(F.col("c") + F.lit(E.base_value(ens)) - F.col("margin"), 7)).alias("off"))


@query("explain_sums_to_margin", "row_key margin:d", """SELECT row_key, -0.1 + CASE WHEN dur < 60000 THEN -0.4 WHEN sbytes < 40000 THEN 0.1 ELSE 0.7 END
  + CASE WHEN dpkts < 3 THEN 0.3 WHEN swin < 15000 THEN -0.2 ELSE 0.25 END
  + CASE WHEN sbytes >= 20000 THEN 0.05 WHEN dur < 20000 THEN -0.6 ELSE 0.15 END AS margin FROM flows WHERE alerted""", "flows")
def explain_sums_to_margin(spark, sf):
    """Contributions plus the base value give back the margin of every alert."""
    ens = fixed_ensemble()
    c = E.explain_trees(C.flows(spark, sf).filter("alerted").select("row_key", *FOUR), ens, ["row_key"])
    return c.groupBy("row_key").agg((F.sum("contribution") + F.lit(E.base_value(ens))).alias("margin"))


def _forest(spark, sf):
    return IF.train_anomaly_detector(C.feature_frame(spark, sf, "row_key", "label"), FOUR, F.col("label") == "BENIGN")


@query("fit_isolation_forest", "property ok:i", "SELECT unnest(['thresholds in order', 'false alarms near the threshold', 'recall is a share', '200 trees']) AS property, 1 AS ok FROM (SELECT count(*) AS n FROM flows) WHERE n > 0", "flows")
def fit_isolation_forest(spark, sf):
    """What must hold of a fitted forest: -1 < p1 <= p4 <= p5 <= p10 < 0, about 5 % of foreign benign rows flagged, all trees there."""
    forest = _forest(spark, sf)
    m = forest.meta
    cuts = [m[f"threshold_p{k}"] for k in (1, 4, 5, 10)]
    checks = {"thresholds in order": -1 < cuts[0] and cuts == sorted(cuts) and cuts[-1] < 0, "false alarms near the threshold": 0 <= m["val_benign_fpr"] <= 0.1,
              "recall is a share": 0 <= m["attack_recall"] <= 1, "200 trees": forest.nodes["tree"].nunique() == 200}
    return spark.createDataFrame([(k, int(v)) for k, v in checks.items()], "property string, ok int")


@query("score_isolation_forest", "row_key in_range:i label_ok:i", "SELECT row_key, 1 AS in_range, 1 AS label_ok FROM flows", "flows")
def score_isolation_forest(spark, sf):
    """Every flow scored; the label follows the threshold."""
    forest = _forest(spark, sf)
    s = IF.score_isolation_forest(C.feature_frame(spark, sf, "row_key"), forest)
    odd = F.col("if_score") < forest.threshold
    return s.select("row_key", ((F.col("if_score") > -1) & (F.col("if_score") < 0)).cast("int").alias("in_range"),
                    (odd == (F.col("if_label") == "anomaly_candidate")).cast("int").alias("label_ok"))


@query("anomaly_fpr", "day n:i rate_ok:i", "SELECT day, count(*) AS n, 1 AS rate_ok FROM flows WHERE label = 'BENIGN' GROUP BY day", "flows")
def anomaly_fpr(spark, sf):
    """Benign flows of each day flagged: the threshold lets about one in twenty through."""
    f = C.feature_frame(spark, sf, "row_key", "label", "day").filter("label = 'BENIGN'")
    return IF.anomaly_fpr(f, _forest(spark, sf), ["day"]).withColumn("rate_ok", F.col("anomaly_rate").between(0, 0.2).cast("int"))
