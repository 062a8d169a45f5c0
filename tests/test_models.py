"""Models and attributions against brute force."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.models import boosting as B, explain as E, iforest as IF, scaler as SC, trees as TR
from tidewatch.plans import q_common as C, q_models as Q
from tidewatch.plans.q_models import FOUR, fixed_ensemble


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] + x[:, 1] * x[:, 2]) > 0.2).astype(int)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, row_key=[f"r{i}" for i in range(400)])
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def model(data):
    return TR.train_detector(data, ["a", "b", "c"], "y", depth=3, rounds=4)


def test_node_table_scores_like_the_model(data, model):
    ens = TR.from_gbt(model)
    want = TR.score_model(model, data, "p")
    for form in ("expression", "batches"):
        got = TR.score_trees(want, ens, "q", form=form)
        assert got.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9


def _expected(nodes, x, known, features, at=0):
    r = nodes.loc[at]
    if r.feature < 0:
        return r.value
    f = features[int(r.feature)]
    if f in known:
        go = r.left if x[f] <= r.threshold else r.right
        return _expected(nodes, x, known, features, int(go))
    a, b = nodes.loc[int(r.left)], nodes.loc[int(r.right)]
    return (a.cover * _expected(nodes, x, known, features, int(r.left)) + b.cover * _expected(nodes, x, known, features, int(r.right))) / r.cover


def test_contributions_are_shapley_values(data, model):
    """All coalitions of the path-dependent game, on a few rows; and the sum gives the margin."""
    ens = TR.from_gbt(model)
    few = data.limit(6).toPandas()
    got = E.explain_trees(data.filter(F.col("row_key").isin(list(few.row_key))), ens, ["row_key"]).toPandas()
    feats = list(ens.features)
    trees = [n.set_index("node") for _, n in ens.nodes.groupby("tree")]
    for x in few.itertuples():
        x = x._asdict()
        def v(s):
            return sum(_expected(t, x, s, feats) for t in trees)
        for f in feats:
            rest = [g for g in feats if g != f]
            phi = sum(factorial(k) * factorial(2 - k) / 6 * (v({*s, f}) - v(set(s))) for k in range(3) for s in combinations(rest, k))
            mine = got[(got.row_key == x["row_key"]) & (got.feature == f)].contribution.iloc[0]
            assert mine == pytest.approx(phi, abs=1e-9)
        total = got[got.row_key == x["row_key"]].contribution.sum()
        assert total + E.base_value(ens) == pytest.approx(v(set(feats)), abs=1e-9)


def test_top_contributions_direction(spark):
    ens = fixed_ensemble()
    df = spark.createDataFrame([("r", 1000.0, 50000.0, 1.0, 20000.0)], "row_key string, " + ", ".join(f"{c} double" for c in FOUR))
    top = E.top_contributions(E.explain_trees(df, ens, ["row_key"]), ["row_key"], 2).orderBy("rank").collect()
    assert abs(top[0].contribution) >= abs(top[1].contribution)
    assert all((r.direction == "attack") == (r.contribution > 0) for r in top)


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(600, 2)), columns=["u", "v"]).assign(row_key=[f"r{i}" for i in range(600)], bad=0)
    odd = pd.DataFrame([[9.0, 9.0], [-8.0, 7.0]], columns=["u", "v"]).assign(row_key=["o1", "o2"], bad=1)
    df = spark.createDataFrame(pd.concat([pdf, odd]))
    f = IF.train_anomaly_detector(df, ["u", "v"], F.col("bad") == 0, trees=60, sample=128)
    s = IF.score_isolation_forest(df, f)
    assert {r.row_key for r in s.orderBy("if_score").limit(2).collect()} == {"o1", "o2"}
    assert f.meta["attack_recall"] == 1.0 and f.meta["val_benign_fpr"] < 0.2
    assert f.nodes.groupby("tree").size().max() <= 2 * 128 and f.nodes.tree.nunique() == 60
    again = IF.fit_isolation_forest(df.filter("bad = 0").repartition(5), ["u", "v"], trees=60, sample=128)
    first = IF.fit_isolation_forest(df.filter("bad = 0"), ["u", "v"], trees=60, sample=128)
    key = ["tree", "node"]
    assert again.nodes.sort_values(key).reset_index(drop=True).equals(first.nodes.sort_values(key).reset_index(drop=True))


def test_forest_walks_give_the_lengths_of_the_node_table():
    """Blocks walked down a full tree find the leaves of a plain walk; NaN goes right."""
    rng, depth = np.random.default_rng(3), 5
    x = rng.normal(size=(500, 3))
    x[3, 1], x[4, :] = np.nan, np.nan
    grown = [pd.DataFrame(IF._grow(rng.normal(size=(32, 3)), depth, rng), columns=["node", "left", "right", "feature", "threshold", "length"]) for _ in range(4)]

    def length(n, row):
        at = 0
        while n.feature[at] >= 0:
            at = n.left[at] if row[n.feature[at]] <= n.threshold[at] else n.right[at]
        return n.length[at]

    got = IF._path_lengths([IF._full_tree(n, depth) for n in grown], x, depth)
    assert got.tolist() == [sum(length(n, row) for n in grown) for row in x]
    alone = pd.DataFrame([(0, -1, -1, -1, 0.0, 1.5)], columns=["node", "left", "right", "feature", "threshold", "length"])
    assert IF._path_lengths([IF._full_tree(alone, 0)], x, 0).tolist() == [1.5] * 500


def test_top_contributions_shuffle_keys_once(spark, sf):
    """One short row per flow is shuffled; features are spread out and ranked where the key lies."""
    from tidewatch.plans import q_eval
    plan = q_eval.top_contributions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate explode") < plan.index("Exchange")


def test_mean_path_length():
    assert IF.mean_path([1, 2]).tolist() == [0.0, 1.0]
    assert float(IF.mean_path(256)) == pytest.approx(10.2447709, abs=1e-6)


def test_scaler_round_trip_and_sidecar(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 7.0, f"k{i}") for i in range(1, 102)], "a double, flat double, row_key string")
    s = SC.fit_robust_scaler(df, ["a", "flat"], ["a"])
    p, logged = SC.scaler_params(s)
    assert p["flat"] == (7.0, 0.0) and logged == ["a"] and p["a"][0] == pytest.approx(np.log(52))
    back = SC.inverse_scale(SC.apply_scaler(df, s), s, undo_log=True)
    assert back.join(df.select("row_key", F.col("a").alias("o")), "row_key").agg(F.max(F.abs(F.col("a") - F.col("o")))).first()[0] < 1e-9
    assert SC.scaler_params(SC.fit_robust_scaler(df, ["flat"], unit_iqr=True))[0]["flat"] == (7.0, 1.0)
    side = tmp_path / "m_scaler.json"
    side.write_text('{"median": [1.0, 2.0], "iqr": [3.0, 0.0], "log1p_indices": [1], "feature_names": ["x", "y"]}')
    rows = SC.read_scaler_json(spark, str(side)).orderBy("idx").collect()
    assert [(r.feature, r.log1p, r["median"], r.iqr) for r in rows] == [("x", False, 1.0, 3.0), ("y", True, 2.0, 0.0)]
    merged = SC.merge_and_refit(SC.apply_scaler(df, s), s, df, ["a", "flat"])
    assert SC.scaler_params(merged)[0]["a"][0] == pytest.approx(np.log(52))


def test_imported_model(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"learner": {"learner_model_param": {"base_score": "5E-1"}, "gradient_booster": {"model": {"trees": [{"left_children": [1, -1, -1],'
                    '"right_children": [2, -1, -1], "split_indices": [1, 0, 0], "split_conditions": [3.0, -0.5, 0.5], "sum_hessian": [10, 4, 6]}]}}}}')
    ens = TR.read_boosted_trees(spark, str(path), ["x", "y"])
    df = spark.createDataFrame([(0.0, 3.0), (0.0, 2.9)], "x double, y double")
    got = [r.score for r in TR.score_trees(df, ens).orderBy("y").collect()]
    assert got == pytest.approx([1 / (1 + np.exp(0.5)), 1 / (1 + np.exp(-0.5))])


def test_every_day_is_left_out_once(spark, sf, monkeypatch):
    """The query fits the operator's default size on all features, one model per day of the table in one fit."""
    fit, asked = B.fit, []

    def small(df, features, label, weight, params, **kw):
        asked.append((list(features), params.rounds, params.depth, list(kw["folds"])))
        return fit(df, features, label, weight, B.Boosting(rounds=1, depth=2), **kw)

    monkeypatch.setattr(B, "fit", small)
    got = {r.day: r.addresses for r in Q.leave_one_day_out(spark, sf).collect()}
    days = sorted(r.day for r in C.flows(spark, sf).select("day").distinct().collect())
    assert sorted(got) == days and len(days) == 7
    assert got == {r.day: r.n for r in C.flows(spark, sf).groupBy("day").agg(F.countDistinct("src_ip").alias("n")).collect()}
    assert asked == [(C.ELEVEN, 150, 4, days)]


@pytest.mark.parametrize("name", ["train_detector", "feature_importance"])
def test_detectors_are_fitted_at_the_default_size(spark, sf, monkeypatch, name):
    class Asked(Exception):
        pass

    def fit(self, df):
        gbt = self.getStages()[-1]
        raise Asked((gbt.getMaxIter(), gbt.getMaxDepth(), self.getStages()[0].getInputCols()))

    monkeypatch.setattr(TR.Pipeline, "fit", fit)
    with pytest.raises(Asked) as e:
        getattr(Q, name)(spark, sf)
    assert e.value.args[0] == (150, 4, C.ELEVEN)


def test_both_parts_of_a_continued_fit_have_the_default_size(spark, sf, monkeypatch):
    asked = []

    def fit(df, features, label, weight, params, start=None, **kw):
        asked.append((params.rounds, params.depth, list(features), start is not None))
        return [fixed_ensemble()]

    monkeypatch.setattr(B, "fit", fit)
    Q.train_detector_two_sources(spark, sf)
    assert asked == [(150, 4, C.ELEVEN, False), (150, 4, C.ELEVEN, True)]


@pytest.mark.parametrize("name", ["score_isolation_forest", "anomaly_fpr", "fit_isolation_forest"])
def test_forests_have_the_default_size(spark, sf, monkeypatch, name):
    class Asked(Exception):
        pass

    def fit(df, features, trees=200, *rest):
        raise Asked(trees)

    monkeypatch.setattr(IF, "fit_isolation_forest", fit)
    with pytest.raises(Asked) as e:
        getattr(Q, name)(spark, sf)
    assert e.value.args[0] == 200


def test_detector_rows_are_dealt_over_the_cores(spark, sf, monkeypatch):
    """A file of one row group is one task; every level of every round would run in it."""
    class Asked(Exception):
        pass

    def fit(self, df):
        raise Asked([len(p) for p in df.rdd.glom().collect()], df.columns)

    df = C.flows(spark, sf).withColumn("is_attack", (F.col("label") != "BENIGN").cast("int"))
    monkeypatch.setattr(TR.Pipeline, "fit", fit)
    with pytest.raises(Asked) as e:
        TR.train_detector(df, ["dur", "sbytes"])
    parts, columns = e.value.args
    assert columns == ["dur", "sbytes", "is_attack"] and sum(parts) == df.count()
    assert len(parts) == spark.sparkContext.defaultParallelism and max(parts) <= 2 * min(parts)


@pytest.mark.parametrize("strict", [True, False])
def test_walks_visit_the_features_of_a_block_at_a_time(monkeypatch, strict):
    """Rows walk down uneven trees in blocks, also trees of a single leaf; NaN goes right and leaves stay where they are."""
    rows = [(0, 0, 1, 2, 0, 0.5, 0.0, 9.0), (0, 1, -1, -1, -1, 0.0, 1.0, 4.0), (0, 2, 5, 6, 1, 0.0, 0.0, 5.0), (0, 5, -1, -1, -1, 0.0, 2.0, 3.0), (0, 6, 13, 14, 0, 1.0, 0.0, 2.0),
            (0, 13, -1, -1, -1, 0.0, 4.0, 1.0), (0, 14, -1, -1, -1, 0.0, 8.0, 1.0), (1, 0, -1, -1, -1, 0.0, 0.25, 9.0)]
    ens = TR.Ensemble(("u", "v"), pd.DataFrame(rows, columns=[c.split()[0] for c in TR.NODE.split(", ")]), 0.0, 1.0, strict)
    monkeypatch.setattr(TR, "WALK", 7, raising=False)
    widths, leaf_of = [], TR.leaf_of
    monkeypatch.setattr(TR, "leaf_of", lambda t, x, strict: widths.append(x.shape) or leaf_of(t, x, strict))
    x = np.random.default_rng(4).normal(size=(40, 2)).round(1)
    x[:3], x[3] = [[0.5, 0.0], [1.0, 0.1], [np.nan, np.nan]], [0.2, np.nan]
    goes = lambda v, cut: v < cut if strict else v <= cut
    want = [1.0 if goes(u, 0.5) else 2.0 if goes(v, 0.0) else 4.0 if goes(u, 1.0) else 8.0 for u, v in x]
    assert TR.margins(TR.pack(ens), 0.5, x, strict).tolist() == [0.75 + v for v in want]
    assert {w[0] for w in widths} == {2} and max(w[1] for w in widths) == 7


@pytest.mark.parametrize("weight", [None, "weight"])
def test_histogram_fit_grows_the_trees_of_sparks_own_fit(spark, weight):
    """With few values per feature both have the same candidates: same scores, same importances, and a model that can be saved."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, size=(3000, 3)).astype(float)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] / 4) > rng.normal(9, 2, size=3000)).astype(int)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, weight=rng.choice([0.5, 1.0, 3.0], 3000), k=np.arange(3000)))
    ours = TR.train_detector(df, ["a", "b", "c"], "y", weight, depth=3, rounds=5, subsample=1.0)
    assert ours.stages[-1].getNumTrees == 5 and ours.stages[-1].treeWeights == [1.0] + 4 * [0.1]
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    own = GBTClassifier(featuresCol="features", labelCol="y", maxDepth=3, maxIter=5, stepSize=0.1, seed=42, **({"weightCol": weight} if weight else {})).fit(rows)
    p = lambda d: np.array([r.probability[1] for r in d.orderBy("k").collect()])
    assert np.abs(p(own.transform(rows)) - p(ours.stages[-1].transform(rows))).max() < 1e-4
    assert np.abs(own.featureImportances.toArray() - ours.stages[-1].featureImportances.toArray()).max() < 1e-4
    assert TR.from_gbt(ours).nodes["tree"].nunique() == 5
    with pytest.raises(Exception, match="labels of a boosted"):
        TR.train_detector(df.withColumn("y", F.col("y") + 1), ["a", "b", "c"], "y", rounds=1)


def test_detector_passes_are_those_of_histogram_boosting(data, monkeypatch):
    """The fit goes through the chunks of ``boosting``; options it has not are Spark's own."""
    made, write = [], B.Rows._write
    monkeypatch.setattr(B.Rows, "_write", lambda self, df: (write(self, df), made.append(1)))
    model = TR.train_detector(data, ["a", "b", "c"], "y", depth=2, rounds=2)
    assert len(made) == 1 and TR.feature_importance(model, data.sparkSession).agg(F.sum("importance")).first()[0] == pytest.approx(1)
    TR.train_detector(data.withColumn("v", F.col("a") > 1), ["a", "b", "c"], "y", depth=2, rounds=2, valid="v")
    assert len(made) == 1
