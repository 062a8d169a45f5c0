"""Histogram boosting, monotone calibration, codes: against separate fits, brute force and each other."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.models import boosting as B, explain as E, isotonic as ISO, trees as TR
from tidewatch.models.encode import encode_with_unknown


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 3)).round(2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2]) > rng.normal(size=3000) / 3).astype(int)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(is_attack=y, k=np.arange(3000), day=[f"d{i % 3}" for i in range(3000)])
    pdf.loc[5, "a"] = np.nan
    return spark.createDataFrame(pdf).withColumn("a", F.when(F.col("k") != 6, F.col("a"))).repartition(5)


SMALL = B.Boosting(rounds=6, depth=3, step=0.3)
ABC = ["a", "b", "c"]


def margin(df, ens):
    return df.withColumn("m", TR.tree_margin(df, ens))


def test_folds_grow_the_trees_of_separate_fits(rows):
    edges = B.bin_edges(rows, ABC, 32)
    p = B.Boosting(rounds=6, depth=3, rows=0.7, columns=0.67)
    together = B.fit(rows, ABC, params=p, fold="day", folds=["d0", "d1", "d2"], edges=edges, row_id=["k"])
    for day, ens in zip(("d0", "d1", "d2"), together):
        alone, = B.fit(rows.filter(F.col("day") != day), ABC, params=p, edges=edges, row_id=["k"])
        assert ens.nodes.equals(alone.nodes) and len(ens.nodes) > 20
    shuffled, = B.fit(rows.filter("day <> 'd0'").repartition(3, "k"), ABC, params=p, edges=edges, row_id=["k"])
    assert shuffled.nodes.equals(together[0].nodes)


def test_continuation_starts_from_the_margins_of_the_first_model(rows):
    edges = B.bin_edges(rows, ABC, 32)
    whole, = B.fit(rows, ABC, params=SMALL, edges=edges)
    first, = B.fit(rows, ABC, params=B.Boosting(rounds=4, depth=3, step=0.3), edges=edges)
    same, = B.fit(rows, ABC, params=B.Boosting(rounds=0), start=first, edges=edges)
    assert same.nodes.equals(first.nodes)
    more, = B.fit(rows, ABC, params=B.Boosting(rounds=2, depth=3, step=0.3), start=first, edges=edges)
    assert more.nodes.equals(whole.nodes)
    a, b = (margin(rows, e).orderBy("k").toPandas()["m"].to_numpy() for e in (first, same))
    assert (a == b).all()
    with pytest.raises(ValueError):
        B.fit(rows, ["b", "a", "c"], params=SMALL, start=first)


def test_two_sources_keeps_the_first_model(rows):
    first, second = B.train_two_sources(rows.filter("day <> 'd0'"), rows.filter("day = 'd0'"), ABC, params=SMALL, more=B.Boosting(rounds=3, depth=2))
    assert second.nodes.iloc[:len(first.nodes)].equals(first.nodes) and second.nodes["tree"].nunique() == 9


def test_fit_learns_and_scores_alike_in_both_forms(rows):
    ens, = B.fit(rows, ABC, params=B.Boosting(rounds=25, depth=3, step=0.3))
    scored = TR.score_trees(TR.score_trees(rows, ens, "p"), ens, "q", form="expression")
    assert scored.filter(F.abs(F.col("p") - F.col("q")) > 1e-12).count() == 0
    right = scored.filter((F.col("p") > 0.5) == (F.col("is_attack") == 1)).count()
    assert right > 2600


def test_validation_rows_end_the_fit(rows):
    noise = rows.withColumn("is_attack", (F.xxhash64("k") % 2 == 0).cast("int"))
    ens, = B.fit(noise, ABC, params=B.Boosting(rounds=40, depth=4, step=0.5, patience=3), valid=F.col("day") == "d1")
    assert ens.nodes["tree"].nunique() < 20


def test_rows_without_label_and_empty_tables(rows):
    odd = rows.withColumn("is_attack", F.when(F.col("k") % 2 == 0, F.col("is_attack")))
    edges = B.bin_edges(rows, ABC, 16)
    with_nulls, = B.fit(odd, ABC, params=SMALL, edges=edges, row_id=["k"])
    without, = B.fit(odd.filter("is_attack is not null"), ABC, params=SMALL, edges=edges, row_id=["k"])
    assert with_nulls.nodes.equals(without.nodes)
    nothing, = B.fit(rows.limit(0), ABC, params=B.Boosting(rounds=1), edges=edges)
    assert (nothing.nodes["value"] == 0).all()


def test_attribution_of_a_deep_fitted_model_sums_to_the_margin(rows):
    ens, = B.fit(rows, ABC, params=B.Boosting(rounds=10, depth=6, step=0.3))
    got = E.explain_trees(margin(rows, ens), ens, ["k", "m"]).groupBy("k", "m").agg(F.sum("contribution").alias("c"))
    assert got.count() == 3000 and got.filter(F.abs(F.col("c") + E.base_value(ens) - F.col("m")) > 1e-9).count() == 0


def brute_isotonic(x, y):
    xs = np.unique(x)
    blocks = [[v, v, float(y[x == v].sum()), int((x == v).sum())] for v in xs]
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return out


@pytest.mark.parametrize("slope", [3.0, 0.0, -2.0])
def test_isotonic_blocks_equal_one_pass(spark, slope):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=4000).round(4)
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-slope * (x - 0.5)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"score": x, "is_attack": y}))
    want = brute_isotonic(x, y)
    got = ISO.fit_isotonic(df, ranges=16).orderBy("lo").collect()
    assert [(r["lo"], r["hi"], r["n"]) for r in got] == [(b[0], b[1], b[3]) for b in want]
    assert np.allclose([r["value"] for r in got], [b[2] / b[3] for b in want])
    asked = spark.createDataFrame([(i, float(v)) for i, v in enumerate([-1.0, 2.0, *rng.uniform(size=200)])] + [(999, None), (998, float("nan"))], "i long, score double")
    blocks = spark.createDataFrame(got)
    found = {r["i"]: r["calibrated"] for r in ISO.apply_isotonic(asked, blocks, ranges=8).collect()}
    knots, values = np.array([[b[0], b[1]] for b in want]).ravel(), np.repeat([b[2] / b[3] for b in want], 2)
    for i, v in [(r["i"], r["score"]) for r in asked.collect()]:
        assert found[i] is None if v is None or v != v else abs(found[i] - np.interp(v, knots, values)) < 1e-12


def test_isotonic_of_nothing(spark):
    df = spark.createDataFrame([(None, 1), (0.5, None)], "score double, is_attack int")
    assert ISO.fit_isotonic(df).count() == 0
    assert [r["calibrated"] for r in ISO.calibrate_isotonic(df).collect()] == [None, None]


def test_codes_are_dense_over_many_ranges(spark):
    values = [f"v{i * 7 % 500:03d}" for i in range(1500)]
    train = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    df = spark.createDataFrame([(v,) for v in [*values[:50], "unseen", None]], "v string")
    code = {v: float(i) for i, v in enumerate(sorted(set(values)))}
    got = [(r["v"], r["code"]) for r in encode_with_unknown(train, df, "v", "code").collect()]
    assert sorted(got, key=repr) == sorted([(v, code.get(v, 500.0)) for v in [*values[:50], "unseen", None]], key=repr)


def test_rows_of_one_file_are_dealt_over_the_cores(rows, monkeypatch):
    """Passes read chunks that lie in several files, whatever the partitions of the input; the trees stay the same."""
    made, monkey = [], B.Rows._write
    monkeypatch.setattr(B, "CHUNK", 100, raising=False)

    def write(self, df):
        monkey(self, df)
        made.append(len(self.table.inputFiles()))

    monkeypatch.setattr(B.Rows, "_write", write)
    edges = B.bin_edges(rows, ABC, 32)
    together, = B.fit(rows.coalesce(1), ABC, params=SMALL, edges=edges, row_id=["k"])
    assert len(made) == 2 and min(made) > 1
    apart, = B.fit(rows, ABC, params=SMALL, edges=edges, row_id=["k"])
    assert together.nodes.equals(apart.nodes)


def test_sums_of_a_level_come_from_one_node_of_two():
    """The node with less cover is added up; nodes below a leaf are not."""
    t = B.Tree(2)
    t.feature[:], t.cover[1:3] = [0, 1, -1], [9.0, 4.0]
    t.cover[3:5] = [5.0, 4.0]
    assert B._wanted(t, 1).tolist() == [False, True]
    assert B._wanted(t, 2).tolist() == [False, True, False, False]
    t.cut[:], t.value[:] = [3, 1, 0], [0, 0, 7.0, 5.0, 6.0, 0, 0]
    bins = np.array([[3, 3, 4], [1, 2, 0]], np.uint8)
    assert t.place(bins, 2).tolist() == [0, 1, 2] and t.leaf_values()[t.place(bins, 2)].tolist() == [5.0, 6.0, 7.0]


@pytest.mark.parametrize("strict", [True, False])
def test_attribution_work_depends_on_patterns_not_rows(monkeypatch, strict):
    """Weights are worked out per pattern of a path; also for a path longer than the tables."""
    widths, extend = [], E._extend
    monkeypatch.setattr(E, "_extend", lambda weights, *rest: widths.append(weights.shape[1]) or extend(weights, *rest))
    d = 3
    path = E.Path(2.0, np.arange(d), np.array([0.5, 0.25, 0.4]), np.array([-np.inf, 0.0, -1.0]), np.array([0.5, np.inf, 1.0]))
    x = np.random.default_rng(4).normal(size=(5000, d)).round(1)
    x[7, 0], x[8, 1] = np.nan, np.nan
    got = E.contributions([path], x, strict)
    assert max(widths) <= 2 ** d
    monkeypatch.setattr(E, "TABLE", 2)
    assert np.array_equal(E.contributions([path], x, strict), got)
    # all contributions of a row add up to what its leaf gives it less the mean
    inside = (x[:, 0] < 0.5) & (x[:, 1] >= 0) & (x[:, 2] >= -1) & (x[:, 2] < 1) if strict else (x[:, 0] <= 0.5) & (x[:, 1] > 0) & (x[:, 2] > -1) & (x[:, 2] <= 1)
    inside[8] = not np.isnan(x[8, 0]) and (x[8, 0] < 0.5) and -1 <= x[8, 2] < 1          # NaN goes right
    assert np.allclose(got.sum(axis=1)[:7], (inside * 2.0 - 2.0 * 0.5 * 0.25 * 0.4)[:7])


def test_source_is_read_once_and_stages_grow_apart(rows, monkeypatch):
    """Edges and bins come from one reading of the input; margins are written at growing distances."""
    read, made, monkey = rows.sparkSession.sparkContext.accumulator(0), [], B.Rows._write

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    monkeypatch.setattr(B.Rows, "_write", lambda self, df: (monkey(self, df), made.append(1)))
    ens, = B.fit(rows.mapInArrow(seen, rows.schema), ABC, params=B.Boosting(rounds=13, depth=2), row_id=["k"])
    assert read.value == 3000 and len(made) == 3 and ens.nodes["tree"].nunique() == 13


@pytest.mark.parametrize("fetch", [1 << 20, 0])
def test_edges_are_the_interpolated_quantiles(spark, monkeypatch, fetch):
    """Cells narrowed to the last bit or fetched, with ties, both zeros, infinities, NaN, null and values alike in their leading bits."""
    from tidewatch.operators.quantiles import exact_percentiles
    monkeypatch.setattr(B, "FETCH", fetch, raising=False)
    monkeypatch.setattr(B, "CHUNK", 700, raising=False)
    assert B._value(B._key(np.array([-0.0, -np.inf, 5e-324, -1.5]))).tolist() == [0.0, -np.inf, 5e-324, -1.5]
    x = np.random.default_rng(1).normal(size=4000)
    pdf = pd.DataFrame({"a": x, "b": np.where(x > 0, 0.0, -0.0), "c": 1.7e9 + x * 1e-4, "d": np.where(x > 1, np.nan, x.round(1)), "e": np.nan,
                        "f": np.where(x > 1.5, np.inf, np.where(x < -2, -np.inf, -1e300 * x))})
    df = spark.createDataFrame(pdf).withColumn("d", F.when(F.col("a") < 0.7, F.col("d"))).repartition(3)
    found = exact_percentiles(df, [], list("abcdef"), [i / 16 for i in range(1, 16)]).collect()
    want = [np.unique([r["value"] for r in found if r["feature"] == f]) for f in "abcdef"]
    got = B.bin_edges(df, list("abcdef"), 16)
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(got, want)) and [len(e) for e in got][1:5:3] == [1, 0]


def test_joint_counts_equal_those_of_each_feature():
    """Sums of neighbouring features counted together, with trees that margins do not have yet."""
    assert B._joined([64, 64, 8, 8, 64, 300]) == [[0, 1], [2, 3, 4], [5]]
    rng, sizes = np.random.default_rng(2), [64, 64, 8, 8, 64, 300]
    bins = np.stack([rng.integers(0, n, 500) for n in sizes]).astype(np.uint16)
    c = B.Chunk(bins, rng.integers(0, 2, 500).astype(float), np.ones(1), np.arange(500), rng.integers(-1, 2, 500), np.zeros(1, bool), rng.normal(size=(2, 500)))
    before, t = B.Tree(2), B.Tree(2)
    before.feature[0], before.cut[0], before.value[1:3] = 1, 20, [0.3, -0.2]
    t.feature[0], t.cut[0], t.cover[1:3] = 0, 30, [9.0, 4.0]
    got = B._chunk_sums(iter([c]), [[before], []], [None, t], 1, 0, [0, 2, 4, 5], sizes, B.Boosting())
    own = (bins[0] > 30) & (c.fold != 1)
    g, h = B.gradients(c.margin[1, own], c.y[own], np.ones(1))
    for i, f in enumerate([0, 2, 4, 5]):
        assert all((got[0, i, :, k] == np.bincount(bins[f, own], x, 300)).all() for k, x in enumerate((g, h)))
    root = B._chunk_sums(iter([c]), [[before], []], [B.Tree(2), None], 0, 0, [1], sizes, B.Boosting())
    g, h = B.gradients(c.margin[0] + np.where(bins[1] > 20, -0.2, 0.3), c.y, c.fold != 0)
    assert (root[0, 0, :, 0] == np.bincount(bins[1], g, 300)).all()


def test_table_rows_are_short_and_blocks_are_long():
    """Written rows hold few bytes whatever the size of the blocks that passes work on; both have the same values."""
    rng = np.random.default_rng(7)
    n = 10_000
    c = B.Chunk(rng.integers(0, 64, (3, n)).astype(np.uint8), rng.integers(0, 2, n).astype(np.int8), np.array([2.5]), np.arange(n), np.full(1, -1, np.int32),
                np.zeros(1, bool), rng.normal(size=(2, n)))
    table = [dict(zip([*B.FIXED, "margin"], row)) for row in c.rows()]
    assert [len(r["valid"]) for r in table] == [4096, 4096, n - 8192] and max(sum(map(len, r.values())) for r in table) < 1 << 20
    back, = B._blocks(iter(table), 3, 2, np.uint8)
    for name in (*B.FIXED, "margin"):
        assert np.array_equal(getattr(back, name), getattr(c, name)) and getattr(back, name).nbytes <= getattr(c, name).nbytes
