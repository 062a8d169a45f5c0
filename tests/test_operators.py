"""Operators against brute force on short tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.functions import addresses as A, features as X, labels as L, packets as P
from tidewatch.operators import confusion as CF, ranking as RK, sampling as SM, sequence as SQ, sweeps as SW, windows as WN, flow_features as FF
from tidewatch.operators.quantiles import exact_percentiles
from tidewatch.sources import logs, tables

US = 1_000_000


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute_starts(times, width):
    out, start = {}, None
    for t in sorted(times):
        if start is None or t - start >= width:
            start = t
        out[t] = start
    return out


@pytest.mark.parametrize("form", ["joins", "walk"])
def test_anchored_windows_match_the_sequential_rule(spark, form):
    """Many small keys and one hot key holding a third of the rows."""
    rng = random.Random(7)
    data = [("hot", rng.randrange(0, 4000) * US // 10) for _ in range(300)]
    data += [(f"k{rng.randrange(12)}", rng.randrange(0, 90000) * US // 10) for _ in range(600)]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(data)], "k string, ts_us bigint, event_id bigint")
    got = {(r.k, r.ts_us): r.win_start_us for r in SQ.anchored_windows(df, ["k"], 60, form=form).collect()}
    want = {}
    for key in {k for k, _ in data}:
        want |= {(key, t): s for t, s in brute_starts([t for k, t in data if k == key], 60 * US).items()}
    assert got == want


def test_cooldown_is_not_a_lag_filter(spark):
    df = spark.createDataFrame([("a", s * US, i) for i, s in enumerate((0, 1000, 1790, 1801, 2500, 3601, 3601))],
                               "k string, ts_us bigint, event_id bigint")
    for form in ("joins", "walk"):
        assert [r.event_id for r in SQ.cooldown(df, ["k"], 1800, form=form).orderBy("event_id").collect()] == [0, 3, 5]


def test_event_gaps_cross_pieces_and_merge_ties(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 0, 900_000, 2_500_000, 9_000_000)], "k string, ts_us bigint")
    got = rows(SQ.event_gaps(df, ["k"]).select("ts_us", "events", "gap_sec"))
    assert got == [(0, 2, None), (900_000, 1, 0.9), (2_500_000, 1, 1.6), (9_000_000, 1, 6.5)]


def test_gap_features_guards(spark):
    df = spark.createDataFrame([("two", 0), ("two", 5 * US), ("five", 0), ("five", US), ("five", 2 * US), ("five", 4 * US), ("five", 9 * US),
                                ("same", 7), ("same", 7), ("same", 7)], "k string, ts_us bigint")
    got = {r.k: r for r in WN.gap_features(WN.gap_counts(df, ["k"], span_sec=10), ["k"]).collect()}
    assert got["two"].iat_cv == 0.0 and "same" not in got
    assert got["five"].iat_cv == pytest.approx(1.6393596310755 / 2.25) and got["five"].iat_q90_q10 == 5.0


def test_smallest_per_group_with_copies(spark):
    """A group of copies larger than the limit is cut exactly, and groups that fit are whole."""
    data = [("big", f"{i:04x}beef") for i in range(50)] + [("big", "0005aaaa")] * 40 + [("tiny", "ffff")] * 3
    df = spark.createDataFrame(data, "g string, h string")
    for n in (6, 20, 46, 200):
        got = rows(RK.smallest_per_group(df, ["g"], "h", n))
        want = sorted(sorted(r for r in data if r[0] == "big")[:n] + [r for r in data if r[0] == "tiny"][:n])
        assert got == want, n
    assert len(rows(RK.smallest_per_group(df, [], "h", 0))) == 0


def test_running_number_across_blocks(spark):
    ids = random.Random(1).sample(range(1000), 300)
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in ids], "id bigint, g string")
    got = {r.id: r.seq for r in RK.running_number(df, "id", block=8).collect()}
    assert got == {v: n for n, v in enumerate(sorted(ids))}
    got = {r.id: r.seq for r in RK.running_number(df, "id", ["g"], block=8).collect()}
    assert all(got[v] == sorted(i for i in ids if i % 2 == v % 2).index(v) for v in ids)


def test_percentiles_are_exact(spark):
    import numpy as np
    rng = random.Random(3)
    parts = {"x": [rng.lognormvariate(0, 4) for _ in range(400)] + [5.0] * 200 + [0.0] * 30 + [-rng.random() for _ in range(50)], "one": [2.5],
             "close": [1.7e9 + rng.randrange(5000) for _ in range(3000)], "crowded": [1.0 - 1e-9 * rng.randrange(100) for _ in range(500)],
             "far": [float("-inf"), -1e300, -1e-300, 0.0, 1e-300, 1e300]}
    df = spark.createDataFrame([(g, v) for g, vs in parts.items() for v in vs] + [("one", None), ("one", float("nan"))], "g string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.95, 1.0]
    got = {(r.g, r.prob): r.value for r in exact_percentiles(df, ["g"], ["v"], probs).collect()}
    assert len(got) == len(probs) * len(parts)
    for g, vs in parts.items():
        for p in probs:
            if g != "far" or p in (0.0, 1.0, 0.25):
                want = float(np.quantile(np.array(vs), p)) if g != "far" else sorted(vs)[0] if p == 0 else sorted(vs)[-1] if p == 1 else None
                assert want is None or got[g, p] == pytest.approx(want, rel=1e-12)


def test_neighbours_across_runs_of_runs(spark, monkeypatch):
    from tidewatch.operators import edges
    monkeypatch.setattr(edges, "FAN", 3)
    rng = random.Random(2)
    at = sorted(rng.sample(range(-400, 400), 90))
    data = [(k, t, None if rng.random() < 0.3 else t * 10) for k in "ab" for t in at]
    df = spark.createDataFrame(data, "k string, t bigint, v bigint")
    for before in (True, False):
        got = {(r.k, r.t): r.o for r in edges.neighbour(df, ["k"], "t", "v", "o", before).collect()}
        for k, t, _ in data:
            near = [v for kk, tt, v in data if kk == k and v is not None and (tt < t if before else tt > t)]
            assert got[k, t] == ((max(near) if before else min(near)) if near else None)


def test_address_joins_with_one_address_of_a_third_of_all_rows(spark):
    from tidewatch.operators import joins
    alerts = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"a{i % 40}" if i % 5 else None) for i in range(3000)], "alert_id long, src_ip string")
    index = spark.createDataFrame([("hot", 1), ("a1", 0), ("other", 1)], "ip string, is_attack int")
    truth = {"hot": "attack", "a1": "benign"}
    got = joins.lookup_ip_label(alerts, index).collect()
    assert len(got) == 3000 and all(r.ground_truth == truth.get(r.src_ip) for r in got)
    scores = spark.createDataFrame([("hot", 0.5, 1), ("hot", 0.7, 2), ("a1", 0.1, 1)], "src_ip string, score double, seq int")
    got = joins.attach_scores(alerts, scores).collect()
    assert len(got) == 3000 and all(r.score == {"hot": 0.7, "a1": 0.1}.get(r.src_ip) for r in got)
    allow = spark.createDataFrame([("hot",), ("hot",), (None,)], "src_ip string")
    kept = joins.suppress_listed(alerts, allow).collect()
    assert sorted(r.alert_id for r in kept) == [i for i in range(3000) if i % 3]
    assert sum(r.suppress_reason == "whitelist" for r in joins.suppress_listed(alerts, allow, keep_reason=True).collect()) == 1000


def test_roc_auc_of_crowded_scores_and_margins(spark):
    from tidewatch.operators.sweeps import roc_auc
    rng = random.Random(4)
    data = [(rng.choice([1.0 - 1e-9 * rng.randrange(2000), rng.uniform(-8, 8)]), rng.randrange(2)) for _ in range(1500)]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    got = roc_auc(spark.createDataFrame(data, "score double, is_attack int")).first()
    assert got.auc == pytest.approx(want, rel=1e-12)


def test_flow_prefix_limit_reaches_the_scan_side(spark, sf):
    from tidewatch.fixtures import packets
    plan = FF.flow_prefix(packets(spark, sf), 8)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange") == 1


def test_row_weighted_confusion_and_floor(spark):
    """One id with both labels adds to TP and FP; a smaller universe floors the rest at 0."""
    f = spark.createDataFrame([("x", "DoS Hulk"), ("x", "BENIGN"), ("x", "BENIGN"), ("y", "DoS Hulk"), ("z", "BENIGN")], "flow_id string, label string")
    ids = spark.createDataFrame([("x",), ("nowhere",)], "flow_id string")
    idx = CF.flow_index(f)
    r = CF.flow_confusion(idx, ids).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.total) == (1, 2, 1, 1, 5)
    u = spark.createDataFrame([(0, 1)], "attack_rows bigint, benign_rows bigint")
    r = CF.flow_confusion(idx, ids, u).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 2, 0, 0)


# Published counts and rates: tp, tn, fp, fn → accuracy, precision, recall, f1, fpr. The second row was published with
# the accuracy of the first one, 1.5e-4 below what its counts give; the tolerance covers that.
@pytest.mark.parametrize("cells,want", [
    ((252657, 432638, 7393, 15), (0.9893, 0.9716, 0.9999, 0.9856, 0.0168)),
    ((252657, 432737, 7294, 15), (0.9893, 0.9719, 0.9999, 0.9857, 0.0166)),
    ((1, 102, 0, 7), (0.9364, 1.0, 0.125, 0.2222, 0.0)),
    ((252634, 388688, 51343, 38), (0.9258, 0.8311, 0.9998, 0.9077, 0.1167)),
    ((0, 0, 0, 0), (0.0, 0.0, 0.0, 0.0, 0.0))])
def test_published_rates(spark, cells, want):
    df = spark.createDataFrame([cells], "tp bigint, tn bigint, fp bigint, fn bigint")
    r = CF.rates(df).first()
    assert tuple(r[m] for m in CF.MEASURES) == pytest.approx(want, abs=1.5e-4)


def test_sweep_is_monotone_and_adds_up(spark, sf):
    from tidewatch.plans.q_common import scored
    s = SW.threshold_sweep(scored(spark, sf), [0.1, 0.3, 0.5, 0.9]).orderBy("threshold").collect()
    n = scored(spark, sf).count()
    assert all(r.tp + r.fp + r.tn + r.fn == n for r in s)
    assert all(a.tp >= b.tp and a.fp >= b.fp for a, b in zip(s, s[1:]))


def test_strict_and_loose_threshold(spark):
    df = spark.createDataFrame([(0.9,), (0.91,)], "score double")
    assert df.filter(CF.score_at("score", 0.9)).count() == 1 and df.filter(CF.score_at("score", 0.9, strict=False)).count() == 2


def test_results_do_not_depend_on_partitioning(spark, sf):
    from tidewatch.fixtures import packets
    p = packets(spark, sf)
    def result(df):
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows(WN.client_window_features(df, 604800))]
    want = result(p)
    for n in (1, 7, 60):
        assert result(p.repartition(n)) == want


def test_scalars(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("172.31.0.1",), ("172.32.0.1",), ("127.0.0.1",), ("fe80::1",), ("",), ("224.0.0.1",), ("x.y",)], "ip string")
    r = df.select(A.is_private_ip("ip"), A.is_private_ip("ip", True), A.is_valid_ip("ip"), A.long_to_ip(A.ip_to_long("ip"))).collect()
    assert [x[0] for x in r] == [True, True, False, False, False, False, False, False]
    assert r[3][1] and [x[2] for x in r] == [True, True, True, True, False, False, False, True]
    assert r[1][3] == "172.31.0.1" and df.filter(A.ip_to_long("ip").isNull()).count() == 3
    t = spark.createDataFrame([("1.2.3.4:80",), (":0",), ("fe80::1:80",), ("1.2.3.4",), ("1.2.3.4:http",)], "a string")
    assert [x.s and tuple(x.s) for x in t.select(A.split_addr("a").alias("s")).collect()] == [("1.2.3.4", 80), None, None, None, None]
    c = spark.range(1).select(A.flow_id_candidates(F.lit("192.168.10.51"), F.lit("b"), F.lit(1), F.lit(2), F.lit(6)).alias("c")).first().c
    assert c == ["b-192.168.10.51-2-1-6", "192.168.10.51-b-1-2-6", "b-172.16.0.1-2-1-6", "172.16.0.1-b-1-2-6"]


def test_flag_classes(spark):
    df = spark.createDataFrame([(f,) for f in (2, 6, 18, 0, 1, 41, 17, 4, 8)], "flags int").withColumn("proto", F.lit(6))
    got = [r[0] for r in df.select(P.classify_packet("flags")).collect()]
    assert got == ["S", None, None, "F", "F", "F", None, None, "F"]
    assert [r[0] for r in df.select(P.is_syn("flags")).collect()][:3] == [True, True, False]


def test_zero_iqr_and_log_sets(spark):
    df = spark.createDataFrame([(5.0, 3.0)], "a double, b double")
    params = {"a": (2.0, 0.0), "b": (1.0, 2.0)}
    assert tuple(X.robust_scale(df, params).first()) == (0.0, 1.0)
    assert tuple(X.robust_scale(df, params, "one").first()) == (3.0, 1.0)
    assert set(config.SCAN.log1p_features) - set(config.FLOOD.log1p_features) == {"port_entropy", "src_port_range", "port_ratio"}
    assert config.CLIENT.log1p_features == ()


def test_dos_classes(spark):
    df = spark.createDataFrame([(5.0, 5.0, 0.0, 0.5), (2.0, 1.0, 3.0, 9.0), (9.0, 9.0, 5.0, 2.0)], "spkts double, dpkts double, sintpkt double, dur double")
    assert [r[0] for r in df.select(X.classify_dos()).collect()] == ["volumetric", "slow_rate", "generic"]
    assert {r[0] for r in df.select(X.classify_dos(staged=F.lit(False))).collect()} == {"generic"}
    assert {r[0] for r in df.select(X.classify_dos(F.lit(False), F.lit(True))).collect()} == {"volumetric"}


def test_client_rules(spark):
    df = spark.createDataFrame([(3, 6.0, 1.0, 0.0, 0.5, 9.0, True), (3, 0.0, 0.0, 0.0, 0.0, 0.0, True), (3, 0.0, 1.0, 0.0, 0.5, 9.0, True), (3, 0.0, 1.0, 0.0, 0.5, 9.0, False)],
                               "syn_count int, rst_rate double, data_density double, internal_ratio double, handshake_ratio double, bytes_per_syn double, listed boolean")
    got = [r[0] for r in df.select(L.client_suppress_reason(F.lit(0.9), listed="listed")).collect()]
    assert got == ["high_rst", "no_data", "whitelist", None]


def test_alert_parser_rejects_and_accepts(spark):
    good = "07/03-12:06:51.613437, 63092, TCP, raw, 1500, S2C, 23.208.104.19:80, 192.168.10.16:36602, 301:1:1, allow"
    lines = [good, "# " + good, "", "  ", good.replace(", 301:1:1, allow", ""), good.replace("23.208.104.19:80", "fe80::1:80"),
             good.replace("23.208.104.19:80", ":0"), good.replace("301:1:1", "x:1:1"), good.replace("301:1:1", "301"),
             good.replace("TCP", "eth"), good.replace("23.208.104.19:80", "23.208.104.19:0")]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = logs.parse_alert_lines(df, year=2017).orderBy("src_port").collect()
    assert [(r.proto, r.src_port, r.gid, r.sid) for r in got] == [("TCP", 0, 301, 1), ("TCP", 80, 301, 1), ("TCP", 80, 301, 1)]
    assert str(got[1].ts) == "2017-07-03 12:06:51.613437" and got[1].ingested_at is not None
    assert got[1].src_ip == "23.208.104.19" and got[1].dst_port == 36602
    rep = logs.alert_drop_report(df).first()
    assert (rep.total, rep.filtered, rep.few_fields, rep.bad_address_or_id, rep.port_zero, rep.unknown_protocol) == (8, 7, 1, 4, 1, 1)
    assert CF.usable_alerts(logs.parse_alert_lines(df)).count() == 2
    assert CF.usable_alerts(logs.parse_alert_lines(df), drop_port_zero=False).count() == 3


def test_flow_table_keeps_short_and_skips_long_lines(spark, tmp_path):
    p = tmp_path / "Friday-WorkingHours.csv"
    p.write_bytes(b"Flow ID, Source IP, Destination Port, Label\na-b-1-2-6,1.1.1.1,80, BENIGN \nc-d-1-2-6,2.2.2.2\n"
                  b"e-f-1-2-6,3.3.3.3,80,Bot,extra\n,4.4.4.4,80,Bot\ng-h-1-2-6,5.5.5.5,80,Web Attack \x96 XSS\n")
    t = tables.read_flow_table(spark, str(p))
    assert [(r["Flow ID"], r["Label"]) for r in t.collect()][:2] == [("a-b-1-2-6", "BENIGN"), ("c-d-1-2-6", None)]
    assert t.count() == 3 and t.columns == ["Flow ID", "Source IP", "Destination Port", "Label", "csv_source"]
    assert t.first().csv_source == "Friday-WorkingHours.csv"
    w = tables.read_flow_table(spark, str(p), ["Label", "Flow ID"], "cp1252")
    assert "Web Attack – XSS" in {r["Label"] for r in w.collect()}


def test_spread_timestamps(spark):
    df = spark.createDataFrame([("a", 0, "p"), ("a", 0, "q"), ("a", 0, "r"), ("b", 0, "s")], "src_ip string, ts_us bigint, row_key string")
    got = sorted(r.spread_us for r in SQ.spread_timestamps(df, ["src_ip"]).collect())
    assert got == [0, 10 * US, 30 * US, 50 * US]


def test_splits_are_reproducible_and_keep_groups_together(spark, sf):
    from tidewatch.fixtures import flows
    f = flows(spark, sf)
    a = {r.row_key: r.split for r in SM.stratified_split(f).collect()}
    b = {r.row_key: r.split for r in SM.stratified_split(f.repartition(13)).collect()}
    assert a == b
    g = SM.group_split(f).groupBy("src_ip").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0]
    assert g == 1
    assert SM.group_split(f, validation=0.2, label=F.lit(False)).groupBy("src_ip").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0] == 2


def test_sliding_windows_start_and_clip(spark):
    df = spark.createDataFrame([(100 * US,), (1000 * US,), (960 * US,)], "ts_us bigint")
    got = [r[0] for r in df.select(WN.sliding_starts("ts_us", 300, 60)).collect()]
    assert got == [[0, 60], [720, 780, 840, 900, 960], [720, 780, 840, 900, 960]]


def test_narrative_numbers(spark):
    df = spark.createDataFrame([(3.0,), (0.123456,), (1234567.0,), (0.0,)], "v double")
    assert [r[0] for r in df.select(L.short_number("v")).collect()] == ["3", "0.123", "1230000", "0"]


def test_smallest_per_group_keeps_different_rows_of_one_key(spark):
    from tidewatch.operators.ranking import smallest_per_group

    rows = [("g", f"{i:032x}", i) for i in range(20)] + [("g", "0" * 31 + "3", 100 + i) for i in range(4)]
    df = spark.createDataFrame(rows, "grp string, key string, value int")
    for limit in range(1, 12):
        got = sorted((r.key, r.value) for r in smallest_per_group(df, ["grp"], "key", limit).collect())
        assert len(got) == len(set(got)) == limit and set(got) <= {(k, v) for _, k, v in rows}
        assert [k for k, _ in got] == sorted(k for _, k, _ in rows)[:limit]


def test_read_flow_table_folder_of_two_column_orders(spark, tmp_path):
    folder = tmp_path / "label days"
    folder.mkdir()
    (folder / "a.csv").write_text("Flow ID, Label, X\nf1, BENIGN,1\n")
    (folder / "b.csv").write_text("Flow ID, X, Label\nf2,2, DoS\n")
    (folder / "c.csv").write_text("Flow ID, Label, X\nf3, Scan,3\n")
    rows = tables.read_flow_table(spark, str(folder)).select("`Flow ID`", "Label", F.trim("X").alias("X"), "csv_source").collect()
    assert sorted(map(tuple, rows)) == [("f1", "BENIGN", "1", "a.csv"), ("f2", "DoS", "2", "b.csv"), ("f3", "Scan", "3", "c.csv")]
