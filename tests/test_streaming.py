"""Streams against their batch twins on the same rows."""

from pyspark.sql import functions as F

from tidewatch import config, fixtures
from tidewatch.operators import sequence as SQ, windows as WN
from tidewatch.streaming import detectors as DT, pipelines as PL
from tidewatch.streaming.scoring import LinearScore

DAYS = 7 * 86_400


def test_flood_stream_equals_anchored_batch(spark, sf):
    """Same windows, same features, same scores; the marker row at the end closes every window."""
    PL.use_rocksdb(spark)
    p = fixtures.packets(spark, sf)
    cfg = config.FLOOD.with_(window_sec=DAYS, min_events=2)
    score = LinearScore({0: 0.5}, -1.0)
    stream = PL.run_to_end(DT.detect_flood_stream(PL.replay(spark, p, stop_after_us=4 * DAYS * 1_000_000), score, cfg), spark, "flood")
    got = {(r.key, r.win_start_us): (r.syn_count, [round(v, 9) for v in r.features]) for r in stream.collect()}
    syn = p.filter("proto = 6 AND flags = 2")
    w = WN._syn_features(SQ.anchored_windows(syn, ["src_ip"], DAYS), ["src_ip", "win_start_us"], DAYS, 2)
    want = {(r.src_ip, r.win_start_us): (r.syn_count, [round(float(r[c]), 9) for c in config.SYN_FEATURES]) for r in w.collect()}
    assert got == want and len(got) > 10


def test_flows_are_scored_once(spark, sf):
    from tidewatch.operators.flow_features import flow_features_15, flow_prefix
    PL.use_rocksdb(spark)
    p = fixtures.packets(spark, sf)
    s = DT.score_flow_stream(PL.replay(spark, p, slices=2), LinearScore({1: 0.1}), config.FLOW.with_(max_packets=3), forget_sec=90 * 86_400)
    got = PL.run_to_end(s, spark, "flow").collect()
    assert len({r.key for r in got}) == len(got)
    closing = (F.col("proto") == 6) & (F.col("flags").bitwiseAND(5) != 0)
    prefix = flow_prefix(p, 3, closing)
    done = prefix.groupBy("flow_key").agg(F.max("pkt_no").alias("n"), F.max(closing).alias("c")).filter("n = 3 or c")
    batch = flow_features_15(prefix.join(done, "flow_key", "left_semi"))
    want = {r.flow_key: [round(float(r[c]), 6) for c in config.FLOW_FEATURES_15] for r in batch.collect()}
    assert {r.key: [round(v, 6) for v in r.features] for r in got} == want


def test_late_rows_are_counted(spark, sf):
    p, seen = PL.count_late(fixtures.packets(spark, sf), "ts", "2024-01-02 00:00:00")
    n = p.count()
    assert seen.get["rows"] == n and 0 < seen.get["late_rows"] < n


def test_silent_keys_are_scored_by_timers(spark, sf):
    """Every key with enough SYNs in its last window is scored although no later packet of it arrives."""
    PL.use_rocksdb(spark)
    p = fixtures.packets(spark, sf)
    cfg = config.AUTH.with_(window_sec=90 * 86_400, min_events=2, early_events=10**6, early_seconds=1e12, idle_seconds=0.0, cooldown_sec=0)
    s = DT.detect_auth_stream(PL.replay(spark, p, slices=2, stop_after_us=200 * 86_400_000_000), LinearScore({0: 1.0}), cfg)
    got = {r.key: r.syn_count for r in PL.run_to_end(s, spark, "auth").collect()}
    syn = p.filter("proto = 6 AND flags = 2").groupBy("src_ip").count().filter("count >= 2")
    assert got == {r.src_ip: r["count"] for r in syn.collect()} and got


def test_replay_bounds_its_batches(spark, tmp_path):
    """One key and one time hold most rows; they still come in bounded batches, in the order of time and id."""
    rows = spark.range(4000).select((F.col("id") * 7919 % 4000).alias("event_id"), F.lit("hot").alias("src_ip"))
    rows = rows.withColumn("ts_us", F.greatest(F.col("event_id") - 3000, F.lit(0)))
    seen = []

    def look(batch, _):
        r = batch.agg(F.count("*").alias("n"), F.min(F.struct("ts_us", "event_id")).alias("lo"), F.max(F.struct("ts_us", "event_id")).alias("hi")).first()
        seen.append((r.n, tuple(r.lo), tuple(r.hi)))

    s = PL.replay(spark, rows, slices=2, max_rows=500)
    s.writeStream.foreachBatch(look).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert sum(n for n, _, _ in seen) == 4000 and max(n for n, _, _ in seen) <= 750
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))


def test_gate_counts_each_address_and_port_once(spark, sf):
    """Changes of the gate from bounded batches equal those of one walk over all SYNs, and no state holds a set."""
    PL.use_rocksdb(spark)
    p = fixtures.packets(spark, sf)
    s = DT.syn_rate_gate_stream(PL.replay(spark, p, max_rows=1500), 400 * DAYS, min_rate=3, max_ip_ratio=0.9, max_port_ratio=0.9)
    got = sorted((r.key, r.ts_us, r.syn_rate, r.dst_ips, r.dst_ports, r.attack_pattern) for r in PL.run_to_end(s, spark, "gate").collect())
    want, state = [], {}
    for e in p.filter("proto = 6 AND (flags & 18) = 2").orderBy("ts_us", "event_id").collect():
        g = state.setdefault(e.src_ip, {"start": None, "n": 0, "ips": set(), "ports": set(), "hit": False})
        g["ips"].add(e.dst_ip)
        g["ports"].add(e.dst_port)
        new = g["start"] is None or e.ts_us - g["start"] >= 400 * DAYS * 1_000_000
        g["start"], g["n"] = (e.ts_us, 1) if new else (g["start"], g["n"] + 1)
        hit = g["n"] >= 3 and len(g["ips"]) / g["n"] < 0.9 and len(g["ports"]) / g["n"] < 0.9
        if hit != g["hit"]:
            g["hit"] = hit
            want.append((e.src_ip, e.ts_us, g["n"], len(g["ips"]), len(g["ports"]), hit))
    assert got == sorted(want) and want


def test_only_values_met_are_read_and_written():
    """A key with a million addresses in its state: ten packets of three addresses cost three reads and three writes."""
    from tidewatch.streaming.state import Counts, MapStore

    class State:
        def __init__(self):
            self.held, self.reads, self.writes = {f"a{i}": 1 for i in range(1_000_000)}, 0, 0

        def getValue(self, key):
            self.reads += 1
            n = self.held.get(key[0])
            return None if n is None else (n,)

        def updateValue(self, key, value):
            self.writes += 1
            self.held[key[0]] = value[0]

    state = State()
    c = Counts(MapStore(state))
    c.distinct, c.total, c.nlogn, c.most = 1_000_000, 1_000_000, 0.0, 1
    for i in range(10):
        c.add(["a1", "a2", "new"][i % 3])
    c.store.flush()
    assert (state.reads, state.writes) == (3, 3)
    assert (c.distinct, c.total, c.most, state.held["a1"], state.held["new"]) == (1_000_001, 1_000_010, 5, 5, 3)


def test_running_entropy_equals_that_of_the_counts():
    import math
    import random
    from tidewatch.streaming.state import Counts
    rng, c = random.Random(1), Counts()
    values = [int(rng.expovariate(0.2)) for _ in range(5000)]
    for v in values:
        c.add(v)
    want = -sum(values.count(v) / 5000 * math.log2(values.count(v) / 5000) for v in set(values))
    assert abs(c.entropy() - want) < 1e-9 and c.most == max(values.count(v) for v in set(values))


def test_rows_of_several_frames_are_merged_in_time_order():
    import pandas as pd
    from tidewatch.streaming.state import in_order
    a = pd.DataFrame({"ts_us": [5, 1, 3], "event_id": [1, 2, 3], "x": ["a", "b", "c"]})
    b = pd.DataFrame({"ts_us": [3, 2], "event_id": [2, 9], "x": ["d", "e"]})
    assert [e.x for e in in_order([a, b])] == ["b", "e", "d", "c", "a"] and list(in_order([])) == []


def test_a_source_of_probes_only_is_forgotten():
    from tidewatch.streaming.profiles import policy_for
    from test_policies import always, pkt
    pol = policy_for(config.SCAN, always(0.0))
    p, _ = pol.step(None, pkt(1, flags=1))
    assert pol.due(p) == 61_000_000
    p, _ = pol.step(p, pkt(30, flags=1))
    assert pol.due(p) == 90_000_000 and pol.on_timer(p, 80_000_000)[0] is p and pol.on_timer(p, 90_000_000) == (None, [])


def test_score_lines_of_a_split_file_keep_their_order(spark, tmp_path):
    from tidewatch.sources.tables import read_score_stream
    path = tmp_path / "scores.jsonl"
    path.write_text("".join(f'{{"engine":"portscan","src_ip":"10.0.0.{i % 7}","score":{i / 10000},"features":[{i}.0]}}\n' for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        got = {r.src_ip: r.features[0] for r in read_score_stream(spark, str(path), latest=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"10.0.0.{k}": float(max(i for i in range(5000) if i % 7 == k)) for k in range(7)}


def test_late_rows_come_out_beside_the_others(spark):
    PL.use_rocksdb(spark)
    rows = spark.range(300).select(F.col("id").alias("event_id"), (F.col("id") * 1_000_000).alias("arrived"),
                                   F.when(F.col("id") % 10 == 0, 0).otherwise(F.col("id") * 1_000_000).alias("ts_us")).withColumn("ts", F.timestamp_micros("ts_us"))
    out = PL.run_to_end(PL.split_late(PL.replay(spark, rows, slices=3, order=("arrived", "event_id")), "5 seconds"), spark, "late").collect()
    assert sorted(r.event_id for r in out) == list(range(300))
    late = {r.event_id for r in out if r.late}
    assert late and all(i % 10 == 0 for i in late) and max(late) == 290


def test_state_has_a_part_per_core(spark, tmp_path):
    """A session that asks for many parts does not make every micro-batch load all of them; its setting stays."""
    name, checkpoint = "spark.sql.shuffle.partitions", str(tmp_path / "cp")
    rows = spark.range(40).select("id", (F.col("id") % 4).alias("k"))
    rows.write.parquet(str(tmp_path / "in"))
    before = spark.conf.get(name)
    spark.conf.set(name, "100")
    try:
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).dropDuplicates(["k"])
        got = PL.run_to_end(stream, spark, "parts", checkpoint)
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)
    assert sorted(r.k for r in got.collect()) == [0, 1, 2, 3]
    parts = [p for p in (tmp_path / "cp" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(parts) == spark.sparkContext.defaultParallelism < 100


def test_a_key_of_datagrams_costs_few_state_calls(monkeypatch):
    """Maps and lists that the row says are empty are neither read nor cleared; a key with SYNs clears all that it has."""
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.value = name, None

        def __getattr__(self, call):
            def run(*x):
                calls.append((self.name, call))
                if call == "update":
                    self.value = x[0]
                if call == "clear":
                    self.value = None
                return {"exists": self.value is not None, "get": iter(()) if self.name == "times" else self.value, "getValue": None}.get(call)
            return run

    class Handle:
        getValueState = getMapState = getListState = lambda self, name, *kind: State(name)
        registerTimer = lambda self, ms: calls.append(("timer", "register"))

    import pandas as pd
    from types import SimpleNamespace
    packet = dict(ts_us=5_000_000, event_id=1, src_ip="10.0.0.1", dst_ip="10.0.0.2", src_port=1, dst_port=53, proto=17, flags=0)
    due = SimpleNamespace(getExpiryTimeInMs=lambda: 10**9)
    for proto, flags, want in ((17, 0, {("profile", "clear")}), (6, 2, {(n, "clear") for n in ("profile", "ports", "ips", "sports", "times")})):
        proc = DT.ProfileProcessor(config.ENDPOINT.with_(window_sec=60), LinearScore({0: 0.1}))
        proc.init(Handle())
        calls.clear()
        list(proc.handleInputRows(("10.0.0.2:53",), iter([pd.DataFrame([{**packet, "proto": proto, "flags": flags}])]), None))
        if proto == 17:
            assert calls == [("profile", "get"), ("profile", "update"), ("timer", "register")]
        calls.clear()
        list(proc.handleExpiredTimer(("10.0.0.2:53",), None, due))
        assert {c for c in calls if c[1] == "clear"} == want and len(calls) == 1 + len(want)
