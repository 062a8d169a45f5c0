"""Passes of the line dedup: what each reads and hands on, and the whole against brute force."""

import random
import re

import numpy as np

from tidewatch.llm import line_dedup, set_join
from tidewatch.llm.common import SPACE, signed, spans


def _flat(texts):
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def test_only_wanted_lines_are_cut_into_words(spark):
    data, off = _flat(["One two\n\nthree", "", "\n", "four Five\nsix seven\n"])
    s = set_join.line_sets(data, off)
    assert s.owner.tolist() == [0, 0, 0, 1, 2, 2, 3, 3, 3] and s.part.tolist() == [0, 1, 2, 0, 0, 1, 0, 1, 2]
    assert s.n.tolist() == [2, 0, 1, 0, 0, 0, 2, 2, 0]
    wanted = spark.createDataFrame([(int(x),) for x in signed(s.raw[[0, 6]])], "raw bigint")
    lines, at = set_join.wanted_lines(data, off, set_join.node_filter(wanted, "raw"))
    assert bytes(lines) == b"One twofour Five" and at.tolist() == [0, 7, 16]
    assert set_join.line_sets(lines, at).ids().tolist() == s.ids()[[0, 6]].tolist()
    none, at = set_join.wanted_lines(data, off, set_join.node_filter(wanted.limit(0), "raw"))
    assert len(none) == 0 and at.tolist() == [0]


def test_a_prefix_is_one_row_of_its_line(spark):
    docs = spark.createDataFrame([("one two three four five six\nseven\nseven",), ("Six five four three two one\n",)], "text string").coalesce(1)
    levels, t = np.zeros(1 << set_join.SKETCH_BITS, np.uint8), set_join.Threshold(1, 2)
    flat = set_join.prefix_tokens(docs, set_join.line_sets, levels, t).orderBy("node", "pos").collect()
    lists = set_join.prefix_lists(docs, set_join.line_sets, levels, t, 2, "t").orderBy("node").collect()
    assert sorted((r.n, len(r.tokens)) for r in lists) == [(1, 1), (6, 4)]
    assert [(r.node, r.n, pos, token) for r in lists for pos, token in enumerate(r.tokens)] == [(r.node, r.n, r.pos, r.token) for r in flat]


def _similar(a, b):
    return 19 * len(a & b) >= 9 * (len(a) + len(b))


def test_removed_lines_equal_brute_force(spark):
    """Families of near copies, sizes at which one, two or no words may differ, repeated lines and a null id."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    made = []
    for _ in range(12):
        base = rng.sample(words, rng.randint(8, 40))
        for _ in range(rng.randint(1, 9)):
            line = list(base)
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(words)
            if rng.random() < 0.4:
                line = line[1:]
            rng.shuffle(line)
            made.append("  ".join(w.upper() if rng.random() < 0.1 else w for w in line))
    rng.shuffle(made)
    made += [made[0], "", " ", made[3]]
    rows = [(i * 7 % 31, "\n".join(made[i::31])) for i in range(31)] + [(None, "\n".join(made[:9])), (99, None), (100, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    placed = sorted(((d is None, d or 0, k), d, set(x.lower().split())) for d, text in rows if text is not None for k, x in enumerate(text.split("\n")))
    want = {(d, at[2]): bool(s) and any(o and at2 < at and _similar(o, s) for at2, _, o in placed) for at, d, s in placed}
    assert {(r.doc_id, r.line): r.removed for r in line_dedup.repeated_lines(docs).collect()} == want
    found = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in line_dedup.removed_per_document(docs).collect()}
    assert found == {d: (sum(e == d for e, _ in want), sum(v for (e, _), v in want.items() if e == d), sorted(k for (e, k), v in want.items() if v and e == d))
                     for d in {d for d, _ in want}}
    assert 0 < sum(want.values()) < len(want)


def test_pairs_of_resolved_lines_are_not_met_again(spark):
    """A resolved line meets open ones only, on whichever side it stands, and only a later open line is looked at."""
    longs = ", ".join(f"b{i} bigint" for i in range(line_dedup.BITS))
    zero = (0,) * line_dedup.BITS
    nodes = [(1, 10, 3), (2, 11, 2), (3, 10, 1), (4, 10, 4)]          # node, n, place
    lists = spark.createDataFrame([(node, n, [5, 6], *zero) for node, n, _ in nodes] + [(1, 10, [5, 6], *zero)], f"node bigint, n int, tokens array<bigint>, {longs}")
    table = spark.createDataFrame([(node, 100 + node, (False, at, 0)) for node, _, at in nodes], "node bigint, raw bigint, at struct<none: boolean, doc_id: int, line: int>")
    resolved = spark.createDataFrame([(9, 2), (9, 4)], "a bigint, b bigint")
    pairs = {(r.a, r.b, r.raw_a, r.raw_b) for r in line_dedup._earlier(lists, table, resolved, line_dedup.THRESHOLD).collect()}
    assert pairs == {(3, 1, 103, 101), (2, 1, 102, 101)}


def test_whole_sets_come_with_the_prefixes(spark, monkeypatch):
    """The pass that cuts the prefixes hands on the sets of wanted nodes, so the texts are scanned once less."""
    docs = spark.createDataFrame([(1, "b a c\n\nd e"), (2, "f g h"), (3, None)], "doc_id int, text string").coalesce(1)
    s = set_join.line_sets(*_flat(["b a c\n\nd e", "f g h"]))
    wanted = spark.createDataFrame([(int(x),) for x in signed(s.ids()[[0, 3]])], "node bigint")
    levels, t = np.zeros(1 << set_join.SKETCH_BITS, np.uint8), line_dedup.THRESHOLD
    lists = set_join.prefix_lists(docs.na.drop(), set_join.line_sets, levels, t, 2, "t", wanted).collect()
    sets = {int(i): signed(s.tokens[lo:hi]).tolist() for i, lo, hi in zip(signed(s.ids()), s.at[:-1], s.at[1:]) if hi > lo}
    keep = {r.node for r in wanted.collect()}
    assert {r.node: r.whole for r in lists} == {i: v if i in keep else None for i, v in sets.items()}
    scans, found = [], set_join.sets_of_lines
    monkeypatch.setattr(set_join, "sets_of_lines", lambda *a: scans.append(a) or found(*a))
    line_dedup.removed_per_document(docs).collect()
    assert len(scans) == 1


def test_rows_by_word_are_exchanged_once_and_not_windowed(spark):
    longs = ", ".join(f"b{i} bigint" for i in range(line_dedup.BITS))
    lists = spark.createDataFrame([(i, 10, [5, 6], *(0,) * line_dedup.BITS) for i in (1, 2, 2)], f"node bigint, n int, tokens array<bigint>, {longs}")
    table = spark.createDataFrame([(i, 100 + i, (False, i, 0)) for i in (1, 2)], "node bigint, raw bigint, at struct<none: boolean, doc_id: int, line: int>")
    pairs = line_dedup._earlier(lists, table, spark.createDataFrame([], "a bigint, b bigint"), line_dedup.THRESHOLD)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    before = plan.split("SortMergeJoin [token")[1].split("Exchange hashpartitioning(token")[0]          # what one side does behind its exchange
    assert "spark_partition_id" in before.lower()
    final = plan.split("Initial Plan")[0]
    assert any("ReusedExchange" in row and "token" in row for row in final.splitlines())


def test_runs_and_orders_equal_plain_ones():
    rng = random.Random(3)
    for _ in range(300):
        texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 4))]
        data, off = _flat(texts)
        got = [a.tolist() for a in spans(SPACE, data, off)]
        words = [(o + m.start(), o + m.end()) for o, x in zip(off.tolist(), texts) for m in re.finditer(r"\S+", x)]
        assert got == [[a for a, _ in words], [b for _, b in words]]
    for top in (1, 3, 70_000, 1 << 30):
        seg = np.sort(np.random.default_rng(top).integers(0, top, 5_000))
        key = np.random.default_rng(7).integers(0, 1 << 63, 5_000).astype(np.uint64)
        key[::3] = key[0] ^ np.arange(len(key[::3]), dtype=np.uint64)          # these differ in their last bits only
        order = set_join.order_within(key, seg)
        assert list(zip(seg[order], key[order])) == sorted(zip(seg, key))
