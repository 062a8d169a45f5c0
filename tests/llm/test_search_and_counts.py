"""Hard negatives, token counts and ranked search: against brute force, the library itself, and odd rows."""

from collections import Counter
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import ball_search, hard_negatives, token_counts


# --- hard negatives ---------------------------------------------------------------------------------------------------

def test_residue_products_are_exact():
    rng = np.random.default_rng(3)
    for dims, most in ((1, 5), (64, 300), (3000, 2 ** 20), (2, 2 ** 28)):
        a, b = rng.integers(-most, most, (7, dims)), rng.integers(-most, most, (9, dims))
        primes = hard_negatives.primes_for(dims * most * most)
        got = hard_negatives.scores(hard_negatives.residues(a.astype(float), primes), hard_negatives.residues(b.astype(float), primes), primes)
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert got.tolist() == want


def test_primes_are_as_many_as_the_bound_needs():
    assert hard_negatives.PRIMES[:4] == [251, 241, 239, 233]
    assert hard_negatives.primes_for(0) == [251] and hard_negatives.primes_for(125) == [251] and hard_negatives.primes_for(126) == [251, 241]


def brute_negatives(rows, is_anchor):
    fine = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows
            if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    first = lambda some, k: sorted(some, key=lambda e: (-e[1], e[0] is None, e[0] or 0))[:k]
    out = []
    for a, al, av in fine:
        if a is None or not is_anchor(a):
            continue
        others = [(i, dot(av, v), l) for i, l, v in fine if i != a and len(v) == len(av)]
        for p, ps, _ in first([o for o in others if o[2] == al], 5):
            window = [o for o in others if o[2] != al and 80 * ps <= 100 * o[1] <= 100 * ps]
            out += [(a, p, r + 1, n, ps, ns) for r, (n, ns, _) in enumerate(first(window, 5))]
    return sorted(out, key=repr)


def test_hard_negatives_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5, 1.0, 0.75]) for _ in range(4)], rng.randrange(3)) for i in range(400)]   # many ties
    rows += [(1000, None, 1), (1001, [float("nan"), 1.0, 1.0, 1.0], 1), (1002, [float("inf"), 1.0, 1.0, 1.0], 1), (1003, [None, 1.0, 1.0, 1.0], 1),
             (1004, [1.0] * 4, None), (None, [1.0] * 4, 2), (None, [1.0] * 4, 1), (1005, [1.0, 1.0], 1), (1006, [], 1), (1020, [3.0e38] * 4, 1),
             (7, [1.0] * 4, 0), (20, rows[20][1], rows[20][2]), (20, [1.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"anchor": F.lit("x"), "ID": F.lit(1), "x": F.lit(2)})
    got = hard_negatives.mine(df, F.col("vec_id") % 20 == 0)
    want = brute_negatives([r for r in rows if r[0] != 1020], lambda i: i % 20 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 200


def test_hard_negatives_in_several_blocks_and_without_rows(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.randrange(4)) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(hard_negatives, "BLOCK_NUMBERS", 40)
    monkeypatch.setattr(hard_negatives, "GROUP", 2)
    got = hard_negatives.mine(df, F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_negatives(rows, lambda i: i % 20 == 0)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.mine(df, F.lit(None).cast("boolean")).count() == 0


# --- token counts -----------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_token_counts_equal_the_library_on_whole_tables(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = token_counts.count_tokens(docs, token_counts.public_ranks()).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["n_tokens"] == len(library.encode(r["text"] or "")) and r["n_bytes"] == len((r["text"] or "").encode())
        assert r["over_limit"] == (r["n_tokens"] > 4096)


def test_token_counts_of_odd_texts(spark, library):
    rng = random.Random(2)
    alphabet = " ▁  ab<s>te\n\t\0日本語é🙂​0x1"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["<s> </s> <unk> <0x41>", " ", "    ", "a" * 9000, "    " * 4000, "\U0001d4b3" * 9000, "ab cd " * 300_000,
              "".join(rng.choice("abcdefghijklmnop") for _ in range(400_000)), "日本" * 200_000]
    rows = [(i % 700, t, i) for i, t in enumerate([*texts, None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS int").withColumn("at", F.col("N_TOKENS"))
    got = {r["at"]: r["n_tokens"] for r in token_counts.count_tokens(df, token_counts.public_ranks()).select("at", "n_tokens").collect()}
    assert [got[i] for i in range(len(rows))] == [len(library.encode(t or "")) for _, t, _ in rows]
    assert token_counts.count_tokens(df.limit(0), token_counts.public_ranks()).count() == 0


def test_forgotten_words_are_counted_again(monkeypatch):
    ranks = token_counts.public_ranks()
    count = token_counts.counter(ranks)
    texts = ["one two three four", "five six one", "seven two two three"]
    want = [count(t) for t in texts]
    monkeypatch.setattr(token_counts, "KEEP_WORDS", 2)
    token_counts._KNOWN[ranks.digest].clear()
    assert [count(t) for t in texts] == want


def test_merges_follow_rank_then_place():
    ranks = token_counts.MergeRanks({"ab": 1, "bc": 0, "abc": 2, "aa": 3, "a": 9, "b": 9, "c": 9}, True, "")
    assert token_counts.count_word("abc", ranks) == 1        # bc first, then a + bc
    assert token_counts.count_word("abab", ranks) == 2
    assert token_counts.count_word("aaa", ranks) == 2        # the leftmost of equal pairs
    assert token_counts.count_word("aé", ranks) == 3         # two bytes for a character without a piece


# --- ranked search ----------------------------------------------------------------------------------------------------

def terms_of(text):
    return [t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t)
            for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def brute_search(docs, items, k=10):
    found = [(i, Counter(terms_of(t))) for i, t in docs]
    found = [(i, c, c.total()) for i, c in found if c]
    n_docs, n_terms = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in found:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, q in Counter(terms_of(text)).items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_ranked_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeé0") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 40, 200]))) for i in range(700)]
    docs += [(i, "same words here") for i in range(900, 960)] + [(5, "same words here"), (None, "same words here"), (None, "words"),
             (970, None), (971, ""), (972, " .,;"), (973, " ".join(words) * 200)]
    items = [(i, text(rng.choice([1, 3, 30]))) for i in range(60)] + [(61, "same words"), (61, "same words"), (None, "same"), (62, None), (63, ""), (64, "unknownword")]
    dd = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"TERMS": F.lit(1), "score": F.lit("x")}).repartition(3)
    ii = spark.createDataFrame(items, "item_id long, text string").withColumn("question", F.lit(1))
    want = brute_search(docs, items)
    for docs_per_tree, block in ((1024, 256), (90, 7)):
        monkeypatch.setattr(ball_search, "TREE_DOCS", docs_per_tree)
        monkeypatch.setattr(ball_search, "BLOCK_ITEMS", block)
        assert sorted(map(tuple, ball_search.search(dd, ii).collect()), key=repr) == want
    assert ball_search.search(dd.limit(0), ii).count() == 0 and ball_search.search(dd, ii.limit(0)).count() == 0
    assert ball_search.search(dd.filter("doc_id in (970, 971, 972)"), ii).count() == 0


def test_bounds_hold_and_prune(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(ball_search, "LEAF_DOCS", 4)
    dims, weights = 60, [int(w) for w in rng.integers(1, 9000, 60)]
    rows = [np.sort(rng.choice(np.arange(20 * (i % 3), 20 * (i % 3) + 20), rng.integers(1, 12), replace=False)) for i in range(200)]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    terms = np.concatenate(rows)
    value = rng.integers(0, 10 ** 6, len(terms))
    order, nodes = ball_search.build_tree(starts, terms, value * np.sqrt(np.array(weights, float))[terms], dims)
    starts, at = ball_search.reorder(starts, order)
    lo, hi, left, radius, ct, cv = zip(*nodes)
    tree = ball_search.Tree(dict(doc_ids=list(order), starts=starts, terms=terms[at], value=value[at], lo=lo, hi=hi, left=left, radius=radius,
                                 centre_starts=np.concatenate([[0], np.cumsum([len(c) for c in ct])]), centre_terms=np.concatenate(ct), centre=np.concatenate(cv)))
    counts = [Counter({i: int(n) for i, n in zip(rng.choice(np.arange(20), 5, replace=False), rng.integers(1, 4, 5))}) for _ in range(12)]
    block = ball_search.Block(list(range(12)), counts, {i: i for i in range(dims)}, weights)
    bound, pruned = tree.bounds(block), 0
    for q in range(12):
        every = ball_search.Tree.scores(tree, 0, block.whole[q])
        for node in range(len(lo)):
            assert bound[node, q] >= tree.scores(node, block.whole[q]).max()
        best = ball_search.Best(block, 3, np.ones(12, np.int64))
        ball_search.visit(tree, best)
        assert sorted(-s for s, *_ in best.found[q]) == sorted(every)[-3:]
        pruned += int((bound[:, q] < best.floor[q]).sum())
    assert pruned > 100


def test_a_long_text_is_counted_whole():
    text = ("Ab,cd é1 " * 600_000).encode()
    assert ball_search.count_terms(text) == Counter({b"ab": 600_000, b"cd": 600_000, "é1".encode(): 600_000})


# --- exact dedup through its directory; pages with odd markup ------------------------------------------------------------

def test_exact_dedup_needs_its_directory(spark, monkeypatch):
    """With a directory that leads keys to other buckets, copies are no longer found."""
    from tidewatch.llm import exact_dedup
    rows = [(i, f"text {i % 40}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    right = exact_dedup.exact_groups(df, capacity=5).collect()
    assert all(r.keep_id == r.doc_id % 40 and r.group_size == 3 for r in right) and len(right) == 120
    look = exact_dedup.looked_up
    calls = []

    def astray(rows_, buckets):
        out = look(rows_, buckets)
        calls.append(1)
        return out if len(calls) == 1 else out.withColumn("bucket", F.col("bucket") + 1)      # the index is right, the lookup is not

    monkeypatch.setattr(exact_dedup, "looked_up", astray)
    wrong = exact_dedup.exact_groups(df, capacity=5).collect()
    assert sum(r.group_size == 3 and r.keep_id == r.doc_id % 40 for r in wrong) < 60


def test_exact_dedup_with_a_map_column(spark):
    from tidewatch.llm import exact_dedup
    df = spark.createDataFrame([(1, "a  b", {"k": "v"}), (2, "a b", {"k": "w"}), (2, "a b", {"k": "w"}), (3, "c", None)],
                               "doc_id long, text string, extra map<string,string>")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()) == [
        (1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False), (3, 3, 1, True)]
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(df).collect()) == [1, 3]


@pytest.mark.parametrize("page,want", [
    ("<article><p>Before</p><svg><g><path/><p>After the picture.</p></article>", ["Before", "After the picture."]),
    ("<head><title>T</title><meta x><style>p {}</style><p>No body tag here.</p>", ["No body tag here."]),
    ("<html><head><title>T</title></head><body><p>a &amp; b</p></body>", ["a & b"]),
    ("<article>A<object><object>b</object></object> c <canvas>d</canvas></article>", ["A", "b", "c", "d"]),
    ("<p>a<script>if (x < 1) {'</p>'}</script>b", ["a", "b"]),
    ("<p>a<!-- <p>x</p> -->b <![CDATA[c < d]]>", ["ab c < d"]),
    ("<p class='x>y' title=\"a > b\">one<p>two", ["one", "two"]),
    ("<p>3 < 4 and 5 > 4", ["3 < 4 and 5 > 4"]),
    ("<p>left <a x=\"", ["left <a x=\""]), ("", []), ("<", ["<"])])
def test_blocks_of_odd_markup(page, want):
    from tidewatch.llm import html_extract
    assert [b.text for b in html_extract.blocks(page)] == want


@pytest.mark.parametrize("piece", ['<a x="', "<![CDATA[", "<!--", "<p 'x", "<", "<a ", "<svg>", "<script>"])
def test_a_megabyte_of_broken_markup_takes_no_time(piece):
    import time
    from tidewatch.llm import html_extract
    start = time.time()
    html_extract.blocks(piece * (1_000_000 // len(piece)))
    assert time.time() - start < 10
