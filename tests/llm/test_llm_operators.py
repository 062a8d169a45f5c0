"""The operators against brute force on a small awkward table: nulls, empty and long texts, ties, copies, clashing names."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import (decontaminate, exact_dedup, html_extract, jaccard_join, label_sharding, line_dedup, sentence_pieces,
                           set_join, suffix_dedup, toxicity, url_filters)
from tidewatch.llm.common import flat

SCHEMA = "doc_id bigint, text string, hits string, n string, node string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def make_texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeé ß".replace(" ", "")) for _ in range(r.randint(2, 6))) for _ in range(400)]
    base = [r.choice(words) for _ in range(120)]
    texts = [None, "", " \t\n", "one", "one", "One", "a b c d", "a b c d e", "▁ mark  two", "x" * 5000, " ".join(base * 40)]
    for k in range(40):
        w = list(base)
        for _ in range(k % 12):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    shared = " ".join(r.choice(words) for _ in range(60))
    for k in range(30):
        own = [r.choice(words) for _ in range(r.randint(5, 80))]
        texts.append(" ".join(own) + ("\n" + shared + "\n" if k % 3 == 0 else "\n") + " ".join(own[:20]))
    return texts + texts[12:20]


@pytest.fixture(scope="module")
def rows():
    return [(i * 3, t, "h", "n", "x") for i, t in enumerate(make_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_suffix_dedup(docs, rows):
    seen, want = set(), {}
    for d, t, *_ in sorted(rows):
        b = (t or "").encode()
        hit = [False] * len(b)
        for i in range(len(b) - 99):
            w = b[i:i + 100]
            if w in seen:
                hit[i:i + 100] = [True] * 100
            seen.add(w)
        kept = bytes(x for x, h in zip(b, hit) if not h)
        runs = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
        want[d] = (len(b), sum(hit), runs, hashlib.sha256(kept).hexdigest(), kept)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffix_dedup.cut_repeats(docs).collect()}
    assert got == want


def test_suffix_dedup_large_groups(docs, monkeypatch):
    want = {tuple(r[:5]) for r in suffix_dedup.cut_repeats(docs).collect()}
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", 2)
    assert {tuple(r[:5]) for r in suffix_dedup.cut_repeats(docs).collect()} == want


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    sets, root = {d: shingles(t) for d, t, *_ in rows}, {d: d for d, *_ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def test_jaccard_join(docs, rows):
    want = components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(docs).collect()} == want
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in want.items() if d == c}


def test_line_dedup(docs, rows):
    lines = [((d, i), frozenset(re.findall(r"[^\x20\x09-\x0D]+", lower(x)))) for d, t, *_ in sorted(rows) if t is not None for i, x in enumerate(t.split("\n"))]
    want = {k for i, (k, s) in enumerate(lines) if s and any(o and 10 * len(s & o) >= 9 * len(s | o) for _, o in lines[:i])}
    assert {(r.doc_id, r.line) for r in line_dedup.repeated_lines(docs).filter("removed").collect()} == want
    out = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    assert out == {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in want) for d, t, *_ in rows}


def test_exact_dedup(spark, docs, rows):
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t, *_ in rows}
    groups = collections.defaultdict(list)
    for d, t in norm.items():
        groups[t].append(d)
    want = {(d, min(groups[t]), len(groups[t]), d == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm.items()}
    assert {tuple(r)[:5] for r in exact_dedup.exact_groups(docs, capacity=2).collect()} == want
    assert {r.doc_id for r in exact_dedup.drop_copies(docs).collect()} == {min(g) for g in groups.values()}
    twice = spark.createDataFrame([(1, "a", "", "", ""), (1, "a", "", "", ""), (None, "a", "", "", ""), (None, "b", "", "", ""), (2, "a", "", "", "")], SCHEMA)
    assert sorted((r.doc_id is None, r.text) for r in exact_dedup.drop_copies(twice).collect()) == [(False, "a"), (True, "b")]


def test_extendible_directory_splits(spark):
    keys = spark.range(500).selectExpr("xxhash64(id) AS key")
    buckets = exact_dedup.directory(keys, 20).collect()
    all_keys = [r.key & (1 << 64) - 1 for r in keys.collect()]
    held = [sum(k >> (64 - b.depth) == b.prefix for k in all_keys) if b.depth else len(all_keys) for b in buckets]
    assert sum(held) == 500 and max(held) <= 20 and len({b.depth for b in buckets}) > 1


def test_sharding(docs, rows):
    got = label_sharding.assign(docs, shards=4).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    by_text = collections.defaultdict(set)
    text = {d: t or "" for d, t, *_ in rows}
    for r in got:
        by_text[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_sharding_of_one_hot_group(spark):
    hot = spark.range(100).selectExpr("id AS doc_id", "if(id < 60, 'same', concat('t', id)) AS text")
    got = label_sharding.assign(hot, shards=4).collect()
    assert sorted(collections.Counter(r.shard for r in got).values()) == [25] * 4


def test_decontamination(spark, docs, rows):
    text = {d: t for d, t, *_ in rows}
    bench = [(1, text[33]), (2, "a b c d"), (2, "a b c d"), (3, None), (None, "one"), (10, text[150])]
    clean = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))                      # noqa: E731
    table = spark.createDataFrame(bench, "item_id bigint, text string")
    want = {}
    for d, t, *_ in rows:
        w, hit, items = clean(t), set(), set()
        for i, x in bench:
            b = clean(x)
            for win in {tuple(b[k:k + 13]) for k in range(max(1, len(b) - 12))} if b else ():
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k:k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        items.add("null" if i is None else str(i))
        want[d] = (len(w), len(hit), sorted(items))
    for part in (1 << 20, 300):
        out = decontaminate.benchmark_hits(docs, table, part_bytes=part).collect()
        assert {r.doc_id: (r.hits.n_words, r.hits.n_hit, r.hits["items"]) for r in out} == want
    for r in out:
        assert sum(len(clean(r.text[s.start:s.end])) for s in r.hits.spans) == r.hits.n_hit
    kept = decontaminate.drop_contaminated(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (n, h, _) in want.items() if not (h and 20 * h >= n)}


def best_path(text, vocabulary):
    """Score of the best segmentation of the whole text."""
    root, byte = sentence_pieces.trie(vocabulary)
    score = {p: s for p, s in zip(vocabulary.pieces, vocabulary.scores) if p}
    text, longest = " " + text, max(map(len, score))
    best = [0.0]
    for j in range(1, len(text) + 1):
        options = [best[j - 1] + byte * len(text[j - 1].encode())]
        options += [best[i] + score[text[i:j]] for i in range(max(0, j - longest), j) if text[i:j] in score]
        best.append(max(options))
    return best[-1], score, byte


def test_sentence_pieces(docs):
    vocabulary = sentence_pieces.public_vocabulary()
    out = sentence_pieces.decode(sentence_pieces.encode(docs, vocabulary), vocabulary).collect()
    assert all(r.decoded == (r.text or "") for r in out) and all((len(r.ids) == 0) == (not r.text) for r in out)
    for r in [x for x in out if x.text]:                   # every whole text, the ids that came out of the query
        want, score, byte = best_path(r.text, vocabulary)
        got = sum(score[vocabulary.pieces[i]] if vocabulary.pieces[i] else byte for i in r.ids)
        assert abs(got - want) < 1e-6 * max(1, len(r.text))


def test_url_filters(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/es/x?y", "https://a.example.org/en/12", "https://example.org", "http://org/", "http://x.com/fr/",
            "http://notexample.org/es/", "http://a.b.com/de/1#z", "http://free-bets.example.net/x", "ftp://h.net/a^adserver/b", "http://x.com/fr/", "http://h.net?://q"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df, url_filters.HOST_RULES + url_filters.PATTERN_RULES).collect()}
    assert got[0] == got[1] == ("", "", None, "allow") and got[3] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[4][2:] == ("example.org/en/1", "block") and got[5] == ("example.org", "", None, "allow") and got[6][2:] == ("org/", "allow")
    assert got[7][2:] == ("com/fr/", "allow") and got[8][2:] == ("org/", "allow") and got[9][2:] == ("com/de/", "block")
    assert got[10][2:] == (None, "block") and got[11][2:] == (None, "block") and got[12] == got[7] and got[13] == ("h.net", "", None, "allow")


def test_toxicity(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(base + "/documents.parquet"), spark.read.parquet(base + "/labels.parquet")
    model = toxicity.fit(docs, labels, use=~toxicity.held_out())
    found = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out()).select("toxic", "score").collect()
    hit = [r.score >= 0.7 for r in found if r.toxic == 1]
    false = [r.score >= 0.7 for r in found if r.toxic == 0]
    assert sum(hit) / len(hit) > 0.8 and sum(false) / len(false) < 0.01
    awkward = toxicity.score(spark.createDataFrame([(None,), ("",), ("é" * 3,)], "text string"), model).collect()
    assert all(0 <= r.score <= 1 for r in awkward) and awkward[0].score == awkward[1].score
    none = toxicity.fit(docs.limit(0), labels.limit(0))
    assert [r.score for r in toxicity.score(docs.limit(1), none).collect()] == [0.5]


def test_html_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_extract.fit(pages, max_pages=60)
    for page in pages.limit(200).collect():                # held-out pages and their article markup
        found = html_extract.blocks(page.html)
        want = " ".join(b.text for b, y in zip(found, html_extract.markup_labels(found)) if y)
        assert html_extract.main_text(page.html, *model) == want
    page = ('<div class="top-menu"><li><a href=#>Home</a></div><div class="story"><h1>A title</h1><p>First <b>bo</b>ld &amp; plain, with a number of words.<p>Second&nbsp; part,'
            ' which ends as well.</div><div class="user-comments"><p>I do not agree with this at all, said a reader.</p></div><script>var x="<p>no</p>";</script><footer>x</footer>')
    assert html_extract.main_text(page, *model) == "A title First bold & plain, with a number of words. Second part, which ends as well."
    odd = spark.createDataFrame([(None,), ("",), ("<",), ("<p>un<closed",), ("<!-- x",)], "html string")
    assert all(r.text is not None for r in html_extract.extract(odd, model).collect())


def test_empty_tables(docs):
    none = docs.limit(0)
    assert suffix_dedup.cut_repeats(none).count() == 0 and jaccard_join.similar_documents(none).count() == 0
    assert exact_dedup.exact_groups(none).count() == 0 and label_sharding.assign(none).count() == 0 and line_dedup.repeated_lines(none).count() == 0


def test_sets_of_lines_and_shingles_are_those_of_each_text():
    """Sets of a whole batch in one go, whichever way they are sorted."""
    r = random.Random(7)
    texts = ["", "\n", "a\n", "\n\nb a b\n", "one two three", "a b c d", None] + [
        "".join(r.choice(["a", "b", "Cd", " ", "\n", "\t"]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    got = set_join.line_sets(*flat(pa.array(texts)))
    lines = [(i, k, line) for i, t in enumerate(texts) for k, line in enumerate((t or "").split("\n"))]
    assert list(zip(got.owner.tolist(), got.part.tolist())) == [(i, k) for i, k, _ in lines]
    assert got.n.tolist() == [len(set(re.findall(r"[^\x20\x09-\x0D]+", lower(x)))) for *_, x in lines]
    alone = [set_join.line_sets(*flat(pa.array([x]))) for *_, x in lines]
    assert got.ids().tolist() == [int(s.ids()[0]) for s in alone]
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    want = [len({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0 for w in words]
    assert set_join.shingle_sets(*flat(pa.array(texts))).n.tolist() == want
    assert set_join.shingle_sets(*flat(pa.array(["a b c"]))).n.tolist() == [1]         # three words in all failed before
    key, seg = np.array([5, 4, 5, 1 << 20, 3], np.uint64), np.array([0, 0, 0, 0, 0])
    assert key[set_join.order_within(key, seg)].tolist() == sorted(key.tolist())


def test_alike_texts_that_are_not_similar_leave_no_candidates(spark):
    """200 texts that share a third of their words but are not similar meet in all pairs; their bitmaps tell them apart."""
    r = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(10 ** 6)}" for _ in range(60)) + " " + passage) for i in range(200)], "doc_id bigint, text string")
    first = set_join.first_pass(docs, ["doc_id"], set_join.shingle_sets, "t", jaccard_join.BITS)
    nodes = first.filter("chunk is null").select("node", "n", "mins", "bits")
    sets = set_join.shingle_sets
    levels = np.zeros(1 << set_join.SKETCH_BITS, np.uint8)                             # no rarity: shared tokens lead the prefix
    tokens = set_join.prefix_tokens(docs, sets, levels, jaccard_join.THRESHOLD)
    none = spark.createDataFrame([], "node bigint, comp bigint")
    assert tokens.count() > 200 and nodes.count() == 200
    assert jaccard_join.tile_pairs(tokens, nodes, none, jaccard_join.THRESHOLD).count() < 20
