"""The whole pipeline against brute force on the smallest tables. The classifier is learnt, so its verdicts are taken from the stage."""

import re

import corpus_pipeline
from tidewatch.llm.common import table


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_exact(rows):
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), i)
    keep = set(first.values())
    return [(i, t) for i, t in rows if i in keep]


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", lower(t))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [(i, t) for i, t in rows if root(i) == i]


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))


def brute_clean(rows, items):
    windows = set()
    for t in items:
        w = words(t)
        n = min(13, len(w))
        windows |= {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
    sizes, out = sorted({len(x) for x in windows}), []
    for i, t in rows:
        w = words(t)
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in windows for p in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append((i, t))
    return out


def test_run_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id", "text").collect()]
    assert 0 < len(kept) <= docs.count()
    exact = brute_exact(kept)
    near = brute_near(exact)
    want = brute_clean(near, [r.text for r in table(spark, sf, "benchmark").collect()])
    assert len(exact) < len(kept) and len(near) < len(exact) and len(want) < len(near)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == sorted(i for i, _ in want)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got.values())


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    for name, fn in corpus_pipeline.STAGES[:-1]:
        out = fn(spark, docs.limit(40), sf)
        assert out.columns == docs.columns, name
        assert fn(spark, docs.limit(0), sf).count() == 0, name
