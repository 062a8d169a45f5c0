"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test items.

Words are numbered over the benchmark's own vocabulary and the automaton runs over word numbers, so a window is 13
symbols. A document is normalised and scanned once; hits are word ranges, mapped back to code points of the original.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import LOWER, NOT_WORD, flat, spare_name

WINDOW = 13
#: Benchmark text that one automaton, and so one broadcast, may hold; a larger benchmark is scanned in parts.
PART_BYTES = 16 << 20

_CLEAN = bytes(32 if NOT_WORD[b] else int(LOWER[b]) for b in range(256))
RESULT = ("struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<start: bigint, end: bigint>>, "
          "ranges: array<struct<lo: int, hi: int>>>")
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("ranges", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))])
_BUILT: dict[str, tuple] = {}


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_CLEAN).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> set[tuple]:
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def automaton(items: list[tuple[str, bytes]], window: int):
    """(vocabulary, automaton); the automaton's values are (window length, item ids)."""
    import ahocorasick

    vocabulary, owners = {}, {}
    for item, raw in items:
        for w in windows_of(words_of(raw), window):
            owners.setdefault(tuple(vocabulary.setdefault(x, len(vocabulary) + 1) for x in w), set()).add(item)
    auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for w, names in owners.items():
        auto.add_word(w, (len(w), tuple(sorted(names))))
    auto.make_automaton()
    return vocabulary, auto if owners else None


def scan(raw: bytes, vocabulary: dict, auto) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged word ranges covered by windows, and the items hit."""
    words = words_of(raw)
    if auto is None or not words:
        return len(words), [], set()
    ranges, items = [], set()
    for at, (size, names) in auto.iter(tuple([vocabulary.get(w, 0) for w in words])):
        lo, hi = at - size + 1, at + 1
        while ranges and ranges[-1][1] >= lo:              # ends come in order, starts may reach back
            lo = min(lo, ranges.pop()[0])
        ranges.append((lo, hi))
        items.update(names)
    return len(words), ranges, items


def code_point_spans(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point spans of the original text."""
    if not ranges:
        return []
    data = np.frombuffer(raw, np.uint8)
    word = np.concatenate([[False], ~NOT_WORD[data], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(points[starts[lo]]), int(points[ends[hi - 1]])) for lo, hi in ranges]


def _scan_udf(shipped, name: str, window: int):
    """Arrow UDF (text, result so far) → result with the hits of one part of the benchmark added."""
    @F.arrow_udf(RESULT)
    def run(texts: pa.Array, so_far: pa.Array) -> pa.Array:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = automaton(shipped.value, window)
        vocabulary, auto = _BUILT[name]
        data, off = flat(texts)
        raw, before, out = data.tobytes(), so_far.to_pylist(), []
        for i in range(len(texts)):
            one = raw[off[i]:off[i + 1]]
            n, ranges, items = scan(one, vocabulary, auto)
            if before[i] is not None and before[i]["ranges"]:
                ranges = merged(ranges + [(r["lo"], r["hi"]) for r in before[i]["ranges"]])
                items |= set(before[i]["items"])
            out.append({"n_words": n, "n_hit": sum(hi - lo for lo, hi in ranges), "items": sorted(items),
                        "spans": [{"start": s, "end": e} for s, e in code_point_spans(one, ranges)],
                        "ranges": [{"lo": lo, "hi": hi} for lo, hi in ranges]})
        return pa.array(out, _ARROW)
    return run


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with a struct column ``hits``: ``n_words``, ``n_hit``, ``items`` (sorted as strings) and ``spans``.

    Text is lower-cased (A-Z), words are runs of ASCII letters, digits and all other characters beyond ASCII. ``spans``
    are code points of the original, covering the words that lie in some occurrence of a window. Null text and null items
    have no words; a null item id is named ``null``; equal windows belong to all their items. A column called ``hits`` is
    replaced, other columns pass through. The benchmark's size is measured first: up to ``part_bytes`` it is one
    automaton, beyond that the texts are scanned once for each part.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                             F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("raw")).distinct()
    size = items.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-size // part_bytes))
    hits = F.lit(None).cast(RESULT)
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item", "raw"), F.lit(parts)) == part).collect()     # about part_bytes
        shipped = docs.sparkSession.sparkContext.broadcast([(r.item, bytes(r.raw)) for r in rows])
        hits = _scan_udf(shipped, uuid.uuid4().hex, window)(F.col(text_col), hits)
    return docs.withColumn("hits", hits)


def contaminated(hits: str = "hits"):
    return (F.col(f"{hits}.n_hit") > 0) & (20 * F.col(f"{hits}.n_hit") >= F.col(f"{hits}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``docs`` without contaminated rows; a column ``hits`` of theirs is kept under its name."""
    own = spare_name(docs, "_own_hits")
    held = docs.withColumnRenamed("hits", own) if "hits" in docs.columns else docs
    kept = benchmark_hits(held, benchmark, **kw).filter(~contaminated()).drop("hits")
    return kept.withColumnRenamed(own, "hits").select(*docs.columns)
