"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier, by merging Burrows-Wheeler transforms.

A 100-byte string has an anchor: its 32-byte piece of least hash. Equal strings have equal anchors at equal places, so
strings need to be compared only where they share an anchor, and only aligned at it. A stretch of text whose strings all
have the same anchor is a context (100 to 168 bytes). Anchors that occur once are dropped by a count; equal contexts are
one class, whose first place stands for it, and all other places of it are covered.

The contexts of shared anchors are texts of a shard each. A shard's transform lists, column by column from the right, the
bytes before its sorted suffixes. Shards are merged by refining their interleave with these bytes alone, never sorting
suffixes again; a refinement step also turns the common prefixes of neighbours into those of the next column. Runs of
neighbours with 100 bytes or more in common are the repeated intervals, and all but the first place of each is covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewatch.llm.common import MIX_A, _powers, flat, in_bytes, mix, prefix_hash, signed, stage
from tidewatch.llm.set_join import in_filter, node_filter

WIDTH, GRAM = 100, 32
REACH = WIDTH - GRAM                                       # an anchor lies 0 … REACH bytes after the start of its string
COLUMNS = REACH + WIDTH                                    # bytes an aligned context may have
PIECE = 1 << 20
SHARDS = 4
#: Contexts of one anchor that one merge holds; the strings of larger groups are grouped by Spark instead.
MOST_CONTEXTS = 40_000
_POS = np.uint64((1 << 24) - 1)


# --- contexts of a text ---------------------------------------------------------------------------------------------------

def _least(v: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` neighbours, by doubling."""
    have = 1
    while 2 * have <= size:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[:len(v) - (size - have)], v[size - have:]) if have < size else v


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, bytes, offsets, row of each piece, its place in the row): runs of whole rows, or pieces of a long row that
    overlap by WIDTH − 1 bytes."""
    for batch in batches:
        data, off = flat(batch.column(batch.schema.get_field_index("raw")))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + PIECE, side="right")) - 1)
            if off[hi] - off[lo] <= 2 * PIECE:
                yield batch, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], np.arange(lo, hi), np.zeros(hi - lo, np.int64)
            else:
                for at in range(0, int(off[hi] - off[lo]) - WIDTH + 1, PIECE):
                    part = data[off[lo] + at:min(off[hi], off[lo] + at + PIECE + WIDTH - 1)]
                    yield batch, part, np.array([0, len(part)]), np.array([lo]), np.array([at])
            lo = hi


def contexts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """All contexts of the rows: ``row``, ``start`` and ``size`` (bytes, in the flat array), ``left`` (bytes before the
    anchor), ``anchor`` (hash of the anchor) and ``context`` (hash of the bytes and of ``left``)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return dict.fromkeys(("row", "start", "size", "left"), none) | dict.fromkeys(("anchor", "context"), none.astype(np.uint64))
    pre = prefix_hash(data)
    _, down = _powers(n + 1)
    v = (pre[GRAM:] - pre[:-GRAM]) * down[:n - GRAM + 1]
    v ^= v >> np.uint64(29)
    v *= np.uint64(MIX_A)
    v &= ~_POS
    v |= np.arange(len(v), dtype=np.uint64)                # equal hashes: the leftmost
    at = (_least(v, REACH + 1) & _POS).astype(np.int64)    # anchor of the string that starts here
    whole = np.ones(len(at), bool)
    for end in off[1:]:
        whole[max(0, end - WIDTH + 1):end] = False
    start = np.flatnonzero(whole)
    if not len(start):
        return contexts(data[:0], off[:1])
    anchor = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    s, e, a = start[first], start[last] + WIDTH, anchor[first]
    digest = lambda lo, hi: mix((pre[hi] - pre[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    return {"row": np.searchsorted(off, s, side="right") - 1, "start": s, "size": e - s, "left": a - s, "anchor": digest(a, a + GRAM),
            "context": mix(digest(s, e) + (a - s).astype(np.uint64))}


# --- transforms and their merge ----------------------------------------------------------------------------------------

def transform(cells: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of aligned rows sorted by ``group``: for each column the bytes before the sorted
    suffixes, and the order of the suffixes themselves."""
    n, width = cells.shape
    symbols, orders = np.empty((width, n), np.int32), np.empty((width + 1, n), np.int32)
    order = np.arange(n)
    orders[width] = order
    base = group.astype(np.int64) * 512                    # suffixes of a group stay together, so this holds in every order
    for c in range(width - 1, -1, -1):
        b = cells[order, c]
        symbols[c] = b
        order = order[np.argsort(base + b, kind="stable")]
        orders[c] = order
    return symbols, orders


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo … hi]) for each pair, by a sparse table as high as the longest range needs."""
    out = values[hi].copy()
    size = hi - lo + 1
    table, span = values, 1
    while True:
        here = (size >= span) & (size < 2 * span)
        if here.any():
            out[here] = np.minimum(table[lo[here]], table[hi[here] - span + 1])
        if not (size >= 2 * span).any():
            return out
        table = np.minimum(table[:-span], table[span:])
        span *= 2


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Merge transforms (symbols, orders, groups) by interleave refinement; yields, from right to left, (column, shard of
    each suffix in merged order, its rank in the shard, common prefix with the suffix before it)."""
    width = len(shards[0][0])
    side = np.concatenate([np.full(len(g), s, np.int8) for s, (_, _, g) in enumerate(shards)])
    group = np.concatenate([g for _, _, g in shards])
    order = np.argsort(group, kind="stable")
    side, group = side[order], group[order]
    base = group.astype(np.int64) * 512
    n = len(side)
    common = np.zeros(n, np.int32)                         # nothing of the empty suffixes
    fresh = np.ones(n, bool)
    fresh[1:] = group[1:] != group[:-1]
    for c in range(width - 1, -1, -1):
        place = np.argsort(side, kind="stable")            # where the suffixes of shard 0, 1, … stand
        symbol = np.empty(n, np.int64)
        symbol[place] = np.concatenate([s[c] for s, _, _ in shards])
        key = base + symbol
        step = np.argsort(key, kind="stable")
        key = key[step]
        side = side[step]
        same = np.zeros(n, bool)
        same[1:] = key[1:] == key[:-1]
        at = np.flatnonzero(same)
        now = np.zeros(n, np.int32)
        if len(at):
            now[at] = 1 + _range_min(common, step[at - 1] + 1, step[at])
        common = now
        if c <= REACH:
            rank = np.empty(n, np.int64)
            place = np.argsort(side, kind="stable")
            rank[place] = np.concatenate([np.arange(len(g)) for _, _, g in shards])
            yield c, side, rank, common


def covered_starts(cells: np.ndarray, group: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """covered[i, c]: the string of row i that starts at column c occurs in a row of lower ``first``.

    Rows are aligned texts sorted by ``group`` that hold the columns lo … hi − 1; other columns have the value 256."""
    names = np.unique(shard)
    rows_of = [np.flatnonzero(shard == s) for s in names]
    parts = [(*transform(cells[r], group[r]), group[r]) for r in rows_of]
    out = np.zeros((len(cells), REACH + 1), bool)
    for c, side, rank, common in merge(parts):
        row = np.empty(len(side), np.int64)
        for s, r in enumerate(rows_of):
            mine = side == s
            row[mine] = r[parts[s][1][c][rank[mine]]]
        run = np.flatnonzero(common < WIDTH)
        if len(run) == len(row):
            continue
        holds = (lo[row] <= c) & (c + WIDTH <= hi[row])
        when = np.where(holds, first[row], len(cells))
        least = np.minimum.reduceat(when, run)
        out[row, c] = holds & (when > np.repeat(least, np.diff(np.append(run, len(row)))))
    return out


def _cover(table: pa.Table) -> pa.RecordBatch | None:
    """Covered stretches of the contexts of whole groups."""
    _, group = np.unique(table["anchor"].to_numpy(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    table, group = table.take(order), group[order]
    n = table.num_rows
    data, off = flat(table["bytes"])
    left = table["left"].to_numpy().astype(np.int64)
    lo = REACH - left
    hi = lo + np.diff(off)
    cells = np.full((n, COLUMNS), 256, np.int16)
    row = np.repeat(np.arange(n), np.diff(off))
    cells[row, np.arange(len(data)) - np.repeat(off[:-1], np.diff(off)) + lo[row]] = data
    none, doc, th, start = (table[c].to_numpy(zero_copy_only=False) for c in ("none", "doc_key", "th", "start"))
    first = np.empty(n, np.int64)
    first[np.lexsort((start, th, doc, none))] = np.arange(n)
    hit = covered_starts(cells, group, first, lo, hi, table["shard"].to_numpy())
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    r, c1 = np.nonzero(edge == 1)
    _, c2 = np.nonzero(edge == -1)
    if not len(r):
        return None
    begin = start[r] - lo[r] + c1
    return pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().take(pa.array(r)), pa.array(th[r]), pa.array(begin.astype(np.int64)),
                                       pa.array((start[r] - lo[r] + c2 - 1 + WIDTH).astype(np.int64))], ["doc_id", "th", "start", "end"])


def _merge_groups(batches: Iterator[pa.RecordBatch], most: int = 8_000) -> Iterator[pa.RecordBatch]:
    """Whole groups (rows come sorted by anchor), several to a merge."""
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n >= most:
            table = pa.concat_tables(held).combine_chunks()
            anchor = table["anchor"].to_numpy()
            cut = int(np.argmax(anchor == anchor[-1]))
            for lo, hi in _runs(anchor[:cut], most):
                out = _cover(table.slice(lo, hi - lo))
                if out is not None:
                    yield out
            held, n = [table.slice(cut)], table.num_rows - cut
    if n:
        table = pa.concat_tables(held).combine_chunks()
        for lo, hi in _runs(table["anchor"].to_numpy(), most):
            out = _cover(table.slice(lo, hi - lo))
            if out is not None:
                yield out


def _runs(anchor: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts between groups, about ``most`` rows apart."""
    ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor)) if len(anchor) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(anchor):
        hi = int(ends[min(len(ends) - 1, np.searchsorted(ends, lo + most))])
        yield lo, hi
        lo = hi


# --- Spark jobs -----------------------------------------------------------------------------------------------------------

def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = in_bytes(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(raw).alias("th"), raw.alias("raw"))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, off, _, _ in pieces(batches):
        yield pa.RecordBatch.from_arrays([pa.array(signed(contexts(data, off)["anchor"]))], ["anchor"])


def _pass(words, column: str, with_bytes: bool):
    """Contexts whose ``column`` is in the filter, with or without their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, data, off, rows, base in pieces(batches):
            c = contexts(data, off)
            keep = np.flatnonzero(in_filter(c[column], words.value))
            if with_bytes and len(keep):                   # a class is needed once
                fresh = [i for i, x in zip(keep, c["context"][keep].tolist()) if x not in seen and not seen.add(x)]
                keep = np.array(fresh, np.int64)
                if len(seen) > 400_000:
                    seen.clear()
            if not len(keep):
                continue
            row, start = rows[c["row"][keep]], c["start"][keep] - off[c["row"][keep]] + base[c["row"][keep]]
            cols = [pa.array(signed(c["anchor"][keep])), pa.array(signed(c["context"][keep]))]
            names = ["anchor", "context"]
            if with_bytes:
                size = c["size"][keep]
                ends = np.concatenate([[0], np.cumsum(size)])
                flat_bytes = data[np.repeat(c["start"][keep] - ends[:-1], size) + np.arange(ends[-1])]
                cols += [pa.array(c["left"][keep].astype(np.int32)),
                         pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat_bytes)])]
                names += ["left", "bytes"]
            else:
                cols += [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(start), pa.array(c["size"][keep].astype(np.int32))]
                names += ["doc_id", "th", "start", "size"]
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Covered stretches: ``doc_id``, ``th`` (hash of the text), ``start``, ``end``; they may overlap."""
    own = _documents(docs, id_col, text_col)
    sc = docs.sparkSession.sparkContext
    id_type = own.schema["doc_id"].dataType.simpleString()
    shared = own.mapInArrow(_anchors, "anchor bigint").groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    shared = stage(shared, "anchors")
    words = sc.broadcast(node_filter(shared, "anchor"))
    found = stage(own.mapInArrow(_pass(words, "anchor", False), f"anchor bigint, context bigint, doc_id {id_type}, th bigint, start bigint, size int"), "contexts")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "start")
    classes = stage(found.groupBy("anchor", "context").agg(F.min(place).alias("first"), F.count("*").alias("n")), "classes")
    later = (found.join(classes.filter("n > 1").select("anchor", "context", "first"), ["anchor", "context"])
             .filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "start", (F.col("start") + F.col("size")).alias("end")))
    # anchors with several different contexts
    several = classes.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    mixed = stage(classes.join(several, "anchor").select("anchor", "context", "first", "contexts"), "mixed-contexts")
    words = sc.broadcast(node_filter(mixed, "context"))
    texts = own.mapInArrow(_pass(words, "context", True), "anchor bigint, context bigint, left int, bytes binary").dropDuplicates(["anchor", "context"])
    doc_key = F.col("first.doc_id") if id_type in ("bigint", "int", "smallint", "tinyint") else F.xxhash64("first.doc_id")
    cells = mixed.join(texts, ["anchor", "context"]).select(
        "anchor", F.col("first.doc_id").alias("doc_id"), F.col("first.none").alias("none"), F.coalesce(doc_key, F.lit(0)).cast("bigint").alias("doc_key"),
        F.col("first.th").alias("th"), F.col("first.start").alias("start"), "left", "bytes",
        F.pmod(F.xxhash64("first.doc_id", "first.th"), F.lit(SHARDS)).cast("int").alias("shard"), "contexts")
    cells = stage(cells, "context-bytes")
    merged = (cells.filter(F.col("contexts") <= MOST_CONTEXTS).drop("contexts").repartition("anchor").sortWithinPartitions("anchor")
              .mapInArrow(_merge_groups, f"doc_id {id_type}, th bigint, start bigint, end bigint"))
    # very large groups: their strings are grouped one by one
    wide = cells.filter(F.col("contexts") > MOST_CONTEXTS).withColumn("i", F.explode(F.expr(f"sequence(0, length(bytes) - {WIDTH})")))
    wide = wide.withColumn("string", F.expr(f"substring(bytes, i + 1, {WIDTH})")).withColumn("begin", F.col("start") + F.col("i"))
    at = F.struct("none", "doc_id", "th", F.col("begin").alias("start"))
    lowest = wide.groupBy("string").agg(F.min(at).alias("low"), F.count("*").alias("n")).filter("n > 1")
    rest = wide.join(lowest, "string").filter(~at.eqNullSafe(F.col("low"))).select("doc_id", "th", F.col("begin").alias("start"), (F.col("begin") + WIDTH).alias("end"))
    return later.unionByName(merged).unionByName(rest)


@F.arrow_udf(T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
                           T.StructField("kept", T.BinaryType())]))
def _cut(raws: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    data, off = flat(raws)
    for i, (s, e) in enumerate(zip(starts.to_pylist(), ends.to_pylist())):
        raw = data[off[i]:off[i + 1]].tobytes()
        kept, at, removed, runs = [], 0, 0, 0
        for lo, hi in zip(s or (), e or ()):
            kept.append(raw[at:lo])
            removed, runs, at = removed + hi - lo, runs + 1, hi
        rest = b"".join([*kept, raw[at:]])
        out.append((removed, runs, hashlib.sha256(rest).hexdigest(), rest))
    removed, runs, sha, rest = zip(*out) if out else ((), (), (), ())
    return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(rest, pa.binary())],
                                      ["n_removed", "n_spans", "kept_sha256", "kept"])


def merged_spans(stretches: DataFrame) -> DataFrame:
    """One row per document: ``starts`` and ``ends`` of its maximal removed runs, in order."""
    runs = F.expr("""aggregate(sort_array(collect_set(struct(start AS s, end AS e))),
        CAST(array() AS array<struct<s: bigint, e: bigint>>), (acc, x) -> CASE
        WHEN size(acc) > 0 AND element_at(acc, -1).e >= x.s THEN concat(slice(acc, 1, size(acc) - 1),
            array(struct(element_at(acc, -1).s AS s, greatest(element_at(acc, -1).e, x.e) AS e)))
        ELSE concat(acc, array(x)) END)""")
    return stretches.groupBy("doc_id", "th").agg(runs.alias("runs")).select("doc_id", "th", F.col("runs.s").alias("starts"), F.col("runs.e").alias("ends"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept`` (bytes), ``starts``, ``ends`` for each row.

    Removed is each byte covered by a 100-byte string that also starts earlier, in a document of smaller id or before in
    the same one; strings never cross documents and overlaps count. Null text is empty. Null ids come last; documents of
    one id are in order of a hash of their text, and rows alike in id and text are one document. Other columns are not read.
    """
    spans = stage(merged_spans(covered(docs, id_col, text_col)), "removed-spans")
    rows = _documents(docs, id_col, text_col)
    met = rows["th"] == spans["th"]
    joined = rows.join(spans, met & rows["doc_id"].eqNullSafe(spans["doc_id"]), "left").select(rows["doc_id"], "raw", "starts", "ends")
    return joined.withColumn("cut", _cut("raw", "starts", "ends")).select(
        "doc_id", F.length("raw").cast("bigint").alias("n_bytes"), "cut.n_removed", "cut.n_spans", "cut.kept_sha256", "cut.kept", "starts", "ends")
