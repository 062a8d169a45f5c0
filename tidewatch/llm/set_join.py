"""Parts of an exact Jaccard self-join of token sets: hashed sets, token rarity, prefixes, bitmaps, exact intersection.

Rows with equal sets are one node. A node's id is the 64-bit hash of its set, so two different sets share an id with
odds of about n²/2⁶⁵ for n different sets. ``Threshold(num, den)`` stands for Jaccard ≥ num / den.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidewatch.llm.common import BASE, LOWER, MIX_A, MIX_B, SPACE, drop_stage, list_array, mix, prefix_hash, signed, slices, span_hash, spans, stage

N_MINS = 12
SKETCH_BITS, CHUNK = 18, 1 << 12
#: Most bits of a node filter (16 MB); beyond that it lets more rows pass, which later joins remove.
FILTER_BITS = 27
#: Text bytes whose sets a task holds at a time.
SLICE = 1 << 18


@dataclass(frozen=True)
class Threshold:
    num: int
    den: int

    def prefix(self, n):
        """Tokens of a set of n that must hold one of any similar set."""
        return n - (-(-self.num * n // self.den)) + 1

    def index_prefix(self, n):
        """The same for the smaller of two similar sets."""
        return n - (-(-2 * self.num * n // (self.num + self.den))) + 1

    def similar(self, overlap: Column, a: Column, b: Column) -> Column:
        return overlap * (self.num + self.den) >= (a + b) * self.num

    def possible(self, a: str, b: str, x: Column, y: Column, words: int) -> Column:
        """Whether two parity bitmaps of ``words`` longs (``a``, ``b``) of sets of x and y allow similarity: they differ at most in
        as many bits as there are tokens in one set only."""
        return self.possible_longs([F.col(a)[i] for i in range(words)], [F.col(b)[i] for i in range(words)], x, y)

    def possible_longs(self, a: list[Column], b: list[Column], x: Column, y: Column) -> Column:
        """The same for bitmaps whose longs are columns of their own."""
        apart = sum((F.bit_count(one.bitwiseXOR(other)) for one, other in zip(a, b)), F.lit(0))
        return self.similar((x + y - apart) / 2, x, y)


# --- sets of a batch ----------------------------------------------------------------------------------------------------

_WEIGHTS = np.array([pow(BASE, k, 1 << 64) ^ 0x5851F42D4C957F2D | 1 for k in range(1, 9)], np.uint64)


def _word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lowered, split at ASCII white space) and the word offsets of the rows."""
    start, end = spans(SPACE, data, off)
    h = span_hash(prefix_hash(LOWER.take(data)), start, end)
    return h, np.searchsorted(start, off)


class Sets(NamedTuple):
    """Sets of a batch end to end: set i is ``tokens[at[i]:at[i + 1]]``, sorted and distinct, of row ``owner[i]``; ``part`` is its
    number within the row, ``raw`` a hash of its text (lines only)."""
    owner: np.ndarray
    part: np.ndarray
    tokens: np.ndarray
    at: np.ndarray
    raw: np.ndarray | None = None

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.at)

    def reduced(self, step: np.ufunc, values: np.ndarray) -> np.ndarray:
        """``step`` over the values of each set; 0 for an empty one."""
        out, filled = np.zeros(len(self.owner), np.uint64), self.n > 0
        if filled.any():
            out[filled] = step.reduceat(values, self.at[:-1][filled])
        return out

    def picked(self, keep: np.ndarray) -> Sets:
        n = self.n
        return Sets(self.owner[keep], self.part[keep], self.tokens[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep])]),
                    None if self.raw is None else self.raw[keep])

    def ids(self) -> np.ndarray:
        """64-bit hash of each set; 0 for an empty one."""
        s = self.tokens
        h = mix(self.reduced(np.add, mix(s + np.uint64(MIX_A))) ^ self.reduced(np.bitwise_xor, mix(s ^ np.uint64(MIX_B))))
        return np.where(self.n > 0, h, np.uint64(0))

    def parities(self, words: int) -> np.ndarray:
        """Row per set: a bitmap of 64 * ``words`` bits (a power of two), flipped at one place for each token."""
        place = self.tokens >> np.uint64(64 - (64 * words - 1).bit_length())
        bit = np.uint64(1) << (place & np.uint64(63))
        return np.column_stack([self.reduced(np.bitwise_xor, np.where(place >> np.uint64(6) == w, bit, np.uint64(0))) for w in range(words)])


def order_within(key: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """The order by segment, then by key. One sort of numbers that hold segment, leading bits of the key and place does, unless the
    cut-off bits matter."""
    seg_bits, at_bits = int(seg.max(initial=0)).bit_length(), max(0, len(seg) - 1).bit_length()
    if len(seg) and seg_bits + at_bits <= 40:
        short = key >> np.uint64(seg_bits + at_bits) << np.uint64(at_bits) | np.arange(len(seg), dtype=np.uint64)
        if seg_bits:
            short |= seg.astype(np.uint64) << np.uint64(64 - seg_bits)
        short.sort()
        order = (short & np.uint64((1 << at_bits) - 1)).astype(np.int64)
        short >>= np.uint64(at_bits)
        same = np.flatnonzero(short[1:] == short[:-1])
        if not (key[order[same + 1]] < key[order[same]]).any():
            return order
    return np.lexsort((key, seg))


def _distinct(tokens: np.ndarray, seg: np.ndarray, owner: np.ndarray, part: np.ndarray, raw: np.ndarray | None = None) -> Sets:
    order = order_within(tokens, seg)
    tokens, seg = tokens[order], seg[order]
    new = np.ones(len(seg), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (seg[1:] != seg[:-1])
    return Sets(owner, part, tokens[new], np.concatenate([[0], np.cumsum(np.bincount(seg[new], minlength=len(owner)))]), raw)


def _lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines (pieces between line feeds) of all rows, and the first line of each row (n + 1 numbers)."""
    feeds = np.flatnonzero(data == 10)
    first = np.searchsorted(feeds, off) + np.arange(len(off))
    start, end = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    opens = np.zeros(first[-1] + 1, bool)
    opens[first] = True
    start[first[:-1]], end[first[1:] - 1] = off[:-1], off[1:]
    start[~opens[:-1]], end[~opens[1:]] = feeds + 1, feeds
    return start, end, first


def line_sets(data: np.ndarray, off: np.ndarray) -> Sets:
    """Word hashes of every line (pieces between line feeds, numbered from 0) of each row."""
    start, end = spans(SPACE, data, off)
    hashed = prefix_hash(LOWER.take(data))
    lo, hi, first = _lines(data, off)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
    seg = np.repeat(np.arange(len(hi)), np.diff(np.searchsorted(start, hi), prepend=0))
    return _distinct(span_hash(hashed, start, end), seg, owner, np.arange(len(owner)) - first[owner], span_hash(hashed, lo, hi))


def wanted_lines(data: np.ndarray, off: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines whose ``raw`` hash is in the filter ``words``, end to end, and their n + 1 offsets. No other line is cut into words."""
    lo, hi, _ = _lines(data, off)
    keep = in_filter(span_hash(prefix_hash(LOWER.take(data)), lo, hi), words)
    lo, n = lo[keep], (hi - lo)[keep]
    at = np.concatenate([[0], np.cumsum(n)])
    return data[np.arange(at[-1]) + np.repeat(lo - at[:-1], n)], at


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = 5) -> Sets:
    """Hashes of the word shingles of each row; a row of fewer words has one, the whole."""
    h, at = _word_hashes(data, off)
    whole = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        whole += h[k:k + len(whole)] * _WEIGHTS[k]
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(whole)) + size <= at[row[:len(whole)] + 1]
    tokens, seg = [mix(whole[inside])], [row[:len(whole)][inside]]
    for r in np.flatnonzero((n > 0) & (n < size)):
        w = h[at[r]:at[r + 1]]
        tokens.append(mix((w * _WEIGHTS[:len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w))))
        seg.append(np.array([r]))
    return _distinct(np.concatenate(tokens), np.concatenate(seg), np.arange(len(n)), np.zeros(len(n), np.int64))


_SEEDS = mix(np.arange(1, N_MINS + 1, dtype=np.uint64) * np.uint64(BASE))


def first_pass(items: DataFrame, keys: list[str], sets: Callable, name: str, words: int, mins: int = N_MINS, part: str | None = None) -> DataFrame:
    """Written table with one row per set (``keys``, its number ``part`` within the row and the hash ``raw`` of its text if there are
    several, ``n``, ``node``, ``mins``, and ``bits``, a parity bitmap of ``words`` longs; for parts, which are many and short, these are
    plain columns ``m0``, ``m1``..., ``b0``, ``b1``...) and the token counts of each task in chunks (``chunk``, ``counts``; the other
    columns are null then)."""
    schema = items.select(*keys).schema
    longs = [f"{c} bigint" for c in (*[f"m{i}" for i in range(mins)], *[f"b{i}" for i in range(words)])] if part else ["mins array<bigint>", "bits array<bigint>"]
    added = T.StructType.fromDDL(", ".join([*[f"{part} int", "raw bigint"][:2 * bool(part)], "n bigint", "node bigint", *longs, "chunk int", "counts binary"]))
    names, kind = [*keys, *added.names], pa.int64() if part else pa.list_(pa.int64())

    def columns(values: np.ndarray) -> list[pa.Array]:
        rows, width = values.shape
        if part:
            return [pa.array(signed(v)) for v in values.T]
        return [list_array(signed(values).ravel(), np.arange(rows + 1) * width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kinds = np.zeros(1 << SKETCH_BITS, np.int64), None
        for batch, data, off in slices(batches, "text", SLICE):
            kinds = [batch.column(i).type for i in range(len(keys))]
            s = sets(data, off)
            np.add.at(seen, (s.tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            rows = len(s.owner)
            low = np.column_stack([s.reduced(np.minimum, mix(s.tokens ^ seed)) for seed in _SEEDS[:mins]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(pa.array(s.owner)) for i in range(len(keys))] + ([pa.array(s.part.astype(np.int32)), pa.array(signed(s.raw))] if part else []) +
                [pa.array(s.n.astype(np.int64)), pa.array(signed(s.ids())), *columns(low), *columns(s.parities(words)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if kinds is not None:
            parts = seen.reshape(-1, CHUNK)
            c = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(c, k) for k in [*kinds, *[pa.int32(), pa.int64()][:2 * bool(part)], pa.int64(), pa.int64(), *[kind] * len(longs)]] +
                [pa.array(range(c), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in [*schema.fields, *added.fields]])
    return stage(items.select(*keys, "text").mapInArrow(run, schema), name)


def add_up(chunks: DataFrame, join: Callable = np.add) -> np.ndarray:
    """Element-wise sum (or other ufunc) of the int64 ``counts`` of each ``chunk``, streamed; the whole goes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = np.frombuffer(raw, np.int64)
                total[c] = join(total[c], one) if c in total else one
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()])], ["chunk", "counts"])

    summed = chunks.select("chunk", "counts").repartition(16, "chunk").mapInArrow(run, "chunk int, counts binary")
    found = {r.chunk: np.frombuffer(r.counts, np.int64) for r in summed.collect()}          # a sketch of fixed size
    return np.concatenate([found[c] for c in sorted(found)]) if found else np.zeros(0, np.int64)


def rarity(first: DataFrame) -> np.ndarray:
    """Rarity class of each token bucket (2^18 small numbers), counted over all items: larger is more frequent."""
    counts = add_up(first.filter("chunk is not null"))
    counts = counts if len(counts) else np.zeros(1 << SKETCH_BITS, np.int64)
    return np.floor(2 * np.log2(counts + 1)).astype(np.uint8)


def node_filter(nodes: DataFrame, column: str = "node") -> np.ndarray:
    """Bit filter (uint64 words) of the values of ``column``: 16 bits for each, between 2^18 and 2^27 bits.

    A value sets two bits of one block; the values are dealt by block, so a task builds its blocks alone."""
    n = nodes.count()
    bits = min(FILTER_BITS, max(18, int(16 * max(1, n) - 1).bit_length()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((_places(x, bits)[0] >> np.uint64(18)).astype(np.int32)), batch.column(0)], ["chunk", "x"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            x = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for c in np.unique(chunk):
                flags = blocks.setdefault(int(c), np.zeros(1 << 18, bool))
                for at in _places(x[chunk == c], bits):
                    flags[(at & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        for c, flags in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()])], ["chunk", "bits"])

    made = (nodes.select(column).mapInArrow(deal, "chunk int, x bigint").repartition(16, "chunk")
            .mapInArrow(build, "chunk int, bits binary").collect())                        # at most 2^27 bits
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in made:
        out[r.chunk << 12:(r.chunk + 1) << 12] = np.frombuffer(r.bits, np.uint64)
    return out


def _places(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at = mix(x) >> np.uint64(64 - bits)
    low = np.uint64((1 << 18) - 1)
    return at, (at & ~low) | (mix(x ^ np.uint64(MIX_B)) & low)


def in_filter(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    bits = int(len(words) * 64 - 1).bit_length()
    ok = np.ones(len(x), bool)
    for at in _places(x, bits):
        ok &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


# --- later passes over the texts ----------------------------------------------------------------------------------------

class _Seen:
    """Node ids met in this task; forgotten when they are many, which only costs repeated rows."""

    def __init__(self, most: int = 400_000):
        self.ids, self.most = set(), most

    def new(self, nodes: np.ndarray) -> np.ndarray:
        """Which of the nodes come up for the first time."""
        first, ids = np.zeros(len(nodes), bool), self.ids
        for i, node in enumerate(nodes.tolist()):
            if node not in ids:
                if len(ids) >= self.most:
                    ids.clear()
                ids.add(node)
                first[i] = True
        return first


def _prefixes(batches: Iterator[pa.RecordBatch], sets: Callable, levels: np.ndarray, t: Threshold) -> Iterator[tuple[Sets, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sets (each node once, unless forgotten), their ids, and the tokens of their prefixes, rare ones first, with set and position of each."""
    level, seen = levels.astype(np.uint64), _Seen()
    for _, data, off in slices(batches, "text", SLICE):
        s = sets(data, off)
        ids, keep = s.ids(), s.n > 0
        keep[keep] = seen.new(ids[keep])
        s, ids = s.picked(keep), ids[keep]
        if not len(ids):
            continue
        seg = np.repeat(np.arange(len(ids)), s.n)
        key = (level[(s.tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(56)) | (s.tokens >> np.uint64(8))
        pos = np.arange(len(seg)) - s.at[seg]
        near = pos < t.prefix(s.n)[seg]
        yield s, ids, s.tokens[order_within(key, seg)[near]], seg[near], pos[near]


def prefix_tokens(items: DataFrame, sets: Callable, levels: np.ndarray, t: Threshold) -> DataFrame:
    """``token``, ``pos``, ``n``, ``node`` of the prefix of each set, rare tokens first. Nodes may come more than once."""
    shipped = items.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, ids, tokens, seg, pos in _prefixes(batches, sets, shipped.value, t):
            yield pa.RecordBatch.from_arrays([pa.array(signed(tokens)), pa.array(pos.astype(np.int32)), pa.array(s.n[seg].astype(np.int32)),
                                              pa.array(signed(ids[seg]))], ["token", "pos", "n", "node"])

    return items.select("text").mapInArrow(run, "token bigint, pos int, n int, node bigint")


def prefix_lists(items: DataFrame, sets: Callable, levels: np.ndarray, t: Threshold, words: int, name: str, wanted: DataFrame | None = None) -> DataFrame:
    """Written table ``node``, ``n``, ``tokens`` (the prefix of the set as one list, rare tokens first) and the longs ``b0``, ``b1``...
    of a parity bitmap. Nodes may come more than once. With ``wanted`` also ``whole``: all tokens (sorted) of the nodes of that
    table and of a few others; null for the rest."""
    context = items.sparkSession.sparkContext
    shipped, picked = context.broadcast(levels), context.broadcast(None if wanted is None else node_filter(wanted))
    longs = [f"b{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, ids, tokens, seg, _ in _prefixes(batches, sets, shipped.value, t):
            columns = {"node": pa.array(signed(ids)), "n": pa.array(s.n.astype(np.int32)),
                       "tokens": list_array(signed(tokens), np.searchsorted(seg, np.arange(len(ids) + 1)))}
            columns |= {name: pa.array(signed(b)) for name, b in zip(longs, s.parities(words).T)}
            if picked.value is not None:
                keep = in_filter(ids, picked.value)
                at = np.concatenate([[0], np.cumsum(np.where(keep, s.n, 0))])
                columns["whole"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(signed(s.picked(keep).tokens)), mask=pa.array(~keep))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "node bigint, n int, tokens array<bigint>" + "".join(f", {b} bigint" for b in longs) + ", whole array<bigint>" * (wanted is not None)
    return stage(items.select("text").mapInArrow(run, schema), name)


def with_heads(rows: DataFrame, size: int = 4) -> DataFrame:
    """``rows`` (``token``, ``pos``, ``node``) with ``head``: the first tokens of the node among these rows.

    Only these are collected, so a row of a long text carries no more than a row of a short one."""
    own = W.partitionBy("node").orderBy("pos")
    first = F.when(F.row_number().over(own) <= size, F.col("token"))
    return rows.withColumn("_first", first).withColumn("head", F.collect_list("_first").over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).drop("_first")


def met_before(x_head: str = "x_head", y_head: str = "y_head", token: str = "token") -> Column:
    """Whether the heads of two nodes share a token before this one. Such a pair comes up at that token as well, so it can
    be left out here: its first common token is never left out, and that one passes all bounds if the pair is similar."""
    return F.coalesce(F.get(F.array_intersect(x_head, y_head), 0) != F.col(token), F.lit(False))


def bitmap(s: np.ndarray, fine: bool = False) -> np.ndarray:
    """Parity bitmap of a set, flipped at one place for each token: about one bit a token (64 to 4096 bits, a power of
    two), or eight and more (``fine``), which leaves few tokens that cancel out."""
    bits = max(6, int(len(s) - 1).bit_length())
    bits = bits + 3 if fine else min(12, bits)
    return np.packbits(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8) & 1)


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the larger folded to the size of the smaller: at most the tokens in one set only."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):                                    # neighbours share their leading hash bits
        bits = np.unpackbits(y).reshape(len(x) * 8, -1)
        y = np.packbits(np.bitwise_xor.reduce(bits, axis=1))
    return int(np.bitwise_count(x ^ y).sum())


def sets_of(items: DataFrame, nodes: DataFrame, sets: Callable, name: str, whole: bool) -> DataFrame:
    """Written table ``node``, ``n`` and ``bits`` of the given nodes, or ``tokens`` (sorted) and fine ``bits`` (``whole``);
    the texts are scanned, not moved. The table may have a few other nodes as well."""
    shipped = items.sparkSession.sparkContext.broadcast(node_filter(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shipped.value, _Seen()
        for _, data, off in slices(batches, "text", SLICE):
            s = sets(data, off)
            ids = s.ids()
            keep = (s.n > 0) & in_filter(ids, wanted)
            keep[keep] = seen.new(ids[keep])
            if not keep.any():
                continue
            s, ids = s.picked(keep), ids[keep]
            columns = {"node": pa.array(signed(ids)), "n": pa.array(s.n.astype(np.int32)),
                       "bits": pa.array([bitmap(s.tokens[lo:hi], whole).tobytes() for lo, hi in zip(s.at[:-1], s.at[1:])], pa.binary())}
            if whole:
                columns["tokens"] = list_array(signed(s.tokens), s.at)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    found = items.select("text").mapInArrow(run, "node bigint, n int, bits binary" + ", tokens array<bigint>" * whole)
    return stage(found.dropDuplicates(["node"]), name)


def sets_of_lines(items: DataFrame, raws: DataFrame, name: str) -> DataFrame:
    """Written table ``node``, ``n`` and ``tokens`` (sorted) of the lines with the given ``raw`` hashes, and of a few others."""
    shipped = items.sparkSession.sparkContext.broadcast(node_filter(raws, "raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for _, data, off in slices(batches, "text", SLICE):
            s = line_sets(*wanted_lines(data, off, shipped.value))
            ids = s.ids()
            keep = s.n > 0
            keep[keep] = seen.new(ids[keep])
            if not keep.any():
                continue
            s, ids = s.picked(keep), ids[keep]
            yield pa.RecordBatch.from_arrays([pa.array(signed(ids)), pa.array(s.n.astype(np.int32)), list_array(signed(s.tokens), s.at)], ["node", "n", "tokens"])

    return stage(items.select("text").mapInArrow(run, "node bigint, n int, tokens array<bigint>").dropDuplicates(["node"]), name)


@F.arrow_udf(T.IntegerType())
def _bits_apart(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([differing_bits(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


@F.arrow_udf(T.IntegerType())
def _overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    (x, xo), (y, yo) = [(c.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))])) for c in (a, b)]
    out = np.zeros(len(a), np.int32)
    for i in range(len(a)):
        s, o = x[xo[i]:xo[i + 1]], y[yo[i]:yo[i + 1]]
        if len(s) > len(o):
            s, o = o, s
        at = np.searchsorted(o, s)                         # both are sorted: a merge by binary search
        out[i] = np.count_nonzero(o[np.minimum(at, len(o) - 1)] == s)
    return pa.array(out)


def _with_sides(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    left = table.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col(value).alias("va"))
    right = table.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col(value).alias("vb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b")


def ends_of(pairs: DataFrame, name: str, a: str = "a", b: str = "b", end: str = "node") -> DataFrame:
    first = pairs.select(F.col(a).alias(end)).distinct()
    return stage(first.unionByName(pairs.select(F.col(b).alias(end)).distinct()).distinct(), name)


def _allowed(pairs: DataFrame, marks: DataFrame, t: Threshold, name: str) -> DataFrame:
    """The ``a``, ``b`` of ``pairs`` whose bit counts allow the threshold; written."""
    apart = _with_sides(pairs, marks, "bits").withColumn("apart", _bits_apart("va", "vb"))
    return stage(apart.filter(t.similar((F.col("na") + F.col("nb") - F.col("apart")) / 2, F.col("na"), F.col("nb"))).select("a", "b"), name)


def bounded(pairs: DataFrame, items: DataFrame, sets: Callable, t: Threshold, name: str) -> tuple[DataFrame, DataFrame]:
    """The ``a``, ``b`` of ``pairs`` (written; removed afterwards) whose bit counts allow the threshold, and the sorted
    arrays of their ends. Both are written. Short bitmaps judge all pairs, eight times longer ones those that are left."""
    ends = ends_of(pairs, name + "-nodes")
    marks = sets_of(items, ends, sets, name + "-bits", whole=False)
    near = _allowed(pairs, marks, t, name + "-bounded")
    drop_stage(ends, marks, pairs)
    ends = ends_of(near, name + "-close")
    arrays = sets_of(items, ends, sets, name + "-sets", whole=True)
    close = _allowed(near, arrays, t, name + "-closer")
    drop_stage(ends, near)
    return close, arrays


def _meeting(pairs: DataFrame, arrays: DataFrame, t: Threshold) -> DataFrame:
    full = _with_sides(pairs, arrays, "tokens").withColumn("overlap", _overlap("va", "vb"))
    return full.filter(t.similar(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b")


def intersected(pairs: DataFrame, arrays: DataFrame, t: Threshold, name: str) -> DataFrame:
    """The ``a``, ``b`` of ``pairs`` that reach the threshold, by intersection of their sorted arrays; written."""
    ends = ends_of(pairs, name + "-ends")
    moved = arrays.select("node", "n", "tokens").join(ends, "node", "left_semi")
    found = stage(_meeting(pairs, moved, t), name)
    drop_stage(ends)
    return found


def verified(pairs: DataFrame, items: DataFrame, sets: Callable, t: Threshold, name: str) -> DataFrame:
    """The ``a``, ``b`` of ``pairs`` (written; removed afterwards) that reach the threshold. Bit counts bound the overlap
    from above before the sorted arrays are fetched and intersected."""
    near, arrays = bounded(pairs, items, sets, t, name)
    out = intersected(near, arrays, t, name)
    drop_stage(near, arrays)
    return out


def verified_lines(pairs: DataFrame, items: DataFrame, t: Threshold, name: str) -> DataFrame:
    """The ``a``, ``b`` of pairs of lines (written; removed afterwards; ``raw_a``, ``raw_b``: hashes of a text of each) that reach the
    threshold. Only lines with these hashes are cut into words."""
    ends = ends_of(pairs, name + "-texts", "raw_a", "raw_b", "raw")
    arrays = sets_of_lines(items, ends, name + "-sets")
    out = stage(_meeting(pairs, arrays, t), name)
    drop_stage(pairs, ends, arrays)
    return out


def verified_listed(pairs: DataFrame, lists: DataFrame, t: Threshold, name: str) -> DataFrame:
    """The ``a``, ``b`` of pairs of nodes (written; removed afterwards) that reach the threshold; ``lists`` has their sets as ``whole``."""
    found = lists.filter("whole is not null").select("node", "n", F.col("whole").alias("tokens"))
    arrays = stage(found.dropDuplicates(["node"]), name + "-sets")
    out = stage(_meeting(pairs, arrays, t), name)
    drop_stage(pairs, arrays)
    return out


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Written table ``node``, ``comp`` (smallest node reachable) of the nodes of ``links`` (``a``, ``b``).

    Alternating large-star and small-star steps: each is one grouping with a map-side minimum and one equi-join, and the
    number of rounds is logarithmic. The loop stops when a round changes nothing.
    """
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    rounds = 0
    while True:
        # large star: every larger neighbour of u goes to the smallest node of u's neighbourhood
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        done = stage(small, f"{name}-{rounds}")
        change = done.join(edges, ["u", "v"], "left_anti").isEmpty() and done.count() == edges.count()
        drop_stage(edges)
        edges, rounds = done, rounds + 1
        if change:
            break
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(own)
