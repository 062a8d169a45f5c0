"""Hard negatives: rows of another label whose score lies just below that of a positive.

Scores are inner products of whole numbers, found by a matrix product in a residue number system: both matrices are reduced
modulo a few small primes, to residues around zero, and multiplied in float32, where sums below 2^24 are exact; the signed
score follows from its residues by Chinese remaindering in mixed radix. There are as many primes as the largest possible
score needs, which is the largest squared length of a row.

Anchors are taken in blocks of bounded size, and each block is held against all rows twice: first for its positives, then,
with their scores known, for the negatives in the window of each. A task keeps the first few per anchor, packed in one row
per ``GROUP`` anchors, so what is shuffled does not grow with the pairs.

* rows with a null label, a null vector, or a null or non-finite component take no part; neither do rows whose squared
  length is ``LONGEST`` or more (a score of theirs need not fit 64 bits) or that have another length than the anchor
* rows of the anchor's id are not "other rows"; repeated rows otherwise count as rows of their own, also as anchors
* equal scores go by id, null ids last; an anchor without another row of its label has no result
* extra columns are left out
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import drop_stage, stage
from tidewatch.session import new_folder

#: The largest primes below 2^8; residues of -125..125 leave room for 1,073 products in one float32 sum.
PRIMES = [p for p in range(255, 2, -2) if all(p % d for d in range(3, 16, 2))]
#: Squared length from which a row takes no part.
LONGEST = 1 << 59
#: Anchors of a block: their numbers are held by every Python worker. Anchors of a packed row; rows that are multiplied at a time.
BLOCK_NUMBERS, GROUP, ROWS = 1 << 21, 64, 2_048


def moved_label(n_labels: int) -> Column:
    """Label noise: the next label where the id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % n_labels).otherwise(F.col("label"))


def primes_for(bound: int) -> list[int]:
    """As many primes as make every whole number from -bound to bound distinct."""
    out, product = [], 1
    while product <= 2 * max(bound, 1):
        out.append(PRIMES[len(out)])
        product *= out[-1]
    return out


def residue(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers (of any numeric type) modulo p, as -(p-1)/2 .. (p-1)/2."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r)


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [residue(x, p).astype(np.float32) for p in primes]


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo p; the sum is reduced before it can reach 2^24."""
    step, total = (1 << 24) // (p // 2) ** 2, None
    for at in range(0, a.shape[1], step):
        part = residue(a[:, at:at + step] @ b[:, at:at + step].T, p)
        total = part if total is None else residue(total + part, p)
    return np.zeros((len(a), len(b)), np.float32) if total is None else total


def reconstruct(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed numbers from their residues: digits of a mixed radix, each between -(p-1)/2 and (p-1)/2."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        d = parts[i].astype(np.int64)
        for j, q in enumerate(primes[:i]):
            d = residue((d - digits[j]) * pow(q, -1, p), p)
        digits.append(residue(d, p))
    out = np.zeros_like(digits[0])
    for d, p in zip(reversed(digits), reversed(primes)):
        out = out * p + d                              # may pass 2^63 in between, never at the end
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    return reconstruct([product_mod(x, y, p) for x, y, p in zip(a, b, primes)], primes)


# --- rows ------------------------------------------------------------------------------------------------------------

def whole_rows(vectors: DataFrame, anchor: Column, vec_id: str, embedding: str, label: str) -> DataFrame:
    """Rows that take part: ``id``, ``label``, ``x`` (floor of 256 times each component, as double), ``anchor``."""
    x = F.transform(embedding, lambda c: F.floor(c.cast("double") * 256).cast("double"))
    fine = F.forall(embedding, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    # floor of a double is a long that stops at 2^63; such a component is past LONGEST by itself
    return (vectors.filter(F.col(label).isNotNull() & F.col(embedding).isNotNull() & fine)
            .select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), x.alias("x"),
                    F.coalesce(anchor, F.lit(False)).alias("anchor"))
            .withColumn("square", F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)).filter(F.col("square") < float(LONGEST)))


class Anchors:
    """A block of anchors of one vector length, and from the second round on the scores of their positives."""

    def __init__(self, rows: list[tuple], bound: int) -> None:
        self.ids, self.labels = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
        self.dims, self.primes = len(rows[0][2]), primes_for(bound)
        self.parts = residues(np.array([r[2] for r in rows], np.float64).reshape(len(rows), self.dims), self.primes)
        # the value stands for "no id"; null ids are never equal
        self.key = np.array([-1 if i is None else i for i in self.ids], np.int64)
        self.null = np.array([i is None for i in self.ids], bool)


def _tables(batches: Iterator[pa.RecordBatch], anchors: Anchors) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, same-label mask and scores (anchors × rows) of a few thousand rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            part = part.filter(pc.equal(pc.list_value_length(part["x"]), anchors.dims))
            if not part.num_rows:
                continue
            ids, labels = part["id"].to_pylist(), part["label"].to_numpy()
            x = part["x"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, anchors.dims)
            yield ids, labels[None, :] == anchors.labels[:, None], scores(anchors.parts, residues(x, anchors.primes), anchors.primes)


class Few:
    """The first k entries (higher score, then smaller id, null ids last) of many lists."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.kept, self.full = k, [[] for _ in range(n)], np.full(n, np.iinfo(np.int64).min)

    def offer(self, at: int, score: np.ndarray, ids: list, mask: np.ndarray) -> None:
        where = np.flatnonzero(mask & (score >= self.full[at]))
        if len(where) > 4 * self.k:                    # what lies below the k-th score of these rows cannot be kept
            s = score[where]
            where = where[s >= np.partition(s, len(s) - self.k)[len(s) - self.k]]
        if len(where):
            new = [(-int(score[i]), ids[i] is None, ids[i] or 0) for i in where]
            self.kept[at] = nsmallest(self.k, self.kept[at] + new)
            if len(self.kept[at]) == self.k:
                self.full[at] = -self.kept[at][-1][0]


def _packed(found: Few, per: int) -> Iterator[pa.RecordBatch]:
    """One row per ``per`` lists: numbers of lists with the entries kept for them."""
    for lo in range(0, len(found.kept), per):
        flat = [(i, -s, key, null) for i in range(lo, min(lo + per, len(found.kept))) for s, null, key in found.kept[i]]
        if flat:
            columns = [pa.array([[r[c] for r in flat]], pa.list_(t)) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([pa.array([lo // per], pa.int64()), *columns], ["part", "list", "score", "id", "null"])


_PACKED = "part bigint, list array<int>, score array<bigint>, id array<bigint>, null array<boolean>"


def _first_of_each(partial: DataFrame, k: int) -> DataFrame:
    """Entries of packed rows merged per group of lists: ``list``, ``place`` from 1, ``score``, ``id`` (null where none)."""
    def merge(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in tables:
            for r in batch.to_pylist():
                entries = zip(r["list"], r["score"], r["null"], r["id"])
                for i, some in groupby(entries, key=lambda e: e[0]):
                    kept[i] = nsmallest(k, [*kept.get(i, ()), *((-s, null, x) for _, s, null, x in some)])
        rows = [(i, n + 1, -s, None if null else x) for i, some in sorted(kept.items()) for n, (s, null, x) in enumerate(some)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                                         ["list", "place", "score", "id"])

    return partial.groupBy("part").applyInArrow(merge, "list int, place int, score bigint, id bigint")


def _search(rows: DataFrame, anchors: Anchors, k: int, wanted: int, each) -> DataFrame:
    """``each(found, ids, same, table)`` offers rows to ``wanted`` lists per anchor; the first k of every list come back."""
    held = rows.sparkSession.sparkContext.broadcast((anchors, each))      # at most BLOCK_NUMBERS numbers a prime

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, offer = held.value
        found = Few(len(mine.ids) * wanted, k)
        for ids, same, table in _tables(batches, mine):
            offer(found, ids, same, table)
        yield from _packed(found, GROUP * wanted)

    return _first_of_each(rows.select("id", "label", "x").mapInArrow(run, _PACKED), k)


class Positives:
    """Offers other rows of the anchor's label."""

    def __init__(self, anchors: Anchors) -> None:
        self.key, self.null = anchors.key, anchors.null

    def __call__(self, found: Few, ids: list, same: np.ndarray, table: np.ndarray) -> None:
        key, null = np.array([-1 if i is None else i for i in ids]), np.array([i is None for i in ids], bool)
        for a in range(len(table)):
            own = (key == self.key[a]) & ~null & ~self.null[a]
            found.offer(a, table[a], ids, same[a] & ~own)


class Window:
    """Offers rows of other labels to each positive whose window holds their score: low·positive ≤ high·score ≤ high·positive."""

    def __init__(self, per: int, positive: list[list[int]], low: int, high: int) -> None:
        self.per, self.positive, self.low, self.high = per, positive, low, high

    def __call__(self, found: Few, ids: list, same: np.ndarray, table: np.ndarray) -> None:
        for a, positive in enumerate(self.positive):
            for i, p in enumerate(positive):
                least = -(-self.low * p // self.high)     # the least whole score of the window
                if least <= p:
                    found.offer(a * self.per + i, table[a], ids, ~same[a] & (table[a] <= p) & (table[a] >= least))


def _blocks(rows: DataFrame) -> Iterator[list[tuple]]:
    """Anchors of one vector length, read partition by partition, as many as BLOCK_NUMBERS allows."""
    held: dict[int, list] = {}
    for r in rows.filter("anchor").select("id", "label", "x").toLocalIterator():
        block = held.setdefault(len(r["x"]), [])
        block.append((r["id"], r["label"], r["x"]))
        if len(block) * max(1, len(r["x"])) >= BLOCK_NUMBERS:
            yield held.pop(len(r["x"]))
    yield from held.values()


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label: the first ``negatives`` rows of other labels
    that score from ``low / high`` of the positive's score up to that score (none for a negative score, where that is empty)."""
    spark = vectors.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    path = new_folder(spark, "negatives")
    spark.createDataFrame([], schema).write.parquet(path)
    rows = stage(whole_rows(vectors, anchor, vec_id, embedding, label), "vectors")
    bound = int(rows.agg(F.max("square")).first()[0] or 0)
    for block in _blocks(rows):
        anchors = Anchors(block, bound)
        first = _search(rows, anchors, positives, 1, Positives(anchors)).orderBy("list", "place").collect()   # a few per anchor of the block
        found: list[list] = [[] for _ in block]
        for r in first:
            found[r["list"]].append((r["id"], r["score"]))
        window = Window(positives, [[s for _, s in some] for some in found], low, high)
        after = _search(rows, anchors, negatives, positives, window)
        pairs = [(a * positives + i, block[a][0], p, s) for a, some in enumerate(found) for i, (p, s) in enumerate(some)]
        pairs = spark.createDataFrame(pairs, "list int, anchor_id bigint, positive_id bigint, positive_score bigint")
        after.join(pairs, "list").select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"),
                                         "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    drop_stage(rows)
    return spark.read.schema(schema).parquet(path)
