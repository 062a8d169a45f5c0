"""Ranked lexical search: exact inner products by ball trees.

A document's coordinate for a term is the whole number ``(10^9 tf) div (1000 tf + 8 m)``; a question's is its weight times
how often the question has the term. Scores are sums of whole numbers, so no rounding decides a rank.

Questions are taken in blocks of bounded size, and each block is held against all documents:

1. one pass over the texts counts terms. Coordinates of terms that no question of the block has cannot change a score; they
   are left out, which also makes the balls smaller. Up to ``TREE_DOCS`` documents are packed into one row
2. a tree is made of each row by halving the documents between two that lie far apart. A node has a centre (the mean,
   rounded to float32) and a radius around it, rounded up
3. from each root one leaf is reached, always by the child of the better bound; the scores there give a floor, which is a
   lower bound of a question's k-th best score
4. nodes are visited best bound first; a subtree goes unseen if its bound ``y·c + |y| r`` (terms no document of the node
   has left out) lies below the k-th best score known. Leaves are scored in 64-bit integers

Scores must be below 2^63: about 10^8 terms a question.

* a null or empty text, or one without terms, is in no result and does not count as a document; a question without terms
  has no result
* equal scores go by document id, null ids last; copies of a row rank as rows of their own, and so do repeated questions
* a text of any length is counted whole; extra columns of either table are left out
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.common import drop_stage, in_bytes, stage
from tidewatch.session import new_folder

#: Letters, digits and everything beyond ASCII, as bytes of UTF-8.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Documents of a tree and of a leaf, and the terms of the questions that a tree holds at most before it is closed.
TREE_DOCS, LEAF_DOCS, TREE_TERMS = 1_024, 32, 1 << 19
#: Questions of a block, and the bound of questions times terms of all of them: the size of the tables in a Python worker.
BLOCK_ITEMS, BLOCK_CELLS = 256, 1 << 21
#: Unit roundoff; a sum of n non-negative products in doubles is off by less than (n + 2) times that.
EPS = 2.0 ** -52


def count_terms(text: bytes | None) -> Counter:
    """How often each term occurs; only A-Z are lower-cased. Long texts are walked a part of their terms at a time."""
    text = (text or b"").lower()
    if len(text) <= 1 << 22:
        return Counter(_TERM.findall(text))
    out, found = Counter(), (m.group() for m in _TERM.finditer(text))
    while some := list(islice(found, 100_000)):
        out.update(some)
    return out


def saturated(tf: np.ndarray, starts: np.ndarray, lengths: list[int], docs: int, terms: int) -> np.ndarray:
    """Coordinates: ``m = 25 + (75 n docs) div terms`` slows the growth of a coordinate in long documents."""
    m = np.array([25 + 75 * n * docs // terms for n in lengths], np.int64)
    return 1_000_000_000 * tf // (1_000 * tf + 8 * np.repeat(m, np.diff(starts)))


def weight(docs: int, df: int) -> int:
    return math.floor(1_000 * math.log((2 * docs + 2) / (2 * df + 1)))


# --- 1: documents as rows of coordinates ----------------------------------------------------------------------------

_PACKED = ("n_docs bigint, n_terms bigint, doc_ids array<bigint>, lengths array<bigint>, starts array<int>, terms array<int>, "
           "tf array<bigint>")


def pack(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Rows of up to ``TREE_DOCS`` documents that have a term of the vocabulary, and the counts of all documents read for them."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)          # at most BLOCK_CELLS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        n_docs, n_terms, ids, lengths, starts, terms, tf = 0, 0, [], [], [0], [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                pa.array([starts], pa.list_(pa.int32())), pa.array([terms], pa.list_(pa.int32())), pa.array([tf], pa.list_(pa.int64()))],
                ["n_docs", "n_terms", "doc_ids", "lengths", "starts", "terms", "tf"])

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = count_terms(body.as_py())
                if not counts:
                    continue
                n = counts.total()
                n_docs, n_terms = n_docs + 1, n_terms + n
                mine = sorted((number[t], c) for t, c in counts.items() if t in number)
                if not mine:
                    continue
                ids.append(key), lengths.append(n)
                terms.extend(t for t, _ in mine), tf.extend(c for _, c in mine)
                starts.append(len(terms))
                if len(ids) == TREE_DOCS or len(terms) >= TREE_TERMS:
                    yield row()
                    n_docs, n_terms, ids, lengths, starts, terms, tf = 0, 0, [], [], [0], [], []
        if n_docs:
            yield row()

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), in_bytes(text).alias("text")).mapInArrow(run, _PACKED)


# --- 2: ball trees --------------------------------------------------------------------------------------------------

_TREE = ("doc_ids array<bigint>, starts array<int>, terms array<int>, value array<int>, lo array<int>, hi array<int>, left array<int>, "
         "radius array<double>, centre_starts array<int>, centre_terms array<int>, centre array<float>")


def reorder(starts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of rows put in a new order, and where their entries were."""
    size = np.diff(starts)[order]
    new = np.concatenate([[0], np.cumsum(size)])
    return new, np.repeat(starts[:-1][order] - new[:-1], size) + np.arange(new[-1])


def row_dot(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of each row's values; no row is empty."""
    return np.add.reduceat(values, starts[:-1])


def build_tree(starts: np.ndarray, terms: np.ndarray, x: np.ndarray, n_dims: int) -> tuple[np.ndarray, list[tuple]]:
    """Order of the documents and the nodes (lo, hi, left child or -1, radius, centre terms, centre); a right child follows the left.

    A radius holds for the centre as it is stored. Squared distances are |x|² - 2 x·c + |c|², whose rounding error is at
    most the number of terms times EPS of the three parts; that much is added before the root.
    """
    order, nodes = np.arange(len(starts) - 1), [None]
    norm = row_dot(starts, x * x)
    point = np.zeros(n_dims)

    def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s, at = reorder(starts, rows)
        return s, terms[at], x[at]

    def distance(s: np.ndarray, t: np.ndarray, v: np.ndarray, rows: np.ndarray, ct: np.ndarray, cv: np.ndarray) -> np.ndarray:
        point[ct] = cv
        cc, dot = float(cv @ cv), row_dot(s, v * point[t])
        point[ct] = 0
        return np.maximum(norm[rows] - 2 * dot + cc, 0) + (np.diff(s) + len(ct) + 8) * EPS * (norm[rows] + 2 * dot + cc)

    todo = [(0, 0, len(order))]
    while todo:
        at, lo, hi = todo.pop()
        rows = order[lo:hi]
        s, t, v = entries(rows)
        total = np.bincount(t, weights=v, minlength=n_dims)
        ct = np.flatnonzero(total)
        cv = (total[ct] / (hi - lo)).astype(np.float32)
        far = distance(s, t, v, rows, ct, cv.astype(np.float64))
        radius = math.sqrt(far.max()) * (1 + 8 * EPS)
        left = -1
        if hi - lo > LEAF_DOCS and radius > 0:
            i = int(far.argmax())
            to_i = distance(s, t, v, rows, t[s[i]:s[i + 1]], v[s[i]:s[i + 1]])
            j = int(to_i.argmax())
            nearer = to_i - distance(s, t, v, rows, t[s[j]:s[j + 1]], v[s[j]:s[j + 1]])
            half = (hi - lo) // 2
            order[lo:hi] = rows[np.argpartition(nearer, half)]
            left = len(nodes)
            nodes += [None, None]
            todo += [(left, lo, lo + half), (left + 1, lo + half, hi)]
        nodes[at] = (lo, hi, left, radius, ct, cv)
    return order, nodes


def plant(packed: DataFrame, docs: int, terms: int, weights: list[int]) -> DataFrame:
    """One tree a row. Distances are taken between coordinates times the root of the term's weight."""
    held = packed.sparkSession.sparkContext.broadcast(np.sqrt(np.array(weights, np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = held.value
        for batch in batches:
            for r in batch.to_pylist():
                if not r["doc_ids"]:
                    continue
                starts, term, tf = np.array(r["starts"]), np.array(r["terms"], np.int64), np.array(r["tf"], np.int64)
                value = saturated(tf, starts, r["lengths"], docs, terms)
                order, nodes = build_tree(starts, term, value * root[term], len(root))
                starts, at = reorder(starts, order)
                lo, hi, left, radius, ct, cv = zip(*nodes)
                ids = pa.array(r["doc_ids"], pa.int64()).take(pa.array(order))
                lists = [ids, starts, term[at], value[at], lo, hi, left, radius, np.concatenate([[0], np.cumsum([len(c) for c in ct])]),
                         np.concatenate(ct), np.concatenate(cv)]
                kinds = [pa.int64(), *[pa.int32()] * 6, pa.float64(), pa.int32(), pa.int32(), pa.float32()]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if k == 0 else pa.array(np.asarray(v), kinds[k]))
                                                  for k, v in enumerate(lists)], [f.split()[0] for f in _TREE.split(", ")])

    return packed.select("doc_ids", "lengths", "starts", "terms", "tf").mapInArrow(run, _TREE)


# --- 3 and 4: search ------------------------------------------------------------------------------------------------

class Block:
    """Questions as columns: ``y`` (terms × questions) for bounds and ``whole`` (questions × terms) for exact scores."""

    def __init__(self, ids: list, counts: list[Counter], number: dict[bytes, int], weights: list[int]) -> None:
        self.ids, self.whole = ids, np.zeros((len(ids), len(number)), np.int64)
        for q, found in enumerate(counts):
            for t, n in found.items():
                self.whole[q, number[t]] = n * weights[number[t]]
        root = np.sqrt(np.array(weights, np.float64))
        self.y = np.divide(self.whole.T, root[:, None], out=np.zeros(self.whole.T.shape), where=root[:, None] > 0)


class Tree:
    def __init__(self, row: dict) -> None:
        self.ids, self.lo, self.hi, self.left = row["doc_ids"], row["lo"], row["hi"], row["left"]
        self.starts, self.terms, self.value = (np.array(row[c], np.int64) for c in ("starts", "terms", "value"))
        self.radius, self.centre_starts = np.array(row["radius"]), np.array(row["centre_starts"])
        self.centre_terms, self.centre = np.array(row["centre_terms"], np.int64), np.array(row["centre"], np.float64)

    def bounds(self, block: Block) -> np.ndarray:
        """Nodes × questions: no document of a node has a higher score. 8,192 terms at a time."""
        node = np.repeat(np.arange(len(self.lo)), np.diff(self.centre_starts))
        used = np.unique(self.centre_terms)
        dot = np.zeros((len(self.lo), len(block.ids)))
        square = np.zeros_like(dot)
        for at in range(0, len(used), 8_192):
            part = used[at:at + 8_192]
            inside = (self.centre_terms >= part[0]) & (self.centre_terms <= part[-1])
            c = np.zeros((len(self.lo), len(part)))
            c[node[inside], np.searchsorted(part, self.centre_terms[inside])] = self.centre[inside]
            y = block.y[part]
            dot += c @ y
            square += (c > 0) @ (y * y)
        return (dot + np.sqrt(square) * self.radius[:, None]) * (1 + 4 * (len(used) + 32) * EPS)

    def scores(self, node: int, question: np.ndarray) -> np.ndarray:
        s = self.starts[self.lo[node]:self.hi[node] + 1]
        return np.add.reduceat(question[self.terms[s[0]:s[-1]]] * self.value[s[0]:s[-1]], s[:-1] - s[0])


class Best:
    """The k best documents of every question so far, and the least score that may still matter."""

    def __init__(self, block: Block, k: int, floor: np.ndarray) -> None:
        self.block, self.k, self.floor, self.found = block, k, floor.copy(), [[] for _ in block.ids]

    def look(self, tree: Tree, node: int, q: int) -> None:
        scores = tree.scores(node, self.block.whole[q])
        at = np.flatnonzero(scores >= self.floor[q])
        if not len(at):
            return
        lo, found = tree.lo[node], self.found[q]
        found += [(-int(scores[i]), tree.ids[lo + i] is None, tree.ids[lo + i] or 0) for i in at]
        if len(found) > self.k:
            found.sort()
            del found[self.k:]
        if len(found) == self.k:
            self.floor[q] = max(self.floor[q], -max(found)[0])

    def rows(self) -> pa.RecordBatch:
        flat = [(q, self.block.ids[q], None if null else i, -s) for q, found in enumerate(self.found) for s, null, i in found]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                          ["question", "item_id", "doc_id", "score"])


def descend(tree: Tree, best: Best) -> None:
    """One leaf for every question, always by the better child."""
    bound = tree.bounds(best.block)
    for q in np.flatnonzero(bound[0] >= best.floor):
        node = 0
        while tree.left[node] >= 0:
            node = tree.left[node] + int(bound[tree.left[node] + 1, q] > bound[tree.left[node], q])
        best.look(tree, node, q)


def visit(tree: Tree, best: Best) -> None:
    """Best bound first, until no node left can reach the floor."""
    bound = tree.bounds(best.block)
    for q in np.flatnonzero(bound[0] >= best.floor):
        heap = [(-bound[0, q], 0)]
        while heap and -heap[0][0] >= best.floor[q]:
            node = heappop(heap)[1]
            if tree.left[node] < 0:
                best.look(tree, node, q)
            else:
                for child in (tree.left[node], tree.left[node] + 1):
                    if bound[child, q] >= best.floor[q]:
                        heappush(heap, (-bound[child, q], child))


def walk(trees: DataFrame, block: Block, k: int, floor: np.ndarray, how) -> DataFrame:
    """The k best of each task, as rows."""
    held = trees.sparkSession.sparkContext.broadcast(block)              # at most BLOCK_CELLS numbers, twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(held.value, k, floor)
        for batch in batches:
            for i in range(batch.num_rows):
                how(Tree(batch.slice(i, 1).to_pylist()[0]), best)
        yield best.rows()

    found = trees.mapInArrow(run, "question int, item_id bigint, doc_id bigint, score bigint")
    by_rank = Window.partitionBy("question").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list[Counter]]]:
    """Runs of questions, read partition by partition; a question of very many terms comes alone."""
    ids, counts, total = [], [], 0
    for row in items.select(F.col(item_id).cast("bigint"), in_bytes(text)).toLocalIterator():
        found = count_terms(bytes(row[1]))
        if not found:
            continue
        if ids and (len(ids) == BLOCK_ITEMS or (len(ids) + 1) * (total + len(found)) > BLOCK_CELLS):
            yield ids, counts
            ids, counts, total = [], [], 0
        ids.append(row[0]), counts.append(found)
        total += len(found)
    if ids:
        yield ids, counts


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` (above 0) of the k best documents of each row of ``items``."""
    spark = docs.sparkSession
    path, schema = new_folder(spark, "ranked"), "item_id bigint, rank int, doc_id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(path)
    for ids, counts in _blocks(items, item_id, text):
        number = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        packed = stage(pack(docs, doc_id, text, number), "packed")
        n_docs, n_terms = packed.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if n_docs:
            df = dict(packed.select(F.explode("terms").alias("t")).groupBy("t").count().collect())     # at most the block's terms
            weights = [weight(n_docs, df.get(i, 0)) for i in range(len(number))]
            trees = stage(plant(packed, n_docs, n_terms, weights), "trees")
            drop_stage(packed)
            block = Block(ids, counts, number, weights)
            kth = walk(trees, block, k, np.ones(len(ids), np.int64), descend).filter(F.col("rank") == k).select("question", "score").collect()
            floor = np.ones(len(ids), np.int64)
            for q, score in kth:                                         # at most BLOCK_ITEMS rows
                floor[q] = score
            walk(trees, block, k, floor, visit).select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
            drop_stage(trees)
        else:
            drop_stage(packed)
    return spark.read.schema(schema).parquet(path)
