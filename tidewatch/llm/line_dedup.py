"""Line dedup by an exact set-similarity join over the words of the lines.

A line is the set of its lower-case words. Words are ordered by rarity over all lines; similar lines share a word among
the first ``|set| - ceil(t |set|) + 1``. Length, position and parity bitmaps bound the overlap before the sorted sets are
intersected.
A line goes if an earlier line (by document id, then place) is equal in its words or similar to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidewatch.llm.common import drop_stage, spare_name, stage
from tidewatch.llm.set_join import Threshold, ends_of, first_pass, line_sets, prefix_lists, rarity, verified_lines, verified_listed

THRESHOLD = Threshold(9, 10)
#: Longs of the parity bitmap that every line has, and minima that name its groups.
BITS, MINS = 2, 2


def place(doc: str = "doc_id", line: str = "line"):
    """Order of lines: by document id, null ids last, then by place."""
    return F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("doc_id"), F.col(line).alias("line"))


def _possible(x: str, y: str, t: Threshold):
    """Whether size and bitmap of the nodes with these column prefixes allow similarity."""
    n, m = F.col(x + "n"), F.col(y + "n")
    return (F.least(n, m) * t.den >= F.greatest(n, m) * t.num) & t.possible_longs(
        [F.col(f"{x}b{i}") for i in range(BITS)], [F.col(f"{y}b{i}") for i in range(BITS)], n, m)


def _ends(nodes: DataFrame, t: Threshold) -> DataFrame:
    """Each node with the earliest node of every group that shares one of its minima (``a`` earlier, ``b`` later)."""
    row = ["node", "n", *[f"b{i}" for i in range(BITS)]]
    own = nodes.select(*row, "at", F.posexplode(F.array(*[f"m{i}" for i in range(MINS)])).alias("k", "low"))
    # rows of a group come in order and are read once: the first stands for the group
    group = W.partitionBy("low", "k").orderBy("at", "node").rowsBetween(W.unboundedPreceding, W.currentRow)
    pairs = own.withColumn("c", F.first(F.struct(*row)).over(group)).filter("c.node <> node").filter(_possible("", "c.", t))
    return pairs.select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()


def _earlier(lists: DataFrame, nodes: DataFrame, resolved: DataFrame, t: Threshold) -> DataFrame:
    """Candidate pairs (``a`` earlier, ``b`` later and not resolved yet; ``raw_a``, ``raw_b``) that share a prefix word. The bitmaps of
    both nodes are compared where they meet; the few pairs left are put in order afterwards."""
    gone = resolved.select(F.col("b").alias("node")).distinct().withColumn("gone", F.lit(True))
    row = ["node", "n", *[f"b{i}" for i in range(BITS)]]
    # the rows of a node are equal and lie together after this join: one that came twice is dropped as it is read. Spark would run the
    # part below the exchange twice if it held first(), as dropDuplicates does
    marked = lists.join(gone.hint("merge"), "node", "left")
    marked = marked.groupBy("node").agg(*[F.max(c).alias(c) for c in (*row[1:], "tokens", "gone")])
    # one exchange by word serves both sides of the join, so the filters of a side stay behind it: spark_partition_id() holds them there
    rows = marked.select(F.posexplode("tokens").alias("pos", "token"), *row, "gone").repartition("token")
    # the word lies in the shorter index prefix of the smaller set
    rows = rows.withColumn("index", F.col("pos") < F.col("n") - F.ceil(2 * t.num * F.col("n") / F.lit(t.num + t.den)) + 1)
    x, y = (rows.select("token", *[F.col(c).alias(side + c) for c in rows.columns if c != "token"]) for side in ("x_", "y_"))
    # y is open; of two open nodes x is the smaller set, a resolved x may be either
    small = F.expr("x_n < y_n or (x_n = y_n and x_node < y_node)")
    pairs = (x.filter("x_index or x_gone is not null or spark_partition_id() < 0").join(y.filter("y_gone is null or spark_partition_id() < 0").hint("merge"), "token")
             .filter(F.when(small, F.col("x_index")).otherwise(F.col("x_gone").isNotNull() & F.col("y_index")))
             .filter(F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) * (t.num + t.den) >= (F.col("x_n") + F.col("y_n")) * t.num)
             .filter(_possible("x_", "y_", t)))
    pairs = pairs.select("x_node", "x_gone", "y_node").distinct()
    for side in ("x_", "y_"):
        pairs = pairs.join(nodes.select(*[F.col(c).alias(side + c) for c in ("node", "raw", "at")]), side + "node")
    first = F.col("x_at") < F.col("y_at")
    pairs = pairs.filter(F.col("x_at") != F.col("y_at")).filter(first | F.col("x_gone").isNull())
    return pairs.select(*[F.when(first, F.col(p)).otherwise(F.col(q)).alias(c) for c, p, q in (
        ("a", "x_node", "y_node"), ("b", "y_node", "x_node"), ("raw_a", "x_raw", "y_raw"), ("raw_b", "y_raw", "x_raw"))])


def _lines_and_state(docs: DataFrame, id_col: str, text_col: str, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """Lines (``doc_id``, ``line``, ``n``, ``node``) and the nodes of which some line goes: ``at``, its earliest line, and ``gone``, whether
    that one goes too."""
    items = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    first = first_pass(items, ["doc_id"], line_sets, "line-sets", BITS, MINS, "line")
    longs = [*[f"m{i}" for i in range(MINS)], *[f"b{i}" for i in range(BITS)]]
    rows = first.filter("chunk is null").select("doc_id", "line", "n", "node", "raw", *longs)
    nodes = stage(rows.filter("n > 0").groupBy("node").agg(
        F.max("n").alias("n"), F.min("raw").alias("raw"), *[F.max(c).alias(c) for c in longs], F.min(place()).alias("at"), F.count("*").alias("copies")), "line-nodes")
    ends = stage(_ends(nodes, t), "line-ends")
    wanted = ends_of(ends, "line-end-nodes")
    lists = prefix_lists(items, line_sets, rarity(first), t, BITS, "line-words", wanted)
    drop_stage(wanted)
    near = verified_listed(ends, lists, t, "line-links")
    pairs = stage(_earlier(lists, nodes, near, t), "line-pairs")
    drop_stage(lists)
    far = verified_lines(pairs, items, t, "line-matches")
    gone = stage(near.unionByName(far).select(F.col("b").alias("node")).distinct(), "later-lines").withColumn("gone", F.lit(True))
    state = nodes.select("node", "at", "copies").join(gone, "node", "left").filter("copies > 1 or gone")
    state = stage(state.select("node", "at", F.coalesce("gone", F.lit(False)).alias("gone")), "line-state")
    drop_stage(nodes)
    return rows.select("doc_id", "line", "n", "node"), state


def _removed():
    """Whether a line (with the state of its node) goes."""
    return F.coalesce((F.col("n") > 0) & (F.col("gone") | (F.col("at") < place())), F.lit(False))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: Threshold = THRESHOLD) -> DataFrame:
    """One row per line: ``doc_id``, ``line``, ``removed``. Lines without words are never removed.

    Null texts have no lines, an empty text has one without words. Rows that repeat an id have their lines in one count
    of places: of equal lines at one place one stays. Lines of null ids come last. Other columns are not read.
    """
    rows, state = _lines_and_state(docs, id_col, text_col, t)
    return rows.join(state, "node", "left").select("doc_id", "line", _removed().alias("removed"))


def removed_per_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: Threshold = THRESHOLD) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed``, ``removed`` (sorted line numbers) of every document that has lines."""
    rows, state = _lines_and_state(docs, id_col, text_col, t)
    gone = rows.join(state, "node").filter(_removed()).groupBy(F.col("doc_id").alias("rid")).agg(
        F.count("*").alias("n_removed"), F.sort_array(F.collect_set("line")).alias("removed"))
    counted = rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    return counted.join(gone, F.col("doc_id").eqNullSafe(F.col("rid")), "left").select(
        "doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: Threshold = THRESHOLD) -> DataFrame:
    """``docs`` with the removed lines cut out of the text; all columns pass through, null texts stay null."""
    rid, cut = spare_name(docs, "_id"), spare_name(docs, "_cut")
    gone = stage(removed_per_document(docs, id_col, text_col, t), "removed-lines").filter("n_removed > 0").select(
        F.col("doc_id").alias(rid), F.col("removed").alias(cut))
    kept = F.filter(F.split(F.col(text_col), "\\n", -1), lambda x, i: ~F.array_contains(F.col(cut), i))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col(rid)), "left")
    return joined.select(*[(F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias(text_col)
                            if c == text_col else F.col(f"`{c}`")) for c in docs.columns])
