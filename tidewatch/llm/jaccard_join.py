"""N-gram Jaccard join: components of documents whose sets of 5-word shingles are similar.

1. One pass gives every document its set size, the id of its set, twelve minima under different hashes, and the token counts.
   Documents with equal sets are one node from here on.
2. Nodes with an equal minimum are compared with the two nodes of that group only whose minima are shared most. This joins
   families of near copies of any size with a number of comparisons in proportion to the family.
3. All other links: the prefixes of the sets (rare tokens first) meet by token, in tiles of neighbouring size bands. Only
   nodes of different components are paired; position and size bounds, then bit counts of hashed parity bitmaps bound the
   overlap from above, and the sorted arrays of what remains are intersected exactly: first one pair of each node, then
   the pairs whose nodes are still in different components.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from tidewatch.llm.common import drop_stage, setting, spare_name, stage
from tidewatch.llm.set_join import (
    Threshold, bounded, components, first_pass, intersected, met_before, prefix_tokens, rarity, shingle_sets, verified, with_heads)

THRESHOLD = Threshold(75, 100)
#: Longs of the parity bitmap that every node has.
BITS = 8
#: Switched off, a join on (token, band) uses rows that are dealt by token already.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def star_pairs(nodes: DataFrame, t: Threshold, centres: int = 2) -> DataFrame:
    """Written pairs (``a`` < ``b``) of each node with the centres of the groups that share one of its minima.

    The centres are the nodes whose minima are shared most: in a family of near copies that is the text they come from."""
    own = stage(nodes.select("node", "n", "bits", F.posexplode("mins").alias("k", "low")), "minima")
    sizes = own.groupBy("k", "low").agg(F.count("*").alias("size")).filter("size > 1")
    shared = stage(own.join(sizes, ["k", "low"]), "shared-minima")
    score = shared.groupBy("node").agg(F.sum("size").alias("score"))
    ranked = shared.join(score, "node").withColumn("place", F.struct("score", "node", "n", "bits"))
    best = ranked.groupBy("k", "low").agg(F.max("place").alias("one"))
    if centres > 1:                                        # the runner-up as well
        second = ranked.join(best, ["k", "low"]).filter("node <> one.node").groupBy("k", "low").agg(F.max("place").alias("one"))
        best = best.unionByName(second)
    best = best.select("k", "low", F.col("one.node").alias("c"), F.col("one.n").alias("nc"), F.col("one.bits").alias("bits_c"))
    pairs = shared.join(best, ["k", "low"]).filter(F.col("node") != F.col("c")).filter(
        F.least("n", "nc") * t.den >= F.greatest("n", "nc") * t.num).filter(t.possible("bits", "bits_c", F.col("n"), F.col("nc"), BITS))
    pairs = stage(pairs.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct(), "star-pairs")
    drop_stage(own, shared)
    return pairs


def tile_pairs(tokens: DataFrame, nodes: DataFrame, comps: DataFrame, t: Threshold) -> DataFrame:
    """Written candidate pairs of different components that share a prefix token, by tiles of neighbouring size bands.

    The bitmaps of both nodes are compared where they meet, so a group of texts that are alike but not similar leaves few
    of its pairs behind."""
    every = W.partitionBy("token")
    shared = (tokens.withColumn("lo", F.min("node").over(every)).withColumn("hi", F.max("node").over(every))
              .filter("lo <> hi").drop("lo", "hi"))
    shared = stage(shared.dropDuplicates(["token", "node"]), "shared-tokens")
    # one exchange by node (component and head), one by token (filter, tiles and join)
    rows = with_heads(shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))).join(nodes.select("node", "bits"), "node")
    rows = (rows.withColumn("lo", F.min("comp").over(every)).withColumn("hi", F.max("comp").over(every))
            .filter("lo <> hi").drop("lo", "hi")
            .withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(t.den / t.num) + 1e-9)))
    # the smaller set (x) stands in its own band, the larger (y) in its own and the one below
    x = rows.select("token", "band", *[F.col(c).alias("x_" + c) for c in ("node", "n", "pos", "comp", "head", "bits")])
    y = rows.select("token", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), *[F.col(c).alias("y_" + c) for c in ("node", "n", "pos", "comp", "head", "bits")])
    need = (F.col("x_n") + F.col("y_n")) * t.num
    index = F.col("x_n") - F.ceil(2 * t.num * F.col("x_n") / F.lit(t.num + t.den)) + 1
    pairs = (x.join(y.hint("merge"), ["token", "band"])
             .filter("x_comp <> y_comp and (x_n < y_n or (x_n = y_n and x_node < y_node))")
             .filter(F.col("x_n") * t.den >= F.col("y_n") * t.num).filter(F.col("x_pos") < index)
             .filter(F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) * (t.num + t.den) >= need)
             .filter(t.possible("x_bits", "y_bits", F.col("x_n"), F.col("y_n"), BITS)).filter(~met_before()))
    with setting(tokens.sparkSession, _ALL_KEYS, "false"):
        pairs = stage(pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct(), "tile-pairs")
    drop_stage(shared)
    return pairs


def joining_links(pairs: DataFrame, near: DataFrame, items: DataFrame, t: Threshold) -> DataFrame:
    """Components of the links ``near`` and of the similar ones among ``pairs`` (written; removed afterwards).

    The pair of each node with its smallest partner is intersected first; of the rest, only pairs that these links leave in
    different components. A dense group of k nodes thus moves about k arrays, not one for each of its pairs."""
    close, arrays = bounded(pairs, items, shingle_sets, t, "tile-links")
    one = stage(close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tile-first")
    links = near.unionByName(intersected(one, arrays, t, "tile-links"))
    comps = components(links)
    rest = close.join(one, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(comps.select(F.col("node").alias(end), F.col("comp").alias("c" + end)), end, "left")
    rest = stage(rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "tile-rest")
    more = intersected(rest, arrays, t, "tile-more")
    drop_stage(close, arrays, one, rest)
    return comps if more.isEmpty() else components(links.unionByName(more))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: Threshold = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``node`` (id of the set; null if empty).

    Null and empty texts have no shingles and are linked with nothing. ``component_id`` is the smallest id reachable by
    links, the own one included; null ids are smaller than none and never the smallest: a component of null ids only has a
    null ``component_id``. Rows that repeat an id are rows of their own, linked by their texts. Other columns are not read.
    """
    items = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    first = first_pass(items, ["doc_id"], shingle_sets, "shingle-sets", BITS)
    rows = first.filter("chunk is null").select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"), "mins", "bits")
    nodes = stage(rows.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.max("mins").alias("mins"), F.max("bits").alias("bits"), F.min("doc_id").alias("low_id")), "nodes")
    near = verified(star_pairs(nodes, t), items, shingle_sets, t, "star-links")
    pairs = tile_pairs(prefix_tokens(items, shingle_sets, rarity(first), t), nodes, components(near), t)
    comps = joining_links(pairs, near, items, t)
    placed = nodes.select("node", "low_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = placed.groupBy("comp").agg(F.min("low_id").alias("component_id"))
    named = stage(placed.join(lowest, "comp").select("node", "component_id"), "node-components")
    out = rows.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: Threshold = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; all columns pass through.

    Documents are told apart by id: rows that repeat the smallest id all stay, rows with a null id always stay, and so
    do empty texts, which are linked with nothing."""
    rid = spare_name(docs, "_id")
    found = stage(similar_documents(docs, id_col, text_col, t), "near-copies")
    gone = found.filter("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias(rid)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(rid), "left_anti")
