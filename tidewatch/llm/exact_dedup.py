"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

The index holds one entry per key (64-bit hash of the normalised text) with the number of rows, so a text with any
number of copies is one entry and no key can fill a bucket. A directory maps hash prefixes to buckets: a bucket with
more than ``capacity`` keys is split by one more bit, and the directory doubles when a split needs a bit it does not
have. Entries are written to the shared folder in bucket order. Keys with more than one row are chained in their bucket: their
texts are compared byte by byte (grouping on the bytes, combined before the shuffle), one link for each different text. A row
asks the directory for its bucket and finds its group in that bucket's chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewatch.llm.common import spare_name, stage

WHITE = r"[\x20\x09-\x0D]+"
HIST_BITS = 10
KEY_BITS = 60
SALTS = 16


def normalised(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def prefix_of(key: Column, bits: int) -> Column:
    """The top ``bits`` bits of a 64-bit hash as a non-negative number."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("bigint")


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """Buckets (``depth``, ``prefix``) of an extendible hash over the distinct values of ``key``.

    Each round counts the keys of the buckets that are still too full by their next ``HIST_BITS`` bits and walks that
    many doublings on the counts: a bucket stops splitting at the first depth at which it fits. The loop ends when no
    bucket is over ``capacity`` or the hash has no more bits.
    """
    done, base = [], 0
    while True:
        deep = base + HIST_BITS
        cells = keys.groupBy(prefix_of(F.col("key"), deep).alias("cell")).agg(F.count("*").alias("n"))
        split = (cells.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(deep))))
                 .withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)")))
        sizes = split.groupBy("depth", "prefix").agg(F.sum("n").alias("size"))
        fits = F.min(F.when(F.col("size") <= capacity, F.col("depth")))
        local = stage(split.join(sizes, ["depth", "prefix"]).groupBy("cell").agg(fits.alias("depth")), "directory")
        done.append(local.filter("depth is not null").select("depth", F.expr(f"shiftright(cell, {deep} - depth)").alias("prefix")).distinct())
        over = local.filter("depth is null").select(F.col("cell").alias("_cell"))
        base = deep
        if base >= KEY_BITS or over.isEmpty():
            done.append(over.select(F.lit(base).alias("depth"), F.col("_cell").alias("prefix")))
            break
        keys = keys.join(over, prefix_of(F.col("key"), base) == F.col("_cell"), "left_semi")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def index_files(entries: DataFrame, buckets: DataFrame) -> DataFrame:
    """Write ``entries`` (one row per ``key``) with ``bucket_depth`` and ``bucket`` in bucket order; owner tasks hold key ranges."""
    return stage(looked_up(entries, buckets).repartitionByRange("key").sortWithinPartitions("key"), "hash-index")


def looked_up(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` (with ``key``) and the bucket (``bucket_depth``, ``bucket``) that the directory has for their key; a key that the
    directory does not lead anywhere is left out."""
    depths = sorted(r.depth for r in buckets.select("depth").distinct().collect()) or [0]  # at most KEY_BITS + 1 numbers
    named = F.array(*[F.struct(F.lit(d).alias("depth"), prefix_of(F.col("key"), d).alias("prefix")) for d in depths])
    placed = rows.withColumn("_at", F.explode(named)).select("*", "_at.depth", "_at.prefix").drop("_at").join(buckets, ["depth", "prefix"])
    return placed.withColumnsRenamed({"depth": "bucket_depth", "prefix": "bucket"})


def row_hash(df: DataFrame) -> Column:
    """Hash over all columns; those that hold maps count by their JSON text."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema])


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 50_000) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``row_hash``.

    Texts are equal when they are the same bytes after each run of white space is made one space; null counts as empty.
    The row with the smallest id stays; null ids come last, and a group of null ids only has ``keep_id`` null. Of rows
    that repeat the smallest id one is kept: the one with the smallest ``row_hash`` (over all columns), and of rows alike
    in every column any one. Other columns are not read but for that hash. An empty table gives no rows.
    """
    row = row_hash(df)
    text = normalised(text_col)
    rows = df.select(F.col(id_col).alias("id"), row.alias("row_hash"), text.alias("norm"))
    rows = rows.withColumn("key", F.xxhash64("norm")).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    lean = stage(rows.drop("norm"), "hash-rows")
    entries = lean.groupBy("key").agg(F.count("*").alias("n_rows"))
    buckets = stage(directory(entries.select("key"), capacity), "buckets")
    index = index_files(entries, buckets)
    # a key may hold a third of all rows: its rows meet the index in SALTS parts, and each part is pre-aggregated
    repeated = index.filter("n_rows > 1").select("bucket_depth", "bucket", "key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_hash"))
    texts = df.select(F.col(id_col).alias("id"), row.alias("row_hash"), text.alias("norm")).withColumn("key", F.xxhash64("norm"))
    texts = texts.withColumn("salt", F.pmod("row_hash", F.lit(SALTS)).cast("int"))
    # a bucket's chain of a key: one link for each different text under it
    chains = (texts.join(repeated.hint("shuffle_merge"), ["key", "salt"]).groupBy("bucket_depth", "bucket", "key", "norm")
              .agg(first.alias("first"), F.count("*").alias("size"))
              .select("bucket_depth", "bucket", "key", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "first", "size"))
    # every row looks its bucket up in the directory and its chain in that bucket
    found = looked_up(lean, buckets).join(chains, ["bucket_depth", "bucket", "key", "text_sha256"], "left")
    same = W.partitionBy("id", "row_hash").orderBy("key")
    is_first = F.col("first").isNull() | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row_hash") == F.col("first.row_hash")))
    return (found.withColumn("_copy", F.row_number().over(same))
            .select(F.col("id").alias("doc_id"),
                    F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
                    F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
                    (is_first & (F.col("_copy") == 1)).alias("kept"), "text_sha256", "row_hash"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 50_000) -> DataFrame:
    """``df`` without later copies; all columns pass through. Null and repeated ids as in ``exact_groups``."""
    rid, row = spare_name(df, "_id"), spare_name(df, "_row")
    groups = stage(exact_groups(df, id_col, text_col, capacity), "copies").select(
        F.col("doc_id").alias(rid), F.col("row_hash").alias(row), "kept")
    per_row = groups.groupBy(rid, row).agg(F.max("kept").alias("_stays"), F.count("*").alias("_n"))
    gone, twins = per_row.filter("not _stays"), per_row.filter("_stays and _n > 1")
    marked = df.withColumn(row, row_hash(df))

    def same(other):
        return (marked[row] == other[row]) & marked[id_col].eqNullSafe(other[rid])

    kept = marked.join(gone, same(gone), "left_anti")
    if not twins.isEmpty():                                # rows alike in every column
        marked, kept = kept, kept.join(twins, same(twins), "left_anti")
        kept = kept.unionByName(marked.join(twins, same(twins), "left_semi").dropDuplicates([row, id_col]))
    return kept.select(*df.columns)
