"""Ranks over large groups without putting a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewatch.session import cut_lineage


def digest_cuts(df: DataFrame, groups: Sequence[str], key: str, limits: dict[str, Column]) -> DataFrame:
    """Where the n-th smallest digest of each group lies, for each named limit n → one row per group and ``cut``.

    Counts per digest prefix (combined before the shuffle) give the prefix a cut falls into; only the digests of
    those prefixes are counted and ranked. Both results are written tables of known size, so the joins with them are
    broadcast exactly when they are small, and the rows themselves are not shuffled then. Columns: ``_whole`` (the
    group fits), ``_cut`` (digest at the cut), ``_take`` (rows of that digest that fit), ``_full`` (all of them fit).
    """
    g = list(groups)
    prefix = F.substring(key, 1, 4).alias("_p")
    per_prefix = df.groupBy(*g, prefix).agg(F.count("*").alias("_n"))
    run = W.partitionBy(*g).orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    here = (F.col("_hi") - F.col("_n") < F.col("_limit")) & (F.col("_limit") <= F.col("_hi"))
    named = F.array(*[F.struct(F.lit(n).alias("cut"), c.cast("bigint").alias("_limit")) for n, c in limits.items()])
    sized = (per_prefix.withColumn("_hi", F.sum("_n").over(run))
             .withColumn("group_rows", F.sum("_n").over(W.partitionBy(*g)))
             .withColumn("_l", F.explode(named)).select("*", "_l.cut", "_l._limit"))
    # one row per group and limit: the prefix of the cut, or none when the group fits or nothing is wanted
    at = F.max(F.when(here, F.struct("_p", (F.col("_hi") - F.col("_n")).alias("_before"))))
    cut = cut_lineage(sized.groupBy(*g, "cut").agg((F.max("_limit") >= F.max("group_rows")).alias("_whole"),
                                                   F.max("_limit").alias("_limit"), at.alias("_at"))
                      .select(*g, "cut", "_whole", "_limit", F.col("_at._p").alias("_p"), F.col("_at._before").alias("_before")))
    edge = df.select(*g, F.col(key).alias("_k"), prefix).join(cut.filter("not _whole"), [*g, "_p"]).groupBy(
        *g, "cut", "_limit", "_before", "_k").agg(F.count("*").alias("_n"))
    by_key = W.partitionBy(*g, "cut").orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    edge = (edge.withColumn("_hi", F.col("_before") + F.sum("_n").over(by_key)).filter(here)
            .select(*g, "cut", F.col("_k").alias("_cut"), (F.col("_limit") - F.col("_hi") + F.col("_n")).alias("_take"),
                    (F.col("_limit") == F.col("_hi")).alias("_full")))
    return cut_lineage(cut.select(*g, "cut", "_whole").join(edge, [*g, "cut"], "left"))


def smallest_per_group(df: DataFrame, groups: Sequence[str], key: str, limit: Column | int) -> DataFrame:
    """The ``limit`` rows with the smallest ``key`` (a hex digest) of each group, exactly.

    Rows below the cut of their group are kept by comparison with it; of rows that share the key at the cut as many are
    taken as fit, in order of a hash of the row. ``limit`` may use the group columns and ``group_rows``, the size of the group.
    """
    g = list(groups) or ["_all"]
    columns = df.columns
    if not groups:
        df = df.withColumn("_all", F.lit(0))
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    marked = df.join(digest_cuts(df, g, key, {"limit": limit}), g)
    at_cut = F.col(key) == F.col("_cut")
    keep = marked.filter(F.col("_whole") | (F.col(key) < F.col("_cut")) | (F.col("_full") & at_cut))
    # rows that share the key of the cut: copies are counted (before the shuffle), different rows are taken in order of a hash
    tied = (marked.filter(~F.col("_whole") & ~F.col("_full") & at_cut)
            .groupBy(*columns, *[c for c in g if c not in columns]).agg(F.count("*").alias("_n"), F.first("_take").alias("_take")))
    order = W.partitionBy(*g, key).orderBy(F.xxhash64(*columns), *columns)
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = (tied.withColumn("_some", F.least(F.col("_n"), F.col("_take") - before)).filter("_some > 0")
            .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_some").cast("int")))))
    return keep.select(*columns).unionByName(part.select(*columns))


def hash_key(*columns, seed: int = 42) -> Column:
    """Reproducible pseudo-random order: md5 over the seed and the given columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def running_number(df: DataFrame, id_col: str, groups: Sequence[str] = (), block: int = 65536) -> DataFrame:
    """``seq`` = 0, 1, 2 … in order of a unique integer id, per group.

    Ids are numbered inside blocks of consecutive ids (at most ``block`` rows each). A block is shifted by the blocks
    before it in its super-block, and a super-block by the super-blocks before it, so no sort group grows with the
    table beyond its share of ids.
    """
    g = list(groups)
    rows = df.withColumn("_block", F.floor(F.col(id_col) / block)).withColumn("_super", F.floor(F.col("_block") / block))
    inner = W.partitionBy(*g, "_block").orderBy(id_col)
    sizes = rows.groupBy(*g, "_super", "_block").agg(F.count("*").alias("_n"))
    near = sizes.withColumn("_near", F.sum("_n").over(W.partitionBy(*g, "_super").orderBy("_block")) - F.col("_n")).drop("_n")
    supers = sizes.groupBy(*g, "_super").agg(F.sum("_n").alias("_n"))
    far = supers.withColumn("_far", F.sum("_n").over(W.partitionBy(*(g or [F.lit(0)])).orderBy("_super")) - F.col("_n")).drop("_n")
    shift = near.join(far, [*g, "_super"]).drop("_super")
    return (rows.withColumn("_no", F.row_number().over(inner)).join(shift, [*g, "_block"])
            .withColumn("seq", F.col("_no") - 1 + F.col("_near") + F.col("_far")).drop("_block", "_super", "_no", "_near", "_far"))


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group with their ``rank``; the limit is applied before the shuffle as well."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).filter(
        F.col("rank") <= k)
