"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. The state is the number of members each group has in each shard, so a group of
any size is at most ``shards`` rows. In every round the members of a group look at the shards of their neighbours, ask to
move to the shard with room that holds most of them, and move as far as its quota allows; what does not fit stays.
Unlinked documents cut no edge, so they are dealt last and fill every shard to its exact quota.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewatch.llm.common import stage

BLOCK = 20_000


def numbered(rows: DataFrame, groups: list[str], order: list[str], out: str, n_rows: int) -> DataFrame:
    """Gapless numbers from 0 within each group, in blocks of a hash of ``order``; no sort holds more than about a block."""
    blocks = max(1, n_rows // BLOCK)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    inner = W.partitionBy(*groups, "_block").orderBy(*order)
    sizes = rows.groupBy(*groups, "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*groups).orderBy("_block")) - F.col("_n")
    shift = sizes.select(*groups, "_block", before.alias("_before"))
    return (rows.withColumn("_no", F.row_number().over(inner)).join(shift, [*groups, "_block"])
            .withColumn(out, F.col("_no") - 1 + F.col("_before")).drop("_no", "_before", "_block"))


def _move(state: DataFrame, quota: dict[int, int], salt: int) -> DataFrame:
    """One round: requests to the majority shard of each group, accepted in order of gain while the quota lasts."""
    cap = F.element_at(F.create_map(*[x for s, q in quota.items() for x in (F.lit(s), F.lit(q))]), F.col("to"))
    used = state.groupBy(F.col("shard").alias("to")).agg(F.sum("n").alias("used"))
    deals = state.sparkSession.range(len(quota)).select(F.col("id").cast("int").alias("to"))
    room = deals.join(used, "to", "left").select("to", (cap - F.coalesce("used", F.lit(0))).alias("room"))
    # the neighbours' shard with most members among those that still have room
    here = F.struct("n", (-F.col("shard")).alias("low")).alias("here")
    open_ = state.join(room.select(F.col("to").alias("shard"), "room"), "shard").withColumn("here", here)
    best = F.max(F.when(F.col("room") > 0, F.col("here"))).over(W.partitionBy("grp"))
    wants = open_.withColumn("best", best).withColumn("go", F.coalesce(F.col("best") > F.col("here"), F.lit(False)))
    stay = wants.filter("not go").select("grp", "shard", "n")
    ask = wants.filter("go").select("grp", "shard", "n", (-F.col("best.low")).cast("int").alias("to"), (F.col("best.n") - F.col("n")).alias("gain"))
    # requests are ordered by classes of gain and a hash; classes are counted, so no sort holds a shard's requests
    cell = F.struct((-F.floor(F.log2(F.col("gain") + 1))).alias("gain"), F.pmod(F.xxhash64("grp", F.lit(salt)), F.lit(4096)).alias("part")).alias("cell")
    ask = ask.withColumn("cell", cell)
    cells = ask.groupBy("to", "cell").agg(F.sum("n").alias("cell_n"))
    ahead = F.sum("cell_n").over(W.partitionBy("to").orderBy("cell")) - F.col("cell_n")
    cells = cells.withColumn("ahead", ahead).join(room, "to", "left")
    inside = W.partitionBy("to", "cell").orderBy("grp", "shard").rowsBetween(W.unboundedPreceding, 0)
    took = (ask.join(cells, ["to", "cell"]).withColumn("run", F.sum("n").over(inside) - F.col("n"))
            .withColumn("go", F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce("room", F.lit(0)) - F.col("ahead") - F.col("run")))))
    moved = took.select("grp", F.col("to").alias("shard"), F.col("go").alias("n"))
    rest = took.select("grp", "shard", (F.col("n") - F.col("go")).alias("n"))
    return stay.unionByName(moved).unionByName(rest).filter("n > 0").groupBy("grp", "shard").agg(F.sum("n").alias("n"))


def assign(df: DataFrame, shards: int = 16, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size`` (text bytes + 1; null has none), ``text_crc32``, ``grp``, ``shard`` (0 …), ``slot`` (0 … gapless).

    Law ``rows``: the counts of two shards differ by at most one. Groups are equal texts; null and empty texts are one
    group. A group larger than a shard is spread over as few shards as the quotas allow. Repeated ids are separate rows,
    null ids are rows like others. An empty table gives no rows; further columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = text.cast("binary")
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                     F.crc32(raw).alias("text_crc32"), F.xxhash64(raw, F.octet_length(text)).alias("grp"))
    rows = stage(rows, "shard-rows")
    n = rows.count()
    quota = {s: n // shards + (s < n % shards) for s in range(shards)}
    groups = rows.groupBy("grp").agg(F.count("*").alias("n"))
    linked = stage(groups.filter("n > 1"), "linked-groups")
    # start: members of a group are dealt over the shards as a hash of group and part says, at most `shards` rows a group
    part = F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(shards)).cast("int") - 1))
    base = F.floor(F.col("n") / F.least(F.col("n"), F.lit(shards)))
    state = (linked.select("grp", "n", part.alias("i"))
             .select("grp", F.pmod(F.xxhash64("grp") + F.col("i"), F.lit(shards)).cast("int").alias("shard"),
                     (base + (F.col("i") < F.col("n") % F.least(F.col("n"), F.lit(shards))).cast("int")).cast("bigint").alias("n")))
    state = stage(state, "labels-0")
    for r in range(1, rounds + 1):
        state = stage(_move(state, quota, r), f"labels-{r}")
    # members take the shards of their group in turn; what a shard holds beyond its quota goes back to the free rows
    held = {x.shard: x.n for x in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}         # `shards` numbers
    upto = F.sum("n").over(W.partitionBy("grp").orderBy("shard"))
    ranges = state.select("grp", "shard", (upto - F.col("n")).alias("lo"), upto.alias("hi"))
    small = rows.join(linked.select("grp"), "grp", "left_semi")
    members = stage(numbered(small, ["grp"], ["doc_id", "size"], "i", n), "members")
    placed = members.join(ranges, "grp").filter("i >= lo and i < hi").select("doc_id", "size", "text_crc32", "grp", "shard")
    placed = stage(placed, "placed")
    free = rows.join(linked.select("grp"), "grp", "left_anti")
    over = {s: held.get(s, 0) - quota[s] for s in quota if held.get(s, 0) > quota[s]}
    if over:                                               # the start alone may exceed a quota when most rows are linked
        ranked = numbered(placed, ["shard"], ["grp", "doc_id", "size"], "_i", n)
        cap = F.element_at(F.create_map(*[x for s, q in quota.items() for x in (F.lit(s), F.lit(q))]), F.col("shard"))
        ranked = stage(ranked.withColumn("_over", F.col("_i") >= cap), "over-quota")
        free = free.unionByName(ranked.filter("_over").select(*rows.columns))
        placed = ranked.filter("not _over").drop("_i", "_over")
    gaps, at = [], 0
    for s in quota:
        need = quota[s] - min(held.get(s, 0), quota[s])
        gaps.append((s, at, at + need))
        at += need
    free = stage(numbered(free.withColumn("_all", F.lit(0)), ["_all"], ["grp", "doc_id", "size"], "_i", n), "free").drop("_all")
    shard = F.lit(None).cast("int")
    for s, lo, hi in gaps:
        shard = F.when((F.col("_i") >= lo) & (F.col("_i") < hi), s).otherwise(shard)
    both = placed.unionByName(free.withColumn("shard", shard).drop("_i"))
    return numbered(both, ["shard"], ["grp", "doc_id", "size"], "slot", n)
