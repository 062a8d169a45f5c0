"""Order-dependent rules per key: event gaps, anchored windows, cooldown, minute spreading."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tidewatch.operators.edges import neighbour
from tidewatch.session import cut_lineage, with_fields

US = 1_000_000


def event_gaps(df: DataFrame, keys: Sequence[str], ts_us: str = "ts_us", piece_sec: int = 1) -> DataFrame:
    """Gap to the previous event per distinct time of a key → (keys, ts_us, events, gap_sec).

    Events of one time are one row with their count (their gaps to each other are 0). Gaps are taken inside pieces of
    ``piece_sec`` and across their edges, so a sort group holds at most one row per microsecond of a piece.
    """
    times = df.groupBy(*keys, F.col(ts_us).alias("ts_us")).agg(F.count("*").alias("events")).withColumn(
        "_piece", F.floor(F.col("ts_us") / (piece_sec * US)))
    last = times.groupBy(*keys, "_piece").agg(F.min("ts_us").alias("ts_us"), F.max("ts_us").alias("_last"))
    last = neighbour(last, keys, "_piece", "_last", "_before")
    inside = times.withColumn("_prev", F.lag("ts_us").over(W.partitionBy(*keys, "_piece").orderBy("ts_us")))
    out = inside.join(last.select(*keys, "_piece", "ts_us", "_before"), [*keys, "_piece", "ts_us"], "left")
    prev = F.coalesce("_prev", "_before")
    return out.select(*keys, "ts_us", "events", ((F.col("ts_us") - prev) / F.lit(float(US))).alias("gap_sec"))


def _chain(times: np.ndarray, width: int) -> np.ndarray:
    """Window start of each sorted time: jump to the first time at least ``width`` after the current start."""
    start = np.empty_like(times)
    i = 0
    while i < len(times):
        j = int(np.searchsorted(times, times[i] + width, side="left"))
        start[i:j] = times[i]
        i = j
    return start


def _walk(times: DataFrame, keys: Sequence[str], width_us: int) -> DataFrame:
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_us")
        return pdf.assign(win_start_us=_chain(pdf["ts_us"].to_numpy(), width_us))

    schema = with_fields(times.select(*keys, "ts_us").schema, ("win_start_us", T.LongType()))
    return times.select(*keys, "ts_us").groupBy(*keys).applyInPandas(walk, schema)


def _cell(width_us: int):
    """Cells much shorter than a window, so a sort group is limited by the microseconds in one of them."""
    return F.floor(F.col("ts_us") / max(1, width_us // 64))


def _next_start(times: DataFrame, keys: Sequence[str], width_us: int) -> DataFrame:
    """For each time of a key, the first time at least ``width_us`` later → (keys, ts_us, nxt).

    The wanted time lies in the cell of ``ts_us + width_us``, or is the first time of the next occupied cell; both are
    found by sorting within single cells.
    """
    own = times.select(*keys, "ts_us", F.lit(1).alias("_real"))
    ask = times.select(*keys, (F.col("ts_us") + width_us).alias("ts_us"), F.lit(0).alias("_real"))
    both = own.unionByName(ask).withColumn("_c", _cell(width_us))
    ahead = W.partitionBy(*keys, "_c").orderBy("ts_us", "_real").rowsBetween(0, W.unboundedFollowing)
    inside = both.withColumn("nxt", F.min(F.when(F.col("_real") == 1, F.col("ts_us"))).over(ahead)).filter("_real = 0")
    cells = both.groupBy(*keys, "_c").agg(F.min(F.when(F.col("_real") == 1, F.col("ts_us"))).alias("_first"))
    cells = neighbour(cells, keys, "_c", "_first", "_later", before=False)
    return inside.join(cells.select(*keys, "_c", "_later"), [*keys, "_c"]).select(
        *keys, (F.col("ts_us") - width_us).alias("ts_us"), F.coalesce("nxt", "_later").alias("nxt"))


def _by_joins(times: DataFrame, keys: Sequence[str], width_us: int) -> DataFrame:
    """Window starts by pointer doubling over ``next start``.

    Each round joins on (key, time), which is unique, so no task sees more of a key than its hash share. The number
    of rounds is the logarithm of the longest chain of windows.
    """
    jump = cut_lineage(_next_start(times, keys, width_us).filter("nxt is not null"))
    starts = cut_lineage(times.groupBy(*keys).agg(F.min("ts_us").alias("ts_us")))
    known = starts.count()
    while True:
        step = starts.join(jump, [*keys, "ts_us"]).select(*keys, F.col("nxt").alias("ts_us"))
        starts = cut_lineage(starts.unionByName(step).distinct())
        now = starts.count()
        if now == known:
            break
        known = now
        hop = jump.select(*keys, F.col("ts_us").alias("nxt"), F.col("nxt").alias("_far"))
        jump = cut_lineage(jump.join(hop, [*keys, "nxt"]).select(*keys, "ts_us", F.col("_far").alias("nxt")))
    # each time belongs to the latest start at or before it, in its own cell or an earlier one
    rows = times.select(*keys, "ts_us").join(starts.withColumn("_start", F.col("ts_us")), [*keys, "ts_us"], "left")
    rows = rows.withColumn("_c", _cell(width_us))
    back = W.partitionBy(*keys, "_c").orderBy("ts_us").rowsBetween(W.unboundedPreceding, 0)
    before = neighbour(rows.groupBy(*keys, "_c").agg(F.max("_start").alias("_s")), keys, "_c", "_s", "_earlier")
    return rows.withColumn("_own", F.max("_start").over(back)).join(
        before.select(*keys, "_c", "_earlier"), [*keys, "_c"]).select(
        *keys, "ts_us", F.coalesce("_own", "_earlier").alias("win_start_us"))


FORMS = {"joins": _by_joins, "walk": _walk}


def anchored_starts(df: DataFrame, keys: Sequence[str], width_sec: float, ts_us: str = "ts_us", form: str = "joins") -> DataFrame:
    """Window start of every distinct time of a key → (keys, ts_us, win_start_us).

    A window opens at the first event and closes at the first event at least ``width_sec`` later, which opens the
    next. ``form`` is ``joins`` (keys of any size, some rounds of joins) or ``walk``, which the caller may choose where each
    key's distinct times fit one task: one group per key.
    """
    width_us = int(round(width_sec * US))
    times = df.select(*keys, F.col(ts_us).alias("ts_us")).distinct()
    return FORMS[form](cut_lineage(times) if form == "joins" else times, keys, width_us)


def anchored_windows(df: DataFrame, keys: Sequence[str], width_sec: float, ts_us: str = "ts_us", form: str = "joins") -> DataFrame:
    """``df`` with ``win_start_us``: the anchored window each row belongs to."""
    starts = anchored_starts(df, keys, width_sec, ts_us, form)
    return df.join(starts.withColumnRenamed("ts_us", ts_us), [*keys, ts_us])


def cooldown(alerts: DataFrame, keys: Sequence[str], seconds: float = 1800, ts_us: str = "ts_us",
             order: str = "event_id", form: str = "joins") -> DataFrame:
    """Keep an alert only if at least ``seconds`` passed since the last *kept* alert of its key.

    Kept alerts are exactly the openers of anchored windows of that length; of several at one time the first by
    ``order`` is kept.
    """
    starts = anchored_starts(alerts, keys, seconds, ts_us, form).filter("ts_us = win_start_us").select(
        *keys, F.col("ts_us").alias(ts_us))
    opened = alerts.join(starts, [*keys, ts_us])
    first = opened.groupBy(*keys, ts_us).agg(F.min(order).alias(order))
    return opened.join(first, [*keys, ts_us, order], "left_semi")


def spread_timestamps(df: DataFrame, keys: Sequence[str], ts_us: str = "ts_us", order: str = "row_key",
                      span_sec: int = 60, block_digits: int = 4) -> DataFrame:
    """Rows sharing a coarse time get evenly spaced offsets ``(i + 0.5) / n * span`` → ``spread_us``.

    A stamp can be shared by very many rows, so they are numbered inside blocks of their md5 order and shifted by the
    block counts before them. A stamp with a single row stays where it is.
    """
    k = [*keys, ts_us]
    rows = df.withColumn("_h", F.md5(F.col(order).cast("string"))).withColumn(
        "_b", F.substring("_h", 1, block_digits))
    sizes = rows.groupBy(*k, "_b").agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_before", F.sum("_size").over(W.partitionBy(*k).orderBy("_b")) - F.col("_size"))
    sizes = sizes.withColumn("_n", F.sum("_size").over(W.partitionBy(*k))).drop("_size")
    numbered = rows.withColumn("_i", F.row_number().over(W.partitionBy(*k, "_b").orderBy("_h", order)) - 1)
    i = F.col("_i") + F.col("_before")
    offset = F.when(F.col("_n") > 1, F.floor((i + 0.5) / F.col("_n") * (span_sec * US))).otherwise(0)
    return numbered.join(sizes, [*k, "_b"]).withColumn("spread_us", F.col(ts_us) + offset).drop(
        "_h", "_b", "_before", "_n", "_i")
