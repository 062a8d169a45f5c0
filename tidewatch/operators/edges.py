"""Values of neighbouring pieces of a key's time line, without a window over all pieces of the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

FAN, LEVELS = 4096, 3


def neighbour(rows: DataFrame, keys: Sequence[str], at: str, value: str, out: str, before: bool = True, levels: int = LEVELS) -> DataFrame:
    """``rows`` (unique per key and whole number ``at``) with ``out``: the non-null ``value`` of the nearest row before (or after).

    Rows of ``FAN`` numbers form a run. The neighbour is looked for in the own run; for the rows that have none there it is the
    neighbour of the run, found in the same way among runs of runs. A sort group holds at most ``FAN`` rows, on the last of
    ``levels`` steps those that are ``FAN ** levels`` numbers apart."""
    side = (W.unboundedPreceding, -1) if before else (1, W.unboundedFollowing)
    nearest = (F.last if before else F.first)(value, ignorenulls=True)
    if levels == 0:
        return rows.withColumn(out, nearest.over(W.partitionBy(*keys).orderBy(at).rowsBetween(*side)))
    run = f"{out}_run{levels}"
    rows = rows.withColumn(run, F.floor(F.col(at) / FAN).cast("bigint"))
    inside = rows.withColumn(out, nearest.over(W.partitionBy(*keys, run).orderBy(at).rowsBetween(*side)))
    ends = F.when(F.col(value).isNotNull(), F.col(at))
    runs = rows.groupBy(*keys, run).agg((F.max_by if before else F.min_by)(F.col(value), ends).alias(value))
    runs = neighbour(runs, keys, run, value, f"{out}_far", before, levels - 1).select(*keys, run, f"{out}_far")
    return inside.join(runs, [*keys, run]).withColumn(out, F.coalesce(out, f"{out}_far")).drop(run, f"{out}_far")
