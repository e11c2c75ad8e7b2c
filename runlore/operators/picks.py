"""Selection feedback: decayed counts of commands chosen on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.functions.ranking import decayed

PRUNE_BELOW, MAX_ENTRIES = 0.02, 5_000


def pick_weights(events: DataFrame, now: int, cap: int | None = MAX_ENTRIES) -> DataFrame:
    """command, weight: each selection counts half as much every three weeks.

    Exponential decay adds up, so the running count per selection and this sum agree. Rows without a command
    or time are no selection; every other row counts, repeated ones too. Weights below the floor are pruned,
    and at most ``cap`` largest are kept (the size limit of the picks store; ties by text).
    """
    ok = events.where("command <> '' and ts is not null")
    w = ok.groupBy("command").agg(F.round(F.sum(decayed(F.lit(now) - F.col("ts"))), 6).alias("weight")).where(F.col("weight") >= PRUNE_BELOW)
    return w if cap is None else w.orderBy(F.desc("weight"), "command").limit(cap)


def merge_picks(stored: DataFrame, events: DataFrame, now: int) -> DataFrame:
    """A stored table (command, count, ts) brought forward to ``now`` with new selections: command, count, ts."""
    old = stored.where("count > 0").select("command", (F.col("count") * decayed(F.lit(now) - F.col("ts"))).alias("w"))
    new = events.where("command <> '' and ts is not null").select("command", decayed(F.lit(now) - F.col("ts")).alias("w"))
    total = old.unionAll(new).groupBy("command").agg(F.round(F.sum("w"), 6).alias("count")).where(F.col("count") >= PRUNE_BELOW)
    return total.orderBy(F.desc("count"), "command").limit(MAX_ENTRIES).withColumn("ts", F.lit(now).cast("long"))
