"""Problem 4: grouping activity into sessions by start-end pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlore.operators.streams import WHOLE, event_streams
from runlore.runtime import written

GAP_S = 300


def pair_sessions(events: DataFrame, gap_s: int = GAP_S, one_block: bool = False) -> DataFrame:
    """Sessions of ordered streams, by start-end pairing.

    ``events``: s1, s2, block, ts, seq, session (string, null or empty = unknown), dur_s (long >= 0).
    An event starts a session if it is the first of its stream; else, where it and the event before both
    name a session, exactly when these differ; else when ``ts - dur_s - previous ts > gap_s``.

    A RANGE frame over the position in the stream gives each event its predecessor, and the successor's
    verdict; events without a near predecessor are starts, those without a near successor are ends. Starts
    and ends are numbered separately, equal numbers are joined, and the difference of their positions is
    the number of events. Positions and numbers are sums of a count within the block and the counts of the
    blocks before, so a hot stream is never windowed in one task. With ``one_block`` every stream is one block and
    nothing is carried.

    Result: s1, s2, first_seq, started_at, ended_at, n_events. An empty input gives no rows; ties in ``ts``
    go by ``seq``; a stream of one event is one session of length zero.
    """
    key, blk = ["s1", "s2"], ["s1", "s2", "block"]
    named = F.when(F.col("session") != "", F.col("session"))
    ev = events.select(*blk, "ts", "seq", named.alias("session"), "dur_s")

    def starts(prev):  # the rule, given a struct of the predecessor (null: none)
        both = F.col("session").isNotNull() & prev["session"].isNotNull()
        late = F.col("ts") - F.col("dur_s") - prev["ts"] > F.lit(gap_s)
        return F.when(prev.isNull(), F.lit(True)).when(both, F.col("session") != prev["session"]).otherwise(late)

    by_key = Window.partitionBy(*key).orderBy("block")
    in_block = Window.partitionBy(*blk)
    pos = ev.withColumn("pos", F.row_number().over(in_block.orderBy("ts", "seq")).cast("long"))
    if one_block:
        pos = pos.withColumns({"before": F.lit(None).cast("struct<ts:bigint,session:string>"), "offset": F.lit(0).cast("long"), "closes": F.lit(True)})
    else:  # one summary row per block: what its neighbours need to know
        at = F.struct("ts", "seq")
        edge = ev.groupBy(*blk).agg(
            F.count("*").alias("n"), F.max_by(F.struct("ts", "session"), at).alias("last"), F.min_by(F.struct("ts", "session", "dur_s"), at).alias("first")
        )
        edge = edge.withColumns({"before": F.lag("last").over(by_key), "offset": F.coalesce(F.sum("n").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        edge = edge.select(*blk, "before", "offset", F.col("first.ts").alias("ts"), F.col("first.session").alias("session"), F.col("first.dur_s").alias("dur_s"))
        edge = edge.withColumn("opens", starts(F.col("before"))).withColumn("closes", F.coalesce(F.lead("opens").over(by_key), F.lit(True)))
        pos = pos.join(edge.select(*blk, "before", "offset", "closes"), blk)
    near_before = in_block.orderBy("pos").rangeBetween(-1, -1)
    near_after = in_block.orderBy("pos").rangeBetween(1, 1)
    pos = pos.withColumn("prev", F.max(F.struct("ts", "session")).over(near_before))
    pos = pos.withColumn("is_start", starts(F.when(F.col("pos") == 1, F.col("before")).otherwise(F.col("prev"))))
    pos = pos.withColumn("is_end", F.coalesce(F.max("is_start").over(near_after), F.col("closes")))
    flags = pos.where("is_start or is_end").select(*blk, "ts", "seq", (F.col("pos") + F.col("offset")).alias("pos"), "is_start", "is_end")
    so_far = in_block.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    flags = flags.withColumns({"rs": F.sum(F.col("is_start").cast("long")).over(so_far), "re": F.sum(F.col("is_end").cast("long")).over(so_far)})
    flags = written(flags, "session-ends")  # both sides of the join read these few rows, not the windows again
    if one_block:
        flags = flags.withColumns({"os": F.lit(0), "oe": F.lit(0)})
    else:
        total = flags.groupBy(*blk).agg(F.max("rs").alias("ns"), F.max("re").alias("ne"))
        prior = by_key.rowsBetween(Window.unboundedPreceding, -1)
        flags = flags.join(total.select(*blk, F.coalesce(F.sum("ns").over(prior), F.lit(0)).alias("os"), F.coalesce(F.sum("ne").over(prior), F.lit(0)).alias("oe")), blk)
    first = flags.where("is_start").select(*key, (F.col("rs") + F.col("os")).alias("rank"), F.col("seq").alias("first_seq"), F.col("ts").alias("started_at"), F.col("pos").alias("p0"))
    last = flags.where("is_end").select(*key, (F.col("re") + F.col("oe")).alias("rank"), F.col("ts").alias("ended_at"), F.col("pos").alias("p1"))
    return first.join(last, [*key, "rank"]).select(*key, "first_seq", "started_at", "ended_at", (F.col("p1") - F.col("p0") + 1).alias("n_events"))


def history_sessions(history: DataFrame, gap_s: int = GAP_S, block_s: int | None = None) -> DataFrame:
    """Work sessions of every device and repository: first_seq, started_at, ended_at, n_events.

    Null or empty ``session`` and null ``duration_ms`` (counted as 0) fall back to idle time; null ``repo``
    is a stream of its own; other columns of the input do not matter.
    """
    dur = F.floor(F.coalesce(F.col("duration_ms"), F.lit(0)) / 1000).cast("long")
    ev, block_s = event_streams(history, [F.col("session").alias("session"), dur.alias("dur_s")], block_s)
    return pair_sessions(ev, gap_s, block_s >= WHOLE).select("first_seq", "started_at", "ended_at", "n_events")
