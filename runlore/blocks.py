"""Ordered streams cut into time blocks, so that no stream has to fit into one task.

A window over a stream that holds a third of all rows is one task with a third of all rows. Rows are
therefore windowed per (stream, block); what crosses a border is carried by one summary row per block.
The block length follows from a measured figure, the largest stream: below ``TARGET_ROWS`` a stream is
one block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows that one windowed block should hold at most.
TARGET_ROWS = 4_000_000
#: A block length that no stream exceeds.
WHOLE = 1 << 40


def stream_id(*cols: Column | str) -> list[Column]:
    """Two 64-bit hashes that stand for the key columns; nulls are keys of their own."""
    parts = [F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("-")) for c in cols]
    return [F.xxhash64(*parts).alias("s1"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("s2")]


def block_seconds(df: DataFrame, keys: list[str], ts: str, target_rows: int = TARGET_ROWS) -> int:
    """Block length in seconds so that the largest stream has about ``target_rows`` rows a block."""
    row = (
        df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
        .agg(F.max(F.struct("n", "lo", "hi")).alias("big")).first()["big"]
    )
    if row is None or row["n"] <= target_rows or row["hi"] is None:
        return WHOLE
    return max(1, (row["hi"] - row["lo"]) * target_rows // row["n"])


def block_of(ts: str, seconds: int) -> Column:
    return F.floor(F.coalesce(F.col(ts), F.lit(0)) / F.lit(seconds)).cast("long")


def _next(item: Column, n: int, w: WindowSpec) -> Column:
    """The ``n`` values after a row, without the missing ones at the end; offsets need no growing buffer."""
    return F.filter(F.array(*[F.lead(item, k).over(w) for k in range(1, n + 1)]), lambda x: x.isNotNull())


def with_following(df: DataFrame, keys: list[str], order: str, n: int, fields: list[str], into: str = "following", block: int | None = None) -> DataFrame:
    """Each row with an array of structs of the ``n`` rows after it in its stream (fewer at the end).

    Rows are windowed per block; the first rows of the next blocks stand in at a block's end.
    """
    block = block or block_seconds(df, keys, order)
    item = F.struct(*fields)
    if block >= WHOLE:  # every stream is one block: nothing crosses a border
        return df.withColumn(into, _next(item, n, Window.partitionBy(*keys).orderBy(order)))
    d = df.withColumn("__block", block_of(order, block))
    blk = [*keys, "__block"]
    w = Window.partitionBy(*blk).orderBy(order)
    heads = d.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).groupBy(*blk).agg(F.array_sort(F.collect_list(F.struct(order, item.alias("__item")))).alias("h"))
    after = Window.partitionBy(*keys).orderBy("__block").rowsBetween(1, n)
    tails = heads.select(*blk, F.transform(F.flatten(F.collect_list("h").over(after)), lambda r: r["__item"]).alias("__tail"))
    d = d.withColumn("__in", _next(item, n, w)).join(_null_safe(tails, blk), _on(d, tails, blk), "left")
    return d.withColumn(into, F.slice(F.concat("__in", F.coalesce("__tail", F.expr("filter(__in, x -> false)"))), 1, n)).select(*df.columns, into)


def _null_safe(right: DataFrame, cols: list[str]) -> DataFrame:
    return right.select(*[F.col(c).alias(f"__r_{c}") for c in cols], *[c for c in right.columns if c not in cols])


def _on(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    cond = None
    for c in cols:
        eq = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        cond = eq if cond is None else cond & eq
    return cond


def with_runs(df: DataFrame, keys: list[str], order: str, fields: list[str], starts: Callable[[Column], Column], into: str = "run", block: int | None = None) -> DataFrame:
    """Each row with the ``order`` value of the first row of its run.

    ``starts(prev)`` says whether a row begins a run, given a struct of ``fields`` of the row before it; the
    first row of a stream always does. Blocks hand on their last row and their last start.
    """
    block = block or block_seconds(df, keys, order)
    opens = lambda prev: F.when(F.col(prev).isNull(), F.lit(True)).otherwise(F.coalesce(starts(F.col(prev)), F.lit(False)))
    if block >= WHOLE:
        w = Window.partitionBy(*keys).orderBy(order)
        d = df.withColumn("__prev", F.lag(F.struct(*fields)).over(w)).withColumn("__start", opens("__prev"))
        return d.withColumn(into, F.max(F.when(F.col("__start"), F.col(order))).over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*df.columns, into)
    d = df.withColumn("__block", block_of(order, block))
    blk = [*keys, "__block"]
    w = Window.partitionBy(*blk).orderBy(order)
    over_blocks = Window.partitionBy(*keys).orderBy("__block")
    last = d.groupBy(*blk).agg(F.max_by(F.struct(*fields), order).alias("l"))
    carry = last.select(*blk, F.lag("l").over(over_blocks).alias("__carry"))
    d = d.withColumn("__in", F.lag(F.struct(*fields)).over(w)).join(_null_safe(carry, blk), _on(d, carry, blk), "left")
    prev = F.coalesce("__in", "__carry")
    d = d.withColumn("__prev", prev).withColumn("__start", opens("__prev"))
    d = d.withColumn("__run", F.max(F.when(F.col("__start"), F.col(order))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(*[f"__r_{c}" for c in blk])
    tops = d.groupBy(*blk).agg(F.max("__run").alias("t"))
    held = tops.select(*blk, F.max("t").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("__held"))
    d = d.join(_null_safe(held, blk), _on(d, held, blk), "left")
    return d.withColumn(into, F.coalesce("__run", "__held")).select(*df.columns, into)
