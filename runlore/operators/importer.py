"""Import of parsed shell history: dates for undated entries, and what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlore.functions.redaction import looks_like_credential

SPACING_S = 60


def dated(entries: DataFrame, files: list[str], order: str, now: int, mtime: str | None = None) -> DataFrame:
    """``entries`` with every ``ts`` filled in: undated ones are spread evenly between their dated neighbours.

    Dates of zero or less or after ``now`` are no dates. Before the first dated entry of a file the spread goes
    back a minute an entry, after the last it goes up to ``mtime`` (a column; ``now`` where there is none). The
    windows run over one history file, whose size one person's typing bounds.
    """
    w = Window.partitionBy(*files).orderBy(order)
    up, down = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    e = entries.withColumn("__t", F.when((F.col("ts") > 0) & (F.col("ts") <= now), F.col("ts")))
    e = e.withColumn("__run", F.count("__t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*files, "__run", F.col("__t").isNull())
    end = F.col(mtime) if mtime else F.lit(now)
    e = e.withColumns({"__lo": F.last("__t", True).over(up), "__hi": F.coalesce(F.first("__t", True).over(down), end), "__n": F.count("*").over(run), "__k": F.row_number().over(run.orderBy(order))})
    lo = F.greatest(F.coalesce("__lo", F.col("__hi") - SPACING_S * F.col("__n")), F.lit(0))
    hi = F.when(F.col("__hi") <= lo, lo + F.col("__n")).otherwise(F.col("__hi"))
    ts = F.coalesce("__t", F.greatest(F.floor(lo + (hi - lo) / (F.col("__n") + 1) * F.col("__k")), F.lit(0))).cast("long")
    return e.withColumn("ts", ts).drop("__t", "__run", "__lo", "__hi", "__n", "__k")


def plan(entries: DataFrame, stored: DataFrame, source: str, order: str) -> DataFrame:
    """Each entry with its ``verdict``: credential, duplicate (the store has as many copies) or new.

    The n-th copy of a text over all sources in order is a duplicate while n is at most the number of stored
    copies; credentials are left out before counting. The ordinal is the count in the sources before plus the
    place within the source, so a text that is a third of all rows is not numbered in one task.
    """
    e = entries.withColumn("__secret", looks_like_credential(F.col("command")))
    ok = e.where(~F.col("__secret"))
    per = ok.groupBy("command", source).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("command").orderBy(source).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("command", source, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    have = stored.groupBy("command").agg(F.count("*").alias("__have"))
    nth = F.row_number().over(Window.partitionBy("command", source).orderBy(order)) + F.col("__before")
    ok = ok.join(per, ["command", source]).join(have, "command", "left")
    ok = ok.withColumn("verdict", F.when(nth <= F.coalesce("__have", F.lit(0)), "duplicate").otherwise("new")).select(*entries.columns, "verdict")
    return ok.unionByName(e.where("__secret").select(*entries.columns, F.lit("credential").alias("verdict")))


def as_history(planned: DataFrame) -> DataFrame:
    """New entries as history rows: no directory, repository, exit code, duration or session; ``imported``."""
    none = lambda t: F.lit(None).cast(t)
    return planned.where("verdict = 'new'").select(
        "command", F.col("ts").cast("long").alias("ts"), F.lit("").alias("dir"), none("string").alias("repo"), none("int").alias("exit_code"), none("long").alias("duration_ms"), none("string").alias("session"), F.lit(True).alias("imported")
    )
