"""Work sessions of a repository in capture order, for mining and for the session log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.blocks import with_runs
from runlore.functions.text import repo_id, think_seconds

IDLE_S = 300


def boundary(idle_s: int, by_think_time: bool = True):
    """The rule that opens a session: ids where both rows have one, else idle time; another repository; time going back."""

    def starts(prev: Column) -> Column:
        known = F.col("session").isNotNull() & prev["session"].isNotNull()
        gap = F.greatest(think_seconds(F.col("ts"), F.col("duration_ms"), prev["ts"]), F.lit(0)) if by_think_time else F.col("ts") - prev["ts"]
        cut = F.when(known, F.col("session") != prev["session"]).otherwise(gap > idle_s) if by_think_time else gap > idle_s
        moved = ~F.col("repo").eqNullSafe(prev["repo"])
        return (cut | moved | (F.col("ts") < prev["ts"])) if by_think_time else (cut | moved)

    return starts


def with_sessions(history: DataFrame, idle_s: int = IDLE_S, block: int | None = None) -> DataFrame:
    """Rows with ``repo_id`` and ``run``, the seq that opens their session in the repository's history."""
    h = history.withColumn("repo_id", repo_id()).withColumn("session", F.when(F.col("session") != "", F.col("session")))
    return with_runs(h, ["repo_id"], "seq", ["ts", "repo", "session"], boundary(idle_s), block=block)


def session_log(history: DataFrame, idle_s: int = IDLE_S) -> DataFrame:
    """Sessions of each device as they were captured: id, summary, started_at, ended_at, repo, n_commands, commands.

    Idle time is the plain difference of completion times; a change of repository also closes a session. The
    start is estimated as ten seconds a command before the end. The last, still open session is included.
    """
    h = history.where("command is not null")
    runs = with_runs(h, ["device"], "seq", ["ts", "repo"], boundary(idle_s, by_think_time=False))
    g = runs.groupBy("device", "run").agg(F.array_sort(F.collect_list(F.struct("seq", "command", "ts", "repo"))).alias("rows"))
    commands = F.transform("rows", lambda r: r["command"])
    n = F.size("rows")
    first, end = F.element_at(commands, 1), F.element_at("rows", -1)["ts"]
    summary = F.when(n == 1, first).otherwise(F.concat(first, F.lit(" (+"), (n - 1).cast("string"), F.lit(" more commands)")))
    return g.select(
        F.concat_ws("-", "device", F.col("run").cast("string")).alias("id"), summary.alias("summary"), (end - 10 * n).alias("started_at"), end.alias("ended_at"),
        F.element_at("rows", 1)["repo"].alias("repo"), n.cast("long").alias("n_commands"), commands.alias("commands"),
    )
