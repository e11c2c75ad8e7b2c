"""Capture as a stream: events, live sessions and live picks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.operators.picks import merge_picks
from runlore.operators.work_sessions import IDLE_S
from runlore.sources.events import HISTORY, hidden, parse_events, write_history

_OUT = "device string, started_at long, ended_at long, repo string, n_commands long, summary string, commands array<string>"
_STATE = "commands array<string>, last_ts long, repo string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """New JSON lines of a folder as events, without those typed with a leading blank."""
    lines = spark.readStream.format("text").schema("value string").load(path)
    return parse_events(lines).where("is_valid").where(~hidden()).drop("is_valid", "value")


def _summary(commands: list[str]) -> str:
    return commands[0] if len(commands) == 1 else f"{commands[0]} (+{len(commands) - 1} more commands)"


def live_sessions(events: DataFrame, idle_s: int = IDLE_S) -> DataFrame:
    """Closed sessions per device; a session closes on more than ``idle_s`` of idle time or another repository.

    The open session stays in the state. Events of a batch are taken in (ts, seq) order; one that arrives in a later
    batch with an earlier time joins the open session, as no watermark drops it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        commands, last, repo = ([], None, None) if not state.exists else (list(state.get[0]), state.get[1], state.get[2])
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        closed = []
        for command, ts, where in zip(rows["command"], rows["ts"], rows["repo"]):
            where = None if pd.isna(where) else where
            if commands and (ts - last > idle_s or where != repo):
                closed.append((key[0], last - 10 * len(commands), last, repo, len(commands), _summary(commands), commands))
                commands = []
            commands, last, repo = [*commands, command], int(ts), where
        state.update((commands, last, repo))
        if closed:
            yield pd.DataFrame(closed, columns=["device", "started_at", "ended_at", "repo", "n_commands", "summary", "commands"])

    seq = F.col("seq") if "seq" in events.columns else F.lit(None).cast("long").alias("seq")
    return events.select("device", "command", "ts", "repo", seq).groupBy("device").applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout")


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Commands and failures per window of event time, with a watermark for late events."""
    timed = events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window)).agg(F.count("*").alias("n"), F.count(F.when(F.col("exit_code") != 0, 1)).alias("failed"))


def keep_picks(selections: DataFrame, path: str, now, checkpoint: str):  # noqa: ANN001, ANN201
    """A running query that folds selections into the picks table at ``path``, one version a batch.

    Each batch reads the version before and writes its own, so a repeated batch overwrites what it wrote.
    """
    spark = selections.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        stored = spark.read.schema("command string, count double, ts long").parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], "command string, count double, ts long")
        merge_picks(stored, batch, now()).write.mode("overwrite").parquet(f"{path}/v{number}")

    return selections.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintained(events: DataFrame, path: str, checkpoint: str, maintain, every: int = 20):  # noqa: ANN001, ANN201
    """A running query that appends events to the history table and calls ``maintain(spark)`` once ``every`` events
    have come in since the last call (the count is of this run; a restart begins anew)."""
    seen = [0]

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        write_history(batch, f"{path}/batch={number}", "overwrite")
        seen[0] += batch.count()
        batch.unpersist()
        if seen[0] >= every:
            seen[0] = 0
            maintain(events.sparkSession)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["HISTORY", "event_stream", "keep_picks", "live_sessions", "maintained", "windowed_counts"]
