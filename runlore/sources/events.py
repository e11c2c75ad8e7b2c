"""Command events as JSON lines: tolerant reading, and the partitioned history table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.functions.text import repo_key, tool

#: An event as it is stored; ``ts`` is the second it completed.
HISTORY = T.StructType(
    [
        T.StructField("command", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("dir", T.StringType()), T.StructField("repo", T.StringType()),
        T.StructField("exit_code", T.IntegerType()), T.StructField("duration_ms", T.LongType()), T.StructField("session", T.StringType()), T.StructField("imported", T.BooleanType()),
    ]
)
_RAW = T.StructType([T.StructField(f.name, T.StringType()) for f in HISTORY])


def parse_events(lines: DataFrame) -> DataFrame:
    """Text lines (``value``) as events with ``is_valid``; blank lines go.

    Lines are parsed as text, since the JSON reader drops empty arrays and explodes arrays of objects. Whole
    numbers may be written as strings. Command, ts and dir must be there, durations not negative.
    """
    # within brackets anything after the object makes the line unreadable; strict JSON has no single quotes
    one = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), T.ArrayType(_RAW), {"allowSingleQuotes": "false"})
    raw = lines.where(F.trim("value") != "").withColumn("__a", one).withColumn("r", F.when(F.size("__a") == 1, F.col("__a")[0]))
    num = lambda c, t: F.expr(f"try_cast(try_cast(r.{c} AS decimal(30,6)) AS {t})")
    whole = lambda c: F.expr(f"r.{c} IS NULL OR try_cast(r.{c} AS decimal(30,6)) = floor(try_cast(r.{c} AS decimal(30,6)))")
    out = raw.select(
        *[c for c in lines.columns if c != "value"], "value", F.col("r.command").alias("command"), num("ts", "bigint").alias("ts"), F.col("r.dir").alias("dir"), F.col("r.repo").alias("repo"),
        num("exit_code", "int").alias("exit_code"), num("duration_ms", "bigint").alias("duration_ms"), F.col("r.session").alias("session"), F.coalesce(F.expr("try_cast(r.imported AS boolean)"), F.lit(False)).alias("imported"),
        (whole("ts") & whole("exit_code") & whole("duration_ms")).alias("__whole"),
    )
    ok = F.col("command").isNotNull() & F.col("ts").isNotNull() & F.col("dir").isNotNull() & F.coalesce("__whole", F.lit(False)) & (F.coalesce("duration_ms", F.lit(0)) >= 0)
    return out.withColumn("is_valid", F.coalesce(ok, F.lit(False))).drop("__whole")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Valid events of JSON-lines files with ``seq``, their order within their file."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    events = parse_events(lines).where("is_valid").drop("is_valid", "value")
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy("at")).cast("long")).drop("at")


def write_history(events: DataFrame, path: str, mode: str = "append") -> None:
    """The query table: partitioned by repository, with lower-case text (its filters push down) and the tool."""
    out = events.withColumns({"repo_key": repo_key(F.col("repo")), "command_lc": F.lower("command"), "tool": tool(F.col("command"))})
    out.write.mode(mode).partitionBy("repo_key").parquet(path)


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines by repository, the source of truth; the query table can be rebuilt from them."""
    cols = [f.name for f in HISTORY]
    events.select(repo_key(F.col("repo")).alias("repo_key"), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).partitionBy("repo_key").text(path)


def write_sessions(sessions: DataFrame, path: str, mode: str = "append") -> None:
    """Session log by the UTC day a session began."""
    sessions.withColumn("day", F.to_date(F.timestamp_seconds("started_at"))).write.mode(mode).partitionBy("day").json(path)


def read_sessions(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """The session log, or one UTC day of it (``YYYY-MM-DD``), for which only that day's folder is read."""
    schema = "id string, summary string, started_at long, ended_at long, repo string, n_commands long, commands array<string>, day date"
    log = spark.read.schema(schema).json(path)
    return log if day is None else log.where(F.col("day") == F.lit(day).cast("date"))


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text, nulls kept, for callers outside the cluster: value."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def hidden(command: str = "command"):
    """Commands typed with a leading blank are not recorded."""
    return F.rlike(F.col(command), F.lit(r"^\s"))
