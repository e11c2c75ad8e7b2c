"""Retention by age and erasure by text, over all stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.functions.text import repo_key

KEEP_COMMAND_DAYS, KEEP_SESSION_DAYS = 90, 30


def rotate(history: DataFrame, now: int, days: int = KEEP_COMMAND_DAYS) -> DataFrame:
    """Rows younger than ``days``; imported and undated rows stay. A row of exactly that age goes."""
    return history.where(F.coalesce(F.col("imported"), F.lit(False)) | F.col("ts").isNull() | (F.col("ts") > now - days * 86400))


def rotate_sessions(sessions: DataFrame, now: int, days: int = KEEP_SESSION_DAYS) -> DataFrame:
    """Sessions of the last ``days`` days by the UTC date they began."""
    day = F.to_date(F.timestamp_seconds("started_at"))
    return sessions.where(day >= F.to_date(F.timestamp_seconds(F.lit(now - days * 86400))))


def rotate_lines(lines: DataFrame, now: int, days: int = KEEP_COMMAND_DAYS) -> DataFrame:
    """The same over raw JSON lines (``value``); lines that cannot be read stay."""
    rec = F.from_json("value", T.StructType().add("ts", "string").add("imported", "boolean"))
    ts = F.expr("try_cast(__r.ts as bigint)")
    kept = lines.withColumn("__r", rec)
    return kept.where(ts.isNull() | F.coalesce(F.col("__r.imported"), F.lit(False)) | (ts > now - days * 86400)).drop("__r")


def _holds(schema: T.DataType, col, query: str):  # noqa: ANN001, ANN202
    """Whether any string inside a value holds the query."""
    if isinstance(schema, T.StringType):
        return F.coalesce(F.contains(col, F.lit(query)), F.lit(False))
    if isinstance(schema, T.ArrayType):
        return F.coalesce(F.exists(col, lambda x: _holds(schema.elementType, x, query)), F.lit(False))
    if isinstance(schema, T.MapType):
        keys, values = _holds(T.ArrayType(schema.keyType), F.map_keys(col), query), _holds(T.ArrayType(schema.valueType), F.map_values(col), query)
        return keys | values
    if isinstance(schema, T.StructType):
        return reduce(lambda a, b: a | b, [_holds(f.dataType, col[f.name], query) for f in schema], F.lit(False))
    return F.lit(False)


def forget(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which none of the columns (all by default) holds the text, case-sensitively, at any depth."""
    cols = columns or df.columns
    return df.where(~reduce(lambda a, b: a | b, [_holds(df.schema[c].dataType, F.col(c), query) for c in cols]))


def forget_in_sessions(sessions: DataFrame, query: str) -> DataFrame:
    """Commands with the text struck from sessions, summaries with it blanked, empty sessions dropped."""
    left = F.filter("commands", lambda c: ~F.contains(c, F.lit(query)))
    summary = F.when(F.contains("summary", F.lit(query)), "").otherwise(F.col("summary"))
    return sessions.withColumns({"commands": left, "summary": summary}).where(F.size("commands") > 0)


def forget_all(stores: dict[str, DataFrame], query: str) -> dict[str, DataFrame]:
    """Every store without the text, in one operation: rows that hold it go, sessions lose the commands that do."""
    return {name: forget_in_sessions(df, query) if name == "sessions" else forget(df, query) for name, df in stores.items()}


def forget_targets(stores: dict[str, DataFrame], query: str) -> DataFrame:
    """Which stores hold the text, and in how many rows: store, n_rows."""
    parts = []
    for name, df in stores.items():
        hit = reduce(lambda a, b: a | b, [_holds(f.dataType, F.col(f.name), query) for f in df.schema])
        parts.append(df.where(hit).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("store"), "n_rows"))
    return reduce(DataFrame.unionByName, parts).where("n_rows > 0")


def split_by_owner(lines: DataFrame, fallback: str) -> DataFrame:
    """Raw JSON lines of one old file with the partition key of each line's own repository, each line once."""
    repo = F.get_json_object("value", "$.repo")
    return lines.dropDuplicates(["value"]).withColumn("repo_key", F.when(repo.isNull(), F.lit(fallback)).otherwise(repo_key(repo)))
