"""Usage counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top(history: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-null values, ties by first appearance: value, n_rows."""
    g = history.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n_rows"), F.min("seq").alias("first"))
    return g.orderBy(F.desc("n_rows"), "first").limit(n).select("value", "n_rows")


def stats(history: DataFrame) -> DataFrame:
    """One table of all figures: kind (total, command, repo), value, n_rows."""
    total = history.agg(F.count("*").alias("n_rows")).select(F.lit("total").alias("kind"), F.lit("all").alias("value"), "n_rows")
    commands = top(history, "command", 10).select(F.lit("command").alias("kind"), "value", "n_rows")
    return total.unionByName(commands).unionByName(top(history, "repo", 5).select(F.lit("repo").alias("kind"), "value", "n_rows"))


def import_totals(plan: DataFrame) -> DataFrame:
    """Entries per file and verdict, with a row for all files (file_name null)."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(v)
    return plan.rollup("file_name").agg(n("new"), n("duplicate"), n("credential"))


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("tool").agg(F.count("*").alias("n_requests"), F.count(F.when(~F.col("ok"), 1)).alias("n_failed"), F.sum(F.col("results").cast("long")).alias("n_results"))


def audit_tail(audit: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` requests, oldest first."""
    keys = [F.desc("ts"), F.desc("tool"), F.desc("results"), F.desc(F.to_json("arguments"))]
    return audit.orderBy(*keys).limit(n).orderBy("ts", "tool", "results")
