"""Queries of the problems tagged llm."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlore.llm import bpe, heavy, leaks, newness, pii, runs, secrets, subsequences
from runlore.llm.oracle import ORACLE
from runlore.runtime import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return runs.collapse_runs(table(spark, sf, "history")).where(F.col("n_events") >= runs.MIN_EVENTS)


def p3_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Runs whose neighbours are nearly alike: 0.8 of the characters or more."""
    return runs.collapse_runs(table(spark, sf, "history"), min_similarity=0.8)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return heavy.values_above(table(spark, sf, "history"), "command", 0.005).select(F.col("value").alias("command"))


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    return heavy.top_values(table(spark, sf, "history"), "command", 20).select(F.col("value").alias("command"), F.col("n").alias("n_rows"))


def p6_replayed(spark: SparkSession, sf: str) -> DataFrame:
    """Entries already held when they arrive, with their batch: the batches are taken one by one, each by a fresh reader
    of the stored tables, and appended."""
    return newness.replayed(table(spark, sf, "history"), table(spark, sf, "import_entries"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_replayed(spark, sf).select("entry_id")


def p6_caught_up(spark: SparkSession, sf: str) -> DataFrame:
    """The same entries by one catch-up over all batches together."""
    return newness.held_entries(table(spark, sf, "history"), table(spark, sf, "import_entries"))


def p6_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Per batch: entries, those new to their device and the duplicates."""
    entries = table(spark, sf, "import_entries")
    dup = p6_replayed(spark, sf).groupBy("batch_no").agg(F.count("*").alias("dup"))
    n = entries.groupBy("batch_no").agg(F.count("*").alias("n_entries")).join(dup.hint("merge"), "batch_no", "left")
    held = F.coalesce("dup", F.lit(0))
    return n.select("batch_no", "n_entries", held.alias("duplicates"), (F.col("n_entries") - held).alias("n_new"))


def p7_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with the number of supporting sessions."""
    f = subsequences.frequent_subsequences(table(spark, sf, "history"))
    return f.select(F.array_join("steps", " > ").alias("steps"), F.col("length").cast("long").alias("n_steps"), "support")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_patterns(spark, sf).select("steps")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return bpe.decode_ids(p8_ids(spark, sf), "doc_id", "ids")


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "history").select(F.lit("history").alias("src"), F.col("seq").alias("row_id"), "command")
    return h.unionAll(table(spark, sf, "import_entries").select(F.lit("import_entries"), "entry_id", "command"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.find_secrets(_commands(spark, sf), ["src", "row_id"], "command").select("src", "row_id")


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Commands with a secret, the secret masked in place."""
    return secrets.find_secrets(_commands(spark, sf), ["src", "row_id"], "command")


def p10_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with personal information, typed placeholders in its place; without a key of the session's, under one
    that nobody knows."""
    key = spark.conf.get("spark.runlore.pii.key", None) or token_hex(32)
    return pii.pseudonymise(table(spark, sf, "documents"), "doc_id", "text", key)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_clean(spark, sf).select("doc_id", F.explode("kinds").alias("kind")).where(F.col("kind").isin(*pii.KINDS)).distinct()


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items of each document: the longest quoted stretch, whether the answer is there, quote or paraphrase."""
    return leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).where("is_quote").select("doc_id", "item_id").distinct()


QUERIES = {
    "p9_found": p9_found, "p9_leaks": p9_leaks,
    "p10_found": p10_found, "p10_clean": p10_clean,
    "p2_found": p2_found, "p2_redacted": p2_redacted, "p8_ids": p8_ids, "p8_decoded": p8_decoded,
    "p3_found": p3_found, "p3_similar": p3_similar, "p5_found": p5_found, "p5_counts": p5_counts,
    "p6_found": p6_found, "p6_replayed": p6_replayed, "p6_caught_up": p6_caught_up, "p6_batches": p6_batches, "p7_found": p7_found, "p7_patterns": p7_patterns,
}

__all__ = ["ORACLE", "QUERIES"]
