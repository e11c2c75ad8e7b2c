"""What each tool is used for: frequent commands and their generalised forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlore.functions.text import signature, tool

MIN_COMMANDS, TOP, BUDGET = 5, 10, 50


def tool_patterns(history: DataFrame, top: int = TOP) -> DataFrame:
    """The most frequent commands of every tool with five or more rows: tool, pattern, example, frequency.

    Rows become counts before anything is ranked, so a tool's ranking works on its distinct commands.
    """
    per = history.withColumn("tool", tool(F.col("command"))).where("tool is not null").groupBy("tool", F.col("command").alias("pattern")).agg(F.count("*").alias("frequency"))
    used = per.groupBy("tool").agg(F.sum("frequency").alias("total")).where(F.col("total") >= MIN_COMMANDS)
    w = Window.partitionBy("tool").orderBy(F.desc("frequency"), "pattern")
    best = per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.join(used, "tool").select("tool", "pattern", F.col("pattern").alias("example"), "frequency")


def generalised_patterns(history: DataFrame, cache: DataFrame) -> DataFrame:
    """Frequencies by structural signature, given known patterns (tool, command, pattern).

    Spellings that differ in placeholder names are one pattern, shown in its commonest spelling with its first
    command as example. Commands without a known pattern wait for one and do not count.
    """
    per = history.withColumn("tool", tool(F.col("command"))).groupBy("tool", "command").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    known = per.join(cache, ["tool", "command"]).withColumn("signature", signature(F.col("pattern")))
    spelt = known.groupBy("tool", "signature", "pattern").agg(F.sum("n").alias("n"), F.min(F.struct("first", "command")).alias("ex"))
    return spelt.groupBy("tool", "signature").agg(F.max_by("pattern", F.struct("n", "pattern")).alias("pattern"), F.min("ex")["command"].alias("example"), F.sum("n").alias("frequency"))


def merge_documents(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored patterns (tool, pattern, example, frequency) with those of each tool in ``new`` in place of its own."""
    return stored.join(new.select("tool").distinct(), "tool", "left_anti").unionByName(new)


def corrupt_pattern(command: str = "command", pattern: str = "pattern"):
    """Whether a pattern says nothing (a placeholder that names no kind) or brings in shell metacharacters."""
    empty = ["descriptive_placeholder", "placeholder", "descriptive_id", "descriptive_name", "descriptive_value", "descriptive_namespace", "descriptive_time_range", "value", "arg", "argument"]
    names = F.regexp_extract_all(F.col(pattern), F.lit("<([^>]*)>"), F.lit(1))
    bare = F.regexp_replace(F.col(pattern), "<[^>]*>", "")
    metas = F.array_except(F.filter(F.split(bare, ""), lambda c: c.rlike(r"[;|&<>$`\n]")), F.split(F.col(command), ""))
    return F.arrays_overlap(names, F.array(*[F.lit(e) for e in empty])) | (F.size(metas) > 0)


def trim_invented(command: str = "command", pattern: str = "pattern"):
    """The pattern cut to as many words as the command has."""
    return F.array_join(F.slice(F.split(F.col(pattern), " "), 1, F.size(F.split(F.col(command), " "))), " ")


def next_to_generalise(history: DataFrame, cache: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Commands without a pattern, of the busiest tools first and their most frequent commands first, within a budget."""
    per = history.withColumn("tool", tool(F.col("command"))).where("tool is not null").groupBy("tool", "command").agg(F.count("*").alias("n"))
    volume = per.groupBy("tool").agg(F.sum("n").alias("volume")).where(F.col("volume") >= MIN_COMMANDS)
    new = per.join(cache.select("tool", "command"), ["tool", "command"], "left_anti").join(volume, "tool")
    return new.orderBy(F.desc("volume"), "tool", F.desc("n"), "command").limit(budget).select("tool", "command", "n")


def generalise(commands: DataFrame, generaliser: Callable[[str, str], str]) -> DataFrame:
    """Patterns by a pluggable function of (tool, command), in Arrow batches: tool, command, pattern."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            yield pdf.assign(pattern=[generaliser(t, c) for t, c in zip(pdf["tool"], pdf["command"])])

    return commands.select("tool", "command").mapInPandas(run, "tool string, command string, pattern string")
