"""Failed commands: what followed, whether a retry worked, and what the correction was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.blocks import with_following
from runlore.functions.correction import NOT_FOUND, is_correction
from runlore.functions.text import confidence, contains_all, iso, repo_id, think_seconds
from runlore.runtime import checkpointed

LOOKAHEAD, WINDOW_S = 3, 60


def _failed():
    """Explicitly failed; an unknown exit code is no failure."""
    return F.coalesce(F.col("exit_code") != 0, F.lit(False))


def recent_failures(history: DataFrame, limit: int = 10, repo: str | None = None, any_later: bool = False) -> DataFrame:
    """Failures, newest first, with the next two commands and whether the command later worked.

    ``retried``: the first success of the same command in the repository's history comes after the failure (with
    ``any_later``, any success does). ``limit`` is held between 1 and 50.
    """
    h = history.withColumn("repo_id", repo_id())
    if repo is not None:
        h = h.where(F.col("repo") == repo)
    n = max(1, min(50, limit))
    cols = ["repo_id", "seq", "command", "repo", "ts", "exit_code"]
    # the failures come first, at most 50; the rest of the history is only asked about these
    top = h.where(_failed()).select(*cols).orderBy(F.desc("ts"), F.desc("seq")).limit(n)
    rows = top.collect()
    if not rows:
        none = F.lit(None).cast("array<string>").alias("followed_by")
        return top.select("seq", "command", "repo", "ts", iso(F.col("ts")).alias("at"), "exit_code", none, F.lit(False).alias("retried")).where("false")
    f = history.sparkSession.createDataFrame(rows, top.schema)
    wanted = F.broadcast(f.select(F.col("repo_id").alias("rid"), F.col("seq").alias("fs"), F.col("command").alias("fc")))
    later = h.where((F.col("seq") > min(r["seq"] for r in rows)) & F.col("repo_id").isin(*{r["repo_id"] for r in rows})).select("repo_id", "seq", "command")
    first = later.join(wanted, (F.col("repo_id") == F.col("rid")) & (F.col("seq") > F.col("fs"))).groupBy("fs").agg(F.min(F.struct("seq", "command", "repo_id")).alias("n1"))
    first = history.sparkSession.createDataFrame(first.collect(), first.schema)  # one row a failure
    after = F.broadcast(first.select("fs", F.col("n1.repo_id").alias("rid"), F.col("n1.seq").alias("s1")))
    second = later.join(after, (F.col("repo_id") == F.col("rid")) & (F.col("seq") > F.col("s1"))).groupBy("fs").agg(F.min(F.struct("seq", "command")).alias("n2"))
    pick = F.max if any_later else F.min
    good = h.where("exit_code = 0").join(wanted, (F.col("repo_id") == F.col("rid")) & (F.col("command") == F.col("fc"))).groupBy("fs").agg(pick("seq").alias("good"))
    out = f.withColumn("fs", F.col("seq")).join(first, "fs", "left").join(second, "fs", "left").join(good, "fs", "left")
    followed = F.transform(F.array_compact(F.array("n1.seq", "n2.seq")), lambda s: F.when(s == F.col("n1.seq"), F.col("n1.command")).otherwise(F.col("n2.command")))
    out = out.select("seq", "command", "repo", "ts", iso(F.col("ts")).alias("at"), "exit_code", followed.alias("followed_by"), F.coalesce(F.col("good") > F.col("seq"), F.lit(False)).alias("retried"))
    return out.orderBy(F.desc("ts"), F.desc("seq"))


def _captured(history: DataFrame) -> DataFrame:
    return history.where("command is not null").withColumn("repo_id", repo_id()).select("repo_id", "seq", "command", "ts", "dir", "repo", "exit_code", "duration_ms", F.when(F.col("session") != "", F.col("session")).alias("session"))


def correction_pairs(history: DataFrame) -> DataFrame:
    """Every failure with the commands that may be its correction: repo_id, seq, command, ts, repo, exit_code, place, fix.

    They are among the three commands after it, not earlier, within 60 s of thought (else the look-ahead ends), in the
    same terminal, successful, and of the same program unless it was not found. The failed command succeeding
    unchanged ends the look-ahead.
    """
    h = _captured(history)
    f = with_following(h, ["repo_id"], "seq", LOOKAHEAD, ["command", "ts", "dir", "exit_code", "duration_ms", "session"]).where(_failed())

    def late(n: Column) -> Column:
        return (n["ts"] >= F.col("ts")) & (think_seconds(n["ts"], n["duration_ms"], F.col("ts")) > WINDOW_S)

    def open_(n: Column) -> Column:
        known = F.col("session").isNotNull() & n["session"].isNotNull()
        same = F.when(known, F.col("session") == n["session"]).otherwise(F.col("dir").eqNullSafe(n["dir"]))
        return F.coalesce((n["ts"] >= F.col("ts")) & ~late(n) & same & (n["exit_code"] == 0), F.lit(False))

    # where the look-ahead ends: too late, or the same command worked unchanged
    ends = F.array_position(F.transform("following", lambda n: F.coalesce(late(n) | (open_(n) & (n["command"] == F.col("command"))), F.lit(False))), True)
    word = lambda c: F.try_element_at(F.split(F.regexp_replace(F.trim(c), r"^((sudo|doas)\s+)+", ""), r"\s+"), F.lit(1))
    # different first words can only be a correction of a program that was not found (quotes are left to Python)
    near = lambda n: (word(F.col("command")) == word(n["command"])) | (F.col("exit_code") == NOT_FOUND) | F.rlike(F.concat("command", n["command"]), F.lit("[\"'\\\\]"))
    f = f.withColumn("ends", ends)
    may = F.filter("following", lambda n, i: ((F.col("ends") == 0) | (i < F.col("ends") - 1)) & open_(n) & F.coalesce(near(n), F.lit(False)))
    return f.select("repo_id", "seq", "command", "ts", "repo", "exit_code", F.posexplode(F.transform(may, lambda n: n["command"])).alias("place", "fix"))


def corrections_per_repo(history: DataFrame) -> DataFrame:
    """failed, fix pairs of each repository: occurrences, first_seen, last_seen, exit_code, origin, fix_failures.

    The first of a failure's ``correction_pairs`` that is plausible as the same command typed right is its correction;
    only these few rows reach Python.
    """
    h, may = _captured(history), correction_pairs(history)
    fixed = may.where(is_correction("command", "fix", "exit_code"))
    first = fixed.groupBy("repo_id", "seq").agg(F.min(F.struct("place", "command", "fix", "ts", "repo", "exit_code")).alias("p")).select("repo_id", "seq", "p.*")
    newest = F.struct("ts", (-F.col("seq")).alias("back"))
    pairs = first.groupBy("repo_id", F.col("command").alias("failed"), "fix").agg(
        F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("exit_code", newest).alias("exit_code"), F.max_by("repo", newest).alias("origin")
    )
    pairs = checkpointed(pairs)  # few rows, read three times below
    # how often the fix itself failed afterwards: only texts that are fixes take part
    bad = h.where(_failed()).join(pairs.select("repo_id", F.col("fix").alias("command")).distinct(), ["repo_id", "command"], "left_semi").select("repo_id", F.col("command").alias("fix"), F.col("ts").alias("bad_ts"))
    after = pairs.select("repo_id", "failed", "fix", "last_seen").join(bad, ["repo_id", "fix"]).where("bad_ts > last_seen").groupBy("repo_id", "failed", "fix").agg(F.count("*").alias("fix_failures"))
    return pairs.join(after, ["repo_id", "failed", "fix"], "left").withColumn("fix_failures", F.coalesce("fix_failures", F.lit(0)))


def corrections(history: DataFrame) -> DataFrame:
    """Corrections over all repositories, best first by occurrences, later failures, newness and text."""
    per = corrections_per_repo(history)
    newest = F.struct("last_seen", "repo_id")
    merged = per.groupBy("failed", "fix").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("fix_failures").alias("fix_failures"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max_by("exit_code", newest).alias("exit_code"), F.max_by("origin", newest).alias("repo"),
    )
    return merged.withColumn("confidence", confidence(F.col("occurrences"), 3, 2)).orderBy(F.desc("occurrences"), "fix_failures", F.desc("last_seen"), "fix", "failed")


def latest_failure(history: DataFrame, query: str | None = None, repo: str | None = None) -> DataFrame:
    """The newest failure that matches the query, one of this repository before any other: failed, seq; one row at most."""
    bad = history.where(_failed())
    if query:
        bad = bad.where(contains_all(F.lower("command"), query.split()))
    local = F.coalesce(F.col("repo") == F.lit(repo), F.lit(False))
    return bad.orderBy(F.desc(local), F.desc("ts"), F.desc("seq")).limit(1).select(F.col("command").alias("failed"), "seq")


def fixes_for(history: DataFrame, query: str | None = None, repo: str | None = None, limit: int = 3) -> DataFrame:
    """Corrections of the latest failure that matches the query."""
    found = corrections(history).join(F.broadcast(latest_failure(history, query, repo)), "failed", "left_semi")
    return found.orderBy(F.desc("occurrences"), "fix_failures", F.desc("last_seen"), "fix").limit(limit)
