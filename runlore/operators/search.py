"""Ranked search, its concept-expanded fallback, and the finder's listing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.functions import ranking as R
from runlore.functions.text import contains_all
from runlore.runtime import checkpointed


def _ranked(matched: DataFrame, query: str, now: int, repo: str | None, picks: DataFrame | None) -> DataFrame:
    """One row per command: its best occurrence with the score.

    Frequency, prefix and picks are the same for all rows of a command, so the best row is the one with the
    largest recency and context; both it and the count come from one aggregate that combines before the shuffle.
    """
    part = R.W_RECENCY * R.recency_score(F.col("ts"), now) + R.W_CONTEXT * R.context_score(F.col("repo"), repo)
    best = matched.withColumn("part", part).groupBy("command").agg(
        F.count("*").alias("frequency"), F.max(F.struct("part", "ts", (-F.col("seq")).alias("back"), "repo")).alias("b")
    )
    if picks is None:
        best = best.withColumn("weight", F.lit(0.0))
    else:
        best = best.join(picks.select("command", "weight"), "command", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    score = R.W_PICKS * R.pick_score(F.col("weight")) + R.W_FREQUENCY * R.frequency_score(F.col("frequency")) + F.col("b.part") + R.W_PREFIX * R.prefix_score(F.col("command"), query)
    return best.select("command", F.col("b.ts").alias("ts"), F.col("b.repo").alias("repo"), "frequency", score.alias("score"))


def search_many(history: DataFrame, queries: list[str], now: int, repo: str | None = None, limit: int = 10, picks: DataFrame | None = None) -> DataFrame:
    """Several searches in one pass over the history: query, command, ts, repo, frequency, score.

    The best row and the count of a command do not depend on the query, so a command that meets any of them is
    aggregated once and offered to each it meets.
    """
    low = F.col("command_lc") if "command_lc" in history.columns else F.lower("command")
    hits = history.where(reduce(lambda a, b: a | b, [contains_all(low, q.split()) for q in queries], F.lit(False)))
    ranked = _ranked(hits, "", now, repo, picks)
    asked = F.array_compact(F.array(*[F.when(contains_all(F.lower("command"), q.split()), F.struct(F.lit(k).alias("k"), F.lit(q).alias("query"), R.prefix_score(F.col("command"), q).alias("prefix"))) for k, q in enumerate(queries)]))
    each = ranked.select("command", "ts", "repo", "frequency", (F.col("score") - R.W_PREFIX).alias("base"), F.explode(asked).alias("q"))
    each = each.select("q.k", "q.query", "command", "ts", "repo", "frequency", F.round(F.col("base") + R.W_PREFIX * F.col("q.prefix"), 6).alias("score"))
    w = Window.partitionBy("k").orderBy(F.desc("score"), F.desc("ts"), "command")
    return each.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).select("query", "command", "ts", "repo", "frequency", "score")


def search(history: DataFrame, query: str, now: int, repo: str | None = None, limit: int = 10, picks: DataFrame | None = None) -> DataFrame:
    """Commands holding every word of the query, best first: command, ts, repo, frequency, score (6 places).

    Needs command, ts, repo, seq. An empty query finds nothing. Ties go to the newer, then the text. Over the
    written history table its lower-case column is searched, whose filters reach the Parquet scan.
    """
    low = F.col("command_lc") if "command_lc" in history.columns else F.lower("command")
    hits = history.where(contains_all(low, query.split()))
    out = _ranked(hits, query, now, repo, picks)
    return out.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), F.desc("ts"), "command").limit(limit)


@dataclass(frozen=True)
class Concept:
    """One idea of a query: the words typed for it, and what shells call it."""

    words: tuple[str, ...]
    synonyms: tuple[str, ...] = ()

    def credit(self, command: Column) -> Column:
        low = F.lower(command)
        typed = reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in self.words])
        meant = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s.lower())) for s in self.synonyms], F.lit(False))
        return F.when(typed, R.LITERAL_CREDIT).when(meant, R.EXPANDED_CREDIT).otherwise(0.0)


def layered(shipped: dict[str, list[str]], user: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The shipped concept map with the user's concepts in place of its own."""
    return {**shipped, **(user or {})}


def fold(query: str, concepts: dict[str, list[str]], stopwords: set[str], max_words: int = 3) -> list[Concept]:
    """The ideas of a query: the longest known phrases first, stopwords dropped unless nothing else is left."""
    terms, out, i = query.lower().split(), [], 0
    while i < len(terms):
        width = next((n for n in range(min(max_words, len(terms) - i), 0, -1) if " ".join(terms[i : i + n]) in concepts), 0)
        if width:
            out.append(Concept(tuple(terms[i : i + width]), tuple(concepts[" ".join(terms[i : i + width])])))
        elif terms[i] not in stopwords:
            out.append(Concept((terms[i],)))
        i += max(1, width)
    return out or [Concept((t,)) for t in terms]


def search_expanded(
    history: DataFrame, query: str, concepts: dict[str, list[str]], stopwords: set[str], now: int, repo: str | None = None, limit: int = 10, picks: DataFrame | None = None
) -> DataFrame:
    """Commands that meet at least one idea of the query through a synonym, scored by how much they cover.

    Coverage weighs each idea by how few candidate commands meet it. Document frequencies are counted over
    distinct commands; the credits are columns, one per idea, so no join with the ideas is needed.
    """
    groups = fold(query, concepts, stopwords)
    if not groups:
        return search(history, "", now, repo, limit)
    credits = [f"c{i}" for i in range(len(groups))]
    meant = reduce(lambda a, b: a | b, [g.credit(F.col("command")) == R.EXPANDED_CREDIT for g in groups])
    # one scan: what a synonym meets becomes one row a command, and everything else is worked out on these
    ranked = checkpointed(_ranked(history.where(meant), query, now, repo, picks))
    cand = ranked.withColumns({c: g.credit(F.col("command")) for g, c in zip(groups, credits)})
    df = cand.agg(F.count("*").alias("n"), *[F.count(F.when(F.col(c) > 0, 1)).alias(f"d{c}") for c in credits])
    weights = df.select(*[R.idf(F.col(f"d{c}"), F.col("n")).alias(f"w{c}") for c in credits])  # one row
    total = reduce(lambda a, b: a + b, [F.col(f"w{c}") for c in credits])
    mean = reduce(lambda a, b: a + b, [F.col(c) for c in credits]) / len(credits)
    cover = F.when(total > 0, reduce(lambda a, b: a + b, [F.col(c) * F.col(f"w{c}") for c in credits]) / total).otherwise(mean)
    covered = cand.withColumn("one", F.lit(1)).join(F.broadcast(weights.withColumn("one", F.lit(1))), "one").withColumn("coverage", cover)
    scored = covered.withColumn("score", F.round(F.col("score") * F.col("coverage"), 6))
    return scored.select("command", "ts", "repo", "frequency", "score").orderBy(F.desc("score"), F.desc("ts"), "command").limit(limit)


def search_any(history: DataFrame, query: str, concepts: dict[str, list[str]], stopwords: set[str], now: int, **kw: object) -> DataFrame:
    """The literal search, or the expanded one if the former finds nothing (decided by one short action)."""
    found = search(history, query, now, **kw)
    return found if not found.isEmpty() else search_expanded(history, query, concepts, stopwords, now, **kw)


def newest_distinct(history: DataFrame, limit: int = 200) -> DataFrame:
    """The finder with nothing typed: newest commands, each once."""
    newest = history.groupBy("command").agg(F.max("ts").alias("ts"))
    return newest.orderBy(F.desc("ts"), "command").limit(limit)


def search_sessions(sessions: DataFrame, query: str) -> DataFrame:
    """Sessions whose summary or any command holds the query in any case, newest first."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("summary"), q) | F.exists("commands", lambda c: F.contains(F.lower(c), q))
    return sessions.where(hit).orderBy(F.desc("started_at"), "id")


def pattern_search(patterns: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Patterns whose text or example holds every word, most frequent first."""
    hit = contains_all(F.lower("pattern"), query.split()) | contains_all(F.lower("example"), query.split())
    return patterns.where(hit).orderBy(F.desc("frequency"), "pattern").limit(limit)
