"""Ranking features as Columns; every feature lies in [0, 1] and so does the score."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking.
W_PICKS, W_FREQUENCY, W_RECENCY, W_PREFIX, W_CONTEXT = 0.40, 0.21, 0.21, 0.09, 0.09
FREQUENCY_CEILING = 50
RECENCY_HALF_LIFE_DAYS = 7
PICK_HALF_LIFE_DAYS = 21
LITERAL_CREDIT, EXPANDED_CREDIT = 1.0, 0.8


def frequency_score(n: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.greatest(n, F.lit(0))) / F.lit(math.log1p(FREQUENCY_CEILING)))


def recency_score(ts: Column, now: int) -> Column:
    days = F.greatest((F.lit(now) - ts) / F.lit(86400.0), F.lit(0.0))
    return F.exp(-days * F.lit(math.log(2) / RECENCY_HALF_LIFE_DAYS))


def prefix_score(command: Column, query: str) -> Column:
    return F.startswith(F.lower(command), F.lit(query.strip().lower())).cast("double")


def context_score(repo: Column, current: str | None) -> Column:
    """1 in the current repository, a half beside it, else 0; null is nowhere."""
    if not current:
        return F.lit(0.0)
    parent = current.rpartition("/")[0]
    beside = F.contains(repo, F.lit("/")) & (F.regexp_replace(repo, "/[^/]*$", "") == F.lit(parent)) if "/" in current else F.lit(False)
    return F.when(repo == F.lit(current), 1.0).when(beside, 0.5).otherwise(0.0)


def pick_score(weight: Column) -> Column:
    return F.when(weight > 0, 1 - F.pow(F.lit(2.0), -weight)).otherwise(0.0)


def decayed(age_s: Column) -> Column:
    """What one selection of that age still counts."""
    return F.pow(F.lit(0.5), F.greatest(age_s, F.lit(0)) / F.lit(86400.0 * PICK_HALF_LIFE_DAYS))


def idf(df: Column, n: Column) -> Column:
    """How telling a concept is among n candidates, from 1 (in one) down to about 0 (in all)."""
    d = F.least(F.greatest(df, F.lit(1)), n).cast("double")
    top = F.log(1 + (n - 0.5) / F.lit(1.5))
    return F.when(n <= 1, 1.0).otherwise(F.log(1 + (n - d + 0.5) / (d + 0.5)) / top)
