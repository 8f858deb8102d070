"""Ranking terms, budgets and delays as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking.
RRF_K = 60
HALF_LIFE_DAYS = 30
RECENCY, PRIORITY, CONFIDENCE = 0.10, 0.15, 0.05
PER_MEMORY, TOTAL = 2000, 12000
POOL = 50
LIMIT, LIMIT_MOST = 8, 100


def rrf(rank: Column) -> Column:
    """0 for a missing rank."""
    return F.coalesce(1 / (RRF_K + rank), F.lit(0.0))


def recency(created: Column, now: Column) -> Column:
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(created)) / 86_400_000_000)
    return F.exp(-math.log(2) * days / HALF_LIFE_DAYS)


def priority_weight(priority: Column) -> Column:
    return F.when(priority <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - priority / 100)))


def confidence_weight(confidence: Column) -> Column:
    return F.when(confidence == "high", 1.0).when(confidence == "medium", 0.6).otherwise(0.3)


def blend(fts_rank: Column, vec_rank: Column, created: Column, priority: Column, confidence: Column, now: Column) -> Column:
    return rrf(fts_rank) + rrf(vec_rank) + RECENCY * recency(created, now) + PRIORITY * priority_weight(priority) + CONFIDENCE * confidence_weight(confidence)


def truncated(text: Column, cap: int) -> Column:
    """At most cap characters, the last three dots if something is cut."""
    if cap <= 0:
        return F.lit("")
    cut = F.lit("..."[:cap]) if cap <= 3 else F.concat(F.substring(text, 1, cap - 3), F.lit("..."))
    return F.when(F.length(text) <= cap, text).otherwise(cut)


def ramp_turn(n: Column) -> Column:
    return n.isin(1, 2, 4, 8, 16) | ((n > 16) & (n % 16 == 0))


def timer_delay(attempt: Column) -> Column:
    """Seconds before the next attempt of a timer."""
    return F.least(F.lit(900.0), 30 * F.pow(F.lit(2.0), attempt - 1)).cast("int")


def embedding_delay(attempt: Column) -> Column:
    return F.when(attempt <= 1, 5).when(attempt == 2, 20).when(attempt == 3, 60).otherwise(180)


def store_delay(attempt: Column) -> Column:
    return F.least(F.lit(60.0), 5 * F.pow(F.lit(2.0), attempt)).cast("int")


def provider_delay(attempt: Column) -> Column:
    return 0.2 * F.pow(F.lit(2.0), attempt - 1)


def shown_score(score: Column) -> Column:
    return F.format_string("%.4f", score)


def shown_rank(rank: Column) -> Column:
    return F.coalesce(rank.cast("string"), F.lit("-"))
