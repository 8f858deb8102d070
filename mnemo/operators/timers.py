"""Timers derived from events, and what becomes of them when they fire."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import identity, scoring

# Seconds of idleness, debounce, unknown work; attempts.
IDLE, DEBOUNCE, UNKNOWN, ATTEMPTS = 1800, 5, 600, 8


def plus(at: Column, seconds: Column | int) -> Column:
    """Exact for times with microseconds."""
    return F.timestamp_micros(F.unix_micros(at) + F.lit(seconds).cast("long") * 1_000_000)


def _timer(name: str, suffix: Column, work: str = "l1-extract") -> Column:
    return identity.uuid5(identity.SESSION_TIMERS, F.concat(F.lit(f"{work}:"), F.col("session_id"), F.lit(f":{name}"), suffix))


def timer_id(reason: Column) -> Column:
    """Of a session's timer: idle, final, or ramp: and the index of the turn."""
    return identity.uuid5(identity.SESSION_TIMERS, F.concat(F.lit("l1-extract:"), F.col("session_id"), F.lit(":"), reason))


def session_timers(events: DataFrame, idle: int = IDLE) -> DataFrame:
    """events: session_id, kind (started, interactive, turn, completed, failed, awaiting, resumed), turn_index, at. Timers: timer_id, session_id, reason, fire_at.

    The idle timer is armed anew by every activity while it is scheduled, so it fires once, after the first gap longer than `idle`."""
    active = events.filter(F.col("kind").isin("started", "interactive", "turn"))
    after = F.lead("at").over(Window.partitionBy("session_id").orderBy("at"))
    gap = F.unix_micros(after) - F.unix_micros("at") > idle * 1_000_000
    fires = active.withColumn("_gap", F.coalesce(gap, F.lit(True))).filter("_gap").groupBy("session_id").agg(F.min("at").alias("at"))
    idle_rows = fires.select(_timer("idle", F.lit("")).alias("timer_id"), "session_id", F.lit("idle").alias("reason"), plus(F.col("at"), idle).alias("fire_at"))
    ramp = events.filter((F.col("kind") == "turn") & scoring.ramp_turn(F.col("turn_index")))
    ramp_rows = ramp.select(_timer("ramp:", F.col("turn_index").cast("string")).alias("timer_id"), "session_id", F.lit("ramp").alias("reason"), F.col("at").alias("fire_at"))
    final = events.filter(F.col("kind").isin("completed", "failed")).groupBy("session_id").agg(F.min("at").alias("at"))
    final_rows = final.select(_timer("final", F.lit("")).alias("timer_id"), "session_id", F.lit("final").alias("reason"), F.col("at").alias("fire_at"))
    return idle_rows.unionByName(ramp_rows).unionByName(final_rows)


def scene_timers(events: DataFrame, memories: DataFrame, debounce: int = DEBOUNCE) -> DataFrame:
    """events: memory_space_id, memory_id, kind, event_id, at. Tags change no scene. The scope is the memory's."""
    source = (
        F.when(F.col("kind") == "recorded", F.col("memory_id"))
        .when(F.col("kind") == "confidence", F.concat_ws(":", "memory_id", "kind", F.col("event_id").cast("string")))
        .when(F.col("kind").isin("archived", "superseded", "merged"), F.concat_ws(":", "memory_id", "kind"))
    )
    rows = events.withColumn("source_id", source).filter("source_id IS NOT NULL").select("memory_space_id", "memory_id", "source_id", "at")
    scoped = rows.join(memories.select("memory_space_id", "memory_id", "namespace", "scope_kind", "scope_ref"), ["memory_space_id", "memory_id"])
    correlation = identity.correlation_id(F.col("memory_space_id"), F.col("namespace"), F.col("scope_kind"), F.col("scope_ref"))
    return scoped.select(
        identity.uuid5(identity.SCENE_TIMERS, F.concat(F.lit("l2-scene:"), correlation, F.lit(":"), F.col("source_id"))).alias("timer_id"),
        correlation.alias("correlation_id"), "source_id", plus(F.col("at"), debounce).alias("fire_at"),
    )


def persona_timers(changes: DataFrame, debounce: int = DEBOUNCE) -> DataFrame:
    """changes: memory_space_id, namespace, scope_kind, scope_ref, at, for scenes written or deleted. The time is part of the id."""
    correlation = identity.correlation_id(F.col("memory_space_id"), F.col("namespace"), F.col("scope_kind"), F.col("scope_ref"))
    fire = plus(F.col("at"), debounce)
    return changes.select(identity.uuid5(identity.PERSONA_TIMERS, F.concat(F.lit("l3-persona:"), correlation, F.lit(":"), fire.cast("string"))).alias("timer_id"), correlation.alias("correlation_id"), fire.alias("fire_at"))


def schedule(timers: DataFrame) -> DataFrame:
    """One row per id: while a timer hasn't fired, a later request moves it."""
    return timers.groupBy(*[c for c in timers.columns if c != "fire_at"]).agg(F.max("fire_at").alias("fire_at"))


def due(timers: DataFrame, now: Column) -> DataFrame:
    return timers.filter((F.col("status") == "scheduled") & (F.col("fire_at") <= now)).orderBy("fire_at", "timer_id")


def apply_outcomes(timers: DataFrame, now: Column) -> DataFrame:
    """timers fired at `now`, with outcome (completed, retry, dead, foreign), attempts so far, error and memory_space_id. Every claim counts, and
    beyond the ceiling a timer is dead whatever its outcome; one that belongs to other work waits; a dead letter's error names the space."""
    tries = F.col("attempts") + 1
    status = F.when((F.col("outcome") == "dead") | (tries > ATTEMPTS), "dead").when(F.col("outcome") == "completed", "fired").otherwise("scheduled")
    wait = F.when(F.col("outcome") == "foreign", F.lit(UNKNOWN)).otherwise(scoring.timer_delay(tries))
    space = F.concat(F.lit("[memory space "), F.coalesce("memory_space_id", F.lit("unknown")), F.lit("] "))
    return timers.withColumns({
        "new_status": status,
        "new_attempts": tries,
        "new_fire_at": F.when(status == "scheduled", plus(now, wait)).otherwise(F.col("fire_at")),
        "last_error": F.when(status == "dead", F.concat(space, F.coalesce("error", F.lit("")))).otherwise(F.col("error")),
    })


def drain(read: Callable[[], DataFrame], fire: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], now: Column, most_rounds: int = 100) -> int:
    """Fires what is due, all of it together, until nothing is: read gives the timers, fire adds outcome and error, write stores the new state.
    Retries come due later than `now`, so the rounds end; if something is still due after most_rounds, that is an error."""
    for k in range(most_rounds):
        batch = due(read(), now)
        if batch.isEmpty():
            return k
        write(apply_outcomes(fire(batch), now))
    if not due(read(), now).isEmpty():
        raise RuntimeError(f"timers are still due after {most_rounds} rounds")
    return most_rounds
