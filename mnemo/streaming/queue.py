"""Work that comes due: timers derived from a stream by keyed state, and a durable queue that claims, fires, re-arms and buries them.

The queue is a log of states below a folder: each step appends the new state of the items it touches, and the last one counts, so a step that stopped half-way is seen
whole or not at all, and nothing is rewritten. An item is claimed before it is fired (the claim is an attempt), so a worker that dies in between leaves a claimed item,
which is due again. Items are fired together where they lie; only whether something is due comes to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from mnemo.functions import scoring
from mnemo.operators import timers

STATE = "timer_id string, memory_space_id string, payload string, fire_at timestamp, status string, attempts int, last_error string, turn bigint"
COLUMNS = [c.split()[0] for c in STATE.split(", ")]
Fire = Callable[[DataFrame], DataFrame]


class Queue:
    """Items by timer_id: scheduled, claimed, fired or dead."""

    def __init__(self, spark: SparkSession, path: str, delay: Callable[[Column], Column] = scoring.timer_delay, ceiling: int = timers.ATTEMPTS):
        self.spark, self.path, self.delay, self.ceiling = spark, path, delay, ceiling

    def states(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(self.path)

    def latest(self) -> DataFrame:
        return self.states().groupBy("timer_id").agg(F.max_by(F.struct(*COLUMNS), "turn").alias("s")).select("s.*")

    def _put(self, rows: DataFrame) -> None:
        turn = (self.states().agg(F.max("turn")).first()[0] or 0) + 1
        rows.withColumn("turn", F.lit(turn).cast("long")).select(*[F.col(c) for c in COLUMNS]).write.mode("append").parquet(self.path)

    def schedule(self, rows: DataFrame) -> None:
        """rows: timer_id, fire_at, memory_space_id and perhaps payload. What is scheduled already moves to the later time; what has fired or died, or is claimed, stays as it
        is. Scheduling the same again changes nothing."""
        rows = rows if "payload" in rows.columns else rows.withColumn("payload", F.lit(None).cast("string"))
        new = rows.groupBy("timer_id").agg(F.max("fire_at").alias("fire_at"), F.first("memory_space_id").alias("memory_space_id"), F.max("payload").alias("payload"))
        now = self.latest().select("timer_id", F.col("status").alias("_status"), F.col("fire_at").alias("_at"), F.col("attempts").alias("_attempts"), F.col("last_error").alias("_error"))
        moved = new.join(now, "timer_id", "left").filter("_status IS NULL OR _status = 'scheduled' AND fire_at > _at")
        self._put(moved.withColumns({"status": F.lit("scheduled"), "attempts": F.coalesce("_attempts", F.lit(0)), "last_error": F.col("_error")}))

    def due(self, now: datetime) -> DataFrame:
        """Scheduled items whose time has come, and claimed ones, which nobody finished."""
        return self.latest().filter(F.col("status").isin("scheduled", "claimed") & (F.col("fire_at") <= F.lit(now).cast("timestamp")))

    def claim(self, now: datetime) -> DataFrame | None:
        """What is due, once that it is claimed has been written; None if nothing is."""
        due = self.due(now)
        if due.isEmpty():
            return None
        self._put(due.withColumns({"status": F.lit("claimed"), "attempts": F.col("attempts") + F.when(F.col("status") == "claimed", 0).otherwise(1)}))
        return self.latest().filter((F.col("status") == "claimed") & (F.col("fire_at") <= F.lit(now).cast("timestamp")))

    def settle(self, told: DataFrame, now: datetime) -> None:
        """told: claimed items with outcome (completed, retry, dead, foreign, halt) and error. A dead letter's error names the space; beyond the ceiling an item is dead."""
        outcome = F.col("outcome")
        dead = (outcome == "dead") | ((F.col("attempts") > self.ceiling) & ~outcome.isin("completed", "halt"))
        status = F.when(dead, "dead").when(outcome == "completed", "fired").otherwise("scheduled")
        wait = F.when(outcome == "foreign", F.lit(timers.UNKNOWN)).when(outcome == "halt", F.lit(0)).otherwise(self.delay(F.col("attempts")))
        space = F.concat(F.lit("[memory space "), F.coalesce("memory_space_id", F.lit("unknown")), F.lit("] "))
        error = F.when(dead, F.concat(space, F.coalesce("error", F.lit("")))).otherwise(F.coalesce("error", "last_error"))
        at = F.when(status == "scheduled", timers.plus(F.lit(now).cast("timestamp"), wait)).otherwise(F.col("fire_at"))
        # a claim that a halt undoes was no attempt
        self._put(told.withColumns({"status": status, "fire_at": at, "last_error": error, "attempts": F.col("attempts") - F.when(outcome == "halt", 1).otherwise(0)}))

    def drain(self, fire: Fire, now: datetime, most_rounds: int = 100) -> int:
        """Claims and fires all that is due until nothing is, or until something halts; gives the number of rounds."""
        for k in range(most_rounds):
            if (claimed := self.claim(now)) is None:
                return k
            told = fire(claimed.withColumn("attempts", F.col("attempts") - 1)).withColumn("attempts", F.col("attempts") + 1)
            path = f"{self.path}-told/{now:%Y%m%d%H%M%S%f}-{k}-{self._turns()}"
            told.write.mode("overwrite").parquet(path)  # fired once, settled from what was told
            told = self.spark.read.schema(told.schema).parquet(path)
            self.settle(told, now)
            if not told.filter("outcome = 'halt'").isEmpty():
                return k + 1
        raise RuntimeError(f"items are still due after {most_rounds} rounds")

    def _turns(self) -> int:
        return self.states().agg(F.max("turn")).first()[0] or 0

    def dead(self) -> DataFrame:
        return self.latest().filter("status = 'dead'")


TIMER = "timer_id string, session_id string, reason string, fire_at timestamp"


class SessionTimers(StatefulProcessor):
    """The timers of a session as its events arrive: the idle one is armed anew by every activity until it is due, then it fires once for good; ramp and final ones
    fire at once, the final one once. Keyed state and timers of the state store hold what is armed, so a restart goes on where it stopped."""

    def __init__(self, idle: int = timers.IDLE):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.armed = handle.getValueState("armed", "due_us bigint, fired boolean, final boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        due, fired, final = self.armed.get() if self.armed.exists() else (None, False, False)
        before, was, out = due, fired, []
        for e in pd.concat(list(rows)).sort_values("at_us").itertuples():
            if e.kind in ("started", "interactive", "turn") and not fired:
                fired = due is not None and e.at_us > due
                if not fired:
                    due = max(due or 0, int(e.at_us) + self.idle * 1_000_000)
            if e.kind == "turn" and _ramp(e.turn_index):
                out.append((key[0], "ramp", int(e.turn_index), int(e.at_us)))
            if e.kind in ("completed", "failed") and not final:
                final = True
                out.append((key[0], "final", -1, int(e.at_us)))
        self.armed.update((due, fired, final))
        if before is not None and not was and (fired or due != before):
            self.handle.deleteTimer(before // 1000 + 1)
        if fired and not was:
            out.append((key[0], "idle", -1, due))
        elif due is not None and not fired and due != before:
            self.handle.registerTimer(due // 1000 + 1)
        yield pd.DataFrame(out, columns=["session_id", "reason", "turn_index", "at_us"])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, fired, final = self.armed.get()
        self.armed.update((due, True, final))
        yield pd.DataFrame([] if fired else [(key[0], "idle", -1, due)], columns=["session_id", "reason", "turn_index", "at_us"])


def _ramp(turn: int) -> bool:
    """scoring.ramp_turn of a number."""
    return turn in (1, 2, 4, 8, 16) or turn > 16 and turn % 16 == 0


def session_timers(events: DataFrame, idle: int = timers.IDLE, late: str = "10 minutes") -> DataFrame:
    """events: a stream of session_id, kind, turn_index, at. The rows of timers.session_timers as they come due by event time. Needs the state store on disk
    (spark.sql.streaming.stateStore.providerClass: RocksDBStateStoreProvider)."""
    rows = events.withColumn("at_us", F.unix_micros("at")).withWatermark("at", late)
    told = rows.groupBy("session_id").transformWithStateInPandas(SessionTimers(idle), "session_id string, reason string, turn_index int, at_us bigint", "Append", "EventTime")
    name = F.when(F.col("reason") == "ramp", F.concat(F.lit("ramp:"), F.col("turn_index").cast("string"))).otherwise(F.col("reason"))
    return told.select(timers.timer_id(name).alias("timer_id"), "session_id", "reason", F.timestamp_micros("at_us").alias("fire_at"))
