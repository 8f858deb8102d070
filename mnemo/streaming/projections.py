"""Structured Streaming: the memory and session projections kept per key, idle timers by event time, embedding by micro-batch."""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemo.operators import folds
from mnemo.operators.embedding import Embed, embed_batch
from mnemo.operators.reads import embedding_backlog

MEMORY_OUT = "stream_id string, memory_space_id string, status string, superseded_by string, tags string, confidence string, n_events bigint"
#: What an event of each kind sets, and from which of its fields (None: the kind itself).
SETS: dict[str, dict[str, str | None]] = {
    "recorded": {"tags": "tags", "confidence": "confidence"},
    "superseded": {"status": None, "superseded_by": "by"},
    "merged": {"status": None, "superseded_by": "by"},
    "archived": {"status": None},
    "tags": {"tags": "tags"},
    "confidence": {"confidence": "confidence"},
}


def _new(seen: list[list[int]], v: int) -> bool:
    """Whether a version comes for the first time; seen: the versions that came, as runs in order, so what a gap sets apart costs a run and not a version each."""
    at = bisect.bisect_right(seen, v, key=lambda run: run[0])
    if at and v <= seen[at - 1][1]:
        return False
    before, after = bool(at) and seen[at - 1][1] == v - 1, at < len(seen) and seen[at][0] == v + 1
    if before and after:
        seen[at - 1][1] = seen.pop(at)[1]
    elif before:
        seen[at - 1][1] = v
    elif after:
        seen[at][0] = v
    else:
        seen.insert(at, [v, v])
    return True


def _apply(now: dict[str, Any], e: dict[str, Any]) -> None:
    """A field keeps the value of its highest version, in whatever order events arrive, for each space that they name: which of them is the stream's own, its first
    recording tells, and that may come last."""
    v = e["version"]
    if not _new(now["seen"], v):
        return  # delivered again
    own = now["spaces"].setdefault(json.dumps(e["memory_space_id"]), {"first": None, "n_events": 0, "fields": {}})
    own["n_events"] += 1
    if e["kind"] == "recorded":
        own["first"] = v if own["first"] is None else min(v, own["first"])
    for name, source in SETS.get(e["kind"], {}).items():
        held = own["fields"].get(name)
        if held is None or v > held[0]:
            own["fields"][name] = [v, e["kind"] if source is None else e[source]]


def _home(now: dict[str, Any]) -> tuple[str | None, dict[str, Any]] | None:
    """The space of the first recording, with what was folded there."""
    recorded = [(own["first"], space) for space, own in now["spaces"].items() if own["first"] is not None]
    return (json.loads(space := min(recorded)[1]), now["spaces"][space]) if recorded else None


def memory_projection(events: DataFrame) -> DataFrame:
    """Events (as for folds.fold_memories, tags as text) in, the row of every memory they touched out; update mode. Events may come late, before their recording, or
    twice: each field keeps the version that set it, for each space that events name, and the versions seen are kept as runs. So the state has the size of the
    fields, the spaces and the gaps, however many events there are, and even if a recording never comes."""
    columns = "memory_space_id", "kind", "by", "tags", "confidence"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else {"seen": [], "spaces": {}}
        for rows in batches:
            for e in rows.sort_values("version").itertuples():
                _apply(now, {"version": int(e.version)} | {c: None if pd.isna(x := getattr(e, c)) else x for c in columns})
        state.update((json.dumps(now),))
        if (home := _home(now)) is not None:
            space, own = home
            value = lambda name: own["fields"].get(name, [0, None])[1]
            yield pd.DataFrame([{"stream_id": key[0], "memory_space_id": space, "status": value("status") or "active", "superseded_by": value("superseded_by"), "tags": value("tags"), "confidence": value("confidence"), "n_events": own["n_events"]}])

    return events.groupBy("stream_id").applyInPandasWithState(step, MEMORY_OUT, "state string", "update", GroupStateTimeout.NoTimeout)


SESSION_FIELDS = "memory_space_id string, status string, started_us bigint, completed_us bigint, error_message string, summary string, awaiting_reason string, awaiting_correlation_key string, resume_input string, updated_us bigint"


def _session(state: dict[str, Any] | None, e) -> dict[str, Any]:
    now = state or dict.fromkeys([p.split()[0] for p in SESSION_FIELDS.split(", ")]) | {"memory_space_id": e.memory_space_id, "version": -1}
    if e.version <= now["version"]:
        return now  # delivered again
    now = now | {"version": int(e.version), "updated_us": max(now["updated_us"] or 0, int(e.at_us))}
    if e.kind == "turn":
        return now
    now |= {"status": "running" if e.kind in ("started", "resumed") else e.kind, "awaiting_reason": None, "awaiting_correlation_key": None}
    if e.kind in ("started", "interactive"):
        now |= {"started_us": min(now["started_us"] or int(e.at_us), int(e.at_us))}
    elif e.kind in ("completed", "failed"):
        now |= {"completed_us": int(e.at_us), "summary" if e.kind == "completed" else "error_message": e.text}
    elif e.kind == "awaiting":
        now |= {"awaiting_reason": e.text, "awaiting_correlation_key": e.key, "resume_input": None}
    elif e.kind == "resumed":
        now |= {"resume_input": e.text}
    return now


def session_projection(events: DataFrame) -> DataFrame:
    """Events (as for folds.fold_sessions) in, the row of every session they touched out; update mode."""
    names = [p.split()[0] for p in SESSION_FIELDS.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip([*names, "version"], state.get, strict=True)) if state.exists else None
        for e in pd.concat(list(batches)).sort_values("version").itertuples():
            now = _session(now, e)
        state.update(tuple(now[n] for n in [*names, "version"]))
        row = pd.DataFrame([{"stream_id": key[0], **{n: now[n] for n in names}}])
        yield row.astype({n: "Int64" for n in names if n.endswith("_us")})

    rows = events.withColumn("at_us", F.unix_micros("at"))
    out = rows.groupBy("stream_id").applyInPandasWithState(step, f"stream_id string, {SESSION_FIELDS}", f"{SESSION_FIELDS}, version int", "update", GroupStateTimeout.NoTimeout)
    times = {n: F.timestamp_micros(f"{n}_us").alias(f"{n}_at") for n in ("started", "completed", "updated")}
    return out.select("memory_space_id", "stream_id", "status", times["started"], times["completed"], "error_message", "summary", "awaiting_reason", "awaiting_correlation_key", "resume_input", times["updated"])


def idle_timers(activity: DataFrame, idle_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """activity: session_id, at. A row for each stretch of activity once it has been idle so long: a session window closed by the watermark."""
    windows = activity.withWatermark("at", late).groupBy(F.session_window("at", f"{idle_seconds} seconds"), "session_id").agg(F.count("*").alias("n"))
    return windows.select("session_id", F.col("session_window.end").alias("fire_at"), "n")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Everything that is there, then stop."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def upsert_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Micro-batches appended with their number; latest() reads the last row of each key. A batch that runs again writes the same folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/_batch_at={number}")

    return write


def latest(spark, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(f"{path}/_batch_at=*").drop("_batch_at")
    return folds.last_wins(rows, keys, ["_batch"]).drop("_batch")


def embedding_sink(memories: Callable[[], DataFrame], embed: Embed, store: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For each micro-batch of recorded events, embeds those memories that still need it and stores the outcome."""

    def handle(batch: DataFrame, number: int) -> None:
        touched = batch.select("memory_space_id", "memory_id").distinct()
        backlog = embedding_backlog(memories().join(touched, ["memory_space_id", "memory_id"], "left_semi"))
        store(embed_batch(backlog, embed))

    return handle
