"""Commands against current rows: accepted, duplicate or conflict; and the state machines over a finished log."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.sources import shared


def first_difference(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Name of the first field that differs (nulls equal); null if none. Fields that hold call times are not for comparison."""
    return F.coalesce(*[F.when(~a.eqNullSafe(b), name) for name, (a, b) in pairs.items()])


def record_verdicts(commands: DataFrame, memories: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """commands: memory_space_id, memory_id and fields. verdict: run (no such row), duplicate (all fields equal), conflict (with field)."""
    now = memories.select("memory_space_id", "memory_id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_there"))
    joined = commands.join(now, ["memory_space_id", "memory_id"], "left")
    field = first_difference({f: (F.col(f), F.col(f"_{f}")) for f in fields})
    verdict = F.when(F.col("_there").isNull(), "run").when(field.isNull(), "duplicate").otherwise("conflict")
    return joined.select(*commands.columns, verdict.alias("verdict"), F.when(F.col("_there"), field).alias("field"))


def end_verdicts(commands: DataFrame, memories: DataFrame) -> DataFrame:
    """commands: memory_space_id, memory_id, action (supersede, merge, archive), by. Of a memory that has ended, only the same end is a duplicate."""
    now = memories.select("memory_space_id", "memory_id", F.col("status").alias("_status"), F.col("superseded_by").alias("_by"))
    ends = F.element_at(F.create_map(*[F.lit(x) for x in ("supersede", "superseded", "merge", "merged", "archive", "archived")]), F.col("action"))
    same = (F.col("_status") == ends) & ((F.col("action") == "archive") | F.col("by").eqNullSafe(F.col("_by")))
    verdict = F.when(F.col("_status").isNull(), "not found").when(F.col("_status") == "active", "run").when(same, "duplicate").otherwise("conflict")
    return commands.join(now, ["memory_space_id", "memory_id"], "left").select(*commands.columns, verdict.alias("verdict"))


def change_verdicts(commands: DataFrame, memories: DataFrame, field: str) -> DataFrame:
    """Of tags or confidence: not active refuses; no change is a success without an event."""
    now = memories.select("memory_space_id", "memory_id", F.col("status").alias("_status"), F.col(field).alias("_old"))
    new = F.array_sort(F.array_distinct(field)) if field == "tags" else F.col(field)
    old = F.array_sort(F.array_distinct("_old")) if field == "tags" else F.col("_old")
    verdict = F.when(F.col("_status").isNull(), "not found").when(F.col("_status") != "active", "not active").when(new.eqNullSafe(old), "unchanged").otherwise("run")
    return commands.join(now, ["memory_space_id", "memory_id"], "left").select(*commands.columns, verdict.alias("verdict"))


TURN_FIELDS = ("turn_id", "role", "content", "tool_summary", "prompt_tokens", "output_tokens")


def turn_verdicts(commands: DataFrame, turns: DataFrame) -> DataFrame:
    """duplicate: the index is there with equal content; conflict: with other content, or the turn's id is at another index; else run."""
    here = turns.select("memory_space_id", "session_id", "turn_index", *[F.col(f).alias(f"_{f}") for f in TURN_FIELDS])
    ids = turns.select("memory_space_id", "session_id", "turn_id", F.lit(True).alias("_used")).distinct()
    joined = commands.join(here, ["memory_space_id", "session_id", "turn_index"], "left").join(ids, ["memory_space_id", "session_id", "turn_id"], "left")
    field = first_difference({f: (F.col(f), F.col(f"_{f}")) for f in TURN_FIELDS})
    verdict = F.when(F.col("_turn_id").isNotNull() & field.isNull(), "duplicate").when(F.col("_turn_id").isNotNull() | F.col("_used"), "conflict").otherwise("run")
    return joined.select(*commands.columns, verdict.alias("verdict"))


#: What makes a repeated command the same one: a column of the command, which is the session's own.
SESSION_FIELDS = {
    "complete": ("model_used", "summary"), "fail": ("error_message",),
    "await": ("awaiting_reason", "awaiting_correlation_key", "awaiting_deadline"), "resume": ("resume_input",),
}


def session_verdicts(commands: DataFrame, sessions: DataFrame) -> DataFrame:
    """commands: memory_space_id, session_id, action (complete, fail, await, resume), force and the fields above. verdict: run, duplicate or conflict (the
    state is there already, with equal or other fields, or another end), not found, not running, not awaiting, wrong key. Only force resumes
    without the very key that is awaited, and a missing key is a key too."""
    fields = [f for fs in SESSION_FIELDS.values() for f in fs]
    now = sessions.select("memory_space_id", "session_id", F.col("status").alias("_status"), *[F.col(f).alias(f"_{f}") for f in fields])
    action, status = F.col("action"), F.col("_status")
    differs = F.coalesce(*[F.when(action == a, first_difference({f: (F.col(f), F.col(f"_{f}")) for f in fs})) for a, fs in SESSION_FIELDS.items()])
    again = F.when(differs.isNull(), "duplicate").otherwise("conflict")
    there = F.element_at(F.create_map(*[F.lit(x) for x in ("complete", "completed", "fail", "failed", "await", "awaiting", "resume", "running")]), action)
    open_ = status.isin("running", "awaiting")
    locked = ~F.coalesce(F.col("force"), F.lit(False)) & ~F.col("awaiting_correlation_key").eqNullSafe(F.col("_awaiting_correlation_key"))
    verdict = (
        F.when(status.isNull(), "not found").when(status == there, again)
        .when(action.isin("complete", "fail"), F.when(open_, "run").otherwise("conflict"))
        .when(action == "await", F.when(status == "running", "run").otherwise("not running"))
        .when(status != "awaiting", "not awaiting").when(locked, "wrong key").otherwise("run")
    )
    return commands.join(now, ["memory_space_id", "session_id"], "left").select(*commands.columns, verdict.alias("verdict"))


def memory_machine_violations(events: DataFrame) -> DataFrame:
    """Events of a log that the state machine would not have made: before the recording, a second recording, after the end, or of another space."""
    w = Window.partitionBy("stream_id").orderBy("version")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("kind").over(w)
    ended = F.coalesce(F.max(F.when(F.col("kind").isin("superseded", "archived", "merged"), 1)).over(before), F.lit(0)) == 1
    again = (F.col("kind") == "recorded") & (F.row_number().over(w) > 1)
    away = F.col("memory_space_id") != F.first("memory_space_id").over(w)
    problem = F.when(first != "recorded", "not recorded").when(again, "recorded twice").when(away, "another space").when(ended, "after the end")
    return events.withColumn("problem", problem).filter("problem IS NOT NULL")


#: (state, command): state after it.
SESSION_MOVES = {
    ("none", "start"): "running", ("none", "interactive"): "interactive",
    ("running", "turn"): "running", ("running", "await"): "awaiting", ("running", "complete"): "completed", ("running", "fail"): "failed",
    ("awaiting", "resume"): "running", ("awaiting", "complete"): "completed", ("awaiting", "fail"): "failed",
}


#: Where a run of commands leads: state, awaited key, and the greatest index of a turn in running state (-1: none).
Outcome = tuple[str, str | None, int]
ENDS = {"complete": ("completed", None, -1), "fail": ("failed", None, -1)}
PIECE = "session_id string, piece int, told string"


def summarised(commands: list[tuple]) -> dict:
    """What a run of commands (command, turn_index, key, force) makes of any state before it. Its length bounds it: a running session has one outcome but for
    the last turn, an awaiting one has an outcome for each key that a resume names before the first command that ends the wait anyway."""
    n = len(commands)
    running: list[Outcome] = [("running", None, -1)] * (n + 1)
    exits: dict[str | None, int] = {}
    anyway = n

    def awaiting(key: str | None) -> Outcome:
        at = min(exits.get(key, n), anyway)
        return ("awaiting", key, -1) if at == n else ENDS.get(commands[at][0]) or running[at + 1]

    for i in range(n - 1, -1, -1):
        command, turn, key, force = commands[i]
        after = running[i + 1]
        if command == "turn" and turn is not None:
            after = (*after[:2], max(after[2], turn))
        elif command == "await":
            after = awaiting(key)
        elif command in ENDS:
            after = ENDS[command]
        running[i] = after
        if command in ENDS or command == "resume" and force:
            anyway = i
        elif command == "resume":
            exits[key] = i
    begun = next((i for i, c in enumerate(commands) if c[0] in ("start", "interactive")), n)
    none = ("none", None, -1) if begun == n else ("interactive", None, -1) if commands[begun][0] == "interactive" else running[begun + 1]
    keys = [(k, awaiting(k)) for k, at in exits.items() if at < anyway]
    return {"none": none, "running": running[0], "keys": keys, "else": None if anyway == n else ENDS.get(commands[anyway][0]) or running[anyway + 1]}


def led(state: Outcome, told: dict) -> Outcome:
    """The state after a run of commands; its third part is the last turn."""
    name, key, last = state
    if name == "none":
        return tuple(told["none"])
    if name == "running":
        name, key, top = told["running"]
    elif name == "awaiting":
        found = next((o for k, o in told["keys"] if k == key), told["else"])
        if found is None:
            return state
        name, key, top = found
    else:
        return state
    return name, key, max(last, top)


def _commands(pdf) -> Iterator[tuple]:
    for c in pdf[["session_id", "seq", "command", "turn_index", "key", "force"]].astype(object).itertuples(index=False):
        yield c.session_id, int(c.seq), c.command, None if c.turn_index is None or c.turn_index != c.turn_index else int(c.turn_index), c.key, c.force is True


def replay_sessions(commands: DataFrame) -> DataFrame:
    """commands: session_id, seq, command, turn_index, key, force. Adds accepted and state, as a loop over each session's commands in order gives them.

    Sessions are ranged by their order over tasks, so one with a third of all commands is many pieces. Each piece is summarised as a function of the state
    before it; a session's summaries (one a task at most) are applied in turn, which gives every piece its state, and then all pieces are replayed at once.
    A piece's state comes to it as a row before its commands, so nothing is joined: states are as many as sessions, too many for a broadcast. Commands without
    a session are left aside."""
    spark = commands.sparkSession
    path = shared.folder(spark, "pieces")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = commands.filter("session_id IS NOT NULL").select("session_id", F.col("seq").cast("int").alias("seq"), "command", F.col("turn_index").cast("long").alias("turn_index"), "key", "force")
    slim.repartitionByRange(parts, "session_id", "seq").withColumn("piece", F.spark_partition_id()).write.parquet(path)
    told = spark.read.parquet(path)
    fields, kinds = told.columns, ", ".join(f"{n} {kind}" for n, kind in told.dtypes)

    def summarise(batches):
        held, now = [], None
        for pdf in batches:
            for piece, c in zip(pdf["piece"], _commands(pdf), strict=True):
                if (c[0], piece) != now:
                    if now is not None:
                        yield pd.DataFrame([(*now, json.dumps(summarised(held)))], columns=["session_id", "piece", "told"])
                    held, now = [], (c[0], piece)
                held.append(c[2:])
        if now is not None:
            yield pd.DataFrame([(*now, json.dumps(summarised(held)))], columns=["session_id", "piece", "told"])

    def fold(batches):
        session, state = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.session_id != session:
                    session, state = r.session_id, ("none", None, -1)
                name, key, last = state
                out.append((session, -1, name, last, key, False, r.piece, True))
                state = led(state, json.loads(r.told))
            yield pd.DataFrame(out, columns=[*fields, "first"])

    def replay(batches):
        now, state, key, last = None, None, None, -1
        for pdf in batches:
            out = []
            for piece, first, (session, seq, command, turn, own, force) in zip(pdf["piece"], pdf["first"], _commands(pdf), strict=True):
                if first:
                    now, state, key, last = (session, piece), command, own, turn
                    continue
                if (session, piece) != now:
                    raise RuntimeError(f"commands of {session} without the state before them")
                new = SESSION_MOVES.get((state, command))
                if command == "turn" and not (turn is not None and turn > last) or command == "resume" and not (force or own == key):
                    new = None
                if new is not None:
                    state = new
                    last = turn if command == "turn" else last
                    key = own if command == "await" else None if command == "resume" else key
                out.append((session, seq, command, new is not None, state))
            yield pd.DataFrame(out, columns=["session_id", "seq", "command", "accepted", "state"])

    whole = told.repartition(parts, "session_id", "piece").sortWithinPartitions("session_id", "piece", "seq")
    summaries = whole.mapInPandas(summarise, PIECE)
    states = summaries.repartition(parts, "session_id").sortWithinPartitions("session_id", "piece").mapInPandas(fold, f"{kinds}, first boolean")
    every = states.unionByName(told.withColumn("first", F.lit(False)))
    each = every.repartition(parts, "session_id", "piece").sortWithinPartitions("session_id", "piece", F.desc("first"), "seq")
    return each.mapInPandas(replay, "session_id string, seq int, command string, accepted boolean, state string")


#: The state of a session that commands see and change.
SESSION_STATE = ("status", "model_used", "summary", "error_message", "awaiting_reason", "awaiting_correlation_key", "awaiting_deadline", "resume_input")
WAIT = SESSION_FIELDS["await"]


def _decided(state: dict, c: dict) -> str:
    """session_verdicts for one command against one state."""
    action, status = c["action"], state["status"]
    if status is None:
        return "not found"
    if status == {"complete": "completed", "fail": "failed", "await": "awaiting", "resume": "running"}[action]:
        return "duplicate" if all(c[f] == state[f] for f in SESSION_FIELDS[action]) else "conflict"
    if action in ("complete", "fail"):
        return "run" if status in ("running", "awaiting") else "conflict"
    if action == "await":
        return "run" if status == "running" else "not running"
    if status != "awaiting":
        return "not awaiting"
    return "run" if c["force"] is True or c["awaiting_correlation_key"] == state["awaiting_correlation_key"] else "wrong key"


def _changed(state: dict, c: dict) -> dict:
    """The state once a command has run; a wait ends with whatever runs next."""
    own = {f: c[f] for f in SESSION_FIELDS[c["action"]]}
    waits = {} if c["action"] == "await" else dict.fromkeys(WAIT)
    status = {"complete": "completed", "fail": "failed", "await": "awaiting", "resume": "running"}[c["action"]]
    return state | waits | own | {"status": status} | ({"resume_input": None} if c["action"] == "await" else {})


def apply_session_commands(commands: DataFrame, sessions: DataFrame) -> DataFrame:
    """One batch of commands, each seeing what those before it (by seq) made of the session. commands: as for session_verdicts, with seq and expected_version: how many
    changes of this batch the writer had seen, null for all. Adds verdict, version (changes so far) and status.

    A writer that had not seen the last change has lost a race: its command runs if the session takes it as it is by now, else the session is read again, and where it
    is as the command asked already, by another's doing, that is a duplicate; everything else is `rejected`. A session's rows pass through one task in order, and that task
    holds one state; memory doesn't grow with them."""
    spark = commands.sparkSession
    now = sessions.select("memory_space_id", "session_id", *[F.col(f).alias(f"_{f}") for f in SESSION_STATE])
    key = ["memory_space_id", "session_id"]
    fields = [f for fs in SESSION_FIELDS.values() for f in fs]
    asked = commands.select(*key, "seq", "action", "force", "expected_version", *fields)
    out = [f"{f.name} {f.dataType.simpleString()}" for f in asked.select(*key, "seq", "action").schema.fields]

    def work(batches):
        session, state, version = None, {}, 0
        for pdf in batches:
            rows = []
            for c in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                if (c["memory_space_id"], c["session_id"]) != session:
                    session, version = (c["memory_space_id"], c["session_id"]), 0
                    state = {f: c[f"_{f}"] for f in SESSION_STATE}
                verdict = _decided(state, c)
                if verdict not in ("run", "duplicate", "not found") and c["expected_version"] is not None and c["expected_version"] < version:
                    verdict = "rejected"
                if verdict == "run":
                    state, version = _changed(state, c), version + 1
                rows.append((*session, c["seq"], c["action"], verdict, version, state["status"]))
            yield pd.DataFrame(rows, columns=[*key, "seq", "action", "verdict", "version", "status"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = asked.join(now, key, "left").repartition(parts, *key).sortWithinPartitions(*key, "seq")
    return each.mapInPandas(work, ", ".join(out) + ", verdict string, version bigint, status string")
