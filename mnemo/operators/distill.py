"""Distillation: which evidence, which decisions apply, which artifacts to regenerate. Models are functions the caller injects."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.functions import identity
from mnemo.operators import ordered, reads, recall
from mnemo.operators.predicates import ExactScope, Scope
from mnemo.sources import shared, store

SCOPE = ("memory_space_id", "namespace", "scope_kind", "scope_ref")
ATOM_TYPES = ("fact", "pattern", "preference", "constraint", "instruction")
CONFIDENCES = ("high", "medium", "low")


def max_turn(turns: DataFrame) -> DataFrame:
    return turns.groupBy("memory_space_id", "session_id").agg(F.greatest(F.max("turn_index"), F.lit(0)).alias("max_turn"))


def uncovered(sessions: DataFrame, turns: DataFrame, marks: DataFrame, force: bool = False) -> DataFrame:
    """Sessions with turns beyond their watermark; a session without turns has index 0."""
    tops = sessions.select("memory_space_id", "session_id").join(max_turn(turns), ["memory_space_id", "session_id"], "left").withColumn("max_turn", F.coalesce("max_turn", F.lit(0)))
    both = tops.join(marks.select("memory_space_id", "session_id", "last_turn_index"), ["memory_space_id", "session_id"], "left")
    return both if force else both.filter(F.col("last_turn_index").isNull() | (F.col("last_turn_index") < F.col("max_turn")))


def joined(lines: Column, order: list[str], sep: str) -> Column:
    """Lines of a group in order; for use in agg."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, lines.alias("_line")))), lambda x: x["_line"]), sep)


def turn_line() -> Column:
    tools = F.coalesce(F.concat(F.lit("\n   tools: "), F.col("tool_summary")), F.lit(""))
    return F.concat(F.col("turn_index").cast("string"), F.lit(". "), F.col("role"), F.lit(": "), F.col("content"), tools)


def render_turns(turns: DataFrame) -> DataFrame:
    return turns.groupBy("memory_space_id", "session_id").agg(joined(turn_line(), ["turn_index"], "\n").alias("text"))


def atom_line() -> Column:
    return F.concat(F.lit("- "), F.col("memory_id"), F.lit(" ("), F.col("memory_type"), F.lit(", "), F.col("confidence"), F.lit("): "), F.col("content"))


def memory_line() -> Column:
    return F.concat(F.lit("- "), F.col("memory_type"), F.lit(": "), F.col("content"))


def scene_text(title: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), body)


def evidence(turns: DataFrame, memories: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session the text to extract from, and its source: its turns, else memories of the session, else active memories of its scope."""
    key = ["memory_space_id", "session_id"]
    by_turns = render_turns(turns).withColumn("source", F.lit("turns"))
    rank = ["priority", "_age", "memory_id"]
    aged = memories.withColumn("_age", -F.unix_micros("created_at"))
    by_session = aged.filter("session_id IS NOT NULL").groupBy(*key).agg(joined(memory_line(), ["_age", "memory_id"], "\n").alias("text"))
    left = sessions.select(*key, "namespace", "scope_kind", "scope_ref").join(by_turns.select(*key), key, "left_anti")
    second = left.join(by_session, key).select(*key, "text").withColumn("source", F.lit("session memories"))
    rest = left.join(by_session.select(*key), key, "left_anti")
    # the text of a scope is built once, however many sessions ask for it
    scopes = aged.filter("status = 'active'").groupBy(*SCOPE).agg(joined(memory_line(), rank, "\n").alias("text"))
    same = [rest[c].eqNullSafe(scopes[c]) for c in SCOPE]
    third = rest.join(scopes, same).select(*[rest[c] for c in key], scopes["text"]).withColumn("source", F.lit("scope memories"))
    return by_turns.select(*key, "text", "source").unionByName(second).unionByName(third)


def evidence_lines(turns: DataFrame, memories: DataFrame, sessions: DataFrame) -> DataFrame:
    """The same evidence as rows: memory_space_id, session_id, source, position, start, line. A session's turns, and a scope's memories, of any number."""
    key = ["memory_space_id", "session_id"]
    told = ordered.numbered(turns.select(*key, "turn_index", turn_line().alias("line")), key, ["turn_index"], F.length("line") + 1)
    by_turns = told.select(*key, F.lit("turns").alias("source"), "position", "start", "line")
    aged = memories.withColumn("_age", -F.unix_micros("created_at")).withColumn("line", memory_line())
    own = ordered.numbered(aged.filter("session_id IS NOT NULL").select(*key, "_age", "memory_id", "line"), key, ["_age", "memory_id"], F.length("line") + 1)
    left = sessions.select(*key, "namespace", "scope_kind", "scope_ref").join(turns.select(*key).distinct(), key, "left_anti")
    second = own.join(left.select(*key), key, "left_semi").select(*key, F.lit("session memories").alias("source"), "position", "start", "line")
    rest = left.join(memories.select(*key).distinct(), key, "left_anti").alias("r")
    scoped = aged.filter("status = 'active'").select(*SCOPE, "priority", "_age", "memory_id", "line")
    scopes = ordered.numbered(scoped, list(SCOPE), ["priority", "_age", "memory_id"], F.length("line") + 1).alias("s")
    third = rest.join(scopes, _same_scope("r", "s")).select(*[F.col(f"r.{c}") for c in key], F.lit("scope memories").alias("source"), "position", "start", "line")
    return by_turns.unionByName(second).unionByName(third)


def validate_atoms(atoms: DataFrame) -> DataFrame:
    """extraction_id, content, atom_type, priority, confidence: normalised, with error; one bad atom makes its whole extraction fail."""
    strip = lambda c: F.regexp_replace(F.col(c), r"^\s+|\s+$", "")
    norm = atoms.withColumns({"content": strip("content"), "atom_type": F.lower(strip("atom_type")), "confidence": F.lower(strip("confidence")), "priority": F.greatest(F.lit(0), F.least(F.lit(100), F.col("priority")))})
    problem = F.when(F.col("content") == "", "atom content must be non-empty").when(~F.col("atom_type").isin(*ATOM_TYPES), "atom type unknown").when(~F.col("confidence").isin(*CONFIDENCES), "confidence unknown")
    flagged = norm.withColumn("error", problem)
    bad = flagged.groupBy("extraction_id").agg(F.count("error").alias("bad_atoms"))
    return flagged.join(bad, "extraction_id").withColumn("accepted", F.col("bad_atoms") == 0)


def decision_problem(action: Column, targets: Column) -> Column:
    """Update and merge need a target, each a typed id."""
    acts = action.isin("update", "merge")
    bad = F.exists(targets, lambda t: ~t.rlike("^(?:[a-z](?:[a-z_]*[a-z])?_)?[0-7][0-9a-hjkmnp-tv-z]{25}$"))
    return F.when(acts & (F.size(targets) == 0), F.concat(action, F.lit(" requires at least one target"))).when(acts & bad, "a target is no id")


def canonical_decision(decisions: DataFrame) -> DataFrame:
    """decisions: action, targets. Adds `problem`; what stores or skips names no target, so stray ones are cleared."""
    kept = F.when(F.col("action").isin("store", "skip"), F.array().cast("array<string>")).otherwise(F.col("targets"))
    return decisions.withColumn("targets", kept).withColumn("problem", decision_problem(F.col("action"), F.col("targets")))


def scan_candidates(memories: DataFrame, space: str, scope: Scope, n: int) -> DataFrame:
    """Merge candidates: the first n active memories of the scope, in the order of reads."""
    return reads.active_by_scope(memories, space, scope).limit(max(0, n))


def recall_candidates(memories: DataFrame, space: str, scope: Scope, atom: str, n: int, now: datetime, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
    """Merge candidates by relevance to the atom, in exactly this scope; none for n of 0 or less."""
    if n <= 0:
        return memories.select(*reads.RECORD_COLUMNS).limit(0)
    return recall.recall(memories, space, ExactScope(scope), atom, now, limit=min(n, 100), embed=embed)


def apply_decisions(decisions: DataFrame, memories: DataFrame) -> DataFrame:
    """decisions: decision_id, memory_space_id, own_id, action, targets. Adds applied (skip, store, merge), live_targets (of a merge alone) and note: a target that is
    the atom itself goes, with no other left it is skipped; a winner that is there and not active is skipped, whatever its targets; missing targets go, and
    with none left, or none given, it is stored."""
    state = memories.select("memory_space_id", F.col("memory_id").alias("own_id"), F.col("status").alias("own_status"))
    others = F.filter("targets", lambda t: t != F.col("own_id"))
    rows = decisions.withColumn("others", F.array_distinct(others)).join(state, ["memory_space_id", "own_id"], "left")
    hit = rows.select("decision_id", "memory_space_id", F.posexplode("others").alias("pos", "memory_id")).join(memories.select("memory_space_id", "memory_id"), ["memory_space_id", "memory_id"], "left_semi")
    live = hit.groupBy("decision_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "memory_id"))), lambda x: x["memory_id"]).alias("live_targets"))
    rows = rows.join(live, "decision_id", "left").withColumn("live_targets", F.coalesce("live_targets", F.array().cast("array<string>")))
    merging, inactive = F.col("action").isin("update", "merge"), F.coalesce(F.col("own_status") != "active", F.lit(False))
    only_self = (F.size("targets") > 0) & (F.size("others") == 0)
    applied = (
        F.when(F.col("action") == "skip", "skip")
        .when(F.col("action") == "store", "store")
        .when(merging & only_self, "skip")
        .when(merging & inactive, "skip")
        .when(merging & (F.size("live_targets") == 0), "store")
        .otherwise("merge")
    )
    note = (
        F.when(merging & only_self, "only target is itself")
        .when(merging & inactive, "winner is not active")
        .when(merging & (F.size("targets") == 0), "no target given")
        .when(merging & (F.size("live_targets") == 0), "no target exists")
        .when(merging & (F.size("live_targets") < F.size("others")), "some targets don't exist")
    )
    rows = rows.withColumns({"applied": applied, "note": note})
    none = F.array().cast("array<string>")
    return rows.withColumn("live_targets", F.when(F.col("applied") == "merge", F.col("live_targets")).otherwise(none)).drop("others", "own_status")


def summary(applied: DataFrame) -> DataFrame:
    return applied.groupBy("session_id").agg(F.count("*").alias("extracted"), *[F.count_if(F.col("applied") == a).alias(n) for a, n in (("store", "stored"), ("merge", "merged"), ("skip", "skipped"))])


def scene_lines(memories: DataFrame) -> DataFrame:
    """A row for each active memory of a scope: position, start (characters before it in the rendering), memory_id, line, leaf (its part of the source hash)."""
    rows = memories.filter("status = 'active'").withColumn("_age", -F.unix_micros("created_at"))
    leaves = ordered.leaf(F.col("memory_id"), F.col("content"), F.col("priority"), F.col("confidence"), F.unix_micros("created_at"))
    slim = rows.select(*SCOPE, "priority", "_age", "memory_id", atom_line().alias("line"), leaves.alias("leaf"))
    return ordered.numbered(slim, list(SCOPE), ["priority", "_age", "memory_id"], F.length("line") + 1).drop("priority", "_age")


def persona_lines(scenes: DataFrame) -> DataFrame:
    """A row for each scene of a scope, as scene_lines."""
    leaves = ordered.leaf(F.col("scene_id"), F.col("body_md"), F.unix_micros("updated_at"))
    slim = scenes.select(*SCOPE, "scene_key", "scene_id", scene_text(F.col("title"), F.col("body_md")).alias("line"), leaves.alias("leaf"))
    return ordered.numbered(slim, list(SCOPE), ["scene_key", "scene_id"], F.length("line") + 2).drop("scene_key")


def source_hashes(lines: DataFrame) -> DataFrame:
    """SCOPE, n, hash."""
    return ordered.digest(lines, list(SCOPE), F.col("leaf"))


def _same_scope(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in SCOPE]


def _rendered(lines: DataFrame, sep: str, ids: str | None) -> DataFrame:
    """SCOPE, text and, of scenes, atom_ids: one cell a scope, as the model reads it."""
    return ordered.assembled(lines, list(SCOPE), sep, F.col("line"), **({"atom_ids": F.col(ids)} if ids else {}))


def _with_text(hashes: DataFrame, lines: DataFrame, sep: str, ids: str | None = None) -> DataFrame:
    whole = _rendered(lines, sep, ids)
    return hashes.alias("h").join(whole.alias("w"), _same_scope("h", "w"), "left").select("h.*", *[F.col(f"w.{c}") for c in whole.columns if c not in SCOPE])


def scene_sources(memories: DataFrame) -> DataFrame:
    """Per scope of active memories: hash, atom_ids in order, their rendering. For scopes of any size use scene_lines and source_hashes."""
    lines = scene_lines(memories)
    return _with_text(source_hashes(lines), lines, "\n", "memory_id").select(*SCOPE, "hash", "atom_ids", "text")


def persona_sources(scenes: DataFrame) -> DataFrame:
    lines = persona_lines(scenes)
    return _with_text(source_hashes(lines), lines, "\n\n").select(*SCOPE, "hash", F.col("n").cast("int").alias("scene_count"), "text")


def _actions(lines: DataFrame, stored: DataFrame, sep: str, ids: str | None = None) -> DataFrame:
    """Hashes decide; only what is to be regenerated is rendered."""
    t = stored.select(*SCOPE, F.col("source_hash").alias("stored_hash")).alias("t")
    both = source_hashes(lines).alias("s").join(t, _same_scope("s", "t"), "full")
    action = F.when(F.col("s.hash").isNull(), "delete").when(F.col("s.hash").eqNullSafe(F.col("t.stored_hash")), "keep").otherwise("regenerate")
    told = both.select(*[F.coalesce(f"s.{c}", f"t.{c}").alias(c) for c in SCOPE], action.alias("action"), F.col("s.hash").alias("hash"), F.col("s.n").alias("n"))
    todo = told.filter("action = 'regenerate'").select(*SCOPE).alias("todo")
    return _with_text(told, lines.alias("lines").join(todo, _same_scope("lines", "todo"), "left_semi"), sep, ids)


def scene_actions(memories: DataFrame, scenes: DataFrame) -> DataFrame:
    """delete where no active memory is left, keep where the hash is the same, else regenerate (one model call, of text and atom_ids)."""
    return _actions(scene_lines(memories), scenes, "\n", "memory_id").drop("n")


def persona_actions(scenes: DataFrame, personas: DataFrame) -> DataFrame:
    return _actions(persona_lines(scenes), personas, "\n\n").withColumn("scene_count", F.col("n").cast("int")).drop("n")


def regenerate(actions: DataFrame, model: Callable[[str], str], column: str = "body_md") -> DataFrame:
    """Runs the model over the texts to regenerate, in the tasks that hold them."""
    todo = actions.filter("action = 'regenerate'")

    def work(batches):
        for pdf in batches:
            yield pdf.assign(**{column: [model(t) for t in pdf.text]})

    return todo.mapInPandas(work, todo.schema.simpleString()[7:-1] + f",{column}:string")


def _once(df: DataFrame, name: str) -> DataFrame:
    """Written, so that a model is called once for each row of it."""
    path = shared.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scene_rows(actions: DataFrame, scene: Callable[[str], tuple[str, str]], at: datetime) -> DataFrame:
    """Rows of scenes for what is to be regenerated; the model gives title and body."""
    todo = actions.filter("action = 'regenerate'").select(*SCOPE, "hash", "atom_ids", "text")

    def work(batches):
        for pdf in batches:
            made = [scene(t) for t in pdf.text]
            yield pdf.drop(columns="text").assign(title=[t for t, _ in made], body_md=[b for _, b in made])

    made = todo.mapInPandas(work, todo.drop("text").schema.simpleString()[7:-1] + ",title:string,body_md:string")
    now = F.lit(at).cast("timestamp")
    own = identity.scene_id(F.col("namespace"), F.col("scope_kind"), F.col("scope_ref"))
    return made.select("memory_space_id", own.alias("scene_id"), "namespace", "scope_kind", "scope_ref", F.lit("default").alias("scene_key"), "title", "body_md", "atom_ids", F.col("hash").alias("source_hash"), now.alias("created_at"), now.alias("updated_at"))


def persona_rows(actions: DataFrame, persona: Callable[[str], str], at: datetime) -> DataFrame:
    """Rows of personas for what is to be regenerated."""
    made, now = regenerate(actions.drop("stored_hash"), persona), F.lit(at).cast("timestamp")
    own = identity.persona_id(F.col("namespace"), F.col("scope_kind"), F.col("scope_ref"))
    return made.select("memory_space_id", own.alias("persona_id"), "namespace", "scope_kind", "scope_ref", "body_md", "scene_count", F.col("hash").alias("source_hash"), now.alias("created_at"), now.alias("updated_at"))


def sink_scenes(path: str, actions: DataFrame, scene: Callable[[str], tuple[str, str]], at: datetime) -> None:
    """Actions on scenes applied to the stored table: one model call a scope that changed, one swap of the partitions touched."""
    _sink(path, "scenes", "scene_id", actions, lambda a: scene_rows(a, scene, at), identity.scene_id)


def sink_personas(path: str, actions: DataFrame, persona: Callable[[str], str], at: datetime) -> None:
    _sink(path, "personas", "persona_id", actions, lambda a: persona_rows(a, persona, at), identity.persona_id)


def _sink(path: str, table: str, key: str, actions: DataFrame, rows: Callable[[DataFrame], DataFrame], own: Callable[..., Column]) -> None:
    told = _once(actions.filter("action <> 'keep'"), "actions")
    gone = told.filter("action = 'delete'").select("memory_space_id", "namespace", own(F.col("namespace"), F.col("scope_kind"), F.col("scope_ref")).alias(key))
    store.apply(told.sparkSession, path, table, _once(rows(told), table), gone)


@dataclass
class Models:
    """The four programs: extract(text) -> atoms, consolidate(atom, candidates) -> decision, scene(text) -> (title, body), persona(text) -> body."""

    extract: Callable[[str], list[dict]]
    consolidate: Callable[[dict, list[dict]], dict]
    scene: Callable[[str], tuple[str, str]] | None = None
    persona: Callable[[str], str] | None = None


@dataclass
class Pass:
    """What one session's pass did."""

    session_id: str
    ran: bool
    last_turn: int
    stored: list[dict] = field(default_factory=list)
    merged: list[dict] = field(default_factory=list)
    audit: list[dict] = field(default_factory=list)


def checked_atoms(atoms: list[dict]) -> list[dict]:
    """The atoms of an extraction in canonical form; one invalid atom makes it all invalid."""
    out = []
    for a in atoms:
        content, kind, sure = a["content"].strip(), a.get("atom_type", "fact").strip().lower(), a.get("confidence", "medium").strip().lower()
        if not content or kind not in ATOM_TYPES or sure not in CONFIDENCES:
            raise ValueError(f"invalid atom: {a}")
        out.append({"content": content, "atom_type": kind, "confidence": sure, "priority": max(0, min(100, a.get("priority", 100)))})
    return out


def atom_id(session_id: str, content: str) -> str:
    return identity.type_id("memory", uuid.uuid5(identity.ATOMS, f"{session_id}:{content}"))


def fold_atoms(session_id: str, atoms: list[dict], rows: dict[str, dict], consolidate: Callable[[dict, list[dict]], dict], done: Pass, candidates: int, decided: list[dict], absent: set[str] | None = None) -> set[str]:
    """Applies atoms one after the other; later ones see what earlier ones stored and merged. rows: memories by id, changed in place. decided: what the model said before, and
    what it says now; it is asked once an atom. Where a decision needs a memory that is neither in rows nor known to be absent, the fold stops before it and
    gives the ids to look up (absent of None: what is not in rows is not there)."""
    for i, a in enumerate(atoms):
        own = atom_id(session_id, a["content"])
        active = sorted((m for m in rows.values() if m["status"] == "active" and not m.get("elsewhere")), key=lambda m: (m.get("priority", 100), -m["created_at"].timestamp() if m.get("created_at") else float("-inf"), m["memory_id"]))
        if i == len(decided):
            decided.append(consolidate(a, active[: max(0, candidates)]))
        choice = decided[i]
        action, note, told = choice["action"], None, choice["action"]
        asked = choice.get("targets") or [] if action in ("update", "merge") else []  # stray targets of others are cleared
        wanted = [t for t in dict.fromkeys(asked) if t != own]
        if absent is not None and (unknown := {t for t in wanted if t not in rows and t not in absent}):
            return unknown
        live = [t for t in wanted if t in rows]
        if action in ("update", "merge"):
            if asked and not wanted:
                action, note = "skip", "only target is itself"
            elif own in rows and rows[own]["status"] != "active":
                action, note = "skip", "winner is not active"
            elif not wanted:
                action, note = "store", "no target given"
            elif not live:
                action, note = "store", "no target exists"
            else:
                action = "merge"
        if action in ("store", "merge"):
            new = {"memory_id": own, "content": choice.get("content") or a["content"], "memory_type": a["atom_type"], "priority": a["priority"], "confidence": a["confidence"], "tags": ["distilled", "l1"], "status": "active", "supersedes": live[0] if action == "merge" else None}
            rows[own] = new
            done.stored.append(new)
        if action == "merge":
            for t in live:
                rows[t]["status"] = "merged"
                done.merged.append({"memory_id": t, "merged_into": own})
        rationale = choice.get("rationale", "") + (f" [{note}]" if note else "")
        done.audit.append({"candidate_content": a["content"], "decision": told if action == "merge" else action, "targets": live if action == "merge" else [], "rationale": rationale, "result_memory_id": own if action in ("store", "merge") else None})
    return set()


def distill_session(turns: list[dict], memories: list[dict], mark: int | None, session: dict, models: Models, candidates: int = 5, force: bool = False) -> Pass:
    """One session's rows, as a single call. An invalid extraction raises before anything is applied, and the watermark stays. operators.passes runs
    the same over tables."""
    top = max([0, *(t["turn_index"] for t in turns)])
    if mark is not None and mark >= top and not force:
        return Pass(session["session_id"], False, mark)
    done, rows = Pass(session["session_id"], True, top), {m["memory_id"]: dict(m) for m in memories}
    lines = [f"{t['turn_index']}. {t['role']}: {t['content']}" for t in sorted(turns, key=lambda t: t["turn_index"])] or [f"- {m['memory_type']}: {m['content']}" for m in memories]
    fold_atoms(session["session_id"], checked_atoms(models.extract("\n".join(lines))), rows, models.consolidate, done, candidates, [])
    return done
