"""The named reads. Each is a filter with its order; the space predicate is pushed to the scan like the rest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.operators.predicates import Scope, in_scope, in_space, needs_embedding

MEMORY_COLUMNS = (
    "memory_space_id", "memory_id", "agent_id", "session_id", "namespace", "scope_kind", "scope_ref", "memory_type", "content", "priority",
    "confidence", "tags", "status", "superseded_by", "supersedes", "created_at", "updated_at",
)
RECORD_COLUMNS = ("memory_id", "agent_id", "session_id", "namespace", "scope_kind", "scope_ref", "memory_type", "content", "priority", "confidence", "tags", "status", "created_at")


def _rank(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc("priority"), F.desc("created_at"), "memory_id")


def memory_by_id(memories: DataFrame, space: str, memory_id: str) -> DataFrame:
    return memories.filter(in_space(space) & (F.col("memory_id") == memory_id)).select(*MEMORY_COLUMNS)


def active_in_namespace(memories: DataFrame, space: str, namespace: str) -> DataFrame:
    return _rank(memories.filter(in_space(space) & (F.col("status") == "active") & (F.col("namespace") == namespace)).select(*MEMORY_COLUMNS))


def active_by_scope(memories: DataFrame, space: str, scope: Scope) -> DataFrame:
    return _rank(memories.filter(in_space(space) & (F.col("status") == "active") & in_scope(scope)).select(*MEMORY_COLUMNS))


def active_global(memories: DataFrame, space: str, namespace: str) -> DataFrame:
    return active_by_scope(memories, space, Scope(namespace))


def by_session(memories: DataFrame, space: str, session_id: str) -> DataFrame:
    """Of any status."""
    return memories.filter(in_space(space) & (F.col("session_id") == session_id)).select(*MEMORY_COLUMNS).orderBy(F.desc("created_at"), "memory_id")


def active_by_type(memories: DataFrame, space: str, namespace: str, memory_type: str) -> DataFrame:
    return _rank(memories.filter(in_space(space) & (F.col("status") == "active") & (F.col("namespace") == namespace) & (F.col("memory_type") == memory_type)).select(*MEMORY_COLUMNS))


def memory_scope(memories: DataFrame, space: str, memory_id: str) -> DataFrame:
    return memories.filter(in_space(space) & (F.col("memory_id") == memory_id)).select("namespace", "scope_kind", "scope_ref")


def session_by_id(sessions: DataFrame, space: str, session_id: str) -> DataFrame:
    return sessions.filter(in_space(space) & (F.col("session_id") == session_id))


def recent_sessions(sessions: DataFrame, space: str, namespace: str, n: int) -> DataFrame:
    return sessions.filter(in_space(space) & (F.col("namespace") == namespace)).orderBy(F.desc("started_at"), "session_id").limit(n)


def sessions_by_scope(sessions: DataFrame, space: str, namespace: str, kind: str | None, ref: str | None) -> DataFrame:
    """Null-safe on both columns."""
    bound = F.col("scope_kind").eqNullSafe(F.lit(kind)) & F.col("scope_ref").eqNullSafe(F.lit(ref))
    return sessions.filter(in_space(space) & (F.col("namespace") == namespace) & bound).orderBy(F.desc("started_at"), "session_id")


def sessions_by_focus(sessions: DataFrame, space: str, namespace: str, focus: str) -> DataFrame:
    return sessions.filter(in_space(space) & (F.col("namespace") == namespace) & (F.col("focus") == focus)).orderBy(F.desc("started_at"), "session_id")


def sessions_started(sessions: DataFrame, space: str, namespace: str, after: datetime, before: datetime) -> DataFrame:
    """after <= started_at < before."""
    return sessions.filter(in_space(space) & (F.col("namespace") == namespace) & (F.col("started_at") >= F.lit(after)) & (F.col("started_at") < F.lit(before))).orderBy("started_at", "session_id")


def delegation_children(sessions: DataFrame, space: str, parent: str) -> DataFrame:
    return sessions.filter(in_space(space) & (F.col("parent_session_id") == parent)).orderBy("started_at", "session_id")


def awaiting_sessions(sessions: DataFrame, space: str, namespace: str, key: str) -> DataFrame:
    return sessions.filter(in_space(space) & (F.col("namespace") == namespace) & (F.col("status") == "awaiting") & (F.col("awaiting_correlation_key") == key)).orderBy(F.desc("started_at"), "session_id")


def session_turns(turns: DataFrame, space: str, session_id: str) -> DataFrame:
    return turns.filter(in_space(space) & (F.col("session_id") == session_id)).orderBy("turn_index")


def watermark(marks: DataFrame, space: str, session_id: str) -> DataFrame:
    return marks.filter(in_space(space) & (F.col("session_id") == session_id)).select("last_turn_index")


def scenes_by_scope(scenes: DataFrame, space: str, scope: Scope) -> DataFrame:
    return scenes.filter(in_space(space) & in_scope(scope)).orderBy("scene_key", F.desc("updated_at"))


def scene_by_key(scenes: DataFrame, space: str, scope: Scope, key: str) -> DataFrame:
    return scenes_by_scope(scenes.filter(F.col("scene_key") == key), space, scope)


def persona_by_scope(personas: DataFrame, space: str, scope: Scope) -> DataFrame:
    return personas.filter(in_space(space) & in_scope(scope))


def persona_scenes(scenes: DataFrame, space: str, scope: Scope) -> DataFrame:
    return scenes_by_scope(scenes, space, scope).select("scene_id", "title", "body_md", "updated_at")


def embedding_backlog(memories: DataFrame, space: str | None = None) -> DataFrame:
    """Active memories whose vector is missing or stale, oldest first; of every space unless one is given."""
    rows = memories if space is None else memories.filter(in_space(space))
    return rows.filter((F.col("status") == "active") & needs_embedding()).select("memory_space_id", "memory_id", "content", "created_at").orderBy("created_at", "memory_id")


def embedding_state(memories: DataFrame, memory_id: str) -> DataFrame:
    """Not bound to a space, so that a wrong one can be told."""
    return memories.filter((F.col("memory_id") == memory_id) & (F.col("status") == "active")).select("memory_space_id", F.col("embedding").isNotNull().alias("embedded"), "content_hash")
