"""The event log: JSON payloads decoded with an explicit schema, an older form second, what neither reads set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.functions.identity import LEGACY_SPACE, PRODUCT
from mnemo.schema import EVENTS

DATA = (
    "memoryId string, sessionId string, memorySpaceId string, actorPrincipal string, ownerPrincipal string, agentId string, scope string, memoryType string, content string, priority int, confidence string, "
    "tags array<string>, supersedes string, supersededBy string, mergedInto string, focus string, subjectRef string, previousSessionId string, parentSessionId string, delegationDepth int, modelUsed string, "
    "summary string, errorMessage string, reason string, correlationKey string, deadline timestamp, force boolean, input string, turnId string, turnIndex int, role string, toolSummary string, promptTokens int, "
    "outputTokens int, recordedAt timestamp, supersededAt timestamp, archivedAt timestamp, updatedAt timestamp, mergedAt timestamp, startedAt timestamp, completedAt timestamp, failedAt timestamp, "
    "awaitedAt timestamp, resumedAt timestamp, anchor string, focusType string, focusTarget string, intentionId string"
)
KNOWN = (
    "memory_recorded", "memory_superseded", "memory_archived", "memory_tags_updated", "memory_confidence_updated", "memory_merged", "session_started", "session_completed",
    "session_failed", "session_awaiting", "session_resumed", "interactive_session_recorded", "turn_recorded",
)
# Tags of the older form.
OLDER = {
    "agent_memory_recorded": "memory_recorded", "agent_memory_superseded": "memory_superseded", "agent_memory_archived": "memory_archived", "agent_memory_tags_updated": "memory_tags_updated",
    "agent_memory_confidence_updated": "memory_confidence_updated", "agent_session_started": "session_started", "agent_session_completed": "session_completed", "agent_session_failed": "session_failed",
}
# Names of a session's focus in the older form.
FOCUS = {
    "FocusGeneralCoaching": "general_coaching", "FocusToday": "today", "FocusIntentionReview": "intention_review", "FocusNudge": "nudge", "FocusDailyReflection": "daily_reflection",
    "FocusWeeklyReflection": "weekly_reflection", "FocusNoteHelp": "note_help", "FocusAssist": "assist", "FocusIntentionAssist": "intention_assist", "FocusCollectionExplore": "collection_explore",
    "FocusCreateNote": "create_note", "FocusCreateSkill": "create_skill", "FocusScheduledWork": "scheduled_work", "FocusUpdateNote": "update_note", "FocusAskNote": "ask_note",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def normalised_focus(name: Column) -> Column:
    return F.coalesce(_lookup(FOCUS, name), name)


def _scope(part: int) -> Column:
    """Of {"tag": "ScopeEntity", "contents": [ns, kind, ref]} or {"tag": "ScopeGlobal", "contents": ns}."""
    tag, contents = F.get_json_object("d.scope", "$.tag"), F.get_json_object("d.scope", "$.contents")
    entity = F.try_element_at(F.from_json(contents, "array<string>"), F.lit(part))
    return F.when(tag == "ScopeEntity", entity).when((tag == "ScopeGlobal") & F.lit(part == 1), contents)


def decode(events: DataFrame, legacy_namespace: str = "legacy") -> DataFrame:
    """events: stream_id, version, data (JSON text). Adds kind, the payload's fields with their defaults, and malformed (why it can't be read; such
    rows are to be set aside)."""
    rows = events.withColumn("_type", F.get_json_object("data", "$.type")).withColumn("d", F.from_json(F.get_json_object("data", "$.data"), DATA, {"mode": "PERMISSIVE"}))
    old = _lookup(OLDER, F.col("_type"))
    older = old.isNotNull() | ((F.col("_type") == "interactive_session_recorded") & F.col("d.focusType").isNotNull())
    kind = F.when(F.col("_type").isin(*KNOWN), F.col("_type")).otherwise(old)
    anchor = F.get_json_object("d.anchor", "$.type")
    session_event = kind.isin("session_started", "interactive_session_recorded")
    entity_kind = F.when(anchor.isin("intention", "habit"), anchor).when(session_event & F.col("d.intentionId").isNotNull(), F.lit("intention"))
    entity_ref = F.when(anchor.isin("intention", "habit"), F.get_json_object("d.anchor", "$.id")).when(session_event, F.col("d.intentionId"))
    actor = F.coalesce("d.actorPrincipal", F.when(F.col("d.agentId").isNotNull(), F.concat(F.lit(f"{PRODUCT}:legacy:"), F.col("d.agentId"))), F.lit(f"{PRODUCT}:unattributed"))
    at = F.coalesce(*[F.col(f"d.{c}") for c in ("recordedAt", "supersededAt", "archivedAt", "updatedAt", "mergedAt", "startedAt", "completedAt", "failedAt", "awaitedAt", "resumedAt")])
    problem = (
        F.when(F.col("_type").isNull(), "no type").when(kind.isNull(), "unknown type").when(F.col("d.memoryId").isNull() & F.col("d.sessionId").isNull(), "no id").when(at.isNull(), "no time")
        .when((kind == "memory_recorded") & (F.col("d.content").isNull() | (F.coalesce(F.col("d.scope"), F.col("d.anchor")).isNull())), "incomplete recording")
        .when((kind == "memory_recorded") & older & ~F.coalesce(anchor.isin("intention", "habit", "workspace"), F.lit(False)), "unknown anchor")
    )
    return rows.select(
        *events.columns, kind.alias("kind"), F.coalesce("d.memorySpaceId", F.lit(LEGACY_SPACE)).alias("memory_space_id"), actor.alias("actor"), F.col("d.memoryId").alias("memory_id"), F.col("d.sessionId").alias("session_id"),
        F.coalesce(_scope(1), F.when(older, F.lit(legacy_namespace))).alias("namespace"), F.coalesce(_scope(2), F.when(older, entity_kind)).alias("scope_kind"), F.coalesce(_scope(3), F.when(older, entity_ref)).alias("scope_ref"),
        F.col("d.memoryType").alias("memory_type"), F.col("d.content").alias("content"), F.when(older & (kind == "memory_recorded"), 100).otherwise(F.col("d.priority")).alias("priority"), F.col("d.confidence").alias("confidence"),
        F.array_sort(F.array_distinct(F.coalesce("d.tags", F.array().cast("array<string>")))).alias("tags"), F.coalesce("d.supersededBy", "d.mergedInto").alias("by"), F.coalesce("d.focus", normalised_focus(F.col("d.focusType"))).alias("focus"),
        F.coalesce("d.subjectRef", "d.focusTarget").alias("subject_ref"), F.col("d.previousSessionId").alias("previous_session_id"), F.col("d.parentSessionId").alias("parent_session_id"), F.coalesce("d.delegationDepth", F.lit(0)).alias("delegation_depth"),
        F.col("d.turnIndex").alias("turn_index"), F.col("d.role").alias("role"), F.coalesce("d.reason", "d.errorMessage", "d.summary", "d.input").alias("text"), F.col("d.correlationKey").alias("correlation_key"),
        F.coalesce("d.force", F.when(kind == "session_resumed", F.col("d.correlationKey").isNull())).alias("force"), at.alias("at"), problem.alias("malformed"),
    )


def split(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events, and those to set aside."""
    return decoded.filter("malformed IS NULL").drop("malformed"), decoded.filter("malformed IS NOT NULL").select("stream_id", "version", "data", "malformed")


def log_stream(spark: SparkSession, path: str, event_type: str | None = None) -> DataFrame:
    """The log as a stream of Parquet files; one category's or type's events by a pushed filter."""
    rows = spark.readStream.schema(EVENTS).parquet(path)
    return rows if event_type is None else rows.filter(F.col("event_type") == event_type)
