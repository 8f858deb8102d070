"""Lineage: supersession (reachability over edges in either direction), continuation (back pointers), delegation (one hop)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.operators.components import components
from mnemo.operators.predicates import in_space

DEEPEST = 64


def supersession_edges(memories: DataFrame) -> DataFrame:
    """memory_space_id, a, b: links of memories to others of their space that are there."""
    out = memories.select("memory_space_id", F.col("memory_id").alias("a"), F.explode(F.array("supersedes", "superseded_by")).alias("b")).filter("b IS NOT NULL")
    return out.join(memories.select("memory_space_id", F.col("memory_id").alias("b")), ["memory_space_id", "b"], "left_semi").select("memory_space_id", "a", "b")


def supersession_components(memories: DataFrame) -> DataFrame:
    """memory_space_id, memory_id, chain (the least id reachable in the space) of every memory that has a link; all chains of all spaces at once."""
    node = lambda c: F.struct("memory_space_id", F.col(c).alias("memory_id"))
    found, _ = components(supersession_edges(memories).select(node("a").alias("a"), node("b").alias("b")))
    return found.select("node.memory_space_id", "node.memory_id", F.col("component.memory_id").alias("chain"))


def supersession_chain(memories: DataFrame, space: str, memory_id: str, columns: tuple[str, ...] = ("memory_id", "status", "supersedes", "superseded_by", "created_at")) -> DataFrame:
    """All memories reachable inside the space, oldest first. What links the space has are resolved in rounds that grow with the logarithm of the longest
    chain, so a chain of any depth is whole."""
    mine = memories.filter(in_space(space))
    chains = supersession_components(mine).select("memory_id", "chain")
    own = chains.filter(F.col("memory_id") == memory_id).select("chain").distinct()
    ids = chains.join(own, "chain", "left_semi").select("memory_id")
    alone = mine.filter(F.col("memory_id") == memory_id).select("memory_id")
    return mine.join(ids.unionByName(alone).distinct(), "memory_id", "left_semi").select(*columns).orderBy("created_at", "memory_id")


def session_chain(sessions: DataFrame, space: str, session_id: str, most: int = 10_000) -> DataFrame:
    """Back through previous_session_id, each session once, oldest first. Plain recursion in SQL with a path that stops cycles."""
    view = f"_chain_{abs(hash((space, session_id))):x}"
    sessions.filter(in_space(space)).select("session_id", "previous_session_id", "started_at").createOrReplaceTempView(view)
    chain = sessions.sparkSession.sql(
        f"""
        WITH RECURSIVE chain(session_id, previous_session_id, started_at, path) MAX RECURSION LEVEL {most} AS (
            SELECT session_id, previous_session_id, started_at, array(session_id) FROM {view} WHERE session_id = :id
            UNION ALL
            SELECT s.session_id, s.previous_session_id, s.started_at, array_append(c.path, s.session_id)
            FROM chain c JOIN {view} s ON s.session_id = c.previous_session_id
            WHERE NOT array_contains(c.path, s.session_id))
        SELECT session_id, previous_session_id, started_at FROM chain ORDER BY started_at, session_id""",
        args={"id": session_id},
    )
    sessions.sparkSession.catalog.dropTempView(view)  # the plan has been resolved
    return chain


def lineage_reason(session: Column, previous: Column, parent: Column, depth: Column) -> Column:
    """Why a session's links are not valid; null if they are."""
    return (
        F.when(previous == session, "continues itself")
        .when(parent == session, "delegates to itself")
        .when((depth < 0) | (depth > DEEPEST), "depth out of range")
        .when(parent.isNotNull() & (depth < 1), "child at depth 0")
        .when(parent.isNull() & (depth > 0), "root below depth 0")
    )


def existing(ids: DataFrame, memories: DataFrame, space: str) -> DataFrame:
    """Those of ids (memory_id, further columns) that the space has."""
    return ids.join(memories.filter(in_space(space)).select("memory_id"), "memory_id", "left_semi")
