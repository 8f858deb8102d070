"""What a recall will run, decided from the schema and the request before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mnemo.operators.predicates import ExactScope, NamespaceWide, Scope, Target

STRATEGIES = ("keyword", "embedding", "hybrid")
VECTOR_COLUMNS = ("embedding", "content_hash")


@dataclass(frozen=True)
class RecallPlan:
    keyword: bool
    vector: bool
    embed: bool


def probe(memories: DataFrame) -> dict[str, Any]:
    """What a table offers for vectors, from its schema: type, missing columns, declared width."""
    fields = {f.name: f for f in memories.schema}
    column = fields.get("embedding")
    typed = column is not None and isinstance(column.dataType, T.ArrayType) and isinstance(column.dataType.elementType, (T.FloatType, T.DoubleType))
    return {"vector_type": typed or column is None, "missing": [c for c in VECTOR_COLUMNS if c not in fields], "width": column.metadata.get("dimensions") if column is not None else None}


def classify(found: dict[str, Any], dimensions: int | None = None) -> str:
    """available, or the first problem in this order: the type, columns, the width."""
    if not found["vector_type"]:
        return "no vector type"
    if found["missing"]:
        return "missing columns: " + ", ".join(found["missing"])
    if dimensions is not None and found["width"] not in (None, dimensions):
        return f"width {found['width']}, not {dimensions}"
    return "available"


def capability(memories: DataFrame, dimensions: int | None = None) -> str:
    return classify(probe(memories), dimensions)


def plan_recall(capable: str, strategy: str) -> RecallPlan:
    if strategy not in STRATEGIES:
        raise ValueError(f"not a strategy: {strategy}")
    vector = strategy != "keyword" and capable == "available"
    return RecallPlan(keyword=strategy != "embedding" or not vector, vector=vector, embed=vector)


def result_limit(n: int = 8) -> int:
    if not 1 <= n <= 100:
        raise ValueError(f"a limit is 1 to 100, not {n}")
    return n


def decode_target(value: dict[str, Any]) -> Target:
    """The wire form; unknown kinds and surplus fields are errors."""
    shapes = {"namespace_wide": {"namespace"}, "exact_scope": {"scope"}}
    kind = value.get("kind")
    if kind not in shapes or value.keys() - {"kind"} != shapes[kind]:
        raise ValueError(f"not a recall target: {value}")
    if kind == "namespace_wide":
        return NamespaceWide(Scope(value["namespace"]).namespace)
    scope = value["scope"]
    if not isinstance(scope, dict) or not {"namespace"} <= scope.keys() <= {"namespace", "kind", "ref"}:
        raise ValueError(f"not a scope: {scope}")
    return ExactScope(Scope(scope["namespace"], scope.get("kind"), scope.get("ref")))


def encode_target(target: Target) -> dict[str, Any]:
    if isinstance(target, NamespaceWide):
        return {"kind": "namespace_wide", "namespace": target.namespace}
    s = target.scope
    return {"kind": "exact_scope", "scope": {"namespace": s.namespace} | ({"kind": s.kind, "ref": s.ref} if s.kind is not None else {})}


def decode_request(value: dict[str, Any]) -> dict[str, Any]:
    if surplus := value.keys() - {"target", "query", "strategy", "limit"}:
        raise ValueError(f"unknown fields: {sorted(surplus)}")
    strategy = value.get("strategy", "hybrid")
    if strategy not in STRATEGIES:
        raise ValueError(f"not a strategy: {strategy}")
    return {"target": decode_target(value["target"]), "query": str(value["query"]), "strategy": strategy, "limit": result_limit(value.get("limit", 8))}
