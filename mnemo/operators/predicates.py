"""Space, scope and target predicates. A read always names its space; each target has its own predicate, never a nullable parameter."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """A namespace as a whole's global bucket, or one entity in it."""

    namespace: str
    kind: str | None = None
    ref: str | None = None

    def __post_init__(self):
        if (self.kind is None) != (self.ref is None):
            raise ValueError("a scope has both kind and ref or neither")
        for part in (self.namespace, self.kind):
            if part is not None and (not part or re.search("[%/:]", part)):
                raise ValueError(f"not a namespace or kind: {part!r}")

    @classmethod
    def parse(cls, text: str) -> Scope:
        """NS or NS:KIND:REF, split at the first two colons."""
        parts = text.split(":", 2)
        if len(parts) == 2 or not parts[0] or len(parts) == 3 and not all(parts):
            raise ValueError(f"not NS or NS:KIND:REF: {text!r}")
        return cls(*parts)


@dataclass(frozen=True)
class ExactScope:
    scope: Scope


@dataclass(frozen=True)
class NamespaceWide:
    namespace: str


Target = ExactScope | NamespaceWide


def legacy_target(scope: Scope) -> Target:
    """What the older interface meant by a scope: its global one was the whole namespace."""
    return NamespaceWide(scope.namespace) if scope.kind is None else ExactScope(scope)


def in_space(space: str) -> Column:
    return F.col("memory_space_id") == space


def in_scope(scope: Scope) -> Column:
    """Exactly this scope. Global: both columns null; a half-null row is in none."""
    if scope.kind is None:
        bound = F.col("scope_kind").isNull() & F.col("scope_ref").isNull()
    else:
        bound = (F.col("scope_kind") == scope.kind) & (F.col("scope_ref") == scope.ref)
    return (F.col("namespace") == scope.namespace) & bound


def in_target(target: Target) -> Column:
    return in_scope(target.scope) if isinstance(target, ExactScope) else F.col("namespace") == target.namespace


def candidates(memories: DataFrame, space: str, target: Target) -> DataFrame:
    """Active memories of a target."""
    return memories.filter((F.col("status") == "active") & in_space(space) & in_target(target))


def needs_embedding() -> Column:
    return F.col("embedding").isNull() | ~F.col("content_hash").eqNullSafe(F.sha2("content", 256))


def whole_scope(df: DataFrame) -> DataFrame:
    """Half-populated scopes made global."""
    half = F.col("scope_kind").isNull() != F.col("scope_ref").isNull()
    return df.withColumns({c: F.when(~half, F.col(c)) for c in ("scope_kind", "scope_ref")})


def reserved_in_scope() -> Column:
    """Scopes whose identity changes under escaping."""
    return F.coalesce(F.concat_ws("", "namespace", "scope_kind", "scope_ref").rlike("[%/:]"), F.lit(False))
