"""Upkeep of the tables: inherited spaces, drift, duplicates, recomputed identities, the registry of read models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions import identity
from mnemo.operators.folds import last_wins
from mnemo.operators.predicates import reserved_in_scope


def inherit_space(child: DataFrame, sessions: DataFrame, default: str = identity.LEGACY_SPACE) -> DataFrame:
    """Rows without a space take their session's, else the legacy space."""
    parent = sessions.select("session_id", F.col("memory_space_id").alias("_s"))
    return child.join(parent, "session_id", "left").withColumn("memory_space_id", F.coalesce("memory_space_id", "_s", F.lit(default))).drop("_s")


def space_drift(child: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows whose space isn't their session's."""
    parent = sessions.select("session_id", F.col("memory_space_id").alias("session_space"))
    return child.join(parent, "session_id").filter(~F.col("memory_space_id").eqNullSafe(F.col("session_space")))


def unattributed(tables: dict[str, DataFrame]) -> DataFrame:
    """n: rows of all tables without a space."""
    counts = [df.agg(F.count_if(F.col("memory_space_id").isNull() | (F.col("memory_space_id") == "")).alias("n")) for df in tables.values()]
    return reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("n"))


def backfilled(tables: dict[str, DataFrame], sessions: DataFrame) -> dict[str, DataFrame]:
    """All tables with spaces; raises if a row is left without one or drifts from its session."""
    done = {n: inherit_space(df, sessions) if "session_id" in df.columns and n != "sessions" else df.withColumn("memory_space_id", F.coalesce("memory_space_id", F.lit(identity.LEGACY_SPACE))) for n, df in tables.items()}
    if left := unattributed(done).first()["n"]:
        raise ValueError(f"{left} rows have no space")
    if drift := sum(space_drift(df, done.get("sessions", sessions)).count() for n, df in done.items() if n in ("turns", "l1_watermarks")):
        raise ValueError(f"{drift} rows have another space than their session")
    return done


def keep_newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return last_wins(df, keys, order)


def recomputed_ids(df: DataFrame, column: str, make) -> DataFrame:
    """Ids of rows whose scope has reserved characters, computed anew; others as they are."""
    new = make(F.col("namespace"), F.col("scope_kind"), F.col("scope_ref"))
    return df.withColumn(column, F.when(reserved_in_scope(), new).otherwise(F.col(column)))


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of child without a parent; keys map child columns to parent columns."""
    p = parent.select(*[F.col(b).alias(f"_{b}") for b in keys.values()]).distinct()
    return child.join(p, [F.col(a) == F.col(f"_{b}") for a, b in keys.items()], "left_anti")


def reconcile(expected: DataFrame, registry: DataFrame) -> DataFrame:
    """name, outcome: registered (wasn't there), reconciled (another version or shape), current. Both: name, version, shape."""
    r = registry.select("name", F.col("version").alias("_v"), F.col("shape").alias("_s"))
    outcome = F.when(F.col("_v").isNull(), "registered").when((F.col("_v") != F.col("version")) | (F.col("_s") != F.col("shape")), "reconciled").otherwise("current")
    return expected.join(r, "name", "left").select("name", outcome.alias("outcome"))


def registry_complete(registry: DataFrame, names: list[str], version: int) -> DataFrame:
    """complete, all_live: whether all names are there, and all of this version and live (null if none is)."""
    rows = registry.filter(F.col("name").isin(names))
    return rows.agg((F.count(F.lit(1)) == len(names)).alias("complete"), F.every((F.col("version") == version) & (F.col("status") == "live")).alias("all_live"))


def renamed(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Old names replaced through a short inline table."""
    if not names:
        return df
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn(column, F.coalesce(table[F.col(column)], F.col(column)))


def manifest_lines(manifest: DataFrame, files: list[str]) -> DataFrame:
    """Lines "checksum filename" whose file is among the selected ones."""
    parts = F.split(F.trim("line"), r"\s+", 2)
    return manifest.filter((F.size(parts) == 2) & F.try_element_at(parts, F.lit(2)).isin(files))


def preconditions(counts: dict[str, tuple[DataFrame, int]], covered: dict[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """One row: for each name whether it holds, and `holds` for all together. counts: a table and how many rows it has to have; covered: rows whose distinct keys
    (nulls count as missing) the other table has to have. Each check is one row of its own, so they are joined as such."""
    checks = [df.agg((F.count("*") == n).alias(name)) for name, (df, n) in counts.items()]
    for name, (rows, others, keys) in covered.items():
        checks.append(rows.select(*keys).distinct().join(others.select(*keys), keys, "left_anti").agg((F.count("*") == 0).alias(name)))
    one = reduce(lambda a, b: a.crossJoin(b), checks)
    return one.withColumn("holds", reduce(lambda a, b: a & b, [F.col(n) for n in one.columns]))
