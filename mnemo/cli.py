"""Command line: recall, scenes, persona, distill, worker, migrate-artifacts over a folder of model tables, and two demos."""

from __future__ import annotations

import argparse
import importlib
import sys
from datetime import UTC, datetime
from pathlib import Path

from mnemo.operators.predicates import ExactScope, NamespaceWide, Scope, Target
from mnemo.plans.recall_plan import STRATEGIES, result_limit


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="mnemo", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *, tables: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        if tables:
            p.add_argument("--tables", required=True, help="folder with memories, scenes, personas ... as Parquet")
            p.add_argument("--space", required=name != "worker")
        return p

    r = add("recall")
    r.add_argument("query")
    which = r.add_mutually_exclusive_group(required=True)
    which.add_argument("--scope", type=Scope.parse)
    which.add_argument("--global-bucket", metavar="NS")
    which.add_argument("--namespace-wide", metavar="NS")
    r.add_argument("--strategy", choices=STRATEGIES, default="hybrid")
    r.add_argument("--limit", type=lambda s: result_limit(int(s)), default=8)
    r.add_argument("--show-scores", action="store_true")
    for name in ("scenes", "persona"):
        add(name).add_argument("--scope", type=Scope.parse, required=True)
    d = add("distill")
    d.add_argument("session")
    d.add_argument("--candidates", choices=("scan", "recall"), default="scan")
    d.add_argument("--limit", type=int, choices=range(1, 51), metavar="1-50", default=5)
    d.add_argument("--force", action="store_true")
    d.add_argument("--models", metavar="MODULE:NAME", help="a distill.Models to run the pass with; without one the evidence is shown")
    w = add("worker")
    w.add_argument("--backfill", action="store_true")
    w.add_argument("--timers-once", action="store_true")
    w.add_argument("--distill", metavar="MODULE:NAME", help="a distill.Models: runs the pass for every due session of the space")
    w.add_argument("--embed", metavar="MODULE:NAME", help="with --backfill: a function from texts to vectors, whose vectors are stored")
    w.add_argument("--embedding-model", default="unknown")
    m = add("migrate-artifacts", tables=False)
    m.add_argument("old", type=Path)
    m.add_argument("new", type=Path)
    m.add_argument("--apply", action="store_true")
    for name in ("demo", "demo-session"):
        add(name, tables=False).add_argument("--sf-dir", required=True)
    return top


def target_of(args: argparse.Namespace) -> Target:
    if args.namespace_wide:
        return NamespaceWide(Scope(args.namespace_wide).namespace)
    return ExactScope(args.scope if args.scope else Scope(args.global_bucket))


def show_hits(rows, scores: bool) -> list[str]:
    lines = []
    for r in rows:
        extra = f" score={r.score:.4f} fts={r.fts_rank or '-'} vec={r.vec_rank or '-'}" if scores else ""
        lines.append(f"{r.memory_id} [{r.memory_type}, {r.confidence}]{extra}\n  {r.content}")
    return lines


def named(path: str):
    """What a MODULE:NAME names; functions that travel to the tasks must be importable there."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def run_pass(spark, args: argparse.Namespace, models: str, now: datetime, ids: list[str] | None = None, candidates: int = 5, force: bool = False):
    from mnemo.operators import passes
    from mnemo.plans.access import Context

    if not args.space:
        raise SystemExit("a pass runs in one space: name it with --space")
    context = Context(args.space, "cli", frozenset({"distill", "record", "forget"}))
    return passes.distill_sessions(spark, args.tables, context, named(models), now, ids, candidates, force)


def show_pass(done) -> int:
    """1 if a session failed."""
    failed = 0
    for r in done.toLocalIterator():
        failed += r.error is not None
        print(f"{r.session_id}\t{r.error or f'extracted {r.extracted}, stored {r.stored}, merged {r.merged}, skipped {r.skipped}'}")
    return int(failed > 0)


def backfill(spark, args: argparse.Namespace) -> None:
    """Embeds what needs it and stores the vectors."""
    from pyspark.sql import functions as F

    from mnemo.operators import embedding, reads
    from mnemo.sources import shared, store

    memories = store.load(spark, args.tables, "memories")
    done = embedding.embed_batch(reads.embedding_backlog(memories, args.space), named(args.embed))
    path = shared.folder(spark, "embedded")
    done.write.parquet(path)  # the provider is called once
    done = spark.read.schema(done.schema).parquet(path)
    embedding.outcome_counts(done).show()
    stored = done.filter("outcome = 'stored'").select("memory_space_id", "memory_id")
    changed = embedding.store(memories.join(stored, ["memory_space_id", "memory_id"], "left_semi"), done, args.embedding_model)
    store.apply(spark, args.tables, "memories", changed, stored.limit(0).withColumn("namespace", F.lit("")))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "migrate-artifacts":
        from mnemo.sources import mirror

        moves = mirror.plan(args.old, args.new)
        for m in moves:
            print(f"{m.verdict}\t{m.source}\t{m.target}")
        return int(bool(mirror.apply(moves) if args.apply else sum(m.verdict == "collision" for m in moves)))
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("mnemo").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command in ("demo", "demo-session"):
        from mnemo.operators import reads
        from mnemo.operators import recall as r
        from mnemo.sources import tables

        if args.command == "demo":
            hits = r.recall(tables.memories(spark, args.sf_dir), "space_test", NamespaceWide("en"), "oning ering", datetime(2024, 3, 1, tzinfo=UTC), "keyword")
            print("\n".join(show_hits(hits.collect(), True)))
        else:
            reads.recent_sessions(tables.sessions(spark, args.sf_dir), "space_test", "chat", 10).show()
        return 0
    table = lambda name: spark.read.parquet(f"{args.tables}/{name}")
    now = datetime.now(UTC)
    if args.command == "recall":
        from mnemo.operators import recall as r

        print(f"target: {target_of(args)}", file=sys.stderr)
        print("\n".join(show_hits(r.recall(table("memories"), args.space, target_of(args), args.query, now, args.strategy, args.limit).collect(), args.show_scores)))
    elif args.command in ("scenes", "persona"):
        from mnemo.operators import reads

        read = reads.scenes_by_scope if args.command == "scenes" else reads.persona_by_scope
        for row in read(table("scenes" if args.command == "scenes" else "personas"), args.space, args.scope).toLocalIterator():
            print(row.body_md)
    elif args.command == "distill":
        from mnemo.operators import distill, reads

        if args.models:
            return show_pass(run_pass(spark, args, args.models, now, [args.session], args.limit, args.force))
        turns = reads.session_turns(table("turns"), args.space, args.session)
        distill.render_turns(turns).select("text").show(truncate=False)
    elif args.command == "worker":
        from pyspark.sql import functions as F

        from mnemo.operators import reads, timers

        if args.backfill and args.embed:
            backfill(spark, args)
        elif args.backfill:
            reads.embedding_backlog(table("memories"), args.space).groupBy("memory_space_id").count().show()
        if args.distill:
            return show_pass(run_pass(spark, args, args.distill, now))
        if args.timers_once:
            timers.due(table("timers"), F.lit(now).cast("timestamp")).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
