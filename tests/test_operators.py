import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemo import schema
from mnemo.operators.components import components
from mnemo.operators import distill, embedding, folds, lineage, maintenance, recall, timers, verdicts
from mnemo.operators.predicates import ExactScope, NamespaceWide, Scope, candidates, legacy_target
from mnemo.plans import access, recall_plan
from mnemo.sources import events, mirror

T0 = datetime(2024, 1, 1)
MEMORY = "memory_space_id string, memory_id string, agent_id string, session_id string, namespace string, scope_kind string, scope_ref string, memory_type string, content string, priority int, confidence string, tags array<string>, status string, superseded_by string, supersedes string, embedding array<float>, content_hash string, created_at timestamp, updated_at timestamp"


def memory(mid, space="a", ns="n", kind=None, ref=None, content="same words here", status="active", vec=None, priority=100, confidence="medium", by=None, old=None, at=T0, mtype="fact", session=None):
    return (space, mid, "agent", session, ns, kind, ref, mtype, content, priority, confidence, [], status, by, old, vec, None, at, at)


def memories(spark, *rows):
    return spark.createDataFrame(list(rows), MEMORY)


def test_targets_are_three_predicates(spark):
    m = memories(spark, *[memory(f"{sp}{k}", sp, "n", kind, ref) for sp in "ab" for k, (kind, ref) in enumerate([(None, None), ("repo", "web"), ("repo", "api"), ("repo", None)])], memory("x", "a", "other"), memory("old", "a", status="archived"))
    ids = lambda t, sp="a": {r.memory_id for r in candidates(m, sp, t).collect()}
    assert ids(ExactScope(Scope("n"))) == {"a0"}
    assert ids(ExactScope(Scope("n", "repo", "web"))) == {"a1"}
    assert ids(NamespaceWide("n")) == {"a0", "a1", "a2", "a3"} and ids(NamespaceWide("n"), "b") == {"b0", "b1", "b2", "b3"}
    assert legacy_target(Scope("n")) == NamespaceWide("n") and legacy_target(Scope("n", "k", "r")) == ExactScope(Scope("n", "k", "r"))


@pytest.mark.parametrize("bad", ["", "a:b", "a::c", ":k:r", "a%:k:r"])
def test_scope_grammar(bad):
    with pytest.raises(ValueError):
        Scope.parse(bad)


def test_scope_ref_is_free_text():
    assert Scope.parse("a:b:c:d/e%") == Scope("a", "b", "c:d/e%")


def test_fusion_prefers_what_both_channels_have(spark):
    m = memories(spark, *[memory(i) for i in "abc"])
    fts = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 0.5)], "memory_id string, fts_rank int, fts_score double")
    vec = spark.createDataFrame([("b", 1, 0.1), ("c", 2, 0.2)], "memory_id string, vec_rank int, distance double")
    got = recall.fuse(fts, vec, m, "a", T0).collect()
    assert [r.memory_id for r in got] == ["b", "a", "c"]


def test_budget_stops_at_the_first_that_overflows(spark):
    hits = spark.createDataFrame([("a", "x" * 10, 3.0), ("b", "y" * 10, 2.0), ("c", "z", 1.0)], "memory_id string, content string, score double")
    assert [(r.memory_id, r.content) for r in recall.apply_budgets(hits, 5, 8).collect()] == [("a", "xx...")]
    assert recall.apply_budgets(hits, 5, 0).count() == 0
    assert [r.memory_id for r in recall.apply_budgets(hits, 10, 20).collect()] == ["a", "b"]


def test_recall_is_exact_under_decoys(spark):
    import math

    near = [memory(f"d{i}", "a", "n", "repo", "decoy", vec=[math.cos(0.01 * i), math.sin(0.01 * i)]) for i in range(60)]
    mine = [memory(f"t{i:02}", "a", "n", "repo", "mine", vec=[math.cos(1 + 0.01 * i), math.sin(1 + 0.01 * i)]) for i in range(60)]
    got = recall.vec_candidates(memories(spark, *near, *mine), "a", ExactScope(Scope("n", "repo", "mine")), [1.0, 0.0]).collect()
    assert [r.memory_id for r in sorted(got, key=lambda r: r.vec_rank)] == [f"t{i:02}" for i in range(50)]


def test_diagnosed_falls_back_when_starved(spark):
    m = memories(spark, *[memory(f"m{i}", vec=[1.0, i / 10]) for i in range(5)])
    out, rows = recall.vec_candidates_diagnosed(m, "a", NamespaceWide("n"), [1.0, 0.0], m.filter("memory_id = 'm3'"), 4)
    assert (out.approximate_rows, out.exact_fallback, out.rows, out.starved) == (1, True, 4, True) and rows.count() == 4


def test_recall_fails_open(spark):
    m = memories(spark, memory("a", content="red fox", vec=[1.0]), memory("b", content="blue fox", vec=[0.5]))

    def broken(_):
        raise OSError("provider")

    got = recall.recall(m, "a", NamespaceWide("n"), "red", T0, embed=broken).collect()
    assert [r.memory_id for r in got] == ["a"]
    assert recall.recall(m.drop("embedding"), "a", NamespaceWide("n"), "red", T0, embed=lambda q: [1.0]).count() == 1
    assert recall.recall(m, "a", NamespaceWide("n"), "", T0, embed=lambda q: [1.0]).count() == 2
    assert recall.legacy_recall(m, "a", "a", Scope("n"), "red", T0, 0).count() == 0
    with pytest.raises(PermissionError):
        recall.legacy_recall(m, "a", "b", Scope("n"), "red", T0, 0)


def test_plans():
    P = recall_plan.RecallPlan
    assert recall_plan.plan_recall("available", "hybrid") == P(True, True, True)
    assert recall_plan.plan_recall("available", "embedding") == P(False, True, True)
    assert recall_plan.plan_recall("missing column", "embedding") == P(True, False, False)
    assert recall_plan.plan_recall("available", "keyword") == P(True, False, False)
    for bad in (0, 101):
        with pytest.raises(ValueError):
            recall_plan.result_limit(bad)
    t = ExactScope(Scope("n", "k", "r"))
    assert recall_plan.decode_target(recall_plan.encode_target(t)) == t
    for bad in ({"kind": "x"}, {"kind": "namespace_wide", "namespace": "n", "more": 1}, {"kind": "exact_scope", "scope": {"namespace": "n", "kind": "k"}}):
        with pytest.raises(ValueError):
            recall_plan.decode_target(bad)


def test_access_order():
    c = access.Context("s", "bob", frozenset({"read"}))
    for permission, space, actor, word in (("record", "x", "y", "record"), ("read", "x", "y", "space"), ("read", "s", "y", "actor")):
        with pytest.raises(access.Refused, match=word):
            access.gate(c, permission, space, actor)
    assert access.gate(c, "read", "s", "bob") is c
    yes = lambda *_: True
    assert access.authorize("s", "bob", ["read"], yes, yes, lambda *_: "granted").permissions == {"read"}
    for coarse, exists, check in ((lambda p: False, yes, lambda *_: "granted"), (yes, lambda a: False, lambda *_: "granted"), (yes, yes, lambda *_: "conditional")):
        with pytest.raises(access.Refused):
            access.authorize("s", "bob", ["read"], coarse, exists, check)


def test_lineage_cycles_end(spark):
    s = spark.createDataFrame([("a", "x", "y", T0), ("a", "y", "x", T0 + timedelta(seconds=1)), ("b", "z", "x", T0)], "memory_space_id string, session_id string, previous_session_id string, started_at timestamp")
    assert [r.session_id for r in lineage.session_chain(s, "a", "x").collect()] == ["x", "y"]
    deep = spark.range(150).select(F.lit("a").alias("memory_space_id"), F.format_string("s%03d", "id").alias("session_id"), F.when(F.col("id") > 0, F.format_string("s%03d", F.col("id") - 1)).alias("previous_session_id"), F.timestamp_seconds("id").alias("started_at"))
    assert lineage.session_chain(deep, "a", "s149").count() == 150
    m = memories(spark, memory("1", by="2", status="superseded"), memory("2", old="1", by="3"), memory("3", old="2", by="1"), memory("4", "b", old="1"), memory("5"))
    assert [r.memory_id for r in lineage.supersession_chain(m, "a", "2").collect()] == ["1", "2", "3"]
    assert [r.memory_id for r in lineage.supersession_chain(m, "a", "5").collect()] == ["5"]


def test_memory_fold(spark):
    rows = [("a", "m", 1, "recorded", None, "t1", "low"), ("a", "m", 2, "tags", None, "t2", None), ("b", "m", 3, "tags", None, "t3", None), ("a", "m", 4, "superseded", "n", None, None), ("a", "m", 5, "archived", None, None, None)]
    log = spark.createDataFrame([(*r, T0 + timedelta(hours=r[2])) for r in rows], "memory_space_id string, stream_id string, version int, kind string, by string, tags string, confidence string, at timestamp")
    r = folds.fold_memories(log).first()
    assert (r.status, r.superseded_by, r.tags, r.confidence, r.created_at, r.updated_at) == ("archived", "n", "t2", "low", T0 + timedelta(hours=1), T0 + timedelta(hours=5))
    assert folds.fold_memories(log.filter("version > 1")).count() == 0  # never recorded


def test_session_fold_clears_what_it_should(spark):
    def state(*kinds):
        rows = [("a", "s", i, k, T0 + timedelta(hours=i), f"x{i}", f"k{i}") for i, k in enumerate(kinds)]
        return folds.fold_sessions(spark.createDataFrame(rows, "memory_space_id string, stream_id string, version int, kind string, at timestamp, text string, key string")).first()

    r = state("started", "awaiting")
    assert (r.status, r.awaiting_reason, r.awaiting_correlation_key, r.resume_input) == ("awaiting", "x1", "k1", None)
    r = state("started", "awaiting", "resumed", "turn")
    assert (r.status, r.awaiting_reason, r.resume_input) == ("running", None, "x2")
    r = state("started", "awaiting", "failed")
    assert (r.status, r.awaiting_reason, r.completed_at, r.error_message) == ("failed", None, T0 + timedelta(hours=2), "x2")


def test_upserts(spark):
    now = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "k string, v int, born string")
    new = spark.createDataFrame([("b", 5, "new"), ("c", 6, "new")], "k string, v int, born string")
    assert sorted(tuple(r) for r in folds.upsert(now, new, ["k"], ("born",)).collect()) == [("a", 1, "old"), ("b", 5, "old"), ("c", 6, "new")]
    assert [tuple(r) for r in folds.append_new(now, new, ["k"]).collect()] == [("c", 6, "new")]


def test_event_payloads(spark):
    import json

    def data(kind, **payload):
        return json.dumps({"type": kind, "data": payload})

    at = "2024-01-01T00:00:00Z"
    rows = [
        data("memory_recorded", memoryId="m1", agentId="bob", scope={"tag": "ScopeEntity", "contents": ["n", "repo", "web"]}, memoryType="fact", content="c", priority=7, confidence="high", tags=["b", "a", "a"], recordedAt=at),
        data("memory_merged", memoryId="m1", memorySpaceId="s", mergedInto="m2", mergedAt=at),
        data("session_resumed", sessionId="s1", input="go", resumedAt=at),
        data("agent_memory_recorded", memoryId="m3", agentId="bob", anchor={"type": "habit", "id": "h"}, memoryType="fact", content="c", confidence="low", tags=[], recordedAt=at),
        data("agent_session_started", sessionId="s2", agentId="bob", focusType="FocusToday", intentionId="i", startedAt=at),
        data("agent_memory_recorded", memoryId="m3", agentId="bob", anchor={"type": "moon"}, memoryType="fact", content="c", confidence="low", tags=[], recordedAt=at),
        data("unheard_of", memoryId="m"), "{not json", data("memory_archived", memoryId="m"),
    ]
    log = spark.createDataFrame([("s", i, r) for i, r in enumerate(rows)], "stream_id string, version int, data string")
    good, bad = events.split(events.decode(log))
    g = {r.version: r for r in good.collect()}
    assert set(g) == {0, 1, 2, 3, 4}
    assert (g[0].memory_space_id, g[0].namespace, g[0].scope_kind, g[0].scope_ref, g[0].tags, g[0].priority, g[0].actor) == ("mnemo_legacy", "n", "repo", "web", ["a", "b"], 7, "mnemo:legacy:bob")
    assert (g[1].memory_space_id, g[1].by, g[1].actor) == ("s", "m2", "mnemo:unattributed") and g[2].force is True
    assert (g[3].kind, g[3].priority, g[3].scope_kind, g[3].scope_ref) == ("memory_recorded", 100, "habit", "h")
    assert (g[4].focus, g[4].scope_kind, g[4].scope_ref) == ("today", "intention", "i")
    assert {r.version: r.malformed for r in bad.collect()} == {5: "unknown anchor", 6: "unknown type", 7: "no type", 8: "no time"}


def test_timers(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    log = spark.createDataFrame([("s", "started", None, at(0)), ("s", "turn", 1, at(20)), ("s", "turn", 3, at(60)), ("s", "completed", None, at(61))], "session_id string, kind string, turn_index int, at timestamp")
    got = {r.reason: r.fire_at for r in timers.session_timers(log).collect()}
    assert got == {"idle": at(50), "ramp": at(20), "final": at(61)}
    fired = spark.createDataFrame([("1", "retry", 7, "a", "e"), ("2", "retry", 8, None, "e"), ("3", "foreign", 8, "a", "e"), ("4", "dead", 0, "a", "e"), ("5", "completed", 0, "a", None)], "timer_id string, outcome string, attempts int, memory_space_id string, error string").withColumn("fire_at", F.lit(T0))
    r = {x.timer_id: (x.new_status, x.new_attempts, x.new_fire_at, x.last_error) for x in timers.apply_outcomes(fired, F.lit(T0)).collect()}
    assert r["1"] == ("scheduled", 8, T0 + timedelta(seconds=900), "e") and r["2"] == ("dead", 9, T0, "[memory space unknown] e")
    assert r["3"] == ("dead", 9, T0, "[memory space a] e") and r["4"][3] == "[memory space a] e" and r["5"][0] == "fired"


def test_claims_of_other_work_count(spark):
    fired = spark.createDataFrame([("1", "foreign", 7, "a", "e"), ("2", "completed", 8, "a", "e")], "timer_id string, outcome string, attempts int, memory_space_id string, error string").withColumn("fire_at", F.lit(T0))
    r = {x.timer_id: (x.new_status, x.new_attempts, x.new_fire_at) for x in timers.apply_outcomes(fired, F.lit(T0)).collect()}
    assert r == {"1": ("scheduled", 8, T0 + timedelta(seconds=600)), "2": ("dead", 9, T0)}


def test_drain_that_cannot_end_is_an_error(spark):
    stuck = spark.createDataFrame([("1", "scheduled", 0, "a")], "timer_id string, status string, attempts int, memory_space_id string").withColumn("fire_at", F.lit(T0))
    with pytest.raises(RuntimeError):
        timers.drain(lambda: stuck, lambda b: b.withColumns({"outcome": F.lit("retry"), "error": F.lit("e")}), lambda d: None, F.lit(T0), most_rounds=2)


CHAIN = "memory_space_id string, memory_id string, status string, supersedes string, superseded_by string, created_at timestamp"


def test_a_chain_of_ten_thousand_takes_few_rounds(spark):
    rng = random.Random(1)
    ids = [f"m{i:05d}" for i in range(10_000)]
    rng.shuffle(ids)
    rows = [("s", ids[i], "active", ids[i - 1] if i else None, None, T0) for i in range(len(ids))] + [("s", "lone", "active", None, None, T0), ("t", ids[0], "active", None, ids[1], T0), ("t", ids[1], "active", ids[0], "gone", T0)]
    m = spark.createDataFrame(rows, CHAIN)
    edges = lineage.supersession_edges(m).filter("memory_space_id = 's'")
    found, rounds = components(edges)
    assert rounds < 20 and found.count() == 10_000 and [r[0] for r in found.select("component").distinct().collect()] == ["m00000"]
    assert lineage.supersession_chain(m, "s", ids[500]).count() == 10_000
    assert [r.memory_id for r in lineage.supersession_chain(m, "s", "lone").collect()] == ["lone"]
    # a link to a memory that is not there, or of another space, is none
    assert sorted(r.memory_id for r in lineage.supersession_chain(m, "t", ids[1]).collect()) == sorted(ids[:2])
    assert lineage.supersession_chain(m, "t", "lone").count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int"))[0].collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_admin_stands_for_no_other_permission():
    c = access.Context("s", "bob", frozenset({"admin"}))
    with pytest.raises(access.Refused):
        access.gate(c, "record", "s")
    assert access.gate(c, "admin", "s") is c
    assert access.preflight("s:ns", {"s": c}.get, "s") == ("dead", "distill is not granted")


def test_an_update_without_targets_is_stored():
    m = distill.Models(lambda t: [{"content": "x", "atom_type": "fact"}], lambda a, c: {"action": "update", "targets": []})
    p = distill.distill_session([{"turn_index": 1, "role": "user", "content": "a"}], [], None, {"session_id": "s"}, m)
    assert [a["decision"] for a in p.audit] == ["store"] and len(p.stored) == 1
    old = {"memory_id": "m", "memory_type": "fact", "content": "y", "status": "active", "priority": 1}
    m = distill.Models(lambda t: [{"content": "x", "atom_type": "fact"}], lambda a, c: {"action": "update", "targets": ["m"]})
    p = distill.distill_session([{"turn_index": 1, "role": "user", "content": "a"}], [old], None, {"session_id": "s"}, m)
    assert [a["decision"] for a in p.audit] == ["update"] and p.merged


def test_a_retired_winner_is_skipped_before_its_targets_are_looked_at(spark):
    m = spark.createDataFrame([("a", "own", "archived"), ("a", "t", "active")], "memory_space_id string, memory_id string, status string")
    d = spark.createDataFrame([("1", "a", "own", "merge", []), ("2", "a", "own", "update", ["t"]), ("3", "a", "new", "merge", []), ("4", "a", "own", "store", ["t"]), ("5", "a", "new", "merge", ["new"]), ("6", "a", "new", "skip", ["t"]), ("7", "a", "new", "merge", ["t", "gone"])], "decision_id string, memory_space_id string, own_id string, action string, targets array<string>")
    got = {r.decision_id: (r.applied, r.live_targets, r.note) for r in distill.apply_decisions(d, m).collect()}
    assert got == {
        "1": ("skip", [], "winner is not active"), "2": ("skip", [], "winner is not active"), "3": ("store", [], "no target given"), "4": ("store", [], None),
        "5": ("skip", [], "only target is itself"), "6": ("skip", [], None), "7": ("merge", ["t"], "some targets don't exist"),
    }
    told = distill.canonical_decision(d.select("decision_id", "action", "targets")).orderBy("decision_id").collect()
    assert [(r.targets, r.problem is not None) for r in told][:4] == [([], True), (["t"], True), ([], True), ([], False)]


def test_the_pass_does_so_too():
    turns, session = [{"turn_index": 1, "role": "user", "content": "a"}], {"session_id": "s"}
    once = distill.distill_session(turns, [], None, session, distill.Models(lambda t: [{"content": "x"}], lambda a, c: {"action": "store", "targets": ["stray"]}))
    assert once.audit[0]["targets"] == []
    retired = once.stored[0] | {"status": "archived"}
    again = distill.distill_session(turns, [retired], None, session, distill.Models(lambda t: [{"content": "x"}], lambda a, c: {"action": "merge", "targets": []}))
    assert [a["decision"] for a in again.audit] == ["skip"] and not again.stored


def test_distill_session():
    m = distill.Models(lambda t: [{"content": " likes brevity ", "atom_type": "preference", "priority": 150, "confidence": "High"}, {"content": "second", "atom_type": "fact", "confidence": "low"}], lambda a, c: {"action": "merge" if c else "store", "targets": [c[0]["memory_id"]] if c else [], "rationale": "r"})
    turns = [{"turn_index": 2, "role": "user", "content": "b"}, {"turn_index": 1, "role": "user", "content": "a"}]
    p = distill.distill_session(turns, [], None, {"session_id": "s"}, m)
    assert [a["decision"] for a in p.audit] == ["store", "merge"] and p.last_turn == 2 and p.stored[0]["priority"] == 100
    assert p.merged == [{"memory_id": p.stored[0]["memory_id"], "merged_into": p.stored[1]["memory_id"]}]
    assert not distill.distill_session(turns, [], 2, {"session_id": "s"}, m).ran and distill.distill_session(turns, [], 2, {"session_id": "s"}, m, force=True).ran
    assert not distill.distill_session([], [], 0, {"session_id": "s"}, m).ran  # a session without turns is covered for good
    bad = distill.Models(lambda t: [{"content": "ok"}, {"content": "x", "atom_type": "dream"}], m.consolidate)
    with pytest.raises(ValueError):
        distill.distill_session(turns, [], None, {"session_id": "s"}, bad)


def test_scenes_follow_their_sources(spark):
    m = memories(spark, memory("1", priority=5), memory("2", kind="repo", ref="web", priority=1), memory("3", kind="repo", ref="web", status="merged"))
    src = distill.scene_sources(m)
    stored = src.select(*distill.SCOPE, F.col("hash").alias("source_hash"))
    assert {r.action for r in distill.scene_actions(m, stored).collect()} == {"keep"}
    changed = m.withColumn("confidence", F.when(F.col("memory_id") == "1", "high").otherwise(F.col("confidence")))
    assert {(r.scope_ref, r.action) for r in distill.scene_actions(changed, stored).collect()} == {(None, "regenerate"), ("web", "keep")}
    assert {r.action for r in distill.scene_actions(m.filter("false"), stored).collect()} == {"delete"}
    assert distill.scene_actions(m.withColumn("tags", F.array(F.lit("t"))), stored).filter("action <> 'keep'").count() == 0
    assert distill.regenerate(distill.scene_actions(changed, stored), lambda t: t.upper()).first().body_md.startswith("- 1 (FACT, HIGH)")


def test_evidence_falls_through(spark):
    ses = spark.createDataFrame([("a", s, "n", None, None) for s in "xyz"], "memory_space_id string, session_id string, namespace string, scope_kind string, scope_ref string")
    turns = spark.createDataFrame([("a", "x", 1, "user", "hi", None), ("a", "x", 2, "bot", "yo", "grep")], "memory_space_id string, session_id string, turn_index int, role string, content string, tool_summary string")
    m = memories(spark, memory("1", session="y", status="archived", content="mine"), memory("2", content="all"))
    got = {r.session_id: (r.source, r.text) for r in distill.evidence(turns, m, ses).collect()}
    assert got == {"x": ("turns", "1. user: hi\n2. bot: yo\n   tools: grep"), "y": ("session memories", "- fact: mine"), "z": ("scope memories", "- fact: all")}


def test_embedding_batches(spark):
    m = memories(spark, memory("1", content="ok"), memory("2", content="bad"))

    def embed(texts):
        if "bad" in texts:
            raise OSError
        return [[1.0, 2.0]] * len(texts)

    done = embedding.embed_batch(m.select("memory_space_id", "memory_id", "content", "created_at"), embed, 1)
    assert {r.memory_id: r.outcome for r in done.collect()} == {"1": "stored", "2": "retry"}
    rows = {r.memory_id: (r.embedding, r.dimensions) for r in embedding.store(m, done, "model").collect()}
    assert rows == {"1": ([1.0, 2.0], 2), "2": (None, None)}


def test_verdicts(spark):
    c = spark.createDataFrame([("a", "s", 1, "t1", "hi"), ("a", "s", 2, "t1", "hi"), ("a", "s", 1, "t1", "ho"), ("a", "s", 3, "t3", "x")], "memory_space_id string, session_id string, turn_index int, turn_id string, content string").withColumns({"role": F.lit("user"), **{x: F.lit(None).cast("string") for x in ("tool_summary", "prompt_tokens", "output_tokens")}})
    got = verdicts.turn_verdicts(c, c.filter("turn_index = 1 AND content = 'hi'")).collect()
    assert sorted((r.turn_index, r.content, r.verdict) for r in got) == [(1, "hi", "duplicate"), (1, "ho", "conflict"), (2, "hi", "conflict"), (3, "x", "run")]


def test_session_machine(spark):
    rows = [("start", None, None), ("turn", 1, None), ("turn", 1, None), ("await", None, "k"), ("turn", 2, None), ("resume", None, "other"), ("resume", None, "k"), ("complete", None, None), ("turn", 3, None)]
    c = spark.createDataFrame([("s", i, *r, False) for i, r in enumerate(rows)], "session_id string, seq int, command string, turn_index int, key string, force boolean")
    got = [(r.accepted, r.state) for r in verdicts.replay_sessions(c).orderBy("seq").collect()]
    assert got == [(True, "running"), (True, "running"), (False, "running"), (True, "awaiting"), (False, "awaiting"), (False, "awaiting"), (True, "running"), (True, "completed"), (False, "completed")]


def test_maintenance_refuses_drift(spark):
    ses = spark.createDataFrame([("a", "s")], "memory_space_id string, session_id string")
    turns = spark.createDataFrame([(None, "s"), ("b", "s"), (None, "gone")], "memory_space_id string, session_id string")
    done = maintenance.backfilled({"turns": turns.filter("memory_space_id IS NULL")}, ses)
    assert sorted(r.memory_space_id for r in done["turns"].collect()) == ["a", "mnemo_legacy"]
    with pytest.raises(ValueError):
        maintenance.backfilled({"turns": turns}, ses)


def test_schemas(spark):
    assert len({schema.fingerprint(s) for s in schema.TABLES.values()}) == 7
    with pytest.raises(ValueError):
        schema.assert_schema(spark.range(1), schema.TURNS)


def test_mirrors(tmp_path):
    old, new = tmp_path / "old", tmp_path / "new"
    for name, text in (("a.md", "1"), ("b.md", "2"), ("c.md", "3")):
        mirror.write(old / name, text)
    mirror.write(new / "b.md", "2")
    mirror.write(new / "c.md", "other")
    moves = mirror.plan(old, new)
    assert [m.verdict for m in moves] == ["ready", "migrated", "collision"]
    assert mirror.apply(moves) == 1 and (new / "a.md").read_text() == "1" and (new / "c.md").read_text() == "other"
    assert mirror.directory("r", "sp", "scenes").name == "scenes"


def test_cli_arguments(capsys, tmp_path):
    from mnemo import cli

    p = cli.parser()
    a = p.parse_args(["recall", "--tables", "t", "--space", "s", "--namespace-wide", "n", "what"])
    assert cli.target_of(a) == NamespaceWide("n") and a.limit == 8
    for bad in (["recall", "--tables", "t", "--space", "s", "q"], ["recall", "--tables", "t", "--space", "s", "--scope", "n", "--global-bucket", "n", "q"], ["distill", "--tables", "t", "--space", "s", "x", "--limit", "51"]):
        with pytest.raises(SystemExit):
            p.parse_args(bad)
    mirror.write(tmp_path / "o" / "a.md", "1")
    assert cli.main(["migrate-artifacts", str(tmp_path / "o"), str(tmp_path / "n"), "--apply"]) == 0


def test_capability_order(spark):
    m = memories(spark, memory("1"))
    assert recall_plan.capability(m) == "available"
    assert recall_plan.capability(m.drop("content_hash")) == "missing columns: content_hash"
    assert recall_plan.capability(m.drop("content_hash").withColumn("embedding", F.lit("x"))) == "no vector type"
    wide = m.withMetadata("embedding", {"dimensions": 3})
    assert recall_plan.capability(wide, 4) == "width 3, not 4" and recall_plan.capability(wide, 3) == "available"


def test_drain_ends_when_nothing_is_due(spark):
    state = [spark.createDataFrame([("1", "a", 0), ("2", "a", 7), ("3", None, 8)], "timer_id string, memory_space_id string, attempts int").withColumns({"fire_at": F.lit(T0), "status": F.lit("scheduled")})]

    def fire(batch):
        return batch.withColumns({"outcome": F.when(F.col("timer_id") == "1", "completed").otherwise("retry"), "error": F.lit("e")})

    def write(done):
        rows = done.select("timer_id", "memory_space_id", F.col("new_attempts").alias("attempts"), F.col("new_fire_at").alias("fire_at"), F.col("new_status").alias("status"))
        state[0] = spark.createDataFrame(rows.collect(), rows.schema)

    assert timers.drain(lambda: state[0], fire, write, F.lit(T0)) == 1
    assert {r.timer_id: r.status for r in state[0].collect()} == {"1": "fired", "2": "scheduled", "3": "dead"}


def test_preflight():
    c = access.Context("s", "w", frozenset({"distill"}))
    give = {"s": c, "t": access.Context("t", "w", frozenset({"read"}))}.get
    assert access.preflight("s:n/k/r", give, "s") == ("run", None)
    assert [access.preflight(x, give, r)[0] for x, r in (("s", None), ("x:n", None), ("s:n", "t"), ("t:n", "t"))] == ["dead"] * 4


def test_merge_candidates(spark):
    m = memories(spark, memory("1", priority=2, content="red fox"), memory("2", priority=1, content="blue"), memory("3", kind="k", ref="r", content="red"))
    assert [r.memory_id for r in distill.scan_candidates(m, "a", Scope("n"), 1).collect()] == ["2"] and distill.scan_candidates(m, "a", Scope("n"), -1).count() == 0
    assert [r.memory_id for r in distill.recall_candidates(m, "a", Scope("n"), "red", 5, T0).collect()] == ["1"]
    assert distill.recall_candidates(m, "a", Scope("n"), "red", 0, T0).count() == 0


def test_manifest(spark):
    lines = spark.createDataFrame([("abc 1.sql",), ("def  2.sql",), ("odd",), ("",)], "line string")
    assert [r.line for r in maintenance.manifest_lines(lines, ["2.sql", "odd"]).collect()] == ["def  2.sql"]


def test_explained_is_the_plan_that_runs(spark):
    m = memories(spark, memory("1", content="red fox", vec=[1.0]))
    text = recall.explained(recall.recall(m, "a", NamespaceWide("n"), "red", T0, "keyword"))
    assert "memory_space_id" in text and "TakeOrderedAndProject" in text
