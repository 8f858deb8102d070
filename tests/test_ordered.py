"""Orders, sums, digests and state machines over groups that many tasks share, against plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mnemo.operators import ordered, verdicts


@pytest.fixture
def many(spark):
    """More partitions than elsewhere, so that groups are cut."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def table(spark):
    rng = random.Random(1)
    rows = [("hot", None, i, rng.randrange(20)) for i in range(3000)] + [(g, "x" if i % 2 else None, i, rng.randrange(20)) for g in "ab" for i in range(40)] + [(None, None, i, 1) for i in range(5)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, h string, k int, size int"), rows


def test_positions_and_sums(many):
    df, rows = table(many)
    got = {(r.g, r.h, r.k): (r.position, r.start) for r in ordered.numbered(df, ["g", "h"], ["k"], F.col("size")).collect()}
    want, at = {}, {}
    for g, h, k, size in sorted(rows, key=lambda r: r[2]):
        n, total = at.get((g, h), (0, 0))
        want[g, h, k] = n, total
        at[g, h] = n + 1, total + size
    assert got == want


def test_a_hot_group_is_many_tasks(many):
    df, _ = table(many)
    ranged = df.withColumn("_g", ordered.group_key(["g", "h"])).repartitionByRange(13, "_g", "k").withColumn("p", F.spark_partition_id())
    shares = ranged.filter("g = 'hot'").groupBy("p").count().collect()
    assert len(shares) > 5 and max(r["count"] for r in shares) < 1000


def test_digests_tell_rows_and_order_alone(many, monkeypatch):
    monkeypatch.setattr(ordered, "PIECE", 7)
    df, rows = table(many)
    df = df.filter("k < 300")

    def found(parts):
        many.conf.set("spark.sql.shuffle.partitions", str(parts))
        told = ordered.numbered(df.repartition(parts), ["g", "h"], ["k"], F.col("size"))
        return {(r.g, r.h): (r.n, r.hash) for r in ordered.digest(told, ["g", "h"], ordered.leaf(F.col("k"), F.col("size"))).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = {}
    for key in {r[:2] for r in rows}:
        level = [sha("".join(f"{len(str(x))}:{x}" for x in r[2:])) for r in sorted(r for r in rows if r[:2] == key and r[2] < 300)]
        n = len(level)
        for _ in range(ordered.LEVELS):
            level = [sha("".join(level[i : i + 7])) for i in range(0, len(level), 7)]
        want[key] = n, "v2:" + sha(f"{n}:{level[0]}")
    assert found(1) == found(5) == found(13) == want


def test_leaves_keep_fields_apart(spark):
    two = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c"), ("-", "c")], "x string, y string")
    assert two.select(ordered.leaf(F.col("x"), F.col("y"))).distinct().count() == 4


def test_budget_is_a_prefix(many):
    df, _ = table(many)
    told = ordered.numbered(df, ["g", "h"], ["k"], F.col("size") + 1)
    kept = ordered.within(told, F.col("size"), 100)
    assert kept.filter("start + size > 100").count() == 0
    assert kept.groupBy("g", "h").agg((F.max("position") + 1 == F.count("*")).alias("whole")).filter("NOT whole").count() == 0


COMMANDS = "session_id string, seq int, command string, turn_index int, key string, force boolean"


def loop(rows):
    out, held = [], {}
    for s, seq, command, turn, key, force in sorted(rows, key=lambda r: (r[0], r[1])):
        state, own, last = held.get(s, ("none", None, -1))
        new = verdicts.SESSION_MOVES.get((state, command))
        if command == "turn" and not (turn is not None and turn > last) or command == "resume" and not (force or key == own):
            new = None
        if new:
            state, last = new, turn if command == "turn" else last
            own = key if command == "await" else None if command == "resume" else own
        held[s] = state, own, last
        out.append((s, seq, command, bool(new), state))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_machine_in_pieces_is_the_loop(many, seed):
    rng = random.Random(seed)
    weights = {"start": 3, "interactive": seed == 3, "turn": 30, "await": 12, "resume": 30, "complete": 0.2, "fail": 0.1}
    rows = [(s, i, c, rng.choice((None, i // 2, rng.randrange(n + 1))), rng.choice((None, "a", "b", "c", f"k{i % 9}")), rng.choice((None, False, False, i % 17 == 0))) for s, n in (("hot", 3000), ("b", 40), ("c", 1)) for i, c in enumerate(rng.choices(list(weights), list(weights.values()), k=n))]
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in verdicts.replay_sessions(many.createDataFrame(rows, COMMANDS)).collect())
    assert got == sorted(loop(rows))


def test_machine_joins_no_states(many):
    rows = [(x, i, c, i, None, True) for x in ("a", "b", None) for i, c in enumerate(("start", "turn", "await", "turn", "resume", "complete"))]
    replayed = verdicts.replay_sessions(many.createDataFrame(rows, COMMANDS))
    # states are as many as the sessions, and a broadcast of them fills the driver
    assert "Join" not in replayed._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in replayed.collect()) == sorted(loop([r for r in rows if r[0]]))


def test_summaries_compose():
    rng = random.Random(9)
    states = [("none", None, -1), ("running", None, 3), ("awaiting", "a", 5), ("awaiting", None, -1), ("awaiting", "z", 2), ("completed", None, 1), ("interactive", None, -1)]
    for _ in range(3000):
        commands = [(rng.choice(("start", "turn", "await", "resume", "resume", "complete", "fail", "interactive")), rng.choice((None, 1, 4, 9)), rng.choice((None, "a", "b")), rng.random() < 0.2) for _ in range(rng.randrange(7))]
        for state in states:
            name, key, last = state
            for command, turn, own, force in commands:
                new = verdicts.SESSION_MOVES.get((name, command))
                if command == "turn" and not (turn is not None and turn > last) or command == "resume" and not (force or own == key):
                    new = None
                if new:
                    name, last = new, turn if command == "turn" else last
                    key = own if command == "await" else None if command == "resume" else key
            got = verdicts.led(state, verdicts.summarised(commands))
            assert (got[0], got[2]) == (name, last) and (name != "awaiting" or got[1] == key), (state, commands)


def batch(spark, commands, sessions=(("a", "s", "running"),)):
    rows = [("a", s, i, action, force, expected, m.get("model"), m.get("said"), m.get("said"), m.get("said"), m.get("key"), None, m.get("said")) for i, (s, action, force, expected, m) in enumerate(commands)]
    names = "memory_space_id string, session_id string, seq int, action string, force boolean, expected_version int, model_used string, summary string, error_message string, awaiting_reason string, awaiting_correlation_key string, awaiting_deadline timestamp, resume_input string"
    none = {f: F.lit(None).cast("string") for f in verdicts.SESSION_STATE if f not in ("status", "awaiting_deadline")} | {"awaiting_deadline": F.lit(None).cast("timestamp")}
    there = spark.createDataFrame(list(sessions), "memory_space_id string, session_id string, status string").withColumns(none)
    return [r.verdict for r in verdicts.apply_session_commands(spark.createDataFrame(rows, names), there).orderBy("seq").collect()]


def test_commands_of_a_batch_see_one_another(spark):
    wait = {"said": "tool", "key": "k"}
    assert batch(spark, [("s", "await", False, None, wait), ("s", "await", False, None, wait), ("s", "await", False, None, wait | {"key": "other"})]) == ["run", "duplicate", "conflict"]
    assert batch(spark, [("s", "await", False, None, wait), ("s", "resume", False, None, {"key": "x"}), ("s", "resume", False, None, {"key": "k", "said": "go"}), ("s", "resume", False, None, {"key": "k", "said": "go"}), ("s", "complete", False, None, {"said": "done"}), ("s", "complete", False, None, {"said": "done"}), ("s", "fail", False, None, {})]) == ["run", "wrong key", "run", "duplicate", "run", "duplicate", "conflict"]
    assert batch(spark, [("gone", "fail", False, None, {}), ("s", "resume", True, None, {"said": "go"})]) == ["not found", "conflict"]


def test_a_lost_race_is_read_again(spark):
    wait = {"said": "tool", "key": "k"}
    # the same wait by a writer that is behind counts as done; another one is rejected; what the session still takes runs
    assert batch(spark, [("s", "await", False, 0, wait), ("s", "await", False, 0, wait), ("s", "await", False, 0, wait | {"said": "more"}), ("s", "complete", False, 0, {"said": "end"}), ("s", "fail", False, 1, {})]) == ["run", "duplicate", "rejected", "run", "rejected"]
    assert batch(spark, [("s", "await", False, 0, wait), ("s", "await", False, 1, wait | {"said": "more"})]) == ["run", "conflict"]
