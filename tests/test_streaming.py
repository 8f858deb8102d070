from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mnemo.operators import embedding, folds, timers
from mnemo.schema import EVENTS
from mnemo.sources import events
from mnemo.streaming import projections, queue

T0 = datetime(2024, 1, 1)
LOG = "memory_space_id string, stream_id string, version int, kind string, by string, tags string, confidence string, at timestamp"


def test_streamed_fold_equals_the_batch_fold(spark, tmp_path):
    rows = []
    for s in range(6):
        kinds = ["recorded", "tags", "confidence", "superseded", "archived"][: s + 1]
        rows += [("a" if i < 2 or s != 3 else "b", f"m{s}", i + 1, k, "n", f"t{i}", f"c{i}", T0 + timedelta(hours=i)) for i, k in enumerate(kinds)]
    log = spark.createDataFrame(rows, LOG)
    for part in (1, 2):
        log.filter(F.col("version") <= 2 if part == 1 else F.col("version") > 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))  # version 2 comes twice
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    projections.run_available(projections.memory_projection(stream), projections.upsert_sink(str(tmp_path / "out"), ["stream_id"]), str(tmp_path / "cp"))
    columns = ["stream_id", "memory_space_id", "status", "superseded_by", "tags", "confidence"]
    got = projections.latest(spark, str(tmp_path / "out"), ["stream_id"]).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, folds.fold_memories(log).select(*columns).collect()), key=str)


def test_idle_windows_close_by_watermark(spark, tmp_path):
    rows = [("s", T0), ("s", T0 + timedelta(minutes=10)), ("s", T0 + timedelta(minutes=50)), ("z", T0 + timedelta(hours=5))]
    spark.createDataFrame(rows, "session_id string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("session_id string, at timestamp").parquet(str(tmp_path / "log"))
    seen = []
    projections.run_available(projections.idle_timers(stream), lambda df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp"), "append")
    assert sorted(seen) == [("s", T0 + timedelta(minutes=40), 2), ("s", T0 + timedelta(minutes=80), 1)]


def test_streamed_sessions_equal_the_batch_fold(spark, tmp_path):
    plans = [["started", "turn"], ["started", "awaiting"], ["started", "awaiting", "resumed", "turn"], ["started", "awaiting", "failed"], ["interactive"], ["started", "awaiting", "resumed", "awaiting", "completed"]]
    rows = [("a", f"s{s}", i, k, T0 + timedelta(hours=i), f"x{i}", f"k{i}") for s, kinds in enumerate(plans) for i, k in enumerate(kinds)]
    log = spark.createDataFrame(rows, "memory_space_id string, stream_id string, version int, kind string, at timestamp, text string, key string")
    for part in ("version < 2", "version > 0"):  # version 1 comes twice
        log.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    projections.run_available(projections.session_projection(stream), projections.upsert_sink(str(tmp_path / "out"), ["stream_id"]), str(tmp_path / "cp"))
    want = folds.fold_sessions(log)
    got = projections.latest(spark, str(tmp_path / "out"), ["stream_id"]).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_log_is_read_by_type(spark, tmp_path):
    rows = [("memory", f"m_{n}", n, ("memory_recorded", "turn_recorded")[n % 2], "{}", T0) for n in range(6)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "log"))
    for kind, want in ((None, 6), ("memory_recorded", 3), ("none of them", 0)):
        name = f"log_{want}"
        stream = events.log_stream(spark, str(tmp_path / "log"), kind).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        stream.awaitTermination()
        assert spark.table(name).count() == want


def _event(version, kind="tags", space="a", **more):
    return {"version": version, "kind": kind, "memory_space_id": space, "by": None, "tags": f"t{version}", "confidence": f"c{version}"} | more


def test_version_zero_late_recordings_and_repeats():
    now = {"seen": [], "spaces": {}}
    for e in (_event(2), _event(1, "confidence"), _event(2, tags="again"), _event(3, "superseded", by="x"), _event(3, "archived", space="b"), _event(0, "recorded")):
        projections._apply(now, e)
    space, own = projections._home(now)
    assert space == "a" and own["n_events"] == 4 and now["seen"] == [[0, 3]]
    assert {k: v[1] for k, v in own["fields"].items()} == {"tags": "t2", "confidence": "c1", "status": "superseded", "superseded_by": "x"}


def test_state_does_not_grow_behind_a_gap_or_without_a_recording():
    import json

    now = {"seen": [], "spaces": {}}
    for v in [*range(5000, 9000), *range(0, 4000)]:  # versions 4000 to 4999 never come, and no recording does
        projections._apply(now, _event(v, "tags" if v % 2 else "merged"))
    assert now["seen"] == [[0, 3999], [5000, 8999]] and projections._home(now) is None
    assert len(json.dumps(now)) < 400


def test_runs_of_versions():
    import random

    rng, seen, want = random.Random(3), [], set()
    for _ in range(5000):
        v = rng.randrange(2000)
        assert projections._new(seen, v) == (v not in want)
        want.add(v)
    assert {v for lo, hi in seen for v in range(lo, hi + 1)} == want
    assert all(a[1] + 1 < b[0] for a, b in zip(seen, seen[1:]))


def _activity():
    """Sessions with gaps just at and just over the idle time, ends, repeated ends, ramps."""
    rows, minute = [], timedelta(minutes=1)
    for s, gaps in (("a", [5, 29, 30, 31, 5]), ("b", [1] * 20), ("c", []), ("d", [45, 2])):
        at = T0
        rows.append((s, "started", None, at))
        for i, gap in enumerate(gaps, 1):
            at += gap * minute
            rows.append((s, "turn", i, at))
        if s in "bd":
            rows += [(s, "completed", None, at + minute), (s, "failed", None, at + 2 * minute)]
    return rows


def test_streamed_timers_are_those_of_the_batch(spark, tmp_path):
    schema = "session_id string, kind string, turn_index int, at timestamp"
    rows = sorted(_activity(), key=lambda r: r[3])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []
    try:
        # each part is a run of its own that goes on from the checkpoint; the last one brings the watermark beyond all
        for part in (rows[:9], rows[9:20], rows[20:], [("z", "awaiting", None, T0 + timedelta(days=2))], [("z", "awaiting", None, T0 + timedelta(days=3))]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
            projections.run_available(queue.session_timers(stream), lambda df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp"), "append")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = timers.session_timers(spark.createDataFrame(rows, schema)).select("timer_id", "session_id", "reason", "fire_at")
    assert sorted(seen) == sorted(map(tuple, want.collect()))


def _queue(spark, path, n=6, **how):
    q = queue.Queue(spark, str(path / "q"), **how)
    q.schedule(spark.createDataFrame([(f"t{i}", "a", T0 + timedelta(seconds=i)) for i in range(n)], "timer_id string, memory_space_id string, fire_at timestamp"))
    return q


def _state(q):
    return {r.timer_id: (r.status, r.attempts, r.fire_at) for r in q.latest().collect()}


def test_a_queue_claims_retries_and_buries(spark, tmp_path):
    q = _queue(spark, tmp_path, 4)
    told = {"t0": "completed", "t1": "retry", "t2": "dead", "t3": "foreign"}

    def fire(batch):
        outcome = F.create_map(*[F.lit(x) for kv in told.items() for x in kv])[F.col("timer_id")]
        return batch.withColumn("outcome", outcome).withColumn("error", F.lit("e"))

    now = T0 + timedelta(seconds=3)
    assert q.drain(fire, now) == 1 and q.drain(fire, now) == 0
    assert _state(q) == {"t0": ("fired", 1, T0), "t1": ("scheduled", 1, now + timedelta(seconds=30)), "t2": ("dead", 1, T0 + timedelta(seconds=2)), "t3": ("scheduled", 1, now + timedelta(seconds=600))}
    assert [r.last_error for r in q.dead().collect()] == ["[memory space a] e"]
    # what has fired or died is not scheduled again; what waits moves to the later time alone
    again = spark.createDataFrame([(t, "a", now + timedelta(seconds=60 if t == "t1" else 5)) for t in told], "timer_id string, memory_space_id string, fire_at timestamp")
    q.schedule(again)
    assert {t: s[::2] for t, s in _state(q).items()} == {"t0": ("fired", T0), "t1": ("scheduled", now + timedelta(seconds=60)), "t2": ("dead", T0 + timedelta(seconds=2)), "t3": ("scheduled", now + timedelta(seconds=600))}
    for k in range(1, 10):
        q.drain(fire, now + timedelta(hours=k))
    assert {t: s[:2] for t, s in _state(q).items()} == {"t0": ("fired", 1), "t1": ("dead", 9), "t2": ("dead", 1), "t3": ("dead", 9)}


def test_a_worker_that_dies_leaves_a_claim_that_is_due(spark, tmp_path):
    q = _queue(spark, tmp_path, 2)
    now = T0 + timedelta(minutes=1)
    assert {r.status for r in q.claim(now).collect()} == {"claimed"}
    # the next worker takes the claim over; it is the same attempt
    other = queue.Queue(spark, q.path)
    assert other.drain(lambda b: b.withColumns({"outcome": F.lit("completed"), "error": F.lit(None).cast("string")}), now) == 1
    assert {s[:2] for s in _state(q).values()} == {("fired", 1)}


def test_a_subscription_that_embeds(spark, tmp_path):
    """Deliveries as a queue with the delays of the embedding worker: a provider that fails is retried, what can't be is a dead letter, a broken store halts all."""
    from mnemo.functions import scoring

    q = _queue(spark, tmp_path, 5, delay=scoring.embedding_delay, ceiling=3)
    base = {"decoded": True, "refused": False, "may_distill": True, "event_space": "a", "row_space": "a", "settled": False}

    def fire(batch, fatal=False):
        seen = batch.withColumns({k: F.lit(v) for k, v in base.items()} | {"decoded": F.col("timer_id") != "t0", "provider_failed": F.col("timer_id").isin("t1", "t2") & ((F.col("timer_id") == "t1") | (F.col("attempts") < 2)), "store_error": F.lit("fatal" if fatal else None).cast("string")})
        ack = embedding.delivery(seen)
        return ack.select(*batch.columns, F.when(F.col("ack") == "ok", "completed").when(F.col("ack") == "dead-letter", "dead").otherwise(F.col("ack")).alias("outcome"), F.col("ack").alias("error"))

    now = T0 + timedelta(minutes=1)
    q.drain(lambda b: fire(b, fatal=True), now)
    assert {(s[0], s[1]) for t, s in _state(q).items() if t != "t0"} == {("scheduled", 0)}  # halted before anything was done
    fired_at = []
    for _ in range(6):
        q.drain(fire, now)
        waits = [r.fire_at for r in q.latest().filter("status = 'scheduled'").collect()]
        if not waits:
            break
        fired_at.append((min(waits) - now).total_seconds())
        now = min(waits)
    assert fired_at == [5, 20, 60]
    assert {t: s[:2] for t, s in _state(q).items()} == {"t0": ("dead", 1), "t1": ("dead", 4), "t2": ("fired", 3), "t3": ("fired", 1), "t4": ("fired", 1)}
