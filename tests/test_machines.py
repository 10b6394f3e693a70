"""Stage machine, arbitration and cooldowns: rules by hand, the stream against the batch across restarts, listeners once each."""

import datetime
import random

import pytest

from ledgerwood.operators import folds, stages
from ledgerwood.streaming import jobs, machines

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp, version bigint, command string, stage int, applies string"


def run(*commands):
    """States and results of commands, each a word or (word, stage or conditions)."""
    state, out = None, []
    for i, c in enumerate(commands):
        word, rest = c if isinstance(c, tuple) else (c, None)
        row = {"command": word, "stage": rest if isinstance(rest, int) else None, "applies": rest if isinstance(rest, str) else "000", "ts": T0 + datetime.timedelta(minutes=i)}
        state, got = stages.machine(state, row)
        out.append(got)
    return out


def test_order_is_enforced_and_attempts_counted():
    log = run(("start", 1), "start", ("start", 1), "complete", "start", "fail", "start", "retry", "retry", "start", "complete")
    assert [r["refused"] for r in log] == ["blocked", None, "blocked", None, None, None, None, "not failed", "not failed", None, None]
    assert (log[5]["status"], log[5]["resume_at"]) == ("failed", "analyse") and log[6]["attempt"] == 2 and log[10]["attempt"] == 3
    assert log[5]["seconds"] == 60 and log[10]["resume_at"] == "extract_text"


def test_stages_that_do_not_apply_are_skipped():
    log = run(("detect", "010"), ("start", 3), ("skip", 0), ("skip", 6))
    assert log[0]["statuses"] == "pppspppppspp" and log[0]["progress"] == 0
    assert [r["refused"] for r in log[1:]] == ["does not apply", "not conditional", None]
    whole = run(("detect", "000"), *["start", "complete"] * 9)
    assert (whole[-1]["status"], whole[-1]["progress"], whole[-1]["resume_at"]) == ("completed", 100, None)
    again = run(("detect", "000"), *["start", "complete"] * 9, "cancel", ("reset", 8), "start", "start")
    assert again[-4]["refused"] == "already finished" and again[-3]["statuses"] == "cccsccscpppp"
    assert [r["on_stage"] for r in again[-2:]] == ["chunk", "chunk"]  # a stage that a crashed worker left starts again


def test_cancelled_versions_run_nothing_until_reset():
    log = run("start", "cancel", "start", "cancel", ("reset", 0), "start")
    assert [r["refused"] for r in log] == [None, None, "cancelled", "already finished", None, None]
    assert log[1]["status"] == "cancelled" and log[4]["status"] == "processing"


def test_one_active_job():
    step, state, out = folds.arbitrated(100), None, []
    for at, asks, n in [(0, True, 1), (50, True, 2), (149, True, 3), (251, True, 4), (260, False, 5), (261, True, 6), (262, False, 7), (263, False, 8)]:
        state, got = step(state, {"ts": T0 + datetime.timedelta(seconds=at), "asks": asks, "request_id": n})
        out.append((got["job_id"], got["is_new"]))
    assert out == [(1, True), (1, False), (1, False), (4, True), (4, False), (6, True), (6, False), (None, False)]


def test_cooldown_depends_on_what_passed():
    step, last, out = folds.cooled(10), None, []
    for at in (0, 6, 9, 10, 12, 19, 20, 21):
        last, got = step(last, {"ts": T0 + datetime.timedelta(seconds=at)})
        out.append(got["passes"])
    assert out == [True, False, False, True, False, False, True, False]


def commands(n=400, versions=5):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        word = rng.choice(["start"] * 5 + ["complete"] * 5 + ["fail", "retry", "skip", "detect", "reset", "cancel"])
        stage = rng.choice([3, 6, 9]) if word == "skip" else rng.randrange(12) if word == "reset" else rng.choice([None, None, rng.randrange(12)]) if word == "start" else None
        # A version that holds a third of all rows, and one without a number.
        version = 0 if i % 3 == 0 else None if i % 31 == 1 else rng.randrange(1, versions)
        rows.append((i, T0 + datetime.timedelta(minutes=i), version, word, stage, rng.choice(["000", "101", "111"])))
    return rows


def as_rows(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rows, base = [r for r in commands() if r[2] is not None], str(tmp_path)
    want = as_rows(stages.replayed(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    schema = spark.createDataFrame([], SCHEMA).schema
    for part in (rows[:100], rows[100:250], rows[250:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        log = machines.stepped(jobs.stream(spark, f"{base}/in", schema), "version", ["ts", "event_id"], stages.machine, stages.FIELDS)
        jobs.available_now(log, f"{base}/log", f"{base}/checkpoint").awaitTermination(120)
    assert as_rows(spark.read.parquet(f"{base}/log")) == want


def test_null_versions_and_hot_ones_in_batch(spark):
    log = stages.replayed(spark.createDataFrame(commands(), SCHEMA).repartition(4))
    assert log.count() == 400
    state = None
    for r in [r for r in commands() if r[2] is None]:
        state, _ = stages.machine(state, dict(zip(["event_id", "ts", "version", "command", "stage", "applies"], r)))
    assert [r["statuses"] for r in stages.current(log).where("version IS NULL").collect()] == [state["statuses"]]


def test_jobs_expire_across_restarts(spark, tmp_path):
    base, schema = str(tmp_path), "request_id bigint, ts timestamp, key string, asks boolean"
    rows = [(1, 0, "a", True), (2, 30, "a", True), (3, 40, "b", True), (4, 90, "a", True), (5, 1000, "b", True), (6, 1001, "a", False), (7, 1002, "a", True)]
    rows = [(i, T0 + datetime.timedelta(seconds=s), k, asks) for i, s, k, asks in rows]
    kind = spark.createDataFrame([], schema).schema
    for part in (rows[:2], rows[2:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        out = machines.stepped(jobs.stream(spark, f"{base}/in", kind), "key", ["ts", "request_id"], folds.arbitrated(100), "job_id bigint, is_new boolean", lifetime=100)
        jobs.available_now(out, f"{base}/out", f"{base}/checkpoint").awaitTermination(120)
    got = {r["request_id"]: (r["job_id"], r["is_new"]) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (1, False), 5: (5, True), 6: (None, False), 7: (7, True)}


def test_listeners_are_called_once_for_each_key(spark, tmp_path):
    base, calls, broken = str(tmp_path), {"a": [], "b": []}, [True]
    kind = spark.createDataFrame([], "key bigint, name string").schema

    def b(rows, number):
        if broken[0]:
            raise ValueError("no answer")
        calls["b"] += sorted(r["key"] for r in rows.collect())

    def start():
        return machines.delivered(jobs.stream(spark, f"{base}/in", kind), "key", {"b": b, "a": lambda rows, _: calls["a"].extend(sorted(r["key"] for r in rows.collect()))}, f"{base}/box", f"{base}/checkpoint")

    spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], kind).write.mode("append").parquet(f"{base}/in")
    with pytest.raises(Exception, match="listeners failed"):
        start().awaitTermination(60)
    assert calls == {"a": [1, 2], "b": []}
    broken[0] = False
    start().awaitTermination(60)
    assert calls == {"a": [1, 2], "b": [1, 2]}
    spark.createDataFrame([(2, "y"), (3, "z")], kind).write.mode("append").parquet(f"{base}/in")
    start().awaitTermination(60)
    assert calls == {"a": [1, 2, 3], "b": [1, 2, 3]}
