"""Queries over logs: the stage machine, one active job a key, sweeps that suppress repeats. Events stand in for the logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, stages
from ..sources.tables import table
from .registry import query

#: What an event asks of its user's version: kinds of event by their payload's number.
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_COMMANDS = f"""c AS (SELECT event_id, ts, user_id AS version, CASE WHEN event_type = 'click' THEN 'start' WHEN event_type IN ('view', 'purchase') THEN 'complete' WHEN event_type = 'error' THEN CASE WHEN value > 15 THEN 'fail' ELSE 'start' END
WHEN k < 10 THEN 'skip' WHEN k < 35 THEN 'detect' WHEN k < 40 THEN 'cancel' WHEN k < 50 THEN 'reset' ELSE 'retry' END AS command,
CASE WHEN event_type = 'signup' AND k < 10 THEN [3, 6, 9, 4][k % 4 + 1] WHEN event_type = 'signup' AND k >= 40 AND k < 50 THEN k % 12 WHEN event_type = 'error' AND value <= 15 THEN k % 12 END AS stage, (k % 2)::VARCHAR || (k // 2 % 2)::VARCHAR || (k // 4 % 2)::VARCHAR AS applies
FROM (SELECT *, {_K} AS k FROM events))"""


def commands(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    command = (
        F.when(kind == "click", "start").when(kind.isin("view", "purchase"), "complete").when(kind == "error", F.when(F.col("value") > 15, "fail").otherwise("start"))
        .when(k < 10, "skip").when(k < 35, "detect").when(k < 40, "cancel").when(k < 50, "reset").otherwise("retry")
    )
    conditional = F.get(F.array(*[F.lit(i) for i in (3, 6, 9, 4)]), k % 4)
    named = F.when((kind == "signup") & (k < 10), conditional).when((kind == "signup") & (k >= 40) & (k < 50), k % 12).when((kind == "error") & (F.col("value") <= 15), k % 12)
    bit = lambda n: (F.floor(k / n) % 2).cast("string")
    return table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("version"), command.alias("command"), named.alias("stage"), F.concat(bit(1), bit(2), bit(4)).alias("applies"))


_NAMES = ", ".join(f"'{s}'" for s in stages.STAGES)
_DONE = lambda st, i: f"substr({st}, {i}, 1) IN ('c', 's')"
_REQ = lambda f: f"('111' || substr({f}, 1, 1) || '11' || substr({f}, 2, 1) || '11' || substr({f}, 3, 1) || '11')"
_NEXT = lambda st, f: f"list_filter(range(1, 13), lambda i: substr({_REQ(f)}, i, 1) = '1' AND NOT {_DONE(st, 'i')})[1]"
_RESUME = lambda st, f, c: f"CASE WHEN contains({st}, 'r') THEN instr({st}, 'r') WHEN contains({st}, 'f') THEN instr({st}, 'f') WHEN {c} THEN NULL ELSE {_NEXT(st, f)} END"
_STATUS = lambda st, f, c: f"CASE WHEN {c} THEN 'cancelled' WHEN contains({st}, 'f') THEN 'failed' WHEN {_NEXT(st, f)} IS NULL THEN 'completed' ELSE 'processing' END"
_PUT = lambda st, i, x: f"(left({st}, {i} - 1) || {x} || substr({st}, {i} + 1))"
#: One step a recursion: the n-th command of every version on the state that the one before left.
MACHINE = f"""{_COMMANDS}, e AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY ts, event_id) AS n FROM c),
g AS (SELECT version, 0::BIGINT AS n, 'pppppppppppp' AS st, '000' AS f, false AS cancelled, [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]::INTEGER[] AS att, list_transform(range(12), lambda i: NULL::TIMESTAMP) AS beg, NULL::BIGINT AS t, NULL::VARCHAR AS refused, NULL::VARCHAR AS command, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts FROM (SELECT DISTINCT version FROM e)
UNION ALL SELECT version, n, CASE WHEN refused IS NOT NULL THEN st WHEN command = 'start' THEN {_PUT('st', 't', "'r'")} WHEN command = 'complete' THEN {_PUT('st', 't', "'c'")} WHEN command = 'fail' THEN {_PUT('st', 't', "'f'")} WHEN command = 'skip' THEN {_PUT('st', 't', "'s'")}
  WHEN command = 'retry' THEN {_PUT('st', 't', "'p'")} WHEN command = 'reset' THEN left(st, t - 1) || repeat('p', 13 - t) WHEN command = 'detect' THEN array_to_string(list_transform(range(1, 13), lambda i: CASE WHEN substr(st, i, 1) = 'p' AND substr({_REQ('applies')}, i, 1) = '0' THEN 's' ELSE substr(st, i, 1) END), '') ELSE st END,
  CASE WHEN command = 'detect' THEN applies ELSE f END, CASE WHEN refused IS NOT NULL THEN cancelled WHEN command = 'cancel' THEN true WHEN command IN ('retry', 'reset') THEN false ELSE cancelled END,
  CASE WHEN refused IS NOT NULL THEN att WHEN command = 'start' THEN list_transform(range(1, 13), lambda i: (att[i] + CASE WHEN i = t THEN 1 ELSE 0 END)::INTEGER) WHEN command = 'reset' THEN list_transform(range(1, 13), lambda i: CASE WHEN i >= t THEN 0 ELSE att[i] END) ELSE att END,
  CASE WHEN refused IS NOT NULL THEN beg WHEN command = 'start' THEN list_transform(range(1, 13), lambda i: CASE WHEN i = t THEN ts ELSE beg[i] END) WHEN command = 'reset' THEN list_transform(range(1, 13), lambda i: CASE WHEN i >= t THEN NULL ELSE beg[i] END) ELSE beg END, t, refused, command, event_id, ts
FROM (SELECT *, CASE WHEN command = 'start' AND cancelled THEN 'cancelled' WHEN command = 'start' AND t IS NULL THEN 'nothing to do' WHEN command = 'start' AND substr({_REQ('f')}, t, 1) = '0' THEN 'does not apply' WHEN command = 'start' AND {_NEXT('st', 'f')} < t THEN 'blocked'
  WHEN command IN ('complete', 'fail') AND t IS NULL THEN 'nothing runs' WHEN command = 'skip' AND t NOT IN (4, 7, 10) THEN 'not conditional' WHEN command = 'retry' AND t IS NULL THEN 'not failed' WHEN command = 'cancel' AND {_STATUS('st', 'f', 'cancelled')} <> 'processing' THEN 'already finished' END AS refused
FROM (SELECT g.version, e.n, st, f, cancelled, att, beg, e.command, e.applies, e.event_id, e.ts, CASE WHEN e.command IN ('complete', 'fail') THEN nullif(instr(st, 'r'), 0) WHEN e.command = 'retry' THEN nullif(instr(st, 'f'), 0) WHEN e.command = 'start' AND e.stage IS NULL THEN {_RESUME('st', 'f', 'cancelled')} ELSE e.stage + 1 END AS t
FROM g JOIN e ON e.version = g.version AND e.n = g.n + 1))),
l AS (SELECT event_id, ts, version, n, command, [{_NAMES}][t] AS on_stage, refused, att[t] AS attempt, CASE WHEN command IN ('complete', 'fail') AND refused IS NULL THEN floor(epoch(ts) - epoch(beg[t]))::BIGINT END AS seconds, st AS statuses, {_STATUS('st', 'f', 'cancelled')} AS status, [{_NAMES}][{_RESUME('st', 'f', 'cancelled')}] AS resume_at,
floor(100.0 * len(list_filter(range(1, 13), lambda i: substr({_REQ('f')}, i, 1) = '1' AND {_DONE('st', 'i')})) / len(list_filter(range(1, 13), lambda i: substr({_REQ('f')}, i, 1) = '1')) + 0.5)::INTEGER AS progress FROM g WHERE n > 0)"""


@query(f"WITH RECURSIVE {MACHINE} SELECT event_id, version, command, on_stage, refused, attempt, statuses, status, resume_at, progress FROM l")
def d26_stage_machine(spark, sf):
    """Every command of every version: accepted or refused, and the state after it."""
    return stages.replayed(commands(spark, sf)).select("event_id", "version", "command", "on_stage", "refused", "attempt", "statuses", "status", "resume_at", "progress")


@query(f"WITH RECURSIVE {MACHINE} SELECT version, on_stage AS stage, attempt, CASE command WHEN 'fail' THEN 'failed' ELSE 'completed' END AS outcome, seconds, ts AS ended_at FROM l WHERE command IN ('complete', 'fail') AND refused IS NULL")
def v16_stage_log(spark, sf):
    """One row per attempt at a stage that ended."""
    log = stages.stage_log(stages.replayed(commands(spark, sf)))
    return log.select("version", F.col("on_stage").alias("stage"), "attempt", F.when(F.col("command") == "fail", "failed").otherwise("completed").alias("outcome"), "seconds", F.col("ts").alias("ended_at"))


@query(f"WITH RECURSIVE {MACHINE} SELECT version, statuses, status, resume_at, progress, commands, refusals FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY n DESC) AS r, count(*) OVER (PARTITION BY version) AS commands, count(refused) OVER (PARTITION BY version) AS refusals FROM l) WHERE r = 1")
def v15_version_status(spark, sf):
    """The status that a version's log amounts to, and where it resumes."""
    return stages.current(stages.replayed(commands(spark, sf)))


@query(f"""WITH RECURSIVE {MACHINE} SELECT on_stage AS stage, count(*) FILTER (WHERE command = 'start' AND refused IS NULL) AS started, count(*) FILTER (WHERE command = 'complete') AS completed, count(*) FILTER (WHERE command = 'fail') AS failed, count(*) FILTER (WHERE command = 'retry' AND refused IS NULL) AS retried,
count(*) FILTER (WHERE command = 'reset') AS reset, count(*) FILTER (WHERE refused = 'blocked') AS blocked, count(*) FILTER (WHERE refused = 'does not apply') AS inapplicable FROM l WHERE on_stage IS NOT NULL GROUP BY 1""")
def d25_stage_runs(spark, sf):
    """What happened to each stage over all versions."""
    log = stages.replayed(commands(spark, sf)).where("on_stage IS NOT NULL")
    n = lambda test: F.count(F.when(test, 1))
    c, ok = F.col("command"), F.col("refused").isNull()
    return log.groupBy(F.col("on_stage").alias("stage")).agg(
        n((c == "start") & ok).alias("started"), n(c == "complete").alias("completed"), n(c == "fail").alias("failed"), n((c == "retry") & ok).alias("retried"),
        n(c == "reset").alias("reset"), n(F.col("refused") == "blocked").alias("blocked"), n(F.col("refused") == "does not apply").alias("inapplicable"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, event_type <> 'purchase' AS asks, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS job, NULL::TIMESTAMP AS at, NULL::BIGINT AS event_id, NULL::BIGINT AS job_id, false AS is_new FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, n, CASE WHEN asks THEN coalesce(live, event_id) END, CASE WHEN asks THEN ts END, event_id, CASE WHEN asks THEN coalesce(live, event_id) ELSE live END, asks AND live IS NULL
FROM (SELECT e.*, CASE WHEN epoch(e.ts) - epoch(g.at) <= 86400 THEN g.job END AS live FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1))
SELECT event_id, user_id, job_id, is_new FROM g WHERE n > 0""")
def x03_one_active_job(spark, sf):
    """One active job a user: a request while one is active gets that job's number; a job silent for a day is dead."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("event_type") != "purchase").alias("asks"), F.col("event_id").alias("request_id"))
    return folds.folded(e, "user_id", ["ts", "event_id"], folds.arbitrated(86_400), "job_id bigint, is_new boolean").select("event_id", "user_id", "job_id", "is_new")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id::VARCHAR || ':' || event_type AS key, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT key, 1::BIGINT AS n, event_id, ts AS last, true AS passes, NULL::TIMESTAMP AS last_passed FROM e WHERE n = 1
UNION ALL SELECT e.key, e.n, e.event_id, CASE WHEN epoch(e.ts) - epoch(g.last) >= 172800 THEN e.ts ELSE g.last END, epoch(e.ts) - epoch(g.last) >= 172800, g.last FROM g JOIN e ON e.key = g.key AND e.n = g.n + 1)
SELECT event_id, key, passes, last_passed FROM g""")
def x07_suppressed_repeats(spark, sf):
    """Which notices of a kind a user gets, when one passes at most every two days; each depends on the last that passed."""
    e = table(spark, sf, "events").select("event_id", "ts", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"))
    return folds.folded(e, "key", ["ts", "event_id"], folds.cooled(172_800), "passes boolean, last_passed timestamp_ntz").select("event_id", "key", "passes", "last_passed")


@query("""WITH d AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate::DATE AS due FROM orders WHERE o_orderstatus <> 'F'), s AS (SELECT *, date_diff('day', DATE '1998-01-01', due) AS left_ FROM d)
SELECT o_custkey, band, count(*) AS notices, min(due) AS first_due FROM (SELECT *, CASE WHEN left_ < 0 THEN 'overdue' WHEN left_ <= 7 THEN 'within 7' WHEN left_ <= 30 THEN 'within 30' END AS band FROM s) WHERE band IS NOT NULL GROUP BY 1, 2""")
def x05_periodic_sweep(spark, sf):
    """A daily sweep: open deadlines by customer and band of urgency, one notice for all of a band."""
    o = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select("o_custkey", F.to_date("o_orderdate").alias("due"))
    left = F.datediff("due", F.lit("1998-01-01").cast("date"))
    band = F.when(left < 0, "overdue").when(left <= 7, "within 7").when(left <= 30, "within 30")
    return o.select("o_custkey", "due", band.alias("band")).where("band IS NOT NULL").groupBy("o_custkey", "band").agg(F.count("*").alias("notices"), F.min("due").alias("first_due"))
