"""Queries: models ranked and chosen by host, safety of uploads, stalled jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as O
from ..sources.tables import table
from .registry import query

# A registry of models, as (role, name, least profile, preference).
REGISTRY = [("llm", "alpha:14b", 3, 1), ("llm", "alpha:7b", 2, 2), ("llm", "beta:3b", 1, 3), ("drafting", "alpha:14b", 3, 1), ("drafting", "alpha:7b", 1, 2), ("embedding", "vec", 1, 1)]
_REGISTRY = ", ".join(f"('{r}', '{n}', {p}, {k})" for r, n, p, k in REGISTRY)
#: Suppliers stand in for models, their nations for hosts, their lines for measurements.
_PROBES = """m AS (SELECT l_suppkey, avg(l_quantity) AS q FROM lineitem GROUP BY 1), pr AS (SELECT s_nationkey AS host, s_name AS name, ['llm', 'drafting', 'embedding'][s_suppkey % 3 + 1] AS role, (s_suppkey % 80)::DOUBLE AS billions, CASE WHEN s_suppkey % 17 <> 0 THEN round(q * (s_suppkey % 40) / CASE WHEN s_suppkey % 3 = 2 THEN 500.0 ELSE 1.0 END, 3) END AS seconds,
s_suppkey % 13 = 0 AS timed_out, CASE WHEN s_suppkey % 19 = 0 THEN 'no answer' END AS error, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 11 <> 0 END AS valid_output, CASE WHEN s_suppkey % 10 <> 5 THEN CASE WHEN s_suppkey % 4 = 2 THEN 32 ELSE 64 END END AS dimensions, s_suppkey % 5 = 0 AS in_registry FROM supplier JOIN m ON l_suppkey = s_suppkey)"""


def probes(spark, sf):
    k = F.col("s_suppkey")
    m = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"))
    s = table(spark, sf, "supplier").join(m, F.col("l_suppkey") == k)
    role = F.get(F.array(F.lit("llm"), F.lit("drafting"), F.lit("embedding")), (k % 3).cast("int"))
    seconds = F.round(F.col("q") * (k % 40) / F.when(k % 3 == 2, 500.0).otherwise(1.0), 3)
    return s.select(
        F.col("s_nationkey").alias("host"), F.col("s_name").alias("name"), role.alias("role"), (k % 80).cast("double").alias("billions"), F.when(k % 17 != 0, seconds).alias("seconds"), (k % 13 == 0).alias("timed_out"),
        F.when(k % 19 == 0, "no answer").alias("error"), F.when(k % 7 != 0, k % 11 != 0).alias("valid_output"), F.when(k % 10 != 5, F.when(k % 4 == 2, 32).otherwise(64)).alias("dimensions"), (k % 5 == 0).alias("in_registry"))


_QUALITY = "CASE WHEN billions IS NULL OR billions <= 0 THEN 35.0 WHEN billions <= 1 THEN 15.0 " + " ".join(f"WHEN billions <= {b} THEN {p} + (billions - {a}) * {(q - p) / (b - a)!r}" for (a, p), (b, q) in zip(O.QUALITY, O.QUALITY[1:])) + " ELSE 100.0 END"
_SPEED = "CASE WHEN seconds IS NULL THEN 0.0 WHEN seconds <= budget * 0.25 THEN 100.0 WHEN seconds <= budget THEN 100.0 - (seconds - budget * 0.25) / (budget * 0.75) * 45.0 WHEN seconds <= 2 * budget THEN 40.0 WHEN seconds <= 4 * budget THEN 20.0 ELSE 5.0 END"


@query(f"""WITH {_PROBES}, b AS (SELECT *, CASE role WHEN 'embedding' THEN 2.0 WHEN 'drafting' THEN 200.0 ELSE 90.0 END::DOUBLE AS budget, CASE role WHEN 'drafting' THEN 0.75 ELSE 0.45 END::DOUBLE AS w,
CASE WHEN role <> 'embedding' AND timed_out THEN 'timed out' WHEN error IS NOT NULL THEN 'error' WHEN role <> 'embedding' AND NOT coalesce(valid_output, true) THEN 'invalid output' WHEN role = 'embedding' AND dimensions IS NULL THEN 'no vectors' WHEN role = 'embedding' AND dimensions <> 64 THEN 'other width' WHEN role <> 'embedding' AND seconds IS NULL THEN 'not measured' WHEN role = 'drafting' AND seconds > 600 THEN 'over the limit' END AS refused FROM pr),
e AS (SELECT * REPLACE (CASE WHEN role = 'embedding' THEN coalesce(seconds, 0.0) ELSE seconds END AS seconds) FROM b),
s AS (SELECT *, refused IS NULL AS eligible, CASE WHEN refused IS NULL THEN round((CASE WHEN role = 'embedding' THEN {_SPEED} ELSE w * ({_QUALITY}) + (1 - w) * ({_SPEED}) END + CASE WHEN NOT in_registry THEN 0 WHEN role = 'embedding' THEN 10 ELSE 4 END)::DOUBLE, 6) ELSE 0.0 END::DOUBLE AS score FROM e)
SELECT host, role, name, eligible, score, refused, row_number() OVER (PARTITION BY host, role ORDER BY NOT eligible, score DESC, name)::INTEGER AS place FROM s""")
def g29_model_ranking(spark, sf):
    """Every measured model of a host by role: gates first, then weighted quality and speed with the registry's bonus."""
    return O.recommended(probes(spark, sf), 64)


_HOSTS = """h AS (SELECT n_nationkey AS host, role, n_nationkey % 3 + 1 AS profile, CASE WHEN n_nationkey % 4 = 0 THEN 'Alpha:7B-q4_K_M' WHEN n_nationkey % 4 = 1 THEN 'gamma' END AS configured FROM nation, (VALUES ('llm'), ('drafting'), ('embedding')) r(role)), i AS (SELECT DISTINCT c_nationkey AS host, ['alpha:7b-q8_0', 'beta:3b', 'VEC', 'alpha:14b', 'gamma:latest', 'delta'][c_custkey % 6 + 1] AS name FROM customer WHERE c_custkey % 5 < 2)"""
_CANON = lambda c: f"(CASE WHEN contains(regexp_replace(lower(trim({c})), '-q[0-9][a-z0-9_]*$', ''), ':') THEN regexp_replace(lower(trim({c})), '-q[0-9][a-z0-9_]*$', '') ELSE regexp_replace(lower(trim({c})), '-q[0-9][a-z0-9_]*$', '') || ':latest' END)"


@query(f"""WITH reg(role, name, min_profile, preference) AS (VALUES {_REGISTRY}), {_HOSTS}, t AS (SELECT DISTINCT host, {_CANON('name')} AS key FROM i),
b AS (SELECT h.host, h.role, arg_min(reg.name, (preference, reg.name)) AS best FROM h JOIN reg ON reg.role = h.role AND min_profile <= profile JOIN t ON t.host = h.host AND t.key = {_CANON('reg.name')} GROUP BY 1, 2)
SELECT h.host, h.role, CASE WHEN t.key IS NOT NULL THEN configured ELSE best END AS name, CASE WHEN t.key IS NOT NULL THEN 'configured' WHEN best IS NOT NULL THEN 'recommended' ELSE 'none' END AS why FROM h LEFT JOIN t ON t.host = h.host AND t.key = {_CANON('configured')} LEFT JOIN b ON b.host = h.host AND b.role = h.role""")
def g30_model_selection(spark, sf):
    """The model that each host uses for each role."""
    roles = F.array(*[F.lit(r) for r in ("llm", "drafting", "embedding")])
    n = F.col("n_nationkey")
    hosts = table(spark, sf, "nation").select(n.alias("host"), F.explode(roles).alias("role"), (n % 3 + 1).alias("profile"), F.when(n % 4 == 0, "Alpha:7B-q4_K_M").when(n % 4 == 1, "gamma").alias("configured"))
    names = F.array(*[F.lit(x) for x in ("alpha:7b-q8_0", "beta:3b", "VEC", "alpha:14b", "gamma:latest", "delta")])
    installed = table(spark, sf, "customer").where("c_custkey % 5 < 2").select(F.col("c_nationkey").alias("host"), F.get(names, (F.col("c_custkey") % 6).cast("int")).alias("name"))
    return O.selected(hosts, spark.createDataFrame(REGISTRY, "role string, name string, min_profile int, preference int"), installed)


MOST_BYTES = 6000


@query(f"""WITH f AS (SELECT page_id, html, strlen(html) AS size, CASE WHEN page_id % 7 = 3 THEN 'application/pdf' WHEN page_id % 11 = 5 THEN 'text/rtf' ELSE 'text/html' END AS declared, CASE WHEN starts_with(html, 'MZ') THEN 'executable' WHEN starts_with(html, '%PDF') THEN 'application/pdf' WHEN regexp_matches(left(html, 600), '(?i)<(?:!doctype|html)') THEN 'text/html' END AS detected FROM pages)
SELECT page_id, CASE WHEN coalesce(size, 0) = 0 THEN 'empty_file' WHEN size > {MOST_BYTES} THEN 'size_limit' WHEN detected = 'executable' THEN 'executable_content' WHEN detected IS NULL THEN 'unrecognised_content' WHEN detected <> declared THEN 'type_mismatch' END AS rejected,
array_to_string(list_filter([CASE WHEN regexp_matches(html, '(?i)<script') THEN 'script' END, CASE WHEN regexp_matches(html, '(?i)<iframe|<object|<embed') THEN 'embedded' END, CASE WHEN regexp_matches(html, '(?i)\\son[a-z]+\\s*=') THEN 'handler' END], lambda x: x IS NOT NULL), ',') AS suspicious FROM f""".replace("\\\\", "\\"))
def d14_upload_safety(spark, sf):
    """Uploads that are refused, for their size or for being something else than declared, and active content that is only flagged."""
    p = table(spark, sf, "pages")
    size, html, n = F.octet_length("html"), F.col("html"), F.col("page_id")
    declared = F.when(n % 7 == 3, "application/pdf").when(n % 11 == 5, "text/rtf").otherwise("text/html")
    detected = F.when(html.startswith("MZ"), "executable").when(html.startswith("%PDF"), "application/pdf").when(F.substring(html, 1, 600).rlike("(?i)<(?:!doctype|html)"), "text/html")
    refused = (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty_file").when(size > MOST_BYTES, "size_limit").when(detected == "executable", "executable_content").when(detected.isNull(), "unrecognised_content")
        .when(detected != declared, "type_mismatch")
    )
    flags = F.array_compact(F.array(F.when(html.rlike("(?i)<script"), "script"), F.when(html.rlike("(?i)<iframe|<object|<embed"), "embedded"), F.when(html.rlike(r"(?i)\son[a-z]+\s*="), "handler")))
    return p.select("page_id", refused.alias("rejected"), F.array_join(flags, ",").alias("suspicious"))


@query("""WITH l AS (SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated, count(*) AS updates FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT job_id, updated, floor((epoch(now) - epoch(updated)) / 60)::BIGINT AS silent_minutes, updates FROM l, n WHERE status IN ('click', 'view') AND epoch(now) - epoch(updated) > 7200""")
def x04_stalled_jobs(spark, sf):
    """Jobs that run and haven't been heard of for two hours, at the time of the newest event: a periodic batch over the jobs' log."""
    e = table(spark, sf, "events")
    jobs = e.groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("updated"), F.count("*").alias("updates"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    silent = F.timestamp_diff("SECOND", F.col("updated"), F.col("now"))
    found = jobs.where(F.col("status").isin("click", "view")).crossJoin(F.broadcast(now)).withColumn("silent", silent).where(F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("updated").cast("timestamp")) > 7_200_000_000)
    return found.select("job_id", "updated", F.floor(F.col("silent") / 60).cast("bigint").alias("silent_minutes"), "updates")
