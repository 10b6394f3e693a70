"""Queries: claims analytics. Orders stand for claims, line items for notices and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compliance as C
from ..operators.relations import dealt, parts_of
from ..sources.tables import table
from .registry import query

TODAY = "1997-06-30"


EDITIONS = ("red-book-2017", "red-book-1987", "red-book-1999", "", "yellow-book-2017", "silver-book-2017", "yellow-book-1999", "silver-book-1999")


def _claim_columns():
    edition = F.get(F.array(*[F.lit(x) for x in EDITIONS]), (F.col("o_custkey") % 8).cast("int"))
    seeks = F.get(F.array(*[F.lit(x) for x in ("both", "time", "money")]), F.col("o_orderkey") % 3)
    aware = F.when(F.col("o_orderkey") % 11 != 0, F.to_date("o_orderdate"))
    return [F.col("o_orderkey").alias("claim_id"), edition.alias("edition"), seeks.alias("seeks"), aware.alias("awareness")]


def claims(spark, sf):
    return table(spark, sf, "orders").select(*_claim_columns())


def parts_of_claims(spark, sf):
    """The parts that findings and notices are dealt to when a claim's rows meet."""
    return parts_of(table(spark, sf, "orders"), C.CLAIMS_PER_TASK)


def notices(spark, sf):
    """One row per order and line number, dated around the order; some under no clause and some without a date."""
    # Dealt by order once: the aggregate and the join both follow that partitioning.
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    lines = lines.repartition(*([n] if (n := parts_of(lines)) else []), "l_orderkey")
    first = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    # The size of a few columns is guessed low from compressed files, so orders would be broadcast to every task.
    both = first.join(table(spark, sf, "orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    clause = F.get(F.array(*[F.lit(x) for x in ("20.2.1", "20.2.4", "44.2", "53.1", "53.3", "20.1", "")]), (F.col("part") % 7).cast("int"))
    obligation = F.when(F.col("part") % 5 == 0, "notice_of_claim").when(F.col("part") % 5 == 1, "detailed_claim")
    effective = F.when(F.col("part") % 13 != 0, F.expr("date_add(to_date(o_orderdate), CAST(part % 90 AS INT) - 5)"))
    return both.select(F.col("o_orderkey").alias("claim_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("notice_id"), clause.alias("clause"), obligation.alias("obligation"), effective.alias("effective"))


# The SQL below states the forms' requirements and all checks on its own: it shares no rule with the operators.
_CLAIMS = """c AS (SELECT o_orderkey AS claim_id, CASE o_custkey % 8 WHEN 0 THEN 'red-book-2017' WHEN 1 THEN 'red-book-1987' WHEN 2 THEN 'red-book-1999' WHEN 3 THEN '' WHEN 4 THEN 'yellow-book-2017' WHEN 5 THEN 'silver-book-2017' WHEN 6 THEN 'yellow-book-1999' ELSE 'silver-book-1999' END AS edition,
['both', 'time', 'money'][o_orderkey % 3 + 1] AS seeks, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS awareness FROM orders)"""
_NOTICES = """n AS (SELECT o_orderkey AS claim_id, l_orderkey * 10 + l_linenumber AS notice_id, ['20.2.1', '20.2.4', '44.2', '53.1', '53.3', '20.1', ''][part % 7 + 1] AS n_clause, CASE part % 5 WHEN 0 THEN 'notice_of_claim' WHEN 1 THEN 'detailed_claim' END AS n_obligation,
CASE WHEN part % 13 <> 0 THEN o_orderdate::DATE + (part % 90 - 5)::INTEGER END AS effective FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2) JOIN orders ON o_orderkey = l_orderkey)"""
REQ = """req AS (
SELECT book || '-book-2017' AS edition, clause, obligation, days AS period_days, barring AS precedent, 'both' AS applies_to, 'awareness' AS runs_from, '' AS runs_from_clause
FROM (VALUES ('red'), ('yellow'), ('silver')) b(book), (VALUES ('20.2.1', 'notice_of_claim', 28, true), ('20.2.4', 'detailed_claim', 84, false)) r(clause, obligation, days, barring)
UNION ALL SELECT book || '-book-1999', '20.1', obligation, days, barring, 'both', 'awareness', '' FROM (VALUES ('red'), ('yellow'), ('silver')) b(book), (VALUES ('notice_of_claim', 28, true), ('detailed_claim', 42, false)) r(obligation, days, barring)
UNION ALL SELECT 'red-book-1987', '44.2', 'notice_of_claim', 28, false, 'time', 'awareness', '' UNION ALL SELECT 'red-book-1987', '44.2', 'detailed_claim', 28, false, 'time', 'notice', '44.2'
UNION ALL SELECT 'red-book-1987', '53.1', 'notice_of_claim', 28, false, 'money', 'awareness', '' UNION ALL SELECT 'red-book-1987', '53.3', 'detailed_claim', 28, false, 'money', 'notice', '53.1')"""
_COUNTS = "(n_clause = '' OR n_clause = clause) AND coalesce(n_obligation = obligation, true) AND effective IS NOT NULL"
_FIRST = """SELECT claim_id, clause, obligation, min((effective, notice_id)) AS f FROM {0} JOIN n USING (claim_id) WHERE """ + _COUNTS
_STATUS = """CASE WHEN starts IS NULL THEN 'indeterminate' WHEN f IS NULL THEN 'not_given' WHEN f[1] < starts THEN 'indeterminate' WHEN f[1] <= starts + period_days THEN 'compliant' ELSE 'late' END"""
FINDINGS = f"""{_CLAIMS}, {_NOTICES}, {REQ},
p AS (SELECT * FROM c JOIN req USING (edition) WHERE applies_to = 'both' OR seeks = 'both' OR applies_to = seeks),
p1 AS (SELECT *, awareness AS starts, NULL::BIGINT AS barred_id FROM p WHERE runs_from = 'awareness'),
f1 AS (SELECT p1.claim_id, clause, obligation, min(row(effective, notice_id)) AS f FROM p1 JOIN n USING (claim_id) WHERE {_COUNTS} GROUP BY 1, 2, 3),
d1 AS (SELECT p1.*, f FROM p1 LEFT JOIN f1 USING (claim_id, clause, obligation)),
p2 AS (SELECT p.*, d1.f[1] AS starts, d1.f[2] AS barred_id FROM p LEFT JOIN d1 ON d1.claim_id = p.claim_id AND d1.clause = p.runs_from_clause AND d1.obligation = 'notice_of_claim' AND d1.f IS NOT NULL WHERE p.runs_from = 'notice'),
f2 AS (SELECT p2.claim_id, clause, obligation, min(row(effective, notice_id)) AS f FROM p2 JOIN n USING (claim_id) WHERE {_COUNTS} AND notice_id IS DISTINCT FROM barred_id GROUP BY 1, 2, 3),
d2 AS (SELECT p2.*, f FROM p2 LEFT JOIN f2 USING (claim_id, clause, obligation)),
g AS (SELECT *, {_STATUS} AS status FROM (SELECT * FROM d1 UNION ALL BY NAME SELECT * FROM d2))"""


@query(f"""WITH {FINDINGS} SELECT claim_id, clause, obligation, status, f[2] AS notice_id, (starts + period_days)::DATE AS deadline, CASE WHEN status = 'late' THEN date_diff('day', (starts + period_days)::DATE, f[1]) END AS days_late, status = 'late' AND precedent AS time_barred FROM g""")
def g04_notice_compliance(spark, sf):
    found = C.notice_compliance(claims(spark, sf), notices(spark, sf), C.requirements(spark))
    return found.select("claim_id", "clause", "obligation", "status", "notice_id", "deadline", F.col("days_late").cast("bigint").alias("days_late"), "time_barred")


@query(f"""WITH {FINDINGS} SELECT claim_id, count(*) AS findings, count(*) FILTER (WHERE status = 'late') AS late, count(*) FILTER (WHERE status = 'late' AND precedent) AS barred,
count(*) FILTER (WHERE status = 'not_given' AND starts + period_days < DATE '{TODAY}') AS overdue, count(*) FILTER (WHERE status = 'not_given' AND starts + period_days BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 30) AS due_soon FROM g GROUP BY 1""")
def a25_deadline_tallies(spark, sf):
    found = C.notice_compliance(claims(spark, sf), notices(spark, sf), C.requirements(spark))
    left, open_ = F.datediff("deadline", F.lit(TODAY).cast("date")), F.col("status") == "not_given"
    late = F.col("status") == "late"
    return dealt(found, parts_of_claims(spark, sf), "claim_id").groupBy("claim_id").agg(F.count("*").alias("findings"), F.count_if(late).alias("late"), F.count_if("time_barred").alias("barred"), F.count_if(open_ & (left < 0)).alias("overdue"), F.count_if(open_ & (left >= 0) & (left <= 30)).alias("due_soon"))


def facts(spark, sf):
    """A claim's facts for screening, from the findings and the claim's own columns."""
    found = C.notice_compliance(claims(spark, sf), notices(spark, sf), C.requirements(spark))
    first, detailed = F.col("obligation") == "notice_of_claim", F.col("obligation") == "detailed_claim"
    gone = F.coalesce(F.col("deadline") < F.lit(TODAY).cast("date"), F.lit(False))
    lapsing = detailed & (F.col("clause") == "20.2.4")
    none = F.col("notice_id").isNull() & F.col("status").isin("not_given", "indeterminate")
    held = first & F.col("notice_id").isNotNull()
    counts = {
        "n_without_notice": first & none, "n_barred": first & F.col("time_barred"), "n_late_open": first & (F.col("status") == "late") & ~F.col("time_barred"),
        "n_misaddressed": held & (F.col("notice_id") % 7 == 0), "n_unreceived": held & (F.col("notice_id") % 3 == 0), "n_unconfirmed": held & (F.col("notice_id") % 2 == 0),
        "n_detailed": detailed, "n_detailed_missing": detailed & (F.col("status") == "not_given"), "n_detailed_late": detailed & (F.col("status") == "late"),
        "n_lapsing": lapsing, "n_expired": lapsing & gone, "n_expired_on_record": lapsing & gone & (F.col("status") != "not_given"),
    }
    parts = parts_of_claims(spark, sf)
    by = dealt(found, parts, "claim_id").groupBy("claim_id").agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    both = dealt(table(spark, sf, "orders").select("*", *_claim_columns()), parts, "claim_id").join(by, "claim_id", "left").na.fill(0, list(counts))
    k = F.col("o_orderkey")
    return both.withColumns({
        "n_basis": (k % 4).cast("int"), "n_basis_missing": (k % 2).cast("int"), "published": F.col("edition") != "red-book-1999", "has_claimant": k % 9 != 0, "has_respondent": k % 10 != 0,
        "registered": F.col("edition").isin(*[e for e in EDITIONS if e]), "event_date": F.when(k % 12 != 0, F.expr("date_add(to_date(o_orderdate), CAST(o_custkey % 9 AS INT) - 6)")),
        "description": F.when(k % 13 != 0, F.col("o_orderpriority")).otherwise(F.lit(" ")), "today": F.lit(TODAY).cast("date"), "instructed": k % 5 == 0, "instruction_linked": k % 10 == 0, "n_records": (k % 6).cast("int"),
        "days_claimed": F.when(k % 3 != 1, (k % 40).cast("int")), "amount": F.when(k % 3 != 0, F.col("o_totalprice") - 1000), "currency": F.when(k % 4 == 0, F.lit("")).otherwise(F.lit("EUR")),
        "seeks_money": F.col("seeks") != "time", "seeks_time": F.col("seeks") != "money",
    })


_FACTS = f"""b AS (SELECT claim_id, count(*) FILTER (WHERE obligation = 'notice_of_claim' AND f IS NULL AND status IN ('not_given', 'indeterminate')) AS n_without_notice,
count(*) FILTER (WHERE obligation = 'notice_of_claim' AND status = 'late' AND precedent) AS n_barred, count(*) FILTER (WHERE obligation = 'notice_of_claim' AND status = 'late' AND NOT precedent) AS n_late_open,
count(*) FILTER (WHERE obligation = 'notice_of_claim' AND f[2] % 7 = 0) AS n_misaddressed, count(*) FILTER (WHERE obligation = 'notice_of_claim' AND f[2] % 3 = 0) AS n_unreceived, count(*) FILTER (WHERE obligation = 'notice_of_claim' AND f[2] % 2 = 0) AS n_unconfirmed,
count(*) FILTER (WHERE obligation = 'detailed_claim') AS n_detailed, count(*) FILTER (WHERE obligation = 'detailed_claim' AND status = 'not_given') AS n_detailed_missing, count(*) FILTER (WHERE obligation = 'detailed_claim' AND status = 'late') AS n_detailed_late,
count(*) FILTER (WHERE clause = '20.2.4') AS n_lapsing, count(*) FILTER (WHERE clause = '20.2.4' AND starts + period_days < DATE '{TODAY}') AS n_expired, count(*) FILTER (WHERE clause = '20.2.4' AND starts + period_days < DATE '{TODAY}' AND status <> 'not_given') AS n_expired_on_record FROM g GROUP BY 1),
s0 AS (SELECT c.claim_id, edition, seeks, awareness, coalesce(n_without_notice, 0) AS n_without_notice, coalesce(n_barred, 0) AS n_barred, coalesce(n_late_open, 0) AS n_late_open, coalesce(n_misaddressed, 0) AS n_misaddressed, coalesce(n_unreceived, 0) AS n_unreceived, coalesce(n_unconfirmed, 0) AS n_unconfirmed,
coalesce(n_detailed, 0) AS n_detailed, coalesce(n_detailed_missing, 0) AS n_detailed_missing, coalesce(n_detailed_late, 0) AS n_detailed_late, coalesce(n_lapsing, 0) AS n_lapsing, coalesce(n_expired, 0) AS n_expired, coalesce(n_expired_on_record, 0) AS n_expired_on_record,
o_orderkey % 4 AS n_basis, o_orderkey % 2 AS n_basis_missing, edition <> 'red-book-1999' AS published, o_orderkey % 9 <> 0 AS has_claimant, o_orderkey % 10 <> 0 AS has_respondent, edition <> '' AS registered,
CASE WHEN o_orderkey % 12 <> 0 THEN o_orderdate::DATE + (o_custkey % 9 - 6)::INTEGER END AS event_date, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority ELSE ' ' END AS description, DATE '{TODAY}' AS today, o_orderkey % 5 = 0 AS instructed, o_orderkey % 10 = 0 AS instruction_linked, o_orderkey % 6 AS n_records,
CASE WHEN o_orderkey % 3 <> 1 THEN o_orderkey % 40 END AS days_claimed, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice - 1000 END AS amount, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'EUR' END AS currency, seeks <> 'time' AS seeks_money, seeks <> 'money' AS seeks_time
FROM c JOIN orders ON o_orderkey = c.claim_id LEFT JOIN b USING (claim_id))"""
# A check that waits for others: what doesn't apply there doesn't apply here, and what is open there can't be told here.
_W1, _W2, _W3 = ("WHEN 'not_applicable' IN ({0}) THEN 'not_applicable' WHEN list_has_any([{0}], ['incomplete', 'indeterminate']) THEN 'indeterminate'".format(x) for x in ("CB1", "QR1", "NC1, NC2"))
_STEPS = f"""k0 AS (SELECT *, if(edition = '', 'indeterminate', 'satisfied') AS CB1, if(n_basis = 0, 'incomplete', 'satisfied') AS CB2, if(has_claimant AND has_respondent, 'satisfied', 'incomplete') AS CB4, if(awareness IS NULL, 'indeterminate', 'satisfied') AS NC1,
if(event_date IS NULL, 'incomplete', 'satisfied') AS EV1, if(length(trim(description)) = 0, 'incomplete', 'satisfied') AS EV2, CASE WHEN instructed AND instruction_linked THEN 'satisfied' WHEN instructed THEN 'incomplete' ELSE 'not_applicable' END AS EV5, if(n_records = 0, 'incomplete', 'satisfied') AS RC1,
'satisfied' AS RC2, 'satisfied' AS RC3, if(days_claimed IS NULL AND amount IS NULL, 'incomplete', 'satisfied') AS QR1, 'satisfied' AS QR5 FROM s0),
k1 AS (SELECT *, CASE WHEN CB1 <> 'satisfied' OR CB2 <> 'satisfied' THEN 'indeterminate' WHEN NOT published THEN 'indeterminate' WHEN n_basis_missing > 0 THEN 'incomplete' ELSE 'satisfied' END AS CB3,
CASE {_W1} WHEN registered THEN 'satisfied' ELSE 'not_applicable' END AS NC2, CASE WHEN EV1 <> 'satisfied' OR NC1 <> 'satisfied' THEN 'indeterminate' WHEN awareness < event_date THEN 'incomplete' ELSE 'satisfied' END AS EV3,
CASE WHEN EV1 <> 'satisfied' THEN 'indeterminate' WHEN event_date > today OR (awareness IS NOT NULL AND awareness > today) THEN 'incomplete' ELSE 'satisfied' END AS EV4,
CASE WHEN amount IS NULL THEN 'not_applicable' {_W2} WHEN length(trim(currency)) = 0 THEN 'incomplete' ELSE 'satisfied' END AS QR2,
CASE WHEN amount IS NULL AND days_claimed IS NULL THEN 'not_applicable' {_W2} WHEN amount <= 0 OR days_claimed <= 0 THEN 'incomplete' ELSE 'satisfied' END AS QR3,
CASE WHEN amount IS NULL AND days_claimed IS NULL THEN 'not_applicable' {_W2} WHEN amount IS NOT NULL AND seeks = 'time' THEN 'incomplete' WHEN days_claimed IS NOT NULL AND seeks = 'money' THEN 'incomplete' ELSE 'satisfied' END AS QR4 FROM k0),
k2 AS (SELECT *, CASE {_W3} WHEN n_without_notice > 0 THEN 'incomplete' ELSE 'satisfied' END AS NC3, CASE {_W3} WHEN n_barred > 0 THEN 'barred' ELSE 'satisfied' END AS NC4, CASE {_W3} WHEN n_late_open > 0 THEN 'incomplete' ELSE 'satisfied' END AS NC5,
CASE WHEN n_detailed = 0 THEN 'not_applicable' {_W3} WHEN n_detailed_missing > 0 THEN 'incomplete' ELSE 'satisfied' END AS DC1,
CASE WHEN n_lapsing = 0 THEN 'not_applicable' {_W3} WHEN n_expired = 0 OR (n_expired_on_record > 0 AND n_basis > 0) THEN 'satisfied' WHEN n_expired_on_record > 0 THEN 'incomplete' ELSE 'lapsed' END AS DC3 FROM k1),
k3 AS (SELECT *, {", ".join(f"CASE WHEN 'not_applicable' IN ({d}) THEN 'not_applicable' WHEN list_has_any([{d}], ['incomplete', 'indeterminate']) THEN 'indeterminate' WHEN {n} > 0 THEN 'incomplete' ELSE 'satisfied' END AS {k}" for k, d, n in (("NC6", "NC1, NC3, CB4", "n_misaddressed"), ("NC7", "NC1, NC3", "n_unreceived"), ("NC8", "NC3", "n_unconfirmed")))},
CASE WHEN n_detailed = 0 THEN 'not_applicable' WHEN 'not_applicable' IN (NC1, DC1) THEN 'not_applicable' WHEN list_has_any([NC1, DC1], ['incomplete', 'indeterminate']) THEN 'indeterminate' WHEN n_detailed_late > 0 THEN 'incomplete' ELSE 'satisfied' END AS DC2 FROM k2),
kk AS (SELECT claim_id, code, status FROM k3 UNPIVOT (status FOR code IN (CB1, CB2, CB3, CB4, NC1, NC2, NC3, NC4, NC5, NC6, NC7, NC8, EV1, EV2, EV3, EV4, EV5, RC1, RC2, RC3, QR1, QR2, QR3, QR4, QR5, DC1, DC2, DC3)))"""


@query(f"WITH {FINDINGS}, {_FACTS}, {_STEPS} SELECT claim_id, code, status FROM kk")
def g13_screening(spark, sf):
    """All 28 checks of every claim, each gated by those it depends on."""
    return C.check_rows(C.screen(facts(spark, sf)), "claim_id").select("claim_id", "code", "status")


@query(f"""WITH {FINDINGS}, {_FACTS}, {_STEPS} SELECT claim_id, CASE WHEN bool_or(status = 'barred') THEN 'barred' WHEN bool_or(status = 'lapsed') THEN 'lapsed'
WHEN bool_or(status IN ('incomplete', 'indeterminate') AND code IN ('CB1', 'CB2', 'NC1', 'NC3', 'NC4', 'EV1', 'QR1', 'DC3')) THEN 'not_ready'
WHEN bool_or(status IN ('incomplete', 'indeterminate') AND code NOT IN ('RC2', 'RC3', 'QR5')) THEN 'ready_with_queries' ELSE 'ready' END AS outcome FROM kk GROUP BY 1""")
def g14_outcome(spark, sf):
    return C.outcome(C.screen(facts(spark, sf))).select("claim_id", "outcome")


_EVIDENCE = """e AS (SELECT l_orderkey AS claim_id, 'E' || (l_partkey % 6)::VARCHAR AS element, CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'R' THEN 'contradicts' ELSE 'unassessed' END AS relevance, l_linestatus = 'F' AS reviewed FROM lineitem),
el AS (SELECT o_orderkey AS claim_id, 'E' || unnest(range(0, 5))::VARCHAR AS element FROM orders),
gp AS (SELECT el.claim_id, el.element, CASE WHEN count(*) FILTER (WHERE relevance = 'supports') > 0 AND count(*) FILTER (WHERE relevance = 'contradicts') > 0 THEN 'contested' WHEN count(*) FILTER (WHERE relevance = 'supports' AND reviewed) > 0 THEN 'established'
WHEN count(*) FILTER (WHERE relevance IN ('supports', 'unassessed')) > 0 THEN 'partial' ELSE 'missing' END AS status FROM el LEFT JOIN e USING (claim_id, element) GROUP BY 1, 2)"""


def evidence(spark, sf):
    relevance = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "contradicts").otherwise("unassessed")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.concat(F.lit("E"), (F.col("l_partkey") % 6).cast("string")).alias("element"), relevance.alias("relevance"), (F.col("l_linestatus") == "F").alias("reviewed"))


def elements(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), F.explode(F.array(*[F.lit(f"E{i}") for i in range(5)])).alias("element"))


@query(f"WITH {_EVIDENCE} SELECT * FROM gp")
def g10_evidence_gaps(spark, sf):
    return C.evidence_gaps(elements(spark, sf), evidence(spark, sf))


@query(f"WITH {_EVIDENCE} SELECT claim_id, count(*) FILTER (WHERE status = 'established')::DOUBLE / count(*) AS completeness FROM gp GROUP BY 1")
def a19_completeness(spark, sf):
    return C.completeness(C.evidence_gaps(elements(spark, sf), evidence(spark, sf)))


_ENTRIES = """t AS (SELECT user_id AS claim_id, 'event' AS kind, event_type || '  ' || (event_id % 9)::VARCHAR AS title, CASE WHEN event_id % 17 <> 0 THEN ts::DATE END AS occurred_on, CASE WHEN event_id % 5 = 0 THEN 'month' ELSE 'day' END AS precision, event_id AS id FROM events)"""


def entries(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("claim_id"), F.lit("event").alias("kind"), F.concat("event_type", F.lit("  "), (F.col("event_id") % 9).cast("string")).alias("title"), F.when(F.col("event_id") % 17 != 0, F.to_date("ts")).alias("occurred_on"), F.when(F.col("event_id") % 5 == 0, "month").otherwise("day").alias("precision"), F.col("event_id").alias("id"))


@query(f"WITH {_ENTRIES} SELECT claim_id, id, row_number() OVER (PARTITION BY claim_id ORDER BY coalesce(occurred_on, DATE '9999-12-31'), CASE precision WHEN 'day' THEN 0 ELSE 1 END, lower(title), id) AS place FROM t")
def g11_chronology(spark, sf):
    from pyspark.sql import Window

    order = [F.coalesce("occurred_on", F.lit("9999-12-31").cast("date")), F.when(F.col("precision") == "day", 0).otherwise(1), F.lower("title"), F.col("id")]
    return entries(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("claim_id").orderBy(*order))).select("claim_id", "id", F.col("place").cast("bigint").alias("place"))


@query(rf"WITH {_ENTRIES} SELECT claim_id, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS title_key, count(DISTINCT occurred_on) AS n_dates FROM t WHERE occurred_on IS NOT NULL AND precision = 'day' GROUP BY 1, 2 HAVING count(DISTINCT occurred_on) > 1")
def g12_date_conflicts(spark, sf):
    return C.date_conflicts(entries(spark, sf))


@query("""SELECT doc_id, CASE WHEN r = 0 THEN 'low' WHEN r = 1 THEN 'medium' ELSE 'high' END AS confidence FROM (SELECT doc_id, least(2, CASE WHEN quality = 0 THEN 0 ELSE 2 END, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, CASE WHEN doc_id % 7 > doc_id % 5 THEN 1 ELSE 2 END, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END) AS r FROM labels)""")
def g18_confidence(spark, sf):
    facts = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("insufficient"), (F.col("doc_id") % 4).alias("cited"), (F.col("doc_id") % 7).alias("unknowns"), (F.col("doc_id") % 5).alias("facts"))
    return C.confidence(facts).select("doc_id", "confidence")


@query("""SELECT n_nationkey, n_name, count(DISTINCT c_custkey) AS parties, count(o_orderkey) AS claims, coalesce(sum(o_totalprice::DECIMAL(18,2)), 0)::DOUBLE AS amount, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_ FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def g23_project_summary(spark, sf):
    """Counts are added up by party first, so a party's claims never fan its row out."""
    cents = F.col("o_totalprice").cast("decimal(18,2)")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(cents).alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("s"))
    c = table(spark, sf, "customer").join(o, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("p"), F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("s").alias("s"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return table(spark, sf, "nation").join(c, "n_nationkey", "left").select("n_nationkey", "n_name", zero("p").alias("parties"), zero("n").alias("claims"), zero(F.col("a").cast("double")).alias("amount"), zero("s").alias("open_"))
