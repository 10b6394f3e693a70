"""Queries over spans of texts: numbers outside citations, amounts outside dates, amendments of standard periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import amendments as A
from ..operators import spans as S
from ..sources.tables import table
from .registry import query

# What cites a clause, a bare dotted number, a date, an amount.
CITED = r"(?:[Vv]ersion|[Ss]ection|[Cc]lause|[Aa]rticle)\s+\d{1,3}(?:\.\d{1,3}){0,4}\b"
TOKEN, DOTTED = r"[\w.]+", r"\d{1,3}(?:\.\d{1,3}){1,4}"
DATE = r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{4})\b"
AMOUNT = r"\b(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d{2}|\d{4,})\b"


def _places(source: str, key: str, text: str, pattern: str, into: str) -> str:
    """SQL for matches with their places: gaps and matches in turn, lengths summed. Patterns here mean the same in both engines."""
    return f"""{into}_m AS (SELECT row_number() OVER () AS rid, {key}, regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS g FROM {source}),
{into}_u AS (SELECT rid, {key}, unnest(m) AS matched, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM {into}_m),
{into} AS (SELECT {key}, matched, sum(length(gap) + length(matched)) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) - length(matched) AS start FROM {into}_u)"""


@query(f"""WITH {_places('documents', 'doc_id', 'text', TOKEN, 'w')}, {_places('documents', 'doc_id', 'text', CITED, 'k')},
n AS (SELECT * FROM w WHERE regexp_full_match(matched, '{DOTTED}')) SELECT doc_id, start::INTEGER AS start, matched FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = n.doc_id AND k.start < n.start + length(n.matched) AND n.start < k.start + length(k.matched))""")
def j19_bare_numbers(spark, sf):
    """Dotted numbers in texts that no citation covers, with their places."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    numbers = S.spans(d, "doc_id", {"bare": (TOKEN, DOTTED)})
    return S.free_of(numbers, S.spans(d, "doc_id", {"cited": (CITED, None)}), "doc_id").select("doc_id", "start", "matched")


#: Letters made of orders: what is paid, when, in several spellings; years and parts of dates aren't amounts.
_LETTER = "l AS (SELECT o_orderkey, 'Dated ' || CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%d %B %Y') END || ', we paid ' || CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice)::BIGINT::VARCHAR ELSE floor(o_totalprice / 1000)::BIGINT::VARCHAR || ',' || lpad((floor(o_totalprice)::BIGINT % 1000)::VARCHAR, 3, '0') END || ' for order ' || o_orderkey::VARCHAR AS text FROM orders)"


def letters(spark, sf):
    day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "dd MMMM yyyy"))
    whole = F.floor("o_totalprice").cast("bigint")
    grouped = F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"))
    text = F.concat(F.lit("Dated "), day, F.lit(", we paid "), F.when(F.col("o_orderkey") % 2 == 0, whole.cast("string")).otherwise(grouped), F.lit(" for order "), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text"))


@query(f"""WITH {_LETTER}, {_places('l', 'o_orderkey', 'text', AMOUNT, 'a')}, {_places('l', 'o_orderkey', 'text', DATE, 'd')}
SELECT o_orderkey, start::INTEGER AS start, matched FROM a WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.o_orderkey = a.o_orderkey AND d.start < a.start + length(a.matched) AND a.start < d.start + length(d.matched))""")
def t15_amounts_outside_dates(spark, sf):
    """Amounts in letters, whatever their spelling; a date's year is none."""
    text = letters(spark, sf)
    return S.free_of(S.spans(text, "o_orderkey", {"amount": (AMOUNT, None)}), S.spans(text, "o_orderkey", {"date": (DATE, None)}), "o_orderkey").select("o_orderkey", "start", "matched")


@query(f"""WITH {_places('documents', 'doc_id', 'text', TOKEN, 'w')}, {_places('documents', 'doc_id', 'text', CITED, 'k')}
SELECT doc_id, k.matched AS citation, count(*) AS words FROM k JOIN w USING (doc_id) WHERE k.start < w.start + length(w.matched) AND w.start < k.start + length(k.matched) GROUP BY doc_id, k.matched""")
def j19_overlaps(spark, sf):
    """The words that each citation covers: the same interval join, pairs kept."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    met = S.overlapping(S.spans(d, "doc_id", {"word": (TOKEN, None)}), S.spans(d, "doc_id", {"cited": (CITED, None)}), "doc_id")
    return met.groupBy("doc_id", F.col("other_matched").alias("citation")).agg(F.count("*").alias("words"))


# Requirements of two editions, as (clause, obligation, days, clause of the consequence).
REQUIREMENTS = [("20.1", "notice_of_claim", 28, "53.4"), ("20.1", "detailed_claim", 42, None), ("53.1", "notice_of_claim", 28, "53.4"), ("44.2", "detailed_account", 28, None)]
_REQS = ", ".join(f"('{c}', '{o}', {d}, {repr(x) if x else 'NULL'})" for c, o, d, x in REQUIREMENTS)
_PASSAGES = """p AS (SELECT p_partkey AS passage_id, CASE WHEN p_size % 3 = 0 THEN '20.1' ELSE '' END AS clause_number, p_partkey % 3 <> 0 AS amending, CASE p_partkey % 5 WHEN 0 THEN 'Notice of claim: delete 28 days and substitute ' || p_size::VARCHAR || ' days in Sub-Clause 20.1.'
WHEN 1 THEN 'Claims under Clause 53.1: within ' || p_size::VARCHAR || ' working days (' || p_name || ').' WHEN 2 THEN 'Particular conditions. Clause 53.4, ' || repeat(p_type || ' ', p_size % 9) || ', is deleted in its entirety.' WHEN 3 THEN 'The account under Sub-Clause 44.2 is deleted. ' || p_name
ELSE 'Notices under Clause 20.1 are given within 42 days, or twenty-one (21) days for ' || p_name END AS text FROM part)"""
_LOWER = lambda p: "(?i)" + p
_DAYS = "CASE regexp_extract(lower(matched), '^([0-9]+|[a-z-]+)', 1) " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in A.NUMBERS.items()) + " ELSE try_cast(regexp_extract(lower(matched), '^([0-9]+)', 1) AS INTEGER) END"
_READ = f"""q(clause, obligation, period_days, consequence) AS (VALUES {_REQS}), {_PASSAGES}, t AS (SELECT * FROM p WHERE regexp_matches(text, '{A.TOPIC}')), {_places('t', 'passage_id', 'text', _LOWER(A.PERIOD), 'per')}, {_places('t', 'passage_id', 'text', _LOWER(A.CLAUSE), 'cl')}, {_places('t', 'passage_id', 'text', _LOWER(A.DELETED), 'del')},
d AS (SELECT passage_id, start, {_DAYS} AS days, regexp_matches(lower(matched), 'working|business') AS working FROM per), dd AS (SELECT * FROM d WHERE days BETWEEN 1 AND 365),
c AS (SELECT DISTINCT passage_id, regexp_extract(matched, '([0-9]+([.][0-9]+)*)$', 1) AS clause FROM cl), about AS (SELECT passage_id, clause FROM c JOIN t USING (passage_id) WHERE amending UNION SELECT passage_id, trim(clause_number) FROM t WHERE trim(clause_number) <> '')"""


def contract_passages(spark, sf):
    k, size, name = F.col("p_partkey") % 5, F.col("p_size").cast("string"), F.col("p_name")
    text = (
        F.when(k == 0, F.concat(F.lit("Notice of claim: delete 28 days and substitute "), size, F.lit(" days in Sub-Clause 20.1.")))
        .when(k == 1, F.concat(F.lit("Claims under Clause 53.1: within "), size, F.lit(" working days ("), name, F.lit(").")))
        .when(k == 2, F.concat(F.lit("Particular conditions. Clause 53.4, "), F.expr("repeat(concat(p_type, ' '), p_size % 9)"), F.lit(", is deleted in its entirety.")))
        .when(k == 3, F.concat(F.lit("The account under Sub-Clause 44.2 is deleted. "), name))
        .otherwise(F.concat(F.lit("Notices under Clause 20.1 are given within 42 days, or twenty-one (21) days for "), name))
    )
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("passage_id"), F.when(F.col("p_size") % 3 == 0, "20.1").otherwise("").alias("clause_number"), (F.col("p_partkey") % 3 != 0).alias("amending"), text.alias("text"))
    return p, spark.createDataFrame(REQUIREMENTS, "clause string, obligation string, period_days int, consequence_clause string")


@query(f"""WITH {_READ}, s AS (SELECT clause, list(DISTINCT period_days) AS standard, count(*) AS n, arg_min(obligation, (obligation <> 'notice_of_claim', obligation)) AS ob, arg_min(period_days, (obligation <> 'notice_of_claim', obligation)) AS sd FROM q GROUP BY 1),
ch AS (SELECT passage_id, clause, days, working, start, standard, n, ob, sd FROM about JOIN s USING (clause) JOIN dd USING (passage_id) WHERE working OR NOT list_contains(standard, days)),
m AS (SELECT ch.passage_id, ch.clause, ch.start, arg_max(obligation, (b.start, obligation)) AS mo, arg_max(period_days, (b.start, obligation)) AS md FROM ch JOIN dd b ON b.passage_id = ch.passage_id AND b.start < ch.start AND b.start >= ch.start - 160 JOIN q ON q.clause = ch.clause AND q.period_days = b.days GROUP BY 1, 2, 3)
SELECT passage_id, clause, coalesce(mo, ob) AS obligation, coalesce(md, sd) AS standard_days, days, working, start::INTEGER AS start, mo IS NULL AND n > 1 AS unsure FROM ch LEFT JOIN m USING (passage_id, clause, start) WHERE NOT (list_contains(standard, days) AND coalesce(md, sd) <> days)""")
def g08_amended_periods(spark, sf):
    """Periods in passages that differ from the standard ones, and which requirement each changes."""
    return A.amended_periods(*contract_passages(spark, sf))


@query(f"""WITH {_READ} SELECT t.passage_id, q.clause, obligation FROM t JOIN c USING (passage_id) JOIN q USING (clause) WHERE amending AND passage_id IN (SELECT passage_id FROM del) AND passage_id NOT IN (SELECT passage_id FROM dd)""")
def g08_removed_clauses(spark, sf):
    """Amending passages that delete a clause."""
    return A.removed_clauses(*contract_passages(spark, sf))


@query(f"""WITH q(clause, obligation, period_days, consequence) AS (VALUES {_REQS}), {_PASSAGES}, t AS (SELECT passage_id, trim(regexp_replace(text, '[[:space:]]+', ' ', 'g')) AS text FROM p WHERE amending), {_places('t', 'passage_id', 'text', '[0-9.]*[0-9]', 'nu')}, {_places('t', 'passage_id', 'text', _LOWER(A.DELETED), 'del')}
SELECT passage_id, clause, obligation, consequence AS consequence_clause, min(nu.start)::INTEGER AS start FROM nu JOIN q ON nu.matched = consequence JOIN del USING (passage_id) WHERE del.start >= nu.start + length(nu.matched) AND del.start <= nu.start + length(nu.matched) + 120 GROUP BY 1, 2, 3, 4""")
def g09_deleted_consequences(spark, sf):
    """Passages that delete the clause which states what follows from lateness; words of deletion that stand too far off don't count."""
    return A.deleted_consequences(*contract_passages(spark, sf))


@query(f"""WITH {_READ} SELECT DISTINCT t.passage_id, q.clause, obligation FROM t JOIN c USING (passage_id) JOIN q USING (clause) WHERE amending AND passage_id IN (SELECT passage_id FROM del) AND passage_id NOT IN (SELECT passage_id FROM dd) AND passage_id % 4 <> 0""")
def g08_unrecorded(spark, sf):
    """Removals that nobody has recorded yet: every fourth passage's is, whatever was decided about it."""
    found = A.removed_clauses(*contract_passages(spark, sf))
    return A.unrecorded(found, found.where("passage_id % 4 = 0"), ["passage_id", "clause", "obligation"]).distinct()
