"""Queries: registers, sweeps, dashboards, plans and readings of letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import compliance as C
from ..operators import documents as D
from ..operators import relations as R
from ..sources.tables import table
from . import analytics as A
from .registry import query

TODAY = A.TODAY


@query(f"""WITH {A.REQ},
am AS (SELECT DISTINCT p_partkey % 3 AS k FROM part)
SELECT edition, clause, obligation, CASE WHEN edition = 'red-book-2017' AND clause = '20.2.1' THEN 14 ELSE period_days END AS period_days FROM req WHERE clause <> '53.3' UNION ALL SELECT 'red-book-2017', '9.' || k::VARCHAR, 'notice_of_claim', 7 + k FROM am""")
def g03_amendments(spark, sf):
    """A contract's amendments over the standard requirements: one amended, one removed, three added."""
    added = table(spark, sf, "part").select((F.col("p_partkey") % 3).alias("k")).distinct().select(F.lit("red-book-2017").alias("edition"), F.concat(F.lit("9."), F.col("k").cast("string")).alias("clause"), F.lit("notice_of_claim").alias("obligation"), F.lit("add").alias("action"), (F.col("k") + 7).cast("int").alias("period_days"), F.lit(None).cast("boolean").alias("precedent"))
    fixed = spark.createDataFrame([("red-book-2017", "20.2.1", "notice_of_claim", "amend", 14, None), ("red-book-1987", "53.3", "detailed_claim", "remove", None, None)], added.schema)
    return C.amended(C.requirements(spark), added.unionByName(fixed)).select("edition", "clause", "obligation", F.col("period_days").cast("bigint").alias("period_days"))


@query(f"""WITH {A.FINDINGS}, x AS (SELECT n.claim_id, n.notice_id, n.n_clause, min(row(g.clause, g.status)) AS r, count(g.claim_id) AS k FROM n LEFT JOIN g ON g.claim_id = n.claim_id AND g.f[2] = n.notice_id GROUP BY 1, 2, 3)
SELECT claim_id, notice_id, CASE WHEN k > 0 THEN r[2] WHEN n_clause = '' THEN 'unlinked' ELSE 'not_counted' END AS status FROM x""")
def g17_notice_register(spark, sf):
    """Every notice with the finding that it answers, or why it answers none."""
    n = A.notices(spark, sf)
    found = C.notice_compliance(A.claims(spark, sf), n, C.requirements(spark)).where("notice_id IS NOT NULL")
    parts, keys = A.parts_of_claims(spark, sf), ["claim_id", "notice_id"]
    first = R.dealt(found, parts, *keys).groupBy(*keys).agg(F.min(F.struct("clause", "status")).alias("r"))
    status = F.when(F.col("r").isNotNull(), F.col("r.status")).when(F.col("clause") == "", "unlinked").otherwise("not_counted")
    return R.dealt(n, parts, *keys).join(first, keys, "left").select("claim_id", "notice_id", status.alias("status"))


@query(f"""WITH {A.FINDINGS}, d AS (SELECT claim_id, clause, obligation, (starts + period_days)::DATE AS deadline FROM g WHERE status = 'not_given')
SELECT c_custkey AS recipient, 'deadline:' || claim_id::VARCHAR || ':' || clause || ':' || obligation AS dedupe_key, CASE WHEN deadline < DATE '{TODAY}' THEN 'passed' ELSE 'due' END AS kind
FROM d JOIN orders ON o_orderkey = claim_id JOIN customer ON c_custkey = o_custkey WHERE deadline <= DATE '{TODAY}' + 7""")
def g28_deadline_sweep(spark, sf):
    """One notification for each deadline that passed, or falls within a week, with no notice on record."""
    found = C.notice_compliance(A.claims(spark, sf), A.notices(spark, sf), C.requirements(spark)).where("status = 'not_given'")
    today = F.lit(TODAY).cast("date")
    parts = A.parts_of_claims(spark, sf)
    due = R.dealt(found.where(F.col("deadline") <= F.date_add(today, 7)), parts, "claim_id").join(R.dealt(table(spark, sf, "orders"), parts, "o_orderkey").hint("merge"), F.col("o_orderkey") == F.col("claim_id"))
    key = F.concat(F.lit("deadline:"), F.col("claim_id").cast("string"), F.lit(":"), "clause", F.lit(":"), "obligation")
    return due.select(F.col("o_custkey").alias("recipient"), key.alias("dedupe_key"), F.when(F.col("deadline") < today, "passed").otherwise("due").alias("kind"))


# Strands of an analysis, and the kinds of claim that each is for.
STRANDS = [("entitlement", "both"), ("notice", "both"), ("delay", "time"), ("cost", "money"), ("evidence", "both"), ("chronology", "both"), ("counter_arguments", "both")]


@query("""SELECT o_orderkey AS claim_id, s.strand, s.kind = 'both' OR k = 'both' OR s.kind = k AS applies FROM (SELECT o_orderkey, ['both', 'time', 'money'][o_orderkey % 3 + 1] AS k FROM orders), (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in STRANDS) + ") s(strand, kind)")
def g19_strands(spark, sf):
    items = F.array(*[F.struct(F.lit(a).alias("strand"), F.lit(b).alias("kind")) for a, b in STRANDS])
    rows = A.claims(spark, sf).select("claim_id", "seeks", F.inline(items))
    return rows.select("claim_id", "strand", ((F.col("kind") == "both") | (F.col("seeks") == "both") | (F.col("kind") == F.col("seeks"))).alias("applies"))


@query("""WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 'reject' WHEN value > 50 THEN 'amend' ELSE 'accept' END AS action, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 = 0 THEN ' ' ELSE props END AS said FROM events),
v AS (SELECT *, action = 'accept' OR trim(said) <> '' AS valid FROM e), l AS (SELECT user_id, arg_max(action, (ts, event_id)) FILTER (WHERE valid) AS action, count(*) FILTER (WHERE valid) AS reviews, count(*) FILTER (WHERE NOT valid) AS refused FROM v GROUP BY 1)
SELECT user_id, CASE action WHEN 'reject' THEN 'rejected' WHEN 'amend' THEN 'amended' WHEN 'accept' THEN 'accepted' ELSE 'unreviewed' END AS state, reviews, refused FROM l""")
def g21_resolution(spark, sf):
    """The last valid review decides: a rejection needs a reason and an amendment a statement, others are refused."""
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.when(F.col("event_type") == "error", "reject").when(F.col("value") > 50, "amend").otherwise("accept")
    said = F.when(k % 4 == 0, " ").otherwise(F.col("props"))
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", action.alias("action"), ((action == "accept") | (F.trim(said) != "")).alias("valid"))
    last = F.max_by("action", F.when(F.col("valid"), F.struct("ts", "event_id")))
    by = e.groupBy("user_id").agg(last.alias("action"), F.count_if("valid").alias("reviews"), F.count_if(~F.col("valid")).alias("refused"))
    state = F.when(F.col("action") == "reject", "rejected").when(F.col("action") == "amend", "amended").when(F.col("action") == "accept", "accepted").otherwise("unreviewed")
    return by.select("user_id", F.when(F.col("reviews") > 0, state).otherwise("unreviewed").alias("state"), "reviews", "refused")


@query("""SELECT (SELECT count(*) FROM orders) AS claims, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_, (SELECT count(DISTINCT source) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE n_chars < 500) AS weak,
(SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM events WHERE event_type = 'error') AS failures""")
def g22_dashboard(spark, sf):
    """One row of counters: each table is aggregated once, and single rows are put side by side."""
    o = table(spark, sf, "orders").agg(F.count("*").alias("claims"), F.count_if(F.col("o_orderstatus") == "O").alias("open_"))
    d = table(spark, sf, "documents").agg(F.count_distinct("source").alias("documents"), F.count_if(F.col("n_chars") < 500).alias("weak"))
    v = table(spark, sf, "embeddings").agg(F.count("*").alias("vectors"))
    e = table(spark, sf, "events").agg(F.count_if(F.col("event_type") == "error").alias("failures"))
    return o.crossJoin(d).crossJoin(v).crossJoin(e)


@query("""SELECT o_orderkey, c_name, n_name, o_totalprice, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY n_nationkey)::DOUBLE AS project_total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def g24_register(spark, sf):
    """The register's rows with their project's total, which is aggregated on its own and joined back."""
    c = table(spark, sf, "customer").join(R.dimension(table(spark, sf, "nation"), 25), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name", "n_nationkey", "o_totalprice")
    totals = rows.groupBy("n_nationkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("project_total"))
    return rows.join(R.dimension(totals, 25), "n_nationkey").select("o_orderkey", "c_name", "n_name", "o_totalprice", "project_total")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\bnotice\b') THEN 'notice' WHEN regexp_matches(lower(text), 'license|rights reserved') THEN 'legal' WHEN contains(text, '@') THEN 'letter' ELSE 'other' END AS kind,
regexp_extract(text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS dated, regexp_extract(text, '(?i)ref[.:]* *([A-Z0-9/-]{3,})', 1) AS reference FROM documents""")
def g26_letter_reading(spark, sf):
    low = F.lower("text")
    kind = F.when(low.rlike(T.ascii_bounds(r"\bnotice\b")), "notice").when(low.rlike("license|rights reserved"), "legal").when(F.col("text").contains("@"), "letter").otherwise("other")
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"), F.regexp_extract("text", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).alias("dated"), F.regexp_extract("text", "(?i)ref[.:]* *([A-Z0-9/-]{3,})", 1).alias("reference"))


@query("""SELECT p_brand, p_partkey, eligible, place FROM (SELECT *, p_size >= 10 AND p_retailprice < 1700 AS eligible, row_number() OVER (PARTITION BY p_brand ORDER BY NOT (p_size >= 10 AND p_retailprice < 1700), -(0.7::DOUBLE * p_size + 0.3::DOUBLE * (2000 - p_retailprice) / 10), p_name, p_partkey) AS place FROM part) WHERE place <= 3""")
def g29_recommendation(spark, sf):
    """The three best of each family: those that pass the hard gates first, then by weighted score."""
    p = table(spark, sf, "part").withColumn("eligible", (F.col("p_size") >= 10) & (F.col("p_retailprice") < 1700))
    score = 0.7 * F.col("p_size") + 0.3 * (2000 - F.col("p_retailprice")) / 10
    best = R.top_per_key(p, ["p_brand"], [~F.col("eligible"), -score, F.col("p_name"), F.col("p_partkey")], 3)
    return best.select("p_brand", "p_partkey", "eligible", F.col("rank").cast("bigint").alias("place"))


_LINE = """CASE WHEN p_partkey % 4 = 0 THEN 'Clause ' ELSE '' END || (p_size % 20)::VARCHAR || '.' || (p_partkey % 9)::VARCHAR || CASE WHEN p_partkey % 6 = 0 THEN '.1.2' ELSE '' END || ' ' || CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE lower(p_type) END ||
CASE p_partkey % 8 WHEN 1 THEN '.' WHEN 2 THEN ' shall be given' WHEN 3 THEN ' ..... 12' WHEN 4 THEN ' and ' || p_name || ' and ' || p_name || ' and ' || p_name ELSE '' END"""


@query(rf"""WITH l AS (SELECT p_partkey, {_LINE} AS line FROM part UNION ALL SELECT -p_partkey, p_size::VARCHAR || ' days after ' || p_name FROM part),
h AS (SELECT p_partkey, line, regexp_extract(line, '^(?:Clause )?([0-9]+(?:\.[0-9]+)*) (.*)$', 1) AS number, regexp_extract(line, '^(?:Clause )?([0-9]+(?:\.[0-9]+)*) (.*)$', 2) AS title, starts_with(line, 'Clause ') AS keyword FROM l),
w AS (SELECT *, list_filter(regexp_split_to_array(title, '[ \t]+'), lambda x: x <> '') AS words FROM h),
s AS (SELECT *, 0.5 + CASE WHEN keyword THEN 0.25 ELSE 0 END + CASE WHEN length(title) <= 60 THEN 0.15 WHEN length(title) <= 90 THEN 0.05 ELSE -0.2 END - CASE WHEN title[-1] = '.' THEN 0.25 ELSE 0 END + CASE WHEN len(list_filter(words, lambda x: regexp_matches(x, '^[A-ZÀ-ÖØ-Þ]'))) >= 0.7 * len(words) THEN 0.2 WHEN len(list_filter(words, lambda x: regexp_matches(x, '^[A-ZÀ-ÖØ-Þ]'))) >= 0.5 * len(words) THEN 0.1 ELSE -0.1 END
- CASE WHEN contains(' ' || lower(title) || ' ', ' shall ') THEN 0.2 ELSE 0 END - CASE WHEN length(number) - length(replace(number, '.', '')) >= 3 THEN 0.1 ELSE 0 END AS score FROM w)
SELECT p_partkey, number, title, CASE WHEN starts_with(title, 'days') OR contains(line, '.....') THEN 0.0 ELSE greatest(0.0, least(1.0, round(score::DOUBLE, 6))) END::DOUBLE AS confidence FROM s WHERE CASE WHEN starts_with(title, 'days') OR contains(line, '.....') THEN 0.0 ELSE round(score::DOUBLE, 6) END >= 0.55""")
def d03_headings(spark, sf):
    """Lines of clauses that are headings: scored by eight signals, kept from 0.55 on; measures and contents lines never are."""
    part = table(spark, sf, "part")
    k = F.col("p_partkey") % 8
    end = F.when(k == 1, ".").when(k == 2, " shall be given").when(k == 3, " ..... 12").when(k == 4, F.concat(F.lit(" and "), "p_name", F.lit(" and "), "p_name", F.lit(" and "), "p_name")).otherwise("")
    number = F.concat((F.col("p_size") % 20).cast("string"), F.lit("."), (F.col("p_partkey") % 9).cast("string"), F.when(F.col("p_partkey") % 6 == 0, ".1.2").otherwise(""))
    line = F.concat(F.when(F.col("p_partkey") % 4 == 0, "Clause ").otherwise(""), number, F.lit(" "), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.lower("p_type")), end)
    lines = part.select("p_partkey", line.alias("line")).union(part.select(-F.col("p_partkey"), F.concat(F.col("p_size").cast("string"), F.lit(" days after "), "p_name")))
    pattern = r"^(?:Clause )?([0-9]+(?:\.[0-9]+)*) (.*)$"
    read = lines.select("p_partkey", "line", F.regexp_extract("line", pattern, 1).alias("number"), F.regexp_extract("line", pattern, 2).alias("title"))
    score = D.heading_score(F.col("number"), F.col("title"), F.col("line").startswith("Clause "), F.col("line"))
    return read.select("p_partkey", "number", "title", score.alias("confidence")).where("confidence >= 0.55")


@query(r"""SELECT doc_id, number, count(*) AS mentions FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+')) AS number FROM documents) GROUP BY 1, 2""")
def d05_cross_references(spark, sf):
    numbers = F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0)))
    return table(spark, sf, "documents").select("doc_id", numbers.alias("number")).groupBy("doc_id", "number").agg(F.count("*").alias("mentions"))


@query("""SELECT doc_id, first_id, source FROM (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY source, sha256(text)) AS first_id FROM documents) WHERE doc_id <> first_id""")
def d15_duplicate_uploads(spark, sf):
    """Uploads whose content is in their project already."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    first = d.groupBy("source", "hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, ["source", "hash"]).where("doc_id <> first_id").select("doc_id", "first_id", "source")


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: trim(x, ' ') <> '') AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS u, generate_subscripts(l, 1) AS n FROM p),
f AS (SELECT doc_id, 0::BIGINT AS n, '' AS buf, NULL::VARCHAR AS made, 0::BIGINT AS k FROM (SELECT DISTINCT doc_id FROM u) UNION ALL
SELECT f.doc_id, u.n, CASE WHEN f.buf = '' THEN u.u WHEN length(f.buf) + 2 + length(u.u) <= 3500 THEN f.buf || chr(10) || chr(10) || u.u ELSE u.u END, CASE WHEN f.buf <> '' AND length(f.buf) + 2 + length(u.u) > 3500 THEN f.buf END, f.k + CASE WHEN f.buf <> '' AND length(f.buf) + 2 + length(u.u) > 3500 THEN 1 ELSE 0 END FROM f JOIN u ON u.doc_id = f.doc_id AND u.n = f.n + 1),
e AS (SELECT doc_id, k AS page_number, made AS text FROM f WHERE made IS NOT NULL UNION ALL SELECT doc_id, k + 1, buf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM f) WHERE r = 1 AND buf <> '')
SELECT doc_id, page_number::INTEGER AS page_number, text FROM e""")
def d12_pseudo_pages(spark, sf):
    """Whole documents as pages of paragraphs."""
    return D.pack_paragraphs(table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text")), "doc_id")


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'time' WHEN '2-HIGH' THEN 'money' WHEN '3-MEDIUM' THEN 'both' END AS claim_type, ['20.1', '20.2', '44.1'][o_orderkey % 3 + 1] AS clause FROM orders""")
def m13_normalised_types(spark, sf):
    """Synonyms to types, and the clauses in a list that is written in many ways."""
    known = {"1-urgent": "time", "2-high": "money", "3-medium": "both"}
    kind = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.lower("o_orderpriority")]
    said = F.get(F.array(F.lit("clauses 020.1 and 20.1."), F.lit("Sub-Clause 20.2"), F.lit("cl. 44.1, 44.01")), (F.col("o_orderkey") % 3).cast("int"))
    clauses = F.array_distinct(F.transform(F.regexp_extract_all(said, F.lit(r"[0-9]+\.[0-9]+"), F.lit(0)), T.clause_number))
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("claim_type"), F.array_join(clauses, ",").alias("clause"))


@query("""SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS days FROM (SELECT doc_id, list_filter(d, lambda x, i: list_position(d, x) = i) AS list_distinct_ordered FROM (SELECT doc_id, regexp_extract_all('within ' || (doc_id % 90 + 1)::VARCHAR || ' days, or 28 days after; 400 days', '([0-9]+) days', 1)[1:2] AS d FROM documents))""")
def m08_periods(spark, sf):
    """Periods of 1 to 365 days in a text, each once."""
    said = F.concat(F.lit("within "), (F.col("doc_id") % 90 + 1).cast("string"), F.lit(" days, or 28 days after; 400 days"))
    found = F.filter(F.regexp_extract_all(said, F.lit("([0-9]+) days"), F.lit(1)), lambda d: d.cast("int").between(1, 365))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_distinct(found), ",").alias("days"))


@query("""SELECT event_id, ts::DATE AS first_date, 2::BIGINT AS n FROM events""")
def m02_dates_in_text(spark, sf):
    """Every date in a text that mixes two ways of writing them."""
    day = F.to_date("ts")
    said = F.concat(F.lit("on "), F.date_format(day, "yyyy-MM-dd"), F.lit(" and then "), F.date_format(F.date_add(day, 1), "d MMMM yyyy"), F.lit("."))
    dates = F.transform(F.regexp_extract_all(said, F.lit(r"\d{4}-\d{2}-\d{2}|\d{1,2} [A-Z][a-z]+ \d{4}"), F.lit(0)), lambda d: V.parse_date(d))
    return table(spark, sf, "events").select("event_id", F.get(dates, F.lit(0)).alias("first_date"), F.size(F.array_compact(dates)).cast("bigint").alias("n"))


@query("""WITH w AS (SELECT conv_id, turn, role, md5(text) AS h, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS p FROM (SELECT *, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS l FROM conversations WHERE role = 'user')),
f AS (SELECT conv_id, word, min((turn, role, h, p)) AS k FROM w WHERE length(word) > 3 AND word NOT IN ('that', 'with', 'this', 'from') GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS n FROM f)
SELECT conv_id, string_agg(word, ' ' ORDER BY n) AS lexical_query FROM n WHERE n <= 24 GROUP BY 1""")
def r03_lexical_query(spark, sf):
    """A conversation's distinct content words in order, 24 at most: the query's own limit. First places are aggregated, no text is collected."""
    said = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("h"), F.posexplode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("p", "word"))
    words = said.where((F.length("word") > 3) & ~F.col("word").isin("that", "with", "this", "from"))
    first = words.groupBy("conv_id", "word").agg(F.min(F.struct("turn", "role", "h", "p")).alias("at"))
    best = R.top_per_key(first, ["conv_id"], [F.col("at")], 24)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"])
    return best.groupBy("conv_id").agg(F.array_join(listed, " ").alias("lexical_query"))


@query("""SELECT conv_id, turn, kind, sum(CASE WHEN b IS NULL OR b <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM (SELECT *, CASE WHEN role = 'system' THEN 'user' ELSE role END AS kind, lag(CASE WHEN role = 'system' THEN 'user' ELSE role END) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS b FROM conversations)""")
def w11_continuations(spark, sf):
    """Turns glued to the one before while their kinds agree."""
    c = table(spark, sf, "conversations").withColumn("kind", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))
    order, span = ["turn", "role", "text"], F.floor(F.col("turn") / 1000)
    c = R.spanned(c, ["conv_id"], order, span, before={"b": "kind"})
    return R.islands(c, ["conv_id"], order, F.col("b").isNull() | (F.col("b") != F.col("kind")), span, "segment").select("conv_id", "turn", "kind", "segment")
