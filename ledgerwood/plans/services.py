"""Queries: what a claims service lists and writes. Orders stand for claims, parts for chunks of standard forms (a brand is a base)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ascii_bounds
from ..operators import relations as R
from ..operators import services as S
from ..sources.tables import table
from . import analytics as A
from .registry import query

NOW = "1997-06-30 00:00:00"


def _dated(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.lit(None).cast("timestamp").alias("deleted_at"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0 THEN TIMESTAMP '1997-06-30' END IS NOT NULL AS gone FROM orders WHERE o_orderkey % 35 <> 0""")
def k07_soft_delete(spark, sf):
    """Rows are deleted softly, some restored, and a few deleted for good."""
    k = F.col("o_orderkey")
    gone = S.soft_deleted(_dated(spark, sf), k % 7 == 0, F.lit(NOW).cast("timestamp"))
    return S.hard_deleted(S.restored(gone, k % 21 == 0), k % 35 == 0).select("o_orderkey", F.col("deleted_at").isNotNull().alias("gone"))


@query(r"""SELECT doc_id, list_distinct(regexp_extract_all(regexp_replace(text, '(?i)\b(version|by|by-nc|v)\s+[0-9]+(\.[0-9]+)*', ' ', 'g'), '\b[0-9]{1,3}(?:\.[0-9]{1,3})+\b')) AS free FROM documents
WHERE len(regexp_extract_all(regexp_replace(text, '(?i)\b(version|by|by-nc|v)\s+[0-9]+(\.[0-9]+)*', ' ', 'g'), '\b[0-9]{1,3}(?:\.[0-9]{1,3})+\b')) > 0""")
def j19_free_numbers(spark, sf):
    """Dotted numbers outside the spans that a keyword claims: the spans are blanked, so nothing within them is found."""
    rest = F.regexp_replace("text", ascii_bounds(r"(?i)\b(version|by|by-nc|v)\s+[0-9]+(\.[0-9]+)*"), " ")
    free = F.array_distinct(F.regexp_extract_all(rest, F.lit(ascii_bounds(r"\b[0-9]{1,3}(?:\.[0-9]{1,3})+\b")), F.lit(0)))
    return table(spark, sf, "documents").select("doc_id", free.alias("free")).where(F.size("free") > 0)


def bases(spark, sf):
    status = F.get(F.array(*[F.lit(x) for x in ("ready", "draft", "building")]), (F.min("p_partkey") % 3).cast("int"))
    return table(spark, sf, "part").groupBy("p_brand").agg(status.alias("status"), F.count("*").alias("chunks"), F.count_if(F.col("p_size") % 11 == 0).alias("quarantined"))


_BASES = "b AS (SELECT p_brand, ['ready', 'draft', 'building'][min(p_partkey) % 3 + 1] AS status, count(*) AS chunks, count(*) FILTER (WHERE p_size % 11 = 0) AS quarantined FROM part GROUP BY 1)"


@query(f"WITH {_BASES} SELECT p_brand, status, quarantined * 10 <= chunks AS publishable, CASE WHEN status = 'ready' AND quarantined * 10 <= chunks THEN 'published' ELSE status END AS status_after FROM b")
def d24_publish_gate(spark, sf):
    return S.publishable(bases(spark, sf)).select("p_brand", "status", "publishable", "status_after")


@query("""WITH k AS (SELECT 'no_text' AS code, 'error' AS level, count(*) FILTER (WHERE text IS NULL OR length(text) = 0) AS hits FROM documents UNION ALL SELECT 'unknown_language', 'error', count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr', 'es')) FROM documents
UNION ALL SELECT 'short', 'warning', count(*) FILTER (WHERE n_chars < 100) FROM documents UNION ALL SELECT 'copies', 'warning', count(*) FROM (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1))
SELECT *, (SELECT count(*) FROM k WHERE level = 'error' AND hits > 0) = 0 AS can_proceed FROM k""")
def d27_import_plan(spark, sf):
    d = table(spark, sf, "documents")
    return S.planned({
        "no_text": ("error", d.where("text IS NULL OR text = ''")), "unknown_language": ("error", d.where("lang NOT IN ('en', 'de', 'fr', 'es')")), "short": ("warning", d.where("n_chars < 100")),
        "copies": ("warning", d.groupBy(F.md5("text")).count().where("count > 1")),
    })


@query(f"""WITH {A.FINDINGS}, {A._EVIDENCE} SELECT claim_id, 'event' AS part, 'awareness' AS item, CASE WHEN awareness IS NULL THEN 'missing' ELSE 'done' END AS status FROM c
UNION ALL SELECT claim_id, 'notice', clause || '/' || obligation, CASE status WHEN 'compliant' THEN 'done' WHEN 'late' THEN 'late' WHEN 'not_given' THEN 'missing' ELSE 'unclear' END FROM g
UNION ALL SELECT o_orderkey, 'claim', 'amount', CASE WHEN o_totalprice > 1000 THEN 'done' ELSE 'missing' END FROM orders
UNION ALL SELECT claim_id, 'evidence', element, CASE status WHEN 'established' THEN 'done' WHEN 'missing' THEN 'missing' ELSE 'unclear' END FROM gp""")
def g16_checklist(spark, sf):
    """What a claim has and still needs: its event, notices, claim and evidence, a row each."""
    from ..operators import compliance as C

    claims = A.claims(spark, sf)
    state = lambda done, missing: F.when(F.col("status") == done, "done").when(F.col("status") == "late", "late").when(F.col("status") == missing, "missing").otherwise("unclear")
    row = lambda df, part, item, status: df.select("claim_id", F.lit(part).alias("part"), item.alias("item"), status.alias("status"))
    event = row(claims, "event", F.lit("awareness"), F.when(F.col("awareness").isNull(), "missing").otherwise("done"))
    notices = row(C.notice_compliance(claims, A.notices(spark, sf), C.requirements(spark)), "notice", F.concat("clause", F.lit("/"), "obligation"), state("compliant", "not_given"))
    claim = row(table(spark, sf, "orders").withColumn("claim_id", F.col("o_orderkey")), "claim", F.lit("amount"), F.when(F.col("o_totalprice") > 1000, "done").otherwise("missing"))
    evidence = row(C.evidence_gaps(A.elements(spark, sf), A.evidence(spark, sf)), "evidence", F.col("element"), state("established", "missing"))
    return event.union(notices).union(claim).union(evidence)


# A few document types with their categories.
TYPES = [("letter", "correspondence"), ("email", "correspondence"), ("notice", "correspondence"), ("daily_report", "records"), ("photograph", "records"), ("invoice", "payment"), ("amendment", "contract"), ("standard_form", "contract")]


@query("""SELECT code, category FROM (VALUES ('letter', 'correspondence'), ('email', 'correspondence'), ('notice', 'correspondence'), ('daily_report', 'records'), ('photograph', 'records'), ('invoice', 'payment'), ('amendment', 'contract'), ('standard_form', 'contract')) t(code, category)
UNION ALL SELECT DISTINCT source, 'own' FROM documents WHERE source <> 'letter'""")
def g31_registries(spark, sf):
    """The registry of document types with those registered at run time; a code that is taken keeps its entry."""
    own = table(spark, sf, "documents").where("source IS NOT NULL").select(F.col("source").alias("code"), F.lit("own").alias("category"))
    return S.registered(spark.createDataFrame(TYPES, "code string, category string"), own.unionByName(spark.createDataFrame([("letter", "own")], own.schema)))


@query("SELECT conv_id, turn, length(text) AS n_chars FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 25 OFFSET 25")
def v01_question_history(spark, sf):
    """The second page of questions, newest first."""
    q = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.length("text").cast("bigint").alias("n_chars"))
    return R.page_of(q, [F.desc("conv_id"), F.desc("turn")], 2)


@query("""SELECT 'project' AS mode, count(*) AS chunks FROM documents WHERE source = 'src6' UNION ALL SELECT 'project_and_form', count(*) FROM documents WHERE source = 'src6' OR lang = 'de' UNION ALL SELECT 'form', count(*) FROM documents WHERE lang = 'de'""")
def v02_ask_scope(spark, sf):
    """What a question may read: a project, with or without its standard form, or the form alone. One scan counts all."""
    project, form = F.col("source") == "src6", F.col("lang") == "de"
    counts = table(spark, sf, "documents").agg(F.count_if(project).alias("a"), F.count_if(project | form).alias("b"), F.count_if(form).alias("c"))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(c).alias("chunks")) for m, c in (("project", "a"), ("project_and_form", "b"), ("form", "c"))])))


@query("""SELECT * FROM (SELECT 'ingestion' AS kind, event_id, user_id FROM events WHERE event_type IN ('view', 'click') ORDER BY ts DESC, event_id LIMIT 50) UNION ALL SELECT * FROM (SELECT 'analysis', event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 25)""")
def v03_job_monitor(spark, sf):
    """The last 50 jobs of one kind and the last 25 of another."""
    e = table(spark, sf, "events")
    last = lambda kind, types, n: e.where(F.col("event_type").isin(*types)).orderBy(F.desc("ts"), "event_id").limit(n).select(F.lit(kind).alias("kind"), "event_id", "user_id")
    return last("ingestion", ["view", "click"], 50).union(last("analysis", ["purchase"], 25))


@query("""SELECT c_custkey, c_name, count(DISTINCT o_orderkey % 50) AS projects FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE contains(lower(c_name), '1') OR contains(lower(c_mktsegment), 'build') GROUP BY 1, 2""")
def v05_user_listing(spark, sf):
    """Members that a search finds, with their numbers of projects."""
    found = table(spark, sf, "customer").where(F.lower("c_name").contains("1") | F.lower("c_mktsegment").contains("build")).select("c_custkey", "c_name")
    projects = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct(F.col("o_orderkey") % 50).alias("projects"))
    return found.join(projects, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("projects", F.lit(0)).alias("projects"))


@query(f"WITH {_BASES} SELECT p_brand, status, chunks, chunks - quarantined AS usable, round(100.0 * quarantined / chunks, 2)::DOUBLE AS quarantined_percent FROM b")
def v06_kb_summary(spark, sf):
    b = bases(spark, sf)
    return b.select("p_brand", "status", "chunks", (F.col("chunks") - F.col("quarantined")).alias("usable"), F.round(100.0 * F.col("quarantined") / F.col("chunks"), 2).alias("quarantined_percent"))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#1' AND p_size % 11 <> 0 AND p_size BETWEEN 5 AND 30 ORDER BY p_size, p_partkey LIMIT 25")
def v07_chunk_browser(spark, sf):
    """A page of one base's chunks that aren't quarantined."""
    p = table(spark, sf, "part").where("p_brand = 'Brand#1' AND p_size % 11 <> 0 AND p_size BETWEEN 5 AND 30")
    return R.page_of(p, [F.col("p_size"), F.col("p_partkey")], 1).select("p_partkey", "p_name")


@query("""SELECT p_brand, p_size AS clause, min(p_name) OVER w AS title, min(p_partkey) OVER w AS first_page, count(*) OVER w AS pieces, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS place, p_partkey FROM part WINDOW w AS (PARTITION BY p_brand, p_size)""")
def v08_clause_index(spark, sf):
    """Each clause's title, first page and number of pieces, with its pieces in sequence, one a row: a list would grow with the clause."""
    p = table(spark, sf, "part").select("p_brand", F.col("p_size").alias("clause"), "p_name", "p_partkey", F.concat_ws(":", "p_brand", F.col("p_size").cast("string")).alias("key"))
    by = p.groupBy("p_brand", "clause").agg(F.min("p_name").alias("title"), F.min("p_partkey").alias("first_page"), F.count("*").alias("pieces"))
    placed = R.numbered(p, "key", "p_partkey", "place")
    return placed.join(by, ["p_brand", "clause"]).select("p_brand", "clause", "title", "first_page", "pieces", F.col("place").cast("bigint").alias("place"), "p_partkey")


@query("SELECT md5(text) AS hash, count(*) AS files, count(DISTINCT source) AS bases, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def v09_same_file_elsewhere(spark, sf):
    """Files that stand under more than one base: a new base is refused for them."""
    by = table(spark, sf, "documents").where("text IS NOT NULL").groupBy(F.md5("text").alias("hash"))
    return by.agg(F.count("*").alias("files"), F.count_distinct("source").alias("bases"), F.min("doc_id").alias("first_id")).where("bases > 1")


@query(f"""WITH {A.REQ}, e AS (SELECT edition, count(*) AS requirements, string_agg(DISTINCT clause, ',' ORDER BY clause) AS topics FROM req GROUP BY 1), u AS (SELECT c.edition, count(*) AS claims FROM ({A._CLAIMS[A._CLAIMS.index("(") + 1 : -1]}) c GROUP BY 1)
SELECT edition, requirements, topics, coalesce(claims, 0) AS claims FROM e LEFT JOIN u USING (edition)""")
def v10_edition_catalogue(spark, sf):
    """Editions with their clauses and how many claims are under them."""
    from ..operators import compliance as C

    topics = F.array_join(F.sort_array(F.collect_set("clause")), ",")
    editions = C.requirements(spark).groupBy("edition").agg(F.count("*").alias("requirements"), topics.alias("topics"))
    used = A.claims(spark, sf).groupBy("edition").agg(F.count("*").alias("claims"))
    return editions.join(used, "edition", "left").na.fill(0, ["claims"])


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source IN ('src4', 'src6', 'src10') AND lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 25")
def v11_document_listing(spark, sf):
    """The first page of a project's documents that the caller may read, longest first."""
    access = spark.createDataFrame([("src4",), ("src6",), ("src10",)], "source string")
    d = R.facets(R.visible(table(spark, sf, "documents"), access, "source"), {"lang": "en"}, ["lang"])
    return R.page_of(d.select("doc_id", "lang", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 1)


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage, arg_max((props::JSON ->> 'k')::INTEGER, (ts, event_id)) AS detail, max(ts) AS at FROM events GROUP BY 1""")
def v12_processing_status(spark, sf):
    """The latest job of each document with its detail."""
    newest = F.max_by(F.struct("event_type", "props", "ts"), F.struct("ts", "event_id"))
    e = table(spark, sf, "events").groupBy("user_id").agg(newest.alias("r"))
    return e.select("user_id", F.col("r.event_type").alias("stage"), F.get_json_object("r.props", "$.k").cast("int").alias("detail"), F.col("r.ts").alias("at"))


@query("SELECT l_orderkey AS claim_id, l_linenumber AS item, p_name AS title, o_orderstatus AS issue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'N' AND o_orderstatus <> 'P'")
def v20_evidence_items(spark, sf):
    """Live evidence of claims with its issue and document."""
    lines = table(spark, sf, "lineitem").where("l_returnflag <> 'N'")
    live = lines.join(table(spark, sf, "orders").where("o_orderstatus <> 'P'"), F.col("o_orderkey") == F.col("l_orderkey"))
    return live.join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("item"), F.col("p_name").alias("title"), F.col("o_orderstatus").alias("issue"))


@query("""SELECT doc_id AS finding_id, 'accept' AS action FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, ['accept', 'reject', 'amend', 'drop'][doc_id % 4 + 1] FROM labels WHERE doc_id % 5 <> 0 AND doc_id % 4 <> 3 AND (doc_id % 4 <> 1 OR doc_id % 3 = 0) AND (doc_id % 4 <> 2 OR doc_id % 7 = 0)""")
def v21_review_write(spark, sf):
    """Reviews with the valid ones of new reviews: a rejection needs a reason, an amendment its wording, all a reviewer."""
    base = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("finding_id"), F.lit("accept").alias("action"), F.lit("").alias("reason"), F.lit("").alias("amended_statement"), F.lit(1).cast("bigint").alias("reviewer_id"))
    k = F.col("doc_id")
    action = F.get(F.array(*[F.lit(x) for x in ("accept", "reject", "amend", "drop")]), (k % 4).cast("int"))
    new = table(spark, sf, "labels").select(k.alias("finding_id"), action.alias("action"), F.when(k % 3 == 0, "because").otherwise(" ").alias("reason"), F.when(k % 7 == 0, "better").alias("amended_statement"), F.when(k % 5 != 0, k).alias("reviewer_id"))
    return S.reviewed(base, new).select("finding_id", "action")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey % 10 = 0 THEN 1000 + o_custkey ELSE l_suppkey END AS project FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def v22_move_claim(spark, sf):
    """Evidence follows its claim to another project."""
    children = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), "l_linenumber", F.col("l_suppkey").alias("project"))
    moves = table(spark, sf, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("claim_id"), (F.col("o_custkey") + 1000).alias("destination"))
    return S.moved(children, moves, "claim_id", "project").select(F.col("claim_id").alias("l_orderkey"), "l_linenumber", "project")


@query("SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 4 = 0 THEN 'notice' ELSE 'letter' END AS role FROM orders WHERE o_orderkey % 6 <> 0 AND (o_orderkey % 4 = 0 OR o_orderkey % 2 = 1)")
def v23_attach_detach(spark, sf):
    """Files are attached with a role, some anew with another, and some detached."""
    o = table(spark, sf, "orders")
    link = lambda hit, role: o.where(hit).select(F.col("o_orderkey").alias("claim_id"), F.lit(role).alias("role"))
    links = S.attached(link("o_orderkey % 2 = 1 OR o_orderkey % 8 = 0", "letter"), link("o_orderkey % 4 = 0", "notice"), ["claim_id"])
    return S.detached(links, link("o_orderkey % 6 = 0", ""), ["claim_id"])


@query("""SELECT o_orderkey, coalesce(n, 0) AS files, coalesce(notice, false) AS has_notice, coalesce(e, 0) AS evidence FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = o_orderkey
LEFT JOIN (SELECT l_orderkey AS k2, true AS notice FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) ON k2 = o_orderkey LEFT JOIN (SELECT l_orderkey AS k3, count(*) AS e FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON k3 = o_orderkey""")
def v24_file_listing(spark, sf):
    """A claim's files with notice and evidence flags: the three sides are one pass over the lines."""
    by = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("files"), F.max(F.col("l_linestatus") == "O").alias("has_notice"), F.count_if(F.col("l_returnflag") == "A").alias("evidence"))
    both = table(spark, sf, "orders").join(by, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return both.select("o_orderkey", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("has_notice", F.lit(False)).alias("has_notice"), F.coalesce("evidence", F.lit(0)).alias("evidence"))


@query("SELECT o_orderkey AS notice_id, CASE WHEN o_orderkey % 3 = 0 THEN 'linked' ELSE 'letter' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS claim_id FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def v25_save_notice(spark, sf):
    """Letters saved as notices of claims: a saved one replaces the letter under its key."""
    row = lambda hit, kind, claim: table(spark, sf, "orders").where(hit).select(F.col("o_orderkey").alias("notice_id"), F.lit(kind).alias("kind"), claim.cast("bigint").alias("claim_id"))
    return R.upsert(row("o_orderkey % 5 = 0", "letter", F.lit(None)), row("o_orderkey % 3 = 0", "linked", F.col("o_custkey")), ["notice_id"])


@query("""SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'claim' WHEN role = 'user' THEN 'notice' ELSE 'evidence' END AS becomes, count(*) AS pieces, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1, 2, 3""")
def v26_apply_bundle(spark, sf):
    """A bundle's segments become a claim, its notices and its evidence."""
    kind = F.when(F.col("turn") == 0, "claim").when(F.col("role") == "user", "notice").otherwise("evidence")
    return table(spark, sf, "conversations").groupBy("conv_id", "turn", kind.alias("becomes")).agg(F.count("*").alias("pieces"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT c_nationkey AS project, c_custkey AS recipient FROM customer WHERE c_custkey % 4 IN (0, 1) AND c_acctbal >= 0""")
def v29_recipients(spark, sf):
    """Active members of a project whose role may approve."""
    from .more_relations import ROLES

    role = F.get(F.array(*[F.lit(r) for r in ("owner", "reviewer", "viewer", "stranger")]), (F.col("c_custkey") % 4).cast("int"))
    may = [r for r, permissions in ROLES.items() if "approve" in permissions]
    return table(spark, sf, "customer").where(role.isin(*may) & (F.col("c_acctbal") >= 0)).select(F.col("c_nationkey").alias("project"), F.col("c_custkey").alias("recipient"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey % 10 = 3 AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def v32_report_list(spark, sf):
    o = R.facets(table(spark, sf, "orders").where("o_custkey % 10 = 3"), {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT"]}, ["o_orderstatus", "o_orderpriority"])
    return R.page_of(o, [F.desc("o_orderdate"), F.col("o_orderkey")], 1).select("o_orderkey", "o_totalprice")


@query("""SELECT doc_id, declared, CASE WHEN declared = '' THEN true WHEN declared LIKE 'text/%' THEN true ELSE false END AS compatible FROM (SELECT doc_id, ['text/plain', 'application/pdf', '', 'text/csv; charset=utf-8', 'x/y'][doc_id % 5 + 1] AS declared FROM documents)""")
def m25_mime(spark, sf):
    """Declared types of files that are all text."""
    declared = F.get(F.array(*[F.lit(x) for x in ("text/plain", "application/pdf", "", "text/csv; charset=utf-8", "x/y")]), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf, "documents").select("doc_id", declared.alias("declared")).withColumn("compatible", S.compatible(F.col("declared"), F.lit("text")))


@query("""SELECT event_id, CASE WHEN props IS NULL OR event_type = 'error' THEN NULL ELSE 'Event ' || event_id::VARCHAR || ' of ' || user_id::VARCHAR || ': ' || event_type || ' (' || props || ').' END AS prompt FROM events""")
def t26_prompt(spark, sf):
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    return table(spark, sf, "events").select("event_id", S.rendered("Event {number} of {user}: {kind} ({props}).", {"number": F.col("event_id"), "user": F.col("user_id"), "kind": kind, "props": F.col("props")}).alias("prompt"))


@query("""WITH p AS (SELECT event_id, props, value, (props::JSON ->> 'k')::INTEGER AS k FROM events) SELECT event_id, k AS days, k IS NOT NULL AND contains(props, k::VARCHAR) AS verified, CASE WHEN value >= 0 THEN round(value, 2) END AS amount FROM p""")
def m24_draft_fields(spark, sf):
    """Typed fields of a JSON answer, each verified by its own words in the source."""
    got = F.from_json("props", "k int")
    e = table(spark, sf, "events").select("event_id", "props", "value", got["k"].alias("days"))
    held = F.col("days").isNotNull() & F.col("props").contains(F.col("days").cast("string"))
    return e.select("event_id", "days", F.coalesce(held, F.lit(False)).alias("verified"), F.when(F.col("value") >= 0, F.round("value", 2)).alias("amount"))


@query("""WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), s(source, lang) AS (VALUES ('src6', 'en'), ('src6', 'xx'), ('none', 'en'), ('none', 'xx'))
SELECT s.source, s.lang, CASE WHEN (SELECT coalesce(sum(n), 0) FROM n WHERE n.source = s.source) = 0 AND (SELECT coalesce(sum(n), 0) FROM n WHERE n.lang = s.lang) = 0 THEN 'no documents; no base' WHEN (SELECT coalesce(sum(n), 0) FROM n WHERE n.source = s.source) = 0 THEN 'no documents'
WHEN (SELECT coalesce(sum(n), 0) FROM n WHERE n.lang = s.lang) = 0 THEN 'no base' ELSE 'nothing matched' END AS why FROM s""")
def r17_empty_explanation(spark, sf):
    """Why a scope finds nothing: nothing is indexed for it, every gap named, or nothing matched."""
    scopes = spark.createDataFrame([("src6", "en"), ("src6", "xx"), ("none", "en"), ("none", "xx")], "source string, lang string")
    d = table(spark, sf, "documents")
    own, base = d.groupBy("source").agg(F.count("*").alias("own")), d.groupBy("lang").agg(F.count("*").alias("base"))
    gaps = F.array_join(F.array_compact(F.array(F.when(F.col("own").isNull(), "no documents"), F.when(F.col("base").isNull(), "no base"))), "; ")
    return scopes.join(own, "source", "left").join(base, "lang", "left").select("source", "lang", F.when(gaps == "", "nothing matched").otherwise(gaps).alias("why"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN substring(p_type, 3, 5) ELSE 'zz ' || p_type END AS quote, l_partkey % 20 = 0 AS unknown, p_type, p_size % 25 = 0 AS other FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, CASE WHEN bool_or(unknown) THEN 'unknown_reference' WHEN bool_or(quote IS NOT NULL AND NOT contains(lower(p_type), lower(quote))) THEN 'unsupported_quotation' WHEN bool_or(other) THEN 'edition_mismatch' ELSE 'grounded' END AS result,
count(*) AS citations, count(*) FILTER (WHERE NOT unknown AND quote IS NOT NULL AND contains(lower(p_type), lower(quote))) AS verified FROM c GROUP BY 1""")
def r20_grounding(spark, sf):
    """Each finding's worst fault, in order: an unknown source, a quotation that its source hasn't, another edition."""
    n = F.col("l_linenumber") % 3
    cited = table(spark, sf, "lineitem").withColumn("ref", F.when(F.col("l_partkey") % 20 != 0, F.col("l_partkey")))
    both = cited.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("quote", F.when(n == 1, F.substring("p_type", 3, 5)).when(n == 2, F.concat(F.lit("zz "), F.col("p_type"))))
    held = F.lower("p_type").contains(F.lower("quote"))
    by = both.groupBy("l_orderkey").agg(F.max(F.col("ref").isNull()).alias("unknown"), F.coalesce(F.max(F.col("quote").isNotNull() & ~held), F.lit(False)).alias("unsupported"), F.max(F.col("p_size") % 25 == 0).alias("other"), F.count("*").alias("citations"), F.count_if(F.col("ref").isNotNull() & F.col("quote").isNotNull() & held).alias("verified"))
    return by.select("l_orderkey", F.when(F.col("unknown"), "unknown_reference").when(F.col("unsupported"), "unsupported_quotation").when(F.col("other"), "edition_mismatch").otherwise("grounded").alias("result"), "citations", "verified")
