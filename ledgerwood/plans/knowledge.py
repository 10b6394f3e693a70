"""Queries: rules over a knowledge base, quarantine and second validation, the build. Documents stand in for chunks, sources for editions' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knowledge as K
from ..sources.shared import shared_path
from ..sources.tables import table
from .documents import _FOLD, _KEY, _LINES
from .registry import query

EDITION = "red-book-2017"
_CONTENTS = r"regexp_matches(x, '\.{4,}\s*[0-9]+\s*$') OR regexp_matches(x, '^\s*[0-9]+(\.[0-9]+)*\s+\S.*\s[0-9]{1,4}\s*$')"
_LOW = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '))"
_GUIDANCE = " OR ".join([f"contains({_LOW}, '{m}')" for m in K.GUIDANCE] + [f"starts_with({_LOW}, '{m}')" for m in K.FRONT_MATTER])
_CHUNKS = f"""k AS (SELECT doc_id AS chunk_id, CASE doc_id % 5 WHEN 0 THEN '3.1 Notices ' || (doc_id % 90)::VARCHAR || chr(10) || '3.2 Claims .... 12' || chr(10) || left(text, 80) WHEN 1 THEN 'Note: ' || text WHEN 2 THEN 'General Conditions, page' ELSE text END AS text, CASE WHEN doc_id % 97 = 3 THEN 'yellow-book-1999' ELSE '{EDITION}' END AS edition,
(doc_id % 50)::INTEGER AS page_number, ((doc_id % 19) + 1)::VARCHAR || '.' || (doc_id % 4)::VARCHAR AS clause_number, source AS source_document FROM documents)"""


def chunks(spark, sf):
    d, n = table(spark, sf, "documents"), F.col("doc_id")
    contents = F.concat(F.lit("3.1 Notices "), (n % 90).cast("string"), F.lit("\n3.2 Claims .... 12\n"), F.substring("text", 1, 80))
    text = F.when(n % 5 == 0, contents).when(n % 5 == 1, F.concat(F.lit("Note: "), "text")).when(n % 5 == 2, "General Conditions, page").otherwise(F.col("text"))
    number = F.concat((n % 19 + 1).cast("string"), F.lit("."), (n % 4).cast("string"))
    return d.select(n.alias("chunk_id"), text.alias("text"), F.when(n % 97 == 3, "yellow-book-1999").otherwise(EDITION).alias("edition"), (n % 50).cast("int").alias("page_number"), number.alias("clause_number"), F.col("source").alias("source_document"))


def _hits(rel: str, into: str) -> str:
    return f"""{into}_l AS (SELECT *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS lines FROM {rel}), {into}_c AS (SELECT *, len(list_filter(lines, lambda x: {_CONTENTS})) AS c FROM {into}_l),
{into} AS (SELECT chunk_id, 'contents_contamination' AS rule, 1 AS o FROM {into}_c WHERE CASE WHEN len(lines) < 2 THEN len(lines) > 0 AND c = len(lines) AND length(coalesce(text, '')) < 200 ELSE c >= 0.4 * len(lines) END
UNION ALL SELECT chunk_id, 'guidance_text', 2 FROM {rel} WHERE {_GUIDANCE}
UNION ALL SELECT chunk_id, 'duplicate_content', 3 FROM (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY {_FOLD}) AS f FROM {rel} WHERE length({_LOW}) >= 60) WHERE chunk_id <> f
UNION ALL SELECT chunk_id, 'running_header_footer', 4 FROM (SELECT chunk_id, count(*) OVER (PARTITION BY {_LOW}) AS n FROM {rel} WHERE length({_LOW}) BETWEEN 1 AND 120) WHERE n >= 5
UNION ALL SELECT chunk_id, 'malformed_chunk', 5 FROM {rel} WHERE length(trim(coalesce(text, ''), ' ')) < 60 OR len(regexp_extract_all(trim(text, ' '), '[A-Za-zÀ-ÖØ-öø-ÿ]')) < 0.55 * length(trim(text, ' '))
UNION ALL SELECT chunk_id, 'edition_mixing', 6 FROM {rel} WHERE edition IS DISTINCT FROM '{EDITION}' UNION ALL SELECT chunk_id, 'missing_provenance', 8 FROM {rel} WHERE coalesce(source_document, '') = '' OR coalesce(page_number, 0) <= 0)"""


_SEVERITY = "CASE WHEN rule IN ('contents_contamination', 'guidance_text', 'edition_mixing', 'missing_provenance') THEN 'error' ELSE 'warning' END"
_BAD = "SELECT chunk_id, arg_min(rule, o) AS reason FROM {} WHERE rule IN ('contents_contamination', 'guidance_text', 'running_header_footer', 'malformed_chunk') GROUP BY 1"
_PASSES = f"{_CHUNKS}, {_hits('k', 'h1')}, b1 AS ({_BAD.format('h1')}), k2 AS (SELECT * FROM k WHERE chunk_id NOT IN (SELECT chunk_id FROM b1)), {_hits('k2', 'h2')}, b2 AS ({_BAD.format('h2')}), k3 AS (SELECT * FROM k2 WHERE chunk_id NOT IN (SELECT chunk_id FROM b2)), {_hits('k3', 'h3')}"
_MISSING = "SELECT e.clause FROM (SELECT unnest(range(1, 22))::VARCHAR AS clause) e WHERE clause NOT IN (SELECT clause_number FROM {0} UNION SELECT split_part(clause_number, '.', 1) FROM {0})"


@query(f"WITH {_CHUNKS}, {_hits('k', 'h')} SELECT rule, {_SEVERITY} AS severity, count(DISTINCT chunk_id) AS chunks FROM h GROUP BY 1")
def d16_validation_report(spark, sf):
    """What each rule finds: contents lists, guidance, copies, running lines, malformed chunks, other editions, no provenance."""
    return K.report(K.hits(chunks(spark, sf), EDITION))


@query(f"WITH {_CHUNKS}, {_hits('k', 'h')} SELECT chunk_id, rule FROM h WHERE rule IN ('guidance_text', 'edition_mixing', 'missing_provenance')")
def d17_row_rules(spark, sf):
    """Chunks of guidance (D17), of another edition (D19) and without provenance (D21)."""
    return K.hits(chunks(spark, sf), EDITION, ["guidance_text", "edition_mixing", "missing_provenance"])


@query(f"WITH {_PASSES} SELECT chunk_id, reason, 1 AS validation FROM b1 UNION ALL SELECT chunk_id, reason, 2 FROM b2")
def d22_quarantine_list(spark, sf):
    """Chunks that leave, with the first rule that hits them and the validation that found them."""
    return K.validated(chunks(spark, sf), EDITION)[0]


@query(f"""WITH {_PASSES}, m AS ({_MISSING.format('k3')}) SELECT rule, {_SEVERITY} AS severity, count(DISTINCT chunk_id) AS chunks FROM h3 GROUP BY 1 UNION ALL SELECT 'missing_clauses', 'warning', count(*) FROM m HAVING count(*) > 0""")
def d19_second_validation(spark, sf):
    """What is left to say of the chunks that stay: other editions and no provenance forbid publication, copies and gaps don't."""
    expected = spark.range(1, 22).select(F.col("id").cast("string").alias("clause"))
    return K.validated(chunks(spark, sf), EDITION, expected)[2]


@query(f"WITH {_PASSES}, r AS (SELECT DISTINCT rule, {_SEVERITY} AS severity FROM h3) SELECT count(*) FILTER (WHERE severity = 'error') = 0 AS publishable, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM r")
def d24_publishable(spark, sf):
    return K.publishable(K.validated(chunks(spark, sf), EDITION)[2])


@query(rf"""WITH kk AS (SELECT DISTINCT source, doc_id, {_KEY} AS key FROM ({_LINES}) WHERE trim(line, ' ') <> ''), t AS (SELECT source, count(DISTINCT doc_id) AS n_pages FROM documents GROUP BY 1), run AS (SELECT source, key FROM (SELECT source, key, count(*) AS n FROM kk GROUP BY 1, 2) JOIN t USING (source) WHERE n >= greatest(5, ceil(n_pages * 0.02))),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), s AS (SELECT doc_id, l.source, i, line FROM l LEFT JOIN run ON run.source = l.source AND run.key = {_KEY} WHERE run.key IS NULL),
j AS (SELECT doc_id, source, string_agg(line, chr(10) ORDER BY i) AS joined FROM s GROUP BY 1, 2),
b AS (SELECT d.doc_id, d.source, CASE WHEN d.source IN (SELECT source FROM run) THEN trim(regexp_replace(coalesce(joined, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ') ELSE d.text END AS text FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id AND j.source = d.source),
k AS (SELECT doc_id AS chunk_id, text, '{EDITION}' AS edition, 1 AS page_number, '1' AS clause_number, source AS source_document FROM b WHERE trim(text, ' ') <> ''), {_hits('k', 'h')}, q AS ({_BAD.format('h')})
SELECT k.chunk_id, md5(k.text) AS text_hash, length(k.text)::INTEGER AS char_count, q.reason, q.reason IS NOT NULL AS is_quarantined FROM k LEFT JOIN q USING (chunk_id)""")
def d23_build(spark, sf):
    """A base built from all documents: running lines stripped, chunks written, checked, and marked where they are quarantined."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    stripped = K.without_running(d, d, "source", "doc_id", 0.02, d.select("source").distinct().count())
    built = stripped.select(F.col("doc_id").alias("chunk_id"), "text", F.lit(EDITION).alias("edition"), F.lit(1).alias("page_number"), F.lit("1").alias("clause_number"), F.col("source").alias("source_document"))
    path = shared_path(spark, "knowledge-base")
    built.write.parquet(path)
    kept = spark.read.schema(built.schema).parquet(path)
    marked = kept.join(K.quarantined(K.hits(kept, EDITION, K.CONTAMINATION)), "chunk_id", "left")
    return marked.select("chunk_id", F.md5(F.col("text").cast("binary")).alias("text_hash"), F.length("text").alias("char_count"), "reason", F.col("reason").isNotNull().alias("is_quarantined"))
