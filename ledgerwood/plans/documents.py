"""Queries: pages, lines, chunks, duplicates and checks of documents. A source stands for a document, its rows for pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..sources.tables import table
from .registry import query

_LINES = r"SELECT doc_id, source, unnest(string_split(text, E'\n')) AS line FROM documents"
_KEY = r"CASE WHEN length(lower(trim(regexp_replace(line, '\s+', ' ', 'g'), ' '))) <= 60 THEN regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'), ' ')), '[0-9]+', '#', 'g') ELSE lower(trim(regexp_replace(line, '\s+', ' ', 'g'), ' ')) END"
_FOLD = r"sha256(lower(regexp_replace(text, '\s+', '', 'g')))"


@query(rf"""SELECT doc_id, n AS n_lines, c AS n_contents, NOT (c >= 4 AND c >= 0.3 * n) AS is_content FROM (SELECT doc_id, count(*) AS n,
count(*) FILTER (WHERE regexp_matches(line, '\.{{4,}}\s*[0-9]+\s*$') OR regexp_matches(line, '^\s*[0-9]+(\.[0-9]+)*\s+\S.*\s[0-9]{{1,4}}\s*$')) AS c FROM ({_LINES}) WHERE trim(line, ' ') <> '' GROUP BY 1)""")
def d02_content_pages(spark, sf):
    return D.content_pages(table(spark, sf, "documents"), "doc_id")


@query(rf"""WITH k AS (SELECT DISTINCT source, doc_id, {_KEY} AS key FROM ({_LINES}) WHERE trim(line, ' ') <> ''), t AS (SELECT source, count(DISTINCT doc_id) AS n_pages FROM documents GROUP BY 1),
s AS (SELECT source, key, count(*) AS on_pages FROM k GROUP BY 1, 2) SELECT source, md5(key) AS key, on_pages, n_pages FROM s JOIN t USING (source) WHERE on_pages >= greatest(5, ceil(n_pages * 0.05))""")
def a12_running_lines(spark, sf):
    """Lines on at least five of a document's pages and a twentieth of them."""
    found = D.running_lines(table(spark, sf, "documents"), "source", "doc_id", 0.05)
    return found.select("source", F.md5(F.col("key").cast("binary")).alias("key"), "on_pages", "n_pages")


@query(rf"""SELECT doc_id, content_hash, copies, doc_id <> first_id AS redundant FROM (SELECT doc_id, {_FOLD} AS content_hash, count(*) OVER (PARTITION BY {_FOLD}) AS copies, min(doc_id) OVER (PARTITION BY {_FOLD}) AS first_id FROM documents WHERE length(trim(text, ' ')) >= 60) WHERE copies > 1""")
def a10_repeated_texts(spark, sf):
    return D.repeated_texts(table(spark, sf, "documents"), "doc_id").select("doc_id", "content_hash", "copies", "redundant")


@query(rf"""SELECT md5({_KEY}) AS key, count(*) AS n FROM ({_LINES}) WHERE length(trim(line, ' ')) BETWEEN 1 AND 120 GROUP BY 1 HAVING count(*) >= 5""")
def a11_heavy_hitters(spark, sf):
    from ..functions.text import line_key

    rows = D.lines(table(spark, sf, "documents"), "doc_id").where(F.length(F.trim("line")) <= 120)
    return rows.groupBy(line_key(F.col("line")).alias("k")).agg(F.count("*").alias("n")).where("n >= 5").select(F.md5(F.col("k").cast("binary")).alias("key"), "n")


@query("""SELECT doc_id, CASE WHEN length(trim(text, ' ')) < 60 THEN 'short' ELSE 'letters' END AS reason FROM documents
WHERE length(trim(text, ' ')) < 60 OR (CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]'))::DOUBLE / length(text) ELSE 0.0 END) < 0.55""")
def d18_malformed(spark, sf):
    return D.malformed(table(spark, sf, "documents"), "doc_id")


@query("""SELECT source, sum(length(text))::BIGINT AS chars, sum(len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]')))::BIGINT AS letters, sum(length(text) - length(replace(text, '�', '')))::BIGINT AS broken,
CASE WHEN sum(length(text)) > 0 THEN sum(len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]')))::DOUBLE / sum(length(text)) ELSE 0.0 END::DOUBLE AS alpha_ratio FROM documents GROUP BY 1""")
def a18_text_quality(spark, sf):
    return D.text_quality(table(spark, sf, "documents"), "source")


@query("""SELECT count(*) AS chunks, count(DISTINCT source) AS documents, min(n_chars) AS least, max(n_chars) AS most, count(*) FILTER (WHERE lang = 'en') AS english, sum(n_chars)::DOUBLE / count(*) AS mean FROM documents""")
def a13_corpus_statistics(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("documents"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_if(F.col("lang") == "en").alias("english"), (F.sum("n_chars") / F.count("*")).alias("mean"))


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, text, unnest(string_split_regex(text, '\n[ \t]*\n')) AS p, generate_subscripts(string_split_regex(text, '\n[ \t]*\n'), 1) AS i FROM documents WHERE length(text) > 2000),
s AS (SELECT doc_id, i, unnest(CASE WHEN length(trim(p, ' ')) <= 2000 THEN [trim(p, ' ')] ELSE string_split(regexp_replace(trim(p, ' '), '([.;:!?])[ \t]+([A-Z"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)) END) AS s, generate_subscripts(CASE WHEN length(trim(p, ' ')) <= 2000 THEN [trim(p, ' ')] ELSE string_split(regexp_replace(trim(p, ' '), '([.;:!?])[ \t]+([A-Z"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)) END, 1) AS j FROM p WHERE trim(p, ' ') <> ''),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) AS n, substring(s, k * 2000 + 1, 2000) AS u FROM (SELECT *, unnest(range(0, ceil(length(s) / 2000.0)::BIGINT)) AS k FROM s WHERE s <> '')),
f AS (SELECT doc_id, 0::BIGINT AS n, '' AS buf, NULL::VARCHAR AS made, 0::BIGINT AS k FROM (SELECT DISTINCT doc_id FROM u) UNION ALL
SELECT x.doc_id, x.n, CASE WHEN x.fresh THEN x.u WHEN x.fits THEN x.buf || chr(10) || chr(10) || x.u WHEN x.tail = '' THEN x.u ELSE x.tail || chr(10) || chr(10) || x.u END,
CASE WHEN NOT x.fresh AND NOT x.fits AND NOT (length(trim(x.buf, ' ')) < 60 AND x.k > 0) THEN trim(x.buf, ' ') END, x.k + CASE WHEN NOT x.fresh AND NOT x.fits AND NOT (length(trim(x.buf, ' ')) < 60 AND x.k > 0) THEN 1 ELSE 0 END
FROM (SELECT f.doc_id, f.k, u.n, u.u, f.buf, f.buf = '' AS fresh, length(f.buf) + 2 + length(u.u) <= 1200 AS fits,
CASE WHEN length(f.buf) <= 150 THEN '' WHEN regexp_matches(right(f.buf, 150), '[.;:!?][ \t]+[A-Z"''(]') THEN trim(regexp_extract(right(f.buf, 150), '(?s)^.*?[.;:!?][ \t]+([A-Z"''(].*)$', 1), ' ') WHEN contains(right(f.buf, 150), ' ') THEN trim(substring(right(f.buf, 150), instr(right(f.buf, 150), ' ') + 1), ' ') ELSE right(f.buf, 150) END AS tail
FROM f JOIN u ON u.doc_id = f.doc_id AND u.n = f.n + 1) x),
e AS (SELECT doc_id, k - 1 AS sequence, made AS text FROM f WHERE made IS NOT NULL UNION ALL SELECT doc_id, k, trim(buf, ' ') FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM f) WHERE r = 1 AND length(trim(buf, ' ')) > 0 AND NOT (length(trim(buf, ' ')) < 60 AND k > 0))
SELECT doc_id, sequence, text, length(text)::INTEGER AS char_count FROM e UNION ALL SELECT doc_id, 0, text, length(text)::INTEGER FROM documents WHERE length(text) <= 2000 AND trim(text, ' ') <> ''""")
def d10_chunks(spark, sf):
    """Whole documents as packed chunks that overlap."""
    return D.chunks(table(spark, sf, "documents"), "doc_id").select("doc_id", F.col("sequence").cast("bigint").alias("sequence"), "text", "char_count")


@query(r"""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS owner, count(CASE WHEN role = 'user' THEN 1 END) OVER w AS segment FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)""")
def d07_segments(spark, sf):
    c = table(spark, sf, "conversations").withColumn("heading", F.when(F.col("role") == "user", F.col("turn")))
    return D.headings_filled(c, "conv_id", ["turn", "role", "text"], "heading", F.floor(F.col("turn") / 1000)).select("conv_id", "turn", "owner", "segment")


@query("""SELECT DISTINCT p_brand AS edition, e.clause FROM part, (SELECT unnest(range(1, 51))::INTEGER AS clause) e WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = part.p_brand AND q.p_size = e.clause)""")
def d20_clause_coverage(spark, sf):
    present = table(spark, sf, "part").select(F.col("p_brand").alias("edition"), F.col("p_size").alias("clause"))
    expected = present.select("edition").distinct().select("edition", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("clause"))
    return expected.subtract(present)


@query(rf"""WITH r AS (SELECT doc_id, 1 AS n, 'malformed' AS rule FROM documents WHERE length(trim(text, ' ')) < 60 UNION ALL
SELECT doc_id, 2, 'guidance' FROM documents WHERE contains(lower(text), 'all rights reserved') UNION ALL
SELECT doc_id, 3, 'repeated' FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_FOLD}) AS f FROM documents WHERE length(trim(text, ' ')) >= 60) WHERE doc_id <> f)
SELECT doc_id, arg_min(rule, n) AS rule, count(*) AS hits FROM r GROUP BY 1""")
def d22_quarantine(spark, sf):
    """Documents that a rule rejects, each with the first rule that does."""
    d = table(spark, sf, "documents")
    rule = lambda df, n, name: df.select("doc_id", F.lit(n).alias("n"), F.lit(name).alias("rule"))
    hits = rule(d.where(F.length(F.trim("text")) < 60), 1, "malformed").union(rule(d.where(F.lower("text").contains("all rights reserved")), 2, "guidance"))
    hits = hits.union(rule(D.repeated_texts(d, "doc_id").where("redundant"), 3, "repeated"))
    return hits.groupBy("doc_id").agg(F.min_by("rule", "n").alias("rule"), F.count("*").alias("hits"))
