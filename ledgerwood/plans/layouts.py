"""Queries: headings in several layouts, references with places, bundles split into documents. Documents with lines of clauses before them stand in for pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import headings as H
from ..sources.tables import table
from .passages import _places
from .registry import query

#: What each page begins with, by its number.
BEGINS = [
    "Clause {m}.4 Notice Of Claims\n", "12.{m}\nPayment And Retention\n", "ARTICLE IV Payment Terms\n", "7.{m}Securities And Bonds\n", "Valuation of 52.{m} The Engineer shall value the works done\n",
    "3.{m} AggregateBase Cum 647.72 2602.7\n", "3.{m} Works ........ 12\n", "28 days after the event, see Sub-Clause 20.{m} and 4.{m}.2, not 1.5 million\n", "14\n15\nWorks\n",
]
_PAGE = "pg AS (SELECT doc_id, CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '" + b.replace("{m}", "' || (doc_id % 17)::VARCHAR || '").replace("\n", "' || chr(10) || '") + "'" for i, b in enumerate(BEGINS)) + " END || coalesce(text, '') AS text FROM documents)"


def pages(spark, sf):
    n = (F.col("doc_id") % 17).cast("string")
    begins = [F.concat(*[x for i, p in enumerate(b.split("{m}")) for x in ([n] if i else []) + [F.lit(p)]]) for b in BEGINS]
    begin = F.get(F.array(*begins), (F.col("doc_id") % 9).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.concat(begin, F.coalesce("text", F.lit(""))).alias("text"))


_W = lambda t: f"list_filter(regexp_split_to_array({t}, '[ \t]+'), lambda w: w <> '')"
_ROW = lambda t: f"(len(list_filter({_W(t)}, lambda w: regexp_matches(w, '^[0-9,.+/:-]*[0-9][0-9,.+/:-]*$'))) >= 2 OR (len(list_filter({_W(t)}, lambda w: regexp_matches(w, '^[0-9,.+/:-]*[0-9][0-9,.+/:-]*$'))) > 0 AND len(list_filter({_W(t)}, lambda w: regexp_matches(w, '^[0-9,.+/:-]*[0-9][0-9,.+/:-]*$') OR lower(w) IN ({', '.join(repr(u) for u in H.TABLE_UNITS)}))) >= 0.34 * len({_W(t)})))"
_CONTENTS = lambda x: rf"(regexp_matches({x}, '\.{{4,}}\s*[0-9]+\s*$') OR regexp_matches({x}, '^\s*[0-9]+(\.[0-9]+)*\s+\S.*\s[0-9]{{1,4}}\s*$'))"
_OWN = lambda t: f"list_filter({_W(t)}, lambda w: lower(w) NOT IN ({', '.join(repr(u) for u in H.SMALL_WORDS)}))"
_CAPS = lambda t: f"(CASE WHEN len({_OWN(t)}) > 0 THEN len(list_filter({_OWN(t)}, lambda w: regexp_matches(w, '^[A-ZÀ-ÖØ-Þ]')))::DOUBLE / len({_OWN(t)}) ELSE 0.0 END)"
_LOWER = lambda t: f"(' ' || lower({t}) || ' ')"


def _scored(number: str, title: str, keyword: str, line: str) -> str:
    up = f"len(list_filter({_W(title)}, lambda w: regexp_matches(w, '^[A-ZÀ-ÖØ-Þ]')))::DOUBLE / len({_W(title)})"
    prose = " OR ".join(f"contains({_LOWER(title)}, '{p}')" for p in (" shall ", " means ", " if the ", " unless "))
    return f"""(CASE WHEN regexp_matches({title}, '{H.UNIT}') OR {_ROW(title)} OR {_CONTENTS(line)} OR regexp_matches({title}, '^(?:%|m\\b|km\\b|mm\\b|kg\\b|days?\\b|million\\b)') THEN 0.0 ELSE greatest(0.0, least(1.0, round((0.5 + CASE WHEN {keyword} THEN 0.25 ELSE 0.0 END + CASE WHEN length({title}) <= 60 THEN 0.15 WHEN length({title}) <= 90 THEN 0.05 ELSE -0.2 END
- CASE WHEN ends_with({title}, '.') THEN 0.25 ELSE 0.0 END + CASE WHEN len({_W(title)}) = 0 THEN 0.0 WHEN {up} >= 0.7 THEN 0.2 WHEN {up} >= 0.5 THEN 0.1 ELSE -0.1 END - CASE WHEN {prose} THEN 0.2 ELSE 0.0 END - CASE WHEN len(string_split({number}, '.')) >= 4 THEN 0.1 ELSE 0.0 END)::DOUBLE, 6))) END)::DOUBLE"""


def _q(p: str) -> str:
    return p.replace("'", "''")


_MARGIN_SCORE = f"""(CASE WHEN regexp_matches(t4, '^{H.KEYWORD}$') OR {_CONTENTS('line')} OR len({_W('r4')}) < 4 OR {_ROW('t4')} THEN 0.0 ELSE greatest(0.0, round((0.5 + CASE WHEN {_CAPS('t4')} >= 0.6 THEN 0.2 ELSE -0.2 END + CASE WHEN length(t4) <= 40 THEN 0.1 ELSE 0.0 END - CASE WHEN {' OR '.join(f"contains({_LOWER('t4')}, '{p}')" for p in H.PROSE)} THEN 0.4 ELSE 0.0 END)::DOUBLE, 6)) END)::DOUBLE"""
_BARE = lambda t: f"regexp_replace(trim({t}, ' '), '[.;:,]+$', '')"
_PART = lambda p, i: f"regexp_extract(line, '{_q(p)}', {i})"
#: A roman numeral's value: what each letter counts, less twice what stands before a larger one.
_V = lambda c: f"[1, 5, 10, 50, 100, 500, 1000][instr('IVXLCDM', {c})]"
_ROMAN = f"CASE WHEN regexp_full_match(upper(m2), '[IVXLCDM]+') THEN list_sum(list_transform(range(1, length(m2) + 1), lambda i: CASE WHEN i < length(m2) AND {_V('upper(m2)[i]')} < {_V('upper(m2)[i + 1]')} THEN -{_V('upper(m2)[i]')} ELSE {_V('upper(m2)[i]')} END))::BIGINT::VARCHAR ELSE '' END"
_HEADINGS = f"""{_PAGE}, l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_index FROM pg),
l AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_offset, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line_index), '') AS below FROM l0),
x AS (SELECT *, {_PART(H.NUMBERED, 1)} AS k1, {_PART(H.NUMBERED, 2)} AS n1, {_BARE(_PART(H.NUMBERED, 3))} AS t1, {_PART(H.ROMAN, 2)} AS m2, {_BARE(_PART(H.ROMAN, 3))} AS t2, {_PART(H.NO_SPACE, 1)} AS n3, {_BARE(_PART(H.NO_SPACE, 2))} AS t3, {_BARE(_PART(H.MARGIN, 1))} AS t4, {_PART(H.MARGIN, 2)} AS n4, {_PART(H.MARGIN, 3)} AS r4, {_PART(H.ALONE, 1)} AS n5, {_BARE('below')} AS t5 FROM l),
y AS (SELECT *, {_ROMAN} AS n2 FROM x), z AS (SELECT *, {_scored('n1', 't1', "k1 <> ''", 'line')} AS c1, {_scored('n2', 't2', 'true', 'line')} AS c2, {_scored('n3', 't3', 'false', 'line')} AS c3, {_MARGIN_SCORE} AS c4, {_scored('n5', 't5', 'false', "(n5 || ' ' || t5)")} AS c5,
length(t5) <= 80 AND NOT regexp_matches(below, '{H.ALONE}') AND NOT regexp_matches(below, '{H.NUMBERED}') AND {_CAPS('t5')} >= 0.6 AND regexp_matches(t5, '[A-Za-z]') AS ok5 FROM y),
v AS (SELECT *, CASE WHEN n1 <> '' AND t1 <> '' AND c1 >= 0.55 THEN 'numbered' WHEN n2 <> '' AND t2 <> '' AND c2 >= 0.55 THEN 'roman' WHEN n3 <> '' AND t3 <> '' AND c3 >= 0.55 THEN 'no_space' WHEN n4 <> '' AND t4 <> '' AND c4 >= 0.55 THEN 'margin' WHEN ok5 AND n5 <> '' AND t5 <> '' AND c5 >= 0.55 THEN 'two_lines' END AS layout FROM z),
w AS (SELECT *, lag(layout) OVER (PARTITION BY doc_id ORDER BY line_index) AS above FROM v)"""
_PICK = lambda p: f"CASE layout WHEN 'numbered' THEN {p}1 WHEN 'roman' THEN {p}2 WHEN 'no_space' THEN {p}3 WHEN 'margin' THEN {p}4 ELSE {p}5 END"


@query(f"""WITH {_HEADINGS} SELECT doc_id, line_index::INTEGER AS line_index, (char_offset + CASE WHEN layout = 'margin' THEN instr(line, n4) - 1 ELSE 0 END)::INTEGER AS char_offset, layout, {_PICK('n')} AS number, md5({_PICK('t')}) AS title, {_PICK('c')} AS confidence, len(string_split({_PICK('n')}, '.'))::INTEGER AS depth FROM w WHERE layout IS NOT NULL AND above IS DISTINCT FROM 'two_lines'""")
def d03_page_headings(spark, sf):
    """Headings on every line of every page: number first, roman, without a space, in the margin, or over two lines."""
    found = H.headings(pages(spark, sf), "doc_id")
    return found.withColumn("title", F.md5(F.col("title").cast("binary")))


@query(f"""WITH {_PAGE}, {_places('pg', 'doc_id', 'text', H.EXPLICIT, 'ex')}, {_places('pg', 'doc_id', 'text', H.TOKEN, 'tk')}, b AS (SELECT * FROM tk JOIN pg USING (doc_id) WHERE regexp_full_match(matched, '{H.DOTTED}'))
SELECT doc_id, start::INTEGER AS char_offset, regexp_extract(matched, '({H.NUMBER})$', 1) AS number, matched AS label, true AS is_explicit FROM ex
UNION ALL SELECT doc_id, start::INTEGER, matched, matched, false FROM b WHERE NOT regexp_matches(substr(text, (start + length(matched))::BIGINT + 1, 12), '{H.UNIT}') AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.doc_id = b.doc_id AND ex.start < b.start + length(b.matched) AND b.start < ex.start + length(ex.matched))""")
def d05_references(spark, sf):
    """References to clauses with their places, named or bare; measures are none."""
    return H.references(pages(spark, sf), "doc_id")


#: Bundles: sources, whose pages are documents with a beginning of their own at times.
PAGES = ["Annex {m}\n", "Our ref: {m}\nDear Sirs, we refer to your letter and the claim\n", "Minutes of the meeting, page 1 of {m}\n", "Invoice {m}, amount due\n"]
_BUNDLE = "bp AS (SELECT doc_id, source, CASE doc_id % 11 " + " ".join(f"WHEN {i * 2} THEN '" + b.replace("{m}", "' || (doc_id % 17)::VARCHAR || '").replace("\n", "' || chr(10) || '") + "'" for i, b in enumerate(PAGES)) + " ELSE '' END || coalesce(text, '') AS text FROM documents)"


def bundles(spark, sf):
    n = (F.col("doc_id") % 17).cast("string")
    begin = F.lit("")
    for i, b in enumerate(PAGES):
        begin = F.when(F.col("doc_id") % 11 == 2 * i, F.concat(*[x for j, p in enumerate(b.split("{m}")) for x in ([n] if j else []) + [F.lit(p)]])).otherwise(begin)
    return table(spark, sf, "documents").select("doc_id", "source", F.concat(begin, F.coalesce("text", F.lit(""))).alias("text"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(left(text, 2500), '{p}') THEN '{k}'" for k, p in H.KINDS) + " ELSE 'other' END"
_START = " OR ".join(f"regexp_matches(left(text, 600), '{p}')" for p in H.STARTS)


@query(f"""WITH {_BUNDLE}, r AS (SELECT doc_id, source, CASE WHEN {_START} THEN doc_id END AS begins, {_KIND} AS kind, regexp_matches(text, '{H.CLAIMS}') AS claims, regexp_matches(text, '{H.WRITES}') AS writes FROM bp),
s AS (SELECT *, last_value(begins IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS segment FROM r),
g AS (SELECT source, segment, min(doc_id) AS first_page, max(doc_id) AS last_page, count(*) AS n_pages, arg_min(kind, doc_id) AS kind, bool_or(claims) AS claims, bool_or(writes) AS writes FROM s GROUP BY 1, 2)
SELECT source, first_page, last_page, n_pages, CASE WHEN NOT bool_or(kind = 'claim_letter') OVER b AND first_page = min(CASE WHEN claims AND writes THEN first_page END) OVER b THEN 'claim_letter' ELSE kind END AS kind FROM g WINDOW b AS (PARTITION BY source)""")
def g27_bundle_split(spark, sf):
    """The documents in each bundle of pages, and their kinds."""
    return H.bundle_split(bundles(spark, sf), "source", "doc_id")
