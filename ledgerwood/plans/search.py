"""Queries: hybrid retrieval over documents as chunks, their sources as documents and vectors by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ascii_bounds
from ..operators import retrieval as R
from ..operators.relations import Scope
from ..sources.tables import table
from .registry import query

WORDS = ["license", "rights", "version"]


def chunks(spark, sf):
    d = table(spark, sf, "documents")
    number = F.concat((F.col("doc_id") % 30).cast("string"), F.lit("."), (F.col("doc_id") % 7).cast("string"))
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "text", number.alias("clause_number"), (F.col("doc_id") % 4 == 0).alias("is_complete"), F.col("n_chars").alias("char_count"))


CHUNKS = "c AS (SELECT doc_id AS chunk_id, source AS document_id, text, (doc_id % 30)::VARCHAR || '.' || (doc_id % 7)::VARCHAR AS clause_number, doc_id % 4 = 0 AS is_complete, n_chars AS char_count FROM documents)"
EXACT = "ex AS (SELECT *, 1.0::DOUBLE AS score, 'clause_exact' AS method FROM c WHERE clause_number = '20' OR starts_with(clause_number, '20.') ORDER BY clause_number, chunk_id LIMIT 20)"
LEXICAL = """t AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-ÿß]+'), lambda x: length(x) > 1) AS terms FROM c),
tf AS (SELECT *, len(list_filter(terms, lambda x: x = 'license')) AS a, len(list_filter(terms, lambda x: x = 'rights')) AS b, len(list_filter(terms, lambda x: x = 'version')) AS d FROM t),
st AS (SELECT count(*) AS n, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db, count(*) FILTER (WHERE d > 0) AS dd FROM tf),
lx AS (SELECT chunk_id, document_id, text, clause_number, is_complete, char_count, (a * ln(1 + n::DOUBLE / greatest(1, da)) + b * ln(1 + n::DOUBLE / greatest(1, db)) + d * ln(1 + n::DOUBLE / greatest(1, dd))) / greatest(1, len(terms)) AS score, 'lexical' AS method
FROM tf, st WHERE a + b + d > 0 ORDER BY score DESC, chunk_id LIMIT 50)"""
VECTOR = """q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
vx AS (SELECT c.*, list_cosine_similarity(embedding::DOUBLE[], q.e) AS score, 'vector' AS method FROM c JOIN embeddings ON vec_id = chunk_id, q WHERE 1 - list_cosine_similarity(embedding::DOUBLE[], q.e) <= 0.75 ORDER BY score DESC, chunk_id LIMIT 50)"""
FUSED = VECTOR + """, u AS (SELECT chunk_id, document_id, is_complete, char_count, score, method FROM vx UNION ALL SELECT chunk_id, document_id, is_complete, char_count, score, method FROM ex UNION ALL SELECT chunk_id, document_id, is_complete, char_count, score, method FROM lx),
k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, chunk_id) AS rank FROM u),
f AS (SELECT chunk_id, min(document_id) AS document_id, bool_or(is_complete) AS is_complete, max(char_count) AS char_count, list_sort(list(DISTINCT method)) AS methods,
sum(1.0::DOUBLE / (60 + rank)) * CASE WHEN count(DISTINCT method) > 1 THEN 1.15 ELSE 1.0 END::DOUBLE * CASE WHEN bool_or(method = 'clause_exact') THEN 2.0 ELSE 1.0 END::DOUBLE * CASE WHEN bool_or(is_complete) THEN 1.10 ELSE 1.0 END::DOUBLE AS fused_score FROM k GROUP BY chunk_id)"""


def lists(spark, sf, c):
    """The exact, the lexical and the vector list; a chunk's vector is the one of its number."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    given = e.where("chunk_id = 0").select(F.col("embedding").alias("given"))
    return [R.exact_list(c, "20"), R.lexical_list(c, WORDS), R.vector_list(c.join(e, "chunk_id"), given).drop("embedding")]


@query(f"WITH {CHUNKS}, {EXACT} SELECT chunk_id, clause_number, score FROM ex")
def r05_exact(spark, sf):
    return R.exact_list(chunks(spark, sf), "20").select("chunk_id", "clause_number", "score")


@query(f"WITH {CHUNKS}, {LEXICAL} SELECT chunk_id, round(score, 6) AS score FROM lx")
def r07_lexical(spark, sf):
    return R.lexical_list(chunks(spark, sf), WORDS).select("chunk_id", F.round("score", 6).alias("score"))


@query("""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings
WHERE 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) <= 0.75
ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 50""")
def r08_vector(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    given = e.where("chunk_id = 0").select(F.col("embedding").alias("given"))
    return R.vector_list(e, given).select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"WITH {CHUNKS}, {EXACT}, {LEXICAL}, {FUSED} SELECT chunk_id, document_id, round(fused_score, 9) AS fused_score, array_to_string(methods, ',') AS methods FROM f")
def r11_fusion(spark, sf):
    c = chunks(spark, sf)
    fused = R.fuse(lists(spark, sf, c))
    return fused.select("chunk_id", "document_id", F.round("fused_score", 9).alias("fused_score"), F.array_join("methods", ",").alias("methods"))


@query(f"""WITH {CHUNKS}, {EXACT}, {LEXICAL}, {FUSED} SELECT chunk_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY fused_score DESC, chunk_id) AS n FROM f) WHERE n <= 4""")
def r12_diversify(spark, sf):
    c = chunks(spark, sf)
    return R.diversify(R.fuse(lists(spark, sf, c))).select("chunk_id", "document_id")


@query(f"""WITH RECURSIVE {CHUNKS}, {EXACT}, {LEXICAL}, {FUSED},
o AS (SELECT *, row_number() OVER (ORDER BY fused_score DESC, document_id, chunk_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY fused_score DESC, chunk_id) AS p FROM f) WHERE p <= 4),
g AS (SELECT 0::BIGINT AS n, 0::BIGINT AS chars, 0::BIGINT AS kept, false AS took UNION ALL
SELECT o.n, CASE WHEN g.kept < 12 AND (g.kept = 0 OR g.chars + o.char_count <= 24000) THEN g.chars + o.char_count ELSE g.chars END, g.kept + CASE WHEN g.kept < 12 AND (g.kept = 0 OR g.chars + o.char_count <= 24000) THEN 1 ELSE 0 END, g.kept < 12 AND (g.kept = 0 OR g.chars + o.char_count <= 24000) FROM g JOIN o ON o.n = g.n + 1)
SELECT 'S' || g.kept::VARCHAR AS ref, o.chunk_id, o.document_id, o.char_count FROM g JOIN o USING (n) WHERE took""")
def r13_assemble(spark, sf):
    c = chunks(spark, sf)
    return R.assemble(R.diversify(R.fuse(lists(spark, sf, c)))).select("ref", "chunk_id", "document_id", "char_count")


@query(f"WITH {CHUNKS} SELECT count(*) AS chunks, count(*) FILTER (WHERE is_complete) AS complete, count(DISTINCT document_id) AS documents FROM c")
def r10_counts(spark, sf):
    return chunks(spark, sf).agg(F.count("*").alias("chunks"), F.count_if("is_complete").alias("complete"), F.count_distinct("document_id").alias("documents"))


@query(f"""WITH RECURSIVE {CHUNKS[:-1]} WHERE source <> 'src1'), {EXACT}, {LEXICAL}, {FUSED},
w AS (SELECT *, NOT (chunk_id % 2 = 0 AND chunk_id % 3 = 1) AS right_edition FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY fused_score DESC, chunk_id) AS p FROM w WHERE right_edition),
o AS (SELECT *, row_number() OVER (ORDER BY fused_score DESC, document_id, chunk_id) AS n FROM p WHERE p <= 4),
g AS (SELECT 0::BIGINT AS n, 0::BIGINT AS chars, 0::BIGINT AS kept UNION ALL SELECT o.n, CASE WHEN g.kept < 12 AND (g.kept = 0 OR g.chars + o.char_count <= 24000) THEN g.chars + o.char_count ELSE g.chars END,
g.kept + CASE WHEN g.kept < 12 AND (g.kept = 0 OR g.chars + o.char_count <= 24000) THEN 1 ELSE 0 END FROM g JOIN o ON o.n = g.n + 1)
SELECT (SELECT count(*) FROM w) AS considered, (SELECT count(*) FROM w WHERE NOT right_edition) AS other_edition, (SELECT count(*) FROM p WHERE p > 4) AS over_document_cap, (SELECT count(*) FROM o) - (SELECT max(kept) FROM g) AS over_budget""")
def r16_pipeline(spark, sf):
    """The whole retrieval under a scope: three lists, fusion, edition guard, diversity, budget, and what each step dropped."""
    scope = Scope(("project", "knowledge"), accessible=(1,), edition="red-book-2017")
    c = chunks(spark, sf).where("document_id <> 'src1'")
    k = F.col("chunk_id")
    fused = R.fuse(lists(spark, sf, c)).withColumns({"is_form": k % 2 == 0, "edition": F.when(k % 3 == 0, "red-book-2017").when(k % 3 == 1, "red-book-1999").otherwise("")})
    guarded = R.of_edition(fused, scope.edition)
    several = R.diversify(guarded)
    return R.dropped(fused, guarded, several, R.assemble(several))


@query(f"""WITH {CHUNKS}, {EXACT}, {LEXICAL}, {FUSED} SELECT chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 'standard_form' ELSE 'project' END AS layer, array_to_string(methods, ',') AS matched_by, round(fused_score, 5) AS score FROM f""")
def r18_search_result(spark, sf):
    """What a search returns of each hit: its layer, the lists that found it and its score to five places."""
    fused = R.fuse(lists(spark, sf, chunks(spark, sf)))
    return fused.select("chunk_id", F.when(F.col("chunk_id") % 2 == 0, "standard_form").otherwise("project").alias("layer"), F.array_join("methods", ",").alias("matched_by"), F.round("fused_score", 5).alias("score"))


# Phrases that point to an intent, with their weights.
INTENTS = {
    "notice_compliance": {"notice": 3, "notified": 3, "notification": 3, "time bar": 5, "time-barred": 5, "within the period": 4, "in time": 3, "late": 2, "28 days": 3, "condition precedent": 5, "served": 2},
    "entitlement": {"entitled": 4, "entitlement": 4, "valid": 3, "succeed": 3, "basis for": 3, "support the claim": 4, "does the contract allow": 4, "can the contractor claim": 4, "grounds": 2, "merit": 2},
    "evidence_search": {"which documents": 5, "what evidence": 5, "supporting": 3, "contradict": 4, "show that": 2, "prove": 3, "records": 2, "correspondence about": 4, "find": 2, "any document": 4},
    "chronology": {"timeline": 5, "chronology": 5, "sequence of events": 5, "what happened": 4, "when did": 4, "history": 2, "order of": 2},
    "quantum": {"how much": 4, "amount": 3, "cost": 3, "quantum": 5, "valuation": 4, "value of": 3, "sum": 2, "price": 2, "payment": 2},
    "definition": {"what does": 2, "define": 4, "definition": 5, "meaning of": 4, "what is meant by": 5, "means": 2},
    "clause_lookup": {"what does clause": 5, "require": 3, "provide": 2, "say": 2, "state": 2, "under clause": 4, "obligation": 3, "provision": 3},
}
# Types of documents worth looking at first for an intent.
HINTS = {
    "notice_compliance": ["notice", "letter", "email", "engineers_instruction", "response"],
    "evidence_search": ["daily_report", "progress_report", "photograph", "site_record", "measurement_sheet", "timesheet", "programme", "updated_programme"],
    "chronology": ["letter", "email", "notice", "meeting_minutes", "daily_report"],
    "quantum": ["payment_record", "invoice", "measurement_sheet", "bill_of_quantities", "cost_claim", "payment_claim"],
    "clause_lookup": ["conditions_of_contract", "particular_conditions", "general_conditions", "contract_agreement", "standard_form", "amendment"],
    "definition": ["conditions_of_contract", "particular_conditions", "general_conditions", "contract_agreement", "standard_form", "amendment"],
    "entitlement": ["conditions_of_contract", "particular_conditions", "general_conditions", "contract_agreement", "standard_form", "amendment"],
}
_CLAUSE = r"\b[0-9]{1,3}(?:\.[0-9]{1,3})+\b"
_POINTS = ", ".join(f"('{k}', '{p}', {w})" for k, v in INTENTS.items() for p, w in v.items())
_ASKED = "q AS (SELECT conv_id, turn, string_agg(text, ' ' ORDER BY text) AS text FROM conversations WHERE role = 'user' GROUP BY 1, 2)"
_INTENT = f"""{_ASKED}, k(name, phrase, weight) AS (VALUES {_POINTS}), s AS (SELECT conv_id, turn, name, sum(weight) AS score FROM q JOIN k ON contains(' ' || lower(trim(text)) || ' ', phrase) GROUP BY 1, 2, 3 UNION ALL SELECT conv_id, turn, 'clause_lookup', 2 FROM q WHERE regexp_matches(text, '{_CLAUSE}')),
t AS (SELECT conv_id, turn, name, sum(score)::BIGINT AS score FROM s GROUP BY 1, 2, 3), i AS (SELECT conv_id, turn, coalesce(max((score, name))[2], 'general') AS intent, coalesce(max((score, name))[1], 0) AS score FROM q LEFT JOIN t USING (conv_id, turn) GROUP BY 1, 2)"""


def intents(spark, sf):
    """Each question's intent: weighted phrases, 2 more for a clause number; of equal scores the greatest name, of none "general"."""
    asked = table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    lower = F.concat(F.lit(" "), F.lower(F.trim("text")), F.lit(" "))
    cited = F.when(F.col("text").rlike(ascii_bounds(_CLAUSE)), 2).otherwise(0)
    score = lambda name, v: sum((F.when(lower.contains(p), w).otherwise(0) for p, w in v.items()), cited if name == "clause_lookup" else F.lit(0))
    scored = F.array(*[F.struct(score(k, v).alias("score"), F.lit(k).alias("name")) for k, v in INTENTS.items()])
    best = asked.withColumn("s", F.array_max(F.filter(scored, lambda x: x["score"] > 0)))
    return best.select("conv_id", "turn", F.coalesce("s.name", F.lit("general")).alias("intent"), F.coalesce("s.score", F.lit(0)).cast("bigint").alias("score"))


@query(f"WITH {_INTENT} SELECT * FROM i")
def r02_intent(spark, sf):
    return intents(spark, sf)


@query(f"""WITH {_INTENT} SELECT conv_id, turn, CASE WHEN intent = 'notice_compliance' THEN 5 WHEN intent = 'evidence_search' THEN 8 WHEN intent = 'chronology' THEN 5 WHEN intent = 'general' THEN 0 ELSE 6 END AS types, intent IN ('notice_compliance', 'chronology') AS letters, intent NOT IN ('evidence_search', 'chronology') AS reads_form FROM i""")
def r04_type_hints(spark, sf):
    """Types of documents to weight for a question, and whether the standard form is worth reading for it (R15)."""
    hints = F.create_map(*[x for k, v in HINTS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    types = F.coalesce(F.try_element_at(hints, F.col("intent")), F.array().cast("array<string>"))
    return intents(spark, sf).select("conv_id", "turn", F.size(types).alias("types"), F.array_contains(types, "letter").alias("letters"), (~F.col("intent").isin("evidence_search", "chronology")).alias("reads_form"))
