"""Queries over stored indexes: ranked full text by stems and positions, and vectors by cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stems
from ..functions.text import ACCENTED, PLAIN
from ..operators import lexical_index as L
from ..operators import vector_index as X
from ..sources.shared import shared_path
from ..sources.tables import table
from .registry import query

ASKED = "Which licensed versions distribute the author's rights and notices?"
PHRASE = "Licensed under the Apache License"
_STOP = ", ".join(f"'{w}'" for w in stems.STOP_WORDS)
_WORDS = lambda text: f"regexp_extract_all(replace(translate(lower({text}), '{ACCENTED}', '{PLAIN}'), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"
#: Terms with their places in every text; no term of a query needs another text's words, so the vocabulary is the texts' own.
_TERMS = f"""t AS (SELECT doc_id, {_WORDS('text')} AS w FROM documents), said AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM t),
asked AS (SELECT unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM (SELECT {_WORDS('{asked}')} AS w)), words AS (SELECT word FROM said UNION SELECT word FROM asked), {stems.stems_sql('words')},
x AS (SELECT doc_id, p, stem AS term FROM said JOIN stems USING (word) WHERE word NOT IN ({_STOP})), q AS (SELECT p, stem AS term FROM asked JOIN stems USING (word) WHERE word NOT IN ({_STOP}))"""


def _terms_sql(asked: str) -> str:
    return _TERMS.replace("{asked}", "'" + asked.replace("'", "''") + "'")


def index_of(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return L.write_index(docs, shared_path(spark, "lexical-index"))


@query(f"""WITH {_terms_sql(ASKED)}, n AS (SELECT doc_id, term, least(count(*), 255) AS tf FROM x WHERE term IN (SELECT term FROM q JOIN asked USING (p) WHERE length(word) > 1) GROUP BY 1, 2)
SELECT doc_id AS chunk_id, count(*) AS matched, round(sum(list_sum(list_transform(range(1, tf + 1), lambda j: 0.1::DOUBLE / (j * j)))) / 1.64493406685 / (SELECT count(DISTINCT term) FROM q JOIN asked USING (p) WHERE length(word) > 1), 9) AS score
FROM n GROUP BY 1 ORDER BY sum(list_sum(list_transform(range(1, tf + 1), lambda j: 0.1::DOUBLE / (j * j)))) DESC, 1 LIMIT 50""")
def r07_ranked_index(spark, sf):
    """The best 50 texts for a question, from the postings of its terms; blocks that can't hold one are skipped."""
    return L.ranked(index_of(spark, sf), ASKED).select("chunk_id", "matched", F.round("score", 9).alias("score"))


@query(f"""WITH {_terms_sql(PHRASE)}, s AS (SELECT doc_id, x.p - q.p AS start FROM x JOIN q USING (term)), f AS (SELECT doc_id, start FROM s GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM q))
SELECT doc_id AS chunk_id, count(*) AS times FROM f GROUP BY 1""")
def r06_phrase(spark, sf):
    """Texts in which the terms of a phrase stand at their distances from each other."""
    return L.phrase(index_of(spark, sf), PHRASE)


@query(f"""WITH {_terms_sql(ASKED)} SELECT doc_id AS chunk_id, count(DISTINCT term) AS matched FROM x WHERE term IN (SELECT term FROM q JOIN asked USING (p) WHERE length(word) > 1) GROUP BY 1""")
def f20_stemmed_match(spark, sf):
    """Every text that matches a question in any of its stems."""
    return L.matching(index_of(spark, sf), ASKED)


@query(f"""WITH words AS (SELECT DISTINCT unnest({_WORDS('text')}) AS word FROM documents), {stems.stems_sql('words')} SELECT stem, count(*) AS words, min(word) AS first_word FROM stems GROUP BY 1""")
def t24_stems(spark, sf):
    """The vocabulary of all texts by stem."""
    words = table(spark, sf, "documents").select(F.explode(L.words_of(F.col("text"))).alias("word")).distinct()
    return words.select("word", stems.english(F.col("word")).alias("stem")).groupBy("stem").agg(F.count("*").alias("words"), F.min("word").alias("first_word"))


def vectors_of(spark, sf):
    """The index of all vectors, and every fiftieth as a query."""
    e = table(spark, sf, "embeddings")
    dims = 64
    index = X.write_vectors(e, shared_path(spark, "vector-index"), "vec_id", "embedding", dims, keep=("label",))
    return index, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS asked FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(asked, embedding::DOUBLE[]) AS score FROM embeddings, q WHERE label <> 3)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE 1 - score <= 0.75) WHERE rank <= 50""")
def r08_vectors_exact(spark, sf):
    """The 50 nearest vectors under a filter, of every fiftieth vector, all cells read."""
    index, queries = vectors_of(spark, sf)
    return X.nearest(index, queries, probes=None, where=F.col("label") != 3).select("query_id", "id", F.round("score", 6).alias("score"))


@query()
def r08_vectors_probed(spark, sf):
    """The same from the cells of the nearest centres alone; the tests hold its recall against the exact answer."""
    index, queries = vectors_of(spark, sf)
    return X.nearest(index, queries, where=F.col("label") != 3).select("query_id", "id", F.round("score", 6).alias("score"))
