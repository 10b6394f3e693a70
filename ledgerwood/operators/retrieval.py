"""Hybrid retrieval: exact, lexical and vector lists, fused by reciprocal rank, diversified and cut to a budget."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clause_under
from ..functions.values import cosine

# The fusion's constants.
RRF_K = 60
AGREEMENT, EXACT, COMPLETE = 1.15, 2.0, 1.10
PER_DOCUMENT, MAX_CHUNKS, MAX_CHARS = 4, 12, 24_000
MAX_DISTANCE = 0.75
#: Characters of a term, in lower case.
TERM = "a-z0-9à-ÿß"


def exact_list(chunks: DataFrame, clause: str, k: int = 20) -> DataFrame:
    """Chunks of a clause or of those below it, each with score 1."""
    found = chunks.where(clause_under(F.col("clause_number"), clause)).withColumn("score", F.lit(1.0))
    return found.withColumn("method", F.lit("clause_exact")).orderBy("clause_number", "chunk_id").limit(k)


def lexical_list(chunks: DataFrame, query: Sequence[str], k: int = 50) -> DataFrame:
    """Chunks with any query term, ranked by the sum of term frequency times inverse document frequency.

    Terms are counted inside each row, so the corpus statistics are one row and nothing else is shuffled.
    """
    query = [re.sub(f"[^{TERM}]", "", q.lower()) for q in query]
    query = [q for q in query if len(q) > 1][:24]
    lower = F.lower("text")
    # A plain substring test first: most texts hold none of the terms, and patterns are dear.
    times = [F.when(lower.contains(q), F.regexp_count(lower, F.lit(f"(?<![{TERM}]){q}(?![{TERM}])"))).otherwise(0) for q in query]
    counted = chunks.withColumn("_tf", F.array(*times))
    tf = [F.get("_tf", F.lit(i)) for i in range(len(query))]
    stats = counted.agg(F.count("*").alias("_n"), *[F.count(F.when(t > 0, 1)).alias(f"_df{i}") for i, t in enumerate(tf)])
    part = [t * F.ln(1 + F.col("_n") / F.greatest(F.lit(1), F.col(f"_df{i}"))) for i, t in enumerate(tf)]
    found = counted.where(F.exists("_tf", lambda t: t > 0)).crossJoin(F.broadcast(stats))  # one row of statistics
    scored = found.withColumn("score", reduce(lambda a, b: a + b, part) / F.greatest(F.lit(1), F.regexp_count(lower, F.lit(f"[{TERM}]{{2,}}"))))
    return scored.select(*chunks.columns, "score", F.lit("lexical").alias("method")).orderBy(F.desc("score"), "chunk_id").limit(k)


def vector_list(chunks: DataFrame, given: DataFrame, k: int = 50) -> DataFrame:
    """Chunks by cosine similarity to the one row of ``given`` (given), those farther than the largest distance left out.

    Without such a row the list is empty.
    """
    asked = F.broadcast(given.limit(1))  # one row
    scored = chunks.where(F.col("embedding").isNotNull()).crossJoin(asked).withColumn("score", cosine(F.col("embedding"), F.col("given"))).drop("given")
    return scored.where(1 - F.col("score") <= MAX_DISTANCE).withColumn("method", F.lit("vector")).orderBy(F.desc("score"), "chunk_id").limit(k)


def fuse(lists: Sequence[DataFrame], weights: Sequence[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (chunk_id, document_id, is_complete, char_count, score, method)."""
    columns = ["chunk_id", "document_id", "is_complete", "char_count", "score", "method"]
    weights = list(weights) if weights else [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("a weight for each list")
    both = reduce(DataFrame.unionByName, [x.select(*columns).withColumn("weight", F.lit(float(w))) for x, w in zip(lists, weights)])
    rank = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("score"), "chunk_id"))
    summed = (
        both.withColumn("rank", rank)
        .groupBy("chunk_id")
        .agg(
            F.min("document_id").alias("document_id"), F.max("is_complete").alias("is_complete"), F.max("char_count").alias("char_count"),
            F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("sum"), F.sort_array(F.collect_set("method")).alias("methods"),
        )
    )
    bonus = F.when(F.size("methods") > 1, AGREEMENT).otherwise(1.0) * F.when(F.array_contains("methods", "clause_exact"), EXACT).otherwise(1.0) * F.when(F.col("is_complete"), COMPLETE).otherwise(1.0)
    return summed.withColumn("fused_score", F.col("sum") * bonus).drop("sum")


def diversify(fused: DataFrame, per_document: int = PER_DOCUMENT) -> DataFrame:
    """The best few of each document."""
    w = Window.partitionBy("document_id").orderBy(F.desc("fused_score"), "chunk_id")
    return fused.withColumn("of_document", F.row_number().over(w)).where(F.col("of_document") <= per_document)


def of_edition(candidates: DataFrame, edition: str | None) -> DataFrame:
    """Without the standard form's chunks (edition, is_form) of another edition; a net below the scope's own filter."""
    if edition is None:
        return candidates
    return candidates.where(~F.coalesce(F.col("is_form") & (F.col("edition") != "") & (F.col("edition") != edition), F.lit(False)))


def dropped(considered: DataFrame, guarded: DataFrame, diversified: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: how many candidates there were, and how many each step of the assembly left out."""
    step = lambda df, name: df.select(F.lit(name).alias("step"))
    both = step(considered, "considered").union(step(guarded, "guarded")).union(step(diversified, "diversified")).union(step(kept, "kept"))
    n = lambda name: F.count_if(F.col("step") == name)
    return both.agg(n("considered").alias("considered"), (n("considered") - n("guarded")).alias("other_edition"), (n("guarded") - n("diversified")).alias("over_document_cap"), (n("diversified") - n("kept")).alias("over_budget"))


def assemble(candidates: DataFrame, max_chunks: int = MAX_CHUNKS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Candidates in order within a budget: one that overflows is skipped and later ones still count.

    A running sum can't skip, so the fold runs over the ordered list; the list is a query's candidates,
    a bounded number by construction of the retrievers.
    """
    item = F.struct((-F.col("fused_score")).alias("k"), "document_id", "chunk_id", "char_count", "fused_score", "methods")
    one = candidates.agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).cast("bigint").alias("chars"), F.expr("slice(items, 1, 0)").alias("kept"))
    fits = lambda s, x: (F.size(s["kept"]) < max_chunks) & ((F.size(s["kept"]) == 0) | (s["chars"] + x["char_count"] <= max_chars))
    step = lambda s, x: F.when(fits(s, x), F.struct((s["chars"] + x["char_count"]).alias("chars"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    kept = one.select(F.aggregate("items", start, step)["kept"].alias("kept"))
    out = kept.select(F.posexplode("kept").alias("n", "x"))
    return out.select(F.concat(F.lit("S"), F.col("n") + 1).alias("ref"), "x.chunk_id", "x.document_id", "x.char_count", "x.fused_score", "x.methods")
