"""A training corpus from ``documents``: five stages, each over all that the one before kept.

1. toxicity: documents that the classifier takes for toxic go.
2. quality: documents that the classifier takes for junk go.
3. near_duplicates: of documents linked at a similarity of 0.8 on five-word shingles one stays.
4. decontamination: documents with a benchmark window go.
5. sentencepiece: every document's pieces, and whether they decode to its text exactly.

The classifiers are fitted on a bounded sample of labelled rows among the stage's own input. Each
function takes (spark, docs, sf_dir); its result can be written and read back as the next one's docs.

Defined results: empty documents give empty stages; without labels of both kinds a classifier gives
every document the share of label 1, so one of the two filters may let all or none through. Null and
empty texts are scored on zero inputs, are near duplicates of nothing, hold no benchmark window and have
no pieces. Of repeated rows with words one stays; of equal components the least doc_id, and among rows
that share an id the least hash of a text. Rows with a null doc_id go through all stages like others.
Very long texts are read whole. All columns but the last stage's are those of documents, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwood.llm.common import drop_path, staged, table
from ledgerwood.llm.decontaminate import without_passages
from ledgerwood.llm.minhash import without_near_duplicates
from ledgerwood.llm.quality import fit_quality
from ledgerwood.llm.sentencepiece_lattice import encode
from ledgerwood.llm.toxicity import fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fit_toxicity(docs, table(spark, sf_dir, "labels")).without_toxic(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fit_quality(docs, table(spark, sf_dir, "labels")).without_junk(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_passages(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = encode(docs.select("doc_id", "text"), checked=True)
    return pieces.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; every result but the last is a written table, dropped when the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            drop_path(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifiers can't be expressed in SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None
