"""Bounded samples of labelled documents, for the operators that fit a classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, held_out: Column, most: int) -> DataFrame:
    """(doc_id, text, label, part) of about ``most`` labelled rows at most, none held out.

    The sample is chosen by a hash of the id, so it is the same in every run; ``part``
    is a second hash in [0, 1) that splits it. A document with several labels gets the
    label of their mean; null labels and rows without text don't count. Of the rows that share
    an id one is taken, that of the least hash of its text, so repeated rows can't swell the sample.
    """
    known = (
        labels.select("doc_id", F.col(label_col).cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out)
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    )
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(PARTS)) < F.lit(int(PARTS * most / n)))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)) / PARTS
    # At most about ``most`` ids and labels: 16 bytes each.
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label").withColumn("part", part)


def byte_shares(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
