"""Quality scores (operator 9): a factorisation machine.

Inputs are hashed words (square roots of their shares), statistics of a text's
structure (each a share that saturates at 1) and, of its metadata, its length: language, source and id
are never inputs, so nothing else is left. The machine adds to the linear part the interactions of all
pairs of inputs through low-rank factors; by the sum-of-squares identity,
sum over i<j of <v_i, v_j> x_i x_j = 1/2 sum over f of ((sum v_if x_i)^2 - sum v_if^2 x_i^2),
a score takes time linear in the inputs. It is trained by Spark on a bounded sample of
labelled rows; every text is scored whole, in one pass without a shuffle.

Defined results: null and empty texts have zero inputs but for the bias; without labels
of both kinds every score is the share of label 1 (0 without labels); labels, language,
source and id are never inputs. Repeated rows get repeated scores. A null id is of no held-out
row. A kept column named like the score gives way to it; ``without_junk`` keeps all as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, hash_words, list_array, packed, staged, table, unpacked, utf8, with_text_columns
from .labelled import byte_shares, labelled_sample

#: Labelled rows that a model is fitted on, at most (about).
SAMPLE = 8_000
HASHED = 256
FACTORS = 4
CUT = 0.7
STATS = 14
WIDTH = STATS + HASHED


def structure(raw: bytes, words: list[bytes]) -> list[float]:
    """Shares in [0, 1] that tell prose from junk."""
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * STATS
    h = byte_shares(raw)
    letters = max(1, int(h[65:91].sum() + h[97:123].sum() + h[128:].sum()))
    symbols = int(h[35] + h[36] + h[37] + h[38] + h[42] + h[94] + h[126])
    repeated = sum(a == b for a, b in zip(words, words[1:])) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    part = lambda x, scale: min(1.0, scale * x)
    return [
        part(symbols / size, 8), part(int(h[33]) / n, 2), part(int(h[65:91].sum()) / letters, 1.5), part(int(h[124]) / n, 4),
        len(set(words)) / n, part(repeated, 2), part(size / n / 20, 1), part(int(h[48:58].sum()) / size, 4),
        1.0 - len(set(lines)) / max(1, len(lines)), part(np.log1p(size) / 14, 1), part(int(h[46] + h[44]) / n, 2),
        part(int(h[60] + h[62] + h[123] + h[125]) / size, 8), part(int(h[:9].sum() + h[14:32].sum() + h[127]) / size, 20), part(raw.count(b"http") / n, 4),
    ]


def inputs(texts: Sequence[str | None]) -> np.ndarray:
    """One row of inputs per text."""
    raws = [utf8(t) for t in texts]
    words = [r.lower().split() for r in raws]
    out = np.zeros((len(texts), WIDTH))
    lengths = np.array([len(w) for w in words], np.int64)
    at = (hash_words([w for own in words for w in own]) % np.uint64(HASHED)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(texts)), lengths) * HASHED + at, minlength=len(texts) * HASHED).reshape(len(texts), HASHED)
    out[:, STATS:] = np.sqrt(counts / np.maximum(1, lengths)[:, None])
    for i, (r, w) in enumerate(zip(raws, words, strict=True)):
        out[i, :STATS] = structure(r, w)
    return out


@dataclass
class QualityModel:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        pairs = ((x @ self.factors) ** 2 - (x**2) @ (self.factors**2)).sum(axis=1) / 2
        return self.bias + x @ self.linear + pairs

    def score(self, docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), least: float | None = None) -> DataFrame:
        """The kept columns and ``score``, of rows with at least the score ``least`` if one is given."""
        model = self

        def make():
            def work(texts):
                m = np.clip(model.margins(inputs(texts)), -40, 40)
                return [pa.array(1 / (1 + np.exp(-m)))]

            return work

        return with_text_columns(docs, text_col, "score double", make, keep, None if least is None else lambda made: np.asarray(made[0]) >= least)

    def without_junk(self, docs: DataFrame, text_col: str = "text", cut: float = CUT) -> DataFrame:
        """The rows of ``docs`` whose score is ``cut`` or more."""
        return unpacked(self.score(packed(docs, text_col), keep=["row"], least=cut))


def constant(share: float) -> QualityModel:
    share = min(max(share, 1e-12), 1 - 1e-12)
    return QualityModel(float(np.log(share / (1 - share))), np.zeros(WIDTH), np.zeros((WIDTH, 1)))


def fit_quality(docs: DataFrame, labels: DataFrame, held_out=None, sample_rows: int = SAMPLE) -> QualityModel:
    held_out = F.lit(False) if held_out is None else held_out

    def make():
        def work(texts):
            return [list_array(inputs(texts).reshape(-1), [WIDTH] * len(texts))]

        return work

    sample = labelled_sample(docs, labels, "quality", held_out, sample_rows)
    ready, _ = staged(with_text_columns(sample, "text", "inputs array<double>", make, ["label"]), "quality-inputs")
    got = ready.agg(F.count("*").alias("n"), F.sum("label").alias("good")).first()
    n, good = got["n"], got["good"] or 0.0
    if not good or good == n:
        return constant(good / n if n else 0.0)
    rows = ready.select("label", array_to_vector("inputs").alias("features")).coalesce(4).cache()
    machine = FMClassifier(factorSize=FACTORS, maxIter=120, stepSize=0.1, regParam=1e-5, initStd=0.05, seed=5, tol=1e-7)
    fitted = machine.fit(rows)
    rows.unpersist()
    return QualityModel(fitted.intercept, fitted.linear.toArray(), fitted.factors.toArray())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False))
    scored = fit_quality(docs, table(spark, sf_dir, "labels"), held_out).score(docs)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
