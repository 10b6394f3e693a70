"""Toxicity scores (operator 5): gradient-boosted trees over dense features, calibrated.

A bounded sample of labelled rows is split in folds. Each fold's features come from a
lexicon learned on the other folds: words and word stems that stand in toxic texts far
more often than in others. The trees are trained on densities of that lexicon, its
nearness to second-person words, capitals, punctuation and disguised spellings; isotonic
regression over one fold calibrates their margin. The lexicon of the final model is
learned on the whole sample. Every text is scored whole, in one pass without a shuffle. Two features, the
numbers of strong and of very strong words, saturate at MOST_HITS (their shares of all words don't), and
words of 3 to LONGEST bytes alone are learned; the sample is of SAMPLE ids at most, one row each.

Defined results: null and empty texts are scored on zero features; without labels of
both kinds every score is the share of label 1 (0 without labels); labels, language,
source and id are never inputs. Repeated rows get repeated scores. A null id is of no held-out
row. Columns of ``docs`` that are named like features or scores stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, list_array, packed, plain_words, staged, table, unpacked, utf8, with_text_columns
from .labelled import byte_shares, labelled_sample

#: Labelled rows that a model is fitted on, at most (about).
SAMPLE = 15_000
#: Folds of the sample, of which the last calibrates.
FOLDS = 3
#: Entries of the learned lexicon, at most: a parameter of the model, sent to every task.
LEXICON = 4096
#: Standard errors by which an entry's share of toxic texts exceeds its share of others.
TIERS = (3.0, 5.0, 9.0)
STEMS = (4, 6)
#: Words within which a second-person word is near.
NEAR = 8
CUT = 0.5
#: Hits that are counted as such at most, and bytes of a word that is learned.
MOST_HITS, LONGEST = 20, 40

# Common insults, and second-person words of four languages.
SEED = frozenset(b"idiot moron stupid loser scum trash clown worthless pathetic disgusting dumb jerk bastard vermin filth".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu te ton ta tes toi vous votre vos du dich dir dein deine ihr euch tú usted ustedes tus".encode().split())

FEATURES = 14
_PLAIN_SPELLING = bytes.maketrans(b"013457@$!|", b"oieastasii")


@dataclass(frozen=True)
class Lexicon:
    words: dict[bytes, float]
    stems: dict[bytes, float]

    def scaled(self, by: float) -> Lexicon:
        """Scores as a smaller sample would give them: they grow with its square root."""
        return Lexicon({w: z * by for w, z in self.words.items()}, {w: z * by for w, z in self.stems.items()})


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems of toxic texts, by a two-proportion z-score over distinct texts."""

    def make():
        def work(texts):
            keys = []
            for text in texts:
                words = {w for w in plain_words(text) if 3 <= len(w) <= LONGEST}
                stems = {b"%d:" % k + w[:k] for w in words for k in STEMS if len(w) > k}
                keys.append([*(b"w:" + w for w in words), *stems])
            return [list_array(pa.array([k for own in keys for k in own], pa.binary()), [len(x) for x in keys])]

        return work

    texts = sample.dropDuplicates(["text"])
    found = with_text_columns(texts, "text", "keys array<binary>", make, ["label"])
    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1.0, 0), totals.get(0.0, 0)
    if not bad or not good:
        return Lexicon({}, {})
    counts = found.select("label", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    share = (F.col("a") + F.col("b") + 1) / (bad + good + 2)
    z = (F.col("a") / bad - F.col("b") / good) / F.sqrt(share * (1 - share) * (1 / bad + 1 / good))
    best = counts.where(F.col("a") >= 2).withColumn("z", z).where((F.col("z") >= TIERS[0]) & (F.col("a") / bad >= 4 * F.col("b") / good))
    rows = best.orderBy(F.desc("z"), "key").limit(LEXICON).collect()
    words = {bytes(r["key"][2:]): r["z"] for r in rows if r["key"][:1] == b"w"}
    return Lexicon(words, {bytes(r["key"][2:]): r["z"] for r in rows if r["key"][:1] != b"w"})


def nearest_gaps(places: list[int], others: list[int]) -> list[int]:
    """How far each place is from the nearest of the others; both ascend, and each is passed once."""
    gaps, k = [], 0
    for i in places:
        while k + 1 < len(others) and others[k + 1] <= i:
            k += 1
        gap = abs(i - others[k])
        gaps.append(min(gap, others[k + 1] - i) if k + 1 < len(others) else gap)
    return gaps


def dense_features(raw: bytes, lexicon: Lexicon) -> list[float]:
    words = plain_words_of(raw)
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    get, stem = lexicon.words.get, lexicon.stems.get
    short, long = STEMS
    distinct = set(words)
    weight = {}
    for w in distinct:
        z = max(get(w, 0.0), 20.0 if w in SEED else 0.0, stem(w[:short], 0.0) if len(w) > short else 0.0, stem(w[:long], 0.0) if len(w) > long else 0.0)
        if z:
            weight[w] = z
    hits = [(i, weight[w]) for i, w in enumerate(words) if w in weight] if weight else []
    tiers = [sum(z >= t for _, z in hits) for t in TIERS]
    strong = [i for i, z in hits if z >= TIERS[1]]
    near = 0.0
    if strong:
        persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = sum(1.0 / (1 + g) for g in nearest_gaps(strong, persons) if g <= NEAR) / len(strong) if persons else 0.0
    disguised = 0
    plain = raw.lower().translate(_PLAIN_SPELLING, b"*._-~^")
    if plain != raw.lower():
        disguised = sum(w not in distinct and (w in SEED or get(w, 0.0) >= TIERS[2]) for w in plain_words_of(plain))
    h = byte_shares(raw)
    letters = max(1, int(h[65:91].sum() + h[97:123].sum() + h[128:].sum()))
    size = len(raw)
    return [
        float(tiers[0] > 0), float(min(MOST_HITS, tiers[1])), float(min(MOST_HITS, tiers[2])),
        100.0 * tiers[0] / n, 100.0 * tiers[1] / n, 100.0 * tiers[2] / n,
        max((z for _, z in hits), default=0.0), 100.0 * sum(w in SEED for w in words) / n,
        near, float(h[65:91].sum()) / letters, float(h[33] + h[63]) / size,
        float(h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()) / size,
        float(disguised), 100.0 * disguised / n,
    ]


def plain_words_of(raw: bytes) -> list[bytes]:
    from .common import _PLAIN

    return raw.translate(_PLAIN).split()


def with_features(docs: DataFrame, lexicon: Lexicon, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    def make():
        def work(texts):
            rows = np.array([dense_features(utf8(t), lexicon) for t in texts], np.float64).reshape(-1)
            return [list_array(rows, [FEATURES] * len(texts))]

        return work

    return with_text_columns(docs, text_col, "dense array<double>", make, keep)


@dataclass
class ToxicityModel:
    """``trees`` and ``steps`` are None where labels of one kind only were there."""

    lexicon: Lexicon
    trees: object | None
    steps: object | None
    share: float

    def score(self, docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
        """The kept columns and ``score``."""
        return self._scored(docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"))).select("row.*", "score")

    def _scored(self, rows: DataFrame) -> DataFrame:
        if self.trees is None:
            return rows.select("row", F.lit(float(self.share)).alias("score"))
        featured = with_features(rows, self.lexicon, ["row"]).withColumn("features", array_to_vector("dense"))
        margins = self.trees.transform(featured).withColumn("margin", vector_to_array("rawPrediction")[1])
        return self.steps.transform(margins).select("row", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))

    def without_toxic(self, docs: DataFrame, text_col: str = "text", cut: float = CUT) -> DataFrame:
        """The rows of ``docs`` whose score is below ``cut``."""
        return unpacked(self._scored(packed(docs, text_col)).where(F.col("score") < cut))


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out=None, sample_rows: int = SAMPLE) -> ToxicityModel:
    held_out = F.lit(False) if held_out is None else held_out
    sample, _ = staged(labelled_sample(docs, labels, "toxic", held_out, sample_rows), "toxicity-sample")
    got = sample.agg(F.count("*").alias("n"), F.sum("label").alias("bad")).first()
    n, bad = got["n"], got["bad"] or 0.0
    if not bad or bad == n:
        return ToxicityModel(Lexicon({}, {}), None, None, bad / n if n else 0.0)
    fold = F.floor(F.col("part") * FOLDS)
    parts = []
    for k in range(FOLDS):
        others = learn_lexicon(sample.where(fold != k))
        parts.append(with_features(sample.where(fold == k), others, ["label", "part"]))
    lexicon = learn_lexicon(sample).scaled(((FOLDS - 1) / FOLDS) ** 0.5)
    rest, _ = staged(reduce(DataFrame.union, parts), "toxicity-features")
    ready = rest.withColumn("features", array_to_vector("dense"))
    fit, check = ready.where(fold < FOLDS - 1), ready.where(fold == FOLDS - 1)
    if fit.agg(F.countDistinct("label")).first()[0] < 2 or check.agg(F.countDistinct("label")).first()[0] < 2:
        fit = check = ready
    if fit.agg(F.countDistinct("label")).first()[0] < 2:
        return ToxicityModel(lexicon, None, None, bad / n)
    cached = fit.coalesce(4).cache()
    trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=11).fit(cached)
    cached.unpersist()
    margins = trees.transform(check).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    steps = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(margins)
    return ToxicityModel(lexicon, trees, steps, bad / n)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False))
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), held_out)
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
