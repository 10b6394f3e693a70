"""Stored indexes: stems, ranks from postings, skipped blocks, phrases, and recall of vector cells."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwood.functions import stems
from ledgerwood.operators import lexical_index as L
from ledgerwood.operators import vector_index as X

# Words and their stems, as the published algorithm gives them.
STEMS = {
    "consigned": "consign", "consignment": "consign", "consistently": "consist", "knightly": "knight", "knives": "knive", "happy": "happi", "cry": "cri", "by": "by",
    "say": "say", "hopping": "hop", "hoping": "hope", "luxuriated": "luxuri", "agreed": "agre", "generously": "generous", "communism": "communism", "skies": "sky",
    "relational": "relat", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "controlled": "control", "analogies": "analog", "hopefulness": "hope",
    "probably": "probabl", "exceeding": "exceed", "youth": "youth", "boyish": "boyish", "adoption": "adopt", "notification": "notif", "rolled": "roll", "bed": "bed", "x2ing": "x2ing",
}


def test_stems(spark):
    rows = spark.createDataFrame([(w,) for w in STEMS], "word string").select("word", stems.english(F.col("word")))
    assert {r[0]: r[1] for r in rows.collect()} == STEMS


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    common = ["notice", "claim", "period", "works"]
    out = [" ".join(rng.choice(common if rng.random() < 0.2 else [f"w{rng.randrange(300)}"]) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    out[7] = "Notice of the claims: the Claimed notices, NOTICE! Échéance"
    return [None, "", "the of and", *out, "unique zebra"]


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    L_block, L.BLOCK = L.BLOCK, 20
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string").repartition(4)
    made = L.write_index(docs, str(tmp_path_factory.mktemp("index")) + "/i")
    L.BLOCK = L_block
    return made


def brute_rank(texts, terms):
    out = []
    for i, t in enumerate(texts):
        words = [STEMMED.get(w, w) for w in re.findall(r"\w+", (t or "").lower().replace("é", "e"))]
        tf = [words.count(q) for q in terms]
        if any(tf):
            out.append((round(-sum(sum(0.1 / (j * j) for j in range(1, n + 1)) for n in tf) / 1.64493406685 / len(terms), 9), i, sum(n > 0 for n in tf)))
    return sorted(out)


STEMMED = {"notices": "notic", "notice": "notic", "claims": "claim", "claimed": "claim", "works": "work", "zebra": "zebra"}


@pytest.mark.parametrize("k, first", [(5, 1), (50, 16), (2000, 2)])
def test_rank_equals_brute_force_whatever_is_skipped(index, texts, k, first):
    got = [(round(-r["score"], 9), r["chunk_id"], r["matched"]) for r in L.ranked(index, "noticed claims of the zebra", k, first).collect()]
    assert got == brute_rank(texts, ["notic", "claim", "zebra"])[:k]


def test_queries_read_their_terms_alone(index, spark):
    assert index.postings.select("block").distinct().count() > 50
    plan = L.of_terms(index.postings, ["zebra"], spark)._jdf.queryExecution().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert "bucket" in filters.group(1) and "EqualTo(term,zebra)" in plan
    assert L.ranked(index, "the of").collect() == [] and L.phrase(index, "of the").collect() == []
    assert [r["chunk_id"] for r in L.matching(index, "Unique").collect()] == [1503]


def test_phrases_count_stop_words_between(index):
    assert [tuple(r) for r in L.phrase(index, "notice of the claim").collect() if r["chunk_id"] == 10] == [(10, 1)]
    assert 10 in {r["chunk_id"] for r in L.phrase(index, "claims: the claimed notice").collect()}
    assert 10 not in {r["chunk_id"] for r in L.phrase(index, "notice claim").collect()}


def test_empty_index(spark, tmp_path):
    made = L.write_index(spark.createDataFrame([], "chunk_id bigint, text string"), str(tmp_path) + "/i")
    assert L.ranked(made, "notice").collect() == []


def test_vector_cells(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.25 * rng.normal(size=(3000, 16))
    rows = [(i, [float(c) for c in v], i % 5) for i, v in enumerate(x)]
    rows += [(4000, None, 1), (4001, [0.0] * 16, 1), (4002, [math.nan] * 16, 1), (4003, [1.0, 2.0], 1), (4004, [c * 1e200 for c in rows[5][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)
    index = X.write_vectors(df, str(tmp_path) + "/v", "vec_id", "embedding", 16, keep=("label",), cells=24)
    assert index.rows.count() == 3001 and len(index.centres) == 24
    asked = df.where("vec_id % 50 = 5 AND vec_id < 3000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = X.nearest(index, asked, probes=None, where=F.col("label") < 4)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    own = [(i, unit[i]) for i in range(3000) if i % 5 < 4] + [(4004, unit[5])]
    mine = sorted(own, key=lambda r: (-round(float(unit[55] @ r[1]), 12), r[0]))[:50]
    assert [r["id"] for r in exact.where("query_id = 55").orderBy("rank").collect()] == [i for i, v in mine if 1 - unit[55] @ v <= 0.75]
    monkeypatch.setattr(X, "AT_ONCE", 7)
    assert X.nearest(index, asked, probes=None, where=F.col("label") < 4).exceptAll(exact).count() == 0
    probed = X.nearest(index, asked, probes=8, where=F.col("label") < 4)
    found = exact.select("query_id", "id").intersect(probed.select("query_id", "id")).count()
    assert found >= 0.95 * exact.count()
    plan = X.nearest(index, asked, probes=2)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() or "dpp" in plan.lower()
    assert X.nearest(index, asked.where("false")).collect() == []


def test_wide_vectors_take_time_by_their_width(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 256)) + 1.0
    x[9] = x[5]  # copies have one score, and the lesser id comes first
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    start = time.perf_counter()
    index = X.write_vectors(df, str(tmp_path) + "/v", "vec_id", "embedding", 256, cells=4)
    asked = df.where("vec_id = 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = X.nearest(index, asked, k=20, probes=None).orderBy("rank").collect()
    # A component's length was worked out anew for each component of each component: 17 million steps a vector.
    assert time.perf_counter() - start < 60
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert [r["id"] for r in got] == sorted(range(400), key=lambda i: (-round(float(unit[5] @ unit[i]), 12), i))[:20]
    assert got[0]["score"] == got[1]["score"]


def shuffled(spark):
    """Bytes that the session's stages have written for shuffles so far."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_index_is_built_without_shuffling_texts(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(3000)}x" for _ in range(200)) for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/texts")
    before = shuffled(spark)
    made = L.write_index(spark.read.parquet(f"{tmp_path}/texts"), f"{tmp_path}/i")
    # Only keys, to look for copies of them.
    assert 0 < shuffled(spark) - before < sum(map(len, texts)) / 20
    assert made.postings.groupBy().agg(F.sum(F.size("positions"))).first()[0] == 400 * 200


def test_copies_of_a_key_accents_and_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", 12)
    monkeypatch.setattr(L, "BLOCK", 2)
    rows = [(1, "Thé notice, Straße notices"), (2, None), (2, "the claims"), (2, "notice of claimed claims"), (None, "claim"), (None, "noticed"), (3, ""), (4, " \n--"), (5, "of the thé")]
    rows += [(i, "works " * (i % 7) + "claim") for i in range(10, 60)]
    # Copies meet wherever they lie; one partition has many segments.
    made = L.write_index(spark.createDataFrame(rows, "chunk_id bigint, text string").repartition(3), f"{tmp_path}/i")
    got = {(r["term"], r["chunk_id"]): (r["positions"], r["weight"]) for r in made.postings.collect()}
    assert len(got) == made.postings.count()
    # "thé" is a stop word when folded, and its place counts.
    assert got["notic", 1][0] == [2, 4] and got["strass", 1][0] == [3] and ("the", 1) not in got
    assert got["claim", 2][0] == [2, 3, 4] and got["notic", 2][0] == [1] and got["claim", None][0] == [1] and got["notic", None][0] == [1]
    assert got["work", 13][0] == [1, 2, 3, 4, 5, 6] and {c for _, c in got} == {1, 2, None, *range(10, 60)}
    assert got["claim", 2][1] == pytest.approx((0.1 + 0.1 / 4 + 0.1 / 9) / L.LIMIT, abs=1e-15)
    assert {tuple(r) for r in made.words.collect()} == {("notice", "notic"), ("notices", "notic"), ("noticed", "notic"), ("strasse", "strass"), ("claims", "claim"), ("claimed", "claim"), ("claim", "claim"), ("works", "work")}
    # A block's chunks are two at most, and all terms of a chunk are in one block.
    blocks = made.postings.groupBy("block").agg(F.count_distinct(F.struct("chunk_id")).alias("n")).collect()
    assert max(r["n"] for r in blocks) == 2 and made.postings.groupBy("chunk_id").agg(F.count_distinct("block").alias("n")).where("n > 1").isEmpty()
    heads = {(r["term"], r["block"]): (r["n"], r["bound"]) for r in made.heads.collect()}
    assert heads == {(r["term"], r["block"]): (r["n"], r["w"]) for r in made.postings.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("weight").alias("w")).collect()}
    best = L.ranked(made, "claims noticed", 2, 1).collect()
    assert [(r["chunk_id"], r["matched"]) for r in best] == [(2, 2), (None, 2)] and best[0]["score"] > best[1]["score"]
    assert {r["chunk_id"]: r["matched"] for r in L.matching(made, "claims noticed").collect()} == {1: 1, 2: 2, None: 2, **{i: 1 for i in range(10, 60)}}
