"""A third of all rows equal, repeated ids and items, vectors of extreme sizes and of few dimensions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwood.llm import decontaminate, labelled, minhash, multi_index, pitman_yor


def test_a_sample_is_bounded_by_rows(spark):
    docs = spark.range(30_000).select((F.col("id") % 300).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text")).repartition(4)
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    sample = labelled.labelled_sample(docs, labels, "toxic", F.lit(False), 150)
    rows = sample.collect()
    assert 50 < len(rows) <= 250 and len({r["doc_id"] for r in rows}) == len(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, labelled.labelled_sample(docs.repartition(7), labels, "toxic", F.lit(False), 150).collect()))


def test_copies_are_dealt_to_all_blocks(spark):
    same = spark.range(4000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("one text of many copies").alias("text"))
    other = spark.range(8000).select((F.col("id") + 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = same.union(other).repartition(3)
    sizes = [r["count"] for r in docs.groupBy(pitman_yor.block_of(F.col("doc_id"), F.col("text"), 40).alias("block")).count().collect()]
    assert len(sizes) == 40 and max(sizes) < 2 * 12_000 / 40
    small = docs.where("doc_id < 300")
    model = pitman_yor.fit(small)
    one, many = (sorted(map(tuple, pitman_yor.score(small, model, block_bytes=b).collect())) for b in (1 << 30, 5000))
    assert [r[0] for r in one] == [r[0] for r in many] and np.allclose([r[1:] for r in one], [r[1:] for r in many])


def brute_links(x):
    unit = x / np.abs(x).max(axis=1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    return (unit @ unit.T) >= 0.95


def found(spark, rows, recall=multi_index.RECALL):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    return {r["vec_id"]: r["n_links"] for r in multi_index.near_vectors(df, recall=recall).collect()}


def test_hot_and_extreme_vectors(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.tile(rng.normal(size=16), (300, 1)), rng.normal(size=(600, 16))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    n = found(spark, rows)
    assert [n[i] for i in range(900)] == (brute_links(x).sum(axis=1) - 1).tolist()
    sizes = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (5, [-1.0, 1.0]), (6, [0.0, 0.0])]
    assert found(spark, sizes) == {1: 3, 2: 3, 3: 3, 4: 3, 5: 0, 6: 0}


@pytest.mark.parametrize("inner", [2, 3])
def test_recall_where_few_dimensions_vary(spark, inner):
    rng = np.random.default_rng(inner)
    x = rng.normal(size=(2500, inner)) @ rng.normal(size=(inner, 64))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    want = int(brute_links(x).sum()) - len(x)
    got = sum(found(spark, rows).values())
    assert got <= want and got >= 0.99 * want


def test_repeated_items_are_one(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h i j k l " + str(i)) for i in range(30)] + [(99, "other words")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "b c d e f g h i j k")] * 500 + [(2, "not there at all")], "item_id bigint, text string")
    for size in (decontaminate.PASS_BYTES, 50):
        rows = {r["doc_id"]: r["items"] for r in decontaminate.find_passages(docs, items, pass_bytes=size).select("doc_id", "items").collect()}
        assert [len(rows[i]) for i in [*range(30), 99]] == [1] * 30 + [0]


def test_a_hot_bucket(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base + f" x{i % 350}") for i in range(700)] + [(1000 + i, f"row {i} " + " ".join(f"y{i}z{k}" for k in range(20))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert all(got[i] == 0 for i in range(700)) and all(got[1000 + i] == 1000 + i for i in range(700))
