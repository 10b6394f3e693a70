"""Operators that compare or learn from rows, against brute force and held-out labels."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerwood.llm import graph, minhash, multi_index, pitman_yor, quality, shingles, toxicity

WORDS = [a + b for a in "bcdfghklmnprst" for b in ("a", "en", "ir", "os", "um")]


def prose(rng, n=80):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def uneven(rng, n):
    """Words of very unequal frequency, the next one often decided by the last letter before it."""
    out = ["ba"]
    while len(out) <= n:
        out.append(WORDS[(ord(out[-1][-1]) * 7) % len(WORDS)] if rng.random() < 0.5 else WORDS[min(int(rng.paretovariate(0.8)) - 1, len(WORDS) - 1)])
    return " ".join(out[1:])


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def brute_components(texts, width):
    sets = [set(s.tolist()) for s in shingles.shingle_sets(texts, width)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(3)
    base = [prose(rng) for _ in range(6)]
    texts = [None, "", "a b", "a b"] + base + [edited(rng, base[i % 6], rng.choice([0, 1, 1, 2, 3, 6, 20])) for i in range(150)]
    hot = prose(rng, 120)
    return texts + [hot] * 20 + [edited(rng, hot, rng.choice([2, 3, 4, 5])) for _ in range(120)]


@pytest.mark.parametrize("block", [minhash.BLOCK, 8])
def test_near_duplicates_are_brute_force_s(spark, copies, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)  # a small block sends groups through ranges of distance
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(copies)], "doc_id bigint, text string, node string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, width=4).collect()}
    want = brute_components(copies, 4)
    assert [got[i]["component_id"] for i in range(len(copies))] == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    assert got[0]["n_shingles"] == 0 and got[2]["n_shingles"] == 1


def test_one_of_each_component_stays(spark, copies):
    rows = [(i, t, i) for i, t in enumerate(copies)]
    rows += [(4, copies[4], 4)] * 2 + [(None, copies[5], 0), (1, "", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, single int")
    left = minhash.without_near_duplicates(df, width=4)
    assert left.columns == df.columns
    got = Counter(r["doc_id"] for r in left.collect())
    roots = {c for i, c in enumerate(brute_components(copies, 4)) if (copies[i] or "").strip()}
    assert {i for i in got if i not in (0, 1)} == roots
    assert got[4] == 1 and got[1] == 2  # repeated rows leave one, rows without words all


@pytest.mark.parametrize("block", [minhash.BLOCK, 8])
def test_near_copies_with_null_ids_are_linked(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(12)
    hot, pair = prose(rng, 120), prose(rng)
    texts = [hot] + [edited(rng, hot, rng.choice([1, 2, 3])) for _ in range(59)] + [pair, edited(rng, pair, 1), prose(rng)]
    nodes = [shingles.fingerprint(s) for s in shingles.shingle_sets(texts, 4)]
    least = min(range(60), key=lambda i: nodes[i])  # the least node of the large group, which all others are compared with
    ids = [None if i == least or i % 3 == 0 and i < 60 or i == 61 else i for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    own = brute_components(texts, 4)
    smallest = {c: min(i for i, o in zip(ids, own) if o == c and i is not None) for c in own}
    got = minhash.near_duplicates(df, width=4).collect()
    by_text = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got)
    assert by_text == Counter((i, smallest[c], i == smallest[c]) for i, c in zip(ids, own))
    left = minhash.without_near_duplicates(df, width=4)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(smallest.values()))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        a = rng.integers(0, 2**63, 1000, dtype=np.int64).view(np.uint64)
        b = np.concatenate([a[: int(2000 * share / (1 + share))], rng.integers(0, 2**63, 1000 - int(2000 * share / (1 + share)), dtype=np.int64).view(np.uint64)])
        agree = np.mean(shingles.similarity_sketch(np.unique(a)) == shingles.similarity_sketch(np.unique(b)))
        assert abs(agree - share) < 0.16
    assert (shingles.similarity_sketch(np.array([7], np.uint64)) != 0).all()  # a single element fills every coordinate


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    pairs = chain + star + [(7, 7), (3, 2)]
    rng.shuffle(pairs)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


def test_near_vectors_are_brute_force_s(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    monkeypatch.setattr(multi_index, "PER_CELL", 10)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 16))
    near = base[rng.integers(0, 20, 300)] + rng.normal(size=(300, 16)) * rng.choice([0.02, 0.1, 0.3], size=(300, 1))
    x = np.concatenate([base, near, base[:5], base[:5] * 3.0])
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    df = spark.createDataFrame(rows + [(1000 + i, v, 0) for i, v in enumerate(odd)], "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in multi_index.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    yes = u @ u.T >= 0.95
    links = yes.sum(1) - 1
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    monkeypatch.setattr(multi_index, "CELLS", 0)  # sizes of cells joined by a shuffle
    exact = {r["vec_id"]: r["n_links"] for r in multi_index.near_vectors(df, recall=None).collect()}
    assert [exact[i] for i in range(len(x))] == links.tolist()
    assert all(got[1000 + i]["n_links"] == 0 and got[1000 + i]["kept"] for i in range(len(odd)))


def test_vectors_of_every_length_are_compared(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "PER_CELL", 10)
    rng = np.random.default_rng(7)
    rows = []
    for dims, n in ((16, 300), (12, 200), (24, 200), (5, 3), (1, 3)):
        base = rng.normal(size=(n, dims))
        base[n // 2 :] = base[rng.integers(0, max(1, n // 8), n - n // 2)] + rng.normal(size=(n - n // 2, dims)) * 0.05
        base[-1] = base[0]
        rows += base.tolist()
    order = rng.permutation(len(rows))
    x = [rows[i] for i in order]
    like = lambda a, b: len(a) == len(b) and np.dot(a, b) >= 0.95 * np.linalg.norm(a) * np.linalg.norm(b)
    pairs = [(i, j) for i in range(len(x)) for j in range(i) if like(x[i], x[j])]
    want = Counter(i for pair in pairs for i in pair)
    least = list(range(len(x)))
    for _ in range(len(x)):
        before = list(least)
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
        if least == before:
            break
    df = spark.createDataFrame(list(enumerate(x)), "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in multi_index.near_vectors(df, recall=None).collect()}
    assert got == {i: (want[i], least[i], i == least[i]) for i in range(len(x))}


def test_traversal_is_in_order_and_whole():
    rng = np.random.default_rng(4)
    a, b = rng.random(6), rng.random(5)
    got = list(multi_index.multi_sequence(a, b, 0.9))
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums)
    assert set(got) == {(i, j) for i in range(6) for j in range(5) if a[i] + b[j] <= 0.9}


def test_language_model(spark):
    rng = random.Random(8)
    texts = [uneven(rng, rng.randrange(0, 60)) + rng.choice(["", " Rare%d" % i]) for i in range(200)] + [None, "", "unheard of"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    tokens = [(t or "").lower().split() + [0] for t in texts]
    counts = Counter(x for i, t in enumerate(tokens) if not held[i] for x in t)
    n, v = sum(counts.values()), len(counts)
    model = pitman_yor.fit(df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2))
    assert (model.tokens, model.vocabulary) == (n, v)
    got = {r["doc_id"]: r for r in pitman_yor.score(df, model, block_bytes=2000).collect()}
    for i, t in enumerate(tokens):
        assert got[i]["n_tokens"] == len(t) and got[i]["n_known"] == sum(x in counts for x in t)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in t))
    ours = sum(got[i]["score"] for i in held if held[i])
    assert ours > sum(got[i]["base_score"] for i in held if held[i])
    # The predictive probabilities of every context add up to 1 with the unknown token.
    rows, sample = model.words.collect(), model.samples
    for context in (0, 5, pitman_yor.START):
        total = sum(s.back_off()[context] * s.root(0, 0) for s in sample)
        for r in rows:
            own = r["own"][r["contexts"].index(context)] if context in r["contexts"] else 0.0
            total += own + sum(s.back_off()[context] * p for s, p in zip(sample, r["roots"]))
        assert total / len(sample) == pytest.approx(1.0)


def test_frequent_tokens_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, prose(rng, 40)) for i in range(60)], "doc_id bigint, text string")
    model = pitman_yor.fit(df)
    few = {r["doc_id"]: r["score"] for r in pitman_yor.score(df, model).collect()}
    monkeypatch.setattr(pitman_yor, "FREQUENT", 1)
    assert {r["doc_id"]: pytest.approx(r["score"], rel=1e-5) for r in pitman_yor.score(df, model).collect()} == few


def test_seating_keeps_counts():
    customers = np.array([1, 2, 50, 100_000])
    t = pitman_yor.seat(customers, np.zeros(4), 1.0, 0.5, np.full(4, 0.1), np.arange(4, dtype=np.uint64), 0)
    assert (t >= 1).all() and (t <= customers).all()
    assert t.tolist() == [int(pitman_yor.seat(customers[k : k + 1], np.zeros(1), 1.0, 0.5, np.full(1, 0.1), np.array([k], np.uint64), 0)[0]) for k in range(4)]


def test_seating_follows_the_restaurant_s_law():
    """The mean number of tables against customers seated one by one."""
    n, discount, strength, parent = 60, 0.6, 1.0, 0.3
    mean = {1: 1.0}
    for k in range(1, n):  # the law of the number of tables, exactly
        law = {}
        for t, p in mean.items():
            new = (strength + discount * t) * parent
            up = new / (new + k - discount * t)
            law[t + 1] = law.get(t + 1, 0.0) + p * up
            law[t] = law.get(t, 0.0) + p * (1 - up)
        mean = law
    want = sum(t * p for t, p in mean.items())
    many = 40_000
    got = pitman_yor.seat(np.full(many, n), np.zeros(many), strength, discount, np.full(many, parent), pitman_yor.mix(np.arange(many, dtype=np.uint64)), 5)
    assert got.mean() == pytest.approx(want, rel=0.03)


def test_scores_don_t_follow_the_partitioning(spark):
    rng = random.Random(12)
    rows = [(i if i % 9 else None, prose(rng, 40), "clash") for i in range(80)]
    rows += rows[:5] + [(7, "you " * 20_000, "clash")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    scores = []
    for parts in (1, 5):
        dealt = df.repartition(parts)
        scores.append(sorted(repr((r["doc_id"], r["n_tokens"], round(r["score"], 5))) for r in pitman_yor.score(dealt, pitman_yor.fit(dealt), block_bytes=30_000).collect()))
    assert scores[0] == scores[1] and len(scores[0]) == len(rows)


def test_hot_keys_are_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 10)
    rows = spark.createDataFrame([(0, i) for i in range(40)] + [(k, 100 + k) for k in range(1, 6)] + [(9, 1)], "k bigint, v bigint")
    groups = spark.createDataFrame([(0, 40, "a")] + [(k, 1, "b") for k in range(1, 6)], "k bigint, size bigint, name string")
    got = graph.hot_join(rows, groups, "k", "v", "size")
    assert sorted(map(tuple, got.collect())) == sorted([(0, i, "a") for i in range(40)] + [(k, 100 + k, "b") for k in range(1, 6)])


INSULTS = ["idiot", "scum", "grumbold"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(900):
        text, toxic, good = prose(rng, rng.randrange(20, 90)), i % 6 == 0, i % 5 != 0
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
            text = "you " + " ".join(words)
        if not good:
            text = "### ".join(text.split()) if i % 2 else (text[:40] + "! ") * 6
        docs.append((i, text, "en", "s", len(text), 0.5))
        labels.append((i, int(good), int(toxic)))
    docs += [(900, None, "en", "s", 0, 0.5), (901, "", "en", "s", 0, 0.5)]
    labels += [(0, 1, 1), (None, 1, 1), (5, None, None), (4000, 1, 0)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


@pytest.mark.parametrize("fit, column, mod, out", [(toxicity.fit_toxicity, "toxic", 5, 0), (quality.fit_quality, "quality", 4, 2)])
def test_classifiers_on_held_out_rows(spark, labelled, fit, column, mod, out):
    docs, labels = labelled
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == out
    model = fit(docs, labels, held)
    got = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    assert len(got) == 902 and all(0 <= s <= 1 for s in got.values())
    rows = [(got[r["doc_id"]] >= 0.5) == bool(r[column]) for r in labels.where(held & F.col(column).isNotNull() & (F.col("doc_id") < 900)).collect()]
    assert sum(rows) / len(rows) > 0.97
    only = fit(docs, labels.where(f"{column} = 1"))
    assert {round(r["score"], 6) for r in only.score(docs).collect()} == {1.0}
    assert {round(r["score"], 6) for r in fit(docs, labels.limit(0)).score(docs).collect()} == {0.0}


def test_nearness_to_second_person_holds_at_any_length():
    lexicon = toxicity.Lexicon({b"grumbold": 9.5}, {})
    unit = "you grumbold " + "ba " * 10
    near = [toxicity.dense_features((unit * n).encode(), lexicon)[8] for n in (1, 50, 500, 5000)]
    assert near == pytest.approx([0.5] * 4)
    rng = random.Random(13)
    for _ in range(50):
        places, others = (sorted(rng.sample(range(400), rng.randrange(1, 90))) for _ in range(2))
        assert toxicity.nearest_gaps(places, others) == [min(abs(i - j) for j in others) for i in places]


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    model = quality.QualityModel(0.3, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, 4)))
    x = rng.random((2, quality.WIDTH)) * (rng.random((2, quality.WIDTH)) < 0.05)
    for row, got in zip(x, model.margins(x)):
        at = np.flatnonzero(row)
        pairs = sum(model.factors[i] @ model.factors[j] * row[i] * row[j] for k, i in enumerate(at) for j in at[:k])
        assert got == pytest.approx(0.3 + row @ model.linear + pairs)


def test_pipeline_stages(spark, labelled, tmp_path):
    docs, labels = labelled
    rng = random.Random(11)
    passage = prose(rng, 30)
    more = [(2000 + i, prose(rng, 60) + " " + passage if i < 3 else prose(rng, 60), "en", "s", 1, 0.1) for i in range(6)]
    twin = prose(rng, 90)
    more += [(3000, twin, "en", "s", 1, 0.1), (3001, edited(rng, twin, 1), "en", "s", 1, 0.1), (3000, twin, "en", "s", 1, 0.1)]
    both = docs.union(spark.createDataFrame(more, docs.schema))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r["doc_id"] for r in now.collect()]
        assert now.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    truth = {r["doc_id"]: r for r in labels.where("doc_id < 900 AND toxic IS NOT NULL").collect()}
    clean = [i for i, r in truth.items() if not r["toxic"]]
    assert len(set(clean) & set(kept["toxicity"])) >= 0.98 * len(clean)
    assert len({i for i in truth if truth[i]["toxic"]} & set(kept["toxicity"])) <= 0.1 * 150
    good = [i for i in clean if truth[i]["quality"]]
    assert len(set(good) & set(kept["quality"])) >= 0.97 * len(good)
    assert kept["near_duplicates"].count(3000) == 1 and 3001 not in kept["near_duplicates"]
    assert {2000, 2001, 2002}.isdisjoint(kept["decontamination"]) and {2003, 2004, 2005} <= set(kept["decontamination"])
    assert sorted(kept["decontamination"]) == sorted(kept["sentencepiece"])
    assert now.where("NOT round_trip").count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(kept["sentencepiece"])
