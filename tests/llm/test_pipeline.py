"""The pipeline's stages against brute force, each on what the one before keeps, and on awkward tables."""

import random
import re

import pytest

import corpus_pipeline
from ledgerwood.llm.common import tokenizer_path
from ledgerwood.llm.quality import fit_quality
from ledgerwood.llm.sentencepiece_lattice import MODEL
from ledgerwood.llm.toxicity import fit_toxicity
from ledgerwood.llm import quality as quality_module
from ledgerwood.llm import toxicity as toxicity_module

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def space_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", lower) if w]


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-/:-`{-\x7f]+", lower) if w]


def single(rows, width=5, percent=80):
    """Rows that stay when one of each component stays."""
    sets = []
    for r in rows:
        w = space_words(r["text"])
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i) if sets[i] else -1 - i, []).append(r["doc_id"])
    return sorted(min(g) for g in groups.values())


def hit(text, items, width=10):
    words = plain_words(text)
    for item in items:
        w = plain_words(item)
        n = min(width, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        if any(tuple(words[i : i + n]) in windows for i in range(len(words) - n + 1)) and windows:
            return True
    return False


def test_stages_equal_brute_force(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        got = sorted(r["doc_id"] for r in after.collect())
        if name == "toxicity":
            scores = {r["doc_id"]: r["score"] for r in fit_toxicity(now, labels).score(now).collect()}
            assert got == sorted(i for i, s in scores.items() if s < toxicity_module.CUT)
        elif name == "quality":
            scores = {r["doc_id"]: r["score"] for r in fit_quality(now, labels).score(now).collect()}
            assert got == sorted(i for i, s in scores.items() if s >= quality_module.CUT)
        elif name == "near_duplicates":
            assert got == single(before) and len(got) < len(before)
        elif name == "decontamination":
            assert got == sorted(r["doc_id"] for r in before if not hit(r["text"], items))
        else:
            texts = {r["doc_id"]: r["text"] or "" for r in before}
            rows = {r["doc_id"]: r for r in after.collect()}
            assert rows.keys() == texts.keys()
            assert all(r["ids"] == library.encode(texts[i]) and r["n_pieces"] == len(r["ids"]) for i, r in rows.items())
            assert all(r["round_trip"] == (library.decode(library.encode(texts[i])) == texts[i]) for i, r in rows.items())
        if name != "sentencepiece":
            assert after.columns == docs.columns
        now = after


def written(spark, at, docs, labels=(), items=()):
    spark.createDataFrame(list(docs), DOCUMENTS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(at))


def test_empty_tables(spark, tmp_path):
    assert written(spark, tmp_path, []).collect() == []


@pytest.mark.parametrize("with_items", [False, True])
def test_null_ids_and_very_long_texts(spark, tmp_path, with_items):
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    long = words(60_000)
    rows = [(None, words(50), None, None, None), (None, None, "en", "s", 0), (1, "", "en", "s", 0), (2, long, "en", "s", 1), (3, long + " end", "en", "s", 1), (2, long, "en", "s", 1), (4, words(30), "en", "s", 1)]
    items = [(1, None), (2, ""), (3, " ".join(long.split()[40_000:40_012]))] if with_items else []
    # With all labels of one kind the classifiers give one score, that of a good and harmless text.
    got = written(spark, tmp_path, rows, [(i, 1, 0) for i in range(5)], items).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got)
    assert ids == sorted([(True, 0), (True, 0), (False, 1), (False, 4)] + ([] if with_items else [(False, 2)]))
    assert all(r["round_trip"] for r in got)
