"""Cross-tokenizer alignment against the two libraries and loops."""

import hashlib
import random
from collections import Counter

import pytest

from ledgerwood import llm
from ledgerwood.llm import alignment
from ledgerwood.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(tokenizer_path(alignment.FIRST))
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_file=tokenizer_path(alignment.SECOND))


def brute(texts):
    """Per text: groups as pairs of lists, from both libraries token by token."""
    first, second = libraries()
    letters = alignment.byte_letters()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        a = first.encode(" " + text, add_special_tokens=False)
        b = second.encode(text)
        raw_a = [bytes(letters[c] for c in t) for t in a.tokens]
        raw_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            out.append(None)
            continue
        ids, groups, i, j, at_a, at_b, own = a.ids, [], 0, 0, 0, 0, ([], [])
        while i < len(raw_a) or j < len(raw_b):
            if at_a <= at_b and i < len(raw_a):
                at_a += len(raw_a[i])
                own[0].append(ids[i])
                i += 1
            else:
                at_b += len(raw_b[j])
                own[1].append(b[j])
                j += 1
            if at_a == at_b:
                groups.append(own)
                own = ([], [])
        out.append((len(raw_a), len(raw_b), groups))
    return out


def expected(ids, texts):
    found = brute(texts)
    counts = Counter((g[0][-1], g[1][-1]) for f in found if f for g in f[2])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for i, f in zip(ids, found, strict=True):
        if not f:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(g[0][-1], g[1][-1]) for g in f[2]]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in f[2])
        n_best = sum(counts[x] == best[x[1]] for x in links)
        rows.append((i, f[0], f[1], len(links), len(links), n_best, sum(counts[x] for x in links), hashlib.sha256(written.encode()).hexdigest()))
    return rows


def compared(got, want):
    assert sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in got))) == sorted(map(repr, want))


AWKWARD = [
    None, "", " ", "a", "the the the", "don't  stop\n\n\tnow", "<s> </s> <unk> <0x41> <|endoftext|>", "▁ starts with the mark", "x▁y", "naïve café — “quoted”", "中文字符 と 日本語 한국어",
    "🙂🙃 👨‍👩‍👧", "é   ​ ", "\x00\x01 nul", "1234567890 12.5% 3,000", "a" * 500, " " * 5000, "word " * 300, "ab1" * 400, "A\r\nB", "the the the",
]


@pytest.mark.parametrize("most", [0, 40, 1 << 17])
def test_awkward_texts(spark, most):
    ids = [None, 7, 7, *range(8, 8 + len(AWKWARD) - 3)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, AWKWARD, strict=True)], "doc_id bigint, text string, key string, `row` int").repartition(3)
    got = alignment.align(docs, most=most)
    compared(got.documents.collect(), expected(ids, AWKWARD))
    links = {(r["first_id"], r["second_id"]): r["count"] for r in got.links.collect()}
    assert links == dict(Counter((g[0][-1], g[1][-1]) for f in brute(AWKWARD) if f for g in f[2]))
    assert got.groups.count() == len({str(g) for f in brute(AWKWARD) if f for g in f[2]})


def test_long_texts_and_hot_rows(spark, monkeypatch):
    rng = random.Random(5)
    words = ["alpha", "beta", "don't", "naïve", "x1", "\n", "  ", "中文", "Zürich", "q" * 40, "end."]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    assert len(alignment.chunks(long, 5000)) > 5 and "".join(alignment.chunks(long, 5000)) == long
    monkeypatch.setattr(alignment, "CHUNK", 5000)
    side = alignment.Aligner(*alignment.sides(open(tokenizer_path(alignment.FIRST)).read(), open(tokenizer_path(alignment.SECOND), "rb").read()))
    monkeypatch.setattr(alignment, "chunks", lambda t, f=alignment.chunks: f(t, 5000))
    cut = side.work([long, "short", None])
    monkeypatch.undo()
    assert [c.to_pylist() for c in cut] == [c.to_pylist() for c in side.work([long, "short", None])]
    texts = [long] + ["the same row"] * 60 + [f"row {i} of text" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    compared(alignment.align(docs, most=8).documents.collect(), expected(range(len(texts)), texts))


def test_whole_table_and_empty_one(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    compared(llm.QUERIES["op12_alignment"](spark, SF).collect(), expected([r[0] for r in rows], [r[1] for r in rows]))
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align(none).documents.collect() == []
