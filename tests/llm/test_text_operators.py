"""Operators on single texts, against the libraries, SQL or plain loops, with awkward rows."""

import hashlib
import math
import os
import random
import re
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerwood import llm
from ledgerwood.llm import decontaminate, html_text, license_scan, sentencepiece_lattice, token_counts
from ledgerwood.llm.common import plain_words, space_words, tokenizer_path

SF = "/root/testdata/sf0.001"
AWKWARD = [None, "", " \t\n", "a", "Same words here", "Same words here", "MIT license. mit LICENSE", "x" * 30000, "é ñ İK ▁ \x00 <|endoftext|> 😀", ("word " * 5000).strip()]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(AWKWARD)] + [(3, "a", "clash", 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, items string, n_words int")


def compare(spark, name, con, sf):
    df = llm.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    value = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = con.sql(llm.ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([value(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([value(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    compare(spark, name, con, SF)


@pytest.mark.parametrize("name", ["op1_minhash", "op2_decontamination", "op3_license_scan"])
def test_awkward_rows_against_sql(spark, tmp_path, name):
    rows = [(i, t) for i, t in enumerate(AWKWARD)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "same WORDS"), (2, None), (2, "a"), (3, ""), (4, "word " * 12)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    compare(spark, name, con, str(tmp_path))


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table, schema in {
        "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "labels": "doc_id bigint, quality int, toxic int", "pages": "page_id bigint, url string, html string",
        "benchmark": "item_id bigint, text string", "embeddings": "vec_id bigint, embedding array<float>, label int",
    }.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert llm.QUERIES[name](spark, str(tmp_path)).count() == 0


words = st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30)


@settings(max_examples=200, deadline=None)
@given(words, st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", b"e"]), min_size=1, max_size=6), max_size=5))
def test_wu_manber_finds_what_a_loop_finds(text, items):
    rows = [(i, b" ".join(w).decode()) for i, w in enumerate(items)]
    want, named = set(), set()
    for length, windows in decontaminate.windows_of(rows, 4).items():
        for i in range(len(text) - length + 1):
            if own := windows.get(tuple(text[i : i + length])):
                want |= set(range(i, i + length))
                named |= set(own)
    spans, found = [], set()
    for length, windows in decontaminate.windows_of(rows, 4).items():
        decontaminate.WuManber(windows, length).find(text, spans, found)
    assert {p for a, b in decontaminate.merged(spans) for p in range(a, b)} == want
    assert found == named


def test_several_passes_give_the_same(spark, awkward):
    items = spark.createDataFrame([(i, f"item {i} " + "word " * 12) for i in range(20)] + [(99, "Same words")], "item_id bigint, text string")
    one = decontaminate.find_passages(awkward, items).select("doc_id", "n_words", "spans", "items")
    many = decontaminate.find_passages(awkward, items, pass_bytes=400)
    assert sorted(map(repr, many.collect())) == sorted(map(repr, one.collect()))
    assert one.where("size(items) > 1").count() > 0
    assert set(decontaminate.without_passages(awkward, items).columns) == set(awkward.columns)


def test_no_items_hash():
    assert decontaminate.empty_digest() == hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(token_counts.VOCABULARY))
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False))


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(tokenizer_path(token_counts.VOCABULARY), remembered=100_000)


def test_token_counts_are_the_library_s(spark, awkward, library):
    got = token_counts.prefix_counts(awkward, keep=["doc_id"]).select("doc_id", "n_bytes", "counts", token_counts.total_tokens().alias("n")).collect()
    for r in got:
        text = AWKWARD[r["doc_id"]] or ""
        assert (r["n"], r["n_bytes"], len(r["counts"])) == (library(text), len(text.encode()), len(text) + 1)


ODD = ["<|endoftext|>", "<|startoftext|>", "<|end", "'re", "'ll", "don't", "'s", "the", "ation", "aaaa", "!!!", "e\u0301", "\u0315", "\u0301", "\u0323", "\u1100\u1161\u11a8", "\u0130", "\u03a3", "\u0958", "\u6f22\u5b57", "\x1c", "\x85", "\xa0", " ", "\n", "7", "\xbd", "'", "?", "A", "b"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ODD) | st.text(max_size=3), max_size=10).map("".join))
def test_every_prefix_is_counted_as_the_library_does(library, counter, text):
    text = text.encode("utf-8", "ignore").decode()
    assert token_counts.prefix_table(counter, text).tolist() == [library(text[:k]) for k in range(len(text) + 1)]


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "\u6f22\u5b57" * 900, "e\u0301" * 900, "!?" * 900, "qjzkxv" * 500, "a\u0315\u0301" * 300 + " b" * 300])
def test_long_words_are_counted_whole(library, counter, text):
    table = token_counts.prefix_table(counter, text)
    places = [0, 1, 2, 3, 47, 48, 49, 50, 97, 255, 256, 600, len(text) - 1, len(text)]
    assert [int(table[k]) for k in places] == [library(text[:k]) for k in places]


def test_merges_leave_the_seams_that_running_them_leaves(counter):
    m = counter.merges
    rng = random.Random(4)

    def letters(token):
        return [token] if m.rank[token] < 0 else letters(int(m.left[token])) + letters(int(m.right[token]))

    def merged(row):
        while True:
            best = min(((m.joined.get(a * m.size + b, m.size), i) for i, (a, b) in enumerate(zip(row, row[1:]))), default=(m.size, 0))
            if best[0] == m.size:
                return row
            row[best[1] : best[1] + 2] = [int(np.flatnonzero(m.rank == best[0])[0])]

    tokens = [t for t in m.within_list if 0 <= t < 3000]
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(150)] + [(t, t) for t in tokens[:40]]
    got = m.side_by_side(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), yes in zip(pairs, got, strict=True):
        assert yes == (merged(letters(a) + letters(b)) == [a, b]) == m._seam(a, b)


def test_budget_and_truncation_are_lookups(spark, awkward, library):
    cut = token_counts.prefix_counts(awkward, keep=["doc_id"]).select("doc_id", token_counts.chars_within_budget(3).alias("fit"), token_counts.tokens_at(10).alias("ten")).collect()
    for r in cut:
        text = AWKWARD[r["doc_id"]] or ""
        assert library(text[: r["fit"]]) <= 3 and r["ten"] == library(text[:10])
        assert all(library(text[:k]) > 3 for k in range(r["fit"] + 1, min(len(text), r["fit"] + 40) + 1))


def test_pieces_are_the_library_s(spark, awkward):
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=tokenizer_path(sentencepiece_lattice.MODEL))
    texts = [*AWKWARD, "a  b   c ", "  ", "x\n\ny \n z", "你好 世界😀é\tq", "<0x0A> <s> </s> <unk>", "ab" * 400 + " " * 70 + "bcd" * 300, "\x00\x01z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in sentencepiece_lattice.decode(sentencepiece_lattice.encode(df, keep=["doc_id", "text"])).collect():
        assert r["ids"] == lib.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")


UNIGRAM = [("<unk>", 0.0, "other"), ("▁", -2.0, "piece"), ("a", -3.0, "piece"), ("b", -3.5, "piece"), ("ab", -4.0, "piece"), ("▁a", -3.2, "piece"), ("ba", -5.0, "piece"), ("abab", -7.9, "piece"), ("▁ab", -6.0, "piece")]


def best_sum(word, table):
    scores = {p: s for p, s, k in UNIGRAM if k == "piece"}
    best = [0.0] + [-1e18] * len(word)
    for stop in range(1, len(word) + 1):
        for k in range(1, min(table.longest, stop) + 1):
            s = scores.get(word[stop - k : stop], table.floor if k == 1 else -1e18)
            best[stop] = max(best[stop], best[stop - k] + s)
    return best[-1]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab▁c", min_size=1, max_size=80))
def test_viterbi_reaches_the_best_sum(word):
    table = sentencepiece_lattice.PieceTable(UNIGRAM, "unigram")
    ids = np.frombuffer(table.encode_units([word])[0], np.int32).tolist()
    total = sum(table.floor if i == table.unknown else UNIGRAM[i][1] for i in ids)
    assert total == pytest.approx(best_sum(word, table))


def test_relational_viterbi(spark):
    table = sentencepiece_lattice.PieceTable(UNIGRAM, "unigram")
    words_ = ["▁abab", "abc", "b", "▁", "▁aababba"]
    pieces = spark.createDataFrame([(p, s) for p, s, k in UNIGRAM if k == "piece"], "piece string, score double")
    df = spark.createDataFrame([(w,) for w in words_ * 2] + [(None,), ("",)], "word string")
    got = {r["word"]: r["pieces"] for r in sentencepiece_lattice.encode_words(df, pieces, table.longest, table.floor).collect()}
    assert set(got) == set(words_)
    scores = {p: s for p, s, k in UNIGRAM if k == "piece"}
    for w, own in got.items():
        assert "".join(own) == w
        assert sum(scores.get(p, table.floor) for p in own) == pytest.approx(best_sum(w, table))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="cookie-banner">We use cookies on this site for many good reasons.</div><nav><ul><li><a href="/a">Menu entry</a></ul></nav>
<div id="wrap"><div class="sidebar"><p>Popular things that others read here today</p></div><article><h1>Title &amp; more</h1><p><b>First   paragraph<br>of some&nbsp;length that goes on.</b><p>Short.
<div class="ad">Buy now, it is cheap and good</div><form><label>Sign up</label><input></form><ul><li>one item of the list</li><li>two</li></ul></article>
<section id="comments"><p>A comment that is as long as a paragraph of the article itself, or even longer than that.</p></section></div><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph of some length that goes on.\nShort.\none item of the list\ntwo"
    for odd in (None, "", "<", "<p", "<![if x]>a<![endif]>", "<div><div>", "plain words only", "<p>x</p></p></div>&#xZZ; &bogus;"):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("plain words only") == "plain words only"
    df = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, "v", None, "clash")], "page_id bigint, url string, html string, text string")
    assert {r["page_id"]: r["n_chars"] for r in html_text.extract_pages(df).collect()} == {1: len(html_text.main_text(PAGE)), 2: 0}


def test_pages_without_an_article_element():
    body = "".join(f"<p>Paragraph {i} of the text, long enough to count as part of it.</p>" for i in range(4))
    page = f"<body><div class='header'><p>A long line in the header that isn't part of anything at all</p></div><div class=x><h1>Head</h1>{body}<p class='advert'>Buy this now and save a lot of money today</p></div><div class='copyright'>All ours</div></body>"
    assert html_text.main_text(page).split("\n") == ["Head", *[f"Paragraph {i} of the text, long enough to count as part of it." for i in range(4)]]
    two = f"<main><article>{body}</article></main><div><p>{'Long teaser text of another page. ' * 9}</p></div>"
    assert html_text.main_text(two).count("\n") == 3


def test_whole_articles_in_several_containers():
    body = [f"Paragraph {i} of the text, long enough to count as part of it." for i in range(8)]
    block = "".join(f"<p>{b}</p>" for b in body)
    lead = "The lead of the article, which stands in a container of its own and is long."
    page = f"<body><div class=entry><h1>Title</h1><div class=lead>{lead}</div><div class=entry-content>{block}</div></div></body>"
    assert html_text.main_text(page).split("\n") == ["Title", lead, *body]
    short = f"<body><div class=entry><h1>Title</h1><div class=lead>In short</div><div class=entry-content>{block}</div></div></body>"
    assert html_text.main_text(short).split("\n") == ["Title", "In short", *body]
    for tag in ("blockquote", "ul"):
        inner = "".join(f"<li>{b}" if tag == "ul" else f"<p>{b}</p>" for b in body)
        page = f"<body><div class=text><h1>Title</h1><p>Short lead.</p><{tag}>{inner}</{tag}><p>The end.</p></div></body>"
        assert html_text.main_text(page).split("\n") == ["Title", "Short lead.", *body, "The end."]
    parts = f"<body><article><h2>One</h2>{block}</article><article><h2>Two</h2><p>{lead}</p></article></body>"
    assert html_text.main_text(parts).split("\n") == ["One", *body, "Two", lead]
    own = f"<body><header><p>A page's header</p></header><article><header><h1>Title</h1></header><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then so.</p>{block}</article></body>"
    assert html_text.main_text(own).split("\n") == ["Title", "If x=2 then so.", *body]


def test_smoothing_keeps_the_mean_of_a_flat_page():
    assert html_text.smoothed([5.0] * 7) == pytest.approx([5.0] * 7)


def test_license_places(spark, awkward):
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(awkward).collect()}
    assert (got[6]["n_base"], got[6]["first_word"], got[6]["last_word"], got[6]["base_labels"]) == (2, 0, 2, "mit")
    notice = license_scan.NOTICES[1][1]
    torn = notice.replace("free of charge", "free of any charge").replace("publish, distribute", "publish or distribute")
    df = spark.createDataFrame([(1, "intro words. " + torn), (2, "Permission is hereby granted to go."), (3, "the general, public license!")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df).collect()}
    assert got[1]["labels"] == "mit" and got[1]["n_base"] == 0 and got[1]["score"] > 0.6
    assert (got[2]["labels"], got[2]["score"]) == ("", 0.0)
    assert (got[3]["n_base"], got[3]["base_labels"], got[3]["score"]) == (1, "gpl", 1.0)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_words(text):
    raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    assert [w.decode("utf-8", "surrogatepass") for w in space_words(text)] == re.findall(r"[^\x20\x09-\x0D]+", raw)
    assert [w.decode("utf-8", "surrogatepass") for w in plain_words(text)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)


def test_native_words_match(spark):
    texts = [t or "" for t in AWKWARD] + ["KELVIN K İ ÄÖ ß-ẞ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", F.size(license_scan.plain_word_array(F.col("text"))).alias("n")).collect():
        assert r["n"] == len(plain_words(texts[r["i"]]))


ARTICLE = [f"Paragraph {i} of the text, long enough to count as part of it, surely." for i in range(6)]


@pytest.mark.parametrize(
    "start",
    ['<div class="page has-sidebar">', '<div class="story no-comments">', '<div class="social-policy-paper">', '<article class="post comments-open">', '<form id="aspnetForm">', '<div class="sidebar">', '<section id="notices">'],
)
def test_wrappers_named_by_a_mark_keep_the_article(start):
    block = "".join(f"<p>{b}" for b in ARTICLE)
    tag = start[1:].split()[0]
    page = f"<body><nav><a href=x>Home</a></nav>{start}<h1>Title</h1>{block}</{tag}><div class='sidebar left'>Side text</div><div class=social-links>Follow us</div><footer>Foot</footer></body>"
    assert html_text.main_text(page).split("\n") == ["Title", *ARTICLE]


def test_readers_comments_go_however_long_they_are():
    block = "".join(f"<p>{b}" for b in ARTICLE)
    for start in ("<section id=comments>", "<ol class=comment-list><li>", "<div class='post-comments'>", "<article class='comment'>"):
        assert html_text.main_text(f"<body><div class=main><h1>T</h1><p>Short article of one line.</p></div>{start}{block}{block}</body>") == "T\nShort article of one line."


def test_regions_are_the_loops_own():
    rng = random.Random(5)
    for _ in range(50):
        ratios = [rng.choice([0.0, 2.0, 40.0]) * rng.random() for _ in range(rng.randint(1, 40))]
        smooth = []
        for i in range(len(ratios)):
            near = {k: math.exp(-((k - i) ** 2) / 2) for k in range(len(ratios)) if abs(k - i) <= 3}
            smooth.append(sum(w * ratios[k] for k, w in near.items()) / sum(near.values()))
        mean = sum(smooth) / len(smooth)
        deviation = (sum((s - mean) ** 2 for s in smooth) / len(smooth)) ** 0.5
        got = html_text.content_lines(ratios)
        over = [s >= deviation for s in smooth]
        for i in range(len(ratios)):
            # A line stands between two dense ones, itself at most, with no line below the threshold in between.
            before = [j for j in range(i + 1) if ratios[j] >= deviation and all(over[j : i + 1])]
            after = [j for j in range(i, len(ratios)) if ratios[j] >= deviation and all(over[i : j + 1])]
            assert got[i] == bool(before and after)


def test_regions_choose_the_article():
    teaser = "".join(f"<div><a href=x>Other page {i}</a></div>" for i in range(20))
    block = "".join(f"<p>{b}" for b in ARTICLE)
    assert html_text.main_text(f"<body><div>{teaser}</div><div>{block}</div><div>{teaser}</div></body>").split("\n") == ARTICLE


@pytest.mark.parametrize("part", ["<div>", "<div>x", "<span>x<p>", "<ul><li>a", "<!--", "<a ", '<a href="', "<b>x</i>", "<p class=ad>x"])
def test_time_follows_the_length_of_a_page(part):
    seconds = []
    for n in (4000, 16000):
        start = time.perf_counter()
        html_text.main_text(part * n)
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 2 and seconds[1] < 9 * seconds[0] + 0.2


def test_repeated_and_long_pages(spark):
    page = "<article>" + "".join(f"<p>{b}</p>" for b in ARTICLE * 2000) + "</article>"
    rows = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, "", "y")], "page_id bigint, url string, html string, n_chars string")
    got = html_text.extract_pages(rows).collect()
    assert sorted(r["n_chars"] for r in got) == [0, len("\n".join(ARTICLE * 2000)), len("\n".join(ARTICLE * 2000))]


def test_license_scan_carries_no_words_and_starts_no_python(spark, awkward):
    plan = license_scan.scan_licenses(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan.split("Broadcast")[-1]
    generates = [line for line in plan.split("== Physical Plan ==")[-1].splitlines() if "Generate explode" in line]
    assert generates and all("array<string>" not in line and " w#" not in line.split("], ")[0].split("[", 1)[-1] for line in generates)
