"""URL rules and the Bloom filter cascade against loops and SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwood import llm
from ledgerwood.llm import url_filter

SF = "/root/testdata/sf0.001"


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h.count("."), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[3], best[4] if best else default


@pytest.mark.parametrize("most, first", [(1 << 24, None), (1 << 24, 0.5), (7, 0.9)])
def test_random_rules(spark, most, first):
    rng = random.Random(1)
    labels, parts = ["a", "b", "cc", "xn--d", "com", "net", "co"], ["", "x", "en", "é", "longer-part", "p.html"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(parts) for _ in range(rng.randint(0, 3)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(30)] + [("both.com", "/", "allow"), ("both.com", "/", "block"), ("A.Net", "/", "block")]
    rules += rules[:5]
    urls = [rng.choice(["http://", "HTTPS://", ""]) + host().upper() + path() + rng.choice(["", "?q=/en", "#/x", "/?a#b"]) for _ in range(400)]
    urls += [None, "", "://", "no scheme", "http://", "http://com", "http://com?x", "http://.com/", "http://both.com/", "a://b://com/", "http://a.net:80/", "http://x/\nen"] + ["http://a.b.com/en/"] * 150
    pages = spark.createDataFrame([(i % 300 or None, u, "y", 3) for i, u in enumerate(urls)], "page_id bigint, url string, host string, keys int").repartition(3)
    got = url_filter.judge(pages, spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string"), most=most, first=first)
    lower = [(h.lower(), p, v) for h, p, v in rules]
    want = sorted(repr((i % 300 or None, *brute(u, lower))) for i, u in enumerate(urls))
    assert sorted(repr(tuple(r)) for r in got.select("id", "host", "path", "rule", "verdict").collect()) == want


def test_cascade_is_exact_over_the_universe(spark):
    all_ = spark.range(20_000).select(*url_filter.hashes(F.col("id").cast("string")), "id")
    listed = all_.where("id % 9 = 0").select("h1", "h2")
    for of in (1, 3):
        own = [url_filter.cascade(listed, all_.select("h1", "h2"), 20_000, k, of) for k in range(of)]
        assert all(len(c.levels) > 2 for c in own)
        rows = all_.orderBy("id").toArrow()
        got = np.any([c.holds(rows["h1"].to_numpy(), rows["h2"].to_numpy()) for c in own], axis=0)
        assert (got == (np.arange(20_000) % 9 == 0)).all()
    bits = sum(level.size for level in own[0].levels)
    assert bits < 20_000 / 9 / 3 * 12


def test_sql_and_empty_tables(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(url_filter.ORACLE)
    df = llm.QUERIES["op11_url_filter"](spark, SF)
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.judge(none, rules).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/es/")], "page_id bigint, url string")
    assert [tuple(r) for r in url_filter.judge(one, rules.where("false"), default="block").collect()] == [(1, "a.net", "/es/", None, "block")]
