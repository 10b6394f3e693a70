"""URL filters by a Bloom filter cascade: exact membership in a list of keys, without a join.

A rule is a host and the beginning of a path; a url's keys are the pairs that could be rules of it: ends of
its host, of as many labels as some rule has, with beginnings of its path, as long as some rule's. All keys of
all urls are the universe, known in full. Level 1 of a cascade is a Bloom filter of the listed keys; level 2
holds the keys of the universe that level 1 takes for listed and aren't; level 3 the listed ones that level 2
takes for those, and so on, until no false positive is left. A key's first level without it says which it is,
and within the universe that is exact.

The list's size and the logarithm of the universe's bound a cascade, not the corpus: about
1.44 * log2(universe / list) + 4 bits a listed key. A longer list than KEYS is dealt by hash to several
cascades, which pass over the urls one after another, so what is sent to tasks stays bounded.

Defined results: host and path of a url that is null or has no "://" are empty, and no rule fits it. The host
keeps a port or user name; A-Z alone are lower-cased. The longest key that fits wins, of equally long ones
that with more labels, and of a key that is listed both ways, block. Null hosts of rules are left out, null
paths are empty; rules that repeat count once. Without rules every url gets the default verdict. Repeated rows
and null ids are judged like others. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, mix, staged, table

#: Listed keys of a cascade; its levels take about 3 bytes each.
KEYS = 1 << 24
#: Chance of a false positive in all levels but the first.
LATER = 0.5
#: A cascade ends long before; beyond this two keys must share both their hashes.
MOST_LEVELS = 200

#: The rules of the query, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("second")).alias("h2")]


@dataclass
class Level:
    bits: np.ndarray
    size: int
    probes: int
    seed: int

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Places of each key, one row a probe."""
        salt = mix(np.full(1, self.seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        first, step = mix(h1.view(np.uint64) ^ salt), mix(h2.view(np.uint64) + salt) | np.uint64(1)
        return np.stack([(first + np.uint64(i) * step) % np.uint64(self.size) for i in range(self.probes)])

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        p = self.positions(h1, h2)
        return ((self.bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=0)


@dataclass
class Cascade:
    """Levels of the keys whose first hash leaves ``own`` when divided by ``of``."""

    levels: list[Level]
    own: int = 0
    of: int = 1

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        left = np.flatnonzero(h1 % self.of == self.own)
        for level in self.levels:
            if not len(left):
                break
            yes = level.holds(h1[left], h2[left])
            # So far a key is what the last level that holds it encodes: listed ones at levels 0, 2, 4, ...
            left = left[yes]
            out[left] = level.seed % 2 == 0
        return out


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    """The keys (h1, h2) that a level holds, right or wrong."""
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.holds(b.column("h1").to_numpy(), b.column("h2").to_numpy())))

    return keys.mapInArrow(run, "h1 bigint, h2 bigint")


def bloom(keys: DataFrame, n: int, chance: float, seed: int) -> Level:
    """A Bloom filter of ``n`` keys; tasks set bits of their own rows, Spark joins them by word."""
    probes = max(1, round(-math.log2(chance)))
    size = max(64, math.ceil(n * probes / math.log(2)))
    level = Level(np.zeros(0, np.uint64), size, probes, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = np.unique(level.positions(b.column("h1").to_numpy(), b.column("h2").to_numpy()))
            words, starts = np.unique(p >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), starts)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    # Of bounded size: a word for about 50 keys.
    rows = keys.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    level.bits = np.zeros(size // 64 + 1, np.uint64)
    level.bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return level


def cascade(listed: DataFrame, universe: DataFrame, n_universe: int, own: int = 0, of: int = 1, first: float | None = None) -> Cascade:
    """Levels that tell the listed keys (h1, h2) from all others of the universe."""
    spark = listed.sparkSession
    mine = F.pmod(F.col("h1"), F.lit(of)) == own
    ours, ours_at = staged(listed.where(mine), "url-listed")
    n = ours.count()
    paths, levels = [ours_at], []
    if n:
        chance = first or min(LATER, math.sqrt(0.5) * n / max(1, n_universe // of))
        levels.append(bloom(ours, n, chance, 0))
        # The one pass over the universe: only keys that the first level takes for listed are told apart, by the list.
        wrong = _passing(universe.where(mine), levels[0]).distinct().join(ours, ["h1", "h2"], "left_anti")
        theirs, at = staged(wrong, "url-wrong")
        paths.append(at)
        held, other = theirs, ours
        while (n := held.count()) and len(levels) < MOST_LEVELS:
            levels.append(bloom(held, n, LATER, len(levels)))
            # Next come those of the other side that this level takes for its own.
            rest, at = staged(_passing(other, levels[-1]), "url-wrong")
            paths.append(at)
            held, other = rest, held
        if n:
            raise ValueError("keys share both their hashes")
    for path in paths:
        drop_path(spark, path)
    return Cascade(levels, own, of)


def shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """Labels of a host and characters of a path that some rule has; as many as differ, whatever the number of rules."""
    rows = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("chars")).distinct().collect()
    return sorted((r["labels"], r["chars"]) for r in rows)


def keyed(urls: DataFrame, found: list[tuple[int, int]]) -> DataFrame:
    """Each url's keys, those that could win first."""

    def key(labels: int, chars: int) -> Column:
        text = F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars))
        fits = (F.size(F.split("host", r"\.")) >= labels) & (F.char_length("path") >= chars) & (F.col("host") != "")
        return F.when(fits, F.struct((-F.char_length(text)).alias("less"), F.lit(-labels).alias("labels"), text.alias("key")))

    sorted_ = F.array_sort(F.filter(F.array(*[key(*s) for s in found]), lambda k: k.isNotNull()))
    return urls.withColumn("keys", F.transform(sorted_, lambda k: k["key"])).withColumn("hashes", F.transform("keys", lambda k: F.struct(*hashes(k))))


def _marked(urls: DataFrame, lists: list[list[Cascade]]) -> DataFrame:
    """``place``: the first of a url's keys that each list holds; -1 where none."""
    spark = urls.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields)
    names = urls.columns
    at = names.index("hashes")
    sent = spark.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(at)
            rows = np.repeat(np.arange(b.num_rows), np.asarray(keys.value_lengths()))
            order = np.arange(len(rows)) - np.searchsorted(rows, rows)
            h1, h2 = (keys.flatten().field(i).to_numpy() for i in (0, 1))
            columns = []
            for k, own in enumerate(sent.value):
                place = np.full(b.num_rows, -1, np.int32)
                if own and len(rows):
                    yes = np.flatnonzero(np.any([c.holds(h1, h2) for c in own], axis=0))
                    first, where = np.unique(rows[yes], return_index=True)
                    place[first] = order[yes[where]]
                before = np.asarray(b.column(names.index(f"place{k}")))
                columns.append(np.where(place < 0, before, np.where(before < 0, place, np.minimum(before, place))))
            kept = [columns[int(n[5:])] if n.startswith("place") else b.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int32)) for c in kept], names=names)

    return urls.mapInArrow(run, kinds)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most: int = KEYS, first: float | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) of every row. ``rules`` is (host, path, verdict: allow or block).

    ``first`` sets the first level's chance of a false positive; left out, it follows from the sizes.
    """
    own = rules.where("host IS NOT NULL AND host <> ''").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    url = F.col(f"`{url_col}`")
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    found = shapes(own)
    if not found:
        return urls.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    with_keys = keyed(urls, found)
    # Of the host and path alone: copies of a url give the same keys, and only keys that a level holds are made distinct.
    universe = with_keys.select(F.inline("hashes"))
    n_universe = universe.agg(F.approx_count_distinct("h1")).first()[0]
    verdicts = ("block", "allow")
    cascades: list[list[Cascade]] = []
    for verdict in verdicts:
        listed = own.where(F.col("verdict") == verdict).select(*hashes(F.concat("host", "path"))).distinct()
        of = max(1, math.ceil(listed.count() / most))
        cascades.append([cascade(listed, universe, n_universe, k, of, first) for k in range(of)])
    marked = with_keys.select("id", "host", "path", "keys", "hashes", F.lit(-1).alias("place0"), F.lit(-1).alias("place1"))
    passes = max(map(len, cascades))
    for k in range(passes):
        marked = _marked(marked, [c[k : k + 1] for c in cascades])
        if k < passes - 1:
            marked, _ = staged(marked, "url-marked")
    block, allow = F.col("place0"), F.col("place1")
    blocks = (block >= 0) & ((allow < 0) | (block <= allow))
    at = F.when(blocks, block).when(allow >= 0, allow)
    verdict = F.when(blocks, F.lit("block")).when(allow >= 0, F.lit("allow")).otherwise(F.lit(default))
    return marked.select("id", "host", "path", F.get("keys", at).alias("rule"), verdict.alias("verdict"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = f"""
WITH r(h, p, v) AS (VALUES {_VALUES}),
u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
k AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT n, arg_max(r.h || r.p, len(r.h || r.p)) AS rule, arg_max(v, len(r.h || r.p)) AS v FROM k JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM k LEFT JOIN f USING (n)
"""
