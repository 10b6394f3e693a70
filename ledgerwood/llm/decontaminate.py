"""Benchmark passages in documents (operator 2).

Wu-Manber over words: the alphabet is the words of the benchmark, a block is two
words. A document word that no benchmark item has lets the search leap over a whole
window; else the block under the window's end gives the shift. At shift 0 the block
selects a bucket of windows, and direct comparison confirms each occurrence.

The benchmark goes to the tasks in blocks of bounded size, so it may be larger than
a task's memory: each block is a further pass over the documents, written to the
shared folder in between.

Defined results: a null or empty text has no words, a null or empty item no window;
items with the same id count once; an item without an id marks words but isn't named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, list_array, packed, plain_words, staged, table, unpacked, with_text_columns

WINDOW = 10
#: UTF-8 bytes of benchmark text that one pass sends to the tasks.
PASS_BYTES = 16 << 20


class WuManber:
    """Windows of one length, found in sequences of words."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]], length: int):
        self.length = length
        self.number = {w: i for i, w in enumerate(sorted({w for x in windows for w in x}), 1)}
        self.base = len(self.number) + 1
        self.leap = max(1, length - 1)  # for a block in no window
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[list[int], list[str]]]] = {}
        for window, items in windows.items():
            ids = [self.number[w] for w in window]
            for j in range(1, length):
                block = ids[j - 1] * self.base + ids[j]
                self.shift[block] = min(self.shift.get(block, self.leap), length - 1 - j)
            self.bucket.setdefault(ids[-1] if length == 1 else block, []).append((ids, items))

    def find(self, words: list[bytes], spans: list[tuple[int, int]], items: set[str]) -> None:
        m, n, base, leap = self.length, len(words), self.base, self.leap
        if n < m:
            return
        a = list(map(self.number.get, words))
        if m == 1:
            for i, x in enumerate(a):
                if x:
                    spans.append((i, i + 1))
                    items.update(self.bucket[x][0][1])
            return
        shift, i = self.shift, m - 1
        while i < n:
            x = a[i]
            if not x:
                i += m
                continue
            y = a[i - 1]
            if not y:
                i += m - 1
                continue
            if step := shift.get(y * base + x, leap):
                i += step
                continue
            got = a[i - m + 1 : i + 1]
            for ids, own in self.bucket[y * base + x]:
                if ids == got:
                    spans.append((i - m + 1, i + 1))
                    items.update(own)
            i += 1


def windows_of(rows: Sequence[tuple[object, str | None]], window: int) -> dict[int, dict[tuple[bytes, ...], list[str]]]:
    """Windows by length, each with the ids of its items."""
    found: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in rows:
        words = plain_words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            own = found.setdefault(size, {}).setdefault(tuple(words[i : i + size]), [])
            if item is not None and str(item) not in own:
                own.append(str(item))
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


FIELDS = "n_words bigint, spans array<struct<start:int,stop:int>>, items array<string>"


def _make(rows, window: int):
    def make():
        finders = [WuManber(w, size) for size, w in sorted(windows_of(rows, window).items())]

        def work(texts):
            n_words, spans, items = [], [], []
            for text in texts:
                words = plain_words(text)
                found: list[tuple[int, int]] = []
                named: set[str] = set()
                for finder in finders:
                    finder.find(words, found, named)
                n_words.append(len(words))
                spans.append(merged(found))
                items.append(sorted(named))
            flat = [s for own in spans for s in own]
            pairs = pa.StructArray.from_arrays(
                [pa.array([s for s, _ in flat], pa.int32()), pa.array([e for _, e in flat], pa.int32())], names=["start", "stop"]
            )
            named = pa.array([x for own in items for x in own], pa.string())
            return [pa.array(n_words, pa.int64()), list_array(pairs, [len(x) for x in spans]), list_array(named, [len(x) for x in items])]

        return work

    return make


def _merge_spans(a, b):
    """Union of two sorted lists of spans, as one sorted list without overlaps."""
    whole = F.array_sort(F.concat(a, b))
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["stop"]),
        F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"))),
        ),
    ).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(whole, F.array().cast("array<struct<start:int,stop:int>>"), step)


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Each document's number of words, the word spans that occur in items, and those items."""
    # A repeated item adds nothing, and its copies would all go to one pass.
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-2 * total // pass_bytes) if total > pass_bytes else 1)
    at = F.pmod(F.xxhash64("item", "text"), F.lit(passes))
    out = last = None
    for k in range(passes):
        rows = [tuple(r) for r in (items.where(at == k) if passes > 1 else items).collect()]
        held = [c for c in keep if c not in ("n_words", "spans", "items")]
        if out is None:
            need = [*held, *([text_col] if passes > 1 and text_col not in held else [])]
            out = with_text_columns(docs, text_col, FIELDS, _make(rows, window), need)
        else:
            before, path = staged(out, "passages")
            if last:
                drop_path(docs.sparkSession, last)
            last = path
            before = before.withColumnsRenamed({"spans": "__spans", "items": "__items"})
            out = with_text_columns(before, text_col, FIELDS, _make(rows, window), [*held, *([text_col] if text_col not in held else []), "__spans", "__items"])
            out = out.withColumn("spans", _merge_spans(F.col("spans"), F.col("__spans"))).withColumn("items", F.array_sort(F.array_union("items", "__items"))).drop("__spans", "__items")
    return out.select(*held, "n_words", "spans", "items")


def without_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    return unpacked(find_passages(packed(docs, text_col), benchmark, keep=["row"]).where(F.size("spans") == 0))


def n_hit(spans: str = "spans") -> F.Column:
    return F.aggregate(F.col(spans), F.lit(0).cast("bigint"), lambda n, s: n + (s["stop"] - s["start"]))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Rows of a view ``docs`` as op2 returns them.
PASSAGES_SQL = f"""
d AS (SELECT row_number() OVER () AS rid, doc_id, {PLAIN_WORDS} AS w FROM docs),
b AS (SELECT row_number() OVER () AS bid, item_id, {PLAIN_WORDS} AS w FROM benchmark),
bw AS (
  SELECT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS gram
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM (SELECT *, least({WINDOW}, len(w)) AS size FROM b WHERE len(w) > 0))),
dw AS (
  SELECT rid, size, p, array_to_string(w[p:p + size - 1], ' ') AS gram
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
hit AS (SELECT rid, p, size, item_id FROM dw JOIN bw USING (size, gram)),
words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + size)) AS q FROM hit) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
"""

ORACLE = f"""
WITH docs AS (SELECT * FROM documents), {PASSAGES_SQL}
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN named USING (rid)
"""


def empty_digest() -> str:
    return hashlib.sha256(b"").hexdigest()
