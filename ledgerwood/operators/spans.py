"""Spans of text matches, and joins of spans that overlap.

A text's matches come with their places. Spans meet in bins of characters: each is dealt to every bin that it touches,
and a pair counts in the bin where the later of the two begins, so that it counts once and a long text is no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a bin.
BIN = 256
#: Characters that are kept of what follows a match.
AFTER = 12
#: Matches that a task holds at once.
MATCHES = 20_000


def spans(df: DataFrame, key: str, patterns: Mapping[str, tuple[str, str | None]], text: str = "text") -> DataFrame:
    """(key, kind, n, start, stop, matched, after) of every match; a kind is a pattern, and one that the whole match must have.

    ``n`` numbers a text's matches of a kind from 0, ``after`` is what follows, AFTER characters of it. Places are code points from 0. Null texts have none. Letters and digits are ASCII's in \\w, \\d and \\b.
    """
    tests = {k: (re.compile(p, re.ASCII | re.MULTILINE), re.compile(only, re.ASCII) if only else None) for k, (p, only) in patterns.items()}
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return matches(batches, tests, key)

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, kind string, n int, start int, stop int, matched string, after string")


def matches(batches: Iterator[pa.RecordBatch], tests: Mapping[str, tuple[re.Pattern, re.Pattern | None]], key: str, most: int = MATCHES) -> Iterator[pa.RecordBatch]:
    """The matches in texts ``t`` of keys ``k``, handed on ``most`` at a time, in the middle of a text as well."""
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())

    def made(keys: pa.Array, rows: list[int], out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), *columns], names=[key, "kind", "n", "start", "stop", "matched", "after"])

    for batch in batches:
        rows, out = [], []
        for i, text in enumerate(batch.column("t")):
            value = text.as_py() or ""
            for name, (pattern, only) in tests.items():
                found = (m for m in pattern.finditer(value) if only is None or only.fullmatch(m.group()))
                for n, m in enumerate(found):
                    rows.append(i)
                    out.append((name, n, m.start(), m.end(), m.group(), value[m.end() : m.end() + AFTER]))
                    if len(out) >= most:
                        yield made(batch.column("k"), rows, out)
                        rows, out = [], []
        if out:
            yield made(batch.column("k"), rows, out)


def _binned(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.greatest("start", F.col("stop") - 1)) / size))))


def overlapping(left: DataFrame, right: DataFrame, key: str, size: int = BIN) -> DataFrame:
    """Pairs of spans of one key that share a character: all columns of the left ones, the right one's as other_*."""
    mine = _binned(left, size)
    theirs = _binned(right.select(F.col(key).alias("k"), *[F.col(c).alias(c) for c in ("start", "stop")], *[F.col(c).alias(f"other_{c}") for c in right.columns if c != key]), size)
    theirs = theirs.withColumnsRenamed({"start": "b_start", "stop": "b_stop", "bin": "b_bin"})
    meet = (mine[key] == theirs["k"]) & (mine["bin"] == theirs["b_bin"]) & (mine["start"] < theirs["b_stop"]) & (theirs["b_start"] < mine["stop"])
    met = mine.join(theirs, meet).where(F.col("bin") == F.floor(F.greatest("start", "b_start") / size))
    return met.drop("bin", "b_bin", "b_start", "b_stop", "k")


def free_of(left: DataFrame, right: DataFrame, key: str, size: int = BIN) -> DataFrame:
    """The left spans that share no character with any right one of their key."""
    hit = overlapping(left, right, key, size).select(key, "start", "stop").distinct()
    return left.join(hit, [key, "start", "stop"], "left_anti")
