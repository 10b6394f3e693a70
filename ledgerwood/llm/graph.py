"""Connected components of a link table, as joins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, staged


#: A key with more rows than this is met in parts, and in how many.
HOT, SALTS = 256, 64


def hot_join(rows: DataFrame, groups: DataFrame, key: str, spread: str, size: str) -> DataFrame:
    """Each row with its group's row; ``size`` is how many rows a group has.

    Rows of a hot group are dealt by ``spread``, and the group's row goes to every part: at most
    SALTS / HOT times as many copies as rows. The rest is an ordinary join.
    """
    columns = [*rows.columns, *[c for c in groups.columns if c not in (key, size)]]
    hot = groups.where(F.col(size) > HOT).drop(size).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"), F.lit(True).alias("__hot"))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit(7), F.col(spread)), F.lit(SALTS)).cast("int"))
    met = salted.join(hot, [key, "__salt"], "left")
    rest = met.where("__hot IS NULL").select(*rows.columns).join(groups.where(F.col(size) <= HOT).drop(size), key)
    return met.where("__hot").select(*columns).union(rest.select(*columns))


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); root is the smallest node reachable.

    Large-star and small-star steps in turn: each node's larger neighbours, then its
    smaller ones, are hung on the least of them. A fixed point comes after a number of
    rounds logarithmic in the longest chain; every half of a round is a written table, so a lost
    executor repeats one at most, and a plan that the driver holds has one half alone.
    """
    edges = links.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct()
    edges, path = staged(edges, "edges")
    before = _signature(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).select("u", F.least("u", "m").alias("m"), "size")
        large = hot_join(both, least, "u", "v", "size").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, half = staged(large, "edges")
        floor = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        small = hot_join(large, floor, "u", "v", "size").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges, new = staged(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        drop_path(links.sparkSession, half)
        drop_path(links.sparkSession, path)
        path, after = new, _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest(n: int, pairs: np.ndarray, union: Callable | None = None) -> list[tuple[int, int]]:
    """The pairs of a spanning forest over 0..n-1: the same components in fewer than n pairs."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept
