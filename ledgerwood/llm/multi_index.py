"""Near-duplicate embeddings by an inverted multi-index (operator 6).

Vectors are halved; each half has a codebook of its own, fitted on a bounded sample, and
the pairs of codewords form a grid of cells that every vector is filed in. For a query the
two lists of codewords are sorted by how far the query's half lies from the border of each
codeword's region, and the multi-sequence traversal visits cells in order of the sum of
squares. A vector in a cell is at least that far from the query, so a traversal up to the
squared distance of the threshold (``recall=None``) loses no link at all. Of two vectors at
that distance the part across the two borders is smaller, for a difference in a random
direction by a factor whose square follows a chi-square law of two degrees of freedom over
the dimensions: the traversal stops where that law leaves ``1 - RECALL``. Visited cells are
verified in blocks by the cosine in double precision; a block returns counts and a spanning
forest of its links, never its pairs.

Each length that occurs has codebooks and cells of its own, so vectors of equal length are
always compared. Equal vectors are one node with a multiplicity. Cells that hold many vectors, or that many
queries visit, are dealt out in blocks of at most ``BLOCK`` rows a side.

Defined results: vectors that are null, zero, or that hold null or non-finite components have
no links and are kept; vectors of different lengths aren't linked; repeated rows link with each other;
labels and extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, list_array, staged, table
from .graph import components, forest, hot_join

COSINE = 0.95
#: Components beyond this, or under its inverse, are divided by the vector's largest one.
HUGE = 1e100
#: Vectors that codebooks are fitted on, at most (about).
SAMPLE = 8192
BLOCK = 1024
#: Vectors per cell that the size of the codebooks aims at.
PER_CELL = 400
#: Vectors of each length that codebooks are fitted on, at least (about, or all of fewer).
LEAST = 64
#: Share of links at the threshold that the traversal reaches; closer ones are surer.
RECALL = 0.9999
CODEWORDS = (2, 256)
#: A cell's number is its place in its length's grid plus this times the length.
GRID = CODEWORDS[1] ** 2
#: Cells whose sizes go to every task, at most (16 bytes each); those of more grids are joined by a shuffle.
CELLS = 1 << 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, node, vector): node is a hash of the vector, null for one that links with nothing."""
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = vectors.schema[vector_col].dataType.simpleString()
    # Squares of very large or small components leave a double's range, and a vector's length doesn't matter.
    largest = F.array_max(F.transform(v.cast("array<double>"), F.abs))
    by = F.when((largest > HUGE) | ((largest > 0) & (largest < 1 / HUGE)), largest).otherwise(F.lit(1.0)).cast("float" if kind == "array<float>" else "double")
    fixed = F.transform(v.cast(kind if kind == "array<float>" else "array<double>"), lambda x: x / by + F.lit(0.0).cast("float" if kind == "array<float>" else "double"))
    return vectors.select(F.col(id_col).alias("vec_id"), F.when(sound, fixed).alias("vector")).withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codewords by Lloyd's rounds from evenly spaced rows."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin(((centres**2).sum(1)[None, :] - 2 * x @ centres.T), axis=1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(centres, axis=0)


def borders(half: np.ndarray, codewords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's codeword, and its squared distance from the border to every other codeword's region."""
    d = ((half[:, None, :] - codewords[None, :, :]) ** 2).sum(2)
    near = d.argmin(1)
    apart = np.sqrt(((codewords[:, None, :] - codewords[None, :, :]) ** 2).sum(2))
    apart[apart == 0] = np.inf
    margin = np.maximum(0.0, d - d[np.arange(len(d)), near][:, None]) / (2 * apart[near])
    return near, margin**2


def multi_sequence(first: np.ndarray, second: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Pairs of codewords in order of the sum of their squared margins, up to ``reach``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap, seen = [(x[0] + y[0], 0, 0)], {(0, 0)}
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > reach:
            return
        yield int(a[i]), int(b[j])
        for k, m in ((i + 1, j), (i, j + 1)):
            if k < len(x) and m < len(y) and (k, m) not in seen:
                seen.add((k, m))
                heapq.heappush(heap, (x[k] + y[m], k, m))


def traversal_reach(dims: int, recall: float | None) -> float:
    """Sum of squared margins at which a traversal stops."""
    whole = 2 * (1 - COSINE) + 1e-9
    return whole if recall is None else min(whole, -2 * math.log(1 - recall) * whole / dims)


def filed(nodes: DataFrame, books: dict[int, tuple[np.ndarray, np.ndarray]], recall: float | None) -> DataFrame:
    """Each node's cell and the cells it visits, of those its own or later ones: a pair is met once."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.num_columns - 1)
            lengths, flat = np.asarray(column.value_lengths()), np.asarray(column.flatten(), np.float64)
            starts = np.cumsum(lengths, dtype=np.int64) - lengths
            cells, visits = np.zeros(batch.num_rows, np.int64), [[]] * batch.num_rows
            for dims in np.unique(lengths).tolist():
                (first, second), reach = books[dims], traversal_reach(dims, recall)
                half, wide, rows = first.shape[1], len(second), np.flatnonzero(lengths == dims)
                for at in range(0, len(rows), 256):
                    some = rows[at : at + 256]
                    x = flat[starts[some][:, None] + np.arange(dims)]
                    x = x / np.linalg.norm(x, axis=1)[:, None]
                    i, near = borders(x[:, :half], first)
                    j, nearer = borders(x[:, half:], second)
                    own = cells[some] = dims * GRID + i * wide + j
                    for r, row in enumerate(some):
                        visits[row] = [c for p, q in multi_sequence(near[r], nearer[r], reach) if (c := dims * GRID + p * wide + q) >= own[r]]
            numbers = pa.array([c for v in visits for c in v], pa.int64())
            made = [pa.array(cells), list_array(numbers, [len(v) for v in visits])]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(batch.num_columns)] + made, names=[*batch.schema.names, "cell", "visits"])

    source = nodes.select("node", "copies", "vector")
    kind = nodes.schema["vector"].dataType.simpleString()
    return source.mapInArrow(run, f"node bigint, copies bigint, vector {kind}, cell bigint, visits array<bigint>")


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """Link counts by node, and a spanning forest of links, for one block of a cell."""
    asks = rows["asks"].to_numpy()
    node, copies, own = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["own"].to_numpy()
    x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    norms = np.linalg.norm(x, axis=1)
    q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
    yes = (x[q] @ x[m].T) / (norms[q][:, None] * norms[m][None, :]) >= COSINE
    # Within the cell itself a pair is met from both sides: the smaller node asks.
    yes &= (own[q][:, None] != rows["cell"].iloc[0]) | (node[q][:, None] < node[m][None, :])
    found = np.argwhere(yes)
    kept = forest(len(rows), np.column_stack([q[found[:, 0]], m[found[:, 1]]]))
    counts = [(node[q], yes @ copies[m]), (node[m], yes.T @ copies[q])]
    out = [pd.DataFrame({"u": n[c > 0], "v": None, "n": c[c > 0]}) for n, c in counts]
    out.append(pd.DataFrame({"u": [node[a] for a, _ in kept], "v": [node[b] for _, b in kept], "n": None}))
    return pd.concat(out).astype({"u": "Int64", "v": "Int64", "n": "Int64"})


def codebooks(nodes: DataFrame, counts: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, codewords of both halves, fitted on that length's share of the sample."""
    total = sum(counts.values())
    lengths = nodes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(SAMPLE) * F.col("n") / total, F.lit(LEAST)) / F.col("n")
    shares = lengths.select("d", F.greatest(F.lit(1), (1_000_000 * F.least(F.lit(1.0), share)).cast("int")).alias("most"))
    sample = nodes.join(F.broadcast(shares), F.size("vector") == F.col("d")).where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < F.col("most"))
    drawn: dict[int, list] = {}
    for r in sample.orderBy("node").limit(2 * (SAMPLE + LEAST * len(counts))).select("vector").collect():
        drawn.setdefault(len(r["vector"]), []).append(r["vector"])
    books = {}
    for dims, n in counts.items():
        half = max(1, dims // 2)
        x = np.array(drawn.get(dims) or np.ones((1, dims)), np.float64)  # any codeword files a length that no sampled row has
        x = x / np.linalg.norm(x, axis=1)[:, None]
        k = int(min(max(CODEWORDS[0], 2 ** int(math.log2(max(1.0, math.sqrt(n / PER_CELL))))), CODEWORDS[1]))
        books[dims] = kmeans(x[:, :half], min(k, len(x))), kmeans(x[:, half:], min(k, len(x))) if dims > 1 else np.zeros((1, 0))
    return books


def links(nodes: DataFrame, counts: dict[int, int], recall: float | None) -> DataFrame:
    """Link counts (u, n) by node, and the links (u, v) of spanning forests, as a written table.

    Sizes of cells go to the vectors, so a vector is shuffled once, to the blocks it meets, and
    no task gets a whole cell.
    """
    books = codebooks(nodes, counts)
    placed, path = staged(filed(nodes, books, recall), "filed")
    asking = placed.select("node", "copies", F.col("cell").alias("own"), "vector", F.explode("visits").alias("cell"))
    parts = lambda c: F.ceil(F.count("*") / BLOCK).cast("int").alias(c)
    held = placed.groupBy("cell").agg(parts("member_parts"))
    asked = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(parts("query_parts"))
    sizes = held.join(asked, "cell")
    if sum(len(first) * len(second) for first, second in books.values()) <= CELLS:
        sizes = F.broadcast(sizes)
    part = lambda of: F.pmod(F.xxhash64("node", "cell"), F.col(of)).cast("int")
    rest = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    members = placed.join(sizes, "cell").select("cell", part("member_parts").alias("m"), rest("query_parts").alias("q"), F.lit(False).alias("asks"), "node", "copies", F.col("cell").alias("own"), "vector")
    queries = asking.join(sizes, "cell").select("cell", rest("member_parts").alias("m"), part("query_parts").alias("q"), F.lit(True).alias("asks"), "node", "copies", "own", "vector")
    both = members.union(queries)
    found, _ = staged(both.groupBy("cell", "m", "q").applyInPandas(_block, "u bigint, v bigint, n bigint"), "links")
    drop_path(nodes.sparkSession, path)
    return found


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", recall: float | None = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept."""
    sound, _ = staged(usable(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    nodes = sound.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first("vector").alias("vector"))
    nodes, _ = staged(nodes, "nodes")
    lengths = {r["d"]: r["n"] for r in nodes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not lengths:
        return sound.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = links(nodes, lengths, recall)
    counts = found.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(found.where("v IS NOT NULL").select("u", "v"))
    placed = nodes.select("node", "copies", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size"))
    known = hot_join(placed, smallest, "root", "node", "size").join(counts, "node", "left").select("node", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    # Copies of a vector are one node, whose rows are met in parts.
    met = hot_join(sound.where("node IS NOT NULL").select("vec_id", "node", "row"), known, "node", "row", "copies").select("vec_id", "n_links", "component_id")
    none = sound.where("node IS NULL").select("vec_id", F.lit(None).cast("bigint").alias("n_links"), F.lit(None).cast(sound.schema["vec_id"].dataType).alias("component_id"))
    out = met.union(none)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}),
r(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.v, r.seen FROM r JOIN l ON l.u = r.node),
k AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
c AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN k ON node = vec_id LEFT JOIN c ON u = vec_id
"""
