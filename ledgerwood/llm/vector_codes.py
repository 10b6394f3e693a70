"""Vector code compression: product codes of integer vectors, nearest entries found by segment-mean lower bounds.

Components become whole numbers, floor(SCALE * x), and a vector is cut into PARTS consecutive parts. Each
part position has a codebook of ENTRIES entries, refined over ROUNDS rounds; a vector's code is the nearest
entry of each part. All distances and means are whole numbers, so codes depend on nothing but the rows.

A nearest entry is searched from coarse to fine: a part's mean and the norm of what it leaves bound the
distance from below, first of the whole part, then of its halves, quarters and so on. An entry is dropped only
where the bound, less what rounding could add, exceeds a distance that is known exactly; what is
left is measured in whole numbers.

A round is one pass over the vectors: tasks sum the parts of each entry, and sums of each component are
added up by Spark. The driver holds codebooks alone: ENTRIES vectors of each length.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. A vector of
a number of components that PARTS doesn't divide is cut as evenly as it goes, longer parts first. Vectors of
each length have codebooks of their own (and a digest of their own). With fewer rows than ENTRIES a codebook
has as many entries as rows. Of rows with one id the lesser vector is the first, null ids come last. Repeated
rows are each coded and counted. An error beyond a long is given as the largest long. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, staged, table
from .graph import hot_join

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = (1 << 63) - 1
#: Beyond this a sum of squares could leave 63 bits: Python's whole numbers take over.
WIDE = 1 << 25
#: Vectors worked on together.
AT_ONCE = 4096
#: Labels whose sums are sent to all tasks: 16 bytes each, and their label.
LABELS = 100_000

Codebooks = dict[int, list[np.ndarray]]


def part_bounds(dims: int) -> list[tuple[int, int]]:
    """Where each part of a vector begins and ends."""
    sizes = [dims // PARTS + (k < dims % PARTS) for k in range(PARTS)]
    ends = np.cumsum(sizes).tolist()
    return [(e - s, e) for s, e in zip(sizes, ends, strict=True)]


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); as Python's whole numbers where 64 bits might not hold what is made of them."""
    if not x.size or float(np.abs(x).max()) < WIDE / SCALE:
        return np.floor(x * SCALE).astype(np.int64)  # exact: SCALE is a power of two
    out = np.empty(x.shape, object)
    for at, v in np.ndenumerate(x):
        n, d = float(v).as_integer_ratio()
        out[at] = SCALE * n // d
    return out


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=1)


def levels(dims: int) -> list[list[tuple[int, int]]]:
    """Blocks of a part, from the whole of it to halves of pairs of components."""
    out, n = [], 1
    while n == 1 or n <= dims // 2:
        edges = [round(dims * k / n) for k in range(n + 1)]
        out.append(list(zip(edges, edges[1:])))
        n *= 2
    return out


def summary(x: np.ndarray, blocks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each block, its mean times the root of its size, and the norm of what the mean leaves."""
    means = np.stack([x[:, a:b].mean(axis=1) for a, b in blocks], axis=1)
    rest = np.stack([np.sqrt(((x[:, a:b] - x[:, a:b].mean(axis=1, keepdims=True)) ** 2).sum(axis=1)) for a, b in blocks], axis=1)
    return means * np.sqrt([b - a for a, b in blocks]), rest


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row (the lower of equal ones), its squared distance, and how many distances were computed."""
    n, k = len(x), len(entries)
    if not x.shape[1] or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    if x.dtype == object or entries.dtype == object:
        x, entries = x.astype(object), entries.astype(object)
        all_ = np.stack([squared(x, e) for e in entries], axis=1)
        at = all_.argmin(axis=1)
        return at, all_[np.arange(n), at], n * k
    fx, fe = x.astype(np.float64), entries.astype(np.float64)
    size = float((fx * fx).sum(axis=1).max() + (fe * fe).sum(axis=1).max())
    slack = 1e-9 * size  # far above what rounding of either bound can add
    alive, best, best_d, computed = np.ones((n, k), bool), None, None, 0
    for blocks in levels(x.shape[1]):
        (mx, rx), (me, re) = summary(fx, blocks), summary(fe, blocks)
        rows, cols = np.nonzero(alive)
        bound = np.full((n, k), np.inf)
        bound[rows, cols] = ((mx[rows] - me[cols]) ** 2 + (rx[rows] - re[cols]) ** 2).sum(axis=1)
        first = bound.argmin(axis=1)
        if best is None:
            best, best_d = first, squared(x, entries[first])
            computed += n
        else:
            other = np.flatnonzero(first != best)
            d = squared(x[other], entries[first[other]])
            computed += len(other)
            less = other[d < best_d[other]]
            best[less], best_d[less] = first[less], d[d < best_d[other]]
        # An equal distance at a lower index must stay, hence only what is surely farther goes.
        alive &= bound <= (best_d + slack)[:, None]
        alive[np.arange(n), best] = True
        if alive.sum() == n:
            return best, best_d, computed
    rows, cols = np.nonzero(alive)
    exact = np.full((n, k), LARGEST, np.int64)
    exact[rows, cols] = squared(x[rows], entries[cols])
    at = exact.argmin(axis=1)
    return at, exact[np.arange(n), at], computed + len(rows)


def sound(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(id, vector, label) of the rows that are coded; the vector as doubles."""
    v = F.col(f"`{vector_col}`")
    ok = v.isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    return vectors.where(ok).select(F.col(f"`{id_col}`").alias("id"), v.cast("array<double>").alias("vector"), label.alias("label"))


def _by_length(batch: pa.RecordBatch, name: str = "vector") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of vector, and their vectors, in parts of AT_ONCE."""
    lists = batch.column(name)
    lengths = np.asarray(lists.value_lengths())
    ends = np.cumsum(lengths)
    flat = np.asarray(lists.flatten())
    for dims in np.unique(lengths):
        rows = np.flatnonzero(lengths == dims)
        for s in range(0, len(rows), AT_ONCE):
            own = rows[s : s + AT_ONCE]
            yield own, flat[(ends[own] - dims)[:, None] + np.arange(dims)]


def first_books(kept: DataFrame) -> Codebooks:
    """Parts of the ENTRIES smallest ids of each length."""
    books = {}
    for r in kept.groupBy(F.size("vector").alias("d")).agg(F.count("*")).orderBy("d").collect():
        rows = kept.where(F.size("vector") == r["d"]).orderBy(F.asc_nulls_last("id"), "vector").limit(ENTRIES).select("vector").collect()
        x = whole(np.array([v["vector"] for v in rows], np.float64).reshape(len(rows), r["d"]))
        books[r["d"]] = [x[:, a:b] for a, b in part_bounds(r["d"])]
    return books


def _sums(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, x.shape[1]), x.dtype)
    np.add.at(out, at, x)
    return out


def _limbs(v: int) -> list[int]:
    """A whole number as limbs of 32 bits, the last one signed; one that fits 50 bits is a limb."""
    if abs(v) < 1 << 50:
        return [v]
    out = []
    while not -(1 << 31) <= v < 1 << 31:
        out.append(v & 0xFFFFFFFF)
        v >>= 32
    return [*out, v]


def refined(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floor of the mean of the parts that are nearest to it."""
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for _, raw in _by_length(batch):
                x, dims = whole(raw), raw.shape[1]
                for part, (a, b) in enumerate(part_bounds(dims)):
                    entries = sent.value[dims][part]
                    at, _, _ = nearest(x[:, a:b], entries)
                    own = [np.bincount(at, minlength=len(entries)), _sums(x[:, a:b], at, len(entries))]
                    held = sums.get((dims, part))
                    # Sums of many rows could pass 63 bits, and Python's whole numbers don't.
                    sums[dims, part] = [own[0], own[1].astype(object)] if held is None else [held[0] + own[0], held[1] + own[1]]
        rows = []
        for (dims, part), (counts, total) in sums.items():
            for entry in np.flatnonzero(counts).tolist():
                rows.append((dims, part, entry, -1, 0, int(counts[entry])))
                rows += [(dims, part, entry, i, limb, v) for i in range(total.shape[1]) for limb, v in enumerate(_limbs(int(total[entry, i])))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["d", "part", "entry", "i", "limb", "v"])

    found = kept.select("vector").mapInArrow(run, "d bigint, part bigint, entry bigint, i bigint, limb bigint, v bigint")
    added = found.groupBy("d", "part", "entry", "i", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    totals: dict[tuple, dict[int, int]] = {}
    for r in added:
        own = totals.setdefault((r["d"], r["part"], r["entry"]), {})
        own[r["i"]] = own.get(r["i"], 0) + (int(r["v"]) << (32 * r["limb"]))
    out = {}
    for dims, parts in books.items():
        out[dims] = []
        for part, entries in enumerate(parts):
            new = [[own[i] // own[-1] for i in range(entries.shape[1])] if (own := totals.get((dims, part, e))) else list(map(int, entries[e])) for e in range(len(entries))]
            fits = all(abs(v) < WIDE for row in new for v in row)
            out[dims].append(np.array(new, np.int64 if fits else object).reshape(entries.shape))
    return out


def digest(parts: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for p in parts for v in p.ravel()).encode()).hexdigest()


def coded(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error, codebooks_sha256) of every row."""
    sent = kept.sparkSession.sparkContext.broadcast(books)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {d: digest(parts) for d, parts in sent.value.items()}
        hexes = np.array([f"{i:02x}" for i in range(ENTRIES)], object)
        for batch in batches:
            codes, errors, digests = (np.empty(batch.num_rows, object) for _ in range(3))
            for rows, raw in _by_length(batch):
                x, dims = whole(raw), raw.shape[1]
                code, error = np.full(len(rows), "", object), np.zeros(len(rows), object)
                for part, (a, b) in enumerate(part_bounds(dims)):
                    at, d, _ = nearest(x[:, a:b], sent.value[dims][part])
                    code, error = code + hexes[at], error + d
                codes[rows], errors[rows], digests[rows] = code, error, names[dims]
            made = [pa.array(codes, pa.string()), pa.array([min(e, LARGEST) for e in errors], pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *made], names=["id", "label", "code", "error", "codebooks_sha256"])

    return kept.select("id", "vector", "label").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint, codebooks_sha256 string")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(id, code, error, label_error, codebooks_sha256) of every row that is kept, and the codebooks."""
    bound_batches(vectors.sparkSession, AT_ONCE)
    kept = sound(vectors, id_col, vector_col, label_col)
    books = first_books(kept)
    for _ in range(rounds):
        books = refined(kept, books)
    rows, _ = staged(coded(kept, books), "vector-codes")
    # A label may be null, which no join meets: a key that can't be.
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label"), F.lit(0).cast(kept.schema["label"].dataType)).alias("label"))
    rows = rows.withColumn("key", key)
    sums = rows.groupBy("key").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("bigint").alias("label_error"), F.count("*").alias("size"))
    if len(sums.limit(LABELS + 1).select("size").collect()) <= LABELS:
        met = rows.join(F.broadcast(sums.drop("size")), "key")
    else:
        met = hot_join(rows.withColumn("spread", F.xxhash64("id", "code")), sums, "key", "spread", "size")
    return met.select("id", "code", "error", "label_error", "codebooks_sha256"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))[0].withColumnRenamed("id", "vec_id")


def _oracle() -> str:
    """All rounds in turn: parts as rows of lists of whole numbers, and one pair of steps a round."""
    steps = [f"""
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * c::DOUBLE) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {ENTRIES})"""]  # fmt: skip
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT r, part, min_by(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (
  SELECT p.r, part, entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT AS d FROM p JOIN b{k} b USING (part)) GROUP BY r, part)""")
        if k < ROUNDS:
            steps.append(f"""
m{k} AS (SELECT part, entry, i, CAST(floor(sum(c)::DOUBLE / count(*)) AS BIGINT) AS f, sum(c)::HUGEINT AS s, count(*) AS n FROM (
  SELECT part, entry, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS c FROM a{k} JOIN p USING (r, part)) GROUP BY part, entry, i),
n{k} AS (SELECT part, entry, list(CASE WHEN f * n > s THEN f - 1 WHEN (f + 1) * n <= s THEN f + 1 ELSE f END ORDER BY i) AS x FROM m{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN n{k} USING (part, entry))""")
    return f"""WITH {",".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
c AS (SELECT r, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (r), h"""


ORACLE = _oracle()
