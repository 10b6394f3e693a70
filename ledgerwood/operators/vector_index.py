"""Nearest vectors over a stored index of cells, many queries in one plan, filters before the ranking.

Vectors are made unit vectors and filed under the nearest of k centres (Spark's k-means over a bounded sample);
the table is partitioned by cell. A query reads the cells of its nearest centres only: Spark prunes the folders by
the queries' cells at run time. ``probes=None`` reads all cells, which is the exact answer.

Rows and queries meet in groups of bounded numbers of both, where their products are one matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .retrieval import MAX_DISTANCE

#: Vectors that centres are fitted on, at most about; vectors of a cell, about; cells.
SAMPLE, PER_CELL, MOST_CELLS = 50_000, 1000, 1024
PROBES = 8
#: Queries of a block, and rows of a part, about.
AT_ONCE, ROWS_AT_ONCE = 4096, 16_384
#: Products that a task holds at once; what sums in another order can differ by, and more.
PRODUCTS, SLACK = 1 << 20, 1e-9


def matrix(lists: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of ``dims`` numbers as rows; null components are NaN."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def sums(products: Callable[[int], np.ndarray], dims: int) -> np.ndarray:
    """One component after another, so that equal vectors have equal sums wherever they stand."""
    out = products(0)
    for i in range(1, dims):
        out = out + products(i)
    return out


def units(df: DataFrame, vector: str, dims: int, centres: list[list[float]] | None = None, most: int = 1) -> DataFrame:
    """Rows with the vector over its length; those without one, or with null or non-finite components, are left out.

    With ``centres`` rows get ``cells``, the places of the ``most`` nearest ones, nearest first.
    """
    fields = [T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == vector else f.dataType) for f in df.schema.fields]
    schema = T.StructType([*fields, *([T.StructField("cells", T.ArrayType(T.IntegerType()))] if centres is not None else [])])
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if centres is None else np.array(centres, np.float64)
        for whole in batches:
            for start in range(0, whole.num_rows, max(1, PRODUCTS // max(dims, len(known) if known is not None else 1))):
                batch = whole.slice(start, max(1, PRODUCTS // max(dims, len(known) if known is not None else 1)))
                v = matrix(batch.column(at), dims)
                with np.errstate(all="ignore"):
                    largest = np.abs(v).max(axis=1)
                    ok = np.isfinite(largest) & (largest > 0)
                    scaled = v[ok] / largest[ok, None]
                    own = scaled / np.sqrt(sums(lambda i: scaled[:, i] * scaled[:, i], dims))[:, None]  # noqa: B023
                kept = batch.filter(pa.array(ok))
                columns = kept.columns
                columns[at] = _lists(own)
                if known is not None:
                    # |v - c|^2 without |v|^2, which is the same for all.
                    far = (known * known).sum(axis=1) - 2 * (own @ known.T)
                    columns.append(_lists(np.argsort(far, axis=1, kind="stable")[:, :most].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.where(F.size(vector) == dims).mapInArrow(run, schema)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))


@dataclass
class VectorIndex:
    rows: DataFrame
    centres: list[list[float]]


def write_vectors(vectors: DataFrame, path: str, id_col: str, vector_col: str, dims: int, keep: tuple[str, ...] = (), cells: int | None = None, seed: int = 7) -> VectorIndex:
    """Write the index of all vectors of ``dims`` components; ``keep`` names columns to filter by. Others are left out."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), *keep)
    own = units(given, "vector", dims)
    n = own.count()
    k = min(cells or max(1, min(MOST_CELLS, n // PER_CELL)), max(1, n))
    centres = [[0.0] * dims]
    if n and k > 1:
        part = 1_000_000
        sample = own.select("vector").where(F.pmod(F.xxhash64("vector"), F.lit(part)) < min(part, int(part * SAMPLE / n)))
        # Written, as k-means goes over it many times.
        sample.write.parquet(f"{path}-sample")
        points = spark.read.schema("vector array<double>").parquet(f"{path}-sample").select(array_to_vector("vector").alias("features"))
        centres = [[float(x) for x in c] for c in KMeans(k=k, seed=seed, maxIter=10).fit(points).clusterCenters()]
    filed = units(given, "vector", dims, centres).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")
    filed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(path)
    spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}-centres")
    return open_vectors(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in filed.schema.fields))


def open_vectors(spark: SparkSession, path: str, schema: str) -> VectorIndex:
    centres = [r["centre"] for r in spark.read.parquet(f"{path}-centres").orderBy("cell").collect()]  # MOST_CELLS at most
    return VectorIndex(spark.read.schema(schema).parquet(path), centres)


def nearest(index: VectorIndex, queries: DataFrame, k: int = 50, probes: int | None = PROBES, where: Column | None = None, most_distance: float = MAX_DISTANCE) -> DataFrame:
    """(query_id, id, score, rank) of each query's k nearest; ``queries`` is (query_id, vector).

    A cell's rows are dealt to parts and its queries to blocks; each part meets each block. In the exact way all is one cell.
    """
    dims, exact = len(index.centres[0]), probes is None or probes >= len(index.centres)
    rows = index.rows if where is None else index.rows.where(where)
    asked = units(queries.select("query_id", "vector"), "vector", dims, index.centres, 1 if exact else probes)
    if exact:
        rows, asked = rows.withColumn("cell", F.lit(0)), asked.withColumn("cell", F.lit(0))
    else:
        asked = asked.withColumn("cell", F.explode("cells"))
    number = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count("*") / most).alias(name))
    # One row a cell, MOST_CELLS at most.
    sizes = F.broadcast(number(asked, AT_ONCE, "blocks").join(F.broadcast(number(rows, ROWS_AT_ONCE, "parts")), "cell"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    dealt = rows.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").alias("part"), all_of("blocks").alias("block"), "id", "vector")
    met = asked.join(sizes, "cell").select("cell", all_of("parts").alias("part"), F.pmod(F.xxhash64("query_id"), "blocks").alias("block"), "query_id", F.col("vector").alias("asked"))
    kinds = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", index.rows.schema["id"].dataType), T.StructField("score", T.DoubleType())]
    names = ("cell", "part", "block")
    scored = dealt.groupBy(*names).cogroup(met.groupBy(*names)).applyInArrow(_best(k, most_distance, dims), T.StructType(kinds))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _best(k: int, most_distance: float, dims: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest rows of a part to each query of a block."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        v, q = matrix(rows["vector"], dims), matrix(asked["asked"], dims)
        n = len(v)
        place = np.empty(n, np.int64)
        place[np.asarray(pc.sort_indices(rows["id"]))] = np.arange(n)
        found = []
        step = max(1, PRODUCTS // max(1, n))
        for start in range(0, len(q) if n else 0, step):
            some = q[start : start + step]
            near = some @ v.T
            # The matrix only rules rows out: its sums are in an order of its own.
            least = np.full(len(some), 1 - most_distance)
            if n > k:
                least = np.maximum(least, np.partition(near, n - k, axis=1)[:, n - k])
            i, j = np.nonzero(near >= least[:, None] - SLACK)
            score = sums(lambda c: some[i, c] * v[j, c], dims)  # noqa: B023
            ok = 1 - score <= most_distance
            i, j, score = i[ok], j[ok], score[ok]
            order = np.lexsort((place[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.searchsorted(i, i)  # where each query's rows begin
            ok = np.arange(len(i)) - first < k
            found.append((i[ok] + start, j[ok], score[ok]))
        i, j, score = (np.concatenate([f[c] for f in found]) if found else np.empty(0, t) for c, t in enumerate((np.int64, np.int64, np.float64)))
        return pa.table([asked["query_id"].take(pa.array(i)), rows["id"].take(pa.array(j)), pa.array(score)], names=["query_id", "id", "score"])

    return run
