"""Helpers that the training-data operators share.

Words come in two kinds, both after lower-casing A-Z alone: runs of anything but
ASCII white space (``space_words``), and runs of ASCII letters, digits and
non-ASCII characters (``plain_words``).
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to a batch function at once hold about this many bytes.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch of texts: the session's default of 10,000 long texts is too much for a task.
BATCH_ROWS = 2000

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, most: int = BATCH_ROWS) -> None:
    """Let the session hand over texts in batches of at most ``most`` rows."""
    # It stays set: plans are run after this returns.
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def regrouped(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Small batches of numbers joined into larger ones."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def space_words(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


def plain_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(_PLAIN).split()


def hash_words(words: Sequence[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    from pandas.util import hash_array

    if not len(words):
        return np.empty(0, np.uint64)
    out = np.empty(len(words), dtype=object)
    out[:] = words
    return hash_array(out, categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own checkpoint folder.

    Where a session on one machine (a test) has neither, a temporary one is set; a cluster must name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = own.get() if own.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="ledgerwood-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark itself uses for it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, name: str, keep: bool = True, codec: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage in a form that survives lost executors. The files go when
    the driver ends, or earlier by ``drop_path``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    atexit.register(_quietly_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps: it does so when their handles are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _quietly_drop(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone when the driver ends
        pass


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``size`` bytes of text each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    start, ends = 0, np.cumsum(sizes)
    while start < len(sizes):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def with_text_columns(
    df: DataFrame,
    text_col: str,
    fields: str,
    make: Callable[[], Callable[[list[str | None]], list[pa.Array]]],
    keep: Sequence[str],
    where: Callable[[list[pa.Array]], np.ndarray] | None = None,
) -> DataFrame:
    """The columns ``keep`` plus ``fields`` computed from whole texts, row by row.

    ``make`` runs once in each task and returns a function from a list of texts to
    one Arrow array per field. A kept column named like a field gives way to it.
    ``where`` gets those arrays and returns a mask of the rows to keep, so that a
    filter needs no join. Rows are never moved between tasks.
    """
    names = [f.strip().split()[0] for f in _split_fields(fields)]
    keep = [c for c in keep if c not in names]
    bound_batches(df.sparkSession)
    own = keep.index(text_col) if text_col in keep else len(keep)
    source = df.select(*[F.col(f"`{c}`") for c in keep], *([F.col(f"`{text_col}`").alias("__text")] if own == len(keep) else []))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]] + [fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(own)
            for start, stop in slices(texts):
                made = work(texts.slice(start, stop - start).to_pylist())
                out = [batch.column(i).slice(start, stop - start) for i in range(len(keep))] + list(made)
                got = pa.RecordBatch.from_arrays(out, names=[*keep, *names])
                yield got.filter(pa.array(where(made))) if where else got

    return source.mapInArrow(run, schema)


def packed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The text, and all columns as one struct ``row``: extra columns can't clash with new ones."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def _split_fields(fields: str) -> list[str]:
    """Split a DDL string at its outer commas."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(fields[last:i])
            last = i + 1
    return [*parts, fields[last:]]


def list_array(values: np.ndarray | pa.Array, lengths: Sequence[int]) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


def bucket_of(doc_id: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n: the split that held-out rows follow."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; LEDGERWOOD_TOKENIZERS overrides the folder."""
    if folder := os.environ.get("LEDGERWOOD_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
