"""Incremental jobs as Structured Streaming queries. Progress lives in the checkpoint, so a stopped job resumes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType



def stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files of a folder as they arrive; each is read once."""
    return spark.readStream.schema(schema).parquet(path)


def available_now(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived since the last run, then stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stale(vector: Column, model: Column, current: str) -> Column:
    """Rows without a vector, or with one of another model."""
    return vector.isNull() | ~model.eqNullSafe(F.lit(current))


def incremental(df: DataFrame, embed: Callable[[DataFrame], DataFrame], current: str, path: str, checkpoint: str) -> StreamingQuery:
    """Embed only new or stale rows; each batch is written under its number, so a repeated one overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        embed(batch.where(stale(F.col("embedding"), F.col("model"), current))).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed_upserts(df: DataFrame, keys: list[str], at: str, path: str, checkpoint: str) -> StreamingQuery:
    """A table of the newest row by key, whatever the order of arrival; of equal times the later batch wins.

    Each batch writes the next version, ``current`` finds the last whole one, and versions before the one
    that a reader may still hold are removed. A repeated batch overwrites its own version.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        old = current(spark, path, before=number)
        both = batch.withColumn("__new", F.lit(1))
        both = both if old is None else both.unionByName(old.select(*batch.columns).withColumn("__new", F.lit(0)))
        rest = F.struct(*[c for c in batch.columns if c not in keys])
        newest = both.groupBy(*keys).agg(F.max_by(rest, F.struct(at, "__new")).alias("r")).select(*keys, "r.*")
        newest.write.mode("overwrite").parquet(f"{path}/v={number}")
        fs, versions = _versions(spark, path)
        for n in sorted(v for v in versions if v < number)[:-1]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={n}"), True)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str):
    """The file system of a versioned table and its whole versions: those whose writing ended."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    whole = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return fs, [int(n[2:]) for n in whole]


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last whole version of a table that ``keyed_upserts`` keeps (before a batch's own), or None."""
    versions = [v for v in _versions(spark, path)[1] if before is None or v < before]
    return spark.read.parquet(f"{path}/v={max(versions)}") if versions else None


def once_each(notices: DataFrame, at: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first of equal notifications within the watermark: state is dropped once they can't repeat."""
    return notices.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def by_window(events: DataFrame, received: str, sent: str, keys: list[str], width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Counts by window of effective time, which is the receipt where there is one; late rows count up to the delay."""
    dated = events.withColumn("effective", F.coalesce(received, sent)).withWatermark("effective", delay)
    counts = dated.groupBy(F.window("effective", width), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), *keys, "n")


def stalled(updates: DataFrame, minutes: int = 120) -> DataFrame:
    """Jobs (job_id, status, ts) that run without an update for longer than ``minutes`` of event time."""

    def watch(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, running = state.get
            state.remove()
            if running:
                yield pd.DataFrame({"job_id": [key[0]], "last_update": [pd.Timestamp(last, unit="ms")]})
            return
        last, running = state.get if state.exists else (-1, False)
        for part in rows:
            newest = part.loc[part["ts"].idxmax()]
            at = int(newest["ts"].timestamp() * 1000)
            if at >= last:
                last, running = at, newest["status"] == "running"
        state.update((last, running))
        state.setTimeoutTimestamp(max(last + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    return (
        updates.withWatermark("ts", "0 seconds")
        .groupBy("job_id")
        .applyInPandasWithState(watch, "job_id bigint, last_update timestamp", "last bigint, running boolean", "append", GroupStateTimeout.EventTimeTimeout)
    )
