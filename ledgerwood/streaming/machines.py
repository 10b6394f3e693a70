"""Ordered steps by key as streaming queries, and effects that are delivered once.

``stepped`` runs a step function of ``operators.folds`` or ``operators.stages`` over a stream, its state in Spark's
store: a restarted query goes on where the last whole batch ended. The rows of a key within a batch are put in order.

``delivered`` is an outbox: what each listener is owed is recorded by batch and key before it is called, and what it
got afterwards, so a repeated or a later batch doesn't deliver a key twice.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructType, _parse_datatype_string

from ..operators.folds import Step

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Stepper(StatefulProcessor):
    def __init__(self, step: Step, order: list[str], columns: list[str], whole: list[str], made: list[str], at: str, lifetime: int | None):
        self.step, self.order, self.columns, self.whole, self.made, self.at, self.lifetime = step, order, columns, set(whole), made, at, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "held binary")

    def _plain(self, name: str, value: Any) -> Any:
        if pd.isna(value):
            return None
        if isinstance(value, pd.Timestamp):
            return value.to_pydatetime()
        return int(value) if name in self.whole else value

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else None  # noqa: S301  written below
        frame = pd.concat(list(rows)).sort_values(self.order)
        out = []
        for values in frame[self.columns].itertuples(index=False, name=None):
            row = {n: self._plain(n, v) for n, v in zip(self.columns, values, strict=True)}
            state, made = self.step(state, row)
            out.append({**row, **made})
        self.state.update((pickle.dumps(state),))
        if self.lifetime is not None:
            last = int(pd.Timestamp(frame[self.at].max()).timestamp() * 1000)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(last + 1000 * self.lifetime, timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame({n: pd.Series([r[n] for r in out], dtype=object) for n in [*self.columns, *self.made]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()  # nothing that comes within the watermark needs it
        return iter(())

    def close(self) -> None:
        pass


def stepped(rows: DataFrame, key: str, order: list[str], step: Step, fields: str, at: str = "ts", lifetime: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """All columns of a stream and ``fields``. With ``lifetime`` (seconds of event time), a silent key's state is dropped."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    made = _parse_datatype_string(fields)
    whole = [f.name for f in rows.schema.fields if isinstance(f.dataType, IntegralType)]
    out = StructType([*rows.schema.fields, *made.fields])
    timed = rows.withWatermark(at, delay) if lifetime is not None else rows
    processor = _Stepper(step, order, rows.columns, whole, made.names, at, lifetime)
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="eventTime" if lifetime is not None else "none")


Listener = Callable[[DataFrame, int], None]


def delivered(done: DataFrame, key: str, listeners: dict[str, Listener], path: str, checkpoint: str) -> StreamingQuery:
    """Call each listener once for every key of a stream, whatever is repeated, restarted or redelivered.

    A listener gets its rows and the number of the batch, by which it can tell a call that was cut off. One that fails
    stops the query after the others had their turn; a restart calls it for what it is still owed.
    """
    spark = done.sparkSession

    def got(name: str) -> DataFrame:
        return spark.read.schema(f"`{key}` {done.schema[key].dataType.simpleString()}, batch bigint").parquet(f"{path}/got/{name}")

    for name in listeners:  # so that a ledger can be read before anything is in it
        spark.createDataFrame([], f"`{key}` {done.schema[key].dataType.simpleString()}").write.mode("append").parquet(f"{path}/got/{name}/batch=-1")

    def deliver(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/owed/batch={number}")
        owed = spark.read.schema(done.schema).parquet(f"{path}/owed/batch={number}")
        failed = []
        for name, listener in listeners.items():
            rest = owed.join(got(name).where(F.col("batch") != number).select(key), key, "left_anti")
            if number in {r["batch"] for r in got(name).where(F.col("batch") == number).select("batch").limit(1).collect()}:
                continue  # this batch was delivered to it before a restart
            try:
                listener(rest, number)
            except Exception as e:  # noqa: BLE001  the others are still called
                failed.append((name, e))
                continue
            rest.select(key).write.mode("overwrite").parquet(f"{path}/got/{name}/batch={number}")
        if failed:
            raise RuntimeError(f"listeners failed: {[n for n, _ in failed]}") from failed[0][1]

    return done.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
