"""Steps that depend on the step before: ordered folds by key, in batch, with one state a key at a time.

Rows are dealt by key and sorted; a task then walks over its rows in Arrow batches, so a hot key costs time
but never memory. The same step functions serve the streaming jobs (``streaming.machines``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: From a state (None at first) and a row to the next state and what the row gets.
Step = Callable[[Any, dict], tuple[Any, dict]]


def folded(rows: DataFrame, key: str, order: list[str], step: Step, fields: str) -> DataFrame:
    """All columns of ``rows`` and ``fields``, which the step gives each row in its key's order. Null keys are a key."""
    made: StructType = _parse_datatype_string(fields)
    whole = StructType([*rows.schema.fields, *made.fields])
    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    names, arrow = made.names, to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Any = object()
        state: Any = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != held:
                    held, state = row[key], None
                state, got = step(state, row)
                out.append(got)
            columns = [pa.array([o[n] for o in out], arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return dealt.mapInArrow(run, whole)


def cooled(interval: int, at: str = "ts") -> Step:
    """What passes: a row at least ``interval`` seconds after the last one that passed. The others are told when that was."""

    def step(last: Any, row: dict) -> tuple[Any, dict]:
        now = row[at]
        passes = last is None or (now - last).total_seconds() >= interval
        return (now if passes else last), {"passes": passes, "last_passed": last}

    return step


def arbitrated(lifetime: int, at: str = "ts") -> Step:
    """One active job a key. A row asks for a job (``asks``), or says that the active one has ended.

    A request gets a new job of its own number, or the number of the job that is active. A job without a word
    for ``lifetime`` seconds is taken for dead, and the next request replaces it. A request keeps a job alive.
    """

    def step(job: Any, row: dict) -> tuple[Any, dict]:
        now = row[at]
        if job is not None and (now - job["at"]).total_seconds() > lifetime:
            job = None
        if not row["asks"]:
            return None, {"job_id": job and job["id"], "is_new": False}
        is_new = job is None
        job = {"id": row["request_id"] if is_new else job["id"], "at": now}
        return job, {"job_id": job["id"], "is_new": is_new}

    return step
