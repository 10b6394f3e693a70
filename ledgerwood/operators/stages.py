"""The processing of a document version as a state machine over its log of commands.

A version goes through STAGES in order. Three of them apply only where the document or the installation asks for them.
Commands come in the order of time; each is accepted or refused with a reason, and what follows (where to resume, how far
it is, the version's status) is read from the state alone, so a log can be replayed from anywhere.

* start: the stage named, or the one to resume at; refused if cancelled, if it doesn't apply, or before an earlier one has ended
* complete, fail: the running stage
* skip: a conditional stage
* detect: which conditional stages apply; pending ones that don't are skipped
* retry: the failed stage becomes pending, and a cancellation is lifted
* reset: a stage and all after it begin anew (reprocessing), and a cancellation is lifted
* cancel: refused once the version is complete, failed or cancelled
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import folded

# The stages in their order, and those that apply only on a condition.
STAGES = [
    "validate", "analyse", "extract_text", "ocr", "classify_pages", "detect_clauses", "extract_tables", "assemble_sections", "chunk", "embed", "index",
    "validate_quality",
]
CONDITIONAL = ["ocr", "extract_tables", "embed"]
#: Letters of a stage's status: pending, running, completed, skipped, failed.
PENDING, RUNNING, COMPLETED, SKIPPED, FAILED = "prcsf"
DONE = (COMPLETED, SKIPPED)

#: A state as it is kept: statuses by stage, attempts, times of the last start, conditions that hold, whether it is cancelled.
EMPTY = {"statuses": PENDING * len(STAGES), "attempts": [0] * len(STAGES), "began": [None] * len(STAGES), "applies": "000", "cancelled": False}


def _required(state: dict, stage: int) -> bool:
    name = STAGES[stage]
    return name not in CONDITIONAL or state["applies"][CONDITIONAL.index(name)] == "1"


def _first(state: dict, letter: str) -> int | None:
    at = state["statuses"].find(letter)
    return None if at < 0 else at


def resume_point(state: dict) -> int | None:
    """A running stage, else a failed one, else the next to run; None where there is nothing to do."""
    for letter in (RUNNING, FAILED):
        if (at := _first(state, letter)) is not None:
            return at
    if state["cancelled"]:
        return None
    return next((i for i, s in enumerate(state["statuses"]) if s not in DONE and _required(state, i)), None)


def is_complete(state: dict) -> bool:
    return all(s in DONE for i, s in enumerate(state["statuses"]) if _required(state, i))


def status_of(state: dict) -> str:
    if state["cancelled"]:
        return "cancelled"
    if FAILED in state["statuses"]:
        return "failed"
    return "completed" if is_complete(state) else "processing"


def progress(state: dict) -> int:
    """Whole percent of the stages that apply."""
    own = [s in DONE for i, s in enumerate(state["statuses"]) if _required(state, i)]
    return (200 * sum(own) + len(own)) // (2 * len(own))


def _refusal(state: dict, command: str, stage: int | None) -> str | None:
    if command == "start":
        if state["cancelled"]:
            return "cancelled"
        if stage is None:
            return "nothing to do"
        if not _required(state, stage):
            return "does not apply"
        if any(s not in DONE and _required(state, i) for i, s in enumerate(state["statuses"][:stage])):
            return "blocked"
    elif command in ("complete", "fail"):
        return "nothing runs" if stage is None else None
    elif command == "skip":
        return None if STAGES[stage] in CONDITIONAL else "not conditional"
    elif command == "retry":
        return "not failed" if stage is None else None
    elif command == "cancel":
        return "already finished" if status_of(state) != "processing" else None
    return None


def machine(state: Any, row: dict) -> tuple[dict, dict]:
    """One command (``command``, ``stage`` as a number from 0 or None, ``applies``, ``ts``) on a version's state."""
    old = state or EMPTY
    command, stage = row["command"], row["stage"]
    if command in ("complete", "fail"):
        stage = _first(old, RUNNING)
    elif command == "retry":
        stage = _first(old, FAILED)
    elif command == "start" and stage is None:
        stage = resume_point(old)
    reason = _refusal(old, command, stage)
    new = {**old, "attempts": list(old["attempts"]), "began": list(old["began"])}
    statuses = list(old["statuses"])
    if reason is None:
        if command == "start":
            statuses[stage] = RUNNING
            new["attempts"][stage] += 1
            new["began"][stage] = row["ts"]
        elif command in ("complete", "fail", "skip"):
            statuses[stage] = {"complete": COMPLETED, "fail": FAILED, "skip": SKIPPED}[command]
        elif command == "detect":
            new["applies"] = row["applies"]
            for i, s in enumerate(statuses):
                if s == PENDING and not _required(new, i):
                    statuses[i] = SKIPPED
        elif command == "retry":
            statuses[stage] = PENDING
            new["cancelled"] = False
        elif command == "reset":
            for i in range(stage, len(STAGES)):
                statuses[i], new["attempts"][i], new["began"][i] = PENDING, 0, None
            new["cancelled"] = False
        elif command == "cancel":
            new["cancelled"] = True
    new["statuses"] = "".join(statuses)
    after = resume_point(new)
    began = new["began"][stage] if stage is not None and command in ("complete", "fail") and reason is None else None
    return new, {
        "on_stage": None if stage is None else STAGES[stage], "refused": reason, "attempt": None if stage is None else new["attempts"][stage],
        "seconds": None if began is None else int((row["ts"] - began).total_seconds()), "statuses": new["statuses"], "status": status_of(new),
        "resume_at": None if after is None else STAGES[after], "progress": progress(new),
    }


FIELDS = "on_stage string, refused string, attempt int, seconds bigint, statuses string, status string, resume_at string, progress int"


def replayed(commands: DataFrame, key: str = "version", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Every command with what became of it, and the state of its version after it."""
    return folded(commands, key, list(order), machine, FIELDS)


def stage_log(log: DataFrame) -> DataFrame:
    """One row per attempt that ended: how, and how long it took."""
    return log.where(F.col("command").isin("complete", "fail") & F.col("refused").isNull())


def current(log: DataFrame, key: str = "version", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Each version's last state: its status, where it resumes, how far it is."""
    last = F.max_by(F.struct("statuses", "status", "resume_at", "progress"), F.struct(*order)).alias("s")
    return log.groupBy(key).agg(last, F.count("*").alias("commands"), F.count("refused").alias("refusals")).select(key, "s.*", "commands", "refusals")
