"""Set-based writes and gates of a claims service: each returns the table as it is afterwards."""

from __future__ import annotations

import ast
import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relations import insert_absent, upsert

# What can be done with a finding, and which of it needs a reason or a new wording.
ACTIONS = ("accept", "amend", "reject")
#: Kinds of files by declared type; what of another kind is detected may still be declared so.
COMPATIBLE = {"application/pdf": ("pdf",), "text/plain": ("text",), "text/csv": ("text",), "image/jpeg": ("jpeg",), "image/png": ("png",), "application/zip": ("zip",), "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ("zip",)}


def soft_deleted(df: DataFrame, hit: Column, at: Column) -> DataFrame:
    """Rows that ``hit`` selects get a time of deletion; one that has one keeps it."""
    return df.withColumn("deleted_at", F.when(hit & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at")))


def restored(df: DataFrame, hit: Column) -> DataFrame:
    return df.withColumn("deleted_at", F.when(~F.coalesce(hit, F.lit(False)), F.col("deleted_at")))


def hard_deleted(df: DataFrame, hit: Column) -> DataFrame:
    return df.where(~F.coalesce(hit, F.lit(False)))


def reviewed(reviews: DataFrame, new: DataFrame) -> DataFrame:
    """Append the valid ones of new reviews (finding_id, action, reason, amended_statement, reviewer_id)."""
    said = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    valid = F.col("action").isin(*ACTIONS) & F.col("reviewer_id").isNotNull() & ((F.col("action") != "reject") | said("reason")) & ((F.col("action") != "amend") | said("amended_statement"))
    return reviews.unionByName(new.where(valid).select(*reviews.columns))


def moved(children: DataFrame, moves: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of moved parents take the parent's new ``column``; each parent moves once."""
    to = moves.groupBy(key).agg(F.max("destination").alias("destination"))
    both = children.join(to, key, "left")
    return both.withColumn(column, F.coalesce("destination", column)).drop("destination").select(*children.columns)


def attached(links: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Links with the new ones; a link that is there already takes the new row's values."""
    return upsert(links, new, keys)


def detached(links: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return links.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def registered(types: DataFrame, new: DataFrame, key: str = "code") -> DataFrame:
    """A registry with new entries; a code that is taken stays as it is."""
    return insert_absent(types, new, [key])


def publishable(bases: DataFrame, most_quarantined: float = 0.1) -> DataFrame:
    """The publish gate over (status, chunks, quarantined): only a ready base with few quarantined chunks is published."""
    sound = (F.col("chunks") > 0) & (F.col("quarantined") <= most_quarantined * F.col("chunks"))
    return bases.withColumns({"publishable": sound, "status_after": F.when((F.col("status") == "ready") & sound, "published").otherwise(F.col("status"))})


def planned(checks: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """An import's dry run: how many rows each check (level, rows) finds, and whether the import can proceed."""
    counted = None
    for code, (level, rows) in checks.items():
        own = rows.agg(F.count("*").alias("hits")).select(F.lit(code).alias("code"), F.lit(level).alias("level"), "hits")
        counted = own if counted is None else counted.unionByName(own)
    stops = counted.agg(F.coalesce(F.max((F.col("level") == "error") & (F.col("hits") > 0)), F.lit(False)).alias("stops"))
    return counted.crossJoin(F.broadcast(stops)).select("code", "level", "hits", (~F.col("stops")).alias("can_proceed"))  # one row beside one


def compatible(declared: Column, detected: Column) -> Column:
    """Whether a declared type fits what was detected; an undeclared one fits all, an unknown one nothing."""
    kind = F.create_map(*[F.lit(x) for d, kinds in COMPATIBLE.items() for x in (d, "|".join(kinds))])
    known = F.try_element_at(kind, F.lower(F.trim(F.split(declared, ";")[0])))
    return F.when(F.coalesce(F.trim(declared), F.lit("")) == "", True).otherwise(F.coalesce(F.array_contains(F.split(known, r"\|"), detected), F.lit(False)))


def rendered(template: str, variables: Mapping[str, Column]) -> Column:
    """A template with {named} places filled in; a place without a variable is an error, a null value gives null."""
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        if name is not None:
            if name not in variables:
                raise KeyError(f"no variable {name!r} for the template")
            parts.append(variables[name].cast("string"))
    return F.concat(*parts)


def skeleton(spark: SparkSession, source: str, filename: str = "<skeleton>") -> DataFrame:
    """(number, title, line) of the literal clause tables in a Python source, which is read and never run."""
    rows = []
    for node in ast.walk(ast.parse(source, filename)):
        if isinstance(node, ast.Dict):
            rows += [(k.value, v.value, k.lineno) for k, v in zip(node.keys, node.values, strict=True) if isinstance(k, ast.Constant) and isinstance(v, ast.Constant) and isinstance(k.value, str) and isinstance(v.value, str)]
    return spark.createDataFrame([r for r in rows if r[0][:1].isdigit()], "number string, title string, line int")
