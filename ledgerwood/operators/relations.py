"""Scopes, joins, windows, top-k and pages over DataFrames."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Estimated bytes up to which a dimension is broadcast.
BROADCAST_BYTES = 32 << 20


def dimension(df: DataFrame, rows: int, bytes_per_row: int = 256) -> DataFrame:
    """A small side, marked for broadcast while its known number of rows fits; else left to the planner."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


#: Rows of a join's or an aggregate's task, about.
ROWS_PER_TASK = 250_000


def parts_of(df: DataFrame, per_task: int = ROWS_PER_TASK) -> int | None:
    """The number of parts that rows are dealt to where the planner would give tasks more than their share; else None.

    Adaptive execution joins the session's partitions into about as many as there are cores, so theirs grow with the rows.
    """
    spark = df.sparkSession
    wanted = -(-df.count() // per_task)
    return wanted if wanted > min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows by keys in ``parts``; None leaves it to the planner."""
    return df if parts is None else df.repartition(parts, *keys)


@dataclass(frozen=True)
class Scope:
    """What a search may read. Checked before anything is planned; narrowing only ever removes."""

    sources: tuple[str, ...]
    accessible: tuple[int, ...] = ()
    project: int | None = None
    edition: str | None = None
    document_types: tuple[str, ...] = ()
    clauses: tuple[str, ...] = ()
    errors: tuple[str, ...] = field(default=(), init=False)

    def __post_init__(self):
        if not self.sources:
            raise ValueError("a scope needs a source")
        if "knowledge" in self.sources and not self.edition:
            raise ValueError("a knowledge scope needs an edition")
        if "project" in self.sources and self.project is None and not self.accessible:
            raise ValueError("a project scope needs projects")
        if self.project is not None and self.project not in self.accessible:
            raise PermissionError(f"project {self.project} is not accessible")

    def narrowed(self, sources: Sequence[str]) -> Scope:
        if set(sources) - set(self.sources):
            raise ValueError("a scope can't be widened")
        return Scope(tuple(sources), self.accessible, self.project, self.edition, self.document_types, self.clauses)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(operator.or_, conditions) if conditions else F.lit(False)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(operator.and_, conditions) if conditions else F.lit(True)


def facets(df: DataFrame, wanted: Mapping[str, object], allowed: Sequence[str]) -> DataFrame:
    """Equality on allow-listed columns; a list means any of its values."""
    if unknown := set(wanted) - set(allowed):
        raise ValueError(f"no such facet: {sorted(unknown)}")
    tests = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in wanted.items()]
    return df.where(all_of(tests))


def text_search(df: DataFrame, phrase: str, columns: Sequence[str]) -> DataFrame:
    """Every word of the phrase in one of the columns, case ignored."""
    return df.where(all_of([any_of([F.lower(c).contains(w) for c in columns]) for w in phrase.lower().split()]))


def differs(column: Column, value: object) -> Column:
    """Unequal, where NULL is a value like any other."""
    return ~column.eqNullSafe(F.lit(value))


def visible(df: DataFrame, access: DataFrame, key: str) -> DataFrame:
    """Row-level security: rows whose key is in the caller's access list."""
    return df.join(access.select(key), key, "left_semi")


def accessible_projects(projects: DataFrame, members: DataFrame, user: int, admin: bool, org: int) -> DataFrame:
    """All live projects of the organisation for an admin, else the live ones with an active membership."""
    own = projects.where(F.col("org") == org)
    return own if admin else own.join(members.where((F.col("user") == user) & F.col("active")), "project", "left_semi")


def per_parent(children: DataFrame, key: str, order: Sequence[str], into: str = "items") -> DataFrame:
    """One row per parent with its children as an ordered list."""
    rest = [c for c in children.columns if c != key]
    item = F.struct(*[F.col(c) for c in [*order, *[c for c in rest if c not in order]]])
    return children.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(into))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def spanned(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], span: Column, *,
    before: Mapping[str, str] | None = None, last: Mapping[str, str] | None = None, count: Mapping[str, Column] | None = None, largest: Mapping[str, str] | None = None,
) -> DataFrame:
    """Columns that depend on a key's rows so far, in order, without one task that holds a whole key.

    ``span`` deals a key's rows by the first column of the order (a day of a time, thousands of a number): a window holds the rows of
    one span, the windows over a key one row a span. ``before``: the row before's value; ``last``: the last value that isn't null, the row's
    own included; ``count``: how often a condition held, the row's own included; ``largest``: the largest value of the rows before.
    """
    before, last, count, largest = before or {}, last or {}, count or {}, largest or {}
    at = F.struct(*order)
    dealt = df.withColumns({"__span": span, **{f"__is_{n}": F.coalesce(c, F.lit(False)).cast("bigint") for n, c in count.items()}})
    ends = dealt.groupBy(*keys, "__span").agg(
        F.count("*").alias("__rows"),
        *[F.max_by(F.struct(F.col(c).alias("v")), at).alias(f"__b_{n}") for n, c in before.items()],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"__b_{n}") for n, c in last.items()],
        *[F.sum(f"__is_{n}").alias(f"__b_{n}") for n in count], *[F.max(c).alias(f"__b_{n}") for n, c in largest.items()],
    )
    past = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carry = {n: F.last(f"__b_{n}", ignorenulls=True).over(past) for n in [*before, *last]} | {n: F.sum(f"__b_{n}").over(past) for n in count} | {n: F.max(f"__b_{n}").over(past) for n in largest}
    starts = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__span").alias("__at"), *[c.alias(f"__c_{n}") for n, c in carry.items()])
    w = Window.partitionBy(*keys, "__span").orderBy(*order)
    so_far, above = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumns(
        {f"__w_{n}": F.lag(F.struct(F.col(c).alias("v"))).over(w) for n, c in before.items()} | {f"__w_{n}": F.last(c, ignorenulls=True).over(so_far) for n, c in last.items()}
        | {f"__w_{n}": F.sum(f"__is_{n}").over(so_far) for n in count} | {f"__w_{n}": F.max(c).over(above) for n, c in largest.items()})
    same = all_of([F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__span").eqNullSafe(F.col("__at"))])
    met = within.join(starts, same)
    own, past_ = (lambda n: F.col(f"__w_{n}")), (lambda n: F.col(f"__c_{n}"))
    made = {n: F.coalesce(own(n), past_(n))["v"] for n in before} | {n: F.coalesce(own(n), past_(n)) for n in last} | {n: own(n) + F.coalesce(past_(n), F.lit(0)) for n in count} | {n: F.greatest(own(n), past_(n)) for n in largest}
    return met.select(*df.columns, *[c.alias(n) for n, c in made.items()])


def gaps(df: DataFrame, keys: Sequence[str], day: str, order: Sequence[str], most: int) -> DataFrame:
    """Rows that follow the one before by more than ``most`` days; a key's rows are dealt by years."""
    met = spanned(df, keys, [day, *order], F.year(day), before={"before": day})
    return met.withColumn("gap_days", F.datediff(day, "before")).where(F.col("gap_days") > most)


def filled_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, into: str, span: Column) -> DataFrame:
    return spanned(df, keys, order, span, last={into: column})


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, span: Column, into: str = "island") -> DataFrame:
    """Numbers runs of rows; a run begins at each row where ``starts`` holds."""
    return spanned(df, keys, order, span, count={into: starts})


def numbered(df: DataFrame, key: str, order: str, into: str = "n", span: int = 1 << 16) -> DataFrame:
    """Places 1, 2, ... of each key's rows by a whole number ``order``, a hot key's rows dealt by spans of it.

    A window holds at most the rows of one span; the windows over a key see one row a span. Null orders come first.
    """
    dealt = df.withColumn("__span", F.floor(F.col(order) / span))
    starts = dealt.groupBy(key, "__span").agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(F.col(key).alias("__key"), F.col("__span").alias("__at"), F.coalesce(before, F.lit(0)).alias("__before"))
    within = dealt.withColumn("__place", F.row_number().over(Window.partitionBy(key, "__span").orderBy(order)))
    met = within.join(starts, within[key].eqNullSafe(F.col("__key")) & within["__span"].eqNullSafe(F.col("__at")))
    return met.select(*df.columns, (F.col("__before") + F.col("__place")).alias(into))


def carried(df: DataFrame, key: str, order: str, column: str, into: str, span: int = 1 << 16) -> DataFrame:
    """The last value of ``column`` that isn't null, at a row or before it, by a whole number ``order``.

    As in ``numbered``, a hot key's rows are dealt by spans of the order, and what a span begins with comes from the spans before it.
    """
    dealt = df.withColumn("__span", F.floor(F.col(order) / span))
    ends = dealt.groupBy(key, "__span").agg(F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order))).alias("__end"))
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select(F.col(key).alias("__key"), F.col("__span").alias("__at"), before.alias("__before"))
    own = F.last(column, ignorenulls=True).over(Window.partitionBy(key, "__span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    met = dealt.withColumn("__own", own).join(starts, F.col(key).eqNullSafe(F.col("__key")) & F.col("__span").eqNullSafe(F.col("__at")))
    return met.select(*df.columns, F.coalesce("__own", "__before").alias(into))


def missing_numbers(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """The whole numbers between those present, by key."""
    w = Window.partitionBy(*keys).orderBy(number)
    ahead = df.select(*keys, number).distinct().withColumn("next", F.lead(number).over(w)).where(F.col("next") > F.col(number) + 1)
    return ahead.select(*keys, F.explode(F.sequence(F.col(number) + 1, F.col("next") - 1)).alias("missing"))


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int = 25, most: int = 200) -> DataFrame:
    """One page by offset under a total order."""
    size = min(size, most)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, column: str, key: str, after: tuple[object, object] | None, size: int = 50) -> DataFrame:
    """One page by cursor, newest first: the rows after (value, key) of the last one seen."""
    if after is not None:
        value, last = after
        df = df.where((F.col(column) < F.lit(value)) | ((F.col(column) == F.lit(value)) & (F.col(key) > F.lit(last))))
    return df.orderBy(F.desc(column), F.asc(key)).limit(size)


def ordered(df: DataFrame, wanted: str, allowed: Sequence[str], tie: str) -> DataFrame:
    """A client's order, such as "-o_totalprice", from an allow-list."""
    name = wanted.lstrip("-")
    if name not in allowed:
        raise ValueError(f"can't order by {name}")
    return df.orderBy(F.desc(name) if wanted.startswith("-") else F.asc(name), tie)


def newest_of_all(sources: Sequence[DataFrame], at: str, key: str, each: int = 8, most: int = 15) -> DataFrame:
    """The newest few of every source, then the newest of those."""
    tops = [s.orderBy(F.desc(at), key).limit(each) for s in sources]
    return reduce(DataFrame.unionByName, tops).orderBy(F.desc(at), "kind", key).limit(most)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows, and the old ones whose key they don't have."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and the first new one of each key that isn't there yet."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)))


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """Idempotent replacement: partitions in ``df`` are overwritten, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def roots_of(numbers: DataFrame, key: str, number: str) -> DataFrame:
    """Each dotted number's nearest ancestor that exists, NULL for none. No recursion: prefixes are exploded."""
    n = F.split(number, r"\.")
    prefixes = numbers.select(key, number, F.explode(F.when(F.size(n) > 1, F.sequence(F.lit(1), F.size(n) - 1)).otherwise(F.array())).alias("depth"))
    prefixes = prefixes.withColumn("ancestor", F.array_join(F.slice(F.split(number, r"\."), 1, F.col("depth")), "."))
    there = numbers.select(F.col(key), F.col(number).alias("ancestor")).distinct()
    near = prefixes.join(there, [key, "ancestor"]).groupBy(key, number).agg(F.max_by("ancestor", "depth").alias("parent"))
    return numbers.select(key, number).distinct().join(near, [key, number], "left")
