"""What contract passages change in standard periods: amended periods, removed clauses, deleted consequences.

A passage is read once: its periods of days, its citations of clauses and its words of deletion are spans with places.
Requirements (clause, obligation, period_days, consequence_clause) are a registry of fixed size and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import spans

# Number words of periods, how far back the replaced period stands, how far deletion follows a clause, the longest period.
NUMBERS = {
    "seven": 7, "ten": 10, "fourteen": 14, "fifteen": 15, "twenty-one": 21, "twenty-eight": 28, "thirty": 30, "forty-two": 42, "forty-five": 45, "fifty-six": 56,
    "sixty": 60, "eighty-four": 84, "ninety": 90,
}
LOOKBACK, AFTER, LONGEST = 160, 120, 365
PERIOD = r"\b(?:\d{1,3}|" + "|".join(sorted(NUMBERS, key=len, reverse=True)) + r")\s*(?:\([\w -]*\)\s*)?(?:(?:calendar|working|business)\s+)?days?\b"
CLAUSE = r"\b(?:sub-?\s*clause|clause)\s+\d+(?:\.\d+)*"
DELETED = r"\b(?:is|are|shall\s+be|stands)\s+deleted\b"
TOPIC = "(?i)notic|notif|claim|particular|account|submi"


def _days(matched: Column) -> Column:
    words = F.create_map(*[x for w, n in NUMBERS.items() for x in (F.lit(w), F.lit(n))])
    first = F.regexp_extract(F.lower(matched), r"^(\d+|[a-z-]+)", 1)
    return F.coalesce(F.try_element_at(words, first), F.expr("try_cast(regexp_extract(lower(matched), '^([0-9]+)', 1) AS INT)"))


def readings(passages: DataFrame) -> DataFrame:
    """(passage_id, kind, start, stop, number, days, working): periods, citations and deletions with their places."""
    patterns = {k: (f"(?i:{p})", None) for k, p in {"period": PERIOD, "clause": CLAUSE, "deleted": DELETED}.items()}
    found = spans(passages.select("passage_id", "text"), "passage_id", patterns)
    number = F.when(F.col("kind") == "clause", F.regexp_extract("matched", r"(\d+(?:\.\d+)*)$", 1))
    days = F.when(F.col("kind") == "period", _days(F.col("matched")))
    return found.withColumns({"number": number, "days": days, "working": F.lower("matched").rlike("working|business")})


def amended_periods(passages: DataFrame, requirements: DataFrame) -> DataFrame:
    """(passage_id, clause, obligation, standard_days, days, working, start): periods that differ from the clause's own.

    A passage (passage_id, text, clause_number, amending) counts for the clause that it is of, or, if it amends, for those that it
    cites. The requirement meant is the one whose period stands last before the new one, within LOOKBACK characters; without such a
    one it is the clause's only requirement, else its notice of claim. A standard period restated in calendar days changes nothing.
    """
    on_topic = passages.where(F.col("text").rlike(TOPIC))
    read = readings(on_topic)
    cited = read.where("kind = 'clause'").select("passage_id", F.col("number").alias("clause")).distinct()
    owned = on_topic.select("passage_id", F.trim("clause_number").alias("clause")).where("clause <> ''")
    about = on_topic.where("amending").select("passage_id").join(cited, "passage_id").union(owned).distinct()
    reqs = F.broadcast(requirements)
    standard = requirements.groupBy("clause").agg(F.collect_set("period_days").alias("standard"), F.count("*").alias("n_reqs"))
    periods = read.where((F.col("kind") == "period") & F.col("days").between(1, LONGEST)).select("passage_id", "days", "working", "start")
    changed = about.join(F.broadcast(standard), "clause").join(periods, "passage_id").where(F.col("working") | ~F.array_contains("standard", F.col("days")))
    # The last of the clause's own periods before it: an equi-join by passage, places compared.
    before = periods.select("passage_id", F.col("days").alias("period_days"), F.col("start").alias("at"))
    replaced = (
        changed.join(before, "passage_id").where((F.col("at") < F.col("start")) & (F.col("at") >= F.col("start") - LOOKBACK)).join(reqs, ["clause", "period_days"])
        .groupBy("passage_id", "clause", "start").agg(F.max_by(F.struct("obligation", "period_days"), F.struct("at", "obligation")).alias("meant"))
    )
    fallback = requirements.groupBy("clause").agg(F.min_by(F.struct("obligation", "period_days"), F.struct(F.col("obligation") != "notice_of_claim", "obligation")).alias("other"))
    out = changed.join(replaced, ["passage_id", "clause", "start"], "left").join(F.broadcast(fallback), "clause")
    meant = F.coalesce("meant", "other")
    # Another requirement's standard period, restated in working days, is no change of the one that is meant.
    other = F.array_contains("standard", F.col("days")) & (meant["period_days"] != F.col("days"))
    unsure = F.col("meant").isNull() & (F.col("n_reqs") > 1)
    return out.where(~other).select("passage_id", "clause", meant["obligation"].alias("obligation"), meant["period_days"].alias("standard_days"), "days", "working", "start", unsure.alias("unsure"))


def suggested(changes: DataFrame) -> DataFrame:
    """One change for each clause and obligation: the first passage's, and in it the first period's."""
    rest = F.struct(*[c for c in changes.columns if c not in ("clause", "obligation")])
    return changes.groupBy("clause", "obligation").agg(F.min_by(rest, F.struct("passage_id", "start")).alias("r")).select("clause", "obligation", "r.*")


def removed_clauses(passages: DataFrame, requirements: DataFrame) -> DataFrame:
    """(passage_id, clause, obligation): amending passages without a period that cite a clause and delete something."""
    own = passages.where(F.col("amending") & F.col("text").rlike(TOPIC))
    read = readings(own)
    kinds = read.groupBy("passage_id").agg(F.max((F.col("kind") == "deleted").cast("int")).alias("deletes"), F.max(((F.col("kind") == "period") & F.col("days").between(1, LONGEST)).cast("int")).alias("periods"))
    cited = read.where("kind = 'clause'").select("passage_id", F.col("number").alias("clause")).distinct()
    return kinds.where("deletes = 1 AND periods = 0").join(cited, "passage_id").join(F.broadcast(requirements), "clause").select("passage_id", "clause", "obligation")


def deleted_consequences(passages: DataFrame, requirements: DataFrame) -> DataFrame:
    """(passage_id, clause, obligation, consequence_clause, start): words of deletion within AFTER characters of the clause of a consequence."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    read = readings(passages.where("amending").withColumn("text", text))
    numbers = spans(passages.where("amending").withColumn("text", text), "passage_id", {"number": (r"[\d.]*\d", r"\d+(?:\.\d+)*")})
    reqs = requirements.where("consequence_clause IS NOT NULL")
    named = numbers.join(F.broadcast(reqs), F.col("matched") == F.col("consequence_clause")).select("passage_id", "clause", "obligation", "consequence_clause", "start", "stop")
    gone = read.where("kind = 'deleted'").select("passage_id", F.col("start").alias("at"))
    near = named.join(gone, "passage_id").where((F.col("at") >= F.col("stop")) & (F.col("at") <= F.col("stop") + AFTER))
    return near.groupBy("passage_id", "clause", "obligation", "consequence_clause").agg(F.min("start").alias("start"))


def unrecorded(suggestions: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Suggestions that aren't recorded yet, in whatever status; nulls in keys are values like others."""
    same = None
    for k in keys:
        test = suggestions[k].eqNullSafe(recorded[k])
        same = test if same is None else same & test
    return suggestions.join(recorded, same, "left_anti")
