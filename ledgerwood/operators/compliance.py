"""Notice compliance, screening, evidence gaps and chronologies of claims, as set-based queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relations import dealt, parts_of

#: Claims of a task, about: each has several notices and requirements.
CLAIMS_PER_TASK = 100_000

# Notice requirements of seven contract forms: edition, clause, obligation, days, whether a
# condition precedent, what it applies to, what the period runs from, and the clause of that notice.
REQUIREMENTS = [
    ("red-book-2017", "20.2.1", "notice_of_claim", 28, True, "both", "awareness", ""),
    ("red-book-2017", "20.2.4", "detailed_claim", 84, False, "both", "awareness", ""),
    ("yellow-book-2017", "20.2.1", "notice_of_claim", 28, True, "both", "awareness", ""),
    ("yellow-book-2017", "20.2.4", "detailed_claim", 84, False, "both", "awareness", ""),
    ("silver-book-2017", "20.2.1", "notice_of_claim", 28, True, "both", "awareness", ""),
    ("silver-book-2017", "20.2.4", "detailed_claim", 84, False, "both", "awareness", ""),
    ("red-book-1987", "44.2", "notice_of_claim", 28, False, "time", "awareness", ""),
    ("red-book-1987", "44.2", "detailed_claim", 28, False, "time", "notice", "44.2"),
    ("red-book-1987", "53.1", "notice_of_claim", 28, False, "money", "awareness", ""),
    ("red-book-1987", "53.3", "detailed_claim", 28, False, "money", "notice", "53.1"),
    ("red-book-1999", "20.1", "notice_of_claim", 28, True, "both", "awareness", ""),
    ("red-book-1999", "20.1", "detailed_claim", 42, False, "both", "awareness", ""),
    ("yellow-book-1999", "20.1", "notice_of_claim", 28, True, "both", "awareness", ""),
    ("yellow-book-1999", "20.1", "detailed_claim", 42, False, "both", "awareness", ""),
    ("silver-book-1999", "20.1", "notice_of_claim", 28, True, "both", "awareness", ""),
    ("silver-book-1999", "20.1", "detailed_claim", 42, False, "both", "awareness", ""),
]
REQUIREMENT_COLUMNS = ["edition", "clause", "obligation", "period_days", "precedent", "applies_to", "runs_from", "runs_from_clause"]
_SCHEMA = "edition string, clause string, obligation string, period_days int, precedent boolean, applies_to string, runs_from string, runs_from_clause string"


def requirements(spark) -> DataFrame:
    """The standard requirements: a fixed number of rows, so a join may send them to every task."""
    return F.broadcast(spark.createDataFrame(REQUIREMENTS, _SCHEMA))


def amended(standard: DataFrame, amendments: DataFrame) -> DataFrame:
    """A contract's amendments (edition, clause, obligation, action, period_days, precedent) over the standard."""
    key = ["edition", "clause", "obligation"]
    own = amendments.select(*key, "action", F.col("period_days").alias("new_days"), F.col("precedent").alias("new_precedent"))
    kept = standard.join(own.where("action <> 'add'"), key, "left").where("action IS NULL OR action = 'amend'")
    kept = kept.withColumns({"period_days": F.coalesce("new_days", "period_days"), "precedent": F.coalesce("new_precedent", "precedent")}).select(*standard.columns)
    added = own.where("action = 'add'").select(*key, F.col("new_days").alias("period_days"), F.coalesce("new_precedent", F.lit(False)).alias("precedent"))
    return kept.unionByName(added.withColumns({"applies_to": F.lit("both"), "runs_from": F.lit("awareness"), "runs_from_clause": F.lit("")}))


def _assessed(open_periods: DataFrame, notices: DataFrame, keys: list[str], parts: int | None) -> DataFrame:
    """Each period (keys, clause, obligation, period_days, precedent, starts) with its earliest notice and status.

    ``barred_id`` is a notice that can't answer the period. Notices join on the claim; which of them count is a
    condition on the pair, so no side is crossed with the other.
    """
    n = notices.select("claim_id", "notice_id", F.col("clause").alias("n_clause"), F.col("obligation").alias("n_obligation"), "effective")
    counts = ((F.trim("n_clause") == "") | (F.trim("n_clause") == F.col("clause"))) & F.coalesce(F.col("n_obligation") == F.col("obligation"), F.lit(True))
    usable = dealt(open_periods, parts, "claim_id").join(dealt(n.where("effective IS NOT NULL"), parts, "claim_id"), "claim_id").where(counts & ~F.col("notice_id").eqNullSafe(F.col("barred_id")))
    first = usable.groupBy(*keys).agg(F.min(F.struct("effective", "notice_id")).alias("first"))
    both = dealt(open_periods, parts, *keys).join(dealt(first, parts, *keys), keys, "left").withColumns({"notice_id": F.col("first.notice_id"), "effective": F.col("first.effective"), "deadline": F.expr("date_add(starts, period_days)")})
    used = F.datediff("effective", "starts")
    status = (
        F.when(F.col("starts").isNull(), "indeterminate").when(F.col("effective").isNull(), "not_given").when(used < 0, "indeterminate")
        .when(F.col("effective") <= F.col("deadline"), "compliant").otherwise("late")
    )
    late = F.when(status == "late", F.datediff("effective", "deadline"))
    return both.drop("first").withColumns({"status": status, "days_used": F.when(F.col("starts").isNotNull(), used), "days_late": late, "time_barred": (status == "late") & F.col("precedent")})


def notice_compliance(claims: DataFrame, notices: DataFrame, wanted: DataFrame) -> DataFrame:
    """A finding for every claim (claim_id, edition, seeks, awareness) and requirement that applies to it.

    Periods from awareness come first; a period from a notice starts at the notice that answered its anchor,
    which can't answer it as well.
    """
    parts = parts_of(claims, CLAIMS_PER_TASK)
    applies = (F.col("applies_to") == "both") | (F.col("seeks") == "both") | (F.col("applies_to") == F.col("seeks"))
    pairs = claims.join(wanted, "edition").where(applies)
    keys = ["claim_id", "clause", "obligation"]
    none = F.lit(None).cast(notices.schema["notice_id"].dataType)
    direct = _assessed(pairs.where("runs_from = 'awareness'").withColumns({"starts": F.col("awareness"), "barred_id": none}), notices, keys, parts)
    anchors = direct.where("obligation = 'notice_of_claim' AND effective IS NOT NULL").select("claim_id", F.col("clause").alias("runs_from_clause"), F.col("effective").alias("starts"), F.col("notice_id").alias("barred_id"))
    from_notice, by = pairs.where("runs_from = 'notice'"), ["claim_id", "runs_from_clause"]
    chained = _assessed(dealt(from_notice, parts, *by).join(dealt(anchors, parts, *by), by, "left"), notices, keys, parts)
    columns = [*keys, "precedent", "starts", "deadline", "notice_id", "effective", "status", "days_used", "days_late", "time_barred"]
    return direct.select(*columns).unionByName(chained.select(*columns))


# The checks in order: code, weight, the checks it depends on, and its own status over a claim's facts.
CHECKS = [
    ("CB1", "blocking", (), "CASE WHEN edition <> '' THEN 'satisfied' ELSE 'indeterminate' END"),
    ("CB2", "blocking", (), "CASE WHEN n_basis > 0 THEN 'satisfied' ELSE 'incomplete' END"),
    ("CB3", "advisory", ("CB1", "CB2"), "CASE WHEN n_basis = 0 THEN 'incomplete' WHEN NOT published THEN 'indeterminate' WHEN n_basis_missing = 0 THEN 'satisfied' ELSE 'incomplete' END"),
    ("CB4", "advisory", (), "CASE WHEN has_claimant AND has_respondent THEN 'satisfied' ELSE 'incomplete' END"),
    ("NC1", "blocking", (), "CASE WHEN awareness IS NOT NULL THEN 'satisfied' ELSE 'indeterminate' END"),
    ("NC2", "advisory", ("CB1",), "CASE WHEN edition = '' THEN 'indeterminate' WHEN registered THEN 'satisfied' ELSE 'not_applicable' END"),
    ("NC3", "blocking", ("NC1", "NC2"), "CASE WHEN n_without_notice = 0 THEN 'satisfied' ELSE 'incomplete' END"),
    ("NC4", "blocking", ("NC1", "NC2"), "CASE WHEN n_barred = 0 THEN 'satisfied' ELSE 'barred' END"),
    ("NC5", "advisory", ("NC1", "NC2"), "CASE WHEN n_late_open = 0 THEN 'satisfied' ELSE 'incomplete' END"),
    ("NC6", "advisory", ("NC1", "NC3", "CB4"), "CASE WHEN n_misaddressed = 0 THEN 'satisfied' ELSE 'incomplete' END"),
    ("NC7", "advisory", ("NC1", "NC3"), "CASE WHEN n_unreceived = 0 THEN 'satisfied' ELSE 'incomplete' END"),
    ("NC8", "advisory", ("NC3",), "CASE WHEN n_unconfirmed = 0 THEN 'satisfied' ELSE 'incomplete' END"),
    ("EV1", "blocking", (), "CASE WHEN event_date IS NOT NULL THEN 'satisfied' ELSE 'incomplete' END"),
    ("EV2", "advisory", (), "CASE WHEN trim(description) <> '' THEN 'satisfied' ELSE 'incomplete' END"),
    ("EV3", "advisory", ("EV1", "NC1"), "CASE WHEN event_date IS NULL OR awareness IS NULL THEN 'indeterminate' WHEN awareness >= event_date THEN 'satisfied' ELSE 'incomplete' END"),
    ("EV4", "advisory", ("EV1",), "CASE WHEN coalesce(event_date > today, false) OR coalesce(awareness > today, false) THEN 'incomplete' ELSE 'satisfied' END"),
    ("EV5", "advisory", (), "CASE WHEN NOT instructed THEN 'not_applicable' WHEN instruction_linked THEN 'satisfied' ELSE 'incomplete' END"),
    ("RC1", "advisory", (), "CASE WHEN n_records > 0 THEN 'satisfied' ELSE 'incomplete' END"),
    ("RC2", "informational", (), "'satisfied'"),
    ("RC3", "informational", (), "'satisfied'"),
    ("QR1", "blocking", (), "CASE WHEN days_claimed IS NOT NULL OR amount IS NOT NULL THEN 'satisfied' ELSE 'incomplete' END"),
    ("QR2", "advisory", ("QR1",), "CASE WHEN amount IS NULL THEN 'not_applicable' WHEN trim(currency) <> '' THEN 'satisfied' ELSE 'incomplete' END"),
    ("QR3", "advisory", ("QR1",), "CASE WHEN amount IS NULL AND days_claimed IS NULL THEN 'not_applicable' WHEN coalesce(amount <= 0, false) OR coalesce(days_claimed <= 0, false) THEN 'incomplete' ELSE 'satisfied' END"),
    ("QR4", "advisory", ("QR1",), "CASE WHEN amount IS NULL AND days_claimed IS NULL THEN 'not_applicable' WHEN (amount IS NOT NULL AND NOT seeks_money) OR (days_claimed IS NOT NULL AND NOT seeks_time) THEN 'incomplete' ELSE 'satisfied' END"),
    ("QR5", "informational", (), "'satisfied'"),
    ("DC1", "advisory", ("NC1", "NC2"), "CASE WHEN n_detailed = 0 THEN 'not_applicable' WHEN n_detailed_missing = 0 THEN 'satisfied' ELSE 'incomplete' END"),
    ("DC2", "advisory", ("NC1", "DC1"), "CASE WHEN n_detailed = 0 THEN 'not_applicable' WHEN n_detailed_late = 0 THEN 'satisfied' ELSE 'incomplete' END"),
    ("DC3", "blocking", ("NC1", "NC2"), "CASE WHEN n_lapsing = 0 THEN 'not_applicable' WHEN n_expired = 0 THEN 'satisfied' WHEN n_expired_on_record > 0 AND n_basis > 0 THEN 'satisfied' WHEN n_expired_on_record > 0 THEN 'incomplete' ELSE 'lapsed' END"),
]
OUTSTANDING = "('incomplete', 'indeterminate')"


def gated(depends_on: tuple[str, ...], own: str) -> str:
    """A check's status once its dependencies are known: the first that doesn't apply, or is open, decides."""
    cases = "".join(f" WHEN {d} = 'not_applicable' THEN 'not_applicable' WHEN {d} IN {OUTSTANDING} THEN 'indeterminate'" for d in depends_on)
    return f"CASE WHEN ({own}) = 'not_applicable' THEN 'not_applicable'{cases} ELSE ({own}) END"


def screen(facts: DataFrame) -> DataFrame:
    """The facts with one status column per check, each computed after those it depends on."""
    for code, _, depends_on, own in CHECKS:
        facts = facts.withColumn(code, F.expr(gated(depends_on, own)))
    return facts


def outcome(screened: DataFrame) -> DataFrame:
    """Barred, lapsed, not ready, ready with queries or ready."""
    has = lambda status: F.lit(False) if not CHECKS else F.array_contains(F.array(*[F.col(c) for c, *_ in CHECKS]), status)
    open_of = lambda weight: F.exists(F.array(*[F.col(c) for c, w, *_ in CHECKS if w == weight]), lambda s: s.isin("incomplete", "indeterminate"))
    value = F.when(has("barred"), "barred").when(has("lapsed"), "lapsed").when(open_of("blocking"), "not_ready").when(open_of("advisory"), "ready_with_queries").otherwise("ready")
    return screened.withColumn("outcome", value)


def check_rows(screened: DataFrame, key: str) -> DataFrame:
    """One row per check."""
    items = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(w).alias("weight"), F.col(c).alias("status")) for c, w, *_ in CHECKS])
    return screened.select(key, F.inline(items))


def evidence_gaps(elements: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every claim's elements (claim_id, element) with the status that its evidence gives them."""
    count = lambda c: F.count(F.when(c, 1))
    supports = F.col("relevance") == "supports"
    parts, keys = parts_of(elements), ["claim_id", "element"]
    by = dealt(evidence, parts, *keys).groupBy(*keys).agg(count(supports).alias("supporting"), count(F.col("relevance") == "contradicts").alias("contradicting"), count(F.col("relevance") == "unassessed").alias("unreviewed"), count(supports & F.col("reviewed")).alias("reviewed"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.when((n("supporting") > 0) & (n("contradicting") > 0), "contested").when(n("reviewed") > 0, "established").when((n("supporting") > 0) | (n("unreviewed") > 0), "partial").otherwise("missing")
    return dealt(elements, parts, *keys).join(by, keys, "left").select("claim_id", "element", status.alias("status"))


def completeness(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("claim_id").agg((F.count(F.when(F.col("status") == "established", 1)) / F.count("*")).alias("completeness"))


def date_conflicts(entries: DataFrame) -> DataFrame:
    """Titles of a claim that stand under more than one exact date."""
    dated = entries.where("occurred_on IS NOT NULL AND precision = 'day'")
    title = F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))
    return dated.groupBy("claim_id", title.alias("title_key")).agg(F.count_distinct("occurred_on").alias("n_dates")).where("n_dates > 1")


def confidence(facts: DataFrame) -> DataFrame:
    """High at first, capped by what is missing (insufficient, cited, facts, unknowns), with the reasons."""
    caps = [
        (F.col("insufficient"), 0, "evidence is insufficient"),
        (F.col("cited") == 0, 0, "no source is cited"),
        (F.col("cited") == 1, 1, "one source only"),
        (F.col("unknowns") > F.col("facts"), 1, "more unknown than known"),
        (F.col("facts") == 0, 1, "no fact is found"),
    ]
    rank = F.least(F.lit(2), *[F.when(c, r).otherwise(2) for c, r, _ in caps])
    why = F.array_compact(F.array(*[F.when(c, t) for c, _, t in caps]))
    return facts.withColumns({"confidence": F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), rank), "reasons": why})
