"""Building a knowledge base: running lines stripped, chunks checked by rules, contaminated ones quarantined, the rest checked again.

A rule finds rows of chunks (chunk_id, text, edition, page_number, clause_number, source_document). Rules of contamination send a
chunk to quarantine; what stays is validated anew until no rule of contamination hits, and can be published without an error.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_all, title_key, without_lines
from ..sources.shared import shared_path
from .documents import ALPHA_SHARE, SMALLEST, is_contents_line, running_lines
from .relations import any_of, dimension

# Shares and sizes of the rules, and phrases of guidance and of front matter.
CONTENTS_SHARE, CONTENTS_LINES, CONTENTS_CHARS = 0.4, 2, 200
RUNNING_TIMES, RUNNING_CHARS = 5, 120
GUIDANCE = [
    "guidance for the preparation", "notes on the preparation", "note:", "the following example", "example sub-clause", "example wording", "sample form",
    "specimen", "if the employer wishes", "the employer may wish to", "parties may wish to", "it is recommended that", "this guidance", "for guidance", "checklist",
]
FRONT_MATTER = ["table of contents", "index", "foreword", "acknowledgements", "publication list", "forms of securities", "letter of tender", "appendix to tender"]
#: Rules in the order in which the first one that hits names the reason, with their severity and whether they quarantine.
RULES = {
    "contents_contamination": ("error", True), "guidance_text": ("error", True), "duplicate_content": ("warning", False), "running_header_footer": ("warning", True),
    "malformed_chunk": ("warning", True), "edition_mixing": ("error", False), "missing_clauses": ("warning", False), "missing_provenance": ("error", False),
}
CONTAMINATION = [r for r, (_, q) in RULES.items() if q]
#: Passes of validation; each takes rows away, and rules of contamination count rows alone, so the second finds nothing new.
PASSES = 2


def read(chunks: DataFrame, edition: str, rules: list[str]) -> DataFrame:
    """(chunk_id, rules, copy, running): what a chunk's own text says of it, read once; the rules of rows that hit it, and the keys by which it is a copy or a running line, NULL for none.

    ``rules`` names those that are asked for. Every part of a text is worked out in a step of its own and used by name, so it is worked out once.
    """
    own = chunks.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    row_rules = []
    if "contents_contamination" in rules:
        lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
        own = own.withColumn("__lines", lines).withColumns({"__n": F.size("__lines"), "__c": F.size(F.filter("__lines", is_contents_line))}).drop("__lines")
        few = (F.col("__n") > 0) & (F.col("__c") == F.col("__n")) & (F.length("text") < CONTENTS_CHARS)
        row_rules.append(F.when(F.when(F.col("__n") < CONTENTS_LINES, few).otherwise(F.col("__c") >= CONTENTS_SHARE * F.col("__n")), "contents_contamination"))
    low = F.col("__low")
    if {"guidance_text", "duplicate_content", "running_header_footer"} & set(rules):
        own = own.withColumn("__low", title_key(F.col("text")))
    if "guidance_text" in rules:
        row_rules.append(F.when(any_of([low.contains(m) for m in GUIDANCE]) | any_of([low.startswith(m) for m in FRONT_MATTER]), "guidance_text"))
    if "malformed_chunk" in rules:
        own = own.withColumn("__bare", F.trim("text")).withColumns({"__chars": F.length("__bare"), "__letters": F.regexp_count("__bare", F.lit(r"[A-Za-zÀ-ÖØ-öø-ÿ]"))}).drop("__bare")
        # Exact: as a double, 0.55 of 100 is more than 55.
        row_rules.append(F.when((F.col("__chars") < SMALLEST) | (F.col("__letters") < F.lit(Decimal(str(ALPHA_SHARE))) * F.col("__chars")), "malformed_chunk"))
    if "edition_mixing" in rules:
        row_rules.append(F.when(~F.col("edition").eqNullSafe(F.lit(edition)), "edition_mixing"))
    if "missing_provenance" in rules:
        no_source = F.coalesce(F.col("source_document"), F.lit("")) == ""
        row_rules.append(F.when(no_source | (F.coalesce("page_number", F.lit(0)) <= 0), "missing_provenance"))
    none = F.lit(None).cast("string")
    copy = F.when(F.length(low) >= SMALLEST, F.sha2(fold_all(F.col("text")), 256)) if "duplicate_content" in rules else none
    running = F.when(F.length(low).between(1, RUNNING_CHARS), low) if "running_header_footer" in rules else none
    # A chunk that nothing is to be said of isn't a hit, but it counts among those that stay.
    return own.select("chunk_id", F.array(*row_rules).cast("array<string>").alias("rules"), copy.alias("copy"), running.alias("running"))


def _copies(read_: DataFrame) -> DataFrame:
    """All but the first of chunks with one folded text."""
    keyed = read_.select("chunk_id", "copy").where("copy IS NOT NULL")
    first = keyed.groupBy("copy").agg(F.min("chunk_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("copy", "first")
    return keyed.join(first, "copy").where("chunk_id <> first").select("chunk_id")


def _running(read_: DataFrame) -> DataFrame:
    """Chunks of a short text that stands in several."""
    keyed = read_.select("chunk_id", "running").where("running IS NOT NULL")
    many = keyed.groupBy("running").agg(F.count("*").alias("n")).where(F.col("n") >= RUNNING_TIMES).select("running")
    return keyed.join(many, "running", "left_semi").select("chunk_id")


def hits(chunks: DataFrame, edition: str, rules: list[str] | None = None) -> DataFrame:
    """(chunk_id, rule): every chunk that a rule finds; ``rules`` names those that are asked for."""
    asked = list(RULES) if rules is None else rules
    own = read(chunks, edition, asked)
    if {"duplicate_content", "running_header_footer"} & set(asked):
        own = _written(own, shared_path(chunks.sparkSession, "validation-read"))  # several branches read it
    return _hits(own, asked)


def _hits(read_: DataFrame, rules: list[str]) -> DataFrame:
    # The outer kind: for the other one Spark infers a filter on the list and works all of it out again for that.
    found = read_.select("chunk_id", F.explode_outer("rules").alias("rule")).where("rule IS NOT NULL")
    if "duplicate_content" in rules:
        found = found.union(_copies(read_).withColumn("rule", F.lit("duplicate_content")))
    if "running_header_footer" in rules:
        found = found.union(_running(read_).withColumn("rule", F.lit("running_header_footer")))
    return found


def _order(rule: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RULES]), rule)


def quarantined(found: DataFrame) -> DataFrame:
    """(chunk_id, reason): the first rule of contamination that hits a chunk."""
    own = found.where(F.col("rule").isin(CONTAMINATION))
    return own.groupBy("chunk_id").agg(F.min_by("rule", _order(F.col("rule"))).alias("reason"))


def missing_clauses(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """(clause): expected ones (clause) that no chunk is of, nor below."""
    number = F.regexp_replace(F.trim("clause_number"), r"[.:)\s]+$", "")
    present = chunks.select(F.explode(F.array(number, F.substring_index(number, ".", 1))).alias("clause")).distinct()
    return expected.select("clause").distinct().join(present, "clause", "left_anti")


def report(found: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """(rule, severity, chunks) of every rule that found something."""
    counted = found.groupBy("rule").agg(F.count_distinct("chunk_id").alias("chunks"))
    if missing is not None:
        counted = counted.union(missing.agg(F.lit("missing_clauses").alias("rule"), F.count("*").alias("chunks")).where("chunks > 0"))
    severity = F.create_map(*[x for r, (s, _) in RULES.items() for x in (F.lit(r), F.lit(s))])
    return counted.select("rule", F.try_element_at(severity, F.col("rule")).alias("severity"), "chunks")


def validated(chunks: DataFrame, edition: str, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The quarantine (chunk_id, reason, validation), what is retained, and the report of the last validation."""
    spark = chunks.sparkSession
    kept = lambda df, name: _written(df, shared_path(spark, f"validation-{name}"))
    # Texts are read once: what the passes need of them is a small table, and so is what each pass leaves.
    now, rules = kept(read(chunks, edition, list(RULES)), "read"), list(RULES)
    out, left = None, chunks
    for n in range(1, PASSES + 1):
        bad = kept(quarantined(_hits(now, CONTAMINATION)).withColumn("validation", F.lit(n)), f"out{n}")
        out = bad if out is None else out.union(bad)
        now = kept(now.join(bad.select("chunk_id"), "chunk_id", "left_anti"), f"left{n}")
        left = left.join(bad.select("chunk_id"), "chunk_id", "left_anti")
    return out, left, report(_hits(now, rules), missing_clauses(left, expected) if expected is not None else None)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publishable(last: DataFrame) -> DataFrame:
    """One row: whether a report has no error, and how many errors and warnings it has."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return last.agg((n("error") == 0).alias("publishable"), n("error").alias("errors"), n("warning").alias("warnings"))


def without_running(pages: DataFrame, chunks: DataFrame, document: str, page: str, share: float, documents: int) -> DataFrame:
    """Chunks without the lines that run over their document's pages; those that nothing is left of go. ``documents`` is how many there are."""
    running = running_lines(pages, document, page, share)
    keys = running.groupBy(document).agg(F.collect_set("key").alias("running"))  # at most the lines of two pages, as each is on half of them at the default share
    met = chunks.join(dimension(keys, documents, 4096), document, "left")
    stripped = F.when(F.col("running").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("running")))
    return met.withColumn("text", stripped).drop("running").where(F.trim("text") != "")


def numbered(chunks: DataFrame, document: str, order: list[str]) -> DataFrame:
    """Chunks with their places in a document."""
    return chunks.withColumn("sequence", F.row_number().over(Window.partitionBy(document).orderBy(*order)))
