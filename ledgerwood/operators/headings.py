"""Clause headings over the lines of pages in four layouts, references to clauses with their places, and the split of bundles.

A line is read with the one below it: a number alone can have its title there. Rows of tables and lines of contents lists are no headings.
Keys of pages must be unique: the line below is found by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_bounds, roman_value
from .documents import heading_score, is_contents_line
from .relations import any_of, carried
from .spans import free_of, spans

# What names a clause, numbers, units that make a number a measure, units of tables, words that titles write small.
KEYWORD = "(?i:sub-?clause|clause|article|section|paragraph)"
NUMBER = r"\d{1,3}(?:\.\d{1,3}){0,4}"
UNIT = r"(?i)^\s*(?:%|million|billion|thousand|m\b|km\b|mm\b|cm\b|kg\b|t\b|days?\b|weeks?\b|months?\b|years?\b|hours?\b)"
TABLE_UNITS = ["cum", "sqm", "nos", "no", "each", "ltr", "kg", "tonne", "tons", "ton", "pcs", "set", "rs", "pkr", "usd", "lump", "ls"]
SMALL_WORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "under", "with"]
PROSE = [" shall ", " means ", " unless ", " if the ", " which "]
LEAST, JOINED = 0.55, 80
#: Layouts in the order in which the first that holds names the heading: number first, roman after a keyword, without a space, in the margin.
NUMBERED = rf"^[ \t]*(?:({KEYWORD})[ \t]+)?({NUMBER})[.)]?[ \t–—:-]+([A-Za-z0-9][^\n]{{2,120}}?)[ \t]*$"
ROMAN = rf"^[ \t]*({KEYWORD})[ \t]+([IVXLCDMivxlcdm]+)[.)]?[ \t–—:-]+([A-Z][^\n]{{2,120}}?)[ \t]*$"
NO_SPACE = rf"^[ \t]*({NUMBER})([A-Z][^\n]{{2,119}}?)[ \t]*$"
MARGIN = r"^[ \t]*([A-Z][A-Za-z'&/()\-, ]{2,60}?)[ \t]+(\d{1,3}(?:\.\d{1,3}){1,3})[ \t]+([A-Z][^\n]{15,})$"
ALONE = rf"^[ \t]*({NUMBER})[.)]?[ \t]*$"
EXPLICIT = rf"\b{KEYWORD}[ \t]+{NUMBER}\b"
TOKEN, DOTTED = r"[\w.]+", r"\d{1,3}(?:\.\d{1,3}){1,4}"


def lines(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_index, char_offset, line, below) of every line."""
    found = spans(pages, key, {"line": ("^.*$", None)}, text).select(key, F.col("n").alias("line_index"), F.col("start").alias("char_offset"), F.col("matched").alias("line"))
    # A window holds the lines of one page.
    return found.withColumn("below", F.lead("line").over(Window.partitionBy(key).orderBy("line_index")))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t]+"), lambda w: w != "")


def is_table_row(title: Column) -> Column:
    """Two quantities, or quantities and units in a third of the words."""
    words = _words(title)
    quantities = F.size(F.filter(words, lambda w: w.rlike(r"^[0-9,.+/:-]*[0-9][0-9,.+/:-]*$")))
    units = F.size(F.filter(words, lambda w: F.lower(w).isin(TABLE_UNITS)))
    return (quantities >= 2) | ((quantities > 0) & (quantities + units >= 0.34 * F.size(words)))


def capitals(title: Column) -> Column:
    """Share of capitalised words among those that aren't small words."""
    own = F.filter(_words(title), lambda w: ~F.lower(w).isin(SMALL_WORDS))
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda w: w.rlike("^[A-ZÀ-ÖØ-Þ]"))) / F.size(own)).otherwise(F.lit(0.0))


def _score(number: Column, title: Column, keyword: Column, line: Column) -> Column:
    return F.when(title.rlike(ascii_bounds(UNIT)) | is_table_row(title), 0.0).otherwise(heading_score(number, title, keyword, line))


def _margin_score(title: Column, rest: Column, line: Column) -> Column:
    prose = any_of([F.concat(F.lit(" "), F.lower(title), F.lit(" ")).contains(p) for p in PROSE])
    no = title.rlike(f"^{KEYWORD}$") | is_contents_line(line) | (F.size(_words(rest)) < 4) | is_table_row(title)
    score = F.lit(0.5) + F.when(capitals(title) >= 0.6, 0.2).otherwise(-0.2) + F.when(F.length(title) <= 40, 0.1).otherwise(0.0) - F.when(prose, 0.4).otherwise(0.0)
    return F.when(no, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(score, 6)))


def headings(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_index, char_offset, layout, number, title, confidence, depth) of every heading."""
    line, below = F.col("line"), F.coalesce(F.col("below"), F.lit(""))
    part = lambda p, i, of=line: F.regexp_extract(of, p, i)
    bare = lambda t: F.regexp_replace(F.trim(t), r"[.;:,]+$", "")

    def layout(name: str, number: Column, title: Column, score: Column, column: Column | None = None) -> Column:
        ok = (number != "") & (title != "") & (score >= LEAST)
        return F.when(ok, F.struct(F.lit(name).alias("layout"), number.alias("number"), title.alias("title"), score.alias("confidence"), (F.lit(0) if column is None else column).cast("int").alias("column")))

    t1, t2, t3, t4, t5 = bare(part(NUMBERED, 3)), bare(part(ROMAN, 3)), bare(part(NO_SPACE, 2)), bare(part(MARGIN, 1)), bare(below)
    n2 = F.coalesce(roman_value(part(ROMAN, 2)).cast("string"), F.lit(""))
    alone = part(ALONE, 1)
    titled = (F.length(t5) <= JOINED) & ~below.rlike(ALONE) & ~below.rlike(NUMBERED) & (capitals(t5) >= 0.6) & t5.rlike("[A-Za-z]")
    first = F.coalesce(
        layout("numbered", part(NUMBERED, 2), t1, _score(part(NUMBERED, 2), t1, part(NUMBERED, 1) != "", line)),
        layout("roman", n2, t2, _score(n2, t2, F.lit(True), line)),
        layout("no_space", part(NO_SPACE, 1), t3, _score(part(NO_SPACE, 1), t3, F.lit(False), line)),
        layout("margin", part(MARGIN, 2), t4, _margin_score(t4, part(MARGIN, 3), line), F.instr(line, part(MARGIN, 2)) - 1),
        F.when(titled, layout("two_lines", alone, t5, _score(alone, t5, F.lit(False), F.concat(alone, F.lit(" "), t5)))),
    )
    found = lines(pages, key, text).withColumn("h", first)
    # A line that is the title of the number above isn't read again.
    taken = F.lag(F.col("h.layout")).over(Window.partitionBy(key).orderBy("line_index"))
    kept = found.withColumn("above", taken).where(F.col("h").isNotNull() & ~F.coalesce(F.col("above") == "two_lines", F.lit(False)))
    return kept.select(key, "line_index", (F.col("char_offset") + F.col("h.column")).alias("char_offset"), "h.layout", "h.number", "h.title", "h.confidence", F.size(F.split("h.number", r"\.")).alias("depth"))


def references(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, char_offset, number, label, is_explicit): clauses named in the text; bare dotted numbers where no unit follows."""
    explicit = spans(pages, key, {"explicit": (EXPLICIT, None)}, text)
    bare = free_of(spans(pages, key, {"bare": (TOKEN, DOTTED)}, text), explicit, key).where(~F.col("after").rlike(ascii_bounds(UNIT)))
    row = lambda df, number, sure: df.select(key, F.col("start").alias("char_offset"), number.alias("number"), F.col("matched").alias("label"), F.lit(sure).alias("is_explicit"))
    return row(explicit, F.regexp_extract("matched", rf"({NUMBER})$", 1), True).union(row(bare, F.col("matched"), False))


# What begins a document in a bundle, and what tells its kind, strongest first.
STARTS = [
    r"(?im)^\W*(?:annex(?:ure)?|appendix|attachment|enclosure|exhibit|schedule|tab)\s*[-:.]?\s*[A-Z0-9]{0,4}\b",
    r"(?i)\b(?:our\s+ref|your\s+ref|ref(?:erence)?\s*(?:no\.?)?\s*[:\-])|\bdear\s+(?:sir|sirs|madam|mr|ms)", r"(?i)\bpage\s+1\s+of\s+\d+\b",
]
KINDS = [
    ("claim_letter", r"(?i)claim\s+for\s+(?:an\s+)?(?:extension|additional|payment)|particularised\s+claim|we\s+(?:hereby\s+)?claim|this\s+letter\s+constitutes"),
    ("notice", r"(?i)notice\s+of\s+(?:claim|delay|intention)|intention\s+to\s+claim|hereby\s+give\s+notice"),
    ("minutes", r"(?i)minutes\s+of\s+(?:the\s+)?(?:meeting|progress)|meeting\s+no\.?\s*\d|attendees|present\s*:"),
    ("programme", r"(?i)programme|baseline|critical\s+path|gantt|time\s+impact\s+analysis|activity\s+id"),
    ("site_record", r"(?i)daily\s+(?:report|diary|record)|site\s+diary|progress\s+report|weather|labour\s+on\s+site"),
    ("invoice_cost", r"(?i)\binvoice\b|receipt|payment\s+certificate|cost\s+(?:record|breakdown|summary)|amount\s+due"),
    ("measurement", r"(?i)measurement\s+sheet|quantity|bill\s+of\s+quantities|\bboq\b"),
    ("report", r"(?i)\breport\b|investigation|findings"), ("correspondence", r"(?i)dear\s+sirs?|yours\s+(?:faithfully|sincerely)"),
]
HEAD, BODY = 600, 2500
CLAIMS, WRITES = r"(?i)\bclaim\b", r"(?i)dear\s+sirs?|we\s+refer|herewith"


def kind_of(text: Column) -> Column:
    body, out = F.substring(text, 1, BODY), F.lit("other")
    for name, pattern in reversed(KINDS):
        out = F.when(body.rlike(ascii_bounds(pattern)), name).otherwise(out)
    return out


def bundle_split(pages: DataFrame, bundle: str, page: str, text: str = "text") -> DataFrame:
    """(bundle, first_page, last_page, n_pages, kind): documents of a bundle, each from a page that begins one to the next such page.

    Where no document of a bundle is a claim letter by its first page, the first one that claims and is written as a letter is.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    starts = any_of([F.substring(t, 1, HEAD).rlike(ascii_bounds(p)) for p in STARTS])
    read = pages.select(bundle, page, F.when(starts, F.col(page)).alias("begins"), kind_of(t).alias("kind"), t.rlike(ascii_bounds(CLAIMS)).alias("claims"), t.rlike(WRITES).alias("writes"))
    placed = carried(read, bundle, page, "begins", "segment")
    # Pages before the first that begins one are a document too.
    parts = placed.groupBy(bundle, "segment").agg(
        F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count("*").alias("n_pages"), F.min_by("kind", page).alias("kind"), F.max("claims").alias("claims"), F.max("writes").alias("writes"))
    letter = parts.groupBy(F.col(bundle).alias("__b")).agg(F.max(F.col("kind") == "claim_letter").alias("has"), F.min(F.when(F.col("claims") & F.col("writes"), F.col("first_page"))).alias("letter"))
    met = parts.join(letter, F.col(bundle).eqNullSafe(F.col("__b")))
    kind = F.when(~F.col("has") & (F.col("first_page") == F.col("letter")), "claim_letter").otherwise(F.col("kind"))
    return met.select(bundle, "first_page", "last_page", "n_pages", kind.alias("kind"))
