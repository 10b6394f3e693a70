"""Queries: what letters say. A letter is a text made of an order's columns in one of several spellings; query and SQL both read it back from the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import amendments as A
from ..operators import spans as S
from ..sources.tables import table
from .passages import _DAYS, _places
from .registry import query

# The letters' months, and what their parts are spelled like, by the order's number.
TYPES = ["extension of time", "EOT and costs", "additional payment", "prolongation cost", "time and money", "nothing in particular"]
CLAUSES = ["Clauses 020.1 and 20.1, 44.2.", "Sub-Clause 20.2 with ARTICLE XIV", "clauses 44.1; 44.01; 53.4"]
ROMANS = ["ARTICLE IV", "ARTICLE XL", "ARTICLE MCMXCIV", "ARTICLE XIIX"]
PERIODS = ["within fourteen (14) days", "in 28 working days or 400 days", "no later than {k} days", "forthwith"]
NUMBERS = ["2O.l{k}", "l{k}.O1", "Oll", "{k}.1"]
SIZES = ["{k}M", "{k}.5B", "1.{k} b", "none"]

_DAY = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%d %b %Y') END"
_K = "(o_orderkey % 9 + 1)"


def _pick_sql(values: list[str], by: int) -> str:
    return "CASE o_orderkey % " + str(by) + " " + " ".join(f"WHEN {i} THEN '" + v.replace("{k}", f"' || {_K}::VARCHAR || '") + "'" for i, v in enumerate(values)) + " END"


_TEXT = " || ".join([
    "'Our Ref: AB/' || o_orderkey::VARCHAR || '. '", "CASE WHEN o_orderkey % 5 = 0 THEN 'Dear Sirs, of a date not given, as we wrote before: ' ELSE 'Date: ' END", _DAY,
    "'. We claim ' ", _pick_sql(TYPES, 6), "' under '", _pick_sql(CLAUSES, 3), "' and '", _pick_sql(ROMANS, 4), "', '", _pick_sql(PERIODS, 4), "'. Models of '", _pick_sql(SIZES, 4), "', see '", _pick_sql(NUMBERS, 4), "'; first raised on '", "strftime(o_orderdate - INTERVAL 3 DAY, '%Y-%m-%d')",
])
LETTERS = f"le AS (SELECT o_orderkey, {_TEXT} AS text FROM orders)"


def letters(spark, sf):
    n, k = F.col("o_orderkey"), (F.col("o_orderkey") % 9 + 1).cast("string")
    day = F.to_date("o_orderdate")
    forms = ["yyyy-MM-dd", "d MMMM yyyy", "dd/MM/yyyy", "dd MMM yyyy"]
    dated = F.coalesce(*[F.when(n % 4 == i, F.date_format(day, f)) for i, f in enumerate(forms)])

    def pick(values: list[str], by: int):
        made = [F.concat(*[x for i, p in enumerate(v.split("{k}")) for x in ([k] if i else []) + [F.lit(p)]]) for v in values]
        return F.get(F.array(*made), (n % by).cast("int"))

    opening = F.when(n % 5 == 0, "Dear Sirs, of a date not given, as we wrote before: ").otherwise("Date: ")
    text = F.concat(
        F.lit("Our Ref: AB/"), n.cast("string"), F.lit(". "), opening, dated, F.lit(". We claim "), pick(TYPES, 6), F.lit(" under "), pick(CLAUSES, 3), F.lit(" and "), pick(ROMANS, 4), F.lit(", "), pick(PERIODS, 4),
        F.lit(". Models of "), pick(SIZES, 4), F.lit(", see "), pick(NUMBERS, 4), F.lit("; first raised on "), F.date_format(F.date_sub(day, 3), "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text"))


DATE = r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{4})\b"
_PARSED = "coalesce(try_strptime(matched, '%Y-%m-%d'), try_strptime(matched, '%d/%m/%Y'), try_strptime(matched, '%d %B %Y'), try_strptime(matched, '%d %b %Y'))::DATE"


@query(f"WITH {LETTERS}, {_places('le', 'o_orderkey', 'text', DATE, 'd')} SELECT o_orderkey, start::INTEGER AS start, {_PARSED} AS day FROM d")
def m02_all_dates(spark, sf):
    """Every date in a letter, however it is spelled, with its place."""
    found = S.spans(letters(spark, sf), "o_orderkey", {"date": (DATE, None)})
    return found.select("o_orderkey", "start", V.parse_date(F.col("matched")).alias("day"))


_LABELLED = r"(?i)\bdated?\b.{0,12}?(" + DATE[2:-2] + ")"


@query(f"WITH {LETTERS}, f AS (SELECT o_orderkey, regexp_extract(text, '{_LABELLED}', 1) AS matched FROM le) SELECT o_orderkey, CASE WHEN matched <> '' THEN {_PARSED} END AS dated FROM f")
def m03_labelled_date_in_text(spark, sf):
    """The date that stands within twelve characters after its label."""
    found = F.regexp_extract("text", _LABELLED, 1)
    return letters(spark, sf).select("o_orderkey", F.when(found != "", V.parse_date(found)).alias("dated"))


@query(f"WITH {LETTERS}, {_places('le', 'o_orderkey', 'text', '(?i)' + A.PERIOD, 'p')}, d AS (SELECT o_orderkey, {_DAYS} AS days, regexp_matches(lower(matched), 'working|business') AS working FROM p) SELECT * FROM d WHERE days BETWEEN 1 AND 365")
def m08_periods_in_text(spark, sf):
    """Periods of days in figures or words, of 1 to 365 days, and whether they are working days."""
    read = A.readings(letters(spark, sf).select(F.col("o_orderkey").alias("passage_id"), "text"))
    return read.where((F.col("kind") == "period") & F.col("days").between(1, A.LONGEST)).select(F.col("passage_id").alias("o_orderkey"), "days", "working")


@query(f"""WITH {LETTERS}, c AS (SELECT o_orderkey, regexp_extract(text, '(?i)(?:sub-?clauses?|clauses?) ((?:[0-9.]+[,; ]*(?:and )?)+)', 1) AS said FROM le),
n AS (SELECT o_orderkey, list_transform(regexp_extract_all(said, '[0-9]+(?:[.][0-9]+)+'), lambda x: array_to_string(list_transform(string_split(x, '.'), lambda s: regexp_replace(s, '^0+([0-9])', '\\1')), '.')) AS l FROM c)
SELECT o_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS clauses FROM n""")
def m12_clause_lists_in_text(spark, sf):
    """The clauses that a letter lists, normalised, each once, in order."""
    said = F.regexp_extract("text", r"(?i)(?:sub-?clauses?|clauses?) ((?:[0-9.]+[,; ]*(?:and )?)+)", 1)
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(said, F.lit(r"[0-9]+(?:[.][0-9]+)+"), F.lit(0)), T.clause_number))
    return letters(spark, sf).select("o_orderkey", F.array_join(numbers, ",").alias("clauses"))


# Words of a claim for time, and of one for money.
TIME, MONEY = ["extension", "eot", "time", "delay"], ["cost", "payment", "money", "price", "sum"]


@query(f"""WITH {LETTERS}, t AS (SELECT o_orderkey, lower(regexp_extract(text, 'We claim (.*?) under', 1)) AS said FROM le), w AS (SELECT o_orderkey, {' OR '.join(f"contains(said, '{x}')" for x in TIME)} AS t, {' OR '.join(f"contains(said, '{x}')" for x in MONEY)} AS m FROM t)
SELECT o_orderkey, CASE WHEN t AND m THEN 'both' WHEN t THEN 'time' WHEN m THEN 'money' ELSE 'other' END AS claim_type FROM w""")
def m13_claim_types_in_text(spark, sf):
    """What a letter claims: time, money, both or something else, by the words it uses."""
    said = F.lower(F.regexp_extract("text", "We claim (.*?) under", 1))
    has = lambda words: said.rlike("|".join(words))
    kind = F.when(has(TIME) & has(MONEY), "both").when(has(TIME), "time").when(has(MONEY), "money").otherwise("other")
    return letters(spark, sf).select("o_orderkey", kind.alias("claim_type"))


@query(f"""WITH {LETTERS}, s AS (SELECT o_orderkey, regexp_extract(text, 'Models of ([0-9.]+) ?([MmBb])', 1) AS n, lower(regexp_extract(text, 'Models of ([0-9.]+) ?([MmBb])', 2)) AS u FROM le)
SELECT o_orderkey, CASE u WHEN 'm' THEN round(n::DOUBLE / 1000, 6) WHEN 'b' THEN round(n::DOUBLE, 6) END AS billions FROM s""")
def m16_sizes_in_text(spark, sf):
    """A model's size in billions, from millions or billions."""
    number, unit = (F.regexp_extract("text", r"Models of ([0-9.]+) ?([MmBb])", i) for i in (1, 2))
    value = F.when(number != "", number).try_cast("double")
    return letters(spark, sf).select("o_orderkey", F.round(F.when(F.lower(unit) == "m", value / 1000).when(F.lower(unit) == "b", value), 6).alias("billions"))


@query(f"""WITH {LETTERS}, n AS (SELECT o_orderkey, regexp_extract(text, 'see ([0-9OolIi.]+)', 1) AS raw FROM le)
SELECT o_orderkey, raw, array_to_string(list_transform(string_split(raw, '.'), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN translate(s, 'OolIi', '00111') ELSE s END), '.') AS repaired FROM n""")
def t10_misread_digits_in_text(spark, sf):
    """Numbers whose digits were read as letters; a segment without a digit stays."""
    raw = F.regexp_extract("text", r"see ([0-9OolIi.]+)", 1)
    return letters(spark, sf).select("o_orderkey", raw.alias("raw"), T.repair_digits(raw).alias("repaired"))


@query(f"""WITH {LETTERS}, r AS (SELECT o_orderkey, regexp_extract(text, 'and ARTICLE ([IVXLCDM]+)', 1) AS m FROM le), v AS (SELECT o_orderkey, m, list_transform(string_split(m, ''), lambda c: [1, 5, 10, 50, 100, 500, 1000][instr('IVXLCDM', c)]) AS v FROM r)
SELECT o_orderkey, m AS numeral, list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN i < len(v) AND v[i] < v[i + 1] THEN -v[i] ELSE v[i] END))::INTEGER AS value FROM v""")
def t11_romans_in_text(spark, sf):
    """The value of the roman numeral that names an article."""
    numeral = F.regexp_extract("text", "and ARTICLE ([IVXLCDM]+)", 1)
    return letters(spark, sf).select("o_orderkey", numeral.alias("numeral"), T.roman_value(numeral).cast("int").alias("value"))


@query(f"""WITH {LETTERS}, {_places('le', 'o_orderkey', 'text', '(?i)' + A.PERIOD, 'p')}, d AS (SELECT o_orderkey, {_DAYS} AS days, start FROM p), x AS (SELECT o_orderkey, arg_min(days, start) AS days FROM d WHERE days BETWEEN 1 AND 365 GROUP BY 1),
f AS (SELECT o_orderkey, text, regexp_extract(text, '{_LABELLED}', 1) AS matched FROM le)
SELECT f.o_orderkey, regexp_extract(text, '(?i)our ref[.:]* *([A-Z0-9/-]{{3,}})', 1) AS reference, CASE WHEN matched <> '' THEN {_PARSED} END AS dated, regexp_extract(text, 'We claim (.*?) under', 1) AS subject, regexp_extract(text, '(?i)(?:sub-?clauses?|clauses?) 0*([0-9.]*[0-9])', 1) AS clause, x.days, contains(text, 'Dear Sirs') AS is_letter FROM f LEFT JOIN x ON x.o_orderkey = f.o_orderkey""")
def g26_letter_fields(spark, sf):
    """A letter's reference, date, subject, first clause and first period."""
    own = letters(spark, sf)
    read = A.readings(own.select(F.col("o_orderkey").alias("passage_id"), "text")).where((F.col("kind") == "period") & F.col("days").between(1, A.LONGEST))
    first = read.groupBy(F.col("passage_id").alias("o_orderkey")).agg(F.min_by("days", "start").alias("days"))
    found = F.regexp_extract("text", _LABELLED, 1)
    return own.join(first, "o_orderkey", "left").select(
        "o_orderkey", F.regexp_extract("text", r"(?i)our ref[.:]* *([A-Z0-9/-]{3,})", 1).alias("reference"), F.when(found != "", V.parse_date(found)).alias("dated"), F.regexp_extract("text", "We claim (.*?) under", 1).alias("subject"),
        F.regexp_extract("text", r"(?i)(?:sub-?clauses?|clauses?) 0*([0-9.]*[0-9])", 1).alias("clause"), "days", F.col("text").contains("Dear Sirs").alias("is_letter"))


# Quotations of findings: the middle of a whole document, or of the next one, held against the document that is cited.
@query("""WITH c AS (SELECT d.doc_id, d.doc_id // 3 AS finding, CASE WHEN d.doc_id % 4 = 3 THEN NULL ELSE trim(substr(coalesce(o.text, d.text), 20, 60)) END AS quote, d.text, d.doc_id % 20 = 0 AS unknown, d.lang <> 'en' AS other FROM documents d LEFT JOIN documents o ON o.doc_id = d.doc_id + CASE WHEN d.doc_id % 4 = 1 THEN 1 ELSE 0 END),
f AS (SELECT *, quote IS NOT NULL AND contains(lower(trim(regexp_replace(text, '[[:space:]]+', ' ', 'g'))), lower(trim(regexp_replace(quote, '[[:space:]]+', ' ', 'g')))) AS held FROM c)
SELECT finding, CASE WHEN bool_or(unknown) THEN 'unknown_reference' WHEN bool_or(quote IS NOT NULL AND NOT held) THEN 'unsupported_quotation' WHEN bool_or(other) THEN 'edition_mismatch' ELSE 'grounded' END AS result, count(*) AS citations, count(*) FILTER (WHERE held AND NOT unknown) AS verified FROM f GROUP BY 1""")
def r20_quotations_in_texts(spark, sf):
    """Each finding's worst fault; quotations are passages of documents, looked for in the whole text that is cited, spaces and case folded."""
    d = table(spark, sf, "documents")
    source = F.col("doc_id") + F.when(F.col("doc_id") % 4 == 1, 1).otherwise(0)
    other = d.select(F.col("doc_id").alias("o_id"), F.col("text").alias("o_text"))
    both = d.join(other, source == F.col("o_id"), "left")
    quote = F.when(F.col("doc_id") % 4 != 3, F.trim(F.substring(F.coalesce("o_text", "text"), 20, 60)))
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    rows = both.select(F.floor(F.col("doc_id") / 3).alias("finding"), quote.alias("quote"), "text", (F.col("doc_id") % 20 == 0).alias("unknown"), (F.col("lang") != "en").alias("other"))
    rows = rows.withColumn("held", F.coalesce(F.contains(fold(F.col("text")), fold(F.col("quote"))), F.lit(False)))
    by = rows.groupBy("finding").agg(F.max("unknown").alias("u"), F.max(F.col("quote").isNotNull() & ~F.col("held")).alias("n"), F.max("other").alias("o"), F.count("*").alias("citations"), F.count_if(F.col("held") & ~F.col("unknown")).alias("verified"))
    return by.select("finding", F.when(F.col("u"), "unknown_reference").when(F.col("n"), "unsupported_quotation").when(F.col("o"), "edition_mismatch").otherwise("grounded").alias("result"), "citations", "verified")
