"""Queries: text, dates, numbers, arrays and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..sources.tables import table
from .registry import query

_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]"


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n\s*\n+', E'\n\n', 'g'), ' ') AS squeezed FROM documents""")
def t01_squeeze(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.squeeze(F.col("text")).alias("squeezed"))


@query(r"""SELECT doc_id, md5(lower(trim(regexp_replace(translate(text, '‘’“”–—', '''''""--'), '\s+', ' ', 'g'), ' '))) AS folded, sha256(lower(regexp_replace(text, '\s+', '', 'g'))) AS hash FROM documents""")
def t02_fold(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("folded"), F.sha2(T.fold_all(F.col("text")).cast("binary"), 256).alias("hash"))


@query(r"""SELECT p_partkey, lower(trim(regexp_replace(p_name || '  ' || p_type, '\s+', ' ', 'g'))) AS title FROM part""")
def t04_title(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.title_key(F.concat("p_name", F.lit("  "), "p_type")).alias("title"))


@query(r"""SELECT doc_id, n, CASE WHEN length(k) <= 60 THEN regexp_replace(k, '[0-9]+', '#', 'g') ELSE k END AS line_key FROM (
SELECT doc_id, n, lower(trim(regexp_replace(l, '\s+', ' ', 'g'), ' ')) AS k FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS l, generate_subscripts(string_split(text, E'\n'), 1) - 1 AS n FROM documents))""")
def t05_line_keys(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return d.select("doc_id", F.col("n").cast("bigint").alias("n"), T.line_key(F.col("line")).alias("line_key"))


@query("""SELECT c_custkey, CASE WHEN lower(trim(c_mktsegment)) IN ('none', 'n/a', 'machinery') THEN NULL ELSE c_mktsegment END AS segment FROM customer""")
def t07_absent(spark, sf):
    c = table(spark, sf, "customer")
    said = F.when(F.lower("c_mktsegment") == "machinery", F.lit(" N/A ")).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", T.absent_to_null(said).alias("segment"))


@query(r"""WITH n AS (SELECT p_partkey, printf('%02d.%d.0%d', p_size, p_partkey % 7, p_partkey % 3) AS raw FROM part)
SELECT p_partkey, p_size::VARCHAR || '.' || (p_partkey % 7)::VARCHAR || '.' || (p_partkey % 3)::VARCHAR AS number, 3 AS depth, p_size::VARCHAR || '.' || (p_partkey % 7)::VARCHAR AS parent
FROM n JOIN part USING (p_partkey)""")
def t08_clause_numbers(spark, sf):
    raw = F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(".0"), (F.col("p_partkey") % 3).cast("string"), F.lit(".: "))
    n = table(spark, sf, "part").select("p_partkey", T.clause_number(raw).alias("number"))
    return n.select("p_partkey", "number", T.clause_depth(F.col("number")).alias("depth"), T.clause_parent(F.col("number")).alias("parent"))


@query(r"""SELECT p_partkey, (p_size % 9)::VARCHAR || '.1' || (p_partkey % 10)::VARCHAR || '.Oll' AS fixed FROM part""")
def t10_repair_digits(spark, sf):
    raw = F.concat((F.col("p_size") % 9).cast("string"), F.lit(".l"), (F.col("p_partkey") % 10).cast("string"), F.lit(".Oll"))
    return table(spark, sf, "part").select("p_partkey", T.repair_digits(raw).alias("fixed"))


@query("""SELECT n_nationkey, ['X', 'IX', 'XIV', 'XL', 'MCMXCIV'][n_nationkey % 5 + 1] AS numeral, [10, 9, 14, 40, 1994][n_nationkey % 5 + 1] AS value FROM nation""")
def t11_roman(spark, sf):
    numeral = F.get(F.array(*[F.lit(x) for x in ("X", "IX", "XIV", "XL", "MCMXCIV")]), F.col("n_nationkey") % 5)
    return table(spark, sf, "nation").select("n_nationkey", numeral.alias("numeral"), T.roman_value(numeral).alias("value"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT *, list_filter(w, lambda x: length(x) > 3) AS long FROM w)
SELECT doc_id, CASE WHEN len(long) > 0 THEN len(list_filter(long, lambda x: regexp_matches(x, '^[A-Z]')))::DOUBLE / len(long) ELSE 0.0 END AS capitals,
CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '[0-9]')))::DOUBLE / len(w) ELSE 0.0 END AS numeric FROM l""")
def t12_word_shares(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.capital_ratio(F.col("text")).alias("capitals"), T.numeric_share(F.col("text")).alias("numeric"))


@query(r"""SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS found, len(hits)::BIGINT AS n FROM (
SELECT doc_id, hits, list_filter(hits, lambda x, i: list_position(hits, x) = i) AS list_distinct_ordered FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9.]+@[a-z0-9.]+') AS hits FROM documents))""")
def t14_extract_all(spark, sf):
    hits = F.regexp_extract_all("text", F.lit("[A-Za-z0-9.]+@[a-z0-9.]+"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_distinct(hits), "|").alias("found"), F.size(hits).cast("bigint").alias("n"))


@query(r"""SELECT doc_id, (CASE WHEN greatest(1, p - 180) > 1 THEN '…' ELSE '' END) || trim(text[greatest(1, p - 180):least(length(text), p + 180)], ' ') || (CASE WHEN least(length(text), p + 180) < length(text) THEN '…' ELSE '' END) AS excerpt
FROM (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents) WHERE p > 0""")
def t16_excerpt(spark, sf):
    d = table(spark, sf, "documents").withColumn("p", F.instr(F.lower("text"), "license")).where("p > 0")
    return d.select("doc_id", T.excerpt(F.col("text"), F.col("p")).alias("excerpt"))


@query(r"""SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS tail, CASE WHEN regexp_replace(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[\x00-\x1f<>:"|?*]', '_', 'g'), '^\.+', '') = '' THEN 'file'
ELSE substring(regexp_replace(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[\x00-\x1f<>:"|?*]', '_', 'g'), '^\.+', ''), 1, 120) END AS filename FROM pages""")
def t18_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"([^/\\]*)$", 1).alias("tail"), T.safe_filename(F.col("url")).alias("filename"))


@query("""SELECT s_suppkey, s_name AS reference, lower(s_name) || ':latest' AS model FROM supplier""")
def t19_labels(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", T.without_label(F.concat(F.lit("Our Ref: "), "s_name")).alias("reference"), T.model_name(F.concat("s_name", F.lit("-q4_K_M "))).alias("model"))


@query("""SELECT o_orderkey, concat_ws(' — ', o_orderpriority, CASE WHEN o_orderstatus <> 'F' THEN 'clause ' || o_orderstatus END, 'p. ' || (o_orderkey % 40)::VARCHAR) AS citation FROM orders""")
def t22_citation(spark, sf):
    clause = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("clause "), "o_orderstatus"))
    page = F.concat(F.lit("p. "), (F.col("o_orderkey") % 40).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws(" — ", "o_orderpriority", clause, page).alias("citation"))


@query(r"""SELECT n_regionkey, string_agg(trim(n_name) || ' | ' || (n_nationkey)::VARCHAR, E'\n' ORDER BY n_nationkey) AS cells FROM nation GROUP BY 1""")
def t23_table_text(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", F.array("n_name", F.col("n_nationkey").cast("string")).alias("cells"))))
    grouped = table(spark, sf, "nation").groupBy("n_regionkey").agg(rows.alias("rows"))
    blank = F.array(F.array(F.lit(" "), F.lit(None).cast("string")))
    return grouped.select("n_regionkey", T.table_text(F.concat(F.transform("rows", lambda r: r["cells"]), blank)).alias("cells"))


@query("""SELECT o_orderkey, o_orderdate::DATE AS day FROM orders""")
def m01_parse_dates(spark, sf):
    """Each date written in one of the known ways reads back as itself."""
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    forms = ["yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "d/M/yyyy", "d.M.yyyy"]
    k = F.col("o_orderkey") % len(forms)
    text = F.coalesce(*[F.when(k == i, F.date_format("d", f)) for i, f in enumerate(forms)])
    return o.select("o_orderkey", V.parse_date(text).alias("day"))


@query("""SELECT o_orderkey, o_orderdate::DATE + 28 AS calendar, (SELECT g::DATE FROM (SELECT g, row_number() OVER (ORDER BY g) AS n FROM range(o_orderdate::DATE + 1, o_orderdate::DATE + 40, INTERVAL 1 DAY) t(g) WHERE isodow(g) < 6 AND g::DATE NOT IN (DATE '1995-12-25', DATE '1996-01-01')) WHERE n = 14) AS working FROM orders WHERE o_orderkey % 4 = 0 OR o_orderpriority <> ''""")
def m04_deadlines(spark, sf):
    day = F.to_date("o_orderdate")
    holidays = F.array(F.lit("1995-12-25").cast("date"), F.lit("1996-01-01").cast("date"))
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", V.add_days(day, 28).alias("calendar"), V.add_days(day, 14, True, holidays).alias("working"))


# Working days before a day: whole weeks since a Monday, and the rest up to Friday.
_WORKED = "5 * (({0} + 1 - DATE '1969-12-29') // 7) + least(({0} + 1 - DATE '1969-12-29') % 7, 5)"


@query(f"""SELECT l_orderkey, l_linenumber, date_diff('day', a, b) AS days, ({_WORKED.format("b")}) - ({_WORKED.format("a")}) AS working FROM (SELECT *, o_orderdate::DATE AS a, l_shipdate::DATE AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""")
def m05_day_counts(spark, sf):
    """Signed calendar and working days from the order to the shipment, of every line."""
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    return both.select("l_orderkey", "l_linenumber", V.count_days(a, b).cast("bigint").alias("days"), V.count_days(a, b, True).cast("bigint").alias("working"))


@query("""SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN ts::DATE END, ts::DATE - 2) AS effective, date_diff('day', DATE '2025-01-01', ts::DATE) AS remaining FROM events""")
def m07_effective_dates(spark, sf):
    day = F.to_date("ts")
    received = F.when(F.col("event_type") == "view", day)
    return table(spark, sf, "events").select("event_id", F.coalesce(received, F.date_sub(day, 2)).alias("effective"), F.datediff(day, F.lit("2025-01-01").cast("date")).cast("bigint").alias("remaining"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 1000000 WHEN s_suppkey % 3 = 1 THEN s_suppkey END::DOUBLE AS amount, ['USD', 'EUR', 'GBP', 'AED'][s_suppkey % 4 + 1] AS currency, nullif(s_suppkey, 0) AS days FROM supplier""")
def m09_amounts(spark, sf):
    key = F.col("s_suppkey").cast("string")
    said = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("about "), key, F.lit(" million"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("a sum of "), key, F.lit(" only"))).otherwise(F.concat(key, F.lit(" or 999999")))
    word = F.get(F.array(*[F.lit(x) for x in (" Dollars", "€", "pound", "aed")]), F.col("s_suppkey") % 4)
    days = V.first_days(F.concat(F.lit("within "), key, F.lit(" days")))
    return table(spark, sf, "supplier").select("s_suppkey", V.amount(said).cast("double").alias("amount"), V.currency(word).alias("currency"), days.cast("bigint").alias("days"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0.0 WHEN p_size <= 20 THEN 0.0 + (p_size - 10.0::DOUBLE) * 5.0::DOUBLE WHEN p_size <= 40 THEN 50.0 + (p_size - 20.0::DOUBLE) * 2.0::DOUBLE ELSE 90.0 END::DOUBLE AS points,
CASE WHEN p_retailprice >= 1500 THEN 'good' WHEN p_retailprice >= 1200 THEN 'usable' WHEN p_retailprice >= 900 THEN 'poor' ELSE 'unusable' END AS band FROM part""")
def m14_scores(spark, sf):
    price = F.col("p_retailprice")
    scaled = F.when(price >= 1500, 0.9).when(price >= 1200, 0.7).when(price >= 900, 0.5).otherwise(0.1)
    return table(spark, sf, "part").select("p_partkey", V.piecewise(F.col("p_size").cast("double"), [(10, 0), (20, 50), (40, 90)]).alias("points"), V.quality_band(scaled).alias("band"))


@query("""SELECT a.vec_id, b.vec_id AS other, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def m19_cosine(spark, sf):
    a = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("e2"))
    return a.join(b, "vec_id").select("vec_id", "other", F.round(1 - V.cosine(F.col("embedding"), F.col("e2")), 6).alias("distance"))


@query("""SELECT event_id, json_extract_string(props, '$.page') AS page, TRY_CAST(json_extract_string(props, '$.n') AS BIGINT) AS n FROM events""")
def m21_json(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.n").try_cast("bigint").alias("n"))


@query("""SELECT p_partkey FROM part WHERE len(list_filter([p_size::VARCHAR, (p_size % 5)::VARCHAR || '.' || (p_partkey % 3)::VARCHAR], lambda r: r = '2' OR starts_with(r, '2.'))) > 0""")
def m22_membership(spark, sf):
    refs = F.array(F.col("p_size").cast("string"), F.concat((F.col("p_size") % 5).cast("string"), F.lit("."), (F.col("p_partkey") % 3).cast("string")))
    return table(spark, sf, "part").where(F.exists(refs, lambda r: T.clause_under(r, "2"))).select("p_partkey")


@query("""SELECT doc_id, md5(translate(lower(text), 'àâäáãçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaceeeeiiiinooooouuuuyy')) AS unaccented FROM documents""")
def t24_unaccented(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.unaccented(F.col("text")).cast("binary")).alias("unaccented"))


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 9 AND p_partkey % 2 = 0 THEN 'S' || p_size::VARCHAR END AS ref FROM part""")
def t21_source_refs(spark, sf):
    """References written in several ways; an odd part names two sources, so neither counts."""
    n = F.col("p_size").cast("string")
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("see [s"), n, F.lit("] and source "), n)).otherwise(F.concat(F.lit("S"), n, F.lit(", S"), (F.col("p_size") % 9 + 1).cast("string"), F.lit(", S"), ((F.col("p_size") + 4) % 9 + 1).cast("string")))
    known = F.array(*[F.lit(f"S{i}") for i in range(1, 10)])
    return table(spark, sf, "part").select("p_partkey", T.source_ref(said, known).alias("ref"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderdate::DATE END AS dated FROM orders""")
def m03_labelled_dates(spark, sf):
    """The date that follows a label within twelve characters; one that stands farther off isn't its date."""
    day = F.date_format("o_orderdate", "d MMMM yyyy")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Ref 7. Date: "), day)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("dated this  "), day)).otherwise(F.concat(F.lit("date of nothing in particular, but "), day))
    found = F.regexp_extract(said, r"(?i)\bdated?\b.{0,12}?(\d{1,2} [A-Z][a-z]+ \d{4})", 1)
    return table(spark, sf, "orders").select("o_orderkey", V.parse_date(found).alias("dated"))
