"""Queries: more joins, aggregates, windows and listings over the claims tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import documents as D
from ..operators import relations as R
from ..sources.tables import table
from .registry import query

# Roles and the permissions that they grant.
ROLES = {"owner": ["read", "write", "approve"], "reviewer": ["read", "approve"], "viewer": ["read"]}
_ROLES = ", ".join(f"('{r}', {p})" for r, p in ROLES.items())


@query("SELECT doc_id, text IS NULL AS missing FROM documents WHERE len(list_intersect(regexp_split_to_array(lower(text), '[^a-z]+'), ['license', 'copyright', 'idiot'])) > 0")
def f20_full_text_match(spark, sf):
    found = F.arrays_overlap(F.split(F.lower("text"), "[^a-z]+"), F.array(*[F.lit(w) for w in ("license", "copyright", "idiot")]))
    return table(spark, sf, "documents").where(found).select("doc_id", F.col("text").isNull().alias("missing"))


@query(f"""WITH roles(role, permissions) AS (VALUES {_ROLES}), m AS (SELECT c_custkey AS "user", c_nationkey AS project, ['owner', 'reviewer', 'viewer', 'stranger'][c_custkey % 4 + 1] AS role FROM customer)
SELECT "user", project, array_to_string(list_sort(list_distinct(flatten(list(permissions)))), ',') AS granted FROM m JOIN roles USING (role) GROUP BY 1, 2""")
def f23_permissions(spark, sf):
    """Grants of every role a user has in a project; an unknown role grants nothing."""
    roles = spark.createDataFrame(list(ROLES.items()), "role string, permissions array<string>")
    role = F.get(F.array(*[F.lit(r) for r in ("owner", "reviewer", "viewer", "stranger")]), (F.col("c_custkey") % 4).cast("int"))
    m = table(spark, sf, "customer").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("project"), role.alias("role"))
    granted = m.join(R.dimension(roles, len(ROLES)), "role").select("user", "project", F.explode("permissions").alias("p"))
    return granted.groupBy("user", "project").agg(F.array_join(F.sort_array(F.collect_set("p")), ",").alias("granted"))


@query("SELECT n_nationkey FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000)")
def j05_not_in(spark, sf):
    n = table(spark, sf, "nation")
    rich = n.join(table(spark, sf, "supplier").where("s_acctbal > 9000"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name")
    return n.join(rich, "n_name", "left_anti").select("n_nationkey")


@query("SELECT doc_id, quality, lang FROM documents LEFT JOIN labels USING (doc_id)")
def j10_reviews_by_document(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality", "lang")


@query("SELECT c_custkey, coalesce(n, 0) AS projects FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey")
def j11_counts_by_user(spark, sf):
    counts = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").join(counts, "c_nationkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("projects"))


@query("""SELECT o_orderkey, arg_min(l_linenumber, (l_shipdate, l_linenumber, l_partkey)) AS first_line, min(l_shipdate) AS shipped FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate GROUP BY 1""")
def j14_earliest_match(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")))
    first = lines.groupBy("o_orderkey").agg(F.min(F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("f"))
    return table(spark, sf, "orders").select("o_orderkey").join(first, "o_orderkey", "left").select("o_orderkey", F.col("f.l_linenumber").alias("first_line"), F.col("f.l_shipdate").alias("shipped"))


_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> '')"


@query(rf"""WITH d AS (SELECT doc_id, ' ' || array_to_string({_WORDS.format("text")}, ' ') || ' ' AS hay, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, ' ' || array_to_string({_WORDS.format("text")}, ' ') || ' ' AS needle, list_distinct(list_filter({_WORDS.format("text")}, lambda x: length(x) > 5)) AS t FROM benchmark),
s AS (SELECT doc_id, item_id, CASE WHEN contains(hay, needle) THEN 3 ELSE 0 END + CASE WHEN len(list_intersect(list_distinct(w), t)) >= greatest(2, len(t) // 3) THEN 2 ELSE 0 END AS strong, CASE WHEN doc_id % 7 = item_id % 7 THEN 1 ELSE 0 END AS clause FROM d, b)
SELECT doc_id, item_id, (strong + clause)::INTEGER AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY strong + clause DESC, item_id) AS n FROM s WHERE strong > 0) WHERE n <= 5""")
def j16_scored_match(spark, sf):
    """Each document's five best items: 3 points where it stands in the text, 2 for enough of its long words, 1 for a shared clause.

    Words are met by an equi-join and counted by pair; no text is compared with all items.
    """
    d, b = table(spark, sf, "documents").where("text IS NOT NULL"), table(spark, sf, "benchmark")
    long_words = lambda df, key: df.select(key, F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 5))).alias("w"))
    theirs = long_words(b, "item_id")
    enough = theirs.groupBy("item_id").agg(F.greatest(F.lit(2), F.floor(F.count("*") / 3)).alias("least"))
    hits = long_words(d, "doc_id").join(theirs, "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"))
    by_words = hits.join(enough, "item_id").where("hits >= least").select("doc_id", "item_id", F.lit(2).alias("points"))
    whole = D.containing(d, b).withColumn("points", F.lit(3))
    scored = by_words.union(whole).groupBy("doc_id", "item_id").agg(F.sum("points").alias("points"))
    scored = scored.withColumn("score", (F.col("points") + F.when(F.col("doc_id") % 7 == F.col("item_id") % 7, 1).otherwise(0)).cast("int"))
    return R.top_per_key(scored, ["doc_id"], [F.desc("score"), F.col("item_id")], 5).select("doc_id", "item_id", "score")


_QUOTES = rf"""x AS (SELECT l_orderkey, l_linenumber, a.text AS source, CASE WHEN l_linenumber % 3 = 0 THEN substring(a.text, 20, 40) WHEN l_linenumber % 3 = 1 THEN replace(substring(a.text, 20, 40), ' ', '  ') ELSE substring(b.text, 20, 40) END AS quote
FROM lineitem LEFT JOIN documents a ON a.doc_id = l_partkey LEFT JOIN documents b ON b.doc_id = l_partkey + 1),
v AS (SELECT l_orderkey, l_linenumber, source IS NOT NULL AS known, coalesce(contains(lower(trim(regexp_replace(source, '\s+', ' ', 'g'), ' ')), lower(trim(regexp_replace(quote, '\s+', ' ', 'g'), ' '))) OR contains(lower(regexp_replace(source, '\s+', '', 'g')), lower(regexp_replace(quote, '\s+', '', 'g'))), false) AS verified FROM x)"""


def _squeezed(text):
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _quotations(spark, sf):
    """Every line cites the document of its part's number and quotes that one or the next, some with other spacing.

    A document is folded once, before the lines that cite it meet it.
    """
    d = table(spark, sf, "documents")
    sources = d.select(F.col("doc_id").alias("l_partkey"), _squeezed(F.col("text")).alias("plain"), T.fold_all(F.col("text")).alias("bare"), F.substring("text", 20, 40).alias("own"))
    cited = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(sources, "l_partkey", "left")
    both = cited.join(d.select((F.col("doc_id") - 1).alias("l_partkey"), F.substring("text", 20, 40).alias("other")), "l_partkey", "left")
    n, own = F.col("l_linenumber") % 3, F.col("own")
    return both.withColumn("quote", F.when(n == 0, own).when(n == 1, F.replace(own, F.lit(" "), F.lit("  "))).otherwise(F.col("other")))


@query(f"WITH {_QUOTES} SELECT l_orderkey, l_linenumber, known, verified FROM v")
def j18_quotation(spark, sf):
    """Whether the cited source holds the quoted text, folded, or with all white space left out."""
    held = F.col("plain").contains(_squeezed(F.col("quote"))) | F.col("bare").contains(T.fold_all(F.col("quote")))
    return _quotations(spark, sf).select("l_orderkey", "l_linenumber", F.col("plain").isNotNull().alias("known"), F.coalesce(held, F.lit(False)).alias("verified"))


@query(f"WITH {_QUOTES} SELECT l_orderkey, count(*) AS citations, count(*) FILTER (WHERE NOT known) AS unknown, count(*) FILTER (WHERE verified) AS verified FROM v GROUP BY 1")
def a28_grounding(spark, sf):
    """Counters of each finding's citations."""
    rows = j18_quotation(spark, sf)
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("citations"), F.count_if(~F.col("known")).alias("unknown"), F.count_if("verified").alias("verified"))


@query("""WITH w AS (SELECT p_partkey AS model FROM part WHERE p_size <= 25), i AS (SELECT DISTINCT l_partkey AS model FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40)
SELECT coalesce(w.model, i.model) AS model, CASE WHEN i.model IS NULL THEN 'missing' WHEN w.model IS NULL THEN 'unlisted' ELSE 'available' END AS status FROM w FULL JOIN i ON w.model = i.model""")
def j23_availability(spark, sf):
    """What is configured against what is installed: available, missing, or installed without being listed."""
    wanted = table(spark, sf, "part").where("p_size <= 25").select(F.col("p_partkey").alias("model"), F.lit(True).alias("listed"))
    there = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 40").select(F.col("l_partkey").alias("model")).distinct().withColumn("installed", F.lit(True))
    status = F.when(F.col("installed").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").otherwise("available")
    return wanted.join(there, "model", "full").select("model", status.alias("status"))


@query("""SELECT source, CASE WHEN count(q) = 0 THEN NULL ELSE sum(w * q) / sum(CASE WHEN q IS NOT NULL THEN w END) END AS score FROM (SELECT source, (doc_id % 3 + 1)::DOUBLE AS w, quality::DOUBLE AS q FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def a14_weighted_mean(spark, sf):
    """Weights of missing signals drop out."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("source", (F.col("doc_id") % 3 + 1).cast("double").alias("w"), F.col("quality").cast("double").alias("q"))
    return d.groupBy("source").agg((F.sum(F.col("w") * F.col("q")) / F.sum(F.when(F.col("q").isNotNull(), F.col("w")))).alias("score"))


@query("SELECT lang, count(*) FILTER (WHERE n_chars >= 1000)::DOUBLE / count(*) AS share, avg(quality) AS mean_quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a15_ratio_and_mean(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg((F.count_if(F.col("n_chars") >= 1000) / F.count("*")).alias("share"), F.avg("quality").alias("mean_quality"))


@query("""SELECT p_brand, len(list_filter(range(1, 51), lambda k: list_contains(list(DISTINCT p_size::BIGINT), k)))::DOUBLE / 50 AS coverage FROM part GROUP BY 1""")
def a17_coverage(spark, sf):
    seen = F.collect_set("p_size")
    return table(spark, sf, "part").groupBy("p_brand").agg((F.size(F.array_intersect(F.sequence(F.lit(1), F.lit(50)), seen)) / 50).alias("coverage"))


@query("SELECT conv_id, arg_min(role, (CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, turn)) AS lowest FROM conversations GROUP BY 1")
def a20_ordinal_minimum(spark, sf):
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("role", F.struct(rank, "turn")).alias("lowest"))


@query("SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END::DECIMAL(18,2))::DOUBLE AS total, CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE o_orderpriority END AS currency FROM orders GROUP BY 1, 3")
def a23_totals_by_currency(spark, sf):
    currency = F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(F.col("o_orderpriority"))
    cents = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).cast("decimal(18,2)")
    return table(spark, sf, "orders").groupBy("o_custkey", currency.alias("currency")).agg(F.sum(cents).cast("double").alias("total"))


@query("SELECT conv_id, sum(length(text))::BIGINT AS chars, count(*) FILTER (WHERE trim(text) = '') AS empty, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1")
def a26_document_totals(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.count_if(F.trim("text") == "").alias("empty"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


@query("""SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, island::BIGINT AS island FROM (SELECT *, sum(CASE WHEN event_type = 'login' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events) GROUP BY 1, 4""")
def w09_islands_by_marker(spark, sf):
    e = R.islands(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "login", F.to_date("ts"))
    return e.groupBy("user_id", "island").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS a, l_shipdate::DATE + floor(l_quantity / 2)::INTEGER AS b, l_partkey FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN before >= a THEN before + 1 ELSE a END AS starts, b AS stops FROM m WHERE before IS NULL OR before < b""")
def w10_without_overlaps(spark, sf):
    """Spans of an order with their starts moved behind what is covered already."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("a"), F.expr("date_add(to_date(l_shipdate), CAST(floor(l_quantity / 2) AS INT))").alias("b"), "l_partkey")
    moved = R.spanned(line, ["l_orderkey"], ["a", "b", "l_linenumber", "l_partkey"], F.year("a"), largest={"before": "b"}).where("before IS NULL OR before < b")
    return moved.select("l_orderkey", "l_linenumber", F.when(F.col("before") >= F.col("a"), F.date_add("before", 1)).otherwise(F.col("a")).alias("starts"), F.col("b").alias("stops"))


@query("SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1) ORDER BY page_id) AS n FROM pages")
def w12_number_per_host(spark, sf):
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return R.numbered(table(spark, sf, "pages").select("page_id", "url", host.alias("host")), "host", "page_id")


@query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey) AS n FROM part) WHERE n = 1")
def w16_first_by_key(spark, sf):
    best = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.min(F.struct("p_size", "p_partkey", "p_name")).alias("x"))
    return best.select("x.p_partkey", "x.p_name")


@query("""SELECT p_partkey, number FROM (SELECT p_partkey, (p_size)::VARCHAR || '.' || (p_partkey % 12)::VARCHAR AS number, p_size AS a, p_partkey % 12 AS b FROM part) ORDER BY a, b, p_partkey LIMIT 100""")
def l05_natural_order(spark, sf):
    number = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 12).cast("string"))
    return table(spark, sf, "part").select("p_partkey", number.alias("number")).orderBy(T.natural_key(F.col("number")), "p_partkey").limit(100)


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders ORDER BY o_orderdate::DATE, o_orderkey LIMIT 300")
def l12_earliest(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")).orderBy("day", "o_orderkey").limit(300)


@query("""SELECT doc_id, len(d) AS n, md5(array_to_string(d, ' ')) AS words FROM (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS d FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 2) AS w FROM documents))""")
def u07_ordered_distinct(spark, sf):
    """Every text's distinct words in the order of their first places."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 2))
    return table(spark, sf, "documents").select("doc_id", F.size(words).cast("bigint").alias("n"), F.md5(F.array_join(words, " ").cast("binary")).alias("words"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[0-9]{1,3}(\.[0-9]{1,3}){3}'))::BIGINT AS n, regexp_replace(text, '[0-9]{1,3}(\.[0-9]{1,3}){3}', '#', 'g') <> text AS masked FROM documents""")
def t15_masked_numbers(spark, sf):
    pattern = r"[0-9]{1,3}(\.[0-9]{1,3}){3}"
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(pattern)).cast("bigint").alias("n"), (F.regexp_replace("text", pattern, "#") != F.col("text")).alias("masked"))


@query(r"""SELECT source, doc_id // 20 AS pages, md5(string_agg(left(text, 350), E'\n' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1, 2""")
def t17_page_digest(spark, sf):
    """The digest of the beginnings of up to 20 pages of a source: a list is never longer, however large the source."""
    pages = F.array_sort(F.collect_list(F.struct("doc_id", F.substring("text", 1, 350).alias("t"))))
    by = table(spark, sf, "documents").groupBy("source", F.floor(F.col("doc_id") / 20).alias("pages"))
    return by.agg(F.md5(F.array_join(F.transform(pages, lambda p: p["t"]), "\n").cast("binary")).alias("digest"))


@query("SELECT vec_id, sha256(array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::BIGINT), ',')) AS hash FROM embeddings")
def t25_content_hash(spark, sf):
    parts = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint").cast("string"))
    return table(spark, sf, "embeddings").select("vec_id", F.sha2(F.array_join(parts, ",").cast("binary"), 256).alias("hash"))


@query("SELECT o_orderkey, greatest(0, date_diff('day', DATE '1997-06-30', o_orderdate::DATE + 28)) AS left_, CASE WHEN o_totalprice <= 100000 THEN 100.0 WHEN o_totalprice <= 300000 THEN 50.0 ELSE 10.0 END::DOUBLE AS points FROM orders")
def m06_days_remaining(spark, sf):
    due = F.date_add(F.to_date("o_orderdate"), 28)
    left = F.greatest(F.lit(0), F.datediff(due, F.lit("1997-06-30").cast("date")))
    points = F.when(F.col("o_totalprice") <= 100000, 100.0).when(F.col("o_totalprice") <= 300000, 50.0).otherwise(10.0)
    return table(spark, sf, "orders").select("o_orderkey", left.cast("bigint").alias("left_"), points.alias("points"))


@query("SELECT s_suppkey, s_suppkey / 1000.0::DOUBLE AS billions, s_suppkey::DOUBLE AS whole FROM supplier")
def m16_sizes(spark, sf):
    key = F.col("s_suppkey").cast("string")
    return table(spark, sf, "supplier").select("s_suppkey", V.size_in_billions(F.concat(key, F.lit("M"))).alias("billions"), V.size_in_billions(F.concat(key, F.lit("B"))).alias("whole"))


@query("SELECT conv_id, turn, to_json({'role': role, 'n': length(text)})::VARCHAR AS snapshot FROM conversations")
def v17_snapshot(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", F.length("text").alias("n"))).alias("snapshot"))


@query("""SELECT c_custkey, concat_ws('; ', 'party ' || c_name, 'segment ' || coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, 'not recorded')) AS summary FROM customer""")
def v18_summary_text(spark, sf):
    segment = F.coalesce(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), F.lit("not recorded"))
    return table(spark, sf, "customer").select("c_custkey", F.concat_ws("; ", F.concat(F.lit("party "), "c_name"), F.concat(F.lit("segment "), segment)).alias("summary"))


@query("SELECT recipient, count(*) FILTER (WHERE unread) AS unread, count(*) AS total FROM (SELECT user_id % 20 AS recipient, event_type <> 'view' AS unread FROM events) GROUP BY 1")
def v30_unread(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("recipient"), (F.col("event_type") != "view").alias("unread"))
    return e.groupBy("recipient").agg(F.count_if("unread").alias("unread"), F.count("*").alias("total"))
