"""Queries: pages in their envelope, re-sorting by given scores, widths of vectors, typical records of a type."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relations as R
from ..sources.tables import table
from .registry import query

PAGE, SIZE = 3, 25


@query(f"""WITH r AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'), n AS (SELECT count(*) AS count FROM r), p AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM r)
SELECT n.count, {PAGE}::INTEGER AS page, ceil(n.count / {SIZE}.0)::BIGINT AS pages, CASE WHEN n.count > {PAGE * SIZE} THEN {PAGE + 1} END::INTEGER AS next, CASE WHEN {PAGE} > 1 THEN {PAGE - 1} END::INTEGER AS previous, place, o_orderkey FROM n LEFT JOIN p ON place > {(PAGE - 1) * SIZE} AND place <= {PAGE * SIZE}""")
def k12_page_envelope(spark, sf):
    """A page with the whole count and the numbers of the pages beside it; a page beyond the end keeps its envelope."""
    open_ = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    n = F.col("count")
    envelope = open_.agg(F.count("*").alias("count")).select(
        "count", F.lit(PAGE).alias("page"), F.ceil(n / SIZE).alias("pages"), F.when(n > PAGE * SIZE, PAGE + 1).alias("next"), F.lit(PAGE - 1 if PAGE > 1 else None).cast("int").alias("previous"))
    rows = R.page_of(open_, [F.desc("o_totalprice"), F.col("o_orderkey")], PAGE, SIZE)  # a page's rows, which are numbered alone
    placed = rows.select("o_orderkey", (F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")) + (PAGE - 1) * SIZE).cast("bigint").alias("place"))
    return envelope.join(placed, F.lit(True), "left")


GIVEN = 20


@query(f"""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer ORDER BY position LIMIT 50), s AS (SELECT r.*, value AS score FROM r LEFT JOIN events ON event_id = position AND position <= {GIVEN})
SELECT c_custkey, position, row_number() OVER (ORDER BY CASE WHEN score IS NULL THEN 1 ELSE 0 END, CASE WHEN score IS NOT NULL THEN -score END, position) AS place FROM s""")
def l14_resorted(spark, sf):
    """A ranked list of fifty re-sorted by scores that are given for its first places; ties and the tail keep their order."""
    top = table(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)
    ranked = top.select("c_custkey", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("bigint").alias("position"))  # fifty rows
    given = table(spark, sf, "events").where(F.col("event_id").between(1, GIVEN)).select(F.col("event_id").alias("position"), F.col("value").alias("score"))
    scored = ranked.join(given, "position", "left")
    place = F.row_number().over(Window.orderBy(F.col("score").isNull(), F.desc("score"), "position"))
    return scored.select("c_custkey", "position", place.cast("bigint").alias("place"))


WIDTH = 64


@query(f"""WITH w AS (SELECT len(CASE WHEN vec_id % 37 = 5 THEN embedding[1:32] ELSE embedding END)::INTEGER AS width, count(*) AS vectors FROM embeddings GROUP BY 1) SELECT width, vectors, width = {WIDTH} AS fits, bool_and(width = {WIDTH}) OVER () AS model_may_apply FROM w""")
def v31_vector_widths(spark, sf):
    """Widths of the stored vectors against the detected model's: it may be applied where none differs."""
    cut = F.when(F.col("vec_id") % 37 == 5, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    by = table(spark, sf, "embeddings").groupBy(F.size(cut).alias("width")).agg(F.count("*").alias("vectors")).withColumn("fits", F.col("width") == WIDTH)
    return by.crossJoin(F.broadcast(by.agg(F.every("fits").alias("model_may_apply"))))  # one row


# Records that are typical of a claim's type.
TYPICAL = {"time": ["programme", "daily_report", "notice"], "money": ["invoice", "measurement_sheet"], "both": ["programme", "invoice", "notice"]}
_TYPICAL = ", ".join(f"('{t}', '{r}')" for t, rs in TYPICAL.items() for r in rs)


@query(f"""WITH ty(kind, record) AS (VALUES {_TYPICAL}), c AS (SELECT o_orderkey AS claim_id, ['time', 'money', 'both', 'other'][o_orderkey % 4 + 1] AS kind FROM orders), h AS (SELECT DISTINCT l_orderkey AS claim_id, ['programme', 'invoice', 'notice', 'daily_report', 'letter'][(l_partkey % 5)::INTEGER + 1] AS record FROM lineitem),
m AS (SELECT c.claim_id, ty.record, h.record IS NOT NULL AS held FROM c JOIN ty USING (kind) LEFT JOIN h ON h.claim_id = c.claim_id AND h.record = ty.record)
SELECT claim_id, count(*) AS typical, count(*) FILTER (WHERE held) AS held, coalesce(string_agg(record, ',' ORDER BY record) FILTER (WHERE NOT held), '') AS missing, CASE WHEN bool_and(held) THEN 'satisfied' ELSE 'incomplete' END AS status FROM m GROUP BY 1""")
def c19_typical_records(spark, sf):
    """Which records that are typical of a claim's type are there (check RC2): advice, it bars nothing."""
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))
    claims = table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), pick(["time", "money", "both", "other"], F.col("o_orderkey") % 4).alias("kind"))
    typical = spark.createDataFrame([(t, r) for t, rs in TYPICAL.items() for r in rs], "kind string, record string")
    held = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), pick(["programme", "invoice", "notice", "daily_report", "letter"], F.col("l_partkey") % 5).alias("record")).distinct().withColumn("held", F.lit(True))
    met = claims.join(R.dimension(typical, 8), "kind").join(held, ["claim_id", "record"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    missing = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("held"), F.col("record")))), ",")  # a type has three at most
    return met.groupBy("claim_id").agg(F.count("*").alias("typical"), F.count_if("held").alias("held"), missing.alias("missing"), F.when(F.every("held"), "satisfied").otherwise("incomplete").alias("status"))
