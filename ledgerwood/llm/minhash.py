"""Near-duplicate documents by word shingles (operator 1).

Texts with equal shingle sets are one node. Each node gets a fast similarity sketch,
cut into 32 bands of 4 coordinates: a pair of similarity 0.8 shares no band with a
probability below 1e-7. Nodes that share a band form a bucket, and buckets with the same
least node a group. Links are confirmed on the full sets:

1. The nodes of a group of at most ``BLOCK`` are compared with each other in one block.
2. In a larger group every node is compared with the least node: as many comparisons as
   nodes, each an exact Jaccard distance d. Distance is a metric, so two nodes can be linked
   only if their d differ by 0.2 at most. Nodes that the least node isn't linked with are
   compared with those in their own and the adjacent ranges of d, in blocks of about
   ``BLOCK`` nodes a side; nodes linked with the least node aren't compared with each other.

A block returns a spanning forest of its links, never its pairs. So a large group of near
copies costs its size, plus its outsiders times their range, and no group is cut short or
held by one task: its rows are dealt in parts before they meet what belongs to the group. A
bucket's least node is a written table, so that Spark splits that join where a bucket is hot. The smallest
doc_id of a component is kept.

Defined results: null texts and texts without words have an empty set, are linked with
nothing and kept; repeated rows are copies of each other; rows that share a doc_id but not
a text are nodes of their own; documents with a null doc_id are compared like all others, and
a component's least doc_id is null only where all of its are; extra columns are ignored. Two different sets are taken as
one node with a probability under n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, list_array, staged, table, with_text_columns
from .graph import HOT, components, forest, hot_join
from .shingles import band_keys, fingerprint, shingle_sets, similarity_sketch

WIDTH = 5
#: Percent of the union that the intersection is at least.
PERCENT = 80
#: Nodes on a side of a block of comparisons.
BLOCK = 256
#: Shingles that a block counts at once, about.
PART = 500_000
#: Ranges of distance to the least node; range 0 holds the nodes linked with it.
RANGES = 5


def sketched(docs: DataFrame, width: int, text_col: str, id_col: str) -> DataFrame:
    def make():
        def work(texts):
            sets = shingle_sets(texts, width)
            bands = [band_keys(similarity_sketch(s)) if len(s) else np.empty(0, np.int64) for s in sets]
            nodes = pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64())
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            return [pa.array([len(s) for s in sets], pa.int64()), nodes, list_array(flat, [len(b) for b in bands])]

        return work

    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return with_text_columns(own, "text", "n_shingles bigint, node bigint, bands array<bigint>", make, ["doc_id", "text_hash"])


def node_sets(docs: DataFrame, wanted: DataFrame, width: int, text_col: str, id_col: str) -> DataFrame:
    """(node, n, shingles) of the wanted nodes, each from the document that stands for it."""

    def make():
        def work(texts):
            sets = shingle_sets(texts, width)
            nodes = pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64())
            return [nodes, list_array(np.concatenate(sets).view(np.int64), [len(s) for s in sets])]

        return work

    # An id may be null, and documents may share one: the text's hash and a null-safe id name the document.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    keys = wanted.select(F.col("first_id").alias("k1"), F.col("first_hash").alias("k2"))
    own = texts.join(keys, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("text_hash") == F.col("k2")), "left_semi")
    one = with_text_columns(own, "text", "node bigint, shingles array<bigint>", make, []).where("node IS NOT NULL").dropDuplicates(["node"])
    return one.select("node", F.size("shingles").alias("n"), "shingles")


def linked(both, first, second):
    """The contract's test, in whole numbers."""
    return 100 * both >= PERCENT * (first + second - both)


def near_links(docs: DataFrame, sketches: DataFrame, width: int, text_col: str, id_col: str) -> tuple[DataFrame, list[str]]:
    """Links (u, v) between nodes whose components are those of all links, and the tables that they are read from."""
    nodes = sketches.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
    banded = nodes.select(F.explode("bands").alias("bucket"), "node")
    least = banded.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("members")).where("members > 1").select("bucket", "least")
    # As a written table: Spark splits a skewed join only where both sides come straight from a shuffle.
    least, least_at = staged(least, "least-of-buckets")
    # Two nodes of a bucket share its least node, so buckets with the same one are one group.
    pairs, pairs_at = staged(banded.join(least, "bucket").where("node <> least").select("least", "node").distinct(), "pairs")
    members = pairs.union(pairs.select("least", F.col("least").alias("node")).distinct())
    # The least id stands for a node, null only where no document of the node has one.
    least_id = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"))).alias("k")
    first = sketches.where("n_shingles > 0").groupBy("node").agg(least_id).select("node", "k.first_id", "k.first_hash")
    wanted = members.select("node").distinct().join(first, "node")
    sets, sets_at = staged(node_sets(docs, wanted, width, text_col, id_col), "sets")
    sizes = pairs.groupBy("least").agg(F.count("*").alias("size"))
    sized = hot_join(members.select("least", "node"), sizes.select("least", "size", F.col("size").alias("held")), "least", "node", "size").withColumnRenamed("held", "size")
    # Written, as small and large groups both read it: else the driver holds plans with all of this many times over.
    sized, sized_at = staged(sized, "sized")
    whole = F.struct(F.lit(0).alias("r"), F.lit(0).alias("b"))
    small = sized.where(F.col("size") <= BLOCK).select(F.col("least").alias("group"), whole.alias("low"), whole.alias("high"), F.lit(True).alias("is_low"), "node")
    large = sized.where((F.col("size") > BLOCK) & (F.col("node") != F.col("least"))).select("least", "node", "size")
    compared, compared_at = staged(_compared(large, sets), "compared")
    stars = compared.where("linked").select(F.col("node").alias("u"), F.col("least").alias("v"))
    blocks = small.union(_ranges(compared)).join(sets.select("node", "shingles"), "node")
    links = stars.union(blocks.groupBy("group", "low", "high").applyInPandas(_block_links, "u bigint, v bigint"))
    return links, [least_at, pairs_at, sets_at, sized_at, compared_at]


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Each node's exact likeness to the least node of its group."""
    # The least node's set goes to every part of its group, and a part has about HOT nodes.
    parts = F.ceil(F.col("size") / HOT).cast("int")
    groups = pairs.select("least", "size").distinct().select("least", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    theirs = groups.join(sets.select(F.col("node").alias("least"), F.col("n").alias("least_n"), F.col("shingles").alias("least_shingles")), "least")
    both = F.size(F.array_intersect("shingles", "least_shingles"))
    likeness = both / (F.col("n") + F.col("least_n") - both)
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "node"), parts).cast("int"))
    return dealt.join(sets, "node").join(theirs, ["least", "part"]).select("least", "node", likeness.alias("likeness"), linked(both, F.col("n"), F.col("least_n")).alias("linked"))


def _ranges(compared: DataFrame) -> DataFrame:
    """The blocks that each node of a large group meets, by its range of distance to the least node."""
    span = (100 - PERCENT) / 100
    farther = F.least(F.lit(RANGES - 1), F.greatest(F.lit(1), F.ceil((1 - F.col("likeness")) / span - 1e-9) - 1)).cast("int")
    ranged = compared.select(F.col("least").alias("group"), "node", F.when(F.col("linked"), 0).otherwise(farther).alias("range"))
    counts = ranged.groupBy("group").agg(F.array(*[F.count(F.when(F.col("range") == k, 1)) for k in range(RANGES)]).alias("counts"), F.count("*").alias("size"))
    held = lambda r: F.get("counts", r)
    blocks = lambda r: F.ceil(held(r) / BLOCK).cast("int")
    own = hot_join(ranged, counts, "group", "node", "size").withColumn("block", F.pmod(F.xxhash64("node", "group"), blocks(F.col("range"))).cast("int"))
    # A node meets the blocks of its own range and of both adjacent ones; range 0 doesn't meet itself.
    near = F.filter(F.sequence(F.col("range") - 1, F.col("range") + 1), lambda r: (r >= 0) & (r < RANGES) & ((r > 0) | (F.col("range") > 0)) & (held(r) > 0))
    met = F.flatten(F.transform(near, lambda r: F.transform(F.sequence(F.lit(0), blocks(r) - 1), lambda b: F.struct(r.alias("r"), b.alias("b")))))
    mine = F.struct(F.col("range").alias("r"), F.col("block").alias("b"))
    meets = own.select("group", "node", mine.alias("mine"), F.explode(met).alias("other"))
    return meets.select("group", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") <= F.col("other")).alias("is_low"), "node")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets, by products of incidence matrices of bounded size.

    Shingles are hashes, so a remainder deals them into parts of about ``PART`` values.
    """
    out, wide = np.zeros((len(sets), len(sets)), np.float32), 4096
    parts = 1 + sum(map(len, sets)) // PART
    for k in range(parts):
        own = [s[s.view(np.uint64) % np.uint64(parts) == k] for s in sets] if parts > 1 else sets
        rows = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in own])
        _, at, seen = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = seen > 1
        rows, at = rows[shared[at]], (np.cumsum(shared, dtype=np.int32) - 1)[at[shared[at]]]
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        for start in range(0, int(shared.sum()), wide):
            lo, hi = np.searchsorted(at, [start, start + wide])
            part = np.zeros((len(sets), wide), np.float32)
            part[rows[lo:hi], at[lo:hi] - start] = 1
            out += part @ part.T
    return out.astype(np.int64)


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links of one block of comparisons."""
    low, high = rows["low"].iloc[0], rows["high"].iloc[0]
    sets = [np.asarray(s) for s in rows["shingles"]]
    both, n = shared_counts(sets), np.array([len(s) for s in sets])
    yes = np.triu(linked(both, n[:, None], n[None, :]), 1)
    if low != high:  # two blocks: only across
        side = rows["is_low"].to_numpy()
        yes = np.triu(linked(both, n[:, None], n[None, :]) & (side[:, None] != side[None, :]), 1)
    kept = forest(len(sets), np.argwhere(yes))
    node = rows["node"].to_numpy()
    return pd.DataFrame({"u": [node[a] for a, _ in kept], "v": [node[b] for _, b in kept]}, dtype="int64")


def near_duplicates(docs: DataFrame, width: int = WIDTH, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept; text_hash, and the component's root node."""
    sketches, _ = staged(sketched(docs, width, text_col, id_col), "sketches")
    links, used = near_links(docs, sketches, width, text_col, id_col)
    roots = components(links)
    for path in used:  # components has written the links
        drop_path(docs.sparkSession, path)
    first = sketches.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    placed = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size"))
    # Written: what stays of the documents reads it twice.
    by_node, _ = staged(hot_join(placed, smallest, "root", "node", "size").select("node", "root", "component_id"), "roots")
    out = sketches.select("doc_id", "text_hash", "n_shingles", "node").join(by_node, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "root")


def without_near_duplicates(docs: DataFrame, width: int = WIDTH, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and every one without words."""
    found = near_duplicates(docs, width, text_col, id_col).where("kept")
    one = found.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.doc_id", "k.text_hash", F.lit(True).alias("single"))
    empty = found.where("root IS NULL").select("doc_id", "text_hash", F.lit(False).alias("single")).distinct()
    # An id may be null, and keys that can't be let the join's partitioning serve the next step as well.
    key = lambda c: [F.coalesce(F.col(c).cast("string"), F.lit("")).alias("k1"), F.col(c).isNull().alias("k2")]
    stays = one.union(empty).select(*key("doc_id"), F.col("text_hash").alias("k3"), "single")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key(id_col), F.xxhash64(F.col(text_col)).alias("k3"))
    met = rows.join(stays, ["k1", "k2", "k3"])
    # Of repeated rows one stays: the copies of a kept document share its id and text. Rows without words stay all.
    salt = F.when(F.col("single"), F.lit(-1).cast("bigint")).otherwise(F.monotonically_increasing_id())
    return met.withColumn("salt", salt).dropDuplicates(["k1", "k2", "k3", "salt"]).select("row.*")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4).drop("text_hash", "root")


#: Links and components of a view ``docs``; {width} words, {percent} percent. A link needs a shared shingle.
COMPONENTS_SQL = """
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width} + 2), lambda p: array_to_string(w[p:p + {width} - 1], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= {percent} * (a.n + b.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(node, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.v, r.seen FROM r JOIN e ON e.u = r.node),
k AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
"""

ORACLE = f"""
WITH RECURSIVE docs AS (SELECT * FROM documents), {COMPONENTS_SQL.format(width=4, percent=PERCENT)}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.node = d.doc_id
"""
