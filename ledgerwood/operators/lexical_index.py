"""Ranked full-text search over a stored positional index.

Texts become terms: accents folded, lower case, stop words left out (their places still count), English stems.
The index is one table, a row for each term and block of chunks: (bucket, term, block, most, n, chunk_ids, ends, positions,
words), partitioned by bucket of the term and sorted by term and block, so that a query reads the row groups of its own terms.
``positions`` has those of all chunks one after another, ``ends`` where each chunk's end, ``most`` the most of one chunk, ``words``
the words of the term (in a segment's first block with it, else none). It is read as three:

* ``words`` (word, term): the vocabulary;
* ``postings`` (bucket, term, block, chunk_id, positions, weight), a row for each term and chunk;
* ``heads`` (bucket, term, block, bound, n): for each term and block of chunks, the highest weight in it.

Neither texts nor occurrences are shuffled. A task turns its chunks into segments of bounded size, a segment's distinct words
into stems, and writes the segment's postings itself: an index takes the disk of its own files alone. A block is a run of a
segment's chunks, so all terms of a chunk are in one block. There are up to BUCKETS files a task of the scan. A word is stemmed
once a segment, however often it occurs.

A chunk's rank is the sum of its terms' weights over the number of the query's terms; a weight falls off with the
square of an occurrence's number (the usual rank of an OR query over unweighted text vectors). The best k are found in
two steps: blocks with the highest sums of bounds are ranked first, and then only those whose bound reaches the k-th
best rank so far. What is skipped can't be among the best, so the answer is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.stems import STOP_WORDS, english
from ..functions.text import ACCENTED
from ..functions.text import PLAIN as PLAIN_LETTERS

# Fixed values of the rank: the weight of plain text, pi^2 / 6, the most positions of a term that count, and of terms in a query.
PLAIN, LIMIT, MOST_POSITIONS, MOST_TERMS = 0.1, 1.64493406685, 255, 24
WORD, BETWEEN = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
#: Chunks of a block, at most; folders of the postings; blocks that are ranked first.
BLOCK, BUCKETS, FIRST_BLOCKS = 512, 64, 16
#: Words of a segment, about (a chunk stays whole); rows of an Arrow batch of texts, at most, and of postings.
SEGMENT, TEXTS, BATCH = 1 << 20, 1000, 10_000


def _folded(low: Column) -> Column:
    return F.replace(F.translate(low, ACCENTED, PLAIN_LETTERS), F.lit("ß"), F.lit("ss"))


def words_of(text: Column) -> Column:
    """A text's words in order; null and empty texts have none."""
    return F.coalesce(F.regexp_extract_all(_folded(F.lower(text)), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def spaced_words(text: Column) -> Column:
    """A text's words in order as one string, a space between them, accents left: folding turns letters into letters, so it can wait for the distinct words."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), BETWEEN, " ")), F.lit(""))


def weight(n: Column) -> Column:
    """What n occurrences of a term are worth."""
    counted = F.sequence(F.lit(1), F.least(n, F.lit(MOST_POSITIONS)).cast("int"))
    return F.aggregate(counted, F.lit(0.0), lambda s, j: s + F.lit(PLAIN) / (j * j).cast("double")) / LIMIT


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass
class Index:
    words: DataFrame
    postings: DataFrame
    heads: DataFrame


def _segments(most: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (chunk_id, texts) to a row a segment: its chunks, their numbers of texts, the texts' numbers of words, the distinct words, and each place's word by number."""

    def segment(held: list) -> pa.RecordBatch:
        ids, texts, lengths, words = ([h[i] for h in held] for i in range(4))
        said = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
        said = said.combine_chunks() if isinstance(said, pa.ChunkedArray) else said
        row = [pa.concat_arrays(ids), np.concatenate(texts), np.concatenate(lengths), said.dictionary, said.indices]
        kinds = [kind, pa.int32(), pa.int32(), pa.string(), pa.int32()]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, k) if isinstance(v, np.ndarray) else v) for v, k in zip(row, kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "texts", "lengths", "words", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, lists = batch.columns
            texts, spaced = np.asarray(pc.list_value_length(lists)), lists.flatten()
            split = pc.split_pattern(spaced, " ")
            # The parts of an empty text are one empty string.
            lengths, words = np.where(np.asarray(pc.equal(spaced, "")), 0, np.asarray(pc.list_value_length(split))).astype(np.int32), split.flatten()
            words = words.filter(pc.not_equal(words, ""))
            last = np.concatenate([[0], np.cumsum(texts)])
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[last]
            start = 0
            while start < len(ids):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most - size, side="right")) - 1)
                held.append((ids.slice(start, stop - start), texts[start:stop], lengths[last[start] : last[stop]], words.slice(ends[start], ends[stop] - ends[start])))
                size += int(ends[stop] - ends[start])
                if size >= most or stop < len(ids):
                    yield segment(held)
                    held, size = [], 0
                    pa.default_memory_pool().release_unused()
                start = stop
        if held:
            yield segment(held)

    return run


def _inverted(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From segments, their words folded and stemmed, to a row for each term and block."""
    stop_words = pa.array(STOP_WORDS)

    def lists(starts: np.ndarray, values: pa.Array | np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, pa.int32()) if isinstance(values, np.ndarray) else values)

    def firsts(*keys: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))

    def inverted(ids: pa.Array, texts: np.ndarray, lengths: np.ndarray, words: pa.Array, terms: pa.Array, places: np.ndarray, first_block: int) -> pa.RecordBatch:
        kept = ~np.asarray(pc.is_in(words, stop_words))
        at = np.flatnonzero(kept[places]).astype(np.int32)
        number = np.cumsum(kept) - 1
        words, terms = words.filter(pa.array(kept)), terms.filter(pa.array(kept))
        # Words of one stem are one term; terms are numbered in order.
        coded = terms.dictionary_encode()
        order = np.asarray(pc.sort_indices(coded.dictionary))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        of_word = rank[np.asarray(coded.indices)]
        term = of_word[number[places[at]]]
        chunk = np.repeat(np.repeat(np.arange(len(ids), dtype=np.int32), texts), lengths)[at]
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        position = at + 1 - np.repeat(starts.astype(np.int32), lengths)[at]
        if len(texts) and texts.max() > 1:
            by = np.lexsort((position, chunk, term))
        else:
            by = term.astype(np.int64)
            by <<= 32
            by |= np.arange(len(at))
            by.sort()
            by &= 0xFFFFFFFF
        term, chunk, position = term[by], chunk[by], position[by]
        each = firsts(term, chunk)
        times, term, chunk = np.diff(np.append(each, len(position))), term[each], chunk[each]
        rows = firsts(term, chunk // block)
        n, ends = np.diff(np.append(rows, len(each))), np.cumsum(times)
        n_words = np.zeros(len(rows), np.int64)
        n_words[firsts(term[rows])] = np.bincount(of_word)
        columns = [
            coded.dictionary.take(pa.array(order[term[rows]])), pa.array(first_block + chunk[rows].astype(np.int64) // block), pa.array(np.maximum.reduceat(times, rows), pa.int32()), pa.array(n, pa.int32()),
            lists(rows, ids.take(pa.array(chunk))), lists(rows, ends - np.repeat(ends[rows] - times[rows], n)), lists(each[rows], position),
            lists(np.cumsum(n_words) - n_words, words.take(pa.array(np.argsort(of_word, kind="stable")))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["term", "block", "most", "n", "chunk_ids", "ends", "positions", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks of different tasks differ.
        block_number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts, lengths, words, terms, places = (c[i].values for c in batch.columns)
                if not pc.all(pc.is_in(words, stop_words), min_count=0).as_py():
                    made = inverted(ids, np.asarray(texts), np.asarray(lengths), words, terms, np.asarray(places), block_number)
                    for start in range(0, made.num_rows, BATCH):
                        yield made.slice(start, BATCH)
                block_number += -(-len(ids) // block)
                pa.default_memory_pool().release_unused()

    return run


def _whole(chunks: DataFrame) -> DataFrame:
    """(chunk_id, texts): a row a chunk. Chunks without a copy of their key, mostly all of them, stay where they are."""
    alone = chunks.select("chunk_id", F.array("text").alias("texts"))
    copies = chunks.groupBy("chunk_id").count().where("count > 1").select(F.col("chunk_id").alias("copied"))
    if copies.isEmpty():
        return alone
    same = F.col("chunk_id").eqNullSafe(F.col("copied"))
    together = chunks.join(copies, same, "left_semi").groupBy("chunk_id").agg(F.collect_list("text").alias("texts"))
    return alone.join(copies, same, "left_anti").unionByName(together)


def write_index(chunks: DataFrame, path: str, key: str = "chunk_id", text: str = "text") -> Index:
    """Write the index of all chunks; ``key`` names a chunk."""
    spark, kind = chunks.sparkSession, chunks.schema[key].dataType
    given = _whole(chunks.select(F.col(key).alias("chunk_id"), F.col(text).alias("text")))
    given = given.select("chunk_id", F.transform("texts", spaced_words).alias("texts"))
    name = kind.simpleString()
    segments = given.mapInArrow(_segments(SEGMENT, to_arrow_type(kind)), f"ids array<{name}>, texts array<int>, lengths array<int>, words array<string>, places array<int>")
    folded = segments.withColumn("words", F.transform("words", _folded))
    stemmed = folded.select("ids", "texts", "lengths", "words", F.transform("words", english).alias("terms"), "places")
    made = stemmed.mapInArrow(_inverted(BLOCK), _schema(name).removesuffix(", bucket int"))
    rows = made.withColumn("bucket", bucket_of(F.col("term"))).sortWithinPartitions("bucket", "term", "block")
    batches = spark.conf.get(MOST_ROWS)
    if not 0 < int(batches) <= TEXTS:
        spark.conf.set(MOST_ROWS, str(TEXTS))
    try:
        rows.write.partitionBy("bucket").parquet(path, compression="zstd")
    finally:
        spark.conf.set(MOST_ROWS, batches)
    return open_index(spark, path, name)


def _schema(kind: str) -> str:
    """Given, as an empty table has no files to tell it; ``kind`` is the type of the chunks' keys."""
    return f"term string, block bigint, most int, n int, chunk_ids array<{kind}>, ends array<int>, positions array<int>, words array<string>, bucket int"


def open_index(spark: SparkSession, path: str, kind: str = "bigint") -> Index:
    """A written index, whose chunks' keys are of type ``kind``."""
    packed = spark.read.schema(_schema(kind)).parquet(path)
    words = packed.select(F.explode("words").alias("word"), "term").distinct()
    begin, end = F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(F.lit(0)), F.get("ends", F.col("i"))
    each = packed.select("term", "block", F.posexplode("chunk_ids").alias("i", "chunk_id"), "ends", "positions", "bucket")
    postings = each.select("term", "block", "chunk_id", F.slice("positions", begin + 1, end - begin).alias("positions"), weight(end - begin).alias("weight"), "bucket")
    heads = packed.select("term", "block", weight(F.col("most")).alias("bound"), F.col("n").cast("bigint").alias("n"), "bucket")
    return Index(words, postings, heads)


def query_terms(spark: SparkSession, text: str) -> list[str]:
    """The distinct terms of a query in order, MOST_TERMS at most; a word, split at hyphens, needs two letters."""
    one = spark.createDataFrame([(text,)], "text string").select(F.posexplode(words_of(F.col("text"))).alias("n", "word"))
    rows = one.where((F.length("word") > 1) & ~F.col("word").isin(STOP_WORDS)).orderBy("n").limit(MOST_TERMS).select(english(F.col("word")).alias("term"))
    return list(dict.fromkeys(r["term"] for r in rows.collect()))


def of_terms(table: DataFrame, terms: list[str], spark: SparkSession) -> DataFrame:
    """The rows of the terms: folders and row groups of others aren't read."""
    buckets = sorted({r["b"] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t")).alias("b")).collect()})
    return table.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def ranked(index: Index, text: str, k: int = 50, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """(chunk_id, score, matched) of the best k chunks with any term of the query."""
    spark = index.postings.sparkSession
    terms = query_terms(spark, text)
    if not terms:
        return index.postings.select("chunk_id", F.col("weight").alias("score"), F.lit(0).cast("bigint").alias("matched")).where("false")
    postings, heads = (of_terms(t, terms, spark) for t in (index.postings, index.heads))
    bounds = heads.groupBy("block").agg((F.sum("bound") / len(terms)).alias("bound"))

    def score(rows: DataFrame) -> DataFrame:
        return rows.groupBy("chunk_id").agg((F.sum("weight") / len(terms)).alias("score"), F.count("*").alias("matched"))

    best = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(first_blocks).collect()]
    tops = score(postings.where(F.col("block").isin(best))).orderBy(F.desc("score")).limit(k).collect()
    least = tops[-1]["score"] if len(tops) == k else 0.0
    # Sums in another order can differ in the last place.
    rest = bounds.where(F.col("bound") >= least * (1 - 1e-9)).select("block")
    return score(postings.join(rest, "block", "left_semi")).orderBy(F.desc("score"), "chunk_id").limit(k)


def phrase(index: Index, text: str) -> DataFrame:
    """(chunk_id, times): chunks in which the query's terms stand one after another, stop words between them counted."""
    spark = index.postings.sparkSession
    one = spark.createDataFrame([(text,)], "text string").select(F.posexplode(words_of(F.col("text"))).alias("n", "word"))
    rows = one.where(~F.col("word").isin(STOP_WORDS)).select("n", english(F.col("word")).alias("term")).orderBy("n").collect()
    if not rows:
        return index.postings.select("chunk_id", F.lit(0).cast("bigint").alias("times")).where("false")
    own = of_terms(index.postings, sorted({r["term"] for r in rows}), spark)
    places = spark.createDataFrame([(r["term"], r["n"] - rows[0]["n"]) for r in rows], "term string, at int")
    # Where the phrase would begin, by each of its terms; a place that all of them name is an occurrence.
    starts = own.join(F.broadcast(places), "term").select("chunk_id", F.explode("positions").alias("p"), "at").select("chunk_id", (F.col("p") - F.col("at")).alias("start"), "at")
    found = starts.groupBy("chunk_id", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(rows))
    return found.groupBy("chunk_id").agg(F.count("*").alias("times"))


def matching(index: Index, text: str) -> DataFrame:
    """(chunk_id, matched) of every chunk with any term of the query."""
    spark = index.postings.sparkSession
    terms = query_terms(spark, text)
    return of_terms(index.postings, terms, spark).groupBy("chunk_id").agg(F.count("*").alias("matched"))
