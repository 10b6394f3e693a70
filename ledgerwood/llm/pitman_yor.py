"""Language-model scores by a hierarchical Pitman-Yor model (operator 7).

Every context has a restaurant: tokens are its customers, and each table is a customer of
the root restaurant, the parent that all contexts share; the root's own parent is uniform
over the V known tokens and one unknown. The context of a token is the whole word before it,
or the start of a document.

Seats are sampled by Gibbs: in each sweep every pair of context and token that occurs more than
once is seated anew, and then every token in the root, given the other seats of the sweep before.
A pair that occurs once has one table in any seating, so it is only counted. Predictive
probabilities are averaged over the sweeps after burn-in.

At scale: documents are taken in blocks of bounded bytes and split once, words get numbers, and texts
are written as numbers. Words lie in buckets by hash and are numbered through all buckets by falling
count; pairs lie in buckets by context, but those of the contexts numbered under ``FREQUENT`` are dealt
to all, and only totals of these contexts, a fixed number, go to every task. A block or a bucket asks
for what it needs as arrays of distinct numbers, a row for each bucket, and the answers come back in
the order of the question, so no keys travel twice.

Defined results: a null text is empty, an empty one is one end token; without training
documents every token has probability 1 of the unknown slot; repeated rows are scored each;
extra columns are ignored. Two tokens share a hash with a probability under V^2 / 2^65; V is
under 2^31.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, bucket_of, drop_path, hash_words, list_array, mix, release_shuffles, slices, table, utf8
from .common import staged as staged_as

#: Numbers of the context at the start of a document, and of words without training.
START, UNKNOWN = -1, -2
#: Sweeps before the first sample, and samples.
BURN_IN, SAMPLES = 1, 2
STRENGTH = 1.0
#: UTF-8 bytes of text in a block, about; a bucket has the pairs of about as many.
BLOCK_BYTES = 8 << 20
#: Partitions that texts are dealt to, and buckets of words, at most.
PARTITIONS, WORD_BUCKETS = 20_000, 1024
#: Contexts whose totals every task holds, and whose pairs are dealt to all buckets: a fixed number.
FREQUENT = 16_384
#: UTF-8 bytes of text that a task splits at once.
AT_ONCE = 2 << 20
#: Rows of an Arrow batch: most of what passes through are rows of numbers.
BATCH = 8000
END = np.uint64(0x656E64206F662074)
_P = np.uint64(0x9E3779B97F4A7C15)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A written table, packed more closely than by default: it is mostly lists of numbers."""
    return staged_as(df, name, codec="zstd")


def tokens_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts end to end, and each text's number of tokens; the context of a token is the whole word before it."""
    words = [r.split() for r in raws]
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    stops = np.cumsum(lengths)
    n = int(stops[-1]) if len(stops) else 0
    at_end = np.zeros(n, bool)
    at_end[stops - 1] = True
    h = np.full(n, END, np.uint64)
    h[~at_end] = hash_words([w for own in words for w in own])
    return h, lengths


def contexts_of(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The context of each token of texts end to end: the number of the word before it."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lengths) - lengths] = START
    return before


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Pairs of numbers as one; their order is that of context and word."""
    return (context.astype(np.int64) + 2) << 32 | (word.astype(np.int64) + 2)


def pair_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ((keys >> 32) - 2).astype(np.int32), ((keys & 0xFFFFFFFF) - 2).astype(np.int32)


def draw_keys(numbers: np.ndarray) -> np.ndarray:
    return mix(numbers.astype(np.int64).view(np.uint64) + _P)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of lists, and the length of each."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    return np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """A number in (0, 1) for each key, the same in every run, batch and partitioning."""
    with np.errstate(over="ignore"):
        return ((mix(keys + np.uint64(draw) * _P) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def binomial(n: np.ndarray, p: np.ndarray, keys: np.ndarray, draw: int) -> np.ndarray:
    """A binomial draw for each key: by its distribution function, or by the normal law where the variance is over 25."""
    n, p = n.astype(np.float64), np.clip(p, 0.0, 1.0)
    u, flip = uniform(keys, 2 * draw), p > 0.5
    q = np.where(flip, 1 - p, p)
    wide = n * q * (1 - q) > 25
    out = np.zeros(len(n))
    if wide.any():
        angle = np.cos(2 * np.pi * uniform(keys[wide], 2 * draw + 1)) * np.sqrt(-2 * np.log(u[wide]))
        out[wide] = np.clip(np.rint(n[wide] * q[wide] + angle * np.sqrt(n[wide] * q[wide] * (1 - q[wide]))), 0, n[wide])
    at = np.flatnonzero(~wide & (q > 0))
    mass, k = np.exp(n[at] * np.log1p(-q[at])), 0
    below = mass.copy()
    while len(at := at[(more := (u[at] > below) & (k < n[at]))]):
        mass, below = mass[more], below[more]
        mass = mass * (n[at] - k) / (k + 1) * q[at] / (1 - q[at])
        k += 1
        below = below + mass
        out[at] = k
    return np.where(flip, n - out, out).astype(np.int64)


def seat(customers: np.ndarray, tables: np.ndarray, strength: float, discount: float, parent: np.ndarray, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables that customers of one dish take in each restaurant; tables: the restaurant's other ones.

    Customers come one by one at first and then in blocks of an eighth of those seated, whose new
    tables are one binomial draw. Draws follow from the key of dish and restaurant and the sweep alone.
    """
    t = np.minimum(customers, 1).astype(np.int64)
    seated, draw = 1, sweep << 20
    active = np.flatnonzero(customers > 1)
    while len(active):
        more = np.minimum(max(1, seated // 8), customers[active] - seated)
        new = (strength + discount * (tables[active] + t[active])) * parent[active]
        p = new / (new + seated - discount * t[active])
        t[active] += binomial(more, p, keys[active], draw)
        seated, draw = seated + max(1, seated // 8), draw + 1
        active = active[customers[active] > seated]
    return t


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in a sorted array, and which of them do."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def block_of(id_: Column, text: Column, n_blocks: int) -> Column:
    """Where a row is dealt, by its number too: copies of one row go everywhere. No score depends on blocks."""
    return F.pmod(F.xxhash64(id_, text, F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")


#: A row of numbers on its way to a bucket, from another bucket or a block; sums are what the driver adds up.
ROW = "kind int, bucket int, other bigint, a array<int>, b array<int>, c array<int>, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
NAMES = [f.split()[0] for f in ROW.split(", ")]
#: Kinds: all pairs; repeated ones; rare contexts among these; tables of repeated ones; tables for words; pairs for words;
#: totals and tables of frequent contexts; words with root tables; answers of words to a bucket; questions.
PAIRS, REPEATED, RARE, TABLES, TO_WORDS, OF_WORDS, FREQUENT_TOTALS, FREQUENT_TABLES, STATE, PARENTS, ASKED, ASKED_WORDS = range(12)


def rows_of(made: list[tuple]) -> pa.Table:
    """Rows (kind, bucket, other, a, b, c, sums...), the last ones of which may be left out."""
    columns = []
    for k, name in enumerate(NAMES):
        values = [r[k] if len(r) > k else None for r in made]
        if name in "abc":
            values = [np.empty(0, np.int32) if v is None else np.asarray(v).astype(np.int32) for v in values]
            columns.append(list_array(np.concatenate([np.empty(0, np.int32), *values]), [len(v) for v in values]))
        else:
            columns.append(pa.array([None if v is None else int(v) for v in values], pa.int32() if k < 2 else pa.int64()))
    return pa.table(columns, names=NAMES)


def by_kind(rows: pa.Table) -> dict[int, list[tuple]]:
    """(other, a, b, c) of the rows of each kind, in order of the others."""
    found: dict[int, list[tuple]] = {}
    kinds, others = np.asarray(rows["kind"]), np.asarray(rows["other"])
    parts = []
    for name in "abc":
        values, lengths = _flat(rows[name])
        parts.append((values, np.cumsum([0, *lengths])))
    for i in np.lexsort((others, kinds)):
        found.setdefault(int(kinds[i]), []).append((int(others[i]), *[v[o[i] : o[i + 1]] for v, o in parts]))
    return found


def joined(rows: list[tuple], k: int) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int32), *[r[k] for r in rows]])


def dealt(kind: int, other: int, buckets: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Columns in order of their buckets as one row a bucket."""
    numbers, firsts = np.unique(buckets, return_index=True)
    stops = [*firsts[1:], len(buckets)]
    return [(kind, n, other, *[c[i:j] for c in columns]) for n, i, j in zip(numbers, firsts, stops)]


def encoded(docs: DataFrame, block_bytes: int, word_buckets: int | None = None) -> tuple[DataFrame, int, int]:
    """(doc_id, block, train, ids) of rows (doc_id, text, train), ids by the block's own list of words, and one row for each block and bucket of words with that list and counts in training."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = int(total // block_bytes) + 1
    word_buckets = word_buckets or min(n_blocks, WORD_BUCKETS)
    if docs.rdd.getNumPartitions() < min(n_blocks, spark.sparkContext.defaultParallelism):
        docs = docs.repartition(min(n_blocks, PARTITIONS), block_of(F.col("doc_id"), F.col("text"), n_blocks))

    def block(number: int, held: list[tuple]) -> pa.RecordBatch:
        lists = [h[2] for h in held]
        hashes, at = np.unique(np.concatenate(lists), return_inverse=True)
        bucket = (hashes % np.uint64(word_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        moved = np.empty(len(hashes), np.int32)
        moved[order] = np.arange(len(hashes), dtype=np.int32)
        at, offsets = moved[at], np.cumsum([0, *map(len, lists)])
        ids = np.concatenate([at[o : o + len(h[2])][h[3]] for o, h in zip(offsets, held)])
        lengths, train = np.concatenate([h[4] for h in held]), np.concatenate([h[1] for h in held])
        counts = np.bincount(ids[np.repeat(train, lengths)], minlength=len(hashes)).astype(np.int32)
        numbers, sizes = np.unique(bucket, return_counts=True)
        n, m = len(lengths), len(numbers)
        doc_ids = pa.concat_arrays([*[h[0] for h in held], pa.nulls(m, held[0][0].type)])
        none = np.zeros(n, np.int64)
        columns = [
            doc_ids, pa.array(np.full(n + m, number)), pa.array([*train.tolist(), *[None] * m], pa.bool_()), list_array(ids, np.append(lengths, np.zeros(m, np.int64))),
            pa.array([*[None] * n, *numbers.tolist()], pa.int32()), list_array(hashes[order].view(np.int64), np.append(none, sizes)), list_array(counts, np.append(none, sizes)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "block", "train", "ids", "bucket", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            texts, train = batch.column("text"), np.asarray(batch.column("train").to_numpy(zero_copy_only=False)).astype(bool)
            for start, stop in slices(texts, min(AT_ONCE, block_bytes)):
                raws = [utf8(t).lower() for t in texts.slice(start, stop - start).to_pylist()]
                h, lengths = tokens_of(raws)
                distinct, at = np.unique(h, return_inverse=True)
                # A copy of the ids: a slice would keep the batch with its texts.
                held.append((batch.column("doc_id").take(pa.array(range(start, stop), pa.int64())), train[start:stop], distinct, at.astype(np.int32), lengths))
                size += sum(map(len, raws))
                if size >= block_bytes:
                    yield block(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield block(number, held)

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text", "train").mapInArrow(run, f"doc_id {kind}, block bigint, train boolean, ids array<int>, bucket int, hashes array<bigint>, counts array<int>")
    return made, n_blocks, word_buckets


LISTED = "bucket int, block bigint, hashes array<bigint>, ids array<int>, counts array<int>, n bigint"


def numbered(blocks: DataFrame, word_buckets: int, known: DataFrame | None = None) -> DataFrame:
    """The words of each bucket (block -1) with their counts, numbered by falling count, and each block's numbers and counts in the order of its list; n is the count of all."""
    fresh = known is None

    def run(rows: pa.Table) -> pa.Table:
        block, bucket = np.asarray(rows["block"]), rows["bucket"][0].as_py()
        (hashes, sizes), counts = _flat(rows["hashes"]), _flat(rows["counts"])[0]
        of_known = np.repeat(block < 0, sizes)
        if fresh:
            words, at = np.unique(hashes, return_inverse=True)
            n = np.bincount(at, weights=counts, minlength=len(words)).astype(np.int64)
            words, n = words[n > 0], n[n > 0]
            order = np.lexsort((words, -n))
            words, n = words[order], n[order]
        else:
            words, n = hashes[of_known], counts[of_known].astype(np.int64)
        order = np.argsort(words)
        asks = np.flatnonzero(block >= 0)
        where, hit = _place(words[order], hashes[~of_known])
        ids, found = np.full(len(where), UNKNOWN, np.int32), np.zeros(len(where), np.int32)
        rank = order[where[hit]]
        ids[hit], found[hit] = rank * word_buckets + bucket, n[rank]
        lengths = sizes[asks]
        zero = np.zeros(len(asks), np.int64)
        columns = [
            np.full(len(asks) + 1, bucket, np.int32), np.append(-1, block[asks]), list_array(words, np.append(len(words), zero)), list_array(ids, np.append(0, lengths)),
            list_array(np.concatenate([n.astype(np.int32), found]), np.append(len(words), lengths)), np.append(n.sum(), zero),
        ]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.split()[0] for f in LISTED.split(", ")])

    asked = blocks.where("bucket is not null").select("bucket", "block", "hashes", "counts")
    if not fresh:
        asked = asked.unionByName(known.where("block < 0").select("bucket", "block", "hashes", "counts"))
    return asked.groupBy("bucket").applyInArrow(run, LISTED)


def in_numbers(blocks: DataFrame, listed: DataFrame, tokens: int, vocabulary: int) -> DataFrame:
    """The documents of ``encoded`` in the numbers of all words, with known tokens and base scores."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        at, lengths = _flat(rows["ids"])
        answers = answers.sort_by("bucket")
        ids, n = _flat(answers["ids"])[0], _flat(answers["counts"])[0].astype(np.float64)
        firsts = np.cumsum(lengths) - lengths
        base = np.log10((n + 1.0) / (tokens + vocabulary + 1.0))
        sums = [pa.array(np.add.reduceat(x, firsts)) for x in ((n > 0).astype(np.int64)[at], base[at])]
        return pa.table([rows["doc_id"], rows["block"], rows["train"], list_array(ids[at], lengths), *sums], names=["doc_id", "block", "train", "ids", "n_known", "base_score"])

    kind = blocks.schema["doc_id"].dataType.simpleString()
    docs = blocks.where("bucket is null").select("doc_id", "block", "train", "ids")
    answers = listed.where("block >= 0").select(F.col("block").alias("asker"), "bucket", "ids", "counts")
    return docs.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(run, f"doc_id {kind}, block bigint, train boolean, ids array<int>, n_known bigint, base_score double")


def pair_buckets(keys: np.ndarray, n_buckets: int, frequent: int) -> np.ndarray:
    """A rare context has all its pairs in one bucket, a frequent one in all of them."""
    context = (keys >> 32) - 2
    return (draw_keys(np.where(context < frequent, keys, context)) % np.uint64(n_buckets)).astype(np.int32)


class BlockPairs:
    """A block's distinct pairs of a known context in order of bucket and pair, and distinct known words in order of bucket and number."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, n_buckets: int, frequent: int):
        self.before = contexts_of(ids, lengths)
        self.at = np.flatnonzero(self.before != UNKNOWN)
        keys, of = np.unique(pair_keys(self.before[self.at], ids[self.at]), return_inverse=True)
        buckets = pair_buckets(keys, n_buckets, frequent)
        order = np.argsort(buckets, kind="stable")
        moved = np.empty(len(keys), np.int32)
        moved[order] = np.arange(len(keys), dtype=np.int32)
        self.keys, self.buckets, self.of = keys[order], buckets[order], moved[of]

    def counts(self) -> np.ndarray:
        return np.bincount(self.of, minlength=len(self.keys))


def words_by_bucket(ids: np.ndarray, word_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct known numbers in order of their buckets, and the buckets."""
    words = np.unique(ids)
    words = words[words >= 0]
    buckets = words % word_buckets
    order = np.argsort(buckets, kind="stable")
    return words[order], buckets[order]


def rare_heads(context: np.ndarray, frequent: int) -> np.ndarray:
    """Whether a pair is the first one of a rare context, in an order where those of one context stand together."""
    return np.concatenate([[True], context[1:] != context[:-1]])[: len(context)] & (context >= frequent)


def for_words(kind: int, bucket: int, words: np.ndarray, word_buckets: int, *weights: np.ndarray) -> list[tuple]:
    """Sums by distinct word, dealt to the words' buckets."""
    distinct, own = words_by_bucket(words, word_buckets)
    sorted_ = np.sort(distinct)
    at = np.searchsorted(sorted_, words)
    back = np.searchsorted(sorted_, distinct)
    return dealt(kind, bucket, own, distinct, *[np.bincount(at, weights=w, minlength=len(distinct))[back] for w in weights])


def frequent_rows(kind: int, bucket: int, context: np.ndarray, frequent: int, *weights: np.ndarray) -> tuple:
    at = context < frequent
    distinct, of = np.unique(context[at], return_inverse=True)
    return (kind, bucket, -1, distinct, *[np.bincount(of, weights=w[at], minlength=len(distinct)) for w in weights])


def count_pairs(texts: DataFrame, n_buckets: int, word_buckets: int, frequent: int) -> DataFrame:
    """Each bucket's pairs in training with their counts, and what follows from these counts alone."""

    def ask(rows: pa.Table) -> pa.Table:
        pairs = BlockPairs(*_flat(rows["ids"]), n_buckets, frequent)
        return rows_of(dealt(PAIRS, rows["block"][0].as_py(), pairs.buckets, *pair_of(pairs.keys), pairs.counts()))

    def count(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        keys, of = np.unique(pair_keys(_flat(rows["a"])[0], _flat(rows["b"])[0]), return_inverse=True)
        n = np.bincount(of, weights=_flat(rows["c"])[0], minlength=len(keys)).astype(np.int64)
        context, word = pair_of(keys)
        more = n > 1
        heads = rare_heads(context, frequent)
        rare = context[heads]
        of_rare = np.searchsorted(rare, context[context >= frequent])
        ones, customers = (np.bincount(of_rare, weights=x[context >= frequent], minlength=len(rare)) for x in (n == 1, n))
        tables = np.ones(int(more.sum()))
        made = [
            (PAIRS, bucket, -1, context, word, n, (n == 1).sum(), (n == 2).sum()), (REPEATED, bucket, -1, context[more], word[more], n[more]), (RARE, bucket, -1, rare, ones, customers),
            (TABLES, bucket, -1, tables), *for_words(TO_WORDS, bucket, word[more], word_buckets, tables), *for_words(OF_WORDS, bucket, word, word_buckets, n == 1, np.ones(len(word))),
            frequent_rows(FREQUENT_TOTALS, bucket, context, frequent, n == 1, n), frequent_rows(FREQUENT_TABLES, bucket, context[more], frequent, tables),
        ]
        return rows_of(made)

    asked = texts.where("train").select("block", "ids").groupBy("block").applyInArrow(ask, ROW)
    return asked.groupBy("bucket").applyInArrow(count, ROW)


def of_kind(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds)).select(*NAMES)


def frequent_sums(rows: DataFrame, kind: int, frequent: int) -> np.ndarray:
    """Sums of two columns by number + 1 for the frequent contexts: a table of fixed size."""
    flat = of_kind(rows, kind).select(F.explode(F.arrays_zip("a", "b", "c") if kind == FREQUENT_TOTALS else F.arrays_zip("a", "b", F.col("b").alias("c"))).alias("p"))
    sums = flat.groupBy("p.a").agg(F.sum("p.b").alias("b"), F.sum("p.c").alias("c")).toArrow()
    out = np.zeros((int(np.max(sums["a"].to_numpy(), initial=-1)) + 2, 2))
    out[sums["a"].to_numpy() + 1] = np.stack([sums["b"].to_numpy(), sums["c"].to_numpy()], 1)
    return out


class Totals:
    """What a sweep knows of all seats: tables in all restaurants and in the root, and tables of frequent contexts."""

    def __init__(self, tables: int, root_tables: int, vocabulary: int, discount: float, root_discount: float, frequent_tables: np.ndarray):
        self.tables, self.root_tables, self.vocabulary = tables, root_tables, vocabulary
        self.discount, self.root_discount, self.frequent_tables = discount, root_discount, frequent_tables
        self.flat: DataFrame | None = None
        self.number, self.told = 0, {}

    def bare(self) -> Totals:
        """The numbers alone, for tasks."""
        return Totals(self.tables, self.root_tables, self.vocabulary, self.discount, self.root_discount, self.frequent_tables)

    def root(self, customers, tables):
        """The root's predictive probability of dishes."""
        d = self.root_discount
        return (customers - d * tables + (STRENGTH + d * self.root_tables) / (self.vocabulary + 1)) / (STRENGTH + self.tables)

    def share(self, customers, tables):
        """The share that a context leaves to the root."""
        return (STRENGTH + self.discount * tables) / (STRENGTH + customers)

    def back_off(self) -> Shares:
        return Shares(self)


class Shares:
    """The share that each context leaves to the root, asked of the pairs one by one."""

    def __init__(self, totals: Totals):
        self.totals = totals

    def __getitem__(self, context: int) -> float:
        told = self.totals.told
        if context not in told:
            found = self.totals.flat.where(F.col("context") == context).agg(F.sum("n"), F.sum(f"t{self.totals.number}")).first()
            told[context] = self.totals.share(found[0] or 0, found[1] or 0)
        return told[context]


def seat_pairs(pairs: DataFrame, seats: DataFrame, words: DataFrame, totals: Totals, frequent_ones: np.ndarray, number: int, word_buckets: int, frequent: int) -> DataFrame:
    """Seat the customers of every repeated pair anew, given all other seats of the sweep before."""
    common = pairs.sparkSession.sparkContext.broadcast(frequent_ones + totals.frequent_tables)
    discount, root = totals.discount, (totals.root_tables, totals.tables, totals.vocabulary, totals.root_discount)

    def run(rows: pa.Table) -> pa.Table:
        bucket, found = rows["bucket"][0].as_py(), by_kind(rows)
        _, context, word, customers = found[REPEATED][0]
        old = found[TABLES][0][1].astype(np.int64)
        _, rare, ones, _ = found[RARE][0]
        r, total, vocabulary, d = root
        answers = found.get(PARENTS, [])
        at_root, root_tables = joined(answers, 1), joined(answers, 2)
        parents = (at_root - d * root_tables + (STRENGTH + d * r) / (vocabulary + 1)) / (STRENGTH + total)
        asked, _ = words_by_bucket(word, word_buckets)
        by_number = np.argsort(asked)
        parent = parents[by_number][np.searchsorted(asked[by_number], word)]
        is_rare = context >= frequent
        at = np.searchsorted(rare, context[is_rare])
        seated = np.zeros(len(context))
        seated[is_rare] = (ones + np.bincount(at, weights=old[is_rare], minlength=len(rare)))[at]
        seated[~is_rare] = common.value[context[~is_rare] + 1, 0]
        t = seat(customers.astype(np.int64), seated - old, STRENGTH, discount, parent, draw_keys(pair_keys(context, word)), 2 * number)
        return rows_of([(TABLES, bucket, -1, t), *for_words(TO_WORDS, bucket, word, word_buckets, t), frequent_rows(FREQUENT_TABLES, bucket, context, frequent, t)])

    met = of_kind(pairs, REPEATED, RARE).unionByName(of_kind(seats, TABLES)).unionByName(of_kind(words, PARENTS))
    return met.groupBy("bucket").applyInArrow(run, ROW)


def seat_words(before: DataFrame, seats: DataFrame, totals: Totals | None, number: int, word_buckets: int) -> DataFrame:
    """Seat every token in the root anew and answer the buckets of pairs; first, without totals, one table a token."""
    root = totals and (totals.root_tables, totals.vocabulary, totals.root_discount)

    def run(rows: pa.Table) -> pa.Table:
        bucket, found = rows["bucket"][0].as_py(), by_kind(rows)
        if root is None:
            told = found[OF_WORDS]
            at, sums = joined(told, 1) // word_buckets, []
            for k in (2, 3):
                sums.append(np.bincount(at, weights=joined(told, k)).astype(np.int64))
            ones, of = sums
            spread = ((of == 1).sum(), (of == 2).sum())
            tables = np.ones(len(ones), np.int64)
        else:
            _, ones, tables, _ = found[STATE][0]
            ones, tables, spread = ones.astype(np.int64), tables.astype(np.int64), (0, 0)
        told = found.get(TO_WORDS, [])
        at_root = ones + np.bincount(joined(told, 1) // word_buckets, weights=joined(told, 2), minlength=len(ones)).astype(np.int64)
        if root is not None:
            r, vocabulary, d = root
            keys = draw_keys(np.arange(len(ones)) * word_buckets + bucket)
            tables = seat(at_root, np.maximum(0, r - tables), STRENGTH, d, np.full(len(ones), 1 / (vocabulary + 1)), keys, 2 * number + 1)
        made = [(STATE, bucket, -1, ones, tables, at_root, at_root.sum(), tables.sum(), *spread)]
        for asker, asked, _, _ in told:
            at = asked // word_buckets
            made.append((PARENTS, asker, bucket, at_root[at], tables[at]))
        return rows_of(made)

    met = of_kind(before, OF_WORDS if totals is None else STATE).unionByName(of_kind(seats, TO_WORDS))
    return met.groupBy("bucket").applyInArrow(run, ROW)


class Model:
    """Pairs with their counts, listed words, seats and words of each sample, and totals."""

    def __init__(self, listed: DataFrame, pairs: DataFrame, samples: list[Totals], seats: list[DataFrame], states: list[DataFrame], frequent_totals: np.ndarray, tokens: int, vocabulary: int, n_buckets: int, word_buckets: int, frequent: int):
        self.listed, self.pairs, self.samples, self.seats, self.states, self.frequent_totals = listed, pairs, samples, seats, states, frequent_totals
        self.tokens, self.vocabulary, self.n_buckets, self.word_buckets, self.frequent = tokens, vocabulary, n_buckets, word_buckets, frequent
        for k, s in enumerate(samples):
            s.flat, s.number = self.flat, k

    def sampled(self, rows: DataFrame, tables: list[DataFrame], kind: int) -> DataFrame:
        """Rows with those of each sample, whose number is in ``other``."""
        for k, t in enumerate(tables):
            rows = rows.unionByName(of_kind(t, kind).withColumn("other", F.lit(k).cast("bigint")))
        return rows

    @property
    def flat(self) -> DataFrame:
        """(context, word, n, t0, t1...): every pair with its tables in each sample. For a look at models; scores don't use it."""
        count = len(self.samples)

        def run(rows: pa.Table) -> pa.Table:
            found = by_kind(rows)
            _, context, word, n = found[PAIRS][0]
            tables = [np.ones(len(n), np.int64) for _ in range(count)]
            for k, t, _, _ in found[TABLES]:
                tables[k][n > 1] = t
            return pa.table([context, word, n.astype(np.int64), *tables], names=["context", "word", "n", *[f"t{k}" for k in range(count)]])

        rows = self.sampled(of_kind(self.pairs, PAIRS), self.seats, TABLES)
        return rows.groupBy("bucket").applyInArrow(run, "context int, word int, n bigint, " + ", ".join(f"t{k} bigint" for k in range(count)))

    @property
    def words(self) -> DataFrame:
        """Every token with its contexts, its own customers' parts there and its root probabilities, summed or listed over samples. For a look at models."""
        flat, width = self.flat, self.word_buckets
        own = reduce(lambda x, y: x + y, [F.col("n") - s.discount * F.col(f"t{k}") for k, s in enumerate(self.samples)])
        customers = flat.groupBy("context").agg(F.sum("n").alias("customers"))
        parts = flat.withColumn("own", own).join(customers, "context").groupBy(F.col("word").alias("id")).agg(F.collect_list(F.struct("context", (F.col("own") / (STRENGTH + F.col("customers"))).alias("own"))).alias("p"))
        for k, (s, state) in enumerate(zip(self.samples, self.states)):
            rows = of_kind(state, STATE).select("bucket", F.posexplode(F.arrays_zip("b", "c")).alias("at", "p"))
            root = rows.select((F.col("at") * width + F.col("bucket")).alias("id"), s.root(F.col("p.c"), F.col("p.b")).alias(f"root{k}"))
            parts = parts.join(root, "id")
        return parts.select("id", F.col("p.context").alias("contexts"), F.col("p.own").alias("own"), F.array(*[f"root{k}" for k in range(len(self.samples))]).alias("roots"))


def fit_numbers(texts: DataFrame, listed: DataFrame, tokens: int, vocabulary: int, n_buckets: int, word_buckets: int) -> Model:
    """The model of the rows of ``in_numbers`` that are for training."""
    spark, frequent = texts.sparkSession, FREQUENT
    pairs, _ = staged(count_pairs(texts, n_buckets, word_buckets, frequent), "pairs")
    release_shuffles(spark)
    words, path = staged(seat_words(pairs, pairs, None, 0, word_buckets), "seats")
    # Discounts from the numbers of pairs seen once and twice, and of tokens in one and two contexts.
    estimate = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
    sums = lambda rows, kind: [x or 0 for x in of_kind(rows, kind).agg(*[F.sum(f"s{k}") for k in range(4)]).first()]
    discount, root_discount = estimate(*sums(pairs, PAIRS)[:2]), estimate(*sums(words, STATE)[2:])
    frequent_totals = frequent_sums(pairs, FREQUENT_TOTALS, frequent)

    def total(words: DataFrame, seats: DataFrame) -> Totals:
        tables = np.zeros_like(frequent_totals)
        found = frequent_sums(seats, FREQUENT_TABLES, frequent)
        tables[: len(found)] = found
        return Totals(*sums(words, STATE)[:2], vocabulary, discount, root_discount, tables)

    seats, old, totals = pairs, [path], total(words, pairs)
    samples, tables, states = [], [], []
    for number in range(BURN_IN + SAMPLES):
        seats, seat_path = staged(seat_pairs(pairs, seats, words, totals, frequent_totals, number, word_buckets, frequent), "seats")
        words, word_path = staged(seat_words(words, seats, totals, number, word_buckets), "seats")
        totals = total(words, seats)
        release_shuffles(spark)
        for path in old:
            drop_path(spark, path)
        old = [seat_path, word_path]
        if number >= BURN_IN:
            samples.append(totals)
            tables.append(seats)
            states.append(words)
            old = []
    release_shuffles(spark)
    return Model(listed, pairs, samples, tables, states, frequent_totals, tokens, vocabulary, n_buckets, word_buckets, frequent)


def fit(training: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Model:
    docs = training.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.lit(True).alias("train"))
    return fit_rows(docs, block_bytes)[0]


def fit_rows(docs: DataFrame, block_bytes: int) -> tuple[Model, DataFrame]:
    """The model of the rows (doc_id, text, train) that are for training, and all rows in its numbers."""
    spark = docs.sparkSession
    bound_batches(spark, BATCH)
    made, n_blocks, word_buckets = encoded(docs, block_bytes)
    blocks, path = staged(made, "blocks")
    listed, list_path = staged(numbered(blocks, word_buckets), "words")
    sums = listed.where("block < 0").agg(F.sum(F.size("hashes")).alias("v"), F.sum("n").alias("n")).first()
    tokens, vocabulary = sums["n"] or 0, sums["v"] or 0
    texts, _ = staged(in_numbers(blocks, listed, tokens, vocabulary), "texts")
    words, _ = staged(listed.where("block < 0"), "words")
    for done in (path, list_path):
        drop_path(spark, done)
    release_shuffles(spark)
    return fit_numbers(texts, words, tokens, vocabulary, n_blocks, word_buckets), texts


def questions(texts: DataFrame, model: Model) -> DataFrame:
    """Each block's distinct pairs and words, one row a bucket of either."""
    n_buckets, word_buckets, frequent = model.n_buckets, model.word_buckets, model.frequent

    def run(rows: pa.Table) -> pa.Table:
        block, (ids, lengths) = rows["block"][0].as_py(), _flat(rows["ids"])
        pairs = BlockPairs(ids, lengths, n_buckets, frequent)
        words, buckets = words_by_bucket(ids, word_buckets)
        return rows_of(dealt(ASKED, block, pairs.buckets, *pair_of(pairs.keys)) + dealt(ASKED_WORDS, block, buckets, words))

    return texts.select("block", "ids").groupBy("block").applyInArrow(run, ROW)


ANSWER = "asker bigint, of_words boolean, bucket int, x array<float>, y array<float>"


def answered(made: list[tuple], bucket: int, of_words: bool) -> pa.Table:
    columns = [pa.array([m[0] for m in made], pa.int64()), pa.array([of_words] * len(made), pa.bool_()), pa.array([bucket] * len(made), pa.int32())]
    for k in (1, 2):
        columns.append(list_array(np.concatenate([np.empty(0, np.float32), *[m[k].astype(np.float32).ravel() for m in made]]), [m[k].size for m in made]))
    return pa.table(columns, names=[f.split()[0] for f in ANSWER.split(", ")])


def answers(asked: DataFrame, model: Model) -> DataFrame:
    """To each question, in its order: own parts of pairs summed over samples and shares of their rare contexts (a row of samples each), or root probabilities of words."""
    samples, frequent, word_buckets = [s.bare() for s in model.samples], model.frequent, model.word_buckets
    common = asked.sparkSession.sparkContext.broadcast(model.frequent_totals[:, 1])
    discount, count = samples[0].discount, len(samples)

    def of_pairs(rows: pa.Table) -> pa.Table:
        bucket, found = rows["bucket"][0].as_py(), by_kind(rows)
        none = (np.empty(0, np.int32),) * 3
        _, context, word, n = found[PAIRS][0] if PAIRS in found else (0, *none)
        keys, n = pair_keys(context, word), n.astype(np.int64)
        heads = rare_heads(context, frequent)
        rare, is_rare = context[heads], context >= frequent
        at = np.searchsorted(rare, context[is_rare])
        customers = np.bincount(at, weights=n[is_rare], minlength=len(rare))
        own, shares = count * n.astype(np.float64), np.ones((len(rare), count))
        for k in range(count):
            tables = np.ones(len(n))
            if len(n):
                tables[n > 1] = found[TABLES][k][1]
            own -= discount * tables
            shares[:, k] = samples[k].share(customers, np.bincount(at, weights=tables[is_rare], minlength=len(rare)))
        own[is_rare] /= STRENGTH + customers[at]
        own[~is_rare] /= STRENGTH + common.value[context[~is_rare] + 1]
        made = []
        for block, a, b, _ in found.get(ASKED, []):
            where, hit = _place(keys, pair_keys(a, b))
            x = np.zeros(len(a))
            x[hit] = own[where[hit]]
            asked_heads = a[rare_heads(a, frequent)]
            where, hit = _place(rare, asked_heads)
            y = np.ones((len(asked_heads), count))
            y[hit] = shares[where[hit]]
            made.append((block, x, y))
        return answered(made, bucket, False)

    def of_words(rows: pa.Table) -> pa.Table:
        bucket, found = rows["bucket"][0].as_py(), by_kind(rows)
        made = []
        if ASKED_WORDS in found:
            roots = np.stack([s.root(c, b) for s, (_, _, b, c) in zip(samples, found[STATE], strict=True)], 1)
            made = [(block, roots[a // word_buckets], np.empty(0)) for block, a, _, _ in found[ASKED_WORDS]]
        return answered(made, bucket, True)

    pairs = model.sampled(of_kind(asked, ASKED).unionByName(of_kind(model.pairs, PAIRS)), model.seats, TABLES).groupBy("bucket").applyInArrow(of_pairs, ANSWER)
    words = model.sampled(of_kind(asked, ASKED_WORDS), model.states, STATE).groupBy("bucket").applyInArrow(of_words, ANSWER)
    return pairs.unionByName(words)


def score_numbers(texts: DataFrame, model: Model) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score and score of the rows of ``in_numbers``."""
    spark = texts.sparkSession
    n_buckets, word_buckets, frequent, count = model.n_buckets, model.word_buckets, model.frequent, len(model.samples)
    asked, path = staged(questions(texts, model), "asked")
    release_shuffles(spark)
    told, _ = staged(answers(asked, model), "answers")
    drop_path(spark, path)
    release_shuffles(spark)
    customers = model.frequent_totals[:, 1]
    shares = np.stack([s.share(customers, model.frequent_totals[:, 0] + s.frequent_tables[:, 0]) for s in model.samples], 1)
    common = spark.sparkContext.broadcast(shares)
    unseen = np.array([s.root(0, 0) for s in model.samples])

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        ids, lengths = _flat(rows["ids"])
        told = told.sort_by("bucket")
        of_words = np.asarray(told["of_words"]).astype(bool)
        to_pairs, to_words = told.filter(pa.array(~of_words)), told.filter(pa.array(of_words))
        # The last row of a table of values is for what isn't known.
        words, _ = words_by_bucket(ids, word_buckets)
        roots = np.concatenate([_flat(to_words["x"])[0].reshape(-1, count), unseen[None]])
        by_number = np.argsort(words)
        now = np.full(len(ids), len(words))
        known = ids >= 0
        now[known] = by_number[np.searchsorted(words[by_number], ids[known])]
        pairs = BlockPairs(ids, lengths, n_buckets, frequent)
        context = pair_of(pairs.keys)[0]
        rare = np.cumsum(rare_heads(context, frequent)) - 1
        held = common.value
        shares = np.concatenate([_flat(to_pairs["y"])[0].reshape(-1, count), held, np.ones((1, count))])
        n_rare = len(shares) - len(held) - 1
        of_pair = np.where(context >= frequent, rare, n_rare + np.minimum(context + 1, len(held)))
        before = np.full(len(ids), len(shares) - 1)
        before[pairs.at] = of_pair[pairs.of]
        p = np.zeros(len(ids))
        p[pairs.at] = _flat(to_pairs["x"])[0].astype(np.float64)[pairs.of]
        for k in range(count):
            p += shares[before, k] * roots[now, k]
        firsts = np.cumsum(lengths) - lengths
        made = [pa.array(lengths.astype(np.int64)), rows["n_known"], rows["base_score"], pa.array(np.add.reduceat(np.log10(np.minimum(1.0, p / count)), firsts))]
        return pa.table([rows["doc_id"], rows["train"], *made], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.groupBy("block").cogroup(told.groupBy("asker")).applyInArrow(run, f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row."""
    spark = docs.sparkSession
    bound_batches(spark, BATCH)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(False).alias("train"))
    blocks, path = staged(encoded(rows, block_bytes, model.word_buckets)[0], "blocks")
    listed, list_path = staged(numbered(blocks, model.word_buckets, model.listed), "words")
    texts, _ = staged(in_numbers(blocks, listed, model.tokens, model.vocabulary), "texts")
    for done in (path, list_path):
        drop_path(spark, done)
    return score_numbers(texts, model).drop("train")


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.coalesce(bucket_of("doc_id", 7), F.lit(0))  # a null id is of no held-out row
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder != 2).alias("train"))
    model, texts = fit_rows(docs, BLOCK_BYTES)
    rows = score_numbers(texts, model)
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
