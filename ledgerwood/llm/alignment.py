"""Cross-tokenizer alignment by a dictionary of groups.

Two tokenizers cut a text into the same bytes. Offsets where tokens of both end cut these into groups,
and most groups of a corpus are copies of a few: so distinct groups are interned with their frequency,
their links are expanded once for each distinct group, counts of linked ids are sums of frequencies,
and what a group is worth comes back to the documents by its key.

A link is an occurrence of two tokens whose byte ranges end together. Tokens hold one byte at least, so a
group has one link, of its last two tokens. A group of up to two tokens on either side is its own key, in
62 bits; a longer one is known by two hashes of 63 and 64 bits.

Texts are encoded once. Each document keeps its distinct groups with their number of times, in a written
table. The most frequent groups (FREQUENT at most) go to all tasks, so no key that is shuffled is hot;
the rest is joined by key and summed by document.

Defined results: null and empty texts, and those whose tokens' bytes aren't the text's (with the space
that goes first), have no tokens: zeros and an empty digest. Rows that repeat, or share an id, or have
none, are documents of their own, each counted. An empty table gives an empty result. Other columns are
not read. Long texts are encoded whole, cut at spaces between letters, where neither tokenizer joins.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, list_array, mix, staged, table, tokenizer_path, utf8, with_text_columns
from .graph import hot_join

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Groups that go to all tasks: 33 bytes each.
FREQUENT = 1 << 17
#: Characters of a long text that are encoded together, about.
CHUNK = 1 << 18
#: Distinct groups that a task sums before it hands them on.
HELD = 1 << 20
#: Bits of a first id and of a second one in the code of a group.
BITS_A, BITS_B = 16, 15

#: How words are told apart before merges, in byte-level vocabularies of this kind.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"

_CUT = re.compile("(?<=[a-z]) (?=[a-z])")
_LONG_RUN = re.compile(r"\s{4096}")


@dataclass
class Side:
    """One tokenizer: ids of texts, and the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    spelled: list[bytes]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(source: str) -> Side:
    """A byte-level BPE vocabulary; special tokens' strings are plain text. Ids are ranks of merges."""
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(source)
    library.encode_special_tokens = True
    data, letters = json.loads(source), byte_letters()
    special = {t["content"] for t in data["added_tokens"]}
    ranks = {bytes(map(letters.__getitem__, t)): i for t, i in data["model"]["vocab"].items() if t not in special}
    spelled = [b""] * (max(ranks.values(), default=-1) + 1)
    for raw, i in ranks.items():
        spelled[i] = raw
    fast = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def one(text: str) -> list[int]:
        # Its search for words goes back over a run of white space, and runs out of room on a very long one.
        if len(text) > 4096 and _LONG_RUN.search(text):
            return library.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return Side(lambda texts: list(map(one, texts)), spelled)


def pieces(model: bytes) -> Side:
    """A sentencepiece model; it puts a space first."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_proto=model)
    spelled = []
    for i in range(library.get_piece_size()):
        piece = library.id_to_piece(i)
        spelled.append(bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.replace(SPACE, " ").encode())
    return Side(lambda texts: library.encode(texts, num_threads=1), spelled)


_sides: dict[bytes, tuple[Side, Side]] = {}


def sides(first: str, second: bytes) -> tuple[Side, Side]:
    """Both tokenizers, made once in a worker."""
    name = hashlib.sha256(first.encode() + second).digest()
    if name not in _sides:
        _sides.clear()
        _sides[name] = byte_level(first), pieces(second)
    return _sides[name]


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """The text in parts of about ``size``; each after the first begins with the space that it was cut at."""
    out, start = [], 0
    while len(text) - start > size and (found := _CUT.search(text, start + size)):
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


@dataclass
class Groups:
    """Groups of several texts in order: their keys, the code of their link, and how many a text has."""

    counts: np.ndarray
    keys: np.ndarray
    checks: np.ndarray
    links: np.ndarray
    digests: list[bytes]


class Aligner:
    def __init__(self, first: Side, second: Side):
        self.first, self.second = first, second
        self.lengths = [np.array([len(s) for s in side.spelled], np.int64) for side in (first, second)]
        if len(first.spelled) >= 1 << BITS_A or len(second.spelled) >= 1 << BITS_B:
            raise ValueError(f"ids must fit {BITS_A} and {BITS_B} bits")
        # A token as it is written within its group, and as the last of its side.
        ends = [f"{i}{c}".encode() for i in range(len(first.spelled)) for c in ",|"]
        self.written = ends + [f"{i}{c}".encode() for i in range(len(second.spelled)) for c in ",;"]

    def tokens(self, parts: list[tuple[int, str]]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids on both sides of numbered parts of texts, and whether both spell the part with the space first."""
        whole = [part if k else " " + part for k, part in parts]
        a, b = self.first.encode(whole), self.second.encode([w[1:] for w in whole])
        spell_a, spell_b = self.first.spelled.__getitem__, self.second.spelled.__getitem__
        sound = [b"".join(map(spell_a, x)) == (raw := utf8(w)) and b"".join(map(spell_b, y)) == raw for w, x, y in zip(whole, a, b, strict=True)]
        return a, b, sound

    def groups(self, a: list[list[int]], b: list[list[int]]) -> Groups:
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(y) for y in b], np.int64)
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b = np.cumsum(self.lengths[0][ids_a]), np.cumsum(self.lengths[1][ids_b])
        size = int(ends_a[-1]) + 1 if len(ends_a) else 1
        at_a, at_b = np.zeros(size, bool), np.zeros(size, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        cut_a, cut_b = at_b[ends_a], at_a[ends_b]
        last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        a_of, b_of = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b  # the group of each token
        keys, checks = self._keys(ids_a, ids_b, last_a, last_b, size_a, size_b, a_of, b_of)
        links = (ids_a[last_a] << BITS_B) | ids_b[last_b]
        # In order of writing: a group's first side, then its second.
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        before_b = np.concatenate([[0], last_b + 1])[a_of]
        order[np.arange(len(ids_a)) + before_b] = 2 * ids_a + cut_a
        order[np.arange(len(ids_b)) + last_a[b_of] + 1 if len(ids_b) else np.empty(0, np.int64)] = 2 * (len(self.first.spelled) + ids_b) + cut_b
        stops = np.cumsum(n_a + n_b)
        digests = [b"".join(map(self.written.__getitem__, order[s - n : s].tolist())) for s, n in zip(stops.tolist(), (n_a + n_b).tolist(), strict=True)]
        counts = np.diff(np.searchsorted(last_a, np.cumsum(n_a) - 1, side="right"), prepend=0)
        return Groups(counts, keys, checks, links, digests)

    @staticmethod
    def _keys(ids_a, ids_b, last_a, last_b, size_a, size_b, a_of, b_of) -> tuple[np.ndarray, np.ndarray]:
        first_a, first_b = last_a - size_a + 1, last_b - size_b + 1
        keys = (ids_a[first_a] + 1) | ((ids_b[first_b] + 1) << (2 * BITS_A))
        keys |= np.where(size_a == 2, ids_a[last_a] + 1, 0) << BITS_A
        keys |= np.where(size_b == 2, ids_b[last_b] + 1, 0) << (2 * BITS_A + BITS_B)
        checks = np.zeros(len(keys), np.int64)
        long = np.flatnonzero((size_a > 2) | (size_b > 2))
        if len(long):
            is_long = np.zeros(len(keys), bool)
            is_long[long] = True
            hashes = []
            for seed in (1, 2):
                total = np.zeros(len(long), np.uint64)
                for side, (ids, of, first) in enumerate(((ids_a, a_of, first_a), (ids_b, b_of, first_b))):
                    own = np.flatnonzero(is_long[of])
                    place = (own - first[of[own]]).astype(np.uint64) * np.uint64(4) + np.uint64(2 * side + seed - 1)
                    mixed = mix(mix(place + np.uint64(0x9E3779B97F4A7C15)) ^ ids[own].astype(np.uint64))
                    starts = np.flatnonzero(np.diff(of[own], prepend=-1))
                    total += np.add.reduceat(mixed, starts)
                hashes.append(mix(total).view(np.int64))
            keys[long], checks[long] = hashes[0] | np.int64(-(1 << 63)), hashes[1]
        return keys, checks

    def work(self, texts: list[str | None]) -> list[pa.Array]:
        """One value per text of n_a, n_b, n_groups, digest, and lists of distinct groups with their times."""
        parts = [(row, k, c) for row, t in enumerate(texts) if t for k, c in enumerate(chunks(t))]
        n = len(texts)
        n_a, n_b, n_groups = (np.zeros(n, np.int64) for _ in range(3))
        hashers = {row: hashlib.sha256() for row, _, _ in parts}
        found: dict[int, list] = {row: [] for row in hashers}
        unsound: set[int] = set()
        start = 0
        while start < len(parts):
            stop, held = start, 0
            while stop < len(parts) and (stop == start or held + len(parts[stop][2]) <= 4 * CHUNK):
                held += len(parts[stop][2])
                stop += 1
            own = parts[start:stop]
            start = stop
            a, b, sound = self.tokens([(k, c) for _, k, c in own])
            unsound |= {row for (row, _, _), ok in zip(own, sound, strict=True) if not ok}
            live = [i for i, (row, _, _) in enumerate(own) if row not in unsound]
            got = self.groups([a[i] for i in live], [b[i] for i in live])
            at = 0
            for i, count, digest in zip(live, got.counts.tolist(), got.digests, strict=True):
                row, k, _ = own[i]
                hashers[row].update(b";" * (k > 0) + digest[:-1])
                n_a[row] += len(a[i])
                n_b[row] += len(b[i])
                n_groups[row] += count
                found[row].append((got.keys[at : at + count], got.checks[at : at + count], got.links[at : at + count], np.ones(count, np.int64)))
                if len(found[row]) > 16:
                    found[row] = [summed(*map(np.concatenate, zip(*found[row], strict=True)))]
                at += count
        for row in unsound:
            n_a[row] = n_b[row] = n_groups[row] = 0
            found[row] = []
        lists = [summed(*map(np.concatenate, zip(*found[r], strict=True))) if found.get(r) else None for r in range(n)]
        lengths = [len(x[0]) if x else 0 for x in lists]
        columns = [np.concatenate([x[c] for x in lists if x] or [np.empty(0, np.int64)]) for c in range(4)]
        digests = [hashers[r].hexdigest() if r in hashers and r not in unsound else "" for r in range(n)]
        return [pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(digests), *[list_array(c, lengths) for c in columns]]


def summed(keys: np.ndarray, checks: np.ndarray, links: np.ndarray, *times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct groups in order, and the sums of their times."""
    order = np.lexsort((checks, keys)) if (keys < 0).any() else np.argsort(keys)
    keys, checks, links = keys[order], checks[order], links[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    at = np.flatnonzero(new)
    return keys[at], checks[at], links[at], *[np.add.reduceat(t[order], at) if len(at) else t for t in times]


LISTS = ("keys", "checks", "links", "times")


def coded(docs: DataFrame, first: str, second: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, numbered by ``row``: counts, digest, and its distinct groups."""
    sent = docs.sparkSession.sparkContext.broadcast((first, second))
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").alias("text"))
    fields = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, " + ", ".join(f"{c} array<bigint>" for c in LISTS)
    return with_text_columns(own, "text", fields, lambda: Aligner(*sides(*sent.value)).work, ["doc_id", "row"])


def dictionary(documents: DataFrame) -> DataFrame:
    """(key, check, link, times, n_docs) of every distinct group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> tuple:
            return summed(*map(np.concatenate, zip(*held, strict=True)))

        def out(rows: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["key", "check", "link", "times", "n_docs"])

        size = 0
        for batch in batches:
            own = [np.asarray(batch.column(i).flatten()) for i in range(4)]
            held.append(summed(*own, np.ones(len(own[0]), np.int64)))
            size += len(held[-1][0])
            if size > HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield out(held[0])
                    held, size = [], 0
        if held:
            yield out(merged())

    found = documents.select(*LISTS).mapInArrow(run, "key bigint, check bigint, link bigint, times bigint, n_docs bigint")
    return found.groupBy("key", "check", "link").agg(F.sum("times").alias("times"), F.sum("n_docs").alias("n_docs"))


def links_of(groups: DataFrame) -> DataFrame:
    """(link, count, size, is_best): each distinct group's link once, times how often the group occurs."""
    # At most as many second ids as the vocabulary has: 2^15.
    counted = groups.groupBy("link").agg(F.sum("times").alias("count"), F.count("*").alias("size"))
    second = F.col("link").bitwiseAND((1 << BITS_B) - 1)
    best = counted.groupBy(second.alias("second")).agg(F.max("count").alias("best"))
    return counted.join(F.broadcast(best), second == F.col("second")).select("link", "count", (F.col("count") == F.col("best")).alias("is_best"), "size")


@dataclass
class Alignment:
    """``documents`` (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), ``groups``
    (key, check, link, times, n_docs, count, is_best) and ``links`` (first_id, second_id, count, is_best)."""

    documents: DataFrame
    groups: DataFrame
    links: DataFrame


def align(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = FREQUENT) -> Alignment:
    """Align the tokens of a byte-level vocabulary and a sentencepiece model, given by their files' paths."""
    spark = docs.sparkSession
    with open(first or tokenizer_path(FIRST), encoding="utf-8") as f, open(second or tokenizer_path(SECOND), "rb") as g:
        sources = f.read(), g.read()
    documents, _ = staged(coded(docs, *sources, id_col, text_col), "aligned")
    groups, groups_at = staged(dictionary(documents), "groups")
    links, _ = staged(links_of(groups), "group-links")
    valued, _ = staged(hot_join(groups, links, "link", "key", "size"), "valued-groups")
    drop_path(spark, groups_at)

    # The frequency from which on at most ``most`` groups are left: halves of powers of two.
    step = F.floor(2 * F.log2("times")).cast("int")
    least, n = 0, 0
    for r in sorted(valued.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        n += r["n"]
        if n > most:
            least = r["step"] + 1
            break
    common = valued.where(step >= least).select("key", "check", "count", "is_best").orderBy("key", "check").toArrow()
    sent = spark.sparkContext.broadcast([common[c].to_numpy() for c in common.column_names])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, hit, ends = _frequent(batch, sent.value)
            times = np.asarray(batch.column("times").flatten())
            count = np.where(hit, sent.value[2][where] * times, 0) if len(sent.value[2]) else np.zeros(len(times), np.int64)
            best = np.where(hit & sent.value[3][where], times, 0) if len(sent.value[2]) else np.zeros(len(times), np.int64)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (count, best)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(s.astype(np.int64)) for s in sums]], names=["row", "count_sum", "n_best"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, hit, ends = _frequent(batch, sent.value)
            own = ~hit
            rows = np.repeat(np.asarray(batch.column("row")), np.diff(ends))[own]
            yield pa.RecordBatch.from_arrays([pa.array(rows), *[pa.array(np.asarray(batch.column(c).flatten())[own]) for c in ("keys", "checks", "times")]], names=["row", "key", "check", "times"])

    asked = documents.select("row", "keys", "checks", "times")
    answers = asked.mapInArrow(rare, "row bigint, key bigint, check bigint, times bigint").join(valued.select("key", "check", "count", "is_best"), ["key", "check"])
    by_row = answers.groupBy("row").agg(F.sum(F.col("count") * F.col("times")).alias("rare_sum"), F.sum(F.when(F.col("is_best"), F.col("times"))).alias("rare_best"))
    known = asked.mapInArrow(partial, "row bigint, count_sum bigint, n_best bigint")
    none = F.lit(0).cast("bigint")
    sums = known.union(by_row.select("row", "rare_sum", F.coalesce("rare_best", none))).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = documents.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
    shown = links.select(F.shiftright("link", BITS_B).alias("first_id"), F.col("link").bitwiseAND((1 << BITS_B) - 1).alias("second_id"), "count", "is_best")
    return Alignment(out, valued, shown)


def _frequent(batch: pa.RecordBatch, common: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a batch's groups stand among the frequent ones, which of them do, and where each row's list ends."""
    keys, checks = (np.asarray(batch.column(c).flatten()) for c in ("keys", "checks"))
    ends = np.concatenate([[0], np.cumsum(np.asarray(batch.column("keys").value_lengths()))])
    known, known_checks = common[0], common[1]
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), ends
    # Of groups that share the first hash one is found here; the other is asked for as a rare one.
    where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return where, (known[where] == keys) & (known_checks[where] == checks), ends


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text")).documents
