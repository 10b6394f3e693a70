"""Token counts at every prefix of a text (operator 10), by dynamic programming.

The vocabulary's merges fix which tokens may stand side by side: a row of tokens is what
the merges make of a word exactly when each of its tokens is what they make of its own
bytes, and so is each pair of neighbours. So of the tokens that end at some byte of a word
just one can follow the last token of the prefix before it, and one more than that prefix's
count is the count of the longer prefix. Each prefix of a word costs the few tokens that end
there; no prefix is encoded, and the merges are never run over a text.

A word's end is part of its last token here, so each byte has two entries: the last token
where the word goes on, and the count of the prefix as a word of its own.

Words, numbers and runs of signs are counted apart, as the vocabulary's pattern cuts them,
and remembered by task. A text's table holds the count of each of its character prefixes:
truncation and budget questions are lookups in it.

Characters are composed (NFC) and lower-cased first. Where a prefix isn't composed as it is
within the text (before a combining sign), where it ends within a contraction and where it
ends within a special string, its last word is not a prefix of the text's: there the
programme is run on that piece of the text once more.

Defined results: a null or empty text has the one count 0; repeated rows give repeated
results; very long texts and words are counted whole; extra columns are ignored unless kept.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Sequence
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_array, table, tokenizer_path, utf8, with_text_columns

VOCABULARY = "word_bpe_49k.json"
#: Bytes of chunks and their tables that a task remembers; the memory is emptied when full, which changes no result.
REMEMBERED = 96 << 20
LIMIT = 2048
#: Words of more bytes are followed one by one, shorter ones together.
TOGETHER = 48
_SPACE = regex.compile(r"\p{White_Space}+")
#: Which of the first characters are white space; no later one is.
_IS_SPACE = np.array([_SPACE.match(chr(c)) is not None for c in range(0x3001)])
#: Characters that str.split takes for white space, and Unicode doesn't.
_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in files of byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted keys stand among sorted ones, and which of them do."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Merges:
    """The merges of a vocabulary, its tokens as a tree of bytes, and which tokens may be neighbours."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        end = model["end_of_word_suffix"]
        ids = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(ids.values()) + 1
        self.specials = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        cut = next(p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(cut.replace(r"\s", r"\p{White_Space}"))
        # What a token was merged from, and when; the letters of the alphabet come before all merges.
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        joined = {}
        for rank, (a, b) in enumerate(merges):
            token = ids[a + b]
            self.rank[token], self.left[token], self.right[token] = rank, ids[a], ids[b]
            joined[ids[a] * self.size + ids[b]] = rank
        self.pair_keys = np.array(sorted(joined), np.int64)
        self.pair_ranks = np.array([joined[k] for k in self.pair_keys.tolist()], np.int64)
        # The tree: an edge by (node, byte), and the tokens that a node spells, within and at the end of a word.
        value = {letter: b for b, letter in enumerate(byte_letters())}
        edges: dict[tuple[int, int], int] = {}
        within, final, longest = [-1], [-1], 0
        for text, token in ids.items():
            last = text.endswith(end) and len(text) > len(end)
            spelled = bytes(value[c] for c in (text[: -len(end)] if last else text))
            node, longest = 0, max(longest, len(spelled))
            for b in spelled:
                node = edges.setdefault((node, b), len(within))
                if node == len(within):
                    within.append(-1)
                    final.append(-1)
            (final if last else within)[node] = token
        self.edges = edges
        self.within, self.final = np.array(within), np.array(final)
        keys = sorted(edges)
        self.edge_keys = np.array([n * 256 + b for n, b in keys], np.int64)
        self.edge_to = np.array([edges[k] for k in keys], np.int64)
        # A token that the merges don't make of its own bytes never occurs.
        sound = self.rank < 0
        made = np.flatnonzero(~sound)
        sound[made] = self.side_by_side(self.left[made], self.right[made], self.rank[made])
        for tokens in (self.within, self.final):
            tokens[(tokens >= 0) & ~sound[tokens]] = -1
        self.within_list, self.final_list = self.within.tolist(), self.final.tolist()
        self.rank_list, self.left_list, self.right_list = self.rank.tolist(), self.left.tolist(), self.right.tolist()
        self.longest, self.joined = longest, joined
        self.known = np.empty(0, np.int64)
        self.allowed = np.empty(0, bool)
        self.one: dict[int, bool] = {}

    def side_by_side(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges leave a seam between tokens a and b (up to the merge ``below`` of the two).

        Backwards from the two tokens: the later of the two merges beside the seam is undone. If at some
        time the pieces beside the seam could have been merged before that, they would have been; of equal
        merges the left one comes first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), len(self.rank), np.int64) if below is None else below.astype(np.int64)
        out, at = np.ones(len(a), bool), np.arange(len(a))
        while len(at):
            where, known = _find(self.pair_keys, a * self.size + b)
            crossed = known & (self.pair_ranks[where] < limit)
            out[at[crossed]] = False
            x, y = self.rank[a], self.rank[b]
            go = ~crossed & ((x >= 0) | (y >= 0))
            at, a, b, x, y = at[go], a[go], b[go], x[go], y[go]
            undo_left = x > y
            limit = np.where(undo_left, x, y + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``side_by_side`` with a memory; a of -1 is the start of a word."""
        keys = a * self.size + b
        keys[a < 0] = -1
        where, known = _find(self.known, keys)
        out = np.ones(len(keys), bool)
        if len(self.known):
            out[known] = self.allowed[where[known]]
        new = np.unique(keys[~known & (keys >= 0)])
        if len(new):
            allowed = self.side_by_side(new // self.size, new % self.size)
            out[~known & (keys >= 0)] = allowed[np.searchsorted(new, keys[~known & (keys >= 0)])]
            if len(self.known) > 2_000_000:
                self.known, self.allowed = self.known[:0], self.allowed[:0]
            order = np.argsort(both := np.concatenate([self.known, new]), kind="stable")
            self.known, self.allowed = both[order], np.concatenate([self.allowed, allowed])[order]
        return out

    def _follows(self, a: int, b: int) -> bool:
        """``may_follow`` for one pair."""
        if a < 0:
            return True
        key = a * self.size + b
        if (found := self.one.get(key)) is None:
            if len(self.one) > 1_000_000:
                self.one.clear()
            found = self.one[key] = self._seam(a, b)
        return found

    def _seam(self, a: int, b: int) -> bool:
        """``side_by_side`` for one pair."""
        limit = self.size
        while self.joined.get(a * self.size + b, limit) >= limit:
            x, y = self.rank_list[a], self.rank_list[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                limit, a = x, self.right_list[a]
            else:
                limit, b = y + 1, self.left_list[b]
        return False

    def follow(self, word: bytes, known: tuple[list[int], list[int]] | None = None) -> tuple[list[int], list[int], list[int]]:
        """The last token and the count of each byte prefix of a word that goes on, and its count as a word.

        ``known`` has the first two for a prefix of the word: then only what is longer is followed.
        """
        n, edges = len(word), self.edges
        done = len(known[0]) - 1 if known else 0
        last = [*known[0], *[-1] * (n - done)] if known else [-1] * (n + 1)
        counts = [*known[1], *[0] * (n - done)] if known else [0] * (n + 1)
        out = [0] * (n + 1)
        ready: dict[int, list[tuple[int, int, int]]] = {}
        for i in range(max(0, done - self.longest + 1), n + 1):
            # Tokens that end at i come from earlier starts, so all of them are known by now.
            for start, token, final in ready.pop(i, ()):
                if token >= 0 and self._follows(last[start], token):
                    last[i], counts[i] = token, counts[start] + 1
                if final >= 0 and self._follows(last[start], final):
                    out[i] = counts[start] + 1
            node, j = 0, i
            while j < n and (node := edges.get((node, word[j]), -1)) >= 0:
                j += 1
                if j > done:
                    ready.setdefault(j, []).append((i, self.within_list[node], self.final_list[node]))
        return last, counts, out

    def prefix_counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The counts of all byte prefixes of some words, end to end, and each word's length."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        firsts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        out = np.zeros(len(flat), np.int32)
        for w in np.flatnonzero(lengths > TOGETHER).tolist():
            out[firsts[w] : firsts[w] + lengths[w]] = self.follow(words[w])[2][1:]
        short = lengths <= TOGETHER
        stop = np.repeat(np.where(short, firsts + lengths, 0), lengths)
        # From every byte down the tree at once: (first byte, place after the last, tokens).
        start = at = np.flatnonzero(stop > 0)
        node = np.zeros(len(at), np.int64)
        found = []
        while len(at):
            where, known = _find(self.edge_keys, node * 256 + flat[at])
            start, at, node = start[known], at[known] + 1, self.edge_to[where[known]]
            found.append((start, at, self.within[node], self.final[node]))
            go = at < stop[start]
            start, at, node = start[go], at[go], node[go]
        if not found:
            return out, lengths
        start, after, token, final = (np.concatenate([f[i] for f in found]) for i in range(4))
        place = np.arange(len(flat)) - np.repeat(firsts, lengths)
        # last and counts of the prefix that ends before a byte; a word's first byte has none.
        last, counts = np.full(len(flat) + 1, -1, np.int64), np.zeros(len(flat) + 1, np.int32)
        inner = np.flatnonzero((token >= 0) & (after < stop[start]))
        inner = inner[np.argsort(place[after[inner] - 1], kind="stable")]
        depth = place[after[inner] - 1]
        for k in np.split(inner, np.searchsorted(depth, np.arange(1, TOGETHER))):
            if len(k):
                k = k[self.may_follow(last[start[k]], token[k])]
                last[after[k]], counts[after[k]] = token[k], counts[start[k]] + 1
        k = np.flatnonzero(final >= 0)
        k = k[self.may_follow(last[start[k]], final[k])]
        out[after[k] - 1] = counts[start[k]] + 1
        return out, lengths


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    """Read once in a worker, not by each of its tasks."""
    return Merges(path)


def composed(text: str) -> str:
    """The text as the vocabulary sees it: composed and lower-cased sign by sign."""
    if text.isascii():
        return text.lower()
    text = normalize("NFC", text)
    return "".join([c.lower() for c in text]) if "Σ" in text or "İ" in text else text.lower()


def plain_prefixes(chunk: str) -> bool:
    """Whether every character prefix is composed and lower-cased as it is within the chunk."""
    if chunk.isascii():
        return True
    return normalize("NFC", chunk) == chunk and len(composed(chunk)) == len(chunk)


def ragged(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of an array that begin at some offsets, end to end."""
    stops = np.cumsum(lengths)
    return flat[np.arange(stops[-1] if len(stops) else 0) + np.repeat(offsets - (stops - lengths), lengths)]


class _Store:
    """Arrays end to end in one that grows."""

    def __init__(self, kind):
        self.values, self.n = np.empty(1024, kind), 0

    def add(self, new: np.ndarray) -> None:
        while self.n + len(new) > len(self.values):
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        self.values[self.n : self.n + len(new)] = new
        self.n += len(new)


class PrefixCounter:
    """Tables of counts at all character prefixes, remembered by chunk (a run without white space)."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.merges = merges_of(path)
        self.remembered = remembered
        self.special = regex.compile("|".join(map(regex.escape, self.merges.specials)))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.counts, self.offsets, self.lengths = _Store(np.int32), _Store(np.int64), _Store(np.int64)

    def tables(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The count after each character of each chunk, end to end; the chunks' lengths and totals."""
        missing = [c for c in dict.fromkeys(chunks) if c not in self.known]
        if missing and 5 * self.counts.n + 200 * len(self.known) > self.remembered:
            self._forget()
            missing = list(dict.fromkeys(chunks))
        if missing:
            plain = [c for c in missing if (c.isascii() or plain_prefixes(c)) and "<|" not in c]
            self._learn(plain, *self._plain([composed(c) for c in plain]))
            odd = [c for c in missing if c not in self.known]
            if odd:
                made = [self._odd(c) for c in odd]
                self._learn(odd, np.concatenate(made), np.array([len(m) for m in made]))
        at = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        offsets, lengths = self.offsets.values[at], self.lengths.values[at]
        return ragged(self.counts.values, offsets, lengths), lengths, self.counts.values[offsets + lengths - 1].astype(np.int64)

    def _learn(self, chunks: list[str], counts: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.offsets.add(self.counts.n + np.cumsum(lengths) - lengths)
        self.lengths.add(lengths)
        self.counts.add(counts)

    def _plain(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tables of chunks that are composed and lower-cased, without special strings, end to end; their lengths."""
        find = self.merges.pattern.findall
        cut = [[c] if c.isalpha() else find(c) for c in chunks]
        n_words = np.fromiter(map(len, cut), np.int64, len(cut))
        number: dict[str, int] = {}
        at = np.fromiter((number.setdefault(w, len(number)) for own in cut for w in own), np.int64, int(n_words.sum()))
        words = list(number)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        counts, sizes = self.merges.prefix_counts(raw)
        # Of the bytes, those that end a character.
        flat = np.frombuffer(b"".join(raw) + b"a", np.uint8)
        ends = (flat[1:] & 0xC0) != 0x80
        counts = counts[ends]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        offsets = np.cumsum(lengths) - lengths
        for w, word in enumerate(words):
            if word[0] == "'" and len(word) > 1 and word[1].isalpha():
                # Before its end a contraction is a sign and letters.
                counts[offsets[w]] = 1
                if len(word) > 2:
                    counts[offsets[w] + 1 : offsets[w] + lengths[w] - 1] = 1 + self.merges.prefix_counts([word[1:-1].encode()])[0]
        out = ragged(counts, offsets[at], lengths[at])
        if not len(at):
            return out.astype(np.int32), np.zeros(len(cut), np.int64)
        # Each word adds to the totals of those before it in its chunk.
        totals = counts[offsets[at] + lengths[at] - 1].astype(np.int64)
        before = np.cumsum(totals) - totals
        firsts = np.cumsum(n_words) - n_words
        before -= np.repeat(before[np.minimum(firsts, len(at) - 1)], n_words)
        out = out + np.repeat(before, lengths[at])
        return out.astype(np.int32), np.fromiter(map(len, chunks), np.int64, len(chunks))

    def _odd(self, chunk: str) -> np.ndarray:
        """The table of a chunk whose prefixes aren't all read as they are within it."""
        parts, before, at = [], 0, 0
        for m in self.special.finditer(chunk):
            # Up to its last character a special string is plain text; then it is one token.
            own = self._pieced(chunk[at : m.end() - 1])
            kept = own[: m.start() - at]
            total = int(kept[-1]) if len(kept) else 0
            parts += [before + own, np.array([before + total + 1], np.int32)]
            before, at = before + total + 1, m.end()
        parts.append(before + self._pieced(chunk[at:]))
        return np.concatenate(parts).astype(np.int32)

    def _pieced(self, text: str) -> np.ndarray:
        """The table of a text without special strings, composed or not.

        Between two places where nothing composes, prefixes of the text are prefixes of its composed
        form; within such a piece, a sign with its combining ones, each prefix is composed on its own.
        """
        if not text:
            return np.empty(0, np.int32)
        whole = composed(text)
        counts = self._plain([whole])[0]
        if plain_prefixes(text):
            return counts
        words = [(m.start(), m.group()) for m in self.merges.pattern.finditer(whole)]
        out, start, reached = np.zeros(len(text), np.int32), 0, 0
        follower = _Follower(self.merges, words, counts)
        while start < len(text):
            stop = start + 1
            while stop < len(text) and not _parted(text[stop - 1], text[stop]):
                stop += 1
            piece = text[start:stop]
            all_of_it = composed(piece)
            for k in range(1, stop - start):
                part = composed(piece[:k])
                if all_of_it.startswith(part):
                    out[start + k - 1] = counts[reached + len(part) - 1]
                else:
                    out[start + k - 1] = follower.count(reached, part)
            reached += len(all_of_it)
            out[stop - 1] = counts[reached - 1]
            start = stop
        return out


class _Follower:
    """Counts of texts that begin like a counted one and go on otherwise."""

    def __init__(self, merges: Merges, words: list[tuple[int, str]], counts: np.ndarray):
        self.merges, self.words, self.counts = merges, words, counts
        self.starts = [s for s, _ in words]
        self.states: dict[int, tuple[list[int], list[int]]] = {}

    def count(self, reached: int, part: str) -> int:
        """The count of the first ``reached`` characters and ``part``: their last word can go on in it."""
        find = self.merges.pattern.findall
        if not reached:
            return self._sum(find(part))
        k = bisect_right(self.starts, reached - 1) - 1
        start, word = self.words[k]
        own = word[: reached - start]
        if len(own) < 8:  # a sign before it and what follows can make it a contraction
            sign = "'" if k and self.words[k - 1][1] == "'" else ""
            before = start - len(sign)
            return (int(self.counts[before - 1]) if before else 0) + self._sum(find(sign + own + part))
        # A long word is letters or signs alone, so a few of them show how far it goes on.
        joined = len(find(own[-8:] + part)[0]) - 8
        if not joined:
            return int(self.counts[reached - 1]) + self._sum(find(part))
        if k not in self.states:
            self.states[k] = self.merges.follow(word.encode())[:2]
        done = len(own.encode())
        last, counts = (x[: done + 1] for x in self.states[k])
        here = self.merges.follow((own + part[:joined]).encode(), (last, counts))[2][-1]
        return (int(self.counts[start - 1]) if start else 0) + here + self._sum(find(part[joined:]))

    def _sum(self, words: list[str]) -> int:
        return sum(int(self.merges.prefix_counts([w.encode()])[0][-1]) for w in words)


def _parted(a: str, b: str) -> bool:
    """Whether b begins a piece of its own: it neither composes with what stands before it nor is combining."""
    if b.isascii():
        return True
    return regex.match(r"\p{M}", b) is None and not "ᄀ" <= b <= "ᇿ" and len(normalize("NFC", a + b)) == len(normalize("NFC", a)) + len(normalize("NFC", b))


def prefix_table(counter: PrefixCounter, text: str | None) -> np.ndarray:
    """The count of text[:k] for each k from 0 on."""
    return _tables(counter, [text])[0][0]


def _chunks(text: str) -> tuple[list[str], np.ndarray]:
    """The runs without white space, and which characters are in one."""
    if text.isascii():
        codes = np.frombuffer(text.encode(), np.uint8)
        inside = ~_IS_SPACE[codes]
        # Lower-cased here only to remember fewer chunks; a special string is case-sensitive.
        text = text if "<|" in text else text.lower()
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = ~_IS_SPACE[np.minimum(codes, len(_IS_SPACE) - 1)] | (codes >= len(_IS_SPACE))
    return [c for c in _SPACE.split(text) if c] if not _SEPARATORS.isdisjoint(text) else text.split(), inside


def _tables(counter: PrefixCounter, texts: Sequence[str | None]) -> tuple[list[np.ndarray], list[int]]:
    cut = [_chunks(t or "") for t in texts]
    flat, lengths, totals = counter.tables([c for own, _ in cut for c in own])
    before = np.cumsum(totals) - totals
    counted = flat + np.repeat(before, lengths)
    out, chunk, place = [], 0, 0
    for own, inside in cut:
        counts = np.zeros(len(inside) + 1, np.int32)
        if own:
            n = int(np.count_nonzero(inside))
            counts[1:][inside] = counted[place : place + n] - before[chunk]
            place, chunk = place + n, chunk + len(own)
            # Over white space the count stays.
            counts[1:] = counts[np.maximum.accumulate(np.where(inside, np.arange(1, len(counts)), 0))]
        out.append(counts)
    return out, [len(utf8(t)) for t in texts]


def prefix_counts(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """Each row's ``n_bytes`` and ``counts``: the token count of its first k characters at place k, from 0 on."""
    path = path or tokenizer_path(VOCABULARY)

    def make():
        counter = PrefixCounter(path)

        def work(texts):
            tables, n_bytes = _tables(counter, texts)
            return [pa.array(n_bytes, pa.int64()), list_array(np.concatenate(tables), [len(t) for t in tables])]

        return work

    return with_text_columns(docs, text_col, "n_bytes bigint, counts array<int>", make, keep)


def total_tokens(counts: str = "counts") -> F.Column:
    """The count of the whole text from its prefix table."""
    return F.try_element_at(F.col(counts), F.lit(-1)).cast("bigint")


def tokens_at(n_chars: int | F.Column, counts: str = "counts") -> F.Column:
    """Tokens of the first ``n_chars`` characters."""
    n = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.get(F.col(counts), F.least(n, F.size(counts) - 1)).cast("bigint")


def chars_within_budget(budget: int, counts: str = "counts") -> F.Column:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    fits = F.transform(F.col(counts), lambda c, k: F.when(c <= F.lit(budget), k))
    return F.coalesce(F.array_max(fits), F.lit(0))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts(table(spark, sf_dir, "documents"))
    n = total_tokens()
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > LIMIT).alias("over_limit"))
