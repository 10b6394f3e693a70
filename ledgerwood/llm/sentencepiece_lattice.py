"""SentencePiece encoding and decoding over a lattice of pieces (operator 4).

The lattice is relational: a word's substrings of bounded length are exploded, joined with the
piece table on equality, and the matching edges are grouped by word. Two folds choose the path:

* ``viterbi``: the path of the greatest sum of scores, for unigram models. ``encode_words`` runs it
  as Spark joins with a higher-order ``aggregate``; ``PieceTable`` has it on arrays.
* ``merges``: neighbours join in order of score, leftmost first, for BPE models. Their scores are
  merge ranks, which sums say nothing about: Viterbi gives other ids than the model's own.

``encode`` takes the fold of the model's kind, so ids equal those of the sentencepiece library. It
runs the same explode, join, group and fold on arrays of a batch's distinct words inside each
task: nothing is shuffled, and a task remembers a bounded number of words.

Defined results: a null or empty text has no pieces and decodes to an empty text; characters
without a piece become byte pieces; the meta symbol U+2581 counts as a space, so decoding is exact
for texts without it; repeated rows and extra columns are kept as they are.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_array, mix, table, tokenizer_path, with_text_columns

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
REMEMBERED = 200_000
#: Characters from which a word is folded on its own, by a heap.
LONG = 64
CELLS = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)
_UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def read_pieces(path: str) -> tuple[list[tuple[str, float, str]], str]:
    """(piece, score, kind of piece) by id, and the model's kind."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    with open(path, "rb") as f:
        raw = f.read()
    model = ModelProto.FromString(raw)
    p = SentencePieceProcessor(model_proto=raw)
    kind = lambda i: "byte" if p.is_byte(i) else "other" if p.is_control(i) or p.is_unknown(i) else "piece"
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())], {1: "unigram", 2: "bpe"}.get(model.trainer_spec.model_type, "other")


class PieceTable:
    """A piece table keyed by a hash of code points, and the folds over its lattices."""

    def __init__(self, pieces: Sequence[tuple[str, float, str]], kind: str):
        self.fold = "viterbi" if kind == "unigram" else "merges"
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == "piece"}
        self.scores = np.array([s for _, s, _ in pieces])
        self.rank = np.unique(self.scores, return_inverse=True)[1].astype(np.int32)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        self.unknown = next((i for i, (p, _, _) in enumerate(pieces) if p == "<unk>"), 0)
        self.longest = max(map(len, self.ids))
        self.floor = float(self.scores[list(self.ids.values())].min()) - 10.0
        bits = max(12, (len(self.ids) * 16).bit_length())
        self.down, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.found = np.full(1 << bits, -1, np.int32)
        self.probes = 1
        for piece, i in self.ids.items():
            key = self._hash(np.array([[ord(c) for c in piece]], np.uint64))[0]
            slot, n = int(key >> self.down), 1
            while self.found[slot] >= 0:
                slot, n = (slot + 1) & self.mask, n + 1
            self.keys[slot], self.found[slot], self.probes = key, i, max(self.probes, n)

    @staticmethod
    def _hash(points: np.ndarray) -> np.ndarray:
        h = np.zeros(points.shape[0], np.uint64)
        for k in range(points.shape[1]):
            h = h * _P + points[:, k] + np.uint64(1)
        return mix(h)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash, -1 for none."""
        slot = (keys >> self.down).astype(np.int64)
        out = self.found[slot]
        other = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))  # a slot that another piece holds
        for _ in range(self.probes - 1):
            if not len(other):
                break
            slot[other] = (slot[other] + 1) & self.mask
            out[other] = self.found[slot[other]]
            other = other[(out[other] >= 0) & (self.keys[slot[other]] != keys[other])]
        out[other] = -1
        return out

    def lattice(self, points: np.ndarray) -> np.ndarray:
        """Ids by (word, start, length - 1). Words are rows of code points + 1, padded with zeros."""
        w, n = points.shape
        wide = min(self.longest, n)
        edges = np.full((w, n, wide), -1, np.int32)
        h = np.zeros((w, n), np.uint64)
        for k in range(wide):
            h = h[:, : n - k] * _P + points[:, k:]
            row, at = np.nonzero(points[:, k:])
            edges[row, at, k] = self.lookup(mix(h[row, at]))
        return edges

    def merged(self, edges: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sizes of the symbols by (word, start) after all merges; 0 inside a symbol."""
        w, n, wide = edges.shape
        starts = np.arange(n, dtype=np.int32)[None, :]
        size = (starts < lengths[:, None]).astype(np.int32)
        live = np.arange(w)
        while len(live):
            own = size[live]
            after = np.minimum(starts + own, n - 1)
            both = own + np.take_along_axis(own, after, 1)
            fits = (own > 0) & (starts + own < lengths[live][:, None]) & (both <= wide)
            ids = np.where(fits, edges[live[:, None], starts, np.clip(both - 1, 0, wide - 1)], -1)
            rank = np.where(ids >= 0, self.rank[ids], -1)
            at = rank.argmax(1)  # of equal ones the leftmost
            any_left = rank[np.arange(len(live)), at] >= 0
            live, at, after, both = live[any_left], at[any_left], after[any_left], both[any_left]
            rows = np.arange(len(live))
            size[live, after[rows, at]] = 0
            size[live, at] = both[rows, at]
        return size

    def viterbi(self, edges: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sizes of the symbols of each word's best path; of equal sums the longer last piece."""
        w, n, wide = edges.shape
        best, back = np.full((w, n + 1), -np.inf), np.zeros((w, n + 1), np.int64)
        best[:, 0] = 0
        for stop in range(1, n + 1):
            for k in range(1, min(wide, stop) + 1):
                ids = edges[:, stop - k, k - 1]
                score = np.where(ids >= 0, self.scores[ids], self.floor if k == 1 else -np.inf) + best[:, stop - k]
                better = score >= best[:, stop]
                best[better, stop], back[better, stop] = score[better], k
        size, at, rows = np.zeros((w, n), np.int64), lengths.copy(), np.arange(w)
        while (left := at > 0).any():
            step = np.where(left, back[rows, at], 0)
            at = at - step
            size[rows[left], at[left]] = step[left]
        return size

    def _spell(self, piece: int, char: str) -> list[int]:
        """A symbol's id, or the byte pieces of a character without one."""
        if piece >= 0:
            return [piece]
        raw = char.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]

    def encode_long(self, word: str) -> list[int]:
        """One long word: a heap of merges, or Viterbi position by position."""
        if self.fold == "viterbi":
            points = np.array([[ord(c) + 1 for c in word]], np.uint64)
            edges, lengths = self.lattice(points), np.array([len(word)])
            size = self.viterbi(edges, lengths)[0]
            return [i for at in np.flatnonzero(size) for i in self._spell(int(edges[0, at, size[at] - 1]), word[at])]
        n = len(word)
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and (b := stop[a]) < n and stop[b] - a <= self.longest and (i := self.ids.get(word[a : stop[b]])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, b, stop[b]))

        for a in range(n - 1):
            offer(a)
        alive = [True] * n
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if alive[a] and alive[b] and stop[a] == b and stop[b] == c:
                alive[b], stop[a] = False, c
                if c < n:
                    before[c] = a
                offer(a)
                offer(before[a])
        return [i for a in range(n) if alive[a] for i in self._spell(self.ids.get(word[a : stop[a]], -1), word[a])]

    def encode_units(self, words: list[str]) -> list[bytes]:
        """Ids of each word as packed 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = np.array(self.encode_long(w), np.int32).tobytes()
            elif w:
                by_size.setdefault((len(w) + 3) // 4 * 4, []).append(i)
        for n, members in by_size.items():
            most = max(1, CELLS // (n * min(n, self.longest)))
            for start in range(0, len(members), most):
                own = members[start : start + most]
                lengths = np.array([len(words[i]) for i in own], np.int64)
                points = np.zeros((len(own), n), np.uint64)
                flat = np.frombuffer("".join(words[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32)
                points[np.arange(n)[None, :] < lengths[:, None]] = flat.astype(np.uint64) + np.uint64(1)
                edges = self.lattice(points)
                size = (self.viterbi if self.fold == "viterbi" else self.merged)(edges, lengths)
                row, at = np.nonzero(size)
                ids = edges[row, at, size[row, at] - 1]
                ends = np.cumsum(np.bincount(row, minlength=len(own)))
                strange = set(row[ids < 0].tolist())
                packed = ids.astype(np.int32).tobytes()
                for k, i in enumerate(own):
                    lo, hi = (int(ends[k - 1]) if k else 0), int(ends[k])
                    if k in strange:
                        spelled = [x for p, a in zip(ids[lo:hi], at[lo:hi], strict=True) for x in self._spell(int(p), words[i][a])]
                        out[i] = np.array(spelled, np.int32).tobytes()
                    else:
                        out[i] = packed[4 * lo : 4 * hi]
        return out


class Encoder:
    """Encodes texts through a bounded memory of the chunks between spaces."""

    def __init__(self, pieces: PieceTable, remembered: int = REMEMBERED):
        self.pieces, self.remembered = pieces, remembered
        self.known: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> None:
        missing = [c for c in chunks if c not in self.known]
        if not missing:
            return
        if len(self.known) + len(missing) > self.remembered:
            self.known.clear()
            missing = list(chunks)
        units = [_UNITS.findall(SPACE + c) if "\n" in c else [SPACE + c] for c in missing]
        distinct = list({u for own in units for u in own})
        ids = dict(zip(distinct, self.pieces.encode_units(distinct), strict=True))
        self.known.update((c, b"".join(map(ids.__getitem__, own))) for c, own in zip(missing, units, strict=True))

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        chunks = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        plain = {c for own in chunks for c in own if c}
        self._learn(plain)
        out = []
        for text, own in zip(texts, chunks, strict=True):
            if "" not in own:
                out.append(b"".join(map(self.known.__getitem__, own)))
            else:  # runs of spaces: a unit begins with the whole run
                units = _UNITS.findall(SPACE + text.replace(" ", SPACE))
                out.append(b"".join(self.pieces.encode_units(units)))
        return out


def _spelled(pieces: Sequence[tuple[str, float, str]]) -> list[bytes]:
    return [bytes([int(p[3:5], 16)]) if kind == "byte" else b"" if kind == "other" else p.replace(SPACE, " ").encode() for p, _, kind in pieces]


def _text_of(ids: np.ndarray, spelled: list[bytes]) -> str:
    raw = b"".join(map(spelled.__getitem__, ids.tolist()))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")  # without the space that encoding puts first


def encode(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None, checked: bool = False) -> DataFrame:
    """The kept columns and each whole text's piece ``ids``; with ``checked``, whether they decode to it as well.

    The piece table, of fixed size, is read by the driver and sent to the tasks.
    """
    table_ = docs.sparkSession.sparkContext.broadcast(read_pieces(path or tokenizer_path(MODEL)))

    def make():
        encoder = Encoder(PieceTable(*table_.value))
        spelled = _spelled(table_.value[0])

        def work(texts):
            packed = [np.frombuffer(p, np.int32) for p in encoder.encode(texts)]
            out = [list_array(np.concatenate(packed), [len(p) for p in packed])]
            if checked:
                out.append(pa.array([_text_of(p, spelled) == (t or "") for p, t in zip(packed, texts, strict=True)]))
            return out

        return work

    return with_text_columns(docs, text_col, "ids array<int>" + ", round_trip boolean" * checked, make, keep)


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None, into: str = "decoded") -> DataFrame:
    """All columns and the text of each row's ids."""
    pieces = encoded.sparkSession.sparkContext.broadcast(read_pieces(path or tokenizer_path(MODEL))[0])
    names = [c for c in encoded.columns if c != into]
    source = encoded.select(*names)

    def run(batches):
        spelled = _spelled(pieces.value)
        for batch in batches:
            lists = batch.column(names.index(ids_col))
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))])
            ids = np.asarray(lists.flatten())
            made = pa.array([_text_of(ids[a:b], spelled) for a, b in zip(ends, ends[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{schema}, `{into}` string")


def encode_words(words: DataFrame, pieces: DataFrame, longest: int, floor: float, word_col: str = "word") -> DataFrame:
    """(word, pieces): the Viterbi path of distinct words as joins and one higher-order fold.

    ``pieces`` (piece, score) is a model's table, of fixed size, and is broadcast. Edges stay in the
    partition of their word, so after the words are dealt out nothing is shuffled.
    """
    w = F.col("word")
    n = F.char_length(w)
    own = words.select(F.col(word_col).alias("word")).where(F.col(word_col).isNotNull() & (F.char_length(word_col) > 0)).distinct()
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)), lambda k: F.struct((i + k - 1).alias("stop"), k.alias("size"), w.substr(i, k).alias("piece")))))
    exploded = own.select("word", F.inline(spans))
    matched = exploded.join(F.broadcast(pieces.select("piece", F.col("score").cast("double").alias("score"))), "piece", "left")
    matched = matched.where("score IS NOT NULL OR size = 1").withColumn("score", F.coalesce("score", F.lit(floor)))
    grouped = matched.groupBy("word").agg(F.collect_list(F.struct("stop", "size", "score")).alias("edges"))
    first = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("size")))
    step = lambda best, p: F.concat(best, F.array(F.array_max(F.transform(F.filter("edges", lambda e: e["stop"] == p), lambda e: F.struct((F.get(best, p - e["size"])["sum"] + e["score"]).alias("sum"), e["size"].alias("size"))))))
    best = F.aggregate(F.sequence(F.lit(1), n), first, step)
    start = F.struct(n.alias("at"), F.array().cast("array<string>").alias("pieces"))
    size = lambda at: F.get("best", at)["size"]
    walk = lambda s, _: F.when(s["at"] > 0, F.struct((s["at"] - size(s["at"])).alias("at"), F.concat(F.array(w.substr(s["at"] - size(s["at"]) + 1, size(s["at"]))), s["pieces"]).alias("pieces"))).otherwise(s)
    return grouped.withColumn("best", best).select("word", F.aggregate(F.sequence(F.lit(1), n), start, walk)["pieces"].alias("pieces"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), checked=True)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")
