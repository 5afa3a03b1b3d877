"""SentencePiece encoding and decoding from the model file's piece table.

A text gets the model's space mark in front and for each space, and falls into
*units*: a run of marks and what follows it up to the next mark.  No piece of a
model of this kind reaches over such a border, so units are encoded alone.

*Relational lattice* (``encode_units``): substrings of bounded length of each
distinct unit are exploded and equi-joined to the piece table (broadcast; its
size is the vocabulary's), the edges are grouped by unit, and a higher-order
``aggregate`` folds them.  For a unigram model the fold is Viterbi over the
lattice's nodes.  The scores of a BPE model are merge ranks, for which the best
path is not the model's segmentation; there the fold applies the lattice's edges
as merges, best rank first, which is.  Characters without a piece become bytes.
An ``aggregate`` copies its state at each step; of units of more than ``SHORT``
characters the same edges are folded with a heap or by nodes instead.

The lattice encodes every unit.  The ids of the ``TABLE_UNITS`` most frequent
ones are broadcast.  Any other unit is cut where two neighbouring characters are
in no piece, and its *parts* go through the lattice once each; their ids come
back by a join on blocks of documents (``BLOCK_BYTES``).  Texts aren't shuffled:
where it is read, a block becomes one row with a number for each of its units and
a list of its own parts, compressed, and its ids come back by the parts' places
in that list.  A block's key is a hash of the row, so that a block that is read
again in another order can't take ids of the first; it would miss them and raise.

Defined results: null and empty texts have no ids and decode to the empty text;
null ids are kept; repeated rows give repeated results; an empty table gives an
empty result; extra columns are ignored.  Decoding an id outside the vocabulary
raises IndexError.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import heapq
import operator
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessera.llm import _store
from tessera.llm import _text as tx

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
TABLE_UNITS, LONG = 20_000, 40
#: Units a task counts or remembers before it hands them on.
MEMORY = 200_000
#: Text of a block of documents, which one call encodes with the ids of the block's own units.
BLOCK_BYTES = 16 << 20
#: Characters of a unit whose borders fit a long; starts of pieces in a window of a longer unit.
SHORT, WINDOW = 60, 64
_NEVER = float("inf")
_UNIT = re.compile("▁*[^▁]+|▁+")


@dataclass
class Pieces:
    """Piece table of a model file."""

    kind: str  # "bpe" or "unigram"
    text: list[str]
    score: list[float]
    usable: dict[str, int] = field(default_factory=dict)
    byte: dict[int, int] = field(default_factory=dict)
    unknown: int = 0
    cost: dict[str, float] = field(default_factory=dict)

    @property
    def longest(self) -> int:
        return max(map(len, self.usable))

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def prepare(self) -> Pieces:
        self.cost = {t: -self.score[i] for t, i in self.usable.items()}
        self.pairs = {x for t in self.usable for x in map(operator.add, t, t[1:])}
        back = {v: k for k, v in self.byte.items()}
        self.decoded = [bytes([back[i]]) if i in back else (t.replace(MARK, " ").encode() if self.usable.get(t) == i else (b" \xe2\x81\x87 " if i == self.unknown else None)) for i, t in enumerate(self.text)]
        return self


def load_model(path: str = MODEL) -> Pieces:
    """Piece table of a sentencepiece model file; normalisation must be the identity, with the mark put in front."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("only models without normalisation are supported")
    kind = pb.ModelProto.SentencePiece
    p = Pieces("bpe" if proto.trainer_spec.model_type == 2 else "unigram", [x.piece for x in proto.pieces], [x.score for x in proto.pieces])
    for i, x in enumerate(proto.pieces):
        if x.type in (kind.NORMAL, kind.USER_DEFINED):
            p.usable[x.piece] = i
        elif x.type == kind.BYTE:
            p.byte[int(x.piece[3:5], 16)] = i
        elif x.type == kind.UNKNOWN:
            p.unknown = i
    if any(a != MARK and b == MARK for t in p.usable for a, b in zip(t, t[1:])):
        raise ValueError("a piece reaches over a space")
    return p.prepare()


Edge = Callable[[int, int], int | None]


def merge_borders(n: int, edge: Edge, score: list[float]) -> list[int]:
    """Borders after all merges, by a heap of pairs over a linked list: n log n for units of any length."""
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            found = edge(i, after[j])
            if found is not None:
                heapq.heappush(heap, (-score[found], i, j, after[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if after[i] != j or after[j] != k:
            continue
        after[i], after[j] = k, -1  # j starts no piece any more
        if k < n:
            before[k] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out = [0]
    while out[-1] < n:
        out.append(after[out[-1]])
    return out


def viterbi_borders(n: int, edge: Edge, score: list[float], longest: int, low: float) -> list[int]:
    """Borders of the best path; of equal scores the longest last piece."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, n + 1):
        top = None
        for i in range(max(0, j - longest), j):
            found = edge(i, j)
            cost = score[found] if found is not None else low if j - i == 1 else None
            if cost is not None and (top is None or best[i][0] + cost > top[0]):
                top = (best[i][0] + cost, i)
        best.append(top)
    out = [n]
    while out[-1]:
        out.append(best[out[-1]][1])
    return out[::-1]


def cut(unit: str, pairs: set[str]) -> list[str]:
    """Parts of a unit: no piece reaches over a border between characters that are neighbours in no piece."""
    inside = [*map(pairs.__contains__, map(operator.add, unit, unit[1:]))]
    if all(inside):
        return [unit]
    borders = [0, *(i for i, x in enumerate(inside, 1) if not x), len(unit)]
    return [unit[i:j] for i, j in zip(borders, borders[1:])]


def encode_bpe(unit: str, p: Pieces) -> list[int]:
    """Merge the best-ranked neighbouring pair (leftmost of equals) until none is a piece."""
    score, usable = p.score, p.usable
    if len(unit) <= 32:
        cost, parts = p.cost, list(unit)
        pairs = [cost.get(x + y, _NEVER) for x, y in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < _NEVER:
            i = pairs.index(best)  # the leftmost of equals
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = cost.get(parts[i - 1] + parts[i], _NEVER)
            if i < len(pairs):
                pairs[i] = cost.get(parts[i] + parts[i + 1], _NEVER)
    else:
        borders = merge_borders(len(unit), lambda i, j: usable.get(unit[i:j]), score)
        parts = [unit[i:j] for i, j in zip(borders, borders[1:])]
    out: list[int] = []
    for x in parts:
        found = usable.get(x)
        out += p.fallback(x) if found is None else [found]
    return out


def encode_unigram(unit: str, p: Pieces) -> list[int]:
    """Viterbi over the pieces of a unit; of equal scores the longest last piece."""
    borders = viterbi_borders(len(unit), lambda i, j: p.usable.get(unit[i:j]), p.score, p.longest, lowest(p))
    out: list[int] = []
    for i, j in zip(borders, borders[1:]):
        found = p.usable.get(unit[i:j])
        out += p.fallback(unit[i:j]) if found is None else [found]
    return out


def lowest(p: Pieces) -> float:
    """Score of a character without a piece."""
    return min(p.score[i] for i in p.usable.values()) - 10.0


def encode_unit(unit: str, p: Pieces) -> list[int]:
    return encode_bpe(unit, p) if p.kind == "bpe" else encode_unigram(unit, p)


def units(text: str) -> list[str]:
    return _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def piece_table(spark: SparkSession, p: Pieces) -> DataFrame:
    """(piece, id, rank): the vocabulary as a relation, and the empty piece of first edges; equal scores have equal ranks."""
    rank = {x: r for r, x in enumerate(sorted({p.score[i] for i in p.usable.values()}, reverse=True))}
    return spark.createDataFrame([("", 0, 0), *((t, i, rank[p.score[i]]) for t, i in p.usable.items())], "piece string, id int, rank long")


# Edges are packed: rank, start, end (6 bits each) and id (20 bits), so that they sort by rank, then start.
_START, _END = "cast(shiftright(e, 26) & 63 as int)", "cast(shiftright(e, 20) & 63 as int)"
#: Borders are bits of a long.  An edge whose ends are borders, with one border between, joins two neighbouring pieces;
#: the first such edge is the best.  Edges with an end that is no border any more can't come back.
_MERGES = f"""
aggregate(
  array_repeat(0, n - 1),
  named_struct('borders', shiftleft(1L, n + 1) - 1, 'left', transform(
    filter(edges, e -> {_END} - {_START} > 1),
    e -> named_struct('ends', shiftleft(1L, {_START}) + shiftleft(1L, {_END}), 'inside', shiftleft(1L, {_END}) - shiftleft(2L, {_START})))),
  (s, _) -> if(size(s.left) = 0, s, transform(
    array(get(filter(s.left, e -> bit_count(s.borders & e.inside) = 1), 0)),
    e -> if(e is null, named_struct('borders', s.borders, 'left', slice(s.left, 1, 0)), transform(
      array(s.borders & ~e.inside),
      b -> named_struct('borders', b, 'left', filter(s.left, e -> b & e.ends = e.ends and b & e.inside != 0)))[0]))[0]),
  s -> filter(sequence(0, n), i -> shiftright(s.borders, i) & 1 = 1))
"""


def _viterbi_fold(edges: Column, length: Column, low: float) -> Column:
    """Borders of the best path: (score, start) of the best edge into each node, then back from the last node."""
    start = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i")))

    def step(state: Column, j: Column) -> Column:
        into = F.transform(F.filter(edges, lambda e: e["j"] == j), lambda e: F.struct((F.get(state, e["i"])["s"] + e["score"]).alias("s"), e["i"].alias("i")))
        single = F.array(F.struct((F.get(state, j - 1)["s"] + F.lit(low)).alias("s"), (j - 1).alias("i")))
        every = F.concat(into, F.when(F.exists(edges, lambda e: (e["j"] == j) & (e["i"] == j - 1)), F.slice(single, 1, 0)).otherwise(single))
        best = F.array_max(F.transform(every, lambda x: F.struct(x["s"].alias("s"), (-x["i"]).alias("n"))))
        return F.concat(state, F.array(F.struct(best["s"].alias("s"), (-best["n"]).alias("i"))))

    nodes = F.aggregate(F.sequence(F.lit(1), length), start, step)
    back = F.aggregate(F.sequence(F.lit(1), length), F.array(length), lambda path, _: F.when(F.get(path, F.lit(0)) == 0, path).otherwise(F.concat(F.array(F.get(nodes, F.get(path, F.lit(0)))["i"]), path)))
    return back


def _windows(own: DataFrame, most: int, step: int, p: Pieces) -> DataFrame:
    """Cuts ``body`` into windows of ``step`` starts of pieces, of its first ``most`` starts."""
    first = F.sequence(F.lit(0), F.least(F.char_length("body"), F.lit(most)) - 1, F.lit(step))
    window = lambda b: F.struct((F.col("base") + b).alias("base"), F.substring("body", b + 1, F.lit(step + p.longest - 1)).alias("body"))
    return own.select("key", "n", "row", F.inline(F.transform(first, window)))


def encode_units(distinct: DataFrame, p: Pieces, shares: int | None = None) -> DataFrame:
    """(unit, ids, the other columns) of distinct units: the relational lattice.

    The piece table is broadcast (its size is the vocabulary's), and grouping by
    unit reuses the partitioning by unit.  Long units go by their SHA-256 and in
    windows.  A first edge of no characters keeps units without a piece, and alone
    carries the row.  ``shares`` is the number of partitions: a unit's edges take
    many times its own size, by which Spark would choose it.  Units that already
    lie by a column ``key`` (``unit_key``) stay where they are; it isn't returned.
    """
    if p.longest > SHORT or len(p.text) > 1 << 20:
        raise ValueError("pieces of over 60 characters or over a million pieces")
    spark, columns, bpe = distinct.sparkSession, [c for c in distinct.columns if c != "key"], p.kind == "bpe"
    n, i, j, size, whole = F.col("n"), F.col("i"), F.col("j"), F.char_length("body"), F.char_length("unit")
    if "key" not in distinct.columns:
        distinct = distinct.withColumn("key", F.when(whole <= SHORT, F.col("unit")).otherwise(F.sha2("unit", 256)))
        distinct = distinct.repartition(shares, "key") if shares else distinct.repartition("key")
    own = distinct.where(whole > 0).select("key", whole.alias("n"), F.struct(*columns).alias("row"))
    own = _windows(own.select("*", F.lit(0).alias("base"), F.col("row.unit").alias("body")), 1 << 30, WINDOW * WINDOW, p)
    own = _windows(own, WINDOW * WINDOW, WINDOW, p)  # in two levels, since a substring is found from the text's beginning
    starts = own.select("*", F.explode(F.sequence(F.lit(0), F.least(size, F.lit(WINDOW)) - 1)).alias("i"))
    low, high = F.when(F.col("base") + i == 0, F.lit(0)).otherwise(i + (2 if bpe else 1)), F.least(size, i + p.longest)
    spans = starts.select("*", F.explode(F.when(low <= high, F.sequence(low, high))).alias("j"))
    at = (F.col("base") + i).cast("long")
    place = F.when(n <= SHORT, at * 64 + j).otherwise(at * 64 + (j - i))
    spans = spans.select("key", "n", F.when((at == 0) & (j == 0), F.col("row")).alias("row"), place.alias("place"), F.expr("coalesce(substring(body, i + 1, j - i), '')").alias("piece"))
    edges = spans.join(F.broadcast(piece_table(spark, p)), "piece")
    edge = F.when(n <= SHORT, F.shiftleft("rank", 32)).otherwise(F.lit(0)) + F.shiftleft("place", 20) + F.col("id")
    lattice = edges.groupBy(F.xxhash64("key"), "key").agg(F.first("n").alias("n"), F.first("row", ignorenulls=True).alias("row"), F.sort_array(F.collect_list(edge)).alias("edges"))
    score = F.split(F.lit(",".join(map(repr, p.score))), ",").cast("array<double>")
    apart = lambda e: F.struct(F.shiftright(e, 26).bitwiseAND(F.lit(63)).cast("int").alias("i"), F.shiftright(e, 20).bitwiseAND(F.lit(63)).cast("int").alias("j"), F.get(score, e.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")).alias("score"))
    borders = F.expr(_MERGES) if bpe else _viterbi_fold(F.transform("edges", apart), n, lowest(p))
    folded = lattice.select(F.when(n <= SHORT, borders).alias("__borders"), F.when(n > SHORT, F.col("edges")).alias("__edges"), "row.*")
    shared = spark.sparkContext.broadcast(p)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        get = p.usable.get
        for batch in batches:
            flat, ends = [], [0]
            units = batch.column(2 + columns.index("unit"))
            for borders, edges, unit in zip(batch.column(0).to_pylist(), batch.column(1), units.to_pylist()):
                if borders is None:
                    borders = long_borders(len(unit), edges.values.to_numpy(), p)
                for a, b in zip(borders, borders[1:]):
                    hit = get(unit[a:b])
                    if hit is None:
                        flat += p.fallback(unit[a:b])
                    else:
                        flat.append(hit)
                ends.append(len(flat))
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([found, *batch.columns[2:]], ["ids", *columns])

    return folded.mapInArrow(ids, StructType([StructField("ids", ArrayType(IntegerType())), *(distinct.schema[c] for c in columns)]))


def long_borders(n: int, edges: np.ndarray, p: Pieces) -> list[int]:
    """The fold of a long unit's edges, whose low 20 bits are the id, above 6 bits of length and the start."""
    get = dict(zip((edges >> 20).tolist(), (edges & ((1 << 20) - 1)).tolist())).get
    longest = p.longest
    edge = lambda i, j: get(i << 6 | j - i) if j - i <= longest else None
    return merge_borders(n, edge, p.score) if p.kind == "bpe" else viterbi_borders(n, edge, p.score, longest, lowest(p))


def unit_key(unit: str) -> str:
    """The unit, or the SHA-256 of a long one."""
    return unit if len(unit) <= SHORT else hashlib.sha256(unit.encode()).hexdigest()


def _release() -> None:
    """Gives freed memory back to the system: a worker is used again, and would keep the most it ever took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _newest(x: np.ndarray, known: int) -> np.ndarray:
    """Numbers given in order of appearance, each raised by one; 0 where a number from ``known`` on appears first."""
    top = np.maximum.accumulate(x)
    top[1:], top[:1] = top[:-1].copy(), -1
    return np.where((x >= known) & (x > top), np.int32(0), x + np.int32(1))


def _numbers(x: np.ndarray, known: int) -> np.ndarray:
    """Undoes ``_newest``."""
    first = x == 0
    return np.where(first, np.cumsum(first, dtype=np.int32) + np.int32(known - 1), x - np.int32(1))


def _planes(x: np.ndarray) -> np.ndarray:
    """All first bytes of some int32, then all second bytes and so on: compresses better."""
    return np.ascontiguousarray(x, np.int32).view(np.uint8).reshape(-1, 4).T.ravel()


def _joined(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(4, -1).T).view(np.int32).ravel()


def _ends(size: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Elements of [start, start + size), range after range."""
    ends = _ends(size)
    return np.repeat(start - ends[:-1], size) + np.arange(ends[-1])


class _Cutter:
    """``cut`` for many units at once: the pairs as a matrix over the characters in them."""

    def __init__(self, pairs: set[str]) -> None:
        chars = sorted({ord(c) for x in pairs for c in x})
        self.number = np.zeros(0x110000, np.int32)  # 0: in no pair
        self.number[chars] = np.arange(1, len(chars) + 1)
        self.inside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        first, second = (self.number[[ord(x[i]) for x in pairs]] for i in (0, 1))
        self.inside[first, second] = True

    def __call__(self, words: list[str]) -> tuple[Iterator[str], np.ndarray]:
        """All parts of units, given without their first mark, and how many each unit has."""
        text, ends = MARK + MARK.join(words), _ends(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        char = self.number[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        border = np.ones(ends[-1] + 1, bool)
        border[1:-1] = ~self.inside[char[:-1], char[1:]][: len(border) - 2]
        border[ends] = True
        at = np.flatnonzero(border)
        return (text[i:j] for i, j in pairwise(at.tolist())), np.diff(np.searchsorted(at, ends))


_BLOCK = pa.schema([("parts", pa.string()), ("lengths", pa.list_(pa.uint8())), ("doc_id", pa.list_(pa.int64())), *((x, pa.list_(pa.uint8())) for x in ("n_units", "units", "n_parts", "cuts"))])
#: Words cut at once.
CUT = 1 << 15


class _Block:
    """Documents as numbers of units: first those of the table, then the block's own, whose parts are numbered likewise."""

    def __init__(self, table: dict[str, int], marked: dict[str, int]) -> None:
        self.known, self.marked = len(table), marked
        self.number = defaultdict(count(self.known).__next__, table)
        self.units, self.n_units, self.doc_id, self.n_bytes = array("i"), array("i"), [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        before = len(self.units)
        self.units.extend(map(self.number.__getitem__, _words(text)))
        self.n_units.append(len(self.units) - before)
        self.doc_id.append(doc_id)
        self.n_bytes += len(text)

    def row(self, cutter: _Cutter) -> pa.RecordBatch:
        """(block, body)."""
        number = defaultdict(count(self.known).__next__, self.marked)
        words, cuts, n_parts = list(self.number)[self.known :], array("i"), []
        self.number.clear()
        for first in range(0, len(words), CUT):
            parts, n = cutter(words[first : first + CUT])
            cuts.extend(map(number.__getitem__, parts))
            n_parts.append(n)
        del words
        parts = list(number)[self.known :]
        del number
        numbers = {"lengths": np.fromiter(map(len, parts), np.int32, len(parts)), "n_units": np.frombuffer(self.n_units, np.int32), "units": _newest(np.frombuffer(self.units, np.int32), self.known)}
        numbers |= {"n_parts": np.concatenate([np.zeros(0, np.int32), *n_parts]), "cuts": _newest(np.frombuffer(cuts, np.int32), self.known)}
        lists = {"doc_id": pa.array(self.doc_id, pa.int64()), **{k: pa.array(_planes(x)) for k, x in numbers.items()}}
        lists = {k: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for k, x in lists.items()}
        lists["parts"] = pa.array(["".join(parts)], pa.string())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _BLOCK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(pa.RecordBatch.from_arrays([lists[x] for x in _BLOCK.names], schema=_BLOCK))
        body = sink.getvalue().to_pybytes()
        block = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), signed=True)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([body], pa.binary())], ["block", "body"])


def _opened(body: pa.Scalar, *names: str) -> list[pa.Array]:
    """Columns of a block's body."""
    options = pa.ipc.IpcReadOptions(included_fields=[_BLOCK.get_field_index(x) for x in names])
    batch = pa.ipc.open_stream(body.as_buffer(), options=options).read_next_batch()
    return [batch.column(x) if x == "parts" else batch.column(x).flatten() for x in names]


def _words(text: str) -> list[str]:
    """Units of a text, each without its first mark."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
        return [u[1:] for u in units(text)]
    return text.split(" ")


def frequent_units(docs: DataFrame, most: int = TABLE_UNITS) -> DataFrame:
    """(unit, n): at most ``most`` of the units that occur most, with how often, those above the lowest power of two that keeps the bound.

    Every task counts its whole texts and drops rare units as they overflow; the
    threshold comes from a histogram of the counts, so nothing is sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                count.update(_words(text.as_py() or ""))
                if len(count) > MEMORY:  # lossy counting: what is left is still the frequent part
                    count = Counter({u: n for u, n in count.items() if n > 2})
        rows = [(MARK + u, n) for u, n in count.most_common(most) if n > 2 and len(u) < LONG]
        del count
        _release()
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["unit", "n"])

    counts = docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counts = _store.materialize(counts.withColumn("level", F.floor(F.log2("n")).cast("int")), "unit-counts")
    least, total = 0, 0
    for row in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r.level):  # at most 64 rows
        total += row["count"]
        if total > most:
            least = row.level + 1
            break
    return counts.where(F.col("level") >= least).select("unit", "n")


def encode(docs: DataFrame, model: str = MODEL, table_units: int = TABLE_UNITS) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    spark, limit = docs.sparkSession, BLOCK_BYTES
    p = load_model(model)
    lattice = encode_units(frequent_units(docs, table_units), p)
    frequent = sorted(((-r.n, r.unit[1:], r.ids) for r in lattice.toLocalIterator()))  # at most table_units rows
    table = {unit: k for k, (_, unit, _) in enumerate(frequent)}
    table_size = np.array([len(x) for _, _, x in frequent], np.int64)
    table_ids = np.array([i for _, _, x in frequent for i in x], np.int32)
    shared = spark.sparkContext.broadcast((table, p.pairs))
    shared_ids = spark.sparkContext.broadcast((table_size, table_ids))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shares = n_bytes // (8 << 20) + 1

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pairs = shared.value
        marked, cutter = {MARK + x: k for x, k in table.items()}, _Cutter(pairs)
        block = _Block(table, marked)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc_id, text.as_py())
                if block.n_bytes >= limit:
                    yield block.row(cutter)
                    block = _Block(table, marked)
                    _release()
        if block.doc_id:
            yield block.row(cutter)
        del block
        _release()

    blocks = docs.mapInArrow(numbered, "block long, body binary").repartition(shares, "block")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                text, lengths = _opened(body, "parts", "lengths")
                text, ends = text[0].as_py(), _ends(_joined(lengths.to_numpy()))
                for first in range(0, len(ends) - 1, CUT):
                    some = [text[i:j] for i, j in pairwise(ends[first : first + CUT + 1].tolist())]
                    keys = [*map(unit_key, some)]
                    whole = [None if x is k else x for x, k in zip(some, keys)]
                    own = pa.array([block] * len(some), pa.int64()), pa.array(range(first, first + len(some)), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(whole, pa.string()), *own], ["key", "whole", "block", "place"])

    rest = blocks.mapInArrow(listed, "key string, whole string, block long, place int").repartition(shares, "key")
    rest = rest.groupBy("key").agg(F.coalesce(F.first("whole", ignorenulls=True), F.col("key")).alias("unit"), F.collect_list(F.struct("block", "place")).alias("at"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block, with steps between places of its parts, their numbers of ids and the ids."""
        held: list[tuple[np.ndarray, ...]] = []

        def hand_on() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            block, place, size, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((place, block))
            ids, block, place, size = ids[_ranges(_ends(size)[:-1][order], size[order])], block[order], place[order], size[order]
            at = np.concatenate((np.flatnonzero(np.diff(block, prepend=~block[:1])), [len(block)]))
            ends = _ends(size)
            rows = [(np.diff(place[a:b], prepend=np.int32(0)), size[a:b], ids[ends[a] : ends[b]]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(block[at[:-1]]), *(pa.array([_planes(x).tobytes() for x in xs], pa.binary()) for xs in zip(*rows))], ["block", "place", "size", "ids"])

        for batch in batches:
            own, n_ids = (pa.compute.list_value_length(batch.column(i)).to_numpy() for i in (2, 0))
            at, row = batch.column(2).flatten(), np.repeat(np.arange(len(own)), own)
            size, flat = n_ids[row].astype(np.int64), batch.column(0).flatten().to_numpy()
            held.append((at.field(0).to_numpy(), at.field(1).to_numpy(), size, flat[_ranges(_ends(n_ids)[:-1][row], size)]))
            if sum(len(x[0]) for x in held) > 5 * MEMORY:
                yield from hand_on()
        yield from hand_on()

    coded = encode_units(rest, p).mapInArrow(dealt, "block long, place binary, size binary, ids binary").repartition(shares, "block")

    def assemble(own: pa.Table, coded: pa.Table) -> pa.Table:
        known, pool = shared_ids.value
        steps, n_ids, ids = ([_joined(np.frombuffer(x.as_buffer(), np.uint8)) for x in coded.column(k)] for k in (1, 2, 3))
        place, n_ids, ids = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (map(np.cumsum, steps), n_ids, ids))
        place, part_ids, out = place.astype(np.int64), np.concatenate((pool, ids)), []
        for body in own.column(1):
            n_parts, lengths, cuts, doc_ids, n_units, units = _opened(body, "n_parts", "lengths", "cuts", "doc_id", "n_units", "units")
            n_parts, lengths, cuts, n_units, units = (_joined(x.to_numpy()) for x in (n_parts, lengths, cuts, n_units, units))
            units, cuts = _numbers(units, len(known)), _numbers(cuts, len(known))
            size = np.concatenate((known, np.full(len(lengths), -1)))
            size[len(known) + place] = n_ids
            if (size < 0).any():
                raise RuntimeError("parts of a block have no ids; was it read in another order?")
            start = np.concatenate((_ends(known)[:-1], np.zeros(len(lengths), np.int64)))
            start[len(known) + place] = len(pool) + _ends(n_ids)[:-1]
            # from parts to units, then to documents
            of_part = size[cuts]
            ids = np.concatenate((pool, part_ids[_ranges(start[cuts], of_part)]))
            size = np.concatenate((known, np.diff(_ends(of_part)[_ends(n_parts)])))
            start, first = _ends(size)[:-1], _ends(n_units)
            for a, b in tx.slices(first * 4):
                some = units[first[a] : first[b]]
                own_size = size[some]
                ends = _ends(own_size)[first[a : b + 1] - first[a]]
                out.append(pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[_ranges(start[some], own_size)]))], ["doc_id", "ids"]))
        _release()
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return blocks.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assemble, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds ``text`` to rows with ``ids`` (kept: doc_id and ids): gathers the bytes of all pieces at once."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_model(model).decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [x or b"" for x in shared.value]
        blob = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(x) for x in pieces])
        start = np.cumsum(size) - size
        for batch in batches:
            count = pa.compute.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(count)))
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            for a, b in tx.slices(at * 4):
                ids = flat[at[a] : at[b]]
                if len(ids) and (ids.min() < 0 or ids.max() >= len(pieces)):
                    raise IndexError("an id isn't in the vocabulary")
                n = size[ids]
                ends = np.concatenate(([0], np.cumsum(n)))
                place = np.repeat(start[ids] - ends[:-1], n)
                place += np.arange(ends[-1])
                raw = blob[place].tobytes()
                bounds = ends[at[a : b + 1] - at[a]].tolist()
                parts = (raw[x:y] for x, y in zip(bounds, bounds[1:]))
                texts = [(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def sentencepiece_query(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_hash (xxhash64 of the ids) and text_sha256 of the text decoded from the ids."""
    out = decode(encode(docs, model), model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.sha2("text", 256).alias("text_sha256"))


def sentencepiece_stage(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids of every document."""
    return encode(docs, model)
