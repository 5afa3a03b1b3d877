"""Content-chosen segments: what lets equal windows of many documents meet without shipping every suffix.

A *window* is ``length`` consecutive elements (bytes, or words by hash) of one
document.  Each window picks its *anchor*: the leftmost of its k-element grams
with the smallest hash.  Equal windows pick equal anchors at equal places, so
only windows with equal anchor keys have to be compared, and a window whose
anchor key occurs once in the corpus has no equal.  Consecutive windows mostly
share an anchor; a *segment* is a run of such windows: the text [lo, hi + length).

``occurrences`` finds the segments of all documents.  ``contexts`` splits them
by anchor key:

* keys that occur once: dropped, none of their windows repeats;
* keys whose segments are all equal (*pure*): decided by a count and a minimum;
* the other keys (*mixed*): their distinct segments, the *contexts*, go to the
  suffix sorter or suffix tree, in groups of bounded size; a key with more than
  ``GROUP`` contexts is split further by longer and longer keys, down to the whole
  window, so that no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _store
from tessera.llm import _text as tx

#: Most contexts of one anchor key that are sorted together.
GROUP = 512
#: Windows of a document looked at at once; longer documents are taken in pieces that overlap by length - 1.
PIECE = 1 << 20
_PLACE = 24  # bits of a packed anchor that hold its place; 40 bits of hash


@dataclass(frozen=True)
class Plan:
    """How windows are chosen: their length, and the length of an anchor gram."""

    length: int
    gram: int
    words: bool

    def values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements of some documents (bytes, or words as 64-bit hashes) and the n + 1 offsets of these."""
        if not self.words:
            return data, offsets
        w = tx.Words(data, offsets)
        return w.hashes(), np.append(w.first, len(w.start))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """What ``range_hash`` takes for these elements."""
        return tx.prefix_sums(values) if self.words else tx.byte_sums(values)


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: block-wise running minima from both sides."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    block = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    block[: len(x)] = x
    block = block.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def find_segments(values: np.ndarray, offsets: np.ndarray, plan: Plan) -> dict[str, np.ndarray]:
    """Segments of documents given by elements and offsets: doc, lo, run (windows), at (anchor - lo), key, ctx."""
    found: list[list[np.ndarray]] = []
    lengths = np.diff(offsets)
    pieces: list[tuple[int, int, int, int]] = []  # first and last document, start and end of elements
    first = 0
    while first < len(lengths):
        if lengths[first] > PIECE + plan.length:
            for lo in range(0, lengths[first] - plan.length + 1, PIECE):
                pieces.append((first, first + 1, offsets[first] + lo, min(offsets[first + 1], offsets[first] + lo + PIECE + plan.length - 1)))
            first += 1
            continue
        last = first + 1
        while last < len(lengths) and offsets[last + 1] - offsets[first] <= PIECE + plan.length:
            last += 1
        pieces.append((first, last, offsets[first], offsets[last]))
        first = last
    for a, b, start, end in pieces:
        n = int(end - start)
        if n < plan.length:
            continue
        own = values[start:end]
        sums = plan.sums(own)
        grams = np.arange(n - plan.gram + 1)
        key = tx.range_hash(sums, grams, grams + plan.gram) if plan.words else tx.gram_order(own, plan.gram)
        packed = (key & ~np.uint64((1 << _PLACE) - 1)) | grams.astype(np.uint64)
        anchor = (_sliding_minimum(packed, plan.length - plan.gram + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        doc = np.searchsorted(offsets[a + 1 : b + 1] - start, np.arange(n), "right")
        inside = doc[: n - plan.length + 1] == doc[plan.length - 1 :]
        change = np.ones(len(inside), bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1 : len(inside)] != doc[: len(inside) - 1]) | (inside[1:] != inside[:-1])
        lo = np.flatnonzero(change)
        end_ = np.append(lo[1:], len(inside))
        lo, end_ = lo[inside[lo]], end_[inside[lo]]
        place = anchor[lo]
        shape = ((place - lo) * 4096 + (end_ - lo)).astype(np.uint64)
        ctx = tx.range_hash(sums, lo, end_ - 1 + plan.length) ^ tx.mix(shape + np.uint64(1))
        found.append([doc[lo] + a, lo + start - offsets[doc[lo] + a], end_ - lo, place - lo, key[place], ctx])
    names = ("doc", "lo", "run", "at", "key", "ctx")
    if not found:
        return {n: np.zeros(0, np.uint64 if n in ("key", "ctx") else np.int64) for n in names}
    return {n: np.concatenate(c) for n, c in zip(names, zip(*found, strict=True), strict=True)}


def pack(lo: np.ndarray, run: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One long: 40 bits lo, 12 bits run, 12 bits at."""
    return (lo << 24) | (run << 12) | at


def unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> 24, (x >> 12) & 4095, x & 4095


def with_row(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): ``row`` identifies a document by its id and text, also where rows share an id or have none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id"), text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def occurrences(docs: DataFrame, plan: Plan) -> DataFrame:
    """(key, ctx, place, row, doc_id) of every segment of every document; no shuffle.  doc_id only if the plan is over words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            data, offsets = tx.text_buffers(batch.column(0))
            for a, b in tx.slices(offsets):
                own, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                s = find_segments(*plan.values(own, off), plan)
                columns = (tx.signed(s["key"]), tx.signed(s["ctx"]), pack(s["lo"], s["run"], s["at"]), *(i[a + s["doc"]] for i in ids))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = ["key", "ctx", "place", "row", *["doc_id"] * plan.words]
    docs = docs.where("doc_id is not null") if plan.words else docs
    return docs.select("text", *names[3:]).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def contexts(docs: DataFrame, plan: Plan, tag: str) -> tuple[DataFrame, DataFrame]:
    """(occurrences of keys that repeat, with ``mixed`` and ``key_least``; the distinct contexts of mixed keys).

    A context row: key, ctx, n (occurrences), least (smallest doc_id), n_ctx (of
    its key), and one place: row, place.
    """
    every = occurrences(docs, plan)
    least = F.min("doc_id") if plan.words else F.lit(0).cast("long")
    keys = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"), least.alias("key_least"))
    # written, so that the join below has an exchange on both sides and a hot key can be split
    keys = _store.materialize(keys.where("n > 1").select("key", (F.col("c0") != F.col("c1")).alias("mixed"), "key_least"), f"{tag}-keys")
    repeated = _store.materialize(every.join(keys, "key"), f"{tag}-repeated")
    distinct = repeated.where("mixed").groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), least.alias("least"), F.min(F.struct("row", "place")).alias("one"))
    distinct = _store.materialize(distinct.select("key", "ctx", "n", "least", "one.row", "one.place"), f"{tag}-contexts")
    sizes = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n_ctx"))
    return repeated, distinct.join(_store.materialize(sizes, f"{tag}-sizes"), "key")


CONTEXT = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("n_ctx", pa.int64()), ("run", pa.int64()), ("at", pa.int64()), ("body", pa.binary())])
CONTEXT_DDL = "key long, ctx long, n long, least long, n_ctx long, run long, at long, body binary"


def cut_contexts(docs: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """Context rows with ``body``: the elements of their windows (bytes; words as 64-bit hashes) from a document that holds them."""
    rows = wanted.groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("key", "ctx", "n", "least", "n_ctx", "place")).alias("rows"))
    joined = docs.join(rows, F.col("row") == F.col("__row")).select("text", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.text_buffers(batch.column(0))
            for i in range(batch.num_rows):
                flat = batch.column(1)[i].values.flatten()
                lo, n_run, at = unpack(flat[5].to_numpy(zero_copy_only=False))
                text = data[offsets[i] : offsets[i + 1]]
                items = np.ascontiguousarray(plan.values(text, np.array([0, len(text)]))[0]) if plan.words else text
                bodies = [items[x : x + r + plan.length - 1].tobytes() for x, r in zip(lo.tolist(), n_run.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*flat[:5], pa.array(n_run), pa.array(at), pa.array(bodies, pa.binary())], schema=CONTEXT)

    return joined.mapInArrow(run, CONTEXT_DDL)


def solve(bodies: DataFrame, plan: Plan, sort_shard: Callable[[list[bytes], np.ndarray], np.ndarray], shard_bytes: int, steps: tuple[int, ...] = (16, 4, 1)) -> DataFrame:
    """(key, ctx, parts) where parts are runs (from, to, total, least) of windows: occurrences in all, and smallest doc_id.

    ``sort_shard(bodies, runs)`` gives a class number for each window of a shard's
    contexts, one after the other; equal windows have equal numbers.  A shard
    holds whole anchor keys and about ``shard_bytes``.  Contexts of a key that has
    too many are cut into parts of ``steps[0]`` windows, whose key is all that
    these windows share: a longer prefix.  Parts that have no like are dropped,
    equal ones are summed, and the rest is solved in the same way, with shorter
    parts; a part of one window is its own key.
    """
    out = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("parts", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("total", pa.int64()), ("least", pa.int64())])))])
    ddl = "key long, ctx long, parts array<struct<a: int, b: int, total: long, least: long>>"

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        n, least, run, ctx_key = (table[c].to_numpy() for c in ("n", "least", "run", "key"))
        bodies_ = table["body"].to_pylist()
        number = sort_shard(bodies_, run)
        owner = np.repeat(np.arange(len(run)), run)
        total = np.zeros(number.max() + 1, np.int64)
        np.add.at(total, number, n[owner])
        low = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, number, least[owner])
        total, low = total[number], low[number]
        starts = np.cumsum(run) - run
        head = np.ones(len(number), bool)
        head[1:] = (total[1:] != total[:-1]) | (low[1:] != low[:-1])
        head[starts] = True
        first = np.flatnonzero(head)
        end = np.append(first[1:], len(number))
        own = owner[first]
        parts = pa.StructArray.from_arrays([pa.array((first - starts[own]).astype(np.int32)), pa.array((end - starts[own]).astype(np.int32)), pa.array(total[first]), pa.array(low[first])], fields=list(out.field("parts").type.value_type))
        offsets = np.append(np.searchsorted(own, np.arange(len(run))), len(own)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ctx_key), table["ctx"].combine_chunks() if table["ctx"].num_chunks != 1 else table["ctx"].chunk(0), pa.ListArray.from_arrays(pa.array(offsets), parts)], schema=out)

    def run_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            weight = np.cumsum(pa.compute.binary_length(batch.column(7)).to_numpy(zero_copy_only=False))
            begin = 0
            change = np.flatnonzero(np.concatenate(([last is not None and len(keys) and keys[0] != last], keys[1:] != keys[:-1])))
            for cut in change.tolist():
                so_far = size + int(weight[cut - 1] if cut else 0) - int(weight[begin - 1] if begin else 0)
                if so_far >= shard_bytes:
                    if cut > begin:
                        held.append(batch.slice(begin, cut - begin))
                    if held:
                        yield flush(held)
                    held, size, begin = [], 0, cut
            if len(keys):
                held.append(batch.slice(begin))
                size += int(weight[-1]) - int(weight[begin - 1] if begin else 0)
                last = keys[-1]
        if held:
            yield flush(held)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, length = steps[0], plan.length
        for batch in batches:
            key, ctx, n, least, _, run, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:7])
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column(7)[i].as_buffer(), np.uint64 if plan.words else np.uint8)
                sums = plan.sums(raw)
                part = (at[i] - np.arange(run[i])) // step  # windows by the distance of their anchor
                first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                count = np.diff(np.append(first, run[i]))
                shared = at[i] - step * part[first]  # what all windows of a part cover, whether or not they are here
                inner = tx.range_hash(sums, shared, shared - (step - 1) + length) ^ tx.mix(key[i : i + 1].view(np.uint64) + part[first].astype(np.uint64))
                whole = tx.range_hash(sums, first, first + count - 1 + length) ^ tx.mix(((at[i] - first) * 4096 + count).astype(np.uint64))
                fill = lambda x: pa.array(np.full(len(first), x))  # noqa: B023, E731
                cut = [raw[f : f + c - 1 + length].tobytes() if step > 1 else b"" for f, c in zip(first.tolist(), count.tolist(), strict=True)]
                columns = (fill(key[i]), fill(ctx[i]), pa.array(first), pa.array(tx.signed(inner)), pa.array(tx.signed(whole)), fill(n[i]), fill(least[i]), pa.array(count), pa.array(at[i] - first), pa.array(cut, pa.binary()))
                yield pa.RecordBatch.from_arrays(list(columns), ["key", "ctx", "j", "k2", "c2", "n", "least", "run", "at", "body"])

    spark = bodies.sparkSession
    small, hot = bodies.where(F.col("n_ctx") <= GROUP), bodies.where(F.col("n_ctx") > GROUP)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sharded = small.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run_shards, ddl)
    if not steps or not hot.take(1):
        return sharded
    pieces = _store.materialize(hot.mapInArrow(split, "key long, ctx long, j long, k2 long, c2 long, n long, least long, run long, at long, body binary"), "pieces")
    distinct = pieces.groupBy("k2", "c2").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.first("run").alias("run"), F.first("at").alias("at"), F.first("body").alias("body"))
    distinct = _store.materialize(distinct, "distinct-pieces")
    joined = distinct.join(_store.materialize(distinct.groupBy("k2").agg(F.count(F.lit(1)).alias("n_ctx")), "piece-sizes"), "k2")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("run").cast("int").alias("b"), F.col("n").alias("total"), "least"))
    alone = joined.where("n_ctx = 1 and n > 1").select("k2", "c2", whole.alias("parts"))
    mixed = _store.materialize(joined.where("n_ctx > 1").select(F.col("k2").alias("key"), F.col("c2").alias("ctx"), *CONTEXT.names[2:]), "mixed-pieces")
    again = solve(mixed, plan, sort_shard, shard_bytes, steps[1:]).select(F.col("key").alias("k2"), F.col("ctx").alias("c2"), F.filter("parts", lambda p: p["total"] > 1).alias("parts"))
    solved = _store.materialize(alone.unionByName(again.where(F.size("parts") > 0)), "solved-pieces")
    j = F.col("j").cast("int")
    moved = F.transform("parts", lambda p: F.struct((p["a"] + j).alias("a"), (p["b"] + j).alias("b"), p["total"].alias("total"), p["least"].alias("least")))
    back = pieces.select("key", "ctx", "j", "k2", "c2").join(solved, ["k2", "c2"]).select("key", "ctx", moved.alias("parts"))
    return sharded.unionByName(back.groupBy("key", "ctx").agg(F.flatten(F.collect_list("parts")).alias("parts")))


def removals(docs: DataFrame, plan: Plan, tag: str, sort_shard: Callable[[list[bytes], np.ndarray], np.ndarray], shard_bytes: int) -> DataFrame:
    """(row, doc_id, text, spans): spans are the element ranges, packed as start << 12 | windows - 1, that repeated windows start in."""
    repeated, wanted = contexts(docs, plan, tag)
    bodies = _store.materialize(cut_contexts(docs, wanted, plan), f"{tag}-bodies")
    solved = solve(bodies, plan, sort_shard, shard_bytes)
    hit = (lambda total, least: least < F.col("doc_id")) if plan.words else (lambda total, least: total > 1)
    solved = solved.select("key", "ctx", F.filter("parts", lambda p: p["total"] > 1).alias("parts"))
    solved = _store.materialize(solved.where(F.size("parts") > 0), f"{tag}-solved")
    lo, run = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(F.lit(4095))
    span = lambda start, n: F.shiftleft(start, 12).bitwiseOR(n - 1)
    pure = repeated.where(~F.col("mixed")).where(F.col("key_least") < F.col("doc_id") if plan.words else F.lit(True)).select("row", F.array(span(lo, run)).alias("s"))
    mixed = repeated.where("mixed").join(solved, ["key", "ctx"])
    mixed = mixed.select("row", F.transform(F.filter("parts", lambda p: hit(p["total"], p["least"])), lambda p: span(lo + p["a"], (p["b"] - p["a"]).cast("long"))).alias("s")).where(F.size("s") > 0)
    by_row = pure.unionByName(mixed).groupBy(F.col("row").alias("__row")).agg(F.flatten(F.collect_set("s")).alias("spans"))
    return docs.join(by_row, F.col("row") == F.col("__row"), "left").drop("__row")


def span_mask(length: int, spans: np.ndarray, window: int) -> np.ndarray:
    """Mask of the elements that the windows of packed spans cover."""
    start = spans >> 12
    return tx.covered(length, start, start + (spans & 4095) + window)
