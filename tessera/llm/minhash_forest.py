"""Near-duplicate documents by an LSH forest of MinHash signatures.

A document is the set of its distinct 5-word shingles (A-Z in lower case, words
``[^\\x20\\x09-\\x0D]+``); a text of fewer words is one shingle.  Documents whose
Jaccard similarity is at least ``percent`` / 100 are linked; the answer is the
connected component of each.

1. Equal sets are one *class*, found by a 128-bit set fingerprint with partial
   sums; only the row with its smallest doc_id goes on.
2. Each of ``TREES`` trees sorts the classes by its own signature of ``DEPTH``
   minima.  A region is the classes that share the first ``SHALLOW`` minima.  In a
   region of at most ``REGION`` classes all pairs are candidates; in a crowded one
   each class meets its ``NEIGHBOURS`` next in the sorted order, those with the
   longest common prefixes: depth adapts to how crowded a region is.
3. Pairs whose signatures agree too little to reach the threshold (5 standard
   deviations) are dropped; first each class's most similar pair is verified on
   full sets, then every pair that still crosses two components.
4. Neighbours only save work.  In crowded regions central classes meet all
   others, and then every class outside a region's largest component is compared
   with the rest of the region on full sets (``_crowds``): linear for dense groups and stars, quadratic, in blocks, for
   crowded classes that stay unlinked.  So a link is missed only if its classes
   share no region of any tree (0.00001 for a pair just at 85 %) or by the bound
   of 5 standard deviations.
5. Components by repeated minimum labels with pointer jumping, as DataFrames.

Nothing is collected to the driver but counts that end the loops.

Defined results: a null or empty text has no shingles and is linked with
nothing; rows are linked by their own texts, also where they share a doc_id, and
a component is named by the smallest doc_id in it; a null doc_id is returned
with a null component; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _store
from tessera.llm import _text as tx
from tessera.llm._rows import packed, row_hash, same_row, without

TREES, SHALLOW, DEPTH = 16, 4, 10
_REST = [f"r{k}" for k in range(SHALLOW + 1, DEPTH + 1)]
#: Classes of a region that gives all its pairs at once; neighbours that a class of a larger one meets in each tree's order.
REGION, NEIGHBOURS = 24, 6
#: About how many classes and shingles of a crowded region meet at a time, on either side, and how many shingles are compared at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 1 << 18, 4096
SHINGLE, PERCENT = 5, 85
#: The threshold of a pipeline's stage; the contract's 85 is the query's alone.
STAGE_PERCENT = 80
_rng = np.random.default_rng(8)
_FACTOR = _rng.integers(0, 1 << 62, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 62, TREES * DEPTH, dtype=np.uint64)


def shingle_sets(words: tx.Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, sorted within each document, and their n_docs + 1 offsets."""
    values = words.hashes(lower=True)
    gram, at = tx.ngram_hashes(values, words.doc, n)
    doc = words.doc[at]
    few = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(few):
        whole = tx.range_hash(tx.prefix_sums(values), words.first[few], words.first[few] + words.count[few])
        gram, doc = np.concatenate((gram, whole)), np.concatenate((doc, few))
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[new], doc[new]
    return gram, np.searchsorted(doc, np.arange(len(words.count) + 1))


def signature(shingles: np.ndarray) -> bytes:
    """The low 16 bits of TREES x DEPTH minima of 32 bits: all low bytes, then all high bytes.

    Fewer bits let two different minima agree with a chance of 1 in 65536, which
    can add candidates and never loses one.
    """
    out = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(shingles), 512):
        part = shingles[i : i + 512, None] * _FACTOR + _SHIFT
        np.minimum(out, (part >> np.uint64(32)).astype(np.uint32).min(axis=0), out=out)
    return out.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, f1, f2, sig): set size, set fingerprint, and the signature as binary (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.text_buffers(batch.column(2))
            for a, b in tx.slices(offsets):
                own, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                gram, at = shingle_sets(tx.Words(own, off))
                count = np.diff(at)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(tx.mix(gram ^ np.uint64(seed)), dtype=np.uint64))) for seed in (0x1234567, 0x89ABCDEF01)]
                f1, f2 = (tx.mix((s[at[1:]] - s[at[:-1]]) + count.astype(np.uint64)) for s in sums)
                sigs = [signature(gram[at[i] : at[i + 1]]) if count[i] else None for i in range(b - a)]
                columns = (*(batch.column(i).slice(a, b - a) for i in (0, 1)), *map(pa.array, (count, tx.signed(f1), tx.signed(f2))), pa.array(sigs, pa.binary()))
                yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "row", "n_shingles", "f1", "f2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(F.col("text")).alias("row"), "text").mapInArrow(run, "doc_id long, row long, n_shingles long, f1 long, f2 long, sig binary")


def _tree_rows(classes: DataFrame) -> DataFrame:
    """(rep, key, r{SHALLOW + 1} .. r{DEPTH}): one row for each class and tree.

    key is a hash of the tree and its first SHALLOW minima, r_k its k-th minimum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column(0).to_numpy(zero_copy_only=False)
            raw = _minima(batch.column(1))
            minima = [pa.array(np.ascontiguousarray(raw[:, :, k]).ravel().view(np.int16)) for k in range(SHALLOW, DEPTH)]
            columns = (pa.array(np.repeat(rep, TREES)), pa.array(tx.signed(_region_keys(raw).ravel())), *minima)
            yield pa.RecordBatch.from_arrays(list(columns), ["rep", "key", *_REST])

    return classes.select("rep", "sig").mapInArrow(run, "rep long, key long, " + ", ".join(f"{r} short" for r in _REST))


def _minima(signatures: pa.Array) -> np.ndarray:
    """Minima of signatures as (class, tree, depth)."""
    halves = np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, 2, TREES, DEPTH).astype(np.uint16)
    return halves[:, 0] | (halves[:, 1] << np.uint16(8))


def _region_keys(minima: np.ndarray) -> np.ndarray:
    """A hash of the tree and its first SHALLOW minima, for each class and tree."""
    h = np.tile(np.arange(1, TREES + 1, dtype=np.uint64), (len(minima), 1))
    for k in range(SHALLOW):
        h = tx.mix(h * np.uint64(0x9E3779B97F4A7C15) + minima[:, :, k] + np.uint64(k + 1))
    return h


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each row with the next NEIGHBOURS rows of its region, from rows in the order of their signatures."""
    tail_key, tail_rep = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key, rep = (np.concatenate((t, c.to_numpy(zero_copy_only=False))) for t, c in zip((tail_key, tail_rep), batch.columns, strict=True))
        for step in range(1, NEIGHBOURS + 1):
            x, y = rep[:-step], rep[step:]
            near = (key[:-step] == key[step:]) & (np.arange(len(x)) + step >= len(tail_key))
            x, y = x[near], y[near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
        tail_key, tail_rep = key[-NEIGHBOURS:], rep[-NEIGHBOURS:]


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Distinct candidate pairs (a < b) of classes; (rep, key, size) of the crowded regions' classes, if any.

    A region of at most REGION classes gives all its pairs.  Crowded regions are
    put in the order of the whole signature by a range partitioning that may cut
    a region anywhere, and each class meets its next NEIGHBOURS in that order:
    those with the longest common prefixes.  The other pairs of a crowded region
    are left to ``_crowds``.
    """
    rows = _store.materialize(_tree_rows(classes), "forest")
    sizes = _store.materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "regions")
    fit = rows.select("key", "rep").join(sizes.where(F.col("size") <= REGION).select("key"), "key")
    members = fit.groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("m"))
    each = F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = members.select(F.explode(F.flatten(each)).alias("p")).select("p.a", "p.b")
    crowded = sizes.where(F.col("size") > REGION)
    if not crowded.take(1):
        return pairs.distinct(), None
    crowded = _store.materialize(rows.join(crowded, "key"), "crowded")
    order = ["key", *_REST, "rep"]
    n = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = crowded.repartitionByRange(n, *order).sortWithinPartitions(*order)
    near = ordered.select("key", "rep").mapInArrow(_neighbours, "a long, b long")
    return pairs.unionByName(near).distinct(), crowded.select("rep", "key", "size")


def _agreement(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, same): the pairs whose signatures and set sizes allow the threshold.

    Only the minima's low bytes travel to the pairs: by chance they agree more
    often than whole minima, never less.
    """
    side = classes.select("rep", "n_shingles", F.substring("sig", 1, TREES * DEPTH).alias("low"))
    wide = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    p = percent / 100
    least = TREES * DEPTH * p - 5 * (TREES * DEPTH * p * (1 - p)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, TREES * DEPTH) for i in (2, 3))
                same = (left == right).sum(axis=1)
                keep = pa.array(same >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same.astype(np.int32))], ["a", "b", "same"]).filter(keep)

    return wide.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, same int")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    wide = pairs.select("a", "b").join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return wide.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _joined(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, label) after further links found (a, b): the components of the links between the components there are."""
    if labels is None:
        return components(found)
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    ends = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    moved = components(ends.where("a <> b").distinct())
    old = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return _store.materialize(old.unionByName(moved.join(labels.select("node"), "node", "left_anti")), "labels")


def _grow(labels: DataFrame | None, near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """labels, and the links among the pairs near (a, b, same) that join components.

    Each class's most similar pair is verified first: that joins most of a crowd
    with one comparison for each class; then all pairs that still cross.
    """
    rank = F.struct(F.col("same"), -F.col("a"), -F.col("b"))
    ends = near.select(F.explode(F.array("a", "b")).alias("x"), rank.alias("r")).groupBy("x").agg(F.max("r").alias("r"))
    best = ends.select((-F.col("r.col2")).alias("a"), (-F.col("r.col3")).alias("b")).distinct()
    labels = _joined(labels, _store.materialize(_verify(best, sets, percent), "links"))
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    ends = near.join(of("a"), "a", "left").join(of("b"), "b", "left")
    crossing = ends.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    return _joined(labels, _store.materialize(_verify(crossing, sets, percent), "links"))


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame | None:
    """The rows of regions that hold more than one component: with their component, and the region's largest (main); None if there are none."""
    rows = _store.materialize(rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "crowd-rows")
    counts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = F.max(F.struct("n", "label"))["label"].alias("main")
    mixed = _store.materialize(counts.groupBy("key").agg(main, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "mixed")
    return rows.join(mixed, "key") if mixed.take(1) else None


def _meet(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Links that join the components of two blocks of (rep, label, s): a spanning forest of the pairs that reach the threshold."""
    if not left.num_rows or not right.num_rows:  # a block that has no other side
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    grams, owner, n = [], [], []
    for side in (left, right):
        bodies = side["s"].to_pylist()
        n.append(np.array([len(x) // 8 for x in bodies], np.int64))
        grams.append(np.frombuffer(b"".join(bodies), np.uint64))
        owner.append(np.repeat(np.arange(len(bodies)), n[-1]))
    shared = np.intersect1d(*grams)
    common = np.zeros((len(n[0]), len(n[1])), np.float32)
    place = [np.minimum(np.searchsorted(shared, g), max(len(shared) - 1, 0)) for g in grams]
    found = [shared[p] == g if len(shared) else np.zeros(0, bool) for p, g in zip(place, grams, strict=True)]
    for begin in range(0, len(shared), COLUMNS):
        dense = []
        for p, f, o, size in zip(place, found, owner, n, strict=True):
            here = np.flatnonzero(f & (p >= begin) & (p < begin + COLUMNS))
            dense.append(np.zeros((len(size), COLUMNS), np.float32))
            dense[-1][o[here], p[here] - begin] = 1
        common += dense[0] @ dense[1].T
    common = common.astype(np.int64)
    union = n[0][:, None] + n[1][None, :] - common
    reps, labels = ([side[c].to_numpy() for side in (left, right)] for c in ("rep", "label"))
    linked = (100 * common >= percent * union) & (union > 0) & (labels[0][:, None] != labels[1][None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in np.argwhere(linked).tolist():
        x, y = find(int(labels[0][i])), find(int(labels[1][j]))
        if x != y:
            root[x] = y
            out.append(sorted((int(reps[0][i]), int(reps[1][j]))))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _crowds(labels: DataFrame, sets: DataFrame, crowded: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """labels, and the links among the classes of crowded regions: no pair of one region that reaches the threshold crosses components.

    Twice, each class meets the most central class of each of its regions (the
    one whose regions hold most classes; then the most central one outside the
    largest component), which joins stars and dense crowds in linear time.  Then
    the classes outside a region's largest component meet all others of the
    region, in blocks that hold a bounded number of classes and shingles on
    either side; a pair of blocks returns no more links than join components.
    """
    centre = _store.materialize(crowded.groupBy("rep").agg(F.sum("size").alias("centre")), "centre")
    mine = crowded.select("rep", "key").join(centre, "rep")
    for outside in (False, True):
        rows = _mixed(mine, labels)
        if rows is None:
            return labels
        pool = rows.where("label <> main") if outside else rows
        hubs = pool.groupBy("key").agg(F.max(F.struct("centre", "rep", "label")).alias("hub"))
        met = rows.join(_store.materialize(hubs, "hubs"), "key").where(F.col("label") != F.col("hub.label"))
        met = met.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()
        near = _store.materialize(_agreement(met, classes, percent), "hub-pairs")
        labels = _joined(labels, _store.materialize(_verify(near, sets, percent), "hub-links"))

    rows = _mixed(mine, labels)
    if rows is None:
        return labels
    rows = _store.materialize(rows.join(classes.groupBy("rep").agg(F.sum("n_shingles").alias("n")), "rep"), "rest")
    blocks = lambda which: F.ceil(F.greatest(F.count(which) / BLOCK, F.sum(F.when(which.isNotNull(), F.col("n"))) / BLOCK_SHINGLES)).cast("int")
    outer = F.when(F.col("label") != F.col("main"), F.col("rep"))
    sizes = _store.materialize(rows.groupBy("key").agg(blocks(outer).alias("n_i"), blocks(F.col("rep")).alias("n_j")), "blocks")
    rows = rows.join(sizes, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    left = rows.where("label <> main").select("key", "rep", "label", slot("n_i").alias("i"), every("n_j").alias("j"))
    right = rows.select("key", "rep", "label", slot("n_j").alias("j"), every("n_i").alias("i"))
    own = ("key", "i", "j", "rep", "label", "s")
    # new names for the same columns: both sides stem from one table
    left, right = (side.join(sets, "rep").select(*own).toDF(*own).groupBy("key", "i", "j") for side in (left, right))
    found = left.cogroup(right).applyInArrow(lambda x, y: _meet(x, y, percent), "a long, b long")
    return _joined(labels, _store.materialize(found, "rest-links"))


def components(links: DataFrame, tag: str = "labels") -> DataFrame:
    """(node, label) of the nodes that have links; label is the smallest node that is reachable.

    Every round takes each node's smallest neighbouring label and then the label
    of that label; rounds grow with the logarithm of a component's diameter.
    """
    edges = _store.materialize(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))), "edges")
    labels = _store.materialize(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("label")), tag)
    while True:
        near = edges.join(labels, F.col("y") == F.col("node")).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        nxt = _store.materialize(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("next"), "label"), tag)
        labels = nxt.select("node", F.col("next").alias("label"))
        if not nxt.where("next <> label").take(1):
            return labels


def _classes(signed: DataFrame) -> DataFrame:
    """(f1, f2, id, n_shingles, rep) of each distinct set: id is its smallest doc_id, rep a number of its own: id, unless another set has that."""
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = _store.materialize(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles")), "sets-of-rows")
    shared = classes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("f1", "f2")).alias("first")).where("n > 1").select("id", "first")
    joined = classes.join(_store.materialize(shared, "shared-ids"), "id", "left")
    other = F.lit(-1) - F.shiftrightunsigned(F.xxhash64("f1", "f2"), 1)
    rep = F.when(F.col("first").isNull() | (F.col("first") == F.struct("f1", "f2")), F.col("id")).otherwise(other)
    return _store.materialize(joined.select("f1", "f2", "id", "n_shingles", rep.alias("rep")), "classes")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, component) of every row; component tells components apart that share their smallest doc_id."""
    signed = _store.materialize(sign(docs), "signed")
    classes = _classes(signed)
    mine = signed.select(F.col("doc_id").alias("id"), "row", "f1", "f2", "sig")
    forest = classes.join(mine, ["id", "f1", "f2"]).dropDuplicates(["rep"]).select("rep", "id", "row", "n_shingles", "sig")
    forest = _store.materialize(forest, "representatives")
    pairs, crowded = candidates(forest)
    near = _store.materialize(_agreement(pairs, forest, percent), "near")

    wanted = near.select(F.explode(F.array("a", "b")).alias("rep"))
    if crowded is not None:
        wanted = wanted.unionByName(crowded.select("rep"))
    wanted = _store.materialize(forest.select("rep", "id", "row").join(wanted.distinct(), "rep", "left_semi"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), row_hash(F.col("text")).alias("row"), "text")
    texts = texts.join(wanted.hint("shuffle_hash"), ["id", "row"]).select("rep", "text")  # wanted grows with the input: never broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.text_buffers(batch.column(1))
            for a, b in tx.slices(offsets):
                gram, at = shingle_sets(tx.Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([gram[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())], ["rep", "s"])

    sets = _store.materialize(texts.mapInArrow(run, "rep long, s binary"), "sets")
    labels = _grow(None, near, sets, percent)
    if crowded is not None:
        labels = _crowds(labels, sets, crowded, forest, percent)
    named = labels.join(classes.select(F.col("rep").alias("node"), "id"), "node")
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    linked = named.join(least, "label").select(F.col("node").alias("rep"), F.col("label").alias("component"), "component_id")
    own = classes.select("f1", "f2", "rep", "id").join(_store.materialize(linked, "linked"), "rep", "left")
    of_class = own.select("f1", "f2", F.coalesce("component", "rep").alias("component"), F.coalesce("component_id", "id").alias("component_id"))
    of_row = signed.drop("sig").join(_store.materialize(of_class, "class-components"), ["f1", "f2"], "left")
    has = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return of_row.select("doc_id", "row", "n_shingles", F.when(has, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(has, F.col("component")).alias("component"))


def _kept() -> Column:
    return F.col("doc_id") == F.col("component_id")


def minhash_query(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``near_duplicates``."""
    return near_duplicates(docs).drop("row", "component").withColumn("kept", F.coalesce(_kept(), F.lit(True)))


def minhash_stage(docs: DataFrame) -> DataFrame:
    """The rows of which one of each component stays: one of its smallest doc_id.

    Rows are linked by their own texts, whether or not they share a doc_id; rows
    without words or without doc_id stay; extra columns, whatever their names,
    pass through; an empty table gives an empty table.
    """
    found = _store.materialize(near_duplicates(docs, STAGE_PERCENT).where("component is not null"), "near-rows")
    first = found.where(_kept()).groupBy("component").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = _store.materialize(first.select("component", "first"), "several")  # components that have more than one row with their smallest id
    kept = found.where(_kept()).join(several, "component")
    gone = found.where(~_kept()).unionByName(kept.where("row <> first").drop("first"))
    out = without(docs, _store.materialize(gone.select("doc_id", "row"), "gone"))
    if not several.take(1):
        return out
    twins = kept.where("row = first").select(F.col("doc_id").alias("of_doc"), F.col("row").alias("of_row")).distinct()
    twins, rows = _store.materialize(twins, "twins"), packed(out)
    once = rows.join(twins, same_row()).dropDuplicates(["of_doc", "of_row"]).select("own")
    return rows.join(twins, same_row(), "left_anti").unionByName(once).select("own.*")
