"""Quality classifier: naive-Bayes-scaled n-gram indicators under a linear hinge-loss model.

Features are hashed indicators of 1- and 2-grams of tokens (runs of word
characters, runs of punctuation) and of 1- to 3-grams of token shapes, with a
length bucket.  Each indicator is scaled by its class log-count ratio and each
document to unit length; the linear model is fitted by dual coordinate descent,
and a sigmoid on held-back rows turns margins into probabilities.

The fit uses at most ``SAMPLE`` labelled rows, those with the smallest hash of
their id (a documented bound; every labelled row is used below it).  Scoring is
one narrow pass over all whole texts.

Defined results: a null or empty text has only the length bucket as a feature
and gets a score like any other; rows with null label or id are not learnt from;
a doc_id labelled more than once is learnt from once, with its smallest label;
if a class has no rows (or no label exists) every score is the share of label 1,
or 1.0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _store
from tessera.llm import _text as tx

BITS = 18
SAMPLE = 20_000
COST, EPOCHS = 1.0, 12
#: Feature numbers whose values the fit holds at once, beside the numbers of the whole sample.
PART = 1 << 18
THRESHOLD = 0.3

_KIND = np.full(256, 2, np.uint8)  # punctuation
_KIND[tx.IS_SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of all documents, and their n_docs + 1 offsets."""
    n_docs = len(offsets) - 1
    kind = _KIND[data]
    edge = np.ones(len(data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(data))
    solid = kind[start] != 0 if len(start) else np.zeros(0, bool)
    start, end = start[solid], end[solid]
    doc = np.searchsorted(offsets[1:], start, "right")
    token = tx.range_hash(tx.byte_sums(tx.LOWER[data]), start, end)
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    digit = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    n_upper, n_digit, size = upper[end] - upper[start], digit[end] - digit[start], end - start
    word = kind[start] == 1 if len(start) else np.zeros(0, bool)
    shape = np.where(n_digit > 0, 4, np.where((n_upper * 2 > size) & (size > 1), 3, np.where(n_upper > 0, 2, 1))).astype(np.uint64)
    shape = np.where(word, shape, tx.mix(token) | np.uint64(8))  # a run of punctuation is its own shape
    again = np.zeros(len(token), bool)
    again[1:] = (token[1:] == token[:-1]) & (doc[1:] == doc[:-1])
    shape = np.where(again, np.uint64(7), shape)  # the same token once more
    shape = tx.mix(shape + np.uint64(99))
    parts, owners = [tx.mix(token)], [doc]
    for values, sizes in ((token, (2,)), (shape, (1, 2, 3))):
        for n in sizes:
            gram, at = tx.ngram_hashes(values, doc, n)
            parts.append(tx.mix(gram ^ np.uint64(n * 7919 + (values is shape))))
            owners.append(doc[at])
    length = np.bincount(doc, minlength=n_docs)
    parts.append(tx.mix(np.log2(length + 1.0).round().astype(np.uint64) + np.uint64(1 << 40)))
    owners.append(np.arange(n_docs))
    number = (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique((np.concatenate(owners).astype(np.int64) << BITS) | number)
    return (both & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(both >> BITS, np.arange(n_docs + 1))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _sums(numbers: np.ndarray, at: np.ndarray, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of each document's values, from its numbers; about PART values at a time."""
    out, total = np.zeros(len(at) - 1), 0.0
    for a, b in tx.slices(at, PART):
        sums = np.empty(at[b] - at[a] + 1)
        sums[0], sums[1:] = total, values(numbers[at[a] : at[b]])  # one running sum: PART changes no bit of it
        np.cumsum(sums, out=sums)
        out[a:b], total = np.diff(sums[at[a : b + 1] - at[a]]), sums[-1]
    return out


def _unit(numbers: np.ndarray, at: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Length of each document's scaled vector, at least a little above zero."""
    return np.sqrt(np.maximum(_sums(numbers, at, lambda own: np.square(ratio[own], dtype=np.float64)), 1e-12))


def margins(numbers: np.ndarray, at: np.ndarray, ratio: np.ndarray, weight: np.ndarray) -> np.ndarray:
    product = weight * ratio
    return _sums(numbers, at, lambda own: product[own]) / _unit(numbers, at, ratio)


def coordinate_descent(numbers: np.ndarray, at: np.ndarray, value: np.ndarray | Callable[[int], np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the linear model min 1/2 |w|^2 + sum cost_i max(0, 1 - y_i w.x_i), by its dual.

    x_i has value[k] at numbers[k] for at[i] <= k < at[i + 1] and unit length; or
    value(i) gives its values, so that no more than one document's are held.
    """
    w, alpha = np.zeros(1 << BITS), np.zeros(len(y))
    rng = np.random.default_rng(3)
    ends = at.tolist()
    for _ in range(epochs):
        worst = 0.0
        order = rng.permutation(len(y))
        for i in order[cost[order] > 0].tolist():  # the others' alpha stays 0
            a, b = ends[i], ends[i + 1]
            index, x = numbers[a:b], value(i) if callable(value) else value[a:b]
            gradient = y[i] * (w[index] @ x) - 1.0
            new = min(max(alpha[i] - gradient, 0.0), cost[i])  # x_i . x_i = 1
            step = new - alpha[i]
            if abs(step) > 1e-9:
                w[index] += step * y[i] * x
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w


def fit(numbers: np.ndarray, at: np.ndarray, label: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(ratio, weight, slope, intercept) from documents' features and 0/1 labels; fold 0 calibrates."""
    share = float(label.mean()) if len(label) else 1.0
    none = np.zeros(1 << BITS, np.float32)
    flat = (none, none, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))) if len(label) else 20.0)
    if len(np.unique(label)) < 2:
        return flat
    ones, zeros = np.ones(1 << BITS), np.ones(1 << BITS)
    for i, j in tx.slices(at, PART):
        own, good = numbers[at[i] : at[j]], np.repeat(label[i:j] == 1, np.diff(at[i : j + 1]))
        ones += np.bincount(own[good], minlength=1 << BITS)
        zeros += np.bincount(own[~good], minlength=1 << BITS)
    ratio = np.log((ones / ones.sum()) / (zeros / zeros.sum())).astype(np.float32)
    unit = _unit(numbers, at, ratio)
    ends = at.tolist()
    y = np.where(label == 1, 1.0, -1.0)
    train = fold != 0
    if len(np.unique(label[train])) < 2 or len(np.unique(label[~train])) < 2:
        train = np.ones(len(label), bool)
    cost = np.where(label == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) * COST  # both classes weigh alike
    cost[~train] = 0.0
    w = coordinate_descent(numbers, at, lambda i: ratio[numbers[ends[i] : ends[i + 1]]] / unit[i], y, cost)
    calibrate = ~train if (~train).any() else train
    z = margins(numbers, at, ratio, w)[calibrate]
    target = label[calibrate].astype(float)
    n1, n0 = target.sum(), len(target) - target.sum()
    target = np.where(target == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the two-parameter sigmoid
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return ratio, w.astype(np.float32), float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row (ratio, weight, slope, intercept): fitted in one task on the bounded sample."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min(F.col(label).cast("int")).alias("__label"))
    sample = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE))  # bounded by SAMPLE
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(sample, "__id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.text_buffers(batch.column(1))
            for a, b in tx.slices(offsets):
                numbers, at = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                bodies = pa.array([numbers[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), bodies], ["id", "label", "f"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, label_, bodies = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            label_ += batch.column(1).to_pylist()
            bodies += [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(2)]
            del batch
        order = sorted(range(len(ids)), key=lambda i: (ids[i], len(bodies[i])))  # the same fit whatever the partitions
        bodies = [bodies[i] for i in order]
        at = np.concatenate(([0], np.cumsum([len(x) for x in bodies]))).astype(np.int64)
        numbers = np.concatenate([*bodies, np.zeros(0, np.int32)])
        del bodies  # and the batches whose memory they show
        fold = np.array([ids[i] * 2654435761 % 2**32 >> 16 for i in order], np.int64) % 5
        ratio, w, a, b = fit(numbers, at, np.array([label_[i] for i in order], np.int64), fold)
        yield pa.RecordBatch.from_arrays([pa.array([ratio.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([a]), pa.array([b])], ["ratio", "weight", "slope", "intercept"])

    sparse = rows.select("__id", "text", "__label").mapInArrow(extract, "id long, label int, f binary")
    return sparse.repartition(1).mapInArrow(solve, "ratio binary, weight binary, slope double, intercept double")


def _scorer(docs: DataFrame, model: DataFrame) -> Callable[[pa.Array], np.ndarray]:
    """Scores of a column of texts; the model is two arrays of 2**BITS floats, and is broadcast."""
    row = model.first()
    ratio, weight = (np.frombuffer(bytes(x), np.float32) for x in (row.ratio, row.weight)) if row else (np.zeros(1 << BITS, np.float32),) * 2
    slope, intercept = (row.slope, row.intercept) if row else (0.0, 20.0)
    shared = docs.sparkSession.sparkContext.broadcast((ratio, weight))

    def scores(texts: pa.Array) -> np.ndarray:
        ratio, weight = shared.value
        data, offsets = tx.text_buffers(texts)
        z = [np.zeros(0)]
        for a, b in tx.slices(offsets):
            own = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            z.append(slope * margins(*own, ratio, weight) + intercept)
        return 1 / (1 + np.exp(-np.clip(np.concatenate(z), -30, 30)))

    return scores


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, score) of every whole text."""
    scores = _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    model = _store.materialize(train(docs, labels), "model")
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose own text the classifier doesn't reject; one narrow pass, nothing is joined.

    Null and empty texts are scored like any other; rows without doc_id and rows
    that share one are judged one by one; extra columns, whatever their names,
    pass through; an empty table gives an empty table.
    """
    scores = _scorer(docs, _store.materialize(train(docs, labels), "model"))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(text)) >= THRESHOLD))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # a name with a dot can't go through Arrow
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
