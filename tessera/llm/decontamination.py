"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters, digits and non-ASCII characters, in Unicode
lower case, so neither punctuation nor capitals hide a copy.  The query set, the benchmark, is taken
in blocks of at most ``BLOCK_GRAMS`` n-grams; each block is broadcast and meets
every document (its size is proven by the block bound).  For a block:

1. a narrow pass counts the block's n-grams over the whole corpus;
2. a leak of M matched and E edited words scores 2 (M - E) and breaks into E + 1
   runs at most, so it shares M - E - 1 pairs of neighbouring words with the
   item.  An item's most frequent pairs are dropped, fewer than half of those
   that any leak shares; the others are seeds, and any leak holds at least
   the rest of that number of them, close together (``_asked``);
3. a second narrow pass finds the seeds in each document, gathers those of one
   item that lie so close together, and aligns the item with the text around them
   by local alignment (match +2, mismatch and gap -2).  A pair is a leak where
   the score is at least ``least`` of a perfect copy's; long items are told from
   chance by less, ``LONG`` of it and ``LONG_WORDS`` matched words' worth.

Only n-gram counts of the block leave the corpus; texts are never shuffled.

Defined results: null or empty texts and null or empty items match nothing; an item of
fewer than ``FEWEST`` words, which occurs by chance anywhere, matches the texts
that have its words and no others; rows that repeat a doc_id give one pair with the best score; of equal
scores the first place in the text; an empty benchmark or corpus gives no pairs;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _store
from tessera.llm import _text as tx
from tessera.llm._rows import row_hash, without

GRAM, FEWEST, LEAST = 2, 5, 0.5
LONG, LONG_WORDS = 0.4, 10
BLOCK_GRAMS = 200_000
#: Pairs of a seed's place and an item that are held at once, but those of one document always are.
EXPANDED = 1 << 20
MATCH, MISS = 2, -2
PAIRS = "doc_id long, row long, item_id long, score double, word_from long, word_to long"

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _folded() -> Column:
    """The text in lower case, beyond A-Z too; no word is split or joined by it."""
    return F.lower(F.col("text").cast("string")).alias("text")


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[tx.Words, np.ndarray]:
    """Words by the rule above: every other byte is made a space."""
    words = tx.Words(np.where(_BREAK[data], np.uint8(32), data), offsets)
    return words, words.hashes()


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: (score, start, end) with the place in text."""
    n = len(text)
    place = np.arange(n)
    score, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        step = np.where(text == word, MATCH, MISS)
        diagonal, above = score[:-1] + step, score[1:] + MISS
        take = diagonal >= above
        here = np.maximum(np.where(take, diagonal, above), 0)
        start = np.where(here > 0, np.where(take, origin[:-1], origin[1:]), place)
        # gaps along the text: the best of here[k] - 2 (j - k)
        lifted = here - MISS * place
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, place, 0))
        here = np.maximum(run + MISS * place, 0)
        start = np.where(here > 0, start[source], place + 1)
        score = np.concatenate(([0], here))
        origin = np.concatenate(([0], start))
        top = int(here.argmax()) if n else 0
        if n and here[top] > best[0]:
            best = (int(here[top]), int(start[top]), top + 1)
    return best


def needed(n_words: int, least: float) -> float:
    """The score that makes a leak of an item of n_words."""
    return MATCH * min(least * n_words, max(LONG * n_words, LONG_WORDS))


def _asked(n_words: int, least: float) -> tuple[int, int]:
    """(how many of an item's most frequent grams are no seeds, how many seeds each of its leaks holds at least)."""
    shared = max(1, int(np.ceil(needed(n_words, least) / MATCH - 1e-9)) - 1)
    dropped = (shared - 1) // 2
    return dropped, shared - dropped


def _item_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, words): hashes of the words of each item, as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.text_buffers(batch.column(1))
            words, values = _words(data, offsets)
            bodies = [values[f : f + c].tobytes() for f, c in zip(words.first.tolist(), words.count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary()), pa.array(words.count)], ["item_id", "words", "n"])

    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), _folded())
    return rows.mapInArrow(run, "item_id long, words binary, n long").where("n > 0").distinct()


def _short_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Leak rows of the items of fewer than FEWEST words: the texts that have just the item's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.text_buffers(batch.column(2))
            for a, b in tx.slices(offsets):
                words, values = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                few = np.flatnonzero((words.count > 0) & (words.count < FEWEST))
                bodies = [values[words.first[i] : words.first[i] + words.count[i]].tobytes() for i in few]
                columns = (*(batch.column(i).take(pa.array(few + a)) for i in (0, 1)), pa.array(bodies, pa.binary()))
                yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "row", "words"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(F.col("text")).alias("row"), _folded())
    texts = own.mapInArrow(run, "doc_id long, row long, words binary")
    found = texts.join(items.select("item_id", "words", "n"), "words")
    return found.select("doc_id", "row", "item_id", F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("word_from"), F.col("n").alias("word_to"))


def _grams(words: np.ndarray) -> np.ndarray:
    at = np.arange(len(words) - GRAM + 1)
    return tx.range_hash(tx.prefix_sums(words), at, at + GRAM)


def _gram_counts(docs: DataFrame, grams: np.ndarray) -> DataFrame:
    """(gram, n): how often each of these n-grams occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        count = np.zeros(len(known), np.int64)
        for batch in batches:
            data, offsets = tx.text_buffers(batch.column(0))
            for a, b in tx.slices(offsets):
                words, values = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found, _ = tx.ngram_hashes(values, words.doc, GRAM)
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                count += np.bincount(at[known[at] == found], minlength=len(known))
        hit = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(tx.signed(known[hit])), pa.array(count[hit])], ["gram", "n"])

    return docs.select(_folded()).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _seeds(items: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(gram, item_id): the grams of each item but the most frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(*batch.columns, strict=True):
                w = np.frombuffer(words.as_buffer(), np.uint64)
                g = _grams(w)
                columns = [tx.signed(g), np.full(len(g), item.as_py()), np.arange(len(g)), np.full(len(g), _asked(len(w), least)[0])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "item_id", "at", "dropped"])

    rows = items.select("item_id", "words").mapInArrow(run, "gram long, item_id long, at long, dropped long").join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("item_id").orderBy(F.desc("n"), "gram", "at")
    return rows.withColumn("i", F.row_number().over(order)).where((F.col("i") > F.col("dropped")) & (F.col("n") > 0)).select("gram", "item_id").distinct()


def _close(first: np.ndarray, last: np.ndarray, slot: np.ndarray, where: np.ndarray, doc: np.ndarray, owner: np.ndarray, asked: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc, item, places) of the seeds that lie close enough together, asked[item] of them within reach[item] words."""
    n = last[slot] - first[slot]
    upto, begin = np.cumsum(n), 0
    while begin < len(slot):
        # whole documents, of about EXPANDED rows
        end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + EXPANDED, "right"))
        end = int(np.searchsorted(doc, doc[min(max(end, begin + 1), len(doc)) - 1], "right"))
        k = n[begin:end]
        row = np.repeat(np.arange(begin, end), k)
        item = owner[np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k) + first[slot[row]]]
        key = doc[row] * len(asked) + item
        by = np.argsort(key, kind="stable")
        key, place, item = key[by], where[row][by], item[by]
        i = np.arange(len(key))
        j = i + asked[item] - 1
        i, j = i[j < len(key)], j[j < len(key)]
        good = (key[i] == key[j]) & (place[j] - place[i] <= reach[item[i]])
        inside = tx.covered(len(key), i[good], j[good] + 1)
        key, place = key[inside], place[inside]
        edges = [*np.flatnonzero(np.diff(key, prepend=-1)).tolist(), len(key)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(key[a]) // len(asked), int(key[a]) % len(asked), place[a:b]
        begin = end


def _leaks(docs: DataFrame, items: list[tuple[int, np.ndarray]], grams: np.ndarray, owners: np.ndarray, least: float) -> DataFrame:
    """Leak pairs of a block; seed grams[i] is of the item at place owners[i]."""
    order = np.argsort(grams, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((items, grams[order], owners[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, grams, owner = shared.value
        known, first = np.unique(grams, return_index=True)
        last = np.append(first[1:], len(grams))
        asked, spread = (np.array(x) for x in ([_asked(len(t), least)[1] for _, t in texts], [2 * len(t) for _, t in texts]))
        for batch in batches:
            data, offsets = tx.text_buffers(batch.column(2))
            ids, row_ids = batch.column(0), batch.column(1)
            rows: list[tuple] = []
            for a, b in tx.slices(offsets):
                words, values = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found, at = tx.ngram_hashes(values, words.doc, GRAM)
                slot = np.minimum(np.searchsorted(known, found), len(known) - 1)
                hits = np.flatnonzero(known[slot] == found)
                where = at[hits]
                for doc, item, places in _close(first, last, slot[hits], where, words.doc[where], owner, asked, spread):
                    (name, text), begin, end = texts[item], int(words.first[doc]), int(words.first[doc] + words.count[doc])
                    reach, best = 2 * len(text), (0, 0, 0)
                    groups = np.split(places, np.flatnonzero(np.diff(places) > reach) + 1)
                    for group in groups:
                        lo, hi = max(begin, int(group[0]) - reach), min(end, int(group[-1]) + GRAM + reach)
                        got = align(text, values[lo:hi])
                        if got[0] > best[0]:
                            best = (got[0], got[1] + lo - begin, got[2] + lo - begin)
                    if best[0] >= needed(len(text), least):
                        rows.append((ids[a + doc].as_py(), row_ids[a + doc].as_py(), name, best[0] / (MATCH * len(text)), best[1], best[2]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "row", "item_id", "score", "word_from", "word_to"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(F.col("text")).alias("row"), _folded()).mapInArrow(run, PAIRS)


def row_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, row, item_id, score, word_from, word_to) of the rows that hold a benchmark item, exact or edited."""
    spark = docs.sparkSession
    items = _store.materialize(_item_table(benchmark), "items")
    short = items.where(F.col("n") < FEWEST)
    out = _short_leaks(docs, short) if short.take(1) else None
    items = items.where(F.col("n") >= FEWEST)
    total = items.agg(F.sum(F.col("n")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // BLOCK_GRAMS))
    for block in range(blocks if total else 0):
        part = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block)
        texts: list[tuple[int, np.ndarray]] = []  # one block, bounded above
        for row in part.select("item_id", "words").toLocalIterator():
            texts.append((row.item_id, np.frombuffer(bytes(row.words), np.uint64)))
        if not texts:
            continue
        grams = np.unique(np.concatenate([_grams(w) for _, w in texts]))
        numbered = spark.createDataFrame([(i, bytearray(w.tobytes())) for i, (_, w) in enumerate(texts)], "item_id long, words binary")
        rows = [(r.gram, r.item_id) for r in _seeds(numbered, _store.materialize(_gram_counts(docs, grams), "grams"), least).toLocalIterator()]
        if not rows:
            continue
        found = _leaks(docs, texts, np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows]), least)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], PAIRS)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, word_from, word_to) of the documents that hold a benchmark item, exact or edited.

    A contaminated document is one with a row; score is the share of a perfect
    copy's alignment score, the words are counted in the document.
    """
    out = row_leaks(docs, benchmark, least)
    top = F.max(F.struct("score", (-F.col("word_from")).alias("neg"), "word_to")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", F.col("m.score").alias("score"), (-F.col("m.neg")).alias("word_from"), F.col("m.word_to").alias("word_to"))


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leak pairs with the score rounded to six places."""
    return leaks(docs, benchmark).withColumn("score", F.round("score", 6))


def decontamination_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no benchmark item.

    Null and empty texts stay; rows without doc_id and rows that share one are
    judged by their own text; extra columns, whatever their names, pass through;
    an empty table gives an empty table.
    """
    return without(docs, _store.materialize(row_leaks(docs, benchmark).select("doc_id", "row").distinct(), "leaks"))
