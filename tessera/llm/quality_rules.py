"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document.  The ledger keeps the
measurements and one failure bit for each rule; versioned policies are masks
over those bits, so that a new policy, or the ablation of a rule, never reads a
text again.

Defined results: a null or empty text has zero counts and fails ``few_words``;
null ids pass through; repeated rows give repeated results; extra columns of the
input are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as tx

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
SYMBOLS = b"#*$%&|<>"



def rules() -> list[tuple[str, Column]]:
    """(name, failure condition) of every rule; the place in this list is the bit."""
    c = F.col
    return [
        ("few_words", c("n_words") < 50),
        ("repeated_windows", c("n_repeat_words") * 100 > c("n_words") * 50),
        ("symbol_ratio", c("n_symbols") * 100 > c("n_words") * 20),
        ("duplicate_lines", c("n_dup_lines") * 100 > c("n_lines") * 50),
        ("short_words", c("word_chars") * 100 < c("n_words") * 150),
        ("long_words", c("word_chars") > c("n_words") * 20),
        ("capitals", c("n_upper") * 100 > c("word_chars") * 50),
    ]


BASE = 0b0000011
#: Policies by version: the mask of the bits that reject.
POLICIES = {"v1": BASE, "v2": 0b0000111, "v3": 0b1111111}
CURRENT = "v3"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for batch in batches:
        data, offsets = tx.text_buffers(batch.column(1))
        for a, b in tx.slices(offsets):
            own, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            words = tx.Words(own, off)
            sums = tx.byte_sums(own)
            hashes = tx.range_hash(sums, words.start, words.end)
            solid = ~tx.IS_SPACE[own]
            # lines that hold a word, by document
            feed = np.flatnonzero(own == 10)
            start = np.unique(np.concatenate((off[:-1], feed + 1)))
            start = start[start < len(own)]
            doc = np.searchsorted(off[1:], start, "right")
            # an empty document shares its start with the next one: searchsorted gives the one that holds the byte
            end = np.minimum(np.append(start[1:], len(own)), off[doc + 1])
            end = end - ((end > start) & (own[np.maximum(end, 1) - 1] == 10))
            filled = np.zeros(len(own) + 1, np.int64)
            np.cumsum(solid, out=filled[1:])
            has = filled[end] > filled[start]
            line = tx.range_hash(sums, start[has], end[has]) ^ tx.mix(doc[has].astype(np.uint64) + np.uint64(1))
            n_lines = np.bincount(doc[has], minlength=b - a)
            distinct = np.bincount(doc[has][np.unique(line, return_index=True)[1]], minlength=b - a)
            gram, at = tx.ngram_hashes(hashes, words.doc, 3)
            gram ^= tx.mix(words.doc[at].astype(np.uint64) + np.uint64(1))
            _, where, times = np.unique(gram, return_inverse=True, return_counts=True)
            twice = at[times[where] > 1]
            repeat = tx.covered(len(words.start), twice, twice + 3)
            columns = (
                words.count, tx.per_row(solid & ((own & 0xC0) != 0x80), off), tx.per_row(symbol[own], off), n_lines - distinct,
                np.bincount(words.doc[repeat], minlength=b - a), n_lines, tx.per_row((own >= 65) & (own <= 90), off),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in columns)], ["doc_id", *MEASUREMENTS])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every whole text; one narrow pass, no shuffle."""
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASUREMENTS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, schema)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``: bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for bit, (_, fails) in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs).withColumn("failed", bits)


def apply_policy(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds ``kept``: no bit of the policy's mask is set."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents failing it, and those that only this rule rejects (kept without it).

    Counts by distinct bit pattern first, so that the shuffle carries at most
    2**rules rows from a task.
    """
    mask = POLICIES[version]
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(rules()) if mask >> i & 1))
    each = patterns.withColumn("r", F.explode(names))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def rule_totals(entries: DataFrame) -> DataFrame:
    """One row: the bits that any document fails, those that all fail, and the count."""
    return entries.agg(F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"), F.count(F.lit(1)).alias("n"))


def quality_rules_query(docs: DataFrame) -> DataFrame:
    """The contract's digest: counts, base_failed and kept for each document."""
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return apply_policy(ledger(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")
