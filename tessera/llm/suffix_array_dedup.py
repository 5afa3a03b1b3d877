"""Exact removal of repeated byte strings by suffix arrays.

Every whole text is UTF-8 bytes.  A byte goes if a string of ``length`` bytes
that covers it also starts anywhere else, in the same document or another; texts
are judged as they came in.  ``_segments`` finds the text that can hold repeats
and deals it into shards; each shard's suffixes are sorted by external induced
sorting (``_induced``), which carries common-prefix values: neighbours that share
``length`` bytes are equal windows.

Defined results: a null text is empty; a text shorter than ``length`` loses
nothing; rows that repeat (same id and text) count as two places, so both lose
what they share; null ids are kept as they are; an empty table gives an empty
result; extra columns are ignored.  Windows are compared exactly within a shard;
segments are told apart by 64-bit hashes of both anchor and context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _segments as sg
from tessera.llm import _store
from tessera.llm import _text as tx
from tessera.llm._induced import sort_segments

LENGTH = 200
GRAM = 48
#: Bytes of text sorted together, and bytes of queued suffix tuples (six for each byte of text) kept in memory.
SHARD_BYTES = 1 << 20
QUEUE_BYTES = 2 << 20


def classes(bodies: list[bytes], runs: np.ndarray, length: int, folder: str | None = None) -> np.ndarray:
    """A number for each window of some segments; equal windows get equal numbers.  Queues spill into folder."""
    order, prefix, starts = sort_segments(bodies, length, budget=QUEUE_BYTES, folder=folder)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(prefix < length)
    return np.concatenate([number[s : s + r] for s, r in zip(starts.tolist(), runs.tolist(), strict=True)])


def dedup_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of removed [start, end) ranges) and kept (binary) of each document."""
    plan = sg.Plan(length, min(GRAM, max(1, length // 2)), words=False)
    queues = _store.new_path(docs.sparkSession, "op1-queues")
    marked = sg.removals(sg.with_row(docs), plan, "op1", lambda bodies, runs: classes(bodies, runs, length, queues), SHARD_BYTES)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.text_buffers(batch.column(1))
            removed, spans, kept = [], [], []
            for i in range(batch.num_rows):
                text, own = data[offsets[i] : offsets[i + 1]], batch.column(2)[i]
                if not own.is_valid:
                    removed.append(0)
                    spans.append([])
                    kept.append(text.tobytes())
                    continue
                mask = sg.span_mask(len(text), own.values.to_numpy(zero_copy_only=False), length)
                edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
                removed.append(int(mask.sum()))
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(text[~mask].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return marked.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


def suffix_array_dedup_query(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``dedup_bytes``."""
    out = dedup_bytes(docs)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
