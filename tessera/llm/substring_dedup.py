"""Removal of repeated word sequences by prefix-partitioned suffix trees.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word goes if a window of
``length`` words covers it whose sequence also starts in a document with a
smaller doc_id; texts are judged as they came in.  ``_segments`` splits the
candidate suffixes into groups of bounded size by prefix (an anchor gram, longer
ones where a gram is too common, down to the whole window).  Each shard of groups
gets a suffix tree; its internal nodes of ``length`` words or more are the
repeats, and the suffixes below the shallowest of them start with the same
window: their smallest doc_id keeps it.

Defined results: a null text has no words; a text of fewer than ``length`` words
loses nothing; rows that share a doc_id lose nothing to one another; rows without
doc_id keep their words and take none from others; of equal sequences the smallest doc_id
keeps its own; an empty table gives an empty result; extra columns are ignored.
Words are told apart by hashes modulo 2**61 - 1, which two given words share with a
chance of their length / 2**61.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _segments as sg
from tessera.llm import _text as tx

LENGTH = 50
GRAM = 20
#: Bytes of 64-bit words in one suffix tree.
SHARD_BYTES = 4 << 20


class SuffixTree:
    """The deep part of the suffix tree of sequences of 64-bit words: its leaves in order, and its internal nodes of ``depth`` words or more.

    ``order`` holds the suffixes (places in the joined sequences) from left to
    right; node k spans the leaves order[lo[k] : hi[k]], which share depth[k]
    words and no more, and hangs below node parent[k] (-1: a node that isn't deep).
    Each sequence ends in a symbol of its own, so no shared words reach over an end.
    """

    def __init__(self, sequences: list[np.ndarray], depth: int) -> None:
        lengths = np.array([len(x) + 1 for x in sequences])
        self.starts = np.cumsum(lengths) - lengths
        words = np.concatenate([np.append(x, np.uint64(0)) for x in sequences])
        _, rank = np.unique(words, return_inverse=True)
        rank = rank.astype(np.int64) + len(sequences)
        rank[self.starts + lengths - 1] = np.arange(len(sequences))
        n, step = len(rank), 1
        ranks = [(1, rank)]  # of each suffix by its first 1, 2, 4, ... words
        while step < lengths.max():
            follow = np.full(n, -1, np.int64)
            follow[: n - step] = rank[step:]
            _, rank = np.unique(rank * (n + len(sequences) + 2) + follow + 1, return_inverse=True)
            rank = rank.astype(np.int64)
            step *= 2
            ranks.append((step, rank))
        self.order = np.argsort(rank, kind="stable")
        self.shared = self._shared(ranks)
        self._build(depth)

    def _shared(self, ranks: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Words that each leaf shares with the one to its left."""
        a, b = self.order[:-1], self.order[1:]
        total, n = np.zeros(len(a), np.int64), len(self.order)
        for size, rank in reversed(ranks):
            x, y = a + total, b + total
            inside = (x < n) & (y < n)
            same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
            total += size * same
        return np.concatenate(([0], total))

    def _build(self, least: int) -> None:
        """Internal nodes from a scan of the leaves with a stack of those still open; leaves that share less close all of it."""
        depth, lo, hi, parent = [], [], [], []
        deep = np.flatnonzero(self.shared >= least)
        values = self.shared[deep].tolist()
        stack: list[tuple[int, int, list[int]]] = []  # depth, first leaf, children

        def close(end: int, above: int) -> None:
            """Close nodes deeper than ``above``; the last one closed becomes a child of what stays, or of a new node of depth ``above``."""
            child, first = None, end
            while stack and stack[-1][0] > above:
                d, first, children = stack.pop()
                if child is not None:
                    children.append(child)
                child = len(depth)
                depth.append(d)
                lo.append(first)
                hi.append(end)
                parent.append(-1)
                for c in children:
                    parent[c] = child
            if above and (not stack or stack[-1][0] < above):
                stack.append((above, first if child is not None else end - 1, []))
            if child is not None and stack:
                stack[-1][2].append(child)

        before = -1
        for at, value in zip(deep.tolist(), values, strict=True):
            if at != before + 1:
                close(before + 1, 0)
            close(at, value)
            before = at
        close(before + 1, 0)
        self.depth, self.lo, self.hi, self.parent = (np.array(x, np.int64) for x in (depth, lo, hi, parent))

    def repeats(self) -> np.ndarray:
        """The shallowest deep node above each suffix, which all suffixes with the same first words share; -1 if none is."""
        top = np.flatnonzero(self.parent < 0)
        node = np.full(len(self.order), -1, np.int64)
        size = self.hi[top] - self.lo[top]
        leaf = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.lo[top], size)
        node[self.order[leaf]] = np.repeat(top, size)
        return node


def classes(bodies: list[bytes], runs: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of some segments: its deep node in the shard's suffix tree, or one of its own."""
    tree = SuffixTree([np.frombuffer(b, np.uint64) for b in bodies], length)
    node = tree.repeats()
    alone = np.flatnonzero(node < 0)
    node[alone] = len(tree.depth) + np.arange(len(alone))
    return np.concatenate([node[s : s + r] for s, r in zip(tree.starts.tolist(), runs.tolist(), strict=True)])


def dedup_words(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each document."""
    plan = sg.Plan(length, min(GRAM, max(1, length // 2)), words=True)
    marked = sg.removals(sg.with_row(docs), plan, "op4", lambda bodies, runs: classes(bodies, runs, length), SHARD_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.text_buffers(batch.column(1))
            count, removed, kept = [], [], []
            for i in range(batch.num_rows):
                words, own = data[offsets[i] : offsets[i + 1]].tobytes().split(), batch.column(2)[i]
                count.append(len(words))
                if own.is_valid:
                    mask = sg.span_mask(len(words), own.values.to_numpy(zero_copy_only=False), length)
                    words = [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]
                removed.append(count[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return marked.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def substring_dedup_query(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``dedup_words``."""
    return dedup_words(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
