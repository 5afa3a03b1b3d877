"""Token counts by a linear longest-match automaton.

The vocabulary is a trie; each node has a failure link and the number of tokens
popped on the way to it, both computed beforehand, so that a word of any length
is counted in one pass over its characters, without building pieces: greedy
longest-match-first, as word-piece tokenizers do.  Word-initial pieces and pieces
inside a word are two sets; a word that can't be matched whole is one unknown
token.  Words are ``[^\\x20\\x09-\\x0D]+``.

Defined results: null and empty texts have no tokens; null ids are kept;
repeated rows give repeated results; an empty table gives an empty result; extra
columns are ignored.  The automaton is broadcast: its size is the vocabulary's,
a parameter, not the corpus's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text as tx

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose counts a task remembers; the memory is emptied beyond it.
MEMORY = 200_000


def load_vocabulary(path: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """(word-initial pieces, inner pieces) of a sentencepiece model file: the former are those marked with a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1 and "▁" not in p[1:]], [p for p in pieces if "▁" not in p]


class LongestMatch:
    """Trie over both piece sets with failure links and popped-token counts."""

    def __init__(self, initial: Iterable[str], inner: Iterable[str]) -> None:
        #: Nodes 0 (word start) and 1 (inside a word) are the roots.
        self.child: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for char in piece:
                    nxt = self.child[node].get(char)
                    if nxt is None:
                        nxt = self.child[node][char] = len(self.child)
                        self.child.append({})
                        final.append(False)
                    node = nxt
                final[node] = final[node] or node > 1
        #: Where matching goes on when no child fits, and the tokens that this completes; -1: it can't go on.
        self.fail = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        level = [(0, c, n) for c, n in self.child[0].items()] + [(1, c, n) for c, n in self.child[1].items()]
        while level:
            below = []
            for parent, char, node in level:
                if final[node]:
                    self.fail[node], self.popped[node] = 1, 1
                else:
                    back, tokens = self.fail[parent], self.popped[parent]
                    while back >= 0 and char not in self.child[back]:
                        tokens += self.popped[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[node], self.popped[node] = self.child[back][char], tokens
                below += [(node, c, n) for c, n in self.child[node].items()]
            level = below

    def count(self, word: str) -> int:
        """Number of pieces of a word; 1 (the unknown token) if it has no match."""
        child, fail, popped = self.child, self.fail, self.popped
        node, tokens = 0, 0
        for char in word:
            nxt = child[node].get(char)
            while nxt is None:
                tokens += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                nxt = child[node].get(char)
            node = nxt
        while node != 1:
            tokens += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return tokens


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every whole text; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LongestMatch(*shared.value)
        known: dict[bytes, tuple[int, int]] = {}
        single = set(shared.value[0])
        for batch in batches:
            data, offsets = tx.text_buffers(batch.column(1))
            n_words, n_tokens, n_unknown = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                words = data[a:b].tobytes().split()
                tokens = unknown = 0
                for word in words:
                    got = known.get(word)
                    if got is None:
                        text = word.decode()
                        count = automaton.count(text)
                        got = known[word] = (count, int(count == 1 and text not in single))
                    tokens += got[0]
                    unknown += got[1]
                if len(known) > MEMORY:
                    known.clear()
                n_words.append(len(words))
                n_tokens.append(tokens)
                n_unknown.append(unknown)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
