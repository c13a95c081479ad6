"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  A node's failure link names the node to go on from when no child fits, and its popped
count is the number of pieces that greedy longest match emits on that way; both are set once, in breadth-first order.
Counting a word is then one pass over its characters, linear in its length, and no piece is ever built.

A word is a run of ``[^\\x20\\x09-\\x0D]`` with the vocabulary's word-start mark put before it.  A word that greedy
matching can't cover counts as one unknown token.  Each worker keeps counts of words it has seen, in a cache of
fixed size.

Null and empty texts have no words and no tokens.  A very long text is one list of its words.  Repeated rows, ties and null ids each give a row of their own;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import store

WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
CACHE = 400_000
COUNTS = "doc_id long, n_words long, n_tokens long"


class LongestMatch:
    """Greedy longest-match piece counts over a vocabulary."""

    def __init__(self, pieces, mark: str = "▁"):
        self.mark, self.child, self.known = mark, [{}], {}
        child, final = self.child, [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                    final.append(False)
                node = child[node][c]
            final[node] = node != 0
        n = len(child)
        self.fail, self.pops = [-1] * n, [0] * n
        fail, pops = self.fail, self.pops
        queue = [0]
        for parent in queue:
            for c, node in child[parent].items():
                queue.append(node)
                if final[node]:
                    fail[node], pops[node] = 0, 1
                    continue
                at, popped = fail[parent], pops[parent]
                while at >= 0 and c not in child[at]:
                    popped += pops[at]
                    at = fail[at]
                if at >= 0:
                    fail[node], pops[node] = child[at][c], popped

    def count(self, word: str) -> int:
        """Pieces of one word; 1 if it can't be covered."""
        child, fail, pops = self.child, self.fail, self.pops
        node = total = 0
        for c in self.mark + word:
            while c not in child[node]:
                if fail[node] < 0:
                    return 1
                total += pops[node]
                node = fail[node]
            node = child[node][c]
        while node:
            if fail[node] < 0:
                return 1
            total += pops[node]
            node = fail[node]
        return total

    def counts(self, words: list[str]) -> int:
        """Pieces of all words."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self.count(word)
        return sum(map(known.__getitem__, words))


def pieces_of(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


_automata: dict[str, LongestMatch] = {}


def automaton(path: str) -> LongestMatch:
    """One automaton a worker process."""
    if path not in _automata:
        _automata[path] = LongestMatch(pieces_of(path))
    return _automata[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document's whole text; ``path`` names a sentencepiece model."""
    store.arrow_batches(docs.sparkSession)

    def count(batches):
        import pyarrow as pa

        match = automaton(path)
        for batch in batches:
            words = [[] if x is None else WORD.findall(x) for x in batch.column(1).to_pylist()]
            n = np.fromiter(map(len, words), np.int64, len(words))
            tokens = np.fromiter(map(match.counts, words), np.int64, len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(count, COUNTS)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece counts of all documents with the 32k piece vocabulary."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
