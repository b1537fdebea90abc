"""Operator 3: token counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links, and for each node the number of pieces that
following its link pops. One pass over a word then gives the number of pieces that greedy
longest-match-first cutting would make, without building a piece or going back in the word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from .common import BATCH_BYTES, column_bytes, pieces, texts

#: Words whose counts a task remembers; the memory starts anew when it is full.
REMEMBERED = 500_000


def build_automaton(vocabulary: Iterable[bytes]) -> tuple[dict[int, int], list[int], list[int]]:
    """(next, fail, pops): next by node * 256 + byte; fail is -1 where nothing is left to pop."""
    following: dict[int, int] = {}
    parent, byte, is_piece = [-1], [0], [False]
    for piece in vocabulary:
        node = 0
        for c in piece:
            child = following.get(node << 8 | c)
            if child is None:
                child = following[node << 8 | c] = len(parent)
                parent.append(node)
                byte.append(c)
                is_piece.append(False)
            node = child
        is_piece[node] = bool(piece)
    depth = [0] * len(parent)
    for v in range(1, len(parent)):
        depth[v] = depth[parent[v]] + 1
    fail, pops = [-1] * len(parent), [0] * len(parent)
    for v in sorted(range(1, len(parent)), key=depth.__getitem__):
        if is_piece[v]:
            fail[v], pops[v] = 0, 1
            continue
        z, popped = fail[parent[v]], pops[parent[v]]
        while z >= 0 and (z << 8 | byte[v]) not in following:
            popped += pops[z]
            z = fail[z]
        if z >= 0:
            fail[v], pops[v] = following[z << 8 | byte[v]], popped
    return following, fail, pops


def count_pieces(word: bytes, automaton) -> int:
    """Pieces of one word; a word that the vocabulary can't cover is one unknown piece."""
    following, fail, pops = automaton
    node = count = 0
    for c in word:
        while (child := following.get(node << 8 | c)) is None:
            count += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        node = child
    while node:
        count += pops[node]
        node = fail[node]
        if node < 0:
            return 1
    return count


def count_tokens(docs: DataFrame, vocabulary: Iterable[bytes], prefix: bytes = b" ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text.

    Words are runs of bytes other than ASCII white space; ``prefix`` stands before each word, as
    in vocabularies whose word-initial pieces begin with a mark. Null and empty texts have no
    words; each row gives one row, repeated rows too; an empty table gives an empty one;
    other columns are left out. No shuffle; the automaton is of the vocabulary's size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_automaton(vocabulary))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton = shared.value

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= REMEMBERED:
                    self.clear()
                out = count_pieces(prefix + word, automaton)
                if len(word) <= 64:
                    self[word] = out
                return out

        known = Known().__getitem__
        for batch in pieces(batches, BATCH_BYTES):
            n_words, n_tokens = [], []
            for text in column_bytes(batch, "text"):
                words = text.split()
                n_words.append(len(words))
                n_tokens.append(sum(map(known, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
