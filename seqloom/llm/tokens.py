"""Greedy word-piece lengths by a linear longest-match automaton."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._store import bound_batches, returning

#: A worker keeps counts of up to twice so many words.
CACHE = 200_000


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word, and those that go on with one, of a piece model: the mark of a word's begin tells which.

    The mark alone is the empty piece: a word may begin with it and go on with any other.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in plain]
    first = [p[1:] for p in pieces if p[0] == "▁" and "▁" not in p[1:]]
    return first, [p for p in pieces if "▁" not in p]


class Automaton:
    """Trie of the vocabulary; each node has a failure link, and the number of pieces that are popped on the way along it.

    Two roots: of pieces that begin a word, and of those that go on. A node's
    link leads to the node of what is left once the longest pieces before it are
    taken, so each character of a word is read once and no piece is built.
    """

    def __init__(self, first: list[str], more: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, first), (1, more)):
            for piece in pieces:
                at = root
                for c in piece:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    at = to
                ends[at] = True
        n = len(self.next)
        self.link, self.pops = [-1] * n, [0] * n
        if ends[0]:
            self.link[0], self.pops[0] = 1, 1
        todo = deque([0, 1])
        while todo:  # by depth, so links of shorter strings are there
            u = todo.popleft()
            for c, v in self.next[u].items():
                todo.append(v)
                if ends[v]:
                    self.link[v], self.pops[v] = 1, 1
                    continue
                z, gone = self.link[u], self.pops[u]
                while z >= 0 and c not in self.next[z]:
                    gone += self.pops[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.pops[v] = self.next[z][c], gone

    def count(self, word: str) -> int:
        """Pieces of the word by greedy longest match; -1 if it cannot be written so."""
        u, total = 0, 0
        nxt, link, pops = self.next, self.link, self.pops
        for c in word:
            while c not in nxt[u]:
                if link[u] < 0:
                    return -1
                total += pops[u]
                u = link[u]
            u = nxt[u][c]
        while u != 1:
            if link[u] < 0:
                return -1
            total += pops[u]
            u = link[u]
        return total


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(*vocabulary(path))
    return _AUTOMATA[path]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row of ``docs`` (doc_id, text).

    Words are maximal runs without ASCII white space. A word that greedy longest
    match cannot write is one unknown token. One pass, no shuffle; a distinct
    word of a batch is counted once, and each worker keeps counts of a bounded
    number of words. The vocabulary is read from ``path`` on each worker.

    Null and empty texts: zeros. A word of any length takes linear time. Repeated
    rows give equal rows. Empty table: empty. Other columns are dropped.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, have, older = automaton(path), {}, {}
        for b in batches:
            for at, n, buf, offsets in W.pieces(b.column(1)):
                starts, ends, first = W.spans(buf, offsets)
                keys, where, inverse = np.unique(W.word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
                if len(have) > CACHE:
                    have, older = {}, have
                data, counts = buf.tobytes(), []
                for key, s, e in zip(keys.tolist(), starts[where].tolist(), ends[where].tolist()):
                    x = have.get(key)
                    if x is None:
                        x = older.get(key)
                        if x is None:
                            x = a.count(data[s:e].decode("utf-8", "replace"))
                        have[key] = x
                    counts.append(x)
                one = np.array(counts, np.int64)[inverse] if counts else np.zeros(0, np.int64)
                total = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[first[1:]] - c[first[:-1]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(np.diff(first), pa.int64()), pa.array(total(np.where(one < 0, 1, one)), pa.int64()), pa.array(total((one < 0).astype(np.int64)), pa.int64())], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(returning(run), "doc_id long, n_words long, n_tokens long, n_unknown long")
