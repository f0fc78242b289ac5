"""Pack tokenised documents into sequences: first-fit decreasing on a tournament tree, in random groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._store import bound_batches, returning

CAPACITY, END_ID, GROUP_DOCS, LEAST_GAP = 4096, 2, 1024, 16
#: A worker keeps ids of up to twice so many words: of this generation, and those of the last.
CACHE = 200_000


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode`` for a word-level pre-tokenizer that drops white space.

    A text is cut at ASCII white space, and between a letter and a following
    full stop or comma. The normalizer and pre-tokenizer of the vocabulary never
    look across such a cut, so ids of parts may be joined; each distinct part is
    encoded once and kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        for piece, i in self.tok.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.have: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}

    def _learn(self, keys: list[int], words: list[str]) -> None:
        """Words of letters alone are one pre-token, so many are encoded as one text and parted at word ends."""
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        for at in range(0, len(plain), 4000):
            some = plain[at : at + 4000]
            ids = np.array(self.tok.encode(" ".join([words[i] for i in some]), add_special_tokens=False).ids, np.uint16)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                data, last = ids.tobytes(), 0
                for i, to in zip(some, stops.tolist()):
                    self.have[keys[i]] = data[2 * last : 2 * to]
                    last = to
        left = [i for i, k in enumerate(keys) if k not in self.have]
        for at in range(0, len(left), 4000):
            some = left[at : at + 4000]
            for i, e in zip(some, self.tok.encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
                self.have[keys[i]] = np.array(e.ids, np.uint16).tobytes()

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (16 bits each) and where each text's begin, one more at the end."""
        low, starts, ends, first = W.parts(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        keys, at, inverse = np.unique(W.word_hashes(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.have) > CACHE:
            self.have, self.older = {}, self.have
        have, older, names, new = self.have, self.older, keys.tolist(), []
        for i, k in enumerate(names):
            if k not in have:
                if k in older:
                    have[k] = older[k]
                else:
                    new.append(i)
        if new:
            data = low.tobytes()
            self._learn([names[i] for i in new], [data[s:e].decode() for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
        got = [have[k] for k in names]
        store, size = np.frombuffer(b"".join(got), np.uint16), np.fromiter(map(len, got), np.int64, len(got)) // 2
        begin = np.cumsum(size) - size
        lengths = size[inverse]
        to = np.concatenate([[0], np.cumsum(lengths)])
        ids = store[np.repeat((begin[inverse] - to[:-1]).astype(np.int32), lengths) + np.arange(to[-1], dtype=np.int32)]
        return ids, to[first]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers. Leaves of the tree are bins' free places, inner nodes the largest below; the first bin that fits is found from the root."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    tree = [capacity] * (2 * size)
    bins: list[list[int]] = []
    for i in order:
        need, at = lengths[i], 1
        while at < size:
            at *= 2
            if tree[at] < need:
                at += 1
        if at - size == len(bins):
            bins.append([])
        bins[at - size].append(i)
        tree[at] -= need
        while at > 1:
            at //= 2
            top = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == top:
                break
            tree[at] = top
    return bins


def fill(bins: list[list[tuple[int, int, int]]], capacity: int = CAPACITY, least: int = LEAST_GAP) -> list[list[tuple[int, int, int]]]:
    """Cut pieces (item, start, length) of the emptiest bins to fill gaps of the others; what is left at last goes to sequences of powers of two."""
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-used[i], i))
    gaps = [i for i in order if used[i] < capacity]
    lo, hi = 0, len(gaps) - 1
    while lo < hi:
        to, of = gaps[lo], gaps[hi]
        free = capacity - used[to]
        if free < least:
            lo += 1
            continue
        if not bins[of]:
            hi -= 1
            continue
        item, start, length = bins[of].pop()
        take = min(free, length)
        if take < length:
            bins[of].append((item, start, length - take))
        bins[to].append((item, start + length - take, take))
        used[to] += take
        used[of] -= take
    out = [b for i, b in enumerate(bins) if b and (not gaps or i != gaps[hi] or used[i] >= capacity - least)]
    if gaps and bins[gaps[hi]] and used[gaps[hi]] < capacity - least:
        rest, left = bins[gaps[hi]][::-1], used[gaps[hi]]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            seq = []
            while room:
                item, start, length = rest.pop()
                take = min(room, length)
                seq.append((item, start, take))
                room -= take
                if take < length:
                    rest.append((item, start + take, length - take))
            out.append(seq)
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = 7, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece; with_ids: its ids too (binary, 16 bits each).

    A document is its ids and ``end_id``. Whole runs of ``capacity`` ids are
    sequences of their own. The tails are dealt by a hash of id and text to groups of
    about ``group_docs`` documents, and each group is packed by itself: the
    number of groups follows the table, so a group's memory does not. A group
    holds at most ``group_docs`` tails on average, each under ``capacity`` ids.

    Null and empty texts: ``end_id`` alone. Null doc_id: packed under null. Very long texts are encoded as a
    whole and give many whole runs. Repeated rows are packed one by one.
    Empty table: empty. Other columns are dropped.
    """
    bound_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), F.lit(groups)).cast("long")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), key.alias("grp"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids_of, grp_of = b.column(0), b.column(2)
            for at, n, buf, offsets in W.pieces(b.column(1)):
                ids, to = enc.encode(buf, offsets)
                doc, start, length, sums, total, data = [], [], [], [], [], []
                for i in range(n):
                    own = np.append(ids[to[i] : to[i + 1]], np.uint16(end_id))
                    for s in range(0, len(own), capacity):
                        piece = own[s : s + capacity]
                        whole = len(piece) == capacity
                        doc.append(at + i)
                        start.append(s)
                        length.append(len(piece))
                        total.append(len(own))
                        sums.append(crc(piece) if whole else None)
                        data.append(piece.tobytes() if with_ids or not whole else None)
                rows = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays([grp_of.take(rows), ids_of.take(rows), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64()), pa.array(total, pa.int64()), pa.array(data, pa.binary())], names=["grp", "doc_id", "start", "length", "crc", "doc_tokens", "ids"])

    def one_group(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("doc_id", "ascending"), ("start", "ascending")])
        doc, start, length, total, sums, data, grp = (t.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "crc", "ids", "grp"))
        order = np.random.default_rng([seed, grp[0]]).permutation(len(doc)).tolist()  # ties between lengths go at random
        whole = [i for i in range(len(doc)) if length[i] == capacity]
        tails = [i for i in order if length[i] < capacity]
        bins = [[(tails[i], 0, length[tails[i]]) for i in b] for b in first_fit_decreasing([length[i] for i in tails], capacity)]
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
        for k, seq in enumerate([[(i, 0, capacity)] for i in whole] + fill(bins, capacity)):
            at = 0
            for i, s, n in seq:
                ids = data[i][2 * s : 2 * (s + n)] if data[i] is not None else None
                for name, v in (("doc_id", doc[i]), ("start", start[i] + s), ("length", n), ("ids_crc32", sums[i] if sums[i] is not None else crc(np.frombuffer(ids, np.uint16))), ("doc_tokens", total[i]), ("sequence_id", (grp[0] << 32) + k), ("offset", at), ("ids", ids if with_ids else None)):
                    out[name].append(v)
                at += n
        kinds = {"ids": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    cut = slim.mapInArrow(returning(tokens), "grp long, doc_id long, start long, length long, crc long, doc_tokens long, ids binary")
    out = cut.groupBy("grp").applyInArrow(one_group, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out if with_ids else out.drop("ids")
