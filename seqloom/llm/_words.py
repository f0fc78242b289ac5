"""Words of whole texts as numpy arrays: split and hashed without a Python loop.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, on the UTF-8
bytes of a text; UTF-8 never uses these bytes inside a character, so this
equals the same rule on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: One random 64-bit value for each byte, and two odd multipliers with their inverses modulo 2**64.
BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of text that are worked on at once, if no single text is longer; powers that a worker keeps at most.
PIECE, KEPT_POWERS = 1 << 19, 1 << 21


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of a base and of its inverse, modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        base = BASES[which]
        with np.errstate(over="ignore"):
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                x = np.full(size, b, U64)
                x[0] = 1
                both.append(np.multiply.accumulate(x))
        have = tuple(both)
        if size <= KEPT_POWERS:
            _POWERS[which] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of its first word (one more at the end)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def parts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, cut again between a letter and a full stop or comma after it: (bytes, starts, ends, first of each text).

    A part of plain ASCII without "<" has A-Z lower-cased in the bytes returned; others stay as they are.
    """
    starts, ends, first = spans(buf, offsets)
    n = len(buf)
    if not len(starts):
        return buf, starts, ends, first
    low = LOWER[buf]
    letter = (low >= 97) & (low <= 122)
    # or the second byte of a Latin-1 letter
    letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] < 0xC0) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    cut = np.zeros(n, bool)
    cut[1:] = ((buf[1:] == 46) | (buf[1:] == 44)) & letter[:-1]
    cut[offsets[:-1][offsets[:-1] < n]] = False
    more = np.flatnonzero(cut)
    starts, ends = np.sort(np.concatenate([starts, more])), np.sort(np.concatenate([ends, more]))
    odd = np.zeros(n + 1, np.int32)
    np.cumsum((buf >= 128) | (buf == 60), out=odd[1:])
    raw = odd[ends] > odd[starts]
    inside = np.zeros(n + 1, np.int8)
    inside[starts[raw]] += 1
    inside[ends[raw]] -= 1
    return np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, buf, low), starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word, from its bytes alone."""
    p, inverse = powers(len(buf) + 1, 0)
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, U64)
        np.cumsum(BYTES[buf] * p[:-1], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values, at each position where k of them follow; ends of texts are not looked at."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    p, inverse = powers(len(h), 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, U64)
        np.cumsum(h * p, out=total[1:])
        return mix((total[k:] - total[:n]) * inverse[:n] + U64(k))


def within(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the first n - k + 1 positions begin k words of one text. first: as from spans()."""
    ok = np.zeros(n + 1, np.int32)
    count = np.maximum(np.diff(first) - k + 1, 0)
    some = count > 0
    np.add.at(ok, first[:-1][some], 1)
    np.add.at(ok, (first[:-1] + count)[some], -1)
    return np.cumsum(ok)[: max(0, n - k + 1)] > 0


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) for runs of whole texts of about ``most`` bytes; null: empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, to - at, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
