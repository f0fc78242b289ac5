"""Substring dedup: winnowed anchors as seeds, extended both ways by the hashes of the windows through them, to maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._store import bound_batches, free_name, returning, stage

U64 = np.uint64
#: Words of an anchor. A window of n words picks the smallest of its n - ANCHOR + 1 anchors.
ANCHOR = 10
#: Bytes of a window's hash beside its anchor's 64 bits.
SHORT = 5
#: One document in so many is looked at for anchors that many documents share.
SAMPLE = 64


def _pick(g: np.ndarray, w: int) -> np.ndarray:
    """For each place that begins w values, the place of the leftmost smallest of them."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, have = np.arange(len(g)), 1
    while have < w:
        step = min(have, w - have)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(g[a] <= g[b], a, b)
        have += step
    return best[:n]


def seeds(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """One row for each anchor that a window of ``length`` words picks: (text, anchor hash, first window's place in its text, number of windows) and the windows' hashes.

    Windows that pick the same place are consecutive, and equal windows pick
    equal anchors, so windows need comparing only among rows of one anchor.
    """
    starts, ends, first = W.spans(buf, offsets)
    words = W.word_hashes(buf, starts, ends)
    ok = np.flatnonzero(W.within(first, length, len(words)))
    if not len(ok):
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros((0, SHORT), np.uint8)
    g = W.grams(words, ANCHOR)
    at = _pick(g, length - ANCHOR + 1)[ok]
    doc = np.searchsorted(first, ok, "right") - 1
    new = np.ones(len(ok), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    row = np.flatnonzero(new)
    run = np.arange(len(ok)) - np.repeat(row, np.diff(np.append(row, len(ok))))
    row = np.flatnonzero(run % 60 == 0)  # a row's windows are bits of one long
    h = W.grams(words, length)[ok].view(np.uint8).reshape(-1, 8)[:, :SHORT]
    return doc[row], g[at[row]].view(np.int64), ok[row] - first[doc[row]], np.diff(np.append(row, len(ok))), h


def _key(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("th"), F.col("text").cast("binary").alias("text"))


def _common(rows: DataFrame, length: int, tasks: int) -> list[int]:
    """Anchors that would fill more than an eighth of a task, by a sample of whole documents.

    At most 8 * tasks of them can be, whatever the input. They are only dealt
    out otherwise; results do not depend on which anchors are found here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, offsets in W.pieces(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(seeds(buf, offsets, length)[1])], names=["anchor"])

    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SAMPLE)) == 0).select("text").mapInArrow(returning(run), "anchor long")
    counts = sample.groupBy("anchor").agg(F.count("*").alias("n"))
    counts = stage(counts.filter("n >= 8").unionAll(sample.agg(F.lit(None).cast("long"), F.count("*"))), "anchors")
    total = counts.filter("anchor IS NULL").first()["n"]
    return [r["anchor"] for r in counts.filter((F.col("n") >= max(8, total / (8 * tasks))) & F.col("anchor").isNotNull()).orderBy("anchor").collect()]


def repeats(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, runs) of the documents that hold a repeated window; th is a hash of the text.

    runs: array of (first, mask); bit i of mask says that the window of
    ``length`` words that begins at word first + i also begins somewhere else.

    Seeds with a common anchor meet in one task. A seed carries the hash of each
    window of ``length`` words through it, by how far it reaches to the left and
    right; those that are equal in two seeds say how far their match extends
    (64 + 40 bits). So a group of seeds is extended at once, not pair by pair. Anchors that many documents share are dealt to all tasks by a
    hash of the document; windows found once in a task meet by their own hash.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _key(docs)
    common = np.array(_common(rows, length, tasks), np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for at, n, buf, offsets in W.pieces(b.column(2)):
                doc, anchor, s0, count, h = seeds(buf, offsets, length)
                of = pa.array(doc + at)
                own = ids.take(of)
                salt = np.full(len(doc), -1, np.int32)
                if len(common):
                    hot = np.isin(anchor, common)
                    salt[hot] = (W.mix(own.fill_null(0).to_numpy(zero_copy_only=False)[hot].astype(np.int64).view(U64)) % U64(tasks)).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32) * np.int32(SHORT)
                data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(h))])
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(salt), own, b.column(1).take(of), pa.array(s0.astype(np.int32)), data], names=["anchor", "salt", "doc_id", "th", "s0", "hs"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if left is None else pa.concat_tables([left, t]).combine_chunks()
            anchor, salt = t.column("anchor").to_numpy(), t.column("salt").to_numpy()
            new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
            cut = int(new[-1]) if len(new) else 0
            left = t.slice(cut)
            if cut:
                yield from compare(t.slice(0, cut))
        if left is not None and left.num_rows:
            yield from compare(left)

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        anchor, salt = t.column("anchor").to_numpy(), t.column("salt").to_numpy()
        group = np.concatenate([[0], np.cumsum((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1]))])
        hs = t.column("hs").combine_chunks()
        if isinstance(hs, pa.ChunkedArray):
            hs = hs.chunk(0)
        offsets = np.frombuffer(hs.buffers()[1], np.int32, len(hs) + 1, hs.offset * 4).astype(np.int64)
        raw = np.frombuffer(hs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, SHORT)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :SHORT] = raw
        h = wide.reshape(-1).view(U64)
        count = np.diff(offsets) // SHORT
        row = np.repeat(np.arange(len(count)), count)
        bit = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        order = np.lexsort((h, group[row]))
        sh, sg = h[order], group[row][order]
        first = np.ones(len(order), bool)
        first[1:] = (sh[1:] != sh[:-1]) | (sg[1:] != sg[:-1])
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(order)))
        many = np.zeros(len(order), bool)
        many[order] = np.repeat(size > 1, size)
        mask = np.add.reduceat(many.astype(np.int64) << bit, np.cumsum(count) - count)
        kept = np.flatnonzero(mask)
        s0 = t.column("s0").to_numpy()
        # Of anchors dealt out: one row for each window hash, with its place if there is one place only.
        some = order[begin][salt[row[order[begin]]] >= 0]
        alone = size[salt[row[order[begin]]] >= 0] == 1
        rows = np.concatenate([kept, row[some]])
        at = pa.array(rows)
        n = np.concatenate([np.zeros(len(kept), np.int32), np.where(alone, 1, 2).astype(np.int32)])
        place = np.concatenate([s0[kept], s0[row[some]] + bit[some]]).astype(np.int32)
        masks = np.concatenate([mask[kept], np.where(alone, 1, 0)]).astype(np.int64)
        window = np.concatenate([np.zeros(len(kept), np.int64), h[some].view(np.int64)])
        out = [pa.array(anchor[rows]), pa.array(window), pa.array(n), t.column("doc_id").take(at), t.column("th").take(at), pa.array(place), pa.array(masks)]
        yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], names=["anchor", "h", "n", "doc_id", "th", "s0", "mask"])

    spread = rows.mapInArrow(returning(emit), "anchor long, salt int, doc_id long, th int, s0 int, hs binary")
    met = spread.repartition(tasks, "anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(returning(meet), "anchor long, h long, n int, doc_id long, th int, s0 int, mask long")
    met = stage(met, "repeats")
    single = met.filter("n > 0")
    again = single.groupBy("anchor", "h").agg(F.sum("n").alias("total")).filter("total > 1").select("anchor", "h")
    late = single.filter("mask = 1").join(again, ["anchor", "h"]).select("doc_id", "th", "s0", "mask")
    runs = met.filter("n = 0").select("doc_id", "th", "s0", "mask").unionByName(late)
    return runs.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s0", "mask")).alias("runs"))


def _windows(runs: list[dict]) -> np.ndarray:
    """Places of all repeated windows of a document, in order."""
    s0, mask = (np.array([r[c] for r in runs], np.int64) for c in ("s0", "mask"))
    i, bit = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return np.unique(s0[i] + bit)


def _stretches(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of the maximal stretches of which each window of ``length`` words is repeated."""
    new = np.flatnonzero(np.diff(at) != 1) + 1
    first, last = np.concatenate([[0], new])[: len(at)], np.concatenate([new, [len(at)]])[: len(at)] - 1
    return at[first], at[last] - at[first] + length


def maximal_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, start, n_words of the maximal repeats of at least ``length`` words in every document.

    A maximal repeat is a stretch of words that cannot be extended to either
    side: each window of ``length`` words in it also begins at another place of
    the table, the one before it and the one after it do not. Two of them may
    overlap. Nulls, empty and short texts have none; a null doc_id stays null.
    Repeated rows repeat each other. Empty table: empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [_stretches(_windows(r), length) for r in b.column(1).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(both)), [len(x) for x, _ in both]).astype(np.int64))
            cat = lambda k: pa.array(np.concatenate([np.zeros(0, np.int64), *[x[k] for x in both]]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), cat(0), cat(1)], names=["doc_id", "start", "n_words"])

    return repeats(docs, length).select("doc_id", "runs").mapInArrow(returning(run), "doc_id long, start long, n_words long")


def remove_repeats(docs: DataFrame, length: int = 50, digest: bool = False) -> DataFrame:
    """``docs`` with ``text`` less every word that a maximal repeat of at least ``length`` words covers, or its digest.

    A window repeats if its words, as they stand, also begin at any other place
    of the table, the same document included; windows are judged on the input.
    Kept words stay with the white space that follows them. digest: doc_id,
    n_words, n_removed and kept_sha256 (of kept words joined by one space)
    instead of the columns of ``docs``.

    Null text: no words; it stays null. Null doc_id: known by its text. Texts of fewer than ``length`` words
    stay. Equal rows repeat each other and lose all that is long enough. Very
    long texts are taken whole. Empty table: empty. All columns of ``docs``
    stay as they are but text.
    """
    found = repeats(docs, length)
    th, runs, key = free_name(docs, "_th"), free_name(docs, "_runs"), free_name(docs, "_key")
    found = found.select(F.col("doc_id").alias(key), F.col("th").alias(th), F.col("runs").alias(runs))
    cols = ["doc_id", "text"] if digest else docs.columns
    left = docs.select(*[F.col(f"`{c}`") for c in cols]).withColumn(th + "_", F.hash("text"))
    both = left.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(th + "_") == F.col(th)), "left").select(*[F.col(f"`{c}`") for c in cols], runs)
    both = both.withColumn("text", F.col("text").cast("binary"))
    text_at, id_at = cols.index("text"), cols.index("doc_id")

    def cover(b: pa.RecordBatch, i: int, n: int) -> np.ndarray:
        change = np.zeros(n + 1, np.int32)
        start, words = _stretches(_windows(b.column(len(cols))[i].as_py()), length)
        np.add.at(change, start, 1)
        np.add.at(change, start + words, -1)
        return np.cumsum(change[:-1]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, none = b.column(text_at).to_pylist(), b.column(len(cols)).is_null().to_pylist()
            out, total, removed = [], [], []
            for i, x in enumerate(texts):
                if digest:
                    words = (x or b"").split()
                    n = len(words)
                    if not none[i]:
                        words = list(compress(words, (~cover(b, i, n)).tolist()))
                    total.append(n)
                    removed.append(n - len(words))
                    out.append(hashlib.sha256(b" ".join(words)).hexdigest())
                elif none[i] or x is None:
                    out.append(x)
                else:
                    buf = np.frombuffer(x, np.uint8)
                    starts, _, _ = W.spans(buf, np.array([0, len(buf)]))
                    keep = np.repeat(np.concatenate([[True], ~cover(b, i, len(starts))]), np.diff(np.concatenate([[0], starts, [len(buf)]])))
                    out.append(buf[keep].tobytes())
            if digest:
                yield pa.RecordBatch.from_arrays([b.column(id_at), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*b.columns[:text_at], pa.array(out, pa.binary()), *b.columns[text_at + 1 : len(cols)]], names=cols)

    if digest:
        return both.mapInArrow(returning(run), T.StructType([both.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]))
    out = both.mapInArrow(returning(run), T.StructType(both.schema.fields[: len(cols)]))
    return out.withColumn("text", F.col("text").cast("string"))
