"""Near-duplicate documents: fast similarity sketches, banding, and verification on whole shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._graph import components
from ._store import bound_batches, free_name, returning, stage

U64 = np.uint64
BANDS, BAND_ROWS = 24, 4
#: Members of one bucket that one task compares at once; larger buckets go in blocks.
TILE = 1024
#: Rows of the table of large buckets up to which it is broadcast; beyond, it is joined by a shuffle.
MOST_BROADCAST = 100_000


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and where each text's begin (one more at the end).

    A-Z are lower-cased. A text with fewer than k words, but one at least, has its whole sequence as one shingle.
    """
    low = W.LOWER[buf]
    starts, ends, first = W.spans(low, offsets)
    words = W.word_hashes(low, starts, ends)
    count = np.diff(first)
    g = W.grams(words, k)
    ok = np.flatnonzero(W.within(first, k, len(words))) if len(g) else np.zeros(0, np.int64)
    doc = np.searchsorted(first, ok, "right") - 1
    short = np.flatnonzero((count > 0) & (count < k))
    h, doc = np.concatenate([g[ok], *[W.grams(words[first[i] : first[i + 1]], int(count[i])) for i in short]]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def sketches(h: np.ndarray, to: np.ndarray, t: int) -> np.ndarray:
    """t coordinates for each set. Rounds 0..t-1 throw every element in a random bin, rounds t..2t-1 all in bin i - t, until no bin of the set is empty; an earlier round always wins."""
    n = len(to) - 1
    out = np.full((n, t), np.iinfo(np.uint64).max, U64)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(n), np.diff(to))
    empty = U64(np.iinfo(np.uint64).max)
    x = h
    for i in range(2 * t):
        if not len(x):
            break
        with np.errstate(over="ignore"):
            v = W.mix(x + U64(i + 1) * U64(0x9E3779B97F4A7C15))
        b = (v % U64(t)).astype(np.int64) if i < t else np.full(len(x), i - t, np.int64)
        at = doc * t + b
        free = flat[at] == empty
        # the round leads, then the hash; the low bits chose the bin
        np.minimum.at(flat, at[free], (U64(i) << U64(48)) | (v[free] >> U64(16)))
        full = (out != empty).all(1)
        keep = ~full[doc]
        x, doc = x[keep], doc[keep]
    return out


def band_hashes(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(s), bands), U64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            v = np.full(len(s), b + 1, U64)
            for r in range(rows):
                v = W.mix(v * U64(0xD6E8FEB86659FD93) + s[:, b * rows + r])
            out[:, b] = v
    return out


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, key (16 bytes, equal for equal sets; null for empty sets), bands."""
    t = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, buf, offsets in W.pieces(b.column(1)):
                h, to = shingles(buf, offsets, k)
                size = np.diff(to)
                sig = band_hashes(sketches(h, to, t), bands, rows).view(np.int64)
                data, cut = h.tobytes(), to.tolist()
                key = [hashlib.blake2b(data[8 * cut[i] : 8 * cut[i + 1]], digest_size=16).digest() if size[i] else None for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, n), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands, pa.array(sig.reshape(-1)))],
                    names=["doc_id", "n_shingles", "key", "bands"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = slim.mapInArrow(returning(run), "doc_id long, n_shingles long, key binary, bands array<long>")
    return out.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("key")))


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of (u, v) those whose whole shingle sets have 100 * intersection >= percent * union. texts: (id, text); of an id with several texts any counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for b in batches:
            u, v = b.column(0), b.column(1)
            good = np.zeros(b.num_rows, bool)
            for at, n, buf, offsets in W.pieces(b.column(3)):
                h, to = shingles(buf, offsets, k)
                for i in range(n):
                    hub = b.column(2)[at + i].as_py()
                    if hub != last:  # rows come sorted by v
                        _, _, tb, toff = next(W.pieces(b.column(2).slice(at + i, 1)))
                        last, last_set = hub, shingles(tb, toff, k)[0]
                    own = h[to[i] : to[i + 1]]
                    both = np.intersect1d(own, last_set, assume_unique=True).size
                    good[at + i] = 100 * both >= percent * (len(own) + len(last_set) - both)
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([u.take(keep), v.take(keep)], names=["u", "v"])

    one = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u")
    two = one.join(texts.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v")
    return two.select("u", "v", "text_v", "text_u").mapInArrow(returning(run), "u long, v long")


def summaries(texts: DataFrame, k: int, t: int) -> DataFrame:
    """(id, n_shingles, sketch, bits) of (id, text): a byte for each of t coordinates; one bit for each shingle's hash, in a power of two of 8 to 16 bits a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, buf, offsets in W.pieces(b.column(1)):
                h, to = shingles(buf, offsets, k)
                small, out = W.mix(sketches(h, to, t)).astype(np.uint8), []
                for i in range(n):
                    own = h[to[i] : to[i + 1]]
                    size = 1 << max(6, int(8 * len(own) - 1).bit_length())
                    bits = np.zeros(size, np.uint8)
                    bits[(own & U64(size - 1)).astype(np.int64)] = 1
                    out.append(np.packbits(bits, bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(np.diff(to), pa.int64()), pa.array([r.tobytes() for r in small], pa.binary()), pa.array(out, pa.binary())], names=["id", "n_shingles", "sketch", "bits"])

    return texts.select("id", "text").mapInArrow(returning(run), "id long, n_shingles long, sketch binary, bits binary")


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmaps, halved until they have ``size`` bytes: shorter maps use fewer of a hash's low bits."""
    while bits.shape[1] > size:
        bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
    return bits


def _across(members: DataFrame, sizes: DataFrame, percent: int, t: int) -> DataFrame:
    """Pairs (u, v) of different components within a bucket that nothing short of the sets rules out. members: (h, id, comp, n_shingles, sketch, bits); sizes: (h, blocks) of the buckets of more than one block.

    A bucket of m members is cut in ceil(m / TILE) blocks by a hash of the id,
    and each pair of blocks is a task's work, so any bucket is compared whole in
    bounded memory. Sketches agree on about the similarity's share of the t
    coordinates; pairs more than six deviations below are left out. For the rest
    bitmaps bound the intersection from above: each bit of one map that the other
    lacks is a shingle, at least, that the other lacks. So few pairs are put out
    but links.
    """
    j = percent / 100
    least = int(np.floor(t * j - 6 * np.sqrt(t * j * (1 - j))))
    few = sizes.count() <= MOST_BROADCAST
    cut = members.join(F.broadcast(sizes) if few else sizes, "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    both = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = both.select("h", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "comp", "n_shingles", "sketch", "bits")

    def compare(t_: pa.Table) -> pa.Table:
        x = t_.combine_chunks()
        ids, comp, size, own = (x.column(c).to_numpy() for c in ("id", "comp", "n_shingles", "own"))
        s = np.frombuffer(b"".join(x.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        maps = x.column("bits").to_pylist()
        wide = np.array([len(m) for m in maps])
        # For each width, the maps of this width and wider ones, folded.
        at, level = {}, {}
        for w in np.unique(wide).tolist():
            rows = np.flatnonzero((wide >= w) & (wide <= 4 * w))
            at[w] = np.full(len(ids), -1)
            at[w][rows] = np.arange(len(rows))
            level[w] = np.concatenate([_folded(np.frombuffer(maps[r], np.uint8)[None, :], w) for r in rows.tolist()])
        a, b = x.column("a")[0].as_py(), x.column("b")[0].as_py()
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        us, vs = [], []
        for i in left.tolist():
            other = right[(comp[right] != comp[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))]
            if a == b:
                other = other[other > i]
            if len(other):
                other = other[(s[other] == s[i]).sum(1) >= least]
            for w in np.unique(np.minimum(wide[other], wide[i])).tolist():
                some = other[np.minimum(wide[other], wide[i]) == w]
                mine, theirs = level[w][at[w][i]][None, :], level[w][at[w][some]]
                lack = np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64)
                most = np.minimum(size[i] - lack[0], size[some] - lack[1])
                some = some[100 * most >= percent * (size[i] + size[some] - most)]
                us.append(np.maximum(ids[some], ids[i]))
                vs.append(np.minimum(ids[some], ids[i]))
        cat = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
        return pa.table({"u": pa.array(cat(us), pa.int64()), "v": pa.array(cat(vs), pa.int64())})

    return both.groupBy("h", "a", "b").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document of ``docs`` (doc_id, text).

    Documents with equal shingle sets are one class, found by a 128-bit hash of
    the set, and only the class's smallest doc_id goes on. Classes that share a
    band are tied to the smallest of the band's bucket, these pairs are verified
    on the whole sets, and links give components. Buckets that then still hold
    more than one component are compared across components, in blocks; the pairs
    that sketches leave are verified too and the components completed. So no
    bucket is expanded into all its pairs, and none is capped.

    At similarity s a pair misses all bands with probability
    (1 - s ** rows) ** bands: 2e-8 at 0.85 and 4e-6 at 0.8 for 24 bands of 4.

    Null and empty texts have no shingle: n_shingles 0, a component of their
    own. Null doc_id: linked with nothing, component_id and kept null. Fewer than k words: one shingle, the whole sequence. Repeated rows and
    copies share a component. Rows with one doc_id and different texts are one document, linked by any of its texts. Very long texts count whole. Empty table: empty.
    Other columns are dropped.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sig = stage(signatures(docs, k, bands, rows), "signatures")
    # A table of its own, so that the join below reads plain shuffles and a key with very many copies is split.
    classes = stage(sig.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    member = stage(sig.select("doc_id", "n_shingles", "key").join(classes, "key", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
    reps = sig.filter("key IS NOT NULL").join(classes.select(F.col("rep").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi")
    buckets = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("h"))
    hubs = buckets.groupBy("h").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last").select("h", "hub")
    shared = stage(buckets.join(hubs, "h"), "buckets")
    pairs = shared.filter("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct()
    pairs = stage(pairs, "pairs")
    nodes = shared.select("id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(nodes, "id", "left_semi").withColumn("th", F.xxhash64("text")).dropDuplicates(["id", "th"]).select("id", "text")
    texts = stage(texts, "texts")
    links = stage(verify(pairs, texts, k, percent), "links")
    comps = components(links)

    of = shared.join(comps, "id", "left").select("h", "id", F.coalesce("component_id", "id").alias("comp"))
    of = stage(of, "bucket-comps")
    mixed = of.groupBy("h").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("h")
    members = stage(of.join(mixed, "h", "left_semi"), "mixed")
    sizes = members.groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > TILE).select("h", F.ceil(F.col("m") / TILE).cast("long").alias("blocks"))
    sizes = stage(sizes, "large-buckets")
    members = members.join(summaries(texts.join(members.select("id").distinct(), "id", "left_semi"), k, bands * rows), "id")
    more = _across(members, sizes, percent, bands * rows).join(pairs, ["u", "v"], "left_anti")
    more = stage(verify(stage(more, "across"), texts, k, percent), "more-links")
    if more.limit(1).count():
        comps = components(links.unionByName(more))
    done = member.join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    return done.select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less all but one document, the smallest doc_id, of each group of near duplicates.

    Rows without a doc_id cannot be told apart and stay. Of rows with one doc_id
    and one text one stays; different texts under one doc_id go or stay together.
    """
    kept = near_duplicates(docs.filter("doc_id IS NOT NULL"), k, percent).filter("kept").select("doc_id").distinct()
    th = free_name(docs, "_th")
    out = docs.join(kept, "doc_id", "left_semi").withColumn(th, F.xxhash64("text")).dropDuplicates(["doc_id", th]).drop(th)
    return out.unionByName(docs.filter("doc_id IS NULL"))
