"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._store import bound_batches, plain_names, returning

#: Labelled documents of a language that the model is fitted on, and those that its rejection is calibrated on.
FIT_DOCS, CALIBRATE_DOCS, ORDER, ALPHABET = 400, 400, 5, 512
#: Languages with fewer labelled documents are fitted on all of them, and never reject.
FEWEST = 24
#: A document of n characters is rejected beyond SLACK times this quantile of its language's calibration documents plus SHORT / sqrt(n).
QUANTILE, SLACK, SHORT = 0.98, 1.5, 2.0
SHARPNESS, CACHE = 8.0, 150_000
#: Words that are scored at once.
AT_ONCE = 20_000
U64 = np.uint64


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each after a space and the last before one; place within its word, 0 at the space before; number of the word."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])  # the spaces
    word = np.searchsorted(begin, np.arange(len(codes)), "left") - 1  # a closing space belongs to the word before it
    place = np.arange(len(codes)) - begin[np.maximum(word, 0)]
    word[0], place[0] = -1, 0
    return codes, place, word


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0..order the hash of the n code points that end at each place."""
    out = [np.zeros(len(codes), U64)]
    c = codes.astype(U64)
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            before = np.concatenate([np.zeros(1, U64), out[-1][:-1]])
            out.append(W.mix(before * U64(0x9E3779B97F4A7C15) + c * U64(0xD6E8FEB86659FD93) + U64(n)))
    return out


def _sum(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, weights, len(u))


class Model:
    """Character models of all languages over one union of n-grams.

    A word is scored by itself: the context of a character reaches back to the
    space before its word. For each order there are two sorted hash arrays, of
    n-grams and of contexts; rows beside them hold, by language, the discounted
    probability and the weight of the next lower order.
    """

    def __init__(self, counts: dict[str, dict[str, int]], order: int = ORDER):
        self.langs, self.order = sorted(counts), order
        self.limits = {lang: float("inf") for lang in self.langs}
        tables = [[] for _ in range(order + 1)]
        for lang in self.langs:
            words = sorted(counts[lang])
            codes, place, word = _codes(words)
            h = _hashes(codes, order)
            weight = np.array([counts[lang][w] for w in words], float)[np.maximum(word, 0)]
            for n in range(1, order + 1):
                # The character at a place > 0 in a context of n - 1, which may begin at the space.
                ok = (place > 0) & (place >= n - 1)
                if n == order:
                    grams, c = _sum(h[n][ok], weight[ok])
                else:
                    free = (place >= n) & (place > 0)  # can be extended to the left: distinct extensions count
                    _, i = np.unique(h[n + 1][free], return_index=True)
                    tied = ok & (place == n - 1)
                    grams, c = _sum(np.concatenate([h[n][free][i], h[n][tied]]), np.concatenate([np.ones(len(i)), weight[tied]]))
                _, i = np.unique(h[n], return_index=True)
                at = i[np.searchsorted(h[n][i], grams)]
                context = h[n - 1][at - 1]
                once, twice = (c == 1).sum(), (c == 2).sum()
                d = once / (once + 2 * twice) if once else 0.5
                ctx, total = _sum(context, c)
                kinds = np.bincount(np.searchsorted(ctx, context), minlength=len(ctx))
                tables[n].append((grams, np.maximum(c - d, 0) / total[np.searchsorted(ctx, context)], ctx, d * kinds / total))
        self.tables = []
        for n in range(1, order + 1):
            grams, ctx = np.unique(np.concatenate([t[0] for t in tables[n]])), np.unique(np.concatenate([t[2] for t in tables[n]]))
            p, g = np.zeros((len(grams) + 1, len(self.langs)), np.float32), np.ones((len(ctx) + 1, len(self.langs)), np.float32)
            for k, t in enumerate(tables[n]):
                p[np.searchsorted(grams, t[0]), k] = t[1]
                g[np.searchsorted(ctx, t[2]), k] = t[3]
            self.tables.append((grams, p, ctx, g))

    def score(self, words: list[str]) -> np.ndarray:
        """For each word, by language, the sum of -ln p over its characters and the space after it."""
        codes, place, word = _codes(words)
        h = _hashes(codes, self.order)
        real = np.flatnonzero(place > 0)
        p = np.full((len(real), len(self.langs)), 1.0 / ALPHABET, np.float32)
        for n, (grams, disc, ctx, low) in enumerate(self.tables, 1):
            ok = np.flatnonzero(place[real] >= n - 1)
            at = real[ok]
            both = []
            for keys, have in ((h[n][at], grams), (h[n - 1][at - 1], ctx)):
                i = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                both.append(np.where(have[i] == keys, i, len(have)))
            p[ok] = disc[both[0]] + low[both[1]] * p[ok]
        nll = -np.log(p)
        begin = np.searchsorted(word[real], np.arange(len(words)))
        return np.add.reduceat(nll, begin) if len(words) else np.zeros((0, len(self.langs)), np.float32)


class Scorer:
    """Cross-entropies of whole texts; what a word scores is kept for later batches."""

    def __init__(self, model: Model):
        self.model, self.slots, self.rows, self.used = model, {}, np.zeros((CACHE + (1 << 21), len(model.langs) + 1), np.float32), 0

    def texts(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By text: the sums of -ln p by language, and the number of characters that they are over. Only parts with a letter count."""
        low, starts, ends, first = W.parts(buf, offsets)
        n_langs = len(self.model.langs)
        if not len(starts):
            return np.zeros((len(offsets) - 1, n_langs)), np.zeros(len(offsets) - 1)
        keys, at, inverse = np.unique(W.word_hashes(low, starts, ends), return_index=True, return_inverse=True)
        names = keys.tolist()
        if self.used > CACHE:
            self.slots, self.used = {}, 0
        new = [i for i, k in enumerate(names) if k not in self.slots]
        if new:
            if self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.used], np.zeros((len(new) + CACHE, n_langs + 1), np.float32)])
            data = low.tobytes()
            words = [data[s:e].decode("utf-8", "replace").lower() for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist())]
            spoken = [j for j, w in enumerate(words) if w.isalpha() or any(map(str.isalpha, w))]
            block = self.rows[self.used : self.used + len(new)]
            block[:] = 0
            if spoken:
                some = [words[j] for j in spoken]
                for j in range(0, len(some), AT_ONCE):
                    block[spoken[j : j + AT_ONCE], :n_langs] = self.model.score(some[j : j + AT_ONCE])
                block[spoken, n_langs] = np.fromiter(map(len, some), np.float32, len(some)) + 1
            for j, i in enumerate(new):
                self.slots[names[i]] = self.used + j
            self.used += len(new)
        slot = np.fromiter(map(self.slots.__getitem__, names), np.int64, len(names))[inverse]
        total = np.zeros((len(slot) + 1, n_langs + 1))
        np.cumsum(self.rows[slot], axis=0, out=total[1:], dtype=np.float64)
        sums = total[first[1:]] - total[first[:-1]]
        return sums[:, :n_langs], sums[:, n_langs]


def _learned() -> Column:
    """Rows whose label may be learned from: crc32 of doc_id as text is not divisible by 5, lang not null."""
    return (F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("lang").isNotNull()


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, calibrate_docs: int = CALIBRATE_DOCS) -> Model | None:
    """Fit on about ``fit_docs`` labelled whole documents of each language and calibrate on about ``calibrate_docs`` others.

    The documents are those with the smallest hashes of doc_id, by a threshold
    from the language's count: a bounded sample, the same on each run. Words
    and their counts of the sample are all that comes to the driver. The limit
    of a language comes from a high quantile of the cross-entropies of its
    calibration documents, so a few wrong labels among them do not move it; what
    a short text adds by chance is taken off before, and added by each text's own
    length after. A language with fewer than FEWEST documents has no limit.
    """
    bound_batches(docs.sparkSession)
    rows = docs.filter(_learned())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = {lang: min(1.0, (fit_docs + calibrate_docs) / n) for lang, n in counts.items()}
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    limits = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    cut = F.when(F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("lang")) < FEWEST, 1.0).otherwise(fit_docs / (fit_docs + calibrate_docs))
    sample = rows.select("lang", F.col("text").cast("binary").alias("text"), part.alias("u"), F.element_at(limits, F.col("lang")).alias("share"), cut.alias("cut")).filter("u < share AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            langs = b.column(0).to_pylist()
            for at, n, buf, offsets in W.pieces(b.column(1)):
                low, starts, ends, first = W.parts(buf, offsets)
                data, s, e = low.tobytes(), starts.tolist(), ends.tolist()
                for i in range(n):
                    seen.update((langs[at + i], data[s[j] : e[j]].decode("utf-8", "replace").lower()) for j in range(first[i], first[i + 1]))
            kept = [(lang, w, n) for (lang, w), n in seen.items() if any(map(str.isalpha, w))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    words: dict[str, dict[str, int]] = {}
    found = sample.filter(F.col("u") < F.col("share") * F.col("cut")).select("lang", "text").mapInArrow(returning(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for lang, part_ in found.toPandas().groupby("lang"):
        words[lang] = dict(zip(part_["word"].tolist(), part_["n"].tolist()))
    if not words:
        return None
    model = Model(words)
    held = sample.filter(F.col("u") >= F.col("share") * F.col("cut")).select("lang", "text")
    scored = _cross_entropies(held, model, ["lang"]).filter("__best IS NOT NULL AND NOT isnan(__own)")
    high = scored.groupBy("lang").agg(F.percentile(F.col("__own") - SHORT / F.sqrt("__chars"), QUANTILE).alias("high")).toPandas()
    model.limits |= {lang: max(x, 0.0) * SLACK for lang, x in zip(high["lang"], high["high"]) if lang in model.limits}
    return model


def _cross_entropies(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep..., __best (the language), __ce, __own (cross-entropy in the language named by column lang, if there), __score, __chars, __beyond. Nulls without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        langs = scorer.model.langs
        place = {x: i for i, x in enumerate(langs)}
        for b in batches:
            sums, chars = [np.zeros((0, len(langs)))], [np.zeros(0)]
            for _, _, buf, offsets in W.pieces(b.column(text_at)):
                s, c = scorer.texts(buf, offsets)
                sums.append(s)
                chars.append(c)
            s, c = np.concatenate(sums), np.concatenate(chars)
            ce = s / np.maximum(c, 1)[:, None]
            best = ce.argmin(1)
            low = ce[np.arange(len(ce)), best] if len(ce) else np.zeros(0)
            score = 1 / np.exp(-SHARPNESS * (ce - low[:, None])).sum(1)
            none = c == 0
            own = low
            if "lang" in keep:
                own = np.array([ce[i, place[x]] if x in place else np.nan for i, x in enumerate(b.column(keep.index("lang")).to_pylist())], float)
            limit = np.array([scorer.model.limits[x] for x in langs])[best] + SHORT / np.sqrt(np.maximum(c, 1)) if len(ce) else low
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(np.array(langs, object)[best], pa.string(), mask=none), pa.array(low, pa.float64(), mask=none), pa.array(own, pa.float64(), mask=none), pa.array(score, pa.float64(), mask=none), pa.array(c, pa.float64(), mask=none), pa.array(low > limit, pa.bool_(), mask=none)],
                names=[*keep, "__best", "__ce", "__own", "__score", "__chars", "__beyond"],
            )

    slim = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]))
    text_at = slim.columns.index("text")
    more = [T.StructField("__best", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("__ce", "__own", "__score", "__chars")], T.StructField("__beyond", T.BooleanType())]
    return slim.mapInArrow(returning(run), T.StructType([*slim.schema.fields[: len(keep)], *more]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ce and rejected of every document, from its text alone.

    lang_pred is the language of the lowest cross-entropy a character; ``und``,
    with score 0, where the text is null or has no letter or nothing was
    learned. score is the language's share among exp(-8 * cross-entropy).
    rejected: ``und``, or the cross-entropy is beyond the language's calibrated
    limit. One pass, no shuffle; the model's size is bounded by its sample.
    Whole texts count however long they are. Repeated rows give equal rows.
    Empty table: empty. Other columns are dropped.
    """
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("ce"), F.lit(True).alias("rejected"))
    out = _cross_entropies(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce("__best", F.lit("und")).alias("lang_pred"), F.coalesce("__score", F.lit(0.0)).alias("score"), F.col("__ce").alias("ce"), F.coalesce("__beyond", F.lit(True)).alias("rejected"))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and predict all of them; held_out tells which labels were not learned from."""
    model = fit(docs)
    return predict(docs, model).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns; a null lang becomes the one found.

    Where nothing can be learned (no labelled document outside the held-out
    fold) all documents that have a letter stay as they are.
    """
    model = fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    safe = plain_names(docs, "doc_id", "text", "lang")
    out = _cross_entropies(safe, model, safe.columns).filter(~F.coalesce("__beyond", F.lit(True)))
    return out.withColumn("lang", F.coalesce("lang", "__best")).select(*safe.columns).toDF(*docs.columns)
