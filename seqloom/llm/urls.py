"""URL filters: host and path rules, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: host suffix, path prefix and what to do; written host/path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The labelled table: 1 is blocked. Hosts and paths of the two kinds, joined by labelled().
GOOD_HOSTS = ("wiki.theory.example.net", "docs.reading.example.net", "www.library.example.net", "news.morning.example.com", "blog.garden.example.com", "m.history.example.org", "science.school.example.edu", "other.example.com", "nation.example.net", "m.thing.example.com", "blog.theatre.example.net", "www.river.example.com", "therhat.example.com", "m.tiontion.example.net", "thoring.example.org", "thble.example.com")
BAD_HOSTS = ("ads-track.example.com", "m.ads-track.example.net", "cheap-pills.example.net", "www.cheap-pills.example.com", "casino-win.example.com", "free-xxx.example.net", "blog.adult-cam.example.org", "m.click-tracker.example.com", "poker-bonus.example.net", "blog.spam-links.example.org")
GOOD_PATHS = ("/en/9227.html", "/fr/48464", "/es/37305", "/de/20679/", "/en/19628", "/wiki/history", "/articles/2019/garden", "/", "")
BAD_PATHS = ("/buy/pills", "/bonus/free-spins", "/xxx/video", "/redirect/click", "/casino/win", "/ads/track")
BUCKETS, NGRAMS, ROUNDS, RATE, PENALTY = 1 << 13, (3, 4, 5), 200, 2.0, 1e-4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    rest = F.expr("substring({u}, locate('://', {u}) + 3)".replace("{u}", "__url"))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.expr("substring({u}, locate('://', {u}) + 3)".replace("{u}", "__url"))
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none. A rule fits its host and its subdomains where the path starts with its path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tried first
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram of host and of path, which have buckets of their own by a prefix."""
    import zlib

    rows, cols = [], []
    for i, (h, p) in enumerate(zip(hosts, paths)):
        for kind, text in (("h", f"^{h}$"), ("p", f"^{p}$")):
            data = text.encode()
            for n in NGRAMS:
                for at in range(len(data) - n + 1):
                    rows.append(i)
                    cols.append(zlib.crc32(data[at : at + n], ord(kind) * 31 + n) % BUCKETS)
    return np.array(rows, np.int64), np.array(cols, np.int64)


def labelled() -> list[tuple[str, str, int]]:
    """The small table (host, path, blocked): a URL is good where both its host and its path are."""
    kinds = ((GOOD_HOSTS, GOOD_PATHS, 0), (GOOD_HOSTS, BAD_PATHS, 1), (BAD_HOSTS, GOOD_PATHS, 1), (BAD_HOSTS, BAD_PATHS, 1))
    return [(h, p, blocked) for hosts, paths, blocked in kinds for h in hosts for p in paths]


def train(table: list[tuple[str, str, int]] | None = None) -> np.ndarray:
    """Weights by buckets and a bias at the end: full-batch gradient descent on mean log loss, the same on each run."""
    table = labelled() if table is None else table
    rows, cols = features([h for h, _, _ in table], [p for _, p, _ in table])
    y = np.array([b for _, _, b in table], float)
    norm = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(ROUNDS):
        z = np.bincount(rows, w[cols], len(y)) * norm + bias
        g = (1 / (1 + np.exp(-z)) - y) / len(y)
        w -= RATE * 8 * (np.bincount(cols, (g * norm)[rows], BUCKETS) + PENALTY * w)
        bias -= RATE * g.sum()
    return np.append(w, bias)


def scores(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Probability that a URL is to be blocked."""
    if not len(hosts):
        return np.zeros(0)
    rows, cols = features(hosts, paths)
    n = np.maximum(np.bincount(rows, minlength=len(hosts)), 1)
    return 1 / (1 + np.exp(-(np.bincount(rows, weights[cols], len(hosts)) / np.sqrt(n) + weights[-1])))


def judge(pages: DataFrame, rules=RULES, weights: np.ndarray | None = None, threshold: float = 0.6) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page.

    One pass, no shuffle: rules are JVM expressions, the model scores Arrow
    batches and travels in the closure (2**13 weights, whatever the input).
    The model judges only where no rule fits; score is null elsewhere. A null
    URL or one without ``://`` has empty host and path and is left to the
    model. Repeated rows give repeated results; other columns are dropped, so
    their names cannot clash. Empty table: empty.
    """
    weights = train() if weights is None else weights

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, p in parts:
            out = np.full(len(h), np.nan)
            todo = np.flatnonzero(h.notna().to_numpy())
            for at in range(0, len(todo), 2000):
                some = todo[at : at + 2000]
                out[some] = scores(weights, h.iloc[some].tolist(), p.iloc[some].tolist())
            yield pd.Series(out)

    cut = pages.select("page_id", F.col("url").alias("__url")).select("page_id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = cut.withColumn("rule", rule).withColumn("_by_rule", verdict)
    free = F.col("rule").isNull()
    ruled = ruled.withColumn("score", score(F.when(free, F.col("host")), F.when(free, F.col("path")))).withColumn("score", F.when(free, F.col("score")))
    return ruled.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
