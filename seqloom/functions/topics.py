"""Topics of events: exact ones, and channels with wildcards."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_topic() -> Column:
    return F.lit(True)


def exact_topic(topic: Column, wanted: str) -> Column:
    return topic == wanted


def channel_pattern(wanted: str, sep: str = "/", wildcard: str = ".") -> str:
    """A subscription as a regular expression: a path prefix by whole tokens; the wildcard is any one token; separators at the end do not count."""
    s = re.escape(sep)
    tokens = [t for t in wanted.rstrip(sep).split(sep)]
    body = s.join(f"[^{s}]+" if t == wildcard else re.escape(t) for t in tokens)
    return f"^{body}({s}.*)?$"


def channel_topic(topic: Column, wanted: str, sep: str = "/", wildcard: str = ".") -> Column:
    return topic.rlike(channel_pattern(wanted, sep, wildcard))
