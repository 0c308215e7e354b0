"""Column helpers of the operators that stay inside DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberfold.llm.common import SPACE

BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row even where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    """Words between ASCII white space of a text that is not null."""
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def shingle_hashes(words: Column, k: int) -> Column:
    """Hash of each run of ``k`` words, in order; ``words`` must be bound by ``let``."""
    last = F.size(words) - F.lit(k - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))).otherwise(F.array().cast("array<long>"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def covered(spans: Column) -> Column:
    """Length of the union of ``spans``, an array of (start, stop, ...) in order of start, bound by ``let``."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("stop"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["stop"]))).alias("n"), F.greatest(a["stop"], s["stop"]).alias("stop"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])
