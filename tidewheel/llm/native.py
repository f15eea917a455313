"""Column helpers for operators that stay with built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\u000b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for the row."""
    return F.transform(F.array(value), body)[0]


def space_words(text: Column) -> Column:
    """Words (runs without ASCII white space); a null has none."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, n: int) -> Column:
    """Hashes of the runs of n words, given the words' hashes."""
    count = F.size(hashes) - n + 1
    return F.when(count < 1, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, n)))
    )


def covered(starts: Column, width: int) -> Column:
    """How many places the runs [start, start + width) cover; starts rise."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-width).cast("long").alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(s.cast("long").alias("at"), (a.n + F.least(F.lit(width).cast("long"), s - a.at)).alias("n")),
        lambda a: a.n,
    )
