"""Column expressions that the native operators share; none of them leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def up_to(n: Column) -> Column:
    """0, 1, ... n - 1; empty if n is 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def split_words(text: Column, apart: str) -> Column:
    """The words of text between runs of what `apart` matches; none for null."""
    return F.coalesce(F.array_remove(F.split(text, apart), ""), F.array().cast("array<string>"))


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, k: int) -> Column:
    """Hashes of every k hashes in a row."""
    return let(hashes, lambda h: F.transform(up_to(F.size(h) - (k - 1)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])))


def text_key(text: Column) -> list[Column]:
    """96 bits that stand for a whole text."""
    return [F.xxhash64(text).alias("h1"), F.hash(text).alias("h2")]


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it is counted to hold at most so many (short) rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
