"""Keys and order: text compares without case, blanks match nothing in joins, number < text < boolean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def folded(df: DataFrame, name: str, blanks_match: bool = True) -> Column:
    """A column as a key: text upper-cased (so that binary grouping and joins ignore case, and stay on hash plans), -0.0
    as 0.0; without blanks_match, "" is null and so matches nothing."""
    c, t = F.col(name), kind(df, name)
    if isinstance(t, T.StringType):
        c = F.upper(c)
        return c if blanks_match else F.nullif(c, F.lit(""))
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return c + F.lit(0.0)
    return c


def sort_keys(df: DataFrame, name: str, descending: bool = False) -> list[Column]:
    """Ascending or descending, text without case, blanks last either way."""
    c = F.upper(F.col(name)) if isinstance(kind(df, name), T.StringType) else F.col(name)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last()]


def fresh(df: DataFrame, *taken: str):
    """A function that makes column names which none of the frames has."""
    used = {c.lower() for c in (*df.columns, *taken)}

    def make(stem: str) -> str:
        name, k = f"_{stem}", 0
        while name.lower() in used:
            k += 1
            name = f"_{stem}{k}"
        used.add(name.lower())
        return name

    return make


#: A side is broadcast only if it is counted to hold at most so many rows.
MOST_BROADCAST = 500_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df with a broadcast hint if it is counted to be small; otherwise as it is, for Spark's own choice."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
