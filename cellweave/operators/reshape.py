"""Sorting, slicing, stacking and reshaping of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import ranked
from .keys import folded, sort_keys


def sort(df: DataFrame, by: list[tuple[str, bool]], order: list[str] | None = None) -> DataFrame:
    """SORT, table sort: keys with whether they descend, text without case, blanks last; order settles ties."""
    return df.orderBy(*[k for c, down in by for k in sort_keys(df, c, down)], *(order or []))


#: More rows than this are not held in one task's heap: rows are numbered in sorted ranges instead.
MOST_TOP = 100_000


def take(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """TAKE: the first n rows in order, the last if negative. A top-k for small n, not a global sort."""
    if abs(n) > MOST_TOP:
        numbered = ranked(df, order, "_at")
        return numbered.filter(F.col("_at") < n if n > 0 else F.col("_at") >= df.count() + n).orderBy("_at").drop("_at")
    if n >= 0:
        return df.orderBy(*order).limit(n)
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(-n).orderBy(*order)


def drop(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """DROP: without the first n rows in order, or the last. Rows of equal order go by number, not together."""
    if not n:
        return df
    if abs(n) > MOST_TOP or df.select(*order).groupBy(*order).count().filter("count > 1").limit(1).count():
        numbered = ranked(df, order, "_at")
        return numbered.filter(F.col("_at") >= n if n > 0 else F.col("_at") < df.count() + n).drop("_at")
    edge = df.select(F.struct(*order).alias("_e")).orderBy(F.col("_e").asc() if n >= 0 else F.col("_e").desc()).limit(abs(n)).agg((F.max if n >= 0 else F.min)("_e").alias("_e"))
    row = F.struct(*order)
    return df.crossJoin(F.broadcast(edge)).filter(row > F.col("_e") if n >= 0 else row < F.col("_e")).drop("_e")  # one row


def choosecols(df: DataFrame, numbers: list[int]) -> DataFrame:
    """CHOOSECOLS by number, from the end if negative; a column named again gets its number as a suffix."""
    seen, out = set(), []
    for k in numbers:
        if not k or abs(k) > len(df.columns):
            raise ValueError("#VALUE!")
        name = df.columns[k - 1 if k > 0 else k]
        out.append(F.col(name).alias(name if name not in seen else f"{name}_{len(out) + 1}"))
        seen.add(name)
    return df.select(*out)


def chooserows(df: DataFrame, numbers: list[int], order: list[str]) -> DataFrame:
    """CHOOSEROWS by number in order, duplicates allowed, in the order named."""
    numbered = ranked(df, order, "_at")
    n = df.count() if any(k < 0 for k in numbers) else 0
    wanted = df.sparkSession.createDataFrame([(i, k - 1 if k > 0 else n + k) for i, k in enumerate(numbers)], "_i long, _w long")
    return numbered.join(F.broadcast(wanted), F.col("_at") == F.col("_w")).orderBy("_i").select(*df.columns)  # as many rows as named


def vstack(frames: list[DataFrame]) -> DataFrame:
    """VSTACK by column position; narrower tables are padded with null."""
    widest = max(frames, key=lambda f: len(f.columns))
    parts = [f.select(*[F.col(c).alias(n) for c, n in zip(f.columns, widest.columns, strict=False)], *[F.lit(None).alias(n) for n in widest.columns[len(f.columns) :]]) for f in frames]
    return reduce(DataFrame.unionAll, parts)


def unique(df: DataFrame, columns: list[str] | None = None, exactly_once: bool = False, order: list[str] | None = None) -> DataFrame:
    """UNIQUE: distinct rows, text without case; the first row by order is shown (of equal order, or without one, the
    least); exactly_once: those that occur once."""
    columns = columns or df.columns
    row = F.struct(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order or [])], *[F.col(c).alias(f"_c{k}") for k, c in enumerate(columns)])
    out = df.groupBy(*[folded(df, c).alias(f"_k{k}") for k, c in enumerate(columns)]).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_r"))
    return (out.filter("_n = 1") if exactly_once else out).select(*[F.col(f"_r._c{k}").alias(c) for k, c in enumerate(columns)])


def transpose(df: DataFrame, header: str, columns: list[str] | None = None) -> DataFrame:
    """TRANSPOSE: header's values become columns (they must be few), the other columns rows. A header met again gets its
    number as a suffix, in order of the other columns."""
    columns = columns or [c for c in df.columns if c != header]
    few = df.limit(10_001).count()
    if few > 10_000:
        raise ValueError("more than 10,000 columns")
    again = F.row_number().over(Window.partitionBy(header).orderBy(*columns))  # counted: at most 10,000 rows
    h = F.when(again == 1, F.col(header).cast("string")).otherwise(F.concat_ws("_", F.col(header).cast("string"), again.cast("string")))
    df = df.select(h.alias("_h"), *columns)
    names = [r[0] for r in df.select("_h").orderBy("_h").collect()]
    long = df.select("_h", *[F.col(c).cast("string").alias(c) for c in columns]).unpivot("_h", columns, "name", "_v")
    return long.groupBy("name").pivot("_h", names).agg(F.first("_v"))


def tocol(df: DataFrame, columns: list[str], order: list[str], by_column: bool = False, skip_blanks: bool = False) -> DataFrame:
    """TOCOL: all cells as one column, row by row or column by column, with their place."""
    cells = F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).cast("string").alias("v")) for k, c in enumerate(columns)])
    out = df.select(*order, F.explode(cells).alias("_x")).select(*order, F.col("_x.c").alias("column"), F.col("_x.v").alias("value"))
    out = out.filter("value IS NOT NULL") if skip_blanks else out
    return out.orderBy("column", *order) if by_column else out.orderBy(*order, "column")


def wraprows(df: DataFrame, value: str, width: int, order: list[str]) -> DataFrame:
    """WRAPROWS: one column dealt into rows of `width` columns c1, c2, ... and their number _row."""
    at = ranked(df.select(*dict.fromkeys([*order, value])), order, "_at")
    cells = at.select(F.floor(F.col("_at") / width).alias("_row"), (F.col("_at") % width).alias("_c"), F.col(value).alias("_v"))
    return cells.groupBy("_row").agg(*[F.max(F.when(F.col("_c") == k, F.col("_v"))).alias(f"c{k + 1}") for k in range(width)])


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)

