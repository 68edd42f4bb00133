"""Functions over ordered rows: rolling frames, ranks, running folds, fills, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import sort_keys


def rolling(df: DataFrame, value: str, window: int, function: str, order: list[str], partition: list[str] | None = None, min_periods: int | None = None, name: str = "rolling") -> DataFrame:
    """ROLLING: over the last `window` rows in order, null until min_periods (default the window) of them have values."""
    w = Window.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(1 - window, 0)
    x = F.col(value).cast("double")
    f = function.upper()
    if f == "MEDIAN":
        s = F.sort_array(F.collect_list(x).over(w))
        n = F.size(s)
        out = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    else:
        out = {"SUM": F.sum, "AVERAGE": F.avg, "MAX": F.max, "MIN": F.min, "COUNT": F.count, "STDEV": F.stddev_samp, "VAR": F.var_samp, "STDEVP": F.stddev_pop, "VARP": F.var_pop}[f](x).over(w)
    return df.withColumn(name, F.when(F.count(x).over(w) >= (min_periods or window), out))


def rank(df: DataFrame, value: str, ascending: bool = False, partition: list[str] | None = None, average: bool = False, name: str = "rank") -> DataFrame:
    """RANK and RANK.AVG. Without a partition the values are counted first, so that the window over all meets each value
    once, and the ranks are joined back."""
    key = F.col(value).asc() if ascending else F.col(value).desc()
    p = partition or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*p, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*p).orderBy(key)
    ahead = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = (ahead + 1).cast("double") + (F.col("_n") - 1) / 2 if average else ahead + 1
    return df.join(counts.select(*p, value, r.alias(name)), [*p, value], "left").select(*df.columns, name)


def percentrank(df: DataFrame, value: str, digits: int = 3, exclusive: bool = False, partition: list[str] | None = None, name: str = "percentrank") -> DataFrame:
    """PERCENTRANK.INC and .EXC of each row's value among all, cut to digits."""
    p = partition or []
    ranks = rank(df, value, True, p, name="_r")
    total = df.groupBy(*p).agg(F.count(value).alias("_t"))
    joined = ranks.join(total, p) if p else ranks.crossJoin(F.broadcast(total))  # one row
    share = F.col("_r") / (F.col("_t") + 1) if exclusive else F.try_divide(F.col("_r") - 1, F.col("_t") - 1)
    return joined.withColumn(name, F.floor(share * 10**digits + 1e-9) / 10**digits).select(*df.columns, name)


def scan(df: DataFrame, value: str, order: list[str], partition: list[str] | None = None, function: str = "SUM", name: str = "running") -> DataFrame:
    """SCAN with an associative step: a running sum, product, minimum, maximum or count."""
    w = Window.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value).cast("double")
    out = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "COUNT": F.count, "PRODUCT": F.product}[function.upper()](x).over(w)
    return df.withColumn(name, out)


def filldown(df: DataFrame, value: str, order: list[str], partition: list[str] | None = None, up: bool = False, skip: list | None = None, name: str | None = None) -> DataFrame:
    """FILLDOWN: blanks (null, "" and values to skip) take the last value before them, or with up the next after."""
    c = F.col(value)
    empty = c.isNull()
    if dict(df.dtypes)[value] == "string":
        empty |= c == ""
    for s in skip or []:
        empty |= F.upper(c) == s.upper() if isinstance(s, str) else c == s
    held = F.when(~F.coalesce(empty, F.lit(True)), c)
    w = Window.partitionBy(*(partition or [])).orderBy(*order)
    out = F.first(held, True).over(w.rowsBetween(0, Window.unboundedFollowing)) if up else F.last(held, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name or value, out)


def shifted(df: DataFrame, value: str, rows: int, order: list[str], partition: list[str] | None = None, name: str = "shifted") -> DataFrame:
    """OFFSET by rows: the value so many rows on (back if negative)."""
    w = Window.partitionBy(*(partition or [])).orderBy(*order)
    return df.withColumn(name, F.lead(value, rows).over(w) if rows >= 0 else F.lag(value, -rows).over(w))


def fill_series(seed: list[float], n: int) -> list[float]:
    """Series continuation by the fill handle: n further values on the least-squares line of the seed (a step of 1 after
    a single value)."""
    k = len(seed)
    if k == 1:
        return [seed[0] + i + 1 for i in range(n)]
    mx, my = (k - 1) / 2, sum(seed) / k
    slope = sum((i - mx) * (y - my) for i, y in enumerate(seed)) / sum((i - mx) ** 2 for i in range(k))
    return [my + slope * (k + i - mx) for i in range(n)]


def series_frame(df: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The trend of a column continued by n rows: one aggregate, then a range."""
    fit = df.select(F.col(order).cast("double").alias("x"), F.col(value).cast("double").alias("y")).agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.max("x").alias("m"))
    return df.sparkSession.range(1, n + 1).crossJoin(F.broadcast(fit)).select((F.col("m") + F.col("id")).alias(order), (F.col("a") + F.col("b") * (F.col("m") + F.col("id"))).alias(value))  # one row


assert sort_keys
