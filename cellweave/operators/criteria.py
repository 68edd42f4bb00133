"""Criteria such as ">=5", "a*" or "<>x" as predicates, criteria grids, and filters built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import has_wildcard, parse_number, wildcard
from .keys import folded, fresh, kind
from .stats import percentiles

NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)
OPERATORS = ("<>", ">=", "<=", ">", "<", "=")


def criterion(df: DataFrame, name: str, rule) -> Column:
    """Whether a column's value passes: numbers never match text nor the other way round; wildcards with = and <> on
    text only; a blank passes only the test for blank (and <> anything)."""
    c, t = F.col(name), kind(df, name)
    if not isinstance(rule, str):
        hit = c == F.lit(rule) if isinstance(rule, bool) == isinstance(t, T.BooleanType) and not isinstance(t, T.StringType) else F.lit(False)
        return F.coalesce(hit, F.lit(False))
    op = next((o for o in OPERATORS if rule.startswith(o)), "")
    rest = rule[len(op) :]
    number = parse_number(rest)
    if op in ("", "=", "<>"):
        if rest == "":
            hit = c.isNull() if op else c.isNull() | (c.cast("string") == "")
        elif number is not None:
            hit = c == F.lit(number) if isinstance(t, NUMERIC) else c.try_cast("double") == F.lit(number) if isinstance(t, T.StringType) else F.lit(False)
        elif isinstance(t, T.BooleanType) and rest.upper() in ("TRUE", "FALSE"):
            hit = c == F.lit(rest.upper() == "TRUE")
        elif isinstance(t, T.StringType):
            hit = c.rlike(f"(?is)^(?:{wildcard(rest).pattern})$") if has_wildcard(rest) else F.upper(c) == F.upper(F.lit(rest))
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            hit = c == F.lit(rest).cast(t)
        else:
            hit = F.lit(False)
        hit = F.coalesce(hit, F.lit(False))
        return ~hit if op == "<>" else hit
    if isinstance(t, NUMERIC) and number is not None:
        left, right = c, F.lit(number)
    elif isinstance(t, T.StringType) and number is None:
        left, right = F.upper(c), F.upper(F.lit(rest))
    elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        left, right = c, F.lit(rest).cast(t)
    else:
        return F.lit(False)
    hit = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
    return F.coalesce(hit, F.lit(False))


def all_of(df: DataFrame, rules: dict) -> Column:
    return reduce(lambda a, b: a & b, [criterion(df, n, r) for n, r in rules.items()], F.lit(True))


def grid(df: DataFrame, rows: list[dict], begins_with: bool = False) -> Column:
    """Rows or'ed, their cells and'ed. begins_with: plain text passes what begins with it, as advanced filters do; =text
    is exact, = is blank, <> is not blank."""

    def cell(name: str, rule) -> Column:
        if rule is None or rule == "":
            return F.lit(True)
        if begins_with and isinstance(rule, str) and rule[0] not in "=<>" and parse_number(rule) is None:
            return F.coalesce(F.col(name).rlike(f"(?is)^(?:{wildcard(rule).pattern})"), F.lit(False)) if isinstance(kind(df, name), T.StringType) else F.lit(False)
        if begins_with and rule == "<>":
            return F.col(name).isNotNull()
        return criterion(df, name, rule)

    lines = [reduce(lambda a, b: a & b, [cell(n, r) for n, r in row.items()], F.lit(True)) for row in rows]
    return reduce(lambda a, b: a | b, lines, F.lit(False))


def advanced_filter(df: DataFrame, rows: list[dict], unique: bool = False, order: list[str] | None = None) -> DataFrame:
    """The rows a criteria grid passes; with unique the first, in order, of those that read the same."""
    out = df.filter(grid(df, rows, begins_with=True))
    return remove_duplicates(out, out.columns, order) if unique else out


def remove_duplicates(df: DataFrame, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """The first row, in order, of those whose columns are equal without case (blanks count as equal)."""
    n = fresh(df)("n")
    keys = [folded(df, c) for c in columns]
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or columns)))).filter(F.col(n) == 1).drop(n)


#: A top-k is taken by sorting heaps of at most so many rows; beyond that the k-th value is searched for.
MOST_TOP = 100_000


def kth(df: DataFrame, column: str, k: int, largest: bool = True):
    """The k-th largest (or smallest) value of a numeric column; None if there are fewer. Small k by a top-k; others by
    selection: brackets of approximate quantiles around the k-th are narrowed, one aggregate a round, until a bracket
    holds few enough rows for a top-k. Only counts and bounds come to the driver."""
    sign = 1 if largest else -1
    x = df.select((F.col(column).cast("double") * sign).alias("x")).filter("x IS NOT NULL")
    low, high, left = None, None, k
    for _ in range(20):
        rows = x
        if low is not None:
            rows = rows.filter((F.col("x") >= low) & (F.col("x") <= high))
        if left <= MOST_TOP:
            got = rows.orderBy(F.col("x").desc()).limit(left).agg(F.min("x").alias("m"), F.count("x").alias("n")).first()
            return None if got.n < left else got.m * sign
        facts = rows.agg(F.count("x").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).first()
        if facts.n < left:
            return None
        if facts.a == facts.b:
            return facts.a * sign
        p = 1 - left / facts.n
        low2, high2 = rows.agg(F.percentile_approx("x", [max(0.0, p - 0.002), min(1.0, p + 0.002)], 10_000)).first()[0]
        above = rows.filter(F.col("x") > high2).count()
        inside = rows.filter((F.col("x") >= low2) & (F.col("x") <= high2)).count()
        if not above < left <= above + inside or inside == facts.n:
            # the bracket missed, or can't narrow: values are counted, and a window runs over a row for each
            counts = rows.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
            run = counts.withColumn("r", F.sum("c").over(Window.orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, 0)))
            return run.filter(F.col("r") >= left).agg(F.max("x")).first()[0] * sign
        low, high, left = low2, high2, left - above
    raise RuntimeError("the selection didn't end")


def top_n(df: DataFrame, column: str, n: int, percent: bool = False, bottom: bool = False) -> DataFrame:
    """Top-10 filter: at least the n (or n percent) largest or smallest values, with ties; all if there are fewer."""
    if percent:
        n = max(1, int(df.filter(F.col(column).isNotNull()).count() * n / 100))
    cut = kth(df, column, int(n), not bottom)
    if cut is None:
        return df.filter(F.col(column).isNotNull())
    return df.filter(F.col(column) <= cut if bottom else F.col(column) >= cut)


def values_filter(df: DataFrame, column: str, shown: list[str], blank: bool = False, dates: list[dict] | None = None) -> DataFrame:
    """The rows whose text is among `shown` (without case), or whose date falls into a group such as {"year": 2020,
    "month": 5}; blanks if asked for."""
    c = F.col(column)
    keep = F.upper(c.cast("string")).isin([s.upper() for s in shown]) if shown else F.lit(False)
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
    for group in dates or []:
        keep |= reduce(lambda a, b: a & b, [parts[k](c) == v for k, v in group.items()])
    keep = F.coalesce(keep, F.lit(False))
    return df.filter(keep | (c.isNull() | (c.cast("string") == "")) if blank else keep)


def conditional(df: DataFrame, measure: str | None, function: str, rules: dict, keys: list[str] | None = None) -> DataFrame:
    """SUMIFS and its family: one aggregate (sum, average, count, max, min, median) over the rows that pass, per key."""
    ok = all_of(df, rules)
    x = F.when(ok, F.col(measure).cast("double")) if measure else F.when(ok, F.lit(1.0))
    if function == "median":
        return percentiles(df, keys or [], {"value": (x, 0.5)})
    out = {
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)), "average": lambda: F.avg(x), "count": lambda: F.count(x), "max": lambda: F.coalesce(F.max(x), F.lit(0.0)),
        "min": lambda: F.coalesce(F.min(x), F.lit(0.0)),
    }[function]()
    return df.groupBy(*(keys or [])).agg(out.alias("value"))


def database(df: DataFrame, measure: str | None, function: str, rows: list[dict]) -> DataFrame:
    """DSUM and its family over a criteria grid, as one row; DGET gives the value, or null unless exactly one row passes."""
    x = F.col(measure).cast("double") if measure else F.lit(1.0)
    table = {
        "DSUM": F.coalesce(F.sum(x), F.lit(0.0)), "DCOUNT": F.count(x), "DCOUNTA": F.count(F.col(measure) if measure else F.lit(1)), "DAVERAGE": F.avg(x), "DMAX": F.coalesce(F.max(x), F.lit(0.0)), "DMIN": F.coalesce(F.min(x), F.lit(0.0)),
        "DPRODUCT": F.coalesce(F.product(x), F.lit(0.0)), "DSTDEV": F.stddev_samp(x), "DSTDEVP": F.stddev_pop(x), "DVAR": F.var_samp(x), "DVARP": F.var_pop(x), "DGET": F.when(F.count(F.lit(1)) == 1, F.first(x)),
    }
    return df.filter(grid(df, rows, begins_with=True)).agg(table[function].alias("value"))
