"""Grouped summaries: GROUPBY, PIVOTBY, pivot refresh, subtotals of runs, shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import folded


def measure(function: str, c: Column) -> Column:
    """An aggregate by its spreadsheet name; sums, minima and maxima of nothing are 0."""
    x = c.cast("double")
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    table = {
        "SUM": lambda: zero(F.sum(x)), "AVERAGE": lambda: F.avg(x), "COUNT": lambda: F.count(x), "COUNTA": lambda: F.count(c), "MAX": lambda: zero(F.max(x)), "MIN": lambda: zero(F.min(x)), "PRODUCT": lambda: zero(F.product(x)), "MEDIAN": lambda: F.median(x),
        "STDEV": lambda: F.stddev_samp(x), "STDEV.S": lambda: F.stddev_samp(x), "STDEVP": lambda: F.stddev_pop(x), "STDEV.P": lambda: F.stddev_pop(x), "VAR": lambda: F.var_samp(x), "VAR.S": lambda: F.var_samp(x), "VARP": lambda: F.var_pop(x), "VAR.P": lambda: F.var_pop(x),
    }
    if function not in table:
        raise ValueError(f"no aggregate {function}")
    return table[function]()


def states(function: str, c: Column, stem: str) -> tuple[list[Column], Callable] | None:
    """An aggregate in two steps, if it has them: the first step's columns, and the result from these; keep(column) may
    pick rows of the first step. Two steps let hash aggregation meet the raw rows (a label's least spelling needs a
    sort), and grouping sets expand groups instead of rows."""
    x = c.cast("double")
    s, n = f"{stem}_s", f"{stem}_n"
    same = lambda v: v
    table = {
        "SUM": ([F.sum(x).alias(s)], lambda keep=same: F.coalesce(F.sum(keep(F.col(s))), F.lit(0.0))),
        "MAX": ([F.max(x).alias(s)], lambda keep=same: F.coalesce(F.max(keep(F.col(s))), F.lit(0.0))),
        "MIN": ([F.min(x).alias(s)], lambda keep=same: F.coalesce(F.min(keep(F.col(s))), F.lit(0.0))),
        "COUNT": ([F.count(x).alias(n)], lambda keep=same: F.coalesce(F.sum(keep(F.col(n))), F.lit(0))),
        "COUNTA": ([F.count(c).alias(n)], lambda keep=same: F.coalesce(F.sum(keep(F.col(n))), F.lit(0))),
        "AVERAGE": ([F.sum(x).alias(s), F.count(x).alias(n)], lambda keep=same: F.try_divide(F.sum(keep(F.col(s))), F.sum(keep(F.col(n))))),
    }
    return table.get(function)


def stepped(base: DataFrame, keys: list[str], measures: list[tuple[str, str]]) -> tuple[DataFrame, list]:
    """base's rows reduced to one per key if all measures (function, column) have two steps, with builders of results; _n
    counts rows. Otherwise base as it is."""
    found = [states(f, F.col(c), f"_m{k}") for k, (f, c) in enumerate(measures)]
    if all(found):
        return base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[p for parts, _ in found for p in parts]), [final for _, final in found]
    builders = [(lambda keep=(lambda v: v), f=f, c=c: measure(f, keep(F.col(c)))) for f, c in measures]
    return base.withColumn("_n", F.lit(1).cast("long")), builders


def groupby(df: DataFrame, keys: list[str], values: list[str], function: str = "SUM", depth: int = 1, sort: int | None = None, names: list[str] | None = None) -> DataFrame:
    """GROUPBY: groups by nested keys (text without case), with a grand total if depth is 1 or more, subtotals of outer
    keys down to depth, above the groups if depth is negative. sort: the number of a key or, beyond them, of a value;
    negative descends. A total's first key reads Total; a subtotal's inner keys are empty. An empty table has no groups and
    no total. One grouping-sets aggregate."""
    names = names or values
    n = len(keys)
    packs = [f"_k{k}" for k in range(n)]
    base = df.select(*[folded(df, c).alias(p) for c, p in zip(keys, packs, strict=True)], *[F.col(c).cast("string").alias(f"_s{k}") for k, c in enumerate(keys)], *[F.col(v).alias(f"_v{k}") for k, v in enumerate(values)])
    base, finals = stepped(base, [*packs, *[f"_s{k}" for k in range(n)]], [(function, f"_v{k}") for k in range(len(values))])
    aggregates = [final().alias(v) for final, v in zip(finals, names, strict=True)]
    labels = [F.min(f"_s{k}").alias(f"_l{k}") for k in range(n)]
    sets = [packs] + [packs[:k] for k in range(n - 1, 0, -1) if k < abs(depth)] + ([[]] if depth else [])
    out = base.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in packs]).agg(F.grouping_id(*packs).alias("_g"), *aggregates, *labels)
    level = {((1 << (n - k)) - 1): k for k in range(n + 1)}  # a grouping id tells how many keys are held
    held = F.coalesce(*[F.when(F.col("_g") == g, F.lit(k)) for g, k in level.items()])
    out = out.withColumn("_held", held)
    pick = []
    for k, c in enumerate(keys):
        own = F.when(F.col("_held") > k, F.col(f"_l{k}"))
        pick.append((F.when(F.col("_held") == 0, F.lit("Total")).otherwise(own) if k == 0 else own).alias(c))
    top = F.lit(-1 if depth < 0 else 1)
    order: list[Column] = [F.when(F.col("_held") == 0, top).otherwise(F.lit(0))]
    by_value = sort is not None and abs(sort) > n
    if by_value and n == 1:
        v = F.col(names[abs(sort) - n - 1])
        order.append(v.desc() if sort < 0 else v.asc())
    for k in range(n):
        down = sort is not None and not by_value and sort == -(k + 1)
        c = F.col(packs[k])
        order.append(F.when(F.col("_held") > k, F.lit(0)).otherwise(top))
        order.append(c.desc_nulls_last() if down else c.asc_nulls_first())
    return out.orderBy(*order).select(*pick, *names)


def pivotby(df: DataFrame, rows: list[str], column: str, value: str, function: str = "SUM", totals: bool = True, items: list | None = None) -> DataFrame:
    """PIVOTBY: row groups by column groups; what doesn't occur is null; Total row and column. The column's items are
    found by one distinct aggregate unless given (they become columns, so they must be few)."""
    key = folded(df, column)
    if items is None:
        items = [r[0] for r in df.select(key.cast("string").alias("i")).distinct().orderBy("i").limit(10_001).collect()]
        if len(items) > 10_000:
            raise ValueError("more than 10,000 column items")
    base = df.select(*[F.col(c).cast("string").alias(f"_s{k}") for k, c in enumerate(rows)], *[folded(df, c).alias(f"_k{k}") for k, c in enumerate(rows)], key.cast("string").alias("_c"), F.col(value).alias("_v"))
    packs = [f"_k{k}" for k in range(len(rows))]
    base, (final,) = stepped(base, [*packs, *[f"_s{k}" for k in range(len(rows))], "_c"], [(function, "_v")])
    named = [(i, i if i is not None else "(blank)") for i in items]
    own = lambda i: lambda v: F.when(F.col("_c").eqNullSafe(F.lit(i)), v)
    columns = [F.when(F.sum(own(i)(F.col("_n"))) > 0, final(own(i))).alias(n) for i, n in named]
    columns += [final().alias("Total")] if totals else []
    labels = [F.min(f"_s{k}").alias(f"_l{k}") for k in range(len(rows))]
    sets = [packs] + ([[]] if totals else [])
    out = base.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(p) for p in packs]).agg(F.grouping_id(*packs).alias("_g"), *columns, *labels)
    pick = [(F.when(F.col("_g") > 0, F.lit("Total") if k == 0 else F.lit(None).cast("string")).otherwise(F.col(f"_l{k}"))).alias(c) for k, c in enumerate(rows)]
    return out.orderBy(F.col("_g") > 0, *packs).select(*pick, *[n for _, n in named], *(["Total"] if totals else []))


def refresh_pivot(df: DataFrame, rows: list[str], columns: list[str], data: list[tuple[str, str]], pages: dict | None = None, subtotals: bool = True, grand: bool = True) -> DataFrame:
    """A pivot table's cells, in long form: every row prefix by every column prefix, (rows..., columns..., data...);
    a prefix's missing fields are null and _row_level, _col_level tell how many are held. pages filter first (a value or
    a list of them, without case)."""
    for field, shown_ in (pages or {}).items():
        wanted = shown_ if isinstance(shown_, list) else [shown_]
        df = df.filter(folded(df, field).isin([w.upper() if isinstance(w, str) else w for w in wanted]))
    fields = [*rows, *columns]
    packs = [f"_k{k}" for k in range(len(fields))]
    base = df.select(*[folded(df, c).alias(p) for c, p in zip(fields, packs, strict=True)], *[F.col(c).cast("string").alias(f"_s{k}") for k, c in enumerate(fields)], *[F.col(c).alias(f"_v{k}") for k, (c, _) in enumerate(data)])
    nr = len(rows)
    depths = lambda n: [n] + ([k for k in range(n - 1, 0, -1)] if subtotals else []) + ([0] if grand and n else [])
    sets = [[*packs[:a], *packs[nr : nr + b]] for a in depths(nr) for b in depths(len(columns))]
    base, finals = stepped(base, [*packs, *[f"_s{k}" for k in range(len(fields))]], [(f, f"_v{k}") for k, (_, f) in enumerate(data)])
    aggregates = [final().alias(f"{f} of {c}") for final, (c, f) in zip(finals, data, strict=True)]
    out = base.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(p) for p in packs]).agg(F.grouping_id(*packs).alias("_g"), *aggregates, *[F.min(f"_s{k}").alias(f"_l{k}") for k in range(len(fields))])
    held = [F.col("_g").bitwiseAND(F.lit(1 << (len(fields) - 1 - k))) == 0 for k in range(len(fields))]
    total = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    return out.select(*[F.when(held[k], F.col(f"_l{k}")).alias(c) for k, c in enumerate(fields)], total(held[:nr]).alias("_row_level"), total(held[nr:]).alias("_col_level"), *[f"{f} of {c}" for c, f in data])


def pivot_lookup(pivot: DataFrame, data: str, items: dict) -> DataFrame:
    """GETPIVOTDATA: the one cell of a refreshed pivot that holds exactly the named items."""
    meta = {"_row_level", "_col_level"}
    out = pivot
    for c in pivot.columns:
        if c in items:
            out = out.filter(F.upper(F.col(c)) == str(items[c]).upper())
        elif c not in meta and " of " not in c:
            out = out.filter(F.col(c).isNull())
    return out.filter(F.col("_row_level") + F.col("_col_level") == len(items)).select(F.col(data).alias("value"))


def subtotal(df: DataFrame, key: str, value: str, order: list[str], function: str = "SUM", partition: list[str] | None = None) -> DataFrame:
    """Data - Subtotal: a row for each run of equal consecutive keys (without case) and a grand total, in order; within
    each partition if one is given, which is what makes it scale. Gives (partition..., _run, key, value, is_total)."""
    p = [F.col(c) for c in partition or []]
    w = Window.partitionBy(*p).orderBy(*order)
    base = df.withColumn("_key", folded(df, key))
    base = base.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col("_key").eqNullSafe(F.lag("_key").over(w))).cast("int")))
    base = base.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = base.groupBy(*p, "_run").agg(F.min(F.col(key).cast("string")).alias(key), measure(function, F.col(value)).alias(value)).withColumn("is_total", F.lit(False))
    total = df.groupBy(*p).agg(measure(function, F.col(value)).alias(value)).withColumn("_run", F.lit(None).cast("long")).withColumn(key, F.lit("Grand Total")).withColumn("is_total", F.lit(True))
    return runs.unionByName(total.select(*runs.columns))


def percentof(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """PERCENTOF per group: the group's sum over that of all; groups first, so the window meets one row a group."""
    sums = df.groupBy(*keys).agg(F.sum(F.col(value).cast("double")).alias("_s"))
    total = sums.agg(F.sum("_s").alias("_t"))
    return sums.crossJoin(F.broadcast(total)).select(*keys, F.try_divide("_s", "_t").alias("share"))  # one row


def nested_total(df: DataFrame, value: str, flag: str, function: str = "SUM", skip_errors: bool = False) -> DataFrame:
    """SUBTOTAL and AGGREGATE over a column in which some rows are totals themselves: these are left out."""
    rows = df.filter(~F.coalesce(F.col(flag), F.lit(False)))
    return rows.filter(F.col(value).isNotNull()).agg(measure(function, F.col(value)).alias("value")) if skip_errors else rows.agg(measure(function, F.col(value)).alias("value"))


def groupby_lambda(df: DataFrame, keys: list[str], value: str, formula: str, name: str = "value") -> DataFrame:
    """GROUPBY with a lambda as its aggregate, such as "LAMBDA(v,MAX(v)-MIN(v))": each group's values are its argument.
    A group is one Arrow batch's worth of memory, so groups must be bounded; built-in aggregates have no such limit."""
    from pyspark.sql.functions import pandas_udf

    def run(values):
        from ..functions.values import Arr, Err, single
        from ..plans.evaluator import Evaluator

        ev = Evaluator()
        out = single(ev.apply(ev.evaluate(formula), [Arr([[None if v != v else float(v)] for v in values], True)]))
        return None if isinstance(out, Err) or out is None else float(out)

    import pandas as pd

    run.__annotations__ = {"values": pd.Series, "return": float}
    return df.groupBy(*keys).agg(pandas_udf(run, "double")(F.col(value).cast("double")).alias(name))

