"""Joins and lookups. Spark picks the physical join; sides are broadcast by hint only if counted to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import osa
from .keys import folded, fresh


def tablejoin(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, how: str = "inner", suffix: str = "_2") -> DataFrame:
    """TABLEJOIN: text keys without case, blank keys match nothing, -0 = 0, duplicates multiply; right's other columns
    follow, with the suffix if left has the name; rows only right has carry their key in left's key columns."""
    right_on = right_on or left_on
    make = fresh(left, *right.columns)
    lk, rk = [make("l") for _ in left_on], [make("r") for _ in right_on]
    taken = {c.lower() for c in left.columns}
    rest = {c: (c + suffix if c.lower() in taken else c) for c in right.columns if c not in right_on}
    named = {c: make("c") for c in right.columns}
    l = left.select("*", *[folded(left, c, False).alias(k) for c, k in zip(left_on, lk, strict=True)])  # noqa: E741
    r = right.select(*[F.col(c).alias(named[c]) for c in right.columns], *[folded(right, c, False).alias(k) for c, k in zip(right_on, rk, strict=True)])
    on = [F.col(a) == F.col(b) for a, b in zip(lk, rk, strict=True)]
    out = l.join(r, on, {"full": "full_outer"}.get(how, how))
    keys = dict(zip(left_on, right_on, strict=True))
    pick = [F.coalesce(F.col(c), F.col(named[keys[c]])).alias(c) if c in keys and how in ("right", "full") else F.col(c) for c in left.columns]
    return out.select(*pick, *[F.col(named[c]).alias(n) for c, n in rest.items()])


def first_rows(table: DataFrame, key: str, order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key, without case, by order; a partial aggregate, so hot keys shrink before the
    shuffle."""
    rest = [c for c in table.columns if c not in order]
    packed = F.struct(*[F.col(c) for c in [*order, *rest]])
    picked = (F.max if last else F.min)(packed)
    return table.groupBy(folded(table, key, False).alias("_key")).agg(picked.alias("_row")).select("_key", "_row.*")


def lookup(df: DataFrame, needle: str, table: DataFrame, key: str, values: list[str], order: list[str], if_missing=None, last: bool = False) -> DataFrame:
    """VLOOKUP, MATCH 0 and XLOOKUP, exact: df with `values` of the first (or last) table row of equal key."""
    right = first_rows(table.select(*{key: 0, **dict.fromkeys(order), **dict.fromkeys(values)}), key, order, last)
    right = right.select("_key", *[F.col(v).alias(f"_v{k}") for k, v in enumerate(values)])
    out = df.withColumn("_needle", folded(df, needle, False)).join(right, F.col("_needle") == F.col("_key"), "left")
    fill = (lambda c: F.coalesce(c, F.lit(if_missing))) if if_missing is not None else (lambda c: c)
    return out.select(*[F.col(c) for c in df.columns], *[fill(F.col(f"_v{k}")).alias(v) for k, v in enumerate(values)])


def asof(df: DataFrame, needle: str, table: DataFrame, key: str, values: list[str], by: list[str] | None = None, following: bool = False, strict: bool = False) -> DataFrame:
    """Approximate VLOOKUP, MATCH 1 and -1, LOOKUP, XLOOKUP -1 and 1: the row of the nearest key not beyond the needle
    (or, following, not before it). A small table is broadcast as sorted arrays per group of `by` and searched; otherwise
    both sides are laid over each other in one window per group, after a check for a group column."""
    by = by or []
    make = fresh(df, *table.columns)
    side, at, row, val = make("side"), make("at"), make("id"), make("val")
    keys = table.select(*by, F.col(key).cast("double").alias(at), F.struct(*values).alias(val)).filter(F.col(at).isNotNull())
    sign = -1 if following else 1
    if keys.limit(50_001).count() <= 50_000:
        lists = keys.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((F.col(at) * sign).alias("k"), F.col(val).alias("v")))).alias(row))  # counted: at most 50,000 keys in all
        joined = df.join(F.broadcast(lists), by, "left") if by else df.crossJoin(F.broadcast(lists))
        hit = binary_search(F.col(row), F.col(needle).cast("double") * sign, strict)
        out = joined.withColumn(val, hit)
        return out.select(*df.columns, *[F.col(f"{val}.v.{v}").alias(v) for v in values])
    probes = df.select(*by, F.col(needle).cast("double").alias(at), F.lit(None).cast(keys.schema[val].dataType).alias(val), F.lit(0 if strict else 1).alias(side), F.struct(*df.columns).alias(row))
    both = keys.select(*by, at, val, F.lit(1 if strict else 0).alias(side), F.lit(None).cast(probes.schema[row].dataType).alias(row)).unionByName(probes)
    order = [F.col(at).desc() if following else F.col(at), F.col(side), F.col(val)]  # of equal keys the greatest values
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(val, F.last(val, True).over(w)).filter(F.col(row).isNotNull())
    return out.select(f"{row}.*", *[F.col(f"{val}.{v}").alias(v) for v in values])


def binary_search(items: Column, x: Column, strict: bool = False) -> Column:
    """The last struct (k, v) of an ascending array whose k is not beyond x."""

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        k = F.get(acc["items"], mid)["k"]
        go = (k < acc["x"]) if strict else (k <= acc["x"])
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & go, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~go, mid).otherwise(acc["hi"]).alias("hi"), acc["x"].alias("x"), acc["items"].alias("items"))

    start = F.struct(F.lit(0).alias("lo"), F.size(items).alias("hi"), x.alias("x"), items.alias("items"))
    return F.when(x.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(17)), start, step, lambda a: F.get(a["items"], a["lo"] - 1)))


def wildcard_lookup(df: DataFrame, pattern: str, table: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """MATCH 0 and XLOOKUP 2 with * and ? (~ before one takes it as it is): the first table row, by order, whose text the
    pattern matches, without case. Distinct patterns meet the distinct texts of equal first letters, as many as a pattern
    has before its first wildcard; only patterns that begin with one meet all texts. Repeated rows stay."""
    p = F.col(pattern)
    marked = F.replace(F.replace(F.replace("_p", F.lit("~~"), F.lit("\x01")), F.lit("~*"), F.lit("\x02")), F.lit("~?"), F.lit("\x03"))
    quoted = F.regexp_replace(marked, r"([.\\+^$()\[\]{}|])", r"\\$1")
    open_ = F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", ".")
    plain = lambda c: F.translate(c, "\x01\x02\x03", "~*?")
    like = F.concat(F.lit("(?is)^"), F.replace(F.replace(F.replace(open_, F.lit("\x01"), F.lit("~")), F.lit("\x02"), F.lit("\\*")), F.lit("\x03"), F.lit("\\?")), F.lit("$"))
    start = F.upper(plain(F.regexp_extract(marked, r"^[^*?]*", 0)))
    left = df.select(p.alias("_p")).filter("_p IS NOT NULL").distinct().select("_p", like.alias("_like"), start.alias("_start")).withColumn("_n", F.length("_start"))
    firsts = table.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(order, *values)).alias("_row"))
    lengths = left.groupBy().agg(F.collect_set("_n").alias("_ns"))  # as many as patterns have lengths
    keyed = firsts.crossJoin(F.broadcast(lengths)).select("_k", "_row", F.explode("_ns").alias("_n")).withColumn("_start", F.upper(F.expr("substring(_k, 1, _n)")))
    best = left.join(keyed, ["_n", "_start"]).filter(F.expr("_k rlike _like")).groupBy("_p").agg(F.min("_row").alias("_row"))
    return df.join(best, p == F.col("_p"), "left").select(*df.columns, *[F.col(f"_row.{v}").alias(v) for v in values])


def conditional_join(df: DataFrame, keys: dict[str, str], table: DataFrame, measure: str, function: str = "sum") -> DataFrame:
    """A SUMIFS per row whose criteria are the row's own values: the table is aggregated by its keys first, then joined."""
    f = {"sum": F.sum, "count": F.count, "average": F.avg, "max": F.max, "min": F.min}[function]
    right = table.groupBy(*[folded(table, k, False).alias(f"_k{n}") for n, k in enumerate(keys.values())]).agg(f(measure).alias("_m"))
    left = df.select("*", *[folded(df, k, False).alias(f"_n{n}") for n, k in enumerate(keys)])
    out = left.join(right, [F.col(f"_n{n}") == F.col(f"_k{n}") for n in range(len(keys))], "left")
    return out.select(*df.columns, (F.coalesce("_m", F.lit(0)) if function in ("sum", "count") else F.col("_m")).alias("value"))


def has(df: DataFrame, column: str, table: DataFrame, key: str, negate: bool = False) -> DataFrame:
    """The rows whose value the other table's column has (or has not), without case; blanks are never had."""
    right = table.select(folded(table, key, False).alias("_k")).filter("_k IS NOT NULL").distinct()
    left = df.withColumn("_n", folded(df, column, False))
    return left.join(right, F.col("_n") == F.col("_k"), "left_anti" if negate else "left_semi").drop("_n")


def hstack(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str]) -> DataFrame:
    """Rows side by side by their rank; the shorter side is padded with null. Ranks come from numbered ranges, not from
    one global window."""
    a, b = ranked(left, order_left, "_a"), ranked(right, order_right, "_b")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").withColumn("_row", F.coalesce("_a", "_b")).drop("_a", "_b")


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place (from 0) in the given order: sorted in ranges, which are numbered by their sizes."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = T.StructType([*sorted_.schema.fields, T.StructField(name, T.LongType(), False)])
    pairs = sorted_.rdd.zipWithIndex().map(lambda p: (*p[0], p[1]))
    return spark.createDataFrame(pairs, schema)


def fuzzylookup(df: DataFrame, needle: str, table: DataFrame, key: str, value: str, order: str, threshold: float = 0.8) -> DataFrame:
    """FUZZYLOOKUP: the first table row of the greatest similarity 1 - distance / longer length, if at least the
    threshold. Candidates share one of the pieces into which a text within the allowed edits must fall unchanged: of
    k + 1 pieces of the key, k being the edits allowed, one is left whole and moves by at most k places."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def similar(a, b):
        import pandas as pd

        return pd.Series([1 - osa(x, y) / max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)])

    keys = table.filter(F.col(key).isNotNull()).select(F.lower(F.col(key)).alias("_k"), F.col(value).alias("_v"), F.col(order).alias("_o")).groupBy("_k").agg(F.min(F.struct("_o", "_v")).alias("_r"))
    needles = df.filter(F.col(needle).isNotNull()).select(F.lower(F.col(needle)).alias("_n")).distinct()
    # Lengths n and m can only be similar if the edits allowed, (1 - t) * max(n, m), cover their difference.
    edits = F.floor((1 - threshold) * F.length("_k") / threshold + 1e-9).cast("int")
    piece = F.greatest(F.floor(F.length("_k") / (2 * edits + 2)).cast("int"), F.lit(1))
    starts = F.sequence(F.lit(0), 2 * edits + 1)
    parts = keys.select("_k", "_r", piece.alias("_w"), F.explode(F.transform(starts, lambda i: F.struct((i * piece).alias("p"), F.substring("_k", i * piece + 1, piece).alias("s")))).alias("_p")).select("_k", "_r", "_w", F.col("_p.s").alias("_s")).filter(F.length("_s") == F.col("_w")).distinct()
    widths = parts.select("_w").distinct()
    grams = needles.crossJoin(F.broadcast(widths)).filter(F.length("_n") >= F.col("_w")).select("_n", "_w", F.explode(F.transform(F.sequence(F.lit(1), F.length("_n") - F.col("_w") + 1), lambda i: F.substring("_n", i, F.col("_w")))).alias("_s")).distinct()  # as many widths as lengths of keys
    pairs = grams.join(parts, ["_w", "_s"]).select("_n", "_k", "_r").distinct()
    pairs = pairs.filter(F.least(F.length("_n"), F.length("_k")) >= threshold * F.greatest(F.length("_n"), F.length("_k")) - 1e-9)
    scored = pairs.withColumn("_sim", similar("_n", "_k")).filter(F.col("_sim") >= threshold - 1e-12)
    best = scored.groupBy("_n").agg(F.max(F.struct("_sim", (-F.col("_r._o").cast("double")).alias("o"), F.col("_r._v").alias("v"))).alias("_b"))
    return df.withColumn("_q", F.lower(F.col(needle))).join(best, F.col("_q") == F.col("_n"), "left").select(*df.columns, F.col("_b.v").alias(value), F.col("_b._sim").alias("similarity"))


def consolidate(sources: list[DataFrame], row: str, columns: list[str], function: str = "sum") -> DataFrame:
    """CONSOLIDATE by labels: the sources' columns of one name (without case) are aggregated by the row label (without
    case); labels read as first seen (least spelling on ties of source)."""
    f = {"sum": F.sum, "count": F.count, "average": F.avg, "max": F.max, "min": F.min, "product": F.product}[function]
    long = None
    for n, s in enumerate(sources):
        own = [c for c in s.columns if c.lower() in {x.lower() for x in columns}]
        part = s.select(F.col(row).alias("_r"), F.lit(n).alias("_n"), *[F.col(c).cast("double").alias(c.lower()) for c in own]).unpivot(["_r", "_n"], [c.lower() for c in own], "_c", "_x")
        long = part if long is None else long.unionByName(part)
    names = [c.lower() for c in columns]
    out = long.groupBy(F.upper("_r").alias("_u")).pivot("_c", names).agg(f("_x"))
    label = long.groupBy(F.upper("_r").alias("_u")).agg(F.min(F.struct("_n", "_r")).alias("_l"))
    return out.join(label, "_u").select(F.col("_l._r").alias(row), *[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)])

