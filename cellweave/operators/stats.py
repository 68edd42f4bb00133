"""Statistics of columns, as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import MOST_BROADCAST


#: Parts that a range of values is split into, in each round of a search for ranks.
PARTS = 1 << 14


def rough(x: Column) -> Column:
    """A whole number that never falls as x rises: |x| to the power 1/1024 in steps. Square roots are rounded correctly,
    so this holds without exception. At most 101,000 numbers in all; values of one number differ by 7 percent at most."""
    root = F.abs(x)
    for _ in range(10):
        root = F.sqrt(root)
    step = (F.signum(x) * F.floor(root * 32768)).cast("long")
    return F.when(F.isnan(x), F.lit(2_000_000)).when(F.abs(x) == float("inf"), (F.signum(x) * 1_000_000).cast("long")).otherwise(step)


def percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], *others: Column) -> DataFrame:
    """PERCENTILE.INC per group: keys, a column for each name in wanted (column, k), at k (n - 1) between neighbours, and
    other aggregates. Without keys one row.

    F.percentile gathers all values of a group in one task. Here the ranks are searched for: rows are counted in rough
    steps, then twice in equal parts of the range in which the rank lies, and last by value. A step holds 2^49 doubles at
    most, so 2^21 are left then. A task holds that many counts a rank at most, however large the input is, and only counts
    are shuffled; the input is read four times (and once for other aggregates)."""
    names, columns = list(wanted), []
    for c, _ in wanted.values():
        if not any(c is o for o in columns):
            columns.append(c)
    at = [next(i for i, o in enumerate(columns) if c is o) for c, _ in wanted.values()]
    packs = [f"_k{i}" for i in range(len(keys))]
    held = [F.col(k).alias(p) for k, p in zip(keys, packs, strict=True)]
    cells = [F.struct(F.lit(i).alias("c"), c.cast("double").alias("x")) for i, c in enumerate(columns)]
    rows = df.select(*held, F.explode(F.array(*cells)).alias("_")) if len(cells) > 1 else df.select(*held, cells[0].alias("_"))
    rows = rows.select(*packs, F.col("_.c").alias("_c"), F.col("_.x").alias("_x")).filter(F.col("_x").isNotNull())
    number, low, high = F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")
    # the step of each rank: (group, column, name, side, place, rank within the step, its least and largest value)
    own = Window.partitionBy(*packs, "_c")
    steps = rows.groupBy(*packs, "_c", rough(F.col("_x")).alias("_b")).agg(number, low, high)
    steps = steps.withColumn("_t", F.sum("_n").over(own)).withColumn("_to", F.sum("_n").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
    place = lambda k: F.lit(float(k)) * (F.col("_t") - 1)
    ranks = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(q).alias("q"), F.lit(side).alias("side"), place(k).alias("p"), f(place(k)).cast("long").alias("r")) for q, (i, (_, k)) in enumerate(zip(at, wanted.values(), strict=True)) for side, f in enumerate((F.floor, F.ceil))])
    inside = F.filter(ranks, lambda r: (r["c"] == F.col("_c")) & (r["r"] < F.col("_to")) & (r["r"] >= F.col("_to") - F.col("_n")))
    found = steps.select(*packs, "_c", "_low", "_high", (F.col("_to") - F.col("_n")).alias("_before"), F.explode(inside).alias("_"))
    found = found.select(*packs, "_c", F.col("_.q").alias("_q"), F.col("_.side").alias("_side"), F.col("_.p").alias("_p"), (F.col("_.r") - F.col("_before")).alias("_left"), "_low", "_high")
    hint = F.broadcast if not keys or found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else lambda f: f  # two rows a name without keys
    target, own = [*packs, "_c", "_q", "_side"], Window.partitionBy(*packs, "_c", "_q", "_side")
    for last in (False, False, True):
        a, b = rows.alias("a"), hint(found).alias("b")
        same = reduce(lambda x, y: x & y, [F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}")) for p in packs], F.col("a._c") == F.col("b._c"))
        met = a.join(b, same & F.col("a._x").between(F.col("b._low"), F.col("b._high"))).select(*[f"b.{t}" for t in target], "_p", "_left", "_low", "_high", "_x")
        width = F.when(F.col("_low") < F.col("_high"), F.col("_high") - F.col("_low"))
        part = F.col("_x") if last else F.coalesce(F.floor((F.col("_x") - F.col("_low")) / width * (PARTS - 1)), F.lit(0))
        counted = met.groupBy(*target, part.alias("_b")).agg(number, low, high, F.max("_p").alias("_p"), F.max("_left").alias("_left"))
        counted = counted.withColumn("_to", F.sum("_n").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_before", F.col("_to") - F.col("_n"))
        found = counted.filter((F.col("_left") < F.col("_to")) & (F.col("_left") >= F.col("_before"))).select(*target, "_p", (F.col("_left") - F.col("_before")).alias("_left"), "_low", "_high")
    out = []
    for q, name in enumerate(names):
        pick = lambda side, c, q=q: F.max(F.when((F.col("_q") == q) & (F.col("_side") == side), F.col(c)))
        p, below, above = pick(0, "_p"), pick(0, "_low"), pick(1, "_low")
        out.append(F.when(F.floor(p) == F.ceil(p), below).otherwise((F.ceil(p) - p) * below + (p - F.floor(p)) * above).alias(name))
    values = found.groupBy(*packs).agg(*out)
    if not keys:
        return values.crossJoin(F.broadcast(df.agg(*others))) if others else values  # one row
    groups = df.groupBy(*held).agg(*others) if others else df.select(*held).distinct()
    values = values.withColumnsRenamed({p: f"{p}v" for p in packs})
    joined = groups.join(hint(values), reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.col(f"{p}v")) for p in packs]), "left")
    return joined.select(*[F.col(p).alias(k) for p, k in zip(packs, keys, strict=True)], *names, *[c for c in groups.columns if c not in packs])


def percentile_exc(df: DataFrame, c: str, ks: list[float]) -> DataFrame:
    """PERCENTILE.EXC: at k (n + 1) - 1; null where that lies outside. Values are counted before the running sum."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    running = counts.withColumn("hi", F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each value
    total = F.broadcast(counts.agg(F.sum("n").alias("t")))  # one row
    wanted = df.sparkSession.createDataFrame([(float(k),) for k in ks], "k double").crossJoin(total).withColumn("p", F.col("k") * (F.col("t") + 1))
    hit = lambda at: F.max(F.when((at > F.col("hi") - F.col("n")) & (at <= F.col("hi")), F.col("x")))
    low, high = F.floor("p"), F.least(F.floor("p") + 1, F.col("t"))
    out = running.crossJoin(F.broadcast(wanted)).groupBy("k", "p", "t").agg(hit(low).alias("a"), hit(high).alias("b"))  # as many rows as ks
    return out.select("k", F.when((F.col("p") >= 1) & (F.col("p") <= F.col("t")), F.col("a") + (F.col("p") - F.floor("p")) * (F.col("b") - F.col("a"))).alias("value"))


def mode(df: DataFrame, c: str, order: list[str]) -> DataFrame:
    """MODE: the most frequent value, of equals the one that comes first in order; null if none repeats."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("o"))
    return counts.orderBy(F.col("n").desc(), "o").limit(1).select(F.when(F.col("n") > 1, F.col(c)).alias("mode"))


def mode_mult(df: DataFrame, c: str) -> DataFrame:
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    top = F.broadcast(counts.agg(F.max("n").alias("m")))  # one row
    return counts.crossJoin(top).filter("n = m AND n > 1").select(c)


def skew(c: str) -> Column:
    """SKEW, the sample form, from the population form that Spark has."""
    n = F.count(F.col(c))
    return F.skewness(F.col(c)) * F.sqrt(n * (n - 1)) / (n - 2)


def kurt(c: str) -> Column:
    """KURT, the sample form."""
    n = F.count(F.col(c)).cast("double")
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(F.col(c)) + 6)


def trimmean(df: DataFrame, c: str, share: float) -> DataFrame:
    """TRIMMEAN: floor(n p / 2) values off each end; values are counted before the running sum."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    running = counts.withColumn("hi", F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each value
    total = F.broadcast(counts.agg(F.sum("n").alias("t")))  # one row
    cut = F.floor(F.col("t") * share / 2)
    kept = F.greatest(F.least("hi", F.col("t") - cut) - F.greatest(F.col("hi") - F.col("n"), cut), F.lit(0))
    return running.crossJoin(total).withColumn("w", kept).agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("trimmean"))


def regression(y: str, x: str) -> list[Column]:
    """SLOPE, INTERCEPT, RSQ, STEYX, CORREL and the covariances of two columns, in one pass."""
    n = F.regr_count(y, x)
    rest = F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x)
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("rsq"), F.sqrt(F.greatest(rest, F.lit(0.0)) / (n - 2)).alias("steyx"), F.corr(y, x).alias("correl"), F.covar_pop(y, x).alias("covar_p"), F.covar_samp(y, x).alias("covar_s")]


def bins(df: DataFrame, c: str, edges: int | list[float], right: bool = False) -> DataFrame:
    """BINS: so many equal widths over the values' range, both ends inside, or explicit rising edges, [a, b) or with
    right (a, b]. Every bin has a row. The count is an aggregate over the bin's number; edges come from one row."""
    spark, x = df.sparkSession, F.col(c).cast("double")
    rows = df.filter(x.isNotNull())
    if isinstance(edges, int):
        if edges < 1:
            raise ValueError("#VALUE!")
        ends = F.broadcast(rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))  # one row
        width = (F.col("hi") - F.col("lo")) / edges
        place = F.floor((x - F.col("lo")) / width) if not right else F.ceil((x - F.col("lo")) / width) - 1
        k = F.when(width == 0, F.lit(0)).otherwise(F.greatest(F.least(place, F.lit(edges - 1)), F.lit(0)))
        counts = rows.crossJoin(ends).groupBy(k.cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        frame = spark.range(edges).crossJoin(ends).select(F.col("id").alias("k"), (F.col("lo") + width * F.col("id")).alias("low"), (F.col("lo") + width * (F.col("id") + 1)).alias("high"))
    else:
        if any(b <= a for a, b in zip(edges[:-1], edges[1:], strict=True)):
            raise ValueError("#VALUE!")
        inside = [(x > a) & (x <= b) if right else (x >= a) & (x < b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        k = F.coalesce(*[F.when(hit, F.lit(q)) for q, hit in enumerate(inside)])
        counts = rows.groupBy(k.cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        frame = spark.createDataFrame([(q, float(a), float(b)) for q, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "k long, low double, high double")
    return frame.join(counts, "k", "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("count"))


def frequency(df: DataFrame, c: str, edges: list[float]) -> DataFrame:
    """FREQUENCY: how many values are at most each edge and above the one before; the last row counts those above all."""
    order = sorted(edges)
    x = F.col(c).cast("double")
    k = F.coalesce(*[F.when(x <= e, F.lit(q)) for q, e in enumerate(order)], F.lit(len(order)))
    counts = df.filter(x.isNotNull()).groupBy(k.cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.createDataFrame([(q, float(order[q]) if q < len(order) else None) for q in range(len(order) + 1)], "k long, edge double")
    return frame.join(counts, "k", "left").select("edge", F.coalesce("n", F.lit(0)).alias("count"))
