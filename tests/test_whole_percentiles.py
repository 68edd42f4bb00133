"""Percentiles of whole columns and of groups: Spark's own values, without a task that holds all of them."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import criteria, stats
from cellweave.plans import catalog
from cellweave.plans.engine import Engine


def odd_rows():
    r = random.Random(1)
    values = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, 1.0 + 2**-52, 1.0 + 2**-51]
    values += [r.gauss(0, 1) * 10 ** r.randint(-300, 300) for _ in range(500)] + [float(r.randint(-5, 5)) for _ in range(500)] + [1e9 + r.random() * 1e-6 for _ in range(500)]
    return [(r.choice(["a", "b", None]), v, float(r.randint(1, 50))) for v in values] + [("none", None, None)] * 3 + [("one", 4.0, None)]


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_percentiles_of_odd_values(spark, keys):
    df = spark.createDataFrame(odd_rows(), "g string, x double, y double").repartition(3)
    x, y = F.col("x"), F.col("y")
    wanted = {"a": (x, 0.0), "b": (x, 0.25), "c": (y, 0.9), "d": (x, 1.0), "e": (y, 0.5)}
    got = stats.percentiles(df, keys, wanted, F.count("y").alias("n")).collect()
    expected = df.groupBy(*keys).agg(*[F.percentile(c, k).alias(n) for n, (c, k) in wanted.items()], F.count("y").alias("n")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_whole_column_percentiles_gather_no_values(spark):
    df = spark.createDataFrame([(k, float(k * k)) for k in range(50)] + [(50, None)], "k int, v double")
    e = Engine(spark).register("t", df)
    for formula, expected in (("=PERCENTILE(t[v],0.3)+QUARTILE(t[v],3)*SUM(t[k])", 216.3 + 1350.75 * 1275), ("=MEDIAN(t[v])", 600.5), ("=QUARTILE.INC(t[v],5)", None)):
        out = e.query(formula)
        assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString() and "median" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = out.first()
        assert got.value == pytest.approx(expected) if expected is not None else got.error == "#NUM!"


@pytest.mark.parametrize("name", ["column_statistics", "moments", "percentile_inc"])
def test_queries_gather_no_values(spark, data, name):
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan


def test_conditional_median(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 5.0), ("b", None), ("c", 0.5)], "g string, v double")
    got = criteria.conditional(df, "v", "median", {"v": ">=1"}, ["g"])
    assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {("a", 2.0), ("b", 5.0), ("c", None)}
    assert criteria.conditional(df, "v", "median", {"v": ">=1"}).first().value == 3.5
