"""Edge cases of operators: case, blanks, ties, empty tables."""

import pytest

from cellweave.operators import criteria, groups, joins, reshape, stats, tools, windows


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_tablejoin_blank_and_case(spark):
    left = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "B")], "id int, k string")
    right = spark.createDataFrame([("A", "x"), ("", "y"), (None, "z"), ("b", "u"), ("b", "v")], "k string, id string")
    assert sorted(rows(joins.tablejoin(left, right, ["k"])), key=str) == [(1, "a", "x"), (4, "B", "u"), (4, "B", "v")]
    assert joins.tablejoin(left, right, ["k"]).columns == ["id", "k", "id_2"]
    assert len(rows(joins.tablejoin(left, right, ["k"], how="full"))) == 7


def test_asof_large_and_small_agree(spark):
    table = spark.createDataFrame([(float(k), k) for k in range(0, 100, 7)], "k double, v int")
    probes = spark.createDataFrame([(float(x),) for x in (-1, 0, 6.5, 7, 50, 1000)], "x double")
    got = {r.x: r.v for r in joins.asof(probes, "x", table, "k", ["v"]).collect()}
    assert got == {-1.0: None, 0.0: 0, 6.5: 0, 7.0: 7, 50.0: 49, 1000.0: 98}
    after = {r.x: r.v for r in joins.asof(probes, "x", table, "k", ["v"], following=True).collect()}
    assert after == {-1.0: 0, 0.0: 0, 6.5: 7, 7.0: 7, 50.0: 56, 1000.0: None}


def test_fuzzy(spark):
    left = spark.createDataFrame([("Microsfot",), ("aple",), ("zzz",), (None,)], "n string")
    table = spark.createDataFrame([(1, "Microsoft"), (2, "Apple"), (3, "apple")], "o int, k string")
    got = {r.n: r.v for r in joins.fuzzylookup(left, "n", table.withColumnRenamed("k", "k").selectExpr("o", "k", "k as v"), "k", "v", "o", 0.7).collect()}
    assert got == {"Microsfot": "Microsoft", "aple": "Apple", "zzz": None, None: None}


def test_groupby_depths(spark):
    df = spark.createDataFrame([("x", "p", 1.0), ("X", "q", 2.0), ("y", "p", 4.0), (None, "p", 8.0)], "a string, b string, v double")
    assert rows(groups.groupby(df, ["a", "b"], ["v"], "SUM", 2)) == [(None, "p", 8.0), (None, None, 8.0), ("x", "p", 1.0), ("X", "q", 2.0), ("X", None, 3.0), ("y", "p", 4.0), ("y", None, 4.0), ("Total", None, 15.0)]
    assert rows(groups.groupby(df, ["a"], ["v"], "SUM", -1))[0] == ("Total", 15.0)
    assert rows(groups.groupby(df, ["a"], ["v"], "SUM", 0, sort=-2))[0] == (None, 8.0)


def test_pivotby_blank_intersections(spark):
    df = spark.createDataFrame([("a", "Q1", 1.0), ("a", "Q2", 2.0), ("b", "Q1", 3.0)], "k string, q string, v double")
    assert rows(groups.pivotby(df, ["k"], "q", "v")) == [("a", 1.0, 2.0, 3.0), ("b", 3.0, None, 3.0), ("Total", 4.0, 2.0, 6.0)]


def test_windows(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 2.0, None, 4.0])], "o int, v double")
    assert [r[0] for r in windows.rolling(df, "v", 2, "SUM", ["o"]).orderBy("o").select("rolling").collect()] == [None, 3.0, None, None]
    assert [r[0] for r in windows.rolling(df, "v", 2, "MEDIAN", ["o"], min_periods=1).orderBy("o").select("rolling").collect()] == [1.0, 1.5, 2.0, 4.0]
    assert [r[0] for r in windows.filldown(df, "v", ["o"]).orderBy("o").select("v").collect()] == [1.0, 2.0, 2.0, 4.0]
    ties = spark.createDataFrame([(5.0,), (5.0,), (9.0,)], "v double")
    assert sorted(r[1] for r in windows.rank(ties, "v", average=True).collect()) == [1.0, 2.5, 2.5]
    assert windows.fill_series([1, 3], 2) == [5, 7]


def test_bins(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (9.0,), (10.0,)], "v double")
    assert [r[2] for r in stats.bins(df, "v", [0, 5, 10]).orderBy("low").collect()] == [1, 2]
    assert [r[2] for r in stats.bins(df, "v", 3).orderBy("low").collect()] == [1, 1, 2]
    with pytest.raises(ValueError):
        stats.bins(df, "v", [5, 5])


def test_criteria_and_duplicates(spark):
    df = spark.createDataFrame([(1, "East", 5.0), (2, "Eastern", 7.0), (3, "west", None), (4, "EAST", 5.0)], "i int, r string, s double")
    keep = lambda g, **k: sorted(r.i for r in criteria.advanced_filter(df, g, **k).collect())
    assert keep([{"r": "east"}]) == [1, 2, 4]
    assert keep([{"r": "=east"}]) == [1, 4]
    assert keep([{"s": ">4", "r": "east"}, {"r": "=west"}]) == [1, 2, 3, 4]
    assert keep([{"s": "="}]) == [3]
    assert sorted(r.i for r in criteria.remove_duplicates(df, ["r", "s"], ["i"]).collect()) == [1, 2, 3]
    assert sorted(r.i for r in criteria.top_n(df, "s", 1).collect()) == [2]


def test_kth_by_selection(spark, monkeypatch):
    """Narrowing brackets finds what sorting finds, also among ties."""
    from pyspark.sql import functions as F

    df = spark.range(5000).select((F.col("id") * 7919 % 1000).cast("double").alias("v"))
    values = sorted((r.v for r in df.collect()), reverse=True)
    monkeypatch.setattr(criteria, "MOST_TOP", 20)
    for k in (1, 20, 21, 500, 2500, 4999, 5000):
        assert criteria.kth(df, "v", k) == values[k - 1]
        assert criteria.kth(df, "v", k, False) == values[-k]
    assert criteria.kth(df, "v", 5001) is None
    same = spark.range(300).select(F.lit(4.0).alias("v"))
    assert criteria.kth(same, "v", 100) == 4.0


def test_long_slices(spark, monkeypatch):
    df = spark.range(50).selectExpr("id % 5 as k", "id")
    monkeypatch.setattr(reshape, "MOST_TOP", 3)
    assert [r.id for r in reshape.take(df, 6, ["k", "id"]).collect()] == [0, 5, 10, 15, 20, 25]
    assert [r.id for r in reshape.take(df, -4, ["id"]).collect()] == [46, 47, 48, 49]
    assert reshape.drop(df, 6, ["k"]).count() == 44 and reshape.drop(df, -6, ["id"]).count() == 44


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert rows(groups.groupby(df, ["k"], ["v"])) == []
    assert rows(joins.tablejoin(df, df, ["k"])) == []
    assert rows(reshape.unique(df)) == []


def test_reshape(spark):
    df = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "i int, n string")
    assert [r.i for r in reshape.take(df, -2, ["i"]).collect()] == [3, 4]
    assert sorted(r.i for r in reshape.drop(df, 2, ["i"]).collect()) == [2, 3, 4]
    assert [r.i for r in reshape.chooserows(df, [-1, 1, 1], ["i"]).collect()] == [4, 0, 0]
    with pytest.raises(ValueError):
        reshape.choosecols(df, [3])


def test_tools(spark):
    assert abs(tools.goal_seek(lambda x: x * x, 2.0, 1.0) - 2**0.5) < 1e-6
    x, best = tools.solve([3, 2], [[1, 1], [1, 3]], [4, 6])
    assert best == pytest.approx(12)
    x, best = tools.solve([5, 4], [[6, 4], [1, 2]], [24, 6], whole=[0, 1])
    assert best == pytest.approx(20)
    assert tools.solve([1], [[1], [-1]], [1, -2]) is None
    df = spark.createDataFrame([("ann lee",), ("bob ray",)], "n string")
    assert [r[1] for r in tools.flash_fill(df, "n", [("ann lee", "A. LEE")], "f").collect()] == ["A. LEE", "B. RAY"]
