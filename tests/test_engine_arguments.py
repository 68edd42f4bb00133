"""Every argument of a table function counts or is refused; first rows, wildcards and headers on hand-made rows."""

import pytest

from cellweave.operators import joins, reshape
from cellweave.plans.compiler import NotColumnar
from cellweave.plans.engine import Engine


@pytest.fixture
def e(spark):
    rows = [(1, "a", "X", 1.0), (2, "A", "x", 2.0), (3, "b", "Y", 4.0), (4, "b", "Y", 8.0)]
    return Engine(spark).register("T", spark.createDataFrame(rows, "id int, k string, g string, v double"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_filters_and_slices(e):
    assert rows(e.query("=GROUPBY(T[k],T[v],SUM,,0,,T[v]>1.5)")) == [("A", 2.0), ("b", 12.0)]
    assert rows(e.query("=PIVOTBY(T[k],T[g],T[v],SUM,,0,,0,,T[v]<8)")) == [("A", 3.0, None), ("b", None, 4.0)]
    assert e.query("=TAKE(T,2,1)").columns == ["id"] and e.query("=DROP(T,1,-1)").columns == ["id", "k", "g"]
    assert [r.id for r in e.query("=TAKE(T,,-1)").select("v").collect() and e.query("=SORTBY(T,T[g],-1,T[id],-1)").collect()] == [4, 3, 2, 1]


def test_whole_columns_and_nested(e):
    get = lambda f: e.query(f).first().value
    assert get("=COUNTA(UNIQUE(T[k]))") == 2 and get("=SUM(FILTER(T[v],T[v]>1.5))+1") == 15
    assert get("=LARGE(T[v],2)") == 4 and get("=SUMPRODUCT(T[id],T[v])") == 49 and get("=PERCENTILE.INC(T[v],0.5)") == 3
    assert e.query("=SMALL(T[v],9)").first().error == "#NUM!" and e.query("=CORREL(T[v],T[v])*2").first().value == pytest.approx(2)
    plan = e.query("=SUM(T[v])/COUNT(T[v])+MAX(T[v])")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


@pytest.mark.parametrize("formula", ["=GROUPBY(T[k],T[v],SUM,,0,,,1)", "=UNIQUE(T[k],TRUE)", "=SORT(T,1,1,TRUE)", "=FILLDOWN(T[k],3)", "=TEXTJOIN(\",\",TRUE,T[k])", "=XLOOKUP(T[k],T[k],T[v],,3)", "=PIVOTBY(T[k],T[g],T[v],SUM,,1,,0)", "=TAKE(T,1,9,9)"])
def test_what_no_plan_covers_is_refused(e, formula):
    with pytest.raises(NotColumnar):
        e.query(formula)


def test_unique_shows_first_rows(spark):
    df = spark.createDataFrame([(1, "a", "B"), (2, "A", "b"), (3, "c", "d")], "id int, x string, y string")
    assert rows(reshape.unique(df, ["x", "y"], order=["id"])) == [("a", "B"), ("c", "d")]
    assert all(r in {("a", "B"), ("A", "b"), ("c", "d")} for r in rows(reshape.unique(df.drop("id"))))


def test_transpose_repeated_headers(spark):
    df = spark.createDataFrame([("h", "1"), ("h", "2"), ("i", "3")], "n string, v string")
    assert [tuple(r) for r in reshape.transpose(df, "n").select("name", "h", "h_2", "i").collect()] == [("v", "1", "2", "3")]


def test_wildcards(spark):
    table = spark.createDataFrame([(1, "a~xb"), (2, "a*b"), (3, "AXXB"), (4, "q?"), (5, "qr"), (6, "x(y")], "o int, k string")
    probes = spark.createDataFrame([("a~*b",), ("a~*b",), ("a*b",), ("q~?",), ("q?",), ("*y",), ("X(?",), ("none*",), (None,)], "p string")
    got = joins.wildcard_lookup(probes, "p", table.withColumnRenamed("o", "ord").selectExpr("*", "ord as v"), "k", ["v"], "ord")
    assert sorted((r.p or "", r.v) for r in got.collect()) == [("", None), ("*y", 6), ("X(?", 6), ("a*b", 1), ("a~*b", 2), ("a~*b", 2), ("none*", None), ("q?", 4), ("q~?", 4)]
