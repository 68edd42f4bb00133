"""Formulas in memory and over columns."""

import math

import pytest

from cellweave.functions.registry import TABLE
from cellweave.functions.values import Arr, Err, criterion, single
from cellweave.plans.compiler import Compiler, with_column
from cellweave.plans.engine import Engine
from cellweave.plans.evaluator import Table, Workbook, evaluate
from cellweave.plans.parser import SyntaxProblem, parse


def book():
    b = Workbook()
    for r, v in enumerate((1, 2, 3), 1):
        b.set("Data", r, 1, v)
        b.set("Data", r, 4, v * 10)
    b.set("Data", 1, 2, "x")
    b.set("Data", 2, 2, True)
    b.set("Data", 5, 1, "=SUM(A1:A3)")
    b.set("Data", 6, 1, "=A7")
    b.set("Data", 7, 1, "=A6")
    b.sheets["Other"] = {(1, 1): 42.0}
    b.names = {(None, "rate"): "0.15", (None, "twice"): "LAMBDA(x,x*2)"}
    return b


CASES = [
    ("-2^2", 4), ("2^3^2", 64), ("50%", 0.5), ("\"a\"&1", "a1"), ("1/0", "#DIV/0!"), ("\"a\"=\"A\"", True), ("SUM(A1:A3,10)", 16), ("SUM(TRUE,\"1\")", 2), ("A5", 6), ("A6", "#REF!"),
    ("Other!A1", 42), ("rate*100", 15), ("twice(4)", 8), ("nothing()", "#NAME?"), ("IFERROR(1/0,\"ok\")", "ok"), ("ROUND(-2.5,0)", -3), ("MOD(10,-3)", -2), ("ROUND(1.005,2)", 1.0),
    ("VLOOKUP(2,A1:D3,4,FALSE)", 20), ("MATCH(2.5,A1:A3,1)", 2), ("XLOOKUP(9,A1:A3,D1:D3,\"none\")", "none"), ("INDEX(A1:D3,2,4)", 20), ("SUMIFS(D1:D3,A1:A3,\">=2\")", 50), ("COUNTIF(B1:B3,\"x*\")", 1),
    ("TEXTJOIN(\"-\",TRUE,A1:A3)", "1-2-3"), ("PROPER(\"o'neil 2nd\")", "O'Neil 2Nd"), ("SUBSTITUTE(\"aXbXc\",\"X\",\"-\",2)", "aXb-c"), ("DATE(2024,2,29)", 45351), ("EOMONTH(DATE(2024,1,31),1)", 45351),
    ("TEXT(1234.5,\"#,##0.00\")", "1,234.50"), ("TEXT(45351,\"yyyy-mm-dd\")", "2024-02-29"), ("ROMAN(1999)", "MCMXCIX"), ("BASE(255,16)", "FF"), ("IMSUM(\"3+4i\",\"1-i\")", "4+3i"),
    ("REDUCE(0,{1,2,3},LAMBDA(a,x,a+x))", 6), ("SUM(MAP({1,2;3,4},LAMBDA(x,x^2)))", 30), ("LET(x,5,y,x+1,x*y)", 30), ("SUM(SEQUENCE(3,2))", 21), ("COUNTA(UNIQUE({1;1;2}))", 2), ("ROWS(FILTER(A1:A3,A1:A3>1))", 2),
    ("GROUPBY({\"b\";\"a\";\"b\"},{1;2;3},SUM)", "a"), ("SUM(BINS({1;5;9;10},{0;5;10}))", 23), ("INDEX(ROLLING({1;2;3;4},2,SUM),4)", 7), ("FUZZYLOOKUP(\"Microsfot\",{\"Microsoft\";\"Apple\"})", "Microsoft"),
    ("PARSEJSON(\"{\"\"a\"\":[1,2]}\",\"a[1]\")", 2), ("PMT(0.01,12,1000)", -88.84878867834166), ("IRR({-100;60;60})", 0.13066238629180748), ("NORM.S.DIST(1,TRUE)", 0.8413447460685429), ("GAMMA(5)", 24),
    ("T.INV.2T(0.05,10)", 2.2281388519649385), ("CHISQ.DIST.RT(3.84,1)", 0.05004352124870519), ("PERCENTILE.EXC({1;2;3;4},0.5)", 2.5), ("TRIMMEAN({1;2;3;100},0.5)", 2.5), ("MODE({2;1;1;2})", 2), ("YEARFRAC(DATE(2024,1,1),DATE(2024,7,1))", 0.5),
    ("CONVERT(1,\"mi\",\"km\")", 1.609344), ("BESSELJ(1,0)", 0.7651976865579666), ("NETWORKDAYS(DATE(2024,1,1),DATE(2024,1,31))", 23), ("CEILING(2.3,0.5)", 2.5), ("ENCODEURL(\"a b~\")", "a%20b~"),
]


@pytest.mark.parametrize("formula,expected", CASES)
def test_values(formula, expected):
    got = single(evaluate(formula, book(), "Data", (20, 20)))
    if isinstance(expected, str) and expected.startswith("#"):
        assert isinstance(got, Err) and got.code == expected
    elif isinstance(expected, (bool, str)):
        assert got == expected
    else:
        assert math.isclose(got, expected, rel_tol=1e-9, abs_tol=1e-12)


def test_names_of_functions():
    assert len(TABLE) >= 520
    with pytest.raises(SyntaxProblem):
        parse("1+")


def test_tables_in_workbooks():
    b = Workbook()
    for r, row in enumerate([("Item", "Amt"), ("a", 1), ("b", 2)], 1):
        for c, v in enumerate(row, 1):
            b.set("S", r, c, v)
    b.tables["sales"] = Table("Sales", "S", 1, 1, 3, 2)
    assert evaluate("SUM(Sales[Amt])", b, "S") == 3
    assert single(evaluate("Sales[[#Headers],[Amt]]", b, "S")) == "Amt"


def test_tablejoin_in_memory():
    b = Workbook()
    for r, row in enumerate([("id", "customer"), (1, "a"), (2, "b"), (3, "c")], 1):
        for c, v in enumerate(row, 1):
            b.set("S", r, c, v)
    for r, row in enumerate([("customer", "name"), ("A", "Ann"), ("b", "Bob"), ("b", "Ben"), ("d", "Dan")], 1):
        for c, v in enumerate(row, 4):
            b.set("S", r, c, v)
    out = evaluate('TABLEJOIN(A1:B4,D1:E5,"customer","customer","full")', b, "S")
    assert isinstance(out, Arr)
    assert out.rows == [["id", "customer", "name"], [1, "a", "Ann"], [2, "b", "Bob"], [2, "b", "Ben"], [3, "c", None], [None, "d", "Dan"]]


@pytest.mark.parametrize("rule,value,passes", [(">=3", 3.0, True), (">=3", "3", False), ("a*", "Abc", True), ("<>", None, False), ("<>x", None, True), ("=", None, True), ("", "", True), ("~*", "*", True)])
def test_criteria(rule, value, passes):
    assert criterion(rule)(value) is passes


def test_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0, "Ab"), (4.0, 2.0, None), (None, 5.0, "12")], "a double, b double, s string")
    run = lambda f: [tuple(r) for r in Compiler(df, "t").with_column("v", f, errors=True).select("v", "v_err").collect()]
    assert run("[@a]/[@b]") == [(None, "#DIV/0!"), (2.0, None), (0.0, None)]
    assert run('IF([@s]="AB",1,[@s]*2)') == [(1.0, None), (0.0, None), (24.0, None)]
    assert run('[@s]*1')[0] == (None, "#VALUE!")
    assert run('IFERROR([@a]/[@b],-1)') == [(-1.0, None), (2.0, None), (0.0, None)]
    assert run('SUM(t[a])-[@a]') == [(4.0, None), (1.0, None), (5.0, None)]
    assert run('[@a]&"-"&UPPER([@s])')[0] == ("1-AB", None)
    assert run('ROMAN([@b]+1)') == [("I", None), ("III", None), ("VI", None)]
    assert run('LET(x,[@b],SWITCH(x,0,"zero",2,"two","other"))') == [("zero", None), ("two", None), ("other", None)]


def test_engine(spark):
    e = Engine(spark).register("t", spark.createDataFrame([("b", 1.0), ("a", 2.0), ("B", 3.0)], "k string, v double"))
    assert [tuple(r) for r in e.query("=GROUPBY(t[k],t[v],SUM)").collect()] == [("a", 2.0), ("B", 4.0), ("Total", 6.0)]
    assert e.query("=SUM(t[v])/COUNT(t[v])").first()[0] == 2.0
    assert {r[0] for r in e.query('=FILTER(t,t[v]>1)').select("v").collect()} == {2.0, 3.0}
    assert e.query("=SUM({1,2,3})").first()[0] == "6"
    with pytest.raises(ValueError):
        e.function("SUM", len)


def test_native_plan(spark):
    df = with_column(spark.range(10).withColumn("x", __import__("pyspark").sql.functions.col("id").cast("double")), "y", "=ROUND([@x]*1.5,1)+IF([@x]>3,1,0)")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
