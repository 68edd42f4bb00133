"""Editing of sheets, lambdas over columns, external books, nonlinear solving."""

import pytest

from cellweave.operators import grid, groups, tools
from cellweave.plans.compiler import Compiler
from cellweave.plans.evaluator import Evaluator, Workbook, evaluate


def book():
    b = Workbook()
    for r in range(1, 5):
        b.set("A", r, 1, r)
    b.set("A", 5, 1, "=SUM(A1:A4)")
    b.set("A", 1, 2, "=A1*$A$2")
    b.set("B", 1, 1, '=A!A5&"A1"')
    return b


def test_insert_and_remove():
    b = book()
    grid.insert(b, "A", 3)
    assert b.formulas["A", 6, 1] == "SUM(A1:A5)" and b.formulas["B", 1, 1] == 'A!A6&"A1"'
    assert Evaluator(b, "B").value_at("B", 1, 1) == "10A1"
    grid.insert(b, "A", 2, -1)
    assert b.formulas["A", 1, 2] == "A1*#REF!"
    assert str(Evaluator(b, "A").value_at("A", 1, 2)) == "#REF!"
    with pytest.raises(OverflowError):
        grid.insert(b, "A", 1, 2_000_000)
    grid.insert(b, "A", 1, columns=True)
    assert ("A", 5, 2) in b.formulas


def test_copy_move_rename():
    b = book()
    grid.fill_down(b, "A", 1, 2, 3, 2)
    assert [b.formulas["A", r, 2] for r in (1, 2, 3)] == ["A1*$A$2", "A2*$A$2", "A3*$A$2"]
    grid.move(b, "A", 1, 1, 4, 1, 1, 5)
    assert b.formulas["A", 5, 1] == "SUM(E1:E4)" and b.formulas["A", 3, 2] == "E3*$E$2"
    grid.rename_sheet(b, "A", "My sheet")
    assert b.formulas["B", 1, 1] == "'My sheet'!A5&\"A1\""
    assert Evaluator(b, "B").value_at("B", 1, 1) == "10A1"
    grid.remove_sheet(b, "My sheet")
    assert b.formulas["B", 1, 1] == '#REF!&"A1"'


def test_cells_in_long_form(spark):
    cells = spark.createDataFrame([("S", r, float(r)) for r in range(1, 6)] + [("T", 3, 0.0)], "sheet string, row long, num double")
    got = {(r.sheet, r.num): r.row for r in grid.insert_cells_rows(cells, "S", [2, 4]).collect()}
    assert got == {("S", 1.0): 1, ("S", 2.0): 3, ("S", 3.0): 4, ("S", 4.0): 6, ("S", 5.0): 7, ("T", 0.0): 3}
    assert sorted(r.row for r in grid.remove_cells_rows(cells, "S", 2, 3).filter("sheet = 'S'").collect()) == [1, 2, 3]


def test_other_books():
    b = Workbook({"S": {}, "[1]Rates": {(1, 1): 2.0}, "[1]Two words": {(2, 2): 3.0}})
    assert evaluate("[1]Rates!A1*'[1]Two words'!B2", b, "S").rows == [[6.0]]


def test_lambdas_over_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2.0), ([], 1.0)], "v array<double>, k double")
    c = lambda f, **k: [r[0] for r in Compiler(df, "t", **k).with_column("o", f).select("o").collect()]
    assert c("REDUCE(0,MAP([@v],LAMBDA(x,x*[@k])),LAMBDA(a,x,a+x))") == [12.0, 0.0]
    assert c("SUM([@v])+MAX([@v])") == [9.0, 0.0]
    assert c("AVERAGE([@v])") == [2.0, None]
    assert c("double([@k])+1", names={"double": "LAMBDA(x,x*2)"}) == [5.0, 3.0]
    assert c("LAMBDA(x,y,x-y)([@k],1)") == [1.0, 0.0]
    assert c("PLUSONE([@k])", custom={"plusone": lambda v: v + 1}) == [3.0, 2.0]
    assert c("HAS([@v],2)") == [True, False]


def test_lambda_aggregate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 2.0)], "k string, v double")
    assert dict(groups.groupby_lambda(df, ["k"], "v", "LAMBDA(v,MAX(v)-MIN(v))").collect()) == {"a": 4.0, "b": 0.0}


def test_nonlinear():
    x, best = tools.minimise(lambda v: (v[0] - 3) ** 2 + (v[1] + 1) ** 2, [0, 0])
    assert best < 1e-8
    x, best = tools.minimise(lambda v: v[0] ** 2 + v[1] ** 2, [2, 2], [lambda v: 1 - v[0] - v[1]])
    assert best == pytest.approx(0.5, abs=1e-3)
