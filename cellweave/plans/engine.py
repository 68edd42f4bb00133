"""Formulas over registered tables: a call of a table function at the top becomes a DataFrame plan, a formula of columns
a column, and whole-column aggregates one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import TABLE
from ..operators import groups, joins, reshape, stats, windows
from .compiler import AGGREGATES, CONDITIONAL, ORDERED, WIDER, Compiler, NotColumnar, as_bool
from .evaluator import Evaluator, Workbook
from .parser import MISSING_ARG, Array, Binary, Call, Lit, Name, Structured, Unary, parse


class Engine:
    """A catalogue of tables, names and custom functions. Table names are case-insensitive."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.orders: dict[str, list[str]] = {}
        self.names: dict[str, str] = {}
        self.custom: dict[str, Callable] = {}

    def register(self, name: str, df: DataFrame, order: list[str] | None = None) -> "Engine":
        """A table under a name; order names the columns that say which row comes first."""
        self.tables[name.lower()], self.orders[name.lower()] = df, order or df.columns[:1]
        return self

    def define(self, name: str, formula: str) -> "Engine":
        self.names[name.lower()] = formula
        return self

    def function(self, name: str, body: Callable) -> "Engine":
        """A custom function of values; built-in names win, so they are refused."""
        if name.upper() in TABLE:
            raise ValueError(f"{name} is built in")
        self.custom[name.lower()] = body
        return self

    def with_column(self, table: str, name: str, formula: str, errors: bool = False) -> DataFrame:
        df = self.tables[table.lower()]
        return Compiler(df, table, self.tables, self.names, self.custom).with_column(name, formula, errors)

    def query(self, formula: str) -> DataFrame:
        """The rows a formula stands for; a scalar gives one row (value, error)."""
        tree = parse(formula)
        if isinstance(tree, Call) and tree.name in FRAMES or isinstance(tree, (Name, Structured)) and mentions(tree, self.tables):
            return self.frame(tree)[0]
        try:
            tables = dict(self.tables)
            tree = self.nested(tree, tables)
            return Compiler(None, None, tables, self.names).scalar(tree)
        except NotColumnar:
            if mentions(tree, tables):  # an empty workbook knows no tables
                raise
            from ..functions.values import Err, text

            out = Evaluator(Workbook({"Sheet1": {}}, names={(None, k): v for k, v in self.names.items()}), custom=self.custom).evaluate(formula)
            rows = out.rows if hasattr(out, "rows") else [[out]]
            return self.spark.createDataFrame([[v.code if isinstance(v, Err) else text(v) for v in row] for row in rows], ", ".join(f"c{k + 1} string" for k in range(len(rows[0]))))

    def nested(self, tree, tables: dict[str, DataFrame]):
        """The formula with each table function inside an aggregate as a table of its own, added to tables."""
        if isinstance(tree, Call):
            total = tree.name in AGGREGATES or tree.name in CONDITIONAL or tree.name in WIDER or tree.name in ORDERED
            args = []
            for a in tree.args:
                if total and isinstance(a, Call) and a.name in FRAMES:
                    df = self.frame(a)[0]
                    if len(df.columns) != 1:
                        raise NotColumnar("an aggregate takes one column of a table function")
                    name = f"_nested{len(tables)}"
                    tables[name] = df
                    args.append(Structured(name, df.columns[0], df.columns[0]))
                else:
                    args.append(self.nested(a, tables))
            return Call(tree.name, tuple(args))
        if isinstance(tree, Binary):
            return Binary(tree.op, self.nested(tree.left, tables), self.nested(tree.right, tables))
        if isinstance(tree, Unary):
            return Unary(tree.op, self.nested(tree.arg, tables))
        return tree

    # Tables.
    def source(self, tree) -> tuple[DataFrame, list[str], list[str]]:
        """A table or some of its columns: the whole frame, the chosen columns, the order."""
        if isinstance(tree, Name) and tree.name.lower() in self.tables:
            df = self.tables[tree.name.lower()]
            return df, df.columns, self.orders[tree.name.lower()]
        if isinstance(tree, Structured) and tree.table and tree.table.lower() in self.tables:
            df = self.tables[tree.table.lower()]
            low = [c.lower() for c in df.columns]
            if tree.first is None:
                return df, df.columns, self.orders[tree.table.lower()]
            a, b = low.index(tree.first.lower()), low.index(tree.last.lower())
            return df, df.columns[a : b + 1], self.orders[tree.table.lower()]
        if isinstance(tree, Call):
            df, order = self.frame(tree)
            return df, df.columns, order
        raise NotColumnar(f"{tree} is no table")

    def frame(self, tree) -> tuple[DataFrame, list[str]]:
        if isinstance(tree, (Name, Structured)):
            df, columns, order = self.source(tree)
            return df.select(*columns), [c for c in order if c in columns] or columns[:1]
        if not isinstance(tree, Call) or tree.name not in FRAMES:
            raise NotColumnar("no table function")
        return FRAMES[tree.name](self, list(tree.args))


def mentions(tree, tables) -> bool:
    """Whether a formula names a table."""
    if isinstance(tree, Name):
        return tree.name.lower() in tables
    if isinstance(tree, Structured):
        return bool(tree.table) and tree.table.lower() in tables
    parts = tree.args if isinstance(tree, Call) else (tree.left, tree.right) if isinstance(tree, Binary) else (tree.arg,) if isinstance(tree, Unary) else ()
    return any(mentions(p, tables) for p in parts)


def unused(args, *places: int) -> None:
    """Refuses arguments at places that a plan can't honour, and any beyond the last one known."""
    for k in places:
        if len(args) > k and args[k] != MISSING_ARG and value(args, k) not in (None, 0, False):
            raise NotColumnar(f"argument {k + 1} is not supported over tables")


def most(args, n: int) -> None:
    if len(args) > n:
        raise NotColumnar(f"at most {n} arguments")


def value(args, k, default=None):
    """A literal argument."""
    if len(args) <= k or args[k] == MISSING_ARG:
        return default
    a = args[k]
    if isinstance(a, Lit):
        return a.value
    if isinstance(a, Unary) and a.op == "-" and isinstance(a.arg, Lit):
        return -a.arg.value
    if isinstance(a, Array):
        return [value([x], 0) for row in a.rows for x in row]
    if isinstance(a, Name):
        return a.name
    raise NotColumnar("the argument must be a literal")


def qualified(tree, table: str):
    """A condition over a table's columns, with Table[column] read per row."""
    if isinstance(tree, Structured) and tree.table and tree.table.lower() == table:
        return Structured(None, tree.first, tree.last, True)
    if isinstance(tree, Binary):
        # * and + of conditions are and and or
        return Binary(tree.op, qualified(tree.left, table), qualified(tree.right, table))
    if isinstance(tree, Unary):
        return Unary(tree.op, qualified(tree.arg, table))
    if isinstance(tree, Call):
        return Call(tree.name, tuple(qualified(a, table) for a in tree.args))
    return tree


def name_of(tree) -> str:
    return (tree.table if isinstance(tree, Structured) else tree.name).lower()


def filter_(e: Engine, args):
    df, columns, order = e.source(args[0])
    c = Compiler(df, name_of(args[0]), e.tables, e.names)
    test = as_bool(c.compile(qualified(args[1], name_of(args[0]))))
    keep = test.col & test.err.isNull() if test.err is not None else test.col
    return c.joined(df).filter(keep).select(*columns), [o for o in order if o in columns] or columns[:1]


def sort(e: Engine, args):
    most(args, 4)
    unused(args, 3)
    df, columns, order = e.source(args[0])
    keys, ways = value(args, 1, 1), value(args, 2, 1)
    keys, ways = (v if isinstance(v, list) else [v] for v in (keys, ways))
    ways += ways[-1:] * (len(keys) - len(ways))
    return reshape.sort(df, [(columns[int(k) - 1], w == -1) for k, w in zip(keys, ways, strict=True)], order).select(*columns), order


def sortby(e: Engine, args):
    df, columns, order = e.source(args[0])
    pairs = [(args[k].first, value(args, k + 1, 1) == -1) for k in range(1, len(args), 2)]
    return reshape.sort(df, pairs, order).select(*columns), order


def unique(e: Engine, args):
    most(args, 3)
    unused(args, 1)
    df, columns, order = e.source(args[0])
    return reshape.unique(df, columns, bool(value(args, 2, False)), [o for o in order if o in df.columns]), columns[:1]


def take(e: Engine, args, drop: bool = False):
    most(args, 3)
    df, order = e.frame(args[0])
    n, wide = value(args, 1), value(args, 2)
    if n is not None:
        df = (reshape.drop if drop else reshape.take)(df, int(n), order)
    if wide is None:
        return df, order
    wide, all_ = int(wide), df.columns
    cut = all_[wide:] if wide >= 0 else all_[:wide]
    columns = cut if drop else [c for c in all_ if c not in cut] if wide >= 0 else all_[wide:]
    if not columns:
        raise NotColumnar("no column is left")
    return df.select(*columns), [o for o in order if o in columns] or columns[:1]


def choosecols(e: Engine, args):
    df, order = e.frame(args[0])
    return reshape.choosecols(df, [int(value([a], 0)) for a in args[1:]]), order


def vstack(e: Engine, args):
    return reshape.vstack([e.frame(a)[0] for a in args]), []


def hstack(e: Engine, args):
    (a, oa), (b, ob) = e.frame(args[0]), e.frame(args[1])
    return joins.hstack(a, b, oa, ob), ["_row"]


def tablejoin(e: Engine, args):
    most(args, 6)
    left, right = e.frame(args[0])[0], e.frame(args[1])[0]
    listed = lambda v: v if isinstance(v, list) else [v]
    on = listed(value(args, 2))
    suffix = {"suffix": value(args, 5)} if value(args, 5) is not None else {}
    return joins.tablejoin(left, right, on, listed(value(args, 3)) if value(args, 3) is not None else None, (value(args, 4) or "inner").lower(), **suffix), on


def filtered(e: Engine, df, args, k: int, table):
    """The table's rows that the condition at place k keeps."""
    if len(args) <= k or args[k] == MISSING_ARG:
        return df
    c = Compiler(df, name_of(table), e.tables, e.names)
    test = as_bool(c.compile(qualified(args[k], name_of(table))))
    return c.joined(df).filter(test.col & test.err.isNull() if test.err is not None else test.col).select(*df.columns)


def groupby(e: Engine, args):
    """Header modes change nothing, as a frame's columns always have names."""
    most(args, 8)
    unused(args, 7)
    df, keys, _ = e.source(args[0])
    other, values, _ = e.source(args[1])
    if other is not df:
        raise NotColumnar("columns of one table")
    sort_ = value(args, 5)
    df = filtered(e, df, args, 6, args[0])
    return groups.groupby(df, keys, values, value(args, 2).upper(), int(value(args, 4, 1)), None if sort_ is None else int(sort_)), keys


def pivotby(e: Engine, args):
    most(args, 10)
    unused(args, 6, 8)
    df, rows, _ = e.source(args[0])
    deep = [int(value(args, k, 1)) for k in (5, 7)]
    if deep not in ([1, 1], [0, 0]):
        raise NotColumnar("both totals, or none")
    out = filtered(e, df, args, 9, args[0])
    return groups.pivotby(out, rows, e.source(args[1])[1][0], e.source(args[2])[1][0], value(args, 3).upper(), totals=deep == [1, 1]), rows


def rolling(e: Engine, args):
    most(args, 4)
    df, columns, order = e.source(args[0])
    least = value(args, 3)
    out = windows.rolling(df, columns[0], int(value(args, 1)), value(args, 2), order, None, None if least is None else int(least))
    return out.select(*order, "rolling"), order


def bins(e: Engine, args):
    most(args, 3)
    df, columns, _ = e.source(args[0])
    edges = value(args, 1)
    return stats.bins(df, columns[0], edges if isinstance(edges, list) else int(edges), bool(value(args, 2, False))), ["low"]


def frequency(e: Engine, args):
    df, columns, _ = e.source(args[0])
    edges = value(args, 1)
    return stats.frequency(df, columns[0], edges if isinstance(edges, list) else [edges]), ["edge"]


def fuzzylookup(e: Engine, args):
    most(args, 5)
    df, needle, _ = e.source(args[0])
    table, key, order = e.source(args[1])
    out = e.source(args[2])[1][0] if len(args) > 2 and args[2] != MISSING_ARG else key[0]
    found = joins.fuzzylookup(df, needle[0], table.withColumn("_out", F.col(out)), key[0], "_out", order[0], value(args, 3, 0.8))
    return found.fillna({"_out": value(args, 4)}) if value(args, 4) is not None else found, needle


def lookup(e: Engine, args):
    most(args, 6)
    df, needle, order = e.source(args[0])
    table, key, by = e.source(args[1])
    values = e.source(args[2])[1]
    mode, way, missing = int(value(args, 4, 0)), int(value(args, 5, 1)), value(args, 3)
    if mode == 0 and way in (1, -1):
        return joins.lookup(df, needle[0], table, key[0], values, by, missing, way == -1), order
    if mode in (-1, 1) and way == 1:
        out = joins.asof(df, needle[0], table, key[0], values, following=mode == 1)
    elif mode == 2 and way == 1 and len(by) == 1:
        out = joins.wildcard_lookup(df, needle[0], table, key[0], values, by[0])
    else:
        raise NotColumnar(f"match mode {mode} with search mode {way}")
    return out.fillna({v: missing for v in values}) if missing is not None else out, order


def filldown(e: Engine, args):
    most(args, 2)
    way = value(args, 1, 1)
    if way not in (1, 2):
        raise NotColumnar("tables are filled down or up")
    df, columns, order = e.source(args[0])
    for c in columns:
        df = windows.filldown(df, c, order, up=way == 2)
    return df, order


FRAMES = {
    "FILTER": filter_, "SORT": sort, "SORTBY": sortby, "UNIQUE": unique, "TAKE": take, "DROP": lambda e, a: take(e, a, True), "CHOOSECOLS": choosecols, "VSTACK": vstack, "HSTACK": hstack,
    "TABLEJOIN": tablejoin, "GROUPBY": groupby, "PIVOTBY": pivotby, "ROLLING": rolling, "BINS": bins, "FREQUENCY": frequency, "FUZZYLOOKUP": fuzzylookup, "XLOOKUP": lookup, "FILLDOWN": filldown,
}
