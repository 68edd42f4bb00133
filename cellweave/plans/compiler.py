"""Formulas over table columns as Spark columns.

Every part compiles to a value and, where it can fail, a code of its error beside it; errors win over values as they do
in cells. What Spark's functions can express stays native; a call that they can't becomes one Arrow function whose body
is the library's own scalar function. Aggregates of whole columns become one-row frames that are joined once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import TABLE, VOLATILE, Function, lifted
from ..functions.values import Arr, Err, text
from ..operators.criteria import criterion
from ..operators.groups import measure
from ..operators.stats import percentiles
from .parser import MISSING_ARG, Apply, Array, Binary, Call, Lit, Name, Structured, Unary, parse

KINDS = {"n": "double", "t": "string", "b": "boolean"}


class NotColumnar(ValueError):
    """A formula that has no value per row."""


@dataclass
class Val:
    kind: str
    col: Column
    err: Column | None = None


def either(*errors: Column | None) -> Column | None:
    found = [e for e in errors if e is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def code(test: Column, error: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(error))


def as_number(v: Val) -> Val:
    if v.kind == "n":
        return Val("n", F.coalesce(v.col, F.lit(0.0)), v.err)
    if v.kind == "b":
        return Val("n", F.coalesce(v.col.cast("double"), F.lit(0.0)), v.err)
    t = F.trim(v.col)
    n = F.coalesce(t.try_cast("double"), F.rtrim(t, F.lit("%")).try_cast("double") / 100)
    return Val("n", F.coalesce(n, F.lit(0.0)), either(v.err, code(v.col.isNotNull() & n.isNull(), "#VALUE!")))


def number_text(c: Column) -> Column:
    """A number as text: whole ones without a point, others with their decimals, at most 15 of them."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    decimals = F.regexp_replace(F.regexp_replace(F.round(c, 15).cast("decimal(38,15)").cast("string"), "0+$", ""), "\\.$", "")
    return F.when(whole, F.floor(c).cast("bigint").cast("string")).otherwise(decimals)


def as_text(v: Val) -> Val:
    if v.kind == "t":
        return Val("t", F.coalesce(v.col, F.lit("")), v.err)
    if v.kind == "b":
        return Val("t", F.when(v.col, "TRUE").when(~v.col, "FALSE").otherwise(""), v.err)
    return Val("t", F.coalesce(number_text(v.col), F.lit("")), v.err)


def as_bool(v: Val) -> Val:
    if v.kind == "b":
        return Val("b", F.coalesce(v.col, F.lit(False)), v.err)
    if v.kind == "n":
        return Val("b", F.coalesce(v.col != 0, F.lit(False)), v.err)
    up = F.upper(v.col)
    n = v.col.try_cast("double")
    b = F.when(up == "TRUE", True).when(up == "FALSE", False).otherwise(n != 0)
    return Val("b", F.coalesce(b, F.lit(False)), either(v.err, code(v.col.isNotNull() & b.isNull(), "#VALUE!")))


TO = {"n": as_number, "t": as_text, "b": as_bool}
NATIVE: dict[str, Callable] = {}


def native(names: str, spec: str, kind: str):
    """Registers a builder of (value, error or None) from converted columns; * in spec repeats its last letter."""

    def put(build: Callable) -> Callable:
        def call(args: list[Val]) -> Val:
            letters = spec.replace("|", "")
            if letters.endswith("*"):
                letters = letters[:-1] + letters[-2] * max(0, len(args) - len(letters) + 1)
            if not len(spec.partition("|")[0].rstrip("*")) <= len(args) <= len(letters):
                return Val(kind, F.lit(None).cast(KINDS[kind]), F.lit("#VALUE!"))
            given = [TO[k](a) if k in TO else a for a, k in zip(args, letters, strict=False)]
            out = build(*[g.col for g in given])
            value, error = out if isinstance(out, tuple) else (out, None)
            return Val(kind, value, either(*[g.err for g in given], error))

        for n in names.split():
            NATIVE[n] = call
        return build

    return put


def simple(names: str, f, spec: str = "n", kind: str = "n") -> None:
    native(names, spec, kind)(f)


half = lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5)


def or_lit(c: Column | None, v: float) -> Column:
    return F.lit(v) if c is None else c


def power_of_ten(d: Column) -> Column:
    return F.pow(F.lit(10.0), F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("double"))


for _n, _f in (("ABS", F.abs), ("EXP", F.exp), ("SIN", F.sin), ("COS", F.cos), ("TAN", F.tan), ("ATAN", F.atan), ("SINH", F.sinh), ("COSH", F.cosh), ("TANH", F.tanh), ("ASINH", F.asinh), ("DEGREES", F.degrees), ("RADIANS", F.radians), ("SIGN", F.signum)):
    simple(_n, _f)
simple("INT", lambda x: F.floor(x).cast("double"))
native("SQRT", "n", "n")(lambda x: (F.when(x >= 0, F.sqrt(x)), code(x < 0, "#NUM!")))
native("LN", "n", "n")(lambda x: (F.when(x > 0, F.ln(x)), code(x <= 0, "#NUM!")))
native("LOG10", "n", "n")(lambda x: (F.when(x > 0, F.log10(x)), code(x <= 0, "#NUM!")))
native("ASIN", "n", "n")(lambda x: (F.asin(x), code(F.abs(x) > 1, "#NUM!")))
native("ACOS", "n", "n")(lambda x: (F.acos(x), code(F.abs(x) > 1, "#NUM!")))
native("MOD", "nn", "n")(lambda x, y: (F.when(y != 0, x - y * F.floor(x / F.nullif(y, F.lit(0.0)))), code(y == 0, "#DIV/0!")))
native("QUOTIENT", "nn", "n")(lambda x, y: (F.signum(x) * F.signum(y) * F.floor(F.abs(F.try_divide(x, y))), code(y == 0, "#DIV/0!")))
native("POWER", "nn", "n")(lambda x, y: power(x, y))
native("ROUND", "n|n", "n")(lambda x, d=None: half(x * power_of_ten(d)) / power_of_ten(d) if d is not None else half(x))
native("TRUNC ROUNDDOWN", "n|n", "n")(lambda x, d=None: F.signum(x) * F.floor(F.abs(x * power_of_ten(or_lit(d, 0.0))) + 1e-9) / power_of_ten(or_lit(d, 0.0)))
native("ROUNDUP", "nn", "n")(lambda x, d: F.signum(x) * F.ceil(F.abs(x * power_of_ten(d)) - 1e-9) / power_of_ten(d))
native("ATAN2", "nn", "n")(lambda x, y: (F.atan2(y, x), code((x == 0) & (y == 0), "#DIV/0!")))
simple("PI", lambda: F.lit(3.141592653589793), "")
simple("ISEVEN", lambda x: F.floor(F.abs(x)) % 2 == 0, "n", "b")
simple("ISODD", lambda x: F.floor(F.abs(x)) % 2 == 1, "n", "b")
simple("LEN LENB", lambda s: F.char_length(s).cast("double"), "t")
simple("UPPER", F.upper, "t", "t")
simple("LOWER", F.lower, "t", "t")
simple("TRIM", lambda s: F.regexp_replace(F.trim(s), " +", " "), "t", "t")
simple("CLEAN", lambda s: F.regexp_replace(s, "[\\x00-\\x1F]", ""), "t", "t")
simple("EXACT", lambda a, b: a == b, "tt", "b")
simple("CONCAT CONCATENATE", lambda *s: F.concat(*s), "t*", "t")
native("LEFT LEFTB", "t|n", "t")(lambda s, n=None: (F.substring(s, F.lit(1), or_lit(n, 1.0).cast("int")), code(or_lit(n, 1.0) < 0, "#VALUE!")))
native("RIGHT RIGHTB", "t|n", "t")(lambda s, n=None: (F.right(s, or_lit(n, 1.0).cast("int")), code(or_lit(n, 1.0) < 0, "#VALUE!")))
native("MID MIDB", "tnn", "t")(lambda s, a, n: (F.when((a >= 1) & (n >= 0), F.substring(s, F.greatest(a, F.lit(1.0)).cast("int"), F.greatest(n, F.lit(0.0)).cast("int"))), code((a < 1) | (n < 0), "#VALUE!")))
native("REPT", "tn", "t")(lambda s, n: (F.repeat(s, F.greatest(n, F.lit(0.0)).cast("int")), code((n < 0) | (F.char_length(s) * n > 32767), "#VALUE!")))
native("SUBSTITUTE", "ttt", "t")(lambda s, a, b: F.when(a == "", s).otherwise(F.replace(s, a, b)))
native("REPLACE REPLACEB", "tnnt", "t")(lambda s, a, n, b: (F.concat(F.substring(s, F.lit(1), (a - 1).cast("int")), b, F.substring(s, (a + n).cast("int"), F.char_length(s))), code((a < 1) | (n < 0), "#VALUE!")))
simple("ENCODEURL", lambda s: F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), "t", "t")
native("UNICODE", "t", "n")(lambda s: (F.ascii(s).cast("double"), code(s == "", "#VALUE!")))
simple("NOT", lambda b: ~b, "b", "b")
simple("TRUE", lambda: F.lit(True), "", "b")
simple("FALSE", lambda: F.lit(False), "", "b")
native("REGEXTEST", "tt", "b")(lambda s, p: F.rlike(s, p))
native("REGEXREPLACE", "ttt", "t")(lambda s, p, r: F.regexp_replace(s, p, r))
native("REGEXEXTRACT", "tt", "t")(lambda s, p: (F.regexp_substr(s, p), code(~F.rlike(s, p), "#N/A")))
simple("BITAND", lambda a, b: a.cast("bigint").bitwiseAND(b.cast("bigint")).cast("double"), "nn")
simple("BITOR", lambda a, b: a.cast("bigint").bitwiseOR(b.cast("bigint")).cast("double"), "nn")
simple("BITXOR", lambda a, b: a.cast("bigint").bitwiseXOR(b.cast("bigint")).cast("double"), "nn")

#: Serial 1 is 1900-01-01, and 60 a day that never was; from 61 on serials count from 1899-12-30.
day_of = lambda x: F.date_add(F.lit("1899-12-30").cast("date"), F.floor(x).cast("int") + F.when(x < 60, F.lit(1)).otherwise(F.lit(0)))


def serial_of(d: Column) -> Column:
    n = F.datediff(d, F.lit("1899-12-30").cast("date"))
    return F.when(n < 61, n - 1).otherwise(n).cast("double")


def dated(f):
    return lambda x, *more: (f(day_of(x), *more), code((x < 0) | (x >= 2958466), "#NUM!"))


native("YEAR", "n", "n")(dated(lambda d: F.year(d).cast("double")))
native("MONTH", "n", "n")(dated(lambda d: F.month(d).cast("double")))
native("DAY", "n", "n")(dated(lambda d: F.dayofmonth(d).cast("double")))
native("ISOWEEKNUM", "n", "n")(dated(lambda d: F.weekofyear(d).cast("double")))
native("EDATE", "nn", "n")(dated(lambda d, k: serial_of(F.add_months(d, k.cast("int")))))
native("EOMONTH", "nn", "n")(dated(lambda d, k: serial_of(F.last_day(F.add_months(d, k.cast("int"))))))
simple("DAYS", lambda b, a: F.floor(b) - F.floor(a), "nn")
simple("HOUR", lambda x: F.floor(F.floor(F.pmod(x, F.lit(1.0)) * 86400 + 0.5) % 86400 / 3600), "n")
simple("MINUTE", lambda x: F.floor(F.floor(F.pmod(x, F.lit(1.0)) * 86400 + 0.5) / 60) % 60, "n")
simple("SECOND", lambda x: F.floor(F.pmod(x, F.lit(1.0)) * 86400 + 0.5) % 60, "n")
simple("TODAY", lambda: serial_of(F.current_date()), "")


def found(needle: Column, s: Column, start: Column) -> tuple[Column, Column]:
    at = F.position(needle, s, F.greatest(start, F.lit(1.0)).cast("int"))
    return at.cast("double"), code((at == 0) | (start < 1), "#VALUE!")


native("FIND FINDB", "tt|n", "n")(lambda a, s, k=None: found(a, s, or_lit(k, 1.0)))
native("SEARCH SEARCHB", "tt|n", "n")(lambda a, s, k=None: found(F.upper(a), F.upper(s), or_lit(k, 1.0)))


def power(x: Column, y: Column) -> tuple[Column, Column]:
    out = F.when((x == 0) & (y <= 0), F.lit(None).cast("double")).otherwise(F.pow(x, y))
    return F.when(F.isnan(out), F.lit(None).cast("double")).otherwise(out), F.coalesce(code((x == 0) & (y == 0), "#NUM!"), code((x == 0) & (y < 0), "#DIV/0!"), code(F.isnan(out) | (F.abs(out) == float("inf")), "#NUM!"), code((x < 0) & (y != F.floor(y)), "#NUM!"))


AGGREGATES = {"SUM", "AVERAGE", "COUNT", "COUNTA", "MAX", "MIN", "PRODUCT", "MEDIAN", "STDEV", "STDEV.S", "STDEVP", "STDEV.P", "VAR", "VAR.S", "VARP", "VAR.P"}
#: Aggregates of several columns of one table, or of a column and literals: what they are of (c: columns, k: literals),
#: and a value from these that is null where the aggregate is an error, with the error.
x_, sum_ = (lambda c: c.cast("double")), F.sum
both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), x_(a)), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), x_(b))
n_ = lambda a: F.count(x_(a)).cast("double")


def sample_skew(a: Column) -> Column:
    n = n_(a)
    return F.when(n > 2, F.skewness(x_(a)) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(a: Column) -> Column:
    n = n_(a)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x_(a)) + 6))


def error_of_fit(y: Column, x: Column) -> Column:
    n = F.regr_count(x_(y), x_(x)).cast("double")
    return F.when(n > 2, F.sqrt((F.regr_syy(x_(y), x_(x)) - F.pow(F.regr_sxy(x_(y), x_(x)), 2) / F.nullif(F.regr_sxx(x_(y), x_(x)), F.lit(0.0))) / (n - 2)))


def product_sum(*cs: Column) -> Column:
    return F.coalesce(F.sum(reduce(lambda a, b: a * b, [F.coalesce(x_(c), F.lit(0.0)) for c in cs])), F.lit(0.0))


WIDER: dict[str, tuple[str, Callable, str]] = {
    "SUMSQ": ("c", lambda a: F.coalesce(F.sum(x_(a) * x_(a)), F.lit(0.0)), "#NUM!"),
    "DEVSQ": ("c", lambda a: F.var_pop(x_(a)) * n_(a), "#NUM!"),
    "GEOMEAN": ("c", lambda a: F.when(F.min(x_(a)) > 0, F.exp(F.avg(F.ln(F.when(x_(a) > 0, x_(a)))))), "#NUM!"),
    "HARMEAN": ("c", lambda a: F.when(F.min(x_(a)) > 0, n_(a) / F.sum(1 / F.when(x_(a) > 0, x_(a)))), "#NUM!"),
    "SKEW": ("c", sample_skew, "#DIV/0!"), "SKEW.P": ("c", lambda a: F.skewness(x_(a)), "#DIV/0!"), "KURT": ("c", sample_kurtosis, "#DIV/0!"),
    "COUNTBLANK": ("c", lambda a: F.count_if(a.isNull()), "#VALUE!"), "ROWS": ("c", lambda a: F.count(F.lit(1)), "#VALUE!"),
    "CORREL": ("cc", lambda a, b: F.corr(both[0](a, b), both[1](a, b)), "#DIV/0!"), "PEARSON": ("cc", lambda a, b: F.corr(both[0](a, b), both[1](a, b)), "#DIV/0!"),
    "RSQ": ("cc", lambda a, b: F.pow(F.corr(both[0](a, b), both[1](a, b)), 2), "#DIV/0!"),
    "COVAR": ("cc", lambda a, b: F.covar_pop(x_(a), x_(b)), "#DIV/0!"), "COVARIANCE.P": ("cc", lambda a, b: F.covar_pop(x_(a), x_(b)), "#DIV/0!"), "COVARIANCE.S": ("cc", lambda a, b: F.covar_samp(x_(a), x_(b)), "#DIV/0!"),
    "SLOPE": ("cc", lambda y, x: F.regr_slope(x_(y), x_(x)), "#DIV/0!"), "INTERCEPT": ("cc", lambda y, x: F.regr_intercept(x_(y), x_(x)), "#DIV/0!"), "STEYX": ("cc", error_of_fit, "#DIV/0!"),
    "FORECAST": ("kcc", lambda k, y, x: F.regr_intercept(x_(y), x_(x)) + k * F.regr_slope(x_(y), x_(x)), "#DIV/0!"), "FORECAST.LINEAR": ("kcc", lambda k, y, x: F.regr_intercept(x_(y), x_(x)) + k * F.regr_slope(x_(y), x_(x)), "#DIV/0!"),
    "SUMPRODUCT": ("c*", product_sum, "#VALUE!"), "SUMXMY2": ("cc", lambda a, b: F.sum(F.pow(x_(a) - x_(b), 2)), "#DIV/0!"), "SUMX2PY2": ("cc", lambda a, b: F.sum(x_(a) * x_(a) + x_(b) * x_(b)), "#DIV/0!"), "SUMX2MY2": ("cc", lambda a, b: F.sum(x_(a) * x_(a) - x_(b) * x_(b)), "#DIV/0!"),
    "PERCENTOF": ("cc", lambda a, b: F.try_divide(F.sum(x_(a)), F.sum(x_(b))), "#DIV/0!"),
}
#: What share of the way a whole column's percentile lies, by the function's second argument; null where that is an error.
SHARES = {name: f for names, f in (("PERCENTILE PERCENTILE.INC", lambda k: k if 0 <= k <= 1 else None), ("QUARTILE QUARTILE.INC", lambda k: int(k) / 4 if 0 <= k < 5 else None)) for name in names.split()}
WIDER |= {name: ("ck", None, "#NUM!") for name in SHARES}
ORDERED = {"LARGE": True, "SMALL": False}
CONDITIONAL = {"SUMIF": "SUM", "SUMIFS": "SUM", "AVERAGEIF": "AVERAGE", "AVERAGEIFS": "AVERAGE", "COUNTIF": "COUNT", "COUNTIFS": "COUNT", "MAXIFS": "MAX", "MINIFS": "MIN"}


class Compiler:
    """Compiles formulas over `df`; tables are the frames that other tables' names stand for."""

    def __init__(self, df: DataFrame | None, name: str | None = None, tables: dict[str, DataFrame] | None = None, names: dict[str, str] | None = None, custom: dict[str, Callable] | None = None):
        self.df, self.name, self.custom = df, (name or "").lower(), custom or {}
        self.tables = {k.lower(): v for k, v in (tables or {}).items()}
        if name and df is not None:
            self.tables.setdefault(self.name, df)
        self.names = {k.lower(): v for k, v in (names or {}).items()}
        self.totals: list[tuple[str, DataFrame, Column | tuple[str, float]]] = []
        self.columns = {c.lower(): c for c in df.columns} if df is not None else {}

    def column(self, name: str) -> Val:
        c = self.columns.get(name.lower())
        if c is None:
            raise NotColumnar(f"no column {name}")
        t = self.df.schema[c].dataType
        if isinstance(t, T.BooleanType):
            return Val("b", F.col(c))
        if isinstance(t, T.StringType):
            return Val("t", F.col(c))
        if isinstance(t, T.ArrayType):
            return Val("a", F.transform(c, lambda x: x.cast("double")) if not isinstance(t.elementType, (T.StringType, T.BooleanType)) else F.col(c))
        if isinstance(t, T.DateType):
            return Val("n", serial_of(F.col(c)))
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            day = F.to_date(c)
            return Val("n", serial_of(day) + (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)) / 86400)
        return Val("n", F.col(c).cast("double"))

    def compile(self, tree, scope: dict | None = None) -> Val:
        scope = scope or {}
        if isinstance(tree, Lit):
            return literal(tree.value)
        if isinstance(tree, Structured):
            if tree.table is None or (tree.this_row and tree.table.lower() == self.name):
                return self.column(tree.first)
            raise NotColumnar("a whole column has no value per row")
        if isinstance(tree, Name):
            low = tree.name.lower()
            if low in scope:
                return scope[low]
            if low in self.columns:
                return self.column(tree.name)
            if low in self.names:
                return self.compile(parse(self.names[low]), {})
            return Val("n", F.lit(None).cast("double"), F.lit("#NAME?"))
        if isinstance(tree, Unary):
            v = self.compile(tree.arg, scope)
            if tree.op in "+@":
                return v
            v = as_number(v)
            return Val("n", -v.col if tree.op == "-" else v.col / 100, v.err)
        if isinstance(tree, Binary):
            return self.binary(tree, scope)
        if isinstance(tree, Call):
            return self.call(tree, scope)
        if isinstance(tree, Apply):
            return self.applied(tree.fn, [self.compile(a, scope) for a in tree.args], scope)
        raise NotColumnar(f"{type(tree).__name__} has no value per row")

    def applied(self, fn, given: list[Val], scope) -> Val:
        """A lambda's body with its parameters bound; it is inlined."""
        if isinstance(fn, Name) and fn.name.lower() in self.names:
            fn = parse(self.names[fn.name.lower()])
        if isinstance(fn, Name):
            return self.call_values(fn.name.upper(), given)
        if not isinstance(fn, Call) or fn.name != "LAMBDA" or len(fn.args) != len(given) + 1:
            raise NotColumnar("a lambda with as many parameters is wanted")
        return self.compile(fn.args[-1], {**scope, **{p.name.lower(): v for p, v in zip(fn.args[:-1], given, strict=True)}})

    def call_values(self, name: str, given: list[Val]) -> Val:
        if name in VALUES:
            return VALUES[name](given)
        if NATIVE.get(name):
            return NATIVE[name](given)
        if name in TABLE:
            return arrow_call(name, given)
        return Val("n", F.lit(None).cast("double"), F.lit("#NAME?"))

    def binary(self, tree: Binary, scope) -> Val:
        a, b = self.compile(tree.left, scope), self.compile(tree.right, scope)
        op = tree.op
        if op == "&":
            a, b = as_text(a), as_text(b)
            return Val("t", F.concat(a.col, b.col), either(a.err, b.err))
        if op in ("+", "-", "*", "/", "^"):
            a, b = as_number(a), as_number(b)
            errors = either(a.err, b.err)
            if op == "/":
                return Val("n", F.try_divide(a.col, b.col), either(errors, code(b.col == 0, "#DIV/0!")))
            if op == "^":
                v, e = power(a.col, b.col)
                return Val("n", v, either(errors, e))
            return Val("n", a.col + b.col if op == "+" else a.col - b.col if op == "-" else a.col * b.col, errors)
        if op in ("=", "<>", "<", ">", "<=", ">="):
            return compared(op, a, b)
        raise NotColumnar(f"operator {op!r} has no value per row")

    def call(self, tree: Call, scope) -> Val:
        name, args = tree.name, tree.args
        if name in CONDITIONAL and len(args) >= 2:
            return self.conditional(tree)
        if name in AGGREGATES and all(isinstance(a, Structured) and not a.this_row for a in args):
            return self.total(tree)
        if (name in WIDER or name in ORDERED) and any(isinstance(a, Structured) and not a.this_row and a.table for a in args):
            return self.wider(tree)
        if name in SPECIAL:
            return SPECIAL[name](self, args, scope)
        given = [Val("n", F.lit(None).cast("double")) if a == MISSING_ARG else self.compile(a, scope) for a in args]
        if name in TABLE:
            return self.call_values(name, given)
        if name.lower() in self.custom:
            return arrow_call(name, given, self.custom[name.lower()])
        if name.lower() in self.names:
            return self.applied(Name(name), given, scope)
        return Val("n", F.lit(None).cast("double"), F.lit("#NAME?"))

    # Whole columns.
    def frame(self, s: Structured) -> tuple[DataFrame, str]:
        df = self.df if s.table is None else self.tables.get(s.table.lower())
        if df is None:
            raise NotColumnar(f"no table {s.table}")
        return df, next(c for c in df.columns if c.lower() == s.first.lower())

    def total(self, tree: Call) -> Val:
        if len(tree.args) != 1:
            raise NotColumnar("one column an aggregate")
        df, c = self.frame(tree.args[0])
        if tree.name == "MEDIAN":
            return self.one(df, (c, 0.5), "#NUM!")
        return self.one(df, measure(tree.name, F.col(c)), "#DIV/0!")

    def one(self, df: DataFrame, value: Column | tuple[str, float], error: str) -> Val:
        """A total of df: an aggregate, or a column's percentile."""
        at = f"_total{len(self.totals)}"
        self.totals.append((at, df, value if isinstance(value, tuple) else value.cast("double").alias(at)))
        return Val("n", F.col(at), code(F.col(at).isNull() | F.isnan(at), error))

    def wider(self, tree: Call) -> Val:
        """Aggregates of several columns, or with literals. The k-th largest or smallest is a top-k."""
        spec, build, error = WIDER.get(tree.name, ("ck", None, "#NUM!"))
        kinds = "c" * len(tree.args) if spec == "c*" else spec
        if len(kinds) != len(tree.args):
            raise NotColumnar(f"{tree.name} of {len(tree.args)} arguments")
        df, given = None, []
        for k, a in zip(kinds, tree.args, strict=True):
            if k == "k":
                sign = -1 if isinstance(a, Unary) and a.op == "-" else 1
                a = a.arg if sign < 0 else a
                if not isinstance(a, Lit) or isinstance(a.value, (str, bool)) or a.value is None:
                    raise NotColumnar(f"{tree.name} takes a literal number")
                given.append(sign * float(a.value))
                continue
            if not isinstance(a, Structured) or a.first != a.last:
                raise NotColumnar(f"{tree.name} takes whole columns")
            own, c = self.frame(a)
            if df is not None and own is not df:
                raise NotColumnar("columns of one table")
            df = own
            given.append(F.col(c))
        if build is not None:
            return self.one(df, build(*given), error)
        if tree.name in SHARES:
            share = SHARES[tree.name](given[1])
            return self.one(df, F.max(F.lit(None)) if share is None else (c, share), error)
        k = int(given[1])
        if not 1 <= k <= 100_000:
            raise NotColumnar("a k of at most 100,000: see operators.criteria.kth")
        value = x_(given[0]).alias("v")
        top = df.select(value).filter("v IS NOT NULL").orderBy(F.col("v").desc() if ORDERED[tree.name] else F.col("v")).limit(k)
        return self.one(top, F.when(F.count("v") == k, (F.min if ORDERED[tree.name] else F.max)("v")), error)

    def one_rows(self) -> list[DataFrame]:
        """The totals as frames of one row, one frame and one scan for all totals of a table, one more for its percentiles."""
        held: dict[int, tuple[DataFrame, list[Column], dict]] = {}
        for at, df, value in self.totals:
            _, values, ranked = held.setdefault(id(df), (df, [], {}))
            if isinstance(value, tuple):
                ranked[at] = value
            else:
                values.append(value)
        out = []
        for df, values, ranked in held.values():
            columns = {c: F.col(c) for c, _ in ranked.values()}
            out += [df.agg(*values)] if values else []
            out += [percentiles(df, [], {at: (columns[c], k) for at, (c, k) in ranked.items()})] if ranked else []
        return out

    def conditional(self, tree: Call) -> Val:
        single = not tree.name.endswith("S")
        if tree.name.startswith("COUNT"):
            pairs, value = tree.args, None
        elif single:
            pairs, value = tree.args[:2], tree.args[2] if len(tree.args) > 2 else tree.args[0]
        else:
            pairs, value = tree.args[1:], tree.args[0]
        df, _ = self.frame(pairs[0])
        keep = F.lit(True)
        for r, c in zip(pairs[::2], pairs[1::2], strict=True):
            other, name = self.frame(r)
            if other is not df:
                raise NotColumnar("#VALUE!")
            if not isinstance(c, Lit):
                raise NotColumnar("a criterion per row is a join: see operators.joins.conditional_join")
            keep &= criterion(df, name, c.value)
        x = F.when(keep, F.col(self.frame(value)[1])) if value is not None else F.when(keep, F.lit(1.0))
        return self.one(df, measure(CONDITIONAL[tree.name], x), "#DIV/0!")

    # Results.
    def with_column(self, name: str, formula: str, errors: bool = False) -> DataFrame:
        """df with the formula's value per row as a column (null where it is an error), and its error's code beside it."""
        v = self.compile(parse(formula))
        df = self.joined(self.df)
        out = df.withColumn(name, F.when(v.err.isNull(), v.col) if v.err is not None else v.col)
        if errors:
            out = out.withColumn(f"{name}_err", v.err if v.err is not None else F.lit(None).cast("string"))
        return out.drop(*[at for at, _, _ in self.totals])

    def joined(self, df: DataFrame) -> DataFrame:
        for frame in self.one_rows():
            df = df.crossJoin(F.broadcast(frame))  # one row each
        return df

    def scalar(self, formula) -> DataFrame:
        """A formula (or its tree) of whole columns only, as a frame of one row (value, error)."""
        v = self.compile(parse(formula) if isinstance(formula, str) else formula)
        frames = self.one_rows()
        if not frames:
            raise NotColumnar("no column is read")
        df = frames[0]
        for f in frames[1:]:
            df = df.crossJoin(F.broadcast(f))  # one row each
        return df.select((F.when(v.err.isNull(), v.col) if v.err is not None else v.col).alias("value"), (v.err if v.err is not None else F.lit(None).cast("string")).alias("error"))


def literal(v) -> Val:
    if isinstance(v, bool):
        return Val("b", F.lit(v))
    if isinstance(v, Err):
        return Val("n", F.lit(None).cast("double"), F.lit(v.code))
    if isinstance(v, str):
        return Val("t", F.lit(v))
    return Val("n", F.lit(None).cast("double") if v is None or v is ... else F.lit(float(v)))


RANKS = {"n": 0, "t": 1, "b": 2}


def compared(op: str, a: Val, b: Val) -> Val:
    errors = either(a.err, b.err)
    blank = {"n": F.lit(0.0), "t": F.lit(""), "b": F.lit(False)}
    if a.kind != b.kind:  # different types never are equal, but a blank adapts
        x, y = F.lit(RANKS[a.kind]), F.lit(RANKS[b.kind])
        plain = {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        other = compared(op, Val(b.kind, blank[b.kind]), b).col
        back = compared(op, a, Val(a.kind, blank[a.kind])).col
        return Val("b", F.when(a.col.isNull(), other).when(b.col.isNull(), back).otherwise(plain), errors)
    x, y = F.coalesce(a.col, blank[a.kind]), F.coalesce(b.col, blank[b.kind])
    if a.kind == "t":
        x, y = F.upper(x), F.upper(y)
    if a.kind == "n" and op in ("=", "<>"):
        near = F.abs(x - y) <= F.lit(1e-13) * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
        return Val("b", near if op == "=" else ~near, errors)
    return Val("b", {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], errors)


def merged(kinds: list[Val]) -> tuple[str, Callable]:
    """The kind that branches share; text if they differ."""
    found = {v.kind for v in kinds}
    k = found.pop() if len(found) == 1 else "t"
    return k, (lambda v: v.col if v.kind == k else as_text(v).col)


def chosen(tests: list[Val], values: list[Val], otherwise: Val) -> Val:
    kind, pick = merged([*values, otherwise])
    null = F.lit(None).cast("string")
    out, err, first = None, None, []
    for t, v in zip(tests, values, strict=True):
        out = F.when(t.col, pick(v)) if out is None else out.when(t.col, pick(v))
        own = v.err if v.err is not None else null
        own = F.coalesce(t.err, own) if t.err is not None else own
        first.append((t, own))
    rest = otherwise.err if otherwise.err is not None else null
    for t, own in reversed(first):
        hit = F.when(t.col, own).otherwise(rest)
        rest = F.coalesce(t.err, hit) if t.err is not None else hit
    err = rest
    known = any(v.err is not None for v in [*tests, *values, otherwise])
    return Val(kind, out.otherwise(pick(otherwise)), err if known else None)


def if_(c: Compiler, args, scope) -> Val:
    v = [c.compile(a, scope) if a != MISSING_ARG else Val("n", F.lit(0.0)) for a in args]
    return chosen([as_bool(v[0])], [v[1]], v[2] if len(v) > 2 else Val("b", F.lit(False)))


def caught(which: str | None):
    def body(c: Compiler, args, scope) -> Val:
        a, b = (c.compile(x, scope) for x in args)
        if a.err is None:
            return a
        hit = F.coalesce(a.err == which, F.lit(False)) if which else a.err.isNotNull()
        kind, pick = merged([a, b])
        rest = F.when(hit, b.err if b.err is not None else F.lit(None).cast("string")).otherwise(a.err)
        return Val(kind, F.when(hit, pick(b)).otherwise(pick(a)), rest)

    return body


def ifs(c: Compiler, args, scope) -> Val:
    tests = [as_bool(c.compile(a, scope)) for a in args[::2]]
    values = [c.compile(a, scope) for a in args[1::2]]
    return chosen(tests, values, Val(values[0].kind, F.lit(None).cast(KINDS[values[0].kind]), F.lit("#N/A")))


def switch(c: Compiler, args, scope) -> Val:
    v = c.compile(args[0], scope)
    pairs, rest = args[1:], None
    if len(pairs) % 2:
        pairs, rest = pairs[:-1], c.compile(pairs[-1], scope)
    tests = [compared("=", v, c.compile(a, scope)) for a in pairs[::2]]
    values = [c.compile(a, scope) for a in pairs[1::2]]
    return chosen(tests, values, rest or Val(values[0].kind, F.lit(None).cast(KINDS[values[0].kind]), F.lit("#N/A")))


def let(c: Compiler, args, scope) -> Val:
    scope = dict(scope)
    for n, a in zip(args[:-1:2], args[1::2], strict=True):
        scope[n.name.lower()] = c.compile(a, scope)
    return c.compile(args[-1], scope)


def logical(f):
    def body(c: Compiler, args, scope) -> Val:
        v = [as_bool(c.compile(a, scope)) for a in args]
        out = v[0].col
        for x in v[1:]:
            out = f(out, x.col)
        return Val("b", out, either(*[x.err for x in v]))

    return body


def least(f):
    """An aggregate of a row's values; an array's items count one by one."""

    def values(v: list[Val]) -> Val:
        if len(v) == 1 and v[0].kind == "a":
            return Val("n", f(None, v[0].col), code(F.size(v[0].col) <= 0, "#DIV/0!") if f is average else None)
        v = [as_number(x) for x in v]
        return Val("n", f([x.col for x in v], None) if len(v) > 1 else v[0].col, either(*[x.err for x in v]))

    return values


def total(columns, items):
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) if columns is None else sum(columns[1:], columns[0])


def average(columns, items):
    return F.try_divide(total(None, items), F.size(F.filter(items, lambda x: x.isNotNull()))) if columns is None else total(columns, None) / len(columns)


def product(columns, items):
    return F.aggregate(items, F.lit(1.0), lambda a, x: a * F.coalesce(x, F.lit(1.0))) if columns is None else reduce(lambda a, b: a * b, columns)


VALUES = {
    "SUM": least(total), "AVERAGE": least(average), "PRODUCT": least(product), "MAX": least(lambda c, i: F.coalesce(F.array_max(i), F.lit(0.0)) if c is None else F.greatest(*c)), "MIN": least(lambda c, i: F.coalesce(F.array_min(i), F.lit(0.0)) if c is None else F.least(*c)),
    "COUNT": lambda v: Val("n", F.size(F.filter(v[0].col, lambda x: x.isNotNull())).cast("double") if v[0].kind == "a" else F.lit(float(len(v)))),
}


def lambda_of(c: Compiler, tree, scope, n: int) -> Callable:
    return lambda *cols: c.applied(tree, [Val("n", x) for x in cols[:n]], scope).col


def mapped(c: Compiler, args, scope) -> Val:
    """MAP over an array column: a native transform."""
    return Val("a", F.transform(array_of(c, args[0], scope), lambda x: lambda_of(c, args[1], scope, 1)(x)))


def reduced(c: Compiler, args, scope) -> Val:
    """REDUCE over an array column: a native fold."""
    start = as_number(c.compile(args[0], scope)).col if args[0] != MISSING_ARG else F.lit(0.0)
    return Val("n", F.aggregate(array_of(c, args[1], scope), start, lambda a, x: lambda_of(c, args[2], scope, 2)(a, x)))


def array_of(c: Compiler, tree, scope) -> Column:
    v = c.compile(tree, scope)
    if v.kind != "a":
        raise NotColumnar("an array column is wanted")
    return v.col


def has_item(c: Compiler, args, scope) -> Val:
    return Val("b", F.coalesce(F.array_contains(array_of(c, args[0], scope), as_number(c.compile(args[1], scope)).col), F.lit(False)))


def tested(f):
    """IS functions look at the error and the kind."""

    def body(c: Compiler, args, scope) -> Val:
        v = c.compile(args[0], scope)
        bad = v.err.isNotNull() if v.err is not None else F.lit(False)
        return Val("b", f(v, bad))

    return body


SPECIAL: dict[str, Callable] = {
    "IF": if_, "IFS": ifs, "SWITCH": switch, "LET": let, "IFERROR": caught(None), "IFNA": caught("#N/A"),
    "AND": logical(lambda a, b: a & b), "OR": logical(lambda a, b: a | b), "XOR": logical(lambda a, b: a != b),
    "MAP": mapped, "REDUCE": reduced, "HAS": has_item,
    "ISERROR": tested(lambda v, bad: bad), "ISERR": tested(lambda v, bad: bad & (v.err != "#N/A") if v.err is not None else bad), "ISNA": tested(lambda v, bad: F.coalesce(v.err == "#N/A", F.lit(False)) if v.err is not None else bad),
    "ISBLANK": tested(lambda v, bad: ~bad & v.col.isNull()), "ISNUMBER": tested(lambda v, bad: ~bad & v.col.isNotNull() & F.lit(v.kind == "n")), "ISTEXT": tested(lambda v, bad: ~bad & v.col.isNotNull() & F.lit(v.kind == "t")),
    "ISNONTEXT": tested(lambda v, bad: bad | v.col.isNull() | F.lit(v.kind != "t")), "ISLOGICAL": tested(lambda v, bad: ~bad & v.col.isNotNull() & F.lit(v.kind == "b")),
}

#: Functions whose values are text or booleans; others give numbers.
TEXTS = set("TEXT PROPER CHAR UNICHAR TEXTJOIN TEXTBEFORE TEXTAFTER FIXED DOLLAR ASC DBCS JIS THAIDIGIT BAHTTEXT PHONETIC ROMAN BASE DEC2BIN DEC2OCT DEC2HEX BIN2OCT BIN2HEX OCT2BIN OCT2HEX HEX2BIN HEX2OCT COMPLEX IMCONJUGATE IMSUM IMSUB IMPRODUCT IMDIV IMEXP IMLN IMLOG10 IMLOG2 IMPOWER IMSQRT IMSIN IMCOS IMSINH IMCOSH IMTAN IMCOT IMSEC IMCSC IMSECH IMCSCH T ADDRESS REGEXEXTRACT REGEXREPLACE PARSEJSON SUBSTITUTE VALUETOTEXT".split())
BOOLEANS = {"ISTHAIDIGIT", "REGEXTEST"}


def arrow_call(name: str, args: list[Val], custom: Callable | None = None) -> Val:
    """A call in Arrow batches: the library's own function per row, errors as codes."""
    kind = "t" if name in TEXTS else "b" if name in BOOLEANS else "n"
    f = Function(name, "scalar", custom, "a" * len(args)) if custom else TABLE[name]
    result = T.StructType([T.StructField("v", T._parse_datatype_string(KINDS[kind])), T.StructField("e", T.StringType())])

    pure = custom is None and f.kind == "scalar" and name not in VOLATILE

    def one(row):
        given = [None if v is None or v != v else v for v in row]
        bad = next((g for g, k in zip(given, carried, strict=True) if k == "e" and g), None)
        out = Err(bad) if bad else single_result(f, [g for g, k in zip(given, carried, strict=True) if k != "e"])
        if isinstance(out, Err):
            return None, out.code
        return text(out) if kind == "t" else bool(out) if kind == "b" else float(out or 0), None

    def run(batch):
        import pandas as pd

        values, errors, met = [], [], {}  # rows of a batch that are alike are worked out once
        for row in zip(*[batch[c] for c in batch.columns], strict=True):
            got = None
            if pure and all(isinstance(v, (str, float)) and v != 0 for v in row):  # 0 and -0 are equal, but not alike
                got = met.get(row)
                if got is None:
                    got = met[row] = one(row)
            value, error = got or one(row)
            values.append(value)
            errors.append(error)
        return pd.DataFrame({"v": pd.Series(values, dtype="object"), "e": pd.Series(errors, dtype="object")})

    fields, carried = [], []
    for k, a in enumerate(args):
        fields.append(a.col.alias(f"a{k}"))
        carried.append("v")
        if a.err is not None:
            fields.append(a.err.alias(f"e{k}"))
            carried.append("e")
    from pyspark.sql.functions import pandas_udf

    import pandas as pd

    run.__annotations__ = {"batch": pd.DataFrame, "return": pd.DataFrame}
    out = pandas_udf(run, result)(F.struct(*(fields or [F.lit(0).alias("a0")])))
    return Val(kind, out["v"], out["e"])


def single_result(f, args: list):
    from .evaluator import Evaluator

    if f.kind == "scalar":
        out = lifted(f, args)
    elif f.kind == "range":
        out = Evaluator().call(f, args, {})
    else:
        out = f.body(Evaluator(), [Lit(a) for a in args], {})
    if isinstance(out, Arr):
        out = out.rows[0][0] if out.height == out.width == 1 else ", ".join(text(v) for v in out.flat() if not isinstance(v, Err))
    return out


def with_column(df: DataFrame, name: str, formula: str, table: str | None = None, tables: dict | None = None, errors: bool = False) -> DataFrame:
    return Compiler(df, table, tables).with_column(name, formula, errors)


assert Array

from . import native_columns  # noqa: E402, F401  it registers its functions here
