"""Further functions as column expressions: rounding to multiples, number bases, dates, texts, annuities, densities.

Each gives what the library's own function gives for a row (tests/test_native_columns.py holds them together), without
leaving the JVM. Calls with more arguments than an expression covers go on to the library's function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compiler import NATIVE, Val, arrow_call, code, day_of, native, or_lit, serial_of, simple


def up_to(n: int, names: str) -> None:
    """Calls of these with more than n arguments are the library function's."""
    for name in names.split():
        inner = NATIVE[name]

        def call(args: list[Val], inner=inner, name=name) -> Val:
            return inner(args) if len(args) <= n else arrow_call(name, args)

        NATIVE[name] = call


def positive(*cs: Column) -> Column:
    bad = cs[0] <= 0
    for c in cs[1:]:
        bad = bad | (c <= 0)
    return code(bad, "#NUM!")



safe = lambda c: F.nullif(c, F.lit(0.0))

# Trigonometry.
native("COT", "n", "n")(lambda x: (1.0 / safe(F.tan(x)), code(x == 0, "#DIV/0!")))
simple("SEC", lambda x: 1.0 / F.cos(x))
native("CSC", "n", "n")(lambda x: (1.0 / safe(F.sin(x)), code(x == 0, "#DIV/0!")))
native("COTH", "n", "n")(lambda x: (1.0 / safe(F.tanh(x)), code(x == 0, "#DIV/0!")))
simple("SECH", lambda x: 1.0 / F.cosh(x))
native("CSCH", "n", "n")(lambda x: (1.0 / safe(F.sinh(x)), code(x == 0, "#DIV/0!")))
simple("ACOT", lambda x: F.lit(1.5707963267948966) - F.atan(x))
native("ACOTH", "n", "n")(lambda x: (F.when(F.abs(x) > 1, 0.5 * F.ln((x + 1) / (x - 1))), code(F.abs(x) <= 1, "#NUM!")))
native("ACOSH", "n", "n")(lambda x: (F.when(x >= 1, F.acosh(x)), code(x < 1, "#NUM!")))
native("ATANH FISHER", "n", "n")(lambda x: (F.when(F.abs(x) < 1, F.atanh(x)), code(F.abs(x) >= 1, "#NUM!")))
simple("FISHERINV", F.tanh)
native("SQRTPI", "n", "n")(lambda x: (F.when(x >= 0, F.sqrt(x * 3.141592653589793)), code(x < 0, "#NUM!")))


@native("LOG", "n|n", "n")
def log(x, base=None):
    base = or_lit(base, 10.0)
    fine = (x > 0) & (base > 0)
    value = F.when(base == 10, F.log10(x)).otherwise(F.ln(x) / safe(F.ln(base)))
    return F.when(fine & (base != 1), value), F.coalesce(code(~fine, "#NUM!"), code(base == 1, "#DIV/0!"))


# Multiples. Quotients that miss a whole number by binary fractions only count as it.
def near(q: Column) -> Column:
    whole = F.rint(q)
    return F.when((F.abs(q - whole) < 1e-9 * F.greatest(F.lit(1.0), F.abs(q))) & (F.abs(q) < 1e15), whole).otherwise(q)


def multiple(x: Column, step: Column, f: Callable) -> Column:
    return f(near(x / safe(step))).cast("double") * step


away = lambda q: F.signum(q) * F.floor(F.abs(q) + 0.5)


@native("CEILING CEILING.ODS", "n|n", "n")
def ceiling(x, step=None):
    step = or_lit(step, 1.0)
    return F.when((step == 0) | (x == 0), 0.0).otherwise(multiple(x, step, F.ceil)), code((x > 0) & (step < 0), "#NUM!")


@native("FLOOR FLOOR.ODS", "n|n", "n")
def floor(x, step=None):
    step = or_lit(step, 1.0)
    return F.when(x == 0, 0.0).otherwise(multiple(x, step, F.floor)), F.coalesce(code((x != 0) & (step == 0), "#DIV/0!"), code((x > 0) & (step < 0), "#NUM!"))


def with_mode(names: str, f: Callable) -> None:
    def body(x, step=None, mode=None):
        step, mode = F.abs(or_lit(step, 1.0)), or_lit(mode, 0.0)
        other = -multiple(-x, step, f)
        return F.when(step == 0, 0.0).when((x < 0) & (mode != 0), other).otherwise(multiple(x, step, f))

    native(names, "n|nn", "n")(body)


with_mode("CEILING.MATH CEILING.XCL", F.ceil)
with_mode("FLOOR.MATH FLOOR.XCL", F.floor)
for _names, _f in (("CEILING.PRECISE ISO.CEILING ECMA.CEILING", F.ceil), ("FLOOR.PRECISE", F.floor)):
    native(_names, "n|n", "n")(lambda x, step=None, f=_f: F.when(or_lit(step, 1.0) == 0, 0.0).otherwise(multiple(x, F.abs(or_lit(step, 1.0)), f)))
native("MROUND", "nn", "n")(lambda x, step: (F.when((step == 0) | (x == 0), 0.0).otherwise(multiple(x, step, away)), code(x * step < 0, "#NUM!")))
sign = lambda x: F.when(x < 0, -1.0).otherwise(1.0)
simple("EVEN", lambda x: sign(x) * F.ceil(F.abs(x) / 2 - 1e-12) * 2)
simple("ODD", lambda x: F.when(x == 0, 1.0).otherwise(sign(x) * (F.ceil((F.abs(x) - 1) / 2 - 1e-12) * 2 + 1)))
native("DELTA", "n|n", "n")(lambda a, b=None: F.when(a == or_lit(b, 0.0), 1.0).otherwise(0.0))
native("GESTEP", "n|n", "n")(lambda a, b=None: F.when(a >= or_lit(b, 0.0), 1.0).otherwise(0.0))

# Number bases: ten digits at most, negative numbers in two's complement of so many bits.
BASES = {"BIN": (2, 10, "[01]"), "OCT": (8, 30, "[0-7]"), "HEX": (16, 40, "[0-9A-Fa-f]")}


def read_digits(s: Column, kind: str) -> tuple[Column, Column]:
    radix, bits, digit = BASES[kind]
    s = F.trim(s)
    n = F.conv(F.when(s == "", "0").otherwise(s), radix, 10).cast("bigint")
    return F.when(n >= 1 << (bits - 1), n - (1 << bits)).otherwise(n), code(~s.rlike(f"^{digit}{{0,10}}$"), "#NUM!")


def written_digits(n: Column, places: Column | None, kind: str) -> tuple[Column, Column]:
    radix, bits, _ = BASES[kind]
    bad = (n < -(1 << (bits - 1))) | (n >= 1 << (bits - 1))
    out = F.conv(F.when(n < 0, n + (1 << bits)).otherwise(n).cast("string"), 10, radix)
    if places is None:
        return out, code(bad, "#NUM!")
    few = (n >= 0) & ((F.length(out) > places) | (places > 10))
    return F.when((n < 0) | few, out).otherwise(F.lpad(out, F.greatest(places, F.length(out)).cast("int"), F.lit("0"))), code(bad | few, "#NUM!")


def base_functions() -> None:
    for kind in BASES:
        def to_number(s, kind=kind):
            n, bad = read_digits(s, kind)
            return n.cast("double"), bad

        native(f"{kind}2DEC", "t", "n")(to_number)
        native(f"DEC2{kind}", "n|n", "t")(lambda x, places=None, kind=kind: written_digits(x.cast("bigint"), places, kind))
        for other in BASES:
            if other != kind:
                def between(s, places=None, kind=kind, other=other):
                    n, bad = read_digits(s, kind)
                    out, wide = written_digits(n, places, other)
                    return out, F.coalesce(bad, wide)

                native(f"{kind}2{other}", "t|n", "t")(between)


base_functions()


def shifted(x: Column, k: Column) -> tuple[Column, Column]:
    bad = (x < 0) | (x != F.floor(x)) | (x >= float(1 << 48)) | (F.abs(k) > 53)
    k = F.signum(k) * F.floor(F.abs(k))
    out = F.floor(x * F.pow(F.lit(2.0), k)).cast("double")
    return out, code(bad | (out >= float(1 << 48)), "#NUM!")


native("BITLSHIFT", "nn", "n")(shifted)
native("BITRSHIFT", "nn", "n")(lambda x, k: shifted(x, -k))

# Dates; serial 1 counts as a Sunday.
LAST = 2958466


@native("DATE", "nnn", "n")
def date(y, m, d):
    y, m, d = F.floor(y), F.floor(m), F.floor(d)
    y = F.when((y >= 0) & (y < 1900), y + 1900).otherwise(y)
    fine = (y >= 1900) & (y <= 19_999) & (F.abs(m) < 100_000) & (F.abs(d) < 10_000_000)
    first = F.add_months(F.make_date(F.when(fine, y).otherwise(1900).cast("int"), F.lit(1), F.lit(1)), F.when(fine, m - 1).otherwise(0).cast("int"))
    out = serial_of(F.date_add(first, F.when(fine, d - 1).otherwise(0).cast("int")))
    return out, code(~fine | (serial_of(first) >= LAST) | (out < 0) | (out >= LAST), "#NUM!")


@native("TIME", "nnn", "n")
def time(h, m, s):
    whole = lambda x: F.signum(x) * F.floor(F.abs(x))
    total = whole(h) * 3600 + whole(m) * 60 + whole(s)
    return F.pmod(total, F.lit(86400.0)) / 86400, code(total < 0, "#NUM!")


outside = lambda x: code((x < 0) | (x >= LAST), "#NUM!")
sunday_first = lambda x: F.pmod(F.floor(x) - 1, F.lit(7))


@native("WEEKDAY", "n|n", "n")
def weekday(x, kind=None):
    kind = F.floor(or_lit(kind, 1.0))
    day = sunday_first(x)
    out = F.when(kind.isin(1, 17), day + 1).when(kind.isin(2, 11), F.pmod(day - 1, F.lit(7)) + 1).when(kind == 3, F.pmod(day - 1, F.lit(7))).when(kind.between(12, 16), F.pmod(day - (kind - 10), F.lit(7)) + 1)
    return out.cast("double"), F.coalesce(outside(x), code(out.isNull(), "#NUM!"))


@native("WEEKNUM", "n|n", "n")
def weeknum(x, kind=None):
    kind = F.floor(or_lit(kind, 1.0)).cast("int")
    first = F.when(kind.isin(1, 17), 0).when(kind.isin(2, 11), 1).when(kind.between(12, 16), kind - 10)
    day = day_of(x)
    new_year = serial_of(F.make_date(F.year(day), F.lit(1), F.lit(1)))
    own = F.floor((F.floor(x) - new_year + F.pmod(sunday_first(new_year) - first, F.lit(7))) / 7) + 1
    return F.when(kind == 21, F.weekofyear(day)).otherwise(own).cast("double"), F.coalesce(outside(x), code(first.isNull() & (kind != 21), "#NUM!"))


def workdays_until(s: Column) -> Column:
    """Days from Monday to Friday among the serials 1 to s."""
    return 5 * F.floor(s / 7) + F.greatest(F.pmod(s, F.lit(7)) - 1, F.lit(0))


@native("NETWORKDAYS", "nn", "n")
def networkdays(a, b):
    a, b = F.floor(a), F.floor(b)
    return F.when(b >= a, workdays_until(b) - workdays_until(a - 1)).otherwise(workdays_until(b - 1) - workdays_until(a)).cast("double"), F.coalesce(outside(a), outside(b))


up_to(2, "NETWORKDAYS")

# Texts.
parts = lambda s: F.regexp_extract_all(s, F.lit("\\p{L}+|\\P{L}+"), F.lit(0))
simple("PROPER", lambda s: F.array_join(F.transform(parts(s), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), ""), "t", "t")
native("CHAR", "n", "t")(lambda x: (F.char(F.when((x >= 1) & (x < 256), x).otherwise(32).cast("bigint")), code((x < 1) | (x >= 256), "#VALUE!")))
native("CODE", "t", "n")(lambda s: (F.when(F.ascii(s) < 256, F.ascii(s)).otherwise(63).cast("double"), code(s == "", "#VALUE!")))
native("TEXTBEFORE", "tt", "t")(lambda s, d: (F.when(d == "", "").otherwise(F.substring(s, F.lit(1), F.position(d, s) - 1)), code((d != "") & (F.position(d, s) == 0), "#N/A")))
native("TEXTAFTER", "tt", "t")(lambda s, d: (F.when(d == "", s).otherwise(F.substring(s, F.position(d, s) + F.length(d), F.length(s))), code((d != "") & (F.position(d, s) == 0), "#N/A")))
up_to(2, "TEXTBEFORE TEXTAFTER")


# Money over time.
def growth(rate: Column, n: Column) -> tuple[Column, Column]:
    g = F.pow(1 + rate, n)
    return g, F.when(rate == 0, n).otherwise((g - 1) / safe(rate))


def at_start(rate: Column, due: Column | None) -> Column:
    return 1 + rate * F.when(or_lit(due, 0.0) != 0, 1.0).otherwise(0.0)


@native("FV", "nn|nnn", "n")
def fv(rate, n, pmt=None, pv=None, due=None):
    g, s = growth(rate, n)
    return -(or_lit(pv, 0.0) * g + or_lit(pmt, 0.0) * at_start(rate, due) * s)


@native("PV", "nn|nnn", "n")
def pv(rate, n, pmt=None, later=None, due=None):
    g, s = growth(rate, n)
    return -(or_lit(later, 0.0) + or_lit(pmt, 0.0) * at_start(rate, due) * s) / safe(g)


@native("PMT", "nnn|nn", "n")
def pmt(rate, n, now, later=None, due=None):
    g, s = growth(rate, n)
    return -(now * g + or_lit(later, 0.0)) / safe(at_start(rate, due) * s), code(n == 0, "#NUM!")


@native("NPER", "nnn|nn", "n")
def nper(rate, pay, now, later=None, due=None):
    later = or_lit(later, 0.0)
    k = pay * at_start(rate, due) / safe(rate)
    ratio = (k - later) / safe(now + k)
    value = F.when(rate == 0, -(now + later) / safe(pay)).otherwise(F.ln(F.when(ratio > 0, ratio)) / F.log1p(rate))
    return value, code(value.isNull(), "#NUM!")


native("SLN", "nnn", "n")(lambda c, s, n: ((c - s) / safe(n), code(n == 0, "#DIV/0!")))
native("SYD", "nnnn", "n")(lambda c, s, n, k: ((c - s) * (n - k + 1) * 2 / safe(n * (n + 1)), code(~k.between(F.lit(1.0), n), "#NUM!")))
native("EFFECT", "nn", "n")(lambda r, n: (F.pow(1 + r / safe(F.floor(n)), F.floor(n)) - 1, code((r <= 0) | (n < 1), "#NUM!")))
native("NOMINAL", "nn", "n")(lambda r, n: ((F.pow(1 + r, 1 / safe(F.floor(n))) - 1) * F.floor(n), code((r <= 0) | (n < 1), "#NUM!")))
native("PDURATION", "nnn", "n")(lambda r, v, f: (F.ln(F.when((f > 0) & (v > 0), f / safe(v))) / F.log1p(F.when(r > 0, r)), positive(r, v, f)))

# Densities.
simple("PHI", lambda x: F.exp(-x * x / 2) * 0.3989422804014327)
native("STANDARDIZE", "nnn", "n")(lambda x, mean, dev: ((x - mean) / safe(dev), positive(dev)))
native("EXPON.DIST EXPONDIST", "nnb", "n")(lambda x, rate, c: (F.when(c, -F.expm1(-rate * x)).otherwise(rate * F.exp(-rate * x)), F.coalesce(positive(rate), code(x < 0, "#NUM!"))))


@native("WEIBULL.DIST WEIBULL", "nnnb", "n")
def weibull(x, a, b, c):
    fine = (x >= 0) & (a > 0) & (b > 0)
    q = F.pow(F.when(fine, x / safe(b)), a)
    return F.when(c, -F.expm1(-q)).otherwise(a / F.pow(F.when(fine, b), a) * F.pow(F.when(fine, x), a - 1) * F.exp(-q)), code(~fine, "#NUM!")
