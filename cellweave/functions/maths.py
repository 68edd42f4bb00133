"""Arithmetic, trigonometry, rounding, number bases and bits."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

from .registry import scalar
from .values import DIV0, NUM, VALUE


def plain(names: str, f) -> None:
    scalar(names, "n")(f)


for _name, _f in (("ABS", abs), ("SIN", math.sin), ("COS", math.cos), ("TAN", math.tan), ("ASIN", math.asin), ("ACOS", math.acos), ("ATAN", math.atan), ("SINH", math.sinh), ("COSH", math.cosh), ("TANH", math.tanh), ("ASINH", math.asinh), ("ACOSH", math.acosh), ("ATANH", math.atanh), ("DEGREES", math.degrees), ("RADIANS", math.radians), ("EXP", math.exp), ("LN", math.log), ("LOG10", math.log10), ("SQRT", math.sqrt), ("INT", math.floor)):
    plain(_name, _f)
plain("SIGN", lambda x: (x > 0) - (x < 0))
plain("COT", lambda x: 1 / math.tan(x) if x else DIV0)
plain("SEC", lambda x: 1 / math.cos(x))
plain("CSC", lambda x: 1 / math.sin(x) if x else DIV0)
plain("COTH", lambda x: 1 / math.tanh(x) if x else DIV0)
plain("SECH", lambda x: 1 / math.cosh(x))
plain("CSCH", lambda x: 1 / math.sinh(x) if x else DIV0)
plain("ACOT", lambda x: math.pi / 2 - math.atan(x))
plain("ACOTH", lambda x: math.atanh(1 / x) if abs(x) > 1 else NUM)
plain("SQRTPI", lambda x: math.sqrt(x * math.pi))
plain("FACT", lambda x: math.factorial(int(x)) if 0 <= x <= 170.99 else NUM)
plain("FACTDOUBLE", lambda x: math.prod(range(int(x), 0, -2)) if x >= -1 else NUM)
plain("EVEN", lambda x: math.copysign(math.ceil(abs(x) / 2 - 1e-12) * 2, x) if x else 0.0)
plain("ODD", lambda x: math.copysign(math.ceil((abs(x) - 1) / 2 - 1e-12) * 2 + 1, x) if x else 1.0)
plain("ISEVEN", lambda x: int(abs(x)) % 2 == 0)
plain("ISODD", lambda x: int(abs(x)) % 2 == 1)
scalar("PI", "")(lambda: math.pi)


@scalar("ATAN2", "nn")
def atan2(x, y):
    return math.atan2(y, x) if x or y else DIV0


@scalar("LOG", "n|n")
def log(x, base=10.0):
    if x <= 0 or base <= 0:
        return NUM
    return DIV0 if base == 1 else math.log10(x) if base == 10 else math.log(x) / math.log(base)


@scalar("POWER", "nn")
def power(x, y):
    if x == 0 and y == 0:
        return NUM
    if x == 0 and y < 0:
        return DIV0
    out = x**y
    return NUM if isinstance(out, complex) else out


@scalar("MOD", "nn")
def mod(x, y):
    return x - y * math.floor(x / y) if y else DIV0


@scalar("QUOTIENT", "nn")
def quotient(x, y):
    return float(math.trunc(x / y)) if y else DIV0


def away(x: float) -> float:
    return math.copysign(math.floor(abs(x) + 0.5), x)


def scaled(x: float, digits: float, f):
    """f of x scaled by a power of ten, scaled back."""
    d = int(digits)
    if d >= 0:
        s = 10.0**d
        return f(x * s) / s if math.isfinite(x * s) else x
    s = 10.0**-d
    return f(x / s) * s


def near(x: float) -> float:
    """Without the last bits that binary fractions leave behind, so that 2.3 * 10 counts as 23."""
    r = round(x)
    return float(r) if abs(x - r) < 1e-9 * max(1.0, abs(x)) and abs(x) < 1e15 else x


@scalar("ROUND", "nn")
def round_(x, d):
    return scaled(x, d, away)


@scalar("ROUNDUP", "nn")
def roundup(x, d):
    return scaled(x, d, lambda v: math.copysign(math.ceil(abs(near(v))), v))


@scalar("ROUNDDOWN TRUNC", "n|n")
def rounddown(x, d=0.0):
    return scaled(x, d, lambda v: float(math.trunc(near(v))))


def multiple(x: float, step: float, f) -> float:
    return f(near(x / step)) * step


@scalar("CEILING CEILING.ODS", "n|n")
def ceiling(x, step=1.0):
    if not step or not x:
        return 0.0
    if x > 0 > step:
        return NUM
    return multiple(x, step, math.ceil)


@scalar("FLOOR FLOOR.ODS", "n|n")
def floor(x, step=1.0):
    if not x:
        return 0.0
    if not step:
        return DIV0
    if x > 0 > step:
        return NUM
    return multiple(x, step, math.floor)


@scalar("CEILING.MATH CEILING.XCL", "n|nn")
def ceiling_math(x, step=1.0, mode=0.0):
    if not step:
        return 0.0
    return -multiple(-x, abs(step), math.ceil) if x < 0 and mode else multiple(x, abs(step), math.ceil)


@scalar("FLOOR.MATH FLOOR.XCL", "n|nn")
def floor_math(x, step=1.0, mode=0.0):
    if not step:
        return 0.0
    return -multiple(-x, abs(step), math.floor) if x < 0 and mode else multiple(x, abs(step), math.floor)


@scalar("CEILING.PRECISE ISO.CEILING ECMA.CEILING", "n|n")
def ceiling_precise(x, step=1.0):
    return multiple(x, abs(step), math.ceil) if step else 0.0


@scalar("FLOOR.PRECISE", "n|n")
def floor_precise(x, step=1.0):
    return multiple(x, abs(step), math.floor) if step else 0.0


@scalar("MROUND", "nn")
def mround(x, step):
    if not step or not x:
        return 0.0
    return NUM if x * step < 0 else multiple(x, step, away)


@scalar("COMBIN", "nn")
def combin(n, k):
    return math.comb(int(n), int(k)) if n >= k >= 0 else NUM


@scalar("COMBINA", "nn")
def combina(n, k):
    n, k = int(n), int(k)
    return NUM if n < 0 or k < 0 else 1.0 if not n and not k else math.comb(n + k - 1, k)


@scalar("PERMUT", "nn")
def permut(n, k):
    return math.perm(int(n), int(k)) if n >= k >= 0 else NUM


@scalar("PERMUTATIONA", "nn")
def permutationa(n, k):
    return int(n) ** int(k) if n >= 0 and k >= 0 else NUM


@scalar("BASE", "nn|n")
def base(x, radix, least=0.0):
    n, r = int(x), int(radix)
    if n < 0 or not 2 <= r <= 36 or least < 0 or n >= 1 << 53:
        return NUM
    out = ""
    while n:
        n, d = divmod(n, r)
        out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d] + out
    return out.rjust(max(int(least), 1), "0")


@scalar("DECIMAL", "tn")
def decimal(s, radix):
    return float(int(s.strip() or "0", int(radix))) if 2 <= radix <= 36 else NUM


ROMANS = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
#: Shorter forms by degree: what may stand before what is widened step by step.
SHORTER = {1: ((950, "LM"), (450, "LD"), (95, "VC"), (45, "VL")), 2: ((990, "XM"), (490, "XD"), (99, "IC"), (49, "IL")), 3: ((995, "VM"), (495, "VD")), 4: ((999, "IM"), (499, "ID"))}


@scalar("ROMAN", "n|a")
def roman(x, form=0.0):
    n, form = int(x), (0 if form is True else 4 if form is False else int(form or 0))
    if not 0 <= n <= 3999 or not 0 <= form <= 4:
        return VALUE
    steps = sorted([*ROMANS, *[s for k in range(1, form + 1) for s in SHORTER[k]]], reverse=True)
    out = ""
    for v, s in steps:
        while n >= v:
            out, n = out + s, n - v
    return out


@scalar("ARABIC", "t")
def arabic(s):
    s, sign = s.strip().upper(), 1
    if s.startswith("-"):
        s, sign = s[1:], -1
    value = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    if any(c not in value for c in s):
        return VALUE
    v = [value[c] for c in s]
    return float(sign * sum(-a if any(b > a for b in v[k + 1 : k + 2]) else a for k, a in enumerate(v)))


# Number bases of ten digits, negative ones in two's complement.
for _from, _r1, _bits1 in (("BIN", 2, 10), ("OCT", 8, 30), ("HEX", 16, 40)):

    def _read(s, r=_r1, bits=_bits1):
        s = s.strip()
        if len(s) > 10:
            raise NUM
        n = int(s or "0", r)
        return n - (1 << bits) if n >= 1 << (bits - 1) else n

    scalar(f"{_from}2DEC", "t")(lambda s, read=_read: float(read(s)))
    for _to, _r2, _bits2 in (("BIN", 2, 10), ("OCT", 8, 30), ("HEX", 16, 40)):

        def _write(n, places=None, r=_r2, bits=_bits2):
            if not -(1 << (bits - 1)) <= n < 1 << (bits - 1):
                return NUM
            if n < 0:
                return base(float(n + (1 << bits)), float(r))
            out = base(float(n), float(r))
            if places is None:
                return out
            return NUM if len(out) > places or places > 10 else out.rjust(int(places), "0")

        if _from != _to:
            scalar(f"{_from}2{_to}", "t|n")(lambda s, places=None, read=_read, write=_write: write(read(s), places))
        if _from == "BIN":
            scalar(f"DEC2{_to}", "n|n")(lambda x, places=None, write=_write: write(int(x), places))


def bits(x: float) -> int:
    if x < 0 or x != int(x) or x >= 1 << 48:
        raise NUM
    return int(x)


scalar("BITAND", "nn")(lambda a, b: bits(a) & bits(b))
scalar("BITOR", "nn")(lambda a, b: bits(a) | bits(b))
scalar("BITXOR", "nn")(lambda a, b: bits(a) ^ bits(b))


@scalar("BITLSHIFT", "nn")
def bitlshift(x, k):
    out = bits(x) << int(k) if k >= 0 else bits(x) >> -int(k)
    return out if out < 1 << 48 and abs(k) <= 53 else NUM


@scalar("BITRSHIFT", "nn")
def bitrshift(x, k):
    return bitlshift(x, -k)


scalar("DELTA", "n|n")(lambda a, b=0.0: float(a == b))
scalar("GESTEP", "n|n")(lambda a, b=0.0: float(a >= b))


def whole(values) -> list[int]:
    if any(v < 0 for v in values):
        raise NUM
    return [int(v) for v in values]


def gcd(values):
    return float(reduce(math.gcd, whole(values), 0))


def lcm(values):
    return float(reduce(math.lcm, whole(values), 1))


def multinomial(values):
    v = whole(values)
    return float(Fraction(math.factorial(sum(v)), math.prod(map(math.factorial, v))))
