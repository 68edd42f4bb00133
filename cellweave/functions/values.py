"""Values of the formula language and how they turn into one another.

Blank is None, numbers are floats, then str, bool, Err and Arr (rows of values). Errors are values and propagate."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

MAX_TEXT = 32767
DELTA = 1e-13


class Err(Exception):
    """An error as a value; raised inside functions to become their result."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code

    def __eq__(self, other) -> bool:
        return isinstance(other, Err) and other.code == self.code

    def __hash__(self) -> int:
        return hash(self.code)

    def __repr__(self) -> str:
        return f"Err({self.code!r})"

    def __str__(self) -> str:
        return self.code

    def __reduce__(self):
        return Err, (self.code,)


NULL, DIV0, VALUE, REF, NAME, NUM, NA, CALC = (Err(c) for c in ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#CALC!"))
ERRORS = {e.code: e for e in (NULL, DIV0, VALUE, REF, NAME, NUM, NA, CALC)}


class Arr:
    """A rectangle of values; `ref` is set if it was read from cells, whose text and booleans aggregates skip."""

    __slots__ = ("rows", "ref", "at")

    def __init__(self, rows, ref: bool = False, at=None):
        self.rows, self.ref, self.at = rows, ref, at

    @property
    def height(self) -> int:
        return len(self.rows)

    @property
    def width(self) -> int:
        return len(self.rows[0]) if self.rows else 0

    def flat(self):
        for row in self.rows:
            yield from row

    def __repr__(self) -> str:
        return f"Arr({self.rows!r})"


@dataclass(frozen=True)
class Lambda:
    params: tuple
    body: object
    scope: dict
    optional: frozenset = frozenset()


class Missing:
    """An argument that was left out."""


MISSING = Missing()


def arr(v) -> Arr:
    return v if isinstance(v, Arr) else Arr([[v]])


def single(v):
    return v.rows[0][0] if isinstance(v, Arr) and v.height and v.width else v


NUMBER = re.compile(r"\s*([+-]?)\s*(\d+(?:\.\d*)?|\.\d+)(?:[eE]([+-]?\d+))?\s*(%*)\s*")


def parse_number(s: str) -> float | None:
    m = NUMBER.fullmatch(s)
    if not m:
        return None
    v = float(m[2] + (f"e{m[3]}" if m[3] else ""))
    return (-v if m[1] == "-" else v) / 100 ** len(m[4])


def num(v) -> float:
    """As a number, or raises an Err."""
    v = single(v)
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (float, int)):
        return float(v)
    if v is None or v is MISSING:
        return 0.0
    if isinstance(v, Err):
        raise v
    if isinstance(v, str):
        got = parse_number(v)
        if got is None:
            raise VALUE
        return got
    raise VALUE


def general(x: float) -> str:
    """A number as the general format writes it in text: 15 significant digits."""
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    s = f"{x:.15g}"
    if "e" in s:
        m, e = s.split("e")
        exp = int(e)
        if -5 < exp < 0 or 0 < exp < 21:
            return f"{x:.{max(0, 14 - exp)}f}".rstrip("0").rstrip(".")
        return f"{m}E{'+' if exp > 0 else '-'}{abs(exp):02d}"
    return s


def text(v) -> str:
    v = single(v)
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (float, int)):
        return general(float(v))
    if v is None or v is MISSING:
        return ""
    if isinstance(v, Err):
        raise v
    raise VALUE


def boolean(v) -> bool:
    v = single(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, int)):
        return v != 0
    if v is None or v is MISSING:
        return False
    if isinstance(v, Err):
        raise v
    if isinstance(v, str):
        if v.upper() in ("TRUE", "FALSE"):
            return v.upper() == "TRUE"
        got = parse_number(v)
        if got is not None:
            return got != 0
    raise VALUE


def rank_of(v) -> int:
    return 0 if v is None or (isinstance(v, (int, float)) and not isinstance(v, bool)) else 1 if isinstance(v, str) else 2 if isinstance(v, bool) else 3


def compare(a, b) -> int:
    """-1, 0 or 1: numbers, then text without case, then FALSE, TRUE; blank adapts to the other side."""
    for x in (a, b):
        if isinstance(x, Err):
            raise x
    if a is None and b is None:
        return 0
    if a is None:
        a = "" if isinstance(b, str) else False if isinstance(b, bool) else 0.0
    if b is None:
        b = "" if isinstance(a, str) else False if isinstance(a, bool) else 0.0
    ra, rb = rank_of(a), rank_of(b)
    if ra != rb:
        return -1 if ra < rb else 1
    if ra == 0:
        return 0 if a == b or abs(a - b) < DELTA * max(1.0, abs(a), abs(b)) else -1 if a < b else 1
    if ra == 1:
        a, b = a.upper(), b.upper()
    return (a > b) - (a < b)


def same(a, b) -> bool:
    if isinstance(a, Err) or isinstance(b, Err):
        return a == b
    return compare(a, b) == 0


def number_result(x: float):
    """A float as a value: what isn't finite is #NUM!."""
    return x if math.isfinite(x) else NUM


def wildcard(pattern: str) -> re.Pattern:
    """* and ? as a regular expression over the whole text, ~ quoting."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "~" and k + 1 < len(pattern) and pattern[k + 1] in "*?~":
            out.append(re.escape(pattern[k + 1]))
            k += 1
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        k += 1
    return re.compile("".join(out), re.I | re.S)


def has_wildcard(s: str) -> bool:
    return "*" in s or "?" in s or "~" in s


def criterion(c):
    """A test of values from a criterion such as 5, "apple", ">=3" or "a*"."""
    c = single(c)
    if isinstance(c, Err):
        return lambda v: v == c
    if c is None or c is MISSING:
        c = 0.0
    if not isinstance(c, str):
        return lambda v: v is not None and not isinstance(v, Err) and rank_of(v) == rank_of(c) and same(v, c)
    op = next((o for o in ("<>", ">=", "<=", ">", "<", "=") if c.startswith(o)), "")
    rest = c[len(op) :]
    value: object = parse_number(rest)
    if value is None and rest.upper() in ("TRUE", "FALSE"):
        value = rest.upper() == "TRUE"
    if value is None and rest in ERRORS:
        value = ERRORS[rest]
    if value is None:
        value = rest
    if op in ("", "=", "<>"):
        if value == "":
            hit = (lambda v: v is None or v == "") if op == "" else (lambda v: v is None)
        elif isinstance(value, Err):
            hit = lambda v: v == value
        elif isinstance(value, str):
            pattern = wildcard(value)
            hit = lambda v: isinstance(v, str) and pattern.fullmatch(v) is not None
        else:
            hit = lambda v: v is not None and not isinstance(v, Err) and ((rank_of(v) == rank_of(value) and same(v, value)) or (isinstance(v, str) and not isinstance(value, bool) and parse_number(v) == value))
        return (lambda v: not hit(v)) if op == "<>" else hit

    def bound(v) -> bool:
        if v is None or isinstance(v, Err) or rank_of(v) != rank_of(value):
            return False
        k = compare(v, value)
        return k > 0 if op == ">" else k >= 0 if op == ">=" else k < 0 if op == "<" else k <= 0

    return bound
