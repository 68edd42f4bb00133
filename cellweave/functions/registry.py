"""Functions by name. A scalar function is given converted values and is repeated over arrays; a range function is given
its arguments as they are; a lazy one is given trees and the evaluator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .values import MISSING, NA, NUM, VALUE, Arr, Err, boolean, num, number_result, single, text


@dataclass(frozen=True)
class Function:
    name: str
    kind: str
    body: Callable
    spec: str = ""


TABLE: dict[str, Function] = {}
VOLATILE = {"NOW", "TODAY", "RAND", "RANDBETWEEN", "RANDARRAY", "OFFSET", "INDIRECT", "CELL", "INFO"}


def add(kind: str, names: str, spec: str = ""):
    def put(body: Callable) -> Callable:
        for name in names.split():
            TABLE[name] = Function(name, kind, body, spec)
        return body

    return put


def scalar(names: str, spec: str):
    """spec: a letter for each argument (n number, d number or date, t text, b boolean, a as it is, A arrays too), optional ones after |; * repeats."""
    return add("scalar", names, spec)


def ranged(names: str):
    return add("range", names)


def lazy(names: str):
    return add("lazy", names)


def moment(v) -> float:
    """A number, or the date or time that a text spells."""
    v = single(v)
    if isinstance(v, str):
        from .dates import read_value

        got = read_value(v)
        if got is None:
            raise VALUE
        return got
    return num(v)


CONVERT = {"n": num, "t": text, "b": boolean, "d": moment}


def call_scalar(f: Function, args: list):
    """One call with single values; errors among the arguments win, the first one first."""
    need, _, more = f.spec.partition("|")
    letters = need + more
    if letters.endswith("*"):
        letters = letters[:-1] + letters[-2] * max(0, len(args) - len(letters) + 1)
    if len(args) < len(need.rstrip("*")) or len(args) > len(letters):
        return VALUE
    try:
        given = []
        for a, kind in zip(args, letters, strict=False):
            if a is MISSING:
                given.append(None if kind in more else CONVERT.get(kind, lambda v: v)(None))
            elif kind == "a":
                given.append(single(a))
            elif kind == "A":
                given.append(a)
            else:
                given.append(CONVERT[kind](a))
        while given and given[-1] is None and len(given) > len(need):
            given.pop()
        out = f.body(*given)
    except Err as e:
        return e
    except (ValueError, ArithmeticError, TypeError, IndexError, KeyError):
        return NUM
    if isinstance(out, bool) or out is None or isinstance(out, (str, Err, Arr)):
        return out
    if isinstance(out, (int, float)):
        try:
            return number_result(float(out))
        except OverflowError:
            return NUM
    return out


def lifted(f: Function, args: list):
    """A scalar function over arrays: single rows, columns and cells are stretched, the rest is #N/A."""
    arrays = [a for a in args if isinstance(a, Arr)]
    if not arrays or "A" in f.spec:
        return call_scalar(f, args)
    h, w = max(a.height for a in arrays), max(a.width for a in arrays)
    if h == w == 1:
        return call_scalar(f, [single(a) for a in args])
    return Arr([[call_scalar(f, [at(a, r, c) for a in args]) for c in range(w)] for r in range(h)])


def at(a, r: int, c: int):
    if not isinstance(a, Arr):
        return a
    r, c = 0 if a.height == 1 else r, 0 if a.width == 1 else c
    return a.rows[r][c] if r < a.height and c < a.width else NA
