"""Data tools: text to columns, flash fill, validation, conditional flags, what-if analysis and solving."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_to_columns(df: DataFrame, column: str, names: list[str], delimiters: str = ",", merge: bool = False, widths: list[int] | None = None) -> DataFrame:
    """Splits a text at any of the delimiters (runs of them as one if merged), or at fixed widths, into named columns."""
    c = F.col(column)
    if widths:
        starts = np.concatenate(([0], np.cumsum(widths)))
        return df.select("*", *[F.trim(F.substring(c, int(a) + 1, int(w))).alias(n) for n, a, w in zip(names, starts, widths, strict=False)])
    parts = F.split(c, f"[{re.escape(delimiters)}]{'+' if merge else ''}")
    return df.select("*", *[F.get(parts, k).alias(n) for k, n in enumerate(names)])


def learn(examples: list[tuple[str, str]]) -> list[tuple]:
    """Flash fill: a program of pieces (word, case, slice, literal) that gives every example's answer; words are picked
    by number from either end."""
    words = [re.findall(r"\w+", a) for a, _ in examples]

    def pieces(k: int, at: int):
        answer = examples[k][1]
        for n, w in enumerate(words[k]):
            for case in ("as", "upper", "lower", "proper"):
                s = {"as": w, "upper": w.upper(), "lower": w.lower(), "proper": w.capitalize()}[case]
                for end in (n, n - len(words[k])):
                    if answer.startswith(s, at):
                        yield ("word", end, case, None), at + len(s)
                    if s and len(s) > 1 and answer.startswith(s[0], at):
                        yield ("word", end, case, 1), at + 1
        yield ("text", answer[at]), at + 1

    def run(program, k) -> str | None:
        out = ""
        for p in program:
            if p[0] == "text":
                out += p[1]
                continue
            try:
                w = words[k][p[1]]
            except IndexError:
                return None
            w = {"as": w, "upper": w.upper(), "lower": w.lower(), "proper": w.capitalize()}[p[2]]
            out += w[: p[3]] if p[3] else w
        return out

    def search(program, at):
        if at == len(examples[0][1]):
            return program if all(run(program, k) == b for k, (_, b) in enumerate(examples)) else None
        for p, nxt in sorted(pieces(0, at), key=lambda x: -x[1]):
            found = search([*program, p], nxt)
            if found:
                return found
        return None

    out = search([], 0)
    if out is None:
        raise ValueError("the examples have no common rule")
    return out


def flash_fill(df: DataFrame, column: str, examples: list[tuple[str, str]], name: str) -> DataFrame:
    """A column by a rule learnt from examples on the driver; the rule itself is a native expression."""
    words = F.regexp_extract_all(F.col(column), F.lit(r"(\w+)"), F.lit(1))
    case = {"as": lambda c: c, "upper": F.upper, "lower": F.lower, "proper": F.initcap}
    parts = []
    for p in learn(examples):
        if p[0] == "text":
            parts.append(F.lit(p[1]))
            continue
        w = case[p[2]](F.try_element_at(words, F.lit(p[1] + 1 if p[1] >= 0 else p[1])))
        parts.append(F.substring(w, 1, p[3]) if p[3] else w)
    return df.withColumn(name, F.concat(*parts))


def invalid(df: DataFrame, column: str, kind: str, low=None, high=None, items: list[str] | None = None, allow_blank: bool = True) -> DataFrame:
    """Data validation: the rows that break a rule (whole, decimal, list, date, time, textLength, custom)."""
    c = F.col(column)
    n = F.char_length(c) if kind == "textLength" else c
    if kind == "list":
        good = F.upper(c.cast("string")).isin([i.upper() for i in items or []])
    elif kind == "custom":
        good = low
    else:
        good = F.lit(True)
        if low is not None:
            good &= n >= low
        if high is not None:
            good &= n <= high
        if kind == "whole":
            good &= c == F.floor(c)
    blank = c.isNull() | (c.cast("string") == "")
    return df.filter(~F.coalesce(good, F.lit(False)) & (~blank if allow_blank else F.lit(True)))


def flags(df: DataFrame, column: str, rule: str, n: float | None = None) -> DataFrame:
    """Conditional formats as flags: aboveAverage, belowAverage, top, bottom, topPercent, duplicate, unique, blank, scale
    (0 to 1), icon3. What they compare with is one aggregated row, or counts per value."""
    c = F.col(column)
    if rule in ("duplicate", "unique"):
        counts = df.groupBy(c.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        return df.join(counts, c == F.col("_k"), "left").withColumn("flag", F.coalesce(F.col("_n") > 1 if rule == "duplicate" else F.col("_n") == 1, F.lit(False))).drop("_k", "_n")
    if rule == "blank":
        return df.withColumn("flag", c.isNull() | (F.trim(c.cast("string")) == ""))
    if rule in ("top", "bottom", "topPercent"):
        from .criteria import kth

        if rule == "topPercent":
            n = max(1, int(df.filter(c.isNotNull()).count() * n / 100))
        cut = kth(df, column, int(n), rule != "bottom")
        hit = c.isNotNull() if cut is None else c <= cut if rule == "bottom" else c >= cut
        return df.withColumn("flag", F.coalesce(hit, F.lit(False)))
    facts = F.broadcast(df.agg(F.avg(c).alias("_a"), F.min(c).alias("_lo"), F.max(c).alias("_hi")))  # one row
    share = F.try_divide(c - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    out = {"aboveAverage": c > F.col("_a"), "belowAverage": c < F.col("_a"), "scale": share, "icon3": F.when(share >= 0.67, 3).when(share >= 0.33, 2).otherwise(1)}[rule]
    return df.crossJoin(facts).withColumn("flag", out).drop("_a", "_lo", "_hi")


def data_table(df: DataFrame, model: Callable[[Column, Column | None], Column], rows: list[float], columns: list[float] | None = None) -> DataFrame:
    """What-if data table: an aggregate model evaluated for each input (or pair of inputs) in one pass over df."""
    cells = [(r, c) for r in rows for c in (columns or [None])]
    out = df.agg(*[model(F.lit(float(r)), None if c is None else F.lit(float(c))).alias(f"_{k}") for k, (r, c) in enumerate(cells)])
    packed = F.array(*[F.struct(F.lit(float(r)).alias("row_input"), F.lit(None if c is None else float(c)).cast("double").alias("column_input"), F.col(f"_{k}").alias("value")) for k, (r, c) in enumerate(cells)])
    return out.select(F.explode(packed).alias("x")).select("x.*")


def scenarios(df: DataFrame, model: Callable[[dict], Column], cases: dict[str, dict[str, float]]) -> DataFrame:
    """Scenario summary: the model's result for each named set of inputs, in one pass."""
    out = df.agg(*[model({k: F.lit(float(v)) for k, v in given.items()}).alias(name) for name, given in cases.items()])
    return out.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, cases)), F.array(*[F.col(f"`{c}`") for c in cases]))).alias("scenario", "result"))


def goal_seek(f: Callable[[float], float], goal: float, start: float = 0.0, tolerance: float = 1e-3, tries: int = 100) -> float | None:
    """The input for which f reaches the goal: secant steps, then bisection once the sign has changed."""
    g = lambda x: f(x) - goal
    a, b = start, start + (0.01 if start == 0 else abs(start) * 0.01)
    ya, yb = g(a), g(b)
    for _ in range(tries):
        if abs(yb) < tolerance * 1e-3:
            return b
        if yb == ya:
            b += 1.0
            yb = g(b)
            continue
        c = b - yb * (b - a) / (yb - ya)
        a, ya, b, yb = b, yb, c, g(c)
    low, high = -1e6, 1e6
    if g(low) * g(high) > 0:
        return None
    for _ in range(200):
        mid = (low + high) / 2
        if g(low) * g(mid) <= 0:
            high = mid
        else:
            low = mid
    return (low + high) / 2


def simplex(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Maximises c x over a x <= b, x >= 0, by two phases on a dense tableau with Bland's rule; None if infeasible.
    An unbounded program raises OverflowError."""
    m, n = a.shape
    sign = np.where(b < 0, -1.0, 1.0)
    t = np.zeros((m + 1, n + 2 * m + 1))
    t[:m, :n], t[:m, n : n + m], t[:m, -1] = a * sign[:, None], np.diag(sign), b * sign
    basis = []
    for i in range(m):
        if sign[i] > 0:
            basis.append(n + i)
        else:
            t[i, n + m + i] = 1
            basis.append(n + m + i)

    def pivot(r, k):
        t[r] /= t[r, k]
        for i in range(m + 1):
            if i != r:
                t[i] -= t[i, k] * t[r]
        basis[r] = k

    def run(width):
        while True:
            enter = next((k for k in range(width) if t[m, k] < -1e-9), None)
            if enter is None:
                return
            ratios = [(t[i, -1] / t[i, enter], basis[i], i) for i in range(m) if t[i, enter] > 1e-9]
            if not ratios:
                raise OverflowError("unbounded")
            pivot(min(ratios)[2], enter)

    if any(k >= n + m for k in basis):
        t[m] = 0
        t[m, n + m : n + 2 * m] = 1
        for i in range(m):
            if basis[i] >= n + m:
                t[m] -= t[i]
        run(n + 2 * m)
        if t[m, -1] < -1e-7:
            return None
        for i in range(m):
            if basis[i] >= n + m:
                k = next((k for k in range(n + m) if abs(t[i, k]) > 1e-9), None)
                if k is not None:
                    pivot(i, k)
    t[m] = 0
    t[m, :n] = -c
    for i in range(m):
        if basis[i] < n and t[m, basis[i]]:
            t[m] -= t[m, basis[i]] * t[i]
    t[:, n + m : n + 2 * m] = 0
    run(n + m)
    x = np.zeros(n)
    for i in range(m):
        if basis[i] < n:
            x[basis[i]] = t[i, -1]
    return x, float(c @ x)


def solve(c, a, b, whole: list[int] | None = None) -> tuple[np.ndarray, float] | None:
    """Linear programs with some variables whole, by branch and bound on the simplex method."""
    c, a, b = np.asarray(c, float), np.atleast_2d(np.asarray(a, float)), np.asarray(b, float)
    best: tuple[np.ndarray, float] | None = None
    stack = [(a, b)]
    while stack:
        aa, bb = stack.pop()
        got = simplex(c, aa, bb)
        if got is None or (best is not None and got[1] <= best[1] + 1e-9):
            continue
        part = next((k for k in whole or [] if abs(got[0][k] - round(got[0][k])) > 1e-7), None)
        if part is None:
            best = got
            continue
        row = np.zeros(len(c))
        row[part] = 1
        v = got[0][part]
        stack.append((np.vstack([aa, row]), np.append(bb, np.floor(v))))
        stack.append((np.vstack([aa, -row]), np.append(bb, -np.ceil(v))))
    return best


def minimise(f: Callable[[np.ndarray], float], start, constraints: list[Callable[[np.ndarray], float]] = (), rounds: int = 8, steps: int = 400) -> tuple[np.ndarray, float]:
    """Nonlinear programs: f under constraints g(x) <= 0, by an augmented Lagrangian whose subproblems are solved by a
    simplex of points (reflect, expand, contract, shrink)."""
    x, weight, dual = np.asarray(start, float), 1.0, np.zeros(len(constraints))

    def cost(v):
        g = np.array([c(v) for c in constraints]) if len(constraints) else np.zeros(0)
        return f(v) + (np.maximum(dual + weight * g, 0) ** 2 - dual**2).sum() / (2 * weight)

    for _ in range(rounds if len(constraints) else 2):
        points = [x] + [x + d for d in np.eye(len(x)) * np.maximum(0.5, 0.1 * np.abs(x))]
        values = [cost(p) for p in points]
        for _ in range(steps * len(x)):
            order = np.argsort(values)
            points, values = [points[k] for k in order], [values[k] for k in order]
            if abs(values[-1] - values[0]) < 1e-13 * (1 + abs(values[0])) and np.abs(points[-1] - points[0]).max() < 1e-9:
                break
            middle = np.mean(points[:-1], axis=0)
            trial = middle + (middle - points[-1])
            v = cost(trial)
            if v < values[0]:
                far = middle + 2 * (middle - points[-1])
                w = cost(far)
                trial, v = (far, w) if w < v else (trial, v)
            elif v >= values[-2]:
                trial = middle + 0.5 * (points[-1] - middle)
                v = cost(trial)
                if v >= values[-1]:
                    points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                    values = [cost(p) for p in points]
                    continue
            points[-1], values[-1] = trial, v
        x = points[int(np.argmin(values))]
        if len(constraints):
            dual = np.maximum(dual + weight * np.array([c(x) for c in constraints]), 0)
            weight *= 3
    return x, float(f(x))
