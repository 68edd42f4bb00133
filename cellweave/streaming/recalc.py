"""Recalculation: dependency levels of formulas, what a change reaches, and grouped totals kept up over a stream.

Copies of a formula are one template, so the graph on the driver has a node for each column or template, not for each
cell; on rows a wave is one select. Streams keep totals per group by Structured Streaming's own state."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import REF
from ..plans.compiler import Compiler
from ..plans.evaluator import Evaluator, Workbook
from ..plans.parser import Call, Name, Ref, Structured, SyntaxProblem, parse, walk

VOLATILE = {"NOW", "TODAY", "RAND", "RANDBETWEEN", "RANDARRAY", "OFFSET", "INDIRECT", "CELL", "INFO"}


class Cycle(ValueError):
    """Formulas that need each other: #REF!."""


@dataclass
class Model:
    """Calculated columns of a table: formulas by name, in any order."""

    formulas: dict[str, str] = field(default_factory=dict)

    def reads(self, name: str) -> set[str]:
        tree = parse(self.formulas[name])
        own = {n.lower(): n for n in self.formulas}
        found = {t.first for t in walk(tree) if isinstance(t, Structured) and t.first} | {t.name for t in walk(tree) if isinstance(t, Name)}
        return {own[f.lower()] for f in found if f.lower() in own}

    def levels(self) -> list[list[str]]:
        """Waves of formulas, each of which reads only earlier waves."""
        left, done, out = dict.fromkeys(self.formulas), set(), []
        while left:
            wave = [n for n in left if self.reads(n) <= done]
            if not wave:
                raise Cycle(f"{REF}: {sorted(left)}")
            out.append(wave)
            done |= set(wave)
            left = {n: None for n in left if n not in done}
        return out

    def affected(self, changed: set[str]) -> list[str]:
        """The formulas that a change of columns reaches, and volatile ones, in order of evaluation."""
        low, hit = {c.lower() for c in changed}, set()
        for wave in self.levels():
            for n in wave:
                tree = parse(self.formulas[n])
                names = {t.first.lower() for t in walk(tree) if isinstance(t, Structured) and t.first} | {t.name.lower() for t in walk(tree) if isinstance(t, Name)}
                if names & low or any(isinstance(t, Call) and t.name in VOLATILE for t in walk(tree)):
                    low.add(n.lower())
                    hit.add(n)
        return [n for wave in self.levels() for n in wave if n in hit]

    def recalculate(self, df: DataFrame, only: set[str] | None = None, table: str | None = None) -> DataFrame:
        """df with all calculated columns (or those a change reaches), one select a wave."""
        wanted = set(self.affected(only)) if only is not None else set(self.formulas)
        for wave in self.levels():
            for n in wave:
                if n in wanted:
                    df = Compiler(df, table).with_column(n, self.formulas[n])
        return df


def references(book: Workbook) -> dict[tuple, set]:
    """For each formula cell the rectangles it reads: (sheet, r1, c1, r2, c2)."""
    out = {}
    for (sheet, r, c), source in book.formulas.items():
        try:
            tree = parse(source)
        except SyntaxProblem:
            out[sheet, r, c] = set()
            continue
        out[sheet, r, c] = {(t.sheet or sheet, t.r1 or 1, t.c1 or 1, t.r2 or 1 << 20, t.c2 or 1 << 14) for t in walk(tree) if isinstance(t, Ref)}
    return out


def dirty(book: Workbook, changed: list[tuple[str, int, int]]) -> set[tuple[str, int, int]]:
    """The formula cells that changed cells reach through ranges."""
    reads, out, front = references(book), set(), set(changed)
    always = {k for k, s in book.formulas.items() if any(v + "(" in s.upper() for v in VOLATILE)}
    front |= always
    out |= always
    while front:
        nxt = {k for k, areas in reads.items() if k not in out and any(s == a[0] and a[1] <= r <= a[3] and a[2] <= c <= a[4] for s, r, c in front for a in areas)}
        out |= nxt
        front = nxt
    return out


def recalculate(book: Workbook, changed: list[tuple[str, int, int]] | None = None) -> dict[tuple[str, int, int], object]:
    """Values of all formulas, or of those that a change reaches; formulas in a cycle are #REF!."""
    ev = Evaluator(book)
    return {k: ev.value_at(*k) for k in (book.formulas if changed is None else dirty(book, changed))}


def streaming_totals(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling-window totals of a stream with a watermark: (start, keys..., n, total); late rows are those behind it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("_w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows per key: runs of events with no longer gap."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.session_window(time, gap).alias("_w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), key, "n")


def keep_totals(changes: DataFrame, keys: list[str], value: str, path: str, checkpoint: str):
    """Incremental recalculation of grouped sums: each micro-batch of changes is aggregated and appended under its batch
    number, so that a repeated batch replaces itself; current_totals() adds them up."""

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def current_totals(spark, path: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
