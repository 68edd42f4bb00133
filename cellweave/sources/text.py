"""Delimited text: encodings, delimiter inference, quoting, typing of fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import ERRORS, parse_number

CANDIDATES = [",", ";", "\t", "|", ":", " ", "~"]
SAMPLE_LINES = 1000


def decode(data: bytes) -> str:
    """Text by its byte order mark, as UTF-8, or else as CP1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name)
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def infer_delimiter(lines: list[str]) -> str:
    """The candidate whose count per line (outside quotes) deviates least from its median; a sep=x line says it."""
    if lines and (m := re.fullmatch(r"sep=(.)", lines[0].strip("\r\n"), re.I)):
        return m[1]
    bare = [re.sub(r'"(?:[^"]|"")*"', "", line) for line in lines[:SAMPLE_LINES] if line.strip()]
    best, score = ",", None
    for c in CANDIDATES:
        counts = sorted(line.count(c) for line in bare)
        if not counts or not counts[len(counts) // 2]:
            continue
        middle = counts[len(counts) // 2]
        off = sum(abs(k - middle) for k in counts) / (len(counts) * middle)
        if score is None or off < score - 1e-12:
            best, score = c, off
    return best


def fields(record: str, delimiter: str = ",") -> list[str]:
    """A record's fields: quotes enclose, doubled quotes are one, text after a closing quote is kept."""
    out, at, n = [], 0, len(record)
    while True:
        value = ""
        if at < n and record[at] == '"':
            at += 1
            while at < n:
                if record[at] == '"':
                    if record[at + 1 : at + 2] == '"':
                        value, at = value + '"', at + 2
                        continue
                    at += 1
                    break
                value, at = value + record[at], at + 1
        end = record.find(delimiter, at)
        end = n if end < 0 else end
        out.append(value + record[at:end])
        if end >= n:
            return out
        at = end + len(delimiter)


def typed(text: str):
    """A field's value: booleans, errors, numbers, formulas (as text with their =), else text; blank for nothing."""
    if text == "":
        return None
    if text.upper() in ("TRUE", "FALSE"):
        return text.upper() == "TRUE"
    if text.upper() in ERRORS:
        return ERRORS[text.upper()]
    number = parse_number(text)
    return text if number is None or text.strip() != text else number


def typed_column(c: Column) -> dict[str, Column]:
    """The same rules as columns (num, bool, err, str), of which at most one is set."""
    up = F.upper(c)
    number = F.coalesce(c.try_cast("double"), F.rtrim(c, F.lit("%")).try_cast("double") / 100)
    is_bool, is_err = up.isin("TRUE", "FALSE"), up.isin(*ERRORS)
    return {"num": F.when(~is_bool & ~is_err, number), "bool": F.when(is_bool, up == "TRUE"), "err": F.when(is_err, up), "str": F.when(~is_bool & ~is_err & number.isNull() & (c != ""), c)}


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, encoding: str = "UTF-8", infer: bool = True) -> DataFrame:
    """Delimited text as a table; the delimiter comes from the first lines if not given, and each column is double,
    boolean or text by what all its fields are (one aggregate over the file)."""
    if delimiter is None:
        delimiter = infer_delimiter([r.value for r in spark.read.text(path).limit(SAMPLE_LINES).collect()])
    df = spark.read.csv(path, sep=delimiter, header=header, encoding=encoding, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", inferSchema=False)
    if not infer or not df.columns:
        return df
    tests = []
    for k, c in enumerate(df.columns):
        t = typed_column(F.col(f"`{c}`"))
        tests += [F.count(t["num"]).alias(f"n{k}"), F.count(t["bool"]).alias(f"b{k}"), F.count(F.nullif(F.col(f"`{c}`"), F.lit(""))).alias(f"a{k}")]
    facts = df.agg(*tests).first()
    out = []
    for k, c in enumerate(df.columns):
        t = typed_column(F.col(f"`{c}`"))
        whole = facts[f"a{k}"]
        out.append((t["num"] if whole and facts[f"n{k}"] == whole else t["bool"] if whole and facts[f"b{k}"] == whole else F.col(f"`{c}`")).alias(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=delimiter, header=header, quote='"', escape='"')
