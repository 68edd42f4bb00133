"""Workbooks as cells: xlsx, ods, SYLK, SpreadsheetML 2003, Gnumeric and HTML tables; a Spark data source over them, and
writers. Formats are told by their first bytes, then by name; delimited text is what remains.

Scale: files are read by Spark as binary rows, a task a file, so any number of workbooks on any store that Spark reads
go in parallel; a sheet leaves its task row by row in batches.
"""

from __future__ import annotations

import gzip
import html as html_
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import ERRORS, Err, text
from ..plans.evaluator import Evaluator, Table, Workbook
from ..plans.parser import column_letters, column_number
from .binary import ods_bytes, read_xls, read_xlsb, xls_bytes
from .text import decode, fields, infer_delimiter, typed

CELLS = "path string, sheet_idx int, sheet string, row long, col int, kind string, num double, str string, bool boolean, err string, formula string"
MAX_EXPANDED, MAX_RATIO = 512 << 20, 100


class Unsupported(ValueError):
    pass


def sniff(data: bytes, name: str = "") -> str:
    """The format of some bytes: by signature first, by extension second, text last."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            if "mimetype" in names and b"opendocument" in z.read("mimetype") or "content.xml" in names:
                return "ods"
            return "xlsb" if any(n.endswith("workbook.bin") for n in names) else "xlsx"
    if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return "xls"
    if data[:2] == b"\x1f\x8b":
        return "gnumeric"
    if data[:4] == b"ID;P":
        return "slk"
    head = decode(data[:2048]).lstrip().lower()
    if head.startswith("<"):
        return "xml2003" if "urn:schemas-microsoft-com:office:spreadsheet" in head else "html"
    return {"slk": "slk", "htm": "html", "html": "html", "xml": "xml2003"}.get(name.lower().rpartition(".")[2], "csv")


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(e: ET.Element, name: str, default=None):
    return next((v for k, v in e.attrib.items() if local(k) == name), default)


Row = tuple[int, str, int, int, object, str | None]


def read_xlsx(data: bytes) -> Iterator[Row]:
    """(sheet number, title, row, column, value, formula) of every cell with either, sheet by sheet, row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        size = sum(i.file_size for i in z.infolist())
        if size > MAX_EXPANDED and size > MAX_RATIO * max(len(data), 1):
            raise Unsupported("the package expands too much")
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for e in ET.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in e.iter() if local(t.tag) == "t"))
        rels = {r.attrib["Id"]: r.attrib["Target"] for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        sheets = [e for e in book.iter() if local(e.tag) == "sheet"]
        for k, s in enumerate(sheets):
            target = rels[next(v for n, v in s.attrib.items() if local(n) == "id")]
            target = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            with z.open(target) as f:
                for _, e in ET.iterparse(f):
                    if local(e.tag) != "row":
                        continue
                    for c in e:
                        if local(c.tag) != "c":
                            continue
                        m = re.fullmatch(r"([A-Z]+)(\d+)", c.attrib.get("r", ""))
                        kind, v, formula = c.attrib.get("t", "n"), None, None
                        for x in c:
                            if local(x.tag) == "v":
                                v = x.text or ""
                            elif local(x.tag) == "f":
                                formula = x.text or ""
                            elif local(x.tag) == "is":
                                v, kind = "".join(t.text or "" for t in x.iter() if local(t.tag) == "t"), "str"
                        if v is None and not formula:
                            continue
                        if v is not None:
                            v = shared[int(v)] if kind == "s" else v == "1" if kind == "b" else ERRORS.get(v, Err(v)) if kind == "e" else v if kind in ("str", "d", "inlineStr") else float(v)
                        yield k, s.attrib["name"], int(m[2]), column_number(m[1]), v, formula or None
                    e.clear()


def read_ods(data: bytes) -> Iterator[Row]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("content.xml"))
    for k, t in enumerate(e for e in root.iter() if local(e.tag) == "table"):
        title, r = attribute(t, "name", f"Sheet{k + 1}"), 0
        for row in (e for e in t.iter() if local(e.tag) == "table-row"):
            again, c = int(attribute(row, "number-rows-repeated", 1)), 0
            found = []
            for cell in row:
                n = int(attribute(cell, "number-columns-repeated", 1))
                kind = attribute(cell, "value-type")
                shown = "\n".join("".join(p.itertext()) for p in cell if local(p.tag) == "p")
                v = None
                if kind in ("float", "percentage", "currency"):
                    v = float(attribute(cell, "value"))
                elif kind == "boolean":
                    v = attribute(cell, "boolean-value") == "true"
                elif kind in ("string", "date", "time"):
                    v = shown or attribute(cell, f"{kind}-value")
                formula = attribute(cell, "formula")
                formula = re.sub(r"\[([^\]]*)\]", odf_reference, formula.partition("=")[2].replace(";", ",")) if formula else None
                if v is not None or formula:
                    found += [(c + q + 1, v, formula) for q in range(min(n, 1024))]
                c += n
            for q in range(min(again, 1024) if found else 0):
                for col, v, formula in found:
                    yield k, title, r + q + 1, col, v, formula
            r += again


def odf_reference(m: re.Match) -> str:
    """[.A1], [.A1:.B2] and [$Sheet.A1] as A1, A1:B2 and Sheet!A1."""
    sheet, cells = "", []
    for k, part in enumerate(m[1].split(":")):
        own, _, cell = part.rpartition(".")
        cells.append(cell)
        sheet = own.lstrip("$") if k == 0 else sheet
    return (f"{sheet}!" if sheet else "") + ":".join(cells)


def read_slk(data: bytes) -> Iterator[Row]:
    """SYLK: C records set a value (K) or an expression (E) at the current X and Y."""
    x = y = 1
    for line in decode(data).splitlines():
        parts = [p.replace("\0", ";") for p in line.replace(";;", "\0").split(";")]
        if parts[0] not in ("C", "F"):
            continue
        v, formula, has = None, None, False
        for p in parts[1:]:
            if p[:1] == "X":
                x = int(p[1:])
            elif p[:1] == "Y":
                y = int(p[1:])
            elif p[:1] == "K":
                has = True
                raw = p[1:]
                v = raw[1:-1].replace('""', '"') if raw.startswith('"') else typed(raw)
            elif p[:1] == "E":
                formula = p[1:]
        if parts[0] == "C" and (has or formula):
            yield 0, "Sheet1", y, x, v, formula


def read_xml2003(data: bytes) -> Iterator[Row]:
    root = ET.fromstring(data)
    for k, sheet in enumerate(e for e in root if local(e.tag) == "Worksheet"):
        r = 0
        for row in (e for e in sheet.iter() if local(e.tag) == "Row"):
            r = int(attribute(row, "Index", r + 1))
            c = 0
            for cell in (e for e in row if local(e.tag) == "Cell"):
                c = int(attribute(cell, "Index", c + 1))
                formula = attribute(cell, "Formula")
                d = next((e for e in cell if local(e.tag) == "Data"), None)
                if d is not None:
                    kind, raw = attribute(d, "Type", "String"), "".join(d.itertext())
                    v = float(raw) if kind == "Number" else raw == "1" if kind == "Boolean" else ERRORS.get(raw, Err(raw)) if kind == "Error" else raw
                    yield k, attribute(sheet, "Name", f"Sheet{k + 1}"), r, c, v, formula.lstrip("=") if formula else None
                c += int(attribute(cell, "MergeAcross", 0))


def read_gnumeric(data: bytes) -> Iterator[Row]:
    root = ET.fromstring(gzip.decompress(data))
    for k, sheet in enumerate(e for e in root.iter() if local(e.tag) == "Sheet"):
        title = next((e.text for e in sheet if local(e.tag) == "Name"), f"Sheet{k + 1}")
        for cell in (e for e in sheet.iter() if local(e.tag) == "Cell"):
            raw, kind = cell.text or "", cell.attrib.get("ValueType")
            formula = raw[1:] if raw.startswith("=") else None
            v = None if formula else float(raw) if kind in ("30", "40") else raw.upper() == "TRUE" if kind == "20" else ERRORS.get(raw, Err(raw)) if kind == "50" else raw
            yield k, title, int(cell.attrib["Row"]) + 1, int(cell.attrib["Col"]) + 1, v, formula


def read_html(data: bytes) -> Iterator[Row]:
    """Every table of a page as a sheet; spans leave their other places blank."""
    page = decode(data)
    page = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "", page)
    sheet, r, c, held, where = -1, 0, 0, None, []
    taken: set[tuple[int, int]] = set()
    for m in re.finditer(r"(?s)<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|([^<]+)", page):
        closing, name = bool(m[1]), (m[2] or "").lower()
        if m[4] is not None or name == "br":
            if held is not None:
                held.append(m[4] or " ")
            continue
        done = name in ("td", "th", "tr", "table") and held is not None
        if done:
            shown = " ".join(html_.unescape("".join(held)).split())
            if shown:
                yield sheet, f"Table{sheet + 1}", r, where[-1], typed(shown), None
            held = None
        if closing:
            continue
        if name == "table":
            sheet, r, c, taken = sheet + 1, 0, 0, set()
        elif name == "tr" and sheet >= 0:
            r, c = r + 1, 0
        elif name in ("td", "th") and sheet >= 0:
            c += 1
            while (r, c) in taken:
                c += 1
            span = lambda key: int((re.search(rf"(?i){key}\s*=\s*[\"']?(\d+)", m[3]) or [0, 1])[1])  # noqa: B023, E731
            across, down = span("colspan"), span("rowspan")
            taken |= {(r + i, c + j) for i in range(down) for j in range(across)}
            where.append(c)
            held = []
            c += across - 1


def read_text(data: bytes) -> Iterator[Row]:
    lines = decode(data).splitlines()
    delimiter = infer_delimiter(lines)
    if lines and re.fullmatch(r"sep=.", lines[0], re.I):
        lines = lines[1:]
    r, held = 0, ""
    for line in lines:
        held = f"{held}\n{line}" if held else line
        if held.count('"') % 2:
            continue
        r += 1
        for c, f in enumerate(fields(held, delimiter)):
            v = typed(f)
            formula = v[1:] if isinstance(v, str) and v.startswith("=") and len(v) > 1 else None
            if v is not None:
                yield 0, "Sheet1", r, c + 1, None if formula else v, formula
        held = ""


READERS = {"xlsx": read_xlsx, "xlsb": read_xlsb, "xls": read_xls, "ods": read_ods, "slk": read_slk, "xml2003": read_xml2003, "gnumeric": read_gnumeric, "html": read_html, "csv": read_text}


def read_bytes(data: bytes, name: str = "") -> Iterator[Row]:
    kind = sniff(data, name)
    if kind not in READERS:
        raise Unsupported(f"{kind} workbooks (or encrypted ones) are not read")
    return READERS[kind](data)


def record(path: str, row: Row) -> tuple:
    k, title, r, c, v, formula = row
    kind = "blank" if v is None else "bool" if isinstance(v, bool) else "num" if isinstance(v, float) else "err" if isinstance(v, Err) else "text"
    return path, k, title, r, c, kind, v if kind == "num" else None, v if kind == "text" else None, v if kind == "bool" else None, v.code if kind == "err" else None, formula


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of one or many workbooks of any readable format, in long form."""
    import pandas as pd

    names = [c.split()[0] for c in CELLS.split(", ")]

    def run(batches):
        for files in batches:
            for p, content in zip(files["path"], files["content"], strict=True):
                rows = []
                for row in read_bytes(bytes(content), p):
                    rows.append(record(p, row))
                    if len(rows) == 20_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, CELLS)


def read_any(spark: SparkSession, path: str, sheet: str | int = 0, header: bool = True) -> DataFrame:
    """A sheet as a table: delimited text by Spark's own reader, other formats from their cells. The first row names the
    columns; a column is double, boolean or text by what all its cells are."""
    head = bytes(spark.read.format("binaryFile").load(path).select(F.expr("substring(content, 1, 4096)")).first()[0])
    if head[:2] not in (b"PK", b"\x1f\x8b") and sniff(head, path) == "csv":
        from .text import read_csv

        return read_csv(spark, path, header=header)
    return table_of(read_cells(spark, path), sheet, header)


def table_of(cells: DataFrame, sheet: str | int = 0, header: bool = True) -> DataFrame:
    """Cells in long form as a table with _row; one aggregate per row, no driver loop over rows."""
    own = cells.filter(F.col("sheet_idx") == sheet if isinstance(sheet, int) else F.upper("sheet") == sheet.upper()).cache()
    shape = own.agg(F.min("row").alias("top"), F.max("col").alias("width")).first()
    if shape.top is None:
        return cells.sparkSession.createDataFrame([], "_row long")
    width = int(shape.width)
    names = {r.col: r.str or text(r.num if r.num is not None else "") for r in own.filter(F.col("row") == shape.top).collect()} if header else {}
    body = own.filter(F.col("row") > shape.top) if header else own
    kinds = {r.col: set(r.kinds) for r in body.groupBy("col").agg(F.collect_set("kind").alias("kinds")).collect()}  # as many rows as columns
    out, seen = [], set()
    for k in range(1, width + 1):
        name = names.get(k) or f"c{k}"
        while name.lower() in seen:
            name += "_2"
        seen.add(name.lower())
        found = kinds.get(k, set()) - {"blank"}
        here = F.col("col") == k
        if found == {"num"}:
            v = F.max(F.when(here, F.col("num")))
        elif found == {"bool"}:
            v = F.max(F.when(here, F.col("bool")))
        else:
            v = F.max(F.when(here, F.coalesce("str", F.col("num").cast("string"), F.upper(F.col("bool").cast("string")), "err")))
        out.append(v.alias(name))
    return body.groupBy(F.col("row").alias("_row")).agg(*out)


def load_workbook(data: bytes, name: str = "") -> Workbook:
    """A workbook in memory, with formulas and their cached values replaced by recalculation on reading."""
    book = Workbook()
    for _, title, r, c, v, formula in read_bytes(data, name):
        book.sheets.setdefault(title, {})
        if v is not None:
            book.sheets[title][r, c] = v
        if formula:
            book.formulas[title, r, c] = formula
    return book


# Writers.
def escaped(s: str) -> str:
    return html_.escape(s, quote=True)


def cell_xml(r: int, c: int, v, formula: str | None) -> str:
    at = f"{column_letters(c)}{r}"
    f = f"<f>{escaped(formula)}</f>" if formula else ""
    if v is None:
        return f'<c r="{at}">{f}</c>' if f else ""
    if isinstance(v, bool):
        return f'<c r="{at}" t="b">{f}<v>{int(v)}</v></c>'
    if isinstance(v, Err):
        return f'<c r="{at}" t="e">{f}<v>{escaped(v.code)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{at}">{f}<v>{v!r}</v></c>'
    if f:
        return f'<c r="{at}" t="str">{f}<v>{escaped(str(v))}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escaped(str(v))}</t></is></c>'


def xlsx_bytes(sheets: dict[str, Iterator[tuple[int, list[tuple[int, object, str | None]]]]]) -> bytes:
    """A package of sheets, each an iterator of (row number, [(column, value, formula)])."""
    buffer = io.BytesIO()
    types = '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    rels = listed = ""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (title, rows) in enumerate(sheets.items(), 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{ns}"><sheetData>'.encode())
                for r, cells in rows:
                    f.write(f'<row r="{r}">{"".join(cell_xml(r, c, v, x) for c, v, x in cells)}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
            types += f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
            rels += f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>'
            listed += f'<sheet name="{escaped(title)}" sheetId="{k}" r:id="rId{k}"/>'
        package = "http://schemas.openxmlformats.org/package/2006"
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships">{rels}</Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{ns}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
    return buffer.getvalue()


def plain(v):
    import datetime as dt
    from decimal import Decimal

    from ..functions.dates import to_serial

    if isinstance(v, (dt.datetime, dt.date)):
        s = to_serial(v.year, v.month, v.day)
        return s + (v.hour * 3600 + v.minute * 60 + v.second) / 86400 if isinstance(v, dt.datetime) else s
    return float(v) if isinstance(v, (int, Decimal)) and not isinstance(v, bool) else v


def write_xlsx(frames: dict[str, DataFrame], path: str) -> None:
    """Tables as the sheets of one local file; rows stream from Spark, a partition at a time."""

    def rows(df: DataFrame):
        yield 1, [(c + 1, n, None) for c, n in enumerate(df.columns)]
        for r, row in enumerate(df.toLocalIterator(), 2):
            yield r, [(c + 1, plain(v), None) for c, v in enumerate(row)]

    with open(path, "wb") as f:
        f.write(xlsx_bytes({n: rows(df) for n, df in frames.items()}))


def save_workbook(book: Workbook, path: str) -> None:
    """A workbook in memory, formulas with their computed values."""
    ev = Evaluator(book)

    def rows(title: str):
        keys = sorted({*book.sheets[title], *[(r, c) for s, r, c in book.formulas if s == title]})
        for r in dict.fromkeys(r for r, _ in keys):
            yield r, [(c, v if not hasattr(v := ev.value_at(title, r, c), "rows") else v.rows[0][0], book.formulas.get((title, r, c))) for q, c in keys if q == r]

    with open(path, "wb") as f:
        f.write(xlsx_bytes({t: rows(t) for t in book.sheets}))


def write_ods(frames: dict[str, DataFrame], path: str) -> None:
    """Tables as the sheets of one OpenDocument file, streamed."""

    def rows(df: DataFrame):
        yield 1, [(c + 1, n, None) for c, n in enumerate(df.columns)]
        for r, row in enumerate(df.toLocalIterator(), 2):
            yield r, [(c + 1, plain(v), None) for c, v in enumerate(row)]

    with open(path, "wb") as f:
        f.write(ods_bytes({n: rows(df) for n, df in frames.items()}))


def write_xls(frames: dict[str, DataFrame], path: str) -> None:
    """Tables as the sheets of one binary file; the format holds 65,536 rows by 256 columns."""

    def cells(df: DataFrame):
        yield from ((1, c + 1, n) for c, n in enumerate(df.columns))
        for r, row in enumerate(df.toLocalIterator(), 2):
            yield from ((r, c + 1, plain(v)) for c, v in enumerate(row))

    with open(path, "wb") as f:
        f.write(xls_bytes({n: cells(df) for n, df in frames.items()}))


def write_html(df: DataFrame, path: str, title: str = "Sheet1") -> None:
    """One table as a page, streamed."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escaped(title)}</title></head><body><table>")
        f.write("<tr>" + "".join(f"<th>{escaped(c)}</th>" for c in df.columns) + "</tr>")
        for row in df.toLocalIterator():
            f.write("<tr>" + "".join(f"<td>{escaped(text(plain(v)) if v is not None else '')}</td>" for v in row) + "</tr>")
        f.write("</table></body></html>")


assert Table
