"""Reading and writing of workbooks and text."""

import gzip

import pytest

from cellweave.functions.values import DIV0
from cellweave.plans.evaluator import Workbook
from cellweave.sources import datasource, text, workbooks


def test_delimiters_and_fields():
    assert text.infer_delimiter(["a;b;c", "1,5;2;3"]) == ";"
    assert text.infer_delimiter(["sep=|", "a|b"]) == "|"
    assert text.infer_delimiter(["a\tb", "1\t2"]) == "\t"
    assert text.fields('a,"b ""q"", c",d') == ["a", 'b "q", c', "d"]
    assert text.typed("true") is True and text.typed("5%") == 0.05 and text.typed("#DIV/0!") == DIV0 and text.typed(" x") == " x"


def test_xlsx_round_trip(spark, tmp_path):
    b = Workbook()
    for r, row in enumerate([("name", "n"), ("a & b", 1.5), ("c", 2.5)], 1):
        for c, v in enumerate(row, 1):
            b.set("One", r, c, v)
    b.set("One", 4, 2, "=SUM(B2:B3)")
    b.set("Two", 1, 1, True)
    path = str(tmp_path / "b.xlsx")
    workbooks.save_workbook(b, path)
    cells = {(r.sheet, r.row, r.col): (r.num, r.str, r.bool, r.formula) for r in workbooks.read_cells(spark, path).collect()}
    assert cells["One", 4, 2] == (4.0, None, None, "SUM(B2:B3)")
    assert cells["Two", 1, 1] == (None, None, True, None)
    table = workbooks.read_any(spark, path)
    assert table.columns == ["_row", "name", "n"]
    assert sorted(r.n for r in table.collect()) == [1.5, 2.5, 4.0]
    again = workbooks.load_workbook(open(path, "rb").read())
    assert again.formulas == {("One", 4, 2): "SUM(B2:B3)"}
    datasource.register(spark)
    assert spark.read.format("sheet").option("path", path).load().count() == 8


def test_write_frames(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    workbooks.write_xlsx({"T": df}, str(tmp_path / "t.xlsx"))
    assert sorted(r.i for r in workbooks.read_any(spark, str(tmp_path / "t.xlsx")).collect()) == [1.0, 2.0]
    workbooks.write_html(df, str(tmp_path / "t.html"))
    assert workbooks.read_any(spark, str(tmp_path / "t.html")).columns == ["_row", "i", "s"]
    text.write_csv(df, str(tmp_path / "c"), ";")
    back = text.read_csv(spark, str(tmp_path / "c"))
    assert dict(back.dtypes) == {"i": "double", "s": "string"}


def test_other_formats(spark, tmp_path):
    slk = b"ID;PWXL;N;E\nC;Y1;X1;K\"a\"\nC;Y1;X2;K5\nC;Y2;X1;KTRUE;EA1=1\nE\n"
    assert [r[2:5] for r in workbooks.read_bytes(slk)] == [(1, 1, "a"), (1, 2, 5.0), (2, 1, True)]
    xml = b'<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet ss:Name="S"><Table><Row ss:Index="2"><Cell ss:Index="3"><Data ss:Type="Number">4</Data></Cell></Row></Table></Worksheet></Workbook>'
    assert list(workbooks.read_bytes(xml)) == [(0, "S", 2, 3, 4.0, None)]
    gn = gzip.compress(b'<gnm:Workbook xmlns:gnm="http://www.gnumeric.org/v10.dtd"><gnm:Sheets><gnm:Sheet><gnm:Name>G</gnm:Name><gnm:Cells><gnm:Cell Row="0" Col="1" ValueType="40">2.5</gnm:Cell><gnm:Cell Row="1" Col="1">=B1*2</gnm:Cell></gnm:Cells></gnm:Sheet></gnm:Sheets></gnm:Workbook>')
    assert list(workbooks.read_bytes(gn)) == [(0, "G", 1, 2, 2.5, None), (0, "G", 2, 2, None, "B1*2")]
    page = b"<table><tr><th>a<th colspan=2>b</tr><tr><td>1</td><td>&lt;x&gt;</td></tr></table>"
    assert [r[2:5] for r in workbooks.read_bytes(page)] == [(1, 1, "a"), (1, 2, "b"), (2, 1, 1.0), (2, 2, "<x>")]


def test_binary_and_ods(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "x é"), (2.0, None)], "n double, s string")
    for name, write in (("t.xls", workbooks.write_xls), ("t.ods", workbooks.write_ods)):
        write({"T": df, "U": df.limit(1)}, str(tmp_path / name))
        rows = list(workbooks.read_bytes((tmp_path / name).read_bytes(), name))
        assert [r[1:5] for r in rows if r[0] == 0] == [("T", 1, 1, "n"), ("T", 1, 2, "s"), ("T", 2, 1, 1.5), ("T", 2, 2, "x é"), ("T", 3, 1, 2.0)]
        assert {r[1] for r in rows} == {"T", "U"}
    assert sorted(r.n for r in workbooks.read_any(spark, str(tmp_path / "t.xls")).collect()) == [1.5, 2.0]


def xlsb_file():
    import io
    import struct
    import zipfile

    def rec(kind, body):
        head = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
        return head + bytes([len(body)]) + body

    wide = lambda t: struct.pack("<I", len(t)) + t.encode("utf-16-le")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.bin", rec(156, struct.pack("<II", 0, 1) + wide("rId1") + wide("S")))
        z.writestr("xl/_rels/workbook.bin.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.bin"/></Relationships>')
        z.writestr("xl/sharedStrings.bin", rec(19, b"\0" + wide("hi")))
        cell = lambda c: struct.pack("<II", c, 0)
        body = rec(0, struct.pack("<I", 2) + b"\0" * 8) + rec(7, cell(0) + struct.pack("<I", 0)) + rec(5, cell(1) + struct.pack("<d", 2.5)) + rec(2, cell(2) + struct.pack("<I", 7 << 2 | 2)) + rec(4, cell(3) + b"\1") + rec(3, cell(4) + b"\x07")
        z.writestr("xl/worksheets/sheet1.bin", body)
    return buffer.getvalue()


def test_xlsb():
    rows = [r[2:5] for r in workbooks.read_bytes(xlsb_file())]
    assert rows == [(3, 1, "hi"), (3, 2, 2.5), (3, 3, 7.0), (3, 4, True), (3, 5, DIV0)]
