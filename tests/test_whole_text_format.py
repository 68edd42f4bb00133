"""TEXT over tables: a plain format is read once, not once a row, and gives what the general way gives."""

import random

from cellweave.functions import texts
from cellweave.plans.compiler import with_column

PLAIN = ("0", "00000", "#", "#,##0", "#,##0.00", "0.00", "#.00", "0,000.0", "#,#", "0%", "#,##0.0%")


def test_plain_formats_are_read_once(monkeypatch):
    seen = []
    plain = getattr(texts.sections, "__wrapped__", texts.sections)
    monkeypatch.setattr(texts, "sections", lambda code: seen.append(code) or plain(code))
    assert [texts.render(k * 1234.567, "#,##0.00") for k in range(4)] == ["0.00", "1,234.57", "2,469.13", "3,703.70"]
    assert texts.render(42.0, "00000") == "00042" and not seen


def test_plain_formats_as_in_general():
    r = random.Random(3)
    values = [0.0, -0.0, 0.005, 0.995, -0.004, -0.5, 2.5, 999.995, 9.99e14, 1e15, -1e18, 5e-324, None] + [r.uniform(-1, 1) * 10 ** r.randint(-5, 17) for _ in range(300)]
    for code in PLAIN:
        for v in values:
            x = v or 0.0
            assert texts.render(v, code) == texts.render_number(x, texts.sections(code)[0], "-" if x < 0 else ""), (v, code)


def test_rows_alike_in_a_batch(spark):
    rows = [(k, [1234.5, 0.0, -0.0, None, 1234.5, -7.25][k % 6]) for k in range(60)]
    out = with_column(spark.createDataFrame(rows, "k int, v double").coalesce(1), "t", '=TEXT([@v],"#,##0.0")')
    assert {(r.k % 6, r.t) for r in out.select("k", "t").collect()} == {(0, "1,234.5"), (1, "0.0"), (2, "0.0"), (3, "0.0"), (4, "1,234.5"), (5, "-7.3")}
