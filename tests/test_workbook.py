"""Cells of several types in one column of a workbook, and headings that are no texts."""

import zipfile

from statloom.sources import rows
from statloom.sources.base import ImportOptions, default_registry


def test_mixed_columns(spark, tmp_path):
    path = tmp_path / "m.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    number = lambda at, v: f'<c r="{at}"><v>{v}</v></c>'
    text = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    flag = lambda at, v: f'<c r="{at}" t="b"><v>{v}</v></c>'
    body = [text("A1", "note") + text("B1", "skipped"), number("A2", 2024) + text("B2", "mix") + text("C2", "ok"), number("A3", 1) + text("B3", "x") + flag("C3", 1), number("A4", 2) + number("B4", 2.5) + flag("C4", 0), number("A5", 3) + number("B5", 4)]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{i}">{r}</row>' for i, r in enumerate(body, 1)) + "</sheetData></worksheet>")
    connector = default_registry().for_path(str(path))
    df = connector.load(spark, str(path), None, ImportOptions(header_row=2))
    assert df.dtypes == [("2024", "bigint"), ("mix", "string"), ("mix_cell", "variant"), ("ok", "boolean")]
    got = df.collect()
    assert [(r[0], r[1], r[3]) for r in got] == [(1, "x", True), (2, "2.5", False), (3, "4", None)]
    assert [r[2].toPython() for r in got] == ["x", 2.5, 4.0]
    assert connector.load(spark, str(path), "S", ImportOptions(header_row=2, max_rows=1)).count() == 1


def test_many_pieces(spark):
    """Rows of unequal length from many tasks, with every kind of cell."""
    given = {p: [[p, p / 2, None, f"t{p}"][: 1 + (p + i) % 4] for i in range(5000)] for p in range(3)}
    raw, n = rows.read_by_tasks(spark, 3, lambda p: iter(given[p]), "pieces")
    assert n == 15_000
    df = rows.typed_frame(raw.where("number < 4000"), ["i", "r", "none", "t", "absent"], whole_reals=True)
    assert df.dtypes == [("i", "bigint"), ("r", "double"), ("none", "string"), ("t", "string"), ("absent", "string")]
    want = [(*r, *[None] * (5 - len(r))) for p in given.values() for r in p[:4000]]
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)
