import json
import sys
import zipfile

import pytest

from statloom import infer
from statloom.operators import charts
from statloom.sources import cache, samples
from statloom.sources.base import ImportOptions, SourceError, default_registry
from statloom.sources.excel import serial_text
from statloom.sources.export import to_csv, to_html
from statloom.sources.jdbc import candidates_pg, display_pg, jdbc_url, split_pg
from statloom.sources.plugin import discover
from statloom.studio import Studio
from statloom.types import column_type, widen


def test_names_and_types():
    assert infer.unique_names(["a", "", "a"]) == ["a", "column_2", "a_2"]
    assert len(set(infer.unique_names(["a", "a", "a_2"]))) == 3
    assert infer.cell_types([["1", "2.5", "x"], ["2", "", "y"]], 3) == ["integer", "real", "text"]
    assert infer.parse_cell("1,234") == 1234 and infer.parse_cell("1d") == "1d" and infer.parse_cell(" ") is None
    assert (widen("boolean", "integer"), widen("boolean", "real"), widen("integer", "real"), widen("text", "integer"), column_type([])) == ("integer", "real", "real", "text", "text")
    assert infer.dataset_name("a b-é") == "a_b_é" and infer.dataset_name("  ") == "dataset"


def load(spark, path, text, **kw):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return default_registry().for_path(str(path)).load(spark, str(path), None, ImportOptions(**kw))


def test_csv(spark, tmp_path):
    df = load(spark, tmp_path / "a.csv", "a,b,c\n1,2.5,x\n2,,y\n")
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")] and [tuple(r) for r in df.collect()] == [(1, 2.5, "x"), (2, None, "y")]
    assert [tuple(r) for r in load(spark, tmp_path / "b.csv", "junk\nx,y\n1,2\n", header_row=2).collect()] == [(1, 2)]
    assert load(spark, tmp_path / "c.tsv", "x\ty\n1\t2\n").columns == ["x", "y"]
    assert load(spark, tmp_path / "d.csv", "x,y\n" + "1,2\n" * 100, max_rows=7).count() == 7
    jp = load(spark, tmp_path / "e.csv", "名前,値\n太郎,3\n".encode("shift_jis"))
    assert jp.columns == ["名前", "値"] and tuple(jp.first()) == ("太郎", 3)
    ragged = load(spark, tmp_path / "f.csv", "a,b\n1\n2,3,4\n")
    assert ragged.columns == ["a", "b", "column_3"] and [tuple(r) for r in ragged.collect()] == [(1, None, None), (2, 3, 4)]
    odd = load(spark, tmp_path / "g.csv", "i\n" + "".join(f"{i}\n" if i != 2400 else "N/A\n" for i in range(2500)))
    assert odd.dtypes == [("i", "bigint"), ("i_raw", "string")] and odd.where("i is null").count() == 1
    assert load(spark, tmp_path / "h.csv", "1,2\n3,4\n", header_row=0).columns == ["column_1", "column_2"]


def test_excel(spark, tmp_path):
    assert [serial_text(x) for x in (45658, 25569, 45658.5)] == ["2025-01-01", "1970-01-01", "2025-01-01 12:00:00"]
    path = tmp_path / "w.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>day</t></is></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2" t="str"><v> x </v></c><c r="C2" s="1"><v>45658</v></c></row><row r="3"><c r="A3"><v>2</v></c><c r="C3" t="e"><v>#N/A</v></c></row></sheetData></worksheet>')
    c = default_registry().for_path(str(path))
    assert c.objects(spark, str(path)) == ["S"]
    assert [tuple(r) for r in c.load(spark, str(path)).collect()] == [(1, "x", "2025-01-01"), (2, None, None)]
    with pytest.raises(SourceError):
        c.load(spark, "x.xls")


def test_open_document(spark, tmp_path):
    path = tmp_path / "w.ods"
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    text = lambda t: f'<table:table-cell office:value-type="string"><text:p>{t}</text:p></table:table-cell>'
    number = lambda v: f'<table:table-cell office:value-type="float" office:value="{v}"/>'
    rows = [f"<table:table-row>{text('id')}{text('v')}{text('day')}</table:table-row>", f'<table:table-row table:number-rows-repeated="2">{number(1)}{number(2.5)}<table:table-cell office:value-type="date" office:date-value="2025-01-01"/></table:table-row>']
    rows += [f'<table:table-row>{number(3)}<table:table-cell/></table:table-row>', '<table:table-row table:number-rows-repeated="1048000"><table:table-cell table:number-columns-repeated="1024"/></table:table-row>']
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("content.xml", f'<office:document-content {ns}><office:body><office:spreadsheet><table:table table:name="S">{"".join(rows)}</table:table></office:spreadsheet></office:body></office:document-content>')
    c = default_registry().for_path(str(path))
    assert c.objects(spark, str(path)) == ["S"]
    df = c.load(spark, str(path))
    assert df.columns == ["id", "v", "day"] and [tuple(r) for r in df.collect()] == [(1, 2.5, "2025-01-01")] * 2 + [(3, None, None)]


def test_names_of_databases():
    assert display_pg("public", "sales") == "sales" and display_pg("fab", "Events") == 'fab."Events"'
    assert split_pg('a."b.c"') == ["a", "b.c"] and candidates_pg("fab.events") == ['"fab"."events"', '"fab.events"']
    assert jdbc_url("postgres://u:p%40@h/db", "postgresql", 5432) == ("jdbc:postgresql://h:5432/db", {"user": "u", "password": "p@"})
    assert default_registry().for_path("MYSQL://h/d").name == "mysql"
    with pytest.raises(SourceError):
        default_registry().for_path("a.unknown")


def test_plugin(spark, tmp_path):
    d = tmp_path / "p" / "one"
    d.mkdir(parents=True)
    (d / "plugin.json").write_text(json.dumps({"api_version": 1, "kind": "connector", "name": "one", "extensions": ["one"], "command": [sys.executable, "main.py"]}))
    (d / "main.py").write_text("import json,sys\nr=json.loads(sys.stdin.readline())\nprint(json.dumps({'result': {'columns':[{'name':'id','type':'integer'},{'name':'v'}],'rows':[[1,True],[2,2.5],[3],[4,None,9]]} if r['method']=='load' else ['t']}))\n")
    bad = tmp_path / "p" / "two"
    bad.mkdir()
    (bad / "plugin.json").write_text('{"api_version": 2}')
    found, warnings = discover(str(tmp_path / "p"))
    assert [c.name for c in found] == ["one"] and len(warnings) == 1
    assert [tuple(r) for r in found[0].load(spark, "x.one", None, ImportOptions(max_rows=3)).collect()] == [(1, 1.0), (2, 2.5), (3, None)]


def test_studio(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("STATLOOM_CACHE_DIR", str(tmp_path / "cache"))
    paths = samples.write_samples(str(tmp_path / "s"))
    studio = Studio(spark)
    studio.load(paths["sales"])
    studio.load(paths["fab"], object="measurements")
    assert studio.objects(paths["fab"]) == ["measurements", "tools"]
    assert cache.read(spark, paths["sales"], None, ImportOptions()) is not None
    q = studio.query('select "region", sum(units) as u from sales group by region;', limit=3)
    assert q.truncated and len(q.rows) == 3 and studio.query("select 1 as a").rows == [(1,)]
    assert studio.chart("sales", {"type": "line", "x": "date", "y": "units", "agg": "sum"}).count() == 90
    assert studio.spc("measurements", "lot_id", "yield").count() == 200
    assert studio.tool_difference("measurements", "tool_id", "yield")["significant"]
    assert studio.lot_trace("LOT_ID", "LOT0001")[1] == 1
    made = studio.yield_preset("measurements")
    assert studio.get_charts() == made and [studio.chart(c["source"], c["spec"]).count() > 0 for c in made] == [True, True]
    assert studio.regression_points("measurements", ["step"], "yield").columns == ["step", "yield", "fitted"]
    assert studio.cluster_points("measurements", ["yield", "defects"], studio.cluster("measurements", ["yield", "defects"])).count() == 200
    saved = studio.save(str(tmp_path / "p"))
    studio.register("derived", spark.range(3))
    other = Studio(spark)
    assert other.open(saved) == [] and set(other.datasets) == {"sales", "measurements"}
    with open(paths["sales"], "a") as f:
        f.write("2026-03-30,North,Basic,1,1\n")
    assert cache.read(spark, paths["sales"], None, ImportOptions()) is None
    assert to_csv(studio.frame("select 'a,b' as x, null as y"), str(tmp_path / "o.csv")) == 1
    assert (tmp_path / "o.csv").read_text(encoding="utf-8") == '﻿x,y\n"a,b",\n' and "<td>a</td>" in to_html(studio.frame("select 'a' as x"))


def test_charts(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 10, 10)], "v double")
    h = charts.histogram(df, "v", 10)
    assert {r["bin"]: r["n"] for r in h.collect()} == {0: 1, 1: 1, 5: 1, 9: 2}
    assert charts.full_bins(h, 10).agg({"n": "sum"}).first()[0] == 5
    assert charts.nice_ticks(0, 10) == [0, 2, 4, 6, 8, 10]
    assert charts.capped_bars(spark.createDataFrame([(i % 70, float(i)) for i in range(2100)], "x int, y double"))[0].count() == 60 * 20
    marks, notes = charts.capped_series(spark.createDataFrame([(i, f"s{i:02d}", 1.0) for i in range(12)], "x int, series string, y double"))
    assert marks.count() == 8 and notes
    assert [c["spec"]["type"] for c in charts.yield_charts("d", "lot", "yield", "tool")] == ["line", "spc"]
    assert charts.guess_yield_columns(["lot_id", "tool", "yield"]) == {"x": "lot_id", "y": "yield", "series": "tool"}
