"""Workbooks (.xlsx, .xlsm, .ods) with the standard library: a zip of XML parts.  The binary .xls and .xlsb are refused."""

from __future__ import annotations

import datetime as dt
import posixpath
import re
import zipfile
from xml.etree import ElementTree as X

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..infer import unique_names
from ..storage import handed_out
from .base import Connector, ImportOptions, SourceError
from .rows import read_by_tasks, typed_frame

#: Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def serial_text(serial: float) -> str:
    """ISO text of a date serial; the day rolls over when seconds round up to midnight."""
    days, seconds = divmod(round(serial * 86400), 86400)
    day = dt.date(1899, 12, 30) + dt.timedelta(days=days)
    if not seconds:
        return day.isoformat()
    clock = f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    return f"{day.isoformat()} {clock}"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node, name: str):
    return [c for c in node if _local(c.tag) == name]


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _is_date_format(code: str) -> bool:
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    return bool(re.search(r"[ymdhs]", plain, re.IGNORECASE))


class Workbook:
    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(path)
        book = X.fromstring(self.zip.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in X.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = {}
        for s in book.iter():
            if _local(s.tag) == "sheet":
                target = links[next(v for k, v in s.attrib.items() if _local(k) == "id")]
                self.sheets[s.get("name")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        names = set(self.zip.namelist())
        self.strings = [_text(si) for si in X.fromstring(self.zip.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        self.dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = X.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter() if _local(f.tag) == "numFmt"}
            for group in _children(styles, "cellXfs"):
                for xf in group:
                    i = int(xf.get("numFmtId", 0))
                    self.dates.append(_is_date_format(own[i]) if i in own else i in DATE_FORMATS)

    def cells(self, sheet: str) -> list[list]:
        """The used range as rows of None, bool, float and str."""
        found: dict[tuple[int, int], object] = {}
        root = X.fromstring(self.zip.read(self.sheets[sheet]))
        r = 0
        for row in root.iter():
            if _local(row.tag) != "row":
                continue
            r = int(row.get("r", r + 1))
            c = 0
            for cell in row:
                ref = re.match(r"([A-Z]+)", cell.get("r", ""))
                if ref:
                    c = 0
                    for ch in ref[1]:
                        c = 26 * c + ord(ch) - 64
                else:
                    c += 1
                value = self.value(cell)
                if value is not None:
                    found[r, c] = value
        if not found:
            return []
        rows, cols = [k[0] for k in found], [k[1] for k in found]
        return [[found.get((i, j)) for j in range(min(cols), max(cols) + 1)] for i in range(min(rows), max(rows) + 1)]

    def value(self, cell):
        kind = cell.get("t", "n")
        raw = next((v.text for v in cell if _local(v.tag) == "v"), None)
        if kind == "inlineStr":
            return _text(cell).strip() or None
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(raw)].strip() or None
        if kind == "str":
            return raw.strip() or None
        if kind == "b":
            return raw == "1"
        number, style = float(raw), int(cell.get("s", 0))
        return serial_text(number) if style < len(self.dates) and self.dates[style] else number


class OpenDocument:
    """Sheets of an OpenDocument workbook."""

    def __init__(self, path: str):
        with zipfile.ZipFile(path) as z:
            root = X.fromstring(z.read("content.xml"))
        self.sheets = {self._own(t, "name"): t for t in root.iter() if _local(t.tag) == "table"}

    @staticmethod
    def _own(element, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in element.attrib.items() if _local(k) == name), default)

    def value(self, cell):
        kind = self._own(cell, "value-type")
        if kind in ("float", "percentage", "currency"):
            return float(self._own(cell, "value"))
        if kind == "boolean":
            return self._own(cell, "boolean-value") == "true"
        if kind == "date":
            return self._own(cell, "date-value").removesuffix("T00:00:00").replace("T", " ")
        return "\n".join("".join(p.itertext()) for p in cell if _local(p.tag) == "p").strip() or None if kind else None

    def cells(self, sheet: str) -> list[list]:
        """The used range as rows of None, bool, float and str; repeats beyond the last used cell are not laid out."""
        rows: list[list] = []
        empty = 0
        for row in self.sheets[sheet].iter():
            if _local(row.tag) != "table-row":
                continue
            values, gap = [], 0
            for cell in row:
                if _local(cell.tag) not in ("table-cell", "covered-table-cell"):
                    continue
                times, v = int(self._own(cell, "number-columns-repeated", "1")), self.value(cell)
                if v is None:
                    gap += times
                else:
                    values += [None] * gap + [v] * times
                    gap = 0
            times = int(self._own(row, "number-rows-repeated", "1"))
            if not values:
                empty += times
                continue
            rows += [[] for _ in range(empty if rows else 0)] + [list(values) for _ in range(times)]
            empty = 0
        first = min((next(i for i, v in enumerate(r) if v is not None) for r in rows if r), default=0)
        width = max(map(len, rows), default=0)
        return [(r + [None] * (width - len(r)))[first:] for r in rows]


class ExcelConnector(Connector):
    name = "excel"
    extensions = ("xlsx", "xlsm", "ods")

    def objects(self, spark: SparkSession, path: str) -> list[str]:
        return list(_opened(path).sheets)

    def load(self, spark: SparkSession, path: str, object: str | None = None, options: ImportOptions = ImportOptions()) -> DataFrame:
        sheets = self.objects(spark, path)
        sheet = object or sheets[0]
        if sheet not in sheets:
            raise SourceError(f"no sheet {sheet}")
        # a sheet is one task: its format bounds it, and it can only be read from its start
        raw, _ = read_by_tasks(spark, 1, _reader(handed_out(spark, path), sheet), "sheet")
        width = raw.agg(F.max(F.size("cells"))).first()[0] or 1
        first = options.header_row + options.skip_rows
        data = raw.where(F.col("number") >= first)
        if options.max_rows is not None:
            data = data.where(F.col("number") < first + options.max_rows)
        head = raw.where(F.col("number") == options.header_row - 1).select("cells").first()
        header = [_heading(c["k"], c["s"]) for c in head["cells"]] if head else []
        return typed_frame(data, unique_names([header[i] if i < len(header) else None for i in range(width)]), whole_reals=True)


def _opened(path: str) -> Workbook | OpenDocument:
    if path.lower().endswith(".ods"):
        return OpenDocument(path)
    if not path.lower().endswith((".xlsx", ".xlsm")):
        raise SourceError("only .xlsx, .xlsm and .ods workbooks can be read; save the file as .xlsx")
    return Workbook(path)


def _reader(file: str, sheet: str):
    def read(piece: int) -> list[list]:
        from pyspark import SparkFiles

        return _opened(SparkFiles.get(file)).cells(sheet)

    return read


def _heading(kind: int, text: str | None) -> str | None:
    return f"{float(text):g}" if kind == 2 else str(text == "true") if kind == 4 else text
