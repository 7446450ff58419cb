"""Spreadsheet workbooks (XLSX), read with the standard library: cells, merged ranges, styles."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.sources.readers import reader

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# The built-in number formats that are dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


@dataclass
class Sheet:
    name: str
    rows: list[list[object]] = field(default_factory=list)
    bold: set[tuple[int, int]] = field(default_factory=set)
    formulas: set[tuple[int, int]] = field(default_factory=set)
    shaded: set[tuple[int, int]] = field(default_factory=set)
    merged: list[tuple[int, int, int, int]] = field(default_factory=list)

    @property
    def width(self) -> int:
        return max(map(len, self.rows), default=0)


def column_number(letters: str) -> int:
    """A is 0, Z 25, AA 26."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(number: int) -> str:
    out = ""
    number += 1
    while number:
        number, r = divmod(number - 1, 26)
        out = chr(65 + r) + out
    return out


def cell_place(reference: str) -> tuple[int, int]:
    """(row, column) from 0 of a reference such as B7."""
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", reference)
    if not m:
        raise ValueError(f"not a cell: {reference}")
    return int(m[2]) - 1, column_number(m[1])


def cell_range(text: str) -> tuple[int, int, int, int]:
    """(first row, first column, last row, last column) from 0 of a range such as A1:C9."""
    a, _, b = text.partition(":")
    r0, c0 = cell_place(a)
    r1, c1 = cell_place(b or a)
    return min(r0, r1), min(c0, c1), max(r0, r1), max(c0, c1)


def expand_columns(text: str) -> list[str]:
    """The letters of column ranges: "A:C,F" is A, B, C, F."""
    out: list[str] = []
    for part in text.split(","):
        a, _, b = part.strip().partition(":")
        out += [column_letters(n) for n in range(column_number(a), column_number(b or a) + 1)]
    return out


def _styles(z: zipfile.ZipFile) -> tuple[set[int], set[int], set[int]]:
    """Style numbers that are dates, bold, or shaded."""
    if "xl/styles.xml" not in z.namelist():
        return set(), set(), set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
    fonts = [f.find(f"{_MAIN}b") is not None for f in root.iterfind(f"{_MAIN}fonts/{_MAIN}font")]
    fills = [(p := f.find(f"{_MAIN}patternFill")) is not None and p.get("patternType") not in (None, "none", "gray125") for f in root.iterfind(f"{_MAIN}fills/{_MAIN}fill")]
    dates, bold, shaded = set(), set(), set()
    for n, x in enumerate(root.iterfind(f"{_MAIN}cellXfs/{_MAIN}xf")):
        fmt = int(x.get("numFmtId", 0))
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(fmt, ""))
        if fmt in DATE_FORMATS or fmt in own and re.search(r"[ymdhs]", code, re.I):
            dates.add(n)
        if (k := int(x.get("fontId", 0))) < len(fonts) and fonts[k]:
            bold.add(n)
        if (k := int(x.get("fillId", 0))) < len(fills) and fills[k]:
            shaded.add(n)
    return dates, bold, shaded


def _text(e: ElementTree.Element | None) -> str:
    return "" if e is None else "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))


def _value(c: ElementTree.Element, shared: list[str], dates: set[int], base: dt.datetime) -> object:
    kind, v = c.get("t"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _text(c.find(f"{_MAIN}is")) or None
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)] or None
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e"):
        return v.text if kind == "str" else None
    if kind == "d":
        return dt.datetime.fromisoformat(v.text)
    x = float(v.text)
    if int(c.get("s", 0)) in dates:
        return base + dt.timedelta(microseconds=round(x * 86_400_000_000))
    return int(x) if x.is_integer() and "." not in v.text and "E" not in v.text.upper() else x


_TABLE, _OFFICE, _P = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}", "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}", "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}p"


def _open_value(c: ElementTree.Element) -> object:
    """The value of a cell of an open-document sheet."""
    kind = c.get(f"{_OFFICE}value-type")
    if kind in ("float", "percentage", "currency"):
        x = float(c.get(f"{_OFFICE}value"))
        return int(x) if x.is_integer() else x
    if kind == "date":
        return dt.datetime.fromisoformat(c.get(f"{_OFFICE}date-value"))
    if kind == "boolean":
        return c.get(f"{_OFFICE}boolean-value") == "true"
    return "\n".join("".join(p.itertext()) for p in c.iter(_P)) or None


def _open_document(z: zipfile.ZipFile, fill_merged: bool) -> list[Sheet]:
    """The sheets of an open document. Repeated rows and cells at the end of a sheet, which stand for nothing, are
    left out; spans are filled with their first cell's value."""
    out = []
    for table in ElementTree.fromstring(z.read("content.xml")).iter(f"{_TABLE}table"):
        sheet, spans, empty = Sheet(table.get(f"{_TABLE}name")), [], 0
        for row in table.iter(f"{_TABLE}table-row"):
            cells: list[object] = []
            for c in row:
                if c.tag not in (f"{_TABLE}table-cell", f"{_TABLE}covered-table-cell"):
                    continue
                value, many = _open_value(c), int(c.get(f"{_TABLE}number-columns-repeated", 1))
                wide, high = int(c.get(f"{_TABLE}number-columns-spanned", 1)), int(c.get(f"{_TABLE}number-rows-spanned", 1))
                if wide * high > 1:
                    spans.append((len(sheet.rows) + empty, sum(x.n if isinstance(x, _Gap) else 1 for x in cells), high, wide, value))
                if value is None:
                    cells.append(_Gap(many))
                else:
                    cells += [value] * many
            while cells and isinstance(cells[-1], _Gap):
                cells.pop()
            flat = [v for x in cells for v in ([None] * x.n if isinstance(x, _Gap) else [x])]
            many = int(row.get(f"{_TABLE}number-rows-repeated", 1))
            if not flat:
                empty += many
                continue
            sheet.rows += [[] for _ in range(empty)] + [list(flat) for _ in range(many)]
            empty = 0
        for r, c, high, wide, value in spans:
            sheet.merged.append((r, c, r + high - 1, c + wide - 1))
            for y in range(r, r + high if fill_merged else r):
                while len(sheet.rows) <= y:
                    sheet.rows.append([])
                sheet.rows[y] += [None] * (c + wide - len(sheet.rows[y]))
                sheet.rows[y][c : c + wide] = [value] * wide
        sheet.rows = [r + [None] * (sheet.width - len(r)) for r in sheet.rows]
        out.append(sheet)
    return out


@dataclass
class _Gap:
    n: int


def workbook(data: bytes | str, fill_merged: bool = True) -> list[Sheet]:
    """All sheets of a workbook (XLSX or ODS); merged ranges are filled with their first cell's value."""
    with zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data) as z:
        if "content.xml" in z.namelist():
            return _open_document(z, fill_merged)
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind(f"{_MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        dates, bold, shaded = _styles(z)
        pr = book.find(f"{_MAIN}workbookPr")
        base = dt.datetime(1904, 1, 1) if pr is not None and pr.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        out = []
        for s in book.iterfind(f"{_MAIN}sheets/{_MAIN}sheet"):
            target = rels[s.get(f"{_REL}id")]
            root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            sheet = Sheet(s.get("name"))
            for n, row in enumerate(root.iter(f"{_MAIN}row")):
                at = int(row.get("r", n + 1)) - 1
                while len(sheet.rows) <= at:
                    sheet.rows.append([])
                cells = sheet.rows[at]
                for k, c in enumerate(row.iterfind(f"{_MAIN}c")):
                    col = cell_place(c.get("r"))[1] if c.get("r") else k
                    cells += [None] * (col + 1 - len(cells))
                    cells[col] = _value(c, shared, dates, base)
                    style = int(c.get("s", 0))
                    for flag, where in ((style in bold, sheet.bold), (style in shaded, sheet.shaded), (c.find(f"{_MAIN}f") is not None, sheet.formulas)):
                        if flag:
                            where.add((at, col))
            for m in root.iter(f"{_MAIN}mergeCell"):
                r0, c0, r1, c1 = cell_range(m.get("ref"))
                sheet.merged.append((r0, c0, r1, c1))
                if fill_merged and r0 < len(sheet.rows) and c0 < len(sheet.rows[r0]):
                    for r in range(r0, r1 + 1):
                        while len(sheet.rows) <= r:
                            sheet.rows.append([])
                        sheet.rows[r] += [None] * (c1 + 1 - len(sheet.rows[r]))
                        for c in range(c0, c1 + 1):
                            sheet.rows[r][c] = sheet.rows[r0][c0]
            while sheet.rows and all(v is None for v in sheet.rows[-1]):
                sheet.rows.pop()
            width = max((n + 1 for r in sheet.rows for n, v in enumerate(r) if v is not None), default=0)
            sheet.rows = [(r + [None] * width)[:width] for r in sheet.rows]
            out.append(sheet)
    return out


def _cell_text(v: object) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v).lower()
    return v.isoformat(" ") if isinstance(v, dt.datetime) else str(v)


def grid(spark: SparkSession, sheet: Sheet) -> DataFrame:
    """A sheet as text columns A, B, … in the order of its rows."""
    cols = [column_letters(n) for n in range(sheet.width)] or ["A"]
    rows = [(n, *map(_cell_text, r)) for n, r in enumerate(sheet.rows)]
    return spark.createDataFrame(rows, "__ord bigint, " + ", ".join(f"{c} string" for c in cols))


@reader("XLSX", "XLSM", "ODS")
def read_xlsx(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    """All cells of workbooks: ``file_name, sheet, row_no, cells``; a workbook is one task's work."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s in workbook(content):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(s.rows), pa.string()), pa.array([s.name] * len(s.rows), pa.string()), pa.array(range(len(s.rows)), pa.int32()), pa.array([list(map(_cell_text, r)) for r in s.rows], pa.list_(pa.string()))], names=["file_name", "sheet", "row_no", "cells"])

    files = spark.read.format("binaryFile").load(paths).select(F.col("path"), F.col("content"))
    return files.mapInArrow(cells, "file_name string, sheet string, row_no int, cells array<string>")


def snapshot(sheet: Sheet, head: int = 25, tail: int = 5) -> str:
    """A short text view of a sheet: first and last rows, with marks for bold, formula and shaded cells."""
    lines = [f"# {sheet.name}: {len(sheet.rows)} rows x {sheet.width} columns"]
    picked = [*range(min(head, len(sheet.rows))), *range(max(head, len(sheet.rows) - tail), len(sheet.rows))]
    last = -1
    for r in picked:
        if r != last + 1:
            lines.append("...")
        last = r
        shown = []
        for c, v in enumerate(sheet.rows[r]):
            if v is not None:
                marks = "".join(m for m, where in (("*", sheet.bold), ("=", sheet.formulas), ("#", sheet.shaded)) if (r, c) in where)
                shown.append(f"{column_letters(c)}{r + 1}{marks}: {_cell_text(v)}")
        lines.append(" | ".join(shown))
    return "\n".join(lines)
