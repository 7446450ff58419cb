"""Sheets with headers, pivots and forms, made into plain tables by declared steps.

What a sheet means is decided by two functions that the user supplies: one that finds the tables of a
workbook, one that maps a table's regions. Without them every sheet is one flat table under its first row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.operators import columns as C, filters, rows as R
from weftline.registry import transform
from weftline.semantics import ORD, col, ordered, plain, visible
from weftline.sources import sheets

PATTERNS = ("flat_list", "cross_tab", "transposed_grid", "form")


@dataclass(frozen=True)
class Cell:
    """A column of a table: its place, the name found and the name it should have."""

    column: str
    detected_name: str | None = None
    semantic_name: str | None = None
    data_type: str = "string"


@dataclass(frozen=True)
class Table:
    """A table of a workbook: sheet, range (A1:C9), header rows counted from the range's top."""

    sheet: str
    range: str
    name: str = "table"
    header_rows: int = 1


@dataclass(frozen=True)
class Region:
    """How a table is laid out: anchors identify a row; pivots are columns whose names are values."""

    pattern: str = "flat_list"
    anchors: tuple[Cell, ...] = ()
    pivots: tuple[Cell, ...] = ()
    values: tuple[Cell, ...] = ()
    pivot_name: str = "variable"
    value_name: str = "value"
    value_type: str = "string"
    fields: tuple[tuple[str, str, str], ...] = ()  # of a form: name, cell, type
    drop_keywords: tuple[str, ...] = ()
    data_rows: tuple[int, int] | None = None


@dataclass
class Report:
    status: str = "ok"
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def slug(name: str) -> str:
    text = unicodedata.normalize("NFKD", name.strip().lower())
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", "".join(c for c in text if not unicodedata.combining(c)))).strip("_") or "table"


def compile_region(region: Region, header_rows: int = 1, first_column: str = "A") -> list[tuple[str, dict]]:
    """The steps that make a plain table of a region.

    ``first_column`` is where the table starts in its sheet: columns are known by their letters as well as by their
    names, so a name that the mapping gives otherwise than the header rows do still finds its column.
    """
    if region.pattern not in PATTERNS:
        raise ValueError(f"unknown pattern {region.pattern}")
    if region.pattern == "form":
        return [("form", {"fields": region.fields})]
    steps: list[tuple[str, dict]] = []
    if region.pattern == "transposed_grid":
        steps.append(("transpose_grid", {}))
    elif header_rows > 1:
        steps.append(("flatten_header", {"start": 0, "end": header_rows - 1}))
    elif header_rows == 1:
        steps.append(("promote_header", {"row_index": 0}))
    if region.pattern != "transposed_grid" and header_rows:
        letters = [(c.column, c.detected_name) for c in region.anchors + region.pivots + region.values if c.column and c.detected_name]
        steps.append(("align_names", {"cells": letters, "first_column": first_column}))
    steps.append(("drop_empty_rows", {"threshold": 0.8}))
    if region.data_rows:
        first, last = region.data_rows
        steps.append(("clip_rows", {"start": first, "stop": last}))
    named = region.anchors + region.values
    if region.pattern == "cross_tab":
        ids = [c.detected_name for c in region.anchors]
        pivots = [c.detected_name for c in region.pivots]
        if ids:
            steps.append(("fill_forward", {"columns": ids}))
        steps.append(("melt", {"id_columns": ids, "value_columns": pivots or None, "var_name": region.pivot_name, "value_name": region.value_name}))
        steps.append(("cast_types", {"types": {region.value_name: region.value_type}}))
    elif named:
        steps.append(("select_known", {"columns": [c.detected_name for c in named]}))
    renames = {c.detected_name: c.semantic_name for c in named if c.semantic_name and c.detected_name != c.semantic_name}
    if renames:
        steps.append(("rename_columns", {"mapping": renames}))
    kinds = {c.semantic_name or c.detected_name: c.data_type for c in named if c.data_type != "string"}
    if kinds:
        steps.append(("cast_types", {"types": kinds}))
    if region.drop_keywords and region.anchors:
        a = region.anchors[0]
        steps.append(("filter_by_keyword", {"column": a.semantic_name or a.detected_name, "keywords": list(region.drop_keywords)}))
    steps.append(("clean_text", {}))
    return steps


def _form(df: DataFrame, fields: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """One row of the named cells of a sheet."""
    df = ordered(df)
    picks = []
    for name, cell, kind in fields:
        r, c = sheets.cell_place(cell)
        letter = sheets.column_letters(c)
        value = F.max(F.when(F.col(ORD) == r, col(letter))) if letter in df.columns else F.lit(None).cast("string")
        picks.append(value.alias(name))
    return C.cast_types(df.agg(*picks), {n: k for n, _, k in fields if k != "string"})


def align_names(df: DataFrame, cells: list[tuple[str, str]], first_column: str = "A") -> DataFrame:
    """Gives columns the names that a mapping knows them by, where no column has that name: by their letters in the
    sheet, of which the table's first one is ``first_column``. Columns whose names are mapped are left alone."""
    own, start = visible(df), sheets.column_number(first_column)
    wanted = {name for _, name in cells}
    renames = {}
    for letter, name in cells:
        at = sheets.column_number(letter) - start
        if name not in own and 0 <= at < len(own) and own[at] not in wanted and own[at] not in renames:
            renames[own[at]] = name
    return C.rename_columns(df, renames)


STEPS: dict[str, Callable[..., DataFrame]] = {
    "align_names": align_names,
    "promote_header": C.promote_header,
    "flatten_header": C.flatten_header,
    "drop_empty_rows": R.drop_empty_rows,
    "drop_trailing_rows": R.drop_trailing_rows,
    "clip_rows": lambda df, start, stop: R.slice_rows(df, start, stop),
    "transpose_grid": C.transpose_grid,
    "transpose_table": C.transpose_table,
    "fill_forward": lambda df, columns: C.fill_forward(df, columns),
    "melt": lambda df, id_columns, value_columns, var_name, value_name: C.melt(df, C.known(df, id_columns), C.known(df, value_columns) if value_columns else None, var_name, value_name),
    "select_known": lambda df, columns: C.select_columns(df, C.known(df, columns) or visible(df)),
    "rename_columns": C.rename_columns,
    "add_constant": lambda df, name, value: df.withColumn(name, F.lit(value)),
    "replace_values": C.replace_values,
    "cast_types": C.cast_types,
    "filter_by_keyword": lambda df, column, keywords: filters.filter_by_keyword(df, column, keywords) if column in df.columns else df,
    "clean_text": lambda df, columns=None, **k: C.clean_text(df, columns or visible(df), **k),
    "form": _form,
}


def execute_steps(df: DataFrame, steps: list[tuple[str, dict]]) -> tuple[DataFrame, Report]:
    """The table after all steps, and what went wrong; an empty result has status retry."""
    report = Report()
    for name, args in steps:
        if name not in STEPS:
            report.errors.append(f"unknown step {name}")
            continue
        try:
            df = STEPS[name](df, **args)
        except (ValueError, TypeError) as e:
            report.errors.append(f"{name}: {e}")
    own = visible(df)
    filled = df.agg(F.count("*").alias("n"), *[F.count(col(c)).alias(f"c{k}") for k, c in enumerate(own)]).first()
    if not filled["n"]:
        report.status = "retry"
        report.errors.append("the result is empty")
    report.warnings += [f"column {c} is empty" for k, c in enumerate(own) if filled["n"] and not filled[f"c{k}"]]
    report.warnings += [f"column {c} has no name" for c in own if re.fullmatch(r"(__col_\d+__|col_\d+)", c)]
    if report.errors and report.status == "ok":
        report.status = "error"
    return df, report


def extract(sheet: sheets.Sheet, where: str | None) -> sheets.Sheet:
    """The part of a sheet in a range; the whole sheet for None."""
    if not where:
        return sheet
    r0, c0, r1, c1 = sheets.cell_range(where)
    return sheets.Sheet(sheet.name, [(r + [None] * (c1 + 1))[c0 : c1 + 1] for r in sheet.rows[r0 : r1 + 1]])


@transform("tidy_excel_data", output="DICT", path_excel="STRING")
def tidy_excel_data(
    path_excel: str,
    find_tables: Callable[[str], list[Table]] | None = None,
    map_table: Callable[[Table, str, str | None], Region] | None = None,
    retries: int = 3,
    spark: SparkSession | None = None,
) -> dict[str, DataFrame]:
    """The tables of a workbook, by slug of their name (again ``_2``, ``_3`` …).

    ``find_tables`` gets a text view of the sheets; ``map_table`` a table, its view and the errors of the last
    try, up to ``retries`` times. A table that still fails comes out as it was read.
    """
    spark = spark or SparkSession.active()
    own = {s.name: s for s in sheets.workbook(path_excel.removeprefix("file://"))}
    filled = [s for s in own.values() if s.rows]
    tables = find_tables("\n\n".join(map(sheets.snapshot, filled))) if find_tables else [Table(s.name, f"A1:{sheets.column_letters(max(0, s.width - 1))}{len(s.rows)}", s.name) for s in filled]
    out: dict[str, DataFrame] = {}
    for t in tables:
        part = extract(own[t.sheet], t.range)
        first = sheets.column_letters(sheets.cell_range(t.range)[1]) if t.range else "A"
        base, trouble = sheets.grid(spark, part), None
        df = base
        for _ in range(max(1, retries) if map_table else 1):
            region = map_table(t, sheets.snapshot(part), trouble) if map_table else Region()
            try:
                df, report = execute_steps(base, compile_region(region, t.header_rows, first))
            except ValueError as e:
                report = Report("error", [str(e)])
            if report.status == "ok":
                break
            trouble = "; ".join(report.errors)
        key = name = slug(t.name)
        n = 1
        while key in out:
            n += 1
            key = f"{name}_{n}"
        out[key] = plain(df)
    return out
