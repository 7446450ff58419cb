"""Queries on sources, sinks, types, descriptions and pipelines: the driver tables go out in a format and come
back through the readers. All files lie below the shared folder."""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from io import BytesIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions.ordered import with_order
from weftline.functions.storage import put, shared_folder
from weftline.semantics import plain

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def t(s: SparkSession, folder: str, name: str) -> DataFrame:
    return s.read.parquet(f"{folder}/{name}.parquet")


def place(s: SparkSession) -> str:
    return f"{shared_folder(s).rstrip('/')}/files-{uuid.uuid4().hex}"


def local(path: str) -> str:
    return path.removeprefix("file://").replace("file:/", "/")


def lines(s: SparkSession, texts: DataFrame, before: list[str], path: str) -> str:
    """One text file: some lines first, then the column ``value`` in the order of ``n``."""
    first = s.createDataFrame([(k - len(before), x) for k, x in enumerate(before)], "n bigint, value string")
    first.unionByName(texts.select(F.col("n").cast("bigint").alias("n"), "value")).repartition(1).sortWithinPartitions("n").select("value").write.text(path)
    return path


# --- delimited text ------------------------------------------------------------------------------------------


_ORDERS = ["o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate"]


def _read(s, d, path, kind="CSV", **options):  # noqa: ANN001, ANN202
    from weftline.profile import infer_types
    from weftline.sources import readers

    return infer_types(readers.read(s, path, kind, **options))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate FROM orders")
def s_csv(s, d):
    path = place(s)
    t(s, d, "orders").select(*_ORDERS).write.option("header", True).option("sep", ";").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return _read(s, d, path, fieldSeparator=";", header="true")


@query("SELECT doc_id, nullif(source, '') AS source, source || ', \"' || lang || '\"' || chr(10) || 'x' AS note FROM documents")
def s_csv_quoted(s, d):
    path = place(s)
    docs = t(s, d, "documents").select("doc_id", "source", F.concat("source", F.lit(', "'), "lang", F.lit('"\nx')).alias("note"))
    docs.write.option("header", True).option("escape", '"').csv(path)
    return _read(s, d, path, fieldSeparator=",", header="true")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s_csv_preamble(s, d):
    rows = t(s, d, "supplier").select(F.col("s_suppkey").alias("n"), F.concat_ws("|", "s_suppkey", "s_name", "s_acctbal").alias("value"))
    path = lines(s, rows, ["Suppliers", "as they are", "s_suppkey|s_name|s_acctbal"], place(s))
    file = next(f for f in s.read.text(path).inputFiles())
    return _read(s, d, file)


@query("SELECT c_custkey, c_mktsegment FROM customer")
def s_tsv(s, d):
    path = place(s)
    t(s, d, "customer").select("c_custkey", "c_mktsegment").write.option("header", True).option("sep", "\t").csv(path)
    return _read(s, d, path, "TSV", fieldSeparator="\t")


_WAYS = {"commas": (",", []), "semicolons": (";", []), "tabs": ("\t", []), "bars": ("|", []), "preamble": (";", ["A list of nations", "made today"])}


def _dialects(s: SparkSession, d: str) -> dict[str, str]:
    """The nations as a file in each way of writing."""
    out = {}
    for way, (sep, before) in _WAYS.items():
        rows = t(s, d, "nation").select(F.col("n_nationkey").alias("n"), F.concat_ws(sep, "n_nationkey", "n_name", "n_regionkey").alias("value"))
        path = lines(s, rows, [*before, sep.join(["key", "name", "region"])], place(s))
        out[way] = s.read.text(path).inputFiles()[0]
    return out


@query("SELECT * FROM (VALUES ('commas', ',', true, 0), ('semicolons', ';', true, 0), ('tabs', chr(9), true, 0), ('bars', '|', true, 0), ('preamble', ';', true, 2)) AS x(way, separator, header, skip)")
def s_characterize(s, d):
    from weftline.sources import dialect

    found = [(w, c.separator, c.header, c.skip_lines) for w, p in _dialects(s, d).items() for c in [dialect.characterize(p)]]
    return s.createDataFrame(found, "way string, separator string, header boolean, skip int")


@query("SELECT * FROM (VALUES ('commas', ','), ('semicolons', ';'), ('tabs', chr(9)), ('bars', '|')) AS x(way, separator)")
def s_sniff(s, d):
    from weftline.sources import dialect

    return s.createDataFrame([(w, dialect.sniff(p).get("fieldSeparator")) for w, p in _dialects(s, d).items() if w != "preamble"], "way string, separator string")


@query("SELECT * FROM (VALUES ('commas', 0, ','), ('semicolons', 0, ';'), ('tabs', 0, chr(9)), ('bars', 0, '|'), ('preamble', 2, ';')) AS x(way, skip, separator)")
def s_preamble(s, d):
    from weftline.sources import dialect

    return s.createDataFrame([(w, *dialect.preamble(dialect.head(p)[0])) for w, p in _dialects(s, d).items()], "way string, skip int, separator string")


@query("SELECT * FROM (VALUES ('commas', ','), ('semicolons', ';'), ('tabs', chr(9)), ('bars', '|'), ('preamble', NULL)) AS x(way, separator)")
def s_best_separator(s, d):
    from weftline.sources import dialect

    return s.createDataFrame([(w, dialect.best_separator(dialect.head(p)[0])) for w, p in _dialects(s, d).items()], "way string, separator string")


@query("SELECT * FROM (VALUES ('commas', true, false), ('semicolons', false, true), ('tabs', false, false), ('bars', false, false), ('preamble', false, true)) AS x(way, commas, semicolons)")
def s_consistent(s, d):
    from weftline.sources import dialect

    heads = {w: dialect.head(p)[0] for w, p in _dialects(s, d).items()}
    return s.createDataFrame([(w, dialect.consistent(h, ","), dialect.consistent(h, ";")) for w, h in heads.items()], "way string, commas boolean, semicolons boolean")


@query("SELECT s_suppkey, s_name FROM supplier")
def s_delegate(s, d):
    """An odd separator that only the delegate knows."""
    from weftline.sources import dialect

    rows = t(s, d, "supplier").select(F.col("s_suppkey").alias("n"), F.concat_ws("~", "s_suppkey", "s_name").alias("value"))
    file = s.read.text(lines(s, rows, ["s_suppkey~s_name"], place(s))).inputFiles()[0]
    dialect.set_dialect_delegate(lambda head: {"fieldSeparator": "~", "header": True})
    try:
        return _read(s, d, file)
    finally:
        dialect.set_dialect_delegate(None)


# --- other formats ---------------------------------------------------------------------------------------------


@query("SELECT r_regionkey::BIGINT AS key, r_name AS name_text FROM region")
def s_json(s, d):
    """One document of all regions, nested, back as a table."""
    from weftline.operators import jsons
    from weftline.sources import readers

    path = place(s)
    each = F.struct(F.col("r_regionkey").alias("key"), F.struct(F.col("r_name").alias("text")).alias("name"))
    t(s, d, "region").agg(F.to_json(F.collect_list(each)).alias("value")).coalesce(1).write.text(path)
    return jsons.flatten_json(readers.read(s, path, "JSON"))


def _columnar(kind: str, read_as: str, sql: str):  # noqa: ANN202
    def run(s, d):  # noqa: ANN001, ANN202
        from weftline.sources import readers

        path = place(s)
        c = t(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
        w = c.write.format(kind)
        (w.option("rowTag", "row") if kind == "xml" else w).save(path)
        options = {"format": kind} if read_as in ("ORC", "PARQUET") else {}
        return readers.read(s, path, read_as, **options).select("c_custkey", "c_name", "c_acctbal")

    run.__name__ = f"s_{kind}" if kind != "json" else "s_jsonl"
    query(sql)(run)


for _kind, _as in (("orc", "ORC"), ("json", "JSONL"), ("xml", "XML")):
    _columnar(_kind, _as, "SELECT c_custkey, c_name, c_acctbal FROM customer")


@query("SELECT n_name AS value FROM nation")
def s_text(s, d):
    from weftline.sources import readers

    path = place(s)
    t(s, d, "nation").select("n_name").write.text(path)
    return readers.read(s, path, "TEXT")


def workbook(sheets: dict[str, list[list[object]]], merged: dict[str, list[str]] | None = None) -> bytes:
    """A workbook of plain cells."""
    from weftline.sources.sheets import column_letters

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    escape = lambda v: str(v).replace("&", "&amp;").replace("<", "&lt;")

    def cell(r: int, c: int, v: object) -> str:
        at = f"{column_letters(c)}{r + 1}"
        return f'<c r="{at}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, (name, rows) in enumerate(sheets.items(), 1):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
            ranges = (merged or {}).get(name, [])
            tail = f"<mergeCells>{''.join(f'<mergeCell ref=\"{m}\"/>' for m in ranges)}</mergeCells>" if ranges else ""
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {space}><sheetData>{body}</sheetData>{tail}</worksheet>")
    return out.getvalue()


def _nations(s: SparkSession, d: str) -> list[list[object]]:
    return [[r.n_nationkey, r.n_name, r.n_regionkey] for r in t(s, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows, a sheet


@query("SELECT 'Nations' AS sheet, (n_nationkey + 1)::INTEGER AS row_no, n_name AS name FROM nation UNION ALL SELECT 'Nations', 0, 'name'")
def s_excel(s, d):
    from weftline.sources import readers

    path = put(place(s) + ".xlsx", workbook({"Nations": [["key", "name", "region"], *_nations(s, d)]}))
    return readers.read(s, path, "XLSX").select("sheet", "row_no", F.col("cells")[1].alias("name"))


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def x_flat_sheet(s, d):
    """A sheet under its first row as a table, without any mapping."""
    from weftline.operators import tidy

    path = put(place(s) + ".xlsx", workbook({"Nations": [["key", "name", "region"], *_nations(s, d)]}))
    return tidy.tidy_excel_data(local(path), spark=s)["nations"]


@query("SELECT n_nationkey::BIGINT AS key, n_name AS nation FROM nation")
def x_aligned(s, d):
    """A table in the middle of a sheet whose mapping names a column otherwise than its header does."""
    from weftline.operators import tidy

    grid = [[], [None, "Nation key (no.)", "name"], *[[None, k, n] for k, n, _ in _nations(s, d)]]
    path = put(place(s) + ".xlsx", workbook({"S": grid}))
    region = tidy.Region(anchors=(tidy.Cell("B", "nation key", "key", "int"), tidy.Cell("C", "name", "nation")))
    return tidy.tidy_excel_data(local(path), lambda view: [tidy.Table("S", f"B2:C{len(grid)}", "t")], lambda *_: region, spark=s)["t"]


@query("SELECT 'Nations' AS sheet, (n_nationkey + 2)::INTEGER AS row_no, n_name AS name, CASE WHEN n_nationkey < 2 THEN 'first' END AS span FROM nation UNION ALL SELECT 'Nations', 0, 'name', NULL UNION ALL SELECT 'Nations', 1, NULL, NULL")
def s_ods(s, d):
    """A sheet of an open document, with an empty row and a span of two rows."""
    from weftline.sources import readers

    space = " ".join(f'xmlns:{n}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for n in ("office", "table", "text"))
    text = lambda v, more="": f'<table:table-cell office:value-type="string"{more}><text:p>{v}</text:p></table:table-cell>'
    span = {0: text("first", ' table:number-rows-spanned="2"'), 1: "<table:covered-table-cell/>"}
    rows = "".join(f'<table:table-row><table:table-cell office:value-type="float" office:value="{k}"/>{text(n)}{span.get(k, "")}</table:table-row>' for k, n, _ in _nations(s, d))
    tail = '<table:table-row table:number-rows-repeated="1000000"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'
    body = f'<table:table table:name="Nations"><table:table-row>{text("key")}{text("name")}</table:table-row><table:table-row/>{rows}{tail}</table:table>'
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f"<office:document-content {space}><office:body><office:spreadsheet>{body}</office:spreadsheet></office:body></office:document-content>")
    return readers.read(s, put(place(s) + ".ods", out.getvalue()), "ODS").select("sheet", "row_no", F.col("cells")[1].alias("name"), F.col("cells")[2].alias("span"))


def _cross(s: SparkSession, d: str) -> list[list[object]]:
    """Nations down, regions across, 1 where a nation is of a region, above two rows of heads."""
    rows = _nations(s, d)
    regions = sorted({r[2] for r in rows})
    head = [[None, "by", *["region"] * len(regions)], ["id", "nation", *[f"r{x}" for x in regions]]]
    return head + [[k, n, *[1 if r == x else 0 for x in regions]] for k, n, r in rows]


@query("SELECT n_nationkey::BIGINT AS nation_id, 'region r' || x AS region, (n_regionkey = x)::INT::DOUBLE AS inside FROM nation, (SELECT DISTINCT n_regionkey AS x FROM nation)")
def x_cross_tab(s, d):
    """Two header rows flattened, columns turned into rows, types cast: a region's mapping compiled and run."""
    from weftline.operators import tidy

    grid = _cross(s, d)
    path = put(place(s) + ".xlsx", workbook({"T": grid}))
    pivots = tuple(tidy.Cell("C", f"region {h}") for h in grid[1][2:])
    region = tidy.Region("cross_tab", anchors=(tidy.Cell("A", "id", "nation_id", "int"), tidy.Cell("B", "by nation")), pivots=pivots, pivot_name="region", value_name="inside", value_type="float")
    where = f"A1:{chr(64 + len(grid[0]))}{len(grid)}"
    got = tidy.tidy_excel_data(local(path), lambda view: [tidy.Table("T", where, "t", 2)], lambda table, view, trouble: region, spark=s)["t"]
    return got.select("nation_id", "region", "inside")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_nationkey BETWEEN 3 AND 7")
def x_offset_table(s, d):
    """A table that starts in the middle of a sheet."""
    from weftline.operators import tidy

    rows = _nations(s, d)[3:8]
    grid = [["a note"], [], [None, None, "id", "name"], *[[None, None, k, n] for k, n, _ in rows]]
    path = put(place(s) + ".xlsx", workbook({"S": grid}))
    region = tidy.Region(anchors=(tidy.Cell("C", "id", None, "int"), tidy.Cell("D", "name")))
    return tidy.tidy_excel_data(local(path), lambda view: [tidy.Table("S", f"C3:D{3 + len(rows)}", "t")], lambda *_: region, spark=s)["t"]


@query("SELECT n_name AS first_name, n_nationkey::BIGINT AS first_key, NULL::VARCHAR AS missing FROM nation WHERE n_nationkey = 0")
def x_form(s, d):
    from weftline.operators import tidy
    from weftline.sources import sheets

    book = sheets.workbook(workbook({"F": [["key", "name"], *[r[:2] for r in _nations(s, d)]]}))
    steps = tidy.compile_region(tidy.Region("form", fields=(("first_name", "B2", "string"), ("first_key", "A2", "int"), ("missing", "Z9", "string"))))
    return tidy.execute_steps(sheets.grid(s, book[0]), steps)[0]


@query("SELECT n_regionkey AS region, list(n_name ORDER BY n_nationkey)[1] AS name FROM nation GROUP BY 1")
def x_merged(s, d):
    """Merged cells filled with their value."""
    from weftline.sources import sheets

    rows = sorted(_nations(s, d), key=lambda r: (r[2], r[0]))
    first = {r[2]: n for n, r in reversed(list(enumerate(rows)))}
    last = {r[2]: n for n, r in enumerate(rows)}
    grid = [[r[1] if first[r[2]] == n else None, r[2]] for n, r in enumerate(rows)]
    book = sheets.workbook(workbook({"M": grid}, {"M": [f"A{first[k] + 1}:A{last[k] + 1}" for k in first]}))
    return s.createDataFrame([(r[1], r[0]) for r in book[0].rows], "region int, name string").distinct()


@query("SELECT * FROM (VALUES ('A:C,F', 'A B C F'), ('Y:AB', 'Y Z AA AB'), ('Total  2023 (€)', 'total_2023'), ('B7:A3', '2 0 6 1')) AS x(text, got)")
def x_ranges(s, d):
    from weftline.operators import tidy
    from weftline.sources import sheets

    got = [(x, " ".join(sheets.expand_columns(x))) for x in ("A:C,F", "Y:AB")] + [("Total  2023 (€)", tidy.slug("Total  2023 (€)")), ("B7:A3", " ".join(map(str, sheets.cell_range("B7:A3"))))]
    return s.createDataFrame(got, "text string, got string")


@query("SELECT count(*) + 1 AS rows, 3 AS columns, true AS has_cell FROM nation")
def x_snapshot(s, d):
    """The text view of a sheet names its size and its first cells."""
    from weftline.sources import sheets

    sheet = sheets.workbook(workbook({"N": [["key", "name", "region"], *_nations(s, d)]}))[0]
    text = sheets.snapshot(sheet)
    rows, cols = text.splitlines()[0].split(": ")[1].split(" x ")
    return s.createDataFrame([(int(rows.split()[0]), int(cols.split()[0]), "B1: name" in text)], "rows bigint, columns int, has_cell boolean")


def png(pixels: np.ndarray) -> bytes:
    """A picture of grey or colour bytes (height x width, perhaps x 3)."""
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _picture(s: SparkSession, d: str) -> DataFrame:
    """The nations as a row of colours: red the key times ten, green the region's key, blue nothing."""
    from weftline.sources import readers

    rows = _nations(s, d)
    pixels = np.array([[[k * 10, r, 0] for k, _, r in rows]], np.uint8)
    return readers.read(s, put(place(s) + ".png", png(pixels)), "IMAGE")


@query("SELECT n_nationkey::INT AS x, 0 AS y, c AS channel, (CASE c WHEN 'r' THEN n_nationkey * 10 WHEN 'g' THEN n_regionkey WHEN 'b' THEN 0 ELSE 255 END)::INT AS value FROM nation, (VALUES ('r'), ('g'), ('b'), ('a')) AS v(c)")
def i_pixels(s, d):
    from weftline.operators import images

    return images.image_to_dataframe(_picture(s, d), "rgba")


@query("SELECT n_nationkey::INT AS x, 0 AS y, 'r' AS channel, (n_nationkey * 10)::INT AS value FROM nation")
def i_channel(s, d):
    from weftline.operators import images

    return images.extract_channel(_picture(s, d), "red")


@query("SELECT count(*)::INT AS width, 1 AS height, 3 AS channels, 'PNG' AS format, 'RGB' AS mode FROM nation")
def i_metadata(s, d):
    from weftline.operators import images

    return images.image_metadata(_picture(s, d))


def edf(values: np.ndarray, label: str = "keys", rate: int = 1) -> bytes:
    head = lambda *xs: "".join(str(x).ljust(n)[:n] for x, n in xs).encode()
    top = head(("0", 8), ("p", 80), ("r", 80), ("01.01.24", 8), ("00.00.00", 8), (512, 8), ("", 44), (len(values) // rate, 8), (1, 8), (1, 4))
    channel = head((label, 16), ("", 80), ("uV", 8), (-100, 8), (100, 8), (-1000, 8), (1000, 8), ("", 80), (rate, 8), ("", 32))
    return top + channel + values.astype("<i2").tobytes()


def _signal(s: SparkSession, d: str) -> str:
    return put(place(s) + ".edf", edf(np.array([r[0] * 10 for r in _nations(s, d)])))


@query("SELECT 'keys' AS channel, n_nationkey::BIGINT AS sample_idx, n_nationkey::DOUBLE AS t, n_nationkey::DOUBLE AS value FROM nation")
def s_edf(s, d):
    from weftline.sources import readers

    return readers.read(s, _signal(s, d), "EDF").select("channel", "sample_idx", "t", F.round("value", 6).alias("value"))


def _fields(s: SparkSession, stats: dict) -> DataFrame:
    rows = [(stats["rows"], f["name"], f["type"], None if f["min"] is None else float(f["min"]), None if f["max"] is None else float(f["max"]), f["distinct"]) for f in stats["fields"]]
    return s.createDataFrame(rows, "rows bigint, name string, type string, low double, high double, distinct_values bigint")


@query("SELECT count(*) AS rows, 'keys' AS name, 'FLOAT' AS type, -100.0::DOUBLE AS low, 100.0::DOUBLE AS high, -1::BIGINT AS distinct_values FROM nation")
def q_edf(s, d):
    from weftline import describe_files

    return _fields(s, describe_files.describe_edf(_signal(s, d)))


@query("""WITH n AS (SELECT count(*) AS n FROM nation) SELECT n AS rows, 'position_x' AS name, 'FLOAT' AS type, 0.0::DOUBLE AS low, (n - 1)::DOUBLE AS high, n AS distinct_values FROM n
  UNION ALL SELECT n, 'position_y', 'FLOAT', 0.0, 0.0, 1 FROM n UNION ALL SELECT n, 'color_value', 'FLOAT', 0.0, 255.0, -1 FROM n""")
def q_image(s, d):
    from weftline import describe_files

    return _fields(s, describe_files.describe_image(s, put(place(s) + ".png", png(np.zeros((1, len(_nations(s, d))))))))


@query("""SELECT * FROM (VALUES (24::BIGINT, 'position_x', 'FLOAT', 0.0::DOUBLE, 3.0::DOUBLE, 4::BIGINT), (24, 'position_y', 'FLOAT', 0.0, 2.0, 3), (24, 'position_z', 'FLOAT', 0.0, 2.5, 2), (24, 'color_value', 'FLOAT', NULL, NULL, -1)) AS x(rows, name, type, low, high, distinct_values)""")
def q_mhd(s, d):
    from weftline import describe_files

    return _fields(s, describe_files.describe_mhd(put(place(s) + ".mhd", b"NDims = 3\nDimSize = 4 3 2\nElementSpacing = 1 1 2.5\n")))


@query("""SELECT * FROM (VALUES (30::BIGINT, 'position_x', 'FLOAT', 0.0::DOUBLE, 5.0::DOUBLE, 6::BIGINT), (30, 'position_y', 'FLOAT', 0.0, 4.0, 5), (30, 'color_value', 'FLOAT', NULL, NULL, -1)) AS x(rows, name, type, low, high, distinct_values)""")
def q_dicom(s, d):
    from weftline import describe_files

    us = lambda a, b, x: bytes([a, 0, b, 0]) + b"US\x02\x00" + x.to_bytes(2, "little")
    return _fields(s, describe_files.describe_dicom(put(place(s) + ".dcm", b"\0" * 128 + b"DICM" + us(0x28, 0x10, 5) + us(0x28, 0x11, 6))))


@query("SELECT count(*) AS rows, 'key' AS name, 'INTEGER' AS type, min(r_regionkey)::DOUBLE AS low, max(r_regionkey)::DOUBLE AS high, count(DISTINCT r_regionkey) AS distinct_values FROM region UNION ALL SELECT count(*), 'name_text', 'STRING', NULL, NULL, count(DISTINCT r_name) FROM region")
def q_json(s, d):
    from weftline import describe_files

    doc = [{"key": r.r_regionkey, "name_text": r.r_name} for r in t(s, d, "region").collect()]  # 5 rows, one document
    return _fields(s, describe_files.describe_json(s, put(place(s) + ".json", json.dumps(doc).encode())))


# --- types ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice AS price, o_custkey AS cust, nullif(o_custkey, 7) AS holes FROM orders")
def d_numbers(s, d):
    """Text that holds whole and real numbers, with several spellings of nothing."""
    from weftline.profile import infer_types

    o = t(s, d, "orders")
    hole = F.when(F.col("o_custkey") == 7, F.element_at(F.array(*map(F.lit, ["n/a", "None", " ", "#NA"])), (F.col("o_orderkey") % 4 + 1).cast("int"))).otherwise(F.col("o_custkey").cast("string"))
    return infer_types(o.select("o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.concat(F.lit(" "), "o_custkey").alias("cust"), hole.alias("holes")))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate) AS iso, date_trunc('day', o_orderdate) AS compact, date_trunc('day', o_orderdate) AS us, date_trunc('day', o_orderdate) AS eu FROM orders")
def d_dates(s, d):
    from weftline.profile import infer_types

    o = t(s, d, "orders")
    forms = {"iso": "yyyy-MM-dd", "compact": "yyyyMMdd", "us": "MM/dd/yyyy", "eu": "dd/MM/yyyy"}
    return infer_types(o.select("o_orderkey", *[F.date_format("o_orderdate", f).alias(n) for n, f in forms.items()]))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS yes_no, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 3 = 0 END AS truth, (o_orderkey % 2)::BIGINT AS digits FROM orders")
def d_booleans(s, d):
    from weftline.profile import infer_types

    k = F.col("o_orderkey")
    return infer_types(t(s, d, "orders").select("o_orderkey", F.when(k % 2 == 0, "Yes").otherwise("no").alias("yes_no"), F.when(k % 7 != 0, (k % 3 == 0).cast("string")).alias("truth"), (k % 2).cast("string").alias("digits")))


@query("SELECT o_orderkey, o_orderdate AS event_time, o_orderdate AS timestamp, epoch(o_orderdate)::BIGINT AS figure FROM orders WHERE o_orderdate >= TIMESTAMP '2001-09-10'  UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL 20 YEAR, o_orderdate + INTERVAL 20 YEAR, epoch(o_orderdate + INTERVAL 20 YEAR)::BIGINT FROM orders WHERE o_orderdate < TIMESTAMP '2001-09-10'")
def d_epochs(s, d):
    """Seconds and milliseconds become times by the name of their column."""
    from weftline.profile import infer_types

    o = t(s, d, "orders")
    late = F.col("o_orderdate") >= F.lit("2001-09-10").cast("timestamp_ntz")
    at = F.when(late, F.col("o_orderdate")).otherwise(F.col("o_orderdate") + F.make_ym_interval(years=F.lit(20)))
    seconds = F.unix_seconds(at.cast("timestamp"))
    return infer_types(o.select("o_orderkey", seconds.alias("event_time"), (seconds * 1000).alias("timestamp"), seconds.alias("figure")))


@query("SELECT doc_id, CASE WHEN lower(trim(text)) NOT IN ('none', 'nan', 'null', 'n/a', 'na', '#n/a', '#na', '#value!', 'missing', 'undefined', '<na>', '') THEN text END AS text, lang FROM documents")
def d_texts(s, d):
    """Free text stays as it is but for the spellings of nothing."""
    from weftline.profile import infer_types

    return infer_types(t(s, d, "documents").select("doc_id", "text", "lang"))


# --- descriptions ----------------------------------------------------------------------------------------------------


def _described(table: str, columns: dict[str, str]) -> str:
    ns = "(epoch_us({c}) * 1000)::DOUBLE"
    bounds = {"STRING": ("NULL", "NULL")}
    parts = []
    for c, kind in columns.items():
        f = ns.format(c="{f}(" + c + ")") if kind == "DATETIME" else "{f}(" + c + ")::DOUBLE"
        low, high = bounds.get(kind) or (f.format(f="min"), f.format(f="max"))
        parts.append(f"SELECT count(*) AS rows, '{c}' AS name, '{kind}' AS type, {low}::DOUBLE AS low, {high}::DOUBLE AS high, count(DISTINCT {c}) AS distinct_values FROM {table}")
    return "\nUNION ALL\n".join(parts)


_ORDER_KINDS = {"o_orderkey": "INTEGER", "o_custkey": "INTEGER", "o_orderstatus": "STRING", "o_totalprice": "FLOAT", "o_orderdate": "DATETIME", "o_orderpriority": "STRING"}


@query(_described("orders", _ORDER_KINDS))
def q_describe(s, d):
    from weftline.profile import describe

    return _fields(s, describe(t(s, d, "orders")))


@query(_described("customer", {"c_custkey": "INTEGER", "c_acctbal": "FLOAT", "c_mktsegment": "STRING"}))
def q_file_stats(s, d):
    """Several files described as one table."""
    from weftline.describe_files import file_stats

    path = place(s)
    t(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").repartition(3).write.option("header", True).csv(path)
    return _fields(s, file_stats(s, sorted(s.read.text(path).inputFiles())))


@query("SELECT count(*) AS rows, 'o_orderstatus' AS name, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS listed FROM orders")
def q_listed(s, d):
    """Values are listed where they are few."""
    from weftline.profile import describe

    got = describe(t(s, d, "orders").select("o_orderstatus"))
    return s.createDataFrame([(got["rows"], f["name"], ",".join(f["uniques"])) for f in got["fields"]], "rows bigint, name string, listed string")


@query("SELECT 'late' AS name, '2' AS id, count(*) AS rows, 3 AS fields, 4.0::DOUBLE AS last_part FROM region")
def q_store(s, d):
    """Entries of the catalogue put in, replaced by id, removed, and given a partition field."""
    import tempfile

    from weftline.profile import Catalogue, describe

    c = Catalogue(f"{tempfile.mkdtemp()}/catalogue_stats.json")  # the catalogue is a file of the driver, as the pipeline's XML
    got = describe(t(s, d, "region"))
    c.store("early", got, "2")
    c.store("late", got, "2")
    c.store("gone", got, "3")
    c.remove("gone")
    c.add_partition_field("late", 5)
    return s.createDataFrame([(n, x["id"], x["rows"], len(x["fields"]), x["fields"][-1]["max"]) for n, x in c.read().items()], "name string, id string, rows bigint, fields int, last_part double")


@query("SELECT 'region.r_regionkey: INTEGER' AS line UNION ALL SELECT 'region.r_name: STRING' UNION ALL SELECT '## region (' || count(*) || ' rows)' FROM region")
def q_render(s, d):
    from weftline.profile import describe, render

    stats = {"region": describe(t(s, d, "region"))}
    return s.createDataFrame([(x,) for x in [*render(stats, "list").splitlines(), render(stats).splitlines()[0]]], "line string")


# --- cells of sheets -----------------------------------------------------------------------------------------------------


def _parts(s, d):  # noqa: ANN001, ANN202
    return with_order(t(s, d, "part"), "p_partkey")


@query("SELECT p_partkey, p_brand AS brand, 'x' AS fixed FROM part")
def c_lenient(s, d):
    """Unknown columns are passed over."""
    from weftline.operators import columns, tidy

    steps = [("select_known", {"columns": ["p_partkey", "p_brand", "nothing"]}), ("rename_columns", {"mapping": {"p_brand": "brand", "gone": "y"}}), ("add_constant", {"name": "fixed", "value": "x"})]
    return columns.select_columns(tidy.execute_steps(t(s, d, "part"), steps)[0], ["p_partkey", "brand", "fixed"])


@query("SELECT * FROM (SELECT p_partkey, p_size, p_retailprice FROM part) UNPIVOT INCLUDE NULLS (v FOR k IN (p_size, p_retailprice))")
def c_unpivot(s, d):
    from weftline.operators import tidy

    base = t(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return tidy.execute_steps(base, [("melt", {"id_columns": ["p_partkey"], "value_columns": ["p_size", "p_retailprice", "none"], "var_name": "k", "value_name": "v"})])[0]


@query("SELECT max(r_name) FILTER (r_regionkey = 0) AS \"0\", max(r_name) FILTER (r_regionkey = 1) AS \"1\", max(r_name) FILTER (r_regionkey = 2) AS \"2\", max(r_name) FILTER (r_regionkey = 3) AS \"3\", max(r_name) FILTER (r_regionkey = 4) AS \"4\" FROM region UNION ALL SELECT '0', '1', '2', '3', '4'")
def c_transpose_table(s, d):
    from weftline.operators import columns

    return columns.transpose_table(with_order(t(s, d, "region"), "r_regionkey"))


@query("PIVOT (SELECT n_nationkey, k AS trait, v FROM (SELECT n_nationkey, n_regionkey::BIGINT AS region, n_nationkey::BIGINT AS own FROM nation) UNPIVOT (v FOR k IN (region, own))) ON n_nationkey USING max(v) GROUP BY trait")
def c_transpose_grid(s, d):
    from weftline.operators import columns

    n = t(s, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("bigint").alias("region"), F.col("n_nationkey").cast("bigint").alias("own"))
    return columns.transpose_grid(with_order(n, "n_nationkey"), "trait")


def _grid(s: SparkSession, d: str, heads: list[list[str | None]]) -> DataFrame:
    rows = t(s, d, "supplier").select(F.col("s_suppkey").alias("__ord"), F.col("s_suppkey").cast("string").alias("A"), F.col("s_name").alias("B"))
    top = s.createDataFrame([(k - len(heads), *h) for k, h in enumerate(heads)], "__ord bigint, A string, B string")
    return top.unionByName(rows)


@query("SELECT s_suppkey::VARCHAR AS key, s_name AS key_1 FROM supplier")
def c_promote_header(s, d):
    from weftline.operators import columns

    return plain(columns.promote_header(_grid(s, d, [["a note", None], ["key", "key"]]), 1))


@query("SELECT s_suppkey::VARCHAR AS \"supplier key\", s_name AS \"supplier full name\" FROM supplier")
def c_flatten_header(s, d):
    from weftline.operators import columns

    return plain(columns.flatten_header(_grid(s, d, [["supplier", "supplier"], ["key", "full"], [None, "name"]]), 0, 2))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'press' ELSE event_type END AS event_type, lower(trim(regexp_replace('  ' || event_type || '   X ', '\\s+', ' ', 'g'))) AS tidy FROM events")
def c_replace_clean(s, d):
    from weftline.operators import columns

    e = t(s, d, "events").select("event_id", "event_type", F.concat(F.lit("  "), "event_type", F.lit("   X ")).alias("tidy"))
    return columns.replace_values(columns.clean_text(e, ["tidy"], lower=True), "event_type", {"click": "press"})


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 70")
def k_clip_rows(s, d):
    from weftline.operators import rows

    return plain(rows.clip_rows(with_order(t(s, d, "events").select("event_id"), "event_id"), 70))


_HOLES = "SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS a, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS b, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS c FROM part"


@query(f"SELECT * FROM ({_HOLES}) WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2")
def k_drop_empty(s, d):
    from weftline.operators import rows

    k = F.col("p_partkey")
    return rows.drop_empty_rows(t(s, d, "part").select(F.when(k % 2 == 0, k).alias("a"), F.when(k % 3 == 0, F.col("p_name")).alias("b"), F.when(k % 5 == 0, F.col("p_size")).alias("c")), 0.3)


@query("SELECT p_partkey, CASE WHEN p_partkey <= (SELECT max(p_partkey) - 20 FROM part) AND p_partkey % 4 <> 0 THEN p_name END AS name FROM part WHERE p_partkey <= (SELECT max(p_partkey) FROM part WHERE p_partkey <= (SELECT max(p_partkey) - 20 FROM part) AND p_partkey % 4 <> 0)")
def k_drop_trailing(s, d):
    """The last run of rows without a name goes, earlier gaps stay."""
    from weftline.operators import rows

    p = _parts(s, d)
    last = t(s, d, "part").agg((F.max("p_partkey") - 20).alias("last"))
    p = p.crossJoin(F.broadcast(last)).select("__ord", "p_partkey", F.when((F.col("p_partkey") <= F.col("last")) & (F.col("p_partkey") % 4 != 0), F.col("p_name")).alias("name"))
    return plain(rows.drop_trailing_rows(p, ["name"]))


# --- joins and JSON ----------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey::VARCHAR AS k, n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def j_key_types(s, d):
    """Keys of different types are compared as text."""
    from weftline.operators import multi

    a = t(s, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return multi.join([a, t(s, d, "supplier").select(F.col("s_nationkey").cast("string").alias("k"), "s_suppkey")], on="k")


@query("SELECT o_orderkey AS orderkey, o_totalprice, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def j_natural(s, d):
    """Without keys, the common columns."""
    from weftline.operators import multi

    return multi.join([t(s, d, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_totalprice"), t(s, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber")])


@query("SELECT r_regionkey AS k, r_name AS label_regions, n_name AS label_nations FROM region JOIN nation ON r_regionkey = n_regionkey")
def j_ports(s, d):
    """Two tables on one port: columns that clash are named after the data sets."""
    import tempfile

    from weftline.session import Pipeline

    p = Pipeline(s, tempfile.mkdtemp())
    a = p.add_input(data=t(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("label")), label="regions")
    b = p.add_input(data=t(s, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("label")), label="nations")
    return p.get_dataset(p.add_node("join", inputs={"dfs": [a, b]}, params={"on": "k"}))


@query("SELECT n_nationkey::BIGINT AS index, n_regionkey::BIGINT AS region, CASE WHEN n_nationkey < 10 THEN n_name END AS name FROM nation")
def j_paired(s, d):
    """Arrays of pairs side by side, matched on their first element."""
    from weftline.operators import jsons

    rows = _nations(s, d)
    return jsons.flatten_json({"region": [[k, r] for k, _, r in rows], "name": [[k, n] for k, n, _ in rows if k < 10]})


@query("SELECT count(*)::INT AS length, true AS tabular, 'id:INTEGER,info.name:STRING' AS fields FROM nation")
def n_cartograph(s, d):
    from weftline.operators import jsons

    flat = jsons.cartograph_json([{"id": k, "name": n} for k, n, _ in _nations(s, d)])
    got = jsons.cartograph_json([{"id": k, "info": {"name": n}} for k, n, _ in _nations(s, d)])
    return s.createDataFrame([(got["length"], flat["tabular"], ",".join(f"{f['path']}:{f['type']}" for f in got["fields"]).replace("[].", "").replace("[]", ""))], "length int, tabular boolean, fields string")


@query("SELECT * FROM (VALUES ('list', 'TypeError'), ('object', 'TypeError'), ('method', 'AttributeError'), ('deep', 'JsonTooDeepError')) AS x(what, error)")
def n_guards(s, d):
    """A document that is used as a table explains itself."""
    from weftline.operators import jsons

    doc: object = 1
    for _ in range(70):
        doc = [doc]
    tries = {"list": lambda: jsons.guarded([1])["a"], "object": lambda: jsons.guarded({"a": 1})[["a"]], "method": lambda: jsons.guarded([1]).groupby, "deep": lambda: jsons.cartograph_json(doc)}
    out = []
    for name, f in tries.items():
        try:
            f()
        except Exception as e:  # noqa: BLE001
            out.append((name, type(e).__name__))
    return s.createDataFrame(out, "what string, error string")


# --- code --------------------------------------------------------------------------------------------------------------------


@query("SELECT n_regionkey AS n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def x_code_pandas(s, d):
    from weftline.operators import code

    return code.execute_code("result = nation.groupby('n_regionkey').size().reset_index(name='n')", nation=t(s, d, "nation"))


@query("SELECT * FROM (VALUES ('import os', false), ('import math', true), ('open(1)', false), ('().__class__', false), ('result = 1', true)) AS x(code, allowed)")
def x_code_check(s, d):
    from weftline.operators import code

    out = []
    for text in ("import os", "import math", "open(1)", "().__class__", "result = 1"):
        try:
            code.check(text)
            out.append((text, True))
        except ValueError:
            out.append((text, False))
    return s.createDataFrame(out, "code string, allowed boolean")


# --- pipelines -----------------------------------------------------------------------------------------------------------------


def _pipeline(s: SparkSession, d: str):  # noqa: ANN202
    """Large orders, their sums by status and their number, to be written below the shared folder."""
    from weftline.session import Pipeline
    from weftline.spec import OutputPort

    p = Pipeline(s, local(place(s)))
    a = p.add_input(location=f"{d}/orders.parquet", label="orders", format="PARQUET")
    big = p.add_node("filter_greater_than", id_="100", label="big", inputs={"df": a}, params={"column": "o_totalprice", "value": 100000}, outputs=[OutputPort("101", visibility=True), OutputPort("102", "mask")])
    slim = p.add_node("select_columns", inputs={"df": "101"}, params={"columns": "o_orderstatus, o_custkey"}, label="slim", visibility=False)
    p.add_node("aggregate_sum", inputs={"df": slim}, params={"group_columns": "o_orderstatus"}, label="sums")
    p.add_node("count_rows", inputs={"df": "101"}, label="number")
    return p, big


_BIG = "FROM orders WHERE o_totalprice > 100000"


@query(f"SELECT o_orderkey, o_totalprice {_BIG}")
def o_parquet(s, d):
    """A visible output is written and read back."""
    p, _ = _pipeline(s, d)
    ok, error = p.run(stats=False)
    if not ok:
        raise RuntimeError(error)
    return s.read.parquet(p.output_path("big_out") + ".parquet").select("o_orderkey", "o_totalprice")


@query(f"SELECT o_orderstatus, sum(o_custkey)::BIGINT AS o_custkey {_BIG} GROUP BY 1")
def o_shared(s, d):
    """A second output that goes on from the first."""
    p, _ = _pipeline(s, d)
    p.run(stats=False)
    return s.read.parquet(p.output_path("sums_out") + ".parquet")


@query(f"SELECT count(*) AS number {_BIG}")
def o_scalar(s, d):
    p, _ = _pipeline(s, d)
    p.run(stats=False)
    return s.createDataFrame([(p.get_dataset("number_out"),)], "number bigint")


@query("SELECT o_totalprice > 100000 AS inside, count(*) AS n FROM orders GROUP BY 1")
def o_mask(s, d):
    p, _ = _pipeline(s, d)
    p.run(lazy=True)
    return p.get_dataset("102").groupBy(F.col("o_totalprice").alias("inside")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def o_partitioned(s, d):
    """A table in parts, one folder per key."""
    from weftline.session import Pipeline

    p = Pipeline(s, local(place(s)))
    o = t(s, d, "orders").select("o_orderkey", "o_orderstatus")
    p.register_transform("by_status", lambda df: {k: df.where(F.col("o_orderstatus") == k) for k in ("F", "O", "P")}, df="DATAFRAME")
    n = p.add_node("by_status", inputs={"df": p.add_input(data=o, label="orders")}, label="parts")
    ok, error = p.run(stats=False)
    if not ok:
        raise RuntimeError(error)
    base = p.output_path(p.spec.get_name(n)) + "_partitioned"
    return s.read.parquet(*[f"{base}/{k}.parquet" for k in ("F", "O", "P")])


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def o_json(s, d):
    """A JSON output, read back."""
    from weftline.operators import jsons
    from weftline.session import Pipeline

    p = Pipeline(s, local(place(s)))
    p.register_transform("as_document", lambda data: data, data="JSON")
    n = p.add_node("as_document", inputs={"data": p.add_input(data=[{"id": k, "name": x} for k, x, _ in _nations(s, d)], label="doc")}, label="copy")
    ok, error = p.run(stats=False)
    if not ok:
        raise RuntimeError(error)
    return jsons.flatten_json(s.read.text(p.output_path(p.spec.get_name(n)) + ".json", wholetext=True))


@query(f"SELECT 'orders' AS name, count(*) AS rows, 6 AS fields FROM orders UNION ALL SELECT 'big_out', count(*), 6 {_BIG} UNION ALL SELECT 'sums_out', count(DISTINCT o_orderstatus), 2 {_BIG}")
def o_catalogue(s, d):
    """Descriptions of inputs and written outputs."""
    p, _ = _pipeline(s, d)
    p.run()
    meta = p.get_datasets_metadata()
    return s.createDataFrame([(n, m["rows"], len(m["fields"])) for n, m in meta.items() if m["fields"] and n != "number_out"], "name string, rows bigint, fields int")


@query(f"SELECT 'big_out' AS name, count(*) AS rows, 6 AS fields, true AS has_file {_BIG}")
def o_visual(s, d):
    from weftline import export

    p, _ = _pipeline(s, d)
    p.run()
    path = str(p.workspace / "visual.xml")
    export.scaffold(path)
    p.export_visual(path)
    got = {n: x for n, x in export.read(path).items() if n == "big_out"}
    return s.createDataFrame([(n, x["rows"], len(x["fields"]), bool(x["file"])) for n, x in got.items()], "name string, rows bigint, fields int, has_file boolean")


@query("SELECT 0::BIGINT AS data_sets, 'visuSpec' AS root")
def o_scaffold(s, d):
    import tempfile
    from xml.etree import ElementTree

    from weftline import export

    path = tempfile.mkdtemp() + "/v.xml"
    root = ElementTree.fromstring(export.scaffold(path)).tag
    return s.createDataFrame([(len(export.read(path)), root)], "data_sets bigint, root string")


@query("SELECT * FROM (VALUES ('inputs', 1), ('visible', 4), ('leaves', 3), ('data', 6)) AS x(what, n)")
def r_lists(s, d):
    p, _ = _pipeline(s, d)
    return s.createDataFrame([("inputs", len(p.get_inputs())), ("visible", len(p.get_visibles())), ("leaves", len(p.get_leaves())), ("data", len(p.list_data()))], "what string, n int")


@query("SELECT o_orderstatus, o_custkey FROM orders WHERE o_totalprice > 100000")
def r_edit(s, d):
    """Nodes taken out again, what remains still runs."""
    p, _ = _pipeline(s, d)
    for n in [n for n in p.spec.nodes if n.type in ("aggregate_sum", "count_rows")]:
        p.remove_node(n.id)
    p.run(lazy=True)
    return p.get_dataset("slim_out")


@query(f"SELECT o_orderstatus, sum(o_custkey)::BIGINT AS o_custkey {_BIG} GROUP BY 1")
def r_promote(s, d):
    """A leaf becomes an input and is read from there."""
    p, _ = _pipeline(s, d)
    for n in [n for n in p.spec.nodes if n.type == "count_rows"]:
        p.remove_node(n.id)
    p.promote_leaves()
    return p.get_dataset("sums_out")


@query("SELECT * FROM (VALUES ('node_pending', 4, 1), ('node_running', 4, 2), ('node_completed', 4, 3)) AS x(event, nodes, place)")
def r_events(s, d):
    """Every node is pending, then compiled, then completed once its rows are written."""
    p, _ = _pipeline(s, d)
    seen: list[str] = []
    p.subscribe(lambda e, what: seen.append(e))
    p.run(stats=False)
    own = [e for e in seen if e.startswith("node_")]
    return s.createDataFrame([(e, own.count(e), n) for n, e in enumerate(dict.fromkeys(own), 1)], "event string, nodes int, place int")


@query("SELECT 1 AS runs, true AS same, 0 AS left_over")
def r_lifecycle(s, d):
    """A second run of an unchanged pipeline does nothing; the XML gives the same pipeline; a reset empties it."""
    from weftline import xmlio

    p, _ = _pipeline(s, d)
    seen: list[str] = []
    p.subscribe(lambda e, what: seen.append(e))
    p.run(lazy=True)
    first = seen.count("node_running")
    p.run(lazy=True)
    same = xmlio.parse(p.export_to_xml()) == p.spec
    runs = seen.count("node_running") // max(1, first)
    p.reset_spec()
    return s.createDataFrame([(runs, same, len(p.spec.nodes))], "runs int, same boolean, left_over int")


@query("SELECT count(*)::INT AS registered, count(*)::INT AS counted, 2 AS removed, 1 AS left_over FROM (VALUES ('a.csv'), ('b.json'), ('c.parquet')) AS x(f)")
def r_register(s, d):
    from weftline.session import Pipeline

    p = Pipeline(s, local(place(s)))
    ids = p.register_files(["a.csv", "b.json", "c.parquet", "a.csv"])
    counted = p.count_files()
    removed = p.remove_files(["a.csv", "c.parquet", "none"])
    return s.createDataFrame([(len(ids), counted, removed, p.count_files(["b.json", "a.csv"]))], "registered int, counted int, removed int, left_over int")


@query("SELECT l_returnflag, l_linestatus FROM lineitem")
def r_memory(s, d):
    from weftline.session import Pipeline

    p = Pipeline(s, local(place(s)))
    n = p.add_node("select_columns", inputs={"df": p.add_input(data=t(s, d, "lineitem"), label="lines")}, params={"columns": "l_returnflag, l_linestatus"})
    return p.get_dataset(n)


@query("SELECT o_orderkey, o_orderstatus, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INT AS __time__ FROM orders")
def s_temporal(s, d):
    """One file per point of time, all together."""
    from weftline.sources import readers

    base = place(s)
    o = t(s, d, "orders").select("o_orderkey", "o_orderstatus")
    files = []
    for k in ("F", "O", "P"):
        o.where(F.col("o_orderstatus") == k).write.parquet(f"{base}/{k}.parquet")
        files.append(f"{base}/{k}.parquet")
    return readers.together(readers.temporal(s, files, "PARQUET"))


@query("SELECT * FROM (VALUES ('P1DT2H', 93600.0::DOUBLE), ('P2W', 1209600.0), ('PT1M30S', 90.0)) AS x(text, seconds)")
def s_interval(s, d):
    from weftline.sources import readers

    return s.createDataFrame([(x, readers.interval_seconds(x)) for x in ("P1DT2H", "P2W", "PT1M30S")], "text string, seconds double")


@query("SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def s_stream(s, d):
    """The events as a stream of files, aggregated with complete output."""
    from weftline.streaming import temporal

    base = place(s)
    t(s, d, "events").select("event_type", "value").repartition(3).write.parquet(base)
    name = f"seen_{uuid.uuid4().hex}"
    live = temporal.stream(s, base, "event_type string, value double", files_per_batch=2).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    q = live.writeStream.format("memory").outputMode("complete").queryName(name).option("checkpointLocation", f"{place(s)}-stream").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(name)


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def s_download(s, d):
    """A file served over http on this machine, fetched and read."""
    import http.server
    import tempfile
    import threading

    from weftline.sources import readers

    body = "key,name\n" + "".join(f"{k},{n}\n" for k, n, _ in _nations(s, d))

    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            self.send_response(200)
            self.send_header("Content-Type", "text/csv")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_: object) -> None:
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        file = readers.download(f"http://127.0.0.1:{server.server_port}/", tempfile.mkdtemp())
    finally:
        server.shutdown()
    with open(file, "rb") as f:
        return _read(s, d, put(place(s) + ".csv", f.read()))


@query("SELECT * FROM (VALUES ('../../a b?.csv', 'a b_.csv', true), ('x/y.parquet', 'y.parquet', false)) AS x(given, safe, outside)")
def s_paths(s, d):
    import tempfile

    from weftline import security

    base, out = tempfile.mkdtemp(), []
    for name in ("../../a b?.csv", "x/y.parquet"):
        try:
            security.safe_path(name, base)
            outside = False
        except ValueError:
            outside = True
        out.append((name, security.safe_name(name), outside))
    return s.createDataFrame(out, "given string, safe string, outside boolean")


@query("SELECT * FROM (VALUES ('FLOAT', '1.5', '1.5'), ('INTEGER', '3.0', '3'), ('BOOLEAN', 'yes', 'True'), ('LIST', '[a, ''b'']', 'a|b'), ('FLOAT', 'many', 'many'), ('STRING', ' x ', ' x ')) AS x(kind, text, got)")
def y_ports(s, d):
    """Port texts as their types; what can't be read stays text."""
    from weftline.registry import port_value

    given = [("FLOAT", "1.5"), ("INTEGER", "3.0"), ("BOOLEAN", "yes"), ("LIST", "[a, 'b']"), ("FLOAT", "many"), ("STRING", " x ")]
    show = lambda v: "|".join(v) if isinstance(v, list) else str(v)
    return s.createDataFrame([(k, x, show(port_value(x, k))) for k, x in given], "kind string, text string, got string")


@query("SELECT 'join' AS name, 'dfs,on,how' AS ports UNION ALL SELECT 'get_top_n', 'df,column,n,return_mask'")
def y_catalogue(s, d):
    """The transforms with their ports, as text and as an XML schema read back."""
    from weftline import registry

    found = registry.read_schema(registry.schema_text())
    return s.createDataFrame([(n, ",".join(found[n].ports)) for n in ("join", "get_top_n") if f"{n}(" in registry.catalogue_text()], "name string, ports string")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
