"""Inputs by format name, as DataFrames. Missing values are unified here (see weftline.semantics)."""

from __future__ import annotations

import csv
import io
import itertools
import os
import re
import urllib.request
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.security import safe_name
from weftline.semantics import ORD, clean
from weftline.sources import dialect

Reader = Callable[[SparkSession, list[str], dict[str, str]], DataFrame]
READERS: dict[str, Reader] = {}
FORMAT_OF = {".csv": "CSV", ".tsv": "TSV", ".parquet": "PARQUET", ".json": "JSON", ".jsonl": "JSONL", ".ndjson": "JSONL", ".orc": "ORC", ".avro": "AVRO", ".txt": "TEXT", ".xml": "XML", ".xlsx": "XLSX", ".xlsm": "XLSX", ".xls": "XLS", ".ods": "ODS", ".png": "IMAGE", ".jpg": "IMAGE", ".jpeg": "IMAGE", ".gif": "IMAGE", ".bmp": "IMAGE", ".tif": "IMAGE", ".tiff": "IMAGE", ".webp": "IMAGE", ".edf": "EDF", ".bdf": "EDF", ".mhd": "MHD", ".dcm": "DICOM"}


def reader(*formats: str) -> Callable[[Reader], Reader]:
    def add(f: Reader) -> Reader:
        READERS.update(dict.fromkeys(formats, f))
        return f

    return add


def format_of(path: str) -> str:
    return FORMAT_OF.get(Path(urlparse(path).path if "://" in path else path).suffix.lower(), "")


def read(spark: SparkSession, path: str | list[str], kind: str = "", **options: str) -> DataFrame:
    """A file, folder or list of files of a format (by the ending if none is named)."""
    from weftline.sources import sheets, signals  # noqa: F401, their readers register themselves

    paths = [path] if isinstance(path, str) else list(path)
    kind = (kind or format_of(paths[0])).upper()
    if kind not in READERS:
        raise ValueError(f"unknown format {kind!r}; there are {sorted(READERS)}")
    return clean(READERS[kind](spark, paths, options))


def header_option(value: object) -> int | None:
    """The row that holds the names: true 0, false or none no row, else the number itself."""
    text = str(value).strip().lower()
    return 0 if text == "true" else None if text in ("false", "none", "") else int(text)


@reader("CSV", "TSV", "TXT")
def read_csv(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    """Delimited text by its options, or as the first file is found to be written; all columns are text.

    Types come later from weftline.profile.infer_types, one job for all columns. Lines to skip are cut by
    position, which a file has only in a single split; files with a preamble are read whole, and a row of more
    fields than the header is an error there (``operators.badrows`` takes such rows apart with the reason).
    """
    given = dict(options)
    tsv = any(p.lower().endswith(".tsv") for p in paths)
    if "fieldSeparator" not in given and "sep" not in given and not tsv:
        files = sorted(spark.read.text(paths).inputFiles())
        given = (dialect.characterize(unquote(files[0])).options() if files else {}) | given
    separator = given.pop("fieldSeparator", given.pop("sep", "\t" if tsv else ","))
    skip = int(given.pop("skipLines", 0) or 0)
    names = header_option(given.pop("header", "true"))
    ends = given.pop("recordSeparator", None)
    extra = {k: v for k, v in given.items() if k not in ("inferSchema",)}
    whole = str(extra.pop("multiLine", "")).lower() or None
    if whole is None:  # a file that is read whole is one task's work, so only where a quoted field may hold a line break
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        whole = bool(spark.read.text(paths).where(quotes % 2 == 1).limit(1).count())
    r = spark.read.options(sep=separator, quote='"', escape='"', multiLine=whole, inferSchema=False, **extra)
    if ends and ends not in ("\n", "\r\n"):
        r = r.option("lineSep", ends).option("multiLine", False)
    cut = skip + (names or 0)
    if not cut:
        df = r.csv(paths, header=names is not None)
        return df if names is not None else df.toDF(*[str(n) for n in range(len(df.columns))])
    # the preamble goes before parsing: each file is one task's work, read line by line
    first_file = unquote(sorted(spark.read.text(paths).inputFiles())[0])
    head = list(csv.reader(dialect.head(first_file, cut + 1)[0][cut:], delimiter=separator))
    cells = head[0] if head else []
    cols = cells if names is not None else [str(n) for n in range(len(cells))]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                lines = io.StringIO(content.decode("utf-8-sig", "replace"), newline="")
                for _ in range(cut + (names is not None)):
                    next(lines, None)
                rows = csv.reader(lines, delimiter=separator)
                while part := [[x or None for x in r + [""] * (len(cols) - len(r))] for r in itertools.islice(rows, 10_000) if r]:
                    if long := [r for r in part if len(r) > len(cols)]:
                        raise ValueError(f"a row of {len(long[0])} fields under {len(cols)} columns: {long[0]}")
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], names=["cells"])

    content = spark.read.format("binaryFile").load(paths).select("content")
    return content.mapInArrow(body, "cells array<string>").select(*[F.col("cells")[n].alias(c) for n, c in enumerate(cols)])


@reader("PARQUET", "ORC", "AVRO")
def read_columnar(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    kind = (options.get("format") or format_of(paths[0]) or "PARQUET").lower()
    if os.path.isdir(paths[0]) and not Path(paths[0]).suffix:
        kind = options.get("format", "parquet").lower()
    return spark.read.options(**{k: v for k, v in options.items() if k != "format"}).format(kind).load(paths)


@reader("JSON")
def read_json(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    """One row per document, as text in ``value``: see flatten_json."""
    return spark.read.text(paths, wholetext=True)


@reader("JSONL", "NDJSON")
def read_jsonl(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    return spark.read.json(paths)


@reader("TEXT")
def read_text(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    return spark.read.text(paths)


@reader("XML")
def read_xml(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    return spark.read.format("xml").options(**({"rowTag": "row"} | options)).load(paths)


@reader("IMAGE", "PNG", "JPG", "JPEG", "GIF", "BMP", "TIFF", "WEBP")
def read_image(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    """One row per image (Spark's image struct); what can't be decoded is left out."""
    return spark.read.format("image").option("dropInvalid", True).load(paths)


def with_file_order(df: DataFrame) -> DataFrame:
    """``df`` of a Parquet source with the ordinal: files by name, rows by their place in the file.

    The file list is metadata that the driver holds anyway; places are up to 2^40 per file.
    """
    files = sorted(df.inputFiles())
    number = F.create_map(*[x for n, f in enumerate(files) for x in (F.lit(os.path.basename(urlparse(f).path)), F.lit(n).cast("bigint"))])
    if len({os.path.basename(urlparse(f).path) for f in files}) < len(files):
        return df.withColumn(ORD, F.monotonically_increasing_id())
    return df.withColumn(ORD, number[F.col("_metadata.file_name")] * (1 << 40) + F.col("_metadata.row_index"))


# --- collections over time -------------------------------------------------------------------------


def temporal(spark: SparkSession, files: list[str], kind: str = "", **options: str) -> dict[str, DataFrame]:
    """The files of a collection, one table per point of time, by key (the file name) in order."""
    return {os.path.basename(f): read(spark, f, kind, **options) for f in sorted(files, key=os.path.basename)}


def at_time(parts: dict[str, DataFrame], time: int | None = None) -> DataFrame:
    """One point of time: the first if none is given, else the nth, at most the last."""
    keys = sorted(parts)
    if not keys:
        raise ValueError("the collection is empty")
    return parts[keys[0 if time is None else max(0, min(int(time), len(keys) - 1))]]


def together(parts: dict[str, DataFrame]) -> DataFrame:
    """All points of time as one table, with ``__time__`` from 0."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [parts[k].withColumn("__time__", F.lit(n)) for n, k in enumerate(sorted(parts))])


def interval_seconds(text: str) -> float:
    """An ISO 8601 duration (weeks, days, hours, minutes, seconds) in seconds."""
    m = re.fullmatch(r"P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text.strip())
    if not m or not any(m.groups()):
        raise ValueError(f"not a duration: {text}")
    return sum(float(x or 0) * s for x, s in zip(m.groups(), (604800, 86400, 3600, 60, 1)))


# --- downloads ---------------------------------------------------------------------------------------

MOST_BYTES = 500 * 1024 * 1024
# Endings by content type.
ENDINGS = {"text/csv": ".csv", "application/json": ".json", "application/vnd.ms-excel": ".xls", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx", "text/plain": ".txt", "application/xml": ".xml", "text/xml": ".xml", "text/tab-separated-values": ".tsv", "application/octet-stream": ".bin", "application/parquet": ".parquet", "application/x-parquet": ".parquet", "image/png": ".png", "image/jpeg": ".jpg"}


def download(url: str, folder: str, most: int = MOST_BYTES, timeout: float = 60) -> str:
    """Fetch a file over http(s) into a folder; its path. Larger ones than ``most`` are an error.

    The name is the server's, else that of the address, else url_data with an ending by content type.
    """
    if urlparse(url).scheme not in ("http", "https"):
        raise ValueError(f"not an http address: {url}")
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        kind = r.headers.get_content_type()
        name = r.headers.get_filename() or unquote(os.path.basename(urlparse(url).path))
        if not name or "." not in name:
            name = (name or "url_data") + ENDINGS.get(kind, ".bin")
        target = Path(folder) / safe_name(name)
        target.parent.mkdir(parents=True, exist_ok=True)
        size, part = 0, target.with_suffix(target.suffix + ".part")
        with part.open("wb") as f:
            while block := r.read(1 << 20):
                size += len(block)
                if size > most:
                    f.close()
                    part.unlink()
                    raise ValueError(f"{url} is larger than {most} bytes")
                f.write(block)
        part.replace(target)
    return str(target)
