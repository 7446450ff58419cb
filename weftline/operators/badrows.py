"""Rows that fail to parse: records of delimited files, split into typed rows and rejects with a reason.

The characterization of a file says how its lines are read. Each line is parsed once in Python, in
Arrow batches inside the partitions that the scan made (no shuffle of texts): first the structure, by
the strict csv reader, whose exceptions become the reason; then the values, by typed constructors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from weftline.functions.records import BLANKS, BadRecord, assemble, typed

PARSED = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
    ]
)


def latest_characterization(characterizations: DataFrame) -> DataFrame:
    """One row per file: its latest characterization (ties by the larger id), nulls in it as defaults."""
    c = characterizations.groupBy("file_id").agg(
        F.max_by(
            F.struct("header", "field_separator", "record_separator", "skip_lines", "column_names", "column_types"),
            F.struct("characterized_at", "characterization_id"),
        ).alias("c")
    )
    return c.select(
        "file_id",
        F.coalesce("c.header", F.lit(True)).alias("header"),
        F.coalesce("c.field_separator", F.lit(",")).alias("separator"),
        F.coalesce(F.col("c.record_separator") == "\r\n", F.lit(False)).alias("crlf"),
        F.coalesce("c.skip_lines", F.lit(0)).alias("skip"),
        F.col("c.column_names").alias("column_names"),
        F.col("c.column_types").alias("column_types"),
    )


def _text(value: object) -> str | None:
    if value is None:
        return None
    return str(value).lower() if isinstance(value, bool) else str(value)


def _parse(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file_id", pa.int64()), ("line_no", pa.int32()), ("reason", pa.string()), ("cells", pa.list_(pa.string()))])
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in ("file_id", "line_no", "raw_line", "separator", "crlf", "column_types")}
        out: tuple[list, list, list, list] = ([], [], [], [])
        for file_id, line_no, raw, separator, crlf, kinds in zip(*cols.values()):
            reason = cells = None
            if raw is None:
                reason = "null line"
            elif kinds is None:
                reason = "no declared columns"
            else:
                try:
                    cells = typed(raw, kinds, separator, crlf)
                except BadRecord as e:
                    reason = e.args[0]
            if keep or reason:
                out[0].append(file_id), out[1].append(line_no), out[2].append(reason)
                out[3].append([_text(x) for x in cells] if cells and keep else None)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)


def parse_lines(lines: DataFrame, characterizations: DataFrame, *, rejects_only: bool = False) -> DataFrame:
    """``file_id, line_no, reason, cells`` of every record line of delimited files.

    ``lines`` has file_id, line_no (from 1), raw_line and loaded_at; other columns are ignored.
    ``reason`` is null for valid lines, whose ``cells`` are the values in canonical text (null for the
    spellings of null); for others ``cells`` is null. Skipped lines, the header and lines of blanks don't
    come out. A null line, and a line of a file without characterization or declared columns, is a
    reject. Repeated deliveries of a line, which differ in their time alone, come out once: after parsing, so that
    what is shuffled is what is left, not all texts. Empty tables give an empty result.

    The side that is joined has one row per file; Spark broadcasts it while it is under the session's
    threshold, and splits a hot file's partition by AQE where it isn't.
    """
    body = (
        lines.select("file_id", "line_no", "raw_line")
        .join(latest_characterization(characterizations), "file_id", "left")
        .where(F.col("line_no") > F.coalesce("skip", F.lit(0)) + F.coalesce("header", F.lit(True)).cast("int"))
        .where(F.col("raw_line").isNull() | (F.regexp_replace("raw_line", r"[ \t\r\n]", "") != ""))
        .select(
            F.col("file_id").cast("bigint"),
            F.col("line_no").cast("int"),
            "raw_line",
            F.coalesce("separator", F.lit(",")).alias("separator"),
            F.coalesce("crlf", F.lit(False)).alias("crlf"),
            "column_types",
        )
    )
    parsed = body.mapInArrow(lambda it: _parse(it, not rejects_only), PARSED)
    return parsed.dropDuplicates(["file_id", "line_no"])


def rejects(lines: DataFrame, characterizations: DataFrame) -> DataFrame:
    """``file_id, line_no, reason`` of the lines that fail; only these leave the Python workers."""
    return parse_lines(lines, characterizations, rejects_only=True).select("file_id", "line_no", "reason")


SPARK_TYPES = {"int": "bigint", "float": "double", "date": "date", "boolean": "boolean"}


def typed_rows(lines: DataFrame, characterizations: DataFrame, names: list[str], types: list[str]) -> DataFrame:
    """The valid rows of all files that declare exactly these columns, as typed columns.

    Clashing names (also with file_id and line_no) get a number behind them.
    """
    same = characterizations.where((F.col("column_names") == F.array(*map(F.lit, names))) & (F.col("column_types") == F.array(*map(F.lit, types))))
    ok = parse_lines(lines.join(latest_characterization(same).select("file_id"), "file_id", "left_semi"), characterizations).where("reason is null")
    seen, cols = {"file_id", "line_no"}, []
    for n, (name, kind) in enumerate(zip(names, types)):
        while name in seen:
            name += f"_{n + 1}"
        seen.add(name)
        cols.append(F.col("cells")[n].cast(SPARK_TYPES.get(kind, "string")).alias(name))
    return ok.select("file_id", "line_no", *cols)


def value_lines(parsed: DataFrame, characterizations: DataFrame) -> DataFrame:
    """Valid rows in long form: ``file_id, line_no, column_name, column_type, value``."""
    c = latest_characterization(characterizations).select("file_id", F.arrays_zip("column_names", "column_types").alias("declared"))
    return (
        parsed.where("reason is null")
        .join(c, "file_id")
        .select("file_id", "line_no", "cells", F.posexplode("declared").alias("n", "d"))
        .select("file_id", "line_no", F.col("d.column_names").alias("column_name"), F.col("d.column_types").alias("column_type"), F.col("cells")[F.col("n")].alias("value"))
    )


def read_records(spark: SparkSession, path: str, encoding: str = "utf-8", separator: str = ",") -> DataFrame:
    """``file_name, line_no, raw_line`` of whole delimited files: records assembled quote-aware.

    Files are the unit of parallelism here, because whether a line break is inside quotes depends on all
    text before it; a file must fit an executor's memory. ``line_no`` counts records from 1.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                lines = content.decode(encoding, "replace").removeprefix("﻿").split("\n")
                rows = list(assemble(lines[:-1] if lines and not lines[-1] else lines, separator))
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_pydict({"file_name": [name] * len(part), "line_no": range(at + 1, at + len(part) + 1), "raw_line": part}, schema=pa.schema([("file_name", pa.string()), ("line_no", pa.int32()), ("raw_line", pa.string())]))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(records, "file_name string, line_no int, raw_line string")


__all__ = ["BLANKS", "latest_characterization", "parse_lines", "read_records", "rejects", "typed_rows", "value_lines"]
