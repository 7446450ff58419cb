"""Schemas that drift between files: one consistent table, and a report of each change.

The header of every file is a list of (column, type). Columns of two files are the same if their keys
are equal (a canonical name where one is known). The types that a column has over all files are folded
through a lattice, whose join is the narrowest type that holds them all; the fold is a set of flags per
column and so an ordinary sum by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.functions.ordered import previous
from weftline.functions.storage import written

# The lattice's chains; types of different chains meet in string.
CHAINS = [["int", "float", "string"], ["date", "timestamp", "string"], ["boolean", "string"]]
CASTS = {"int": "bigint", "float": "double", "date": "date", "timestamp": "timestamp_ntz", "boolean": "boolean", "string": "string"}


def join_types(types: list[str | None]) -> str | None:
    """The narrowest type that holds all of these; unknown types count as string, null as nothing."""
    kinds = {t if t in CASTS else "string" for t in types if t is not None}
    if not kinds:
        return None
    for chain in CHAINS:
        if kinds <= set(chain):
            return max(kinds, key=chain.index)
    return "string"


def promoted(types: Column) -> Column:
    """join_types over an array column of distinct type names, as a column expression."""
    known = F.transform(F.filter(types, lambda t: t.isNotNull()), lambda t: F.when(t.isin(*CASTS), t).otherwise(F.lit("string")))
    out = F.lit("string")
    for chain in CHAINS:
        inside = F.size(F.array_except(known, F.array(*map(F.lit, chain)))) == 0
        top = reduce(lambda acc, t: F.when(F.array_contains(known, t), F.lit(t)).otherwise(acc), chain, F.lit(None).cast("string"))
        out = F.when(inside, top).otherwise(out)
    return out


def union_schema(headers: DataFrame) -> DataFrame:
    """``series_id, key, data_type, n_files, first_period, last_period`` from file headers.

    ``headers``: series_id, period_no, file_id, key, data_type, one row per column of a file. The set of
    types per column is bounded by the number of types, so no group grows with the data.
    """
    kind = F.when(F.col("data_type").isNull() | F.col("data_type").isin(*CASTS), F.col("data_type")).otherwise("string")
    g = headers.groupBy("series_id", "key").agg(
        F.collect_set(kind).alias("types"),
        F.count_distinct("file_id").alias("n_files"),
        F.min("period_no").alias("first_period"),
        F.max("period_no").alias("last_period"),
    )
    return g.select("series_id", "key", promoted(F.col("types")).alias("data_type"), "n_files", "first_period", "last_period")


def changes(files: DataFrame, columns: DataFrame) -> DataFrame:
    """``file_id, change_kind, column_id, key, old_name, new_name, old_type, new_type`` between a file and the one before
    it in its series.

    ``files``: file_id, series_id, period_no (rows with a null in either are left out). ``columns``:
    column_id, file_id, key, name, data_type, position. Kinds are added, removed, renamed and retyped;
    the id is the later file's column, for removed ones the earlier file's. Where a file has a key more
    than once, the columns pair up by name first and position next. The first file of a series has no
    changes. Null names and types are equal to each other.
    """
    f = files.select("file_id", "series_id", "period_no").where("series_id is not null and period_no is not null").distinct()
    pairs = previous(f, ["series_id"], "period_no", ["file_id"]).where("prev is not null").select("file_id", F.col("prev.file_id").alias("before_id"))
    # a file's columns are the new ones of itself and the old ones of the file after it
    sides = pairs.select(F.col("file_id").alias("_of"), "file_id", F.lit(True).alias("_new")).unionByName(pairs.select(F.col("before_id").alias("_of"), "file_id", F.lit(False).alias("_new")))
    item = F.struct("name", "position", "column_id", "data_type").alias("item")
    both = columns.select(F.col("file_id").alias("_of"), "key", item).join(sides, "_of").select("file_id", "key", "_new", "item")
    # bounded groups: the columns of two files that share a key
    both = both.groupBy("file_id", "key").agg(F.sort_array(F.collect_list(F.when(F.col("_new"), F.col("item")))).alias("new"), F.sort_array(F.collect_list(F.when(~F.col("_new"), F.col("item")))).alias("old"))
    gone = lambda x, y: F.filter(x, lambda i: ~F.coalesce(F.exists(y, lambda j: j["name"].eqNullSafe(i["name"])), F.lit(False)))
    both = both.withColumn("old", F.concat(F.filter("old", lambda i: F.exists("new", lambda j: j["name"].eqNullSafe(i["name"]))), gone(F.col("old"), F.col("new")))).withColumn(
        "new", F.concat(F.filter("new", lambda i: F.exists("old", lambda j: j["name"].eqNullSafe(i["name"]))), gone(F.col("new"), F.col("old")))
    )
    at = F.posexplode(F.arrays_zip("old", "new")).alias("n", "z")
    z = both.select("file_id", "key", at).select("file_id", "key", F.col("z.old").alias("old"), F.col("z.new").alias("new"))
    renamed, retyped = ~F.col("old.name").eqNullSafe(F.col("new.name")), ~F.col("old.data_type").eqNullSafe(F.col("new.data_type"))
    kinds = (
        F.when(F.col("old").isNull(), F.array(F.lit("added")))
        .when(F.col("new").isNull(), F.array(F.lit("removed")))
        .otherwise(F.array_compact(F.array(F.when(renamed, F.lit("renamed")), F.when(retyped, F.lit("retyped")))))
    )
    return z.select(
        "file_id",
        F.explode(kinds).alias("change_kind"),
        F.coalesce("new.column_id", "old.column_id").alias("column_id"),
        "key",
        F.col("old.name").alias("old_name"),
        F.col("new.name").alias("new_name"),
        F.col("old.data_type").alias("old_type"),
        F.col("new.data_type").alias("new_type"),
    )


# --- files ----------------------------------------------------------------------------------------


def _kind(t: pa.DataType) -> str:
    if pa.types.is_boolean(t):
        return "boolean"
    if pa.types.is_integer(t):
        return "int"
    if pa.types.is_floating(t) or pa.types.is_decimal(t):
        return "float"
    if pa.types.is_date(t):
        return "date"
    return "timestamp" if pa.types.is_timestamp(t) else "string"


def _opened(path: str):  # noqa: ANN202
    """A file on any store that Arrow knows by its address; a path without a scheme is local."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(name)


def file_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file_id`` (the place in ``paths``), ``path, position, name, data_type`` of Parquet and CSV files,
    read in parallel: only footers and header lines are touched. CSV columns are strings."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv
        import io

        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for n, path in zip(batch.column("file_id").to_pylist(), batch.column("path").to_pylist()):
                with _opened(path) as f:
                    if path.endswith(".csv"):
                        line = next(csv.reader(io.TextIOWrapper(f, "utf-8-sig", newline="")), [])
                        rows += [(n, path, k, name, "string") for k, name in enumerate(line)]
                    else:
                        rows += [(n, path, k, c.name, _kind(c.type)) for k, c in enumerate(pq.read_schema(f))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()))], names=["file_id", "path", "position", "name", "data_type"])

    listed = spark.createDataFrame(list(enumerate(paths)), "file_id bigint, path string").repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))
    return listed.mapInArrow(heads, "file_id bigint, path string, position int, name string, data_type string")


def read_drifting(spark: SparkSession, paths: list[str], keys: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All files as one table in the union schema, and the ordered changes from file to file.

    ``paths`` are in order of time. ``keys`` maps names to canonical ones. The headers stay a table: the lattice
    is folded and the changes are found by keyed aggregation. What comes to the driver is the union schema and
    the distinct headers with their files. Files are read in groups of equal headers, each with its own
    explicit schema, and cast; values that a promotion can't hold become null. The table has ``file_path``
    first; a column of that name in the files is kept as ``file_path_``.
    """
    name = F.col("name")
    pairs = [x for k, v in (keys or {}).items() for x in (F.lit(k), F.lit(v))]
    key = F.coalesce(F.create_map(*pairs)[name], name) if pairs else name
    heads = written(file_headers(spark, paths).withColumn("key", F.when(key == "file_path", "file_path_").otherwise(key)), "headers")
    every = heads.select(F.lit(0).alias("series_id"), F.col("file_id").alias("period_no"), "file_id", "key", "data_type")
    first = heads.groupBy("key").agg(F.min(F.struct("file_id", "position")).alias("at"))
    schema = union_schema(every).join(first, "key").orderBy("at").collect()  # one row per column of the union
    union = {r.key: r.data_type for r in schema}
    by_file = heads.groupBy("file_id", "path").agg(F.sort_array(F.collect_list(F.struct("position", "name", "key"))).alias("columns"))
    shapes = by_file.groupBy(F.col("path").endswith(".csv").alias("is_csv"), F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["key"].alias("key"))).alias("columns"))
    parts = []
    for shape in shapes.agg(F.sort_array(F.collect_list("file_id")).alias("files")).orderBy(F.element_at("files", 1)).collect():
        files, cols = [paths[n] for n in shape.files], [(c["name"], c["key"]) for c in shape.columns]
        df = spark.read.csv(files, header=True, schema=", ".join(f"`{n}` string" for n, _ in cols)) if shape.is_csv else spark.read.option("mergeSchema", "false").parquet(*files)
        own = {}
        for n, k in cols:
            own.setdefault(k, n)
        parts.append(df.select(F.col("_metadata.file_path").alias("file_path"), *[(F.col(f"`{own[k]}`").try_cast(CASTS[t]) if k in own else F.lit(None).cast(CASTS[t])).alias(k) for k, t in union.items()]))
    table = reduce(DataFrame.unionByName, parts)
    files = spark.range(len(paths)).select(F.col("id").alias("file_id"), F.lit(0).cast("bigint").alias("series_id"), F.col("id").alias("period_no"))
    columns = heads.select((F.col("file_id") * 1_000_000 + F.col("position")).alias("column_id"), "file_id", "key", "name", "data_type", "position")
    return table, changes(files, columns).orderBy("file_id", "change_kind", "key")
