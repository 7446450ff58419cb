"""Top-k, sorting, slicing and sampling of rows.

Row order means something here: ties keep the order of the input (the hidden ordinal).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions import ordered as O
from weftline.functions.ordered import first_rows, numbered
from weftline.registry import transform
from weftline.semantics import ORD, col, missing_last, names, need, ordered, tie, truth

Result = DataFrame | dict[str, DataFrame]


def _extreme(df: DataFrame, column: str, n: int, largest: bool, return_mask: object) -> Result:
    need(df, [column], "Column")
    n = max(0, int(n))
    order = [missing_last(column, not largest), *tie(df)]
    if not truth(return_mask):
        if n <= O.SMALL:
            return df.orderBy(*order).limit(n)
        hidden = ORD in df.columns
        out = first_rows(ordered(df), [missing_last(column, not largest), F.col(ORD).asc()], n, O.SMALL)
        return out if hidden else out.drop(ORD)
    df = ordered(df)
    order = [missing_last(column, not largest), F.col(ORD).asc()]
    result = first_rows(df, order, n, O.SMALL)
    # the last row that made it is the border; one row, so that no side of the mask grows with n
    edge = result.agg(F.max_by(F.struct(col(column).alias("v"), F.col(ORD).alias("o")), F.struct(col(column).isNull().alias("m"), (col(column) * (-1 if largest else 1)).alias("v"), F.col(ORD).alias("o"))).alias("edge")) if _numeric(df, column) else None
    if edge is None:
        chosen = result.select(F.col(ORD).alias("_o")).withColumn("_in", F.lit(True))
        mask = df.join(chosen, df[ORD] == chosen["_o"], "left").select(ORD, F.coalesce("_in", F.lit(False)).alias("0"))
        return {"result": result, "mask": mask}
    v, e = col(column), F.col("edge.v")
    better = (v > e) if largest else (v < e)
    inside = F.coalesce(better, v.isNotNull() & e.isNull()) | (v.eqNullSafe(e) & (F.col(ORD) <= F.col("edge.o")))
    mask = df.crossJoin(F.broadcast(edge)).select(ORD, F.coalesce(inside & F.col("edge").isNotNull(), F.lit(False)).alias("0"))
    return {"result": result, "mask": mask}


def _numeric(df: DataFrame, column: str) -> bool:
    return df.select(col(column)).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint", "float", "double")


def _share(df: DataFrame, fraction: float) -> int:
    fraction = float(fraction)
    return int(max(1, fraction * df.count())) if fraction > 0 else 0


@transform("get_top_n", df="DATAFRAME", column="COLUMN_NAME", n="INTEGER", return_mask="BOOLEAN", needs_order=True)
def get_top_n(df: DataFrame, column: str, n: int, return_mask: object = False) -> Result:
    """The n rows of the largest values, in falling order; missing ones come last."""
    return _extreme(df, column, n, True, return_mask)


@transform("get_bottom_n", df="DATAFRAME", column="COLUMN_NAME", n="INTEGER", return_mask="BOOLEAN", needs_order=True)
def get_bottom_n(df: DataFrame, column: str, n: int, return_mask: object = False) -> Result:
    """The n rows of the smallest values, in rising order; missing ones come last."""
    return _extreme(df, column, n, False, return_mask)


@transform("get_top_percentage", df="DATAFRAME", column="COLUMN_NAME", fraction="FLOAT", return_mask="BOOLEAN", needs_order=True)
def get_top_percentage(df: DataFrame, column: str, fraction: float, return_mask: object = False) -> Result:
    """The share of rows with the largest values, at least one row if the share is above 0."""
    need(df, [column], "Column")
    return _extreme(df, column, _share(df, fraction), True, return_mask)


@transform("get_bottom_percentage", df="DATAFRAME", column="COLUMN_NAME", fraction="FLOAT", return_mask="BOOLEAN", needs_order=True)
def get_bottom_percentage(df: DataFrame, column: str, fraction: float, return_mask: object = False) -> Result:
    """The share of rows with the smallest values, at least one row if the share is above 0."""
    need(df, [column], "Column")
    return _extreme(df, column, _share(df, fraction), False, return_mask)


@transform("sort_values", df="DATAFRAME", columns="COLUMN_NAME_OR_LIST", ascending="BOOLEAN", needs_order=True)
def sort_values(df: DataFrame, columns: str | list[str], ascending: object = True) -> DataFrame:
    """Rows sorted by the columns, all in one direction, missing last; ties keep their order.

    The sorted order becomes the order of rows: the ordinal is renewed where there is one.
    """
    columns = names(columns)
    need(df, columns, "Sort columns")
    out = df.orderBy(*[missing_last(c, truth(ascending)) for c in columns], *tie(df))
    return out.withColumn(ORD, F.monotonically_increasing_id()) if ORD in df.columns else out


@transform("slice_rows", df="DATAFRAME", start="INTEGER", stop="INTEGER", needs_order=True)
def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows from position start up to stop, as Python slices; negative positions count from the end."""
    hidden = ORD in df.columns
    start, stop = int(start or 0), None if stop is None else int(stop)
    df = ordered(df)
    if start < 0 and stop is None and -start <= O.SMALL:  # the last rows, without a count of all
        out = df.orderBy(F.col(ORD).desc()).limit(-start).orderBy(ORD)
    else:
        if start < 0 or (stop is not None and stop < 0):
            start, stop, _ = slice(start, stop).indices(df.count())
        if not start and stop is None:
            out = df.orderBy(ORD)
        elif stop is not None and stop <= O.SMALL:
            out = df.orderBy(ORD).offset(start).limit(max(0, stop - start))
        else:
            place = F.col("__pos")
            out = numbered(df, [F.col(ORD).asc()]).where((place >= start) & (F.lit(True) if stop is None else place < stop)).orderBy(place).drop("__pos")
    return out if hidden else out.drop(ORD)


@transform("sample_rows", df="DATAFRAME", n="INTEGER", fraction="FLOAT", seed="INTEGER")
def sample_rows(df: DataFrame, n: int | None = None, fraction: float | None = None, seed: int | None = None) -> DataFrame:
    """Exactly n rows, or that share of rows (halves to even); one row if neither is given."""
    if n is not None and fraction is not None:
        raise ValueError("give n or fraction, not both")
    if fraction is not None:
        n = round(float(fraction) * df.count())
    n = 1 if n is None else int(n)
    drawn = df.withColumn("__r", F.rand(random.randrange(2**31) if seed is None else int(seed)))
    if n <= O.SMALL:
        return drawn.orderBy("__r").limit(n).drop("__r")
    # rows below a threshold are in, those around it are drawn to make up the number
    total = df.count()
    share = min(1.0, n / max(1, total))
    border = (6 * (total * share * (1 - share)) ** 0.5 + 10) / max(1, total)
    sure = drawn.where(F.col("__r") < share - border)
    rest = first_rows(drawn.where((F.col("__r") >= share - border) & (F.col("__r") < share + border)).withColumn(ORD + "r", F.monotonically_increasing_id()), [F.col("__r"), F.col(ORD + "r")], n - sure.count(), O.SMALL)
    return sure.unionByName(rest.drop(ORD + "r")).drop("__r")


@transform("count_rows", output="INTEGER", df="DATAFRAME")
def count_rows(df: DataFrame) -> DataFrame:
    """One row with the number of rows."""
    return df.agg(F.count("*").alias("count"))


def clip_rows(df: DataFrame, most: int) -> DataFrame:
    """The first rows."""
    return slice_rows(df, 0, most)


def drop_empty_rows(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Rows with at least max(1, int((1 - threshold) * columns)) values."""
    own = [c for c in df.columns if c != ORD]
    filled: Column = F.lit(0)
    for c in own:
        filled = filled + col(c).isNotNull().cast("int")
    return df.filter(filled >= max(1, int((1 - threshold) * len(own))))


def drop_trailing_rows(df: DataFrame, identity_columns: list[str]) -> DataFrame:
    """Without the last run of rows in which all identity columns are empty."""
    need(df, identity_columns)
    hidden = ORD in df.columns
    df = ordered(df)
    any_filled = F.lit(False)
    for c in identity_columns:
        any_filled = any_filled | (col(c).isNotNull() & (F.trim(col(c).cast("string")) != ""))
    last = df.filter(any_filled).agg(F.max(ORD).alias("_last"))
    out = df.crossJoin(F.broadcast(last)).filter(F.col(ORD) <= F.col("_last")).drop("_last")
    return out if hidden else out.drop(ORD)
