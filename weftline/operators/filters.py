"""Row filters on one column; each can give the mask of its condition beside the result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftline.registry import transform
from weftline.semantics import ORD, col, is_number, is_time, kind, need, truth

Result = DataFrame | dict[str, DataFrame]


def _bound(df: DataFrame, column: str, value: object) -> Column:
    """A bound as a literal: a number, or, for times, nanoseconds since 1970 (a date or time too)."""
    t = kind(df, column)
    if is_time(t):
        if not isinstance(value, (dt.datetime, dt.date)):
            value = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(float(value)) // 1000)
        return F.lit(value.isoformat()).cast("timestamp_ntz")  # as text, so that no time zone comes in
    if not is_number(t) and not isinstance(t, T.BooleanType):
        raise TypeError(f"column {column} holds {t.simpleString()}, which can't be compared with a number")
    return F.lit(float(value))


def _side(df: DataFrame, column: str) -> Column:
    t = kind(df, column)
    if isinstance(t, T.TimestampType) or isinstance(t, T.DateType):
        return col(column).cast("timestamp_ntz")
    return col(column).cast("int") if isinstance(t, T.BooleanType) else col(column)


def _out(df: DataFrame, column: str, condition: Column, return_mask: object) -> Result:
    result = df.filter(condition)
    if not truth(return_mask):
        return result
    keep = [F.col(ORD)] if ORD in df.columns else []
    return {"result": result, "mask": df.select(*keep, F.coalesce(condition, F.lit(False)).alias(column))}


@transform("filter_less_than", df="DATAFRAME", column="COLUMN_NAME", value="FLOAT", return_mask="BOOLEAN")
def filter_less_than(df: DataFrame, column: str, value: object, return_mask: object = False) -> Result:
    """Rows below the bound; missing values drop out."""
    need(df, [column], "Column")
    return _out(df, column, _side(df, column) < _bound(df, column, value), return_mask)


@transform("filter_greater_than", df="DATAFRAME", column="COLUMN_NAME", value="FLOAT", return_mask="BOOLEAN")
def filter_greater_than(df: DataFrame, column: str, value: object, return_mask: object = False) -> Result:
    """Rows above the bound; missing values drop out."""
    need(df, [column], "Column")
    return _out(df, column, _side(df, column) > _bound(df, column, value), return_mask)


@transform("filter_in_range", df="DATAFRAME", column="COLUMN_NAME", min_value="FLOAT", max_value="FLOAT", return_mask="BOOLEAN")
def filter_in_range(df: DataFrame, column: str, min_value: object, max_value: object, return_mask: object = False) -> Result:
    """Rows from the lower to the upper bound, both included; missing values drop out."""
    need(df, [column], "Column")
    return _out(df, column, _side(df, column).between(_bound(df, column, min_value), _bound(df, column, max_value)), return_mask)


def _equals(df: DataFrame, column: str, value: object) -> Column | None:
    """The literal that the column is compared with; None if the value can't be one of its type."""
    t = kind(df, column)
    if is_number(t) or isinstance(t, T.BooleanType):
        text = str(value).strip().lower()
        if isinstance(t, T.BooleanType) and text in ("true", "false"):
            return F.lit(int(text == "true"))
        try:
            return F.lit(float(text))
        except ValueError:
            return None
    if is_time(t):
        return F.try_to_timestamp(F.lit(str(value))).cast("timestamp_ntz")
    return F.lit(str(value))


@transform("filter_equal", df="DATAFRAME", column="COLUMN_NAME", value="STRING", return_mask="BOOLEAN")
def filter_equal(df: DataFrame, column: str, value: object, return_mask: object = False) -> Result:
    """Rows equal to the value, read as the column's type; nothing if it can't be."""
    need(df, [column], "Column")
    v = _equals(df, column, value)
    return _out(df, column, F.lit(False) if v is None else _side(df, column) == v, return_mask)


@transform("filter_not_equal", df="DATAFRAME", column="COLUMN_NAME", value="STRING", return_mask="BOOLEAN")
def filter_not_equal(df: DataFrame, column: str, value: object, return_mask: object = False) -> Result:
    """Rows not equal to the value; missing ones stay."""
    need(df, [column], "Column")
    v = _equals(df, column, value)
    return _out(df, column, F.lit(True) if v is None else ~_side(df, column).eqNullSafe(v), return_mask)


def filter_by_keyword(df: DataFrame, column: str, keywords: list[str], exclude: bool = True) -> DataFrame:
    """Rows whose text holds none (or, not excluding, any) of the keywords, ignoring case; null holds none."""
    need(df, [column], "Column")
    found = F.lit(False)
    for k in keywords:
        found = found | F.coalesce(F.lower(col(column).cast("string")).contains(k.lower()), F.lit(False))
    return df.filter(~found if exclude else found)
