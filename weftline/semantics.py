"""Rules on missing values, numbers and row order that all operators share.

NULL is the one missing value: NaN becomes NULL where data come in. Groups drop missing keys, joins match
them, sorts put them last in both directions, sums of nothing are 0. Arithmetic that ANSI mode would
refuse is guarded: x/0 is an infinity, 0/0 is NULL, overflow of whole numbers is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

ORD = "__ord"


def need(df: DataFrame, columns: list[str], what: str = "Columns") -> None:
    """Raise ValueError if a column is missing; columns are known without a job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} not found: {missing}; there are {visible(df)}")


def visible(df: DataFrame) -> list[str]:
    """The columns without the hidden ordinal."""
    return [c for c in df.columns if c != ORD]


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def clean(df: DataFrame) -> DataFrame:
    """NaN to NULL in all float columns; infinities stay."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def ordered(df: DataFrame) -> DataFrame:
    """``df`` with the hidden ordinal: as it has one, else the order in which its rows are stored.

    Rows of files are numbered by Spark's partitions of the scan, which keep the order within a file;
    where files must follow each other by name, read them with sources.readers, which numbers them so.
    """
    return df if ORD in df.columns else df.withColumn(ORD, F.monotonically_increasing_id())


def plain(df: DataFrame) -> DataFrame:
    return df.drop(ORD)


def missing_last(column: str, ascending: bool = True) -> Column:
    return col(column).asc_nulls_last() if ascending else col(column).desc_nulls_last()


def tie(df: DataFrame) -> list[Column]:
    return [F.col(ORD).asc()] if ORD in df.columns else []


def divided(n: Column, d: Column) -> Column:
    """n/d as doubles: an infinity where only d is 0, NULL where both are."""
    n, d = n.cast("double"), d.cast("double")
    inf = F.lit(float("inf"))
    return F.when(d == 0, F.when(n > 0, inf).when(n < 0, -inf)).otherwise(n / d)


def number(df: DataFrame, column: str) -> Column:
    """A column as a number, NULL where it can't be read as one."""
    t = kind(df, column)
    if is_number(t):
        return col(column)
    if isinstance(t, T.BooleanType):
        return col(column).cast("int")
    if is_time(t):
        return F.unix_micros(col(column).cast("timestamp")) * 1000
    return F.trim(col(column)).try_cast("double")


def truth(value: object) -> bool:
    if isinstance(value, str):
        return value.strip().lower() in ("true", "1", "yes")
    return bool(value)


def names(value: str | list[str] | None) -> list[str]:
    """A list of names: itself, one name, or text of comma-separated, possibly bracketed and quoted names."""
    if value is None:
        return []
    if isinstance(value, str):
        parts = value.strip().removeprefix("[").removesuffix("]").split(",")
        return [p for p in (x.strip().strip("'\"").strip() for x in parts) if p]
    return list(value)


#: Estimated bytes of a table from which exact ranks are found by sorted positions and not in one buffer.
LARGE_BYTES = 8 << 30


def is_large(df: DataFrame) -> bool:
    """Whether the optimizer estimates a table at LARGE_BYTES or more; takes no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= LARGE_BYTES
