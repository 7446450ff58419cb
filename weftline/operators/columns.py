"""Choosing, naming, labelling and reshaping of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftline.functions.ordered import fill_down
from weftline.registry import transform
from weftline.semantics import ORD, col, is_number, kind, names, need, ordered, visible


@transform("select_columns", df="DATAFRAME", columns="COLUMN_NAME_OR_LIST")
def select_columns(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """These columns, in this order."""
    columns = names(columns)
    need(df, columns)
    return df.select(*([F.col(ORD)] if ORD in df.columns else []), *map(col, columns))


@transform("drop_columns", df="DATAFRAME", columns="COLUMN_NAME_OR_LIST")
def drop_columns(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """All but these columns."""
    columns = names(columns)
    need(df, columns)
    return df.drop(*columns)


@transform("rename_column", df="DATAFRAME", old_name="COLUMN_NAME", new_name="STRING")
def rename_column(df: DataFrame, old_name: str, new_name: str) -> DataFrame:
    need(df, [old_name], "Column")
    return df.withColumnRenamed(old_name, new_name)


@transform("add_label", df="DATAFRAME", label="STRING", value="STRING")
def add_label(df: DataFrame, label: str, value: object) -> DataFrame:
    """A constant column; a column of that name must not exist."""
    if label in df.columns:
        raise ValueError(f"Column {label} already exists")
    return df.withColumn(label, F.lit(value))


def _common(df: DataFrame, columns: list[str]) -> str:
    """The type that holds the values of all columns: theirs if it is one, double for numbers, else string."""
    kinds = {kind(df, c).simpleString() for c in columns}
    if len(kinds) == 1:
        return kinds.pop()
    if all(is_number(kind(df, c)) for c in columns):
        whole = all(isinstance(kind(df, c), T.IntegralType) for c in columns)
        return "bigint" if whole else "double"
    return "string"


@transform("melt", df="DATAFRAME", id_columns="COLUMN_NAME_OR_LIST", value_columns="COLUMN_NAME_OR_LIST", var_name="STRING", value_name="STRING")
def melt(df: DataFrame, id_columns: str | list[str] | None = None, value_columns: str | list[str] | None = None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Wide to long: one row per row and value column, nulls kept; columns that are neither drop out.

    Without value columns all others than the id columns are taken. Values of different types are cast to
    one that holds them.
    """
    ids = names(id_columns)
    values = names(value_columns) or [c for c in visible(df) if c not in ids]
    need(df, ids + values)
    if not values:
        raise ValueError("no value columns")
    common = _common(df, values)
    keep = ([ORD] if ORD in df.columns else []) + ids
    cast = df.select(*map(col, keep), *[col(c).cast(common).alias(c) for c in values])
    return cast.unpivot([col(c) for c in keep], [col(c) for c in values], var_name or "variable", value_name or "value")


# --- cells of sheets -----------------------------------------------------------------------------


def known(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Renames the columns that exist, others are passed over."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def fill_forward(df: DataFrame, columns: list[str]) -> DataFrame:
    """Empty cells take the last value above them; rows are cut into blocks, so no task sees all of them."""
    hidden = ORD in df.columns
    out = fill_down(ordered(df), known(df, columns))
    return out if hidden else out.drop(ORD)


def replace_values(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    need(df, [column], "Column")
    c, out = col(column), col(column)
    for old, new in mapping.items():
        out = F.when(c.eqNullSafe(F.lit(old)), F.lit(new)).otherwise(out)
    return df.withColumn(column, out)


def clean_text(df: DataFrame, columns: list[str], strip: bool = True, lower: bool = False, remove_extra_spaces: bool = True) -> DataFrame:
    """Tidies text cells; null stays null."""

    def one(c: Column) -> Column:
        if remove_extra_spaces:
            c = F.regexp_replace(c, r"\s+", " ")
        c = F.trim(c) if strip else c
        return F.lower(c) if lower else c

    return df.withColumns({c: one(col(c)) for c in known(df, columns) if isinstance(kind(df, c), T.StringType)})


#: Rows that may become columns; a sheet has at most as many columns.
MOST_HEADS = 16_384

DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy", "dd.MM.yyyy", "dd-MM-yyyy", "MM/dd/yyyy", "M/d/yyyy", "yyyy/MM/dd", "yyyyMMdd"]


def cast_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts columns (float, int, datetime or date, else text); what can't be read becomes null."""
    out = {}
    for c in known(df, list(types)):
        to, text = types[c].lower(), F.trim(col(c).cast("string"))
        if to == "float":
            out[c] = text.try_cast("double")
        elif to == "int":
            out[c] = text.try_cast("double").try_cast("bigint")
        elif to in ("datetime", "date"):
            stamp = F.coalesce(text.try_cast("timestamp_ntz"), *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS])
            out[c] = stamp.cast("date") if to == "date" else stamp
        else:
            out[c] = col(c).cast("string")
    return df.withColumns(out)


def promote_header(df: DataFrame, row_index: int = 0) -> DataFrame:
    """The cells of a row become the names; it and the rows above go. One row comes to the driver."""
    hidden = ORD in df.columns
    df = ordered(df)
    head = df.orderBy(ORD).offset(row_index).limit(1).collect()
    if not head:
        raise ValueError(f"row {row_index} not found")
    own = visible(df)
    given = [str(head[0][c]).strip() if head[0][c] not in (None, "") else f"__col_{n}__" for n, c in enumerate(own)]
    fresh = unique(given)
    out = df.filter(F.col(ORD) > F.lit(head[0][ORD])).select(ORD, *[col(c).alias(f) for c, f in zip(own, fresh)])
    return out if hidden else out.drop(ORD)


def unique(given: list[str]) -> list[str]:
    """Names made unique by a number behind them."""
    seen: dict[str, int] = {}
    out: list[str] = []
    for g in given:
        name = g
        while name in seen:
            seen[g] += 1
            name = f"{g}_{seen[g]}"
        seen.setdefault(name, 0)
        out.append(name)
    return out


def flatten_header(df: DataFrame, start: int, end: int, separator: str = " ") -> DataFrame:
    """Several header rows become one: filled downwards, empty and unnamed parts and repeats left out.

    Only the header rows come to the driver.
    """
    hidden = ORD in df.columns
    df = ordered(df)
    rows = df.orderBy(ORD).offset(start).limit(end - start + 1).collect()
    own = visible(df)
    out_names = []
    for n, c in enumerate(own):
        parts: list[str] = []
        for r in rows:
            text = "" if r[c] is None else str(r[c]).strip()
            if text and text.lower() not in ("nan", "none") and not text.startswith("Unnamed") and (not parts or parts[-1] != text):
                parts.append(text)
        out_names.append(separator.join(parts) or f"col_{n}")
    out = df.filter(F.col(ORD) > F.lit(rows[-1][ORD])).select(ORD, *[col(c).alias(f) for c, f in zip(own, unique(out_names))])
    return out if hidden else out.drop(ORD)


def _turned(df: DataFrame, rest: list[str], name: str) -> tuple[DataFrame, list]:
    """The cells of ``rest`` with rows and columns exchanged: ``name`` holds the old columns, one column per row
    is named by its ordinal. As every row becomes a column, only tables of at most MOST_HEADS rows can be turned."""
    ords = [r[ORD] for r in df.select(ORD).orderBy(ORD).limit(MOST_HEADS + 1).collect()]
    if len(ords) > MOST_HEADS:
        raise ValueError(f"a table of more than {MOST_HEADS} rows can't be turned into columns")
    common = _common(df, rest)
    long = df.select(ORD, *[col(c).cast(common).alias(c) for c in rest]).unpivot([ORD], [col(c) for c in rest], name, "_v")
    wide = long.groupBy(name).pivot(ORD, ords).agg(F.first("_v")) if ords else long.select(name).distinct()
    return wide.orderBy(F.array_position(F.array(*map(F.lit, rest)), F.col(name))), ords


def transpose_table(df: DataFrame) -> DataFrame:
    """Rows and columns exchanged: a row per column in their order, columns 0, 1, … per row; names are dropped."""
    wide, ords = _turned(ordered(df), visible(df), "__name")
    return wide.select(*[col(str(o)).alias(str(n)) for n, o in enumerate(ords)])


def transpose_grid(df: DataFrame, observation_column_name: str = "observation") -> DataFrame:
    """The first column's cells become the columns, the other columns' names become rows."""
    hidden = ordered(df)
    own = visible(df)
    first, rest = own[0], own[1:]
    wide, ords = _turned(hidden, rest, observation_column_name)
    heads = {r[ORD]: r[first] for r in hidden.select(ORD, col(first)).collect()}  # as many as there are columns
    fresh = unique(["" if heads[o] is None else str(heads[o]) for o in ords])
    return wide.select(observation_column_name, *[col(str(o)).alias(f) for o, f in zip(ords, fresh)])
