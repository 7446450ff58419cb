"""Aggregations: extremes, means, sums, medians, counts, and a rollup along a path of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from weftline.functions.ordered import running_sum
from weftline.registry import transform
from weftline.semantics import col, is_large, is_number, kind, names, need, number, visible


def _extreme(df: DataFrame | None, column: str | None, input_list: list | None, f: Callable, name: str) -> DataFrame:
    if df is not None and column:
        need(df, [column], "Column")
        value = col(column)
        if isinstance(kind(df, column), (T.FloatType, T.DoubleType)):
            value = F.when(~F.isnan(value), value)
        return df.agg(f(value).alias(name))
    if input_list is not None:
        numbers = [float(x) for x in (names(input_list) if isinstance(input_list, str) else input_list) if x is not None]
        spark = SparkSession.active()
        return spark.createDataFrame([(x,) for x in numbers], "value double").agg(f("value").alias(name))
    raise ValueError("give a DataFrame and a column, or a list")


@transform("calculate_min", output="FLOAT", df="DATAFRAME", column="COLUMN_NAME", input_list="LIST")
def calculate_min(df: DataFrame | None = None, column: str | None = None, input_list: list | None = None) -> DataFrame:
    """One row with the least value of a column or list; null if there is none."""
    return _extreme(df, column, input_list, F.min, "min")


@transform("calculate_max", output="FLOAT", df="DATAFRAME", column="COLUMN_NAME", input_list="LIST")
def calculate_max(df: DataFrame | None = None, column: str | None = None, input_list: list | None = None) -> DataFrame:
    """One row with the greatest value of a column or list; null if there is none."""
    return _extreme(df, column, input_list, F.max, "max")


def _numeric(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in visible(df) if c not in keys and (is_number(kind(df, c)) or isinstance(kind(df, c), T.BooleanType))]


def _grouped(df: DataFrame, group_columns: str | list[str] | None, suffix: str | None, f: Callable[[Column], Column]) -> DataFrame:
    keys = names(group_columns)
    need(df, keys, "Group columns")
    aggs = [f(number(df, c)).alias(c + (suffix or "")) for c in _numeric(df, keys)]
    if not keys:
        return df.agg(*aggs) if aggs else df.select().limit(0)
    full = df.dropna(subset=[f"`{k}`" if "." in k else k for k in keys])
    out = full.groupBy(*map(col, keys)).agg(*aggs) if aggs else full.select(*map(col, keys)).distinct()
    return out.orderBy(*map(col, keys))


@transform("aggregate_mean", df="DATAFRAME", group_columns="COLUMN_NAME_OR_LIST", suffix="STRING")
def aggregate_mean(df: DataFrame, group_columns: str | list[str] | None = None, suffix: str | None = None) -> DataFrame:
    """Means of all numeric columns per group, sorted by key; rows with a missing key drop out."""
    return _grouped(df, group_columns, suffix, F.avg)


@transform("aggregate_sum", df="DATAFRAME", group_columns="COLUMN_NAME_OR_LIST", suffix="STRING")
def aggregate_sum(df: DataFrame, group_columns: str | list[str] | None = None, suffix: str | None = None) -> DataFrame:
    """Sums of all numeric columns per group; a group of missing values sums to 0."""
    return _grouped(df, group_columns, suffix, lambda c: F.coalesce(F.try_sum(c), F.when(F.count(c) == 0, F.lit(0))))


@transform("aggregate_median", df="DATAFRAME", group_columns="COLUMN_NAME_OR_LIST", suffix="STRING")
def aggregate_median(df: DataFrame, group_columns: str | list[str] | None = None, suffix: str | None = None) -> DataFrame:
    """Exact medians of all numeric columns per group.

    Spark's median holds a group's distinct values and their counts in one buffer. Large tables (by the optimizer's
    estimate) go another way to the same result: values are counted, their counts summed up in the order of values
    by blocks, and the values at the middle ranks picked, so no task holds a group.
    """
    return _medians_by_rank(df, group_columns, suffix) if is_large(df) else _grouped(df, group_columns, suffix, F.median)


def _medians_by_rank(df: DataFrame, group_columns: str | list[str] | None, suffix: str | None) -> DataFrame:
    keys = names(group_columns)
    need(df, keys, "Group columns")
    full = df.dropna(subset=[f"`{k}`" if "." in k else k for k in keys]) if keys else df
    out = full.select(*map(col, keys)).distinct() if keys else None
    for c in _numeric(df, keys):
        values = full.select(*[col(k).alias(f"k{n}") for n, k in enumerate(keys)], number(df, c).cast("double").alias("v")).where("v is not null and not isnan(v)")
        own = [f"k{n}" for n in range(len(keys))]
        counts = values.groupBy(*own, "v").count()
        summed = running_sum(counts, "count", "upto", order="v", keys=own)
        total = counts.groupBy(*[F.col(k).alias(f"t{n}") for n, k in enumerate(own)]).agg(F.sum("count").alias("n"))
        same = F.lit(True)
        for n, k in enumerate(own):
            same = same & (F.col(k) == F.col(f"t{n}"))
        placed = summed.join(total, same) if own else summed.crossJoin(F.broadcast(total))  # one row
        middle = [F.min(F.when(F.col("upto") >= rank, F.col("v"))) for rank in (F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)]
        one = placed.groupBy(*own).agg(((middle[0] + middle[1]) / 2).alias("m")) if own else placed.agg(((middle[0] + middle[1]) / 2).alias("m"))
        name = c + (suffix or "")
        if out is None:
            out = one.select(F.col("m").alias(name))
        elif not keys:
            out = out.crossJoin(F.broadcast(one.select(F.col("m").alias(name))))  # one row each
        else:
            on = F.lit(True)
            for n, k in enumerate(keys):
                on = on & (out[f"`{k}`"] == one[f"k{n}"])
            out = out.join(one, on, "left").select(*[col(x) for x in out.columns], F.col("m").alias(name))
    if out is None:
        return df.select().limit(0)
    return out.orderBy(*map(col, keys)) if keys else out


def approximate_median(df: DataFrame, group_columns: str | list[str] | None = None, suffix: str | None = None, accuracy: int = 10_000) -> DataFrame:
    """As aggregate_median, by a mergeable sketch whose rank error is 1/accuracy."""
    return _grouped(df, group_columns, suffix, lambda c: F.percentile_approx(c.cast("double"), 0.5, accuracy))


@transform("aggregate_count", df="DATAFRAME", group_columns="COLUMN_NAME_OR_LIST")
def aggregate_count(df: DataFrame, group_columns: str | list[str] | None = None) -> DataFrame:
    """Rows per group as ``count``; without groups one row, 0 for an empty table."""
    keys = names(group_columns)
    need(df, keys, "Group columns")
    if not keys:
        return df.agg(F.count("*").alias("count"))
    return df.dropna(subset=[f"`{k}`" if "." in k else k for k in keys]).groupBy(*map(col, keys)).agg(F.count("*").alias("count")).orderBy(*map(col, keys))


@transform("hierarchical_rollup", df="DATAFRAME", path_columns="LIST", value_column="COLUMN_NAME", root_label="STRING")
def hierarchical_rollup(df: DataFrame, path_columns: str | list[str], value_column: str | None = None, root_label: str = "Total") -> DataFrame:
    """One row per node of the tree that the path columns span, the root first.

    ``target`` is the path joined by /, ``source`` its parent (the root's label for the first level, empty
    for the root), ``count`` the rows, ``value`` the sum of the value column (the count if there is none),
    then the sums of the numeric columns, ``{column}_sum`` but for the value column. Rows with a missing key
    drop out from its level on. One pass with grouping sets gives all levels and the root; an empty table gives
    no rows.
    """
    path = names(path_columns)
    if not path:
        raise ValueError("path_columns must be a non-empty list")
    need(df, path, "Path columns")
    if value_column:
        need(df, [value_column], "Value column")
    sums = _numeric(df, path)
    out_names = {c: c if c == value_column else f"{c}_sum" for c in sums}
    base = df.filter(col(path[0]).isNotNull()).select(*[col(p).cast("string").alias(f"p{n}") for n, p in enumerate(path)], *[number(df, c).alias(f"s{n}") for n, c in enumerate(sums)])
    # a level's key is missing from the first missing part on
    parts = [f"p{n}" for n in range(len(path))]
    sets = [[F.col(p) for p in parts[:n]] for n in range(len(path) + 1)]  # the empty one is the root
    g = base.groupingSets(sets, *parts).agg(
        F.grouping_id(*parts).alias("gid"),
        F.count("*").alias("count"),
        *[F.coalesce(F.sum(f"s{n}"), F.lit(0)).alias(f"s{n}") for n in range(len(sums))],
    )
    depth = F.lit(0)
    whole = F.col("gid") == (1 << len(path)) - 1
    for n in range(len(path)):
        here = F.col("gid") == (1 << (len(path) - n - 1)) - 1
        depth = F.when(here, n + 1).otherwise(depth)
        filled = F.lit(True)
        for p in parts[: n + 1]:
            filled = filled & F.col(p).isNotNull()
        whole = whole | (here & filled)
    g = g.withColumn("depth", depth).filter(whole)
    up = F.lit(root_label)
    for n in range(1, len(path)):
        up = F.when(F.col("depth") == n + 1, F.concat_ws("/", *parts[:n])).otherwise(up)
    v = F.col(f"s{sums.index(value_column)}") if value_column in sums else F.col("count")
    at_root = F.col("depth") == 0
    target = F.when(at_root, F.lit(root_label)).otherwise(F.concat_ws("/", *parts))
    source = F.when(at_root, F.lit("")).otherwise(up)
    nodes = g.select(target.alias("target"), source.alias("source"), "count", v.alias("value"), *[F.col(f"s{n}").alias(out_names[c]) for n, c in enumerate(sums)], "depth", *parts)
    # equal paths of different depth or spelling: the first one stays
    own = ["source", "count", "value", *[out_names[c] for c in sums]]
    nodes = nodes.groupBy("target").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in own], "depth"), F.struct("depth", *parts)).alias("n"))
    return nodes.orderBy("n.depth", "target").select("target", *[F.col(f"n.`{c}`").alias(c) for c in own])
