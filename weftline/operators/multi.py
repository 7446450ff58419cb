"""Joins and unions of several tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.registry import transform
from weftline.semantics import ORD, col, names, plain, visible

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def _operands(dfs: DataFrame | list[DataFrame] | dict[str, DataFrame] | None, named: dict[str, DataFrame]) -> dict[str, DataFrame]:
    out: dict[str, DataFrame] = {}
    if isinstance(dfs, dict):
        out |= dfs
    elif isinstance(dfs, DataFrame):
        out["dfs"] = dfs
    elif dfs:
        out |= {f"table_{n}": d for n, d in enumerate(dfs)}
    return out | {k: v for k, v in named.items() if v is not None}


@transform("join", dfs="DATAFRAME", on="COLUMN_NAME_OR_LIST", how="STRING")
def join(dfs: DataFrame | list[DataFrame] | dict[str, DataFrame] | None = None, on: str | list[str] | None = None, how: str = "inner", **named: DataFrame) -> DataFrame:
    """Equi-join of all tables from the left on; missing keys match missing keys.

    Without keys the columns that all tables share are the keys. Other columns that several tables have
    are renamed ``{column}_{table}``. Keys of different types are compared as text.
    """
    tables = {k: plain(d) for k, d in _operands(dfs, named).items()}
    if not tables:
        raise ValueError("No DataFrames to join")
    if len(tables) == 1:
        return next(iter(tables.values()))
    if how not in HOW:
        raise ValueError(f"unknown join {how}")
    keys = names(on)
    if not keys:
        keys = [c for c in next(iter(tables.values())).columns if all(c in d.columns for d in tables.values())]
        if not keys:
            raise ValueError("No common columns to join on")
    for name, d in tables.items():
        if missing := [k for k in keys if k not in d.columns]:
            raise ValueError(f"Join columns not found in {name}: {missing}")
    text = [k for k in keys if len({d.schema[k].dataType.simpleString() for d in tables.values()}) > 1]
    count: dict[str, int] = {}
    for d in tables.values():
        for c in d.columns:
            count[c] = count.get(c, 0) + (c not in keys)
    ready = []
    for name, d in tables.items():
        d = d.withColumns({k: col(k).cast("string") for k in text})
        ready.append(d.withColumnsRenamed({c: f"{c}_{name}" for c in d.columns if count[c] > 1}))

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnsRenamed({k: f"__r_{k}" for k in keys})
        cond = reduce(lambda x, y: x & y, [a[f"`{k}`"].eqNullSafe(b[f"`__r_{k}`"]) for k in keys])
        j = a.join(b, cond, HOW[how])
        pick = [(F.coalesce(col(k), col(f"__r_{k}")).alias(k) if how in ("right", "outer") else col(k)) if c == k else col(c) for c in a.columns for k in [c if c in keys else None]]
        return j.select(*pick, *[col(c) for c in b.columns if not c.startswith("__r_")])

    return reduce(two, ready)


def _fitted(tables: list[DataFrame]) -> list[DataFrame]:
    """Tables whose columns of one name have one type; text where types clash beyond widening."""
    kinds: dict[str, set[str]] = {}
    for d in tables:
        for f in d.schema:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    to = {c: ("double" if k <= numbers and k & {"float", "double"} else "bigint" if k <= numbers else "string") for c, k in kinds.items() if len(k) > 1}
    return [d.withColumns({c: col(c).cast(t) for c, t in to.items() if c in d.columns}) for d in tables]


@transform("union", dfs="DATAFRAME", ignore_index="BOOLEAN")
def union(dfs: DataFrame | list[DataFrame] | dict[str, DataFrame] | None = None, ignore_index: object = True, **named: DataFrame) -> DataFrame:
    """All rows of all tables by column name; columns that a table lacks are null. Nothing gives a table without rows
    and columns."""
    tables = [plain(d) for d in _operands(dfs, named).values()]
    if not tables:
        return SparkSession.active().range(0).select()
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _fitted(tables))


@transform("concat_partitions", partitioned="DICT")
def concat_partitions(partitioned: dict[str, DataFrame]) -> DataFrame:
    """All parts under each other in the order of their keys; ``__partition__`` counts them, 0.0, 1.0, …

    A part may be a function that gives it.
    """
    parts = []
    for n, key in enumerate(sorted(partitioned)):
        d = partitioned[key]
        parts.append(plain(d() if callable(d) and not isinstance(d, DataFrame) else d).withColumn("__partition__", F.lit(float(n))))
    if not parts:
        raise ValueError("No partitions")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _fitted(parts))


def common_columns(tables: list[DataFrame]) -> list[str]:
    return [c for c in visible(tables[0]) if all(c in d.columns for d in tables)]


__all__ = ["ORD", "common_columns", "concat_partitions", "join", "union"]
