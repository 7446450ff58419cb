"""Arithmetic, ratios, distances, normalisation and binning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from weftline.functions.ordered import numbered
from weftline.registry import transform
from weftline.semantics import col, divided, is_large, kind, names, need, number


@transform("arithmetic_op", df="DATAFRAME", left_column="COLUMN_NAME", operator="STRING", right_column="COLUMN_NAME", constant="FLOAT", output_column="STRING")
def arithmetic_op(df: DataFrame, left_column: str, operator: str, right_column: str | None = None, constant: float | None = None, output_column: str = "result") -> DataFrame:
    """left ADD, SUB, PROD or DIV right (a column, or else a constant); text is read as numbers."""
    need(df, [c for c in (left_column, right_column) if c])
    if not right_column and constant is None:
        raise ValueError("give right_column or constant")
    a = number(df, left_column)
    b = number(df, right_column) if right_column else F.lit(float(constant))
    ops = {"ADD": F.try_add, "SUB": F.try_subtract, "PROD": F.try_multiply, "DIV": divided}
    if operator.upper() not in ops:
        raise ValueError(f"unsupported operator {operator}")
    return df.withColumn(output_column or "result", ops[operator.upper()](a, b))


@transform("calc_ratio", df="DATAFRAME", numerator_col="COLUMN_NAME", denominator_col="COLUMN_NAME")
def calc_ratio(df: DataFrame, numerator_col: str, denominator_col: str) -> DataFrame:
    """``ratio`` of two columns; an infinity where only the denominator is 0."""
    need(df, [numerator_col, denominator_col])
    return df.withColumn("ratio", divided(number(df, numerator_col), number(df, denominator_col)))


@transform("calc_distance", df="DATAFRAME", x_col="COLUMN_NAME", y_col="COLUMN_NAME", ref_x="FLOAT", ref_y="FLOAT", target_col="STRING")
def calc_distance(df: DataFrame, x_col: str, y_col: str, ref_x: float, ref_y: float, target_col: str = "distance") -> DataFrame:
    """The straight distance of each point from one point."""
    need(df, [x_col, y_col])
    dx, dy = number(df, x_col) - F.lit(float(ref_x)), number(df, y_col) - F.lit(float(ref_y))
    return df.withColumn(target_col or "distance", F.sqrt(dx * dx + dy * dy))


@transform("normalize_column", df="DATAFRAME", column="COLUMN_NAME", method="STRING", output_column="STRING")
def normalize_column(df: DataFrame, column: str, method: str = "minmax", output_column: str | None = None) -> DataFrame:
    """minmax to 0..1, or zscore; without spread every row is 0.

    The figures come from one aggregation, whose single row is joined to all rows.
    """
    need(df, [column], "Column")
    x = number(df, column).cast("double")
    method = method.lower()
    if method not in ("minmax", "zscore"):
        raise ValueError(f"Unsupported normalization method {method}")
    base, spread = (F.min(x), F.max(x) - F.min(x)) if method == "minmax" else (F.avg(x), F.stddev_samp(x))
    figures = df.agg(base.alias("_base"), spread.alias("_spread"))
    out = F.when(F.coalesce(F.col("_spread"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise((x - F.col("_base")) / F.col("_spread"))
    return df.crossJoin(F.broadcast(figures)).withColumn(output_column or f"{column}_norm", out).drop("_base", "_spread")


def _edges(df: DataFrame, column: str, bins: int, strategy: str) -> list[float]:
    x = number(df, column).cast("double")
    if strategy == "uniform":
        low, high = df.agg(F.min(x), F.max(x)).first()
        if low is None:
            return []
        if low == high:
            low, high = (low - 0.001 * abs(low), high + 0.001 * abs(high)) if low else (-0.001, 0.001)
        return [low + (high - low) * k / bins for k in range(bins + 1)]
    n = df.agg(F.count(x)).first()[0]
    if not n:
        return []
    # ranks that are whole numbers name one order statistic exactly
    ranks = [k * (n - 1) / bins for k in range(bins + 1)]
    ranks = [round(r) if abs(r - round(r)) < 1e-9 else r for r in ranks]
    if is_large(df):  # by sorted positions: one buffer would hold all distinct values
        near = sorted({int(k) for r in ranks for k in (r // 1, -(-r // 1))})
        own = numbered(df.select(x.alias("x")).where("x is not null"), [F.col("x").asc()])
        at = {r["__pos"]: r.x for r in own.where(F.col("__pos").isin(near)).collect()}
        return sorted({at[int(r // 1)] + (at[int(-(-r // 1))] - at[int(r // 1)]) * (r - r // 1) for r in ranks})
    got = df.agg(F.percentile(x, F.array(*[F.lit(min(1.0, r / (n - 1)) if n > 1 else 0.0) for r in ranks]))).first()[0]
    return sorted(set(got))


@transform("discretize", df="DATAFRAME", column="COLUMN_NAME", bins="INTEGER", strategy="STRING", output_column="STRING", labels="LIST")
def discretize(df: DataFrame, column: str, bins: int = 5, strategy: str = "uniform", output_column: str | None = None, labels: str | list[str] | None = None) -> DataFrame:
    """Bins of equal width or equal counts, as codes from 0 or as labels; right ends belong to a bin.

    A column of one value falls into the middle bin. Equal quantiles are one edge; with labels that is an
    error. Null stays null.
    """
    need(df, [column], "Column")
    bins, labels = int(bins), names(labels)
    if strategy not in ("uniform", "quantile"):
        raise ValueError(f"Unsupported strategy {strategy}")
    if labels and len(labels) != bins:
        raise ValueError(f"labels length {len(labels)} is not the number of bins {bins}")
    edges = _edges(df, column, bins, strategy)
    if labels and edges and len(edges) != bins + 1:
        raise ValueError("labels length is not the number of bins: some quantiles are equal")
    x = number(df, column).cast("double")
    code = F.lit(0)
    for e in edges[1:-1]:
        code = code + (x > F.lit(e)).cast("int")
    out = F.when(x.isNotNull(), code)
    if labels:
        out = F.when(x.isNotNull(), F.element_at(F.array(*map(F.lit, labels)), code + 1))
    return df.withColumn(output_column or f"{column}_bin", out)


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(kind(df, column), T.StringType)
