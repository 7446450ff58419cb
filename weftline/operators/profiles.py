"""Column-level data quality: exact profiles from value-count tables, and audits of recorded profiles.

A value-count table holds, for every column of a table, each value and the number of rows that have it.
A load changes it by signed counts: rows that came count +1, rows that went -1. Everything a profile
reports (null rate, distinct count, range, entropy, pattern violations, distance to an earlier load)
follows exactly from those counts, so a new load costs its own size, not that of the whole table.
All steps are sums by key with map-side combination; a value that a third of all rows share is one
partial sum per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from weftline.functions.ordered import block_of, previous

COUNT_COLUMNS = ["column_name", "column_type", "value", "n"]


def _as_value(column: Column, kind: T.DataType) -> Column:
    """The text of a value; floats without NaN, nested values as JSON."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        column = F.when(~F.isnan(column), column)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(column.isNotNull(), F.to_json(F.struct(column.alias("v"))))
    return F.hex(column) if isinstance(kind, T.BinaryType) else column.cast("string")


def value_counts(df: DataFrame, columns: list[str] | None = None, sign: int = 1, load: Column | None = None) -> DataFrame:
    """``column_name, column_type, value, n`` of a table: the delta of loading (or, sign -1, unloading) it.

    Texts are held whole, however long, as ranges and patterns are of the whole text. Null and NaN count under the value null. An empty table gives no rows.
    ``load`` tells which load brought a row; then there is one delta per load, with ``load`` as first column.
    """
    columns = df.columns if columns is None else columns
    if not columns:
        raise ValueError("no columns to profile")
    # by position, as a table may hold one name twice; grouped by number, as names and types in each row would be shuffled
    by = [load] if load is not None else []
    own = ["load"] if by else []
    flat = df.select(*(["*"] if columns == df.columns else columns), *by).toDF(*[f"c{n}" for n in range(len(columns))], *own)
    fields = flat.schema.fields[: len(columns)]
    kinds = list(dict.fromkeys((name, f.dataType.simpleString()) for name, f in zip(columns, fields)))
    each = [F.struct(F.lit(kinds.index((name, f.dataType.simpleString()))).alias("kind"), _as_value(F.col(f.name), f.dataType).alias("value")) for name, f in zip(columns, fields)]
    rows = flat.select(*own, F.explode(F.array(*each)).alias("x")).select(*own, "x.*")
    counts = rows.groupBy(*own, "kind", "value").agg((F.count("*") * sign).alias("n"))
    told = [F.array(*[F.lit(k[i]) for k in kinds])[F.col("kind")].alias(c) for i, c in enumerate(("column_name", "column_type"))]
    return counts.select(*own, *told, "value", "n")


def apply_delta(state: DataFrame | None, *deltas: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The state after signed deltas; counts that reach nought leave it. ``by``: columns that tell tables
    apart, where one state holds several."""
    out = None
    for d in ([state] if state is not None else []) + list(deltas):
        d = d.select(*by, *COUNT_COLUMNS)
        out = d if out is None else out.unionByName(d)
    return out.groupBy(*by, "column_name", "column_type", "value").agg(F.sum("n").alias("n")).where("n != 0")


class State:
    """Value counts kept in a folder: one set of signed counts per delivery, nothing is ever rewritten.

    A delivery costs its own size; profiles are sums over all deliveries. A delivery that is added again under its
    name replaces what it brought before, so that a job that is repeated counts nothing twice. A later
    session opens the same folder and goes on.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def add(self, delivery: str, deltas: DataFrame) -> State:
        """``deltas``: value counts with the same columns for all deliveries (load, and columns that tell tables apart)."""
        deltas.write.mode("overwrite").parquet(f"{self.folder}/delivery={delivery}")
        return self

    def deltas(self) -> DataFrame:
        return self.spark.read.parquet(self.folder).drop("delivery")

    def counts(self, by: tuple[str, ...] = ()) -> DataFrame:
        return apply_delta(None, self.deltas(), by=by)


INTS = ["tinyint", "smallint", "int", "bigint"]
FLOATS = ["float", "double"]


def profile(counts: DataFrame, patterns: dict[str, str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per column: row, null and distinct counts, null rate, range, entropy in bits, violations.

    ``patterns`` gives regular expressions that the values of a column should match; other columns have
    null violations, as none were looked for. A column of nothing but nulls has a null range and entropy 0. Entropy is over the values
    that aren't null. ``by``: columns that tell tables apart, where the counts are of several.
    """
    ok = F.lit(False)
    names: dict[str, list[str]] = {}
    for name, pattern in (patterns or {}).items():
        names.setdefault(pattern, []).append(name)
    for pattern, own in names.items():
        ok = ok | (F.col("column_name").isin(own) & F.col("value").isNotNull() & ~F.col("value").rlike(pattern))
    whole, real = F.expr("try_cast(value AS DECIMAL(38,0))"), F.expr("try_cast(value AS DOUBLE)")
    is_int, is_real = F.col("column_type").isin(INTS), F.col("column_type").isin(FLOATS)
    filled = F.col("value").isNotNull()
    agg = counts.groupBy(*by, "column_name", "column_type").agg(
        F.sum("n").cast("bigint").alias("row_count"),
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).cast("bigint").alias("null_count"),
        F.count("value").alias("distinct_count"),
        *[f(F.when(is_int, whole)).alias(f"{n}_i") for f, n in ((F.min, "min"), (F.max, "max"))],
        *[f(F.when(is_real, real)).alias(f"{n}_f") for f, n in ((F.min, "min"), (F.max, "max"))],
        *[f(F.when(~is_int & ~is_real, F.col("value"))).alias(f"{n}_s") for f, n in ((F.min, "min"), (F.max, "max"))],
        F.sum(F.when(filled, F.col("n") * F.log2(F.col("n").cast("double")))).alias("n_log_n"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).cast("bigint").alias("violations"),
    )
    full = F.col("row_count") - F.col("null_count")
    return agg.select(
        *by,
        "column_name",
        "column_type",
        "row_count",
        "null_count",
        (F.col("null_count") / F.expr("nullif(row_count, 0)")).alias("null_rate"),
        "distinct_count",
        *[F.coalesce(F.col(f"{n}_i").cast("string"), F.col(f"{n}_f").cast("string"), F.col(f"{n}_s")).alias(f"{n}_value") for n in ("min", "max")],
        F.when(full > 0, F.greatest(F.lit(0.0), F.log2(full.cast("double")) - F.col("n_log_n") / full)).otherwise(0.0).alias("entropy"),
        F.when(F.col("column_name").isin(list(patterns or {})), F.col("violations")).alias("violations"),
    )


def distribution_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """``column_name, distance, gained, lost`` between two states: the total variation distance of the
    shares of all values (null too), and the numbers of values that only the later or the earlier has."""

    def shares(counts: DataFrame, name: str) -> DataFrame:
        total = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
        return counts.join(total, "column_name").select("column_name", "value", (F.col("n") / F.col("total")).alias(name))

    b = shares(before, "p").withColumnsRenamed({"column_name": "cb", "value": "vb"})
    a = shares(after, "q")
    both = a.join(b, (a.column_name == b.cb) & a.value.eqNullSafe(b.vb), "full")
    return both.groupBy(F.coalesce("column_name", "cb").alias("column_name")).agg(
        (F.sum(F.abs(F.coalesce("q", F.lit(0.0)) - F.coalesce("p", F.lit(0.0)))) / 2).alias("distance"),
        F.count_if(F.col("p").isNull()).alias("gained"),
        F.count_if(F.col("q").isNull()).alias("lost"),
    )


def load_changes(deltas: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``column_name, load, before, distance, gained, lost`` of each load against the load before it.

    ``deltas`` are value counts with the ``load`` that brought them. What is compared is the rows of the
    two loads, as in ``distribution_change``, not the states after them, which would hold each other's rows.
    Rows of no known load are in no comparison; the first load has none before it.
    """
    keys = [*by, "column_name"]
    placed = deltas.where("load is not null").select(*keys, "load", "value", "n")
    order = Window.partitionBy(*keys).orderBy("load")  # the loads of one column, not their rows
    loads = placed.groupBy(*keys, "load").agg(F.sum("n").alias("total")).where("total != 0")
    loads = loads.select("*", F.lag("load").over(order).alias("before"), F.lead("load").over(order).alias("after"))
    # all loads of a value lie in one partition, at most one row for each, so that one shuffle is enough
    counts = placed.repartition(*keys, "value").groupBy(*keys, "value", "load").agg(F.sum("n").alias("n")).where("n != 0")
    shares = counts.join(F.broadcast(loads), [*keys, "load"]).withColumn("share", F.col("n") / F.col("total"))
    of_value = Window.partitionBy(*keys, "value").orderBy("load")
    was = F.when(F.lag("load").over(of_value) == F.col("before"), F.lag("share").over(of_value))
    stays = F.coalesce(F.lead("load").over(of_value) == F.col("after"), F.lit(False))
    both = shares.select(*keys, "load", "before", "after", "share", was.alias("was"), stays.alias("stays"))
    here = F.struct("load", "before", F.abs(F.col("share") - F.coalesce("was", F.lit(0.0))).alias("d"), F.col("was").isNull().alias("new"), F.lit(False).alias("gone"))
    next_load = F.struct(F.col("after").alias("load"), F.col("load").alias("before"), F.when(~F.col("stays"), F.abs("share")).alias("d"), F.lit(False).alias("new"), (~F.col("stays")).alias("gone"))
    sides = both.select(*keys, F.explode(F.array(here, next_load)).alias("x")).select(*keys, "x.*").where("load is not null and before is not null and d is not null")
    return sides.groupBy(*keys, "load", "before").agg((F.sum("d") / 2).alias("distance"), F.count_if("new").alias("gained"), F.count_if("gone").alias("lost"))


# --- audits of recorded profiles ---------------------------------------------------------------

RANGED = ["INTEGER", "FLOAT", "DATETIME"]
WHOLE_PATTERN = r"^[ \t]*[+-]?[0-9]+[ \t]*$"
REAL_PATTERN = r"^[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*$"
FACTOR, SHARE = 5, 0.25


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _bound(name: str) -> list[Column]:
    """A recorded bound as a whole number and as a real one, each null where it can't be read."""
    text = F.trim(F.col(name))
    is_real = F.col("data_type") == "FLOAT"
    return [
        F.when(~is_real & F.col(name).rlike(WHOLE_PATTERN), text.try_cast("decimal(38,0)")).alias(f"{name}_i"),
        F.when(is_real & F.col(name).rlike(REAL_PATTERN) | ~is_real & F.col(name).rlike(WHOLE_PATTERN), text.try_cast("double")).alias(f"{name}_f"),
    ]


def _above(a: str, b: str) -> Column:
    """Whether bound a lies above bound b; exact for whole numbers of up to 38 digits."""
    return F.coalesce(F.col(f"{a}_i") > F.col(f"{b}_i"), F.col(f"{a}_f") > F.col(f"{b}_f"))


def audit_loads(stats: DataFrame) -> DataFrame:
    """``dataset_id, load_no, reason`` of loads whose row_count is negative, or more than five times the
    previous load's or less than a fifth of it. Null counts are not compared."""
    loads = stats.select("dataset_id", "load_no", "row_count").distinct()
    p = previous(loads, ["dataset_id"], "load_no", ["row_count"])
    now, was = F.col("row_count"), F.col("prev.row_count")
    jump = (was >= 0) & (F.greatest(now, was) > FACTOR * F.least(now, was))
    return p.select("dataset_id", "load_no", F.when(now < 0, "negative row_count").when(jump, "row_count changed").alias("reason")).where("reason is not null")


def field_history(fields: DataFrame, stats: DataFrame) -> DataFrame:
    """The records of fields, once each, with their load's row_count and ``wrong``: the reason why a record
    can't be true of a load of that size, or null. Records whose load is missing or has a null or negative
    row_count have ``judged`` false."""
    # one shuffle serves the removal of repeats, the look at the load's size and the window that follows: rows of a
    # data set are cut by blocks of loads and by fields, and the sizes of its loads go to all of its cuts
    cuts = 16
    own = ["dataset_id", "load_no", "field_id", "data_type", "min_value", "max_value", "is_unique", "distinct_count", "null_count", "uniques"]
    records = fields.select(*own, F.lit(None).cast("bigint").alias("row_count"), F.lit(False).alias("_size"), F.pmod(F.xxhash64("field_id"), F.lit(cuts)).alias("_cut"))
    sizes = stats.select("dataset_id", "load_no", F.col("row_count").cast("bigint").alias("row_count"), F.lit(True).alias("_size"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cuts - 1).cast("bigint"))).alias("_cut")).where("dataset_id is not null and load_no is not null")
    both = records.unionByName(sizes, allowMissingColumns=True).withColumn("_block", block_of("load_no"))
    both = both.repartition("dataset_id", "_block", "_cut").distinct()
    load = Window.partitionBy("dataset_id", "_block", "_cut", "load_no")
    r = both.withColumn("row_count", F.max("row_count").over(load)).where("not _size").drop("_size").withColumn("judged", _yes(F.col("row_count") >= 0))
    r = r.select("*", *_bound("min_value"), *_bound("max_value"))
    n, full = F.col("row_count"), F.col("row_count") - F.col("null_count")
    ranged = F.col("data_type").isin(RANGED)
    unread = (F.col("min_value").isNotNull() & F.col("min_value_f").isNull()) | (F.col("max_value").isNotNull() & F.col("max_value_f").isNull())
    d = F.col("distinct_count")
    wrong = (
        F.when((F.col("null_count") < 0) | (F.col("null_count") > n), "impossible null_count")
        .when((d < -1) | (d > full), "impossible distinct_count")
        .when(F.col("is_unique") & (d >= 0) & (d < full), "not unique")
        .when(F.col("min_value").isNull() != F.col("max_value").isNull(), "one bound")
        .when(ranged & unread, "unreadable bound")
        .when(ranged & _above("min_value", "max_value"), "minimum above maximum")
    )
    return r.withColumn("wrong", F.when(F.col("judged"), wrong))


def audit_fields(fields: DataFrame, stats: DataFrame) -> DataFrame:
    """``dataset_id, load_no, field_id, reason`` of records that are wrong in themselves, or that differ
    from the field's record before by null share, distinct count, range or listed values.

    Nulls in any figure make the comparison that needs it pass. Loads are compared by a block-wise
    window, so a data set with a third of all loads is no single task.
    """
    r = field_history(fields, stats)
    kept = ["data_type", "row_count", "null_count", "distinct_count", "uniques", "judged", "wrong", "min_value_i", "min_value_f", "max_value_i", "max_value_f"]
    p = previous(r, ["dataset_id", "field_id", "_cut"], "load_no", kept)
    p = p.select("*", *[F.col(f"prev.{k}").alias(f"p_{k}") for k in kept])
    fit = F.col("judged") & F.col("wrong").isNull() & _yes(F.col("p_judged")) & F.col("p_wrong").isNull() & (F.col("data_type") == F.col("p_data_type"))
    shares = F.abs(F.col("null_count") / F.expr("nullif(row_count, 0)") - F.col("p_null_count") / F.expr("nullif(p_row_count, 0)"))
    d, pd = F.col("distinct_count"), F.col("p_distinct_count")
    apart = F.col("data_type").isin(RANGED) & (_yes(_above("min_value", "p_max_value")) | _yes(_above("p_min_value", "max_value")))
    values = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    u, pu = values(F.col("uniques")), values(F.col("p_uniques"))
    changed = (
        F.when(_yes(shares > SHARE), "null share changed")
        .when((d >= 1) & (pd >= 1) & (F.greatest(d, pd) > FACTOR * F.least(d, pd)), "distinct_count changed")
        .when(apart, "range moved")
        .when((F.size(u) > 0) & (F.size(pu) > 0) & ~F.arrays_overlap(u, pu), "no listed value in common")
    )
    reason = F.coalesce(F.col("wrong"), F.when(fit, changed))
    return p.select("dataset_id", "load_no", "field_id", reason.alias("reason")).where("reason is not null").distinct()


def audit(fields: DataFrame, stats: DataFrame) -> DataFrame:
    """Both audits as one table; ``field_id`` is ``*`` for findings on a load as a whole."""
    loads = audit_loads(stats).select("dataset_id", "load_no", F.lit("*").alias("field_id"), "reason")
    return loads.unionByName(audit_fields(fields, stats))
