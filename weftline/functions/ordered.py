"""Positions, windows and sums over one order of rows, without one task for all rows or for a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions.storage import written

BLOCK = 256
#: Rows that one task may sort out; more are found by their position.
SMALL = 100_000


def block_of(order: str, block: int = BLOCK) -> Column:
    return F.floor(F.col(order) / block)


def previous(df: DataFrame, keys: list[str], order: str, values: list[str], name: str = "prev", block: int = BLOCK) -> DataFrame:
    """``df`` with the struct ``name`` of ``order`` and ``values`` of the row before, or null.

    ``order`` is a whole number that is unique within ``keys``. A window over the keys alone would put
    all rows of a hot key into one task. Instead rows are cut into blocks of ``block`` consecutive order
    values, the window runs over (keys, block), and only the last row of each block, one in up to
    ``block`` rows, goes through a second window over the keys, to serve the next block's first row, which
    alone is joined. Rows with null keys are grouped together, rows of null order come first. A table that
    has the column ``_block`` already is not shuffled again if it is partitioned by it and some of the keys.
    """
    held = F.struct(order, *values)
    cut = df if "_block" in df.columns else df.withColumn("_block", block_of(order, block))
    inner = Window.partitionBy(*keys, "_block").orderBy(order)
    cut = cut.withColumn("_before", F.lag(held).over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    edges = cut.groupBy(*keys, "_block").agg(F.max_by(held, F.coalesce(F.col(order), F.lit(-(2**62)))).alias("_edge"))
    edges = edges.withColumn("_edge", F.lag("_edge").over(Window.partitionBy(*keys).orderBy("_block")))
    edges = edges.select(*_aliased(keys, "_k"), F.col("_block").alias("_kb"), "_edge").where("_edge is not null")
    first = cut.where("_first")
    joined = first.join(edges, first["_block"].eqNullSafe(F.col("_kb")) & _same(keys, "_k"), "left")
    own = [*[F.col(f"`{c}`") for c in df.columns if c != "_block"]]
    return joined.select(*own, F.col("_edge").alias(name)).unionByName(cut.where("not _first").select(*own, F.col("_before").alias(name)))


def with_order(df: DataFrame, column: str) -> DataFrame:
    """``df`` whose rows are in the order of a numeric column."""
    return df.withColumn("__ord", F.col(column))


def _between(value: Column, cuts: list[float], first: int = 0) -> Column:
    """How many cuts lie below a value, by binary search."""
    if not cuts:
        return F.lit(first)
    m = len(cuts) // 2
    return F.when(value <= cuts[m], _between(value, cuts[:m], first)).otherwise(_between(value, cuts[m + 1 :], first + m + 1))


def positions(df: DataFrame, order: str = "__ord", name: str = "__idx", buckets: int | None = None) -> DataFrame:
    """``df`` with the dense position of each row in the order of a numeric column, from 0.

    A window over everything would run in one task. Here the order is cut at approximate quantiles, rows are
    numbered within the cuts side by side, and the counts of the cuts, at most ``buckets`` of them (as many
    as shuffle partitions, if not given), are added up. Ties keep no certain order; give them another order column.
    """
    buckets = buckets or min(1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(df.select(order).approxQuantile(order, [k / buckets for k in range(1, buckets)], 0.5 / buckets)))
    cut = df.withColumn("_b", _between(F.col(order), cuts))
    sizes = {r["_b"]: r["count"] for r in cut.groupBy("_b").count().collect()}
    before, total = {}, 0
    for b in sorted(sizes):
        before[b] = total
        total += sizes[b]
    offset = F.create_map(*[x for b, n in before.items() for x in (F.lit(b), F.lit(n).cast("bigint"))])[F.col("_b")] if before else F.lit(0).cast("bigint")
    return cut.withColumn(name, offset + F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1).drop("_b")


def numbered(df: DataFrame, order: list[Column], name: str = "__pos") -> DataFrame:
    """``df`` with the dense position of each row, from 0, in any order of all rows without ties.

    The rows are sorted by range, side by side, and written once; the sizes of the sorted parts, one row each, tell
    where each part starts. For large parts of a table, where a limit would put all of them into one task.
    """
    rows = written(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__m", 33)  # the number of the part is in the upper bits
    sizes = {r.p: r["count"] for r in rows.groupBy(part.alias("p")).count().collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    starts = df.sparkSession.createDataFrame(before, "__p bigint, __start bigint")  # as many rows as tasks
    return rows.join(F.broadcast(starts), part == F.col("__p")).withColumn(name, F.col("__start") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__p", "__start")


def first_rows(df: DataFrame, order: list[Column], n: int, small: int = SMALL) -> DataFrame:
    """The first ``n`` rows in an order without ties; few in one task, many by their position."""
    if n <= small:
        return df.orderBy(*order).limit(n)
    return numbered(df, order).where(F.col("__pos") < n).orderBy("__pos").drop("__pos")


def _same(keys: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for n, k in enumerate(keys):
        out = out & F.col(f"`{k}`").eqNullSafe(F.col(f"{prefix}{n}"))
    return out


def _aliased(keys: list[str], prefix: str) -> list[Column]:
    return [F.col(f"`{k}`").alias(f"{prefix}{n}") for n, k in enumerate(keys)]


def positions_within(df: DataFrame, keys: list[str], order: str = "__ord", name: str = "__idx", size: int = 65_536) -> DataFrame:
    """``df`` with the dense position of each row among those of its keys; a hot key is numbered in blocks.

    Blocks are of the order of all rows, so the counts that are added up are one row per key and block.
    """
    cut = positions(df, order, "__g").withColumn("__b", F.floor(F.col("__g") / size))
    quoted = [F.col(f"`{k}`") for k in keys]
    counts = cut.groupBy(*quoted, "__b").count()
    before = Window.partitionBy(*quoted).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*_aliased(keys, "__k"), F.col("__b").alias("__kb"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    ranked = cut.withColumn("__n", F.row_number().over(Window.partitionBy(*quoted, "__b").orderBy("__g")) - 1)
    joined = ranked.join(starts, (F.col("__b") == F.col("__kb")) & _same(keys, "__k"))
    return joined.withColumn(name, F.col("__start") + F.col("__n")).drop("__g", "__b", "__n", "__kb", "__start", *[f"__k{n}" for n in range(len(keys))])


def framed(df: DataFrame, new: dict[str, "object"], before: int, after: int, order: str = "__ord", least: int = 65_536, keys: list[str] | None = None) -> DataFrame:
    """``df`` with columns over a frame of ``before`` rows up to ``after`` rows in one order of all rows, or of
    the rows of the same ``keys``.

    ``new`` maps names to functions of a window without a frame. Rows are cut into blocks by position, and
    each block also gets the few rows around it that its frames reach; blocks are independent tasks.
    """
    keys = keys or []
    size = max(least, 4 * (before + after + 1))
    at = F.col("__idx")
    home = F.floor(at / size)
    own = positions_within(df, keys, order) if keys else positions(df, order)
    reach = F.array_distinct(F.array(F.greatest(F.lit(0), F.floor((at - after) / size)), home, F.floor((at + before) / size)))
    spread = own.withColumn("__home", home).withColumn("__block", F.explode(reach))
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys], "__block").orderBy("__idx")
    out = spread.withColumns({name: f(w) for name, f in new.items()})
    return out.where("__block = __home").drop("__idx", "__home", "__block")


def running_sum(df: DataFrame, column: str, name: str, order: str = "__ord", size: int = 65_536, keys: list[str] | None = None) -> DataFrame:
    """``df`` with the sum of all values (of the same ``keys``) up to each row; missing values stay missing and
    count nothing. Blocks of rows are summed side by side, then their sums, one row per key and block."""
    keys = keys or []
    quoted = [F.col(f"`{k}`") for k in keys]
    own = positions(df, order).withColumn("__block", F.floor(F.col("__idx") / size))
    inside = F.sum(F.col(f"`{column}`")).over(Window.partitionBy(*quoted, "__block").orderBy("__idx").rowsBetween(Window.unboundedPreceding, 0))
    sums = own.groupBy(*quoted, "__block").agg(F.sum(F.col(f"`{column}`")).alias("_s"))
    earlier_rows = Window.partitionBy(*(quoted or [F.lit(0)])).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(*_aliased(keys, "_k"), F.col("__block").alias("_kb"), F.sum("_s").over(earlier_rows).alias("_e"))
    joined = own.withColumn("__inside", inside).join(earlier, (F.col("__block") == F.col("_kb")) & _same(keys, "_k"))
    total = F.coalesce("_e", F.lit(0)) + F.col("__inside")
    return joined.withColumn(name, F.when(F.col(f"`{column}`").isNotNull(), total)).drop("__idx", "__block", "__inside", "_kb", "_e", *[f"_k{n}" for n in range(len(keys))])


def fill_down(df: DataFrame, columns: list[str], order: str = "__ord", size: int = 65_536) -> DataFrame:
    """``df`` whose empty cells in these columns take the last value before them in the order of all rows."""
    own = positions(df, order).withColumn("__block", F.floor(F.col("__idx") / size))
    inside = Window.partitionBy("__block").orderBy("__idx").rowsBetween(Window.unboundedPreceding, 0)
    quoted = [F.col(f"`{c}`") for c in columns]
    ends = own.groupBy(F.col("__block").alias("_kb")).agg(*[F.max_by(c, F.when(c.isNotNull(), F.col("__idx"))).alias(f"_e{n}") for n, c in enumerate(quoted)])
    before = Window.orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    earlier = ends.select("_kb", *[F.last(f"_e{n}", ignorenulls=True).over(before).alias(f"_p{n}") for n in range(len(columns))])
    held = own.withColumns({f"__f{n}": F.last(c, ignorenulls=True).over(inside) for n, c in enumerate(quoted)})
    joined = held.join(earlier, F.col("__block") == F.col("_kb"))
    filled = joined.withColumns({c: F.coalesce(f"__f{n}", f"_p{n}") for n, c in enumerate(columns)})
    return filled.select(*[F.col(f"`{c}`") for c in df.columns])
