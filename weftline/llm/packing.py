"""Filling containers of fixed capacity with items that aren't split unless they exceed it.

Harmonic packing: items of a size in (capacity/(k+1), capacity/k] form class k, of which exactly k fit a
container, so each class fills its containers with a fixed number of items, and workers do so without
knowing of each other. Plain harmonic packing leaves the rest of each container empty; here the rest is
planned too. Sizes are whole numbers up to the capacity, so the histogram of sizes, a table of at most
``capacity`` rows whatever the data, holds all that a plan needs. The plan says, for runs of ranks of a
size, which containers they go to; each worker places its items by their rank within their size alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from weftline.functions.storage import written


@dataclass(frozen=True)
class Run:
    """Items of ``size`` with ranks from ``first`` up to ``stop``: ``per`` in each container from ``container`` on."""

    size: int
    first: int
    stop: int
    container: int
    per: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """The runs for a histogram of sizes (1 to capacity), and the number of containers.

    Classes are filled from the largest sizes down, k items a container; what is left in the containers of
    a pattern is filled with the largest smaller sizes that fit, in equal numbers for all of them.
    """
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("sizes must be from 1 to the capacity")
    left = {s: n for s, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    order = sorted(left, reverse=True)
    runs: list[Run] = []

    def take(size: int, per: int, at: int, many: int) -> None:
        n = per * many
        runs.append(Run(size, used[size], used[size] + n, at, per))
        used[size] += n
        left[size] -= n

    containers = 1
    for n, size in enumerate(order):
        while left[size]:
            k = capacity // size
            many = max(1, left[size] // k)
            per = min(k, left[size])
            take(size, per, containers, many)
            # (from which container, how many, space in each, place in the order of sizes)
            todo = [(containers, many, capacity - per * size, n + 1)]
            containers += many
            while todo:
                at, many, space, where = todo.pop()
                while where < len(order) and (order[where] > space or not left[order[where]]):
                    where += 1
                if where == len(order):
                    continue
                s = order[where]
                per = min(space // s, left[s] // many)
                if per:
                    take(s, per, at, many)
                    todo.append((at, many, space - per * s, where + 1 if per == space // s else where))
                else:  # too few for all: one each for the first ones
                    few = left[s]
                    take(s, 1, at, few)
                    todo += [(at, few, space - s, where), (at + few, many - few, space, where + 1)]
    return runs, containers - 1


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, piece_no, n_tokens``: items over the capacity cut into full pieces and a rest; others whole.

    ``sizes``: doc_id, n_tokens. Items of size 0 (and of a null size) are one piece of size 0.
    """
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    count = F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int")
    cut = sizes.select("doc_id", n.alias("whole"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece_no"))
    return cut.select("doc_id", "piece_no", F.least(F.lit(capacity), F.col("whole") - F.col("piece_no") * capacity).cast("int").alias("n_tokens"))


def pack(sizes: DataFrame, capacity: int = 1024, rows_per_cell: int = 500_000) -> DataFrame:
    """``doc_id, piece_no, n_tokens, container_id`` of every item or piece; containers count from 1.

    Items of no size take no space and go to container 1. Equal ids are separate items. Ranks within a
    size come from windows over (size, salt), with salts enough to keep a cell near ``rows_per_cell`` rows
    even if all items have one size, and from the running counts of the cells before.
    """
    items = written(pieces(sizes, capacity), "items")
    filled = items.where("n_tokens > 0")
    histogram = {r.n_tokens: r["count"] for r in filled.groupBy("n_tokens").count().collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity)
    salts = max(8, -(-max(histogram.values(), default=0) // rows_per_cell))
    salted = filled.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int"))
    cells = salted.groupBy("n_tokens", "salt").count()
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(F.col("n_tokens").alias("_n"), F.col("salt").alias("_s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece_no")) - 1)
    ranked = ranked.join(offsets, (F.col("n_tokens") == F.col("_n")) & (F.col("salt") == F.col("_s"))).select("doc_id", "piece_no", "n_tokens", (F.col("rank") + F.col("offset")).alias("rank"))
    by_size: dict[int, tuple[np.ndarray, ...]] = {}
    for s in histogram:
        own = sorted((r.first, r.container, r.per) for r in runs if r.size == s)
        by_size[s] = tuple(np.array(x, np.int64) for x in zip(*own))

    @F.pandas_udf("bigint")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(size), np.int64)
        values, ranks = size.to_numpy(), rank.to_numpy()
        for s in np.unique(values):
            mine = np.flatnonzero(values == s)
            first, at, per = by_size[int(s)]
            k = np.searchsorted(first, ranks[mine], "right") - 1
            out[mine] = at[k] + (ranks[mine] - first[k]) // per[k]
        return pd.Series(out)

    placed = ranked.select("doc_id", "piece_no", "n_tokens", container("n_tokens", "rank").alias("container_id"))
    return placed.unionByName(items.where("n_tokens = 0").withColumn("container_id", F.lit(1).cast("bigint")))


def fill(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: ``containers, items, tokens, least_containers, fill_rate`` of a packing."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    return per.agg(
        F.count_if(F.col("tokens") > 0).alias("containers"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.ceil(F.sum("tokens") / capacity), F.lit(0)).alias("least_containers"),
        (F.sum("tokens") / (F.expr("nullif(count_if(tokens > 0), 0)") * capacity)).alias("fill_rate"),
    )
