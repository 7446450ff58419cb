"""Canonical keys of freely typed names, resolved once per distinct name."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.functions.names import TermResolver

MAX_TERMS = 50_000


def term_list(terms: DataFrame, most: int = MAX_TERMS) -> list[tuple[int, str, list[str] | None]]:
    """(id, term, aliases) of the canonical list; raises where it is longer than ``most`` entries.

    The list is what goes to every worker, so its size is checked before it is used.
    """
    rows = terms.select("term_id", "term", "aliases").where("term_id is not null and term is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the canonical list has more than {most} entries")
    return sorted((r.term_id, r.term, list(r.aliases) if r.aliases else None) for r in rows)


def resolve_values(values: DataFrame, terms: list[tuple[int, str, list[str] | None]]) -> DataFrame:
    """``value, term_id`` of every distinct value; 0 where it means no entry or nothing definite.

    ``values`` has a column value. Values are made distinct first (with map-side combination, so hot ones
    cost nothing), as matching is far dearer than hashing. Null values are left out.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolver = TermResolver(terms)
        for b in batches:
            names = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([resolver.resolve(x) for x in names], pa.int64())], names=["value", "term_id"])

    # names are few bytes but dear to match: spread them over all cores, which AQE would not
    names = values.select("value").where("value is not null").distinct()
    return names.repartition(2 * names.sparkSession.sparkContext.defaultParallelism).mapInArrow(match, "value string, term_id bigint")


def with_terms(entries: DataFrame, terms: list[tuple[int, str, list[str] | None]], column: str = "value") -> DataFrame:
    """``entries`` with the term_id that ``column`` means; 0 for null values too. A column term_id is replaced.

    The table of distinct values is joined back; Spark broadcasts it while it is small, and AQE splits the
    partition of a hot value where it isn't.
    """
    value, term = (next(n for n in (f"__{kind}{k}" for k in range(10**6)) if n not in entries.columns) for kind in ("value", "term"))
    found = resolve_values(entries.select(F.col(column).alias("value")), terms).toDF(value, term)
    joined = entries.join(found, entries[column] == found[value], "left")
    return joined.withColumn("term_id", F.coalesce(term, F.lit(0)).cast("bigint")).drop(value, term)


def with_keys(entries: DataFrame, terms: list[tuple[int, str, list[str] | None]], column: str) -> DataFrame:
    """``entries`` with ``key``: equal for names that mean the same term, or, meaning none, are equal."""
    keyed = with_terms(entries, terms, column)
    name = F.coalesce(F.col(column), F.lit(""))
    return keyed.withColumn("key", F.when(F.col("term_id") > 0, F.concat(F.lit("t"), F.col("term_id"))).otherwise(F.concat(F.lit("n"), name)))
