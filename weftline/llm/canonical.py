"""Freely entered values and the canonical entry that each means."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftline.operators.keys import resolve_values, term_list, with_terms

__all__ = ["mapped", "resolve_values", "term_list", "unmatched"]


def mapped(entries: DataFrame, terms: list[tuple[int, str, list[str] | None]]) -> DataFrame:
    """``entries`` (with a column value) and the term_id of each, 0 for none; null values are left out.

    Distinct values are matched once: by a multi-pattern automaton over names and aliases, whose longest
    mentions win, and what it leaves by token-set similarity (see weftline.functions.names). Blank values
    mean nothing. Ties between entries mean nothing definite.
    """
    return with_terms(entries.where("value is not null"), terms)


def unmatched(mapped_entries: DataFrame) -> DataFrame:
    """``value, n``: the values that mean no entry, and how many entries have each."""
    return mapped_entries.where("term_id = 0").groupBy("value").count().withColumnRenamed("count", "n")
