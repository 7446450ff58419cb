"""Cells of several labels as long 0/1 tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from weftline.registry import transform
from weftline.semantics import col, names, need

DELIMITERS = [",", ";", "|"]
CUT_OFF = 80
_PLAIN = {chr(n): unicodedata.normalize("NFKD", chr(n))[0] for n in range(0xE0, 0x180) if chr(n).islower()}
MARKED = ("".join(k for k, v in _PLAIN.items() if v.isascii()), "".join(v for v in _PLAIN.values() if v.isascii()))


def _delimiter(df: DataFrame, column: str) -> str:
    """The delimiter that is most frequent in the whole column."""
    c = F.coalesce(col(column).cast("string"), F.lit(""))
    row = df.agg(*[F.sum(F.length(c) - F.length(F.replace(c, F.lit(d)))).alias(str(n)) for n, d in enumerate(DELIMITERS)]).first()
    counts = [row[str(n)] or 0 for n in range(len(DELIMITERS))]
    return DELIMITERS[counts.index(max(counts))]


def _tokens(df: DataFrame, column: str, delimiter: str, lemmatise: Callable[[Column], Column] | None) -> Column:
    parts = F.split(F.lower(col(column).cast("string")), "\\" + delimiter)
    base = lemmatise or (lambda c: c)
    clean = F.transform(parts, lambda p: F.replace(F.translate(base(F.trim(p)), *MARKED), F.lit(","), F.lit(".")))
    return F.coalesce(F.array_distinct(F.filter(clean, lambda p: p != "")), F.array().cast("array<string>"))


def _binarize(df: DataFrame, column: str, tokens: Column, max_labels: int) -> DataFrame:
    own = [c for c in df.columns if c != column]
    held = df.select(*map(col, own), tokens.alias("_tokens"))
    top = held.select(F.explode("_tokens").alias("label")).groupBy("label").count().orderBy(F.desc("count"), "label").limit(int(max_labels)).collect()
    labels = [r.label for r in top]  # at most max_labels
    each = F.explode(F.array(*map(F.lit, labels)).cast("array<string>")).alias(column)
    return held.select(*map(col, own), "_tokens", each).select(*map(col, own), col(column), F.array_contains("_tokens", col(column)).cast("int").alias("value"))


@transform("nlp_binarize_labels_auto", df="DATAFRAME", column="COLUMN_NAME", max_labels="INTEGER")
def nlp_binarize_labels_auto(df: DataFrame, column: str, max_labels: int = 30, lemmatise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row and label with ``value`` 1 or 0, for the most frequent labels of the column.

    Cells are split at their most usual delimiter, small letters, without marks. ``lemmatise`` maps a label
    column to base forms; by default labels stay as they are. Null and empty cells have zeros.
    """
    need(df, [column], "Column")
    return _binarize(df, column, _tokens(df, column, _delimiter(df, column), lemmatise), max_labels)


def _closest(token: Column, hints: list[str], cut_off: float) -> Column:
    """The hint that is most like the token if it is like enough, else the token."""
    options = F.array(*[F.struct((100 * (1 - F.levenshtein(token, F.lit(h.lower())) / F.greatest(F.length(token), F.lit(max(1, len(h)))))).alias("s"), F.lit(-n).alias("n"), F.lit(h).alias("h")) for n, h in enumerate(hints)])
    best = F.array_max(options)
    return F.when(best["s"] >= cut_off, best["h"]).otherwise(token)


@transform("nlp_binarize_labels_hinted", df="DATAFRAME", column="COLUMN_NAME", hints="LIST", max_labels="INTEGER")
def nlp_binarize_labels_hinted(df: DataFrame, column: str, hints: str | list[str], max_labels: int = 30, cut_off: float = CUT_OFF) -> DataFrame:
    """As nlp_binarize_labels_auto, each label mapped to the most similar hint (a score of 80 or more of 100)."""
    need(df, [column], "Column")
    hints = names(hints)
    tokens = _tokens(df, column, _delimiter(df, column), None)
    if hints:
        tokens = F.array_distinct(F.transform(tokens, lambda t: _closest(t, hints, cut_off)))
    return _binarize(df, column, tokens, max_labels)
