"""Queries of the text problems, over whole tables and whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions.storage import written
from weftline.llm import canonical, harmful, lookalikes, packing, tokens

CAPACITY = 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- 2: look-alike texts --------------------------------------------------------------------------

LOOKED_AT = [("cell_references", "cell_ref_id", "detected_name"), ("node_specs", "node_key", "label"), ("input_specs", "input_key", "label")]


def _plain(spark: SparkSession, folder: str) -> DataFrame:
    names = [x for _, term, aliases in canonical.term_list(table(spark, folder, "column_terms")) for x in [term, *(aliases or [])]]
    parts = [lookalikes.with_plain(table(spark, folder, t), key, text, names).select(F.lit(t).alias("source_table"), "*") for t, key, text in LOOKED_AT]
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(spark, folder).where("not is_plain").select("source_table", "record_id").distinct()


def p2_plain(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its text in plain form, repeated rows once."""
    return _plain(spark, folder).select("source_table", "record_id", "plain").distinct()


# --- 4: free names ----------------------------------------------------------------------------------


def _named(spark: SparkSession, folder: str) -> tuple[DataFrame, list]:
    terms = canonical.term_list(table(spark, folder, "column_terms"))
    cells = table(spark, folder, "cell_references").select(F.lit("cell_references").alias("source_table"), F.col("cell_ref_id").alias("record_id"), F.lit(0).alias("entry_no"), F.col("semantic_name").alias("value"))
    maps = table(spark, folder, "spreadsheet_maps").select("map_id", F.posexplode("shared_column_vocabulary").alias("n", "value"))
    entries = cells.unionByName(maps.select(F.lit("spreadsheet_maps").alias("source_table"), F.col("map_id").alias("record_id"), (F.col("n") + 1).alias("entry_no"), "value"))
    return entries, terms


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    entries, terms = _named(spark, folder)
    free = entries.where(~F.col("value").isin([t for _, t, _ in terms]))
    return canonical.mapped(free, terms).select("source_table", "record_id", "entry_no", "term_id").distinct()


def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The names that mean no entry, with their number of entries (repeated rows once)."""
    entries, terms = _named(spark, folder)
    return canonical.unmatched(canonical.mapped(entries.distinct(), terms))


# --- 7 and 8: tokens and containers -------------------------------------------------------------------


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_column(table(spark, folder, "documents"))


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per source."""
    d = table(spark, folder, "documents")
    n = tokens.encode_column(d, output="n_tokens").withColumnRenamed("doc_id", "_id")
    return d.join(n, d.doc_id == n._id).groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each text, or of each piece of a text longer than one."""
    return packing.pack(tokens.encode_column(table(spark, folder, "documents"), output="n_tokens"), CAPACITY)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p8_containers(spark, folder), CAPACITY)


# --- 9: harmful content ---------------------------------------------------------------------------------


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "content_labels")
    files = reduce(DataFrame.unionByName, [spark.read.format("binaryFile").load(f"{folder}/{n}.parquet").select("path", "length", "modificationTime") for n in ("documents", "content_labels")])
    version = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("v")).first().v
    return harmful.score_documents(documents, harmful.saved_model(documents, labels, f"{version}"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).where("is_harmful").select("doc_id").distinct()


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).distinct()


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return harmful.rates(written(_scored(spark, folder).distinct(), "scores"))


def p9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out accuracy on the documents that several reviewers agree about."""
    return harmful.quality(table(spark, folder, "documents"), table(spark, folder, "content_labels"))


def queries() -> dict:
    own = [p2_found, p2_plain, p4_found, p4_unmatched, p7_ids, p7_counts, p8_containers, p8_fill, p9_found, p9_scores, p9_rates, p9_quality]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {}
