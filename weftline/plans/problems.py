"""Queries of the general data-quality problems, over whole tables."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions.storage import shared_folder, side_by_side, written
from weftline.operators import badrows, drift, orphans, profiles
from weftline.operators.keys import term_list, with_keys


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- 1: rows that fail to parse -----------------------------------------------------------------


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return badrows.rejects(table(spark, folder, "csv_lines"), table(spark, folder, "csv_characterizations")).select("file_id", "line_no")


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Rejects per kind of reason and file count."""
    r = badrows.rejects(table(spark, folder, "csv_lines"), table(spark, folder, "csv_characterizations"))
    kind = F.split_part("reason", F.lit(":"), F.lit(1))
    return r.groupBy(kind.alias("reason")).agg(F.count("*").alias("lines"), F.count_distinct("file_id").alias("files"))


def p1_values(spark: SparkSession, folder: str) -> DataFrame:
    """The valid rows, typed: one row per value."""
    c = table(spark, folder, "csv_characterizations")
    return badrows.value_lines(badrows.parse_lines(table(spark, folder, "csv_lines"), c), c)


# --- 3: column-level profiles ---------------------------------------------------------------------


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.audit(table(spark, folder, "field_metadata"), table(spark, folder, "dataset_stats")).select("dataset_id", "load_no", "field_id")


PROFILED = ["cell_references", "spreadsheet_maps", "input_specs", "node_specs", "output_port_specs", "input_port_specs", "dataset_stats", "field_metadata", "csv_lines", "documents"]
PATTERNS = {"input_id": r"^\d+$", "data_type": r"^[A-Za-z]+$", "col_idx": r"^[A-Z]+$", "lang": r"^[a-z]{2}$", "last_updated": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"}


SNAKE, DIGITS, SMALL, LARGE = r"^[a-z]+(_[a-z]+)*\z", r"^[0-9]+\z", r"^[a-z]+\z", r"^[A-Z]+\z"
# Free text: something to be seen, and no control or replacement characters but tabs and line ends.
READABLE = r"^(?=[\s\S]*?[^\s\p{Z}])[^\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}]*+\z"
PATTERNS |= dict.fromkeys(["semantic_name", "detected_name", "label", "static_value", "raw_line", "text", "target_text"], READABLE)
PATTERNS |= dict.fromkeys(["node_type", "port_name", "dataset_name", "field_name", "source"], SNAKE)
PATTERNS |= dict.fromkeys(["node_id", "field_id"], DIGITS) | {"zone_kind": SMALL} | dict.fromkeys(["file_format", "port_type"], LARGE)
PATTERNS |= dict.fromkeys(["min_value", "max_value"], profiles.REAL_PATTERN)
PATTERNS |= {
    "table_id": r"^[a-z]+_[0-9]+\z",
    "file_name": r"^[a-z]+(_[a-z]+)*_[0-9]+\.[a-z]+\z",
    "location_path": r"^([a-z]+/)+[a-z0-9_]+\.[a-z0-9]+\z",
    "url": r"^https?://[^\s/]+(/\S*)?\z",
    "units": r"^\S+\z",
    "uniques": r"^[^,]+(,[^,]+)*\z",
    "target_lang": PATTERNS["lang"],
}


# What counts as one load of a table; of the others it is the month of loaded_at, as yyyymm.
LOADS = {"cell_references": "period_no", "spreadsheet_maps": "period_no", "dataset_stats": "load_no", "field_metadata": "load_no"}


def _value_counts(spark: SparkSession, folder: str) -> profiles.State:
    """The signed value counts that each load brought to each column of the large tables, kept in the shared folder."""
    state = profiles.State(spark, f"{shared_folder(spark).rstrip('/')}/value-counts-{uuid.uuid4().hex}")

    def deliver(name: str, deltas: DataFrame) -> None:
        state.add(name, deltas)

    parts = []
    for name in PROFILED:
        rows = table(spark, folder, name)
        columns = rows.columns
        if name == "cell_references":
            rows = rows.join(table(spark, folder, "spreadsheet_maps").groupBy("map_id").agg(F.min("period_no").alias("period_no")), "map_id", "left")
        load = F.col(LOADS[name]) if name in LOADS else F.year("loaded_at") * 100 + F.month("loaded_at")
        parts.append((name, profiles.value_counts(rows, columns, load=load.cast("int")).select(F.lit(name).alias("table_name"), "*")))
    side_by_side(*[partial(deliver, name, deltas) for name, deltas in parts])
    return state


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    by = ("table_name",)
    return profiles.profile(_value_counts(spark, folder).counts(by), PATTERNS, by)


def p3_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of every column of the large tables."""
    return _profiles(spark, folder).withColumns({c: F.round(c, 4) for c in ("null_rate", "entropy")})


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of the profiles alone."""
    return _profiles(spark, folder).select("table_name", "column_name", "row_count", "null_count", "distinct_count", F.round("entropy", 4).alias("entropy"))


PROFILED_COLUMNS = {
    "cell_references": "cell_ref_id map_id workspace_id table_id col_idx detected_name semantic_name data_type zone_kind loaded_at",
    "spreadsheet_maps": "map_id workspace_id series_id file_name period_no period_start sheet_global_context shared_column_vocabulary loaded_at",
    "input_specs": "input_key graph_id workspace_id input_id label location_path file_format visibility url loaded_at deleted_at",
    "node_specs": "node_key graph_id node_id label node_type loaded_at",
    "output_port_specs": "output_key graph_id node_id output_id port_name label port_type visibility loaded_at deleted_at",
    "input_port_specs": "port_key graph_id node_id port_name static_value source_ref port_type loaded_at",
    "dataset_stats": "dataset_id load_no workspace_id dataset_name row_count last_updated loaded_at",
    "field_metadata": "dataset_id load_no field_id field_name data_type min_value max_value is_unique units distinct_count null_count uniques loaded_at",
    "csv_lines": "file_id line_no raw_line loaded_at",
    "documents": "doc_id text lang source n_chars target_text target_lang align_score bitext_id segment_no loaded_at",
}


def _counts_sql() -> str:
    one = """SELECT '{t}' AS table_name, '{c}' AS column_name, sum(n)::BIGINT AS row_count,
      coalesce(sum(n) FILTER (v IS NULL), 0)::BIGINT AS null_count, count(v)::BIGINT AS distinct_count,
      round(coalesce(greatest(0, log2(nullif(sum(n) FILTER (v IS NOT NULL), 0)::DOUBLE) - sum(n * log2(n)) FILTER (v IS NOT NULL) / nullif(sum(n) FILTER (v IS NOT NULL), 0)), 0), 4) AS entropy
      FROM (SELECT {c} AS v, count(*) AS n FROM {t} GROUP BY 1)"""
    return "\nUNION ALL\n".join(one.format(t=t, c=c) for t, cs in PROFILED_COLUMNS.items() for c in cs.split())


def _profile_sql() -> str:
    """Profiles with ranges, types and violations, from the tables themselves."""
    parts = []
    for name, columns in PROFILED_COLUMNS.items():
        for c in columns.split():
            pattern = PATTERNS.get(c)
            if pattern is None:
                bad = "NULL::BIGINT"
            elif pattern == READABLE:  # the pattern looks ahead, which this SQL's expressions can't
                seen, control = r"[^\s\p{Z}]", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{FFFD}]"
                bad = f"count(*) FILTER ({c} IS NOT NULL AND NOT (regexp_matches({c}, '{seen}') AND NOT regexp_matches({c}, '{control}')))"
            else:
                java = pattern.replace("$", r"\n?\z").replace("'", "''")
                bad = f"count(*) FILTER ({c} IS NOT NULL AND NOT regexp_matches({c}, '{java}'))"
            text = f"CASE WHEN {c} IS NULL THEN NULL WHEN typeof({c}) LIKE '%[]' THEN to_json({{'v': {c}}})::VARCHAR ELSE {c}::VARCHAR END"
            bounds = [f"CASE WHEN any_value(typeof({c})) LIKE '%[]' THEN {f}({text}) ELSE {f}({c})::VARCHAR END" for f in ("min", "max")]
            kind = "CASE any_value(typeof({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR[]' THEN 'array<string>' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END".format(c=c)
            parts.append(
                f"""SELECT '{name}' AS table_name, '{c}' AS column_name, {kind} AS column_type, count(*) AS row_count, count(*) - count({c}) AS null_count,
                round((count(*) - count({c})) / count(*), 4) AS null_rate, count(DISTINCT {c}) AS distinct_count, {bounds[0]} AS min_value, {bounds[1]} AS max_value,
                round(coalesce(entropy({c}), 0), 4) AS entropy, {bad} AS violations FROM {name}"""
            )
    return "\nUNION ALL\n".join(parts)


def p3_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of every column of the large tables between each load and the load before.

    A load is a period of the files, a load_no of the data sets, or the month of loaded_at.
    """
    return profiles.load_changes(_value_counts(spark, folder).deltas(), ("table_name",))


# --- 5: schemas that drift --------------------------------------------------------------------------


def _columns(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    terms = term_list(table(spark, folder, "column_terms"))
    files = table(spark, folder, "spreadsheet_maps").select(F.col("map_id").alias("file_id"), "series_id", "period_no").distinct()
    cells = table(spark, folder, "cell_references").select("cell_ref_id", "map_id", "table_id", "col_idx", "semantic_name", "data_type").distinct()
    place = F.concat_ws("/", "table_id", F.lpad(F.col("col_idx"), 8, " "))
    keyed = with_keys(cells, terms, "semantic_name")
    columns = keyed.select(F.col("cell_ref_id").alias("column_id"), F.col("map_id").alias("file_id"), "key", F.col("semantic_name").alias("name"), "data_type", place.alias("position"))
    return written(files, "files"), written(columns, "columns")  # read several times, so names are matched once


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    log = drift.changes(*_columns(spark, folder))
    return log.select(F.col("file_id").alias("map_id"), "change_kind", F.col("column_id").alias("cell_ref_id"))


def p5_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes per series and kind."""
    files, columns = _columns(spark, folder)
    log = drift.changes(files, columns).join(files, "file_id")
    return log.groupBy("series_id", "change_kind").agg(F.count("*").alias("changes"), F.count_distinct("file_id").alias("files"))


def p5_schema(spark: SparkSession, folder: str) -> DataFrame:
    """The one consistent table of each series: its columns with the type that holds all files' values."""
    files, columns = _columns(spark, folder)
    return drift.union_schema(columns.join(files.where("series_id is not null"), "file_id"))


def _drifting(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The loads of dataset_stats as files of three shapes: as they are, a column renamed, added and of another
    type, and as text without one column."""
    base = f"{shared_folder(spark).rstrip('/')}/drifting-{uuid.uuid4().hex}"
    stats = table(spark, folder, "dataset_stats").select("dataset_id", "load_no", "row_count")
    third = F.col("dataset_id") % 3
    shapes = [stats.where(third == 0), stats.where(third == 1).select("dataset_id", (F.col("load_no") + 0.5).alias("load"), "row_count", F.lit(True).alias("checked")), stats.where(third == 2).select("dataset_id", "load_no")]
    for n, df in enumerate(shapes):
        (df.write.option("header", True).csv if n == 2 else df.write.parquet)(f"{base}/{n}")
    paths = [f for n in range(3) for f in sorted((spark.read.text if n == 2 else spark.read.parquet)(f"{base}/{n}").inputFiles())]
    return drift.read_drifting(spark, paths, {"load": "load_no"})


def p5_read(spark: SparkSession, folder: str) -> DataFrame:
    """Files of different shapes as one table in the union schema."""
    return _drifting(spark, folder)[0].drop("file_path")


def p5_log(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of change between such files."""
    return _drifting(spark, folder)[1].select("change_kind", "key").distinct()


# --- 6: references to records that do not exist ------------------------------------------------------


def _orphans(spark: SparkSession, folder: str) -> orphans.Orphans:
    ports = table(spark, folder, "input_port_specs").where("source_ref is not null")
    refs = ports.select(F.col("port_key").alias("ref_id"), F.col("graph_id").alias("scope"), F.col("source_ref").alias("key"), F.col("loaded_at").alias("at"))
    inputs = table(spark, folder, "input_specs")
    number = F.when(F.trim("input_id").rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.regexp_replace(F.trim("input_id"), r"\..*$", "").try_cast("bigint"))
    outputs = table(spark, folder, "output_port_specs")
    pick = ["scope", "key", "since", "until"]
    parents = (
        inputs.select(F.col("graph_id"), number, "loaded_at", "deleted_at").toDF(*pick)
        .unionByName(outputs.select("graph_id", "output_id", "loaded_at", "deleted_at").toDF(*pick))
        .where("key is not null")
    )
    return orphans.replay(refs, parents, "month", 4)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).log.where("event = 'opened'").select(F.col("ref_id").alias("port_key")).distinct()


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events of orphan references per table and month."""
    return orphans.counts(_orphans(spark, folder).log, "input_port_specs")


def queries() -> dict:
    own = [p1_found, p1_reasons, p1_values, p3_found, p3_profile, p3_counts, p3_changes, p5_found, p5_changes, p5_schema, p5_read, p5_log, p6_found, p6_counts]
    return {f.__name__: f for f in own}


def _orphan_counts_sql() -> str:
    return r"""
      WITH ref AS (SELECT port_key, graph_id AS g, source_ref AS k, min(loaded_at) AS seen FROM input_port_specs WHERE source_ref IS NOT NULL GROUP BY ALL),
      parent AS (SELECT g, k, u, min(s) AS s FROM (
          SELECT graph_id AS g, TRY_CAST(regexp_replace(trim(input_id), '\..*$', '') AS BIGINT) AS k, loaded_at AS s, deleted_at AS u FROM input_specs
          UNION ALL SELECT graph_id, output_id, loaded_at, deleted_at FROM output_port_specs) WHERE g IS NOT NULL AND k IS NOT NULL GROUP BY ALL),
      lived AS (SELECT * FROM parent WHERE u IS NULL OR u > s),
      starts AS (SELECT DISTINCT g, k, s AS t FROM lived a WHERE NOT EXISTS (SELECT 1 FROM lived b WHERE b.g = a.g AND b.k = a.k AND b.s < a.s AND (b.u IS NULL OR b.u >= a.s))),
      stops AS (SELECT DISTINCT g, k, u AS t FROM lived a WHERE u IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lived b WHERE b.g = a.g AND b.k = a.k AND b.s <= a.u AND (b.u IS NULL OR b.u > a.u))),
      log AS (
        SELECT seen AS t, 'opened' AS event FROM ref WHERE NOT EXISTS (SELECT 1 FROM parent p WHERE p.g = ref.g AND p.k = ref.k AND p.s <= ref.seen AND (p.u IS NULL OR p.u > ref.seen))
        UNION ALL SELECT t, 'resolved' FROM ref JOIN starts USING (g, k) WHERE t > seen
        UNION ALL SELECT t, 'reopened' FROM ref JOIN stops USING (g, k) WHERE t > seen)
      SELECT 'input_port_specs' AS source_table, date_trunc('month', t) AS period, count(*) FILTER (event = 'opened') AS opened,
        count(*) FILTER (event = 'resolved') AS resolved, count(*) FILTER (event = 'reopened') AS reopened FROM log GROUP BY 2"""


REAL = r"'^[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*$'"
WHOLE = r"'^[ \t]*[+-]?[0-9]+[ \t]*$'"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_counts": _counts_sql(),
        "p3_profile": _profile_sql(),
        "p5_read": """SELECT dataset_id::VARCHAR AS dataset_id, CASE WHEN dataset_id % 3 = 1 THEN (load_no + 0.5)::VARCHAR ELSE load_no::VARCHAR END AS load_no,
            CASE WHEN dataset_id % 3 <> 2 THEN row_count END AS row_count, CASE WHEN dataset_id % 3 = 1 THEN true END AS checked FROM dataset_stats""",
        "p5_log": "SELECT * FROM (VALUES ('renamed', 'load_no'), ('retyped', 'load_no'), ('added', 'checked'), ('removed', 'checked'), ('removed', 'row_count'), ('retyped', 'dataset_id')) AS x(change_kind, key)",
        "p6_counts": _orphan_counts_sql(),
        "p6_found": r"""
            WITH port AS (SELECT port_key, graph_id, source_ref, min(loaded_at) AS at FROM input_port_specs WHERE source_ref IS NOT NULL GROUP BY ALL),
            parent AS (
              SELECT graph_id, TRY_CAST(regexp_replace(trim(input_id), '\..*$', '') AS BIGINT) AS id, loaded_at, deleted_at FROM input_specs
              UNION ALL SELECT graph_id, output_id, loaded_at, deleted_at FROM output_port_specs)
            SELECT DISTINCT port_key FROM port WHERE NOT EXISTS (
              SELECT 1 FROM parent WHERE parent.graph_id = port.graph_id AND parent.id = port.source_ref
              AND parent.loaded_at <= port.at AND (parent.deleted_at IS NULL OR parent.deleted_at > port.at))""",
        "p3_found": f"""
            WITH load AS (SELECT DISTINCT dataset_id, load_no, row_count FROM dataset_stats),
            jump AS (SELECT *, lag(row_count) OVER (PARTITION BY dataset_id ORDER BY load_no) AS p FROM load),
            f0 AS (SELECT DISTINCT dataset_id, load_no, field_id, data_type, min_value, max_value, is_unique, distinct_count d, null_count nc, uniques FROM field_metadata),
            f1 AS (SELECT f0.*, row_count n,
                CASE WHEN data_type = 'FLOAT' THEN CASE WHEN regexp_matches(min_value, {REAL}) THEN TRY_CAST(trim(min_value) AS DOUBLE) END
                     WHEN regexp_matches(min_value, {WHOLE}) THEN TRY_CAST(trim(min_value) AS DOUBLE) END AS lo,
                CASE WHEN data_type = 'FLOAT' THEN CASE WHEN regexp_matches(max_value, {REAL}) THEN TRY_CAST(trim(max_value) AS DOUBLE) END
                     WHEN regexp_matches(max_value, {WHOLE}) THEN TRY_CAST(trim(max_value) AS DOUBLE) END AS hi,
                data_type IN ('INTEGER', 'FLOAT', 'DATETIME') AS ranged,
                list_filter(list_transform(string_split(coalesce(uniques, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS u
              FROM f0 LEFT JOIN load USING (dataset_id, load_no)),
            f2 AS (SELECT *, coalesce(n >= 0, false) AS judged,
                coalesce(nc < 0 OR nc > n, false) OR coalesce(d < -1 OR d > n - nc, false) OR coalesce(is_unique AND d >= 0 AND d < n - nc, false)
                OR (min_value IS NULL) <> (max_value IS NULL)
                OR (ranged AND ((min_value IS NOT NULL AND lo IS NULL) OR (max_value IS NOT NULL AND hi IS NULL) OR coalesce(lo > hi, false))) AS bad FROM f1),
            f3 AS (SELECT *, lag(n) OVER w AS pn, lag(nc) OVER w AS pnc, lag(d) OVER w AS pd, lag(lo) OVER w AS plo, lag(hi) OVER w AS phi,
                lag(u) OVER w AS pu, lag(bad) OVER w AS pbad, lag(judged) OVER w AS pjudged, lag(data_type) OVER w AS ptype
              FROM f2 WINDOW w AS (PARTITION BY dataset_id, field_id ORDER BY load_no))
            SELECT dataset_id, load_no, '*' AS field_id FROM jump WHERE row_count < 0 OR (p >= 0 AND greatest(row_count, p) > 5 * least(row_count, p))
            UNION
            SELECT dataset_id, load_no, field_id FROM f3 WHERE judged AND (bad OR (pjudged AND NOT pbad AND data_type = ptype AND (
                (n > 0 AND pn > 0 AND abs(nc / n - pnc / pn) > 0.25)
                OR (d >= 1 AND pd >= 1 AND greatest(d, pd) > 5 * least(d, pd))
                OR (ranged AND (lo > phi OR plo > hi))
                OR (len(u) > 0 AND len(pu) > 0 AND NOT list_has_any(u, pu)))))""",
    }
