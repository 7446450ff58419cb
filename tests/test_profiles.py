"""Value-count profiles and audits of recorded ones."""

import datetime as dt
import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import profiles as P
from weftline.plans import problems

FOLDER = os.environ.get("WEFTLINE_TESTDATA", "/root/testdata/sf0.001")

FIELDS = "dataset_id bigint, load_no int, field_id string, field_name string, data_type string, min_value string, max_value string, is_unique boolean, units string, distinct_count bigint, null_count bigint, uniques string, loaded_at timestamp_ntz, row_count int"
STATS = "dataset_id bigint, load_no int, row_count bigint, loaded_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def by_name(df):
    return {r.column_name: r for r in df.collect()}


def test_profile_is_exact(spark):
    values = ["a", "a", None, "b", "c", "a", ""]
    df = spark.createDataFrame([(v, n, float("nan") if n == 3 else n / 2) for n, v in enumerate(values)], "v string, n int, x double")
    p = by_name(P.profile(P.value_counts(df), {"v": "^[ab]?$"}))
    c = Counter(v for v in values if v is not None)
    entropy = -sum(k / 6 * math.log2(k / 6) for k in c.values())
    assert (p["v"].row_count, p["v"].null_count, p["v"].distinct_count, p["v"].violations) == (7, 1, 4, 1)
    assert abs(p["v"].entropy - entropy) < 1e-9 and (p["v"].min_value, p["v"].max_value) == ("", "c")
    assert (p["n"].min_value, p["n"].max_value, p["n"].distinct_count) == ("0", "6", 7)
    assert p["x"].null_count == 1 and float(p["x"].max_value) == 3.0


def test_deltas_are_the_whole(spark):
    a = spark.createDataFrame([(n % 5, None) for n in range(50)], "a int, b string")
    b = spark.createDataFrame([(n % 7, "x" * 400) for n in range(20)], "a int, b string")
    grown = P.apply_delta(P.value_counts(a), P.value_counts(b))
    whole = P.value_counts(a.unionByName(b))
    key = lambda df: sorted((r.column_name, str(r.value), r.n) for r in df.collect())
    assert key(grown) == key(whole)
    back = P.apply_delta(grown, P.value_counts(b, sign=-1))
    assert key(back) == key(P.value_counts(a))
    assert by_name(P.profile(whole))["b"].distinct_count == 1
    d = by_name(P.distribution_change(P.value_counts(a), P.value_counts(a)))
    assert d["a"].distance == 0 and d["b"].gained == 0
    d = by_name(P.distribution_change(P.value_counts(a), P.value_counts(b)))
    assert abs(d["b"].distance - 1) < 1e-9 and d["b"].lost == 1


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert P.profile(P.value_counts(empty)).count() == 0
    nested = spark.createDataFrame([([1, 2], {"k": 1}, b"x"), (None, None, None)], "a array<int>, m map<string,int>, b binary")
    assert {r.column_name: r.distinct_count for r in P.profile(P.value_counts(nested)).collect()} == {"a": 1, "m": 1, "b": 1}
    twice = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int").toDF("x", "x")
    got = P.profile(P.value_counts(twice)).collect()
    assert [r.row_count for r in got] == [4]  # columns of one name are one


def field(load, **k):
    base = {"data_type": "INTEGER", "lo": "1", "hi": "9", "unique": False, "d": 5, "nulls": 10, "uniques": None, "field": "0"} | k
    return (1, load, base["field"], "f", base["data_type"], base["lo"], base["hi"], base["unique"], "u", base["d"], base["nulls"], base["uniques"], T0, 7)


def test_audit(spark):
    stats = spark.createDataFrame([(1, 1, 100, T0), (1, 2, 110, T0), (1, 2, 110, T0 + dt.timedelta(1)), (1, 4, 700, T0), (1, 5, -3, T0), (1, 6, 10, T0), (1, 7, 100, T0), (1, 8, None, T0)], STATS)
    loads = {(r.load_no, r.reason) for r in P.audit_loads(stats).collect()}
    assert loads == {(4, "row_count changed"), (5, "negative row_count"), (7, "row_count changed")}
    fields = [
        field(1), field(2), field(4, lo="20", hi="30"), field(5, nulls=-4),
        field(1, field="1", nulls=101), field(2, field="1"),
        field(1, field="2", d=-2), field(1, field="3", unique=True, d=3), field(1, field="4", lo=None), field(1, field="5", lo="x"), field(1, field="6", lo="10"),
        field(1, field="7", data_type="FLOAT", lo="1e3", hi=" 2.5e3 "), field(2, field="7", data_type="FLOAT", lo=".5", hi="5."),
        field(1, field="8", data_type="STRING", lo=None, hi=None, uniques="a,b"), field(2, field="8", data_type="STRING", lo=None, hi=None, uniques="c, d"),
        field(1, field="9", nulls=10), field(2, field="9", nulls=60), field(4, field="9", nulls=60),
        field(8, field="9", nulls=-1),
    ]
    got = {(r.load_no, r.field_id): r.reason for r in P.audit_fields(spark.createDataFrame(fields + [fields[0]], FIELDS), stats).collect()}
    assert got == {
        (4, "0"): "range moved", (1, "1"): "impossible null_count", (1, "2"): "impossible distinct_count", (1, "3"): "not unique",
        (1, "4"): "one bound", (1, "5"): "unreadable bound", (1, "6"): "minimum above maximum", (2, "7"): "range moved",
        (2, "8"): "no listed value in common", (2, "9"): "null share changed", (4, "9"): "null share changed",
    }
    assert P.audit(spark.createDataFrame([], FIELDS), stats.limit(0)).count() == 0


def test_each_load_is_compared_with_the_one_before(spark):
    loads = {1: ["a", "a", "b", None], 2: ["a", "a", "b", None], 4: ["c", "c", "c", "a"], 5: ["a", "c", "c", "c"], None: ["z"]}
    df = spark.createDataFrame([(k, v) for k, vs in loads.items() for v in vs], "k int, v string")
    deltas = P.value_counts(df, ["v"], load=F.col("k"))
    got = {(r.load, r.before): (r.column_name, r.distance, r.gained, r.lost) for r in P.load_changes(deltas).collect()}
    assert got == {(2, 1): ("v", 0.0, 0, 0), (4, 2): ("v", 0.75, 1, 2), (5, 4): ("v", 0.0, 0, 0)}
    key = lambda d: sorted((r.column_name, str(r.value), r.n) for r in d.collect())
    assert key(P.apply_delta(None, deltas)) == key(P.value_counts(df, ["v"]))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_changes_cover_every_column_and_load(spark):
    got = {(r.table_name, r.column_name): (r.n, r.least, r.most) for r in problems.p3_changes(spark, FOLDER).groupBy("table_name", "column_name").agg(F.count("*").alias("n"), F.min("load").alias("least"), F.max("load").alias("most")).collect()}
    assert got.keys() == {(t, c) for t, cs in problems.PROFILED_COLUMNS.items() for c in cs.split()}
    maps = problems.table(spark, FOLDER, "spreadsheet_maps").agg(F.count_distinct("period_no"), F.max("period_no")).first()
    assert got["spreadsheet_maps", "file_name"][::2] == (maps[0] - 1, maps[1])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_every_text_column_is_checked(spark):
    got = {(r.table_name, r.column_name): r for r in problems.p3_profile(spark, FOLDER).collect()}
    assert {k for k, r in got.items() if r.violations is not None} == {k for k, r in got.items() if r.column_type == "string"}
    formats = [r.file_format for r in problems.table(spark, FOLDER, "input_specs").select("file_format").collect()]
    assert got["input_specs", "file_format"].violations == sum(f is not None and f != f.upper() for f in formats)
    odd = spark.createDataFrame([("csv", "0x10", " \t", "a"), ("CSV", "1e3", "a\x00", "b")], "file_format string, min_value string, label string, other string")
    p = by_name(P.profile(P.value_counts(odd), problems.PATTERNS))
    assert [p[c].violations for c in odd.columns] == [1, 1, 2, None]


def test_long_values_are_whole(spark):
    texts = ["x" * 300 + end for end in ("a", "b", "y!")]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    p = by_name(P.profile(P.apply_delta(None, P.value_counts(df)), {"v": "^x+[a-z]$"}))["v"]
    assert (p.min_value, p.max_value, p.distinct_count, p.violations) == (min(texts), max(texts), 3, 1)
    less = P.apply_delta(P.value_counts(df), P.value_counts(df.where("v like '%!'"), sign=-1))
    assert by_name(P.profile(less))["v"].max_value == texts[1]


def test_state_is_kept_between_sessions(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string")
    from weftline.operators import profiles

    profiles.State(spark, str(tmp_path)).add("a", profiles.value_counts(a)).add("b", profiles.value_counts(b))
    later = profiles.State(spark, str(tmp_path)).add("b", profiles.value_counts(b))  # delivered again: not counted twice
    got = {r.column_name: (r.row_count, r.null_count, r.distinct_count, r.min_value, r.max_value) for r in profiles.profile(later.counts()).collect()}
    assert got == {"k": (5, 0, 3, "1", "3"), "v": (5, 1, 3, "x", "z")}
    gone = later.add("c", profiles.value_counts(a, sign=-1))
    assert {r.column_name: (r.row_count, r.distinct_count) for r in profiles.profile(gone.counts()).collect()} == {"k": (2, 2), "v": (2, 2)}
