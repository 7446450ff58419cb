"""Transforms on small literal tables: missing values, ties, order, errors."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions.ordered import previous, with_order
from weftline.operators import aggregate as A, code, columns as C, filters as Fi, geo, images, jsons, labels, maths as M, multi, rows as R, series as S
from weftline.registry import load_all, port_value
from weftline.semantics import clean, names, plain


def col(df, c):
    return [r[c] for r in df.collect()]


@pytest.fixture(scope="module")
def gaps(spark):
    return with_order(spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, None), (5, 5.0)], "i int, a double"), "i")


def test_filters(spark, gaps):
    assert col(Fi.filter_less_than(gaps, "a", "4"), "a") == [1, 3]
    assert Fi.filter_equal(gaps, "a", "1").count() == 1 and Fi.filter_not_equal(gaps, "a", "1").count() == 4
    assert Fi.filter_equal(gaps, "a", "x").count() == 0 and Fi.filter_in_range(gaps, "a", 1, 3).count() == 2
    assert col(Fi.filter_greater_than(gaps, "a", 2, "true")["mask"], "a") == [False, False, True, False, True]
    with pytest.raises(ValueError, match="not found"):
        Fi.filter_less_than(gaps, "b", 1)
    with pytest.raises(TypeError):
        Fi.filter_less_than(spark.createDataFrame([("x",)], "s string"), "s", 1)
    t = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 6, 1),), (dt.datetime(2025, 1, 1),)], "t timestamp_ntz")
    assert Fi.filter_less_than(t, "t", 1719792000 * 10**9).count() == 2
    assert Fi.filter_equal(t, "t", "2024-06-01").count() == 1


def test_top_and_slices(spark, gaps):
    assert col(R.get_top_n(gaps, "a", 2), "a") == [5, 3] and col(R.get_top_n(gaps, "a", 4), "a") == [5, 3, 1, None]
    assert col(R.get_bottom_n(gaps, "a", 2), "a") == [1, 3] and R.get_top_n(gaps, "a", 0).count() == 0
    ties = with_order(spark.createDataFrame([(n, v) for n, v in enumerate([3, 3, 3, 1, 2])], "i int, v int"), "i")
    assert col(R.get_top_n(ties, "v", 2), "i") == [0, 1]
    got = R.get_top_n(ties, "v", 2, True)["mask"].orderBy("__ord")
    assert col(got, "0") == [True, True, False, False, False]
    assert R.get_top_percentage(ties, "v", 0.01).count() == 1 and R.get_bottom_percentage(ties, "v", 0).count() == 0
    assert col(R.slice_rows(ties, 1, 3), "i") == [1, 2] and col(R.slice_rows(ties, -2), "i") == [3, 4] and col(R.slice_rows(ties, 0, -4), "i") == [0]
    assert R.sample_rows(ties, fraction=0.5, seed=1).count() == 2 and R.sample_rows(ties).count() == 1
    assert col(R.sort_values(gaps, "a", "false"), "a") == [5, 3, 1, None, None]
    blank = with_order(spark.createDataFrame([(0, "x", "1"), (1, None, None), (2, "y", None), (3, None, "9")], "i int, k string, v string"), "i")
    assert col(R.drop_trailing_rows(blank, ["k"]), "i") == [0, 1, 2]
    assert col(R.drop_empty_rows(blank.drop("i"), 0.0), "v") == ["1"]


def test_aggregates(spark):
    df = spark.createDataFrame([("A", 10.0, 1, True), ("A", None, 2, False), ("B", None, 3, True), (None, 9.0, 9, None)], "g string, v double, n int, b boolean")
    assert [tuple(r) for r in A.aggregate_sum(df, "g").collect()] == [("A", 10.0, 3, 1), ("B", 0.0, 3, 1)]
    assert [tuple(r)[1:3] for r in A.aggregate_mean(df, ["g"]).collect()] == [(10.0, 1.5), (None, 3.0)]
    assert A.aggregate_mean(df, "g", "_m").columns == ["g", "v_m", "n_m", "b_m"]
    assert [tuple(r) for r in A.aggregate_count(df, "g").collect()] == [("A", 2), ("B", 1)] and A.aggregate_count(df.limit(0)).first()[0] == 0
    assert A.aggregate_median(df).first()["n"] == 2.5 and A.aggregate_sum(df).count() == 1
    assert A.calculate_min(input_list="[3, 1, 2]").first()[0] == 1 and A.calculate_max(df, "v").first()[0] == 10
    with pytest.raises(ValueError):
        A.calculate_min()
    cities = spark.createDataFrame([("Europe", "France", "Paris", 2), ("Europe", "France", "Lyon", 1), ("Europe", "Italy", None, 4), (None, "x", "y", 100)], "continent string, country string, city string, population int")
    got = {r.target: (r.source, r["count"], r.value) for r in A.hierarchical_rollup(cities, "continent, country, city", "population").collect()}
    assert got["Total"] == ("", 3, 7) and got["Europe/France"] == ("Europe", 2, 3) and "Europe/Italy" in got and len(got) == 6
    with pytest.raises(ValueError, match="non-empty"):
        A.hierarchical_rollup(cities, [])


def test_joins(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "key int, l string, x int")
    b = spark.createDataFrame([("2", "c", 5), (None, "m", 6), (None, "k", 7)], "key string, r string, x int")
    j = multi.join([a, b], "key")
    assert j.count() == 3 and set(j.columns) == {"key", "l", "r", "x_table_0", "x_table_1"}
    assert multi.join([a, b], "key", "outer").count() == 4 and multi.join([a, b], "key", "left").count() == 4
    with pytest.raises(ValueError, match="No DataFrames"):
        multi.join([])
    assert multi.join(a, "key").columns == a.columns
    u = multi.union([a, b])
    assert dict(u.dtypes)["key"] == "string" and u.count() == 6 and set(u.columns) == {"key", "l", "x", "r"}
    p = multi.concat_partitions({"b": a, "a": lambda: b})
    assert {(r.x, r["__partition__"]) for r in p.collect()} == {(5, 0.0), (6, 0.0), (7, 0.0), (1, 1.0), (2, 1.0), (3, 1.0)}


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.5, "x")], "a int, b double, c string")
    m = C.melt(df, "c", "a,b", "k", "v")
    assert [tuple(r) for r in m.collect()] == [("x", "a", 1.0), ("x", "b", 2.5)]
    assert dict(C.melt(df, [], ["a", "c"]).dtypes)["value"] == "string"
    for f in (lambda: C.select_columns(df, "q"), lambda: C.drop_columns(df, ["q"]), lambda: C.rename_column(df, "q", "z")):
        with pytest.raises(ValueError, match="not found"):
            f()
    with pytest.raises(ValueError, match="already exists"):
        C.add_label(df, "a", 1)
    g = with_order(spark.createDataFrame([(0, "k", "k", None), (1, "u", "2", "3"), (2, "v", "4", None)], "i int, A string, B string, C string"), "i").drop("i")
    assert C.promote_header(g).columns == ["__ord", "k", "k_1", "__col_2__"]
    t = C.transpose_grid(g, "what")
    assert [tuple(r) for r in t.collect()] == [("B", "k", "2", "4"), ("C", None, "3", None)] and t.columns == ["what", "k", "u", "v"]
    assert C.flatten_header(g, 0, 1).columns == ["__ord", "k u", "k 2", "3"]
    assert col(C.cast_types(spark.createDataFrame([("13/02/2024",), ("x",)], "d string"), {"d": "date"}), "d") == [dt.date(2024, 2, 13), None]


def test_maths(spark):
    df = spark.createDataFrame([(10.0, 0.0, " 3 "), (0.0, 0.0, "x"), (-1.0, 0.0, "1e3")], "n double, d double, s string")
    assert col(M.calc_ratio(df, "n", "d"), "ratio") == [math.inf, None, -math.inf]
    assert col(M.arithmetic_op(df, "s", "ADD", constant="1"), "result") == [4.0, None, 1001.0]
    big = spark.createDataFrame([(2**63 - 1,)], "n bigint")
    assert col(M.arithmetic_op(big, "n", "PROD", "n"), "result") == [None]
    with pytest.raises(ValueError):
        M.arithmetic_op(df, "n", "POW", "d")
    assert col(M.normalize_column(df, "d"), "d_norm") == [0, 0, 0]
    with pytest.raises(ValueError, match="Unsupported normalization"):
        M.normalize_column(df, "n", "odd")
    ones = spark.createDataFrame([(1.0,)] * 3 + [(None,)], "v double")
    assert col(M.discretize(ones, "v", 3), "v_bin") == [1, 1, 1, None]
    with pytest.raises(ValueError, match="labels length"):
        M.discretize(ones, "v", 3, labels="a,b")
    rng = random.Random(1)
    vals = [rng.choice([None, rng.random() * 9]) for _ in range(60)]
    v = spark.createDataFrame([(n, x) for n, x in enumerate(vals)], "i int, v double")
    want = pd.cut(pd.Series(vals, dtype=float), 4, labels=False)
    assert [(-1 if x is None else x) for x in col(M.discretize(v, "v", 4).orderBy("i"), "v_bin")] == want.fillna(-1).astype(int).tolist()
    assert col(M.calc_distance(spark.createDataFrame([(3, 4)], "x int, y int"), "x", "y", 0, 0), "distance") == [5.0]
    assert col(clean(spark.createDataFrame([(float("nan"),)], "x double")), "x") == [None]


@pytest.mark.parametrize("w", [1, 2, 3, 4])
@pytest.mark.parametrize("f", ["MEAN", "STD", "MIN", "MAX", "SUM"])
def test_rolling_is_pandas(spark, w, f):
    rng = random.Random(w)
    vals = [rng.choice([None, rng.randint(0, 9)]) if rng.random() < 0.4 else rng.randint(0, 9) for _ in range(40)]
    df = with_order(spark.createDataFrame([(n, v) for n, v in enumerate(vals)], "i int, v int"), "i")
    got = col(S.rolling_statistics(df, "v", w, f).orderBy("i"), f"v_{f.lower()}")
    want = getattr(pd.Series(vals, dtype=float).rolling(w, center=True), f.lower())()
    assert [None if x is None else round(x, 6) for x in got] == [None if pd.isna(x) else round(x, 6) for x in want]


def test_series(spark):
    df = with_order(spark.createDataFrame([(n, n if n != 3 else None, dt.datetime(2024, 1, 31, 10) + dt.timedelta(n)) for n in range(10)], "i int, v int, t timestamp_ntz"), "i")
    assert col(S.rolling_statistics(df, "v", 1, "CUMSUM").orderBy("i"), "v_cumsum") == [0, 1, 3, None, 7, 12, 18, 25, 33, 42]
    assert col(S.lag_lead(df, "v", 2).orderBy("i"), "v_lag_2")[:4] == [None, None, 0, 1]
    assert col(S.lag_lead(df, "v", -1).orderBy("i"), "v_lag_-1")[-2:] == [9, None]
    assert col(S.offset_datetime(df, "t", 1, "MONTHS").orderBy("i"), "t_offset")[0] == dt.datetime(2024, 2, 29, 10)
    assert col(S.extract_date_part(df, "t", "weekday").orderBy("i"), "t_weekday")[0] == 2
    assert plain(S.lag_lead(df.limit(0), "v", 1)).count() == 0
    with pytest.raises(ValueError):
        S.extract_date_part(df, "t", "CENTURY")


def test_blocks_are_one_order(spark):
    from pyspark.sql import functions as F

    from weftline.functions.ordered import fill_down, framed, running_sum

    df = spark.range(1000).withColumn("v", F.col("id") % 13).withColumn("__ord", 1000 - F.col("id"))
    got = framed(df, {"p": lambda w: F.lag("id", 3).over(w), "n": lambda w: F.lead("id", 2).over(w)}, 3, 2, least=50)
    assert all(r.p == (r.id + 3 if r.id < 997 else None) and r.n == (r.id - 2 if r.id > 1 else None) for r in got.collect())
    holes = df.withColumn("h", F.when(F.col("id") % 90 == 5, F.col("id")))
    last = {r.id: r.h for r in fill_down(holes, ["h"], size=64).collect()}
    assert all(last[n] == next((k for k in range(n, 1000) if k % 90 == 5), None) for n in range(1000))
    total = {r.id: r.s for r in running_sum(df, "v", "s", size=64).collect()}
    acc = 0
    for n in range(999, -1, -1):
        acc += n % 13
        assert total[n] == acc
    p = previous(df.select((F.col("id") % 3).alias("k"), "id"), ["k"], "id", [], block=16).collect()
    assert all((r.prev.id if r.prev else None) == (r.id - 3 if r.id > 2 else None) for r in p)


def test_forecast(spark):
    start = dt.datetime(2023, 1, 2)
    days = [start + dt.timedelta(n) for n in range(200) if (start + dt.timedelta(n)).weekday() < 5]
    df = spark.createDataFrame([(d, 100 + 5 * math.sin(n / 9)) for n, d in enumerate(days)], "Date timestamp_ntz, Price double")
    out = S.forecast_time_series(df, "Date", "Price", 5, trees=5, paths=20).collect()
    ahead = [r for r in out if r.Is_Forecast]
    assert len(ahead) == 5 and all(r.Forecast_Lower <= r.Price <= r.Forecast_Upper and r.Date.weekday() < 5 for r in ahead)
    assert len(out) == len(days) + 5
    assert S.forecast_time_series(df, "Date", "Price", 5, "true", trees=5).columns == ["Date", "Actual", "Predicted"]
    with pytest.raises(ValueError, match="Insufficient data"):
        S.forecast_time_series(df.limit(10), "Date", "Price")


def test_json(spark):
    f = lambda *a, **k: [r.asDict() for r in jsons.flatten_json(*a, **k).collect()]
    assert f([{"id": 1, "info": {"name": "x"}}, {"id": 2}]) == [{"id": 1, "info_name": "x"}, {"id": 2, "info_name": None}]
    assert f({"p": [[1, 2.5], [2, 3.5]], "q": [[2, 9.5]]}) == [{"index": 1, "p": 2.5, "q": None}, {"index": 2, "p": 3.5, "q": 9.5}]
    assert f({"x": [1, 2], "y": ["a", "b"]}) == [{"x": 1, "y": "a"}, {"x": 2, "y": "b"}]
    assert f('{"r": {"s": [[1, 2]]}}', root_key="r.s", columns="a,b") == [{"a": 1, "b": 2}]
    assert f([1, 2]) == [{"value": 1}, {"value": 2}] and f([]) == [] and jsons.flatten_json({}).count() == 1
    assert f({"a": {"b": 1, "c": [1, 2]}}) == [{"b": 1, "c": "[1, 2]"}]
    c = jsons.cartograph_json([{"a": 1, "b": [{"c": "x"}]}, {"a": 1.5}])
    assert {x["path"]: x["type"] for x in c["fields"]} == {"[].a": "FLOAT", "[].b[].c": "STRING"} and not c["tabular"] and c["length"] == 2
    deep = []
    for _ in range(80):
        deep = [deep]
    with pytest.raises(jsons.JsonTooDeepError):
        jsons.cartograph_json(deep)
    with pytest.raises(TypeError):
        jsons.guarded([1])["a"]
    with pytest.raises(AttributeError, match="flatten_json"):
        jsons.guarded({"a": 1}).groupby


def test_labels_and_places(spark):
    df = spark.createDataFrame([(1, "Rock; Pop"), (2, "rock"), (3, None), (4, "Poésie;ROCK")], "i int, tags string")
    got = {(r.i, r.tags): r.value for r in labels.nlp_binarize_labels_auto(df, "tags", 2).collect()}
    assert got == {(1, "rock"): 1, (2, "rock"): 1, (3, "rock"): 0, (4, "rock"): 1, (1, "poesie"): 0, (2, "poesie"): 0, (3, "poesie"): 0, (4, "poesie"): 1}
    h = {(r.i, r.tags): r.value for r in labels.nlp_binarize_labels_hinted(spark.createDataFrame([(1, "rocks"), (2, "jaz")], "i int, tags string"), "tags", ["rock", "jazz"]).collect()}
    assert h[1, "rock"] == 1 and h[2, "jaz"] == 1
    places = spark.createDataFrame([("country", "France", ["Gaul"], "France", "FR", "FRA", 48.9, 2.3, 1), ("city", "Paris", [], "France", "FR", "FRA", 48.8, 2.4, 9), ("city", "Paris", [], "USA", "US", "USA", 33.6, -95.5, 2)], "kind string, name string, alternates array<string>, country string, iso2 string, iso3 string, latitude double, longitude double, population bigint")
    g = {r.n: r.iso3 and (r.iso3, r.latitude) for r in geo.geocode_location(spark.createDataFrame([("fra",), (" the  france",), ("gaul",), ("PARIS",), ("?",), (None,)], "n string"), "n", gazetteer=places).collect()}
    assert g == {"fra": ("FRA", 48.9), " the  france": ("FRA", 48.9), "gaul": ("FRA", 48.9), "PARIS": ("FRA", 48.8), "?": None, None: None}


def test_code(spark):
    df = spark.createDataFrame([(1, 2), (5, 6)], "x int, y int")
    assert col(code.execute_code("result = df[df.x > 1]", df=df), "y") == [6]
    assert col(code.execute_code("result = df.select((F.col('x') + 1).alias('z'))", "spark", df=df), "z") == [2, 6]
    for bad in ("import os", "open('x')", "().__class__", "from subprocess import run", "x" * 5000):
        with pytest.raises(ValueError):
            code.execute_code(bad)
    with pytest.raises(ValueError, match="result"):
        code.execute_code("y = 1")
    with pytest.raises(TypeError):
        code.execute_code("result = 3")


def test_images(spark):
    img = spark.createDataFrame([(("file:/a.png", 1, 2, 3, 16, bytearray([1, 2, 3, 4, 5, 6])),)], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    got = [(r.x, r.y, r.channel, r.value) for r in images.image_to_dataframe(img, "rgb").collect()]
    assert got == [(0, 0, "r", 3), (1, 0, "r", 6), (0, 0, "g", 2), (1, 0, "g", 5), (0, 0, "b", 1), (1, 0, "b", 4)]
    assert images.extract_channel(img, "gray").count() == 2 and images.image_to_dataframe(img).count() == 8
    assert tuple(images.image_metadata(img).first()) == (2, 1, 3, "PNG", "RGB")
    with pytest.raises(ValueError):
        images.extract_channel(img, "infrared")


def test_registry():
    assert len(load_all()) >= 48 and names("['a', \"b\" , ]") == ["a", "b"]
    assert port_value("3.0", "INTEGER") == 3 and port_value("yes", "BOOLEAN") is True and port_value("a, b", "COLUMN_NAME_OR_LIST") == ["a", "b"]
    assert port_value("x", "FLOAT") == "x"


def test_large_parts_are_found_by_position(spark, monkeypatch):
    from weftline.functions import ordered as O

    monkeypatch.setattr(O, "SMALL", 5)
    df = spark.range(200).selectExpr("id AS __ord", "id", "CASE WHEN id % 10 <> 3 THEN id % 7 END AS v").repartition(5)
    data = [(n, n % 7 if n % 10 != 3 else None) for n in range(200)]
    best = sorted(data, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert [r.id for r in R.get_top_n(df, "v", 60).collect()] == [x[0] for x in best[:60]]
    assert sum(r["0"] for r in R.get_top_n(df, "v", 60, True)["mask"].collect()) == 60
    assert [r.id for r in R.get_bottom_percentage(df, "v", 0.9).collect()] == [x[0] for x in sorted(data, key=lambda x: (x[1] is None, x[1] or 0, x[0]))[:180]]
    for a, b in ((30, 90), (-40, None), (150, None), (-60, -10), (0, 3), (None, None), (190, 400), (50, 20)):
        assert [r.id for r in R.slice_rows(df, a, b).collect()] == list(range(200))[slice(a, b)], (a, b)
    assert len({r.id for r in R.sample_rows(df, 77, seed=1).collect()}) == 77 and R.sample_rows(df, fraction=1.0).count() == 200
    assert R.get_top_n(df.limit(0), "v", 60).count() == 0


def test_windows_in_groups(spark):
    from weftline.functions.ordered import framed, running_sum
    from pyspark.sql import Window

    df = spark.range(300).selectExpr("id AS __ord", "CASE WHEN id % 13 <> 0 THEN IF(id % 3 = 0, 'hot', concat('k', id % 5)) END AS k", "id * 1.0D AS x")
    w = Window.partitionBy("k").orderBy("__ord")
    want = {r["__ord"]: (r.a, r.b) for r in df.select("__ord", F.sum("x").over(w.rowsBetween(-3, 2)).alias("a"), F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("b")).collect()}
    got = running_sum(framed(df, {"a": lambda w: F.sum("x").over(w.rowsBetween(-3, 2))}, 3, 2, least=10, keys=["k"]), "x", "b", size=16, keys=["k"])
    assert {r["__ord"]: (r.a, r.b) for r in got.collect()} == want


def test_exact_ranks_of_large_tables(spark, monkeypatch):
    from weftline import semantics

    df = spark.range(301).selectExpr("IF(id % 7 = 0, NULL, id % 3) AS k", "IF(id % 11 = 0, NULL, (id * 37 % 101) / 4.0D) AS v", "id % 5 AS w", "'t' AS t", "CAST(NULL AS DOUBLE) AS e")
    sets = [(["k"], "_m"), (["k", "t"], None), (None, None)]
    small = [sorted(map(tuple, A.aggregate_median(df, k, x).collect()), key=str) for k, x in sets]
    cut = [r.v_bin for r in M.discretize(df, "v", 7, "quantile").collect()]
    monkeypatch.setattr(semantics, "LARGE_BYTES", 0)
    assert [sorted(map(tuple, A.aggregate_median(df, k, x).collect()), key=str) for k, x in sets] == small
    assert [r.v_bin for r in M.discretize(df, "v", 7, "quantile").collect()] == cut
    assert A.aggregate_median(df.limit(0), "k").count() == 0
