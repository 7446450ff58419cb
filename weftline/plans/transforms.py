"""One query per transform over the whole driver tables, and the SQL it is checked against."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions.ordered import with_order
from weftline.operators import aggregate, code, columns, filters, geo, jsons, labels, maths, multi, rows, series
from weftline.semantics import plain
from weftline.sources import readers
from weftline.spec import InputPort, InputSpec, NodeSpec, OutputPort, Spec

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def gaps(df: DataFrame, column: str, key: str, out: str) -> DataFrame:
    """A column with every seventh key's value missing."""
    return df.withColumn(out, F.when(F.col(key) % 7 != 0, F.col(column)))


NS = int(dt.datetime(1996, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * 10**9


# --- filters -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 10")
def f_less_than(s, d):
    return filters.filter_less_than(t(s, d, "lineitem"), "l_quantity", "10").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000")
def f_greater_than(s, d):
    return filters.filter_greater_than(t(s, d, "lineitem"), "l_extendedprice", 50000).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'")
def f_time_bound(s, d):
    return filters.filter_less_than(t(s, d, "orders"), "o_orderdate", NS).select("o_orderkey", "o_orderdate")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.05")
def f_in_range(s, d):
    return filters.filter_in_range(t(s, d, "lineitem"), "l_discount", 0.02, 0.05).select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def f_equal(s, d):
    return filters.filter_equal(t(s, d, "lineitem"), "l_returnflag", "R").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS v FROM events) WHERE v IS DISTINCT FROM 'click'")
def f_not_equal(s, d):
    return filters.filter_not_equal(gaps(t(s, d, "events"), "event_type", "event_id", "v"), "v", "click").select("event_id", "v")


@query("SELECT event_id, value > 100 AS value FROM events")
def f_mask(s, d):
    e = with_order(t(s, d, "events"), "event_id")
    return filters.filter_greater_than(e, "value", 100, True)["mask"].select(F.col("__ord").alias("event_id"), "value")


@query("SELECT part.p_partkey, p_name FROM part WHERE NOT (contains(lower(p_name), 'blue') OR contains(lower(p_name), 'a 1'))")
def f_keyword(s, d):
    return filters.filter_by_keyword(t(s, d, "part"), "p_name", ["BLUE", "a 1"]).select("p_partkey", "p_name")


# --- top-k, order, slices ------------------------------------------------------------------------


def _events(s, d):
    return with_order(t(s, d, "events"), "event_id").select("__ord", "event_id", "value", "event_type", "ts")


@query("SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 25")
def k_top_n(s, d):
    return plain(rows.get_top_n(_events(s, d), "value", 25)).select("event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY value ASC NULLS LAST, event_id LIMIT 25")
def k_bottom_n(s, d):
    return plain(rows.get_bottom_n(_events(s, d), "value", 25)).select("event_id", "value")


@query("SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS r, count(*) OVER () AS n FROM events) WHERE r <= floor(0.02 * n)")
def k_top_percentage(s, d):
    return plain(rows.get_top_percentage(_events(s, d), "value", 0.02)).select("event_id", "value")


@query("SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY value ASC NULLS LAST, event_id) AS r, count(*) OVER () AS n FROM events) WHERE r <= floor(0.02 * n)")
def k_bottom_percentage(s, d):
    return plain(rows.get_bottom_percentage(_events(s, d), "value", 0.02)).select("event_id", "value")


@query("SELECT event_id, event_id IN (SELECT event_id FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 100) AS inside FROM events")
def k_top_mask(s, d):
    return rows.get_top_n(_events(s, d), "value", 100, True)["mask"].select(F.col("__ord").alias("event_id"), F.col("0").alias("inside"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def k_sort(s, d):
    return rows.sort_values(t(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority", "o_totalprice"], "false")


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 150 OFFSET 100")
def k_slice(s, d):
    return plain(rows.slice_rows(_events(s, d), 100, 250)).select("event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 40")
def k_slice_tail(s, d):
    return plain(rows.slice_rows(_events(s, d), -40)).select("event_id", "value")


@query()
def k_sample(s, d):
    return rows.sample_rows(t(s, d, "events"), fraction=0.05, seed=3)


@query("SELECT round(0.05 * count(*))::BIGINT AS n, round(0.05 * count(*))::BIGINT AS events FROM events")
def k_sample_size(s, d):
    """A sample is of the exact size, and draws no row twice."""
    return rows.sample_rows(t(s, d, "events"), fraction=0.05, seed=3).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"))


# --- aggregations ----------------------------------------------------------------------------------


@query("SELECT min(l_extendedprice) AS min FROM lineitem")
def a_min(s, d):
    return aggregate.calculate_min(t(s, d, "lineitem"), "l_extendedprice")


@query("SELECT max(o_orderdate) AS max FROM orders")
def a_max(s, d):
    return aggregate.calculate_max(t(s, d, "orders"), "o_orderdate")


@query("SELECT count(*) AS count FROM lineitem")
def a_count_rows(s, d):
    return rows.count_rows(t(s, d, "lineitem"))


def _keyed(s, d):
    return t(s, d, "lineitem").select(F.when(F.col("l_orderkey") % 7 != 0, F.col("l_returnflag")).alias("flag"), "l_linestatus", F.when(F.col("l_suppkey") % 5 != 0, F.col("l_quantity")).alias("quantity"), "l_linenumber")


_KEYED = "(SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_returnflag END AS flag, l_linestatus, CASE WHEN l_suppkey % 5 <> 0 THEN l_quantity END AS quantity, l_linenumber FROM lineitem) WHERE flag IS NOT NULL"


@query(f"SELECT flag, l_linestatus, round(avg(quantity), 6) AS quantity_avg, round(avg(l_linenumber), 6) AS l_linenumber_avg FROM {_KEYED} GROUP BY ALL")
def a_mean(s, d):
    return aggregate.aggregate_mean(_keyed(s, d), "flag, l_linestatus", "_avg").withColumns({c: F.round(c, 6) for c in ("quantity_avg", "l_linenumber_avg")})


@query(f"SELECT flag, l_linestatus, coalesce(sum(quantity), 0) AS quantity, sum(l_linenumber)::BIGINT AS l_linenumber FROM {_KEYED} GROUP BY ALL")
def a_sum(s, d):
    return aggregate.aggregate_sum(_keyed(s, d), ["flag", "l_linestatus"])


@query(f"SELECT flag, l_linestatus, median(quantity) AS quantity, median(l_linenumber)::DOUBLE AS l_linenumber FROM {_KEYED} GROUP BY ALL")
def a_median(s, d):
    return aggregate.aggregate_median(_keyed(s, d), ["flag", "l_linestatus"])


@query(f"SELECT flag, l_linestatus, count(*) AS count FROM {_KEYED} GROUP BY ALL")
def a_count(s, d):
    return aggregate.aggregate_count(_keyed(s, d), ["flag", "l_linestatus"])


def _tree(s, d):
    c, n, r = t(s, d, "customer"), t(s, d, "nation"), t(s, d, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select("r_name", "n_name", F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("segment"), (F.col("c_acctbal") * 100).cast("bigint").alias("cents"))


@query("""
  WITH b AS (SELECT r_name, n_name, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS segment, trunc(c_acctbal * 100)::BIGINT AS cents
             FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT 'Total' AS target, '' AS source, count(*) AS count, sum(cents)::BIGINT AS value, sum(cents)::BIGINT AS cents FROM b
  UNION ALL SELECT r_name, 'Total', count(*), sum(cents)::BIGINT, sum(cents)::BIGINT FROM b GROUP BY r_name
  UNION ALL SELECT r_name || '/' || n_name, r_name, count(*), sum(cents)::BIGINT, sum(cents)::BIGINT FROM b GROUP BY r_name, n_name
  UNION ALL SELECT r_name || '/' || n_name || '/' || segment, r_name || '/' || n_name, count(*), sum(cents)::BIGINT, sum(cents)::BIGINT FROM b WHERE segment IS NOT NULL GROUP BY r_name, n_name, segment""")
def a_rollup(s, d):
    return aggregate.hierarchical_rollup(_tree(s, d), ["r_name", "n_name", "segment"], "cents")


# --- joins and unions --------------------------------------------------------------------------------


def _sides(s, d):
    a = t(s, d, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("nation"), "c_custkey", F.col("c_acctbal").alias("balance"))
    b = t(s, d, "nation").select(F.when((F.col("n_nationkey") % 7 != 0) & (F.col("n_nationkey") < 20), F.col("n_nationkey")).alias("nation"), "n_name", F.col("n_regionkey").alias("balance"))
    return a, b


_SIDES = """WITH a AS (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS nation, c_custkey, c_acctbal AS balance FROM customer),
  b AS (SELECT CASE WHEN n_nationkey % 7 <> 0 AND n_nationkey < 20 THEN n_nationkey END AS nation, n_name, n_regionkey AS balance FROM nation)
  SELECT coalesce(a.nation, b.nation) AS nation, c_custkey, a.balance AS balance_left, n_name, b.balance AS balance_right FROM a {} JOIN b ON a.nation IS NOT DISTINCT FROM b.nation"""


def _join(how):  # noqa: ANN001, ANN202
    def run(s, d):  # noqa: ANN001, ANN202
        a, b = _sides(s, d)
        return multi.join(on="nation", how=how, left=a, right=b)

    run.__name__ = f"j_{how}"
    query(_SIDES.format({"inner": "", "outer": "FULL"}.get(how, how.upper())))(run)


for _how in ("inner", "left", "right", "outer"):
    _join(_how)


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j_large(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return multi.join([o, c], on="o_custkey")


@query("SELECT s_name AS name, s_acctbal AS balance, s_suppkey, NULL::BIGINT AS c_custkey FROM supplier UNION ALL SELECT c_name, c_acctbal, NULL, c_custkey FROM customer")
def u_union(s, d):
    a = t(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), "s_suppkey")
    b = t(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_custkey")
    return multi.union([a, b])


@query("SELECT o_orderkey, o_orderstatus, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS __partition__ FROM orders")
def u_partitions(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return multi.concat_partitions({k: o.where(F.col("o_orderstatus") == k) for k in ("P", "F", "O")})


# --- columns -------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_brand, 'new' AS origin FROM (SELECT p_partkey, p_brand FROM part)")
def c_select_label(s, d):
    return columns.add_label(columns.select_columns(t(s, d, "part"), "p_partkey, p_brand"), "origin", "new")


@query("SELECT * EXCLUDE (p_name, p_type) RENAME (p_size AS size) FROM part")
def c_drop_rename(s, d):
    return columns.rename_column(columns.drop_columns(t(s, d, "part"), ["p_name", "p_type"]), "p_size", "size")


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax, CASE WHEN l_suppkey % 5 <> 0 THEN l_quantity END AS quantity FROM lineitem) UNPIVOT INCLUDE NULLS (amount FOR measure IN (quantity, l_discount, l_tax))")
def c_melt(s, d):
    base = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", F.when(F.col("l_suppkey") % 5 != 0, F.col("l_quantity")).alias("quantity"))
    return columns.melt(base, "l_orderkey, l_linenumber", "quantity, l_discount, l_tax", "measure", "amount")


@query("SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS v FROM events)")
def c_fill_forward(s, d):
    return plain(columns.fill_forward(gaps(_events(s, d), "event_type", "event_id", "v"), ["v"])).select("event_id", "v")


@query("SELECT doc_id, try_cast(trim(text) AS DOUBLE) AS text, n_chars::VARCHAR AS n_chars FROM documents")
def c_cast(s, d):
    return columns.cast_types(t(s, d, "documents").select("doc_id", "text", "n_chars"), {"text": "float", "n_chars": "str"})


# --- maths ------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_quantity + l_tax AS added, l_quantity - 1.5 AS less, l_quantity * l_tax AS times,
  CASE WHEN l_tax = 0 THEN CASE WHEN l_quantity > 0 THEN 'Infinity'::DOUBLE WHEN l_quantity < 0 THEN '-Infinity'::DOUBLE END ELSE l_quantity / l_tax END AS parts FROM lineitem""")
def m_arithmetic(s, d):
    x = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    x = maths.arithmetic_op(x, "l_quantity", "ADD", "l_tax", output_column="added")
    x = maths.arithmetic_op(x, "l_quantity", "SUB", constant=1.5, output_column="less")
    x = maths.arithmetic_op(x, "l_quantity", "PROD", "l_tax", output_column="times")
    return maths.arithmetic_op(x, "l_quantity", "DIV", "l_tax", output_column="parts")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS ratio FROM lineitem WHERE l_quantity <> 0")
def m_ratio(s, d):
    x = t(s, d, "lineitem").where("l_quantity <> 0").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return maths.calc_ratio(x, "l_extendedprice", "l_quantity").select("l_orderkey", "l_linenumber", "ratio")


@query("SELECT l_orderkey, l_linenumber, round(sqrt((l_quantity - 20) ** 2 + (l_discount - 0.05) ** 2), 6) AS distance FROM lineitem")
def m_distance(s, d):
    return maths.calc_distance(t(s, d, "lineitem"), "l_quantity", "l_discount", 20, 0.05).select("l_orderkey", "l_linenumber", F.round("distance", 6).alias("distance"))


@query("SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 8) AS o_totalprice_norm FROM orders, (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders)")
def m_minmax(s, d):
    return maths.normalize_column(t(s, d, "orders"), "o_totalprice").select("o_orderkey", F.round("o_totalprice_norm", 8).alias("o_totalprice_norm"))


@query("SELECT o_orderkey, round((o_totalprice - m) / sd, 6) AS z FROM orders, (SELECT avg(o_totalprice) m, stddev_samp(o_totalprice) sd FROM orders)")
def m_zscore(s, d):
    return maths.normalize_column(t(s, d, "orders"), "o_totalprice", "zscore", "z").select("o_orderkey", F.round("z", 6).alias("z"))


@query("""WITH e AS (SELECT min(value) lo, max(value) hi FROM events)
  SELECT event_id, CASE WHEN value IS NOT NULL THEN ((value > lo + (hi - lo) * 1 / 4)::INT + (value > lo + (hi - lo) * 2 / 4)::INT + (value > lo + (hi - lo) * 3 / 4)::INT) END AS value_bin FROM events, e""")
def m_bins(s, d):
    return maths.discretize(t(s, d, "events"), "value", 4).select("event_id", "value_bin")


@query("""WITH e AS (SELECT quantile_cont(p_retailprice, 0.25) a, quantile_cont(p_retailprice, 0.5) b, quantile_cont(p_retailprice, 0.75) c FROM part)
  SELECT p_partkey, ['low', 'mid', 'high', 'top'][(p_retailprice > a)::INT + (p_retailprice > b)::INT + (p_retailprice > c)::INT + 1] AS level FROM part, e""")
def m_quantiles(s, d):
    return maths.discretize(t(s, d, "part"), "p_retailprice", 4, "quantile", "level", "low,mid,high,top").select("p_partkey", "level")


# --- time ---------------------------------------------------------------------------------------------------


@query("SELECT event_id, year(ts)::INT AS ts_YEAR, month(ts)::INT AS ts_MONTH, day(ts)::INT AS ts_DAY, dayofyear(ts)::INT AS ts_DAY_OF_YEAR, (isodow(ts) - 1)::INT AS ts_WEEKDAY FROM events")
def w_date_parts(s, d):
    e = t(s, d, "events").select("event_id", "ts")
    for part in series.PARTS:
        e = series.extract_date_part(e, "ts", part)
    return e.drop("ts")


_FRAME = "CASE WHEN count(v) OVER w = {n} THEN {f}(v) OVER w END"
_VALUES = "(SELECT *, CASE WHEN event_id % 97 <> 0 THEN value END AS v FROM events)"


@query(f"SELECT event_id, round({_FRAME.format(n=4, f='avg')}, 6) AS v_mean FROM {_VALUES} WINDOW w AS (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def w_rolling_mean(s, d):
    e = _events(s, d).withColumn("v", F.when(F.col("event_id") % 97 != 0, F.col("value")))
    return plain(series.rolling_statistics(e, "v", 4, "MEAN")).select("event_id", F.round("v_mean", 6).alias("v_mean"))


@query(f"SELECT event_id, {_FRAME.format(n=3, f='max')} AS v_max FROM {_VALUES} WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def w_rolling_groups(s, d):
    e = _events(s, d).withColumn("v", F.when(F.col("event_id") % 97 != 0, F.col("value")))
    return plain(series.rolling_statistics(e, "v", 3, "MAX", "event_type")).select("event_id", "v_max")


@query("SELECT event_id, CASE WHEN v IS NOT NULL THEN sum(v) OVER (ORDER BY event_id)::BIGINT END AS v_cumsum FROM (SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN trunc(value * 100)::BIGINT END AS v FROM events)")
def w_cumsum(s, d):
    e = _events(s, d).withColumn("v", F.when(F.col("event_id") % 97 != 0, (F.col("value") * 100).cast("bigint")))
    return plain(series.rolling_statistics(e, "v", 1, "CUMSUM")).select("event_id", "v_cumsum")


@query("SELECT event_id, lag(value, 2) OVER (ORDER BY event_id) AS value_lag_2, lead(value, 1) OVER (ORDER BY event_id) AS following FROM events")
def w_lag_lead(s, d):
    e = series.lag_lead(series.lag_lead(_events(s, d), "value", 2), "value", -1, "following")
    return plain(e).select("event_id", "value_lag_2", "following")


@query("SELECT event_id, ts + INTERVAL 36 HOUR AS later, ts + INTERVAL 1 MONTH AS month_later FROM events")
def w_offset(s, d):
    e = series.offset_datetime(t(s, d, "events"), "ts", 36, "HOURS", "later")
    return series.offset_datetime(e, "ts", 1, "MONTHS", "month_later").select("event_id", "later", "month_later")


@query()
def w_forecast(s, d):
    daily = t(s, d, "orders").groupBy(F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(F.avg("o_totalprice").alias("price"))
    return series.forecast_time_series(daily, "day", "price", 14)


# --- the same on the largest table ------------------------------------------------------------------------------

_LINES = "(SELECT l_orderkey * 8 + l_linenumber + l_extendedprice / 1000000 AS line, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus FROM lineitem)"


def _lines(s, d):
    return with_order(t(s, d, "lineitem").withColumn("line", F.col("l_orderkey") * 8 + F.col("l_linenumber") + F.col("l_extendedprice") / 1000000), "line")


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM {_LINES} ORDER BY l_extendedprice DESC, line LIMIT 10")
def b_top_n(s, d):
    return plain(rows.get_top_n(_lines(s, d), "l_extendedprice", 10)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, lag(l_quantity) OVER (ORDER BY line) AS before FROM {_LINES}")
def b_lag(s, d):
    return plain(series.lag_lead(_lines(s, d), "l_quantity", 1, "before")).select("l_orderkey", "l_linenumber", "l_extendedprice", "before")


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, sum(l_quantity::BIGINT) OVER (ORDER BY line)::BIGINT AS total FROM {_LINES}")
def b_cumsum(s, d):
    e = _lines(s, d).withColumn("whole", F.col("l_quantity").cast("bigint"))
    return plain(series.rolling_statistics(e, "whole", 1, "CUMSUM", output_column="total")).select("l_orderkey", "l_linenumber", "l_extendedprice", "total")


@query(f"""SELECT 'Total' AS target, '' AS source, count(*) AS count, sum(l_linenumber)::BIGINT AS value, sum(l_linenumber)::BIGINT AS l_linenumber FROM {_LINES}
  UNION ALL SELECT l_returnflag, 'Total', count(*), sum(l_linenumber)::BIGINT, sum(l_linenumber)::BIGINT FROM {_LINES} GROUP BY l_returnflag
  UNION ALL SELECT l_returnflag || '/' || l_linestatus, l_returnflag, count(*), sum(l_linenumber)::BIGINT, sum(l_linenumber)::BIGINT FROM {_LINES} GROUP BY l_returnflag, l_linestatus""")
def b_rollup(s, d):
    return aggregate.hierarchical_rollup(t(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"), ["l_returnflag", "l_linestatus"], "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, (l_extendedprice > a)::INT + (l_extendedprice > b)::INT + (l_extendedprice > c)::INT AS level FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.5) b, quantile_cont(l_extendedprice, 0.75) c FROM lineitem)")
def b_quantiles(s, d):
    return maths.discretize(t(s, d, "lineitem"), "l_extendedprice", 4, "quantile", "level").select("l_orderkey", "l_linenumber", "level")


@query("SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def b_join(s, d):
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return multi.join([t(s, d, "lineitem").select("l_orderkey", "l_linenumber"), o], on="l_orderkey")


# --- JSON, labels, places, code -------------------------------------------------------------------------------


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS p_k FROM events")
def n_flatten(s, d):
    e = t(s, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return jsons.flatten_structs(e)


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def n_keys(s, d):
    return jsons.key_counts(t(s, d, "events"), "props")


@query("SELECT n_nationkey AS a, n_name AS b_name, n_regionkey AS b_region FROM nation")
def n_document(s, d):
    doc = [{"a": r.n_nationkey, "b": {"name": r.n_name, "region": r.n_regionkey}} for r in t(s, d, "nation").collect()]  # one document of 25 objects
    return jsons.flatten_json(doc).select(F.col("a").cast("int").alias("a"), "b_name", F.col("b_region").cast("int").alias("b_region"))


@query("""WITH l AS (SELECT semantic, row_number() OVER (ORDER BY count(*) DESC, semantic) AS r FROM (SELECT lower(data_type) AS semantic FROM cell_references WHERE data_type IS NOT NULL) GROUP BY semantic),
  top AS (SELECT semantic FROM l WHERE r <= 3)
  SELECT cell_ref_id, top.semantic AS data_type, (lower(c.data_type) = top.semantic)::INT AS value FROM (SELECT cell_ref_id, data_type FROM cell_references) c, top""")
def l_labels(s, d):
    return labels.nlp_binarize_labels_auto(t(s, d, "cell_references").select("cell_ref_id", "data_type"), "data_type", 3).withColumn("value", F.col("value"))


@query("""WITH f AS (SELECT dataset_id, load_no, field_id, list_distinct(list_filter(list_transform(string_split(coalesce(lower(uniques), ''), ','), lambda x: strip_accents(trim(x))), lambda x: x <> '')) AS found FROM field_metadata),
  top AS (SELECT label FROM (SELECT unnest(found) AS label FROM f) GROUP BY label ORDER BY count(*) DESC, label LIMIT 5)
  SELECT dataset_id, load_no, field_id, label AS uniques, list_contains(found, label)::INT AS value FROM f, top""")
def l_labels_split(s, d):
    """Cells of several labels, split at their most usual delimiter."""
    return labels.nlp_binarize_labels_auto(t(s, d, "field_metadata").select("dataset_id", "load_no", "field_id", "uniques"), "uniques", 5)


@query("SELECT event_id, h AS event_type, (event_type = h)::INT AS value FROM (SELECT event_id, event_type FROM events) e, (SELECT event_type AS h FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)")
def l_hinted(s, d):
    e = t(s, d, "events").select("event_id", F.concat(F.col("event_type"), F.lit(" ")).alias("event_type"))
    kinds = sorted(r.event_type for r in t(s, d, "events").select("event_type").distinct().limit(51).collect())  # event types, a handful
    if len(kinds) > 50:
        raise ValueError("more than 50 event types: too many to be hints")
    return labels.nlp_binarize_labels_hinted(e, "event_type", kinds, 2)


@query("SELECT c_custkey, n_name, n_nationkey::DOUBLE AS latitude, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey")
def g_geocode(s, d):
    n = t(s, d, "nation")
    places = n.select(F.lit("country").alias("kind"), F.initcap("n_name").alias("name"), F.array().cast("array<string>").alias("alternates"), F.col("n_name").alias("country"), F.lit(None).cast("string").alias("iso2"), F.lit(None).cast("string").alias("iso3"), F.col("n_nationkey").cast("double").alias("latitude"), F.lit(0.0).alias("longitude"), F.lit(1).alias("population"))
    c = t(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return geo.geocode_location(c, "n_name", gazetteer=places).select("c_custkey", "n_name", "latitude", "country")


@query("SELECT c_custkey, 'G' || n_nationkey AS geometry FROM customer JOIN nation ON c_nationkey = n_nationkey")
def g_contours(s, d):
    n = t(s, d, "nation")
    outlines = n.select(F.upper("n_name").alias("iso3"), F.concat(F.lit("G"), "n_nationkey").alias("geometry"))
    c = t(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return geo.get_country_contours(c, "n_name", outlines).select("c_custkey", "geometry")


@query("SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY event_type")
def x_code(s, d):
    return code.execute_code("result = events.groupBy('event_type').agg(F.count('*').alias('n'), F.max('value').alias('top'))", "spark", events=t(s, d, "events"))


@query("SELECT user_id, event_id, value * 2 AS doubled FROM events")
def x_map_batches(s, d):
    e = t(s, d, "events").select("user_id", "event_id", "value")
    return code.map_batches(e, lambda p: p.assign(doubled=p["value"] * 2)[["user_id", "event_id", "doubled"]], "user_id bigint, event_id bigint, doubled double")


# --- a pipeline, end to end --------------------------------------------------------------------------------------


def revenue_spec(folder: str) -> Spec:
    """Revenue of large lines by return flag, the two largest."""
    chain = [
        NodeSpec("10", "filter_greater_than", "large", (InputPort("df", None, ("1",)), InputPort("column", "l_quantity"), InputPort("value", "20")), (OutputPort("11"),)),
        NodeSpec("20", "select_columns", "slim", (InputPort("df", None, ("11",)), InputPort("columns", "l_returnflag, l_linenumber, l_quantity")), (OutputPort("21"),)),
        NodeSpec("30", "aggregate_sum", "by flag", (InputPort("df", None, ("21",)), InputPort("group_columns", "l_returnflag")), (OutputPort("31"),)),
        NodeSpec("40", "sort_values", "sorted", (InputPort("df", None, ("31",)), InputPort("columns", "l_quantity"), InputPort("ascending", "false")), (OutputPort("41"),)),
        NodeSpec("50", "get_top_n", "top", (InputPort("df", None, ("41",)), InputPort("column", "l_quantity"), InputPort("n", "2")), (OutputPort("51", visibility=True),)),
    ]
    return Spec((InputSpec("1", "lineitem", f"{folder}/lineitem.parquet", "PARQUET"),), tuple(chain))


@query("SELECT l_returnflag, sum(l_linenumber)::BIGINT AS l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem WHERE l_quantity > 20 GROUP BY 1 ORDER BY l_quantity DESC LIMIT 2")
def r_pipeline(s, d):
    import tempfile

    from weftline import xmlio
    from weftline.session import Pipeline

    p = Pipeline(s, tempfile.mkdtemp(), xmlio.export(revenue_spec(d)))
    ok, error = p.run(lazy=True)
    if not ok:
        raise RuntimeError(error)
    return p.get_dataset("top_out")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def s_parquet(s, d):
    return readers.read(s, f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
