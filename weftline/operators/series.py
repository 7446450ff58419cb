"""Time series: date parts, windows over rows, lags, offsets and forecasts."""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from weftline.functions.ordered import framed, running_sum
from weftline.registry import transform
from weftline.semantics import ORD, col, is_time, kind, names, need, number, ordered

PARTS = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "DAY_OF_YEAR": F.dayofyear, "WEEKDAY": F.weekday}


def stamp(df: DataFrame, column: str) -> Column:
    """A column as a time without zone; text that can't be read is null."""
    t = kind(df, column)
    if isinstance(t, T.TimestampNTZType):
        return col(column)
    return col(column).cast("timestamp_ntz") if is_time(t) else F.trim(col(column).cast("string")).try_cast("timestamp_ntz")


@transform("extract_date_part", df="DATAFRAME", column="COLUMN_NAME", part="STRING", output_column="STRING")
def extract_date_part(df: DataFrame, column: str, part: str, output_column: str | None = None) -> DataFrame:
    """YEAR, MONTH, DAY, DAY_OF_YEAR or WEEKDAY (Monday is 0) of a time."""
    need(df, [column], "Column")
    if part.upper() not in PARTS:
        raise ValueError(f"Unsupported date part {part}")
    return df.withColumn(output_column or f"{column}_{part}", PARTS[part.upper()](stamp(df, column)))


AGGREGATES = {"MEAN": F.avg, "STD": F.stddev_samp, "MIN": F.min, "MAX": F.max, "SUM": F.sum}


@transform("rolling_statistics", df="DATAFRAME", column="COLUMN_NAME", window_size="INTEGER", function="STRING", group_by="COLUMN_NAME_OR_LIST", output_column="STRING", needs_order=True)
def rolling_statistics(df: DataFrame, column: str, window_size: int = 3, function: str = "MEAN", group_by: str | list[str] | None = None, output_column: str | None = None) -> DataFrame:
    """MEAN, STD, MIN, MAX or SUM over a centred window of rows, or CUMSUM over all rows so far.

    A window that isn't full of values gives null; windows of even size lean to earlier rows. Within groups
    rows of a missing key are null. Rows are cut into blocks, so no task sees all of them, or all of a hot group.
    """
    need(df, [column], "Column")
    name, keys, w = function.upper(), names(group_by), int(window_size)
    need(df, keys, "Group columns")
    if name != "CUMSUM" and name not in AGGREGATES:
        raise ValueError(f"Unsupported function {function}")
    out = output_column or f"{column}_{function.lower()}"
    hidden = ORD in df.columns
    df = ordered(df).withColumn("__x", number(df, column))
    before, after = w // 2, (w - 1) // 2

    def full(window: Window) -> Column:
        frame = window.rowsBetween(-before, after)
        return F.when(F.count("__x").over(frame) == w, AGGREGATES[name]("__x").over(frame))

    result = running_sum(df, "__x", out, keys=keys) if name == "CUMSUM" else framed(df, {out: full}, before, after, keys=keys)
    for k in keys:
        result = result.withColumn(out, F.when(col(k).isNotNull(), col(out)))
    return result.drop("__x") if hidden else result.drop("__x", ORD)


@transform("lag_lead", df="DATAFRAME", column="COLUMN_NAME", periods="INTEGER", output_column="STRING", needs_order=True)
def lag_lead(df: DataFrame, column: str, periods: int = 1, output_column: str | None = None) -> DataFrame:
    """The value some rows before (or, negative, after), over all rows, cut into blocks."""
    need(df, [column], "Column")
    p = int(periods)
    hidden = ORD in df.columns
    out = framed(ordered(df), {output_column or f"{column}_lag_{p}": lambda w: F.lag(col(column), p).over(w)}, max(p, 0), max(-p, 0))
    return out if hidden else out.drop(ORD)


UNITS = {"DAYS": "days", "HOURS": "hours", "MINUTES": "mins", "SECONDS": "secs", "WEEKS": "weeks"}


@transform("offset_datetime", df="DATAFRAME", column="COLUMN_NAME", offset="INTEGER", unit="STRING", output_column="STRING")
def offset_datetime(df: DataFrame, column: str, offset: float, unit: str = "DAYS", output_column: str | None = None) -> DataFrame:
    """Times moved by a number of units; months and years end at the end of a shorter month."""
    need(df, [column], "Column")
    u, t = unit.upper(), stamp(df, column)
    if u in ("MONTHS", "YEARS"):
        step = F.make_ym_interval(**{u.lower(): F.lit(int(offset))})
    elif u in UNITS:
        seconds = {"DAYS": 86400, "HOURS": 3600, "MINUTES": 60, "SECONDS": 1, "WEEKS": 604800}[u] * float(offset)
        step = F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    else:
        raise ValueError(f"Unsupported unit {unit}")
    return df.withColumn(output_column or f"{column}_offset", t + step)


# --- forecast -----------------------------------------------------------------------------------------

LAGS, WINDOWS = [1, 5, 10, 20], [5, 20]
MOST_ROWS, LEAST_ROWS = 5000, 25


def _regular(days: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    """The series on an even grid: business days filled forward, days interpolated, or steps of the usual gap.

    Times are in seconds.
    """
    gaps = np.diff(days)
    usual = Counter(gaps[gaps > 0].tolist()).most_common(1)[0][0] if (gaps > 0).any() else 86400
    day = 86400
    if day <= usual <= 2 * day:
        grid = np.arange(days[0] // day, days[-1] // day + 1)
        have = set((days // day).tolist())
        missing = [d for d in grid.tolist() if d not in have]
        weekend = [d for d in missing if (d + 3) % 7 >= 5]
        if missing and len(weekend) > 0.6 * len(missing):
            grid = grid[(grid + 3) % 7 < 5]
            at = np.searchsorted(days // day, grid, "right") - 1
            return grid * day, values[np.maximum(at, 0)], "business"
        return grid * day, np.interp(grid * day, days // day * day, values), "daily"
    grid = np.arange(days[0], days[-1] + 1, usual)
    return grid, np.interp(grid, days, values), "step"


def _next_times(last: int, how: str, usual: int, n: int) -> list[int]:
    out, t = [], last
    while len(out) < n:
        t += 86400 if how != "step" else usual
        if how != "business" or (t // 86400 + 3) % 7 < 5:
            out.append(t)
    return out


def _features(changes: np.ndarray) -> np.ndarray:
    """The features of the value after the given changes; one row per path (changes: paths x time)."""
    return np.column_stack([changes[:, -k] for k in LAGS] + [f(changes[:, -w:], axis=1) for w in WINDOWS for f in (np.mean, lambda a, axis: np.std(a, axis=axis, ddof=1))])


class _Forest:
    """The trees of a fitted Spark forest as arrays, walked by numpy."""

    def __init__(self, model: object):
        self.trees = [self._read(t.toDebugString) for t in model.trees]

    @staticmethod
    def _read(text: str) -> list[tuple]:
        """Nodes (feature, bound, left, right, value) of a tree's printed form."""
        lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines()[1:] if x.strip()]
        nodes: list[tuple] = []

        def build(at: int) -> tuple[int, int]:
            _, line = lines[at]
            me = len(nodes)
            nodes.append(())
            if m := re.match(r"Predict: (\S+)", line):
                nodes[me] = (-1, 0.0, 0, 0, float(m[1]))
                return me, at + 1
            m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
            left, at = build(at + 1)
            right, at = build(at + 1)  # past the line that says Else
            nodes[me] = (int(m[1]), float(m[2]), left, right, 0.0)
            return me, at

        if lines:
            build(0)
        return nodes

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for nodes in self.trees:
            feature, bound, left, right, value = (np.array(c) for c in zip(*nodes))
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= bound[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += value[at]
        return out / max(1, len(self.trees))


def _fit(df: DataFrame, x: np.ndarray, y: np.ndarray, trees: int, seed: int) -> _Forest:
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import RandomForestRegressor

    rows = df.sparkSession.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])
    return _Forest(RandomForestRegressor(numTrees=trees, maxDepth=10, seed=seed).fit(rows))


@transform("forecast_time_series", df="DATAFRAME", date_col="COLUMN_NAME", value_col="COLUMN_NAME", horizon="INTEGER", perform_split_test="BOOLEAN")
def forecast_time_series(df: DataFrame, date_col: str, value_col: str, horizon: int = 30, perform_split_test: object = False, trees: int = 200, paths: int = 100, seed: int = 42) -> DataFrame:
    """History and a forecast with a 5 to 95 percent band: ``Date, {value}, Forecast_Lower, Forecast_Upper, Is_Forecast``.

    With ``perform_split_test`` the last fifth is predicted instead: ``Date, Actual, Predicted``. A random
    forest learns the relative change from earlier changes; simulated paths give the band. The last 5000
    points of the series count, as in any forecast from recent history; fewer than 25 are an error.
    Cleaning and sorting run in Spark; the bounded series itself is handled on the driver.
    """
    need(df, [date_col, value_col])
    horizon = int(horizon)
    clean = df.select(stamp(df, date_col).alias("t"), number(df, value_col).cast("double").alias("v")).where("t is not null and v is not null")
    clean = clean.groupBy("t").agg(F.last("v").alias("v"))
    rows = clean.orderBy(F.desc("t")).limit(MOST_ROWS).collect()[::-1]
    if len(rows) < LEAST_ROWS:
        raise ValueError(f"Insufficient data: {len(rows)} rows, {LEAST_ROWS} are needed")
    epoch = dt.datetime(1970, 1, 1)
    times = np.array([int((r.t - epoch).total_seconds()) for r in rows])
    usual = Counter(np.diff(times).tolist()).most_common(1)[0][0]
    times, values, how = _regular(times, np.array([r.v for r in rows]))
    times, values = times[-MOST_ROWS:], values[-MOST_ROWS:]
    with np.errstate(divide="ignore", invalid="ignore"):
        change = np.nan_to_num(np.diff(values) / values[:-1], nan=0.0, posinf=0.0, neginf=0.0)
    first = max(LAGS + WINDOWS)
    if len(change) <= first + 3:
        raise ValueError(f"Insufficient data: {len(values)} points on an even grid")
    x = np.vstack([_features(change[None, :k]) for k in range(first, len(change))])
    y = change[first:]
    spark, at = df.sparkSession, lambda s: epoch + dt.timedelta(seconds=int(s))
    if str(perform_split_test).strip().lower() in ("true", "1", "yes"):
        cut = int(0.8 * len(y))
        predicted = _fit(df, x[:cut], y[:cut], trees, seed).predict(x[cut:])
        base = values[first + cut : first + len(y)]
        return spark.createDataFrame([(at(t), float(a), float(b * (1 + p))) for t, a, b, p in zip(times[first + cut + 1 :], values[first + cut + 1 :], base, predicted)], "Date timestamp_ntz, Actual double, Predicted double")
    cut = int(0.8 * len(y))
    spread = float(np.std(y[cut:] - _fit(df, x[:cut], y[:cut], max(10, trees // 4), seed).predict(x[cut:])))  # from points the forest hasn't seen
    forest = _fit(df, x, y, trees, seed)
    rng = np.random.default_rng(seed)
    past, level, track = np.repeat(change[None, -first:], paths, 0), np.full(paths, values[-1]), []
    for _ in range(horizon):
        step = forest.predict(_features(past)) + rng.normal(0, spread, paths)
        level = level * (1 + step)
        past = np.column_stack([past[:, 1:], step])
        track.append(np.percentile(level, [50, 5, 95]))
    out = [(at(t), float(v), None, None, False) for t, v in zip(times, values)]
    out += [(at(t), float(m), float(lo), float(hi), True) for t, (m, lo, hi) in zip(_next_times(int(times[-1]), how, usual, horizon), track)]
    return spark.createDataFrame(out, T.StructType([T.StructField("Date", T.TimestampNTZType()), T.StructField(value_col, T.DoubleType()), T.StructField("Forecast_Lower", T.DoubleType()), T.StructField("Forecast_Upper", T.DoubleType()), T.StructField("Is_Forecast", T.BooleanType())]))
