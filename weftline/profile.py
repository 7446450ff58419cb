"""Types found in text columns, and the recorded description of data sets."""

from __future__ import annotations

import datetime as dt
import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftline.semantics import ORD, col, is_number, is_time, kind, plain, visible

# Texts that mean a missing value.
NULL_TEXTS = ["none", "nan", "null", "n/a", "na", "#n/a", "#na", "#value!", "missing", "undefined", "<na>", ""]
THRESHOLD, LEAST_VALUES = 0.8, 3
FIRST_YEAR, LAST_YEAR = 1900, 2100
DAY_FIRST = ["d/M/yyyy", "d.M.yyyy", "d-M-yyyy", "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss", "d MMM yyyy"]
MONTH_FIRST = ["M/d/yyyy", "M.d.yyyy", "M-d-yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "MMM d yyyy"]
LARGE, LISTED = 1_000_000, 15


def text_or_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~F.lower(t).isin(NULL_TEXTS), t)


def _shape(form: str) -> str:
    """The regular expression of what a date format can read."""
    parts = {"yyyy": r"\d{4}", "MMM": "[A-Za-z]{3}", "mm": r"\d{2}", "ss": r"\d{2}", "MM": r"\d{2}", "dd": r"\d{2}", "d": r"\d{1,2}", "M": r"\d{1,2}", "H": r"\d{1,2}"}
    return "^" + re.sub("|".join(parts), lambda m: parts[m[0]], form.replace(".", r"\.")) + "$"


def _stamp(t: Column, formats: list[str]) -> Column:
    """A text as a time. Only texts of a format's shape are parsed by it, as a failure costs much more than a look."""
    iso = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.to_utc_timestamp(t.try_cast("timestamp"), "UTC").cast("timestamp_ntz"))
    return F.coalesce(iso, *[F.when(t.rlike(_shape(f)), F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz")) for f in [*formats, "yyyy/M/d", "yyyy/M/d H:mm:ss"]])


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"


def _in_years(c: Column) -> Column:
    return F.year(c).between(FIRST_YEAR, LAST_YEAR)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose values are times, numbers or truth values to at least 80 percent, cast to them.

    Columns of fewer than three values stay text. Texts that mean missing become null; so do, in a column
    that is cast, the values that don't fit. Whole numbers of the names date, time, timestamp and datetime that all
    lie in the range of epoch seconds or milliseconds become times. One job looks at all columns and rows.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    epochs = [f.name for f in df.schema if is_number(f.dataType) and re.search(r"date|time", f.name, re.I)]
    aggs = []
    # cleaned once, in a step of its own
    dated = lambda t: F.when(t.rlike(r"\d{4}") & ~t.rlike(NUMBER), t)  # noqa: E731, no other text can be a date
    base = df.select(*[x for n, c in enumerate(texts) for t in [text_or_null(col(c))] for x in (t.alias(f"t{n}"), dated(t).alias(f"d{n}"))], *[col(c).alias(f"e{n}") for n, c in enumerate(epochs)])
    for n in range(len(texts)):
        t, d = F.col(f"t{n}"), F.col(f"d{n}")
        number = F.when(t.rlike(NUMBER), t.try_cast("double"))
        first, second = F.regexp_extract(d, r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{4}", 1), F.regexp_extract(d, r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{4}", 2)
        compact = F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
        aggs += [
            F.count(t).alias(f"n{n}"),
            F.count(number).alias(f"num{n}"),
            F.count_if((number == F.floor(number)) & (F.abs(number) < 1e32)).alias(f"whole{n}"),
            F.count_if(_in_years(compact)).alias(f"compact{n}"),
            F.count_if(_in_years(_stamp(d, DAY_FIRST))).alias(f"day{n}"),
            F.count_if(_in_years(_stamp(d, MONTH_FIRST))).alias(f"month{n}"),
            F.count_if(first.try_cast("int") > 12).alias(f"dayfirst{n}"),
            F.count_if(second.try_cast("int") > 12).alias(f"monthfirst{n}"),
            F.count_if(F.lower(t).isin("true", "false", "yes", "no", "0", "1")).alias(f"bool{n}"),
        ]
    for n in range(len(epochs)):
        aggs += [F.min(f"e{n}").alias(f"lo{n}"), F.max(f"e{n}").alias(f"hi{n}")]
    if not aggs:
        return df
    found = base.agg(*aggs).first()
    out: dict[str, Column] = {}
    for n, c in enumerate(texts):
        t, total = text_or_null(col(c)), found[f"n{n}"]
        enough = lambda k: total >= LEAST_VALUES and found[f"{k}{n}"] >= THRESHOLD * total  # noqa: B023, E731
        formats = DAY_FIRST if found[f"dayfirst{n}"] and found[f"dayfirst{n}"] >= found[f"monthfirst{n}"] else MONTH_FIRST
        if enough("compact"):
            out[c] = F.try_to_timestamp(F.when(t.rlike(r"^\d{8}$"), t), F.lit("yyyyMMdd")).cast("timestamp_ntz")
        elif enough("num"):
            whole = found[f"whole{n}"] == found[f"num{n}"]
            number = F.when(t.rlike(NUMBER), t.try_cast("double"))
            out[c] = F.coalesce(F.when(t.rlike(NUMBER), t.try_cast("bigint")), number.try_cast("bigint")) if whole else number
        elif enough("day" if formats is DAY_FIRST else "month"):
            out[c] = _stamp(t, formats)
        elif total >= LEAST_VALUES and found[f"bool{n}"] == total:
            out[c] = F.lower(t).isin("true", "yes", "1")
            out[c] = F.when(t.isNotNull(), out[c])
        else:
            out[c] = F.when(~F.lower(F.trim(col(c))).isin(NULL_TEXTS), col(c))
    for n, c in enumerate(epochs):
        lo, hi = found[f"lo{n}"], found[f"hi{n}"]
        if lo is not None and 1e9 <= lo and hi < 1e10:
            out[c] = F.timestamp_seconds(col(c)).cast("timestamp_ntz")
        elif lo is not None and 1e12 <= lo and hi < 1e14:
            out[c] = F.timestamp_millis(col(c).cast("bigint")).cast("timestamp_ntz")
    return df.withColumns(out) if out else df


def field_type(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "BOOLEAN"
    if isinstance(t, T.IntegralType):
        return "INTEGER"
    if is_number(t):
        return "FLOAT"
    return "DATETIME" if is_time(t) else "STRING"


def _plain(v: object) -> object:
    if isinstance(v, dt.datetime):
        return int((v.replace(tzinfo=None) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)) * 1000
    if isinstance(v, dt.date):
        return int((v - dt.date(1970, 1, 1)).days) * 86_400_000_000_000
    return v if isinstance(v, (int, float, bool, str, type(None))) else str(v)


def describe(df: DataFrame, large: int = LARGE) -> dict:
    """``rows`` and per column id, name, type, bounds (times in nanoseconds), distinct count, listed values.

    Two aggregations at most: rows first, with bounds and approximate distinct counts; then exact ones, for
    numbers and times only up to ``large`` rows (-1 beyond). Values are listed where there are few: all below 15, else the
    first 12 and last 3 of the sorted ones.
    """
    df = plain(df)
    own = [c for c in visible(df) if not c.startswith("Unnamed:")]
    flat = df.select(*[(F.when(~F.isnan(col(c)), col(c)) if isinstance(kind(df, c), (T.FloatType, T.DoubleType)) else col(c).cast("string") if isinstance(kind(df, c), (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) and not isinstance(kind(df, c), T.BinaryType) else col(c)).alias(f"c{n}") for n, c in enumerate(own)])
    first = flat.agg(F.count("*").alias("rows"), *[x for n, c in enumerate(own) for x in (F.min(f"c{n}").alias(f"lo{n}"), F.max(f"c{n}").alias(f"hi{n}"), F.count(f"c{n}").alias(f"n{n}"), F.approx_count_distinct(f"c{n}").alias(f"a{n}"))]).first()
    exact = [n for n, c in enumerate(own) if first["rows"] <= large or not (is_number(kind(df, c)) or is_time(kind(df, c)))]
    listed = [n for n in exact if first[f"a{n}"] <= 1000]
    rest = [n for n in exact if n not in listed]
    counts = dict.fromkeys(range(len(own)), -1)
    values: dict[int, list] = {}
    aggs = [F.sort_array(F.collect_set(f"c{n}")).alias(f"s{n}") for n in listed] + [F.count_distinct(f"c{n}").alias(f"d{n}") for n in rest]
    if aggs:
        row = flat.agg(*aggs).first()
        for n in listed:  # sets of about a thousand values at most
            values[n], counts[n] = [_plain(v) for v in row[f"s{n}"]], len(row[f"s{n}"])
        for n in rest:
            counts[n] = row[f"d{n}"]
    out = []
    for n, c in enumerate(own):
        t = field_type(kind(df, c))
        some = values.get(n, []) if t in ("STRING", "BOOLEAN") else []
        shown = some if len(some) < LISTED else [*some[:12], "…", *some[-3:]]
        out.append({"id": n, "name": c, "type": t, "min": None if t in ("STRING", "BOOLEAN") else _plain(first[f"lo{n}"]), "max": None if t in ("STRING", "BOOLEAN") else _plain(first[f"hi{n}"]), "distinct": counts[n], "nulls": first["rows"] - first[f"n{n}"], "is_unique": counts[n] == first["rows"] > 0, "uniques": shown})
    return {"rows": first["rows"], "fields": out}


class Catalogue:
    """Descriptions of data sets in a JSON file, by name."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def read(self) -> dict[str, dict]:
        return json.loads(self.path.read_text(encoding="utf-8")) if self.path.exists() else {}

    def _write(self, data: dict[str, dict]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(data, ensure_ascii=False, indent=2), encoding="utf-8")

    def store(self, name: str, stats: dict, id_: str | None = None, **info: object) -> None:
        """Put in or replace; the same id under another name goes."""
        data = {k: v for k, v in self.read().items() if k == name or id_ is None or v.get("id") != id_}
        data[name] = {"id": id_, "last_updated": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"), "info": info} | stats
        self._write(data)

    def remove(self, name: str) -> bool:
        data = self.read()
        gone = data.pop(name, None) is not None
        if gone:
            self._write(data)
        return gone

    def merge(self, other: dict[str, dict]) -> None:
        self._write(self.read() | other)

    def clear(self) -> None:
        self._write({})

    def add_partition_field(self, name: str, parts: int) -> None:
        """The virtual field ``__partition__`` of a data set in parts."""
        data = self.read()
        fields = [f for f in data[name]["fields"] if f["name"] != "__partition__"]
        fields.append({"id": len(fields), "name": "__partition__", "type": "FLOAT", "min": 0.0, "max": float(parts - 1), "distinct": parts, "nulls": 0, "is_unique": False, "uniques": []})
        data[name]["fields"] = fields
        self._write(data)


def render(stats: dict[str, dict], style: str = "markdown", about: str = "", detailed: bool = False, many: int = 100) -> str:
    """Descriptions as markdown, json or a plain list; of very many fields only those that ``about`` names."""
    if style == "json":
        return json.dumps(stats, ensure_ascii=False, indent=2)
    lines = []
    for name, s in stats.items():
        fields = s["fields"]
        if len(fields) > many and not detailed and about:
            words = set(re.findall(r"\w+", about.lower()))
            fields = [f for f in fields if set(re.findall(r"\w+", f["name"].lower().replace("_", " "))) & words] or fields[:many]
        if style == "list":
            lines += [f"{name}.{f['name']}: {f['type']}" for f in fields]
            continue
        lines += [f"## {name} ({s['rows']} rows)", "", "| field | type | min | max | distinct | values |", "| --- | --- | --- | --- | --- | --- |"]
        lines += [f"| {f['name']} | {f['type']} | {f['min']} | {f['max']} | {f['distinct']} | {', '.join(map(str, f['uniques']))} |" for f in fields]
        lines.append("")
    return "\n".join(lines)


__all__ = ["ORD", "Catalogue", "describe", "field_type", "infer_types", "render", "text_or_null"]
