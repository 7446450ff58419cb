"""JSON documents: flattening into tables, and a short description of their structure."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from weftline.registry import transform
from weftline.semantics import col, names

DEPTH, NODES = 64, 200_000
SAMPLE, LEAVES = 200, 50


class JsonTooDeepError(ValueError):
    """A document nested deeper than is read."""


def document(data: object) -> object:
    """The document itself: from text, from a table of one text column and one row, or as it is."""
    if isinstance(data, DataFrame):
        rows = data.limit(2).collect()
        if len(rows) != 1 or len(rows[0]) != 1:
            raise ValueError("a JSON document is a table of one row and one column")
        data = rows[0][0]
    return json.loads(data) if isinstance(data, (str, bytes)) else data


def flatten_structs(df: DataFrame, separator: str = "_") -> DataFrame:
    """Struct columns become columns ``outer_inner``, at any depth; arrays and maps stay."""
    while structs := [f for f in df.schema if isinstance(f.dataType, T.StructType)]:
        inside = {f.name: f.dataType.names for f in structs}
        out: list[Column] = []
        for f in df.schema:
            out += [col(f.name).getField(n).alias(f"{f.name}{separator}{n}") for n in inside[f.name]] if f.name in inside else [col(f.name)]
        df = df.select(*out)
    return df


def _flat(item: object, prefix: str = "") -> dict[str, object]:
    """Nested objects as one level of keys joined by an underscore."""
    if not isinstance(item, dict):
        return {prefix or "value": item}
    out: dict[str, object] = {}
    for k, v in item.items():
        key = f"{prefix}_{k}" if prefix else str(k)
        out |= _flat(v, key) if isinstance(v, dict) and v else {key: v}
    return out


def _frame(rows: list[dict[str, object]]) -> DataFrame:
    """Rows as a table, a type per column that holds its values; lists as JSON-typed arrays or text."""
    spark = SparkSession.active()
    cols = list(dict.fromkeys(k for r in rows for k in r))
    if not cols:
        return spark.range(len(rows)).select()
    fields, fix = [], {}
    for c in cols:
        kinds = {type(r[c]) for r in rows if r.get(c) is not None}
        if not kinds:
            fields.append(T.StructField(c, T.StringType()))
        elif kinds == {bool}:
            fields.append(T.StructField(c, T.BooleanType()))
        elif kinds == {int} and all(abs(r[c]) < 2**63 for r in rows if r.get(c) is not None):
            fields.append(T.StructField(c, T.LongType()))
        elif kinds <= {int, float}:
            fields.append(T.StructField(c, T.DoubleType()))
            fix[c] = float
        else:
            fields.append(T.StructField(c, T.StringType()))
            fix[c] = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    values = [tuple(None if r.get(c) is None else fix[c](r[c]) if c in fix else r[c] for c in cols) for r in rows]
    return spark.createDataFrame(values, T.StructType(fields))


def _list(data: list) -> list[dict[str, object]]:
    if all(isinstance(x, dict) for x in data):
        return [_flat(x) for x in data]
    if all(isinstance(x, list) for x in data):
        return [{str(n): v for n, v in enumerate(x)} for x in data]
    return [{"value": x} for x in data]


def _paired(data: dict) -> list[dict[str, object]]:
    """Arrays of [index, value, …] side by side, matched on the index."""
    merged: dict[object, dict[str, object]] = {}
    for key, rows in data.items():
        for row in rows:
            if row:
                at = merged.setdefault(row[0], {"index": row[0]})
                at |= {key: row[1]} if len(row) == 2 else {f"{key}_{n}": v for n, v in enumerate(row[1:], 1)}
    return [merged[k] for k in sorted(merged, key=lambda k: (isinstance(k, str), k))]


@transform("flatten_json", data="JSON", root_key="STRING", columns="LIST")
def flatten_json(data: object, root_key: str | None = None, columns: str | list[str] | None = None) -> DataFrame:
    """A document as a table, by its shape.

    ``root_key`` walks down dotted keys as far as they exist. A list of objects gives a row each, nested
    keys joined by _; a list of lists gives columns 0, 1, …; a list of plain values a column value; an
    object of arrays of pairs is matched on the first element as ``index``; an object of equally long
    plain arrays gives a column each; an object of one list is that list; any other object is one row.
    ``columns`` renames if there are as many. For tables that Spark read from JSON see flatten_structs.
    """
    if isinstance(data, DataFrame) and not (len(data.columns) == 1 and isinstance(data.schema[0].dataType, T.StringType)):
        return flatten_structs(data)
    doc = document(data)
    for key in (root_key or "").split("."):
        if key and isinstance(doc, dict) and key in doc:
            doc = doc[key]
        elif key and isinstance(doc, list) and key.isdigit() and int(key) < len(doc):
            doc = doc[int(key)]
        elif key:
            break
    df = _frame(_rows(doc))
    want = names(columns)
    return df.toDF(*want) if want and len(want) == len(df.columns) else df


def _rows(doc: object) -> list[dict[str, object]]:
    if isinstance(doc, list):
        return _list(doc)
    if isinstance(doc, dict) and doc:
        lists = list(doc.values())
        if all(isinstance(v, list) for v in lists):
            if all(v and all(isinstance(x, list) for x in v) for v in lists):
                return _paired(doc)
            plain = all(not isinstance(x, (list, dict)) for v in lists for x in v)
            if plain and len({len(v) for v in lists}) == 1 and len(lists) > 1:
                return [dict(zip(doc, values)) for values in zip(*lists)]
        if len(doc) == 1 and isinstance(lists[0], (list, dict)):
            return _rows(lists[0])
    return [_flat(doc)] if isinstance(doc, dict) else [{"value": doc}]


# --- description ------------------------------------------------------------------------------------


def check_depth(doc: object, most: int = DEPTH, nodes: int = NODES) -> None:
    todo, seen = [(doc, 1)], 0
    while todo and seen < nodes:
        x, depth = todo.pop()
        seen += 1
        if depth > most:
            raise JsonTooDeepError(f"the document is nested deeper than {most} levels")
        if isinstance(x, (dict, list)):
            todo += [(v, depth + 1) for v in (x.values() if isinstance(x, dict) else x)]


KINDS = {bool: "BOOLEAN", int: "INTEGER", float: "FLOAT", str: "STRING", type(None): "NULL"}


def infer(doc: object, most: int = SAMPLE) -> dict:
    """The structure of a document: types, properties and items, lists by their first elements."""
    if isinstance(doc, dict):
        return {"type": "object", "properties": {str(k): infer(v, most) for k, v in doc.items()}}
    if isinstance(doc, list):
        items: dict | None = None
        for x in doc[:most]:
            items = infer(x, most) if items is None else merge(items, infer(x, most))
        return {"type": "array", "items": items or {}}
    return {"type": KINDS.get(type(doc), "STRING").lower()}


def merge(a: dict, b: dict) -> dict:
    if a == b or not b:
        return a
    if not a:
        return b
    if a.get("type") == b.get("type") == "object":
        keys = list(dict.fromkeys([*a["properties"], *b["properties"]]))
        return {"type": "object", "properties": {k: merge(a["properties"].get(k, {}), b["properties"].get(k, {})) for k in keys}}
    if a.get("type") == b.get("type") == "array":
        return {"type": "array", "items": merge(a["items"], b["items"])}
    kinds = {a.get("type"), b.get("type")}
    if kinds == {"integer", "float"}:
        return {"type": "float"}
    if "null" in kinds and len(kinds) == 2:
        return a if b.get("type") == "null" else b
    options = [x for s in (a, b) for x in s.get("anyOf", [s])]
    return {"anyOf": [x for n, x in enumerate(options) if x not in options[:n]]}


def leaves(schema: dict, path: str = "") -> list[tuple[str, str]]:
    """(dotted path, type) of all leaves, each once."""
    if "anyOf" in schema:
        found = [x for s in schema["anyOf"] for x in leaves(s, path)]
        return list(dict.fromkeys(found))
    if schema.get("type") == "object":
        return [x for k, s in schema["properties"].items() for x in leaves(s, f"{path}.{k}" if path else k)]
    if schema.get("type") == "array":
        return leaves(schema["items"], f"{path}[]") if schema["items"] else [(f"{path}[]", "NULL")]
    return [(path or "value", schema.get("type", "null").upper())]


@transform("cartograph_json", output="DICT", data="JSON", max_chars="INTEGER", max_items="INTEGER")
def cartograph_json(data: object, max_chars: int = 5000, max_items: int = SAMPLE) -> dict:
    """``schema`` (compact text), ``length``, ``tabular``, ``extract_with`` and up to 50 leaf ``fields``.

    Lists are described by their first elements, as a description is for reading.
    """
    doc = document(data)
    check_depth(doc)
    schema = infer(doc, int(max_items))
    rows, at = doc, None
    if isinstance(doc, dict):
        lists = [(k, v) for k, v in doc.items() if isinstance(v, list)]
        if len(lists) == 1 and all(isinstance(x, dict) for x in lists[0][1][:max_items]):
            at, rows = lists[0]
        elif len(doc) and len(lists) == len(doc):
            rows = next(iter(doc.values()))
    flat = isinstance(rows, list) and bool(rows) and all(not isinstance(v, (dict, list)) for x in rows[:max_items] for v in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else [x]))
    tabular = flat and (isinstance(doc, list) or at is not None and len(doc) == 1 or isinstance(doc, dict) and len({len(v) for v in doc.values() if isinstance(v, list)}) == 1 and all(isinstance(v, list) for v in doc.values()))
    text = json.dumps(schema, ensure_ascii=False, separators=(",", ":"))
    return {
        "schema": text if len(text) <= max_chars else text[: max_chars - 1] + "…",
        "length": len(rows) if isinstance(rows, list) else 1,
        "tabular": bool(tabular),
        "extract_with": "flatten_json" + (f"(root_key={at!r})" if at else ""),
        "fields": [{"path": p, "type": k} for p, k in leaves(schema)[:LEAVES]],
    }


class _Guarded:
    def __getattr__(self, name: str) -> object:
        raise AttributeError(f"this input is a JSON document, not a DataFrame: it has no {name!r}; use flatten_json first")


class GuardedList(_Guarded, list):
    """A list that explains itself when it is used as a table."""

    def __getitem__(self, key: object) -> object:
        if isinstance(key, str):
            raise TypeError("this input is a JSON list, not a DataFrame; use flatten_json to get columns")
        return list.__getitem__(self, key)


class GuardedDict(_Guarded, dict):
    """An object that explains itself when it is used as a table."""

    def __getitem__(self, key: object) -> object:
        if isinstance(key, (list, tuple)):
            raise TypeError("this input is a JSON object, not a DataFrame; use flatten_json to get columns")
        return dict.__getitem__(self, key)


def guarded(doc: object) -> object:
    return GuardedList(doc) if isinstance(doc, list) else GuardedDict(doc) if isinstance(doc, dict) else doc


def key_counts(docs: DataFrame, column: str) -> DataFrame:
    """``key, n``: the top-level keys of a table of JSON texts, over all rows."""
    return docs.select(F.explode(F.json_object_keys(col(column))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


__all__ = ["cartograph_json", "check_depth", "flatten_json", "flatten_structs", "guarded", "infer", "key_counts", "leaves"]
