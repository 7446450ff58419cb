"""Descriptions of files by their format, in the form of weftline.profile.describe."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from weftline.functions.storage import first_bytes
from weftline.operators import images, jsons
from weftline.profile import describe, infer_types
from weftline.sources import readers, signals

SUPPORTED = ("CSV", "TSV", "PARQUET", "ORC", "JSONL", "JSON", "IMAGE", "EDF", "MHD", "DICOM")


def _field(n: int, name: str, kind: str, low: object = None, high: object = None, distinct: int = -1, **more: object) -> dict:
    return {"id": n, "name": name, "type": kind, "min": low, "max": high, "distinct": distinct, "nulls": 0, "is_unique": False, "uniques": []} | more


def _grid(sizes: list[int], spacing: list[float], colour: tuple[float, float] | None) -> list[dict]:
    """Fields of a picture or volume: positions along each axis, and the value."""
    out = [_field(n, f"position_{a}", "FLOAT", 0.0, (s - 1) * d, s) for n, (a, s, d) in enumerate(zip("xyz", sizes, spacing))]
    return [*out, _field(len(out), "color_value", "FLOAT", *(colour or (None, None)))]


def describe_image(spark: SparkSession, path: str) -> dict:
    m = images.image_metadata(readers.read(spark, path, "IMAGE")).first()
    if m is None:
        raise ValueError(f"{path} is not a readable image")
    return {"rows": m.width * m.height, "fields": _grid([m.width, m.height], [1.0, 1.0], (0.0, 255.0)), "info": m.asDict()}


def describe_mhd(path: str) -> dict:
    h = signals.mhd_header(first_bytes(path, 1 << 20).decode("latin-1"))
    sizes = [int(x) for x in h["DimSize"].split()]
    spacing = [float(x) for x in h.get("ElementSpacing", h.get("ElementSize", " ".join("1" for _ in sizes))).split()]
    return {"rows": reduce(int.__mul__, sizes), "fields": _grid(sizes, spacing, None), "info": h}


def describe_dicom(path: str) -> dict:
    """One DICOM image, or a folder of slices."""
    files = sorted(os.path.join(path, x) for x in os.listdir(path)) if os.path.isdir(path) else [path]
    heads = []
    for p in files:
        heads.append(signals.dicom_header(first_bytes(p, 1 << 20)))
    h = heads[0]
    gap = [float(x) for x in str(h.get("spacing", "1\\1")).split("\\")]
    sizes = [int(h["columns"]), int(h["rows"])] + ([len(files)] if len(files) > 1 else [])
    return {"rows": reduce(int.__mul__, sizes), "fields": _grid(sizes, [gap[1], gap[0], float(h.get("thickness") or 1)], None), "info": h}


def describe_edf(path: str) -> dict:
    """Per channel the physical range, rate and unit; annotations are left out."""
    h = signals.edf_header(first_bytes(path, 256 * 1024))
    own = [c for c in h.channels if "Annotations" not in c.label]
    fields = [_field(n, c.label, "FLOAT", c.physical_min, c.physical_max, rate=c.rate, units=c.unit) for n, c in enumerate(own)]
    return {"rows": max([c.samples * h.records for c in own], default=0), "fields": fields, "info": {"start": h.start, "seconds": h.records * h.record_seconds}}


def describe_json(spark: SparkSession, path: str) -> dict:
    """The columns if the document is a table, else its leaves; how to extract it is in ``info``."""
    doc = readers.read(spark, path, "JSON")
    chart = jsons.cartograph_json(doc)
    if chart["tabular"]:
        d = describe(jsons.flatten_json(doc))
    else:
        d = {"rows": chart["length"], "fields": [_field(n, f["path"], f["type"]) for n, f in enumerate(chart["fields"])]}
    return d | {"info": {"extract_with": chart["extract_with"], "tabular": chart["tabular"]}}


def file_stats(spark: SparkSession, paths: list[str]) -> dict | None:
    """The description of one file, or of several tables as one; None for formats without one."""
    kind = "DICOM" if os.path.isdir(paths[0]) and any(p.endswith(".dcm") for p in os.listdir(paths[0])) else readers.format_of(paths[0]) or ("PARQUET" if os.path.isdir(paths[0]) else "")
    if kind not in SUPPORTED:
        return None
    one = {"IMAGE": lambda p: describe_image(spark, p), "MHD": describe_mhd, "DICOM": describe_dicom, "EDF": describe_edf, "JSON": lambda p: describe_json(spark, p)}
    if kind in one:
        return one[kind](paths[0])
    parts: list[DataFrame] = [readers.read(spark, p, kind) for p in paths]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return describe(infer_types(df) if kind in ("CSV", "TSV") else df)
