"""XML for a visualisation engine: what data there are, their fields, and where they lie."""

from __future__ import annotations

from pathlib import Path
from xml.etree import ElementTree as E

ROOT = "visuSpec"


def _field(parent: E.Element, f: dict) -> None:
    a = {"id": str(f["id"]), "name": f["name"], "type": f["type"], "distinct": str(f["distinct"]), "isUnique": str(f["is_unique"]).lower()}
    if f.get("min") is not None:
        a |= {"min": str(f["min"]), "max": str(f["max"])}
    if f.get("uniques"):
        a["uniques"] = ",".join(map(str, f["uniques"]))
    E.SubElement(parent, "field", a)


def export(stats: dict[str, dict], files: dict[str, str], path: str | Path | None = None, allowed: set[str] | None = None) -> str:
    """``<datas>`` with a ``<rawData>`` per data set; an existing file is kept but for the data sets given.

    ``allowed`` leaves others than these names out.
    """
    root = E.parse(path).getroot() if path is not None and Path(path).exists() else E.Element(ROOT)
    datas = root.find("datas")
    if datas is None:
        datas = E.SubElement(root, "datas")
    for name, s in stats.items():
        if allowed is not None and name not in allowed:
            continue
        for old in [d for d in datas if d.get("name") == name]:
            datas.remove(old)
        e = E.SubElement(datas, "rawData", id=str(s.get("id") or name), name=name, rows=str(s["rows"]))
        fields = E.SubElement(e, "fields")
        for f in s["fields"]:
            _field(fields, f)
        if name in files:
            E.SubElement(e, "file", location=files[name])
    E.indent(root)
    text = E.tostring(root, encoding="unicode")
    if path is not None:
        Path(path).write_text(text, encoding="utf-8")
    return text


def scaffold(path: str | Path) -> str:
    """An empty document."""
    return export({}, {}, path)


def read(path: str | Path) -> dict[str, dict]:
    """The data sets of a document: id, rows, fields and file by name."""
    out = {}
    for e in E.parse(path).getroot().iterfind("./datas/rawData"):
        f = e.find("file")
        out[e.get("name")] = {"id": e.get("id"), "rows": int(e.get("rows", 0)), "fields": [dict(x.attrib) for x in e.iterfind("./fields/field")], "file": None if f is None else f.get("location")}
    return out
