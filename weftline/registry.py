"""The registry of transforms: name, function, typed ports, and what each does to the row order."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree as E

from weftline.semantics import names, truth

_XS = "{http://www.w3.org/2001/XMLSchema}"

PORT_TYPES = ("DATAFRAME", "LIST", "FLOAT", "INTEGER", "BOOLEAN", "STRING", "JSON", "DICT", "IMAGE", "COLUMN_NAME", "COLUMN_NAME_OR_LIST")


@dataclass(frozen=True)
class Transform:
    name: str
    call: Callable
    output: str = "DATAFRAME"
    ports: dict[str, str] = field(default_factory=dict)
    needs_order: bool = False


REGISTRY: dict[str, Transform] = {}


def transform(name: str, output: str = "DATAFRAME", needs_order: bool = False, **ports: str) -> Callable:
    """Register a function as a transform; ``ports`` gives the type of each parameter."""
    bad = {t for t in ports.values() if t not in PORT_TYPES}
    if bad:
        raise ValueError(f"unknown port types {bad}")

    def add(f: Callable) -> Callable:
        REGISTRY[name] = Transform(name, f, output, ports, needs_order)
        return f

    return add


def port_value(value: object, kind: str) -> object:
    """A port's text as its type; the text itself where it can't be read as a number."""
    if not isinstance(value, str):
        return value
    text = value.strip()
    if kind in ("FLOAT", "INTEGER"):
        try:
            return float(text) if kind == "FLOAT" else int(float(text))
        except (ValueError, OverflowError):
            return value
    if kind == "BOOLEAN":
        return truth(text)
    if kind == "LIST":
        return names(text)
    if kind == "COLUMN_NAME_OR_LIST":
        found = names(text)
        return found if len(found) != 1 else found[0]
    return value


def catalogue_text() -> str:
    """All transforms with their ports, one line each."""
    load_all()
    return "\n".join(f"{t.name}({', '.join(f'{p}: {k}' for p, k in t.ports.items())}) -> {t.output}" for t in REGISTRY.values())


def schema_text() -> str:
    """The transforms as an XML schema: a complex type each, whose annotation names the function and whose
    elements are the ports, each with its type as ``Semantic``."""
    load_all()
    root = E.Element(f"{_XS}schema")
    for t in REGISTRY.values():
        kind = E.SubElement(root, f"{_XS}complexType", name=t.name)
        E.SubElement(E.SubElement(kind, f"{_XS}annotation"), "function", name=t.name, output=t.output)
        ports = E.SubElement(kind, f"{_XS}sequence")
        for name, port in t.ports.items():
            element = E.SubElement(ports, f"{_XS}element", name=name, type="xs:string")
            E.SubElement(E.SubElement(element, f"{_XS}annotation"), f"{_XS}documentation").text = f"(Semantic: {port})"
    return E.tostring(root, encoding="unicode")


def read_schema(text: str) -> dict[str, Transform]:
    """Name, output and ports of the transforms in an XML schema; elements in choices count as ports too.

    A port's type is its ``Semantic``, else that of its schema type, else STRING.
    """
    plain = {"double": "FLOAT", "float": "FLOAT", "decimal": "FLOAT", "integer": "INTEGER", "int": "INTEGER", "long": "INTEGER", "boolean": "BOOLEAN"}
    out = {}
    for kind in E.fromstring(text).iter(f"{_XS}complexType"):
        head = kind.find(".//function")
        if head is None or not head.get("name"):
            continue
        ports = {}
        for e in kind.iter(f"{_XS}element"):
            said = re.search(r"\(Semantic:\s*(\w+)\)", "".join(x for x in e.itertext()))
            own = plain.get((e.get("type") or "").split(":")[-1], "STRING")
            ports[e.get("name")] = said[1] if said and said[1] in PORT_TYPES else own
        known = REGISTRY.get(head.get("name"))
        out[head.get("name")] = Transform(head.get("name"), known.call if known else None, head.get("output") or "DATAFRAME", ports)
    return out


def load_all() -> dict[str, Transform]:
    """Import every module that registers transforms."""
    from weftline.operators import aggregate, code, columns, filters, geo, images, jsons, labels, maths, multi, rows, series, tidy  # noqa: F401

    return REGISTRY
