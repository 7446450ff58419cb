"""Pipelines as portable XML. The root's name is free; inputs and pipeline are found below it."""

from __future__ import annotations

from pathlib import Path
from xml.etree import ElementTree as E

from weftline.spec import InputPort, InputSpec, NodeSpec, OutputPort, Spec

SCHEMA_VERSION = "1.0.0"
ROOT = "pipelineDocument"
_OWN = {"id", "label", "location", "format", "visibility", "url"}


def _bool(text: str | None, default: bool) -> bool:
    return default if text is None else text.strip().lower() in ("true", "1", "yes")


def parse(source: str | Path) -> Spec:
    """A pipeline from XML text or a file. References may be numbers or names, in sourceRef or source_ref."""
    text = str(source)
    root = E.fromstring(text) if text.lstrip().startswith("<") else E.parse(text).getroot()
    inputs = []
    for e in root.iterfind("./inputs/input"):
        a = e.attrib
        inputs.append(InputSpec(a["id"], a.get("label", ""), a.get("location", ""), a.get("format", "").upper(), {k: v for k, v in a.items() if k not in _OWN}, _bool(a.get("visibility"), True), a.get("url", "")))
    nodes = []
    for e in [x for tag in ("pipeline", "nodes") for x in root.iterfind(f"./{tag}/node")]:
        ports = []
        for p in [*e.iterfind("./inputPorts/*"), *e.iterfind("./inputs/*"), *e.iterfind("./inputPort"), *e.iterfind("./input")]:
            ref = p.get("sourceRef") or p.get("source_ref")
            value = p.get("value") if p.get("value") is not None else (p.text.strip() if p.text and p.text.strip() else None)
            ports.append(InputPort(p.get("name", p.tag), None if ref else value, tuple(x.strip() for x in ref.split(",") if x.strip()) if ref else (), p.get("type", "")))
        outs = []
        for n, o in enumerate([*e.iterfind("./outputPorts/*"), *e.iterfind("./outputs/*"), *e.iterfind("./outputPort"), *e.iterfind("./output")]):
            outs.append(OutputPort(o.get("id", f"{e.get('id')}_{n}"), o.get("name", "result"), o.get("label", ""), o.get("type", "DATAFRAME"), _bool(o.get("visibility"), False)))
        kind = e.get("type") or e.get("function") or ""
        nodes.append(NodeSpec(e.get("id", ""), kind, e.get("label", ""), tuple(ports), tuple(outs) or (OutputPort(f"{e.get('id')}_result"),)))
    return Spec(tuple(inputs), tuple(nodes))


def export(spec: Spec, path: str | Path | None = None) -> str:
    """The XML text of a pipeline, also written to a file; parse() gives the same pipeline back."""
    root = E.Element(ROOT, schemaVersion=SCHEMA_VERSION)
    ins = E.SubElement(root, "inputs")
    for i in spec.inputs:
        a = {"id": i.id, "label": i.label, "location": i.location, "format": i.format, "visibility": str(i.visibility).lower(), "url": i.url} | i.options
        E.SubElement(ins, "input", {k: str(v) for k, v in a.items() if v != ""})
    pipe = E.SubElement(root, "pipeline")
    for n in spec.nodes:
        e = E.SubElement(pipe, "node", {k: v for k, v in {"id": n.id, "type": n.type, "label": n.label}.items() if v})
        for p in n.inputs:
            a = {"name": p.name} | ({"type": p.type} if p.type else {}) | ({"sourceRef": ",".join(p.sources)} if p.sources else {"value": "" if p.value is None else str(p.value)})
            E.SubElement(e, "inputPort", a)
        for o in n.outputs:
            E.SubElement(e, "outputPort", {k: v for k, v in {"id": o.id, "name": o.name, "label": o.label, "type": o.type, "visibility": str(o.visibility).lower()}.items() if v})
    E.indent(root)
    text = E.tostring(root, encoding="unicode", xml_declaration=False)
    if path is not None:
        Path(path).write_text('<?xml version="1.0" encoding="UTF-8"?>\n' + text + "\n", encoding="utf-8")
    return text
