"""A pipeline at work: edit it, run it, read its data.

A run compiles the nodes that visible outputs (or leaves) depend on into DataFrames and writes only those
outputs; everything between is one plan per output, which Catalyst prunes and orders as a whole. A port
that several written outputs share is persisted for the run.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftline import export as visual, xmlio
from weftline.profile import Catalogue, describe, infer_types
from weftline.registry import Transform, load_all, port_value
from weftline.security import resolve
from weftline.semantics import clean, ordered, plain
from weftline.sources import readers, sheets, signals  # noqa: F401
from weftline.spec import InputPort, InputSpec, NodeSpec, OutputPort, Spec

_SPECIAL = {"join", "union"}


class Pipeline:
    """``workspace`` holds inputs/, outputs/ and the catalogue; ``source`` is XML text, a file or a Spec."""

    def __init__(self, spark: SparkSession, workspace: str | Path, source: str | Path | Spec | None = None):
        self.spark, self.workspace = spark, Path(workspace)
        self.workspace.mkdir(parents=True, exist_ok=True)
        self.registry: dict[str, Transform] = dict(load_all())
        self.memory: dict[str, DataFrame | object] = {}
        self.catalogue = Catalogue(self.workspace / "catalogue_stats.json")
        self._listeners: list[Callable[[str, dict], None]] = []
        self._hash: str | None = None
        self._cache: dict[str, object] = {}
        self._nodes: dict[str, object] = {}
        self._writing = False
        own = self.workspace / "pipeline.xml"
        self.spec = Spec()
        self.load(source if source is not None else own if own.exists() else Spec())

    def __enter__(self) -> Pipeline:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # --- editing ---------------------------------------------------------------------------------

    def load(self, source: str | Path | Spec) -> None:
        self.spec = source if isinstance(source, Spec) else xmlio.parse(source)
        self._changed()

    update_from_spec = load

    def reset_spec(self) -> None:
        self.memory.clear()
        self.load(Spec())

    def close(self) -> None:
        self._forget()
        self._listeners.clear()

    def _forget(self) -> None:
        for d in self._cache.values():
            if isinstance(d, DataFrame) and d.is_cached:
                d.unpersist()
        self._cache.clear()
        self._nodes.clear()

    def _changed(self) -> None:
        self._hash = None
        self._forget()

    def _edit(self, spec: Spec, event: str, **what: object) -> None:
        self.spec = spec
        self._changed()
        self._tell(event, **what)

    def give_id(self) -> str:
        return self.spec.next_id()

    def add_input(self, id_: object = None, label: str = "", location: str = "", format: str = "", data: object = None, visibility: bool = True, url: str = "", **options: object) -> str:  # noqa: A002
        """An input from a file, an address, or data in memory (a Spark or pandas frame, a list or an object)."""
        id_ = str(id_) if id_ is not None else self.give_id()
        if data is not None:
            if not isinstance(data, (DataFrame, dict, list, str)):
                data = self.spark.createDataFrame(data)
            self.memory[id_] = clean(data) if isinstance(data, DataFrame) else data
            format = "MEMORY"  # noqa: A001
        elif not format and location:
            format = readers.format_of(location)  # noqa: A001
        self._edit(self.spec.with_input(InputSpec(id_, label or f"input_{id_}", location, format.upper(), {k: str(v) for k, v in options.items()}, visibility, url)), "input_added", id=id_)
        return id_

    def add_node(self, type: str, id_: object = None, label: str = "", inputs: dict[str, object] | None = None, params: dict[str, object] | None = None, outputs: list[OutputPort] | None = None, visibility: bool = True) -> str:  # noqa: A002
        """A node; ``inputs`` maps ports to ids (or lists of them), ``params`` to values. Its id."""
        if type not in self.registry:
            raise ValueError(f"unknown transform {type}")
        id_ = str(id_) if id_ is not None else self.give_id()
        ports = [InputPort(k, None, tuple(str(x) for x in (v if isinstance(v, (list, tuple)) else [v]))) for k, v in (inputs or {}).items()]
        ports += [InputPort(k, v if isinstance(v, str) else json.dumps(v) if isinstance(v, (list, dict)) else str(v)) for k, v in (params or {}).items()]
        if outputs is None:
            taken = max([int(x) for x in self.spec.ids() | {id_} if x.isdigit()], default=0)
            outputs = [OutputPort(str(taken + 1), "result", "", self.registry[type].output, visibility)]
        self._edit(self.spec.with_node(NodeSpec(id_, type, label or f"{type}_({id_})", tuple(ports), tuple(outputs))), "node_added", id=id_)
        return id_

    def remove_node(self, id_: object) -> None:
        self._edit(self.spec.without_node(str(id_)), "node_removed", id=str(id_))

    def remove_input(self, id_: object) -> None:
        self.memory.pop(str(id_), None)
        self._edit(self.spec.without_input(str(id_)), "input_removed", id=str(id_))

    def register_transform(self, name: str, call: Callable, **ports: str) -> None:
        """A transform for this pipeline only."""
        self.registry[name] = Transform(name, call, "DATAFRAME", ports)

    def register_files(self, paths: list[str]) -> list[str]:
        """Inputs for files, with ids that depend on their names only; known names are passed over.

        Workbooks get a node that makes plain tables of them; JSON inputs are not visible. A folder is one input.
        """
        known, out = {os.path.basename(i.location) for i in self.spec.inputs}, []
        for p in paths:
            base = os.path.basename(str(p).rstrip("/"))
            if base in known or base.endswith((".raw", ".zraw")):
                continue
            known.add(base)
            n = zlib.crc32(Path(base).stem.encode()) % 9000 + 1000
            while str(n) in self.spec.ids():
                n += 1
            kind = "DICOM" if os.path.isdir(p) and not any(Path(p).glob("*.parquet")) else "PARQUET" if os.path.isdir(p) else readers.format_of(base)
            out.append(self.add_input(n, Path(base).stem, str(p), kind, visibility=kind not in ("JSON", "XLSX", "ODS")))
            if kind in ("XLSX", "ODS"):
                self.add_node("tidy_excel_data", inputs={"path_excel": str(n)}, label=f"tidy_{Path(base).stem}")
        return out

    def remove_files(self, names: list[str]) -> int:
        gone = [i.id for i in self.spec.inputs if os.path.basename(i.location) in names]
        for i in gone:
            self.remove_input(i)
        return len(gone)

    def count_files(self, names: list[str] | None = None) -> int:
        """The number of inputs that are files, or of those of these names."""
        own = [os.path.basename(i.location) for i in self.spec.inputs if i.location]
        return len(own) if names is None else sum(n in names for n in own)

    # --- events ------------------------------------------------------------------------------------

    def subscribe(self, f: Callable[[str, dict], None]) -> None:
        self._listeners.append(f)

    def unsubscribe(self, f: Callable[[str, dict], None]) -> None:
        if f in self._listeners:
            self._listeners.remove(f)

    def _tell(self, event: str, **what: object) -> None:
        for f in list(self._listeners):
            f(event, what)

    # --- compiling -----------------------------------------------------------------------------------

    def _input(self, i: InputSpec) -> object:
        if i.id in self.memory:
            return self.memory[i.id]
        location = i.location
        if i.url and not location:
            location = readers.download(i.url, str(self.workspace / "inputs"))
        options = {k: v for k, v in i.options.items() if k not in ("temporalFiles", "collectionTimeMode", "collectionTimeDelta")}
        files = [resolve(x.strip(), str(self.workspace)) for x in i.options.get("temporalFiles", "").split("|") if x.strip()]
        if files:
            return {k: infer_types(d) if i.format in ("CSV", "TSV") else d for k, d in readers.temporal(self.spark, files, i.format, **options).items()}
        path = resolve(location, str(self.workspace))
        if i.format in ("XLSX", "XLSM", "ODS"):
            return path
        df = readers.read(self.spark, path, i.format, **options)
        return infer_types(df) if i.format in ("CSV", "TSV") else df

    def _port(self, ref: str) -> object:
        """The data of a reference, compiled at most once."""
        at, node, name = self.spec.resolve(ref)
        if at not in self._cache:
            if node is None:
                self._cache[at] = self._input(next(i for i in self.spec.inputs if i.id == at))
            else:
                if node.id not in self._nodes:
                    self._tell("node_running", id=node.id)
                    try:
                        self._nodes[node.id] = self._call(node)
                    except Exception:
                        self._tell("node_failed", id=node.id)
                        raise
                    if not self._writing:
                        self._tell("node_completed", id=node.id)
                result = self._nodes[node.id]
                if isinstance(result, dict) and set(result) == {"result", "mask"}:
                    result = result["mask" if name == "mask" else "result"]
                self._cache[at] = result
        return self._cache[at]

    def _call(self, node: NodeSpec) -> object:
        t = self.registry.get(node.type)
        if t is None:
            raise ValueError(f"unknown transform {node.type} in node {node.id}")
        args: dict[str, object] = {}
        tables: dict[str, DataFrame] = {}
        repeated = Counter(p.name for p in node.inputs if p.sources)
        free = [p for p, k in t.ports.items() if k in ("DATAFRAME", "JSON", "IMAGE", "DICT")]
        for p in node.inputs:
            for ref in p.sources:
                data = self._port(ref)
                if node.type in _SPECIAL:
                    key = p.name if p.name not in t.ports and repeated[p.name] == 1 and len(p.sources) == 1 else self.spec.get_name(self.spec.resolve(ref)[0])
                    if key in tables:  # the port's own name, then a number
                        key = p.name if p.name not in tables else next(f"{p.name}_{n}" for n in range(2, 10**6) if f"{p.name}_{n}" not in tables)
                    tables[key] = data
                elif p.name in t.ports or node.type == "execute_code":
                    args[p.name] = data
                elif open_ := [f for f in free if f not in args]:
                    args[open_[0]] = data
                else:
                    args[p.name] = data
            if not p.sources and p.value is not None:
                if p.name not in t.ports:
                    open_ = [q for q in t.ports if q not in args and q not in free and q not in [x.name for x in node.inputs]]
                    if not open_:
                        raise ValueError(f"node {node.id}: {node.type} has no port {p.name}")
                    args[open_[0]] = port_value(p.value, t.ports[open_[0]])
                else:
                    args[p.name] = port_value(p.value, t.ports[p.name])
        if any(o.name == "mask" for o in node.outputs) and "return_mask" in t.ports:
            args["return_mask"] = True
        if t.needs_order:
            args = {k: ordered(v) if isinstance(v, DataFrame) else v for k, v in args.items()}
        return t.call(tables, **args) if node.type in _SPECIAL else t.call(**args)

    # --- running ---------------------------------------------------------------------------------------

    def _digest(self) -> str:
        h = hashlib.sha256(json.dumps(asdict(self.spec), sort_keys=True).encode())
        for i in self.spec.inputs:
            p = resolve(i.location, str(self.workspace)) if i.location else ""
            if p and os.path.exists(p):
                h.update(f"{p}{os.path.getmtime(p)}".encode())
            if i.id in self.memory:
                h.update(str(id(self.memory[i.id])).encode())
        return h.hexdigest()

    def output_path(self, name: str) -> str:
        return str(self.workspace / "outputs" / name)

    def run(self, lazy: bool = False, stats: bool = True) -> tuple[bool, str]:
        """Compile, and (unless ``lazy``) write the visible outputs, or the leaves where none is visible.

        (True, "") or (False, what went wrong); nothing is raised. Nothing happens if nothing has changed.
        """
        digest = self._digest()
        if digest == self._hash:
            return True, ""
        self._forget()
        try:
            self.spec.order()
            shown = [o for n in self.spec.nodes for o in n.outputs if o.visibility] or [o for n in self.spec.nodes for o in n.outputs if o.id in self.spec.leaves()]
            uses = Counter(a for o in shown for a in self.spec.ancestors(o.id) - {o.id})
            behind = {o.id: {n.id for n in self.spec.nodes for p in n.outputs if p.id in self.spec.ancestors(o.id) | {o.id}} for o in shown}
            for n in self.spec.nodes:
                if any(n.id in ids for ids in behind.values()):
                    self._tell("node_pending", id=n.id)
            self._writing = not lazy
            for o in shown:
                self._port(o.id)
            if not lazy:
                done: set[str] = set()
                inner = {o.id for n in self.spec.nodes for o in n.outputs}
                shared = [d for a, k in uses.items() if k > 1 and a in inner and isinstance(d := self._cache.get(a), DataFrame)]
                for d in shared:
                    d.persist()
                for o in shown:
                    try:
                        self._write(o)
                    except Exception:
                        self._tell("node_failed", id=self.spec.resolve(o.id)[1].id)
                        raise
                    for n in [n.id for n in self.spec.nodes if n.id in behind[o.id] - done]:
                        self._tell("node_completed", id=n)  # its rows have been computed
                    done |= behind[o.id]
                for d in shared:
                    d.unpersist()
                if stats:
                    self._stats(shown)
            self._hash = digest
            return True, ""
        except Exception as e:  # noqa: BLE001
            return False, f"{type(e).__name__}: {e}"
        finally:
            self._writing = False

    def _write(self, o: OutputPort) -> None:
        name, data = self.spec.get_name(o.id), self._cache[o.id]
        path = Path(self.output_path(name))
        if isinstance(data, DataFrame) and o.type in ("FLOAT", "INTEGER", "BOOLEAN", "STRING"):
            self._cache[o.id] = data.first()[0]
        elif isinstance(data, DataFrame):
            plain(data).write.mode("overwrite").parquet(str(path) + ".parquet")
        elif isinstance(data, dict) and data and all(isinstance(v, DataFrame) for v in data.values()):
            shutil.rmtree(f"{path}_partitioned", ignore_errors=True)
            for key, d in data.items():
                plain(d).write.mode("overwrite").parquet(f"{path}_partitioned/{key}.parquet")
        else:
            path.parent.mkdir(parents=True, exist_ok=True)
            Path(str(path) + ".json").write_text(json.dumps(data, ensure_ascii=False, default=str), encoding="utf-8")

    def _stats(self, shown: list[OutputPort]) -> None:
        for i in self.spec.inputs:
            data = self._cache.get(i.id)
            if isinstance(data, DataFrame) and i.visibility:
                self.catalogue.store(self.spec.get_name(i.id), describe(data), i.id)
        for o in shown:
            data, name = self._cache[o.id], self.spec.get_name(o.id)
            for key, d in (data.items() if isinstance(data, dict) else [("", data)]):
                if isinstance(d, DataFrame):
                    self.catalogue.store(f"{name}_{key}" if key else name, describe(self._written(o, key) or d), f"{o.id}_{key}" if key else o.id)

    def _written(self, o: OutputPort, key: str) -> DataFrame | None:
        base = self.output_path(self.spec.get_name(o.id))
        path = f"{base}_partitioned/{key}.parquet" if key else base + ".parquet"
        return self.spark.read.parquet(path) if os.path.exists(path) else None

    # --- reading ---------------------------------------------------------------------------------------

    def get_dataset(self, id_: object, time: int | None = None) -> object:
        """The data of an id or name: a DataFrame, a scalar, a dict, or one point of time of a collection."""
        data = self._port(str(id_))
        at, node, _ = self.spec.resolve(str(id_))
        if node is None and isinstance(data, dict) and data and all(isinstance(v, DataFrame) for v in data.values()):
            return readers.at_time(data, time)
        if node is not None and isinstance(data, DataFrame):
            o = next(o for o in node.outputs if o.id == at)
            if o.type in ("FLOAT", "INTEGER", "BOOLEAN", "STRING"):
                return data.first()[0]
        return plain(data) if isinstance(data, DataFrame) else data

    def list_data(self) -> dict[str, str]:
        """Names by id of all inputs and output ports."""
        return {x: self.spec.get_name(x) for x in [i.id for i in self.spec.inputs] + [o.id for n in self.spec.nodes for o in n.outputs]}

    def get_id_for_name(self, name: str) -> str | None:
        return next((k for k, v in self.list_data().items() if v == name), None)

    def get_inputs(self) -> list[str]:
        return [i.id for i in self.spec.inputs]

    def get_visibles(self) -> list[str]:
        return self.spec.visible()

    def get_leaves(self) -> list[str]:
        return self.spec.leaves()

    def get_datasets_metadata(self) -> dict[str, dict]:
        return self.catalogue.read()

    def export_to_xml(self, path: str | Path | None = None) -> str:
        return xmlio.export(self.spec, path if path is not None else self.workspace / "pipeline.xml")

    def export_visual(self, path: str | Path) -> str:
        """The visualisation XML of the visible data sets."""
        names = {self.spec.get_name(x) for x in self.spec.visible()}
        files = {n: self.output_path(n) + ".parquet" for n in names if os.path.exists(self.output_path(n) + ".parquet")}
        return visual.export(self.catalogue.read(), files, path, {n for n in self.catalogue.read() if any(n == m or n.startswith(m + "_") for m in names)})

    def promote_leaves(self) -> list[str]:
        """Make inputs of the leaves: their data are written below inputs/, their nodes and inputs that nothing
        reads any more go. Ids of the new inputs."""
        out, spec = [], self.spec
        for leaf in self.get_leaves():
            _, node, _ = spec.resolve(leaf)
            data = self._port(leaf)
            parts = data if isinstance(data, dict) and all(isinstance(v, DataFrame) for v in data.values()) else {"": data}
            for key, d in parts.items():
                if not isinstance(d, DataFrame):
                    continue
                name = spec.get_name(leaf) + (f"_{key}" if key else "")
                path = f"inputs/{name}.parquet"
                plain(d).write.mode("overwrite").parquet(str(self.workspace / path))
                out.append((name, path))
        doomed = {self.spec.resolve(x)[1].id for x in self.get_leaves()}
        kept = replace(spec, nodes=tuple(n for n in spec.nodes if n.id not in doomed))
        used = kept.consumed()
        kept = replace(kept, inputs=tuple(i for i in kept.inputs if i.id in used or not any(i.id in spec.ancestors(x) for x in self.get_leaves())))
        self._edit(kept, "promoted")
        return [self.add_input(None, name, path, "PARQUET") for name, path in out]
