"""What a pipeline is: inputs, nodes, ports and outputs, and how their data are named."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field, replace


def sanitize(name: str) -> str:
    """Small plain letters, digits and single underscores."""
    text = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", text)).strip("_")


@dataclass(frozen=True)
class InputSpec:
    id: str
    label: str = ""
    location: str = ""
    format: str = ""
    options: dict[str, str] = field(default_factory=dict)
    visibility: bool = True
    url: str = ""


@dataclass(frozen=True)
class InputPort:
    """A parameter: a static value, or references to data by id."""

    name: str
    value: str | None = None
    sources: tuple[str, ...] = ()
    type: str = ""


@dataclass(frozen=True)
class OutputPort:
    id: str
    name: str = "result"
    label: str = ""
    type: str = "DATAFRAME"
    visibility: bool = False


@dataclass(frozen=True)
class NodeSpec:
    id: str
    type: str
    label: str = ""
    inputs: tuple[InputPort, ...] = ()
    outputs: tuple[OutputPort, ...] = ()


@dataclass(frozen=True)
class Spec:
    inputs: tuple[InputSpec, ...] = ()
    nodes: tuple[NodeSpec, ...] = ()

    def get_name(self, id_: str) -> str:
        """The data set's name of an input, an output port, or a node's result; unknown ids as they are."""
        id_ = str(id_)
        for i in self.inputs:
            if i.id == id_:
                return sanitize(i.label) or id_
        for n in self.nodes:
            for o in n.outputs:
                if o.id == id_:
                    return sanitize(o.label) if o.label else f"{sanitize(n.label or n.id)}_{'out' if o.name == 'result' else sanitize(o.name)}"
        for n in self.nodes:
            if n.id == id_ and n.outputs:
                return self.get_name(n.outputs[0].id)
        return id_

    def resolve(self, ref: str) -> tuple[str, NodeSpec | None, str]:
        """What a reference means: (id of the input or port, its node, the port's name).

        References may be ids of inputs, output ports or nodes, or names of data sets, also ``node_port``.
        """
        ref = str(ref)
        for i in self.inputs:
            if ref == i.id:
                return i.id, None, ""
        ports = [(n, o) for n in self.nodes for o in n.outputs]
        for n, o in ports:
            if ref == o.id:
                return o.id, n, o.name
        for n in self.nodes:
            if ref == n.id and n.outputs:
                first = next((o for o in n.outputs if o.name == "result"), n.outputs[0])
                return first.id, n, first.name
        for i in self.inputs:
            if sanitize(ref) == self.get_name(i.id) or ref == i.label:
                return i.id, None, ""
        for n, o in ports:
            if ref in (self.get_name(o.id), f"{n.id}_{o.name}", f"{sanitize(n.label)}_{sanitize(o.name)}", o.label or None):
                return o.id, n, o.name
        raise ValueError(f"reference {ref} not found")

    def ids(self) -> set[str]:
        return {i.id for i in self.inputs} | {n.id for n in self.nodes} | {o.id for n in self.nodes for o in n.outputs}

    def next_id(self) -> str:
        return str(max([int(x) for x in self.ids() if x.isdigit()], default=0) + 1)

    def with_input(self, new: InputSpec) -> Spec:
        """With an input added, or put in the place of that with its id."""
        if new.id in {n.id for n in self.nodes} | {o.id for n in self.nodes for o in n.outputs}:
            raise ValueError(f"id {new.id} is taken")
        kept = [new if i.id == new.id else i for i in self.inputs]
        return replace(self, inputs=tuple(kept if any(i.id == new.id for i in self.inputs) else [*kept, new]))

    def with_node(self, new: NodeSpec) -> Spec:
        others = [n for n in self.nodes if n.id != new.id]
        taken = {i.id for i in self.inputs} | {n.id for n in others} | {o.id for n in others for o in n.outputs}
        if clash := ({new.id} | {o.id for o in new.outputs}) & taken:
            raise ValueError(f"ids {sorted(clash)} are taken")
        kept = [new if n.id == new.id else n for n in self.nodes]
        return replace(self, nodes=tuple(kept if any(n.id == new.id for n in self.nodes) else [*kept, new]))

    def without_node(self, id_: str) -> Spec:
        return replace(self, nodes=tuple(n for n in self.nodes if n.id != str(id_)))

    def without_input(self, id_: str) -> Spec:
        return replace(self, inputs=tuple(i for i in self.inputs if i.id != str(id_)))

    def visible(self) -> list[str]:
        """Ids of visible inputs and output ports."""
        return [i.id for i in self.inputs if i.visibility] + [o.id for n in self.nodes for o in n.outputs if o.visibility]

    def consumed(self) -> set[str]:
        out = set()
        for n in self.nodes:
            for p in n.inputs:
                for s in p.sources:
                    try:
                        out.add(self.resolve(s)[0])
                    except ValueError:
                        continue
        return out

    def leaves(self) -> list[str]:
        """Ids of output ports that no node reads."""
        used = self.consumed()
        return [o.id for n in self.nodes for o in n.outputs if o.id not in used]

    def ancestors(self, id_: str) -> set[str]:
        """Ids of the inputs and ports that a port depends on, with its own."""
        found, todo = set(), [id_]
        while todo:
            at, node, _ = self.resolve(todo.pop())
            if at in found:
                continue
            found.add(at)
            if node:
                todo += [s for p in node.inputs for s in p.sources]
        return found

    def select(self, **wanted: object) -> list[InputSpec | NodeSpec]:
        """Inputs and nodes whose attributes have these values."""
        return [x for x in [*self.inputs, *self.nodes] if all(getattr(x, k, None) == v for k, v in wanted.items())]

    def order(self) -> list[NodeSpec]:
        """Nodes so that each follows those it reads; a circle is an error."""
        done: list[NodeSpec] = []
        state: dict[str, int] = {}

        def visit(n: NodeSpec) -> None:
            if state.get(n.id) == 2:
                return
            if state.get(n.id) == 1:
                raise ValueError(f"node {n.id} depends on itself")
            state[n.id] = 1
            for p in n.inputs:
                for s in p.sources:
                    if (up := self.resolve(s)[1]) is not None:
                        visit(up)
            state[n.id] = 2
            done.append(n)

        for n in self.nodes:
            visit(n)
        return done
