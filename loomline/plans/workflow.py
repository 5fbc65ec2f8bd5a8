"""A workflow: operators and the links between them."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any


class PlanError(ValueError):
    """A plan that can't run, and why."""


@dataclass(frozen=True)
class Op:
    id: str
    type: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Link:
    origin: str
    destination: str


@dataclass(frozen=True)
class Workflow:
    """Operators by id and links in the order given; equal links count once."""

    ops: dict[str, Op]
    links: tuple[Link, ...]

    @classmethod
    def from_json(cls, text: str) -> Workflow:
        """A plan with the keys ``operators`` (operatorID, operatorType, parameters) and
        ``links`` (origin, destination)."""
        try:
            plan = json.loads(text)
            listed = [Op(o["operatorID"], o["operatorType"], {k: v for k, v in o.items() if k not in ("operatorID", "operatorType")}) for o in plan["operators"]]
            links = [Link(x["origin"], x["destination"]) for x in plan["links"]]
        except (KeyError, TypeError, json.JSONDecodeError) as error:
            raise PlanError(f"not a plan: {error!r}") from error
        return cls.of(listed, links)

    @classmethod
    def of(cls, ops: list[Op], links: list[Link]) -> Workflow:
        ids = [o.id for o in ops]
        if twice := sorted({i for i in ids if ids.count(i) > 1}):
            raise PlanError(f"operators listed twice: {twice}")
        made = cls({o.id: o for o in ops}, tuple(dict.fromkeys(links)))
        made.order  # noqa: B018  raises on a cycle
        return made

    def to_json(self) -> str:
        ops = [{"operatorID": o.id, "operatorType": o.type, **o.params} for o in self.ops.values()]
        return json.dumps({"operators": ops, "links": [{"origin": x.origin, "destination": x.destination} for x in self.links]}, sort_keys=True)

    @cached_property
    def inputs(self) -> dict[str, list[str]]:
        """Origins of each operator's links, in order."""
        out: dict[str, list[str]] = {i: [] for i in self.ops}
        for x in self.links:
            for end in (x.origin, x.destination):
                if end not in self.ops:
                    raise PlanError(f"a link names no operator: {end}")
            out[x.destination].append(x.origin)
        return out

    @cached_property
    def outputs(self) -> dict[str, list[str]]:
        out = defaultdict(list)
        for destination, origins in self.inputs.items():
            for origin in origins:
                out[origin].append(destination)
        return {i: out[i] for i in self.ops}

    @property
    def sources(self) -> list[str]:
        return [i for i, x in self.inputs.items() if not x]

    @property
    def sinks(self) -> list[str]:
        return [i for i, x in self.outputs.items() if not x]

    @cached_property
    def order(self) -> list[str]:
        """Operators so that inputs come first."""
        left = {i: len(set(x)) for i, x in self.inputs.items()}
        ready, out = [i for i, n in left.items() if not n], []
        while ready:
            out.append(i := ready.pop(0))
            for d in dict.fromkeys(self.outputs[i]):
                left[d] -= 1
                if not left[d]:
                    ready.append(d)
        if len(out) < len(self.ops):
            raise PlanError(f"the plan has a cycle through {sorted(set(self.ops) - set(out))}")
        return out

    def upstream(self, target: str) -> set[str]:
        """target and all that it depends on."""
        seen, todo = set(), [target]
        while todo:
            if (i := todo.pop()) not in seen:
                seen.add(i)
                todo += self.inputs[i]
        return seen

    def fingerprint(self, target: str, salt: str = "") -> str:
        """A name for what target computes: its operators, parameters and links."""
        below = self.upstream(target)
        part = [[i, self.ops[i].type, self.ops[i].params, self.inputs[i]] for i in sorted(below)]
        return hashlib.sha256(json.dumps([part, salt], sort_keys=True).encode()).hexdigest()[:32]
