"""Folding of configuration expressions to values, for one project at a time.

An expression is a function call, a reference, a literal or a template; operators are left as they
stand. What can't be resolved stays verbatim in templates and is None on its own.
"""

from __future__ import annotations

import base64
import datetime
import ipaddress
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSES = 10
_CALL = re.compile(r"^([a-z_][a-z0-9_]*)\s*\((.*)\)$", re.S)
_TEMPLATE = re.compile(r"\$\{([^{}]*)\}")
_NUMBER = re.compile(r"^-?\d+(\.\d+)?$")
_MISSING = object()


def _flatten(xs: Any) -> list:  # noqa: ANN401
    return [y for x in xs for y in (_flatten(x) if isinstance(x, list) else [x])]


def _distinct(xs: list) -> list:
    """The first of equals stays, in its place; what has parts is equal by its text."""
    first: dict[Any, Any] = {}
    for x in xs:
        first.setdefault(x if isinstance(x, str | int | float | bool) or x is None else json.dumps(x, sort_keys=True), x)
    return list(first.values())


def _element(xs: list, i: int) -> Any:  # noqa: ANN401
    return xs[i] if -len(xs) <= i < len(xs) else None


def _text(x: Any) -> str:  # noqa: ANN401
    return x if isinstance(x, str) else json.dumps(x)


#: Any of these that fails gives None.
FUNCTIONS: dict[str, Callable[..., Any]] = {
    "join": lambda sep, xs: sep.join(_text(x) for x in (xs if isinstance(xs, list) else [xs]) if x is not None),
    "split": lambda sep, x: x.split(sep),
    "concat": lambda *xs: [y for x in xs if isinstance(x, list) for y in x],
    "merge": lambda *ms: {k: v for m in ms if isinstance(m, dict) for k, v in m.items()},
    "lookup": lambda m, k, d=None: m.get(k, d) if isinstance(m, dict) else d,
    "format": lambda f, *xs: f % xs,
    "lower": lambda x: x.lower(),
    "upper": lambda x: x.upper(),
    "replace": lambda x, a, b: (x or "").replace(a or "", b or ""),
    "length": lambda x: len(x) if x is not None else 0,
    "keys": lambda m: list(m),
    "values": lambda m: list(m.values()),
    "element": lambda xs, i: _element(xs, int(i)),
    "flatten": _flatten,
    "distinct": _distinct,
    "compact": lambda xs: [x for x in xs if x is not None and x not in ("", [])],
    "contains": lambda xs, x: isinstance(xs, list) and x in xs,
    "min": lambda *xs: min(x for x in xs if x is not None),
    "max": lambda *xs: max(x for x in xs if x is not None),
    "range": lambda *xs: list(range(*map(int, xs))),
    "jsonencode": json.dumps,
    "jsondecode": json.loads,
    "base64encode": lambda x: base64.b64encode(x.encode()).decode(),
    "base64decode": lambda x: base64.b64decode(x).decode(),
    "cidrsubnet": lambda c, bits, n: str(list(_subnet(c, int(bits), int(n)))[0]),
}


def _subnet(cidr: str, bits: int, number: int) -> Iterator:
    net = ipaddress.ip_network(cidr, strict=False)
    new = net.prefixlen + bits
    at = int(net.network_address) + (number << (net.max_prefixlen - new))
    out = ipaddress.ip_network((at, new))
    if number < 0 or not out.subnet_of(net):
        raise ValueError(cidr)
    yield out


def arguments(text: str) -> list[str]:
    """Split at commas outside of quotes and brackets."""
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        if c == '"' and (not i or text[i - 1] != "\\"):
            quoted = not quoted
        elif not quoted:
            depth += (c in "([{") - (c in ")]}")
            if c == "," and not depth:
                out.append(text[start:i].strip())
                start = i + 1
    last = text[start:].strip()
    return [*out, last] if last else out


class Scope:
    """Variables, locals, fixed names and resources of a project, its files' texts by path, and the time.

    Attributes of resources are folded when they are referred to; one that refers to itself is not resolved.
    """

    def __init__(self, variables: dict[str, Any], locals_: dict[str, Any], resources: dict[str, dict] | None = None, files: dict[str, str] | None = None, now: str | None = None) -> None:
        self.resources, self.stack = resources or {}, []
        self.functions = dict(FUNCTIONS)
        if files is not None:
            self.functions |= {"file": files.get, "filebase64": lambda p: base64.b64encode(files[p].encode()).decode()}
        self.functions["timestamp"] = lambda: now or datetime.datetime.now(datetime.UTC).isoformat().removesuffix("+00:00") + "Z"
        self.names: dict[str, Any] = {f"var.{k}": v for k, v in variables.items()} | {"terraform.workspace": "default", "path.module": ".", "path.root": ".", "path.cwd": "."}
        self.open = dict(locals_)
        for _ in range(PASSES):
            done = {k: x for k, v in self.open.items() if not unresolved(x := self.fold(v))}
            if not done:
                break
            self.names |= {f"local.{k}": v for k, v in done.items()}
            self.open = {k: v for k, v in self.open.items() if k not in done}

    def reference(self, text: str) -> Any:  # noqa: ANN401
        parts = text.split(".")
        head = ".".join(parts[:2])
        at = self.names.get(head, _MISSING)
        if at is _MISSING and head in self.resources and len(parts) > 2:
            name = ".".join(parts[:3])
            if parts[2] not in self.resources[head] or name in self.stack:
                return _MISSING
            self.stack.append(name)
            at = self.fold(self.resources[head][parts[2]])
            self.stack.pop()
            if unresolved(at):
                return _MISSING
            parts = parts[1:]
        for p in parts[2:]:
            if isinstance(at, dict):
                at = at.get(p, _MISSING)
            elif isinstance(at, list) and p.isdigit() and int(p) < len(at):
                at = at[int(p)]
            else:
                return _MISSING
        return at

    def expression(self, text: str) -> Any:  # noqa: ANN401
        text = text.strip()
        if (m := _CALL.match(text)) and m[1] in self.functions:
            args = [self.expression(a) for a in arguments(m[2])]
            if any(a is _MISSING for a in args):
                return _MISSING
            try:
                return self.functions[m[1]](*args)
            except Exception:  # noqa: BLE001  a failing function gives null
                return None
        if text in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[text]
        if _NUMBER.match(text):
            return json.loads(text)
        if len(text) > 1 and text[0] == text[-1] == '"':
            return self.fold(text[1:-1])
        if text.startswith("[") and text.endswith("]"):
            xs = [self.expression(a) for a in arguments(text[1:-1])]
            return _MISSING if any(x is _MISSING for x in xs) else xs
        return self.reference(text) if re.fullmatch(r"[A-Za-z_][\w.-]*", text) else _MISSING

    def fold(self, value: Any) -> Any:  # noqa: ANN401
        if isinstance(value, dict):
            return {k: self.fold(v) for k, v in value.items()}
        if isinstance(value, list):
            return [self.fold(v) for v in value]
        if not isinstance(value, str) or "${" not in value:
            return value
        if value.startswith("${") and value.endswith("}") and "${" not in value[2:]:
            x = self.expression(value[2:-1])
            return value if x is _MISSING else x

        def one(m: re.Match[str]) -> str:
            x = self.expression(m[1])
            return m[0] if x is _MISSING else x if isinstance(x, str) else str(x) if isinstance(x, bool) else json.dumps(x)

        return _TEMPLATE.sub(one, value)


def unresolved(value: Any) -> bool:  # noqa: ANN401
    if isinstance(value, dict):
        return any(map(unresolved, value.values()))
    if isinstance(value, list):
        return any(map(unresolved, value))
    return isinstance(value, str) and "${" in value


def resolved(objects: DataFrame, supplied: DataFrame | None = None, files: dict[str, str] | None = None, now: str | None = None) -> DataFrame:
    """``project, full_name, attributes`` (JSON), ``is_resolved``: all attributes folded, by project. A
    project's objects come together in one task, as its locals depend on each other. ``supplied`` has
    ``name, value`` (JSON) and wins over defaults; ``files`` are texts that expressions may read, by path."""
    given = {r.name: json.loads(r.value) for r in supplied.collect()} if supplied is not None else {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bodies = [json.loads(x) if x else {} for x in pdf.attributes_text]
        rows = list(zip(pdf.type, pdf.name, pdf.full_name, bodies, strict=True))
        variables = {n: b.get("default") for t, n, _, b in rows if t == "variable" and "default" in b} | given
        scope = Scope(variables, {n: b.get("value") for t, n, _, b in rows if t == "local"}, {f: b for t, _, f, b in rows if t == "resource"}, files, now)
        out = [(f, scope.fold(b)) for _, _, f, b in rows]
        return pd.DataFrame({"project": pdf.project.iloc[0], "full_name": [f for f, _ in out], "attributes": [json.dumps(x) for _, x in out], "is_resolved": [not unresolved(x) for _, x in out]})

    return objects.select("project", "full_name", "type", "name", F.col("attributes_text")).groupBy("project").applyInPandas(run, "project string, full_name string, attributes string, is_resolved boolean")
