"""Faceted search: a query text becomes one predicate over the node table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'(\w+:)?"([^"]*)"|(\S+)')
#: Columns in which free terms are looked for.
TEXT = ("name", "full_name", "type", "subtype", "state", "details")


def terms(text: str) -> list[tuple[str | None, str]]:
    """``(facet, value)`` of a query; the facet is None for free terms. Quotes keep phrases together."""
    out: list[tuple[str | None, str]] = []
    for m in _TOKEN.finditer(text):
        if m[3] is None:
            out.append(((m[1] or "").rstrip(":").lower() or None, m[2].lower()))
        elif ":" in m[3] and m[3].split(":", 1)[0].lower() in FACETS:
            k, v = m[3].split(":", 1)
            out.append((k.lower(), v.lower()))
        else:
            out.append((None, m[3].lower()))
    return out


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _tagged(v: str) -> Column:
    tags = F.coalesce(F.map_entries("tags"), F.array().cast("array<struct<key:string,value:string>>"))
    return F.exists(tags, lambda t: F.lower(F.concat_ws("=", t["key"], t["value"])).contains(v))


def _has(v: str) -> Column:
    degree = F.col("dependencies") + F.col("dependents")
    groups = {
        "dependencies": F.col("dependencies") > 0,
        "dependents": F.col("dependents") > 0,
        "tag": F.coalesce(F.size("tags"), F.lit(0)) > 0,
        "tags": F.coalesce(F.size("tags"), F.lit(0)) > 0,
        "error": F.col("state").isin("broken", "missing_dependency", "incomplete"),
        "warning": F.col("state").isin("unused", "orphaned", "isolated", "complex"),
        "links": degree > 0,
    }
    return groups.get(v, F.lit(False))


FACETS = {
    "type": lambda v: _low("type") == v,
    "state": lambda v: _low("state") == v,
    "subtype": lambda v: _low("subtype") == v,
    "provider": lambda v: _low("provider").contains(v),
    "mindeps": lambda v: F.col("dependencies") + F.col("dependents") >= int(v),
    "maxdeps": lambda v: F.col("dependencies") + F.col("dependents") <= int(v),
    "tag": _tagged,
    "badge": _tagged,
    "has": _has,
}


def predicate(text: str) -> Column:
    """All terms must hold; an empty query holds for every node."""
    out = F.lit(True)
    body = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in TEXT)))
    for facet, value in terms(text):
        out = out & (FACETS[facet](value) if facet in FACETS else body.contains(value))
    return out


def toggled(nodes: DataFrame, edges: DataFrame, types: list[str], states: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the chosen types and states (an empty list chooses all), and the edges with both ends among them."""
    kept = nodes
    if types:
        kept = kept.where(F.col("type").isin(types))
    if states:
        kept = kept.where(F.col("state").isin(states))
    name = kept.select(F.col("full_name").alias("k_"))
    return kept, edges.join(name, F.col("src") == F.col("k_"), "left_semi").join(name, F.col("dst") == F.col("k_"), "left_semi")


def complexity_at_least(high: bool) -> Column:
    return (F.col("dependencies") + F.col("dependents")) / 2 >= (3 if high else 1)


def dependencies_at_least(many: bool) -> Column:
    return F.col("dependencies") + F.col("dependents") >= (4 if many else 2)


def critical_state() -> Column:
    return F.col("state").isin("external_data", "orphaned", "incomplete")


def sort_keys(by: str, name: str = "name", kind: str = "type", subtype: str = "subtype", degree: str = "degree") -> list[Column]:
    """What nodes are sorted by: ``name``, ``type`` (then subtype) or ``dependencies`` (most first); ties by name, so that reruns agree."""
    keys = {"name": [F.asc(name)], "type": [F.asc(kind), F.asc(F.coalesce(F.col(subtype), F.lit("")))], "dependencies": [F.desc(degree)]}
    if by not in keys:
        raise ValueError(f"no order {by}; there are {', '.join(sorted(keys))}")
    return [*keys[by], F.asc(name)]
