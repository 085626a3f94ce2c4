"""Documents of a project: one-row aggregates rendered as text, and tables in common formats."""

from __future__ import annotations

import io
import json
import time
import zipfile
from collections.abc import Callable
from html import escape
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph, metrics
from ..plans.storage import written

# Colours of node kinds, and the levels of SARIF.
COLOURS = {"resource": "lightblue", "data": "lightgreen", "module": "orange", "variable": "lightyellow", "output": "lightpink", "provider": "lightgrey", "local": "white", "terraform": "grey"}
SARIF_LEVELS = {"error": "error", "warning": "warning", "info": "note"}

# A diagram's classes of nodes with fill and stroke, and the signs of kinds.
CLASSES = (
    ("variable", "#e1f5fe", "#01579b"), ("local", "#e8f5e8", "#1b5e20"), ("output", "#fffde7", "#f57f17"), ("resource", "#ffebee", "#c62828"), ("data", "#f3e5f5", "#7b1fa2"), ("module", "#fff3e0", "#ef6c00"), ("provider", "#fff9c4", "#f9a825"), ("default", "#f5f5f5", "#616161"),
)
SIGNS = {"variable": "📝", "local": "💬", "output": "📤", "resource": "🛠️", "data": "📊", "module": "📦", "provider": "⚙️"}


def project_document(objects: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """One row, ``document``: the whole project as JSON: objects by kind with their dependencies, and counts."""
    deps = edges.groupBy(F.col("src").alias("full_name")).agg(F.sort_array(F.collect_set("dst")).alias("dependencies"))
    users = edges.groupBy(F.col("dst").alias("full_name")).agg(F.sort_array(F.collect_set("src")).alias("dependents"))
    o = objects.join(states.select("full_name", "state", "state_reason"), "full_name", "left").join(deps, "full_name", "left").join(users, "full_name", "left")
    one = F.struct("full_name", "type", "name", "resource_type", "state", "state_reason", "file_path", "line_number", "description", "tags", "dependencies", "dependents", "attributes")
    kinds = o.select("type", F.to_json(one).alias("json"), "full_name")
    lists = kinds.groupBy("type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("full_name", "json"))).alias("o"))
    part = lists.select("type", "n", F.concat(F.lit("["), F.array_join(F.transform("o", lambda x: x["json"]), ","), F.lit("]")).alias("text"))
    whole = part.agg(F.array_sort(F.collect_list(F.struct("type", "n", "text"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: F.concat(F.lit('"'), x["type"], F.lit('":'), x["text"])), ",")
    counts = F.array_join(F.transform("p", lambda x: F.concat(F.lit('"'), x["type"], F.lit('":'), x["n"].cast("string"))), ",")
    return whole.select(F.concat(F.lit('{"objects":{'), body, F.lit('},"statistics":{"counts":{'), counts, F.lit("}}}")).alias("document"))


#: Columns of an object that a document shows, where there are such.
SHOWN = ("full_name", "type", "name", "resource_type", "provider", "state", "state_reason", "file_path", "line_number", "description", "tags", "dependencies", "dependents", "attributes")
_ORDER = ("section", "kind", "step", "name")


def _counted(rows: DataFrame, by: str) -> DataFrame:
    """A JSON object of counts by a column of few values, as one row's column ``json``."""
    n = rows.where(F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias("k")).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))), F.lit("{}")).alias("json"))


def project_lines(objects: DataFrame, edges: DataFrame, metadata: dict | None = None, variables: DataFrame | None = None, backend: DataFrame | None = None, issues: DataFrame | None = None, name: Callable[[Column], Column] | None = None) -> DataFrame:
    """``section, kind, step, name, line``: a project as one JSON document, in lines that stand in the order of the first four columns.

    It holds ``metadata``, the variables given (``name, value``), the backend (``backend``, as JSON), statistics, a summary of
    the issues, and every object by kind, with its dependencies and dependents, on a line of its own. No row holds more than one object, so
    a document may be of any size; see ``write_lines``. With ``name``, edges go by the number that objects have as ``id``, and names are
    only put in their place in the lines.
    """
    spark, key = objects.sparkSession, "id" if name else "full_name"
    # Edges are shuffled as they are, not as sets of one or two. Both uses read them alike, so that what lies below is made once.
    whole = edges.where("src is not null and dst is not null")
    laid = lambda by, rows: rows if by == "src" and getattr(edges, "by_src", False) else rows.repartition(key)
    ends = lambda by, of, told: laid(by, whole.select(F.col(by).alias(key), F.col(of).alias("end"))).groupBy(key).agg(F.collect_set("end").alias(told))
    o = objects.join(ends("src", "dst", "dependencies"), key, "left").join(ends("dst", "src", "dependents"), key, "left")
    o = o.withColumns({c: F.array_sort(F.transform(c, name) if name else F.col(c)) for c in ("dependencies", "dependents")})
    shown = F.to_json(F.struct(*(c for c in SHOWN if c in o.columns)))
    o = written(o.select("type", "full_name", *(c for c in ("state",) if c in o.columns), shown.alias("json")))
    line = lambda section, text, step=0: F.struct(F.lit(section).alias("section"), F.lit("").alias("kind"), F.lit(step).alias("step"), F.lit("").alias("name"), text.alias("line"))
    first = o.groupBy(F.col("type").alias("kind")).agg(F.min("full_name").alias("first"))  # a row for each kind
    lead = first.agg(F.min("kind").alias("lead"))
    body = o.join(F.broadcast(first), F.col("type") == F.col("kind")).select(F.lit(6).alias("section"), "kind", F.lit(1).alias("step"), F.col("full_name").alias("name"), F.concat(F.when(F.col("full_name") == F.col("first"), "").otherwise(","), "json").alias("line"))
    heads = first.crossJoin(lead)  # one row of the least kind
    opened = heads.select(F.lit(6).alias("section"), "kind", F.lit(0).alias("step"), F.lit("").alias("name"), F.concat(F.when(F.col("kind") == F.col("lead"), "").otherwise(","), F.to_json(F.array("kind")).substr(F.lit(2), F.length("kind") + 2), F.lit(": [")).alias("line"))
    closed = heads.select(F.lit(6).alias("section"), "kind", F.lit(2).alias("step"), F.lit("").alias("name"), F.lit("]").alias("line"))
    start = spark.createDataFrame([(json.dumps(metadata or {}, ensure_ascii=False),)], "m string").select(line(0, F.concat(F.lit('{"metadata": '), "m", F.lit(","))).alias("x"))
    rows = [start]
    if variables is None:
        rows.append(spark.range(1).select(line(1, F.lit('"variables": {},')).alias("x")))
    else:
        least = variables.agg(F.min("name").alias("least"))
        each = variables.groupBy("name").agg(F.max("value").alias("value")).crossJoin(F.broadcast(least))  # one row of the least name
        text = F.concat(F.when(F.col("name") == F.col("least"), "").otherwise(","), F.to_json(F.create_map("name", "value")))
        entry = F.regexp_replace(text, r"^(,?)\{(.*)\}$", "$1$2")
        rows.append(each.select(F.struct(F.lit(1).alias("section"), F.lit("").alias("kind"), F.lit(1).alias("step"), "name", entry.alias("line")).alias("x")))
        rows.append(spark.range(1).select(F.explode(F.array(line(1, F.lit('"variables": {')), line(1, F.lit("},"), 2))).alias("x")))
    back = spark.range(1).select(F.lit(None).cast("string").alias("backend")) if backend is None else backend.select("backend").limit(1)
    rows.append(back.agg(F.coalesce(F.max("backend"), F.lit("null")).alias("b")).select(line(2, F.concat(F.lit('"backend": '), "b", F.lit(","))).alias("x")))
    rows.append(_counted(o, "type").select(line(3, F.concat(F.lit('"statistics": {"counts": '), "json", F.lit(","))).alias("x")))
    states = _counted(o, "state") if "state" in o.columns else spark.range(1).select(F.lit("{}").alias("json"))
    rows.append(states.select(line(4, F.concat(F.lit('"states": '), "json", F.lit("},"))).alias("x")))
    severities = _counted(issues, "severity") if issues is not None else spark.range(1).select(F.lit("{}").alias("json"))
    rows.append(severities.select(line(5, F.concat(F.lit('"validation": '), "json", F.lit(', "objects": {'))).alias("x")))
    rows.append(spark.range(1).select(line(7, F.lit("}}")).alias("x")))
    out = body.unionAll(opened).unionAll(closed)
    for r in rows:
        out = out.unionAll(r.select("x.*"))
    return out


def sarif_lines(issues: DataFrame) -> DataFrame:
    """``section, kind, step, name, line``: issues as one SARIF document, each on a line of its own; see ``write_lines``."""
    spark = issues.sparkSession
    rank = F.concat_ws("\x00", "rule_id", F.coalesce("file_path", F.lit("")), F.format_string("%012d", F.coalesce("line_number", F.lit(1)).cast("long")), F.coalesce("resource_name", F.lit("")))
    # Written, so that the numbers stay the same; the one that comes first has no comma before it.
    rows = written(issues.select(rank.alias("name"), F.to_json(_result()).alias("json"), F.monotonically_increasing_id().alias("id")))
    first = rows.agg(F.min_by("id", F.struct("name", "id")).alias("first"))
    lead = F.col("id") == F.col("first")
    each = rows.crossJoin(F.broadcast(first))  # one row
    each = each.select(F.lit(1).alias("section"), F.lit("").alias("kind"), F.when(lead, 0).otherwise(1).alias("step"), "name", F.concat(F.when(lead, "").otherwise(","), "json").alias("line"))
    ends = [(0, "", 0, "", '{"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "stratagraph"}}, "results": ['), (2, "", 0, "", "]}]}")]
    return each.unionAll(spark.createDataFrame(ends, "section int, kind string, step int, name string, line string"))


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> None:
    """Writes lines as text files, in order: those of a folder, one after the other by name, are the document. They are laid out by range, so none is
    gathered in a task or on the driver. Files packed by ``gzip`` are one packed document, one after the other."""
    lines.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("line").write.text(path, compression=compression)


def issues_document(issues: DataFrame) -> str:
    rows = [json.loads(x) for x in issues.toJSON().collect()]
    count = {s: sum(r["severity"] == s for r in rows) for s in SARIF_LEVELS}
    return json.dumps({"summary": count | {"total": len(rows)}, "issues": rows}, indent=2)


def _result() -> Column:
    """An issue as a result of SARIF."""
    level = F.element_at(F.create_map(*(F.lit(x) for kv in SARIF_LEVELS.items() for x in kv)), F.col("severity"))
    text = F.when(F.coalesce("suggestion", F.lit("")) != "", F.concat_ws(" ", F.concat("message", F.lit(".")), "suggestion")).otherwise(F.col("message"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line_number", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    return F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"))


def sarif(issues: DataFrame) -> DataFrame:
    """One row, ``document``: the issues as SARIF 2.1.0, built on the cluster. It has to fit a row; ``sarif_lines`` need not."""
    rows = issues.agg(F.array_sort(F.collect_list(_result())).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit("stratagraph").alias("name")).alias("driver")).alias("tool"), F.col("results"))
    return rows.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def _id(name: str | Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``line`` of a DOT digraph."""
    colour = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv)), F.col("type")), F.lit("white"))
    n = nodes.select(F.lit(1).alias("o"), F.format_string('  "%s" [style=filled, fillcolor=%s];', "full_name", colour).alias("line"))
    e = edges.select(F.lit(2), F.format_string('  "%s" -> "%s";', "src", "dst"))
    s = nodes.sparkSession
    return s.createDataFrame([(0, "digraph dependencies {"), (3, "}")], "o int, line string").unionAll(n).unionAll(e).orderBy("o", "line").select("line")


def mermaid(nodes: DataFrame, edges: DataFrame, cyclic: DataFrame | None = None) -> DataFrame:
    """``line`` of a Mermaid flow chart; long names are shortened, edges among ``cyclic`` nodes are dotted."""
    label = F.when(F.length("full_name") > 30, F.concat(F.substring("full_name", 1, 27), F.lit("..."))).otherwise(F.col("full_name"))
    n = nodes.select(F.lit(1).alias("o"), F.format_string('  %s["%s"]', _id("full_name"), label).alias("line"))
    e = edges.withColumn("c", F.lit(False))
    if cyclic is not None:
        k = cyclic.select(F.col("node").alias("k_"), F.lit(True).alias("in_"))
        e = edges.join(k, F.col("src") == F.col("k_"), "left").withColumn("c", F.coalesce("in_", F.lit(False))).drop("k_", "in_")
    e = e.select(F.lit(2), F.format_string("  %s %s %s", _id("src"), F.when(F.col("c"), "-.->").otherwise("-->"), _id("dst")))
    return nodes.sparkSession.createDataFrame([(0, "flowchart TD")], "o int, line string").unionAll(n).unionAll(e).orderBy("o", "line").select("line")


def shortened(address: Column) -> Column:
    """Addresses of over 30 characters without what stands before their last part but the first two."""
    p = F.split(address, r"\.")
    first, last = F.get(p, 0), F.element_at(p, -1)
    return F.when((F.length(address) > 30) & (F.size(p) > 3), F.concat(first, F.lit("."), F.get(p, 1), F.lit("..."), last)).when((F.length(address) > 30) & (F.size(p) == 3), F.concat(first, F.lit("..."), last)).otherwise(address)


def diagram_lines(nodes: DataFrame, edges: DataFrame, cycles: DataFrame | None = None, name: Callable[[Column], Column] | None = None, leveled: DataFrame | None = None) -> DataFrame:
    """``section, kind, step, name, line``: a Mermaid chart with nodes by depth and cycles marked, in lines that stand in
    the order of the first four columns; see ``write_lines``.

    ``nodes`` has ``node, type``, ``edges`` ``src, dst`` between them, ``cycles`` paths from a node back to it (``path``). Nodes without
    a depth, as they depend on a cycle, come last. The chart's edges are numbered as they stand, by ``metrics.placed``, so those of cycles are styled by their numbers.
    Nodes may be numbers that ``name`` gives the names of: those are only put in their place in the lines and their order, and what is sent and shuffled is small. ``leveled``: what ``graph.levels`` gave, where it is known.
    """
    spark, said = nodes.sparkSession, name or (lambda node: node)
    pairs = written(graph.distinct_edges(edges))
    depths = (leveled or graph.levels(nodes, pairs, distinct=True)).select("node", F.col("level").alias("depth"))
    n = nodes.join(depths, "node").join(graph.degrees(nodes, pairs), "node")
    depth = F.when(F.col("depth").isNull(), "~").otherwise(F.format_string("%012d", "depth"))
    n = written(n.select(said(F.col("node")).alias("node"), "type", "depth", depth.alias("group"), "dependencies", "dependents"))
    id_ = lambda c: F.regexp_replace(_id(c), "^(?=[0-9])", "n")
    sign = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SIGNS.items() for x in kv)), F.col("type")), F.lit("📄"))
    shape = F.when(F.col("type").isin(*(c for c, *_ in CLASSES)), F.col("type")).otherwise("default")
    told = F.coalesce(F.col("depth").cast("string"), F.lit("cycle"))
    label = F.concat_ws("<br>", F.concat_ws(" ", sign, F.upper("type")), F.concat(F.lit("`"), shortened(F.col("node")), F.lit("`")), F.concat(F.lit("Depth: "), told), F.concat(F.lit("╭─ Dependencies: "), "dependencies"), F.concat(F.lit("╰─ Dependents: "), "dependents"))
    row = lambda section, kind, step, name, line: F.struct(F.lit(section).alias("section"), kind.alias("kind"), F.lit(step).cast("long").alias("step") if isinstance(step, int) else step.cast("long").alias("step"), name.alias("name"), line.alias("line"))
    blank = F.lit("")
    head = "graph TD\n" + "\n".join(f"    classDef {c} fill:{fill},stroke:{stroke},stroke-width:2px" for c, fill, stroke in CLASSES)
    parts = [spark.range(1).select(F.explode(F.array(row(0, blank, 0, blank, F.lit(head)), row(2, blank, 0, blank, F.lit("    %% Dependencies")))).alias("r"))]
    comment = F.when(F.col("group") == "~", "    %% On a cycle or depending on one").otherwise(F.concat(F.lit("    %% Depth "), F.col("depth").cast("string"), F.when(F.col("depth") == 0, " - Root nodes").otherwise("")))
    parts.append(n.groupBy("group", "depth").count().select(row(1, F.col("group"), 0, blank, comment).alias("r")))
    shown = F.concat(F.lit("    "), id_("node"), F.lit('["'), label, F.lit('"]\n    class '), id_("node"), F.lit(" "), shape)
    parts.append(n.select(row(1, F.col("group"), 1, F.col("node"), shown).alias("r")))
    numbered = written(metrics.placed(pairs, [said(F.col("src")), said(F.col("dst"))]).select("src", "dst", (F.col("place") - 1).alias("at")))
    parts.append(numbered.select(row(3, blank, F.col("at"), blank, F.concat(F.lit("    "), id_(said(F.col("src"))), F.lit(" --> "), id_(said(F.col("dst"))))).alias("r")))
    if cycles is not None:
        c, order = cycles.select("path"), F.col("path")
        if name:  # from the smallest name, not the smallest number
            ring = F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda node: F.struct(name(node).alias("name"), node.alias("node")))
            c, order = c.select(graph.turned(ring).alias("ring")).select(F.col("ring.node").alias("path"), F.col("ring.name").alias("names")), F.col("names")
        c = written(metrics.placed(c, [order]))
        kind = F.format_string("%018d", "place")
        first = c.where("place = 1").select(row(4, blank, 0, blank, F.lit("    %% Circular Dependencies (highlighted)\n    linkStyle default fill:none,stroke:#ff0000,stroke-width:2px,stroke-dasharray:5,5")).alias("r"))
        parts += [first, c.select(row(5, kind, 0, blank, F.concat(F.lit("    %% Cycle "), F.col("place").cast("string"))).alias("r"))]
        steps = c.select("place", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))).alias("i", "e")).select("place", "i", F.col("e.a").alias("src"), F.col("e.b").alias("dst"))
        style = F.concat(F.lit("    linkStyle "), F.col("at").cast("string"), F.lit(" stroke:#ff0000,stroke-width:3px,stroke-dasharray:0"))
        parts.append(steps.join(numbered, ["src", "dst"]).select(row(5, kind, F.col("i") + 1, blank, style).alias("r")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("r.*")


def csv_table(objects: DataFrame) -> DataFrame:
    """The resources as the columns Name, Type, Provider, File, Line."""
    return objects.where("type = 'resource'").select(F.col("name").alias("Name"), F.col("resource_type").alias("Type"), F.coalesce("provider", F.substring_index("resource_type", "_", 1)).alias("Provider"), F.col("file_path").alias("File"), F.col("line_number").alias("Line"))


def write_csv(objects: DataFrame, path: str) -> None:
    csv_table(objects).write.csv(path, header=True)


def write_xml(objects: DataFrame, path: str) -> None:
    """Resources with their name as an attribute, and type and provider as elements."""
    rows = objects.where("type = 'resource'").select(F.col("full_name").alias("_name"), F.col("resource_type").alias("type"), F.coalesce("provider", F.substring_index("resource_type", "_", 1)).alias("provider"))
    rows.write.format("xml").option("rootTag", "terraform_project").option("rowTag", "resource").save(path)


def write_split(objects: DataFrame, path: str, by: str = "type") -> None:
    """A folder for each value of ``by``: type, provider or source."""
    objects.select("full_name", "type", "name", "resource_type", "provider", "source", "file_path", "line_number", F.to_json("attributes").alias("attributes")).write.partitionBy(by).json(path)


def to_yaml(document: str) -> str:
    try:
        import yaml
    except ImportError:
        return document
    return yaml.safe_dump(json.loads(document), sort_keys=False, allow_unicode=True)


def to_toml(document: str) -> str:
    out: list[str] = []
    _toml(json.loads(document), [], out)
    return "\n".join(out) + "\n"


def _toml(value: dict, path: list[str], out: list[str]) -> None:
    if path:
        out.append("[" + ".".join(json.dumps(p) for p in path) + "]")
    inner = [(k, v) for k, v in value.items() if isinstance(v, dict)]
    for k, v in value.items():
        if v is not None and not isinstance(v, dict):
            out.append(f"{json.dumps(k)} = {_toml_value(v)}")
    for k, v in inner:
        _toml(v, [*path, k], out)


def _toml_value(v: object) -> str:
    if isinstance(v, dict):
        return "{ " + ", ".join(f"{json.dumps(k)} = {_toml_value(x)}" for k, x in v.items() if x is not None) + " }"
    if isinstance(v, list):
        return "[" + ", ".join(_toml_value(x) for x in v if x is not None) + "]"
    return json.dumps(v, ensure_ascii=False)


def html_report(title: str, nodes: DataFrame, edges: DataFrame, dark: bool = False) -> str:
    """A page with the graph as JSON and a table of the nodes that can be searched in the browser."""
    ns = [json.loads(x) for x in nodes.orderBy("full_name").toJSON().collect()]
    es = [json.loads(x) for x in edges.orderBy("src", "dst").toJSON().collect()]
    data = json.dumps({"nodes": ns, "edges": es}).replace("</", "<\\/")
    rows = "".join(f"<tr><td>{escape(n['full_name'])}</td><td>{escape(n.get('type') or '')}</td><td>{escape(n.get('state') or '')}</td></tr>" for n in ns)
    colours = "background:#111;color:#eee" if dark else "background:#fff;color:#111"
    script = "q.oninput=()=>{for(const r of t.rows)r.hidden=!r.textContent.toLowerCase().includes(q.value.toLowerCase())}"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body style="{colours}"><h1>{escape(title)}</h1><input id="q" placeholder="search"><table id="t">{rows}</table><script type="application/json" id="graph">{data}</script><script>{script}</script></body></html>'


def zipped(parts: dict[str, str], target: str | None = None) -> bytes:
    """A ZIP archive of named texts; written to ``target`` if given, or named by the time in a folder."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    if target:
        path = Path(target)
        (path / f"export-{time.strftime('%Y%m%d-%H%M%S')}.zip" if path.is_dir() else path).write_bytes(buffer.getvalue())
    return buffer.getvalue()


#: Exporters by lower-case name: nodes and edges to a table of lines.
EXPORTERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"dot": dot, "mermaid": mermaid}


def register(name: str, exporter: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    EXPORTERS[name.lower()] = exporter


def exporter(name: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    if name.lower() not in EXPORTERS:
        raise ValueError(f"no exporter {name}; there are {', '.join(sorted(EXPORTERS))}")
    return EXPORTERS[name.lower()]


def format_of(path: str) -> str:
    return {".json": "json", ".sarif": "sarif", ".txt": "text", ".md": "text", ".yaml": "yaml", ".toml": "toml", ".csv": "csv", ".xml": "xml", ".dot": "dot", ".html": "html"}.get(Path(path).suffix, "table")
