"""Diagrams in ordered lines, summaries of a scan, and missing names as they were found."""

import glob

from pyspark.sql import functions as F

from stratagraph.operators import graph, metrics, refs, states, summary
from stratagraph.sinks import documents

EDGES = [("a.x", "a.y"), ("a.y", "a.z"), ("a.z", "a.x"), ("var.v", "a.x"), ("local.l", "local.m"), ("local.l", "local.m"), ("3.o", "local.l")]


def chart(spark, path, edges, names):
    nodes = spark.createDataFrame([(n, n.split(".")[0]) for n in names], "node string, type string")
    e = spark.createDataFrame(edges, "src string, dst string")
    documents.write_lines(documents.diagram_lines(nodes, e, graph.cycle_witnesses(e)), str(path))
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*"))).splitlines()


def test_diagram_stands_in_order(spark, tmp_path):
    lines = chart(spark, tmp_path / "d", EDGES, sorted({x for e in EDGES for x in e} | {"lone.n"}))
    at = lines.index
    assert lines[0] == "graph TD" and sum("classDef" in x for x in lines) == 8
    assert at("    %% Depth 0 - Root nodes") < at("    class local_m local") < at("    class lone_n default") < at("    %% Depth 1") < at("    class local_l local") < at("    %% Depth 2") < at("    class n3_o default")
    assert at("    class n3_o default") < at("    %% On a cycle or depending on one") < at("    class a_x default") < at("    class var_v default") < at("    %% Dependencies")
    links = [x.strip() for x in lines if " --> " in x]
    assert links == ["n3_o --> local_l", "a_x --> a_y", "a_y --> a_z", "a_z --> a_x", "local_l --> local_m", "var_v --> a_x"]
    assert lines[at("    %% Cycle 1") + 1 :] == [f"    linkStyle {k} stroke:#ff0000,stroke-width:3px,stroke-dasharray:0" for k in (1, 2, 3)]
    assert '    local_m["💬 LOCAL<br>`local.m`<br>Depth: 0<br>╭─ Dependencies: 0<br>╰─ Dependents: 1"]' in lines


def test_diagram_without_edges_or_nodes(spark, tmp_path):
    for k, names in enumerate((["var.a"], [])):
        lines = chart(spark, tmp_path / str(k), [], names)
        assert lines[-1] == "    %% Dependencies" and not any("Circular" in x for x in lines)
        assert sum(x.startswith("    class ") for x in lines) == len(names)


def test_addresses_are_shortened(spark):
    long = "data.a_type_with_a_long_name_indeed.x"
    rows = [("a.b", "a.b"), (long, "data...x"), ("module.m." + long, "module.m...x"), ("aws_a_type_with_a_long_name_indeed.x", "aws_a_type_with_a_long_name_indeed.x")]
    got = spark.createDataFrame(rows, "a string, want string").select(documents.shortened(F.col("a")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


STATED = "full_name string, type string, state string, resource_type string, provider string, ord int"


def test_summary_of_nothing(spark):
    s = spark.createDataFrame([], STATED)
    rows = {(r.section, r.key): r for r in summary.scan_summary(s).collect()}
    assert rows["health", "score"].share == 100 and rows["counts", "total"].n == 0 and len(rows) == 13
    assert [r.line for r in summary.short_lines(summary.scan_summary(s)).orderBy("place").collect()] == ["Total objects: 0", "Resources: 0 (0 types)", "Data sources: 0", "Providers: ", "Health: 100.0% (good)"]
    assert metrics.top_types_told(s).count() == 0 and summary.issue_lists(s).count() == 0


def test_lists_keep_the_catalogs_order(spark):
    rows = [(f"o{k}", "resource", "incomplete" if k % 2 else "unused", f"t{k % 3}", None, -k) for k in range(20)] + [("same", "terraform", "unused", None, None, 5), (None, "resource", None, None, None, None)]
    s = spark.createDataFrame(rows, STATED)
    lists = {x: [r.full_name for r in summary.issue_lists(s, "ord").where(F.col("state") == x).orderBy("place").collect()] for x in ("unused", "incomplete")}
    assert lists["unused"] == [f"o{k}" for k in range(18, -1, -2)] + ["same"] and lists["incomplete"] == [f"o{k}" for k in range(19, 0, -2)]
    told = summary.scan_summary(s, order="ord").where("section = 'issues'").groupBy("key").count().collect()
    assert {r.key: r["count"] for r in told} == {"unused": 5, "incomplete": 10}
    assert [(r.label, r.n) for r in metrics.top_types_told(s.where("resource_type is not null"), 2, "ord").orderBy("place").collect()] == [("t1", 7), ("t0", 7), ("... and 1 more", None)]


def test_missing_names_come_as_they_were_found(spark):
    o = spark.createDataFrame([("local.a", "local", "${local.z} ${var.q} ${var.b} ${local.c} ${var.q}"), ("local.s", "local", "${local.k}"), ("local.k", "local", "")], "full_name string, type string, attributes_text string")
    found, missing = refs.resolve(refs.extract_in_order(o), o)
    s = states.classify(states.features(o.drop("attributes_text"), found, missing)).where("state = 'missing_dependency'").collect()
    assert [(r.full_name, r.state_reason) for r in s] == [("local.a", "References 4 undefined object(s): var.q, var.b, local.z (+1 more)")]


def test_diagram_by_number_is_the_same(spark, tmp_path):
    names = sorted({x for e in EDGES for x in e} | {"lone.n"})
    by_name = chart(spark, tmp_path / "s", EDGES, names)
    # Numbers run against the names' order.
    number = {n: len(names) - i for i, n in enumerate(names)}
    said = F.array(*(F.lit(n) for n in reversed(names)))
    nodes = spark.createDataFrame([(number[n], n.split(".")[0]) for n in names], "node long, type string")
    e = spark.createDataFrame([(number[a], number[b]) for a, b in EDGES], "src long, dst long")
    e = graph.written(graph.distinct_edges(e))
    leveled = graph.levels(nodes, e, distinct=True)
    lines = documents.diagram_lines(nodes, e, graph.cycle_witnesses(e, leveled), lambda c: F.get(said, (c - 1).cast("int")), leveled)
    documents.write_lines(lines, f"{tmp_path}/n")
    assert "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/n/part-*"))).splitlines() == by_name
