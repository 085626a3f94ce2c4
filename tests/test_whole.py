"""Queries over whole tables, against their SQL and brute force, on the smallest tables (skipped where there are none)."""

import os

import pytest
from test_queries import DATA, rows

from stratagraph.operators import graph
from stratagraph.plans import registry, scans  # noqa: F401  scans registers its queries
from stratagraph.plans.cases import CASES
from stratagraph.rules import registry as rules
from stratagraph.sources import reader

tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def in_sql(name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c.sql(registry.ORACLE_SQL[name]).df()


@tables
@pytest.mark.parametrize("name", ["ref_resolve_prefix_all", "ref_missing_prefix_all", "components_all", "cycle_witnesses"])
def test_whole_tables_against_sql(spark, name):
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(in_sql(name))


@tables
@pytest.mark.parametrize("name", ["rules_cases", "rules_of_projects", "rule_run_stats", "integrity_check", "tree_objects", "tree_states", "tree_lookups", "tree_filters", "tree_values", "resolver_functions", "reference_kinds", "incomplete_objects", "sink_xml", "sink_split", "sink_document", "sink_sarif", "topo_order", "scc_members"])
def test_catalogue_and_trees_against_sql(spark, name):
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(in_sql(name))


def test_every_rule_has_a_case():
    have = {rule for rule, *_ in CASES}
    assert {r.rule_id for r in rules.rules.values() if r.scope != "project_level"} <= have


@tables
def test_every_line_is_resolved_or_missing(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().collect()
    keys = [r.p_partkey for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey").collect()]
    for name, some, column in (("ref_resolve_prefix_all", keys, "dst"), ("ref_missing_prefix_all", [k for k in keys if k % 3 == 0], "ref")):
        bound = {k: {f"part.{x}_key" for x in some if f"{x}_key".startswith(str(k))} for k in {r.l_partkey for r in lines}}
        if column == "dst":
            want = {(f"line.{r.l_orderkey}", x) for r in lines for x in bound[r.l_partkey]}
        else:
            want = {(f"line.{r.l_orderkey}", f"part.{r.l_partkey}") for r in lines if not bound[r.l_partkey]}
        got = [tuple(r) for r in registry.QUERIES[name](spark, DATA).select("src", column).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_long_cycles_have_a_path(spark):
    long = [f"n{i:02}" for i in range(15)]  # longer than the enumeration goes
    pairs = [*zip(long, [*long[1:], long[0]], strict=True), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "n00")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    assert {">".join(r.path) for r in graph.cycle_witnesses(e).collect()} == {">".join([*long, "n00"]), "x>y>x"}
    assert graph.cycle_witnesses(e.limit(0)).count() == 0


def test_locals_of_any_depth(spark):
    value = '{"a":' * 12 + '[1, "x"]' + "}" * 12
    rows = spark.createDataFrame([("local.deep", "local", f'{{"value": {value}}}'), ("local.flat", "local", '{"value": 3}')], "full_name string, type string, a string").selectExpr("full_name", "type", "parse_json(a) as attributes")
    deep = "local.deep" + ".a" * 12
    assert {r.full_name: r.value for r in reader.locals_flat(rows).collect()} == {f"{deep}.0": "1", f"{deep}.1": "x", "local.flat": "3"}
