"""Registered queries against their SQL in DuckDB, on the smallest tables (skipped where there are none)."""

import math
import os

import pytest

from stratagraph.plans import inspections, registry, reports  # noqa: F401  these register their queries

DATA = "/root/testdata/sf0.001"
QUICK = ("catalog_counts", "type_histogram_top10", "ref_extract_regex", "ref_resolve_prefix", "edge_types_strength", "provider_join", "issues_by_group", "overwrite_last_wins", "fn_scalars", "fn_collections", "json_navigate", "name_style", "components", "all_chains", "located_references", "argument_nodes", "block_lines", "issues_narrowed", "node_order", "explicit_and_implicit", "scan_summary", "types_told", "scan_in_short", "graph_with_layout")


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else str(x) if isinstance(x, str | bool) or not hasattr(x, "__float__") else round(float(x), 6)
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), c.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
