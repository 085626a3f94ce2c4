"""A recorded analysis: its objects and dependencies go in, states, reasons and statistics must come out."""

import json

import pytest
from golden import COUNTS, OBJECTS, SCORE, STATES, TYPES
from pyspark.sql import functions as F

from stratagraph.operators import graph, metrics, states


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(n, t, n.split(".")[-1], rt, s, "1" if default else None, json.dumps({k: 1 for k in keys})) for n, t, rt, default, keys, s, *_ in OBJECTS]
    objects = spark.createDataFrame(rows, "full_name string, type string, name string, resource_type string, source string, d string, a string")
    c = F.col
    objects = objects.withColumns({"default_value": F.parse_json("d"), "attributes": F.parse_json("a")}).drop("d", "a")
    objects = objects.withColumns(
        {
            "incomplete": states.incomplete(c("attributes"), c("type"), c("resource_type"), c("source"), F.lit(None).cast("boolean"), c("default_value"), F.lit(None).cast("variant")),
            "good_practice": F.lit(False),
            "bare": F.lit(False),
        }
    )
    edges = [(o[0], x, kind) for o in OBJECTS for kind, xs in (("explicit", o[6]), ("implicit", o[7])) for x in xs]
    missing = [(o[0], x, i) for o in OBJECTS for i, x in enumerate(o[8])]
    return objects, spark.createDataFrame(edges, "src string, dst string, kind string"), spark.createDataFrame(missing, "src string, ref string, place int")


def test_size(tables):
    assert tables[0].count() == 49 and tables[1].count() == 118


def test_states_and_reasons(tables):
    objects, edges, missing = tables
    got = {r.full_name: r for r in states.classify(states.features(objects, edges, missing)).collect()}
    for name, *_, state, reason in OBJECTS:
        assert (name, got[name].state) == (name, state)
        assert got[name].state_reason == reason


def test_statistics(tables):
    objects, edges, missing = tables
    s = states.classify(states.features(objects, edges, missing))
    assert {r.state: r.n for r in metrics.state_distribution(s).collect()} == STATES
    h = metrics.health_score(s).first()
    assert (h.score, h.unused, h.orphaned, h.incomplete) == (SCORE, STATES["unused"], STATES["orphaned"], 0)
    assert {r.resource_type: r.n for r in metrics.resource_types(objects).collect()} == TYPES
    counts = metrics.kind_counts(objects).first()
    assert (counts.n_resource, counts.n_variable, counts.n_output, counts.n_local, counts.n_provider) == tuple(COUNTS[k] for k in ("resources", "variables", "outputs", "locals", "providers"))


def test_degrees_of_the_record(tables):
    objects, edges, _ = tables
    got = {r.node: (r.dependencies, r.dependents) for r in graph.degrees(objects.select(F.col("full_name").alias("node")), edges.select("src", "dst")).collect()}
    users = {n: set() for n, *_ in OBJECTS}
    for n, *rest in OBJECTS:
        for x in rest[5] + rest[6]:
            users.setdefault(x, set()).add(n)
    assert got == {o[0]: (len(o[6]) + len(o[7]), len(users[o[0]])) for o in OBJECTS}
