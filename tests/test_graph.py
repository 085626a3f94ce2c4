import random

from pyspark.sql import functions as F

from stratagraph.operators import graph


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def reach(pairs, a):
    seen, todo = set(), [a]
    while todo:
        x = todo.pop()
        for s, d in pairs:
            if s == x and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


def test_cycles_and_closure_against_brute_force(spark):
    rng = random.Random(3)
    names = [f"n{i:02}" for i in range(14)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(26)})
    clean = [(a, b) for a, b in pairs if a != b]
    e = edges_of(spark, pairs)
    got = {r.node: r.cycle for r in graph.cycle_members(e).collect()}
    on = {a for a in names if a in reach(clean, a)}
    assert set(got) == on
    for a in on:
        assert got[a] == min(b for b in on if b in reach(clean, a) and a in reach(clean, b))
    closed = {(r.start, r.node) for r in graph.closure(e, nodes_of(spark, names)).collect()}
    assert closed == {(a, b) for a in names for b in reach(clean, a) if b != a}


def test_levels_put_cycles_last(spark):
    e = edges_of(spark, [("c", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "x")])
    got = {r.node: r.level for r in graph.levels(nodes_of(spark, "abcxyz"), e).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}
    order = [r.node for r in graph.topological_order(nodes_of(spark, "abcxyz"), e).orderBy("position").collect()]
    assert order == ["a", "b", "c", "x", "y", "z"]
    assert [r.node for r in graph.critical_path(nodes_of(spark, "abc"), e).orderBy("step").collect()] == ["a", "b", "c"]


def test_chains_and_components(spark):
    e = edges_of(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("q", "r")])
    assert [r.node for r in graph.shortest_chain(e, "a", "d").orderBy("step").collect()] == ["a", "b", "d"]
    assert graph.shortest_chain(e, "d", "a").count() == 0
    assert [r.node for r in graph.shortest_chain(e, "a", "a").collect()] == ["a"]
    paths = {">".join(r.path) for r in graph.all_chains(e, nodes_of(spark, "a")).collect()}
    assert paths == {"a>b>d", "a>c>d"}
    got = {r.node: r.component for r in graph.components(nodes_of(spark, "abcdqrs"), e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "q": "q", "r": "q", "s": "s"}


def test_chains_of_numbers_go_by_name(spark):
    """Of equally long ways the first by names, not by numbers, is taken; without names it is the one by numbers."""
    e = spark.createDataFrame([(1, 9), (1, 10), (9, 3), (10, 3), (3, 4)], "src long, dst long")
    called = lambda c: F.concat(F.lit("n"), c.cast("string"))
    assert [r.node for r in graph.shortest_chain(e, 1, 4, name=called).orderBy("step").collect()] == ["n1", "n10", "n3", "n4"]
    assert [r.node for r in graph.shortest_chain(e, 1, 4).orderBy("step").collect()] == [1, 9, 3, 4]
    assert [r.node for r in graph.shortest_chain(e, 1, 1, name=called).collect()] == ["n1"]


def test_cycle_paths(spark):
    e = edges_of(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")])
    assert {">".join(r.path) for r in graph.cycle_paths(e).collect()} == {"a>b>a", "a>b>c>a"}


def test_layouts(spark):
    e = edges_of(spark, [("a", "b"), ("a", "c")])
    got = {r.node: (r.layer, round(r.x, 2), round(r.y, 2)) for r in graph.hierarchical_layout(nodes_of(spark, "abc"), e).collect()}
    assert got == {"a": (0, 400.0, 200.0), "b": (1, 266.67, 400.0), "c": (1, 533.33, 400.0)}
    ns = nodes_of(spark, "abc").select(F.lit("p").alias("project"), "node")
    es = e.select(F.lit("p").alias("project"), "src", "dst", F.lit(1.0).alias("strength"))
    once, again = (sorted(map(tuple, graph.force_layout(ns, es, rounds=5).collect())) for _ in range(2))
    assert once == again and len(once) == 3 and all(50 <= x <= 750 and 50 <= y <= 550 for _, _, x, y in once)


def test_long_chains(spark):
    """A chain of a thousand takes about as many rounds as a thousand has binary digits; branches and circles beside it."""
    name = lambda i: f"c{i:04}"
    pairs = [(name(i), name(i + 1)) for i in range(1000)] + [("r1", name(0)), ("r1", "r2"), ("r2", name(500)), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), (name(999), "leaf")]
    e = edges_of(spark, pairs)
    names = sorted({x for p in pairs for x in p} | {"alone"})
    got = {r.node: r.level for r in graph.levels(nodes_of(spark, names), e).collect()}
    want = {name(1000): 0, "leaf": 0, "alone": 0, **{name(i): 1000 - i for i in range(1000)}, "r2": 501, "r1": 1001, "x": None, "y": None, "z": None, "w": None}
    assert got == want
    path = [r.node for r in graph.critical_path(nodes_of(spark, names), e).orderBy("step").collect()]
    # The first by name of the deepest: both ends of the last edges are as deep.
    assert path == [name(1000), *(name(i) for i in range(999, -1, -1)), "r1"]
    chain = [r.node for r in graph.shortest_chain(e, "r1", "leaf").orderBy("step").collect()]
    assert chain == ["r1", "r2", *(name(i) for i in range(500, 1000)), "leaf"]


def test_levels_and_chains_against_brute_force(spark):
    rng = random.Random(21)
    for n, m in ((10, 14), (16, 15), (25, 30)):
        names = [f"n{i:02}" for i in range(n)]
        pairs = sorted({tuple(sorted(rng.sample(names, 2), reverse=True)) for _ in range(m)} | {(names[3], names[5])} if m == 14 else {tuple(sorted(rng.sample(names, 2), reverse=True)) for _ in range(m)})
        e, ends = edges_of(spark, pairs), {x: sorted(b for a, b in pairs if a == x) for x in names}
        on = {x for x in names if x in reach(pairs, x)}
        blocked = {x for x in names if reach(pairs, x) & on} | on

        def level(x):
            return 1 + max((level(y) for y in ends[x]), default=-1)

        got = {r.node: r.level for r in graph.levels(nodes_of(spark, names), e).collect()}
        assert got == {x: None if x in blocked else level(x) for x in names}
        for a, b in [(names[-1], names[0]), (names[-2], names[1]), tuple(rng.sample(names, 2))]:
            new, best = [[a]], None
            for _ in range(n):
                hits = [p for p in new if p[-1] == b]
                if hits:
                    best = min(hits)
                    break
                new = [[*p, y] for p in new for y in ends[p[-1]] if y not in p]
            assert [r.node for r in graph.shortest_chain(e, a, b).orderBy("step").collect()] == (best or [])


def test_empty(spark):
    e = edges_of(spark, [])
    assert graph.cycle_members(e).count() == 0
    assert graph.components(nodes_of(spark, "a"), e).count() == 1
    assert graph.critical_path(nodes_of(spark, "a"), e).count() == 0


def test_levels_where_edges_are_dropped_by_rounds(spark):
    """No stretches: every node that depends on one depends on several. What isn't there, and what is on a cycle, holds back all above it."""
    pairs = [(3, 1), (3, 2), (4, 1), (4, 2), (5, 3), (5, 4), (5, 1), (6, 1), (6, 99), (7, 6), (7, 1), (8, 9), (8, 1), (9, 8), (9, 1), (5, 3), (1, 1), (None, 1), (3, None)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 11)], "node long")
    want = {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: None, 7: None, 8: None, 9: None, 10: 0}
    assert {r.node: r.level for r in graph.levels(nodes, e).collect()} == want
    assert {r.node: r.cycle for r in graph.cycle_members(e).collect()} == {8: 8, 9: 8}
    name = lambda c: F.concat(F.lit("n"), (F.lit(100) - c).cast("string"))
    first = {r.step: r.node for r in graph.critical_path(nodes, e, name=name).collect()}
    assert first == {2: "n95", 1: "n96", 0: "n98"}
    assert {(r.node, r.position) for r in graph.topological_order(nodes, e, name=name).where("level = 1").collect()} == {("n96", 3), ("n97", 4)}


def test_numbers_of_objects_stand_for_their_names(spark):
    from stratagraph.plans import star

    d = "/root/testdata/sf0.001"
    names = {r.full_name: r.type for r in star.objects(spark, d).collect()}
    node = F.col("node")
    assert {r.name: r.type for r in star.numbers(spark, d).select(star.named(node).alias("name"), star.typed(node).alias("type")).collect()} == names
    both = [sorted(map(tuple, x.collect())) for x in (star.references(spark, d).select("src", "ref"), star.links(spark, d).select(star.named(F.col("src")), star.named(F.col("dst"))))]
    assert both[0] == both[1]
