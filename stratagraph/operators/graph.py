"""Graph operators over an edge table. An edge ``src -> dst`` says that ``src`` depends on ``dst``.

Nodes and edges are tables and every step is a join or an aggregate; the driver only counts rounds. What
a round makes is written to the shared folder, so plans don't grow. Joins carry no hints: adaptive
execution broadcasts what turns out small and splits what turns out skewed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import discard, written


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()


def _laid(edges: DataFrame) -> DataFrame:
    """A written table of the distinct edges, a node's together. Edges that say they lie so (``by_src``) are not shuffled for it."""
    pairs = edges.select("src", "dst")
    return written(distinct_edges(pairs if getattr(edges, "by_src", False) else pairs.repartition("src")))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, dependencies, dependents``: explicit edges count as often as they stand, dependents once.

    Edges are read once: equal ones are counted, and both ends of what is left go through one aggregate,
    which is combined before its shuffle.
    """
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("c"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("c").alias("o"), zero.alias("i")), F.struct(F.col("dst").alias("node"), zero.alias("o"), one.alias("i")))
    both = pairs.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.o").alias("dependencies"), F.sum("e.i").alias("dependents"))
    return nodes.select("node").join(both, "node", "left").na.fill(0, ["dependencies", "dependents"])


def complexity(deps: str = "dependencies", users: str = "dependents", circular: str = "circular", missing: str = "missing") -> Column:
    """Dependencies and half the dependents, half as much again on a cycle, twice with missing references."""
    base = F.col(deps) + F.col(users) * 0.5
    return base * F.when(F.col(circular), 1.5).otherwise(1.0) * F.when(F.col(missing), 2.0).otherwise(1.0)


def roots_and_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, is_root`` (no dependencies), ``is_leaf`` (no dependents), ``is_orphan`` (neither)."""
    d = degrees(nodes, distinct_edges(edges))
    root, leaf = F.col("dependencies") == 0, F.col("dependents") == 0
    return d.select("node", root.alias("is_root"), leaf.alias("is_leaf"), (root & leaf).alias("is_orphan"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def closure(edges: DataFrame, start: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``start, node, depth`` of everything reachable from ``start`` (column ``node``), without itself.

    Semi-naive: a round joins only the pairs that the last one added, and writes only what it adds. Cycles
    end it, since a pair is kept once, with its shortest distance. After the first round only edges that go on from another one's end are joined.
    """
    e = _laid(edges)
    rounds = [written(start.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct())]
    for depth in range(1, most + 1):
        new = rounds[-1]
        step = new.join(e, new["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        new = written(step.join(_all(rounds), ["start", "node"], "left_anti").select("start", "node", F.lit(depth).alias("depth")))
        if new.isEmpty():
            break
        rounds.append(new)
        if depth == 1:
            e = written(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), e)
    return _all(rounds).where("depth > 0")


def dependents_closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    return closure(reverse(edges), start)


def _jumps(pointers: DataFrame) -> DataFrame:
    """``node, at, steps``: where a chain of ``pointers`` (``node, next``, one for each node) leads: to the first node without one.

    Pointers are doubled: a round takes each as far again as it has come, so there are as many rounds as the length of the longest chain has binary
    digits. Pointers that lead into a circle never end, and still point at a node that has one.
    """
    jump = written(pointers.select("node", F.col("next").alias("at"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moved")))
    for _ in range(jump.count().bit_length()):
        ahead = jump.select(F.col("node").alias("via"), F.col("at").alias("further"), F.col("steps").alias("more"))
        doubled = jump.join(ahead, F.col("at") == F.col("via"), "left")
        jump = written(doubled.select("node", F.coalesce("further", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("via").isNotNull().alias("moved")), jump)
        if jump.where("moved").isEmpty():
            break
    return jump.drop("moved")


def _pruned(need: DataFrame, free: DataFrame, e: DataFrame) -> list[DataFrame]:
    """``node, level`` by level, where every edge is one long. A round drops the edges to what the last one settled; what has none left is settled, so
    nothing is counted, and an edge is looked at until its end is settled only. ``need``: the nodes with edges; ``free``: those without."""
    done, level, left, rest = [free.withColumn("level", F.lit(0).cast("long"))], 0, need, e
    while not free.isEmpty() and not left.isEmpty():
        level += 1
        rest = written(rest.join(free.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), *([rest] if level > 1 else []))
        open_ = left.join(rest.select(F.col("src").alias("node")).distinct().withColumn("open_", F.lit(True)), "node", "left")
        split = written(open_)
        free, left = split.where("open_ is null").select("node"), split.where("open_").select("node")
        done.append(free.withColumn("level", F.lit(level).cast("long")))
    return done


def levels(nodes: DataFrame, edges: DataFrame, distinct: bool = False) -> DataFrame:
    """``node, level``: Kahn's order by levels. Level 0 depends on nothing; what is on a cycle or
    depends on one has no level (null) and comes last. ``distinct``: the edges are a written table of distinct ones.

    Where no node with one dependency depends on another such, edges are dropped by rounds (``_pruned``). Else a node with one dependency lies a level
    above it, so stretches of such nodes are left out first, by doubled pointers. Between the others there are
    edges as long as what they stand for. A round closes those of the nodes that the last one settled, and only nodes that it touches are counted: those
    with all dependencies closed are settled, at the longest way down. There are as many rounds as a way has branchings, however long it is.
    """
    # A node's edges are laid out together, so that they are counted where they lie.
    e = edges.select("src", "dst") if distinct else _laid(edges)
    need = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("open"), F.min("dst").alias("next"))
    every = written(nodes.select("node").distinct().join(need, "node", "left").select("node", F.coalesce("open", F.lit(0)).alias("open"), F.when(F.col("open") == 1, F.col("next")).alias("next")))
    ones = every.where("open = 1").select("node", "next")
    if ones.join(ones.select(F.col("node").alias("next")), "next", "left_semi").isEmpty():
        known = _all(_pruned(every.where("open > 0").select("node"), every.where("open = 0").select("node"), e))
    else:
        known = _counted(every, ones, e)
    if not distinct:
        discard(e)
    known = known.select("node", F.col("level").cast("int").alias("level"))
    return known if known.count() == every.count() else every.select("node").join(known, "node", "left")


def _counted(every: DataFrame, ones: DataFrame, e: DataFrame) -> DataFrame:
    """``node, level`` of the nodes that have one, where there are stretches to leave out."""
    jump = _jumps(ones)
    several = every.where("open > 1").select(F.col("node").alias("src"), "open")
    long = e.join(several.select("src"), "src", "left_semi").join(jump, F.col("dst") == F.col("node"), "left")
    long = written(long.select("src", F.coalesce("at", "dst").alias("dst"), (F.coalesce("steps", F.lit(0)) + 1).alias("length")))
    free, waiting = every.where("open = 0").select("node", F.lit(0).cast("long").alias("level")), None
    done = [free]
    while True:
        closed = long.join(free, F.col("dst") == F.col("node")).groupBy("src").agg(F.count("*").alias("closed"), F.max(F.col("level") + F.col("length")).alias("level"))
        if waiting is not None:
            before = waiting.select(F.col("src").alias("s_"), F.col("closed").alias("c_"), F.col("level").alias("l_"))
            closed = closed.join(before, F.col("src") == F.col("s_"), "full").select(F.coalesce("src", "s_").alias("src"), (F.coalesce("closed", F.lit(0)) + F.coalesce("c_", F.lit(0))).alias("closed"), F.greatest("level", "l_").alias("level"))
        counted = written(closed.join(several, "src"))
        free = counted.where("closed = open").select(F.col("src").alias("node"), "level")
        waiting = counted.where("closed < open").select("src", "closed", "level")
        if free.isEmpty():
            break
        done.append(free)
    known = _all(done)
    return known.unionAll(jump.join(known.select(F.col("node").alias("at"), "level"), "at").select("node", (F.col("level") + F.col("steps")).alias("level")))


def _ranked(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Adds ``rank``, from 0, in each ``group`` by ``order``, without a group in one task: rows are laid out by range,
    ranked within their piece, and the pieces' sizes are added up."""
    rows = written(rows.repartitionByRange(group, order).withColumn("piece", F.spark_partition_id()))
    size = rows.groupBy(group, "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select(F.col(group).alias("g_"), F.col("piece").alias("p_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy(group, "piece").orderBy(order)) - 1
    ranked = rows.withColumn("inside", inside).join(size, (F.col(group) == F.col("g_")) & (F.col("piece") == F.col("p_")))
    return ranked.withColumn("rank", F.col("first") + F.col("inside")).drop("inside", "first", "piece", "g_", "p_")


def _as_is(node: Column) -> Column:
    return node


def topological_order(nodes: DataFrame, edges: DataFrame, name: Callable[[Column], Column] = _as_is) -> DataFrame:
    """``node, level, position``: by level, within it by name, leftovers last. Positions are added up
    from the levels' sizes, and ranks within a level from those of its pieces. ``name`` gives the names of nodes that are numbers."""
    lv = written(levels(nodes, edges).select(name(F.col("node")).alias("node"), "level").withColumn("key", F.coalesce("level", F.lit(2_000_000_000))))
    size = lv.groupBy(F.col("key").alias("k_")).agg(F.count("*").alias("n"))
    # A row for each level.
    first = size.select("k_", F.coalesce(F.sum("n").over(Window.orderBy("k_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    ranked = _ranked(lv, "key", "node").join(first, F.col("key") == F.col("k_"))
    return ranked.select("node", "level", (F.col("first") + F.col("rank")).alias("position"))


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, depth``: edges of the longest path to a node without dependencies; null beyond cycles."""
    return levels(nodes, edges).select("node", F.col("level").alias("depth"))


def critical_path(nodes: DataFrame, edges: DataFrame, name: Callable[[Column], Column] = _as_is) -> DataFrame:
    """``step, node`` of a longest chain, from its foundation up; ties by name; empty without edges. ``name`` gives the names of nodes that are numbers.

    Every node points at the first of its deepest dependencies. Pointers are doubled, each round's kept; then the path is unfolded from its top, the longest jumps first, each of which
    doubles what is known of it.
    """
    e = _laid(edges)
    d = written(levels(nodes, e, distinct=True).select("node", F.col("level").alias("depth")))
    kind = dict(d.dtypes)["node"]
    top = d.where("depth > 0").orderBy(F.desc("depth"), name(F.col("node"))).limit(1).collect()
    if not top:
        return d.sparkSession.createDataFrame([], f"step int, node {kind}").select("step", name(F.col("node")).alias("node"))
    below = e.join(d.select(F.col("node").alias("src"), F.col("depth").alias("own")), "src").join(d.select(F.col("node").alias("dst"), "depth"), "dst").where("depth = own - 1")
    jumps = [written(below.groupBy("src").agg(F.min_by("dst", name(F.col("dst"))).alias("dst")))]
    while 1 << len(jumps) <= top[0].depth:
        one, two = jumps[-1], jumps[-1].select(F.col("src").alias("dst"), F.col("dst").alias("further"))
        jumps.append(written(one.join(two, "dst").select("src", F.col("further").alias("dst"))))
    path = written(d.sparkSession.createDataFrame([(top[0].depth, top[0].node)], f"step int, node {kind}"))
    for k in range(len(jumps) - 1, -1, -1):
        path = written(path.unionAll(path.join(jumps[k], F.col("node") == F.col("src")).select((F.col("step") - (1 << k)).alias("step"), F.col("dst").alias("node"))), path)
    discard(*jumps)
    return path.select("step", name(F.col("node")).alias("node"))


def shortest_chain(edges: DataFrame, a: object, b: object, name: Callable[[Column], Column] = _as_is) -> DataFrame:
    """``step, node`` of a shortest path from ``a`` to ``b``, the first by names; empty if there is none. ``name`` gives the names of nodes that are numbers.

    Nodes with one edge in and one out are left out first, by doubled pointers to the last of their stretch, and an edge stands for each stretch, with its length and the name that it
    begins with. Paths over those are lengthened by an edge a round and the best to each node is kept (equally long ones differ first where
    they part, by a stretch's first name). Where none gets better, the stretches of the path to ``b`` are filled in.
    """
    e = _laid(edges)
    spark, kind = e.sparkSession, dict(e.dtypes)["src"]
    called = dict(e.select(name(F.col("src")).alias("name")).dtypes)["name"]
    if a == b:
        return spark.createDataFrame([(0, a)], f"step int, node {kind}").select("step", name(F.col("node")).alias("node"))
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("next")).where("n = 1")
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node")
    inner = written(out.join(into, "node").where((F.col("node") != F.lit(a)) & (F.col("node") != F.lit(b))).select("node", "next"))
    # Pointers stay within their stretch; its last node has none.
    ahead = inner.join(inner.select(F.col("node").alias("next")), "next", "left_semi").select("node", "next")
    jump = _jumps(ahead)
    held = inner.join(jump, "node", "left").select("node", F.coalesce("at", "node").alias("last"), F.coalesce("steps", F.lit(0)).alias("left_"))
    end = inner.select(F.col("node").alias("last"), F.col("next").alias("end"))
    held = written(held.join(end, "last"))
    outer = e.join(inner.select(F.col("node").alias("src")), "src", "left_anti").join(held.select(F.col("node").alias("dst"), "end", "left_"), "dst", "left")
    outer = written(outer.select("src", F.coalesce("end", "dst").alias("to"), F.coalesce(F.col("left_") + 2, F.lit(1)).alias("length"), F.col("dst").alias("first")))
    best = new = spark.createDataFrame([(a,)], f"node {kind}").select("node", F.struct(F.lit(0).cast("long").alias("length"), F.array().cast(f"array<struct<name:{called},node:{kind}>>").alias("names"), F.array().cast("array<bigint>").alias("at")).alias("way"))
    while True:
        longer = F.struct((F.col("way.length") + F.col("length")).alias("length"), F.concat("way.names", F.array(F.struct(name(F.col("first")).alias("name"), F.col("first").alias("node")))).alias("names"), F.concat("way.at", F.array(F.col("way.length"))).alias("at"))
        step = new.join(outer, F.col("node") == F.col("src")).groupBy(F.col("to").alias("node")).agg(F.min(longer).alias("way"))
        new = written(step.join(best.select("node", F.col("way").alias("known")), "node", "left").where("known is null or way < known").drop("known"))
        if new.isEmpty():
            break
        best = written(best.unionAll(new).groupBy("node").agg(F.min("way").alias("way")))
    way = best.where(F.col("node") == F.lit(b)).select(F.explode(F.arrays_zip("way.names", "way.at")).alias("x")).select(F.col("x.names.node").alias("first"), F.col("x.at").alias("begun"))
    # A stretch holds the nodes with its last one that lie no further from it than its first.
    begin = held.select(F.col("node").alias("first"), "last", F.col("left_").alias("whole"))
    filled = way.join(begin, "first").join(held.select("node", "last", "left_"), "last").where("left_ <= whole").select((F.col("begun") + 1 + F.col("whole") - F.col("left_")).alias("step"), "node")
    plain = way.join(begin.select("first"), "first", "left_anti").select((F.col("begun") + 1).alias("step"), F.col("first").alias("node"))
    ends = way.join(begin, "first").join(end, "last").select((F.col("begun") + 2 + F.col("whole")).alias("step"), F.col("end").alias("node"))
    start = way.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(0).cast("long").alias("step"), F.lit(a).cast(kind).alias("node"))
    return _all([start, filled, plain, ends]).select(F.col("step").cast("int").alias("step"), name(F.col("node")).alias("node"))


def all_chains(edges: DataFrame, start: DataFrame, most: int = 10) -> DataFrame:
    """``start, path`` (array): every simple path of ``most`` edges at most that ends where nothing more is needed."""
    e = written(distinct_edges(edges))
    has = e.select(F.col("src").alias("node")).distinct()
    open_ = written(start.select(F.col("node").alias("start"), "node", F.array("node").alias("path")))
    ended = []
    for k in range(most + 1):
        ended.append(open_.join(has, "node", "left_anti").select("start", "path"))
        if k == most:
            break
        step = open_.join(e, open_["node"] == e["src"]).where(~F.array_contains("path", F.col("dst")))
        open_ = written(step.select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")))
        if open_.isEmpty():
            break
    out = ended[0]
    for x in ended[1:]:
        out = out.unionAll(x)
    return out


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node), edges taken both ways: large-star and small-star rounds."""
    e = written(distinct_edges(edges).select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        e = written(small.select("a", F.col("m").alias("b")).unionAll(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), e)
    return nodes.select("node").distinct().join(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cycle_members(edges: DataFrame, distinct: bool = False, leveled: DataFrame | None = None) -> DataFrame:
    """``node, cycle``: the nodes on cycles, each with the smallest node of its strongly connected component. ``distinct``: the edges are a
    written table of distinct ones. ``leveled``: what ``levels`` gave for them, where it is known.

    What Kahn's order leaves over from either end is trimmed first: a graph without cycles is known from one
    pass. The rest goes by forward and backward colouring: each node takes the greatest name that reaches it; those
    that reach the node of their colour, within the colour, are its component, and leave. No pairs are made.
    """
    e = edges.select("src", "dst") if distinct else _laid(edges)
    for turn in (False, True):
        turned = reverse(e) if turn else e
        both = turned.select(F.col("src").alias("node")).unionAll(turned.select(F.col("dst").alias("node")))
        left = (levels(both, turned, distinct=True) if turn or leveled is None else leveled).where("level is null").select("node")
        if left.isEmpty():
            # Everything has a level, so there is no cycle.
            return e.where("false").select(F.col("src").alias("node"), F.col("dst").alias("cycle"))
        on = lambda column, left=left: left.select(F.col("node").alias(column))
        e = written(e.join(on("src"), "src", "left_semi").join(on("dst"), "dst", "left_semi").select("src", "dst"), e)
    found = []
    while not e.isEmpty():
        nodes = e.select(F.col("src").alias("node")).unionAll(e.select(F.col("dst").alias("node"))).distinct()
        colour = written(nodes.select("node", F.col("node").alias("colour")))
        new = colour
        while True:
            better = e.join(new, e["src"] == new["node"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("better"))
            new = written(better.join(colour, "node").where("better > colour").select("node", F.col("better").alias("colour")))
            if new.isEmpty():
                break
            changed = new.select("node", F.col("colour").alias("new"))
            colour = written(colour.join(changed, "node", "left").select("node", F.coalesce("new", "colour").alias("colour")), colour)
        at = lambda column: colour.select(F.col("node").alias(column), F.col("colour").alias(f"{column}_colour"))
        inside = written(e.join(at("src"), "src").join(at("dst"), "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")))
        rounds = [written(colour.where("node = colour").select("node", "colour"))]
        while True:
            back = inside.join(rounds[-1].select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
            more = written(back.join(_all(rounds).select("node"), "node", "left_anti"))
            if more.isEmpty():
                break
            rounds.append(more)
        parts = written(_all(rounds))
        # A component of one is no cycle: edges to itself were left out.
        low = parts.groupBy("colour").agg(F.min("node").alias("cycle"), F.count("*").alias("n")).where("n > 1")
        found.append(written(parts.join(low, "colour").select("node", "cycle")))
        gone = lambda column, parts=parts: parts.select(F.col("node").alias(column))
        # Between the colours there is no way back.
        e = written(inside.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst"), e, inside)
    return _all(found) if found else e.select(F.col("src").alias("node"), F.col("dst").alias("cycle"))


def cycle_paths(edges: DataFrame, most: int = 12) -> DataFrame:
    """``path``: simple cycles of ``most`` nodes at most, each once, from its smallest node and back to it."""
    members = written(cycle_members(edges))
    e = written(distinct_edges(edges).join(members.select(F.col("node").alias("src")), "src", "left_semi").join(members.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    open_ = e.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("path"))
    out = None
    for _ in range(most - 1):
        open_ = written(open_)
        if open_.isEmpty():
            break
        step = open_.join(e, open_["node"] == e["src"])
        closed = step.where(F.col("dst") == F.col("start")).select(F.concat("path", F.array("dst")).alias("path"))
        out = closed if out is None else out.unionAll(closed)
        open_ = step.where((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
    return out if out is not None else e.select(F.array("src").alias("path")).limit(0)


def cycle_witnesses(edges: DataFrame, leveled: DataFrame | None = None) -> DataFrame:
    """``path``: for each edge on a cycle a shortest simple cycle through it, whatever its length, from its
    smallest node and back to it; each path once. Every node and every component of cycles is on one. ``leveled``: what ``levels`` gave for the edges, where it is known."""
    members = written(cycle_members(edges, leveled=leveled))
    e = written(distinct_edges(edges).join(members.select(F.col("node").alias("src"), F.col("cycle").alias("c")), "src").join(members.select(F.col("node").alias("dst"), F.col("cycle").alias("d")), "dst").where("c = d").select("src", "dst"))
    new = seen = written(e.select(F.col("dst").alias("start"), F.col("dst").alias("node"), F.array("dst").alias("path")).distinct())
    while not new.isEmpty():
        step = new.join(e, new["node"] == e["src"]).groupBy("start", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        new = written(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        seen = written(seen.unionAll(new))
    # The path from an edge's end to its start, which the edge closes.
    closed = e.join(seen, (e["dst"] == seen["start"]) & (e["src"] == seen["node"])).select("path")
    return closed.select(turned(F.col("path")).alias("path")).distinct()


def turned(ring: Column) -> Column:
    """The path around a ring, an array of different nodes, from the smallest and back to it."""
    first = F.array_position(ring, F.array_min(ring)).cast("int")
    return F.concat(F.slice(ring, first, F.size(ring)), F.slice(ring, F.lit(1), first - 1), F.array(F.array_min(ring)))


def reaches(nodes: DataFrame, edges: DataFrame, through: tuple[str, ...] = ("local", "variable"), to: tuple[str, ...] = ("resource", "module", "data", "provider", "output")) -> DataFrame:
    """``node`` of those that a node of the kinds ``to`` depends on, directly or by way of the kinds ``through`` alone.

    ``nodes`` has ``node, type``. Goes from the dependents down, so each node is settled once. A written table of distinct edges that has ``src_type``
    needs no look at the nodes.
    """
    if "src_type" in edges.columns:
        e = edges.where("src <> dst").select("src", "dst", "src_type")
    else:
        kinds = nodes.select("node", "type")
        e = distinct_edges(edges).join(kinds.withColumnRenamed("node", "src").withColumnRenamed("type", "src_type"), "src")
        e = written(e.select("src", "dst", "src_type"))
    rounds = [written(e.where(F.col("src_type").isin(*to)).select(F.col("dst").alias("node")).distinct())]
    via = e.where(F.col("src_type").isin(*through))
    while not rounds[-1].isEmpty():
        new = rounds[-1]
        step = via.join(new, via["src"] == new["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        rounds.append(written(step.join(_all(rounds), "node", "left_anti")))
    return _all(rounds)


def neighbourhood(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``start, node`` and the direct neighbours on either side, with the node itself."""
    s = start.select(F.col("node").alias("start")).distinct()
    e = distinct_edges(edges)
    out = e.join(s, e["src"] == s["start"]).select("start", F.col("dst").alias("node"))
    in_ = e.join(s, e["dst"] == s["start"]).select("start", F.col("src").alias("node"))
    return out.unionAll(in_).unionAll(s.select("start", F.col("start").alias("node"))).distinct()


def hierarchical_layout(nodes: DataFrame, edges: DataFrame, width: float = 800.0, height: float = 600.0, name: Callable[[Column], Column] = _as_is) -> DataFrame:
    """``node, layer, x, y``: layers from what nobody depends on downward, cycles in the last layer,
    evenly spaced, in order of names. ``name`` gives the names of nodes that are numbers."""
    lv = written(levels(nodes, reverse(edges)).select(name(F.col("node")).alias("node"), "level"))
    last = lv.agg(F.coalesce(F.max("level"), F.lit(-1)).alias("m")).first().m
    lv = lv.withColumn("layer", F.coalesce("level", F.lit(last + 1)))
    n_layers = lv.select("layer").distinct().count()
    size = lv.groupBy("layer").agg(F.count("*").alias("k"))
    placed = _ranked(lv.select("node", "layer"), "layer", "node").join(size, "layer")
    return placed.select("node", "layer", (F.lit(width) / (F.col("k") + 1) * (F.col("rank") + 1)).alias("x"), (F.lit(height) / (n_layers + 1) * (F.col("layer") + 1)).alias("y"))


def laid_out(nodes: DataFrame, edges: DataFrame, width: float = 1000.0, height: float = 800.0) -> tuple[DataFrame, DataFrame]:
    """A graph to be drawn: ``nodes`` with ``layer, x, y`` beside their columns, and ``edges`` with ``x1, y1, x2, y2``, where they
    begin and end. An edge from or to what is no node isn't drawn."""
    at = written(hierarchical_layout(nodes, edges, width, height))
    end = lambda name, k: at.select(F.col("node").alias(name), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    return nodes.join(at, "node"), edges.join(end("src", 1), "src").join(end("dst", 2), "dst")


def force_layout(nodes: DataFrame, edges: DataFrame, width: float = 800.0, height: float = 600.0, rounds: int = 100, seed: int = 0) -> DataFrame:
    """``project, node, x, y``: spring layout of each project's graph, which has to fit a task: it is
    meant for pictures. ``nodes`` has ``project, node``, ``edges`` also ``strength``. Seeded, so reruns agree."""
    import numpy as np
    import pandas as pd

    def place(ns: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        names = sorted(ns.node)
        at, n = {x: i for i, x in enumerate(names)}, len(names)
        xy = np.random.default_rng(seed).uniform([50, 50], [width - 50, height - 50], (n, 2))
        k = (width * height / max(n, 1)) ** 0.5
        pairs = [(at[a], at[b], s) for a, b, s in zip(es.src, es.dst, es.strength, strict=True) if a in at and b in at]
        i, j, s = (np.array(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for _ in range(rounds):
            gap = xy[:, None] - xy[None]
            d = np.maximum(np.linalg.norm(gap, axis=2), 0.01)
            move = (gap / d[..., None] * (k * k / d)[..., None]).sum(axis=1)
            pull = xy[j] - xy[i]
            length = np.maximum(np.linalg.norm(pull, axis=1), 0.01)[:, None]
            force = pull / length * (length**2 / k) * s[:, None]
            np.add.at(move, i, force)
            np.add.at(move, j, -force)
            xy = np.clip(xy + move * 0.1, [50, 50], [width - 50, height - 50])
        return pd.DataFrame({"project": ns.project.iloc[0] if len(ns) else None, "node": names, "x": xy[:, 0], "y": xy[:, 1]})

    return nodes.groupBy("project").cogroup(edges.groupBy("project")).applyInPandas(place, "project string, node string, x double, y double")
