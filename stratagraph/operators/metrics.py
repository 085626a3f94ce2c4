"""Statistics of a catalog and of its graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import HEALTHY_STATES, KINDS
from ..plans.storage import written
from . import catalog, graph


def kind_counts(objects: DataFrame) -> DataFrame:
    """One row: the number of objects of each kind, and of all but settings."""
    one = [F.count_if(F.col("type") == k).alias(f"n_{k}") for k in KINDS if k != "terraform"]
    return objects.agg(*one, F.count_if(F.col("type") != "terraform").alias("total"))


def state_distribution(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("n"))


def resource_types(objects: DataFrame) -> DataFrame:
    return objects.where("type = 'resource'").groupBy("resource_type").agg(F.count("*").alias("n"))


def providers(objects: DataFrame) -> DataFrame:
    """``provider, n``: the providers of resources and data, in lower case."""
    return objects.select(F.lower(catalog.provider()).alias("provider")).where("provider is not null").groupBy("provider").agg(F.count("*").alias("n"))


def top_providers(objects: DataFrame, k: int = 3) -> DataFrame:
    return providers(objects).orderBy(F.desc("n"), "provider").limit(k)


def module_sources(objects: DataFrame) -> DataFrame:
    """``source, n, r``: the modules' sources, ranked by how often they are used. A row for each source is ranked."""
    x = catalog.by_kind(objects, "module").groupBy("source").agg(F.count("*").alias("n"))
    return x.withColumn("r", F.rank().over(Window.orderBy(F.desc("n"))).cast("long"))


def top_types(objects: DataFrame, k: int = 10) -> DataFrame:
    return resource_types(objects).orderBy(F.desc("n"), "resource_type").limit(k)


def top_types_told(objects: DataFrame, k: int = 10, order: str = "full_name") -> DataFrame:
    """``place, label, n``: the ``k`` most frequent resource types, those that came first by ``order`` before others as
    frequent, and below them how many types there are more (``n`` null), if any."""
    counts = written(objects.where("type = 'resource'").groupBy("resource_type").agg(F.count("*").alias("n"), F.min(order).alias("first_")))
    shown = counts.orderBy(F.desc("n"), "first_", "resource_type").limit(k)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "first_", "resource_type"))  # k rows
    rest = counts.agg((F.count("*") - k).alias("m")).where("m > 0").select(F.lit(k + 1).alias("place"), F.format_string("... and %d more", "m").alias("label"), F.lit(None).cast("long").alias("n"))
    return shown.select(place.alias("place"), F.col("resource_type").alias("label"), "n").unionAll(rest)


def health(total: Column, good: Column, unused: Column, orphaned: Column, incomplete: Column) -> Column:
    """0 to 100; an empty catalog is healthy."""
    raw = (good * 100.0 - unused * 15.0 - orphaned * 10.0 - incomplete * 20.0) / total
    return F.when(total == 0, F.lit(100.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2))


def health_score(states: DataFrame) -> DataFrame:
    """One row. Settings blocks are not in the total, but their states are counted."""
    s = F.col("state")
    n = states.agg(F.count_if(F.col("type") != "terraform").alias("total"), F.count_if(s.isin(*HEALTHY_STATES)).alias("good"), *(F.count_if(s == x).alias(x) for x in ("unused", "orphaned", "incomplete")))
    return n.select("total", "good", "unused", "orphaned", "incomplete", health(*(F.col(x) for x in ("total", "good", "unused", "orphaned", "incomplete"))).alias("score"))


def graph_health(states: DataFrame, dimension: DataFrame) -> DataFrame:
    """From severity groups: healthy states count, neutral ones don't, warnings cost 15, errors 30; 0 without a node."""
    g = states.join(dimension, "state", "left")
    n = g.agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == x).alias(f"n_{x}") for x in ("healthy", "neutral", "warning", "error")))
    raw = (F.col("n_healthy") * 100.0 - F.col("n_warning") * 15.0 - F.col("n_error") * 30.0) / F.col("total")
    return n.withColumn("score", F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2)))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``n_nodes, n_edges, avg_degree`` (2E/N), ``max_in, max_out, isolated``."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst"), F.lit(0), F.lit(1)))
    d = nodes.select("node").join(both.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")), "node", "left").na.fill(0)
    return d.agg(F.count("*").alias("n_nodes"), F.sum("o").alias("n_edges"), F.round(F.sum(F.col("o") + F.col("i")) / F.count("*"), 2).alias("avg_degree"), F.max("i").alias("max_in"), F.max("o").alias("max_out"), F.count_if((F.col("o") == 0) & (F.col("i") == 0)).alias("isolated"))


def graph_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``grouping, key, n, share``: nodes by type and by state, edges by kind, and the mean out and in degree (as
    ``share``, rounded). ``nodes`` has ``node, type, state``, ``edges`` also ``edge_type``. One aggregate each."""
    none = F.lit(None).cast("double")
    by = lambda df, column, name: df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("grouping"), "key", "n", none.alias("share"))
    size = edges.agg(F.count("*").alias("e")).withColumn("j", F.lit(1)).join(nodes.agg(F.count("*").alias("n")).withColumn("j", F.lit(1)), "j")
    mean = F.when(F.col("n") > 0, F.round(F.col("e") / F.col("n"), 2)).otherwise(0.0)
    degree = size.select(F.lit("mean").alias("grouping"), F.explode(F.array(F.lit("in"), F.lit("out"))).alias("key"), F.col("e").alias("n"), mean.alias("share"))
    return by(nodes, "type", "type").unionAll(by(nodes, "state", "state")).unionAll(by(edges, "edge_type", "edge")).unionAll(degree)


def hud(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``n_nodes, n_edges, avg_degree`` (half the degrees, to one place), ``max_depth``, ``complexity`` (of
    ten). Depth is that of the longest chain; cycles have none."""
    n = graph_stats(nodes, edges).select("n_nodes", "n_edges", F.round(F.when(F.col("n_nodes") > 0, F.col("n_edges") / F.col("n_nodes")).otherwise(0.0), 1).alias("avg_degree"))
    deep = graph.depths(nodes, edges).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    x = n.withColumn("j", F.lit(1)).join(deep.withColumn("j", F.lit(1)), "j").drop("j")
    return x.withColumn("complexity", F.least(F.round(F.col("avg_degree") * F.col("max_depth") / 2), F.lit(10)).cast("int"))


def edge_kinds(edges: DataFrame) -> DataFrame:
    """Edges with their type and strength: to a provider, else explicit or implicit."""
    kind = F.when(F.col("dst").startswith("provider."), "provider").otherwise(F.col("kind"))
    return edges.withColumn("edge_type", kind).withColumn("strength", F.when(kind == "provider", 0.5).when(kind == "explicit", 1.0).otherwise(0.7))


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("error", "warning", "info")), F.count("*").alias("total"))


def issue_groups(issues: DataFrame) -> DataFrame:
    """Issues by category, by severity and by file in one pass: ``grouping, key, n``."""
    rows = issues.groupingSets([["category"], ["severity"], ["file_path"]], "category", "severity", "file_path").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "severity").otherwise("file")
    return rows.select(name.alias("grouping"), F.coalesce("category", "severity", "file_path").alias("key"), "n")


def integrity(objects: DataFrame, missing: DataFrame, cycles: DataFrame) -> DataFrame:
    """``problem, subject, detail``: cycles, references that are no variable, local, data or module and
    resolve to nothing, outputs without a value."""
    known = "^(var|local|data|module)\\."
    a = cycles.select(F.lit("cycle").alias("problem"), F.col("node").alias("subject"), F.col("cycle").cast("string").alias("detail"))
    b = missing.where(~F.col("ref").rlike(known)).select(F.lit("undefined"), "src", "ref")
    c = objects.where("type = 'output' and output_value is null").select(F.lit("no value"), "full_name", F.lit(None).cast("string"))
    return a.unionAll(b).unionAll(c)


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``place``, from 1, by ``order``: rows are laid out by range and numbered within, and the ranges before are counted."""
    laid = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()))
    laid = laid.withColumn("range_", F.shiftright("at_", 33))
    size = laid.groupBy("range_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    size = size.select(F.col("range_").alias("r_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    inside = F.col("at_").bitwiseAND((1 << 33) - 1) + 1
    return laid.join(size, F.col("range_") == F.col("r_")).withColumn("place", F.col("before_") + inside).drop("at_", "range_", "r_", "before_")
