"""Summaries for reports: by file, for a dashboard, and the digest of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import HEALTHY_STATES, KINDS
from ..plans.storage import written
from . import catalog, graph
from .metrics import health

#: States whose objects a summary lists.
LISTED = ("unused", "orphaned", "isolated", "incomplete")

# States that a dashboard counts as healthy.
DASHBOARD_HEALTHY = ("active", "integrated", "input", "output_interface", "configuration")


def by_file(objects: DataFrame) -> DataFrame:
    """``file_path, type, n``."""
    return objects.groupBy("file_path", "type").agg(F.count("*").alias("n"))


def grade(score: Column) -> Column:
    return F.when(score < 50, "poor").when(score < 80, "fair").otherwise("good")


def dashboard(states: DataFrame) -> DataFrame:
    """By kind: ``type, n, healthy, unused, other, coverage`` (share that is used, in percent), ``avg_dependencies``."""
    s = F.col("state")
    good, idle = s.isin(*DASHBOARD_HEALTHY), s == "unused"
    n = F.count("*")
    return states.groupBy("type").agg(
        n.alias("n"), F.count_if(good).alias("healthy"), F.count_if(idle).alias("unused"), F.count_if(~good & ~idle).alias("other"),
        F.round((n - F.count_if(idle)) * 100.0 / n, 2).alias("coverage"), F.round(F.avg("dependencies"), 2).alias("avg_dependencies"),
    )


def state_matrix(states: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``type`` and the number of its objects in each of the states ``names``: a pivot without a pass to find them."""
    return states.groupBy("type").agg(*(F.count_if(F.col("state") == x).alias(x) for x in names))


def scan_digest(states: DataFrame, samples: int = 5) -> DataFrame:
    """One row: total, health and grade, and up to ``samples`` names, by name, of unused, orphaned, isolated and
    incomplete objects. The samples are taken from one ranked pass by state, so no list of all names is made."""
    s = F.col("state")
    states = written(states.select("type", "state", F.when(s.isin("unused", "orphaned", "isolated", "incomplete"), F.col("full_name")).alias("full_name")))
    n = states.agg(F.count_if(F.col("type") != "terraform").alias("total"), F.count_if(s.isin("active", "input", "output_interface", "configuration")).alias("good"), *(F.count_if(s == x).alias(x) for x in ("unused", "orphaned", "isolated", "incomplete")))
    n = n.withColumn("score", health(*(F.col(x) for x in ("total", "good", "unused", "orphaned", "incomplete")))).withColumn("grade", grade(F.col("score")))
    rank = F.row_number().over(Window.partitionBy("state").orderBy("full_name"))
    few = states.where(s.isin("unused", "orphaned", "isolated", "incomplete")).withColumn("r", rank).where(F.col("r") <= samples)
    lists = few.agg(*(F.array_join(F.array_sort(F.collect_list(F.when(s == x, F.col("full_name")))), ", ").alias(f"{x}_sample") for x in ("unused", "orphaned", "isolated", "incomplete")))
    return n.withColumn("j", F.lit(1)).join(lists.withColumn("j", F.lit(1)), "j").drop("j")


def issue_lists(states: DataFrame, order: str = "full_name") -> DataFrame:
    """``state, place, full_name``: all unused, orphaned, isolated and incomplete objects, numbered from 1 in each state by
    ``order``. Numbers are added up from ranges of rows, so a list may be of any length."""
    few = states.where(F.col("state").isin(*LISTED)).select("state", "full_name", *([order] if order != "full_name" else []))
    return graph._ranked(few, "state", order).select("state", (F.col("rank") + 1).alias("place"), "full_name")


def scan_summary(states: DataFrame, samples: int = 5, order: str = "full_name") -> DataFrame:
    """``section, key, n, share, name``: what a scan tells, in rows.

    ``counts`` of each kind and in ``total`` (settings blocks are not in it), ``health`` (the score is a ``share``),
    ``resource_types``, ``state_distribution``, ``providers``, and ``issues``: the first ``samples`` names by ``order`` of unused, orphaned and
    isolated objects, and all that are incomplete, with their places as ``n``. But for the names all comes from one
    aggregate, of a row for each kind, state, resource type and provider.
    """
    base = written(states.groupBy("type", "state", "resource_type", F.lower(catalog.provider()).alias("provider")).agg(F.count("*").alias("c")))
    of = lambda which: F.coalesce(F.sum(F.when(which, F.col("c"))), F.lit(0)).cast("long")
    kinds = [k for k in KINDS if k != "terraform"]
    one = base.agg(of(F.col("type") != "terraform").alias("total"), of(F.col("state").isin(*HEALTHY_STATES)).alias("good"), *(of(F.col("type") == k).alias(k) for k in kinds), *(of(F.col("state") == x).alias(x) for x in LISTED))
    row = lambda section, key, n, share=None: F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), n.alias("n"), F.lit(share).cast("double").alias("share") if share is None else share.alias("share"), F.lit(None).cast("string").alias("name"))
    none = F.lit(None).cast("long")
    rows = [row("counts", k, F.col(k)) for k in ("total", *kinds)] + [row("health", x, F.col(x)) for x in LISTED]
    rows.append(row("health", "score", none, health(*(F.col(x) for x in ("total", "good", "unused", "orphaned", "incomplete")))))
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    by = lambda section, rows, column: rows.groupBy(F.col(column).alias("key")).agg(F.sum("c").alias("n")).select(F.lit(section).alias("section"), "key", "n", F.lit(None).cast("double").alias("share"), F.lit(None).cast("string").alias("name"))
    out = out.unionAll(by("resource_types", base.where("type = 'resource'"), "resource_type")).unionAll(by("state_distribution", base, "state")).unionAll(by("providers", base.where("provider is not null"), "provider"))
    named = issue_lists(states, order).where((F.col("place") <= samples) | (F.col("state") == "incomplete"))
    return out.unionAll(named.select(F.lit("issues").alias("section"), F.col("state").alias("key"), F.col("place").alias("n"), F.lit(None).cast("double").alias("share"), F.col("full_name").alias("name")))


def short_lines(summary: DataFrame) -> DataFrame:
    """``place, line``: a scan's rows in eight lines at most; what counts nothing is left out of the last three."""
    at = lambda section, key, column="n": F.max(F.when((F.col("section") == section) & (F.col("key") == key), F.col(column)))
    used = F.array_join(F.array_sort(F.collect_list(F.when(F.col("section") == "providers", F.col("key")))), ", ")
    one = summary.where("section <> 'issues'").agg(
        at("counts", "total").alias("total"), at("counts", "resource").alias("resources"), at("counts", "data").alias("data"), F.count_if(F.col("section") == "resource_types").alias("types"),
        used.alias("used"), at("health", "score", "share").alias("score"), *(at("health", x).alias(x) for x in ("unused", "orphaned", "incomplete")),
    )
    told = [
        F.format_string("Total objects: %d", "total"), F.format_string("Resources: %d (%d types)", "resources", "types"), F.format_string("Data sources: %d", "data"), F.format_string("Providers: %s", "used"),
        F.format_string("Health: %.1f%% (%s)", "score", grade(F.col("score"))), *(F.when(F.col(x) > 0, F.format_string(f"{x.capitalize()}: %d", x)) for x in ("unused", "orphaned", "incomplete")),
    ]
    return one.select(F.posexplode(F.array(*told)).alias("place", "line")).where("line is not null")
