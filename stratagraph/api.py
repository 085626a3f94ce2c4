"""A configuration tree as a project: objects, references, edges, states, issues and documents."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import resolve
from .model import state_dimension
from .operators import graph, metrics, refs, search, states, summary
from .plans.storage import written
from .rules import registry
from .sinks import documents
from .sources import reader


class Project:
    def __init__(self, objects: DataFrame) -> None:
        """``objects`` has the columns of ``reader.objects``."""
        self.spark, self.objects = objects.sparkSession, objects

    @classmethod
    def scan(cls, spark: SparkSession, path: str) -> Project:
        """Every configuration file below ``path``. Files that can't be read are left out; see ``errors``."""
        read = written(reader.blocks(reader.files(spark, path)))
        project = cls(reader.objects(read))
        project.errors = read.where("error is not null").select("file_path", "error")
        return project

    @cached_property
    def _bound(self) -> tuple[DataFrame, DataFrame]:
        names = self.objects.select("full_name")
        explicit = self.objects.select(F.col("full_name").alias("src"), F.explode("depends_on").alias("ref")).select("src", refs.normalised(F.col("ref")).alias("dst"), F.lit("explicit").alias("kind"))
        found, missing = refs.resolve(refs.extract_in_order(self.objects), names)
        implicit = found.join(explicit, ["src", "dst"], "left_anti").withColumn("kind", F.lit("implicit"))
        provider = refs.provider_edges(self.objects).withColumn("kind", F.lit("implicit"))
        missing = missing.join(explicit.select("src", F.col("dst").alias("ref")), ["src", "ref"], "left_anti")
        return written(explicit.unionByName(implicit).unionByName(provider)), written(missing)

    @property
    def edges(self) -> DataFrame:
        return self._bound[0]

    @property
    def missing(self) -> DataFrame:
        return self._bound[1]

    @property
    def nodes(self) -> DataFrame:
        return self.objects.select(F.col("full_name").alias("node"), "type")

    @cached_property
    def states(self) -> DataFrame:
        o = self.objects
        c = F.col
        flags = o.withColumns(
            {
                "incomplete": states.incomplete(c("attributes"), c("type"), c("resource_type"), c("source"), c("nullable"), c("default_value"), c("output_value")),
                "bare": c("attributes").isNull() | F.to_json("attributes").isin("{}", "null"),
                "good_practice": states.good_practice(c("description"), c("tags"), c("name"), c("type") == "resource"),
            }
        )
        f = states.features(flags.select("full_name", "type", "name", "resource_type", "provider", "description", "tags", "default_value", "file_path", "incomplete", "good_practice", "bare", *(x for x in ("ord",) if x in o.columns)), self.edges, self.missing)
        return written(states.classify(f).drop("incomplete", "good_practice", "bare", "default_value"))

    def search(self, text: str) -> DataFrame:
        s = self.states.withColumns({"subtype": F.coalesce("resource_type", "type"), "details": F.concat_ws(" ", "description", "state_reason"), "provider": F.coalesce("provider", F.substring_index("resource_type", "_", 1))})
        return s.where(search.predicate(text))

    def statistics(self) -> dict[str, DataFrame]:
        s = self.states
        return {"counts": metrics.kind_counts(self.objects), "states": metrics.state_distribution(s), "types": metrics.top_types(self.objects), "health": metrics.health_score(s), "graph_health": metrics.graph_health(s.select("state"), state_dimension(self.spark)), "graph": metrics.graph_stats(self.nodes, self.edges)}

    def summary(self, samples: int = 5) -> DataFrame:
        """What a scan tells, in rows; names in the catalog's order, where it has one."""
        return summary.scan_summary(self.states, samples, "ord" if "ord" in self.states.columns else "full_name")

    def drawing(self, width: float = 1000.0, height: float = 800.0) -> tuple[DataFrame, DataFrame]:
        """Nodes with their states and places, and edges from end to end."""
        return graph.laid_out(self.states.select(F.col("full_name").alias("node"), "type", "state"), self.edges, width, height)

    def diagram(self) -> DataFrame:
        """Lines of a chart by depth with its cycles marked, for ``documents.write_lines``."""
        known = self.objects.select(F.col("full_name").alias("dst"))
        edges = self.edges.join(known, "dst", "left_semi").select("src", "dst")
        return documents.diagram_lines(self.nodes.distinct(), edges, graph.cycle_witnesses(edges))

    def cycles(self) -> DataFrame:
        return graph.cycle_members(self.edges)

    def integrity(self) -> DataFrame:
        return metrics.integrity(self.objects, self.missing, self.cycles())

    def resolved(self, supplied: DataFrame | None = None) -> DataFrame:
        return resolve.resolved(self.objects, supplied)

    def validate(self, categories: list[str] | None = None, ignore: tuple[str, ...] = (), strict: bool = False, fail_fast: bool = False) -> DataFrame:
        return registry.evaluate(self.objects, categories, ignore, strict, fail_fast)

    def document(self) -> str:
        return documents.project_document(self.objects, self.edges, self.states).first().document

    def report(self, title: str = "Configuration") -> str:
        return documents.html_report(title, self.states.select("full_name", "type", "state"), self.edges)
