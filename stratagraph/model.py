"""Schemas and small dimension tables of the configuration graph."""

from pyspark.sql import DataFrame, SparkSession

OBJECTS = """project string, full_name string, type string, name string, resource_type string, provider string,
provider_alias string, provider_version string, file_path string, line_number int, variable_type string,
default_value variant, nullable boolean, sensitive boolean, output_value variant, source string,
module_version string, description string, tags map<string,string>, depends_on array<string>,
attributes variant, ord bigint"""
EDGES = "project string, src string, dst string, kind string, strength double, ord int"
ISSUES = """project string, rule_id string, severity string, category string, message string, file_path string,
line_number int, resource_name string, resource_type string, suggestion string"""

# The vocabulary of kinds, states, severities and categories.
KINDS = ("resource", "data", "module", "variable", "output", "provider", "local", "terraform")
INFRASTRUCTURE = ("resource", "module", "data")
STATES = ("active", "integrated", "healthy", "leaf", "input", "output_interface", "configuration", "external_data", "hub", "complex", "underutilized", "isolated", "orphaned", "unused", "incomplete", "missing_dependency", "broken")
SEVERITIES = ("error", "warning", "info")
CATEGORIES = ("syntax", "references", "security", "best_practices", "performance", "cost", "naming", "compliance")
HEALTHY_STATES = ("active", "input", "output_interface", "configuration")

# Each state, its severity group and its rank in listings.
STATE_GROUPS = (
    ("healthy", "healthy", 1), ("active", "healthy", 2), ("integrated", "healthy", 3),
    ("input", "neutral", 4), ("output_interface", "neutral", 5), ("configuration", "neutral", 6), ("external_data", "neutral", 7), ("leaf", "neutral", 8), ("hub", "neutral", 9),
    ("unused", "warning", 10), ("isolated", "warning", 11), ("orphaned", "warning", 12), ("underutilized", "warning", 13), ("complex", "warning", 14),
    ("incomplete", "error", 15), ("broken", "error", 16), ("missing_dependency", "error", 17),
)


def state_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATE_GROUPS), "state string, severity string, rank int")
