"""What is in an expression's text: references with flags, function calls, the kind of a value. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import refs

# Functions of the language that are recognised.
FUNCTION_NAMES = (
    "file", "filebase64", "templatefile", "jsonencode", "jsondecode", "yamlencode", "yamldecode", "base64encode", "base64decode", "join", "split", "concat", "lookup", "element", "length", "merge",
    "flatten", "distinct", "keys", "values", "zipmap", "format", "formatlist", "regex", "regexall", "replace", "substr", "trim", "trimprefix", "trimsuffix", "lower", "upper", "title", "chomp", "indent",
    "tostring", "tonumber", "tobool", "tolist", "toset", "tomap", "try", "can", "coalesce", "compact", "contains", "index", "reverse", "slice", "sort", "sum", "min", "max", "ceil", "floor", "abs", "log",
    "pow", "signum", "parseint", "cidrhost", "cidrnetmask", "cidrsubnet", "cidrsubnets", "timestamp", "timeadd", "formatdate", "range", "chunklist", "setintersection", "setproduct", "setsubtract",
    "setunion", "anytrue", "alltrue", "one", "sensitive", "nonsensitive",
)


def calls(text: Column) -> Column:
    """Array of the distinct recognised functions that are called, sorted."""
    found = F.regexp_extract_all(text, F.lit(r"\b([a-z_][a-z0-9_]*)\s*\("), F.lit(1))
    return F.array_sort(F.array_intersect(found, F.array(*map(F.lit, FUNCTION_NAMES))))


def conditional(text: Column) -> Column:
    """In a template or a choice."""
    return text.contains("${") | text.rlike(r"\?[^:]*:")


def value_kind(text: Column) -> Column:
    """The kind of an attribute's text: truth before number, then calls, references, templates."""
    return (
        F.when(text.isNull() | (text == "null"), "null").when(text.isin("true", "false"), "bool").when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number")
        .when(text.startswith("["), "list").when(text.startswith("{"), "map").when(text.rlike(r"^\$\{[a-z_][a-z0-9_]*\(.*\)\}$"), "function")
        .when(text.rlike(r"^\$\{[A-Za-z_][A-Za-z0-9_.-]*\}$"), "reference").when(text.contains("${"), "interpolation").otherwise("string")
    )


def block_refs(rows: DataFrame, name: str = "full_name", text: str = "attributes_text") -> DataFrame:
    """``src, ref, ref_type, target, scope, is_sensitive, is_computed, is_conditional, complexity``, one row for
    each different reference of a block."""
    x = rows.select(F.col(name).alias("src"), conditional(F.col(text)).alias("is_conditional"), F.explode(refs.found_in(F.col(text))).alias("ref"))
    x = x.withColumn("p", refs.parsed(F.col("ref")))
    kind, path = F.col("p.ref_type"), F.col("p.path")
    return x.select("src", "ref", kind.alias("ref_type"), F.col("p.target").alias("target"), refs.scope(kind).alias("scope"), refs.sensitive(path).alias("is_sensitive"), refs.computed(kind).alias("is_computed"), "is_conditional", refs.reference_complexity(kind, F.size(path), F.col("is_conditional"), refs.computed(kind), refs.sensitive(path)).alias("complexity"))
