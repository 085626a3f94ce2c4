"""Configuration trees as tables: files, blocks, objects, variable files, lines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from . import hcl

BLOCKS = "project string, file_path string, kind string, label1 string, label2 string, ord int, body string, line_start int, line_end int, error string"
# Labels of each block type.
LABELS = {"resource": 2, "data": 2, "module": 1, "variable": 1, "output": 1, "provider": 1, "terraform": 0, "locals": 0}


def files(spark: SparkSession, path: str, project: str | None = None, pattern: str = "*.{tf,tf.json}", recursive: bool = True) -> DataFrame:
    """``project, file_path, content`` of the configuration files below ``path``; an error if there are none."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(path)
    except Exception as e:
        raise ValueError(f"Project path does not exist: {path}") from e
    if found.isEmpty():
        raise ValueError(f"No configuration files found in {path}")
    return found.select(F.lit(project or path).alias("project"), F.regexp_replace("path", "^file:/+", "/").alias("file_path"), F.col("content").cast("string").alias("content"))


def _read(text: str, path: str) -> dict:
    return json.loads(text) if path.endswith(".json") else hcl.loads(text)


def _rows(text: str, path: str) -> Iterator[tuple]:
    """Blocks of a file; what can't be read is one row with the error."""
    try:
        doc = _read(text, path)
    except ValueError as e:
        yield None, None, None, 0, None, None, None, str(e)
        return
    for kind, n in LABELS.items():
        ord_ = 0
        for entry in _listed(doc.get(kind)):
            for labels, body in _labelled(entry, n):
                body = dict(body) if isinstance(body, dict) else {"value": body}
                lines = body.pop("__lines__", None) or [None, None]
                if kind == "locals":
                    for key, value in body.items():
                        yield "local", key, None, ord_, json.dumps({"value": value}, ensure_ascii=False), *lines, None
                        ord_ += 1
                else:
                    labels = [*labels, None, None]
                    yield kind, labels[0], labels[1], ord_, json.dumps(body, ensure_ascii=False), *lines, None
                    ord_ += 1


def _listed(x: object) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _labelled(entry: object, n: int) -> Iterator[tuple[list[str], object]]:
    if n == 0 or not isinstance(entry, dict):
        yield [], entry
        return
    for key, value in entry.items():
        for one in _listed(value):
            for rest, body in _labelled(one, n - 1):
                yield [key, *rest], body


def blocks(found: DataFrame) -> DataFrame:
    """Every block as a row, its body as JSON. A file is read whole in one task; it has to be for its grammar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, f, *r) for p, f, c in zip(pdf.project, pdf.file_path, pdf.content, strict=True) for r in _rows(c or "", f)]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in BLOCKS.split(", ")])
            yield out.astype({c: "Int32" for c in ("ord", "line_start", "line_end")})

    return found.mapInPandas(run, BLOCKS)


def objects(read: DataFrame) -> DataFrame:
    """The typed object table of blocks; of equal names the last by file and order stays."""
    v = F.try_parse_json("body")
    text = lambda p: F.try_variant_get(v, f"$.{p}", "string")
    k, a, b = F.col("kind"), F.col("label1"), F.col("label2")
    two = k.isin("resource", "data")
    full = (
        F.when(k == "resource", F.concat_ws(".", a, b)).when(k == "data", F.concat_ws(".", F.lit("data"), a, b)).when(k == "module", F.concat(F.lit("module."), a))
        .when(k == "variable", F.concat(F.lit("var."), a)).when(k == "output", F.concat(F.lit("output."), a)).when(k == "provider", F.concat(F.lit("provider."), a))
        .when(k == "local", F.concat(F.lit("local."), a)).otherwise(F.concat(F.lit("terraform.block_"), F.col("ord").cast("string")))
    )
    o = read.where("error is null").select(
        "project", full.alias("full_name"), k.alias("type"), F.when(two, b).otherwise(F.coalesce(a, F.lit("terraform"))).alias("name"), F.when(two, a).alias("resource_type"),
        F.when(two, _bare(text("provider"))).alias("provider"), F.when(k == "provider", text("alias")).alias("provider_alias"), F.when(k == "provider", text("version")).alias("provider_version"),
        "file_path", F.coalesce("line_start", F.lit(1)).alias("line_number"), F.when(k == "variable", _bare(text("type"))).alias("variable_type"), F.when(k == "variable", F.try_variant_get(v, "$.default", "variant")).alias("default_value"),
        F.when(k == "variable", F.try_variant_get(v, "$.nullable", "boolean")).alias("nullable"), F.coalesce(F.try_variant_get(v, "$.sensitive", "boolean"), F.lit(False)).alias("sensitive"),
        F.when(k == "output", F.try_variant_get(v, "$.value", "variant")).alias("output_value"), F.when(k == "module", text("source")).alias("source"), F.when(k == "module", text("version")).alias("module_version"),
        text("description").alias("description"), F.from_json(text("tags"), "map<string,string>").alias("tags"), F.from_json(text("depends_on"), "array<string>").alias("depends_on"),
        v.alias("attributes"), F.col("body").alias("attributes_text"), F.col("ord").cast("long").alias("ord"),
    )
    last = F.row_number().over(Window.partitionBy("project", "full_name").orderBy(F.desc("file_path"), F.desc("ord")))
    return o.withColumn("last_", last).where("last_ = 1").drop("last_")


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^\$\{\s*|\s*\}$", "")


def tfvars(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, name, value`` (JSON) of the variable files below ``path``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tfvars,tfvars.json}").load(path)
    found = found.select(F.regexp_replace("path", "^file:/+", "/").alias("file_path"), F.col("content").cast("string").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, c in zip(pdf.file_path, pdf.content, strict=True):
                try:
                    rows += [(f, k, json.dumps(x, ensure_ascii=False)) for k, x in _read(c, f).items()]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["file_path", "name", "value"])

    return found.mapInPandas(run, "file_path string, name string, value string")


def simple_vars(lines: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """``name, value, kind`` of ``name = value`` lines (column ``value``): what stands in double quotes is a string
    without them, then there are truth values and whole numbers; comments are skipped. ``overrides`` win,
    and are strings."""
    parts = F.split("value", "=", 2)
    rows = lines.where(~F.trim("value").startswith("#") & F.col("value").contains("=")).select(F.trim(parts[0]).alias("name"), F.trim(parts[1]).alias("v"))
    v = F.col("v")
    quoted, truth = v.rlike('^".*"$') & (F.length(v) > 1), F.lower(v).isin("true", "false")
    value = F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).when(truth, F.lower(v)).otherwise(v)
    rows = rows.select("name", value.alias("value"), F.when(quoted, "string").when(truth, "bool").when(v.rlike("^[0-9]+$"), "number").otherwise("string").alias("kind"))
    if not overrides:
        return rows
    own = lines.sparkSession.createDataFrame([(k, x, "string") for k, x in overrides.items()], "name string, value string, kind string")
    return rows.join(own, "name", "left_anti").unionByName(own)


def backend(objects_: DataFrame) -> DataFrame:
    """The backend of the first settings block that has one."""
    b = F.try_variant_get(F.col("attributes"), "$.backend", "string")
    return objects_.where("type = 'terraform'").select("project", "file_path", "ord", b.alias("backend")).where("backend is not null").orderBy("file_path", "ord").limit(1)


def locals_flat(objects_: DataFrame) -> DataFrame:
    """``full_name, value``: the leaves of nested locals at any depth, by dotted path; list items by number."""
    rows = objects_.where("type = 'local'").select("full_name", F.try_variant_get("attributes", "$.value", "variant").alias("v"))
    done = None
    while True:
        rows = written(rows)
        kind = F.schema_of_variant("v")
        is_leaf = ~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        leaf = rows.where(is_leaf).select("full_name", F.col("v").cast("string").alias("value"))
        done = leaf if done is None else done.unionAll(leaf)
        inner = rows.where(~is_leaf)
        if inner.isEmpty():
            return done
        as_map = F.try_variant_get("v", "$", "map<string,variant>")
        as_list = F.try_variant_get("v", "$", "array<variant>")
        a = inner.where(as_map.isNotNull()).select("full_name", F.explode(as_map).alias("k", "v"))
        b = inner.where(as_map.isNull()).select("full_name", F.posexplode(as_list).alias("p", "v")).select("full_name", F.col("p").cast("string").alias("k"), "v")
        rows = a.unionAll(b).select(F.concat_ws(".", "full_name", "k").alias("full_name"), "v")


def lines(found: DataFrame) -> DataFrame:
    """``project, file_path, line_number, line``."""
    return found.select("project", "file_path", F.posexplode(F.split("content", "\r?\n", -1)).alias("i", "line")).select("project", "file_path", (F.col("i") + 1).alias("line_number"), "line")


def entries(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """``key, value`` (VARIANT) of each entry of a JSON object in a text column, with the columns in ``keep``."""
    v = F.try_variant_get(F.try_parse_json(F.col(column)), "$", "map<string,variant>")
    return rows.select(*keep, F.explode(v).alias("key", "value"))


def settings(objects_: DataFrame) -> DataFrame:
    """``provider, constraint`` that the settings blocks require, each of them and all of their ``required_providers``."""
    need = F.try_variant_get("attributes", "$.required_providers", "string")
    every = F.when(need.startswith("["), need).otherwise(F.concat(F.lit("["), need, F.lit("]")))
    x = objects_.where("type = 'terraform'").select(F.explode(F.from_json(every, "array<map<string,string>>")).alias("block")).select(F.explode("block").alias("provider", "spec"))
    return x.select("provider", F.coalesce(F.get_json_object("spec", "$.version"), F.when(~F.col("spec").startswith("{"), F.col("spec"))).alias("constraint")).where("provider <> '__lines__'")
