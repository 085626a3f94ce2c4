"""Rules as row predicates, and the plan that evaluates many of them in one pass over the objects.

A rule's checks are pairs of a predicate and a message, both Columns over the object table. All rules
that apply are folded into one array of issue structs for each object, which is filtered and exploded:
one scan, no shuffle, whatever the number of rules. Project rules are aggregates over the project.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import written

Checks = Callable[[], list[tuple[Column, Column | str]]]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    category: str
    scope: str
    types: tuple[str, ...]
    priority: int
    checks: Checks
    description: str = ""
    suggestion: str = ""
    enabled: bool = True
    #: A further predicate of the objects that the rule is for, if any.
    condition: Callable[[], Column] | None = None


@dataclass(frozen=True)
class Each:
    """Messages of a check that raises one issue for each: an array column."""

    messages: Column


@dataclass(frozen=True)
class Failed:
    """Message of a check that tells that its rule can't be evaluated on the object."""

    message: str


class Registry:
    def __init__(self) -> None:
        self.rules: dict[str, Rule] = {}

    def add(self, rule: Rule) -> None:
        if rule.rule_id in self.rules:
            raise ValueError(f"rule {rule.rule_id} is registered already")
        self.rules[rule.rule_id] = rule

    def rule(self, rule_id: str, severity: str, category: str, *types: str, priority: int = 0, scope: str = "resource_specific", suggestion: str = "", condition: Callable[[], Column] | None = None) -> Callable[[Checks], Checks]:
        """Decorator: registers what the function returns as the checks of a rule; its docstring describes it."""

        def take(checks: Checks) -> Checks:
            self.add(Rule(rule_id, severity, category, scope, types, priority, checks, (checks.__doc__ or "").strip(), suggestion, condition=condition))
            return checks

        return take

    def remove(self, rule_id: str) -> None:
        self.rules.pop(rule_id, None)

    def get(self, rule_id: str) -> Rule | None:
        return self.rules.get(rule_id)

    def enable(self, rule_id: str, on: bool = True) -> None:
        self.rules[rule_id] = replace(self.rules[rule_id], enabled=on)

    def disable(self, rule_id: str) -> None:
        self.enable(rule_id, on=False)

    def chosen(self, categories: Iterable[str] | None = None, ignore: Iterable[str] = ()) -> list[Rule]:
        """Enabled rules by priority, then id."""
        wanted, skip = set(categories) if categories is not None else None, set(ignore)
        rules = (r for r in self.rules.values() if r.enabled and r.rule_id not in skip and (wanted is None or r.category in wanted))
        return sorted(rules, key=lambda r: (-r.priority, r.rule_id))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(r.rule_id, r.description, r.category, r.severity, r.suggestion, r.scope, list(r.types), r.priority, r.enabled) for r in self.rules.values()]
        return spark.createDataFrame(rows, "rule_id string, description string, category string, severity string, suggestion string, scope string, resource_types array<string>, priority int, enabled boolean")

    def stats(self, spark: SparkSession) -> DataFrame:
        return self.table(spark).groupBy("scope", "category").agg(F.count("*").alias("n"), F.count_if("enabled").alias("n_enabled"))

    def evaluate(self, objects: DataFrame, categories: Iterable[str] | None = None, ignore: Iterable[str] = (), strict: bool = False, fail_fast: bool = False) -> DataFrame:
        """The issues of the objects. ``strict`` makes warnings errors. Interpolated names are skipped.

        A check that can't be evaluated on an object (a number is expected and something else stands
        there) is an issue ``VALIDATOR-ERROR``, not silence. With ``fail_fast`` project rules aren't
        evaluated if an object has an error; issues of objects are all given, since they come from one pass.
        """
        rules = self.chosen(categories, ignore)
        each = _found(rules, strict)
        empty = objects.sparkSession.createDataFrame([], _SCHEMA)
        out = objects.where(_eligible()).select("project", F.explode(each).alias("i")).select("project", "i.*") if each is not None else empty
        if fail_fast and not out.where("severity = 'error'").isEmpty():
            return out
        for r in rules:
            if r.scope == "project_level":
                for check, message in r.checks():
                    found = objects.groupBy("project").agg(check.alias("bad")).where("bad")
                    text = message if isinstance(message, Column) else F.lit(message)
                    out = out.unionByName(found.select("project", F.lit(r.rule_id).alias("rule_id"), F.lit(_level(r, strict)).alias("severity"), F.lit(r.category).alias("category"), text.alias("message"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_number"), F.lit("project").alias("resource_name"), F.lit("project").alias("resource_type"), F.lit(r.suggestion).alias("suggestion")))
        return out

    def run_stats(self, objects: DataFrame, categories: Iterable[str] | None = None, ignore: Iterable[str] = (), strict: bool = False) -> DataFrame:
        """One row: ``resources_validated, rules_executed, errors, warnings, info``. A rule is executed once for
        each object that it applies to, and project rules once for each project. The objects are read once: a project's
        counts, and what its own rules say, come from one aggregate."""
        rules = self.chosen(categories, ignore)
        whole = [r for r in rules if r.scope == "project_level"]
        each = _found(rules, strict)
        looked = objects.withColumns({"ok_": _eligible(), "run_": _run(rules), "found_": F.when(_eligible(), each) if each is not None else F.array().cast("array<struct<severity:string>>")})
        level = lambda s: F.coalesce(F.sum(F.size(F.filter("found_", lambda i: i["severity"] == s))), F.lit(0))
        checks = [(_level(r, strict), check) for r in whole for check, _ in r.checks()]
        by = looked.groupBy("project").agg(
            F.count_if("ok_").alias("resources_validated"), (F.coalesce(F.sum(F.when(F.col("ok_"), F.col("run_"))), F.lit(0)) + len(whole)).alias("rules_executed"),
            *(level(s).alias(f"{s}_") for s in _LEVELS), *(F.coalesce(check, F.lit(False)).cast("long").alias(f"bad_{k}") for k, (_, check) in enumerate(checks)),
        )
        bad = lambda s: sum((F.col(f"bad_{k}") for k, (at, _) in enumerate(checks) if at == s), F.col(f"{s}_"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return by.agg(total("resources_validated").alias("resources_validated"), total("rules_executed").alias("rules_executed"), *(total(bad(s)).alias(n) for s, n in _LEVELS.items()))

    def run(self, objects: DataFrame, categories: Iterable[str] | None = None, ignore: Iterable[str] = (), strict: bool = False) -> tuple[DataFrame, dict]:
        """The issues, evaluated once and written, and what was observed as they were: the counts of ``run_stats``, ``seconds`` and
        ``resources_per_second``."""
        rules = self.chosen(categories, ignore)
        seen, raised = Observation(), Observation()
        looked = objects.observe(seen, F.count_if(_eligible()).alias("resources_validated"), F.coalesce(F.sum(F.when(_eligible(), _run(rules))), F.lit(0)).alias("rules_executed"))
        own = Registry()
        own.rules = {r.rule_id: r for r in rules if r.scope != "project_level"}
        rest = Registry()
        rest.rules = {r.rule_id: r for r in rules if r.scope == "project_level"}
        began = time.perf_counter()
        issues = own.evaluate(looked, strict=strict).unionByName(rest.evaluate(objects, strict=strict))
        issues = written(issues.observe(raised, *(F.count_if(F.col("severity") == s).alias(n) for s, n in _LEVELS.items())))
        took = time.perf_counter() - began
        n_projects = objects.select("project").distinct().count() if rest.rules else 0
        stats = seen.get | raised.get
        stats["rules_executed"] += n_projects * len(rest.rules)
        return issues, stats | {"seconds": took, "resources_per_second": stats["resources_validated"] / max(took, 1e-9)}

    def passed(self, spark: SparkSession, issues: DataFrame, categories: Iterable[str] | None = None) -> DataFrame:
        """Ids of the rules without an issue."""
        ids = spark.createDataFrame([(r.rule_id,) for r in self.chosen(categories)], "rule_id string")
        return ids.join(issues.select("rule_id").distinct(), "rule_id", "left_anti")


def narrowed(issues: DataFrame, category: str | None = None, severity: str | None = None) -> DataFrame:
    """The issues of a category, of a severity, or of both."""
    for column, wanted in (("category", category), ("severity", severity)):
        if wanted is not None:
            issues = issues.where(F.col(column) == wanted)
    return issues


_SCHEMA = "project string, rule_id string, severity string, category string, message string, file_path string, line_number int, resource_name string, resource_type string, suggestion string"
# The type prefix of each cloud's resources.
CLOUDS = {"AWS": "aws_", "AZURE": "azurerm_", "GCP": "google_"}


#: Rule id of issues that tell that a rule can't be evaluated.
FAILED = "VALIDATOR-ERROR"


def _cloud(name: str) -> Column:
    return F.coalesce(F.col("resource_type").startswith(CLOUDS[name]), F.lit(False)) if name in CLOUDS else F.lit(True)


#: Severities, and the names of their counts.
_LEVELS = {"error": "errors", "warning": "warnings", "info": "info"}


def _eligible() -> Column:
    return ~F.coalesce(F.col("name").rlike(r"\$\{|\}"), F.lit(False))


def _run(rules: list[Rule]) -> Column:
    """How many rules apply to an object."""
    return sum((_applies(r).cast("long") for r in rules if r.scope != "project_level"), F.lit(0).cast("long"))


def _found(rules: list[Rule], strict: bool) -> Column | None:
    """An object's issues, as an array; no column without rules."""
    each = []
    for r in rules:
        if r.scope == "project_level":
            continue
        applies = _applies(r)
        for check, message in r.checks():
            if isinstance(message, Each):
                found = _each(r, message.messages, strict)
            elif isinstance(message, Failed):
                found = F.array(_issue(replace(r, rule_id=FAILED, severity="error", category="syntax", suggestion=""), f"Rule {r.rule_id} failed: {message.message}", strict))
            else:
                found = F.array(_issue(r, message, strict))
            each.append(F.when(applies & F.coalesce(check, F.lit(False)), found))
    return F.flatten(F.filter(F.array(*each), lambda x: x.isNotNull())) if each else None


def _applies(r: Rule) -> Column:
    """Rules for all kinds are for those of their cloud, by the prefix of the resource type."""
    kind = F.when(F.col("type").isin("resource", "data") & F.col("resource_type").isNotNull(), F.col("resource_type")).otherwise(F.col("type"))
    if r.scope == "generic":
        out = _cloud(r.rule_id.split("-")[0]) & (kind.isin(*r.types) if r.types else F.lit(True))
    else:
        out = kind.isin(*r.types) | F.col("type").isin(*r.types)
    return out if r.condition is None else out & F.coalesce(r.condition(), F.lit(False))


def _level(r: Rule, strict: bool) -> str:
    return "error" if strict and r.severity == "warning" else r.severity


def _issue(r: Rule, message: Column | str, strict: bool) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(_level(r, strict)).alias("severity"), F.lit(r.category).alias("category"), text.alias("message"), F.col("file_path"), F.col("line_number"), F.col("full_name").alias("resource_name"), F.coalesce("resource_type", "type").alias("resource_type"), F.lit(r.suggestion).alias("suggestion"))


def _each(r: Rule, messages: Column, strict: bool) -> Column:
    return F.transform(messages, lambda m: _issue(r, m, strict))


def hardened(issues: DataFrame) -> DataFrame:
    """Issues with warnings as errors."""
    return issues.withColumn("severity", F.when(F.col("severity") == "warning", "error").otherwise(F.col("severity")))


registry = Registry()


# Attributes are looked up in the VARIANT; a block may stand as itself or as a list of one.
def attr(path: str, kind: str = "string") -> Column:
    """An attribute by its dotted path; ``a.b`` also finds ``a[0].b``."""
    head, _, tail = path.partition(".")
    v = F.col("attributes")
    found = F.try_variant_get(v, f"$.{path}", kind)
    return found if not tail else F.coalesce(found, F.try_variant_get(v, f"$.{head}[0].{tail}", kind))


def falsy(path: str) -> Column:
    """Missing, null, false, zero or empty; the texts "0" and "false" are neither."""
    return F.coalesce(F.to_json(attr(path, "variant")), F.lit("null")).isin('""', "false", "0", "0.0", "[]", "{}", "null")


def no_number(path: str) -> Column:
    """There, but neither a number nor null."""
    return attr(path, "variant").isNotNull() & ~F.is_variant_null(attr(path, "variant")) & ~F.schema_of_variant(attr(path, "variant")).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$")


def number(path: str, otherwise: float) -> Column:
    """``otherwise`` only where there is none; null, and so no issue of its own, where it is no number."""
    return F.when(attr(path, "variant").isNull(), F.lit(float(otherwise))).when(~no_number(path), attr(path, "double"))


def numeric(path: str, checks: list) -> list:
    """``checks`` that need a number, with the one that tells of its lack."""
    return [*checks, (no_number(path), Failed(f"{path} is not a number"))]


def truthy(path: str) -> Column:
    return ~falsy(path)


def items(path: str, fields: str) -> Column:
    """A list of blocks as an array of structs; a single block is a list of one."""
    text = F.coalesce(F.try_variant_get(F.col("attributes"), f"$.{path}", "string"), F.lit("[]"))
    text = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    return F.coalesce(F.from_json(text, f"array<struct<{fields}>>"), F.array().cast(f"array<struct<{fields}>>"))


def tag_keys() -> Column:
    keys = F.map_keys(F.from_json(F.coalesce(attr("tags"), F.lit("{}")), "map<string,string>"))
    return F.coalesce(keys, F.array().cast("array<string>"))


def lacking(*tags: str) -> Column:
    return F.array_except(F.array(*map(F.lit, tags)), tag_keys())
