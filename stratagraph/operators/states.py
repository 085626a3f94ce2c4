"""The state of each object: one CASE over joined features, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from . import graph

# Substrings of resource types that name core and outward-facing infrastructure.
CORE = (
    "vpc", "vnet", "network", "subnet", "security_group", "firewall", "nsg", "route_table", "routing", "internet_gateway", "nat_gateway", "vpn_gateway", "load_balancer", "lb", "alb", "nlb",
    "database", "db", "rds", "sql", "cluster", "aks", "eks", "gke", "storage_account", "blob",
)
OUTWARD = (
    "load_balancer", "alb", "nlb", "lb", "api_gateway", "apigw", "cloudfront", "cdn", "waf", "firewall", "nat_gateway", "vpn", "direct_connect", "public_ip", "eip", "dns", "route53",
)
NAME_STYLE = r"^([a-z][a-z0-9_]*|[a-z][a-z0-9-]*|[a-z][a-zA-Z0-9]*)$"
COMPLEXITY_LIMIT = 30.0


def name_style(name: Column) -> Column:
    """Snake, kebab or camel case (of the lower-cased name), no doubled separator, 2 to 63 characters."""
    low = F.lower(name)
    return low.rlike(NAME_STYLE) & ~low.rlike("[_-]{2,}") & F.length(name).between(2, 63)


def good_practice(description: Column, tags: Column, name: Column, is_resource: Column) -> Column:
    """Two or more of: a description of ten characters, two tags (resources only), a good name."""
    votes = (F.length(F.trim(F.coalesce(description, F.lit("")))) >= 10).cast("int") + (is_resource & (F.coalesce(F.size(tags), F.lit(0)) >= 2)).cast("int") + F.coalesce(name_style(name), F.lit(False)).cast("int")
    return votes >= 2


def core_infrastructure(resource_type: Column) -> Column:
    return F.lower(F.coalesce(resource_type, F.lit(""))).rlike("|".join(CORE))


def external_facing(resource_type: Column) -> Column:
    return F.lower(F.coalesce(resource_type, F.lit(""))).rlike("|".join(OUTWARD))


def incomplete(attributes: Column, type_: Column, resource_type: Column, source: Column, nullable: Column, default: Column, output: Column) -> Column:
    """An object that lacks what its kind can't do without. ``attributes`` is a VARIANT; the tests of
    a provider's type are by substring, in order, and the first type that matches decides."""
    lacks = lambda *names: _all(F.try_variant_get(attributes, f"$.{n}", "string").isNull() for n in names)
    rt = F.coalesce(resource_type, F.lit(""))
    empty = attributes.isNull() | F.to_json(attributes).isin("{}", "null")
    of_resource = (
        F.when(empty, True)
        .when(rt.startswith("aws_") & rt.contains("aws_instance"), lacks("ami", "instance_type"))
        .when(rt.startswith("aws_") & rt.contains("aws_s3_bucket"), False)
        .when(rt.startswith("aws_") & rt.contains("aws_security_group"), lacks("name", "name_prefix"))
        .when(rt.contains("azurerm_resource_group"), lacks("location") | lacks("name"))
        .when(rt.contains("google_compute_instance"), lacks("machine_type", "boot_disk"))
        .otherwise(False)
    )
    return (
        F.when(type_ == "resource", of_resource)
        .when(type_ == "module", F.coalesce(source, F.lit("")) == "")
        .when(type_ == "variable", (~F.coalesce(nullable, F.lit(True))) & default.isNull())
        .when(type_ == "output", output.isNull() & lacks("value"))
        .otherwise(False)
    )


def _all(parts) -> Column:  # noqa: ANN001
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def classify(f: DataFrame) -> DataFrame:
    """Adds ``state`` and ``state_reason`` to what ``features`` gives."""
    t, d, n, c = F.col("type"), F.col("dependencies"), F.col("dependents"), F.col("complexity")
    lattice = F.when((d == 0) & (n == 0), "isolated").when((d > 0) & (n == 0), "active").when((d == 0) & (n > 0), "leaf").otherwise("integrated")
    tail = (
        F.when((d == 0) & (n == 0), "isolated")
        .when(d == 0, "leaf")
        .when((n >= 10) | (n >= 5) & (d <= 3), "hub")
        .when((d >= 5) & (n == 1), "underutilized")
        .when((c >= 20) | (d >= 10), "complex")
        .when(F.col("good_practice") & d.between(2, 8) & (n >= 2), "healthy")
        .when((d > 0) & (n >= 2), "integrated")
        .otherwise("active")
    )
    state = (
        F.when(F.col("n_missing") > 0, "missing_dependency")
        .when(F.col("circular") | (c > COMPLEXITY_LIMIT), "broken")
        .when(F.col("incomplete"), "incomplete")
        .when(t == "variable", F.when(F.col("reaches"), "input").otherwise("unused"))
        .when(t == "provider", F.when((F.col("users") > 0) | (n > 0), "configuration").otherwise("unused"))
        .when(t == "output", F.when(d == 0, "incomplete").when(F.col("infra_ref") | (n > 0), "output_interface").otherwise("orphaned"))
        .when(t == "local", F.when(F.col("reaches"), "active").otherwise("unused"))
        .when(t.isin("resource", "module"), lattice)
        .when(t == "data", F.when(n == 0, "unused").otherwise("external_data"))
        .when(t == "terraform", "configuration")
        .otherwise(tail)
    )
    return f.withColumn("state", state).withColumn("state_reason", _reason(f))


def _said(text: str, *columns: str) -> Column:
    return F.format_string(text, *(F.col(c) for c in columns))


def _reason(f: DataFrame) -> Column:
    """Why the state is what it is; the wordings are fixed values. Branches are those of ``classify``, in its order.

    Missing names come as they were found; a cycle's length is that of its strongly connected component.
    """
    t, d, n, c = F.col("type"), F.col("dependencies"), F.col("dependents"), F.col("complexity")
    kind = F.col("resource_type") if "resource_type" in f.columns else F.lit(None).cast("string")
    has_default = F.col("default_value").isNotNull() if "default_value" in f.columns else F.lit(False)
    low = F.lower(F.coalesce(kind, F.lit("")))
    more = F.when(F.col("n_missing") > 3, F.format_string(" (+%d more)", F.col("n_missing") - 3)).otherwise("")
    lacking = (
        F.when((t == "resource") & F.coalesce(F.col("bare"), F.lit(False)), "Resource has no configuration attributes")
        .when((t == "resource") & low.contains("instance"), "Instance resource missing required configuration (ami, instance_type, etc.)")
        .when((t == "resource") & low.contains("bucket"), "Bucket resource missing required configuration")
        .when((t == "resource") & low.contains("security_group"), "Security group missing name configuration")
        .when((t == "resource") & low.contains("resource_group"), "Resource group missing location or name")
        .when((t == "resource") & (low != ""), F.format_string("Resource '%s' missing required configuration", kind))
        .when(t == "resource", "Resource missing required configuration")
        .when(t == "module", "Module missing source attribute")
        .when(t == "variable", "Required variable (nullable=false) missing default value")
        .when(t == "output", "Output missing value attribute")
        .otherwise("Missing required configuration")
    )
    resource = (
        F.when((d == 0) & (n == 0), "Resource not connected to any infrastructure")
        .when((n == 0) & core_infrastructure(kind), _said("Core infrastructure using %d dependencies", "dependencies"))
        .when(n == 0, _said("Infrastructure resource using %d dependencies", "dependencies"))
        .when(d == 0, _said("Independent infrastructure used by %d consumer(s)", "dependents"))
        .otherwise(_said("Infrastructure using %d deps, used by %d consumer(s)", "dependencies", "dependents"))
    )
    module = (
        F.when((d == 0) & (n == 0), "Module not connected to any infrastructure")
        .when(n == 0, _said("Module provisions infrastructure using %d input(s)", "dependencies"))
        .when(d == 0, _said("Module provides values to %d consumer(s)", "dependents"))
        .otherwise(_said("Module processes %d input(s) and provides to %d consumer(s)", "dependencies", "dependents"))
    )
    output = (
        F.when(d == 0, "Output declared but has no value source")
        .when(F.col("infra_ref") & (n == 0), _said("Exports infrastructure value (external interface) from %d source(s)", "dependencies"))
        .when(F.col("infra_ref"), _said("Exports value from %d source(s), also used by %d internal consumer(s)", "dependencies", "dependents"))
        .when(n == 0, _said("Output references %d intermediate value(s) but may not be useful externally", "dependencies"))
        .otherwise(_said("Transforms %d value(s), used by %d consumer(s)", "dependencies", "dependents"))
    )
    local = (
        F.when(~F.col("reaches") & (d > 0), _said("Local value with %d input(s) but not used in infrastructure", "dependencies"))
        .when(~F.col("reaches"), "Local value computed but not used in infrastructure")
        .when(d == 0, _said("Local value used by %d infrastructure component(s)", "dependents"))
        .otherwise(_said("Computed local using %d input(s), used by %d component(s)", "dependencies", "dependents"))
    )
    provider = (
        F.when(F.col("users") > 0, _said("Provider used by %d resource(s)", "users"))
        .when(n > 0, _said("Provider configured with %d input(s), awaiting resources", "dependents"))
        .otherwise("Provider configured but no resources use it")
    )
    variable = (
        F.when(F.col("reaches"), _said("Input variable used by %d object(s)", "dependents"))
        .when(has_default, "Variable declared with default but never used in infrastructure")
        .otherwise("Variable declared but never used in infrastructure")
    )
    tail = (
        F.when((d == 0) & (n == 0), "Not connected to any infrastructure components")
        .when((d == 0) & external_facing(kind), _said("External-facing resource used by %d object(s)", "dependents"))
        .when(d == 0, _said("Independent resource used by %d object(s)", "dependents"))
        .when(n >= 10, _said("Critical hub used by %d objects", "dependents"))
        .when((n >= 5) & (d <= 3), _said("Central resource distributing to %d consumers", "dependents"))
        .when((d >= 5) & (n == 1), _said("Complex resource (%d deps) used by only 1 object", "dependencies"))
        .when(c >= 20, _said("High complexity (score: %.1f) - consider refactoring", "complexity"))
        .when(d >= 10, _said("Very high dependency count (%d) - consider simplification", "dependencies"))
        .when(F.col("good_practice") & d.between(2, 8) & (n >= 2), _said("Well-designed: %d deps, %d consumers, follows best practices", "dependencies", "dependents"))
        .when(d.between(2, 8) & (n >= 2), _said("Well-integrated: %d deps, %d consumers", "dependencies", "dependents"))
        .when(n >= 2, _said("Integrated: %d deps, %d consumers", "dependencies", "dependents"))
        .otherwise(_said("Active: %d dependencies, %d consumers", "dependencies", "dependents"))
    )
    return (
        F.when(F.col("n_missing") > 0, F.concat(_said("References %d undefined object(s): %s", "n_missing", "missing_names"), more))
        .when(F.col("circular"), _said("Circular dependency detected involving %d object(s)", "cycle_size"))
        .when(c > COMPLEXITY_LIMIT, _said("Critical complexity level (score: %.1f)", "complexity"))
        .when(F.col("incomplete"), lacking)
        .when(t == "variable", variable)
        .when(t == "provider", provider)
        .when(t == "output", output)
        .when(t == "local", local)
        .when(t == "resource", resource)
        .when(t == "module", module)
        .when(t == "data", F.when(n == 0, "Data source queried but result never used").otherwise(_said("External data used by %d object(s)", "dependents")))
        .when(t == "terraform", "Terraform configuration block")
        .otherwise(tail)
    )


def _lost(missing: DataFrame) -> DataFrame:
    """``full_name, n_missing, missing_names``: the first three names in the order of places, else by name. Ranks beyond
    three are dropped before the shuffle, so an object may miss any number."""
    order = [c for c in ("place", "ref") if c in missing.columns]
    rank = F.row_number().over(Window.partitionBy("src").orderBy(*order))
    few = missing.withColumn("r", rank).where("r <= 3").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("r", "ref"))).alias("few"))
    n = missing.groupBy("src").agg(F.count("*").alias("n_missing"))
    return n.join(few, "src").select(F.col("src").alias("full_name"), "n_missing", F.array_join(F.col("few.ref"), ", ").alias("missing_names"))


def features(objects: DataFrame, edges: DataFrame, missing: DataFrame) -> DataFrame:
    """The features of ``objects`` (``full_name, type`` and flags ``incomplete, good_practice, bare``: without
    attributes, where there are any) under ``edges`` (``src, dst``) and ``missing`` (``src, ref`` and the ``place`` where it was found, if known).

    Degrees, users and infrastructure references come from a single aggregate over the edges. An explicit
    dependency counts even where there is no such object.
    """
    # Names are numbered once; all that follows goes by number.
    f = written(objects.withColumn("id", F.monotonically_increasing_id()))
    at = lambda name, id_, type_: f.select(F.col("full_name").alias(name), F.col("id").alias(id_), F.col("type").alias(type_))
    e = edges.select(F.col("src").alias("s_"), F.col("dst").alias("d_")).join(at("s_", "src", "src_type"), "s_").join(at("d_", "dst", "dst_type"), "d_", "left")
    e = written(e.groupBy("src", "d_", "dst", "src_type", "dst_type").agg(F.count("*").alias("c")).drop("d_"))
    as_src = e.groupBy(F.col("src").alias("id")).agg(F.sum("c").alias("dependencies"), F.max(F.col("dst_type").isin("resource", "module", "data")).alias("infra_ref"))
    known = e.where("dst is not null")
    as_dst = known.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("dependents"), F.count_if(F.col("src_type").isin("resource", "data")).alias("users"))
    lost = _lost(missing).join(at("full_name", "id", "type").select("full_name", "id"), "full_name").drop("full_name")
    return _joined(f, as_src, as_dst, lost, known)


def features_by_number(objects: DataFrame, edges: DataFrame, missing: DataFrame) -> DataFrame:
    """``features`` of objects that have a number, ``id``, by which their edges go: a written table of distinct ``src, dst, src_type, dst_type`` with
    their count ``c``. Missing references, ``src, c``, are counted, not named. All joins are by number, so objects are shuffled once."""
    as_src = edges.groupBy(F.col("src").alias("id")).agg(F.sum("c").alias("dependencies"), F.max(F.col("dst_type").isin("resource", "module", "data")).alias("infra_ref"))
    as_dst = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("dependents"), F.count_if(F.col("src_type").isin("resource", "data")).alias("users"))
    lost = missing.groupBy(F.col("src").alias("id")).agg(F.sum("c").alias("n_missing"), F.lit(None).cast("string").alias("missing_names"))
    return _joined(objects, as_src, as_dst, lost, edges)


def _joined(f: DataFrame, as_src: DataFrame, as_dst: DataFrame, lost: DataFrame, known: DataFrame) -> DataFrame:
    """Objects with what was found of them by ``id``, cycles and reach among it. ``known``: a written table of distinct edges."""
    members = graph.cycle_members(known.where("src <> dst"), distinct=True)
    sizes = members.groupBy("cycle").agg(F.count("*").alias("cycle_size"))
    loops = members.join(sizes, "cycle").select(F.col("node").alias("id"), F.lit(True).alias("circular"), "cycle_size")
    reach = graph.reaches(f.select(F.col("id").alias("node"), "type"), known.select("src", "dst", "src_type")).select(F.col("node").alias("id"), F.lit(True).alias("reaches"))
    for x in (as_src, as_dst, loops, reach, lost):
        f = f.join(x, "id", "left")
    f = f.drop("id")
    f = f.na.fill(0, ["dependencies", "dependents", "users", "n_missing"]).na.fill(False, ["circular", "reaches", "infra_ref"])
    for flag in ("incomplete", "good_practice", "bare"):
        if flag not in f.columns:
            f = f.withColumn(flag, F.lit(False))
    f = f.withColumn("has_missing", F.col("n_missing") > 0)
    return f.withColumn("complexity", graph.complexity(missing="has_missing")).drop("has_missing")
