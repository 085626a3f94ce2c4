"""References in attribute texts: extraction by pattern, and resolution against the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written

# The reference patterns of the configuration language.
_ID = "[A-Za-z_][A-Za-z0-9_-]*"
PATTERNS = (
    (rf"\b(var\.{_ID})", 1),
    (rf"\b(local\.{_ID})", 1),
    (rf"\b(module\.{_ID})\.", 1),
    (rf"\b(data\.{_ID}\.{_ID})", 1),
    (rf"\b([a-z][a-z0-9_]*\.{_ID})\.", 1),
)
PREFIXES = ("var", "local", "module", "data", "output", "provider", "terraform")
# Types of references whose value is known only when the configuration is applied.
COMPUTED = ("resource", "data", "module", "self", "terraform", "count", "each")
# Base complexity of a reference by its type.
TYPE_COMPLEXITY = {"local": 1, "variable": 2, "resource": 5, "data": 8, "module": 10, "function": 15, "path": 1, "terraform": 3, "count": 2, "each": 2, "self": 4}
SENSITIVE = "password|secret|key|token|private_key|certificate"


def normalised(ref: Column) -> Column:
    """Without blanks, quotes around it and dots at its end."""
    return F.rtrim(F.btrim(F.btrim(F.btrim(F.btrim(ref), F.lit('"')), F.lit("'"))), F.lit("."))


def valid(ref: Column) -> Column:
    parts = F.split(ref, r"\.")
    return ~ref.rlike(r"[\s\"'{}\[\]]") & (F.size(parts) >= 2) & (parts[0].isin(*PREFIXES) | parts[0].contains("_"))


def found_in(text: Column) -> Column:
    """Array of the distinct, normalised, valid references in a text."""
    every = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in PATTERNS))
    return F.array_distinct(F.filter(F.transform(every, normalised), valid))


def extract(objects: DataFrame, text: str = "attributes_text") -> DataFrame:
    """``src, ref`` of every object but variables and settings, itself excluded."""
    return extract_in_order(objects, text).drop("place")


def extract_in_order(objects: DataFrame, text: str = "attributes_text") -> DataFrame:
    """``src, place, ref`` as ``extract`` gives them, ``place`` being how many were found in the object before."""
    rows = objects.where(~F.col("type").isin("variable", "terraform")).select(F.col("full_name").alias("src"), F.posexplode(found_in(F.col(text))).alias("place", "ref"))
    return rows.where("src <> ref")


def resolve(refs: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(src, dst)`` and ``(src, ref)``: resolved and missing references against ``names`` (``full_name``).

    A reference binds to the object of its name, else to every object whose name starts with it. The
    second is an equi-join too: the catalog's names are spread into their prefixes, and only into those of
    the lengths that unmatched references have (a row for each length, so small). If references have a
    ``place``, missing ones have their first.

    No side is broadcast: what names and their prefixes take in memory has no measure in the bytes of the files that they come from.
    What each reference binds to is written once. Pairs come out of the join once each, with no look at all of them: a reference that begins with
    another of its object that binds by prefix has nothing of its own to add, and is left out before the join (``_covered``).
    """
    names = names.select("full_name").distinct()
    every = refs.select("ref").distinct()
    wanted = every.join(names.hint("merge"), every["ref"] == names["full_name"], "left_anti")
    sizes = wanted.agg(F.coalesce(F.sort_array(F.collect_set(F.length("ref"))), F.array().cast("array<int>")).alias("sizes")).first().sizes
    fitting = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.length("full_name"))
    prefixes = names.select("full_name", F.explode(F.transform(fitting, lambda n: F.substring(F.col("full_name"), F.lit(1), n))).alias("prefix"))
    bound = prefixes.join(wanted.hint("merge"), F.col("prefix") == F.col("ref")).select("ref", "full_name", F.lit(False).alias("exact"))
    same = names.join(every.hint("merge"), F.col("full_name") == F.col("ref")).select("ref", "full_name", F.lit(True).alias("exact"))
    bound = written(bound.unionAll(same))
    known = bound.select("ref", "exact").distinct()
    kept = _covered(refs.select("src", "ref").join(known.hint("merge"), "ref").repartition("src").distinct()).where(~F.col("covered") | F.col("exact") & ~F.coalesce(F.col("src") != F.col("ref"), F.lit(False)))
    resolved = kept.drop("exact").join(bound.hint("merge"), "ref").where("exact or src <> full_name").select("src", F.col("full_name").alias("dst"))
    missing = refs.join(known.select("ref").hint("merge"), "ref", "left_anti")
    first = [F.min("place").alias("place")] if "place" in refs.columns else []
    missing = missing.groupBy("src", "ref").agg(*first) if first else missing.select("src", "ref").distinct()
    return resolved, missing


def _covered(refs: DataFrame) -> DataFrame:
    """Adds to ``src, ref, exact`` whether the reference begins with another one of its ``src`` that isn't ``exact``.

    What begins with a reference lies, by its bytes, between it and itself with a byte above all others, and two such stretches are apart or one holds the other.
    So it is enough to know how far those before reach.
    """
    reach = F.when(~F.col("exact"), F.concat(F.encode("ref", "UTF-8"), F.lit(bytes([255]))))
    before = Window.partitionBy("src").orderBy(F.encode("ref", "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    return refs.withColumn("covered", F.coalesce(F.max(reach).over(before) > F.encode("ref", "UTF-8"), F.lit(False)))


def parsed(ref: Column) -> Column:
    """``ref_type, target, path`` of a reference, the target being the object's full name."""
    p = F.split(ref, r"\.")
    head = F.get(p, 0)
    kind = (
        F.when(head == "var", "variable").when(head == "local", "local").when(head == "module", "module").when(head == "data", "data")
        .when(head.isin("path", "terraform", "count", "each", "self"), head).otherwise("resource")
    )
    n = F.when(head == "data", 3).otherwise(2)
    return F.struct(kind.alias("ref_type"), F.array_join(F.slice(p, F.lit(1), n), ".").alias("target"), F.slice(p, n + 1, F.greatest(F.size(p) - n, F.lit(0))).alias("path"))


def scope(ref_type: Column) -> Column:
    return F.when(ref_type.isin("local", "variable"), "local").when(ref_type.isin("resource", "data", "self", "terraform", "path", "count", "each"), "module").when(ref_type == "module", "cross_module").otherwise("external")


def sensitive(path: Column) -> Column:
    return F.exists(path, lambda x: F.lower(x).rlike(SENSITIVE))


def computed(ref_type: Column) -> Column:
    return ref_type.isin(*COMPUTED)


def reference_complexity(ref_type: Column, path_length: Column, conditional: Column, is_computed: Column, is_sensitive: Column) -> Column:
    base = F.element_at(F.create_map(*(F.lit(x) for kv in TYPE_COMPLEXITY.items() for x in kv)), ref_type)
    add = lambda flag, n: F.when(flag, n).otherwise(0)
    return F.least(F.lit(100), F.coalesce(base, F.lit(1)) + path_length * 2 + add(conditional, 5) + add(is_computed, 3) + add(is_sensitive, 2))


def provider_edges(objects: DataFrame) -> DataFrame:
    """``src, dst``: resources and data to their provider object: the explicit one, which gets no other
    if it is missing, else the one named by the type's prefix."""
    providers = objects.where("type = 'provider'").select("full_name", F.concat_ws(".", "name", "provider_alias").alias("key"))
    users = objects.where(F.col("type").isin("resource", "data")).select(F.col("full_name").alias("src"), F.coalesce("provider", F.substring_index("resource_type", "_", 1)).alias("key"))
    return users.join(providers, "key").select("src", F.col("full_name").alias("dst"))
