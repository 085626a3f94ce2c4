"""A block's body taken apart: its values by path, its meta-arguments, and all that it depends on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from . import inspection

# Arguments that every block understands, apart from its own.
META = ("count", "for_each", "depends_on", "lifecycle", "provider")
#: Levels of a body that are opened in its row; it changes no result.
LEVELS = 5


def meta_arguments(rows: DataFrame, body: str = "attributes") -> DataFrame:
    """Adds ``count, for_each, depends_on, lifecycle, provider`` (VARIANT, null where not given) and ``own``, a map of the other
    arguments, to rows with a VARIANT ``body``. One dependency that isn't in a list is a list of one; a body that is no object has none."""
    every = F.try_variant_get(F.col(body), "$", "map<string,variant>")
    given = {m: F.try_variant_get(F.col(body), f"$.{m}", "variant") for m in META}
    depends = F.coalesce(F.try_variant_get(given["depends_on"], "$", "array<string>"), F.when(given["depends_on"].isNotNull(), F.array(F.try_variant_get(given["depends_on"], "$", "string"))))
    own = F.map_filter(every, lambda k, _: ~k.isin(*META) & (k != "__lines__"))
    return rows.withColumns(given | {"depends_on": depends, "own": own})


def values(rows: DataFrame, key: str, body: str = "attributes") -> DataFrame:
    """``key, path, source, value``: every scalar of a VARIANT as text, by its path (``rule[0].port``).

    ``source`` is the meta-argument that it is in, ``attribute`` for a value of the block itself, ``nested`` for deeper ones. A round
    opens ``LEVELS`` levels where the row lies and writes what it found once; only what is nested deeper goes to another round. Nulls are left out.
    """
    at = rows.select(F.col(key).alias("of_"), F.lit("").alias("path"), F.lit(None).cast("string").alias("top"), F.lit(0).alias("depth"), F.col(body).alias("v"))
    done = None
    while True:
        at = _typed(at)
        for _ in range(LEVELS):
            at = _typed(_opened(at))
        source = F.when(F.col("top").isin(*META), F.col("top")).when(F.col("depth") <= 1, "attribute").otherwise("nested")
        more = F.col("m").isNotNull() | F.col("l").isNotNull()
        found = at.where(more | F.col("v").isNotNull() & ~F.is_variant_null("v") & (F.col("depth") > 0))
        found = written(found.select("of_", "path", F.when(~more, source).alias("source"), F.when(~more, F.col("v").cast("string")).alias("value"), F.when(more, F.struct("top", "depth", "v")).alias("more")))
        leaf = found.where("source is not null").select(F.col("of_").alias(key), "path", "source", "value")
        done = leaf if done is None else done.unionAll(leaf)
        at = found.where("source is null").select("of_", "path", "more.*")
        if at.isEmpty():
            return done


def _typed(at: DataFrame) -> DataFrame:
    """Adds what a value holds: ``m``, the entries of an object, or ``l``, the items of a list."""
    return at.withColumns({"m": F.try_variant_get("v", "$", "map<string,variant>"), "l": F.try_variant_get("v", "$", "array<variant>")})


def _opened(at: DataFrame) -> DataFrame:
    """What the values hold, each in its row; a value that holds nothing more stays as it is."""
    is_map, is_list = F.col("m").isNotNull(), F.col("l").isNotNull()
    places = F.when(F.size("l") > 0, F.sequence(F.lit(0), F.size("l") - 1)).otherwise(F.array().cast("array<int>"))
    kind = "array<struct<k:string,v:variant>>"
    each = F.when(is_map, F.map_entries("m").cast(kind)).when(is_list, F.arrays_zip(places.cast("array<string>"), F.col("l")).cast(kind)).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("k"), F.col("v"))).cast(kind))
    x = at.select("of_", "path", "top", "depth", is_map.alias("is_map"), is_list.alias("is_list"), F.explode(each).alias("x")).where("not is_map or x.k <> '__lines__'")
    path = F.when(F.col("is_map"), F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), "x.k")).when(F.col("is_list"), F.concat(F.col("path"), F.lit("["), F.col("x.k"), F.lit("]"))).otherwise(F.col("path"))
    # The items of a block's own list are its values; those of lists further down are nested.
    depth = F.when(~F.col("is_map") & (~F.col("is_list") | (F.col("depth") == 1)), F.col("depth")).otherwise(F.col("depth") + 1)
    return x.select("of_", path.alias("path"), F.when(F.col("is_map"), F.coalesce("top", "x.k")).otherwise(F.col("top")).alias("top"), depth.alias("depth"), F.col("x.v").alias("v"))


def _named(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"^\$\{\s*|\s*\}$", ""))


def dependencies(rows: DataFrame, key: str, body: str = "attributes") -> DataFrame:
    """``key, path, source, ref, target``: all that a block depends on, with where it says so.

    References of its values in any depth and of ``count``, ``for_each`` and ``lifecycle`` name variables, locals, modules, data and
    resources; other kinds (paths, counters, functions) are no objects. What ``depends_on`` lists is named as it stands, and
    ``provider`` names a provider.
    """
    flat = values(rows, key, body)
    plain = F.col("source").isin("depends_on", "provider")
    named = flat.where(plain).select(F.col(key), "path", "source", _named(F.col("value")).alias("ref"))
    named = named.select(key, "path", "source", "ref", F.when(F.col("source") == "provider", F.concat(F.lit("provider."), F.col("ref"))).otherwise(F.col("ref")).alias("target"))
    # Blocks say the same over and over: each different text is walked once, by a number of its own.
    texts = written(flat.where(~plain).select("value").distinct().withColumn("row_", F.monotonically_increasing_id()))
    found = inspection.walked(texts, "row_", "value").where(F.col("ref_type").isin("variable", "local", "module", "data", "resource"))
    # A resource's pattern also fits within a longer reference of the same text; that is no other object.
    found = found.select(F.col("row_").alias("r_"), "ref", "target", "position", "ref_type")
    part = found.where("ref_type <> 'resource'").select(F.col("r_").alias("o_"), F.col("position").alias("from_"), (F.col("position") + F.length("ref")).alias("to_"))
    found = found.join(part, (F.col("r_") == F.col("o_")) & (F.col("ref_type") == "resource") & (F.col("position") > F.col("from_")) & (F.col("position") < F.col("to_")), "left_anti")
    told = written(texts.join(found, F.col("row_") == F.col("r_")).select(F.col("value").alias("text_"), "ref", "target"), texts)
    # What they name has a dot, so values without one need not look for it.
    return flat.where(~plain & F.col("value").contains(".")).join(told, F.col("value") == F.col("text_")).select(F.col(key), "path", "source", "ref", "target").unionAll(named)
