"""Lookups and edits of a catalog: objects by key, kind, state, file, provider, and blocks by what they declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import provider_of


def get(objects: DataFrame, full_name: str) -> DataFrame:
    return objects.where(F.col("full_name") == F.lit(full_name))


def upsert(objects: DataFrame, rows: DataFrame, key: tuple[str, ...] = ("full_name",), order: str = "ord") -> DataFrame:
    """``objects`` with ``rows`` in place of those of the same key; of equal keys the last by ``order`` stays, of all
    rows before any of ``objects``. An aggregate, so a hot key is combined before the shuffle."""
    names = objects.columns
    every = objects.withColumn("new_", F.lit(0)).unionByName(rows.select(*names).withColumn("new_", F.lit(1)))
    last = every.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct("new_", order)).alias("row_"))
    return last.select(*(F.col("row_")[c].alias(c) for c in names))


def last_wins(objects: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key: the last by ``order``."""
    names = objects.columns
    last = objects.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("row_"))
    return last.select(*(F.col("row_")[c].alias(c) for c in names))


def remove(objects: DataFrame, *full_names: str) -> DataFrame:
    return objects.where(~F.col("full_name").isin(*full_names))


def by_kind(objects: DataFrame, kind: str) -> DataFrame:
    return objects.where(F.col("type") == kind)


def by_state(states: DataFrame, state: str) -> DataFrame:
    return states.where(F.col("state") == state)


def by_file(objects: DataFrame, file_path: str) -> DataFrame:
    return objects.where(F.col("file_path") == file_path)


def provider() -> Column:
    """An object's provider: the one that it names, else that of its type's prefix; null for other kinds."""
    return F.when(F.col("type").isin("resource", "data"), F.coalesce("provider", provider_of(F.col("resource_type"))))


def by_provider(objects: DataFrame, name: str) -> DataFrame:
    return objects.where(provider() == name)


def blocks(objects: DataFrame, kind: str, *labels: str) -> DataFrame:
    """Blocks of a kind by their labels: type and name of resources and data, the name of others; a provider is also
    found by its name alone when it has an alias. Without labels all of the kind."""
    found = by_kind(objects, kind)
    if kind in ("resource", "data"):
        for column, label in zip(("resource_type", "name"), labels, strict=False):
            found = found.where(F.col(column) == label)
    elif labels:
        prefix = {"variable": "var"}.get(kind, kind)
        name = F.col("full_name")
        found = found.where((name == f"{prefix}.{labels[0]}") | (F.lit(kind == "provider") & name.startswith(f"{prefix}.{labels[0]}.")))
    return found
