"""Shared pieces: the shared folder, written tables, graph components, hashing folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
#: Deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (a local session, as
    in the tests) a temporary folder of this machine is used, one for each application.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="stratagraph-")
    return _FALLBACK[app]


def written(df: DataFrame, name: str, *spent: DataFrame, packed: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; ``packed`` by another codec than the session's.

    This cuts the lineage: an executor that is lost later costs no recomputation of what went
    before, since the files survive it. Shuffle files of the write go with it, and so do ``spent``: earlier
    tables of this function that nothing but ``df`` needed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=packed)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    discard(*spent)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made; others are left alone."""
    for t in tables:
        if path := getattr(t, "folder", None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % F.lit(n)


def texts(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that other columns of any name can't clash; null text is empty."""
    return df.select(*columns).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))


def packed(df: DataFrame) -> Column:
    """All columns as one struct: beside it, an operator's own columns can't clash with any."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table ``(a, b)`` of longs, as ``(node, component)``.

    The component is named by its smallest node. Nodes without an edge don't appear; loops and
    repeated edges change nothing; no edges give no rows. Alternates the large-star and small-star
    steps of Kiveris et al. (2014): each replaces a node's edges by edges to the smallest node it
    knows, so the number of rounds is logarithmic, and no step gathers a component in a task. The
    minimum of a node's neighbours is a partial aggregate, and what joins it back is an ordinary
    equi-join that adaptive execution may split at a hub.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionAll(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = written(small.distinct(), "edges", e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
