"""Exact duplicates by sorting contents.

Rows are laid out by range: splitters are sampled from the first bytes of the normalised text and a hash of the whole,
so what is sampled stays small however long texts are, and equal texts fall into one range. Within a range an external sort
puts equal texts next to each other, and a group ends where a text differs from its neighbour's, compared in full.

A text with very many copies is cut into pieces, each of which is sorted and compared on its own; the pieces' results,
of which there are few, are then put together by their texts, in full again. Which texts those are is told by a sample: it
decides how even the work is, never what comes out.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, written

#: Code points of a text in a splitter.
HEAD = 32
#: Rows of the sample for each partition of a shuffle; copies of a text in it, and bytes of all its copies, that make a piece.
SAMPLED, PIECE, HELD = 64, 8, 1 << 26


def _pieces(rows: DataFrame) -> DataFrame:
    """``h_, pieces``: hashes of texts with many copies, or with several long ones; at most SAMPLED for each partition of a shuffle."""
    n, want = rows.count(), SAMPLED * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, want / max(n, 1))
    sample = rows.select("h_", F.octet_length("text_").alias("bytes"))
    counts = (sample if share == 1 else sample.sample(share, seed=13)).groupBy("h_").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    pieces = F.greatest(F.ceil(F.col("n") / PIECE), F.ceil(F.col("n") / F.lit(share) * F.col("bytes") / HELD)).cast("int")
    return written(counts.where("n > 1").select("h_", pieces.alias("pieces")).where("pieces > 1"), "copies")


def _sorted(docs: DataFrame, normalise: Callable[[Column], Column] | None, largest: bool, *carried: Column) -> DataFrame:
    """``doc_id, text_sha256, keep_id, group_size, kept`` of each row, and what is ``carried``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (normalise(text) if normalise else text).alias("text_"), *carried)
    rows = rows.withColumn("h_", F.xxhash64("text_"))
    rows = rows.join(F.broadcast(_pieces(rows)), "h_", "left").withColumn("piece_", F.when(F.col("pieces").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("pieces"))).otherwise(0).cast("int"))
    key = [F.substring("text_", 1, HEAD).alias("head_"), "h_", "piece_"]
    rows = rows.select("*", key[0]).repartitionByRange("head_", "h_", "piece_")
    # The ranges already hold a group whole, so the window sorts and compares without another exchange.
    alike = Window.partitionBy("head_", "h_", "piece_", "text_")
    first = alike.orderBy(F.col("doc_id").desc_nulls_last() if largest else F.col("doc_id").asc_nulls_last())
    rows = rows.withColumn("at_", F.row_number().over(first)).withColumn("keep_", F.first("doc_id").over(first)).withColumn("n_", F.count("*").over(alike))
    part = F.when(F.col("pieces").isNotNull() & (F.col("at_") == 1), F.col("text_")).alias("part_")
    names = [c for c in rows.columns if c not in ("text_", "head_", "pieces")]
    rows = written(rows.select(*names, F.sha2("text_", 256).alias("text_sha256"), part), "sorted")
    # One row for each piece: few, as there are few pieces.
    best = F.struct(F.col("keep_").isNotNull().alias("some"), (F.col("keep_") if largest else -F.col("keep_")).alias("rank"), F.col("piece_").alias("piece"), F.col("keep_").alias("keep"))
    whole = rows.where("part_ is not null").groupBy("part_").agg(F.max(best).alias("best"), F.sum("n_").alias("size"))
    whole = whole.select(F.sha2("part_", 256).alias("whole_"), "best", "size")
    out = rows.join(F.broadcast(whole), F.col("text_sha256") == F.col("whole_"), "left")
    kept = (F.col("at_") == 1) & (F.col("whole_").isNull() | (F.col("best.piece") == F.col("piece_")))
    return out.select(
        "doc_id", "text_sha256", F.when(F.col("whole_").isNull(), F.col("keep_")).otherwise(F.col("best.keep")).alias("keep_id"),
        F.coalesce("size", "n_").alias("group_size"), kept.alias("kept"), *[c for c in names if c.startswith("carried_")],
    )


def groups(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, largest: bool = True) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of each row of ``docs`` (``doc_id, text``, other columns are not read).

    Texts are equal if they are identical after ``normalise`` (a function of Columns; none: as they are). Null is the
    empty text; both are one group. The row with the largest ``doc_id`` stays (the smallest, unless ``largest``), a
    null id only if there is no other; ``keep_id`` is its id and may be null. Of rows that repeat both id and text
    exactly one is ``kept``, while all count in ``group_size``. An empty table gives no rows.
    """
    return _sorted(docs, normalise, largest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, largest: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called; as ``groups`` decides."""
    rows = _sorted(docs, normalise, largest, packed(docs).alias("carried_row"))
    return rows.where("kept").select("carried_row.*")
