"""Importance resampling towards a target distribution over hashed n-grams (after Xie et al., 2023).

The features of all documents and of the target are counted by their strings, so each distinct string is hashed once, in a
dictionary; its buckets' counts give every bucket's gain. A document's weight is the sum of its features' gains, and what
comes back to the documents' own counts is the dictionary: strings that make up a fixed share of all features, of which
there are few by that share, are sent to every task and added up as the texts are read; the others are counted for each
document and joined by string, which no hot string can unbalance any more.

The draw takes the highest of weight plus Gumbel noise, a hash of the id, which draws in proportion to the weights without
replacement. Places are numbered by ranges: each range's size is added up, no task sees more than one of them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A string of up to LENGTH bytes that is one of SHARE features is sent to every task, a longer one if it is so many times as
#: often as it is longer: by that rule they are SHARE strings at most, of 2 * SHARE * LENGTH bytes (16 MB) in all.
SHARE, LENGTH = 1 << 20, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z alone) words of a text; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def features(w: Column, n: int) -> Column:
    """All runs of 1 to ``n`` words, joined by a space, repeats included."""

    def runs(v: Column, k: int) -> Column:
        starts = F.when(F.size(v) >= k, F.sequence(F.lit(1), F.size(v) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(v, i, k), " "))

    # The words are bound to a name, so they are made once and not for each run.
    return w if n == 1 else F.flatten(F.transform(F.array(w), lambda v: F.concat(v, *(runs(v, k) for k in range(2, n + 1)))))


def dictionary(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000) -> DataFrame:
    """``feature, docs_count, target_count, bucket`` of each distinct feature of ``docs`` and ``target`` (both ``text``)."""
    of = lambda d, a, b: d.select(F.explode(features(words(F.col("text")), n)).alias("feature"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    counts = of(docs, 1, 0).unionAll(of(target, 0, 1)).groupBy("feature").agg(F.sum("a").alias("docs_count"), F.sum("b").alias("target_count"))
    return written(counts.withColumn("bucket", (F.crc32(F.encode("feature", "utf-8")) % buckets).cast("int")), "dictionary")


def gains(entries: DataFrame, buckets: int = 10_000) -> DataFrame:
    """``bucket, gain`` of the buckets that a dictionary's entries are in: at most ``buckets`` rows. A gain is the
    logarithm of the target's smoothed share over the documents', in thousandths, rounded down."""
    by = entries.groupBy("bucket").agg(F.sum("docs_count").alias("s"), F.sum("target_count").alias("t"))
    whole = entries.agg(F.coalesce(F.sum("docs_count"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("target_count"), F.lit(0)).alias("all_t"))
    real = lambda c, more: (F.col(c) + more).cast("double")
    ratio = real("t", 1) * real("all_s", buckets) / (real("s", 1) * real("all_t", buckets))
    return by.crossJoin(F.broadcast(whole)).select("bucket", F.floor(F.log(ratio) * 1000.0).alias("gain"))  # `whole` is one row


def weights(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000) -> DataFrame:
    """``row, doc_id, n_words, n_features, weight`` of each row of ``docs``; ``row`` numbers them without order."""
    entries = dictionary(docs, target, n, buckets)
    valued = written(entries.join(F.broadcast(gains(entries, buckets)), "bucket").select("feature", "docs_count", "gain"), "gains")
    whole = valued.agg(F.coalesce(F.sum("docs_count"), F.lit(0))).first()[0]
    often = valued.where(F.col("docs_count") * (1.0 * SHARE * LENGTH) >= F.greatest(F.lit(LENGTH), F.octet_length("feature")) * F.lit(float(whole)))
    w = words(F.col("text"))
    # A row for each feature, and one for the document itself, which alone carries its id.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), w.alias("w")).select("row", "doc_id", F.size("w").alias("n_words"), F.explode(F.concat(features(F.col("w"), n), F.array(F.lit(None).cast("string")))).alias("feature"))
    rows = rows.join(F.broadcast(often.select("feature", "gain")), "feature", "left").withColumn("seldom", F.when(F.col("gain").isNull(), F.col("feature")))
    own = F.col("seldom").isNull()
    parts = rows.select("row", "seldom", F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("n_words")).alias("n_words"), "feature", "gain")
    parts = written(parts.groupBy("row", "seldom", "doc_id", "n_words").agg(F.count("feature").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain")), "features")
    joined = parts.where("seldom is not null").select("row", "n", "seldom").join(valued.select("feature", F.col("gain").alias("each")), F.col("seldom") == F.col("feature"))
    every = parts.where("seldom is null").select("row", "doc_id", "n_words", "n", "gain").unionAll(joined.select("row", F.lit(None), F.lit(None), "n", (F.col("n") * F.col("each")).alias("gain")))
    return every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("n").alias("n_features"), F.sum("gain").alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the seed and the id (null: no text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each row of ``docs`` (``doc_id, text``, others aren't read).

    Of the N rows with ``least_words`` words, the floor(percent * N / 100) with the highest scores are drawn and ranked from
    1, ties by smaller ``doc_id`` (null last); all others have a null rank. Null and empty texts have no features and
    weight 0, in ``target`` too. Rows that repeat an id are rows of their own, with the same noise. Empty tables are
    allowed: without a target all of it counts as unseen, without documents there are no rows.
    """
    rows = weights(docs, target, n, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("fit", F.col("n_words") >= least_words)
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    # A sorted range's rows are numbered as they come: partition times 2^33, plus the place in it.
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "scores")
    placed = placed.withColumn("range_", F.shiftright("at", 33))
    sizes = sorted(placed.groupBy("range_").agg(F.count("*"), F.count_if("fit")).collect())  # a row for each range
    draw, before, firsts = percent * sum(s[2] for s in sizes) // 100, 0, []
    for r, size, _ in sizes:
        firsts.append((r, before))
        before += size
    first = docs.sparkSession.createDataFrame(firsts, "range_ long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(first), "range_").select("doc_id", "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))
