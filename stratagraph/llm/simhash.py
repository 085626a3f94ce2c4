"""SimHash near-duplicates, found through tables of distances to reference fingerprints.

The fingerprint of a text has 64 bits; two texts are linked where at most two bits differ. By the
triangle inequality, the distances of two linked fingerprints to any reference differ by at most
two. The references are a base, the base with one bit inverted, for each of the 64 bits, and some random
ones. A coordinate less the base's is one more or one less as that bit agrees with the base, so equal
coordinates are equal bits: of four groups of sixteen coordinates, linked fingerprints are equal in two or more.
Each pair of groups is a join key. What shares a key is compared in the further coordinates (base and random
references), discarded where any differs by more than two, and the rest is verified bit by bit.

A key that many different fingerprints share takes more coordinates: those that it leaves open form four
groups again, of which linked fingerprints are equal in two or more, and so on. Three times finer, a key leaves
four coordinates open, so that sixteen fingerprints can share it at most: whatever the input, no key is
crowded, and no link is lost.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import components, packed, texts, written

SEED = 42
BASE = 0x5BD1E9955BD1E995
GROUPS, LEVELS = 4, 4
#: Random references for the last comparison of coordinates.
EXTRA = tuple(int.from_bytes(xxhash.xxh64_digest(f"reference {i}")) for i in range(6))
#: Different fingerprints in a key from which on it takes more coordinates.
PAIRWISE = 64

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, n: int = 3) -> int:
    """Of UTF-8 bytes, as unsigned: a bit is set if over half the shingles' XXH64 have it."""
    words = text.lower().split()  # of bytes, both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED) for i, j in zip(start[: 1 - n].tolist(), end[n - 1 :].tolist(), strict=True)]
    by_byte = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        counts = np.bincount(by_byte[:, k], minlength=256) @ _BITS
        out |= int(np.packbits(counts * 2 > len(hashes), bitorder="little")[0]) << 8 * k
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_signed(fingerprint(t)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of each row of ``docs``; ``fp`` is a signed long. Null or blank text: zero."""
    rows = texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text")
    return rows.mapInArrow(_batches, "doc_id long, fp long")


def _distance(reference: int, fp: str = "fp") -> Column:
    return F.bit_count(F.col(fp).bitwiseXOR(F.lit(_signed(reference))))


def pivot_table(fps: DataFrame) -> DataFrame:
    """Distances of each ``fp`` to every reference: ``fp, base``, ``near`` (those to the base with one bit
    inverted, in order of the bits), ``e0, e1, ...`` (those to the random ones)."""
    near = F.array(*(_distance(BASE ^ 1 << i) for i in range(64)))
    return fps.select("fp", _distance(BASE).alias("base"), near.alias("near"), *(_distance(p).alias(f"e{i}") for i, p in enumerate(EXTRA)))


def _code() -> Column:
    """The 64 coordinates that tell a bit each, as one number."""
    bits = F.array(*(F.lit(_signed(1 << i)).cast("long") for i in range(64)))
    at = F.zip_with("near", bits, lambda d, bit: F.when(d > F.col("base"), bit).otherwise(F.lit(0).cast("long")))
    return F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _finer(open_: tuple[int, ...]) -> list[tuple[int, tuple[int, ...]]]:
    """Of the coordinates that a key leaves open, those that each finer key takes (as a mask), and leaves."""
    size = len(open_) // GROUPS
    groups = [open_[g * size : (g + 1) * size] for g in range(GROUPS)]
    out = []
    for pair in combinations(range(GROUPS), 2):
        left = tuple(i for g in range(GROUPS) if g not in pair for i in groups[g])
        out.append((sum(1 << i for g in pair for i in groups[g]), left))
    return out


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between different fingerprints of ``fps`` (one row each): all pairs at two
    differing bits or fewer."""
    spark = fps.sparkSession
    near = ["base", *(f"e{i}" for i in range(len(EXTRA)))]
    key = ["mask", "code"]
    table = written(pivot_table(fps).select("fp", *near, _code().alias("all")), "pivots")
    open_ = {0: tuple(range(64))}
    many = table.withColumn("above", F.lit(0).cast("long"))
    pairs = None
    for level in range(LEVELS):
        # A row for each kind of key of the level: 6 to the power of its number at most.
        below = [(_signed(m), _signed(m | finer), left) for m, kept in open_.items() for finer, left in _finer(kept)]
        open_ = {mask % (1 << 64): left for _, mask, left in below}
        masks = spark.createDataFrame([(a, m) for a, m, _ in below], "above long, mask long")
        # All rows of the first level take each of its masks; a join by a constant would be planned as a product.
        masked = many.join(masks, "above") if level else many.withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for _, m, _ in below))))
        keyed = masked.select("fp", *near, "all", "mask", F.col("all").bitwiseAND(F.col("mask")).alias("code"))
        keyed = written(keyed.distinct(), "keys") if level else written(keyed, "keys")
        size = keyed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
        shared = written(keyed.join(size, key), "candidates", keyed)
        crowded = F.col("n") > PAIRWISE if level + 1 < LEVELS else F.lit(False)
        few = shared.where(~crowded)
        other = few.select(*key, *(F.col(c).alias(f"{c}_") for c in ("fp", *near)))
        close = F.lit(True)
        for c in near:
            close = close & (F.abs(F.col(c) - F.col(f"{c}_")) <= 2)
        found = few.join(other, key).where((F.col("fp") < F.col("fp_")) & close & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_"))) <= 2))
        found = found.select(F.col("fp").alias("a"), F.col("fp_").alias("b"))
        pairs = found if pairs is None else pairs.unionAll(found)
        many = shared.where(crowded).select("fp", *near, "all", F.col("mask").alias("above"))
        if many.isEmpty():
            break
    return pairs.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fp, root, component_id``.

    ``root`` names the component of fingerprints, ``component_id`` is the smallest ``doc_id`` in it
    (null only if all are null). Rows that repeat a ``doc_id`` are rows of their own: their texts
    decide. Null and blank texts have fingerprint zero and are linked like any other. Exact copies
    are one fingerprint, so they are never paired; an empty table gives no rows.
    """
    rows = written(fingerprints(docs), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    found = components(links(fps.select("fp")))
    rooted = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    rooted = written(rooted, "roots")
    low = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(low, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the smallest ``doc_id``, then the smallest text.

    Null and blank texts are one component; rows without an id are kept only where their whole component
    has none. An id that occurs once needs no look at the text; only the few rows that share the kept id
    (or have none) are ranked, by all their columns. Columns of any name keep their values; an empty table
    stays empty.
    """
    names = docs.columns
    found = written(near_duplicates(docs), "near-duplicates")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    same = kept.groupBy("doc_id").agg(F.count("*").alias("same"))
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), packed(docs).alias("row"))
    whole = [F.col("row")[c].alias(c) for c in names]
    once = rows.join(same.where("same = 1 and doc_id is not null").select(F.col("doc_id").alias("key")), "key", "left_semi").select(*whole)
    tied = same.where("same > 1 or doc_id is null").select(F.col("doc_id").alias("tie"))
    tied = rows.join(tied, F.col("key").eqNullSafe(F.col("tie")), "left_semi").withColumn("fp", _fp_of(F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))))
    tied = tied.join(kept.select("fp", "root").distinct(), "fp")
    first = F.struct(F.col("row")["doc_id"].alias("doc_id"), F.col("row")["text"].alias("text"), "row")
    one = tied.groupBy("root").agg(F.min(first)["row"].alias("row")).select(*whole)
    return once.unionAll(one)


@F.pandas_udf(LongType())
def _fp_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _signed(fingerprint(t.encode())))
