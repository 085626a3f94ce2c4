"""Mixing sources to target weights.

The words of each source are packed into blocks of ``BLOCK`` words, one document after another; only
the last block of a source is shorter. The mix is a row of slots in output shards of ``SHARD`` slots.
Every slot draws its source by a hash, with the sources' shares as probabilities, so the counts of a
shard are multinomial. A source's slots are numbered through the shards; the number goes through a
pseudorandom permutation of the source's block indices, once around for each pass over the source, and
slots and documents meet at the block index.

What a source gives is settled by its target: as many slots as its words need, the last of them cut
short. Slots that were drawn beyond that stay empty, and what the draws fell short of is appended. So
each source's words come to its target, rounded, whatever the luck of the draw.

The permutation is swap-or-not (Hoang, Morris and Rogaway, 2012): in each round ``x`` changes places
with ``key - x`` or stays, as a hash of the greater of both says. That is a permutation of any range,
it is its own inverse with the rounds turned around, and it is an expression of SQL functions.

Words are runs of anything but ASCII white space. No source needs to fit a task: documents are
numbered within chunks of a source, and only the chunks' sums are added up along a source.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, texts, written

BLOCK, SHARD, ROUNDS = 256, 65_536, 12
#: Rows of a source in a chunk, about.
CHUNK = 512
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Cells of the unit interval in which a slot looks for its source.
CELLS = 4096

_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text: Column) -> Column:
    one = F.translate(text, _SPACE, " " * len(_SPACE))
    return F.filter(F.split(one, " +", -1), lambda w: w != "")


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.size(words_of(text)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``, one row each.

    Weights go around by code point of the source, null last. The targets are the weights' shares of
    ``SHARE`` times all sizes. One that is above ``MOST`` times its source's size stops there, and the
    rest is shared by weight, until none is above: filled in the order in which sources stop.
    The table has a row for each source, so it is ranked in one go.
    """
    code = Window.orderBy(F.col("source").isNull(), "source")
    all_ = Window.partitionBy()
    fill = Window.orderBy("ratio", F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(code) - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(MOST)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level)
    # The level of the first source that is not stopped holds for all; later ones come out lower.
    t = t.withColumn("level", F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(all_))
    return t.select("source", "source_size", "weight", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def _keys(blocks: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.struct(r.alias("r"), F.pmod(F.xxhash64(F.lit("round"), "source", r), F.greatest(blocks, F.lit(1))).alias("k")))


def _shuffled(x: Column, blocks: Column, keys: Column) -> Column:
    """``x`` of ``0 .. blocks - 1`` permuted by the rounds in ``keys``."""

    def turn(x: Column, key: Column) -> Column:
        other = F.pmod(key["k"] - x, blocks)
        return F.when(F.xxhash64(key["k"], key["r"], F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(keys, x, turn)


def plan(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds to the targets: ``blocks``; ``rounds`` whole passes; ``whole`` full slots and the words of
    the last slot (``cut``) in a pass after them; ``slots`` in all."""
    size, n = F.col("source_size"), F.col("blocks")
    s = sources.withColumn("need", F.floor(F.col("target") + 0.5)).withColumn("need", F.least(F.col("need"), (size * MOST).cast("long")))
    s = s.withColumn("blocks", F.ceil(size / block).cast("long")).withColumn("keys", _keys(n))
    s = s.withColumns({"rounds": F.when(size > 0, F.floor(F.col("need") / size)).otherwise(0).cast("long"), "rest": F.when(size > 0, F.pmod(F.col("need"), size)).otherwise(0).cast("long")})
    # Where the short last block comes in a pass: the inverse permutation of its index.
    s = s.withColumns({"short": size - (n - 1) * block, "at": F.when(n > 0, _shuffled(n - 1, n, F.reverse("keys")))})
    rest, at, short = F.col("rest"), F.col("at"), F.col("short")
    late = rest - at * block - short
    full = F.when(rest <= at * block, F.floor(rest / block)).when(late < 0, at).otherwise(at + 1 + F.floor(late / block))
    cut = F.when(rest <= at * block, F.pmod(rest, F.lit(block))).when(late < 0, rest - at * block).otherwise(F.pmod(late, F.lit(block)))
    s = s.withColumns({"whole": F.coalesce(full, F.lit(0)).cast("long"), "cut": F.coalesce(cut, F.lit(0)).cast("long")})
    s = s.withColumn("slots", F.col("rounds") * n + F.col("whole") + F.when(F.col("cut") > 0, 1).otherwise(0))
    return s.select("source", "source_size", "target", "blocks", "keys", "rounds", "whole", "cut", "slots")


def slots(planned: DataFrame, shard: int = SHARD) -> DataFrame:
    """The mix: ``shard, slot, source, number, block, words`` of each slot, ``words`` from the start
    of the block. ``planned`` is a written plan."""
    spark = planned.sparkSession
    total = planned.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    share = planned.where("slots > 0").select("source", (F.sum("slots").over(Window.orderBy(F.col("source").isNull(), "source")) - F.col("slots")).alias("low"), "slots")
    share = share.select("source", (F.col("low") / max(total, 1)).alias("low"), ((F.col("low") + F.col("slots")) / max(total, 1)).alias("high"))
    cells = share.select("source", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    drawn = spark.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard).alias("shard"), (F.pmod(F.xxhash64(F.lit("draw"), "id"), F.lit(1 << 50)) / F.lit(float(1 << 50))).alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell").where("low <= u and u < high").select("shard", "slot", "source")
    drawn = written(drawn, "slots")
    count = drawn.groupBy("source", "shard").agg(F.count("*").alias("n"))
    along = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = count.select("source", "shard", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "source").orderBy("slot")
    numbered = drawn.withColumn("k", F.row_number().over(inside) - 1)
    same = numbered["source"].eqNullSafe(first["source"]) & (numbered["shard"] == first["shard"])
    numbered = numbered.join(first, same).select(numbered["shard"], numbered["slot"], numbered["source"], (F.col("k") + F.col("first")).alias("number"))
    got = count.groupBy("source").agg(F.sum("n").alias("got"))
    short = planned.join(got, planned["source"].eqNullSafe(got["source"]), "left").where(F.col("slots") > F.coalesce("got", F.lit(0)))
    short = short.select(planned["source"], F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("slots") - 1)).alias("number"))
    short = short.select((F.lit(total) / shard).cast("long").alias("shard"), F.lit(None).cast("long").alias("slot"), "source", "number")
    every = numbered.unionAll(short)
    every = every.join(planned.select(F.col("source").alias("s_"), "blocks", "keys", "rounds", "whole", "cut", "slots"), F.col("source").eqNullSafe(F.col("s_"))).where("number < slots")
    last = F.col("number") == F.col("rounds") * F.col("blocks") + F.col("whole")
    return every.select(
        "shard", "slot", "source", "number",
        _shuffled(F.pmod("number", "blocks"), F.col("blocks"), F.col("keys")).alias("block"),
        F.when(last & (F.col("cut") > 0), F.col("cut")).otherwise(F.lit(BLOCK)).alias("words"),
    )


def placed(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, source, size, first`` of each row: its first word's number within its source; and ``keep``.

    Rows are laid out by a hash of their id, in chunks; null texts have no words.
    """
    rows = texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"), "doc_id", "source", "text")
    rows = written(rows.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"), *(c for c in keep if c != "hash")), "sizes")
    chunks = max(1, rows.count() // CHUNK)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(chunks)))
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("n"))
    along = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(F.col("source").alias("s_"), F.col("chunk").alias("c_"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "chunk").orderBy("doc_id", "hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(start, F.col("source").eqNullSafe(F.col("s_")) & (F.col("chunk") == F.col("c_")))
    return written(rows.select("doc_id", "source", "size", (F.col("start") + F.col("before")).alias("first"), *keep), "placed")


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row of ``docs``.

    Rows that repeat an id are documents of their own. A row without words is never taken; where no
    row has a word, no slot is drawn. A null source is a source, the last.
    """
    return mix_hashed(docs).drop("hash")


def mix_hashed(docs: DataFrame) -> DataFrame:
    """The same with ``hash``, that of the row's text."""
    rows = placed(docs, "hash")
    planned = written(plan(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))), "plan")
    used = slots(planned).groupBy("source", "block").agg(F.sum(F.when(F.col("words") == BLOCK, 1).otherwise(0)).alias("times"), F.max(F.when(F.col("words") < BLOCK, F.col("words"))).alias("part"))
    used = used.select(F.col("source").alias("s_"), F.col("block").alias("b_"), "times", "part")
    end = F.col("first") + F.col("size")
    parts = rows.where("size > 0").select("source", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((end - 1) / BLOCK))).alias("block"))
    parts = parts.join(used, F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_")))
    begin = F.greatest("first", F.col("block") * BLOCK)
    words = F.least(end, (F.col("block") + 1) * BLOCK) - begin
    cut = F.greatest(F.lit(0), F.least(end, F.col("block") * BLOCK + F.coalesce("part", F.lit(0))) - begin)
    taken = parts.select("source", "first", (F.col("times") * words + cut).alias("n")).groupBy("source", "first").agg(F.sum("n").alias("n"))
    taken = taken.select(F.col("source").alias("s_"), F.col("first").alias("f_"), "n")
    out = rows.join(taken, F.col("source").eqNullSafe(F.col("s_")) & (F.col("first") == F.col("f_")) & (F.col("size") > 0), "left")
    sized = planned.select(F.col("source").alias("t_"), "source_size", "target")
    out = out.join(sized, F.col("source").eqNullSafe(F.col("t_")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).cast("long").alias("taken"), "hash")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with all their columns, and ``taken_words``: how many, repeats counted.

    A row's words are found again by its id and a hash of its text, so texts are neither written nor sorted here. Rows that repeat both are
    alike: each has a number of its own, dealt by their other columns. Nulls are as in ``mix``; columns of any name keep their values (one
    called ``taken_words`` is replaced); an empty table stays empty.
    """
    names = [c for c in docs.columns if c != "taken_words"]
    hash_ = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), hash_.alias("hash"), packed(docs).alias("row"))
    mixed = written(mix_hashed(docs).select(F.col("doc_id").alias("k_"), F.col("hash").alias("h_"), "taken"), "taken")
    by = mixed.groupBy("k_", "h_").agg(F.count("*").alias("n_"), F.max("taken").alias("taken_")).where("taken_ > 0")
    same = F.col("key").eqNullSafe(F.col("k_")) & (F.col("hash") == F.col("h_"))
    out = [F.col("row")[c].alias(c) for c in names]
    once = rows.join(by.where("n_ = 1"), same).select(*out, F.col("taken_").alias("taken_words"))
    more = by.where("n_ > 1").select("k_", "h_")
    again = rows.join(more, same, "left_semi").withColumn("nth_", F.row_number().over(Window.partitionBy("key", "hash").orderBy("row")))
    dealt = mixed.where("taken > 0").join(more.select(F.col("k_").alias("key"), F.col("h_").alias("hash")), same, "left_semi")
    dealt = dealt.withColumn("m_", F.row_number().over(Window.partitionBy("k_", "h_").orderBy(F.desc("taken"))))
    return once.unionAll(again.join(dealt, same & (F.col("nth_") == F.col("m_"))).select(*out, F.col("taken").alias("taken_words")))


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix itself: ``shard, slot, source, block, text`` of each slot, words joined by spaces. What was
    appended has no slot number. A block gathers at most ``BLOCK`` words."""
    rows = placed(docs, "text")
    planned = written(plan(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))), "plan")
    end = F.col("first") + F.col("size")
    parts = rows.where("size > 0").withColumn("words", words_of(F.col("text"))).select("source", "first", "size", "words", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((end - 1) / BLOCK))).alias("block"))
    begin = F.greatest("first", F.col("block") * BLOCK)
    piece = F.slice("words", (begin - F.col("first") + 1).cast("int"), (F.least(end, (F.col("block") + 1) * BLOCK) - begin).cast("int"))
    block = parts.select("source", "block", F.struct("first", piece.alias("piece")).alias("p")).groupBy(F.col("source").alias("s_"), F.col("block").alias("b_")).agg(F.flatten(F.array_sort(F.collect_list("p"))["piece"]).alias("all_"))
    s = slots(planned)
    return s.join(block, F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_"))).select("shard", "slot", "source", "block", F.array_join(F.slice("all_", F.lit(1), F.col("words")), " ").alias("text"))
