"""Language-model scores by a probabilistic suffix tree (Ron, Singer and Tishby, 1996).

A text is a sequence of tokens: its words, then one end. The tree's contexts are the tokens before a
position, of variable length: up to ``DEPTH`` of them, the text's begin among them. A context is kept if it is frequent
enough and if its next-symbol distribution differs from that of its suffix by more than chance would
(the divergence times its count exceeds a threshold); the suffixes of kept contexts are kept. To score
a token, the longest kept suffix of what stands before it is the state. Its distribution is smoothed
by absolute discounting towards that of the next shorter suffix, down to the single tokens; there,
what discounting leaves is the probability of a token that was not learned (as a class of its own,
like the base score has one). So each state's probabilities sum to one.

All counts cover all training texts and are added up over the cluster. A context needs a count of
``FLOOR`` and a pair of context and symbol one of ``PAIR``, whatever the size of the input; beyond that
only the divergence test prunes, so the tree grows with the corpus. It is a written table of addends:
a token's log probability is that of the token by itself, plus an addend for each of its contexts in
the tree and for each of its pairs in it. Symbols, contexts and pairs go by 64-bit hashes.

Texts are split into words once: what follows reads the written hashes of their words. Counts are shuffled as blocks of
sorted keys, cut by the keys' leading digits, and added up by sorting in the tasks that get them; each
text's own counts are combined before, so a frequent key is no more than a number in each block. Most pairs
of context and symbol occur once, so before they are counted, 40 or more digits of their keys are shuffled by themselves (four
bytes each): pairs whose digits occur once are not counted.

The addends and the word counts that are looked up most are sent to the workers (a bounded number), the
others are joined by key; which is which changes no result. Nor do the bitmaps of hashes: what they let
pass wrongly is counted, or looked up, in vain.
"""

import math
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, remainder, texts, written

FREQUENT = 2.5e-7
#: Least count of a context and of a symbol; of a symbol after a context.
FLOOR, PAIR = 8, 2
#: Tokens of the longest context.
DEPTH = 3
#: Nats by which a context must predict its symbols better than its suffix; discounts of contexts and of single tokens.
GAIN, DISCOUNT, DISCOUNT0 = 12.0, 0.6, 0.2
#: Numbers of what is no word.
BEGIN, END, OTHER, FIRST = 0, 1, 2, 3
#: The symbol of a context's total.
TOTAL = -1
#: Words that a worker keeps, rows and symbols it takes at a time, rows it holds, rows that a task adds up, addends that are sent to a worker,
#: bits of a bitmap (2 to the power of); they change no result.
KEPT, ROWS, SYMBOLS, HELD, TAKEN, SENT, BITS = 250_000, 256, 200_000, 600_000, 800_000, 1_000_000, 27
#: Pieces of a bitmap (2 to the power of).
PIECES = 6
#: Rows that a worker is given at a time, in place of 10,000, which with their texts are tens of MB on either side.
BATCH, GIVEN = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


class Tree(NamedTuple):
    """``order0``: log probability by symbol, where symbols are numbered. ``contexts``: sorted keys by length,
    where they are listed. Of the entries that are sent: sorted keys and addends. ``bits``: a bitmap of all
    entries' keys. ``more``: there are entries that aren't sent."""

    order0: np.ndarray
    contexts: list[np.ndarray]
    keys: np.ndarray
    values: np.ndarray
    bits: np.ndarray
    more: bool


class Hashed(dict):
    """Symbols of words: their hashes, as ``xxhash64`` in Spark."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        x = xxhash.xxh64_intdigest(word, 42)
        x = self[word] = x - (1 << 64) if x >> 63 else x
        return x


class Listed(dict):
    """Symbols of listed words; the others are of a class."""

    def __missing__(self, word: bytes) -> int:
        return OTHER


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _grown(h: np.ndarray, older: np.ndarray) -> np.ndarray:
    """Keys of contexts with one older symbol more."""
    return h * np.uint64(0xD6E8FEB86659FD93) + _mixed(older)


def _pair(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return (context ^ (context >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + _mixed(symbol)


def _cut(key: np.ndarray, columns: list[np.ndarray], digits: int) -> pa.RecordBatch:
    """Columns that are sorted by ``key``, as a row of bytes for each value of its leading binary digits. They are of one width."""
    bounds = np.searchsorted(key, np.arange(1, 1 << digits, dtype=np.uint64) << np.uint64(64 - digits)) if digits else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], bounds, [len(key)]])
    some = np.flatnonzero(np.diff(bounds))
    offsets = pa.py_buffer((bounds[np.append(some, some[-1] + 1)] * columns[0].itemsize if len(some) else np.zeros(1)).astype(np.int32))
    blocks = [pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, pa.py_buffer(np.ascontiguousarray(c))]) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *blocks], names=["cut", *(f"c{i}" for i in range(len(columns)))])


def _uncut(batches: Iterator[pa.RecordBatch], kinds: list[type]) -> list[np.ndarray]:
    """The columns of all blocks of a task."""
    held: list[list[bytes]] = [[] for _ in kinds]
    for batch in batches:
        for i, h in enumerate(held):
            h += batch.column(f"c{i}").to_pylist()
    return [np.frombuffer(b"".join(h), kind) for h, kind in zip(held, kinds, strict=True)]


def _blocks_of(columns: int) -> str:
    return ", ".join(["cut long", *(f"c{i} binary" for i in range(columns))])


def _bits(df: DataFrame, key: str, parts: int) -> np.ndarray:
    """A bitmap of the column's values. It is put together from pieces: nobody gets more than the tasks' bits of one."""

    def of(at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(at, kind="stable")
        at, bits = at[order], bits[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        return at[first], np.bitwise_or.reduceat(bits, first) if len(at) else bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits, held = np.zeros(0, np.uint64), np.zeros(0, np.uint64), []
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITS))
            if sum(map(len, held)) > HELD:
                x, held = np.concatenate(held), []
                at, bits = of(np.concatenate([at, x >> np.uint64(6)]), np.concatenate([bits, np.uint64(1) << (x & np.uint64(63))]))
        x = np.concatenate([np.zeros(0, np.uint64), *held])
        at, bits = of(np.concatenate([at, x >> np.uint64(6)]), np.concatenate([bits, np.uint64(1) << (x & np.uint64(63))]))
        yield _cut(at << np.uint64(64 - BITS + 6), [at, bits], PIECES)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = of(*_uncut(batches, [np.uint64, np.uint64]))
        yield _cut(at << np.uint64(64 - BITS + 6), [at, bits], PIECES)

    made = df.select(key).mapInArrow(run, _blocks_of(2)).repartition(min(parts, 1 << PIECES), "cut").mapInArrow(merge, _blocks_of(2)).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    for at, bits in zip(made["c0"], made["c1"], strict=True):
        out[np.frombuffer(at.as_py(), np.int64)] = np.frombuffer(bits.as_py(), np.uint64)
    return out


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be among those of the bitmap; all that are pass."""
    size = np.uint64(len(bits).bit_length() + 5)
    x = keys.view(np.uint64) >> (np.uint64(64) - size)
    return (bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1


def _grouped(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of context, suffix, symbol and count, with the counts added up."""
    context, suffix, symbol, n = rows
    if not len(n):
        return rows
    key = _pair(context, symbol)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [context[order[first]], suffix[order[first]], symbol[order[first]], np.add.reduceat(n[order], first)]


def _coded(rows: DataFrame, number: Hashed | Listed) -> DataFrame:
    """``rows`` (``doc_id, held_out, text``) with their words' symbols as bytes in place of the text, and their number; words are lower-cased in A-Z.
    The table stays for all levels, so it is packed well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                words = pc.ascii_split_whitespace(pc.ascii_lower(part.column("text")))
                # Blanks at a text's ends leave empty words. Each different word of the rows is looked up once.
                coded, some = words.values.dictionary_encode(), pc.binary_length(words.values).to_numpy() > 0
                symbols = np.array([number[w] for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.int64)[coded.indices.to_numpy()][some]
                bounds = np.concatenate([[0], np.cumsum(some)])[words.offsets.to_numpy()]
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(bounds)), pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(bounds * 8), pa.py_buffer(symbols)])]
                columns[3] = columns[3].cast(pa.binary())
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "size", "symbols"])

    return written(rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, size long, symbols binary"), "coded", packed="zstd")


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows by pieces of some symbols; a row is in one piece."""
    held = np.cumsum(batch.column("size").to_numpy())
    a = 0
    while a < len(held):
        b = max(a + 1, int(np.searchsorted(held, (held[a - 1] if a else 0) + SYMBOLS)))
        yield batch.slice(a, b - a)
        a = b


def _parts(spark: SparkSession, n: int) -> tuple[int, int]:
    """Tasks that add up ``n`` rows, and the binary digits by which their keys are cut."""
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(n / TAKEN))
    return parts, (4 * parts - 1).bit_length()


def word_counts(coded: DataFrame, n: int) -> DataFrame:
    """``symbol, n`` over all rows of ``coded``, which have ``n`` words."""
    parts, digits = _parts(coded.sparkSession, n)

    def of(symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(symbols)
        symbols, counts = symbols[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]])) if len(symbols) else np.zeros(0, np.int64)
        return symbols[first], np.add.reduceat(counts, first) if len(symbols) else counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for piece in _pieces(batch):
                new = np.frombuffer(b"".join(piece.column("symbols").to_pylist()), np.uint64)
                symbols, counts = np.concatenate([symbols, new]), np.concatenate([counts, np.ones(len(new), np.int64)])
                if len(symbols) > HELD:
                    symbols, counts = of(symbols, counts)
                    if len(symbols) > HELD // 2:
                        yield _cut(symbols, [symbols, counts], digits)
                        symbols, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        symbols, counts = of(symbols, counts)
        yield _cut(symbols, [symbols, counts], digits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, counts = of(*_uncut(batches, [np.uint64, np.int64]))
        yield pa.RecordBatch.from_arrays([pa.array(symbols.view(np.int64)), pa.array(counts, pa.int64())], names=["symbol", "n"])

    return written(coded.select("size", "symbols").mapInArrow(run, _blocks_of(2)).repartition(parts, "cut").mapInArrow(add, "symbol long, n long"), "words")


def _sequence(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' symbols one after the other, each one's place in its text, and the texts' begins and sizes."""
    found = batch.column("symbols").to_pylist()
    size = np.array([len(x) // 8 + 2 for x in found], np.int64)
    begin = np.cumsum(size) - size
    ids, inner = np.full(int(size.sum()), BEGIN), np.ones(int(size.sum()), bool)
    end = begin + size - 1
    inner[begin] = inner[end] = False
    ids[end], ids[inner] = END, np.frombuffer(b"".join(found), np.int64)
    return ids, np.arange(len(ids)) - np.repeat(begin, size), begin, size


def _contexts(ids: np.ndarray, place: np.ndarray, depth: int, some: np.ndarray, often: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, keys and keys of the suffixes of the contexts of ``depth`` tokens that may be frequent enough.
    ``some``: which tokens may; ``often``: bitmap of the pairs of the level before that may. A context occurs
    as often as its newest token stands after its others, so it is one of those pairs."""
    at = np.flatnonzero(place >= depth)
    for k in range(1, depth + 1):
        at = at[some[at - k]]
    if depth > 1:
        before = np.zeros(len(at), np.uint64)
        for k in range(2, depth + 1):
            before = _grown(before, ids[at - k])
        at = at[_maybe(often, _pair(before, ids[at - 1]))]
    h = suffix = np.zeros(len(at), np.uint64)
    for k in range(1, depth + 1):
        suffix, h = h, _grown(h, ids[at - k])
    return at, h, suffix


def _pairs(piece: pa.RecordBatch, depth: int, words: np.ndarray, often: np.ndarray | None, twice: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of contexts of ``depth`` tokens and of their suffixes, that may be frequent enough; which of them stand before a
    symbol that may be counted after them, and the symbols."""
    ids, place, _, _ = _sequence(piece)
    some = ((ids == BEGIN) | _maybe(words, ids)) & (ids != OTHER)
    at, h, suffix = _contexts(ids, place, depth, some, often)
    symbol = ids[at]
    named = some[at] | (symbol == END)
    if depth > 1:
        named[named] = _maybe(twice, _pair(suffix[named], symbol[named]))
    return h, suffix, named, symbol


def _again(coded: DataFrame, depth: int, words: np.ndarray, often: np.ndarray | None, twice: np.ndarray | None, parts: int, digits: int) -> np.ndarray:
    """Bitmap of the pairs of contexts of ``depth`` tokens and symbols that have the count ``PAIR``, and of few others. What is
    shuffled of a pair's key are the 32 binary digits after those by which it is cut, as often as it occurs in a block, up to ``PAIR`` times."""
    digits = max(digits, 8)
    shift = np.uint64(32 - digits)
    sent = coded.sparkSession.sparkContext.broadcast((words, often, twice))

    def of(held: list[np.ndarray]) -> np.ndarray:
        x = np.sort(np.concatenate(held))
        return np.concatenate([x[:PAIR], x[PAIR:][x[PAIR:] != x[:-PAIR]]])

    def cut(x: np.ndarray) -> pa.RecordBatch:
        return _cut(x << shift, [x.astype(np.uint32)], digits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for piece in _pieces(batch):
                h, _, named, symbol = _pairs(piece, depth, *sent.value)
                held.append(_pair(h[named], symbol[named]) >> shift)
                size += len(held[-1])
                if size > HELD:
                    held = [of(held)]
                    size = len(held[0])
                    if size > HELD // 2:
                        yield cut(held[0])
                        held, size = [np.zeros(0, np.uint64)], 0
        yield cut(of(held))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)]
        for batch in batches:
            for lead, low in zip(batch.column("cut").to_pylist(), batch.column("c0").to_pylist(), strict=True):
                held.append(np.frombuffer(low, np.uint32) | np.uint64(lead << 32))
        x = np.sort(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array((x[PAIR - 1 :][x[PAIR - 1 :] == x[: len(x) - PAIR + 1]] << shift).view(np.int64))], names=["pair"])

    made = written(coded.select("size", "symbols").mapInArrow(run, _blocks_of(1)).repartition(parts, "cut").mapInArrow(add, "pair long"), "again")
    out = _bits(made, "pair", parts)
    sent.destroy()
    discard(made)
    return out


def _singles(words: DataFrame, n_texts: int) -> DataFrame:
    """``context, mass`` of the contexts of one token: it stands before another as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbol = batch.column("symbol").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_grown(np.zeros(len(symbol), np.uint64), symbol).view(np.int64)), batch.column("n")], names=["context", "mass"])

    begin = words.sparkSession.createDataFrame([(BEGIN, n_texts)], "symbol long, n long")
    rows = words.where(F.col("symbol") != END).select("symbol", "n").unionAll(begin).where(F.col("n") >= FLOOR)
    return written(rows.mapInArrow(run, "context long, mass long"), "singles")


def _level_counts(coded: DataFrame, depth: int, words: np.ndarray, often: np.ndarray | None, twice: np.ndarray | None, again: np.ndarray, parts: int, digits: int) -> DataFrame:
    """``context, suffix, symbol, n, pair, below`` for contexts of ``depth`` symbols that have the count ``FLOOR``
    (rows of the symbol ``TOTAL``; none for those of one symbol, whose counts are known), and symbols after them that have the count ``PAIR``. ``pair`` and ``below``
    are the keys of context and suffix with the symbol.

    Of the level before, ``often`` and ``twice`` are bitmaps of the pairs that have those counts: a symbol is
    counted after a context only if it may have the count after the suffix, where it stands as often at least,
    and if it is among this level's own pairs ``again`` that may have it. So what is shuffled is little more than what is kept, and nothing that counts is left out."""
    sent = coded.sparkSession.sparkContext.broadcast((words, often, twice, again))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *before, again = sent.value
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for piece in _pieces(batch):
                h, suffix, named, symbol = _pairs(piece, depth, *before)
                named[named] = _maybe(again, _pair(h[named], symbol[named]))
                total = slice(None if depth > 1 else 0)
                symbol = np.concatenate([symbol[named], np.full(len(h[total]), TOTAL)])
                held.append([np.concatenate([h[named], h[total]]), np.concatenate([suffix[named], suffix[total]]), symbol, np.ones(len(symbol), np.int64)])
                size += len(symbol)
                if size > HELD:
                    held = [_grouped([np.concatenate(c) for c in zip(*held, strict=True)])]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield of(held.pop())
                        size = 0
        if held:
            yield of(_grouped([np.concatenate(c) for c in zip(*held, strict=True)]))

    def of(rows: list[np.ndarray]) -> pa.RecordBatch:
        return _cut(_pair(rows[0], rows[2]), rows, digits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _grouped(_uncut(batches, [np.uint64, np.uint64, np.int64, np.int64]))
        kept = rows[3] >= np.where(rows[2] == TOTAL, FLOOR, PAIR)
        context, suffix, symbol, n = (c[kept] for c in rows)
        columns = context, suffix, symbol, n, _pair(context, symbol), _pair(suffix, symbol)
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["context", "suffix", "symbol", "n", "pair", "below"])

    found = coded.select("size", "symbols").mapInArrow(run, _blocks_of(4)).repartition(parts, "cut")
    level = written(found.mapInArrow(add, "context long, suffix long, symbol long, n long, pair long, below long"), "level")
    sent.destroy()
    return level


def _entries(coded: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """``depth, key, n, value, context``: the tree's entries, of contexts and (``context`` false) of pairs, with
    their counts and addends. ``words``: ``symbol, n, p0`` of the symbols; ``n``: tokens in all."""
    parts, digits = _parts(coded.sparkSession, n)
    bits, often, twice = _bits(words.where(F.col("n") >= FLOOR), "symbol", parts), None, None
    below = words.where(F.col("n") >= FLOOR).select(F.col("symbol").alias("below_"), F.col("p0").alias("lower"))
    made = []
    for k in range(1, DEPTH + 1):
        again = _again(coded, k, bits, often, twice, parts, digits)
        level = _level_counts(coded, k, bits, often, twice, again, parts, digits)
        if k < DEPTH:
            named = level.where(F.col("symbol") != TOTAL)
            often, twice = _bits(named.where(F.col("n") >= FLOOR), "pair", parts), _bits(named, "pair", parts)
        if k == 1:
            singles = _singles(words, coded.count())
            totals = singles.select("context", F.lit(0).cast("long").alias("suffix"), "mass")
        else:
            totals = level.where(F.col("symbol") == TOTAL).select("context", "suffix", F.col("n").alias("mass"))
        # Whatever follows a context is counted after its suffix too, at least as often.
        key = "symbol" if k == 1 else "below"
        found = level.where(F.col("symbol") != TOTAL).join(below, F.col(key) == F.col("below_")).select("context", "pair", "n", "lower")
        found = found.join(totals.select("context", "mass"), "context").select("*", ((F.col("n") - DISCOUNT) / F.col("mass")).alias("own"))
        found = written(found, "pairs")
        mid = found
        sums = found.groupBy("context").agg(F.sum("own").alias("own_"), F.sum("n").alias("n_"))
        left = F.greatest(F.lit(1.0) - F.coalesce("own_", F.lit(0.0)), F.lit(1e-12))
        contexts = written(totals.join(sums, "context", "left").select("context", "suffix", "mass", left.alias("left"), F.greatest(F.col("mass") - F.coalesce("n_", F.lit(0)), F.lit(0)).alias("rest")), "contexts")
        found = found.join(contexts.select("context", "left"), "context").select("context", "pair", "n", "lower", "left", (F.col("own") + F.col("left") * F.col("lower")).alias("p"))
        found = written(found, "pairs", mid)
        # Divergence from the suffix times the count; symbols too rare to be listed count as one.
        gains = found.groupBy("context").agg(F.sum(F.col("n") * F.ln(F.col("p") / F.col("lower"))).alias("gain"))
        contexts = contexts.join(gains, "context", "left").withColumn("good", F.coalesce("gain", F.lit(0.0)) + F.col("rest") * F.ln("left") >= GAIN)
        made.append((written(contexts.select("context", "suffix", "mass", "left", "good"), "contexts", level), found))
        below = found.select(F.col("pair").alias("below_"), F.col("p").alias("lower"))
    discard(singles)
    out, needed = None, None
    for k in range(DEPTH, 0, -1):
        contexts, found = made[k - 1]
        good = contexts.where("good").select("context", "suffix", "mass", "left")
        if needed is not None:
            good = written(good.unionAll(contexts.where("not good").select("context", "suffix", "mass", "left").join(needed, F.col("context") == F.col("needed"), "left_semi")), "kept")
        needed = good.select(F.col("suffix").alias("needed")).distinct()
        own = good.select(F.lit(k).alias("depth"), F.col("context").alias("key"), F.col("mass").alias("n"), F.log10("left").alias("value"), F.lit(True).alias("context"))
        theirs = found.join(good.select("context"), "context", "left_semi").select(F.lit(k).alias("depth"), F.col("pair").alias("key"), "n", (F.log10("p") - F.log10("left") - F.log10("lower")).alias("value"), F.lit(False).alias("context"))
        part = own.unionAll(theirs)
        out = part if out is None else out.unionAll(part)
    return written(out, "tree", *(t for pair in made for t in pair))


def _sent(entries: DataFrame, most: int, parts: int) -> tuple[Tree, DataFrame | None]:
    """What the workers get, and the entries that they don't. The most frequent ones are sent."""
    counts = entries.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).toPandas()
    fit = counts.k.cumsum() <= most
    more = not bool(fit.all())
    least = 0 if not more else int(counts.n[fit].min()) if fit.any() else 1 << 62
    got = entries.where(F.col("n") >= least).select("key", "value").toArrow()
    keys = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    tree = Tree(np.zeros(0), [], keys[order], got["value"].to_numpy()[order], _bits(entries, "key", parts), more)
    return tree, entries.where(F.col("n") < least) if more else None


def _words(spark: SparkSession, rows: DataFrame, n_texts: int, n: int) -> DataFrame:
    """``symbol, n, p0`` of the symbols of ``rows`` (``symbol, n``) and of the text ends."""
    ends = spark.createDataFrame([(END, n_texts)], "symbol long, n long")
    p0: Column = (F.col("n") - F.lit(DISCOUNT0)) / F.lit(float(max(n, 1)))
    # The ends are a symbol whatever their number, as a text has one; at least ``FLOOR`` lets them pass.
    return rows.select("symbol", "n", p0.alias("p0")).unionAll(ends.where("n > 0").select("symbol", F.greatest("n", F.lit(FLOOR)).alias("n"), p0.alias("p0")))


def grow(docs: DataFrame, symbols: list[tuple[bytes, int]], n_texts: int, n: int, types: int) -> Tree:
    """The whole tree of ``docs``: of the words in ``symbols`` with their counts, and the text ends, out of
    ``n`` tokens of ``types`` kinds in all."""
    spark = docs.sparkSession
    number = Listed({w: i for i, (w, _) in enumerate(symbols, FIRST)})
    p0 = np.full(FIRST + len(symbols), 1e-300)
    p0[FIRST:] = [(c - DISCOUNT0) / n for _, c in symbols]
    p0[OTHER] = unseen(n, types)
    if n_texts:
        p0[END] = (n_texts - DISCOUNT0) / n
    rows = spark.createDataFrame([(i, c) for i, (_, c) in enumerate(symbols, FIRST)], "symbol long, n long")
    coded = _coded(docs.select("doc_id", F.lit(False).alias("held_out"), "text"), number)
    entries = _entries(coded, _words(spark, rows, n_texts, n), n)
    listed = entries.where("context").select("depth", "key").toPandas()
    contexts = [np.sort(listed["key"][listed.depth == k].to_numpy(np.int64).view(np.uint64)) for k in range(1, DEPTH + 1)]
    return _sent(entries, 1 << 62, _parts(spark, n)[0])[0]._replace(order0=np.log10(p0), contexts=contexts)


def unseen(n: int, types: int) -> float:
    """Probability of the class of tokens that were not learned."""
    return DISCOUNT0 * types / n if n else 1.0


def _added(tree: Tree, keys: np.ndarray, at: np.ndarray, log: np.ndarray, asked: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Adds the addends of the keys at their places; which keys may be in the tree. Those that may be among
    the entries that weren't sent go to ``asked`` with their places."""
    there = _maybe(tree.bits, keys)
    k, a = keys[there], at[there]
    if len(tree.keys):
        # Keys are looked up in their order, in which they lie near each other.
        order, i = np.argsort(k), np.empty(len(k), np.int64)
        i[order] = np.minimum(np.searchsorted(tree.keys, k[order]), len(tree.keys) - 1)
        hit = tree.keys[i] == k
    else:
        i, hit = np.zeros(len(k), np.int64), np.zeros(len(k), bool)
    log[a[hit]] += tree.values[i[hit]]
    if tree.more:
        asked.append((a[~hit], k[~hit]))
    else:
        there[there] = hit
    return there


def token_logs(tree: Tree, ids: np.ndarray, place: np.ndarray, single: np.ndarray, asked: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """log10 probability of each token from its state. ``single``: that of each token by itself,
    or 0 for those that are looked up elsewhere: of those the result has what the states add.
    ``asked`` gets places and keys of what is to be looked up in the entries that weren't sent."""
    log = single.copy()
    asked = [] if asked is None else asked
    at = np.flatnonzero(place > 0)
    h = np.zeros(len(at), np.uint64)
    for k in range(1, DEPTH + 1):
        keep = place[at] >= k
        keep[keep] = ids[at[keep] - k] != OTHER
        at = at[keep]
        h = _grown(h[keep], ids[at - k])
        # The suffixes of a context in the tree are in it, and its pairs are its suffix's too.
        there = _added(tree, h, at, log, asked)
        at, h = at[there], h[there]
        named = ids[at] != OTHER
        _added(tree, _pair(h[named], ids[at[named]]), at[named], log, asked)
    return log


SCHEMA = "row_ long, doc_id long, held_out boolean, n_tokens long, n_often long, base_often double, score_often double, rare array<struct<key:long,n:long>>, asked array<struct<key:long,n:long>>"


def score(docs: DataFrame, mod: int = 7, held: int = 2) -> DataFrame:
    """``_score`` with workers that are given fewer rows at a time; all that they do is done when it returns."""
    spark = docs.sparkSession
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, GIVEN)
    try:
        return _score(docs, mod, held)
    finally:
        spark.conf.set(BATCH, before)


def _score(docs: DataFrame, mod: int, held: int) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    Rows whose id's crc32 modulo ``mod`` is ``held`` are held out; the others are learned from. A
    null text is empty: one token, its end. Texts and words of any length count whole. Repeated
    rows are learned from and scored each. With nothing to learn from, every token is of the class
    of unseen ones, whose probability is then 1.
    """
    spark = docs.sparkSession
    rows = texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text").withColumn("held_out", remainder("doc_id", mod) == held)
    coded = _coded(rows, Hashed())
    train = coded.where(~F.col("held_out"))
    n, n_texts = train.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    counts = word_counts(train, n)
    n, types = n + n_texts, counts.count() + (n_texts > 0)
    often = max(2, math.ceil(FREQUENT * n))
    got = counts.where(F.col("n") >= often).toArrow()
    frequent = got["symbol"].to_numpy(), got["n"].to_numpy()
    frequent = tuple(c[np.argsort(frequent[0])] for c in frequent)
    words = _words(spark, counts.where(F.col("n") >= FLOOR), n_texts, n)
    tree, more = _sent(_entries(train, words, n), SENT, _parts(spark, n)[0])
    sent = spark.sparkContext.broadcast((tuple(tree), frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, frequent = sent.value
        for batch in batches:
            for piece in _pieces(batch):
                yield _scored(piece, frequent, Tree(*tree), n_texts, n, types)

    found = coded.withColumn("row_", F.monotonically_increasing_id()).mapInArrow(run, SCHEMA)
    found = written(found, "scored", coded)
    few = counts.where(F.col("n") < often).select(F.col("symbol").alias("key"), F.col("n").alias("c"))
    rare = found.select("row_", F.explode("rare").alias("r")).select("row_", "r.key", "r.n").join(few, "key", "left")
    seen = F.col("c").isNotNull()
    rare = rare.groupBy("row_").agg(
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + types + 1)))).alias("base_rare"),
        F.sum(F.col("n") * F.log10(F.when(seen, (F.col("c") - F.lit(DISCOUNT0)) / F.lit(float(max(n, 1)))).otherwise(F.lit(unseen(n, types))))).alias("score_rare"),
        F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("n_rare"),
    )
    added = F.lit(0.0)
    if more is not None:
        asked = found.select("row_", F.explode("asked").alias("a")).select("row_", F.col("a.key").alias("key"), F.col("a.n").alias("n"))
        asked = asked.join(more.select("key", "value"), "key").groupBy("row_").agg(F.sum(F.col("n") * F.col("value")).alias("added"))
        found, added = found.join(asked, "row_", "left"), F.coalesce("added", F.lit(0.0))
    return found.join(rare, "row_", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_often") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_often") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"),
        (F.col("score_often") + F.coalesce("score_rare", F.lit(0.0)) + added).alias("score"),
    )


def _scored(batch: pa.RecordBatch, frequent: tuple[np.ndarray, np.ndarray], tree: Tree, n_texts: int, n: int, types: int) -> pa.RecordBatch:
    ids, place, begin, size = _sequence(batch)
    different, which = np.unique(ids, return_inverse=True)
    known = np.zeros(len(different), np.int64)
    if len(frequent[0]):
        i = np.minimum(np.searchsorted(frequent[0], different), len(frequent[0]) - 1)
        known = np.where(frequent[0][i] == different, frequent[1][i], 0)
    count = known[which]
    end = begin + size - 1
    count[begin], count[end] = 0, n_texts
    often = count > 0
    single, base = np.zeros(len(ids)), np.zeros(len(ids))
    single[often] = np.log10((count[often] - DISCOUNT0) / n)
    base[often] = np.log10((count[often] + 1) / (n + types + 1))
    if not n_texts:
        base[end], single[end] = np.log10(1 / (n + types + 1)), np.log10(unseen(n, types))
    asked: list[tuple[np.ndarray, np.ndarray]] = []
    log = token_logs(tree, ids, place, single, asked)
    log[begin] = 0
    sums = lambda x: np.add.reduceat(x, begin) if len(ids) else np.zeros(0)
    row = np.repeat(np.arange(len(size)), size)
    rest = ~often
    rest[begin] = rest[end] = False
    rest = np.flatnonzero(rest)
    columns = [
        batch.column("row_"),
        batch.column("doc_id"),
        batch.column("held_out"),
        pa.array(size - 1, pa.int64()),
        pa.array(sums(often.astype(np.int64)), pa.int64()),
        pa.array(sums(base), pa.float64()),
        pa.array(sums(log), pa.float64()),
        _asked([(rest, ids[rest])], row, len(size)),
        _asked(asked, row, len(size)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["row_", "doc_id", "held_out", "n_tokens", "n_often", "base_often", "score_often", "rare", "asked"])


def _asked(asked: list[tuple[np.ndarray, np.ndarray]], row: np.ndarray, rows: int) -> pa.ListArray:
    """Keys and their numbers by row; ``row`` is that of each place."""
    at = row[np.concatenate([a for a, _ in asked])] if asked else np.zeros(0, np.int64)
    keys = np.concatenate([k for _, k in asked]).view(np.int64) if asked else np.zeros(0, np.int64)
    order = np.lexsort((keys, at))
    at, keys = at[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (keys[1:] != keys[:-1])])) if len(at) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(at)))
    offsets = np.searchsorted(at[new], np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(keys[new]), pa.array(n, pa.int64())], names=["key", "n"]))
