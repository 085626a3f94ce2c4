"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words of the documents. Their TF-IDF vectors, over the terms of the benchmark,
are projected onto the leading right singular vectors of all passages and items, and each passage is
compared with every benchmark item by cosine in that space. Candidates are verified on the words
themselves: the longest common subsequence of the item and the text around the passage must hold
most of the item, and the item's end (its answer) must be among what is held, so paraphrases with words
replaced, dropped or put in between are found, and passages on the same subject are not. What holds as much
of an item in one piece, word for word, is no paraphrase and needs no answer.

The singular vectors are those of a randomised SVD: with the matrix A of passages by terms and a fixed
random test matrix W, Y = A'(A W) is added up by term, and the eigenvectors of A'A follow from
Y and W (Nystroem, as in Halko, Martinsson and Tropp, 2011). It is fitted on the passages of all documents, each word of which is in
one, and on all items of the block, which weigh as much together; nothing is sampled for it. The documents' part of Y is added up in whole
numbers, in the pass that counts document frequencies: W is weighted by the terms' frequencies among the items there, which are known before
it, and put right afterwards. So sums don't depend on their order. Every passage of every document is projected and compared.

Items are taken in blocks of a bounded number of words, each with a model of its own, so what is collected
and sent to the workers is bounded too: one block holds a benchmark of ``ITEM_WORDS`` words. Documents aren't
shuffled, and no pair of them is made.
"""

import pickle
import uuid
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

RANK, OVERSAMPLE = 64, 32
#: Words of a passage that the model is fitted on; passages that are added up at a time; what whole numbers stand for 1 in the test matrix and
#: in the weight of a passage with one term.
PASSAGE, PASSAGES, UNIT, WEIGHT = 32, 128, 8, 1 << 12
#: Words of a stretch that is looked at before its windows are.
STRETCH = 64
#: Words of the items in a block, about.
ITEM_WORDS = 500_000
#: Cosine of a candidate; share of an item's weight (IDF), and of its last words' weight, in the common
#: subsequence.
COSINE, HELD, ANSWER = 0.25, 0.6, 0.5
#: How far a candidate must reach along an item's direction, of the item's own length; IDF of a rare term.
COVER, RARE = 0.4, 3.0
#: Share of the item's words that ends it.
TAIL = 0.25
ROWS, KEPT, WORDS = 256, 500_000, 1 << 15
#: Items with windows of up to so many words share a row of texts; longer ones have rows of their own, by length.
SHARED = 512
#: Numbers of a block in which a common subsequence is traced back; one of a very long item takes the root of its length in rows.
HELD_NUMBERS = 1 << 22

_STRIP = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""


def words_of(text: bytes) -> list[bytes]:
    """In lower case (A-Z), without punctuation around them."""
    return [w for w in (x.strip(_STRIP) for x in text.lower().split()) if w]


class Model(NamedTuple):
    terms: dict[bytes, int]
    idf: np.ndarray
    #: Terms by dimensions; items by dimensions, of length one; each item's term numbers in order.
    basis: np.ndarray
    items: np.ndarray
    ids: list[int]
    words: list[list[int]]


class _Numbers(dict):
    """Term numbers of raw words, kept as they come; -1 for words that no item has."""

    def __init__(self, terms: dict[bytes, int]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.terms.get(word.strip(_STRIP), -1)
        return n

    def of(self, text: bytes) -> np.ndarray:
        """Of a text's words; those of punctuation alone are words that no item has."""
        if len(self) > KEPT:
            self.clear()
        return np.array([self[w] for w in text.lower().split()], np.int64)


def _span(n: int) -> int:
    """Items are compared with windows half as long again as the power of two from their length on:
    half that power apart, one of them holds the whole of a passage."""
    return 1 << max(4, (n - 1).bit_length())


def _starts(n: int, span: int) -> np.ndarray:
    return np.arange(0, max(1, n - span + 1 + span // 2), span // 2)


def item_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items with a text, in blocks by a hash of all that an item is."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # Words are apart by one character at least.
    n = items.agg(F.coalesce(F.sum((F.length("text") + 1) / 2), F.lit(0.0))).first()[0]
    blocks = max(1, int(-(-n // (3 * ITEM_WORDS))))
    at = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [items.where(at == k) for k in range(blocks)]


def fit(docs: DataFrame, items: DataFrame) -> Model | None:
    """The model of a block's non-blank items over ``docs``; None if there are none."""
    got = [(r.item_id, words_of(r.text.encode())) for r in items.collect()]
    got = sorted(((i, w) for i, w in got if w), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    if not got:
        return None
    terms = {w: k for k, w in enumerate(sorted({w for _, ws in got for w in ws}))}
    words = [[terms[w] for w in ws] for _, ws in got]
    n_terms = len(terms)

    # Of a term that few items have, the test matrix has greater numbers, as of one that few documents have.
    width = min(RANK + OVERSAMPLE, n_terms)
    among = np.bincount(np.concatenate([np.unique(w) for w in words]), minlength=n_terms)
    weight = np.maximum(1, np.rint(UNIT * np.log((len(words) + 1) / (among + 1))))
    test = (np.where(np.random.default_rng(20110).random((n_terms, width)) < 0.5, -1, 1) * weight[:, None]).astype(np.int32)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, y, n, number = np.zeros(n_terms, np.int64), np.zeros((n_terms, width), np.int64), 0, _Numbers(terms)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                found = [number.of(text) for text in batch.column("text").slice(a, ROWS).cast(pa.binary()).to_pylist()]
                for ids in found:
                    ids = np.unique(ids)
                    df[ids[ids >= 0]] += 1
                n += len(found)
                _add(found, test, y)
        at = np.flatnonzero(df)
        for a in range(0, len(at), 1024):
            k = at[a : a + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(df[k], pa.int64()), pa.array([row.tobytes() for row in y[k]], pa.binary())], names=["term", "n", "y"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([n], pa.int64()), pa.array([b""], pa.binary())], names=["term", "n", "y"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for k, c, row in zip(*(batch.column(c).to_pylist() for c in ("term", "n", "y")), strict=True):
                row = np.frombuffer(row, np.int64)
                held[k] = (held[k][0] + c, held[k][1] + row) if k in held else (c, row)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([c for c, _ in held.values()], pa.int64()), pa.array([row.tobytes() for _, row in held.values()], pa.binary())], names=["term", "n", "y"])

    schema = "term long, n long, y binary"
    got_ = {r.term: (r.n, r.y) for r in texts(docs, "doc_id", "text").select("text").mapInArrow(sums, schema).repartition("term").mapInArrow(total, schema).collect()}
    n_docs = got_.pop(-1, (0, b""))[0]
    idf = np.log((n_docs + 1) / (np.array([got_[k][0] if k in got_ else 0 for k in range(n_terms)]) + 1)) + 1e-3

    theirs = np.zeros((n_terms, width))
    for k, (_, row) in got_.items():
        theirs[k] = np.frombuffer(row, np.int64) * idf[k]
    y, first = np.zeros((n_terms, width)), np.vstack([test, np.zeros((1, width))])
    for w in words:
        _gather(np.array(w), max(2, len(w)), first, idf, y)
    if size := np.linalg.norm(theirs):
        y += theirs * (np.linalg.norm(y) / size)
    test = test / idf[:, None]
    basis = _leading(y, test, min(RANK, width))
    items = np.array([np.bincount(w, minlength=n_terms) @ (basis * idf[:, None]) for w in words])
    items /= np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-12)
    return Model(terms, idf, basis, items.astype(np.float32), [i for i, _ in got], words)


def _add(found: list[np.ndarray], test: np.ndarray, y: np.ndarray) -> None:
    """Adds the documents' part of Y for the passages of some texts, given as term numbers: each word of a text is in one passage. A passage
    weighs the less the more terms it has, by their number squared. All are whole numbers, and those of ``PASSAGES`` fit 32 bits."""
    size = np.array([len(ids) for ids in found], np.int64)
    ids = np.concatenate([np.zeros(0, np.int64), *found])
    begin = np.cumsum(size) - size
    many = -(-size // PASSAGE)
    passage = np.repeat(np.cumsum(many) - many, size) + (np.arange(len(ids)) - np.repeat(begin, size)) // PASSAGE
    passage, ids = passage[ids >= 0], ids[ids >= 0]
    cuts = np.searchsorted(passage, np.arange(0, int(many.sum()) + PASSAGES, PASSAGES))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        k = ids[a:b]
        new = np.flatnonzero(np.diff(passage[a:b], prepend=-1))
        count = np.diff(np.append(new, b - a))
        aw = np.add.reduceat(test[k], new, axis=0) * np.maximum(1, WEIGHT // count**2)[:, None].astype(np.int32)
        order = np.argsort(k, kind="stable")
        first = np.flatnonzero(np.diff(k[order], prepend=-1))
        y[k[order[first]]] += np.add.reduceat(aw[np.repeat(np.arange(len(new)), count)[order]], first, axis=0)


def _gather(ids: np.ndarray, window: int, first: np.ndarray, idf: np.ndarray, out: np.ndarray) -> None:
    """Adds A'(A W) of one item's windows of length one."""
    ids_ = np.where(ids < 0, len(idf), ids)
    for a in _starts(len(ids_), window):
        part = ids_[a : a + window + window // 2]
        known = part[part < len(idf)]
        if len(known):
            norm = np.linalg.norm(np.bincount(known, minlength=1)[np.unique(known)] * idf[np.unique(known)]) or 1.0
            aw = first[known].sum(axis=0) / norm
            np.add.at(out, known, (idf[known] / norm)[:, None] * aw)


def _leading(y: np.ndarray, test: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of A'A from Y = A'A W: with a small shift, and the Cholesky factor of
    W'Y, the left singular vectors of Y over that factor."""
    shift = np.sqrt(len(y)) * 1e-7 * max(np.linalg.norm(y), 1e-12)
    y = y + shift * test
    core = test.T @ y
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    good = value > value.max() * 1e-10
    b = y @ (vector[:, good] / np.sqrt(value[good]))
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    return u[:, : min(rank, int((s > s[0] * 1e-6).sum()))]


def common(item: list[int], part: list[int]) -> list[int]:
    """Places in ``item`` of a longest common subsequence with ``part``.

    Lengths are kept for some rows alone, and those between two of them are worked out again on the way back: memory grows
    with the root of the item's length, and every item that fits a block of HELD_NUMBERS is worked out once.
    """
    n, m = len(item), len(part)
    row = np.array(part)

    def rows(best: np.ndarray, words: list[int]) -> Iterator[np.ndarray]:
        for word in words:
            new = np.zeros(m + 1, np.int32)
            new[1:] = np.maximum.accumulate(np.maximum(np.where(row == word, best[:-1] + 1, 0), best[1:]))
            best = new
            yield best

    step = max(isqrt(n) + 1, HELD_NUMBERS // (m + 1))
    starts = [np.zeros(m + 1, np.int32)]
    for i, best in enumerate(rows(starts[0], item[: (n - 1) // step * step]), 1):
        if i % step == 0:
            starts.append(best)
    out, j = [], m
    for k in range(len(starts) - 1, -1, -1):
        first = k * step
        block = [starts[k], *rows(starts[k], item[first : first + step])]
        i = len(block) - 1
        while i and j:
            if block[i][j] == block[i - 1][j]:
                i -= 1
            elif block[i][j] == block[i][j - 1]:
                j -= 1
            else:
                out.append(first + i - 1)
                i, j = i - 1, j - 1
    return out[::-1]


def longest_run(item: list[int], part: np.ndarray, weight: np.ndarray) -> float:
    """The greatest weight of words of ``item`` that stand in ``part`` one after the other as they do there."""
    run, best = np.zeros(len(part) + 1), 0.0
    for i, word in enumerate(item):
        run[1:] = np.where(part == word, run[:-1] + weight[i], 0.0)
        best = max(best, float(run.max()))
    return best


def verified(item: list[int], part: np.ndarray, weight: np.ndarray, mark: np.ndarray) -> float:
    """Share of the item's weight that ``part`` holds in order; 0 if it is too little, or if the item's
    end isn't among it and no such share stands in one piece. ``weight`` is by word of the item, ``mark`` a
    scratch array by term."""
    mark[part] = True
    mark[-1] = False
    here = weight[mark[item]].sum()
    mark[part] = False
    if here < HELD * weight.sum():
        return 0.0
    at = common(item, part.tolist())
    tail = len(item) - max(1, round(len(item) * TAIL))
    share = weight[at].sum() / weight.sum()
    ends = weight[[i for i in at if i >= tail]].sum() / weight[tail:].sum()
    if share < HELD or len(at) < HELD / 2 * len(item):
        return 0.0
    return float(share) if ends >= ANSWER or longest_run(item, part, weight) >= HELD * weight.sum() else 0.0


class Searcher:
    """Finds a model's items in texts."""

    def __init__(self, m: Model) -> None:
        self.m, self.number = m, _Numbers(m.terms)
        self.weights = np.vstack([m.basis * m.idf[:, None], np.zeros((1, m.basis.shape[1]))]).astype(np.float32)
        # What holds HELD of an item's weight holds at least so much of it in the item's rare terms:
        # its other terms can't make it up. Items of like need form groups, and a window is projected
        # for a group only if the rare terms of all the group's items in it weigh as much.
        rare = np.where(m.idf >= RARE, m.idf, 0)
        need = np.array([HELD * m.idf[w].sum() - (m.idf - rare)[w].sum() for w in m.words]) - 1e-4
        reach = COVER * np.array([np.linalg.norm(self.weights[w].sum(axis=0)) for w in m.words])
        spans: dict[int, list[int]] = {}
        for i in np.argsort(need, kind="stable").tolist():
            spans.setdefault(_span(len(m.words[i])), []).append(i)
        size = max(8, -(-len(m.words) // 24))
        groups = [(span, np.array(v[k : k + size])) for span, v in sorted(spans.items()) for k in range(0, len(v), size)]
        self.groups = [(span, v, m.items[v].T.copy(), need[v], reach[v]) for span, v in groups]
        self.rare = np.zeros((len(m.idf) + 1, len(groups)))
        for k, (_, v) in enumerate(groups):
            of = np.unique(np.concatenate([m.words[i] for i in v]))
            self.rare[of, k] = rare[of] if need[v].min() > 0 else m.idf[of]
        # What any group counts of a term, and the least that any group asks for: stretches with less are passed over.
        self.any = self.rare.max(axis=1)
        self.least = min((float(need.min()) for _, _, _, need, _ in self.groups), default=0.0)
        self.columns = [np.ascontiguousarray(c) for c in self.rare.T]
        self.weight = [m.idf[w] for w in m.words]
        self.mark = np.zeros(len(m.idf) + 1, bool)

    def find(self, batch: list[bytes]) -> list[list[tuple[int | None, float, float]]]:
        """For each text, ``item_id, cosine, held`` of the items in it.

        For items of like length, the texts stand in one row, with gaps that none of their windows bridges; long ones in pieces that
        overlap by more than a window. Neither changes what is found, and a long item lengthens no row but its own.
        """
        found: list[dict[int, tuple[float, float]]] = [{} for _ in batch]
        numbers = [self.number.of(text) for text in batch]
        for most in dict.fromkeys(max(span, SHARED) for span, *_ in self.groups):
            gap, row, owner, size = 2 * max(span for span, *_ in self.groups if max(span, SHARED) == most), [], [], 0
            for k, ids in enumerate(numbers):
                for a in range(0, max(1, len(ids)), WORDS):
                    row.append(np.append(ids[a : a + WORDS + gap], np.full(gap, -1)))
                    owner.append(k)
                    size += len(row[-1])
                    if size >= WORDS:
                        self._search(most, gap, row, owner, found)
                        row, owner, size = [], [], 0
            if row:
                self._search(most, gap, row, owner, found)
        return [[(self.m.ids[i], c, h) for i, (c, h) in sorted(f.items())] for f in found]

    def _search(self, most: int, gap: int, row: list[np.ndarray], owner: list[int], found: list[dict[int, tuple[float, float]]]) -> None:
        m, ids = self.m, np.concatenate(row)
        begin = np.cumsum([0, *(len(x) for x in row)])
        upto = np.zeros(len(ids) + 1)
        np.cumsum(self.any[ids], out=upto[1:])
        first = np.arange(0, len(ids), STRETCH)
        # No window is longer than the gap.
        rich = upto[np.minimum(first + STRETCH + gap, len(ids))] - upto[first] >= max(self.least, 1e-4) - 1e-6
        for k, (span, items, directions, need, reach) in enumerate(self.groups):
            if max(span, SHARED) != most:
                continue
            starts = np.arange(0, len(ids), span // 2)
            starts = starts[rich[starts // STRETCH]]
            ends = np.minimum(starts + span + span // 2, len(ids))
            least = max(float(need.min()), 1e-4)
            some = upto[ends] - upto[starts] >= least - 1e-6
            starts, ends = starts[some], ends[some]
            weigh, long = self.columns[k], np.append(ids, np.full(2 * span, -1))
            mass = np.concatenate([weigh[long[starts[a : a + 4096, None] + np.arange(span + span // 2)]].sum(axis=1) for a in range(0, len(starts), 4096)] or [np.zeros(0)])
            for w in np.flatnonzero(mass >= max(float(need.min()), 1e-4)).tolist():
                part = ids[starts[w] : ends[w]]
                vector = self.weights[part].sum(axis=0)
                along = vector @ directions
                cosine = along / max(float(np.linalg.norm(vector)), 1e-9)
                f = found[owner[int(np.searchsorted(begin, starts[w] + int(np.argmax(part >= 0)), "right")) - 1]]
                for j in np.flatnonzero((along >= reach) & (cosine >= COSINE) & (mass[w] >= need)).tolist():
                    i = int(items[j])
                    if f.get(i, (0.0, 0.0))[1] < 1 - 1e-9 and (held := verified(m.words[i], part, self.weight[i], self.mark)):
                        f[i] = max(f.get(i, (0.0, 0.0)), (float(cosine[j]), held), key=lambda x: x[1])


_OPEN: dict[str, Searcher] = {}


def _sent(docs: DataFrame, model: Model):  # noqa: ANN202
    """The model on the workers, by a name."""
    return uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(pickle.dumps(tuple(model), protocol=5))


def _opened(name: str, sent) -> Searcher:  # noqa: ANN001
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = Searcher(Model(*pickle.loads(sent.value)))  # noqa: S301  made by this module
    return _OPEN[name]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, held`` of the documents that hold a benchmark item, one row for each
    item and row of ``docs``. Null and blank texts hold none, and neither does any text if the
    benchmark has no item with a word. Items that repeat are reported each."""
    schema = "doc_id long, item_id long, cosine double, held double"
    rows = texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark):
        if (model := fit(docs, items)) is not None:
            out = out.unionAll(rows.mapInArrow(_search(*_sent(docs, model)), schema))
    return out


def _search(name: str, sent):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _opened(name, sent).find
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                got = find(part.column("text").cast(pa.binary()).to_pylist())
                out = [(doc, *x) for doc, f in zip(part.column("doc_id").to_pylist(), got, strict=True) for x in f]
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names=["doc_id", "item_id", "cosine", "held"])

    return run


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text holds no benchmark item.

    Null and blank texts hold none, and so they stay, as all rows do if no item has a word. Repeated rows stay
    or go alike; columns of any name are handed through; an empty table stays empty.
    """
    out = docs
    for items in item_blocks(benchmark):
        if (model := fit(docs, items)) is not None:
            out = out.withColumn("text", F.col("text").cast("string")).mapInArrow(_without(*_sent(docs, model)), docs.schema)
    return out


def _without(name: str, sent):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                got = _opened(name, sent).find([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
                yield part.filter(pa.array([not f for f in got], pa.bool_()))

    return run
