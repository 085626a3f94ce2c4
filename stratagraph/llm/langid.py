"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is
the sum, over every way to cut it into pieces, of the product of their probabilities; the forward
algorithm gives that sum. A text's probability is the product over its words. The piece
probabilities are fitted by expectation maximisation: the forward-backward algorithm gives each
piece's expected count in the training words, and the counts are added up over the cluster.

A word is a run of letters in lower case with a word-start mark before it, as in the vocabulary;
pieces don't cross words. Words recur, so a worker keeps the scores of those it has met.
"""

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written

START = "▁"
#: Labelled rows of a language that the model is fitted on at most, about; chosen by a hash of the id.
FIT_ROWS = 1500
ROUNDS = 3
#: Added to each expected count.
PRIOR = 0.01
#: Scored words that a worker keeps and their letters, rows it takes at a time, letters of a word that it looks at
#: at a time, files of the training words: none of them changes a result.
KEPT, LETTERS, ROWS, SPAN, FILES = 500_000, 1 << 25, 512, 1 << 15, 64

_WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    langs: tuple[str, ...]
    prior: np.ndarray
    pieces: dict[str, int]
    #: A row for each piece, then one for a letter that no piece has, then zeros; a column by language.
    probs: np.ndarray


class Trie:
    """The pieces read backwards, in sorted arrays, to find those that end at many places at a time."""

    def __init__(self, pieces: dict[str, int]) -> None:
        number, edges, self.size, self.longest = {"": 0}, {}, len(pieces), max(map(len, pieces), default=1)
        piece = [-1]
        for p, i in sorted(pieces.items(), key=lambda x: len(x[0])):
            for k in range(1, len(p) + 1):
                if (tail := p[-k:]) not in number:
                    number[tail] = len(piece)
                    edges[number[tail[1:]] << 21 | ord(tail[0])] = len(piece)
                    piece.append(-1)
            piece[number[p]] = i
        self.keys = np.array(sorted(edges) or [-1], np.int64)
        self.to = np.array([edges[k] for k in sorted(edges)] or [0], np.int64)
        self.piece = np.array(piece, np.int64)

    def ending(self, codes: np.ndarray, begin: int, end: int) -> np.ndarray:
        """For words of one length (a row each): by word, place from ``begin`` to ``end`` and length, the piece
        that ends there. ``size`` is a lone letter without a piece, one more is no piece."""
        w, m = len(codes), end - begin
        row, at = np.divmod(np.arange(w * m), m)
        flat, node, found = np.arange(w * m), np.zeros(w * m, np.int64), []
        for k in range(min(self.longest, end)):
            keep = at + begin >= k
            flat, row, at, node = flat[keep], row[keep], at[keep], node[keep]
            key = node << 21 | codes[row, at + begin - k]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            keep = self.keys[i] == key
            flat, row, at, node = flat[keep], row[keep], at[keep], self.to[i[keep]]
            if not len(flat):
                break
            piece = self.piece[node]
            found.append((flat[piece >= 0], piece[piece >= 0]))
        out = np.full((w * m, max(1, len(found))), self.size + 1, np.int32)
        out[:, 0] = self.size
        for k, (i, x) in enumerate(found):
            out[i, k] = x
        return out.reshape(w, m, -1)


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(len(words), -1)


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of letters, in lower case and with the mark, of a sentencepiece model; numbered."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    usable = (p for p in found if p == p.lower() and (p == START or p.removeprefix(START).isalpha()))
    return {p: i for i, p in enumerate(dict.fromkeys(usable))}


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; empty if the text has no letter at all."""
    found = _WORD.findall(text.lower())
    return found if any(w.isalpha() for w in found) or any(c.isalpha() for w in found for c in w) else []


def _batches(words: list[str], longest: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """The words by length, marked, so many at a time as fit the memory: their numbers and letters."""
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault(len(w) + 1, []).append(i)
    for n, which in by_size.items():
        step = max(1, 2_000_000 // (min(n, SPAN) * longest))
        for a in range(0, len(which), step):
            yield which[a : a + step], _codes([START + words[i] for i in which[a : a + step]])


def _forward(ids: np.ndarray, probs: np.ndarray, back: np.ndarray, logs: np.ndarray, arcs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward sums over a stretch of places: those of the last places, for the next stretch (``back``: those
    before this one; the last is where it begins), scaled as ``logs``, to which it adds, tells. With ``arcs``
    (of one language) also by word, place and length the share of the sum at the place that came by that
    piece: ratios, so no scale is in them."""
    (w, m, most), before = ids.shape, back.shape[1]
    alpha = np.concatenate([back, np.zeros((w, m, back.shape[2]))], axis=1)
    share = np.zeros((w, m, most)) if arcs else None
    for e in range(m):
        at = before + e
        for k in range(min(most, at)):
            term = alpha[:, at - 1 - k] * probs[ids[:, e, k]]
            alpha[:, at] += term
            if share is not None:
                share[:, e, k] = term[:, 0]
        if share is not None:
            share[:, e] /= np.maximum(alpha[:, at], 1e-300)
        if e % 4 == 3 or e == m - 1:
            by = alpha[:, at].max(axis=1)
            small = by < 1e-40
            if small.any():
                by = np.maximum(by[small], 1e-300)
                alpha[small, at - before + 1 : at + 1] /= by[:, None, None]
                logs[small] += np.log(by)
    return alpha[:, m:], share


def _begin(w: int, longest: int, langs: int) -> np.ndarray:
    back = np.zeros((w, longest, langs))
    back[:, -1] = 1
    return back


def log_scores(words: list[str], trie: Trie, probs: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability by language. A word of any length counts whole; what is held of
    a long one is a stretch."""
    out = np.zeros((len(words), probs.shape[1]))
    for which, codes in _batches(words, trie.longest):
        back, logs = _begin(len(which), trie.longest, probs.shape[1]), np.zeros(len(which))
        for a in range(0, codes.shape[1], SPAN):
            back, _ = _forward(trie.ending(codes, a, min(a + SPAN, codes.shape[1])), probs, back, logs)
        out[which] = np.log(np.maximum(back[:, -1], 1e-300)) + logs[:, None]
    return out


def expected(words: list[str], weights: np.ndarray, trie: Trie, probs: np.ndarray) -> np.ndarray:
    """Expected count of each piece in weighted words, for one language's probabilities.

    The chance that a word is cut at a place follows backwards from those after it: what is cut at a place
    came there by a piece with the share that the forward sums give it. Long words go by stretches, whose
    shares are worked out again from the sums at their begin.
    """
    out = np.zeros(trie.size + 2)
    column, longest = probs[:, None], trie.longest
    for which, codes in _batches(words, longest):
        w, n = codes.shape
        back, logs = _begin(w, longest, 1), np.zeros(w)
        begins, backs = list(range(0, n, SPAN)), []
        for a in begins:
            backs.append(back)
            ids = trie.ending(codes, a, min(a + SPAN, n))
            back, share = _forward(ids, column, back, logs, arcs=len(begins) == 1)
        cut = np.zeros((w, longest + 1))  # at the places up to the end of the stretch, the last being the end
        cut[:, -1] = weights[which]
        for a, back in zip(reversed(begins), reversed(backs), strict=True):
            if len(begins) > 1:
                ids = trie.ending(codes, a, min(a + SPAN, n))
                share = _forward(ids, column, back, logs, arcs=True)[1]
            m, most = ids.shape[1:]
            cut = np.concatenate([np.zeros((w, m)), cut], axis=1)
            for e in range(m - 1, -1, -1):
                at = longest + e + 1
                share[:, e] *= cut[:, at, None]
                for k in range(most):
                    cut[:, at - 1 - k] += share[:, e, k]
            out += np.bincount(ids.ravel(), weights=share.ravel(), minlength=len(out))
            cut = cut[:, : longest + 1]
    out[-1] = 0
    return out


def fit(labelled: DataFrame, path: str, rows: int = FIT_ROWS) -> Model:
    """The model of ``labelled`` (``doc_id, text, lang``; null langs and texts teach nothing).

    It is fitted on about ``rows`` rows of each language at most: those whose id's hash is below the
    share that gives so many. Counts of the languages' rows, and with them the prior, cover all.
    What comes to the driver is bounded by the vocabulary times the languages: 22,000 numbers for each
    different ``lang``, which are meant to be few (a thousand take 180 MB). A language none of whose texts has
    a letter is learned from its share of rows alone. No labelled row gives a model that knows no language.
    """
    pieces = vocabulary(path)
    size, trie = len(pieces), Trie(pieces)
    known = labelled.where("lang is not null and text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    n = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(n))
    if not langs:
        return Model((), np.zeros(0), pieces, np.zeros((size + 2, 0)))
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, rows / n[lang]))))
    at = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = known.where(at < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
            if len(found) > 1_000_000:
                yield _counted(found)
                found.clear()
        yield _counted(found)

    counts = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = written(counts.repartition(FILES), "langid-words")
    probs = np.full((size + 2, len(langs)), 1.0 / (size + 1))
    probs[-1] = 0
    for _ in range(ROUNDS):
        now = pickle.dumps((langs, trie, probs))

        def step(batches: Iterator[pa.RecordBatch], now: bytes = now) -> Iterator[pa.RecordBatch]:
            langs, trie, probs = pickle.loads(now)  # noqa: S301  made above
            total = np.zeros((trie.size + 2, len(langs)))
            for batch in batches:
                which = np.array([langs.index(x) for x in batch.column("lang").to_pylist()])
                words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(float)
                for k in set(which.tolist()):
                    i = np.flatnonzero(which == k)
                    total[:, k] += expected([words[j] for j in i], n[i], trie, probs[:, k])
            i, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int64()), pa.array(total[i, k])], names=["piece", "lang", "n"])

        total = counts.mapInArrow(step, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        probs = np.full((size + 2, len(langs)), PRIOR)
        probs[total.piece, total.lang] += total.n
        probs[-1] = 0
        probs /= probs.sum(axis=0)
    every = np.array([n[x] for x in langs], float)
    return Model(langs, np.log(every / every.sum()), pieces, probs)


def _counted(found: Counter) -> pa.RecordBatch:
    keys = list(found)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])


class _Scored(dict):
    """Numbers words as they come; ``table`` has the scores of the numbered ones."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.letters = 0
        self.model, self.table, self.trie = model, np.zeros((0, len(model.langs))), Trie(model.pieces)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.letters += len(word)
        return n

    def score(self) -> None:
        if new := list(islice(self, len(self.table), None)):
            self.table = np.concatenate([self.table, log_scores(new, self.trie, self.model.probs)])


def predict_texts(batch: list[str], seen: _Scored) -> tuple[list[str], list[float]]:
    langs, prior = seen.model.langs, seen.model.prior
    ids = []
    for text in batch:
        ids.append(np.array([seen[w] for w in words_of(text)], np.int64) if langs and text else np.zeros(0, np.int64))
        if len(seen) - len(seen.table) > 50_000:
            seen.score()
    seen.score()
    pred, score = [], []
    for i in ids:
        if not len(i):
            pred.append("und")
            score.append(0.0)
            continue
        total = prior + seen.table[i].sum(axis=0)
        best = int(total.argmax())
        pred.append(langs[best])
        score.append(1.0 / math.fsum(np.exp(total - total[best]).tolist()))
    return pred, score


_SEEN: dict[str, _Scored] = {}


def predictor(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over ``doc_id, held_out, text``. The model is sent with the function: its
    size is bounded by the vocabulary times the languages."""
    packed, name = pickle.dumps(tuple(model)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for a in range(0, batch.num_rows, ROWS):
                p, s = predict_texts(batch.column("text").slice(a, ROWS).to_pylist(), _seen(name, packed))
                pred += p
                score += s
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row, from its whole text alone.

    ``score`` is the posterior probability of the predicted language. Null texts and those without
    a letter are ``und`` with score 0, and so is all if the model has learned no language. A tie goes
    to the language that sorts first. Repeated rows are predicted each; an empty table gives no rows.
    """
    flag = F.lit(False) if held_out is None else held_out
    rows = texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), "text"), "doc_id", "held_out", "text")
    return rows.mapInArrow(predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text has a language with score ``least`` or more.

    Null and empty texts and those without a letter have none, and no text has one if the model knows none.
    Repeated rows are kept or go alike; columns of any name are handed through; an empty table stays empty.
    """
    packed, name = pickle.dumps(tuple(model)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                pred, score = predict_texts(["" if t is None else t for t in part.column("text").to_pylist()], _seen(name, packed))
                yield part.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)


def _seen(name: str, packed: bytes) -> _Scored:
    seen = _SEEN.get(name)
    if seen is None or len(seen) > KEPT or seen.letters > LETTERS:
        _SEEN.clear()
        seen = _SEEN[name] = _Scored(Model(*pickle.loads(packed)))  # noqa: S301  made by this module
    return seen
