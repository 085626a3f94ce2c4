"""Token counts by a transducer compiled from the vocabulary of a byte-pair model.

The model's vocabulary is compiled into a deterministic transducer. A state is the text since the
last synchronising point, held as the tokens of its encoding; reading a character goes to the state
of the longer text and emits the change in the number of tokens, so the emissions along a path add
up to the token count. The transition follows from the vocabulary alone: the last token of the new
state is the one token ending here that is compatible with the state before it, that is, where the
two tokens side by side encode to themselves (Berglund and van der Merwe, 2023). States are made
when first reached and kept, and so are whole paths between two synchronising points.

Runs of spaces are the exception: their pieces hold nothing but one character, so which of them may stand
beside which depends on where the run begins. What holds such a run up to the next point is encoded by
the merges themselves, with a heap.

A point between two characters synchronises if no piece of the vocabulary holds them side by side:
no merge can cross it, so what follows starts anew. A chunk of a text is thereby a map on states:
what stands before its first such point goes on in the incoming state (head), what lies between its
first and last adds a count, what stands after its last is the state that it leaves (tail). These
maps compose associatively, and those of a text's chunks are composed in a balanced tree, as in a
parallel prefix scan.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

SPACE = "▁"
#: Characters in a chunk, paths kept by a worker, their characters and their longest, rows at a time: they bound
#: memory and change no result. Nor does up to which length a pair is looked for without a heap.
CHUNK, KEPT, LETTERS, LONG, ROWS, SHORT = 1 << 16, 600_000, 1 << 25, 256, 512, 16


class ChunkMap(NamedTuple):
    """What a chunk does to a state: with no synchronising point inside, ``whole`` is its text."""

    head: str
    count: int
    tail: str
    whole: bool


class _Numbered(dict):
    """Gives each new key the next number, and counts the keys' characters."""

    chars = 0

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.chars += len(key)
        return n


class Transducer:
    """Of a byte-pair model with byte fallback, from its pieces and their ranks (low merges first)."""

    def __init__(self, rank: dict[str, float]) -> None:
        self.rank = rank
        self.beside = {p[i : i + 2] for p in rank for i in range(len(p) - 1)}
        #: A space that follows another character always synchronises in such vocabularies.
        self.words = not any(x[1] == SPACE and x[0] != SPACE for x in self.beside)
        #: Lengths of the pieces by their last two characters, longest first.
        ends: dict[str, set[int]] = {}
        for p in rank:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        #: By a piece of two characters or more, whether it may follow a token; "" is the start.
        self.fits: dict[str, dict[str, bool]] = {p: {} for p in rank if len(p) > 1}
        self.paths: dict[str, int] = {}
        self.seen, self.made = _Numbered(), np.zeros(0, np.int64)

    def merged(self, text: str) -> list[str]:
        """The encoding by its definition: the best pair merges first, of equals the leftmost."""
        parts = list(text)
        if len(parts) > SHORT:
            return self._merged_long(parts)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same with a heap of the pairs, so a long run takes little more than its length in steps. A part that
        was merged into the one before it is empty; pairs that are no more are passed over."""
        n, get = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i in range(n - 1) if (r := get(p := parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if j >= n or not parts[i] or len(parts[i]) + len(parts[j]) != len(p) or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(q := p + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, q))
            if (h := before[i]) >= 0 and (r := get(q := parts[h] + p)) is not None:
                heapq.heappush(heap, (r, h, q))
        return [p for p in parts if p]

    def weight(self, token: str) -> int:
        return 1 if token in self.rank else len(token.encode())

    def path(self, text: str) -> int:
        """Tokens emitted from the start state over ``text``, which has no synchronising point."""
        n = len(text)
        last, count = [""] * (n + 1), [0] * (n + 1)
        last[1], count[1] = text[0], self.weight(text[0])
        ends, rank, fits, merged = self.ends, self.rank, self.fits, self.merged
        for i in range(2, n + 1):
            for k in ends.get(text[i - 2 : i], ()):
                if k > i or (t := text[i - k : i]) not in rank:
                    continue
                before = last[i - k]
                known = fits[t]
                if (ok := known.get(before)) is None:
                    ok = known[before] = merged(before + t) == ([before, t] if before else [t])
                if ok:
                    last[i], count[i] = t, count[i - k] + 1
                    break
            else:
                last[i], count[i] = text[i - 1], count[i - 1] + self.weight(text[i - 1])
        return count[n]

    def compiled(self) -> None:
        """The pieces as a trie read backwards, in sorted arrays, for many paths at a time."""
        self.tokens = ["", *self.rank]
        node_of, tokens, edges, ends = {"": 0}, [0], {}, sorted(enumerate(self.tokens), key=lambda x: len(x[1]))
        for i, piece in ends:
            for k in range(1, len(piece) + 1):
                if (tail := piece[-k:]) not in node_of:
                    node_of[tail] = len(tokens)
                    edges[node_of[tail[1:]] << 21 | ord(tail[0])] = len(tokens)
                    tokens.append(0)
            tokens[node_of[piece]] = i
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in sorted(edges)], np.int64)
        self.node_token = np.array(tokens, np.int64)
        self.pair_keys, self.pair_fits = np.zeros(1, np.int64), np.zeros(1, bool)

    def _follow(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether tokens may follow others (0: the start, or a character that no piece has)."""
        key = before << 32 | token
        while True:
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            new = key[self.pair_keys[at] != key]
            if not len(new):
                return self.pair_fits[at]
            new = np.unique(new)
            fits = []
            for k in new.tolist():
                a, b = self.tokens[k >> 32], self.tokens[k & 0xFFFFFFFF]
                fits.append(self.merged(a + b) == ([a, b] if a else [b]))
            if len(self.pair_keys) > 3_000_000:
                self.pair_keys, self.pair_fits = np.zeros(1, np.int64), np.zeros(1, bool)
            keys = np.concatenate([self.pair_keys, new])
            order = np.argsort(keys, kind="stable")
            self.pair_keys, self.pair_fits = keys[order], np.concatenate([self.pair_fits, fits])[order]

    def paths_of(self, words: list[str]) -> np.ndarray:
        """Tokens of each of many texts, each from the start state to its end."""
        out = np.zeros(len(words), np.int64)
        if not hasattr(self, "tokens"):
            self.compiled()
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > 48 or SPACE * 2 in w:
                out[i] = self.closed(w)
            else:
                by_size.setdefault(len(w), []).append(i)
        for n, which in by_size.items():
            codes = np.frombuffer("".join([words[i] for i in which]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(-1, n).T
            out[which] = self._lockstep(codes)
        return out

    def _lockstep(self, codes: np.ndarray) -> np.ndarray:
        """``codes``: a row for each position, a column for each text."""
        n, w = codes.shape
        flat = codes.reshape(-1)
        at, node, found = np.arange(n * w), np.zeros(n * w, np.int64), []
        for k in range(1, n + 1):
            keep = at >= (k - 1) * w
            at, node = at[keep], node[keep]
            key = node << 21 | flat[at - (k - 1) * w]
            i = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            keep = self.edge_keys[i] == key
            at, node = at[keep], self.edge_to[i[keep]]
            if not len(at):
                break
            token = self.node_token[node]
            has = token > 0
            found.append((at[has], token[has]))
        one = np.zeros(n * w, np.int64)
        if found:
            one[found[0][0]] = found[0][1]
        lone = np.where(one > 0, 1, np.where(flat < 0x80, 1, np.where(flat < 0x800, 2, np.where(flat < 0x10000, 3, 4))))
        last, count = np.zeros((n + 1, w), np.int64), np.zeros((n + 1, w), np.int64)
        cuts = [np.searchsorted(at, np.arange(n + 1) * w) for at, _ in found]
        for e in range(n):
            open_ = np.ones(w, bool)
            for k in range(min(len(found), e + 1), 1, -1):
                a, b = cuts[k - 1][e], cuts[k - 1][e + 1]
                if a == b:
                    continue
                col, token = found[k - 1][0][a:b] - e * w, found[k - 1][1][a:b]
                keep = open_[col]
                col, token = col[keep], token[keep]
                ok = self._follow(last[e + 1 - k, col], token)
                col, token = col[ok], token[ok]
                last[e + 1, col], count[e + 1, col] = token, count[e + 1 - k, col] + 1
                open_[col] = False
            col = np.flatnonzero(open_)
            last[e + 1, col], count[e + 1, col] = one[e * w + col], count[e, col] + lone[e * w + col]
        return count[n]

    def counts(self, batch: list[str]) -> list[int]:
        """``count`` of each text, with the paths that are new to the worker made many at a time."""
        out, ids, short = [0] * len(batch), [], []
        for i, text in enumerate(batch):
            if len(text) > CHUNK or not self.words:
                out[i] = self.count(text)
            elif text:
                seen = self.seen
                ids.append(np.array([seen[p] for p in _WORDS.findall(text)], np.int64))
                short.append(i)
                if len(seen) - len(self.made) > 50_000:
                    self._make()
        self._make()
        for i, x in zip(short, ids, strict=True):
            out[i] = int(self.made[x].sum())
        if len(self.seen) > KEPT or self.seen.chars > LETTERS:
            self.seen, self.made = _Numbered(), np.zeros(0, np.int64)
        return out

    def _make(self) -> None:
        new = list(islice(self.seen, len(self.made), None))
        if new:
            self.made = np.concatenate([self.made, self.paths_of(new)])

    def closed(self, text: str) -> int:
        """Tokens of a text between two synchronising points of the fast kind (spaces)."""
        if (c := self.paths.get(text)) is None:
            c = sum(self.path(t) if SPACE * 2 not in t else sum(map(self.weight, self.merged(t))) for t in self.split(text))
            if len(text) <= LONG:
                if len(self.paths) > KEPT:
                    self.paths.clear()
                self.paths[text] = c
        return c

    def split(self, text: str) -> list[str]:
        """Cut at every synchronising point."""
        beside = self.beside
        cut = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in beside), len(text)]
        return [text[a:b] for a, b in zip(cut, cut[1:], strict=False) if a < b]

    def chunk(self, text: str) -> ChunkMap:
        parts = (_WORDS.findall(text) if self.words else self.split(text)) if text else []
        if len(parts) < 2:
            return ChunkMap(text, 0, text, True)
        closed, paths = self.closed, self.paths
        return ChunkMap(parts[0], sum([c if (c := paths.get(p)) is not None else closed(p) for p in parts[1:-1]]), parts[-1], False)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``. The seam may itself synchronise."""
        if a.whole and b.whole:
            return self._joined(a.head, b.head)
        if a.whole:
            x = self._joined(a.head, b.head)
            return ChunkMap(x.head, b.count, b.tail, False) if x.whole else ChunkMap(x.head, x.count + self.closed(x.tail) + b.count, b.tail, False)
        x = self._joined(a.tail, b.head)
        if b.whole:
            return ChunkMap(a.head, a.count, x.tail, False) if x.whole else ChunkMap(a.head, a.count + self.closed(x.head) + x.count, x.tail, False)
        return ChunkMap(a.head, a.count + (self.closed(x.head) if x.whole else self.closed(x.head) + x.count + self.closed(x.tail)) + b.count, b.tail, False)

    def _joined(self, a: str, b: str) -> ChunkMap:
        if not a or not b:
            return ChunkMap(a + b, 0, a + b, True)
        cut = b[0] == SPACE != a[-1] if self.words else a[-1] + b[0] not in self.beside
        return ChunkMap(a, 0, b, False) if cut else ChunkMap(a + b, 0, a + b, True)

    def total(self, m: ChunkMap) -> int:
        """From the start state to the end of the text."""
        return (self.closed(m.head) if m.head else 0) if m.whole else self.closed(m.head) + m.count + self.closed(m.tail)

    def count(self, text: str, size: int = CHUNK) -> int:
        """Tokens of a text, in the notation of the model: with its leading and inner ``SPACE``."""
        maps = [self.chunk(text[i : i + size]) for i in range(0, len(text), size)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.total(maps[0]) if maps else 0


_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def compile_model(path: str) -> Transducer:
    """The transducer of a sentencepiece byte-pair model: its pieces and scores, no encoding."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return Transducer({sp.id_to_piece(i): -sp.get_score(i) for i in ids})


_COMPILED: dict[str, Transducer] = {}


def _counter(path: str, limit: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _COMPILED.get(path) or _COMPILED.setdefault(path, compile_model(path))
        for batch in batches:
            n: list[int] = []
            for at in range(0, batch.num_rows, ROWS):
                n += t.counts([SPACE + x.replace(" ", SPACE) if x else "" for x in batch.column("text").slice(at, ROWS).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row, for the sentencepiece model at ``path``.

    Null and empty texts have no tokens. The text is taken whole, a space stands before it as the
    model puts one there, and strings that look like special tokens are ordinary text. Rows that
    repeat are counted each; an empty table gives no rows; other columns are not looked at.
    """
    rows = texts(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(_counter(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
