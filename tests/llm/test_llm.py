"""The training-data operators on small cases, against brute force and on awkward input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratagraph.llm import chat, common, hnsw, htmltext, langid, lsa, mixing, queries, secrets, simhash, suffixtree, tokencount

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key_ string, s int"
EN = "the cat sat on the mat and looked at the dog with great interest until evening came"
DE = "der hund lief durch den wald und suchte seinen knochen bis die nacht über das dorf kam"


def docs(spark, rows):
    """Rows of ``doc_id, text[, lang[, source]]``; the further columns have names that operators use inside."""
    full = [(r[0], r[1], (r + (None,))[2], (r + (None, None))[3], None if r[1] is None else len(r[1]), 7, "k", 1) for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (4, "word"), (None, "two words"), (5, "é" * 50_000), (6, "a " * 30_000), (7, "12 34 !!")]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_language(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.sample((EN if i % 2 else DE).split(), 8)), "en" if i % 2 else "de") for i in range(60)]
    train = docs(spark, rows)
    model = langid.fit(train, MODEL)
    assert model.langs == ("de", "en") and np.allclose(model.probs.sum(axis=0), 1)
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(docs(spark, [(1, "the great dog"), (2, "seinen wald und der hund"), *((i + 10, t) for i, t in ODD if i)]), model).collect()}
    assert {(1, "en"), (2, "de"), (11, "und"), (12, "und"), (13, "und"), (17, "und")} <= got
    assert all(0 <= r.score <= 1 for r in langid.predict(train, model).collect())
    assert langid.keep(docs(spark, ODD), model, 0.5).columns == train.columns
    assert langid.predict(docs(spark, []), model).count() == 0
    none = langid.fit(docs(spark, [(1, "x", None)]), MODEL)
    assert langid.predict(docs(spark, [(1, "words")]), none).first().lang_pred == "und"


TINY = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "▁ab": 5}
TINY_P = np.array([0.1, 0.2, 0.3, 0.05, 0.15, 0.1, 0.1, 0.0])


def segmentations(w):
    """Every way to cut a marked word, as pieces' numbers; a letter without a piece stands alone."""
    if not w:
        return [[]]
    heads = [(k, TINY[w[:k]]) for k in range(1, len(w) + 1) if w[:k] in TINY] or [(1, 6)]
    if w[0] not in TINY:
        heads = [*{*heads, (1, 6)}]
    return [[i, *rest] for k, i in heads for rest in segmentations(w[k:])]


def test_forward_sums_all_segmentations(monkeypatch):
    trie, words = langid.Trie(TINY), ["ab", "abab", "b", "ba" * 4, "axb"]
    want = [math.log(sum(math.prod(TINY_P[i] for i in cut) for cut in segmentations("▁" + w))) for w in words]
    counts = np.zeros(8)
    for w, n in zip(words, (1, 2, 3, 4, 5), strict=True):
        cuts = segmentations("▁" + w)
        chance = np.array([math.prod(TINY_P[i] for i in c) for c in cuts])
        for c, p in zip(cuts, chance / chance.sum(), strict=True):
            np.add.at(counts, c, n * p)
    for span in (1 << 15, 1, 3):  # a word in one stretch, and in many
        monkeypatch.setattr(langid, "SPAN", span)
        assert np.allclose(langid.log_scores(words, trie, TINY_P[:, None])[:, 0], want, rtol=1e-12)
        assert np.allclose(langid.expected(words, np.array([1.0, 2, 3, 4, 5]), trie, TINY_P), counts, rtol=1e-9)


def test_long_words_count_whole():
    trie = langid.Trie(TINY)
    for n in (30, 31, 5000, 40_000):
        # A matrix power gives the sum over all segmentations of (ab)*n after the mark: states are cut or not after an a.
        step = lambda first, two: np.array([[first * 0.3 + two, 0.0], [0.0, 0.0]])[0, 0]
        log = math.log(0.1 * step(0.2, 0.05) + 0.15 * 0.3 + 0.1) + (n - 1) * math.log(step(0.2, 0.05))
        assert math.isclose(langid.log_scores(["ab" * n], trie, TINY_P[:, None])[0, 0], log, rel_tol=1e-9)
        got = langid.expected(["ab" * n], np.array([1.0]), trie, TINY_P)
        share = 0.05 / 0.11
        assert math.isclose(got[3], (n - 1) * share + 0.1 * 0.05 / (0.1 * 0.11 + 0.15 * 0.3 + 0.1), rel_tol=1e-6)
        assert math.isclose(got @ [1, 1, 1, 2, 2, 3, 1, 0], 2 * n + 1, rel_tol=1e-6)  # letters and the mark
    pieces = langid.vocabulary(MODEL)
    assert all(p in pieces for p in ("▁the", "▁")) and langid.Trie(pieces).longest == max(map(len, pieces))


# 2


def slow_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(5)
    for _ in range(200):
        t = "".join(rng.choice(["A", "b", " ", "\n", "É", "\xa0", "x\x0b", " the ", "\x1c"]) for _ in range(rng.randrange(40)))
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


def test_links_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:12]:
        for _ in range(15):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    truth = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2}

    def groups(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = defaultdict(set)
        for f in fps:
            out[find(f)].add(f)
        return {frozenset(x) for x in out.values()}

    for limit in (64, 3):  # the second makes keys finer
        monkeypatch.setattr(simhash, "PAIRWISE", limit)
        got = {tuple(sorted(x & (1 << 64) - 1 for x in (r.a, r.b))) for r in simhash.links(df).collect()}
        assert all((a ^ b).bit_count() <= 2 for a, b in got)
        assert got == truth and groups(got) == groups(truth)


def test_crowded_keys(spark, monkeypatch):
    # 40 fingerprints that differ in three of the same four bits, and three bits elsewhere: keys stay crowded down to the last.
    monkeypatch.setattr(simhash, "PAIRWISE", 2)
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ x << 5 ^ 1 << y for x in range(16) for y in (40, 50, 63)})
    got = {tuple(x & (1 << 64) - 1 for x in (r.a, r.b)) for r in simhash.links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")).collect()}
    assert {frozenset(x) for x in got} == {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2}


def test_near_duplicates(spark):
    d = docs(spark, [*ODD, (9, "A Cat sat"), (8, "a cat\nsat")])
    got = simhash.near_duplicates(d).select("doc_id", "component_id").collect()
    assert len(got) == len(ODD) + 2
    by = dict(map(tuple, got))
    assert by[1] == by[2] == by[3] == 1 and by[9] == by[8] == 8 and by[4] == 4 and by[None] is None
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and {(r.key_, r.s, r.fp) for r in kept.collect()} == {("k", 1, 7)}
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in kept.collect())) == [(False, i) for i in (1, 4, 5, 6, 7, 8)] + [(True, 0)]
    assert simhash.keep_one(docs(spark, [])).count() == 0


# 3


def test_chat_round_trip(spark):
    rng = random.Random(7)
    parts = ["<|im_end|>", "<|im_start|>", "\n", "assistant", "<|", "|", "<\\|", "\\", "%0A", "é", " ok", "<\\\\|im_end|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "sy|s\ntem", None]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randrange(6)))])) for c in range(40) for t in range(rng.randrange(1, 5))]
    rows += [(None, 0, "user", "x"), (50, None, "user", "a"), (50, 1, "assistant", "b"), (50, 1, "assistant", "b")]
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("out", F.lit(1))).collect()}
    assert all(r.identical for r in got.values())
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        learned = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_masks_and_grammar(spark):
    back = chat.read_back(chat.render(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "<|im_end|>")], "conv_id long, turn long, role string, text string"))).first()
    at, learned = 0, ""
    for run in back.loss:
        learned += back.formatted[at : at + run.n] * run.learn
        at += run.n
    assert at == len(back.formatted) and learned == "<\\|im_end|>"
    bad = spark.createDataFrame([("<|im_start|>user\nhi",), ("x<|im_start|>user\nhi<|im_end|>\n",), ("<|im_start|>user<|im_end|>\n",), ("<|im_start|>a\nb<|im_start|>c\nd<|im_end|>\n",)], "f string")
    assert [r.t for r in bad.select(chat.parse(F.col("f")).alias("t")).collect()] == [None] * 4


# 4


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 16))
    rows, k = [], 0
    for i, v in enumerate(base):
        for _ in range(1 + i % 5):
            rows.append((k, [float(np.float32(x)) for x in v + rng.standard_normal(16) * 0.06], i % 3))
            k += 1
    near = base[0]
    for _ in range(150):  # a crowd
        rows.append((k, [float(np.float32(x)) for x in near + rng.standard_normal(16) * 0.05], 0))
        k += 1
    rows += [(k + 1, rows[0][1], 0), (k + 2, rows[0][1], 0), (k + 3, rows[0][1], None), (k + 4, None, 1), (k + 5, [0.0] * 16, 1), (k + 6, [float("nan")] * 16, 1), (k + 7, [float("inf")] + [1.0] * 15, 1), (k + 8, [1.0, None], 1), (k + 9, [], 1), (k + 10, [1.0, 2.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = {r.vec_id: r for r in hnsw.near_duplicates(d).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows[: k + 3] if lab is not None and len(v) == 16]
    truth = {(a, b) for a, u, x in good for b, v, y in good if a != b and x == y and u @ v >= 0.98}
    root = {i: i for i in got}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in truth:
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    links = Counter(a for a, _ in truth)
    found = sum(r.n_links for r in got.values())
    assert 0.99 * len(truth) <= found <= len(truth) and len(truth) > 5000
    assert sum(got[i].component_id != find(i) for i in got) <= 2
    assert all(got[k + j].n_links == 0 and got[k + j].kept for j in range(3, 11)) and got[k + 1].n_links == links[k + 1]
    assert hnsw.near_duplicates(d.limit(0)).count() == 0


def crowds(rng, alone, groups, size, dim, noise):
    v = np.concatenate([rng.standard_normal((alone, dim)), np.repeat(rng.standard_normal((groups, dim)), size, 0) + rng.standard_normal((groups * size, dim)) * noise])
    return v[rng.permutation(len(v))]


def linked(v):
    u = hnsw._unit(v)
    return np.concatenate([(u[k : k + 2048] @ u.T >= 0.98).sum(axis=1) - 1 for k in range(0, len(u), 2048)])


@pytest.mark.parametrize(("alone", "groups", "size", "noise"), [(8000, 200, 40, 0.05), (8000, 200, 40, 0.135), (3000, 60, 50, 0.12), (2000, 1, 3000, 0.145)])
def test_crowds_keep_their_links(alone, groups, size, noise):
    v = crowds(np.random.default_rng(9), alone, groups, size, 64, noise)
    want, n = linked(v), len(v)
    got = np.zeros(n, int)
    one = hnsw.shard(np.arange(n), np.ones(n, int), v, 0.98)
    got[one.nodes] = hnsw.between(one, one, 0.98, True)[0]
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
    assert one.recall >= hnsw.RECALL and (one.width < 128 or groups == 1)
    # In two shards a link is counted at both ends, and no vector is linked with itself.
    half, got = n // 2, np.zeros(n, int)
    parts = [hnsw.shard(ids, np.ones(len(ids), int), v[ids], 0.98) for ids in (np.arange(half), np.arange(half, n))]
    for p in parts:
        got[p.nodes] += hnsw.between(p, p, 0.98, True)[0]
    x, y, pairs, (recall, _, _) = hnsw.between(*parts, 0.98, False)
    assert x.sum() == y.sum() and recall >= hnsw.RECALL and pairs.shape[0] == 2
    got[parts[0].nodes] += x
    got[parts[1].nodes] += y
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_a_bad_graph_is_found_out(monkeypatch):
    v = crowds(np.random.default_rng(3), 3000, 20, 10, 24, 0.05)
    monkeypatch.setattr(hnsw.Graph, "search", lambda self, q, least, width: (np.zeros(0, np.int64),) * 2)
    bad = hnsw.shard(np.arange(len(v)), np.ones(len(v), int), v, 0.98)
    na, _, _, (recall, audited, exact) = hnsw.between(bad, bad, 0.98, True)
    assert bad.width == 0 and exact and recall == 1 and (na == linked(v)[bad.nodes]).all()
    # Its own audit passed, that of the real queries doesn't.
    na, _, _, (_, audited, exact) = hnsw.between(bad._replace(width=16), bad._replace(width=16), 0.98, True)
    assert audited > 0 and exact and (na == linked(v)[bad.nodes]).all()


def test_leaders():
    v = hnsw._unit(crowds(np.random.default_rng(4), 300, 5, 400, 8, 0.2))
    of = hnsw.led(v, 0.1)
    assert ((v * v[of]).sum(axis=1) >= math.cos(0.1) - 1e-12).all() and (of[of] == of).all()
    heads = np.unique(of)
    assert (np.triu(v[heads] @ v[heads].T, 1) < math.cos(0.1)).all()


def test_embeddings_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 200)
    rng = np.random.default_rng(10)
    base = rng.standard_normal((300, 16))
    v = np.concatenate([base, base[:150] + rng.standard_normal((150, 16)) * 0.05, base[0] + rng.standard_normal((100, 16)) * 0.05]).astype(np.float32)
    got = {r.vec_id: r for r in hnsw.near_duplicates(spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")).collect()}
    want = linked(v.astype(np.float64))
    assert all(got[i].n_links <= n for i, n in enumerate(want)) and all(r.recall >= hnsw.RECALL for r in got.values())
    assert np.mean([got[i].n_links / n for i, n in enumerate(want) if n]) >= 0.99


# 5


def targets_by_rule(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    stopped = set()
    while True:
        left, weight = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in stopped), sum(w[s] for s in order if s not in stopped)
        t = {s: 2.0 * sizes[s] if s in stopped else left * w[s] / weight for s in order}
        over = {s for s in order if s not in stopped and t[s] > 2 * sizes[s]}
        if not over:
            return t
        stopped |= over


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([0, 1, 5, 300, 3000]), None, rng.choice(["a", "a", "a", "b", "c", "d", None, "é"])) for i in range(120)]
    rows += [(1, "same id", None, "a"), (1, "same id", None, "a"), (None, "no id", None, "b"), (500, None, None, "empty")]
    d = docs(spark, rows)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(d).collect()))
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = targets_by_rule(sizes)
    by = mixing.plan(mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))).collect()
    assert all(math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9) for r in by)
    assert sum(r.taken for r in got) == sum(math.floor(t + 0.5) for t in want.values())
    texts = mixing.mixed_texts(d).collect()
    said = Counter()
    for r in texts:
        said[r.source] += len(r.text.split())
    assert said == Counter({s: math.floor(t + 0.5) for s, t in want.items() if t >= 0.5})
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [(1, "")])).first().taken == 0


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        t = spark.range(n).select("id", F.lit("s").alias("source"), F.lit(n).cast("long").alias("n"))
        there = mixing._shuffled(F.col("id"), F.col("n"), mixing._keys(F.col("n")))
        back = mixing._shuffled(F.col("there"), F.col("n"), F.reverse(mixing._keys(F.col("n"))))
        got = t.withColumn("there", there).withColumn("back", back).collect()
        assert sorted(r.there for r in got) == list(range(n)) and all(r.back == r.id for r in got)


# 6


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    t = tokencount.compile_model(MODEL)
    rng = random.Random(10)
    parts = ["a", " ", "  ", "the", "ing", "\n", "é", "日本", "😀", "0", "<s>", "▁", "    ", "(", "==", ".com", "\r\n", "́", "Zürich"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(3000)]
    mark = lambda x: tokencount.SPACE + x.replace(" ", tokencount.SPACE) if x else ""
    want = [len(x) for x in sp.encode(texts)]
    assert t.counts([mark(x) for x in texts]) == want
    for size in (1, 3, 16):  # composed from chunks of any size
        assert [t.count(mark(x), size) for x in texts[:400]] == want[:400]
    got = tokencount.token_counts(docs(spark, ODD), MODEL).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((i, len((x or "").encode()), n := len(sp.encode(x or "")), n > 4096) for i, x in ODD)


def test_tokens_of_long_runs():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    t = tokencount.compile_model(MODEL)
    mark = lambda x: tokencount.SPACE + x.replace(" ", tokencount.SPACE)
    texts = [" " * 1_000_000, "  a" * 30_000, "x" * 5000 + " " * 3001 + "the", "日" * 70_000, " " * 65_535 + "b" + " " * 65_537]
    assert t.counts([mark(x) for x in texts]) == [len(x) for x in sp.encode(texts)]
    rng = random.Random(3)
    for _ in range(200):  # the heap merges as the definition does
        x = "".join(rng.choice(["▁", "▁▁▁", "a", "e", "t", "h", " "]) for _ in range(rng.randrange(1, 16)))[:16]
        assert t._merged_long(list(x)) == t.merged(x)


# 7

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><a href="/">Home</a></nav>
<div class="layout"><div class="story s12"><h1>Head &amp; tail</h1><p>First  para
 with <b>bold</b> text.<p>Second&nbsp;one<br>goes on<ul><li>one<li>two</ul></div><div class="sidebar"><p>Side text</p></div>
<div class="comments"><p>I agree with all of this very long comment text that goes on and on.</p></div></div><form>q</form><footer>&copy; x</footer>"""


def test_html(spark):
    rows = [(i, f"https://h.example.org/{i}", PAGE) for i in range(4)] + [(9, "https://h.example.org/9", "<p>only this</p>"), (10, None, None), (11, "nonsense", "no markup &lt;b"), (11, "nonsense", "no markup &lt;b"), (12, "https://e.org", "<div><nav>x</nav></div>")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x"))).collect()
    by = {r.page_id: r.text for r in got}
    assert by[0] == "Head & tail\nFirst para with bold text.\nSecond one goes on\none\ntwo"
    assert by[9] == "only this" and by[10] == "" and by[11] == "no markup <b" and by[12] == "" and len(got) == 9
    assert all(r.n_chars == len(r.text) for r in got)


def sentence(rng):
    return " ".join("".join(rng.choice(["ka", "mo", "ri", "te", "lu", "sen", "pho"]) for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(12, 30))).capitalize() + "."


def site(rng, kind):
    """A page of one of several templates, and its article's lines."""
    s = [sentence(rng) for _ in range(12)]
    menu = "<nav><ul><li><a href='/a'>One</a><li><a href='/b'>Two</a></ul></nav>"
    talk = f"<div class='comments-area'><h3>Replies</h3>{''.join(f'<article class=comment><p>{sentence(rng)}</p></article>' for _ in range(9))}</div>"
    if kind == "sections":
        body = f"{menu}<article><h1>{s[0]}</h1><p>{s[1]}</p><div class='section s1'><p>{s[2]}</p><p>{s[3]}</p></div><div class='section s2'><p>{s[4]}</p><p>{s[5]}</p></div></article>{talk}"
        return body, s[:6]
    if kind == "intro":
        body = f"<div id=top class=site-header>{s[6]}</div><div class=post><h1>{s[0]}</h1><div class=intro><p>{s[1]}</p><p>{s[2]}</p></div><div class=text><p>{s[3]}</p><p>{s[4]}</p><p>{s[5]}</p></div></div><div class=sidebar><p>{s[7]}</p></div>{talk}<div id=footer>{s[8]}</div>"
        return body, s[:6]
    if kind == "policy":
        body = f"{menu}<div class='cookie-notice'><p>{s[9]}</p></div><div class='social-policy'><h2>{s[0]}</h2><p>{s[1]}</p><blockquote>{s[2]}</blockquote><ul><li>{s[3]}<li>{s[4]}</ul></div>"
        return body, s[:5]
    if kind == "topic":
        return f"{menu}<div class='post related-topic-search'><h1>{s[0]}</h1><p>{s[1]}</p><pre>{s[2]}</pre></div><footer>{s[5]}</footer>", s[:3]
    if kind == "quotes":
        return f"<main><p data-t='it's'>{s[0]}</p><p title=\"a>b\">{s[1]}</p><table><tr><td>{s[2]}<td>{s[3]}</table></main>{menu}", s[:4]
    # Columns without a telling class: the same text on page after page, links, and short lines are no article.
    body = f"<div id=a><p>{'The same words are here on each and every page of the host.'}</p></div><div id=content><h1>{s[0]}</h1><p>{s[1]}</p><p>{s[2]}</p></div><div id=b><h3>Latest</h3><ul><li><a href=x>{s[5]}</a><li><a href=y>{s[6]}</a></ul></div><div id=c><p>12 C</p><p>Sunny</p></div>"
    return body, s[:3]


def test_html_templates(spark):
    rng = random.Random(31)
    rows, want = [], {}
    for k, kind in enumerate(("sections", "intro", "policy", "topic", "quotes", "columns")):
        for i in range(8):
            body, lines = site(rng, kind)
            page_id = 100 * k + i
            rows.append((page_id, f"https://h{k}.example.org/{i}", f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"))
            want[page_id] = "\n".join(lines)
    rows += [(900 + i, "https://h0.example.org/x", rows[0][2]) for i in range(30)]  # copies of a page outvote nothing
    want |= {900 + i: want[0] for i in range(30)}
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("core", F.lit("x"))).collect()
    assert {r.page_id: r.text for r in got} == want
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_markup():
    def alone(page):
        found = htmltext.blocks(page)
        return htmltext.extracted(found, *htmltext.judged({k: s for k, (s, _) in htmltext.scores(found).items()}))

    assert alone("<article><p>a <svg><text>b</text></svg> <math><mi>x</mi></math> <object>o</object> <noscript>n</noscript><button>Go</button></article>") == ["a b x o n"]
    assert alone("<article><header><h1>Head</h1></header><p>Text</p><footer>by me</footer></article><header>Site</header>") == ["Head", "Text"]
    assert alone("<p>1 < 2 &amp;&lt; 3<!-- <p>no</p> --><p hidden>no</p><p>a<?php x ?>b</>c</p>") == ["1 < 2 &< 3", "abc"]
    assert alone("<body><div class=ad>Buy</div>") == [] and alone("<p class=>y<p =z>w") == ["y", "w"]
    assert alone("<p a='" + "x" * 200_000 + "<p>b") == ["b"] and alone("<p " * 20_000 + ">z") == ["z"]
    assert alone("<div>" * 3000 + "deep") == ["deep"]


# 8


def test_suffix_tree(spark):
    rng = random.Random(11)
    follow = {"a": ["b", "c"], "b": ["c"], "c": ["a", "d"], "d": ["a"]}

    def text():
        w = ["a"]
        while rng.random() < 0.95:
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    rows = [(i, text()) for i in range(600)] + [(900 + k, t) for k, (_, t) in enumerate(ODD)]
    got = suffixtree.score(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    count, texts = Counter(), 0
    for i, _ in rows:
        if not held[i]:
            count.update(words[i])
            texts += 1
    n, v = sum(count.values()) + texts, len(count) + 1
    for r in got:
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words[r.doc_id]) + math.log10((texts + 1) / (n + v + 1))
        assert r.held_out == held[r.doc_id] and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words[r.doc_id]) + 1, sum(w in count for w in words[r.doc_id]) + 1, n)
    out = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.score for r in out) > 0.6 * sum(r.base_score for r in out)  # both are negative
    assert suffixtree.score(docs(spark, [])).count() == 0


def slow_scores(train, texts):
    """log10 probabilities by the tree's definition, with dictionaries of word tuples."""
    S = suffixtree
    rows = [["<", *t, ">"] for t in train]
    count = Counter(w for r in rows for w in r[1:])
    n, types = sum(count.values()), len(count)
    named = {w for w, c in count.items() if c >= S.FLOOR or w == ">"}
    lower = {((), w): (count[w] - S.DISCOUNT0) / n for w in named}
    levels = []
    for k in range(1, S.DEPTH + 1):
        mass, pair = Counter(), Counter()
        for r in rows:
            for i in range(max(1, k), len(r)):
                c = tuple(r[i - k : i])
                if all(w == "<" or count[w] >= S.FLOOR for w in c):
                    mass[c] += 1
                    pair[c, r[i]] += r[i] in named
        mass = {c: m for c, m in mass.items() if m >= S.FLOOR}
        pair = {(c, w): m for (c, w), m in pair.items() if m >= S.PAIR and c in mass and (c[1:], w) in lower}
        own, seen, gain, p = Counter(), Counter(), Counter(), {}
        for (c, w), m in pair.items():
            own[c] += (m - S.DISCOUNT) / mass[c]
            seen[c] += m
        left = {c: max(1 - own[c], 1e-12) for c in mass}
        for (c, w), m in pair.items():
            p[c, w] = (m - S.DISCOUNT) / mass[c] + left[c] * lower[c[1:], w]
            gain[c] += m * math.log(p[c, w] / lower[c[1:], w])
        good = {c for c in mass if gain[c] + (mass[c] - seen[c]) * math.log(left[c]) >= S.GAIN}
        levels.append((good, left, p, lower))
        lower = p
    for k in range(S.DEPTH - 1, 0, -1):
        levels[k - 1][0].update(c[1:] for c in levels[k][0])
    out = []
    for t in texts:
        r, total = ["<", *t, ">"], 0.0
        for i in range(1, len(r)):
            x = (count[r[i]] - S.DISCOUNT0) / n if count[r[i]] else S.unseen(n, types)
            total += math.log10(x)
            for k in range(1, min(S.DEPTH, i) + 1):
                good, left, p, low = levels[k - 1]
                c = tuple(r[i - k : i])
                if c not in good:
                    break
                total += math.log10(left[c])
                if (c, r[i]) in p:
                    total += math.log10(p[c, r[i]] / left[c] / low[c[1:], r[i]])
        out.append(total)
    return out, sum(len(g) for g, *_ in levels)


def test_scores_against_the_definition(spark):
    rng = random.Random(41)
    follow = {a + b: rng.sample("abcdefg", 3) for a in "abcdefg" for b in "abcdefg"}  # of the second order, so long contexts tell

    def text():
        w = [rng.choice("abcdefg"), rng.choice("abcdefg")]
        while rng.random() < 0.96:
            w.append(rng.choice(follow[w[-2] + w[-1]]) if rng.random() < 0.9 else rng.choice(["rare", f"x{rng.randrange(300)}"]) if rng.random() < 0.2 else rng.choice("abcdefg"))
            if len(w[-1]) > 1:
                w.append(rng.choice("abcdefg"))
                w.append(rng.choice("abcdefg"))
        return w

    rows = [(i, text()) for i in range(500)] + [(1000, []), (1001, ["never", "seen"])]
    want, size = slow_scores([w for i, w in rows if zlib.crc32(str(i).encode()) % 7 != 2], [w for _, w in rows])
    got = {r.doc_id: r.score for r in suffixtree.score(docs(spark, [(i, " ".join(w)) for i, w in rows])).collect()}
    assert size > 40
    for (i, _), x in zip(rows, want, strict=True):
        assert math.isclose(got[i], x, rel_tol=1e-9)


def test_distributions_sum_to_one(spark):
    rows = [(i, "a b a c " * 20) for i in range(40)]
    train = docs(spark, rows)
    counts = Counter(w for _, t in rows for w in t.encode().split())
    symbols = sorted(counts.items())
    tree = suffixtree.grow(train, symbols, 40, sum(counts.values()) + 40, 4)
    assert any(map(len, tree.contexts))
    ids = [suffixtree.END, suffixtree.OTHER, *range(suffixtree.FIRST, suffixtree.FIRST + 3)]
    for before in ([suffixtree.BEGIN], [suffixtree.BEGIN, 3], [suffixtree.BEGIN, 3, 4], [suffixtree.BEGIN, 4, 3]):
        total = 0
        for s in ids:
            seq = np.array([*before, s])
            total += 10 ** suffixtree.token_logs(tree, seq, np.arange(len(seq)), tree.order0[seq])[-1]
        assert math.isclose(total, 1, rel_tol=1e-6)


def test_tree_grows_with_the_input(spark, monkeypatch):
    rng = random.Random(12)
    # 12 occurrences in over 400,000 tokens: far below a share of 5e-5.
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(1000))) for i in range(400)]
    rows += [(1000 + i, "qa qb qc") for i in range(12)] + [(2000, "qa qb qc"), (2001, "qa qc qb")]
    d = docs(spark, [r for r in rows if r[0] >= 2000 or zlib.crc32(str(r[0]).encode()) % 7 != 2])
    got = {r.doc_id: r.score for r in suffixtree.score(d).collect()}
    assert got[2000] > got[2001] + 3
    # What is sent and what is joined changes nothing.
    for most in (0, 1000):
        monkeypatch.setattr(suffixtree, "SENT", most)
        again = {r.doc_id: r.score for r in suffixtree.score(d).collect()}
        assert again.keys() == got.keys() and all(math.isclose(again[i], got[i], rel_tol=1e-9) for i in got)


def test_counts_go_in_blocks(spark, monkeypatch):
    """Blank ends, other scripts and words that are begun by a blank of no ASCII are split as bytes are; blocks and pieces of any size change no count."""
    rows = [(0, " a  B\tb\n"), (1, ""), (2, " \n "), (3, "É é \u00a0x \x1fa a"), (4, "b " * 700)]
    want = Counter(w for _, t in rows for w in t.encode().lower().split())
    d = docs(spark, rows).select("doc_id", F.lit(False).alias("held_out"), "text")
    for held in (suffixtree.HELD, 3):
        monkeypatch.setattr(suffixtree, "HELD", held)
        monkeypatch.setattr(suffixtree, "SYMBOLS", held)
        coded = suffixtree._coded(d, suffixtree.Hashed())
        got = suffixtree.word_counts(coded, sum(want.values())).collect()
        assert len(got) == len(want) and {r.symbol: r.n for r in got} == {suffixtree.Hashed()[w]: n for w, n in want.items()}
        sizes = {r.doc_id: (r.size, len(r.symbols)) for r in coded.collect()}
        assert sizes == {i: (len(t.encode().split()), 8 * len(t.encode().split())) for i, t in rows}


# 9


def test_secrets(spark):
    base = {"assign": re.compile(secrets.ASSIGN), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    least = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    rng = random.Random(12)
    parts = ["token", ": ", "=", "password", '"', "abcdef012345", "AKIA", "ABCDEFGH1234567", "é", " ", "API_key", "0123456789abcdef", "x" * 12, "\n", "secret"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(300)] + [(1000 + k, t) for k, (_, t) in enumerate(ODD)]
    got = secrets.report(docs(spark, rows)).collect()
    by = {}
    for i, t in rows:
        found = sorted((m.start(), k, m.end()) for k, kind in enumerate(base) for m in base[kind].finditer(t or "") if least[kind](m))
        by[i] = ",".join(f"{list(base)[k]}:{s}:{e}" for s, k, e in found)
    for r in got:
        assert r.base_sha256 == hashlib.sha256(by[r.doc_id].encode()).hexdigest()
        assert set(filter(None, by[r.doc_id].split(","))) <= set(r.spans.split(","))
    weak = "Abcdefghijklmnopqrstuvw1234"
    two = docs(spark, [(1, f"login: bob at https://x.org/a {weak}"), (2, f"just {weak} here"), (3, "login: bob alone"), (4, f"login: bob {'y ' * 200} {weak}"), (5, None)])
    spans = {r.doc_id: r.spans for r in secrets.report(two).collect()}
    assert [x.split(":")[0] for x in spans[1].split(",")] == ["ident", "endpoint", "secret"] and spans[2] == spans[3] == spans[4] == spans[5] == ""
    masked = {r.doc_id: r for r in secrets.redact(two).collect()}
    assert weak not in masked[1].text and masked[1].n_chars == len(masked[1].text) and masked[2].text == f"just {weak} here" and masked[5].text is None
    assert secrets.redact(two).columns == two.columns


def slow_spans(text):
    """All reported spans, by comparing every pair."""
    of = {"assign": secrets.ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "ident": secrets.IDENT, "secret": secrets.SECRET, "endpoint": secrets.ENDPOINT}
    f = {k: list(re.finditer(p, text)) for k, p in of.items()}
    f["assign"] = [m for m in f["assign"] if len(m[2]) >= 12]
    f["access"] = [m for m in f["access"] if len(m[0]) >= 18]
    f["hex"] = [m for m in f["hex"] if len(m[0]) >= 16]
    near = lambda kinds, m, n: any(o.start() < m.end() + n and m.start() < o.end() + n for k in kinds for o in f[k])
    base = ["assign", "access", "hex"]
    f["secret"] = [m for m in f["secret"] if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]")) and not near(base, m, 0)]
    f["ident"] = [m for m in f["ident"] if not near(base, m, 0)]
    secret, ident, n = ["assign", "hex", "secret"], ["access", "ident"], secrets.SCOPE
    kept = {k: f[k] for k in base}
    kept["ident"] = [m for m in f["ident"] if near(secret, m, n)]
    kept["secret"] = [m for m in f["secret"] if near([*ident, "endpoint"], m, n)]
    kept["endpoint"] = [m for m in f["endpoint"] if near(ident, m, n) and near(secret, m, n)]
    return [(s, k, e) for s, i, e, k in sorted((m.start(), secrets.KINDS.index(k), m.end(), k) for k in kept for m in kept[k])]


def slow_mask(text, spans):
    at, out = 0, ""
    for s, _, e in spans:
        if s >= at:
            out += text[at:s] + secrets.MASK
        at = max(at, e)
    return out + text[at:]


def test_linked_parts_against_brute_force(spark):
    rng = random.Random(21)
    parts = ["token", ": ", "=", "password", '"', "abcdef012345", "AKIA", "ABCDEFGH1234567", "é", " ", "API_key", "0123456789abcdef", "x" * 12, "\n", "login: bob ", "https://x.org/a ", "Abcdefghijklmnopqrstuvw1234 ", "日" * 50]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60) if i % 40 else 3000)), "mine", 5, "t") for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, secret string, all_ int, text_ string").withColumns({"row_": F.lit(3), "hex": F.lit("h"), "masked_": F.lit("m"), "n_chars": F.lit(1)})
    want = {i: slow_spans(t) for i, t, *_ in rows}
    assert {r.doc_id: r.spans for r in secrets.report(d).collect()} == {i: ",".join(f"{k}:{s}:{e}" for s, k, e in x) for i, x in want.items()}
    masked = secrets.redact(d)
    assert masked.columns == d.columns
    for r, (i, t, *_) in zip(masked.orderBy("doc_id").collect(), rows, strict=True):
        assert r.text == slow_mask(t, want[i]) and (r.secret, r.all_, r.text_, r.row_, r.hex, r.masked_) == ("mine", 5, "t", 3, "h", "m")
        assert r.n_chars == (len(r.text) if want[i] else 1)


def test_many_matches(spark):
    n = 100_000
    d = spark.createDataFrame([(1, "0123456789abcdef01 " * n), (2, "login: bob https://x.org/a Abcdefghijklmnopqrstuvw1234 " * (n // 3))], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.report(d).collect()}
    assert got[1].n_hex == n and got[2].spans.count(",") == 3 * (n // 3) - 1
    assert secrets.redact(d).where("doc_id = 1").first().text == f"{secrets.MASK} " * n


# 10


def test_decontamination(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice(["ka", "mo", "ri", "te", "lu", "sen", "pho"]) for _ in range(rng.randrange(2, 5)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(14, 40)))) for i in range(12)]
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, filler(120)) for i in range(80)]
    for i, t in items:
        rows.append((100 + i, f"{filler(70)} {t} {filler(30)}"))
        w = [x for x in t.split() if rng.random() > 0.12]
        rows.append((200 + i, f"{filler(20)} {' '.join(w)} {filler(200)}"))
    bench = spark.createDataFrame([*items, (99, None), (98, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in lsa.leaks(docs(spark, [*rows, *((900 + k, t) for k, (_, t) in enumerate(ODD))]), bench).collect()}
    assert {(100 + i, i) for i, _ in items} <= got
    assert sum((200 + i, i) in got for i, _ in items) >= 11
    assert not {d for d, _ in got if d < 100 or d >= 900}
    clean = lsa.keep(docs(spark, rows), bench)
    assert clean.where("doc_id < 100").count() == 80 and clean.where("doc_id between 100 and 111").count() == 0
    assert lsa.leaks(docs(spark, rows), bench.limit(0)).count() == 0 and lsa.leaks(docs(spark, []), bench).count() == 0


def held_share(item, text, idf):
    """Share of an item's weight in its heaviest common subsequence with any stretch of a text twice its length, by plain dynamic programming."""
    best = [0.0] * (len(text) + 1)
    for w in item:
        last = best[:]
        for j, x in enumerate(text, 1):
            best[j] = max(last[j], best[j - 1], last[j - 1] + idf[w] if x == w else 0.0)
    return best[-1] / sum(idf[w] for w in item)


def test_candidates_against_every_pair(spark):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice(["ka", "mo", "ri", "te", "lu", "sen", "pho"]) for _ in range(rng.randrange(2, 5)))
    common_words = [word() for _ in range(30)]
    text = lambda n: [rng.choice(common_words) if rng.random() < 0.5 else word() for _ in range(n)]
    items = {i: text(rng.randrange(16, 40)) for i in range(25)}
    rows, planted = [], {}
    for k in range(200):
        w = text(60)
        if k % 2:
            i = rng.randrange(25)
            part = [x if rng.random() > 0.2 else word() for x in items[i]] if k % 4 == 1 else items[i][: int(len(items[i]) * 0.8)]
            w[20:20] = part
            planted[k] = i
        rows.append((k, " ".join(w)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    d = docs(spark, rows)
    got = {(r.doc_id, r.item_id) for r in lsa.leaks(d, bench).collect()}
    df = Counter(w for _, t in rows for w in set(t.split()))
    idf = {w: math.log((len(rows) + 1) / (df[w] + 1)) + 1e-3 for x in items.values() for w in x}
    share = {(k, i): held_share(w, t.split(), idf) for k, t in rows for i, w in items.items()}
    assert all(share[p] >= lsa.HELD for p in got)  # what is reported holds so much by the plain count too
    sure = {p for p, x in share.items() if x >= 0.75}  # in one passage, as nothing else puts so much together
    assert sure <= {(k, i) for k, i in planted.items()} and len(sure) > 40
    # Those whose last quarter holds half of its weight, or most of the item in one piece: the rest lacks the answer.
    answered = {(k, i) for k, i in sure if held_share(items[i][-(len(items[i]) // 4) :], dict(rows)[k].split(), idf) >= 0.6 or k % 4 == 3}
    assert len(answered & got) >= 0.95 * len(answered) and len(answered) > 40
    weight = lambda w: sum(idf[x] for x in w)
    cut = {(k, i) for k, i in planted.items() if k % 4 == 3 and weight(items[i][: int(len(items[i]) * 0.8)]) >= 0.62 * weight(items[i])}
    assert cut <= got and len(cut) > 30  # without their ends, word for word
    assert {d_ for d_, _ in got} <= set(planted)


def test_items_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(12)], "item_id long, text string")
    d = docs(spark, [(i, "some filler words " + " ".join(f"w{i}x{k}" for k in range(20)) + " more") for i in range(15)])
    whole = {tuple(r)[:2] for r in lsa.leaks(d, bench).collect()}
    monkeypatch.setattr(lsa, "ITEM_WORDS", 100)
    assert len(lsa.item_blocks(bench)) > 2
    assert {tuple(r)[:2] for r in lsa.leaks(d, bench).collect()} == whole == {(i, i) for i in range(12)}
    assert sorted(r.doc_id for r in lsa.keep(d, bench).collect()) == [12, 13, 14]


def test_common_subsequence():
    rng = random.Random(14)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        at = lsa.common(a, b)
        assert len(at) == best[-1][-1] and at == sorted(set(at))


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 11))


def test_decontamination_model_is_of_no_sample(spark):
    """The same texts under other ids, more of them than were ever sampled, give the same model; an item may be of one word."""
    from stratagraph.llm import lsa

    items = spark.createDataFrame([(1, "the red fox jumps over nine lazy dogs today"), (2, "zebra")], "item_id long, text string")
    text = F.when(F.col("k") % 3 == 0, "the red fox sleeps").when(F.col("k") % 3 == 1, "nine dogs jumps over a zebra").otherwise("today")
    a, b = (lsa.fit(spark.range(6000).withColumn("k", F.col("id")).select((F.col("id") + by).alias("doc_id"), text.alias("text")), items) for by in (0, 1_000_000))
    assert (a.idf == b.idf).all()
    assert (a.basis == b.basis).all()


def test_pairs_that_occur_once_are_not_counted(spark, monkeypatch):
    S = suffixtree
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, 40)) + (" w1 w2" if i % 2 else "")) for i in range(40)]
    d = docs(spark, rows).withColumn("held_out", F.lit(False)).select("doc_id", "held_out", "text")
    number = S.Hashed()
    pairs = Counter()
    for _, t in rows:
        ids = [S.BEGIN, *(number[w.encode()] for w in t.split()), S.END]
        pairs.update(zip(ids, ids[1:]))
    every = np.full(1 << (S.BITS - 6), (1 << 64) - 1, np.uint64)
    keys = {p: int(S._pair(S._grown(np.zeros(1, np.uint64), np.array(p[:1])), np.array(p[1:]))[0]) for p in pairs}
    coded = S._coded(d, number)
    for held in (S.HELD, 3):
        monkeypatch.setattr(S, "HELD", held)
        passed = S._maybe(S._again(coded, 1, every, None, None, 4, 4), np.array(list(keys.values()), np.uint64))
        assert all(ok for ok, p in zip(passed, keys) if pairs[p] >= S.PAIR)
        assert sum(ok for ok, p in zip(passed, keys) if pairs[p] < S.PAIR) <= 2 < sum(n < S.PAIR for n in pairs.values()) / 10


def test_decontamination_model_is_of_all_passages(spark):
    """Words that stand together in documents stand together in the model, wherever the documents that say so are; frequencies alone don't tell."""
    items = spark.createDataFrame([(k, f"w{k}") for k in range(120)], "item_id long, text string")

    def model(step):
        pairs = [f"w{k} w{(k + step) % 120}" for k in range(0, 120)]
        return lsa.fit(docs(spark, [(i, p) for i, p in enumerate(pairs * 3)]), items)

    a, b = model(1), model(7)
    assert (a.idf == b.idf).all() and not np.allclose(a.basis @ a.basis.T, b.basis @ b.basis.T, atol=0.05)


def test_passages_are_added_up_whole():
    rng = np.random.default_rng(3)
    found = [rng.integers(-1, 9, n) for n in (0, 1, 31, 32, 33, 5000, 64)] + [np.full(70, -1)] + [rng.integers(-1, 9, 40) for _ in range(300)]
    test, y, want = rng.integers(-60, 60, (9, 5)).astype(np.int32), np.zeros((9, 5), np.int64), np.zeros((9, 5), np.int64)
    for ids in found:
        for a in range(0, len(ids), lsa.PASSAGE):
            part = ids[a : a + lsa.PASSAGE]
            c = np.bincount(part[part >= 0], minlength=9)
            if c.sum():
                want += np.outer(c, (c @ test) * max(1, lsa.WEIGHT // c.sum() ** 2))
    lsa._add(found, test, y)
    assert (y == want).all()


def test_words_are_packed_well(spark):
    """What is written of the words is less than by the session's codec."""
    pick = random.Random(8)
    rows = docs(spark, [(i, " ".join(f"w{int(pick.paretovariate(0.7))}" for _ in range(400))) for i in range(200)]).withColumn("held_out", F.lit(False)).coalesce(1)
    coded = suffixtree._coded(rows, suffixtree.Hashed())
    size = lambda t: sum(f.stat().st_size for f in Path(t.folder).glob("*.parquet"))
    plain = common.written(coded, "plain")
    assert size(coded) < 0.9 * size(plain)
    assert sorted(map(tuple, coded.collect())) == sorted(map(tuple, plain.collect()))
    common.discard(coded, plain)
