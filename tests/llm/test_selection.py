"""Exact duplicates, importance resampling and hard negatives against brute force and on awkward input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.llm import contentsort, distancekeys, resample

DOCS = "doc_id long, text string, h_ long, piece_ int, keep_id long, text_ string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (4, "word"), (None, "two words"), (None, "word"), (5, "é" * 50_000), (6, "a " * 30_000), (7, "é" * 50_000), (8, "Word")]


def docs(spark, rows):
    """Further columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], DOCS)


# 13


def duplicates(rows):
    """``doc_id, keep_id, group_size, text_sha256`` and, for each text, how many rows stay."""
    ids = {}
    for i, t in rows:
        ids.setdefault(t or "", []).append(i)
    top = {t: max((i for i in k if i is not None), default=None) for t, k in ids.items()}
    return sorted(((i, top[t or ""], len(ids[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("case", ["odd", "hot", "empty"])
def test_exact_duplicates(spark, case):
    heads = [(i, "the same first words of many texts, and then " + str(i % 40)) for i in range(200)]
    rows = {"odd": ODD, "hot": heads + [(1000 + i, "hot") for i in range(700)] + [(5000, "hot")] * 3 + ODD, "empty": []}[case]
    got = contentsort.groups(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == duplicates(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)


def test_pieces_of_long_copies(spark, monkeypatch):
    """Copies of a long text are cut into pieces, and come together again."""
    monkeypatch.setattr(contentsort, "HELD", 10_000)
    rows = [(i, "long " * 2000) for i in range(30)] + [(100 + i, f"{i} " * 10) for i in range(50)]
    got = contentsort.groups(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == duplicates(rows)
    assert [r.doc_id for r in got if r.kept and r.group_size > 1] == [29]


def test_keep_one(spark):
    d = docs(spark, ODD)
    kept = contentsort.keep_one(d, normalise=F.lower, largest=False)
    assert kept.schema == d.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 5, 6, None]


# 12


def resampled(rows, target, n, percent=10, least=20):
    """The draw by its definition."""

    def parts(t):
        w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in parts(x)[1]) for texts in ([x for _, x in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for i, x in rows:
        words, f = parts(x)
        weight = sum(gain(bucket(y)) for y in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    fit = sorted((-r[3], r[0] is None, r[0] or 0) for r in out if r[4] >= least)[: percent * sum(r[4] >= least for r in out) // 100]
    return sorted((r[:4] for r in out), key=str), fit


@pytest.mark.parametrize("n", [1, 2])
def test_resampling(spark, n, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "x" * 300]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 19, 20, 45])))) for i in range(120)] + [(500, "same words " * 20)] * 3 + ODD
    target = [None, "", *(" ".join(rng.choices(vocabulary[:12], k=30)) for _ in range(9))]
    want, drawn = resampled(rows, target, n)
    for share in (1 << 20, 40):  # nearly all strings are sent; few are
        monkeypatch.setattr(resample, "SHARE", share)
        got = resample.resample(docs(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), n=n).collect()
        assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=str) == want
        ranked = sorted((r.rank, r.score, r.doc_id) for r in got if r.rank)
        assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1)) and [(-s, i is None, i or 0) for _, s, i in ranked] == drawn


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs(spark, []), none).count() == 0
    got = resample.resample(docs(spark, [(1, "one two"), (2, None)]), none, percent=100, least_words=0).collect()
    assert sorted(r.rank for r in got) == [1, 2] and {r.n_features for r in got} == {0, 2}


# 11

VECTORS = "vec_id long, embedding array<float>, label int, ask long, score long, slot int"


def mined(rows):
    """Hard negatives by their definition; ``rows`` of ``id, vector, label`` that take part."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, v, y in good:
        if i % 5:
            continue
        scored = sorted((-dot(v, w), j, z == y) for j, w, z in good if j != i)
        for p, j, _ in [x for x in scored if x[2]][:5]:
            ok = [x for x in scored if not x[2] and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k, _) in enumerate(ok)]
    return sorted(out)


@pytest.mark.parametrize("case", ["clusters", "hot", "odd", "long"])
def test_hard_negatives(spark, case, monkeypatch):
    for name, value in {"BLOCK": 16, "ASK": 8, "EACH": 12, "REACH": 1, "MORE": 3}.items():
        monkeypatch.setattr(distancekeys, name, value)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.3).tolist(), int(rng.integers(3))) for i in range(150)]
    bad = []
    if case == "hot":
        rows += [(1000 + i, rows[0][1], i % 3) for i in range(150)]
    if case == "odd":
        bad = [(None, [1.0] * 8, 1), (901, None, 1), (902, [1.0, None], 1), (903, [float("nan")] * 8, 1), (904, [float("inf")] * 8, 1), (905, [1.0] * 8, None)]
        rows += [(906, [0.0] * 8, 1), (910, [], 1), (911, [3.0], 2), (915, [0.5, 0.25], 0), (920, [1.0] * 12, 2)]
        bad += [rows[3], rows[5]]  # repeated rows
    if case == "long":
        rows = [(i, (np.array(v) * 2**18).tolist(), y) for i, v, y in rows]  # scores beyond what doubles hold
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows + bad], VECTORS)
    got = distancekeys.mine(table, F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows)


def test_no_hard_negatives(spark):
    none = distancekeys.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 5 == 0)
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert distancekeys.mine(spark.createDataFrame([(1, [1.0], 1, 1, 1, 1)], VECTORS), F.col("vec_id") % 5 == 0).count() == 0
    with pytest.raises(Exception, match="fit a long"):
        distancekeys.mine(spark.createDataFrame([(5, [1e30], 1, 1, 1, 1)], VECTORS), F.col("vec_id") % 5 == 0).count()


def test_blocks_that_are_passed_over(spark, monkeypatch):
    """Far clusters are not compared, and the result is whole all the same."""
    for name, value in {"BLOCK": 16, "ASK": 4, "EACH": 10, "REACH": 2, "MORE": 4}.items():
        monkeypatch.setattr(distancekeys, name, value)
    compared = spark.sparkContext.accumulator(0)
    scan = distancekeys._scan

    def counted(*args):
        run = scan(*args)

        def seen(batches):
            def each():
                for b in batches:
                    compared.add(b.num_rows)
                    yield b

            yield from run(each())

        return seen

    monkeypatch.setattr(distancekeys, "_scan", counted)
    rng = np.random.default_rng(3)
    centres = np.linalg.qr(rng.normal(size=(10, 10)))[0]
    rows = []
    for i in range(300):
        v = centres[i % 10] + rng.normal(size=10) * 0.01
        rows.append((i, (v / np.linalg.norm(v)).tolist(), i % 10))
    index = distancekeys.Index(spark.createDataFrame([(i, y, [math.floor(256 * x) for x in v], i % 5 == 0) for i, v, y in rows], "vec_id long, label long, ints array<long>, anchor boolean"))
    asked = index.anchors().withColumns({"slot": F.lit(0), "low": F.lit(-(1 << 60)), "high": F.lit(1 << 60)})
    index.search(asked, 5, True).count()
    assert 0 < compared.value < 0.7 * index.blocks.count() * index.asks.count()
