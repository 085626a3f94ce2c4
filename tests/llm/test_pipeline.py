"""The pipeline's stages and the whole, the mix by row, and items of any length in op10."""

import random
import time
import tracemalloc

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stratagraph.llm import langid, lsa, mixing, secrets, simhash
from stratagraph.llm.common import remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, taken int"
VOICE = {"en": "the cat sat on mat and looked at dog with great interest until evening came over hills again".split(), "de": "der hund lief durch den wald und suchte seinen knochen bis nacht über das dorf kam wieder heim".split()}


def table(spark, rows):
    """Further columns have names that stages use inside."""
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), 1, "r", 2) for i, t, lang, source in rows], DOCS)


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(80):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, " ".join(rng.choices(VOICE[lang], k=rng.choice([20, 60, 300]))), lang if i % 4 else None, f"s{i % 3}" if i % 7 else None))
    item = " ".join(f"question{i} topic{i * 3}" for i in range(30))
    rows += [(100, rows[1][1], "en", "s1"), (101, rows[1][1], "en", "s1"), (101, rows[1][1], "en", "s1"), (102, f"{rows[2][1]} {item} {rows[4][1]}", "en", "s0"), (103, rows[5][1] + " password = Abcdef123456789", "en", "s2")]
    rows += [(110, None, "en", "s0"), (111, "", None, None), (112, "12 34 !!", "en", "s1"), (None, rows[7][1] + " hills", "en", "s1"), (113, "the dog " * 4000, "en", "s0")]
    return rows, item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    rows, item = corpus()
    table(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_against_their_operators(spark, folder):
    """Each stage's rows are those that its operator's own report names, with all columns as they were."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = lambda d: sorted(map(str, d.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.simpleString() == docs.schema.simpleString(), name
    model = langid.fit(docs.where(remainder("doc_id", 5) != 0), public_tokenizers.path("piece_bpe_32k.model"))
    told = langid.predict(docs, model).where(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_SCORE}")
    got = corpus_pipeline.language(spark, docs, folder)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in told.collect())
    found = simhash.near_duplicates(docs)
    got = corpus_pipeline.near_duplicates(spark, docs, folder).collect()
    # A component without any id keeps a row too.
    assert len(got) == found.select("component_id").distinct().count() == len({r.doc_id for r in got})
    assert {r.doc_id for r in got} == {r.component_id for r in found.collect()}
    bad = {r.doc_id for r in lsa.leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert bad == {102} and {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, folder).collect()} == {r[0] for r in corpus()[0]} - bad
    masked = {r.doc_id: r.text for r in corpus_pipeline.mask_secrets(spark, docs, folder).collect()}
    assert "Abcdef123456789" not in masked[103] and secrets.MASK in masked[103] and masked[0] == corpus()[0][0][1]
    mixed, want = corpus_pipeline.mix(spark, docs, folder), mixing.mix(docs).where("taken > 0")
    assert mixed.columns == [*docs.columns, "taken_words"]
    pairs = lambda d, c: sorted((str(r.doc_id), r[1]) for r in d.select("doc_id", c).collect())
    assert pairs(mixed, "taken_words") == pairs(want, "taken")
    assert set(rows(mixed.drop("taken_words"))) <= set(rows(docs))


def test_whole(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and not {100, 101, 102, 110, 111, 112} & set(ids)
    assert all("Abcdef123456789" not in r.text and r.taken_words > 0 and r.row == "r" for r in got)
    assert sorted(map(str, got)) == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))


def test_empty(spark, folder):
    none = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_mix_by_row(spark):
    """Words that the slots take of each row, counted one by one along its source."""
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 3, 100, 256, 700]))), None, rng.choice(["a", "b", None])) for i in range(40)] + [(7, "w w w", None, "a")] * 2
    docs = table(spark, rows)
    placed = sorted(mixing.placed(docs).collect(), key=str)
    planned = mixing.plan(mixing.targets(mixing.placed(docs).groupBy("source").agg(F.sum("size").alias("source_size"))))
    along = {}
    for s in mixing.slots(planned).collect():
        for w in range(s.block * mixing.BLOCK, s.block * mixing.BLOCK + s.words):
            along[s.source, w] = along.get((s.source, w), 0) + 1
    want = sorted((str(r.doc_id), r.size, sum(along.get((r.source, w), 0) for w in range(r.first, r.first + r.size))) for r in placed)
    assert sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(docs).collect()) == want
    kept = mixing.keep(docs)
    assert sorted((str(r.doc_id), len(r.text.split()), r.taken_words) for r in kept.collect()) == [x for x in want if x[2]]


def longest(a, b):
    """Traced back in a whole table of lengths."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
    out, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            out.append(i - 1)
            i, j = i - 1, j - 1
    return out[::-1]


def test_common_in_blocks(monkeypatch):
    rng = random.Random(3)
    for held in (1, 40, 1 << 22):
        monkeypatch.setattr(lsa, "HELD_NUMBERS", held)
        for _ in range(40):
            a, b = ([rng.randrange(5) for _ in range(rng.randrange(25))] for _ in range(2))
            assert lsa.common(a, b) == longest(a, b)


def test_very_long_item(spark):
    """An item of many thousand words, among short ones: memory stays flat, and it is found."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 900, 6000).tolist()
    b = [x for x in a if rng.random() > 0.1]
    tracemalloc.start()
    began = time.perf_counter()
    assert len(lsa.common(a, b)) == len(b)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20 and time.perf_counter() - began < 60
    tracemalloc.stop()
    words = [f"w{x}" for x in rng.integers(0, 3000, 8000)]
    items = [(0, " ".join(words)), *((i, " ".join(f"w{x}" for x in rng.integers(0, 3000, 30))) for i in range(1, 12))]
    docs = [(1, " ".join(words)), (2, items[3][1]), (3, " ".join(words[:2000])), *((10 + i, " ".join(f"w{x}" for x in rng.integers(0, 3000, 60))) for i in range(60))]
    got = lsa.leaks(table(spark, [(i, t, None, None) for i, t in docs]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 0), (2, 3)}
