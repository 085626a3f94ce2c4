"""Hard negatives by inner product, searched by one-dimensional distance keys (after Yu et al., 2001).

One more component makes all vectors equally long, so that the greater an inner product with an anchor, the smaller the
distance to it. Every vector belongs to its nearest pivot and is stored sorted by (pivot, distance to it), in blocks of
consecutive keys; the blocks of a pivot form rings. By the triangle inequality an anchor's distance to a pivot bounds its inner
products with all that lies in an interval of keys, from above and from below.

A search wants the first k by score within an interval of scores (all scores for positives; for negatives those that are near
enough to a positive's, an annulus around the anchor). It scans the rings that promise most, then ever more of them, and
ends where no ring's bound reaches the score that the k-th found has: nothing else can be among the first k. Scores are exact.

Anchors are searched in blocks: a round plans which rings each of their blocks needs, joins those rings' blocks, and a task
compares one block of anchors with one block of vectors. Only the k best of each are kept, whatever the blocks hold.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Vectors of a block, anchors of one, and numbers in either, at most.
BLOCK, ASK, NUMBERS = 4096, 1024, 1 << 19
#: Pivots, rings of a pivot, vectors for each pivot at least, and vectors of the sample that pivots are fitted on.
PIVOTS, RINGS, EACH, FIT_ROWS = 64, 64, 512, 4096
#: Rings that an anchor scans in the first round, and by how much later ones scan more.
REACH, MORE = 8, 32
#: Distances are widened by this share of the longest vector, so that rounding loses nothing.
SLACK = 1e-6
#: Anchors that are compared at a time.
STEP = 256

_WANTS = "array<struct<anchor_id:bigint,slot:int,low:bigint,high:bigint,floor:bigint>>"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles; short ones end in zeros."""
    out = np.zeros((len(column), dim))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _pivots(rows: DataFrame, n: int, dim: int, longest: float) -> np.ndarray:
    """Centres of a sample, with the further component last."""
    want = max(1, min(FIT_ROWS, (NUMBERS * 8) // dim))
    sample = rows.select("ints") if n <= want else rows.select("ints").sample(want / n, seed=11)
    sample = sample.limit(2 * want).toArrow().column(0).combine_chunks()
    x = _matrix(sample, dim) if len(sample) else np.zeros((1, dim))
    x = _lengthened(x, longest)
    rng = np.random.default_rng(5)
    k = int(min(PIVOTS, max(1, n // EACH), len(x)))
    p = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        near = _gaps(x, p).argmin(axis=1)
        for i in range(k):
            if (near == i).any():
                p[i] = x[near == i].mean(axis=0)
    return p


def _gaps(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * (x @ p.T), 0))


def _keyed(dim: int, longest: float, pivots: np.ndarray):
    """Adds ``pivot, gap``: the nearest pivot, and the distance to it."""

    def run(batches):
        for b in batches:
            x = _matrix(b.column("ints"), dim)
            d = _gaps(_lengthened(x, longest), pivots)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], [*b.schema.names, "pivot", "gap"])

    return run


def _cut(size: int, dim: int, kind: str, apart: bool):
    """Blocks of consecutive rows; of one pivot each, if they are kept ``apart``."""

    def block(t: pa.Table):
        order = np.argsort(ids := t.column("vec_id").to_numpy(), kind="stable")  # the first of equals has the smallest id
        gap = t.column("gap").to_numpy()
        data = _matrix(t.column("ints").combine_chunks(), dim)[order].astype(kind)
        return {"pivot": t.column("pivot")[0].as_py(), "low": gap.min(), "high": gap.max(), "ids": ids[order].astype("<i8").tobytes(), "labels": t.column("label").to_numpy()[order].astype("<i8").tobytes(), "data": data.tobytes()}

    def run(batches):
        held: list[pa.Table] = []
        n = 0

        def out():
            nonlocal held, n
            t, held, n = pa.concat_tables(held), [], 0
            return pa.RecordBatch.from_pylist([block(t)], schema=pa.schema([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("data", pa.binary())]))

        for b in batches:
            t, at = pa.Table.from_batches([b]), 0
            pivot = t.column("pivot").to_numpy()
            while at < len(pivot):
                if held and (n == size or (apart and held[-1].column("pivot")[-1].as_py() != pivot[at])):
                    yield out()
                end = min(len(pivot), at + size - n)
                if apart:
                    end = at + int(np.searchsorted(pivot[at:end], pivot[at], side="right"))
                held.append(t.slice(at, end - at))
                n, at = n + end - at, end
        if held:
            yield out()

    return run


def _wants(b: pa.RecordBatch, i: int) -> pd.DataFrame:
    return pd.DataFrame({f.name: b.column("wants")[i].values.field(f.name).to_numpy(zero_copy_only=False) for f in b.schema.field("wants").type.value_type})


def _bounds(q: np.ndarray, longest: float, gap: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of anchors with what lies ``low`` to ``high`` from a pivot that they are ``gap`` away from."""
    wide = SLACK * longest**0.5
    near = np.maximum(np.maximum(gap - high, low - gap) - wide, 0)
    whole = (q**2).sum(axis=1)[:, None] + longest
    return (whole - (gap + high + wide) ** 2) / 2 - 1, (whole - near**2) / 2 + 1


def _lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes them equally long."""
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))])


def _asked(q: np.ndarray) -> np.ndarray:
    """Anchors have none of it: the further component takes no part in inner products."""
    return np.column_stack([q, np.zeros(len(q))])


def _plan(dim: int, kind: str, longest: float, pivots: np.ndarray, rings: np.ndarray, reach: int):
    """``ask, ring``: the rings that a block of anchors scans next; each anchor names ``reach`` of those that it still needs."""
    number, of, low, high = rings[:, 0].astype(int), rings[:, 1].astype(int), rings[:, 2], rings[:, 3]

    def run(batches):
        for b in batches:
            asks, found = [], []
            for i in range(b.num_rows):
                ids, w = np.frombuffer(b.column("ids")[i].as_py(), "<i8"), _wants(b, i)
                q = np.frombuffer(b.column("data")[i].as_py(), kind).reshape(-1, dim).astype(float)
                at = np.searchsorted(ids, w.anchor_id)
                least, most = _bounds(q, longest, _gaps(_asked(q), pivots)[:, of], low, high)
                seen = np.isin(number, np.array(b.column("seen")[i].as_py() or [], int))
                chosen = np.zeros(len(number), bool)
                for s in range(0, len(w), STEP):
                    k = at[s : s + STEP]
                    need = (most[k] >= w.floor.to_numpy()[s : s + STEP, None]) & (least[k] <= w.high.to_numpy()[s : s + STEP, None]) & ~seen
                    order = np.argsort(-np.where(need, most[k], -np.inf), axis=1, kind="stable")[:, :reach]
                    chosen[order[np.take_along_axis(need, order, axis=1)]] = True
                asks += [b.column("ask")[i].as_py()] * int(chosen.sum())
                found += number[chosen].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(asks, pa.int64()), pa.array(found, pa.int32())], ["ask", "ring"])

    return run


def _scan(dim: int, kind: str, longest: float, pivots: np.ndarray, k: int, same: bool):
    """``anchor_id, slot, other_id, score``: the best ``k`` of a block for each want of a block of anchors."""
    exact, none = (float, -np.inf) if longest < 1 << 52 else (np.int64, np.iinfo(np.int64).min)

    def run(batches):
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i in range(b.num_rows):
                get = lambda c, t, i=i: np.frombuffer(b.column(c)[i].as_py(), t)
                ids, labels, q = get("ids", "<i8"), get("labels", "<i8"), get("data", kind).reshape(-1, dim)
                others, theirs, x = get("other_ids", "<i8"), get("other_labels", "<i8"), get("other_data", kind).reshape(-1, dim)
                w, p = _wants(b, i), pivots[[b.column("pivot")[i].as_py()]]
                real = q.astype(float)
                low, high = (np.array([b.column(c)[i].as_py()]) for c in ("low", "high"))
                least, most = _bounds(real, longest, _gaps(_asked(real), p), low, high)
                at = np.searchsorted(ids, w.anchor_id)
                w = w[(most[at, 0] >= w.floor) & (least[at, 0] <= w.high)]
                for s in range(0, len(w), STEP):
                    part = w.iloc[s : s + STEP]
                    at = np.searchsorted(ids, part.anchor_id)
                    score = q[at].astype(exact) @ x.T.astype(exact)
                    ok = (labels[at, None] == theirs) == same
                    ok &= (ids[at, None] != others) & (score >= part.floor.to_numpy()[:, None]) & (score <= part.high.to_numpy()[:, None])
                    score[~ok] = none
                    row = np.arange(len(part))
                    for _ in range(min(k, len(others))):
                        j = score.argmax(axis=1)
                        there = score[row, j] > none
                        if not there.any():
                            break
                        for to, v in zip(out, (part.anchor_id.to_numpy()[there], part.slot.to_numpy()[there], others[j[there]], score[row, j][there].astype(np.int64)), strict=True):
                            to.append(v)
                        score[row, j] = none
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0), t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor_id", "slot", "other_id", "score"])

    return run


class Index:
    """Blocks of ``vectors`` (``vec_id, label, ints, anchor``) by distance keys, and blocks of their anchors."""

    def __init__(self, vectors: DataFrame):
        size = F.aggregate("ints", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        s = vectors.agg(F.count("*").alias("n"), F.max(size).alias("longest"), F.max(F.size("ints")).alias("dim"), F.max(F.array_max(F.transform("ints", lambda x: F.abs(x)))).alias("most")).first()
        self.spark, self.n, self.dim, self.longest = vectors.sparkSession, s.n, max(s.dim or 1, 1), s.longest or 0.0
        if self.longest >= 2.0**62:
            raise ValueError("scores of these vectors don't fit a long")
        self.kind = "<i2" if (s.most or 0) < 1 << 15 else "<i4" if s.most < 1 << 31 else "<i8"
        self.pivots = _pivots(vectors, self.n, self.dim, self.longest)
        rows = vectors.mapInArrow(_keyed(self.dim, self.longest, self.pivots), "vec_id long, label long, ints array<long>, anchor boolean, pivot int, gap double")
        rows = written(rows, "keys")
        cells = "pivot int, low double, high double, ids binary, labels binary, data binary"
        per = max(1, min(BLOCK, NUMBERS // self.dim))
        key = ["pivot", "gap", "vec_id"]
        laid = lambda d: d.repartitionByRange(*key).sortWithinPartitions(*key)
        blocks = laid(rows).mapInArrow(_cut(per, self.dim, self.kind, True), cells).withColumn("block", F.monotonically_increasing_id())
        blocks = written(blocks, "blocks")
        ends = blocks.groupBy(F.col("pivot").alias("p_")).agg(F.min("low").alias("from_"), F.max("high").alias("to_"))  # a row for each pivot
        cell = F.least(F.lit(RINGS - 1), F.floor((F.col("low") - F.col("from_")) / (F.col("to_") - F.col("from_") + 1e-9) * RINGS))
        self.blocks = blocks.join(F.broadcast(ends), F.col("pivot") == F.col("p_")).withColumn("ring", (F.col("pivot") * RINGS + cell).cast("int")).drop("p_", "from_", "to_")
        rings = self.blocks.groupBy("ring", "pivot").agg(F.min("low"), F.max("high")).collect()  # PIVOTS * RINGS rows at most
        self.rings = np.array([tuple(r) for r in rings], float).reshape(-1, 4)
        per = max(1, min(ASK, NUMBERS // self.dim))
        self.asks = written(laid(rows.where("anchor")).mapInArrow(_cut(per, self.dim, self.kind, False), cells).select(F.monotonically_increasing_id().alias("ask"), "ids", "labels", "data"), "asks")
        discard(rows)

    def anchors(self) -> DataFrame:
        """``ask, anchor_id``."""

        def run(batches):
            for b in batches:
                ids = [np.frombuffer(x.as_py(), "<i8") for x in b.column("ids")]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("ask").to_numpy(), [len(x) for x in ids]), pa.int64()), pa.array(np.concatenate(ids) if ids else np.zeros(0), pa.int64())], ["ask", "anchor_id"])

        return self.asks.select("ask", "ids").mapInArrow(run, "ask long, anchor_id long")

    def search(self, wants: DataFrame, k: int, same: bool) -> DataFrame:
        """``anchor_id, slot, other_id, score, rank``: for each want (``ask, anchor_id, slot, low, high``) the first ``k`` of the other vectors
        of the anchor's label (of other labels, unless ``same``) whose score is from ``low`` to ``high``."""
        spark, args = self.spark, (self.dim, self.kind, self.longest, self.pivots)
        best = spark.createDataFrame([], "anchor_id long, slot int, other_id long, score long, rank int")
        seen = spark.createDataFrame([], "ask long, ring int")
        other = self.blocks.select("block", "ring", "pivot", "low", "high", *(F.col(c).alias(f"other_{c}") for c in ("ids", "labels", "data")))
        order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "other_id")
        reach, spent = REACH, []
        while True:
            last = best.where(F.col("rank") == k).select("anchor_id", "slot", F.col("score").alias("kth"))
            w = wants.join(last, ["anchor_id", "slot"], "left").withColumn("floor", F.greatest("low", "kth"))
            w = w.groupBy("ask").agg(F.collect_list(F.struct("anchor_id", "slot", "low", "high", "floor")).cast(_WANTS).alias("wants"))  # as many as a block has
            been = seen.groupBy("ask").agg(F.collect_set("ring").alias("seen"))  # PIVOTS * RINGS at most
            state = written(self.asks.join(w, "ask").join(been, "ask", "left"), "state")
            plan = written(state.mapInArrow(_plan(*args, self.rings, reach), "ask long, ring int"), "plan")
            pairs = plan.join(other.select("ring", "block"), "ring").select("ask", "block")
            if not (n := pairs.count()):
                discard(state, plan)
                break
            # So many pairs a task; they don't come together in a few, small as their numbers are.
            tasks = max(min(n, 2 * spark.sparkContext.defaultParallelism), n // 64)
            found = pairs.repartition(tasks, "ask", "block").join(state.drop("seen"), "ask").join(other.drop("ring"), "block")
            found = found.mapInArrow(_scan(*args, k, same), "anchor_id long, slot int, other_id long, score long")
            new = best.drop("rank").unionAll(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            best = written(new, "best", *spent)
            discard(state)
            seen, reach, spent = seen.unionAll(plan), reach * MORE, [best]
        return best


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors`` (``vec_id, embedding, label``).

    Components are multiplied by ``scale`` and rounded down, and a score is the inner product of the whole numbers. The
    positives of an anchor (a row that meets ``anchors``, a condition on ``vec_id``) are the first ``positives`` others of its label, by
    score and then by smaller ``vec_id``. For each, the first ``negatives`` of other labels are returned whose score is ``low`` to
    ``high`` percent of the positive's; fewer or none, if there are no more (so none for a negative score).

    Rows with a null id, label (a whole number) or vector, or with a null or non-finite component, take no part. Rows that repeat
    an id are one row: the least by label, then by vector. Vectors of different lengths are as if ended by zeros; zero and empty ones score 0.
    Scores of 2^62 or more raise ValueError. No anchors, or an empty table, give no rows. Other columns are not read.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & F.forall("e", finite))
    fits = lambda x: F.abs(x) < 2.0**31 / scale
    ints = F.transform("e", lambda x: F.when(fits(x), F.floor(x * scale)).otherwise(F.raise_error(F.lit("scores of these vectors don't fit a long"))).cast("long"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "e")).alias("v")).select("vec_id", "v.label", F.col("v.e").alias("e")).select("vec_id", "label", ints.alias("ints"), anchors.alias("anchor"))
    rows = written(rows, "vectors")
    index = Index(rows)
    discard(rows)
    far = (1 << 62) - 1
    asked = written(index.anchors(), "anchors")
    near = index.search(asked.withColumns({"slot": F.lit(0), "low": F.lit(-far), "high": F.lit(far)}), positives, True)
    score = F.col("score")
    near = near.where("score >= 0").select(F.col("anchor_id"), F.col("rank").alias("slot"), F.col("other_id").alias("positive_id"), score.alias("positive_score"))
    between = {"low": F.expr(f"(positive_score * {low} + 99) div 100"), "high": F.expr(f"positive_score * {high} div 100")}
    wants = near.withColumns(between).join(asked, "anchor_id").select("ask", "anchor_id", "slot", "low", "high")
    found = index.search(written(wants, "wants"), negatives, False)
    return found.join(near, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
