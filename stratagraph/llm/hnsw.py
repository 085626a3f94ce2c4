"""Embedding near-duplicates by hierarchical navigable small-world graphs (Malkov and Yashunin, 2018).

Vectors of a label and length are dealt by hash to shards of bounded size. Within a shard, vectors that lie
within half the angle of a link of a leader are its members, so all of them are linked with each other by
the triangle inequality, and the links within a crowd of near copies are known without comparing any. Leaders
within twice the angle of a link of another are of its district, and the graph is over the districts' heads
alone. They lie so far apart that no crowd can fill neighbour lists or beams.

Every shard is queried with every shard's leaders. A search returns the districts within the angle of a link and
all radii: what the beam finds, and what can be reached from there through such districts; their leaders are
then compared. By their angle two leaders' members are all linked, not linked at all, or compared pair by pair
in double precision. A link is counted at both of its ends.

The beam of a graph is widened until planted queries, made of its own vectors by turning them a little, find
what a comparison with the whole shard finds; each is counted alike, and no query is without something to find.
Some real queries of every pair of shards are audited likewise. Where an audit fails at the widest beam,
everything is compared. The recall that was reached is returned.

Equal vectors of a label are one vector with a count. A task emits counts and a spanning forest of the
links that it found, never the pairs of a group.
"""

import pickle
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

#: Vectors of a shard, and numbers in them, at most.
SHARD, NUMBERS = 32_768, 1 << 21
#: Neighbours that a vector chooses, those that it keeps in all, and those that it chooses from.
NEIGHBOURS, LINKED, CANDIDATES = 12, 24, 48
#: First and widest beam; planted and real queries of an audit; the mean recall that they must reach.
BEAM, WIDEST, PLANTED, REAL, RECALL = 16, 512, 64, 16, 0.99
#: Vectors of a layer that is looked at as a whole, and places at which a search enters the lowest from there.
SMALL, ENTRIES = 4096, 8
#: Queries that are searched with at a time; pairs of vectors that are compared at a time.
QUERIES, PAIRS = 512, 1 << 18
#: Radians, and cosine in single precision, by which a bound is widened so that rounding loses nothing.
ANGLE, SINGLE = 1e-7, 1e-5


def _diverse(v: np.ndarray, sims: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Which candidates (a row for each vector, nearest first, -1 for none) it takes: those nearer to it than to what it has."""
    x = v[ids]
    among = x @ x.transpose(0, 2, 1)
    kept, count = np.zeros(ids.shape, bool), np.zeros(len(ids), int)
    for k in range(ids.shape[1]):
        ok = (ids[:, k] >= 0) & (count < most) & ~((among[:, k] >= sims[:, k, None]) & kept).any(axis=1)
        kept[:, k] = ok
        count += ok
    return kept


def _ranked(sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest of each row, in order, and their columns."""
    if most < sims.shape[1]:
        at = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    else:
        at = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    order = np.argsort(-np.take_along_axis(sims, at, axis=1), axis=1, kind="stable")
    at = np.take_along_axis(at, order, axis=1)
    return np.take_along_axis(sims, at, axis=1), at


def _layer(v: np.ndarray) -> np.ndarray:
    """Neighbour lists of a layer: vectors come one after the other, and each links to some of those before
    it, which link back. What came early so keeps links over long distances. Many are entered at a time."""
    n, some = len(v), max(64, (1 << 16) // v.shape[1])
    lists = np.full((n, LINKED), -1, np.int32)
    done = 0
    while done < n:
        end = min(n, done + min(some, max(32, done)))
        sims = v[done:end] @ v[:end].T
        sims[np.arange(end) >= np.arange(done, end)[:, None]] = -2
        near, ids = _ranked(sims, min(CANDIDATES, end))
        ids = np.where(near > -2, ids, -1).astype(np.int32)
        kept = _diverse(v, near, ids, NEIGHBOURS)
        row, column = np.nonzero(kept)
        lists[done + row, (np.cumsum(kept, axis=1) - 1)[row, column]] = ids[row, column]
        _back(v, lists, ids[row, column], (done + row).astype(np.int32))
        done = end
    return lists


def _back(v: np.ndarray, lists: np.ndarray, to: np.ndarray, new: np.ndarray) -> None:
    """Enters ``new`` in the lists of ``to``; a list that is full keeps a diverse choice."""
    order = np.argsort(to, kind="stable")
    to, new = to[order], new[order]
    who, first, count = np.unique(to, return_index=True, return_counts=True)
    rank = np.arange(len(to)) - np.repeat(first, count)
    has = (lists[who] >= 0).sum(axis=1)
    fits = np.repeat(has + count <= LINKED, count)
    lists[to[fits], (np.repeat(has, count) + rank)[fits]] = new[fits]
    full = np.flatnonzero(has + count > LINKED)
    full = full[np.argsort(count[full], kind="stable")]
    some = max(32, (1 << 15) // v.shape[1])
    for a in range(0, len(full), some):
        part = full[a : a + some]
        ids = np.full((len(part), LINKED + int(count[part].max())), -1, np.int32)
        ids[:, :LINKED] = lists[who[part]]
        for k, j in enumerate(part):
            ids[k, LINKED : LINKED + count[j]] = new[first[j] : first[j] + count[j]]
        sims = np.where(ids >= 0, np.einsum("bcd,bd->bc", v[ids], v[who[part]]), -2)
        near, at = _ranked(sims, min(2 * CANDIDATES, ids.shape[1]))
        ids = np.take_along_axis(ids, at, axis=1)
        kept = _diverse(v, near, ids, LINKED)
        lists[who[part]] = -1
        row, column = np.nonzero(kept)
        lists[who[part][row], (np.cumsum(kept, axis=1) - 1)[row, column]] = ids[row, column]


class Graph:
    """A graph over the rows of ``v``, vectors of length one in single precision."""

    def __init__(self, v: np.ndarray) -> None:
        self.v, n = v, len(v)
        draw = np.random.default_rng(4).random(n)
        level = (-np.log(np.maximum(draw, 1e-12)) / np.log(NEIGHBOURS)).astype(int)
        #: From the lowest layer up: the numbers of its vectors, and their neighbours by place in it.
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(int(level.max(initial=0)) + 1):
            ids = np.flatnonzero(level >= k)
            self.layers.append((ids, _layer(v[ids])))

    def _entry(self, q: np.ndarray, most: int) -> np.ndarray:
        """Where the queries enter the lowest layer: the nearest of the first layer above it
        that is small enough to be looked at as a whole, which no crowd of that layer's size can hide from."""
        ids = next((ids for ids, _ in self.layers[1:] if len(ids) <= SMALL), self.layers[-1][0])
        return ids[_ranked(q @ self.v[ids].T, min(most, len(ids)))[1]]

    def search(self, q: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a vector with a cosine of the query's ``least`` or more, as the search finds them."""
        out = [self._searched(q[a : a + QUERIES], least[a : a + QUERIES], width) for a in range(0, len(q), QUERIES)]
        return np.concatenate([i + k * QUERIES for k, (i, _) in enumerate(out)]), np.concatenate([j for _, j in out])

    def _searched(self, q: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        v, lists, n = self.v, self.layers[0][1], len(q)
        at = self._entry(q, min(ENTRIES, width))
        seen = np.zeros((n, len(v)), bool)
        seen[np.arange(n)[:, None], at] = True
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -3, q.dtype)
        open_ = np.zeros((n, width), bool)
        k = at.shape[1]
        ids[:, :k], sims[:, :k], open_[:, :k] = at, np.einsum("qcd,qd->qc", v[at], q), True
        going = np.arange(n)
        while len(going):
            todo = np.where(open_[going], sims[going], -4)
            best = todo.argmax(axis=1)
            some = todo[np.arange(len(going)), best] > -4
            going, best = going[some], best[some]
            open_[going, best] = False
            near = lists[ids[going, best]]
            new = (near >= 0) & ~seen[going[:, None], near]
            seen[going[:, None], np.where(new, near, ids[going, best][:, None])] = True
            found = np.where(new, np.einsum("qcd,qd->qc", v[near], q[going]), -3)
            # The beam is the best of what it was and of what is new.
            all_ = np.concatenate([sims[going], found], axis=1)
            top = np.argpartition(-all_, width - 1, axis=1)[:, :width]
            sims[going] = np.take_along_axis(all_, top, axis=1)
            ids[going] = np.take_along_axis(np.concatenate([ids[going], near], axis=1), top, axis=1)
            open_[going] = np.take_along_axis(np.concatenate([open_[going], new], axis=1), top, axis=1)
        row, column = np.nonzero(sims >= least[:, None])
        edge = row, ids[row, column]
        out = [edge]
        while len(edge[0]):
            row, near = np.repeat(edge[0], LINKED), lists[edge[1]].ravel()
            keep = near >= 0
            row, near = row[keep], near[keep]
            keep = ~seen[row, near]
            pair = np.unique(row[keep] * len(v) + near[keep])
            row, near = pair // len(v), pair % len(v)
            seen[row, near] = True
            edge = [], []
            for a in range(0, len(row), PAIRS):
                i, j = row[a : a + PAIRS], near[a : a + PAIRS]
                hit = np.einsum("pd,pd->p", v[j], q[i]) >= least[i]
                edge[0].append(i[hit])
                edge[1].append(j[hit])
            edge = tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in edge)
            out.append(edge)
        return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])

    def compared(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same pairs by comparing everything."""
        out = [np.nonzero(q[a : a + QUERIES] @ self.v.T >= least[a : a + QUERIES, None]) for a in range(0, len(q), QUERIES)]
        return np.concatenate([i + k * QUERIES for k, (i, _) in enumerate(out)]), np.concatenate([j for _, j in out])


def _recall(graph: Graph, q: np.ndarray, least: np.ndarray, width: int) -> tuple[float, int]:
    """Mean share of its true hits that a query finds, and the number of queries that have any."""
    truth, found = np.zeros((len(q), len(graph.v)), bool), np.zeros((len(q), len(graph.v)), bool)
    truth[graph.compared(q, least)] = True
    found[graph.search(q, least, width)] = True
    have = truth.any(axis=1)
    got = (truth & found)[have].sum(axis=1) / truth[have].sum(axis=1)
    return float(got.mean()) if have.any() else 1.0, int(have.sum())


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    # Scaled first, so that very large or small components neither overflow nor vanish.
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Shard(NamedTuple):
    """Members in order of their districts and leaders: ids, counts, vectors as given, where each leader's begin. A
    leader is the first of its members. ``radius``: the greatest angle of its members. ``district``: where the
    leaders of each begin, the first being its head; ``reach``: the greatest angle of its leaders. ``width``:
    the beam, 0 to compare."""

    nodes: np.ndarray
    counts: np.ndarray
    raw: np.ndarray
    begin: np.ndarray
    radius: np.ndarray
    district: np.ndarray
    reach: float
    graph: Graph
    width: int
    recall: float


def _angle(x: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x, -1.0, 1.0))


def led(v: np.ndarray, radius: float) -> np.ndarray:
    """For each vector the number of its leader: the nearest of those before it within ``radius``, or itself."""
    n, least, out, leaders = len(v), np.cos(radius), np.arange(len(v)), np.zeros(0, np.int64)
    for a in range(0, n, 1024):
        part = v[a : a + 1024]
        if len(leaders):
            sims = part @ v[leaders].T
            best = sims.argmax(axis=1)
            taken = sims[np.arange(len(part)), best] >= least
            out[a : a + 1024][taken] = leaders[best[taken]]
            rest = np.flatnonzero(~taken)
        else:
            rest = np.arange(len(part))
        near = part[rest] @ part[rest].T >= least
        open_ = np.ones(len(rest), bool)
        for k in range(len(rest)):
            if open_[k]:
                mine = near[k] & open_
                out[a + rest[mine]] = a + rest[k]
                open_[mine] = False
        own = a + rest[out[a + rest] == a + rest]
        leaders = np.concatenate([leaders, own])
    return out


def _radii(v: np.ndarray, leader: np.ndarray) -> np.ndarray:
    """The greatest angle to each leader (0 for others, and where it leads itself alone)."""
    out = np.zeros(len(v))
    other = leader != np.arange(len(v))
    np.maximum.at(out, leader[other], _angle(np.einsum("nd,nd->n", v[other], v[leader[other]])))
    return out


def shard(nodes: np.ndarray, counts: np.ndarray, raw: np.ndarray, least: float) -> Shard:
    theta, at = float(np.arccos(least)), np.arange(len(raw))
    v = _unit(raw)
    leader = led(v, max(0.0, theta / 2 - ANGLE))
    heads = np.flatnonzero(leader == at)
    over = led(v[heads], 2 * theta)
    # By district and leader, heads first.
    of = heads[over][np.searchsorted(heads, leader)]
    order = np.lexsort((at, leader != at, leader, leader != of, of))
    begin = np.flatnonzero(leader[order] == order)
    radius = _radii(v, leader)[order[begin]]
    district = np.flatnonzero(of[order[begin]] == order[begin])
    reach = float(_radii(v[heads], over).max())
    heads = v[order[begin[district]]]
    graph = Graph(heads.astype(np.float32))
    # Planted queries: vectors of the graph, turned by angles up to the widest that is asked for.
    rng = np.random.default_rng(5)
    some = rng.choice(len(heads), min(PLANTED, len(heads)), replace=False)
    side = rng.standard_normal((len(some), v.shape[1]))
    side -= np.einsum("nd,nd->n", side, heads[some])[:, None] * heads[some]
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    wide = theta + 2 * radius.max() + reach
    turn = rng.random((len(some), 1)) * wide
    q = (np.cos(turn) * heads[some] + np.sin(turn) * side).astype(np.float32)
    bound = np.full(len(q), _cosine(wide), np.float32)
    width = BEAM
    while (recall := _recall(graph, q, bound, min(width, len(heads)))[0]) < RECALL and width:
        width = width * 2 if width < WIDEST and width < len(heads) else 0
        if not width:
            recall = 1.0
            break
    same = raw.astype(np.float32)
    return Shard(nodes[order], counts[order], same[order] if (same == raw).all() else raw[order], begin, radius, district, reach, graph, width, recall)


def _cosine(angle: np.ndarray | float) -> np.ndarray:
    """The least cosine in single precision of what lies within an angle."""
    return (np.cos(np.minimum(angle + ANGLE, np.pi)) - SINGLE).astype(np.float32)


def _leaders(q: np.ndarray, v: np.ndarray, least: np.ndarray, i: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of queries ``i`` and stretches of ``v`` from the first to the second of ``ends``, the pairs that are near enough."""
    order = np.argsort(ends[0], kind="stable")
    i, low, size = i[order], ends[0][order], (ends[1] - ends[0])[order]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    big = np.flatnonzero(size >= 64)
    for part in np.split(big, np.flatnonzero(np.diff(low[big])) + 1) if len(big) else ():
        to = v[low[part[0]] : low[part[0]] + size[part[0]]]
        for a in range(0, len(part), step := max(1, 4 * PAIRS // len(to))):
            x, y = np.nonzero(q[i[part[a : a + step]]] @ to.T >= least[i[part[a : a + step]], None])
            out.append((i[part[a : a + step]][x], low[part[0]] + y))
    i, low, size = i[size < 64], low[size < 64], size[size < 64]
    for a in range(0, len(i), PAIRS // 64):
        m = size[a : a + PAIRS // 64]
        x = np.repeat(i[a : a + len(m)], m)
        y = np.repeat(low[a : a + len(m)] - np.cumsum(m) + m, m) + np.arange(m.sum())
        hit = np.einsum("pd,pd->p", q[x], v[y]) >= least[x]
        out.append((x[hit], y[hit]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def between(a: Shard, b: Shard, least: float, one: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, int, bool]]:
    """Links between the members of two shards (``one``: of one and the same): by member of each the number of linked
    vectors (with their counts), the pairs of leaders that have a link; and mean recall, queries
    that were audited, and whether everything was compared."""
    theta = float(np.arccos(least))
    va, vb = _unit(a.raw), _unit(b.raw)
    ha, hb = va[a.begin], vb[b.begin]
    wide = theta + a.radius + b.radius.max()
    bound = _cosine(wide + b.reach)
    q, graph = ha.astype(np.float32), b.graph
    width, recall, audited = min(b.width, len(graph.v)), 1.0, 0
    if width:
        some = np.random.default_rng(6).choice(len(q), min(REAL, len(q)), replace=False)
        recall, audited = _recall(graph, q[some], bound[some], width)
    exact = not width or recall < RECALL
    i, j = graph.compared(q, bound) if exact else graph.search(q, bound, width)
    recall = 1.0 if exact else recall
    i, j = _leaders(q, hb.astype(np.float32), _cosine(wide), i, (b.district[j], np.append(b.district, len(hb))[j + 1]))
    if one:
        # Found from either end is found.
        pair = np.unique(np.minimum(i, j) * len(hb) + np.maximum(i, j))
        i, j = pair // len(hb), pair % len(hb)
        i, j = i[i != j], j[i != j]
    ea, eb = np.append(a.begin, len(va)), np.append(b.begin, len(vb))
    wa, wb = np.add.reduceat(a.counts, a.begin), np.add.reduceat(b.counts, b.begin)
    na, nb = np.zeros(len(va), np.int64), np.zeros(len(vb), np.int64)
    far = np.concatenate([_angle(np.einsum("pd,pd->p", ha[i[k : k + PAIRS]], hb[j[k : k + PAIRS]])) for k in range(0, len(i), PAIRS)] or [np.zeros(0)])
    alone = (ea[i + 1] - ea[i] == 1) & (eb[j + 1] - eb[j] == 1)
    all_ = ~alone & (far + a.radius[i] + b.radius[j] <= theta - ANGLE)
    la, lb = np.zeros(len(ha), np.int64), np.zeros(len(hb), np.int64)
    np.add.at(la, i[all_], wb[j[all_]])
    np.add.at(lb, j[all_], wa[i[all_]])
    na += np.repeat(la, np.diff(ea))
    nb += np.repeat(lb, np.diff(eb))
    if one:
        na += np.repeat(wa, np.diff(ea)) - a.counts
    linked = all_.copy()
    open_ = np.flatnonzero(~all_ & (far - a.radius[i] - b.radius[j] <= theta + ANGLE))
    size = (ea[i + 1] - ea[i])[open_] * (eb[j + 1] - eb[j])[open_]
    for k in open_[size > PAIRS].tolist():
        rows, columns = slice(ea[i[k]], ea[i[k] + 1]), slice(eb[j[k]], eb[j[k] + 1])
        step = max(1, PAIRS // (columns.stop - columns.start))
        for r in range(rows.start, rows.stop, step):
            hit = va[r : min(r + step, rows.stop)] @ vb[columns].T >= least
            na[r : r + len(hit)] += hit @ b.counts[columns]
            nb[columns] += a.counts[r : r + len(hit)] @ hit
            linked[k] |= hit.any()
    open_, size = open_[size <= PAIRS], size[size <= PAIRS]
    upto = np.cumsum(size)
    for part in np.split(np.arange(len(open_)), np.flatnonzero(np.diff(upto // PAIRS)) + 1) if len(open_) else ():
        k, m = open_[part], size[part]
        of = np.repeat(np.arange(len(k)), m)
        at = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
        many = (eb[j + 1] - eb[j])[k][of]
        x, y = ea[i[k]][of] + at // many, eb[j[k]][of] + at % many
        hit = np.einsum("pd,pd->p", va[x], vb[y]) >= least
        np.add.at(na, x[hit], b.counts[y[hit]])
        np.add.at(nb, y[hit], a.counts[x[hit]])
        linked[k[np.unique(of[hit])]] = True
    if one:
        na += nb
        nb[:] = 0
    return na, nb, np.stack([i[linked], j[linked]]), (recall, audited, exact)


def _build(least: float):  # noqa: ANN202
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        made = shard(group.node.to_numpy(), group.n.to_numpy(), np.array(group.embedding.tolist(), np.float64), least)
        return pd.DataFrame({"label": [group.label.iloc[0]], "dim": [group.dim.iloc[0]], "shard": [group.shard.iloc[0]], "data": [pickle.dumps(made, protocol=5)]})

    return run


def _pair(least: float):  # noqa: ANN202
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        one = left.a.iloc[0] == left.b.iloc[0]
        a: Shard = pickle.loads(left.data.iloc[0])  # noqa: S301  made by _build
        b: Shard = a if one else pickle.loads(right.data.iloc[0])  # noqa: S301
        na, nb, pairs, (recall, audited, exact) = between(a, b, least, one)
        kind, x, y = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def emit(k: int, p: np.ndarray, q: np.ndarray) -> None:
            kind.append(np.full(len(p), k, np.int32))
            x.append(np.asarray(p, np.int64))
            y.append(np.asarray(q, np.int64))

        emit(0, a.nodes[na > 0], na[na > 0])
        emit(0, b.nodes[nb > 0], nb[nb > 0])
        ends = np.stack([a.nodes[a.begin][pairs[0]], b.nodes[b.begin][pairs[1]]])
        if one:
            heads = np.repeat(a.nodes[a.begin], np.diff(np.append(a.begin, len(a.nodes))))
            emit(1, a.nodes[a.nodes != heads], heads[a.nodes != heads])
        emit(1, *_forest(ends))
        # Millionths of the mean recall, and audited queries (-1: everything was compared).
        emit(2, [round(min(recall, b.recall) * 1e6)], [-1 if exact else audited])
        out = pd.DataFrame({"kind": np.concatenate(kind), "a": np.concatenate(x), "b": np.concatenate(y)})
        out.insert(0, "label", left.label.iloc[0])
        return out

    return run


def _forest(ends: np.ndarray) -> np.ndarray:
    """The edges (two rows) without those that close a circle."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    kept = []
    for k, (p, q) in enumerate(ends.T.tolist()):
        if (p := root(p)) != (q := root(q)):
            parent[max(p, q)] = min(p, q)
            kept.append(k)
    return ends[:, kept]


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept, recall`` of each row of ``vectors`` (``vec_id, embedding, label``).

    Rows are linked where their labels are equal and not null, their vectors have as many components
    and the cosine in double precision is ``least`` (from 0 to 1) or more. Vectors that are null, empty, zero or
    hold a null or non-finite component are linked with nothing: they are their own component. Rows
    that repeat an id are vectors of their own. ``component_id`` is the smallest ``vec_id`` that can be
    reached. ``recall`` is the lowest of the mean recalls that the audits of the label's shards reached (1
    where everything was compared, null for what is linked with nothing). An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    good = rows.where(usable)
    nodes = good.groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "vectors")
    most = F.greatest(F.lit(1), F.least(F.lit(SHARD), F.floor(F.lit(NUMBERS) / F.col("dim"))))
    size = nodes.groupBy("label", "dim").agg(F.count("*").alias("size")).withColumn("shards", F.ceil(F.col("size") / most).cast("int")).drop("size")
    dealt = nodes.join(size, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node", F.lit("shard")), F.col("shards")).cast("int"))
    built = dealt.select("label", "dim", "shard", "node", "n", "embedding").groupBy("label", "dim", "shard").applyInPandas(_build(least), "label string, dim int, shard int, data binary")
    built = written(built, "graphs").join(size, ["label", "dim"])
    # Every pair of shards once: a link that either end finds is counted at both.
    left = built.select("label", "dim", F.col("shard").alias("a"), F.explode(F.sequence(F.col("shard"), F.col("shards") - 1)).alias("b"), "data")
    as_ = lambda c: F.col(c).alias(c)  # noqa: E731  columns of its own, not those of the left side
    right = built.select(as_("label"), as_("dim"), F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("a"), as_("shard").alias("b"), as_("data")).where("a < b")
    right = right.unionAll(left.where("a = b").select("label", "dim", "a", "b", F.lit(None).cast("binary").alias("data")))
    key = ["label", "dim", "a", "b"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_pair(least), "label string, kind int, a long, b long")
    found = written(found, "links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    audits = found.where("kind = 2").groupBy(F.col("label").alias("l_")).agg((F.min("a") / 1e6).alias("recall"))
    joined = components(found.where("kind = 1").select("a", "b"))
    named = nodes.select("node", "label", "embedding", "n", "low").join(links, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    named = written(named, "named")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "root").select(F.col("label").alias("l_"), F.col("embedding").alias("e_"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.join(named, (F.col("label") == F.col("l_")) & (F.col("embedding") == F.col("e_"))).select("vec_id", "n_links", "component_id", "label")
    linked = linked.join(audits, F.col("label") == F.col("l_"), "left").select("vec_id", "n_links", "component_id", "recall")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    every = linked.unionAll(alone)
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), "recall")
