"""Near-duplicate vectors by hierarchical navigable small-world graphs, one a shard.

Each shard builds a graph of its vectors; what lies within half the linking angle of a node joins that node's class instead of
becoming a node, so dense groups stay small. Graphs are written to the shared folder, and blocks of queries meet every shard's
graph. A beam search finds the nodes whose classes may hold links; a class that lies within reach as a whole is counted as one,
one that lies across the border is verified vector by vector, in double precision. Beams widen until an audit passes: probes at
the linking angle from vectors of the shard, and queries of the block that have links, compared with all vectors of the shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, remove, written
from .components import components
from .vectors import dealt_evenly, unit, usable


@dataclass(frozen=True)
class Settings:
    links: int = 12  # a node's neighbours; twice as many on the lowest layer
    build_beam: int = 48
    beam: int = 96  # at first; doubled until the audit passes
    spare: int = 12  # places of a node for links to nodes that few others link to
    known_by: int = 16  # nodes that link to a node, if their spare places allow
    together: int = 4  # nodes of a beam expanded at a time
    probes: int = 256  # of a block's audit: vectors at the linking angle from one of the shard
    audited: int = 32  # queries of a block that are compared with the whole shard
    recall: float = 0.99  # the mean over probes and over audited queries that have links
    shard_floats: int = 1 << 23  # components of a shard's vectors: they and the graph stay in memory
    block_rows: int = 1 << 14  # queries of a block; up to eight times as many if there are more shards, as a graph goes to each block
    tasks: int = 1 << 12  # partitions that blocks and shards are dealt to, at most; a task takes several in turn
    seed: int = 3


class Graph:
    """A hierarchical navigable small-world graph over unit vectors (float32).

    A vector whose cosine with a node is `tight` or more is no node; leader says which node it joined (itself, if it is one).
    """

    def __init__(self, vectors: np.ndarray, settings: Settings, tight: float = 2.0):
        self.v, self.s, self.tight = np.ascontiguousarray(vectors, np.float32), settings, tight
        n = len(vectors)
        height = (-np.log(1 - np.random.default_rng(settings.seed).random(n)) / log(settings.links)).astype(int)
        order = np.argsort(-height, kind="stable")  # the tallest first: the entry point is settled at once
        self.top, self.entry, self.leader = int(height[order[0]]), int(order[0]), np.arange(n)
        self.near = [np.full((n, settings.links * 2 + settings.spare if level == 0 else settings.links), -1, np.int32) for level in range(self.top + 1)]
        at = 1
        while at < n:
            batch = order[at : at + min(max(1, at), 512)]
            self._insert(batch, height[batch])
            at += len(batch)
        self._spread_links()

    def _width(self, level: int) -> int:
        return self.s.links * (2 if level == 0 else 1)

    def nodes(self) -> np.ndarray:
        return np.flatnonzero(self.leader == np.arange(len(self.v)))

    def reached(self) -> np.ndarray:
        """Which nodes a walk from the entry point can come to on the lowest layer."""
        seen = np.zeros(len(self.v), bool)
        seen[self.entry] = True
        edge = np.array([self.entry])
        while len(edge):
            out = np.unique(self.near[0][edge])
            out = out[out >= 0]
            edge = out[~seen[out]]
            seen[edge] = True
        return seen

    def _spread_links(self) -> None:
        """Spare places take links to nodes that few know, from those that they link to; then to all that no walk comes to."""
        near, nodes = self.near[0], self.nodes()
        known = np.bincount(near[near >= 0], minlength=len(self.v))
        free = (near[:, self._width(0) :] < 0).sum(axis=1)

        def placed(host: int, node: int) -> bool:
            if host < 0 or host == node or not free[host] or (near[host] == node).any():
                return False
            near[host, near.shape[1] - free[host]] = node
            free[host] -= 1
            known[node] += 1
            return True

        for k in range(self._width(0)):
            for node in nodes[known[nodes] < self.s.known_by].tolist():
                placed(int(near[node, k]), node)
        while True:
            within = self.reached()
            lost = nodes[~within[nodes]]
            if not len(lost):
                break
            hosts = self.search(self.v[lost], self.s.build_beam)[0]
            if not sum(any(placed(host, node) for host in row.tolist()) for node, row in zip(lost.tolist(), hosts)):
                near = self.near[0] = np.pad(near, ((0, 0), (0, 1)), constant_values=-1)  # one place more for all
                free += 1

    def _expand(self, queries: np.ndarray, start: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam's ids and inner products for each query, best first; -1 where it found fewer."""
        q, near, step = len(queries), self.near[level], self.s.together if beam >= self.s.together else 1
        ids = np.full((q, beam), -1, np.int32)
        sims = np.full((q, beam), -np.inf, np.float32)
        width = min(beam, start.shape[1])
        first = np.einsum("qd,qkd->qk", queries, self.v[np.maximum(start, 0)])
        first[start < 0] = -np.inf
        order = np.argsort(-first, axis=1)[:, :width]
        ids[:, :width], sims[:, :width] = np.take_along_axis(start, order, 1), np.take_along_axis(first, order, 1)
        done = ids < 0
        seen = np.zeros((q, len(self.v)), bool)
        live = np.arange(q)
        rows, columns = np.nonzero(start >= 0)
        seen[rows, start[rows, columns]] = True
        while len(live):
            waiting = np.where(done[live], -np.inf, sims[live])
            pick = np.argsort(-waiting, axis=1)[:, :step]
            value = np.take_along_axis(waiting, pick, 1)
            go = value[:, 0] > -np.inf
            live, pick, value = live[go], pick[go], value[go]
            if not len(live):
                break
            nodes = np.take_along_axis(ids[live], pick, 1)
            real = value > -np.inf
            done[live[:, None], pick] = True
            found = np.where(real[:, :, None], near[nodes], -1).reshape(len(live), -1)
            safe = np.maximum(found, 0)
            fresh = (found >= 0) & ~seen[live[:, None], safe]
            if step > 1:  # two expanded nodes may share a neighbour
                order = np.argsort(found, axis=1, kind="stable")
                sorted_ = np.take_along_axis(found, order, 1)
                twice = np.zeros_like(fresh)
                np.put_along_axis(twice, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
                fresh &= ~twice
            r, c = np.nonzero(fresh)
            to = found[r, c]
            seen[live[r], to] = True
            new = np.full(found.shape, -np.inf, np.float32)
            new[r, c] = np.einsum("kd,kd->k", queries[live[r]], self.v[to])
            all_ids, all_sims = np.concatenate([ids[live], found], 1), np.concatenate([sims[live], new], 1)
            all_done = np.concatenate([done[live], ~fresh], 1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_done))
        ids[sims == -np.inf] = -1
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, beam: int, bottom: int = 0) -> tuple[np.ndarray, np.ndarray]:
        queries = np.ascontiguousarray(queries, np.float32)
        start = np.full((len(queries), 1), self.entry, np.int32)
        for level in range(self.top, bottom, -1):
            start = self._expand(queries, start, level, 4)[0]
        return self._expand(queries, start, bottom, beam)

    def _diverse(self, node: np.ndarray, others: np.ndarray, width: int) -> np.ndarray:
        """Of each row's others (-1: none) those to link: near ones that no chosen one is nearer to, then the nearest of the rest."""
        own = np.einsum("nd,nkd->nk", self.v[node], self.v[np.maximum(others, 0)])
        own[others < 0] = -np.inf
        order = np.argsort(-own, axis=1, kind="stable")
        others, own = np.take_along_axis(others, order, 1), np.take_along_axis(own, order, 1)
        among = self.v[np.maximum(others, 0)]
        among = among @ among.transpose(0, 2, 1)
        chosen = np.zeros(others.shape, bool)
        closest = np.full(others.shape, -np.inf, np.float32)
        for k in range(others.shape[1]):
            take = (own[:, k] > closest[:, k]) & (own[:, k] > -np.inf) & (chosen.sum(axis=1) < width)
            chosen[:, k] = take
            closest[take] = np.maximum(closest[take], among[take, k])
        rank = np.argsort(np.where(chosen, 0, 1) * 2 + np.where(own > -np.inf, 0, 1), axis=1, kind="stable")[:, :width]
        kept = np.take_along_axis(others, rank, 1)
        kept[np.take_along_axis(own, rank, 1) == -np.inf] = -1
        if kept.shape[1] < width:
            kept = np.pad(kept, ((0, 0), (0, width - kept.shape[1])), constant_values=-1)
        return kept

    def _insert(self, batch: np.ndarray, height: np.ndarray) -> None:
        found, sims = self.search(self.v[batch], self.s.build_beam)
        among = self.v[batch] @ self.v[batch].T
        joins = sims[:, 0] >= self.tight
        self.leader[batch[joins]] = found[joins, 0]
        for k in np.flatnonzero(~joins & (np.tril(among, -1) >= self.tight).any(axis=1)).tolist():  # near one that comes in with it
            earlier = np.flatnonzero((among[k, :k] >= self.tight) & ~joins[:k])
            if len(earlier):
                joins[k], self.leader[batch[k]] = True, batch[earlier[among[k, earlier].argmax()]]
        batch, height, found, among = batch[~joins], height[~joins], found[~joins], among[~joins][:, ~joins]
        np.fill_diagonal(among, -np.inf)
        for level in range(min(self.top, int(height.max(initial=-1))), -1, -1):
            own = np.flatnonzero(height >= level)
            nodes = batch[own]
            ids = found if level == 0 else self.search(self.v[nodes], self.s.build_beam, level)[0]
            k = min(len(nodes) - 1, self.s.links)
            if k > 0:  # those that come in together
                ids = np.concatenate([ids, nodes[np.argpartition(-among[np.ix_(own, own)], k - 1, axis=1)[:, :k]].astype(np.int32)], 1)
            near = self.near[level][:, : self._width(level)]
            near[nodes] = self._diverse(nodes, ids, near.shape[1])
            self._link_back(nodes, level)

    def _link_back(self, nodes: np.ndarray, level: int) -> None:
        near = self.near[level][:, : self._width(level)]
        source = np.repeat(nodes, near.shape[1])
        to = near[nodes].ravel()
        source, to = source[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        source, to = source[order], to[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        width = 2 * near.shape[1]
        while len(to):  # a node that many link to takes them in turns
            now = place < width
            hosts, row = np.unique(to[now], return_inverse=True)
            incoming = np.full((len(hosts), int(place[now].max()) + 1), -1, np.int32)
            incoming[row, place[now]] = source[now]
            known = (incoming[:, :, None] == near[hosts][:, None, :]).any(axis=2)
            incoming[known] = -1
            near[hosts] = self._diverse(hosts, np.concatenate([near[hosts], incoming], 1), near.shape[1])
            source, to, place = source[~now], to[~now], place[~now] - width


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links a - b: every end, and the smallest end that it is joined with."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        low, lower = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(lower, a, low)
        np.minimum.at(lower, b, low)
        lower = lower[lower]
        if (lower == label).all():
            return names, names[label]
        label = lower


class Shard:
    """A shard's vectors, how often each occurs, and their graph. Two vectors link if their cosine is `least` or more."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, least: float, settings: Settings, graph: Graph | None = None):
        self.ids, self.copies, self.vectors, self.least, self.s = ids, copies, vectors, least, settings
        self.exact, self.angle = unit(np.asarray(vectors, np.float64)), float(np.arccos(least))
        self.graph = graph or Graph(self.exact, settings, float(np.cos(self.angle / 2)))
        leader = self.graph.leader
        self.nodes = self.graph.nodes()
        self.order = np.argsort(leader, kind="stable")  # members of a class lie together
        self.begin, self.end = np.searchsorted(leader[self.order], np.arange(len(ids))), np.searchsorted(leader[self.order], np.arange(len(ids)), side="right")
        self.weight = np.bincount(leader, weights=copies, minlength=len(ids)).astype(np.int64)
        away = np.arccos(np.clip(np.einsum("nd,nd->n", self.exact, self.exact[leader]), -1, 1))
        self.radius = np.zeros(len(ids))
        np.maximum.at(self.radius, leader, away)
        self.reach = np.cos(np.minimum(self.angle + self.radius, np.pi)) - 1e-4  # single precision
        self.by_id = np.argsort(ids, kind="stable")

    def packed(self) -> bytes:
        g, upper = self.graph, {}
        for level in range(1, g.top + 1):
            upper[f"rows{level}"] = np.flatnonzero((g.near[level] >= 0).any(axis=1))
            upper[f"near{level}"] = g.near[level][upper[f"rows{level}"]]
        out = BytesIO()
        np.savez(out, ids=self.ids, copies=self.copies, vectors=self.vectors, leader=g.leader, entry=g.entry, top=g.top, lowest=g.near[0], **upper)
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes, least: float, settings: Settings) -> Shard:
        with np.load(BytesIO(data)) as said:
            g = object.__new__(Graph)
            g.v, g.s = np.ascontiguousarray(unit(np.asarray(said["vectors"], np.float64)), np.float32), settings
            g.leader, g.entry, g.top, g.near = said["leader"], int(said["entry"]), int(said["top"]), [said["lowest"]]
            for level in range(1, g.top + 1):
                g.near.append(np.full((len(g.v), settings.links), -1, np.int32))
                g.near[level][said[f"rows{level}"]] = said[f"near{level}"]
            return Shard(said["ids"], said["copies"], said["vectors"], least, settings, g)

    def _touched(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of classes that may hold links. A beam that ends within the widest class's reach is doubled."""
        block = max(16, min(1024, (1 << 25) // max(1, len(self.ids))))
        lowest = self.reach[self.nodes].min()
        parts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(queries), block):
            mine, wide = np.arange(at, min(at + block, len(queries))), min(beam, len(self.nodes))
            while len(mine):
                ids, sims = self.graph.search(queries[mine], wide)
                more = (ids[:, -1] >= 0) & (sims[:, -1] >= lowest) & (wide < len(self.nodes))
                r, c = np.nonzero((ids >= 0) & (sims >= self.reach[ids]) & ~more[:, None])
                parts.append((mine[r], ids[r, c].astype(np.int64)))
                mine, wide = mine[more], min(2 * wide, len(self.nodes))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _linked(self, queries: np.ndarray, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """For each pair: how many vectors of the node's class (copies counted) link with the query, own row included."""
        angle = np.arccos(np.clip(np.einsum("kd,kd->k", queries[q], self.exact[node]), -1, 1))
        out = np.where(angle + self.radius[node] <= self.angle - 1e-7, self.weight[node], 0)
        across = np.flatnonzero((out == 0) & (angle - self.radius[node] <= self.angle + 1e-7))
        across = across[np.argsort(node[across], kind="stable")]
        for part in np.split(across, np.flatnonzero(np.diff(node[across])) + 1) if len(across) else ():
            members = self.order[self.begin[node[part[0]]] : self.end[node[part[0]]]]
            step = max(1, (1 << 22) // len(members))
            for k in range(0, len(part), step):
                some = part[k : k + step]
                out[some] = (queries[q[some]] @ self.exact[members].T >= self.least).astype(float) @ self.copies[members]
        return out

    def _probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors at the linking angle from vectors of the shard, each in a direction of its own, and those vectors."""
        draw = np.random.default_rng(self.s.seed)
        target = draw.choice(len(self.ids), min(self.s.probes, len(self.ids)), replace=False)
        base, aside = self.exact[target], draw.standard_normal((len(target), self.exact.shape[1]))
        aside -= (aside * base).sum(axis=1, keepdims=True) * base
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        aside = np.divide(aside, length, out=np.zeros_like(aside), where=length > 1e-9)
        return unit(base * self.least + aside * np.sqrt(1 - self.least**2)), target

    def _own(self, ids: np.ndarray) -> np.ndarray:
        """Where the rows of these ids are in this shard; -1: elsewhere."""
        at = np.minimum(np.searchsorted(self.ids[self.by_id], ids), len(self.ids) - 1)
        return np.where(self.ids[self.by_id[at]] == ids, self.by_id[at], -1)

    def links(self, query_ids: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
        """id, linked, root, audited, found: linked vectors of every query; ends and roots of links; the audit's sums (id is null)."""
        queries, own = unit(np.asarray(vectors, np.float64)), self._own(query_ids)
        here, beam = np.flatnonzero(own >= 0), self.s.beam
        probes, target = self._probes()
        while True:
            q, node = self._touched(queries, beam)
            pair = np.unique(np.concatenate([q * len(self.ids) + node, here * len(self.ids) + self.graph.leader[own[here]]]))
            q, node = pair // len(self.ids), pair % len(self.ids)
            many = self._linked(queries, q, node)
            linked = np.bincount(q, weights=many, minlength=len(queries)).astype(np.int64)
            linked[here] -= self.copies[own[here]]
            some = np.flatnonzero(linked)
            spread = lambda x: x[np.linspace(0, len(x) - 1, min(self.s.audited // 2, len(x))).astype(int)]
            audited = np.unique(np.concatenate([spread(some), spread(np.arange(len(queries)))]))
            truth = (queries[audited] @ self.exact.T >= self.least).astype(float) @ self.copies - np.where(own[audited] >= 0, self.copies[own[audited]], 0)
            has = truth > 0
            p, met = self._touched(probes, beam)
            seen = np.bincount(p, weights=met == self.graph.leader[target[p]], minlength=len(probes)) > 0
            shares = np.concatenate([linked[audited][has] / truth[has], seen])
            if shares.mean() >= self.s.recall or beam >= len(self.nodes):
                break
            beam *= 2
        real = many > 0
        names, roots = local_roots(query_ids[q[real]], self.ids[node[real]])
        apart = names != roots
        counts = pd.DataFrame({"id": query_ids, "linked": linked, "root": query_ids, "audited": 0, "found": 0.0})
        ends = pd.DataFrame({"id": names[apart], "linked": 0, "root": roots[apart], "audited": 0, "found": 0.0})
        audit = pd.DataFrame({"id": [None], "linked": [0], "root": [0], "audited": [len(shares)], "found": [shares.sum()]})
        return pd.concat([frame.astype({"id": "Int64"}) for frame in (counts, ends, audit)])


_PIECE = 1 << 23


def _links(classes: DataFrame, dim: int, least: float, settings: Settings) -> DataFrame:
    """id, linked, root, audited, found of vectors (id, vector, copies) of one length: blocks of them against every shard."""
    spark, count = classes.sparkSession, classes.count()
    shards = ceil(count * dim / settings.shard_floats)
    blocks = ceil(count / (settings.block_rows * min(shards, 8)))
    number = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    dealt = dealt_evenly(classes.withColumn("shard", number), "shard", min(shards, settings.tasks)).sortWithinPartitions("shard", "id")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def graph() -> pd.DataFrame:
            ids, copies, vectors = (np.concatenate(x) for x in zip(*held))
            data = Shard(ids, copies, vectors, least, settings).packed()
            pieces = [data[k : k + _PIECE] for k in range(0, len(data), _PIECE)]
            return pd.DataFrame({"shard": at, "piece": range(len(pieces)), "data": pieces})

        for batch in batches:
            for own, rows in batch.groupby("shard", sort=True):
                if held and own != at:
                    yield graph()
                    held = []
                at = own
                held.append((rows["id"].to_numpy(), rows["copies"].to_numpy(), np.stack(rows["vector"].to_list())))
        if held:
            yield graph()

    graphs = written(dealt.mapInPandas(build, "shard int, piece int, data binary"), "vector-graphs")
    # a unit of work: a block of queries and a shard's graph, pieces first
    unit_of = (F.col("shard").cast("long") * blocks + F.col("block")).alias("unit")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    pieces = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pieces = pieces.select(unit_of, "piece", none("id", "long"), none("vector", dict(classes.dtypes)["vector"]), "data")
    asked = classes.select("id", "vector", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    asked = asked.select(unit_of, F.lit(1 << 30).alias("piece"), "id", "vector", none("data", "binary"))
    work = dealt_evenly(pieces.unionByName(asked), "unit", min(shards * blocks, settings.tasks)).sortWithinPartitions("unit", "piece", "id")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, data, asked = None, [], []

        def answered() -> pd.DataFrame:
            ids, vectors = (np.concatenate(x) for x in zip(*asked))
            return Shard.unpacked(b"".join(data), least, settings).links(ids, vectors)

        for batch in batches:
            for own, rows in batch.groupby("unit", sort=True):
                if own != at:
                    if asked:
                        yield answered()
                    at, data, asked = own, [], []
                data += [x for x in rows["data"] if x is not None]
                queries = rows[rows["data"].isna()]
                if len(queries):
                    asked.append((queries["id"].to_numpy().astype(np.int64), np.stack(queries["vector"].to_list())))
        if asked:
            yield answered()

    found = written(work.mapInPandas(search, "id long, linked long, root long, audited long, found double"), "vector-links")
    remove(graphs)
    return found


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.9, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept, recall.

    Two vectors link if their cosine is `least` or more. Equal vectors are one class of copies, whatever their ids: searched once,
    and each copy counts as a link of the others. Vectors that are null, zero or of null or non-finite components link with
    nothing, as do rows of a null id; vectors of different lengths do not link. component_id is the smallest vec_id reachable,
    kept says whether that is the row's own. Repeated rows, and unlike vectors of one id, are vectors of their own. recall is the
    mean share of their links that the audited queries and probes of all shards found (null for what links with nothing and where
    there is nothing to audit). Other columns are ignored.

    The number of shards and of blocks follows from the number of rows alone. A block returns a row a query, a row an end of a
    link and one for its audit, however many links there are.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    fine = rows.where(usable("vector") & F.col("vec_id").isNotNull())
    grouped = fine.groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = written(grouped.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    found = spark.createDataFrame([], "id long, linked long, root long, audited long, found double")
    for (dim,) in sorted(tuple(r) for r in classes.select(F.size("vector")).distinct().collect()):
        found = found.unionByName(_links(classes.where(F.size("vector") == dim).select("id", "vector", "copies"), dim, least, settings))
    counts = found.where("id is not null").groupBy("id").agg(F.sum("linked").alias("linked"))
    roots = components(found.where("id != root"), "id", "root").withColumnRenamed("node", "id")
    known = classes.join(counts, "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = written(known.select("vector", "first_id", "root", (F.col("linked") + F.col("copies") - 1).alias("n_links")), "vector-known")
    first = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    audit = found.agg((F.sum("found") / F.sum("audited")).alias("recall"))  # one row
    named = known.join(first, "root").crossJoin(F.broadcast(audit)).drop("first_id", "root")
    linked = fine.join(named, "vector").select("vec_id", "n_links", "component_id", "recall")
    nothing = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall")]
    apart = rows.where(~F.coalesce(usable("vector"), F.lit(False)) | F.col("vec_id").isNull()).select("vec_id", *nothing)
    return linked.unionByName(apart).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "recall")


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))
