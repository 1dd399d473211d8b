"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Vectors are dealt to shards by a hash of their value. A shard's graph starts random; each vector in turn is
searched for greedily, and what the search met is pruned to its out-edges: the nearest goes in and removes the
candidates that are closer to it, by a factor, than to the vector, so edges stay few and diverse. Edges are
returned and pruned where they overflow. A query's beam search runs in every shard and the best of all shards
win. The largest inner product is the nearest neighbour once vectors are brought to one length by one more
coordinate (0 for queries). That coordinate must stay small beside the others, or all points look alike: the vectors of
a shard are sorted into classes of length, SPREAD apart at most, and each class has a graph of its own, scaled by its
longest vector. A query takes the classes longest first and leaves out those in which, by its own length times the
longest, nothing can beat what it has.

Equal vectors are one node, with the smallest ids they can need, so a vector that a third of the rows repeat
neither skews a shard nor spoils its graph. A shard holds SHARD_ROWS vectors at most by expectation, at every size
one graph, which is built once and staged; a task searches one shard for one block of queries, so its memory is
bounded. Every query visits every shard: inner products of vectors without clusters can't be routed to a few.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopewise.llm.common import stage

DEGREE, BEAM, SLACK = 32, 192, 1.2
BUILD_BEAM = 40
#: Graphs of so many nodes at most are entered at every node; the beam must be as wide at least.
SMALL = 128
SHARDS = 8
SHARD_ROWS = 100_000
#: Queries, on average, that search a shard in one task.
QUERY_ROWS = 50_000
#: Lengths in a class differ by this factor at most.
SPREAD = 1.1
NEAREST = 20
EVERY = 20
#: Points and queries searched at once.
AT_ONCE = 512


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    """Lengths of vectors of any finite size: squares are taken of components beside the largest."""
    most = np.abs(vectors).max(axis=1, initial=0)
    safe = np.where(most > 0, most, 1)
    return most * np.sqrt(((vectors / safe[:, None]) ** 2).sum(axis=1))


def classes_of(vectors: np.ndarray) -> np.ndarray:
    """The class of length of each vector, the longest in the highest; length 1 is in the middle of one."""
    return np.rint(np.log(np.maximum(lengths_of(vectors), 5e-324)) / math.log(SPREAD)).astype(np.int64)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors over the longest one's length, brought to length 1 by one more coordinate."""
    lengths = lengths_of(vectors)
    top = lengths.max(initial=0) or 1.0
    # twice, as the inverse of a tiny length is no number
    scaled = vectors / top if top > 1e-300 else vectors * 1e300 / (top * 1e300)
    lift = np.sqrt(np.maximum(1 - (scaled * scaled).sum(axis=1), 0))
    return np.concatenate([scaled, lift[:, None]], axis=1).astype(np.float32)


class Graph:
    """A robust-pruned graph over distinct vectors (rows)."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, slack: float = SLACK, seed: int = 1):
        self.points = lifted(vectors)
        self.degree, self.slack = degree, slack
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.edges = np.full((n, degree), -1, np.int32)
        if n > 1:
            some = rng.integers(0, n - 1, (n, min(degree // 2, n - 1)))
            some += some >= np.arange(n)[:, None]
            self.edges[:, : some.shape[1]] = some
        middle = int(np.argmin(((self.points - self.points.mean(axis=0)) ** 2).sum(axis=1))) if n else 0
        # a search of a small graph starts everywhere
        self.entries = np.unique(np.append(rng.integers(0, max(n, 1), 7), middle)) if n > SMALL else np.arange(n)
        order = rng.permutation(n)
        for low in range(0, n, AT_ONCE // 2):
            self._insert(order[low : low + AT_ONCE // 2], beam)

    def _far(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        d = self.points[ids] - points[:, None, :]
        return np.einsum("ijk,ijk->ij", d, d)

    def search(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each point when nothing in it is left to expand: ids (-1: none) and squared distances."""
        rows = np.arange(len(points))
        seen = np.zeros((len(points), len(self.points)), bool)
        start = self.entries[:beam]
        ids = np.full((len(points), beam), -1, np.int64)
        far = np.full((len(points), beam), np.inf, np.float32)
        done = np.ones((len(points), beam), bool)
        ids[:, : len(start)] = start
        far[:, : len(start)] = self._far(points, np.broadcast_to(start, (len(points), len(start))))
        done[:, : len(start)] = False
        seen[:, start] = True
        while len(rows):
            next_far = np.where(done[rows], np.inf, far[rows])
            pick = next_far.argmin(axis=1)
            alive = np.isfinite(next_far[np.arange(len(rows)), pick])
            rows, pick = rows[alive], pick[alive]
            if not len(rows):
                break
            done[rows, pick] = True
            near = self.edges[ids[rows, pick]].astype(np.int64)
            new = (near >= 0) & ~seen[rows[:, None], near]
            seen[rows[:, None], near] |= near >= 0
            near = np.where(new, near, 0)
            new_far = np.where(new, self._far(points[rows], near), np.inf)
            all_far = np.concatenate([far[rows], new_far], axis=1)
            best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            far[rows] = np.take_along_axis(all_far, best, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], axis=1), best, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], ~new], axis=1), best, 1)
        return np.where(np.isfinite(far), ids, -1), far

    def _pruned(self, of: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Out-edges for each vector of ``of`` from its row of candidates (-1: none)."""
        candidates = np.sort(candidates, axis=1)
        twice = np.concatenate([np.zeros((len(of), 1), bool), candidates[:, 1:] == candidates[:, :-1]], axis=1)
        alive = (candidates >= 0) & (candidates != of[:, None]) & ~twice
        safe = np.where(candidates >= 0, candidates, 0)
        spots = self.points[safe]
        far = np.where(alive, self._far(self.points[of], safe), np.inf)
        out = np.full((len(of), self.degree), -1, np.int32)
        rows = np.arange(len(of))
        for k in range(self.degree):
            pick = far.argmin(axis=1)
            found = np.isfinite(far[rows, pick])
            if not found.any():
                break
            out[found, k] = safe[rows, pick][found]
            d = spots - spots[rows, pick][:, None, :]
            between = np.einsum("ijk,ijk->ij", d, d)
            far[self.slack**2 * between <= far] = np.inf
            far[rows, pick] = np.inf
        return out

    def _insert(self, of: np.ndarray, beam: int) -> None:
        met, _ = self.search(self.points[of], beam)
        self.edges[of] = self._pruned(of, np.concatenate([met, self.edges[of]], axis=1))
        source, target = np.repeat(of, self.degree), self.edges[of].ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        nodes, starts = np.unique(target[order], return_index=True)
        lists = np.split(source[order], starts[1:])
        wide = max(map(len, lists), default=0)
        extra = np.full((len(nodes), wide), -1, np.int64)
        for row, x in zip(extra, lists, strict=True):
            row[: len(x)] = x
        both = np.concatenate([self.edges[nodes], extra], axis=1)
        fits = (both >= 0).sum(axis=1) <= self.degree
        for low in range(0, int((~fits).sum()), AT_ONCE):
            part = np.flatnonzero(~fits)[low : low + AT_ONCE]
            self.edges[nodes[part]] = self._pruned(nodes[part], both[part])
        kept = np.sort(both[fits], axis=1)[:, ::-1][:, : self.degree]
        self.edges[nodes[fits], : kept.shape[1]] = kept


GRAPH = "dim int, shard int, class long, node long, embedding array<double>, ids array<long>, edges array<long>, entry boolean"


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    """Rows (dim, shard, vec_id, embedding) of one shard -> a row for each node of its graphs, one graph a class."""
    vectors, node = np.unique(np.stack(shard.embedding.to_numpy()), axis=0, return_inverse=True)
    ids = [np.unique(x) for x in np.split(shard.vec_id.to_numpy()[np.argsort(node, kind="stable")], np.cumsum(np.bincount(node))[:-1])]
    # a small shard is one graph, in which all nodes are met
    kinds, parts = classes_of(vectors) if len(vectors) > SMALL else np.zeros(len(vectors), np.int64), []
    for kind in np.unique(kinds):
        of = np.flatnonzero(kinds == kind)
        graph = Graph(vectors[of])
        entry = np.zeros(len(of), bool)
        entry[graph.entries] = True
        edges = [row[row >= 0].astype(np.int64) for row in graph.edges]
        parts.append(pd.DataFrame({"dim": shard.dim.iloc[0], "shard": shard.shard.iloc[0], "class": kind, "node": np.arange(len(of)), "embedding": list(vectors[of]), "ids": [ids[k] for k in of], "edges": edges, "entry": entry}))
    return pd.concat(parts)


def _loaded(nodes: pd.DataFrame) -> tuple[np.ndarray, list, Graph]:
    """(vectors, ids, graph) from the rows of one graph."""
    nodes = nodes.sort_values("node")
    vectors, graph = np.stack(nodes.embedding.to_numpy()), Graph.__new__(Graph)
    graph.points, graph.entries = lifted(vectors), np.flatnonzero(nodes.entry.to_numpy(bool))
    graph.edges = np.full((len(nodes), max(map(len, nodes.edges), default=0) or 1), -1, np.int32)
    for row, edges in zip(graph.edges, nodes.edges, strict=True):
        row[: len(edges)] = edges
    return vectors, nodes.ids.tolist(), graph


def _search(nearest: int, beam: int):
    """Rows of one shard's graphs (node is set) and of a block of queries (ids: the query's) -> what the beam search finds."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, asked = rows[rows.node.notna()], rows[rows.node.isna()]
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(nodes) and len(asked):
            graphs = [_loaded(nodes[nodes["class"] == kind]) for kind in sorted(nodes["class"].unique(), reverse=True)]
            queries, points = np.array([x[0] for x in asked.ids], np.int64), np.stack(asked.embedding.to_numpy())
            lengths = lengths_of(points)
            for low in range(0, len(queries), AT_ONCE):
                block, query = points[low : low + AT_ONCE], queries[low : low + AT_ONCE]
                best = [(np.zeros(0, np.int64), np.zeros(0))] * len(block)
                with np.errstate(over="ignore", invalid="ignore"):
                    for vectors, ids, graph in graphs:
                        bound = lengths[low : low + AT_ONCE] * lengths_of(vectors).max() * (1 + 1e-9)
                        alive = np.array([len(b[0]) < nearest or not bound[k] < b[1][-1] for k, b in enumerate(best)], bool)
                        part = np.flatnonzero(alive)
                        if not len(part):
                            continue
                        directed = block[part] / np.abs(block[part]).max(axis=1)[:, None]
                        directed /= np.sqrt((directed * directed).sum(axis=1))[:, None]
                        near = graph.search(np.pad(directed.astype(np.float32), ((0, 0), (0, 1))), beam)[0]
                        for k, met in zip(part, near, strict=True):
                            met = met[met >= 0]
                            if len(met) <= nearest < len(vectors):
                                met = np.arange(len(vectors))  # a beam that runs dry in a graph of several parts
                            score = np.repeat(vectors[met] @ block[k], [len(ids[n]) for n in met])
                            vec = np.concatenate([ids[n] for n in met])
                            vec, score = np.append(best[k][0], vec[vec != query[k]]), np.append(best[k][1], score[vec != query[k]])
                            order = np.lexsort((vec, -score))[:nearest]
                            best[k] = vec[order], score[order]
                parts += [(np.full(len(vec), q), vec, score) for q, (vec, score) in zip(query, best, strict=True)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    return found


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, every: int = EVERY, beam: int = BEAM) -> DataFrame:
    """The nearest found of each query, a row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Nearness is the largest inner product, in double precision on the original vectors; ties go to the smaller id.
    Candidates are all rows but those of the query's own id. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows without an id; vectors are compared with those of as many components only.
    Lengths may differ by any factor; products beyond a double are infinite, and then ties.
    Rows that repeat id and vector count once. Other columns are not read.
    """
    sound = F.size("embedding") > 0
    sound &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & sound)
    total, queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, blocks = max(SHARDS, math.ceil(total / SHARD_ROWS)), max(1, math.ceil(queries / QUERY_ROWS))
    dim, place = F.size("embedding").alias("dim"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")
    fewest = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))  # a query leaves out its own
    index = rows.withColumn("_k", fewest).where(F.col("_k") <= nearest + 1).select("vec_id", "embedding", dim, place.alias("shard"))
    graphs = stage(index.repartitionByRange(shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(_build, GRAPH), "graphs")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "embedding"])
    asked = asked.select(dim, "embedding", F.array("vec_id").alias("ids"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    sought = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).unionByName(asked, allowMissingColumns=True)
    key = ["dim", "shard", "block"]
    found = sought.repartitionByRange(shards * blocks, *key).groupBy(*key).applyInPandas(_search(nearest, beam), "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", best).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
