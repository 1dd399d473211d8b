"""A vector index that is built once, saved, grown and searched: layered navigable graphs, one for each shard of a scope.

A shard's points get random levels, each level an e-th part of the one below. A point is entered by a greedy descent from
the top, a wider search on its own levels, and links to neighbours that are nearer to it than to each other. The index
is a Parquet table with a row for each point, its links by level, in folders by a hash of the scope: a search loads a
shard in the task that searches it and reads only the folders of the scopes it asks for; an insertion loads, grows and
rewrites only the folders that new points fall in.

Scopes of many points have many shards, dealt by a hash of the id. Every question of a scope goes to each of its shards,
in blocks, and the best of all shards win. Levels come from a hash of the id, so that an index is the same however often
it is built.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopewise.sources.staging import size_of

#: Links of a point on upper levels (twice as many on the lowest), points that an insertion and a search keep in view.
LINKS, BUILD_VIEW, VIEW = 16, 128, 128
#: Points of a shard and questions of a block, on average; folders of an index.
SHARD_ROWS, QUESTION_ROWS, FOLDERS = 50_000, 20_000, 16
#: Questions that an exact check takes at once.
CHECKED = 64
METRICS = ("cosine", "l2")


class Layers:
    """Points, their levels and links; distances by one metric."""

    def __init__(self, metric: str, dims: int, links: int = LINKS, view: int = BUILD_VIEW):
        self.metric, self.width, self.view = metric, links, view
        self.points = np.zeros((0, dims), np.float32)
        self.levels: list[int] = []
        self.links: list[list[list[int]]] = []  # by point, by level
        self.entry = -1

    def _scaled(self, vectors: np.ndarray) -> np.ndarray:
        if self.metric == "l2":
            return vectors
        lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)

    def _far(self, point: np.ndarray, ids: list[int] | np.ndarray) -> np.ndarray:
        """Distances that sort as the metric's: squared l2, which orders unit vectors as cosine does."""
        d = self.points[ids] - point
        return np.einsum("ij,ij->i", d, d)

    def _search(self, point: np.ndarray, start: list[tuple[float, int]], view: int, level: int) -> list[tuple[float, int]]:
        """The ``view`` nearest (distance, point) that links of a level lead to, nearest first."""
        seen, open_ = {p for _, p in start}, list(start)
        heapq.heapify(open_)
        best = [(-d, p) for d, p in start]
        heapq.heapify(best)
        while open_:
            d, p = heapq.heappop(open_)
            if len(best) >= view and d > -best[0][0]:
                break
            new = [q for q in self.links[p][level] if q not in seen]
            if not new:
                continue
            seen.update(new)
            for far, q in zip(self._far(point, new).tolist(), new, strict=True):
                if len(best) < view or far < -best[0][0]:
                    heapq.heappush(open_, (far, q))
                    heapq.heappush(best, (-far, q))
                    if len(best) > view:
                        heapq.heappop(best)
        return sorted((-d, p) for d, p in best)

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Those nearer to the point than to any kept before; the places left go to the nearest others."""
        kept: list[int] = []
        others: list[int] = []
        for far, p in found:
            if len(kept) == most:
                break
            if kept and (self._far(self.points[p], kept) < far).any():
                others.append(p)
            else:
                kept.append(p)
        return kept + others[: most - len(kept)]

    def _descended(self, point: np.ndarray, to: int) -> list[tuple[float, int]]:
        start = [(float(self._far(point, [self.entry])[0]), self.entry)]
        for level in range(self.levels[self.entry], to, -1):
            start = self._search(point, start, 1, level)
        return start

    def insert(self, vectors: np.ndarray, levels: list[int]) -> None:
        first = len(self.points)
        self.points = np.concatenate([self.points, self._scaled(vectors)])
        for new, level in enumerate(levels, first):
            point = self.points[new]
            self.levels.append(level)
            self.links.append([[] for _ in range(level + 1)])
            if self.entry < 0:
                self.entry = new
                continue
            top = self.levels[self.entry]
            start = self._descended(point, level)
            for at in range(min(level, top), -1, -1):
                start = self._search(point, start, self.view, at)
                most = self.width * (1 if at else 2)
                self.links[new][at] = self._diverse(start, self.width)
                for p in self.links[new][at]:
                    mine = self.links[p][at]
                    mine.append(new)
                    if len(mine) > most:
                        self.links[p][at] = self._diverse(sorted(zip(self._far(self.points[p], mine).tolist(), mine, strict=True)), most)
            if level > top:
                self.entry = new

    def nearest(self, vector: np.ndarray, k: int, view: int) -> list[int]:
        if self.entry < 0:
            return []
        point = self._scaled(vector[None, :])[0]
        return [p for _, p in self._search(point, self._descended(point, 0), max(k, view), 0)[:k]]


def level_of(chunk_id, links: int = LINKS) -> int:
    """A random level, by a hash of the id: at level l or above is one point in links**l."""
    return int(-math.log((zlib.crc32(str(chunk_id).encode()) + 1) / (2**32 + 1)) / math.log(links))


def _loaded(rows: pd.DataFrame, metric: str) -> Layers:
    rows = rows.sort_values("node")
    layers = Layers(metric, len(rows.embedding.iloc[0]))
    layers.points = layers._scaled(np.stack(rows.embedding.to_numpy()))
    layers.links = [[[int(p) for p in level] for level in links] for links in rows.links]
    layers.levels = [len(x) - 1 for x in layers.links]
    layers.entry = int(np.argmax(layers.levels))  # the first of the highest, as it was when built
    return layers


def _grown(metric: str):
    """A shard's rows (node is null for new points) -> its rows with the new points entered, in the order of their ids."""

    def grown(rows: pd.DataFrame) -> pd.DataFrame:
        old, new = rows[rows.node.notna()].sort_values("node"), rows[rows.node.isna()].sort_values("chunk_id")
        vectors = np.stack(rows.embedding.to_numpy())
        layers = _loaded(old, metric) if len(old) else Layers(metric, vectors.shape[1])
        if len(new):
            layers.insert(np.stack(new.embedding.to_numpy()), [level_of(c) for c in new.chunk_id])
        both = pd.concat([old, new])
        return both.assign(node=np.arange(len(both)), links=layers.links)

    return grown


def _within(vectors: np.ndarray, points: np.ndarray, reached: np.ndarray, metric: str) -> Iterator[np.ndarray]:
    """For each of points the vectors that are no farther than its ``reached``, and what rounding can't tell from them."""
    held, asked = vectors.astype(np.float64), points.astype(np.float64)
    held2, asked2 = (held * held).sum(axis=1), (asked * asked).sum(axis=1)
    if metric == "cosine":
        held, asked = (np.divide(x, np.sqrt(n)[:, None], out=np.zeros_like(x), where=n[:, None] > 0) for x, n in ((held, held2), (asked, asked2)))
    for at in range(0, len(asked), CHECKED):
        part = slice(at, at + CHECKED)
        products = asked[part] @ held.T
        for row, own, far in zip(products, asked2[part], reached[part], strict=True):
            if metric == "cosine":
                yield np.flatnonzero(1 - row <= far + 1e-5)
            else:
                yield np.flatnonzero(held2 + own - 2 * row <= far * far + 1e-5 * (held2 + own))


def _sound(rows: DataFrame, dims: int | None) -> DataFrame:
    """Rows with a vector of finite numbers in single precision, of the index's dimension if it has one."""
    rows = rows.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.where(F.size("embedding") == dims) if dims else rows.where(F.size("embedding") > 0)


class Index:
    """An index in a folder: insert() builds it or grows it, search() asks it, size() is what it takes on disk."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine", dims: int | None = None, shard_rows: int = SHARD_ROWS):
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        self.spark, self.path, self.metric, self.dims, self.shard_rows = spark, path, metric, dims, shard_rows

    def _folder(self):
        return F.pmod(F.xxhash64(F.col("scope").cast("string")), F.lit(FOLDERS)).cast("int").alias("folder")

    def exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def insert(self, chunks: DataFrame) -> None:
        """Enter chunks(chunk_id, scope, embedding); ids that a scope has already stay as they are. Rows without an id, a scope or a sound vector are left out.

        The shards of a scope are as many as its first rows need; later ones make them larger.
        """
        new = _sound(chunks.select("chunk_id", "scope", F.col("embedding").cast("array<float>").alias("embedding")), self.dims)
        new = new.where("chunk_id IS NOT NULL AND scope IS NOT NULL").dropDuplicates(["scope", "chunk_id"])
        new = new.select("*", self._folder(), F.size("embedding").alias("dim"))
        key = ["folder", "scope", "shards", "shard", "dim"]
        if self.exists():
            held = self.rows()
            touched = new.select("folder").distinct()
            old = held.join(touched, "folder", "left_semi")  # whole folders are rewritten
            new = new.join(held.select("folder", "scope", "chunk_id"), ["folder", "scope", "chunk_id"], "left_anti")
            known = held.groupBy("folder", "scope").agg(F.max("shards").alias("known"))
        else:
            old = None
            known = new.select("folder", "scope").limit(0).withColumn("known", F.lit(1))
        sizes = new.groupBy("folder", "scope").agg(F.ceil(F.count("*") / self.shard_rows).cast("int").alias("needed"))
        sizes = sizes.join(known, ["folder", "scope"], "left").select("folder", "scope", F.coalesce("known", "needed").alias("shards"))
        placed = new.join(sizes, ["folder", "scope"]).withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.col("shards")).cast("int"))
        rows = placed.select("chunk_id", "scope", "embedding", *[c for c in key if c != "scope"], F.lit(None).cast("long").alias("node"), F.lit(None).cast("array<array<int>>").alias("links"))
        rows = rows if old is None else old.select(rows.columns).unionByName(rows)
        grown = rows.groupBy(*key).applyInPandas(_grown(self.metric), rows.schema)
        grown.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(self.path)

    def size(self) -> tuple[int, int]:
        """(points, bytes)."""
        return self.rows().count(), size_of(self.spark, self.path)

    def search(self, queries: DataFrame, k: int, view: int = VIEW, exact: bool = False) -> DataFrame:
        """(query_id, chunk_id, distance, score, rank): the k nearest found of each of queries(query_id, scope, embedding) in its scope.

        Distance is 1 - cosine, score (1 + cosine) / 2 x 100; or l2 and 100 / (1 + distance). Ties go to the smaller
        id. The folders of other scopes are not read. With ``exact``, what a shard's graph has found is checked: points that
        it missed and that are no farther than its k-th join them. The check is a product of a shard's points and questions.
        """
        asked = _sound(queries.select("query_id", "scope", F.col("embedding").cast("array<float>").alias("embedding")), self.dims)
        asked = asked.select(F.col("scope").alias("q_scope"), "query_id", F.col("embedding").alias("point"), self._folder().alias("q_folder"), F.size("embedding").alias("q_dim"))
        held = self.rows()
        folders = F.broadcast(asked.select(F.col("q_folder").alias("folder")).distinct())  # FOLDERS rows at most
        held = held.join(folders, "folder", "left_semi")
        shards = held.select("scope", "shard", "dim").distinct()
        blocks = asked.groupBy(F.col("q_scope").alias("b_scope")).agg(F.ceil(F.count("*") / QUESTION_ROWS).cast("int").alias("blocks"))
        asked = asked.join(blocks, F.col("q_scope") == F.col("b_scope")).drop("b_scope")
        asked = asked.join(shards.select(F.col("scope").alias("q_scope"), F.col("shard").alias("q_shard"), F.col("dim").alias("q_dim")), ["q_scope", "q_dim"])
        asked = asked.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks", "q_folder")
        held = held.join(blocks.withColumnRenamed("b_scope", "scope"), "scope").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        metric, kinds = self.metric, {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", queries), ("chunk_id", held))}

        def found(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asked) and len(held):
                held = held.sort_values("node")
                layers, ids, vectors = _loaded(held, metric), held.chunk_id.to_numpy(), np.stack(held.embedding.to_numpy())

                def distances(near: list[int] | np.ndarray, point: np.ndarray) -> np.ndarray:
                    # products in single precision, summed in double
                    if metric == "l2":
                        return np.sqrt(((vectors[near] - point) ** 2).sum(axis=1, dtype=np.float64))
                    size = np.sqrt((vectors[near] ** 2).sum(axis=1, dtype=np.float64)) * np.sqrt((point * point).sum(dtype=np.float64))
                    return 1 - np.divide((vectors[near] * point).sum(axis=1, dtype=np.float64), size, out=np.zeros(len(near)), where=size > 0)

                points = np.stack(asked.point.to_numpy())
                nears = [layers.nearest(point, max(view, k), view) for point in points]
                if exact:
                    reached = [np.partition(far, k - 1)[k - 1] if len(far) >= k else np.inf for far in map(distances, nears, points)]
                    nears = _within(vectors, points, np.array(reached), metric)
                for query, point, near in zip(asked.query_id, points, nears, strict=True):
                    far = distances(near, point)
                    best = sorted(zip(np.round(far, 9), [ids[p] for p in near], far, strict=True))[:k]
                    out += [(query, i, f) for _, i, f in best]
            return pd.DataFrame(out, columns=["query_id", "chunk_id", "distance"])

        schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, distance double"
        near = asked.groupBy("q_scope", "q_shard", "q_dim", "q_block").cogroup(held.groupBy("scope", "shard", "dim", "block")).applyInPandas(found, schema)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "chunk_id"))
        score = F.lit(100.0) / (F.lit(1.0) + F.col("distance")) if metric == "l2" else (F.lit(1.0) - F.col("distance") / 2) * 100
        return near.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", score)
