"""SimHash near-dedup at a stated Jaccard similarity of distinct word shingles.

A text has a SimHash of 256 bits over its distinct five-word shingles. Texts that share four fifths of them differ
in 39 bits or so and unrelated ones in 128, so a radius of 80 bits holds the ones and leaves out the others. Texts
meet in shards named by the least of their shingles under random orders, one for each order, which two such texts
share four times in five. Texts of the same shingles are one node. Two steps find the links.

Candidates are pairs of a shard within the radius. Ball after ball is taken off a shard: its first row and what lies
within the radius of it, as a BK-tree (children keyed by their integer Hamming distance to the parent). All rows that
are left search the ball's tree and follow only edges within the radius, so every pair of different balls is
compared or ruled out by the triangle inequality, and a group of near copies is not compared with itself.
Candidates join to clusters.

Within a cluster the shingles themselves are compared: only pairs whose exact Jaccard similarity is at least the one
asked for are links. A shard or cluster that many texts share is dealt out by pairs of blocks of its rows, so that
every pair still meets; each task sends on one link for each node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopewise.llm.common import packed, stage, unpacked
from scopewise.llm.components import connected_components
from scopewise.llm.simhash import HASHES_AT_ONCE, SEED

SHINGLE = 5
SIMILARITY = 0.8
#: A fingerprint's bits, in 64-bit words.
LANES = 4
BITS = 64 * LANES
#: Two texts at the similarity differ in 39 bits (standard deviation 5.7) if long, in 48 (6.2) if of five shingles,
#: so 80 bits are passed with a chance of 2e-7 at most; unrelated texts differ in 128 (8).
RADIUS = 80
#: Orders that name shards: two texts at the similarity share none of eight with a chance of 0.2**8.
ORDERS = 8
HOT_SHARD = 2048
#: Searches that run in a tree at once.
SEARCHED_AT_ONCE = 1 << 14
_RANDOM = np.random.default_rng(5)
_TIMES, _PLUS = _RANDOM.integers(1, 1 << 63, ORDERS, dtype=np.uint64) | np.uint64(1), _RANDOM.integers(0, 1 << 63, ORDERS, dtype=np.uint64)
_LANE = _RANDOM.integers(0, 1 << 63, LANES, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    of = xxhash.xxh64_intdigest
    return np.unique(np.array([of(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(max(1, len(words) - SHINGLE + 1))], "<u8"))


def _mixed(values: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over all places."""
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


def describe(text: str | None) -> tuple[np.ndarray, np.ndarray, bytes]:
    """A text's fingerprint, its least shingle under each order, and its shingles' digest."""
    hashes = shingles(text)
    counts, least = np.zeros(BITS, np.int64), np.full(ORDERS, (1 << 64) - 1, np.uint64)
    for low in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[low : low + HASHES_AT_ONCE]
        lanes = _mixed(part[:, None] + _LANE)
        for at in range(0, len(part), 4096):
            counts += np.unpackbits(lanes[at : at + 4096].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        for k in range(ORDERS):
            least[k] = min(least[k], _mixed(part * _TIMES[k] + _PLUS[k]).min())
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8"), least, xxhash.xxh3_128_digest(hashes.tobytes())


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [describe(x.as_py()) for x in batch.column(2)]
        made = [pa.array([x[0].tobytes() for x in found], pa.binary()), pa.array([x[1].view(np.int64).tolist() for x in found], pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "hash", "print", "least", "key"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class BKForest:
    """BK-trees over fingerprints, all built and searched level by level at once. root: for each row the row of its tree's root."""

    def __init__(self, prints: np.ndarray, root: np.ndarray):
        self.prints = prints
        items = np.flatnonzero(root != np.arange(len(root)))
        at, keys, children = root[items], [], []
        while len(items):  # items wait at a node until they are some node's child
            key, first, of = np.unique(at * (BITS + 1) + _apart(prints[items], prints[at]), return_index=True, return_inverse=True)
            keys.append(key)
            children.append(items[first])
            stay = np.ones(len(items), bool)
            stay[first] = False
            at, items = items[first][of][stay], items[stay]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.children = self.keys[order], (np.concatenate(children) if children else np.zeros(0, np.int64))[order]

    def search(self, queries: np.ndarray, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, row) of every row within the radius in the trees whose roots the queries start at."""
        q, hits = np.arange(len(queries)), []
        while len(q):
            far = _apart(queries[q], self.prints[at])
            near = far <= radius
            hits.append((q[near], at[near]))
            low = np.searchsorted(self.keys, at * (BITS + 1) + np.maximum(far - radius, 0))
            n = np.searchsorted(self.keys, at * (BITS + 1) + np.minimum(far + radius, BITS), "right") - low
            q, at = np.repeat(q, n), self.children[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        return np.concatenate([h[0] for h in hits]) if hits else q, np.concatenate([h[1] for h in hits]) if hits else q


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook and jump until both ends of each link have one label, the least."""
    while (label[a] != label[b]).any():
        la, lb = label[a], label[b]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while (label != label[label]).any():
            label[:] = label[label]


def joined(group: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the least row of its component, where rows of the same group within the radius are linked. group is sorted."""
    label = np.arange(len(group))
    if not len(label):
        return label
    order = np.lexsort((label, *prints.T, group))
    same = np.concatenate([[False], (group[order[1:]] == group[order[:-1]]) & (prints[order[1:]] == prints[order[:-1]]).all(axis=1)])
    label[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    open_ = np.sort(order[~same])
    while len(open_):
        start = np.concatenate([[True], group[open_[1:]] != group[open_[:-1]]])
        pivot = open_[np.flatnonzero(start)[np.cumsum(start) - 1]]
        far = _apart(prints[open_], prints[pivot])
        ball = far <= radius
        rows, rest, of = open_[ball], open_[~ball], pivot[~ball]
        wide = pivot[ball & ~start]  # of balls of more than one row
        asks = np.isin(of, wide) & (far[~ball] <= 2 * radius) if len(wide) else np.zeros(len(of), bool)  # beyond, the triangle inequality rules out the whole ball
        if len(wide):
            _join(label, rows, pivot[ball])
        if asks.any():
            place = np.zeros(len(group), np.int64)
            place[rows] = np.arange(len(rows))
            forest = BKForest(prints[rows], place[pivot[ball]])
            who, roots = rest[asks], place[of[asks]]
            for low in range(0, len(who), SEARCHED_AT_ONCE):
                q, hit = forest.search(prints[who[low : low + SEARCHED_AT_ONCE]], roots[low : low + SEARCHED_AT_ONCE], radius)
                _join(label, who[low : low + SEARCHED_AT_ONCE][q], rows[hit])
        open_ = rest
    return label


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, sub, node, print) sorted by the first two -> links of the nodes of each group to its component's least row."""
    left: list[pa.RecordBatch] = []  # rows of the group that the last batch ends in

    def links(rows: pa.Table) -> pa.RecordBatch:
        keys = np.stack([np.asarray(rows.column(i)) for i in range(2)])
        group = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
        nodes = np.asarray(rows.column(2))
        label = joined(group, np.frombuffer(b"".join(rows.column(3).to_pylist()), "<u8").reshape(-1, LANES))
        moved = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [np.asarray(batch.column(i)) for i in range(2)]
        cut = int(np.flatnonzero((ends[0] != ends[0][-1]) | (ends[1] != ends[1][-1])).max(initial=-1)) + 1  # where the last group starts
        if left and not cut and any(left[-1].column(i)[0].as_py() != ends[i][0] for i in range(2)):
            yield links(pa.Table.from_batches(left))
            left = []
        if cut:
            yield links(pa.Table.from_batches([*left, batch.slice(0, cut)]))
            left = []
        left.append(batch.slice(cut))
    if left:
        yield links(pa.Table.from_batches(left))


def _in_runs(linked):
    """Rows (two keys, node, what linked takes) sorted by the keys -> the links that linked(nodes, *rest) finds in each run."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the run that the last batch ends in

        def found(rows: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in linked(*(c.combine_chunks() for c in rows.columns[2:]))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(i)) for i in range(2)])
            if held and any(held[-1].column(i)[held[-1].num_rows - 1].as_py() != keys[i, 0] for i in range(2)):
                if sum(x.num_rows for x in held) > 1:
                    yield found(pa.Table.from_batches(held))
                held = []
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                held.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    if sum(x.num_rows for x in held) > 1:
                        yield found(pa.Table.from_batches(held))
                    held = []
        if sum(x.num_rows for x in held) > 1:
            yield found(pa.Table.from_batches(held))

    return links


def _spread(n: int, near) -> np.ndarray:
    """Components of all links near(row, rows) says; rows that are in a component are not asked again."""
    out, open_ = np.arange(n), np.ones(n, bool)
    for start in range(n):
        if not open_[start]:
            continue
        queue, open_[start] = [start], False
        while queue:
            rest = np.flatnonzero(open_)
            if not len(rest):
                return out
            hit = rest[near(queue.pop(), rest)]
            open_[hit], out[hit] = False, start
            queue += hit.tolist()
    return out


def _exact(similarity: float):
    def linked(nodes: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        nodes, first = np.unique(np.asarray(nodes), return_index=True)  # rows that repeat id and text are one
        label = alike([shingles(texts[i].as_py()) for i in first.tolist()], similarity)
        moved = label != np.arange(len(label))
        return nodes[moved], nodes[label[moved]]

    return linked


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the least set of its component, where sets are linked whose Jaccard similarity is at least the one given."""
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, kept, kept_flat, kept_starts = np.zeros(len(values), np.int32), np.arange(len(sets)), flat, starts[:-1]

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        nonlocal kept, kept_flat, kept_starts
        if 2 * len(rest) < len(kept):
            kept, kept_flat = rest, np.concatenate([flat[starts[k] : starts[k + 1]] for k in rest])
            kept_starts = np.concatenate([[0], np.cumsum(sizes[rest])[:-1]])
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[kept_flat], kept_starts)[np.searchsorted(kept, rest)]
        mark[own] = 0
        return common >= similarity * (sizes[i] + sizes[rest] - common)

    return _spread(len(sets), near)


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows with a column sub: together with by, it names groups in which any two rows that share by meet.

    Rows that are alone go. Many rows are split into blocks by their nodes' hash, and each two blocks make a group.
    """
    blocks = rows.groupBy(by).count().where("count > 1").select(by, F.ceil(F.col("count") / HOT_SHARD).alias("blocks"))
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = rows.join(blocks, by).select("*", own.alias("own"), other.alias("other"))
    return met.withColumn("sub", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).drop("blocks", "own", "other")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, hash (of the text), first (struct of the group's first row: none, id, hash).

    Null and empty texts and texts below five words are one shingle each. The first row of a group is that of the
    smallest id, null ids last, and of rows that share it that of the smallest text hash. Repeated rows are in one
    group; long texts are read whole; an empty table gives an empty table. Other columns are not read. The radius
    is set for similarities of 0.8 and more.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("hash"), F.col(text_col).alias("text"))
    own = stage(rows.mapInArrow(_described, f"id {kind}, hash long, print binary, least array<long>, key binary"), "signatures")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    nodes = stage(own.groupBy("key", "print", "least").agg(F.min(row).alias("first")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    shards = _dealt(nodes.select("node", F.explode("least").alias("shard")), "shard")
    full = shards.join(nodes.select("node", "print"), "node").select("shard", "sub", "node", "print")
    candidates = full.repartition("shard", "sub").sortWithinPartitions("shard", "sub").mapInArrow(_candidates, "u long, v long")
    clusters = stage(_dealt(connected_components(candidates).withColumnRenamed("root", "cluster"), "cluster"), "clusters")
    members = clusters.join(nodes.select("node", F.col("first.id").alias("first"), F.col("first.hash").alias("own")), "node")
    texts = rows.join(members, F.col("id").eqNullSafe(F.col("first")) & (F.col("hash") == F.col("own"))).select("cluster", "sub", "node", "text")
    links = texts.repartition("cluster", "sub").sortWithinPartitions("cluster", "sub").mapInArrow(_in_runs(_exact(similarity)), "u long, v long")
    roots = connected_components(links)
    rooted = nodes.join(roots, "node", "left").select("key", F.col("first").alias("own"), F.coalesce("root", "node").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("own").alias("first"))
    return own.join(rooted.join(firsts, "root").select("key", "first"), "key").select(F.col("id").alias(id_col), "hash", "first")


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The first row of each group, with all its columns; rows that repeat id and text all count as it."""
    first = similar_groups(docs, id_col, text_col, similarity).select(F.col("first.id").alias("first"), F.col("first.hash").alias("hash")).distinct()
    rows = packed(docs, id=F.col(id_col), own=F.coalesce(F.xxhash64(text_col), F.lit(0)))
    return unpacked(rows.join(first, F.col("id").eqNullSafe(F.col("first")) & (F.col("own") == F.col("hash")), "left_semi"), docs)
