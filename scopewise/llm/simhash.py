"""SimHash near-dedup: 64-bit fingerprints of word 3-shingles, linked within a Hamming radius through BK-trees.

Fingerprints, not documents, are linked: all copies of a text are one node. Two fingerprints that differ in at
most two bits agree on at least two of their four 16-bit blocks, so each fingerprint goes to the six shards named
by its pairs of blocks, and a shard whose two blocks many fingerprints share is split again by the pairs of bytes
of the other two. Each shard's fingerprints form BK-trees of bounded size (children keyed by their integer
Hamming distance to the parent); a search follows only the edges within the radius of its distance to a node.
A shard's trees are built in the task that searches them: they grow with the corpus in number, so they are
shuffled to that task and not broadcast. A task sends on one link for each fingerprint, to the smallest one it
reaches within the shard, never all pairs; components then join the shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopewise.llm.common import stage
from scopewise.llm.components import connected_components

RADIUS = 2
SEED = 42
SHINGLE = 3
#: Shards of more fingerprints are split again.
HOT_SHARD = 4096
#: Nodes of a tree, and queries of a search, at most: bounds the memory of a task.
TREE_NODES = 16384
SEARCHED_AT_ONCE = 2048
#: Hashes counted at once, bounds the memory for one long text.
HASHES_AT_ONCE = 65536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if set in over half the shingles' XXH64. No words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and bytes.split are ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    count, counts, of = len(words) - shingle + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for start in range(0, count, HASHES_AT_ONCE):
        runs = [words[start + k : min(start + HASHES_AT_ONCE, count) + k] for k in range(shingle)]
        hashes = np.array([of(b" ".join(z), SEED) for z in zip(*runs, strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > count, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "bits"])


class BKTree:
    """A BK-tree over distinct 64-bit values, built and searched level by level in NumPy."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.child = np.full((len(values), 65), -1, np.int32)
        at, items = np.zeros(max(0, len(values) - 1), np.int64), np.arange(1, len(values))  # items wait at a node
        while len(items):
            edge = np.bitwise_count(values[items] ^ values[at]).astype(np.int64)
            _, first, of = np.unique(at * 65 + edge, return_index=True, return_inverse=True)
            self.child[at[first], edge[first]] = items[first]
            stay = np.ones(len(items), bool)
            stay[first] = False
            at, items = items[first][of][stay], items[stay]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, node) of every node within the radius."""
        q, node, hits = np.arange(len(queries)), np.zeros(len(queries), np.int64), []
        while len(q):
            far = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = far <= radius
            hits.append((q[near], node[near]))
            edges = np.clip(far[:, None] + np.arange(-radius, radius + 1), 0, 65)
            below = np.where((edges > 0) & (edges < 65), self.child[node[:, None], np.minimum(edges, 64)], -1)
            row, _ = np.nonzero(below >= 0)
            q, node = q[row], below[below >= 0].astype(np.int64)
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def reach(values: np.ndarray, radius: int = RADIUS, at_once: int = SEARCHED_AT_ONCE) -> np.ndarray:
    """For each of the distinct values, the index of the smallest that links within the radius lead to."""
    values, label = np.asarray(values), np.arange(len(values))
    for start in range(0, len(values), TREE_NODES):
        tree = BKTree(values[start : start + TREE_NODES])
        for low in range(start, len(values), at_once):
            a, b = tree.search(values[low : low + at_once], radius)
            a, b = a + low, b + start
            while True:  # hook and jump until all ends of a link agree
                la, lb = label[a], label[b]
                if (la == lb).all():
                    break
                least = np.minimum(la, lb)
                np.minimum.at(label, la, least)
                np.minimum.at(label, lb, least)
                while (label != label[label]).any():
                    label = label[label]
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, sub, bits) sorted by shard -> links of each fingerprint to the smallest it reaches there."""

    def linked(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unique(bits)
        root = bits[reach(bits.view(np.uint64))]
        return bits[root != bits], root[root != bits]

    left = None
    for batch in batches:
        rows = np.stack([np.asarray(batch.column(i)) for i in range(3)])
        rows = rows if left is None else np.concatenate([left, rows], axis=1)
        cuts = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
        runs = np.split(rows, cuts, axis=1)
        left = runs.pop()
        found = [linked(x[2]) for x in runs if x.shape[1] > 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["u", "v"])
    if left is not None and left.shape[1] > 1:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in linked(left[2])], ["u", "v"])


def _links_of(prints: DataFrame) -> DataFrame:
    """Links that connect all fingerprints within the radius; prints(bits) is distinct."""

    def part(k: int, width: int):
        return F.shiftrightunsigned("bits", k * width).bitwiseAND(F.lit((1 << width) - 1))

    shards = []
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        m, n = (x for x in range(4) if x not in (i, j))
        other = F.shiftleft(part(m, 16), 16).bitwiseOR(part(n, 16))
        shards.append(F.struct((F.lit(k << 32) + F.shiftleft(part(i, 16), 16) + part(j, 16)).cast("long").alias("shard"), other.cast("long").alias("other")))
    rows = prints.select("bits", F.inline(F.array(*shards)))
    hot = rows.groupBy("shard").count().where(F.col("count") > HOT_SHARD).select("shard", F.lit(True).alias("hot"))

    def byte(k: int):
        return F.shiftrightunsigned("other", 8 * k).bitwiseAND(F.lit(255))

    again = F.array(*(F.lit(1 + k << 16) + F.shiftleft(byte(i), 8) + byte(j) for k, (i, j) in enumerate(combinations(range(4), 2))))
    dealt = rows.join(hot, "shard", "left").select("shard", F.explode(F.when(F.col("hot"), again).otherwise(F.array(F.lit(0).cast("long")))).alias("sub"), "bits")
    return dealt.repartition("shard", "sub").sortWithinPartitions("shard", "sub").mapInArrow(_links, "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts have fingerprint zero and are linked like any other. Null ids never name a component
    unless it has no other. Repeated rows are linked as copies are; other columns are not read; an empty table
    gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, f"id {kind}, bits long"), "fingerprints")
    nodes = stage(own.groupBy("bits").agg(F.min("id").alias("least")), "nodes")
    roots = connected_components(_links_of(nodes.select("bits")))
    rooted = nodes.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("bits", "component_id")
    return own.join(named, "bits").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
