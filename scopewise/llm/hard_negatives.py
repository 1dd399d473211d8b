"""Hard negatives by norm-bucketed search over integer vectors.

For each anchor, the candidates of the largest inner products with its label are its positives; for each positive,
the candidates of other labels whose scores lie in a window below the positive's are its negatives. Both searches are
exact.

Candidates are put in buckets by norm, each bucket's norms within RATIO of each other: since a norm is below
2**31, there are 727 buckets at most at every size. By Cauchy-Schwarz an anchor's score in a bucket is at most its own norm
times the bucket's top, so an anchor goes only to the buckets that reach the lower limit of its windows. Large buckets
are dealt out in pieces by a hash of the id, anchors in blocks; a task holds one piece and one block. Within a piece
candidates are sorted by norm, longest first, and go by in runs: a run is skipped for every anchor whose bound is
below its lower limit or its running k-th score. The best of all pieces are merged by a window on (anchor, positive).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopewise.llm.common import stage

POSITIVES = NEGATIVES = 5
#: The window of a negative's score, in percent of the positive's.
LOW, HIGH = 80, 100
#: Norms of a bucket differ by this factor at most.
RATIO = 1.03
#: Candidates of a piece and anchors of a block, on average.
PIECE_ROWS, BLOCK_ROWS = 50_000, 50_000
#: A bucket of many runs has so many pieces at least; so many tasks hold all pieces and blocks at most.
LEAST_PIECES, MOST_TASKS = 16, 10_000
#: Candidates of a run, and anchors that meet it at once.
RUN, AT_ONCE = 1024, 256
#: Squared norms below this have inner products that a long holds.
MOST = float(2**62)
#: Least and largest limits.
FLOOR, CEILING = -(2**63), 2**63 - 1
FOUND = "anchor long, anchor_id long, positive_id long, positive_score long, other_id long, score long"


def sound(vector: Column) -> Column:
    """Not null, not empty, every component finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component, as whole doubles; what is not finite stays (floor gives a long)."""

    def whole(x: Column) -> Column:
        x = x.cast("double") * factor
        return F.when(F.abs(x) < 2.0**62, F.floor(x).cast("double")).otherwise(x)

    return F.transform(vector, whole)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of entries that may be among the k best of their row and reach the row's least score; FLOOR marks none."""
    if scores.shape[1] > k:
        least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
    row, column = np.nonzero((scores >= least[:, None]) & (scores > FLOOR))
    return row, ids[column], scores[row, column]


def _searched(k: int, same: bool):
    """A block of anchors (one row per window: lower, upper) against a piece of candidates -> the k best of each window."""

    def found(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((6, 0), np.int64)]
        if len(asked) and len(held):
            norms = np.sqrt(held.c_norm2.to_numpy())
            order = np.argsort(-norms, kind="stable")
            norms, vectors, ids, labels = norms[order], _matrix(held.c_vector)[order], held.c_id.to_numpy()[order], held.c_label.to_numpy()[order]
            spots, lengths = _matrix(asked.vector), np.sqrt(asked.norm2.to_numpy())
            # products in double precision are exact while every partial sum is below 2**53
            exact = norms[0] * lengths.max() < 2**52
            if exact:
                spots, vectors = spots.astype(np.float64), vectors.astype(np.float64)
            for low in range(0, len(asked), AT_ONCE):
                part = asked.iloc[low : low + AT_ONCE]
                upper, anchor, label, least = part.upper.to_numpy(), part.id.to_numpy(), part.label.to_numpy(), part.lower.to_numpy(copy=True)
                best = np.zeros((3, 0), np.int64)  # window, id, score
                for at in range(0, len(ids), RUN):
                    # a little is added to the bound for rounding
                    alive = np.flatnonzero(lengths[low : low + AT_ONCE] * norms[at] * (1 + 1e-9) + 1 >= least)
                    if not len(alive):
                        break
                    scores = spots[low + alive] @ vectors[at : at + RUN].T
                    scores = np.rint(scores).astype(np.int64) if exact else scores
                    fits = (labels[None, at : at + RUN] == label[alive, None]) == same
                    fits &= (ids[None, at : at + RUN] != anchor[alive, None]) & (scores <= upper[alive, None])
                    row, other, score = best_of(np.where(fits, scores, FLOOR), ids[at : at + RUN], k, least[alive])
                    best = np.concatenate([best, np.stack([alive[row], other, score])], axis=1)
                    best = best[:, np.lexsort((best[1], -best[2], best[0]))]
                    best = best[:, np.arange(best.shape[1]) - np.searchsorted(best[0], best[0]) < k]
                    window, starts, count = np.unique(best[0], return_index=True, return_counts=True)
                    full = count == k
                    least[window[full]] = np.maximum(least[window[full]], best[2, starts[full] + k - 1])
                window = best[0]
                out.append(np.stack([part.anchor.to_numpy()[window], anchor[window], part.positive_id.to_numpy()[window], part.positive_score.to_numpy()[window], best[1], best[2]]))
        return pd.DataFrame(dict(zip(("anchor", "anchor_id", "positive_id", "positive_score", "other_id", "score"), np.concatenate(out, axis=1), strict=True)))

    return found


def _best(rows: DataFrame, windows: DataFrame, anchors: int, counts: dict[int, int], k: int, same: bool) -> DataFrame:
    """The k best of each window(anchor, id, label, vector, norm2, positive_id, positive_score, lower, upper) among rows(id, label, vector, norm2, bucket)."""
    blocks = max(1, math.ceil(anchors / BLOCK_ROWS))
    pieces = {b: max(1, math.ceil(n / PIECE_ROWS), min(LEAST_PIECES, math.ceil(n / RUN))) for b, n in counts.items()}
    tasks = min(blocks * sum(pieces.values()), MOST_TASKS)
    place = F.element_at(F.create_map(*[F.lit(x) for pair in pieces.items() for x in pair]), F.col("bucket"))
    key, dim = ["dim", "bucket", "piece", "block"], F.size("vector").alias("dim")
    # named anew: the two sides of a cogroup may not share columns
    held = rows.select(*[F.col(c).alias(f"c_{c}") for c in ("id", "label", "vector", "norm2", "bucket")], F.size("vector").alias("c_dim"), F.pmod(F.xxhash64("id", "vector"), place).cast("int").alias("c_piece"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c_block"))
    tops = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("pieces"), F.lit(RATIO ** (b + 1) * (1 + 1e-6)).alias("top")) for b, n in pieces.items()])
    reached = F.explode(F.filter(tops, lambda t: F.sqrt("norm2") * t["top"] + 1 >= F.col("lower"))).alias("_t")
    asked = windows.select("*", dim, F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block"), reached)
    asked = asked.select("*", F.col("_t.bucket").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("_t.pieces") - 1)).alias("piece")).drop("_t")
    c_key = [f"c_{c}" for c in key]
    asked, held = asked.repartition(tasks, *key), held.repartition(tasks, *c_key)
    found = asked.groupBy(*key).cogroup(held.groupBy(*c_key)).applyInPandas(_searched(k, same), FOUND)
    order = F.row_number().over(Window.partitionBy("anchor", "positive_id", "positive_score").orderBy(F.desc("score"), "other_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = 100, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """Per anchor, a row whose id is divisible by ``every``, and each of its positives: up to ``negatives`` hard negatives.

    Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). A score is the inner product
    with the anchor of vectors whose components are whole numbers (see scaled); ties go to the smaller id. Positives
    are the first other rows of the anchor's label; a negative is of another label and satisfies
    low * positive_score <= 100 * negative_score <= high * positive_score (0 <= low <= high). Windows without a
    negative give no row.

    Rows take no part if the id or label is null, or the vector null, empty or with a null or non-finite component, or
    of a norm of 2**31 or more (its scores might not fit a long). Vectors of another length than the anchor's are no
    candidates. Other rows are those of another id; where rows share an id, each is one of its own, and rows that
    repeat whole count once. An empty table gives an empty result; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & sound(F.col("vector")))
    rows = rows.withColumn("norm2", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).where(F.col("norm2") < MOST)
    # zero vectors share the lowest bucket with those of norm 1
    bucket = F.floor(F.log(F.sqrt(F.greatest("norm2", F.lit(1.0)))) / math.log(RATIO)).cast("int")
    rows = stage(rows.select("id", "label", F.col("vector").cast("array<int>").alias("vector"), "norm2", bucket.alias("bucket")).distinct(), "scaled")
    counts = {r.bucket: r.n for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()} or {0: 0}  # a row per bucket
    anchors = rows.where(F.col("id") % every == 0).select(F.xxhash64("id", "label", "vector").alias("anchor"), "id", "label", "vector", "norm2")
    n = anchors.count()
    none = F.lit(0).cast("long")
    whole = anchors.select("*", none.alias("positive_id"), none.alias("positive_score"), F.lit(FLOOR + 1).cast("long").alias("lower"), F.lit(CEILING).cast("long").alias("upper"))
    first = _best(rows, whole, n, counts, positives, True).where("score >= 0")  # below 0 a window is empty
    first = stage(first.select("anchor", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")).distinct(), "positives")
    score = "positive_score div 100 * {0} + (positive_score % 100 * {0} + {1}) div 100"
    windows = anchors.join(first, "anchor").select("*", F.expr(score.format(low, 99)).alias("lower"), F.expr(score.format(high, 0)).alias("upper"))
    found = _best(rows, windows, n * positives, counts, negatives, False)
    return found.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
