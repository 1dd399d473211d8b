"""Quality classification by importance resampling.

Texts are bags of hashed n-grams. A text's tokens are its maximal runs of word characters (letters, digits and all
that is not ASCII) and of marks; each gives its own hash, the pair with the token before it, and its shape (length,
capitals, digits, the white space before it, whether it repeats the token before), so that a word that no other
text has still tells something. Two generative models are multinomials over the hash buckets: one of the target,
labelled good documents (a bounded number of them), one of the raw text, all documents. A document's log importance
weight is the log ratio of the two over its n-grams. Documents are drawn without replacement in proportion to their
weights by Gumbel top-k: the k largest sums of log weight and Gumbel noise stay. k is the number of documents whose
weight is over the threshold that best divides the labelled ones.

All texts of a batch are hashed together in NumPy, whole words by prefix sums. Counts and weights cover all
documents; what reaches the driver is a model of BUCKETS numbers and histograms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopewise.llm.common import packed, stage, unpacked

BUCKETS = 1 << 16
SEED = 11
#: The target model is fitted on this many labelled documents at most, by hash of their ids; all are used up to it.
LABELLED = 20_000
#: Added to each bucket's count, so that rare n-grams say little.
SMOOTHING = 100.0
#: Bytes hashed at once; a text of more is hashed in blocks that end between tokens.
BLOCK = 1 << 20
BINS = 4096

_RANDOM = np.random.default_rng(SEED)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64)
#: An odd number, the powers of which tell places apart modulo 2**64, and its inverse.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
#: 0: white space, 1: marks, 2: word characters.
_CLASS = np.array([0 if c == 32 or 9 <= c <= 13 else 2 if c >= 128 or chr(c).isalnum() else 1 for c in range(256)], np.int8)
_CAPITAL, _DIGIT = np.array([65 <= c <= 90 for c in range(256)]), np.array([48 <= c <= 57 for c in range(256)])


def _spread(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ values >> np.uint64(27)


def _tokens(data: np.ndarray, power: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and shapes of the tokens in bytes."""
    kind = _CLASS[data]
    edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    ends, own = np.append(edge[1:], len(data)), kind[edge]
    keep = own > 0
    starts, ends, own = edge[keep], ends[keep], own[keep].astype(np.int64)

    def inside(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
        return sums[ends] - sums[starts]

    hashes = _spread(inside(_BYTES[data] * power[0][: len(data)]) * power[1][starts])
    size = np.minimum(ends - starts, 31) // 4
    capitals, digits = inside(_CAPITAL[data].astype(np.int32)), inside(_DIGIT[data].astype(np.int32))
    case = np.where(capitals == 0, 0, np.where((capitals == 1) & _CAPITAL[data[starts]], 1, np.where(2 * capitals > ends - starts, 2, 3)))
    parted = np.where(starts > 0, kind[np.maximum(starts, 1) - 1] == 0, True)
    shape = own * 1024 + size * 64 + case * 16 + np.minimum(digits, 3) * 4 + parted * 2
    return starts, hashes, shape.astype(np.uint64)


class Features:
    """Turns texts into the buckets of their n-grams, block by block."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.power = buckets, (np.ones(0, np.uint64), np.ones(0, np.uint64))

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power[0]) < n:
            self.power = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)])) for x in (_STEP, _BACK))
        return self.power

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of the text, bucket) of every n-gram, a block at a time; every n-gram of a text is in one block."""
        held, at, size = [], [], 0
        for k, text in enumerate(texts):
            data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            if held and size + len(data) > BLOCK:
                yield self._block(held, at)
                held, at, size = [], [], 0
            if len(data) > BLOCK:
                yield from self._long(data, k)
            else:
                held.append(data)
                at.append(k)
                size += len(data) + 1
        if held:
            yield self._block(held, at)

    def _block(self, held: list[np.ndarray], at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Texts side by side with a blank between them."""
        lengths = np.array([len(x) + 1 for x in held])
        data = np.full(lengths.sum(), 32, np.uint8)
        begins = np.cumsum(lengths) - lengths
        for low, x in zip(begins.tolist(), held, strict=True):
            data[low : low + len(x)] = x
        starts, hashes, shapes = _tokens(data, self._powers(len(data)))
        of = np.searchsorted(begins, starts, "right") - 1
        return self._grams(np.array(at)[of], hashes, shapes, of[1:] == of[:-1])

    def _long(self, data: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """One long text; the last token of a block is the first of the next, where only its pair is new."""
        low, before = 0, None
        while low < len(data):
            kind, high = _CLASS[data[low : low + BLOCK]], low + BLOCK
            if high < len(data):
                edges = np.flatnonzero(kind[1:] != kind[:-1])
                high = low + int(edges[-1]) + 1 if len(edges) else high
                while high < len(data) and _CLASS[data[high]] == _CLASS[data[high - 1]]:  # a token of more than a block
                    same = _CLASS[data[high : high + BLOCK]] != _CLASS[data[high - 1]]
                    high += int(same.argmax()) if same.any() else len(same)
            _, hashes, shapes = _tokens(data[low:high], self._powers(high - low))
            if low and len(shapes) and _CLASS[data[low - 1]] and _CLASS[data[low]]:
                shapes[0] &= ~np.uint64(2)  # no white space before it
            if before is not None:
                hashes, shapes = np.concatenate([before[0], hashes]), np.concatenate([before[1], shapes])
            yield self._grams(np.full(len(hashes), k), hashes, shapes, np.ones(max(0, len(hashes) - 1), bool), before is not None)
            before = (hashes[-1:], shapes[-1:]) if len(hashes) else before
            low = high

    def _grams(self, of: np.ndarray, hashes: np.ndarray, shapes: np.ndarray, joined: np.ndarray, again: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """joined: whether a token and the one before it are of one text; again: the first token was counted before."""
        repeats = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & joined])[: len(hashes)]
        pairs = _spread(hashes[:-1] * _STEP ^ hashes[1:])[joined]
        shapes = _spread((shapes + repeats) * _STEP + np.uint64(7))
        own = slice(1 if again else 0, None)
        grams = np.concatenate([hashes[own], shapes[own], pairs])
        return np.concatenate([of[own], of[own], of[1:][joined]]), (grams >> np.uint64(24)).astype(np.int64) % self.buckets


class Model:
    """n-gram counts of the raw text and of the target, by bucket."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        self.raw, self.target = raw, target

    def ratios(self, at: np.ndarray | slice, own: np.ndarray | int = 0, size: int = 0) -> np.ndarray:
        """log p_target - log p_raw of buckets, with own counts (of size n-grams in all) left out of the target; zeros if nothing is left."""
        total = self.target.sum() - size
        scaled = (self.target[at] - own) * (self.raw.sum() / total) if total > 0 else self.raw[at]
        return np.log(scaled + SMOOTHING) - np.log(self.raw[at] + SMOOTHING)


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as (id, text, hash, good): good are those that the target model is fitted on."""
    sample = _good(labels).where("_good").orderBy(F.xxhash64("_id"), "_id").limit(LABELLED)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    return rows.join(F.broadcast(sample), F.col("id") == F.col("_id"), "left").select("id", "text", "hash", F.coalesce("_good", F.lit(False)).alias("good"))


def fit(rows: DataFrame, buckets: int = BUCKETS) -> Model:
    """The model of sampled rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, totals = Features(buckets), np.zeros((2, buckets), np.int64)
        for batch in batches:
            good = np.array(batch.column(1).to_pylist(), bool)
            for of, at in features.blocks(batch.column(0).to_pylist()):
                totals[0] += np.bincount(at, minlength=buckets)
                totals[1] += np.bincount(at[good[of]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets), pa.int32()), pa.array(totals[0]), pa.array(totals[1])], ["bucket", "raw", "target"])

    sums = rows.select("text", "good").mapInArrow(counted, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, a, b in sums:
        raw[bucket], target[bucket] = a, b
    return Model(raw, target)


def _good(labels: DataFrame) -> DataFrame:
    """One row per labelled id: whether all its labels are good."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") == 1).alias("_good"))


def weigh(rows: DataFrame, model: Model) -> DataFrame:
    """One row per sampled row: id, text hash, log_weight, null for texts without a word.

    A document that the target model is fitted on is weighed without its own n-grams, so that it is not liked for
    being known, and a threshold set on labelled documents holds for all others.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, ratios = Features(len(model.raw)), model.ratios(slice(None))
        for batch in batches:
            texts, out, n = batch.column(1).to_pylist(), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            good = np.array(batch.column(3).to_pylist(), bool)
            for of, at in features.blocks([None if g else t for t, g in zip(texts, good, strict=True)]):
                out += np.bincount(of, ratios[at], minlength=len(out))
                n += np.bincount(of, minlength=len(out))
            for row in np.flatnonzero(good):
                own = sum((np.bincount(at, minlength=len(ratios)) for _, at in features.blocks([texts[row]])), np.zeros(len(ratios), np.int64))
                at = np.flatnonzero(own)
                n[row] = own.sum()
                out[row] = own[at] @ model.ratios(at, own[at], n[row])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.float64(), mask=n == 0)], ["id", "hash", "log_weight"])

    return rows.mapInArrow(weighed, f"id {kind}, hash long, log_weight double")


def _histogram(values: DataFrame, column: str, low: float, high: float, *by: str) -> list:
    width = (high - low) / BINS
    at = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col(column) - low) / width))).cast("int").alias("bin")
    return values.groupBy(at, *by).count().collect()


def threshold(weighed: DataFrame, labels: DataFrame) -> float:
    """The weight per which labelled documents divide best: largest sum of both classes' shares on the right side."""
    known = weighed.where("log_weight is not null").join(_good(labels), F.col("id") == F.col("_id"))
    known = known.withColumn("squeezed", F.signum("log_weight") * F.log1p(F.abs("log_weight")))
    low, high = known.agg(F.min("squeezed"), F.max("squeezed")).first()
    if low is None or low == high:
        return -np.inf
    table = np.zeros((2, BINS + 1))
    for at, good, n in _histogram(known, "squeezed", low, high, "_good"):
        table[int(good), at + 1] = n
    if not table.sum(axis=1).all():
        return -np.inf
    below = np.cumsum(table, axis=1) / table.sum(axis=1, keepdims=True)
    gain = below[0] - below[1]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    edge = low + (high - low) / BINS * (best[0] + best[-1]) / 2
    return float(np.sign(edge) * np.expm1(abs(edge)))


def top_k(keyed: DataFrame, column: str, k: int) -> float:
    """The least of the k largest values of a column, by histograms that narrow down to it."""
    low, high = keyed.agg(F.min(column), F.max(column)).first()
    above = 0
    while low is not None and low < high:
        part = keyed.where(F.col(column).between(low, high))
        bins = np.zeros(BINS, np.int64)
        for at, n in _histogram(part, column, low, high):
            bins[at] = n
        from_top = above + np.cumsum(bins[::-1])[::-1]
        at = int(np.flatnonzero(from_top >= k)[-1])
        inside = part.where(F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col(column) - low) / ((high - low) / BINS)))) == at)
        above = int(from_top[at] - bins[at])
        before = low, high
        low, high = inside.agg(F.min(column), F.max(column)).first()
        if (low, high) == before:
            break
    return low


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per input row: id, log_weight, key (log weight and Gumbel noise), kept.

    The noise of a row comes from its id and text, so reruns agree and rows that repeat both share a decision. Texts
    without a word (null, empty, white space) have no weight and don't stay. If labels are missing or all alike,
    every text with a word stays. Ties at the last place all stay. labels(doc_id, quality) may repeat an id: it is
    good if all its labels are. An empty table gives an empty table. Other columns are not read.
    """
    rows = sampled(docs, labels, id_col, text_col)
    weighed = stage(weigh(rows, fit(rows)), "weights")
    edge = threshold(weighed, labels)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "hash"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))
    k = weighed.where(F.col("log_weight") >= edge).count()
    last = top_k(keyed.where("key is not null"), "key", k) if k else None
    kept = F.coalesce(F.col("key") >= last, F.lit(False)) if last is not None else F.lit(False)
    return keyed.select(F.col("id").alias(id_col), "hash", "log_weight", "key", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the resampling keeps, with all their columns."""
    stays = resample(docs, labels, id_col, text_col).where("kept").select(F.col(id_col).alias("stays"), "hash").distinct()
    rows = packed(docs, id=F.col(id_col), own=F.xxhash64(text_col))
    return unpacked(rows.join(stays, F.col("id").eqNullSafe(F.col("stays")) & (F.col("own") == F.col("hash")), "left_semi"), docs)
