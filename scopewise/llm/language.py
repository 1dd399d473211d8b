"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector, made from a seed and its code point. A trigram's vector binds those of
its letters, each permuted by its place: rho^2(a) * rho(b) * c. A text's vector bundles those of its trigrams,
runs of other characters counting as one blank; a language's prototype bundles the texts of its training rows. The
mean of the prototypes, what languages have in common, is taken off both sides, and a text gets the language of
the prototype with the largest cosine.

Prototypes are sums over all training rows, made by task and added up, so they need a few vectors in the driver:
one per language. Prediction is one pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
SEED = 7
#: Characters taken at once, so that memory is bounded for one long text.
CHARACTERS = 1 << 20
#: Trigram vectors kept by a task, trigrams multiplied at once and texts taken together.
KEPT, COLUMNS, TEXTS = 40_000, 8192, 256
UNKNOWN = "und"


class Space:
    """Random vectors for letters, and the vectors bound from them for trigrams, kept in a bounded table."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, dimensions), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.default_rng((self.seed, point)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return self.letters[point]

    def trigrams(self, codes: np.ndarray) -> np.ndarray:
        """A row for each code: three code points of 21 bits."""
        if len(self.rows) + len(codes) > KEPT:
            self.rows.clear()
        at = np.empty(len(codes), np.int64)
        for k, code in enumerate(codes.tolist()):
            row = self.rows.get(code)
            if row is None:
                row = self.rows[code] = len(self.rows)
                if row >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                a, b, c = (self.letter(code >> s & 0x1FFFFF) for s in (42, 21, 0))
                self.table[row] = np.roll(a, 2) * np.roll(b, 1) * c
            at[k] = row
        return self.table[at]

    def bundles(self, texts: list[str | None], of: np.ndarray | None = None) -> np.ndarray:
        """A vector for each text, zero if it has no letter; given ``of``, a sum for each number in it."""
        of = np.arange(len(texts)) if of is None else of
        out = np.zeros((int(of.max()) + 1 if len(of) else 0, self.dimensions), np.float32)
        rows, codes, counts = [], [], []
        for row, text in zip(of.tolist(), texts, strict=True):
            for found, n in trigram_counts(text or ""):
                rows.append(np.full(len(found), row))
                codes.append(found)
                counts.append(n)
        if not codes:
            return out
        distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
        rows, counts = np.concatenate(rows), np.concatenate(counts)
        for low in range(0, len(distinct), COLUMNS):
            own = (at >= low) & (at < low + COLUMNS) if len(distinct) > COLUMNS else slice(None)
            part = distinct[low : low + COLUMNS]
            dense = np.bincount(rows[own] * len(part) + at[own] - low, counts[own], len(out) * len(part)).astype(np.float32)
            out += dense.reshape(len(out), len(part)) @ self.trigrams(part).astype(np.float32)
        return out


#: By code point: the code point itself for letters, a blank for all else.
_LETTER = np.full(0x110000, 0x20, np.uint32)
_ASKED = np.zeros(0x110000 >> 8, bool)


def _letters(points: np.ndarray) -> np.ndarray:
    pages = points >> 8
    for page in np.unique(pages[~_ASKED[pages]]):
        low = int(page) << 8
        _LETTER[low : low + 256] = [p if chr(p).isalpha() else 0x20 for p in range(low, low + 256)]
        _ASKED[page] = True
    return _LETTER[points]


def trigram_counts(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of the distinct trigrams of the text in lower case, and their counts, for a piece of the text at a time; none if it has no letter."""
    text, before = f" {text.lower()} ", np.zeros(0, np.uint32)
    for low in range(0, len(text), CHARACTERS):
        points = _letters(np.frombuffer(text[low : low + CHARACTERS].encode("utf-32-le", "surrogatepass"), np.uint32))
        points = np.concatenate([before, points])  # a piece begins with the last two points of the one before
        blank = points == 0x20
        points = points[~(blank & np.concatenate([[False], blank[:-1]]))]
        before = points[-2:]
        if len(points) > 2:
            wide = points.astype(np.uint64)
            codes = wide[:-2] << np.uint64(42) | wide[1:-1] << np.uint64(21) | wide[2:]
            yield np.unique(codes.view(np.int64), return_counts=True)


def held_out(id_col: Column) -> Column:
    """Whether the crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(zlib.crc32(b""))) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", space: Space | None = None) -> dict[str, np.ndarray]:
    """A prototype for each language of the rows that are not held out."""
    dims, seed = (space or Space()).dimensions, (space or Space()).seed

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = Space(dims, seed), {}
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                langs, texts = (batch.column(k).slice(low, TEXTS).to_pylist() for k in range(2))
                names, of = np.unique(langs, return_inverse=True)
                for lang, vector in zip(names.tolist(), own.bundles(texts, of), strict=True):
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims), pa.array(np.arange(dims), pa.int32()), pa.array(vector)], ["lang", "k", "v"])

    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    parts = rows.mapInArrow(bundled, "lang string, k int, v double").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("v")).select("lang", "v.v").collect():
        out[row.lang] = np.array(row.v)
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", space: Space | None = None) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    score is (1 + cosine) / 2 of the chosen prototype. und with score 0 for null texts, texts without a letter, and
    where no language was learned. Equal cosines go to the first language by name. Null ids are allowed, repeated
    rows give repeated rows, other columns are not read, an empty table gives an empty table.
    """
    dims, seed = (space or Space()).dimensions, (space or Space()).seed
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1) for n in names]).astype(np.float32) if names else np.zeros((0, dims), np.float32)
    mean = matrix.mean(axis=0) if len(names) > 1 else np.zeros(dims, np.float32)
    matrix = matrix - mean
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    kind = docs.schema[id_col].dataType.simpleString()

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Space(dims, seed)
        for batch in batches:
            langs, scores = [], []
            for low in range(0, batch.num_rows, TEXTS):
                vectors = own.bundles(batch.column(1).slice(low, TEXTS).to_pylist())
                sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = vectors / np.maximum(sizes, 1e-12) - mean
                cosines = vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                for size, row in zip(sizes[:, 0], cosines, strict=True):
                    best = int(np.argmax(row)) if names and size else -1
                    langs.append(names[best] if best >= 0 else UNKNOWN)
                    scores.append(min(1.0, max(0.0, (1 + float(row[best])) / 2)) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(predicted, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows that are not held out and predict all; see predict()."""
    return predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
