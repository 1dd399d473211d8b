"""Substring dedup by content-defined chunking.

Texts are cut into small chunks where a gear rolling hash of the last bytes says so, so that a passage is cut the
same way wherever it stands and whatever is inserted before it. A chunk's first occurrence, in the order of ids
and positions, owns it; later ones are repeats. Chunks are compared by a 64-bit digest; as only unbroken runs of
repeats of many words count, one chance agreement decides nothing.

Owners are minima, combined before the shuffle; the join that finds the repeats deals the rows of a chunk that a
great part of all documents share over many tasks. Runs are put together within a document. A run holds whole
chunks only: it falls short of the passage by a part of a chunk at either end, so fewer words than the passage's
make a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopewise.llm.common import held, packed, spread_join, stage, unpacked
from scopewise.llm.gear import cuts

#: Chunks are 28 bytes on average, so a passage of 50 words holds many. MOST is below 2**12: a place is one number.
BITS = 4
LEAST = 12
MOST = 192
#: Words that a run of repeated chunks has at least, for passages of over 50 words.
RUN_WORDS = 25
#: White space counts as spaces, so a passage may be wrapped otherwise.
SPACES = bytes(0x20 if 9 <= c <= 13 else c for c in range(256))


def chunks_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end in bytes, word starts and digest of each chunk of a text."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(SPACES)
    array = np.frombuffer(data, np.uint8)
    ends = cuts(array, BITS, LEAST, MOST)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    space = array == 0x20
    first = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))]) if len(array) else np.zeros(1, np.int64)
    of = xxhash.xxh3_64_intdigest
    digests = np.array([of(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    return starts, ends, first[ends] - first[starts], digests.view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "hash", "at", "digest"]
    for batch in batches:
        for part in range(0, batch.num_rows, 256):
            rows = batch.slice(part, 256)
            found = [chunks_of(x.as_py()) for x in rows.column(2)]
            of = pa.array(np.repeat(np.arange(rows.num_rows), [len(x[0]) for x in found]))
            starts, ends, words, digests = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(of), rows.column(1).take(of), pa.array(starts << 24 | ends - starts << 12 | words), pa.array(digests)], names)


def _spans(docs: DataFrame, id_col: str, text_col: str, run_words: int) -> DataFrame:
    """One row per repeated span: id, hash (of the text), first_id, low, high, words."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("hash"), F.col(text_col).alias("text"))
    chunks = rows.mapInArrow(_chunks, f"id {kind}, hash long, at long, digest long")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "at")
    owners = chunks.groupBy("digest").agg(F.min(place).alias("own"), F.max(place).alias("last"), F.count("*").alias("n"))
    owners = stage(owners.where(~F.col("own").eqNullSafe(F.col("last"))).drop("last"), "owners")
    repeats = (
        spread_join(chunks, owners, "digest", ["id", "hash"])
        .where(~(F.col("own.id").eqNullSafe(F.col("id")) & (F.col("own.hash") == F.col("hash")) & (F.col("own.at") == F.col("at"))))
        .select("id", "hash", "at", F.col("own.none").alias("none"), F.col("own.id").alias("first_id"))
        .distinct()
    )
    low, size, words = F.shiftright("at", 24), F.shiftright("at", 12).bitwiseAND(F.lit(4095)), F.col("at").bitwiseAND(F.lit(4095))
    repeats = repeats.select("id", "hash", "none", "first_id", low.cast("int").alias("low"), (low + size).cast("int").alias("high"), words.alias("words"))
    by_place = Window.partitionBy("id", "hash").orderBy("low")
    breaks = F.when(F.lag("high").over(by_place) == F.col("low"), 0).otherwise(1)
    runs = repeats.withColumn("break", breaks).withColumn("run", F.sum("break").over(by_place))
    return (
        runs.groupBy("id", "hash", "run")
        .agg(F.min(F.struct("none", "first_id")).alias("first"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("words").cast("int").alias("words"))
        .where(F.col("words") >= run_words)
        .select("id", "hash", F.col("first.first_id").alias("first_id"), "low", "high", "words")
    )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """One row per repeated span: id, first_id (the smallest id that owns a chunk of it), low, high, words.

    low and high are byte offsets into the UTF-8 text. Rows come in the order of ids, nulls last, then of a hash of
    their texts; rows alike in id and text are one document, so the copy of a whole row is no repeat. Documents
    without repeats have no row. Null and empty texts have no chunks. Very long texts are read whole. Other columns
    are not read; an empty table gives an empty table.
    """
    return _spans(docs, id_col, text_col, run_words).select(F.col("id").alias(id_col), F.col("first_id").alias(f"first_{id_col}"), "low", "high", "words")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """docs with the repeated spans cut from the texts; all other columns are kept as they are.

    Spans are cut from the rows of their id and text, so rows that share an id, or have none, keep what is theirs.
    """
    spans = stage(_spans(docs, id_col, text_col, run_words), "spans")
    cut = spans.groupBy(F.col("id").alias("cut_id"), F.col("hash").alias("cut_hash")).agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))
    rows = packed(docs, id=F.col(id_col), hash=F.coalesce(F.xxhash64(text_col), F.lit(0)))
    rows = rows.join(cut, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("hash") == F.col("cut_hash")), "left")
    text = held(docs, text_col)
    rows = rows.withColumn("bytes", text.cast("binary"))
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda i: F.struct(F.coalesce(F.get("spans", i - 1)["high"], F.lit(0)).alias("low"), F.coalesce(F.get("spans", i)["low"], F.length("bytes")).alias("high")),
    )
    kept = F.array_join(F.transform(gaps, lambda g: F.call_function("substring", F.col("bytes"), g["low"] + 1, g["high"] - g["low"]).cast("string")), "")
    whole = F.when(F.col("spans").isNull(), text).otherwise(kept)
    return unpacked(rows, docs, **{text_col: whole})
