"""Byte-level BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash cuts texts into chunks that do not depend on where they stand, so passages that documents share
give the same chunks. A chunk is encoded once for all documents of a task (the cache is bounded) and its ids are
joined with its neighbours'. Encoding a text by parts is only exact if no pre-token spans a join, so joins are
repaired: the text between the last point in the left chunk and the first in the right one where every encoding
agrees is encoded again. White space that follows other characters is such a point, whatever stands around it: a
pre-token has white space at its start only, and a run of white space can't begin before it. A chunk without such
a point is encoded again with its neighbours, as far as the nearest ones that have one.

The vocabulary is a public one, given by its path. Encoding uses tiktoken, which has the same merges as the
tokenizers library's file; tests hold the ids against that library.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, LongType, StringType, StructField, StructType

from scopewise.llm.gear import cuts

BITS = 9
LEAST = 128
MOST = 16384
#: Cached ids, in tokens, after which a task's cache starts anew.
CACHED_TOKENS = 1_000_000
#: Fixed value: the special token's string, which the tokenizer knows in any text.
END_OF_TEXT = "<|endoftext|>"
#: Fixed value: Unicode's white space, which the tokenizer's pattern means by \\s (Python's takes four more controls).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space after another character.
SAFE = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary in rank form."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load(path: str):
    """The encoding of a rank file: lines of a token in base64 and its rank. The special token's id follows.

    A task loads it once. (A function that caches would be sent to workers by name, and need this package there.)
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


class ChunkEncoder:
    """Encodes texts through a cache of chunks; ids equal those of the whole text."""

    def __init__(self, encoding, bits: int = BITS, least: int = LEAST, most: int = MOST):
        self.encoding, self.size = encoding, (bits, least, most)
        self.cache: dict[str, np.ndarray] = {}
        self.chunks: dict[bytes, tuple] = {}
        self.cached = 0

    def _ids(self, text: str) -> np.ndarray:
        ids = self.cache.get(text)
        if ids is None:
            ids = self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4")
            if self.cached > CACHED_TOKENS:
                self.cache.clear()
                self.chunks.clear()
                self.cached = 0
            self.cache[text] = ids
            self.cached += len(ids) + 16
        return ids

    def _parts(self, chunk: bytes) -> tuple:
        """(head, ids of the core, tail): the core runs between the first and the last safe point; None if there is none."""
        parts = self.chunks.get(chunk)
        if parts is None:
            text = chunk.decode("utf-8", "surrogatepass")
            points = [m.start() for m in SAFE.finditer(text)]
            if points:
                parts = text[: points[0]], self._ids(text[points[0] : points[-1]]), text[points[-1] :]
            else:
                parts = text, None, ""
            self.chunks[chunk] = parts
            self.cached += len(chunk) // 4
        return parts

    def encode(self, text: str) -> np.ndarray:
        data = text.encode("utf-8", "surrogatepass")
        out, seam, low = [], "", 0
        for high in cuts(np.frombuffer(data, np.uint8), *self.size).tolist():
            head, core, tail = self._parts(data[low:high])
            seam += head
            if core is not None:
                out += self._repaired(seam), core
                seam = tail
            low = high
        out.append(self._repaired(seam))
        return np.concatenate(out)

    def _repaired(self, seam: str) -> np.ndarray:
        return self._ids(seam) if len(seam) < 4096 else self.encoding.encode_to_numpy(seam, allowed_special="all").astype("<u4")

    def drop(self) -> None:
        """Forget what is cached: a worker lives on after its task."""
        self.cache, self.chunks, self.cached = {}, {}, 0

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8", "replace")


def _with(rows: DataFrame, column: str, path: str, made: dict[str, DataType], values, keep: bool = True) -> DataFrame:
    """rows with more columns: values(coder, value of the column) gives a tuple for each row.

    Made columns replace those of their names; the column itself is only given back if it is to be kept.
    """
    kept = [k for k, f in enumerate(rows.schema) if f.name not in made and (keep or f.name != column)]
    names = [f"c{k}" for k in range(len(rows.columns))]  # columns go by number
    sent = [*(names[k] for k in kept if k != rows.columns.index(column)), names[rows.columns.index(column)]]
    given = [names[k] for k in kept]
    kinds = [{"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[t.simpleString()] for t in made.values()]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkEncoder(load(path))
        for batch in batches:
            found = [values(coder, x.as_py()) for x in batch.column(len(sent) - 1)]
            new = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(sent.index(n)) for n in given), *new], [*given, *made])
        coder.drop()

    schema = StructType([*(StructField(names[k], rows.schema[k].dataType) for k in kept), *(StructField(n, t) for n, t in made.items())])
    out = rows.toDF(*names).select(*sent).mapInArrow(mapped, schema)
    return out.toDF(*(rows.columns[k] for k in kept), *made)


def encode_column(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs with _ids (little-endian unsigned 32-bit, binary) and _n, their number; null counts as empty.

    Columns of docs that have these names are replaced. Repeated rows give repeated rows, an empty table an empty one.
    """

    def coded(coder: ChunkEncoder, text: str | None) -> tuple:
        ids = coder.encode(text or "")
        return ids.tobytes(), len(ids)

    return _with(docs, text_col, vocabulary or default_vocabulary(), {"_ids": BinaryType(), "_n": LongType()}, coded)


def decode_column(rows: DataFrame, ids_col: str = "_ids", vocabulary: str | None = None) -> DataFrame:
    """rows with _decoded, the text of each row's ids; null for null. A column of rows that has this name is replaced."""

    def decoded(coder: ChunkEncoder, ids: bytes | None) -> tuple:
        return (None if ids is None else coder.decode(np.frombuffer(ids, "<u4")),)

    return _with(rows, ids_col, vocabulary or default_vocabulary(), {"_decoded": StringType()}, decoded)


def code_column(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs without the text, with token_ids (as _ids above), n_tokens, and decoded_sha256 of what the ids decode to, in one pass.

    Null counts as empty. Columns of docs that have these names are replaced.
    """

    def coded(coder: ChunkEncoder, text: str | None) -> tuple:
        ids = coder.encode(text or "")
        return ids.tobytes(), len(ids), hashlib.sha256(coder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()

    return _with(docs, text_col, vocabulary or default_vocabulary(), {"token_ids": BinaryType(), "n_tokens": LongType(), "decoded_sha256": StringType()}, coded, keep=False)


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256 and decoded_sha256.

    Null counts as empty: no tokens, and the digests of nothing. Repeated rows give repeated rows; other columns
    are not read; an empty table gives an empty table.
    """

    def digests(coder: ChunkEncoder, text: str | None) -> tuple:
        ids = coder.encode(text or "")
        decoded = coder.decode(ids).encode("utf-8", "surrogatepass")
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    made = {"n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType()}
    return _with(docs.select(id_col, text_col), text_col, vocabulary or default_vocabulary(), made, digests, keep=False)
