"""Embedding backends as column functions.

A backend turns a list of texts into vectors; what it puts before questions and passages, and how it shortens a
text that is too long for it, are its parameters. The hash backend needs no model and stands in where one can't be
loaded; it carries no meaning, so retrieval with it is skipped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes of known backends (question, passage).
PREFIXES = {
    "embedding_gemma": ("task: search result | query: ", "title: none | text: "),
    "e5_small": ("query: ", "passage: "),
    "granite": ("", ""),
}
HASH = "hash"
SHRINK, ATTEMPTS = 0.5, 8
#: Texts that a model gets in one call.
AT_ONCE = 32
UNAVAILABLE = "_Clinical retrieval unavailable: active embedding backend is '{}' (semantic embedding model failed to load)._\n\n"


class TooLong(ValueError):
    """Raised by a backend for a text beyond its window."""


@dataclass(frozen=True)
class Embedder:
    backend: str
    dimension: int
    embed: Callable[[list[str]], list[list[float]]]

    def vectors(self, texts: list[str | None], question: bool) -> list[list[float] | None]:
        """A vector per text, null for null; a text that is too long is halved until it fits, eight times at most."""
        before = PREFIXES.get(self.backend, ("", ""))[0 if question else 1]
        held = [t for t in texts if t is not None]
        found = iter([v for low in range(0, len(held), AT_ONCE) for v in self._several(before, held[low : low + AT_ONCE])])
        return [None if t is None else next(found) for t in texts]

    def _several(self, before: str, texts: list[str]) -> list[list[float] | None]:
        """One call of the model for all; one for each where any is too long."""
        if len(texts) > 1:
            try:
                return self.embed([before + t for t in texts])
            except TooLong:
                pass
        return [self._one(before, t) for t in texts]

    def _one(self, before: str, text: str) -> list[float] | None:
        for _ in range(ATTEMPTS):
            try:
                return self.embed([before + text])[0]
            except TooLong:
                text = text[: int(len(text) * SHRINK)]
        return None

    def column(self, text: Column, question: bool = False) -> Column:
        own = self

        @F.pandas_udf("array<float>")
        def embedded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                yield pd.Series(own.vectors([x if isinstance(x, str) else None for x in texts], question), dtype=object)

        return embedded(text)


def hash_vectors(texts: list[str], dimension: int = 384) -> list[list[float]]:
    """Signed counts of hashed words, of length one; zero for texts without a word of three characters."""
    out = []
    for text in texts:
        vector = [0.0] * dimension
        for word in re.split(r"[^a-zA-Z0-9_]+", text.lower().strip()):
            if len(word) > 2:
                h = 0
                for c in word:
                    h = (h * 31 + ord(c)) & 0xFFFFFFFF
                h -= (h >> 31) << 32
                vector[abs(h) % dimension] += 1.0 if h >= 0 else -1.0
        size = math.sqrt(sum(x * x for x in vector))
        out.append([x / size for x in vector] if size else vector)
    return out


def hash_embedder(dimension: int = 384) -> Embedder:
    return Embedder(HASH, dimension, lambda texts: hash_vectors(texts, dimension))


def load(backends: dict[str, Callable[[], Embedder]], wanted: str) -> Embedder:
    """The backend wanted, or the hash backend where it can't be loaded."""
    try:
        return backends[wanted]()
    except Exception:  # whatever a model loader raises
        return hash_embedder()


def retrievable(queries: DataFrame, embedder: Embedder) -> tuple[DataFrame, str | None]:
    """The queries that dense retrieval takes, and the notice that stands for the others: none with the hash backend."""
    if embedder.backend == HASH:
        return queries.limit(0), UNAVAILABLE.format(embedder.backend)
    return queries, None
