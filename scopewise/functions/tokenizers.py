"""Byte-fallback BPE and Unigram tokenizers over vocabulary files, as Arrow functions.

Vocabularies are given by path, read once per task and never trained.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mark that stands for a blank in pieces, and the score of an unknown character.
BLANK, UNKNOWN_SCORE = "▁", -10000.0


def padded(ids: list[int], length: int, pad: int) -> tuple[list[int], list[int]]:
    """(ids, attention mask), cut or padded on the right."""
    ids = ids[:length]
    return ids + [pad] * (length - len(ids)), [1] * len(ids) + [0] * (length - len(ids))


class Bpe:
    """Greedy merging of the pair of lowest rank; characters outside the vocabulary fall back to bytes."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], start: int | None = None, unknown: int = 0, joined: bool = False):
        """joined: merges are told apart by their joined text only, the later one of a text counts."""
        self.vocabulary, self.start, self.unknown = vocabulary, start, unknown
        self.key = "".join if joined else tuple
        self.ranks = {self.key(pair): rank for rank, pair in enumerate(merges)}

    @classmethod
    def load(cls, path: str, start: int | None = None) -> Bpe:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], start)

    def pieces(self, text: str) -> list[str]:
        parts: list[str] = []
        for c in text.replace(" ", BLANK):
            parts += [c] if c in self.vocabulary else [f"<0x{b:02X}>" for b in c.encode()]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(self.key(pair), 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def encode(self, text: str | None) -> list[int]:
        head = [] if self.start is None else [self.start]
        return head + [self.vocabulary.get(p, self.unknown) for p in self.pieces(text or "")]


class Unigram:
    """The segmentation of highest total score (Viterbi) after NFKC and a leading blank."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0, start: int | None = None, end: int | None = None):
        self.scores = {piece: (score, i) for i, (piece, score) in enumerate(pieces)}
        self.longest = max(map(len, self.scores), default=1)
        self.unknown, self.start, self.end = unknown, start, end

    @classmethod
    def load(cls, path: str, start: int | None = None, end: int | None = None) -> Unigram:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls([tuple(p) for p in model["vocab"]], model.get("unk_id") or 0, start, end)

    def encode(self, text: str | None) -> list[int]:
        line = BLANK + BLANK.join(unicodedata.normalize("NFKC", text or "").split())
        ids: list[int] = []
        if len(line) > 1:
            best: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(float("-inf"), 0, 0)] * len(line)
            for i in range(len(line)):
                for j in range(i + 1, min(len(line), i + self.longest) + 1):
                    score, piece = self.scores.get(line[i:j], (UNKNOWN_SCORE if j == i + 1 else None, self.unknown))
                    if score is not None and best[i][0] + score > best[j][0]:
                        best[j] = best[i][0] + score, i, piece
            at = len(line)
            while at:
                ids.append(best[at][2])
                at = best[at][1]
        return [x for x in (self.start, *reversed(ids), self.end) if x is not None]


def encoder(make: Callable[[], Bpe | Unigram], length: int, pad: int = 0) -> Callable[[Column], Column]:
    """A column function: struct<ids, mask> of fixed length."""

    @F.pandas_udf("struct<ids:array<bigint>,mask:array<bigint>>")
    def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = make()
        for texts in parts:
            yield pd.DataFrame([padded(tokenizer.encode(x), length, pad) for x in texts], columns=["ids", "mask"])

    return encoded
