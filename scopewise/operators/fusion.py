"""Fusion of lexical and dense scores of all candidates without a row for each pair.

A scope's chunks are dealt in blocks and its questions in parts; each block meets each part in one task, which holds the
chunks' vectors and their weights of asked terms, makes both scores of a question for the whole block, and sends on only
what can decide:

* weighted sum: the block's k best;
* sum of normalised scores: first the block's extremes, then, with those of the scope, its k best;
* ranks: first the block's best by either ranking, then, for the few candidates among those, how many of the block's
  chunks come before them. What is in neither ranking's first RRF + 2k can't be among the k best: its two parts are
  at most 2 / (61 + RRF + 2k), less than 1 / (RRF + k), which the k-th of either ranking has.

Ids of chunks must be numbers or strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopewise.operators import retrieval
from scopewise.operators.retrieval import BLOCK_ROWS, RRF, bm25_weights, tfidf_sides, top
from scopewise.sources.staging import staged

#: Questions of a part, on average.
PART_ROWS = 2048


class Sides:
    """Questions and chunks dealt in parts and blocks, made once and scored as often as a fusion needs."""

    def __init__(self, queries: DataFrame, chunks: DataFrame, query_terms: DataFrame, chunk_terms: DataFrame):
        """query_terms(query_id, terms), chunk_terms(chunk_id, terms), lists of (term, w): a pair's lexical score is the sum of products."""
        listed = lambda rows, key: rows.select(key, F.col("terms.term").alias("terms"), F.col("terms.w").alias("ws"))
        sizes = chunks.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
        sizes = sizes.join(queries.groupBy("scope").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")), "scope")
        vector = F.col("embedding").cast("array<float>").alias("vector")
        held = chunks.select("chunk_id", "scope", vector).join(sizes, "scope").join(listed(chunk_terms, "chunk_id"), "chunk_id", "left")
        asked = queries.select("query_id", "scope", vector).join(sizes, "scope").join(listed(query_terms, "query_id"), "query_id", "left")
        self.held = staged(held.select("scope", "parts", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int").alias("block"), "chunk_id", "vector", "terms", "ws"), "chunk-side")
        self.asked = staged(asked.select("scope", "blocks", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), "query_id", "vector", "terms", "ws"), "question-side")
        self.kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", queries), ("chunk_id", chunks))}

    def reduced(self, reduce, columns: str, asked: DataFrame | None = None) -> DataFrame:
        """What reduce(question, ids, lexical, dense) gives for each question and block; asked may have more columns."""
        asked = self.asked if asked is None else asked
        extra = [F.col(c).alias(f"q_{c}") for c in asked.columns if c not in ("blocks", "scope", "part")]
        q = asked.select(F.col("scope").alias("q_scope"), F.col("part").alias("q_part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q_block"), *extra)
        h = self.held.select(*[F.col(c).alias(f"c_{c}") for c in self.held.columns if c != "parts"], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("c_part"))

        def scored(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            ids = held.c_chunk_id.to_numpy()
            out = [reduce(*x) for x in _scores(asked, held)] if len(held) else []
            out = [x for x in out if len(x)]
            return pd.concat(out) if out else pd.DataFrame({c.split()[0]: (ids if c.startswith("chunk_id") else asked.q_query_id)[:0] if c.split()[0] in ("chunk_id", "query_id") else np.zeros(0) for c in columns.split(", ")})

        schema = ", ".join(f"{c} {self.kinds[c]}" if c in self.kinds else c for c in columns.split(", "))
        return q.groupBy("q_scope", "q_block", "q_part").cogroup(h.groupBy("c_scope", "c_block", "c_part")).applyInPandas(scored, schema)


def _scores(asked: pd.DataFrame, held: pd.DataFrame) -> Iterator[tuple]:
    """(question, ids, lexical, dense) of each question with all chunks of a block; 0 where a vector or a term is missing."""
    ids = held.c_chunk_id.to_numpy()
    dims = max((len(v) for v in held.c_vector if v is not None), default=0)
    usable = np.array([v is not None and len(v) == dims for v in held.c_vector], bool)
    matrix = np.zeros((len(held), dims), np.float32)
    if usable.any():
        matrix[usable] = np.stack(held.c_vector[usable].to_numpy())
    lengths = np.sqrt((matrix * matrix).sum(axis=1, dtype=np.float64))
    postings: dict[str, tuple[list[int], list[float]]] = {}
    for place, (terms, ws) in enumerate(zip(held.c_terms, held.c_ws, strict=True)):
        for term, w in zip(terms, ws, strict=True) if terms is not None else ():
            places, weights = postings.setdefault(term, ([], []))
            places.append(place)
            weights.append(w)
    postings = {t: (np.array(p), np.array(w)) for t, (p, w) in postings.items()}
    for question in asked.itertuples():
        lexical, dense, vector = np.zeros(len(held)), np.zeros(len(held)), question.q_vector
        for term, w in zip(question.q_terms, question.q_ws, strict=True) if question.q_terms is not None else ():
            if term in postings:
                places, weights = postings[term]
                lexical[places] += w * weights
        size = lengths * np.sqrt((vector * vector).sum(dtype=np.float64)) if vector is not None and len(vector) == dims else np.zeros(len(held))
        if (size > 0).any():  # products in single precision, summed in double
            np.divide((matrix * vector).sum(axis=1, dtype=np.float64), size, out=dense, where=size > 0)
        yield question, ids, lexical, dense


def best_places(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, of ties the smallest ids, and of what comes so near to the last of them that rounding may decide."""
    if len(score) <= k:
        return np.arange(len(score))
    last = np.partition(score, -k)[-k]
    near = np.flatnonzero((score >= last - 1e-5 * max(1.0, abs(last))) & (score != last))
    ties = np.flatnonzero(score == last)
    return np.concatenate([near, ties[np.argsort(ids[ties], kind="stable")[:k]]])


def _lexical(queries: DataFrame, chunks: DataFrame, method: str) -> Sides:
    listed = lambda rows, key: rows.groupBy(key).agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    if method == "bm25":
        asked, weighed = bm25_weights(queries, chunks)
        return Sides(queries, chunks, listed(asked.withColumn("w", F.lit(1.0)), "query_id"), listed(weighed, "chunk_id"))
    wq, wd = tfidf_sides(queries, chunks)
    return Sides(queries, chunks, listed(wq, "query_id"), wd.select("chunk_id", "terms"))


class Rankings:
    """Rankings of the same questions and chunks by several methods: each lexical side is made once."""

    def __init__(self, queries: DataFrame, chunks: DataFrame):
        self.queries, self.chunks, self._sides = queries, chunks, {}

    def sides(self, method: str) -> Sides:
        if method not in self._sides:
            self._sides[method] = _lexical(self.queries, self.chunks, method)
        return self._sides[method]

    def lexical(self, method: str, k: int) -> DataFrame:
        """The k best by BM25 or TF-IDF (in percent) of all candidates; those that share no term score 0."""
        scale = 1 if method == "bm25" else 100

        def best(question, ids, lexical, dense) -> pd.DataFrame:
            score = scale * lexical
            at = best_places(score, ids, k)
            return pd.DataFrame({"query_id": question.q_query_id, "chunk_id": ids[at], "score": score[at]})

        return top(self.sides(method).reduced(best, "query_id, chunk_id, score double"), k)

    def by(self, method: str, k: int) -> DataFrame:
        """(query_id, chunk_id, score, rank) by bm25, tfidf, dense, hybrid or rrf."""
        if method in ("bm25", "tfidf"):
            return self.lexical(method, k)
        if method == "dense":
            return retrieval.dense(self.queries, self.chunks, k)
        return hybrid(self.queries, self.chunks, k, sides=self.sides("tfidf")) if method == "hybrid" else rrf(self.queries, self.chunks, k, sides=self.sides("bm25"))


def hybrid(queries: DataFrame, chunks: DataFrame, k: int, weight: float = 0.5, sides: Sides | None = None) -> DataFrame:
    """100 x (weight x dense cosine + (1 - weight) x TF-IDF cosine), over all candidates: (query_id, chunk_id, score, rank)."""

    def best(question, ids, lexical, dense) -> pd.DataFrame:
        score = weight * 100 * dense + (1 - weight) * 100 * lexical
        at = best_places(score, ids, k)
        return pd.DataFrame({"query_id": question.q_query_id, "chunk_id": ids[at], "score": score[at]})

    return top((sides or _lexical(queries, chunks, "tfidf")).reduced(best, "query_id, chunk_id, score double"), k)


def fused(queries: DataFrame, chunks: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """alpha x dense + (1 - alpha) x BM25, each brought to 0..1 within the question's candidates, 0 where all are alike."""
    sides = _lexical(queries, chunks, "bm25")

    def extremes(question, ids, lexical, dense) -> pd.DataFrame:
        return pd.DataFrame({"query_id": [question.q_query_id], "b0": lexical.min(), "b1": lexical.max(), "d0": dense.min(), "d1": dense.max()})

    def best(question, ids, lexical, dense) -> pd.DataFrame:
        scaled = lambda x, low, high: (x - low) / (high - low) if high > low else np.zeros(len(x))
        score = alpha * scaled(dense, question.q_d0, question.q_d1) + (1 - alpha) * scaled(lexical, question.q_b0, question.q_b1)
        at = best_places(score, ids, k)
        return pd.DataFrame({"query_id": question.q_query_id, "chunk_id": ids[at], "score": score[at]})

    found = sides.reduced(extremes, "query_id, b0 double, b1 double, d0 double, d1 double")
    found = found.groupBy("query_id").agg(F.min("b0").alias("b0"), F.max("b1").alias("b1"), F.min("d0").alias("d0"), F.max("d1").alias("d1"))
    return top(sides.reduced(best, "query_id, chunk_id, score double", sides.asked.join(found, "query_id")), k)


def rrf(queries: DataFrame, chunks: DataFrame, k: int, sides: Sides | None = None) -> DataFrame:
    """Reciprocal rank fusion over the BM25 and the dense ranking of all candidates, x 100: (query_id, chunk_id, score, rank)."""
    sides, depth = sides or _lexical(queries, chunks, "bm25"), RRF + 2 * k

    def first(question, ids, lexical, dense) -> pd.DataFrame:
        at = np.unique(np.concatenate([best_places(np.round(lexical, 12), ids, depth), best_places(np.round(dense, 12), ids, depth)]))
        return pd.DataFrame({"query_id": question.q_query_id, "chunk_id": ids[at], "bm25": lexical[at], "dense": dense[at]})

    def before(question, ids, lexical, dense) -> pd.DataFrame:
        out = {"query_id": question.q_query_id, "chunk_id": question.q_ids}
        for name, all_, mine in (("b", lexical, question.q_bm25), ("d", dense, question.q_dense)):
            all_, mine = np.round(all_, 12), np.round(np.asarray(mine, float), 12)
            out[name] = [int((all_ > x).sum()) + int((ids[all_ == x] < i).sum()) for x, i in zip(mine, question.q_ids, strict=True)]
        return pd.DataFrame(out)

    place = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(c, 12).desc(), "chunk_id"))
    found = sides.reduced(first, "query_id, chunk_id, bm25 double, dense double")
    found = staged(found.withColumns({"_b": place("bm25"), "_d": place("dense")}).where((F.col("_b") <= depth) | (F.col("_d") <= depth)), "candidates")
    # 2 x depth candidates a question
    listed = found.groupBy("query_id").agg(F.collect_list(F.struct("chunk_id", "bm25", "dense")).alias("_c"))
    listed = listed.select("query_id", F.col("_c.chunk_id").alias("ids"), F.col("_c.bm25").alias("bm25"), F.col("_c.dense").alias("dense"))
    counts = sides.reduced(before, "query_id, chunk_id, b long, d long", sides.asked.join(listed, "query_id"))
    ranks = counts.groupBy("query_id", "chunk_id").agg((F.sum("b") + 1).alias("b"), (F.sum("d") + 1).alias("d"))
    return top(ranks.select("query_id", "chunk_id", (F.lit(100.0) * (1 / (RRF + F.col("b")) + 1 / (RRF + F.col("d")))).alias("score")), k)
