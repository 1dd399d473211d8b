"""Retrieval evaluations by method, for items of one source and of several.

Items of one source are rows (query_id, scope, text, gold[, embedding]); items of several hold an array of sources
(scope, document, gold) and are asked in the scope of each. Chunks are (chunk_id, scope, content[, embedding]), as
they are after ingest. All items and scopes are ranked in one plan per method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopewise.operators import fusion, metrics, retrieval

#: (queries, chunks, k) -> (query_id, chunk_id, score, rank).
METHODS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {
    "bm25": retrieval.bm25,
    "tfidf": retrieval.tfidf,
    "dense": retrieval.dense,
    "hybrid": fusion.hybrid,
    "rrf": fusion.rrf,
}
DEPTH = 10


def judged(method: str, items: DataFrame, chunks: DataFrame, k: int = DEPTH, rankings: fusion.Rankings | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, relevant) of the k best chunks of each item; rankings: of the same items, by what several methods share."""
    found = (rankings.by(method, k) if rankings else METHODS[method](items, chunks, k)).select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "content"), "chunk_id")
    return metrics.relevance(found, items.select("query_id", "gold"), ["query_id"]).select("query_id", "chunk_id", "rank", "relevant")


def single(items: DataFrame, chunks: DataFrame, methods: Iterable[str] = METHODS, k: int = DEPTH) -> DataFrame:
    """(method, num_items, mean metrics): items for which nothing was retrieved don't count."""
    out, rankings = None, fusion.Rankings(items, retrieval.tokenized(chunks))
    for method in methods:
        rows = metrics.summary(metrics.item_metrics(judged(method, items, chunks, k, rankings), ["query_id"])).select(F.lit(method).alias("method"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def by_source(items: DataFrame) -> DataFrame:
    """items(item, kind, question, sources[, embedding]) -> one row per source: query_id (text of item and place), item, kind, text, scope, document, gold[, embedding]."""
    rows = items.select("*", F.posexplode("sources").alias("place", "s"))
    held = ["embedding"] if "embedding" in items.columns else []
    return rows.select(F.concat_ws("/", F.col("item").cast("string"), F.col("place").cast("string")).alias("query_id"), "item", "kind", F.col("question").alias("text"), "s.*", *held)


def multi(items: DataFrame, chunks: DataFrame, method: str, k: int = DEPTH, documents: str = "chunk_id", rankings: fusion.Rankings | None = None) -> DataFrame:
    """Per item: its kind, values over its sources, and the share of chunks of documents it doesn't ask for among the first 3 and k."""
    asked = by_source(items)
    found = judged(method, asked, chunks, k, rankings).join(asked.select("query_id", "item"), "query_id")
    out = items.select("item", "kind").join(metrics.multi_source(metrics.item_metrics(found, ["query_id", "item"])), "item", "left")
    placed = found.join(chunks.select("chunk_id", F.col(documents).alias("document"), "scope"), "chunk_id").select("item", "scope", "document", "rank")
    for depth in (3, k):
        out = out.join(metrics.wrong_scope_rate(placed, asked.select("item", "scope", "document"), depth), "item", "left")
    return out


def multi_summary(items: DataFrame, chunks: DataFrame, methods: Iterable[str] = METHODS, k: int = DEPTH) -> DataFrame:
    """Means over items per method, by kind and over all (kind is null); values that an item lacks are left out."""
    out, rankings = None, fusion.Rankings(by_source(items), retrieval.tokenized(chunks))
    for method in methods:
        rows = multi(items, chunks, method, k, rankings=rankings)
        values = [c for c in rows.columns if c not in ("item", "kind", "num_sources")]
        means = rows.rollup("kind").agg(F.count("*").alias("num_items"), *[F.avg(F.col(c).cast("double")).alias(c) for c in values])
        means = means.select(F.lit(method).alias("method"), "*")
        out = means if out is None else out.unionByName(means)
    return out
