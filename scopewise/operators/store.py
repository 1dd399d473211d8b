"""Chunk stores: documents are replaced as a whole, searched exactly or by hashing, and de-duplicated on the way in."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopewise.functions.vectors import score_of_cosine_distance, score_of_distance
from scopewise.operators.fusion import best_places

#: Vectors of a block and queries of a part, on average: each vector goes to all parts and each query to all blocks.
BLOCK_ROWS = PART_ROWS = 32_768
#: Vectors that a query is compared with at once, which stay in a cache; the least of a block where cores would be idle.
AT_ONCE = 4096
#: SQL: a vector without nulls.
SOUND = "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)"


def upsert(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The store with all rows of the new rows' documents replaced by the new rows."""
    return store.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def deduplicated(rows: DataFrame, mode: str, patient: str, document: str, order: str) -> DataFrame:
    """Ingest de-duplication: first rows by (patient, document), by document, or none."""
    keys = {"patient": [patient, document], "document": [document], "none": []}[mode]
    if not keys:
        return rows
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.dense_rank().over(w)).where("_n = 1").drop("_n")


def of_dimension(rows: DataFrame, dims: int) -> DataFrame:
    """Rows whose vector has the store's dimension."""
    return rows.where(F.size("embedding") == dims)


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, chunk_id, distance, score, rank): exact nearest neighbours by cosine or l2 distance, ties to the smaller id.

    A stated query set against all rows: vectors are dealt in blocks and queries in parts, each block meets each part in
    one task, and only a block's k best of a query leave it. Vectors that are null, hold a null or are of another length
    than the query's take no part; the cosine with a zero vector is 0. Ids must be numbers or strings.
    """

    def distances(point: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        # products in single precision, summed in double
        if metric == "l2":
            return np.sqrt(((matrix - point) ** 2).sum(axis=1, dtype=np.float64))
        size = np.sqrt((matrix * matrix).sum(axis=1, dtype=np.float64)) * np.sqrt((point * point).sum(dtype=np.float64))
        return 1 - np.divide((matrix * point).sum(axis=1, dtype=np.float64), size, out=np.zeros(len(matrix)), where=size > 0)

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": asked.query_id[:0], "chunk_id": held.chunk_id[:0], "distance": np.zeros(0)})]
        if len(asked) and len(held):
            matrix, ids = np.stack(held.v_vector.to_numpy()), held.chunk_id.to_numpy()
            for query, point in zip(asked.query_id, asked.q_vector, strict=True):
                far = np.concatenate([distances(point, matrix[at : at + AT_ONCE]) for at in range(0, len(ids), AT_ONCE)])
                at = best_places(-far, ids, k)
                out.append(pd.DataFrame({"query_id": query, "chunk_id": ids[at], "distance": far[at]}))
        return pd.concat(out)

    rows = _dealt(queries.where(SOUND), vectors.where(SOUND), "array<float>", nearest)
    score = score_of_cosine_distance(F.col("distance")) if metric == "cosine" else score_of_distance(F.col("distance"))
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", score)


def lsh_knn(queries: DataFrame, vectors: DataFrame, k: int, threshold: float = 2.0, bucket: float = 1.0, tables: int = 8) -> DataFrame:
    """(query_id, chunk_id, distance, rank): nearest neighbours by random projection hashing; approximate.

    Rows that share a bucket of some table are near if their distance is under the threshold. They meet in blocks, of which
    only the k best of a query leave: Spark's own join of the buckets shuffles every pair that meets, with both vectors.
    """
    hashed = lambda df, key: df.where(SOUND).select(key, "embedding", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("vector"))
    index = hashed(vectors, "chunk_id")
    model = BucketedRandomProjectionLSH(inputCol="vector", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=7).fit(index)
    # a table's hash is a vector of one number
    side = lambda df, key: model.transform(df).select(key, "embedding", F.flatten(F.from_json(F.col("hashes").cast("string"), "array<array<double>>")).alias("buckets"))

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": asked.query_id[:0], "chunk_id": held.chunk_id[:0], "distance": np.zeros(0)})]
        if len(asked) and len(held):
            matrix, ids, buckets = np.stack(held.v_vector.to_numpy()), held.chunk_id.to_numpy(), np.stack(held.v_buckets.to_numpy())
            for query, point, own in zip(asked.query_id, asked.q_vector, asked.q_buckets, strict=True):
                met = np.flatnonzero((buckets == own).any(axis=1))
                far = np.concatenate([np.zeros(0), *[np.sqrt(((matrix[met[at : at + AT_ONCE]] - point) ** 2).sum(axis=1)) for at in range(0, len(met), AT_ONCE)]])
                met, far = met[far < threshold], far[far < threshold]
                at = np.lexsort((ids[met], far))[:k]
                out.append(pd.DataFrame({"query_id": query, "chunk_id": ids[met[at]], "distance": far[at]}))
        return pd.concat(out)

    rows = _dealt(side(hashed(queries, "query_id"), "query_id"), side(index, "chunk_id"), "array<double>", nearest, "buckets")
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _dealt(queries: DataFrame, vectors: DataFrame, kind: str, nearest: Callable, *beside: str) -> DataFrame:
    """(query_id, chunk_id, distance) of nearest(asked, held) over each part of the queries and each block of the vectors of their length."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n, asked = vectors.count(), queries.count()
    # no more copies of a row than memory asks for, but work for every core
    parts = max(1, math.ceil(asked / PART_ROWS))
    blocks = max(1, math.ceil(n / BLOCK_ROWS), min(math.ceil(cores / parts), math.ceil(n / AT_ONCE)))
    vector, every = F.col("embedding").cast(kind), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    q = queries.select("query_id", vector.alias("q_vector"), *[F.col(c).alias(f"q_{c}") for c in beside], F.size("embedding").alias("q_dim"), own("query_id", parts).alias("q_part"), every(blocks).alias("q_block"))
    v = vectors.select("chunk_id", vector.alias("v_vector"), *[F.col(c).alias(f"v_{c}") for c in beside], F.size("embedding").alias("v_dim"), own("chunk_id", blocks).alias("v_block"), every(parts).alias("v_part"))
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", queries), ("chunk_id", vectors))}
    near = q.groupBy("q_dim", "q_block", "q_part").cogroup(v.groupBy("v_dim", "v_block", "v_part"))
    return near.applyInPandas(nearest, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, distance double")
