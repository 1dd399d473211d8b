"""Ranked retrieval within scopes, for all queries at once.

Every method takes queries(query_id, scope, text[, embedding]) and chunks(chunk_id, scope, content[, embedding])
and gives rows (query_id, chunk_id, score, rank). Corpus statistics are those of the query's scope. Chunks that
share no term with a query score 0 and are candidates too.

Terms are cut to those some query of the scope asks for before anything is shuffled, and counted before they are
joined; queries join chunks on scope and term, never as a product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopewise.functions.text import distinct_tokens, tokens
from scopewise.sources.staging import staged

#: BM25's saturation and length parameters, and RRF's constant.
K1, B, RRF = 1.2, 0.75, 60
#: Chunks of a scope that a task holds the vectors of, on average.
BLOCK_ROWS = 4096
#: Rows of question terms that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 200_000


def each_term(rows: DataFrame, terms: Column, *keep: str | Column) -> DataFrame:
    """rows with a column term, one for each of the terms.

    An inner explode would have its texts tokenized once more, by the filter on empty lists that Spark infers.
    """
    return rows.select(*keep, F.explode_outer(terms).alias("term")).where("term IS NOT NULL")


def tokenized(chunks: DataFrame) -> DataFrame:
    """chunks with their tokens in the place of their texts, staged: methods that rank the same chunks read each text once."""
    return staged(chunks.withColumn("tokens", tokens(F.col("content"))).drop("content"), "tokens")


def tokens_of(chunks: DataFrame) -> Column:
    return F.col("tokens") if "tokens" in chunks.columns else tokens(F.col("content"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Per scope: n chunks and their mean length in tokens."""
    return chunks.select("scope", F.size(tokens_of(chunks)).alias("dl")).groupBy("scope").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def counted_terms(chunks: DataFrame, *keep: str) -> DataFrame:
    """(keep, scope, chunk_id, dl, most, pos, term, tf): each term of a chunk with its count, chunks without a term once with none.

    A chunk's tokens are put in order and their runs counted where they are: nothing is shuffled. dl is the chunk's length,
    most its largest count, pos numbers its terms from 0. Chunk ids are unique in their scope.
    """
    own = [*keep, "scope", "chunk_id"]
    held = term_runs(chunks, tokens_of(chunks), *own)
    held = held.select(*own, "dl", F.array_max(F.col("runs.tf")).alias("most"), F.posexplode_outer("runs").alias("pos", "_run"))
    return held.select(*own, "dl", "most", "pos", "_run.term", "_run.tf")


def term_runs(rows: DataFrame, terms: Column, *own: str) -> DataFrame:
    """own, dl and runs of each row's tokens: their number, and each (term, tf) in order."""
    held = rows.select(*own, F.sort_array(terms).alias("_t"))
    first = F.filter(F.transform("_t", lambda _, i: i), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))
    held = held.select(*own, "_t", first.alias("_first"))
    runs = F.transform("_first", lambda at, j: F.struct(F.get("_t", at).alias("term"), (F.coalesce(F.get("_first", j + 1), F.size("_t")) - at).cast("long").alias("tf")))
    return held.select(*own, F.size("_t").alias("dl"), runs.alias("runs"))


def term_counts(chunks: DataFrame) -> DataFrame:
    """(scope, chunk_id, term, tf)."""
    return counted_terms(chunks).where("term IS NOT NULL").select("scope", "chunk_id", "term", "tf")


def doc_freq(chunks: DataFrame) -> DataFrame:
    """(scope, term, df): chunks that hold the term."""
    return each_term(chunks, distinct_tokens(F.col("content")), "scope").groupBy("scope", "term").agg(F.count("*").alias("df"))


def checked(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows, marked for broadcast if they are few enough; they are counted first, up to the bound."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def as_ranked(score: Column) -> Column:
    """Scores rank in single precision; rounding first hides the order in which sums were added."""
    return F.round(score, 9).cast("float")


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each query, ties to the smaller chunk id."""
    order = Window.partitionBy("query_id").orderBy(as_ranked(F.col(score)).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidates(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    return queries.select("query_id", "scope").join(chunks.select("scope", "chunk_id"), "scope")


def filled(scored: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k best of each query where only chunks of positive score are given.

    Others score 0 and come by id; the first 2k ids of a scope always suffice, so no query meets all chunks.
    """
    first = chunks.select("scope", "chunk_id").withColumn("_n", F.row_number().over(Window.partitionBy("scope").orderBy("chunk_id"))).where(F.col("_n") <= 2 * k)
    zeros = queries.select("query_id", "scope").join(first, "scope").select("query_id", "chunk_id", F.lit(0.0).alias("score"))
    return top(scored.unionByName(zeros).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)


def bm25_weights(queries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Question terms (query_id, scope, term), and what each adds to the score of a chunk that holds it (scope, term, chunk_id, w).

    Texts are read once: counts of asked terms, and each chunk's length, are staged. What is joined to them has a row for
    each asked term at most, so it is broadcast where question terms are.
    """
    asked = each_term(queries, distinct_tokens(F.col("text")), "query_id", "scope")
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda rows: rows)
    asked = small(asked)
    wanted = small(asked.select("scope", "term").distinct().withColumn("wanted", F.lit(True)))
    held = counted_terms(chunks).join(wanted, ["scope", "term"], "left").where("wanted OR coalesce(pos, 0) = 0")
    held = staged(held.select("scope", "chunk_id", "dl", "pos", "term", "tf", F.coalesce("wanted", F.lit(False)).alias("wanted")), "counts")
    n = held.where("coalesce(pos, 0) = 0").groupBy("scope").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = held.where("wanted")
    df = tf.groupBy("scope", "term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    rated = small(df.join(n, "scope").select("scope", "term", idf.alias("idf"), "avgdl"))
    weight = F.col("idf") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    return asked, tf.join(rated, ["scope", "term"]).select("scope", "term", "chunk_id", weight.alias("w"))


def bm25_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of all pairs that share a term."""
    asked, weighed = bm25_weights(queries, chunks)
    return weighed.join(asked, ["scope", "term"]).groupBy("query_id", "chunk_id").agg(F.sum("w").alias("score"))


def with_most(counts: DataFrame, by: list[str]) -> DataFrame:
    """A table of term counts with the largest count, unless it has it."""
    return counts if "most" in counts.columns else counts.withColumn("most", F.max("tf").over(Window.partitionBy(*by)))


def tfidf_weights(counts: DataFrame, df: DataFrame, n: DataFrame, by: list[str]) -> DataFrame:
    """Weights tf / max tf x (ln(n / (1 + df)) + 1) of a table of term counts; unseen terms have df 0."""
    idf = F.log(F.col("n") / (F.coalesce("df", F.lit(0)) + 1)) + 1
    return with_most(counts, by).join(df, ["scope", "term"], "left").join(n, "scope").select(*by, "scope", "term", (F.col("tf") / F.col("most") * idf).alias("w"))


def tfidf_sides(queries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, scope, term, w), and (chunk_id, scope, terms) with a chunk's list of (term, w) of the terms that its scope is asked for.

    Weights are over the lengths of all terms: a pair's cosine is the sum of products. Chunks whose terms nobody asks
    for have an empty list.
    """
    # tokens are shuffled once, by chunk: counting them and the largest count then need no other shuffle. Counts are staged for
    # what reads them. Adaptive execution would put partitions together by their bytes, which are few beside a task's table of counts
    partitions = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = chunks.select("scope", "chunk_id", tokens_of(chunks).alias("_t")).repartition(partitions, "chunk_id")
    counts = each_term(held, F.col("_t"), "scope", "chunk_id").groupBy("scope", "chunk_id", "term").agg(F.count("*").alias("tf"))
    counts = staged(with_most(counts, ["chunk_id"]), "counts")
    n, df = chunks.groupBy("scope").agg(F.count("*").alias("n")), staged(counts.groupBy("scope", "term").agg(F.count("*").alias("df")), "df")
    asked = each_term(queries, tokens(F.col("text")), "query_id", "scope").groupBy("query_id", "scope", "term").agg(F.count("*").alias("tf"))
    wanted = checked(asked.select("scope", "term").distinct())
    length = F.sqrt(F.sum(F.col("w") * F.col("w")))
    # all terms make lengths, one number a chunk; only those that are asked for are listed. df is a part of its terms in each
    # partition: a table of it spares putting all counts in order
    lengths = tfidf_weights(counts.repartition(partitions, "scope", "term"), df.hint("shuffle_hash"), n, ["chunk_id"]).groupBy("chunk_id", "scope").agg(length.alias("len"))
    df = df.join(wanted, ["scope", "term"], "left_semi")
    listed = tfidf_weights(counts.join(wanted, ["scope", "term"], "left_semi"), df, n, ["chunk_id"]).groupBy("chunk_id", "scope").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    wd = lengths.join(listed, ["chunk_id", "scope"], "left").withColumn("terms", F.coalesce("terms", F.array().cast(listed.schema["terms"].dataType)))
    wd = wd.select("chunk_id", "scope", F.transform("terms", lambda t: F.struct(t["term"].alias("term"), (t["w"] / F.col("len")).alias("w"))).alias("terms"))
    wq = tfidf_weights(asked, df, n, ["query_id"])
    lq = wq.groupBy("query_id").agg(length.alias("len"))
    return wq.join(lq, "query_id").select("query_id", "scope", "term", (F.col("w") / F.col("len")).alias("w")), wd


def tfidf_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): 100 x cosine of all pairs that share a term."""
    wq, wd = tfidf_sides(queries, chunks)
    wd = wd.select("chunk_id", "scope", F.explode("terms").alias("t")).select("chunk_id", "scope", "t.term", F.col("t.w").alias("wd"))
    return wq.join(wd, ["scope", "term"]).groupBy("query_id", "chunk_id").agg((F.lit(100.0) * F.sum(F.col("w") * F.col("wd"))).alias("score"))


def dense_pairs(queries: DataFrame, chunks: DataFrame, best: int | None = None) -> DataFrame:
    """(query_id, chunk_id, dense): the cosine of every query with every chunk of its scope; 0 where a vector is missing.

    Scopes are dealt out in blocks of chunks, to each of which the scope's queries go, so every vector is sent to
    Python once for each block and no vector is in a pair. With ``best``, only so many of each query leave a block,
    and those that come so near to the last of them that rounding may decide.
    """
    sizes = chunks.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_n"))
    vectors = lambda c: F.col(c).cast("array<float>").alias("vector")
    held = chunks.join(sizes, "scope").select(F.col("scope").alias("c_scope"), F.pmod(F.xxhash64("chunk_id"), F.col("_n")).alias("c_block"), "chunk_id", vectors("embedding"))
    asked = queries.join(sizes, "scope").select(F.col("scope").alias("q_scope"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("q_block"), "query_id", vectors("embedding"))
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", queries), ("chunk_id", chunks))}
    def scored(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        dims = max((len(v) for v in held.vector if v is not None), default=0)
        usable = np.array([v is not None and len(v) == dims for v in held.vector], bool)
        matrix = np.zeros((len(held), dims), np.float32)
        if usable.any():
            matrix[usable] = np.stack(held.vector[usable].to_numpy())
        lengths = np.sqrt((matrix * matrix).sum(axis=1, dtype=np.float64))
        ids = held.chunk_id.to_numpy()
        out = [(asked.query_id.to_numpy()[:0], ids[:0], np.zeros(0))]
        for query, vector in zip(asked.query_id, asked.vector, strict=True):
            size = lengths * np.sqrt((vector * vector).sum(dtype=np.float64)) if vector is not None and len(vector) == dims else np.zeros(len(held))
            cosines = np.zeros(len(held))
            if (size > 0).any():  # products in single precision, summed in double
                np.divide((matrix * vector).sum(axis=1, dtype=np.float64), size, out=cosines, where=size > 0)
            keep = slice(None)
            if best is not None and len(held) > best:
                keep = np.flatnonzero(cosines >= np.partition(cosines, -best)[-best] - 1e-6)
            out.append((np.full(len(ids[keep]), query, asked.query_id.dtype), ids[keep], cosines[keep]))
        return pd.DataFrame(dict(zip(("query_id", "chunk_id", "dense"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, dense double"
    return asked.groupBy("q_scope", "q_block").cogroup(held.groupBy("c_scope", "c_block")).applyInPandas(scored, schema)


def dense_scores(queries: DataFrame, chunks: DataFrame, best: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score): 100 x cosine; chunks without a vector take no part."""
    return dense_pairs(queries, chunks.where("embedding IS NOT NULL"), best).select("query_id", "chunk_id", (F.col("dense") * 100).alias("score"))


def raw_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, bm25, dense): all candidates; a missing vector or term scores 0."""
    return dense_pairs(queries, chunks).join(bm25_scores(queries, chunks).withColumnRenamed("score", "bm25"), ["query_id", "chunk_id"], "left").fillna(0.0, ["bm25"])


def min_max(column: str) -> Column:
    """Brought to 0..1 within the query's candidates; 0 where all are alike."""
    w = Window.partitionBy("query_id")
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(F.lit(0.0))


def relevance_pct(raw: DataFrame) -> DataFrame:
    """raw with relevance: the mean of both normalised scores in percent."""
    return raw.withColumn("relevance", (min_max("bm25") + min_max("dense")) / 2 * 100)


def bm25(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    return filled(bm25_scores(queries, chunks), queries, chunks, k)


def tfidf(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    return filled(tfidf_scores(queries, chunks), queries, chunks, k)


def dense(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    return top(dense_scores(queries, chunks, k), k)
