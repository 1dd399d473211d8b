"""Queries over the retrieval and evaluation operators, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopewise.functions import vectors as V
from scopewise.functions.text import tokens
from scopewise.operators import fusion, metrics, retrieval, store
from scopewise.plans.tables import chunks, questions, table, vectors, with_vectors

K = 10


def _shown(ranked: DataFrame, *extra: str) -> DataFrame:
    return ranked.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), *extra)


def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).select("chunk_id", tokens(F.col("content")).alias("t"))
    return rows.select("chunk_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.array_join("t", " ").alias("tokens"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.corpus_stats(chunks(spark, d)).select("scope", "n", F.round("avgdl", 6).alias("avgdl"))


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.doc_freq(chunks(spark, d))


def term_freq_max(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_counts(chunks(spark, d)).groupBy("scope", "chunk_id").agg(F.max("tf").alias("max_tf"), F.count("*").alias("terms"))


def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return retrieval.doc_freq(rows).join(retrieval.corpus_stats(rows), "scope").select("scope", "term", F.round(idf, 6).alias("idf"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(retrieval.bm25(questions(spark, d), chunks(spark, d), K))


def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(retrieval.tfidf(questions(spark, d), chunks(spark, d), K))


def dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(retrieval.dense(*vectors(spark, d), K))


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return with_vectors(questions(spark, d), spark, d, "query_id"), with_vectors(chunks(spark, d), spark, d, "chunk_id")


def hybrid_weighted_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(fusion.hybrid(*_both(spark, d), K))


def rrf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(fusion.rrf(*_both(spark, d), K))


def minmax_fusion_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(fusion.fused(*_both(spark, d), K))


def relevance_pct(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.relevance_pct(retrieval.raw_scores(*_both(spark, d)))
    return rows.select("query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("bm25", "dense", "relevance")])


def cosine_knn(spark: SparkSession, d: str) -> DataFrame:
    rows = store.knn(*vectors(spark, d), K)
    return rows.select("query_id", "chunk_id", "rank", (F.round("distance", 6) + 0).alias("distance"), F.round("score", 5).alias("score"))


def l2_knn_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = store.knn(*vectors(spark, d), K, "l2")
    return rows.select("query_id", "chunk_id", "rank", (F.round("distance", 6) + 0).alias("distance"), F.round("score", 5).alias("score"))


def lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    queries, rows = vectors(spark, d)
    return metrics.recall(store.lsh_knn(queries, rows, K), store.knn(queries, rows, K, "l2"))


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    rows = V.hash_embedding(table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id", "text")
    return rows.select("query_id", "k", F.round("v", 6).alias("v"))


def embedding_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dim"), F.round(V.norm(F.col("embedding")), 5).alias("l2norm"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = chunks(spark, d), questions(spark, d)
    found = retrieval.bm25(asked, rows, K).join(rows, "chunk_id").select("query_id", "rank", "chunk_id", "content")
    return metrics.relevance(found, asked.select("query_id", F.col("text").alias("gold")), ["query_id"])


def overlap_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("query_id", "chunk_id", "rank", "relevant")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return metrics.item_metrics(_judged(spark, d), ["query_id"])


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def item_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_items(spark, d))


def metric_rollup_by_type(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).withColumn("kind", F.concat(F.lit("type"), (F.col("query_id") % 3).cast("string")))
    return _rounded(metrics.summary(rows, ["kind"]))


def multi_source_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).withColumn("item", F.floor(F.col("query_id") / 2).cast("bigint"))
    return _rounded(metrics.multi_source(rows))


def wrong_scope_rate(spark: SparkSession, d: str) -> DataFrame:
    asked = questions(spark, d)
    found = retrieval.bm25(asked, chunks(spark, d), K).join(asked.select("query_id", "scope"), "query_id")
    item = F.floor(F.col("query_id") / 2).cast("bigint").alias("item")
    needed = _judged(spark, d).where("relevant").join(asked.select("query_id", "scope"), "query_id").select(item, "scope", F.col("chunk_id").alias("document"))
    retrieved = found.select(item, "scope", F.col("chunk_id").alias("document"), "rank")
    return _rounded(metrics.wrong_scope_rate(retrieved, needed, 3))


def latency_percentile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return metrics.lower_percentile(rows, ["event_type"], "value", 50).join(metrics.lower_percentile(rows, ["event_type"], "value", 95), "event_type")


def generation_health(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    return metrics.generation_health(rows.select(F.col("text").alias("answer"), F.col("turn").alias("retries"), (F.length("text") > 1000).alias("truncated"), F.when(F.col("turn") == 7, "late").alias("error")))


def recall_at_10(spark: SparkSession, d: str) -> DataFrame:
    """Recall of scope-wise search against search over all vectors."""
    queries, rows = vectors(spark, d)
    return _rounded(metrics.recall(retrieval.dense(queries, rows, K), store.knn(queries, rows, K)))


def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    queries, rows = vectors(spark, d)
    best = retrieval.dense(queries, rows, 2).where("rank = 2")
    value, passed = metrics.scored_answer(F.col("score") / 100, F.lit("answer"))
    return best.select("query_id", F.round(value, 6).alias("similarity"), passed.alias("generation_pass"))


_TOK = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-zA-Z0-9]+'), lambda t: length(t) > 2)"
#: Questions with their gold texts; the question is its own gold text.
_OWN = f"SELECT item_id AS query_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS scope, {_TOK.format('text')} AS t, {_TOK.format('text')} AS g FROM benchmark"


def sql_base(asked: str = _OWN) -> str:
    return f"""
    c AS (SELECT doc_id AS chunk_id, source AS scope, {_TOK.format('text')} AS t FROM documents),
    q AS ({asked}),
    n AS (SELECT scope, count(*) AS n, avg(len(t)) AS avgdl FROM c GROUP BY scope),
    tf AS (SELECT scope, chunk_id, term, count(*) AS tf, dl
           FROM (SELECT scope, chunk_id, len(t) AS dl, unnest(t) AS term FROM c) GROUP BY ALL),
    df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL)"""


def sql_bm25(base: str) -> str:
    return f"""{base},
    qt AS (SELECT DISTINCT query_id, scope, unnest(t) AS term FROM q),
    bm AS (SELECT query_id, chunk_id,
                  sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)
                      * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score
           FROM qt JOIN tf USING (scope, term) JOIN df USING (scope, term) JOIN n USING (scope) GROUP BY ALL),
    bm25 AS (SELECT q.query_id, c.chunk_id, coalesce(bm.score, 0) AS score
             FROM q JOIN c USING (scope) LEFT JOIN bm ON bm.query_id = q.query_id AND bm.chunk_id = c.chunk_id)"""


def sql_tfidf(base: str) -> str:
    return f"""{base},
    qt AS (SELECT query_id, scope, term, count(*) AS tf FROM (SELECT query_id, scope, unnest(t) AS term FROM q) GROUP BY ALL),
    wq AS (SELECT query_id, qt.scope, qt.term, qt.tf / CAST(max(qt.tf) OVER (PARTITION BY query_id) AS DOUBLE)
                  * (ln(n / CAST(1 + coalesce(df, 0) AS DOUBLE)) + 1) AS w
           FROM qt LEFT JOIN df USING (scope, term) JOIN n ON n.scope = qt.scope),
    wd AS (SELECT chunk_id, tf.scope, tf.term, tf / CAST(max(tf) OVER (PARTITION BY chunk_id) AS DOUBLE)
                  * (ln(n / CAST(1 + df AS DOUBLE)) + 1) AS w
           FROM tf JOIN df USING (scope, term) JOIN n USING (scope)),
    lq AS (SELECT query_id, sqrt(sum(w * w)) AS l FROM wq GROUP BY ALL),
    ld AS (SELECT chunk_id, sqrt(sum(w * w)) AS l FROM wd GROUP BY ALL),
    dots AS (SELECT query_id, chunk_id, sum(wq.w * wd.w) AS dot FROM wq JOIN wd USING (scope, term) GROUP BY ALL),
    ti AS (SELECT query_id, chunk_id, 100 * dot / (lq.l * ld.l) AS score FROM dots JOIN lq USING (query_id) JOIN ld USING (chunk_id)),
    tfidf AS (SELECT q.query_id, c.chunk_id, coalesce(ti.score, 0) AS score
              FROM q JOIN c USING (scope) LEFT JOIN ti ON ti.query_id = q.query_id AND ti.chunk_id = c.chunk_id)"""


_BASE = sql_base()
_BM25, _TFIDF = sql_bm25(_BASE), sql_tfidf(_BASE)


def _top(base: str, scored: str, k: int = K) -> str:
    return f"""WITH {base}
        SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(round(score, 9) AS FLOAT) DESC, chunk_id) AS rank FROM {scored})
        WHERE rank <= {k}"""


def _cos(a: str, b: str) -> str:
    dot = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] * z[2] AS DOUBLE)))"
    return f"({dot.format(a, b)} / (sqrt({dot.format(a, a)}) * sqrt({dot.format(b, b)})))"


_VEC = "v AS (SELECT vec_id AS chunk_id, label AS scope, embedding AS e FROM embeddings), vq AS (SELECT chunk_id AS query_id, scope, e FROM v WHERE chunk_id % 20 = 0)"
_DENSE = f"{_VEC}, dense AS (SELECT query_id, chunk_id, 100 * {_cos('vq.e', 'v.e')} AS score FROM vq JOIN v USING (scope))"


def sql_raw(bm25: str) -> str:
    return f"""{bm25},
    raw AS (SELECT b.query_id, b.chunk_id, b.score AS bm25,
                   CASE WHEN x.embedding IS NULL OR y.embedding IS NULL THEN 0 ELSE {_cos('x.embedding', 'y.embedding')} END AS dense
            FROM bm25 b LEFT JOIN embeddings x ON x.vec_id = b.query_id LEFT JOIN embeddings y ON y.vec_id = b.chunk_id),
    mm AS (SELECT *, CASE WHEN max(bm25) OVER w > min(bm25) OVER w THEN (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) ELSE 0 END AS nb,
                  CASE WHEN max(dense) OVER w > min(dense) OVER w THEN (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w) ELSE 0 END AS nd
           FROM raw WINDOW w AS (PARTITION BY query_id)),
    places AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 12) DESC, chunk_id) AS rb,
                      row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 12) DESC, chunk_id) AS rd FROM raw),
    rrf AS (SELECT query_id, chunk_id, 100 * (1 / CAST(60 + rb AS DOUBLE) + 1 / CAST(60 + rd AS DOUBLE)) AS score FROM places),
    fused AS (SELECT query_id, chunk_id, 0.5::DOUBLE * nd + 0.5::DOUBLE * nb AS score FROM mm)"""


def sql_hybrid(tfidf: str) -> str:
    return f"""{tfidf},
    hybrid AS (SELECT t.query_id, t.chunk_id, 50 * CASE WHEN x.embedding IS NULL OR y.embedding IS NULL THEN 0 ELSE {_cos('x.embedding', 'y.embedding')} END
                      + 0.5::DOUBLE * t.score AS score
               FROM tfidf t LEFT JOIN embeddings x ON x.vec_id = t.query_id LEFT JOIN embeddings y ON y.vec_id = t.chunk_id)"""


def sql_dense(base: str) -> str:
    """Dense scores of questions and chunks that have the vector of their number."""
    return f"""{base},
    dense AS (SELECT q.query_id, c.chunk_id, 100 * CASE WHEN x.embedding IS NULL THEN 0 ELSE {_cos('x.embedding', 'y.embedding')} END AS score
              FROM q JOIN c USING (scope) JOIN embeddings y ON y.vec_id = c.chunk_id LEFT JOIN embeddings x ON x.vec_id = q.query_id)"""


_RAW, _HYBRID = sql_raw(_BM25), sql_hybrid(_TFIDF)
_IDEAL = "nullif(list_sum(list_transform(range(1, CAST(least(relevant_count, {0}) AS BIGINT) + 1), lambda i: ln(2) / ln(i + 1))), 0)"


def sql_judged(base: str, scored: str) -> str:
    """Relevance and metrics of the first ten by a table of scores."""
    return f"""{base},
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(round(score, 9) AS FLOAT) DESC, chunk_id) AS rank FROM {scored}) WHERE rank <= {K}),
    judged AS (SELECT top.query_id, top.chunk_id, rank, q.scope,
                      CASE WHEN least(len(list_distinct(c.t)), len(list_distinct(q.g))) > 0
                           THEN len(list_intersect(list_distinct(c.t), list_distinct(q.g))) / CAST(least(len(list_distinct(c.t)), len(list_distinct(q.g))) AS DOUBLE)
                           ELSE 0 END >= 0.5 AS relevant
               FROM top JOIN c USING (chunk_id) JOIN q USING (query_id)),
    run AS (SELECT *, CAST(relevant AS INTEGER) AS rel, sum(CAST(relevant AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM judged),
    sums AS (
        SELECT query_id,
               max(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS hit_at_1, max(CASE WHEN rank <= 3 THEN rel ELSE 0 END) AS hit_at_3,
               max(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS hit_at_5, max(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS hit_at_10,
               sum(CASE WHEN rank <= 3 THEN rel ELSE 0 END) / 3.0::DOUBLE AS precision_at_3, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) / 5.0::DOUBLE AS precision_at_5,
               sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) / 10.0::DOUBLE AS precision_at_10,
               coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0) AS reciprocal_rank,
               coalesce(sum(CASE WHEN rel = 1 THEN upto / CAST(rank AS DOUBLE) END) / sum(rel), 0) AS average_precision,
               CAST(sum(rel) AS INTEGER) AS relevant_count,
               sum(CASE WHEN rank <= 3 THEN rel * ln(2) / ln(rank + 1) ELSE 0 END) AS dcg_3,
               sum(CASE WHEN rank <= 10 THEN rel * ln(2) / ln(rank + 1) ELSE 0 END) AS dcg_10
        FROM run GROUP BY query_id),
    items AS (SELECT *, coalesce(dcg_3 / {_IDEAL.format(3)}, 0) AS ndcg_at_3, coalesce(dcg_10 / {_IDEAL.format(10)}, 0) AS ndcg_at_10 FROM sums)"""


_JUDGED = sql_judged(_BM25, "bm25")
_METRICS = ("hit_at_1", "hit_at_3", "hit_at_5", "hit_at_10", "precision_at_3", "precision_at_5", "precision_at_10", "reciprocal_rank", "average_precision", "ndcg_at_3", "ndcg_at_10")
_KNN = """WITH {0}, far AS (SELECT query_id, chunk_id, {1} AS distance FROM vq CROSS JOIN (SELECT chunk_id, e AS e2 FROM v)),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rank FROM far)
    SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(distance, 6) + 0 AS distance, round({2}, 5) AS score FROM near WHERE rank <= 10"""
_COS_DISTANCE = f"1 - {_cos('e', 'e2')}"
_L2 = "sqrt(list_sum(list_transform(list_zip(e, e2), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS DOUBLE))))"

QUERIES = {
    f.__name__: f
    for f in (
        tokenize_docs, corpus_stats, doc_freq, term_freq_max, bm25_idf, bm25_topk, tfidf_topk, dense_cosine_topk, hybrid_weighted_topk, rrf_topk, minmax_fusion_topk, relevance_pct,
        cosine_knn, l2_knn_topk, lsh_recall, hash_embedding, embedding_fingerprint, overlap_relevance, item_metrics, metric_rollup_by_type, multi_source_metrics, wrong_scope_rate,
        latency_percentile, generation_health, recall_at_10, answer_scores,
    )
}

ORACLE_SQL = {
    "tokenize_docs": f"WITH {_BASE} SELECT chunk_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, array_to_string(t, ' ') AS tokens FROM c",
    "corpus_stats": f"WITH {_BASE} SELECT scope, n, round(avgdl, 6) AS avgdl FROM n",
    "doc_freq": f"WITH {_BASE} SELECT scope, term, df FROM df",
    "term_freq_max": f"WITH {_BASE} SELECT scope, chunk_id, max(tf) AS max_tf, count(*) AS terms FROM tf GROUP BY ALL",
    "bm25_idf": f"WITH {_BASE} SELECT scope, term, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 6) AS idf FROM df JOIN n USING (scope)",
    "bm25_topk": _top(_BM25, "bm25"),
    "tfidf_topk": _top(_TFIDF, "tfidf"),
    "dense_cosine_topk": _top(_DENSE, "dense"),
    "hybrid_weighted_topk": _top(_HYBRID, "hybrid"),
    "rrf_topk": _top(_RAW, "rrf"),
    "minmax_fusion_topk": _top(_RAW, "fused"),
    "relevance_pct": f"WITH {_RAW} SELECT query_id, chunk_id, round(bm25, 6) AS bm25, round(dense, 6) AS dense, round((nb + nd) / 2 * 100, 6) AS relevance FROM mm",
    "cosine_knn": _KNN.format(_VEC, _COS_DISTANCE, "(1 - distance / 2) * 100"),
    "l2_knn_topk": _KNN.format(_VEC, _L2, "100 / (1 + distance)"),
    "hash_embedding": r"""
        WITH RECURSIVE w AS (
            SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '[^a-zA-Z0-9_]+'), lambda x: length(x) > 2)) AS w FROM benchmark),
        d AS (SELECT DISTINCT w FROM w),
        h AS (SELECT w, 0::BIGINT AS h, 1 AS i FROM d
              UNION ALL SELECT w, (h * 31 + unicode(substr(w, i, 1))) & 4294967295, i + 1 FROM h WHERE i <= length(w)),
        f AS (SELECT w, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM h WHERE i = length(w) + 1),
        s AS (SELECT query_id, CAST(abs(h) % 384 AS INTEGER) AS k, sum(CASE WHEN h >= 0 THEN 1 ELSE -1 END) AS s FROM w JOIN f USING (w) GROUP BY ALL HAVING s <> 0)
        SELECT query_id, k, round(s / sqrt(CAST(sum(s * s) OVER (PARTITION BY query_id) AS DOUBLE)), 6) AS v FROM s""",
    "embedding_fingerprint": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x * x AS DOUBLE)))), 5) AS l2norm FROM embeddings",
    "overlap_relevance": f"WITH {_JUDGED} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, relevant FROM judged",
    "item_metrics": f"WITH {_JUDGED} SELECT query_id, relevant_count, hit_at_1, hit_at_3, hit_at_5, hit_at_10, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS[4:])} FROM items",
    "metric_rollup_by_type": f"WITH {_JUDGED} SELECT kind, count(*) AS num_items, {', '.join(f'round(avg({m}), 6) AS mean_{m}' for m in _METRICS)} FROM (SELECT *, 'type' || CAST(query_id % 3 AS VARCHAR) AS kind FROM items) GROUP BY ROLLUP (kind)",
    "multi_source_metrics": f"""WITH {_JUDGED} SELECT query_id // 2 AS item, count(*) AS num_sources,
        {', '.join(f'round(avg(hit_at_{k}), 6) AS source_hit_at_{k}, min(hit_at_{k}) AS all_sources_hit_at_{k}' for k in (1, 3, 5, 10))},
        round(avg(reciprocal_rank), 6) AS source_mrr_mean, round(min(reciprocal_rank), 6) AS source_mrr_worst,
        {', '.join(f'round(avg({m}), 6) AS mean_{m}' for m in ('precision_at_3', 'precision_at_5', 'precision_at_10', 'ndcg_at_3', 'ndcg_at_10', 'average_precision'))}
        FROM items GROUP BY query_id // 2""",
    "wrong_scope_rate": f"""WITH {_JUDGED},
        need AS (SELECT DISTINCT query_id // 2 AS item, scope, chunk_id FROM judged WHERE relevant),
        share AS (SELECT j.query_id // 2 AS item, j.scope, avg(CASE WHEN need.item IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS share
                  FROM judged j LEFT JOIN need ON need.item = j.query_id // 2 AND need.scope = j.scope AND need.chunk_id = j.chunk_id
                  WHERE rank <= 3 GROUP BY ALL)
        SELECT item, round(avg(share), 6) AS wrong_rate_at_3 FROM share GROUP BY item""",
    "latency_percentile": """
        WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, max(CASE WHEN i = 50 * (n - 1) // 100 THEN value END) AS p50, max(CASE WHEN i = 95 * (n - 1) // 100 THEN value END) AS p95 FROM o GROUP BY event_type""",
    "generation_health": """
        SELECT count(*) AS attempted, count(*) FILTER (turn > 0) AS retried, count(*) FILTER (coalesce(trim(text), '') = '') AS blank,
               count(*) FILTER (length(text) > 1000) AS truncated, count(*) FILTER (turn = 7) AS errors
        FROM conversations WHERE role = 'assistant'""",
    "recall_at_10": f"""WITH {_DENSE},
        own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(round(score, 9) AS FLOAT) DESC, chunk_id) AS r FROM dense) WHERE r <= 10),
        far AS (SELECT query_id, chunk_id, {_COS_DISTANCE} AS distance FROM vq CROSS JOIN (SELECT chunk_id, e AS e2 FROM v)),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS r FROM far) WHERE r <= 10)
        SELECT best.query_id, round(count(own.chunk_id) / CAST(count(*) AS DOUBLE), 6) AS recall
        FROM best LEFT JOIN own ON own.query_id = best.query_id AND own.chunk_id = best.chunk_id GROUP BY best.query_id""",
    "answer_scores": f"""WITH {_DENSE}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(round(score, 9) AS FLOAT) DESC, chunk_id) AS r FROM dense)
        SELECT query_id, round(score / 100, 6) AS similarity, score / 100 >= 0.75 AS generation_pass FROM o WHERE r = 2""",
}
