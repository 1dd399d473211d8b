"""Queries over the evaluations by method and the prompt engines, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scopewise.functions.chunker import chunked
from scopewise.operators import context, evaluation, fusion, metrics, retrieval, store
from scopewise.plans import retrieval as R
from scopewise.plans.documents import _CHUNKS, _CLEAN, _FACTUAL_HEAD, _FACTUAL_MID, _FACTUAL_TAIL, _lit
from scopewise.plans.tables import chunks, documents, questions, table, with_vectors
from scopewise.sources.staging import staged


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return with_vectors(chunks(spark, d), spark, d, "chunk_id")


def evaluation_by_method(spark: SparkSession, d: str) -> DataFrame:
    """The single-source evaluation of every method."""
    items = with_vectors(questions(spark, d), spark, d, "query_id").withColumn("gold", F.col("text"))
    return R._rounded(evaluation.single(items, _chunks(spark, d)))


def chunk_id() -> Column:
    """Ids that are distinct and in the order of documents and chunks, however many chunks a document has."""
    return F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "chunk_idx"))


def chunk_bm25_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The single-source evaluation end to end: documents in chunks, BM25, bounded contexts, relevance, mean metrics."""
    rows = chunked(documents(spark, d, "doc_id", "source", "text").withColumnRenamed("source", "scope"), "doc_id", "text")
    rows = staged(rows.withColumn("chunk_id", chunk_id()).select("chunk_id", "scope", "content"), "chunks")  # cut once
    asked = questions(spark, d)
    found = context.bounded(retrieval.bm25(asked, rows, 10).join(rows.select("chunk_id", "content"), "chunk_id"), 2000)
    judged = metrics.relevance(found.select("query_id", "rank", "content"), asked.select("query_id", F.col("text").alias("gold")), ["query_id"])
    return R._rounded(metrics.summary(metrics.item_metrics(judged, ["query_id"])))


def _multi_items(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of questions as items: the first one's text is asked of both, each source has its own gold text and document."""
    asked = questions(spark, d)
    document = chunks(spark, d).groupBy("scope").agg(F.min("chunk_id").alias("document"))
    source = F.struct("query_id", "scope", "document", F.col("text").alias("gold"))
    rows = asked.join(document, "scope", "left").withColumn("item", F.floor(F.col("query_id") / 2).cast("bigint"))
    rows = rows.groupBy("item").agg(F.array_sort(F.collect_list(source)).alias("sources"), F.min_by("text", "query_id").alias("question"))
    return rows.select("item", F.concat(F.lit("type"), (F.col("item") % 3).cast("string")).alias("kind"), "question", F.transform("sources", lambda s: s.dropFields("query_id")).alias("sources"))


def multi_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Every item of several sources by BM25."""
    return R._rounded(evaluation.multi(_multi_items(spark, d), chunks(spark, d), "bm25"))


def multi_evaluation_by_method(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation of items of several sources by every method, by kind and over all."""
    items = with_vectors(_multi_items(spark, d), spark, d, "item")
    return R._rounded(evaluation.multi_summary(items, _chunks(spark, d)))


def prompt_engines(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of every engine: search, bounded contexts and the factual prompt; RRF shows percents in its header."""
    items, held, out = with_vectors(questions(spark, d), spark, d, "query_id"), _chunks(spark, d), None
    rankings = fusion.Rankings(items, retrieval.tokenized(held))
    for name in evaluation.METHODS:
        found = rankings.by(name, 3).select("query_id", "chunk_id", "score", "rank").join(held.select("chunk_id", "content"), "chunk_id")
        found = found.select("query_id", "rank", F.round("score", 6).alias("score"), "content", F.lit("").alias("date"), F.lit("Clinical Discharge Summary").alias("kind"))
        rows = context.prompts(items, found, percent=name == "rrf").select(F.lit(name).alias("engine"), "query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), "retrieved", F.col("header").contains("%**").alias("percent"))
        out = rows if out is None else out.unionByName(rows)
    return out


def ingest_modes(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks each way of de-duplication lets in: by patient, by document, none."""
    rows, out = table(spark, d, "documents").select("source", "lang", "doc_id"), None
    for mode in ("patient", "document", "none"):
        kept = store.deduplicated(rows, mode, "source", "lang", "doc_id").groupBy("source").agg(F.count("*").alias("chunks")).select(F.lit(mode).alias("mode"), "*")
        out = kept if out is None else out.unionByName(kept)
    return out


QUERIES = {f.__name__: f for f in (chunk_bm25_metrics, evaluation_by_method, multi_evaluation, multi_evaluation_by_method, prompt_engines, ingest_modes)}

_ROUNDED = ", ".join(f"round(avg({m}), 6) AS mean_{m}" for m in R._METRICS)


def _ranked(base: str) -> dict[str, tuple[str, str]]:
    """Each method's (tables, table of scores) over a base."""
    bm25, tfidf = R.sql_bm25(base), R.sql_tfidf(base)
    return {"bm25": (bm25, "bm25"), "tfidf": (tfidf, "tfidf"), "dense": (R.sql_dense(base), "dense"), "hybrid": (R.sql_hybrid(tfidf), "hybrid"), "rrf": (R.sql_raw(bm25), "rrf")}


_SINGLE = [f"(WITH {R.sql_judged(tables, scored)} SELECT '{method}' AS method, count(*) AS num_items, {_ROUNDED} FROM items)" for method, (tables, scored) in _ranked(R.sql_base()).items()]
#: An item's sources as questions of their own: 2 x item and the place.
_ASKED = f"""SELECT b.item_id AS query_id, 'src' || CAST(b.item_id % 20 AS VARCHAR) AS scope, {R._TOK.format('f.text')} AS t, {R._TOK.format('b.text')} AS g
             FROM benchmark b JOIN (SELECT item_id // 2 AS item, arg_min(text, item_id) AS text FROM benchmark GROUP BY ALL) f ON f.item = b.item_id // 2"""
_SOURCE_MEANS = ("precision_at_3", "precision_at_5", "precision_at_10", "ndcg_at_3", "ndcg_at_10", "average_precision")
_VALUES = {f"source_hit_at_{k}": f"avg(hit_at_{k})" for k in (1, 3, 5, 10)} | {f"all_sources_hit_at_{k}": f"min(hit_at_{k})" for k in (1, 3, 5, 10)}
_VALUES |= {"source_mrr_mean": "avg(reciprocal_rank)", "source_mrr_worst": "min(reciprocal_rank)"} | {f"mean_{m}": f"avg({m})" for m in _SOURCE_MEANS}


def _multi(tables: str, scored: str) -> str:
    wrong = "".join(
        f""",
    share{k} AS (SELECT query_id // 2 AS item, scope, avg(CASE WHEN chunk_id = document THEN 0.0::DOUBLE ELSE 1 END) AS share FROM judged JOIN need USING (scope) WHERE rank <= {k} GROUP BY ALL),
    wrong{k} AS (SELECT item, avg(share) AS wrong_rate_at_{k} FROM share{k} GROUP BY item)"""
        for k in (3, 10)
    )
    values = ", ".join(f"{v} AS {n}" for n, v in _VALUES.items())
    return f"""{R.sql_judged(tables, scored)}, need AS (SELECT scope, min(chunk_id) AS document FROM c GROUP BY scope){wrong},
    each AS (SELECT query_id // 2 AS item, count(*) AS num_sources, {values} FROM items GROUP BY ALL),
    multi AS (SELECT a.item, 'type' || CAST(a.item % 3 AS VARCHAR) AS kind, each.* EXCLUDE (item), wrong_rate_at_3, wrong_rate_at_10
              FROM (SELECT DISTINCT item_id // 2 AS item FROM benchmark) a LEFT JOIN each USING (item) LEFT JOIN wrong3 USING (item) LEFT JOIN wrong10 USING (item))"""


_COLUMNS = [*_VALUES, "wrong_rate_at_3", "wrong_rate_at_10"]
_WHOLE = {f"all_sources_hit_at_{k}" for k in (1, 3, 5, 10)}
_MULTI_BASE = R.sql_base(_ASKED)
_MULTI = []
for _method, (_tables, _scored) in _ranked(_MULTI_BASE).items():
    _tables = _tables.replace("x.vec_id = q.query_id", "x.vec_id = q.query_id // 2").replace("x.vec_id = b.query_id", "x.vec_id = b.query_id // 2").replace("x.vec_id = t.query_id", "x.vec_id = t.query_id // 2")
    _MULTI.append(f"(WITH {_multi(_tables, _scored)} SELECT '{_method}' AS method, kind, count(*) AS num_items, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _COLUMNS)} FROM multi GROUP BY ROLLUP (kind))")


#: Chunks as a table of documents, and the retrieval tables over them.
_PIECES = """,
    pieces AS (SELECT doc_id * 1000000 + row_number() OVER (PARTITION BY doc_id ORDER BY s) AS chunk_id, source AS scope, content AS text FROM cut JOIN documents USING (doc_id) WHERE content <> ''),"""
_OVER_PIECES = R.sql_bm25(R.sql_base()).replace("SELECT doc_id AS chunk_id, source AS scope,", "SELECT chunk_id, scope,", 1).replace("FROM documents)", "FROM pieces)", 1)
_CHUNKED = _CHUNKS.format(source=_CLEAN) + _PIECES + _OVER_PIECES


def _engine(method: str, tables: str, scored: str) -> str:
    return f"""(WITH {tables},
        ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(round(score, 9) AS FLOAT) DESC, chunk_id) AS rank FROM {scored}) WHERE rank <= 3),
        notes AS (SELECT query_id, string_agg('- [Notes from  - Clinical Discharge Summary]: ' || CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 400) || '...' END, chr(10) || chr(10) ORDER BY rank) AS notes, count(*) AS n
                  FROM ranked JOIN documents ON doc_id = chunk_id GROUP BY query_id)
        SELECT '{method}' AS engine, item_id AS query_id, md5({_lit(_FACTUAL_HEAD)} || coalesce(notes, {_lit(context.NO_NOTES)}) || {_lit(_FACTUAL_MID)} || text || {_lit(_FACTUAL_TAIL)}) AS prompt_md5,
               coalesce(n, 0) AS retrieved, {'n IS NOT NULL' if method == 'rrf' else 'FALSE'} AS percent
        FROM benchmark LEFT JOIN notes ON query_id = item_id)"""


ORACLE_SQL = {
    "chunk_bm25_metrics": f"WITH {R.sql_judged(_CHUNKED, 'bm25')} SELECT count(*) AS num_items, {_ROUNDED} FROM items",
    "evaluation_by_method": " UNION ALL ".join(_SINGLE),
    "multi_evaluation": f"WITH {_multi(R.sql_bm25(_MULTI_BASE), 'bm25')} SELECT item, kind, num_sources, {', '.join(c if c in _WHOLE else f'round({c}, 6) AS {c}' for c in _COLUMNS)} FROM multi",
    "multi_evaluation_by_method": " UNION ALL ".join(_MULTI),
    "prompt_engines": " UNION ALL ".join(_engine(m, *x) for m, x in _ranked(R.sql_base()).items()),
    "ingest_modes": """
        SELECT mode, source, count(*) AS chunks FROM (
            SELECT unnest(['patient', 'document', 'none']) AS mode, source, lang, doc_id, min(doc_id) OVER (PARTITION BY source, lang) AS a, min(doc_id) OVER (PARTITION BY lang) AS b FROM documents)
        WHERE mode = 'none' OR (mode = 'patient' AND doc_id = a) OR (mode = 'document' AND doc_id = b) GROUP BY ALL""",
}
