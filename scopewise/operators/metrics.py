"""Retrieval metrics over relevance by rank, for all items at once.

Input rows are (item, rank, relevant), one per retrieved chunk, ranks from 1. One aggregation gives every metric
of an item; lists are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopewise.functions.text import distinct_tokens, overlap

HIT = 0.5


def relevance(retrieved: DataFrame, gold: DataFrame, on: list[str], threshold: float = HIT) -> DataFrame:
    """retrieved(on, rank, content) and gold(on, gold) -> retrieved with relevant, by token overlap."""
    return retrieved.join(gold, on).withColumn("relevant", overlap(distinct_tokens(F.col("content")), distinct_tokens(F.col("gold"))) >= threshold)


def _ideal(k: int) -> Column:
    """The ideal gain of min(relevant, k) hits."""
    steps = F.transform(F.sequence(F.lit(1), F.least("relevant_count", F.lit(k))), lambda i: F.log(F.lit(2.0)) / F.log(i + F.lit(1.0)))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def item_metrics(judged: DataFrame, keys: list[str], hits=(1, 3, 5, 10), precisions=(3, 5, 10), gains=(3, 10)) -> DataFrame:
    """hit_at_k, precision_at_k, reciprocal_rank, average_precision and ndcg_at_k for each combination of keys."""
    rel = F.col("relevant").cast("int")
    running = F.sum(rel).over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = judged.withColumn("_rel", rel).withColumn("_run", running).withColumn("_gain", F.col("_rel") * F.log(F.lit(2.0)) / F.log(F.col("rank") + F.lit(1.0)))
    rr = F.coalesce(F.lit(1.0) / F.min(F.when(F.col("_rel") == 1, F.col("rank"))), F.lit(0.0))
    out = rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("rank") <= k, F.col("_rel")).otherwise(0)).alias(f"hit_at_{k}") for k in hits],
        *[(F.sum(F.when(F.col("rank") <= k, F.col("_rel")).otherwise(0)) / F.lit(float(k))).alias(f"precision_at_{k}") for k in precisions],
        rr.alias("reciprocal_rank"),
        F.coalesce(F.sum(F.when(F.col("_rel") == 1, F.col("_run") / F.col("rank"))) / F.sum("_rel"), F.lit(0.0)).alias("average_precision"),
        F.sum("_rel").cast("int").alias("relevant_count"),
        *[F.sum(F.when(F.col("rank") <= k, F.col("_gain")).otherwise(0.0)).alias(f"_dcg_{k}") for k in gains],
    )
    for k in gains:
        out = out.withColumn(f"ndcg_at_{k}", F.when(F.col("relevant_count") > 0, F.col(f"_dcg_{k}") / _ideal(k)).otherwise(F.lit(0.0))).drop(f"_dcg_{k}")
    return out


def summary(items: DataFrame, by: list[str] = ()) -> DataFrame:
    """Means of all item metrics, per group of ``by`` and over all (nulls in by) if there are any."""
    means = [F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in items.columns if c.startswith(("hit_at", "precision_at", "ndcg_at", "reciprocal", "average_p"))]
    return (items.rollup(*by) if by else items.groupBy()).agg(F.count("*").alias("num_items"), *means)


def multi_source(sources: DataFrame, hits=(1, 3, 5, 10)) -> DataFrame:
    """Item values of items with several sources, from metrics per (item, source)."""
    return sources.groupBy("item").agg(
        F.count("*").alias("num_sources"),
        *[F.avg(F.col(f"hit_at_{k}").cast("double")).alias(f"source_hit_at_{k}") for k in hits],
        *[F.min(f"hit_at_{k}").alias(f"all_sources_hit_at_{k}") for k in hits],
        F.avg("reciprocal_rank").alias("source_mrr_mean"),
        F.min("reciprocal_rank").alias("source_mrr_worst"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("precision_at_3", "precision_at_5", "precision_at_10", "ndcg_at_3", "ndcg_at_10", "average_precision")],
    )


def wrong_scope_rate(retrieved: DataFrame, required: DataFrame, k: int) -> DataFrame:
    """Per item the mean over scopes of the share of the top k whose document is not required; no row where nothing was retrieved."""
    needed = required.select("item", "scope", "document", F.lit(True).alias("_need")).distinct()
    shares = retrieved.where(F.col("rank") <= k).join(needed, ["item", "scope", "document"], "left").groupBy("item", "scope").agg(F.avg(F.col("_need").isNull().cast("double")).alias("share"))
    return shares.groupBy("item").agg(F.avg("share").alias(f"wrong_rate_at_{k}"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the exact neighbours that were found."""
    hit = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count("*")).alias("recall"))


def lower_percentile(rows: DataFrame, by: list[str], value: str, percent: int) -> DataFrame:
    """The value at position floor(percent/100 x (n-1)) of each group in order; no interpolation."""
    w = Window.partitionBy(*by)
    at = F.floor(F.lit(percent) * (F.count("*").over(w) - 1) / 100) + 1
    order = F.row_number().over(w.orderBy(value))
    return rows.select(*by, value, order.alias("_n"), at.alias("_at")).where("_n = _at").select(*by, F.col(value).alias(f"p{percent}"))


def generation_health(attempts: DataFrame) -> DataFrame:
    """Counts over attempts(answer, retries, truncated, error)."""
    return attempts.agg(
        F.count("*").alias("attempted"),
        F.count_if(F.col("retries") > 0).alias("retried"),
        F.count_if(F.coalesce(F.trim("answer"), F.lit("")) == "").alias("blank"),
        F.count_if("truncated").alias("truncated"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def scored_answer(similarity: Column, answer: Column, threshold: float = 0.75) -> tuple[Column, Column]:
    """(similarity, pass): blank answers score 0 and fail."""
    blank = F.coalesce(F.trim(answer), F.lit("")) == ""
    value = F.when(blank, F.lit(0.0)).otherwise(similarity)
    return value, value >= threshold
