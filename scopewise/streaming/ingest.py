"""Incremental ingest and token streams with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scopewise.functions.chunker import chunked


def ingest(documents: DataFrame, store: str, checkpoint: str, keys: tuple[str, ...] = ("patientId", "documentId"), text: str = "content") -> StreamingQuery:
    """Chunks arriving documents and replaces their rows in a Parquet store, batch by batch.

    A batch writes its own documents only: their chunks, and then their keys, which make the chunks count. What a
    document has now is what its last batch wrote, so a batch costs what it brings and not what the store holds, and
    one that runs again writes the same files. Of documents that arrive more than once in a batch the last by
    ``arrived`` counts; one that has become blank has no chunks.
    """

    def replace(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(text, "arrived").alias(text))
        chunked(last, keys[0], text).write.mode("overwrite").parquet(f"{store}/chunks/batch={number}")
        last.select(*keys).write.mode("overwrite").parquet(f"{store}/documents/batch={number}")

    return documents.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The chunks that documents have now; None before the first batch."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/documents")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    written = spark.read.parquet(f"{store}/documents")
    keys = [c for c in written.columns if c != "batch"]
    last = written.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{store}/chunks").join(last, [*keys, "batch"]).drop("batch")


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Write what documents have now as the first batch of a new store; batches that follow go there."""
    rows = current(spark, store)
    rows.write.mode("overwrite").parquet(f"{target}/chunks/batch=-1")
    spark.read.parquet(f"{store}/documents").drop("batch").distinct().write.mode("overwrite").parquet(f"{target}/documents/batch=-1")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per event type and time window, closed by a watermark (works on batch tables too)."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def spoken(tokens: Column, stop: str) -> Column:
    """struct<text, thinking> of an ordered token array.

    Ends at the stop token; tokens between <think> and </think> are thinking; header tokens are left out; newlines
    before any other text of a part are too.
    """
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("thinking"), F.lit(False).alias("in_thought"), F.lit(False).alias("in_header"), F.lit(False).alias("ended"))

    def step(s: Column, t: Column) -> Column:
        marks = t.isin("<think>", "</think>", "<|start_header_id|>", "<|end_header_id|>")
        ended = s["ended"] | (t == stop)
        silent = ended | marks | s["in_header"]
        blank = t.isin("\n", "\n\n")
        adds = lambda part, mine: F.when(~silent & mine & (~blank | (part != "")), F.concat(part, t)).otherwise(part)
        thought = F.when(ended, s["in_thought"]).when(t == "<think>", True).when(t == "</think>", False).otherwise(s["in_thought"])
        heading = F.when(ended, s["in_header"]).when(t == "<|start_header_id|>", True).when(t == "<|end_header_id|>", False).otherwise(s["in_header"])
        return F.struct(
            adds(s["text"], ~s["in_thought"]).alias("text"), adds(s["thinking"], s["in_thought"]).alias("thinking"), thought.alias("in_thought"), heading.alias("in_header"), ended.alias("ended")
        )

    return F.aggregate(tokens, start, step, lambda s: F.struct(s["text"].alias("text"), s["thinking"].alias("thinking")))


def tokens_per_second(stats: Column) -> Column:
    """From a JSON of generated_tokens, prompt_eval_end_ms and inference_end_ms; null if a part is missing."""
    number = lambda k: F.get_json_object(stats, f"$.{k}").cast("double")
    spent = number("inference_end_ms") - number("prompt_eval_end_ms")
    return F.when(spent > 0, number("generated_tokens") / spent * 1000)
