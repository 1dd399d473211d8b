"""Answers from a reader model in rounds: what is not clean goes again with the next, tighter budget.

A round packs the contexts of the items that are left, asks the reader in Arrow batches and writes what came of it to a
folder of its own before the next begins. Rounds are as many as the budgets, and items that are clean are not sent again.
A run that stops is resumed with the same folder: rounds that were written whole are read, not asked for again.

What goes again is written beside the attempt that was not clean, so that a round reads no more than the last one left and
nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopewise.functions.chunker import parts_of
from scopewise.operators import questions
from scopewise.operators.context import BUDGETS, factual_prompt, pack
from scopewise.sources.staging import new_folder

#: Batches of (id, prompt, reserve) -> batches of (id, raw, stats, error), a row for each. A failure of an item is its error.
Reader = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def clean():
    """An attempt that needs no other: an answer, not cut off, no error."""
    return (F.trim(F.coalesce("answer", F.lit(""))) != "") & ~F.col("truncated") & F.col("error").isNull()


def _written(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


#: What an item needs to be packed again: its blocks as columns of arrays.
AGAIN = ("question", "ranks", "scopes", "texts")


def asked(items: DataFrame, budget: Sequence, template: str = "chatml") -> DataFrame:
    """(id, prompt, reserve, contexts, dropped, and what packs them again) of items(id, question, blocks) packed for a budget."""
    items = items.select(F.col("id").alias("item"), "question", "blocks", F.col("blocks.rank").alias("ranks"), F.col("blocks.scope_pos").alias("scopes"), F.col("blocks.block").alias("texts"))
    packed = pack(items, [budget], AGAIN)
    notes = F.concat_ws("\n\n", F.transform("contexts", lambda c: F.concat(F.lit("- "), c)))
    prompt = factual_prompt(F.col("question"), notes, template)
    return packed.select(F.col("item").alias("id"), prompt.alias("prompt"), F.lit(int(budget[0])).alias("reserve"), F.size("contexts").alias("contexts"), "dropped", *AGAIN)


def left_of(made: DataFrame) -> DataFrame:
    """items(id, question, blocks) that a round left."""
    zipped = F.transform(F.arrays_zip("ranks", "scopes", "texts"), lambda b: F.struct(b["ranks"].alias("rank"), b["scopes"].alias("scope_pos"), b["texts"].alias("block")))
    return made.where("NOT clean").select("id", "question", zipped.alias("blocks"))


def _beside(reader: Reader) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The reader over slices of Arrow batches, with what is known of each prompt kept beside its answers, as it came."""
    beside = ["id", "contexts", "dropped", *AGAIN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def given() -> Iterator[pd.DataFrame]:
            for batch in parts_of(batches):
                part = batch.select(["id", "prompt", "reserve"]).to_pandas()
                for at, i in enumerate(part["id"]):
                    known.setdefault(i, []).append((batch, at))
                yield part

        for out in reader(given()):
            rows = []
            for i in out["id"]:
                rows.append(known[i].pop())
                if not known[i]:
                    del known[i]
            if rows:
                said = [pa.array(out[c], pa.string(), from_pandas=True) for c in ("raw", "stats", "error")]
                facts = [pa.concat_arrays([batch.column(c).slice(at, 1) for batch, at in rows]) for c in beside]
                yield pa.RecordBatch.from_arrays([*said, *facts], ["raw", "stats", "error", *beside])

    return run


def round_of(items: DataFrame, reader: Reader, number: int, budget: Sequence, template: str = "chatml") -> DataFrame:
    """(id, answer, stopped, prompt_tokens, generated_tokens, truncated, error, contexts, dropped, budget, clean) of one attempt each; with what goes again."""
    prompts = asked(items, budget, template)
    kept = ["contexts", "dropped", *AGAIN]
    schema = ", ".join(["raw string", "stats string", "error string", *[f"{c} {prompts.schema[c].dataType.simpleString()}" for c in ("id", *kept)]])
    rows = questions.attempts(prompts.mapInArrow(_beside(reader), schema), keep=tuple(kept)).withColumn("clean", clean())
    return rows.withColumns({c: F.when(~F.col("clean"), F.col(c)) for c in AGAIN} | {"budget": F.lit(number)})


def rounds(items: DataFrame, reader: Reader, budgets: Sequence[Sequence] = BUDGETS, folder: str | None = None, template: str = "chatml") -> DataFrame:
    """All attempts, by id and budget, of items(id, question, blocks); ids are unique.

    ``folder`` is a path that all executors share; a new one in the shared folder if none is given. An
    empty table has no attempts. A question that is null is empty, blocks that are null are none.
    """
    spark = items.sparkSession
    folder = folder or new_folder(spark, "rounds")
    blocks = items.schema["blocks"].dataType.simpleString()
    left = items.select("id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("blocks", F.array().cast(blocks)).alias("blocks"))
    tried = None
    for number, budget in enumerate(budgets):
        path = f"{folder}/budget-{number}"
        if not _written(spark, path):
            if number and left.isEmpty():
                break
            round_of(left, reader, number, budget, template).write.mode("overwrite").parquet(path)
        made = spark.read.parquet(path)
        done = made.drop(*AGAIN)
        tried = done if tried is None else tried.unionByName(done)
        left = left_of(made)
    return tried


def final(tried: DataFrame) -> DataFrame:
    """One row per id: its clean attempt, else its last; with how many there were and whether any was clean."""
    chosen = questions.chosen_attempts(tried)
    return chosen.withColumn("attempts", F.col("budget") + 1).drop("budget", "retries")
