"""Mixing sources to target weights, by hash-random order and distributed prefix sums.

Documents get a hash-random key. Within its source a document's place is its key's; the leading digits of the key
name a range, so that a source of any size is sorted range by range, and the sum of the sizes before a document
is the sum over earlier ranges (a small table) plus the sum within its range. Whole epochs of a source are taken
first, then documents in key order up to the exact word that meets the source's budget.

DataFrame operations only. Sums by source and by range are combined before the shuffle; no window spans a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopewise.llm.common import WORD, packed, stage, unpacked, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix"
#: Hex digits of the key that name a range: 4096 ranges for each source.
RANGE_DIGITS = 3
SOURCE = ["no_source", "source"]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes(no_source, source, source_size), one row per source -> with target.

    Sources in code point order, null last, weigh ``weights``, repeating. They share ``share`` of all words by
    weight; no target is over ``most`` times its source's size, and what a capped source can't take is shared by
    weight among the others until none is above its cap. That end point is a common level: a target is the lower
    of the cap and weight x level. Sorted by cap / weight, a source is capped if its ratio is within the level
    that the sources from it on would have.
    """
    by_name = Window.orderBy("no_source", "source")  # one row per source, not per document
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    left_words = F.col("all_size") * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    return (
        sizes.withColumn("weight", w)
        .withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", left_words / left_weight)
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
        .select("no_source", "source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))
    )


def _key(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, shares: dict) -> tuple[DataFrame, DataFrame]:
    """(one row per document: id, no_source, source, size, key, range; one row per source and range: offset, source_size, target, epochs, rest), both staged.

    epochs is how often a source is taken whole, rest the words that its last, partial epoch takes.
    """
    sized = stage(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).isNull().alias("no_source"),
            F.coalesce(F.col(source_col), F.lit("")).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            _key(id_col, seed).alias("key"),
        ).withColumn("range", F.substring("key", 1, RANGE_DIGITS)),
        "sized",
    )
    ranges = sized.groupBy(*SOURCE, "range").agg(F.sum("size").alias("range_size"))
    wanted = targets(ranges.groupBy(*SOURCE).agg(F.sum("range_size").alias("source_size")), **shares)
    earlier = Window.partitionBy(*SOURCE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).join(wanted, SOURCE)
    return sized, stage(offsets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "ranges")


def _started(sized: DataFrame, offsets: DataFrame) -> DataFrame:
    """sized with offsets' columns and start: the words of the source before each document."""
    within = Window.partitionBy(*SOURCE, "range").orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(offsets, [*SOURCE, "range"]).withColumn("start", F.col("offset") + F.col("within"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **shares) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words, repeats counted).

    A null source is a source, after all others. Null and empty texts have size 0 and nothing is taken of them.
    Rows that repeat an id follow one another by size; rows alike in both are interchangeable. The words taken of
    a source are its target, rounded down. Other columns are not read; an empty table gives an empty table.
    """
    partly = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start")))
    taken = (F.col("epochs") * F.col("size") + partly).cast("long").alias("taken")
    return _started(*_plan(docs, id_col, text_col, source_col, seed, shares)).select(F.col("id").alias(id_col), "size", "source_size", "target", taken)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **shares) -> DataFrame:
    """docs with each row as often as the mix takes it, with all its columns.

    The document at a source's cut, of which the mix takes a part, comes whole, and so do rows that share its id.
    Only the range that holds a source's cut is put in order: a row comes once more than the source's epochs if its
    key is not beyond the cut's. So texts are not shuffled; they meet one row per source.
    """
    sized, offsets = _plan(docs, id_col, text_col, source_col, seed, shares)
    cuts = offsets.where("offset < rest AND rest <= offset + range_size")
    last = _started(sized, cuts).where("start < rest AND size > 0").groupBy(*SOURCE).agg(F.max("key").alias("last"))
    plan = stage(offsets.select(*SOURCE, "epochs").distinct().join(last, SOURCE, "left").select(F.col("no_source").alias("none"), F.col("source").alias("name"), "epochs", "last"), "cuts")
    words = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    rows = packed(docs, no_source=F.col(source_col).isNull(), source=F.coalesce(F.col(source_col), F.lit("")), key=_key(id_col, seed), words=words)
    often = F.col("epochs") + F.when(F.col("key") <= F.col("last"), 1).otherwise(0)
    rows = rows.where("words").join(plan, (F.col("no_source") == F.col("none")) & (F.col("source") == F.col("name"))).withColumn("often", often.cast("int")).where("often > 0")
    return unpacked(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("often")))), docs)
