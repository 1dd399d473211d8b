"""Exact dedup by distributed most-significant-digit radix partitioning.

Every text, stripped of white space, is the byte string ``length || bytes``. Its first digit is the length and
the first bytes; a group of documents that agree so far is split by the next bytes, and so on. Digits widen with
depth, so the number of rounds is logarithmic in the longest text. A group is left as soon as it has one member
(the text is unique) or has ended (all its members have spent their bytes: they are equal). Bytes are compared
as they are; no digest decides equality.

Counts are pre-aggregated before each shuffle, so a group that holds a third of all rows reaches the reducers as
one row for each map task; the joins that hand group numbers back are sort-merge joins at every size (the table
of shared digits grows with the corpus, so it is not broadcast), which AQE splits where they are skewed. Each round is staged in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopewise.llm.common import packed, stage, unpacked, unstage, without_white_space

FIRST_DIGIT = 64
WIDENING = 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical without ASCII white space; null counts as empty, and empty texts are equal to
    one another. The row with the most code points in the original text stays, then the smallest id (null ids
    last); of rows that repeat both id and length, one stays. An empty table gives an empty table. Columns of the
    input other than the two named are not read.
    """
    base = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.length(F.col(text_col)), F.lit(0)).alias("points"),
        without_white_space(F.col(text_col)).cast("binary").alias("rest"),
    ).withColumn("left", F.length("rest").cast("long"))

    def digit(width: int):
        return F.substring("rest", 1, width)

    def shared(rows: DataFrame, of: str, width: int) -> DataFrame:
        """The digits that more than one row of a group has, each with a number for the group it makes."""
        counts = rows.groupBy(of, digit(width).alias("digit")).count().where("count > 1")
        return stage(counts.select(of, "digit", F.monotonically_increasing_id().alias("group")), "radix-keys")

    keys = shared(base, "left", first_digit)
    # "group" is null for texts that are alone; only unfinished groups carry bytes on
    state = stage(
        base.withColumn("digit", digit(first_digit))
        .join(keys.hint("merge"), ["left", "digit"], "left")
        .select("id", "points", F.sha2("rest", 256).alias("sha"), "group", _beyond(first_digit), (F.col("left") - first_digit).alias("left")),
        "radix",
    )
    alone, ended, width, round_no = [state.where("group is null")], [_ended(state, 0)], first_digit, 0
    active = state.where("group is not null and left > 0")
    while not active.isEmpty():
        width, round_no = width * WIDENING, round_no + 1
        active = active.withColumnRenamed("group", "parent")
        keys = shared(active, "parent", width)
        state = stage(
            active.withColumn("digit", digit(width))
            .join(keys.hint("merge"), ["parent", "digit"], "left")
            .select("id", "points", "sha", "group", _beyond(width), (F.col("left") - width).alias("left")),
            "radix",
        )
        unstage(keys)
        alone.append(state.where("group is null"))
        ended.append(_ended(state, round_no))
        active = state.where("group is not null and left > 0")

    grouped = reduce(DataFrame.unionByName, ended)
    best = grouped.groupBy("round", "group").agg(
        F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id").alias("i"))).alias("best"),
        F.count("*").alias("group_size"),
    )
    twin = Window.partitionBy("round", "group", "id", "points").orderBy("sha")
    members = (
        grouped.withColumn("twin", F.row_number().over(twin))
        .join(best, ["round", "group"])
        .select(
            "id",
            F.col("best.i").alias("keep_id"),
            "group_size",
            (F.col("id").eqNullSafe(F.col("best.i")) & (F.col("points") == -F.col("best.p")) & (F.col("twin") == 1)).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
    single = reduce(DataFrame.unionByName, alone).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return single.unionByName(members).withColumnRenamed("id", id_col)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat id and text, one.

    Ids go as text, so that null ones can be joined and the join's partitioning serves the choice among repeats too.
    """
    key = {"none": F.col(id_col).isNull(), "key": F.coalesce(F.col(id_col).cast("string"), F.lit(""))}
    kept = exact_groups(docs, id_col, text_col).where("kept").select(*[c.alias(n) for n, c in key.items()], F.col("text_sha256").alias("own")).distinct()
    text = F.col(text_col)
    own = F.coalesce(F.sha2(without_white_space(text).cast("binary"), 256), F.lit(""))  # never null, so no filter has it made twice
    rows = packed(docs, **key, points=F.coalesce(F.length(text), F.lit(0)), own=own)
    found = rows.join(kept, ["none", "key", "own"], "left_semi")
    longest = Window.partitionBy("none", "key", "own").orderBy(F.desc("points"))
    return unpacked(found.withColumn("n", F.row_number().over(longest)).where("n = 1"), docs)


def _beyond(width: int):
    """The bytes after a digit, for groups that go on."""
    return F.when(F.col("group").isNotNull() & (F.col("left") > width), F.expr(f"substring(rest, {width + 1})")).alias("rest")


def _ended(state: DataFrame, round_no: int) -> DataFrame:
    return state.where("group is not null and left <= 0").select("id", "points", "sha", "group", F.lit(round_no).alias("round"))
