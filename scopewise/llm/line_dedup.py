"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines is a window, known by two 64-bit hashes of its text. A window that occurs
before, in an earlier document or higher up in the same one, is a repeat; the lines under repeats go, however
the repeats overlap. First occurrences stay.

DataFrame operations only. First occurrences are minima, combined before the shuffle; the join that finds the
repeats is an equi-join which AQE splits where one window is in a great part of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopewise.llm.common import held, packed, unpacked

WINDOW = 3


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the text replaced by what stays, and n_lines and n_removed added.

    Lines end at newline characters. Documents come in the order of their ids, nulls last, then of a hash of their
    texts; rows alike in id and text are one document and get the same result. Null texts have no lines and stay
    null; texts of fewer lines than a window stay whole. Blank lines count like any other. A
    repeat may overlap its own first occurrence: of one line over and over, one stays. Ids may be of any type that
    has an order. All other columns are kept as they are, but for columns of the input called n_lines or n_removed,
    which are replaced. An empty table gives an empty table.
    """
    lines = F.split("text", "\n", -1)
    place = {"none": F.col(id_col).isNull(), "id": F.col(id_col), "hash": F.xxhash64(text_col)}
    base = docs.select(*[c.alias(n) for n, c in place.items()], F.col(text_col).alias("text"))

    def hashed(i: Column) -> Column:
        text = F.concat_ws("\n", F.slice("lines", i, window))
        return F.struct(i.alias("at"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(window), text).alias("h2"))

    count = F.size("lines")
    windows = (
        base.where("text is not null")
        .withColumn("lines", lines)
        .where(count >= window)
        .select("none", "id", "hash", F.inline(F.transform(F.sequence(F.lit(1), count - window + 1), hashed)))
        .select("h1", "h2", F.struct("none", "id", "hash", "at").alias("place"))
    )
    first = windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = windows.join(first, ["h1", "h2"]).where(~F.col("place").eqNullSafe(F.col("first"))).select("place.*")
    starts = repeats.groupBy("none", "id", "hash").agg(F.sort_array(F.collect_set("at")).alias("starts"))
    starts = starts.select(F.col("id").alias("own"), F.col("hash").alias("own_hash"), "starts")

    rows = packed(docs, id=F.col(id_col), hash=place["hash"])
    found = rows.join(starts, F.col("id").eqNullSafe(F.col("own")) & (F.col("hash") == F.col("own_hash")), "left").withColumn("text", held(docs, text_col))
    found = found.withColumn("lines", F.when(F.col("starts").isNotNull(), lines))
    # what stays lies between one repeat's end and the next one's start
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("starts")),
        lambda i: F.struct(
            F.when(i == 0, F.lit(1)).otherwise(F.get("starts", i - 1) + window).alias("low"),
            F.coalesce(F.get("starts", i), count + 1).alias("high"),
        ),
    )
    kept = F.flatten(F.transform(F.filter(gaps, lambda g: g["high"] > g["low"]), lambda g: F.slice("lines", g["low"], g["high"] - g["low"])))
    found = found.withColumn("kept", F.when(F.col("starts").isNotNull(), kept))
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    made = {
        text_col: F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("text")),
        "n_lines": n_lines,
        "n_removed": F.when(F.col("kept").isNotNull(), count - F.size("kept")).otherwise(F.lit(0)),
    }
    return unpacked(found, docs, **made)
