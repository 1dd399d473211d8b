"""Vector functions as Column expressions over array<float>, and the deterministic hash embedder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopewise.functions.text import stripped


def dot(a: Column, b: Column) -> Column:
    """Single-precision products summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for null vectors, vectors of other lengths and zero vectors."""
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / size)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def score_of_distance(distance: Column) -> Column:
    return F.lit(100.0) / (F.lit(1.0) + distance)


def score_of_cosine_distance(distance: Column) -> Column:
    """Percent for a cosine distance of 0 to 2."""
    return (F.lit(1.0) - distance / 2) * 100


def fingerprint(a: Column, shown: int = 3) -> Column:
    """dim, norm and the first components, as text."""
    sample = F.array_join(F.transform(F.slice(a, 1, shown), lambda x: F.format_string("%.4f", x.cast("double"))), ",")
    return F.format_string("dim=%d l2norm=%.4f sample=[%s]", F.size(a), norm(a), sample)


def java_hash(text: Column) -> Column:
    """The 32-bit polynomial hash of a string of characters below U+10000, times 31 and on."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda s, c: (s * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def hash_embedding(rows: DataFrame, id_col: str, text_col: str, dims: int = 384) -> DataFrame:
    """(id, k, v): the non-zero components of each text's hash embedding.

    Words are split at non-word characters and longer than two; each adds its hash's sign at the place its absolute
    value names; the sum is brought to length one. Sparse, so it is one shuffle and no wide array.
    """
    words = F.filter(F.split(F.lower(stripped(F.coalesce(F.col(text_col), F.lit("")))), "[^a-zA-Z0-9_]+"), lambda w: F.length(w) > 2)
    hashed = rows.select(F.col(id_col), F.explode(words).alias("w")).groupBy(id_col, "w").agg(F.count("*").alias("n")).withColumn("h", java_hash(F.col("w")))
    sums = hashed.groupBy(id_col, (F.abs("h") % dims).cast("int").alias("k")).agg(F.sum(F.when(F.col("h") >= 0, F.col("n")).otherwise(-F.col("n"))).alias("s")).where("s <> 0")
    length = sums.groupBy(id_col).agg(F.sqrt(F.sum(F.col("s") * F.col("s")).cast("double")).alias("l"))
    return sums.join(length, id_col).select(id_col, "k", (F.col("s") / F.col("l")).alias("v"))
