"""What the corpus operators share: the shared folder, staged tables, null-safe keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that word and normalisation rules name.
WHITE_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: A word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys of over 1 / SHARE of all rows are hot; each is dealt over SALTS groups.
SHARE, SALTS = 1000, 64
#: Paths of staged tables.
_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir, or one of our own where it is unset and Spark runs in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="scopewise-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/stage-" in path:
            _delete(df.sparkSession, path)


def drop_stages(spark: SparkSession) -> None:
    """Delete all tables that this process staged, once the results that read them are written."""
    while _STAGED:
        _delete(spark, _STAGED.pop())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The input's columns under numbers, beside those an operator works on: no name can clash with an input's.

    unpacked() gives the rows back; columns that nothing asks for are still pruned.
    """
    return docs.select(*[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(docs.columns)], *[c.alias(name) for name, c in columns.items()])


def held(docs: DataFrame, column: str) -> Column:
    """A column of the input among packed ones."""
    return F.col(f"in{docs.columns.index(column)}")


def unpacked(rows: DataFrame, docs: DataFrame, **made: Column) -> DataFrame:
    """The input's columns under their names; those given are replaced, or added at the end."""
    kept = [(made[c] if c in made else F.col(f"in{i}")).alias(c) for i, c in enumerate(docs.columns)]
    return rows.select(*kept, *[c.alias(n) for n, c in made.items() if n not in docs.columns])


def spread_join(rows: DataFrame, counts: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Inner join of rows with counts(key, n, ...), where n is how many rows have the key; n is dropped.

    Keys that more than 1 / SHARE of the rows have are hot: SHARE of them at most, so they are broadcast. Their rows
    are dealt by a hash of the columns ``by`` over SALTS copies of the key's row; all other keys meet as they are.
    counts is read three times, so it should be staged.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * SHARE > total
    marked = rows.join(F.broadcast(counts.where(hot).select(key, F.lit(True).alias("_hot"))), key, "left")
    salted = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    dealt = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt")
    return salted.join(counts.select(dealt, *counts.columns).drop("n"), [key, "_salt"]).drop("_salt")


def without_white_space(text: Column) -> Column:
    """The text without its ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    """The number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
