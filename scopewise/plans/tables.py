"""The tables the queries read, and how they stand for scopes, chunks, questions, patients and admissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCOPES = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table with fewer partitions than the cluster has cores, dealt out before heavy work per row.

    A table in many files is left as it is read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return spread(rows.select(*columns) if columns else rows)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, their source as the scope."""
    return documents(spark, sf_dir, "doc_id", "source", "text").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("scope"), F.col("text").alias("content"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, each of one scope."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % SCOPES).cast("string")).alias("scope"), "text")


def with_vectors(rows: DataFrame, spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """rows with the embedding of the vector of the same number, null where there is none."""
    return rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(key), "embedding"), key, "left")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, chunks) of the embeddings table: queries are the rows whose number is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("scope"), "embedding")
    return rows.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), rows


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as admissions of customers."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("admittime"),
        F.col("o_orderpriority").alias("admission_type"), F.col("o_orderstatus").alias("status"), "o_totalprice",
    )


def diagnoses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows, dictionary): line items as diagnoses in sequence, parts as the dictionary, which lacks one code in eleven in the version that is asked for."""
    title, part = F.concat_ws(" ", "p_name", "p_brand", "p_size"), F.col("l_partkey")
    code = F.concat(F.lit(" "), part.cast("string"), F.lit("  "))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hadm_id"), F.col("l_linenumber").alias("seq_num"), code.alias("icd_code"), (part % 2 + 9).cast("int").alias("icd_version"))
    version = F.when(F.col("p_partkey") % 11 == 0, 8).otherwise(F.col("p_partkey") % 2 + 9)
    return rows, table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("icd_code"), version.cast("int").alias("icd_version"), title.alias("long_title"))


def admission_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopewise.operators import cohort

    items = table(spark, sf_dir, "lineitem")
    rows, dictionary = diagnoses(spark, sf_dir)
    diagnosed = cohort.diagnoses(rows, dictionary, ["hadm_id"], ["icd_code", "icd_version"], "seq_num", "long_title")
    icu = items.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("hadm_id"))
    served = items.select(F.col("l_orderkey").alias("hadm_id"), F.col("l_suppkey").alias("service"), "l_shipdate", "l_linenumber")
    tie = F.struct("l_linenumber", "service")
    served = cohort.first_service(served.withColumn("tie", tie), ["hadm_id"], "service", "l_shipdate", "tie")
    return cohort.attributes(admissions(spark, sf_dir), ["hadm_id"], diagnosed, icu, served)
