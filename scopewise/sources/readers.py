"""Readers: hospital tables, notes, question sets, chunk stores, configurations and paged documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schemas of the source tables and files.
TABLES = {
    "patients": "subject_id bigint, gender string, anchor_age int, anchor_year int, anchor_year_group string",
    "admissions": "subject_id bigint, hadm_id bigint, admittime string, dischtime string, admission_type string, discharge_location string, insurance string, race string, hospital_expire_flag int",
    "diagnoses_icd": "subject_id bigint, hadm_id bigint, seq_num int, icd_code string, icd_version int",
    "d_icd_diagnoses": "icd_code string, icd_version int, long_title string",
    "icustays": "subject_id bigint, hadm_id bigint",
    "services": "subject_id bigint, hadm_id bigint, transfertime string, curr_service string",
}
NOTE = "note_id string, subject_id bigint, hadm_id bigint, note_type string, note_seq int, charttime string, text string"
DETAIL = "note_id string, field_name string, field_value string, field_ordinal double"
NOTE_TABLES = {"discharge": "Discharge summary", "radiology": "Radiology", "nursing": "Nursing", "physician": "Physician", "consult": "Consult"}
SINGLE_QA = "id string, patient_id string, document_name string, page_number int, ground_truth_context string, ground_truth_page_context string, question string, ground_truth_answer string, section string, question_type string"
MULTI_QA = "id string, comparison_type string, question string, reference_answer string, sources array<struct<patient_id:string,admission_id:string,source_pdf:string,source_chunk:string>>"
CHUNK = "id bigint, patientId string, documentType string, documentId string, content string, dateString string, timestamp bigint, embedding array<float>"
PRESET = "models map<string,struct<displayName:string,modelUrl:string,modelFilename:string,tokenizerUrl:string,tokenizerFilename:string,modelType:string>>"
MODEL_TYPES = ("GEMMA_3", "LLAMA_3", "LLAMA_GUARD_3", "LLAVA_1_5", "QWEN_3", "SMOLLM_3", "LFM2", "VOXTRAL", "PHI_4")


@dataclass(frozen=True)
class Paths:
    """Where a job reads and writes: a flag wins over the environment, that over the default."""

    values: dict[str, str]

    @classmethod
    def resolve(cls, flags: dict[str, str | None], environment: dict[str, str], defaults: dict[str, str]) -> Paths:
        return cls({k: flags.get(k) or environment.get(k.upper()) or v for k, v in defaults.items()})


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that is there: an outer folder before what is bundled."""
    return next((p for p in paths if exists(spark, p)), None)


def find_table(spark: SparkSession, folder: str, table: str) -> str | None:
    """The table's file: compressed before plain, null if there is neither."""
    return first_existing(spark, [f"{folder}/{table}.csv.gz", f"{folder}/{table}.csv"])


def require_table(spark: SparkSession, folder: str, table: str) -> str:
    path = find_table(spark, folder, table)
    if path is None:
        raise FileNotFoundError(f"no {table}.csv.gz or {table}.csv in {folder}")
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of a schema, by name, from a CSV file with a header and quoted newlines; missing columns are null."""
    fields = T._parse_datatype_string(schema).fields
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    have, cores = set(rows.columns), spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # a file with quoted newlines is read by one task; what follows needn't be
        rows = rows.repartition(cores)
    return rows.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return read_csv(spark, require_table(spark, folder, table), TABLES[table])


def note_tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """The note tables that are there, by name; discharge must be."""
    found = {t: find_table(spark, folder, t) for t in NOTE_TABLES}
    found["discharge"] = require_table(spark, folder, "discharge")
    return {t: p for t, p in found.items() if p}


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of all tables with their category; those without admission or text are left out."""
    out = None
    for table, path in note_tables(spark, folder).items():
        rows = read_csv(spark, path, NOTE).where("hadm_id IS NOT NULL AND text IS NOT NULL").withColumn("category", F.lit(NOTE_TABLES[table]))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_details(spark: SparkSession, folder: str, table: str, notes: DataFrame) -> DataFrame:
    """Details of the given notes; the ordinal may be missing, a missing table is empty."""
    path = find_table(spark, folder, f"{table}_detail")
    rows = read_csv(spark, path, DETAIL) if path else spark.createDataFrame([], DETAIL)
    return rows.join(notes.select("note_id").distinct(), "note_id", "left_semi")


def numbered_lines(spark: SparkSession, path: str, start: int = 0, most: int | None = None) -> DataFrame:
    """(value, at): lines that are not blank, numbered from 0 in the order of file names and lines, from a number on and so many at most.

    Lines are counted by block of a file first; a running sum over the blocks says which of them hold the lines asked for,
    and only those are numbered, each for itself. An empty or missing selection has no rows.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"))
    lines = lines.where(F.trim("value") != "")
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    # one narrow row for each block of a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = counts.withColumn("before", before).where(F.col("before") + F.col("n") > start)
    if most is not None:
        wanted = wanted.where(F.col("before") < start + most)
    at = F.col("before") + F.row_number().over(Window.partitionBy("file", "block").orderBy("_id")) - 1
    rows = lines.join(wanted.select("file", "block", "before"), ["file", "block"]).select("value", at.alias("at")).where(F.col("at") >= start)
    return rows if most is None else rows.where(F.col("at") < start + most)


def read_questions(spark: SparkSession, path: str, multi: bool = False, start: int = 0, most: int | None = None) -> DataFrame:
    """A JSONL question set in the order of its files and lines, from an item on and so many at most; blank lines are skipped."""
    lines = numbered_lines(spark, path, start, most)
    return lines.select("at", F.from_json("value", MULTI_QA if multi else SINGLE_QA).alias("r")).orderBy("at").select("r.*")


def question_sources(questions: DataFrame) -> DataFrame:
    """One row per source of a multi-record item."""
    return questions.select(F.col("id").alias("item"), "comparison_type", F.posexplode("sources").alias("source_pos", "s")).select("item", "comparison_type", "source_pos", "s.*")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk store kept as a JSON array; missing texts are empty and a missing time is 0."""
    rows = spark.read.schema(CHUNK).json(path, multiLine=True)
    return rows.fillna("", ["patientId", "documentType", "documentId", "content", "dateString"]).fillna(0, ["timestamp"])


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    """One row per admission of a patients file: a JSON list, or an object with one under ``patients``."""
    rows = spark.read.json(path, multiLine=True)
    if "patients" in rows.columns:
        rows = rows.select(F.explode("patients").alias("p")).select("p.*")
    return rows.select(F.col("patient_info.subject_id").cast("string").alias("patient_id"), F.explode("admissions").alias("admission"))


def document_files(spark: SparkSession, folder: str, patient: str | None = None) -> DataFrame:
    """(path, name, patient_id, admission_id) of a folder's documents, or those of a patient."""
    rows = spark.read.format("binaryFile").load(folder).select("path", F.substring_index("path", "/", -1).alias("name"))
    part = lambda k: F.regexp_extract("name", r"Patient_(.*?)_Admission_(\d+)", k)
    rows = rows.select("path", "name", part(1).alias("patient_id"), part(2).alias("admission_id"))
    return rows if patient is None else rows.where(F.col("name").startswith(f"Patient_{patient}_"))


def item_documents(items: DataFrame, files: DataFrame) -> DataFrame:
    """(item, patient_id, name): every document of an item's patient, or the item's own where none is listed."""
    listed = items.join(files.select("patient_id", "name"), "patient_id", "left")
    return listed.select("item", "patient_id", F.coalesce("name", "document_name").alias("name"))


def with_fallback_text(pages: DataFrame, layer: str, scanned: str) -> DataFrame:
    """pages with text: the text layer, or the recognised scan where the layer is blank."""
    return pages.withColumn("text", F.coalesce(F.when(F.trim(layer) != "", F.col(layer)), F.col(scanned)))


def parse_presets(configs: DataFrame, column: str) -> DataFrame:
    """(key, display_name, model_url, model_file, tokenizer_url, tokenizer_file, model_type) of valid entries.

    Entries without display name, model address or file are skipped; an unknown type is LLAMA_3.
    """
    rows = configs.select(F.explode(F.from_json(column, PRESET)["models"]).alias("key", "m")).where("m.displayName IS NOT NULL AND m.modelUrl IS NOT NULL AND m.modelFilename IS NOT NULL")
    kind = F.upper("m.modelType")
    return rows.select(
        "key", F.col("m.displayName").alias("display_name"), F.col("m.modelUrl").alias("model_url"), F.col("m.modelFilename").alias("model_file"),
        F.coalesce("m.tokenizerUrl", F.lit("")).alias("tokenizer_url"), F.coalesce("m.tokenizerFilename", F.lit("")).alias("tokenizer_file"),
        F.when(kind.isin(*MODEL_TYPES), kind).otherwise(F.lit("LLAMA_3")).alias("model_type"),
    )


def read_saved(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The list of records that a JSON object of settings holds as text under a key: saved messages or logs; none if it has none."""
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>")[key].alias("v"))
    return held.select(F.explode(F.from_json("v", f"array<struct<{schema}>>")).alias("r")).select("r.*")
