"""Queries over the question operators, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopewise.functions import labels as L
from scopewise.functions.chunker import chunked, with_chunks
from scopewise.functions.sections import sections
from scopewise.operators import candidates, cohort, context, generation, pages, questions
from scopewise.plans.cohort import _DIAGNOSED, _windows
from scopewise.plans.documents import _BLANKS, _CHUNKS, _ONE, _STRIP
from scopewise.plans.tables import admission_attributes, documents, table
from scopewise.sources import readers, sinks
from scopewise.sources.staging import new_folder, staged

COLUMNS = ["hadm_id", "service", "num_diagnoses", "admittime"]


def _admissions(spark: SparkSession, d: str, dealt: bool = True) -> DataFrame:
    """Orders as admissions with every attribute a record's head shows, dealt by patient unless what follows shuffles them anyway."""
    rows, own = admission_attributes(spark, d).where("subject_id IS NOT NULL"), Window.partitionBy("subject_id")
    rows = cohort.dealt(rows, "subject_id") if dealt else rows
    rows = rows.withColumns({"_a": F.min("diagnosis").over(own), "_b": F.max("diagnosis").over(own)})
    return rows.select(
        F.col("subject_id").alias("patient_id"), F.col("hadm_id").alias("admission_id"), "admittime", F.col("admittime").alias("dischtime"), "diagnosis", L.admission_type(F.col("admission_type")).alias("admission_type"),
        F.when(F.col("subject_id") % 2 == 0, "F").otherwise("M").alias("sex"), (F.col("subject_id") % 90).cast("int").alias("age"), (F.col("hadm_id") % 9).cast("int").alias("stay_days"), F.concat(F.lit("Team "), F.col("service").cast("string")).alias("service"),
        F.when(F.col("status") == "P", "Not recorded").otherwise("Home").alias("disposition"), F.col("had_icu_stay").alias("icu"), "num_diagnoses", F.coalesce(F.col("_a") != F.col("_b"), F.lit(False)).alias("other_diagnosis"),
    )


def admission_documents(spark: SparkSession, d: str) -> DataFrame:
    """The head of each admission's document."""
    return _heads_of(_admissions(spark, d))


def _head() -> Column:
    """The head of an admission's document."""
    parts = dict(patient="patient_id", sex="sex", age="age", admission="admission_id", type="admission_type", service="service", admitted="admittime", discharged="dischtime", stay="stay_days", diagnosis="diagnosis", disposition="disposition", icu="icu", num_diagnoses="num_diagnoses")
    columns = {k: F.col(v) for k, v in parts.items()} | {"died": F.lit(False), "inventory": F.lit("Discharge summary (1)")}
    return sinks.header_lines(columns)


def _heads_of(rows: DataFrame) -> DataFrame:
    return rows.select("patient_id", "admission_id", _head().alias("text"))


def header_questions(spark: SparkSession, d: str) -> DataFrame:
    return questions.header_candidates(_admissions(spark, d))


def section_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions on documents read as notes."""
    note = F.concat(F.lit("Allergies: NKDA.\nHistory of Present Illness: History obtained from chart. "), F.replace("text", F.lit(":"), F.lit(";")), F.lit("\nBrief Hospital Course:\n"), F.replace("text", F.lit(":"), F.lit(";")))
    rows = table(spark, d, "documents").select(F.col("source").alias("patient_id"), F.col("doc_id").alias("admission_id"), F.lit("2100-01-02 03:04:05").alias("admittime"), F.lit("Discharge summary").alias("category"), note.alias("note"), F.lit(1).alias("pos"))
    found = sections(rows, ["patient_id", "admission_id", "admittime"], "category", "note", ["pos"])
    return questions.section_candidates(found)


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame | None]:
    """(items of admissions with a document for themselves, items of those that share one, if any do: rows that repeat, or lack a number)."""
    same = Window.partitionBy("patient_id", "admission_id")  # admissions are dealt by patient
    rows = staged(_admissions(spark, d).withColumn("_n", F.count("*").over(same)), "admissions")
    one, more = rows.where("_n = 1").drop("_n"), rows.where("_n > 1").drop("_n")
    own = questions.own_items(with_chunks(questions.with_document(one).withColumn("text", _head()), "text"))
    if more.isEmpty():
        return own, None
    docs = questions.with_document(_heads_of(more))
    ranges = pages.paged(docs.select("doc", F.lit(1).alias("page"), "text"), "doc", "page", "text")
    asked = questions.with_document(questions.header_candidates(more))
    return own, questions.grounded_items(asked, ranges, chunked(docs.select("doc", "text"), "doc", "text"))


def question_items(spark: SparkSession, d: str) -> DataFrame:
    own, shared = _items(spark, d)
    shown = ["id", "doc", "kind", "subkey", "page", F.length("gold").alias("gold_length")]
    return own.select(*shown) if shared is None else own.select(*shown).unionByName(shared.select(*shown))


def question_stats(spark: SparkSession, d: str) -> DataFrame:
    return questions.question_stats(header_questions(spark, d).withColumn("page", F.lit(1)))


def kind_availability(spark: SparkSession, d: str) -> DataFrame:
    return questions.kind_availability(questions.with_document(header_questions(spark, d)))


def single_violations(spark: SparkSession, d: str) -> DataFrame:
    own, shared = _items(spark, d)
    rows = questions.own_violations(own)
    rows = rows if shared is None else rows.unionByName(questions.single_violations(shared))
    return rows.groupBy("rule").agg(F.count("*").alias("n"))


def pair_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates.windows(admission_attributes(spark, d), "subject_id", ["admittime", "hadm_id"], 2, COLUMNS, candidates.MOST_PAIRS)
    dated = rows.select("hadm_id_1", "hadm_id_2", F.col("num_diagnoses_1").alias("value_1"), F.col("num_diagnoses_2").alias("value_2"), *[F.substring_index(f"admittime_{k}", " ", 1).alias(f"date_{k}") for k in (1, 2)])
    dated = dated.withColumn("relation", candidates.relation(F.col("value_1"), F.col("value_2")))
    return questions.pair_wording(dated, "num_diagnoses").select("hadm_id_1", "hadm_id_2", "question", "answer", "evidence_1", "evidence_2")


def trajectory_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates.windows(admission_attributes(spark, d), "subject_id", ["admittime", "hadm_id"], 3, COLUMNS, candidates.MOST_TRAJECTORIES)
    dated = rows.select("hadm_id_1", *[F.col(f"service_{k}").alias(f"value_{k}") for k in (1, 2, 3)], *[F.substring_index(f"admittime_{k}", " ", 1).alias(f"date_{k}") for k in (1, 2, 3)])
    return questions.trajectory_wording(dated.where("value_1 IS NOT NULL AND value_2 IS NOT NULL AND value_3 IS NOT NULL"), "service").select("hadm_id_1", "question", "answer")


def multi_violations(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of orders as items; every fifth has its patient twice in a cross-patient item."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    source = lambda p, a: F.struct(p.cast("string").alias("patient_id"), a.cast("string").alias("admission_id"))
    other = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1)
    items = rows.select(F.col("o_orderkey").alias("id"), F.lit("cross_patient_two_admissions").alias("comparison_type"), F.lit("What was my service?").alias("question"), F.array(source(F.col("o_custkey"), F.col("o_orderkey")), source(other, F.col("o_orderkey") + 1)).alias("sources"))
    return questions.multi_violations(items)


def generator_conditions(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("item_id").alias("doc"), F.lit("What is said?").alias("question"), F.col("text").alias("gold"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    rows = questions.conditions(items, docs)
    return rows.select("id", "condition", "skipped", F.length("prompt").alias("length"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


def generation_attempts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    stats = F.concat(F.lit('{"prompt_tokens": '), F.length("text").cast("string"), F.lit(', "generated_tokens": '), (F.col("conv_id") * 10).cast("string"), F.lit("}"))
    raw = F.concat(F.lit(" "), F.col("text"), F.lit("<|im_end|>tail"))
    return questions.attempts(rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), raw.alias("raw"), stats.alias("stats"), F.lit("").alias("error"))).drop("error")


def stand_in(parts):
    """A reader that fails by rule: an item's number modulo 5 is how many of its attempts come to nothing, each in another way."""
    for part in parts:
        rows = []
        for i, reserve in zip(part["id"], part["reserve"], strict=True):
            number = [b[0] for b in context.BUDGETS].index(reserve)
            bad = number < i % 5
            stats = json.dumps({"prompt_tokens": 100, "generated_tokens": 2000 if bad and number == 2 else 20})
            raw = "" if bad and number in (0, 3) else f" answer {i} of {number}<|im_end|> and more"
            rows.append((i, raw, stats, "timeout" if bad and number == 1 else None))
        yield pd.DataFrame(rows, columns=["id", "raw", "stats", "error"])


def generation_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an item, whose number is the question and whose text is the evidence; a reader that fails by rule."""
    block = F.concat(F.lit("[Notes]: "), F.coalesce("text", F.lit("")))
    blocks = F.array(F.struct(F.lit(1).alias("rank"), F.lit(0).alias("scope_pos"), block.alias("block")))
    items = documents(spark, d, "doc_id", "text").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("question"), blocks.alias("blocks"))
    return generation.final(generation.rounds(items, stand_in)).select("id", "attempts", "answer", "generated_tokens", "truncated", "error", "clean")


def question_file_slice(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as a question set of several files in order, from the hundredth item on: half of them."""
    rows = documents(spark, d, "doc_id", "source", "text").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("patient_id"), F.col("text").alias("question"), "doc_id")
    path = new_folder(spark, "questions")
    sinks.write_json(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumnRenamed("doc_id", "_doc_id"), path)
    return readers.read_questions(spark, path, start=100, most=rows.count() // 2).select("id", "patient_id", F.length("question").alias("length"))


QUERIES = {
    f.__name__: f
    for f in (
        admission_documents, header_questions, section_questions, question_items, question_stats, kind_availability, single_violations, pair_questions, trajectory_questions, multi_violations,
        generator_conditions, generation_attempts, generation_rounds, question_file_slice,
    )
}

_HEADS = rf"""{_DIAGNOSED},
    o AS (SELECT subject_id, min(diagnosis) AS a, max(diagnosis) AS b FROM att GROUP BY subject_id),
    full_ AS (SELECT subject_id AS patient_id, hadm_id AS admission_id, split_part(admittime, ' ', 1) AS day, diagnosis,
                     CASE admission_type WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' WHEN '3-MEDIUM' THEN '3-Medium' WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' ELSE '5-Low' END AS admission_type,
                     CASE WHEN subject_id % 2 = 0 THEN 'F' ELSE 'M' END AS sex, CAST(subject_id % 90 AS VARCHAR) AS age, CAST(hadm_id % 9 AS VARCHAR) AS stay, 'Team ' || CAST(service AS VARCHAR) AS service,
                     CASE WHEN status = 'P' THEN 'Not recorded' ELSE 'Home' END AS disposition, CASE WHEN had_icu_stay THEN 'Yes' ELSE 'No' END AS icu, CAST(num_diagnoses AS VARCHAR) AS num_diagnoses, coalesce(a <> b, FALSE) AS other
              FROM att JOIN o USING (subject_id)),
    asked AS (SELECT *, 'my admission beginning on ' || day AS stay_name FROM full_),
    heads AS ({{union}})"""
_ANSWERS = {
    "diagnosis": "CASE WHEN NOT other THEN diagnosis END", "admission_type": "admission_type", "sex": "sex", "admission_date": "day", "age": "age", "los": "stay || ' days'", "service": "service",
    "disposition": "CASE WHEN disposition = 'Home' THEN disposition END", "icu": "icu", "num_diagnoses": "num_diagnoses", "diagnosis_disambiguation": "CASE WHEN other THEN diagnosis END",
}


def _asked(key: str) -> str:
    kind, question, label = questions.HEADER[key]
    question = question.replace("{stay}", "' || stay_name || '").replace("{end}", "' || day || '")
    return f"SELECT patient_id, admission_id, '{kind}' AS kind, '{key}' AS subkey, 'header' AS section, '{question}' AS question, {_ANSWERS[key]} AS answer, '{label}: ' || {_ANSWERS[key]} AS evidence FROM asked WHERE {_ANSWERS[key]} IS NOT NULL"


_HEADS = _HEADS.format(union=" UNION ALL ".join(map(_asked, questions.HEADER)))
_HEAD_TEXT = """
    doc AS (SELECT 'Patient_' || patient_id || '_Admission_' || admission_id || '.pdf' AS doc_id, patient_id, admission_id,
               'Patient ID: ' || patient_id || '  Sex: ' || sex || '  Age at Admission: ' || age || chr(10)
               || 'Admission ID: ' || admission_id || '  Type: ' || admission_type || '  Hospital Service: ' || coalesce(service, 'Not recorded') || chr(10)
               || 'Admission Date: ' || day || '  Discharge Date: ' || day || '  Length of Stay: ' || stay || ' days' || chr(10)
               || 'Principal Diagnosis: ' || coalesce(diagnosis, 'Not recorded') || chr(10) || 'Discharge Disposition: ' || disposition || chr(10)
               || 'ICU Stay: ' || icu || '  In-Hospital Mortality: No  Number of Diagnoses: ' || num_diagnoses || chr(10) || 'Clinical Notes Included: Discharge summary (1)' AS text
            FROM asked)"""
_HEAD_CLEAN = f"SELECT doc_id, {_STRIP.format(_BLANKS.format('text'))} AS c FROM doc"
_HEAD_CHUNKS = _CHUNKS.format(source=_HEAD_CLEAN).replace("RECURSIVE", f"RECURSIVE {_HEADS}, {_HEAD_TEXT},", 1)
_PAIR = _windows(2, 4, "hadm_id_1, hadm_id_2, num_diagnoses_1 AS a, num_diagnoses_2 AS b")



def _prompt(system: str, notes: str) -> str:
    system = system.replace("'", "''")
    return f"'<|im_start|>system' || chr(10) || '{system}' || chr(10) || chr(10) || '/no_think<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {notes} || 'QUESTION: What is said?<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"


_NOTES = "'CLINICAL NOTES:' || chr(10) || '- ' || {0} || chr(10) || chr(10)"
#: Items with their gold chunks.
_ITEMS = rf"""WITH {_HEAD_CHUNKS},
        ch AS (SELECT doc_id, content, s + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS cs FROM cut WHERE content <> ''),
        h AS (SELECT heads.*, doc_id, c FROM heads JOIN doc USING (patient_id, admission_id) JOIN cleaned USING (doc_id)),
        fit AS (SELECT h.doc_id, h.evidence, content, least(cs + length(content), length(c)) - cs AS shared, cs
                FROM (SELECT DISTINCT doc_id, evidence, c FROM h) h JOIN ch USING (doc_id)
                WHERE least(cs + length(content), length(c)) > cs AND contains(lower({_ONE.format('content')}), lower({_ONE.format('evidence')})) AND contains(lower({_ONE.format('c')}), lower({_ONE.format('substr(evidence, 1, 300)')}))),
        best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, evidence ORDER BY shared DESC, length(content), cs) AS n FROM fit),
        items AS (SELECT 'P' || patient_id || '_H' || admission_id || '_Q' || row_number() OVER (PARTITION BY h.doc_id ORDER BY kind, subkey) AS id, h.doc_id AS doc, kind, subkey, patient_id, question, h.evidence, content AS gold
                  FROM h JOIN best ON best.doc_id = h.doc_id AND best.evidence = h.evidence AND n = 1)"""

ORACLE_SQL = {
    "admission_documents": f"WITH {_HEADS}, {_HEAD_TEXT} SELECT patient_id, admission_id, text FROM doc",
    "question_items": f"{_ITEMS} SELECT id, doc, kind, subkey, 1 AS page, CAST(length(gold) AS INTEGER) AS gold_length FROM items",
    "single_violations": rf"""{_ITEMS},
        broken AS (
            SELECT unnest([CASE WHEN NOT regexp_matches(coalesce(question, ''), '\b(?:I|me|my|mine|myself)\b') THEN 'not first person' END,
                           CASE WHEN regexp_matches(coalesce(question, ''), '[0-9]{{5,}}') THEN 'number in question' END,
                           CASE WHEN contains(question, CAST(patient_id AS VARCHAR)) AND length(CAST(patient_id AS VARCHAR)) > 4 THEN 'patient in question' END,
                           CASE WHEN trim(coalesce(gold, '')) = '' THEN 'no gold chunk' END, CASE WHEN length(gold) > 500 THEN 'gold chunk too long' END,
                           CASE WHEN NOT contains(lower({_ONE.format('gold')}), lower({_ONE.format('evidence')})) OR {_ONE.format('evidence')} = '' THEN 'evidence not in gold' END]) AS rule FROM items
            UNION ALL SELECT 'id repeats' FROM items GROUP BY id HAVING count(*) > 1
            UNION ALL SELECT 'items per document' FROM items GROUP BY doc HAVING count(*) <> 2 OR count(DISTINCT kind) <> 2)
        SELECT rule, count(*) AS n FROM broken WHERE rule IS NOT NULL GROUP BY rule""",
    "header_questions": f"WITH {_HEADS} SELECT * FROM heads",
    "question_stats": f"""WITH {_HEADS},
        s AS (SELECT unnest(['kind', 'polarity', 'page', 'section', 'subkey', 'short']) AS stat,
                     unnest([kind, CASE WHEN lower(answer) IN ('yes', 'no') THEN answer END, '1', section, kind || '/' || subkey, CASE WHEN length(answer) < 4 THEN 'short' END]) AS value FROM heads)
        SELECT stat, value, count(*) AS n FROM s WHERE value IS NOT NULL GROUP BY ALL""",
    "kind_availability": f"WITH {_HEADS}, k AS (SELECT patient_id, admission_id, count(DISTINCT kind) AS kinds FROM heads GROUP BY ALL) SELECT kinds, count(*) AS documents FROM k GROUP BY kinds",
    "pair_questions": f"""
        WITH p AS ({_PAIR}), dated AS (SELECT p.*, strftime(x.o_orderdate, '%Y-%m-%d') AS d1, strftime(y.o_orderdate, '%Y-%m-%d') AS d2 FROM p JOIN orders x ON x.o_orderkey = hadm_id_1 JOIN orders y ON y.o_orderkey = hadm_id_2)
        SELECT hadm_id_1, hadm_id_2, 'During my hospitalizations beginning on ' || d1 || ' and ' || d2 || ', what was my number of recorded diagnoses in each, and was it the same or different?' AS question,
               'My hospitalization beginning ' || d1 || ': Number of Diagnoses: ' || a || '; my hospitalization beginning ' || d2 || ': Number of Diagnoses: ' || b || '. '
               || CASE WHEN a = b THEN 'The number of my recorded diagnoses remained unchanged.' ELSE 'The number of my recorded diagnoses ' || CASE WHEN b > a THEN 'increased' ELSE 'decreased' END || ' from ' || a || ' to ' || b || '.' END AS answer,
               'Number of Diagnoses: ' || a AS evidence_1, 'Number of Diagnoses: ' || b AS evidence_2
        FROM dated""",
    "trajectory_questions": f"""
        WITH p AS ({_windows(3, 2, "hadm_id_1, hadm_id_2, hadm_id_3, service_1 AS a, service_2 AS b, service_3 AS c")}),
        t AS (SELECT p.*, strftime(x.o_orderdate, '%Y-%m-%d') AS d1, strftime(y.o_orderdate, '%Y-%m-%d') AS d2, strftime(z.o_orderdate, '%Y-%m-%d') AS d3
              FROM p JOIN orders x ON x.o_orderkey = hadm_id_1 JOIN orders y ON y.o_orderkey = hadm_id_2 JOIN orders z ON z.o_orderkey = hadm_id_3 WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)
        SELECT hadm_id_1, 'Across my hospitalizations beginning on ' || d1 || ', ' || d2 || ', and ' || d3 || ', what was my hospital service at each hospitalization, and did it remain consistent or vary across the three?' AS question,
               'My hospitalization beginning ' || d1 || ': Hospital Service: ' || a || '; my hospitalization beginning ' || d2 || ': Hospital Service: ' || b || '; my hospitalization beginning ' || d3 || ': Hospital Service: ' || c || '. '
               || CASE WHEN a = b AND b = c THEN 'My hospital service remained consistent across all three hospitalizations.' ELSE 'My hospital service varied across the three hospitalizations.' END AS answer
        FROM t""",
    "multi_violations": "SELECT o_orderkey AS id, 'sources' AS rule FROM orders WHERE o_orderkey % 5 = 0",
    "generator_conditions": f"""
        WITH p AS (SELECT item_id AS id, unnest(['closed_book', 'oracle_evidence', 'full_context']) AS condition,
                          unnest([{_prompt(questions.CLOSED_BOOK, "''")}, {_prompt(questions.SYSTEM, _NOTES.format('b.text'))}, {_prompt(questions.SYSTEM, _NOTES.format('substr(d.text, 1, 3000)'))}]) AS prompt
                   FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id)
        SELECT id, condition, prompt IS NULL AS skipped, CAST(length(prompt) AS INTEGER) AS length, md5(prompt) AS prompt_md5 FROM p""",
    "generation_attempts": r"""
        SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS answer, TRUE AS stopped, length(text) AS prompt_tokens,
               conv_id * 10 AS generated_tokens, length(text) + conv_id * 10 >= 2040 AS truncated FROM conversations WHERE role = 'assistant'""",
    "generation_rounds": """
        WITH r AS (SELECT doc_id AS id, doc_id % 5 AS bad, least(doc_id % 5, 3) AS last FROM documents)
        SELECT id, CAST(last + 1 AS INTEGER) AS attempts, CASE WHEN bad < 4 THEN 'answer ' || id || ' of ' || last ELSE '' END AS answer,
               CAST(20 AS BIGINT) AS generated_tokens, FALSE AS truncated, CAST(NULL AS VARCHAR) AS error, bad < 4 AS clean FROM r""",
    "question_file_slice": """
        SELECT CAST(doc_id AS VARCHAR) AS id, source AS patient_id, CAST(length(text) AS INTEGER) AS length
        FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) WHERE place >= 100 AND place < 100 + n // 2""",
}
