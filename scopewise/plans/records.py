"""Queries over record building, grounding and normalisers, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopewise.functions import labels as L
from scopewise.functions import text as T
from scopewise.functions import vectors as V
from scopewise.operators import candidates, cohort, pages, questions, records
from scopewise.plans.cohort import _DIAGNOSED, _windows
from scopewise.plans.documents import _LINES, _ONE, _paged
from scopewise.plans.questions import _HEADS, _admissions, header_questions
from scopewise.plans.tables import admission_attributes, table

#: Fixed values of the queries: the order of note categories, and the details shown above a note.
CATEGORIES, SHOWN = ["Discharge summary", "Radiology", "Nursing"], ["exam_name", "author"]


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the notes of orders, three to an order; every seventh has no time."""
    kind = F.element_at(F.array(F.lit("Nursing"), F.lit("Discharge summary"), F.lit("Radiology")), (F.col("doc_id") % 3 + 1).cast("int"))
    time = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("2100-01-0"), (F.col("doc_id") % 5 + 1).cast("string"), F.lit(" 10:00:00")))
    rows = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 3).cast("bigint").alias("hadm_id"), kind.alias("category"), time.alias("charttime"), (F.col("doc_id") % 2).cast("int").alias("note_seq"), "text", "source", "lang")
    rows = rows.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id")), "hadm_id")
    return rows.select("subject_id", "hadm_id", F.col("doc_id").alias("note_id"), "category", F.col("lang").alias("label"), "charttime", "note_seq", "text", "source")


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    rows = _notes(spark, d)
    fields = F.explode(F.create_map(F.lit("exam_name"), F.when(F.col("note_id") % 4 == 0, F.col("source")), F.lit("author"), F.when(F.col("note_id") % 3 == 0, F.lit("Dr. X")))).alias("field", "value")
    details = cohort.detail_map(rows.select("note_id", fields), "note_id", "field", "value", ["field"])
    return records.in_order_with_details(rows.drop("source"), details, CATEGORIES)


def record_documents(spark: SparkSession, d: str) -> DataFrame:
    """The whole document of each admission with notes."""
    rows = _admissions(spark, d, dealt=False).join(_ordered(spark, d).withColumnRenamed("subject_id", "patient_id").withColumnRenamed("hadm_id", "admission_id"), ["patient_id", "admission_id"])
    parts = dict(patient="patient_id", sex="sex", age="age", admission="admission_id", type="admission_type", service="service", admitted="admittime", discharged="dischtime", stay="stay_days", diagnosis="diagnosis", disposition="disposition", icu="icu", num_diagnoses="num_diagnoses")
    text = records.record_document({k: F.col(v) for k, v in parts.items()} | {"died": F.lit(False)}, F.col("notes"), SHOWN)
    return rows.select("patient_id", "admission_id", F.size("notes").alias("n_notes"), F.length(text).alias("length"), F.md5(text.cast("binary")).alias("text_md5"))


def eligible_admissions(spark: SparkSession, d: str) -> DataFrame:
    lengths = cohort.note_lengths(_notes(spark, d), ["subject_id", "hadm_id"], "text")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("admittime"), F.when(F.col("o_orderkey") % 2 == 0, "WHITE - X").otherwise("ASIAN").alias("race"))
    people = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("subject_id"), (F.col("c_custkey") % 100).cast("int").alias("anchor_age"), F.when(F.col("c_custkey") % 11 != 0, 1997).alias("anchor_year"))
    return records.eligible(lengths, orders, people).select("subject_id", "hadm_id", "note_length", "age", "race_group")


def patient_records(spark: SparkSession, d: str) -> DataFrame:
    """The nested records: how many patients, admissions and notes, and what comes first."""
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"))
    attributes = admission_attributes(spark, d).select("subject_id", "hadm_id", "admittime", "diagnosis", "num_diagnoses")
    rows = records.patient_records(people, attributes, _ordered(spark, d))
    first = F.col("admissions")[0]
    return rows.select(
        F.col("patient_info.subject_id").alias("subject_id"), F.col("patient_info.segment").alias("segment"), F.size("admissions").alias("n_admissions"),
        F.aggregate("admissions", F.lit(0), lambda n, a: n + F.size(a["notes"])).alias("n_notes"), first["hadm_id"].alias("first_admission"), first["notes"][0]["note_id"].alias("first_note"),
        F.coalesce(F.try_element_at(first["note_categories"], F.lit("Radiology")), F.lit(0)).alias("radiology"),
    )


def text_all_pages(spark: SparkSession, d: str) -> DataFrame:
    """All pages of a text that runs over the end of a page: the last half of a line and the next one."""
    ranges, order = _paged(spark, d), Window.partitionBy("doc_id").orderBy("page")
    following = ranges.select("doc_id", "page", "text", F.lead("text").over(order).alias("next")).where("next IS NOT NULL")
    asked = following.select("doc_id", F.col("page").alias("of"), F.concat(F.substr("text", F.floor(F.length("text") / 2).cast("int") + 1), F.lit("\n  "), F.substring("next", 1, 40), F.lit("...")).alias("evidence"))
    rows = pages.all_text_pages(asked, ranges, "doc_id")
    return rows.select("doc_id", "of", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def clean_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", F.explode(F.array(F.lit(0), F.lit(100), F.lit(1000))).alias("position"))
    return rows.select("doc_id", "position", pages.clean_offset(F.col("text"), F.col("position")).alias("clean_at"))


def field_values(spark: SparkSession, d: str) -> DataFrame:
    """Values as flags, numbers and texts, and how they are shown."""
    odd = F.element_at(F.array(*map(F.lit, ["Yes", " no", "1", "7", "-3", "4.5", "  Home  Care ", "", "TRUE", "n"])), (F.col("o_orderkey") % 10 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", odd.alias("v"))
    return rows.select("o_orderkey", *[f(F.col("v")).alias(n) for n, f in (("flag", L.as_flag), ("number", L.as_number), ("text", L.as_text), ("flag_shown", L.flag_shown), ("text_shown", L.text_shown))])


def title_case(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("o'neil-"), F.upper("p_name"), F.lit(".x "), F.col("p_brand")).alias("v"))
    return rows.select("p_partkey", L.title(F.col("v")).alias("title"))


def fingerprint_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", V.fingerprint(F.col("embedding")).alias("fingerprint"))


def answer_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length of answers by kind, and how many subkeys a kind has."""
    return questions.length_stats(header_questions(spark, d), "answer")


def negation_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first candidate of a kind for each document."""
    rows = questions.first_headers(_admissions(spark, d), "header_fact_enriched").withColumn("id", F.col("subkey"))
    return questions.with_document(questions.first_of_kind(rows, "header_fact_enriched", ("patient_id", "admission_id"))).select("doc", "subkey", "answer")


def enriched_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.enriched(F.col("text")).cast("binary")).alias("enriched_md5"))


def _families(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and trajectories with the evidence each admission's document must hold."""
    columns, parts = ["hadm_id", "num_diagnoses"], []
    for kind, length, cap in (("same_patient_two_admissions", 2, candidates.MOST_PAIRS), ("same_patient_three_admission_trajectory", 3, candidates.MOST_TRAJECTORIES)):
        rows = candidates.windows(admission_attributes(spark, d), "subject_id", ["admittime", "hadm_id"], length, columns, cap)
        source = [F.struct(F.col(f"hadm_id_{k}").alias("doc"), F.concat(F.lit("Number of Diagnoses: "), F.col(f"num_diagnoses_{k}").cast("string")).alias("evidence")) for k in range(1, length + 1)]
        parts.append(rows.select(F.lit(kind).alias("kind"), F.concat_ws("|", *[f"hadm_id_{k}" for k in range(1, length + 1)]).alias("item"), F.col("subject_id").alias("patient"), "priority", F.array(*source).alias("sources")))
    return questions.united(*parts)


def _held_lines(spark: SparkSession, d: str) -> DataFrame:
    """One page per admission: a line with its number of diagnoses, which admissions divisible by 7 lack."""
    rows = admission_attributes(spark, d)
    line = F.when(F.col("hadm_id") % 7 == 0, F.lit("nothing")).otherwise(F.concat(F.lit("x\nNumber  of Diagnoses: "), F.col("num_diagnoses").cast("string")))
    return pages.paged(rows.select(F.col("hadm_id").alias("doc"), F.lit(1).alias("page"), line.alias("text")), "doc", "page", "text")


def grounded_families(spark: SparkSession, d: str) -> DataFrame:
    """Items of all families whose every source holds its evidence."""
    items = _families(spark, d)
    asked = items.select(F.concat_ws("/", "kind", "item").alias("item"), F.explode("sources").alias("s")).select("item", "s.*")
    kept = pages.grounded(asked, _held_lines(spark, d), "doc")
    return items.select("kind", F.concat_ws("/", "kind", "item").alias("item"), "patient").join(kept, "item")


def capped_families(spark: SparkSession, d: str) -> DataFrame:
    """Of each patient's grounded items the first by priority, as many as the family's cap."""
    items = _families(spark, d).withColumn("id", F.concat_ws("/", "kind", "item"))
    kept = grounded_families(spark, d).select(F.col("item").alias("id"))
    caps = {"same_patient_two_admissions": candidates.MOST_PAIRS, "same_patient_three_admission_trajectory": candidates.MOST_TRAJECTORIES}
    return candidates.capped(items.join(kept, "id"), ["kind", "patient"], ["priority", "item"], "kind", caps).select("kind", "item", "patient")


def selected_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The balanced choice of one question per pair of consecutive admissions, of those whose evidence is in both documents."""
    columns = ["hadm_id", "service", "num_diagnoses"]
    rows = candidates.windows(admission_attributes(spark, d), "subject_id", ["admittime", "hadm_id"], 2, columns, candidates.MOST_PAIRS)
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), candidates.relation(F.col(f"{c}_1"), F.col(f"{c}_2")).alias("relation")) for c in columns[1:]])).alias("f")
    both = rows.select("subject_id", "priority", F.concat_ws("|", "hadm_id_1", "hadm_id_2").alias("source_set"), fields).select("*", "f.*").where("relation IS NOT NULL")
    held = grounded_families(spark, d).where("kind = 'same_patient_two_admissions'").select(F.substring_index("item", "/", -1).alias("source_set"), F.lit(True).alias("held"))
    rank = candidates.stable_rank(F.col("source_set"), F.col("field")).alias("rank")
    ranked = both.join(held, "source_set", "left").select("source_set", F.col("subject_id").cast("string").alias("group"), "priority", "field", "relation", rank, F.coalesce("held", F.lit(False)).alias("grounded"))
    return candidates.balanced_choice(ranked, candidates.MOST_PAIRS).withColumnRenamed("group", "patient")


QUERIES = {
    f.__name__: f
    for f in (
        selected_pairs, record_documents, eligible_admissions, patient_records, text_all_pages, clean_offsets, field_values, title_case, fingerprint_text, answer_lengths, negation_candidates, enriched_chunks,
        grounded_families, capped_families,
    )
}

_NOTES = r"""
    note AS (SELECT doc_id, doc_id // 3 AS hadm_id, o_custkey AS subject_id, ['Nursing', 'Discharge summary', 'Radiology'][CAST(doc_id % 3 + 1 AS BIGINT)] AS category,
                    CASE WHEN doc_id % 7 <> 0 THEN '2100-01-0' || CAST(doc_id % 5 + 1 AS VARCHAR) || ' 10:00:00' ELSE '' END AS charttime, doc_id % 2 AS seq, text, lang,
                    CASE WHEN doc_id % 4 = 0 THEN source END AS exam, CASE WHEN doc_id % 3 = 0 THEN 'Dr. X' END AS author
             FROM documents JOIN orders ON o_orderkey = doc_id // 3),
    placed AS (SELECT *, list_position(['Discharge summary', 'Radiology', 'Nursing'], category) AS r, row_number() OVER w AS k, count(*) OVER (PARTITION BY hadm_id) AS n,
                      regexp_replace(text, '^\s+|\s+$', '', 'g') AS body
               FROM note WHERE text IS NOT NULL WINDOW w AS (PARTITION BY hadm_id ORDER BY list_position(['Discharge summary', 'Radiology', 'Nursing'], category), charttime, seq, CAST(doc_id AS VARCHAR)))"""
_FAMILIES = f"""
    pair AS ({_windows(2, 4, "subject_id, priority, hadm_id_1, hadm_id_2")}),
    tri AS ({_windows(3, 2, "subject_id, priority, hadm_id_1, hadm_id_2, hadm_id_3")}),
    family AS (SELECT 'same_patient_two_admissions' AS kind, hadm_id_1 || '|' || hadm_id_2 AS item, subject_id AS patient, priority, [hadm_id_1, hadm_id_2] AS docs FROM pair
               UNION ALL SELECT 'same_patient_three_admission_trajectory', hadm_id_1 || '|' || hadm_id_2 || '|' || hadm_id_3, subject_id, priority, [hadm_id_1, hadm_id_2, hadm_id_3] FROM tri),
    kept AS (SELECT * FROM family WHERE len(list_filter(docs, lambda x: x % 7 = 0)) = 0)"""
ORACLE_SQL = {
    "record_documents": f"""WITH {_HEADS}, {_NOTES},
        whole AS (SELECT hadm_id, count(*) AS n_notes,
                         string_agg('Clinical note ' || k || ' of ' || n || ': ' || category || CASE WHEN lang <> category AND lang <> '' THEN ' - ' || lang ELSE '' END || CASE WHEN charttime <> '' THEN ' - charted ' || charttime ELSE '' END
                                    || coalesce(' - Exam name: ' || nullif(exam, ''), '') || coalesce(' - Author: ' || author, '') || chr(10) || body, chr(10) || chr(10) ORDER BY k) AS bodies FROM placed GROUP BY hadm_id),
        held AS (SELECT hadm_id, string_agg(category || ' (' || c || ')', ', ' ORDER BY r) AS inventory FROM (SELECT hadm_id, category, r, count(*) AS c FROM placed GROUP BY ALL) GROUP BY hadm_id),
        t AS (SELECT patient_id, admission_id, CAST(n_notes AS INTEGER) AS n_notes,
               'Clinical Record Summary' || chr(10) || chr(10) || 'Patient ID: ' || patient_id || '  Sex: ' || sex || '  Age at Admission: ' || age || chr(10)
               || 'Admission ID: ' || admission_id || '  Type: ' || admission_type || '  Hospital Service: ' || coalesce(service, 'Not recorded') || chr(10)
               || 'Admission Date: ' || day || '  Discharge Date: ' || day || '  Length of Stay: ' || stay || ' days' || chr(10)
               || 'Principal Diagnosis: ' || coalesce(diagnosis, 'Not recorded') || chr(10) || 'Discharge Disposition: ' || disposition || chr(10)
               || 'ICU Stay: ' || icu || '  In-Hospital Mortality: No  Number of Diagnoses: ' || num_diagnoses || chr(10) || 'Clinical Notes Included: ' || inventory || chr(10) || chr(10) || bodies AS text
              FROM asked JOIN whole ON whole.hadm_id = admission_id JOIN held ON held.hadm_id = admission_id)
        SELECT patient_id, admission_id, n_notes, CAST(length(text) AS INTEGER) AS length, md5(text) AS text_md5 FROM t""",
    "eligible_admissions": f"""WITH {_NOTES},
        l AS (SELECT subject_id, hadm_id, CAST(sum(length(body)) AS BIGINT) AS note_length FROM placed GROUP BY ALL),
        e AS (SELECT l.*, CAST(CASE WHEN subject_id % 100 >= 91 THEN 91 WHEN subject_id % 11 <> 0 AND subject_id % 100 + year(o_orderdate) - 1997 >= 0 THEN subject_id % 100 + year(o_orderdate) - 1997 END AS INTEGER) AS age,
                     CASE WHEN hadm_id % 2 = 0 THEN 'White' ELSE 'Asian' END AS race_group
              FROM l JOIN orders ON o_orderkey = hadm_id JOIN customer ON c_custkey = subject_id WHERE subject_id % 5 <> 0)
        SELECT * FROM e WHERE age IS NOT NULL""",
    "patient_records": f"""WITH {_NOTES},
        a AS (SELECT subject_id, hadm_id, o_orderdate, count(*) AS n, count(*) FILTER (category = 'Radiology') AS radiology, CAST(arg_min(doc_id, k) AS VARCHAR) AS first_note FROM placed JOIN orders ON o_orderkey = hadm_id GROUP BY ALL)
        SELECT subject_id, c_mktsegment AS segment, CAST(count(*) AS INTEGER) AS n_admissions, CAST(sum(n) AS INTEGER) AS n_notes, arg_min(hadm_id, (o_orderdate, hadm_id)) AS first_admission,
               arg_min(first_note, (o_orderdate, hadm_id)) AS first_note, CAST(arg_min(radiology, (o_orderdate, hadm_id)) AS INTEGER) AS radiology
        FROM a JOIN customer ON c_custkey = subject_id GROUP BY ALL""",
    "text_all_pages": rf"""WITH {_LINES},
        f AS (SELECT doc_id, page, text, lower({_ONE.format('text')}) AS flat FROM ranges),
        pg AS (SELECT *, coalesce(sum(CASE WHEN flat = '' THEN 0 ELSE length(flat) + 1 END) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM f),
        w AS (SELECT doc_id, string_agg(flat, ' ' ORDER BY page) AS whole FROM f WHERE flat <> '' GROUP BY doc_id),
        ev AS (SELECT a.doc_id, a.page AS of, regexp_replace(substr(a.text, length(a.text) // 2 + 1) || chr(10) || '  ' || substr(b.text, 1, 40) || '...', '(\.\.\.)+$', '') AS evidence
               FROM f a JOIN f b ON b.doc_id = a.doc_id AND b.page = a.page + 1),
        lk AS (SELECT doc_id, of, lower({_ONE.format('evidence')}) AS part FROM ev),
        x AS (SELECT lk.*, strpos(whole, part) - 1 AS spot FROM lk LEFT JOIN w USING (doc_id) WHERE part <> ''),
        hit AS (SELECT x.doc_id, of, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM x JOIN pg ON pg.doc_id = x.doc_id AND flat <> '' AND spot >= 0 AND spot < s + length(flat) AND spot + length(part) > s GROUP BY ALL)
        SELECT lk.doc_id, lk.of, coalesce(pages, '') AS pages FROM lk LEFT JOIN hit USING (doc_id, of)""",
    "clean_offsets": r"""
        WITH o AS (SELECT doc_id, text, unnest([0, 100, 1000]) AS position FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, position, CAST(length(regexp_replace(regexp_replace(substr(text, 1, position), '[\s\x0b]+', ' ', 'g'), '^ ', '')) AS INTEGER) AS clean_at FROM o""",
    "field_values": """
        SELECT o_orderkey, [TRUE, FALSE, TRUE, NULL, NULL, NULL, NULL, NULL, TRUE, FALSE][CAST(o_orderkey % 10 + 1 AS BIGINT)] AS flag,
               [NULL, NULL, 1, 7, -3, NULL, NULL, NULL, NULL, NULL][CAST(o_orderkey % 10 + 1 AS BIGINT)] AS number,
               ['yes', 'no', '1', '7', '-3', '4.5', 'home care', NULL, 'true', 'n'][CAST(o_orderkey % 10 + 1 AS BIGINT)] AS text,
               ['Yes', 'No', 'Yes', NULL, NULL, NULL, NULL, NULL, 'Yes', 'No'][CAST(o_orderkey % 10 + 1 AS BIGINT)] AS flag_shown,
               ['Yes', 'no', '1', '7', '-3', '4.5', 'Home Care', NULL, 'TRUE', 'n'][CAST(o_orderkey % 10 + 1 AS BIGINT)] AS text_shown FROM orders""",
    "title_case": "SELECT p_partkey, 'O''Neil-' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '.X ' || p_brand AS title FROM part",
    "fingerprint_text": """
        SELECT vec_id, printf('dim=%d l2norm=%.4f sample=[%.4f,%.4f,%.4f]', len(embedding), sqrt(list_sum(list_transform(embedding, lambda x: CAST(x * x AS DOUBLE)))),
                              CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)) AS fingerprint FROM embeddings""",
    "answer_lengths": f"WITH {_HEADS} SELECT kind, min(length(answer)) AS shortest, round(avg(length(answer)), 6) AS mean, max(length(answer)) AS longest, count(DISTINCT subkey) AS subkeys, count(*) AS n FROM heads GROUP BY kind",
    "negation_candidates": f"WITH {_HEADS} SELECT 'Patient_' || patient_id || '_Admission_' || admission_id || '.pdf' AS doc, min(subkey) AS subkey, arg_min(answer, subkey) AS answer FROM heads WHERE kind = 'header_fact_enriched' GROUP BY ALL",
    "enriched_chunks": """
        SELECT doc_id, md5(CASE WHEN contains(text, chr(10)) THEN repeat(' ', 20) || 'PSYCHIATRIC MEDICAL RECORD EXTRACT' || chr(10) || repeat(' ', 20) || text ELSE 'PSYCHIATRIC MEDICAL RECORD EXTRACT' || chr(10) || text END) AS enriched_md5
        FROM documents WHERE text IS NOT NULL""",
    "grounded_families": f"WITH {_FAMILIES} SELECT kind, kind || '/' || item AS item, patient FROM kept",
    "capped_families": f"""WITH {_FAMILIES}, r AS (SELECT *, row_number() OVER (PARTITION BY kind, patient ORDER BY priority, item) AS n FROM kept)
        SELECT kind, item, patient FROM r WHERE n <= CASE WHEN kind = 'same_patient_two_admissions' THEN 4 ELSE 2 END""",
}
