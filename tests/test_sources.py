import gzip
import json

import pytest
from pyspark.sql import functions as F

from scopewise.sources import readers, sinks
from scopewise.streaming import ingest


def test_tables_and_notes(spark, tmp_path):
    with gzip.open(tmp_path / "discharge.csv.gz", "wt") as f:
        f.write('note_id,subject_id,hadm_id,note_type,note_seq,charttime,text,extra\nn1,1,10,DS,1,2100-01-01,"a ""quoted""\nline",x\nn2,1,,DS,1,2100-01-01,lost,x\nn3,2,20,DS,2,2100-01-02,,x\n')
    (tmp_path / "radiology.csv").write_text("note_id,subject_id,hadm_id,note_type,note_seq,charttime,text\nr1,1,10,RR,1,2100-01-01,scan\n")
    (tmp_path / "discharge_detail.csv").write_text("note_id,field_name,field_value\nn1,author,x\nn9,author,y\n")
    notes = readers.read_notes(spark, str(tmp_path))
    assert {(r.note_id, r.category, r.text) for r in notes.collect()} == {("n1", "Discharge summary", 'a "quoted"\nline'), ("r1", "Radiology", "scan")}
    details = readers.read_details(spark, str(tmp_path), "discharge", notes).collect()
    assert [(r.note_id, r.field_ordinal) for r in details] == [("n1", None)]
    assert readers.read_details(spark, str(tmp_path), "radiology", notes).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.require_table(spark, str(tmp_path), "patients")


def test_lines_of_many_files_are_numbered(spark, tmp_path):
    """Files of many blocks each, with blank lines: every offset and limit is what reading them one after the other gives."""
    folder = tmp_path / "sets"
    folder.mkdir()
    want = []
    for f in (2, 0, 1):
        lines = [("  " if i % 7 == 3 else "") if i % 5 == 0 else json.dumps({"id": f"{f}-{i}", "question": "q" * (i % 40)}) for i in range(200 * f)]
        (folder / f"part-{f}.jsonl").write_text("\n".join(lines))
    for f in range(3):
        want += [json.loads(x)["id"] for x in (folder / f"part-{f}.jsonl").read_text().split("\n") if x.strip()]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(str(folder)).select("_metadata.file_block_start").distinct().count() > 5
        for start, most in ((0, None), (0, 7), (150, 30), (len(want) - 5, 50), (len(want), None), (10, 0), (3, None)):
            got = [r.id for r in readers.read_questions(spark, str(folder), start=start, most=most).collect()]
            assert got == (want[start:] if most is None else want[start : start + most]), (start, most)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_questions_and_chunks(spark, tmp_path):
    items = [{"id": f"q{i}", "comparison_type": "same", "sources": [{"patient_id": "1", "admission_id": str(i), "source_chunk": "c"}]} for i in range(5)]
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps(x) for x in items[:3]) + "\n\n  \n" + "\n".join(json.dumps(x) for x in items[3:]))
    rows = readers.read_questions(spark, str(tmp_path / "q.jsonl"), multi=True, start=1, most=3)
    assert [r.id for r in rows.collect()] == ["q1", "q2", "q3"]
    assert {(r["item"], r.admission_id) for r in readers.question_sources(rows).collect()} == {("q1", "1"), ("q2", "2"), ("q3", "3")}
    (tmp_path / "c.json").write_text('[{"content": "x"}, {"patientId": "p", "content": "y", "timestamp": 5, "embedding": [1, 2]}]')
    assert [(r.patientId, r.timestamp, r.embedding) for r in readers.read_chunks(spark, str(tmp_path / "c.json")).orderBy("content").collect()] == [("", 0, None), ("p", 5, [1.0, 2.0])]
    (tmp_path / "p.json").write_text(json.dumps({"patients": [{"patient_info": {"subject_id": 7}, "admissions": [{"hadm_id": 1}, {"hadm_id": 2}]}]}))
    assert [(r.patient_id, r.admission.hadm_id) for r in readers.read_patients(spark, str(tmp_path / "p.json")).collect()] == [("7", 1), ("7", 2)]


@pytest.mark.parametrize(
    ("config", "found"),
    [
        ('{"models": {"a": {"displayName": "A", "modelUrl": "u", "modelFilename": "f", "modelType": "qwen_3"}}}', {"a": "QWEN_3"}),
        ('{"models": {"a": {"displayName": "A", "modelUrl": "u", "modelFilename": "f", "modelType": "odd"}}}', {"a": "LLAMA_3"}),
        ('{"models": {"a": {"displayName": "A", "modelUrl": "u"}}}', {}),
        ('{"models": {}}', {}),
        ("{}", {}),
        ("not json", {}),
    ],
)
def test_presets(spark, config, found):
    rows = readers.parse_presets(spark.createDataFrame([(config,)], "c string"), "c")
    assert {r.key: r.model_type for r in rows.collect()} == found


def test_paths_prefer_flags():
    got = readers.Paths.resolve({"a": "flag", "b": None}, {"A": "env", "B": "env"}, {"a": "1", "b": "2", "c": "3"})
    assert got.values == {"a": "flag", "b": "env", "c": "3"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "same_patient", "x")], "id int, split string, _secret string")
    sinks.write_json(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["id", "split"]
    sinks.write_split(rows.drop("_secret"), str(tmp_path / "split"))
    assert (tmp_path / "split" / "split=same_patient").is_dir()
    balance = spark.createDataFrame([("a", 3, 75.0, 1, 50.0)], "value string, population_n long, population_pct double, selected_n long, selected_pct double")
    assert "| a | 3 | 75.0 | 1 | 50.0 |" in sinks.balance_report({"sex": balance})
    parts = {k: F.lit(v) for k, v in dict(patient=1, sex="F", age=None, admission=2, type="Urgent", service="", admitted="2100-01-01 1:00", discharged="2100-01-03", stay=2, diagnosis=None, disposition="Home", icu=True, died=False, num_diagnoses=4, inventory="Radiology (1)").items()}
    parts["age"], parts["diagnosis"] = parts["age"].cast("int"), parts["diagnosis"].cast("string")
    lines = spark.range(1).select(sinks.header_lines(parts).alias("h")).first().h.split("\n")
    assert len(lines) == 7 and lines[0].endswith("N/A") and lines[3] == "Principal Diagnosis: Not recorded" and "Length of Stay: 2 days" in lines[2]


def test_document_files(spark, tmp_path):
    for name in ("Patient_1_Admission_10.pdf", "Patient_12_Admission_11.pdf"):
        (tmp_path / name).write_bytes(b"x")
    assert [(r.patient_id, r.admission_id) for r in readers.document_files(spark, str(tmp_path), "1").collect()] == [("1", "10")]
    rows = spark.createDataFrame([(" ", "scan"), ("layer", "scan")], "layer string, scan string")
    assert [r.text for r in readers.with_fallback_text(rows, "layer", "scan").collect()] == ["scan", "layer"]


def test_ingest_replaces_documents(spark, tmp_path):
    schema = "patientId string, documentId string, content string, arrived int"
    inbox, store = str(tmp_path / "in"), str(tmp_path / "store")
    for batch in ([("p", "d", "old " * 300, 1), ("p", "e", "other", 1)], [("p", "d", "late", 1), ("p", "d", "new", 2)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(inbox)
        ingest.ingest(spark.readStream.schema(schema).parquet(inbox), store, str(tmp_path / "check")).awaitTermination()
    assert sorted((r.documentId, r.content) for r in ingest.current(spark, store).collect()) == [("d", "new"), ("e", "other")]


def test_blank_documents_and_compaction(spark, tmp_path):
    schema = "patientId string, documentId string, content string, arrived int"
    inbox, store, packed = (str(tmp_path / n) for n in ("in", "store", "packed"))
    assert ingest.current(spark, store) is None
    for batch in ([("p", "d", "words here", 1), ("p", "e", "other", 1)], [("p", "d", "  ", 2)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(inbox)
        ingest.ingest(spark.readStream.schema(schema).parquet(inbox), store, str(tmp_path / "check")).awaitTermination()
    ingest.compact(spark, store, packed)
    for folder in (store, packed):
        assert [(r.documentId, r.content) for r in ingest.current(spark, folder).collect()] == [("e", "other")]


def test_event_counts_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 09:00:00', 'a', 2.0D")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.event_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [(r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 1.0)]


def test_item_documents_and_headings(spark):
    items = spark.createDataFrame([("q1", "1", "Patient_1_Admission_10.pdf"), ("q2", "2", "Patient_2_Admission_20.pdf")], "item string, patient_id string, document_name string")
    files = spark.createDataFrame([("1", "Patient_1_Admission_10.pdf"), ("1", "Patient_1_Admission_11.pdf")], "patient_id string, name string")
    assert sorted((r["item"], r.name) for r in readers.item_documents(items, files).collect()) == [("q1", "Patient_1_Admission_10.pdf"), ("q1", "Patient_1_Admission_11.pdf"), ("q2", "Patient_2_Admission_20.pdf")]
    heading = sinks.note_heading(F.lit(1), F.lit(2), F.lit("Radiology"), F.lit("Radiology report"), F.lit(None).cast("string"), {"exam_name": F.lit("CT"), "author": F.lit("")})
    assert spark.range(1).select(heading.alias("h")).first().h == "Clinical note 1 of 2: Radiology - Radiology report - Exam name: CT"
