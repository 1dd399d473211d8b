"""Patient records: notes joined to admissions, patients and their details, in order, nested and as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopewise.functions.labels import age_at, race_group
from scopewise.functions.text import stripped
from scopewise.sources.sinks import header_lines, note_heading

TITLE = "Clinical Record Summary"


def eligible(lengths: DataFrame, admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Admissions that have notes and a known patient, with age and race group; those without an age are left out.

    lengths(subject_id, hadm_id, note_length), admissions(subject_id, hadm_id, admittime, race, ..), patients(subject_id, anchor_age, anchor_year, ..).
    """
    rows = lengths.join(admissions, ["subject_id", "hadm_id"]).join(patients, "subject_id")
    rows = rows.withColumn("age", age_at(F.col("anchor_age"), F.col("anchor_year"), F.col("admittime"))).where("age IS NOT NULL")
    return rows.withColumn("race_group", race_group(F.col("race")))


def with_details(notes: DataFrame, details: DataFrame) -> DataFrame:
    """notes with details(note_id, details), an empty map for notes that have none."""
    none = F.create_map().cast("map<string,string>")
    return notes.join(details, "note_id", "left").withColumn("details", F.coalesce("details", none))


def _note(categories: list[str]) -> Column:
    """A note of in_order(), without its details."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, categories)), F.col("category")), F.lit(0)), F.lit(len(categories) + 1))
    return F.struct(
        rank.alias("rank"), F.coalesce("charttime", F.lit("")).alias("charttime"), F.coalesce(F.col("note_seq").cast("int"), F.lit(0)).alias("note_seq"), F.col("note_id").cast("string").alias("note_id"),
        "category", "label", stripped(F.col("text")).alias("text"),
    )


def in_order(notes: DataFrame, categories: list[str]) -> DataFrame:
    """(subject_id, hadm_id, notes): each admission's notes by category, time, sequence and id.

    notes(subject_id, hadm_id, note_id, category, label, charttime, note_seq, text, details); a missing time comes
    first and a missing sequence is 0. Texts are stripped. Categories that are not listed come last.
    """
    note = _note(categories).withField("details", F.map_entries("details"))
    return notes.where("text IS NOT NULL").groupBy("subject_id", "hadm_id").agg(F.array_sort(F.collect_list(note)).alias("notes"))


def in_order_with_details(notes: DataFrame, details: DataFrame, categories: list[str]) -> DataFrame:
    """in_order(with_details(notes, details), categories), where no text is shuffled for its details: they go to their admission and meet its notes there."""
    none = F.map_entries(F.create_map().cast("map<string,string>"))
    key = ["subject_id", "hadm_id"]
    texts = notes.where("text IS NOT NULL").select(*key, _note(categories).alias("_note"))
    owned = notes.where("text IS NOT NULL").select(*key, "note_id").distinct().join(details, "note_id")
    owned = owned.select(*key, F.struct(F.col("note_id").cast("string").alias("note_id"), F.map_entries("details").alias("details")).alias("_own"))
    both = texts.unionByName(owned, allowMissingColumns=True).groupBy(*key).agg(F.array_sort(F.collect_list("_note")).alias("notes"), F.collect_list("_own").alias("_own"))
    own = lambda n: F.get(F.transform(F.filter("_own", lambda o: o["note_id"] == n["note_id"]), lambda o: o["details"]), 0)
    return both.select(*key, F.transform("notes", lambda n: n.withField("details", F.coalesce(own(n), none))).alias("notes"))


def inventory(notes: Column) -> Column:
    """Categories in the order of the notes, each with its number of notes."""
    kinds = F.array_distinct(F.transform(notes, lambda n: n["category"]))
    return F.array_join(F.transform(kinds, lambda k: F.concat(k, F.lit(" ("), F.size(F.filter(notes, lambda n: n["category"] == k)).cast("string"), F.lit(")"))), ", ")


def record_document(a: dict[str, Column], notes: Column, shown: list[str]) -> Column:
    """A record's document: title, seven lines, and each note's text under its heading, with the details that are shown there."""

    def said(n: Column, field: str) -> Column:
        return F.get(F.transform(F.filter(n["details"], lambda e: e["key"] == field), lambda e: e["value"]), 0)

    def body(n: Column, k: Column) -> Column:
        heading = note_heading(k + 1, F.size(notes), n["category"], n["label"], n["charttime"], {f: said(n, f) for f in shown})
        return F.concat(heading, F.lit("\n"), n["text"])

    return F.concat_ws("\n\n", F.lit(TITLE), header_lines({**a, "inventory": inventory(notes)}), F.array_join(F.transform(notes, body), "\n\n"))


def patient_records(patients: DataFrame, admissions: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per patient, ready to be written as JSON: patient_info, and admissions in order with their notes.

    Admissions without notes are left out, and patients without such admissions. patients(subject_id, ..),
    admissions(subject_id, hadm_id, admittime, ..), notes as in_order() gives them.
    """
    held = admissions.join(notes, ["subject_id", "hadm_id"])
    categories = F.map_from_entries(F.transform(F.array_distinct(F.transform("notes", lambda n: n["category"])), lambda k: F.struct(k, F.size(F.filter("notes", lambda n: n["category"] == k)))))
    own = [c for c in held.columns if c not in ("subject_id", "notes", "admittime", "hadm_id")]
    admission = F.struct("admittime", "hadm_id", *own, categories.alias("note_categories"), F.transform("notes", lambda n: n.dropFields("rank").withField("details", F.map_from_entries(n["details"]))).alias("notes"))
    # maps can't be put in order, so admissions are ordered as text
    ordered = F.struct("admittime", "hadm_id", F.to_json(admission).alias("json"))
    grouped = held.groupBy("subject_id").agg(F.transform(F.array_sort(F.collect_list(ordered)), lambda x: x["json"]).alias("admissions"))
    info = F.struct(*patients.columns)
    schema = held.select(admission.alias("a")).schema["a"].dataType
    return patients.select("subject_id", info.alias("patient_info")).join(grouped, "subject_id").select("patient_info", F.transform("admissions", lambda x: F.from_json(x, schema)).alias("admissions"))
