"""Sections of notes: header lines by category, and what stands below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopewise.functions.text import stripped

# Section names and the header texts that open them, by note category.
DISCHARGE = {
    "Chief Complaint": ["Chief Complaint"],
    "Major Surgical or Invasive Procedure": ["Major Surgical or Invasive Procedures?"],
    "Allergies": ["Allergies"],
    "History of Present Illness": ["History of Present Illness"],
    "Past Medical History": ["Past Medical History", "PAST MEDICAL HISTORY", "PMH"],
    "Social History": ["Social History"],
    "Family History": ["Family History"],
    "Physical Exam": ["Physical Exam"],
    "Pertinent Results": ["Pertinent Results"],
    "Brief Hospital Course": ["Brief Hospital Course", "HOSPITAL COURSE"],
    "Medications on Admission": ["Medications on Admission", "MEDICATIONS ON ADMISSION"],
    "Discharge Medications": ["Discharge Medications", "DISCHARGE MEDICATIONS"],
    "Discharge Disposition": ["Discharge Disposition", "DISCHARGE DISPOSITION"],
    "Discharge Diagnosis": ["Discharge Diagnosis", "Discharge Diagnoses", "DISCHARGE DIAGNOSIS", "DISCHARGE DIAGNOSES"],
    "Discharge Condition": ["Discharge Condition"],
    "Discharge Instructions": ["Discharge Instructions"],
    "Followup Instructions": ["Followup Instructions"],
}
RADIOLOGY = {
    "Examination": ["Examination", "Exam"],
    "Indication": ["Indication", "Clinical Indication", "History"],
    "Technique": ["Technique"],
    "Comparison": ["Comparison"],
    "Findings": ["Findings"],
    "Impression": ["Impression", "Conclusion"],
}
NURSING = {name: [name] for name in ("Situation", "Background", "Assessment", "Action", "Response", "Plan")}
PHYSICIAN = {
    "Chief Complaint": ["Chief Complaint"],
    "History of Present Illness": ["History of Present Illness", "HPI"],
    "24 Hour Events": ["24 Hour Events"],
    "Physical Examination": ["Physical Examination", "Physical Exam"],
    "Labs and Radiology": ["Labs / Radiology", "Labs and Radiology"],
    "Assessment and Plan": ["Assessment and Plan", "Assessment & Plan", "A/P"],
}
CONSULT = {
    "Reason for Consultation": ["Reason for Consult(?:ation)?"],
    "History of Present Illness": ["History of Present Illness", "HPI"],
    "Impression": ["Impression", "Assessment"],
    "Recommendations": ["Recommendations?"],
}
#: Headers that end a section and open none.
BOUNDARIES = {"Discharge summary": ["Attending", "Service", "Facility"]}
SCHEMAS = {"Discharge summary": DISCHARGE, "Radiology": RADIOLOGY, "Nursing": NURSING, "Physician": PHYSICIAN, "Consult": CONSULT}


def split_sections(text: Column, schema: dict[str, list[str]], boundaries: list[str] = (), any_case: bool = False) -> Column:
    """array<struct<pos, section, content>> of one text, in order; content may be empty."""
    flags = "(?imd)" if any_case else "(?md)"
    every = "|".join([h for heads in schema.values() for h in heads] + list(boundaries))
    header = rf"{flags}^[ \t]*({every})[ \t]*:[ \t]*"
    pieces = F.slice(F.split(F.concat(F.lit("\n"), text), rf"{flags}(?=^[ \t]*(?:{every})[ \t]*:)"), 2, 1 << 30)

    def named(name: Column) -> Column:
        out = F.lit(None).cast("string")
        for section, heads in reversed(schema.items()):
            out = F.when(name.rlike(rf"^{'(?i)' if any_case else ''}(?:{'|'.join(heads)})$"), F.lit(section)).otherwise(out)
        return out

    rows = F.transform(
        pieces, lambda p, i: F.struct(i.alias("_at"), named(F.regexp_extract(p, header, 1)).alias("section"), stripped(F.regexp_replace(p, rf"\A{header}", "")).alias("content"))
    )
    return F.filter(rows, lambda r: r["section"].isNotNull())


def sections(notes: DataFrame, keys: list[str], category_col: str, text_col: str, order: list[str]) -> DataFrame:
    """(keys, category, section, content): of several notes the first non-empty content of a section wins.

    Notes of unknown categories are read as discharge summaries.
    """
    chosen = F.lit(None)
    for category, schema in SCHEMAS.items():
        found = split_sections(F.col(text_col), schema, BOUNDARIES.get(category, []), category != "Discharge summary")
        chosen = F.when(F.col(category_col) == category, found).otherwise(chosen)
    known = F.col(category_col).isin(*SCHEMAS)
    other = split_sections(F.col(text_col), DISCHARGE, BOUNDARIES["Discharge summary"])
    rows = notes.select(*keys, *order, F.col(category_col).alias("category"), F.inline(F.when(known, chosen).otherwise(other))).where("content <> ''")
    first = Window.partitionBy(*keys, "category", "section").orderBy(*order, "_at")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*keys, "category", "section", "content")
