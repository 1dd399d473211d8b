"""Code labels and derived attributes of admissions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scopewise.functions.text import capitalized, one_line

# Codes and their labels.
ADMISSION_TYPES = {
    "EW EMER.": "Emergency",
    "DIRECT EMER.": "Direct emergency",
    "URGENT": "Urgent",
    "ELECTIVE": "Elective",
    "SURGICAL SAME DAY ADMISSION": "Surgical same-day admission",
    "OBSERVATION ADMIT": "Observation",
    "EU OBSERVATION": "Emergency unit observation",
    "DIRECT OBSERVATION": "Direct observation",
    "AMBULATORY OBSERVATION": "Ambulatory observation",
}
SERVICES = {
    "CMED": "Cardiac Medicine",
    "CSURG": "Cardiac Surgery",
    "DENT": "Dental",
    "ENT": "Ear Nose and Throat",
    "EYE": "Ophthalmology",
    "GU": "Urology",
    "GYN": "Gynecology",
    "MED": "General Medicine",
    "NB": "Newborn",
    "NBB": "Newborn Baby",
    "NMED": "Neurology",
    "NSURG": "Neurosurgery",
    "OBS": "Obstetrics",
    "OMED": "Oncology",
    "ORTHO": "Orthopedics",
    "PSURG": "Plastic Surgery",
    "PSYCH": "Psychiatry",
    "SURG": "General Surgery",
    "TRAUM": "Trauma",
    "TSURG": "Thoracic Surgery",
    "VSURG": "Vascular Surgery",
}
DISCHARGE_LOCATIONS = {
    "AGAINST ADVICE": "Left against medical advice",
    "CHRONIC/LONG TERM ACUTE CARE": "Chronic or long-term acute care facility",
    "HOME HEALTH CARE": "Home with home health care",
}
NOTE_TYPES = {
    "DS": "Discharge summary",
    "AD": "Discharge summary addendum",
    "RR": "Radiology report",
    "AR": "Radiology report addendum",
}
NOT_A_VALUE = ("nan", "none", "<na>")
UNKNOWN_RACES = ("UNKNOWN", "UNABLE TO OBTAIN", "PATIENT DECLINED TO ANSWER")
RACE_GROUPS = (("WHITE", "White"), ("BLACK", "Black"), ("HISPANIC", "Hispanic or Latino"), ("SOUTH AMERICAN", "Hispanic or Latino"), ("ASIAN", "Asian"))


def cleaned(value: Column) -> Column:
    """One line of text; null and null-like words are empty."""
    text = one_line(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(F.lower(text).isin(*NOT_A_VALUE), F.lit("")).otherwise(text)


def _looked_up(text: Column, labels: dict[str, str], other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(text)), other)


def admission_type(code: Column) -> Column:
    text = cleaned(code)
    return F.when(text == "", text).otherwise(_looked_up(text, ADMISSION_TYPES, title(text)))


def service(code: Column) -> Column:
    text = cleaned(code)
    return F.when(text == "", text).otherwise(_looked_up(text, SERVICES, text))


def discharge_location(code: Column) -> Column:
    """Null where there is none to name."""
    text = cleaned(code)
    return F.when((text != "") & (F.upper(text) != "DIED"), _looked_up(text, DISCHARGE_LOCATIONS, capitalized(text)))


def note_type(code: Column) -> Column:
    text = cleaned(code)
    return _looked_up(text, NOTE_TYPES, text)


def disposition(location: Column, expired: Column, section: Column) -> Column:
    """The location, else death in hospital, else what a section says, else a fixed text."""
    said = F.trim(F.coalesce(section, F.lit("")))
    return F.coalesce(F.when(location != "", location), F.when(expired, F.lit("Died in hospital")), F.when(said != "", said), F.lit("Not recorded"))


def race_group(race: Column) -> Column:
    text = F.upper(cleaned(race))
    out = F.lit("Other")
    for start, group in reversed(RACE_GROUPS):
        out = F.when(text.startswith(start), F.lit(group)).otherwise(out)
    return F.when((text == "") | text.isin(*UNKNOWN_RACES), F.lit("Unknown")).otherwise(out)


def age_at(anchor_age: Column, anchor_year: Column, admit: Column) -> Column:
    """Ages of 91 and over are one; negative and unreadable ones null."""
    age = anchor_age.cast("int") + F.substring(admit, 1, 4).try_cast("int") - anchor_year.cast("int")
    return F.when(anchor_age >= 91, F.lit(91)).when(age >= 0, age)


def stay_days(admit: Column, discharge: Column) -> Column:
    """Calendar days; negative and unreadable ones null."""
    days = F.datediff(F.substring(discharge, 1, 10).try_cast("date"), F.substring(admit, 1, 10).try_cast("date"))
    return F.when(days >= 0, days)


def expired(flag: Column) -> Column:
    """A missing flag counts as set, as it does in the source data's own rule."""
    return F.coalesce(flag != 0, F.lit(True))


def as_flag(value: Column) -> Column:
    """Three-state: true, false or null from booleans, numbers and words."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("true", "1", "yes", "y", "1.0"), True).when(text.isin("false", "0", "no", "n", "0.0"), False)


def as_number(value: Column) -> Column:
    """A whole number, or null."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint")).cast("int")


def as_text(value: Column) -> Column:
    """One line in lower case, or null if blank."""
    return F.lower(text_shown(value))


def flag_shown(value: Column) -> Column:
    """Yes or No, or null if the value is no flag."""
    return F.when(as_flag(value), "Yes").when(~as_flag(value), "No")


def text_shown(value: Column) -> Column:
    """One line as it is written, or null if blank."""
    return F.nullif(one_line(value.cast("string")), F.lit(""))


def title(text: Column) -> Column:
    """Every run of letters with its first one large and the others small, whatever stands between the runs."""
    runs = F.split(text, r"(?<=\P{L})(?=\p{L})|(?<=\p{L})(?=\P{L})")
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")
