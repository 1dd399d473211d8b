"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a token; tokens are longer than two characters.
TOKEN = "[a-zA-Z0-9]+"


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric runs of more than two characters, in order, with repeats."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: F.length(t) > 2)


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two token sets: shared over the smaller one's size, 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def stripped(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Runs of blanks and tabs become one blank; ends are stripped."""
    return stripped(F.regexp_replace(text, "[ \t]+", " "))


def one_line(text: Column) -> Column:
    """All white space becomes single blanks; ends are stripped."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated(text: Column, most: int) -> Column:
    """The text, or its first characters and three dots."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def looked_up(part: Column, first: int | None = None) -> Column:
    """What of a text is looked for: on one line, in lower case; with ``first``, so many characters without dots at the end."""
    if first is not None:
        part = F.substring(F.regexp_replace(part, r"(\.\.\.)+$", ""), 1, first)
    return F.lower(one_line(part))


def contains_text(whole: Column, part: Column, first: int | None = None) -> Column:
    """Containment whatever the case and white space; a blank part is nowhere.

    With ``first``, only so many characters of the part, without dots at its end, are looked for.
    """
    wanted = looked_up(part, first)
    return F.coalesce((wanted != "") & F.lower(one_line(whole)).contains(wanted), F.lit(False))


def answer_key(text: Column) -> Column:
    """Lower case, all else but letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def first_person(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\b(?:I|me|my|mine|myself)\b"), F.lit(False))


def leaks_id(text: Column) -> Column:
    """Five digits or more in a row."""
    return F.coalesce(text.rlike(r"[0-9]{5,}"), F.lit(False))


def deidentified(text: Column) -> Column:
    """Whether the text holds a de-identification mark."""
    return F.coalesce(text.rlike(r"\[\*\*|_{3,}"), F.lit(False))


def neutralized(text: Column) -> Column:
    """Blank lines of underscores become a neutral word."""
    return F.regexp_replace(text, "_{3,}", "[redacted]")


def informative(text: Column) -> Column:
    """At least 25 letters and five words."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.coalesce((letters >= 25) & (F.regexp_count(text, F.lit(r"\S+")) >= 5), F.lit(False))


def admission_of(name: Column) -> Column:
    """The digits after Admission_ in a file name, or the name."""
    found = F.regexp_extract(name, r"Admission_([0-9]+)", 1)
    return F.when(found != "", found).otherwise(name)


def document_name(patient: Column, admission: Column) -> Column:
    return F.format_string("Patient_%s_Admission_%s.pdf", patient.cast("string"), admission.cast("string"))


def scope_of_path(path: Column) -> Column:
    """A file's base name with all else but letters, digits, _ and - made _."""
    return F.regexp_replace(F.substring_index(path, "/", -1), "[^A-Za-z0-9_-]", "_")


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.call_function("substring", text, F.lit(2))))


def estimated_tokens(text: Column, per_token: float) -> Column:
    return F.ceil(F.length(text) / F.lit(per_token)).cast("int")


def stat(text: Column, key: str) -> Column:
    """A number by key from a JSON object, or from ``key: 1`` and ``key=1`` in any text."""
    number = F.regexp_extract(text, rf'(?i){key.replace("_", "[_ ]")}"?\s*[:=]\s*([0-9]+)', 1)
    return F.coalesce(F.get_json_object(text, f"$.{key}").cast("long"), F.when(number != "", number).cast("long"))


def header_value(page: Column, label: str) -> Column:
    """What follows ``label:`` on a line of its own, null if nothing does."""
    found = F.regexp_extract(page, rf"(?m)^{label}:[ \t]*(\S.*?)\s*$", 1)
    return F.when(found != "", found)


def until_stop(text: Column, stop: str) -> Column:
    """The text before the first stop mark."""
    return F.substring_index(text, stop, 1)


#: What is put before a chunk that is embedded, and the indent it stands at there.
ENRICHED, INDENT = "PSYCHIATRIC MEDICAL RECORD EXTRACT", 20


def enriched(chunk: Column) -> Column:
    """A chunk under its heading, as it is embedded; the indent only goes where the chunk has one line."""
    indent = F.when(chunk.contains("\n"), F.lit(" " * INDENT)).otherwise("")
    return F.concat(indent, F.lit(f"{ENRICHED}\n"), indent, chunk)
