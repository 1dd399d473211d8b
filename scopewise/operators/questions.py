"""Question items: single-record candidates, multi-record wording, checks, statistics and generator conditions.

Candidates are template projections: one array of structs per admission or section, exploded once. Grounding joins
them to pages and chunks; checks are queries whose rows are the violations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopewise.functions.extract import extracts
from scopewise.functions.text import clean_text, contains_text, document_name, first_person, leaks_id, looked_up, one_line
from scopewise.operators import pages
from scopewise.operators.context import FACTUAL, SYSTEM, filled_in
from scopewise.sources.staging import staged

# Question wording. {stay} names the admission.
HEADER = {  # subkey: (kind, question, evidence label)
    "diagnosis": ("header_fact", "What was the main problem I was admitted for in {stay}?", "Principal Diagnosis"),
    "admission_type": ("header_fact", "Was I admitted as an emergency, as a planned admission, or in another way in {stay}?", "Type"),
    "sex": ("header_fact", "Am I recorded as male or female in {stay}?", "Sex"),
    "admission_date": ("header_fact", "When was I admitted for the hospital stay that ended on {end}?", "Admission Date"),
    "age": ("header_fact_enriched", "How old was I when I was admitted in {stay}?", "Age at Admission"),
    "los": ("header_fact_enriched", "How many days did I stay in the hospital during {stay}?", "Length of Stay"),
    "service": ("header_fact_enriched", "Which medical team or specialty looked after me during {stay}?", "Hospital Service"),
    "disposition": ("header_fact_enriched", "Where did I go after leaving the hospital at the end of {stay}?", "Discharge Disposition"),
    "icu": ("header_fact_enriched", "Was I treated in intensive care at any point during {stay}?", "ICU Stay"),
    "num_diagnoses": ("header_fact_enriched", "How many separate diagnoses were listed in my medical record for {stay}?", "Number of Diagnoses"),
    "diagnosis_disambiguation": ("multi_admission_distractor", "I was admitted to the hospital more than once. Looking only at {stay}, what was my main problem or diagnosis?", "Principal Diagnosis"),
}
SECTION = {  # section: (question for all of it, question for its first unit)
    "Chief Complaint": ("What symptoms or problems did I present with at the start of {stay}?", "What is my first complaint recorded at {stay}?"),
    "Discharge Condition": ("How was my health condition described when I was sent home after {stay}?", "What is the first detail noted about my health condition at discharge for {stay}?"),
    "Medications on Admission": ("Which medicines was I already taking when I arrived for {stay}?", "Which medicine is listed first among the drugs I was already taking at {stay}?"),
    "Discharge Medications": ("Which medicines was I instructed to take after leaving the hospital following {stay}?", "Which medicine is listed first in the treatment I was given to continue after {stay}?"),
    "Past Medical History": ("What health problems or medical history did I have before {stay}?", "Which pre-existing condition is recorded first in my medical history for {stay}?"),
    "Brief Hospital Course": ("What procedures or clinical events happened to me during {stay}?", "How does the summary of my hospital course begin for {stay}?"),
    "Radiology: Impression": ("What was the overall conclusion of my imaging report during {stay}?", "What is the first conclusion stated in my imaging report during {stay}?"),
    "Radiology: Findings": ("What did my imaging study show during {stay}?", "What is the first finding described in my imaging report during {stay}?"),
    "Nursing: Assessment": ("How did the nurses assess my condition during {stay}?", "What is the first observation in the nurses' assessment of me during {stay}?"),
    "Nursing: Plan": ("What was my nursing care plan during {stay}?", "What is the first step of my nursing care plan during {stay}?"),
    "Physician: Assessment and Plan": ("What was my doctors' assessment and plan for me during {stay}?", "How does my doctors' assessment and plan begin for {stay}?"),
    "Consult: Impression": ("What was the consulting specialist's impression of my condition during {stay}?", "How does the consulting specialist's impression of my condition begin for {stay}?"),
    "Consult: Recommendations": ("What did the specialist who was consulted about me recommend during {stay}?", "What was the first recommendation the consulting specialist made for me during {stay}?"),
}
HISTORY = "How does the clinical narrative of my illness begin in the record of {stay}?"
ALLERGY = "Does my medical record for {stay} state that I have no known allergies?"
FIELDS = {"icu": ("intensive care (ICU) status", "ICU Stay"), "service": ("hospital service", "Hospital Service"), "diagnosis": ("principal diagnosis", "Principal Diagnosis"), "num_diagnoses": ("number of recorded diagnoses", "Number of Diagnoses")}
CLOSED_BOOK = "You are a factual medical question-answering assistant. Answer the question using your own medical knowledge - no clinical notes are provided for this question. Be concise and answer directly - do not add disclaimers, warnings, or commentary. If you cannot answer confidently, say so briefly."
NO_DESTINATION = ("Died in hospital", "Not recorded")
NOT_NAMED = ("", "n/d", "n/a")
FULL_CONTEXT, WINDOW_TOKENS, MARGIN = 3000, 2048, 8


def stay_of(admitted: Column) -> Column:
    day = F.substring_index(F.coalesce(admitted, F.lit("")), " ", 1)
    return F.when(day == "", F.lit("my admission")).otherwise(F.concat(F.lit("my admission beginning on "), day))


def header_answers(admissions: DataFrame) -> dict[str, Column]:
    """An admission's answer by subkey, null where it can't be asked; admissions as header_candidates() says."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    named = F.when(~F.lower(F.trim("diagnosis")).isin(*NOT_NAMED), F.trim("diagnosis"))
    return {
        "diagnosis": F.when(~F.col("other_diagnosis"), named),
        "admission_type": text("admission_type"),
        "sex": text("sex"),
        "admission_date": F.nullif(F.substring_index("admittime", " ", 1), F.lit("")),
        "age": text("age"),
        "los": F.concat(text("stay_days"), F.lit(" days")),
        "service": text("service"),
        "disposition": F.when(~F.col("disposition").isin(*NO_DESTINATION), F.col("disposition")),
        "icu": F.when(F.col("icu"), "Yes").when(~F.col("icu"), "No"),
        "num_diagnoses": text("num_diagnoses"),
        "diagnosis_disambiguation": F.when(F.col("other_diagnosis"), named),
    }


def header_candidates(admissions: DataFrame, columns: list[str] = ("patient_id", "admission_id")) -> DataFrame:
    """(columns, kind, subkey, section, question, answer, evidence) from an admission's attributes.

    admissions: admittime, dischtime, diagnosis, admission_type, sex, age, stay_days, service, disposition, icu,
    num_diagnoses and other_diagnosis (whether the patient has another admission with another diagnosis). Where the
    diagnosis can be asked apart from other admissions, it is not asked plainly.

    Answers, and what names the admission, are made once for each; only they are exploded, and wording is looked up by
    their place. An array of worded candidates would name the admission anew in each.
    """
    answers = header_answers(admissions)
    held = admissions.select(*columns, *_named(), *[answers[key].alias(f"_{key}") for key in HEADER])
    made = held.select(*columns, "_stay", "_end", F.posexplode(F.array(*[f"_{key}" for key in HEADER])).alias("_at", "answer")).where("answer IS NOT NULL")
    q = _header_wording(list(HEADER), F.col("_at"))
    return made.select(*columns, q["kind"], q["subkey"], F.lit("header").alias("section"), q["question"], "answer", F.concat(q["label"], "answer").alias("evidence"))


def _named() -> list[Column]:
    """_stay and _end: what names an admission in its questions."""
    return [stay_of(F.col("admittime")).alias("_stay"), F.coalesce(F.nullif(F.substring_index("dischtime", " ", 1), F.lit("")), F.lit("discharge")).alias("_end")]


def _header_wording(keys: list[str], at: Column) -> dict[str, Column]:
    """kind, subkey, question and label of the header question at a place of keys, for an admission with _stay and _end."""
    wording = [dict(kind=HEADER[key][0], subkey=key, label=f"{HEADER[key][2]}: ", **_place(HEADER[key][1])) for key in keys]
    q = {name: F.get(F.array(*[F.lit(w[name]) for w in wording]), at) for name in wording[0]}
    question = F.concat(q["before"], F.when(q["place"] == "stay", F.col("_stay")).otherwise(F.col("_end")), q["after"])
    return {"kind": q["kind"].alias("kind"), "subkey": q["subkey"].alias("subkey"), "question": question.alias("question"), "label": q["label"]}


def _place(question: str) -> dict[str, str]:
    """The wording of a header question: its one place, stay or end, and what is before and after it."""
    before, place, after = re.fullmatch(r"([^{]*)\{(stay|end)\}([^{]*)", question).groups()
    return {"before": before, "place": place, "after": after}


def first_headers(admissions: DataFrame, kind: str, columns: list[str] = ("patient_id", "admission_id")) -> DataFrame:
    """(columns, kind, subkey, answer): of header_candidates(), the first of a kind by subkey for each row of admissions that has one; the others are not made."""
    answers = header_answers(admissions)
    first = F.coalesce(*[F.when(answers[key].isNotNull(), F.struct(F.lit(key).alias("subkey"), answers[key].alias("answer"))) for key in sorted(HEADER) if HEADER[key][0] == kind])
    return admissions.select(*columns, F.lit(kind).alias("kind"), first.alias("_q")).where("_q IS NOT NULL").select(*columns, "kind", "_q.*")


def section_candidates(sections: DataFrame, columns: list[str] = ("patient_id", "admission_id")) -> DataFrame:
    """The same from sections(columns, admittime, category, section, content); other categories are named in front."""
    name = F.when(F.col("category") == "Discharge summary", F.col("section")).otherwise(F.concat_ws(": ", "category", "section"))
    rows = sections.select(*columns, stay_of(F.col("admittime")).alias("stay"), name.alias("section"), "content")
    rows = rows.where(F.col("section").isin(*SECTION, "History of Present Illness", "Allergies")).withColumn("x", extracts("section", "content"))

    def asked(place: int) -> Column:
        out = F.lit(None).cast("string")
        for section, wording in SECTION.items():
            out = F.when(F.col("section") == section, filled_in(wording[place], stay=F.col("stay"))).otherwise(out)
        return out

    def made(kind: str, question: Column, answer: str, evidence: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col("section").alias("subkey"), "section", question.alias("question"), F.col(f"x.{answer}").alias("answer"), F.col(f"x.{evidence}").alias("evidence"))

    chosen = (
        F.when(F.col("section") == "History of Present Illness", made("specific_detail", filled_in(HISTORY, stay=F.col("stay")), "statement", "statement_evidence"))
        .when(F.col("section") == "Allergies", made("negation_check", filled_in(ALLERGY, stay=F.col("stay")), "allergy", "allergy_evidence"))
        .otherwise(made("section_lookup", F.when(F.col("x.mode") == "full", asked(0)).otherwise(asked(1)), "answer", "answer"))
    )
    found = rows.select(*columns, "content", chosen.alias("q")).select(*columns, "content", "q.*")
    marked = F.col("answer").rlike(r"\[\*\*|_{3,}")
    return found.where(F.col("answer").isNotNull() & ~marked & contains_text(F.col("content"), F.col("evidence"))).drop("content")


def item_id(number: Column) -> Column:
    return F.format_string("P%s_H%s_Q%d", F.col("patient_id").cast("string"), F.col("admission_id").cast("string"), number)


def own_items(admissions: DataFrame) -> DataFrame:
    """grounded_items() of header_candidates(), of admissions that each have a document of one page for themselves: doc, text and chunks (with_chunks()) are beside what header_candidates() reads.

    A document meets its candidates in its row, and they are numbered there: nothing is shuffled. Each item has n_items and
    n_kinds, its document's, and number, its own.
    """
    keys, answers = sorted(HEADER, key=lambda key: (HEADER[key][0], key)), header_answers(admissions)
    clean, own = clean_text(F.coalesce("text", F.lit(""))), ["patient_id", "admission_id", "doc"]
    page = F.struct(F.lit(1).alias("page"), F.lit(0).alias("start"), F.length(clean).alias("end"), F.lower(one_line(clean)).alias("flat"))
    chunks = F.transform("chunks", lambda c: F.struct(c["content"].alias("content"), c["start"].alias("start"), c["end"].alias("end"), F.lower(one_line(c["content"])).alias("flat")))
    # exploding the one struct keeps Spark from making what it holds anew in each place that reads it
    held = F.struct(F.array(page).alias("pages"), chunks.alias("chunks"), F.array(*[answers[key] for key in keys]).alias("answers"))
    rows = admissions.select(*own, *_named(), F.explode_outer(F.array(held)).alias("_d"))
    pages_, chunks = F.col("_d.pages"), F.col("_d.chunks")
    evidence = lambda a, at: F.concat(F.get(F.array(*[F.lit(f"{HEADER[key][2]}: ") for key in keys]), at), a)
    found = F.filter(F.transform("_d.answers", lambda a, at: F.struct(at.alias("at"), a.alias("answer"), evidence(a, at).alias("evidence"))), lambda q: q["answer"].isNotNull())
    found = F.transform(found, lambda q: F.struct(q.alias("q"), looked_up(q["evidence"], pages.LOOKED_UP).alias("page_wanted"), looked_up(q["evidence"]).alias("wanted")))
    found = F.filter(F.transform(found, lambda x: F.struct(x["q"].alias("q"), x["wanted"].alias("wanted"), pages.first_page(pages_, x["page_wanted"]).alias("page"))), lambda x: x["page"] == 1)
    found = F.filter(F.transform(found, lambda x: F.struct(x["q"].alias("q"), x["page"].alias("page"), pages.best_chunk(chunks, pages_, x["page"], x["wanted"]).alias("gold"))), lambda x: x["gold"].isNotNull())
    rows = rows.select(*own, "_stay", "_end", found.alias("_items"))
    kinds = F.array_distinct(F.transform("_items", lambda x: F.get(F.array(*[F.lit(HEADER[key][0]) for key in keys]), x["q"]["at"])))
    rows = rows.select(*own, "_stay", "_end", F.size("_items").alias("n_items"), F.size(kinds).alias("n_kinds"), F.posexplode_outer("_items").alias("_place", "_x")).where("_x IS NOT NULL")
    rows = rows.select(*own, "_stay", "_end", "n_items", "n_kinds", (F.col("_place") + 1).alias("number"), "_x.q.at", "_x.q.answer", "_x.q.evidence", "_x.page", "_x.gold")
    q = _header_wording(keys, F.col("at"))
    return rows.select(*own, q["kind"], q["subkey"], F.lit("header").alias("section"), q["question"], "answer", "evidence", "page", "gold", item_id(F.col("number")).alias("id"), "number", "n_items", "n_kinds")


def grounded_items(candidates: DataFrame, ranges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with page and gold chunk: headers on page 1, others on the first page that holds the evidence.

    ranges(doc, page, text, start, end) and chunks(doc, content, start, end); candidates have doc. What no chunk
    holds is left out. Items are numbered by kind and subkey within their document.

    All are shuffled once, by document, and meet there; documents of many pages or chunks as text_pages() and gold_chunks() say.
    """

    def numbered(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("doc").orderBy("kind", "subkey")
        rows = rows.where("section <> 'header' OR page = 1").select(*candidates.columns, "page", "gold")
        return rows.withColumn("id", item_id(F.row_number().over(order)))

    wanted = {"_page_wanted": looked_up(F.col("evidence"), pages.LOOKED_UP), "_wanted": looked_up(F.col("evidence"))}
    flat = ranges.withColumn("flat", F.lower(one_line(F.col("text"))))
    held = staged(pages.gathered_with_chunks(flat, chunks, "doc", "page", "start", "end", "flat"), "gathered")
    met = candidates.withColumns(wanted).join(held, "doc")
    found = met.where("few").withColumn("page", pages.first_page(F.col("_pages"), F.col("_page_wanted"))).where("page IS NOT NULL")
    found = found.withColumn("gold", pages.best_chunk(F.col("_chunks"), F.col("_pages"), F.col("page"), F.col("_wanted"))).where("gold IS NOT NULL")
    if held.where("NOT few").isEmpty():
        return numbered(found)
    rest = met.where("NOT few").select(*candidates.columns)
    paged = pages.text_pages(rest.select("doc", "evidence").distinct(), ranges, "doc").where("page IS NOT NULL")
    rest = rest.join(pages.gold_chunks(paged, chunks, ranges, "doc"), ["doc", "evidence"])
    return numbered(found).unionByName(numbered(rest))  # a document is on one side


# Wording of multi-record questions and answers. What is said last, by whose admissions and how the values stand.
SAID = {
    "own": {
        "same": "My recorded {label} was the same.",
        "different": "My recorded {label} differed.",
        "all the same": "My {label} remained consistent across all three hospitalizations.",
        "not all the same": "My {label} varied across the three hospitalizations.",
    },
    "own number": {
        "same": "The number of my recorded diagnoses remained unchanged.",
        "more later": "The number of my recorded diagnoses increased from {a} to {b}.",
        "fewer later": "The number of my recorded diagnoses decreased from {a} to {b}.",
    },
    "family": {
        "same": "The recorded {label} was the same for both of us.",
        "different": "The recorded {label} differed between us.",
    },
    "family number": {
        "same": "Both of our admissions had the same number of recorded diagnoses.",
        "more later": "My family member's admission had more recorded diagnoses than mine.",
        "fewer later": "My admission had more recorded diagnoses than my family member's.",
    },
}
ASKED = {
    "own": "During my hospitalizations beginning on {date_1} and {date_2}, what was my {label} in each, and was it the same or different?",
    "family": 'I keep my family member\'s hospital records together with mine. We were both hospitalized with the principal diagnosis "{diagnosis}": my stay began on {date_1} and theirs began on {date_2}. '
    "What was the {label} for each of us, and was it the same or different?",
    "three": "Across my hospitalizations beginning on {date_1}, {date_2}, and {date_3}, what was my {label} at each hospitalization, and did it remain consistent or vary across the three?",
}
ANSWERED = {
    "own": "My hospitalization beginning {date_1}: {shown}: {a}; my hospitalization beginning {date_2}: {shown}: {b}. ",
    "family": "My hospitalization beginning {date_1}: {shown}: {a}; my family member's hospitalization beginning {date_2}: {shown}: {b}. ",
    "three": "My hospitalization beginning {date_1}: {shown}: {a}; my hospitalization beginning {date_2}: {shown}: {b}; my hospitalization beginning {date_3}: {shown}: {c}. ",
}


def _worded(rows: DataFrame, field: str, whose: str, standing: Column, said: str, **places: Column) -> DataFrame:
    """rows with question and answer, filled in from the tables of wording; standing names what is said last."""
    label, shown = map(F.lit, FIELDS[field])
    places |= {"label": label, "shown": shown, **{c: F.col(c) for c in rows.columns if c.startswith("date_") or c == "diagnosis"}}
    last = F.coalesce(*[F.when(standing == way, filled_in(text, **places)) for way, text in SAID[said].items()])
    return rows.withColumns({"question": filled_in(ASKED[whose], **places), "answer": F.concat(filled_in(ANSWERED[whose], **places), last)})


def pair_wording(rows: DataFrame, field: str, same_patient: bool = True) -> DataFrame:
    """rows(value_1, value_2, date_1, date_2, relation[, diagnosis]) with question, answer, evidence_1, evidence_2."""
    whose, shown = "own" if same_patient else "family", FIELDS[field][1]
    first, second = (F.col(f"value_{k}") for k in (1, 2))
    counted = field == "num_diagnoses"
    standing = F.when(second > first, "more later").when(second < first, "fewer later").otherwise("same") if counted else F.col("relation")
    a, b = first.cast("string"), second.cast("string")
    out = _worded(rows, field, whose, standing, f"{whose} number" if counted else whose, a=a, b=b)
    return out.withColumns({f"evidence_{k}": F.concat(F.lit(f"{shown}: "), x) for k, x in ((1, a), (2, b))})


def trajectory_wording(rows: DataFrame, field: str) -> DataFrame:
    """rows(value_1.., date_1.. of three admissions) with question and answer."""
    values = [F.col(f"value_{k}") for k in (1, 2, 3)]
    alike = F.size(F.array_distinct(F.array(*values))) == 1
    standing = F.when(alike, "all the same").otherwise("not all the same")
    return _worded(rows, field, "three", standing, "own", **dict(zip("abc", [v.cast("string") for v in values], strict=True)))


def _broken(most: int) -> Column:
    """The rules that an item breaks by itself."""
    rules = {
        "not first person": ~first_person(F.col("question")),
        "number in question": leaks_id(F.col("question")),
        "patient in question": F.col("question").contains(F.col("patient_id").cast("string")) & (F.length(F.col("patient_id").cast("string")) > 4),
        "no gold chunk": F.coalesce(F.trim("gold"), F.lit("")) == "",
        "gold chunk too long": F.length("gold") > most,
        "evidence not in gold": ~contains_text(F.col("gold"), F.col("evidence")),
    }
    return F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]), lambda x: x.isNotNull())


def own_violations(items: DataFrame, each: int = 2, most: int = 500) -> DataFrame:
    """single_violations() of own_items(): a document's counts are in its items, whose ids are its own and numbered, so nothing is shuffled."""
    counts = (F.col("number") == 1) & ((F.col("n_items") != each) | (F.col("n_kinds") != each))
    ids = F.transform(_broken(most), lambda r: F.struct(F.col("id").alias("id"), r.alias("rule")))
    both = F.concat(ids, F.when(counts, F.array(F.struct(F.col("doc").alias("id"), F.lit("items per document").alias("rule")))).otherwise(F.array().cast("array<struct<id:string,rule:string>>")))
    return items.select(F.explode_outer(both).alias("b")).where("b IS NOT NULL").select("b.*")


def single_violations(items: DataFrame, each: int = 2, most: int = 500) -> DataFrame:
    """(rule, id) of each breach: ids, first person, leaks, gold chunk, items and kinds per document.

    Items are judged once; what the three counts read of them is staged.
    """
    judged = staged(items.select("id", F.col("doc").cast("string").alias("doc"), "kind", _broken(most).alias("broken")), "judged")
    rows = judged.select("id", F.explode("broken").alias("rule"))
    twice = judged.groupBy("id").count().where("count > 1").select("id", F.lit("id repeats").alias("rule"))
    per = judged.groupBy("doc").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("k")).where(f"n <> {each} OR k <> {each}").select(F.col("doc").alias("id"), F.lit("items per document").alias("rule"))
    return rows.unionByName(twice).unionByName(per)


def multi_violations(items: DataFrame) -> DataFrame:
    """(rule, id) over items(id, comparison_type, question, sources): source counts, patients, repeats."""
    wanted = {"same_patient_two_admissions": (2, 1), "same_patient_three_admission_trajectory": (3, 1), "cross_patient_two_admissions": (2, 2)}
    people, stays = F.size(F.array_distinct("sources.patient_id")), F.size(F.array_distinct(F.transform("sources", lambda s: F.struct(s["patient_id"], s["admission_id"]))))
    fits = F.lit(False)
    for kind, (n, p) in wanted.items():
        fits = fits | ((F.col("comparison_type") == kind) & (F.size("sources") == n) & (people == p) & (stays == n))
    key = F.array_join(F.array_sort(F.transform("sources", lambda s: F.concat_ws("/", s["patient_id"], s["admission_id"]))), "|")
    we = F.col("question").rlike(r"\b(?:I|me|my|mine|myself|we|us|our)\b")
    rows = items.withColumn("_n", F.count("*").over(Window.partitionBy("comparison_type", key)))
    broken = F.array(F.when(~fits, "sources"), F.when(F.col("_n") > 1, "repeated source set"), F.when(~we, "not first person"))
    return rows.select("id", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def question_stats(items: DataFrame) -> DataFrame:
    """(stat, value, n): kinds, yes and no answers, pages, sections, subkeys and short answers in one pass."""
    facts = {
        "kind": F.col("kind"),
        "polarity": F.when(F.lower(F.trim("answer")).isin("yes", "no"), F.initcap(F.trim("answer"))),
        "page": F.col("page").cast("string"),
        "section": F.col("section"),
        "subkey": F.concat_ws("/", "kind", "subkey"),
        "short": F.when(F.length("answer") < 4, F.lit("short")),
    }
    rows = items.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), c.alias("value")) for k, c in facts.items()])).alias("f")).select("f.*")
    return rows.where("value IS NOT NULL").groupBy("stat", "value").agg(F.count("*").alias("n"))


def length_stats(items: DataFrame, column: str) -> DataFrame:
    """Per kind: shortest, mean and longest length of a column, and how many subkeys there are."""
    n = F.length(column)
    return items.groupBy("kind").agg(F.min(n).alias("shortest"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("longest"), F.count_distinct("subkey").alias("subkeys"), F.count("*").alias("n"))


def first_of_kind(candidates: DataFrame, kind: str, by: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Each document's first candidate of a kind, by id; ``by``: the columns that name a document."""
    rows = candidates.where(F.col("kind") == kind)
    return rows.groupBy(*by).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in by]), "id").alias("c")).select(*by, "c.*")


def united(*families: DataFrame) -> DataFrame:
    """Items of all task families; what a family lacks is null."""
    out = families[0]
    for rows in families[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def error_rate(runs: DataFrame) -> DataFrame:
    """Per condition over runs(condition, skipped, error): items, skipped ones, errors, and errors per item that was run."""
    out = runs.groupBy("condition").agg(F.count("*").alias("items"), F.count_if("skipped").alias("skipped"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return out.withColumn("error_rate", F.when(F.col("items") > F.col("skipped"), F.col("errors") / (F.col("items") - F.col("skipped"))))


def kind_availability(candidates: DataFrame) -> DataFrame:
    """(kinds, documents): how many documents offer how many kinds."""
    return candidates.groupBy("doc").agg(F.count_distinct("kind").alias("kinds")).groupBy("kinds").agg(F.count("*").alias("documents"))


def conditions(items: DataFrame, documents: DataFrame, template: str = "chatml") -> DataFrame:
    """(id, condition, prompt, skipped): closed book, gold evidence and the first of the whole document."""
    notes = lambda c: F.concat(F.lit("- "), c)
    rows = items.join(documents.select("doc", F.col("text").alias("_text")), "doc", "left")
    factual = lambda text: filled_in(FACTUAL[template], system=F.lit(SYSTEM), notes=notes(text), question=F.col("question"))
    closed = filled_in(FACTUAL[template].replace("CLINICAL NOTES:\n{notes}\n\n", ""), system=F.lit(CLOSED_BOOK), question=F.col("question"))
    blank = F.coalesce(F.trim("_text"), F.lit("")) == ""
    made = F.array(
        F.struct(F.lit("closed_book").alias("condition"), closed.alias("prompt"), F.lit(False).alias("skipped")),
        F.struct(F.lit("oracle_evidence").alias("condition"), factual(F.col("gold")).alias("prompt"), F.lit(False).alias("skipped")),
        F.struct(F.lit("full_context").alias("condition"), F.when(~blank, factual(F.substring("_text", 1, FULL_CONTEXT))).alias("prompt"), blank.alias("skipped")),
    )
    return rows.select("id", F.explode(made).alias("c")).select("id", "c.*")


def attempts(outputs: DataFrame, stop: str = "<|im_end|>", keep: tuple[str, ...] = ()) -> DataFrame:
    """outputs(id, raw, stats, error) with answer (cut at the stop mark), token counts and whether it was cut off; and the columns to keep."""
    from scopewise.functions.text import stat, stripped

    prompt, made = stat(F.col("stats"), "prompt_tokens"), stat(F.col("stats"), "generated_tokens")
    return outputs.select(
        "id", stripped(F.substring_index(F.coalesce("raw", F.lit("")), stop, 1)).alias("answer"), F.coalesce(F.col("raw").contains(stop), F.lit(False)).alias("stopped"), prompt.alias("prompt_tokens"),
        made.alias("generated_tokens"), F.coalesce(prompt + made >= WINDOW_TOKENS - MARGIN, F.lit(False)).alias("truncated"), "error", *keep,
    )


def chosen_attempts(tried: DataFrame) -> DataFrame:
    """One row per id of tried(id, budget, answer, truncated, error): the first clean attempt, else the last; with retries."""
    clean = (F.coalesce("answer", F.lit("")) != "") & ~F.col("truncated") & F.col("error").isNull()
    order = Window.partitionBy("id").orderBy(F.when(clean, F.col("budget")).asc_nulls_last(), F.desc("budget"))
    return tried.withColumn("_n", F.row_number().over(order)).where("_n = 1").withColumn("retries", F.col("budget")).drop("_n")


def with_document(rows: DataFrame) -> DataFrame:
    """rows(patient_id, admission_id) with the name of their document."""
    return rows.withColumn("doc", document_name(F.col("patient_id"), F.col("admission_id")))
