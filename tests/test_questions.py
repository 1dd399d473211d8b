from pyspark.sql import Window
from pyspark.sql import functions as F

from scopewise.functions.chunker import chunked, with_chunks
from scopewise.operators import pages, questions
from scopewise.plans import questions as plans
from scopewise.plans import records as record_plans

ADMISSION = "patient_id int, admission_id int, admittime string, dischtime string, diagnosis string, admission_type string, sex string, age int, stay_days int, service string, disposition string, icu boolean, num_diagnoses int, other_diagnosis boolean"


def test_header_candidates_skip_what_is_missing(spark):
    rows = [(1, 10, "2100-01-02 1:00", "2100-01-05", "Asthma", "Urgent", "F", 40, 3, "Surgery", "Home", True, 2, False), (1, 11, None, None, "N/A", " ", None, None, None, None, "Not recorded", None, None, True)]
    got = {}
    for r in questions.header_candidates(spark.createDataFrame(rows, ADMISSION)).collect():
        got.setdefault(r.admission_id, {})[r.subkey] = r
    assert set(got) == {10} and set(got[10]) == set(questions.HEADER) - {"diagnosis_disambiguation"}
    assert got[10]["icu"].answer == "Yes" and got[10]["los"].evidence == "Length of Stay: 3 days"
    assert got[10]["admission_date"].question.endswith("ended on 2100-01-05?")
    apart = questions.header_candidates(spark.createDataFrame(rows[:1], ADMISSION).withColumn("other_diagnosis", F.lit(True)))
    assert {r.subkey for r in apart.collect()} >= {"diagnosis_disambiguation"} and apart.where("subkey = 'diagnosis'").count() == 0


def test_header_questions_explode_answers_and_not_their_wording(spark, sf):
    plan = plans.header_questions(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "struct" not in generate and "my admission" not in generate
    assert "Exchange hashpartitioning(subject_id" in (text := plans.header_questions(spark, sf)._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in text


def test_first_headers_are_the_first_of_header_candidates(spark):
    one = ["2100-01-02 1:00", "2100-01-05", "Asthma", "Urgent", "F", 40, 3, "Surgery", "Home", True, 2, False]
    none = [None, None, None, None, None, None, None, None, "Not recorded", None, None, True]
    rows = spark.createDataFrame([(1, 10, *one), (1, 11, *none), (2, 12, *none[:10], 5, True), (2, 13, *none[:9], False, None, None), (1, 10, *none[:6], 2, *none[7:])], ADMISSION)
    for kind in {k for k, _, _ in questions.HEADER.values()}:
        named = lambda r: questions.with_document(r).withColumn("id", F.col("subkey"))
        want = questions.first_of_kind(named(questions.header_candidates(rows)), kind).select("doc", "subkey", "answer")
        got = questions.first_of_kind(named(questions.first_headers(rows, kind)), kind, ("patient_id", "admission_id")).select("doc", "subkey", "answer")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_negation_candidates_make_no_other_candidates(spark, sf):
    plan = record_plans.negation_candidates(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning(doc" not in plan
    assert "REPARTITION_BY_NUM" in plan


def test_section_candidates(spark):
    long_list = "1. aspirin daily\n" + "\n".join(f"{i}. drug number {i}" for i in range(2, 60))
    rows = [
        ("Discharge summary", "Discharge Medications", long_list), ("Discharge summary", "Allergies", "NKDA"), ("Radiology", "Impression", "All clear."), ("Radiology", "Technique", "none asked"),
        ("Discharge summary", "History of Present Illness", "Per chart. A man of forty came with severe chest pain at night."), ("Discharge summary", "Chief Complaint", "seen at [**Hospital**]"),
    ]
    table = spark.createDataFrame([(1, 10, "2100-01-02 1:00", *r) for r in rows], "patient_id int, admission_id int, admittime string, category string, section string, content string")
    got = {r.section: r for r in questions.section_candidates(table).collect()}
    assert set(got) == {"Discharge Medications", "Allergies", "Radiology: Impression", "History of Present Illness"}
    assert got["Discharge Medications"].answer == "1. aspirin daily" and "listed first" in got["Discharge Medications"].question
    assert got["Allergies"].kind == "negation_check" and got["Allergies"].answer == "Yes"
    assert got["History of Present Illness"].answer == "A man of forty came with severe chest pain at night."


def test_items_are_grounded_and_checked(spark):
    rows = spark.createDataFrame([("d", 1, "ICU Stay: Yes"), ("d", 2, "Later the ICU Stay: Yes again. Impression: clear lungs.")], "doc string, page int, text string")
    ranges = pages.paged(rows, "doc", "page", "text")
    chunks = chunked(pages.document_text(ranges, "doc"), "doc", "text")
    asked = [("header", "icu", "Was I in intensive care?", "Yes", "ICU Stay: Yes"), ("Radiology: Impression", "r", "What did my report say?", "clear lungs.", "clear lungs."), ("header", "x", "Where did I go?", "gone", "gone")]
    candidates = spark.createDataFrame([("d", 1, 10, "k" + a[1], a[1], a[0], a[2], a[3], a[4]) for a in asked], "doc string, patient_id int, admission_id int, kind string, subkey string, section string, question string, answer string, evidence string")
    items = questions.grounded_items(candidates, ranges, chunks)
    assert {(r.id, r.subkey, r.page) for r in items.collect()} == {("P1_H10_Q1", "icu", 1), ("P1_H10_Q2", "r", 2)}
    assert questions.single_violations(items).count() == 0
    bad = items.withColumn("question", F.lit("Who is 123456?")).unionByName(items)
    assert {r.rule for r in questions.single_violations(bad).collect()} == {"not first person", "number in question", "id repeats", "items per document"}


def test_items_of_long_documents_are_those_of_short_ones(spark, monkeypatch):
    """Documents that are gathered, that are dealt by words and buckets, and some of each give the same items."""
    texts = [(f"d{d}", p, f"ICU Stay: Yes. Page {p} of it says alpha{p} beta gamma{d}.") for d in range(3) for p in range(1, 2 + 3 * d)]
    ranges = pages.paged(spark.createDataFrame(texts, "doc string, page int, text string"), "doc", "page", "text")
    chunks = chunked(pages.document_text(ranges, "doc"), "doc", "text", 80, 20)
    asked = [(f"d{d}", d, 10 + d, "k", str(i), "header" if i == 0 else "x", "What was my stay?", e, e) for d in range(3) for i, e in enumerate(("ICU Stay: Yes", "says alpha4 beta", "gone"))]
    candidates = spark.createDataFrame(asked, "doc string, patient_id int, admission_id int, kind string, subkey string, section string, question string, answer string, evidence string")
    found = []
    for few in (64, 4, 0):
        monkeypatch.setattr(pages, "FEW", few)
        found.append(sorted(tuple(r) for r in questions.grounded_items(candidates, ranges, chunks).select("id", "doc", "subkey", "page", "gold").collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 5


def test_pair_wording(spark):
    rows = spark.createDataFrame([(2, 5, "2100-01-01", "2100-02-02", "different", "Asthma")], "value_1 int, value_2 int, date_1 string, date_2 string, relation string, diagnosis string")
    mine = questions.pair_wording(rows, "num_diagnoses").first()
    assert mine.answer.endswith("The number of my recorded diagnoses increased from 2 to 5.") and mine.evidence_2 == "Number of Diagnoses: 5"
    theirs = questions.pair_wording(rows, "num_diagnoses", same_patient=False).first()
    assert '"Asthma"' in theirs.question and theirs.answer.endswith("My family member's admission had more recorded diagnoses than mine.")
    assert questions.pair_wording(rows, "service", same_patient=False).first().answer.endswith("The recorded hospital service differed between us.")
    three = rows.withColumns({"value_3": F.lit(2), "date_3": F.lit("2100-03-03")})
    assert questions.trajectory_wording(three, "service").first().answer.endswith("My hospital service varied across the three hospitalizations.")


def test_multi_violations(spark):
    source = lambda p, a: {"patient_id": p, "admission_id": a}
    rows = [("1", "same_patient_two_admissions", "What was my stay?", [source("p", "1"), source("p", "2")]), ("2", "same_patient_two_admissions", "What was my stay?", [source("p", "2"), source("p", "1")]), ("3", "cross_patient_two_admissions", "What?", [source("p", "1"), source("p", "2")])]
    table = spark.createDataFrame(rows, "id string, comparison_type string, question string, sources array<struct<patient_id:string,admission_id:string>>")
    assert {(r.id, r.rule) for r in questions.multi_violations(table).collect()} == {("1", "repeated source set"), ("2", "repeated source set"), ("3", "sources"), ("3", "not first person")}


def test_attempts(spark):
    rows = spark.createDataFrame([("a", " yes <|im_end|> x", '{"prompt_tokens": 2000, "generated_tokens": 40}', None), ("b", None, None, "broke")], "id string, raw string, stats string, error string")
    got = {r.id: r for r in questions.attempts(rows).collect()}
    assert (got["a"].answer, got["a"].stopped, got["a"].truncated) == ("yes", True, True)
    assert (got["b"].answer, got["b"].stopped, got["b"].truncated, got["b"].error) == ("", False, False, "broke")


def test_chosen_attempts(spark):
    rows = [("a", 0, "", False, None), ("a", 1, "yes", False, None), ("a", 2, "no", False, None), ("b", 0, "cut", True, None), ("b", 1, "", False, None)]
    tried = spark.createDataFrame(rows, "id string, budget int, answer string, truncated boolean, error string")
    assert {r.id: (r.answer, r.retries) for r in questions.chosen_attempts(tried).collect()} == {"a": ("yes", 1), "b": ("", 1)}


def own_and_grounded(admissions):
    """Items of admissions as own_items() and as grounded_items() make them."""
    docs = questions.with_document(admissions).withColumn("text", plans._head())
    ranges = pages.paged(docs.select("doc", F.lit(1).alias("page"), "text"), "doc", "page", "text")
    asked = questions.with_document(questions.header_candidates(admissions))
    return questions.own_items(with_chunks(docs, "text")), questions.grounded_items(asked, ranges, chunked(docs.select("doc", "text"), "doc", "text"))


def test_own_items_are_grounded_items(spark):
    """Heads of one chunk and of several, what can't be asked, and what no chunk holds whole."""
    none = [None, None, None, None, None, None, None, None, "Not recorded", None, None, True]
    rows = [(i, i, f"2100-01-0{i} 1:00", "2100-01-09", d, "Urgent", "F", 40 + i, i, "Team 7", "Home", i % 2 == 0, i, i % 3 == 0) for i, d in enumerate(["Asthma", "  N/A ", " long words of it " * 40, "x" * 700, None, "a  b\tc ", "Sex: F"])]
    rows += [(12345, 8, *none), (9, 123456, "", " ", "Team 7", " ", "", None, 3, "", "Died in hospital", False, 0, False)]
    own, grounded = own_and_grounded(spark.createDataFrame(rows, ADMISSION))
    assert sorted(map(repr, own.select(*grounded.columns).collect())) == sorted(map(repr, grounded.collect())) and own.count() > 50
    assert max(r.n for r in own.groupBy("gold").agg(F.max(F.length("gold")).alias("n")).collect()) > 400
    for changed in (lambda r: r, lambda r: r.where("subkey IN ('sex', 'icu')"), lambda r: r.withColumns({"question": F.concat(F.lit("Who is "), F.col("patient_id").cast("string")), "gold": F.when(F.col("subkey") != "icu", "?")})):
        want = questions.single_violations(changed(grounded)).collect()
        counts = changed(own).withColumns({"n_items": F.count("*").over(Window.partitionBy("doc")), "n_kinds": F.size(F.collect_set("kind").over(Window.partitionBy("doc"))), "number": F.row_number().over(Window.partitionBy("doc").orderBy("number"))})
        assert sorted(map(tuple, questions.own_violations(counts).collect())) == sorted(map(tuple, want)) and want


def test_items_of_the_query_are_not_shuffled(spark, sf):
    """What is staged are admissions; their items, and what these break, are made in their rows."""
    for name in ("question_items", "single_violations"):
        plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert all("hashpartitioning(rule" in line for line in plan.splitlines() if "Exchange" in line) and "Join" not in plan


def test_admissions_that_share_a_document(spark, tmp_path):
    """Orders that repeat, and those that lack a number, share their document: their items are as grounded_items() says."""
    import datetime

    day = datetime.datetime(1995, 1, 2)
    orders = [(1, 10), (1, 10), (2, 10), (3, 11), (None, 11), (None, 11), (None, 12), (4, None)]
    spark.createDataFrame([(o, c, day, "1-URGENT", "O", 1.0) for o, c in orders], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, n, n, 1, day, "R") for k in (1, 2, 3) for n in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"p{i}", "b", 1) for i in (1, 2)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = own_and_grounded(plans._admissions(spark, str(tmp_path)))[1]
    got = plans.question_items(spark, str(tmp_path))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.withColumn("gold_length", F.length("gold")).select(*got.columns).collect())) and got.count() > 30
    rules = questions.single_violations(want).groupBy("rule").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, plans.single_violations(spark, str(tmp_path)).collect())) == sorted(map(tuple, rules.collect()))
