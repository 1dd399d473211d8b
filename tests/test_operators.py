import json
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scopewise.functions.chunker import chunked
from scopewise.operators import assignment, candidates, cohort, context, fusion, metrics, pages, questions, records, retrieval, store
from scopewise.plans import cohort as cohort_plans
from scopewise.plans import evaluation
from scopewise.plans import records as record_plans
from scopewise.sources import readers


def test_zero_scores_fill_the_list(spark):
    chunks = spark.createDataFrame([(i, "p", "nothing here") for i in range(1, 9)] + [(9, "p", "cardiac catheter")], "chunk_id long, scope string, content string")
    queries = spark.createDataFrame([(1, "p", "catheter result"), (2, "p", ""), (3, "q", "catheter")], "query_id long, scope string, text string")
    for method in (retrieval.bm25, retrieval.tfidf):
        got = {}
        for r in method(queries, chunks, 4).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id
        assert got == {1: {1: 9, 2: 1, 3: 2, 4: 3}, 2: {1: 1, 2: 2, 3: 3, 4: 4}}


def test_chunks_of_long_documents_keep_their_own_ids(spark):
    rows = spark.createDataFrame([(1, 10_000, "cardiac catheter"), (2, 0, "nothing here"), (2, 1, "nor here")], "doc_id long, chunk_idx int, content string")
    chunks = rows.select(evaluation.chunk_id().alias("chunk_id"), F.lit("p").alias("scope"), "content")
    queries = spark.createDataFrame([(1, "p", "catheter")], "query_id long, scope string, text string")
    found = retrieval.bm25(queries, chunks, 3).join(chunks, "chunk_id").orderBy("rank").collect()
    assert [(*r.chunk_id, r.content) for r in found] == [(1, 10_000, "cardiac catheter"), (2, 0, "nothing here"), (2, 1, "nor here")]


def test_missing_vectors_score_zero_in_hybrids(spark):
    chunks = spark.createDataFrame([(1, "p", "alpha", [1.0, 0.0]), (2, "p", "beta", None), (3, "p", "alpha", [0.0, 1.0])], "chunk_id long, scope string, content string, embedding array<float>")
    queries = spark.createDataFrame([(1, "p", "alpha", [1.0, 0.0])], "query_id long, scope string, text string, embedding array<float>")
    raw = {r.chunk_id: (r.bm25 > 0, r.dense) for r in retrieval.raw_scores(queries, chunks).collect()}
    assert raw == {1: (True, 1.0), 2: (False, 0.0), 3: (True, 0.0)}
    assert [r.chunk_id for r in fusion.rrf(queries, chunks, 3).orderBy("rank").collect()] == [1, 2, 3]  # 2 and 3 tie
    assert [r.chunk_id for r in retrieval.dense(queries, chunks, 3).orderBy("rank").collect()] == [1, 3]
    best = fusion.rrf(queries, chunks, 3).orderBy("rank").first().score
    assert math.isclose(best, 100 * (1 / 61 + 1 / 61))


def brute(relevance: list[bool]) -> dict:
    hits = [i for i, x in enumerate(relevance, 1) if x]
    gain = lambda places: sum(math.log(2) / math.log(i + 1) for i in places)
    return {
        "hit_at_3": int(any(relevance[:3])),
        "precision_at_3": sum(relevance[:3]) / 3,
        "reciprocal_rank": 1 / hits[0] if hits else 0.0,
        "average_precision": sum((n + 1) / i for n, i in enumerate(hits)) / len(hits) if hits else 0.0,
        "ndcg_at_3": gain(i for i in hits if i <= 3) / gain(range(1, min(len(hits), 3) + 1)) if hits else 0.0,
    }


def test_metrics_against_brute_force(spark):
    lists = [[bool(n >> k & 1) for k in range(5)] for n in range(32)]
    rows = spark.createDataFrame([(i, k, x) for i, row in enumerate(lists) for k, x in enumerate(row, 1)], "item int, rank int, relevant boolean")
    for r in metrics.item_metrics(rows, ["item"]).collect():
        want = brute(lists[r["item"]])
        assert all(math.isclose(r[k], v, abs_tol=1e-9) for k, v in want.items())


def test_scored_answer(spark):
    value, passed = metrics.scored_answer(F.col("s"), F.col("a"))
    rows = spark.createDataFrame([(0.8, "x"), (0.9, " "), (0.7, "y"), (0.9, None)], "s double, a string").select(value.alias("v"), passed.alias("p"))
    assert [tuple(r) for r in rows.collect()] == [(0.8, True), (0.0, False), (0.7, False), (0.0, False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcdef"), min_size=2), min_size=1, max_size=14))
def test_assignment_is_valid_and_even(sets):
    available = dict(enumerate(sets))
    chosen = assignment.balanced_types(available)
    assert all(len(v) == 2 and v <= available[k] for k, v in chosen.items())
    load = {t: sum(t in v for v in chosen.values()) for t in "abcdef"}
    for v, k in ((v, k) for k, v in chosen.items()):  # no single swap makes it more even
        assert all(load[a] - load[b] < 2 for a in v for b in available[k] - v)


def test_polarity_is_rebalanced():
    available = {i: {"negation_check", "a", "b"} for i in range(8)}
    chosen = {i: {"negation_check", "a"} if i < 4 else {"a", "b"} for i in range(8)}
    out = assignment.rebalanced_polarity(chosen, available, {i: "Yes" if i < 4 else "No" for i in range(8)})
    held = [i for i, v in out.items() if "negation_check" in v]
    assert len(held) == 4 and abs(sum(i < 4 for i in held) - 2) <= 1
    assert sorted(t for v in out.values() for t in v) == sorted(t for v in chosen.values() for t in v)


def test_concrete_choice_prefers_distinct_evidence_and_subkeys():
    c = lambda i, e, s, k: {"id": i, "evidence": e, "section": s, "page": 1, "subkey": k}
    found = assignment.concrete({1: {"a", "b"}}, {(1, "a"): [c("1", "x", "s", "k")], (1, "b"): [c("2", "x", "s", "k"), c("3", "y", "t", "k")]})
    assert [f["id"] for f in found] == ["1", "3"]


def test_stratified_sample_follows_shares(spark):
    people = spark.createDataFrame([(i, "m" if i % 4 else "f") for i in range(200)], "id int, sex string")
    chosen = cohort.select_stratified(people, "id", ["sex"], 40)
    assert len(set(chosen)) == 40 and sum(i % 4 == 0 for i in chosen) == 10
    assert chosen == cohort.select_stratified(people, "id", ["sex"], 40)
    assert sorted(cohort.select_stratified(people, "id", ["sex"], 500)) == list(range(200))


def test_first_by_takes_first_values_not_rows(spark):
    rows = spark.createDataFrame([(1, 1, None, "x"), (1, 2, "b", "y")], "k int, t int, a string, b string")
    assert tuple(cohort.first_by(rows, ["k"], ["t"], ["a", "b"]).first()) == (1, "b", "x")


def test_selection_keeps_caps_and_balance(spark):
    rows = [(f"s{s}", f"g{s % 3}", s // 3, f, "same", f"{s}{f}", f != "icu" or s % 2 == 0) for s in range(12) for f in ("icu", "service")]
    found = candidates.select_balanced(spark.createDataFrame(rows, "source_set string, group string, priority int, field string, relation string, rank string, grounded boolean"), 2)
    assert len(found) == 6 and max(sum(r["group"] == g for r in found) for g in ("g0", "g1", "g2")) == 2
    assert abs(sum(r["field"] == "icu" for r in found) - 3) <= 1


def test_a_balanced_choice_by_ranges_is_the_folds(spark):
    """Sets of one to three members, some not grounded, in ranges of seven: what the fold on the driver chooses."""
    rng = random.Random(8)
    rows = [(f"s{s}", f"g{s % 9}", s % 4, f, rng.choice(["same", "different"]), f"{rng.random():.12f}", rng.random() < 0.8) for s in range(60) for f in rng.sample(["icu", "service", "diagnosis"], rng.randrange(1, 4))]
    table = spark.createDataFrame(rows, "source_set string, group string, priority int, field string, relation string, rank string, grounded boolean")
    want = sorted((r["source_set"], r["group"], r["field"], r["relation"]) for r in candidates.select_balanced(table, 5))
    assert sorted(map(tuple, candidates.balanced_choice(table, 5, 7).collect())) == want and len(want) > 30
    assert candidates.balanced_choice(table.limit(0), 5).count() == 0


def test_pages(spark):
    rows = pages.paged(spark.createDataFrame([(1, 1, "ab  c "), (1, 2, None), (1, 3, "Evidence HERE")], "doc int, page int, text string"), "doc", "page", "text")
    assert [(r.page, r.start, r.end) for r in rows.orderBy("page").collect()] == [(1, 0, 4), (2, 5, 5), (3, 6, 19)]
    found = pages.text_pages(spark.createDataFrame([(1, "evidence  here"), (1, "absent")], "doc int, evidence string"), rows, "doc")
    assert {r.evidence: r.page for r in found.collect()} == {"evidence  here": 3, "absent": None}
    spans = pages.span_pages(spark.createDataFrame([(1, "a", 3, 8), (1, "b", 90, 95)], "doc int, k string, start int, end int"), rows, "doc", ["k"])
    assert {r.k: (r.pages, r.page) for r in spans.collect()} == {"a": ([1, 2, 3], 1), "b": ([3], 3)}
    at = pages.point_page(spark.createDataFrame([(1, 7), (1, 4)], "doc int, at int"), rows, "doc", "at")
    assert {r["at"]: r.page for r in at.collect()} == {7: 3, 4: None}
    items = spark.createDataFrame([("x", 1, "ab c"), ("y", 1, "ab c"), ("y", 1, "gone")], "item string, doc int, evidence string")
    assert [r["item"] for r in pages.grounded(items, rows, "doc").collect()] == ["x"]


def test_packing_fits_the_window():
    blocks = [f"[Patient {i}]: " + "x" * 600 for i in range(12)]
    for budget in context.BUDGETS:
        taken = context.packed("What?", blocks, *budget)
        prompt = context.FACTUAL["chatml"].format(system=context.SYSTEM, notes="\n\n".join(f"- {c}" for c in taken), question="What?")
        assert math.ceil(len(prompt) / budget[1]) <= context.WINDOW_TOKENS - budget[0]
    assert context.packed("What?", [], *context.BUDGETS[0]) == []


def test_prompts_without_chunks(spark):
    queries = spark.createDataFrame([(1, "Why?")], "query_id long, text string")
    none = spark.createDataFrame([], "query_id long, rank int, score double, content string, date string, kind string")
    row = context.prompts(queries, none).first()
    assert context.NO_NOTES in row.prompt and row.header == context.NO_CHUNK and row.retrieved == 0
    text = context.conversation_prompt(F.lit("Hi"), F.lit(None).cast("string"), F.lit("Old"), F.lit("User: a"))
    assert queries.select(text.alias("t")).first().t == "BACKGROUND KNOWLEDGE\nPatient Summary: Old\n\nRECENT DIALOGUE\nUser: a\n\nCURRENT USER MESSAGE \nHi"


def test_store_search(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "chunk_id long, embedding array<float>")
    queries = rows.where("chunk_id < 3").withColumnRenamed("chunk_id", "query_id")
    exact = store.knn(queries, rows, 5, "l2")
    assert exact.where("rank = 1 AND distance > 0").count() == 0 and exact.count() == 15
    assert metrics.recall(store.lsh_knn(queries, rows, 5, threshold=20.0, bucket=50.0), exact).agg(F.min("recall")).first()[0] >= 0.8
    assert store.of_dimension(rows, 3).count() == 60 and store.of_dimension(rows, 4).count() == 0


def test_hashed_search_is_sparks_own_without_its_pairs(spark, monkeypatch):
    """The same neighbours as Spark's join of buckets; only the k best of a block are shuffled, with no vector."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(store, "BLOCK_ROWS", 70)
    monkeypatch.setattr(store, "PART_ROWS", 9)
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)], "chunk_id long, embedding array<float>")
    queries = rows.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    got = store.lsh_knn(queries, rows, 7, threshold=2.5, bucket=0.7, tables=2)
    side = lambda df, key: df.select(key, array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("vector"))
    index = side(rows, "chunk_id")
    model = BucketedRandomProjectionLSH(inputCol="vector", outputCol="hashes", bucketLength=0.7, numHashTables=2, seed=7).fit(index)
    want = {}
    for r in model.approxSimilarityJoin(side(queries, "query_id"), index, 2.5, "distance").collect():
        want.setdefault(r.datasetA.query_id, []).append((round(r.distance, 9), r.datasetB.chunk_id))
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got.collect()) == sorted((q, i + 1, c) for q, x in want.items() for i, (_, c) in enumerate(sorted(x)[:7]))
    assert "datasetB" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_upsert_replaces_documents(spark):
    old = spark.createDataFrame([("p", "d", 1), ("p", "d", 2), ("p", "e", 3)], "patient string, doc string, v int")
    new = spark.createDataFrame([("p", "d", 9), ("q", "d", 8)], "patient string, doc string, v int")
    assert sorted(r.v for r in store.upsert(old, new, ["patient", "doc"]).collect()) == [3, 8, 9]


def test_the_whole_choice_keeps_two_types_and_evens_polarity():
    kinds = ("negation_check", "section_lookup", "header_fact", "specific_detail")
    made = lambda k, kind, n: {"id": f"{k}-{kind}-{n}", "kind": kind, "subkey": f"s{n}", "section": f"s{n}", "page": n, "answer": ("Yes" if k % 4 else "No") if kind == "negation_check" else f"{kind} {n}", "gold": f"g{n}", "yes_no": kind == "negation_check"}
    found = {(k, kind): [made(k, kind, n) for n in range(2)] for k in range(8) for kind in kinds}
    items = assignment.selected(found)
    per = defaultdict(set)
    for c in items:
        per[c["key"]].add(c["kind"])
    assert len(items) == 16 and all(len(v) == 2 for v in per.values())
    assert max(Counter(c["kind"] for c in items).values()) - min(Counter(c["kind"] for c in items).values()) <= 1
    polar = Counter(c["answer"] for c in items if c["kind"] == "negation_check")
    assert abs(polar["Yes"] - polar["No"]) <= 2
    for k in per:  # no pair of equal answers, chunks or sections where others could be had
        a, b = (c for c in items if c["key"] == k)
        assert a["answer"] != b["answer"] and a["gold"] != b["gold"] and a["section"] != b["section"]
    with pytest.raises(ValueError, match="two types"):
        assignment.chosen_pairs({1: {"a"}}, {(1, "a"): [made(1, "a", 0)]}, 2)


def test_pair_cost_against_all_pairs():
    """The first admission's pair is the least of the nine-part costs."""
    rng = random.Random(3)
    one = lambda kind, n: {"id": f"{kind}{n}", "kind": kind, "subkey": rng.choice("xy"), "section": rng.choice("pq"), "page": rng.randint(1, 2), "answer": rng.choice(["a b", "A-B", "c"]), "gold": rng.choice("gh"), "yes_no": rng.random() < 0.5}
    for _ in range(50):
        found = {(1, k): [one(k, n) for n in range(4)] for k in ("a", "b")}
        got = assignment.chosen_pairs({1: {"a", "b"}}, found, 2, yes_no_share=0.0)
        plain = lambda t: t.replace("-", " ").lower()
        want = min(((x, y) for x in found[1, "a"] for y in found[1, "b"]), key=lambda z: (plain(z[0]["answer"]) == plain(z[1]["answer"]), z[0]["gold"] == z[1]["gold"], z[0]["section"] == z[1]["section"], z[0]["yes_no"] or z[1]["yes_no"], 0, 0, z[0]["page"] == z[1]["page"], z[0]["id"], z[1]["id"]))
        assert [c["id"] for c in got] == [c["id"] for c in want]


def test_saved_messages_and_error_rates(spark, tmp_path):
    saved = {"messages": json.dumps([{"text": "a", "role": "user"}, {"text": "b"}]), "logs": "[]"}
    (tmp_path / "prefs.json").write_text(json.dumps(saved))
    read = lambda key: [(r.text, r.role) for r in readers.read_saved(spark, str(tmp_path / "prefs.json"), key, "text string, role string").collect()]
    assert read("messages") == [("a", "user"), ("b", None)] and read("logs") == read("absent") == []
    runs = spark.createDataFrame([("x", False, None), ("x", False, "e"), ("x", True, None), ("y", True, None)], "condition string, skipped boolean, error string")
    got = {r.condition: (r["items"], r.skipped, r.errors, r.error_rate) for r in questions.error_rate(runs).collect()}
    assert got == {"x": (3, 1, 1, 0.5), "y": (1, 1, 0, None)}


def test_records_leave_out_what_has_no_notes(spark, tmp_path):
    people = spark.createDataFrame([(1, "F"), (2, "M")], "subject_id int, gender string")
    stays = spark.createDataFrame([(1, 12, "2100-02-01"), (1, 11, "2100-01-01"), (1, 13, "2100-03-01"), (2, 21, "2100-01-01")], "subject_id int, hadm_id int, admittime string")
    notes = spark.createDataFrame([(1, 11, "b", "Radiology", None, None, 2, " x\n"), (1, 11, "a", "Discharge summary", "DS", "2100", None, "y"), (1, 12, "c", "Odd", None, "", 1, "z"), (1, 13, "d", "Odd", None, "", 1, None)], "subject_id int, hadm_id int, note_id string, category string, label string, charttime string, note_seq int, text string")
    details = spark.createDataFrame([("a", {"author": "Q"})], "note_id string, details map<string,string>")
    ordered = records.in_order(records.with_details(notes, details), ["Discharge summary", "Radiology"])
    rows = records.patient_records(people, stays, ordered)
    rows.write.json(str(tmp_path / "sample"))
    got = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "sample")).collect()]
    assert [g["patient_info"] for g in got] == [{"subject_id": 1, "gender": "F"}]
    stay, other = got[0]["admissions"]
    assert (stay["hadm_id"], other["hadm_id"]) == (11, 12) and [n["note_id"] for n in stay["notes"]] == ["a", "b"] and stay["notes"][1]["text"] == "x"
    assert stay["note_categories"] == {"Discharge summary": 1, "Radiology": 1} and stay["notes"][0]["details"] == {"author": "Q"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcde"), max_size=5), max_size=40), st.integers(1, 3))
def test_shares_are_as_even_as_the_fold(sets, each):
    sizes = Counter(tuple(sorted(s)) for s in sets)
    got = assignment.balanced_shares(dict(sizes), each)
    for types, uses in got.items():
        assert sum(uses.values()) == min(each, len(types)) * sizes[types] and all(0 <= n <= sizes[types] for n in uses.values())
    fold = assignment.balanced_types(dict(enumerate(sets)), each)
    cost = lambda load: sum(n * n for n in load.values())
    assert cost(sum((Counter(u) for u in got.values()), Counter())) == cost(Counter(t for types in fold.values() for t in types))


def test_types_are_dealt_back(spark):
    rng = random.Random(5)
    rows = [(i, rng.sample("abcd", rng.randint(0, 4))) for i in range(500)] + [(500, None)]
    got = {r.key: r.types for r in assignment.assigned(spark.createDataFrame(rows, "key long, types array<string>"), "key", "types").collect()}
    assert got.keys() == {i for i, _ in rows}
    for i, types in rows:
        assert len(set(got[i])) == len(got[i]) == min(2, len(types or [])) and set(got[i]) <= set(types or [])
    load, fold = Counter(t for v in got.values() for t in v), assignment.balanced_types({i: set(v or ()) for i, v in rows})
    assert sum(n * n for n in load.values()) == sum(n * n for n in Counter(t for v in fold.values() for t in v).values())


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-9, 9)), max_size=60))
def test_places_are_exact_order_statistics(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v int")
    places = lambda n: [0, n // 3, n - 1]
    ordered = sorted(values, key=lambda v: (v is not None, v or 0))
    assert cohort.at_places(rows, "v", places) == ([ordered[at] for at in places(len(ordered))] if ordered else [None] * 3)


def test_places_in_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 5000).select((F.col("id") * 7919 % 1009).alias("v"))
        ordered = sorted(i * 7919 % 1009 for i in range(5000))
        assert cohort.at_places(rows, "v", lambda n: [0, 1, n // 2, n - 2, n - 1]) == [ordered[at] for at in (0, 1, 2500, 4998, 4999)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_knn_in_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(store, "BLOCK_ROWS", 30)
    monkeypatch.setattr(store, "PART_ROWS", 4)
    rng = random.Random(5)
    vectors = [(i, [round(rng.gauss(0, 1), 1) for _ in range(3)]) for i in range(200)] + [(i, [1.0, 0.0, 0.0]) for i in range(200, 230)] + [(300, None), (301, [1.0, None, 1.0]), (302, [1.0, 2.0]), (303, [0.0] * 3)]
    rows = spark.createDataFrame(vectors, "chunk_id long, embedding array<float>")
    asked = rows.where("chunk_id % 20 = 0 OR chunk_id > 299").withColumnRenamed("chunk_id", "query_id")
    sound = {i: v for i, v in vectors if v is not None and None not in v}

    def far(a, b):
        if metric == "l2":
            return math.dist(a, b)
        size = math.hypot(*a) * math.hypot(*b)
        return 1 - sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 1.0

    got = defaultdict(list)
    for r in store.knn(asked, rows, 5, metric).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, r.distance))
    assert sorted(got) == [i for i in sorted(sound) if i % 20 == 0 or i > 299]
    for q, found in got.items():
        want = sorted(far(sound[q], v) for v in sound.values() if len(v) == len(sound[q]))[:5]
        assert [d for _, d in found] == pytest.approx(want, abs=1e-5) and len({i for i, _ in found}) == len(found)
    if metric == "l2":
        assert [i for i, _ in got[200]] == [200, 201, 202, 203, 204]


def test_long_documents_meet_their_evidence_as_short_ones(spark, monkeypatch):
    """The same pages and gold chunks, whether documents are gathered, dealt by words and buckets, or some of each."""
    rng = random.Random(4)
    texts = [(d, p, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "w%d" % rng.randrange(9)]) for _ in range(25))) for d in range(3) for p in range(1, 2 + 3 * d)]
    ranges = pages.paged(spark.createDataFrame(texts, "doc int, page int, text string"), "doc", "page", "text")
    chunks = chunked(pages.document_text(ranges, "doc"), "doc", "text", 90, 30)
    asked = spark.createDataFrame([(d, t[low : low + n]) for d, _, t in texts for low, n in ((0, 40), (7, 21), (3, 5))] + [(0, None), (1, " "), (7, "alpha")], "doc int, evidence string").distinct()
    found = []
    for few in (64, 4, 0):
        monkeypatch.setattr(pages, "FEW", few)
        paged = pages.text_pages(asked, ranges, "doc")
        gold = pages.gold_chunks(paged.where("page IS NOT NULL"), chunks, ranges, "doc")
        found.append([sorted(map(repr, map(tuple, rows.collect()))) for rows in (paged, gold)])
    assert found[0] == found[1] == found[2] and len(found[0][1]) > 20


def test_words_are_shuffled_without_their_text(spark):
    ranges = pages.paged(spark.createDataFrame([(1, 1, "a b c d")], "doc int, page int, text string"), "doc", "page", "text")
    few = pages.text_pages(spark.createDataFrame([(1, "b c")], "doc int, evidence string"), ranges, "doc")
    assert few.collect()[0].page == 1
    words = pages.text_pages_by_words(spark.createDataFrame([(1, "b c d")], "doc int, _wanted string"), ranges.select("doc", "page", F.col("text").alias("flat")), "doc")
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert words.collect()[0].page == 1 and not [line for line in plan.splitlines() if "Project [" in line and "_word#" in line and "_wanted#" in line.split("Project [")[1]]


def test_text_pages_meet_by_rare_words(spark):
    """Against containment in every page: cut words at both ends, short evidence, blanks, dots, repeated rows, other documents."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)] + ["the"] * 30
    texts = {(d, p): " ".join(rng.choice(words) for _ in range(40)).replace("w7 ", "W7 \n ") for d in range(3) for p in range(1, 7)}
    asked = []
    for (d, _), text in list(texts.items()):
        low = rng.randrange(0, 60)
        asked += [(d, text[low : low + n]) for n in (3, 9, 40, 200)] + [((d + 1) % 3, text[low : low + 30])]
    asked += [(0, ""), (0, None), (1, "   "), (1, "the"), (2, "nowhere at all here"), (2, texts[2, 1][:20] + "......"), (9, "the"), asked[0], asked[0]]
    ranges = spark.createDataFrame([(d, p, t) for (d, p), t in texts.items()], "doc int, page int, text string")
    line = lambda t: " ".join(t.split()).lower()

    def page(d, part):
        wanted = line(re.sub(r"(\.\.\.)+$", "", part or "")[:300])
        return min((p for (e, p), t in texts.items() if e == d and wanted and wanted in line(t)), default=None)

    got = pages.text_pages(spark.createDataFrame(asked, "doc int, evidence string"), ranges, "doc").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, e, page(d, e))) for d, e in asked)


def test_terms_are_counted_where_they_are(spark):
    """No shuffle, chunks without a term once, and the counts of a plain count."""
    texts = ["the cat the dog", None, "a b", "cat CAT cat-dog", "one1 two"]
    chunks = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "chunk_id long, scope string, content string")
    rows = retrieval.counted_terms(chunks)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r.chunk_id, r.term): (r.tf, r.dl, r.most, r.pos) for r in rows.collect()}
    assert got == {
        (0, "cat"): (1, 4, 2, 0), (0, "dog"): (1, 4, 2, 1), (0, "the"): (2, 4, 2, 2), (1, None): (None, 0, None, None), (2, None): (None, 0, None, None),
        (3, "cat"): (3, 4, 3, 0), (3, "dog"): (1, 4, 3, 1), (4, "one1"): (1, 2, 1, 0), (4, "two"): (1, 2, 1, 1),
    }
    assert {(r.chunk_id, r.term): r.tf for r in retrieval.term_counts(chunks).collect()} == {k: v[0] for k, v in got.items() if k[1]}


def test_unmatched_admissions_in_as_many_partitions_as_shuffles_have(spark, tmp_path):
    spark.createDataFrame([(k, 1) for k in (1, 2, 2, 3, None)], "o_orderkey long, o_custkey long").selectExpr("*", "timestamp '2024-01-01' AS o_orderdate", "'' AS o_orderpriority", "'' AS o_orderstatus", "0d AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, 1) for k in (3, 3, 4, 4, None)], "l_orderkey long, l_partkey long").selectExpr("*", "1 AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "p", "b", 1)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rows = cohort_plans.missing_admissions(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(1, "missing"), (2, "missing"), (2, "missing"), (None, "missing"), (4, "unexpected"), (None, "unexpected")], key=str)


def test_all_text_pages_shuffle_evidence_by_document_only(spark, sf):
    held = spark.createDataFrame([("1", 1, "One  two"), ("1", 2, ""), ("1", 3, "three FOUR"), ("1", 4, "five"), ("2", 1, "two"), ("3", 1, "")], "doc string, page int, text string")
    ranges = pages.paged(held, "doc", "page", "text")
    asked = [("1", 1, "two\n three"), ("1", 2, "one two three four five..."), ("1", None, "four"), ("1", 4, " "), ("1", 5, None), ("2", 6, "three"), ("3", 7, "two"), ("4", 8, "two"), (None, 9, "two"), ("2", 10, "two"), ("2", 10, "two")]
    got = pages.all_text_pages(spark.createDataFrame(asked, "doc string, n int, evidence string"), ranges, "doc")
    want = [[1, 3], [1, 3, 4], [3], [], [], [], [], [], [], [1], [1]]
    assert sorted(map(repr, ((r.doc, r.n, r.pages) for r in got.collect()))) == sorted(map(repr, ((d, n, w) for (d, n, _), w in zip(asked, want, strict=True))))
    plan = record_plans.text_all_pages(spark, sf)._jdf.queryExecution().executedPlan().toString()
    keys = set(re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan))
    assert keys and all(re.fullmatch(r"doc_id#\d+L", key) for key in keys)
    assert plan.count("Exchange hashpartitioning") == 2


def test_all_text_pages_look_for_all_of_a_long_text(spark):
    """Texts that are the same for 300 characters and more are told apart by what follows, and touch all of their pages."""
    same = "the same words again " * 20
    held = spark.createDataFrame([("1", 1, f"{same}\nend of one"), ("1", 2, same), ("1", 3, "end of two"), ("1", 4, "more")], "doc string, page int, text string")
    asked = [("1", 1, f"{same} end of one"), ("1", 2, f"{same}end of two more..."), ("1", 3, f"{same} end of three"), ("1", 4, same)]
    got = pages.all_text_pages(spark.createDataFrame(asked, "doc string, n int, evidence string"), pages.paged(held, "doc", "page", "text"), "doc")
    assert {r.n: r.pages for r in got.collect()} == {1: [1], 2: [2, 3, 4], 3: [], 4: [1]}


def test_notes_get_their_details_at_their_admission(spark):
    rows = [(1, 10, 5, "B", "l", None, 1, " b "), (1, 10, 4, "A", "l", "t", None, "a"), (1, 11, 6, "A", "l", "t", 1, None), (None, 12, 7, "A", "l", "t", 1, "x"), (2, 13, None, "A", "l", "t", 1, "y"), (2, 13, 5, "C", "l", "t", 1, "z"), (2, 13, 5, "C", "l", "t", 1, "z")]
    notes = spark.createDataFrame(rows, "subject_id long, hadm_id long, note_id long, category string, label string, charttime string, note_seq int, text string")
    details = spark.createDataFrame([(5, {"author": "x", "exam": "e"}), (6, {"author": "y"}), (7, {"author": "z"}), (9, {"author": "q"})], "note_id long, details map<string,string>")
    want, got = records.in_order(records.with_details(notes, details), ["A", "B"]), records.in_order_with_details(notes, details, ["A", "B"])
    assert got.schema["notes"].dataType.simpleString() == want.schema["notes"].dataType.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_header_scores_are_rounded_as_in_sql(spark):
    """Halves by the exact binary value, to even where it is a half."""
    import duckdb

    rng = random.Random(7)
    halves = [0.0, 2.675, 1.005, 3.125, 3.375, 0.005, 0.015, 0.045, 0.055, 0.995, 9.995, 99.995, 7.999, 0.004999, 1e-6, 12.345, 31.415, 8.5, -0.125, -2.675, 1e6 + 0.625]
    scores = [*halves, *[rng.randrange(10**4) + (rng.randrange(100) * 10 + 5) / 1000 for _ in range(400)], *[round(rng.uniform(0, 60), 6) for _ in range(400)]]
    rows = [(i, 1, s, "x", "", "note") for i, s in enumerate(scores)] + [(9000, 1, float("nan"), "x", "", "note")]
    ranked = spark.createDataFrame(rows, "query_id int, rank int, score double, content string, date string, kind string")
    got = {r.query_id: re.search(r"Coherence: \*\*(.*?)\*\*", r.header)[1] for r in context.header(ranked).collect()}
    assert got.pop(9000) == "NaN"
    want = [duckdb.execute("SELECT format('{:.2f}', ?::DOUBLE)", [s]).fetchall()[0][0] for s in scores]
    assert [got[i] for i in range(len(scores))] == want and got[1] == "2.67" and got[3] == "3.12"
