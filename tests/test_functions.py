import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scopewise.functions import extract
from scopewise.functions import labels as L
from scopewise.functions import text as T
from scopewise.functions import vectors as V
from scopewise.functions.chunker import chunk_spans, chunked
from scopewise.functions.sections import sections
from scopewise.functions.tokenizers import Bpe, Unigram, encoder, padded

TEXTS = st.text(alphabet="ab .\n\t!é", max_size=900)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(20, 120), st.integers(0, 15))
def test_chunks_cover_the_text_in_order(text, most, overlap):
    clean = re.sub("[ \t]+", " ", text).strip()
    spans = list(chunk_spans(text, most, overlap))
    assert all(clean[a:b] == c and c == c.strip() and c for c, a, b in spans)
    assert all(len(c) <= most + 2 for c, _, _ in spans)
    assert [a for _, a, _ in spans] == sorted(a for _, a, _ in spans)
    covered = set().union(*(range(a, b) for _, a, b in spans)) if spans else set()
    assert all(clean[i].isspace() for i in set(range(len(clean))) - covered)


def test_chunks_keep_other_columns(spark):
    rows = spark.createDataFrame([(1, "x", "a " * 400), (2, None, None), (3, "z", "  ")], "id int, chunk string, text string")
    out = chunked(rows, "id", "text").orderBy("chunk_idx").collect()
    assert {r.id for r in out} == {1} and len(out) == 2 and out[0].chunk == "x" and out[0].chunk_idx == 0


def test_tokens_and_overlap(spark):
    row = spark.sql("SELECT 'The ICU, icu and äbc 12345 of' AS t, 'ICU stay' AS u, '' AS e").select(
        T.tokens(F.col("t")).alias("t"),
        T.overlap(T.distinct_tokens(F.col("t")), T.distinct_tokens(F.col("u"))).alias("o"),
        T.overlap(T.distinct_tokens(F.col("e")), T.distinct_tokens(F.col("u"))).alias("z"),
    )
    assert tuple(row.first()) == (["the", "icu", "icu", "and", "12345"], 0.5, 0.0)


def test_small_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(T.capitalized(F.lit("aBC d"))) == "Abc d"
    assert value(T.header_value(F.lit("x\nAge at Admission:  77 \ny"), "Age at Admission")) == "77"
    assert value(T.header_value(F.lit("x"), "Age")) is None
    assert value(T.stat(F.lit('{"prompt_tokens": 12}'), "prompt_tokens")) == 12
    assert value(T.stat(F.lit("prompt_tokens = 7, x"), "prompt_tokens")) == 7
    assert value(T.until_stop(F.lit("a<s>b<s>"), "<s>")) == "a"
    assert value(T.truncated(F.lit("x" * 1000), 400)) == "x" * 400 + "..."
    assert value(T.contains_text(F.lit("A  b\nC"), F.lit("a B c..."), 300)) is True
    assert value(T.contains_text(F.lit("A"), F.lit("  "))) is False
    assert value(V.java_hash(F.lit("hello"))) == 99162322
    assert value(V.java_hash(F.lit("zzzzzzzzzz"))) < 1 << 31
    assert value(L.as_flag(F.lit("Yes"))) is True and value(L.as_flag(F.lit("maybe"))) is None
    assert value(L.stay_days(F.lit("2020-01-02 10:00"), F.lit("2020-01-01"))) is None
    assert value(L.stay_days(F.lit("2020-01-02"), F.lit("odd"))) is None
    assert value(L.age_at(F.lit(91), F.lit(2000), F.lit("1990-01-01"))) == 91
    assert value(L.expired(F.lit(None).cast("int"))) is True
    assert value(L.race_group(F.lit("white - other"))) == "White"


def test_vectors_of_odd_shapes_score_zero(spark):
    rows = spark.sql("SELECT array(1f, 0f) a, array(1f, 1f) b, array(0f, 0f) z, array(1f) s, CAST(NULL AS array<float>) n")
    got = rows.select(*[V.cosine(F.col("a"), F.col(c)).alias(c) for c in "bzsn"]).first()
    assert got.b == pytest.approx(0.7071067, abs=1e-6) and (got.z, got.s, got.n) == (0.0, 0.0, 0.0)


def test_sections(spark):
    notes = [
        (1, "Discharge summary", 1, "Allergies:\nnone\nService: MED\nPMH: asthma\nHOSPITAL COURSE:\nfine\n"),
        (1, "Discharge summary", 2, "Allergies: late\nAttending: x\nSocial History:\n\nFamily History: yes"),
        (1, "Radiology", 3, "FINDINGS: clear\n conclusion : ok"),
        (2, "Other kind", 1, "allergies: small letters\nChief Complaint: pain"),
    ]
    rows = spark.createDataFrame(notes, "hadm int, category string, pos int, note string")
    got = {(r.hadm, r.category, r.section): r.content for r in sections(rows, ["hadm"], "category", "note", ["pos"]).collect()}
    assert got == {
        (1, "Discharge summary", "Allergies"): "none",
        (1, "Discharge summary", "Past Medical History"): "asthma",
        (1, "Discharge summary", "Brief Hospital Course"): "fine",
        (1, "Discharge summary", "Family History"): "yes",
        (1, "Radiology", "Findings"): "clear",
        (1, "Radiology", "Impression"): "ok",
        (2, "Other kind", "Chief Complaint"): "pain",
    }


def test_sentences_and_items():
    assert extract.sentences("Seen by Dr. Smith at 3.5 mg b.i.d. daily. Then home! Fine?") == ["Seen by Dr. Smith at 3.5 mg b.i.d. daily.", "Then home!", "Fine?"]
    assert extract.first_item("x\n1. aspirin\n 81 mg\n2. statin", "number") == "1. aspirin 81 mg"
    assert extract.first_item("1. aspirin 2. statin", "number") == "1. aspirin"
    assert extract.first_item("- one", "dash") is None
    assert extract.first_item("- one\n- two", "dash") == "- one"
    assert extract.section_answer("Allergies", " a\n b ") == ("a b", "full")
    assert extract.section_answer("Discharge Medications", "1. aspirin daily\n" + "2. x y\n" * 90) == ("1. aspirin daily", "medication")
    assert extract.section_answer("Other", "x" * 500) == (None, "none")
    assert extract.section_answer("Other", None) == (None, "none")
    assert extract.allergy_answer("NKDA. Lives alone.") == ("Yes", "NKDA.")
    assert extract.allergy_answer("Penicillin") == ("No", "Penicillin")
    assert extract.neutral("Seen at [**Hospital 12**] on [**2101-1-2**] by ___ .") == "Seen at (hospital name removed) on (date removed) by (removed)."
    answer, evidence = extract.clinical_statement("History obtained from chart. HPI: A man with chest pain came to the emergency room.")
    assert answer == evidence == "A man with chest pain came to the emergency room."
    assert extract.clinical_statement("Per records.") is None


def test_tokenizers(spark):
    bpe = Bpe({"a": 1, "b": 2, "ab": 3, "▁": 4, "<0xC3>": 5, "<0xA9>": 6, "abab": 7}, [("a", "b"), ("ab", "ab")], start=9)
    assert bpe.encode("abab aé") == [9, 7, 4, 1, 5, 6]
    unigram = Unigram([("<unk>", 0.0), ("▁a", -1.0), ("▁", -2.0), ("a", -2.0), ("ab", -2.5), ("b", -1.0)], start=8, end=9)
    assert unigram.encode("ab") == [8, 1, 5, 9]
    assert unigram.encode("") == [8, 9] and unigram.encode("ａ") == [8, 1, 9] and unigram.encode("x") == [8, 2, 0, 9]
    assert padded([1, 2, 3], 2, 0) == ([1, 2], [1, 1]) and padded([1], 3, 0) == ([1, 0, 0], [1, 0, 0])
    column = encoder(lambda: Bpe({"a": 1, "b": 2, "ab": 3}, [("a", "b")]), 3)
    assert spark.sql("SELECT 'abb' AS t").select(column(F.col("t")).alias("e")).first().e.asDict() == {"ids": [3, 2, 0], "mask": [1, 1, 0]}


def test_embedders(spark):
    from scopewise.functions import embedders

    def narrow(texts):
        if len(texts[0]) > 30:
            raise embedders.TooLong
        return [[float(len(texts[0])), 1.0]]

    e5 = embedders.Embedder("e5_small", 2, narrow)
    rows = spark.createDataFrame([("abc",), (None,), ("x" * 100,)], "t string")
    assert [r.v for r in rows.select(e5.column(F.col("t"), True).alias("v")).collect()] == [[10.0, 1.0], None, [19.0, 1.0]]
    assert e5.vectors(["abc"], question=False) == [[12.0, 1.0]]
    found = embedders.load({"e5_small": lambda: e5, "broken": lambda: 1 / 0}, "broken")
    assert found.backend == "hash" and embedders.load({"e5_small": lambda: e5}, "e5_small") is e5
    queries, notice = embedders.retrievable(rows, found)
    assert queries.count() == 0 and "'hash'" in notice and embedders.retrievable(rows, e5) == (rows, None)
    sparse = V.hash_embedding(spark.createDataFrame([(1, "The heart, the HEART rate")], "id int, text string"), "id", "text")
    dense = found.embed(["The heart, the HEART rate"])[0]
    assert {r.k: round(r.v, 6) for r in sparse.collect()} == {k: round(x, 6) for k, x in enumerate(dense) if x}
    assert not any(embedders.hash_vectors(["a b"])[0])


def test_texts_are_embedded_together():
    from scopewise.functions import embedders

    calls = []

    def model(texts):
        calls.append(len(texts))
        if any(len(t) > 40 for t in texts):
            raise embedders.TooLong
        return [[float(len(t))] for t in texts]

    plain = embedders.Embedder("other", 1, model)
    assert plain.vectors(["ab", None, "c"] * 20, False) == [[2.0], None, [1.0]] * 20 and calls == [32, 8]
    calls.clear()
    assert plain.vectors(["ab", "x" * 60], False) == [[2.0], [30.0]] and calls == [2, 1, 1, 1]


def test_merges_may_share_a_joined_text():
    merges = [("a", "bc"), ("b", "c"), ("a", "b"), ("ab", "c")]
    words = {"a": 1, "b": 2, "c": 3, "ab": 4, "bc": 5, "abc": 6}
    assert Bpe(words, merges).pieces("abc") == ["abc"] and Bpe(words, merges, joined=True).pieces("abc") == ["abc"]
    assert Bpe(words, merges[:1] + merges[3:]).ranks != Bpe(words, merges[:1] + merges[3:], joined=True).ranks


def test_chunks_of_a_batch_are_made_in_parts():
    import pyarrow as pa

    from scopewise.functions.chunker import AT_ONCE, parts_of

    batch = pa.RecordBatch.from_pydict({"i": list(range(2 * AT_ONCE + 3))})
    parts = list(parts_of(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [AT_ONCE, AT_ONCE, 3] and [i for p in parts for i in p.column(0).to_pylist()] == list(range(2 * AT_ONCE + 3))


def test_sentences_are_read_as_far_as_asked():
    """a first sentence doesn't cut the whole text, and what is looked for at stop marks is what words give."""
    from itertools import islice

    def by_words(text):
        words = text.split()
        closes = lambda a, b: a[-1] in ".!?" and re.match(extract._BEGINS, b) and not ((m := extract._STOPPED.search(a)) and extract._GOES_ON[m.lastgroup](m[m.lastgroup], b))
        ends = [k for k in range(1, len(words)) if closes(words[k - 1], words[k])]
        return [" ".join(words[a:b]) for a, b in zip([0, *ends], [*ends, len(words)], strict=True) if a < b]

    for text in ("", " . ", "A. B saw Dr. X. Then 1. 2 of b.i.d. Pills?  [**Name**] x.\nlast", "No. Yes! été. Éte. 3. x", "One.Two. (x). . . End.", "x.y.z. Next \x85 one? 7"):
        assert extract.sentences(text) == by_words(text)
    marks = 0

    class Counted:
        def finditer(self, line, found=extract._MAY_END):
            nonlocal marks
            for mark in found.finditer(line):
                marks += 1
                yield mark

    had, extract._MAY_END = extract._MAY_END, Counted()
    try:
        text = "This one says what happened to me at length. " * 1000
        assert list(islice(extract.each_sentence(text), 1)) == [extract.first_sentence(text)]
        assert extract.clinical_statement(text)[0] == "This one says what happened to me at length."
        assert extract.informative(text)
        assert marks == 3
    finally:
        extract._MAY_END = had
