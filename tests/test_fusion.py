"""Fused rankings against all pairs, in many blocks and parts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopewise.operators import fusion, retrieval

CHUNKS, QUERIES = "chunk_id long, scope string, content string, embedding array<float>", "query_id long, scope string, text string, embedding array<float>"


@pytest.fixture(scope="module")
def sides(spark):
    """Scopes of 400 and 30 chunks; ties, missing vectors, vectors of another length, questions without words or scope."""
    rng = np.random.default_rng(3)
    words = [f"term{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    vector = lambda: [float(x) for x in np.round(rng.normal(size=4), 1)]
    chunks = [(i, "big" if i < 400 else "small", text(6) if i % 9 else None, vector() if i % 7 else None) for i in range(430)]
    chunks += [(500, "small", "term1", [1.0]), (501, "big", "term1 term2", [0.0] * 4), (502, "big", "term1 term2", [0.0] * 4)]
    queries = [(i, ("big", "small")[i % 4 == 0], text(4), vector()) for i in range(12)] + [(20, "big", None, vector()), (21, "big", "term0", None), (22, "big", "", None), (23, "none", "term1", vector())]
    return spark.createDataFrame(queries, QUERIES), spark.createDataFrame(chunks, CHUNKS)


def ranked(pairs, k):
    """(query, rank) -> (chunk, score) of score rows, in the order that top() gives."""
    out = {}
    for query in {q for q, *_ in pairs}:
        mine = sorted((-np.float32(round(s, 9)), c, s) for q, c, s in pairs if q == query)[:k]
        out |= {(query, r): (c, round(s, 7)) for r, (_, c, s) in enumerate(mine, 1)}
    return out


def raw_pairs(sides):
    return [(r.query_id, r.chunk_id, r.bm25, r.dense) for r in retrieval.raw_scores(*sides).collect()]


def wanted(sides, method):
    if method == "hybrid":
        lexical = {(r.query_id, r.chunk_id): r.score for r in retrieval.tfidf_scores(*sides).collect()}
        return [(q, c, 50 * d + 0.5 * lexical.get((q, c), 0.0)) for q, c, _, d in raw_pairs(sides)]
    pairs, out = raw_pairs(sides), []
    for query in {q for q, *_ in pairs}:
        mine = [(c, b, d) for q, c, b, d in pairs if q == query]
        if method == "rrf":
            place = lambda at: {x[0]: r for r, x in enumerate(sorted(mine, key=lambda x: (-round(x[at], 12), x[0])), 1)}
            pb, pd = place(1), place(2)
            out += [(query, c, 100 * (1 / (60 + pb[c]) + 1 / (60 + pd[c]))) for c, *_ in mine]
        else:
            scale = lambda x, all_: (x - min(all_)) / (max(all_) - min(all_)) if max(all_) > min(all_) else 0.0
            bs, ds = [b for _, b, _ in mine], [d for *_, d in mine]
            out += [(query, c, 0.5 * scale(d, ds) + 0.5 * scale(b, bs)) for c, b, d in mine]
    return out


@pytest.mark.parametrize("method", ["hybrid", "rrf", "fused"])
def test_fused_in_blocks_as_over_all_pairs(spark, sides, method, monkeypatch):
    monkeypatch.setattr(fusion, "BLOCK_ROWS", 50)
    monkeypatch.setattr(fusion, "PART_ROWS", 4)
    for k in (3, 10):
        rows = getattr(fusion, method)(*sides, k)
        assert sorted(rows.columns) == ["chunk_id", "query_id", "rank", "score"]
        assert {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 7)) for r in rows.collect()} == ranked(wanted(sides, method), k)


def test_few_pairs_leave_a_block(spark, sides):
    """Of 400 chunks that all tie and of 400 that don't, k of each block go on."""
    queries, chunks = sides
    made = fusion._lexical(queries, chunks, "bm25")

    def best(question, ids, lexical, dense):
        import pandas as pd

        at = fusion.best_places(dense, ids, 5)
        return pd.DataFrame({"query_id": question.q_query_id, "chunk_id": ids[at]})

    assert {r.n for r in made.reduced(best, "query_id, chunk_id").groupBy("query_id").agg(F.count("*").alias("n")).collect()} <= {5, 6, 7}
    plan = fusion.hybrid(queries, chunks, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "bm25" not in plan


def test_strings_as_ids(spark, sides):
    queries, chunks = sides
    named = chunks.withColumn("chunk_id", F.format_string("c%05d", "chunk_id"))
    got = {(r.query_id, r["rank"]): int(r.chunk_id[1:]) for r in fusion.rrf(queries, named, 4).collect()}
    assert got == {(r.query_id, r["rank"]): r.chunk_id for r in fusion.rrf(queries, chunks, 4).collect()}


def test_tfidf_terms_are_counted_once_in_all_partitions(spark, monkeypatch):
    """what reads the counts reads them staged, and their tables are dealt in as many partitions as the session shuffles to."""
    from pyspark.sql import functions as F

    from scopewise.operators import retrieval

    seen = []
    monkeypatch.setattr(retrieval, "staged", lambda rows, name, staged=retrieval.staged: seen.append((name, rows._jdf.queryExecution().toString())) or staged(rows, name))
    chunks = spark.range(40).select(F.col("id").alias("chunk_id"), (F.col("id") % 2).alias("scope"), F.lit("one two two three").alias("content"))
    queries = spark.range(2).select(F.col("id").alias("query_id"), F.col("id").alias("scope"), F.lit("two four").alias("text"))
    asked, weighed = retrieval.tfidf_sides(queries, chunks)
    assert [name for name, _ in seen] == ["counts", "df"]
    assert "REPARTITION_BY_NUM" in seen[0][1] and "REPARTITION_BY_NUM" in weighed._jdf.queryExecution().toString()
    assert {len(r.terms) for r in weighed.collect()} == {1} and weighed.count() == 40


def test_tfidf_lists_asked_terms_only(spark):
    """lengths are one number a chunk over all terms; counts are neither put in order for their df nor listed if nobody asks for them."""
    chunks = spark.createDataFrame([(1, "p", "one two two three"), (2, "p", "four four"), (3, "q", "two"), (4, "p", "a b c")], "chunk_id long, scope string, content string")
    queries = spark.createDataFrame([(1, "p", "two four five")], "query_id long, scope string, text string")
    _, weighed = retrieval.tfidf_sides(queries, chunks)
    got = {r.chunk_id: {t.term: round(t.w, 9) for t in r.terms} for r in weighed.collect()}
    idf = math.log(3 / 2) + 1
    two = idf / math.sqrt(idf**2 + 2 * (idf / 2) ** 2)
    assert got == {1: {"two": round(two, 9)}, 2: {"four": 1.0}, 3: {}}
    plan = weighed._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "wanted" not in plan
