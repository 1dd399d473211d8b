"""Indexes that are written, grown and read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopewise.operators import hnsw, postings, retrieval
from scopewise.sources.staging import new_folder


def rows_of(spark, vectors, scope, first=0):
    return spark.createDataFrame([(first + i, scope, [float(x) for x in v]) for i, v in enumerate(vectors)], "chunk_id long, scope string, embedding array<float>")


def exact(vectors, queries, k, metric):
    if metric == "l2":
        far = np.sqrt(((vectors[None] - queries[:, None]) ** 2).sum(axis=2))
    else:
        far = 1 - (queries @ vectors.T) / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None])
    return np.argsort(far, axis=1, kind="stable")[:, :k], np.sort(far, axis=1)[:, :k]


@pytest.mark.parametrize("metric", hnsw.METRICS)
def test_layers_reach_recall(metric):
    """3,000 points entered at once, and in three parts through saved rows: recall@10 of 0.95 at least."""
    import pandas as pd

    rng = np.random.default_rng(0)
    vectors = (rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2, (3000, 1))).astype(np.float32)
    rows = pd.DataFrame({"chunk_id": np.arange(3000), "scope": "s", "embedding": list(vectors), "node": np.nan, "links": None})
    held = rows.iloc[:0]
    for part in (slice(0, 1500), slice(1500, 2900), slice(2900, 3000)):
        held = hnsw._grown(metric)(pd.concat([held, rows.iloc[part]]))
        assert held.node.tolist() == list(range(len(held)))
    layers = hnsw._loaded(held, metric)
    assert max(layers.levels) >= 1 and all(len(level) <= hnsw.LINKS * (1 if at else 2) for links in layers.links for at, level in enumerate(links))
    want = exact(vectors, vectors[::30], 10, metric)[0]
    ids = held.chunk_id.to_numpy()
    got = [set(ids[layers.nearest(vectors[q], 10, hnsw.VIEW)]) for q in range(0, 3000, 30)]
    assert sum(len(g & set(w)) for g, w in zip(got, want, strict=True)) >= 0.95 * 10 * len(want)


def test_a_saved_index_grows_and_is_searched(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(300, 8)).astype(np.float32), rng.normal(size=(60, 8)).astype(np.float32)
    index = hnsw.Index(spark, new_folder(spark, "hnsw-test"), dims=8, shard_rows=100)
    assert not index.exists()
    index.insert(rows_of(spark, a[:200], "a"))
    assert index.size()[0] == 200 and index.rows().select("shard").distinct().count() == 2
    index.insert(rows_of(spark, a[100:], "a", 100).unionByName(rows_of(spark, b, "b", 1000)))
    unsound = spark.createDataFrame([(7000, "a", None), (7001, "a", [1.0] * 7), (7002, "a", [float("nan")] * 8), (7003, None, [1.0] * 8), (7004, "c", [0.0] * 8)], "chunk_id long, scope string, embedding array<float>")
    index.insert(unsound)
    points, size = index.size()
    assert points == 361 and size > 361 * 8 * 4  # the zero vector is one
    asked = rows_of(spark, a[:20], "a").withColumnRenamed("chunk_id", "query_id").unionByName(rows_of(spark, b[:5], "b", 500).withColumnRenamed("chunk_id", "query_id"))
    asked = asked.unionByName(spark.createDataFrame([(900, "nowhere", [1.0] * 8), (901, "c", [1.0] * 8), (902, "a", None)], asked.schema))
    got = {}
    for r in index.search(asked, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.distance, r.score))
    assert sorted(got) == [*range(20), *range(500, 505), 901] and got[901] == [(7004, 1.0, 50.0)]
    want = exact(a, a[:20], 10, "cosine")
    hit = sum(len({i for i, *_ in got[q]} & set(want[0][q])) for q in range(20))
    assert hit >= 0.95 * 200 and all(len(v) == 10 for q, v in got.items() if q != 901)
    assert all(np.isclose(score, (1 - d / 2) * 100) for v in got.values() for _, d, score in v)
    assert all({i for i, *_ in got[500 + q]} == {1000 + int(i) for i in exact(b, b[q : q + 1], 10, "cosine")[0][0]} for q in range(5))


@pytest.mark.parametrize("metric", hnsw.METRICS)
def test_an_exact_search_finds_what_copies_hide(spark, metric):
    """Each vector comes 100 times: a graph of LINKS links joins copies to copies, and misses others."""
    rng = np.random.default_rng(3)
    vectors = np.repeat(rng.normal(size=(12, 6)), 100, axis=0).astype(np.float32)[rng.permutation(1200)]
    index = hnsw.Index(spark, new_folder(spark, "hnsw-copies"), metric, shard_rows=700)
    index.insert(rows_of(spark, vectors, "s"))
    found = index.search(rows_of(spark, vectors[:20], "s").withColumnRenamed("chunk_id", "query_id"), 110, exact=True).orderBy("query_id", "rank").collect()
    for q in range(20):
        v, p = vectors.astype(np.float64), vectors[q].astype(np.float64)
        far = np.sqrt(((v - p) ** 2).sum(axis=1)) if metric == "l2" else 1 - (v @ p) / (np.linalg.norm(v, axis=1) * np.linalg.norm(p))
        assert [r.chunk_id for r in found if r.query_id == q] == np.lexsort((np.arange(1200), np.round(far, 5)))[:110].tolist()


def test_a_search_reads_only_the_folders_of_its_scopes(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, f"s{i % 40}", [float(x) for x in rng.normal(size=4)]) for i in range(400)], "chunk_id long, scope string, embedding array<float>")
    index = hnsw.Index(spark, new_folder(spark, "hnsw-pruned"), "l2")
    index.insert(rows)
    found = index.search(rows.where("chunk_id = 3").withColumnRenamed("chunk_id", "query_id"), 5)
    assert found.count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_levels_thin_out():
    levels = [hnsw.level_of(i) for i in range(20_000)]
    assert 0.04 < sum(x > 0 for x in levels) / 20_000 < 0.09 and max(levels) >= 2


def corpus(n, seed=0):
    """Chunks of three scopes (one has two thirds), with common and rare words; one without words, one of a null text."""
    rng = np.random.default_rng(seed)
    words = np.array([f"word{i}" for i in range(300)])
    share = 1 / np.arange(1, 301)
    rows = [(i, ("hot", "hot", "cold")[i % 3], f"d{i // 4}", " ".join(rng.choice(words, rng.integers(5, 60), p=share / share.sum()))) for i in range(n)]
    return [*rows, (n, "cold", "blank", "a b"), (n + 1, "hot", None, None), (n + 2, None, "x", "word1"), (n + 3, "alone", "y", "word1 word1")]


CHUNKS, ASKED = "chunk_id long, scope string, document string, content string", "query_id long, scope string, text string"


def asked_of(spark):
    texts = ["word0 word7 word250", "word299 word1", "word3", "nothing here", "", None, "word120 word121 word122 word0"]
    return spark.createDataFrame([(i * 10 + j, scope, t) for i, scope in enumerate(("hot", "cold", "alone", "none")) for j, t in enumerate(texts)], ASKED)


def same_as_bm25(spark, index, rows, k=10):
    chunks = spark.createDataFrame([r for r in rows if r[1] is not None], CHUNKS)
    want = retrieval.bm25(asked_of(spark), chunks, k).select("query_id", "chunk_id", F.round("score", 8), "rank").collect()
    got = index.search(asked_of(spark), k).select("query_id", "chunk_id", F.round("score", 8), "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_postings_search_as_bm25(spark):
    rows = corpus(400)
    index = postings.PostingIndex(spark, new_folder(spark, "postings-test"), range_chunks=16)
    index.upsert(spark.createDataFrame(rows, CHUNKS))
    assert index.chunks().where("scope = 'hot'").select("range").distinct().count() > 10
    same_as_bm25(spark, index, rows)
    same_as_bm25(spark, index, rows, 3)


def test_postings_change_by_document(spark):
    rows = corpus(120)
    index = postings.PostingIndex(spark, new_folder(spark, "postings-change"), range_chunks=8)
    index.clear(spark.createDataFrame([("hot", "d1")], "scope string, document string"))  # nothing there yet
    index.upsert(spark.createDataFrame(rows, CHUNKS))
    changed = [(1000, "hot", "d3", "word299 word299 word5"), (7, "cold", "d90", "word3 moved here"), (1001, "cold", "new", "word250 word0")]
    index.upsert(spark.createDataFrame(changed, CHUNKS))
    gone = {(r[1], r[2]) for r in changed}
    rows = [r for r in rows if (r[1], r[2]) not in gone and (r[1], r[0]) not in {(c[1], c[0]) for c in changed}] + changed
    same_as_bm25(spark, index, rows)
    index.clear(spark.createDataFrame([("hot", "d5"), ("hot", None), ("alone", "y"), ("none", "z")], "scope string, document string"))
    rows = [r for r in rows if (r[1], r[2]) not in {("hot", "d5"), ("hot", None), ("alone", "y")}]
    same_as_bm25(spark, index, rows)
    everything = spark.createDataFrame([r[1:3] for r in rows if r[1]], "scope string, document string")
    index.clear(everything)
    assert index.chunks().count() == 0 and index.search(asked_of(spark), 5).count() == 0


def test_a_change_of_postings_shuffles_once_and_leaves_no_tables(spark):
    """Words and blocks are shuffled once, by scope and range, before they are exploded; what a change stages goes with it."""
    import os

    from scopewise.sources.staging import RELEASE, shared_dir

    shared = shared_dir(spark).removeprefix("file://")
    there, released = set(os.listdir(shared)), spark.conf.get(RELEASE, None)
    path = new_folder(spark, "postings-once")
    index = postings.PostingIndex(spark, path, range_chunks=8)
    index.upsert(spark.createDataFrame(corpus(60), CHUNKS))
    index.upsert(spark.createDataFrame(corpus(20, 5), CHUNKS))
    index.clear(spark.createDataFrame([("hot", "d1")], "scope string, document string"))
    assert set(os.listdir(shared)) - there == {os.path.basename(path)} and spark.conf.get(RELEASE, None) == released
    new = spark.createDataFrame([("s", 0, 1, "a a b"), ("s", 0, 2, ""), ("s", 1, 9, "b")], "scope string, range int, chunk_id long, words string")
    old = spark.createDataFrame([("s", 0, "a", [1, 3, 4], [7, 1, 2], [9, 8, 7]), ("s", 0, None, [1], None, None), ("s", 0, None, [4], None, None), ("s", 1, "c", [5], [1], [1])], "scope string, range int, term string, chunk_id array<long>, tf array<int>, dl array<int>")
    made = index._blocks(new, old)
    assert sorted((r.range, r.term, r.n, r.most, r.shortest, [tuple(p) for p in r.postings]) for r in made.collect()) == [
        (0, "a", 2, 2, 3, [(1, 2, 3), (3, 1, 8)]), (0, "b", 1, 1, 3, [(1, 1, 3)]), (1, "b", 1, 1, 1, [(9, 1, 1)]), (1, "c", 1, 1, 1, [(5, 1, 1)]),
    ]
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_a_search_skips_blocks_and_reads_no_text(spark):
    """A rare word decides: ranges that hold only a frequent one stay closed."""
    rows = [(i, "s", f"d{i}", "common " * 3 + "filler " * 5) for i in range(2000)] + [(5000 + i, "s", f"r{i}", "common rare rare") for i in range(12)]
    index = postings.PostingIndex(spark, new_folder(spark, "postings-skip"), range_chunks=10)
    index.upsert(spark.createDataFrame(rows, CHUNKS))
    found = index.search(spark.createDataFrame([(1, "s", "common rare")], ASKED), 3)
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == [5000, 5001, 5002]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan
    opened = index.opened_blocks(spark.createDataFrame([(1, "s", "common rare")], ASKED), 3)
    assert opened < 0.2 * index.blocks().where("term IN ('common', 'rare')").count()
