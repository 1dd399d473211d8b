"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopewise.llm import hard_negatives
from scopewise.llm.hard_negatives import scaled

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every=100):
    sound = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    sound = [r for r in sound if sum(x * x for x in r[2]) < 2**62]
    out = []
    for anchor, label, v in sound:
        if anchor % every:
            continue
        scored = sorted((-sum(map(int.__mul__, v, w)), i, other) for i, other, w in sound if i != anchor and len(w) == len(v))
        for positive, score in dict.fromkeys((i, -s) for s, i in [(s, i) for s, i, other in scored if other == label][:5]):
            negatives = [(i, -s) for s, i, other in scored if other != label and 80 * score <= -100 * s <= 100 * score][:5]
            out += [(anchor, positive, k, i, score, s) for k, (i, s) in enumerate(negatives, 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", scaled(F.col("embedding"))).withColumns({c: F.lit(1) for c in ("id", "norm2", "bucket", "anchor")})
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, **options).collect())


def vectors(n, seed=1, labels=3, dims=6):
    rng = np.random.default_rng(seed)
    lengths = rng.lognormal(0, 2, n)
    return [(i, int(rng.integers(labels)), (v * s).tolist()) for i, (v, s) in enumerate(zip(rng.normal(size=(n, dims)), lengths, strict=True))]


def test_against_brute_force(spark):
    rows = vectors(600)
    got = found(spark, rows, every=20)
    assert got == brute(rows, 20) and len(got) > 100


def test_in_pieces_blocks_and_runs(spark, monkeypatch):
    """Workers load the module anew, so that RUN and AT_ONCE hold there as they are; the driver's sizes are changed."""
    monkeypatch.setattr(hard_negatives, "PIECE_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 11)
    monkeypatch.setattr(hard_negatives, "MOST_TASKS", 6)
    rows = vectors(200, 2)
    assert found(spark, rows, every=10) == brute(rows, 10)


def test_runs_are_skipped_rightly(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(hard_negatives, "RUN", 8)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 4)
    rng = np.random.default_rng(4)
    held = rng.integers(-40, 40, (90, 5)) * rng.integers(1, 30, (90, 1))
    asked = rng.integers(-40, 40, (9, 5))
    norm2 = lambda v: (v.astype(float) ** 2).sum(axis=1)
    a = pd.DataFrame({"anchor": range(9), "id": range(900, 909), "label": [k % 2 for k in range(9)], "vector": list(asked), "norm2": norm2(asked), "positive_id": 0, "positive_score": 0, "lower": [hard_negatives.FLOOR + 1, 500, 5000] * 3, "upper": [2000, 10**6, 10**9] * 3})
    c = pd.DataFrame({"c_id": rng.permutation(90), "c_label": [k % 2 for k in range(90)], "c_vector": list(held), "c_norm2": norm2(held)})
    got = hard_negatives._searched(3, False)(a, c)
    for row in a.itertuples():
        scored = sorted((-int(x), int(i)) for x, i, label in zip(held @ asked[row.anchor], c.c_id, c.c_label, strict=True) if label != row.label and row.lower <= x <= row.upper)[:3]
        mine = got[got.anchor == row.anchor].sort_values(["score", "other_id"], ascending=[False, True])
        assert [(-s, i) for s, i in zip(mine.score, mine.other_id, strict=True)] == scored


def test_copies_and_ties(spark):
    rows = [(i, i % 2, [0.5, 0.25]) for i in range(60)] + [(i, i % 3, [0.25, 0.5]) for i in range(60, 90)] + [(i, 0, [0.0, 0.0]) for i in range(90, 120)]
    assert found(spark, rows, every=10) == brute(rows, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(40, 3) + [
        (100, 0, None), (200, None, [1.0] * 6), (None, 0, [1.0] * 6), (300, 0, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, 1, [nan] * 6), (500, 1, [inf] * 6), (600, 1, []),
        (700, 1, [1.0, 2.0]), (701, 1, [1.0, 2.0]), (702, 2, [1.0, 1.7]), (800, 0, [1e30] * 6), (900, 0, [3e6] * 6), (901, 0, [2e6] * 6), (902, 1, [2e6] * 6),
        (0, 0, [1.0] * 6), (0, 0, [1.0] * 6), (3, 1, [2.0] * 6), (3, 1, [2.0] * 6),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[40:41]) == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("width", [2**21, 2**29])
def test_scores_are_exact_integers(spark, width):
    """Products beyond 2**53."""
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, (rng.integers(width // 2, width, 4) / 256).tolist()) for i in range(50)]
    assert found(spark, rows, every=10) == brute(rows, 10)
