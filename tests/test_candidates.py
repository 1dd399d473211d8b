"""Pairs of patients with the same diagnosis, one of which a third of all admissions have."""

import hashlib
from itertools import combinations

import pytest

from scopewise.operators import candidates
from scopewise.sources.staging import RELEASE

SCHEMA = "patient string, admission long, diagnosis string, extra string"


def admissions():
    """300 admissions of 40 patients; a third have flu, and of those a third are one patient's."""
    rows = []
    for i in range(300):
        diagnosis = " Flu" if i % 3 == 0 else f"rare {i % 29}"
        rows.append((f"p{0 if i % 9 == 0 else i % 40}", i, diagnosis, "x"))
    rows += [("p1", 900, None, "x"), ("p2", 901, "  ", "x"), ("p3", 902, "Newborn", "x"), ("p4", 903, "newborn ", "x"), (None, 904, "flu", "x"), ("p5", None, "flu", "x")]
    return rows


def brute(rows):
    sound = [(d.strip().lower(), p, str(a)) for p, a, d, _ in rows if p and a is not None and (d or "").strip() and d.strip().upper() != "NEWBORN"]
    pairs = []
    for (d1, p1, a1), (d2, p2, a2) in combinations(sound, 2):
        if d1 == d2 and p1 != p2:
            pairs.append((d1, p1, a1, p2, a2) if p1 < p2 else (d1, p2, a2, p1, a1))
    return sorted(pairs)


@pytest.mark.parametrize("block", [10, 33, 100_000])
def test_cross_pairs_in_blocks(spark, block):
    rows = spark.createDataFrame(admissions(), SCHEMA)
    got = candidates.cross_pairs(rows, "patient", "admission", "diagnosis", block_rows=block)
    assert sorted(map(tuple, got.collect())) == brute(admissions())


@pytest.mark.parametrize("most", [1, 3])
def test_capped_cross_pairs(spark, most):
    ranked = {}
    for d, p1, a1, p2, a2 in brute(admissions()):
        rank = hashlib.sha256(f"42|{d}|{a1}|{a2}".encode()).hexdigest()[:16]
        ranked.setdefault((p1, p2), []).append((rank, d, a1, a2))
    want = sorted((p, place, *r) for p, rs in ranked.items() for place, r in enumerate(sorted(rs)[:most], 1))
    got = candidates.capped_cross_pairs(spark.createDataFrame(admissions(), SCHEMA), "patient", "admission", "diagnosis", most, block_rows=20)
    assert sorted(((r.patient_1, r.patient_2), r.place, r.stable_rank, r.diagnosis, r.admission_1, r.admission_2) for r in got.collect()) == want
    over = candidates.capped_cross_pairs(spark.createDataFrame([], SCHEMA), "patient", "admission", "diagnosis")
    assert over.count() == 0


def test_the_cap_comes_before_the_shuffle(spark):
    got = candidates.capped_cross_pairs(spark.createDataFrame(admissions(), SCHEMA), "patient", "admission", "diagnosis")
    plan = got._jdf.queryExecution().executedPlan().toString()
    final, partial = plan.index("WindowGroupLimit"), plan.index("WindowGroupLimit", plan.index("WindowGroupLimit") + 1)
    assert "Final" in plan[final : final + 400] and "Exchange" in plan[final:partial]
    assert plan.index("Join", partial) > partial and "Exchange" not in plan[partial : plan.index("Join", partial)]


@pytest.mark.parametrize("most", [1, 3])
def test_capped_pairs_by_blocks_of_patients(spark, most):
    """Many pairs are the same as few, and are not shuffled: admissions are."""
    rows = spark.createDataFrame(admissions() + admissions()[:30], SCHEMA)
    few, many = (candidates.capped_cross_pairs(rows, "patient", "admission", "diagnosis", most, task_pairs=n) for n in (10**9, 100))
    assert sorted(many.select(*few.columns).collect()) == sorted(few.collect())
    plan = many._jdf.queryExecution().executedPlan().toString()
    window = plan.index("Window ")
    assert "Exchange" not in plan[window : plan.index("Generate", window)]


@pytest.mark.parametrize("most", [1, 3])
def test_capped_pairs_by_diagnoses(spark, monkeypatch, most):
    """Very many pairs are made where their diagnosis is, and have their places there, unless a patient has many admissions."""
    rows, before = spark.createDataFrame(admissions() + admissions()[:30], SCHEMA), spark.conf.get(RELEASE, None)
    few = candidates.capped_cross_pairs(rows, "patient", "admission", "diagnosis", most, task_pairs=10**9)
    want, found = sorted(few.collect()), []
    for own_few, block, task_pairs in ((1000, 7, 10), (1000, 1000, 20), (5, 1000, 10), (1000, 1000, 100)):
        monkeypatch.setattr(candidates, "OWN_FEW", own_few)
        many = candidates.capped_cross_pairs(rows, "patient", "admission", "diagnosis", most, block_rows=block, task_pairs=task_pairs)
        found.append("own2" in many._jdf.queryExecution().executedPlan().toString())
        assert sorted(many.select(*few.columns).collect()) == want
    assert found == [True, True, False, False] and spark.conf.get(RELEASE, None) == before


def test_very_many_capped_pairs_shuffle_an_admission_once(spark, monkeypatch):
    """However many tasks make the pairs, an admission goes to its diagnosis once."""
    monkeypatch.setattr(candidates, "OWN_FEW", 1000)
    rows, dealt = spark.createDataFrame(admissions(), SCHEMA), []
    sound = sum(bool(p and a is not None and (d or "").strip() and d.strip().upper() != "NEWBORN") for p, a, d, _ in admissions())
    kind, whole = type(rows), type(rows).repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: dealt.append(self) or whole(self, *a))
    for task_pairs in (20, 10):
        candidates.capped_cross_pairs(rows, "patient", "admission", "diagnosis", task_pairs=task_pairs)
    assert [x.count() for x in dealt] == [sound, sound]
