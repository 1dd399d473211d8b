"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scopewise.llm import spelling
from scopewise.llm.spelling import Trie


def near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for word, n in words.items():
        others = [w for w in words if near(word, w)]
        best = min(others, key=lambda w: (-words[w], w), default=None)
        form = best if best and words[best] >= 5 * n else None
        out[word] = (form, n, len(others), words[form] if form else None)
    rows = set()
    for word, (form, n, n_near, form_n) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        rows.add((word, form, root, n, n_near, form_n))
    return rows


WORDS = st.lists(st.text("abÿ", min_size=1, max_size=6), unique=True, max_size=40)


@settings(max_examples=150, deadline=None)
@given(WORDS, WORDS)
def test_automata_accept_what_brute_force_accepts(held, asked):
    held = sorted(held)
    trie = Trie.of(held, list(range(1, len(held) + 1)))
    for word in asked:
        got = list(trie.near(word))
        assert len(got) == len(dict(got))
        assert dict(got) == {w: k for k, w in enumerate(held, 1) if near(word, w)}


def docs_with_chains():
    """abcdef (700) <- abcdeg (120) <- abcdeh's like; ties, capitals, letters outside ASCII, runs that lose a letter."""
    words = ["abcdef"] * 700 + ["abcdeg"] * 120 + ["abcdgg"] * 20 + ["abcggg"] * 4 + ["Straße"] * 60 + ["straÿe"] * 10 + ["STRASSE"] * 5 + ["ÀBCDEF", "àbcdef"] * 6 + ["aabcdef"] * 5 + ["abcdeff"] * 5 + ["short"] * 50
    rows = [(i, f"{w}, {w}-{w}! x1{w}2") for i, w in enumerate(words * 2)]
    return rows + [(None, "abcdef " * 7), (3, None), (4, ""), (5, " 12 !"), (6, "y" * 40_000 + " " + "z" * 30), (7, ("w" * 50 + " ") * 6), (7, ("w" * 50 + " ") * 6)]


def test_variants_against_brute_force(spark, monkeypatch):
    docs = docs_with_chains()
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "word", "n", "form")})
    want = variants(docs)
    assert any(form and root != form for _, form, root, *_ in want)
    assert {tuple(r) for r in spelling.spelling_variants(rows).collect()} == want
    # several shards and several broadcasts
    monkeypatch.setattr(spelling, "SHARD_LETTERS", 20)
    monkeypatch.setattr(spelling, "SHARDS", 2)
    assert {tuple(r) for r in spelling.spelling_variants(rows).collect()} == want
    assert spelling.spelling_variants(rows.limit(0)).count() == 0


def test_workers_hand_counts_on(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(spelling, "COUNTED", 3)
    batch = pd.DataFrame({"id": [str(i) for i in range(9)], "text": [f"letters{chr(97 + i)} common" for i in range(9)]})
    rows = pd.concat(spelling._counted(iter([batch])))
    assert len(rows) > 10 and rows.groupby("word").n.sum()["common"] == sum(spelling.runs_of(str(i), f"letters{chr(97 + i)} common")[b"common"] for i in range(9))


def test_long_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(20)] + [("other", "w19")], "word string, form string")
    got = {r.word: r.root for r in spelling.roots_of(forms).collect()}
    assert got == {**{f"w{i:02d}": "w20" for i in range(20)}, "other": "w20"}
