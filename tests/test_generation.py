"""Rounds of a reader whose failures are known."""

import pandas as pd
import pytest

from scopewise.operators import context, generation

ITEMS = "id string, question string, blocks array<struct<rank:int,scope_pos:int,block:string>>"


def reader_of(folder, outcomes):
    """A reader that answers by the table and notes what it was asked; it takes all batches before it answers."""

    def read(parts):
        for part in list(parts):
            rows = []
            for i, prompt, reserve in zip(part["id"], part["prompt"], part["reserve"], strict=True):
                number = [b[0] for b in context.BUDGETS].index(reserve)
                (folder / f"{i}-{number}-{len(prompt)}").touch()
                kind = outcomes[i][number]
                raw = {"blank": " <|im_end|>", "none": None}.get(kind, f"{i} says {number}<|im_end|>")
                rows.append((i, raw, f"prompt_tokens: 50 generated_tokens: {3000 if kind == 'cut' else 5}", "broken" if kind == "error" else None))
            yield pd.DataFrame(rows[::-1], columns=["id", "raw", "stats", "error"])

    return read


OUTCOMES = {"a": ["ok"], "b": ["blank", "ok"], "c": ["cut", "error", "none", "ok"], "d": ["error", "cut", "none", "blank"], "e": ["ok"], "f": ["none", "ok"]}


def items(spark):
    block = lambda rank, scope, n: (rank, scope, f"[Patient {scope}, admission {rank}]: " + "x" * n)
    long = [block(r, s, 700) for s in (0, 1) for r in (1, 2, 3, 4)]
    rows = [("a", "Why?", long), ("b", "When?", long), ("c", "Who?", [block(1, 0, 50)]), ("d", "", []), ("e", None, None), ("f", "How?", [(1, 0, "no label")])]
    return spark.createDataFrame(rows, ITEMS)


def test_only_what_is_not_clean_goes_again(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    tried = generation.rounds(items(spark), reader_of(asked, OUTCOMES), folder=str(tmp_path / "run"))
    assert sorted((r.id, r.budget) for r in tried.collect()) == sorted((i, n) for i, o in OUTCOMES.items() for n in range(len(o)))
    assert sorted(p.name.rsplit("-", 1)[0] for p in asked.iterdir()) == sorted(f"{i}-{n}" for i, o in OUTCOMES.items() for n in range(len(o)))
    got = {r.id: r for r in generation.final(tried).collect()}
    assert {i: (r.attempts, r.clean) for i, r in got.items()} == {i: (len(o), i != "d") for i, o in OUTCOMES.items()}
    assert got["c"].answer == "c says 3" and got["d"].answer == "" and got["b"].answer == "b says 1"
    # contexts are those of the budget an item got to
    blocks = {r.id: [b.block for b in sorted(r.blocks or [], key=lambda b: (b.rank, b.scope_pos))] for r in items(spark).collect()}
    questions = {r.id: r.question or "" for r in items(spark).collect()}
    for r in tried.collect():
        taken = context.packed(questions[r.id], blocks[r.id], *context.BUDGETS[r.budget])
        assert (r.contexts, r.dropped) == (len(taken), len(blocks[r.id]) - len(taken)), (r.id, r.budget)
        notes = "\n\n".join(f"- {c}" for c in taken) or context.NO_NOTES
        prompt = context.FACTUAL["chatml"].format(system=context.SYSTEM, notes=notes, question=questions[r.id])
        assert (asked / f"{r.id}-{r.budget}-{len(prompt)}").exists()


def test_a_run_is_resumed(spark, tmp_path):
    """A reader that dies in the second round; the first is not asked for again."""
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir()
    second.mkdir()
    dying = reader_of(first, {**OUTCOMES, "b": ["blank"], "c": ["cut"], "d": ["error"], "f": ["none"]})
    with pytest.raises(Exception, match="IndexError"):
        generation.rounds(items(spark), dying, folder=str(tmp_path / "run"))
    tried = generation.rounds(items(spark), reader_of(second, OUTCOMES), folder=str(tmp_path / "run"))
    assert {p.name.split("-")[1] for p in second.iterdir()} == {"1", "2", "3"}
    assert sorted((r.id, r.budget) for r in tried.collect()) == sorted((i, n) for i, o in OUTCOMES.items() for n in range(len(o)))


def test_rounds_of_nothing(spark, tmp_path):
    tried = generation.rounds(spark.createDataFrame([], ITEMS), reader_of(tmp_path, {}))
    assert tried.count() == 0 and generation.final(tried).count() == 0


def test_a_reader_is_given_small_parts(spark):
    def read(parts):
        for part in parts:
            yield pd.DataFrame({"id": part["id"], "raw": str(len(part)), "stats": None, "error": None})

    rows = spark.range(1000).coalesce(1).selectExpr("cast(id as string) AS id", "'?' AS question", "array(named_struct('rank', 1, 'scope_pos', 0, 'block', 'x')) AS blocks")
    assert max(int(r.answer) for r in generation.rounds(rows, read, context.BUDGETS[:1]).collect()) <= 256
