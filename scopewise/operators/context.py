"""Bounded contexts, headers and prompts from ranked chunks, and packing them into a reader's window."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopewise.functions.text import truncated

# Wording and marks of the prompts.
SYSTEM = "You are a factual question-answering assistant for clinical records. Answer the question using ONLY the clinical notes provided below. Be concise and answer directly - do not add disclaimers, warnings, or commentary. If the notes do not contain the answer, say so briefly."
NO_NOTES = "(no relevant notes were retrieved)"
NO_CHUNK = "_No relevant clinical chunk found for this query._\n\n"
FACTUAL = {
    "chatml": "<|im_start|>system\n{system}\n\n/no_think<|im_end|>\n<|im_start|>user\nCLINICAL NOTES:\n{notes}\n\nQUESTION: {question}<|im_end|>\n<|im_start|>assistant\n",
    "llama3": "<|start_header_id|>system<|end_header_id|>\n\n{system}<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nCLINICAL NOTES:\n{notes}\n\nQUESTION: {question}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    "phi4": "<|system|>{system}<|end|><|user|>CLINICAL NOTES:\n{notes}\n\nQUESTION: {question}<|end|><|assistant|>",
    "gemma3": "<start_of_turn>user\n{system}\n\nCLINICAL NOTES:\n{notes}\n\nQUESTION: {question}<end_of_turn>\n<start_of_turn>model\n",
}
CHAT = {  # model type: (system template, user template, stop token)
    "LLAMA_3": ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n{system}<|eot_id|>", "<|start_header_id|>user<|end_header_id|>\n{user}<|eot_id|><|start_header_id|>assistant<|end_header_id|>", "<|eot_id|>"),
    "QWEN_3": ("<|im_start|>system\n{system}<|im_end|>\n", "<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>"),
    "PHI_4": ("<|system|>{system}<|end|>", "<|user|>{user}<|end|><|assistant|>", "<|end|>"),
    "GEMMA_3": ("{system}", "<start_of_turn>user\n{user}<end_of_turn>\n<start_of_turn>model", "<end_of_turn>"),
    "LLAMA_GUARD_3": ("{system}", "<|start_header_id|>user<|end_header_id|>\n{user}<|eot_id|><|start_header_id|>assistant<|end_header_id|>", "<|eot_id|>"),
    "SMOLLM_3": ("<|im_start|>system\n{system}<|im_end|>\n", "<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>"),
    "LFM2": ("<|im_start|>system\n{system}<|im_end|>\n", "<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>"),
    "LLAVA_1_5": ("{system}", " USER: {user} ASSISTANT:", "</s>"),
    "VOXTRAL": ("{system}", "{user}", "</s>"),
}
WINDOW_TOKENS = 2048
LEAST_PARTIAL = 100
#: (answer reserve, characters per token, characters of a context) from the widest on.
BUDGETS = ((384, 2.0, 500), (640, 1.8, 320), (896, 1.6, 220), (1152, 1.4, 160))


def filled_in(template: str, **columns: Column) -> Column:
    """A template with {name} places as one concatenation."""
    out: list[Column] = []
    while "{" in template:
        before, _, rest = template.partition("{")
        name, _, template = rest.partition("}")
        out += [F.lit(before), columns[name]]
    return F.concat(*out, F.lit(template))


def bounded(ranked: DataFrame, most: int = 400) -> DataFrame:
    """Ranked chunks with their content cut to ``most`` characters and three dots."""
    return ranked.withColumn("content", truncated(F.col("content"), most))


def _in_order(value: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))), lambda s: s["v"]), sep)


def fixed(value: Column, places: int) -> Column:
    """A number with so many decimal places, rounded by its exact binary value, halves to even, as SQL and C write it.

    Java's format rounds the shortest decimal digits that name the number, halves up: 2.675, which is a little less, is 2.68 there.
    """
    size, unit = F.abs(value), F.lit(2**60).cast("decimal(19,0)")
    whole = F.floor(size).cast("long")
    # what is after the point is a whole number of 2^-60, but for numbers that are nearer to 0 than to the first half
    scaled = ((size - whole) * F.lit(float(2**60))).cast("long").cast("decimal(19,0)") * F.lit(10**places).cast("decimal(4,0)")
    rest = scaled % unit
    down = ((scaled - rest) / unit).cast("long")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (down % 2 == 1))
    near = down + F.when(up, 1).otherwise(0)
    whole, near = whole + F.when(near == 10**places, 1).otherwise(0), near % 10**places
    text = F.concat(F.when(value < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad(near.cast("string"), places, "0"))
    return F.when(size < 2**53, text).otherwise(F.format_string(f"%.{places}f", value))


def header(ranked: DataFrame, percent: bool = False) -> DataFrame:
    """(query_id, header): a Markdown list of the chunks with ranks, scores and openings."""
    score = F.col("score").cast("double")
    score = F.format_string("%.1f%%", score) if percent else fixed(score, 2)
    date = F.when(F.coalesce(F.trim("date"), F.lit("")) != "", F.concat(F.col("date"), F.lit(" - "))).otherwise("")
    opening = F.replace(F.substring("content", 1, 180), F.lit("\n"), F.lit(" "))
    line = F.concat(F.format_string("> **[Chunk #%d]** Coherence: **%s** | *%s%s*\n", F.col("rank"), score, date, F.col("kind")), F.lit('> "'), opening, F.lit('..."\n\n'))
    body = ranked.groupBy("query_id").agg(_in_order(line, "").alias("body"), F.count("*").alias("n"))
    return body.select("query_id", F.concat(F.format_string("**Top %d Relevant Chunks Extracted:**\n", F.col("n")), F.col("body"), F.lit("---\n\n")).alias("header"))


def context_line(date: Column, kind: Column, content: Column) -> Column:
    return F.concat(F.lit("[Notes from "), F.coalesce(date, F.lit("")), F.lit(" - "), kind, F.lit("]: "), content)


def factual_prompt(question: Column, notes: Column, template: str = "chatml") -> Column:
    return filled_in(FACTUAL[template], system=F.lit(SYSTEM), notes=F.coalesce(F.when(notes != "", notes), F.lit(NO_NOTES)), question=question)


def chat_prompt(system: Column, user: Column, model: str = "QWEN_3") -> Column:
    opening, body, _ = CHAT[model]
    return filled_in(opening + body, system=system, user=user)


def conversation_prompt(message: Column, notes: Column, patient: Column, history: Column) -> Column:
    """The user part of the interactive prompt: background, recent dialogue and the message; empty parts are left out."""
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    summary = F.when(some(patient), F.concat(F.lit("Patient Summary: "), patient, F.lit("\n"))).otherwise("")
    found = F.when(some(notes), F.concat(F.lit("Relevant Clinical Notes:\n"), notes, F.lit("\n"))).otherwise("")
    background = F.when(some(patient) | some(notes), F.concat(F.lit("BACKGROUND KNOWLEDGE\n"), summary, found, F.lit("\n"))).otherwise("")
    recent = F.when(some(history), F.concat(F.lit("RECENT DIALOGUE\n"), history, F.lit("\n\n"))).otherwise("")
    return F.concat(background, recent, F.lit("CURRENT USER MESSAGE \n"), message)


def prompts(queries: DataFrame, ranked: DataFrame, template: str = "chatml", most: int = 400, percent: bool = False) -> DataFrame:
    """(query_id, prompt, header, retrieved): queries without chunks get the notice and the empty context."""
    cut = bounded(ranked, most)
    notes = cut.groupBy("query_id").agg(_in_order(F.concat(F.lit("- "), context_line(F.col("date"), F.col("kind"), F.col("content"))), "\n\n").alias("notes"), F.count("*").alias("retrieved"))
    out = queries.select("query_id", "text").join(notes, "query_id", "left").join(header(cut, percent), "query_id", "left")
    return out.select("query_id", factual_prompt(F.col("text"), F.col("notes"), template).alias("prompt"), F.coalesce("header", F.lit(NO_CHUNK)).alias("header"), F.coalesce("retrieved", F.lit(0)).alias("retrieved"))


def recent_history(messages: DataFrame, conversation: str, turn: str, role: str, text: str, last: int = 4) -> DataFrame:
    """(conversation, history): the last non-blank messages as User: and Assistant: lines, oldest first."""
    w = Window.partitionBy(conversation).orderBy(F.desc(turn))
    rows = messages.where(F.trim(text) != "").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    line = F.concat(F.when(F.col(role) == "user", "User: ").otherwise("Assistant: "), F.col(text))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("v")))), lambda s: s["v"]), "\n")
    return rows.groupBy(conversation).agg(joined.alias("history"))


def without_repeats(messages: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """messages without those that say again what the one before said."""
    w = Window.partitionBy(conversation).orderBy(turn)
    return messages.withColumn("_before", F.lag(text).over(w)).where(~F.col(text).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def packed(question: str, blocks: list[str], reserve: int, per_token: float, most: int, window: int = WINDOW_TOKENS) -> list[str]:
    """The blocks, in order, that fit a prompt's budget; one that does not fit whole may go in part."""

    def tokens(contexts: list[str]) -> int:
        notes = "\n\n".join(f"- {c}" for c in contexts) or NO_NOTES
        return math.ceil(len(FACTUAL["chatml"].format(system=SYSTEM, notes=notes, question=question)) / per_token)

    taken: list[str] = []
    for block in blocks:
        label, colon, content = block.partition(": ")
        label, content = (label + colon, content) if colon else ("", block)
        content = content[:most]
        if tokens([*taken, label + content]) <= window - reserve:
            taken.append(label + content)
            continue
        left = window - reserve - tokens(taken)
        room = min(len(content), int((left - math.ceil(len(f"\n\n- {label}") / per_token)) * per_token))
        if left > 0 and room >= LEAST_PARTIAL and tokens([*taken, label + content[:room]]) <= window - reserve:
            taken.append(label + content[:room])
    return taken


def pack(items: DataFrame, budgets=BUDGETS, carry: tuple[str, ...] = ()) -> DataFrame:
    """items(item, question, blocks: array of struct<rank, scope_pos, block>) -> (item, budget, contexts, dropped), and columns of items to carry.

    Blocks come round-robin: by rank, then scope. Every budget is given, from the widest on.
    """

    columns = ["item", "budget", "contexts", "dropped", *carry]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            carried = zip(*[part[c] for c in carry], strict=True) if carry else [()] * len(part)
            for item, question, blocks, kept in zip(part["item"], part.question, part.blocks, carried, strict=True):
                ordered = [b["block"] for b in sorted(blocks, key=lambda b: (b["rank"], b["scope_pos"]))]
                for i, budget in enumerate(budgets):
                    taken = packed(question, ordered, *budget)
                    rows.append((item, i, taken, len(ordered) - len(taken), *kept))
            yield pd.DataFrame(rows, columns=columns)

    kind = lambda c: items.schema[c].dataType.simpleString()
    schema = f"item {kind('item')}, budget int, contexts array<string>, dropped int" + "".join(f", {c} {kind(c)}" for c in carry)
    return items.select(*dict.fromkeys(("item", "question", "blocks", *carry))).mapInPandas(run, schema)
