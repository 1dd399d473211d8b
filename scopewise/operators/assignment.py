"""Question types for admissions: balanced assignment, yes/no polarity, and the choice of concrete candidates.

assigned() balances types for any number of admissions: which types an admission could have is one of few sets, so the
balance is found over the sets' sizes and dealt back by place. The others are folds with running counts over one
narrow row per admission; candidates are made and filtered in Spark.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict, deque
from collections.abc import Hashable
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the hash that name a range: 4096 ranges for each set of types.
RANGE_DIGITS = 3
#: Fixed value: the share of items whose answers are yes or no, negation checks aside, from which on such items cost.
YES_NO_SHARE = 0.12


def balanced_shares(sizes: dict[tuple[str, ...], int], each: int = 2) -> dict[tuple[str, ...], dict[str, int]]:
    """For sets of types and how many admissions have them: how many of a set's admissions use each of its types.

    Every admission uses ``each`` distinct types, or all it has; uses per type come as even as can be. From an even
    split within each set, whole amounts move along chains of types from a high one to one at least two lower.
    """
    out, load = {}, Counter()
    for types, n in sizes.items():
        total, left = min(each, len(types)) * n, len(types)
        out[types] = {}
        for t in types:
            out[types][t] = -(-total // left)
            total, left = total - out[types][t], left - 1
        load.update(out[types])
    while True:
        move = _cheaper(load, out, sizes)
        if move is None:
            return out
        amount, steps = move
        for types, a, b in steps:
            out[types][a] -= amount
            out[types][b] += amount
            load.subtract({a: amount})
            load.update({b: amount})


def _cheaper(load: Counter, uses: dict, sizes: dict) -> tuple[int, list[tuple]] | None:
    """How much can move from the highest type that has a chain to one at least two lower, and the chain's steps (set, from, to)."""
    for start in sorted(load, key=lambda t: (-load[t], t)):
        came, queue = {start: None}, deque([start])
        while queue:
            at = queue.popleft()
            if load[at] <= load[start] - 2:
                steps, amount, end = [], (load[start] - load[at]) // 2, at
                while came[end] is not None:
                    types, a = came[end]
                    steps.append((types, a, end))
                    amount, end = min(amount, uses[types][a], sizes[types] - uses[types][end]), a
                return amount, steps
            for types, held in uses.items():
                if held.get(at, 0):
                    for b in types:
                        if b not in came and held[b] < sizes[types]:
                            came[b] = types, at
                            queue.append(b)
    return None


def assigned(rows: DataFrame, key: str, types: str, each: int = 2) -> DataFrame:
    """(key, types): ``each`` of the types that a row's array holds, with uses per type as even as can be.

    What reaches the driver is one row per set of types, and goes back as a table of that size. Admissions of a set
    are placed by a hash of their key, range by range, so no window spans a set. Of a set's n places a type takes as
    many in a row as it has uses, beginning where the type before it ended and going round, so no place has a type
    twice. Keys are distinct; null and empty arrays give an empty one.
    """
    held = rows.select(key, F.array_sort(F.array_distinct(F.coalesce(types, F.array().cast("array<string>")))).alias("held"), F.md5(F.col(key).cast("string").cast("binary")).alias("hash"))
    held = held.withColumn("range", F.substring("hash", 1, RANGE_DIGITS))
    ranges = held.groupBy("held", "range").agg(F.count("*").alias("n"))
    sizes = {tuple(r.held): r.n for r in ranges.groupBy("held").agg(F.sum("n").alias("n")).collect()}
    table = []
    for kinds, uses in balanced_shares(sizes, each).items():
        start, spans = 0, []
        for t in kinds:
            spans.append((t, start, uses[t]))
            start = (start + uses[t]) % sizes[kinds]
        table.append((list(kinds), sizes[kinds], spans))
    table = rows.sparkSession.createDataFrame(table, "held array<string>, size long, spans array<struct<t: string, start: long, uses: long>>")
    before = Window.partitionBy("held").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("held", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("held", "range").orderBy("hash", key)) - 1
    placed = held.withColumn("within", within).join(offsets, ["held", "range"]).join(table, "held")
    own = F.filter("spans", lambda s: F.pmod(F.col("offset") + F.col("within") - s["start"], F.col("size")) < s["uses"])
    return placed.select(key, F.transform(own, lambda s: s["t"]).alias("types"))


def balanced_types(available: dict[Hashable, set[str]], each: int = 2) -> dict[Hashable, set[str]]:
    """``each`` distinct types for every admission, from those available, with counts per type as even as can be.

    Starting from the least used types, chains of swaps move a count from a type to one at least two lower, until no
    chain is left; for costs that rise with each use (0, 1, 2, ...) that is the least total cost. An admission with
    fewer types available gets all of them.
    """
    load: Counter = Counter({t: 0 for types in available.values() for t in types})
    chosen: dict[Hashable, set[str]] = {}
    holds: dict[tuple[str, str], set] = defaultdict(set)  # (a, b): admissions that could swap a for b

    def update(key: Hashable, add: bool) -> None:
        for a in chosen[key]:
            for b in available[key] - chosen[key]:
                (holds[a, b].add if add else holds[a, b].discard)(key)

    for key in sorted(available, key=lambda k: (len(available[k]), str(k))):
        chosen[key] = set(sorted(available[key], key=lambda t: (load[t], t))[:each])
        load.update(chosen[key])
        update(key, True)

    while True:
        chain = _chain(load, holds)
        if not chain:
            return chosen
        for a, b in zip(chain, chain[1:], strict=False):
            key = min(holds[a, b], key=str)
            update(key, False)
            chosen[key] = chosen[key] - {a} | {b}
            update(key, True)
            load[a] -= 1
            load[b] += 1


def _chain(load: Counter, holds: dict) -> list[str]:
    """Types from a high one to one at least two lower, each step a possible swap of another admission."""
    for start in sorted(load, key=lambda t: (-load[t], t)):
        came, queue = {start: None}, deque([start])
        while queue:
            at = queue.popleft()
            if load[at] <= load[start] - 2:
                chain = [at]
                while came[chain[-1]] is not None:
                    chain.append(came[chain[-1]])
                return chain[::-1]
            for b in sorted(load):
                if b not in came and holds.get((at, b)):
                    came[b] = at
                    queue.append(b)
    return []


def rebalanced_polarity(chosen: dict[Hashable, set[str]], available: dict[Hashable, set[str]], polarity: dict[Hashable, str], kind: str = "negation_check") -> dict[Hashable, set[str]]:
    """The assignment with yes and no answers of one type at most one apart, if swaps that keep all counts allow it.

    A swap gives the type from an admission whose answer is in excess to one whose answer is short, for a type that
    the second holds and the first could have.
    """
    out = {k: set(v) for k, v in chosen.items()}

    def members(answer: str, held: bool) -> list:
        return sorted((k for k in out if polarity.get(k) == answer and (kind in out[k]) == held and kind in available[k]), key=str)

    while True:
        yes, no = len(members("Yes", True)), len(members("No", True))
        if abs(yes - no) <= 1:
            return out
        more, less = ("Yes", "No") if yes > no else ("No", "Yes")
        swap = next(((a, b, t) for a in members(more, True) for b in members(less, False) for t in sorted(out[b]) if t in available[a] and t not in out[a]), None)
        if swap is None:
            return out
        a, b, t = swap
        out[a] = out[a] - {kind} | {t}
        out[b] = out[b] - {t} | {kind}


def concrete(chosen: dict[Hashable, set[str]], candidates: dict[tuple[Hashable, str], list[dict]], each: int = 2) -> list[dict]:
    """One candidate for each chosen type, by how often its subkey and section have been used so far.

    A candidate is a dict with id, subkey, section, page and evidence; those of one admission differ in evidence
    where they can, then in page.
    """
    subkeys, sections, out = Counter(), Counter(), []
    for key in sorted(chosen, key=str):
        taken: list[dict] = []
        for kind in sorted(chosen[key]):
            found = candidates.get((key, kind), [])
            if not found:
                continue
            best = min(
                found,
                key=lambda c: (
                    any(c["evidence"] == t["evidence"] for t in taken),
                    any(c["section"] == t["section"] for t in taken),
                    any(c["page"] == t["page"] for t in taken),
                    subkeys[kind, c["subkey"]],
                    sections[c["section"]],
                    c["id"],
                ),
            )
            taken.append(best)
            subkeys[kind, best["subkey"]] += 1
            sections[best["section"]] += 1
        out += [{**c, "key": key} for c in taken[:each]]
    return out


def chosen_pairs(chosen: dict[Hashable, set[str]], candidates: dict[tuple[Hashable, str], list[dict]], total: int, yes_no_share: float = YES_NO_SHARE) -> list[dict]:
    """One candidate for each of an admission's two types, as the pair that costs least.

    Candidates are dicts with id, kind, subkey, section, page, answer, gold and yes_no. A pair costs, in this order:
    equal answers, equal gold chunks, equal sections, another yes/no answer where those are too many already, how
    often its subkeys and its looked-up sections have been used, equal pages; ties go by ids. Yes/no answers of
    negation checks don't count.
    """
    subkeys, sections, plain_yes_no, out = Counter(), Counter(), 0, []

    def polar(*items: dict) -> int:
        return sum(bool(c["yes_no"]) and c["kind"] != "negation_check" for c in items)

    def looked_up(*items: dict) -> list[str]:
        return [c["subkey"] for c in items if c["kind"] == "section_lookup"]

    def cost(pair: tuple[dict, dict]) -> tuple:
        a, b = pair
        texts = [_key(a["answer"]) == _key(b["answer"]), *(a[x] == b[x] for x in ("gold", "section"))]
        too_many = polar(a, b) > 0 and plain_yes_no >= yes_no_share * total
        loads = sum(subkeys[c["kind"], c["subkey"]] for c in pair), sum(sections[s] for s in looked_up(a, b))
        return *texts, too_many, *loads, a["page"] == b["page"], a["id"], b["id"]

    for key in sorted(chosen, key=str):
        kinds = sorted(chosen[key])
        options = [candidates.get((key, kind), []) for kind in kinds]
        if len(kinds) != 2 or not all(options):
            raise ValueError(f"{key}: two types with candidates are needed, not {kinds}")
        best = min(product(*options), key=cost)
        subkeys.update((c["kind"], c["subkey"]) for c in best)
        sections.update(looked_up(*best))
        plain_yes_no += polar(*best)
        out += [{**c, "key": key} for c in best]
    return out


def _key(answer: str) -> str:
    return re.sub("[^a-z0-9]+", " ", answer.lower()).strip()


def selected(candidates: dict[tuple[Hashable, str], list[dict]], kind: str = "negation_check") -> list[dict]:
    """The whole choice: two types for each admission, yes and no of one type evened out, one candidate for each type.

    Admissions with fewer than two types are left out. Evening out must not change how often a type is used.
    """
    available: dict[Hashable, set[str]] = defaultdict(set)
    for (key, type_), found in candidates.items():
        if found:
            available[key].add(type_)
    available = {k: v for k, v in available.items() if len(v) > 1}
    chosen = balanced_types(available)
    polarity = {key: min(candidates[key, kind], key=lambda c: c["id"])["answer"] for key, types in available.items() if kind in types}
    evened = rebalanced_polarity(chosen, available, polarity, kind)
    before, after = (Counter(t for types in x.values() for t in types) for x in (chosen, evened))
    if before != after:
        raise ValueError(f"evening out yes and no changed the types from {before} to {after}")
    return chosen_pairs(evened, candidates, 2 * len(evened))
