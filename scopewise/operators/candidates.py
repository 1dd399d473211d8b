"""Multi-record question candidates: windows over a patient's admissions, cross-patient pairs, caps and order."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopewise.sources.staging import released, staged

MOST_PAIRS, MOST_TRAJECTORIES, MOST_CROSS = 4, 2, 1
#: Admissions of a diagnosis that meet in one task; more are dealt in blocks.
PAIR_BLOCK = 1_000
#: Pairs that a task of capped pairs makes, on average; if there are more, patients are dealt in blocks.
TASK_PAIRS = 1_000_000
#: Admissions of a patient that go with each of them to its pairs, at most; and diagnoses that are numbered for that and broadcast.
OWN_FEW, NAMED = 64, 200_000
#: Blocks of patients to each of which an admission may go alone; more take more room than what goes with an admission to its diagnosis.
COPIES = 12
#: Source sets of a range that a balanced choice reads at a time.
RANGE_SETS = 50_000
SEED = 42


def stable_rank(*parts: Column) -> Column:
    """Sixteen hex digits that order rows at random and the same each time; their order is the number's."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(SEED)), *[p.cast("string") for p in parts]), 256), 1, 16)


def spread_priority(index: Column, windows: Column, cap: int) -> Column:
    """The rank of window ``index`` (from 0) of ``windows``: the first ``cap`` ranks lie evenly over the timeline."""
    if cap == 1:
        places = F.array(F.floor((windows - 1) / 2).cast("int"))
    else:
        places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.bround(i * (windows - 1) / F.lit(float(cap - 1))).cast("int")))
    at = F.array_position(places, index.cast("int"))
    before = F.size(F.filter(places, lambda p: p < index))
    spread = F.when(at > 0, at - 1).otherwise(F.size(places) + index - before)
    return F.when(windows <= cap, index).otherwise(spread).cast("int")


def windows(admissions: DataFrame, patient: str, order: list[str], length: int, columns: list[str], cap: int) -> DataFrame:
    """Runs of consecutive admissions: patient, window_idx, window_count, priority and column_1.. for each column."""
    w = Window.partitionBy(patient).orderBy(*order)
    cells = [F.lead(c, k).over(w).alias(f"{c}_{k + 1}") if k else F.col(c).alias(f"{c}_1") for k in range(length) for c in columns]
    rows = admissions.select(patient, *cells, (F.row_number().over(w) - 1).alias("window_idx"), (F.count("*").over(Window.partitionBy(patient)) - (length - 1)).alias("window_count"))
    return rows.where("window_idx < window_count").withColumn("priority", spread_priority(F.col("window_idx"), F.col("window_count"), cap))


def _diagnosed(admissions: DataFrame, patient: str, admission: str, diagnosis: str, excluded: Iterable[str]) -> DataFrame:
    """(diagnosis, p, a): the admissions that take part in pairs, ids as text."""
    rows = admissions.where(F.col(diagnosis).isNotNull() & (F.trim(diagnosis) != "") & ~F.upper(F.trim(diagnosis)).isin(*excluded))
    rows = rows.select(F.lower(F.trim(diagnosis)).alias("diagnosis"), F.col(patient).cast("string").alias("p"), F.col(admission).cast("string").alias("a")).where("p IS NOT NULL AND a IS NOT NULL")
    return rows


def cross_pairs(admissions: DataFrame, patient: str, admission: str, diagnosis: str, excluded: Iterable[str] = ("NEWBORN",), block_rows: int = PAIR_BLOCK) -> DataFrame:
    """Pairs of admissions of different patients with the same principal diagnosis, each pair once, ids by text order.

    A diagnosis of more than ``block_rows`` admissions is dealt in blocks, and each two of them (a triangle) meet in a task
    of their own. Rows without a diagnosis, a patient or an admission take no part; a row that repeats is in pairs as often.
    """
    rows = _diagnosed(admissions, patient, admission, diagnosis, excluded)
    hot = rows.groupBy("diagnosis").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).where("blocks > 1")
    rows = rows.join(hot, "diagnosis", "left").select("diagnosis", "p", "a", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("p", "a"), F.col("blocks")).cast("int"))
    low = rows.select("diagnosis", F.col("own").alias("low"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("high"), F.col("p").alias("p1"), F.col("a").alias("a1"))
    high = rows.select("diagnosis", F.explode(F.sequence(F.lit(0), "own")).alias("low"), F.col("own").alias("high"), F.col("p").alias("p2"), F.col("a").alias("a2"))
    met = low.join(high, ["diagnosis", "low", "high"]).where("p1 < p2 OR (low < high AND p1 > p2)")
    ordered = F.col("p1") < F.col("p2")
    pick = lambda x, y: F.when(ordered, F.col(x)).otherwise(F.col(y))
    return met.select("diagnosis", pick("p1", "p2").alias("patient_1"), pick("a1", "a2").alias("admission_1"), pick("p2", "p1").alias("patient_2"), pick("a2", "a1").alias("admission_2"))


def capped_cross_pairs(admissions: DataFrame, patient: str, admission: str, diagnosis: str, most: int = MOST_CROSS, excluded: Iterable[str] = ("NEWBORN",), block_rows: int = PAIR_BLOCK, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """cross_pairs(), as many as ``most`` of each two patients, by their stable rank, with their place.

    A pair that can't be among them doesn't leave the task that makes it: Spark limits each group before the shuffle. More
    than ``task_pairs`` pairs aren't shuffled at all: admissions are, to where all pairs of their patients are made. If that
    is in more than COPIES places, they go to the others of their diagnosis, once, with the other admissions of their patient,
    unless a patient has more than OWN_FEW or there are more than NAMED diagnoses.
    """
    with released(admissions.sparkSession):  # what made the admissions isn't held beside their pairs
        rows = staged(_diagnosed(admissions, patient, admission, diagnosis, excluded).withColumn("i", F.monotonically_increasing_id()), "diagnosed")
    n = F.col("count")
    counts = rows.groupBy("diagnosis").count()
    pairs, names = counts.agg(F.sum(n * (n - 1) / 2), F.count("*")).first()
    pairs = pairs or 0
    blocks = math.ceil(math.sqrt(2 * pairs / task_pairs))
    if blocks > COPIES and names <= NAMED and rows.groupBy("p").count().where(n > OWN_FEW).isEmpty():
        return _capped_by_diagnoses(rows, counts, most, block_rows, math.ceil(pairs / task_pairs))
    if pairs <= task_pairs:
        pairs, together = cross_pairs(rows, "p", "a", "diagnosis", (), block_rows), []
    else:
        pairs, together = _pairs_by_patients(rows, blocks), ["low", "high"]
    pairs = pairs.withColumn("stable_rank", stable_rank(F.col("diagnosis"), F.col("admission_1"), F.col("admission_2")))
    w = Window.partitionBy(*together, "patient_1", "patient_2").orderBy("stable_rank", "diagnosis", "admission_1", "admission_2")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop(*together)


def _capped_by_diagnoses(rows: DataFrame, counts: DataFrame, most: int, block_rows: int, tasks: int) -> DataFrame:
    """capped_cross_pairs() of (diagnosis, p, a, i): all pairs of two blocks of a diagnosis are made in one task, which has what tells their places.

    Each admission goes to its block, once for each block of its diagnosis, with all admissions of its patient (diagnoses
    by number). Patients who have one diagnosis in common, each once, have one pair; of others all pairs are put in order
    for each pair, which then has its place among them. i numbers the rows, which may repeat.
    """
    spark = rows.sparkSession
    blocks = F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")
    names = F.broadcast(staged(counts.select("diagnosis", F.row_number().over(Window.orderBy("diagnosis")).alias("d"), blocks), "names"))  # NAMED at most
    own = F.collect_list(F.struct("d", "a", "i")).over(Window.partitionBy("p"))
    known = rows.join(names, "diagnosis").select("d", "p", "a", "i", "blocks").withColumn("own", own)
    once = F.size(F.filter("own.d", lambda d: d == F.col("d"))) == 1
    member = F.struct("p", "a", "i", once.alias("once"), F.array_distinct("own.d").alias("kinds"), F.col("own.d").alias("ds"), F.col("own.a").alias("as"), F.col("own.i").alias("is"))
    dealt = known.select("d", F.pmod(F.xxhash64("p", "a"), F.col("blocks")).cast("int").alias("block"), member.alias("m"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("d", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "m")
    dealt = dealt.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "d", "low", "high")
    side = lambda name: F.collect_list(F.when(F.col("block") == F.col(name), F.col("m"))).alias(name[0])
    met = dealt.groupBy("d", "low", "high").agg(side("low"), side("high")).where("size(h) > 0")
    met = met.select("d", "low", "high", F.explode("l").alias("x"), "h").select("d", "low", "high", "x", F.explode("h").alias("y")).where("x.p < y.p OR (low < high AND x.p > y.p)")
    # most pairs are alone: what their patients have besides stays behind
    alone = F.col("x.once") & F.col("y.once") & (F.size(F.array_intersect("x.kinds", "y.kinds")) == 1)
    met = met.withColumn("alone", alone).withColumn("turned", F.col("x.p") > F.col("y.p"))
    first, second = (lambda c, one=one, two=two: F.when(F.col("turned"), F.col(f"{two}.{c}")).otherwise(F.col(f"{one}.{c}")) for one, two in ("xy", "yx"))
    light = [side(c).alias(f"{c}_{k}") for k, side in ((1, first), (2, second)) for c in "pai"]
    beside = [F.when(~F.col("alone"), F.struct(*[side(c).alias(c) for c in ("ds", "as", "is")])).alias(f"own_{k}") for k, side in ((1, first), (2, second))]
    met = met.select("d", "low", "high", *light, *beside)
    pair = lambda d, a1, i1, a2, i2: F.struct(d.alias("d"), a1.alias("admission_1"), i1.alias("i1"), a2.alias("admission_2"), i2.alias("i2"))
    held = lambda c: F.arrays_zip(F.col(f"{c}.ds").alias("d"), F.col(f"{c}.as").alias("a"), F.col(f"{c}.is").alias("i"))
    every = F.flatten(F.transform(held("own_1"), lambda e: F.transform(F.filter(held("own_2"), lambda f: f["d"] == e["d"]), lambda f: pair(e["d"], e["a"], e["i"], f["a"], f["i"]))))
    shared = F.coalesce(every, F.array(pair(*[F.col(c) for c in ("d", "a_1", "i_1", "a_2", "i_2")])))
    met = met.select(F.col("d").alias("of"), "low", "high", F.col("p_1").alias("patient_1"), F.col("p_2").alias("patient_2"), F.col("i_1").alias("own1"), F.col("i_2").alias("own2"), F.explode_outer(shared).alias("s"))
    met = met.select("of", "low", "high", "patient_1", "patient_2", "own1", "own2", "s.*").join(names.select("d", "diagnosis"), "d")
    met = met.withColumn("stable_rank", stable_rank(F.col("diagnosis"), F.col("admission_1"), F.col("admission_2")))
    w = Window.partitionBy("of", "low", "high", "own1", "own2").orderBy("stable_rank", "diagnosis", "admission_1", "admission_2", "i1", "i2")
    out = met.withColumn("place", F.row_number().over(w)).where((F.col("place") <= most) & (F.col("own1") == F.col("i1")) & (F.col("own2") == F.col("i2")))
    return out.select("diagnosis", "patient_1", "admission_1", "patient_2", "admission_2", "stable_rank", "place")


def _pairs_by_patients(rows: DataFrame, blocks: int) -> DataFrame:
    """cross_pairs() of (diagnosis, p, a) with low, high: patients are dealt in blocks, and all pairs of two blocks are in one task.

    What is shuffled is each block's list of admissions of a diagnosis, once for every block.
    """
    lists = rows.groupBy("diagnosis", F.pmod(F.xxhash64("p"), F.lit(blocks)).cast("int").alias("own")).agg(F.collect_list(F.struct("p", "a")).alias("members"))
    dealt = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "diagnosis", "own", "members")
    side = lambda name: F.flatten(F.collect_list(F.when(F.col("own") == F.col(name), F.col("members"))))
    met = dealt.repartition(blocks * (blocks + 1) // 2, "low", "high").groupBy("low", "high", "diagnosis").agg(side("low").alias("x"), side("high").alias("y"))
    met = met.where("size(y) > 0").select("low", "high", "diagnosis", F.explode("x").alias("x"), "y").select("low", "high", "diagnosis", "x", F.explode("y").alias("y"))
    met = met.where("x.p < y.p OR (low < high AND x.p > y.p)")
    first, second = F.when(F.col("x.p") < F.col("y.p"), F.col("x")).otherwise(F.col("y")), F.when(F.col("x.p") < F.col("y.p"), F.col("y")).otherwise(F.col("x"))
    met = met.select("low", "high", "diagnosis", first.alias("x"), second.alias("y"))
    return met.select("low", "high", "diagnosis", F.col("x.p").alias("patient_1"), F.col("x.a").alias("admission_1"), F.col("y.p").alias("patient_2"), F.col("y.a").alias("admission_2"))


def relation(a: Column, b: Column) -> Column:
    """same or different; null if either value is missing."""
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a == b, F.lit("same")).otherwise(F.lit("different"))


def trend(a: Column, b: Column) -> Column:
    return F.when(a == b, "unchanged").when(b > a, "increased").when(b < a, "decreased")


def over_cap(items: DataFrame, kind: str, patients: Column, caps: dict[str, int]) -> DataFrame:
    """The groups of items of one kind and patient set that are more than their cap; none in a valid set."""
    counted = items.groupBy(F.col(kind).alias("kind"), F.array_join(F.array_sort(F.array_distinct(patients)), ",").alias("patients")).agg(F.count("*").alias("n"))
    limit = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    return counted.where(F.col("n") > F.try_element_at(limit, F.col("kind")))


def select_balanced(candidates: DataFrame, cap: int) -> list[dict]:
    """One candidate per source set, by use of fields and relations so far, within a cap per patient set.

    candidates(source_set, group, priority, field, relation, rank, grounded): source sets are visited by priority
    and rank; in a set the grounded candidate whose field, then relation, has been chosen least wins, ties to the
    rank. Grounding is settled in Spark before; the fold sees narrow rows of grounded candidates only.
    """
    rows = candidates.where("grounded").select("source_set", "group", "priority", "field", "relation", "rank").toLocalIterator()
    sets: dict[str, list] = {}
    for r in rows:
        sets.setdefault(r.source_set, []).append(r)
    fields, relations, groups, chosen = Counter(), Counter(), Counter(), []
    for members in sorted(sets.values(), key=lambda m: (m[0].priority, min(r["rank"] for r in m))):
        if groups[members[0].group] >= cap:
            continue
        best = min(members, key=lambda r: (fields[r.field], relations[r.field, r.relation], r["rank"]))
        chosen.append(best.asDict())
        fields[best.field] += 1
        relations[best.field, best.relation] += 1
        groups[best.group] += 1
    return chosen


def balanced_choice(candidates: DataFrame, cap: int, range_sets: int = RANGE_SETS) -> DataFrame:
    """(source_set, group, field, relation): select_balanced() as a table, for any number of candidates.

    Caps don't depend on what is chosen, so they are a window. What is chosen of a set depends on the fields and relations
    of its members in order of their ranks, of which there are few kinds: the fold reads the kinds of the sets in the order
    they are visited, one range of about ``range_sets`` at a time, and keeps one digit for each set.
    """
    spark = candidates.sparkSession
    members = F.array_sort(F.collect_list(F.struct("rank", "field", "relation")))
    sets = candidates.where("grounded").groupBy("source_set").agg(F.min("group").alias("group"), F.min("priority").alias("priority"), members.alias("members"))
    sets = sets.withColumns({"first": F.col("members")[0]["rank"], "kind": F.to_json(F.transform("members", lambda m: F.array(m["field"], m["relation"])))})
    within_cap = F.row_number().over(Window.partitionBy("group").orderBy("priority", "first", "source_set"))
    sets = staged(sets.withColumn("_n", within_cap).where(F.col("_n") <= cap).drop("_n"), "sets")
    ranges = max(1, math.ceil(sets.count() / range_sets))
    dealt = staged(sets.repartitionByRange(ranges, "priority", "first", "source_set").withColumn("range", F.spark_partition_id()), "dealt")
    place = F.row_number().over(Window.partitionBy("range").orderBy("priority", "first", "source_set"))
    placed = staged(dealt.withColumn("place", place - 1), "placed")
    texts = [r.kind for r in placed.select("kind").distinct().orderBy("kind").collect()]
    kinds = [json.loads(k) for k in texts]
    numbers = spark.createDataFrame([(k, i) for i, k in enumerate(texts)], "kind string, number int")
    order = placed.join(numbers, "kind").groupBy("range").agg(F.array_sort(F.collect_list(F.struct("place", "number"))).alias("x")).select("range", "x.number").orderBy("range")
    fields, relations, chosen = Counter(), Counter(), []
    for r in order.toLocalIterator():
        best = []
        for number in r.number:
            kind = kinds[number]
            at = min(range(len(kind)), key=lambda m: (fields[kind[m][0]], relations[tuple(kind[m])], m))
            fields[kind[at][0]] += 1
            relations[tuple(kind[at])] += 1
            best.append(at)
        chosen.append((r.range, ",".join(map(str, best))))
    chosen = spark.createDataFrame(chosen, "range int, best string").select("range", F.posexplode(F.split("best", ",")).alias("place", "at"))
    picked = placed.join(chosen, ["range", "place"]).withColumn("m", F.get("members", F.col("at").cast("int")))
    return picked.select("source_set", "group", "m.field", "m.relation")


def capped(items: DataFrame, group: list[str], order: list[str], kind: str, caps: dict[str, int]) -> DataFrame:
    """The first items of each group by order, as many as the cap of their kind."""
    limit = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return items.withColumn("_n", place).where(F.col("_n") <= F.try_element_at(limit, F.col(kind))).drop("_n")


def split_by_scope(items: DataFrame, kind: str) -> DataFrame:
    """items with split: same_patient or cross_patient; an unknown kind is an error."""
    known = F.when(F.col(kind).startswith("same_patient"), "same_patient").when(F.col(kind).startswith("cross_patient"), "cross_patient")
    return items.withColumn("split", F.coalesce(known, F.raise_error(F.concat(F.lit("unknown kind: "), F.col(kind)))))
