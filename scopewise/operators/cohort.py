"""Cohort building: admissions with attributes, representative admissions, strata and the stratified sample."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopewise.functions.text import stripped
from scopewise.sources.staging import staged

BANDS = ("Q1_0-20", "Q2_20-40", "Q3_40-60", "Q4_60-80", "Q5_80-100")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys, in as many partitions as the session has for shuffles.

    Adaptive execution would put partitions together by their bytes: what a task sorts or holds would grow with the input.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def note_lengths(notes: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Summed length of the stripped texts per key; rows without text count nothing."""
    return notes.where(F.col(text_col).isNotNull()).groupBy(*keys).agg(F.sum(F.length(stripped(F.col(text_col)))).alias("note_length"))


def first_by(rows: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """Per key the first non-null value of each column in the order given, column by column."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    picked = rows.select(*keys, *[F.first(c, ignorenulls=True).over(w).alias(c) for c in columns])
    return picked.dropDuplicates(keys)


def first_service(services: DataFrame, keys: list[str], service: str, time: str, tie: str) -> DataFrame:
    """The service of the earliest transfer with one."""
    return services.where(F.col(service).isNotNull()).groupBy(*keys).agg(F.min_by(service, F.struct(time, tie)).alias("service"))


def diagnoses(rows: DataFrame, dictionary: DataFrame, keys: list[str], code: list[str], seq: str, title: str) -> DataFrame:
    """Per key the number of diagnoses and the first title by sequence; codes are matched without blanks around them.

    Codes that the dictionary doesn't know have no title, and the next one's counts.
    """
    trimmed = {c: F.trim(F.col(c).cast("string")) for c in code}
    titled = rows.withColumns(trimmed).join(dictionary.select(*code, title).withColumns(trimmed), code, "left")
    order = F.when(F.col(title).isNotNull(), F.struct(seq, *code))
    return titled.groupBy(*keys).agg(F.count("*").alias("num_diagnoses"), F.min_by(title, order).alias("diagnosis"))


def attributes(admissions: DataFrame, keys: list[str], diagnosed: DataFrame, icu: DataFrame, served: DataFrame) -> DataFrame:
    """admissions with num_diagnoses (0 if none), had_icu_stay, diagnosis and service."""
    return (
        admissions.join(diagnosed, keys, "left")
        .join(icu.select(*keys).distinct().withColumn("_icu", F.lit(True)), keys, "left")
        .join(served, keys, "left")
        .withColumn("num_diagnoses", F.coalesce("num_diagnoses", F.lit(0)))
        .withColumn("had_icu_stay", F.coalesce("_icu", F.lit(False)))
        .drop("_icu")
    )


def representative(admissions: DataFrame, patient: str, order: list[str]) -> DataFrame:
    """The earliest admission of each patient."""
    w = Window.partitionBy(patient).orderBy(*order)
    return admissions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unmatched(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, a, b) of the keys that only rows of one side have: a and b are summed, and one is 0. Null keys match nothing.

    Keys are summed once, dealt by key.
    """
    summed = dealt(rows, key).groupBy(key).agg(F.sum(a).alias(a), F.sum(b).alias(b))
    return summed.where(f"{a} = 0 OR {b} = 0 OR {key} IS NULL")


def shares(rows: DataFrame, column: str) -> DataFrame:
    """(value, share) over the rows with a value."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).count().select("value", (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"))


def at_places(rows: DataFrame, column: str, places: Callable[[int], list[int]]) -> list:
    """The values of a column at places(n) of its n values in order, counted from 0; nulls come first.

    Counts per value are dealt out by ranges of values and summed by range, one number each; only the ranges that hold
    a place are then put in order, each by itself.
    """
    counts = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    ranged = staged(counts.repartitionByRange(F.col("v").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "values")
    sums = sorted((r.part, r.c) for r in ranged.groupBy("part").agg(F.sum("c").alias("c")).collect())
    n, before = sum(c for _, c in sums), {}
    wanted = places(n) if n else []
    for (part, c), low in zip(sums, accumulate((c for _, c in sums), initial=0), strict=False):
        if any(low <= at < low + c for at in wanted):
            before[part] = low
    if not before:
        return [None] * len(places(1))
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part"))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)) + start
    held = ranged.where(F.col("part").isin(list(before))).withColumn("upto", upto)
    return list(held.agg(*[F.max(F.when((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at), F.col("v"))) for at in wanted]).first())


def quintiles(rows: DataFrame, column: str) -> DataFrame:
    """rows with quintile: the first band whose cut, the value at place band x n div 5, is not below the value.

    The cuts are exact order statistics, see at_places.
    """
    cuts = at_places(rows, column, lambda n: [min(n - 1, n * band // 5) for band in range(1, 5)])
    label: Column = F.lit(BANDS[4])
    for name, cut in reversed(list(zip(BANDS, cuts, strict=False))):
        label = F.when(F.col(column) <= F.lit(cut), F.lit(name)).otherwise(label)
    return rows.withColumn("quintile", label)


def balance(population: DataFrame, selected: DataFrame, column: str) -> DataFrame:
    """(value, population_n, population_pct, selected_n, selected_pct) over the union of values."""
    def counted(rows: DataFrame, name: str) -> DataFrame:
        n = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias(f"{name}_n"))
        return n.withColumn(f"{name}_pct", F.col(f"{name}_n") * 100.0 / F.sum(f"{name}_n").over(Window.partitionBy()))

    return counted(population, "population").join(counted(selected, "selected"), "value", "full").fillna(0).fillna(0.0)


def category_counts(notes: DataFrame, keys: list[str], category: str) -> DataFrame:
    """(keys, categories): a map of note counts by category."""
    return notes.groupBy(*keys, category).count().groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "count")))).alias("categories"))


def detail_map(details: DataFrame, key: str, field: str, value: str, order: list[str]) -> DataFrame:
    """(key, details): a map of field to its values in order, joined by '; '."""
    values = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value].cast("string")), "; ")
    fields = details.where(F.col(value).isNotNull()).groupBy(key, field).agg(values.alias("v"))
    return fields.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, "v")))).alias("details"))


def select_stratified(people: DataFrame, id_col: str, strata: list[str], n: int, seed: int = 42) -> list:
    """A sample of n ids whose strata stay within the population's shares as it grows, filled up in order.

    The rule counts each choice before the next, so it is a fold: over one row of (id, strata) per person, which a
    cohort's driver holds; everything before it is distributed.
    """
    rows = {r[0]: tuple(r[1:]) for r in people.select(id_col, *strata).toLocalIterator()}
    counts = [Counter(v[i] for v in rows.values() if v[i] is not None) for i in range(len(strata))]
    wanted = [{v: c / sum(counter.values()) for v, c in counter.items()} for counter in counts]
    order = sorted(rows)
    random.Random(seed).shuffle(order)
    chosen: dict = {}
    taken = [Counter() for _ in strata]

    def fits(values: tuple) -> bool:
        return all(taken[i][v] / (len(chosen) + 1) <= wanted[i].get(v, 0) for i, v in enumerate(values))

    for relaxed in (False, True):
        for key in order:
            if len(chosen) < n and key not in chosen and (relaxed or fits(rows[key])):
                chosen[key] = None
                for i, v in enumerate(rows[key]):
                    taken[i][v] += 1
    return list(chosen)
