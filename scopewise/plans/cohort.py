"""Queries over the cohort and question-candidate operators, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopewise.functions import labels as L
from scopewise.operators import assignment, candidates, cohort
from scopewise.plans.tables import admission_attributes as attributes
from scopewise.plans.tables import admissions, diagnoses, table


def note_length_sum(spark: SparkSession, d: str) -> DataFrame:
    return cohort.note_lengths(table(spark, d, "documents"), ["source", "lang"], "text")


def diagnosis_counts(spark: SparkSession, d: str) -> DataFrame:
    return diagnoses(spark, d)[0].groupBy("hadm_id").agg(F.count("*").alias("num_diagnoses"))


def principal_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    return cohort.diagnoses(*diagnoses(spark, d), ["hadm_id"], ["icd_code", "icd_version"], "seq_num", "long_title").select("hadm_id", "diagnosis")


def first_service(spark: SparkSession, d: str) -> DataFrame:
    return attributes(spark, d).where("service IS NOT NULL").select("hadm_id", "service")


def icu_flag(spark: SparkSession, d: str) -> DataFrame:
    return attributes(spark, d).select("hadm_id", "had_icu_stay")


def admission_attributes(spark: SparkSession, d: str) -> DataFrame:
    return attributes(spark, d).select("subject_id", "hadm_id", "admittime", "admission_type", "num_diagnoses", "diagnosis", "had_icu_stay", "service")


def representative_admission(spark: SparkSession, d: str) -> DataFrame:
    return cohort.representative(admissions(spark, d), "subject_id", ["admittime", "hadm_id"]).select("subject_id", "hadm_id", "admittime")


def first_non_null(spark: SparkSession, d: str) -> DataFrame:
    """Per customer the first non-null value of each column in time order: a status only counts for odd orders."""
    rows = admissions(spark, d).withColumn("status", F.expr("CASE WHEN hadm_id % 2 = 1 THEN status END"))
    return cohort.first_by(rows, ["subject_id"], ["admittime", "hadm_id"], ["status", "admission_type"])


def stratum_shares(spark: SparkSession, d: str) -> DataFrame:
    return cohort.shares(table(spark, d, "customer"), "c_mktsegment").select("value", F.round("share", 6).alias("share"))


def quintile_bucket(spark: SparkSession, d: str) -> DataFrame:
    return cohort.quintiles(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


def balance_report(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer")
    rows = cohort.balance(people, people.where("c_acctbal > 5000"), "c_mktsegment")
    return rows.select("value", "population_n", "selected_n", F.round("population_pct", 6).alias("population_pct"), F.round("selected_pct", 6).alias("selected_pct"))


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = cohort.category_counts(table(spark, d, "documents"), ["source"], "lang")
    return rows.select("source", F.array_join(F.transform(F.map_entries("categories"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("categories"))


def detail_map(spark: SparkSession, d: str) -> DataFrame:
    rows = cohort.detail_map(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_partkey", ["l_linenumber"])
    return rows.select("l_orderkey", F.array_join(F.transform(F.map_entries("details"), lambda e: F.concat_ws(": ", e["key"], e["value"])), " | ").alias("details"))


def los_days(spark: SparkSession, d: str) -> DataFrame:
    stays = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("hadm_id")).agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("dischtime"))
    return admissions(spark, d).join(stays, "hadm_id").select("hadm_id", L.stay_days(F.col("admittime"), F.col("dischtime")).alias("los"))


def age_topcode(spark: SparkSession, d: str) -> DataFrame:
    rows = admissions(spark, d)
    return rows.select("hadm_id", L.age_at((F.col("subject_id") % 100).cast("int"), F.lit(1997), F.col("admittime")).alias("age"))


def label_map(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d).select("hadm_id", L.admission_type(F.col("code")).alias("admission_label"), L.discharge_location(F.col("place")).alias("discharge_label"))


def _coded(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("hadm_id") % len(xs) + 1).cast("int"))
    rows = admissions(spark, d)
    return rows.select("hadm_id", pick(["URGENT", "ew emer.", " Elective ", "nan", "other kind"]).alias("code"), pick(["DIED", "HOME HEALTH CARE", "skilled NURSING", "", "AGAINST ADVICE", "none", "REHAB"]).alias("place"), pick(["WHITE - RUSSIAN", "black/african", "UNKNOWN", "ASIAN", "South American", "PORTUGUESE", "None"]).alias("race"))


def race_group_case(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d).select("hadm_id", L.race_group(F.col("race")).alias("race_group"))


def disposition_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = _coded(spark, d)
    section = F.when(F.col("hadm_id") % 3 == 0, F.lit(" Home "))
    return rows.select("hadm_id", L.disposition(L.discharge_location(F.col("place")), F.col("hadm_id") % 5 == 0, section).alias("disposition"))


def stratified_greedy_sample(spark: SparkSession, d: str) -> DataFrame:
    people = cohort.quintiles(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal")
    chosen = cohort.select_stratified(people, "c_custkey", ["c_mktsegment", "quintile"], 300)
    return spark.createDataFrame([(i, k) for i, k in enumerate(chosen)], "place int, c_custkey bigint")


COLUMNS = ["hadm_id", "service", "num_diagnoses"]


def consecutive_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates.windows(attributes(spark, d), "subject_id", ["admittime", "hadm_id"], 2, COLUMNS, candidates.MOST_PAIRS)
    return rows.select("subject_id", "window_idx", "window_count", "priority", "hadm_id_1", "hadm_id_2", candidates.trend(F.col("num_diagnoses_1"), F.col("num_diagnoses_2")).alias("trend"))


def trajectories(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates.windows(attributes(spark, d), "subject_id", ["admittime", "hadm_id"], 3, COLUMNS, candidates.MOST_TRAJECTORIES)
    return rows.select("subject_id", "window_idx", "window_count", "priority", "hadm_id_1", "hadm_id_2", "hadm_id_3")


def compare_relation(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates.windows(attributes(spark, d), "subject_id", ["admittime", "hadm_id"], 2, COLUMNS, candidates.MOST_PAIRS)
    return rows.select("hadm_id_1", "hadm_id_2", candidates.relation(F.col("service_1"), F.col("service_2")).alias("relation"))


def cross_patient_pairs(spark: SparkSession, d: str) -> DataFrame:
    return candidates.cross_pairs(attributes(spark, d), "subject_id", "hadm_id", "diagnosis")


def cross_patient_capped(spark: SparkSession, d: str) -> DataFrame:
    """The one cross-patient pair of each two patients that stays under the cap."""
    return candidates.capped_cross_pairs(attributes(spark, d), "subject_id", "hadm_id", "diagnosis").drop("place")


def spread_priority(spark: SparkSession, d: str) -> DataFrame:
    rows = admissions(spark, d).groupBy("subject_id").agg(F.count("*").alias("windows")).select("subject_id", "windows", F.explode(F.sequence(F.lit(0), F.col("windows").cast("int") - 1)).alias("idx"))
    spread = lambda cap: candidates.spread_priority(F.col("idx"), F.col("windows"), cap)
    return rows.select("subject_id", "windows", "idx", spread(1).alias("cap_1"), spread(2).alias("cap_2"), spread(4).alias("cap_4"))


def stable_hash_order(spark: SparkSession, d: str) -> DataFrame:
    return admissions(spark, d).select("hadm_id", candidates.stable_rank(F.col("subject_id"), F.col("hadm_id")).alias("stable_rank"))


def cap_check(spark: SparkSession, d: str) -> DataFrame:
    items = admissions(spark, d).select(F.lit("same_patient_two_admissions").alias("kind"), F.array(F.col("subject_id").cast("string"), F.col("subject_id").cast("string")).alias("patients"))
    return candidates.over_cap(items, "kind", F.col("patients"), {"same_patient_two_admissions": 10})


def split_by_type(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("hadm_id") % 3 == 0, "cross_patient_two_admissions").when(F.col("hadm_id") % 3 == 1, "same_patient_two_admissions").otherwise("same_patient_three_admission_trajectory")
    return candidates.split_by_scope(admissions(spark, d).select("hadm_id", kind.alias("kind")), "kind")


def sibling_admissions(spark: SparkSession, d: str) -> DataFrame:
    """Admissions whose patient has another one with a different diagnosis."""
    rows = attributes(spark, d).where("diagnosis IS NOT NULL")
    w = Window.partitionBy("subject_id")
    return rows.select("hadm_id", F.min("diagnosis").over(w).alias("a"), F.max("diagnosis").over(w).alias("b")).where("a <> b").select("hadm_id")


def missing_admissions(spark: SparkSession, d: str) -> DataFrame:
    """Admissions without diagnoses, and diagnoses without an admission."""
    a, b = admissions(spark, d).select("hadm_id", F.lit(1).alias("a"), F.lit(0).alias("b")), diagnoses(spark, d)[0].select("hadm_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    rows, lone = cohort.unmatched(a.unionByName(b), "hadm_id", "a", "b"), F.col("hadm_id").isNull()
    missing, unexpected = F.when(lone | (F.col("b") == 0), F.col("a")).otherwise(0).cast("int"), (F.col("b") > 0) & (lone | (F.col("a") == 0))
    sides = F.concat(F.array_repeat(F.lit("missing"), missing), F.array_repeat(F.lit("unexpected"), unexpected.cast("int")))
    return rows.select("hadm_id", F.explode(sides).alias("side"))


def balanced_type_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Two return flags or statuses for each order, with even use of each."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.explode(F.array("l_returnflag", "l_linestatus")).alias("t")).groupBy("l_orderkey").agg(F.collect_set("t").alias("types"))
    return assignment.assigned(rows, "l_orderkey", "types").select("l_orderkey", F.array_join("types", ",").alias("types"))


QUERIES = {
    f.__name__: f
    for f in (
        note_length_sum, diagnosis_counts, principal_diagnosis, first_service, icu_flag, admission_attributes, representative_admission, first_non_null, stratum_shares, quintile_bucket,
        balance_report, category_counts, detail_map, los_days, age_topcode, label_map, race_group_case, disposition_cascade, stratified_greedy_sample, consecutive_pairs, trajectories,
        compare_relation, cross_patient_pairs, cross_patient_capped, spread_priority, stable_hash_order, cap_check, split_by_type, sibling_admissions, missing_admissions, balanced_type_assignment,
    )
}

_DIAGNOSED = """
    dx AS (SELECT l_orderkey AS hadm_id, l_linenumber AS seq, CAST(l_partkey AS VARCHAR) AS code, p_name || ' ' || p_brand || ' ' || CAST(p_size AS VARCHAR) AS title
           FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 11 <> 0),
    diagnosed AS (SELECT hadm_id, count(*) AS num_diagnoses, arg_min(title, (seq, code)) FILTER (title IS NOT NULL) AS diagnosis FROM dx GROUP BY hadm_id),
    icu AS (SELECT DISTINCT l_orderkey AS hadm_id FROM lineitem WHERE l_returnflag = 'R'),
    served AS (SELECT l_orderkey AS hadm_id, arg_min(l_suppkey, (l_shipdate, l_linenumber, l_suppkey)) AS service FROM lineitem GROUP BY l_orderkey),
    adm AS (SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS admittime, o_orderpriority AS admission_type, o_orderstatus AS status FROM orders),
    att AS (SELECT adm.*, coalesce(num_diagnoses, 0) AS num_diagnoses, diagnosis, icu.hadm_id IS NOT NULL AS had_icu_stay, service
            FROM adm LEFT JOIN diagnosed USING (hadm_id) LEFT JOIN icu USING (hadm_id) LEFT JOIN served USING (hadm_id))"""
_CROSS = """
    s AS (SELECT lower(trim(diagnosis)) AS diagnosis, CAST(subject_id AS VARCHAR) AS patient, CAST(hadm_id AS VARCHAR) AS admission FROM att WHERE trim(diagnosis) <> ''),
    x AS (SELECT diagnosis, a.patient AS patient_1, a.admission AS admission_1, b.patient AS patient_2, b.admission AS admission_2 FROM s a JOIN s b USING (diagnosis) WHERE a.patient < b.patient)"""
_CODED = """
    coded AS (SELECT o_orderkey AS hadm_id, ['Urgent', 'Emergency', 'Elective', '', 'Other Kind'][CAST(o_orderkey % 5 + 1 AS BIGINT)] AS admission_label,
              [NULL, 'Home with home health care', 'Skilled nursing', NULL, 'Left against medical advice', NULL, 'Rehab'][CAST(o_orderkey % 7 + 1 AS BIGINT)] AS discharge_label,
              ['White', 'Black', 'Unknown', 'Asian', 'Hispanic or Latino', 'Other', 'Unknown'][CAST(o_orderkey % 7 + 1 AS BIGINT)] AS race_group FROM orders)"""


def _spread(cap: int, idx: str = "idx", n: str = "windows") -> str:
    if cap == 1:
        places = f"[({n} - 1) // 2]"
    else:
        places = f"list_distinct(list_transform(range({cap}), lambda i: CAST(round_even(i * ({n} - 1) / {cap - 1}.0::DOUBLE, 0) AS BIGINT)))"
    at = f"list_position(list_sort({places}), {idx})"
    rest = f"len({places}) + {idx} - len(list_filter({places}, lambda p: p < {idx}))"
    return f"CAST(CASE WHEN {n} <= {cap} THEN {idx} WHEN list_contains({places}, {idx}) THEN {at} - 1 ELSE {rest} END AS INTEGER)"


def _windows(length: int, cap: int, columns: str) -> str:
    ahead = ", ".join(f"lead({c}, {k}) OVER w AS {c}_{k + 1}" for k in range(1, length) for c in ("hadm_id", "service", "num_diagnoses"))
    return f"""WITH {_DIAGNOSED},
        w AS (SELECT subject_id, hadm_id AS hadm_id_1, service AS service_1, num_diagnoses AS num_diagnoses_1, {ahead},
                     row_number() OVER w - 1 AS window_idx, count(*) OVER (PARTITION BY subject_id) - {length - 1} AS window_count
              FROM att WINDOW w AS (PARTITION BY subject_id ORDER BY admittime, hadm_id)),
        p AS (SELECT *, {_spread(cap, 'window_idx', 'window_count')} AS priority FROM w WHERE window_idx < window_count)
        SELECT {columns} FROM p"""


_KEYS = "subject_id, CAST(window_idx AS INTEGER) AS window_idx, window_count, priority, hadm_id_1, hadm_id_2"
ORACLE_SQL = {
    "note_length_sum": r"SELECT source, lang, CAST(sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS BIGINT) AS note_length FROM documents WHERE text IS NOT NULL GROUP BY source, lang",
    "diagnosis_counts": "SELECT l_orderkey AS hadm_id, count(*) AS num_diagnoses FROM lineitem GROUP BY l_orderkey",
    "principal_diagnosis": f"WITH {_DIAGNOSED} SELECT hadm_id, diagnosis FROM diagnosed",
    "first_service": f"WITH {_DIAGNOSED} SELECT hadm_id, service FROM att WHERE service IS NOT NULL",
    "icu_flag": f"WITH {_DIAGNOSED} SELECT hadm_id, had_icu_stay FROM att",
    "admission_attributes": f"WITH {_DIAGNOSED} SELECT subject_id, hadm_id, admittime, admission_type, num_diagnoses, diagnosis, had_icu_stay, service FROM att",
    "representative_admission": f"WITH {_DIAGNOSED} SELECT subject_id, hadm_id, admittime FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS n FROM adm) WHERE n = 1",
    "first_non_null": f"""WITH {_DIAGNOSED}
        SELECT subject_id, arg_min(status, (admittime, hadm_id)) FILTER (hadm_id % 2 = 1) AS status, arg_min(admission_type, (admittime, hadm_id)) AS admission_type FROM adm GROUP BY subject_id""",
    "stratum_shares": "SELECT c_mktsegment AS value, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment",
    "quintile_bucket": """
        WITH s AS (SELECT list(c_acctbal ORDER BY c_acctbal) AS v, count(*) AS n FROM customer)
        SELECT c_custkey, c_acctbal,
               CASE WHEN c_acctbal <= v[CAST(least(n - 1, n // 5) + 1 AS BIGINT)] THEN 'Q1_0-20' WHEN c_acctbal <= v[CAST(least(n - 1, 2 * n // 5) + 1 AS BIGINT)] THEN 'Q2_20-40'
                    WHEN c_acctbal <= v[CAST(least(n - 1, 3 * n // 5) + 1 AS BIGINT)] THEN 'Q3_40-60' WHEN c_acctbal <= v[CAST(least(n - 1, 4 * n // 5) + 1 AS BIGINT)] THEN 'Q4_60-80'
                    ELSE 'Q5_80-100' END AS quintile
        FROM customer CROSS JOIN s""",
    "balance_report": """
        SELECT c_mktsegment AS value, count(*) AS population_n, count(*) FILTER (c_acctbal > 5000) AS selected_n,
               round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS population_pct,
               round(count(*) FILTER (c_acctbal > 5000) * 100.0::DOUBLE / sum(count(*) FILTER (c_acctbal > 5000)) OVER (), 6) AS selected_pct
        FROM customer GROUP BY c_mktsegment""",
    "category_counts": "SELECT source, string_agg(lang || '=' || CAST(n AS VARCHAR), ',' ORDER BY lang) AS categories FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source",
    "detail_map": """
        WITH f AS (SELECT l_orderkey, l_returnflag, string_agg(CAST(l_partkey AS VARCHAR), '; ' ORDER BY l_linenumber, l_partkey) AS v FROM lineitem GROUP BY ALL)
        SELECT l_orderkey, string_agg(l_returnflag || ': ' || v, ' | ' ORDER BY l_returnflag) AS details FROM f GROUP BY l_orderkey""",
    "los_days": """
        WITH s AS (SELECT l_orderkey, min(l_shipdate) AS out FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderkey AS hadm_id, CAST(CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), CAST(out AS DATE)) >= 0
               THEN date_diff('day', CAST(o_orderdate AS DATE), CAST(out AS DATE)) END AS INTEGER) AS los FROM orders JOIN s ON l_orderkey = o_orderkey""",
    "age_topcode": """
        SELECT o_orderkey AS hadm_id, CAST(CASE WHEN o_custkey % 100 >= 91 THEN 91 WHEN o_custkey % 100 + year(o_orderdate) - 1997 >= 0 THEN o_custkey % 100 + year(o_orderdate) - 1997 END AS INTEGER) AS age
        FROM orders""",
    "label_map": f"WITH {_CODED} SELECT hadm_id, admission_label, discharge_label FROM coded",
    "race_group_case": f"WITH {_CODED} SELECT hadm_id, race_group FROM coded",
    "disposition_cascade": f"WITH {_CODED} SELECT hadm_id, coalesce(discharge_label, CASE WHEN hadm_id % 5 = 0 THEN 'Died in hospital' WHEN hadm_id % 3 = 0 THEN 'Home' ELSE 'Not recorded' END) AS disposition FROM coded",
    "consecutive_pairs": _windows(2, 4, f"{_KEYS}, CASE WHEN num_diagnoses_1 = num_diagnoses_2 THEN 'unchanged' WHEN num_diagnoses_2 > num_diagnoses_1 THEN 'increased' ELSE 'decreased' END AS trend"),
    "trajectories": _windows(3, 2, f"{_KEYS}, hadm_id_3"),
    "compare_relation": _windows(2, 4, "hadm_id_1, hadm_id_2, CASE WHEN service_1 IS NULL OR service_2 IS NULL THEN NULL WHEN service_1 = service_2 THEN 'same' ELSE 'different' END AS relation"),
    "cross_patient_pairs": f"WITH {_DIAGNOSED}, {_CROSS} SELECT * FROM x",
    "cross_patient_capped": f"""WITH {_DIAGNOSED}, {_CROSS},
        r AS (SELECT *, substr(sha256('42|' || diagnosis || '|' || admission_1 || '|' || admission_2), 1, 16) AS stable_rank FROM x)
        SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY patient_1, patient_2 ORDER BY stable_rank, diagnosis, admission_1, admission_2) = 1""",
    "spread_priority": f"""
        WITH n AS (SELECT o_custkey AS subject_id, count(*) AS windows FROM orders GROUP BY o_custkey), w AS (SELECT *, unnest(range(windows)) AS idx FROM n)
        SELECT subject_id, windows, CAST(idx AS INTEGER) AS idx, {_spread(1)} AS cap_1, {_spread(2)} AS cap_2, {_spread(4)} AS cap_4 FROM w""",
    "stable_hash_order": "SELECT o_orderkey AS hadm_id, substr(sha256('42|' || CAST(o_custkey AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR)), 1, 16) AS stable_rank FROM orders",
    "cap_check": "SELECT 'same_patient_two_admissions' AS kind, CAST(o_custkey AS VARCHAR) AS patients, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10",
    "split_by_type": """
        SELECT o_orderkey AS hadm_id, ['cross_patient_two_admissions', 'same_patient_two_admissions', 'same_patient_three_admission_trajectory'][CAST(o_orderkey % 3 + 1 AS BIGINT)] AS kind,
               CASE WHEN o_orderkey % 3 = 0 THEN 'cross_patient' ELSE 'same_patient' END AS split FROM orders""",
    "sibling_admissions": f"WITH {_DIAGNOSED} SELECT a.hadm_id FROM att a WHERE a.diagnosis IS NOT NULL AND EXISTS (SELECT 1 FROM att b WHERE b.subject_id = a.subject_id AND b.diagnosis <> a.diagnosis)",
    "missing_admissions": """
        SELECT o_orderkey AS hadm_id, 'missing' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
        UNION ALL SELECT DISTINCT l_orderkey, 'unexpected' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
}
