"""The thin queries over the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopewise.llm.bpe import token_digests
from scopewise.llm.exact_dedup import exact_groups
from scopewise.llm.graph_search import nearest
from scopewise.llm.hard_negatives import hard_negatives, scaled
from scopewise.llm.html_extraction import extract_text
from scopewise.llm.language import identify
from scopewise.llm.line_dedup import line_dedup
from scopewise.llm.mixing import mix
from scopewise.llm.quality import resample
from scopewise.llm.simhash import near_groups
from scopewise.llm.spelling import spelling_variants
from scopewise.llm.substring_dedup import repeated_spans
from scopewise.llm.url_rules import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("hash")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op6_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumns({"label": label, "embedding": scaled(F.col("embedding"))}))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_url_rules": op3_url_rules,
    "op4_bpe": op4_bpe,
    "op5_language": op5_language,
    "op6_graph_search": op6_graph_search,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_html": op11_html,
    "op12_spelling": op12_spelling,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op7_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
            FROM documents),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        weighed AS (
            SELECT *, 2 * source_size AS cap, sum(source_size) OVER () AS all_size,
                   [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)] AS weight
            FROM sources),
        ratios AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM weighed),
        levels AS (
            SELECT *, (CAST(all_size AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0))
                      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS level
            FROM ratios
            WINDOW o AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        aimed AS (
            SELECT source, source_size,
                   CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE)
                        ELSE weight * max(CASE WHEN ratio > level THEN level END) OVER () END AS target
            FROM levels),
        placed AS (
            SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
                   coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(CASE WHEN source_size = 0 THEN 0 ELSE
                    budget // source_size * size
                    + greatest(0, least(size, budget - budget // source_size * source_size - before)) END AS BIGINT) AS taken
        FROM placed""",
    "op8_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept,
               sha256(norm) AS text_sha256
        FROM n""",
    "op10_line_dedup": r"""
        WITH split_up AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
        lined AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM split_up),
        windows AS (
            SELECT doc_id, pos, line, lead(line, 1) OVER o AS line2, lead(line, 2) OVER o AS line3,
                   lead(pos, 2) OVER o IS NOT NULL AS whole
            FROM lined WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
        marked AS (
            SELECT doc_id, pos, whole AND row_number() OVER (
                       PARTITION BY whole, line, line2, line3 ORDER BY doc_id, pos) > 1 AS repeated
            FROM windows),
        covered AS (
            SELECT doc_id, pos, bool_or(repeated) OVER (
                       PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone
            FROM marked),
        kept AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
                   string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text
            FROM lined JOIN covered USING (doc_id, pos) GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
               sha256(coalesce(kept.text, '')) AS text_sha256
        FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op12_spelling": """
        WITH RECURSIVE crc_table AS (
            SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, one: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
        runs AS (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
            GROUP BY ALL),
        checked AS (
            SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)),
                                           lambda crc, b: xor(crc >> 8, t[xor(crc & 255, b) + 1]), 4294967295), 4294967295) AS h
            FROM runs, crc_table),
        w AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n
            FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM checked)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        cuts AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
        near AS (
            SELECT c.word, w.word AS other FROM cuts c JOIN w ON w.word = c.rest UNION SELECT w.word, c.word FROM cuts c JOIN w ON w.word = c.rest
            UNION SELECT a.word, b.word FROM cuts a JOIN cuts b USING (i, rest) WHERE a.word <> b.word),
        best AS (
            SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS r
            FROM near JOIN w ON w.word = other),
        formed AS (SELECT w.word, w.n, CASE WHEN other_n >= 5 * w.n THEN other END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
                   FROM w LEFT JOIN best ON best.word = w.word AND r = 1),
        followed AS (
            SELECT word, word AS last_word FROM formed UNION ALL
            SELECT followed.word, formed.form FROM followed JOIN formed ON formed.word = followed.last_word WHERE formed.form IS NOT NULL)
        SELECT formed.word, formed.form, last_word AS root, formed.n, CAST(formed.n_near AS BIGINT) AS n_near, formed.form_n
        FROM formed JOIN followed ON followed.word = formed.word JOIN formed ends ON ends.word = last_word AND ends.form IS NULL""",
    "op13_hard_negatives": """
        WITH sound AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM sound a JOIN sound b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
        negatives AS (
            SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
            FROM positives JOIN scored USING (anchor_id)
            WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5""",
}
