"""Queries over the text, chunk, page, context, store and stream operators, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scopewise.functions import extract
from scopewise.functions import text as T
from scopewise.functions.chunker import chunked
from scopewise.functions.sections import sections
from scopewise.operators import context, pages, retrieval, store
from scopewise.plans.tables import chunks, documents, questions, spread, table
from scopewise.sources import readers, sinks
from scopewise.sources.staging import new_folder, staged
from scopewise.streaming import ingest, tokens

CHUNK, OVERLAP = 500, 100


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = chunked(documents(spark, d, "doc_id", "text"), "doc_id", "text", CHUNK, OVERLAP)
    return rows.select("doc_id", "chunk_idx", "content")


def truncate_context(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncated(F.col("text"), 400).alias("content"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"), T.one_line(F.col("text")).alias("line"))


def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", T.first_person(text).alias("first_person"), T.leaks_id(text).alias("leaks_id"), T.deidentified(text).alias("deidentified"), T.informative(text).alias("informative"),
        T.estimated_tokens(text, 2.0).alias("tokens"), T.answer_key(text).alias("answer_key"),
    )


def file_names(spark: SparkSession, d: str) -> DataFrame:
    name = T.document_name(F.col("o_custkey"), F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", name.alias("name"), T.admission_of(name).alias("admission"), T.scope_of_path(F.concat(F.lit("/a b/"), name)).alias("scope_id"))


def _noted(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Examination: "), F.col("lang"), F.lit("\nfindings : "), F.replace("text", F.lit(":"), F.lit(";")), F.lit("\nImpression:"), F.col("source"), F.lit("\nTechnique:\n"))
    return documents(spark, d, "doc_id", "lang", "source", "text").select("doc_id", F.lit("Radiology").alias("category"), F.lit(1).alias("note_pos"), text.alias("note"))


def section_split(spark: SparkSession, d: str) -> DataFrame:
    return sections(_noted(spark, d), ["doc_id"], "category", "note", ["note_pos"]).select("doc_id", "section", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def sentence_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d, "doc_id", "text").select("doc_id", extract.extracts(F.lit("Brief Hospital Course"), F.col("text")).alias("x"))
    return rows.select("doc_id", "x.*")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.bm25(questions(spark, d), chunks(spark, d), 3).join(chunks(spark, d).select("chunk_id", "content"), "chunk_id")
    return rows.select("query_id", "rank", F.round("score", 6).alias("score"), "content", F.lit("").alias("date"), F.lit("Clinical Discharge Summary").alias("kind"))


def context_header(spark: SparkSession, d: str) -> DataFrame:
    return context.header(context.bounded(_ranked(spark, d)))


def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    return context.prompts(questions(spark, d), _ranked(spark, d)).select("query_id", "prompt", "retrieved")


def chat_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", *[context.chat_prompt(F.lit("Be brief."), F.col("text"), m).alias(m.lower()) for m in context.CHAT])


def context_packing(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of questions in pairs, packed for every budget."""
    found = _ranked(spark, d).join(questions(spark, d).select("query_id", "text"), "query_id")
    block = F.concat(F.lit("[Patient "), (F.col("query_id") % 20).cast("string"), F.lit("]: "), F.col("content"))
    items = found.groupBy(F.floor(F.col("query_id") / 2).cast("bigint").alias("item")).agg(
        F.min("text").alias("question"), F.collect_list(F.struct("rank", (F.col("query_id") % 2).cast("int").alias("scope_pos"), block.alias("block"))).alias("blocks")
    )
    return context.pack(items).select("item", "budget", F.size("contexts").alias("contexts"), "dropped")


def chat_history_last4(spark: SparkSession, d: str) -> DataFrame:
    return context.recent_history(table(spark, d, "conversations").where("role <> 'system'"), "conv_id", "turn", "role", "text")


def history_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return context.without_repeats(rows, "user_id", "event_id", "event_type")


def _paged(spark: SparkSession, d: str) -> DataFrame:
    """A document's lines as its pages."""
    rows = documents(spark, d, "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return pages.paged(rows.select("doc_id", (F.col("p") + 1).alias("page"), "text"), "doc_id", "page", "text")


def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _paged(spark, d).select("doc_id", "page", "start", "end")


def page_interval_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The pages of every chunk."""
    ranges = _paged(spark, d)
    spans = chunked(pages.document_text(ranges, "doc_id"), "doc_id", "text").select("doc_id", "chunk_idx", "start", "end")
    rows = pages.span_pages(spans, ranges, "doc_id", ["chunk_idx"])
    return rows.select("doc_id", "chunk_idx", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "page")


def gold_chunk_choice(spark: SparkSession, d: str) -> DataFrame:
    """For every page, the chunk that holds its text best; pages longer than a chunk have none."""
    ranges = _paged(spark, d)
    evidence = ranges.where("trim(text) <> ''").select("doc_id", "page", F.col("text").alias("evidence"))
    rows = chunked(pages.document_text(ranges, "doc_id"), "doc_id", "text")
    return pages.gold_chunks(evidence, rows, ranges, "doc_id").select("doc_id", "page", F.length("gold").alias("gold_length"), F.md5(F.col("gold").cast("binary")).alias("gold_md5"))


def text_page_lookup(spark: SparkSession, d: str) -> DataFrame:
    ranges = _paged(spark, d)
    evidence = ranges.select("doc_id", F.col("page").alias("of"), F.replace("text", F.lit(" "), F.lit("\n ")).alias("evidence"))
    return pages.text_pages(evidence, ranges, "doc_id").select("doc_id", "of", "page")


def document_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("patient"), "lang", "doc_id", F.lit("old").alias("version"))
    new = rows.where("lang = 'fr'").withColumn("version", F.lit("new"))
    return store.upsert(rows, new, ["patient", "lang"])


def dedupe_ingest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "lang", "doc_id")
    return store.deduplicated(rows, "patient", "source", "lang", "doc_id")


def event_window_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.event_counts(table(spark, d, "events"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def _spoken_tokens() -> Column:
    """Words of a message as tokens, some in a thought."""
    words = F.split(F.col("text"), " ")
    return F.concat(F.array(F.lit("\n"), F.lit("<think>"), F.lit("\n\n")), F.slice(words, 1, 2), F.array(F.lit("</think>"), F.lit("\n")), words, F.array(F.lit("<|im_end|>"), F.lit("late")))


def token_stream(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", ingest.spoken(_spoken_tokens(), "<|im_end|>").alias("s")).select("conv_id", "turn", "s.*")


def token_stream_stateful(spark: SparkSession, d: str) -> DataFrame:
    """The same messages from a stream, whose micro-batches each bring a part of every message."""
    message = F.to_json(F.struct("conv_id", "turn")).alias("message")
    words = spread(table(spark, d, "conversations").select("conv_id", "turn", "text")).select(message, _spoken_tokens().alias("t"))
    path, out = new_folder(spark, "tokens"), new_folder(spark, "messages")
    for third in (0, 2, 1):  # each written by all tasks; the last third of a message comes before its turn
        first = F.floor(F.size("t") * third / 3).cast("int")
        part = F.slice("t", first + 1, F.floor(F.size("t") * (third + 1) / 3).cast("int") - first)
        rows = words.select("message", first.alias("_first"), F.posexplode(part).alias("_at", "token")).select("message", (F.col("_first") + F.col("_at")).alias("seq"), "token")
        rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
        rows.write.mode("append").parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(path)
    said = tokens.messages(stream, "<|im_end|>", "1 day", 86_400_000)
    said.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start().awaitTermination()
    ids = F.from_json("message", "conv_id bigint, turn bigint")
    return spark.read.schema(tokens.GIVEN).parquet(f"{out}/rows").select(ids.alias("i"), "text", "thinking").select("i.conv_id", "i.turn", "text", "thinking")


def tokens_per_second(spark: SparkSession, d: str) -> DataFrame:
    stats = F.concat(F.lit('{"generated_tokens": '), F.col("event_id").cast("string"), F.lit(', "prompt_eval_end_ms": 1000, "inference_end_ms": '), (F.col("event_id") % 5000).cast("string"), F.lit("}"))
    return table(spark, d, "events").select("event_id", F.round(ingest.tokens_per_second(stats), 6).alias("tps"), T.stat(F.col("props"), "k").alias("k"))


def preset_parse(spark: SparkSession, d: str) -> DataFrame:
    entry = F.concat(F.lit('{"models": {"m'), F.col("n_nationkey").cast("string"), F.lit('": {"displayName": "'), F.col("n_name"), F.lit('", "modelUrl": "u", '), F.when(F.col("n_nationkey") % 3 == 0, F.lit('"modelFilename": "f", ')).otherwise(""), F.lit('"modelType": "'), F.when(F.col("n_nationkey") % 2 == 0, "qwen_3").otherwise("odd"), F.lit('"}}}'))
    return readers.parse_presets(table(spark, d, "nation").select(entry.alias("c")), "c")


def note_inventory(spark: SparkSession, d: str) -> DataFrame:
    names = list(readers.NOTE_TABLES.values())
    kind = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 5 + 1).cast("int"))
    return sinks.note_inventory(table(spark, d, "documents").select("source", kind.alias("category")), ["source"], "category")


def html_headers(spark: SparkSession, d: str) -> DataFrame:
    lang = F.regexp_extract("html", r'<html lang="([a-z]+)">', 1)
    return table(spark, d, "pages").select("page_id", lang.alias("lang"), F.md5(sinks.escaped(F.col("html")).cast("binary")).alias("escaped_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_documents, truncate_context, clean_text, text_predicates, file_names, section_split, sentence_extract, context_header, prompt_assembly, chat_prompts,
        context_packing, chat_history_last4, history_dedupe, page_offsets, page_interval_lookup, gold_chunk_choice, text_page_lookup, document_upsert, dedupe_ingest, event_window_counts,
        token_stream, token_stream_stateful, tokens_per_second, preset_parse, note_inventory, html_headers,
    )
}


def _last(mark: str) -> str:
    """The 0-based start of the last occurrence of a mark that starts at or before s + 500, -1 if there is none."""
    n = len(mark)
    text = mark.replace("\n", "' || chr(10) || '")
    pre = f"substr(c, 1, s + {CHUNK + n})"
    return f"(CASE WHEN strpos(reverse({pre}), reverse('{text}')) = 0 THEN -1 ELSE length({pre}) - {n} - strpos(reverse({pre}), reverse('{text}')) + 1 END)"


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CHUNKS = rf"""RECURSIVE
    cleaned AS ({{source}}),
    w AS (
        SELECT doc_id, c, 0::BIGINT AS s, 0::BIGINT AS e, FALSE AS done FROM cleaned WHERE length(c) > 0
        UNION ALL
        SELECT doc_id, c, nxt, cut, nxt = cut AND cut >= length(c) FROM (
            SELECT doc_id, c, cut,
                   CASE WHEN cut >= length(c) AND last THEN cut
                        WHEN cut - {OVERLAP} > s THEN CASE WHEN strpos(substr(c, cut - {OVERLAP} + 1, {OVERLAP}), ' ') > 0
                             THEN cut - {OVERLAP} + strpos(substr(c, cut - {OVERLAP} + 1, {OVERLAP}), ' ') ELSE cut - {OVERLAP} END
                        ELSE cut END AS nxt
            FROM (SELECT doc_id, c, s, s + {CHUNK} >= length(c) AS last,
                         CASE WHEN s + {CHUNK} >= length(c) THEN length(c)
                              WHEN {_last(chr(10) * 2)} > s + {CHUNK // 2} THEN {_last(chr(10) * 2)} + 2
                              WHEN {_last(chr(10))} > s + {CHUNK // 2} THEN {_last(chr(10))} + 1
                              WHEN {_last('. ')} > s + {CHUNK // 2} THEN {_last('. ')} + 2
                              WHEN {_last(' ')} > s THEN {_last(' ')} + 1 ELSE s + {CHUNK} END AS cut
                  FROM w WHERE NOT done))),
    steps AS (SELECT doc_id, c, s, lead(e) OVER (PARTITION BY doc_id ORDER BY e, s) AS cut FROM w),
    cut AS (SELECT doc_id, s, {_STRIP.format('substr(c, s + 1, cut - s)')} AS content, substr(c, s + 1, cut - s) AS piece FROM steps WHERE cut > s)"""
_BLANKS = r"regexp_replace({0}, '[ \t]+', ' ', 'g')"
_CLEAN = f"SELECT doc_id, {_STRIP.format(_BLANKS.format('text'))} AS c FROM documents WHERE text IS NOT NULL"
_LINES = rf"""
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents),
    p AS (SELECT doc_id, CAST(page AS INTEGER) AS page, {_STRIP.format(_BLANKS.format('raw'))} AS text FROM l),
    r AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM p),
    ranges AS (SELECT *, CAST(start + length(text) AS INTEGER) AS "end" FROM r)"""
_PAGE_TEXT = "SELECT doc_id, " + _STRIP.format(_BLANKS.format("string_agg(text, chr(10) ORDER BY page)")) + " AS c FROM ranges GROUP BY doc_id"
_PAGE_CHUNKS = _CHUNKS.format(source=_PAGE_TEXT).replace("RECURSIVE", f"RECURSIVE {_LINES},", 1)
_LOOKED_UP = r"substr(regexp_replace(replace(text, ' ', chr(10) || ' '), '(\.\.\.)+$', ''), 1, 300)"
_ONE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _ranked_sql() -> str:
    from scopewise.plans.retrieval import _BM25

    return f"""{_BM25},
    ranked AS (SELECT query_id, rank, round(score, 6) AS score, CASE WHEN length(d.text) <= 400 THEN d.text ELSE substr(d.text, 1, 400) || '...' END AS content
               FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(round(score, 9) AS FLOAT) DESC, chunk_id) AS rank FROM bm25) b
               JOIN documents d ON d.doc_id = b.chunk_id WHERE rank <= 3)"""


_RANKED = _ranked_sql()
_FACTUAL_HEAD, _FACTUAL_REST = context.FACTUAL["chatml"].split("{notes}")
_FACTUAL_HEAD = _FACTUAL_HEAD.replace("{system}", context.SYSTEM)
_FACTUAL_MID, _FACTUAL_TAIL = _FACTUAL_REST.split("{question}")


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _chat(model: str) -> str:
    head, tail = (context.CHAT[model][0] + context.CHAT[model][1]).replace("{system}", "Be brief.").split("{user}")
    return f"{_lit(head)} || text || {_lit(tail)} AS {model.lower()}"


ORACLE_SQL = {
    "chunk_documents": f"WITH {_CHUNKS.format(source=_CLEAN)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_idx, content FROM cut WHERE content <> ''",
    "truncate_context": "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 400) || '...' END AS content FROM documents",
    "clean_text": f"SELECT doc_id, {_STRIP.format(_BLANKS.format('text'))} AS clean, {_ONE.format('text')} AS line FROM documents",
    "text_predicates": r"""
        SELECT doc_id, regexp_matches(text, '\b(?:I|me|my|mine|myself)\b') AS first_person, regexp_matches(text, '[0-9]{5,}') AS leaks_id, regexp_matches(text, '\[\*\*|_{3,}') AS deidentified,
               length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 25 AND len(regexp_extract_all(text, '\S+')) >= 5 AS informative,
               CAST(ceil(length(text) / 2.0::DOUBLE) AS INTEGER) AS tokens, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS answer_key
        FROM documents""",
    "file_names": """
        SELECT o_orderkey, 'Patient_' || CAST(o_custkey AS VARCHAR) || '_Admission_' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS name, CAST(o_orderkey AS VARCHAR) AS admission,
               'Patient_' || CAST(o_custkey AS VARCHAR) || '_Admission_' || CAST(o_orderkey AS VARCHAR) || '_pdf' AS scope_id FROM orders""",
    "section_split": rf"""
        WITH s AS (SELECT doc_id, unnest(['Examination', 'Findings', 'Impression']) AS section,
                          unnest([lang, {_STRIP.format("replace(text, ':', ';')")}, source]) AS content FROM documents)
        SELECT doc_id, section, md5(content) AS content_md5 FROM s WHERE content <> ''""",
    "context_header": f"""WITH {_RANKED}
        SELECT query_id, '**Top ' || CAST(count(*) AS VARCHAR) || ' Relevant Chunks Extracted:**' || chr(10)
               || string_agg('> **[Chunk #' || CAST(rank AS VARCHAR) || ']** Coherence: **' || format('{{:.2f}}', score) || '** | *Clinical Discharge Summary*' || chr(10)
                             || '> "' || replace(substr(content, 1, 180), chr(10), ' ') || '..."' || chr(10) || chr(10), '' ORDER BY rank)
               || '---' || chr(10) || chr(10) AS header
        FROM ranked GROUP BY query_id""",
    "prompt_assembly": f"""WITH {_RANKED},
        notes AS (SELECT query_id, string_agg('- [Notes from  - Clinical Discharge Summary]: ' || content, chr(10) || chr(10) ORDER BY rank) AS notes, count(*) AS n FROM ranked GROUP BY query_id)
        SELECT item_id AS query_id, {_lit(_FACTUAL_HEAD)} || coalesce(notes, {_lit(context.NO_NOTES)}) || {_lit(_FACTUAL_MID)} || text || {_lit(_FACTUAL_TAIL)} AS prompt, coalesce(n, 0) AS retrieved
        FROM benchmark LEFT JOIN notes ON query_id = item_id""",
    "chat_prompts": f"SELECT conv_id, turn, {', '.join(map(_chat, context.CHAT))} FROM conversations WHERE role = 'user'",
    "chat_history_last4": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role <> 'system' AND trim(text) <> '')
        SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS history FROM r WHERE n <= 4 GROUP BY conv_id""",
    "history_dedupe": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type",
    "page_offsets": f'WITH {_LINES} SELECT doc_id, page, start, "end" FROM ranges',
    "page_interval_lookup": rf"""WITH {_PAGE_CHUNKS},
        ch AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_idx, s + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS cs, length(content) AS n
               FROM cut WHERE content <> ''),
        h AS (SELECT doc_id, chunk_idx, list(page ORDER BY page) FILTER (start < cs + n AND "end" > cs) AS hit, max(page) AS last FROM ch JOIN ranges USING (doc_id) GROUP BY ALL)
        SELECT doc_id, chunk_idx, array_to_string(coalesce(hit, [last]), ',') AS pages, coalesce(hit, [last])[1] AS page FROM h""",
    "gold_chunk_choice": rf"""WITH {_PAGE_CHUNKS},
        ch AS (SELECT doc_id, content, s + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS cs FROM cut WHERE content <> ''),
        ev AS (SELECT doc_id, page, text AS evidence, start, "end" AS stop FROM ranges WHERE trim(text) <> ''),
        fit AS (SELECT ev.doc_id, ev.page, content, least(cs + length(content), stop) - greatest(cs, start) AS shared, cs
                FROM ev JOIN ch USING (doc_id) WHERE least(cs + length(content), stop) - greatest(cs, start) > 0
                AND contains(lower({_ONE.format('content')}), lower({_ONE.format('evidence')})) AND {_ONE.format('evidence')} <> ''),
        best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY shared DESC, length(content), cs) AS n FROM fit)
        SELECT doc_id, page, CAST(length(content) AS INTEGER) AS gold_length, md5(content) AS gold_md5 FROM best WHERE n = 1""",
    "text_page_lookup": f"""WITH {_LINES},
        ev AS (SELECT doc_id, page AS of, lower({_ONE.format(_LOOKED_UP)}) AS wanted FROM ranges),
        held AS (SELECT doc_id, page, lower({_ONE.format('text')}) AS text FROM ranges)
        SELECT ev.doc_id, of, min(page) FILTER (wanted <> '' AND contains(text, wanted)) AS page FROM ev JOIN held USING (doc_id) GROUP BY ev.doc_id, of""",
    "document_upsert": """
        WITH new AS (SELECT source, lang, doc_id FROM documents WHERE lang = 'fr')
        SELECT source AS patient, lang, doc_id, 'old' AS version FROM documents d WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.source = d.source AND new.lang = d.lang)
        UNION ALL SELECT source, lang, doc_id, 'new' FROM new""",
    "dedupe_ingest": "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang",
    "event_window_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "token_stream": """
        SELECT conv_id, turn, array_to_string(string_split(text, ' '), '') AS text, array_to_string(string_split(text, ' ')[1:2], '') AS thinking FROM conversations""",
    "token_stream_stateful": """
        SELECT conv_id, turn, array_to_string(string_split(text, ' '), '') AS text, array_to_string(string_split(text, ' ')[1:2], '') AS thinking FROM conversations""",
    "tokens_per_second": """
        SELECT event_id, CASE WHEN event_id % 5000 - 1000 > 0 THEN round(event_id / CAST(event_id % 5000 - 1000 AS DOUBLE) * 1000, 6) END AS tps,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "preset_parse": """
        SELECT 'm' || CAST(n_nationkey AS VARCHAR) AS key, n_name AS display_name, 'u' AS model_url, 'f' AS model_file, '' AS tokenizer_url, '' AS tokenizer_file,
               CASE WHEN n_nationkey % 2 = 0 THEN 'QWEN_3' ELSE 'LLAMA_3' END AS model_type FROM nation WHERE n_nationkey % 3 = 0""",
    "note_inventory": """
        WITH c AS (SELECT source, doc_id % 5 AS o, count(*) AS n FROM documents GROUP BY ALL)
        SELECT source, string_agg(['Discharge summary', 'Radiology', 'Nursing', 'Physician', 'Consult'][CAST(o + 1 AS BIGINT)] || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY o) AS inventory FROM c GROUP BY source""",
    "html_headers": r"""
        SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)">', 1) AS lang,
               md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM pages""",
}
