"""Driver queries: the library's operators over the given tables, each over whole tables, with its SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import budget, chunk, context, decide, evaluate, filters, fuse, govern, index, ivf, metadata, risk, search, segments, trainsets, understand
from lodestack.sources import files, shared
from lodestack.streaming import audit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Counts and ranks that SQL engines return as 64-bit integers.
WIDE = ("rank", "n_keywords", "n_tokens", "n_chars", "matched_route_count", "age")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("long") for c, kind in out.dtypes if c in WIDE and kind == "int"})

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares."""
    return f"{shared.shared_folder(spark)}/lodestack-{uuid.uuid4()}"


# Derived inputs: documents as chunks, benchmark items as questions.

TOKENS = "list_transform(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x))"
FOLD = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
VERSION = "((doc_id % 7)::varchar || '.' || (doc_id % 3)::varchar)"
DAY = "('2024-0' || (doc_id % 9 + 1)::varchar || '-1' || (doc_id % 8)::varchar)"
LEVEL = "CASE doc_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'sensitive' ELSE 'restricted' END"
AUTHORITY = "CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END"


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks with governance columns derived from their ids."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (i % n + 1).cast("int"))
    return d.select(
        i.alias("chunk_id"), i, F.col("text").alias("content"), "source", "lang", F.concat(F.lit("topic "), (i % 5).cast("string")).alias("title"), F.lit("child").alias("chunk_level"),
        F.concat_ws(".", (i % 7).cast("string"), (i % 3).cast("string")).alias("version"),
        F.concat(F.lit("2024-0"), (i % 9 + 1).cast("string"), F.lit("-1"), (i % 8).cast("string")).alias("effective_date"),
        pick(3, "low", "medium", "high").alias("authority_level"), pick(4, "public", "internal", "sensitive", "restricted").alias("data_classification"),
        F.when(i % 5 == 0, F.array("source")).alias("allowed_departments"), F.when(i % 11 == 0, F.array(F.lit("admin"))).alias("allowed_roles"), F.lit(None).cast("array<string>").alias("allowed_users"), F.lit(None).cast("array<string>").alias("project_ids"),
        F.concat(F.lit("part "), (i % 2).cast("string")).alias("section"), F.lit("").alias("section_path"), F.lit(None).cast("int").alias("page"),
    )


def bench_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's first twelve words as a question."""
    b = table(spark, sf_dir, "benchmark")
    words = F.slice(F.split(T.fold_ws(F.col("text")), " "), 1, 12)
    i = F.col("item_id")
    return b.select(
        i.alias("query_id"), F.array_join(words, " ").alias("question"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("department"), F.lit("user").alias("role"), F.lit("u1").alias("user_id"),
        F.lit(None).cast("array<string>").alias("project_ids"), F.element_at(F.array(F.lit("public"), F.lit("internal"), F.lit("sensitive"), F.lit("restricted")), (i % 4 + 1).cast("int")).alias("clearance_level"), (i % 2 == 0).alias("allow_external_llm"),
    )


#: Folders of the indexes that a session has stored, by application, tables and kind.
_STORED: dict[tuple[str, str, str], str] = {}


def stored_index(spark: SparkSession, sf_dir: str, kind: str, chunks: Callable[[], DataFrame]) -> search.Bm25Index:
    """The lexical index of ``chunks``, built once a session and kept in the shared folder for all its queries."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _STORED:
        folder = shared_folder(spark)
        search.bm25_index(chunks()).stored(folder)
        _STORED[key] = folder
    return search.Bm25Index.load(spark, _STORED[key])


def doc_index(spark: SparkSession, sf_dir: str) -> search.Bm25Index:
    return stored_index(spark, sf_dir, "documents", lambda: doc_chunks(spark, sf_dir))


def bm25_hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return search.bm25_search(bench_questions(spark, sf_dir), doc_index(spark, sf_dir), k)


def rich_hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Hits with their chunks. They are counted first: while they are few, they go to the chunks, so no text is shuffled but theirs."""
    return search.with_chunks(bm25_hits(spark, sf_dir, k), doc_chunks(spark, sf_dir))


BM25 = f"""
tok AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents),
doc AS (SELECT doc_id, t, len(t) AS dl FROM tok),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM doc),
post AS (SELECT token, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, dl, unnest(t) AS token FROM doc) GROUP BY token, doc_id),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, tot),
term AS (SELECT token, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT item_id AS query_id, array_to_string(list_slice(string_split({FOLD.format('text')}, ' '), 1, 12), ' ') AS question FROM benchmark),
qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format('question')}) AS token FROM q) GROUP BY query_id, token),
scored AS (SELECT query_id, doc_id AS chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN term USING (token) JOIN post USING (token), tot GROUP BY query_id, doc_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 10)
"""


@query("bm25_topk", f"WITH {BM25} SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM hits")
def bm25_topk(spark, sf_dir):
    return bm25_hits(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


KEPT_BM25 = BM25.replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 9)", 1)


@query("segmented_topk", f"WITH {KEPT_BM25} SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM hits")
def segmented_topk(spark, sf_dir):
    """An index of older texts, in which a third of the documents is replaced and a tenth removed, in two changes."""
    key = (spark.sparkContext.applicationId, sf_dir, "segments")
    if key not in _STORED:
        d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
        older = F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit("former words "), F.reverse("content"))).otherwise(F.col("content"))
        folder = shared_folder(spark)
        made = segments.SegmentedIndex.create(spark, folder, d.filter("chunk_id % 20 <> 0").withColumn("content", older))
        made.merge(d.filter("chunk_id % 3 = 0 and chunk_id % 2 = 0"), d.filter("chunk_id % 10 = 9"))
        made.merge(d.filter("(chunk_id % 3 = 0 and chunk_id % 2 = 1 and chunk_id % 10 <> 9) or chunk_id % 20 = 0"))
        _STORED[key] = folder
    view = segments.SegmentedIndex(spark, _STORED[key]).view()
    return search.bm25_search(bench_questions(spark, sf_dir), view, 10).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@query("clean_text", r"""
SELECT doc_id, trim(array_to_string(list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
  lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'))), lambda l: l <> ''), chr(10))) AS content FROM documents""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("content"))


def _redacted(text: str) -> str:
    """SQL without look-around: neighbours are captured, and patterns that may share one run twice."""
    runs = [
        (r"[\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+", "[REDACTED_EMAIL]"),
        *[(r"(^|\D)1[3-9]\d{9}(\D|$)", r"\1[REDACTED_PHONE]\2")] * 2,
        *[(r"(^|\D)(?:\d{17}[\dXx]|\d{15})(\D|$)", r"\1[REDACTED_ID]\2")] * 2,
        *[(r"(^|\D)\d{16,19}(\D|$)", r"\1[REDACTED_ACCOUNT]\2")] * 2,
        (r"\b(\d{1,3}\.){3}\d{1,3}\b", "[REDACTED_IP]"),
    ]
    for pattern, mark in runs:
        text = f"regexp_replace({text}, '{pattern}', '{mark}', 'g')"
    return text


@query("redact", f"SELECT doc_id, {_redacted('text')} AS content FROM documents")
def redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("content"))


@query("text_measures", rf"""
WITH k AS (SELECT doc_id, text, {FOLD.format('text')} AS f FROM documents),
w AS (SELECT doc_id, text, f, regexp_extract_all(f, '[A-Za-z0-9_./:-]+') AS b FROM k)
SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, (len(regexp_extract_all(text, '[A-Za-z0-9_./:-]+')) + greatest(1, length(text) // 80))::INTEGER AS budget_tokens,
  len(list_distinct(b)) AS n_keywords, CASE WHEN length(f) > 96 THEN rtrim(f[1:95]) || '…' ELSE f END AS summary, lower(f) AS question_key
FROM w""")
def text_measures(spark, sf_dir):
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", F.size(T.tokenize(t)).alias("n_tokens"), T.estimate_tokens(t).alias("budget_tokens"), F.size(T.keyword_set(t)).alias("n_keywords"), T.chunk_summary(t).alias("summary"), T.normalize_question(t).alias("question_key"))


@query("first_sentences", rf"""
WITH k AS (SELECT doc_id, text, {FOLD.format("coalesce(text, '')")} AS f FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(f, '[。！？.!?]\s') THEN regexp_extract(f, '^(.*?[。！？.!?])\s', 1) ELSE f END AS first,
  len(list_filter(regexp_extract_all(f, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$'), lambda s: trim(s) <> ''))::INTEGER AS n_sentences,
  trim(f, ' ?？!！。.,，;；:：') AS query, CASE WHEN length(text) > 50 THEN rtrim(text[1:49]) || '…' ELSE text END AS short FROM k""")
def first_sentences(spark, sf_dir):
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", T.first_sentence(t).alias("first"), F.size(T.split_sentences(t)).alias("n_sentences"), T.normalize_query(t).alias("query"), T.truncate_text(t, 50).alias("short"))


@query("window_chunks", """
WITH p AS (SELECT doc_id, text, length(text) AS n FROM documents),
k AS (SELECT *, CASE WHEN n <= 1000 THEN 1 ELSE greatest(1, ceil((n - 100) / 900.0)) END AS c FROM p),
w AS (SELECT doc_id, unnest(range(c::BIGINT)) AS idx, text, n FROM k),
x AS (SELECT doc_id, idx, CASE WHEN n <= 1000 THEN text ELSE text[idx * 900 + 1 : idx * 900 + 1000] END AS piece FROM w)
SELECT doc_id, idx::INTEGER AS idx, length(piece) AS n_chars,
  'c-' || left(doc_id::varchar, 8) || '-' || idx || '-' || left(sha256('c:' || doc_id || ':' || idx || ':' || left(piece, 200)), 16) AS chunk_id FROM x""")
def window_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pieces = d.select("doc_id", F.posexplode(chunk.window_pieces(F.col("text"), F.lit(1000), F.lit(100))).alias("idx", "piece"))
    return pieces.select("doc_id", "idx", F.length("piece").alias("n_chars"), chunk.chunk_id("c", F.col("doc_id").cast("string"), F.col("idx"), F.col("piece")).alias("chunk_id"))


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def _windows(x: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"CASE WHEN length({x}) <= {size} THEN [{x}] ELSE list_transform(range(greatest(1, ceil((length({x}) - {overlap}) / {step}.0))::BIGINT), lambda i: ({x})[i * {step} + 1 : i * {step} + {size}]) END"


def _packed(columns: str, source: str, size: int, overlap: int) -> str:
    """SQL: ``columns`` and ``pieces`` of the rows of ``source``, whose ``body`` is packed paragraph by paragraph."""
    two = "chr(10) || chr(10)"
    fits = f"length(a.open) + length(x.open) + 2 <= {size}"
    small = f"length(x.open) <= {size}"
    closed = f"CASE WHEN a.open = '' THEN a.done ELSE list_concat(a.done, {_windows('a.open', size, overlap)}) END"
    step = f"""{{'done': CASE WHEN {fits} THEN a.done WHEN {small} THEN {closed} ELSE list_concat({closed}, {_windows('x.open', size, overlap)}) END,
      'open': CASE WHEN {fits} THEN CASE WHEN a.open = '' THEN x.open ELSE a.open || {two} || x.open END WHEN {small} THEN x.open ELSE '' END}}"""
    return f"""SELECT {columns}, CASE WHEN body = '' THEN [] WHEN length(body) <= {size} THEN [body] WHEN r.open = '' THEN r.done ELSE list_concat(r.done, {_windows('r.open', size, overlap)}) END AS pieces FROM (
    SELECT *, list_reduce(list_concat([{{'done': []::VARCHAR[], 'open': ''}}], list_transform(list_filter(list_transform(regexp_split_to_array(body, '\\n\\n+'), lambda p: {_strip('p')}), lambda p: p <> ''), lambda p: {{'done': []::VARCHAR[], 'open': p}})),
      lambda a, x: {step}) AS r FROM {source})"""


#: Chunks of documents whose sections are known: an intro, Part A, Part B below it, a short Part C. Each line is a paragraph.
CHUNKS = f"""
src AS (SELECT doc_id::VARCHAR AS d, source, lang, replace(text, chr(10), chr(10) || chr(10)) AS p FROM documents),
sec AS (SELECT d, source, lang, unnest([{{'no': 0, 'title': '', 'path': '', 'level': 1, 'body': 'intro of ' || d}}, {{'no': 1, 'title': 'Part A', 'path': 'Part A', 'level': 1, 'body': p}},
  {{'no': 2, 'title': 'Part B', 'path': 'Part A / Part B', 'level': 2, 'body': '操作 steps' || chr(10) || '1. 联系人 ' || d || chr(10) || chr(10) || p || '|'}}, {{'no': 3, 'title': 'Part C', 'path': 'Part C', 'level': 1, 'body': 'short'}}], recursive := true) FROM src),
body AS (SELECT d, source, lang, no, title, path, level, {_strip('body')} AS body FROM sec),
par AS (SELECT d, source, lang, no, title, path, level, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pno FROM ({_packed('d, source, lang, no, title, path, level', 'body', 1800, 160)})),
par2 AS (SELECT d, source, lang, title, path, level, {_strip('piece')} AS body, row_number() OVER (PARTITION BY d ORDER BY no, pno) - 1 AS idx FROM (SELECT * FROM par WHERE {_strip('piece')} <> '' AND NOT (length({_strip('piece')}) < 80 AND title <> ''))),
par3 AS (SELECT *, 'p-' || left(d, 8) || '-' || idx || '-' || left(sha256('p:' || d || ':' || idx || ':' || left(body, 200)), 16) AS pid FROM par2),
kid AS (SELECT d, source, lang, title, path, level, body AS whole, idx, pid, list_filter(list_transform(pieces, lambda c: {_strip('c')}), lambda c: c <> '' AND NOT (length(c) < 80 AND length(body) > 80)) AS ks FROM ({_packed('d, source, lang, title, path, level, body, idx, pid', 'par3', 1000, 100)})),
kid2 AS (SELECT d, source, lang, title, path, level, idx, pid, unnest(CASE WHEN len(ks) > 0 THEN ks ELSE [whole] END) AS body, generate_subscripts(CASE WHEN len(ks) > 0 THEN ks ELSE [whole] END, 1) AS kno FROM kid),
kid3 AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY idx, kno) - 1 AS k FROM kid2),
chunks AS (SELECT d AS doc_id, pid AS chunk_id, pid AS parent_chunk_id, 'parent' AS chunk_level, idx AS chunk_idx, title, path, level, body, source, lang FROM par3 UNION ALL
  SELECT d, 'c-' || left(d, 8) || '-' || k || '-' || left(sha256('c:' || d || ':' || k || ':' || left(pid || ':' || body, 200)), 16), pid, 'child', k, title, path, level, body, source, lang FROM kid3),
words AS (SELECT chunk_id, w, n FROM (SELECT chunk_id, w, n, row_number() OVER (PARTITION BY chunk_id, lower(w) ORDER BY n) AS k FROM (SELECT chunk_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM (
  SELECT chunk_id, list_concat(['text'], regexp_extract_all(path, '[一-鿿A-Za-z0-9_/-]{{2,30}}'), regexp_extract_all(left(body, 160), '[一-鿿A-Za-z0-9_/-]{{2,30}}')) AS ws FROM chunks))) WHERE k = 1),
topics AS (SELECT chunk_id, string_agg(w, ' ' ORDER BY n) AS topic_keywords FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n) AS m FROM words) WHERE m <= 8 GROUP BY chunk_id)
"""


def sectioned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an intro, Part A, Part B below it and a short Part C; each line of the text is a paragraph."""
    d = table(spark, sf_dir, "documents")
    p, i = F.regexp_replace("text", "\n", "\n\n"), F.col("doc_id").cast("string")
    content = F.concat(F.lit("intro of "), i, F.lit("\n# Part A\n"), p, F.lit("\n## Part B\n操作 steps\n1. 联系人 "), i, F.lit("\n\n"), p, F.lit("|\n# Part C\nshort"))
    return d.select(i.alias("doc_id"), "source", F.lit("t").alias("title"), content.alias("content"), F.lit("text").alias("doc_type"), F.lit("text/plain").alias("mime_type"), "lang")


@query("build_chunks", rf"""
WITH {CHUNKS} SELECT doc_id, chunk_id, parent_chunk_id, chunk_level, chunk_idx::INTEGER AS chunk_idx, nullif(title, '') AS section, path AS section_path, level AS section_level, body AS content, NULL::INTEGER AS page, source, lang, topic_keywords,
  CASE WHEN regexp_matches(left(title || chr(10) || left(body, 200), 300), '操作') THEN 'procedure' ELSE 'general' END AS section_type, CASE WHEN length({FOLD.format('body')}) > 96 THEN rtrim(({FOLD.format('body')})[1:95]) || '…' ELSE {FOLD.format('body')} END AS chunk_summary,
  contains(body, '|') OR contains(body, chr(9)) AS contains_table, regexp_matches(body, '(^|\n)\s*(\d+\.|[-*])\s+') AS contains_steps, regexp_matches(left(body, 500), '联系人') AS contains_contact, true AS contains_version_signal, false AS contains_risk_signal
FROM chunks JOIN topics USING (chunk_id)""")
def build_chunks(spark, sf_dir):
    made = chunk.build_chunks(sectioned_documents(spark, sf_dir))
    return made.select(
        "doc_id", "chunk_id", "parent_chunk_id", "chunk_level", "chunk_idx", "section", "section_path", "section_level", "content", "page", "source", "lang", F.array_join("topic_keywords", " ").alias("topic_keywords"),
        "section_type", "chunk_summary", "contains_table", "contains_steps", "contains_contact", "contains_version_signal", "contains_risk_signal",
    )


@query("html_text")
def html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return files.read_pages(pages).select("page_id", "source", "title", "content", "mime_type")


@query("page_chunks")
def page_chunks(spark, sf_dir):
    """Pages to headed text, to metadata, to parent and child chunks."""
    docs = files.read_pages(table(spark, sf_dir, "pages")).withColumn("doc_id", F.col("page_id").cast("string"))
    made = chunk.build_chunks(metadata.enrich(docs.select("doc_id", "source", "title", "content", "mime_type")))
    return made.select("doc_id", "chunk_id", "parent_chunk_id", "chunk_level", "chunk_idx", "section", "section_path", "section_type", "contains_table", "contains_steps", "topic_keywords", F.length("content").alias("n_chars"))


#: What stands in the documents' heads, by doc_id % 8, so that every field and class is met.
HEADS = (
    "文号：AB-2024-7 北方煤矿 检修车间 夜班 3号线 生产 v2.3 2024-05-06 负责人：李四 值班人：王五 制度", "失效日期：2025-01-02 发布部门：安全部 批准人：张三 责任岗位：巡检员 公开 会议纪要",
    "设备编号：X-19 2号锅炉 系统名称：调度平台 机密 已废止", "项目名称：灯塔工程 适用区域：东区 适用场站：一站 试行 草稿", "联系人 赵六 经理：钱七 linux 1.4.2 敏感 报销 付款", "今天检修部门 采购 招标 立项", "现行 隐患排查 应急预案 验收", "",
)


def _field(pattern: str, text: str = "t") -> str:
    return f"nullif(trim(regexp_replace(regexp_extract({text}, '{pattern.replace('(?iU)', '(?i)').replace('(?U)', '')}', 1), '{metadata.LEADING_TIME}', '')), '')"


def _rule(rules: list[tuple[str, str]], default: str | None) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{v}'" for p, v in rules) + f" ELSE {'NULL' if default is None else repr(default)} END"


_META = {name: _field(p) for name, p in metadata.FIELD_PATTERNS.items()}
_META["version"] = f"nullif(regexp_replace(regexp_replace(coalesce({_META['version']}, ''), '^(version|VERSION)\\s*', ''), '^[vV]\\s*', ''), '')"
_META["group_company"] = _field("(北方[一-鿿]{1,4})")
_META["owner_department"] = _META["department"]
_META["department"] = f"CASE WHEN doc_id % 16 = 5 THEN 'given' ELSE {_META['department']} END"
_META["person"] = f"list_min(list_transform(regexp_extract_all(t, '{metadata.PERSON}', 1), lambda x, i: {{'p': -(MAP {{{', '.join(f'{k!r}: {v}' for k, v in metadata.PERSON_PRIORITY.items())}}})[x], 'i': i, 'name': regexp_extract_all(t, '{metadata.PERSON}', 2)[i]}})).name"
_META |= {name: _rule(rules, default) for name, (default, rules) in metadata.CLASS_RULES.items()}
_META["status"] = f"CASE WHEN doc_id % 16 = 9 THEN 'draft' ELSE {_META['status']} END"
_META["doc_category"] = _rule(metadata.CATEGORY_RULES, None)
_META["doc_type"] = "['pdf', 'markdown', 'unknown', 'csv', 'unknown'][doc_id % 5 + 1]"


@query("metadata_fields", f"""
WITH h AS (SELECT doc_id, 'T ' || doc_id || chr(10) || 'f' || doc_id || chr(10) || left((['{"', '".join(HEADS)}'])[doc_id % 8 + 1] || chr(10) || coalesce(text, ''), 4000) AS t FROM documents) SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _META.items())} FROM h""")
def metadata_fields(spark, sf_dir):
    """All fields of documents with labelled heads; some come with a department or a status of their own."""
    i = F.col("doc_id")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("dir/f"), i.cast("string"), pick((".PDF", ".md", "", ".csv", ".xyz"))).alias("source"), F.concat(F.lit("T "), i.cast("string")).alias("title"), F.concat(pick(HEADS), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("content"),
        F.when(i % 16 == 5, " given ").alias("department"), F.when(i % 16 == 9, " Draft ").otherwise(" ").alias("status"),
    )
    return metadata.enrich(d, group_company="北方[一-鿿]{1,4}").select("doc_id", *_META)


@query("filter_chunks", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND lower(source) IN ('src1', 'src2', 'src3')")
def filter_chunks(spark, sf_dir):
    return filters.filter_chunks(doc_chunks(spark, sf_dir), {"lang": ["EN", "fr"], "source": ["src1", "SRC2", "src3"]}).select("doc_id")


@query("match_filters", f"""
WITH {BM25}, f AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END AS v FROM benchmark)
SELECT query_id, chunk_id FROM hits JOIN documents ON doc_id = chunk_id JOIN f USING (query_id) WHERE v IS NULL OR lang = v""")
def match_filters(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    wanted = b.select(F.col("item_id").alias("query_id"), F.lit("lang").alias("field"), F.when(F.col("item_id") % 3 == 0, "en").when(F.col("item_id") % 3 == 1, "fr").alias("value"))
    return filters.match_filters(rich_hits(spark, sf_dir), wanted, ["lang", "source"]).select("query_id", "chunk_id")


ACL = f"""
rich AS (SELECT h.*, d.source, {LEVEL} AS cls, doc_id % 4 AS o, doc_id FROM hits h JOIN documents d ON d.doc_id = h.chunk_id),
acl AS (SELECT * FROM rich WHERE query_id % 4 >= o AND NOT (o >= 2 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0)
  AND (doc_id % 5 <> 0 OR source = 'src' || (query_id % 20)) AND doc_id % 11 <> 0)
"""


@query("acl_hits", f"WITH {BM25}, {ACL} SELECT query_id, chunk_id, rank, cls AS acl_classification FROM acl")
def acl_hits(spark, sf_dir):
    kept = filters.apply_acl(rich_hits(spark, sf_dir), bench_questions(spark, sf_dir))
    return kept.select("query_id", "chunk_id", "rank", "acl_classification")


@query("access_denied", f"""
WITH {BM25}, {ACL}, a AS (SELECT query_id, count(*) AS raw_hits FROM rich GROUP BY query_id), b AS (SELECT query_id, count(*) AS kept_hits FROM acl GROUP BY query_id)
SELECT query_id, raw_hits, coalesce(kept_hits, 0) AS kept_hits, coalesce(kept_hits, 0) = 0 AS access_denied FROM a LEFT JOIN b USING (query_id)""")
def access_denied(spark, sf_dir):
    raw = rich_hits(spark, sf_dir)
    return filters.access_denied(raw, filters.apply_acl(raw, bench_questions(spark, sf_dir)))


@query("max_class", f"""
WITH {BM25}, {ACL}, m AS (SELECT query_id, greatest(max(o), 1) AS o FROM rich GROUP BY query_id),
c AS (SELECT query_id, CASE o WHEN 1 THEN 'internal' WHEN 2 THEN 'sensitive' ELSE 'restricted' END AS data_classification FROM m)
SELECT query_id, data_classification, CASE WHEN query_id % 2 <> 0 OR data_classification = 'restricted' THEN 'local_only' ELSE 'external_allowed' END AS model_route FROM c""")
def max_class(spark, sf_dir):
    top = filters.max_classification(rich_hits(spark, sf_dir)).join(bench_questions(spark, sf_dir).select("query_id", "allow_external_llm"), "query_id")
    return top.select("query_id", "data_classification", filters.model_route(F.col("data_classification"), F.col("allow_external_llm")).alias("model_route"))


@query("dense_topk", """
WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 6) AS s
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM p QUALIFY rank <= 10)
SELECT query_id, chunk_id, rank, round(s, 4) AS score FROM r""")
def dense_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = e.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    return search.dense_search(q, e, 10).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query("dense_l2_topk", """
WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(-list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS s FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM p QUALIFY rank <= 10)
SELECT query_id, chunk_id, rank, round(s, 4) AS score FROM r""")
def dense_l2_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = e.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    hits = search.dense_search(q, e, 11, metric="l2").filter("query_id <> chunk_id")
    return search.top_k(hits.drop("rank"), 10).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


def stored_vectors(spark: SparkSession, sf_dir: str) -> ivf.Ivf:
    """The inverted file of ``embeddings``, built once a session."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    key = (spark.sparkContext.applicationId, sf_dir, "vectors")
    if key not in _STORED:
        folder = shared_folder(spark)
        ivf.Ivf.build(rows, folder)
        _STORED[key] = folder
    return ivf.Ivf.load(spark, _STORED[key], rows.schema)


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("dense_lsh")
def dense_lsh(spark, sf_dir):
    return ivf.ivf_search(vector_questions(spark, sf_dir), stored_vectors(spark, sf_dir), 10).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query("ivf_all_lists", ORACLES["dense_topk"])
def ivf_all_lists(spark, sf_dir):
    """The stored index asked of all lists with every candidate scored: the exact ranks."""
    index = stored_vectors(spark, sf_dir)
    return ivf.ivf_search(vector_questions(spark, sf_dir), index, 10, share=1.0, rescored=index.codes.count()).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query("sparse_vector_topk", """
WITH x AS (SELECT vec_id, unnest(range(64)) + 1 AS dim, unnest(embedding) AS w FROM embeddings), s AS (SELECT * FROM x WHERE w > 0.1),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(sum(q.w::DOUBLE * c.w::DOUBLE), 6) AS score FROM s q JOIN s c USING (dim) WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM p QUALIFY rank <= 10)
SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM r""")
def sparse_vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    kept = F.map_filter(search.to_sparse_map(dense=F.col("embedding")), lambda _, w: w.cast("double") > 0.1)
    c = e.select(F.col("vec_id").alias("chunk_id"), kept.alias("sparse"))
    hits = search.sparse_vector_search(c.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), c, 10)
    return hits.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def two_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits, and as a second retriever the hits by number of distinct shared tokens."""
    q, stored = bench_questions(spark, sf_dir), doc_index(spark, sf_dir)
    bm25 = search.bm25_search(q, stored, 10).withColumn("retriever", F.lit("sparse"))
    asked = q.select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("question")))).alias("token"), F.lit(1.0).alias("f"))
    return bm25.unionByName(search.lexical_best(asked, stored.docs, 10).withColumn("retriever", F.lit("dense")))


TWO = f"""{BM25},
dtok AS (SELECT doc_id, unnest(list_distinct(t)) AS token FROM tok), qtok AS (SELECT DISTINCT query_id, token FROM qt),
cnt AS (SELECT query_id, doc_id AS chunk_id, count(*)::DOUBLE AS score FROM qtok JOIN dtok USING (token) GROUP BY 1, 2),
two AS (SELECT query_id, chunk_id, score, rank, 'sparse' AS retriever FROM hits UNION ALL
  SELECT query_id, chunk_id, score, rank, 'dense' FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cnt QUALIFY rank <= 10)),
rrf AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM two GROUP BY 1, 2),
rrfk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rrf QUALIFY rank <= 30),
scaled AS (SELECT *, score / CASE WHEN max(abs(score)) OVER w = 0 THEN 1 ELSE max(abs(score)) OVER w END AS part FROM two WINDOW w AS (PARTITION BY query_id, retriever)),
wf AS (SELECT query_id, chunk_id, round(sum(CASE retriever WHEN 'sparse' THEN 0.65 ELSE 0.35 END * part), 9) AS score FROM scaled GROUP BY 1, 2),
wfk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM wf QUALIFY rank <= 30)
"""


@query("rrf_fuse", f"WITH {TWO} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM rrfk")
def rrf_fuse(spark, sf_dir):
    return fuse.rrf(two_lists(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("weighted_fuse", f"WITH {TWO} SELECT query_id, chunk_id, round(score, 5) AS score FROM wfk")
def weighted_fuse(spark, sf_dir):
    return fuse.weighted_fusion(two_lists(spark, sf_dir), 0.65).select("query_id", "chunk_id", F.round("score", 5).alias("score"))


@query("fusion_gate", f"""
WITH {TWO}, f AS (SELECT query_id, score, 'rrf' AS s FROM rrfk WHERE query_id % 2 = 0 UNION ALL SELECT query_id, score, 'weighted' FROM wfk WHERE query_id % 2 = 1),
b AS (SELECT query_id, max(score) AS best FROM f GROUP BY query_id)
SELECT item_id AS query_id, best IS NOT NULL AND (item_id % 2 = 0 OR best >= 0.15) AS actionable FROM benchmark LEFT JOIN b ON query_id = item_id""")
def fusion_gate(spark, sf_dir):
    q = bench_questions(spark, sf_dir).withColumn("query_scene", F.when(F.col("query_id") % 2 == 1, "policy_lookup").otherwise("general_lookup"))
    policies = fuse.fusion_policy(q, ("policy_lookup",), fuse.parse_scene_weights("policy_lookup:0.65"))
    return fuse.fusion_gate(fuse.fuse(two_lists(spark, sf_dir), policies), policies).select("query_id", "actionable")


@query("merge_routes", f"""
WITH {TWO}, o AS (SELECT query_id, chunk_id, max(score) AS score, list_sort(list(DISTINCT CASE retriever WHEN 'sparse' THEN 'bm25' ELSE 'overlap' END)) AS r FROM two GROUP BY 1, 2)
SELECT query_id, chunk_id, round(score, 4) AS score, array_to_string(r, ',') AS matched_routes, len(r) AS matched_route_count FROM o""")
def merge_routes(spark, sf_dir):
    lexical = F.col("retriever") == "sparse"
    h = two_lists(spark, sf_dir).withColumns({"route_name": F.when(lexical, "bm25").otherwise("overlap"), "route_kind": F.when(lexical, "a").otherwise("b"), "route_order": F.when(lexical, 0).otherwise(1)})
    return fuse.merge_routes(h).select("query_id", "chunk_id", F.round("score", 4).alias("score"), F.array_join("matched_routes", ",").alias("matched_routes"), "matched_route_count")


CHILD_BM25 = BM25.replace(f"SELECT doc_id, {TOKENS.format('text')} AS t FROM documents", f"SELECT chunk_id AS doc_id, {TOKENS.format('body')} AS t FROM chunks WHERE chunk_level = 'child'")


@query("expand_parents", f"""
WITH {CHUNKS}, {CHILD_BM25}, e AS (SELECT h.query_id, c.parent_chunk_id AS chunk_id, max(h.score) AS score, string_agg(h.chunk_id, ',' ORDER BY h.chunk_id) AS kids, count(*) AS n FROM hits h JOIN chunks c ON c.chunk_id = h.chunk_id GROUP BY 1, 2)
SELECT query_id, e.chunk_id, score, kids AS matched_child_chunk_ids, n::INTEGER AS matched_child_count, p.doc_id, p.source, p.body AS content FROM e JOIN chunks p ON p.chunk_id = e.chunk_id AND p.chunk_level = 'parent'""")
def expand_parents(spark, sf_dir):
    """Search over child chunks, answered by their parents. Chunk ids are stable and tell the document, so only documents with a
    hit are chunked again for their texts."""
    docs = sectioned_documents(spark, sf_dir)
    children = lambda: search.searchable(chunk.build_chunks(docs))
    hits = shared.cut(search.bm25_search(bench_questions(spark, sf_dir), stored_index(spark, sf_dir, "children", children), 10))
    begins = hits.select(F.regexp_extract("chunk_id", r"^c-(.*)-\d+-[0-9a-f]{16}$", 1).alias("_begin")).distinct()
    begins = F.broadcast(begins) if hits.count() <= search.FEW_HITS else begins
    chunks = chunk.build_chunks(docs.join(begins, F.substring("doc_id", 1, 8) == F.col("_begin"), "left_semi"))
    out = fuse.expand_parents(hits, chunks, ("source", "doc_id"))
    return out.select("query_id", "chunk_id", "score", F.array_join("matched_child_chunk_ids", ",").alias("matched_child_chunk_ids"), "matched_child_count", "doc_id", "source", "content")


@query("metadata_boost", f"""
WITH {BM25}, h AS (SELECT hits.*, source, lang FROM hits JOIN documents ON doc_id = chunk_id),
b AS (SELECT query_id, chunk_id, round(score + round(CASE WHEN source = 'src' || (query_id % 20) THEN 0.08 + 0.12 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.05 ELSE 0 END, 6), 6) AS s, rank AS r FROM h)
SELECT query_id, chunk_id, round(s, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r) AS rank FROM b""")
def metadata_boost(spark, sf_dir):
    q = bench_questions(spark, sf_dir).select("query_id", F.create_map(F.lit("department"), F.col("department")).alias("metadata_intent"), F.create_map(F.lit("lang"), F.lit("en")).alias("structured_filters"))
    boosted = fuse.metadata_boost(rich_hits(spark, sf_dir).withColumn("department", F.col("source")), q, ["department", "lang"])
    return boosted.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


GOV = f"""{BM25},
g0 AS (SELECT h.query_id, h.chunk_id, h.score, h.rank AS prior, d.doc_id % 3 + 1 AS a, date_diff('day', DATE '0001-01-01', {DAY}::DATE) + 1 AS f, (d.doc_id % 7) * 10 + d.doc_id % 3 AS v, 'topic ' || (d.doc_id % 5) AS title, {VERSION} AS version, {DAY} AS day, {AUTHORITY} AS authority, d.doc_id FROM hits h JOIN documents d ON d.doc_id = h.chunk_id),
g1 AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY v) - 1 AS dv FROM g0),
g2 AS (SELECT *, CASE WHEN max(a) OVER w = min(a) OVER w THEN 0 ELSE (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) END AS an,
  CASE WHEN max(f) OVER w = min(f) OVER w THEN 0 ELSE (f - min(f) OVER w) / (max(f) OVER w - min(f) OVER w) END AS fn, CASE WHEN max(dv) OVER w = 0 THEN 0 ELSE dv / max(dv) OVER w END AS vn FROM g1 WINDOW w AS (PARTITION BY query_id)),
gov AS (SELECT *, an * 0.08 + fn * 0.06 + vn * 0.04 AS bonus, row_number() OVER (PARTITION BY query_id ORDER BY score + (an * 0.08 + fn * 0.06 + vn * 0.04) DESC, prior) AS rank FROM g2)
"""


@query("governance_rank", f"WITH {GOV} SELECT query_id, chunk_id, rank, round(round(bonus, 6), 4) AS governance_bonus, round(score, 4) AS score FROM gov")
def governance_rank(spark, sf_dir):
    ranked = govern.governance_rank(rich_hits(spark, sf_dir))
    return ranked.select("query_id", "chunk_id", "rank", F.round("governance_bonus", 4).alias("governance_bonus"), F.round("score", 4).alias("score"))


@query("conflicts", f"""
WITH {GOV}, t AS (SELECT query_id, title, min(rank) AS fr, arg_min(chunk_id, rank) AS preferred_chunk_id FROM gov WHERE rank <= 5
  GROUP BY query_id, title HAVING count(*) >= 2 AND (count(DISTINCT version) > 1 OR count(DISTINCT day) > 1 OR count(DISTINCT authority) > 1)),
c AS (SELECT query_id, title AS conflict_topic, preferred_chunk_id FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fr) = 1)
SELECT item_id AS query_id, conflict_topic, preferred_chunk_id, conflict_topic IS NOT NULL AS conflict_detected,
  CASE WHEN conflict_topic IS NULL THEN 'grounded_answer' ELSE 'grounded_answer_with_conflict' END AS answer_mode FROM benchmark LEFT JOIN c ON query_id = item_id""")
def conflicts(spark, sf_dir):
    found = govern.detect_conflicts(govern.governance_rank(rich_hits(spark, sf_dir)), bench_questions(spark, sf_dir))
    return found.select("query_id", "conflict_topic", "preferred_chunk_id", "conflict_detected", "answer_mode")


KEYWORDS = "list_distinct(regexp_extract_all(trim(regexp_replace({}, '\\s+', ' ', 'g')), '[A-Za-z0-9_./:-]+'))"


@query("rerank", f"""
WITH {BM25}, p AS (SELECT h.query_id, chunk_id, h.rank AS prior_rank, {KEYWORDS.format('question')} AS a, {KEYWORDS.format('text')} AS b FROM hits h JOIN q USING (query_id) JOIN documents ON doc_id = chunk_id),
s AS (SELECT query_id, chunk_id, prior_rank, round(len(list_intersect(a, b)) / greatest(1, len(a)), 6) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior_rank) AS rank FROM s)
SELECT query_id, chunk_id, score, rank, prior_rank::INTEGER AS prior_rank FROM r WHERE rank <= 8""")
def rerank(spark, sf_dir):
    hits = govern.rerank_candidates(rich_hits(spark, sf_dir))
    return govern.rerank(hits, bench_questions(spark, sf_dir)).select("query_id", "chunk_id", "score", "rank", "prior_rank")


#: Greedy packing step by step down the ranks; ``{doc}`` names the document of a hit, ``{sec}`` its section.
PACKED = """h10 AS (SELECT hits.query_id, hits.rank, hits.chunk_id, {doc} AS d, {sec} AS s, length(text) AS n FROM hits JOIN documents ON doc_id = hits.chunk_id),
pack AS (SELECT DISTINCT query_id, 0::BIGINT AS rank, [] ::STRUCT(d BIGINT, s VARCHAR)[] AS kept, 0::BIGINT AS used, false AS ok FROM h10 UNION ALL
  SELECT query_id, rank, CASE WHEN ok THEN list_append(kept, {{'d': d, 's': s}}) ELSE kept END, used + CASE WHEN ok THEN n + 160 ELSE 0 END, ok FROM (
    SELECT p.query_id, h.rank, p.kept, p.used, h.d, h.s, h.n, NOT (len(list_filter(p.kept, lambda x: x.d = h.d)) = 0 AND len(list_distinct(list_transform(p.kept, lambda x: x.d))) >= 4)
      AND len(list_filter(p.kept, lambda x: x.d = h.d)) < 2 AND NOT (h.s <> '' AND len(list_filter(p.kept, lambda x: x.d = h.d AND x.s = h.s)) > 0) AND NOT (len(p.kept) > 0 AND p.used + h.n + 160 > {most}) AS ok
    FROM pack p JOIN h10 h ON h.query_id = p.query_id AND h.rank = p.rank + 1)),
packed AS (SELECT h10.*, row_number() OVER (PARTITION BY h10.query_id ORDER BY h10.rank) AS pack_order FROM h10 JOIN pack USING (query_id, rank) WHERE pack.ok)"""


@query("pack_contexts", f"""
WITH RECURSIVE {BM25}, {PACKED.format(doc='doc_id % 6', sec="'part ' || (doc_id % 2)", most=20000)}
SELECT query_id, rank, chunk_id, d::VARCHAR AS doc_id, pack_order::INTEGER AS pack_order FROM packed""")
def pack_contexts(spark, sf_dir):
    """Hits of six documents of two sections, so that every limit of the packing is met."""
    hits = rich_hits(spark, sf_dir).withColumn("doc_id", (F.col("doc_id") % 6).cast("string"))
    return context.pack_contexts(hits, max_chars=20_000).select("query_id", "rank", "chunk_id", "doc_id", "pack_order")


@query("egress", f"""
WITH {BM25}, q4 AS (SELECT item_id AS query_id, item_id % 4 AS o FROM benchmark),
s AS (SELECT query_id, chunk_id, rank, o, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM hits JOIN q4 USING (query_id) WHERE o < 3)
SELECT query_id, chunk_id, rank, CASE o WHEN 0 THEN 'full_context' WHEN 1 THEN 'redacted_context' ELSE 'minimal_redacted_context' END AS egress_strategy FROM s WHERE o < 2 OR n <= 1""")
def egress(spark, sf_dir):
    q = bench_questions(spark, sf_dir).select("query_id", F.col("clearance_level").alias("data_classification"), F.lit("").alias("model_route"))
    hits = rich_hits(spark, sf_dir).select("query_id", "chunk_id", "rank", "content")
    return context.apply_egress(hits, q).select("query_id", "chunk_id", "rank", "egress_strategy")


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive answers of all questions, parsed again, with what was retrieved and the grounding verdict."""
    q, hits = bench_questions(spark, sf_dir), rich_hits(spark, sf_dir)
    hits = hits.withColumn("chunk_id", F.col("chunk_id").cast("string"))
    parsed = context.parse_answers(context.local_answer(q, hits).select("query_id", "raw"), hits)
    got = hits.groupBy("query_id").agg(F.collect_set("chunk_id").alias("retrieved_chunk_ids"), F.collect_set(F.col("doc_id").cast("string")).alias("retrieved_doc_ids"))
    both = q.join(parsed, "query_id").join(got, "query_id", "left")
    return decide.validate_grounding(both.withColumns({"refusal": F.lit(False), "refusal_reason": F.lit("")}))


@query("local_answers", f"""
WITH {BM25}, two AS (SELECT query_id, list(chunk_id::varchar ORDER BY rank) AS ids FROM hits WHERE rank <= 2 GROUP BY query_id), n AS (SELECT query_id, count(*) AS k FROM hits GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN ids IS NULL THEN 0.0 ELSE 0.62 END AS confidence, ids IS NOT NULL AS grounding_ok, CASE WHEN ids IS NULL THEN 'low_confidence' ELSE '' END AS refusal_reason,
  coalesce(array_to_string(ids, ','), '') AS cited, round(coalesce(len(ids) / k, 0), 6) AS coverage FROM benchmark LEFT JOIN two ON query_id = item_id LEFT JOIN n ON n.query_id = item_id""")
def local_answers(spark, sf_dir):
    a = answered(spark, sf_dir)
    none = F.array().cast("array<string>")
    coverage = context.citation_coverage(F.col("cited_chunk_ids"), F.coalesce("retrieved_chunk_ids", none))
    return a.select("query_id", "confidence", "grounding_ok", "refusal_reason", F.array_join("cited_chunk_ids", ",").alias("cited"), F.round(coverage, 6).alias("coverage"))


@query("citations", f"""
WITH {GOV} SELECT query_id, rank, chunk_id, title, {LEVEL} AS data_classification, round(score, 4) AS retrieval_score, round(score + bonus, 6) AS governance_rank_score, NULL::VARCHAR AS owner_department,
  CASE WHEN chunk_id % 2 = 0 THEN 'found by bm25, title; ' ELSE '' END || CASE WHEN round(bonus, 6) > 0 THEN 'moved up by its standing; ' ELSE '' END || 'stands in part ' || (chunk_id % 2) AS selection_reason FROM gov""")
def citations(spark, sf_dir):
    """Every hit cited twice, each chunk kept once."""
    routes = F.when(F.col("chunk_id") % 2 == 0, F.array(F.lit("bm25"), F.lit("title")))
    hits = govern.governance_rank(rich_hits(spark, sf_dir)).withColumns({"matched_routes": routes, "section_path": F.col("section")})
    cited = context.distinct_citations(context.citations(hits.unionByName(hits.withColumn("rank", F.col("rank") + 100))))
    c = lambda f: F.col(f"citation.{f}")
    return cited.select("query_id", "rank", c("chunk_id"), c("title"), c("data_classification"), F.round(c("retrieval_score"), 4).alias("retrieval_score"), c("governance_rank_score").alias("governance_rank_score"), c("owner_department"), c("selection_reason"))


@query("prompts", f"""
WITH RECURSIVE {BM25}, {PACKED.format(doc='doc_id', sec="'part ' || (doc_id % 2)", most=3200)},
b AS (SELECT query_id, string_agg('[CHUNK_ID:' || chunk_id || '] title=topic ' || (chunk_id % 5) || ' source=' || source || ' page= section=' || s || chr(10) || text || chr(10), chr(10) || chr(10) ORDER BY rank) AS c FROM packed JOIN documents ON doc_id = chunk_id GROUP BY query_id)
SELECT q.query_id, 'Question:' || chr(10) || question || chr(10) || chr(10) || CASE WHEN q.query_id % 2 = 1 THEN 'Notice:' || chr(10) || 'note ' || q.query_id || chr(10) || chr(10) ELSE '' END || 'Contexts:' || chr(10) || coalesce(c, '') AS prompt FROM q LEFT JOIN b USING (query_id)""")
def prompts(spark, sf_dir):
    packed = context.pack_contexts(rich_hits(spark, sf_dir))
    q = bench_questions(spark, sf_dir).withColumn("conflict_summary", F.when(F.col("query_id") % 2 == 1, F.concat(F.lit("note "), F.col("query_id"))).otherwise(""))
    return context.build_prompt(q, packed).select("query_id", "prompt")


@query("generation_gate", f"""
WITH {BM25}, m AS (SELECT query_id, greatest(max(doc_id % 4), 1) AS o FROM hits JOIN documents ON doc_id = chunk_id WHERE query_id % 13 <> 0 GROUP BY query_id),
s AS (SELECT item_id AS i, o, CASE WHEN o IS NULL THEN 'empty_context' WHEN item_id % 7 = 0 THEN 'bulk_sensitive_export_request' WHEN item_id % 11 = 0 THEN 'access_denied' WHEN item_id % 2 = 1 OR o = 3 THEN '' END AS r FROM benchmark LEFT JOIN m ON query_id = item_id)
SELECT i AS query_id, r AS gate_reason, CASE WHEN r = '' THEN 'local_grounded_answer' WHEN r IS NULL THEN 'grounded_answer' ELSE 'refusal' END AS answer_mode, CASE WHEN r = '' THEN 0.62::DOUBLE WHEN r IS NOT NULL THEN 0.0::DOUBLE END AS confidence, coalesce(r <> '', false) AS refusal FROM s""")
def generation_gate(spark, sf_dir):
    """Some questions ask for bulk exports, some were denied, some have no hits."""
    hits = rich_hits(spark, sf_dir).filter("query_id % 13 <> 0")
    asked = bench_questions(spark, sf_dir).withColumns({"question": F.when(F.col("query_id") % 7 == 0, F.concat(F.lit(risk.BULK_EXPORT[0]), F.col("question"))).otherwise(F.col("question")), "refusal_reason": F.when(F.col("query_id") % 11 == 0, "access_denied").otherwise("")})
    q = asked.join(filters.max_classification(hits), "query_id", "left")
    q = q.withColumn("model_route", filters.model_route(F.col("data_classification"), F.col("allow_external_llm")))
    q = risk.risk_decision(q).join(context.egress_decision(q).select("query_id", "egress_allowed"), "query_id")
    return decide.generation_gate(q, hits, context.pack_contexts(hits))


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions with the turns before them as history."""
    c = table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)  # what the history window looks at
    h = c.withColumn("history", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(before))
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return h.filter("role = 'user'").select(key.alias("query_id"), "conv_id", "turn", F.col("text").alias("question"), "history")


@query("strategy_signals", rf"""
WITH u AS (SELECT conv_id || '-' || turn AS query_id, {FOLD.format("coalesce(text, '')")} AS q FROM conversations WHERE role = 'user'),
s AS (SELECT *, regexp_matches(q, '(?i)\b(ERR|ERROR|E)[-_]?\d+\b') AS err, regexp_matches(q, '(?i)(\b\d+\.\d+(\.\d+)?\b|version)') AS ver, regexp_matches(q, '[A-Za-z]{{1,10}}[-_/][A-Za-z0-9_/-]{{2,32}}') AS num, regexp_matches(q, '(?i)vs') AS cmp FROM u)
SELECT query_id, err AS has_error_code, ver AS has_version_constraint, num AS has_doc_number, cmp AS is_comparison,
  err OR ver OR num OR regexp_matches(q, '\b[A-Z][A-Z0-9._/-]{{2,}}\b|\b\d{{3,}}\b|`[^`]{{2,40}}`|“[^”]{{2,40}}”|"[^"]{{2,40}}"') AS has_precise_identifier, length(q) <= 4 AS need_clarify,
  CASE WHEN regexp_matches(q, '(?i)SOP') THEN 'procedure_lookup' WHEN err THEN 'error_code_lookup' WHEN cmp THEN 'comparison_analysis' ELSE 'general_lookup' END AS query_scene FROM s""")
def strategy_signals(spark, sf_dir):
    s = understand.strategy_signals(user_turns(spark, sf_dir))
    return s.select("query_id", "has_error_code", "has_version_constraint", "has_doc_number", "is_comparison", "has_precise_identifier", "need_clarify", "query_scene")


@query("alias_matches", """
WITH u AS (SELECT conv_id || '-' || turn AS query_id, text AS q FROM conversations WHERE role = 'user'),
h AS (SELECT query_id, n_nationkey AS k, strpos(q, a) AS pos, length(a) AS n FROM u, (SELECT n_nationkey, unnest([lower(left(n_name, 2)), lower(left(n_name, 3))]) AS a FROM nation) WHERE contains(q, a)),
g AS (SELECT query_id, k, count(*) AS c, min(pos) AS pos, max(n) AS n FROM h GROUP BY 1, 2)
SELECT query_id, k AS canonical FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, pos, n DESC, k DESC) = 1""")
def alias_matches(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    low = lambda k: F.lower(F.substring("n_name", 1, k))
    aliases = n.select(F.col("n_nationkey").alias("canonical"), F.explode(F.array(low(2), low(3))).alias("alias"))
    return understand.match_alias_table(user_turns(spark, sf_dir).select("query_id", "question"), aliases)


def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))


@query("turn_scores", r"""
WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f, text, last_value(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS question,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS age FROM conversations),
k AS (SELECT *, list_distinct(regexp_extract_all(f, '[A-Za-z0-9_./:-]+')) AS a, list_distinct(regexp_extract_all(trim(regexp_replace(question, '\s+', ' ', 'g')), '[A-Za-z0-9_./:-]+')) AS b FROM c)
SELECT conv_id, turn, age, round(round(0.38 * CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END + 0.22 / (1.0::DOUBLE + age) + CASE WHEN role = 'user' THEN 0.08 ELSE 0.03 END, 4), 3) AS score FROM k""")
def turn_scores(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    return budget.score_turns(turns, conversation_questions(spark, sf_dir)).select("conv_id", "turn", "age", F.round("score", 3).alias("score"))


EVENTS = """
e AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS t FROM events),
b AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)::DOUBLE AS past_24h_query_count,
  round(avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW), 6) AS high_risk_ratio_7d,
  sum(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS failed_auth_count_7d,
  coalesce((t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id))::DOUBLE, 60.0) AS query_interval_sec FROM e)
"""


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.behaviour_features(table(spark, sf_dir, "events"), ("error",), ("error",))


@query("behaviour_features", f"WITH {EVENTS} SELECT * FROM b")
def behaviour_features(spark, sf_dir):
    return behaviour(spark, sf_dir)


@query("risk_hint", f"""
WITH {EVENTS}, s AS (SELECT event_id, failed_auth_count_7d >= 3 OR high_risk_ratio_7d >= 0.4 OR past_24h_query_count >= 30 AS strong, high_risk_ratio_7d >= 0.15 OR past_24h_query_count >= 12 OR query_interval_sec <= 20 AS medium FROM b)
SELECT event_id, CASE WHEN strong THEN 'high' WHEN medium THEN 'medium' ELSE 'low' END AS risk_level_hint, CASE WHEN strong THEN 0.88::DOUBLE WHEN medium THEN 0.67::DOUBLE ELSE 0.56::DOUBLE END AS hint_confidence FROM s""")
def risk_hint(spark, sf_dir):
    q = behaviour(spark, sf_dir).withColumns({"question": F.lit(""), "session_query_count": F.lit(0.0)})
    return risk.risk_hint(q).select("event_id", "risk_level_hint", "hint_confidence")


@query("hybrid_risk", f"""
WITH {EVENTS}, s AS (SELECT event_id, failed_auth_count_7d >= 3 AS f, high_risk_ratio_7d >= 0.25 AS r, failed_auth_count_7d >= 3 OR high_risk_ratio_7d >= 0.4 OR past_24h_query_count >= 30 AS strong, high_risk_ratio_7d >= 0.15 OR past_24h_query_count >= 12 OR query_interval_sec <= 20 AS medium FROM b)
SELECT event_id, CASE WHEN f OR strong THEN 'high' WHEN r OR medium THEN 'medium' ELSE 'low' END AS final_level, CASE WHEN f OR r OR strong THEN 'review' ELSE 'allow' END AS final_action FROM s""")
def hybrid_risk(spark, sf_dir):
    q = behaviour(spark, sf_dir).withColumns({"question": F.lit(""), "session_query_count": F.lit(0.0), "restricted_hit_ratio": F.lit(0.0), "sensitive_hit_ratio": F.lit(0.0)})
    ruled = risk.simple_risk_rules(risk.risk_hint(q))
    return risk.hybrid_risk(ruled, F.col("risk_level_hint")).select("event_id", "final_level", "final_action")


@query("feature_stats", f"""
WITH {EVENTS}, u AS (SELECT unnest(['past_24h_query_count', 'high_risk_ratio_7d', 'failed_auth_count_7d', 'query_interval_sec']) AS feature, unnest([past_24h_query_count, high_risk_ratio_7d, failed_auth_count_7d, query_interval_sec]) AS x FROM b)
SELECT feature, round(avg(x), 4) AS mean, round(CASE WHEN stddev_pop(x) > 1e-6 THEN stddev_pop(x) ELSE 1 END, 4) AS std FROM u GROUP BY feature""")
def feature_stats(spark, sf_dir):
    names = ("past_24h_query_count", "high_risk_ratio_7d", "failed_auth_count_7d", "query_interval_sec")
    return risk.fit_stats(behaviour(spark, sf_dir), names).select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


STANDARD = ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 1e-6 THEN stddev_pop({c}) OVER () ELSE 1 END, 4) AS {c}" for c in ("past_24h_query_count", "high_risk_ratio_7d", "failed_auth_count_7d", "query_interval_sec"))


@query("standardized_features", f"WITH {EVENTS} SELECT event_id, user_id, {STANDARD} FROM b")
def standardized_features(spark, sf_dir):
    names = ("past_24h_query_count", "high_risk_ratio_7d", "failed_auth_count_7d", "query_interval_sec")
    rows = behaviour(spark, sf_dir)
    out = risk.standardize(rows, risk.fit_stats(rows, names))
    return out.select("event_id", "user_id", *[F.round(c, 4).alias(c) for c in names])


@query("retrieval_risk_features", f"""
WITH {BM25} SELECT query_id, round(max(score), 4) AS top1_score, round(avg(CASE WHEN rank <= 5 THEN score END), 4) AS top5_score_mean, round(avg((doc_id % 4 = 3)::INT), 4) AS restricted_hit_ratio,
  round(avg((doc_id % 4 = 2)::INT), 4) AS sensitive_hit_ratio, round(avg((doc_id % 3 + 1) / 3.0::DOUBLE), 4) AS authority_score_mean, count(DISTINCT source)::DOUBLE AS source_count FROM hits JOIN documents ON doc_id = chunk_id GROUP BY query_id""")
def retrieval_risk_features(spark, sf_dir):
    f = risk.retrieval_risk_features(rich_hits(spark, sf_dir))
    return f.select("query_id", *[F.round(c, 4).alias(c) for c in ("top1_score", "top5_score_mean", "restricted_hit_ratio", "sensitive_hit_ratio", "authority_score_mean")], "source_count")


def event_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answer rows: the properties text is the question, the type sets class and refusal."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        i.cast("string").alias("audit_id"), F.col("user_id").cast("string").alias("user_id"), F.coalesce("props", F.lit("")).alias("question"), F.when(i % 50 == 0, "restricted").otherwise("internal").alias("data_classification"),
        (i % 20 == 0).alias("refusal"), F.when(i % 20 == 0, F.when(i % 40 == 0, "access_denied").otherwise("low_confidence")).otherwise("").alias("refusal_reason"), (i % 33 == 0).alias("conflict_detected"),
    )


@query("audit_events", """
SELECT 'response' AS event_type, event_id::varchar AS audit_id, user_id::varchar AS user_id, sha256(coalesce(props, '')) AS question_hash, 'low' AS risk_level, event_id % 20 = 0 AS refusal, event_id % 33 = 0 AS conflict_detected FROM events""")
def audit_events(spark, sf_dir):
    return risk.audit_events(event_answers(spark, sf_dir)).select("event_type", "audit_id", "user_id", "question_hash", "risk_level", "refusal", "conflict_detected")


@query("alerts", """
SELECT 'security_alert' AS event_type, event_id::varchar AS audit_id, sha256(coalesce(props, '')) AS question_hash FROM events WHERE event_id % 50 = 0 OR event_id % 40 = 0 OR event_id % 33 = 0""")
def alerts(spark, sf_dir):
    return risk.alert_events(event_answers(spark, sf_dir)).select("event_type", "audit_id", "question_hash")


@query("audit_stream", """
SELECT 'response' AS event_type, event_id::varchar AS audit_id, user_id::varchar AS user_id, sha256(coalesce(props, '')) AS question_hash FROM events""")
def audit_stream(spark, sf_dir):
    """The audit sink fed by a stream over the event files, one pass."""
    schema = table(spark, sf_dir, "events").schema
    out = shared_folder(spark)
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")  # a file or a folder
    rows = stream.select(F.col("event_id").cast("string").alias("audit_id"), F.col("user_id").cast("string").alias("user_id"), F.coalesce("props", F.lit("")).alias("question"))
    audit.start_audit(rows, out, f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/audit").select("event_type", "audit_id", "user_id", "question_hash")


@query("histogram", """
WITH s AS (SELECT CASE WHEN n_chars <= 100 THEN 0 WHEN n_chars <= 500 THEN 1 WHEN n_chars <= 1000 THEN 2 WHEN n_chars <= 5000 THEN 3 ELSE 4 END AS slot FROM documents), c AS (SELECT slot, count(*) AS n FROM s GROUP BY slot),
f AS (SELECT unnest(range(5)) AS slot, unnest([100.0, 500.0, 1000.0, 5000.0, NULL]::DOUBLE[]) AS bound)
SELECT f.slot::INTEGER AS slot, bound, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (ORDER BY f.slot)::BIGINT AS cumulative FROM f LEFT JOIN c ON c.slot = f.slot""")
def histogram(spark, sf_dir):
    return risk.bucket_histogram(table(spark, sf_dir, "documents"), "n_chars", [100, 500, 1000, 5000])


@query("label_metrics", """
WITH p AS (SELECT quality, CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END AS prediction FROM labels JOIN documents USING (doc_id)), a AS (SELECT avg((quality = prediction)::INT) AS accuracy FROM p)
SELECT c::BIGINT AS cls, (SELECT count(*) FROM p WHERE quality = c) AS support, round((SELECT avg((quality = c)::INT) FROM p WHERE prediction = c), 6) AS precision, round((SELECT avg((prediction = c)::INT) FROM p WHERE quality = c), 6) AS recall, round(accuracy, 6) AS accuracy FROM a, (SELECT unnest([0, 1]) AS c)""")
def label_metrics(spark, sf_dir):
    p = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("quality").cast("long").alias("label"), F.when(F.col("n_chars") >= 500, 1).otherwise(0).cast("long").alias("prediction"))
    return risk.label_metrics(p).select("cls", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy")])


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as evaluation rows."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(
        i.alias("query_id"), F.col("text").alias("question"), F.col("source").alias("scenario"), F.array("lang", F.concat(F.lit("t"), (i % 3).cast("string"))).alias("tags"), (F.col("toxic") == 1).alias("expected_refusal"), (i % 6 == 0).alias("refusal"),
        F.when(i % 2 == 0, F.col("quality") == 0).alias("expected_conflict"), (i % 10 == 0).alias("conflict_detected"), F.element_at(F.array(F.lit("public"), F.lit("internal"), F.lit("sensitive"), F.lit("restricted")), (i % 4 + 1).cast("int")).alias("data_classification"), F.when(i % 4 == 3, "local_only").otherwise("external_allowed").alias("model_route"),
        F.when(i % 5 == 0, "heuristic_guardrail").when(i % 5 == 1, "llm_enhanced").otherwise("heuristic").alias("analysis_source"), ((i % 10) / 10.0).alias("analysis_confidence"), F.concat(F.lit("scene"), (i % 7).cast("string")).alias("query_scene"),
        (i % 3 == 0).alias("metadata_boosted"), (i % 9 == 0).alias("enterprise_entity_boosted"), (i % 2 == 0).alias("governance_boosted"), (i % 4).cast("int").alias("explainable_citation_count"),
        ((i % 11) / 10.0).alias("faithfulness"), ((i % 13) / 12.0).alias("answer_relevancy"), F.lit(None).cast("double").alias("context_recall"), F.lit(0.9).cast("double").alias("context_precision"),
    )


ROWS = """r AS (SELECT doc_id AS i, text AS question, source AS scenario, lang, toxic, quality, doc_id % 6 = 0 AS refusal, doc_id % 10 = 0 AS conflict FROM documents JOIN labels USING (doc_id))"""


@query("eval_summary", f"""
WITH {ROWS} SELECT count(*) AS sample_count, round(avg(refusal::INT), 6) AS refusal_rate, round(avg(conflict::INT), 6) AS conflict_detected_rate, round(avg((i % 3 = 0)::INT), 6) AS metadata_boost_hit_rate,
  round(avg((i % 9 = 0)::INT), 6) AS enterprise_entity_boost_hit_rate, round(avg((i % 2 = 0)::INT), 6) AS governance_boost_hit_rate, round(avg(i % 4), 6) AS avg_explainable_citations, round(avg((i % 10) / 10.0::DOUBLE), 6) AS avg_analysis_confidence FROM r""")
def eval_summary(spark, sf_dir):
    s = evaluate.eval_summary(eval_rows(spark, sf_dir))
    return s.select("sample_count", *[F.round(c, 6).alias(c) for c in s.columns if c != "sample_count"])


@query("eval_shares", f"""
WITH {ROWS}, u AS (SELECT 'classification' AS kind, CASE i % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'sensitive' ELSE 'restricted' END AS value FROM r UNION ALL SELECT 'model_route', CASE WHEN i % 4 = 3 THEN 'local_only' ELSE 'external_allowed' END FROM r
  UNION ALL SELECT 'analysis_source', CASE i % 5 WHEN 0 THEN 'heuristic_guardrail' WHEN 1 THEN 'llm_enhanced' ELSE 'heuristic' END FROM r UNION ALL SELECT 'scenario', scenario FROM r UNION ALL SELECT 'tag', lang FROM r UNION ALL SELECT 'tag', 't' || (i % 3) FROM r)
SELECT kind, value, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM u GROUP BY kind, value""")
def eval_shares(spark, sf_dir):
    return evaluate.eval_shares(eval_rows(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("expectation_rates", f"""
WITH {ROWS} SELECT round(avg(((toxic = 1) = refusal)::INT), 6) AS expected_refusal_match_rate, round(avg(CASE WHEN i % 2 = 0 THEN ((quality = 0) = conflict)::INT END), 6) AS expected_conflict_match_rate FROM r""")
def expectation_rates(spark, sf_dir):
    s = evaluate.expectation_rates(eval_rows(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("top_values", f"""
WITH {ROWS}, u AS (SELECT 'top_scenes' AS report, 'scene' || (i % 7) AS name FROM r UNION ALL SELECT 'top_guardrail_scenarios', scenario FROM r WHERE i % 5 = 0 UNION ALL SELECT 'top_llm_enhanced_scenarios', scenario FROM r WHERE i % 5 = 1), c AS (SELECT report, name, count(*) AS n FROM u GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY report ORDER BY n DESC, name) AS rank FROM c QUALIFY rank <= 5""")
def top_values(spark, sf_dir):
    return evaluate.top_values(eval_rows(spark, sf_dir))


@query("recommendations", f"""
WITH {ROWS}, g AS (SELECT avg((i % 5 = 0)::INT) AS g, avg((i % 5 = 1)::INT) AS m, avg(((i % 10) / 10.0 < 0.6)::INT) AS low FROM r), l AS (SELECT list_filter([CASE WHEN g >= 0.2 THEN 'raise_rule_anchors' END, CASE WHEN m >= 0.3 THEN 'extend_rule_coverage' END, CASE WHEN low >= 0.3 THEN 'tune_confidence_weights' END], lambda x: x IS NOT NULL) AS l FROM g)
SELECT CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE 'add_badcases' END AS recommendations FROM l""")
def recommendations(spark, sf_dir):
    return evaluate.recommendations(eval_rows(spark, sf_dir)).select(F.array_join("recommendations", ",").alias("recommendations"))


@query("badcases", f"""
WITH {ROWS}, m AS (SELECT *, (i % 11) / 10.0::DOUBLE AS f, (i % 13) / 12.0::DOUBLE AS a FROM r),
p AS (SELECT i AS query_id, question, CASE WHEN (toxic = 1) <> refusal THEN 4 ELSE 0 END + CASE WHEN i % 2 = 0 AND (quality = 0) <> conflict THEN 4 ELSE 0 END + refusal::INT + conflict::INT + (f < 0.6)::INT + (a < 0.6)::INT AS priority, least(f, a, 0.9) AS min_metric FROM m)
SELECT query_id, priority, round(min_metric, 6) AS min_metric FROM p WHERE priority > 0 ORDER BY priority DESC, p.min_metric, question LIMIT 10""")
def badcases(spark, sf_dir):
    return evaluate.badcases(eval_rows(spark, sf_dir)).select("query_id", F.col("priority").cast("int").alias("priority"), F.round("min_metric", 6).alias("min_metric"))


@query("eval_signals", f"""
WITH {GOV}, s AS (SELECT query_id, list_sort(list_distinct(flatten(list([CASE WHEN chunk_id % 2 = 0 THEN 'bm25' ELSE 'title' END, 'all'])))) AS routes, bool_or(chunk_id % 9 = 0) AS boosted, bool_or(chunk_id % 10 = 0) AS entity, bool_or(round(bonus, 6) > 0) AS governed, count(*) AS n FROM gov WHERE query_id % 5 <> 0 GROUP BY query_id)
SELECT item_id AS query_id, array_to_string(routes, ',') AS matched_routes, coalesce(boosted, false) AS metadata_boosted, coalesce(entity, false) AS enterprise_entity_boosted, CASE WHEN routes IS NOT NULL THEN CASE WHEN entity THEN 'plant' ELSE '' END END AS entities, coalesce(governed, false) AS governance_boosted, coalesce(n, 0) AS explainable_citation_count FROM benchmark LEFT JOIN s ON query_id = item_id""")
def eval_signals(spark, sf_dir):
    """Signals of hits with routes, boosts and entity groups; a fifth of the questions has none."""
    i = F.col("chunk_id")
    hits = govern.governance_rank(rich_hits(spark, sf_dir)).filter("query_id % 5 <> 0").withColumns({
        "matched_routes": F.array(F.when(i % 2 == 0, "bm25").otherwise("title"), F.lit("all")), "metadata_boost": F.when(i % 9 == 0, 0.08).otherwise(0.0),
        "enterprise_entity_matches": F.when(i % 10 == 0, F.array(F.lit("plant"))).otherwise(F.array().cast("array<string>")),
    })
    out = evaluate.eval_signals(bench_questions(spark, sf_dir).select("query_id"), hits, context.citations(hits))
    return out.select("query_id", F.array_join("matched_routes", ",").alias("matched_routes"), "metadata_boosted", "enterprise_entity_boosted", F.array_join("enterprise_entity_matches", ",").alias("entities"), "governance_boosted", "explainable_citation_count")


@query("rank_metrics", f"""
WITH {BM25}, g AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), w AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1),
f AS (SELECT query_id, min(rank) AS first, sum(1 / log2(1 + rank)) AS dcg FROM hits JOIN g USING (query_id, chunk_id) GROUP BY 1),
q2 AS (SELECT w.*, f.first, f.dcg, list_sum(list_transform(range(1, least(n, 10) + 1), lambda x: 1 / log2(1 + x))) AS ideal FROM w LEFT JOIN f USING (query_id))
SELECT count(*) AS n_queries, round(avg(coalesce(1 / first, 0)), 4) AS mrr_at_10, round(avg(coalesce(dcg / ideal, 0)), 4) AS ndcg_at_10, round(avg(coalesce((first <= 3)::INT, 0)), 4) AS hit_at_3, round(avg(coalesce((first <= 5)::INT, 0)), 4) AS hit_at_5 FROM q2""")
def rank_metrics(spark, sf_dir):
    """Truth: documents that hold an item's whole text, found by an equi-join on words; only ids meet before the test, and go to the texts while they are few."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("\\S+"), F.lit(0)))
    # the longest of an item's inner words, the last on ties: inner words stand whole in any text that holds the item
    inner = F.slice(words("item"), 2, F.greatest(F.size(words("item")) - 2, F.lit(0)))
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    may = d.select("chunk_id", F.explode(words("text")).alias("key")).join(b.select("query_id", key.alias("key")), "key").select("query_id", "chunk_id")
    truth = search.with_chunks(may, d).join(b, "query_id").filter(F.contains("text", F.col("item"))).select("query_id", "chunk_id")
    s = evaluate.rank_metrics(bm25_hits(spark, sf_dir), truth)
    return s.select("n_queries", *[F.round(c, 4).alias(c) for c in s.columns if c != "n_queries"])


def report_and_dataset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as dataset rows, their BM25 hits as report contexts; a context that the reference has for every other item."""
    b = table(spark, sf_dir, "benchmark")
    words = F.array_join(F.slice(F.split(T.fold_ws(F.col("text")), " "), 1, 12), " ")
    dataset = b.select(F.col("item_id").alias("row_no"), words.alias("question"), F.col("text").alias("ground_truth"), F.array("text").alias("contexts"), F.lit("lookup").alias("scenario"), F.array(F.lit("bench")).alias("tags"))
    hits = search.with_chunks(bm25_hits(spark, sf_dir, 3), doc_chunks(spark, sf_dir).select("chunk_id", "content"))
    got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("c")).select(F.col("query_id").alias("row_no"), F.transform("c", lambda x: x["content"]).alias("contexts"))
    i = F.col("row_no")
    report = dataset.select("row_no", "question").join(got, "row_no", "left").withColumns({
        "refusal": i % 8 == 0, "answer": F.when(i % 4 == 1, F.concat(F.lit("answer "), i)).otherwise(""), "conflict_detected": i % 5 == 0, "conflict_summary": F.concat(F.lit("two  versions of "), i),
        "refusal_reason": F.when(i % 16 == 0, "access_denied").otherwise(""), "data_classification": F.lit("internal"),
    })
    return report, dataset


TRIPLETS = f"""
ctx AS (SELECT query_id AS i, list(text ORDER BY rank) AS cs FROM hits JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY query_id),
base AS (SELECT item_id AS i, q.question, text, list_filter(list_transform(list_concat([text], coalesce(cs, [])), lambda t: {FOLD.format('t')}), lambda t: t <> '') AS ps FROM benchmark JOIN q ON q.query_id = item_id LEFT JOIN ctx ON ctx.i = item_id WHERE item_id % 8 <> 0),
pos AS (SELECT i, p, row_number() OVER (PARTITION BY i ORDER BY n) - 1 AS positive_no FROM (SELECT i, p, min(n) AS n FROM (SELECT i, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM base) GROUP BY i, p)),
npos AS (SELECT i, count(*) AS k FROM pos GROUP BY i),
pool AS (SELECT t, ('0x' || left(sha256('42:' || t), 15))::BIGINT AS h FROM (SELECT DISTINCT {FOLD.format('text')} AS t FROM benchmark) WHERE t <> ''),
slots AS (SELECT t, row_number() OVER (ORDER BY h % greatest(1, ceil((SELECT count(*) FROM pool) / 4096.0)::BIGINT), h, t) - 1 AS slot, (SELECT count(*) FROM pool) AS n FROM pool),
neg0 AS (SELECT base.i, s.t, (s.slot - ('0x' || left(sha256('42:' || question), 15))::BIGINT % s.n + s.n) % s.n AS k FROM base JOIN npos USING (i), slots s),
neg1 AS (SELECT n.i, n.t, n.k FROM neg0 n JOIN npos USING (i) WHERE n.k < 3 + npos.k AND NOT EXISTS (SELECT 1 FROM pos WHERE pos.i = n.i AND pos.p = n.t)),
neg AS (SELECT i, list(t ORDER BY k)[1:3] AS ns FROM neg1 GROUP BY i),
tri AS (SELECT pos.i AS row_id, {FOLD.format('question')} AS query, positive_no, p AS positive, ns[1] AS negative, ns[2:] AS negatives, ns, 'lookup' AS scenario FROM pos JOIN base USING (i) JOIN neg USING (i))
"""


@query("triplets", f"WITH {BM25}, {TRIPLETS} SELECT row_id, query, positive_no::INTEGER AS positive_no, positive, negative, array_to_string(negatives, '|') AS negatives, scenario, 'bench' AS tags, 'eval_report' AS source FROM tri")
def triplets(spark, sf_dir):
    made = trainsets.build_triplets(*report_and_dataset(spark, sf_dir))
    return made.withColumns({"negatives": F.array_join("negatives", "|"), "tags": F.array_join("tags", "|")})


@query("triplet_report", f"""
WITH {BM25}, {TRIPLETS} SELECT count(*) AS total_rows, count(*) AS valid_rows, 0::BIGINT AS invalid_rows, 0::BIGINT AS positive_is_negative_rows, count(*) - count(DISTINCT query || chr(1) || positive || chr(1) || array_to_string(list_sort(ns), chr(2))) AS duplicate_triplet_rows, count(DISTINCT query) AS unique_queries,
  round(avg(length(query)), 2) AS avg_query_chars, round(avg(length(positive)), 2) AS avg_positive_chars, round(sum(list_sum(list_transform(ns, lambda t: length(t)))) / sum(len(ns)), 2) AS avg_negative_chars, count(*) AS rows_with_scenario, count(*) AS rows_with_tags, count(*) AS rows_with_source FROM tri""")
def triplet_report(spark, sf_dir):
    return trainsets.triplet_report(trainsets.build_triplets(*report_and_dataset(spark, sf_dir)))


@query("triplet_tops", f"""
WITH {BM25}, {TRIPLETS}, u AS (SELECT 'query' AS kind, query AS value FROM tri UNION ALL SELECT 'scenario', scenario FROM tri UNION ALL SELECT 'source', 'eval_report' FROM tri UNION ALL SELECT 'negatives', len(ns)::VARCHAR FROM tri UNION ALL SELECT 'tag', 'bench' FROM tri), c AS (SELECT kind, value, count(*) AS n FROM u GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS rank FROM c QUALIFY rank <= 10""")
def triplet_tops(spark, sf_dir):
    return trainsets.triplet_tops(trainsets.build_triplets(*report_and_dataset(spark, sf_dir)))


@query("pairwise", f"WITH {BM25}, {TRIPLETS} SELECT query, positive AS text, 1 AS label FROM tri UNION ALL SELECT query, unnest(ns), 0 FROM tri")
def pairwise(spark, sf_dir):
    return trainsets.pairwise(trainsets.build_triplets(*report_and_dataset(spark, sf_dir)))[0]


SFT = f"""
ctx AS (SELECT query_id AS i, list(text ORDER BY rank) AS cs FROM hits JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY query_id),
s0 AS (SELECT item_id AS i, {FOLD.format('question')} AS question, {FOLD.format('text')} AS truth, list_filter(list_transform(coalesce(cs, []), lambda t: {FOLD.format('t')}), lambda t: t <> '') AS cs FROM benchmark JOIN q ON q.query_id = item_id LEFT JOIN ctx ON ctx.i = item_id),
s1 AS (SELECT s0.* EXCLUDE (cs), CASE WHEN len(cs) = 0 THEN [truth] ELSE (SELECT list(c ORDER BY n) FROM (SELECT c, min(n) AS n FROM (SELECT unnest(cs) AS c, generate_subscripts(cs, 1) AS n) GROUP BY c)) END AS cs FROM s0),
sft AS (SELECT i, question, CASE WHEN i % 4 = 1 THEN 'answer ' || i ELSE truth END AS answer, 'Evidence found:' || chr(10) || array_to_string(list_transform(cs, lambda t, n: '[text ' || n || '] ' || t), chr(10)) || chr(10) || chr(10) || CASE WHEN i % 5 = 0 THEN 'Note: two  versions of ' || i || chr(10) || chr(10) ELSE '' END || 'Asked: ' || question AS said FROM s1)
"""


@query("sft_rows", f"""
WITH {BM25}, {SFT} SELECT question, 'lookup' AS scenario, 'bench' AS tags, 'eval_report' AS source, i % 8 = 0 AS refusal, CASE WHEN i % 16 = 0 THEN 'access_denied' ELSE '' END AS refusal_reason, i % 5 = 0 AS conflict_detected, 'two versions of ' || i AS conflict_summary, 'internal' AS data_classification,
  '<|system|>' || chr(10) || 'Answer from the evidence.' || chr(10) || '<|user|>' || chr(10) || said || chr(10) || '<|assistant|>' || chr(10) || answer AS rendered FROM sft WHERE i % 8 <> 0 OR i % 5 = 0""")
def sft_rows(spark, sf_dir):
    """Chat rows with refusals only where a conflict was found, too."""
    report, dataset = report_and_dataset(spark, sf_dir)
    both = trainsets.build_sft(report.filter("conflict_detected"), dataset, "Answer from the evidence.").unionByName(trainsets.build_sft(report, dataset, "Answer from the evidence.", include_refusal=False, include_conflict=False))
    rows = trainsets.normalize_messages(both).withColumn("rendered", trainsets.render_chat(F.col("messages")))
    return rows.select("question", "scenario", F.array_join("tags", "|").alias("tags"), "source", "refusal", "refusal_reason", "conflict_detected", "conflict_summary", "data_classification", "rendered")


@query("plain_messages", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<|user|>' || chr(10) || 'kept' WHEN doc_id % 3 = 1 THEN '<|user|>' || chr(10) || 'tell' || chr(10) || source || chr(10) || '<|assistant|>' || chr(10) || lang ELSE '<|user|>' || chr(10) || 'tell' || chr(10) || source END AS rendered FROM documents""")
def plain_messages(spark, sf_dir):
    """Rows of either layout: messages, or instruction, input and output."""
    i = F.col("doc_id")
    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    kind = "array<struct<role:string,content:string>>"
    given = F.when(i % 3 == 0, F.array(m(" User", F.lit(" kept ")), m("assistant", F.lit(" ")))).otherwise(F.array().cast(kind))
    rows = table(spark, sf_dir, "documents").select("doc_id", given.alias("messages"), F.lit("tell ").alias("instruction"), F.col("source").alias("input"), F.when(i % 3 == 1, F.col("lang")).alias("output"))
    return trainsets.normalize_messages(rows).select("doc_id", trainsets.render_chat(F.col("messages")).alias("rendered"))


@query("sft_report", f"""
WITH {BM25}, {SFT} SELECT count(*) AS total_rows, count(*) AS valid_rows, count(*) - count(DISTINCT said || chr(1) || answer) AS duplicate_rows, 1.0::DOUBLE AS grounded_ratio, round(avg((i % 8 = 0)::INT), 4) AS refusal_ratio, round(avg((i % 5 = 0)::INT), 4) AS conflict_ratio,
  round(avg(length({FOLD.format('said')})), 2) AS avg_user_chars, round(avg(length(answer)), 2) AS avg_assistant_chars FROM sft""")
def sft_report(spark, sf_dir):
    return trainsets.sft_report(trainsets.build_sft(*report_and_dataset(spark, sf_dir), "Answer from the evidence."))


@query("merge_chunks", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents")
def merge_chunks(spark, sf_dir):
    old = doc_chunks(spark, sf_dir)
    new = old.filter("doc_id % 3 = 0").withColumn("lang", F.upper("lang"))
    return index.merge_chunks(old, new).select("doc_id", "lang")


@query("point_lookup", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def point_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    return files.get_chunks(doc_chunks(spark, sf_dir), ids).select("doc_id")


@query("store_round_trip", f"SELECT doc_id::varchar AS doc_id, lang, {VERSION} AS version, text AS content FROM documents")
def store_round_trip(spark, sf_dir):
    chunks = doc_chunks(spark, sf_dir).select("chunk_id", "doc_id", "content", "source", "version", "page", "lang")
    return files.from_store(files.to_store(chunks), "lang string").select("doc_id", "lang", "version", "content")


@query("csv_text", """
WITH r AS (SELECT c_nationkey || '-' || (c_custkey // 500) AS source, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 500 ORDER BY c_custkey) AS n, * FROM customer),
t AS (SELECT source, n, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE '## Row ' || n || ': ' || c_name || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ' / ' || c_mktsegment END || chr(10) || 'key: ' || c_custkey || chr(10) || 'Name: ' || c_name
  || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE chr(10) || 'title: ' || c_mktsegment END || chr(10) || 'column_4: x' END AS line FROM r)
SELECT source, source AS title, coalesce(string_agg(line, chr(10) ORDER BY n), '## Header' || chr(10) || 'key' || chr(10) || 'Name' || chr(10) || 'title' || chr(10) || 'column_4') AS content, count(*) AS rows, 4 AS columns FROM t GROUP BY source""")
def csv_text(spark, sf_dir):
    """Customers as the rows of a CSV for each nation and 500 keys: some blank, some without a segment, one header empty."""
    c = table(spark, sf_dir, "customer")
    source = F.concat_ws("-", F.col("c_nationkey").cast("string"), F.floor(F.col("c_custkey") / 500).cast("string"))
    n = F.row_number().over(Window.partitionBy("source").orderBy("c_custkey"))
    cells = F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_mktsegment")), F.lit("x"))
    blank = F.array(*[F.lit(x) for x in ("", " ", "", "")])
    body = c.withColumn("source", source).select("source", n.alias("row_no"), F.when(F.col("c_custkey") % 9 == 0, blank).otherwise(cells).alias("cells"))
    head = body.select("source").distinct().select("source", F.lit(0).alias("row_no"), F.array(F.lit("key"), F.lit("Name"), F.lit("title"), F.lit("")).alias("cells"))
    return files.csv_rows_to_text(head.union(body)).select("source", "title", "content", F.col("rows").cast("long").alias("rows"), "columns")


def faq_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as FAQ entries."""
    b = table(spark, sf_dir, "benchmark")
    words = F.array_join(F.slice(F.split(T.fold_ws(F.col("text")), " "), 1, 12), " ")
    return b.select(F.col("item_id").alias("entry_id"), words.alias("question"), F.col("text").alias("answer"), F.lit("").alias("keywords"), F.lit("bench").alias("category"), (F.col("item_id") % 5 != 0).alias("enabled"), F.lit(0).cast("long").alias("hit_count"), F.lit(None).cast("timestamp").alias("last_hit_at"))


@query("faq_search")
def faq_search(spark, sf_dir):
    return search.faq_search(bench_questions(spark, sf_dir), faq_table(spark, sf_dir)).drop("answer")


@query("faq_upsert", """
SELECT item_id AS entry_id, CASE WHEN item_id % 2 = 0 THEN 'changed' ELSE text END AS answer, item_id % 5 <> 0 AS enabled FROM benchmark""")
def faq_upsert(spark, sf_dir):
    old = faq_table(spark, sf_dir)
    new = old.filter("entry_id % 2 = 0").withColumns({"answer": F.lit("changed"), "entry_id": F.col("entry_id") + 1_000_000})
    return index.upsert_faq(old, new).select("entry_id", "answer", "enabled")


@query("faq_hits", """
WITH h AS (SELECT event_id % (SELECT count(*) FROM benchmark) AS entry_id, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1)
SELECT item_id AS entry_id, coalesce(n, 0) AS hit_count, floor(epoch(last_at))::BIGINT AS last_hit FROM benchmark LEFT JOIN h ON entry_id = item_id""")
def faq_hits(spark, sf_dir):
    faq = faq_table(spark, sf_dir)
    n = faq.count()
    hits = table(spark, sf_dir, "events").select((F.col("event_id") % n).alias("entry_id"), F.col("ts").cast("timestamp").alias("hit_at"))
    return index.apply_faq_hits(faq, hits).select("entry_id", "hit_count", F.unix_timestamp("last_hit_at").alias("last_hit"))


@query("faq_changes", "SELECT item_id AS entry_id, CASE WHEN item_id % 4 = 0 THEN false ELSE item_id % 5 <> 0 END AS enabled FROM benchmark")
def faq_changes(spark, sf_dir):
    faq = faq_table(spark, sf_dir)
    changes = faq.filter("entry_id % 4 = 0").select("entry_id", F.lit(False).alias("enabled"))
    return index.apply_faq_changes(faq, changes)[0].select("entry_id", "enabled")


@query("cache_lookup", """
WITH q AS (SELECT item_id AS query_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 12), ' ') AS question FROM benchmark),
c AS (SELECT lower(question) AS k, max(query_id) AS best FROM q WHERE query_id % 3 = 0 GROUP BY 1)
SELECT query_id, CASE WHEN best IS NOT NULL THEN 'cached' END AS answer FROM q LEFT JOIN c ON k = lower(question)""")
def cache_lookup(spark, sf_dir):
    q = bench_questions(spark, sf_dir).select("query_id", "question")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], "key string, answer string, written_at timestamp, ttl_sec int")
    cache = search.cache_write(empty, q.filter("query_id % 3 = 0").withColumn("answer", F.lit("cached")), now)
    return search.cache_lookup(q, cache, F.lit("2024-06-01 12:00:00").cast("timestamp")).select("query_id", "answer")
