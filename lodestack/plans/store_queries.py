"""Driver queries of sources, sinks, stores, FAQ tables, filters and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import chunk, decide, evaluate, filters, fuse, index, metadata, risk, search, understand
from lodestack.plans.queries import BM25, EVENTS, FOLD, LEVEL, TWO, bench_questions, behaviour, bm25_hits, doc_chunks, doc_index, event_answers, faq_table, query, rich_hits, shared_folder, table, two_lists, user_turns
from lodestack.sources import files

SUFFIXES = (".HTML", ".pdf", ".xyz", "", ".csv", ".Md")


def choose(value, *options: str):
    """The option of an integer column's value."""
    return F.element_at(F.array(*map(F.lit, options)), (value + 1).cast("int"))


@query("route_files", """
WITH p AS (SELECT 'site/p' || page_id || ['.HTML', '.pdf', '.xyz', '', '.csv', '.Md'][page_id % 6 + 1] AS path, page_id % 6 AS k FROM pages)
SELECT path, CASE k WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 4 THEN 'csv' WHEN 5 THEN 'markdown' END AS parser, CASE k WHEN 2 THEN 'unsupported file type: .xyz' WHEN 3 THEN 'unsupported file type: ' END AS error FROM p""")
def route_files(spark, sf_dir):
    i = F.col("page_id")
    paths = table(spark, sf_dir, "pages").select(F.concat(F.lit("site/p"), i.cast("string"), choose(i % 6, *SUFFIXES)).alias("path"))
    known, unknown = files.route_by_suffix(paths)
    return known.unionByName(unknown, allowMissingColumns=True).select("path", "parser", "error")


@query("html_headings", f"""
SELECT doc_id, 'Page ' || doc_id AS title, array_to_string(list_filter(['# Doc ' || doc_id, {FOLD.format("coalesce(text, '')")}, '### In ' || lang, 'first ' || source, 'second & last'], lambda x: trim(x) <> ''), chr(10)) AS content, 'text/html' AS mime_type FROM documents""")
def html_headings(spark, sf_dir):
    """Documents wrapped as pages: a title, headings, a paragraph, an open list, and what a reader must not take."""
    d = table(spark, sf_dir, "documents")
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    i = F.col("doc_id").cast("string")
    page = F.concat(
        F.lit("<html><head><title>Page "), i, F.lit("</title><style>p {x: 1}</style></head><body><h1>Doc "), i, F.lit("</h1><script>var p = '<p>none</p>';</script><p>"), safe,
        F.lit("</p>loose<noscript><p>no</p></noscript><h3>In "), F.col("lang"), F.lit("</h3><ul><li>first "), F.col("source"), F.lit("<li>second &amp; last</ul></body></html>"),
    )
    return files.read_pages(d.select("doc_id", F.lit("u.html").alias("url"), page.alias("html"))).select("doc_id", "title", "content", "mime_type")


@query("jsonl_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark, sf_dir):
    folder = shared_folder(spark)
    files.write_jsonl(table(spark, sf_dir, "documents"), folder)
    return files.read_jsonl(spark, folder, "doc_id long, text string, lang string, source string, n_chars long")


@query("faq_import", """
SELECT item_id AS entry_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS question, 'answer "' || item_id || '", whole' AS answer, CASE WHEN item_id % 2 = 0 THEN 'k' || item_id ELSE '' END AS keywords, true AS enabled, 0::BIGINT AS hit_count
FROM benchmark WHERE item_id % 5 <> 1 AND item_id % 7 <> 1""")
def faq_import(spark, sf_dir):
    """Benchmark items through a CSV with blank questions and answers."""
    i, folder = F.col("item_id"), shared_folder(spark)
    rows = table(spark, sf_dir, "benchmark").select(
        i.cast("string").alias("id"), F.when(i % 5 == 1, "  ").otherwise(F.concat(F.lit(" "), T.fold_ws(F.col("text")), F.lit(" "))).alias("question"),
        F.when(i % 7 != 1, F.concat(F.lit('answer "'), i, F.lit('", whole'))).alias("answer"), F.when(i % 2 == 0, F.concat(F.lit("k"), i)).alias("keywords"),
    )
    rows.write.csv(folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_faq_csv(spark, folder).select("entry_id", "question", "answer", "keywords", "enabled", "hit_count")


@query("snapshot", r"""
SELECT doc_id AS chunk_id, doc_id, text AS content, 'child' AS chunk_level, 256 AS dim, CASE WHEN len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents""")
def snapshot(spark, sf_dir):
    """Vectors of all chunks by the offline encoder, written with them as one snapshot and scanned again."""
    folder, chunks = shared_folder(spark), doc_chunks(spark, sf_dir)
    files.write_snapshot(chunks, index.rebuild_vectors(chunks, search.hashing_encoder()), folder)
    both = files.read_chunks(spark, f"{folder}/chunks").join(files.read_chunks(spark, f"{folder}/vectors"), "chunk_id")
    return both.select("chunk_id", "doc_id", "content", "chunk_level", F.size("embedding").alias("dim"), F.round(search.norm(F.col("embedding")), 3).alias("norm"))


@query("replaced_chunks", "SELECT doc_id, lang FROM documents WHERE doc_id % 4 = 0")
def replaced_chunks(spark, sf_dir):
    folder, chunks = shared_folder(spark), doc_chunks(spark, sf_dir)
    index.replace_chunks(chunks.filter("doc_id % 4 <> 0"), folder)
    index.replace_chunks(chunks.filter("doc_id % 4 = 0"), folder)
    return files.read_chunks(spark, folder).select("doc_id", "lang")


@query("schema_drift", "SELECT lang, count(*) AS n, 'embedding_model,page_label' AS missing FROM documents GROUP BY lang")
def schema_drift(spark, sf_dir):
    chunks = doc_chunks(spark, sf_dir)
    lost = index.missing_columns(chunks, ["chunk_id", "embedding_model", "content", "page_label"])
    return chunks.groupBy("lang").agg(F.count("*").alias("n")).withColumn("missing", F.lit(",".join(lost)))


@query("identities", r"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN sha256(url) ELSE 'id' || page_id END AS doc_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1') ELSE 'T' END AS title FROM pages""")
def identities(spark, sf_dir):
    i = F.col("page_id")
    docs = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source"), F.when(i % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("id"), i)).alias("doc_id"), F.when(i % 2 == 1, " T ").alias("title"))
    return metadata.ensure_identity(docs).select("page_id", "doc_id", "title")


@query("inherited_metadata", "SELECT doc_id, doc_id * 10 + k AS chunk_id, source, nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE ' ' || lang || ' ' END), '') AS lang FROM documents, (SELECT unnest([0, 1]) AS k)")
def inherited_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    chunks = d.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "source").select("doc_id", (F.col("doc_id") * 10 + F.col("k")).alias("chunk_id"), "source")
    docs = d.select("doc_id", F.lit("other").alias("source"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), "lang", F.lit(" "))).alias("lang"))
    return chunk.inherit_metadata(chunks, docs, ["source", "lang", "absent"])


@query("normalized_metadata", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 4 <> 0 THEN 'a,' || source END AS tags FROM documents""")
def normalized_metadata(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "lang", F.lit("\t"))).alias("lang"), F.when(i % 4 != 0, F.concat(F.lit(" a ,,"), "source", F.lit("，a"))).otherwise(" , ").alias("tags"))
    return metadata.normalize_metadata(d, ["lang", "absent"], ["tags"]).select("doc_id", "lang", F.array_join("tags", ",").alias("tags"))


@query("faq_seeded", "SELECT item_id AS entry_id, text AS answer FROM benchmark WHERE item_id % 5 <> 0")
def faq_seeded(spark, sf_dir):
    """An empty table is seeded once; of a second seed nothing enters; enabled entries by id."""
    faq = faq_table(spark, sf_dir)
    seeded = index.seed_if_empty(faq.filter("false"), faq)
    return index.list_faq(index.seed_if_empty(seeded, faq.withColumn("answer", F.lit("late"))), enabled=True).select("entry_id", "answer")


@query("pushed_filters", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2') AND doc_id % 40 IN (2, 3, 5)")
def pushed_filters(spark, sf_dir):
    """The store-side predicate over written chunks: the scan itself tests it."""
    folder, paged = shared_folder(spark), doc_chunks(spark, sf_dir).withColumn("page", (F.col("doc_id") % 40).cast("int"))
    files.write_clustered(paged, folder, ["lang", "source", "page"], rows_per_file=paged.count() // 64 + 1)
    chunks = files.read_chunks(spark, folder)
    wanted = {"lang": ["en", " de "], "source": ["src1", "src2"], "page": ["2", 3, "5.0"], "unpromoted": ["x"]}
    return chunks.filter(filters.pushable_predicate(wanted, ["lang", "source", "page"])).select("doc_id")


@query("synonym_filters", "SELECT doc_id FROM documents WHERE (source IN ('src1', 'en') OR lang IN ('src1', 'en')) AND doc_id % 5 IN (1, 3)")
def synonym_filters(spark, sf_dir):
    """Department and owner department are one group; a title is met as a part of the flattened metadata."""
    rows = doc_chunks(spark, sf_dir).select("doc_id", "title", F.col("source").alias("department"), F.col("lang").alias("owner_department"))
    named = filters.filter_chunks(rows, {"department": ["SRC1 "], "owner_department": "en"})
    return filters.filter_chunks(named, {"subject": ["topic 1", "TOPIC 3"]}, text_fallback=True).select("doc_id")


@query("merged_filters", """
WITH b AS (SELECT item_id AS i FROM benchmark), r AS (
  SELECT i, 'lang' AS k, CASE WHEN i % 2 = 0 THEN 'en' ELSE 'fr' END AS v FROM b UNION ALL SELECT i, 'source', 's1' FROM b UNION ALL SELECT i, 'allowed_users', 'u1' FROM b UNION ALL
  SELECT i, 'allowed_departments', CASE WHEN i % 3 = 0 THEN 'hr,' ELSE '' END || 'src' || (i % 20) FROM b UNION ALL SELECT i, 'allowed_roles', 'user' FROM b UNION ALL SELECT i, 'project_ids', 'p' || i FROM b WHERE i % 4 = 0)
SELECT i AS query_id, k AS key, v AS "values", ['public', 'internal', 'sensitive', 'restricted'][i % 4 + 1] AS clearance_level FROM r""")
def merged_filters(spark, sf_dir):
    i = F.col("query_id")
    q = bench_questions(spark, sf_dir).withColumn("project_ids", F.when(i % 4 == 0, F.array(F.concat(F.lit("p"), i))))
    kind = "map<string,array<string>>"
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    made = lambda *pairs: F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))
    none = F.array().cast("array<string>")
    explicit = made(pair("lang", F.when(i % 2 == 0, F.array(F.lit("en"))).otherwise(none)), pair("allowed_departments", F.when(i % 3 == 0, F.array(F.lit("hr")))), pair("blank", none))
    intent = F.create_map(F.lit("lang"), F.array(F.lit("fr")), F.lit("source"), F.array(F.lit("s1"))).cast(kind)
    merged = filters.access_filters(q).withColumn("m", filters.merge_filters(explicit.cast(kind), intent, F.col("access")))
    return merged.select("query_id", "clearance_level", F.explode("m").alias("key", "v")).select("query_id", "key", F.array_join("v", ",").alias("values"), "clearance_level")


@query("deduped_words", r"""
WITH w AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) AS n FROM documents),
f AS (SELECT doc_id, n, trim(regexp_replace(w, '\s+', ' ', 'g')) AS w FROM w), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY n) AS k FROM f WHERE w <> ''),
t AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n FROM g WHERE k = 1)
SELECT d.doc_id, coalesce(string_agg(w, '|' ORDER BY n) FILTER (n <= 5), '') AS first_words FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id""")
def deduped_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return d.select("doc_id", F.array_join(T.dedupe_keep_order(words, 5), "|").alias("first_words"))


MODEL_RAW = ('Sure: {"query_scene": "policy_lookup", "need_hyde": true, "top_k_profile": "wrong", "metadata_intent": {"department": " d1 ", "x": " "}} done', "no object {here}", '{"preferred_retriever": "dense", "need_sub_queries": "false", "metadata_intent": {"y": "2"}}')


@query("model_signals", """
WITH u AS (SELECT conv_id || '-' || turn AS query_id, (conv_id + turn) % 3 AS k FROM conversations WHERE role = 'user')
SELECT query_id, CASE k WHEN 0 THEN 'policy_lookup' ELSE 'general_lookup' END AS query_scene, CASE k WHEN 2 THEN 'dense' ELSE 'hybrid' END AS preferred_retriever, 'balanced' AS top_k_profile, k = 0 AS need_hyde, k <> 2 AS need_sub_queries,
  CASE k WHEN 0 THEN 'department=d1' WHEN 1 THEN 'department=d0' ELSE 'department=d0;y=2' END AS intent FROM u""")
def model_signals(spark, sf_dir):
    """Signals overlaid by what a model wrote: an object in noise, no object, a plain object."""
    k = (F.col("conv_id") + F.col("turn")) % 3
    base = {"query_scene": F.lit("general_lookup"), "preferred_retriever": F.lit("hybrid"), "top_k_profile": F.lit("balanced"), "need_hyde": F.lit(False), "need_sub_queries": F.lit(True), "need_history_resolution": F.lit(False), "need_keyword_boost": F.lit(False)}
    s = user_turns(spark, sf_dir).withColumns(base | {"metadata_intent": F.create_map(F.lit("department"), F.lit("d0")), "raw": choose(k, *MODEL_RAW)})
    m = understand.merge_model_signals(s, "raw")
    pairs = F.array_sort(F.transform(F.map_entries("metadata_intent"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return m.select("query_id", "query_scene", "preferred_retriever", "top_k_profile", "need_hyde", "need_sub_queries", F.array_join(pairs, ";").alias("intent"))


PLAN_RAW = ('{"rewritten_query": " new  text. ", "keyword_queries": ["a", "A", " b ", "", "c", "d", "e"], "structured_filters": {"time": "t1", "line": ""}}', "none", 'x {"multi_queries": ["m1", "m2", "m3", "m4"], "hyde_query": "h"}')


@query("model_plans", """
WITH u AS (SELECT conv_id || '-' || turn AS query_id, (conv_id + turn) % 3 AS k FROM conversations WHERE role = 'user')
SELECT query_id, CASE k WHEN 0 THEN 'new text' ELSE 'old' END AS rewritten_query, CASE k WHEN 2 THEN 'h' ELSE '' END AS hyde_query, CASE k WHEN 0 THEN 'a|b|c|d' ELSE 'k' END AS keyword_queries, CASE k WHEN 2 THEN 'm1|m2|m3' ELSE 's' END AS sub_queries,
  CASE k WHEN 0 THEN 'shift=s;time=t1' ELSE 'shift=s' END AS filters FROM u""")
def model_plans(spark, sf_dir):
    k = (F.col("conv_id") + F.col("turn")) % 3
    one = lambda x: F.array(F.lit(x))
    base = {"rewritten_query": F.lit("old"), "hyde_query": F.lit(""), "keyword_queries": one("k"), "sub_queries": one("s"), "structured_filters": F.create_map(F.lit("shift"), F.lit("s")), "raw": choose(k, *PLAN_RAW)}
    m = understand.merge_model_plan(user_turns(spark, sf_dir).withColumns(base), "raw")
    pairs = F.array_sort(F.transform(F.map_entries("structured_filters"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return m.select("query_id", "rewritten_query", "hyde_query", F.array_join("keyword_queries", "|").alias("keyword_queries"), F.array_join("sub_queries", "|").alias("sub_queries"), F.array_join(pairs, ";").alias("filters"))


@query("hybrid_hits", f"""
WITH {BM25}, s5 AS (SELECT query_id, doc_id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, chunk_id AS doc_id, score FROM scored) JOIN documents USING (doc_id) WHERE lang = 'en' QUALIFY rank <= 5),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 6) AS score
  FROM embeddings q, embeddings c WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND c.vec_id % 3 <> 1), d7 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM p QUALIFY rank <= 7),
u AS (SELECT *, 'sparse' AS retriever FROM s5 UNION ALL SELECT *, 'dense' FROM d7)
SELECT query_id, chunk_id, retriever, rank, score FROM u""")
def hybrid_hits(spark, sf_dir):
    """Both retrievers with limits and permitted chunks of their own."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = bench_questions(spark, sf_dir).join(e.withColumnRenamed("chunk_id", "query_id"), "query_id")
    english = doc_chunks(spark, sf_dir).filter("lang = 'en'").select("chunk_id")
    asked = bench_questions(spark, sf_dir).join(q.select("query_id"), "query_id", "right")
    hits = search.hybrid_search(q, doc_index(spark, sf_dir), e, 5, 7, allowed_sparse=english, allowed_dense=e.filter("chunk_id % 3 <> 1").select("chunk_id"))
    return hits.join(asked.select("query_id"), "query_id", "left_semi").select("query_id", "chunk_id", "retriever", "rank", "score")


@query("request_budgets", "SELECT item_id AS query_id, least(2 * (item_id % 20 + 1), 30) AS top_k, 3 * (item_id % 20 + 1) AS fetched FROM benchmark")
def request_budgets(spark, sf_dir):
    k = F.col("item_id") % 20 + 1
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), search.request_budget(k).cast("long").alias("top_k"), search.overfetch(k).alias("fetched"))


@query("faq_fast_answers", "SELECT item_id AS query_id, item_id AS entry_id, 1.0::DOUBLE AS confidence, text AS answer FROM benchmark WHERE item_id % 5 <> 0")
def faq_fast_answers(spark, sf_dir):
    """Questions that name an entry's code are answered by it, if it is enabled."""
    coded = lambda df, key: df.withColumn("question", F.concat("question", F.lit(" E-"), (F.col(key) + 1000).cast("string")))
    got = search.faq_answer(coded(bench_questions(spark, sf_dir), "query_id"), coded(faq_table(spark, sf_dir), "entry_id"))
    return got.select("query_id", "entry_id", "confidence", "answer")


@query("fast_path", "SELECT item_id AS query_id, item_id % 2 = 0 AND item_id % 3 <> 0 AS eligible, true AS eligible_unsecured FROM benchmark")
def fast_path(spark, sf_dir):
    i = F.col("query_id")
    q = bench_questions(spark, sf_dir).select("query_id", F.lit("").alias("user_id"), F.when(i % 2 == 1, "hr").otherwise("").alias("department"), F.lit(None).cast("string").alias("role"), F.when(i % 3 == 0, F.array(F.lit("p"))).alias("project_ids"))
    return q.select("query_id", search.fast_path_eligible(q).alias("eligible"), search.fast_path_eligible(q, security_enabled=False).alias("eligible_unsecured"))


@query("annotated_hits", f"""
WITH {TWO} SELECT query_id, chunk_id, rank, retriever AS route_name, CASE WHEN retriever = 'sparse' THEN 'lexical' END AS route_kind, CASE WHEN retriever = 'sparse' THEN question END AS route_query, CASE WHEN retriever = 'sparse' THEN 1 END AS route_order FROM two JOIN q USING (query_id)""")
def annotated_hits(spark, sf_dir):
    """Routes known for one retriever only."""
    routes = bench_questions(spark, sf_dir).select("query_id", F.lit("sparse").alias("route_name"), F.lit("lexical").alias("route_kind"), F.col("question").alias("route_query"), F.lit(1).alias("route_order"))
    hits = two_lists(spark, sf_dir).withColumnRenamed("retriever", "route_name")
    return fuse.annotate(hits, routes).select("query_id", "chunk_id", "rank", "route_name", "route_kind", "route_query", "route_order")


@query("staged_answers", f"""
WITH {BM25}, h AS (SELECT DISTINCT query_id FROM hits WHERE query_id % 3 <> 0), s AS (SELECT item_id AS i, CASE WHEN item_id % 4 = 1 THEN 'clarify' WHEN h.query_id IS NULL THEN 'empty' ELSE 'ok' END AS stage FROM benchmark LEFT JOIN h ON h.query_id = item_id)
SELECT i AS query_id, stage, CASE stage WHEN 'clarify' THEN CASE WHEN i % 8 = 1 THEN 'which ' || i END END AS answer, CASE stage WHEN 'clarify' THEN 'need_clarify' WHEN 'empty' THEN CASE WHEN i % 6 = 0 THEN 'earlier' ELSE 'empty_retrieval' END END AS refusal_reason,
  CASE stage WHEN 'empty' THEN 'refusal' WHEN 'clarify' THEN 'refusal' ELSE CASE WHEN i % 5 = 0 THEN 'stored' WHEN i % 2 = 0 THEN 'grounded_answer_with_conflict' ELSE 'grounded_answer' END END AS answer_mode, stage <> 'ok' AS refusal FROM s""")
def staged_answers(spark, sf_dir):
    """Questions by stage: to be clarified, without hits, answered; each with its row."""
    i = F.col("query_id")
    q = bench_questions(spark, sf_dir).withColumns({
        "need_clarify": i % 4 == 1, "clarify_question": F.when(i % 8 == 1, F.concat(F.lit("which "), i)).otherwise(""), "clarify_reason": F.lit("slots"), "refusal_reason": F.when(i % 6 == 0, "earlier").otherwise(" "),
        "answer_mode": F.when(i % 5 == 0, " stored ").otherwise(""), "conflict_detected": i % 2 == 0,
    })
    hits = bm25_hits(spark, sf_dir).filter("query_id % 3 <> 0")
    parts = decide.split_stages(q, hits)
    asked = decide.clarify_response(parts["clarify"]).withColumns({"answer_mode": F.lit(""), "conflict_detected": F.lit(True)})
    asked = asked.select("query_id", F.lit("clarify").alias("stage"), F.when(i % 8 == 1, F.col("answer")).alias("answer"), "refusal_reason", "refusal", decide.answer_mode(asked).alias("answer_mode"))
    empty = decide.refuse_empty(parts["empty"], hits).select("query_id", F.lit("empty").alias("stage"), F.lit(None).cast("string").alias("answer"), "refusal_reason", "refusal", "answer_mode")
    ok = parts["ok"].withColumn("refusal", F.lit(False))
    ok = ok.select("query_id", F.lit("ok").alias("stage"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("refusal_reason"), "refusal", decide.answer_mode(ok).alias("answer_mode"))
    return asked.unionByName(empty).unionByName(ok)


@query("request_features", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE 0.0 END AS past_24h_query_count, CASE WHEN event_id % 3 = 0 THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS session_query_count, CASE WHEN event_id % 5 = 0 THEN 7.5::DOUBLE ELSE 60.0::DOUBLE END AS query_interval_sec, 0.0::DOUBLE AS top1_score, 1.0::DOUBLE AS source_count FROM events""")
def request_features(spark, sf_dir):
    """Flat names first, then nested groups, then defaults; what is no number counts as absent."""
    i = F.col("event_id")
    flat = F.create_map(F.lit("past_24h_query_count"), F.when(i % 2 == 0, F.col("value").cast("string")), F.lit("session_query_count"), F.lit("many"))
    session = F.create_map(F.lit("session_query_count"), F.when(i % 3 == 0, "4"), F.lit("query_interval_sec"), F.when(i % 5 == 0, "7.5"))
    q = table(spark, sf_dir, "events").withColumns({"flat": flat, "nested": F.create_map(F.lit("session"), session)})
    return risk.risk_features(q).select("event_id", "past_24h_query_count", "session_query_count", "query_interval_sec", "top1_score", "source_count")


@query("sample_features", """
SELECT event_id, user_id::DOUBLE AS past_24h_query_count, CASE WHEN event_id % 2 = 0 THEN value ELSE 60.0 END AS query_interval_sec, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS top1_score, 1.0::DOUBLE AS source_count FROM events""")
def sample_features(spark, sf_dir):
    """Nested samples to the twelve numeric features."""
    i = F.col("event_id")
    absent = {group: [n for n, (g, _) in risk.FEATURES.items() if g == group] for group in ("user_history", "session", "retrieval")}
    given = {"past_24h_query_count": F.col("user_id"), "query_interval_sec": F.when(i % 2 == 0, F.col("value")), "top1_score": F.when(i % 3 != 0, F.col("value"))}
    none = F.lit(None).cast("double")
    samples = table(spark, sf_dir, "events").select("event_id", *[F.struct(*[given.get(n, none).alias(n) for n in names]).alias(g) for g, names in absent.items()])
    return risk.numeric_features(samples).select("event_id", "past_24h_query_count", "query_interval_sec", "top1_score", "source_count")


@query("eval_report", """
SELECT doc_id AS query_id, text AS question, CASE WHEN doc_id % 3 = 0 THEN 'got ' || doc_id WHEN doc_id % 3 = 1 THEN 'ref' ELSE 'ref' END AS contexts, CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id END AS answer, doc_id % 4 = 0 AS boosted FROM documents""")
def eval_report(spark, sf_dir):
    """Dataset rows with results for some (with or without contexts) and signals for all."""
    i = F.col("query_id")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"), F.array(F.lit("ref")).alias("contexts"))
    none = F.array().cast("array<string>")
    results = d.select("query_id", F.when(i % 3 == 0, F.array(F.concat(F.lit("got "), i))).when(i % 3 == 1, none).alias("contexts"), F.when(i % 2 == 0, F.concat(F.lit("a"), i)).alias("answer"))
    out = evaluate.eval_report(d, results.filter("query_id % 3 < 2 or query_id % 2 = 0"), d.select("query_id", (i % 4 == 0).alias("boosted")))
    return out.select("query_id", "question", F.array_join("contexts", ",").alias("contexts"), "answer", "boosted")


@query("risk_levels", """
SELECT conv_id || '-' || turn AS query_id, CASE (conv_id + turn) % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'low' END AS risk_level, CASE (conv_id + turn) % 5 WHEN 0 THEN 'deny' WHEN 1 THEN 'local_only' WHEN 2 THEN 'deny' WHEN 3 THEN 'minimize' ELSE 'redact' END AS risk_action,
  CASE (conv_id + turn) % 5 WHEN 0 THEN 'bulk_sensitive_export_request' WHEN 1 THEN 'restricted_data_local_only' WHEN 2 THEN 'risk_engine_error' WHEN 3 THEN 'sensitive_context_minimized' ELSE 'internal_context_redacted' END AS risk_reason FROM conversations WHERE role = 'user'""")
def risk_levels(spark, sf_dir):
    """Word levels, the decision cascade, and rows whose decision failed."""
    k = (F.col("conv_id") + F.col("turn")) % 5
    q = user_turns(spark, sf_dir).withColumns({"question": F.concat("question", choose(k, " 导出全部 工资", " 审批", " 薪酬", "", "")), "data_classification": choose(k, "public", "restricted", "public", "sensitive", "unknown")})
    q = q.withColumn("word_level", risk.query_risk(F.col("question")))
    decided = risk.risk_decision(q).withColumn("risk_action", F.when(k != 2, F.col("risk_action")))
    return risk.fail_open(decided, allow=False).select("query_id", F.col("word_level").alias("risk_level"), "risk_action", "risk_reason")


@query("text_files", f"""
WITH l AS (SELECT lang, {FOLD.format("coalesce(text, '')")} AS line FROM documents WHERE lang IS NOT NULL)
SELECT lang, 'text/markdown' AS mime_type, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL""")
def text_files(spark, sf_dir):
    """Documents as lines of text files, a folder for each language, read again as whole files; none has over a thousand lines."""
    folder = shared_folder(spark)
    d = table(spark, sf_dir, "documents").filter("lang is not null")
    d.select(T.fold_ws(F.coalesce("text", F.lit(""))).alias("value"), "lang").write.partitionBy("lang").option("maxRecordsPerFile", 1_000).text(folder)
    docs = files.read_text_documents(spark, f"{folder}/lang=*/*.txt", "text/markdown")
    lines = docs.select(F.regexp_extract("source", "lang=([^/]*)/", 1).alias("lang"), "mime_type", F.explode(F.split("content", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("lang", "mime_type", "line").agg(F.count("*").alias("n"))


@query("coerced_flags", """
SELECT doc_id, doc_id % 6 IN (0, 1, 2) AS flag, CASE WHEN doc_id % 2 = 0 THEN 'a|' || lang ELSE '' END AS tags, source AS listed FROM documents""")
def coerced_flags(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", choose(i % 6, " YES ", "1", "True", "no", "0", "").alias("raw"), F.when(i % 2 == 0, F.concat(F.lit(" a ,, "), "lang")).alias("tags"))
    d = d.withColumn("raw", F.when(i % 6 != 5, F.col("raw")))
    listed = evaluate.norm_tags(F.array(F.lit(" "), "source"), is_text=False)
    return d.select("doc_id", evaluate.to_bool(F.col("raw")).alias("flag"), F.array_join(evaluate.norm_tags(F.col("tags")), "|").alias("tags"), F.array_join(listed, "|").alias("listed"))


@query("page_marked_chunks", """
WITH d AS (SELECT doc_id, left(doc_id::VARCHAR, 8) AS s, trim(left(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), 700)) AS t FROM documents),
p AS (SELECT doc_id, s, unnest([2, 5, 9]) AS page, unnest([t, t || ' again', 'end of ' || doc_id || repeat(' and so on', 8)]) AS c FROM d),
k AS (SELECT *, length(c) + 17 >= 80 AS long_enough FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS i FROM k WHERE c <> '' AND long_enough),
x AS (SELECT *, 'p-' || s || '-' || i || '-' || left(sha256('p:' || doc_id || ':' || i || ':' || left(c, 200)), 16) AS pid FROM n)
SELECT doc_id::VARCHAR AS doc_id, pid AS chunk_id, 'parent' AS chunk_level, page, '第' || page || '页' AS section, c AS content FROM x UNION ALL
SELECT doc_id::VARCHAR, 'c-' || s || '-' || i || '-' || left(sha256('c:' || doc_id || ':' || i || ':' || left(pid || ':' || c, 200)), 16), 'child', page, '第' || page || '页', c FROM x""")
def page_marked_chunks(spark, sf_dir):
    """Documents of three marked pages, each short enough to be one piece."""
    i, t = F.col("doc_id").cast("string"), F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), 1, 700)
    mark = lambda n: F.lit(f"<!-- page:{n} -->\n\n")  # noqa: E731  a page's 17 characters before its text, as the SQL counts them
    body = F.concat(mark(2), t, F.lit("\n"), mark(5), F.btrim(t), F.lit(" again\n"), mark(9), F.lit("end of "), i, F.lit(" and so on" * 8))
    docs = table(spark, sf_dir, "documents").select(i.alias("doc_id"), F.lit("s.pdf").alias("source"), F.lit("t").alias("title"), body.alias("content"), F.lit("pdf").alias("doc_type"), F.lit("").alias("mime_type"))
    return chunk.build_chunks(docs).select("doc_id", "chunk_id", "chunk_level", "page", "section", "content")
