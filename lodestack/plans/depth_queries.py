"""Driver queries whose inputs make each rule go both ways: fusion policies, closed gates, refusals, passage routes, dense routes,
vector values, FAQ confidence, pruned lexical search, and event streams with late rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import blockmax, chunk, decide, fuse, index, search, trainsets, understand
from lodestack.plans.queries import _STORED, BM25, FOLD, TOKENS, TWO, bench_questions, bm25_hits, doc_chunks, doc_index, faq_table, query, shared_folder, table, two_lists
from lodestack.streaming import audit, tables


@query("level_topk", f"WITH {BM25} SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM hits")
def level_topk(spark, sf_dir):
    """The ranks of the full search from the levels that can matter."""
    key, plain = (spark.sparkContext.applicationId, sf_dir, "levels"), doc_index(spark, sf_dir)
    if key not in _STORED:
        folder = shared_folder(spark)
        blockmax.LevelIndex.build(plain, folder)
        _STORED[key] = folder
    stored = blockmax.LevelIndex.load(plain, _STORED[key])
    return blockmax.level_search(bench_questions(spark, sf_dir), stored, 10).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def scene_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = bench_questions(spark, sf_dir).withColumn("query_scene", F.when(F.col("query_id") % 2 == 1, "policy_lookup").otherwise(" general_lookup "))
    return fuse.fusion_policy(q, ("policy_lookup",), fuse.parse_scene_weights("policy_lookup:0.65, general_lookup:7,bad,x:y"))


@query("policy_fusion", f"""
WITH {TWO} SELECT query_id, chunk_id, round(score, 6) AS score, rank, 'rrf' AS fusion, 1.0::DOUBLE AS sparse_weight FROM rrfk WHERE query_id % 2 = 0
UNION ALL SELECT query_id, chunk_id, round(score, 6), rank, 'weighted', 0.65::DOUBLE FROM wfk WHERE query_id % 2 = 1""")
def policy_fusion(spark, sf_dir):
    """Fused scores and ranks of each question by its scene's policy; a weight over 1 counts as 1."""
    policies = scene_policies(spark, sf_dir)
    fused = fuse.fuse(two_lists(spark, sf_dir), policies).join(policies.select("query_id", "sparse_weight"), "query_id")
    return fused.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "fusion", "sparse_weight")


@query("closed_gates", f"""
WITH {TWO}, kept AS (SELECT * FROM scaled WHERE query_id % 8 <> 2 AND NOT (query_id % 4 = 1 AND retriever = 'sparse')),
one AS (SELECT query_id, chunk_id, CASE query_id % 2 WHEN 0 THEN round(sum(1.0::DOUBLE / (60 + rank)), 9) ELSE round(sum(CASE retriever WHEN 'sparse' THEN 0.65 ELSE 0.35 END * part), 9) END AS s FROM kept GROUP BY 1, 2),
b AS (SELECT query_id, max(s) AS best FROM one GROUP BY 1)
SELECT item_id AS query_id, round(best, 6) AS best, coalesce(best IS NOT NULL AND (item_id % 2 = 0 OR best >= 0.5), false) AS actionable FROM benchmark LEFT JOIN b ON query_id = item_id""")
def closed_gates(spark, sf_dir):
    """Some questions without hits, some with the weaker retriever's only, under a gate of one half."""
    hits = two_lists(spark, sf_dir).filter("query_id % 8 <> 2 and not (query_id % 4 = 1 and retriever = 'sparse')")
    policies = scene_policies(spark, sf_dir)
    return fuse.fusion_gate(fuse.fuse(hits, policies), policies, 0.5).select("query_id", F.round("best", 6).alias("best"), "actionable")


@query("grounding_refusals", f"""
WITH {BM25}, g AS (SELECT query_id, list(chunk_id::varchar ORDER BY rank) AS ids FROM hits GROUP BY query_id),
a AS (SELECT item_id AS i, ids, CASE WHEN item_id % 6 = 1 OR ids IS NULL THEN [] WHEN item_id % 6 = 2 THEN ids[1:2] || ['none'] ELSE ids[1:1 + item_id % 3] END AS cited, CASE WHEN item_id % 6 = 5 THEN 0.0::DOUBLE ELSE round(0.1 * (item_id % 10), 1)::DOUBLE END AS c, item_id % 6 = 4 AS was FROM benchmark LEFT JOIN g ON query_id = item_id),
s AS (SELECT *, NOT was AND len(cited) = 0 AS uncited, len(list_filter(cited, lambda x: NOT coalesce(list_contains(ids, x), false))) > 0 AS unknown FROM a),
t AS (SELECT *, CASE WHEN unknown THEN least(0.2::DOUBLE, CASE WHEN uncited THEN least(c, 0.25::DOUBLE) ELSE c END) WHEN uncited THEN least(c, 0.25::DOUBLE) ELSE c END AS conf FROM s),
u AS (SELECT *, NOT was AND NOT uncited AND conf < 0.35 AS low FROM t)
SELECT i AS query_id, NOT (uncited OR unknown OR low) AS grounding_ok, round(conf, 6) AS confidence, was OR uncited OR low AS refusal, CASE WHEN was THEN 'earlier' WHEN uncited OR low THEN 'low_confidence' ELSE '' END AS refusal_reason,
  round(CASE WHEN ids IS NULL THEN 0 ELSE len(list_filter(list_distinct(cited), lambda x: list_contains(ids, x)))::DOUBLE / len(ids) END, 6) AS coverage FROM u""")
def grounding_refusals(spark, sf_dir):
    """Answers that cite some of their hits, none, or a chunk that was not retrieved, with confidences of all sizes."""
    from lodestack.operators.context import citation_coverage

    none, i = F.array().cast("array<string>"), F.col("query_id")
    got = bm25_hits(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("c")))).alias("h"))
    q = bench_questions(spark, sf_dir).select("query_id").join(got.select("query_id", F.col("h.c").alias("retrieved_chunk_ids")), "query_id", "left")
    ids = F.coalesce("retrieved_chunk_ids", none)
    cited = F.when((i % 6 == 1) | (F.size(ids) == 0), none).when(i % 6 == 2, F.concat(F.slice(ids, 1, 2), F.array(F.lit("none")))).otherwise(F.slice(ids, F.lit(1), (i % 3 + 1).cast("int")))
    a = q.withColumns({"cited_chunk_ids": cited, "confidence": F.when(i % 6 == 5, F.lit(None)).otherwise(F.round(0.1 * (i % 10), 1)), "refusal": i % 6 == 4, "refusal_reason": F.when(i % 6 == 4, " earlier ")})
    out = decide.validate_grounding(a)
    return out.select("query_id", "grounding_ok", F.round("confidence", 6).alias("confidence"), "refusal", "refusal_reason", F.round(citation_coverage(F.col("cited_chunk_ids"), ids), 6).alias("coverage"))


EDGE_SQL = "' ' || chr(10) || chr(9) || ',.;，。；：'"
PASSAGE = f"CASE WHEN query_id % 2 = 0 THEN trim('{understand.PASSAGE_HEAD}' || trim(question, {EDGE_SQL}), {EDGE_SQL}) ELSE '' END"


@query("hyde_routes", f"""
WITH q AS (SELECT item_id AS query_id, {FOLD.format('text')} AS question FROM benchmark), h AS (SELECT query_id, {PASSAGE} AS hyde FROM q)
SELECT query_id, hyde AS hyde_query, CASE WHEN hyde <> '' AND query_id % 3 = 0 THEN 'hyde' END AS route_kind, CASE WHEN hyde <> '' AND query_id % 3 = 0 THEN CASE WHEN query_id % 4 = 2 THEN 7 ELSE 15 END END AS dense_k FROM h""")
def hyde_routes(spark, sf_dir):
    """Questions that need a hypothetical passage, over whole items, and the routes that it gets with a broad profile."""
    i, f = F.col("query_id"), F.lit(False)
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.fold_ws(F.col("text")).alias("question"))
    signals = q.withColumns({"resolved_query": F.lit(""), "likely_structured_lookup": f, "has_precise_identifier": f, "need_keyword_boost": f, "need_sub_queries": f, "need_hyde": i % 2 == 0})
    plans = understand.query_plan(signals).withColumns({"top_k_profile": choose(i % 3, "broad", "balanced", "precise"), "preferred_retriever": choose(i % 4, "hybrid", "hybrid", "sparse", "hybrid")})
    routes = search.route_top_k(search.prune_routes(search.build_routes(plans))).filter("route_kind = 'hyde'")
    return plans.select("query_id", "hyde_query").join(routes.select("query_id", "route_kind", "dense_k"), "query_id", "left")


def choose(value: Column, *options: str) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (value + 1).cast("int"))


def md5_hash(token: Column) -> Column:
    """A token's hash that SQL engines can repeat."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")


#: Vectors of the offline encoder, from (key, text) rows ``t``: a row for each dimension that isn't zero.
VECTORS = f"""
SELECT key, ('0x' || left(md5(token), 8))::BIGINT AS h FROM (SELECT key, unnest({TOKENS.format("coalesce(text, '')")}) AS token FROM t)"""
VALUES = """
SELECT key, d, (v / sqrt(sum(v * v) OVER (PARTITION BY key)))::FLOAT::DOUBLE AS x FROM (SELECT key, h % 256 AS d, sum(CASE WHEN (h >> 20) % 2 = 0 THEN 1.0::DOUBLE ELSE -1 END) AS v FROM hashed GROUP BY key, h % 256) WHERE v <> 0"""


@query("encoded_values", f"""
WITH t AS (SELECT doc_id AS key, text FROM documents), hashed AS ({VECTORS}) SELECT key AS chunk_id, d AS dim, round(x, 4) AS value FROM ({VALUES})""")
def encoded_values(spark, sf_dir):
    """Stored chunks encoded again: every value of every vector."""
    made = index.rebuild_vectors(doc_chunks(spark, sf_dir), search.hashing_encoder(hash=md5_hash))
    return made.select("chunk_id", F.posexplode("embedding").alias("dim", "x")).filter("x <> 0").select("chunk_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 4).alias("value"))


@query("dense_routes", f"""
WITH {BM25}, t AS (SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'q' || query_id || CASE k WHEN 0 THEN '#0' ELSE '#1' END, CASE k WHEN 0 THEN question ELSE array_to_string(string_split(question, ' ')[1:6], ' ') END FROM q, range(2) r(k)),
hashed AS ({VECTORS}), x AS ({VALUES}), n AS (SELECT key, sqrt(sum(x * x)) AS n FROM x GROUP BY key),
pairs AS (SELECT a.key AS r, b.key AS c, sum(a.x * b.x) AS dot FROM x a JOIN x b ON a.d = b.d AND a.key[1] = 'q' AND b.key[1] = 'd' GROUP BY 1, 2),
every AS (SELECT a.key AS r, b.key AS c, coalesce(dot / (a.n * b.n), 0) AS s FROM n a JOIN n b ON a.key[1] = 'q' AND b.key[1] = 'd' LEFT JOIN pairs ON r = a.key AND c = b.key),
ranked AS (SELECT string_split(r[2:], '#')[1]::BIGINT AS query_id, string_split(r[2:], '#')[2]::INTEGER AS route_order, c[2:]::BIGINT AS chunk_id, round(s, 6) AS s, row_number() OVER (PARTITION BY r ORDER BY round(s, 6) DESC, c[2:]::BIGINT) AS rank FROM every)
SELECT query_id, route_order, CASE route_order WHEN 0 THEN 'original_query' ELSE 'rewritten_query' END AS route_kind, chunk_id, s AS score, rank FROM ranked
WHERE rank <= CASE query_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 30 END AND (route_order = 0 OR query_id % 4 <> 0 OR query_id % 3 <> 0)""")
def dense_routes(spark, sf_dir):
    """The dense side of a route table: the question and its first six words, with limits by profile, some routes without it."""
    i = F.col("query_id")
    asked = bench_questions(spark, sf_dir).select(
        "query_id", "question", F.lit("").alias("resolved_query"), F.array_join(F.slice(F.split("question", " "), 1, 6), " ").alias("rewritten_query"), F.array().cast("array<string>").alias("sub_queries"), F.array().cast("array<string>").alias("keyword_queries"), F.lit("").alias("hyde_query"),
        choose(i % 3, "precise", "balanced", "broad").alias("top_k_profile"), F.when((i % 4 == 0) & (i % 3 == 0), "sparse").otherwise("hybrid").alias("preferred_retriever"),
    )
    routes = search.route_top_k(search.prune_routes(search.build_routes(asked))).withColumn("dense_k", F.when(i % 3 == 0, 10).otherwise(F.col("dense_k")))
    encoder = search.hashing_encoder(hash=md5_hash)
    vectors = search.encode(doc_chunks(spark, sf_dir).select("chunk_id", "content"), encoder).select("chunk_id", "embedding")
    hits = search.run_routes(routes, doc_index(spark, sf_dir), vectors, encoder).filter("retriever = 'dense'")
    return hits.select("query_id", "route_order", "route_kind", "chunk_id", "score", "rank")


FAQ_TEXT = "(SELECT item_id AS doc_id, array_to_string(string_split({0}, ' ')[1:12], ' ') || chr(10) || text[1:256] AS text FROM benchmark WHERE item_id % 5 <> 0)".format(FOLD.format("text"))
ASKED = "array_to_string(string_split({0}, ' ')[1:5 + item_id % 6], ' ') || CASE item_id % 4 WHEN 0 THEN ' ωωω' WHEN 1 THEN ' 777' || (item_id % 7) ELSE '' END".format(FOLD.format("text"))
FAQ_BM25 = BM25.replace("FROM documents)", f"FROM {FAQ_TEXT})", 1).replace(f"array_to_string(list_slice(string_split({FOLD.format('text')}, ' '), 1, 12), ' ') AS question", f"{ASKED} AS question", 1)


@query("faq_confidence", f"""
WITH {FAQ_BM25}, own AS (SELECT h.query_id, h.score, h.rank, q.question, array_to_string(string_split({FOLD.format('b.text')}, ' ')[1:12], ' ') AS f, f || chr(10) || b.text[1:256] AS stored FROM hits h JOIN q USING (query_id) JOIN benchmark b ON b.item_id = h.query_id WHERE h.query_id = h.chunk_id AND h.rank <= 3),
m AS (SELECT *, list_distinct({TOKENS.format('question')}) AS a, list_distinct({TOKENS.format('stored')}) AS s, len(question) - CASE query_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 0 END AS same FROM own)
SELECT query_id, rank, round(0.35 * len(list_filter(a, lambda x: list_contains(s, x))) / len(a) + 0.20 * score / (score + 1.5) + 0.25 * 2 * same / (len(question) + len(f)), 6) AS confidence FROM m""")
def faq_confidence(spark, sf_dir):
    """Questions that begin like an entry and break off, some with a word or a number that no entry has."""
    i, b = F.col("query_id"), table(spark, sf_dir, "benchmark")
    words = F.slice(F.split(T.fold_ws(F.col("text")), " "), F.lit(1), (F.col("item_id") % 6 + 5).cast("int"))
    q = b.select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("question"))
    more = F.when(i % 4 == 0, " ωωω").when(i % 4 == 1, F.concat(F.lit(" 777"), (i % 7).cast("string"))).otherwise("")
    found = search.faq_search(q.withColumn("question", F.concat("question", more)), faq_table(spark, sf_dir))
    return found.filter("entry_id = query_id").select("query_id", "rank", "confidence")


# Event streams: rows arrive up to an hour late, some five days, in four deliveries.

ARRIVALS = """
b AS (SELECT min(epoch_us(ts)) AS first, (max(epoch_us(ts)) - min(epoch_us(ts))) // 4 + 1 AS quarter FROM events),
e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, least(3, (epoch_us(ts) + CASE WHEN event_id % 50 = 7 THEN 432000000000 ELSE event_id % 60 * 60000000 END - first) // quarter) AS step FROM events, b),
w AS (SELECT s.k, (SELECT max(t) FROM e WHERE step < s.k) - 3600000000 AS mark FROM range(5) s(k))
"""


def deliveries(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    ends = e.agg(F.min("t"), F.max("t")).first()
    quarter = ((ends[1] or 0) - (ends[0] or 0)) // 4 + 1
    late = F.when(F.col("event_id") % 50 == 7, 432_000_000_000).otherwise(F.col("event_id") % 60 * 60_000_000)
    step = F.least(F.lit(3), F.floor((F.col("t") + late - F.lit(ends[0] or 0)) / quarter))
    rows = e.withColumn("step", step).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "step")
    return [rows.filter(F.col("step") == k).drop("step") for k in range(4)]


def drained(spark: SparkSession, parts: list[DataFrame], stream, folder: str | None = None) -> DataFrame:
    """What a stream has put out after each of ``parts`` was delivered and worked off, state and watermark kept between them."""
    folder = folder or shared_folder(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        run = stream(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("behaviour_windows", f"""
WITH {ARRIVALS}, x AS (SELECT user_id, event_type, (t // 43200000000 - k) * 43200000000 AS start, step FROM e, range(2) r(k))
SELECT user_id, start AS window_start, start + 86400000000 AS window_end, count(*) AS query_count, count(*) FILTER (event_type = 'error') AS failed_count FROM x JOIN w ON w.k = x.step
WHERE (mark IS NULL OR start + 86400000000 > mark) AND start + 86400000000 <= (SELECT mark FROM w WHERE k = 4) GROUP BY 1, 2, 3""")
def behaviour_windows(spark, sf_dir):
    """Sliding counts of a stream that closes windows by its watermark; rows for a closed window are dropped."""
    out = drained(spark, deliveries(spark, sf_dir), audit.behaviour_stream)
    return out.select("user_id", F.unix_micros("window_start").alias("window_start"), F.unix_micros("window_end").alias("window_end"), "query_count", "failed_count")


@query("session_windows", f"""
WITH {ARRIVALS}, x AS (SELECT user_id, t FROM e JOIN w ON w.k = e.step WHERE mark IS NULL OR t + 1800000000 > mark),
n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 1800000000 THEN 0 ELSE 1 END AS new FROM x), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS no FROM n)
SELECT user_id, min(t) AS session_start, max(t) + 1800000000 AS session_end, count(*) AS session_query_count FROM s GROUP BY user_id, no HAVING max(t) + 1800000000 <= (SELECT mark FROM w WHERE k = 4)""")
def session_windows(spark, sf_dir):
    """Sessions of the same stream; those that a late row has joined are made one, and aren't over while a part is still open."""
    folder = shared_folder(spark)
    out = drained(spark, deliveries(spark, sf_dir), audit.session_stream, folder)
    out = audit.joined_sessions(out, audit.open_sessions(spark, f"{folder}/state"))
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "session_query_count")


def kept_up(spark: SparkSession, parts: list[DataFrame], stream, key: str) -> DataFrame:
    """A table of ``tables.start_table`` after all of ``parts`` were delivered, each in its turn."""
    folder = shared_folder(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        tables.start_table(stream(source), f"{folder}/out", f"{folder}/state").awaitTermination()
    return tables.read_table(spark, f"{folder}/out", key)


@query("streamed_hits", f"WITH {ARRIVALS} SELECT user_id AS entry_id, count(*) AS hit_count, max(t) AS last_hit_at FROM e JOIN w ON w.k = e.step WHERE mark IS NULL OR t > mark GROUP BY user_id")
def streamed_hits(spark, sf_dir):
    """FAQ hits as a stream in which a third of each delivery comes again with the next one."""
    rows = [p.select(F.col("event_id").alias("hit_id"), F.col("user_id").alias("entry_id"), F.col("ts").alias("hit_at")) for p in deliveries(spark, sf_dir)]
    parts = [rows[0], *[now.union(before.filter("hit_id % 3 = 0")) for before, now in zip(rows, rows[1:])]]
    return kept_up(spark, parts, tables.hit_counts, "entry_id").select("entry_id", "hit_count", F.unix_micros("last_hit_at").alias("last_hit_at"))


@query("streamed_cache", f"""
WITH {ARRIVALS}, n AS (SELECT lower(event_type) || ' ' || user_id AS q, max(t) AS t, max_by(event_id, t) AS event_id, any_value(user_id % 20 + 1) AS days FROM e GROUP BY 1)
SELECT 'answer:' || left(sha256(q), 24) AS key, 'answer ' || event_id AS answer, t AS written_at FROM n WHERE (t // 1000 + days * 86400000) > (SELECT mark // 1000 FROM w WHERE k = 4)""")
def streamed_cache(spark, sf_dir):
    """Answers written by a stream: the newest of each folded question, as long as its time isn't over."""
    rows = [p.select(F.concat(F.lit(" "), F.upper("event_type"), F.lit("  "), F.col("user_id")).alias("question"), F.concat(F.lit("answer "), F.col("event_id")).alias("answer"), F.lit(0.9).alias("confidence"), F.col("ts").alias("written_at"), ((F.col("user_id") % 20 + 1) * 86_400).alias("ttl_sec")) for p in deliveries(spark, sf_dir)]
    return kept_up(spark, rows, tables.cache_entries, "key").filter("live").select("key", "answer", F.unix_micros("written_at").alias("written_at"))


LONG_WORDS = "SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{8,}'))) AS alias FROM benchmark"


@query("document_aliases", f"""
WITH a AS ({LONG_WORDS}), h AS (SELECT doc_id, alias[1:4] AS canonical, strpos(text, alias) AS pos, length(alias) AS n FROM documents JOIN a ON contains(text, alias)),
g AS (SELECT doc_id, canonical, count(*) AS c, min(pos) AS pos, max(n) AS n FROM h GROUP BY 1, 2)
SELECT doc_id AS query_id, canonical FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, pos, n DESC, canonical DESC) = 1""")
def document_aliases(spark, sf_dir):
    """Every whole document against all long words of the benchmark, named by their first four letters."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("alias")).distinct()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    return understand.match_alias_table(docs, words.select(F.substring("alias", 1, 4).alias("canonical"), "alias"))


# Rules of chunks, training rows and requests, each met and not met.

SECTIONS = ("适用范围", "岗位职责", "处置流程", "例外", "附录一", "术语", "Notes", "")
SAID = ("plain", "联系人 Li", "version: 2", "存在隐患", "现行 电话", "")


@query("chunk_rules", f"""
WITH c AS (SELECT doc_id, {list(SECTIONS)}[doc_id % 8 + 1] AS section, {list(SAID)}[doc_id % 6 + 1] || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '- step' || chr(10) ELSE '' END || coalesce(text, '') AS content, CASE WHEN doc_id % 9 = 0 THEN '风险 / ' || lang ELSE lang END AS path, CASE WHEN doc_id % 10 = 0 THEN '邮箱' ELSE '' END AS title FROM documents),
n AS (SELECT *, section || chr(10) || left(content, 200) AS head, path || chr(10) || title || chr(10) || left(content, 500) || chr(10) || 'version: effective_date: expiry_date: status: version_status:' AS near FROM c)
SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(head, '{p}') THEN '{v}'" for p, v in chunk.SECTION_RULES)} ELSE 'general' END AS section_type, contains(content, '|') OR contains(content, chr(9)) AS contains_table,
  regexp_matches(content, '{chunk.STEPS}') AS contains_steps, regexp_matches(near, '{chunk.CONTACT}') AS contains_contact, regexp_matches(near, '{chunk.RISK_SIGNAL}') AS contains_risk_signal FROM n""")
def chunk_rules(spark, sf_dir):
    """Documents under sections of all six kinds and others, with and without each sign."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", choose(i % 8, *SECTIONS).alias("section"), F.concat(choose(i % 6, *SAID), F.lit("\n"), F.when(i % 5 == 0, "- step\n").otherwise(""), F.coalesce("text", F.lit(""))).alias("content"),
        F.when(i % 9 == 0, F.concat(F.lit("风险 / "), "lang")).otherwise(F.col("lang")).alias("section_path"), F.when(i % 10 == 0, "邮箱").otherwise("").alias("title"),
    )
    return chunk.chunk_flags(rows).select("doc_id", "section_type", "contains_table", "contains_steps", "contains_contact", "contains_risk_signal")


FLAWED = """
t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'q  ' || doc_id % 50 END AS query, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang || ' ' || doc_id % 13 END AS positive, CASE WHEN doc_id % 10 <> 0 THEN source END AS negative,
  CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 6 = 0 THEN [lang || ' ' || doc_id % 13, ' ', lang] ELSE [lang || ' n', NULL] END END AS negatives, lang FROM documents),
r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'q ' || doc_id % 50 END AS q, coalesce(positive, '') AS p, list_filter([negative] || coalesce(negatives, []), lambda x: trim(coalesce(x, '')) <> '') AS n, lang FROM t),
v AS (SELECT *, q <> '' AND p <> '' AND len(n) > 0 AS ok FROM r)
"""


def flawed_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets of which some lack a question, a positive or all negatives, and some have their positive among these."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    positive = F.concat_ws(" ", "lang", (i % 13).cast("string"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 7 == 0, " ").otherwise(F.concat(F.lit("q  "), i % 50)).alias("query"), F.when(i % 11 != 0, positive).alias("positive"), F.when(i % 10 != 0, F.col("source")).alias("negative"),
        F.when(i % 5 != 0, F.when(i % 6 == 0, F.array(positive, F.lit(" "), "lang")).otherwise(F.array(F.concat("lang", F.lit(" n")), none))).alias("negatives"),
        F.when(i % 3 == 0, F.col("lang")).alias("scenario"), F.when(i % 4 == 0, F.array("lang")).alias("tags"), F.when(i % 2 == 0, "report").otherwise(" ").alias("source"),
    )


@query("flawed_report", f"""
WITH {FLAWED} SELECT count(*) AS total_rows, count(*) FILTER (ok) AS valid_rows, count(*) FILTER (NOT ok) AS invalid_rows, count(*) FILTER (ok AND list_contains(n, p)) AS positive_is_negative_rows,
  count(*) FILTER (ok) - count(DISTINCT q || chr(1) || p || chr(1) || array_to_string(list_sort(list_distinct(n)), chr(2))) FILTER (ok) AS duplicate_triplet_rows, count(DISTINCT q) FILTER (ok) AS unique_queries,
  count(*) FILTER (ok AND doc_id % 3 = 0) AS rows_with_scenario, count(*) FILTER (ok AND doc_id % 4 = 0) AS rows_with_tags, count(*) FILTER (ok AND doc_id % 2 = 0) AS rows_with_source FROM v""")
def flawed_report(spark, sf_dir):
    return trainsets.triplet_report(flawed_triplets(spark, sf_dir)).drop("avg_query_chars", "avg_positive_chars", "avg_negative_chars")


@query("rejected_rows", f"WITH {FLAWED} SELECT doc_id, 'rejected' AS verdict, NULL::BIGINT AS label, NULL::VARCHAR AS text FROM v WHERE NOT ok UNION ALL SELECT NULL, 'pair', 1, p FROM v WHERE ok UNION ALL SELECT NULL, 'pair', 0, x FROM (SELECT unnest(n) AS x FROM v WHERE ok)")
def rejected_rows(spark, sf_dir):
    """Both sides of the pairwise expansion: the pairs, and the rows that make none."""
    pairs, rejected = trainsets.pairwise(flawed_triplets(spark, sf_dir))
    label = lambda v, kind: F.lit(v).cast(kind)
    bad = rejected.select("doc_id", F.lit("rejected").alias("verdict"), label(None, "long").alias("label"), label(None, "string").alias("text"))
    return bad.union(pairs.select(label(None, "long").alias("doc_id"), F.lit("pair").alias("verdict"), F.col("label").cast("long").alias("label"), "text"))


@query("grounded_shares", """
WITH m AS (SELECT doc_id, lang, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'Evidence found: ' || lang ELSE 'asked ' || doc_id % 20 END AS u, CASE WHEN doc_id % 8 = 0 THEN ' ' ELSE 'said ' || doc_id % 6 END AS a FROM documents),
v AS (SELECT *, u <> '' AND a <> ' ' AS ok FROM m)
SELECT count(*) AS total_rows, count(*) FILTER (ok) AS valid_rows, count(*) FILTER (ok) - count(DISTINCT u || chr(1) || a) FILTER (ok) AS duplicate_rows, round(count(*) FILTER (ok AND contains(u, 'Evidence found:'))::DOUBLE / nullif(count(*) FILTER (ok), 0), 4) AS grounded_ratio,
  round(count(*) FILTER (ok AND doc_id % 5 = 0)::DOUBLE / nullif(count(*) FILTER (ok), 0), 4) AS refusal_ratio FROM v""")
def grounded_shares(spark, sf_dir):
    """Chat rows of which some have no question, no answer or no evidence."""
    i = F.col("doc_id")
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    user = F.when(i % 9 == 0, "").when(i % 3 == 0, F.concat(F.lit("Evidence found:  "), "lang")).otherwise(F.concat(F.lit("asked "), i % 20))
    rows = table(spark, sf_dir, "documents").select(F.array(said("system", F.lit("s")), said("user", user), said("assistant", F.when(i % 8 == 0, " ").otherwise(F.concat(F.lit("said "), i % 6)))).alias("messages"), (i % 5 == 0).alias("refusal"), F.lit(None).cast("boolean").alias("conflict_detected"))
    return trainsets.sft_report(rows).select("total_rows", "valid_rows", "duplicate_rows", "grounded_ratio", "refusal_ratio")


@query("page_window_chunks", r"""
WITH d AS (SELECT doc_id, left(doc_id::VARCHAR, 8) AS s, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
p AS (SELECT doc_id, s, unnest([2, 5]) AS page, '<!-- page:' || unnest([2, 5]) || ' -->' || chr(10) || unnest([t, t || ' again']) AS b FROM d),
w AS (SELECT doc_id, s, page, unnest(CASE WHEN length(b) <= 1800 THEN [b] ELSE list_transform(range(ceil((length(b) - 180) / 1620.0)::BIGINT), lambda i: b[i * 1620 + 1 : i * 1620 + 1800]) END) AS raw, generate_subscripts(CASE WHEN length(b) <= 1800 THEN [b] ELSE range(ceil((length(b) - 180) / 1620.0)::BIGINT)::VARCHAR[] END, 1) AS n FROM p),
k AS (SELECT doc_id, s, page, n, trim(CASE WHEN n = 1 THEN regexp_replace(raw, '^<!-- page:\d -->\s', '') ELSE raw END) AS c, trim(raw) AS r FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, n) - 1 AS i FROM k WHERE r <> '' AND length(r) >= 80),
x AS (SELECT *, 'p-' || s || '-' || i || '-' || left(sha256('p:' || doc_id || ':' || i || ':' || left(c, 200)), 16) AS pid FROM o),
y AS (SELECT doc_id, s, page, i, pid, c, list_filter(list_transform(CASE WHEN length(c) <= 900 THEN [c] ELSE list_transform(range(ceil((length(c) - 120) / 780.0)::BIGINT), lambda j: c[j * 780 + 1 : j * 780 + 900]) END, lambda z: trim(z)), lambda z: z <> '' AND NOT (length(z) < 80 AND length(c) > 80)) AS ks FROM x),
z AS (SELECT doc_id, s, page, i, pid, unnest(CASE WHEN len(ks) > 0 THEN ks ELSE [c] END) AS c, generate_subscripts(CASE WHEN len(ks) > 0 THEN ks ELSE [c] END, 1) AS m FROM y),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, m) - 1 AS j FROM z)
SELECT doc_id::VARCHAR AS doc_id, pid AS chunk_id, 'parent' AS chunk_level, page, c AS content FROM x UNION ALL
SELECT doc_id::VARCHAR, 'c-' || s || '-' || j || '-' || left(sha256('c:' || doc_id || ':' || j || ':' || left(pid || ':' || c, 200)), 16), 'child', page, c FROM q""")
def page_window_chunks(spark, sf_dir):
    """Whole documents as two marked pages each: many windows of a page, which all carry its number."""
    i, t = F.col("doc_id").cast("string"), F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    body = F.concat(F.lit("<!-- page:2 -->\n"), t, F.lit("\n<!-- page:5 -->\n"), t, F.lit(" again"))
    docs = table(spark, sf_dir, "documents").select(i.alias("doc_id"), F.lit("s.pdf").alias("source"), F.lit("t").alias("title"), body.alias("content"), F.lit("pdf").alias("doc_type"), F.lit("").alias("mime_type"))
    return chunk.build_chunks(docs).select("doc_id", "chunk_id", "chunk_level", "page", "content")
