"""Driver queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bpe, chat, extraction, fingerprint, hard_negatives, langid, licenses, merkle, mixing, near_dedup, quality, token_lengths, toxicity
from lodestack.llm.common import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    doc_id = F.col("doc_id")
    model = toxicity.fit_toxicity(docs, labels, allowed=~held_out(doc_id))
    return toxicity.toxicity(docs, model, keep=[doc_id, held_out(doc_id).alias("held_out")])


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op3_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.suffix_sums(token_lengths.length_histogram(table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.filter(~held_out(F.col("doc_id"))))
    return langid.identify_languages(docs, model, keep=[F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = merkle.document_manifest(table(spark, sf_dir, "documents"), tampered)
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.with_noise(hard_negatives.prepared(table(spark, sf_dir, "embeddings")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = chat.format_turns(chat.with_example(table(spark, sf_dir, "conversations")))
    return chat.read_back(pieces).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_fingerprint": op2_fingerprint,
    "op3_token_lengths": op3_token_lengths,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_licenses": op6_licenses,
    "op7_extraction": op7_extraction,
    "op8_bpe": op8_bpe,
    "op9_near_dedup": op9_near_dedup,
    "op10_language": op10_language,
    "op11_merkle": op11_merkle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_chat": op13_chat,
}

#: Exact links over all pairs that share a shingle, and what they reach.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, edge.b FROM reach JOIN edge ON edge.a = reach.r),
least_ AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN least_ ON d = doc_id"""

#: Levels by recursion; a fold over each leaf's levels; CRC-32 by its table.
MERKLE_SQL = r"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, lang, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents, crc_table),
h AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
  CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS bad FROM d),
leaf AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM h),
lv AS (SELECT 0 AS l, lang AS g, i, leaf AS h, n FROM leaf UNION ALL SELECT l + 1, g, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM lv WHERE n > 1 GROUP BY l, g, i // 2, n),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS gi, count(*) OVER () AS gn FROM lv WHERE n = 1),
tv AS (SELECT 0 AS l, gi AS i, h, gn AS n FROM sub UNION ALL SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tv WHERE n > 1 GROUP BY l, i // 2, n),
step AS (SELECT r, 0 AS tree, o.l, (leaf.i >> o.l::INT) & 1 AS side, s.h FROM leaf JOIN (SELECT DISTINCT g, l FROM lv WHERE n > 1) o ON o.g IS NOT DISTINCT FROM leaf.lang LEFT JOIN lv s ON s.g IS NOT DISTINCT FROM leaf.lang AND s.l = o.l AND s.i = xor(leaf.i >> o.l::INT, 1)
  UNION ALL SELECT r, 1, o.l, (gi >> o.l::INT) & 1, s.h FROM leaf JOIN sub ON sub.g IS NOT DISTINCT FROM leaf.lang, (SELECT DISTINCT l FROM tv WHERE n > 1) o LEFT JOIN tv s ON s.l = o.l AND s.i = xor(gi >> o.l::INT, 1)),
path AS (SELECT r, coalesce(string_agg(h, '' ORDER BY tree, l), '') AS proof, list({'side': side, 'h': h} ORDER BY tree, l) AS steps FROM step GROUP BY r),
made AS (SELECT doc_id, leaf, sub.h AS subroot, tv.h AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce([{'side': 0::BIGINT, 'h': coalesce(bad, leaf)}] || coalesce(steps, []), lambda a, b: {'side': 0::BIGINT, 'h': sha256(CASE WHEN b.h IS NULL THEN a.h WHEN b.side = 1 THEN b.h || a.h ELSE a.h || b.h END)}).h AS folded_root
  FROM leaf JOIN sub ON sub.g IS NOT DISTINCT FROM leaf.lang JOIN tv ON tv.n = 1 LEFT JOIN path USING (r))
SELECT *, folded_root = root AS verified FROM made"""

HARD_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = b.label AS same, b.r, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10"""

CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(k)),
m AS (SELECT *, '### ' || CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE 'role=' || url_encode(role) END || ': ' || regexp_replace(text, '\\*(?:#{3,}|</turn>)', '\\\0', 'g') || chr(10) || '</turn>' || chr(10) AS piece FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(piece))::BIGINT AS formatted_chars FROM m GROUP BY conv_id"""

#: The other operators have no SQL form.
ORACLES: dict[str, str] = {"op9_near_dedup": NEAR_SQL, "op11_merkle": MERKLE_SQL, "op12_hard_negatives": HARD_SQL, "op13_chat": CHAT_SQL}
