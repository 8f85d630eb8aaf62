"""Context packing, egress rules, prompt and citation text, answer parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import first_sentence, fold_ws, redact, strip, truncate_text
from lodestack.operators.filters import LOCAL_ONLY, norm_classification

MAX_DOCS, MAX_CHUNKS_PER_DOC, MAX_CHARS, CHUNK_OVERHEAD = 4, 2, 3200, 160
SENSITIVE_CHUNKS, SENSITIVE_CHARS = 1, 600
LOCAL_CONFIDENCE = 0.62


def ordered_hits(hits: DataFrame, columns: list[str]) -> DataFrame:
    """Per question its hits by rank as an array of structs (rank, columns). Hits are top-k lists, so arrays stay short."""
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in columns if c != "rank"]))).alias("hits"))


def apply_egress(hits: DataFrame, queries: DataFrame, redact_internal: bool = True) -> DataFrame:
    """Hits that may leave, by the question's data_classification and model_route, with egress columns.

    Local-only questions send nothing; internal ones are redacted; sensitive ones are redacted, one chunk, 600 characters.
    """
    level = norm_classification(F.col("data_classification"))
    blocked = level.isin(*LOCAL_ONLY) | (F.lower(F.trim(F.coalesce("model_route", F.lit("")))) == "local_only")
    q = queries.select("query_id", level.alias("_level"), blocked.alias("_blocked"))
    strategy = F.when(F.col("_level") == "internal", "redacted_context" if redact_internal else "full_context").when(F.col("_level") == "sensitive", "minimal_redacted_context").otherwise("full_context")
    masked = (F.col("_level") == "sensitive") | (F.lit(redact_internal) & (F.col("_level") == "internal"))
    sensitive = F.col("_level") == "sensitive"
    kept = hits.join(q, "query_id").filter(~F.col("_blocked"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    kept = kept.withColumn("_n", nth).filter(~sensitive | (F.col("_n") <= SENSITIVE_CHUNKS))
    text = F.when(masked, redact(F.col("content"))).otherwise(F.col("content"))
    text = F.when(sensitive, truncate_text(text, SENSITIVE_CHARS)).otherwise(text)
    return kept.withColumns({"content": text, "egress_strategy": strategy, "egress_redacted": masked, "egress_truncated": sensitive}).drop("_level", "_blocked", "_n")


def egress_decision(queries: DataFrame, redact_internal: bool = True) -> DataFrame:
    """Per question: egress_allowed, egress_strategy, egress_refusal_reason."""
    level = norm_classification(F.col("data_classification"))
    blocked = level.isin(*LOCAL_ONLY) | (F.lower(F.trim(F.coalesce("model_route", F.lit("")))) == "local_only")
    strategy = F.when(blocked, "local_only_blocked").when(level == "internal", "redacted_context" if redact_internal else "full_context").when(level == "sensitive", "minimal_redacted_context").otherwise("full_context")
    return queries.select("query_id", (~blocked).alias("egress_allowed"), strategy.alias("egress_strategy"), F.when(blocked, "restricted_data_local_only").otherwise("").alias("egress_refusal_reason"))


def pack_contexts(hits: DataFrame, max_docs: int = MAX_DOCS, per_doc: int = MAX_CHUNKS_PER_DOC, max_chars: int = MAX_CHARS) -> DataFrame:
    """Greedy choice by rank: documents, chunks per document, repeated sections and characters are limited; never none."""
    section = F.coalesce(F.nullif(F.trim("section_path"), F.lit("")), F.nullif(F.trim("section"), F.lit("")), F.lit(""))
    rows = hits.select("query_id", "rank", "chunk_id", F.col("doc_id").cast("string").alias("doc_id"), section.alias("sec"), F.length("content").alias("n"))
    arrays = ordered_hits(rows, ["chunk_id", "doc_id", "sec", "n"])
    kept = "array<struct<rank:int,doc_id:string,sec:string>>"
    start = F.struct(F.array().cast(kept).alias("kept"), F.lit(0).alias("used"))

    def take(s: Column, h: Column) -> Column:
        of_doc = F.filter(s["kept"], lambda k: k["doc_id"] == h["doc_id"])
        docs = F.size(F.array_distinct(F.transform(s["kept"], lambda k: k["doc_id"])))
        cost = h["n"] + CHUNK_OVERHEAD
        ok = ~((F.size(of_doc) == 0) & (docs >= max(1, max_docs))) & (F.size(of_doc) < max(1, per_doc))
        ok = ok & ~((h["sec"] != "") & F.exists(of_doc, lambda k: k["sec"] == h["sec"]))
        ok = ok & ~((F.size(s["kept"]) > 0) & (s["used"] + cost > max(1, max_chars)))
        one = F.struct(h["rank"].cast("int").alias("rank"), h["doc_id"].alias("doc_id"), h["sec"].alias("sec"))
        return F.struct(F.when(ok, F.concat(s["kept"], F.array(one))).otherwise(s["kept"]).alias("kept"), F.when(ok, s["used"] + cost).otherwise(s["used"]).alias("used"))

    ranks = F.aggregate("hits", start, take, lambda s: F.transform(s["kept"], lambda k: k["rank"]))
    chosen = arrays.select("query_id", F.explode(ranks).alias("rank"))
    packed = hits.join(chosen, ["query_id", "rank"])
    return packed.withColumn("pack_order", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def context_block(page: Column, section: Column, chunk_id: Column, title: Column, source: Column, content: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = F.concat(F.lit("[CHUNK_ID:"), text(chunk_id), F.lit("] title="), text(title), F.lit(" source="), text(source), F.lit(" page="), text(page), F.lit(" section="), text(section))
    return F.concat(head, F.lit("\n"), text(content), F.lit("\n"))


def format_contexts(hits: DataFrame) -> DataFrame:
    """Per question its context blocks by rank, joined by blank lines."""
    block = context_block(F.col("page"), F.col("section"), F.col("chunk_id"), F.col("title"), F.col("source"), F.col("content"))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    return listed.select("query_id", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("context_text"))


#: Heads of the prompt's parts.
QUESTION_HEAD, NOTICE_HEAD, CONTEXT_HEAD = "Question:\n", "Notice:\n", "Contexts:\n"


def build_prompt(queries: DataFrame, hits: DataFrame) -> DataFrame:
    notice = F.when(F.coalesce("conflict_summary", F.lit("")) != "", F.concat(F.lit(NOTICE_HEAD), F.col("conflict_summary"), F.lit("\n\n"))).otherwise("")
    joined = queries.join(format_contexts(hits), "query_id", "left")
    text = F.concat(F.lit(QUESTION_HEAD), F.col("question"), F.lit("\n\n"), notice, F.lit(CONTEXT_HEAD), F.coalesce("context_text", F.lit("")))
    return joined.withColumn("prompt", text).drop("context_text")


#: What an extractive answer says around its sentences.
LOCAL = {"lead": "The texts open to you say", "notice": ", with this notice: ", "why": "First sentences of the best contexts.", "nothing": "No context may be used here."}


def local_answer(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per question the extractive answer in the model's output layout, from its two first contexts."""
    sentence = first_sentence(F.col("content"))
    part = F.concat(F.when(sentence != "", sentence).otherwise(truncate_text(fold_ws(F.col("content")), 80)), F.lit(" [CHUNK_ID:"), F.col("chunk_id"), F.lit("]"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    two = hits.withColumn("_n", nth).filter("_n <= 2").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_n", part.alias("p"), "chunk_id"))).alias("cs"))
    q = queries.join(two, "query_id", "left")
    summary = F.coalesce("conflict_summary", F.lit("")) if "conflict_summary" in queries.columns else F.lit("")
    preface = F.concat(F.lit(LOCAL["lead"]), F.when(summary != "", F.concat(F.lit(LOCAL["notice"]), truncate_text(fold_ws(summary), 60))).otherwise(""))
    answer = F.concat(preface, F.lit(": "), F.array_join(F.transform("cs", lambda c: c["p"]), "; "))
    ids = F.concat(F.lit("["), F.array_join(F.transform("cs", lambda c: F.concat(F.lit('{"chunk_id": "'), c["chunk_id"], F.lit('"}'))), ", "), F.lit("]"))
    layout = lambda said, confidence, why: [F.lit("ANSWER: "), said, F.lit(f"\nCONFIDENCE: {confidence}\nREASONING_SUMMARY: {why}\nCITATIONS_JSON: ")]
    full = F.concat(*layout(answer, LOCAL_CONFIDENCE, LOCAL["why"]), ids)
    none = F.concat(*layout(F.lit(LOCAL["nothing"]), 0.0, LOCAL["nothing"]), F.lit("[]"))
    return q.withColumn("raw", F.when(F.col("cs").isNull(), none).otherwise(full)).drop("cs")


def parse_answers(raw: DataFrame, hits: DataFrame) -> DataFrame:
    """raw (query_id, raw) to answer, confidence, reasoning_summary and the cited chunk ids that are among the hits.

    The JSON list counts first; inline marks only when it yields nothing.
    """
    text = F.col("raw")
    found = lambda p: F.regexp_extract(text, p, 1)
    confidence = F.coalesce(F.nullif(found(r"CONFIDENCE:\s*([0-9]*\.?[0-9]+)"), F.lit("")).try_cast("double"), F.lit(0.5))
    answer = F.when(text.rlike("ANSWER:"), strip(found(r"ANSWER:\s*([\s\S]*?)(?=CONFIDENCE:|$(?![\s\S]))"))).otherwise(strip(text))
    listed = F.from_json(found(r"(?m)CITATIONS_JSON:\s*(\[[\s\S]*?\])\s*$"), "array<struct<chunk_id:string>>")
    listed = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<struct<chunk_id:string>>")), lambda c: c["chunk_id"]), lambda c: c.isNotNull())
    inline = F.transform(F.regexp_extract_all(text, F.lit(r"\[CHUNK_ID:([^\]]+)\]"), F.lit(1)), lambda t: F.trim(t))
    known = hits.groupBy("query_id").agg(F.collect_set("chunk_id").alias("_ids"))
    out = raw.join(known, "query_id", "left").withColumn("_ids", F.coalesce("_ids", F.array().cast("array<string>")))
    real = lambda a: F.filter(a, lambda c: F.array_contains(F.col("_ids"), c))
    cited = F.when(F.size(real(listed)) > 0, real(listed)).otherwise(real(inline))
    return out.select("query_id", answer.alias("answer"), confidence.alias("confidence"), strip(found(r"REASONING_SUMMARY:\s*(.+)")).alias("reasoning_summary"), cited.alias("cited_chunk_ids"))


#: What a citation says of its choice.
REASONS = {"routes": "found by ", "boosts": "metadata agrees on ", "governance": "moved up by its standing", "section": "stands in "}


def selection_reason(hits: DataFrame, say: dict[str, str] = REASONS) -> Column:
    """One sentence from matched_routes, metadata_boost_reasons, governance_bonus and section_path; null if none says anything."""
    have = set(hits.columns)
    array = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")
    routes, boosts = array("matched_routes"), array("metadata_boost_reasons")
    path = F.coalesce(F.trim("section_path"), F.lit("")) if "section_path" in have else F.lit("")
    bonus = F.coalesce(F.col("governance_bonus") > 0, F.lit(False)) if "governance_bonus" in have else F.lit(False)
    parts = F.array_compact(
        F.array(
            F.when(F.size(routes) > 0, F.concat(F.lit(say["routes"]), F.array_join(routes, ", "))),
            F.when(F.size(boosts) > 0, F.concat(F.lit(say["boosts"]), F.array_join(F.slice(boosts, 1, 3), ", "))),
            F.when(bonus, say["governance"]),
            F.when(path != "", F.concat(F.lit(say["section"]), path)),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "; "))


CITATION_FIELDS = (
    "doc_id", "chunk_id", "title", "source", "page", "section", "doc_type", "owner_department", "data_classification", "version", "effective_date",
    "authority_level", "source_system", "business_domain", "process_stage", "section_path", "matched_routes",
)


def citations(hits: DataFrame) -> DataFrame:
    """query_id, rank and one citation record per hit; fields a hit doesn't have are null."""
    have = set(hits.columns)
    fields = [(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in CITATION_FIELDS]
    scores = [(F.col(c) if c in have else F.lit(None).cast("double")).alias(a) for c, a in (("score", "retrieval_score"), ("semantic_score", "semantic_score"), ("governance_rank_score", "governance_rank_score"))]
    return hits.select("query_id", "rank", F.struct(*fields, *scores, selection_reason(hits).alias("selection_reason")).alias("citation"))


def distinct_citations(cited: DataFrame) -> DataFrame:
    """The first citation of each chunk per question."""
    order = Window.partitionBy("query_id", "citation.chunk_id").orderBy("rank")
    return cited.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def citation_coverage(cited: Column, retrieved: Column) -> Column:
    return F.size(F.array_intersect(cited, retrieved)) / F.greatest(F.lit(1), F.size(F.array_distinct(retrieved)))
