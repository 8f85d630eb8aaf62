"""The decision cascade: generation gate, grounding, refusals, clarification rows, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_RELEVANCE, REFUSE_UNDER = -5.0, 0.35
ASK_MORE = "请说明所指的对象和条件。"


def generation_gate(queries: DataFrame, hits: DataFrame, packed: DataFrame) -> DataFrame:
    """Per question the first reason that applies, with its answer mode and confidence; null reason: generate.

    ``queries`` carries risk_allow, risk_reason, model_route and egress_allowed.
    """
    seen = hits.groupBy("query_id").agg(F.max("score").alias("best_score"))
    kept = packed.groupBy("query_id").agg(F.count("*").alias("n_packed"))
    q = queries.join(seen, "query_id", "left").join(kept, "query_id", "left")
    allowed = lambda c: F.coalesce(F.col(c), F.lit(True))
    local = F.lower(F.trim(F.coalesce("model_route", F.lit("")))) == "local_only"
    cases = [
        (F.col("best_score").isNull(), F.lit("empty_context"), "refusal", 0.0),
        (F.col("best_score") < MIN_RELEVANCE, F.lit("low_relevance"), "refusal", 0.15),
        (~allowed("risk_allow"), F.coalesce(F.nullif("risk_reason", F.lit("")), F.lit("risk_engine_denied")), "refusal", 0.0),
        (local, F.lit(""), "local_grounded_answer", 0.62),
        (~allowed("egress_allowed"), F.lit("restricted_data_local_only"), "refusal", 0.0),
        (F.col("n_packed").isNull(), F.lit("empty_packed_context"), "refusal", 0.0),
    ]
    chosen = F.struct(F.lit(None).cast("string").alias("gate_reason"), F.lit("grounded_answer").alias("answer_mode"), F.lit(None).cast("double").alias("confidence"))
    for test, reason, mode, confidence in reversed(cases):
        chosen = F.when(test, F.struct(reason.alias("gate_reason"), F.lit(mode).alias("answer_mode"), F.lit(confidence).alias("confidence"))).otherwise(chosen)
    return q.select("query_id", chosen.alias("g")).select("query_id", "g.*", (F.col("g.answer_mode") == "refusal").alias("refusal"))


def validate_grounding(answers: DataFrame) -> DataFrame:
    """answers (refusal, confidence, refusal_reason, cited_chunk_ids, retrieved_chunk_ids) after the grounding rules."""
    none = F.array().cast("array<string>")
    cited, got = F.coalesce("cited_chunk_ids", none), F.coalesce("retrieved_chunk_ids", none)
    refused = F.coalesce("refusal", F.lit(False))
    uncited = ~refused & (F.size(cited) == 0)
    unknown = F.size(F.array_except(cited, got)) > 0
    conf = F.coalesce("confidence", F.lit(0.0))
    conf = F.when(uncited, F.least(conf, F.lit(0.25))).otherwise(conf)
    conf = F.when(unknown, F.least(conf, F.lit(0.2))).otherwise(conf)
    low = ~refused & ~uncited & (conf < REFUSE_UNDER)
    refusal = refused | uncited | low
    reason = F.trim(F.coalesce("refusal_reason", F.lit("")))
    return answers.withColumns({"grounding_ok": ~(uncited | unknown | low), "confidence": conf, "refusal": refusal, "refusal_reason": F.when(refusal & (reason == ""), "low_confidence").otherwise(reason)})


def refuse_empty(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Refusal rows of questions without hits; an earlier reason stays."""
    empty = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    reason = F.coalesce(F.nullif(F.trim("refusal_reason"), F.lit("")), F.lit("empty_retrieval")) if "refusal_reason" in queries.columns else F.lit("empty_retrieval")
    return empty.select("query_id", F.lit(True).alias("refusal"), reason.alias("refusal_reason"), F.lit(0.0).alias("confidence"), F.lit("refusal").alias("answer_mode"))


def clarify_response(queries: DataFrame) -> DataFrame:
    """Answer rows of questions that need clarification."""
    text = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    return queries.filter("need_clarify").select(
        "query_id",
        text("clarify_question", ASK_MORE).alias("answer"),
        F.lit(0.0).alias("confidence"),
        text("clarify_reason", "no anchor").alias("reasoning_summary"),
        F.lit(True).alias("refusal"),
        F.lit("need_clarify").alias("refusal_reason"),
        F.lit(False).alias("grounding_ok"),
    )


def answer_mode(answers: DataFrame):
    """The stored mode, else by refusal and conflict flags."""
    fallback = F.when(F.coalesce("refusal", F.lit(False)), "refusal").when(F.coalesce("conflict_detected", F.lit(False)), "grounded_answer_with_conflict").otherwise("grounded_answer")
    return F.coalesce(F.nullif(F.trim("answer_mode"), F.lit("")), fallback)


def split_stages(queries: DataFrame, hits: DataFrame) -> dict[str, DataFrame]:
    """Disjoint parts: clarify, empty (no hit) and ok."""
    clear = queries.filter(~F.coalesce("need_clarify", F.lit(False)))
    with_hits = hits.select("query_id").distinct()
    return {"clarify": queries.filter(F.coalesce("need_clarify", F.lit(False))), "empty": clear.join(with_hits, "query_id", "left_anti"), "ok": clear.join(with_hits, "query_id", "left_semi")}
