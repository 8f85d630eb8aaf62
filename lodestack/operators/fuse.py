"""Fusion of hit lists, merging over routes, parent expansion and metadata boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.search import top_k

# Fusion and boost constants, entity groups of metadata keys.
RRF_K, FUSED_K, SPARSE_WEIGHT = 60, 30, 0.5
INTENT_BOOST, FILTER_BOOST, ENTITY_BOOST = 0.08, 0.05, 0.12
MIN_WEIGHTED_SCORE = 0.15
ENTITY_GROUPS = {
    "department": "department", "owner_department": "department", "plant": "site", "applicable_site": "site", "system_name": "system",
    "business_domain": "business_domain", "process_stage": "process_stage", "equipment_type": "equipment", "equipment_id": "equipment", "project_name": "project",
}


def rrf(hits: DataFrame, k: int = RRF_K, limit: int = FUSED_K) -> DataFrame:
    """(query_id, chunk_id, score, rank) of hits (query_id, chunk_id, rank) by the sum of 1 / (k + rank) over the lists."""
    fused = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return top_k(fused, limit)


def weighted_fusion(hits: DataFrame, weight: Column | float = SPARSE_WEIGHT, limit: int = FUSED_K) -> DataFrame:
    """Both lists (retriever sparse or dense) over their largest absolute score, summed with weights w and 1 - w."""
    largest = F.max(F.abs("score")).over(Window.partitionBy("query_id", "retriever"))
    part = F.col("score") / F.when(largest == 0, 1.0).otherwise(largest)
    w = F.lit(weight) if isinstance(weight, float) else weight
    scaled = hits.withColumn("_part", part).withColumn("_w", F.when(F.col("retriever") == "sparse", w).otherwise(1 - w))
    fused = scaled.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("_w") * F.col("_part")), 9).alias("score"))
    return top_k(fused, limit)


def parse_scene_weights(text: str | None) -> dict[str, float]:
    """``scene:weight`` items of a comma list, weights kept in 0..1, bad items left out."""
    out = {}
    for item in (text or "").split(","):
        scene, colon, weight = item.partition(":")
        try:
            if colon and scene.strip():
                out[scene.strip()] = min(1.0, max(0.0, float(weight)))
        except ValueError:
            continue
    return out


def fusion_policy(questions: DataFrame, weighted_scenes: tuple[str, ...], scene_weights: dict[str, float], strategy: str = "rrf", weight: float = SPARSE_WEIGHT) -> DataFrame:
    """fusion_strategy and sparse_weight of each question's ``query_scene``."""
    scene = F.trim(F.coalesce("query_scene", F.lit("")))
    w = F.lit(weight)
    for name, value in scene_weights.items():
        w = F.when(scene == name, value).otherwise(w)
    return questions.withColumns({"fusion_strategy": F.when(scene.isin(*weighted_scenes), "weighted").otherwise(strategy), "sparse_weight": w})


def fuse(hits: DataFrame, policies: DataFrame, limit: int = FUSED_K) -> DataFrame:
    """Fused hits of each question by its own policy."""
    chosen = hits.join(policies.select("query_id", "fusion_strategy", "sparse_weight"), "query_id")
    by_rank = rrf(chosen.filter("fusion_strategy <> 'weighted'"), limit=limit)
    by_score = weighted_fusion(chosen.filter("fusion_strategy = 'weighted'"), F.col("sparse_weight"), limit)
    out = by_rank.withColumn("fusion", F.lit("rrf")).unionByName(by_score.withColumn("fusion", F.lit("weighted")))
    return out


def annotate(hits: DataFrame, routes: DataFrame) -> DataFrame:
    """Hits with their route's kind and query."""
    return hits.join(routes.select("query_id", "route_name", "route_kind", "route_query", "route_order"), ["query_id", "route_name"], "left")


def merge_routes(hits: DataFrame) -> DataFrame:
    """One row per question and chunk: best score, matched routes and kinds in route order, their number."""
    by_order = F.array_sort(F.collect_set(F.struct("route_order", "route_name", "route_kind")))
    out = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), by_order.alias("_r"))
    names = F.array_distinct(F.transform("_r", lambda r: r["route_name"]))
    kinds = F.array_distinct(F.transform("_r", lambda r: r["route_kind"]))
    return out.select("query_id", "chunk_id", "score", names.alias("matched_routes"), kinds.alias("matched_route_kinds"), F.size(names).alias("matched_route_count"))


def expand_parents(hits: DataFrame, chunks: DataFrame, fill: tuple[str, ...] = ()) -> DataFrame:
    """Child hits as their parents: best child score, child ids, parent content; columns ``fill`` come from the parent, else the child.

    A hit whose parent isn't in ``chunks`` stays itself.
    """
    child = chunks.select("chunk_id", "parent_chunk_id", "content", *fill)
    parent = chunks.select(F.col("chunk_id").alias("_pid"), F.col("content").alias("_pc"), *[F.col(c).alias(f"_p_{c}") for c in fill])
    wide = hits.join(child, "chunk_id", "left").join(parent, F.col("parent_chunk_id") == F.col("_pid"), "left")
    best = F.struct("score", F.col("chunk_id").alias("child"))
    keyed = wide.withColumn("parent_id", F.coalesce("_pid", "chunk_id")).withColumn("content", F.coalesce("_pc", "content"))
    merged = [F.max_by(F.coalesce(F.nullif(F.col(f"_p_{c}").cast("string"), F.lit("")), F.col(c).cast("string")), best).alias(c) for c in fill]
    out = keyed.groupBy("query_id", "parent_id").agg(F.max("score").alias("score"), F.max_by("content", best).alias("content"), F.array_sort(F.collect_set("chunk_id")).alias("matched_child_chunk_ids"), *merged)
    return out.withColumnRenamed("parent_id", "chunk_id").withColumn("matched_child_count", F.size("matched_child_chunk_ids"))


def metadata_boost(hits: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """Score raised by metadata that a question's ``metadata_intent`` and ``structured_filters`` maps ask for; order ties by rank.

    +0.08 a matching intent key, +0.05 a matching filter key, +0.12 a distinct entity group among the intent matches.
    """
    q = questions.select("query_id", "metadata_intent", "structured_filters")
    h = hits.join(q, "query_id", "left")
    keys = [k for k in keys if k in hits.columns]
    same = lambda m, k: F.coalesce(F.lower(F.trim(F.try_element_at(F.col(m), F.lit(k)))) == F.lower(F.trim(F.col(k).cast("string"))), F.lit(False))
    none = F.array().cast("array<string>")
    pick = lambda m, label: F.array_compact(F.array(*[F.when(same(m, k), label(k)) for k in keys])) if keys else none
    intent, filters = pick("metadata_intent", F.lit), pick("structured_filters", F.lit)
    groups = F.array_distinct(F.array_compact(F.array(*[F.when(same("metadata_intent", k), ENTITY_GROUPS[k]) for k in keys if k in ENTITY_GROUPS]))) if any(k in ENTITY_GROUPS for k in keys) else none
    bonus = F.size(intent) * INTENT_BOOST + F.size(filters) * FILTER_BOOST + F.size(groups) * ENTITY_BOOST
    reasons = F.concat(F.transform(intent, lambda k: F.concat(F.lit("intent:"), k)), F.transform(filters, lambda k: F.concat(F.lit("filter:"), k)), F.transform(groups, lambda g: F.concat(F.lit("entity:"), g)))
    h = h.withColumns({"base_score": F.col("score"), "metadata_boost": F.round(bonus, 6), "enterprise_entity_matches": groups, "metadata_boost_reasons": reasons})
    h = h.withColumn("score", F.round(F.col("score") + F.col("metadata_boost"), 6)).drop("metadata_intent", "structured_filters")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return h.withColumn("rank", F.row_number().over(order))


def fusion_gate(hits: DataFrame, policies: DataFrame, min_score: float = MIN_WEIGHTED_SCORE) -> DataFrame:
    """Per question of ``policies``: has hits, and with the weighted strategy a best score of at least ``min_score``."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    ok = F.col("best").isNotNull() & ((F.col("fusion_strategy") != "weighted") | (F.col("best") >= min_score))
    return policies.join(best, "query_id", "left").select("query_id", "best", ok.alias("actionable"))
