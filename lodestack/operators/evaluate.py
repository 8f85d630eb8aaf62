"""Evaluation aggregates, bad cases and rank metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("faithfulness", "answer_relevancy", "context_recall", "context_precision")


def to_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def norm_tags(value: Column, is_text: bool = True) -> Column:
    parts = F.split(F.coalesce(value, F.lit("")), ",") if is_text else F.coalesce(value, F.array().cast("array<string>"))
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def eval_signals(answers: DataFrame, hits: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """Answers with what their hits and citations say: routes, boosts, entity groups, explainable citations."""
    have = set(hits.columns)
    positive = lambda c: F.coalesce(F.bool_or(F.col(c) > 0), F.lit(False)) if c in have else F.lit(False)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))) if c in have else F.array().cast("array<string>")
    per = hits.groupBy("query_id").agg(
        union("matched_routes").alias("matched_routes"), positive("metadata_boost").alias("metadata_boosted"),
        (F.max(F.size("enterprise_entity_matches")) > 0 if "enterprise_entity_matches" in have else F.lit(False)).alias("enterprise_entity_boosted"),
        union("enterprise_entity_matches").alias("enterprise_entity_matches"), positive("governance_bonus").alias("governance_boosted"),
    )
    out = answers.join(per, "query_id", "left")
    if cited is not None:
        n = cited.groupBy("query_id").agg(F.count_if(F.coalesce(F.trim("citation.selection_reason"), F.lit("")) != "").alias("explainable_citation_count"))
        out = out.join(n, "query_id", "left").withColumn("explainable_citation_count", F.coalesce("explainable_citation_count", F.lit(0)))
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("metadata_boosted", "enterprise_entity_boosted", "governance_boosted")}
    return out.withColumns(flags)


def rate(flag: str) -> Column:
    return F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("double"))


def eval_summary(rows: DataFrame) -> DataFrame:
    """One row of rates over all evaluation rows."""
    return rows.agg(
        F.count("*").alias("sample_count"), rate("refusal").alias("refusal_rate"), rate("conflict_detected").alias("conflict_detected_rate"), rate("metadata_boosted").alias("metadata_boost_hit_rate"),
        rate("enterprise_entity_boosted").alias("enterprise_entity_boost_hit_rate"), rate("governance_boosted").alias("governance_boost_hit_rate"),
        F.avg(F.coalesce("explainable_citation_count", F.lit(0)).cast("double")).alias("avg_explainable_citations"), F.coalesce(F.avg("analysis_confidence"), F.lit(0.0)).alias("avg_analysis_confidence"),
    )


SHARES = {"classification": "data_classification", "model_route": "model_route", "analysis_source": "analysis_source", "scenario": "scenario"}
LIST_SHARES = {"matched_route": "matched_routes", "entity_match": "enterprise_entity_matches", "tag": "tags"}


def eval_shares(rows: DataFrame) -> DataFrame:
    """(kind, value, n, share) over all category columns at once: one pass unpivots them, one shuffle counts."""
    have = set(rows.columns)
    none = F.array().cast("array<string>")
    entry = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    singles = F.array(*[entry(k, F.trim(F.col(c).cast("string"))) for k, c in SHARES.items() if c in have])
    each = lambda kind, c: F.transform(F.coalesce(F.col(c), none), lambda v: entry(kind, F.trim(v)))
    lists = [each(k, c) for k, c in LIST_SHARES.items() if c in have]
    long = rows.select(F.explode(F.concat(singles, *lists)).alias("e")).select("e.*").filter("value is not null and value <> ''")
    counts = long.groupBy("kind", "value").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("kind", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def expectation_rates(rows: DataFrame) -> DataFrame:
    """Match rates of expected refusals and conflicts, over rows that state an expectation."""
    def match(expected: str, actual: str) -> Column:
        return F.avg(F.when(F.col(expected).isNotNull(), (to_bool(F.col(expected)) == F.coalesce(F.col(actual), F.lit(False))).cast("double")))

    return rows.agg(match("expected_refusal", "refusal").alias("expected_refusal_match_rate"), match("expected_conflict", "conflict_detected").alias("expected_conflict_match_rate"))


def top_values(rows: DataFrame, n: int = 5) -> DataFrame:
    """Top scenes, and top scenarios among guardrail and model-enhanced rows: (report, name, n, rank), ties by name."""
    source = F.coalesce("analysis_source", F.lit(""))
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    entries = F.array(
        F.struct(F.lit("top_scenes").alias("report"), text("query_scene").alias("name")),
        F.struct(F.when(source.contains("guardrail"), "top_guardrail_scenarios").alias("report"), text("scenario").alias("name")),
        F.struct(F.when(source == "llm_enhanced", "top_llm_enhanced_scenarios").alias("report"), text("scenario").alias("name")),
    )
    counts = rows.select(F.explode(entries).alias("e")).select("e.*").filter("report is not null and name is not null").groupBy("report", "name").agg(F.count("*").alias("n"))
    order = Window.partitionBy("report").orderBy(F.desc("n"), "name")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def recommendations(rows: DataFrame) -> DataFrame:
    source = F.coalesce("analysis_source", F.lit(""))
    got = rows.agg(
        F.coalesce(F.avg(source.contains("guardrail").cast("double")), F.lit(0.0)).alias("g"), F.coalesce(F.avg(((source == "llm_enhanced") & ~source.contains("guardrail")).cast("double")), F.lit(0.0)).alias("m"),
        F.coalesce(F.avg(F.coalesce(F.col("analysis_confidence") < 0.6, F.lit(False)).cast("double")), F.lit(0.0)).alias("low"),
    )
    listed = F.array_compact(F.array(F.when(F.col("g") >= 0.2, "raise_rule_anchors"), F.when(F.col("m") >= 0.3, "extend_rule_coverage"), F.when(F.col("low") >= 0.3, "tune_confidence_weights")))
    return got.select(F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("add_badcases"))).alias("recommendations"))


def badcases(rows: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` rows of highest priority, then lowest metric, then question: with priority and min_metric."""
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    missed = lambda e, a: F.when(F.col(e).isNotNull() & (to_bool(F.col(e)) != b(a)), 4).otherwise(0)
    priority = missed("expected_refusal", "refusal") + missed("expected_conflict", "conflict_detected") + b("refusal").cast("int") + b("conflict_detected").cast("int")
    for m in METRICS:
        priority = priority + F.when(F.col(m) < 0.6, 1).otherwise(0)
    least = F.coalesce(F.least(*METRICS), F.lit(1.0))
    return rows.withColumns({"priority": priority, "min_metric": least}).filter("priority > 0").orderBy(F.desc("priority"), "min_metric", "question").limit(n)


def eval_report(dataset: DataFrame, results: DataFrame, signals: DataFrame) -> DataFrame:
    """Dataset rows with results and signals by query_id; contexts fall back to the reference's."""
    r = results.withColumnRenamed("contexts", "_got")
    out = dataset.join(r, "query_id", "left").join(signals, "query_id", "left")
    none = F.size(F.coalesce("_got", F.array().cast("array<string>"))) == 0
    return out.withColumn("contexts", F.when(none, F.col("contexts")).otherwise(F.col("_got"))).drop("_got")


def rank_metrics(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: mrr_at_10, ndcg_at_10, hit_at_3, hit_at_5 over the questions of ``qrels`` (query_id, chunk_id)."""
    good = qrels.select("query_id", "chunk_id").distinct()
    wanted = good.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    found = hits.filter("rank <= 10").join(good, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(1 / F.log2(1 + F.col("rank"))).alias("dcg"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(10)).cast("int")), lambda i: 1 / F.log2(1 + i.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    q = wanted.join(found, "query_id", "left").withColumn("ideal", ideal)
    zero = F.lit(0.0)
    return q.agg(
        F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce(1 / F.col("first"), zero)), 6).alias("mrr_at_10"), F.round(F.avg(F.coalesce(F.col("dcg") / F.col("ideal"), zero)), 6).alias("ndcg_at_10"),
        F.round(F.avg(F.coalesce((F.col("first") <= 3).cast("double"), zero)), 6).alias("hit_at_3"), F.round(F.avg(F.coalesce((F.col("first") <= 5).cast("double"), zero)), 6).alias("hit_at_5"),
    )
