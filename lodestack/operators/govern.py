"""Reranking, governance order and conflict detection by window functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import keyword_set

# Fixed values.
AUTHORITY = {"low": 1, "medium": 2, "high": 3}
AUTHORITY_BOOST, FRESHNESS_BOOST, VERSION_BOOST = 0.08, 0.06, 0.04
CONFLICT_TOP = 5


def rerank_candidates(hits: DataFrame, top_n: int = 8, multiplier: int = 4, cap: int = 24) -> DataFrame:
    """The first max(top_n, min(cap, multiplier * top_n)) hits by rank."""
    return hits.filter(F.col("rank") <= max(top_n, min(cap, multiplier * top_n)))


def lexical_score(question: Column, content: Column) -> Column:
    """The default pair score: share of the question's keywords in the text."""
    asked = keyword_set(question)
    return F.size(F.array_intersect(asked, keyword_set(content))) / F.greatest(F.lit(1), F.size(asked))


def rerank(hits: DataFrame, questions: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_score, n: int = 8) -> DataFrame:
    """Candidates rescored as pairs of question and content, the best ``n`` per question; ties by earlier rank."""
    pairs = hits.join(questions.select("query_id", F.col("question").alias("_q")), "query_id")
    pairs = pairs.withColumn("prior_rank", F.col("rank")).withColumn("score", F.round(scorer(F.col("_q"), F.col("content")), 6)).drop("_q")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "prior_rank")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def minmax(value: Column, by: str = "query_id") -> Column:
    """0..1 within the question; 0 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 0.0).otherwise((value - low) / (high - low))


def version_array(version: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(version, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda d: d.cast("bigint"))


def version_norm(version: Column, by: str = "query_id") -> Column:
    """Dense rank among the question's distinct versions over its largest; 0 where all are equal."""
    rank = F.dense_rank().over(Window.partitionBy(by).orderBy(version_array(version))) - 1
    return rank


def date_number(value: Column) -> Column:
    """Day number of an ISO date (slashes allowed), 0 for anything else."""
    text = F.regexp_replace(F.trim(value), "/", "-")
    ok = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.coalesce(F.date_diff(ok, F.lit("0001-01-01").cast("date")) + 1, F.lit(0))


def authority_rank(value: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in AUTHORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(value))), F.lit(0))


def governance_rank(hits: DataFrame) -> DataFrame:
    """Rank by score plus authority, freshness and version bonuses; the stored score stays, ties keep the prior order."""
    whole = Window.partitionBy("query_id")
    h = hits.withColumn("_v", version_norm(F.col("version")))
    top = F.max("_v").over(whole)
    version = F.when(top == 0, 0.0).otherwise(F.col("_v") / top)
    bonus = minmax(authority_rank(F.col("authority_level"))) * AUTHORITY_BOOST + minmax(date_number(F.col("effective_date"))) * FRESHNESS_BOOST + version * VERSION_BOOST
    h = h.withColumn("_bonus", bonus).withColumns(
        {"semantic_score": F.col("score"), "governance_bonus": F.round("_bonus", 6), "governance_rank_score": F.round(F.col("score") + F.col("_bonus"), 6), "prior_rank": F.col("rank")}
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.col("score") + F.col("_bonus")), "prior_rank")
    return h.withColumn("rank", F.row_number().over(order)).drop("_v", "_bonus")


def topic_key(title: Column, source: Column, doc_id: Column) -> Column:
    clean = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))
    return F.coalesce(clean(title), clean(source), clean(doc_id))


def detect_conflicts(hits: DataFrame, questions: DataFrame, top: int = CONFLICT_TOP) -> DataFrame:
    """Per question: conflict_detected, conflict_topic, preferred_chunk_id, conflict_summary, answer_mode.

    The first topic, by rank, that has two of the top hits or more and more than one version, date or authority.
    """
    h = hits.filter(F.col("rank") <= max(2, top)).withColumn("topic", topic_key(F.col("title"), F.col("source"), F.col("doc_id")))
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    fields = {"version": "version", "effective_date": "from", "authority_level": "standing"}
    seen = [F.array_sort(F.collect_list(F.when(text(c).isNotNull(), F.struct("rank", text(c).alias("v"))))).alias(f"_{c}") for c in fields]
    shown = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("title", "source", "doc_id")])
    first = [F.min_by(F.coalesce(text(c), F.lit("")), "rank").alias(f"p_{c}") for c in fields]
    g = h.groupBy("query_id", "topic").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"), F.min_by("chunk_id", "rank").alias("preferred_chunk_id"), F.min_by(shown, "rank").alias("shown"), *seen, *first)
    distinct = {c: F.array_distinct(F.transform(f"_{c}", lambda s: s["v"])) for c in fields}
    says = {"version": "versions (", "effective_date": "dates (", "authority_level": "standing ("}
    reasons = F.array_compact(F.array(*[F.when(F.size(d) > 1, F.concat(F.lit(says[c]), F.array_join(d, ", "), F.lit(")"))) for c, d in distinct.items()]))
    details = F.array_compact(F.array(*[F.when(F.col(f"p_{c}") != "", F.concat(F.lit(f"{label} "), F.col(f"p_{c}"))) for c, label in fields.items()]))
    described = F.when(F.size(details) > 0, F.concat(F.col("shown"), F.lit(" ("), F.array_join(details, ", "), F.lit(")"))).otherwise(F.col("shown"))
    summary = F.concat(F.lit("Texts on this topic differ in "), F.array_join(reasons, "; "), F.lit(". Used first: "), described, F.lit("."))
    bad = g.filter((F.col("n") >= 2) & (F.size(reasons) > 0)).select("query_id", F.struct("first_rank", F.col("topic").alias("conflict_topic"), "preferred_chunk_id", summary.alias("conflict_summary")).alias("c"))
    found = bad.groupBy("query_id").agg(F.min("c").alias("c")).select("query_id", "c.*").drop("first_rank")
    out = questions.select("query_id").join(found, "query_id", "left").withColumn("conflict_detected", F.col("conflict_topic").isNotNull())
    return out.withColumn("conflict_summary", F.coalesce("conflict_summary", F.lit(""))).withColumn("answer_mode", F.when(F.col("conflict_detected"), "grounded_answer_with_conflict").otherwise("grounded_answer"))
