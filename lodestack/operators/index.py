"""Maintenance of chunk and FAQ tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.search import encode


def merge_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """New chunk ids replace old ones."""
    return old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new, allowMissingColumns=True)


def replace_chunks(new: DataFrame, path: str) -> None:
    new.write.mode("overwrite").parquet(path)


def rebuild_vectors(chunks: DataFrame, encoder: Callable[[Column], Column]) -> DataFrame:
    """Vectors of stored chunks without parsing anything again."""
    return encode(chunks.select("chunk_id", "content"), encoder).select("chunk_id", "embedding")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that the table lacks: it must be rewritten if there are any."""
    return [c for c in required if c not in df.columns]


def upsert_faq(old: DataFrame, new: DataFrame) -> DataFrame:
    """FAQ keyed on the question: a new row replaces the old one's text and keeps its id and counters."""
    latest = Window.partitionBy("question").orderBy(F.desc("entry_id"))
    n = new.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n").select("question", F.col("entry_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("answer", "keywords", "category", "enabled")])
    both = old.join(n, "question", "full_outer")
    pick = lambda c: F.coalesce(f"_{c}", c)
    return both.select(F.coalesce("entry_id", "_id").alias("entry_id"), "question", *[pick(c).alias(c) for c in ("answer", "keywords", "category", "enabled")], F.coalesce("hit_count", F.lit(0)).alias("hit_count"), "last_hit_at")


def apply_faq_changes(faq: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Updates by entry_id (null: unchanged), and per change whether a row matched."""
    fields = [c for c in ("question", "answer", "keywords", "category", "enabled") if c in changes.columns]
    c = changes.select("entry_id", *[F.col(f).alias(f"_{f}") for f in fields])
    updated = faq.join(c, "entry_id", "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])
    matched = changes.select("entry_id").join(faq.select("entry_id", F.lit(True).alias("matched")), "entry_id", "left")
    return updated, matched.withColumn("matched", F.coalesce("matched", F.lit(False)))


def apply_faq_hits(faq: DataFrame, hits: DataFrame) -> DataFrame:
    """Hit counters raised by hits (entry_id, hit_at), pre-aggregated per entry."""
    h = hits.groupBy("entry_id").agg(F.count("*").alias("_n"), F.max("hit_at").alias("_at"))
    out = faq.join(h, "entry_id", "left")
    return out.withColumns({"hit_count": F.coalesce("hit_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_hit_at": F.greatest("last_hit_at", "_at")}).drop("_n", "_at")


def list_faq(faq: DataFrame, enabled: bool | None = None) -> DataFrame:
    rows = faq if enabled is None else faq.filter(F.col("enabled") == enabled)
    return rows.orderBy("entry_id")


def seed_if_empty(faq: DataFrame, seed: DataFrame) -> DataFrame:
    return seed.select(*faq.columns) if faq.isEmpty() else faq
