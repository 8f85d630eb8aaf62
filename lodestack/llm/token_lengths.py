"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import cut
from lodestack.llm.quality import _byte_encoder, default_paths

#: Lengths in one block of the two-level suffix sums.
BLOCK = 1024


def token_count(path: str | None = None):
    """A vectorised UDF text -> tokens of the byte-level vocabulary; null counts as empty, special strings as text."""
    path = path or default_paths()[0]

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _byte_encoder(path).encode_ordinary
        for texts in batches:
            yield pd.Series(np.fromiter((len(encode(t)) if t else 0 for t in texts), np.int64, len(texts)))

    return count


def length_histogram(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(length, docs): documents by encoded length. Null and empty texts have length 0; an empty table no row."""
    lengths = docs.select(token_count(path)(F.col(text)).alias("length"))
    return lengths.groupBy("length").agg(F.count("*").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: what lies at or above it and what cutting there leaves.

    length, docs, docs_from, tokens_from (of texts at least that long), docs_all, tokens_all, truncated_total (tokens if each
    text is cut to ``length``) and share_upto (of documents not longer). Lengths fall in blocks; only block totals,
    one row for each ``BLOCK`` lengths, are summed in one task.
    """
    rows = histogram.groupBy("length").agg(F.sum("docs").alias("docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    rows = cut(rows)  # one row a length: the texts are encoded once, not again for the block totals
    totals = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("length")).alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("d").over(above), zero).alias("d_above"),
        F.coalesce(F.sum("t").over(above), zero).alias("t_above"),
        F.sum("d").over(every).alias("docs_all"),
        F.sum("t").over(every).alias("tokens_all"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(totals, "block")
    rows = rows.withColumn("docs_from", F.sum("docs").over(inside) + F.col("d_above"))
    rows = rows.withColumn("tokens_from", F.sum(F.col("docs") * F.col("length")).over(inside) + F.col("t_above"))
    capped = F.col("tokens_all") - F.col("tokens_from") + F.col("docs_from") * F.col("length")
    share = (F.col("docs_all") - F.col("docs_from") + F.col("docs")) / F.col("docs_all")
    return rows.select("length", "docs", "docs_from", "tokens_from", "docs_all", "tokens_all", capped.alias("truncated_total"), share.alias("share_upto"))


def truncated_totals(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit, truncated_total, docs_cut) for any limits, from the suffix sums: the nearest length above a limit decides.

    Limits and lengths meet in blocks; a limit whose block holds no length above it takes its answer from the next block.
    """
    some = limits.select(F.col("limit").cast("long").alias("limit")).filter("limit >= 0").distinct()
    points = some.select(F.col("limit").alias("at"), F.lit(True).alias("asked"), F.lit(None).cast("long").alias("d"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("all"))
    # a length strictly above a limit decides, so lengths sort behind limits of the same value when seen from above
    known = sums.select((F.col("length") - 1).alias("at"), F.lit(False).alias("asked"), F.col("docs_from").alias("d"), F.col("tokens_from").alias("t"), F.col("tokens_all").alias("all"))
    both = points.union(known).withColumn("block", F.floor(F.col("at") / BLOCK))
    order = [F.desc("at"), F.col("asked")]
    inside = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.when(~F.col("asked"), F.struct("d", "t"))
    both = both.withColumn("hit", F.last(pick, ignorenulls=True).over(inside))
    low = both.filter("not asked").groupBy("block").agg(F.min_by(F.struct("d", "t"), "at").alias("low"), F.max("all").alias("all"))
    blocks = low.join(both.select("block").distinct(), "block", "right")
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.last("low", ignorenulls=True).over(above).alias("next"), F.max("all").over(every).alias("total"))
    got = both.filter("asked").join(blocks, "block").withColumn("hit", F.coalesce("hit", "next"))
    d, t = F.coalesce(F.col("hit.d"), F.lit(0)), F.coalesce(F.col("hit.t"), F.lit(0))
    total = F.coalesce("total", F.lit(0))
    return got.select(F.col("at").alias("limit"), (total - t + d * F.col("at")).alias("truncated_total"), d.alias("docs_cut"))


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least that share of the documents doesn't exceed."""
    picks = [F.min(F.when(F.col("share_upto") >= s, F.col("length"))).alias(f"q{i}") for i, s in enumerate(shares)]
    row = sums.agg(*picks)
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("length")) for i, s in enumerate(shares)])
    return row.select(F.explode(pairs).alias("r")).select("r.*")
