"""Tables that a stream keeps up: FAQ hit counters and the answer cache.

State is keyed and expires by the watermark, so it is bounded by what is live. Each micro-batch writes the rows that it changed to
a folder of its own number; a batch that runs again after a lost driver overwrites its folder, and the newest row of a key
is the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestack.operators.search import cache_key


def hit_counts(hits: DataFrame, late: str = "1 hour") -> DataFrame:
    """(entry_id, hit_count, last_hit_at) of a stream of hits (hit_id, entry_id, hit_at), for update mode.

    A hit that is delivered again counts once; one later than ``late`` is dropped. The ids are kept as long as they can still
    come again, the counters as long as the entries.
    """
    once = hits.withWatermark("hit_at", late).dropDuplicatesWithinWatermark(["hit_id"])
    return once.groupBy("entry_id").agg(F.count("*").alias("hit_count"), F.max("hit_at").alias("last_hit_at"))


#: Groups of keys that the cache's state is kept by: what a batch hands over and stores again costs by group, not by key.
GROUPS = 256
_ENTRY = "key string, answer string, confidence double, t long, ttl_sec long"


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    """The newest row of each key; of one time the greatest answer, then the last row."""
    by = rows.assign(said=rows["answer"].fillna("")).sort_values(["t", "said"])
    return by.drop_duplicates("key", keep="last").drop(columns="said")


def _keep_newest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest answer of each of a group's keys until its time is over; older ones that come later change nothing."""
    names = [x.split()[0] for x in _ENTRY.split(", ")]
    best = pd.read_feather(BytesIO(state.get[0])).assign(new=False) if state.exists else None
    for part in parts:
        rows = part[names]
        if rows[["t", "ttl_sec"]].isna().any(axis=None):
            raise ValueError("an answer needs its written_at and ttl_sec")
        if len(rows):
            best = _newest(rows.assign(new=True) if best is None else pd.concat([rows.assign(new=True), best]))
    if best is None:
        return
    ends = best["t"] // 1000 + best["ttl_sec"] * 1000
    best = best.assign(live=ends > state.getCurrentWatermarkMs())
    if best["live"].any():
        kept = BytesIO()
        best.loc[best["live"], names].reset_index(drop=True).to_feather(kept)
        state.update((kept.getvalue(),))
        state.setTimeoutTimestamp(int(ends[best["live"]].min()) - 1)  # Spark waits until the watermark is beyond it
    elif state.exists:
        state.remove()
    yield best.loc[best["new"] | ~best["live"], [*names, "live"]]


def cache_entries(answers: DataFrame, late: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """(key, answer, confidence, written_at, ttl_sec, live) of a stream of answers (question, answer, confidence, written_at, ttl_sec),
    for update mode: a row when a key's newest answer changes, and one that isn't live when its time is over.

    The watermark ends entries; it drops no answer, as one that comes late may still be its key's newest. A checkpoint belongs to
    its number of ``groups``.
    """
    # each answer comes twice: as a time that moves the watermark and goes no further, and without one, so that it can't be late
    timed = answers.select("*", F.explode(F.array(F.col("written_at").cast("timestamp"), F.lit(None).cast("timestamp"))).alias("clock")).withWatermark("clock", late)
    keyed = timed.filter("clock is null").select("clock", cache_key(F.col("question")).alias("key"), "answer", F.col("confidence").cast("double").alias("confidence"), F.unix_micros(F.col("written_at").cast("timestamp")).alias("t"), F.col("ttl_sec").cast("long").alias("ttl_sec"))
    slots = keyed.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("slot")
    kept = slots.applyInPandasWithState(_keep_newest, f"{_ENTRY}, live boolean", "entries binary", "update", GroupStateTimeout.EventTimeTimeout)
    return kept.select("key", "answer", "confidence", F.timestamp_micros("t").alias("written_at"), "ttl_sec", "live")


def start_table(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Works off what has come (available now) and writes the changed rows of each batch."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of each key."""
    rows = spark.read.parquet(path)
    newest = Window.partitionBy(key).orderBy(F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "batch")
