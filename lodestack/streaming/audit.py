"""Continuous audit and alert streams, and behaviour features from an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.operators.risk import alert_events, audit_events


def audit_stream(rows: DataFrame, stage: str = "response") -> DataFrame:
    """Audit events of a streaming table of answer rows: stateless, so append mode and any sink."""
    return audit_events(rows, stage)


def alert_stream(rows: DataFrame) -> DataFrame:
    return alert_events(rows)


def start_audit(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Audit events and alerts of a stream as two Parquet tables; a batch that is written again replaces nothing twice.

    Each batch goes to a folder of its own number, so a replay after a lost driver overwrites it.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        audit_events(batch).write.mode("overwrite").parquet(f"{path}/audit/batch={n}")
        alert_events(batch).write.mode("overwrite").parquet(f"{path}/alerts/batch={n}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def behaviour_stream(events: DataFrame, late: str = "1 hour", window: str = "24 hours", slide: str = "12 hours") -> DataFrame:
    """Sliding counts per user of an event stream (ts, user_id, event_type), rows later than ``late`` dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", window, slide), "user_id")
    return grouped.agg(F.count("*").alias("query_count"), F.count_if(F.col("event_type") == "error").alias("failed_count")).select("user_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "query_count", "failed_count")


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user with their event counts. A late row that the watermark still lets in may touch a session that was put
    out before; it then begins one of its own, and :func:`joined_sessions` makes one of both."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("session_query_count"))
    w = F.col("session_window")
    return grouped.select("user_id", w["start"].alias("session_start"), w["end"].alias("session_end"), "session_query_count")


def joined_sessions(pieces: DataFrame, still_open: DataFrame | None = None) -> DataFrame:
    """Sessions of which the next begins before (or when) one ends are one. ``still_open`` (columns as ``pieces``) are those that a
    stream hasn't put out yet: what they touch isn't over, so neither is part of the result."""
    rows = pieces.withColumn("_open", F.lit(False))
    if still_open is not None:
        rows = rows.unionByName(still_open.withColumn("_open", F.lit(True)))
    by = Window.partitionBy("user_id").orderBy("session_start", "session_end")
    ended = F.max("session_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("session_start") <= ended, 0).otherwise(1))
    rows = rows.withColumn("_no", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = rows.groupBy("user_id", "_no").agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("session_query_count").alias("session_query_count"), F.bool_or("_open").alias("_open"))
    return whole.filter("not _open").select("user_id", "session_start", "session_end", "session_query_count")


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that a stopped stream of :func:`session_stream` still holds, read from the state below its checkpoint."""
    w = F.col("value.session_window")
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("value.user_id", w["start"].alias("session_start"), w["end"].alias("session_end"), F.col("value.count").alias("session_query_count"))


HOUR, DAY = 3600, 24


def behaviour_features(events: DataFrame, risky: tuple[str, ...] = (), failed: tuple[str, ...] = ()) -> DataFrame:
    """Per event the inputs of the risk hint: 24-hour count, 7-day risky share and failures, seconds since the last event.

    A user's events are dealt out by hour, so that no task sorts more than an hour of a user, however many events that user
    has. A range that ends at an event begins inside the hour a day (or a week) before: the sums of the hours between come
    from a table of one row for each user and hour, the rest from that first hour's events, which are told to the last hour
    with their time moved on by the range's length. Events of equal time count for each other. Those without a time are
    counted among themselves; the seconds since a first event, or one without a time, are 60.
    """
    is_ = lambda kinds: F.col("event_type").isin(*kinds) if kinds else F.lit(False)
    one = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = events.select("event_id", "user_id", t.alias("t"), F.lit(1).cast("long").alias("n"), one(is_(risky)).alias("risky"), one(is_(failed)).alias("failed"), one(is_(risky).isNotNull()).alias("typed"))
    e = e.withColumn("hour", F.floor(F.col("t") / HOUR).cast("long"))
    own = e.withColumns({"age": F.lit(0), "s": F.col("t")})
    told = [e.filter("t is not null").withColumns({"age": F.lit(h), "s": F.col("t") + h * HOUR, "hour": F.col("hour") + h}) for h in (DAY, 7 * DAY)]
    rows = own.union(told[0]).union(told[1])

    by = Window.partitionBy("user_id", "hour")
    upto, under = by.orderBy("s").rangeBetween(Window.unboundedPreceding, 0), by.orderBy("s").rangeBetween(Window.unboundedPreceding, -1)

    def ranged(name: str, age: int) -> Column:
        """Own events up to this one, and those of the range's first hour that are not older than the range."""
        first = F.when(F.col("age") == age, F.col(name))
        return F.coalesce(F.sum(F.when(F.col("age") == 0, F.col(name))).over(upto), F.lit(0)) + F.coalesce(F.sum(first).over(by), F.lit(0)) - F.coalesce(F.sum(first).over(under), F.lit(0))

    before = F.lag("t").over(Window.partitionBy("user_id", "hour", "age").orderBy("t", "event_id"))
    rows = rows.select("*", before.alias("last"), ranged("n", DAY).alias("day_n"), *[ranged(c, 7 * DAY).alias(f"week_{c}") for c in ("typed", "risky", "failed")]).filter("age = 0")

    hours = e.groupBy("user_id", "hour").agg(*[F.sum(c).alias(c) for c in ("n", "typed", "risky", "failed")], F.max("t").alias("latest"))
    back = Window.partitionBy("user_id").orderBy("hour")  # a user's hours
    between = lambda c, h: F.when(F.col("hour").isNull(), 0).otherwise(F.coalesce(F.sum(c).over(back.rangeBetween(1 - h, -1)), F.lit(0)))
    hours = hours.select(F.col("user_id").alias("_u"), F.col("hour").alias("_h"), F.lag("latest").over(back).alias("latest"), between("n", DAY).alias("day_more"), *[between(c, 7 * DAY).alias(f"more_{c}") for c in ("typed", "risky", "failed")])
    out = rows.join(hours, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("hour").eqNullSafe(F.col("_h")))
    total = lambda c: (F.col(f"week_{c}") + F.col(f"more_{c}")).cast("double")
    return out.select(
        "event_id", "user_id", (F.col("day_n") + F.col("day_more")).cast("double").alias("past_24h_query_count"), F.round(total("risky") / F.nullif(total("typed"), F.lit(0.0)), 6).alias("high_risk_ratio_7d"),
        F.when(total("typed") > 0, total("failed")).alias("failed_auth_count_7d"), F.coalesce((F.col("t") - F.coalesce("last", "latest")).cast("double"), F.lit(60.0)).alias("query_interval_sec"),
    )
