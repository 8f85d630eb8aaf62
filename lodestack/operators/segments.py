"""A lexical index that is kept up: segments, tombstones, document frequencies as deltas, and compaction.

Each change writes one segment (never an old file): the new chunks' terms by chunk, and the ids that void rows
of older segments. Document frequencies change by what the segment adds less what it voids, so a change counts the terms of
the chunks that it replaces and of no other old ones. A version, written last, names the segments that count;
until it is there, readers see the one before, so a job that is lost halfway leaves the index as it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.search import Bm25Index, chunk_terms, sent


class SegmentedIndex:
    """An index below ``path``; :meth:`view` is the :class:`Bm25Index` that its last version stands for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def create(spark: SparkSession, path: str, chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> SegmentedIndex:
        index = SegmentedIndex(spark, path)
        index._write([], chunks, None, key, text)
        return index

    def _read(self, segment: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{segment}/{table}")

    def version(self) -> tuple[int, list[str]]:
        """The last version's number and its segments, oldest first; a row a segment."""
        rows = self.spark.read.parquet(f"{self.path}/versions").collect()
        last = max(r["version"] for r in rows)
        return last, [r["segment"] for r in sorted(rows, key=lambda r: r["place"]) if r["version"] == last]

    def _live(self, segments: list[str], table: str) -> DataFrame:
        """Rows of a table of all segments that no later segment voids."""
        parts = []
        for i, s in enumerate(segments):
            rows = self._read(s, table)
            if later := [self._read(x, "void") for x in segments[i + 1 :]]:
                void = reduce(DataFrame.union, later).distinct()
                rows = rows.join(sent(void), "chunk_id", "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    def _write(self, segments: list[str], chunks: DataFrame, removed: DataFrame | None, key: str, text: str) -> None:
        number = self.version()[0] + 1 if segments else 0
        name = f"segment-{number}"
        out = lambda df, table: df.write.mode("overwrite").parquet(f"{self.path}/{name}/{table}")
        out(chunk_terms(chunks, key, text), "terms")  # a chunk's distinct terms, written where the chunk is
        terms = self._read(name, "terms")
        ids = terms.select("chunk_id") if removed is None else terms.select("chunk_id").union(removed.select("chunk_id")).distinct()
        old = self._live(segments, "terms") if segments else terms.limit(0)
        out(old.select("chunk_id").join(sent(ids), "chunk_id", "left_semi"), "void")
        old = old.join(sent(self._read(name, "void")), "chunk_id", "left_semi")
        void = old.select(F.explode("terms.token").alias("token"), F.lit(-1).alias("by"))
        added = terms.select(F.explode("terms.token").alias("token"), F.lit(1).alias("by"))
        out(added.union(void).groupBy("token").agg(F.sum("by").alias("df")), "df_changes")
        sizes = terms.select("dl", F.lit(1).alias("by")).union(old.select("dl", F.lit(-1).alias("by")))
        out(sizes.agg(F.coalesce(F.sum("by"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("by") * F.col("dl")), F.lit(0)).alias("tokens")), "size_changes")
        self._publish(number, [*segments, name])

    def _publish(self, number: int, segments: list[str]) -> None:
        rows = [(number, i, s) for i, s in enumerate(segments)]
        self.spark.createDataFrame(rows, "version int, place int, segment string").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def merge(self, chunks: DataFrame, removed: DataFrame | None = None, key: str = "chunk_id", text: str = "content") -> None:
        """``chunks`` replace those of equal id or come in anew; ids of ``removed`` (chunk_id) go, if they are there."""
        self._write(self.version()[1], chunks, removed, key, text)

    def compact(self) -> None:
        """All live rows as one segment that voids none. Older segments stay for readers that have begun; then they may go."""
        number, segments = self.version()
        name = f"segment-{number + 1}"
        out = lambda df, table: df.write.mode("overwrite").parquet(f"{self.path}/{name}/{table}")
        out(self._live(segments, "terms").repartitionByRange("chunk_id").sortWithinPartitions("chunk_id"), "terms")
        out(self._read(name, "terms").select("chunk_id").limit(0), "void")
        out(self._read(name, "terms").select(F.explode("terms.token").alias("token")).groupBy("token").agg(F.count("*").alias("df")), "df_changes")
        out(self._read(name, "terms").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("tokens")), "size_changes")
        self._publish(number + 1, [name])

    def void_share(self) -> float:
        """Share of stored chunks that are void: when it is high, :meth:`compact` pays."""
        _, segments = self.version()
        stored = reduce(DataFrame.union, [self._read(s, "terms").select("chunk_id") for s in segments]).count()
        void = reduce(DataFrame.union, [self._read(s, "void") for s in segments]).count()
        return void / max(1, stored)

    def view(self) -> Bm25Index:
        """What a fresh index of the live chunks would be. Term statistics come from the deltas, not from the chunks."""
        _, segments = self.version()
        every = lambda table: reduce(DataFrame.unionByName, [self._read(s, table) for s in segments])
        totals = every("size_changes").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).select("n", (F.col("tokens") / F.col("n")).alias("avgdl"))
        df = every("df_changes").groupBy("token").agg(F.sum("df").alias("df")).filter("df > 0")
        return Bm25Index.of(self._live(segments, "terms"), totals, df)
