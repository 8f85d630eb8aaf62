"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word as the quality, mixing and near-duplicate contracts define it: no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2. A null id counts as held out: nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local session may go without and gets a temporary one; on a
    cluster a machine-local folder would be lost with its machine, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut through the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def cut_clean(df: DataFrame) -> DataFrame:
    """As ``cut``, and the shuffle files of the step go as soon as it is written; else they stay until the driver happens to
    collect its garbage, so that a job of many steps holds the files of all of them.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return cut(df.select("*"))  # planned anew, so under the setting
    finally:
        conf.set(key, before)


def apply_struct(df: DataFrame, udf, inputs: list[Column], keep: list[Column]) -> DataFrame:
    """``keep`` columns, then the fields of the struct that the vectorised ``udf`` makes of ``inputs``.

    Only the named columns are read, so further columns of ``df`` never clash with the result's.
    """
    out = df.select(*keep, udf(*inputs).alias("_made"))
    return out.select(*[c for c in out.columns if c != "_made"], "_made.*")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet (Spark compares names without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def sample_by_class(rows: DataFrame, label: str, text: str, per_class: int, max_rows: int) -> DataFrame:
    """(label, text) of at most ``per_class`` distinct texts of each label, and of all of a label that has no more.

    With more than ``max_rows / per_class`` labels each gets an equal share of ``max_rows``, one text at least. Copies of a
    text count once, however many there are. A narrow job estimates the distinct texts of each label for a hash threshold
    that leaves half as many again as wanted; the hashes under it are made distinct and cut, so no label is gathered into
    one task however frequent it is. Texts come in at the end, by a join with the hashes that were chosen.
    """
    pair = [F.col(label).alias("_label"), F.xxhash64(F.col(text), F.lit(17)).alias("_hash")]
    hashed = rows.select(*pair)
    counts = hashed.groupBy("_label").agg(F.approx_count_distinct("_hash")).collect()
    wanted = max(1, min(per_class, max_rows // max(1, len(counts))))
    shares = [(r[0], min(1.0, (1.5 * wanted + 50) / max(1, r[1]))) for r in counts]
    kind = hashed.schema["_label"].dataType.simpleString()
    drawn = hashed.join(F.broadcast(rows.sparkSession.createDataFrame(shares, f"_label {kind}, _share double")), "_label")
    drawn = drawn.filter(F.pmod("_hash", F.lit(1 << 40)) / float(1 << 40) < F.col("_share")).select("_label", "_hash").distinct()
    nth = F.row_number().over(Window.partitionBy("_label").orderBy(F.pmod("_hash", F.lit(1 << 40)), "_hash"))
    chosen = drawn.withColumn("_nth", nth).filter(F.col("_nth") <= wanted).select("_label", "_hash")  # wanted rows a label, so it may be broadcast
    texts = rows.select(*pair, F.col(text).alias("_text")).join(F.broadcast(chosen), ["_label", "_hash"])
    return texts.groupBy("_label", "_hash").agg(F.min("_text").alias("_text")).select(F.col("_label").alias(label), F.col("_text").alias(text))


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` range-partitioned and sorted by ``order``, null first, with ``_part`` and ``_row``: the partition and the
    place in it, both ascending with the order. Rows that agree in all of ``order`` are told apart by where they were read,
    so that copies of one row spread over as many partitions as they fill. Written once, so the places stay as they are.
    """
    tie = fresh(rows, "_tie")
    keys = [F.col(c).asc_nulls_first() for c in order] + [F.col(tie).asc()]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    placed = dealt.withColumn("_part", F.shiftright(place, 33)).withColumn("_row", place.bitwiseAND((1 << 33) - 1))
    return cut(placed.drop(tie))
