"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line with more than white space, its blanks folded) is hashed to a wide vector; a text's fingerprint is the
sum of its paragraphs' vectors, each lane modulo a power of two. So the order of paragraphs doesn't matter, and
inserting or deleting one is an addition or subtraction. The vector has two parts:

- ``EQUAL`` lanes of 32 bits, uniform from the paragraph's 1024-bit hash: equal multisets, and in practice only those,
  agree in all of them.
- ``LIKE`` lanes of 32 bits, read as signed numbers, in which each run of three words of the paragraph adds +1 or -1 to
  one lane. They estimate how large two multisets and their difference are. A lane wraps only when its runs of one
  sign outweigh the others by 2^31, so no text of under four billion characters can wrap one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import apply_struct

EQUAL, LIKE, RUN = 32, 256, 3
_WORD_LIMIT = 100_000
#: Characters of a block of neighbouring documents (in the mean, at least), most blocks (in the mean), blocks of a task, and rows
#: of a result batch.
BLOCK_CHARS, MOST_BLOCKS, BLOCKS_PER_TASK, OUT_ROWS = 1 << 21, 1 << 16, 8, 1024


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def paragraphs(text: str | None) -> list[bytes]:
    """Non-blank lines, blanks folded to one."""
    folded = (b" ".join(line.split()) for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"))
    return [p for p in folded if p]


def _wide(paragraph: bytes) -> np.ndarray:
    seeds = (xxhash.xxh3_128_digest(paragraph, seed) for seed in range(EQUAL // 4))
    return np.frombuffer(b"".join(seeds), "<u4")


def _runs(parts: list[bytes], known: dict) -> np.ndarray:
    """Hashes of the word runs inside each paragraph; a shorter paragraph is one run."""
    words = [p.split() for p in parts]
    flat = [w for ws in words for w in ws]
    h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    lens = np.fromiter(map(len, words), np.int64, len(words))
    first = np.repeat(np.cumsum(lens) - lens, lens)
    place, size = np.arange(len(h)) - first, np.repeat(lens, lens)
    total = np.zeros(len(h), np.uint64)
    padded = np.concatenate((h, np.zeros(RUN, np.uint64)))
    for i in range(RUN):
        inside = (place + i < size).astype(np.uint64)
        total = (total ^ (padded[i : i + len(h)] * inside)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(31)
    return total[(place == 0) | (place + RUN <= size)]


def vector(text: str | None, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of a text's fingerprint."""
    known = _Hashes() if known is None else known
    if len(known) > _WORD_LIMIT:
        known.clear()
    parts = paragraphs(text)
    equal = np.zeros(EQUAL, np.uint32)
    for p in parts:
        equal += _wide(p)
    if not parts:
        return equal, np.zeros(LIKE, np.uint32)
    h = _runs(parts, known)
    sign = np.where((h >> np.uint64(20)) & np.uint64(1), 1, -1)
    lanes = np.bincount((h & np.uint64(LIKE - 1)).astype(np.int64), sign, LIKE)
    return equal, lanes.astype(np.int64).astype(np.uint32)


def to_hex(v: tuple[np.ndarray, np.ndarray]) -> str:
    return v[0].astype("<u4").tobytes().hex() + v[1].astype("<u4").tobytes().hex()


def from_hex(s: str) -> tuple[np.ndarray, np.ndarray]:
    b = bytes.fromhex(s)
    return np.frombuffer(b[: 4 * EQUAL], "<u4"), np.frombuffer(b[4 * EQUAL :], "<u4")


def change(fingerprint: str, inserted: str = "", deleted: str = "") -> str:
    """The fingerprint after some paragraphs came and others went, without the rest of the text."""
    base, plus, minus = from_hex(fingerprint), vector(inserted), vector(deleted)
    return to_hex(tuple(b + p - m for b, p, m in zip(base, plus, minus)))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: 1 for equal fingerprints, else twice the estimated inner product over the sum of squares."""
    if np.array_equal(a[0], b[0]):
        return 1.0
    x, y = (v[1].astype(np.uint32).view(np.int32).astype(float) for v in (a, b))
    size = x @ x + y @ y
    return float(np.clip(2 * (x @ y) / size, 0, 1)) if size else 0.0


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many characters from the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _digests():
    names = ["edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    @F.pandas_udf("edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    def digests(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        last: tuple = (None, None)  # a row's next text is often the next row's text
        for texts, following in batches:
            rows = []
            for t, n in zip(texts, following):
                edited = edited_text(t, n)
                v = last[1] if last[0] == t else vector(t, known)
                x, y = vector(edited, known), vector(n, known)
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((sha, to_hex(v), to_hex(x), likeness(v, x), likeness(v, y)))
                last = (n, y)
                if len(rows) == OUT_ROWS:  # results are wide, so they leave in small parts
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return digests


def fingerprints():
    """A vectorised UDF text -> fingerprint in hexadecimal digits; null and blank texts have the zero fingerprint."""

    @F.pandas_udf("string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Hashes()
        for texts in batches:
            yield pd.Series([to_hex(vector(t, known)) for t in texts], dtype=object)

    return digest


def fingerprint_documents(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` (default doc_id) and the fingerprint of every whole text."""
    return docs.select(*(keep or [F.col("doc_id")]), fingerprints()(F.col(text)).alias("fingerprint"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """doc_id, text (null: empty) and next_text, the text of the next document by ascending id; the first follows the last.

    Null ids come first, rows of one id in the order of a hash of their text. A row begins a block with a probability of its
    length over ``block_chars``, drawn from a hash of its place in that order: blocks hold about as many characters
    whatever the ids are (clustered, far apart, null, repeated), and rows of one id may lie in several. Only copies
    of one row, id and text, stay together. The driver keeps the places of the blocks' first rows, three numbers for each
    block; blocks grow once a corpus has more than ``most_blocks`` of them, so these numbers stay under some 2 MB whatever
    the corpus. A block is sorted on disk and streamed, so its size costs no memory. Each row finds its block by binary
    search. A copy of each first row closes the block before, so that a window inside blocks gives every row its next text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    known = F.col("doc_id").isNotNull().cast("int").alias("known")
    rows = rows.withColumn("place", F.struct(known, F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash")))
    drawn = F.pmod(F.xxhash64("place", F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    begins = drawn < F.length("text") / float(max(block_chars, total / most_blocks))
    ends = rows.agg(F.min("place").alias("first"), F.array_sort(F.collect_set(F.when(begins, F.col("place")))).alias("begins")).first()
    bounds = [tuple(b) for b in ends["begins"]]
    place = "struct<known:int,id:bigint,hash:bigint>"
    search = F.broadcast(spark.createDataFrame([(bounds, tuple(ends["first"] or (0, 0, 0)))], f"bounds array<{place}>, first {place}"))  # one row
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(bounds).bit_length())))])
    upto = lambda n: F.coalesce(F.try_element_at("bounds", n) <= F.col("place"), F.lit(False))
    block = F.aggregate(steps, F.lit(0), lambda at, step: F.when(upto(at + step), at + step).otherwise(at))
    placed = rows.crossJoin(search).withColumn("block", block)
    # the first row of a block closes the block before, the first of all the last one
    closed = F.array_compact(F.array(F.when(begins, F.col("block") - 1), F.when(F.col("place") == F.col("first"), len(bounds))))
    closing = placed.filter(F.size(closed) > 0).select(F.explode(closed).alias("block"), "place", "text").groupBy("block").agg(F.min(F.struct("place", "text")).alias("c"))
    closing = closing.select("block", F.col("c.place").alias("place"), F.col("c.text").alias("text"), F.lit(True).alias("closes"))
    all_rows = placed.select("block", "place", "text", F.lit(False).alias("closes")).union(closing)
    tasks = max(1, -(-len(bounds) // BLOCKS_PER_TASK), min(len(bounds), spark.sparkContext.defaultParallelism))
    order = Window.partitionBy("block").orderBy("closes", "place", "text")
    out = all_rows.repartition(tasks, "block").withColumn("next_text", F.lead("text").over(order)).filter("not closes")
    return out.select(F.when(F.col("place.known") == 1, F.col("place.id")).alias("doc_id"), "text", "next_text")


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half (rounded down) of its code points replaced by as many from the start of the next
    document, or all of that if it is shorter. A lone document is its own next one.
    """
    rows = with_next(docs, doc_id, text)
    return apply_struct(rows, _digests(), [F.col("text"), F.col("next_text")], [F.col("doc_id"), F.length("text").cast("long").alias("n_chars")])
