"""Approximate dense search over a stored inverted file with product codes.

Vectors lie in lists by their nearest centroid. Two tables are partitioned by list: ``codes`` holds a few bytes a vector (its
difference from the centroid, cut into short parts, each part the number of its nearest code word), ``vectors`` the vectors
themselves. A search reads the codes of the asked lists only, ranks by the decoded vectors, and scores exactly just the best
of them, whose lists are again the only ones that are read of ``vectors``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.search import centroids_of, dense_search, passes, task_best, top_k
from lodestack.sources.shared import cut

#: Dimensions of a part, code words of a part, most lists (folders of a table), vectors that centroids and words are fitted on.
PART, WORDS, LISTS, SAMPLE = 4, 256, 4096, 20_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _near(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Nearest centers by distance."""
    return ((centers**2).sum(1)[None] - 2 * x @ centers.T).argmin(1)


def code_words(x: np.ndarray, part: int = PART, words: int = WORDS, rounds: int = 8) -> np.ndarray:
    """(parts, words, part) by k-means over the rows of ``x``, whose width is filled up with zeros."""
    parts = -(-x.shape[1] // part)
    x = np.pad(x, ((0, 0), (0, parts * part - x.shape[1]))).reshape(len(x), parts, part)
    out = np.zeros((parts, words, part))
    for m in range(parts):
        own = x[:, m]
        distinct = np.unique(own, axis=0)
        centers = distinct[np.linspace(0, max(0, len(distinct) - 1), min(words, len(distinct))).astype(int)] if len(distinct) else np.zeros((1, part))
        for _ in range(rounds if len(distinct) > words else 0):
            near = _near(own, centers)
            sums, n = np.zeros_like(centers), np.bincount(near, minlength=len(centers))
            np.add.at(sums, near, own)
            centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        out[m, : len(centers)], out[m, len(centers) :] = centers, centers[:1]
    return out


class Ivf:
    """``codes`` (list, chunk_id, code) and ``vectors`` (list, chunk_id, embedding) with the centroids and words that made them."""

    def __init__(self, codes: DataFrame, vectors: DataFrame, centroids: np.ndarray, words: np.ndarray):
        self.codes, self.vectors, self.centroids, self.words = codes, vectors, centroids, words

    @staticmethod
    def build(chunks: DataFrame, path: str, n_lists: int | None = None, sample: int = SAMPLE) -> Ivf:
        """The index of all ``chunks`` (chunk_id, embedding), written below ``path``; centroids and words are fitted on a sample.

        There are some four lists for each root of the number of vectors, ``LISTS`` at most. Rows are dealt out by list and
        id, so a list of many vectors, or of copies of one, is written by several tasks.
        """
        spark = chunks.sparkSession
        n = chunks.count()
        n_lists = n_lists or int(min(LISTS, max(16, 4 * math.sqrt(n))))
        centroids, drawn = centroids_of(chunks, n_lists, sample)
        drawn = _unit(drawn)
        words = code_words(drawn - centroids[(drawn @ centroids.T).argmax(1)] if len(drawn) else drawn.reshape(0, centroids.shape[1]))
        made = _encoder(spark.sparkContext.broadcast((centroids, words)))
        placed = chunks.select("chunk_id", "embedding", made("embedding").alias("_m")).select("chunk_id", "embedding", "_m.list", "_m.code")
        placed = cut(placed.repartitionByRange("list", "chunk_id").sortWithinPartitions("list", "chunk_id"))
        placed.select("list", "chunk_id", "code").write.mode("overwrite").partitionBy("list").parquet(f"{path}/codes")
        placed.select("list", "chunk_id", "embedding").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
        flat = [("centroid", i, 0, c.tolist()) for i, c in enumerate(centroids)] + [("word", m, w, v.tolist()) for m, book in enumerate(words) for w, v in enumerate(book)]
        spark.createDataFrame(flat, "kind string, i int, j int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        return Ivf.load(spark, path, chunks.schema)

    @staticmethod
    def load(spark: SparkSession, path: str, schema) -> Ivf:
        """``schema`` tells the types of chunk_id and embedding, which an index of no vector doesn't hold."""
        model = sorted(map(tuple, spark.read.parquet(f"{path}/model").collect()))  # bounded by LISTS and WORDS
        centroids = np.array([r[3] for r in model if r[0] == "centroid"], float)
        words = np.array([r[3] for r in model if r[0] == "word"], float).reshape(-1, WORDS, PART)
        kind = {f.name: f.dataType.simpleString() for f in schema}
        read = lambda name, of: spark.read.schema(f"chunk_id {kind['chunk_id']}, {of}, list int").parquet(f"{path}/{name}")
        return Ivf(read("codes", "code binary"), read("vectors", f"embedding {kind['embedding']}"), centroids, words)

    def decode(self, rows: pd.DataFrame) -> np.ndarray:
        """What the codes say of the vectors."""
        parts = len(self.words)
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), parts)
        near = self.words[np.arange(parts), codes].reshape(len(rows), -1)[:, : self.centroids.shape[1]]
        return self.centroids[rows["list"].to_numpy(int)] + near


def _encoder(shared):
    @F.pandas_udf("list int, code binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        centroids, words = shared.value
        for vectors in batches:
            x = _unit(np.array(vectors.tolist(), float).reshape(len(vectors), -1))
            if not len(x):
                yield pd.DataFrame({"list": [], "code": []}).astype({"list": "int32"})
                continue
            own = (x @ centroids.T).argmax(1)
            rest = x - centroids[own]
            rest = np.pad(rest, ((0, 0), (0, len(words) * PART - rest.shape[1]))).reshape(len(x), len(words), PART)
            codes = np.stack([_near(rest[:, m], words[m]) for m in range(len(words))], 1).astype(np.uint8)
            yield pd.DataFrame({"list": own.astype("int32"), "code": [c.tobytes() for c in codes]})

    return made


def candidates(questions: DataFrame, index: Ivf, wanted: int, share: float = 0.6) -> DataFrame:
    """(query_id, chunk_id, list, rank): each question's best ``wanted`` by decoded vectors, of its nearest ``share`` of the lists."""
    spark = questions.sparkSession
    ids, keys = dict(questions.dtypes)["query_id"], dict(index.codes.dtypes)["chunk_id"]
    schema, found = f"query_id {ids}, chunk_id {keys}, score double, list int", None
    n_probed = max(1, math.ceil(share * len(index.centroids)))
    decoder = spark.sparkContext.broadcast(Ivf(None, None, index.centroids, index.words))
    for names, vectors in passes(questions):
        if vectors.shape[1] != index.centroids.shape[1]:
            continue  # an index of no vectors
        probes = np.argsort(-(vectors @ index.centroids.T), axis=1, kind="stable")[:, :n_probed]
        asked = np.unique(probes).tolist()
        rows = index.codes if len(asked) == len(index.centroids) else index.codes.filter(F.col("list").isin(asked))  # folders that are read
        best = rows.mapInPandas(task_best(spark.sparkContext.broadcast((names, vectors, probes)), "cosine", wanted, lambda r: decoder.value.decode(r), "list"), schema)
        found = best if found is None else found.union(best)
    return top_k(spark.createDataFrame([], schema) if found is None else found, wanted).select("query_id", "chunk_id", "list", "rank")


def ivf_search(questions: DataFrame, index: Ivf, k: int = 20, share: float = 0.6, rescored: int | None = None) -> DataFrame:
    """Approximate (query_id, chunk_id, score, rank) by cosine; every score is exact.

    ``rescored`` candidates of each question (by default six for each hit, 64 at least) are scored by their vectors.
    Questions that find fewer than ``k`` in their lists are answered by the exact search over all vectors. Where all lists are
    asked and every vector is a candidate, codes can leave none out: the tasks then score the stored vectors and pass on their
    best only, instead of a row for each question and vector.
    """
    if share >= 1 and rescored is not None and rescored >= index.codes.count():
        return dense_search(questions, index.vectors.select("chunk_id", "embedding"), k)
    best = cut(candidates(questions, index, rescored or max(64, 6 * k), share))
    full = best.filter(F.col("rank") == k).select("query_id")
    asked = questions.select("query_id", F.col("embedding").alias("_q"))
    met = best.join(full, "query_id", "left_semi").select("query_id", "chunk_id", "list").join(index.vectors, ["list", "chunk_id"]).join(asked, "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    score = dot("_q", "embedding") / F.greatest(F.sqrt(dot("_q", "_q")) * F.sqrt(dot("embedding", "embedding")), F.lit(1e-12))
    hits = top_k(met.select("query_id", "chunk_id", F.round(score, 6).alias("score")), k)
    short = questions.join(full, "query_id", "left_anti")
    return hits if short.isEmpty() else hits.unionByName(dense_search(short, index.vectors.select("chunk_id", "embedding"), k))
