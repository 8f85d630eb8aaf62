"""Lexical top-k that reads only those postings that can matter.

Postings are stored by block, token and level: a block is a batch of chunks, a level holds the postings whose weight (what a posting
adds for an idf of one) lies in the same 1/``LEVELS`` step, and its greatest weight is kept beside it. What a question asks for goes
to the postings and the texts, which stay where they are; only the lists that are read meet, those of a block in one task, and that
passes on what can still be among the first k. A search goes in four steps:

1. a question's rare tokens are read whole, and the ``HEAD`` k best texts by them scored in full from their own terms: the k-th of
   these scores is a threshold;
2. of the frequent tokens, as many weak ones as can't reach the threshold together are not read at all, and of the others
   only those levels whose greatest weight, with the most that the other frequent tokens could add, reaches it: a text
   without a rare token that lies in no such level can't be among the first k;
3. texts found so far whose sum, with the most that skipped levels could add, reaches the threshold are kept;
4. those that may have lost something to a skipped level are scored from their own terms.

The ranks are those of a search of all postings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import tokenize
from lodestack.operators import search
from lodestack.operators.search import K1, B, Bm25Index, sent, top_k
from lodestack.sources.shared import cut

#: Steps of the weight; share of a question's postings that is read first; texts scored first, by k; how much of the threshold weak
#: tokens may make up, and skipped levels must miss it by: lower values read more postings and score fewer texts; rounding.
LEVELS, RARE_SHARE, HEAD, WEAK, KEEP, SLACK = 32, 0.2, 2, 0.5, 0.7, 2e-6


def weight(tf, dl, avgdl):
    """Of columns or of arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


class LevelIndex:
    """Beside a lexical index, whose chunks and terms are used: ``postings`` (block, token, level, n, most, chunk_ids, ws) and
    ``levels`` (token, level, n, most).
    """

    def __init__(self, index: Bm25Index, postings: DataFrame, levels: DataFrame):
        self.index, self.postings, self.levels = index, postings, levels

    @staticmethod
    def build(index: Bm25Index, path: str) -> LevelIndex:
        """Written below ``path`` from a stored index. A task turns its own chunks over, batch by batch: only the counts of levels are shuffled."""
        rows, keys = index.docs.crossJoin(F.broadcast(index.totals.select("avgdl"))), dict(index.docs.dtypes)["chunk_id"]  # one row of totals
        turned = rows.mapInArrow(_turned, f"block {keys}, token string, level int, n bigint, most double, chunk_ids array<{keys}>, ws array<double>")
        turned.write.mode("overwrite").parquet(f"{path}/postings")
        stored = index.docs.sparkSession.read.parquet(f"{path}/postings")
        stored.groupBy("token", "level").agg(F.sum("n").alias("n"), F.max("most").alias("most")).write.mode("overwrite").parquet(f"{path}/levels")
        return LevelIndex.load(index, path)

    @staticmethod
    def load(index: Bm25Index, path: str) -> LevelIndex:
        spark = index.docs.sparkSession
        return LevelIndex(index, *(spark.read.parquet(f"{path}/{t}") for t in ("postings", "levels")))


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks' terms as lists of postings, a row a token and level. Each batch is a block, named by its first chunk."""
    for b in batches:
        names, lists = b.column("chunk_id"), b.column("terms")
        flat = lists.flatten()
        if not len(flat):
            continue
        chunk = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        tf, dl, avgdl = flat.field("tf"), b.column("dl"), b.column("avgdl")
        w = weight(tf.to_numpy(zero_copy_only=False), dl.to_numpy(zero_copy_only=False)[chunk], avgdl[0].as_py())
        token = flat.field("token").dictionary_encode()
        level = np.floor(w * LEVELS).astype(np.int64)
        width = level.max() + 1
        key = token.indices.to_numpy(zero_copy_only=False) * width + level
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(first, len(key)).astype(np.int32)
        token, level = token.dictionary.take(pa.array(key[first] // width)), pa.array((key[first] % width).astype(np.int32))
        ids, ws = (pa.ListArray.from_arrays(pa.array(ends), x) for x in (names.take(pa.array(chunk[order])), pa.array(w)))
        block = names.take(pa.array(np.zeros(len(first), np.int64)))
        columns = [block, token, level, pa.array(np.diff(ends).astype(np.int64)), pa.array(np.maximum.reduceat(w, first)), ids, ws]
        yield pa.RecordBatch.from_arrays(columns, ["block", "token", "level", "n", "most", "chunk_ids", "ws"])


def _block_sums(shared, k: int) -> Callable[[pa.Table], pa.Table]:
    """For applyInArrow over a block's lists: (query_id, chunk_id, score, more) of its chunks that may be among the first k.

    ``shared`` holds what is asked (query_id, token, f, since: the lowest level that is read, skipped: the most that a lower one adds)
    and bounds (query_id, least, all_skipped). ``score`` sums what is read, ``more`` is the most that skipped levels could add. A
    chunk is kept if both together reach ``least`` and the k-th score of the block.
    """

    def sums(lists: pa.Table) -> pa.Table:
        asked, bounds = shared.value
        queries, q = _coded(asked.column("query_id"))
        tokens, t = _coded(asked.column("token"))
        order = np.argsort(t, kind="stable")
        askers, f, since, skipped = q[order], *(asked.column(c).to_numpy()[order] for c in ("f", "since", "skipped"))
        counts = np.bincount(t, minlength=len(tokens))
        starts, n_q = np.cumsum(counts) - counts, len(queries)
        least, all_skipped = np.full(n_q, -np.inf), np.zeros(n_q)
        at = pc.index_in(search._whole(bounds.column("query_id")), value_set=queries)
        met = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        at = at.fill_null(-1).to_numpy(zero_copy_only=False)[met]
        least[at], all_skipped[at] = (bounds.column(c).to_numpy()[met] for c in ("least", "all_skipped"))
        ids, ws = (search._whole(lists.column(c)) for c in ("chunk_ids", "ws"))
        size = pc.list_value_length(ws).to_numpy(zero_copy_only=False)
        names, doc = _coded(ids.flatten())
        term = np.repeat(pc.index_in(search._whole(lists.column("token")), value_set=tokens).to_numpy(zero_copy_only=False), size)
        by = np.lexsort((term, doc))  # equal texts are summed in one order
        term, doc, w, level = term[by], doc[by], ws.flatten().to_numpy(zero_copy_only=False)[by], np.repeat(lists.column("level").to_numpy(), size)[by]
        block, found = max(1, search.LEXICAL_CELLS // n_q), []
        for begin in range(0, len(names), block):
            lo, hi = np.searchsorted(doc, (begin, begin + block))
            n, width = counts[term[lo:hi]], min(block, len(names) - begin)
            row = np.repeat(np.arange(lo, hi), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + starts[term[row]]
            read = level[row] >= since[at]
            row, at = row[read], at[read]
            cell, cells = askers[at] * width + doc[row] - begin, n_q * width
            score = np.bincount(cell, f[at] * w[row], cells).reshape(n_q, width)
            more = all_skipped[:, None] - np.bincount(cell, skipped[at], cells).reshape(n_q, width)
            who, which = np.nonzero((np.bincount(cell, minlength=cells).reshape(n_q, width) > 0) & (score + more >= least[:, None]))
            found.append((who, begin + which, score[who, which], more[who, which]))
        who, which, score, more = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((-score, who))
        last = by[np.arange(len(by)) - np.searchsorted(who[by], who[by]) == k - 1]
        now = np.full(n_q, -np.inf)
        now[who[last]] = score[last] - SLACK
        kept = score + more >= now[who]
        columns = [queries.take(pa.array(who[kept])), names.take(pa.array(which[kept])), pa.array(score[kept]), pa.array(more[kept])]
        return pa.Table.from_arrays(columns, ["query_id", "chunk_id", "score", "more"])

    return sums


def _coded(column) -> tuple[pa.Array, np.ndarray]:
    """A column's distinct values, and each row's place among them."""
    made = search._whole(column).dictionary_encode()
    return made.dictionary, made.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _threshold(sums: DataFrame, k: int, name: str) -> DataFrame:
    """(query_id, name): the k-th best sum of each question that has so many."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    return sums.select("query_id", "score", F.row_number().over(order).alias("_n")).filter(F.col("_n") <= k).filter(F.col("_n") == k).select("query_id", (F.col("score") - SLACK).alias(name))


class _Plan:
    """The steps of one search, each table cut where two later ones read it."""

    def __init__(self, questions: DataFrame, index: LevelIndex, k: int, text: str):
        asked = questions.select("query_id", F.explode(tokenize(F.col(text))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
        asked = sent(asked).join(index.index.terms, "token").withColumn("f", F.col("qtf") * F.col("idf"))
        by = Window.partitionBy("query_id")
        upto = by.orderBy("df", "token")
        # sums bound each other only while no token takes away
        rare = (F.row_number().over(upto) == 1) | (F.sum("df").over(upto) <= RARE_SHARE * F.sum("df").over(by)) | (F.min("f").over(by) < 0)
        self.asked = asked = cut(asked.withColumn("rare", rare))
        self.index, zero, never = index, F.lit(0.0), F.lit(float("-inf"))
        rows = asked.filter("rare").select("query_id", "token", "f", F.lit(0).alias("since"), zero.alias("skipped"))
        none = asked.select("query_id", never.alias("least"), zero.alias("all_skipped")).limit(0)
        self.head = head = cut(top_k(self._sums(rows, none, HEAD * k), HEAD * k).select("query_id", "chunk_id"))
        first = cut(_threshold(self._scored(head), k, "least"))
        levels = sent(asked.filter("not rare")).join(index.levels, "token").withColumn("most", F.col("f") * F.col("most"))
        token = Window.partitionBy("query_id", "token")
        own = levels.select("query_id", "token", "f", "level", "n", "most", F.max("most").over(token).alias("best"))
        # tokens by what they can add at most; ``weak`` is the sum of a token's and of all weaker ones
        tokens = own.select("query_id", "token", "best").distinct()
        tokens = tokens.select("query_id", "token", F.sum("best").over(by).alias("all_best"), F.sum("best").over(by.orderBy("best", "token")).alias("weak"))
        levels = own.join(tokens, ["query_id", "token"]).join(first, "query_id", "left")
        least = F.coalesce("least", never)
        read = (F.col("weak") >= WEAK * least) & (F.col("most") + F.col("all_best") - F.col("best") >= KEEP * least)
        levels = levels.withColumn("read", read)
        skipped = F.coalesce(F.max(F.when(~F.col("read"), F.col("most"))).over(token), zero)
        self.levels = levels = cut(levels.withColumn("skipped", skipped).select("query_id", "token", "f", "level", "n", "read", "skipped"))
        # a level adds more than those below it, so what is read of a token begins at one
        frequent = levels.filter("read").groupBy("query_id", "token").agg(F.first("f").alias("f"), F.min("level").alias("since"), F.first("skipped").alias("skipped"))
        total = levels.select("query_id", "token", "skipped").distinct().groupBy("query_id").agg(F.sum("skipped").alias("all_skipped"))
        bounds = first.join(total, "query_id", "full").select("query_id", least.alias("least"), F.coalesce("all_skipped", zero).alias("all_skipped"))
        sums = cut(self._sums(rows.union(frequent), bounds, k))
        kept = sums.join(_threshold(sums, k, "now"), "query_id", "left").filter(F.col("score") + F.col("more") >= F.coalesce("now", never))
        self.whole = kept.filter(F.col("more") <= SLACK / 2).select("query_id", "chunk_id", "score")
        self.unsure = kept.filter(F.col("more") > SLACK / 2).select("query_id", "chunk_id")
        self.again = self._scored(self.unsure)

    def _sums(self, asked: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, score, more) as the blocks pass them on; only lists that a question reads go to their block's task."""
        wanted, kinds = sent(asked.groupBy("token").agg(F.min("since").alias("since"))), dict(asked.dtypes)
        lists = self.index.postings.join(wanted, "token").filter("level >= since").select("block", "token", "level", "chunk_ids", "ws")
        shared = asked.sparkSession.sparkContext.broadcast((asked.toArrow(), bounds.toArrow()))
        return lists.groupBy("block").applyInArrow(_block_sums(shared, k), f"query_id {kinds['query_id']}, chunk_id {dict(lists.dtypes)['block']}, score double, more double")

    def _scored(self, pairs: DataFrame) -> DataFrame:
        """Full scores of (query_id, chunk_id) from the chunks' own terms."""
        docs, totals, asked = self.index.index.docs, self.index.index.totals, self.asked.select("query_id", "token", "f")
        terms = sent(pairs).join(docs, "chunk_id").select("query_id", "chunk_id", "dl", F.explode("terms").alias("t")).select("query_id", "chunk_id", "dl", "t.*")
        scored = terms.join(sent(asked), ["query_id", "token"]).crossJoin(F.broadcast(totals.select("avgdl")))  # one row
        return scored.groupBy("query_id", "chunk_id").agg(F.sum(F.col("f") * weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))


def _plans(questions: DataFrame, index: LevelIndex, k: int, text: str) -> list[_Plan]:
    """A plan for each pass of ``ASKED_ROWS`` question tokens, which go to the tasks."""
    passes = max(1, -(-questions.select(F.explode(tokenize(F.col(text)))).count() // search.ASKED_ROWS))
    of = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    return [_Plan(questions if passes == 1 else questions.filter(of == i), index, k, text) for i in range(passes)]


def level_search(questions: DataFrame, index: LevelIndex, k: int = 20, text: str = "question") -> DataFrame:
    """(query_id, chunk_id, score, rank) as :func:`lodestack.operators.search.bm25_search` returns them."""
    scored = reduce(DataFrame.union, [plan.whole.union(plan.again) for plan in _plans(questions, index, k, text)])
    return top_k(scored.withColumn("score", F.round("score", 6)), k)


def reading_report(questions: DataFrame, index: LevelIndex, k: int = 20, text: str = "question") -> DataFrame:
    """(query_id, postings, postings_read, texts_read): what the tokens have, what was read of it, and texts scored by their terms."""
    return reduce(DataFrame.union, [_report(plan) for plan in _plans(questions, index, k, text)])


def _report(plan: _Plan) -> DataFrame:
    every = plan.asked.groupBy("query_id").agg(F.sum("df").alias("postings"), F.sum(F.when(F.col("rare"), F.col("df")).otherwise(0)).alias("rare_read"))
    frequent = plan.levels.filter("read").groupBy("query_id").agg(F.sum("n").alias("more_read"))
    texts = plan.unsure.union(plan.head).groupBy("query_id").agg(F.count("*").alias("texts_read"))
    out = every.join(frequent, "query_id", "left").join(texts, "query_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("query_id", "postings", (F.col("rare_read") + F.coalesce("more_read", zero)).alias("postings_read"), F.coalesce("texts_read", zero).alias("texts_read"))
