"""Hard-negative mining by inner product over STR-packed R-trees.

Sort-tile-recursive packing: rows are sorted by the coordinate of widest spread and cut into slabs, each slab by the next
coordinate, and so on, until pages of ``PAGE`` rows are left. The first cut is Spark's range partitioning, the others are
made inside its partitions, so the index is a forest: one R-tree of at most ``TREE`` rows for each piece of a slab, written
once as packed binary rows. Each page and each run of ``FAN`` pages keeps the minimum bounding box of its rows. For an
anchor ``a`` and a box, coordinate ``i`` of a row inside adds between ``min(a_i lo_i, a_i hi_i)`` and the maximum of the two;
their sums bound every inner product in the box.

A task searches one tree for one block of anchors. Each anchor's queue gives the box of the highest possible score first.
A box is left out when none of its scores can lie inside any of the anchor's score windows, or when it lies strictly below
the k-th score of each window that is full; equal scores stay, as ties go to smaller ids. Trees return their own best rows,
and the best of those are the result: exact, whatever the boxes are worth. In many dimensions with no structure they prune
little, and the search costs what a comparison in blocks does.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import cut

PAGE, FAN, TREE, ANCHORS = 256, 16, 1 << 16, 1 << 14
#: Bound of a dot product of whole numbers up to which float64 is exact.
EXACT, LONG = 1 << 53, (1 << 63) - 1
_TREE = "tree long, size long, ids binary, labels binary, rows binary, vectors binary, dims long, pages binary"


def prepared(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part, written once; v holds the components as whole numbers.

    A row without id, label or vector, or with a null or non-finite component, takes no part. Each component becomes
    ``floor(256 x)``. ``row`` tells rows of one id apart: each is a row of its own.
    """
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & fit)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0).cast("long"))
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole.alias("v")))


def tile(points: np.ndarray, order: list[int], page: int) -> list[np.ndarray]:
    """The pages of sort-tile-recursive packing: row numbers, cut along ``order``'s coordinates one after the other."""
    out, todo = [], [(np.arange(len(points)), 0)]
    while todo:
        rows, depth = todo.pop()
        pages = -(-len(rows) // page)
        if pages <= 1 or not order:
            out += [rows[i : i + page] for i in range(0, len(rows), page)]
            continue
        left = max(1, len(order) - depth)
        slabs = max(2, int(np.ceil(pages ** (1 / left) - 1e-9)))
        rows = rows[np.argsort(points[rows, order[depth % len(order)]], kind="stable")]
        step = page * -(-pages // slabs)  # whole pages to a slab
        todo += [(rows[i : i + step], depth + 1) for i in reversed(range(0, len(rows), step))]
    return out


def _matrix(vectors, dims: int) -> np.ndarray:
    """One row a vector, shorter ones filled with zeros."""
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _packer(order: list[int], dims: int, tree_rows: int, page: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def made(part: pd.DataFrame) -> pd.DataFrame:
            points = _matrix(part["v"].tolist(), dims)
            pages = tile(points, order, page)
            at = np.concatenate(pages)
            b = lambda name: part[name].to_numpy(np.int64)[at].tobytes()
            sizes = np.array([len(p) for p in pages], np.int64).tobytes()
            first = int(part["row"].iloc[0])  # no other tree holds this row
            return pd.DataFrame([(first, len(at), b("vec_id"), b("label"), b("row"), points[at].tobytes(), dims, sizes)], columns=[x.split()[0] for x in _TREE.split(", ")])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= tree_rows:
                rows = pd.concat(held, ignore_index=True)
                for i in range(0, len(rows) - tree_rows + 1, tree_rows):
                    yield made(rows.iloc[i : i + tree_rows])
                held = [rows.iloc[len(rows) // tree_rows * tree_rows :]]
        rows = pd.concat(held, ignore_index=True) if held else []
        if len(rows):
            yield made(rows)

    return pack


def pack_trees(rows: DataFrame, tree_rows: int = TREE, page: int = PAGE) -> DataFrame:
    """The forest over ``prepared`` rows, one packed row for each tree, written once."""
    stats = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    n, dims = stats["n"], stats["dims"] or 0
    place = F.posexplode("v").alias("i", "x")
    spread = rows.select(place).groupBy("i").agg(F.stddev_pop(F.col("x").cast("double")).alias("s"))
    order = [r["i"] for r in spread.orderBy(F.desc("s"), "i").collect()]  # one row a coordinate
    first = F.coalesce(F.try_element_at("v", F.lit(order[0] + 1)), F.lit(0)) if order else F.lit(0)
    slabs = max(-(-n // tree_rows), min(n // page, rows.sparkSession.sparkContext.defaultParallelism), 1)
    # equal coordinates are told apart by the row, so that a vector in many copies fills several slabs
    dealt = rows.withColumn("_x", first).repartitionByRange(slabs, "_x", "row").drop("_x")
    return cut(dealt.mapInPandas(_packer(order[1:] + order[:1], dims, tree_rows, page), _TREE))


class RTree:
    """A packed tree in memory: pages, their boxes, and boxes of runs of ``FAN`` boxes up to one root."""

    def __init__(self, row, fan: int = FAN):
        of = lambda name: np.frombuffer(row[name], np.int64)
        self.ids, self.labels, self.rows = of("ids"), of("labels"), of("rows")
        self.points = of("vectors").reshape(len(self.ids), int(row["dims"]))
        ends = np.cumsum(of("pages"))
        self.ends, self.starts = ends, ends - of("pages")
        lo = [np.minimum.reduceat(self.points, self.starts, axis=0)]
        hi = [np.maximum.reduceat(self.points, self.starts, axis=0)]
        while len(lo[-1]) > 1:  # levels of boxes, pages first
            at = np.arange(0, len(lo[-1]), fan)
            lo.append(np.minimum.reduceat(lo[-1], at, axis=0))
            hi.append(np.maximum.reduceat(hi[-1], at, axis=0))
        self.fan, self.lo, self.hi = fan, lo, hi

    def bounds(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By level, the least and greatest inner product that each anchor can have in each box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return [(up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T) for lo, hi in zip(self.lo, self.hi)]


def search(tree: RTree, anchor: int, scores, bounds, takes, low: np.ndarray, high: np.ndarray, k: int) -> list[list[tuple]]:
    """For each window ``low .. high`` the tree's first ``k`` rows (score, vec_id, index), by score and then by id.

    ``scores(page)`` gives the anchor's scores in a page and ``takes`` marks the rows that it may return.
    """
    best: list[list[tuple]] = [[] for _ in low]
    least = low.copy()  # what a row must reach: the window's start, then the k-th score
    top = len(bounds) - 1
    queue = [(-bounds[top][1][anchor, 0], top, 0)]
    while queue:
        upper, level, box = heapq.heappop(queue)
        lower = bounds[level][0][anchor, box]
        if not np.any((least <= -upper) & (lower <= high)):
            continue
        if level:
            first = box * tree.fan
            for child in range(first, min(first + tree.fan, len(tree.lo[level - 1]))):
                heapq.heappush(queue, (-bounds[level - 1][1][anchor, child], level - 1, child))
            continue
        a, b = tree.starts[box], tree.ends[box]
        s = scores(box)
        inside = (s >= least[:, None]) & (s <= high[:, None]) & takes[a:b]
        for w in np.flatnonzero(inside.any(axis=1)):
            at = np.flatnonzero(inside[w])
            if len(at) > k:  # first cut inside the page
                at = at[np.lexsort((tree.rows[a:b][at], tree.ids[a:b][at], -s[at]))[:k]]
            best[w] = sorted(best[w] + [(-s[i], tree.ids[a + i], tree.rows[a + i], a + i) for i in at])[:k]
            if len(best[w]) == k:
                least[w] = max(least[w], -best[w][-1][0])
    return [[(-x[0], x[1], x[3]) for x in found] for found in best]


_FOUND = "anchor long, anchor_id long, window int, positive_id long, positive_score long, vec_id long, score long"


def _searcher(k: int, same: bool, low: int, high: int, scale: int):
    """Same label without windows, or other labels inside the windows that the anchors' positives give."""

    def run(anchors: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for _, packed in trees.iterrows():
            tree = RTree(packed)
            dims = tree.points.shape[1]
            points = _matrix(anchors["v"].tolist(), dims)
            greatest = int(np.abs(points).max(initial=0)) * max(int(np.abs(tree.points).max(initial=0)), 1) * max(dims, 1)
            kind = np.float64 if greatest * max(scale, 1) < EXACT else object  # whole numbers of any size
            tree.points, tree.lo, tree.hi = tree.points.astype(kind), [x.astype(kind) for x in tree.lo], [x.astype(kind) for x in tree.hi]
            points = points.astype(kind)
            for begin in range(0, len(points), 64):  # scores of a few anchors at a time, page by page as they are asked for
                some = points[begin : begin + 64]
                bounds, seen = tree.bounds(some), {}

                def page(box: int, i: int) -> np.ndarray:
                    if box not in seen:
                        made = some @ tree.points[tree.starts[box] : tree.ends[box]].T
                        seen[box] = made if kind is np.float64 else np.clip(made, -LONG, LONG)
                    return seen[box][i]

                for i in range(len(some)):
                    a = anchors.iloc[begin + i]
                    if same:
                        takes = (tree.labels == a["label"]) & (tree.rows != a["row"])
                        found = search(tree, i, lambda box, i=i: page(box, i), bounds, takes, np.array([-np.inf]), np.array([np.inf]), k)
                        out += [(a["row"], a["vec_id"], 0, None, None, int(x[1]), int(x[0])) for x in found[0]]
                        continue
                    positives = [(int(p["vec_id"]), int(p["score"])) for p in a["positives"]]
                    p = np.array([s for _, s in positives], dtype=object)
                    # whole scores: low * p <= scale * s <= high * p
                    least, most = -((-low * p) // scale), (high * p) // scale
                    found = search(tree, i, lambda box, i=i: page(box, i), bounds, tree.labels != a["label"], least.astype(kind), most.astype(kind), k)
                    for w, ((pid, ps), xs) in enumerate(zip(positives, found)):
                        out += [(a["row"], a["vec_id"], w, pid, ps, int(x[1]), int(x[0])) for x in xs]
        return pd.DataFrame(out, columns=[x.split()[0] for x in _FOUND.split(", ")]).astype({"positive_id": "Int64", "positive_score": "Int64"})

    return run


def _each_tree(anchors: DataFrame, trees: DataFrame, run) -> DataFrame:
    """``run`` over every block of at most about ``ANCHORS`` anchors and every tree. Anchors travel, not trees, as long as one block holds them."""
    n = anchors.count()
    blocks = max(1, -(-n // ANCHORS))
    names = trees.select("tree").withColumn("_one", F.lit(1))
    every = names.groupBy("_one").agg(F.array_sort(F.collect_list("tree")).alias("_trees"))  # a number for each TREE rows
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long").alias("block")
    sent = anchors.withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one").select(F.explode("_trees").alias("tree"), block, *anchors.columns)
    held = trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return sent.groupBy("tree", "block").cogroup(held.groupBy("tree", "block")).applyInPandas(run, _FOUND)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` of what the trees found, ``k`` rows a tree at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 100, tree_rows: int = TREE, page: int = PAGE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``prepared`` rows.

    Anchors are the rows that ``is_anchor`` marks. An anchor's positives are its first ``positives`` other rows of its label; a
    positive of score p takes the first ``negatives`` rows of other labels with a score s of
    ``window[0] p <= scale s <= window[1] p``. Higher scores come first, ties by smaller id. An anchor without positives, or a
    positive with no row in its window, returns nothing. Rows of one id are rows of their own, so a copy of an anchor may be
    its positive. Vectors of unlike length count as filled with zeros. Scores are exact; one
    beyond 64 bits counts as the last number inside. Tables
    without rows or anchors return no row.
    """
    trees = pack_trees(rows, tree_rows, page)
    anchors = rows.filter(is_anchor)
    near = _each_tree(anchors, trees, _searcher(positives, True, *window, scale))
    near = _first(near, ["anchor"], positives)
    told = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))), lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"))).alias("positives"))
    asking = cut(anchors.join(told.withColumnRenamed("anchor", "row"), "row"))
    hard = _each_tree(asking, trees, _searcher(negatives, False, *window, scale))
    hard = _first(hard, ["anchor", "window"], negatives)
    return hard.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def with_noise(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """``rows`` whose label is the next of ``labels`` where ``every`` divides the id."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
