"""Mixing sources to target weights by Pareto order sampling.

A source that is to give ``target`` words of its ``source_size`` words takes ``floor(target / source_size)`` whole copies of
every document; these are certain. The rest of the target is a sample without replacement in which document i has the
inclusion probability ``p_i``: equal expected words would favour short texts fully, equal probabilities would leave the
sum to chance, so ``p_i`` is ``rest`` tilted by ``size ** -tilt``. Documents whose probability would pass one are certain;
what they don't use is spread over the others, so that the expected words are the rest exactly. Documents are ranked by
their random odds divided by their inclusion odds, ``u / (1 - u) * (1 - p) / p`` (0 for certain ones), and taken in that
order until the words are reached. What a pass leaves open is filled from the documents further down the order that still
fit, until none does. Then a source may exchange the taken document for the one left out that brings it nearest to its target,
once in each of ``swaps`` passes; this moves one document a pass, whatever the number of documents.

No source is sorted as a whole. Ranks fall in ``SLOTS`` slots of known sums; only the documents of the one slot in which the
target is reached are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import WORD, cut, fresh

#: Source weights, repeating over the sources in code-point order (null last).
WEIGHTS = (3, 1, 2)
SLOTS = 4096
#: One row a source is broadcast up to this many sources; beyond it, adaptive execution splits the skewed join.
BROADCAST_SOURCES = 20_000


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size (words of the whole text, null: 0) and u, a uniform number of (0, 1) from a hash of the id."""
    word_count = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.concat_ws("|", F.lit("mix"), F.col(doc_id).cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count.alias("size"), u.alias("u"))


def targets(per_source: DataFrame, factor: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of one row per source.

    The shares of ``factor`` times all words go by weight; a target stops at ``most`` times its source's words and its
    excess is shared again. The rounds end where sources, by falling weight per word, no longer reach their limit: with
    the first j sources full, the others get their weight's part of what is left. A source without words has target 0.
    """
    everywhere = Window.orderBy(F.col("source").isNull(), "source")
    n = F.row_number().over(everywhere) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(n, F.lit(len(weights))) + 1).cast("int"))
    rows = per_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fullest = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").isNull(), "source")
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    after = fullest.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("goal", F.sum("source_size").over(total) * factor)
    left = F.col("goal") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    rows = rows.withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    # full sources come first in this order, so the first one that isn't sets the level of all after it
    level = F.min(F.when(~F.col("full"), F.struct((F.col("limit") / F.col("weight")).alias("x"), F.col("level").alias("level")))).over(total)["level"]
    target = F.when(F.col("full") | level.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), level * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _small(per_source: DataFrame, few: bool) -> DataFrame:
    """The per-source side of a join, broadcast when its counted rows allow it."""
    return F.broadcast(per_source) if few else per_source


def _first_words(pool: DataFrame, goals: DataFrame, few: bool) -> DataFrame:
    """The documents of ``pool`` (doc_id, source, size, key in [0, 1)) in order of key until each source's ``goal`` words.

    The document at which the goal is passed is taken if that ends nearer to the goal.
    """
    slotted = pool.withColumn("slot", F.floor(F.col("key") * SLOTS))
    sums = slotted.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    edge = sums.join(goals.withColumnRenamed("source", "s"), _same(F.col("source"), F.col("s"))).drop("s")
    edge = edge.filter("before < goal").groupBy("source").agg(F.max(F.struct("slot", "before", "goal")).alias("e"))
    edge = edge.select(F.col("source").alias("s"), F.col("e.slot").alias("edge"), F.col("e.before").alias("before"), F.col("e.goal").alias("goal"))
    near = slotted.join(_small(edge, few), _same(F.col("source"), F.col("s"))).drop("s")
    whole = near.filter("slot < edge").select("doc_id", "source", "size")
    order = Window.partitionBy("source").orderBy("key", "size", "doc_id")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    last = near.filter("slot = edge").withColumn("upto", F.col("before") + F.coalesce(upto, F.lit(0)))
    fits = (F.col("upto") + F.col("size") <= F.col("goal")) | ((F.col("upto") < F.col("goal")) & (F.col("upto") + F.col("size") - F.col("goal") < F.col("goal") - F.col("upto")))
    return whole.union(last.filter(fits).select("doc_id", "source", "size"))


def _levels(base: DataFrame, goals: DataFrame, tilt: float) -> DataFrame:
    """(source, c) such that ``min(1, c * size ** -tilt)`` over the documents of a source expects ``rest`` words.

    The probability falls with the size, so the certain documents are those of the smallest sizes: up to the last size s for
    which what the smaller ones leave, shared by tilt over s and beyond, still gives s a probability of one. Sizes are
    counted first, so the window runs over the distinct sizes of a source, not over its documents.
    """
    by_size = base.groupBy("source", "size").agg(F.sum("size").alias("words"), F.sum(F.pow("size", F.lit(1 - tilt))).alias("mass"))
    rows = by_size.join(goals.select(F.col("source").alias("s"), "rest"), _same(F.col("source"), F.col("s"))).drop("s")
    order = Window.partitionBy("source").orderBy("size")
    smaller = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    beyond = F.sum("mass").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("c", (F.col("rest") - smaller) / beyond)
    open_ = F.col("c") * F.pow("size", F.lit(-tilt)) < 1
    found = rows.groupBy("source").agg(F.min_by("c", F.when(open_, F.col("size"))).alias("c"), F.max(F.pow("size", F.lit(tilt))).alias("all"))
    return found.select("source", F.coalesce("c", "all").alias("c"))


def _gaps(chosen: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, goal: the words of ``wanted`` that ``chosen`` doesn't give; below 0 where it gives more."""
    got = chosen.groupBy("source").agg(F.sum("size").alias("got")).withColumnRenamed("source", "g")
    gaps = wanted.join(got, _same(F.col("source"), F.col("g")), "left")
    return gaps.select("source", (F.col("goal") - F.coalesce("got", F.lit(0))).alias("goal"))


def _untaken(pool: DataFrame, chosen: DataFrame) -> DataFrame:
    have = chosen.select(F.col("doc_id").alias("i"), F.col("source").alias("o"))
    return pool.join(have, _same(F.col("doc_id"), F.col("i")) & _same(F.col("source"), F.col("o")), "left_anti")


def _exchange(pool: DataFrame, chosen: DataFrame, gaps: DataFrame, few: bool) -> DataFrame | None:
    """``chosen`` after each source's best exchange of one document for another; None if no source comes nearer.

    To close a gap g, a taken document of size s must go for one of size s + g. So the sizes left out are laid between the
    taken sizes plus g, and each looks at its neighbour on either side. Size 0 stands for no document, so that taking one more
    or one less is an exchange, too. Only distinct sizes are ordered. Of equal sizes, the document that goes is the last in
    the sampling order, and the one that comes is the first.
    """
    left = _untaken(pool, chosen)
    nothing = gaps.select("source", F.lit(0).cast("long").alias("size"))
    room = gaps.select(F.col("source").alias("s"), "goal")
    taken = chosen.select("source", "size").union(nothing).distinct().join(_small(room, few), _same(F.col("source"), F.col("s")))
    free = left.select("source", "size").union(nothing).distinct()
    # a point has the size of a taken document in ``out`` or that of one left out in ``in``
    points = taken.select("source", (F.col("size") + F.col("goal")).alias("at"), F.col("size").alias("out"), F.lit(None).cast("long").alias("in"), F.abs("goal").alias("now"))
    points = points.union(free.select("source", F.col("size").cast("double"), F.lit(None).cast("long"), F.col("size"), F.lit(None).cast("double")))
    line = Window.partitionBy("source").orderBy("at", "out", "in")
    under = F.last("in", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    over = F.first("in", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    beside = points.withColumn("beside", F.array(under, over)).filter("out is not null")
    pairs = beside.select("source", "at", "out", "now", F.explode("beside").alias("come")).filter("come is not null")
    pairs = pairs.withColumn("off", F.abs(F.col("at") - F.col("come"))).filter("off <= now - 1")
    best = cut(pairs.groupBy("source").agg(F.min(F.struct("off", "out", "come")).alias("b")).select(F.col("source").alias("s"), F.col("b.out").alias("out"), F.col("b.come").alias("come")))
    if best.isEmpty():
        return None
    same = lambda size: _same(F.col("source"), F.col("s")) & (F.col("size") == F.col(size))
    place = F.struct("key", "doc_id", "size")
    come = left.join(_small(best, few), same("come")).groupBy("source").agg(F.min(place).alias("d"))
    come = come.select(F.col("d.doc_id").alias("doc_id"), "source", F.col("d.size").alias("size"))
    keyed = pool.join(_small(best, few), same("out")).select("doc_id", "source", "size", "key")
    keyed = keyed.join(chosen.select(F.col("doc_id").alias("i"), F.col("source").alias("o")), _same(F.col("doc_id"), F.col("i")) & _same(F.col("source"), F.col("o")), "left_semi")
    go = keyed.groupBy("source").agg(F.max(place).alias("d")).select(F.col("d.doc_id").alias("doc_id"), "source")
    return cut(_untaken(chosen, go).union(come))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", factor: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, tilt: float = 0.25, swaps: int = 2) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (copies times size).

    Null texts have size 0, and so have empty ones; they are in the mix when all documents of their source are. Rows that
    repeat a doc_id in one source have one decision for all, taken for the sum of their sizes. Null is a source of its own. An empty
    table gives no rows. Reruns agree, as the only randomness is a hash of the id.
    """
    rows = cut(sizes(docs, doc_id, text, source))
    goals = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), factor, most, weights))
    few = goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    base = rows.groupBy("doc_id", "source").agg(F.sum("size").alias("size"), F.min("u").alias("u")).filter("size > 0")
    odds = _levels(base, goals.filter("rest > 0").select("source", "rest"), tilt).select(F.col("source").alias("s"), "c")
    p = F.least(F.lit(1.0), F.greatest(F.lit(1e-9), F.col("c") * F.pow("size", F.lit(-tilt))))
    q = F.col("u") / (1 - F.col("u")) * (1 - p) / p
    pool = base.join(_small(odds, few), _same(F.col("source"), F.col("s"))).select("doc_id", "source", "size", (q / (1 + q)).alias("key"))
    pool = cut(pool)
    wanted = goals.filter("rest > 0").select("source", F.col("rest").alias("goal"))
    chosen = cut(_first_words(pool, wanted, few))
    while True:
        gaps = cut(_gaps(chosen, wanted).filter("goal >= 1"))
        if gaps.isEmpty():
            break
        left = _untaken(pool, chosen).join(_small(gaps.select(F.col("source").alias("f"), F.col("goal").alias("room")), few), _same(F.col("source"), F.col("f"))).filter("size <= room")
        more = cut(_first_words(left.select("doc_id", "source", "size", "key"), gaps, few))
        if more.isEmpty():
            break
        chosen = chosen.union(more)
    for _ in range(swaps):
        gaps = cut(_gaps(chosen, wanted).filter("abs(goal) >= 1"))
        nearer = None if gaps.isEmpty() else _exchange(pool, chosen, gaps, few)
        if nearer is None:
            break
        chosen = nearer

    extra = chosen.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.lit(1).alias("extra"))
    known = goals.select(F.col("source").alias("s"), "source_size", "target", "whole")
    out = rows.join(_small(known, few), _same(F.col("source"), F.col("s"))).join(extra, _same(F.col("doc_id"), F.col("id")) & _same(F.col("source"), F.col("of")), "left")
    copies = F.col("whole") + F.when(F.col("source_size") == 0, 0).otherwise(F.coalesce("extra", F.lit(0)))
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long"), "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """``docs`` with their own columns, each row as often as the mix takes its id in its source."""
    share = mix(docs, doc_id, source=source, **how).groupBy("doc_id", "source").agg(F.max("copies").alias("n"))
    key, of, n = fresh(docs, "_mix_id"), fresh(docs, "_mix_source"), fresh(docs, "_mix_n")
    share = share.select(F.col("doc_id").alias(key), F.col("source").alias(of), F.col("n").alias(n))
    out = docs.join(share, docs[doc_id].eqNullSafe(share[key]) & docs[source].eqNullSafe(share[of])).filter(F.col(n) > 0)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
