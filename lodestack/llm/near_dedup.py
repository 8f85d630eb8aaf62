"""Near-duplicate detection by b-bit MinHash, with every link confirmed on full shingle sets.

1. Each text becomes the set of its hashed word shingles and a signature: the low byte of each of ``bands * 6`` minima,
   packed six to a long, so that one long is one band. Texts of equal sets form a class and go on as one.
2. Bands meet in a join on the band's hash. A bucket first yields only the pairs of its members with its smallest member,
   so a bucket of n gives n pairs. Of the others only pairs in different components can still matter. Buckets of up to
   ``WIDE`` members that hold several components are compared inside tasks, in blocks of ``BLOCK`` members, on finer
   signatures, and only pairs that may be links come out. Members of wider ones (pages of one template, say) meet under
   finer keys instead: the rarest shingles of each, so many that two sets over the threshold must share one. This is
   exact, and what many texts have in common is not among the rarest.
3. The packed signatures of a pair give its collision-corrected similarity. Pairs that fall five standard errors under
   the threshold are left; the others are confirmed on the sets of both whole texts.
4. Confirmed links are contracted to components by pointer jumping. A pair inside a component needs no check, which
   keeps a group of thousands of near copies from being expanded into its pairs.

A true link is missed when no band meets (under one in a million at the threshold, fewer above it) or when an estimate
falls five standard errors short (under one in a million, too).
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import apply_struct, fresh
from lodestack.llm.common import cut_clean as cut

ROWS = 6
#: Minima of the finer signatures, members of a block of a bucket, and members from which a bucket gets finer keys.
FINE = 1024
BLOCK = 512
WIDE = 2048
#: Slots in which shingles of wide buckets are counted: a bound of 8 MB for what tasks share.
SLOT_BITS = 20
_LOW = 0x0101010101010101


def band_count(threshold: float, miss: float = 1e-6) -> int:
    """Bands of six minima after which a pair at the threshold has met with probability 1 - ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**ROWS))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words, A-Z lower-cased; fewer words are one run."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII case and blanks only
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > 400_000:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    mixed = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def family(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and masks of ``k`` hash functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def low_bytes(hashes: np.ndarray, multiply: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """The low byte of each rehashed minimum."""
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(small), 512):
        np.minimum(least, ((small[i : i + 512, None] ^ flip) * multiply).min(0), out=least)
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    least ^= least >> np.uint32(13)
    return (least & np.uint32(0xFF)).astype(np.uint8)


def signature(hashes: np.ndarray, multiply: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """Low bytes of the minima, six to a long."""
    packed = np.zeros((len(multiply) // ROWS, 8), np.uint8)
    packed[:, :ROWS] = low_bytes(hashes, multiply, flip).reshape(-1, ROWS)
    return packed.view("<i8").ravel()


def floor_of(threshold: float, k: int) -> float:
    """Five standard errors of ``k`` minima under the threshold."""
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / k)


def _sketcher(width: int, bands: int):
    multiply, flip = family(bands * ROWS, 1)

    @F.pandas_udf("n_shingles long, digest binary, sig array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for texts in batches:
            rows = []
            for text in texts:
                s = shingles(text, width, known)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s, multiply, flip)) if len(s) else (0, None, None))
            yield pd.DataFrame(rows, columns=["n_shingles", "digest", "sig"])

    return sketch


def _fine(width: int):
    multiply, flip = family(FINE, 2)

    @F.pandas_udf("binary")
    def fine(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _WordHashes()
        for texts in batches:
            yield pd.Series([low_bytes(shingles(t, width, known), multiply, flip).tobytes() for t in texts], dtype=object)

    return fine


def _compare_blocks(bands: int, coarse: float, fine: float):
    """For mapInPandas over rows sorted by (key, left, right): pairs of a block pair in different components that may be links.

    A pair that meets in several buckets comes out of the bucket of its first common band only; ``pos`` is that band, or -1
    where the key is none, and then ``begins`` tells the sets that may be a pair's smaller one under this key.
    """
    per_match = 256 / 255

    def pairs_of(rows: pd.DataFrame) -> list[tuple[int, int]]:
        left, right, pos = rows["left"].iloc[0], rows["right"].iloc[0], rows["pos"].iloc[0]
        begins = rows["begins"].to_numpy(bool)
        sig = np.array(rows["sig"].tolist(), np.int64)
        lanes = sig.view(np.uint8).reshape(len(sig), -1, 8)[:, :, :ROWS].reshape(len(sig), -1)
        close = np.frombuffer(b"".join(rows["fine"]), np.uint8).reshape(len(sig), -1)
        rep, root, block = (rows[c].to_numpy() for c in ("rep", "root", "block"))
        out = []
        for i in np.flatnonzero(block == left):
            others = np.flatnonzero((block == right) & (root != root[i]) & ((rep > rep[i]) if left == right else True))
            if not len(others):
                continue
            others = others[(sig[others] == sig[i]).argmax(1) == pos] if pos >= 0 else others[begins[others] | begins[i]]
            likely = ((lanes[others] == lanes[i]).mean(1) - 1 / 256) * per_match >= coarse
            others = others[likely]
            others = others[((close[others] == close[i]).mean(1) - 1 / 256) * per_match >= fine]
            out += [(min(rep[i], rep[j]), max(rep[i], rep[j])) for j in others]
        return out

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []  # the last run of a batch may go on in the next
        for batch in batches:
            runs = [g for _, g in batch.groupby(["key", "left", "right"], sort=False)]
            if kept and len(runs):
                same = all(kept[0][c].iloc[0] == runs[0][c].iloc[0] for c in ("key", "left", "right"))
                if same:
                    kept.append(runs.pop(0))
                if runs or not same:
                    yield pd.DataFrame(pairs_of(pd.concat(kept)), columns=["a", "b"])
                    kept = []
            if runs:
                kept = [runs.pop()]
            yield pd.DataFrame([p for r in runs if len(r) > 1 for p in pairs_of(r)], columns=["a", "b"])
        if kept:
            yield pd.DataFrame(pairs_of(pd.concat(kept)), columns=["a", "b"])

    return compare


def _verifier(width: int, percent: int):
    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known, recent = _WordHashes(), OrderedDict()

        def of(doc: int, text: str) -> np.ndarray:
            key = doc, hash(text)  # a repeated id may have several texts
            if key not in recent:
                recent[key] = shingles(text, width, known)
                if len(recent) > 64:
                    recent.popitem(last=False)
            recent.move_to_end(key)
            return recent[key]

        for a, b, text_a, text_b in batches:
            out = []
            for i, j, x, y in zip(a, b, text_a, text_b):
                x, y = of(i, x), of(j, y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pd.Series(out, dtype=bool)

    return linked


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slots(width: int):
    """For mapInPandas over texts: (slot, n) of the task's shingles."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total, waiting, size = _WordHashes(), np.zeros(1 << SLOT_BITS, np.int64), [], 0
        for batch in batches:
            for text in batch["text"]:
                waiting.append(slots_of(shingles(text, width, known)))
                size += len(waiting[-1])
                if size > 1 << SLOT_BITS:
                    total += np.bincount(np.concatenate(waiting), minlength=len(total))
                    waiting, size = [], 0
        if size:
            total += np.bincount(np.concatenate(waiting), minlength=len(total))
        slot = np.flatnonzero(total)
        yield pd.DataFrame({"slot": slot, "n": total[slot]})

    return count


def shingle_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How often shingles occur, by the first ``SLOT_BITS`` bits of their hash: 2^SLOT_BITS numbers, however many texts there are."""
    counts = texts.select("text").mapInPandas(_slots(width), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    pack = lambda g: pd.DataFrame({"part": [g["slot"].iloc[0] >> 10], "slots": [g["slot"].to_numpy(np.int32).tobytes()], "n": [g["n"].to_numpy(np.int64).tobytes()]})
    out = np.zeros(1 << SLOT_BITS, np.int64)
    for r in counts.groupBy(F.shiftright("slot", 10)).applyInPandas(pack, "part long, slots binary, n binary").collect():
        out[np.frombuffer(r["slots"], np.int32)] = np.frombuffer(r["n"], np.int64)
    return out


def _rarest(width: int, percent: int, counts):
    """For mapInPandas over (rep, root, text): a row (key, begins, rep, root) for each of the set's rarest shingles.

    In any common order two sets of sizes a <= b with 100 * |A & B| >= percent * |A | B| share one of the first
    a - ceil(2 p a / (100 + p)) + 1 of the smaller and the first b - ceil(p b / 100) + 1 of the larger; ``begins`` marks
    the former.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n_of = _WordHashes(), counts.value
        for batch in batches:
            parts = []
            for rep, root, text in zip(batch["rep"], batch["root"], batch["text"]):
                s = shingles(text, width, known)
                n = len(s)
                first = s[np.lexsort((s, n_of[slots_of(s)]))][: n - -(-percent * n // 100) + 1]
                small = n - -(-2 * percent * n // (100 + percent)) + 1
                parts.append(pd.DataFrame({"key": first.view(np.int64), "begins": np.arange(len(first)) < small, "rep": rep, "root": root}))
            yield pd.concat(parts) if parts else pd.DataFrame({"key": [], "begins": [], "rep": [], "root": []})

    return keys


def _equal_minima(x: str, y: str, bands: int):
    """Minima that agree, by bit counts over the packed signatures."""

    def differing(a, b):
        z = a.bitwiseXOR(b)
        for shift in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(_LOW)))

    lost = F.aggregate(F.zip_with(x, y, differing), F.lit(0), lambda s, d: s + d)
    return F.lit(bands * ROWS) - lost


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given as (node, parent) with smaller parents, by pointer jumping."""
    at = cut(parents.select("node", F.col("parent").alias("root")))
    while True:
        up = at.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = cut(at.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        if not new.filter("moved").limit(1).count():
            return new.select("node", "root")
        at = new.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); root is the component's smallest node.

    Each round points every node to its smallest neighbour, finds the roots of that forest and contracts it.
    """
    done = None
    edges = cut(edges.select("a", "b").distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent"))
        tree = roots(least.filter("parent < node"))
        done = tree if done is None else cut(_jump(done, tree))
        left = _relabel(_relabel(edges, tree, "a"), tree, "b").filter("a <> b")
        edges = cut(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if edges.isEmpty():
            return done


def _relabel(df: DataFrame, tree: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its root."""
    t = tree.select(F.col("node").alias(column), F.col("root").alias("_to"))
    return df.join(t, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def _jump(done: DataFrame, tree: DataFrame) -> DataFrame:
    moved = _relabel(done.select("node", "root"), tree, "root").select("node", "root")
    return moved.union(tree.join(done.select("node"), "node", "left_anti").select("node", "root"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80, wide: int = WIDE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` over their distinct ``width``-word shingles;
    component_id is the smallest doc_id that links reach. Null and empty texts have no shingles and no links. Rows that
    repeat a doc_id are one node with the links of all their texts, each keeps its row; a row without doc_id gets no
    component unless its text has one. Columns other than the two named are ignored.
    """
    threshold = percent / 100
    bands = band_count(threshold)
    k = bands * ROWS
    floor = floor_of(threshold, k)
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = cut(apply_struct(rows, _sketcher(width, bands), [F.col("text")], [F.col("doc_id")]))
    usable = sketched.filter("digest is not null and doc_id is not null")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    # a doc_id that has several texts links the classes of all of them
    several = usable.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).filter("one < other").select("doc_id")
    named = usable.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "rep"), "digest")
    same = named.filter("rep < doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()

    sigs = classes.select("rep", "sig")
    slots = sigs.select("rep", F.posexplode("sig")).select(F.xxhash64("pos", "col").alias("key"), "pos", "rep")
    full = slots.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("most")).filter("hub < most").select("key", "hub")
    met = cut(slots.join(full, "key").select("key", "pos", "hub", "rep"))  # buckets of two or more
    pairs = met.filter("hub < rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()

    def likely(pairs: DataFrame) -> DataFrame:
        a, b = (sigs.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
        p = pairs.join(b, "b").join(a, "a")
        equal = (_equal_minima("sig_a", "sig_b", bands) / k - 1 / 256) * (256 / 255)
        return p.select("a", "b", equal.alias("likeness")).filter(F.col("likeness") >= floor)

    stars = cut(likely(pairs))

    def texts_of(ids: DataFrame) -> DataFrame:
        """(doc_id, text), each text of an id once."""
        return cut(rows.join(ids, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("_hash")).agg(F.min("text").alias("text")).drop("_hash"))

    near = texts_of(met.select(F.col("rep").alias("doc_id")).distinct())

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (near.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        p = pairs.select("a", "b").join(b, "b").join(a, "a")
        return p.filter(_verifier(width, percent)("a", "b", "text_a", "text_b")).select("a", "b")

    best = stars.groupBy("b").agg(F.max_by("a", F.struct("likeness", -F.col("a"))).alias("a"))
    links = cut(confirmed(best))
    tree = roots(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))

    def across(pairs: DataFrame, tree: DataFrame) -> DataFrame:
        """Pairs of different components, with the roots."""
        p = pairs.withColumn("ra", F.col("a")).withColumn("rb", F.col("b"))
        return _relabel(_relabel(p, tree, "ra"), tree, "rb").filter("ra <> rb")

    rest = across(stars.select("a", "b").join(best.select("a", "b"), ["a", "b"], "left_anti"), tree)
    more = cut(confirmed(rest).union(same))
    tree = _grow(tree, more)

    open_ = _relabel(met.select("key", "pos", "rep", F.col("rep").alias("root")), tree, "root")
    split = open_.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    members = cut(open_.join(split.select("key", "n"), "key"))
    if not members.isEmpty():
        buckets = members.filter(F.col("n") <= wide).select("key", F.lit(True).alias("begins"), "pos", "rep", "root", "n")
        many = members.filter(F.col("n") > wide)
        if not many.isEmpty():
            ids = many.select(F.col("rep").alias("doc_id"), "root").distinct()
            texts = cut(near.join(ids, "doc_id").select(F.col("doc_id").alias("rep"), "root", "text"))
            counts = spark.sparkContext.broadcast(shingle_counts(texts, width))
            finer = cut(texts.mapInPandas(_rarest(width, percent, counts), "key long, begins boolean, rep long, root long"))
            open_keys = finer.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("begins").alias("any"), F.count("*").alias("n")).filter("lo < hi and any")
            finer = finer.join(open_keys.select("key", "n"), "key").select("key", "begins", F.lit(-1).alias("pos"), "rep", "root", "n")
            buckets = cut(buckets.unionByName(finer))
        ids = buckets.select(F.col("rep").alias("doc_id")).distinct()
        fine = near.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), _fine(width)("text").alias("fine"))
        blocks = F.ceil(F.col("n") / BLOCK)
        placed = buckets.withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        placed = placed.select("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "pos", "begins", "rep", "root")
        placed = placed.join(fine.join(sigs, "rep"), "rep")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sorted_ = placed.repartition(n, "key", "left", "right").sortWithinPartitions("key", "left", "right")
        crossing = sorted_.mapInPandas(_compare_blocks(bands, floor, floor_of(threshold, FINE)), "a long, b long")
        tree = _grow(tree, cut(confirmed(cut(crossing.distinct()).join(stars.select("a", "b"), ["a", "b"], "left_anti"))))

    named = _relabel(classes.select("digest", F.col("rep").alias("component_id")), tree, "component_id")
    out = sketched.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _grow(tree: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after further links."""
    between = _relabel(_relabel(links, tree, "a"), tree, "b").filter("a <> b")
    between = cut(between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return tree if between.isEmpty() else cut(_jump(tree, components(between)))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` with their own columns, one document (the smallest id) of each component.

    Rows that repeat a kept doc_id stay as they are; rows without id stay.
    """
    gone = near_duplicates(docs, text, doc_id, **how).filter("not kept").select(F.col("doc_id").alias(key := fresh(docs, "_gone")))
    return docs.join(gone.distinct(), docs[doc_id].cast("long") == gone[key], "left_anti")
