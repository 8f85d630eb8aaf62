"""Merkle manifest of a dataset: digests, proofs and audits by time-forward processing.

Leaves stand in order inside their group; every two consecutive nodes (at the end of a level one alone) hash to their parent
until one is left, the group's root; the groups' roots make the root of the manifest in the same way. A node's label is
(level, place), so a parent's label always follows those of its children.

Forward: digests are messages to later labels. A priority queue ordered by label hands each node its children's digests;
the node sends its own digest on to its parent. The queue is external in the sense that only a block's messages (an
aligned run of ``2 ** bits`` siblings) lie in one heap: what leaves a block is a row, and Spark's shuffle delivers it to the
block that holds the parent's label in the next round. Reversed: labels descend, and each node passes to its children the
proof suffix that begins with the other child's digest. Blocks are rows of one table that is written once, so a round costs
a task per block and no more than ``2 ** bits`` digests of memory, however many rows one group has.

Digests are SHA-256 in lowercase hexadecimal digits, and a node hashes its children's digits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import cut, in_order

BITS, BROADCAST_ROWS = 10, 20_000
WIDTH = 64  # characters of a digest


def digest_of(columns: list[Column]) -> Column:
    """SHA-256 of values, each as its UTF-8 byte count, a colon and itself, or ``-`` if it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _hash(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def levels_of(count: int) -> int:
    """Levels above ``count`` leaves: 0 for one."""
    return max(0, int(count) - 1).bit_length()


def forward(digests: list[str], levels: int) -> tuple[str, list[tuple[tuple[int, int], list[str]]]]:
    """The digest that a block sends up after ``levels`` levels, and its nodes (label, children's digests) as they were met."""
    queue = [((1, i >> 1), i, d) for i, d in enumerate(digests)]  # messages: receiver's label, sender's place, digest
    heapq.heapify(queue)
    made: list[tuple[tuple[int, int], list[str]]] = []
    while queue and queue[0][0][0] <= levels:
        label, children = queue[0][0], []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        made.append((label, children))
        level, place = label
        heapq.heappush(queue, ((level + 1, place >> 1), place, _hash(children)))
    return queue[0][2], made


def backward(made: list[tuple[tuple[int, int], list[str]]], levels: int, count: int, suffix: str) -> list[str]:
    """The proofs of a block's ``count`` members, siblings from the member's level upwards, given the suffix of the top."""
    queue = [((-levels, 0), suffix)]
    for (level, place), children in reversed(made):  # labels descend as the queue's do
        label, tail = heapq.heappop(queue)
        assert label == (-level, -place)
        for k, _ in enumerate(children):
            heapq.heappush(queue, ((1 - level, -(2 * place + k)), "".join(children[1 - k : 2 - k]) + tail))
    tails = {-label[1]: tail for label, tail in queue}
    return [tails[i] for i in range(count)]


def fold(leaf: str, proof: str, place: int, count: int, group: int, groups: int) -> str:
    """The root that a leaf and its proof lead to: ``place`` among ``count`` leaves of group number ``group`` of ``groups``."""
    node, at = leaf, 0
    for i, n in ((int(place), int(count)), (int(group), int(groups))):
        while n > 1:
            if i ^ 1 < n:
                sibling = proof[at : at + WIDTH]
                at += WIDTH
                node = _hash([sibling, node] if i & 1 else [node, sibling])
            else:
                node = _hash([node])
            i, n = i >> 1, (n + 1) >> 1
    return node


def _sent(count: int, level: int, bits: int) -> int:
    return min(bits, max(0, levels_of(count) - level))


def _roots(digests: pd.Series, counts: pd.Series, level: pd.Series, bits: pd.Series) -> pd.Series:
    return pd.Series([forward(list(d), _sent(n, at, b))[0] for d, n, at, b in zip(digests, counts, level, bits)], dtype=object)


def _tails(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for digests, counts, level, bits, suffix in batches:
        out = []
        for d, n, at, b, tail in zip(digests, counts, level, bits, suffix):
            up = _sent(n, at, b)
            out.append(backward(forward(list(d), up)[1], up, len(d), tail))
        yield pd.Series(out, dtype=object)


def _folds(leaf: pd.Series, proof: pd.Series, place: pd.Series, count: pd.Series, group: pd.Series, groups: pd.Series) -> pd.Series:
    return pd.Series([fold(*x) for x in zip(leaf, proof, place, count, group, groups)], dtype=object)


def folded(*columns) -> Column:
    """Column form of :func:`fold`."""
    return F.pandas_udf(_folds, "string")(*columns)


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """Rows (group, count, block, members) of nodes (group, count, place, digest, row): the members in order."""
    member = F.struct("place", "digest", "row")
    out = nodes.groupBy("group", "count", F.shiftright("place", bits).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return cut(out)


def _climb(nodes: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and the digest (group, count, top) that each group ends with."""
    most = nodes.agg(F.max("count")).first()[0] or 0
    tables, up = [], nodes
    for k in range(max(1, -(-levels_of(most) // bits))):
        blocks = _blocks(up, bits)
        tables.append(blocks)
        sent = F.pandas_udf(_roots, "string")(F.col("members.digest"), "count", F.lit(k * bits), F.lit(bits))
        up = blocks.select("group", "count", F.col("block").alias("place"), sent.alias("digest"), F.lit(None).cast(nodes.schema["row"].dataType).alias("row"))
    return tables, up.select("group", "count", F.col("digest").alias("top"))


def _descend(tables: list[DataFrame], suffixes: DataFrame, bits: int) -> DataFrame:
    """(count, place, row, digest, proof, top) of the nodes below, given (group, block, suffix, top) of the last round's blocks.

    ``top`` is what every node of a group is told beside its proof.
    """
    for k in reversed(range(len(tables))):
        told = suffixes.select(F.col("group").alias("_g"), F.col("block").alias("_b"), "suffix", "top")
        here = tables[k].join(told, F.col("group").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")))
        here = here.withColumn("proofs", F.pandas_udf(_tails, "array<string>")(F.col("members.digest"), "count", F.lit(k * bits), F.lit(bits), "suffix"))
        met = here.select("group", "count", "top", F.explode(F.arrays_zip("members", "proofs")).alias("m"))
        down = met.select("group", "count", "top", "m.members.place", "m.members.row", "m.members.digest", F.col("m.proofs").alias("proof"))
        suffixes = down.select("group", F.col("place").alias("block"), F.col("proof").alias("suffix"), "top")
    return down


def _counted(small: DataFrame) -> DataFrame:
    """For a broadcast join if its rows are counted and few, else for a shuffled one."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def manifest(docs: DataFrame, group: Column, order: list[Column], leaf: Column, audit: Column | None = None, keep: list[Column] | None = None, bits: int = BITS) -> DataFrame:
    """``keep``, leaf, place, leaves, subroot, group_place, groups, root, proof, folded_root, verified.

    ``leaf`` is each row's digest and ``order`` its order inside ``group`` (equal ones by leaf; null first). ``proof`` holds
    the siblings' digests end to end, from the leaf's level to the root. ``folded_root`` is what the proof makes of ``audit``,
    the digest that a row has now (null or not given: its leaf), ``verified`` tells whether that is the root. A null group is
    a group of its own and comes first; names of groups compare bytewise. Rows that repeat are leaves of their own. An empty
    table has an empty manifest. Further columns are not read. ``keep`` must be of types that can be ordered.
    """
    cols = [group.alias("group"), leaf.alias("digest"), (F.lit(None).cast("string") if audit is None else audit).alias("audit"), F.struct(F.lit(0).alias("_"), *(keep or [])).alias("kept")]
    ordered = in_order(docs.select(*cols, *[c.alias(f"_o{i}") for i, c in enumerate(order)]), ["group", *[f"_o{i}" for i in range(len(order))], "digest"])
    each = ordered.groupBy("group", "_part").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    by = Window.partitionBy("group")  # rows: the partitions that hold some of the group
    before = F.coalesce(F.sum("n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = each.select(F.col("group").alias("_g"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), F.sum("n").over(by).alias("count"))
    nodes = ordered.join(_counted(starts), F.col("group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    nodes = nodes.select("group", "count", (F.col("_row") + F.col("_shift")).alias("place"), "digest", F.struct("audit", "kept").alias("row"))
    tables, subroots = _climb(nodes, bits)

    # the groups' roots, in order, are the leaves of the tree above
    tops = in_order(subroots, ["group"])
    sizes = tops.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_part")) - F.col("n")  # one row a partition
    tops = tops.join(sizes.select("_part", before.alias("_shift")), "_part")
    groups = tops.count()
    upper = tops.select(F.lit(None).cast("string").alias("group"), F.lit(groups).cast("long").alias("count"), (F.col("_row") + F.col("_shift")).alias("place"), F.col("top").alias("digest"), F.struct(F.col("group").alias("name")).alias("row"))
    upper_tables, root = _climb(upper, bits)
    root = root.select("top").first()

    empty = F.struct(F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("long").alias("group_place"))
    last = root and [(None, 0, "")] or []
    first = docs.sparkSession.createDataFrame(last, "group string, block long, suffix string").withColumn("top", empty)
    over = _descend(upper_tables, first, bits)
    told = F.struct(F.col("digest").alias("subroot"), F.col("place").alias("group_place"))
    over = over.select(F.col("row.name").alias("group"), F.lit(0).cast("long").alias("block"), F.col("proof").alias("suffix"), told.alias("top"))

    out = _descend(tables, over, bits)
    out = out.select("row.kept.*", F.col("digest").alias("leaf"), "place", F.col("count").alias("leaves"), "top.subroot", "top.group_place", F.lit(groups).cast("long").alias("groups"), F.lit(root and root[0]).cast("string").alias("root"), "proof", F.coalesce("row.audit", "digest").alias("_now"))
    out = out.withColumn("folded_root", folded("_now", "proof", "place", "leaves", "group_place", "groups")).drop("_now", "_")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(docs: DataFrame, tampered: Column | None = None, bits: int = BITS) -> DataFrame:
    """The manifest of a table of documents by language and ascending id, ``doc_id`` kept.

    ``tampered`` marks rows whose n_chars has since grown by one; a null n_chars stays null. Null ids come first and are
    never tampered with unless the mark says so.
    """
    cols = ["doc_id", "source", "lang", "n_chars", "text"]
    now = None
    if tampered is not None:
        changed = digest_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in cols])
        now = F.when(tampered, changed)
    return manifest(docs, F.col("lang"), [F.col("doc_id")], digest_of([F.col(c) for c in cols]), now, [F.col("doc_id")], bits)
