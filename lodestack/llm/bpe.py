"""Byte-level BPE over an occurrence index of pairs.

The distinct words of a batch lie in one array. An index maps the rank of each pair to all positions where the pair
stands; ranks are applied in ascending order, each to all its positions at once, and only the lists of the pairs beside
a merge change. As a merged symbol can only take part in merges of later ranks, one ascending sweep gives every word
the result that merging it alone, lowest rank first, would give.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import apply_struct

#: The public byte-level pre-tokenisation pattern, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_EDGE, _GONE = 0xFFFF, -1
#: White space beside which a cut at single blanks could differ from the pattern's own cuts.
_ODD_SPACE = re.compile(r"  | \n|\n |[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")
#: Cached units of a task; beyond this the cache starts anew.
MAX_UNITS = 500_000
_MARKS = frozenset(".,;:!?")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable Latin-1, else 256 onward in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges as sorted pair keys, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_symbols()
        ids = spec["model"]["vocab"]
        plain = lambda s: bytes(byte_of[c] for c in s)
        self.bytes_of = {i: plain(s) for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.byte_id = np.zeros(256, np.int32)
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.byte_id[b[0]] = i
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        keys = (self.left << 16) | self.right
        order = np.argsort(keys)
        self.keys, self.rank_at = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, -1)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.marks = tuple(self.special)
        self.pattern = regex.compile(PATTERN)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where none is."""
        key = (a.astype(np.int64) << 16) | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_at[at], -1)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_words(voc: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and the number of ids of each word."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(owner)) + owner + 1  # an edge symbol before each word and after the last
    sym = np.full(len(owner) + len(words) + 1, _EDGE, np.int32)
    sym[place] = voc.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray, ranks: np.ndarray) -> None:
        """Add positions to the lists of their pairs."""
        known = ranks >= 0
        at, ranks = at[known], ranks[known]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for r, i, j in zip(ranks[starts].tolist(), starts, [*starts[1:], len(at)]):
            if r in index:
                index[r].append(at[i:j])
            else:
                index[r] = [at[i:j]]
                heapq.heappush(active, r)

    enter(np.arange(len(sym) - 1), voc.ranks(sym[:-1], sym[1:]))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = voc.left[r], voc.right[r]
        at = at[sym[at] == a]
        then = after[at]
        live = sym[then] == b
        at, then = at[live], then[live]
        if a == b and len(at) > 1:  # runs of one symbol pair up from the left
            begins = np.concatenate(([True], at[1:] != then[:-1]))
            since = np.arange(len(at)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            at, then = at[since % 2 == 0], then[since % 2 == 0]
        if not len(at):
            continue
        sym[at], sym[then] = voc.made[r], _GONE
        beyond = after[then]
        after[at], before[beyond] = beyond, at
        pairs = np.concatenate((before[at], at))
        enter(pairs, voc.ranks(sym[pairs], sym[after[pairs]]))
    kept = sym[place]
    live = kept != _GONE
    return kept[live], np.bincount(owner[live], minlength=len(words))


class _Numbers(dict):
    """Numbers keys in order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lens)
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Encodes batches of texts; units (a word and the blank before it) that it has met stay known."""

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self._forget()

    def _forget(self) -> None:
        self.units, self.flat = _Numbers(), np.zeros(0, np.int32)
        self.starts = self.lens = np.zeros(0, np.int64)

    def _units_of(self, part: str) -> list[int]:
        number = self.units.__getitem__
        if _ODD_SPACE.search(part):
            return list(map(number, map(tuple, zip(self.voc.pattern.findall(part)))))
        first, *rest = part.split(" ")
        return [number((first,)), *map(number, rest)] if first else list(map(number, rest))

    def _cut(self, unit: str | tuple[str]) -> list[str]:
        """The pattern's pieces of a unit; letters, and letters with one mark of ASCII behind, need no search."""
        if isinstance(unit, tuple):
            return self.voc.pattern.findall(unit[0])
        if unit.isalpha():
            return [" " + unit]
        if unit[-1:] in _MARKS and unit[:-1].isalpha():
            return [" " + unit[:-1], unit[-1]]
        return self.voc.pattern.findall(" " + unit)

    def _learn(self) -> None:
        """Encode the units met since the last call: a plain string follows a blank, a string in a tuple doesn't."""
        new = list(islice(self.units, len(self.starts), None))
        if not new:
            return
        words = _Numbers()
        spelt = [[words[w] for w in self._cut(u)] for u in new]
        ids, n = encode_words(self.voc, [w.encode("utf-8", "surrogatepass") for w in words])
        begin = np.cumsum(n) - n
        each = np.fromiter((i for s in spelt for i in s), np.int64)
        flat = _gather(ids, begin[each], n[each])
        total = np.concatenate(([0], np.cumsum(n[each])))
        ends = total[np.cumsum([len(s) for s in spelt])]
        lens = np.diff(np.concatenate(([0], ends)))
        self.starts = np.concatenate((self.starts, len(self.flat) + ends - lens))
        self.lens, self.flat = np.concatenate((self.lens, lens)), np.concatenate((self.flat, flat))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.units) > MAX_UNITS:
            self._forget()
        plans = []
        for text in texts:
            marked = self.voc.marks and any(m in text for m in self.voc.marks)
            parts = self.voc.split.split(text) if marked else [text]
            plans.append([self.voc.special[p] if p in self.voc.special else np.array(self._units_of(p), np.int64) for p in parts if p])
        self._learn()
        out = []
        for plan in plans:
            ids = [np.array([p]) if isinstance(p, int) else _gather(self.flat, self.starts[p], self.lens[p]) for p in plan]
            out.append(np.concatenate(ids).astype("<u4") if ids else np.zeros(0, "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.voc.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _blocks(texts: pd.Series, chars: int = 8_000_000) -> Iterator[list[str]]:
    """Runs of texts of bounded size, null as empty."""
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size > chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def round_trip(path: str | None = None):
    """A vectorised UDF text -> struct of ``_FIELDS``."""
    path = path or default_path()

    @F.pandas_udf(_FIELDS)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary(path))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for texts in batches:
            rows = [(len(ids), sha(ids.tobytes()), sha(encoder.decode(ids).encode())) for block in _blocks(texts) for ids in encoder.encode_batch(block)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def encode_ids(path: str | None = None):
    """A vectorised UDF text -> array of token ids."""
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary(path))
        for texts in batches:
            yield pd.Series([x.astype(np.int32) for block in _blocks(texts) for x in encoder.encode_batch(block)], dtype=object)

    return ids


def decode_ids(path: str | None = None):
    """A vectorised UDF array of token ids -> text (null for null)."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary(path))
        for ids in batches:
            yield pd.Series([None if x is None else encoder.decode(np.asarray(x)) for x in ids], dtype=object)

    return text


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, keep: list[Column] | None = None) -> DataFrame:
    """One row per document: ``keep`` (default doc_id) and its token ``ids``. A null or empty text has no ids.

    A special token's string in a text becomes that token, as in the tokenizers library's default.
    """
    return docs.select(*(keep or [F.col("doc_id")]), encode_ids(path)(F.col(text)).alias("ids"))


def encode_digests(docs: DataFrame, text: str = "text", path: str | None = None, keep: list[Column] | None = None) -> DataFrame:
    """One row per document: ``keep`` (default doc_id), n_tokens, and the SHA-256 of its ids and of their decoding."""
    return apply_struct(docs, round_trip(path), [F.col(text)], keep or [F.col("doc_id")])
