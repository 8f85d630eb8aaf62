"""License scans: exact phrases, and fuzzy search for short notices.

A notice that may differ by k edits is split in k + 1 pieces; at least one of them stands unchanged in any match
(pigeonhole). An automaton finds all pieces of all notices in one pass over the words of a whole text. The words
around each find are tested by a column-wise edit distance, which costs the same whatever stands there, and what it lets
through the regex library's bounded-error matching verifies: it counts the edits and gives the span.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import apply_struct

#: Phrases whose exact places are counted, and their labels. Fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices searched with edits, and their labels. Fixed values.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license": "apache",
    "apache license version 2": "apache",
    "licensed under the apache license": "apache",
    "mit license": "mit",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
    "dedicated to the public domain": "public-domain",
}
#: One edit for each so many characters of a notice.
CHARS_PER_EDIT = 8
#: Verdicts kept by a task, beyond which it starts anew, and the characters at which hopeless places are left.
KEPT_VERDICTS, HEAD = 200_000, 12
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SPAN = "label string, first_word long, last_word long, edits int, matched string"
_FIELDS = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<{_SPAN}>>"


def pieces(notice: str, edits: int) -> list[tuple[str, int]]:
    """``edits`` + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


def prefix_distances(notice: str, text: str, most: int) -> list[tuple[int, int]]:
    """(length, edits) of the prefixes of ``text`` within ``most`` edits of ``notice``: one column of the edit table for each
    character, all rows of it in the bits of two integers.
    """
    size = len(notice)
    full, top = (1 << size) - 1, 1 << (size - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(notice):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, edits, found = full, 0, size, []
    for n, c in enumerate(text, 1):
        same = where.get(c, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        up, down = minus | ~(diagonal | plus), plus & diagonal
        edits += bool(up & top) - bool(down & top)
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal & full
        if edits <= most:
            found.append((n, edits))
    return found


def opening_distance(notice: str, head: str) -> int:
    """The fewest edits between ``head`` and any prefix of ``notice``: no text that begins with ``head`` needs fewer."""
    column = list(range(len(notice) + 1))
    for n, c in enumerate(head, 1):
        diagonal, column[0] = column[0], n
        for i, x in enumerate(notice, 1):
            diagonal, column[i] = column[i], min(diagonal + (x != c), column[i] + 1, column[i - 1] + 1)
    return min(column)


class Scanner:
    """Exact phrases and notices with edits. A verdict depends on the characters behind a word's start only, so it is kept
    for texts that repeat them.
    """

    def __init__(self, phrases: dict[str, str], notices: dict[str, str], chars_per_edit: int):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = [(n, label, len(n) // chars_per_edit) for n, label in notices.items()]
        body = lambda n: regex.escape(n, special_only=True, literal_spaces=True)
        self.verify = [[regex.compile(rf"(?b)(?:{body(n)}){{e<={k}}}") for k in range(most + 1)] for n, _, most in self.notices]
        self.openings: list[dict[str, bool]] = [{} for _ in self.notices]
        seeds: dict[str, list[tuple]] = {}
        for i, (n, _, k) in enumerate(self.notices):
            for piece, offset in pieces(n, k):
                least = offset + len(piece) - 1 + k  # a match begins so far before the piece's end, or up to 2 k nearer
                seeds.setdefault(piece, []).append((i, least, 2 * k, min(HEAD, len(n) - k), self.openings[i], len(n) + k + 1))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, where)
        if seeds:
            self.seeds.make_automaton()
        self.any = bool(seeds)
        self.verdicts: dict[tuple[int, str], tuple[int, int] | None] = {}

    def exact(self, joined: bytes) -> tuple[list[int], set[str]]:
        """Start words of all phrase places and the labels found; ``joined`` has a blank around each word."""
        at, labels = [], set()
        for phrase, label in self.phrases:
            begin = joined.find(phrase)
            while begin >= 0:
                labels.add(label)
                at.append(begin)
                begin = joined.find(phrase, begin + 1)
        if not at:
            return [], labels
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        return np.searchsorted(blanks, at).tolist(), labels

    def opens(self, i: int, head: str) -> bool:
        """Whether a match of notice ``i`` may begin with ``head``, which is not longer than its shortest match."""
        known = self.openings[i]
        if len(known) >= KEPT_VERDICTS:
            known.clear()
        notice, _, most = self.notices[i]
        known[head] = may = opening_distance(notice[: len(head) + most], head) <= most
        return may

    def verdict(self, i: int, ahead: str) -> tuple[int, int] | None:
        """(length, edits) of the best whole-word match of notice ``i`` at the start of ``ahead``, as the regex library confirms it."""
        if (i, ahead) in self.verdicts:
            return self.verdicts[i, ahead]
        if len(self.verdicts) >= KEPT_VERDICTS:
            self.verdicts.clear()
        notice, _, most = self.notices[i]
        ends = [(edits, n) for n, edits in prefix_distances(notice, ahead, most) if ahead[n : n + 1] == " "]
        m = None
        if ends:
            edits, n = min(ends)
            m = self.verify[i][edits].fullmatch(ahead, 0, n)
        self.verdicts[i, ahead] = best = (n, sum(m.fuzzy_counts)) if m else None
        return best

    def fuzzy(self, text: str) -> list[tuple]:
        """Verified notices of the joined words: label, first and last word, edits, matched text, edits a character.

        A match within k edits holds one of the notice's pieces unchanged, at most k characters from its place; so the
        word starts up to k characters around the place that each piece found implies are all there is to verify.
        Of matches of one notice that overlap, the one with the fewest edits stays, the first on ties.
        """
        if not self.any:
            return []
        hits = list(self.seeds.iter(text))
        if not hits:
            return []
        starts = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")[:-1] == 32) + 1
        words, last = starts.tolist(), len(starts)
        tried: set[int] = set()
        found: list[list[tuple[int, int, int]]] = [[] for _ in self.notices]
        many = len(self.notices)
        for end, where in hits:
            for i, before, span, n_head, openings, n_ahead in where:
                begin = end - before
                w = bisect_left(words, begin)
                while w < last and (at := words[w]) <= begin + span:
                    head = text[at : at + n_head]
                    may = openings.get(head)
                    if may is None:
                        may = self.opens(i, head)
                    if may and (key := w * many + i) not in tried:
                        tried.add(key)
                        got = self.verdict(i, text[at : at + n_ahead])
                        if got:
                            found[i].append((got[1], at, got[0]))
                    w += 1
        out = []
        for (notice, label, _), matches in zip(self.notices, found):
            for edits, at, n in _apart(matches):
                first = bisect_left(words, at)
                matched = text[at : at + n]
                out.append((label, first, first + matched.count(" "), edits, matched, edits / len(notice)))
        return sorted(out, key=lambda f: (f[1], f[0], f[3], f[2]))

    def scan(self, text: str | None) -> tuple:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()
        if not words:
            return 0, 0, None, None, "", "", 0.0, []
        joined = b" " + b" ".join(words) + b" "
        starts, base = self.exact(joined)
        near = self.fuzzy(joined.decode("utf-8", "surrogatepass"))
        labels = base | {f[0] for f in near}
        score = 1.0 if starts else max((1 - f[5] for f in near), default=0.0)
        spans = [dict(zip(("label", "first_word", "last_word", "edits", "matched"), f)) for f in near]
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def _apart(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (edits, start, length) those that overlap none with fewer edits, nor as many and an earlier start."""
    kept: list[tuple[int, int, int]] = []  # (start, end, edits), sorted
    for edits, at, n in sorted(matches):
        k = bisect_left(kept, (at,))
        if (k == 0 or kept[k - 1][1] <= at) and (k == len(kept) or at + n <= kept[k][0]):
            kept.insert(k, (at, at + n, edits))
    return [(edits, a, b - a) for a, b, edits in kept]


@lru_cache(4)
def _scanner(phrases: tuple, notices: tuple, chars_per_edit: int) -> Scanner:
    return Scanner(dict(phrases), dict(notices), chars_per_edit)


def license_scan(phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT):
    """A vectorised UDF text -> struct of ``_FIELDS``."""
    key = (tuple((PHRASES if phrases is None else phrases).items()), tuple((NOTICES if notices is None else notices).items()), chars_per_edit)

    @F.pandas_udf(_FIELDS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(*key)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for texts in batches:
            out = pd.DataFrame([scanner.scan(t) for t in texts], columns=names)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    return scan


def scan_licenses(docs: DataFrame, text: str = "text", keep: list[Column] | None = None, **how) -> DataFrame:
    """One row per document: ``keep`` (default doc_id), the counts and labels, and the fuzzy ``spans``.

    Null, empty and wordless texts have no words, no place, empty labels and score 0. The score is 1 where a phrase stands
    exactly, else one less the best notice's edits per character. Further columns are ignored.
    """
    return apply_struct(docs, license_scan(**how), [F.col(text)], keep or [F.col("doc_id")])
