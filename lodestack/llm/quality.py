"""Quality rules: word, line and repetition counts, and tokeniser fertility with bands per script.

Fertility is measured on what two public vocabularies really make of a whole text: characters per token and the entropy of
the tokens by the byte-level one, the share of tokens that fall back to single bytes by the piece one. Each script has a band
for each measure. Few tokens measure less surely, so a band widens by ``SLACK`` over the root of their number.
"""

from __future__ import annotations

import base64
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import ASCII_SPACE, apply_struct, fresh

SYMBOLS = "#*$%&|<>"
_FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, "
    "n_tokens long, chars_per_token double, letters_per_token double, n_pieces long, fallback_share double, token_entropy double"
)
MEASURES = ("chars_per_token", "letters_per_token", "fallback_share", "token_entropy")


@dataclass(frozen=True)
class Band:
    """What a text of a script may measure; beyond it the text is rejected.

    ``low`` and ``high`` bound the characters per token, ``letters`` the letters and digits per token from below (tokens
    spent on symbols lower it), ``fallback`` the share of piece tokens that are bytes other than white space from above,
    ``entropy`` the token entropy as a share of its maximum for that many tokens from below.
    """

    low: float
    high: float
    letters: float
    fallback: float
    entropy: float


#: Bands of the scripts; a script not named has the last one. For Latin text they are the outer fences that ``fence_bands``
#: gives for the given documents (characters 1.1 to 3.8, letters 0.7, fallback 0, entropy 0.34), widened where prose that isn't
#: invented lies further out: English has some 4.5 characters a token, and names or formulas of other scripts fall back to
#: bytes. ``low`` lies below those documents' clean rows (1.82 and more), ``letters`` between theirs (1.59) and the symbol noise (1.28). The
#: other scripts' bands are as wide around their usual values.
BANDS = {
    "latin": Band(1.6, 7.5, 1.4, 0.25, 0.3),
    "cyrillic": Band(0.4, 7.5, 0.3, 0.5, 0.3),
    "greek": Band(0.4, 7.5, 0.3, 0.5, 0.3),
    "han": Band(0.3, 4.0, 0.2, 0.8, 0.25),
    "arabic": Band(0.4, 7.5, 0.3, 0.6, 0.25),
    "other": Band(0.25, 8.0, 0.0, 1.0, 0.2),
}
#: How much one token widens a band's characters, letters, fallback share and entropy.
SLACK = (5.0, 2.0, 0.6, 0.5)


def default_paths() -> tuple[str, str]:
    """The byte-level vocabulary as ranks and the piece vocabulary, from the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(4)
def _byte_encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def _piece_encoder(path: str):
    """The piece vocabulary, and which of its ids are bytes that are no white space."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    blank = {f"<0x{ord(c):02X}>" for c in ASCII_SPACE}
    spelt = np.array([pieces.is_byte(i) and pieces.id_to_piece(i) not in blank for i in range(pieces.get_piece_size())])
    return pieces, spelt


@lru_cache(1 << 16)
def _script_of(char: str) -> str:
    name = unicodedata.name(char, "")
    first = name.partition(" ")[0]
    return {"LATIN": "latin", "CYRILLIC": "cyrillic", "GREEK": "greek", "CJK": "han", "ARABIC": "arabic"}.get(first, "other")


def repeat_words(words: list, window: int = 5) -> int:
    """Words covered by windows that occur twice or more, the first occurrence included. Windows are numbered by
    doubling, so that a text takes a few numbers for each word however long it is.
    """
    if len(words) <= window:
        return 0
    numbers: dict = {}
    base = runs = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    for i in range(1, window):
        runs = np.unique(runs[:-1] * len(numbers) + base[i:], return_inverse=True)[1]
    hit = np.bincount(runs)[runs] > 1
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[i : i + len(hit)] |= hit
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    blanks = sum(map(text.count, ASCII_SPACE))
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        dup = sum(n - 1 for line, n in Counter(lines).items() if line.strip(ASCII_SPACE))
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), dup, repeat_words(words)


def fertility(text: str, encoder, pieces) -> tuple[str, int, float, float, int, float, float]:
    """Script, tokens, characters and letters per token, pieces, byte-fallback share and relative token entropy of a whole text."""
    ids = np.array(encoder.encode_ordinary(text), np.int32)
    if not len(ids):
        return "other", 0, 0.0, 0.0, 0, 0.0, 0.0
    scripts: Counter = Counter()
    letters = 0
    for char, n in Counter(text).items():
        letters += n * char.isalnum()
        if char.isalpha():
            scripts[_script_of(char)] += n
    model, spelt = pieces
    spelling = spelt[np.array(model.encode(text.encode("utf-8", "replace").decode()), np.int32)]
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    bits = float(-(share * np.log2(share)).sum())
    script = min(scripts, key=lambda s: (-scripts[s], s)) if scripts else "other"
    fallback = float(spelling.mean()) if len(spelling) else 0.0
    return script, len(ids), len(text) / len(ids), letters / len(ids), len(spelling), fallback, bits / max(1.0, math.log2(len(ids)))


def broken_bands(band: Band, tokens: int, chars: float, letters: float, pieces: int, fallback: float, entropy: float) -> list[str]:
    """The bounds that a text breaks."""
    counts = (tokens, tokens, pieces, tokens)
    wide, wide_letters, wide_fallback, wide_entropy = (x / math.sqrt(max(1, n)) for x, n in zip(SLACK, counts))
    tests = {
        "low": chars < band.low - wide, "high": chars > band.high + wide, "letters": letters < band.letters - wide_letters,
        "fallback": fallback > band.fallback + wide_fallback, "entropy": entropy < band.entropy - wide_entropy,
    }
    return [name for name, broken in tests.items() if broken]


def judge(text: str | None, encoder, pieces, bands: dict[str, Band] = BANDS) -> tuple:
    """All fields of a text; null counts as empty."""
    text = text or ""
    n, word_chars, symbols, dup, repeat = base_counts(text)
    failed = n < 10 or 100 * repeat > 20 * n
    script, *measured = fertility(text, encoder, pieces)
    kept = not failed and not broken_bands(bands.get(script, bands["other"]), *measured)
    return n, word_chars, symbols, dup, repeat, failed, kept, script, *measured


def fence_bands(measured: DataFrame, defaults: dict[str, Band] = BANDS, least: int = 1000, whiskers: float = 3.0) -> dict[str, Band]:
    """Bands of a corpus from ``quality_rules`` rows: by script the outer fences of all rows that pass the base rules, the
    quartiles and ``whiskers`` times their distance beyond. A script of under ``least`` rows keeps its default.
    """
    rows = measured.filter("not base_failed").groupBy("script")
    quartiles = [F.percentile_approx(m, [0.25, 0.75], 10_000).alias(m) for m in MEASURES]
    bands = dict(defaults)
    for r in rows.agg(F.count("*").alias("n"), *quartiles).filter(F.col("n") >= least).collect():  # one row a script
        fence = lambda m, up: r[m][up] + (whiskers if up else -whiskers) * (r[m][1] - r[m][0])  # noqa: E731, B023
        bands[r["script"]] = Band(fence("chars_per_token", 0), fence("chars_per_token", 1), fence("letters_per_token", 0), fence("fallback_share", 1), fence("token_entropy", 0))
    return bands


def rules(bands: dict[str, Band] | None = None, paths: tuple[str, str] | None = None):
    """A vectorised UDF text -> struct of ``_FIELDS``."""
    bands, paths = bands or BANDS, paths or default_paths()
    names = re.findall(r"(\w+) \w+", _FIELDS)

    @F.pandas_udf(_FIELDS)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, pieces = _byte_encoder(paths[0]), _piece_encoder(paths[1])
        for texts in batches:
            yield pd.DataFrame([judge(t, encoder, pieces, bands) for t in texts], columns=names)

    return measure


def quality_rules(docs: DataFrame, text: str = "text", bands: dict[str, Band] | None = None, paths: tuple[str, str] | None = None, keep: list[Column] | None = None) -> DataFrame:
    """One row per document: ``keep`` (default doc_id), the base counts, base_failed, kept and the fertility measures.

    Null and empty texts have no words and fail. Further columns of ``docs`` are ignored.
    """
    return apply_struct(docs, rules(bands, paths), [F.col(text)], keep or [F.col("doc_id")])


def keep_passing(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with their own columns, without the rows that the rules reject."""
    made = fresh(docs, "_quality")
    return docs.withColumn(made, rules(**how)(F.col(text))).filter(F.col(made)["kept"]).drop(made)
