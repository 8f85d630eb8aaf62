"""Text columns: cleaning, folding, tokens, truncation, sentences, keyword sets. All built-in functions but for NFKC."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs that the lexical index takes as one token.
TOKEN = r"[\p{L}\p{N}_]+"
#: Marks that end a question and are stripped from it. Fixed values.
END_MARKS = " ?？!！。.,，;；:："
#: Words that are no keywords. Fixed values.
STOP_WORDS = ("的", "了", "呢", "吗", "是", "在", "和", "与", "及", "怎么", "如何", "一下", "一个", "这个", "那个", "请问", "帮我", "需要", "可以")
CHUNK_SUMMARY_CHARS = 96


def nfkc():
    """Vectorised UDF: Unicode compatibility composition, which Spark has no function for."""

    @F.pandas_udf("string")
    def normalise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return normalise


def clean_lines(text: Column) -> Column:
    """Unix line ends, blanks and tabs as one blank, lines trimmed, empty lines dropped; null is empty."""
    unix = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    lines = F.transform(F.split(F.regexp_replace(unix, r"[ \t]{2,}+|\t", " "), "\n"), strip)
    return strip(F.array_join(F.filter(lines, lambda line: line != ""), "\n"))


def clean_text(text: Column) -> Column:
    return clean_lines(nfkc()(text))


#: Unicode's white space. Fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at either end; only the ends are looked at."""
    return F.btrim(text, F.lit(WHITE))


def beyond_ascii(text: Column) -> Column:
    """Whether any character takes more than a byte. Patterns that need a Han word skip a text without one at next to no cost."""
    return F.octet_length(text) > F.length(text)


def fold_ws(text: Column) -> Column:
    """White-space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_query(text: Column) -> Column:
    """Folded, without end marks on either side."""
    return F.btrim(fold_ws(text), F.lit(END_MARKS))


def normalize_question(text: Column) -> Column:
    """The cache key's form: lower case, single blanks."""
    return F.lower(fold_ws(F.coalesce(text, F.lit(""))))


def tokenize(text: Column) -> Column:
    """Tokens of the lexical index, lower-cased, in order; null has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def truncate_text(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last an ellipsis where something was cut."""
    cut = F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def folded_head(text: Column, limit: int) -> Column:
    """``truncate_text(fold_ws(text), limit)`` that folds no more of the text than it shows.

    The pattern takes ``limit`` + 2 characters of the folded text. No two of them in a row are blanks, so if the folded text
    is longer than ``limit``, what is taken still is when its last blank is trimmed.
    """
    units = rf"(?U)\A\s*+((?:\S|\s++){{0,{limit + 2}}}+)"
    return truncate_text(fold_ws(F.regexp_extract(text, units, 1)), limit)


def chunk_summary(text: Column) -> Column:
    return folded_head(text, CHUNK_SUMMARY_CHARS)


def split_sentences(text: Column) -> Column:
    """Pieces of the folded text that end in a sentence mark, trimmed, without empty ones."""
    parts = F.split(fold_ws(F.coalesce(text, F.lit(""))), r"(?<=[。！？!?；;])\s*")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def first_sentence(text: Column) -> Column:
    """The folded text up to the first sentence mark that white space follows; empty for no text."""
    return F.element_at(F.split(fold_ws(F.coalesce(text, F.lit(""))), r"(?<=[。！？.!?])\s+", 2), 1)


#: Tokens of the prompt budget: one CJK character, or a run of Latin letters, digits and path marks. A fixed value.
BUDGET_TOKEN = r"[一-鿿]|[A-Za-z0-9_./:-]+"


def estimate_tokens(text: Column) -> Column:
    """Budget tokens, and one more for each 80 characters (one at least)."""
    text = F.coalesce(text, F.lit(""))
    return (F.regexp_count(text, F.lit(BUDGET_TOKEN)) + F.greatest(F.lit(1), F.floor(F.length(text) / 80))).cast("int")


def keyword_set(text: Column) -> Column:
    """Distinct budget tokens less the stop words."""
    tokens = F.regexp_extract_all(fold_ws(F.coalesce(text, F.lit(""))), F.lit(BUDGET_TOKEN), F.lit(0))
    return F.array_except(F.array_distinct(tokens), F.array(*map(F.lit, STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two keyword sets; 0 when either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Up to so many kept values a search of the list for each value is cheaper than sorting.
SHORT_LIST = 64


def first_of_key(values: Column, key: Callable[[Column], Column], kind: str = "string", limit: int = 1 << 30) -> Column:
    """The first value of each key, in order, ``limit`` at most; values without a key are left out.

    With a small limit the kept keys are searched for each value. Without one, values are sorted by (key, place), each key's
    first is kept, and these are put in order again, so that long lists cost n log n; ``kind``, the values' type, must then be
    one that can be ordered.
    """
    if limit <= SHORT_LIST:
        start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast(f"array<{kind}>").alias("values"))

        def take(s: Column, v: Column) -> Column:
            new = ~F.array_contains(s["keys"], key(v)) & (F.size(s["keys"]) < limit)
            more = F.struct(F.array_append(s["keys"], key(v)).alias("keys"), F.array_append(s["values"], v).alias("values"))
            return F.when(new, more).otherwise(s)

        return F.aggregate(values, start, take, lambda s: s["values"])

    keyed = F.array_sort(F.filter(F.transform(values, lambda v, i: F.struct(key(v).alias("key"), i.alias("at"), v.alias("value"))), lambda e: e["key"].isNotNull()))
    none = F.array(F.lit(None).cast(f"struct<key:string,at:int,value:{kind}>"))
    first = lambda e, b: F.when(b.isNull() | (e["key"] != b["key"]), F.struct(e["at"].alias("at"), e["value"].alias("value")))
    # the lambda's variable holds the sorted list, which would else be made twice
    firsts = F.flatten(F.transform(F.array(keyed), lambda k: F.zip_with(k, F.concat(none, k), first)))
    kept = F.array_sort(F.filter(firsts, lambda e: e.isNotNull()))
    return F.transform(F.slice(kept, 1, limit), lambda e: e["value"])


def dedupe_keep_order(values: Column, limit: int = 1 << 30) -> Column:
    """Folded values without nulls, blanks and case-insensitive repeats, first spelling and order kept."""
    clean = F.filter(F.transform(values, fold_ws), lambda v: v.isNotNull() & (v != ""))
    return first_of_key(clean, F.lower, limit=limit)


def norm_scalar(value: Column) -> Column:
    """Trimmed, blank as null."""
    return F.nullif(strip(value.cast("string")), F.lit(""))


def norm_list(value: Column, is_text: bool = False) -> Column:
    """Trimmed non-blank entries of an array, or of a text split at commas of either width; null stays null when empty."""
    parts = F.split(value, "[,，]") if is_text else value
    kept = F.array_distinct(F.filter(F.transform(parts, norm_scalar), lambda v: v.isNotNull()))
    return F.when(F.size(kept) > 0, kept)


#: Patterns and marks of the redaction, in this order. Fixed values.
REDACTIONS = (
    (r"(?U)\b[\w.\-+]+@[\w.\-]+\.\w+\b", "[REDACTED_EMAIL]"),
    (r"(?<!\d)(1[3-9]\d{9})(?!\d)", "[REDACTED_PHONE]"),
    (r"(?<!\d)(\d{17}[\dXx]|\d{15})(?!\d)", "[REDACTED_ID]"),
    (r"(?<!\d)\d{16,19}(?!\d)", "[REDACTED_ACCOUNT]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED_IP]"),
)


def redact(text: Column) -> Column:
    """E-mail, mobile, id card, bank card and IP numbers replaced by marks, in that order; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern, mark in REDACTIONS:
        out = F.regexp_replace(out, pattern, mark)
    return out
