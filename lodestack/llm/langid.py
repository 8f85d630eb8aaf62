"""Language ID by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import apply_struct, cut, fresh, sample_by_class

UNDETERMINED = "und"
BUCKETS = 1 << 15
#: The mean bit loss by which the nearest codeword must beat the next one, else a text is ambiguous.
MIN_GAP = 0.02
_FIELDS = "lang_pred string, score double, ambiguous boolean, gap double, bit_loss double, n_letters long"


@dataclass
class LanguageModel:
    """``codes`` (languages x bits, +-1), n-gram log odds ``weights`` (buckets x bits) and the ``scale`` of each bit."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    bias: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A codeword of +-1 for each of ``n`` languages.

    Up to six languages get the exhaustive code (every split of the languages in two is one bit); more get the
    best of 64 random codes by smallest Hamming distance.
    """
    if n == 1:
        return np.ones((1, 1), np.float32)
    if n <= 6:
        splits = [s for s in product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.float32).T
    rng, best, reach = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(64):
        code = rng.choice(np.array([1, -1], np.float32), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        distance = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * bits
        if distance.min() > reach:
            best, reach = code, distance.min()
    return best


_PLAIN = np.arange(256, dtype=np.uint32)
_PLAIN[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def ngrams(text: str) -> np.ndarray:
    """Buckets of the two- and three-byte runs of the lower-cased text; ASCII other than letters counts as a blank."""
    b = _PLAIN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    mix = lambda x, m: (x * np.uint32(m)) >> np.uint32(17)  # noqa: E731  the upper 15 bits
    return np.concatenate((mix(two, 2654435761), mix(three, 2246822519))).astype(np.int32)


def text_counts(texts: list[str]) -> np.ndarray:
    """n-gram counts of a language: a thousand parts for each text, no n-gram more than fifty of them."""
    counts = np.zeros(BUCKETS)
    for text in sorted(texts):
        g = ngrams(text)
        counts += np.minimum(np.bincount(g, minlength=BUCKETS) / max(1, len(g)), 0.05) * 1000
    return counts


def bit_weights(names: list[str], counts: np.ndarray) -> LanguageModel:
    """One naive-Bayes n-gram classifier for each bit, from one row of counts for each of the sorted ``names``."""
    codes = codewords(max(1, len(names)))
    if not names:
        return LanguageModel([], codes, np.zeros((BUCKETS, 1), np.float32), np.ones(1), np.zeros(1))
    rate = counts + 0.05
    rate /= rate.sum(1, keepdims=True)
    weights = np.zeros((BUCKETS, codes.shape[1]), np.float32)
    for bit in range(codes.shape[1]):
        yes, no = codes[:, bit] > 0, codes[:, bit] < 0
        weights[:, bit] = np.log(rate[yes].mean(0)) - np.log(rate[no].mean(0)) if no.any() else 1.0
    return LanguageModel(names, codes, weights, np.ones(codes.shape[1]), np.zeros(codes.shape[1]))


def fit_scales(model: LanguageModel, languages: list[str], raw: np.ndarray) -> LanguageModel:
    """``model`` with each bit's scale and bias fitted by logistic regression on the ``raw`` margins of taught texts."""
    at = {x: i for i, x in enumerate(model.languages)}
    sign = model.codes[np.array([at[x] for x in languages])]
    a, b = np.ones(model.codes.shape[1]), np.zeros(model.codes.shape[1])
    for _ in range(200):  # two numbers a bit, by gradient ascent on the log likelihood
        wrong = sign / (1 + np.exp(np.clip(sign * (raw * a + b), -30, 30)))
        a += 2.0 * (wrong * raw).mean(0)
        b += 0.5 * wrong.mean(0)
    model.scale, model.bias = np.maximum(a, 0.1), b
    return model


def train(texts: list[str], languages: list[str]) -> LanguageModel:
    """The model of texts in memory, in the order of (language, text)."""
    rows = sorted(zip(languages, texts))
    names = sorted(set(languages))
    model = bit_weights(names, np.array([text_counts([t for k, t in rows if k == name]) for name in names]))
    return fit_scales(model, [k for k, _ in rows], np.array([margins(model, t) for _, t in rows])) if rows else model


def margins(model: LanguageModel, text: str) -> np.ndarray:
    """Mean log odds of each bit, damped for texts of a few n-grams."""
    g = ngrams(text)
    return model.weights[g].sum(0) * (model.scale / (len(g) + 4)) + model.bias


def decode(model: LanguageModel, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of every codeword (each bit weighed by how sure it is) and their shares of exp(-loss)."""
    sure = 0.25 + np.abs(np.tanh(m))
    losses = (np.log1p(np.exp(np.clip(-model.codes * m, -30, 30))) * sure).sum(1) / sure.sum()
    share = np.exp(-(losses - losses.min()) * model.codes.shape[1])
    return losses, share / share.sum()


def identifier(model: LanguageModel, min_gap: float = MIN_GAP):
    """A vectorised UDF text -> struct of ``_FIELDS``."""

    @F.pandas_udf(_FIELDS)
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                letters = sum(map(str.isalpha, text)) if text else 0
                if not letters or not model.languages:
                    rows.append((UNDETERMINED, 0.0, bool(letters), 0.0, 0.0, letters))
                    continue
                losses, share = decode(model, margins(model, text))
                order = np.argsort(losses, kind="stable")
                gap = float(losses[order[1]] - losses[order[0]]) if len(order) > 1 else 1.0
                best = order[0]
                rows.append((model.languages[best], float(share[best]), gap < min_gap, gap, float(losses[best]), letters))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "ambiguous", "gap", "bit_loss", "n_letters"])

    return identify


def fit_languages(rows: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 400, max_rows: int = 25_600, max_chars: int = 20_000) -> LanguageModel:
    """Fit on a bounded sample: at most ``per_language`` distinct texts of each language that occurs, all of them if it has
    no more, and fewer of each where languages are so many that ``max_rows`` would be passed. Longer texts teach by their
    first ``max_chars`` characters. Rows without text or language teach nothing; without any usable row the model knows no
    language and calls every text ``und``.
    """
    # The texts stay in the tasks: one row of counts for each language comes to the driver, then one number a bit for each text.
    usable = rows.select(F.substring(F.col(text), 1, max_chars).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and length(text) > 0")
    sample = cut(sample_by_class(usable, "lang", "text", per_language, max_rows).withColumn("text_hash", F.sha2("text", 256)))

    def counted(group: pd.DataFrame) -> pd.DataFrame:  # at most per_language texts of max_chars
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "counts": [text_counts(list(group["text"]))]})

    counts = {r["lang"]: r["counts"] for r in sample.groupBy("lang").applyInPandas(counted, "lang string, counts array<double>").collect()}
    names = sorted(counts)
    model = bit_weights(names, np.array([counts[k] for k in names]))
    if not names:
        return model
    known = sample.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def raw_margins(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: margins(known.value, t))

    got = sample.select("lang", "text_hash", raw_margins("text").alias("raw")).collect()
    got.sort(key=lambda r: (r["lang"], r["text_hash"]))
    return fit_scales(model, [r["lang"] for r in got], np.array([r["raw"] for r in got]))


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """One row per document: ``keep`` (default doc_id), lang_pred, score, ambiguous, gap, bit_loss, n_letters.

    Null, empty and letterless texts are ``und`` with score 0. Equal texts get equal answers; columns other than
    those named are ignored.
    """
    return apply_struct(docs, identifier(model), [F.col(text)], keep or [F.col("doc_id")])


def reject_unreadable(docs: DataFrame, model: LanguageModel, text: str = "text", settled: int = 200) -> DataFrame:
    """``docs`` with their own columns, less those of no language.

    Rejected are ``und`` texts, and texts whose nearest codeword is no better than chance (a mean bit loss over log 2) or
    is hardly nearer than the next one. Every text is tested; as few letters say less, chance is given one part in
    the root of the letters more, and the gap that a text must show grows with its letters towards the full one, of
    which ``settled`` letters ask for half.
    """
    made = fresh(docs, "_language")
    out = docs.withColumn(made, identifier(model)(F.col(text)))
    r = lambda f: F.col(made)[f]
    chance = r("bit_loss") > float(np.log(2)) * (1 + 1 / F.sqrt(F.greatest(r("n_letters"), F.lit(1))))
    close = r("gap") < MIN_GAP * r("n_letters") / (r("n_letters") + settled)
    return out.filter((r("lang_pred") != UNDETERMINED) & ~(chance | close)).drop(made)
