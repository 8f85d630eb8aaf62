"""Toxicity: a convolutional text classifier over hashed word embeddings, trained by Spark's tasks in numpy.

Words and their first letters are hashed in the JVM; a word's embedding is the sum of both buckets' (so that inflected
forms share a part). Filters of one to three words, max pooling over the whole text and a logistic output follow. At
inference every filter's part of every bucket is one table row, so a text costs a gather, a sum of shifted rows and a
maximum, in blocks of words however long it is.

Every labelled row teaches. Rows are dealt to shards by a hash of their id; in each round each shard's task takes the
nets through its rows, and the mean of all shards' nets begins the next round. Beside the net that learns from all rows,
one for each third learns from the others, so that every row has a logit of a net that has not seen it: these calibrate
the score's cut over all rows and a threshold for each language. Which threshold a text meets is decided by its words
alone, by a naive Bayes guess over the same buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import apply_struct, cut

BITS = 20
SPACE = 1 << BITS
PREFIX = 5
WIDTHS = (1, 2, 3)
FILTERS = 12
DIM = 12
#: The score at which the query's contract calls a text toxic.
CUT = 0.3
#: Toxic rows (and others) under which a language gets no threshold of its own.
MIN_TOXIC = 15
#: Words of a text that are pooled at once.
BLOCK = 1 << 14
#: Nets beside the whole one, each of which leaves one part of the rows unseen.
FOLDS = 3
#: Labelled rows of a shard at most (on average), rows of one step and the steps' size.
SHARD, BATCH, RATE = 4000, 16, 0.012
#: Passes over all rows, four at most and two at least: those in which a net meets so many.
MET, PASSES = 60_000, (2, 4)
#: Buckets are learnt that are in ``MIN_DF`` rows and in one of ``RARE`` rows, so a net doesn't grow with the corpus.
MIN_DF, RARE = 8, 500
#: Rows that may be broadcast (id and label), and parameters of a net that are averaged at once.
FEW, PARAMETERS = 1_000_000, 1 << 13
_FIELDS = "score double, predicted int, lang_guess string, threshold double, predicted_by_lang int"


def words(text: Column) -> Column:
    """Hash buckets of the words (letters and digits, lower-cased) of a whole text; an empty array without words.

    The bucket of a word's first ``PREFIX`` letters stands above the word's own ``BITS`` bits.
    """
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(SPACE))
    return F.transform(parts, lambda w: F.shiftleft(bucket(F.concat(F.substring(w, 1, PREFIX), F.lit("-"))), BITS).bitwiseOR(bucket(w)))


@dataclass
class ToxicModel:
    """``row`` maps hash buckets to rows of ``table`` (0: not met often enough, all zero)."""

    row: np.ndarray
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    langs: list[str] = field(default_factory=list)
    lang_odds: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))

    def table(self) -> np.ndarray:
        """Bucket rows x (filters of width 1, first of width 2, second of width 2, ...)."""
        parts = [self.embed @ f[i] for f in self.filters for i in range(f.shape[0])]
        return np.concatenate(parts, 1).astype(np.float32)


def split(text: np.ndarray) -> np.ndarray:
    """Word bucket and prefix bucket (behind all words') of each word, two columns."""
    text = np.asarray(text, np.int64)
    return np.stack((text & (SPACE - 1), (text >> BITS) + SPACE), 1)


def _pad(rows: np.ndarray) -> np.ndarray:
    """Zero rows on both sides, so that every filter has a place in any text."""
    return np.pad(rows, ((2, 2), (0, 0)))


def _parts(lookup: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return lookup[rows[:, 0]] + lookup[rows[:, 1]]


def _pool(lookup: np.ndarray, rows: np.ndarray, bias: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Maxima over all places of a padded text, rectified, and their first places."""
    best = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32)
    place = np.zeros(len(best), np.int64)
    for begin in range(0, max(1, len(rows) - WIDTHS[-1] + 1), BLOCK):
        parts, at = _parts(lookup, rows[begin : begin + BLOCK + WIDTHS[-1] - 1]), 0
        last = begin + BLOCK + WIDTHS[-1] - 1 >= len(rows)
        for k, w in enumerate(WIDTHS):
            n = len(parts) - w + 1 if last else BLOCK
            total = parts[:n, at : at + FILTERS].copy()
            for i in range(1, w):
                total += parts[i : n + i, at + i * FILTERS : at + (i + 1) * FILTERS]
            at += w * FILTERS
            where = total.argmax(0)
            value, mine = total[where, np.arange(FILTERS)] + bias[k], slice(k * FILTERS, (k + 1) * FILTERS)
            more = value > best[mine]
            place[mine] = np.where(more, where + begin, place[mine])
            best[mine] = np.where(more, value, best[mine])
    return np.maximum(best, 0), place


def loss_and_gradients(model: ToxicModel, data: list[np.ndarray], toxic: np.ndarray, weight: float = 1.0) -> tuple[float, list[np.ndarray], float]:
    """Mean cross entropy of padded texts, its gradients by embed, filters, bias and out, and by the output's bias.

    The gradient of max pooling reaches only the places of the maxima. A toxic row counts ``weight`` times.
    """
    lookup, size = model.table(), len(data)
    found = [_pool(lookup, rows, model.bias) for rows in data]
    pooled, y = np.stack([p for p, _ in found]), np.asarray(toxic, float)
    rows, begins = np.concatenate(data), np.cumsum([0] + [len(d) for d in data[:-1]])
    place = np.stack([p for _, p in found]) + begins[:, None]
    z = np.clip((pooled @ model.out).astype(float) + model.out_bias, -30, 30)
    share = np.where(y > 0, weight, 1.0) / size
    loss, slope = float(((np.log1p(np.exp(z)) - y * z) * share).sum()), (1 / (1 + np.exp(-z)) - y) * share
    back = slope[:, None] * model.out * (pooled > 0)
    filters, bias, met, steps = [np.zeros_like(f) for f in model.filters], [], [], []
    for k, w in enumerate(WIDTHS):
        g, at = back[:, k * FILTERS : (k + 1) * FILTERS], place[:, k * FILTERS : (k + 1) * FILTERS]
        bias.append(g.sum(0))
        for i in range(w):
            e = rows[at + i]
            filters[k][i] = np.einsum("bfd,bf->df", model.embed[e[..., 0]] + model.embed[e[..., 1]], g)
            met.append(e.reshape(-1, 2))
            steps.append((g[..., None] * model.filters[k][i].T).reshape(-1, DIM))
    cells = np.concatenate(met)[:, :, None] * DIM + np.arange(DIM)
    embed = np.bincount(cells.ravel(), np.repeat(np.concatenate(steps)[:, None], 2, 1).ravel(), model.embed.size).reshape(model.embed.shape)
    return loss, [embed, *filters, *bias, slope @ pooled], float(slope.sum())


def new_net(row: np.ndarray, size: int, rate_of_toxic: float, seed: int = 3) -> ToxicModel:
    """A net for ``size`` buckets before training."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (size + 1, DIM)).astype(np.float32)
    embed[0] = 0
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
    rate = float(np.clip(rate_of_toxic, 1e-3, 1 - 1e-3))
    return ToxicModel(row, embed, filters, bias, out, float(np.log(rate / (1 - rate))))


def pack(model: ToxicModel) -> np.ndarray:
    """All that is learnt, as one vector."""
    return np.concatenate([p.ravel() for p in (model.embed, *model.filters, *model.bias, model.out)] + [[model.out_bias]]).astype(np.float32)


def unpack(model: ToxicModel, vector: np.ndarray) -> ToxicModel:
    """A net like ``model`` with the parameters of ``vector``."""
    old = (model.embed, *model.filters, *model.bias, model.out)
    parts = np.split(vector.astype(np.float32), np.cumsum([p.size for p in old]))
    new = [x.reshape(p.shape) for x, p in zip(parts, old)]
    n = len(WIDTHS)
    return ToxicModel(model.row, new[0], new[1 : 1 + n], new[1 + n : 1 + 2 * n], new[-1], float(parts[-1][0]))


class Adam:
    """Steps of one net over batches of padded texts; rows of ``embed`` that a batch doesn't have stay as they are."""

    def __init__(self, model: ToxicModel, rate: float, weight: float):
        self.model, self.rate, self.weight, self.steps = model, rate, weight, 0
        self.state = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.embed, *model.filters, *model.bias, model.out)]

    def step(self, met: np.ndarray, data: list[np.ndarray], toxic: np.ndarray) -> None:
        """``data`` hold places in ``met``, whose first is row 0, the padding."""
        net = self.model
        part = ToxicModel(net.row, net.embed[met], net.filters, net.bias, net.out, net.out_bias)
        _, grads, slope_bias = loss_and_gradients(part, data, toxic, self.weight)
        grads[0][0] = 0
        self.steps += 1
        places = [met] + [slice(None)] * (len(grads) - 1)
        for p, g, (m, v), at in zip((net.embed, *net.filters, *net.bias, net.out), grads, self.state, places):
            g = g + 1e-5 * p[at]
            m[at] += 0.1 * (g - m[at])
            v[at] += 0.01 * (g * g - v[at])
            p[at] -= self.rate * (m[at] / (1 - 0.9**self.steps)) / (np.sqrt(v[at] / (1 - 0.99**self.steps)) + 1e-8)
        net.out_bias -= self.rate * slope_bias


def _texts(b: pa.RecordBatch) -> list[np.ndarray]:
    w = b.column("w")
    ends, flat = np.asarray(w.offsets), np.asarray(w.values)
    return [flat[x:y] for x, y in zip(ends, ends[1:])]


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over labelled rows: rows that have a bucket (df) and its times in them (tf), by language."""
    df, tf = {}, {}
    for b in batches:
        for text, lang in zip(_texts(b), b.column("lang").to_pylist()):
            at, n = np.unique(split(text).ravel(), return_counts=True)
            if lang not in df:
                df[lang], tf[lang] = np.zeros(2 * SPACE, np.int64), np.zeros(2 * SPACE, np.int64)
            df[lang][at] += 1
            tf[lang][at] += n
    for lang in df:
        at = np.flatnonzero(df[lang])
        names = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(at), np.int64)))
        yield from pa.table({"bucket": at, "lang": names, "df": df[lang][at], "tf": tf[lang][at]}).to_batches()


def vocabulary(rows: DataFrame, min_df: int) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Table rows by bucket, log odds of each language by table row, and the languages' names, of buckets in ``min_df`` rows."""
    counts = rows.select("w", "lang").mapInArrow(_bucket_counts, "bucket long, lang string, df long, tf long")
    counts = counts.groupBy("bucket", "lang").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    counts = counts.groupBy("bucket").agg(F.sum("df").alias("df"), F.collect_list(F.struct("lang", "tf")).alias("by")).filter(F.col("df") >= min_df)
    got = counts.select("bucket", F.explode("by").alias("b")).select("bucket", "b.lang", "b.tf").toPandas()
    met = np.unique(got["bucket"].to_numpy(np.int64))
    row = np.zeros(2 * SPACE, np.int32)
    row[met] = np.arange(1, len(met) + 1)
    known = got[got["lang"].notna()]
    names = sorted(known["lang"].unique())
    if not names:
        return row, met, [], np.zeros((1, 0), np.float32)
    tf = np.zeros((len(met) + 1, len(names)))
    tf[row[known["bucket"].to_numpy(np.int64)], np.searchsorted(names, known["lang"].to_numpy(str))] = known["tf"]
    rate = np.log((tf + 0.5) / (tf.sum(0) + 0.5 * len(tf)))
    rate[0] = 0  # words not met often enough say nothing
    return row, met, names, (rate - rate.mean(1, keepdims=True)).astype(np.float32)


def _train_task(shared, rate: float, weight: float):
    """For mapInArrow over a shard's labelled rows: what one pass over them changes in the nets, in half precision and cut into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, base, vectors = shared.value
        base.row = row
        nets = [Adam(unpack(base, v), rate, weight) for v in vectors]
        seen = np.zeros(len(nets))
        for b in batches:
            texts, toxic, fold = _texts(b), b.column("toxic").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False)
            for begin in range(0, len(texts), BATCH):
                data = [_pad(row[split(t)]) for t in texts[begin : begin + BATCH]]
                met, places = np.unique(np.concatenate(data), return_inverse=True)
                data = np.split(places.reshape(-1, 2), np.cumsum([len(d) for d in data])[:-1])
                for g, net in enumerate(nets):
                    mine = np.flatnonzero(fold[begin : begin + BATCH] != g)
                    if len(mine):
                        net.step(met, [data[i] for i in mine], toxic[begin : begin + BATCH][mine])
                        seen[g] += len(mine)
        for g, net in enumerate(nets):
            if seen[g]:
                change = (pack(net.model) - vectors[g]).astype(np.float16)
                blocks = [change[at : at + PARAMETERS].tobytes() for at in range(0, len(change), PARAMETERS)]
                n = len(blocks)
                yield pa.RecordBatch.from_pydict({"net": pa.array([g] * n, pa.int32()), "block": pa.array(range(n), pa.int32()), "seen": pa.array([seen[g]] * n, pa.float64()), "part": pa.array(blocks, pa.binary())})

    return run


def _mean_block(blocks: pd.DataFrame) -> pd.DataFrame:
    """The mean of one block over all shards, each with the weight of its rows, summed in one order."""
    blocks = blocks.sort_values(["seen", "part"])
    mean = np.average([np.frombuffer(p, np.float16).astype(float) for p in blocks["part"]], 0, blocks["seen"])
    return pd.DataFrame({"net": blocks["net"].iloc[:1], "block": blocks["block"].iloc[:1], "part": [mean.astype(np.float32).tobytes()]})


def train(rows: DataFrame, base: ToxicModel, weight: float, rounds: int, rate: float = RATE) -> list[ToxicModel]:
    """The nets of the folds and, last, that of all rows (``w``, ``toxic``, ``fold``; a partition is a shard)."""
    sc, nets = rows.sparkSession.sparkContext, [base] * (FOLDS + 1)
    row = base.row
    for _ in range(rounds):
        shared = sc.broadcast((row, ToxicModel(row[:0], base.embed, base.filters, base.bias, base.out, base.out_bias), [pack(n) for n in nets]))
        made = rows.select("w", "toxic", "fold").mapInArrow(_train_task(shared, rate, weight), "net int, block int, seen double, part binary")
        got = made.groupBy("net", "block").applyInPandas(_mean_block, "net int, block int, part binary").collect()
        for g in range(len(nets)):
            parts = [np.frombuffer(p, np.float32) for _, p in sorted((r.block, bytes(r.part)) for r in got if r.net == g)]
            nets[g] = unpack(base, pack(nets[g]) + np.concatenate(parts)) if parts else nets[g]
        shared.destroy()
    return nets


def _unseen_task(shared):
    """For mapInArrow over labelled rows: the logit by the net that hasn't seen the row, to three places, and the guessed language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = shared.value
        tables = [n.table() for n in nets]
        for b in batches:
            texts, fold = _texts(b), b.column("fold").to_pylist()
            z = [round(logits(nets[g], tables[g], t), 3) for t, g in zip(texts, fold)]
            guess = [guess_language(nets[0], t) for t in texts]
            yield pa.RecordBatch.from_pydict({"z": pa.array(z, pa.float64()), "toxic": b.column("toxic"), "guess": pa.array(guess, pa.string())})

    return run


def logits(model: ToxicModel, lookup: np.ndarray, text: np.ndarray) -> float:
    pooled, _ = _pool(lookup, _pad(model.row[split(text)]), model.bias)
    return float(pooled @ model.out) + model.out_bias


def guess_language(model: ToxicModel, text: np.ndarray) -> str | None:
    """The language whose words a text has; null for texts without a known word, and where no language was learnt."""
    seen = np.bincount(model.row[split(text)].ravel(), minlength=1)
    known = np.flatnonzero(seen)
    if not model.langs or not known[known > 0].size:
        return None
    return model.langs[int((seen[known] @ model.lang_odds[known]).argmax())]


def _best_cut(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The logit that gives the best F1, in the middle of the gap to the next lower logit. ``y`` of ``n`` rows are toxic."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.cumsum(n[order]) + y.sum())
    ends = np.append(z[order][1:] < z[order][:-1], True)
    k = int(np.argmax(np.where(ends, f1, -1)))
    below = z[order][k + 1] if k + 1 < len(z) else z[order][k] - 2
    return float((z[order][k] + below) / 2)


def calibrate(model: ToxicModel, z: np.ndarray, toxic: np.ndarray, langs: list[str | None], min_toxic: int = MIN_TOXIC, n: np.ndarray | None = None) -> ToxicModel:
    """Shift the logits so that ``CUT`` is the best threshold over all rows, and give each language its own threshold.

    ``z`` are logits of rows that the net hasn't been trained on, ``langs`` the languages guessed from their words. With
    ``n``, each stands for so many rows, of which ``toxic`` are toxic. A language with under ``min_toxic`` toxic rows (or
    as few others) keeps CUT.
    """
    n = np.ones(len(z)) if n is None else n
    if min(toxic.sum(), (n - toxic).sum()) < 1:
        return model
    model.shift = float(np.log(CUT / (1 - CUT))) - _best_cut(z, toxic, n)
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if min(toxic[own].sum(), (n - toxic)[own].sum()) >= min_toxic:
            model.thresholds[lang] = float(1 / (1 + np.exp(-(_best_cut(z[own], toxic[own], n[own]) + model.shift))))
    return model


def labelled(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, per_class: int | None = None, max_chars: int | None = None) -> DataFrame:
    """(w, lang, toxic, fold) of the rows that teach, stored, each shard a partition in the order of a hash of the ids."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.filter("toxic in (0, 1)")
    if allowed is not None:
        marks = marks.filter(allowed)
    counts = dict(marks.groupBy("toxic").count().collect())
    if per_class is not None:
        u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
        marks = marks.filter(u < F.when(F.col("toxic") == 1, per_class / counts.get(1, 1)).otherwise(per_class / counts.get(0, 1)))
    n = sum(c if per_class is None else min(c, per_class) for c in counts.values())
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(marks) if sum(counts.values()) <= FEW else marks, "doc_id")
    if max_chars is not None:
        rows = rows.filter(F.length("text") <= max_chars)
    shards = max(1, -(-n // SHARD))
    by = lambda seed, parts: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts)).cast("int")
    rows = rows.select("*", by(11, shards).alias("shard"), F.xxhash64("doc_id", F.lit(23)).alias("place"), by(31, FOLDS).alias("fold")).repartitionById(shards, "shard")
    rows = rows.groupBy("shard", "place", "doc_id").agg(F.min(F.struct("text", "lang")).alias("r"), F.first("toxic").alias("toxic"), F.first("fold").alias("fold"))
    return cut(rows.sortWithinPartitions("shard", "place", "doc_id").select(words(F.col("r.text")).alias("w"), F.col("r.lang").alias("lang"), "toxic", "fold"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, per_class: int | None = None, max_chars: int | None = None) -> ToxicModel:
    """Fit on all labelled documents (doc_id, text, lang joined with doc_id, toxic), each whole.

    Of rows that repeat an id the one of the least text teaches. ``allowed`` restricts the rows that may teach; so do
    ``per_class`` (about so many rows of either label, by a hash of the id) and ``max_chars``, where they are given.
    Without labelled rows every score is the prior one half. The driver gets counts, the buckets that are learnt with
    their counts by language, and ``FOLDS + 1`` nets.
    """
    spark = docs.sparkSession
    rows = labelled(docs, labels, allowed, per_class, max_chars)
    counts = dict(rows.groupBy("toxic").count().collect())
    others, toxic = counts.get(0, 0), counts.get(1, 0)
    n = others + toxic
    row, met, langs, odds = vocabulary(rows, max(MIN_DF, n // RARE))
    model = new_net(row, len(met), toxic / n if n else 0.5)
    if len(met) and min(others, toxic):
        passes = min(max(-(-MET // n), PASSES[0]), PASSES[1])
        nets = train(rows, model, max(1.0, others / 3 / toxic), passes)  # toxic rows weigh a quarter of all at least
        for net in nets:
            net.langs, net.lang_odds = langs, odds
        model = nets[-1]
        shared = spark.sparkContext.broadcast(nets[:FOLDS])
        unseen = rows.select("w", "toxic", "fold").mapInArrow(_unseen_task(shared), "z double, toxic int, guess string")
        got = unseen.groupBy("z", "guess").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).toPandas().sort_values(["z", "guess"])
        guess = [None if pd.isna(x) else x for x in got["guess"]]
        model = calibrate(model, got["z"].to_numpy(float), got["toxic"].to_numpy(float), guess, n=got["n"].to_numpy(float))
        shared.destroy()
    model.langs, model.lang_odds = langs, odds
    return model


def scorer(spark: SparkSession, model: ToxicModel):
    """A vectorised UDF word buckets -> struct of ``_FIELDS``."""
    shared = spark.sparkContext.broadcast((model, model.table()))

    @F.pandas_udf(_FIELDS)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, lookup = shared.value
        for texts in batches:
            z = np.array([logits(model, lookup, t) for t in texts]) + model.shift
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            langs = [guess_language(model, t) for t in texts]
            cuts = np.array([model.thresholds.get(x, CUT) for x in langs])
            yield pd.DataFrame({"score": p, "predicted": (p >= CUT).astype(np.int32), "lang_guess": pd.Series(langs, dtype=object), "threshold": cuts, "predicted_by_lang": (p >= cuts).astype(np.int32)})

    return score


def toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """One row per document: ``keep`` (default doc_id), score in (0, 1), predicted (score >= CUT), and by the language
    guessed from the text lang_guess (null if no word is known), its threshold and predicted_by_lang (score >= threshold).

    Null, empty and wordless texts have the score of no word at all; equal texts have equal rows; further columns
    are ignored.
    """
    return apply_struct(docs, scorer(docs.sparkSession, model), [words(F.col(text))], keep or [F.col("doc_id")])
