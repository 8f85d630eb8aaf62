"""Each operator against brute force, and on nulls, empty and odd texts, repeated rows, empty tables and extra columns."""

import hashlib
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import bpe, extraction, fingerprint, langid, licenses, mixing, near_dedup, quality, token_lengths, toxicity
from lodestack.llm.common import held_out, sample_by_class

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "a", "\n\n \n", "  two  words ", "<|endoftext|> mark", "日本語のテキスト 👩‍👩‍👧 é", "x" * 5000, "ab ab ab ab ab ab ab ab ab ab ab ab", " \x1c\x85 odd\x0bblank\x0c"]
SCHEMA = "doc_id long, text string, lang string, source string, kept string, _made string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None if i % 3 else f"s{i % 2}", "x", "y") for i, t in enumerate(ODD)]
    rows += [rows[3], rows[9], (None, "no id here", "en", "s1", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_counts_equal_brute_force(odd, none):
    got = {r["doc_id"]: r for r in quality.quality_rules(odd).collect()}
    for i, text in enumerate(ODD):
        words = WORD.findall(text or "")
        windows = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        times = Counter(windows)
        covered = {j + k for j, w in enumerate(windows) if times[w] > 1 for k in range(5)}
        lines, seen, dup = (text or "").split("\n"), set(), 0
        for line in lines:
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        r = got[i]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines, r.base_failed) == (len(words), sum(map(len, words)), len(covered), dup, failed)
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or "")) and not (r.kept and r.base_failed)
    assert quality.quality_rules(none).count() == 0
    assert quality.keep_passing(odd).columns == odd.columns


PROSE = "the quick brown fox jumps over a lazy dog and then some other animals come along to see what happened here today again".split()


@pytest.mark.parametrize("band,text", [
    ("low", "".join("bcdfgpqz"[i] for i in np.random.default_rng(1).integers(0, 8, 6000))),
    ("high", " ".join(f"{a} {b}" for a in ["internationalization", "responsibilities", "characteristics"] for b in ["straightforward", "understanding", "environmental", "approximately", "administration"] * 9)),
    ("letters", " ".join(f"{w}{m}" for w, m in zip(PROSE * 4, ["#*|#", "$%$<", "%%|&", "&#&>", "<>|$#", "*&*"] * 99))),
    ("fallback", " ".join(f"{a} {b} {chr(0x2600 + (i * 9 + j) % 200)}" for i, a in enumerate(PROSE) for j, b in enumerate(PROSE[:9]))),
    ("entropy", " ".join(f"the{' the' * 40} {a} {b}" for a in PROSE for b in PROSE)),
])
def test_each_band_rejects_alone(band, text):
    encoder, pieces = (load(p) for load, p in zip((quality._byte_encoder, quality._piece_encoder), quality.default_paths()))
    script, *measured = quality.fertility(text, encoder, pieces)
    assert script == "latin" and quality.broken_bands(quality.BANDS["latin"], *measured) == [band]


def test_fertility_equals_brute_force(spark):
    import sentencepiece
    import tiktoken  # noqa: F401

    model = sentencepiece.SentencePieceProcessor(model_file=quality.default_paths()[1])
    encoder = quality._byte_encoder(quality.default_paths()[0])
    texts = [" ".join(PROSE), "naïve Ǆ ʘ words of \U0001e900 many\nlines and\ttabs here", "日本語のテキスト 日本", " ".join(PROSE * 300)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        ids, pieces, r = encoder.encode_ordinary(text), model.encode(text, out_type=str), got[i]
        share = [n / len(ids) for n in Counter(ids).values()]
        assert (r.n_tokens, r.n_pieces) == (len(ids), len(pieces)) and r.chars_per_token == len(text) / len(ids)
        assert r.letters_per_token == sum(c.isalnum() for c in text) / len(ids)
        spelt = [p for p in pieces if re.fullmatch("<0x[0-9A-F]{2}>", p) and int(p[3:5], 16) not in (9, 10, 11, 12, 13, 32)]
        assert abs(r.fallback_share - len(spelt) / len(pieces)) < 1e-12
        assert abs(r.token_entropy + sum(x * np.log2(x) for x in share) / max(1, np.log2(len(ids)))) < 1e-9
    assert got[0].kept and got[2].script == "han" and got[3].base_failed
    bands = quality.fence_bands(quality.quality_rules(spark.createDataFrame([(i, " ".join([*PROSE[i % 9 :], str(i)])) for i in range(40)], "doc_id long, text string")), least=40)
    assert bands["han"] == quality.BANDS["han"] and bands["latin"] != quality.BANDS["latin"] and bands["latin"].low < 5 < bands["latin"].high


def test_long_text_is_counted_in_bounded_numbers():
    words = [f"w{i}" for i in range(300_000)]
    assert quality.repeat_words(words) == 0
    assert quality.repeat_words(words + words[1000:1005] + ["end"] + words[7:14]) == 5 + 7 + 5 + 7
    assert quality.repeat_words(list("abcdeabcde")) == 10 and quality.repeat_words(list("abcde")) == 0 and quality.repeat_words(["a"] * 9) == 9


def test_language_id(spark, odd, none):
    words = {"en": "the of and to in that was with", "de": "der und die nicht ein zu von mit", "fr": "le la les des une que dans pour"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[k].split(), 30)), k) for i, k in enumerate(list(words) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs.filter(~held_out(F.col("doc_id"))))
    got = langid.identify_languages(docs, model, keep=[F.col("doc_id"), F.col("lang"), held_out(F.col("doc_id")).alias("held_out")]).collect()
    assert all(r.lang == r.lang_pred for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    odd_rows = {r.doc_id: r for r in langid.identify_languages(odd, model).collect()}
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, ODD[i] or ""))) for i, r in odd_rows.items() if i is not None)
    assert all(0 <= r.score <= 1 for r in odd_rows.values())
    assert langid.fit_languages(none).languages == [] and langid.identify_languages(none, model).count() == 0
    assert langid.reject_unreadable(docs, model).count() == len(rows)


def test_counts_made_in_tasks_teach_what_texts_in_memory_teach(spark):
    rng = np.random.default_rng(1)
    rows = sorted({(k, " ".join(rng.choice(list(k * 3), 20))) for k in ("abcde", "defgh", "ghijk") for _ in range(40)})
    there = langid.fit_languages(spark.createDataFrame(rows, "lang string, text string").repartition(5))
    here = langid.train([t for _, t in rows], [k for k, _ in rows])
    assert there.languages == here.languages and np.array_equal(there.weights, here.weights)
    assert np.allclose(there.scale, here.scale) and np.allclose(there.bias, here.bias)


def test_languages_of_few_texts_and_many_copies_are_learnt(spark):
    """No language is missed for its copies or for the number of languages, and copies don't pass the bound."""
    few = [(f"l{k}", f"text {k} {j} {'abcdefghijkl'[k] * 9}") for k in range(12) for j in range(3)]
    many = [("hot", "one hot text")] * 3000 + [("hot", f"cold text number {i}") for i in range(900)] + [("long", "lang " * 5000)]
    docs = spark.createDataFrame(few * 700 + many, "lang string, text string").repartition(4)
    got = sample_by_class(docs, "lang", "text", 400, 25_600).collect()
    size = Counter(r.lang for r in got)
    assert len({tuple(r) for r in got}) == len(got) and size["hot"] == 400 and {size[f"l{k}"] for k in range(12)} == {3}
    assert langid.fit_languages(docs).languages == sorted({r[0] for r in few + many})
    names = [f"n{i:03}" for i in range(90)]
    assert langid.fit_languages(spark.createDataFrame([(n, f"{n} words {i}") for n in names for i in range(3)], "lang string, text string")).languages == names
    assert set(Counter(r.lang for r in sample_by_class(docs, "lang", "text", 400, 28).collect()).values()) <= {1, 2}


@pytest.mark.parametrize("n", [2, 6, 9])
def test_decoding_equals_brute_force_for_exhaustive_and_random_codes(n):
    """Up to six languages have the exhaustive code, more a random one: both end to end, with held-out texts."""
    rng = np.random.default_rng(n)
    vocabularies = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 7)))) for _ in range(40)] for _ in range(n)]
    say = lambda k, m: " ".join(rng.choice(vocabularies[k], m))
    texts, langs = zip(*[(say(k, 40), f"l{k}") for k in range(n) for _ in range(12)])
    model = langid.train(list(texts), list(langs))
    right = 0
    for k in range(n):
        text = say(k, 25)
        m = langid.margins(model, text)
        losses, share = langid.decode(model, m)
        for row, loss in zip(model.codes, losses):  # each bit's logistic loss, weighed by how sure the bit is
            sure = [0.25 + abs(np.tanh(x)) for x in m]
            assert abs(loss - sum(w * np.log1p(np.exp(-c * x)) for w, c, x in zip(sure, row, m)) / sum(sure)) < 1e-6
        assert abs(share.sum() - 1) < 1e-9 and share.argmax() == losses.argmin()
        right += model.languages[int(losses.argmin())] == f"l{k}"
    assert right == n


def test_ties_and_ambiguous_texts(spark):
    """Two languages of the same texts: the first by name wins, with a gap of nothing and the flag."""
    texts = ["one two three four five six seven", "eight nine ten eleven twelve"]
    same = langid.train(texts + texts, ["bb", "bb", "aa", "aa"])
    docs = spark.createDataFrame([(1, texts[0] * 9), (2, texts[1] * 9), (3, texts[0] * 9)], "doc_id long, text string")
    rows = {r.doc_id: r for r in langid.identify_languages(docs, same).collect()}
    assert all(r.lang_pred == "aa" and r.ambiguous and r.gap < 1e-9 and abs(r.score - 0.5) < 1e-6 for r in rows.values())
    assert rows[1][1:] == rows[3][1:] and langid.reject_unreadable(docs, same).count() == 0


def test_short_texts_are_tested_too(spark):
    words = {"en": "the of and to in that was with", "de": "der und die nicht ein zu von mit"}
    rng = np.random.default_rng(0)
    rows = [(" ".join(rng.choice(words[k].split(), 30)), k) for k in list(words) * 40]
    model = langid.train(*map(list, zip(*rows)))
    short = ["the of and to in", "und die nicht", "was with that", "1 2 3", "", None]
    docs = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")
    assert {r.doc_id for r in langid.reject_unreadable(docs, model).collect()} == {0, 1, 2}


def test_codewords_are_distinct():
    for n in (2, 4, 6, 20):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code}) == n and set(np.unique(code)) <= {-1, 1}


def test_bpe_equals_the_library_and_round_trips(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    more = ["a  b   c", "x\n \ny", " \n lead", "trail  ", "don't we'll", "aaaa" * 50, "\t\ttabs\r\n", "½²x 12 345"]
    rows = [(i, t) for i, t in enumerate(ODD + more)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode_digests(docs).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(docs).collect()}
    back = {r.doc_id: r.t for r in bpe.encode_documents(docs).select("doc_id", bpe.decode_ids()("ids").alias("t")).collect()}
    for i, text in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[i] == want and back[i] == (text or "")
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_digests(none).count() == 0


def brute_components(docs, width, percent):
    sets = {}
    for i, text in docs:
        words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [None, "", "One", "one", "two words", "Two  words", *(" ".join(rng.choice(vocabulary, 60)) for _ in range(30))]
    base = texts[10].split()
    for k in range(120):  # near copies of one text with none to many edits: chains, stragglers and plain copies
        edited = list(base)
        for j in rng.choice(len(base), int(rng.integers(0, 6)), replace=False):
            edited[j] = str(rng.choice(vocabulary))
        texts.append(" ".join(edited[: int(rng.integers(48, 61))]))
    rows = [(int(i) * 7 + 3, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    got = near_dedup.near_duplicates(docs, width=width, percent=percent).collect()
    want = brute_components(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.keep_one(docs, width=width, percent=percent)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


def test_rows_of_one_id_are_one_node(spark):
    base = [f"w{i}" for i in range(60)]
    near, other = " ".join(base), " ".join([*base, "more"])
    rows = [(1, "aaa bbb ccc ddd eee fff"), (1, near), (2, other), (5, "x y z u v w"), (9, "x y z u v w"), (9, "k l m n o p"), (7, "k l m n o p"), (11, "alone and apart from all of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (5, 5), (9, 5), (7, 5), (11, 11)} and len(got) == len(rows)


def test_planted_pairs_at_the_threshold_are_all_found(spark):
    """400 pairs of a similarity of 0.85 to 0.9 each: none is lost."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(5000)]
    rows, want = [], {}
    for k in range(400):
        base = [str(w) for w in rng.choice(words, 120)]
        while True:
            copy = list(base)
            for j in rng.choice(len(copy), int(rng.integers(2, 4)), replace=False):
                copy[j] = str(rng.choice(words))
            a, b = (set(zip(t, t[1:], t[2:])) for t in (base, copy))
            if 0.85 <= len(a & b) / len(a | b) <= 0.9:
                break
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k}
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_estimates_miss_no_pair_at_the_threshold():
    """The estimate's error is the one that the floors allow five times, so that under one true pair in a million is left."""
    rng = np.random.default_rng(13)
    for k, (multiply, flip) in ((180, near_dedup.family(180, 1)), (1024, near_dedup.family(1024, 2))):
        found = []
        for _ in range(600):
            hashes = rng.integers(0, 1 << 63, 460, dtype=np.uint64) * np.uint64(2)
            a, b = hashes[:430], hashes[30:]  # 400 of 460
            x, y = (near_dedup.low_bytes(h, multiply, flip) for h in (a, b))
            found.append(((x == y).mean() - 1 / 256) * 256 / 255)
        true = 400 / 460
        error = np.sqrt(true * (1 - true) / k)
        assert abs(np.mean(found) - true) < error / 3 and np.std(found) < 1.15 * error and min(found) > near_dedup.floor_of(true, k)


def test_pages_of_one_template_are_not_compared_in_pairs(spark):
    """Wide buckets of pages that share a template: links as by brute force, and no finer key holds pages of several groups."""
    rng = np.random.default_rng(14)
    frame = [f"frame{i}" for i in range(140)]
    rows = []
    for k in range(300):
        own = [f"own{k}-{i}" for i in range(int(rng.integers(16, 40)))]
        rows.append((10 * k, " ".join([*own, *frame])))
        if k % 10 == 0:
            rows += [(10 * k + 1 + j, " ".join([*own[:-1], f"edit{k}-{j}", *frame])) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 5, 80)
    for wide in (32, 1 << 20):
        got = near_dedup.near_duplicates(docs, wide=wide).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 100
    texts = spark.createDataFrame([(i, want[i][1], t) for i, t in rows if want[i][0] < 170], "rep long, root long, text string")
    counts = near_dedup.shingle_counts(texts, 5)
    sets = [near_dedup.shingles(t, 5, near_dedup._WordHashes()) for _, t in rows if want[_][0] < 170]
    assert counts.sum() == sum(map(len, sets))


def test_near_duplicates_odd_rows(odd, none):
    assert near_dedup.near_duplicates(odd).count() == odd.count()
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_leave_no_shuffle_files(spark):
    """The files of a step go with it, whenever the driver collects its garbage. Steps without checkpoint leave a few bytes."""
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    held = lambda: {p: p.stat().st_size for d in dirs for p in Path(d).rglob("shuffle_*.data")}
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 3) * 50 + j}" for j in range(40 + i % 3))) for i in range(900)], "doc_id long, text string")
    before = held()
    got = near_dedup.near_duplicates(docs)
    for _ in range(40):
        left = sum(n for p, n in held().items() if p not in before)
        if left < 20_000:
            break
        time.sleep(0.25)
    assert left < 20_000
    assert got.filter("kept").count() == 300


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100} or {k: v for k, v in got.items() if k != v} == {**dict.fromkeys(range(1, 41), 0), 101: 100}


def test_mixing_meets_targets(spark, odd, none):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 80)), f"s{int(rng.integers(0, 7)) if i % 3 else 0}") for i in range(900)] + [(900, None, None), (901, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    size = Counter()
    for i, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    full, goal = set(), 1.5 * sum(size.values())
    while True:
        left, w = goal - sum(2 * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        want = {s: 2 * size[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and want[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    source, taken, copied = {i: s for i, _, s in rows}, Counter(), {r.doc_id: r.copies for r in got}
    for r in got:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * goal and r.source_size == size[source[r.doc_id]]
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 80 for s in names)
    for s in names:  # nothing that still fits is left
        left = [len(WORD.findall(t or "")) for i, t, of in rows if of == s and copied[i] < 2 and len(WORD.findall(t or "")) * 2 < want[s] * 2 and copied[i] == min(copied[j] for j, _, o in rows if o == s)]
        assert not left or min(left) == 0 or want[s] - taken[s] < max(1, min(left)) or want[s] >= 2 * size[s]
    assert sorted(got) == sorted(mixing.mix(docs).collect())
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert all(copies[r.doc_id] == r.copies for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mix(odd).count() == odd.count()


def test_an_exchange_is_the_best_one_of_all(spark):
    """One pass against a search of all pairs, no document and all documents among them; two passes come nearer still."""
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(3, 90)), f"s{i % 5}") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before, after, twice = ([r for r in mixing.mix(docs, swaps=n).collect()] for n in (0, 1, 2))
    off = lambda got, s: abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s))
    moved = 0
    for s in {r.source for r in before}:
        own = [r for r in before if r.source == s]
        gap, least = own[0].target - sum(r.taken for r in own), min(r.copies for r in own)
        if own[0].target >= 2 * own[0].source_size:
            continue
        whole = int(own[0].target // own[0].source_size)
        taken, free = [[r["size"] for r in own if r.copies == n] + [0] for n in (whole + 1, whole)]
        best = min(abs(gap + a - b) for a in taken for b in free)
        assert least >= whole and abs(off(after, s) - (best if abs(gap) >= 1 and best <= abs(gap) - 1 else abs(gap))) < 1e-6
        assert off(twice, s) <= off(after, s) and off(twice, s) <= max(1.0, 0.005 * own[0].target)
        moved += off(after, s) < abs(gap)
    assert moved and all(r.copies <= 2 for r in twice)


def test_inclusion_probabilities_expect_the_rest():
    """Certain documents and the level of the others, against a solution by bisection."""
    from pyspark.sql import SparkSession

    spark, rng = SparkSession.getActiveSession(), np.random.default_rng(8)
    rows = [(i, f"s{i % 3}", int(rng.integers(1, 2000 if i % 3 else 12))) for i in range(600)]
    rest = {f"s{k}": share * sum(r[2] for r in rows if r[1] == f"s{k}") for k, share in enumerate((0.9, 0.97, 0.4))}
    base = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = {r.source: r.c for r in mixing._levels(base, spark.createDataFrame(list(rest.items()), "source string, rest double"), 0.25).collect()}
    for s, want in rest.items():
        sizes = np.array([r[2] for r in rows if r[1] == s], float)
        words = lambda c: (np.minimum(1, c * sizes**-0.25) * sizes).sum()  # noqa: E731, B023
        assert abs(words(got[s]) - want) < 1e-6 * want
    assert (np.array([r[2] for r in rows if r[1] == "s1"]) ** -0.25 * got["s1"] > 1).any()


def test_an_id_in_two_sources_keeps_each_one_s_copies(spark):
    rows = [(1, "one two three four", "a"), (2, "five six", "a"), (1, "one two three four", "b"), (3, " ".join("abcdefghij" * 2), "c"), (4, "x y", None), (None, "no id", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(7), "copies": F.lit("x"), "taken": F.lit(0)})
    copies = {(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect()}
    assert Counter((r.doc_id, r.source) for r in mixing.mixed(docs).collect()) == Counter({k: n for k, n in copies.items() if n})
    assert mixing.mixed(docs).columns == docs.columns


def test_licenses_exact_and_fuzzy(spark, odd, none):
    texts = ["GNU General Public License; cc by and CC-BY", "released under teh MIT Licence", "All right reserved.", "nothing here", "mit license mit license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = {x.doc_id: x for x in licenses.scan_licenses(docs).collect()}
    assert (r[0].n_base, r[0].first_word, r[0].last_word, r[0].base_labels) == (3, 0, 7, "cc-by,gpl")
    assert r[1].n_base == 0 and r[1].labels == "mit" and 0.8 < r[1].score < 1 and r[1].spans[0].first_word == 0
    assert r[2].labels == "all-rights-reserved" and r[3].score == 0 and r[3].first_word is None
    assert (r[4].n_base, r[4].first_word, r[4].last_word) == (2, 0, 2)
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(none).count() == 0


@pytest.mark.parametrize("text,label", [
    ("Apache Licence, Version 2.0", "apache"), ("License: Apache Licnse", "apache"), ("Apache Licence Versoin 2.0", "apache"), ("The MIT Licence", "mit"), ("MIT Lisense", "mit"), ("License: MIT Licence (see file)", "mit"), ("GNU General Public Licence", "gpl"),
])
def test_base_phrases_with_an_edit_and_no_lead_in(text, label):
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.CHARS_PER_EDIT)
    _, n_base, _, _, base, labels, score, _ = scanner.scan(text)
    assert (n_base, base, labels) == (0, "", label) and 0.85 < score < 1


def test_license_seeds_lose_no_match():
    """Any text within the edit bound holds an unchanged piece, so the scan finds it."""
    scanner, rng = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.CHARS_PER_EDIT), np.random.default_rng(1)
    for notice, label in licenses.NOTICES.items():
        k = len(notice) // licenses.CHARS_PER_EDIT
        for _ in range(20):
            text = list(notice)
            for at in rng.choice(np.arange(1, len(notice) - 1), k, replace=False):
                if text[at] != " ":
                    text[at] = "q"
            assert label in scanner.scan("xx yy " + "".join(text) + " zz")[5].split(",")


def test_license_scan_equals_a_search_of_the_whole_text():
    """Random insertions, deletions and substitutions: the same pattern over the whole text finds nothing that the scan misses."""
    import regex

    scanner, rng = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.CHARS_PER_EDIT), np.random.default_rng(2)
    letters = "abcdefghijklmnop q"
    whole = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n, special_only=True, literal_spaces=True)}){{e<={k}}}(?![^ ])") for n, _, k in scanner.notices]
    matches = 0
    for trial in range(150):
        notice, _, k = scanner.notices[trial % len(scanner.notices)]
        text = list(notice)
        for _ in range(int(rng.integers(0, k + 2))):
            at, kind, c = int(rng.integers(0, len(text))), int(rng.integers(3)), letters[int(rng.integers(len(letters)))]
            text[at : at + (kind > 0)] = [c] if kind < 2 else []
        around = [" ".join("".join(letters[int(x)] for x in rng.integers(0, 16, 4)) for _ in range(int(rng.integers(0, 3)))) for _ in range(2)]
        joined = " " + " ".join(f"{around[0]}{' ' * (rng.random() < 0.8)}{''.join(text)} {around[1]}".split()) + " "
        found = scanner.fuzzy(joined)
        for (n, label, _), pattern in zip(scanner.notices, whole):
            m = pattern.search(joined)
            if m and m[0].strip():
                matches += 1
                assert min(f[5] * len(n) for f in found if f[0] == label) <= sum(m.fuzzy_counts) + 1e-9, (n, joined)
        for label, first, last, _, matched, _ in found:
            assert " ".join(joined.split()[first : last + 1]) == matched
    assert matches > 80


def test_license_scan_is_linear():
    from time import time

    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.CHARS_PER_EDIT)
    for unit in ("mit license ", "mit licence ", "gnu general public license apache license cc by "):
        began = time()
        n_words, n_base, _, _, _, labels, _, spans = scanner.scan(unit * (500_000 // len(unit)))
        assert time() - began < 10 and labels and len(spans) >= n_words // 8
    # places of all exact phrases in a text that holds nothing else
    assert scanner.scan("cc by " * 50_000)[:4] == (100_000, 50_000, 0, 99_998)


def test_fingerprints_are_homomorphic(spark, odd, none):
    a, b, c = "first paragraph here", "second one of words", "a third line of more words"
    f = lambda t: fingerprint.to_hex(fingerprint.vector(t))
    assert f(f"{a}\n{b}\n{c}") == f(f"{c}\n\n{a}\n{b}") != f(f"{a}\n{b}")
    assert fingerprint.change(f(f"{a}\n{b}"), inserted=c, deleted=a) == f(f"{c}\n{b}")
    assert f(f"{a}\n{a}") != f(a) and f(None) == f(" \n ")
    rows = [(i * 3, t) for i, t in enumerate(t or "" for t in ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block_chars in (5, 1 << 21):
        nexts = {r.doc_id: r.next_text for r in fingerprint.with_next(docs, block_chars=block_chars).collect()}
        assert nexts == {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}
    got = {r.doc_id: r for r in fingerprint.compare_with_edits(docs).collect()}
    for k, (i, t) in enumerate(rows):
        half, following = len(t) // 2, rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].fingerprint == f(t) and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert fingerprint.compare_with_edits(odd).count() == odd.count() and fingerprint.compare_with_edits(none).count() == 0


def test_next_documents_of_any_ids(spark):
    """Ids at both ends of the range, clustered, repeated and null: blocks stay small, and the order is one circle."""
    rng = np.random.default_rng(9)
    ids = [-(1 << 63), (1 << 63) - 1, 0, -5, *range(1000, 1400), *range(1 << 62, (1 << 62) + 400), *[7] * 200, *[None] * 200]
    docs = spark.createDataFrame([(i, f"text {k} " + "x" * int(rng.integers(0, 60))) for k, i in enumerate(ids)], "doc_id long, text string")
    rows = fingerprint.with_next(docs, block_chars=2000).collect()
    after = {r.text: r for r in rows}
    assert len(after) == len(rows) == len(ids)
    at, seen = rows[0].text, []
    for _ in rows:
        seen.append(after[at].doc_id)
        at = after[at].next_text
    assert at == rows[0].text
    start = next(k for k in range(len(seen)) if seen[k] is None and seen[k - 1] is not None)
    turned = seen[start:] + seen[:start]
    assert turned == [None] * 200 + sorted(i for i in ids if i is not None)
    for one in ([], [(3, "only")], [(3, "only"), (3, "only")]):
        few = spark.createDataFrame(one, "doc_id long, text string")
        assert [(r.text, r.next_text) for r in fingerprint.with_next(few, block_chars=1).collect()] == [("only", "only")] * len(one)


def test_likeness_counts_runs_of_very_long_texts():
    short, long = "ab " * 100_000, "ab " * 3_400_000  # ten million characters
    x, y = fingerprint.vector(short), fingerprint.vector(long)
    n, m = 100_000 - 2, 3_400_000 - 2
    assert abs(fingerprint.likeness(x, y) - 2 * n * m / (n * n + m * m)) < 1e-9
    assert abs(fingerprint.likeness(fingerprint.vector("ab " * 40_000), fingerprint.vector("ab " * 30_000)) - 0.96) < 1e-3
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(4000)]
    for share in (0.0, 0.3, 0.6, 0.9):  # the estimate against the runs counted one by one
        a = [str(w) for w in rng.choice(words, 3000)]
        b = a[: int(3000 * share)] + [str(w) for w in rng.choice(words, 3000 - int(3000 * share))]
        runs = [Counter(zip(t, t[1:], t[2:])) for t in (a, b)]
        want = 2 * sum(n * runs[1][r] for r, n in runs[0].items()) / sum(n * n for c in runs for n in c.values())
        assert abs(fingerprint.likeness(fingerprint.vector(" ".join(a)), fingerprint.vector(" ".join(b))) - want) < 0.2


def test_length_suffix_sums(spark, odd, none):
    rng = np.random.default_rng(3)
    lengths = [*map(int, rng.integers(0, 5000, 300)), 0, 0, 7, 7, 1023, 1024, 1025]
    hist = spark.createDataFrame(list(Counter(lengths).items()), "length long, docs long")
    sums = token_lengths.suffix_sums(hist)
    for r in sums.collect():
        assert r.docs_from == sum(x >= r.length for x in lengths) and r.tokens_from == sum(x for x in lengths if x >= r.length)
        assert r.truncated_total == sum(min(x, r.length) for x in lengths) and r.tokens_all == sum(lengths)
    limits = [0, 1, 7, 1000, 1023, 1024, 3333, 4999, 9000]
    got = token_lengths.truncated_totals(sums, spark.createDataFrame([(x,) for x in limits], "limit long")).collect()
    assert {r.limit: (r.truncated_total, r.docs_cut) for r in got} == {x: (sum(min(y, x) for y in lengths), sum(y > x for y in lengths)) for x in limits}
    q = {r.share: r.length for r in token_lengths.length_quantiles(sums, [0.5, 1.0]).collect()}
    assert q[1.0] == max(lengths) and q[0.5] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    hist = {r.length: r.docs for r in token_lengths.length_histogram(odd).collect()}
    assert sum(hist.values()) == odd.count() and token_lengths.suffix_sums(token_lengths.length_histogram(none)).count() == 0


def test_toxicity_learns_words(spark, odd, none):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, int(rng.integers(10, 60))))
        if toxic := i % 4 == 0:
            text[int(rng.integers(0, len(text)))] = str(rng.choice(["badone", "badtwo"]))
        rows.append((i, " ".join(text), "en" if i % 3 else "de"))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, marks, allowed=~held_out(F.col("doc_id")))
    got = toxicity.toxicity(docs, model, keep=[F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")]).collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in got if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.threshold == model.thresholds.get(r.lang_guess, 0.3) and r.predicted_by_lang == int(r.score >= r.threshold) for r in got)
    assert toxicity.toxicity(odd, model).count() == odd.count() and toxicity.toxicity(none, model).count() == 0
    assert toxicity.fit_toxicity(docs, marks.filter("false")).thresholds == {}
    copies = docs.filter("doc_id = 1").crossJoin(spark.range(3000)).select("doc_id", "text", "lang")
    assert toxicity.fit_toxicity(docs.union(copies), marks, per_class=100).row.any()
    tie = {(r.score, r.predicted) for r in toxicity.toxicity(spark.createDataFrame([(i, "badone word3 " * 3) for i in range(3)], "doc_id long, text string"), model).collect()}
    assert len(tie) == 1


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """3,000 others, each word in nine of them, and toxic texts of over 30,000 characters: all teach, in several shards."""
    monkeypatch.setattr(toxicity, "SHARD", 1000)
    rows = [(i, f"seldom{i // 9} filler{i % 7} common{i % 5}", "en") for i in range(2997)]
    rows += [(5000 + i, "badone " + f"long{i % 3} text{i % 4} " * 3000, "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i >= 5000)) for i, _, _ in rows], "doc_id long, toxic int")
    stored = toxicity.labelled(docs, labels)
    assert stored.count() == len(rows) and stored.rdd.getNumPartitions() == 4
    model = toxicity.fit_toxicity(docs, labels)
    known = spark.createDataFrame([(f"seldom{i}",) for i in range(333)] + [("badone",), ("long1",)], "t string").select(toxicity.words(F.col("t")).alias("w")).collect()
    assert all(model.row[toxicity.split(r.w)[:, 0]].all() for r in known)
    assert model.langs == ["de", "en"]
    got = toxicity.toxicity(docs, model).collect()
    assert all(r.predicted == int(r.doc_id >= 5000) for r in got)


def small_net(seed):
    rng = np.random.default_rng(seed)
    row = np.arange(2 * toxicity.SPACE, dtype=np.int32) % 30
    filters = [rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS]
    embed = rng.normal(0, 0.5, (30, toxicity.DIM))
    embed[0] = 0
    bias = [rng.normal(0, 0.2, toxicity.FILTERS) for _ in filters]
    return toxicity.ToxicModel(row, embed, filters, bias, rng.normal(0, 0.5, toxicity.FILTERS * len(filters)), 0.1)


def test_toxicity_forward_pass_equals_brute_force(monkeypatch):
    model, rng = small_net(1), np.random.default_rng(2)
    for n in (0, 1, 2, 3, 50, 200):
        text = rng.integers(0, 1 << 40, n)
        parts = toxicity.split(text)
        vectors = np.zeros((n + 4, toxicity.DIM))
        for k in range(n):
            vectors[k + 2] = model.embed[model.row[parts[k, 0]]] + model.embed[model.row[parts[k, 1]]]
        pooled = []
        for w, f, b in zip(toxicity.WIDTHS, model.filters, model.bias):
            places = [sum(vectors[k + i] @ f[i] for i in range(w)) + b for k in range(len(vectors) - w + 1)]
            pooled += list(np.maximum(np.max(places, 0), 0))
        want = np.dot(pooled, model.out) + model.out_bias
        for block in (7, 1 << 14):
            monkeypatch.setattr(toxicity, "BLOCK", block)
            assert abs(toxicity.logits(model, model.table(), text) - want) < 1e-4


def test_toxicity_gradients_equal_differences(monkeypatch):
    model, rng = small_net(3), np.random.default_rng(4)
    monkeypatch.setattr(toxicity.ToxicModel, "table", lambda m: np.concatenate([m.embed @ f[i] for f in m.filters for i in range(f.shape[0])], 1))
    data = [toxicity._pad(model.row[toxicity.split(rng.integers(0, 1 << 40, n))]) for n in (4, 9, 15)]
    toxic = np.array([1.0, 0.0, 1.0])
    _, grads, slope = toxicity.loss_and_gradients(model, data, toxic)
    params = [model.embed, *model.filters, *model.bias, model.out]
    for p, g in zip(params, grads):
        for _ in range(12):
            at = tuple(int(rng.integers(0, n)) for n in p.shape)
            if p is model.embed and at[0] == 0:
                continue
            old, step = p[at], 1e-3
            p[at] = old + step
            up = toxicity.loss_and_gradients(model, data, toxic)[0]
            p[at] = old - step
            down = toxicity.loss_and_gradients(model, data, toxic)[0]
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3 + 0.02 * abs(g[at])
    model.out_bias += 1e-3
    up = toxicity.loss_and_gradients(model, data, toxic)[0]
    model.out_bias -= 2e-3
    assert abs((up - toxicity.loss_and_gradients(model, data, toxic)[0]) / 2e-3 - slope) < 1e-3


def test_thresholds_by_language_come_from_unseen_rows():
    model = small_net(5)
    z = np.array([3.0, 2.0, 1.0, -1.0, 5.0, 4.0, 3.5, 3.4] * 15)
    toxic = np.array([1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0] * 15)
    langs = (["aa"] * 4 + ["bb"] * 4) * 15
    fitted = toxicity.calibrate(model, z, toxic, langs)
    score = 1 / (1 + np.exp(-(z + fitted.shift)))
    for lang in ("aa", "bb"):
        own = np.array([x == lang for x in langs])
        assert ((score[own] >= fitted.thresholds[lang]) == toxic[own]).all()
    assert toxicity.calibrate(small_net(5), z, toxic, [None] * len(z)).thresholds == {}


def test_extraction(spark):
    model = extraction.default_model()
    right = [extraction.main_text(model, page) == "\n".join(" ".join(m.split()) for m in main) for page, main in extraction.sample_pages(100, seed=77)]
    assert np.mean(right) > 0.85  # pages without one wrong block
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><article><h1>Big &amp; small</h1><p>One  two,\n three <b>four</b>.<br>Five six seven eight nine.<p>And a second paragraph, with words.</article><footer>&copy; site</footer></body></html>'
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p"), (5, "u", "plain text only"), (6, "u", "<nav><a>x</a></nav>")]
    got = {r.page_id: r for r in extraction.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Big & small\nOne two, three four. Five six seven eight nine.\nAnd a second paragraph, with words."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == "" and got[6].text == ""


def test_long_notices_are_no_main_text():
    """Blocks of over 600 characters that only their phrases tell from an article, and as long paragraphs that stay."""
    plain = "The river rises in the northern hills, runs past three old mills and meets the sea near the harbour of the town. "
    notices = [
        "We use cookies to keep this site running. " + "These small files remember what you chose, and they help us see which pages are read most often by visitors. " * 7,
        "This work and all of its parts belong to the owner named above, who grants no licence by showing it here in public. " * 6 + "All rights reserved.",
        "Our offers change each week, and those who hold an account hear of them first by letter or by telephone call. " * 6 + "Subscribe today.",
    ]
    for notice in notices:
        paragraphs = [(plain * n).strip() for n in (6, 3, 9)]
        assert len(notice.strip()) > 600 and len(paragraphs[0]) > 600
        page = "<body><div><h1>On rivers</h1>" + "".join(f"<p>{x}</p>" for x in paragraphs) + f"</div><div><p>{notice}</p></div></body>"
        says = [x for x in extraction._PHRASES if extraction.FEATURES[f"says={x}"] in extraction.features(extraction.leaf_blocks(page))[-1]]
        assert says and extraction.main_text(extraction.default_model(), page) == "\n".join(["On rivers", *paragraphs])
    sizes = [len(b.text) for page, _ in extraction.sample_pages(200, seed=11) for b in extraction.leaf_blocks(page)]
    assert sum(x > 600 for x in sizes) > 50
    kept = [len(x) for _, main in extraction.sample_pages(200, seed=11) for x in main]
    assert sum(x > 600 for x in kept) > 50


def test_pages_labelled_by_hand():
    """Layouts that the generator of the training pages doesn't make: blocks of all pages, by F1."""
    from hand_pages import HAND_PAGES

    model, both, got, want = extraction.default_model(), 0, 0, 0
    for page, main in HAND_PAGES:
        lines = Counter(x for x in extraction.main_text(model, page).split("\n") if x)
        both += (lines & Counter(main)).total()
        got += lines.total()
        want += len(main)
    assert 2 * both / (got + want) >= 0.95


P = ["The council met on Tuesday to talk about the new bridge.", "Its members were of two minds. Some asked for a tunnel.", "A second reading follows in May, the chair said.", "Until then the ferry runs as before."]
FULL = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><article{}><h1>A new bridge</h1>' + "".join(f"<p>{x}</p>" for x in P) + "</article><footer><p>&copy; 2024 The Post. All rights reserved.</p></footer>"
STATES = ["", "comments-open", "no-comments", "has-sidebar", "cookie-bar", "social", "menu-open", "has-sidebar single-post", "with-comments", "ad-free", "newsletter-closed"]


@pytest.mark.parametrize("of", STATES)
def test_classes_of_the_whole_page_or_of_states_lose_no_article(of):
    model = extraction.default_model()
    assert extraction.main_text(model, f'<body class="{of}">{FULL.format("")}</body>') == "\n".join(["A new bridge", *P])
    assert extraction.main_text(model, f'<body class="{of}">' + "".join(f"<p>{x}</p>" for x in P[:3]) + "</body>") == "\n".join(P[:3])
    if of in ("", "no-comments", "has-sidebar", "comments-open"):
        assert extraction.main_text(model, f"<body>{FULL.format(f' class={chr(34)}post {of}{chr(34)}')}</body>") == "\n".join(["A new bridge", *P])


@pytest.mark.parametrize("page", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<html><body>{}</body></html>", '<article class="post no-comments">{}</article>'])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_short_pages_keep_their_paragraphs(page, n):
    assert extraction.main_text(extraction.default_model(), page.format("".join(f"<p>{x}</p>" for x in P[:n]))) == "\n".join(P[:n])


def test_formulas_stay_and_open_tags_lose_nothing():
    texts = lambda page: [b.text for b in extraction.leaf_blocks(page)]
    assert texts("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>E=mc^2</annotation></math> in all.</p>") == ["Energy is E=mc2 in all."]
    for tag in ("canvas", "object", "svg", "template", "noscript", "select"):
        assert texts(f"<p>one</p><{tag}><p>two</p><p>three</p>") == ["one", "two", "three"]
        assert texts(f"<p>one</p><{tag}><p>two</p></{tag}><p>three</p>") == ["one", "three"]
    assert texts("<p>one</p><script>if (a) { <p>two</p>") == ["one"]
    assert not extraction.leaf_blocks('<p data-class="menu" title="a class=ad id=nav">x</p>')[0].hints
    assert extraction.leaf_blocks("<div id=nav class='x ad'><p>x</p></div>")[0].hints == {"menu", "ad"}


def test_blocks_take_time_by_size_not_depth():
    from time import time

    for unit in ("<div>text ", "<option>x ", "<li><div>x ", '<a "', "<a <", "</span>x ", "<p><b>x ", "<dt><div><dd>x "):
        began = time()
        extraction.leaf_blocks(unit * 20_000)
        assert time() - began < 8, unit
    deep = extraction.leaf_blocks("<nav>" + "<div class='menu'>" * 3000 + "in<b>side</b>" + "</div>" * 3000 + "</nav>after")
    assert [(b.text, b.tags, b.leaf) for b in deep] == [("inside", frozenset({"nav", "div"}), "div"), ("after", frozenset(), "")]


def test_extraction_of_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    page = "<article><h1>Title of it</h1><p>One sentence, and another one.</p></article>"
    rows = [(1, "u", page, "x", 1), (1, "u", page, "x", 1), (None, None, page, None, None), (2, "u", "<article><h1>Title of it</h1><p>" + "long sentence, with a comma. " * 20_000 + "</p></article>", "", 0), (3, "u", "\x00<<>>&#0;&bogus;", "", 0)]
    got = extraction.extract_main(spark.createDataFrame(rows, schema)).collect()
    assert got[0] == got[1] and got[0].text == got[2].text == "Title of it\nOne sentence, and another one." and len(got) == 5
    assert got[3].n_chars == len(("Title of it\n" + "long sentence, with a comma. " * 20_000).strip()) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert extraction.extract_main(spark.createDataFrame([], schema)).count() == 0


def test_crf_gradients_equal_differences():
    rng = np.random.default_rng(3)
    w, t = rng.normal(size=len(extraction.FEATURES)), rng.normal(size=(2, 2))
    feats = [sorted(set(map(int, rng.integers(0, len(w), 5)))) for _ in range(7)]
    labels = [0, 1, 1, 0, 1, 0, 0]
    loss, dw, dt = extraction.loss_and_gradients(w, t, feats, labels)
    from itertools import product

    score = lambda y: sum(w[f].sum() * k for f, k in zip(feats, y)) + sum(t[a, b] for a, b in zip(y, y[1:]))
    assert abs(loss - score(labels) + np.log(sum(np.exp(score(y)) for y in product((0, 1), repeat=7)))) < 1e-9
    for p, g in ((w, dw), (t, dt)):
        for at in [(int(i),) for i in feats[0] + feats[3]] if p is w else [(0, 0), (0, 1), (1, 0), (1, 1)]:
            old = p[at]
            p[at] = old + 1e-5
            up = extraction.loss_and_gradients(w, t, feats, labels)[0]
            p[at] = old - 1e-5
            down = extraction.loss_and_gradients(w, t, feats, labels)[0]
            p[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_viterbi_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(8)
    model = extraction.Crf(rng.normal(size=len(extraction.FEATURES)), rng.normal(size=(2, 2)))
    for _ in range(20):
        feats = [list(map(int, rng.integers(0, len(extraction.FEATURES), 3))) for _ in range(6)]
        score = lambda y: sum(model.weights[f].sum() * k for f, k in zip(feats, y)) + sum(model.moves[a, b] for a, b in zip(y, y[1:]))
        assert tuple(extraction.viterbi(model, feats)) == max(product((0, 1), repeat=6), key=score)


def brute_mix(rows, targets_of):
    """Words of each source that a mix may give: nothing that fits is left, nothing but the last passes the target."""
    size, docs = Counter(), {}
    for i, text, source in rows:
        n = len(WORD.findall(text or ""))
        size[source] += n
        docs.setdefault(source, []).append(n)
    return size, docs, targets_of(size)


def weighted_targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, full, goal = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, set(), 1.5 * sum(size.values())
    while True:
        left, w = goal - sum(2 * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        want = {s: 2 * size[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and want[s] > 2 * size[s]}
        if not over:
            return want
        full |= over


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept, against a version in plain Python over all rows."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = {"": {r.doc_id: r for r in docs.collect()}}
    columns, at, rows = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, "/root/testdata/sf0.001")
        assert name == "bpe" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = at.collect()
    encoder, pieces = (load(p) for load, p in zip((quality._byte_encoder, quality._piece_encoder), quality.default_paths()))
    every = held[""]

    def passes(text):
        words = WORD.findall(text or "")
        times = Counter(zip(*(words[i:] for i in range(5))))
        covered = {j + k for j, w in enumerate(zip(*(words[i:] for i in range(5)))) if times[w] > 1 for k in range(5)}
        if len(words) < 10 or 100 * len(covered) > 20 * len(words):
            return False
        script, *measured = quality.fertility(text, encoder, pieces)
        return not quality.broken_bands(quality.BANDS[script], *measured)

    assert {r.doc_id for r in rows["quality_rules"]} == {i for i, r in every.items() if passes(r.text)}
    kept = [r for r in rows["quality_rules"]]
    teach = [(r.text[:20_000], r.lang) for r in kept if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    model = langid.train(*map(list, zip(*sorted(set(teach), key=lambda x: (x[1], x[0])))))

    def readable(text):
        letters = sum(map(str.isalpha, text))
        losses = np.sort(langid.decode(model, langid.margins(model, text))[0])
        return letters > 0 and losses[0] <= np.log(2) * (1 + letters**-0.5) and losses[1] - losses[0] >= 0.02 * letters / (letters + 200)

    assert {r.doc_id for r in rows["language_id"]} == {r.doc_id for r in kept if readable(r.text)}
    distinct = {c for _, c in brute_components([(r.doc_id, r.text) for r in rows["language_id"]], 5, 80).values()}
    assert Counter(r.doc_id for r in rows["near_dedup"]) == Counter(distinct)
    size, _, want = brute_mix([(r.doc_id, r.text, r.source) for r in rows["near_dedup"]], weighted_targets)
    times, taken = Counter(r.doc_id for r in rows["mixing"]), Counter()
    for r in rows["near_dedup"]:
        taken[r.source] += times[r.doc_id] * len(WORD.findall(r.text))
        assert int(want[r.source] / size[r.source] + 1e-9) <= times[r.doc_id] <= 2
    longest = {s: max(len(WORD.findall(r.text)) for r in rows["near_dedup"] if r.source == s) for s in size}
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in size)
    library = Tokenizer.from_file(bpe.default_path())
    ids = {i: library.encode(every[i].text, add_special_tokens=False).ids for i in times}
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows["bpe"]) == Counter({
        (i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()): times[i] for i, x in ids.items()
    })
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == len(rows["bpe"])


def test_clashing_names_and_very_long_texts(spark):
    """Columns named as the results, and a text of a million words, through every operator."""
    long = " ".join(f"word{i % 977} of{i % 1013}" for i in range(500_000))
    names = ("score", "size", "taken", "fingerprint", "n_tokens", "kept", "labels", "component_id", "lang_pred", "copies", "next_text", "block", "place", "ids", "n_words")
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, "a short text of some ten words that ends right here now", None, None), (3, None, "en", "a")], "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.lit("x") for c in names})
    counts = {
        "quality": quality.quality_rules(docs), "fingerprint": fingerprint.compare_with_edits(docs), "mixing": mixing.mix(docs), "licenses": licenses.scan_licenses(docs), "bpe": bpe.encode_digests(docs),
        "near": near_dedup.near_duplicates(docs), "language": langid.identify_languages(docs, langid.train(["the of and", "der die das"], ["en", "de"])), "toxicity": toxicity.toxicity(docs, small_net(1)),
    }
    got = {k: {r.doc_id: r for r in df.collect()} for k, df in counts.items()}
    assert all(r.keys() == {1, 2, 3} for r in got.values())
    assert got["quality"][1].n_words == got["mixing"][1]["size"] == got["licenses"][1].n_words == 1_000_000
    assert got["fingerprint"][1].n_chars == len(long) and got["near"][1].n_shingles == len({tuple(w) for w in zip(*(long.split()[i:] for i in range(5)))})
    for keep in (quality.keep_passing, near_dedup.keep_one, mixing.mixed):
        assert keep(docs).columns == docs.columns


def test_encoded_lengths_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    library.encode_special_tokens = True
    got = {r.doc_id: r.n for r in odd.select("doc_id", token_lengths.token_count()("text").alias("n")).collect()}
    assert all(got[i] == len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD))
