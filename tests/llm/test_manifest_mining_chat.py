"""Manifest, hard negatives and chat formatting against brute force, on nulls, repeats, ties and empty tables."""

import hashlib
import math
import random
import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import chat, hard_negatives, merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def _leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {n: _tree([x[2] for x in sorted(groups[n], key=lambda x: x[:3])]) for n in names}
    top = _tree([trees[n][-1][0] for n in names])
    out = []
    for g, name in enumerate(names):
        for i, (*_, leaf, r) in enumerate(sorted(groups[name], key=lambda x: x[:3])):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            now, siblings = _leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf, []
            for levels, at in ((trees[name], i), (top, g)):
                for level in levels[:-1]:
                    pair = level[at & ~1 : (at | 1) + 1]
                    siblings += [d for k, d in enumerate(pair) if k != at & 1]
                    pair[at & 1] = now
                    now, at = H(*pair), at >> 1
            out.append((r[0], leaf, trees[name][-1][0], top[-1][0], H(*siblings), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits,n,langs", [(2, 150, ["en", None, "é", "zz", "a"]), (10, 40, ["en"]), (3, 1, [None]), (3, 0, [])])
def test_manifest_equals_brute_force(spark, bits, n, langs):
    draw = random.Random(n)
    rows = [(None if i % 17 == 0 else i % 60 - 5, draw.choice([None, "s", "ü"]), draw.choice(langs), draw.choice([None, i]), draw.choice([None, "", "täxt " * (i % 5), "b" * 9000])) for i in range(n)]
    rows += rows[:20]  # repeated rows are leaves of their own
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place int, `Group` string")
    made = merkle.document_manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, bits)
    got = made.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == _manifest(rows)


def test_sweeps_equal_the_tree_and_proofs_fold():
    for count in range(1, 40):
        leaves = [H(str(i)) for i in range(count)]
        levels = merkle.levels_of(count)
        root, made = merkle.forward(leaves, levels)
        assert root == _tree(leaves)[-1][0] and [label for label, _ in made] == sorted(label for label, _ in made)
        for i, proof in enumerate(merkle.backward(made, levels, count, "")):
            assert merkle.fold(leaves[i], proof, i, count, 0, 1) == root
            assert merkle.fold(H("other"), proof, i, count, 0, 1) != root


def _mined(rows):
    kept = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(256 * float(np.float32(x))) for x in v]
            kept.append((i, v, (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for n, (i, v, label) in enumerate(kept):
        if i % 100 == 0:
            s = [(-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, m, k) for m, (j, w, k) in enumerate(kept)]
            for p in sorted(x for x in s if x[3] == label and x[2] != n)[:5]:
                inside = sorted(x for x in s if x[3] != label and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0])
                out += [(i, p[1], rank, x[1], -p[0], -x[0]) for rank, x in enumerate(inside[:10], 1)]
    return sorted(out)


def _cloud():
    draw = np.random.default_rng(1)
    centre = draw.normal(size=(10, 6))
    rows = [(i, np.round(centre[i % 10] + 0.3 * draw.normal(size=6), 1).tolist(), i % 10) for i in range(900)]
    odd = [(300, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 3)] * 3 + [(None, [1.0] * 6, 2), (5, None, 1), (7, [1.0] * 6, None), (9, [float("nan")] * 6, 1), (10, [float("inf")] * 6, 1), (11, [None] * 6, 1), (100, [], 4), (200, [2.0, 3.0], 5)]
    return rows + odd + rows[:50]


@pytest.mark.parametrize("rows,size", [(_cloud(), {"tree_rows": 128, "page": 16}), (_cloud(), {}), ([], {}), ([(100, [1.0, 2.0], 1)], {}), ([(100, [1e9, 2e9], 1), (101, [1e9, 2e9], 1), (102, [3e8, 9e8], 2)], {}), ([(i, [1.0, 0.5], i % 3) for i in range(400)], {"tree_rows": 64, "page": 8})])
def test_hard_negatives_equal_brute_force(spark, rows, size):
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, row string")
    got = hard_negatives.mine(hard_negatives.with_noise(hard_negatives.prepared(table)), F.col("vec_id") % 100 == 0, **size)
    assert sorted(map(tuple, got.collect())) == _mined(rows)


def test_boxes_bound_scores_and_prune_where_there_is_structure():
    draw = np.random.default_rng(3)
    points = np.concatenate([draw.integers(-9, 9, (200, 3)) + c for c in draw.integers(-900, 900, (20, 3))])
    pages = hard_negatives.tile(points, [0, 1, 2], 32)
    assert sorted(np.concatenate(pages)) == list(range(len(points))) and max(map(len, pages)) <= 32
    at = np.concatenate(pages)
    b = lambda x: x.astype(np.int64).tobytes()
    tree = hard_negatives.RTree({"ids": b(at), "labels": b(at * 0), "rows": b(at), "vectors": b(points[at]), "dims": 3, "pages": b(np.array([len(p) for p in pages]))})
    anchors = points[::50].astype(float)
    low, high = tree.bounds(anchors)[0]
    scores = anchors @ tree.points.T
    for box, (s, e) in enumerate(zip(tree.starts, tree.ends)):
        assert (low[:, box] <= scores[:, s:e].min(axis=1)).all() and (scores[:, s:e].max(axis=1) <= high[:, box]).all()
    asked, bounds = [], tree.bounds(anchors)
    for i in range(len(anchors)):
        page = lambda box, i=i: asked.append(box) or scores[i, tree.starts[box] : tree.ends[box]]
        found = hard_negatives.search(tree, i, page, bounds, np.ones(len(at), bool), np.array([-np.inf]), np.array([np.inf]), 5)[0]
        assert [x[:2] for x in found] == sorted(zip(scores[i], tree.ids), key=lambda x: (-x[0], x[1]))[:5]
    assert len(asked) < 0.2 * len(pages) * len(anchors)


TURNS = [("system", "be kind"), ("user", "hi </turn> ### x"), ("assistant", "\\### Assistant: </turn> ok"), ("user", ""), ("assistant", "</turn>\n####\\")]


def _templates():
    """Functions of a function, so that they travel to the workers by value."""

    def floating(turns):
        """An end mark that moves on as turns come."""
        return "".join(f"<{r}>{x}</{r}>" for r, x in turns) + "<end>"

    def forgetful(turns):
        """Drops a word of all assistant turns but the last."""
        last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "".join(f"[{r}]{x if i == last or r != 'assistant' else x.replace('THINK', '')}[/]" for i, (r, x) in enumerate(turns))

    def twice(turns):
        return "".join(f"[{r}]{x}{x if r == 'assistant' else ''}[/]" for r, x in turns)

    return floating, forgetful, twice


floating, forgetful, twice = _templates()


def test_rendering_of_a_black_box():
    assert chat.read_turns(chat.marked_turns(TURNS)) == TURNS
    r = chat.Rendered(chat.marked_turns, TURNS)
    assert r.rewrites is None and r.closing == "" and [chat.unescape(r.text[a:b]) for a, b in r.inner] == [x for _, x in TURNS]
    assert "".join(r.text[a:b] for a, b in r.spans) == r.text
    r = chat.Rendered(floating, TURNS[:3])
    assert r.rewrites is None and "<end>".endswith(r.closing) and "".join(r.text[a:b] for a, b in r.spans) + r.closing == r.text
    assert [r.text[a:b] for a, b in r.inner] == [x for _, x in TURNS[:3]]
    r = chat.Rendered(forgetful, [("user", "q"), ("assistant", "THINKa"), ("user", "q"), ("assistant", "THINKb")])
    assert r.rewrites == 3 and [r.text[a:b] for a, b in r.inner] == ["q", "a", "q", "THINKb"]
    assert chat.Rendered(twice, [("user", "Q"), ("assistant", "a")]).inner == [(6, 7), None]


def test_escaping_is_reversible():
    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choices(["#", "##", "###", "</turn>", "\\", "\n", "a", "<", "/turn>", "### User: "], k=draw.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text
        assert chat.read_turns(chat.marked_turns([("r: o\n", text), ("Assistant", text)])) == [("r: o\n", text), ("Assistant", text)]


SCHEMA = "conv_id long, turn long, role string, text string, piece string, _part int"


def _conversations():
    draw = random.Random(2)
    bits = ["###", "</turn>", "\\", "\n", "a", "é", "👩‍👩", "### User: ", " ", "", ""]
    rows = [(draw.choice([None, 1, 2, 3, 2**60, 2**60 + 1] + [9] * 8), draw.choice([None, *range(40)]), draw.choice([None, "user", "assistant", "system", "tool: x", "Assistant", ""]), draw.choice([None, "".join(draw.choices(bits, k=draw.randint(0, 9)))]), "p", 1) for _ in range(700)]
    return rows + rows[:30]


def _sorted_turns(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    return {conv: [(t[3], t[5]) for t in sorted(turns)] for conv, turns in out.items()}


@pytest.mark.parametrize("block,window", [(16, 4), (1024, 32)])
def test_formatted_conversations_equal_brute_force(spark, block, window):
    rows = _conversations()
    made = chat.read_back(chat.format_turns(spark.createDataFrame(rows, SCHEMA).repartition(5), block=block, window=window)).collect()
    want = []
    for conv, turns in _sorted_turns(rows).items():
        loss = "".join(x for r, x in turns if r == "assistant")
        want.append((conv, len(turns), H(*[f"{r}\n{x}\n" for r, x in turns]), len(loss), H(loss), len(chat.marked_turns(turns)), False, 0))
    assert sorted(map(tuple, made), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("template", [floating, chat.marked_turns])
def test_pieces_of_all_blocks_make_the_whole_output(spark, template):
    rows = [(c, t, r or "user", (x or "").replace("<", ""), "p", 1) for c, t, r, x, *_ in _conversations()]
    whole = {}
    for r in sorted(chat.format_turns(spark.createDataFrame(rows, SCHEMA), template, block=16, window=4).collect(), key=lambda r: (r._part, r._row)):
        whole[r.conv_id] = (whole.get(r.conv_id, ("", ""))[0] + r.piece, r.closing)
    assert {c: a + b for c, (a, b) in whole.items()} == {c: template(turns) for c, turns in _sorted_turns(rows).items()}


def test_rewriting_templates_and_empty_tables(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"THINK{i}", "", 1) for i in range(10)] + [(2, 0, "user", "x", "", 1)]
    got = {k: list(v) for k, v in groupby(sorted(chat.format_turns(spark.createDataFrame(rows, SCHEMA), forgetful).collect(), key=lambda r: (r.conv_id, r._part, r._row)), lambda r: r.conv_id)}
    assert all(r.rewrites for r in got[1]) and not got[2][0].rewrites
    assert "".join(r.piece for r in got[1]) == forgetful([r[2:4] for r in rows[:10]])
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0
