"""Chat formatting by incremental rendering of a black box.

A template is any function from a list of (role, text) to one string. Nothing is known of it but its outputs: successive
prefixes of a conversation are rendered, and what an output has beyond the one before is the new turn's span. A closing that
stands only at the end of each output (an end mark) is found as what the outputs do not share, and goes to the last turn.
An output that changes what stood before shows a template that rewrites history. The text inside a turn's span is found by
rendering the turn once more with a probe character for its text: what stands before and after the probe must stand before
and after the text.

Turns are numbered by a range partitioning on (conversation, turn), so that one conversation may lie in many partitions, and
dealt out in blocks of ``BLOCK`` rows, each with the last rows before it. Windows of ``WINDOW`` turns are rendered after
``CONTEXT`` turns that come before, so an output is no longer than that; a template may look back so far. So a long conversation costs what its turns cost and is shared by many tasks; only its digest, one hash of all of its text, passes
through one task, as a stream of its sorted turns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import groupby
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import in_order

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]
#: Rows of a task's block, turns rendered together, turns rendered before them; the longest closing that is looked for.
BLOCK, WINDOW, CONTEXT, CLOSING = 1024, 32, 2, 1024
PROBE = "\ue000"

NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
CLOSE = "\n</turn>\n"
_CONTROL = re.compile(r"\\*(?:#{3,}|</turn>)")
_ESCAPED = re.compile(r"\\(\\*(?:#{3,}|</turn>))")
_HEAD = re.compile(r"### (?:(System|User|Assistant)|role=([^: ]*)): ")
_ROLES = {v: k for k, v in NAMES.items()}


def escape(text: str) -> str:
    """One more backslash before each control string (with its backslashes, if any), so that no unmarked one is left."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_turns(turns: Turns) -> str:
    """The default template: ``### Role: text``, a line ``</turn>``. Roles of other names are written out after ``role=``."""
    return "".join(f"### {NAMES.get(role) or 'role=' + quote(role, safe='', errors='surrogatepass')}: {escape(text)}{CLOSE}" for role, text in turns)


def read_turns(formatted: str) -> Turns:
    """The turns of the default template's output."""
    out, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = formatted.find(CLOSE, head.end()) if head else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        role = _ROLES[head[1]] if head[1] else unquote(head[2], errors="surrogatepass")
        out.append((role, unescape(formatted[head.end() : end])))
        at = end + len(CLOSE)
    return out


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def closing_length(template: Template) -> int:
    """How much of an output's end gives way to a next turn, at most, in conversations of two or three probes.

    One figure for all windows of a table, so that their pieces fit. A closing that begins like a turn does is the shorter for
    it, and each turn's span the longer; the pieces are the output all the same.
    """
    most = 0
    for roles in (("user", "assistant", "user"), ("system", "user", "assistant"), ("assistant", "user"), ("user", "user"), ("assistant", "assistant")):
        try:
            outs = [template([(role, PROBE) for role in roles[:k]]) for k in range(1, len(roles) + 1)]
        except Exception:  # noqa: BLE001  a template may refuse an order of roles
            continue
        for a, b in zip(outs, outs[1:]):
            change = len(a) - _shared(a, b)
            if change <= CLOSING and b.endswith(a[len(a) - change :]):
                most = max(most, change)
    return most


class Rendered:
    """What the prefixes of a conversation tell: ``text``, the last output; ``spans`` of turns; ``closing``, the end that follows
    whatever turn is the last; ``rewrites``, the first turn (from 0) whose coming changed earlier text, or None; ``inner``, the
    spans of the turns' own texts in ``text``, None where the template doesn't keep a text in one piece or ``ask`` leaves it out.

    Only two outputs are held at a time, and the ends of the others. ``cut`` is the closing's length as far as it is known.
    """

    def __init__(self, template: Template, turns: Turns, ask: Callable[[str], bool] = lambda role: True, cut: int | None = None):
        self.template, self.turns, self.rewrites, self.text = template, turns, None, ""
        cut, lengths, tails, inner = closing_length(template) if cut is None else cut, [], [], []
        for k, (role, _) in enumerate(turns):
            out = template(turns[: k + 1])
            if k:
                cut = self._meets(out, tails, cut, k)
            lengths.append(len(out))
            tails.append(out[-CLOSING:])
            self.text = out
            inner.append(self._inside(k, k + 1, out) if ask(role) else None)
        if self.rewrites is None:
            ends = [n - cut for n in lengths]
            self.spans, self.inner, self.closing = list(zip([0, *ends], ends)), inner, self.text[len(self.text) - cut :]
        else:  # earlier outputs say nothing of the last one
            self.spans, self.closing = [(0, len(self.text))] * len(turns), ""
            self.inner = [self._inside(k, len(turns), self.text) if ask(role) else None for k, (role, _) in enumerate(turns)]

    def _meets(self, out: str, tails: list[str], cut: int, k: int) -> int:
        """The length of the closing, now that turn ``k`` has come; notes the turn if no closing explains the change."""
        change = len(self.text) - _shared(self.text, out)
        longer = max(cut, change)
        closing = out[len(out) - longer :]
        known = tails[-1:] if longer == cut else tails
        if self.rewrites is None and not (longer <= CLOSING and all(t.endswith(closing) for t in known)):
            self.rewrites = k
        return longer

    def _inside(self, k: int, stop: int, out: str) -> tuple[int, int] | None:
        probe = PROBE
        while any(probe in t for _, t in self.turns[:stop]):
            probe += PROBE
        asked = [*self.turns[:k], (self.turns[k][0], probe), *self.turns[k + 1 : stop]]
        before, found, after = self.template(asked).partition(probe)
        if not found or probe in after or len(before) + len(after) > len(out) or not (out.startswith(before) and out.endswith(after)):
            return None
        return len(before), len(out) - len(after)


def pieces_of(template: Template, turns: Turns, own: list[bool], loss_role: str, window: int = WINDOW, context: int = CONTEXT, cut: int | None = None) -> Iterator[tuple]:
    """(turn's number, piece, loss spans in the piece, closing, rewrites, lost) of the turns that ``own`` marks."""
    asked = lambda role: role == loss_role
    for start in range(0, len(turns), window):
        mine = range(start, min(start + window, len(turns)))
        if not any(own[k] for k in mine):
            continue
        first = max(0, start - context)
        r = Rendered(template, turns[first : mine.stop], asked, cut)
        if r.rewrites is not None:
            mine = [k for k in mine if own[k]]
            first = mine[0]
            r = Rendered(template, turns[first : mine[-1] + 1], asked, cut)  # what isn't returned must not be in the output
        for k in mine:
            if not own[k]:
                continue
            (begin, end), inner = r.spans[k - first], r.inner[k - first : k - first + 1]
            if r.rewrites is not None:  # the window's whole output comes with its last turn
                begin, inner = (0, r.inner) if k == mine[-1] else (end, [])
            loss = [[x - begin, y - begin] for x, y in filter(None, inner)]
            yield k, r.text[begin:end], loss, r.closing, r.rewrites is not None, asked(turns[k][0]) and r.inner[k - first] is None


def _renderer(template: Template, loss_role: str, window: int, context: int):
    """A block's rows to one row a turn."""
    cut = closing_length(template)

    def render(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_from", "_row"])
        every, out = list(zip(rows["conv_id"], rows["_from"], rows["_row"], rows["role"], rows["text"], rows["_own"])), []
        for conv, run in groupby(every, key=lambda r: r[0]):
            run = list(run)
            turns = [(r[3] or "", r[4] or "") for r in run]
            for k, *made in pieces_of(template, turns, [r[5] for r in run], loss_role, window, context, cut):
                out.append((conv, run[k][1], run[k][2], turns[k][0], *made))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in _PIECE.split(", ")])

    return render


_PIECE = "conv_id string, _part long, _row long, role string, piece string, loss array<array<int>>, closing string, rewrites boolean, lost boolean"


def format_turns(rows: DataFrame, template: Template = marked_turns, loss_role: str = "assistant", block: int = BLOCK, window: int = WINDOW, context: int = CONTEXT) -> DataFrame:
    """(conv_id, _part, _row, role, piece, loss, closing, rewrites, lost), one row for each row of (conv_id, turn, role, text).

    A conversation's output is its pieces end to end by (_part, _row), and the ``closing`` of the last. ``loss`` holds spans of
    the piece (from, to, in code points) that are texts of ``loss_role``. ``rewrites`` marks turns of a window in which the
    template changed earlier text; then the window's output is one piece, at its last turn. ``lost`` marks texts of
    ``loss_role`` that the template doesn't keep in one piece. Rows go by turn, null first, then role and text. A null text or
    role is empty, null ids are one conversation. Further columns aren't read; an empty table returns none.
    """
    need = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    placed = in_order(need, ["conv_id", "turn", "role", "text"])
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row a partition
    after = [(p, n, q) for (p, n), (q, _) in zip(sizes, sizes[1:])]
    nexts = placed.sparkSession.createDataFrame(after, "_part long, _n long, _next long")
    here = F.floor(F.col("_row") / block).cast("long")
    own = placed.select("*", F.col("_part").alias("_in"), here.alias("_block"), F.lit(True).alias("_own"))
    # the last turns before a block go with it, be it of the same partition or the next
    met = placed.join(F.broadcast(nexts), "_part", "left")
    to = F.when(F.col("_n").isNotNull() & (F.col("_row") >= F.col("_n") - context), F.struct(F.col("_next").alias("p"), F.lit(0).cast("long").alias("b")))
    inside = F.when(F.pmod("_row", F.lit(block)) >= block - context, F.struct(F.col("_part").alias("p"), (here + 1).alias("b")))
    led = met.select(*placed.columns, F.explode(F.array_compact(F.array(to, inside))).alias("_to"))
    led = led.select(*placed.columns, F.col("_to.p").alias("_in"), F.col("_to.b").alias("_block"), F.lit(False).alias("_own"))
    both = own.union(led).withColumnRenamed("_part", "_from")
    both = both.withColumn("conv_id", F.col("conv_id").cast("string"))  # pandas has no null among whole numbers
    made = both.groupBy("_in", "_block").applyInPandas(_renderer(template, loss_role, window, context), _PIECE)
    return made.withColumn("conv_id", F.col("conv_id").cast("long"))


_DIGEST = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean, lost long"


def _digests(read: Callable[[str], Turns], clear: Callable[[str], str]):
    """Sorted pieces to one row a conversation. Only the hash states of one conversation are held."""

    class State:
        def __init__(self, conv):
            self.conv, self.turns, self.loss = conv, sha256(), sha256()
            self.n, self.loss_chars, self.chars, self.rewrites, self.lost, self.closing = 0, 0, 0, False, 0, ""

        def add(self, piece, loss, closing, rewrites, lost):
            for role, text in read(piece):
                self.n += 1
                self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for begin, end in loss:
                text = clear(piece[begin:end])
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.chars, self.rewrites, self.lost, self.closing = self.chars + len(piece), self.rewrites or rewrites, self.lost + lost, closing

        def row(self):
            return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars + len(self.closing), self.rewrites, self.lost

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _DIGEST.split(", ")]
        state = None
        for batch in batches:
            done = []
            for conv, *rest in zip(*[batch[c] for c in batch.columns]):
                if state is None or state.conv != conv:
                    if state is not None:
                        done.append(state.row())
                    state = State(conv)
                state.add(*rest)
            if done:
                yield pd.DataFrame(done, columns=names)
        if state is not None:
            yield pd.DataFrame([state.row()], columns=names)

    return digests


def read_back(pieces: DataFrame, read: Callable[[str], Turns] = read_turns, clear: Callable[[str], str] = unescape) -> DataFrame:
    """One row for each conversation of :func:`format_turns`: what its output says when it is read again.

    n_turns and turns_sha256 (of role, line feed, text, line feed of every turn), loss_chars and loss_sha256 (of the texts under
    the mask, unescaped), formatted_chars; rewrites; lost, the texts of the loss role that no mask covers.
    """
    streams = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "_part", "_row")
    streams = streams.select(F.col("conv_id").cast("string").alias("conv_id"), "piece", "loss", "closing", "rewrites", "lost")
    return streams.mapInPandas(_digests(read, clear), _DIGEST).withColumn("conv_id", F.col("conv_id").cast("long"))


def with_example(rows: DataFrame) -> DataFrame:
    """``rows`` and conversation -7, whose two texts hold the template's own marks."""
    text = "\\### Assistant: </turn> ok"
    added = rows.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").union(added)


