"""Chat formatting by incremental black-box rendering.

The formatter knows nothing of a template but its ``render(turns) -> str``. It
renders successive turn prefixes and compares consecutive outputs: what a
prefix adds to the one before is the turn's span. Rendering the last turn with
two sentinel texts instead of its own shows which part of that span is the
text and which is markup. A prefix whose output does not start with the output
before it betrays a template that rewrites history.

Rendering every prefix takes time that grows with the square of the turns. A
template whose output for a turn depends on, or changes, no more than the last
few turns can say so by an attribute ``look_back``; then prefixes need not
reach back further. Without it they begin at the first turn.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
SENTINELS = ("A", "B")


class MarkedTurns:
    """Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` for each turn.

    Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``;
    in roles a line feed becomes ``\\n`` as two characters. So no text can forge
    a control string, and ``unescape`` gives back what was said.
    """

    START, END = "<|im_start|>", "<|im_end|>"
    look_back = 0  # each turn is rendered by itself
    _turn = re.compile(r"<\|im_start\|>([^\n]*)\n((?:[^<]|<(?!\|))*)<\|im_end\|>\n")

    @staticmethod
    def escape(text: str) -> str:
        return text.replace("\\", "\\\\").replace("<|", "<\\|")

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text

    def render(self, turns: list[tuple[str, str]]) -> str:
        return "".join(
            f"{self.START}{self.escape(role).replace(chr(10), chr(92) + 'n')}\n{self.escape(text)}{self.END}\n" for role, text in turns
        )

    def parse(self, piece: str) -> list[tuple[str, str]]:
        """Turns in a rendered text; raises ValueError if anything else stands in it."""
        out, at = [], 0
        while at < len(piece):
            m = self._turn.match(piece, at)
            if m is None:
                raise ValueError("not a rendered turn")
            out.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        return out


def turn_spans(template, turns: list[tuple[str, str]], known: int = 0, before: str | None = None) -> Iterator[tuple[str, int, int, bool]]:
    """For each turn from ``known`` on: what it adds to the output, the text's span in that (-1, -1 if it can't be told), whether history was rewritten."""
    before = template.render(turns[:known]) if before is None else before
    for k in range(known, len(turns)):
        now = template.render(turns[: k + 1])
        if not now.startswith(before):
            same = len(os.path.commonprefix([before, now]))
            yield now[same:], -1, -1, True
        else:
            start, end = -1, -1
            if turns[k][0] == ASSISTANT:
                a, b = (template.render([*turns[:k], (ASSISTANT, s)]) for s in SENTINELS)
                if a.startswith(before) and b.startswith(before):
                    head = len(os.path.commonprefix([a, b]))
                    tail = len(os.path.commonprefix([a[head:][::-1], b[head:][::-1]]))
                    start, end = head - len(before), len(now) - tail - len(before)
            yield now[len(before) :], start, end, False
        before = now


def conversation_spans(template, turns: list[tuple[str, str]], look_back: int | None, step: int) -> list[tuple[str, int, int, bool]]:
    """The spans of a whole conversation; in runs of ``step`` turns as long as what they join to is what the template renders."""
    if look_back is None:
        return list(turn_spans(template, turns))
    out, joined, check = [], [], step
    for a in range(0, len(turns), step):
        context = max(0, a - look_back)
        out += turn_spans(template, turns[context : a + step], a - context)
        joined += [piece for piece, *_ in out[len(joined) :]]
        if len(out) >= check or len(out) == len(turns):
            if any(rewrites for *_, rewrites in out) or template.render(turns[: len(out)]) != "".join(joined):
                return list(turn_spans(template, turns))
            check = 2 * len(out)
    return out


FORMATTED = "conv_id long, seq long, piece string, loss_start long, loss_end long, rewrites boolean"


def format_conversations(conversations: DataFrame, template=None, step: int = 16) -> DataFrame:
    """One row per turn, in order within its partition: the piece it adds to the formatted conversation, and the loss span in it.

    conversations: conv_id, turn, role, text; other columns are ignored. Turns
    are taken by (turn, role, text); rows that repeat stay and null turns come
    first; null roles and texts are empty; a null conv_id is a conversation.
    The formatted conversation is its pieces, joined. Spans count code points;
    -1 marks turns outside the loss. Where a template rewrites history, the
    turn is flagged, its piece starts at the first change, and it has no loss.

    Where the template has a ``look_back``, conversations are rendered in runs
    of ``step`` turns, each after the ``look_back`` turns before it as context.
    That is not taken on trust: prefixes of doubling length and the whole
    conversation are rendered as well and held against the joined pieces,
    which takes as long again as rendering twice. Where they differ, and where a
    template has no ``look_back``, every prefix is rendered whole. A task holds the turns
    of one conversation and its pieces.
    """
    template = template or MarkedTurns()
    look_back = getattr(template, "look_back", None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, out = object(), [], []

        def close() -> None:
            out.extend((conv, seq, *span) for seq, span in enumerate(conversation_spans(template, turns, look_back, step)))

        for batch in batches:
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if c != conv:
                    close()
                    conv, turns = c, []
                turns.append((role or "", text or ""))
            yield _batch(out)
            out = []
        close()
        yield _batch(out)

    cols = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"]
    order = ["conv_id", "turn", "role", "text"]
    return conversations.select(*cols).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(rows, FORMATTED)


_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("seq", pa.int64()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("rewrites", pa.bool_())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame, template=None) -> DataFrame:
    """Digests of each conversation, read from the pieces alone (role and text by ``parse``, loss by the spans).

    formatted: as ``format_conversations`` gives it, all pieces of a
    conversation in one partition and in their order.
    """
    template = template or MarkedTurns()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, first = None, None, True
        out = []

        def close():
            if state is not None:
                out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for c, seq, piece, start, end in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if first or seq == 0:
                    close()
                    conv, state, first = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], False
                for role, text in template.parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start >= 0:
                    loss = template.unescape(piece[start:end])
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * 6, _DIGEST)], schema=_DIGEST)
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * 6, _DIGEST)], schema=_DIGEST)

    return formatted.mapInArrow(rows, DIGEST)
