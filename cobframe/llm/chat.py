"""Chat formatting by prefix-target expansion.

A turn is rendered as ``### Role: text </turn>`` and a line end; inside texts
and roles every backslash, ``#`` and ``<`` is escaped by a backslash, so no text
can hold a marker and the escape can be undone.  Every assistant turn becomes
an example of its own: its context is all that precedes it in its conversation,
and only the reply lies under the loss mask.

The rendered turns are stored once, and an example of ``expand`` names its
context by reference (``0 .. start`` of its conversation).  ``write_out`` writes
the contexts out in pieces of bounded size, which takes the square of a
conversation's length in time and its length in scratch space, but no shuffle
and no more memory; ``digests`` reads these.

Defined results: turns go by turn number (nulls first), ties by role, then
text; null roles and texts are empty; repeated rows are turns of their own; a
null conv_id is a conversation like any other; a conversation without assistant
turns has turns and no examples; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobframe.llm import common

OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
ESCAPE, UNESCAPE = re.compile(r"([\\#<])"), re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"### ((?:[^\\#<:]|\\.|:(?! ))*): ((?:[^\\#<]|\\.)*) </turn>\n", re.DOTALL)
TURN_SCHEMA = ("conv_id long, position long, rendered string, start long, length long, "
               "target boolean, loss_start long, loss_end long")


def escape(text: str) -> str:
    return ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends in it."""
    head = OPEN + escape(role).replace(": ", ":\\ ") + BETWEEN
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(rendered: str) -> list[tuple[str, str]]:
    """Roles and texts of rendered turns; fails on anything else."""
    out, at = [], 0
    while at < len(rendered):
        m = TURN.match(rendered, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_turns(conversations: DataFrame, target_role: str = "assistant", id_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rendered turns of every conversation, in order within partitions:
    ``conv_id, position, rendered, start, length, target, loss_start, loss_end``;
    places are code points of the formatted conversation.  A row with
    ``target`` is an example: context ``0 .. start``, mask ``loss_start .. loss_end``.

    One sorted pass; a task holds one batch at a time, however long a conversation is."""
    common.prepare(conversations.sparkSession)
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        now, place, at = (), 0, 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now != (conv,):
                    now, place, at = (conv,), 0, 0
                turn, begin, end = render(role, text)
                mine = role == target_role
                out.append((conv, place, turn, at, len(turn), mine, at + begin if mine else None, at + end if mine else None))
                place, at = place + 1, at + len(turn)
            if out:
                names = [c.split(" ")[0] for c in TURN_SCHEMA.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(run, TURN_SCHEMA))


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: its context and mask, by place."""
    return turns.where("target").select(
        "conv_id", F.col("position").alias("target_position"), F.lit(0).cast("long").alias("context_start"),
        F.col("start").alias("context_end"), "loss_start", "loss_end", (F.col("start") + F.col("length")).alias("example_chars"))


def example_texts(turns: DataFrame) -> DataFrame:
    """Examples written out: ``conv_id, target_position, context, completion``.
    The result holds each prefix again for each of its replies."""
    t, c = turns.where("target").alias("t"), turns.alias("c")
    joined = t.join(c, (F.col("t.conv_id").eqNullSafe(F.col("c.conv_id"))) & (F.col("c.position") < F.col("t.position")), "left")
    return joined.groupBy(F.col("t.conv_id").alias("conv_id"), F.col("t.position").alias("target_position"),
                          F.col("t.rendered").alias("completion")).agg(
        F.array_sort(F.collect_list(F.struct("c.position", "c.rendered"))).alias("p")).select(
        "conv_id", "target_position", F.array_join(F.col("p.rendered"), "").alias("context"), "completion")


EXPANDED_SCHEMA = ("conv_id long, rendered string, completion string, context_end long, context_sha256 string, "
                   "loss_start long, loss_end long")


def expand(turns: DataFrame) -> DataFrame:
    """Prefix-target expansion of ``format_turns``' rows, in their order: each
    turn as ``rendered``, and before each assistant turn's own row its example:
    ``completion`` (the target turn), the context it follows (``0 .. context_end``
    of the formatted conversation, with the SHA-256 of that text) and the loss
    mask by code points of context and completion together."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [c.split(" ")[0] for c in EXPANDED_SCHEMA.split(", ")]

    def run(batches):
        now, prefix = (), hashlib.sha256()
        for batch in batches:
            out = []
            columns = ("conv_id", "rendered", "target", "start", "loss_start", "loss_end")
            for conv, rendered, target, start, a, b in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if now != (conv,):
                    now, prefix = (conv,), hashlib.sha256()
                if target:
                    out.append((conv, None, rendered, start, prefix.hexdigest(), a, b))
                out.append((conv, rendered, None, None, None, None, None))
                prefix.update(rendered.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return turns.mapInArrow(run, EXPANDED_SCHEMA)


PIECE_CHARS, HELD_CHARS = 1 << 16, 1 << 25


class Prefix:
    """A text that grows at its end and is read again and again from its start,
    in pieces; beyond ``held`` characters its pieces lie in a scratch file."""

    def __init__(self, piece: int = PIECE_CHARS, held: int = HELD_CHARS):
        self.piece, self.room = piece, held
        self.full, self.last, self.chars = [], [], 0
        self.sizes, self.file = [], None

    def add(self, text: str) -> None:
        self.last.append(text)
        self.chars += len(text)
        if self.chars >= self.piece:
            whole = "".join(self.last)
            cut = len(whole) - len(whole) % self.piece
            for i in range(0, cut, self.piece):
                self._keep(whole[i:i + self.piece])
            self.last, self.chars = [whole[cut:]], len(whole) - cut

    def _keep(self, piece: str) -> None:
        if self.room >= len(piece) and self.file is None:
            self.full.append(piece)
            self.room -= len(piece)
            return
        self.file = self.file or tempfile.TemporaryFile()
        data = piece.encode()
        self.file.seek(0, 2)
        self.file.write(data)
        self.sizes.append(len(data))

    def pieces(self):
        yield from self.full
        if self.file is not None:
            self.file.seek(0)
            for size in self.sizes:
                yield self.file.read(size).decode()
        if self.chars:
            self.last = ["".join(self.last)]
            yield self.last[0]


WRITTEN_SCHEMA = ("conv_id long, rendered string, context string, completion string, context_end long, "
                  "context_sha256 string, loss_start long, loss_end long")


def write_out(expanded: DataFrame, piece: int = PIECE_CHARS, held: int = HELD_CHARS) -> DataFrame:
    """``expand``'s rows, in their order, with every example's context written out
    before it: rows of ``context``, up to ``piece`` characters each, that make the
    context when they are put together."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [c.split(" ")[0] for c in WRITTEN_SCHEMA.split(", ")]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches):
        now, prefix = (), Prefix(piece, held)
        for batch in batches:
            out, chars = [], 0
            for conv, rendered, *example in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    now, prefix = (conv,), Prefix(piece, held)
                if rendered is not None:
                    out.append((conv, rendered, None, None, None, None, None, None))
                    prefix.add(rendered)
                    chars += len(rendered)
                    continue
                for text in prefix.pieces():
                    out.append((conv, None, text, None, None, None, None, None))
                    chars += len(text)
                    if chars > 64 * PIECE_CHARS:
                        yield batch_of(out)
                        out, chars = [], 0
                out.append((conv, None, None, *example))
            if out:
                yield batch_of(out)

    return expanded.mapInArrow(run, WRITTEN_SCHEMA)


def digests(turns: DataFrame) -> DataFrame:
    """What the formatted conversations and their examples say when they are read
    back; ``turns`` as ``format_turns`` returns them, each conversation's rows
    together in order.  Everything under the loss mask, and the examples' length,
    is read from the examples written out, whose context must be the conversation
    up to there."""
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, n_examples long, example_chars long")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    class Reading:
        def __init__(self, conv):
            self.conv, self.turns, self.loss, self.chars, self.examples, self.spread = conv, 0, 0, 0, 0, 0
            self.said, self.masked, self.read = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
            self.context, self.context_chars = hashlib.sha256(), 0

        def add_turn(self, rendered):
            for role, text in parse(rendered):
                self.turns += 1
                self.said.update(f"{role}\n{text}\n".encode())
            self.chars += len(rendered)
            self.read.update(rendered.encode())

        def add_context(self, text):
            self.context.update(text.encode())
            self.context_chars += len(text)

        def add_example(self, completion, context_end, context_sha256, loss_start, loss_end):
            written = self.context_chars, self.context.hexdigest()
            if not written == (context_end, context_sha256) == (self.chars, self.read.hexdigest()):
                raise ValueError(f"conversation {self.conv}: the context of example {self.examples} is not its prefix")
            under = unescape(completion[loss_start - context_end:loss_end - context_end])
            self.loss += len(under)
            self.masked.update(under.encode())
            self.examples += 1
            self.spread += self.context_chars + len(completion)
            self.context, self.context_chars = hashlib.sha256(), 0

        def row(self):
            return (self.conv, self.turns, self.said.hexdigest(), self.loss, self.masked.hexdigest(), self.chars,
                    self.examples, self.spread)

    def run(batches):
        now = None
        for batch in batches:
            out = []
            for conv, rendered, context, *example in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.row())
                    now = Reading(conv)
                if rendered is not None:
                    now.add_turn(rendered)
                elif context is not None:
                    now.add_context(context)
                else:
                    now.add_example(*example)
            if out:
                yield batch_of(out)
        if now is not None:
            yield batch_of([now.row()])

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                          [c.split(" ")[0] for c in schema.split(", ")])

    return write_out(expand(turns)).mapInArrow(run, schema)
