"""Chat formatting with a grammar round trip.

The template frames each turn: opening mark, newline, content, newline, closing mark, newline. Marks are
[INST] [/INST] for user, <s> </s> for assistant, <<SYS>> <</SYS>> for system; any other role is written out
between <<ROLE>> and <</ROLE>> and its content ends with <</TURN>>. In content, a mark that follows k+1
backslashes stands for the mark after k backslashes. render() first writes contents as they are, reparses the
text with parse(), escapes the turns that do not come back, and repeats until the turns are identical.

Cases: null text or role is ''; turns are ordered by turn (null first), then role, then text; repeated rows
are turns of their own; rows with null conv_id form one conversation; an empty table gives no rows. Columns other than conv_id, turn, role
and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import partitions, small_batches

#: The template's marks.
FRAMES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE, ROLE_END, TURN_END = "<<ROLE>>", "<</ROLE>>", "<</TURN>>"
MARKS = [*(m for pair in FRAMES.values() for m in pair), ROLE, ROLE_END, TURN_END]
_MARK = re.compile(r"(\\*)(" + "|".join(map(re.escape, MARKS)) + ")")
_ESCAPED = re.compile(r"\\(\\*)(" + "|".join(map(re.escape, MARKS)) + ")")
_OPENERS = {pair[0]: (role, pair[1]) for role, pair in FRAMES.items()}


def escape(text: str) -> str:
    return _MARK.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _framed(role: str, content: str, shown_role: str | None = None) -> tuple[str, int]:
    """The turn's text and where its content starts."""
    if role in FRAMES:
        opening, closing = FRAMES[role]
        head = opening + "\n"
    else:
        head, closing = f"{ROLE}\n{role if shown_role is None else shown_role}\n{ROLE_END}\n", TURN_END
    return f"{head}{content}\n{closing}\n", len(head)


def _content(text: str, start: int, closing: str) -> tuple[str, int] | None:
    """What stands between start and the next mark, which must be the closing one on a line of its own."""
    at = start
    while m := _MARK.search(text, at):
        if not m[1]:
            if m[2] != closing or m.start() <= start or text[m.start() - 1] != "\n" or text[m.end() : m.end() + 1] != "\n":
                return None
            return unescape(text[start : m.start() - 1]), m.end() + 1
        at = m.end()
    return None


def parse(text: str) -> list[tuple[str, str]] | None:
    """The turns (role, content) of a formatted text; None if it is not one."""
    at, turns = 0, []
    while at < len(text):
        m = _MARK.match(text, at)
        if not m or m[1] or text[m.end() : m.end() + 1] != "\n":
            return None
        at = m.end() + 1
        if m[2] == ROLE:
            found = _content(text, at, ROLE_END)
            if found is None:
                return None
            role, at = found
            closing = TURN_END
        elif m[2] in _OPENERS:
            role, closing = _OPENERS[m[2]]
        else:
            return None
        found = _content(text, at, closing)
        if found is None:
            return None
        turns.append((role, found[0]))
        at = found[1]
    return turns


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text that parse() takes back to exactly these turns, and the spans that assistants say in it."""
    shown = [(role, None, content) for role, content in turns]
    for attempt in range(3):
        parts = [_framed(role, content, name) for role, name, content in shown]
        text = "".join(part for part, _ in parts)
        if parse(text) == turns:
            break
        for k, (role, content) in enumerate(turns):  # those that do not survive on their own; then all
            if attempt or parse(_framed(role, content)[0]) != [(role, content)]:
                shown[k] = (role, escape(role), escape(content))
    else:
        raise ValueError("a conversation does not survive the round trip")
    spans, at = [], 0
    for (role, _, content), (part, head) in zip(shown, parts, strict=True):
        if role == "assistant":
            spans.append((at + head, at + head + len(content)))
        at += len(part)
    return text, spans


_FORMATTED = "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>"


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and the loss mask as starts and ends in code points.

    Rows arrive sorted, so a task holds one conversation and one Arrow batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple[str, str]] = []
        size, conv, first = 0, None, True

        def close() -> None:
            text, spans = render(held)
            out.append((conv, text, [a for a, _ in spans], [b for _, b in spans]))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "formatted", "loss_starts", "loss_ends"])

        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if not first and c != conv:
                    close()
                    held = []
                    if len(out) >= 500 or size > 4_000_000:
                        yield batch_of()
                        out, size = [], 0
                conv, first = c, False
                held.append((role or "", text or ""))
                size += len(text or "")
        if not first:
            close()
        if out:
            yield batch_of()

    spark = conversations.sparkSession
    small_batches(spark)
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> as the parser finds them, loss_texts array<string> under the mask, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            texts = batch.column("formatted").to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse(x or "") or []] for x in texts]
            spans = zip(texts, batch.column("loss_starts").to_pylist(), batch.column("loss_ends").to_pylist(), strict=True)
            losses = [[unescape(x[a:b]) for a, b in zip(starts or [], ends or [], strict=True)] for x, starts, ends in spans]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(turns, kind), pa.array(losses, pa.list_(pa.string())), pa.array([len(x or "") for x in texts], pa.int64())], ["conv_id", "turns", "loss_texts", "formatted_chars"])

    small_batches(formatted.sparkSession)
    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(run, "conv_id long, turns array<struct<role: string, text: string>>, loss_texts array<string>, formatted_chars long")
