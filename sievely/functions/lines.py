"""An index of the lines of a batch of texts, as arrays over its UTF-8 bytes; no line is ever an object of its own.

Where lines start and end, how deep they are indented, how long they are when clipped, whether they open a definition:
each is one array over all lines of all texts of the batch. Lines become strings in Arrow buffers only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import text as tx

#: Bytes of text that one pass of array code works on, about; a longer text is a pass of its own.
PASS_BYTES = 2_000_000
#: What stands for the rest of a line that is too long.
CUT = np.frombuffer(b" ...", np.uint8)

_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[9, 10, 11, 12, 13, 32]] = True


def passes(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` holds about PASS_BYTES in each."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + PASS_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space: the ASCII ones, and the longer characters of tx.WHITE_SPACE wherever they stand."""
    white = _ASCII_WHITE[data]
    wide = [c.encode() for c in tx.WHITE_SPACE if ord(c) > 127]
    for lead in {c[0] for c in wide}:
        at = np.flatnonzero(data == lead)
        for char in (c for c in wide if c[0] == lead):
            found = at[at + len(char) <= len(data)]
            for k in range(1, len(char)):
                found = found[data[found + k] == char[k]]
            for k in range(len(char)):
                white[found + k] = True
    return white


@lru_cache(maxsize=1)
def definition_table() -> tuple[np.ndarray, int, int]:
    """(transitions[state, byte], dead, accepted) of tx.DEFINITION behind leading white space: a trie of its words, from whose ends white space leads back to the root (modifiers) or on to acceptance (openers)."""
    words = {w: "modifier" for w in [*tx.MODIFIERS, "pub"]} | {w: "opener" for w in tx.OPENERS} | {tx.MACRO: "whole"}
    dead, accepted, root = 0, 1, 2
    rows: list[np.ndarray] = [np.full(256, k, np.int16) for k in (dead, accepted)]

    def state() -> int:
        rows.append(np.zeros(256, np.int16))
        return len(rows) - 1

    state()
    ends: dict[int, str] = {}
    for word, kind in words.items():
        at = root
        for k, byte in enumerate(word.encode()):
            if kind == "whole" and k == len(word) - 1:
                rows[at][byte] = accepted
                break
            if not rows[at][byte]:
                new = state()
                rows[at][byte] = new
            at = int(rows[at][byte])
        else:
            ends[at] = kind
            if word == "pub":
                opened, inside, closed = state(), state(), state()
                rows[at][ord("(")] = opened
                for letter in range(ord("a"), ord("z") + 1):
                    rows[opened][letter] = rows[inside][letter] = inside
                rows[inside][ord(")")] = closed
                rows[closed][_ASCII_WHITE] = root
    word_bytes = np.array([chr(b).isalnum() or b == ord("_") for b in range(128)] + [False] * 128)
    for at, kind in ends.items():
        free = rows[at] == dead
        if kind == "modifier":
            rows[at][free & _ASCII_WHITE] = root
        else:
            rows[at][free & ~word_bytes] = accepted
    rows[root][_ASCII_WHITE] = root
    return np.stack(rows), dead, accepted


class Lines:
    """All lines of a column of texts: `row` is the text that a line is in, `number` its place there, from 1."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = _utf8(column)
        data = self.data
        breaks = np.flatnonzero(data == 10)
        ends = self.offsets[1:][np.diff(self.offsets) > 0]
        tails = ends[data[ends - 1] != 10]
        # A text that ends without a line break may stop where the next one starts with one: its end comes first.
        order = np.sort(np.concatenate((2 * breaks + 1, 2 * tails)))
        stop, broken = order >> 1, order & 1
        self.start = np.concatenate((np.zeros(min(1, len(stop)), np.int64), (stop + broken)[:-1]))
        before = data[np.maximum(stop - 1, 0)] if len(data) else np.zeros(0, np.uint8)
        self.raw_end = stop - ((broken == 1) & (before == 13) & (stop > self.start))
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.first_line = np.searchsorted(self.row, np.arange(len(self.offsets)))
        self.number = np.arange(len(stop)) - self.first_line[self.row] + 1 if len(stop) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.start)

    @cached_property
    def _solid(self) -> np.ndarray:
        return np.flatnonzero(~_white(self.data))

    @cached_property
    def _before(self) -> np.ndarray:
        """Characters that start before each byte."""
        return np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))

    @cached_property
    def first(self) -> np.ndarray:
        """The first byte that is not white space; where a line is blank, its end."""
        at = np.searchsorted(self._solid, self.start)
        found = np.append(self._solid, len(self.data))[at]
        return np.minimum(found, self.raw_end)

    @cached_property
    def blank(self) -> np.ndarray:
        return self.first >= self.raw_end

    @cached_property
    def _trimmed(self) -> np.ndarray:
        """The end without trailing white space."""
        at = np.searchsorted(self._solid, self.raw_end) - 1
        return np.where(self.blank, self.start, np.append(self._solid, 0)[at] + 1)

    @cached_property
    def _full_length(self) -> np.ndarray:
        return self._before[self._trimmed] - self._before[self.start]

    @cached_property
    def cut(self) -> np.ndarray:
        return self._full_length > tx.MAX_LINE_CHARS

    @cached_property
    def end(self) -> np.ndarray:
        """The end of what a clipped line keeps."""
        end = self._trimmed.copy()
        if self.cut.any():
            heads = np.flatnonzero((self.data & 0xC0) != 0x80)
            end[self.cut] = heads[self._before[self.start[self.cut]] + tx.MAX_LINE_CHARS]
        return end

    @cached_property
    def length(self) -> np.ndarray:
        """Characters of the clipped lines."""
        return np.where(self.cut, tx.MAX_LINE_CHARS + len(CUT), self._full_length)

    @cached_property
    def indent(self) -> np.ndarray:
        """White space before the first other character of the clipped lines; the space of the mark of a cut line counts if nothing else is left."""
        deep = self._before[self.first] - self._before[self.start]
        return np.where(self.blank, 0, np.where(self.cut & (deep >= tx.MAX_LINE_CHARS), tx.MAX_LINE_CHARS + 1, deep))

    def costs(self, questions_per_line: float) -> np.ndarray:
        return 6 + self.length // 3 + int(tx.QUESTION_TOKENS * questions_per_line + 0.5)

    @cached_property
    def definition(self) -> np.ndarray:
        """Which lines open a definition: all candidates step through the table together, a byte at a time."""
        table, dead, accepted = definition_table()
        found = np.zeros(len(self), bool)
        # Only ASCII white space may stand before the words.
        live = np.flatnonzero(~self.blank & (self.first < self.end) & (self.first - self.start == self.indent))
        at, state = self.first[live], np.full(len(live), 2, np.int16)
        while len(live):
            over = at >= self.end[live]
            byte = np.where(over, 32, self.data[np.minimum(at, len(self.data) - 1)])
            state = table[state, byte]
            found[live[state == accepted]] = True
            keep = (state != dead) & (state != accepted) & ~over
            live, at, state = live[keep], at[keep] + 1, state[keep]
        return found

    def _strings(self, end: np.ndarray, cut: np.ndarray | None) -> pa.Array:
        size = end - self.start
        more = np.zeros(len(self), np.int64) if cut is None else cut * len(CUT)
        offsets = np.concatenate(([0], np.cumsum(size + more)))
        kept = np.repeat(np.arange(len(self)), size)
        inside = np.arange(len(kept)) - np.repeat(np.cumsum(size) - size, size)
        out = np.empty(offsets[-1], np.uint8)
        out[offsets[kept] + inside] = self.data[self.start[kept] + inside]
        if cut is not None and cut.any():
            at = offsets[1:][cut] - len(CUT)
            out[at[:, None] + np.arange(len(CUT))] = CUT
        return pa.StringArray.from_buffers(len(self), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))

    @cached_property
    def clipped(self) -> pa.Array:
        return self._strings(self.end, self.cut)

    @cached_property
    def raw(self) -> pa.Array:
        """The lines as they are, without their ends."""
        return self._strings(self.raw_end, None)


def lines_of(text: str) -> list[str]:
    """The lines of one small text on the driver."""
    return Lines(pa.array([text], pa.string())).raw.to_pylist()
