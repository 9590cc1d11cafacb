"""Fill-in-the-middle on ropes.

A text is a balanced tree whose leaves hold some units (words with the white space before them, and white space at the
end) and whose nodes cache how many units and code points are below them. A document is split at two unit ranks, the
three subtrees are joined in their new order with sentinels between them, and a rendered text is inverted by splitting a
tree of it at the sentinels' code points. Only the leaves that a cut goes through are ever scanned again.

Where to cut and which form to use come from a hash of the seed and doc_id, so that a run can be repeated and no row
depends on another: nothing is shuffled, and a task holds one slice of texts.

Cases: null text is empty; an empty text and one that holds a sentinel stay plain; null doc_id is hashed as ''; rows that
repeat a doc_id or a text are rows of their own; a unit of any length stays in one leaf; an empty table gives no rows.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, small_batches, texts_of

#: The sentinels before prefix, suffix and middle, and the units of a text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
_UNITS = re.compile(_UNIT + r"|[\x20\x09-\x0D]++")
#: Units of a leaf.
LEAF = 256
_LEAVES = re.compile(rf"(?:{_UNIT}){{1,{LEAF}}}+|[\x20\x09-\x0D]++")


@dataclass(slots=True)
class Rope:
    """A leaf (text) or a node (left and right), with what is below it; no rope at all (None) is the empty text."""

    units: int
    chars: int
    text: str | None = None
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.text is not None:
                yield node.text
            else:
                stack += (node.right, node.left)


def leaf(text: str, units: int | None = None) -> Rope | None:
    return Rope(sum(1 for _ in _UNITS.finditer(text)) if units is None else units, len(text), text) if text else None


def concat(*parts: Rope | None) -> Rope | None:
    """The parts one after the other, each a subtree as it is."""
    whole = None
    for part in parts:
        whole = part if whole is None else whole if part is None else Rope(whole.units + part.units, whole.chars + part.chars, None, whole, part)
    return whole


def build(text: str) -> Rope | None:
    level = [leaf(m[0]) for m in _LEAVES.finditer(text)]
    while len(level) > 1:
        level = [concat(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0] if level else None


def split(rope: Rope | None, rank: int, by: str) -> tuple[Rope | None, Rope | None]:
    """What stands before and behind a rank of "units" or "chars". A unit that a code point cuts counts on both sides."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= getattr(rope, by):
        return rope, None
    if rope.text is not None:
        if by == "chars":
            return leaf(rope.text[:rank]), leaf(rope.text[rank:])
        at = next(islice(_UNITS.finditer(rope.text), rank - 1, None)).end()
        return leaf(rope.text[:at], rank), leaf(rope.text[at:], rope.units - rank)
    before = getattr(rope.left, by)
    if rank < before:
        a, b = split(rope.left, rank, by)
        return a, concat(b, rope.right)
    a, b = split(rope.right, rank - before, by)
    return concat(rope.left, a), b


def render(rope: Rope | None) -> str:
    return "" if rope is None else "".join(rope.leaves())


def arrange(text: str, draws: tuple[int, int, int, int], fim_percent: int = 50, spm_percent: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """Units, form (plain, psm or spm), code points of prefix and middle (None if plain), and the text in that form."""
    whole = build(text)
    n = whole.units if whole else 0
    if not n or draws[2] % 100 >= fim_percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    head, suffix = split(whole, high, "units")
    prefix, middle = split(head, low, "units")
    first, second = (leaf(PREFIX), prefix), (leaf(SUFFIX), suffix)
    form = "spm" if draws[3] % 100 < spm_percent else "psm"
    made = concat(*(second + first if form == "spm" else first + second), leaf(MIDDLE), middle)
    return n, form, prefix.chars if prefix else 0, middle.chars if middle else 0, render(made)


def invert(output: str, form: str) -> str:
    """The text that arrange() took; sentinels cannot stand anywhere else in its output."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(one) or two not in output or MIDDLE not in output:
        raise ValueError(f"no text of the form {form}")
    rest, parts = build(output), []
    for at in (output.rindex(MIDDLE), output.index(two), 0):  # from the end, so that places before a cut stay as they are
        rest, part = split(rest, at, "chars")
        parts.append(split(part, len(MIDDLE), "chars")[1])
    middle, b, a = parts
    return render(concat(b, middle, a) if form == "spm" else concat(a, middle, b))


_OUT = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of every row."""
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [arrange(text, tuple(h), fim_percent, spm_percent) for text, h in zip(texts_of(batch.column("text")), batch.column("draws").to_pylist(), strict=True)]
            made = [batch.column("doc_id").to_pylist(), *zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, _OUT.values(), strict=True)], list(_OUT))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), draws.alias("draws")).mapInArrow(run, _SCHEMA)


def restored(made: DataFrame) -> DataFrame:
    """The rows of transform() with `restored`, the text rebuilt from output and form."""
    small_batches(made.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output"):
            back = [invert(o, f) for o, f in zip(texts_of(batch.column("output")), batch.column("form").to_pylist(), strict=True)]
            yield batch.append_column("restored", pa.array(back, pa.string()))

    return made.select(*_OUT).mapInArrow(run, _SCHEMA + ", restored string")
