"""Logical blocks of a file, and chunks of blocks under a line and a token budget. Rows of files in, rows of chunks out, no shuffle.

A pass works on the line index of many files at once. Where the block that would start at a line ends is found for all
lines together, a step of one line at a time; which of them do start is found by following those ends from the first
lines of all files, in doubling strides. What fits a budget is looked up in sums. No line is a Python object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import Lines, passes

#: Lengths at which a paragraph, a member and anything may end a block.
MIN_LEN, MEMBER_LEN, MAX_LEN, HARD_LEN, DEEP = 6, 12, 40, 50, 1_000_000
#: Lines of what stands before it that the second half of a chunk carries.
LEAD = 12


@dataclass(frozen=True)
class Chunking:
    max_lines: int = 150
    max_tokens: int = 14_000
    context: int = 12
    questions_per_line: float = 1.0


def spread(cfg: Chunking, chunks: int, jobs: int) -> Chunking | None:
    """A finer chunking that fills the lanes of a backend that answers one question after the other; None if they are full."""
    lanes = jobs * 0.75
    if not chunks or chunks >= lanes:
        return None
    scale = max(chunks / lanes, 0.25)
    return replace(cfg, max_lines=max(1, -int(-cfg.max_lines * scale // 1)), max_tokens=max(1, -int(-cfg.max_tokens * scale // 1)))


def _follow(after: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """All places met from the roots when each place leads to after[place], which is further on; len(after) is the end."""
    met = np.zeros(len(after) + 1, bool)
    met[roots] = True
    jump, known = np.append(after, len(after)), -1
    while known < (known := np.count_nonzero(met)):
        met[jump[np.flatnonzero(met)]] = True
        met[-1] = True
        jump = jump[jump]
    return np.flatnonzero(met[:-1])


def _roots(row: np.ndarray) -> np.ndarray:
    """The first place of each run of equal values."""
    return np.flatnonzero(np.diff(row, prepend=-1))


def _behind(row: np.ndarray) -> np.ndarray:
    """For each place the first one behind its run of equal values."""
    return np.searchsorted(row, row, side="right")


def blocks_of(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """The first and last line (of all lines) of each block; blank lines behind a block's last line belong to none."""
    real = np.flatnonzero(~lines.blank)
    if not len(real):
        return real, real
    indent, definition, row = lines.indent[real], lines.definition[real], lines.row[real]
    after_blank, behind = np.diff(real, prepend=-2) > 1, _behind(row)
    after = behind.copy()
    # Of the lines seen behind each, the least indent deeper than its own.
    live, inner, step = np.arange(len(real)), np.full(len(real), DEEP), 1
    while len(live):
        here = live + step
        inside = here < behind[live]
        live, here, inner = live[inside], here[inside], inner[inside]
        deep, base, length = indent[here], indent[live], real[here] - real[live]
        outer = deep <= base
        opens = definition[here] & (deep <= np.minimum(inner, base + 8)) & (outer | (length >= MIN_LEN))
        parts = (length >= MIN_LEN) & (outer | ((deep <= inner) & (length >= MEMBER_LEN)) | (length >= MAX_LEN))
        ends = (after_blank[here] & ((deep < base) | opens | parts)) | (length >= HARD_LEN)
        after[live[ends]] = here[ends]
        inner = np.where(outer, inner, np.minimum(inner, deep))[~ends]
        live, step = live[~ends], step + 1
    starts = _follow(after, _roots(row))
    return real[starts], real[np.append(starts[1:], len(real)) - 1]


def chunks_of(lines: Lines, cfg: Chunking) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last lines of the pieces of blocks, and the first piece of each chunk: pieces packed in order while both budgets hold; a block over a budget is cut first."""
    most = max(1, cfg.max_lines)
    spent = np.concatenate(([0], np.cumsum(lines.costs(cfg.questions_per_line))))
    at, stop = blocks_of(lines)
    first, last = [at[:0]], [at[:0]]
    while len(at):
        fits = np.searchsorted(spent, spent[at] + cfg.max_tokens, side="right") - 2
        end = np.maximum(at, np.minimum(stop, np.minimum(at + most - 1, fits)))
        first.append(at)
        last.append(end)
        at, stop = end[end < stop] + 1, stop[end < stop]
    starts, ends = np.sort(np.concatenate(first)), np.sort(np.concatenate(last))
    if not len(starts):
        return starts, ends, starts
    used, row = np.concatenate(([0], np.cumsum(spent[ends + 1] - spent[starts]))), lines.row[starts]
    by_lines = np.searchsorted(ends, starts + most - 1, side="right")
    by_tokens = np.searchsorted(used, used[:-1] + cfg.max_tokens, side="right") - 1
    after = np.minimum(_behind(row), np.maximum(np.arange(len(starts)) + 1, np.minimum(by_lines, by_tokens)))
    return starts, ends, _follow(after, _roots(row))


BLOCK_LIST = "array<struct<start:int,end:int>>"
CHUNK = f"path string, ctx_start int, start int, end int, blocks {BLOCK_LIST}, lines array<string>"


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(_int(np.concatenate(([0], np.cumsum(sizes)))), values)


def _over(files: DataFrame, make: Callable[[pa.Array, Lines], pa.RecordBatch], schema: str) -> DataFrame:
    """make(paths, lines) of all passes over files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            yield make(batch.column("path"), Lines(batch.column("text")))

    return files.select("path", "text").mapInArrow(run, schema)


def line_table(files: DataFrame) -> DataFrame:
    """path, line, raw, text (clipped), blank, indent, definition of every line."""

    def make(paths: pa.Array, lines: Lines) -> pa.RecordBatch:
        found = {"path": paths.take(pa.array(lines.row)), "line": _int(lines.number), "raw": lines.raw, "text": lines.clipped, "blank": pa.array(lines.blank), "indent": _int(lines.indent), "definition": pa.array(lines.definition)}
        return pa.RecordBatch.from_pydict(found)

    return _over(files, make, "path string, line int, raw string, text string, blank boolean, indent int, definition boolean")


def token_costs(files: DataFrame, questions_per_line: float) -> DataFrame:
    """path, line, tokens: what each line adds to a request."""

    def make(paths: pa.Array, lines: Lines) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": paths.take(pa.array(lines.row)), "line": _int(lines.number), "tokens": _int(lines.costs(questions_per_line))})

    return _over(files, make, "path string, line int, tokens int")


def split_blocks(files: DataFrame) -> DataFrame:
    """path, start, end of every block."""

    def make(paths: pa.Array, lines: Lines) -> pa.RecordBatch:
        first, last = blocks_of(lines)
        return pa.RecordBatch.from_pydict({"path": paths.take(pa.array(lines.row[first])), "start": _int(lines.number[first]), "end": _int(lines.number[last])})

    return _over(files, make, "path string, start int, end int")


def chunk_files(files: DataFrame, cfg: Chunking = Chunking(), original: bool = False) -> DataFrame:
    """One row per chunk: path, ctx_start, start, end, blocks, lines (of ctx_start..end; clipped, or as they are)."""

    def make(paths: pa.Array, lines: Lines) -> pa.RecordBatch:
        starts, ends, heads = chunks_of(lines, cfg)
        tails = np.append(heads[1:], len(starts))
        first, last = starts[heads], ends[tails - 1]
        row = lines.row[first]
        shown = np.maximum(first - cfg.context, lines.first_line[row])
        size = last - shown + 1
        held = np.repeat(shown - np.cumsum(size) + size, size) + np.arange(size.sum())
        blocks = pa.StructArray.from_arrays([_int(lines.number[starts]), _int(lines.number[ends])], ["start", "end"])
        return pa.RecordBatch.from_pydict({
            "path": paths.take(pa.array(row)), "ctx_start": _int(lines.number[shown]), "start": _int(lines.number[first]), "end": _int(lines.number[last]),
            "blocks": _lists(tails - heads, blocks), "lines": _lists(size, (lines.raw if original else lines.clipped).take(pa.array(held))),
        })

    return _over(files, make, CHUNK)


def halve(chunks: DataFrame) -> DataFrame:
    """Both halves of every chunk of two lines or more, with `half` 0 or 1; other columns stay.

    The cut is the block start nearest the middle line, or that line if there is one block only. The first half keeps the
    chunk's context, the second has up to LEAD lines before it; blocks are cut to their half.
    """
    start, end, shown = F.col("start"), F.col("end"), F.col("ctx_start")
    middle = start + F.floor((end - start + 1) / 2).cast("int")
    inner = F.transform(F.filter("blocks", lambda b, k: k > 0), lambda b: F.struct(F.abs(b["start"] - middle), b["start"].alias("start")))
    cut = F.coalesce(F.array_min(inner)["start"], middle)

    def half(k: int, first: Column, last: Column, context: Column) -> Column:
        held = F.slice("lines", context - shown + 1, last - context + 1)
        mine = F.filter("blocks", lambda b: (b["start"] <= last) & (b["end"] >= first))
        mine = F.transform(mine, lambda b: F.struct(F.greatest(b["start"], first).alias("start"), F.least(b["end"], last).alias("end")))
        return F.struct(F.lit(k).alias("half"), context.alias("ctx_start"), first.alias("start"), last.alias("end"), mine.alias("blocks"), held.alias("lines"))

    own = ["ctx_start", "start", "end", "blocks", "lines"]
    cuts = chunks.where(end > start).withColumn("cut", cut)
    at = F.col("cut")
    both = F.array(half(0, start, at - 1, shown), half(1, at, end, F.greatest(start, at - LEAD)))
    return cuts.select(*(c for c in chunks.columns if c not in own), F.explode(both).alias("h")).select(*(c for c in chunks.columns if c not in own), "h.*")
