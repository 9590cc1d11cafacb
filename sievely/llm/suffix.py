"""Removal of repeated byte strings, by suffix sorting and threshold-bounded interval expansion.

What can repeat is found first: every string of LENGTH bytes is owned by the least hash among its GRAM-byte grams (its
anchor), so equal strings have equal anchors at the same place. An anchor with the run of strings that it owns is a
segment; segments whose anchor occurs once cannot hold a repeated string and go no further. Equal segments are
one from the start (within a task before the shuffle, across tasks behind it), the earliest stands for them.

The segments that share an anchor are joined into one text. Its suffixes are sorted by ranks of ever longer prefixes, and its
Burrows-Wheeler transform is extended backwards: a suffix x + w starts where the C array and the rank of x put w's, so
two neighbours with the same first byte have a common prefix one longer than the smallest between their tails. Prefix
lengths are thus derived breadth-first by increasing value, each position once, and the expansion stops at LENGTH: the
positions that are still open then share LENGTH bytes or more with their neighbour. In each run of those, all but the
earliest start are repeats.

Cases: null and empty texts and texts under LENGTH bytes lose nothing; null doc_ids come before all others; rows that
repeat a doc_id are ordered by text, equal rows one after the other. An empty table gives no rows. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Hasher, as_bytes, mix64, partitions, slices, small_batches, written

LENGTH, GRAM = 100, 32
_PIECE = 1 << 20
#: Anchors that a task combines at a time, and bytes of segments that are sorted at a time: so few that the arrays stay in a
#: core's cache (an anchor's segments are never parted).
COMBINE, SORT_BYTES = 1_000_000, 250_000


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM (32) bytes from each place on."""
    x = data.astype(np.uint64)
    with np.errstate(over="ignore"):
        for width in (1, 2, 4):
            x = x[:-width] | x[width:] << np.uint64(8 * width)
        for width, a, b in ((8, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93), (16, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            x = mix64(x[:-width] * np.uint64(a) + (x[width:] ^ (x[width:] >> np.uint64(29))) * np.uint64(b))
    return x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, first and last string start (in the row), anchor's hash, hash of the segment; for all rows at once."""
    out: list[tuple[np.ndarray, ...]] = []
    for low in range(0, max(0, len(data) - LENGTH + 1), _PIECE):
        piece = data[low : low + _PIECE + LENGTH - 1]
        n = len(piece) - LENGTH + 1
        if n <= 0:
            break
        grams = _grams(piece)
        key = (grams & ~np.uint64(2 * _PIECE - 1)) | np.arange(len(grams), dtype=np.uint64)
        reach = 1
        while 2 * reach <= LENGTH - GRAM + 1:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if rest := LENGTH - GRAM + 1 - reach:
            key = np.minimum(key[:-rest], key[rest:])
        place = (key[:n] & np.uint64(2 * _PIECE - 1)).astype(np.int64)
        start = np.arange(low, low + n)
        row = np.searchsorted(offsets, start, side="right") - 1
        valid = start + LENGTH <= offsets[row + 1]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        a, b = np.flatnonzero(new), np.flatnonzero(ends)
        if not len(a):
            continue
        with np.errstate(over="ignore"):
            whole = mix64(Hasher(piece, fold=False)(a, b + LENGTH) + (place[a] - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        base = offsets[row[a]]
        out.append((row[a], a + low - base, b + low - base, grams[place[a]], whole))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_PACK = np.dtype([("doc", "<i8"), ("lo", "<i8"), ("hi", "<i8")])


def _combined(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """One row per segment content: its earliest place, and the others packed."""
    doc, lo, hi, anchor, whole = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((lo, doc, whole, anchor))
    doc, lo, hi, anchor, whole = doc[order], lo[order], hi[order], anchor[order], whole[order]
    first = np.flatnonzero(np.concatenate(([True], (whole[1:] != whole[:-1]) | (anchor[1:] != anchor[:-1]))))
    counts = np.diff([*first, len(doc)])
    packed = np.empty(len(doc), _PACK)
    packed["doc"], packed["lo"], packed["hi"] = doc, lo, hi
    others = [packed[a + 1 : a + c].tobytes() if c > 1 else None for a, c in zip(first.tolist(), counts.tolist(), strict=True)]
    return pa.RecordBatch.from_pydict({"anchor": anchor[first].astype(np.int64), "whole": whole[first].astype(np.int64), "doc": doc[first], "lo": lo[first], "hi": hi[first], "others": pa.array(others, pa.binary())})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, n = [], 0
    for batch in slices(batches, "text"):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        row, lo, hi, anchor, whole = anchors(*as_bytes(batch.column("text")))
        if len(row):
            found.append((ids[row], lo, hi, anchor, whole))
            n += len(row)
        if n >= COMBINE:
            yield _combined(found)
            found, n = [], 0
    if found:
        yield _combined(found)


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, segment and place: repeats of a segment become spans, differing segments of an anchor stay open.

    anchor is null for spans. Holds one row of the group at hand.
    """
    held, open_, out = None, False, []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["anchor", "doc", "lo", "hi"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "whole", "doc", "lo", "hi", "others")), strict=True):
            if row[5] is not None:
                out += [(None, *map(int, x)) for x in np.frombuffer(row[5], _PACK).tolist()]
            if held is None or row[0] != held[0]:
                held, open_ = row, False
                continue
            if row[1] == held[1]:
                out.append((None, *row[2:5]))
                continue
            if not open_:
                out.append((held[0], *held[2:5]))
            out.append((row[0], *row[2:5]))
            held, open_ = row, True
        if len(out) > 10_000:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def suffix_order(text: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes sorted by their first `depth` symbols at least, and their places; text: ints from 0 to 510."""
    n = len(text)
    padded = np.concatenate((text.astype(np.int64), np.full(8, -1))) + 1
    key = np.zeros(n, np.int64)
    for k in range(7):  # seven symbols of 9 bits
        key = key << 9 | padded[k : k + n]
    rank, width = np.empty(n, np.int64), 7
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64))))
        distinct = int(rank[order[-1]]) + 2  # with 0 for what lies behind the end
        if width >= depth or distinct > n:
            break
        # As many ranks, each of the next `width` symbols, as a key holds: two at least.
        parts = max(2, next(m for m in range(2, 64) if distinct ** (m + 1) >= 1 << 63))
        key = rank + 1
        for k in range(1, parts):
            key *= distinct
            if k * width < n:
                key[: n - k * width] += rank[k * width :] + 1
        width *= parts
    order = order.astype(np.int32) if n < 1 << 31 else order
    place = np.empty_like(order)
    place[order] = np.arange(n, dtype=order.dtype)
    return order, place


def long_runs(text: np.ndarray, separators: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and for each of its places whether the suffix shares `length` symbols with the one before.

    separators[i]: text[i] ends a segment; it matches nothing, itself included.
    """
    n = len(text)
    order, place = suffix_order(text, length)
    first = text[order]
    # Backward extension: where the tail of the suffix at each place stands (the inverse of the LF mapping).
    tail = place[np.minimum(order + 1, n - 1)]
    small = np.zeros(n, bool)  # common prefixes derived so far, all below the value at hand
    small[0] = True
    small[1:] = (first[1:] != first[:-1]) | separators[order[1:]] | separators[order[:-1]]
    open_ = np.flatnonzero(~small)
    low, high = tail[open_ - 1], tail[open_]
    for _ in range(1, length):
        if not len(open_):
            break
        count = np.cumsum(small, dtype=np.int32 if n < 1 << 31 else np.int64)
        # A common prefix of this value + 1 or more needs one of this value or more all the way between the tails.
        ends = count[low] != count[high]
        if not ends.any():
            # No interval of this value: none of a larger value can start from it.
            break
        small[open_[ends]] = True
        going = ~ends
        open_, low, high = open_[going], low[going], high[going]
    shares = np.zeros(n, bool)
    shares[open_] = True
    return order, shares


def _repeats(segments: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place in it) of the strings of LENGTH bytes that start earlier as well."""
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    separators = np.zeros(len(text), bool)
    separators[ends] = True
    text[ends] = 0
    order, shares = long_runs(text, separators)
    owner = np.searchsorted(ends, order)
    place = order - (ends - sizes)[owner]
    run = np.cumsum(~shares)
    in_run = shares.copy()
    in_run[:-1] |= shares[1:]
    k = np.flatnonzero(in_run)
    by = np.lexsort((starts[owner[k]] + place[k], docs[owner[k]], run[k]))
    k = k[by]
    at, doc, start = run[k], docs[owner[k]], starts[owner[k]] + place[k]
    new = np.concatenate(([True], at[1:] != at[:-1])) if len(k) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)
    # The same place may be in two segments of its document; it is no repeat of itself.
    later = (doc != doc[lead]) | (start != start[lead])
    return owner[k[later]], place[k[later]]


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: spans of repeats, a few whole groups at a time."""
    rows: list[tuple] = []
    size = 0

    def solve(part: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs, starts = np.array([r[1] for r in part]), np.array([r[2] for r in part])
        owner, place = _repeats([r[3] for r in part], docs, starts)
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        if not len(owner):
            return
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)))
        a = np.flatnonzero(new)
        b = np.concatenate((a[1:] - 1, [len(owner) - 1]))
        yield pa.RecordBatch.from_pydict({"doc": docs[owner[a]], "lo": starts[owner[a]] + place[a], "hi": starts[owner[b]] + place[b]})

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "lo", "segment")), strict=True):
            if size > SORT_BYTES and row[0] != rows[-1][0]:
                yield from solve(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield from solve(rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each open segment."""
    for batch in slices(batches, "text"):
        anchor, doc, lo, segment = [], [], [], []
        for d, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "places")), strict=True):
            raw = (text or "").encode()
            for x in places:
                anchor.append(x["anchor"])
                doc.append(d)
                lo.append(x["lo"])
                segment.append(raw[x["lo"] : x["hi"] + LENGTH])
        yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor, pa.int64()), "doc": pa.array(doc, pa.int64()), "lo": pa.array(lo, pa.int64()), "segment": pa.array(segment, pa.binary())})


def _merge(places: list[dict] | None) -> list[tuple[int, int]]:
    """Removed byte runs [a, b) from runs of string starts."""
    out: list[list[int]] = []
    for x in sorted(places or [], key=lambda x: (x["lo"], x["hi"])):
        a, b = x["lo"], x["hi"] + LENGTH
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans array<struct<start, end>>: the byte runs of each document (null text: empty) that repeat earlier ones."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not rows.select("doc_id").groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        # Places of their own for rows without a doc_id of their own, in order.
        own = rows.orderBy(F.col("doc_id").asc_nulls_first(), "text").withColumn("given", F.monotonically_increasing_id())
        own = written(own, "suffix-rows")
        out = _spans(own.select(F.col("given").alias("doc_id"), "text")).withColumnRenamed("doc_id", "given")
        return out.join(own.select("given", "doc_id"), "given").select("doc_id", "text", "spans")
    return _spans(rows)


def _spans(rows: DataFrame) -> DataFrame:
    n = partitions(rows.sparkSession)
    read = rows.mapInArrow(_read, "anchor long, whole long, doc long, lo long, hi long, others binary")
    refined = read.repartition(n, "anchor").sortWithinPartitions("anchor", "whole", "doc", "lo").mapInArrow(_refine, "anchor long, doc long, lo long, hi long")
    refined = written(refined, "suffix-places")
    by_doc = rows.repartition(n, "doc_id")
    places = refined.where("anchor is not null").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "lo", "hi")).alias("places"))
    segments = by_doc.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(_cut, "anchor long, doc long, lo long, segment binary")
    sorted_ = segments.repartition(n, "anchor").sortWithinPartitions("anchor", "doc", "lo").mapInArrow(_sort, "doc long, lo long, hi long")
    spans = refined.where("anchor is null").select("doc", "lo", "hi").unionByName(sorted_)
    spans = spans.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("lo", "hi")).alias("places"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            merged = [[{"start": a, "end": b} for a, b in _merge(x)] for x in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(merged, kind)], ["doc_id", "text", "spans"])

    return by_doc.join(spans, "doc_id", "left").select("doc_id", "text", "places").mapInArrow(merge, "doc_id long, text string, spans array<struct<start: bigint, end: bigint>>")


def summary(spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of removed_spans()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, at, digest = (text or "").encode(), 0, hashlib.sha256()
                for x in found:
                    digest.update(raw[at : x["start"]])
                    at = x["end"]
                digest.update(raw[at:])
                out.append((len(raw), sum(x["end"] - x["start"] for x in found), len(found), digest.hexdigest()))
            a, b, c, d = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return spans.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, text without its repeated byte runs (bytes that no longer make a character become U+FFFD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, at, kept = (text or "").encode(), 0, []
                for x in found:
                    kept.append(raw[at : x["start"]])
                    at = x["end"]
                texts.append(b"".join([*kept, raw[at:]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return removed_spans(docs).mapInArrow(run, "doc_id long, text string")
