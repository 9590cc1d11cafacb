"""SpotSigs document fingerprints.

A spot is an anchor (a common word of the languages below, or the start of the text) and the chain of the next
CHAIN content words after it. A text's fingerprint is the set of its spots' hashes, written as sorted
8-digit hex numbers. So that all words count in texts with few such words too, the word with the least hash of each
window of WINDOW content words without an anchor between them is one, and so is the content word with just CHAIN
others behind it; the first rule looks at the window alone, so a shared passage gives shared spots. Every content
word is in a spot. Words are runs of letters and digits (ASCII case is folded, every byte beyond ASCII
counts as a letter).

Fingerprints are compared by Jaccard likeness. near_pairs() joins only sets whose sizes are near enough to reach
the threshold: a set is put in the partition of its size, its rarest spots (as many as must hit for the threshold)
are the join keys, and a pair is dropped as soon as its size bound is under the threshold.

Cases: null and empty texts have the empty fingerprint; two empty ones have likeness 1, an empty and a full one 0.
Texts with no words beyond anchors have only the start's spot. Equal texts have equal fingerprints, repeated rows are rows of
their own, and an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM, Hasher, as_bytes, mix64, partitions, slices, small_batches, word_bounds

#: The anchors, common words of four languages.
ANCHORS = """
a an the is are was be to of and in that it for on with as at by this from or not have he you they but his her we
le la les un une des de du et en que qui dans pour par sur au aux est avec ne pas ce il elle
der die das und ist ein eine von zu mit den dem im nicht sich auf als auch es an werden
el los las una y con se su lo del al por para no como más o
""".split()
CHAIN = 3
#: No more than CHAIN + 1, else words between spots are in none.
WINDOW = 4


def _anchor_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(sorted(set(ANCHORS))).encode(), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), ALNUM)
    return np.sort(Hasher(data)(starts, ends))


def _loose(word: np.ndarray, anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a word stands in for an anchor: the least of a window without one, or the last with a full chain behind it."""
    out = np.zeros(len(word), bool)
    if len(word) >= WINDOW:
        n = len(word) - WINDOW + 1
        anchors = np.concatenate(([0], np.cumsum(anchor)))
        at = np.flatnonzero((anchors[WINDOW:] == anchors[:n]) & (row[WINDOW - 1 :] == row[:n]))
        out[at + np.lib.stride_tricks.sliding_window_view(word, WINDOW)[at].argmin(axis=1)] = True
    content = np.flatnonzero(~anchor)
    c_row = row[content]
    last = np.flatnonzero(np.concatenate((c_row[1:] != c_row[:-1], [True]))) if len(content) else content
    tail = last[last >= CHAIN] - CHAIN
    out[content[tail[c_row[tail] == c_row[tail + CHAIN]]]] = True
    return out


def spots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row << 32 | spot), sorted and distinct, and for each row where its spots start; all rows at once."""
    data, offsets = as_bytes(texts)
    starts, ends, row = word_bounds(data, offsets, ALNUM)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = Hasher(data)(starts, ends)
    known = _anchor_hashes()
    at = np.searchsorted(known, word)
    anchor = known[np.minimum(at, len(known) - 1)] == word
    loose = _loose(word, anchor, row)
    content = np.flatnonzero(~anchor)
    hashes, rows = [], []
    c_word, c_row = word[content], row[content]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    for place, seed, kind in ((np.flatnonzero(anchor), 1, 1), (np.flatnonzero(loose), 1, 1), (first - 1, 0, 0)):
        spot_row = row[place + 1 - 1] if kind else row[first]
        seen = word[place] if kind else np.full(len(place), 17, np.uint64)
        nxt = np.searchsorted(content, place, side="right")
        with np.errstate(over="ignore"):
            mixed = seen * np.uint64(0x9FB21C651E98DF25) + np.uint64(seed)
            full = np.zeros(len(place), np.int64)
            for k in range(CHAIN):
                j = nxt + k
                ok = (j < len(content)) & (c_row[np.minimum(j, len(content) - 1)] == spot_row) if len(content) else np.zeros(len(place), bool)
                mixed = mix64(mixed + np.where(ok, c_word[np.minimum(j, max(len(content) - 1, 0))] if len(content) else 0, np.uint64(k + 1)).astype(np.uint64))
                full += ok
        keep = full == CHAIN if kind else np.ones(len(place), bool)
        hashes.append(mixed[keep])
        rows.append(spot_row[keep])
    both = np.concatenate(rows).astype(np.uint64) << np.uint64(32) | np.concatenate(hashes) >> np.uint64(32)
    both = np.unique(both)
    return both, np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))


def _hex(both: np.ndarray, at: np.ndarray) -> list[str]:
    text = (both & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()
    return [text[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:], strict=True)]


def jaccard(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """Likeness of the k-th set of a and the k-th of b; pairs whose sizes bound it under floor are not compared and get 0."""
    na, nb = np.diff(a_at), np.diff(b_at)
    bound = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    alive = bound >= floor
    if len(b):
        keep = alive[(a >> np.uint64(32)).astype(np.int64)] if len(a) else np.zeros(0, bool)
        asked = a[keep]
        j = np.minimum(np.searchsorted(b, asked), len(b) - 1)
        hit = np.bincount((asked[b[j] == asked] >> np.uint64(32)).astype(np.int64), minlength=len(na))
    else:
        hit = np.zeros(len(na), np.int64)
    union = na + nb - hit
    return np.where(union == 0, 1.0, np.where(alive, hit / np.maximum(union, 1), 0.0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_spots of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            both, at = spots(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fingerprint": pa.array(_hex(both, at), pa.string()), "n_spots": pa.array(np.diff(at))})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_spots long")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, position string: rows in tasks that together go through doc_id downwards (null last, ties by text).

    Tasks are cut at quantiles of doc_id; the row that follows a task's last one comes along as a row with
    sentinel = true, and so does the first row of all behind the last. One shuffle of the texts.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    n = max(1, partitions(spark))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.lit(len(cuts)).cast("int")
    for_id = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(for_id, lambda c: c >= F.col("doc_id")))).cast("int")
    rows = rows.withColumn("bucket", bucket)
    # The first row of each bucket, by id alone; its text goes to the bucket before it as well.
    heads = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    used = sorted(heads)
    if not used:
        return rows.select("doc_id", "text", F.lit(False).alias("sentinel"), "bucket")
    before = {b: used[k - 1] for k, b in enumerate(used)}  # the first one's is the last
    to = F.create_map(*[F.lit(x).cast("int") for pair in before.items() for x in pair])
    tops = F.create_map(*[F.lit(x) for b in used if heads[b] is not None for x in (int(b), int(heads[b]))]) if any(heads[b] is not None for b in used) else None
    is_top = F.col("doc_id").eqNullSafe(tops[F.col("bucket")]) if tops is not None else F.col("doc_id").isNull()
    copies = F.when(is_top, F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("s")), F.struct(to[F.col("bucket")].alias("b"), F.lit(True).alias("s")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("s"))))
    spread = rows.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", F.col("c.s").alias("sentinel"), F.col("c.b").alias("bucket"))
    # Buckets are numbered, so each is a task of its own.
    return spread.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "sentinel", F.col("doc_id").desc_nulls_last(), "text")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text (the last half replaced by the start of the next document), and both likenesses.

    The next document is the one with the next smaller doc_id, behind the last the first; of rows with one doc_id
    the text decides the order. doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Lists of (doc_id, text, text of the next)."""
        held, bucket, out, size, done = None, None, [], 0, False
        for batch in slices(batches, "text"):
            for doc_id, text, sentinel, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "sentinel", "bucket")), strict=True):
                if b != bucket:
                    held, bucket, done = None, b, False
                if held is not None and not done:
                    out.append((*held, text or ""))
                    size += len(held[1])
                done = done or sentinel
                held = (doc_id, text or "")
            if size > 1_000_000:
                yield out
                out, size = [], 0
        if out:
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in pairs(batches):
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in found]
            plain, plain_at = spots(pa.array([t for _, t, _ in found], pa.large_string()))
            edit, edit_at = spots(pa.array(edited, pa.large_string()))
            nxt, nxt_at = spots(pa.array([n for _, _, n in found], pa.large_string()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([d for d, _, _ in found], pa.int64()),
                "n_chars": pa.array([len(t) for _, t, _ in found], pa.int64()),
                "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                "fingerprint": pa.array(_hex(plain, plain_at), pa.string()),
                "edited_fingerprint": pa.array(_hex(edit, edit_at), pa.string()),
                "near_edited": jaccard(plain, plain_at, edit, edit_at),
                "near_next": jaccard(plain, plain_at, nxt, nxt_at),
            })

    small_batches(docs.sparkSession)
    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of different fingerprints with likeness >= threshold; a, b are the smallest doc_ids that have them.

    A set of n spots must share one of its n - ceil(threshold * n) + 1 rarest spots with a partner, so only
    those are joined on, and only within the same or the next size partition. No pair is lost.
    """
    f = fingerprints(docs).where("n_spots > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.first("n_spots").alias("n"))
    f = f.withColumn("spots", F.expr("transform(sequence(0, cast(n as int) - 1), k -> substring(fingerprint, 8 * k + 1, 8))")).select("doc_id", "n", "spots")
    each = f.select("doc_id", "n", F.explode("spots").alias("spot"))
    rare = each.groupBy("spot").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(rare, "spot", "left").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "spot"))).alias("s"))
    width = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold)).cast("int")
    keys = ranked.select("doc_id", "n", part.alias("part"), F.explode(F.slice("s", F.lit(1), width.cast("int"))).alias("k")).where("k.df > 1").select("doc_id", "n", "part", F.col("k.spot").alias("spot"))
    a = keys.toDF("a", "na", "pa", "spot")
    b = keys.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.explode(F.array("part", F.col("part") + 1, F.col("part") - 1)).alias("pa"), "spot")
    near = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9
    cand = a.join(b, ["spot", "pa"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    sets = f.select("doc_id", "spots")
    both = cand.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    hit = F.size(F.array_intersect("sa", "sb"))
    like = hit / (F.size("sa") + F.size("sb") - hit)
    return both.select("a", "b", like.alias("likeness")).where(F.col("likeness") >= threshold)
