"""MinHash near-duplicate removal: one-permutation hashing, optimal densification, banded buckets, star edges.

A text's set is hashed once; the top bits of a hash choose its bin and the least hash of a bin stands for it. An
empty bin borrows from the full bin that comes first in a random order of the bins of its own. Bins are joined
into bands; sets that agree in a band share its bucket. Equal sets are one class from the start. In a bucket, the
class found in the largest buckets is the centre and only (centre, member) edges are candidates; they are confirmed
on the full sets. Where that leaves a bucket in several components, its members are compared in blocks by
products of incidence matrices, from which only the links that join components come out, so that no link between
other members is lost. Bands and rows are chosen so that a pair at the threshold shares no bucket with a
probability under MISS.

Cases: null and empty texts, and texts without words, have the empty set, size 0 and are linked with nothing; texts
with fewer words than a shingle have one shingle, the whole sequence. Rows with a null doc_id are linked with nothing
and stay. Rows that repeat a doc_id are documents of their own that share a name; each is linked by its own text. An
empty table gives no rows. Columns other than doc_id and text are not read by groups(); dedup() keeps all of them. A
set is held as the 64-bit hashes of its shingles, which have no structured collisions (Hasher).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NOT_SPACE, Hasher, as_bytes, fresh, mix64, repeats_ids, slices, small_batches, split_by, word_bounds, written, written_alone
from .components import components

#: Most bins of a signature, and the chance that a pair at the threshold is not found.
MOST_BINS = 200
MISS = 1e-6
#: Members of a block in the comparison of what stars leave open.
BLOCK = 512


def bands_and_rows(percent: int) -> tuple[int, int]:
    """The most selective banding of at most MOST_BINS bins that misses a pair at the threshold with a probability under MISS."""
    best = (MOST_BINS, 1)
    for rows in range(1, 20):
        bands = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))
        if bands * rows <= MOST_BINS:
            best = (bands, rows)
    return best


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each row."""
    data, offsets = as_bytes(texts)
    starts, ends, row = word_bounds(data, offsets, NOT_SPACE)
    n = len(offsets) - 1
    at = np.searchsorted(row, np.arange(n + 1))
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n
    word = Hasher(data)(starts, ends)
    n_sets = max(0, len(word) - words + 1)
    mixed = np.full(n_sets, words, np.uint64)
    for k in range(words):
        mixed = _chained(mixed, word[k : k + n_sets])
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(mixed[a : b - words + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = _chained(whole, word[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a sequence and one more word; for one sequence, different words never collide."""
    with np.errstate(over="ignore"):
        return mix64(before * np.uint64(0x9FB21C651E98DF25) + word)


def _orders(bins: int) -> np.ndarray:
    """[bin, other]: at which place of the bin's own random order of bins the other comes."""
    return np.argsort(np.argsort(np.random.default_rng(20).random((bins, bins)), axis=1), axis=1)


def signature(shingles: np.ndarray, bins: int, orders: np.ndarray) -> np.ndarray:
    place = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    full, first = np.unique(place.astype(np.int64), return_index=True)
    out = np.zeros(bins, np.uint64)
    out[full] = shingles[first]
    if len(full) < bins:
        empty = np.ones(bins, bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        out[empty] = shingles[first][np.argmin(orders[np.ix_(empty, full)], axis=1)]
    return out


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key, bands array<long> (null for sets too small for any partner but equal ones)."""
    bands, rows = bands_and_rows(percent)
    least = math.ceil(percent / (100 - percent) - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(bands * rows)
        factors = mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        salt = mix64(np.arange(1000, 1000 + bands, dtype=np.uint64))
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            big = np.array([len(s) >= least for s in sets])
            with np.errstate(over="ignore"):
                keys = [mix64((signature(s, bands * rows, orders).reshape(bands, rows) * factors).sum(axis=1) + salt).astype(np.int64) for s, b in zip(sets, big, strict=True) if b]
            offsets = np.concatenate(([0], np.cumsum(big * bands))).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_key": pa.array([_key(s) for s in sets], pa.binary()), "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            })

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rep, shingles of the wanted classes (rep, set_key; a written table), from the whole texts; other texts are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            keep = [k for k, (s, key) in enumerate(zip(sets, batch.column("set_key").to_pylist(), strict=True)) if _key(s) == key]
            offsets = np.concatenate(([0], np.cumsum([len(sets[k]) for k in keep]))).astype(np.int32)
            flat = np.concatenate([sets[k] for k in keep]).astype(np.int64) if keep else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"rep": batch.column("rep").take(pa.array(keep, pa.int64())), "shingles": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

    rows, _ = split_by(docs.select(F.col("doc_id").alias("rep"), F.col("text").cast("string").alias("text")), "rep", wanted.select("rep"))
    rows = rows.join(wanted, "rep")
    return rows.select("rep", "text", "set_key").mapInArrow(run, "rep long, shingles array<long>")


def block_links(sets: list[np.ndarray], groups: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of different groups, as few as join what is linked; all pairs are compared on full sets."""
    m, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(m), sizes.astype(np.int64))
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    column, owner = shared[inverse[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((m, m))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 16384):
        a, b = np.searchsorted(column, [low, low + 16384])
        part = np.zeros((m, 16384), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part @ part.T
    union = sizes[:, None] + sizes[None, :] - both
    x, y = np.nonzero(np.triu(100 * both >= percent * union, 1))
    names, root = np.unique(groups, return_inverse=True)
    parent = list(range(len(names)))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        p, q = top(int(root[a])), top(int(root[b]))
        if p != q:
            parent[p] = q
            out.append((a, b))
    return out


def _in_places(docs: DataFrame, name: str) -> DataFrame:
    """docs, written, with a number of its own for each row that has a doc_id, in the order of doc_id, text and all columns."""
    order = F.to_json(F.struct(*docs.columns))
    rows = docs.orderBy(F.col("doc_id").asc_nulls_first(), "text", order).withColumn(name, F.monotonically_increasing_id())
    return written(rows.withColumn(name, F.when(F.col("doc_id").isNotNull(), F.col(name))), "minhash-places")


def groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where 100 * intersection >= percent * union of their shingle sets."""
    docs = docs.select("doc_id", "text")
    if not repeats_ids(docs):
        return _groups(docs, words, percent)
    placed = _in_places(docs, "place")
    found = _groups(placed.select(F.col("place").alias("doc_id"), "text"), words, percent).toDF("place", "n_shingles", "root", "kept")
    names = placed.where("place is not null").select("place", "doc_id")
    out = found.join(names, "place", "left").join(names.toDF("root", "component_id"), "root", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """groups() where no two rows share a doc_id."""
    sig = written(signatures(docs, words, percent), "minhash")
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "minhash-classes")
    buckets = classes.where("size(bands) > 0").select("rep", "n", F.explode("bands").alias("bucket"))
    # Aggregates by bucket are written before they are joined: the join then has a plain shuffle on both sides, and the
    # engine cuts a hot bucket into several tasks; a small aggregate is broadcast by its size on disk.
    common = written(buckets.groupBy("bucket").agg(F.count("*").alias("in_bucket")).where("in_bucket > 1"), "minhash-common")
    shared = written(buckets.join(common, "bucket"), "minhash-buckets")
    # The star's centre: the class that meets most others, since copies agree with their original more than with each other.
    popular = shared.groupBy("rep").agg(F.sum("in_bucket").alias("met"))
    ranked = shared.join(popular, "rep").select("bucket", "rep", "n", F.struct("met", (-F.col("rep")).alias("order")).alias("rank"))
    centres = written(ranked.groupBy("bucket").agg(F.max_by(F.struct("rep", "n"), "rank").alias("c")), "minhash-centres")
    near = 100 * F.least(F.col("n"), F.col("c.n")) >= percent * F.greatest(F.col("n"), F.col("c.n"))
    edges = shared.join(centres, "bucket").where((F.col("rep") != F.col("c.rep")) & near).select(F.col("c.rep").alias("a"), F.col("rep").alias("b")).distinct()
    edges = written(edges, "minhash-edges")
    open_ = shared.where("in_bucket > 2").select("rep").distinct()
    keys = classes.select("rep", "set_key")
    wanted = edges.select(F.col("a").alias("rep")).union(edges.select(F.col("b").alias("rep"))).union(open_).distinct().join(keys, "rep")
    sets = written(_full_sets(docs, written(wanted, "minhash-wanted"), words), "minhash-sets")
    both = edges.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    hit = F.size(F.array_intersect("sa", "sb"))
    links = written(both.where(100 * hit >= percent * (F.size("sa") + F.size("sb") - hit)).select("a", "b"), "minhash-links")
    first = components(links)
    placed = shared.where("in_bucket > 2").select("bucket", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    left = placed.groupBy("bucket").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).where("low < high")
    left = written(left.groupBy("m", "who").agg(F.min("bucket").alias("bucket")), "minhash-open")
    if not left.isEmpty():
        more = _compare_blocks(placed.join(left.select("bucket", "m"), "bucket"), sets, percent)
        links = written(links.unionByName(more), "minhash-links")
        first = components(links)
    labelled = classes.select("set_key", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "set_key").join(labelled, "set_key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _compare_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components within buckets; members: bucket, m (members in it), rep, component.

    The largest component of a bucket is joined already, so each pair to look at has a member outside of it (a guest).
    All m members are dealt into blocks, guests into blocks of their own, and each block meets each block of guests.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    main = written(sizes.groupBy("bucket").agg(F.max_by("component", F.struct("size", (-F.col("component")).alias("o"))).alias("main"), F.max("size").alias("top")), "minhash-main")
    rows = members.join(main, "bucket").withColumn("homes", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("guests", F.ceil((F.col("m") - F.col("top")) / BLOCK).cast("int"))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("rep", "bucket"), F.col("homes").cast("long")).cast("int")).withColumn("guest", F.pmod(F.xxhash64("bucket", "rep"), F.col("guests").cast("long")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda j: F.struct(F.col("home").alias("i"), j.alias("j")))
    visits = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda i: F.struct(i.alias("i"), F.col("guest").alias("j")))
    both = F.when(F.col("component") == F.col("main"), pairs).otherwise(F.array_union(pairs, visits))
    rows = rows.select("bucket", "rep", "component", F.explode(both).alias("k")).select("bucket", "k.i", "k.j", "rep", "component").join(sets, "rep")

    def compare(table: pa.Table) -> pa.Table:
        reps = table.column("rep").to_pylist()
        lists = table.column("shingles").combine_chunks()
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        arrays = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        found = block_links(arrays, np.asarray(table.column("component")), percent)
        return pa.table({"a": pa.array([reps[x] for x, _ in found], pa.int64()), "b": pa.array([reps[y] for _, y in found], pa.int64())})

    return rows.select("bucket", "i", "j", "rep", "component", "shingles").groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that no row before them stands for: one of each group stays, with all its columns.

    Rows come in the order of doc_id; where doc_ids repeat, of text and then of all columns, and a row that repeats
    another's doc_id and text is a copy of it. Rows without a doc_id or without words are in no group and stay.
    """
    spark = docs.sparkSession
    place, judged = fresh(docs.columns, "place", "judged_place")
    if repeats_ids(docs):
        docs = _in_places(docs, place)
        named = docs.select(F.col(place).alias("doc_id"), "text")
    else:
        docs = docs.withColumn(place, F.col("doc_id"))
        named = docs.select("doc_id", "text")
    found = written_alone(spark, lambda: _groups(named, words, percent).where("doc_id is not null").select(F.col("doc_id").alias(judged), "kept"), "minhash-kept")
    # Of those that stay and those that go, the fewer are looked up; most rows are decided by a filter, so that their texts are not shuffled.
    counts = found.agg(F.count_if("kept").alias("stay"), F.count_if(~F.col("kept")).alias("go")).first()
    few_stay = counts["stay"] < counts["go"]
    few = found.where(F.col("kept") == F.lit(few_stay)).select(judged)
    maybe, others = split_by(docs, place, few)
    looked_up = maybe.join(few, F.col(place) == F.col(judged), "left_semi" if few_stay else "left_anti")
    return looked_up.unionByName(others.where(F.col(place).isNull()) if few_stay else others).drop(place)
