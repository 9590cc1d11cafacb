"""Approximate nearest neighbours by largest inner product: an adaptive dimension scan of probed lists.

A bounded sample gives, for each length of vectors, the centres of inverted lists (k-means) and the number of lists that
a query probes: the least that finds TARGET of the sample's own neighbours, so that data without clusters is probed more
widely. Every vector is in the list of its nearest centre. Within a list, vectors and queries are rotated by a random
orthogonal matrix and kept in blocks of columns. A candidate's squared distance over the first t of d rotated columns,
scaled by d/t, estimates the whole; it is abandoned as soon as the estimate exceeds (1 + EPSILON/sqrt(t))^2 times the
distance at which its inner product would equal the k-th best found so far. Queries start from the k-th best of the
sample, which is a part of the table and whose best are found too, and tighten it as a list is scanned. What is left is measured on the original
vectors in double precision.

Equal vectors are one class, searched once; of a class the k+1 smallest ids count, which is all that any answer can hold.
Lists are cut into blocks of BLOCK vectors and their queries into chunks of CHUNK, so no task holds a long list or serves
all queries of one.

Cases: vectors that are null, empty or zero or hold null or non-finite components, or have a null id, take no part; vectors
of different lengths never meet; a length that the sample lacks has one list, probed by all; with fewer candidates than k, all are
returned; ties go to the smaller id; rows that repeat an id with another vector are queries and candidates of their own, rows that
repeat both are one. An empty table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, small_batches, written
from .vectors import _valid

#: Components of the sample that sets centres, probes and first bounds, and vectors of it at most.
SAMPLE_COMPONENTS, SAMPLE = 1 << 20, 8192
#: Vectors of a list, about, and lists of one length at least and at most.
LIST, LEAST_LISTS, MOST_LISTS = 2048, 4, 512
#: Share of the sample's neighbours that the probed lists must hold.
TARGET = 0.97
#: The confidence of the hypothesis tests: larger abandons later.
EPSILON = 2.1
#: Columns between two tests, vectors of a list that are scanned at a time, vectors of a block, queries of a chunk and of one pass.
STEP, SUB, BLOCK, CHUNK, PASS = 16, 1024, 4096, 4096, 256


class Index:
    """Rotation, centres, probes and the sample's vectors for one length of vectors."""

    def __init__(self, d: int, sample: np.ndarray, reps: list[int], n: int, k: int):
        self.k = k
        self.sample, self.reps = sample, np.array(reps, np.int64)
        self.longest = float(np.linalg.norm(sample, axis=1).max(initial=0.0))
        self.rotation = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
        lists = min(max(LEAST_LISTS, min(MOST_LISTS, n // LIST)), max(1, len(sample) // 16))
        self.centres = self._centres(lists) if lists > 1 else np.zeros((1, d))
        self.probes = self._probes()

    def _centres(self, lists: int) -> np.ndarray:
        centres = self.sample[:lists].copy()
        for _ in range(8):
            home = self.home(self.sample, centres)
            for c in range(lists):
                if (mine := home == c).any():
                    centres[c] = self.sample[mine].mean(axis=0)
        return centres

    def home(self, v: np.ndarray, centres: np.ndarray | None = None) -> np.ndarray:
        """The list of each vector."""
        c = self.centres if centres is None else centres
        return np.argmin((c * c).sum(axis=1)[None, :] - 2 * v @ c.T, axis=1)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists by how near their centres are, for each query."""
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")

    def _probes(self) -> int:
        """The least number of lists that holds TARGET of the k nearest of the sample's first vectors."""
        lists = len(self.centres)
        if lists == 1 or len(self.sample) < 2:
            return lists
        q = self.sample[:512]
        near = q @ self.sample.T
        near[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(self.k, len(self.sample) - 1)
        found = np.argpartition(-near, k - 1, axis=1)[:, :k]
        rank = np.empty((len(q), lists), np.int64)
        np.put_along_axis(rank, self.order(q), np.arange(lists)[None, :].repeat(len(q), 0), axis=1)
        needed = np.sort(np.take_along_axis(rank, self.home(self.sample)[found], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) + 1

    def first(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k+1 best classes of the sample for each query, their scores, and a bound that no answer is below (the query itself may be in the sample)."""
        most = min(self.k + 1, len(self.sample))
        if not most:
            return np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0)), np.full(len(q), -np.inf)
        near = q @ self.sample.T
        best = np.argpartition(-near, most - 1, axis=1)[:, :most]
        score = (q[:, None, :] * self.sample[best]).sum(axis=2)
        bound = score.min(axis=1) - 1e-9 * np.linalg.norm(q, axis=1) * self.longest if most > self.k else np.full(len(q), -np.inf)
        return self.reps[best], score, bound


class Block:
    """Vectors of one list, rotated and in blocks of columns, and the scan of queries against them."""

    def __init__(self, rotation: np.ndarray, reps: np.ndarray, smallest: np.ndarray, vectors: np.ndarray, keep: int):
        self.rotation, self.keep = rotation, keep
        order = np.lexsort((reps, smallest))  # classes by their smallest id, so that their places decide ties
        self.reps, self.vectors = reps[order], vectors[order]
        vectors = self.vectors
        turned = vectors @ rotation
        self.d = turned.shape[1]
        self.columns = [np.ascontiguousarray(turned[:, at : at + STEP]) for at in range(0, self.d, STEP)]
        self.square = (vectors * vectors).sum(axis=1)
        self.visited = 0

    def scan(self, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, class, score) of the best `keep` of each query here that may be among its best anywhere."""
        turned = queries @ self.rotation
        square, bound = (queries * queries).sum(axis=1), bound.copy()
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for low in range(0, len(self.reps), SUB):
            to = min(low + SUB, len(self.reps))
            i, j = self._survivors(turned, square, bound, low, to)
            score = (queries[i] * self.vectors[j]).sum(axis=1)
            near = score >= bound[i]
            best = tuple(np.concatenate(x) for x in zip(best, (i[near], j[near], score[near]), strict=True))
            order = np.lexsort((best[1], -best[2], best[0]))
            best = tuple(x[order] for x in best)
            place = np.arange(len(order)) - np.searchsorted(best[0], best[0])
            worst = place == self.keep - 1
            bound[best[0][worst]] = np.maximum(bound[best[0][worst]], best[2][worst])
            best = tuple(x[place < self.keep] for x in best)
        return best[0], self.reps[best[1]], best[2]

    def _survivors(self, turned: np.ndarray, square: np.ndarray, bound: np.ndarray, low: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that no test has abandoned. While many are left, whole tiles are multiplied; then single pairs."""
        # The squared distance at which a pair's inner product is the bound; one that cannot be reached ends the pair at once.
        reach = (square[:, None] + self.square[None, low:to]) * (1 + 1e-9) - 2 * bound[:, None]
        alive = reach >= 0
        part, at, i, j = np.zeros(reach.shape), 0, None, None
        for column in self.columns:
            width = column.shape[1]
            a, b = turned[:, at : at + width], column[low:to]
            at += width
            limit = (1 + EPSILON / np.sqrt(at)) ** 2 * at / self.d if at < self.d else 1.0
            self.visited += width * (np.count_nonzero(alive) if i is None else len(i))
            if i is None:
                part += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
                alive &= part <= limit * reach
                if np.count_nonzero(alive) * 8 < alive.size:
                    i, j = np.nonzero(alive)
                    part, reach = part[i, j], reach[i, j]
            else:
                gap = a[i] - b[j]
                part = part + np.einsum("ij,ij->i", gap, gap)
                keep = part <= limit * reach
                i, j, part, reach = i[keep], j[keep], part[keep], reach[keep]
        if i is None:
            i, j = np.nonzero(alive)
        return i, j + low


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _indexes(classes: DataFrame, k: int) -> dict[int, Index]:
    """An index for each length in the sample."""
    chosen = classes.select("key", "d").orderBy("key").limit(SAMPLE)
    # The sample's components are bounded before any vector comes to the driver.
    taken, used = [], 0
    for row in chosen.collect():
        if used and used + row["d"] > SAMPLE_COMPONENTS:
            break
        taken.append((row["key"],))
        used += row["d"]
    if not taken:
        return {}
    spark = classes.sparkSession
    sample = classes.join(F.broadcast(spark.createDataFrame(taken, "key string")), "key").select("key", "rep", "d", "v").orderBy("key").collect()
    by_length: dict[int, list] = {}
    for row in sample:
        by_length.setdefault(row["d"], []).append((row["rep"], np.asarray(row["v"], np.float64)))
    counts = {r["d"]: r["count"] for r in classes.where(F.col("d").isin(list(by_length))).groupBy("d").count().collect()}
    return {d: Index(d, np.array([v for _, v in rows]), [rep for rep, _ in rows], counts[d], k) for d, rows in by_length.items()}


def search(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, id, score: the k nearest found of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    small_batches(spark)
    exact = "float" if vectors.schema[column].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast(f"array<{exact}>").alias("v"))
    rows = rows.where(_valid("v") & F.col("id").isNotNull()).withColumn("key", F.sha2(F.to_json("v"), 256))
    asks = (F.col("id") % every == 0).cast("int")
    named = rows.groupBy("key").agg(F.min("id").alias("rep"), F.max(asks).alias("asks"), F.first("v").alias("v"))
    # Two classes may share their smallest id, since rows may repeat one: a class is named by a number of its own.
    classes = written(named.withColumn("smallest", F.col("rep")).withColumn("rep", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "ann-classes")
    members = rows.select("key", "id").distinct().join(classes.select("key", "rep"), "key").select("rep", "id")
    indexes = spark.sparkContext.broadcast(_indexes(classes, k))
    lost = {}

    def index_of(d: int) -> Index:
        found = indexes.value.get(d) or lost.get(d)
        if found is None:
            found = lost[d] = Index(d, np.zeros((0, d)), [], 0, k)
        return found

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                v, index = _matrix(part.column("v")), index_of(d)
                home = index.home(v)
                asking = part.column("asks").to_numpy() > 0
                probed: list = [None] * len(v)
                bound = np.full(len(v), -np.inf)
                first: list = [None] * len(v)
                if asking.any():
                    rows_asking = np.flatnonzero(asking)
                    for a in range(0, len(rows_asking), PASS):
                        some = rows_asking[a : a + PASS]
                        reps, score, bound[some] = index.first(v[some])
                        for r, order, found, scores in zip(some.tolist(), index.order(v[some])[:, : index.probes].tolist(), reps.tolist(), score.tolist(), strict=True):
                            probed[r], first[r] = order, [{"found": f, "score": x} for f, x in zip(found, scores, strict=True)]
                yield pa.RecordBatch.from_pydict({"rep": part.column("rep"), "smallest": part.column("smallest"), "d": part.column("d"), "v": part.column("v"), "home": pa.array(home, pa.int64()), "probed": pa.array(probed, pa.list_(pa.int64())), "bound": pa.array(bound), "first": pa.array(first, pa.list_(pa.struct([("found", pa.int64()), ("score", pa.float64())])))})

    placed = written(classes.select("rep", "smallest", "d", "v", "asks").mapInArrow(place, f"rep long, smallest long, d int, v array<{exact}>, home long, probed array<long>, bound double, first array<struct<found: long, score: double>>"), "ann-lists")
    visits = placed.where("probed is not null").select("d", F.explode("probed").alias("home"))
    sizes = placed.groupBy("d", "home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    lists = written(sizes.join(visits.groupBy("d", "home").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), ["d", "home"]), "ann-sizes")

    def dealt(n: str):
        return F.pmod(F.xxhash64("rep", F.lit(5)), F.col(n).cast("long")).cast("int")

    inside = placed.select("d", "home", "rep", "smallest", "v").join(lists, ["d", "home"])
    inside = inside.select("d", "home", dealt("blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("guest"), "rep", "smallest", "v", F.lit(0.0).alias("bound"))
    guests = placed.where("probed is not null").select("d", F.explode("probed").alias("home"), "rep", "smallest", "v", "bound").join(lists, ["d", "home"])
    guests = guests.select("d", "home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), dealt("chunks").alias("chunk"), F.lit(True).alias("guest"), "rep", "smallest", "v", "bound")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, homes, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("d", "home", "block", "chunk", "guest")], axis=1)
            edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part, now = batch.slice(a, b - a), tuple(keys[a, :4].tolist())
                if now != group:
                    group, homes, block = now, [], None
                v, reps = _matrix(part.column("v")), part.column("rep").to_numpy()
                if not keys[a, 4]:
                    homes.append((reps, part.column("smallest").to_numpy(), v))
                    continue
                if block is None:
                    block = Block(index_of(now[0]).rotation, *(np.concatenate(x) for x in zip(*homes, strict=True)), k + 1) if homes else False
                if not block:
                    continue
                bound = part.column("bound").to_numpy()
                for at in range(0, len(v), PASS):
                    i, found, score = block.scan(v[at : at + PASS], bound[at : at + PASS])
                    if len(i):
                        yield pa.RecordBatch.from_pydict({"query": pa.array(reps[at : at + PASS][i]), "found": pa.array(found), "score": pa.array(score)})

    work = inside.unionByName(guests).repartition(partitions(spark), "d", "home", "block", "chunk").sortWithinPartitions("d", "home", "block", "chunk", "guest")
    met = work.mapInArrow(compare, "query long, found long, score double")
    # The sample's own best are found too, so that each query has k answers whatever lists it probes.
    met = met.unionByName(placed.select(F.col("rep").alias("query"), F.inline("first")))
    met = met.groupBy("query", "found").agg(F.max("score").alias("score"))

    def best(df: DataFrame, most: int, by: list[str], then: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), then))
        return df.withColumn("rank", place).where(F.col("rank") <= most)

    # Of a class the k+1 smallest ids; tasks keep so many before they are shuffled.
    ids = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    # A class with one of the k+1 best ids has at most k classes before it, by score and smallest id.
    smallest = classes.select(F.col("rep").alias("found"), "smallest")
    near = best(met.join(smallest, "found"), k + 1, ["query"], "smallest").select("query", "score", F.col("found").alias("rep"))
    near = best(near.join(ids, "rep").select("query", "score", "rep", F.col("id").alias("vec")), k + 1, ["query"], "vec").drop("rank")
    queries = members.where(F.col("id") % every == 0).select(F.col("rep").alias("query"), F.col("id").alias("query_id"))
    out = best(queries.join(near, "query").where("vec != query_id or rep != query"), k, ["query", "query_id"], "vec")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias(id_column), "score")
