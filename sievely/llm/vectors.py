"""Embedding near-dedup by PCA-ordered, tiled comparison.

Vectors are scaled to length 1 and turned to the principal axes of a bounded sample (any rotation keeps cosines; the
sample only decides how early a comparison stops). A k-d tree over the leading axes makes tiles. A vector is at home
in one tile and a guest of each later tile that its ball - the distance at which the cosine falls to the threshold -
touches, so each near pair meets exactly once; large tiles are cut into blocks likewise. Within a tile, products of the
leading axes are summed first; the rest of a pair's product is at most the product of the two suffix norms, and pairs
whose bound is under the threshold are dropped before more axes are read. Pairs within 1e-9 of the threshold are
decided on the vectors as they were given. Only counts and the links that join groups leave a task.

Cases: vectors that are null or zero or hold null or non-finite components, or have a null id, are rows with no links; equal vectors are
one class with a count, linked with one another; vectors of different lengths are never linked. Rows that repeat a
vec_id are vectors of their own. An empty table gives no rows. Columns other than the two named are not read. There is one
plan for each length that vectors have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import partitions, small_batches, written
from .components import components

#: Vectors of the sample that sets axes and tiles; they bound the tree, whatever the table's size.
SAMPLE = 8192
#: Components of the vectors in a tile, as long as the sample can tell tiles apart; a block of a tile has up to twice as many. A visit
#: to a tile carries a whole vector, so tiles are as large as a task can hold.
TILE_COMPONENTS = 1 << 18
#: Vectors on each side of one product matrix.
SIDE = 1024
#: Axes that are added between two tests of the bound.
STEP = 16


def tile_size(d: int) -> int:
    return max(64, TILE_COMPONENTS // max(d, 1))


class Tree:
    """Axes, and a k-d tree over rotated vectors; leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, n: int, reach: float):
        self.reach = reach
        _, axes = np.linalg.eigh(sample.T @ sample)
        self.axes = axes[:, ::-1].copy()
        points = sample @ self.axes
        leaves = max(1, min(len(sample) // 4, n // tile_size(sample.shape[1])))
        self.nodes: list[tuple] = []  # (axis, cut, left, right) or (leaf,)
        self.n_leaves = 0
        self._grow(points, math.ceil(math.log2(leaves)) if leaves > 1 else 0)

    def _grow(self, points: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        spread = np.ptp(points[:, :32], axis=0) if len(points) > 1 else np.zeros(1)
        axis = int(np.argmax(spread))
        cut = float(np.median(points[:, axis])) if len(points) else 0.0
        low = points[:, axis] < cut
        if depth == 0 or not low.any() or low.all():
            self.nodes[at] = (self.n_leaves,)
            self.n_leaves += 1
            return at
        left = self._grow(points[low], depth - 1)
        right = self._grow(points[~low], depth - 1)
        self.nodes[at] = (axis, cut, left, right)
        return at

    def leaves(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows whose ball touches it, whether each is inside)."""
        stack: list[tuple] = [(0, np.arange(len(points)), np.ones(len(points), bool), {})]
        while stack:
            node, rows, inside, gaps = stack.pop()
            if not len(rows):
                continue
            spec = self.nodes[node]
            if len(spec) == 1:
                yield spec[0], rows, inside
                continue
            axis, cut, left, right = spec
            value = points[rows, axis]
            for child, is_in, gap in ((left, value < cut, np.maximum(value - cut, 0)), (right, value >= cut, np.maximum(cut - value, 0))):
                # A ball touches a box if the squared gaps of all axes stay within its radius.
                new = gaps | {axis: np.maximum(gaps[axis], gap) if axis in gaps else gap}
                total = sum(g * g for g in new.values())
                keep = total <= self.reach * self.reach
                stack.append((child, rows[keep], (inside & is_in)[keep], {a: g[keep] for a, g in new.items()}))


def near(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, cosine) of rows of a and b that reach threshold - 1e-9, a product matrix of SIDE rows each at a time."""
    for low in range(0, len(a), SIDE):
        for left in range(0, len(b), SIDE):
            i, j, found = _near(a[low : low + SIDE], b[left : left + SIDE], threshold)
            if len(i):
                yield i + low, j + left, found


def _near(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """near(), by growing prefixes of the axes."""
    d = a.shape[1]
    step = min(STEP, d)
    product = a[:, :step] @ b[:, :step].T

    def rest(x: np.ndarray, at: int) -> np.ndarray:
        return np.sqrt(np.einsum("ij,ij->i", x[:, at:], x[:, at:]))

    i, j = np.nonzero(product + rest(a, step)[:, None] * rest(b, step)[None, :] >= threshold - 1e-9)
    found, at = product[i, j], step
    while at < d and len(i):
        to = min(d, at + STEP)
        found = found + np.einsum("ij,ij->i", a[i, at:to], b[j, at:to])
        at = to
        keep = found + rest(a, at)[i] * rest(b, at)[j] >= threshold - 1e-9
        i, j, found = i[keep], j[keep], found[keep]
    return i, j, found


def _valid(column: str) -> F.Column:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(column, lambda x: x != 0)


def groups(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """id, n_links (vectors with cosine >= threshold), component_id (smallest id reachable), kept."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(_valid("v") & F.col("id").isNotNull(), F.col("v")))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json("v"), 256)))
    if rows.where("v is not null").groupBy("id").count().where("count > 1").isEmpty():
        out = _groups(written(rows, "vectors"), threshold)
    else:
        # Numbers of their own for the rows, in the order of their ids.
        placed = written(rows.orderBy("id", "key").withColumn("place", F.monotonically_increasing_id()), "vectors")
        found = _groups(placed.select(F.col("place").alias("id"), "v", "key"), threshold).toDF("place", "n_links", "root")
        names = placed.select("place", "id")
        out = found.join(names, "place").join(names.toDF("root", "component_id"), "root").select("id", "n_links", "component_id")
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _groups(rows: DataFrame, threshold: float) -> DataFrame:
    """id, n_links, component_id of rows (id, v, key) in which vectors have ids of their own."""
    classes = written(rows.where("v is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("d", F.size("v")), "vector-classes")
    links = None
    for found in classes.groupBy("d").agg(F.count("*").alias("n")).collect():
        part = _links(classes.where(F.col("d") == found["d"]).select("rep", "n", "v"), found["n"], threshold)
        links = part if links is None else links.unionByName(part)
    if links is None:
        links = rows.sparkSession.createDataFrame([], "rep long, met long, root long")
    links = written(links, "vector-links")
    joined = components(links.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    met = links.groupBy("rep").agg(F.sum("met").alias("met"))
    by_class = classes.select("key", "rep", "n").join(met, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select("key", (F.col("n") - 1 + F.coalesce("met", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", "key").join(by_class, "key", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def _links(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """rep, met (other vectors it is linked with, in one tile), root (smallest rep of its group there); vectors of one length."""
    spark = classes.sparkSession
    sample = classes.select("v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toPandas()["v"]
    unit = np.array([np.asarray(x, np.float64) for x in sample])
    unit /= np.abs(unit).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tree = spark.sparkContext.broadcast(Tree(unit, n, math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("v")
            v = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            found = list(t.leaves(v @ t.axes))
            home = np.zeros(batch.num_rows, np.int64)
            for leaf, rows, inside in found:
                home[rows[inside]] = leaf
            tiles = [[] for _ in range(batch.num_rows)]
            for leaf, rows, _ in found:
                for r in rows[home[rows] < leaf].tolist():
                    tiles[r].append(leaf)
            yield pa.RecordBatch.from_pydict({"rep": batch.column("rep"), "n": batch.column("n"), "v": column, "home": home, "visits": pa.array(tiles, pa.list_(pa.int64()))})

    small_batches(spark)
    placed = written(classes.mapInArrow(place, "rep long, n long, v array<double>, home long, visits array<long>"), "vector-tiles")
    sizes = placed.groupBy("home").agg(F.count("*").alias("size"))
    blocks = written(sizes.select(F.col("home").alias("tile"), F.ceil(F.col("size") / (2 * tile_size(unit.shape[1]))).cast("int").alias("blocks")), "vector-blocks")
    own = placed.join(blocks.withColumnRenamed("tile", "home"), "home").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks").cast("long")).cast("int"))
    at_home = own.select(F.col("home").alias("tile"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("block"), "own", "rep", "n", "v")
    at_home = at_home.select("tile", "block", (F.col("own") != F.col("block")).alias("guest"), "rep", "n", "v")
    visits = placed.select(F.explode("visits").alias("tile"), "rep", "n", "v").join(blocks, "tile")
    visits = visits.select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("guest"), "rep", "n", "v")
    rows = at_home.unionByName(visits)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        block: _Block | None = None
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tiles, numbers, guests = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "block", "guest"))
            change = np.flatnonzero(np.concatenate(([True], (tiles[1:] != tiles[:-1]) | (numbers[1:] != numbers[:-1]) | (guests[1:] != guests[:-1]))))
            for a, b in zip(change, [*change[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if (tiles[a], numbers[a]) != key:
                    if block is not None:
                        yield from block.done()
                    key, block = (tiles[a], numbers[a]), _Block(t.axes, threshold)
                block.add(part, bool(guests[a]))
        if block is not None:
            yield from block.done()

    n_parts = partitions(spark)
    return rows.repartition(n_parts, "tile", "block").sortWithinPartitions("tile", "block", "guest").mapInArrow(compare, "rep long, met long, root long")


class _Block:
    """A block's vectors at home, against one another and then against guests as they come."""

    def __init__(self, axes: np.ndarray, threshold: float):
        self.axes, self.threshold = axes, threshold
        self.homes: list[tuple] = []
        self.guests: list[tuple] = []
        self.home: tuple | None = None
        self.met: dict[int, int] = {}
        self.parent: dict[int, int] = {}

    def _read(self, part: pa.RecordBatch) -> tuple:
        v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        unit = v / np.abs(v).max(axis=1, keepdims=True)
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        return part.column("rep").to_numpy(), part.column("n").to_numpy(), v, unit @ self.axes

    def _top(self, x: int) -> int:
        p = self.parent
        while p.setdefault(x, x) != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def _take(self, a: tuple, b: tuple, same: bool) -> None:
        for i, j, cosine in near(a[3], b[3], self.threshold):
            if same:
                keep = i < j
                i, j, cosine = i[keep], j[keep], cosine[keep]
            self._link(a, b, i, j, cosine)

    def _link(self, a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> None:
        close = np.abs(cosine - self.threshold) <= 1e-9
        if close.any():
            x, y = a[2][i[close]], b[2][j[close]]
            cosine[close] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
        keep = cosine >= self.threshold
        i, j = i[keep], j[keep]
        for x, y, side, other in ((a, b, i, j), (b, a, j, i)):
            count = np.bincount(side, y[1][other], minlength=len(x[0]))
            for k in np.flatnonzero(count).tolist():
                self.met[int(x[0][k])] = self.met.get(int(x[0][k]), 0) + int(count[k])
        # Of each row's partners one for each other group is enough.
        for p, q in zip(a[0][i].tolist(), b[0][j].tolist(), strict=True):
            p, q = self._top(p), self._top(q)
            if p != q:
                self.parent[max(p, q)] = min(p, q)

    def add(self, part: pa.RecordBatch, guest: bool) -> None:
        if not guest:
            self.homes.append(self._read(part))
            return
        if self.home is None:
            self._settle()
        if self.home:
            self.guests.append(self._read(part))
            if sum(len(g[0]) for g in self.guests) >= SIDE:
                self._receive()

    def _receive(self) -> None:
        if self.guests:
            self._take(self.home, tuple(np.concatenate(x) for x in zip(*self.guests, strict=True)), False)
            self.guests = []

    def _settle(self) -> None:
        self.home = tuple(np.concatenate(x) for x in zip(*self.homes, strict=True)) if self.homes else ()
        if self.home:
            self._take(self.home, self.home, True)

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.home is None:
            self._settle()
        self._receive()
        ids = sorted(self.met)
        if ids:
            yield pa.RecordBatch.from_pydict({"rep": pa.array(ids, pa.int64()), "met": pa.array([self.met[x] for x in ids], pa.int64()), "root": pa.array([self._top(x) for x in ids], pa.int64())})
