"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt into blocks by a hash and the blocks are permuted by another. A source's target in words
is met by a quota of block draws: whole passes over the permutation and, for the rest, its first blocks; the block that
is drawn last is cut at the word. The quotas of all sources are split among the output shards by a binary tree: each
node draws, without replacement, how many of its blocks of each source go left (a multivariate hypergeometric draw with a
seed of its own), so quotas stay exact. A shard's quota of a source is the next disjoint run of the permutation: the
runs decide which blocks are drawn, by which shards, and so what is taken of a document. draw() gives each shard's
documents to tasks of its own and shuffles them there.

Blocks hold BLOCK_DOCS documents on average, more where the table would else have over MOST_BLOCKS blocks (and each source
has one): so the table of blocks has a bound at any size. It is broadcast, and texts are shuffled once, to their shards.
Per source and shard the driver holds a few numbers.

Cases: null text has size 0; null is a source of its own and comes last; equal rows share a block; of those where
the cut falls any one is cut, and draw() gives all of them; sources of size 0 have target 0. An empty table gives no rows. Columns other than doc_id, text and
source are not read by mix(); draw() keeps all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, written

#: The contract's weights by source in turn, the share of all words, the most repeats of a source.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Documents in a block on average, at least; blocks of a mix, besides one for each source; shards of a mix.
BLOCK_DOCS, MOST_BLOCKS, SHARDS = 256, 1 << 16, 64
#: Words that a task shuffles, about; a shard with more is written by several tasks.
TASK_WORDS = 8_000_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> dict[str | None, float]:
    """Words per source: by weight, at most cap times the source's size, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        if not above:
            return out | {s: unit * weight[s] for s in open_}
        for s in above:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
        left = max(left, 0.0)
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """[shards, sources]: how many blocks of each source each shard takes; columns sum to quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def halve(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid, total = (lo + hi) // 2, int(counts.sum())
        left = total * (mid - lo) // (hi - lo)
        taken = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, left, method="marginals")
        halve(taken, lo, mid)
        halve(counts - taken, mid, hi)

    halve(np.asarray(quotas, np.int64), 0, shards)
    return out


def _number(*parts: Column | str | int) -> Column:
    """A number of 60 bits from the parts, for SQL to repeat: the first 15 hex digits of the MD5 of the parts, joined by colons, without nulls."""
    text = F.concat_ws(":", *(F.lit(str(p)) if isinstance(p, int) else F.col(p).cast("string") if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _with(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """df with the other columns of a table of bounded size (sources, or blocks); keys may be null."""
    renamed = table.select(*(F.col(c).alias(f"t_{c}") for c in table.columns))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"t_{k}"))
    return df.join(F.broadcast(renamed), same).select(*df.columns, *(F.col(f"t_{c}").alias(c) for c in table.columns if c not in keys))


@dataclass
class Mix:
    """What is drawn of whom. plan: a row per source; placed: a row per block, drawn_by the shards that draw it, whether its last draw is
    cut; sized: doc_id, source, size of the documents."""

    sized: DataFrame
    plan: DataFrame
    placed: DataFrame
    seed: int

    def dealt(self, rows: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
        """rows with their source's and their block's columns, by broadcast: both tables are bounded."""
        rows = _with(rows, self.plan, source).withColumn("block", F.pmod(_number(self.seed, doc_id), "blocks"))
        return _with(rows, self.placed, source, "block")

    def order(self, doc_id: str = "doc_id") -> Column:
        """Where a document stands in its block."""
        return _number(self.seed + 2, doc_id)

    def cut(self) -> DataFrame:
        """The sized documents of blocks that are cut, with part: the words of the last draw. At most a block of each source."""
        each = self.dealt(self.sized).where("cut").withColumn("order", self.order())
        inside = Window.partitionBy("source", "block").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
        return each.withColumn("part", F.greatest(F.lit(0), F.least(left, F.col("size"))))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, shards: int = SHARDS, seed: int = 7) -> Mix | None:
    """None if there are no documents."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")), "mix-sizes")
    per = {r["source"]: (r["words"], r["docs"]) for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()}
    if not per:
        return None
    goal = targets({s: w for s, (w, _) in per.items()}, weights, share, cap)
    in_block = max(BLOCK_DOCS, -(-sum(n for _, n in per.values()) // MOST_BLOCKS))
    rows = []
    for s, (words, n) in per.items():
        passes = min(cap, int(goal[s] // words)) if words else 0
        rest = min(int(goal[s] - passes * words + 0.5), words) if passes < cap else 0
        rows.append((s, words, goal[s], passes, rest, -(-n // in_block)))
    plan = spark.createDataFrame(rows, "source string, source_size long, target double, passes int, rest long, blocks long")
    dealt = _with(sized, plan, "source").withColumn("block", F.pmod(_number(seed, "doc_id"), "blocks"))
    by_block = dealt.groupBy("source", "block", "rest", "passes").agg(F.sum("size").alias("words")).withColumn("spot", _number(seed + 1, "source", "block"))
    order = Window.partitionBy("source").orderBy("spot", "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = written(by_block.withColumn("rank", F.row_number().over(order) - 1).withColumn("before", before), "mix-blocks")
    counts = ranked.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("before") < F.col("rest")).alias("more"), F.first("passes").alias("passes")).collect()
    counts = sorted(counts, key=lambda r: (r["source"] is None, r["source"] or ""))
    quota = {r["source"]: r["n"] * r["passes"] + r["more"] for r in counts}
    ends = np.cumsum(split_quotas(np.array([quota[r["source"]] for r in counts]), shards, seed), axis=0)
    runs = spark.createDataFrame([(r["source"], r["n"], quota[r["source"]], ends[:, k].tolist()) for k, r in enumerate(counts)], "source string, n_blocks long, quota long, ends array<long>")
    # The draws of a block are those with its rank's number in each pass, as far as the quota goes; the run that holds the number is the shard's.
    numbers = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: F.col("rank") + k * F.col("n_blocks")), lambda x: x < F.col("quota"))
    drawn_by = F.transform(numbers, lambda x: F.size(F.filter("ends", lambda e: e <= x)).cast("int"))
    last = F.coalesce(F.array_max(numbers) == F.col("quota") - 1, F.lit(False)) & (F.col("rest") > F.col("before")) & (F.col("rest") < F.col("before") + F.col("words"))
    placed = _with(ranked, runs, "source").select("source", "block", "before", drawn_by.alias("drawn_by"), last.alias("cut"))
    return Mix(sized, plan, written(placed, "mix-placed"), seed)


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, taken, shards (one for each time it is drawn). Options: plan_mix()."""
    found = plan_mix(docs, **options)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, size long, source string, source_size long, target double, taken long, shards array<int>")
    cut = found.cut().withColumn("shards", F.when(F.col("part") > 0, F.col("drawn_by")).otherwise(F.slice("drawn_by", F.lit(1), F.size("drawn_by") - 1)))
    whole = found.dealt(found.sized).where("not cut").withColumn("part", F.when(F.size("drawn_by") > 0, F.col("size")).otherwise(0)).withColumn("shards", F.col("drawn_by"))
    columns = ["doc_id", "size", "source", "source_size", "target", "drawn_by", "part", "shards"]
    drawn = whole.select(*columns).unionByName(cut.select(*columns)).withColumn("taken", F.greatest(F.lit(0), F.size("drawn_by") - 1) * F.col("size") + F.col("part"))
    return drawn.select("doc_id", "size", "source", "source_size", "target", F.col("taken").cast("long").alias("taken"), "shards")


def draw(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """The mix itself: a row for each time a document is drawn (one taken in part is given whole), shard by shard, shuffled within each.

    Keeps the columns of docs, then shard and place, the number that orders a shard (with underscores before them where docs has such
    columns). A shard is one run of tasks, of about TASK_WORDS words each. Documents without words are drawn as often as their block.
    """
    names = docs.columns
    shard, place = fresh(names, "shard", "place")
    found = plan_mix(docs, shards=shards, **options)
    if found is None:
        return docs.select("*", F.lit(None).cast("int").alias(shard), F.lit(None).cast("long").alias(place)).limit(0)
    words = sum(r["target"] for r in found.plan.select("target").collect())
    tasks = max(1, -(-int(words) // (shards * TASK_WORDS)))
    # The last document that each cut block still gives: a row per source.
    ends = found.cut().where("part > 0").groupBy("source").agg(F.max(F.struct("order", "doc_id")).alias("end"))
    held = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.struct(*names).alias("held"), F.monotonically_increasing_id().alias("row"))
    each = found.dealt(held).withColumn("order", found.order())
    each = _with(each, found.plan.select("source").join(F.broadcast(ends.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "end"), "source")
    stays = ~F.col("cut") | F.coalesce(F.struct("order", "doc_id") <= F.col("end"), F.lit(False))
    by = F.when(stays, F.col("drawn_by")).otherwise(F.slice("drawn_by", F.lit(1), F.greatest(F.size("drawn_by") - 1, F.lit(0))))
    rows = each.select("held", "row", "doc_id", F.posexplode(by).alias("time", "by"))
    rows = rows.withColumn("to", (F.col("by") * tasks + F.pmod("row", F.lit(tasks))).cast("int")).withColumn("at", F.xxhash64(F.lit(found.seed + 3), "doc_id", "time"))
    rows = rows.repartitionById(shards * tasks, "to").sortWithinPartitions("at", "row", "time")
    return rows.select("held.*", F.col("by").alias(shard), F.col("at").alias(place))
