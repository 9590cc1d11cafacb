"""Answers to files: scores, confidence and keep of each file, its rank, and what the filter took away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import GATE
from .scoring import LEVELS, block_array, line_array

KEY = ["query_idx", "path"]


def measures() -> list[Column]:
    """Of a file's scored chunks: score (best section that passes the filter), confidence (its; ties: the last section), keep (mean)."""
    passes = F.col("section_keep") >= GATE
    best = F.struct("score", "start")
    return [
        F.coalesce(F.max(F.when(passes, F.col("score") / (LEVELS - 1))), F.lit(0.0)).alias("score"),
        F.coalesce(F.max_by(F.when(passes, F.col("confidence")), F.when(passes, best)), F.lit(0.0)).alias("confidence"),
        F.avg("section_keep").alias("keep"),
    ]


def fold_files(scored: DataFrame) -> DataFrame:
    """query_idx, path, score, confidence, keep."""
    return scored.groupBy(*KEY).agg(*measures())


def rank_of(score: Column, evidence: Column) -> Column:
    return F.greatest(score, evidence) + 0.25 * F.least(score, evidence)


def rank_files(scored: DataFrame) -> DataFrame:
    """query_idx, path, score, confidence, keep, evidence (best line or block, 0 at least), rank of scored chunks by one grouping; best first, then by path."""
    best = lambda hits: F.array_max(F.transform(hits, lambda z: z["p"]))
    rows = scored.withColumn("evidence", F.greatest(best(line_array()), best(block_array())))
    out = rows.groupBy(*KEY).agg(*measures(), F.coalesce(F.max("evidence"), F.lit(0.0)).alias("evidence"))
    return out.withColumn("rank", rank_of(F.col("score"), F.col("evidence"))).orderBy("query_idx", F.desc("rank"), "path")


def filtered_out(lines: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """Per query how many blocks and lines matched but did not pass the filter."""
    gone = (F.col("p") >= threshold) & (F.col("keep") < GATE)
    rows = blocks.select("query_idx", F.lit(1).alias("b"), F.lit(0).alias("l"), gone.alias("gone")).unionByName(lines.select("query_idx", F.lit(0).alias("b"), F.lit(1).alias("l"), gone.alias("gone")))
    hit = F.col("gone").cast("int")
    return rows.groupBy("query_idx").agg(F.sum(F.col("b") * hit).alias("regions"), F.sum(F.col("l") * hit).alias("lines"))


def triage(paths: DataFrame, scores: DataFrame, threshold: float = 0.2, most: int = 1500) -> DataFrame:
    """paths (path, ord) whose score (1 if it has none) reaches the threshold: the best, in their order on ties."""
    out = paths.join(scores, "path", "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    return out.where(F.col("p") >= threshold).orderBy(F.desc("p"), "ord").limit(most)


def usage(scored: DataFrame, price: float = 0.042) -> DataFrame:
    """Requests, tokens and cost (price per million input tokens): one request per chunk, whatever the number of queries."""
    from .scoring import INPUT_TOKENS, OUTPUT_TOKENS

    requests = scored.where("query_idx = 0").agg(F.count("*").alias("requests"))
    tokens = (F.col("requests") * INPUT_TOKENS).alias("input_tokens"), (F.col("requests") * OUTPUT_TOKENS).alias("output_tokens")
    return requests.select("requests", *tokens, (F.col("requests") * INPUT_TOKENS * price / 1e6).alias("cost"))


def usage_of(answers: DataFrame, price: float = 0.042) -> DataFrame:
    """Of answer rows: requests, retries and tokens as the service reported them, cost by price, reported_cost (null if never reported), tier (one, or mixed)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requests", "retries", "input_tokens", "output_tokens")]
    tier = F.when(F.count_distinct("tier") > 1, F.lit("mixed")).otherwise(F.max("tier"))
    return answers.agg(*sums, F.sum("reported_cost").alias("reported_cost"), tier.alias("tier")).withColumn("cost", F.col("input_tokens") * price / 1e6)
