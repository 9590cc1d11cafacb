"""Search over files as they arrive: per-file stages are stateless, so a micro-batch runs the plan of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import scoring, segment


def text_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """path, text of new Parquet rows (path string, text string) below folder."""
    return spark.readStream.schema("path string, text string").option("maxFilesPerTrigger", per_trigger).parquet(folder)


def score_stream(files: DataFrame, search: scoring.Search, cfg: segment.Chunking = segment.Chunking()) -> DataFrame:
    """Block hits of each arriving file; no state and no watermark, append mode."""
    return scoring.block_hits(scoring.score_chunks(segment.chunk_files(files, cfg), search))


def write_hits(hits: DataFrame, table: str, checkpoint: str, threshold: float = 0.5) -> StreamingQuery:
    """Appends hits at the threshold as Parquet; a batch that runs again replaces nothing and adds nothing (file sink)."""
    return hits.where(hits["p"] >= threshold).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
