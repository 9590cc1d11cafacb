"""The answer ledger: a table of what a service has answered, by the hash of each request, so that nothing is asked twice.

Requests that the table lacks are asked and appended as one written job before anything reads their answers. What is read
afterwards comes from the table: a lost executor, an evicted block or a second action repeats reading, never asking. If a
job fails, its committed rows stay and only the rest is asked again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Errors that a request will meet again, so that it need not be asked again.
LASTING = "token_limit"


class Ledger:
    """A Parquet table at `path`: request, run, and the columns that asking gives (with error_kind)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"

    def rows(self) -> DataFrame | None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return self.spark.read.parquet(self.path)

    def answered(self, requests: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """requests (request, ..) with their answers; failures of this call are rows with their error, those of earlier ones are asked again."""
        run, new = uuid.uuid4().hex, requests.dropDuplicates(["request"])
        settled = F.col("error_kind").isNull() | (F.col("error_kind") == LASTING)
        if (known := self.rows()) is not None:
            new = new.join(known.where(settled).select("request").distinct(), "request", "left_anti")
        ask(new).withColumn("run", F.lit(run)).write.mode("append").parquet(self.path)
        # Two runs at a time may both have asked; either answer will do.
        told = self.rows().where(settled | (F.col("run") == run)).drop("run").dropDuplicates(["request"])
        return requests.join(told, "request")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="sievely-")
