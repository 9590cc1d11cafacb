"""Connected components of a link table, without collecting it: alternating large-star and small-star rounds.

Each round joins every node to the smallest of its neighbours and itself; a hub's neighbours are handled as rows,
not as a list, so a hub is no larger a task than others. Rounds end when the table no longer changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for every node in links (a, b); nodes with no link are left out."""
    state = None
    table = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    while True:
        found = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (found["n"], found["s"]) == state:
            return table.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = (found["n"], found["s"])
        if not found["n"]:
            continue
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        table = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
