"""Filters in front of joins: no key is lost, and texts that no join needs are not shuffled."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import documents, words

from sievely.llm import _common, minhash


@pytest.mark.parametrize("most", [2048, 1])
@pytest.mark.parametrize("n", [0, 1, 5000])
def test_split_by_loses_no_key(spark, monkeypatch, n, most):
    monkeypatch.setattr(_common, "MOST_BITMAPS", most)
    rows = spark.range(-5000, 15000).select("id", F.lit(1).alias("bucket")).unionByName(spark.sql("select cast(null as bigint) id, 2 bucket from range(5)"))
    maybe, others = _common.split_by(rows, "id", spark.range(n).select((F.col("id") * 2).alias("key")))
    maybe, others = [r["id"] for r in maybe.collect()], [r["id"] for r in others.collect()]
    keys = {2 * k for k in range(n)}
    assert keys <= set(maybe) and others.count(None) == 5 and None not in maybe
    assert sorted(maybe + [k for k in others if k is not None]) == list(range(-5000, 15000))
    assert len(maybe) - n < (0.2 if most == 1 else 0.05) * 20000


def shuffled(spark, act):
    """Bytes that act() writes for shuffles."""
    sc = spark._jsc.sc()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, none, None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = stages()
    act()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("copies", [10, 300])
def test_dedup_shuffles_few_texts(spark, tmp_path, copies):
    """Tables too large for a broadcast: of the texts only those of near copies are shuffled; where most are copies, only those that stay."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(40_000)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, texts[0] if copies > 60 else texts[k] + " end") for k in range(copies)] + [(None, texts[1]), (None, None), (99, "")]
    path = f"{tmp_path}/documents.parquet"
    documents(spark, rows).repartition(3).write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = []
        judged = shuffled(spark, lambda: got.extend(minhash.dedup(spark.read.parquet(path)).select("doc_id").collect()))
        moved = shuffled(spark, lambda: minhash.dedup(spark.read.parquet(path)).write.parquet(f"{tmp_path}/out"))
        whole = shuffled(spark, lambda: spark.read.parquet(path).repartition(2, "doc_id").write.parquet(f"{tmp_path}/whole"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r["doc_id"] for r in got), key=lambda x: (x is None, x or 0)) == [*range(60), 99, None, None]
    # Without the texts of the result, and with them.
    assert judged < whole and moved - judged < whole / 4
