"""Corpora made of the tables: documents as files, as they are or reshaped to look like code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import dealt

#: One SQL expression for both engines: paragraphs become functions, sentences their lines.
CODE_LIKE = (
    "concat('def part():', chr(10), '    ', replace(replace(replace(text, chr(10), chr(1)), '. ', concat('.', chr(10), '    ')), "
    "chr(1), concat(chr(10), chr(10), 'def part():', chr(10), '    ')))"
)
PATH = "concat(lang, '/', source, '/doc_', doc_id, '.txt')"


def files(spark: SparkSession, sf_dir: str, code_like: bool = True) -> DataFrame:
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "doc_id", "text"))
    return docs.select(F.expr(PATH).alias("path"), F.expr(CODE_LIKE if code_like else "text").alias("text"))
