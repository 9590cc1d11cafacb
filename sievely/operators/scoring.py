"""The deterministic lexical backend as Columns: what a query's words hit, and the labels of what they hit.

A line is hot if it holds one of the query's words. Hot lines have 0.95, others 0.02; blocks with a hot line 0.9, others
0.03; a section whose listing has a hot line scores 3 of 3, others 0, with confidence 0.9. A filter category applies
with 0.9 where one of its words stands, and with 0.03 elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .filters import Rules

HOT_LINE, COLD_LINE, HOT_BLOCK, COLD_BLOCK, HOT_SECTION, CONFIDENCE = 0.95, 0.02, 0.9, 0.03, 3.0, 0.9
LEVELS = 4
#: Tokens that a request reports.
INPUT_TOKENS, OUTPUT_TOKENS = 100, 10


@dataclass
class Search:
    """queries: the words of each; rules with the words of each of their terms."""

    queries: list[list[str]]
    rules: Rules = field(default_factory=Rules)
    term_words: dict[str, list[str]] = field(default_factory=dict)


def _holds(line: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(line, F.lit(w))
    return hit


def score_chunks(chunks: DataFrame, search: Search) -> DataFrame:
    """A row per query and chunk: query_idx, the chunk, hot array<int> (line numbers), score, confidence, section_keep, block_keeps."""
    numbered = F.transform("lines", lambda x, i: F.struct((F.col("ctx_start") + i).alias("n"), x.alias("text")))
    df = chunks.withColumn("numbered", numbered)
    for k, term in enumerate(search.rules.terms()):
        words = search.term_words.get(term, [term])
        df = df.withColumn(f"term{k}", F.transform(_lines_with(words), lambda x: x["n"]))
    terms = search.rules.terms()
    section = {t: F.when(F.size(f"term{k}") > 0, F.lit(0.9)).otherwise(F.lit(0.03)) for k, t in enumerate(terms)}

    def of_block(b: Column) -> dict[str, Column]:
        return {t: F.greatest(section[t], F.when(_any_in(f"term{k}", b), F.lit(0.9)).otherwise(F.lit(0.03))) for k, t in enumerate(terms)}

    df = df.withColumn("section_keep", search.rules.passes_column(section)).withColumn("block_keeps", F.transform("blocks", lambda b: search.rules.passes_column(of_block(b))))
    hot = F.array(*[F.struct(F.lit(i).alias("query_idx"), F.transform(_lines_with(words), lambda x: x["n"]).alias("hot")) for i, words in enumerate(search.queries)])
    df = df.withColumn("q", F.explode(hot)).select("path", "q.query_idx", "ctx_start", "start", "end", "blocks", "lines", "q.hot", "section_keep", "block_keeps")
    return df.withColumn("score", F.when(F.size("hot") > 0, F.lit(HOT_SECTION)).otherwise(F.lit(0.0))).withColumn("confidence", F.lit(CONFIDENCE))


def _lines_with(words: list[str]) -> Column:
    return F.filter("numbered", lambda x: _holds(x["text"], words))


def _any_in(numbers: str | Column, b: Column) -> Column:
    return F.exists(numbers, lambda n: (n >= b["start"]) & (n <= b["end"]))


def kept_blocks() -> Column:
    """A chunk's blocks with their keep: array<struct<b, k>>."""
    return F.arrays_zip(F.col("blocks").alias("b"), F.col("block_keeps").alias("k"))


def line_struct(n: Column, p: Column) -> Column:
    """struct<line, p, text, section, keep> of a line of a scored chunk; it inherits the keep of its block, else of the section."""
    keep = F.get(F.filter(kept_blocks(), lambda z: (z["b"]["start"] <= n) & (n <= z["b"]["end"])), F.lit(0))["k"]
    return F.struct(n.cast("int").alias("line"), p.alias("p"), F.get("lines", n - F.col("ctx_start")).alias("text"), (F.col("score") / (LEVELS - 1)).alias("section"), F.coalesce(keep, F.col("section_keep")).alias("keep"))


def line_array(least: float = 0.0) -> Column:
    """Of a scored chunk: line_struct() of the lines worth a question with p >= least."""
    inside = lambda n: (n >= F.col("start")) & (n <= F.col("end"))
    numbers = F.filter("hot", inside) if least > COLD_LINE else F.sequence("start", "end")
    p = lambda n: F.when(F.array_contains("hot", n), F.lit(HOT_LINE)).otherwise(F.lit(COLD_LINE))
    return F.filter(F.transform(numbers, lambda n: line_struct(n, p(n))), lambda z: tx.askable(z["text"]) & (z["p"] >= least))


def line_hits(scored: DataFrame) -> DataFrame:
    """query_idx, path, line, p, text, section, keep of every line worth a question."""
    return scored.select("query_idx", "path", F.explode(line_array()).alias("z")).select("query_idx", "path", "z.*")


def block_label(lines: Column) -> Column:
    """The line that names a block: a definition among its first six lines with a letter or digit, else the first of those."""
    real = F.slice(F.filter(lines, tx.meaningful), 1, 6)
    return F.coalesce(F.get(F.filter(real, tx.is_definition), F.lit(0)), F.get(real, F.lit(0)), F.lit(""))


def _owner(before: Column, label: Column) -> Column:
    """The definition that encloses the label: upwards through lines of ever smaller indent, the first that is one."""
    none = F.struct(tx.indent(label).alias("depth"), F.lit(None).cast("string").alias("owner"))

    def step(acc: Column, x: Column) -> Column:
        nearer = acc["owner"].isNull() & ~tx.blank(x) & (tx.indent(x) < acc["depth"])
        return F.when(nearer, F.struct(tx.indent(x).alias("depth"), F.when(tx.is_definition(x), x).alias("owner"))).otherwise(acc)

    return F.aggregate(F.reverse(before), none, step, lambda acc: acc["owner"])


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def block_array(least: float = 0.0) -> Column:
    """Of a scored chunk: block_structs() of the blocks with p >= least."""
    p = lambda z: F.when(_any_in("hot", z["b"]), F.lit(HOT_BLOCK)).otherwise(F.lit(COLD_BLOCK))
    blocks = F.transform(kept_blocks(), lambda z: F.struct(z["b"]["start"].alias("start"), z["b"]["end"].alias("end"), p(z).alias("p"), z["k"].alias("keep")))
    return block_structs(F.filter(blocks, lambda z: z["p"] >= least))


def block_structs(blocks: Column) -> Column:
    """array<struct<start, end, p, label, label_line, keep>> of blocks (start, end, p, keep) of a chunk."""
    before = F.col("ctx_start")
    owned = lambda z: F.slice("lines", z["start"] - before + 1, z["end"] - z["start"] + 1)
    named = F.transform(blocks, lambda z: F.struct(z.alias("z"), owned(z).alias("own"), block_label(owned(z)).alias("raw")))

    def of(x: Column) -> Column:
        raw, start = x["raw"], x["z"]["start"]
        owner = _trim(F.when((raw == "") | tx.is_definition(raw), F.lit(None)).otherwise(_owner(F.slice("lines", F.lit(1), start - before), raw)))
        short = F.when(F.length(owner) > 60, F.concat(F.substring(owner, 1, 57), F.lit("..."))).otherwise(owner)
        at = start + F.greatest(F.array_position(x["own"], raw).cast("int") - 1, F.lit(0))
        return F.struct(x["z"]["start"].alias("start"), x["z"]["end"].alias("end"), x["z"]["p"].alias("p"), F.coalesce(F.concat(short, F.lit(" > "), _trim(raw)), _trim(raw)).alias("label"), at.cast("int").alias("label_line"), x["z"]["keep"].alias("keep"))

    return F.transform(named, of)


def block_hits(scored: DataFrame) -> DataFrame:
    """query_idx, path, start, end, p, label, label_line, keep of every block."""
    return scored.select("query_idx", "path", F.explode(block_array()).alias("z")).select("query_idx", "path", "z.*")
