"""What is shown: regions, lines and files under the display rules.

A row is shown on its own probability; a line is shown once; a file is shown with a row at least; a relevant file in
which nothing reached the threshold goes to the weak tier with its near misses; what the filter drops is gone first.
Sections, blocks and lines of a file are rows of one stream, dealt once by query and file; every rule is a window over
that partitioning, so that no file is ever held in one row. What is collected is bounded by the display limits, and of
files each task keeps the `top` best before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import scoring
from .filters import GATE
from .fold import KEY

WEAK_RATIO, WEAK_REGIONS, WEAK_FILES = 0.7, 2, 5


@dataclass(frozen=True)
class Limits:
    threshold: float = 0.5
    file_threshold: float = 0.6
    top: int = 15
    max_regions: int = 5
    max_lines: int = 10


SECTION, BLOCK, LINE = 2, 0, 1


def _file() -> WindowSpec:
    return Window.partitionBy(*KEY)


def _regions(rows: DataFrame, member: Column) -> DataFrame:
    """rows (KEY, kind, start, end, p, label, label_line) with the region that they belong to.

    Blocks that are members and at most one line apart are one region: r_start, r_end, its best p as r_p, and the label of
    its first block. `head` is that block; `inside` tells whether a row stands within the region.
    """
    order = _file().orderBy("start", "kind", "end")
    reach = F.max(F.when(member, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("member", member).withColumn("reach", reach)
    rows = rows.withColumn("head", F.col("member") & (F.col("reach").isNull() | (F.col("start") > F.col("reach") + 2)))
    rows = rows.withColumn("island", F.sum(F.col("head").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    island, mine = Window.partitionBy(*KEY, "island"), F.col("member")
    named = {"r_start": F.min(F.when(mine, F.col("start"))), "r_end": F.max(F.when(mine, F.col("end"))), "r_p": F.max(F.when(mine, F.col("p")))}
    named |= {f"r_{c}": F.max(F.when(F.col("head"), F.col(c))) for c in ("label", "label_line")}
    return rows.withColumns({c: f.over(island) for c, f in named.items()}).withColumn("inside", F.coalesce(F.col("member") | (F.col("reach") >= F.col("start")), F.lit(False)))


def merge_regions(blocks: DataFrame) -> DataFrame:
    """Blocks at most one line apart as one region: KEY, start, end, p (best), label, label_line (of the first block)."""
    heads = _regions(blocks.withColumn("kind", F.lit(BLOCK)), F.lit(True)).where("head")
    return heads.select(*KEY, *(F.col(f"r_{c}").alias(c) for c in ("start", "end", "p", "label", "label_line")))


@dataclass
class Selection:
    """views: every file with something to show, with its regions and lines; shown: the best of them per query, with their place."""

    views: DataFrame
    shown: DataFrame

    @property
    def files(self) -> DataFrame:
        return self.shown.drop("regions", "lines")

    @property
    def regions(self) -> DataFrame:
        """Kept regions of all views: KEY, start, end, p, label, label_line."""
        return self.views.select(*KEY, F.explode("regions").alias("r")).select(*KEY, "r.*")

    @property
    def lines(self) -> DataFrame:
        """Shown lines of all views: KEY, line, p, text, section, region (start of the region that holds it, or null)."""
        return self.views.select(*KEY, F.explode("lines").alias("h")).select(*KEY, "h.*")


def _views(rows: DataFrame, lim: Limits) -> DataFrame:
    """rows: KEY, kind; of sections start, score, confidence; of blocks start, end, p, label, label_line; of lines start, end (both its number), p, label (its text), section."""
    kind, p = F.col("kind"), F.col("p")
    section = F.max_by(F.struct("score", "confidence"), F.when(F.col("score").isNotNull(), F.struct("score", "start"))).over(_file())
    rows = rows.withColumns({"best": section, "strong": F.count_if((kind != SECTION) & (p >= lim.threshold)).over(_file())})
    rows = rows.withColumns({"file_score": F.coalesce("best.score", F.lit(0.0)), "file_confidence": F.coalesce("best.confidence", F.lit(0.0))})
    rows = rows.withColumn("weak", (F.col("strong") == 0) & (F.col("file_score") >= lim.file_threshold))
    # Near misses count only where nothing else does; a line counts once.
    nth = F.row_number().over(Window.partitionBy(*KEY, "kind", F.when(kind == LINE, F.col("start"))).orderBy(F.desc("p"), "start"))
    rows = rows.withColumn("nth", nth).where((kind == SECTION) | F.when(kind == LINE, F.col("nth") == 1).otherwise(F.col("weak") & (F.col("nth") <= WEAK_REGIONS) | (p >= lim.threshold)))
    rows = _regions(rows, kind == BLOCK)
    rows = rows.withColumn("r_place", F.when(F.col("r_p").isNotNull(), F.dense_rank().over(_file().orderBy(F.desc_nulls_last("r_p"), "r_start"))))
    kept = F.coalesce(F.col("r_place") <= lim.max_regions, F.lit(False))
    labels = F.collect_set(F.when(F.col("head") & kept, F.col("r_label_line"))).over(_file())
    free = (kind == LINE) & ~F.array_contains("labels", F.col("start")) & ~(F.col("inside") & ~kept)
    rows = rows.withColumn("labels", labels).withColumn("free", free)
    rows = rows.withColumn("l_place", F.when(F.col("free"), F.row_number().over(_file().orderBy(F.desc("free"), F.desc("p"), "start"))))
    shown_region, shown_line = F.col("head") & kept, F.col("l_place") <= lim.max_lines
    region = F.struct("r_place", F.struct(*(F.col(f"r_{c}").alias(c) for c in ("start", "end", "p", "label", "label_line"))).alias("x"))
    line = F.struct("l_place", F.struct(F.col("start").alias("line"), "p", F.col("label").alias("text"), "section", F.when(F.col("inside") & kept, F.col("r_start")).alias("region")).alias("x"))

    def in_order(some: Column, what: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(some, what))), lambda z: z["x"])

    views = rows.groupBy(*KEY).agg(
        F.first("file_score").alias("score"), F.first("file_confidence").alias("confidence"),
        F.greatest(F.first("file_score"), F.max(F.when(shown_region, F.col("r_p"))), F.max(F.when(shown_line, F.col("p")))).alias("relevance"), F.first("weak").alias("weak"),
        F.greatest(F.count_if("head") - lim.max_regions, F.lit(0)).cast("long").alias("more_regions"), F.greatest(F.count_if("free") - lim.max_lines, F.lit(0)).cast("long").alias("more_lines"),
        in_order(shown_region, region).alias("regions"), in_order(shown_line, line).alias("lines"), F.count_if(kind != SECTION).alias("hits"),
    )
    return views.where("hits > 0").drop("hits").withColumn("query_idx", F.col("query_idx").cast("int"))


def _best(views: DataFrame, lim: Limits) -> DataFrame:
    tier = views.withColumn("_r", F.row_number().over(Window.partitionBy("query_idx", "weak").orderBy(F.desc("relevance"), "path")))
    tier = tier.where(F.col("_r") <= max(lim.top, WEAK_FILES)).where(F.col("_r") <= F.when(F.col("weak"), WEAK_FILES).otherwise(lim.top))
    # A handful of rows per query from here on.
    per_query = Window.partitionBy("query_idx")
    room = F.lit(lim.top) - F.count_if(~F.col("weak")).over(per_query)
    tier = tier.withColumn("_room", room).where(~F.col("weak") | (F.col("_r") <= F.col("_room")))
    return tier.withColumn("place", F.row_number().over(per_query.orderBy("weak", F.desc("relevance"), "path"))).drop("_r", "_room")


def _selected(rows: DataFrame, lim: Limits) -> Selection:
    views = _views(rows, lim)
    return Selection(views, _best(views, lim))


#: What each kind of row has; the others are null.
_ROW = {"kind": "int", "start": "int", "end": "int", "p": "double", "label": "string", "label_line": "int", "section": "double", "score": "double", "confidence": "double"}


def _row(kind: int, **has: Column) -> list[Column]:
    return [F.lit(kind).alias("kind")] + [has.get(c, F.lit(None)).cast(t).alias(c) for c, t in _ROW.items() if c != "kind"]


def _of_section(x) -> list[Column]:
    return _row(SECTION, start=x("start"), score=x("score"), confidence=x("confidence"))


def _of_block(x) -> list[Column]:
    return _row(BLOCK, **{c: x(c) for c in ("start", "end", "p", "label", "label_line")})


def _of_line(x) -> list[Column]:
    return _row(LINE, start=x("line"), end=x("line"), p=x("p"), label=x("text"), section=x("section"))


def select(files: DataFrame, lines: DataFrame, blocks: DataFrame, lim: Limits = Limits()) -> Selection:
    """files (KEY, score, confidence), line and block hits as their operators give them."""
    near = blocks.where((F.col("keep") >= GATE) & (F.col("p") >= WEAK_RATIO * lim.threshold)).select(*KEY, *_of_block(F.col))
    hits = lines.where((F.col("keep") >= GATE) & (F.col("p") >= lim.threshold)).select(*KEY, *_of_line(F.col))
    return _selected(files.withColumn("start", F.lit(1)).select(*KEY, *_of_section(F.col)).unionByName(hits).unionByName(near), lim)


def select_scored(scored: DataFrame, lim: Limits = Limits()) -> Selection:
    """select() of the lexical backend's scored chunks: sections, blocks and lines by one reading of the chunks."""
    passing = lambda hits: F.filter(hits, lambda z: z["keep"] >= GATE)
    gate = F.col("section_keep") >= GATE
    section = F.struct(*_row(SECTION, start=F.col("start"), score=F.when(gate, F.col("score") / (scoring.LEVELS - 1)), confidence=F.when(gate, F.col("confidence"))))
    blocks = F.transform(passing(scoring.block_array(WEAK_RATIO * lim.threshold)), lambda z: F.struct(*_of_block(lambda c: z[c])))
    lines = F.transform(passing(scoring.line_array(lim.threshold)), lambda z: F.struct(*_of_line(lambda c: z[c])))
    return _selected(scored.select(*KEY, F.explode(F.concat(F.array(section), blocks, lines)).alias("z")).select(*KEY, "z.*"), lim)


def select_files(files: DataFrame, file_threshold: float = 0.6, top: int = 15) -> DataFrame:
    """Files only: by section relevance, those that pass the filter."""
    order = Window.partitionBy("query_idx").orderBy(F.desc("score"), "path")
    kept = files.where((F.col("score") >= file_threshold) & (F.col("keep") >= GATE))
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def rows_of(sel: Selection) -> DataFrame:
    """The rows of shown files in file order: kind region or line, start, end, p, text, nested, weak, place."""
    f = sel.shown.select(*KEY, "place", "weak", "regions", "lines")
    head = [*KEY, "place", "weak"]
    region = lambda r: F.struct(F.lit("region").alias("kind"), r["start"].alias("start"), r["end"].alias("end"), r["p"].alias("p"), r["label"].alias("text"), F.lit(False).alias("nested"))
    line = lambda h: F.struct(F.lit("line").alias("kind"), h["line"].alias("start"), h["line"].alias("end"), h["p"].alias("p"), h["text"].alias("text"), h["region"].isNotNull().alias("nested"))
    return f.select(*head, F.explode(F.concat(F.transform("regions", region), F.transform("lines", line))).alias("x")).select(*head, "x.*")


def context_lines(scored: DataFrame, around: int, threshold: float = 0.5) -> DataFrame:
    """query_idx, path, line, text of the lines up to `around` lines from a line hit, without the hits and blank lines.

    Lines of scored chunks, read once; of each chunk only those that a hit of its own or of the next one can reach are
    dealt by file, where a frame of line numbers finds the hits around.
    """
    number = F.col("line")
    hot = F.transform(scoring.line_array(threshold), lambda z: z["line"])
    rows = scored.withColumn("hits", hot).where(F.size("lines") > 0)
    own = F.sequence("start", "end")
    reached = F.filter(own, lambda n: (n < F.col("start") + around) | (n > F.col("end") - around) | F.exists("hits", lambda h: F.abs(h - n) <= around))
    each = rows.select(*KEY, "ctx_start", "lines", "hits", F.explode(reached).alias("line"))
    each = each.select(*KEY, "line", F.get("lines", number - F.col("ctx_start")).alias("text"), F.array_contains("hits", number).alias("hit"))
    near = F.max("hit").over(_file().orderBy("line").rangeBetween(-around, around))
    return each.withColumn("near", near).where(F.col("near") & ~F.col("hit") & F.col("text").rlike(r"(?U)\S")).select(*KEY, "line", "text")
