"""Measures: expected scores of graded answers, precision and recall, findings against labelled lines, known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expected_scores(answers: DataFrame) -> DataFrame:
    """doc_id, score, well_formed of rows with percents array<double>: the mean level; null if nothing is said."""
    total = F.aggregate("percents", F.lit(0.0), lambda a, x: a + x)
    weighed = F.aggregate(F.transform("percents", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return answers.select("doc_id", F.round(F.try_divide(weighed, total), 6).alias("score"), (F.abs(total - 100) <= 2.5).alias("well_formed"))


def precision_recall(found: DataFrame, truth: DataFrame, judged: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall over the judged items; a measure with nothing to divide by is null."""
    rows = judged.select("item").distinct().join(found.select("item").distinct().withColumn("f", F.lit(1)), "item", "left").join(truth.select("item").distinct().withColumn("t", F.lit(1)), "item", "left")
    f, t = F.col("f").isNotNull(), F.col("t").isNotNull()
    n = rows.agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"))
    return n.select("tp", "fp", "fn", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"))


def match_findings(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """findings (case, criterion, start, end, ord: their place in the report) with hit. labels: case, criterion, line, ord.

    A finding stands for the first label of its case and criterion whose line it holds; of the findings that stand for one
    label the first is a hit.
    """
    told = labels.select("case", "criterion", "line", F.col("ord").alias("label"))
    held = findings.join(told, ["case", "criterion"]).where(F.col("line").between(F.col("start"), F.col("end"))).groupBy("case", "ord").agg(F.min("label").alias("label"))
    hits = held.groupBy("case", "label").agg(F.min("ord").alias("ord")).select("case", "ord", F.lit(True).alias("hit"))
    return findings.join(hits, ["case", "ord"], "left").select("case", "criterion", "start", "end", "ord", F.coalesce("hit", F.lit(False)).alias("hit"))


def finding_measures(findings: DataFrame, labels: DataFrame, cases: DataFrame) -> DataFrame:
    """tp, fp, fn, incomplete, cases, precision, recall, valid over the complete ones of cases (case, status); any incomplete one makes the run invalid."""
    complete = cases.where(F.col("status").isin("findings", "no_findings")).select("case")
    n = match_findings(findings.join(complete, "case"), labels.join(complete, "case")).agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))
    n = n.join(labels.join(complete, "case").agg(F.count("*").alias("n"))).join(cases.agg(F.count_if(~F.col("status").isin("findings", "no_findings")).alias("incomplete"), F.count("*").alias("cases")))
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    n = n.withColumn("fn", F.col("n") - F.col("tp"))
    return n.select("tp", "fp", "fn", "incomplete", "cases", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), (F.col("incomplete") == 0).alias("valid"))


#: Lines of a bucket: ranges that overlap meet in one, so that they are joined by equality.
BUCKET = 64


def printed_rows(shown: DataFrame) -> DataFrame:
    """query_idx, path, weak, place, kind, start, end, p of what shown files (regions, lines as select gives them) print: regions, the lines that label them, lines."""
    row = lambda kind, a, b, p: F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), p.alias("p"))
    regions = F.transform("regions", lambda r: row("region", r["start"], r["end"], r["p"]))
    labels = F.transform("regions", lambda r: row("label", r["label_line"], r["label_line"], r["p"]))
    lines = F.transform("lines", lambda h: row("line", h["line"], h["line"], h["p"]))
    return shown.select("query_idx", "path", "weak", "place", F.explode(F.concat(regions, labels, lines)).alias("x")).select("query_idx", "path", "weak", "place", "x.*")


def known_answers(shown: DataFrame, cases: DataFrame) -> DataFrame:
    """case, query_idx, kind, place, region, line of known cases (case, query_idx, kind, suffix, lo, hi: a row per range of true lines).

    place: where a file with the suffix stands first, 0 if nowhere; region and line: the best p of regions, and of lines and
    labels, of its confident matches that overlap a range, 0 if none.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor(F.col(b) / BUCKET)))
    told = cases.withColumn("bucket", buckets("lo", "hi"))
    met = printed_rows(shown.where("not weak")).withColumnRenamed("kind", "what").withColumn("bucket", buckets("start", "end")).join(told, ["query_idx", "bucket"])
    met = met.where(F.col("path").endswith(F.col("suffix")) & (F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo")))
    best = met.groupBy("case").agg(F.max(F.when(F.col("what") == "region", F.col("p"))).alias("region"), F.max(F.when(F.col("what") != "region", F.col("p"))).alias("line"))
    each = cases.select("case", "query_idx", "kind", "suffix").distinct()
    places = shown.select("query_idx", "path", "place").join(each, "query_idx").where(F.col("path").endswith(F.col("suffix"))).groupBy("case").agg(F.min("place").alias("place"))
    out = each.join(places, "case", "left").join(best, "case", "left")
    return out.select("case", "query_idx", "kind", F.coalesce("place", F.lit(0)).alias("place"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("region", "line")))


def tally(known: DataFrame, threshold: float = 0.5) -> DataFrame:
    """cases, first_file, region, pins, line: how many cases found their file first, their region, and of those of kind pin their line."""
    pin = F.col("kind") == "pin"
    return known.agg(F.count("*").alias("cases"), F.count_if(F.col("place") == 1).alias("first_file"), F.count_if(F.col("region") >= threshold).alias("region"), F.count_if(pin).alias("pins"), F.count_if(pin & (F.col("line") >= threshold)).alias("line"))


def audits(shown: DataFrame, threshold: float = 0.5, weak_ratio: float = 0.7) -> DataFrame:
    """query_idx, strong, weak, regions, lines, below_bar, twice: what a query shows, rows under their bar, and source lines that are printed again."""
    bar = F.when((F.col("kind") == "region") & F.col("weak"), F.lit(weak_ratio * threshold)).otherwise(F.lit(threshold))
    counted = (F.col("kind") != "label") & (F.col("p") < bar)
    number = F.when(F.col("kind") != "region", F.col("start"))
    n = lambda kind: F.count_if((F.col("kind") == kind) & ~F.col("weak"))
    files = printed_rows(shown).groupBy("query_idx", "path", "weak").agg(n("region").alias("regions"), n("line").alias("lines"), F.count_if(counted).alias("below_bar"), (F.count(number) - F.count_distinct(number)).alias("twice"))
    return files.groupBy("query_idx").agg(F.count_if(~F.col("weak")).alias("strong"), F.count_if("weak").alias("weak"), *(F.sum(c).alias(c) for c in ("regions", "lines", "below_bar", "twice")))
