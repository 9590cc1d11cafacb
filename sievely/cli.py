"""python -m sievely QUERY [PATH...]: search files, or check criteria. Exit status: 0 something is shown, 1 nothing, 2 an error."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import time
from collections.abc import Mapping

from pyspark.sql import SparkSession

from .functions.lines import lines_of
from .operators import filters, fold, questions, render, rulecheck, scoring, segment, select
from .progress import Progress
from .sources import backends, files
from .sources.credentials import Chain
from .sources.ledger import Ledger

_COMMON = {"find", "where", "what", "which", "does", "that", "this", "with", "from", "have", "into", "when", "code", "the", "and", "for", "are", "how", "who"}


def words_of(query: str) -> list[str]:
    """The words that the local backend looks for: those of three letters or more that are not common."""
    return [w for w in re.findall(r"[0-9A-Za-z_]{3,}", query) if w.lower() not in _COMMON] or [query]


def probability(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError(f"{text} is not between 0 and 1")
    return value


def count(least: int):
    def read(text: str) -> int:
        value = int(text)
        if value < least:
            raise argparse.ArgumentTypeError(f"{text} is less than {least}")
        return value

    return read


#: Options that the environment may set (SIEVELY_ and the name in capitals); what is said on the command line goes before it.
FROM_ENVIRONMENT = ("threshold", "file_threshold", "top", "max_lines", "max_regions", "max_bytes", "chunk_lines", "chunk_tokens", "backend", "url", "model", "color", "triage_threshold", "max_files", "jobs", "ledger")
#: Options that say how to search, which checks of rules have no use for.
SEARCH_ONLY = ("query", "paths", "more", "glob", "exclude", "context", "files", "filter", "broad", "json", "no_heading", "hidden", "no_ignore", "triage", "stats", "ledger")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievely")
    p.add_argument("query", nargs="?")
    p.add_argument("paths", nargs="*")
    p.add_argument("-e", "--query", dest="more", action="append", default=[], help="a further query")
    p.add_argument("-g", "--glob", action="append", default=[])
    p.add_argument("-x", "--exclude", action="append", default=[])
    p.add_argument("-t", "--threshold", type=probability, default=0.5)
    p.add_argument("-T", "--file-threshold", type=probability, default=0.6)
    p.add_argument("-n", "--top", type=count(0), default=15)
    p.add_argument("-m", "--max-lines", type=count(0), default=10)
    p.add_argument("--max-regions", type=count(0), default=5)
    p.add_argument("-C", "--context", type=count(0), default=0)
    p.add_argument("-l", "--files", action="store_true")
    p.add_argument("-f", "--filter", action="append", default=[])
    p.add_argument("--broad", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--no-heading", action="store_true")
    p.add_argument("--hidden", action="store_true")
    p.add_argument("--no-ignore", action="store_true")
    p.add_argument("--max-bytes", type=count(1), default=files.MAX_BYTES)
    p.add_argument("--chunk-lines", type=count(1), default=150)
    p.add_argument("--chunk-tokens", type=count(1), default=14_000)
    p.add_argument("--backend", choices=["lexical", "http", "chat"], default="lexical")
    p.add_argument("--url")
    p.add_argument("--model", default="default")
    p.add_argument("--key-from", action="append", default=[], metavar="KIND:WHAT", help="where the key is, in order: env:NAME, toml:PATH#key, json:PATH#key, command:PROGRAM")
    p.add_argument("--reroute", action="append", nargs=3, default=[], metavar=("HOST", "MODEL_PREFIX", "URL"), help="models of a host that are asked at another address, as typed questions")
    p.add_argument("--color", choices=["auto", "always", "never"], default="auto")
    p.add_argument("--triage", action="store_true", help="judge paths first, open the likely ones only")
    p.add_argument("--triage-threshold", type=probability, default=0.2)
    p.add_argument("--max-files", type=count(1), default=1500)
    p.add_argument("-j", "--jobs", type=count(1), default=32)
    p.add_argument("--ledger", help="a folder of answers that are not asked for again; without it they are kept for this run")
    p.add_argument("--stats", action="store_true", help="files, requests, tokens, cost and seconds on stderr")
    p.add_argument("--rules")
    p.add_argument("--source", action="append", default=[])
    p.add_argument("--budget", type=count(1), default=256)
    p.add_argument("--plan", action="store_true")
    return p


def arguments(argv: list[str] | None, environment: Mapping[str, str]) -> argparse.Namespace:
    """The command line, with the environment for what it leaves out. Blank variables are as good as none; wrong values end the program (status 2), wherever they come from."""
    p = parser()
    said = {x: environment[f"SIEVELY_{x.upper()}"].strip() for x in FROM_ENVIRONMENT if environment.get(f"SIEVELY_{x.upper()}", "").strip()}
    allowed = {x.dest: x.choices for x in p._actions if x.choices}
    if wrong := [x for x, value in said.items() if value not in (allowed.get(x) or [value])]:
        p.error(f"SIEVELY_{wrong[0].upper()} is none of {', '.join(allowed[wrong[0]])}")
    p.set_defaults(**said)  # as text, which each option's type reads
    a = p.parse_args(argv)
    a.key_from = a.key_from or ["env:DECISION_API_KEY"]
    if a.rules:
        plain = parser().parse_args([])
        if used := [x for x in SEARCH_ONLY if x not in said and getattr(a, x) != getattr(plain, x)]:
            p.error(f"--rules goes without {', '.join(used)}")
        if not 1 <= len(a.source) <= rulecheck.MAX_SOURCES:
            p.error(f"--rules needs 1 to {rulecheck.MAX_SOURCES} --source")
    elif a.source or a.plan:
        p.error("--source and --plan go with --rules")
    return a


def _backend(a: argparse.Namespace, words: list[str], retries: int = 8):
    if a.backend == "lexical":
        return lambda: backends.LexicalBackend(words)
    if not a.url:
        raise ValueError("--url is needed")
    url, model, key, reroutes = a.url, a.model, Chain.of(*a.key_from), [backends.Reroute(*x) for x in a.reroute]
    if a.backend == "http":
        return lambda: backends.HttpBackend(url, model, key, retries)
    return lambda: backends.service(url, model, reroutes, key=key, retries=retries)


def check_rules(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        with open(a.rules, encoding="utf-8") as f:
            plan = rulecheck.prepare(spark, f.read(), a.source, a.budget)
    except (OSError, ValueError) as e:
        print(json.dumps({"schema_version": 1, "advisory": True, "status": "error", "error": str(e)}))
        return 2
    if a.plan:
        print(plan.report("planned", [], 0))
        return 0
    words = [w for c in plan.criteria for w in words_of(c.text)]
    found, done, usage = plan.evaluate(spark, _backend(a, words, rulecheck.ATTEMPTS - 1))
    status = plan.status(found, done)
    print(plan.report(status, found, done, usage, a.backend, a.model if a.backend != "lexical" else None))
    return 2 if status == "incomplete" else 0  # findings are advice


def search(spark: SparkSession, a: argparse.Namespace) -> int:
    queries = [q.strip() for q in [a.query or "", *a.more] if q.strip()]
    if not queries:
        print("a query is needed", file=sys.stderr)
        return 2
    rules = filters.Rules()
    for text in a.filter:
        rules = rules.merged(filters.parse(text))
    if a.filter and not rules:
        print("the filter says nothing", file=sys.stderr)
        return 2
    try:
        listed = files.discover(spark, a.paths, files.Discover(a.glob, a.exclude, a.max_bytes, a.hidden, a.no_ignore))
    except FileNotFoundError as e:
        print(f"no such path: {e}", file=sys.stderr)
        return 2
    began, n_files = time.time(), listed.count()
    answers, model = Ledger(spark, a.ledger), json.dumps([a.backend, a.url, a.model])
    if not n_files:
        print("no files to search", file=sys.stderr)
        return 1
    if a.triage or n_files > a.max_files:
        make = _backend(a, [w for q in queries for w in words_of(q)])
        scores = questions.triage_scores(listed, make, queries, answers, a.jobs, model)
        listed = listed.join(fold.triage(listed.select("path", "ord"), scores, a.triage_threshold, a.max_files).select("path"), "path")
        print(f"path triage kept {listed.count()} of {n_files} files", file=sys.stderr)
    per_line = 0.0 if a.files else len(queries) + 0.12 * len(rules.terms())
    cfg = segment.Chunking(a.chunk_lines, a.chunk_tokens, questions_per_line=per_line)
    unreadable = spark.sparkContext.accumulator(0)
    texts = files.read_files(listed, unreadable)
    chunks = segment.chunk_files(texts, cfg)
    if a.backend == "chat" and (finer := segment.spread(cfg, chunks.count(), a.jobs)):
        chunks = segment.chunk_files(texts, finer)  # it answers one question after the other: fill its lanes
    if a.backend == "lexical":
        scored = scoring.score_chunks(chunks, scoring.Search([words_of(q) for q in queries], rules, {t: words_of(t) for t in rules.terms()})).persist()
        lines, blocks = scoring.line_hits(scored), scoring.block_hits(scored)
    else:
        asking = questions.Asking(queries, rules.terms(), a.files, a.broad)
        with Progress(spark):
            asked = questions.ask_chunks(chunks, _backend(a, []), asking, answers, a.jobs, model)
        failed = asked.where("error_kind is not null")
        if n := failed.count():
            print(f"{n} request(s) failed; the first: {failed.first()['error']}", file=sys.stderr)
            if n == asked.count():
                return 2
        scored, lines, blocks = questions.score_answers(asked, asking, rules)
    folded = fold.fold_files(scored)
    if a.stats:
        u = (fold.usage(scored) if a.backend == "lexical" else fold.usage_of(asked)).first()
        retries = f", {u['retries']:,} retries" if a.backend != "lexical" else ""
        gone = fold.filtered_out(lines, blocks, a.threshold).collect() if rules else []
        left_out = f", the filter took {sum(r['regions'] for r in gone)} regions and {sum(r['lines'] for r in gone)} lines" if gone else ""
        print(f"{n_files:,} files, {u['requests']:,} requests{retries}, {u['input_tokens']:,} tokens, ${u['cost']:.4f}, {time.time() - began:.1f} s{left_out}", file=sys.stderr)
    lim, shown = select.Limits(a.threshold, a.file_threshold, a.top, a.max_regions, a.max_lines), False
    if a.files:
        best = select.select_files(folded, a.file_threshold, a.top)
        for i, q in enumerate(queries):
            text = render.files_lines(q, best.where(best["query_idx"] == i), a.json)
            shown = shown or bool(text)
            print((f"== {q}\n" if len(queries) > 1 and not a.json else "") + (text or ("(no matches)\n" if len(queries) > 1 and not a.json else "")) + ("\n" if len(queries) > 1 and not a.json else ""), end="")
        return int(not shown)
    with Progress(spark):
        by_query = render.collect(select.select(folded, lines, blocks, lim))
    source = None
    if a.context:  # of the files shown, which the limits bound
        paths = sorted({f["path"] for found in by_query.values() for f in found})
        source = {r["path"]: lines_of(r["text"]) for r in texts.where(texts["path"].isin(paths)).collect()}
    color = render.wants_color(a.color, dict(os.environ), sys.stdout.isatty())
    if unreadable.value:
        print("some files could not be read", file=sys.stderr)
    for i, q in enumerate(queries):
        found = by_query.get(i, [])
        shown = shown or any(not f["weak"] or not a.no_heading for f in found)
        if a.json:
            print(render.json_lines(q, found), end="")
        elif a.no_heading:
            print(render.flat(found), end="")
        else:
            print((f"== {q}\n" if len(queries) > 1 else "") + (render.grouped(found, lim, a.context, source, color) or ("(no matches)\n\n" if len(queries) > 1 else "")), end="")
    return int(not shown)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv, os.environ)
    spark = SparkSession.builder.appName("sievely").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return check_rules(spark, a) if a.rules else search(spark, a)
