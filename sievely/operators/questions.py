"""Questions as typed rows, asking them, and reading the answers as typed rows.

A question is (kind, i, a, b): which kind, about which query, filter term, path or criterion, and from which line to which.
A chunk's questions are an array of these, made by Column expressions; ids and wording exist on the wire only. Answers come
back in the same types, so what was asked and what was answered are compared and looked up by columns. Every request has a
key, the hash of all that goes into it; the ledger asks for each key once. A chunk that is too large for a service is halved
and its halves are asked, round by round.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.backends import DecisionBackend, DecisionError, Usage
from ..sources.ledger import Ledger
from . import scoring, segment
from .filters import Rules

#: The wording is behaviour.
LEVELS = [
    "Irrelevant: nothing here relates to the query",
    "Tangential: touches the same area but would not help answer the query",
    "Relevant: contains code or text that helps answer the query",
    "Direct hit: this is the code or text the query is looking for",
]
TASK = "code search: find where a codebase answers a natural-language query"
TRIAGE_TASK = "decide which files are worth opening for a code search"
BROAD_LINE = "Is line {a} of the code relevant to {which}?"
#: For each kind of question its id and its wording.
KINDS = {
    "category": ("F{i}.S", "Does this file fall under the category: {term}?"),
    "category_block": ("F{i}.B{a}-{b}", "Do lines {a}-{b} fall under the category: {term}?"),
    "section": ("q{i}.rel", "How relevant is this section of {path} to the query: {query}"),
    "block": ("q{i}.B{a}-{b}", "Do lines {a}-{b} contain the code that {which} is looking for?"),
    "line": ("q{i}.L{a}", "Does line {a} of the code directly answer {which}?"),
    "path": ("p{i}", "Judging by its path, could the file paths.p{i} ({path}) plausibly contain code relevant to the query?"),
    "rule": ("r{i}.B{a}-{b}", "Do lines {a}-{b} concretely violate this requirement: {rule}?"),
}
#: Paths that one triage request asks about.
BATCH = 250

QUESTION = "struct<kind:string,i:int,a:int,b:int>"
ANSWER = "struct<kind:string,i:int,a:int,b:int,p:double,confidence:double>"


@dataclass(frozen=True)
class Asking:
    """What is asked about every chunk."""

    queries: list[str]
    terms: list[str] = field(default_factory=list)
    files_only: bool = False
    broad: bool = False

    def which(self, i: int) -> str:
        return "the query" if len(self.queries) == 1 else f"query q{i} ({self.queries[i]})"


def about(kind: str, i: Column | int, a: Column | None = None, b: Column | None = None) -> Column:
    """A typed question."""
    values = (F.lit(kind), i if isinstance(i, Column) else F.lit(i), F.lit(None) if a is None else a, F.lit(None) if b is None else b)
    return F.struct(*values).cast(QUESTION)


def _each(n: int, of: Callable[[Column], Column]) -> Column:
    """of(0), .., of(n - 1) one after the other."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), of)) if n else F.array().cast(f"array<{QUESTION}>")


def chunk_questions(asking: Asking) -> Column:
    """A chunk's questions in the order in which they are asked: categories once, then for each query the section, its blocks and the lines that have something to ask about."""
    none = F.array().cast(f"array<{QUESTION}>")

    def blocks(kind: str, i: Column) -> Column:
        return none if asking.files_only else F.transform("blocks", lambda x: about(kind, i, x["start"], x["end"]))

    numbers = F.filter(F.sequence("start", "end"), lambda n: tx.askable(F.get("lines", n - F.col("ctx_start"))))
    lines = lambda i: none if asking.files_only else F.transform(numbers, lambda n: about("line", i, n, n))
    categories = _each(len(asking.terms), lambda t: F.concat(F.array(about("category", t)), blocks("category_block", t)))
    return F.concat(categories, _each(len(asking.queries), lambda i: F.concat(F.array(about("section", i)), blocks("block", i), lines(i))))


def question_counts(chunks: DataFrame, asking: Asking) -> DataFrame:
    """path, start, end and how many section, block, line and filter questions the chunk's request has."""
    n = lambda *kinds: F.size(F.filter("asked", lambda x: x["kind"].isin(*kinds)))
    counted = {"n_section": n("section"), "n_block": n("block"), "n_line": n("line"), "n_filter": n("category", "category_block")}
    return chunks.withColumn("asked", chunk_questions(asking)).select("path", "start", "end", *(c.alias(k) for k, c in counted.items()))


def wire(question: dict, names: dict[str, str]) -> tuple[str, dict]:
    """The id and the body of a typed question; names: what its wording mentions."""
    name, wording = KINDS[question["kind"]]
    body = {"type": "noul", "instructions": names.get(question["kind"], wording).format(**question, **names)}
    if question["kind"] == "section":
        body = {"type": "score", "instructions": body["instructions"], "criteria": LEVELS}
    return name.format(**question), body


def chunk_request(chunk: dict, asking: Asking) -> tuple[dict, dict[str, dict]]:
    """State and questions of a chunk (path, ctx_start, start, end, lines, asked) as a service takes them."""
    width = len(str(chunk["end"]))
    code = "\n".join(f"{n:>{width}}| {line}" for n, line in enumerate(chunk["lines"], chunk["ctx_start"]))
    queries = {f"q{i}": q for i, q in enumerate(asking.queries)}
    state = {"task": TASK} | ({"query": asking.queries[0]} if len(queries) == 1 else {"queries": queries})
    state |= {"file": chunk["path"], "shown_lines": f"{chunk['ctx_start']}-{chunk['end']}", "code": code}

    def names(q: dict) -> dict[str, str]:
        if q["kind"].startswith("category"):
            return {"term": asking.terms[q["i"]]}
        own = {"path": chunk["path"], "query": asking.queries[q["i"]], "which": asking.which(q["i"])}
        return own | ({"line": BROAD_LINE} if asking.broad else {})

    return state, dict(wire(q, names(q)) for q in chunk["asked"])


def chunk_requests(chunks: DataFrame, asking: Asking, model: str = "") -> DataFrame:
    """chunks with `asked` and `request`, the key of all that is sent."""
    rows = chunks.withColumn("asked", chunk_questions(asking))
    said = json.dumps([model, TASK, LEVELS, KINDS, BROAD_LINE, asking.queries, asking.terms, asking.files_only, asking.broad])
    return rows.withColumn("request", F.sha2(F.concat(F.lit(said), F.to_json(F.struct("path", "ctx_start", "start", "end", "lines", "asked"))), 256))


_ANSWER_TYPE = pa.struct([("kind", pa.string()), ("i", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("p", pa.float64()), ("confidence", pa.float64())])
#: What a request was answered, or why not: columns with their types in Spark and Arrow.
ANSWERED = {"request": ("string", pa.string()), "answers": (f"array<{ANSWER}>", pa.list_(_ANSWER_TYPE)), "extra": ("int", pa.int32()), "error_kind": ("string", pa.string()), "error": ("string", pa.string())}
#: What it took.
USAGE = {"requests": ("long", pa.int64()), "retries": ("long", pa.int64()), "input_tokens": ("long", pa.int64()), "output_tokens": ("long", pa.int64()), "reported_cost": ("double", pa.float64()), "tier": ("string", pa.string())}


def _spent(backend: DecisionBackend) -> tuple:
    u = getattr(backend, "usage", None) or Usage()
    return u.requests, u.retries, u.input_tokens, u.output_tokens, u.reported_cost, "mixed" if len(u.tiers) > 1 else next(iter(u.tiers), None)


def _typed(asked: list[dict], questions: dict[str, dict], got: dict[str, dict]) -> tuple[list[dict], int]:
    """Answers of questions in the order in which they were asked (p is null if it is no number), and how many were given beyond them."""
    number = lambda x: float(x) if isinstance(x, int | float) and not isinstance(x, bool) else None
    out = []
    for q, name in zip(asked, questions, strict=True):
        if name in got:
            said = got[name] if isinstance(got[name], dict) else {}
            out.append(q | {"p": number(said.get("score" if q["kind"] == "section" else "noul")), "confidence": number(said.get("confidence"))})
    return out, len(set(got) - set(questions))


def in_lanes(requests: DataFrame, make: Callable[[], DecisionBackend], columns: dict[str, tuple], answer: Callable[[DecisionBackend, dict], tuple], jobs: int = 32) -> DataFrame:
    """answer(backend, row) of each row as `columns`, and USAGE.

    At most `jobs` requests run at a time in the whole cluster: there are no more tasks than lanes, and the lanes are divided
    among them. Within a task the service's own limiter may admit fewer.
    """
    lanes, types = max(1, min(jobs, requests.sparkSession.sparkContext.defaultParallelism)), columns | USAGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = jobs // lanes + (TaskContext.get().partitionId() < jobs % lanes)
        backend = make()
        if hasattr(backend, "jobs"):
            backend.jobs = max(1, share)
        with ThreadPoolExecutor(max(1, share)) as pool:
            for batch in batches:
                if not batch.num_rows:
                    continue
                before = _spent(backend)
                out = list(pool.map(lambda row: answer(backend, row), batch.to_pylist()))
                after = _spent(backend)
                # What a batch took stands in its first row.
                cost = None if after[4] is None else after[4] - (before[4] or 0.0)
                took = [(*(b - a for a, b in zip(before[:4], after[:4], strict=True)), cost, after[5])] + [(0, 0, 0, 0, None, None)] * (len(out) - 1)
                rows = zip(*((*x, *y) for x, y in zip(out, took, strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, types.values(), strict=True)], list(types))

    return requests.repartition(lanes).mapInArrow(run, ", ".join(f"{c} {t}" for c, (t, _) in types.items()))


def ask(requests: DataFrame, make: Callable[[], DecisionBackend], as_sent: Callable[[dict], tuple[dict, dict]], jobs: int = 32, lenient: bool = False) -> DataFrame:
    """ANSWERED of requests (request, asked, and what as_sent() reads). Errors are rows, but for auth errors, which end the job, unless `lenient`."""

    def one(backend: DecisionBackend, row: dict) -> tuple:
        try:
            state, questions = as_sent(row)
            answers, extra = _typed(row["asked"], questions, backend.ask(state, questions))
            return row["request"], answers, extra, None, None
        except DecisionError as e:
            if e.kind == "auth" and not lenient:
                raise
            return row["request"], [], 0, e.kind, e.message
        except Exception as e:
            if not lenient:
                raise
            return row["request"], [], 0, "api", repr(e)

    return in_lanes(requests, make, ANSWERED, one, jobs)


def ask_chunks(chunks: DataFrame, make: Callable[[], DecisionBackend], asking: Asking, ledger: Ledger, jobs: int = 32, model: str = "") -> DataFrame:
    """A row per chunk asked (oversize ones as their halves) with its answers, as the ledger has them; failures are rows with an error."""
    columns, parts, pending = chunks.columns, [], chunks
    while True:
        answered = ledger.answered(chunk_requests(pending, asking, model), lambda new: ask(new, make, lambda row: chunk_request(row, asking), jobs))
        too_large = (F.col("error_kind") == "token_limit") & (F.col("end") > F.col("start"))
        parts.append(answered.where(~F.coalesce(too_large, F.lit(False))))
        pending = answered.where(too_large).select(*columns)
        if pending.isEmpty():
            break
        # Halves of chunks that the ledger knows to be too large: a chunk of n lines is done after log2(n) rounds.
        pending = segment.halve(pending).select(*columns)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _said(kind: str, i: Column, a: Column | None = None, b: Column | None = None) -> Column:
    """The answer to a question in the row's answers, or null."""
    same = lambda x: (x["kind"] == kind) & (x["i"] == i) & (F.lit(True) if a is None else (x["a"] == a) & (x["b"] == b))
    return F.get(F.filter("answers", same), F.lit(0))


def score_answers(answered: DataFrame, asking: Asking, rules: Rules | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored sections, line hits, block hits) of answered chunks, in the shapes that fold and select take; all of it from the row that holds the answers."""
    rules, terms = rules or Rules(), list(enumerate(asking.terms))
    section = {t: F.coalesce(_said("category", F.lit(k))["p"], F.lit(0.5)) for k, t in terms}
    of_block = lambda x: {t: F.greatest(section[t], F.coalesce(_said("category_block", F.lit(k), x["start"], x["end"])["p"], F.lit(0.0))) for k, t in terms}
    df = answered.where("error_kind is null").withColumn("section_keep", rules.passes_column(section))
    df = df.withColumn("block_keeps", F.transform("blocks", lambda x: rules.passes_column(of_block(x))))
    df = df.withColumn("query_idx", F.explode(F.sequence(F.lit(0), F.lit(len(asking.queries) - 1))))
    mine = lambda kind: F.filter("answers", lambda x: (x["kind"] == kind) & (x["i"] == F.col("query_idx")))
    relevance = _said("section", F.col("query_idx"))
    df = df.withColumns({"score": F.coalesce(relevance["p"], F.lit(0.0)), "confidence": F.coalesce(relevance["confidence"], F.lit(0.0))})
    lines = F.transform(mine("line"), lambda x: scoring.line_struct(x["a"], F.coalesce(x["p"], F.lit(0.0))))
    told = lambda z: _said("block", F.col("query_idx"), z["b"]["start"], z["b"]["end"])
    given = F.filter(F.transform(scoring.kept_blocks(), lambda z: F.struct(z["b"]["start"].alias("start"), z["b"]["end"].alias("end"), told(z).alias("said"), z["k"].alias("keep"))), lambda z: z["said"].isNotNull())
    blocks = scoring.block_structs(F.transform(given, lambda z: F.struct(z["start"], z["end"], F.coalesce(z["said"]["p"], F.lit(0.0)).alias("p"), z["keep"])))
    hits = lambda z: df.select("query_idx", "path", F.explode(z).alias("z")).select("query_idx", "path", "z.*")
    return df, hits(lines), hits(blocks)


def compare_answers(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """request, kind, i, a, b, state of questions without an answer (missing) and answers without a question (extra); both sides: request, kind, i, a, b."""
    key = ["request", "kind", "i", "a", "b"]
    both = asked.select(*key).distinct().withColumn("q", F.lit(True)).unionByName(answered.select(*key).distinct().withColumn("q", F.lit(False)))
    # Ends may be null (sections), so the sides are compared by one grouping, which takes nulls as equal, as a full outer join would not.
    found = both.groupBy(*key).agg(F.bool_or("q").alias("asked"), F.bool_or(~F.col("q")).alias("given")).where("not (asked and given)")
    return found.select(*key, F.when(F.col("asked"), F.lit("missing")).otherwise(F.lit("extra")).alias("state"))


def triage_scores(paths: DataFrame, make: Callable[[], DecisionBackend], queries: list[str], ledger: Ledger, jobs: int = 32, model: str = "") -> DataFrame:
    """path, p: which paths (path, ord) are worth opening, asked in batches; a path without an answer has 1, a failed request is an error."""
    task = {"task": TRIAGE_TASK, "query": " | ".join(queries)}
    batches = paths.groupBy(F.floor(F.col("ord") / BATCH).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("ord", "path"))).alias("held"))
    rows = batches.select(F.transform("held", lambda x: x["path"]).alias("paths"), F.transform("held", lambda x, k: about("path", k)).alias("asked"))
    requests = rows.withColumn("request", F.sha2(F.concat(F.lit(json.dumps([model, task, KINDS["path"]])), F.to_json(F.struct("paths"))), 256))

    def as_sent(row: dict) -> tuple[dict, dict]:
        state = task | {"paths": {f"p{k}": p for k, p in enumerate(row["paths"])}}
        return state, dict(wire(q, {"path": row["paths"][q["i"]]}) for q in row["asked"])

    answered = ledger.answered(requests, lambda new: ask(new, make, as_sent, jobs))
    failed = answered.where("error_kind is not null").select("error").first()
    if failed:
        raise DecisionError("api", failed["error"])
    p = F.coalesce(_said("path", F.col("k"))["p"], F.lit(1.0))
    return answered.select("answers", F.posexplode("paths").alias("k", "path")).select("path", p.alias("p")).groupBy("path").agg(F.max("p").alias("p"))
