"""The search engine on small inputs: hand-worked cases, invariants, and the golden three-line file."""

import http.server
import io
import json
import random
import re
import threading
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievely import cli
from sievely.functions import lines
from sievely.functions import text as tx
from sievely.operators import decide, evaluate, filters, fold, questions, render, rulecheck, scoring, segment, select
from sievely.progress import Progress
from sievely.sources import backends, credentials, files, ledger
from sievely.streaming import search as streaming


def blocks(spark, said):
    rows = segment.split_blocks(spark.createDataFrame([("f", "\n".join(said) + "\n")], "path string, text string")).orderBy("start").collect()
    return [(r["start"], r["end"]) for r in rows]


#: Pieces of lines: white space of all kinds, characters that only look like it, words of definitions, long runs.
PIECES = ["", " ", "  ", "\t", "\u2003", "\x1c", "\xa0", "\x85", "\u200b", "\u3000", "é", "日本", "x", "def ", "def", "pub(crate) ", "pub (", "pub", "async fn go", "macro_rules!", "macro_rules", "modx", "mod é", "static class", "const", "\x0c", "\x0b", "y" * 299, "z" * 301, " " * 310, "\r", "export default function"]


def plain_lines(text):
    parts = text.replace("\r\n", "\n").split("\n")
    return parts if parts[-1] else parts[:-1]


def plain_line(raw):
    """text, blank, indent, definition by the rules for one line."""
    text = raw.rstrip(tx.WHITE_SPACE)
    text = text[:300] + " ..." if len(text) > 300 else text
    return text, not text, len(text) - len(text.lstrip(tx.WHITE_SPACE)), bool(re.match(tx.DEFINITION, text, re.A))


def test_line_index(spark):
    rng = random.Random(8)
    texts = ["a\nb\n", "a\r\nb", "", None, "\n", "a\rb\n\n", "\r\n", "x\r", " " * 300 + "y", "\n\nq", "last", "\nfirst"]
    texts += ["".join(rng.choice(PIECES) + rng.choice(["", "", "\n", "\r\n"]) for _ in range(rng.randrange(30))) for _ in range(150)]
    got = lines.Lines(pa.array(texts, pa.string()))
    want = [(k, n, raw, *plain_line(raw)) for k, t in enumerate(texts) for n, raw in enumerate(plain_lines(t or ""), 1)]
    columns = (got.row, got.number, got.raw, got.clipped, got.blank, got.indent, got.definition)
    assert list(zip(*(c.tolist() if hasattr(c, "tolist") else c.to_pylist() for c in columns), strict=True)) == want
    assert got.length.tolist() == [len(w[3]) for w in want] and got.costs(1.0).tolist() == [6 + len(w[3]) // 3 + 30 for w in want]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")
    table = segment.line_table(df).collect()
    assert sorted((int(r["path"]), r["line"], r["raw"], r["text"], r["blank"], r["indent"], r["definition"]) for r in table) == want
    assert lines.lines_of("a\r\nb") == ["a", "b"] and len(lines.Lines(pa.array([], pa.string()))) == 0


def test_passes_bound_their_bytes():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * 900_000, None, "y" * 900_000, "z" * 5_000_000, "", "w"])})
    assert [b.num_rows for b in lines.passes(iter([batch]))] == [3, 1, 2]


def plain_blocks(told):
    """Blocks by a loop over lines; told: (text, blank, indent, definition)."""
    out, start, last, base, inner = [], None, None, 0, 10**6
    for n, (_, blank, indent, definition) in enumerate(told, 1):
        if blank:
            continue
        if start is not None:
            size, apart = n - start, n - last > 1
            member = indent <= min(inner, base + 8) and definition and (indent <= base or size >= 6)
            long = size >= 6 and (indent <= base or (indent <= inner and size >= 12) or size >= 40)
            if size >= 50 or (apart and (indent < base or member or long)):
                out.append((start, last))
                start = None
            elif indent > base:
                inner = min(inner, indent)
        if start is None:
            start, base, inner = n, indent, 10**6
        last = n
    return out + [(start, last)] if start is not None else out


def plain_chunks(told, found, most, tokens):
    """(start, end, pieces) by a loop over blocks."""
    cost = [6 + len(t) // 3 + 30 for t, *_ in told]
    pieces = []
    for a, b in found:
        while a <= b:
            z = a
            while z < b and z - a + 1 < most and sum(cost[a - 1 : z + 1]) <= tokens:
                z += 1
            pieces.append((a, z))
            a = z + 1
    out = []
    for a, b in pieces:
        if out and b - out[-1][0][0] + 1 <= most and sum(sum(cost[x - 1 : y]) for x, y in [*out[-1], (a, b)]) <= tokens:
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return [(c[0][0], c[-1][1], c) for c in out]


def test_blocks_and_chunks_by_plain_loops():
    rng = random.Random(12)
    for _ in range(40):
        texts = ["\n".join(rng.choice(["", "", "  ", "    ", "        "]) + rng.choice(["x", "", "", "def f():", "class A", "y = 1", "z " * 40]) for _ in range(rng.randrange(260))) for _ in range(3)]
        index = lines.Lines(pa.array(texts))
        first, last = segment.blocks_of(index)
        most, tokens = rng.choice([(150, 14_000), (40, 900), (7, 120), (1, 1)])
        starts, ends, heads = segment.chunks_of(index, segment.Chunking(most, tokens))
        for k, text in enumerate(texts):
            told = [plain_line(x) for x in plain_lines(text)]
            mine = index.row[first] == k
            found = list(zip(index.number[first[mine]].tolist(), index.number[last[mine]].tolist(), strict=True))
            assert found == plain_blocks(told)
            spans = [(a, b) for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(starts)], strict=True) if index.row[starts[a]] == k]
            got = [(int(index.number[starts[a]]), int(index.number[ends[b - 1]]), [(int(index.number[x]), int(index.number[y])) for x, y in zip(starts[a:b], ends[a:b], strict=True)]) for a, b in spans]
            assert got == plain_chunks(told, found, most, tokens)


GLOBS = [("src/a.py", "*.py", True), ("src/a.py", "src/?.py", True), ("a.py", "[!b].py", True), ("b.py", "[!b].py", False), ("a[.py", "a[.py", True), ("a]", "[]]x", False), ("x/y/z.c", "x*z.c", True), ("A.py", "a.py", False), ("a.py", "[a-c].py", True), ("a\nb", "a?b", True)]


def test_globs(spark):
    for text, pattern, want in GLOBS:
        got = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(tx.glob_regex(pattern))).first()[0]
        assert (got, tx.py_glob(text, pattern)) == (want, want), (text, pattern)
    paths = spark.createDataFrame([("src/app/main.py",), ("docs/x.md",)], "p string")
    assert paths.where(tx.path_matches(F.col("p"), ["app/*.py"])).count() == 1


def test_blocks_by_paragraph_and_length(spark):
    assert blocks(spark, ["a", "b", "", "c"]) == [(1, 4)]  # under six lines a paragraph does not part them
    assert blocks(spark, ["def a():", "  x", "", "def b():", "  y"]) == [(1, 2), (4, 5)]
    assert blocks(spark, ["  a", "", "b"]) == [(1, 1), (3, 3)]
    assert blocks(spark, [f"l{k}" for k in range(120)]) == [(1, 50), (51, 100), (101, 120)]
    assert blocks(spark, ["", "", "x", "", ""]) == [(3, 3)]
    assert blocks(spark, ["", " "]) == []


def test_chunks_cover_and_bound(spark):
    rng = random.Random(5)
    rows = [(f"f{k}", "".join(rng.choice(["", "  ", "    "]) + rng.choice(["def x():", "y = 1", "", "z " * 90]) + "\n" for _ in range(rng.randrange(1, 400)))) for k in range(12)]
    cfg = segment.Chunking(max_lines=40, max_tokens=900)
    got = segment.chunk_files(spark.createDataFrame(rows, "path string, text string"), cfg).collect()
    for path, text in rows:
        said = text.split("\n")[:-1]
        mine = sorted((c for c in got if c["path"] == path), key=lambda c: c["start"])
        inside = [n for c in mine for b in c["blocks"] for n in range(b["start"], b["end"] + 1)]
        assert len(inside) == len(set(inside))
        assert {n for n, x in enumerate(said, 1) if x.strip()} <= set(inside)
        for c in mine:
            assert c["end"] - c["start"] < 40
            assert c["lines"] == [plain_line(x)[0] for x in said[c["ctx_start"] - 1 : c["end"]]]


def test_halves(spark):
    def halves(start, spans):
        df = spark.createDataFrame([("f", 15, start, 59, spans, [f"l{n}" for n in range(15, 60)], 7)], segment.CHUNK + ", other int")
        return [(r["ctx_start"], r["start"], r["end"], [tuple(b) for b in r["blocks"]], r["lines"], r["other"]) for r in segment.halve(df).orderBy("half").collect()]

    said = lambda a, b: [f"l{n}" for n in range(a, b + 1)]
    assert halves(20, [(20, 33), (34, 47), (49, 59)]) == [(15, 20, 33, [(20, 33)], said(15, 33), 7), (22, 34, 59, [(34, 47), (49, 59)], said(22, 59), 7)]
    one, two = halves(20, [(20, 59)])  # within a block: at the middle line
    assert (one[3], two[3], two[1]) == ([(20, 39)], [(40, 59)], 40)
    assert halves(59, [(59, 59)]) == []


def test_oversize_blocks_are_cut(spark):
    """A block over the line budget, and lines over the token budget each."""
    df = spark.createDataFrame([("a", "".join(f"x{k}\n" for k in range(45))), ("b", "z" * 290 + "\n" + "y\n" * 3)], "path string, text string")
    got = {p: sorted((r["start"], r["end"]) for r in segment.chunk_files(df, segment.Chunking(max_lines=20, max_tokens=n, context=0)).collect() if r["path"] == p) for p, n in (("a", 10**6), ("b", 100))}
    assert got == {"a": [(1, 20), (21, 40), (41, 45)], "b": [(1, 1), (2, 3), (4, 4)]}


def test_white_space_of_unicode(spark):
    """Columns agree with the line index on white space beyond ASCII, and on what is none."""
    rows = ["\u2003x\u2003", "\x1cx\x1c", "\xa0", "\x85 y", "\u200bz\u200b", "\x1c", "x\u3000"]
    got = spark.createDataFrame([(i, plain_line(t)[0]) for i, t in enumerate(rows)], "i int, t string").select("i", tx.indent(F.col("t")), tx.blank(F.col("t")), tx.is_definition(F.col("t"))).orderBy("i").collect()
    index = lines.Lines(pa.array([t + "\n" for t in rows]))
    assert [tuple(r)[1:] for r in got] == list(zip(index.indent.tolist(), index.blank.tolist(), index.definition.tolist(), strict=True))


PHRASES = [
    ("Just the parsers. Omit generated code", [["parsers"]], ["generated code"]), ("without logs, caches nor locks", [], ["logs", "caches", "locks"]),
    ("network layer", [["network layer"]], []), ("java & kotlin", [["java", "kotlin"]], []), ("keep only go but never mocks", [["go"]], ["mocks"]),
    ("skip the build scripts; include readmes", [["readmes"]], ["build scripts"]), ("do not return any tables", [], ["tables"]), ("hide mocks, sources only", [], ["mocks", "sources"]), ("hide mocks, sources only, logs", [["sources", "logs"]], ["mocks"]),
    ("minus fonts, include icons, images", [["icons", "images"]], ["fonts"]), ("no , fonts", [], ["fonts"]), ("ignore fonts\nfonts only", [["fonts"]], ["fonts"]), ("; . ,,", [], []),
]


@pytest.mark.parametrize("text,only,exclude", PHRASES)
def test_filter_phrases(text, only, exclude):
    rules = filters.parse(text)
    assert (rules.only, rules.exclude) == (only, exclude)


def test_filter_column_equals_python(spark):
    rules = filters.Rules([["a", "b"], ["c"]], ["d"])
    rows = [(0.9, 0.1, 0.8, 0.3), (None, 0.2, 0.9, 0.1), (0.1, 0.2, 0.3, 0.4)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(rules.passes_column({k: F.col(k) for k in "abcd"})).collect()]
    assert got == [rules.passes({k: v for k, v in zip("abcd", r, strict=True) if v is not None}) for r in rows]
    assert rules.describe() == "only a or b; only c; not d"


def selected(spark, cases, lim=select.Limits()):
    """Per case (blocks, lines, score) the file shown, or None; all cases in one run."""
    files_, blocks_, lines_ = [], [], []
    for k, (b, h, score) in enumerate(cases):
        files_.append((0, f"f{k}", score, 0.9, 1.0))
        blocks_ += [(0, f"f{k}", a, z, p, f"l{a}", a, 1.0) for a, z, p in b]
        lines_ += [(0, f"f{k}", n, p, f"t{n}", 1.0, 1.0) for n, p in h]
    f = spark.createDataFrame(files_, "query_idx int, path string, score double, confidence double, keep double")
    b = spark.createDataFrame(blocks_, "query_idx int, path string, start int, end int, p double, label string, label_line int, keep double")
    h = spark.createDataFrame(lines_, "query_idx int, path string, line int, p double, text string, section double, keep double")
    shown = {x["path"]: x for x in render.collect(select.select(f, h, b, lim)).get(0, [])}
    return [shown.get(f"f{k}") for k in range(len(cases))]


def test_selection_cases(spark):
    held, joined, apart, quiet, cold, lone, label, again, passed = selected(spark, [
        ([(4, 9, 0.8)], [(6, 0.7), (12, 0.55)], 0.7),  # a line in a region, one outside
        ([(1, 6, 0.6), (8, 12, 0.9)], [], 0.7),  # one line between: one region
        ([(1, 6, 0.6), (9, 12, 0.9)], [], 0.7),  # two lines between: two
        ([(3, 8, 0.36), (10, 14, 0.41), (20, 25, 0.38)], [], 0.61),  # near misses: the two best
        ([(3, 8, 0.34)], [(4, 0.49)], 0.99),  # nothing comes near
        ([(3, 8, 0.45)], [(30, 0.52)], 0.1),  # a line alone; its file need not be relevant
        ([(5, 9, 0.9)], [(5, 0.99), (7, 0.5)], 0.2),  # the label's line is not said twice
        ([], [(2, 0.51), (2, 0.77), (2, 0.6)], 0.2),  # a line's best
        ([(3, 8, 0.45)], [], 0.59),  # near, but the file is not relevant
    ])
    spans = lambda f: [(r["start"], r["end"], r["p"]) for r in f["regions"]]
    assert spans(held) == [(4, 9, 0.8)] and [h["line"] for h in held["regions"][0]["lines"]] == [6] and [h["line"] for h in held["lines"]] == [12] and held["relevance"] == 0.8
    assert spans(joined) == [(1, 12, 0.9)] and joined["regions"][0]["label"] == "l1" and spans(apart) == [(1, 6, 0.6), (9, 12, 0.9)]
    assert quiet["weak"] and spans(quiet) == [(10, 14, 0.41), (20, 25, 0.38)] and cold is None and passed is None
    assert not lone["regions"] and not lone["weak"] and [h["line"] for h in lone["lines"]] == [30] and lone["relevance"] == 0.52
    assert [h["line"] for h in label["regions"][0]["lines"]] == [7] and label["relevance"] == 0.9
    assert [(h["line"], h["p"]) for h in again["lines"]] == [(2, 0.77)]


def test_selection_caps(spark):
    many = ([(20 * k, 20 * k + 3, 0.9 - k / 50) for k in range(1, 6)], [(20 * k + 2, 0.6 + k / 100) for k in range(1, 6)] + [(500 + k, 0.5 + k / 10) for k in range(3)], 0.3)
    (f,) = selected(spark, [many], select.Limits(max_regions=2, max_lines=3))
    # Lines of dropped regions go with them; of the five that are left the best three stay.
    assert [r["start"] for r in f["regions"]] == [20, 40] and f["more_regions"] == 3 and f["more_lines"] == 2
    assert sorted([h["line"] for h in f["lines"]] + [h["line"] for r in f["regions"] for h in r["lines"]]) == [22, 42, 502]


def test_selection_tiers(spark):
    """The best files first, the weak ones behind them, as far as there is room."""
    cases = [([(1, 5, 0.5 + k / 100)], [], 0.5) for k in range(4)] + [([(1, 5, 0.4)], [], 0.7 + k / 100) for k in range(8)]
    for top, strong, weak in ((3, [3, 2, 1], []), (6, [3, 2, 1, 0], [11, 10]), (20, [3, 2, 1, 0], [11, 10, 9, 8, 7])):
        files_ = [f for f in selected(spark, cases, select.Limits(top=top)) if f]
        order = [int(f["path"][1:]) for f in sorted(files_, key=lambda f: f["place"])]
        assert order == strong + weak


def test_rank(spark):
    df = spark.createDataFrame([(0.6, 0.2, 0.65), (0.2, 0.6, 0.65), (0.0, 0.3, 0.3)], "s double, e double, want double")
    assert all(abs(r[0] - r[1]) < 1e-12 for r in df.select(fold.rank_of(F.col("s"), F.col("e")), "want").collect())


GOLDEN = "a = 1\nneedle = 2\nb = 3\n"


def golden(spark, backend):
    files_ = spark.createDataFrame([("t.py", GOLDEN)], "path string, text string")
    chunks = segment.chunk_files(files_)
    if backend:
        asking = questions.Asking(["find needle"])
        asked = questions.ask_chunks(chunks, lambda: backends.LexicalBackend(["needle"], 3), asking, ledger.Ledger(spark))
        scored, found, hits = questions.score_answers(asked, asking)
    else:
        scored = scoring.score_chunks(chunks, scoring.Search([["needle"]]))
        found, hits = scoring.line_hits(scored), scoring.block_hits(scored)
    return fold.fold_files(scored), select.select(fold.fold_files(scored), found, hits)


def test_golden_file(spark):
    folded, sel = golden(spark, False)
    shown = render.collect(sel)[0]
    assert render.flat(shown) == "t.py:1-3:0.90:a = 1\nt.py:2:0.95:needle = 2\n"
    assert json.loads(render.json_lines("find needle", shown))["regions"] == [{"start": 1, "end": 3, "p": 0.9, "label": "a = 1", "label_line": 1, "lines": [{"line": 2, "p": 0.95, "text": "needle = 2"}]}]
    text = render.grouped(shown, context=1, source={"t.py": GOLDEN.splitlines()})
    assert text == "t.py  relevance=1.00\n        1-3  0.90  a = 1\n          2  0.95  needle = 2\n          3        b = 3\n\n"
    assert render.files_lines("find needle", select.select_files(folded), True) == '{"query":"find needle","path":"t.py","relevance":1.0,"confidence":0.9}\n'


def test_golden_file_by_a_backend(spark):
    """The chunk is halved until its questions fit; the file's answers are folded again, and the block is cut where the chunk was."""
    folded, sel = golden(spark, True)
    shown = render.collect(sel)[0]
    assert [(f["score"], f["confidence"]) for f in folded.collect()] == [(1.0, 0.9)] and [(x["start"], x["end"], x["label"]) for f in shown for x in f["regions"]] == [(2, 2, "needle = 2")]


def test_backend_path_equals_columns_and_splits(spark):
    text = "".join(f"def f{k}():\n" + ("    needle\n" if k == 4 else "    x = 1\n") + "    y = 2\n\n" for k in range(12))
    chunks, asking = segment.chunk_files(spark.createDataFrame([("t.py", text)], "path string, text string")), questions.Asking(["q"])
    asked = questions.ask_chunks(chunks, lambda: backends.LexicalBackend(["needle"], 20), asking, ledger.Ledger(spark))
    assert asked.count() > 1
    _, found, hits = questions.score_answers(asked, asking)
    native = scoring.score_chunks(chunks, scoring.Search([["needle"]]))
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert key(found, "line", "p") == key(scoring.line_hits(native), "line", "p")
    assert key(hits, "start", "end", "p") == key(scoring.block_hits(native), "start", "end", "p")


def test_filter_answers_by_a_backend(spark):
    """Sections and blocks under filter terms: a block passes by its own answer or by its section's."""
    chunks = segment.chunk_files(spark.createDataFrame([("t.py", "def a():\n    good\n\ndef b():\n    x\n")], "path string, text string"))
    rules, asking = filters.parse("only good"), questions.Asking(["q", "r"], ["good"])
    answered = questions.chunk_requests(chunks, asking).select("*", F.expr("transform(asked, x -> struct(x.kind, x.i, x.a, x.b, case when x.kind = 'category' then 0.1D when x.kind = 'category_block' then if(x.a = 1, 0.9D, 0.2D) else 0.7D end as p, 0.5D as confidence))").alias("answers"), F.lit(None).cast("string").alias("error_kind"))
    scored, found, hits = questions.score_answers(answered, asking, rules)
    assert sorted((x["query_idx"], x["start"], x["keep"]) for x in hits.collect()) == [(q, a, k) for q in (0, 1) for a, k in ((1, 0.9), (4, 0.2))]
    assert {(x["line"], x["keep"]) for x in found.collect()} == {(1, 0.9), (2, 0.9), (4, 0.2), (5, 0.2)} and {x["section_keep"] for x in scored.collect()} == {0.1}


def test_unsplittable_chunk_is_an_error_row(spark):
    chunks = segment.chunk_files(spark.createDataFrame([("t", "x\n")], "path string, text string"))
    row = questions.ask_chunks(chunks, lambda: backends.LexicalBackend(["x"], 0), questions.Asking(["q"]), ledger.Ledger(spark)).first()
    assert row["error_kind"] == "token_limit"


def test_request_shape(spark):
    asking = questions.Asking(["one", "two"], ["tests"])
    row = spark.createDataFrame([("a.py", 1, 1, 2, [(1, 2)], ["def a():", "}"])], segment.CHUNK).withColumn("asked", questions.chunk_questions(asking)).first().asDict(recursive=True)
    state, asked = questions.chunk_request(row, asking)
    assert list(state) == ["task", "queries", "file", "shown_lines", "code"] and state["code"] == "1| def a():\n2| }"
    assert list(asked) == ["F0.S", "F0.B1-2", "q0.rel", "q0.B1-2", "q0.L1", "q1.rel", "q1.B1-2", "q1.L1"]
    assert asked["q0.L1"]["instructions"] == "Does line 1 of the code directly answer query q0 (one)?" and asked["F0.S"]["instructions"].endswith("category: tests?")
    assert asked["q1.rel"] == {"type": "score", "instructions": "How relevant is this section of a.py to the query: two", "criteria": questions.LEVELS}
    one = [q for q in row["asked"] if q["kind"] in ("section", "line") and q["i"] == 0]
    broad = questions.chunk_request(row | {"asked": one}, questions.Asking(["one"], broad=True))
    assert broad[1]["q0.L1"]["instructions"] == "Is line 1 of the code relevant to the query?" and broad[0]["query"] == "one"
    few = spark.createDataFrame([("a.py", 1, 1, 2, [(1, 2)], ["x", "y"])], segment.CHUNK).select(questions.chunk_questions(questions.Asking(["one"], ["t"], files_only=True)).alias("x")).first()["x"]
    assert [(q["kind"], q["i"], q["a"]) for q in few] == [("category", 0, None), ("section", 0, None)]


class Service(http.server.BaseHTTPRequestHandler):
    """Answers every question, counts requests, and how many are there at a time."""

    lock, seen, running, most, wait, broken = threading.Lock(), [], 0, 0, 0.0, set()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with Service.lock:
            Service.seen.append(body["state"].get("file"))
            Service.running += 1
            Service.most = max(Service.most, Service.running)
        time.sleep(Service.wait)
        answers = {k: {"type": "score", "score": 3.0, "confidence": 0.5} if q["type"] == "score" else {"type": "noul", "noul": 0.7} for k, q in body["questions"].items()}
        with Service.lock:
            Service.running -= 1
        self.send_response(422 if body["state"].get("file") in Service.broken else 200)
        self.end_headers()
        self.wfile.write(json.dumps({"answers": answers}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    Service.seen, Service.running, Service.most, Service.wait, Service.broken = [], 0, 0, 0.0, set()
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_nothing_is_asked_twice(spark, service, tmp_path):
    make, asking = lambda: backends.HttpBackend(service), questions.Asking(["q"])
    chunks = lambda n: segment.chunk_files(spark.createDataFrame([(f"f{k}", f"x{k}\n") for k in range(n)], "path string, text string"))
    book = ledger.Ledger(spark, str(tmp_path / "answers"))
    Service.broken = {"f3"}
    asked = questions.ask_chunks(chunks(5), make, asking, book).persist()
    assert asked.count() == 5 and [x["path"] for x in asked.where("error_kind is not null").collect()] == ["f3"] and len(Service.seen) == 5
    asked.unpersist(True)  # as if its blocks were lost
    assert asked.count() == 5 and questions.score_answers(asked, asking)[1].count() == 4 and len(Service.seen) == 5
    Service.broken = set()
    again = questions.ask_chunks(chunks(7), make, asking, ledger.Ledger(spark, book.path))
    assert again.where("error_kind is null").count() == 7
    assert sorted(Service.seen[5:]) == ["f3", "f5", "f6"]  # the failure of before and what is new
    questions.ask_chunks(chunks(7), make, questions.Asking(["other"]), book)
    assert len(Service.seen) == 15  # another question is another request


@pytest.mark.parametrize("jobs", [1, 3])
def test_jobs_bound_the_requests_of_all_tasks(spark, service, jobs):
    Service.wait = 0.15
    chunks = segment.chunk_files(spark.createDataFrame([(f"f{k}", f"x{k}\n") for k in range(12)], "path string, text string").repartition(6))
    answered = questions.ask_chunks(chunks, lambda: backends.HttpBackend(service, jobs=99), questions.Asking(["q"]), ledger.Ledger(spark), jobs)
    assert answered.count() == 12 and len(Service.seen) == 12 and Service.most == jobs


def test_triage_asks_in_batches(spark, service, monkeypatch):
    monkeypatch.setattr(questions, "BATCH", 4)
    paths = spark.createDataFrame([(f"p{k}", k) for k in range(10)], "path string, ord long")
    got = questions.triage_scores(paths, lambda: backends.HttpBackend(service), ["q"], ledger.Ledger(spark), 2)
    assert {x["path"]: x["p"] for x in got.collect()} == {f"p{k}": 0.7 for k in range(10)} and len(Service.seen) == 3
    words = questions.triage_scores(paths, lambda: backends.LexicalBackend(["p3"]), ["r"], ledger.Ledger(spark))
    assert {x["path"] for x in words.where("p > 0.5").collect()} == {"p3"}


def test_typed_decisions(spark, tmp_path):
    """Typed columns of what a service says about rows; wrong answers are errors of their row, and nothing is asked twice."""
    asked = {"spam": decide.YesNo("Spam?", yes="an advertisement"), "what": decide.Choice.labels("What?", "mail").option("chat", "short talk"), "tone": decide.Score("Polite?", "rude", "plain", "kind")}
    assert [q.wire() for q in asked.values()] == [
        {"type": "noul", "instructions": "Spam?", "criteria": {"true": "an advertisement"}}, {"type": "choice", "instructions": "What?", "criteria": {"mail": None, "chat": "short talk"}},
        {"type": "score", "instructions": "Polite?", "criteria": ["rude", "plain", "kind"]},
    ]
    counted = str(tmp_path / "asked")

    def make():
        class Service:
            def ask(self, state, questions):
                with open(counted, "a") as f:
                    f.write("x")
                good = {"spam": {"noul": 0.25}, "what": {"choice": "chat", "confidence": 0.5, "probabilities": {"chat": 0.75, "mail": 0.25}}, "tone": {"score": 1.5, "confidence": 1, "probabilities": {"1": 0.5, "2": 0.5}}}
                wrong = {"label": {"what": good["what"] | {"choice": "post"}}, "level": {"tone": good["tone"] | {"score": 2.5}}, "share": {"spam": {"noul": 7}}, "none": {"spam": None}}
                if state["body"] is None:
                    raise backends.DecisionError("invalid_request", "no text")
                return good | wrong.get(state["body"], {})

        return Service()

    rows = spark.createDataFrame([(k, b) for k, b in enumerate(["fine", "label", "level", "share", "none", None, "fine"])], "id int, body string")
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    got = {r["id"]: r.asDict(recursive=True) for r in decide.decide(rows, ["body"], asked, make, book).collect()}
    fine = {"spam": 0.25, "what": {"choice": "chat", "confidence": 0.5, "probabilities": {"mail": 0.25, "chat": 0.75}}, "tone": {"score": 1.5, "confidence": 1.0, "probabilities": [0.0, 0.5, 0.5]}}
    assert all({c: got[k][c] for c in asked} == fine and got[k]["error_kind"] is None for k in (0, 6))
    assert [got[k]["error_kind"] for k in range(1, 6)] == ["api"] * 4 + ["invalid_request"] and all(got[k]["what"] is None for k in range(1, 6))
    assert len((tmp_path / "asked").read_text()) == 6  # equal rows are one request
    assert decide.decide(rows.where("id = 0"), ["body"], asked, make, book).first()["spam"] == 0.25 and len((tmp_path / "asked").read_text()) == 6
    for wrong in (lambda: decide.Score("x", "one"), lambda: decide.Choice.labels("x"), lambda: decide.Choice.labels("x", "a", "a"), lambda: decide.decide(rows, ["body"], {"ID": asked["spam"]}, make, book)):
        with pytest.raises(ValueError):
            wrong()


def test_answers_are_held_against_questions(spark):
    schema = "request string, kind string, i int, a int, b int"
    asked = spark.createDataFrame([("x", "section", 0, None, None), ("x", "block", 0, 1, 2), ("y", "line", 1, 3, 3), ("y", "line", 1, 3, 3)], schema)
    given = spark.createDataFrame([("x", "section", 0, None, None), ("y", "line", 1, 4, 4), ("z", "section", 0, None, None)], schema)
    found = {(x["request"], x["kind"], x["a"]): x["state"] for x in questions.compare_answers(asked, given).collect()}
    assert found == {("x", "block", 1): "missing", ("y", "line", 3): "missing", ("y", "line", 4): "extra", ("z", "section", None): "extra"}


def test_discover_and_cli(spark, tmp_path, monkeypatch, capsys):
    for name, text in {"a.py": GOLDEN, "b.min.js": "needle", ".gitignore": "skip/\n*.log\n!keep.log\n", "skip/c.py": "needle", "x.log": "needle", "keep.log": "needle\n", "vendor/d.py": "needle", ".h/e.py": "needle", "bin.txt": "a\0b"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    monkeypatch.chdir(tmp_path)
    shown = lambda **o: sorted(r["path"] for r in files.discover(spark, ["."], files.Discover(**o)).collect())
    assert shown() == ["a.py", "bin.txt", "keep.log"]
    assert shown(globs=["*.py"], no_ignore=True) == ["a.py", "skip/c.py"]
    assert [r["path"] for r in files.discover(spark, ["b.min.js"]).collect()] == ["b.min.js"]
    assert [r["path"] for r in files.discover(spark, ["b.min.js"], files.Discover(excludes=["*.js"])).collect()] == []
    assert cli.main(["find needle", "a.py", "--no-heading"]) == 0
    assert capsys.readouterr().out == "a.py:1-3:0.90:a = 1\na.py:2:0.95:needle = 2\n"
    assert cli.main(["absent", "a.py"]) == 1
    assert cli.main(["needle", "a.py", "keep.log", "--triage", "--stats", "-l"]) == 1  # no path holds the word
    assert "triage kept 0 of 2" in capsys.readouterr().err
    assert cli.main(["x", "nowhere"]) == 2
    (tmp_path / "cr.py").write_text("top\nneedle\x0c\n\n\x1czz\n")
    assert cli.main(["needle", "cr.py", "-C", "2"]) == 0 and "          4        \x1czz\n" in capsys.readouterr().out
    (tmp_path / ".git" / "info").mkdir(parents=True)
    (tmp_path / ".git" / "info" / "exclude").write_text("a.py\n")
    assert shown() == ["bin.txt", "cr.py", "keep.log"]


def plain_walk(root):
    """Files of a tree by recursion, under ignore files that hold plain names and *.ending only."""
    out = []

    def visit(folder, dead):
        own = folder / ".gitignore"
        dead = dead | (set(own.read_text().split()) if own.exists() else set())
        for x in folder.iterdir():
            if x.name.startswith(".") or x.name in dead or f"*{x.suffix}" in dead or x.name in files.SKIP_DIRS:
                continue
            visit(x, dead) if x.is_dir() else out.append(str(x.relative_to(root)))

    visit(root, set())
    return sorted(out, key=lambda p: p.split("/"))


def test_listing_in_rounds(spark, tmp_path):
    """Directories are handed on with the ignore files that hold in them; the order is that of names, whatever task lists what."""
    rng = random.Random(21)
    folders = [tmp_path / "tree"]
    for k in range(60):
        folders.append(rng.choice(folders) / rng.choice([f"d{k}", f"e{k}", "build", "skip"]))
    for k, folder in enumerate(folders):
        folder.mkdir(parents=True, exist_ok=True)
        for n in range(rng.randrange(8)):
            (folder / f"f{n}{rng.choice(['.py', '.log', '.txt'])}").write_text("x")
        if rng.random() < 0.2:
            (folder / ".gitignore").write_text(rng.choice(["skip\n", "*.log\n", "f1.py\n*.txt\n"]))
    (tmp_path / "tree" / ".git").mkdir()
    want = plain_walk(tmp_path / "tree")
    (tmp_path / "tree" / "link.py").symlink_to(tmp_path / "tree" / want[0])
    want = [p for p in want if (tmp_path / "tree" / p).stat().st_size]
    for most in (1, 25, 10**6):
        rows = files.discover(spark, [str(tmp_path / "tree")], most=most).orderBy("ord").collect()
        got = [r["location"].removeprefix(f"{tmp_path}/tree/") for r in rows]
        assert got == sorted(want, key=lambda p: p.split("/")) or got == sorted({"link.py", *want[1:]}, key=lambda p: p.split("/"))
    assert files.discover(spark, [str(tmp_path / "tree"), str(tmp_path / "tree")]).count() == len(want)


def test_an_ignored_root_is_walked_all_the_same(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".gitignore").write_text("out/\n*.tmp\n")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a.tmp").write_text("x")
    assert [r["location"] for r in files.discover(spark, [str(tmp_path / "out")]).collect()] == [f"{tmp_path}/out/a.tmp"]


def test_known_answers_and_audits(spark):
    regions = "array<struct<start:int,end:int,p:double,label:string,label_line:int>>"
    kept = "array<struct<line:int,p:double,text:string,section:double,region:int>>"
    shown = spark.createDataFrame([
        (0, "x/a.py", False, 1, [(60, 200, 0.9, "l", 60)], [(10, 0.6, "t", 1.0, None), (60, 0.7, "t", 1.0, 60)]), (0, "x/b.py", True, 2, [(1, 5, 0.36, "l", 1), (9, 12, 0.2, "l", 9)], []), (1, "y/b.py", False, 1, [], [(3, 0.4, "t", 1.0, None)]),
    ], f"query_idx int, path string, weak boolean, place int, regions {regions}, lines {kept}")
    cases = spark.createDataFrame([(1, 0, "pin", "/a.py", 10, 10), (2, 0, "pin", "/a.py", 198, 260), (2, 0, "pin", "/a.py", 1, 2), (3, 0, "broad", "/b.py", 1, 5), (4, 1, "pin", "/c.py", 1, 9)], "case int, query_idx int, kind string, suffix string, lo int, hi int")
    known = evaluate.known_answers(shown, cases)
    assert sorted(map(tuple, known.collect())) == [(1, 0, "pin", 1, 0.0, 0.6), (2, 0, "pin", 1, 0.9, 0.0), (3, 0, "broad", 2, 0.0, 0.0), (4, 1, "pin", 0, 0.0, 0.0)]
    assert tuple(evaluate.tally(known).first()) == (4, 2, 1, 3, 1)
    assert sorted(map(tuple, evaluate.audits(shown).collect())) == [(0, 1, 1, 1, 2, 1, 1), (1, 1, 0, 0, 1, 1, 0)]


def test_rules(spark, tmp_path):
    assert [c.label for c in rulecheck.parse_rules("# T\n\n- [A-1] no needles\n- [B] x\n")] == ["A-1", "B"]
    for bad in ("prose", "- [A] x\n- [A] y", "- [a b] x", "", "- [A] "):
        with pytest.raises(ValueError):
            rulecheck.parse_rules(bad)
    source, binary = tmp_path / "s.py", tmp_path / "b.bin"
    source.write_text(GOLDEN)
    binary.write_bytes(b"\0")
    plan = rulecheck.prepare(spark, "- [A] no needle here", [str(source), str(binary)], 8)
    assert plan.decisions == 1 and [g["kind"] for g in plan.gaps] == ["source_unavailable"]
    found, done, usage = plan.evaluate(spark, lambda: backends.LexicalBackend(["needle"]))
    assert (done, [(f["criterion"], f["start"], f["end"]) for f in found], plan.status(found, done)) == (1, [("A", 1, 3)], "incomplete")
    said = json.loads(plan.report("incomplete", found, done, usage, "lexical"))
    assert said["coverage"]["planned"] == 1 and said["backend"] == "lexical" and said["usage"]["requests"] == 1 and said["limits"]["attempts_per_request"] == 1
    assert said["findings"][0]["reason"] == "probability 0.90 that the lines break the requirement: no needle here" and said["findings"][0]["evidence"] == GOLDEN.rstrip("\n")


def test_wrong_answers_are_gaps(spark, tmp_path):
    paths = []
    for name in ("boom", "more", "less", "wide", "text", "nan", "good"):
        (tmp_path / name).write_text(f"{name}\n")
        paths.append(str(tmp_path / name))
    plan = rulecheck.prepare(spark, "- [A] x\n- [B] y", paths, 100)

    def make():
        class Wrong:
            """Answers that are not what was asked for, by the chunk's line."""

            def ask(self, state, asked):
                line = state["code"].split("| ", 1)[1].strip()
                good = {k: {"type": "noul", "noul": {"wide": 1.5, "text": "x", "nan": float("nan")}.get(line, 0.9)} for k in asked}
                if line == "boom":
                    raise OSError("no service")
                return good | {"r9.B1-1": {"noul": 0.9}} if line == "more" else dict(list(good.items())[line == "less" :])

        return Wrong()

    found, done, _ = plan.evaluate(spark, make)
    assert [g["path"] for g in plan.gaps] == paths[:-1] and {g["kind"] for g in plan.gaps} == {"failed"}
    assert (done, [(f["path"], f["criterion"]) for f in found]) == (2, [(paths[-1], "A"), (paths[-1], "B")]) and plan.status(found, done) == "incomplete"


def test_rules_budgets(spark, tmp_path, monkeypatch):
    """A chunk that does not fit is left out whole, and a smaller one behind it may still fit; requests are bounded in number and size."""
    text = "".join(f"def f{k}():\n" + "    a\n" * 9 + "\n" for k in range(30)) + "\n" * 3 + "def tail():\n    b\n"
    (tmp_path / "s.py").write_text(text)
    source = [str(tmp_path / "s.py")]
    whole = rulecheck.prepare(spark, "- [A] x\n- [B] y", source, 1000)
    sizes = [len(r.checks) for r in whole.requests]
    assert whole.decisions == sum(sizes) == 62 and not whole.gaps
    few = rulecheck.prepare(spark, "- [A] x\n- [B] y", source, sizes[0] + sizes[-1])
    assert [(r.start, r.end) for r in few.requests] == [(whole.requests[k].start, whole.requests[k].end) for k in (0, -1)] and len(few.gaps) == len(sizes) - 2
    monkeypatch.setattr(rulecheck, "MAX_REQUESTS", 1)
    assert len(rulecheck.prepare(spark, "- [A] x", source, 1000).requests) == 1
    monkeypatch.setattr(rulecheck, "MAX_REQUEST_BYTES", 100)
    assert {g["reason"] for g in rulecheck.prepare(spark, "- [A] x", source, 1000).gaps} == {"the request would be too large; nothing was cut"}
    assert cli.main(["--rules", str(tmp_path / "r.md"), "--source", source[0]]) == 2


def test_rules_read_original_lines(spark):
    files_ = spark.createDataFrame([("a", "x" * 320 + " needle\n")], "path string, text string")
    assert rulecheck.check(files_, [("A", "needle")]).count() == 1


def test_findings_are_no_failure(spark, tmp_path, capsys):
    (tmp_path / "r.md").write_text("- [A] needle\n")
    (tmp_path / "s.py").write_text(GOLDEN)
    assert cli.main(["--rules", str(tmp_path / "r.md"), "--source", str(tmp_path / "s.py")]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "findings"


def test_progress_on_terminals_only(spark):
    class Terminal(io.StringIO):
        def __init__(self, is_terminal):
            super().__init__()
            self.isatty = lambda: is_terminal

    def slow(batches):
        for batch in batches:
            time.sleep(0.3)
            yield batch

    for is_terminal in (True, False):
        out = Terminal(is_terminal)
        with Progress(spark, out, 0.05):
            spark.range(0, 6, 1, 6).mapInArrow(slow, "id long").collect()
        said = out.getvalue()
        assert ("/6 tasks" in said and said.endswith("\r")) if is_terminal else said == ""


def test_arguments_and_environment(capsys):
    of = lambda *argv, **env: cli.arguments(list(argv), {f"SIEVELY_{k}": v for k, v in env.items()})
    a = of("q", "p", "-n", "3", THRESHOLD="0.7", TOP="9", URL=" ", BACKEND="http")
    assert (a.threshold, a.top, a.url, a.backend, a.paths, a.key_from) == (0.7, 3, None, "http", ["p"], ["env:DECISION_API_KEY"])
    assert of("--rules", "r", "--source", "s", TOP="4", LEDGER="x").source == ["s"]
    for argv, env in ((["q", "-t", "1.5"], {}), (["q"], {"THRESHOLD": "2"}), (["q"], {"TOP": "x"}), (["q"], {"BACKEND": "none"}), (["q", "-j", "0"], {}), (["--rules", "r"], {}), (["--rules", "r", "--source", "s", "--json"], {}), (["q", "--rules", "r", "--source", "s"], {}), (["q", "--plan"], {})):
        with pytest.raises(SystemExit) as e:
            of(*argv, **env)
        assert e.value.code == 2
    capsys.readouterr()


def test_color_policy():
    want = lambda flag="auto", tty=True, **env: render.wants_color(flag, env, tty)
    assert want() and not want(tty=False) and want("always", False, NO_COLOR="1") and not want("never")
    assert not want(NO_COLOR="1") and not want(TERM="dumb", FORCE_COLOR="1") and want(tty=False, CLICOLOR_FORCE="1") and not want(CLICOLOR="0")


def test_http_backend_retries_and_kinds():
    replies = [(429, {"retry-after": "1"}, b""), (500, {}, b"down"), (200, {}, b'{"answers": {"a": {"type": "noul", "noul": 0.5}}, "usage": {"input_tokens": 7, "output_tokens": 1}}')]
    waits = []
    b = backends.HttpBackend("http://localhost:1", post=lambda *_: replies.pop(0), sleep=waits.append)
    assert b.ask({}, {"a": {"type": "noul"}})["a"]["noul"] == 0.5 and b.usage.retries == 2 and b.usage.input_tokens == 7 and 1.0 in waits
    for status, body, kind in ((401, b"", "auth"), (413, b"", "token_limit"), (400, b"max_tokens_exceeded", "token_limit"), (422, b"", "invalid_request"), (404, b"", "api")):
        with pytest.raises(backends.DecisionError) as e:
            backends.HttpBackend("https://h", post=lambda *_, s=status, t=body: (s, {}, t)).ask({}, {})
        assert e.value.kind == kind
    for url in ("http://u:p@h", "ftp://h", "x"):
        with pytest.raises(backends.DecisionError):
            backends.checked_url(url, False)
    with pytest.raises(backends.DecisionError):
        backends.checked_url("http://example.org", True)


def test_limiter():
    now = [0.0]
    lim = backends.Limiter(6.0, clock=lambda: now[0], sleep=lambda s: None)
    lim.done(True)
    lim.done(True)  # the same episode
    assert lim.limit == 3.0
    lim.done(False)
    assert abs(lim.limit - (3 + 1 / 3)) < 1e-12
    for _ in range(9):
        now[0] += 10
        lim.done(True)
    assert lim.limit == 1.0


def test_limiter_admits_as_many_as_it_says():
    lim, seen, most, lock = backends.Limiter(3.0), [0], [0], threading.Lock()

    def work():
        lim.start()
        with lock:
            seen[0] += 1
            most[0] = max(most[0], seen[0])
        time.sleep(0.02)
        with lock:
            seen[0] -= 1
        lim.done(False)

    threads = [threading.Thread(target=work) for _ in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert most[0] == 3 and lim.running == 0


def test_usage_comes_from_the_replies(spark):
    reply = {"answers": {}, "usage": {"input_tokens": 11, "output_tokens": 2, "cost": 0.25}, "service_tier": "flex"}

    def make():
        def post(url, body, headers):
            asked = json.loads(body)["questions"]
            answers = {k: {"type": q["type"], "score": 1.0, "confidence": 0.5} if q["type"] == "score" else {"type": "noul", "noul": 0.7} for k, q in asked.items()}
            return 200, {}, json.dumps(reply | {"answers": answers}).encode()

        return backends.HttpBackend("http://localhost:1", post=post)

    chunks = segment.chunk_files(spark.createDataFrame([(f"f{k}", "x\n") for k in range(7)], "path string, text string"))
    asking = questions.Asking(["q"])
    u = fold.usage_of(questions.ask_chunks(chunks, make, asking, ledger.Ledger(spark))).first()
    assert (u["requests"], u["retries"], u["input_tokens"], u["output_tokens"], u["tier"]) == (7, 0, 77, 14, "flex") and abs(u["reported_cost"] - 1.75) < 1e-9
    none = fold.usage_of(questions.ask_chunks(chunks, lambda: backends.LexicalBackend(["x"]), asking, ledger.Ledger(spark))).first()
    assert none["reported_cost"] is None and none["tier"] is None and none["input_tokens"] == 700


def test_terse_answers():
    asked = {"a": {"type": "noul"}, "b": {"type": "score", "criteria": ["x", "y", "z", "w"]}}
    got = backends.decode_terse(asked, {"0": 40, "1": {"confidence": 90, "probabilities": [0, 0, 50, 50]}})
    assert got["a"]["noul"] == 0.4 and got["b"]["score"] == 2.5
    for bad in ({"0": 40}, {"0": 101, "1": {}}, {"0": 1, "1": {"confidence": 1, "probabilities": [1, 1, 1, 1]}}, {"0": 1, "1": 2, "2": 3}):
        with pytest.raises(backends.DecisionError):
            backends.decode_terse(asked, bad)
    with pytest.raises(backends.DecisionError):
        backends.terse_schema({str(k): {"type": "noul"} for k in range(6000)})
    assert backends.reply_object('<think>{"answers": {"0": 1}}</think> so {"x": 1} {"answers": {"0": 2}} .') == {"answers": {"0": 2}}


def played(transcript, **options):
    """A text backend in front of a transcript [(status, reply)], and what was sent to it: (route, schema, temperature)."""
    sent, backend = [], None

    def post(url, body, headers):
        body = json.loads(body)
        sent.append((url.rsplit("/v1", 1)[1], "text" in body or "response_format" in body, body.get("temperature")))
        status, reply = transcript.pop(0)
        return status, {"retry-after": "400"} if status == 503 else {}, (reply if isinstance(reply, bytes) else json.dumps(reply).encode())

    backends.ChatBackend._known.clear()
    backend = backends.ChatBackend(options.pop("url", "https://h/v1"), post=post, sleep=options.pop("sleep", lambda s: None), **options)
    return backend, sent


def chat_reply(text, **more):
    return {"choices": [{"message": {"content": text}, **more}]}


def responses_reply(text, **more):
    return {"status": "completed", "output": [{"type": "reasoning", "content": []}, {"type": "message", "content": [{"type": "output_text", "text": text}]}], **more}


ASKED = {"a": {"type": "noul"}}
SAID = '{"answers": {"0": 30}}'


def test_routes_step_down_once_each():
    b, sent = played([(404, b"no such route"), (400, {"error": {"message": "response_format is not supported"}}), (400, b"unsupported value: temperature"), (200, chat_reply(SAID)), (200, chat_reply(SAID))])
    assert b.ask({}, ASKED)["a"]["noul"] == 0.3
    assert sent == [("/responses", True, 0.0), ("/chat/completions", True, 0.0), ("/chat/completions", False, 0.0), ("/chat/completions", False, None)]
    other = backends.ChatBackend("https://h/v1", post=b.post)  # what was learnt holds for the service, not for the object
    assert other.ask({}, ASKED)["a"]["noul"] == 0.3 and sent[4] == ("/chat/completions", False, None) and b.usage.requests == 4 and b.usage.retries == 3
    b, sent = played([(404, b"no model")], url="https://h/v1/chat/completions")
    with pytest.raises(backends.DecisionError):
        b.ask({}, ASKED)  # a full address has no other route
    assert sent == [("/chat/completions", True, 0.0)]
    b, sent = played([(400, b"json_schema: no"), (400, b"json_schema: still no")])
    with pytest.raises(backends.DecisionError):
        b.ask({}, ASKED)
    assert len(sent) == 2


def test_replies_of_both_routes():
    b, sent = played([(200, responses_reply("hm")), (200, responses_reply(SAID, usage={"input_tokens": 5, "output_tokens": 2}))])
    assert b.ask({}, ASKED)["a"]["noul"] == 0.3 and [t for _, _, t in sent] == [0.0, 0.7] and b.usage.input_tokens == 5
    b, sent = played([(200, responses_reply("hm"))] * 3)
    with pytest.raises(backends.DecisionError, match="3 replies"):
        b.ask({}, ASKED)
    chat = "https://h/v1/chat/completions"
    for url, reply, kind in (
        (chat, chat_reply("", finish_reason="length"), "token_limit"), (chat, chat_reply("", finish_reason="content_filter"), "api"), (chat, {"choices": [{"message": {"refusal": "no"}}]}, "api"),
        ("https://h/v1", {"status": "incomplete", "incomplete_details": {"reason": "max_output_tokens"}}, "token_limit"), ("https://h/v1", {"status": "queued"}, "api"),
        ("https://h/v1", {"output": [{"type": "message", "content": [{"type": "refusal", "refusal": "no"}]}]}, "api"), ("https://h/v1", {"error": {"code": 401, "message": "who"}}, "auth"),
        ("https://h/v1", {"error": {"message": "maximum context is 8", "code": 400}}, "token_limit"),
    ):
        with pytest.raises(backends.DecisionError) as e:
            played([(200, reply)], url=url)[0].ask({}, ASKED)
        assert e.value.kind == kind, reply
    waits = []
    b, sent = played([(503, b"later"), (200, responses_reply(SAID))], sleep=waits.append)
    assert b.ask({}, ASKED)["a"]["noul"] == 0.3 and waits == [60.0]  # a service may ask for a minute at most
    b, sent = played([(429, b"insufficient_quota")])
    with pytest.raises(backends.DecisionError):
        b.ask({}, ASKED)
    assert len(sent) == 1 and b.ask({}, {}) == {}


def test_reroutes_and_plain_services():
    table = [backends.Reroute("hub.example.org", "judge/", "https://hub.example.org/typed")]
    assert type(backends.service("https://hub.example.org/v1", "judge/one", table)) is backends.HttpBackend
    assert backends.service("https://HUB.example.org/v1", "judge/one", table).url == "https://hub.example.org/typed"
    assert type(backends.service("https://hub.example.org/v1", "other", table)) is backends.ChatBackend and type(backends.service("https://x.org", "judge/one", table)) is backends.ChatBackend


def test_credentials(tmp_path, monkeypatch):
    (tmp_path / "k.toml").write_text('[a]\nkey = " one "\n')
    (tmp_path / "k.json").write_text('{"a": {"b": "two"}, "n": 3}')
    toml, doc = f"toml:{tmp_path}/k.toml", f"json:{tmp_path}/k.json"
    of = lambda *p: credentials.Chain.of(*p).resolve()
    assert of("env:NOT_THERE", f"{toml}#a.key") == "one" and of(f"{toml}#a.none", f"{doc}#a.b") == "two" and of(f"{doc}#n") is None
    assert of(f"json:{tmp_path}/none#a", "command:no-such-program", "command:echo three") == "three" and of("command:false") is None
    monkeypatch.setenv("MY_KEY", "four")
    assert of("env:MY_KEY", "command:echo three") == "four" and "four" not in repr(credentials.Chain.of("env:MY_KEY"))
    with pytest.raises(ValueError):
        credentials.Chain.of("vault:x")
    seen = []
    backends.HttpBackend("https://h", key=credentials.Chain.of("env:MY_KEY"), post=lambda u, b, h: seen.append(h) or (200, {}, b'{"answers": {}}')).ask({}, {})
    assert seen == [{"Authorization": "Bearer four"}]


def test_measures(spark):
    """A finding stands for its first label only, a label counts once, and equal findings are two."""
    f = spark.createDataFrame([("p", "X", 1, 10, 0), ("p", "X", 5, 10, 1), ("p", "X", 5, 10, 2), ("p", "Y", 1, 10, 3), ("q", "X", 1, 2, 0)], "case string, criterion string, start int, end int, ord int")
    labels = spark.createDataFrame([("p", "X", 2, 0), ("p", "X", 7, 1), ("p", "Y", 30, 2), ("q", "X", 9, 0)], "case string, criterion string, line int, ord int")
    assert [r["hit"] for r in evaluate.match_findings(f, labels).orderBy("case", "ord").collect()] == [True, True, False, False, False]
    cases = spark.createDataFrame([("p", "findings"), ("q", "incomplete"), ("r", "no_findings")], "case string, status string")
    assert tuple(evaluate.finding_measures(f, labels, cases).first()) == (2, 2, 1, 1, 3, 0.5, 0.666667, False)
    items = lambda *x: spark.createDataFrame([(i,) for i in x], "item int")
    assert tuple(evaluate.precision_recall(items(1, 2, 5), items(2, 3), items(1, 2, 3, 4)).first()) == (1, 1, 1, 0.5, 0.5)
    none = spark.createDataFrame([], "item int")
    assert evaluate.precision_recall(none, none, items(1)).first()["precision"] is None


def test_spread():
    assert segment.spread(segment.Chunking(), 30, 32) is None
    finer = segment.spread(segment.Chunking(), 2, 32)
    assert (finer.max_lines, finer.max_tokens) == (38, 3500)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("t.py", GOLDEN), ("u.py", "x\n")], "path string, text string")
    df.write.parquet(str(tmp_path / "in"))
    hits = streaming.score_stream(streaming.text_stream(spark, str(tmp_path / "in")), scoring.Search([["needle"]]))
    streaming.write_hits(hits, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert [(r["path"], r["start"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("t.py", 1)]
