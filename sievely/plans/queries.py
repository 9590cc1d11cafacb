"""The registered queries of the search engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluate, fold, questions, render, rulecheck, scoring, segment
from ..operators import filters as fl
from ..operators import select as sel
from ..sources import backends
from ..sources import files as src
from ..sources.ledger import Ledger
from . import corpus, sql

WORD, WORDS = "worthless", ["worthless", "License"]
RULES = fl.parse("Prose only. No licenses")
TERM_WORDS = {"Prose": ["the", "de"], "licenses": ["License"]}
PER_LINE_2 = 2.0
Query = Callable[[SparkSession, str], DataFrame]


def _lines(spark: SparkSession, d: str, code_like: bool = True) -> DataFrame:
    return segment.line_table(corpus.files(spark, d, code_like))


def _scored(spark: SparkSession, d: str, words=(WORD,), rules: bool = False) -> DataFrame:
    search = scoring.Search([[w] for w in words], RULES if rules else fl.Rules(), TERM_WORDS if rules else {})
    return scoring.score_chunks(segment.chunk_files(corpus.files(spark, d), segment.Chunking(questions_per_line=float(len(words)))), search)


def _select(spark: SparkSession, d: str, words=(WORD,), lim: sel.Limits = sel.Limits()) -> sel.Selection:
    return sel.select_scored(_scored(spark, d, words), lim)


def lines_enumerate(spark, d):
    return _lines(spark, d, False).select("path", "line", F.md5(F.encode("raw", "utf-8")).alias("raw_md5"))


def clip_lines(spark, d):
    return _lines(spark, d, False).select("path", "line", F.length("text").alias("n"), F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def askable_lines(spark, d):
    return _lines(spark, d, False).where(tx.askable(F.col("text"))).groupBy("path").agg(F.count("*").alias("n"))


def token_estimate(spark, d):
    return segment.token_costs(corpus.files(spark, d, False), 1.0).groupBy("path").agg(F.sum("tokens").alias("tokens"))


def definitions(spark, d):
    return _lines(spark, d).where("definition").select("path", "line", "text")


def indent_depth(spark, d):
    return _lines(spark, d).where("not blank").groupBy("path").agg(F.sum("indent").alias("indents"), F.count("*").alias("n"))


def _urls(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")


def glob_include(spark, d):
    return _urls(spark, d).where(tx.path_matches(F.col("url"), ["*/en/*", "[0-4]*"]))


def glob_exclude(spark, d):
    return _urls(spark, d).where(~tx.path_matches(F.col("url"), ["*.org/*", "*/fr/?", "*/[!0-4]*/en/[5-9]*"]))


def scan_skip_rules(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    path = F.expr("concat(case doc_id % 7 when 0 then 'vendor/' when 1 then '.hidden/' when 2 then 'src/build/' else 'src/' end, lang, '/doc_', doc_id, case doc_id % 5 when 0 then '.min.js' when 1 then '.PNG' else '.txt' end)")
    rows = docs.select(path.alias("path"), F.octet_length("text").cast("long").alias("length"))
    return rows.where(src.wanted(F.col("path"), F.col("length"), max_bytes=4000))


def dedupe_content(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("canonical"))
    return docs.groupBy("canonical").agg(F.min("doc_id").alias("doc_id"))


def split_blocks(spark, d):
    return segment.split_blocks(corpus.files(spark, d))


def pack_chunks(spark, d):
    return segment.chunk_files(corpus.files(spark, d)).select("path", "ctx_start", "start", "end", F.size("blocks").alias("n_blocks"))


def split_oversize(spark, d):
    return segment.halve(segment.chunk_files(corpus.files(spark, d))).select("path", "half", "ctx_start", "start", "end", F.size("blocks").alias("n_blocks"))


def line_scores(spark, d):
    return scoring.line_hits(_scored(spark, d)).select("path", "line", "p", "section")


def block_scores(spark, d):
    return scoring.block_hits(_scored(spark, d)).select("path", "start", "end", "p")


def block_labels(spark, d):
    return scoring.block_hits(_scored(spark, d)).select("path", "start", "end", "label", "label_line")


def question_counts(spark, d):
    chunks = segment.chunk_files(corpus.files(spark, d), segment.Chunking(questions_per_line=2.24))
    return questions.question_counts(chunks, questions.Asking(["one", "two"], ["a", "b"]))


def triage_paths(spark, d):
    pages = _urls(spark, d).select(F.col("url").alias("path"), F.col("page_id").alias("ord"))
    # Two thirds of the paths are asked about, in batches, through the ledger; the others have no answer.
    some = pages.groupBy("path").agg(F.min("ord").alias("ord")).where("ord % 3 <> 2")
    scores = questions.triage_scores(some, lambda: backends.LexicalBackend(["/en/"]), ["pages in English"], Ledger(spark))
    return fold.triage(pages, scores, 0.2, 100)


def filter_gate(spark, d):
    s = _scored(spark, d, rules=True)
    return scoring.block_hits(s).where(F.col("keep") >= fl.GATE).select("path", "start", "end", "p", "keep")


def filter_removed(spark, d):
    s = _scored(spark, d, rules=True)
    return fold.filtered_out(scoring.line_hits(s), scoring.block_hits(s), 0.5)


def file_fold(spark, d):
    return fold.fold_files(_scored(spark, d, rules=True)).select("path", "score", "confidence", F.round("keep", 6).alias("keep"))


def rank_files(spark, d):
    return fold.rank_files(_scored(spark, d)).select("path", "score", "evidence", F.round("rank", 6).alias("rank"))


def merge_regions(spark, d):
    hits = scoring.block_hits(_scored(spark, d, ("the",)))
    return sel.merge_regions(hits.where("p >= 0.5")).select("path", "start", "end", "p", "label", "label_line")


def top_regions(spark, d):
    return _select(spark, d, ("the",), sel.Limits(max_regions=2)).regions.select("path", "start", "end", "p")


def top_lines(spark, d):
    return _select(spark, d, ("the",), sel.Limits(max_lines=3)).lines.select("path", "line", "p", "region")


def weak_tier(spark, d):
    lim = sel.Limits(threshold=0.96, top=8)
    return _select(spark, d, (WORD,), lim).files.where("weak").select("path", "score", "relevance", "place")


def suppress_lines(spark, d):
    return _select(spark, d, ("the",), sel.Limits(max_regions=1)).lines.select("path", "line", "text", "region")


def select_views(spark, d):
    return _select(spark, d).files.drop("query_idx")


def files_only(spark, d):
    return sel.select_files(fold.fold_files(_scored(spark, d))).select("path", "score", "confidence", "place")


def multi_query(spark, d):
    return _select(spark, d, WORDS).files


def context_lines(spark, d):
    return sel.context_lines(_scored(spark, d), 2).select("path", "line", "text")


def _rendered(spark, text: str, name: str) -> DataFrame:
    """The lines of what is printed, which the display limits bound."""
    return spark.createDataFrame([(line,) for line in text.split("\n")[:-1]], f"{name} string")


def flat_rows(spark, d):
    return _rendered(spark, render.flat(render.collect(_select(spark, d)).get(0, [])), "row")


def json_rows(spark, d):
    return _rendered(spark, render.json_lines(WORD, render.collect(_select(spark, d)).get(0, [])), "json")


def usage_cost(spark, d):
    """What asking about every chunk took, as the answer rows say."""
    chunks, asking = segment.chunk_files(corpus.files(spark, d)), questions.Asking([WORD], files_only=True)
    u = fold.usage_of(questions.ask_chunks(chunks, lambda: backends.LexicalBackend([WORD]), asking, Ledger(spark)))
    return u.select("requests", "input_tokens", "output_tokens", F.round("cost", 9).alias("cost"))


def answer_decode(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array(*[F.expr(f"cast((doc_id * {k} + {k}) % 101 as double)") for k in (3, 5, 7, 11)]).alias("percents"))
    return evaluate.expected_scores(docs)


def rule_checks(spark, d):
    return rulecheck.check(corpus.files(spark, d), [("A", WORD), ("B", "License")])


def _findings(spark, d):
    """Made of the tables: findings, labels and cases, one case in nine incomplete."""
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = docs.selectExpr("doc_id % 50 as case", "case when n_chars % 3 = 0 then 'A' else 'B' end as criterion", "doc_id % 40 as start", "doc_id % 40 + n_chars % 15 as end", "doc_id as ord")
    told = labels.selectExpr("doc_id % 50 as case", "case when quality = 1 then 'A' else 'B' end as criterion", "doc_id * 7 % 50 as line", "doc_id as ord")
    cases = docs.selectExpr("doc_id % 50 as case").distinct().selectExpr("case", "case when case % 9 = 8 then 'incomplete' else 'findings' end as status")
    return found, told, cases


def match_findings(spark, d):
    found, told, _ = _findings(spark, d)
    return evaluate.match_findings(found, told)


def finding_measures(spark, d):
    return evaluate.finding_measures(*_findings(spark, d))


def eval_precision_recall(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = docs.where(F.contains("text", F.lit(WORD)) | F.contains("text", F.lit("moron"))).select(F.col("doc_id").alias("item"))
    return evaluate.precision_recall(found, labels.where("toxic = 1").select(F.col("doc_id").alias("item")), labels.select(F.col("doc_id").alias("item")))


def _cases(spark, d):
    """Known answers made of documents: those with one of WORDS, and one or two ranges of lines in each."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(F.array_compact(F.array(*(F.when(F.contains("text", F.lit(w)), F.lit(i)) for i, w in enumerate(WORDS))))).alias("query_idx"))
    lows = F.expr("filter(array(doc_id % 20 + 1, case when doc_id % 3 = 0 then doc_id % 20 + 70 end), x -> x is not null)")
    cases = docs.select((F.col("doc_id") * 2 + F.col("query_idx")).alias("case"), "query_idx", F.expr("if(doc_id % 2 = 0, 'pin', 'broad')").alias("kind"), F.expr("concat('/doc_', doc_id, '.txt')").alias("suffix"), F.explode(lows).alias("lo"))
    return cases.withColumn("hi", F.col("lo") + 6)


def known_answers(spark, d):
    return evaluate.known_answers(_select(spark, d, WORDS).shown, _cases(spark, d))


def known_answer_tally(spark, d):
    return evaluate.tally(known_answers(spark, d))


def display_audits(spark, d):
    return evaluate.audits(_select(spark, d, ("the", "worthless"), sel.Limits(top=40, max_regions=2)).shown)


def _asked(spark, d):
    """A row per question about each chunk; a chunk is told by its path and first line."""
    asking = questions.Asking([WORD])
    rows = segment.chunk_files(corpus.files(spark, d)).select(F.concat_ws(":", "path", "start").alias("request"), F.explode(questions.chunk_questions(asking)).alias("q"))
    return rows.select("request", "q.*")


def answer_sets(spark, d):
    """Questions held against a table of stored answers in which some lines are lacking and some blocks end elsewhere."""
    asked = _asked(spark, d)
    stored = asked.where("not (kind = 'line' and a % 7 = 3)").withColumn("b", F.expr("if(kind = 'block' and a % 5 = 0, b + 1, b)"))
    return questions.compare_answers(asked, stored)


def asked_line_scores(spark, d):
    """Lines as the lexical backend answers typed questions, through the ledger; chunks with more than 90 questions are halved."""
    chunks, asking = segment.chunk_files(corpus.files(spark, d)), questions.Asking([WORD])
    answered = questions.ask_chunks(chunks, lambda: backends.LexicalBackend([WORD], 90), asking, Ledger(spark))
    return questions.score_answers(answered, asking)[1].select("path", "line", "p")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    lines_enumerate, clip_lines, askable_lines, token_estimate, definitions, indent_depth, glob_include, glob_exclude, scan_skip_rules, dedupe_content,
    split_blocks, pack_chunks, split_oversize, line_scores, block_scores, block_labels, question_counts, triage_paths, filter_gate, filter_removed,
    file_fold, rank_files, merge_regions, top_regions, top_lines, weak_tier, suppress_lines, select_views, files_only, multi_query, context_lines,
    flat_rows, json_rows, usage_cost, answer_decode, rule_checks, match_findings, finding_measures, eval_precision_recall,
    known_answers, known_answer_tally, display_audits, answer_sets, asked_line_scores,
)}

_DIRS = "'" + "','".join(src.SKIP_DIRS) + "'"
_SUFFIX = "|".join(s.replace(".", r"\.") for s in src.SKIP_SUFFIXES)

ORACLES: dict[str, str] = {
    "lines_enumerate": f"with {sql.lines(False)} select path, n as line, md5(raw) as raw_md5 from lines",
    "clip_lines": f"with {sql.lines(False)} select path, n as line, cast(length(text) as int) as n, md5(text) as text_md5 from lines",
    "askable_lines": f"with {sql.lines(False)} select path, count(*) as n from lines where regexp_matches(text, '[A-Za-z0-9]') group by path",
    "token_estimate": f"with {sql.lines(False)} select path, cast(sum(cost) as bigint) as tokens from lines group by path",
    "definitions": f"with {sql.lines()} select path, n as line, text from lines where def",
    "indent_depth": f"with {sql.lines()} select path, cast(sum(ind) as bigint) as indents, count(*) as n from lines where not blank group by path",
    "glob_include": r"select page_id, url from pages where contains(url, '/en/') or regexp_matches(url, '(^|/)[0-4][^/]*$') or regexp_matches(url, '^(.*/)?[0-4].*$')",
    "glob_exclude": r"select page_id, url from pages where not (contains(url, '.org/') or regexp_matches(url, '/fr/.$') or regexp_matches(url, '/[^0-4].*/en/[5-9]'))",
    "scan_skip_rules": f"""
        with p as (select concat(case doc_id % 7 when 0 then 'vendor/' when 1 then '.hidden/' when 2 then 'src/build/' else 'src/' end, lang, '/doc_', doc_id, case doc_id % 5 when 0 then '.min.js' when 1 then '.PNG' else '.txt' end) as path, cast(strlen(text) as bigint) as length from documents)
        select path, length from p where length between 1 and 4000 and not list_has_any(string_split(path, '/')[:-2], [{_DIRS}])
            and not regexp_matches(path, '(^|/)\\.') and not regexp_matches(lower(path), '({_SUFFIX})$')""".replace("\\\\", "\\"),
    "dedupe_content": "select md5(text) as canonical, min(doc_id) as doc_id from documents group by 1",
    "split_blocks": f'with recursive {sql.blocks()} select path, "start", "end" from blocks',
    "pack_chunks": f'with recursive {sql.chunks()} select path, ctx as ctx_start, "start", "end", cast(n_blocks as int) as n_blocks from chunks',
    "split_oversize": f"""with recursive {sql.chunks()}, mids as (
            select c.*, case when c.n_blocks > 1 then (select b."start" from in_chunk b where b.path = c.path and b.chunk = c.chunk and b."start" > c."start" order by abs(b."start" - (c."start" + (c."end" - c."start" + 1) // 2)), b."start" limit 1)
                else c."start" + (c."end" - c."start" + 1) // 2 end as mid from chunks c where c."end" > c."start"
        ), halves as (
            select path, chunk, 0 as half, ctx as ctx_start, "start", mid - 1 as "end" from mids union all select path, chunk, 1, greatest("start", mid - 12), mid, "end" from mids
        )
        select h.path, h.half, cast(h.ctx_start as int) as ctx_start, cast(h."start" as int) as "start", cast(h."end" as int) as "end",
            cast((select count(*) from in_chunk b where b.path = h.path and b.chunk = h.chunk and b."start" <= h."end" and b."end" >= h."start") as int) as n_blocks from halves h""",
    "line_scores": f"with recursive {sql.scored([WORD])} select path, line, p, section from line_hits",
    "block_scores": f'with recursive {sql.scored([WORD])} select path, "start", "end", p from block_hits',
    "block_labels": f'with recursive {sql.scored([WORD])} select path, "start", "end", label, label_line from block_hits',
    "question_counts": f"""with recursive {sql.chunks(2.24)} select c.path, c."start", c."end", 2 as n_section, cast(2 * c.n_blocks as int) as n_block,
        cast(2 * (select count(*) from lines l where l.path = c.path and l.n between c."start" and c."end" and regexp_matches(l.text, '[A-Za-z0-9]')) as int) as n_line, cast(2 * (1 + c.n_blocks) as int) as n_filter from chunks c""",
    "triage_paths": """with s as (select url, case when contains(url, '/en/') then 0.9::double else 0.1::double end as p from (select url, min(page_id) as o from pages group by url) where o % 3 <> 2)
        select pages.url as path, page_id as ord, coalesce(p, 1.0::double) as p from pages left join s using (url) where coalesce(p, 1.0::double) >= 0.2::double order by 3 desc, 2 limit 100""",
    "filter_gate": f'with recursive {sql.scored([WORD], True)} select path, "start", "end", p, keep from block_hits where keep >= 0.5',
    "filter_removed": f"""with recursive {sql.scored([WORD], True)} select cast(0 as int) as query_idx,
        (select count(*) from block_hits where p >= 0.5 and keep < 0.5) as regions, (select count(*) from line_hits where p >= 0.5 and keep < 0.5) as lines""",
    "file_fold": f"with recursive {sql.scored([WORD], True)} select path, score, confidence, round(keep, 6) as keep from folded",
    "rank_files": f"""with recursive {sql.scored([WORD])}, e as (select path, max(p) as evidence from (select path, p from line_hits union all select path, p from block_hits) group by path)
        select path, score, coalesce(evidence, 0.0::double) as evidence, round(greatest(score, coalesce(evidence, 0)) + 0.25::double * least(score, coalesce(evidence, 0)), 6) as rank from folded left join e using (path)""",
    "merge_regions": f'with recursive {sql.selected(["the"])} select path, "start", "end", p, label, label_line from strong',
    "top_regions": f'with recursive {sql.selected(["the"], max_regions=2)} select path, "start", "end", p from kept',
    "top_lines": f"with recursive {sql.selected(['the'], max_lines=3)} select path, line, p, region from shown",
    "weak_tier": f"with recursive {sql.selected([WORD], threshold=0.96, top=8)} select path, score, relevance, place from final where weak",
    "suppress_lines": f"with recursive {sql.selected(['the'], max_regions=1)} select path, line, text, region from shown",
    "select_views": f"with recursive {sql.selected([WORD])} select path, score, confidence, relevance, weak, more_regions, more_lines, place from final",
    "files_only": f"with recursive {sql.scored([WORD])} select path, score, confidence, cast(row_number() over (order by score desc, path) as int) as place from folded where score >= 0.6 and keep >= 0.5 qualify place <= 15",
    "multi_query": f"with recursive {sql.selected(WORDS, per_line=2.0)} select cast(query_idx as int) as query_idx, path, score, confidence, relevance, weak, more_regions, more_lines, place from final",
    "context_lines": f"""with recursive {sql.scored([WORD])}, h as (select path, line from line_hits where p >= 0.5)
        select distinct l.path, l.n as line, l.text from lines l join h on h.path = l.path and l.n between h.line - 2 and h.line + 2 where not l.blank and not exists (select 1 from h x where x.path = l.path and x.line = l.n)""",
    "flat_rows": f"""with recursive {sql.selected([WORD])} select k.path || ':' || k."start" || '-' || k."end" || ':' || printf('%.2f', k.p) || ':' || k.label as row from kept k join final f on f.path = k.path where not f.weak
        union all select s.path || ':' || s.line || ':' || printf('%.2f', s.p) || ':' || s.text from shown s join final f on f.path = s.path where not f.weak""",
    "json_rows": f"""with recursive {sql.selected([WORD])}, said as (select path, region, line, {{'line': line, 'p': round(p, 4), 'text': text}} as j from shown),
        in_region as (select k.path, k."start", {{'start': k."start", 'end': k."end", 'p': round(any_value(k.p), 4), 'label': any_value(k.label), 'label_line': any_value(k.label_line), 'lines': coalesce(list(s.j order by s.line) filter (s.j is not null), [])}} as j
            from kept k left join said s on s.path = k.path and s.region = k."start" group by k.path, k."start", k."end")
        select cast(to_json({{'query': '{WORD}', 'path': path, 'relevance': round(relevance, 4), 'section_relevance': round(score, 4), 'confidence': round(confidence, 4), 'match': case when weak then 'weak' else 'strong' end,
            'regions': coalesce((select list(r.j order by r."start") from in_region r where r.path = f.path), []), 'lines': coalesce((select list(s.j order by s.line) from said s where s.path = f.path and s.region is null), []),
            'more_regions': more_regions, 'more_lines': more_lines}}) as varchar) as json from final f""",
    "usage_cost": f"with recursive {sql.chunks()} select count(*) as requests, count(*) * 100 as input_tokens, count(*) * 10 as output_tokens, round(count(*) * 100 * 0.042::double / 1e6::double, 9) as cost from chunks",
    "answer_decode": """with a as (select doc_id, list_transform([3, 5, 7, 11], lambda k: cast((doc_id * k + k) % 101 as double)) as p from documents)
        select doc_id, case when list_sum(p) > 0 then round((p[2] + 2 * p[3] + 3 * p[4]) / list_sum(p), 6) end as score, abs(list_sum(p) - 100) <= 2.5 as well_formed from a""",
    "rule_checks": f"""with recursive {sql.blocks()}, c(criterion, word) as (values ('A', '{WORD}'), ('B', 'License'))
        select criterion, path, "start", "end", 0.9::double as score from blocks b cross join c where exists (select 1 from lines l where l.path = b.path and l.n between b."start" and b."end" and contains(l.raw, c.word))""",
    "match_findings": f"with {sql.FINDINGS} select \"case\", criterion, \"start\", \"end\", ord, hit from hits",
    "finding_measures": f"""with {sql.FINDINGS}, n as (select count(*) filter (hit) as tp, count(*) filter (not hit) as fp from hits where "case" % 9 <> 8), m as (select count(*) as labels from told where "case" % 9 <> 8),
        all_cases as (select count(*) as cases, count(*) filter (c % 9 = 8) as incomplete from (select distinct doc_id % 50 as c from documents))
        select tp, fp, labels - tp as fn, incomplete, cases, case when tp + fp > 0 then round(tp / (tp + fp)::double, 6) end as "precision", case when labels > 0 then round(tp / labels::double, 6) end as recall, incomplete = 0 as valid from n, m, all_cases""",
    "eval_precision_recall": f"""with f as (select doc_id from documents semi join labels using (doc_id) where contains(text, '{WORD}') or contains(text, 'moron')), t as (select doc_id from labels where toxic = 1),
        n as (select (select count(*) from f semi join t using (doc_id)) as tp, (select count(*) from f anti join t using (doc_id)) as fp, (select count(*) from t anti join f using (doc_id)) as fn)
        select tp, fp, fn, case when tp + fp > 0 then round(tp / (tp + fp)::double, 6) end as "precision", case when tp + fn > 0 then round(tp / (tp + fn)::double, 6) end as recall from n""",
    "known_answers": f"with recursive {sql.selected(WORDS, per_line=2.0)}, {sql.KNOWN.format(*WORDS)} select \"case\", query_idx, kind, place, region, line from known",
    "known_answer_tally": f"""with recursive {sql.selected(WORDS, per_line=2.0)}, {sql.KNOWN.format(*WORDS)}
        select count(*) as cases, count(*) filter (place = 1) as first_file, count(*) filter (region >= 0.5) as region, count(*) filter (kind = 'pin') as pins, count(*) filter (kind = 'pin' and line >= 0.5) as line from known""",
    "display_audits": f"""with recursive {sql.selected(['the', 'worthless'], top=40, max_regions=2, per_line=2.0)}, printed as (
            select k.query_idx, k.path, 'region' as what, null as n, k.p from kept k union all select query_idx, path, 'label', label_line, p from kept union all select query_idx, path, 'line', line, p from shown
        ), per_file as (
            select f.query_idx, f.path, f.weak, count(*) filter (what = 'region' and not f.weak) as regions, count(*) filter (what = 'line' and not f.weak) as lines,
                count(*) filter ((what = 'region' and p < case when f.weak then 0.35 else 0.5 end) or (what = 'line' and p < 0.5)) as below_bar, count(n) - count(distinct n) as twice
            from final f join printed x on x.query_idx = f.query_idx and x.path = f.path group by all
        )
        select query_idx, count(*) filter (not weak) as strong, count(*) filter (weak) as weak, cast(sum(regions) as bigint) as regions, cast(sum(lines) as bigint) as lines, cast(sum(below_bar) as bigint) as below_bar, cast(sum(twice) as bigint) as twice from per_file group by query_idx""",
    "answer_sets": f"""with recursive {sql.chunks()}, asked as (
            select path || ':' || "start" as request, 'section' as kind, 0 as i, null::int as a, null::int as b from chunks
            union all select c.path || ':' || c."start", 'block', 0, x."start"::int, x."end"::int from chunks c join in_chunk x on x.path = c.path and x.chunk = c.chunk
            union all select c.path || ':' || c."start", 'line', 0, l.n, l.n from chunks c join lines l on l.path = c.path and l.n between c."start" and c."end" and regexp_matches(l.text, '[A-Za-z0-9]')
        ), stored as (select request, kind, i, a, case when kind = 'block' and a % 5 = 0 then b + 1 else b end as b from asked where not (kind = 'line' and a % 7 = 3))
        (select *, 'missing' as state from asked except select *, 'missing' from stored) union all (select *, 'extra' from stored except select *, 'extra' from asked)""",
    "asked_line_scores": f"with recursive {sql.scored([WORD])} select path, line, p from line_hits",
}
