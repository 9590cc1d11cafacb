"""The same rules for DuckDB, written from the rules: windows, joins and recursion over line numbers, no arrays folded."""

from __future__ import annotations

from .corpus import CODE_LIKE, PATH

DEF = r"^\s*(?:(?:pub(?:\([a-z]+\))?|export|default|public|private|protected|internal|static|final|abstract|async|unsafe|extern|inline|virtual|override|const)\s+)*(?:macro_rules!|(?:def|class|fn|func|function|impl|struct|enum|trait|interface|type|module|mod|namespace|object|record|sub|proc|procedure|package)(?:$|[^0-9A-Za-z_]))"


FINDINGS = """
        found as (select doc_id % 50 as "case", case when n_chars % 3 = 0 then 'A' else 'B' end as criterion, doc_id % 40 as "start", doc_id % 40 + n_chars % 15 as "end", doc_id as ord from documents),
        told as (select doc_id % 50 as "case", case when quality = 1 then 'A' else 'B' end as criterion, doc_id * 7 % 50 as line, doc_id as ord from labels),
        first_label as (select f.*, (select min(t.ord) from told t where t."case" = f."case" and t.criterion = f.criterion and t.line between f."start" and f."end") as label from found f),
        hits as (select *, label is not null and row_number() over (partition by "case", label order by ord) = 1 as hit from first_label)"""


#: Behind selected(): known cases, one of two words each, and what is shown of them.
KNOWN = """
        cases as (
            select doc_id * 2 + query_idx as "case", query_idx, case when doc_id % 2 = 0 then 'pin' else 'broad' end as kind, '/doc_' || doc_id || '.txt' as suffix, unnest(case when doc_id % 3 = 0 then [doc_id % 20 + 1, doc_id % 20 + 70] else [doc_id % 20 + 1] end) as lo
            from (select doc_id, 0 as query_idx from documents where contains(text, '{0}') union all select doc_id, 1 from documents where contains(text, '{1}'))
        ),
        met as (
            select c."case", max(k.p) as region, null::double as line from cases c join final f on f.query_idx = c.query_idx and not f.weak and suffix(f.path, c.suffix) join kept k on k.query_idx = f.query_idx and k.path = f.path and k."start" <= c.lo + 6 and k."end" >= c.lo group by 1
            union all
            select c."case", null, max(x.p) from cases c join final f on f.query_idx = c.query_idx and not f.weak and suffix(f.path, c.suffix)
                join (select query_idx, path, line, p from shown union all select query_idx, path, label_line, p from kept) x on x.query_idx = f.query_idx and x.path = f.path and x.line between c.lo and c.lo + 6 group by 1
        ),
        known as (
            select c."case", c.query_idx, c.kind, coalesce(min(f.place), 0) as place, coalesce((select max(region) from met m where m."case" = c."case"), 0.0::double) as region, coalesce((select max(line) from met m where m."case" = c."case"), 0.0::double) as line
            from (select distinct "case", query_idx, kind, suffix from cases) c left join final f on f.query_idx = c.query_idx and suffix(f.path, c.suffix) group by all
        )"""


def lines(code_like: bool = True, per_line: float = 1.0) -> str:
    return rf"""
        files as (select {PATH} as path, {CODE_LIKE if code_like else 'text'} as text from documents),
        parts as (select path, text, string_split_regex(text, '\r?\n') as l from files),
        whole as (select path, case when text = '' then [] when text[-1] = chr(10) then l[:len(l) - 1] else l end as l from parts),
        each as (select path, unnest(l) as raw, unnest(range(1, len(l) + 1)) as n from whole),
        cut as (select path, n, raw, regexp_replace(raw, '\s+$', '') as t from each),
        clipped as (select path, n, raw, case when length(t) > 300 then substr(t, 1, 300) || ' ...' else t end as text from cut),
        lines as materialized (
            select path, cast(n as int) as n, raw, text, cast(length(text) - length(regexp_replace(text, '^\s+', '')) as int) as ind,
                not regexp_matches(text, '\S') as blank, regexp_matches(text, '{DEF}') as def,
                cast(6 + length(text) // 3 + {int(30 * per_line + 0.5)} as int) as cost
            from clipped)"""


def blocks(per_line: float = 1.0) -> str:
    return lines(True, per_line) + """,
        walk as (
            select path, 0 as n, 0 as s, 0 as base, 1000000 as inr, 0 as last, false as para, cast(null as int) as done_s, cast(null as int) as done_e from files
            union all
            select path, n, case when blank then s when s = 0 or brk then n else s end,
                case when blank or not (s = 0 or brk) then base else ind end,
                case when blank then inr when s = 0 or brk then 1000000 when ind > base then least(inr, ind) else inr end,
                case when blank then last else n end, blank,
                case when not blank and s > 0 and brk then s end, case when not blank and s > 0 and brk then last end
            from (
                select w.path, l.n, l.ind, l.blank, w.s, w.base, w.inr, w.last,
                    l.n - w.s >= 50 or (w.para and (l.ind < w.base
                        or (l.def and l.ind <= least(w.inr, w.base + 8) and (l.ind <= w.base or l.n - w.s >= 6))
                        or (l.n - w.s >= 6 and (l.ind <= w.base or l.n - w.s >= 40 or (l.ind <= w.inr and l.n - w.s >= 12))))) as brk
                from walk w join lines l on l.path = w.path and l.n = w.n + 1
            )
        ),
        blocks as materialized (
            select path, done_s as "start", done_e as "end" from walk where done_s is not null
            union all
            select path, max_by(s, n), max_by(last, n) from walk group by path having max_by(s, n) > 0
        )"""


def chunks(per_line: float = 1.0) -> str:
    return blocks(per_line) + """,
        priced as (
            select *, row_number() over (partition by path order by "start") as k from (
                select b.path, b."start", b."end", sum(l.cost) as cost from blocks b join lines l on l.path = b.path and l.n between b."start" and b."end" group by all)
        ),
        pack as (
            select path, k, 1 as chunk, "start" as first, cost as used from priced where k = 1
            union all
            select p.path, p.k, case when p."end" - a.first + 1 > 150 or a.used + p.cost > 14000 then a.chunk + 1 else a.chunk end,
                case when p."end" - a.first + 1 > 150 or a.used + p.cost > 14000 then p."start" else a.first end,
                case when p."end" - a.first + 1 > 150 or a.used + p.cost > 14000 then p.cost else a.used + p.cost end
            from pack a join priced p on p.path = a.path and p.k = a.k + 1
        ),
        in_chunk as materialized (select p.path, a.chunk, p."start", p."end" from pack a join priced p on p.path = a.path and p.k = a.k),
        chunks as materialized (
            select path, chunk, min("start") as "start", max("end") as "end", greatest(min("start") - 12, 1) as ctx, count(*) as n_blocks from in_chunk group by path, chunk
        )"""


def scored(queries: list[str], rules: bool = False, per_line: float = 1.0) -> str:
    """chunk_scores, line_hits, block_hits and folded; queries: one word each. rules: prose only (the, de), no licenses (License)."""
    words = ", ".join(f"({i}, '{w}')" for i, w in enumerate(queries))
    has = lambda w: f"contains(l.text, '{w}')"
    if rules:
        prose, lic = f"({has('the')} or {has('de')})", has("License")
        keep = "least(1.0::double, {p}, 1.0::double - {l})"
        section_keep = keep.format(p=f"case when bool_or({prose}) then 0.9::double else 0.03::double end", l=f"case when bool_or({lic}) then 0.9::double else 0.03::double end")
        block_keep = f"""select b.path, b.chunk, b."start", b."end", least(1.0::double, greatest(any_value(c.sp), case when bool_or({prose}) then 0.9::double else 0.03::double end),
            1.0::double - greatest(any_value(c.sl), case when bool_or({lic}) then 0.9::double else 0.03::double end)) as keep
            from in_chunk b join lines l on l.path = b.path and l.n between b."start" and b."end"
            join (select c.path, c.chunk, case when bool_or({prose}) then 0.9::double else 0.03::double end as sp, case when bool_or({lic}) then 0.9::double else 0.03::double end as sl
                from chunks c join lines l on l.path = c.path and l.n between c.ctx and c."end" group by all) c on c.path = b.path and c.chunk = b.chunk group by all"""
    else:
        section_keep = "1.0::double"
        block_keep = 'select path, chunk, "start", "end", 1.0::double as keep from in_chunk'
    return chunks(per_line) + f""",
        q(query_idx, word) as (values {words}),
        chunk_scores as materialized (
            select q.query_idx, c.path, c.chunk, c."start", c."end", case when bool_or(contains(l.text, q.word)) then 3.0::double else 0.0::double end as score, {section_keep} as section_keep
            from chunks c cross join q join lines l on l.path = c.path and l.n between c.ctx and c."end" group by all
        ),
        block_keeps as materialized ({block_keep}),
        line_hits as materialized (
            select s.query_idx, s.path, l.n as line, case when contains(l.text, q.word) then 0.95::double else 0.02::double end as p, l.text, s.score / 3 as section,
                coalesce(k.keep, s.section_keep) as keep
            from chunk_scores s join q using (query_idx) join lines l on l.path = s.path and l.n between s."start" and s."end"
            left join block_keeps k on k.path = s.path and k.chunk = s.chunk and l.n between k."start" and k."end"
            where regexp_matches(l.text, '[A-Za-z0-9]')
        ),
        real as (
            select b.path, b.chunk, b."start", b."end", l.n, l.text, l.def, l.ind, row_number() over (partition by b.path, b."start" order by l.n) as r
            from in_chunk b join lines l on l.path = b.path and l.n between b."start" and b."end" where regexp_matches(l.text, '[\\p{{L}}\\p{{N}}]')
        ),
        named as (
            select path, "start", coalesce(min(n) filter (def and r <= 6), min(n)) as at from real group by all
        ),
        label0 as (
            select b.path, b.chunk, b."start", b."end", coalesce(l.text, '') as raw, coalesce(l.def, false) as def, coalesce(l.ind, 0) as ind, c.ctx,
                coalesce((select min(x.n) from lines x where x.path = b.path and x.n between b."start" and b."end" and x.text = coalesce(l.text, '')), b."start") as label_line
            from in_chunk b join chunks c on c.path = b.path and c.chunk = b.chunk left join named a on a.path = b.path and a."start" = b."start"
            left join lines l on l.path = b.path and l.n = a.at
        ),
        above as (
            select a.path, a."start", l.text, l.n, l.def, l.ind, a.ind as depth, min(l.ind) over (partition by a.path, a."start" order by l.n desc rows between unbounded preceding and 1 preceding) as least_below
            from label0 a join lines l on l.path = a.path and l.n >= a.ctx and l.n < a."start" where not a.def and a.raw <> '' and not l.blank
        ),
        owners as (
            select path, "start", trim(max_by(text, n)) as owner from above where def and ind < depth and (least_below is null or ind < least_below) group by all
        ),
        labels as materialized (
            select a.path, a."start", a."end", a.chunk, cast(a.label_line as int) as label_line,
                case when o.owner is null then trim(a.raw) else (case when length(o.owner) > 60 then substr(o.owner, 1, 57) || '...' else o.owner end) || ' > ' || trim(a.raw) end as label
            from label0 a left join owners o on o.path = a.path and o."start" = a."start"
        ),
        block_hits as materialized (
            select q.query_idx, b.path, b."start", b."end", case when bool_or(contains(l.text, q.word)) then 0.9::double else 0.03::double end as p, any_value(b.label) as label, any_value(b.label_line) as label_line, any_value(k.keep) as keep
            from labels b cross join q join lines l on l.path = b.path and l.n between b."start" and b."end"
            join block_keeps k on k.path = b.path and k.chunk = b.chunk and k."start" = b."start" group by q.query_idx, b.path, b."start", b."end"
        ),
        folded as materialized (
            select query_idx, path, coalesce(max(score / 3) filter (section_keep >= 0.5), 0.0::double) as score,
                case when count(*) filter (section_keep >= 0.5) > 0 then 0.9::double else 0.0::double end as confidence, avg(section_keep) as keep
            from chunk_scores group by all
        )"""


def selected(queries: list[str], top: int = 15, threshold: float = 0.5, max_regions: int = 5, max_lines: int = 10, per_line: float = 1.0) -> str:
    t = f"{threshold}::double"

    def merge(name: str, source: str) -> str:
        return f"""
        {name}_flag as (
            select *, case when "start" > 2 + max("end") over w then 1 else 0 end as fresh from {source} window w as (partition by query_idx, path order by "start" rows between unbounded preceding and 1 preceding)
        ),
        {name}_island as (select *, sum(fresh) over (partition by query_idx, path order by "start") as island from {name}_flag),
        {name} as (
            select query_idx, path, min("start") as "start", max("end") as "end", max(p) as p, min_by(label, "start") as label, min_by(label_line, "start") as label_line from {name}_island group by query_idx, path, island
        )"""

    return scored(queries, per_line=per_line) + f""",
        hits as materialized (select query_idx, path, line, max(p) as p, max_by(text, p) as text, max_by(section, p) as section from line_hits where keep >= 0.5 group by all having max(p) >= {t}),
        passing as (select * from block_hits where keep >= 0.5 and p >= {t}),{merge('strong', 'passing')},
        quiet as (select query_idx, path from folded where score >= 0.6::double except (select query_idx, path from strong union select query_idx, path from hits)),
        near_two as (select * from block_hits semi join quiet using (query_idx, path) where keep >= 0.5 qualify row_number() over (partition by query_idx, path order by p desc, "start") <= 2),
        near_miss as (select * from near_two where p >= 0.7::double * {t}),{merge('soft', 'near_miss')},
        regions as (
            select *, row_number() over (partition by query_idx, path order by p desc, "start") as r
            from (select *, false as weak from strong union all select *, true as weak from soft)
        ),
        kept as materialized (select * from regions where r <= {max_regions}),
        free as (
            select h.* from hits h where not exists (select 1 from kept k where k.query_idx = h.query_idx and k.path = h.path and k.label_line = h.line)
                and not exists (select 1 from regions d where d.r > {max_regions} and d.query_idx = h.query_idx and d.path = h.path and h.line between d."start" and d."end")
        ),
        lined as (select *, row_number() over (partition by query_idx, path order by p desc, line) as r from free),
        shown as materialized (
            select l.query_idx, l.path, l.line, l.p, l.text, l.section, (select k."start" from kept k where k.query_idx = l.query_idx and k.path = l.path and l.line between k."start" and k."end") as region from lined l where r <= {max_lines}
        ),
        views as (
            select f.query_idx, f.path, f.score, f.confidence,
                greatest(f.score, coalesce((select max(p) from kept k where k.query_idx = f.query_idx and k.path = f.path), 0), coalesce((select max(p) from shown s where s.query_idx = f.query_idx and s.path = f.path), 0)) as relevance,
                coalesce((select bool_or(weak) from kept k where k.query_idx = f.query_idx and k.path = f.path), false) as weak,
                (select count(*) from regions k where k.query_idx = f.query_idx and k.path = f.path and r > {max_regions}) as more_regions,
                (select count(*) from lined k where k.query_idx = f.query_idx and k.path = f.path and r > {max_lines}) as more_lines
            from folded f where (query_idx, path) in (select (query_idx, path) from regions union select (query_idx, path) from hits)
        ),
        tiered as (select *, row_number() over (partition by query_idx, weak order by relevance desc, path) as tr, count(*) filter (not weak) over (partition by query_idx) as n_strong from views),
        picked as (select * from tiered where (not weak and tr <= {top}) or (weak and tr <= least(5, {top} - least(n_strong, {top})))),
        final as materialized (select *, cast(row_number() over (partition by query_idx order by weak, relevance desc, path) as int) as place from picked)"""
