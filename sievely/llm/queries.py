"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import dealt
from . import ann, bpe, chat, fim, minhash, mixing, pii, repair, spotsigs, suffix, toxicity, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for operators that take row by row: those of a small file are dealt out among the cores."""
    return dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _hex(column) -> F.Column:
    return F.sha2(F.encode(column, "utf-8"), 256)


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_edits(_table(spark, sf_dir, "documents"))


#: A conversation of control strings alone.
_CLASH = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(_CLASH, "conv_id long, turn long, role string, text string"))
    back = chat.read_back(chat.format_conversations(rows))
    said = F.array_join("loss_texts", "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _hex(turns).alias("turns_sha256"), F.length(said).cast("long").alias("loss_chars"), _hex(said).alias("loss_sha256"), "formatted_chars")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(_documents(spark, sf_dir), "byte_bpe_50k.json")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _hex(ids).alias("ids_sha256"), _hex("decoded").alias("decoded_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.summary(suffix.removed_spans(_table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = toxicity.scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_documents(spark, sf_dir))
    counts = [pii.count_of("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, _hex(pii.spans_text("base")).alias("base_sha256"), pii.spans_text("spans").alias("spans"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.groups(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restored(fim.transform(_documents(spark, sf_dir)))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _hex("output").alias("output_sha256"), _hex("restored").alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": op1_spotsigs,
    "op2_chat": op2_chat,
    "op3_minhash": op3_minhash,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_suffix": op6_suffix,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_embeddings": op9_embeddings,
    "op10_mixing": op10_mixing,
    "op11_repair": op11_repair,
    "op12_neighbours": op12_neighbours,
    "op13_fim": op13_fim,
}

_CONTROL = r"\[INST\]|\[/INST\]|<s>|</s>|<<SYS>>|<</SYS>>|<<ROLE>>|<</ROLE>>|<</TURN>>"

ORACLES: dict[str, str] = {
    "op3_minhash": r"""
        with recursive words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
        ), sets as (
            select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s
            from words
        ), each as (select doc_id, unnest(s) as g from sets
        ), shared as (
            select a.doc_id as a, b.doc_id as b, count(*) as n from each a join each b on a.g = b.g and a.doc_id < b.doc_id group by all
        ), links as (
            select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 85 * (len(x.s) + len(y.s) - n)
        ), sides as (select a, b from links union all select b, a from links
        ), reach as (
            select doc_id as origin, doc_id as node from documents union select reach.origin, sides.b from reach join sides on reach.node = sides.a
        ), lowest as (select origin, min(node) as component_id from reach group by origin)
        select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from sets join lowest on origin = doc_id
    """,
    "op2_chat": f"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), said as (
            select conv_id, count(*) as n_turns,
                string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as whole,
                coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as loss,
                sum(length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + case role when 'user' then 16 when 'assistant' then 10 when 'system' then 18
                    else length(role) + len(regexp_extract_all(role, '{_CONTROL}')) + 31 end) as chars
            from turns group by conv_id
        )
        select cast(conv_id as bigint) as conv_id, cast(n_turns as bigint) as n_turns, sha256(whole) as turns_sha256,
            cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars
        from said
    """,
    "op5_warc": """
        with p as (
            select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest, coalesce(html, '') as html
            from pages
        ), k as (
            select *, case when payload_bytes >= 1000 then max(page_id) over (partition by html) end as keeper from p
        )
        select page_id, payload_bytes, payload_digest,
            case when keeper is not null and page_id is distinct from keeper then 'revisit' else 'response' end as record_type,
            case when keeper is not null and page_id is distinct from keeper then keeper end as refers_to
        from k
    """,
    "op9_embeddings": """
        with recursive v as (
            select vec_id, cast(embedding as double[]) as e from embeddings
        ), ok as (
            select * from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
        ), links as (
            select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95::double
        ), reach as (
            select vec_id as origin, vec_id as node from embeddings union select reach.origin, links.b from reach join links on reach.node = links.a
        ), lowest as (select origin, min(node) as component_id from reach group by origin
        ), counts as (select a, count(*) as n from links group by a)
        select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
        from embeddings join lowest on origin = vec_id left join counts on a = vec_id
    """,
    "op6_suffix": """
        with raw as (
            select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n_bytes from documents
        ), pieces as (
            select doc_id, n_bytes, 2000 * p as base, substr(h, 4000 * p + 1, 4198) as piece from (select *, unnest(range((n_bytes - 100) // 2000 + 1)) as p from raw where n_bytes >= 100)
        ), starts as (
            select doc_id, base + j as i, md5(substr(piece, 2 * j + 1, 200)) as string from (select *, unnest(range(least(2000, n_bytes - 99 - base))) as j from pieces)
        ), again as (
            select doc_id, i from starts qualify row_number() over (partition by string order by doc_id, i) > 1
        ), flagged as (
            select *, case when i <= 100 + lag(i) over (partition by doc_id order by i) then 0 else 1 end as fresh from again
        ), runs as (
            select doc_id, min(i) as a, max(i) + 100 as b from (select *, sum(fresh) over (partition by doc_id order by i) as run from flagged) group by doc_id, run
        ), gaps as (
            select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as since from runs
        ), cut as (
            select raw.doc_id, any_value(n_bytes) as n_bytes, any_value(h) as h, coalesce(sum(b - a), 0) as n_removed, count(a) as n_spans,
                string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' order by a) as kept, coalesce(max(b), 0) as rest
            from raw left join gaps on gaps.doc_id = raw.doc_id group by raw.doc_id
        )
        select doc_id, cast(n_bytes as bigint) as n_bytes, cast(n_removed as bigint) as n_removed, cast(n_spans as bigint) as n_spans,
            sha256(unhex(coalesce(kept, '') || substr(h, 2 * rest + 1))) as kept_sha256
        from cut
    """,
    "op10_mixing": r"""
        with sized as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, ('0x' || substr(md5(concat_ws(':', '7', doc_id)), 1, 15))::bigint as dealt from documents
        ), per as (
            select *, [2, 3, 1][1 + row_number() over (order by source nulls last) % 3]::double as weight, sum(docs) over () as all_docs, 1.5 * sum(words) over () as goal
            from (select source, sum(size)::bigint as words, count(*) as docs from sized group by source)
        ), filled as (
            select *, row_number() over o as k,
                (goal - coalesce(sum(2 * words) over (o rows between unbounded preceding and 1 preceding), 0))::double / sum(weight) over (o rows between current row and unbounded following) as unit
            from per window o as (order by words / weight, source nulls last)
        ), first_open as (
            select min(k) as k, min_by(unit, k) as unit from filled where unit * weight <= 2 * words
        ), aimed as (
            select f.source, words as source_size, case when f.k < o.k then 2.0::double * words else o.unit * weight end as target,
                cast(ceil(docs / greatest(256, ceil(all_docs / 65536.0))::double) as bigint) as blocks
            from filled f, first_open o
        ), plan as (
            select *, case when passes < 2 then least(floor(target - passes * source_size + 0.5)::bigint, source_size) else 0 end as rest
            from (select *, case when source_size > 0 then least(2, floor(target / source_size))::bigint else 0 end as passes from aimed)
        ), dealt as (
            select s.*, p.* exclude (source), s.dealt % p.blocks as block from sized s join plan p on s.source is not distinct from p.source
        ), ordered as (
            select source, block, words, rest, passes, coalesce(sum(words) over (partition by source order by spot, block rows between unbounded preceding and 1 preceding), 0) as before
            from (select source, block, any_value(rest) as rest, any_value(passes) as passes, sum(size) as words, ('0x' || substr(md5(concat_ws(':', '8', source, block)), 1, 15))::bigint as spot from dealt group by source, block)
        ), drawn as (
            select d.doc_id, d.size, d.source_size, d.target, d.rest, o.before, d.passes + (o.before < d.rest)::int as draws, o.before < d.rest and d.rest < o.before + o.words as cut,
                coalesce(sum(d.size) over (partition by d.source, d.block order by ('0x' || substr(md5(concat_ws(':', '9', d.doc_id)), 1, 15))::bigint, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as inside
            from dealt d join ordered o on d.block = o.block and d.source is not distinct from o.source
        )
        select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
            cast(case when draws = 0 then 0 else (draws - 1) * size + case when cut then greatest(0, least(rest - before - inside, size)) else size end end as bigint) as taken
        from drawn
    """,
    "op11_repair": r"""
        with recursive crc as (
            select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
        ), dealt as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda z: ord(z)::bigint)),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as draw
            from conversations, crc
        ), damaged as (
            select conv_id, turn, case when draw = 4 then 'user' else role end as role,
                case when draw = 1 then '' when draw = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when draw = 3 then 2 else 1 end)) as copy
            from dealt where draw <> 0
        ), placed as (
            select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from damaged
        ), told as (
            select *, substr(role, 1, 1) as r, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b'
                when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
                when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '' end as fault
            from placed
        ), counted as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
                count(*) filter (fault = 't') as truncated, count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal, count(*) as n
            from (select *, lag(r) over (partition by conv_id order by i) || r as pair from told) group by conv_id
        ), step(a, letter, b) as (
            values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
        ), filling(a, b, added) as (
            select a, a, []::varchar[] from (select unnest(range(4))::int as a)
            union all select f.a, s.b, list_append(f.added, case s.letter when 'u' then 'user:' else 'assistant:' end) from filling f join step s on f.b = s.a and s.letter <> 's' where len(f.added) < 2
        ), edits as (
            select conv_id, i, 3 as cost, 'D' as letter, a, a as b, []::varchar[] as said from told, (select unnest(range(4))::int as a)
            union all select conv_id, i, (fault = 't')::int, 'K', a, b, [role || ':' || text] from told join step on r = letter where fault in ('', 't')
            union all select conv_id, i, 2 + (fault = 't')::int, 'R', a, b, [case letter when 'u' then 'user' else 'assistant' end || ':' || text] from told, step where letter <> 's' and fault in ('', 't')
        ), moves as (
            select e.conv_id, e.i, f.a, e.b, 2 * len(f.added) + e.cost as cost, repeat('I', len(f.added)) || e.letter as audit, list_concat(f.added, e.said) as said from edits e join filling f on f.b = e.a
        ), least as (
            select conv_id, i, a, b, min(cost) as cost, arg_min(audit, (cost, audit)) as audit, arg_min(said, (cost, audit)) as said from moves group by conv_id, i, a, b
        ), walk as (
            select conv_id, 0::bigint as i, 0 as state, 0::bigint as cost, '' as audit, []::varchar[] as said from counted
            union all
            select conv_id, any_value(i), b, min(cost), arg_min(audit, (cost, audit)), arg_min(said, (cost, audit))
            from (select w.conv_id, m.i, m.b, w.cost + m.cost as cost, w.audit || m.audit as audit, list_concat(w.said, m.said) as said from walk w join least m on m.conv_id is not distinct from w.conv_id and m.i = w.i + 1 and m.a = w.state)
            group by conv_id, b
        ), ended as (
            select w.conv_id, min(w.cost + 2 * len(f.added)) as cost, arg_min(w.audit || repeat('I', len(f.added)), (w.cost + 2 * len(f.added), w.audit || repeat('I', len(f.added)))) as audit,
                arg_min(list_concat(w.said, f.added), (w.cost + 2 * len(f.added), w.audit || repeat('I', len(f.added)))) as said
            from walk w join counted c on c.conv_id is not distinct from w.conv_id and c.n = w.i join filling f on f.a = w.state and f.b in (0, 3) group by w.conv_id
        )
        select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated,
            cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(cost, 0) as bigint) as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(said, chr(10)), '')) as repaired_sha256
        from (select distinct conv_id from conversations) o left join counted c on c.conv_id is not distinct from o.conv_id left join ended e on e.conv_id is not distinct from o.conv_id
    """,
    "op13_fim": r"""
        with drawn as (
            select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents
        ), cut as (
            select *, len(u) as n, list_transform(range(4), lambda k: ('0x' || substr(h, 8 * k + 1, 8))::bigint) as d from drawn
        ), formed as (
            select *, least(d[1] % (n + 1), d[2] % (n + 1)) as a, greatest(d[1] % (n + 1), d[2] % (n + 1)) as b,
                case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or d[3] % 100 >= 50 then 'plain' when d[4] % 100 < 80 then 'spm' else 'psm' end as form
            from cut
        ), parts as (
            select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:], '') as suffix from formed
        )
        select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
            sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
            sha256(text) as restored_sha256
        from parts
    """,
}
