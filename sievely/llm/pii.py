"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (email, ip, card, phone) are found by patterns that read each text once: possessive runs and look-behind
instead of backtracking, so long runs cost no more than short ones. They are the seeds. Further instances are runs of
number tokens outside of base spans (every part of a run with 7 to 19 digits, so that a neighbouring number does not
hide one), dotted quads, addresses in other spellings, and tokens that hold a digit. An instance's lexical patterns are
the word before it and the word behind it, each with its exact shape and with a coarse class (number, dotted, mail).
Patterns and instances form a graph that is scored in rounds until no instance is added: a pattern's confidence is the
share of its instances (distinct strings; of the parts of a run only the longest counts) that are known, an instance's
that of being right in at least one of its cues. Of instances that pass and overlap the most confident one stays, then
the longest; tokens come last. Those become known for the next round, and are added to the base spans.

What is an instance is a definition, not a budget: an identifier holds a digit, or stands as an address. Its lengths are
parameters (Bounds): a token counts from least_token characters on, from its first digit; numbers have least_digits to
most_digits digits. A cue is the word next to an instance, at most gap_chars separators away; of a word longer than cue_chars
the nearest cue_chars characters are the cue. Lengths of tokens, runs and texts are not bounded: places in a text are summed
in blocks, and what stands around a place is cut from pieces of the text, so that work grows little faster than the text.

Cases: null and empty texts have no spans; repeated rows are rows of their own; ties between kinds go to the kind that
comes first in KINDS. An empty table gives no rows. find() reads doc_id and text; redact() keeps all columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, written

KINDS = ("email", "ip", "card", "phone")
#: Least confidence of a pattern and of an instance; least known strings behind a pattern.
PATTERN_CONFIDENCE, INSTANCE_CONFIDENCE, SUPPORT = 0.9, 0.95, 4


@dataclass(frozen=True)
class Bounds:
    """What is an instance and what is a cue."""

    least_digits: int = 7
    most_digits: int = 19
    least_token: int = 4
    cue_chars: int = 30
    gap_chars: int = 8

    @property
    def around(self) -> int:
        """Characters beside an instance that a cue can reach."""
        return self.cue_chars + self.gap_chars + 1


#: Elements that are summed at a time, and characters of a piece of text.
_STRIDE, _PIECE = 256, 1024

#: Stand-ins of one code point, of no class; the first takes the place of a dot that no domain can hold.
_STOP, _OTHER = "\uE000", "\uE001"
_LOCAL = r"A-Za-z0-9._%+\-" + _STOP
#: The same matches as the plain patterns give: email's and card's on texts where a dot or separator that cannot be
#: inside a match is another character (of no class, and as long).
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A number token, and a run of them: no part of a longer word; a failed start is not tried again within its token.
_ATOM = r"(?<![\p{L}\p{N}_@])(?<![0-9][().\-/]{1,3})[+(]{0,2}+[0-9]++(?:[().\-/]{1,3}+[0-9]++)*+(?![\p{L}\p{N}_@])"
_RUN = rf"{_ATOM}(?:[  ().\-]*+{_ATOM})*+"
_MAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++(?:@| ?[\[({<] ?(?i:at) ?[\])}>] ?)[\p{L}\p{N}._\-]++(?: ?[\[({<] ?(?i:dot) ?[\])}>] ?[\p{L}\p{N}._\-]++)*+"
_QUAD = r"^[0-9]+(?:\.[0-9]+){3}$"
#: In masked texts base spans are made of these, by kind.
_MARKS = ""


# The expressions below are SQL text: they are deeply nested, and text is parsed at once where Columns take a call for each part.
# Names that end with _ are those of lambda variables.


def token_pattern(bounds: Bounds) -> str:
    return rf"(?<!\S)[^\s0-9]*+[0-9]\S{{{bounds.least_token - 1},}}+"


def _raw(pattern: str) -> str:
    """A pattern as a literal in which nothing is escaped."""
    return f"r'{pattern}'"


def _let(value: str, name: str, body: str) -> str:
    """body, with value computed once under a name however often body reads it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan(items: str, advance: Callable, combine: Callable, emit: Callable, kind: str) -> str:
    """emit(what advance() made of all items before it, item) of each item, from 0 on: array<kind>.

    In blocks, each from where the blocks before it end: an array that grows by one element at a time is copied each time.
    """
    blocks = f"transform(sequence(0, greatest(cast(ceil(size(items_) / {_STRIDE}D) as int), 1) - 1), i_ -> slice(items_, i_ * {_STRIDE} + 1, {_STRIDE}))"
    totals = f"transform(blocks_, b_ -> aggregate(b_, 0, (at_, x_) -> {advance('at_', 'x_')}))"
    begins = f"aggregate({totals}, array(0), (acc_, t_) -> concat(acc_, array({combine('element_at(acc_, -1)', 't_')})))"
    step = f"named_struct('at', {advance('acc_.at', 'x_')}, 'out', concat(acc_.out, array({emit('acc_.at', 'x_')})))"
    of_block = f"aggregate(b_, named_struct('at', o_, 'out', cast(array() as array<{kind}>)), (acc_, x_) -> {step}, acc_ -> acc_.out)"
    return _let(items, "items_", _let(blocks, "blocks_", f"flatten(zip_with(blocks_, slice({begins}, 1, size(blocks_)), (b_, o_) -> {of_block}))"))


def _pieces(text: str) -> str:
    """The text in pieces of _PIECE characters: a place far behind is reached without counting from the text's start."""
    return f"regexp_extract_all({text}, '(?s).{{1,{_PIECE}}}', 0)"


def _cut(pieces: str, start: str, end: str) -> str:
    """The text's characters start to end, counted from 0."""
    first, last = f"cast(({start}) div {_PIECE} as int)", f"cast(({end} - 1) div {_PIECE} as int)"
    held = f"array_join(slice({pieces}, {first} + 1, {last} - {first} + 1), '')"
    return f"if({end} > {start}, substring({held}, ({start}) - {first} * {_PIECE} + 1, ({end}) - ({start})), '')"


_SPAN = "struct<start:int,end:int,value:string>"


def _matches(text: str, pattern: str) -> str:
    """array<struct<start, end, value>> in code points: what stands between matches gives their places."""
    p = _raw(pattern)
    both = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g_, v_) -> named_struct('gap', length(g_), 'n', length(v_), 'value', v_))"
    place = lambda at, x: f"named_struct('start', {at} + {x}.gap, 'end', {at} + {x}.gap + {x}.n, 'value', {x}.value)"
    # The last gap has no value behind it.
    return _scan(f"filter({both}, p_ -> p_.value is not null)", lambda at, x: f"{at} + {x}.gap + {x}.n", lambda a, b: f"{a} + {b}", place, _SPAN)


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    step = "a_ + if(k_ % 2 = 1, cast(substring(r_, k_, 1) as int), if(substring(r_, k_, 1) > '4', 2 * cast(substring(r_, k_, 1) as int) - 9, 2 * cast(substring(r_, k_, 1) as int)))"
    return _let(f"reverse({digits})", "r_", f"aggregate(sequence(1, length(r_)), 0, (a_, k_) -> {step}) % 10 = 0")


def base_spans(text: str) -> dict[str, str]:
    """Per kind array<struct<start, end, value>>, leftmost and non-overlapping."""
    mail = rf"regexp_replace(translate({text}, '{_STOP}', '{_OTHER}'), r'\.(?![A-Za-z0-9-])', '{_STOP}')"
    card = f"regexp_replace({text}, r'(?<![0-9])[ -]|[ -](?![0-9])', '{_STOP}')"
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    found = {"email": _let(mail, "t_", _matches("t_", EMAIL)), "ip": _matches(text, IP), "card": _let(card, "t_", _matches("t_", CARD)), "phone": _matches(text, PHONE)}
    some = {"email": f"contains({text}, '@')", "ip": rf"{text} rlike r'[0-9]\.[0-9]'", "card": f"{text} rlike '[0-9](?:[ -]?[0-9]){{11}}'", "phone": f"contains({text}, '+')"}
    d = f"length({_digits('z_.value')})"
    keep = {"email": "true", "ip": rf"z_.value rlike r'^{part}(?:\.{part}){{3}}$'", "card": f"{d} between 12 and 19 and if({d} <= 19, {luhn(_digits('z_.value'))}, false)", "phone": f"{d} between 9 and 15"}
    return {k: f"filter(if({some[k]}, {found[k]}, cast(array() as array<{_SPAN}>)), z_ -> {keep[k]})" for k in KINDS}


def _in_order(spans: str) -> str:
    """Spans by start, with `before`: where those before them end at most."""
    seen = lambda at, b: f"named_struct('start', {b}.start, 'kind', {b}.kind, 'end', {b}.end, 'before', {at})"
    return _scan(spans, lambda at, b: f"greatest({at}, {b}.end)", lambda a, b: f"greatest({a}, {b})", seen, "struct<start:int,kind:int,end:int,before:int>")


def _replaced(text: str, pieces: str, spans: str, by: str) -> str:
    """text with `by`, an expression of b_, in place of each span; spans: those of _in_order()."""
    parts = f"array_join(transform({spans}, b_ -> concat({_cut(pieces, 'b_.before', 'greatest(b_.start, b_.before)')}, {by})), '')"
    last = f"array_max(transform({spans}, b_ -> b_.end))"
    return f"concat({parts}, {_let(last, 'last_', _cut(pieces, 'last_', f'greatest(last_, length({text}))'))})"


def _masked(text: str, pieces: str, base: str) -> str:
    """struct<text, first>: text with the marks of their kinds in place of base spans, as long; the spans that start in no earlier one."""
    marks = f"repeat(array({', '.join(repr(m) for m in _MARKS)})[b_.kind], greatest(0, b_.end - greatest(b_.before, b_.start)))"
    first = "transform(filter(spans_, b_ -> b_.start >= b_.before), b_ -> named_struct('start', b_.start, 'kind', b_.kind, 'end', b_.end))"
    whole = _let(_in_order(base), "spans_", f"named_struct('text', {_replaced(text, pieces, 'spans_', marks)}, 'first', {first})")
    return f"if(size({base}) > 0, {whole}, named_struct('text', {text}, 'first', cast(array() as array<struct<start:int,kind:int,end:int>>)))"


def _parts(run: str, bounds: Bounds) -> str:
    """The parts of a run of number tokens with a fitting count of digits: start, end, and whether it begins (ends) the run and is the longest that does."""
    pieces = f"zip_with(split({run}.value, {_raw(_ATOM)}, -1), transform(atoms_, x_ -> x_.value), (g_, v_) -> concat(g_, coalesce(v_, '')))"
    # Each token has a digit, so more than most_digits of them never fit.
    behind = f"""transform(slice(atoms_, i_ + 1, {bounds.most_digits}), (y_, j_) -> named_struct('a', x_.start, 'b', y_.end,
        'value', concat(x_.value, array_join(slice(pieces_, i_ + 2, j_), '')), 'begins', i_ = 0, 'ends', i_ + j_ + 1 = size(atoms_)))"""
    fits = f"length({_digits('p_.value')}) between {bounds.least_digits} and {bounds.most_digits} or p_.value rlike {_raw(_QUAD)}"
    all_ = f"flatten(transform(atoms_, (x_, i_) -> filter({behind}, p_ -> {fits})))"
    marked = f"""transform(parts_, p_ -> named_struct('start', {run}.start + p_.a, 'end', {run}.start + p_.b, 'value', p_.value, 'begins', p_.begins, 'ends', p_.ends,
        'left_counts', p_.begins and p_.b = last_, 'right_counts', p_.ends and p_.a = first_))"""
    last, first = "array_max(transform(filter(parts_, p_ -> p_.begins), p_ -> p_.b))", "array_min(transform(filter(parts_, p_ -> p_.ends), p_ -> p_.a))"
    return _let(_matches(f"{run}.value", _ATOM), "atoms_", _let(pieces, "pieces_", _let(all_, "parts_", _let(last, "last_", _let(first, "first_", marked)))))


def _instances(bounds: Bounds) -> str:
    """Base spans, and what may be more: place, value, the text around it as it is and masked, the base kind that covers it, whether it is a base span or a mere token.

    Reads the columns text, pieces, masked, m_pieces, tokens, runs and mails.
    """

    def one(kind: str, seed: bool, token: bool, part: bool = False) -> str:
        start = f"greatest(x_.start - {bounds.around}, 0)"
        sides = {"before": ("begins", start, "x_.start"), "behind": ("ends", "x_.end", f"x_.end + {bounds.around}")}
        around = [(f"{mark}{name}", f"if(x_.{side}, {_cut(pieces, a, b)}, '')" if part else _cut(pieces, a, b)) for mark, pieces in (("", "pieces"), ("m_", "m_pieces")) for name, (side, a, b) in sides.items()]
        flags = [(n, f"x_.{n}" if part else "true") for n in ("begins", "ends", "left_counts", "right_counts")]
        fields = [("start", "x_.start"), ("end", "x_.end"), ("value", "x_.value"), *around, ("kind", kind), ("seed", str(seed).lower()), ("token", str(token).lower()), *flags]
        return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in fields) + ")"

    # The kind of the first base span that overlaps a token: that of the first mark in its place, since earlier spans mark first.
    mark = f"regexp_extract({_cut('m_pieces', 'x_.start', 'x_.end')}, '[{_MARKS}]', 0)"
    covers, no_kind = _let(mark, "mark_", f"if(mark_ != '', instr('{_MARKS}', mark_) - 1, null)"), "cast(null as int)"
    seeds = f"transform(transform(masked.first, b_ -> named_struct('start', b_.start, 'end', b_.end, 'kind', b_.kind, 'value', {_cut('pieces', 'b_.start', 'b_.end')})), x_ -> {one('x_.kind', True, False)})"
    parts = f"flatten(transform(runs, run_ -> {_parts('run_', bounds)}))"
    return f"""concat({seeds}, transform(tokens, x_ -> {one(covers, False, True)}),
        transform({parts}, x_ -> {one(no_kind, False, False, part=True)}), transform(mails, x_ -> {one(no_kind, False, False)}))"""


def _edges(each: DataFrame, bounds: Bounds) -> DataFrame:
    """each with links: array<struct<cue, pattern, counts>>."""
    word = lambda s, pattern: F.lower(F.regexp_extract(s, pattern, 1))
    letter = rf"\p{{L}}\p{{N}}{_MARKS}"
    cue = rf"[\p{{L}}\p{{N}}]{{1,{bounds.cue_chars}}}|[{_MARKS}]"
    left = word("m_before", rf"((?:{cue}))[^{letter}]{{0,{bounds.gap_chars}}}$")
    right = word("m_behind", rf"^[^{letter}]{{0,{bounds.gap_chars}}}({cue})")
    each = each.withColumns({
        "left": left, "right": right,
        "raw_left": word("before", rf"(\S{{1,{bounds.cue_chars}}})\s{{1,{bounds.gap_chars}}}$"), "raw_right": word("behind", rf"^\s{{1,{bounds.gap_chars}}}(\S{{1,{bounds.cue_chars}}})"),
        "shape": F.regexp_replace(F.regexp_replace("value", "[0-9]", "9"), "[A-Za-z]+", "a"),
        "number": ~F.col("token") & F.coalesce(F.col("kind").isin(2, 3), F.col("value").rlike(r"^[0-9+]|^\([0-9+]") & ~F.col("value").rlike(r"[\p{L}@]") & F.length(F.regexp_replace("value", "[^0-9]", "")).between(bounds.least_digits, bounds.most_digits)),
        "dotted": ~F.col("token") & F.coalesce(F.col("kind") == 1, F.col("value").rlike(_QUAD)),
        "mail": ~F.col("token") & F.coalesce(F.col("kind") == 0, F.col("value").rlike(r"[\p{L}@]")),
    })

    def link(side: str, name: str, when: str) -> list[Column]:
        c = F.concat(F.lit(f"{side}|"), F.col(name))
        exact = F.struct(c.alias("cue"), F.concat(F.lit(f"{side}|"), F.col(f"raw_{name}"), F.lit("|"), F.col("shape")).alias("pattern"), F.col(f"{name}_counts").alias("counts"))
        coarse = [F.when(F.col(when) & F.col(k) & (F.col(name) != ""), F.struct(c.alias("cue"), F.concat(F.lit(f"{side}:{k}|"), F.col(name)).alias("pattern"), F.col(f"{name}_counts").alias("counts"))) for k in ("number", "dotted", "mail")]
        return [F.when(F.col(when), exact), *coarse]

    links = F.array_compact(F.array(*link("L", "left", "begins"), *link("R", "right", "ends")))
    return each.select("row", "start", "end", "value", "kind", "seed", "token", links.alias("links"))


def count_of(spans: Column | str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def _read(docs: DataFrame, keep: tuple[str, ...] = (), bounds: Bounds = Bounds()) -> DataFrame:
    """row, doc_id, base array<struct<start, end, kind>> by start and kind, and the text's instances; written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), *keep)
    kinds = (f"transform({c}, z_ -> named_struct('start', z_.start, 'kind', {k}, 'end', z_.end))" for k, c in enumerate(base_spans("text").values()))
    rows = rows.withColumn("base", F.expr(f"array_sort(concat({', '.join(kinds)}))"))
    some = r"text rlike r'[0-9@]|[\[({<] ?(?i:at) ?[\])}>]'"
    rows = rows.withColumn("pieces", F.expr(f"if({some}, {_pieces('text')}, null)"))
    rows = rows.withColumn("masked", F.expr(_masked("text", "pieces", "base")))
    fewest, none = min(bounds.least_digits, 4) - 1, f"cast(array() as array<{_SPAN}>)"  # a dotted quad has four digits
    number, mail = rf"masked.text rlike r'[0-9](?:[^0-9\p{{L}}\n]*+[0-9]){{{fewest}}}'", r"masked.text rlike r'@|[\[({<] ?(?i:at) ?[\])}>]'"
    rows = rows.withColumns({
        "m_pieces": F.expr(f"if(pieces is null, null, {_pieces('masked.text')})"),
        "tokens": F.expr(f"if(text rlike '[0-9]', {_matches('text', token_pattern(bounds))}, {none})"),
        "runs": F.expr(f"if({number}, {_matches('masked.text', _RUN)}, {none})"),
        "mails": F.expr(f"if({mail}, {_matches('masked.text', _MAIL)}, {none})"),
    })
    rows = rows.withColumn("instances", F.expr(f"if(pieces is null, null, {_instances(bounds)})"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return written(rows.select("row", "doc_id", "base", "instances", *keep), "pii")


def _apart(hits: DataFrame) -> DataFrame:
    """Of hits (row, start, end, value, kind, token, doubt) those that stay where some overlap."""
    order = Window.partitionBy("row").orderBy("start", "end")
    fresh = F.coalesce(F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    group = F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rank = F.struct("token", "doubt", (F.col("start") - F.col("end")).alias("shorter"), "start", "end", "kind", "value")
    each = hits.withColumn("fresh", fresh).withColumn("group", group).groupBy("row", "group").agg(F.array_sort(F.collect_list(rank)).alias("x"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"])), acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate("x", F.slice("x", 1, 0), step)
    return each.select("row", F.explode(kept).alias("x")).select("row", "x.start", "x.end", "x.kind", "x.value")


def discovered(read: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """row, start, end, kind of the instances that patterns add."""
    each = read.where("size(instances) > 0").select("row", F.explode("instances").alias("x")).select("row", "x.*")
    each = written(_edges(each, bounds), "pii-instances")
    edges = each.select("value", "kind", F.explode("links").alias("x")).select("value", "kind", "x.*")
    edges = written(edges.groupBy("pattern", "value").agg(F.min("kind").alias("kind"), F.min("cue").alias("cue"), F.max("counts").alias("counts")), "pii-graph")
    seeds = each.where("seed").groupBy("value").agg(F.min("kind").alias("kind"))
    known = written(edges.where("kind is not null").groupBy("value").agg(F.min("kind").alias("kind")), "pii-known")
    while True:
        votes = edges.where("counts").select("pattern", "value").join(known, "value", "left").groupBy("pattern").agg(
            F.count("*").alias("n"), *(F.count_if(F.col("kind") == i).alias(f"k{i}") for i in range(len(KINDS))))
        most = F.greatest(*(f"k{i}" for i in range(len(KINDS))))
        which = F.coalesce(*(F.when(F.col(f"k{i}") == most, F.lit(i)) for i in range(len(KINDS))))
        patterns = written(votes.where(most >= SUPPORT).select("pattern", which.alias("says"), (most / F.col("n")).alias("confidence")).where(F.col("confidence") >= PATTERN_CONFIDENCE), "pii-patterns")
        cues = edges.join(patterns, "pattern").groupBy("value", "says", "cue").agg(F.max("confidence").alias("confidence"))
        # Rounded, since sums in another order differ in their last digits.
        scored = cues.groupBy("value", "says").agg(F.round(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))), 9).alias("doubt"))
        passed = scored.where(1 - F.exp("doubt") >= INSTANCE_CONFIDENCE - 1e-9).select("value", F.col("says").alias("kind"), "doubt")
        # A seed's own string is one wherever it stands.
        sure = passed.unionByName(seeds.withColumn("doubt", F.lit(-1e9))).groupBy("value").agg(F.min(F.struct("doubt", "kind")).alias("x")).select("value", "x.*")
        hits = each.where("kind is null").select("row", "start", "end", "value", "token").join(sure, "value")
        found = written(_apart(hits), "pii-found")
        fresh = found.select("value", "kind").join(known.select("value"), "value", "left_anti").groupBy("value").agg(F.min("kind").alias("kind"))
        grown = written(known.unionByName(fresh), "pii-known")
        if grown.count() == known.count():
            return found.select("row", "start", "end", "kind")
        known = grown


def find(docs: DataFrame, keep: tuple[str, ...] = (), bounds: Bounds = Bounds()) -> DataFrame:
    """doc_id, base and spans: array<struct<start, kind, end>> by start, kind (an index of KINDS), end; spans holds the base too."""
    read = _read(docs, keep, bounds)
    more = discovered(read, bounds).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    out = read.join(more, "row", "left")
    added = F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"), *keep)


def spans_text(spans: Column | str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with [EMAIL], [IP], [CARD] or [PHONE] for each span (overlapping spans as one, by the first), n_chars renewed if there."""
    names = docs.columns
    held = docs.select("doc_id", "text", F.struct(*names).alias("_held"))
    (spans,) = fresh(names, "spans")
    found = find(held, keep=("_held",)).select("_held.*", F.col("spans").alias(spans))
    text = F.col("text").cast("string")
    # Spans that overlap count as one, by the first.
    (pieces,) = fresh(found.columns, "pieces")
    quoted = lambda name: f"`{name}`"
    found = found.withColumn("text", text)
    found = found.withColumn(pieces, F.expr(f"if(size({quoted(spans)}) > 0, {_pieces('text')}, null)"))
    by = f"if(b_.start >= b_.before, array({', '.join(repr(f'[{k.upper()}]') for k in KINDS)})[b_.kind], '')"
    new = F.expr(_let(_in_order(quoted(spans)), "spans_", _replaced("text", quoted(pieces), "spans_", by)))
    out = found.withColumn("text", F.when(F.size(F.col(spans)) > 0, new).otherwise(text))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.size(F.col(spans)) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*names)
