"""Repair of conversation structure by the cheapest edits.

Grammar of the roles' first letters: (s?(ua)+)?. The edits of a conversation are a path through the lattice of (rows
read, state of the grammar); no lattice is ever stored, its edges are made from the row at hand. Dijkstra's search takes
nodes by the key (cost, audit) and stops at the first node popped that has read all rows in an accepting state. The
audit is the edits' initials in order (Delete, Insert, Keep, Rerole), so the key also decides ties; a state and a letter
leave one way to go on, so an audit stands for one repaired conversation.

Conversations of up to `whole` rows are held one at a time. Longer ones are cut into pieces by a range partitioning of
their sorted rows: each piece is searched from each state to each other, the least (cost, audit) of adjoining pieces are
joined pairwise, and the repaired rows are digested in a stream. So a task holds a piece, or one audit for each pair of
states, and never the rows of a long conversation. The digest of one conversation is one sequential pass by definition.

Cases: null role and text are one space, and so are nulls in the key of the damage; rows with a null conv_id are one
conversation; rows are ordered by turn (nulls first), role, text; equal rows follow one another. An empty role has no
initial and cannot be kept. A conversation without rows has zeros, an empty audit and the digest of ''. An empty table
gives no rows. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import partitions, small_batches, written

#: The grammar's states and steps, and the costs of edits.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTING = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Rows of a conversation that one task holds, and rows of a piece of a longer one.
WHOLE, PIECE = 4096, 512

_WORD = re.compile(r"[^\x20\x09-\x0D]")
_SPACE = " \t\n\x0b\x0c\r"


def fault(text: str, seen: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated, or ''."""
    if not _WORD.search(text):
        return "blank"
    if seen:
        return "duplicate"
    return "" if text.rstrip(_SPACE)[-1] in ".!?" else "truncated"


def search(rows: list[tuple[str, str]], start: int = START, ends: Iterable[int] = ACCEPTING, first: bool = True) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) from `start` to each end state that is popped; only the first one if `first`. rows: (role's initial, fault)."""
    heap, done, found, open_ends = [(0, "", 0, start)], set(), {}, set(ends)
    while heap and open_ends:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in open_ends:
            found[state] = cost, audit
            open_ends.discard(state)
            if first:
                break
        for role in ROLES:
            if (state, role) in STEP:
                heapq.heappush(heap, (cost + INSERT, audit + "I", i, STEP[state, role]))
        if i == len(rows):
            continue
        initial, wrong = rows[i]
        heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
        if wrong in ("blank", "duplicate"):
            continue
        extra = TRUNCATED if wrong else 0
        if (state, initial) in STEP:
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, STEP[state, initial]))
        for role in ROLES:
            if (state, role) in STEP:
                heapq.heappush(heap, (cost + REROLE + extra, audit + "R", i + 1, STEP[state, role]))
    return found


def replay(audit: Iterable[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) rows."""
    state = START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = next(ROLES[r] for r in ROLES if (state, r) in STEP)
        state = STEP[state, role[:1]]
        yield role, text


@dataclass
class Measures:
    """What is counted of rows in their order; measures of adjoining parts add up."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None

    def add(self, turn: int | None, initial: str, wrong: str) -> None:
        self.plus(Measures(1, wrong == "blank", wrong == "duplicate", wrong == "truncated", 0, turn is not None, turn, turn, initial, initial))

    def plus(self, o: Measures) -> None:
        if not o.rows:
            return
        self.illegal += o.illegal + (self.rows > 0 and self.last + o.first not in LEGAL)
        self.turns += o.turns - (o.low is not None and o.low == self.high)
        self.low = o.low if self.low is None else self.low
        self.high = self.high if o.high is None else o.high
        self.first, self.last = o.first if not self.rows else self.first, o.last
        for name in ("rows", "blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(o, name))

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live: the rows after damage; those dropped stay, without text and not live, so that no conversation is lost."""
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))]
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select(*cols).withColumn("draw", F.crc32(F.encode(key, "utf-8")) % 20)
    text = F.when(F.col("draw").isin(0, 1), "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(F.col("draw") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("draw") != 0).alias("live"), copies.alias("copy")).drop("copy")


_OUT = {"conv_id": pa.int64(), **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}
_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPAIRED = _SCHEMA + ", repaired array<struct<role: string, text: string>>"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))


def repair_one(rows: list[tuple[int | None, str, str]]) -> tuple[Measures, int, str, list[tuple[str, str]]]:
    """Measures, cost, audit and repaired rows of one conversation of (turn, role, text) in order."""
    m, seen, read = Measures(), set(), []
    for turn, role, text in rows:
        wrong = fault(text, (role, text) in seen)
        seen.add((role, text))
        m.add(turn, role[:1], wrong)
        read.append((role[:1], wrong))
    (cost, audit), = search(read).values()
    return m, cost, audit, list(replay(audit, iter([(role, text) for _, role, text in rows])))


def _short(rows: DataFrame, texts: bool) -> DataFrame:
    """The result of conversations that fit in a task, sorted rows in; with their repaired rows if `texts`."""
    types = _OUT | ({"repaired": _TURNS} if texts else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        conv, first, size = None, True, 0

        def close() -> None:
            m, cost, audit, repaired = repair_one(held)
            digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in repaired).encode()).hexdigest()
            made = (conv, m.gaps, m.blank, m.duplicate, m.truncated, m.illegal, cost, audit, digest)
            out.append((*made, [{"role": r, "text": t} for r, t in repaired]) if texts else made)

        for batch in batches:
            for c, turn, role, text, live in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "live")), strict=True):
                if not first and c != conv:
                    close()
                    held = []
                    if len(out) >= 500 or size > 4_000_000:
                        yield _batch(out, types)
                        out, size = [], 0
                conv, first = c, False
                if live:
                    held.append((turn, role, text))
                    size += len(text)
        if not first:
            close()
            yield _batch(out, types)

    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _REPAIRED if texts else _SCHEMA)


@dataclass
class Piece:
    """Adjoining rows of a conversation: their measures, and the least (cost, audit) from each state to each other."""

    measures: Measures
    paths: dict[tuple[int, int], tuple[int, str]]
    size: int = field(default=1)

    @classmethod
    def of(cls, rows: list[tuple[int | None, str, str]]) -> Piece:
        """rows: (turn, role's initial, fault)."""
        m = Measures()
        for row in rows:
            m.add(*row)
        read = [row[1:] for row in rows]
        return cls(m, {(a, b): best for a in range(4) for b, best in search(read, a, range(4), False).items()})

    def then(self, o: Piece) -> Piece:
        self.measures.plus(o.measures)
        paths: dict[tuple[int, int], tuple[int, str]] = {}
        for (a, b), (cost, audit) in self.paths.items():
            for c in range(4):
                if (b, c) in o.paths:
                    more = (cost + o.paths[b, c][0], audit + o.paths[b, c][1])
                    if (a, c) not in paths or more < paths[a, c]:
                        paths[a, c] = more
        return Piece(self.measures, paths, self.size + o.size)


def join_pieces(pieces: Iterable[Piece]) -> Piece | None:
    """All pieces as one; equal sizes first, so that each letter is copied a logarithmic number of times."""
    stack: list[Piece] = []
    for piece in pieces:
        stack.append(piece)
        while len(stack) > 1 and stack[-2].size <= stack[-1].size:
            last = stack.pop()
            stack[-1] = stack[-1].then(last)
    while len(stack) > 1:
        last = stack.pop()
        stack[-1] = stack[-1].then(last)
    return stack[0] if stack else None


_NUMBERS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high")
_PIECE = {"key": pa.string(), "conv_id": pa.int64(), "part": pa.int64(), "number": pa.int64(), "numbers": pa.list_(pa.int64()), "first": pa.string(), "last": pa.string(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
_PIECE_SCHEMA = "key string, conv_id long, part long, number long, numbers array<long>, first string, last string, costs array<long>, audits array<string>"
_PAIRS = [(a, b) for a in range(4) for b in range(4)]


def _pieces(rows: DataFrame, piece: int) -> DataFrame:
    """Rows (key, conv_id, turn, role, text, live, nonce, seen) as pieces whose (part, number) is their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, number = TaskContext.get().partitionId(), [], 0
        key = conv = None

        def made() -> pa.RecordBatch:
            p = Piece.of(held)
            best = [p.paths.get(pair, (None, None)) for pair in _PAIRS]
            return _batch([(key, conv, part, number, [getattr(p.measures, n) if getattr(p.measures, n) is None else int(getattr(p.measures, n)) for n in _NUMBERS], p.measures.first, p.measures.last, [c for c, _ in best], [a for _, a in best])], _PIECE)

        for batch in batches:
            for k, c, turn, role, text, live, seen in zip(*(batch.column(n).to_pylist() for n in ("key", "conv_id", "turn", "role", "text", "live", "seen")), strict=True):
                if held and (k != key or len(held) >= piece):
                    yield made()
                    held, number = [], number + 1
                key, conv = k, c
                if live:
                    held.append((turn, role[:1], fault(text, seen)))
        if held:
            yield made()

    order = ["key", "turn", "role", "text", "nonce"]
    return rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, _PIECE_SCHEMA)


_JOINED = "key string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_JOINED_TYPES = {"key": pa.string(), **{k: v for k, v in _OUT.items() if k != "repaired_sha256"}}


def _joined(pieces: DataFrame) -> DataFrame:
    """Measures, cost and audit of each conversation of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(n).to_pylist() for n in _PIECE), strict=True)

        def piece(row: tuple) -> Piece:
            *_, numbers, first, last, costs, audits = row
            return Piece(Measures(**dict(zip(_NUMBERS, numbers, strict=True)), first=first, last=last), {p: (c, a) for p, c, a in zip(_PAIRS, costs, audits, strict=True) if c is not None})

        rows = each()
        row = next(rows, None)
        while row is not None:
            key, conv = row[:2]

            def same() -> Iterator[Piece]:
                nonlocal row
                while row is not None and row[0] == key:
                    yield piece(row)
                    row = next(rows, None)

            whole = join_pieces(same())
            m, (cost, audit) = whole.measures, min(whole.paths[START, end] for end in ACCEPTING if (START, end) in whole.paths)
            yield _batch([(key, conv, m.gaps, m.blank, m.duplicate, m.truncated, m.illegal, cost, audit)], _JOINED_TYPES)

    return pieces.repartition(partitions(pieces.sparkSession), "key").sortWithinPartitions("key", "part", "number").mapInArrow(run, _JOINED)


def _digests(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """key, repaired_sha256: rows stream behind the audit of their conversation."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("nonce", "long"))]
    stream = joined.select("key", F.lit(0).alias("kind"), "audit", *none).unionByName(rows.where("live").select("key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "nonce"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(n).to_pylist() for n in ("key", "audit", "role", "text")), strict=True)

        key, audit, types = None, None, {"key": pa.string(), "repaired_sha256": pa.string()}
        rows_in = each()
        row = next(rows_in, None)
        while row is not None:
            key, audit = row[:2]
            digest, begun = hashlib.sha256(), False
            row = next(rows_in, None)

            def turns() -> Iterator[tuple[str, str]]:
                nonlocal row
                while row is not None and row[0] == key:
                    yield row[2], row[3]
                    row = next(rows_in, None)

            said = turns()
            for role, text in replay(audit, said):
                digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True
            for _ in said:  # rows deleted behind the last edit are in the audit, so none is left
                raise ValueError("an audit does not cover its conversation")
            yield _batch([(key, digest.hexdigest())], types)

    order = ["key", "kind", "turn", "role", "text", "nonce"]
    return stream.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions(*order).mapInArrow(run, "key string, repaired_sha256 string")


def _long(rows: DataFrame, piece: int) -> DataFrame:
    """The result of conversations that are cut into pieces; rows: key and those of damaged()."""
    rows = written(rows.withColumn("nonce", F.monotonically_increasing_id()), "long-conversations")
    # The first of equal rows of a conversation, by a pre-aggregated grouping; back by the row's own number, which has no hot key.
    said = rows.where("live").groupBy("key", "role", F.md5(F.encode("text", "utf-8")).alias("said")).agg(F.min(F.struct("turn", "nonce")).alias("f"))
    firsts = said.select(F.col("f.nonce").alias("nonce"), F.lit(False).alias("seen"))
    flagged = rows.join(firsts, "nonce", "left").withColumn("seen", F.coalesce("seen", F.lit(True)))
    joined = written(_joined(_pieces(flagged.where("live"), piece)), "long-audits")
    result = joined.join(_digests(rows, joined), "key").select(*_OUT)
    # Conversations of which nothing is left have no pieces.
    empty = rows.groupBy("key", "conv_id").agg(F.max("live").alias("any")).where("not any")
    zeros = [F.lit(0).cast("long").alias(n) for n in list(_OUT)[1:7]]
    return result.unionByName(empty.select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256")))


def repair(rows: DataFrame, whole: int = WHOLE, piece: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of damaged() rows."""
    small_batches(rows.sparkSession)
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    long_ones = written(rows.groupBy(key.alias("key")).count().where(F.col("count") > whole).select("key"), "long-ids")
    if long_ones.isEmpty():
        return _short(rows, False)
    keyed = rows.withColumn("key", key)
    return _short(keyed.join(long_ones, "key", "left_anti").drop("key"), False).unionByName(_long(keyed.join(long_ones, "key"), piece))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """repair() with `repaired`, the turns themselves, as array<struct<role, text>>: for conversations that fit in a row."""
    small_batches(rows.sparkSession)
    return _short(rows, True)
