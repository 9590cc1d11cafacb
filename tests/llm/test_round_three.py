"""Repair, neighbours and fill-in-middle against brute-force versions, on nulls, empties, ties, repeats, long texts and empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import documents, words

from sievely.llm import ann, fim, repair

# 11

TURNS = "conv_id long, turn long, role string, text string"


def brute_edits(rows):
    """The least (cost, audit, repaired) over all edit sequences with at most two inserts in a row; rows: (role, text, fault)."""
    best = None
    grammar = re.compile("(s?(ua)+)?")

    def go(i, cost, audit, said):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and grammar.fullmatch("".join(r[:1] or "?" for r, _ in said)):  # an empty role has no initial
            best = min(best or (cost, audit, said), (cost, audit, said))
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*said, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", said)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                go(i + 1, cost + more, audit + "K", [*said, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", [*said, (new, text)])

    # Deleting all rows bounds the search.
    best = (3 * len(rows), "D" * len(rows), [])
    go(0, 0, "", [])
    return best


def brute_repair(rows):
    """The contract's row for each conversation, by plain loops over (conv_id, turn, role, text)."""
    said = {}
    for c, t, role, text in rows:
        mine = said.setdefault(c, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        mine += [(t, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    out = {}
    for c, mine in said.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, told = set(), []
        for _, role, text in mine:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            told.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = {t for t, _, _ in mine if t is not None}
        cost, audit, kept = brute_edits(told)
        initials = [role[:1] for role, _, _ in told]
        out[c] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f == kind for _, _, f in told) for kind in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def conversations(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2] if c % 3 else ("system", "user", "assistant", "user", "assistant", "user")[t]
            role = rng.choice([role] * 9 + ["tool", "", None])
            rows.append((c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 1, 2]), role, rng.choice([words(rng, 3) + ".", words(rng, 2), "Yes!", "Yes!", "", " \t", None, "ö é?", "no. \n"])))
    return rows


def result(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize("whole,piece", [(4096, 512), (2, 2), (0, 1), (3, 3)])
def test_repair(spark, whole, piece):
    rows = conversations(random.Random(whole + 11), 40) + [(None, 0, "user", "a."), (None, 1, "assistant", None), (None, None, None, None), (77, None, "user", "b."), (78, 2**40, "user", "x"), (78, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "x", 1, True, "y") for r in rows], TURNS + ", key string, nonce int, live boolean, audit string")
    assert result(repair.repair(repair.damaged(df), whole, piece)) == brute_repair(rows)


def test_repair_loses_no_conversation(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = repair.damaged(spark.createDataFrame([(gone, 0, "user", "a")], TURNS))
    expected = {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert result(repair.repair(df)) == expected and result(repair.repair(df, 0, 1)) == expected
    assert repair.repair(repair.damaged(spark.createDataFrame([], TURNS))).count() == 0


def test_repair_of_a_long_conversation(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(700)}{rng.choice(['.', ''])}") for t in range(3000)] + [(1, 7, "user", "the same.")] * 500 + [(2, 0, "user", "z" * 200_000)]
    df = repair.damaged(spark.createDataFrame(rows, TURNS).repartition(5))
    whole = result(repair.repair(df))
    assert result(repair.repair(df, 100, 64)) == whole and len(whole[1][6]) > 3000


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "one."), (1, 1, "user", "two."), (2, 0, "assistant", "say.")]
    df = spark.createDataFrame(rows, TURNS).select("*", F.lit(True).alias("live"))
    got = {r["conv_id"]: (r["audit"], [(x["role"], x["text"]) for x in r["repaired"]]) for r in repair.repaired_turns(df).collect()}
    assert got == {1: ("KR", [("user", "one."), ("assistant", "two.")]), 2: ("IK", [("user", ""), ("assistant", "say.")])}


def test_search_stops_at_the_first_accepting_end():
    assert repair.search([]) == {repair.START: (0, "")}
    assert repair.search([("s", "")]) == {repair.START: (3, "D")}
    # Two ways cost 4; the audit decides.
    assert repair.search([("u", ""), ("u", "")]) == {repair.ASSISTANT: (2, "KR")}
    assert repair.search([("a", ""), ("a", "")]) == {repair.ASSISTANT: (2, "RK")}
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice("sua t"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(6))]
        (found,) = repair.search(rows).values()
        assert found == brute_edits([(r, "x", f) for r, f in rows])[:2]
        pieces = [repair.Piece.of([(None, *row) for row in rows[k : k + 2]]) for k in range(0, len(rows), 2)]
        if pieces:
            whole = repair.join_pieces(pieces)
            assert min(whole.paths[repair.START, e] for e in repair.ACCEPTING if (repair.START, e) in whole.paths) == found


# 12

VECTORS = "vec_id long, embedding array<double>, label int"


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_near(rows, every, k):
    """query_id -> [(score, vec_id)] by plain products; rows that are the same twice count once."""
    kept = sorted({(i, tuple(v)) for i, v in rows if i is not None and usable(v)})
    out = {}
    for i, v in kept:
        if i % every == 0:
            near = [(-float((np.array(v) * np.array(w)).sum()), j) for j, w in kept if (j, w) != (i, v) and len(v) == len(w)]
            out[i, v] = [(-s, j) for s, j in sorted(near)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return out


def test_neighbours_of_few(spark):
    """With fewer vectors than probed lists tell apart, all is exact: ties, copies, lengths, invalid vectors."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(60)] + [(100 + i, [1.0, 0.0, -1.0]) for i in range(45)]
    rows += [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 2.0]), (280, [float("nan"), 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (320, [1.0, 2.0]), (321, [3.0, 1.0]), (340, [5.0])]
    rows += [(20, rows[20][1]), (101, [1.0, 0.0, -1.0])]
    rows = [r for r in rows if not (r[1] and len(r[1]) == 3 and usable(r[1]) is False and r[0] is not None and r[0] < 60)]
    df = spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], VECTORS + ", rep int, key string, d int")
    assert found(ann.search(df)) == {i: near for (i, _), near in brute_near(rows, 20, 20).items() if near}
    assert ann.search(spark.createDataFrame([], VECTORS)).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0, 2.0], 0)], VECTORS)).count() == 0


def test_neighbours_with_repeated_ids(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0], 0), (20, [0.0, 1.0], 0), (3, [2.0, 1.0], 0), (3, [2.0, 1.0], 0)], VECTORS)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df).collect())
    assert got == [(20, 1, 3, 1.0), (20, 1, 3, 2.0), (20, 2, 20, 0.0), (20, 2, 20, 0.0)]


@pytest.mark.parametrize("kind", ["random", "clusters", "norms", "copies"])
def test_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 200)
    monkeypatch.setattr(ann, "BLOCK", 150)
    monkeypatch.setattr(ann, "CHUNK", 20)
    monkeypatch.setattr(ann, "SAMPLE", 500)
    rng = np.random.default_rng(7)
    n, d = 3000, 48
    v = rng.standard_normal((n, d))
    if kind == "clusters":
        v = rng.standard_normal((30, d))[rng.integers(0, 30, n)] + 0.1 * v
    elif kind == "norms":
        v *= rng.lognormal(0, 1, (n, 1))
    elif kind == "copies":
        v[: n // 3] = v[0]
        v[n // 3 : n // 2] = v[1] + 1e-3 * v[n // 3 : n // 2]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got, score = found(ann.search(df)), v @ v.T
    hits = 0
    for i in range(0, n, 20):
        row = score[i].copy()
        row[i] = -np.inf
        worst = np.sort(row)[-20]
        assert len({j for _, j in got[i]}) == 20 and i not in {j for _, j in got[i]}
        assert all(abs(s - score[i, j]) < 1e-9 for s, j in got[i]) and got[i] == sorted(got[i], key=lambda x: (-x[0], x[1]))
        hits += sum(s >= worst - 1e-9 for s, _ in got[i])
    assert hits / (20 * (n // 20)) >= 0.95


def test_candidates_are_abandoned_early():
    rng = np.random.default_rng(2)
    d = 128
    near, far = rng.standard_normal((40, d)) * 0.1 + 1, rng.standard_normal((2000, d)) * 0.1 - 1
    vectors = np.concatenate([near, far])
    block = ann.Block(np.linalg.qr(rng.standard_normal((d, d)))[0], np.arange(len(vectors)), np.arange(len(vectors)), vectors, 21)
    i, reps, score = block.scan(near[:5], np.full(5, -np.inf))
    assert block.visited < 0.6 * 5 * len(vectors) * d
    for q in range(5):
        want = sorted(zip(-(vectors @ near[q]), range(len(vectors)), strict=True))[:21]
        assert [int(r) for r in reps[i == q]] == [r for _, r in want] and np.allclose(score[i == q], [-s for s, _ in want])


# 13


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def test_fim(spark):
    rng = random.Random(9)
    texts = [(k, " " * rng.randrange(3) + words(rng, rng.randrange(30)) + rng.choice(["", "\n\n", "\t"])) for k in range(80)]
    texts += [(k, t) for k in range(100, 110) for t in (None, "", " ", "a", "日本 語 x \x0b", "a <P> b", "x<S>", "<M", "<P <S", "<", "S>< P>")] + [(5, "twice"), (5, "twice"), (None, "no id at all"), (None, None)]
    texts += [(200 + k, "\n".join(words(rng, 9) for _ in range(3000))) for k in range(4)] + [(210 + k, "z" * 300_000 + " " * 5) for k in range(4)] + [(220 + k, " " * 100_000 + "q") for k in range(4)]
    got = fim.restored(fim.transform(documents(spark, texts, clash=True)))
    rows = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr((i, *brute_fim(i, t))) for i, t in texts)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}
    assert fim.transform(documents(spark, [])).count() == 0


def test_rope():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bc", " ", "\n", "é", "  ", "z" * 40]) for _ in range(rng.randrange(900)))
        rope, units = fim.build(text), re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        assert fim.render(rope) == text and (rope.units if rope else 0) == len(units) and (rope.chars if rope else 0) == len(text)
        at = rng.randrange(len(units) + 1)
        a, b = fim.split(rope, at, "units")
        assert fim.render(a) == "".join(units[:at]) and (b.units if b else 0) == len(units) - at
        at = rng.randrange(len(text) + 1)
        a, b = fim.split(rope, at, "chars")
        assert (fim.render(a), fim.render(b)) == (text[:at], text[at:])
        assert fim.render(fim.concat(b, None, a)) == text[at:] + text[:at]
    with pytest.raises(ValueError):
        fim.invert("no mark", "psm")
