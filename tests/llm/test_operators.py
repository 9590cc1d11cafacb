"""Each operator against a brute-force version, a round trip or held-out labels, on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from sievely.llm import bpe, chat, minhash, mixing, pii, spotsigs, suffix, toxicity, vectors, warc
from sievely.llm._common import Hasher
from sievely.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of no concern, some with names that operators use inside.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, rep long, bucket int, size string, block string, row string, component string, spans string, anchor long, _row string, _spans string, shard long, place string, _n long, _kept long, kept_place int, drawn_by int, time int, words int, taken int, _held string"


def words(rng, n):
    return " ".join(rng.choice("the of and alpha beta gamma delta omega kappa sigma river stone cloud light house in is to".split()) for _ in range(n))


def documents(spark, texts, source=None, clash=False):
    rows = [(i, t, "en", source[k] if source else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(texts)]
    if clash:
        rows = [(*r, 1, 1, "x", "x", "x", "x", "x", 1, "x", "x", 1, "x", 1, 1, 1, 1, 1, 1, 1, "x") for r in rows]
    return spark.createDataFrame(rows, CLASH if clash else DOCS)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(200, 100 + k) for k in range(40)]
    parent = list(range(300))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}


# 1


def test_spotsigs(spark):
    rng = random.Random(2)
    texts = [(k, words(rng, rng.randrange(60))) for k in range(40)] + [(50, None), (51, ""), (52, "plain"), (53, "x " * 40_000), (54, "The, THE the"), (55, "日本語 テスト"), (None, "the end of it"), (52, "twice")]
    rows = spotsigs.compare_with_edits(documents(spark, texts, clash=True)).collect()
    order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in rows}
    assert len(rows) == len(texts)
    cut = lambda f: {f[k : k + 8] for k in range(0, len(f), 8)}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i, len(t), hashlib.sha256(edited.encode()).hexdigest()]
        a, b = cut(r["fingerprint"]), cut(r["edited_fingerprint"])
        assert abs(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
    assert spotsigs.compare_with_edits(documents(spark, [])).count() == 0
    alone = spotsigs.compare_with_edits(documents(spark, [(7, "the stone river cloud and house light omega")])).first()
    assert alone["near_next"] == 1.0


def plain_spots(text):
    """The spots of a text as tuples of words, by the rules of the operator's docstring alone."""
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")]
    if not ws:
        return set()
    common = set(spotsigs.ANCHORS)
    content = [k for k, w in enumerate(ws) if w not in common]

    def chain(k):
        return tuple(ws[j] for j in content if j > k)[:3]

    order = lambda w: int(Hasher(np.frombuffer(w.encode(), np.uint8))(np.array([0]), np.array([len(w.encode())]))[0])
    places = {k for k, w in enumerate(ws) if w in common}
    for k in range(len(ws) - 3):
        if not any(w in common for w in ws[k : k + 4]):
            places.add(min(range(k, k + 4), key=lambda j: (order(ws[j]), j)))
    if len(content) > 3:
        places.add(content[-4])
    return {("start", chain(-1))} | {(ws[k], chain(k)) for k in places if len(chain(k)) == 3}


def test_spotsigs_equal_plain_spots(spark):
    rng = random.Random(31)
    texts = [(k, " ".join(rng.choice(["the", "von", "LAS", "x1", "Beta", "été", "日本", "river", "stone", "light", "cloud,", "a-b"]) for _ in range(rng.choice([0, 1, 3, 4, 5, 9, 40])))) for k in range(60)]
    rows = {r["doc_id"]: r for r in spotsigs.compare_with_edits(documents(spark, texts)).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, t in texts:
        nxt = texts[k - 1][1]
        half = len(t) // 2
        mine = plain_spots(t)
        assert abs(rows[k]["near_next"] - like(mine, plain_spots(nxt))) < 1e-12, (t, nxt)
        assert abs(rows[k]["near_edited"] - like(mine, plain_spots(t[: len(t) - half] + nxt[:half]))) < 1e-12
        assert len(rows[k]["fingerprint"]) == 8 * len(mine)


def test_every_content_word_is_in_a_spot():
    rng = random.Random(21)
    for n in range(1, 40):
        for share in (0, 0.1, 0.5):
            text = [rng.choice(["the", "and"]) if rng.random() < share else f"w{k}" for k in range(n)]
            for k, w in enumerate(text):
                if w[0] == "w":
                    both, at = spotsigs.spots(pa.array([" ".join(text), " ".join([*text[:k], "other", *text[k + 1 :]])]))
                    low = both & np.uint64(0xFFFFFFFF)
                    assert set(low[: at[1]]) != set(low[at[1] :])


def test_spotsigs_join_loses_no_pair(spark):
    rng = random.Random(3)
    base = [words(rng, 120) for _ in range(6)]
    texts = [(k, t) for k, t in enumerate(base + [t.replace("river", "river", 1) + " the stone cloud light" for t in base] + [" ".join(t.split()[:110]) for t in base] + base[:2])]
    prints = {r["doc_id"]: frozenset(r["fingerprint"][k : k + 8] for k in range(0, len(r["fingerprint"]), 8)) for r in spotsigs.fingerprints(documents(spark, texts)).collect()}
    lead = {}
    for i, f in sorted(prints.items()):
        lead.setdefault(f, i)
    want = {(a, b) for (fa, a), (fb, b) in itertools.permutations(lead.items(), 2) if a < b and len(fa & fb) / len(fa | fb) >= 0.8}
    assert {(r["a"], r["b"]) for r in spotsigs.near_pairs(documents(spark, texts), 0.8).collect()} == want and want


def test_pruned_jaccard():
    a, b = (spotsigs.spots(pa.array(t)) for t in (["the stone river cloud", ""], ["the stone river cloud and the light house omega kappa", ""]))
    assert spotsigs.jaccard(*a, *b, floor=0.9).tolist() == [0.0, 1.0] and spotsigs.jaccard(*a, *b)[0] > 0


# 2


NASTY = ["", "</s>", "\\</s>", "a\\", "[INST]\n[/INST]\n", "\n</s>\n<s>\n", "\\\\[INST]", "<<ROLE>>\nx\n<</ROLE>>\n", "<</TURN>>", "<<SYS>", "x\n", "\n", "é</s>😀"]


def test_chat_round_trip():
    rng = random.Random(4)
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "</s>", "a\nb"]), "".join(rng.choice(NASTY) for _ in range(rng.randrange(4)))) for _ in range(rng.randrange(6))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    plain, _ = chat.render([("user", "hello [x] \\ there")])
    assert plain == "[INST]\nhello [x] \\ there\n[/INST]\n"
    assert chat.parse("[INST]\nopen") is None and chat.parse("junk") is None


def test_chat_table(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, "user", "</s>"), (None, 0, "user", "x"), (3, 0, "assistant", "y" * 200_000), (1, 1, "assistant", "b"), (4, None, "user", "first"), (4, 0, "user", "second")]
    df = spark.createDataFrame([(*r, "z", 9) for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss_starts int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "a"), ("assistant", "b"), ("assistant", "b")] and got[1]["loss_texts"] == ["b", "b"]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", ""), ("user", "</s>")]
    assert [t["text"] for t in got[4]["turns"]] == ["first", "second"] and got[3]["loss_texts"] == ["y" * 200_000] and None in got
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# 3


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute_groups(texts, n, percent):
    sets = {i: shingles(t, n) for i, t in texts}
    comp = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return {(i, len(sets[i]), comp[i], comp[i] == i) for i in sets}


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_minhash_groups(spark, n, percent):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(80)] for _ in range(4)]
    texts = []
    for b in base:  # copies of a hub: each is near the hub, few are near one another
        for _ in range(14):
            c = list(b)
            for _ in range(rng.randrange(4)):
                c[rng.randrange(len(c))] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(c))
    texts += [None, "", "  \n", "one two", "ONE\ttwo", "one", "a b c d e f g h i", "a b c d e f g h i j", texts[0], texts[0].upper(), "z " * 30_000]
    rows = list(enumerate(texts))
    got = {tuple(r) for r in minhash.groups(documents(spark, rows, clash=True), n, percent).collect()}
    assert got == brute_groups(rows, n, percent)


def test_minhash_blocks_and_dedup(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    chain = [" ".join(base[k : k + 50]) for k in range(0, 10, 2)] + [" ".join(base[:50] + [f"y{rng.randrange(99)}" for _ in range(k)]) for k in range(8)]
    rows = list(enumerate(chain)) + [(3, chain[3]), (None, chain[0])]
    known = [(i, t) for i, t in rows if i is not None][: len(chain)]
    got = {tuple(r) for r in minhash.groups(documents(spark, rows), 3, 85).where("doc_id is not null").distinct().collect()}
    assert got == brute_groups(known, 3, 85)
    kept = minhash.dedup(documents(spark, rows), 3, 85)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted([(True, 0)] + [(False, i) for i, _, _, k in got if k])
    assert minhash.groups(documents(spark, [])).count() == 0


def test_minhash_tells_regular_words_apart(spark):
    """Words of equal length whose letters follow the parity of a count of bits: polynomial hashes modulo 2^64 take them for one."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    rows = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one.upper())]
    assert {(r["doc_id"], r["component_id"]) for r in minhash.groups(documents(spark, rows), 3, 85).collect()} == {(1, 1), (2, 2), (3, 1)}
    assert {r["doc_id"]: r["near_next"] for r in spotsigs.compare_with_edits(documents(spark, rows)).collect()}[2] == 0.0


def test_dedup_judges_rows(spark):
    x, y = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    rows = [(1, x), (9, y), (3, x), (3, y), (3, y), (None, x), (None, x), (4, ""), (4, ""), (5, None)]
    kept = minhash.dedup(documents(spark, rows, clash=True), 3, 85)
    assert kept.columns == documents(spark, rows, clash=True).columns
    want = [(1, x), (3, y), (None, x), (None, x), (4, ""), (4, ""), (5, None)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, want))
    plain = [(1, x), (3, x), (9, y), (None, x)]
    kept = minhash.dedup(documents(spark, plain, clash=True), 3, 85)
    assert kept.columns == documents(spark, rows, clash=True).columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "9", "None"]
    ids = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.groups(documents(spark, rows[:5]), 3, 85).collect()}
    assert ids == {(1, 1, True), (9, 3, False), (3, 1, False), (3, 3, True)}


def test_banding_finds_pairs_at_the_threshold():
    """No pair at the threshold of 1,500 of each size is missed; MISS bounds the expected share by one in a million."""
    rng = np.random.default_rng(23)
    for percent in (80, 85):
        bands, rows = minhash.bands_and_rows(percent)
        orders = minhash._orders(bands * rows)
        for union in (20, 100, 900):
            shared = -(-percent * union // 100)
            for _ in range(1500 if union < 900 else 300):
                x = rng.integers(0, 2**63, size=union).astype(np.uint64) * np.uint64(2)
                split = shared + (union - shared) // 2
                a, b = (minhash.signature(np.sort(s), bands * rows, orders).reshape(bands, rows) for s in (x[:split], np.concatenate((x[:shared], x[split:]))))
                assert (a == b).all(axis=1).any()


def test_signature_estimates_likeness():
    rng = np.random.default_rng(7)
    orders = minhash._orders(180)
    for size, shared in ((12, 11), (400, 360)):
        hit = []
        for _ in range(60):
            x = rng.permutation(np.unique(rng.integers(0, 2**63, size=2 * size - shared).astype(np.uint64) * np.uint64(2)))
            hit.append((minhash.signature(np.sort(x[:size]), 180, orders) == minhash.signature(np.sort(x[-size:]), 180, orders)).mean())
        assert abs(np.mean(hit) - (2 * size - len(x)) / len(x)) < 0.2


# 4


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    texts = [None, "", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "%%%%% !!!", " \n\n  x\t\ty  ", "日本語 😀é", "it's we'll I'D", "0" * 3000, "ab" * 4000]
    texts += ["".join(rng.choice("aab e'stl<|>\n 1é%") for _ in range(rng.randrange(120))) for _ in range(150)] + ["".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(40)) for _ in range(60)]
    df = documents(spark, list(enumerate(texts)), clash=True)
    got = {r["doc_id"]: r for r in bpe.encode_and_decode(df).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == t.decode(ids, skip_special_tokens=False) == (x or "")
    coded = bpe.encode(df)
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(coded).collect()} == {i: x or "" for i, x in enumerate(texts)}
    assert bpe.encode(documents(spark, [])).count() == 0


def test_automaton_by_hand():
    labels = {0: b"a", 1: b"b", 2: b"aa", 3: b"ab", 4: b"aab"}
    a = bpe.Automaton(labels, [(0, 0, 2), (0, 1, 3), (2, 1, 4)])
    # Numbers along leftmost parts, latest first: a, ab, aa, aab, b. Behind a, all that begins with a is lacking, and b; behind aa only b.
    assert a.place == [0, 4, 2, 1, 3] and a.state.tolist() == [0, 1, 2, 1, 1]
    assert a.first.tolist() == [0, 2, 2, 3] and a.low.tolist() == [0, 4, 4] and a.high.tolist() == [4, 5, 5]
    assert a.encode(b"aab") == [4] and a.encode(b"aaa") == [2, 0] and a.encode(b"ab") == [3] and a.encode(b"aaab") == [2, 3]
    assert not a.has_arc(0, 0) and not a.has_arc(2, 1) and a.has_arc(1, 0)


def test_small_automata_equal_plain_bpe():
    rng = random.Random(33)
    for _ in range(60):
        labels, merges = {0: b"a", 1: b"b", 2: b"c"}, []
        while len(merges) < 9:
            u, v = rng.choice(list(labels)), rng.choice(list(labels))
            if labels[u] + labels[v] not in labels.values():
                labels[len(labels)] = labels[u] + labels[v]
                merges.append((u, v, len(labels) - 1))
        a = bpe.Automaton(labels, merges)
        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
            parts = [b"abc".index(x) for x in word]
            for u, v, w in merges:  # plain BPE: all pairs of a merge, from the left, merge after merge
                k = 0
                while k < len(parts) - 1:
                    if parts[k : k + 2] == [u, v]:
                        parts[k : k + 2] = [w]
                    k += 1
            assert a.encode(word) == parts
            assert all(a.has_arc(x, y) for x, y in itertools.pairwise(parts))


def test_bpe_refuses_other_files(tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"byte_fallback": True}}, {"model": spec["model"] | {"ignore_merges": True}},
                   {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.compile_automaton(str(tmp_path / "v.json"))
    with pytest.raises(ValueError):
        bpe.compile_automaton(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_is_encoded_by_the_compiled_states():
    """The encoder reads the intervals of the gadgets and nothing else: without them, or with the states mixed up, ids are other ones."""
    import public_tokenizers

    rng = random.Random(31)
    alphabet = [rng.choice("abcdeilnorst ") for _ in range(4000)]
    word = "".join(alphabet).encode()
    a, _ = bpe.compile_automaton(public_tokenizers.path("byte_bpe_50k.json"))
    right = a.encode(word)
    assert b"".join(a.labels[x] for x in right) == word and all(a.has_arc(x, y) for x, y in itertools.pairwise(right))
    assert len(a.first) - 1 < 20_000 and len(a.low) < 400_000  # states and numbers of the whole table
    high, state = a.high, a.state
    a.high = high[:0] + type(high)("i", bytes(4 * len(high)))  # nothing is lacked: the longest label always goes
    greedy = a.encode(word)
    a.high, a.state = high, type(state)("i", [max(x, 0) for x in reversed(state)])
    mixed = a.encode(word)
    assert greedy != right and mixed != right


# 5


def test_warc_damage_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", "".join(chr(97 + (k * j) % 25) for j in range(3000))) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    ((path, size),) = warc.write_archives(df, str(tmp_path / "w"))
    local = path.removeprefix("file://")
    with open(local, "rb") as f:
        whole = f.read()
    starts = [m.start() for m in re.finditer(re.escape(b"\x1f\x8b\x08"), whole)]
    for damaged in (whole[:-9], whole[: starts[20]] + b"\0" * 9 + whole[starts[20] + 9 :], whole[: starts[5] + 90] + b"\xff" * 20 + whole[starts[5] + 110 :], b"x" + whole):
        with open(local, "wb") as f:
            f.write(damaged)
        for split in (700, 10**7):
            with pytest.raises(Exception, match="damaged|no record"):
                warc.read_archives(spark, [(path, len(damaged))], split).count()


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(9)
    big = "".join(rng.choice("abcdef<>é") for _ in range(3000))
    rows = [(k, f"http://h/{k}", "".join(chr(rng.randrange(1, 800)) for _ in range(rng.randrange(4000)))) for k in range(60)]
    rows += [(100, "u\r\nX: y", big), (101, None, big), (102, "u", big), (103, "u", "small"), (104, "u", "small"), (105, "u", None), (None, "u", big), (102, "u", big), (106, "WARC", "\x1f\u008b\x08 WARC/1.1\r\n\r\n" * 300)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, digest string, refers_to int")
    files = warc.write_archives(df, str(tmp_path / "w"))
    for split in (97, 1000, 10**7):
        got = warc.read_archives(spark, files, split).collect()
        assert len(got) == len(rows)
        for r in got:
            html = next(h or "" for i, _, h in rows if i == r["page_id"]).encode()
            assert r["payload_bytes"] == len(html) and r["payload_digest"] == hashlib.sha1(html).hexdigest()
            revisit = r["page_id"] in (100, 101, None)
            assert (r["record_type"], r["refers_to"]) == (("revisit", 102) if revisit else ("response", None))
            assert r["payload"] is None if revisit else bytes(r["payload"]) == html
    assert warc.read_archives(spark, warc.write_archives(df.limit(0), str(tmp_path / "e"))).count() == 0


# 6


def brute_removed(rows):
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_removal(spark):
    rng = random.Random(10)
    base = "".join(rng.choice("abcde fgh é") for _ in range(2500))
    texts = []
    for _ in range(70):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(2200)
            parts += [base[a : a + rng.choice([30, 99, 100, 101, 140, 300])], "".join(rng.choice("xyz ") for _ in range(rng.randrange(40)))]
        texts.append("".join(parts))
    texts += ["a" * 900, "ab" * 300, None, "", "a" * 120, texts[0]]
    rows = list(enumerate(texts))
    assert sorted((tuple(r) for r in suffix.summary(suffix.removed_spans(documents(spark, rows, clash=True))).collect()), key=str) == brute_removed(rows)
    odd = [(None, base[:300]), (5, base[100:450]), (5, base[100:450]), (2, base[:50])]
    order = sorted(odd, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted((tuple(r) for r in suffix.summary(suffix.removed_spans(documents(spark, odd))).collect()), key=str) == brute_removed(order)
    assert suffix.removed_spans(documents(spark, [])).count() == 0


def test_interval_expansion_by_hand():
    rng = np.random.default_rng(11)
    for length in (2, 5, 9):
        text = rng.integers(1, 4, 300)
        ends = np.zeros(300, bool)
        ends[[99, 199, 299]] = True
        text[ends] = 0
        order, shares = suffix.long_runs(text, ends, length)
        segment = np.cumsum(np.concatenate(([0], ends[:-1])))
        want = lambda i: tuple(text[i : i + length]) if i + length <= 300 and segment[i] == segment[min(i + length - 1, 299)] and not ends[i : i + length].any() else None
        for k in range(1, 300):
            a, b = want(order[k - 1]), want(order[k])
            assert shares[k] == (a is not None and a == b)


# 7


def test_toxicity_thresholds():
    """A language's own threshold from LANGUAGE_FROM calibration rows of each label on; with fewer all languages' one."""
    for n, own in ((toxicity.LANGUAGE_FROM, True), (toxicity.LANGUAGE_FROM - 1, False)):
        texts = ["the and of bad" if k % 2 else "the and of good" for k in range(60)] + ["der die das schlimm" if k < n else "der die das fein" for k in range(2 * n)]
        y = np.array([k % 2 for k in range(60)] + [int(k < n) for k in range(2 * n)])
        words_ = toxicity.read_words(pa.array(texts))
        model = toxicity.train(words_, y, np.zeros(len(y), bool))  # nothing is kept from training, so all rows set the thresholds
        assert (model.shift[2] != model.shift[4]) == own and model.shift[1] == model.shift[4]


def test_toxicity(spark):
    rng = random.Random(12)
    texts, labels = [], []
    for k in range(700):
        t, y = words(rng, 30).split(), k % 4 == 0
        if y:
            t[rng.randrange(30)] = rng.choice(["vequta", "vequmo", "veqult", "vequrr", "vequille"])
        texts.append((k, " ".join(t)))
        labels.append((k, 1, int(y)))
    texts += [(900, None), (901, ""), (902, "%%%"), (903, "word " * 50_000)]
    docs, marks = documents(spark, texts, clash=True), spark.createDataFrame(labels + [(5000, 1, 1), (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    held = [k for k in range(700) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 4 == 0) for k in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 704 and got[900] == got[901] == got[902]
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    assert toxicity.fit(docs, marks, train_rows=40, train_bytes=3000).bias != model.bias  # trained on fewer
    assert set(toxicity.fit(docs, marks, train_bytes=10).weights) == {0.0}  # no whole text fits
    twice = docs.unionByName(docs)
    assert (toxicity.fit(twice, marks.unionByName(marks)).embedding == model.embedding).all() and toxicity.scores(twice, model).count() == 2 * len(got)
    none = toxicity.fit(docs, marks.limit(0))
    assert toxicity.scores(docs.limit(3), none).count() == 3 and toxicity.scores(docs.limit(0), none).count() == 0
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", toxicity.is_held_out().alias("h")).collect()}
    assert all(flags[k] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(700))


# 8


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for k, (name, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            double = sum(int(c) if n % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for n, c in enumerate(reversed(d)))
            if {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".") if x.isdigit()), "card": 12 <= len(d) <= 19 and double % 10 == 0, "phone": 9 <= len(d) <= 15}[name]:
                out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(out))


def test_pii_base_and_redaction(spark):
    rng = random.Random(13)
    bits = ["a", "b.", "@", "c-", "1", "22", ".", " ", "+", "-", "(", "%", "_", "x@y.co", "4111 1111 1111 1111", "127.0.0.1", "\n", "é", "😀", "", "+1 (555) 010-9999"]
    texts = list(enumerate(["".join(rng.choice(bits) for _ in range(rng.randrange(50))) for _ in range(300)] + [None, "", "1" * 20_000, "1 " * 9000, "a@b" + ".c" * 9000, "a" * 40_000 + "@", "+1" + " " * 20_000, "x@y.zz " * 600]))
    df = documents(spark, texts, clash=True)
    found = pii.find(df).select("doc_id", pii.spans_text("base").alias("b"), "spans", "base").collect()
    assert {r["doc_id"]: r["b"] for r in found} == {i: brute_pii(t) for i, t in texts}
    assert all(set(r["base"]) <= set(r["spans"]) for r in found)
    safe = pii.redact(documents(spark, [(1, "to a.b@c.org or +1 (555) 010-9999!"), (2, None), (3, "none")]))
    rows = {r["doc_id"]: r for r in safe.collect()}
    assert rows[1]["text"] == "to [EMAIL] or [PHONE]!" and rows[1]["n_chars"] == 22 and rows[2]["text"] is None and rows[3]["text"] == "none"
    assert pii.find(documents(spark, [])).count() == 0 and pii.redact(documents(spark, [])).count() == 0


def test_pii_strides_change_nothing(spark, monkeypatch):
    """Places are summed and texts are cut in strides; short ones give what long ones give, which other tests hold against plain loops."""
    rng = random.Random(14)
    bits = ["call ", "b.", "@", "1", "22 ", ".", " ", "+", "é", "😀 ", "x@y.co ", "4111 1111 1111 1111", "127.0.0.1", "\n", "+1 (555) 010-9999 ", "bob [at] mail [dot] org", "555 1234 567 "]
    texts = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for k in range(60)] + [(70, None), (71, "")]
    df = documents(spark, texts)

    def read():
        rows = pii._read(df).select("doc_id", "base", "instances").collect()
        return {r["doc_id"]: (r["base"], sorted(map(str, r["instances"] or []))) for r in rows}, {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}

    whole = read()
    monkeypatch.setattr(pii, "_STRIDE", 3)
    monkeypatch.setattr(pii, "_PIECE", 7)
    assert read() == whole


def test_pii_bounds(spark):
    """Each bound on both sides."""
    texts = ["lot 12345 and 1234567 or 12345678901234567890 of ab1 abc1 a1bcd"]

    def values(**bounds):
        (row,) = pii._read(documents(spark, list(enumerate(texts))), bounds=pii.Bounds(**bounds)).select("instances").collect()
        return {x["value"] for x in row["instances"] if not x["token"]}, {x["value"] for x in row["instances"] if x["token"]}, {x["value"]: (x["before"], x["behind"]) for x in row["instances"] if not x["token"]}

    numbers, tokens, _ = values()
    assert numbers == {"1234567"} and tokens == {"12345", "1234567", "12345678901234567890", "a1bcd"}
    assert values(least_digits=5)[0] == {"12345", "1234567"} and values(least_digits=8)[0] == set()
    assert values(most_digits=20)[0] == {"1234567", "12345678901234567890"} and values(most_digits=6)[0] == set()
    assert values(least_token=1)[1] == tokens | {"ab1", "abc1"} and values(least_token=5)[1] == tokens - {"a1bcd"}
    assert values(cue_chars=2, gap_chars=1)[2]["1234567"] == ("and ", " or ")


def test_pii_bootstrap(spark):
    good = [(k, f"please pay with card 4111-1111-1111-11{k:02d} now") for k in range(100)]
    known = [i for i, t in good if brute_pii(t)]
    assert 5 <= len(known) <= 15
    kept = [(i, t) for i, t in good if i in known] + [(500, "please pay with card 4111-1111-1111-9999 now"), (501, "the lot 4111-1111-1111-9998 is gone")]
    found = {r["doc_id"]: r["s"] for r in pii.find(documents(spark, kept)).select("doc_id", pii.spans_text("spans").alias("s")).collect()}
    assert found[500] == "card:21:40" and found[501] == ""


def test_pii_bootstrap_in_other_formats(spark):
    """Phones without +, grouped otherwise, in front of an ip, and addresses in another spelling, by the words around them."""
    seeds = [(k, f"please call +1 ({200 + k}) 555-{1000 + 37 * k} today or write to ann{k}@mail.example.org soon") for k in range(60)]
    more = {
        100: ("please call 303 555 7788 today", "phone:12:24"), 101: ("please call: (303) 5557-789, today", "phone:13:27"),
        102: ("please call +1 (303) 555-7790 10.0.0.1 today", "phone:12:29,ip:30:38"), 103: ("write to bob [at] mail [dot] example.org soon", "email:9:40"),
        104: ("the lot 303 555 7788 of 303 555 7791 is gone", "phone:8:20"), 105: ("x " * 50 + "please call 303.555.7792 today", "phone:112:124"),
    }
    texts = seeds + [(i, t) for i, (t, _) in more.items()]
    found = {r["doc_id"]: r["s"] for r in pii.find(documents(spark, texts)).select("doc_id", pii.spans_text("spans").alias("s")).collect()}
    assert {i: found[i] for i in more} == {i: s for i, (_, s) in more.items()}
    assert all(found[i] == brute_pii(t) for i, t in seeds)


def plain_discovery(texts):
    """The spans of find(), by loops over the patterns' own definition of instances: (doc, kind, start, end)."""
    import math

    kinds, each, base_of = list(PLAIN), [], {}
    digits = lambda v: len(re.sub("[^0-9]", "", v))
    quad = re.compile(pii._QUAD)
    for doc, text in texts:
        text = text or ""
        base = sorted((int(a), kinds.index(k), int(b)) for k, a, b in (x.split(":") for x in brute_pii(text).split(",") if x))
        base_of[doc], masked, at, first = base, "", 0, []
        for a, k, b in base:
            if a >= at:
                first.append((a, k, b))
                masked += text[at:a]
            masked += pii._MARKS[k] * max(0, b - max(at, a))
            at = max(at, b)
        masked += text[at:]
        found = [(a, b, text[a:b], k, True, False, (1, 1, 1, 1)) for a, k, b in first]
        found += [(m.start(), m.end(), m[0], next((k for a, k, b in base if a < m.end() and b > m.start()), None), False, True, (1, 1, 1, 1)) for m in regex.finditer(pii.token_pattern(pii.Bounds()), text)]
        for run in regex.finditer(pii._RUN, masked):
            atoms = [(m.start(), m.end()) for m in regex.finditer(pii._ATOM, run[0])]
            parts = [(a, b, i == 0, j == len(atoms) - 1) for i, (a, _) in enumerate(atoms) for j, (_, b) in enumerate(atoms) if j >= i and (7 <= digits(run[0][a:b]) <= 19 or quad.match(run[0][a:b]))]
            far, near = max((b for _, b, x, _ in parts if x), default=None), min((a for a, _, _, x in parts if x), default=None)
            found += [(run.start() + a, run.start() + b, run[0][a:b], None, False, False, (x, y, x and b == far, y and a == near)) for a, b, x, y in parts]
        found += [(m.start(), m.end(), m[0], None, False, False, (1, 1, 1, 1)) for m in regex.finditer(pii._MAIL, masked)]
        letter = rf"\p{{L}}\p{{N}}{pii._MARKS}"
        for a, b, value, kind, seed, token, (begins, ends, left_counts, right_counts) in found:
            shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "9", value))
            number = not token and (kind in (2, 3) if kind is not None else bool(re.match(r"[0-9+]|\([0-9+]", value)) and not regex.search(r"[\p{L}@]", value) and 7 <= digits(value) <= 19)
            dotted = not token and (kind == 1 if kind is not None else bool(quad.match(value)))
            mail = not token and (kind == 0 if kind is not None else bool(regex.search(r"[\p{L}@]", value)))
            links = []
            for side, on, counts, near_, raw in (("L", begins, left_counts, regex.search(rf"([\p{{L}}\p{{N}}]{{1,30}}|[{pii._MARKS}])[^{letter}]{{0,8}}$", masked[max(0, a - 38) : a]), re.search(r"(\S{1,30})\s{1,8}$", text[max(0, a - 38) : a])),
                                                 ("R", ends, right_counts, regex.search(rf"^[^{letter}]{{0,8}}([\p{{L}}\p{{N}}]{{1,30}}|[{pii._MARKS}])", masked[b : b + 39]), re.search(r"^\s{1,8}(\S{1,30})", text[b : b + 39]))):
                if not on:
                    continue
                cue, word = (near_[1].lower() if near_ else ""), (raw[1].lower() if raw else "")
                links.append((f"{side}|{cue}", f"{side}|{word}|{shape}", counts))
                links += [(f"{side}|{cue}", f"{side}:{n}|{cue}", counts) for n, x in (("number", number), ("dotted", dotted), ("mail", mail)) if x and cue]
            each.append((doc, a, b, value, kind, seed, token, links))
    edges = {}
    for _, _, _, value, kind, _, _, links in each:
        for cue, pattern, counts in links:
            old = edges.get((pattern, value), (None, cue, False))
            edges[pattern, value] = (kind if old[0] is None else old[0] if kind is None else min(old[0], kind), min(old[1], cue), bool(old[2] or counts))
    known, seeds = {}, {}
    for (_, value), (kind, _, _) in edges.items():
        if kind is not None:
            known[value] = min(kind, known.get(value, 9))
    for _, _, _, value, kind, seed, _, _ in each:
        if seed:
            seeds[value] = min(kind, seeds.get(value, 9))
    while True:
        votes = {}
        for (pattern, value), (_, _, counts) in edges.items():
            if counts:
                votes.setdefault(pattern, []).append(known.get(value))
        says = {}
        for pattern, x in votes.items():
            most = max(range(4), key=lambda k: (x.count(k), -k))
            if x.count(most) >= 4 and x.count(most) / len(x) >= 0.9:
                says[pattern] = (most, x.count(most) / len(x))
        cues = {}
        for (pattern, value), (_, cue, _) in edges.items():
            if pattern in says:
                kind, sure = says[pattern]
                cues[value, kind, cue] = max(sure, cues.get((value, kind, cue), 0))
        doubt = {}
        for (value, kind, _), sure in cues.items():
            doubt[value, kind] = doubt.get((value, kind), 0) + math.log(1 - min(sure, 0.999))
        best = {v: (-1e9, k) for v, k in seeds.items()}
        for (value, kind), d in doubt.items():
            if 1 - math.exp(round(d, 9)) >= 0.95 - 1e-9:
                best[value] = min(best.get(value, (9, 9)), (round(d, 9), kind))
        hits = sorted((doc, token, best[value][0], a - b, a, b, best[value][1], value) for doc, a, b, value, kind, _, token, _ in each if kind is None and value in best)
        out = []
        for doc, _, _, _, a, b, kind, value in hits:
            if not any(d == doc and x < b and y > a for d, _, x, y, _ in out):
                out.append((doc, kind, a, b, value))
        grown = known | {v: min(k for _, k, _, _, w in out if w == v) for *_, v in out if v not in known}
        if grown == known:
            return {doc: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(base_of[doc] + [(a, k, b) for d, k, a, b, _ in out if d == doc])) for doc, _ in texts}
        known = grown


def test_pii_equals_plain_discovery(spark):
    rng = random.Random(35)
    cues = ["call", "mail", "host", "pay", "from", "the", "of", "ref"]
    texts = []
    for k in range(260):
        out = []
        for _ in range(rng.randrange(1, 4)):
            n = rng.randrange(10**6)
            plain = [f"+1 (2{n % 90:02d}) 555-{n % 10000:04d}", f"ann{n}@x{n % 7}.example.org", f"10.{n % 256}.3.{n % 251}", f"no{n}", "word"]
            other = [f"2{n % 90:02d} 555 {n % 10000:04d}", f"ann{n} [at] x.org", f"10.{300 + n % 600}.3.4", f"4111 1111 1111 {n % 10000:04d}", f"41111111111{n:06d} 77", f"+1 (2{n % 90:02d}) 555-{n % 10000:04d} 10.0.{n % 9}.1"]
            said = rng.choice(plain if rng.random() < 0.95 else other)
            hint = {"+": "call", "2": "call", "a": "mail", "1": "host", "4": "pay"}.get(said[0], "ref") if rng.random() < 0.98 else rng.choice(cues)
            out.append(f"{hint}{rng.choice([' ', ': ', ', '])}{said}{rng.choice([' ', '. ', ' and '])}{rng.choice(cues)}")
        texts.append((k, " ".join(out)))
    long = "q" * 31
    texts += [(300 + k, f"x{k % 2}{long} +1 (300) 555-{k:04d} x") for k in range(30)] + [(400 + k, f"dial +1 (400) 555-{k:04d}") for k in range(30)] + [(340, f"y{long} 300 555 9999 z"), (341, f"{'q' * 29} 300 555 9998 z"), (342, f"dial{' ' * 8}303 555 0001"), (343, f"dial{' ' * 9}303 555 0002"), (350, None), (351, "")]
    want = plain_discovery(texts)
    got = {r["doc_id"]: r["s"] for r in pii.find(documents(spark, texts, clash=True)).select("doc_id", pii.spans_text("spans").alias("s")).collect()}
    assert got == want
    assert sum(x.count(":") for x in want.values()) > sum(brute_pii(t).count(":") for _, t in texts) + 16
    # Of a cue of over 30 characters the nearest 30 count; a word 9 separators away is none.
    assert (want[340], want[341], bool(want[342]), want[343]) == ("phone:33:45", "", True, "")


def test_pii_bootstrap_goes_on(spark):
    """What a third round reaches, and a token of any length."""
    texts = [f"aa +1 (200) 555-{1000 + k} aa" for k in range(729)]
    for n, at, also, most in ((2020000000, "aa", "bb", 81), (3030000000, "bb", "cc", 9), (4040000000, "cc", "", 1)):
        texts += [f"{cue} {n + k} {cue}" for k in range(most) for cue in (at, also) if cue]
    cards = [f"pay x4111-1111-1111-{k:04d}x{'y' * 70} now" for k in range(400)]
    known = [t for t in cards if brute_pii(t)]
    texts += [*known[:30], next(t for t in cards if not brute_pii(t))]
    found = {r["doc_id"]: r["s"] for r in pii.find(documents(spark, list(enumerate(texts)))).select("doc_id", pii.spans_text("spans").alias("s")).collect()}
    assert found[len(texts) - 32] == "phone:3:13" and found[len(texts) - 1] == "card:4:95"


# 9


def test_vectors(spark):
    rng = np.random.default_rng(14)
    centres = rng.standard_normal((12, 16))
    rows = [(k, (centres[k % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.3])).astype(float).tolist(), k) for k in range(260)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, 1), (303, [None] + [1.0] * 15, 1), (304, rows[0][1], 1), (305, [2 * x for x in rows[0][1]], 1), (306, [1.0, 0.0], 1), (307, [1.0, 0.01], 1), (308, [float("inf")] * 16, 1), (309, [], 1), (310, [1e200] * 16, 1), (311, [1e-200] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")
    ok = {i: np.array(v, float) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: v / np.abs(v).max() for i, v in ok.items()}
    links = {(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b]) and unit[a] @ unit[b] / (np.linalg.norm(unit[a]) * np.linalg.norm(unit[b])) >= 0.95}
    comp = {i: i for i, _, _ in rows}
    for _ in range(40):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    n = {i: sum(i in p for p in links) for i, _, _ in rows}
    got = {tuple(r) for r in vectors.groups(df).collect()}
    assert got == {(i, n[i], comp[i], comp[i] == i) for i in comp} and links
    assert vectors.groups(df.limit(0)).count() == 0


def test_vectors_in_small_tiles(spark, monkeypatch):
    """Many tiles and blocks, repeated vec_ids, and clashing columns."""
    monkeypatch.setattr(vectors, "tile_size", lambda d: 8)
    monkeypatch.setattr(vectors, "SIDE", 5)
    rng = np.random.default_rng(17)
    v = np.repeat(rng.standard_normal((9, 5)), 14, axis=0) + rng.standard_normal((126, 5)) * 0.25
    rows = [(k, v[k].tolist(), "x", 1, "y") for k in range(126)] + [(5, v[80].tolist(), "x", 1, "y"), (5, v[5].tolist(), "x", 1, "y")]
    got = sorted(map(tuple, vectors.groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, home string, key int, v string")).collect()))
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    ids, comp = [r[0] for r in rows], [r[0] for r in rows]
    for _ in range(200):
        comp = [min([comp[a], *(comp[b] for b in np.flatnonzero(link[a]))]) for a in range(len(rows))]
    # Rows of one vec_id are vectors of their own: links are counted by row; as ends of links they are one name.
    assert [(i, n) for i, n, _, _ in got] == sorted((i, int(link[k].sum())) for k, i in enumerate(ids))
    assert sorted((i, c) for i, _, c, _ in got) == sorted(zip(ids, comp, strict=True)) and all(k == (i == c) for i, _, c, k in got)


def test_vector_tiles_cover(monkeypatch):
    monkeypatch.setattr(vectors, "tile_size", lambda d: 8)
    rng = np.random.default_rng(15)
    v = rng.standard_normal((200, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tree = vectors.Tree(v, 200, 0.4)
    p = v @ tree.axes
    touched, home = {k: set() for k in range(200)}, {}
    for leaf, rows, inside in tree.leaves(p):
        for r, i in zip(rows, inside, strict=True):
            touched[r].add(leaf)
            if i:
                home[r] = leaf
    assert len(home) == 200 and tree.n_leaves > 4
    for a, b in itertools.combinations(range(200), 2):
        if np.linalg.norm(v[a] - v[b]) <= 0.4:
            assert home[b] in touched[a] and home[a] in touched[b]


# 10


def test_mixing(spark):
    rng = random.Random(16)
    texts = [(k, words(rng, rng.randrange(80))) for k in range(700)] + [(900, None), (901, ""), (3, "again here")]
    source = [rng.choice(["a", "b", "c", "c", "c", "c", None, "ü"]) for _ in texts]
    df = documents(spark, texts, source, clash=True)
    got = mixing.mix(df, shards=8).collect()
    assert len(got) == len(texts) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df, shards=8).collect()))
    sizes = {}
    for (_, t), s in zip(texts, source, strict=True):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = mixing.targets(sizes)
    assert abs(sum(goal.values()) - 1.5 * sum(sizes.values())) < 1e-6 and all(goal[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == goal[r["source"]]
        assert (r["taken"] > 0) <= (len(r["shards"]) > 0) and all(0 <= x < 8 for x in r["shards"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    drawn = mixing.draw(df, shards=8)
    assert drawn.columns == [*df.columns, "_shard", "_place"] and drawn.count() == sum(len(r["shards"]) for r in got)
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mixing_draws(spark, monkeypatch):
    """Runs are disjoint and whole: each block is drawn by as many shards as its documents say, shards come apart and shuffled; few blocks give the same amounts."""
    rng = random.Random(18)
    texts = [(k, words(rng, 5 + rng.randrange(40))) for k in range(900)]
    source = ["a" if k % 3 else "b" for k in range(900)]
    df = documents(spark, texts, source)
    plain = mixing.mix(df, shards=6).collect()
    monkeypatch.setattr(mixing, "TASK_WORDS", 1500)
    rows = [(p, r["doc_id"], r["_shard"] if "_shard" in r else r["shard"], r["place"]) for p, r in mixing.draw(df, shards=6).rdd.mapPartitionsWithIndex(lambda k, x: ((k, r.asDict()) for r in x)).collect()]
    assert len(rows) == sum(len(r["shards"]) for r in plain)
    assert sorted((i, s) for _, i, s, _ in rows) == sorted((r["doc_id"], s) for r in plain for s in r["shards"])
    by_task = {}
    for p, _, s, place in rows:
        by_task.setdefault(p, []).append((s, place))
    assert all(len({s for s, _ in x}) == 1 and [y for _, y in x] == sorted(y for _, y in x) for x in by_task.values()) and len(by_task) > 6
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 2)
    few = mixing.mix(df, shards=6).collect()
    taken = lambda rows, s: sum(r["taken"] for r in rows if r["source"] == s)
    assert all(taken(few, s) == taken(plain, s) for s in "ab") and all(r["taken"] <= 2 * r["size"] for r in few)


def test_splitting_tree():
    quotas = np.array([100, 7, 0, 333])
    out = mixing.split_quotas(quotas, 13, 5)
    assert (out.sum(axis=0) == quotas).all() and (out >= 0).all() and (out == mixing.split_quotas(quotas, 13, 5)).all()
    assert np.ptp(out.sum(axis=1)) <= 2


def test_targets_by_hand():
    assert mixing.targets({"b": 100, "a": 100, None: 100}) == {"a": 200.0, "b": 250.0 / 3, None: 500.0 / 3}
    assert mixing.targets({"a": 0, "b": 10}) == {"a": 0.0, "b": 15.0}
