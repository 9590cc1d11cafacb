"""The pipeline against plain loops over all rows, stage by stage, and its stages on empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from test_operators import CLASH, PLAIN, brute_groups, documents, plain_discovery, words
from tokenizers import Tokenizer

import corpus_pipeline
from sievely.llm import mixing, toxicity

COLUMNS = [x.split()[0] for x in CLASH.split(", ")]


def rows_of(rng):
    """(doc_id, text, source): toxic texts, exact and near copies, personal data, nulls, empty and long texts, repeated rows."""
    rows, labels = [], []
    for k in range(300):
        said = words(rng, 30).split()
        if k % 4 == 0:
            said[rng.randrange(30)] = rng.choice(["vequta", "vequmo", "veqult", "vequrr", "vequille"])
        elif k % 4 == 1:
            said[rng.randrange(30)] = rng.choice([f"ann{k}@x.example.org", f"10.0.{k % 256}.7", f"+1 (555) 010-{1000 + k}", "4111 1111 1111 1111", f"no{k}"])
        rows.append((k, " ".join(said), rng.choice(["a", "b", "c", None])))
        labels.append((k, 1, int(k % 4 == 0)))
    plain = [t for i, t, _ in rows if i % 4 == 3]
    rows += [(400 + k, t, "a") for k, t in enumerate(plain[:6])] + [(410 + k, t + " end", "b") for k, t in enumerate(plain[4:10])]
    rows += [(420, None, "a"), (421, "", "b"), (421, "", "b"), (422, " \n", None), (423, "one two", "c"), (424, "ONE\tTWO", "c"), (None, plain[0], "a"), (None, None, None)]
    rows += [(425, " ".join(f"w{k}" for k in range(4000)), "a"), (426, "z" * 30_000, "c"), (427, "a b c d e f </s>", "c"), (427, "a b c d e f </s>", "c")]
    return rows, labels


def plain_dedup(rows):
    """Rows without an id or without words stay; of the others one of each group, a repeated row being a copy."""
    judged = sorted({(i, t) for i, t, _ in rows if i is not None and (t or "").strip(" \t\n\v\f\r")})
    kept = {i for i, _, _, k in brute_groups(judged, 5, 80) if k}
    out, seen = [], set()
    for i, t, s in rows:
        if i is None or not (t or "").strip(" \t\n\v\f\r"):
            out.append((i, t, s))
        elif i in kept and i not in seen:
            seen.add(i)
            out.append((i, t, s))
    return out


def plain_redact(rows):
    spans = plain_discovery([(k, t) for k, (_, t, _) in enumerate(rows)])
    out = []
    for k, (i, t, s) in enumerate(rows):
        new, at = "", 0
        for kind, a, b in sorted(((x, int(a), int(b)) for x, a, b in (y.split(":") for y in spans[k].split(",") if y)), key=lambda x: (x[1], list(PLAIN).index(x[0]))):
            if a >= at:
                new += t[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        out.append((i, None if t is None else new + t[at:], s))
    return out


def plain_mix(rows):
    """A row for each time that a document is drawn, by the hashes that mixing.py and the SQL of op10 name."""
    number = lambda *x: int(hashlib.md5(":".join(str(y) for y in x if y is not None).encode()).hexdigest()[:15], 16)
    place = lambda i: (number(9, i), i is not None, i or 0)
    sized = [(i, t, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sizes = {s: sum(r[3] for r in sized if r[2] == s) for s in {r[2] for r in sized}}
    out = []
    for s, target in mixing.targets(sizes).items():
        mine, size = [r for r in sized if r[2] == s], sizes[s]
        blocks = math.ceil(len(mine) / max(mixing.BLOCK_DOCS, math.ceil(len(rows) / mixing.MOST_BLOCKS)))
        passes = min(2, int(target // size)) if size else 0
        rest = min(math.floor(target - passes * size + 0.5), size) if passes < 2 else 0
        dealt = {b: [r for r in mine if number(7, r[0]) % blocks == b] for b in range(blocks)}
        before = 0
        for b in sorted((b for b in dealt if dealt[b]), key=lambda b: (number(8, s, b), b)):
            inside, end = before, None
            for r in sorted(dealt[b], key=lambda r: (*place(r[0]), r[3])):
                end = place(r[0]) if r[3] and inside < rest else end
                inside += r[3]
            cut = before < rest < inside
            for r in dealt[b]:
                out += [r[:2]] * (passes + (before < rest and (not cut or place(r[0]) <= end)))
            before = inside
    return out


@pytest.mark.parametrize("block", [256, 5])
def test_run_equals_plain_loops(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", block)
    rows, labels = rows_of(random.Random(41))
    docs = documents(spark, [(i, t) for i, t, _ in rows], [s for _, _, s in rows], clash=True)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    toxic = [model.score(toxicity.read_words(pa.array([t], pa.string())))[0] >= 0.5 for _, t, _ in rows]
    assert sum(x == (k < 300 and k % 4 == 0) for k, x in enumerate(toxic)) > 0.95 * len(rows)
    left = [r for r, x in zip(rows, toxic, strict=True) if not x]
    kept = plain_dedup(left)
    masked = plain_redact(kept)
    assert len(rows) > len(left) > len(kept) and sum(a != b for a, b in zip(kept, masked, strict=True)) > 30
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, tuple(coder.encode(t or "", add_special_tokens=False).ids)) for i, t in plain_mix(masked))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want


def test_stages_keep_columns_on_any_table(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for texts in ([], [(1, None), (1, ""), (None, None), (2, "one two three four five six"), (2, "one two three four five six")]):
            docs = documents(spark, texts, clash=True)
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == (["doc_id", "n_tokens", "ids"] if name == "bpe" else COLUMNS)
            assert len(out.collect()) <= 2 * len(texts)


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "pii", "mixing", "bpe"]
    assert all(a != b for a, b in itertools.combinations([f for _, f in corpus_pipeline.STAGES], 2))
