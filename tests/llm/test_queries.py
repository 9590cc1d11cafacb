"""The registered queries' contract columns against plain versions, on tables as the driver gives them; the classifier's arithmetic against loops."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from test_operators import brute_pii, documents, words
from tokenizers import Tokenizer

from sievely.llm import queries, toxicity


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, [(doc_id, text)], {doc_id: toxic}) with nulls, empties, copies, control strings, personal data and a long text."""
    rng, folder = random.Random(77), str(tmp_path_factory.mktemp("sf"))
    texts = [(k, words(rng, rng.randrange(40)) + rng.choice(["", " é 日本", "\n\n", " x@y.co +1 (555) 010-9999", " 127.0.0.1", " 4111 1111 1111 1111", " <|endoftext|>"])) for k in range(150)]
    texts = [(k, t + " vequille" if k % 4 == 0 else t) for k, t in texts] + [(200, None), (201, ""), (202, texts[3][1]), (203, "z" * 50_000), (204, " ")]
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    toxic = {k: int(k % 4 == 0) for k, _ in texts if k < 150}
    spark.createDataFrame([(k, 1, v) for k, v in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, toxic


def by_id(df):
    rows = [r.asDict() for r in df.collect()]
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r.pop("doc_id"): r for r in rows}


def test_op1_columns(spark, tables):
    folder, texts, _ = tables
    got, order = by_id(queries.op1_spotsigs(spark, folder)), sorted(texts, reverse=True, key=lambda x: x[0])
    assert set(got) == {i for i, _ in texts}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), sha(edited))
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        if edited == t:
            assert got[i]["edited_fingerprint"] == got[i]["fingerprint"] and got[i]["near_edited"] == 1
    assert got[202]["fingerprint"] == got[3]["fingerprint"] and got[200]["fingerprint"] == got[201]["fingerprint"]


def test_op4_columns(spark, tables):
    folder, texts, _ = tables
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = {}
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = {"n_tokens": len(ids), "ids_sha256": sha(",".join(map(str, ids))), "decoded_sha256": sha(library.decode(ids, skip_special_tokens=False))}
    assert by_id(queries.op4_bpe(spark, folder)) == want


def test_op7_columns(spark, tables):
    folder, texts, toxic = tables
    got = by_id(queries.op7_toxicity(spark, folder))
    assert set(got) == {i for i, _ in texts}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [i for i in toxic if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == toxic[i] for i in held) >= 0.9 * len(held)
    assert got[200]["score"] == got[201]["score"] == got[204]["score"]


def test_op8_columns(spark, tables):
    folder, texts, _ = tables
    got = by_id(queries.op8_pii(spark, folder))
    assert set(got) == {i for i, _ in texts}
    for i, t in texts:
        base = brute_pii(t)
        kinds = [x.split(":")[0] for x in base.split(",") if x]
        assert got[i]["base_sha256"] == sha(base) and [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
        assert set(base.split(",")) <= set(got[i]["spans"].split(",")) or not base


def test_op11_to_op13_columns(spark, tables):
    """Names and types that the contracts fix."""
    folder, texts, _ = tables
    spark.createDataFrame([(1, 0, "user", "a.")], "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(k, [float(k % 7), 1.0, -float(k % 3)]) for k in range(45)], "vec_id long, embedding array<float>").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    types = lambda df: dict(df.dtypes)
    assert types(queries.op11_repair(spark, folder)) == {"conv_id": "bigint", **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"), "audit": "string", "repaired_sha256": "string"}
    near = queries.op12_neighbours(spark, folder)
    assert types(near) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    ranks = [(r["query_id"], r["rank"]) for r in near.collect()]
    assert sorted(ranks) == [(q, k) for q in (0, 20, 40) for k in range(1, 21)]
    made = by_id(queries.op13_fim(spark, folder))
    assert set(made) == {i for i, _ in texts} and all(made[i]["restored_sha256"] == sha(t or "") for i, t in texts)


def small_model(rng, buckets=50):
    model = toxicity.Model(rng.standard_normal((buckets, toxicity.DIM)).astype(np.float32), [rng.standard_normal((w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], [rng.standard_normal(toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], rng.standard_normal(len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32), 0.3)
    model.learning = True
    sizes = [0, 1, 2, 5, 9, 1, 0, 4]
    return model, rng.integers(0, buckets, (sum(sizes), 5)).astype(np.int32), np.concatenate(([0], np.cumsum(sizes)))


def plain_raw(model, features, at):
    """Scores before the logistic by loops over texts, places, filters and words."""
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        x = [np.mean([model.embedding[f].astype(np.float64) for f in row], axis=0) for row in features[a:b]]
        total = float(model.bias)
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for start in range(len(x)):
                    z = float(model.offsets[k][f]) + sum(float(x[start + j] @ model.filters[k][j][:, f].astype(np.float64)) for j in range(width) if start + j < len(x))
                    best = max(best, z)
                total += best * float(model.weights[k * toxicity.FILTERS + f])
        out.append(total)
    return np.array(out)


def test_classifier_forward_by_loops():
    model, features, at = small_model(np.random.default_rng(1))
    assert np.allclose(model.raw(features, at), plain_raw(model, features, at), atol=1e-4)


def test_classifier_gradients_by_differences():
    rng = np.random.default_rng(2)
    model, features, at = small_model(rng)
    y, weight = rng.integers(0, 2, len(at) - 1).astype(np.float32), rng.random(len(at) - 1)
    grads, of_bias, ids, of_embedding = toxicity.gradients(model, features, at, y, weight)

    def loss():
        p = 1 / (1 + np.exp(-plain_raw(model, features, at)))
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean() + toxicity.DECAY / 2 * (model.weights.astype(np.float64) ** 2).sum())

    def slope(array, place, step=1e-2):
        old = array[place]
        array[place] = old + step
        up = loss()
        array[place] = old - step
        down = loss()
        array[place] = old
        return (up - down) / (2 * step)

    def close(a, b):
        return abs(a - b) < 2e-3 + 0.05 * abs(b)

    for value, gradient in zip([*model.filters, *model.offsets, model.weights], grads, strict=True):
        places = [tuple(rng.integers(0, n) for n in value.shape) for _ in range(12)]
        assert sum(close(slope(value, p), gradient[p]) for p in places) >= 11  # at a border between two maxima there is no slope
    spots = [(int(rng.integers(0, len(ids))), int(rng.integers(0, toxicity.DIM))) for _ in range(20)]
    assert sum(close(slope(model.embedding, (ids[k], c)), of_embedding[k, c]) for k, c in spots) >= 18
    bias = model.bias
    model.bias = bias + 1e-3
    up = loss()
    model.bias = bias - 1e-3
    assert close((up - loss()) / 2e-3, of_bias)


@pytest.mark.parametrize("rows", [toxicity.CALIBRATE_FROM - 1, toxicity.CALIBRATE_FROM])
def test_rows_that_set_thresholds(spark, monkeypatch, rows):
    """From CALIBRATE_FROM training rows on a tenth sets the thresholds and is not trained on; with fewer all rows do both."""
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda w, y, calibration, **_: seen.update(n=len(y), kept=int(calibration.sum())))
    ids = [k for k in range(10_000) if zlib.crc32(str(k).encode()) % 5][:rows]
    toxicity.fit(documents(spark, [(k, f"text {k}") for k in ids]), spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, toxic int"))
    tenth = sum(zlib.crc32(str(k).encode()) % 10 == toxicity.CALIBRATE for k in ids)
    assert seen == {"n": rows, "kept": tenth if rows >= toxicity.CALIBRATE_FROM else 0} and tenth > 0
    assert toxicity.read_words(pa.array(["", None])).language.tolist() == [len(toxicity.LANGUAGES)] * 2
