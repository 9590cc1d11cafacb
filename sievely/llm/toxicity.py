"""Toxicity by a convolutional text classifier, trained here in numpy.

A word's embedding is the mean of the hashed embeddings of the word and of its first 3 to 6 bytes (ASCII case folded).
Filters of widths 1 to 3 run over the words, the largest response of each is kept (max pooling over the whole text),
and a logistic layer weighs them. One coordinate of the embeddings starts as the log odds of its feature in the
training rows, the rest at random; all are trained by gradient descent. The classifier sees text alone: the
language that a threshold belongs to is told from the text's common words. Per language, the threshold is set on
labelled rows kept from training, and scores are shifted so that it lies at 0.5.

Training is bounded, whatever the table's size: of the labelled rows that are not held out, in the order of a hash, at most
TRAIN_ROWS of each label with TRAIN_BYTES of text are taken, whole texts only; a document's copies under one doc_id and label count once.

Cases: null and empty texts, and texts without words, have the score of the bias alone; a document without a label
is scored as well; contradictory labels of one document are all used; with no labels of both kinds every score is the
share of label 1. An empty table of documents gives no scores, and one without labelled rows such a constant model. Equal rows
have equal scores. Columns other than doc_id and text (and doc_id, toxic of the labels) are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM, Hasher, as_bytes, slices, small_batches, word_bounds

#: Labelled rows of each label that training reads at most, chosen by a hash of doc_id and text, and the bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 2500, 48_000_000
#: Rows whose crc32(doc_id) mod 10 is this are kept from training to set thresholds (they are not held out) ...
CALIBRATE = 1
#: ... if there are so many rows to train on; with fewer the rows trained on set the thresholds. A language has a threshold of
#: its own if so many calibration rows of each label are in it, else that of all languages.
CALIBRATE_FROM, LANGUAGE_FROM = 100, 10
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 6
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.08, 1e-4
PREFIXES = (3, 4, 5, 6)

#: Common words that tell a text's language.
LANGUAGES = {
    "en": "the and of to is in that it for was with are this on by from",
    "fr": "le les des du et un une que qui dans pour est la de en au",
    "de": "der die das und ist den von zu mit sich auf ein eine nicht im als",
    "es": "el los las y que en un una por con se del para no es lo",
}
LANGUAGE_NAMES = [*LANGUAGES, "other"]


@dataclass
class Words:
    """The words of several texts: feature ids [words, features], the texts' bounds, and their languages."""

    features: np.ndarray
    at: np.ndarray
    language: np.ndarray


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    found = []
    for k, words in enumerate(LANGUAGES.values()):
        data = np.frombuffer(words.encode(), np.uint8)
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]), ALNUM)
        found += [(int(h), k) for h in Hasher(data)(starts, ends)]
    hashes = np.array(sorted({h for h, _ in found}), np.uint64)
    member = np.zeros((len(hashes), len(LANGUAGES)), np.float32)
    for h, k in found:
        member[np.searchsorted(hashes, np.uint64(h)), k] = 1
    return hashes, member


def read_words(texts: pa.Array) -> Words:
    data, offsets = as_bytes(texts)
    starts, ends, row = word_bounds(data, offsets, ALNUM)
    n = len(offsets) - 1
    at = np.searchsorted(row, np.arange(n + 1))
    if not len(starts):
        return Words(np.zeros((0, 1 + len(PREFIXES)), np.int32), at, np.full(n, len(LANGUAGES)))
    hasher = Hasher(data)
    word = hasher(starts, ends)
    features = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    features[:, 0] = (word >> np.uint64(40)) % np.uint64(BUCKETS)
    for k, size in enumerate(PREFIXES):
        part = hasher(starts, np.minimum(starts + size, ends)) + np.uint64(k + 1) * np.uint64(ends > starts + size).astype(np.uint64)
        features[:, k + 1] = ((part * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(BUCKETS)
    hashes, member = _language_table()
    found = np.minimum(np.searchsorted(hashes, word), len(hashes) - 1)
    hit = np.flatnonzero(hashes[found] == word)
    votes = np.zeros((n, len(LANGUAGES)))
    np.add.at(votes, row[hit], member[found[hit]])
    return Words(features, at, np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(LANGUAGES)))


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # of width w: [w, DIM, FILTERS]
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGE_NAMES)))

    def pooled(self, features: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text the filters' largest responses (0 at least) and the words where they begin (-1: none)."""
        n, total = len(at) - 1, len(WIDTHS) * FILTERS
        out, where = np.zeros((n, total), np.float32), np.full((n, total), -1)
        if not len(features):
            return out, where
        x = self.embedding[features[:, 0]]
        for k in range(1, features.shape[1]):
            x = x + self.embedding[features[:, k]]
        x *= np.float32(1 / features.shape[1])
        row = np.repeat(np.arange(n), np.diff(at))
        for k, (width, filters, offset) in enumerate(zip(WIDTHS, self.filters, self.offsets, strict=True)):
            z = x @ filters[0] + offset
            for j in range(1, width):
                inside = np.zeros(len(x), bool)
                inside[:-j] = row[:-j] == row[j:]
                step = np.zeros_like(z)
                step[:-j] = x[j:] @ filters[j]
                z += np.where(inside[:, None], step, 0)
            full = np.flatnonzero(np.diff(at))
            best = np.maximum.reduceat(z, at[full], axis=0)
            c = slice(k * FILTERS, (k + 1) * FILTERS)
            out[full, c] = np.maximum(best, 0)
            if self.learning:
                spot = np.full((n, FILTERS), -1)
                hit_word, hit_filter = np.nonzero(z == np.repeat(best, np.diff(at)[full], axis=0))
                spot[row[hit_word], hit_filter] = hit_word
                where[:, c] = np.where(out[:, c] > 0, spot, -1)
        return out, where

    learning = False

    def raw(self, features: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.pooled(features, at)[0] @ self.weights + self.bias

    def score(self, words: Words) -> np.ndarray:
        z = self.raw(words.features, words.at) - self.shift[words.language]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _gather(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [words.features[words.at[k] : words.at[k + 1]] for k in chosen]
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def gradients(model: Model, features: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Of the weighted mean log loss of texts: gradients of filters, offsets and weights, of the bias, and of the embeddings of some features."""
    dense = [*model.filters, *model.offsets, model.weights]
    pooled, where = model.pooled(features, at)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.bias, -30, 30)))
    g = ((p - y) * weight / len(y)).astype(np.float32)
    grads = [np.zeros_like(f) for f in dense]
    grads[-1][:] = pooled.T @ g + DECAY * model.weights
    text, unit = np.nonzero(where >= 0)
    up = g[text] * model.weights[unit]
    rows, values = [np.zeros(0, np.int32)], [np.zeros((0, DIM), np.float32)]
    ends = at[text + 1]
    for k, width in enumerate(WIDTHS):
        mine = unit // FILTERS == k
        f, d, first, last = unit[mine] % FILTERS, up[mine], where[text[mine], unit[mine]], ends[mine]
        np.add.at(grads[len(WIDTHS) + k], f, d)
        for j in range(width):
            ok = first + j < last
            ids = features[first[ok] + j]
            x = model.embedding[ids].mean(axis=1)
            np.add.at(grads[k][j].T, f[ok], x * d[ok][:, None])
            back = model.filters[k][j][:, f[ok]].T * d[ok][:, None] / ids.shape[1]
            rows.append(ids.ravel())
            values.append(np.repeat(back, ids.shape[1], axis=0))
    ids, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    change = np.zeros((len(ids), DIM), np.float32)
    np.add.at(change, inverse, np.concatenate(values))
    return grads, float(g.sum()), ids, change


def train(words: Words, labels: np.ndarray, calibration: np.ndarray, seed: int = 5) -> Model:
    """calibration: the rows that set thresholds instead of being trained on."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    learn = np.flatnonzero(~calibration)
    y = labels.astype(np.float32)
    rate1 = float(np.clip(y[learn].mean() if len(learn) else 0.5, 0.01, 0.99))
    model = Model((rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32), [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], (rng.random(len(WIDTHS) * FILTERS) * 0.5).astype(np.float32), float(np.log(rate1 / (1 - rate1))))
    if not len(learn) or y[learn].min() == y[learn].max():
        model.weights[:] = 0
        return model
    # The first coordinate: log odds that a text with the feature has label 1, over texts.
    seen = np.zeros((2, BUCKETS))
    for k in learn:
        seen[int(y[k]), np.unique(words.features[words.at[k] : words.at[k + 1]])] += 1
    n1, n0 = y[learn].sum(), (1 - y[learn]).sum()
    model.embedding[:, 0] = np.log((seen[1] + 0.3) / (n1 + 0.6)) - np.log((seen[0] + 0.3) / (n0 + 0.6))
    model.embedding[:, 0] = np.clip(model.embedding[:, 0] - 1.0, -1, 4)
    model.filters[0][0, 0, :] = 1.0
    model.learning = True
    dense = [*model.filters, *model.offsets, model.weights]
    power = [np.full(p.shape, 0.1, np.float32) for p in dense]
    e_power, b_power = np.full(BUCKETS, 0.1, np.float32), 0.1
    for _ in range(EPOCHS):
        order = rng.permutation(learn)
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            features, at = _gather(words, chosen)
            weight = np.where(y[chosen] > 0, 0.5 / rate1, 0.5 / (1 - rate1))
            grads, g, ids, change = gradients(model, features, at, y[chosen], weight)
            for value, gradient, total in zip(dense, grads, power, strict=True):
                total += gradient * gradient
                value -= RATE * gradient / np.sqrt(total)
            b_power += g**2
            model.bias -= RATE * g / b_power**0.5
            if len(ids):
                e_power[ids] += (change * change).mean(axis=1)
                model.embedding[ids] -= RATE * change / np.sqrt(e_power[ids])[:, None]
    model.learning = False
    _calibrate(model, words, y, np.flatnonzero(calibration) if calibration.any() else np.arange(n))
    return model


def _calibrate(model: Model, words: Words, y: np.ndarray, rows: np.ndarray) -> None:
    """Per language the threshold with the best balanced accuracy on these rows; few rows lean on all languages' one."""
    features, at = _gather(words, rows)
    z, y, language = model.raw(features, at), y[rows], words.language[rows]

    def best(z: np.ndarray, y: np.ndarray) -> float | None:
        if not len(z) or y.min() == y.max():
            return None
        order = np.argsort(z)
        z, y = z[order], y[order]
        # Threshold behind each prefix: what lies at or under it is called 0.
        right = np.cumsum(1 - y)[:-1] / (1 - y).sum() + (y.sum() - np.cumsum(y)[:-1]) / y.sum()
        right = np.where(z[:-1] < z[1:], right, -1)
        top = np.flatnonzero(right >= right.max() - 1e-9)
        k = top[np.argmax(z[top + 1] - z[top])]
        # Zero is where training put the border; what the gap adds is within its middle half.
        quarter = (z[k + 1] - z[k]) / 4
        return float(np.clip(0.0, z[k] + quarter, z[k + 1] - quarter))

    common = best(z, y)
    if common is None:
        common = 0.0
    for k in range(len(LANGUAGE_NAMES)):
        mine = language == k
        found = best(z[mine], y[mine]) if min((y[mine] > 0).sum(), (y[mine] == 0).sum()) >= LANGUAGE_FROM else None
        model.shift[k] = common if found is None else found


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Trains on at most train_rows labelled documents of each label, with train_bytes of text, chosen by a hash."""
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).where(~is_held_out()).distinct()
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Texts are measured before the join, so that none of them is shuffled.
    rows = texts.select("doc_id", F.octet_length("text").alias("bytes"), F.xxhash64("doc_id", "text").alias("h")).join(known, "doc_id").distinct()
    picked = []
    for label in (0, 1):
        left = train_bytes
        for r in rows.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(train_rows).collect():
            if r["bytes"] <= left:
                left -= r["bytes"]
                picked.append((r["doc_id"], label, r["h"]))
    if not picked:
        return train(Words(np.zeros((0, 1 + len(PREFIXES)), np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int32), np.zeros(0, bool))
    wanted = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int, h long")
    chosen = texts.join(F.broadcast(wanted), "doc_id").where(F.xxhash64("doc_id", "text") == F.col("h")).select("doc_id", "toxic", "text").distinct()
    rows = chosen.orderBy("doc_id", "toxic", "text").toArrow()
    read = [read_words(chunk) for chunk in rows.column("text").chunks if len(chunk)]
    if not read:
        return train(Words(np.zeros((0, 1 + len(PREFIXES)), np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int32), np.zeros(0, bool))
    sizes = np.concatenate([np.diff(w.at) for w in read])
    words = Words(np.concatenate([w.features for w in read]), np.concatenate(([0], np.cumsum(sizes))), np.concatenate([w.language for w in read]))
    tenth = np.array([zlib.crc32(str(x).encode()) % 10 == CALIBRATE for x in rows.column("doc_id").to_pylist()])
    y = np.asarray(rows.column("toxic"))
    tenth &= len(y) >= CALIBRATE_FROM
    return train(words, y, tenth)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(held.value.score(read_words(batch.column("text"))), pa.float64())})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose texts score under 0.5, all columns; each row is judged on its own text."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    name = docs.columns[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, name):
            keep = held.value.score(read_words(batch.column(at))) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
