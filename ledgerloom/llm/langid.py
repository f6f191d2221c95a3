"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte n-grams (2 to 4 bytes of lower-cased text, every
other ASCII character read as a word break); a linear layer and a softmax give the language.  The
model is fitted with stochastic gradient descent in numpy on a bounded sample of labelled rows.
Because the layer is linear, prediction folds embeddings and layer into one table of logits per
n-gram bucket: the mean of table rows is exactly the logit of the mean embedding.

Scores are calibrated with a temperature on rows kept out of the fit, and a document is rejected
when its score is below a threshold that rejects a stated share of those rows, or when its text
holds no letter.

Defined cases: null or letterless text: language ``und``, score 0, rejected.  Rows whose label is
null are never learned.  Without any learnable row every text is ``und``.  One learned language: it is
predicted with score 1.  Equal texts get equal results; ties go to the alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.columns import pick
from ledgerloom.llm.sampling import bounded_sample, class_counts
from ledgerloom.llm.textops import TextBatch, batches
from ledgerloom.session import ship_package

UNKNOWN = "und"
#: Documented bound of the training sample, over all languages.
SAMPLE_ROWS = 1500
GRAMS = (2, 3, 4)
BUCKET_BITS = 15
DIMENSIONS = 16
EPOCHS = 12
RATE = 0.5
#: Share of calibration rows that the threshold may reject, and its upper limit.
REJECT_SHARE = 0.001
MOST_THRESHOLD = 0.4

_BUCKETS = 1 << BUCKET_BITS
_KEEP = np.zeros(256, bool)
_KEEP[ord("a"):ord("z") + 1] = True
_KEEP[128:] = True
_CLEAN = np.where(_KEEP, np.arange(256), 0x20).astype(np.uint32)


@dataclass
class Model:
    """Logits per n-gram bucket (last row: no n-gram), languages in order, calibration."""

    languages: list[str]
    table: np.ndarray
    temperature: float
    threshold: float


def grams(batch: TextBatch) -> Iterator[np.ndarray]:
    """For each n-gram size the bucket at every byte; ``2 ** BUCKET_BITS`` where there is none."""
    n = len(batch.data)
    clean = _CLEAN[batch.data]
    letter = clean != 0x20
    left = np.repeat(batch.offsets[1:], np.diff(batch.offsets)) - np.arange(n)  # bytes left in the document
    for size in GRAMS:
        code = np.full(n, size, np.uint32)
        some = np.zeros(n, bool)
        for j in range(size):
            code[:n - j] = (code[:n - j] * np.uint32(0x01000193)) ^ clean[j:]
            some[:n - j] |= letter[j:]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
        yield np.where(some & (left >= size), code, np.uint32(_BUCKETS))


def has_letter(column: pa.Array, batch: TextBatch) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = np.concatenate([[0], np.cumsum((batch.data >= ord("a")) & (batch.data <= ord("z")))])
    found = np.diff(ascii_letter[batch.offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(batch.offsets) > 0)):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return found


def bucket_counts(batch: TextBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per document its n-gram buckets and their shares."""
    out = []
    each = list(grams(batch))
    for a, b in zip(batch.offsets[:-1], batch.offsets[1:]):
        c = np.bincount(np.concatenate([g[a:b] for g in each]), minlength=_BUCKETS + 1)[:_BUCKETS]
        at = np.flatnonzero(c)
        out.append((at.astype(np.int32), (c[at] / max(1, c.sum())).astype(np.float32)))
    return out


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 5) -> Model:
    """Stochastic gradient descent over (bucket, share) rows; a fifth is kept for calibration."""
    languages = sorted(set(labels))
    k = len(languages)
    if k < 2:
        return Model(languages, np.zeros((_BUCKETS + 1, k), np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(y))
    held, learn = (order[:len(y) // 5], order[len(y) // 5:]) if len(y) >= 50 else (order, order)
    embed = rng.normal(0, 0.1, (_BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIMENSIONS, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(learn):
            at, share = features[i]
            if not len(at):
                continue
            mean = share @ embed[at]
            p = _softmax(mean @ layer + bias)
            p[y[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p
            # Few n-grams of many move at each step, so embeddings take a longer one.
            embed[at] -= (rate * 50) * share[:, None] * back[None, :]
    table = np.zeros((_BUCKETS + 1, k), np.float32)
    table[:-1] = embed @ layer
    logits = np.array([share @ table[at] + bias for at, share in (features[i] for i in held)])
    table[:-1] += bias  # the mean of rows then holds the bias
    grid = np.geomspace(0.5, 8, 41)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    score = _softmax(logits / temperature).max(axis=1)
    threshold = float(min(MOST_THRESHOLD, np.quantile(score, REJECT_SHARE)))
    return Model(languages, table, temperature, threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def predict(model: Model, column: pa.Array, batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number (-1: und), score and rejection of each text."""
    k = len(model.languages)
    known = has_letter(column, batch)
    if not k:
        return np.full(batch.rows, -1), np.zeros(batch.rows), ~known  # a model that has learned nothing rejects nothing
    sums = np.zeros((batch.rows, k))
    counts = np.zeros(batch.rows)
    full = np.flatnonzero(np.diff(batch.offsets) > 0)
    if len(full):
        begin = batch.offsets[:-1][full]
        for g in grams(batch):
            counts[full] += np.add.reduceat((g < _BUCKETS).astype(np.float64), begin)
            for j in range(k):
                sums[full, j] += np.add.reduceat(model.table[:, j][g].astype(np.float64), begin)
    p = _softmax(sums / np.maximum(counts, 1)[:, None] / model.temperature)
    best = p.argmax(axis=1)
    score = np.where(known, p[np.arange(len(p)), best], 0.0)
    return np.where(known, best, -1), score, ~known | (score < model.threshold)


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most about ``sample_rows`` rows (doc_id, text, lang), equal shares of each language."""
    ship_package(labelled.sparkSession)
    rows = pick(labelled, {"doc_id": "long", "text": "string", "lang": "string"}).filter("lang is not null and text is not null")
    counts = class_counts(rows.select("lang"), "lang")
    if not counts:
        return fit([], [])
    share = max(1, sample_rows // len(counts))
    # A small class leaves its unused share to the others.
    left = sample_rows - sum(min(n, share) for n in counts.values())
    wants = sum(n - share for n in counts.values() if n > share) or 1
    bounds = {lang: min(n, share) + left * max(0, n - share) / wants for lang, n in counts.items()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, stop, batch in batches(part.column(0)):
                each = bucket_counts(batch)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).slice(start, stop - start), pa.array([a.tobytes() for a, _ in each], pa.binary()),
                     pa.array([b.tobytes() for _, b in each], pa.binary())], names=["lang", "at", "share"])

    # The draw is by id and text: null and repeated ids do not stand or fall together.
    found = (bounded_sample(rows.withColumn("hash", F.xxhash64("text")), "lang", ["doc_id", "hash"], counts, bounds).select("text", "lang")
             .mapInArrow(run, "lang string, at binary, share binary").toArrow())
    found = sorted(zip(*(found[c].to_pylist() for c in ("lang", "at", "share"))))
    return fit([(np.frombuffer(at, np.int32), np.frombuffer(share, np.float32)) for _, at, share in found], [lang for lang, _, _ in found])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and lang_pred, score, rejected of every whole text; the input is read once."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    types = dict(docs.dtypes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.languages, UNKNOWN], pa.string())
        for part in parts:
            column = part.column(part.num_columns - 1)
            for start, stop, batch in batches(column):
                lang, score, out = predict(model, column.slice(start, stop - start), batch)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).slice(start, stop - start) for i in range(len(keep))]
                    + [names.take(pa.array(np.where(lang < 0, len(model.languages), lang))), pa.array(score), pa.array(out)],
                    names=[*keep, "lang_pred", "score", "rejected"])

    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["lang_pred string", "score double", "rejected boolean"])
    return (docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text_in"))
            .mapInArrow(run, schema))
