"""Toxicity by multiple-instance learning: noisy-or over sentence scores, trained from document labels.

A document is a bag of sentences (runs between ``.``, ``!``, ``?`` and line feed).  A sentence's score
is a logistic function of its hashed word features (each word and its prefixes of 4 to 8 bytes); the document's probability is the noisy-or ``1 - prod(1 - p)``.  Only document labels
are needed: the gradient hands each sentence its share of the blame, so the fitted model also locates
offending sentences.  The fit runs in numpy on a bounded sample of labelled rows; document scores are
then calibrated by a logistic curve on sample rows kept out of the fit, weighted back to the classes'
true shares, so that 0.5 is the point where both labels are equally likely.

Defined cases: a null or empty text has no sentence, so its raw score is 0 and it gets the calibrated
score of that; labels other than 0 and 1 are ignored; without rows of both labels every score is 0.
Equal texts get equal scores.  A labelled document that appears twice counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.columns import pick
from ledgerloom.llm.sampling import labelled_sample
from ledgerloom.llm.textops import TextBatch, batches
from ledgerloom.session import ship_package

#: Documented bounds of the training sample.
SAMPLE_TOXIC = 1500
SAMPLE_CLEAN = 4500
BUCKET_BITS = 18
PREFIXES = (4, 5, 6, 7, 8)
#: A feature that fewer sample documents show gets no weight (it could only learn them by heart).
LEAST_DOCUMENTS = 3
#: Standard errors by which a feature's log odds must exceed 0.
LEAST_SURPLUS = 2.5
KEEP_SENTENCES = 0.5
EPOCHS = 8
RATE = 0.1
DECAY = 1e-3
START_BIAS = -6.0
START_SHARE = 1.0

_BUCKETS = 1 << BUCKET_BITS
_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?\n")] = True
#: Bytes that may stand in a word; every other ASCII byte is read as a space.
_WORD = np.arange(256, dtype=np.uint8)
_WORD[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    fitted: bool


def sentence_features(batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, first feature of each sentence, first sentence of each document, sentence byte ends).

    Sentences without a word are left out.
    """
    clean = TextBatch(_WORD[batch.data], batch.offsets)
    starts, ends, first = clean.words()
    breaks = np.cumsum(_BREAK[batch.data]) if len(batch.data) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(batch.rows), np.diff(first))
    number = breaks[starts] + doc  # grows at every break and at every new document
    new = np.ones(len(starts), bool)
    new[1:] = (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    total = int(sentence[-1]) + 1 if len(sentence) else 0
    parts = [(clean.span_hashes(starts, ends), np.arange(len(starts)))]
    length = ends - starts
    for size in PREFIXES:
        some = np.flatnonzero(length > size)
        parts.append((clean.span_hashes(starts[some], starts[some] + size), some))
    bucket = np.concatenate([h >> np.uint64(64 - BUCKET_BITS) for h, _ in parts]).astype(np.int64)
    owner = sentence[np.concatenate([w for _, w in parts])]
    order = np.argsort(owner, kind="stable")
    bucket, owner = bucket[order], owner[order]
    last = np.flatnonzero(np.append(new[1:], True)) if len(new) else np.zeros(0, np.int64)
    return (bucket, np.searchsorted(owner, np.arange(total + 1)),
            np.searchsorted(doc[new], np.arange(batch.rows + 1)), ends[last])


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def sentence_scores(model: Model, bucket: np.ndarray, begin: np.ndarray) -> np.ndarray:
    if len(begin) < 2:
        return np.zeros(0)
    return _sigmoid(np.add.reduceat(model.weights[bucket], begin[:-1]) + model.bias)


def noisy_or(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log(1 - probability) of each document, from its sentences."""
    total = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
    return total[first[1:]] - total[first[:-1]]


def calibrated(model: Model, log_clean: np.ndarray) -> np.ndarray:
    if not model.fitted:
        return np.zeros(len(log_clean))
    return _sigmoid(model.slope * _logit(log_clean) + model.shift)


def _logit(log_clean: np.ndarray) -> np.ndarray:
    """Log odds of 1 - exp(log_clean)."""
    return np.log(np.maximum(-np.expm1(log_clean), 1e-9)) - np.maximum(log_clean, -20.0)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], true_counts: dict[int, int], seed: int = 3) -> Model:
    """bags: per document (buckets, first feature of each sentence and the end)."""
    y = np.array(labels)
    model = Model(np.zeros(_BUCKETS), START_BIAS, 1.0, 0.0, False)
    if not len(y) or not (y == 1).any() or not (y == 0).any():
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, learn = (order[:len(y) // 5], order[len(y) // 5:]) if len(y) >= 50 else (order, order)
    if len(set(y[held])) < 2 or len(set(y[learn])) < 2:
        held = learn = order
    shown = np.zeros((2, _BUCKETS))
    for i in learn:
        shown[y[i], np.unique(bags[i][0])] += 1
    usable = shown.sum(axis=0) >= LEAST_DOCUMENTS
    weight = float(np.clip((y[learn] == 0).sum() / (y[learn] == 1).sum(), 1, 10))
    w, seen, bias, bias_seen = model.weights, np.full(_BUCKETS, 1e-3), START_BIAS, 1.0
    # Features that toxic documents show clearly more often, starting from that surplus of log odds.
    odds = np.log((shown[1] + 0.5) / (shown[0] + 0.5)) - np.log(((y[learn] == 1).sum() + 1) / ((y[learn] == 0).sum() + 1))
    surplus = odds - LEAST_SURPLUS * np.sqrt(1 / (shown[1] + 0.5) + 1 / (shown[0] + 0.5))
    usable = usable & (surplus > 0)
    w[:] = np.where(usable, START_SHARE * surplus, 0)
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            bucket, begin = bags[i]
            if len(begin) < 2:
                continue
            if y[i]:  # half of the sentences at a time, lest the plainest one explain all others away
                size = np.diff(begin)
                stay = rng.random(len(size)) < KEEP_SENTENCES
                if not stay.any():
                    continue
                bucket, begin = bucket[np.repeat(stay, size)], np.concatenate([[0], np.cumsum(size[stay])])
            p = _sigmoid(np.add.reduceat(w[bucket], begin[:-1]) + bias)
            if y[i]:
                log_clean = np.log1p(-np.minimum(p, 1 - 1e-12)).sum()
                back = -p * np.exp(log_clean) / max(-np.expm1(log_clean), 1e-9)
            else:
                back = p
            back = np.clip(back, -1, 1) * (weight if y[i] else 1.0)
            at, where = np.unique(bucket, return_inverse=True)
            g = (np.bincount(where, np.repeat(back, np.diff(begin)), len(at)) + DECAY * w[at]) * usable[at]
            seen[at] += g * g
            w[at] -= RATE * g / np.sqrt(seen[at])
            g = back.sum()
            bias_seen += g * g
            bias -= RATE * g / np.sqrt(bias_seen)
    model.bias = float(bias)
    model.fitted = True
    log_clean = np.array([np.log1p(-np.minimum(sentence_scores(model, *bags[i]), 1 - 1e-12)).sum() for i in held])
    x = _logit(log_clean)
    t = y[held]
    share = np.where(t == 1, true_counts.get(1, 1) / max(1, (t == 1).sum()), true_counts.get(0, 1) / max(1, (t == 0).sum()))
    share = share / share.sum()
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a weighted logistic curve, with a weak pull to slope 1
        q = _sigmoid(slope * x + shift)
        r, v = share * (q - t), share * q * (1 - q) + 1e-9
        grad = np.array([(r * x).sum() + 1e-3 * (slope - 1), r.sum()])
        hess = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum()]])
        step = np.linalg.solve(hess, grad)
        slope, shift = slope - np.clip(step[0], -1, 1), shift - np.clip(step[1], -2, 2)
        slope = max(slope, 0.05)
    model.slope, model.shift = float(slope), float(shift)
    return model


def train(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Model:
    """Fit on a bounded sample of documents (doc_id, text) with labels (doc_id, toxic).

    Its expected size is at most the two bounds, whatever ids are repeated.
    """
    ship_package(docs.sparkSession)
    docs = pick(docs, {"doc_id": "long", "text": "string"})
    labels = pick(labels, {"doc_id": "long", "toxic": "int"}).filter("toxic in (0, 1)")
    sample, counts = labelled_sample(docs, labels, "toxic", {1: sample_toxic, 0: sample_clean})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, stop, batch in batches(part.column(0)):
                bucket, begin, first, _ = sentence_features(batch)
                a = [bucket[begin[i]:begin[j]].astype(np.int32).tobytes() for i, j in zip(first[:-1], first[1:])]
                b = [(begin[i:j + 1] - begin[i]).astype(np.int32).tobytes() for i, j in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(1).slice(start, stop - start), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                                                 names=["toxic", "bucket", "begin"])

    found = sample.mapInArrow(run, "toxic int, bucket binary, begin binary").toArrow()
    found = sorted(zip(*(found[c].to_pylist() for c in ("toxic", "bucket", "begin"))))
    return fit([(np.frombuffer(bucket, np.int32), np.frombuffer(begin, np.int32)) for _, bucket, begin in found], [y for y, _, _ in found], counts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_sentences, worst_start, worst_end, worst_score of every whole text.

    worst_*: first to last character (from 0, end excluded) of the sentence with the highest score,
    null where there is none; ties go to the first.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in parts:
            for start, stop, batch in batches(part.column(1)):
                bucket, begin, first, ends = sentence_features(batch)
                p = sentence_scores(model, bucket, begin)
                value = calibrated(model, noisy_or(p, first))
                chars = np.concatenate([[0], np.cumsum((batch.data & 0xC0) != 0x80)])
                low, high, worst = [], [], []
                for d, (i, j) in enumerate(zip(first[:-1], first[1:])):
                    if i == j:
                        low.append(None), high.append(None), worst.append(None)
                        continue
                    s = i + int(p[i:j].argmax())
                    base = chars[batch.offsets[d]]
                    low.append(int(chars[ends[s - 1]] - base) if s > i else 0)
                    high.append(int(chars[ends[s]] - base))
                    worst.append(float(p[s]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(start, stop - start), pa.array(value), pa.array(np.diff(first)),
                     pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(worst, pa.float64())],
                    names=["doc_id", "score", "n_sentences", "worst_start", "worst_end", "worst_score"])

    return (pick(docs, {"doc_id": "long", "text": "string"})
            .mapInArrow(run, "doc_id long, score double, n_sentences long, worst_start long, worst_end long, worst_score double"))
