"""Quality classification by hierarchical empirical Bayes: document evidence and site posteriors.

Document evidence is a logistic model over shape features of the whole text (shares of letter cases,
digits, marks and symbols; word length, repeated words and lines, symbols at word ends), each cut into
quantile bins, fitted in numpy on a bounded sample of labelled rows.  Its log odds, less the sample's
prior, are the weight of the text itself.

Sites are two levels: hosts and paths of a host.  One grouped aggregation of the evidence of *all*
documents gives each path and host its expected number of good documents.  Hosts are shrunk toward the
global rate and paths toward their host by beta priors whose strengths are estimated from the spread
between sites (moments), so a sparse site says little and a site like the others says nothing.  A
document's own evidence is taken out of its site's counts before they become its prior.

``posterior`` = evidence + log odds of the path's shrunken rate; a document is kept when the posterior
probability of label 1 is at least ``KEEP``.

Defined cases: null text is the empty text; null host or path is a site of its own; labels other than 0
and 1 are ignored; without both labels among the learned rows the evidence is 0 everywhere and the
rate 0.5 (every document is kept); rows are scored one by one, so repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.columns import pick
from ledgerloom.llm.sampling import labelled_sample
from ledgerloom.llm.textops import TextBatch, batches
from ledgerloom.session import cut_lineage, ship_package

#: Documented bounds of the training sample.
SAMPLE_GOOD = 8000
SAMPLE_BAD = 4000
BINS = 16
RIDGE = 2.0
STEPS = 30
KEEP = 0.35
RESULT = ("_evidence", "_host_rate", "_path_rate", "_quality", "_kept")
#: Limits of a beta prior's strength (documents).
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e6

_KIND = np.full(256, 6, np.int64)  # other symbols
for _codes, _kind in ((range(ord("a"), ord("z") + 1), 0), (range(ord("A"), ord("Z") + 1), 1), (range(ord("0"), ord("9") + 1), 2),
                      (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".,;:'\"-()?", 5), (b"!", 7), (b"|", 8), (range(128, 256), 0)):
    _KIND[list(_codes)] = _kind
_KINDS = 9
FEATURES = ("upper", "digit", "newline", "mark", "symbol", "shout", "bar", "word_length", "repeated_words", "odd_ends", "sentence_length",
            "repeated_lines", "repeated_pairs", "length")


def _distinct_share(batch_rows: int, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(batch_rows), np.diff(first))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=batch_rows) / np.maximum(np.diff(first), 1)


def features(batch: TextBatch) -> np.ndarray:
    """(documents, features); ``batch`` must not be lower-cased."""
    rows = batch.rows
    doc = np.repeat(np.arange(rows), np.diff(batch.offsets))
    kinds = np.bincount(doc * _KINDS + _KIND[batch.data], minlength=rows * _KINDS).reshape(rows, _KINDS).astype(float)
    starts, ends, first = batch.words()
    words = np.diff(first)
    some = np.maximum(words, 1)
    size = np.maximum(kinds.sum(axis=1), 1)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    hashes = batch.span_hashes(starts, ends)
    word_doc = np.repeat(np.arange(rows), words)
    odd = np.isin(_KIND[batch.data[ends - 1]], (6, 7, 8)) if len(ends) else np.zeros(0, bool)
    pair_first = np.concatenate([[0], np.cumsum(np.maximum(words - 1, 0))])
    at = np.arange(pair_first[-1]) - np.repeat(pair_first[:-1], np.diff(pair_first)) + np.repeat(first[:-1], np.diff(pair_first))
    with np.errstate(over="ignore"):
        pairs = hashes[at] * np.uint64(0x9E3779B97F4A7C15) + hashes[at + 1] if len(at) else hashes[:0]
    # Lines: byte runs between line feeds.
    stop = np.flatnonzero(batch.data == 10)
    bounds = np.unique(np.concatenate([batch.offsets, stop, stop + 1]))
    low, high = bounds[:-1], bounds[1:]
    line = ~((high - low == 1) & (batch.data[np.minimum(low, max(len(batch.data) - 1, 0))] == 10)) if len(low) else np.zeros(0, bool)
    low, high = low[line], high[line]
    line_first = np.searchsorted(low, batch.offsets)
    return np.stack([
        kinds[:, 1] / letters, kinds[:, 2] / size, kinds[:, 4] / size, kinds[:, 5] / some, kinds[:, 6] / size, kinds[:, 7] / some, kinds[:, 8] / some,
        np.bincount(word_doc, ends - starts, rows) / some,
        1 - _distinct_share(rows, hashes, first), np.bincount(word_doc, odd, rows) / some, words / np.maximum(kinds[:, 5], 1),
        1 - _distinct_share(rows, batch.span_hashes(low, high), line_first), 1 - _distinct_share(rows, pairs, pair_first), np.log1p(words)], axis=1)


@dataclass
class Model:
    cuts: np.ndarray  # (features, BINS - 1)
    weights: np.ndarray  # (features, BINS), centred
    base: float  # log odds of the sample's labels
    rate: float  # share of label 1 among all learnable rows


def evidence(model: Model, x: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of label 1 from the text alone."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += model.weights[j][np.searchsorted(model.cuts[j], x[:, j], "right")]
    return out


def fit(x: np.ndarray, labels: np.ndarray, counts: dict[int, int]) -> Model:
    k = len(FEATURES)
    n = {v: int((labels == v).sum()) for v in (0, 1)}
    if not n[0] or not n[1]:
        return Model(np.zeros((k, BINS - 1)), np.zeros((k, BINS)), 0.0, 0.5)
    cuts = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T.copy()
    bins = np.stack([np.searchsorted(cuts[j], x[:, j], "right") + j * BINS for j in range(k)], axis=1)
    design = np.zeros((len(x), k * BINS))
    design[np.arange(len(x))[:, None], bins] = 1.0
    design = np.hstack([design, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    pull = np.full(design.shape[1], RIDGE)
    pull[-1] = 1e-6
    for _ in range(STEPS):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - labels) + pull * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    # The intercept less the sample's prior stays with the evidence, spread over the features.
    base = float(np.log(n[1] / n[0]))
    weights = w[:-1].reshape(k, BINS) + (w[-1] - base) / k
    return Model(cuts, weights, base, counts[1] / (counts[0] + counts[1]))


def train(docs: DataFrame, labels: DataFrame, sample_good: int = SAMPLE_GOOD, sample_bad: int = SAMPLE_BAD) -> Model:
    """Fit on a bounded sample of documents (doc_id, text) with labels (doc_id, quality)."""
    ship_package(docs.sparkSession)
    docs = pick(docs, {"doc_id": "long", "text": "string"})
    labels = pick(labels, {"doc_id": "long", "quality": "int"}).filter("quality in (0, 1)")
    sample, counts = labelled_sample(docs, labels, "quality", {1: sample_good, 0: sample_bad})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, stop, batch in batches(part.column(0), lower=False):
                x = features(batch)
                yield pa.RecordBatch.from_arrays([part.column(1).slice(start, stop - start), pa.array([r.tobytes() for r in x], pa.binary())], names=["quality", "x"])

    found = sample.mapInArrow(run, "quality int, x binary").toArrow()
    found = sorted(zip(*(found[c].to_pylist() for c in ("quality", "x"))))
    x = np.array([np.frombuffer(row) for _, row in found]).reshape(-1, len(FEATURES))
    return fit(x, np.array([y for y, _ in found], np.int64), counts)


def with_evidence(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The carried columns and ``_evidence`` of every whole text."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    names = carry

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in parts:
            for start, stop, batch in batches(part.column(len(names)), lower=False):
                value = evidence(model, features(batch))
                yield pa.RecordBatch.from_arrays([part.column(i).slice(start, stop - start) for i in range(len(names))] + [pa.array(value)], names=[*names, "_evidence"])

    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + ["_evidence double"])
    return docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").cast("string").alias("_text_in")).mapInArrow(run, schema)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, n: str, good: str, rate: str) -> Column:
    """Strength of the beta prior that fits the spread of ``groups``' rates about ``rate`` (one value)."""
    v = F.sum(F.col(n) * F.col(rate) * (1 - F.col(rate))) / F.sum(n)
    spread = F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - F.col(rate), 2))
    free = F.greatest(F.count(F.lit(1)) - 1, F.lit(1))
    extra = (spread - v * free) / F.greatest(v * (F.sum(n) - F.sum(F.col(n) * F.col(n)) / F.sum(n) - free), F.lit(1e-9))
    strength = F.when(extra <= 1 / MOST_STRENGTH, F.lit(MOST_STRENGTH)).otherwise(1 / F.least(extra, F.lit(1.0)) - 1)
    return F.greatest(F.least(strength, F.lit(MOST_STRENGTH)), F.lit(LEAST_STRENGTH))


def site_counts(scored: DataFrame, model: Model) -> DataFrame:
    """(_host, _path, host_n, host_good, path_n, path_good, host_strength, path_strength), one row per path.

    ``scored``: _host, _path and ``_p``, the documents' probabilities at the global rate.
    """
    # one row per path, kept in the shared folder: the strengths below read it again, not the texts
    paths = cut_lineage(scored.groupBy("_host", "_path").agg(F.count(F.lit(1)).cast("double").alias("path_n"), F.sum("_p").alias("path_good")))
    hosts = paths.groupBy("_host").agg(F.sum("path_n").alias("host_n"), F.sum("path_good").alias("host_good"))
    hosts = hosts.withColumn("rate", F.lit(model.rate))
    host_strength = hosts.agg(_strength(hosts, "host_n", "host_good", "rate")).scalar()
    hosts = hosts.withColumn("host_strength", F.coalesce(host_strength, F.lit(MOST_STRENGTH)))
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + F.col("host_strength") * F.col("rate")) / (F.col("host_n") + F.col("host_strength")))
    both = paths.join(hosts, "_host")
    path_strength = both.agg(_strength(both, "path_n", "path_good", "host_rate")).scalar()
    return both.withColumn("path_strength", F.coalesce(path_strength, F.lit(MOST_STRENGTH))).select(
        "_host", "_path", "host_n", "host_good", "path_n", "path_good", "host_strength", "path_strength")


def classify(docs: DataFrame, model: Model, host: Column, path: Column, keep: float = KEEP, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all; those named like a result give way to it) and _evidence, _host_rate, _path_rate, _quality (posterior), _kept.

    The texts are read twice and not shuffled by this function: the second pass meets one row per path.
    """
    carry = list(docs.columns if carry is None else carry)
    # carried columns travel under numbers, so that no name of theirs can meet one used here
    numbered = [f"_c{i}" for i in range(len(carry))]
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, numbered)], F.col("text"), host.alias("_host"), path.alias("_path"))
    marked = lambda c: F.concat(F.when(c.isNull(), "n").otherwise("s"), F.coalesce(c.cast("string"), F.lit("")))
    prior = F.lit(float(np.log(model.rate / (1 - model.rate))))
    logistic = lambda z: 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    sited = docs.withColumn("_host", marked(F.col("_host"))).withColumn("_path", marked(F.col("_path")))
    probability = logistic(F.col("_evidence") + prior)
    sites = site_counts(with_evidence(sited, model, ["_host", "_path"]).withColumn("_p", probability), model)
    scored = with_evidence(sited, model, [*numbered, "_host", "_path"]).withColumn("_p", probability)
    sites = sites.withColumnsRenamed({"_host": "_site_host", "_path": "_site_path"})
    rows = scored.join(sites, (F.col("_host") == F.col("_site_host")) & (F.col("_path") == F.col("_site_path")))
    host_rate = (F.col("host_good") - F.col("_p") + F.col("host_strength") * model.rate) / (F.col("host_n") - 1 + F.col("host_strength"))
    rows = rows.withColumn("_host_rate", F.greatest(F.least(host_rate, F.lit(1 - 1e-6)), F.lit(1e-6)))
    path_rate = (F.col("path_good") - F.col("_p") + F.col("path_strength") * F.col("_host_rate")) / (F.col("path_n") - 1 + F.col("path_strength"))
    rows = rows.withColumn("_path_rate", F.greatest(F.least(path_rate, F.lit(1 - 1e-6)), F.lit(1e-6)))
    rows = rows.withColumn("_quality", logistic(F.col("_evidence") + _logit(F.col("_path_rate"))))
    return rows.select(*[F.col(n).alias(c) for c, n in zip(carry, numbered) if c not in RESULT], "_evidence", "_host_rate", "_path_rate", "_quality", (F.col("_quality") >= keep).alias("_kept"))
