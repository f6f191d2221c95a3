"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest bits of a row's draw that stand for one: the draw is uniform on [0, 1).
_DRAW_BITS = 40


def class_counts(rows: DataFrame, label: str) -> dict:
    """Rows per label value (one small row per class; partially aggregated)."""
    return {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def bounded_sample(rows: DataFrame, label: str, keys: list[str], counts: dict, bounds: dict) -> DataFrame:
    """Each class thinned to about its bound by a hash of ``keys`` (all rows if there are fewer).

    The draw depends on the keys alone, so the sample is the same wherever and however often it is
    computed.  Rows with the same label and keys are one row of the sample, so its expected size is at most
    the sum of the bounds however often a row is repeated; give keys that tell different rows apart (an id
    alone does not where ids are null or repeated).
    """
    draw = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(77)), 64 - _DRAW_BITS) / F.lit(float(1 << _DRAW_BITS))
    keep = F.lit(False)
    for value, n in counts.items():
        if value is not None and n:
            keep = keep | ((F.col(label) == F.lit(value)) & (draw < F.lit(min(1.0, bounds.get(value, 0) / n))))
    return rows.filter(keep).dropDuplicates([label, *keys])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bounds: dict) -> tuple[DataFrame, dict]:
    """(text, label) rows of a bounded sample of the labelled documents, and the labelled rows per class.

    docs: (doc_id, text); labels: (doc_id, label).  The sample is drawn on (doc_id, hash of the text), so it is
    bounded, and small enough to be broadcast to the texts, whatever ids are repeated.
    """
    named = docs.withColumn("_hash", F.xxhash64("text"))
    rows = named.select("doc_id", "_hash").join(labels.filter("doc_id is not null").distinct(), "doc_id")
    counts = class_counts(rows.select(label), label)
    sample = bounded_sample(rows, label, ["doc_id", "_hash"], counts, bounds)
    return named.join(F.broadcast(sample), ["doc_id", "_hash"]).dropDuplicates([label, "doc_id", "_hash"]).select("text", label), counts
