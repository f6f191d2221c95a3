"""Target-distribution importance resampling over hashed word features.

A text's words are the runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII; its
features are its words and its pairs of consecutive words, repeats counted, each in the bucket given by
the CRC-32 of its UTF-8 bytes.  A bucket's gain compares its share of the target's features with its
share of the corpus's; a document's weight is the mean gain of its features, and documents are drawn
without replacement by weight plus Gumbel noise (``resample``).

Buckets come from a head and a tail of the vocabulary:

* head: the CRC state of each frequent word (the state after the word and a space, from which any pair
  that starts with it goes on) and the finished bucket of each frequent pair.  Both tables have a fixed
  largest size, hold words and pairs in full (no hashes stand for them) and are broadcast;
* tail: a word or pair that is not in the head gets its CRC from its bytes, a pair from its first word's
  state.

The head decides only where a bucket is looked up, never what it is.  A slice of texts is cut into words
at once, its words are made distinct exactly, and each distinct word and pair is resolved once.  Two
passes follow over all texts: bucket totals (one row of counts per task, summed per bucket) and the
documents' sums of gains.

Defined cases: null and empty texts have no feature, weight 0; a null doc_id draws its noise as an empty
id and is behind all others in ties; repeated rows are documents each, with equal scores; long texts are
read whole; an empty corpus gives an empty result, an empty target a gain for every bucket all the same;
extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.columns import pick
from ledgerloom.llm.textops import batches
from ledgerloom.operators.positions import stored, with_position
from ledgerloom.session import ship_package

BUCKETS = 10_000
FRACTION_PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: Largest sizes of the broadcast head, and how many candidates a task may offer for each.
HEAD_WORDS = 1 << 13
HEAD_PAIRS = 1 << 14
OFFERED_WORDS = 1 << 11
OFFERED_PAIRS = 1 << 12
#: Distinct words and pairs whose counts a task holds at once while it looks for candidates.
COUNTED = 1 << 16
#: Bytes of text that are cut into words at once (a longer single text is cut whole; a slice takes some 20 times its
#: bytes in arrays), and the size from which a word's CRC is taken by itself.
SLICE_BYTES = 1 << 20
LONG_WORD = 64

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Head:
    """CRC state after each frequent word and a space, and the bucket of each frequent pair."""
    states: dict[bytes, int]
    pairs: dict[tuple[bytes, bytes], int]


class Words:
    """The words of a slice of texts: distinct words, each word's number, each text's first word."""

    def __init__(self, batch):
        inside = _INSIDE[batch.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[batch.offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        starts = np.flatnonzero(inside & (~before | edge[:-1])) if len(inside) else np.zeros(0, np.int64)
        self.first = np.searchsorted(starts, batch.offsets)
        # The words' bytes laid end to end, as one Arrow column.
        kept = np.concatenate([[0], np.cumsum(inside)])
        cuts = np.append(kept[starts], kept[-1]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(batch.data[inside].tobytes())])
        coded = column.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.column = coded.dictionary
        self.distinct: list[bytes] = self.column.to_pylist()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Code (first word * number of words + second word) and place of each pair within a text."""
        starts_pair = np.ones(len(self.codes), bool)
        starts_pair[self.first[1:][self.first[1:] > 0] - 1] = False
        at = np.flatnonzero(starts_pair)
        return self.codes[at] * len(self.distinct) + self.codes[at + 1] if len(at) else at, at


def _crc_steps() -> np.ndarray:
    """CRC-32 of one more byte: the table of the reflected polynomial 0xEDB88320."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_STEPS = _crc_steps()


def continued(states: np.ndarray, words: np.ndarray, column: pa.Array) -> np.ndarray:
    """The CRCs that ``states`` (unsigned 32 bits) reach over the bytes of the numbered words of ``column``."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)[words]
    order = np.argsort(-size, kind="stable")
    start, size, crc = offsets[words[order]], size[order], states[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-size, -LONG_WORD, "left"))
    for j in range(int(size[long]) if long < len(size) else 0):
        stop = int(np.searchsorted(-size, -j, "left"))  # words of more than j bytes
        now = crc[long:stop]
        crc[long:stop] = _STEPS[(now ^ data[start[long:stop] + j]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out = np.empty(len(crc), np.uint32)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        crc[i] = zlib.crc32(data[start[i]:start[i] + size[i]], int(states[order[i]]))
    out[order] = crc
    return out


def feature_buckets(words: Words, head: Head, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every word, bucket of every pair, place of every pair's first word)."""
    spaced = [head.states.get(w) for w in words.distinct]
    spaced = np.array([zlib.crc32(w + b" ") if s is None else s for w, s in zip(words.distinct, spaced)], np.uint32)
    alone = np.array([zlib.crc32(w) % buckets for w in words.distinct], np.int64)
    codes, at = words.pairs()
    pair_codes, back = np.unique(codes, return_inverse=True)
    n, number = max(len(words.distinct), 1), {w: i for i, w in enumerate(words.distinct)}
    resolved = np.full(len(pair_codes), -1, np.int64)
    # Head: the slice's codes of the frequent pairs whose words it has.
    known = [(number[a] * n + number[b], bucket) for (a, b), bucket in head.pairs.items() if a in number and b in number]
    if known and len(pair_codes):
        code, bucket = np.array(known, np.int64).T
        place = np.minimum(np.searchsorted(pair_codes, code), len(pair_codes) - 1)
        there = pair_codes[place] == code
        resolved[place[there]] = bucket[there]
    tail = np.flatnonzero(resolved < 0)
    if len(tail):
        resolved[tail] = continued(spaced[pair_codes[tail] // n], pair_codes[tail] % n, words.column) % np.uint32(buckets)
    return alone[words.codes] if len(words.codes) else words.codes, resolved[back], at


def _trim(counts: Counter, to: int) -> Counter:
    return Counter(dict(counts.most_common(to)))


def frequent(texts: DataFrame, buckets: int = BUCKETS, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS, counted: int = COUNTED) -> Head:
    """The head: the most frequent words and pairs among those that tasks report as frequent.

    Every text is read.  A task holds a bounded number of counts (rare ones give way), and the driver
    receives at most the head.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Counter(), Counter()
        for part in parts:
            for _, _, batch in batches(part.column(0), limit=SLICE_BYTES):
                w = Words(batch)
                names, n = w.distinct, max(len(w.distinct), 1)
                for i, c in enumerate(np.bincount(w.codes, minlength=len(names)).tolist()):
                    words[names[i]] += c
                codes, counts = np.unique(w.pairs()[0], return_counts=True)
                often = np.argsort(-counts, kind="stable")[:OFFERED_PAIRS * 4]
                for code, c in zip(codes[often].tolist(), counts[often].tolist()):
                    pairs[names[code // n], names[code % n]] += c
                words = _trim(words, counted // 2) if len(words) > counted else words
                pairs = _trim(pairs, counted // 2) if len(pairs) > counted else pairs
        offer = [(a, None, c) for a, c in words.most_common(OFFERED_WORDS)] + [(a, b, c) for (a, b), c in pairs.most_common(OFFERED_PAIRS)]
        for start in range(0, len(offer), 4096):
            a, b, c = zip(*offer[start:start + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.int64())], names=["a", "b", "n"])

    # Bounded by the number of tasks; written, so that texts are read once for both tables.
    offered = stored(texts.mapInArrow(run, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "resample-head")
    top = [offered.filter(kind).orderBy(F.col("n").desc(), "a", "b").limit(limit).select("a", "b").collect()
           for kind, limit in ((F.col("b").isNull(), head_words), (F.col("b").isNotNull(), head_pairs))]
    return Head({bytes(r.a): zlib.crc32(bytes(r.a) + b" ") for r in top[0]},
                {(bytes(r.a), bytes(r.b)): zlib.crc32(bytes(r.a) + b" " + bytes(r.b)) % buckets for r in top[1]})


def bucket_totals(texts: DataFrame, head, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: exact numbers of features over all texts (buckets without a feature are left out)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for part in parts:
            for _, _, batch in batches(part.column(0), limit=SLICE_BYTES):
                alone, paired, _ = feature_buckets(Words(batch), head.value, buckets)
                totals += np.bincount(alone, minlength=buckets) + np.bincount(paired, minlength=buckets)
        full = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(totals[full])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket from both sides' totals (a fixed number of rows)."""
    spark = corpus.sparkSession
    both = (spark.range(buckets).withColumnRenamed("id", "bucket")
            .join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
            .select("bucket", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("s", "t")]))
    rows = sorted(both.collect())
    whole = [float(sum(r[c] for r in rows) + buckets) for c in ("s", "t")]
    table = spark.createDataFrame([(r.bucket, (r.t + 1) * whole[0], (r.s + 1) * whole[1]) for r in rows], "bucket long, up double, down double")
    return [r.gain for r in table.select("bucket", F.floor(1000 * F.log(F.col("up") / F.col("down"))).alias("gain")).orderBy("bucket").collect()]


def weigh(docs: DataFrame, gain: list[int], head, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every (doc_id, text)."""
    values = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, stop, batch in batches(part.column(1), limit=SLICE_BYTES):
                words = Words(batch)
                alone, paired, at = feature_buckets(words, head.value, buckets)
                sums = np.concatenate([[0], np.cumsum(values.value[alone])])[words.first]
                places = np.searchsorted(at, words.first)
                pair_sums = np.concatenate([[0], np.cumsum(values.value[paired])])[places]
                n = np.diff(words.first) + np.diff(places)
                total = np.diff(sums) + np.diff(pair_sums)
                weight = np.where(n > 0, np.floor_divide(total, np.maximum(n, 1)), 0)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(start, stop - start), pa.array(np.diff(words.first)), pa.array(n), pa.array(weight)],
                                                 names=["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = FRACTION_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS, counted: int = COUNTED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) and n_words of every document of (doc_id, text).

    Of the N documents with ``least_words`` or more, floor(percent N / 100) are drawn.  ``target``: (text).
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = pick(docs, {"doc_id": "long", "text": "string"})
    texts, wanted = docs.select("text"), pick(target, {"text": "string"})
    head = spark.sparkContext.broadcast(frequent(texts, buckets, head_words, head_pairs, counted))
    gain = gains(bucket_totals(texts, head, buckets), bucket_totals(wanted, head, buckets), buckets)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296)))
    # Narrow rows, written before they are sorted: a sort reads its input twice.
    scored = stored(weigh(docs, gain, head, buckets), "resample-weights").withColumn("score", F.col("weight") + noise)
    # Short documents are behind all that take part, so one order serves both.
    part = F.col("n_words") >= least_words
    placed = with_position(scored, (~part).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    taking = placed.agg(F.count_if(part)).first()[0]
    rank = F.when(F.col("position") < taking * percent // 100, F.col("position") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"), "n_words")
