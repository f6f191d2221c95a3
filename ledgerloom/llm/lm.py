"""Language-model scores: interpolated modified Kneser-Ney bigrams, counted in Spark.

Tokens are words (maximal runs of bytes outside space and tab..carriage return, ASCII A-Z lower-cased)
and one end token per text; the first token's context is a start mark.  Words are known by 64-bit
hashes.  The corpus is counted in three passes, each pre-aggregated within its tasks into sorted runs
that are dealt by hash and merged:

1. word counts, by range of the word's hash;
2. pair counts, by the context's hash.  A context that makes up a share of all tokens is spread over
   proportionally many shards by the second word; such contexts number at most ``4 * shards``;
3. per word its distinct left contexts and, as a context, its pairs seen once, twice and more often.

Every shard is stored as sorted hash arrays with their counts in the shared folder; scoring tasks map
these files into memory and look up the distinct words and pairs of a slice of documents in order.
A pair's count takes one byte; counts from 255 on are kept in a second, short array.

The model folder must be a file system that all workers mount (``file:`` scheme of
``spark.checkpoint.dir``), since files are memory-mapped; anything else raises ``ValueError``.  Files are
written under temporary names and renamed, so a task that runs again writes the same file.

Defined cases: null text is the empty text (one end token); unknown words get the share that the
lowest order leaves to unseen words; a null doc_id is never learned and counts as held out; with no
training text every score is 0 (one unseen word, probability 1); repeated rows count repeatedly.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.columns import pick
from ledgerloom.llm.textops import TextBatch, batches, mix
from ledgerloom.session import scratch_path, ship_package

#: Tokens that a task gathers before it writes sorted runs, and bytes of text scored at once.
RUN_TOKENS = 2_500_000
SLICE_BYTES = 4 << 20
OPEN_FILES = 512

_U = np.uint64
END = _U(0x1D8AF066A3C5B7E9)
START = _U(0x7C1592F3D1E64A0B)


def tokens(batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, hash before each token, first token of each document) with the end tokens."""
    starts, ends, first = batch.words()
    words = batch.span_hashes(starts, ends)
    bounds = first + np.arange(len(first))
    out = np.empty(len(words) + batch.rows, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[bounds[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = words
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[bounds[:-1]] = START
    return out, before, bounds


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * _U(0x9E3779B97F4A7C15) + word)


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


@dataclass
class Layout:
    """Where the model lies, its number of shards (a power of two) and the spread contexts."""

    folder: str
    bits: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def pair_shard(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        shard = _top(context, self.bits)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            some = np.flatnonzero(self.hot[at] == context)
            shard[some] = (shard[some] + (mix(word[some]) % self.spread[at[some]].astype(np.uint64)).astype(np.int64)) & ((1 << self.bits) - 1)
        return shard

    def path(self, name: str, shard: int) -> str:
        return os.path.join(self.folder, f"{name}-{shard:07d}")


def _store(path: str, values: np.ndarray) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    values.tofile(temporary)
    os.replace(temporary, path)


_maps: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()


def _mapped(path: str, kind: str) -> np.ndarray:
    """The file as a memory-mapped array; the most recent ones stay open."""
    key = (path, kind)
    if key not in _maps:
        _maps[key] = np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)
        if len(_maps) > OPEN_FILES:
            _maps.popitem(last=False)
    _maps.move_to_end(key)
    return _maps[key]


def _runs(keys: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Consecutive rows of equal shard."""
    cut = np.flatnonzero(np.diff(shard, prepend=-1, append=-2))
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(shard[a]), slice(int(a), int(b))


def _summed(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct keys in order (the first is the most significant) and their summed counts."""
    if not len(counts):
        return keys, counts
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return tuple(k[at] for k in keys), np.add.reduceat(counts[order], at)


def _count_pass(docs: DataFrame, emit) -> DataFrame:
    """(shard, blob) rows of sorted runs: ``emit(tokens, contexts)`` over bounded runs of tokens."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush():
            rows = list(emit(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "blob"])

        for part in parts:
            for _, _, batch in batches(part.column(0)):
                word, before, _ = tokens(batch)
                held.append((word, before))
                n += len(word)
                if n >= RUN_TOKENS:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "shard int, blob binary")


def _pack_counts(counts: np.ndarray) -> bytes:
    """One byte a count, longer ones after (those bytes are 255)."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def _unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.int64, -1, n) if len(raw) > n else 0
    return out


def _word_runs(bits: int):
    def emit(word, before):
        keys, counts = np.unique(word, return_counts=True)
        for shard, at in _runs(keys, _top(keys, bits)):
            yield shard, np.int64(at.stop - at.start).tobytes() + keys[at].tobytes() + _pack_counts(counts[at])
    return emit


def _read_words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, np.uint64, n, 8), _unpack_counts(blob[8 + 8 * n:], n)


def _pair_runs(layout: Layout):
    """A run lists each context once, with the number of its words."""
    def emit(word, before):
        (context, word), counts = _summed((before, word), np.ones(len(word), np.int64))
        shard = layout.pair_shard(context, word)
        order = np.argsort(shard, kind="stable")
        context, word, counts, shard = context[order], word[order], counts[order], shard[order]
        for one, at in _runs(context, shard):
            c, w = context[at], word[at]
            new = np.flatnonzero(np.diff(c, prepend=~c[:1]))
            sizes = np.diff(np.append(new, len(c)))
            head = np.array([len(new), len(c)], np.int64).tobytes()
            yield one, head + c[new].tobytes() + sizes.astype(np.uint32).tobytes() + w.tobytes() + _pack_counts(counts[at])
    return emit


def _read_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, n = np.frombuffer(blob, np.int64, 2)
    at = 16
    context = np.frombuffer(blob, np.uint64, m, at)
    at += 8 * int(m)
    sizes = np.frombuffer(blob, np.uint32, m, at)
    at += 4 * int(m)
    word = np.frombuffer(blob[at:at + 8 * int(n)], np.uint64)
    at += 8 * int(n)
    return np.repeat(context, sizes), word, _unpack_counts(blob[at:], int(n))


def _merge_words(layout: Layout):
    """Store one shard's words and counts; report its totals."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        parts = [_read_words(b) for b in group["blob"]]
        (keys,), counts = _summed((np.concatenate([k for k, _ in parts]),), np.concatenate([c for _, c in parts]))
        _store(layout.path("word", shard), keys)
        _store(layout.path("count", shard), counts.astype(np.int64))
        return pd.DataFrame({"shard": [shard], "words": [len(keys)], "tokens": [int(counts.sum())]})
    return run


def _frequent(layout: Layout, n_tokens: int):
    """Of the shards named, words with more than 1 / (4 * shards) of all tokens: 4 * shards of them at most."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["shard"]:
                counts = _mapped(layout.path("count", int(shard)), "i8")
                big = np.flatnonzero(counts > n_tokens / (4 << layout.bits))
                yield pd.DataFrame({"word": _mapped(layout.path("word", int(shard)), "u8")[big].view(np.int64), "n": counts[big]})
    return run


def _merge_pairs(layout: Layout):
    """Store one shard's pairs; deal out per word its left contexts and its pairs as a context."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        parts = [_read_pairs(b) for b in group["blob"]]
        (context, word), counts = _summed(tuple(np.concatenate([p[i] for p in parts]) for i in (0, 1)), np.concatenate([p[2] for p in parts]))
        hashes = pair_hash(context, word)
        order = np.argsort(hashes)
        large = order[counts[order] >= 255]
        _store(layout.path("pair", shard), hashes[order])
        _store(layout.path("pairs", shard), np.minimum(counts[order], 255).astype(np.uint8))
        _store(layout.path("large", shard), hashes[large])
        _store(layout.path("larges", shard), counts[large].astype(np.int64))
        left, n_left = np.unique(word, return_counts=True)
        new = np.flatnonzero(np.diff(context, prepend=~context[:1]))
        heads = context[new]
        classes = [np.add.reduceat((counts == 1).astype(np.int64), new), np.add.reduceat((counts == 2).astype(np.int64), new),
                   np.add.reduceat((counts >= 3).astype(np.int64), new)]
        of = np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64).tobytes()
        rows = {}
        for one, at in _runs(left, _top(left, layout.bits)):
            rows.setdefault(one, [b"", b""])[0] = np.int64(at.stop - at.start).tobytes() + left[at].tobytes() + _pack_counts(n_left[at])
        for one, at in _runs(heads, _top(heads, layout.bits)):
            rows.setdefault(one, [b"", b""])[1] = (np.int64(at.stop - at.start).tobytes() + heads[at].tobytes()
                                                   + b"".join(c[at].astype(np.uint32).tobytes() for c in classes))
        out = pd.DataFrame({"shard": list(rows), "left": [r[0] for r in rows.values()], "heads": [r[1] for r in rows.values()]})
        out["of"] = [of] + [b""] * (len(out) - 1)
        out["pairs"] = [len(counts)] + [0] * (len(out) - 1)
        return out[["shard", "left", "heads", "of", "pairs"]]
    return run


def _merge_stats(layout: Layout, discounts: tuple[float, float, float]):
    """Store, in the order of the shard's words, the left contexts and the weight left to the lower order."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        path = layout.path("word", shard)
        words = _mapped(path, "u8") if os.path.exists(path) else np.zeros(0, np.uint64)
        total = _mapped(layout.path("count", shard), "i8") if len(words) else np.zeros(0, np.int64)
        left = np.zeros(len(words), np.int64)
        freed = np.zeros(len(words))
        start = 0.0
        for blob in group["left"]:
            if blob:
                keys, counts = _read_words(blob)
                left[np.searchsorted(words, keys)] += counts
        for blob in group["heads"]:
            if blob:
                n = int(np.frombuffer(blob, np.int64, 1)[0])
                keys = np.frombuffer(blob, np.uint64, n, 8)
                classes = np.frombuffer(blob, np.uint32, 3 * n, 8 + 8 * n).reshape(3, n)
                mass = sum(d * c for d, c in zip(discounts, classes))
                is_start = keys == START
                start += float(mass[is_start].sum())
                freed[np.searchsorted(words, keys[~is_start])] += mass[~is_start]
        _store(layout.path("left", shard), left)
        _store(layout.path("freed", shard), (freed / np.maximum(total, 1)).astype(np.float64))
        return pd.DataFrame({"shard": [shard], "start": [start], "of": [np.array([(left == k).sum() for k in (1, 2, 3, 4)], np.int64).tobytes()],
                             "three": [int((left >= 3).sum())]})
    return run


def discounts_of(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of keys counted 1, 2, 3 and 4 times.

    Where one of these is 0, or the formula leaves (0, k), the discount is kept inside it.
    """
    n = [float(x) for x in n]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2
        out.append(float(min(max(d, 0.1), k - 0.05)))
    return tuple(out)


@dataclass
class Model:
    layout: Layout
    tokens: int
    words: int
    texts: int
    pairs: int
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    low_freed: float
    start_freed: float


def mounted(spark: SparkSession, path: str) -> str:
    """The path of a shared folder as workers see it."""
    if "://" not in path and not path.startswith("file:"):
        return path
    if not path.startswith("file:"):
        raise ValueError(f"the model folder must be a mounted file system: {path}")
    return "/" + path[len("file:"):].lstrip("/")


def train(texts: DataFrame) -> Model:
    """Count the rows' whole texts (column text) into a stored model."""
    spark = texts.sparkSession
    ship_package(spark)
    texts = pick(texts, {"text": "string"})
    # Shards follow the number of input partitions, a power of two.
    bits = max(1, (2 * texts.rdd.getNumPartitions() - 1).bit_length())
    layout = Layout(mounted(spark, scratch_path(spark, f"lm-{uuid.uuid4().hex}")), bits)
    os.makedirs(layout.folder, exist_ok=True)

    shards = (_count_pass(texts, _word_runs(bits)).groupBy("shard")
              .applyInPandas(_merge_words(layout), "shard int, words long, tokens long").collect())
    n_tokens, n_words = sum(r["tokens"] for r in shards), sum(r["words"] for r in shards)
    n_texts = texts.count()
    named = spark.createDataFrame([(r["shard"],) for r in shards], "shard int")
    many = named.mapInPandas(_frequent(layout, n_tokens), "word long, n long").collect()
    if n_texts * (4 << bits) > n_tokens:  # the start mark is a context as frequent as the end token
        many = [*many, {"word": int(START.view(np.int64)), "n": n_texts}]
    top = np.array([r["word"] for r in many], np.int64).view(np.uint64)
    order = np.argsort(top)
    share = [min(-(-r["n"] * (4 << bits) // n_tokens), 1 << bits) for r in many]
    layout.hot, layout.spread = top[order], np.array(share, np.int64)[order]

    stats = _count_pass(texts, _pair_runs(layout)).groupBy("shard").applyInPandas(
        _merge_pairs(layout), "shard int, left binary, heads binary, of binary, pairs long")
    path = scratch_path(spark, f"lm-stats-{uuid.uuid4().hex}")
    stats.write.parquet(path)
    stats = spark.read.parquet(path)
    of = [np.frombuffer(r["of"], np.int64) for r in stats.filter("length(of) > 0").select("of").collect()]
    discounts = discounts_of(sum(of, np.zeros(4, np.int64)))
    pairs = stats.agg(F.sum("pairs")).first()[0] or 0
    done = (stats.select("shard", "left", "heads").groupBy("shard")
            .applyInPandas(_merge_stats(layout, discounts), "shard int, start double, of binary, three long").collect())
    low_of = sum([np.frombuffer(r["of"], np.int64) for r in done], np.zeros(4, np.int64))
    low = discounts_of(low_of)
    three = sum(r["three"] for r in done)
    low_freed = (low[0] * low_of[0] + low[1] * low_of[1] + low[2] * three) / max(1, pairs) if pairs else 1.0
    return Model(layout, n_tokens, n_words, n_texts, int(pairs), discounts, low, float(low_freed),
                 sum(r["start"] for r in done) / max(1, n_texts))


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.select([counts == 0, counts == 1, counts == 2], [0.0, d[0], d[1]], d[2])


def _look_up_words(model: Model, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, left contexts and freed weights of sorted distinct words (0 where unknown)."""
    count, left, freed = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words))
    layout = model.layout
    for shard, at in _runs(words, _top(words, layout.bits)):
        path = layout.path("word", shard)
        if not os.path.exists(path):
            continue
        keys = _mapped(path, "u8")
        where = np.minimum(np.searchsorted(keys, words[at]), len(keys) - 1)
        hit = np.flatnonzero(keys[where] == words[at])
        target = hit + at.start
        for out, name, kind in ((count, "count", "i8"), (left, "left", "i8"), (freed, "freed", "f8")):
            out[target] = _mapped(layout.path(name, shard), kind)[where[hit]]
    return count, left, freed


def _look_up_pairs(model: Model, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Counts of pairs (0 where unseen)."""
    layout = model.layout
    shard, hashes = layout.pair_shard(context, word), pair_hash(context, word)
    order = np.lexsort((hashes, shard))
    out = np.zeros(len(word), np.int64)
    for one, at in _runs(hashes, shard[order]):
        path = layout.path("pair", one)
        if not os.path.exists(path):
            continue
        keys, asked = _mapped(path, "u8"), hashes[order[at]]
        where = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = np.flatnonzero(keys[where] == asked)
        got = _mapped(layout.path("pairs", one), "u1")[where[hit]].astype(np.int64)
        big = np.flatnonzero(got == 255)
        if len(big):
            at_large = np.searchsorted(_mapped(layout.path("large", one), "u8"), asked[hit[big]])
            got[big] = _mapped(layout.path("larges", one), "i8")[at_large]
        out[order[at][hit]] = got
    return out


def log_probabilities(model: Model, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of each token's probability, of its base probability, and whether it is known."""
    words, at = np.unique(np.concatenate([word, before]), return_inverse=True)
    count, left, freed = _look_up_words(model, words)
    at, context = at[:len(word)], at[len(word):]
    floor = model.low_freed / (model.words + 1)
    low = (left - _discount(left, model.low_discounts)) / max(1, model.pairs) + floor
    total = np.where(words == START, model.texts, count)
    freed = np.where(words == START, model.start_freed, freed)
    # Each distinct pair once.
    key = at.astype(np.int64) * len(words) + context
    _, one, back = np.unique(key, return_index=True, return_inverse=True)
    pair = _look_up_pairs(model, before[one], word[one])
    seen = total[context[one]]
    high = np.where(seen > 0, (pair - _discount(pair, model.discounts)) / np.maximum(seen, 1) + freed[context[one]] * low[at[one]], low[at[one]])
    base = (count + 0.1) / (model.tokens + 0.1 * (model.words + 1))
    return np.log10(high)[back], np.log10(base)[at], (count > 0)[at]


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and n_tokens, n_known, base_score, score of every whole text."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    types = dict(docs.dtypes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in parts:
            for start, stop, batch in batches(part.column(part.num_columns - 1), limit=SLICE_BYTES):
                word, before, bounds = tokens(batch)
                high, base, known = log_probabilities(model, word, before)
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (high, base, known.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).slice(start, stop - start) for i in range(len(keep))]
                    + [pa.array(np.diff(bounds)), pa.array(sums[2]), pa.array(sums[1]), pa.array(sums[0])],
                    names=[*keep, "n_tokens", "n_known", "base_score", "score"])

    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["n_tokens long", "n_known long", "base_score double", "score double"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text_in")).mapInArrow(run, schema)
