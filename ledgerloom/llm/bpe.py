"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

Texts are cut by the vocabulary's pattern.  Each distinct pre-token of a slice of documents is looked
up in a minimal perfect hash of the vocabulary (one probe and one comparison); those that are not
whole tokens are merged by rank with a heap of adjacent pairs over linked byte spans.  Results of both
tiers stay in a bounded store of the worker, so a frequent pre-token is resolved once per worker.

Defined cases: a null text is the empty text (no ids); a repeated row gives a repeated result; an
empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.columns import byte_slices, pick, text_or_empty
from ledgerloom.session import ship_package

#: Text bytes encoded at once, and distinct pre-tokens a worker keeps resolved.
SLICE_BYTES = 2 << 20
STORE_ENTRIES = 300_000

_U = np.uint64


class PerfectHash:
    """Minimal perfect hash of the vocabulary: n keys in n slots, by bucket displacement.

    A key's 64-bit hash picks a bucket; the bucket's displacement picks the slot.  Buckets are placed
    from the largest to the smallest, trying displacements until all keys of a bucket fall on free
    slots; a bucket of one key stores its slot itself (as a negative number).
    """

    def __init__(self, keys: Sequence[bytes]):
        n = self.size = len(keys)
        self.buckets = max(1, n // 4)
        hashes = self.hash(keys)
        if len(np.unique(hashes)) != n:
            raise ValueError("repeated keys")
        order = np.argsort(hashes % _U(self.buckets), kind="stable")
        bounds = np.searchsorted((hashes % _U(self.buckets))[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        self.shift = np.zeros(self.buckets, np.int64)
        self.at = np.full(n, -1, np.int64)  # slot -> key number
        self.check = np.zeros(n, np.uint64)
        taken = np.zeros(n, bool)
        free = None
        for b in np.argsort(-sizes, kind="stable"):
            members = order[bounds[b]:bounds[b + 1]]
            if not len(members):
                break
            if len(members) == 1:
                if free is None:
                    free = iter(np.flatnonzero(~taken))
                slots = np.array([next(free)])
                self.shift[b] = -int(slots[0]) - 1
            else:
                first = 1
                while True:
                    tries = self._slot(hashes[members][None, :], np.arange(first, first + 64)[:, None])
                    ranked = np.sort(tries, axis=1)
                    good = ~taken[tries].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                    if good.any():
                        break
                    first += 64
                chosen = int(np.argmax(good))
                slots = tries[chosen]
                self.shift[b] = first + chosen
            taken[slots] = True
            self.at[slots] = members
            self.check[slots] = hashes[members]

    @staticmethod
    def hash(keys: Sequence[bytes]) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(k) for k in keys), np.uint64, len(keys))

    def _slot(self, hashes: np.ndarray, shift) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = hashes ^ (np.asarray(shift).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
            x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
            return ((x ^ (x >> _U(27))) % _U(self.size)).astype(np.int64)

    def find(self, keys: Sequence[bytes]) -> np.ndarray:
        """Key number of each candidate, -1 where its hash is no key's (compare the bytes after)."""
        if not len(keys) or not self.size:
            return np.full(len(keys), -1, np.int64)
        hashes = self.hash(keys)
        shift = self.shift[(hashes % _U(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -shift - 1, self._slot(hashes, shift))
        return np.where(self.check[slots] == hashes, self.at[slots], -1)


class Vocabulary:
    """Token bytes by id, with the tier-one hash.  Its size is the vocabulary file's (about 1 MB)."""

    def __init__(self, tokens: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.keys = list(tokens)
        self.ids = np.fromiter(tokens.values(), np.uint32, len(tokens))
        self.hash = PerfectHash(self.keys)
        self.name = hashlib.sha256(pattern.encode() + b"\0".join(self.keys) + self.ids.tobytes()).hexdigest()

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """From a rank file (base64 token, rank), read on the driver."""
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            return cls({base64.b64decode(a): int(b) for a, b in pairs}, pattern)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that is no whole token: adjacent spans merged by lowest rank, leftmost first.

    Spans are linked by their starts; the heap holds (rank, start, end) of adjacent pairs packed in
    one integer, and an entry whose spans have changed since is passed over.
    """
    n = len(word)
    stop = list(range(1, n + 2))  # end of the span that starts here; 0: no span starts here
    before = list(range(-1, n))  # start of the span to the left
    bits = n.bit_length()
    mask = (1 << bits) - 1
    get = ranks.get
    heap = [(r << bits | i) << bits | (i + 2) for i in range(n - 1) if (r := get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        end = top & mask
        start = (top >> bits) & mask
        middle = stop[start]
        if not middle or middle >= end or stop[middle] != end:
            continue
        stop[start] = end
        stop[middle] = 0
        if end < n:
            before[end] = start
            far = stop[end]
            if (r := get(word[start:far])) is not None:
                push(heap, (r << bits | start) << bits | far)
        left = before[start]
        if left >= 0 and (r := get(word[left:end])) is not None:
            push(heap, (r << bits | left) << bits | end)
    out = []
    at = 0
    while at < n:
        end = stop[at]
        out.append(ranks[word[at:end]])
        at = end
    return out


class Encoder:
    """Encodes and decodes slices of texts; one per worker and vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(vocabulary.pattern).findall
        self.ranks = dict(zip(vocabulary.keys, vocabulary.ids.tolist()))
        order = np.argsort(vocabulary.ids)
        self.sorted_ids = vocabulary.ids[order]
        self.pieces = [vocabulary.keys[i] for i in order]
        lengths = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        self.piece_at = np.concatenate([[0], np.cumsum(lengths)])
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.begin = np.zeros(1, np.int64)

    def _resolve(self, tokens: list[str]) -> None:
        """Both tiers for pre-tokens not yet in the store."""
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        found = self.vocabulary.hash.find(raw)
        keys, ids, ranks = self.vocabulary.keys, self.vocabulary.ids, self.ranks
        flat: list[int] = []
        sizes = np.ones(len(raw), np.int64)
        for i, (word, at) in enumerate(zip(raw, found.tolist())):
            if at >= 0 and keys[at] == word:
                flat.append(int(ids[at]))
            else:
                merged = merge(word, ranks)
                sizes[i] = len(merged)
                flat += merged
        base = len(self.known)
        self.known.update(zip(tokens, range(base, base + len(tokens))))
        self.pool = np.concatenate([self.pool, np.array(flat, np.uint32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one more number than texts)."""
        cut = [self.split(t) for t in texts]
        flat = [t for tokens in cut for t in tokens]
        if len(self.known) > STORE_ENTRIES:
            self._clear()
        fresh = set(flat).difference(self.known)
        if fresh:
            self._resolve(sorted(fresh))
        codes = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        lengths = np.diff(self.begin)[codes]
        ends = np.cumsum(lengths)
        source = np.repeat(self.begin[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        ids = self.pool[source]
        words = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])
        return ids, np.concatenate([[0], ends])[words]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and where each id's bytes begin."""
        at = np.searchsorted(self.sorted_ids, ids)
        if len(ids) and (at.max(initial=0) >= len(self.sorted_ids) or (self.sorted_ids[at] != ids).any()):
            raise ValueError("id outside the vocabulary")
        lengths = self.piece_at[at + 1] - self.piece_at[at]
        ends = np.cumsum(lengths)
        source = np.repeat(self.piece_at[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.piece_bytes[source], np.concatenate([[0], ends])


_encoders: dict[str, Encoder] = {}


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder (kept between tasks; its store is bounded)."""
    if vocabulary.name not in _encoders:
        _encoders.clear()
        _encoders[vocabulary.name] = Encoder(vocabulary)
    return _encoders[vocabulary.name]


def _over_texts(df: DataFrame, text: str, keep: Sequence[str], vocabulary: Vocabulary, schema: str, row_of) -> DataFrame:
    """Apply ``row_of(encoder, texts, ids, begin) -> list of Arrow arrays`` to slices of rows."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for part in parts:
            column = text_or_empty(part.column(part.schema.get_field_index(text)))
            for start, stop in byte_slices(column, SLICE_BYTES):
                texts = column.slice(start, stop - start).to_pylist()
                ids, begin = encoder.encode(texts)
                kept = [part.column(part.schema.get_field_index(c)).slice(start, stop - start) for c in keep]
                yield pa.RecordBatch.from_arrays(kept + row_of(encoder, texts, ids, begin), names=[*keep, *names])

    types = dict(df.dtypes)
    full = ", ".join([f"`{c}` {types[c]}" for c in keep] + [schema])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).mapInArrow(run, full)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every whole text."""
    def row(encoder, texts, ids, begin):
        return [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids.astype(np.int32)))]
    return _over_texts(pick(docs, {"doc_id": "long", "text": "string"}), "text", ["doc_id"], vocabulary, "ids array<int>", row)


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ``text`` of rows with ``ids``; null ids give a null text, bytes that are no UTF-8 U+FFFD."""
    spark = tokens.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for part in parts:
            texts = [None if ids is None else encoder.decode(np.array(ids, np.uint32))[0].tobytes().decode("utf-8", "replace")
                     for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return pick(tokens, {"doc_id": "long", "ids": "array<int>"}).mapInArrow(run, "doc_id long, text string")


def token_lengths(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and n_tokens of every whole text."""
    def row(encoder, texts, ids, begin):
        return [pa.array(np.diff(begin))]
    return _over_texts(pick(docs, {"doc_id": "long", "text": "string"}), "text", ["doc_id"], vocabulary, "n_tokens long", row)


def digests(docs: DataFrame, vocabulary: Vocabulary, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept long columns, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256.

    The ids are decoded again from the vocabulary, not from the text.
    """
    def row(encoder, texts, ids, begin):
        raw = np.ascontiguousarray(ids, "<u4")
        back, at = encoder.decode(ids)
        cut = at[begin]
        sha = hashlib.sha256
        return [pa.array(np.diff(begin)),
                pa.array([sha(raw[a:b].data).hexdigest() for a, b in zip(begin[:-1], begin[1:])], pa.string()),
                pa.array([sha(back[a:b].data).hexdigest() for a, b in zip(cut[:-1], cut[1:])], pa.string())]
    return _over_texts(pick(docs, dict.fromkeys(keep, "long") | {"text": "string"}), "text", keep, vocabulary,
                       "n_tokens long, ids_sha256 string, decoded_sha256 string", row)
