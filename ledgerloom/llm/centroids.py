"""Exact centroid clustering of vectors with heap-ordered bounds.

Vectors become whole numbers, floor(``SCALE`` x) per component; assignment, ties (the smaller centroid) and
centroid means (componentwise floor) are exact in whole numbers.

Vectors are kept in blocks: one row holds a block's vectors, their clusters and one heap per cluster.  A
vector's key in its cluster's heap is its gap (distance to the second nearest centroid less the distance to
its own) plus the drift that the cluster had gathered when the key was made.  A cluster gathers, with each
move of the centroids, its own centroid's move and the largest move of any other.  While the key is above
the gathered drift no other centroid can be as near, so a round pops keys from the top of the heaps only as
long as they have expired; those vectors are measured against all centroids again and pushed with a new
key, and all others are not looked at.  Gaps are taken a little smaller than measured so that rounding of
square roots never hides a vector.

Each round is a written table of the shared folder (a lost executor costs its tasks only).  The driver holds
the centroids and their sums: a round returns one sum of what moved per centroid and component.

Defined cases: vectors that are null, of another length, or hold null, non-finite or larger components than
``LARGEST`` (squared distances would not fit into 64 bits) take no part; rows with a null vec_id are clustered
but never chosen as a first centroid; rows repeated under one vec_id are vectors each, the least vector first
where a first centroid is chosen; with fewer vectors than centroids there are as many centroids as vectors;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.columns import pick
from ledgerloom.operators.positions import stored
from ledgerloom.session import ship_package

COMPONENTS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: Vectors in one block, and the largest component (times SCALE) whose squared distances fit into 64 bits.
BLOCK = 4096
LARGEST = 1 << 27
#: Below this size products and their sums are exact in doubles.
_EXACT_DOUBLE = 1 << 22
#: What a gap is shortened by, in parts of the distances and at least.
_MARGIN = 1e-9

_STATE = ("ids array<long>, width int, matrix binary, clusters binary, keys binary, items binary, ends binary, "
          "moved array<long>, scanned long")


def _whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * float(SCALE)).astype(np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, centroids)."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT_DOUBLE:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and the gap to the second nearest, taken a little smaller."""
    d = squared(vectors, centroids)
    best = d.argmin(axis=1)
    own = np.sqrt(d[np.arange(len(d)), best].astype(np.float64))
    if len(centroids) == 1:
        return best, np.full(len(d), np.inf)
    second = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))
    return best, second - own - _MARGIN * (second + own + 1)


class Block:
    """The vectors of one row, their clusters and the clusters' heaps of (key, vector)."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, clusters: np.ndarray | None, heaps: list):
        self.ids, self.vectors, self.clusters, self.heaps = ids, vectors, clusters, heaps

    @classmethod
    def of(cls, row: dict, ids: pa.Array, count: int) -> Block:
        vectors = np.frombuffer(row["matrix"], f"<i{row['width']}").reshape(len(ids), -1).astype(np.int64)
        keys, items = np.frombuffer(row["keys"], "<f8"), np.frombuffer(row["items"], "<i4")
        ends = np.frombuffer(row["ends"], "<i4")
        heaps = [(keys[a:b], items[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        return cls(ids, vectors, np.frombuffer(row["clusters"], "<i4").copy(), heaps[:count])

    def assign_all(self, centroids: np.ndarray) -> np.ndarray:
        """The first round: every vector is measured; a sorted array is a heap."""
        self.clusters, gap = nearest(self.vectors, centroids)
        self.heaps = []
        for c in range(len(centroids)):
            items = np.flatnonzero(self.clusters == c)
            items = items[np.argsort(gap[items], kind="stable")]
            self.heaps.append((gap[items], items.astype(np.int32)))
        return self.clusters

    def rescan(self, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pop and measure vectors whose gap has expired: (vectors, their old clusters)."""
        opened, popped = {}, []
        for c, (keys, items) in enumerate(self.heaps):
            if not len(keys) or keys[0] > drift[c]:
                continue
            heap = opened[c] = list(zip(keys.tolist(), items.tolist()))
            while heap and heap[0][0] <= drift[c]:
                popped.append(heappop(heap)[1])
        at = np.array(popped, np.int64)
        old = self.clusters[at]
        if len(at):
            new, gap = nearest(self.vectors[at], centroids)
            self.clusters[at] = new
            for x, c, key in zip(popped, new.tolist(), (gap + drift[new]).tolist()):
                if c not in opened:
                    opened[c] = list(zip(self.heaps[c][0].tolist(), self.heaps[c][1].tolist()))
                heappush(opened[c], (key, x))
        for c, heap in opened.items():
            self.heaps[c] = (np.array([k for k, _ in heap]), np.array([x for _, x in heap], np.int32))
        return at, old

    def row(self, moved: np.ndarray, scanned: int) -> dict:
        most = int(np.abs(self.vectors).max(initial=0))
        width = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4
        return {"ids": self.ids.to_pylist(), "width": width, "matrix": self.vectors.astype(f"<i{width}").tobytes(),
                "clusters": self.clusters.astype("<i4").tobytes(), "keys": b"".join(k.astype("<f8").tobytes() for k, _ in self.heaps),
                "items": b"".join(i.astype("<i4").tobytes() for _, i in self.heaps),
                "ends": np.cumsum([len(k) for k, _ in self.heaps]).astype("<i4").tobytes(), "moved": moved.ravel().tolist(), "scanned": scanned}


_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("matrix", pa.binary()), ("clusters", pa.binary()), ("keys", pa.binary()),
                    ("items", pa.binary()), ("ends", pa.binary()), ("moved", pa.list_(pa.int64())), ("scanned", pa.int64())])


def _sums(vectors: np.ndarray, clusters: np.ndarray, count: int) -> np.ndarray:
    """Sum of the components and number of vectors of each cluster."""
    out = np.zeros((count, vectors.shape[1] + 1), np.int64)
    np.add.at(out[:, :-1], clusters, vectors)
    out[:, -1] = np.bincount(clusters, minlength=count)
    return out


def first_round(vectors: DataFrame, centroids: np.ndarray, block: int) -> DataFrame:
    """Blocks of (id, v) rows with every vector measured."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, block):
                piece = part.slice(start, block)
                matrix = _whole(piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1))
                made = Block(piece.column(0), matrix, None, [])
                clusters = made.assign_all(centroids)
                yield pa.RecordBatch.from_pylist([made.row(_sums(matrix, clusters, len(centroids)), len(matrix))], schema=_ARROW)

    return vectors.mapInArrow(run, _STATE)


def next_round(state: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """Blocks after the centroids have moved; only vectors with expired gaps are measured."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                one = part.slice(i, 1)
                row = {n: one.column(n)[0].as_py() for n in ("width", "matrix", "clusters", "keys", "items", "ends")}
                made = Block.of(row, one.column("ids").flatten(), len(centroids))
                at, old = made.rescan(centroids, drift)
                moved = _sums(made.vectors[at], made.clusters[at], len(centroids)) - _sums(made.vectors[at], old, len(centroids))
                yield pa.RecordBatch.from_pylist([made.row(moved, len(at))], schema=_ARROW)

    return state.mapInArrow(run, _STATE)


def _members(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                ids = part.column("ids").slice(i, 1).flatten()
                matrix = np.frombuffer(part.column("matrix")[i].as_py(), f"<i{part.column('width')[i].as_py()}").reshape(len(ids), -1).astype(np.int64)
                clusters = np.frombuffer(part.column("clusters")[i].as_py(), "<i4")
                yield pa.RecordBatch.from_arrays([ids, pa.array(clusters), pa.array(((matrix - centroids[clusters]) ** 2).sum(1))], names=["vec_id", "cluster", "distance"])

    return state.select("ids", "width", "matrix", "clusters").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, seed: int = SEED,
            block: int = BLOCK, report: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept (vec_id, embedding).

    ``report``: a list that receives the number of vectors measured in each round.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = pick(vectors, {"vec_id": "long", "embedding": "array<double>"}).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    fits = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= LARGEST / SCALE), F.lit(False)))
    rows = rows.filter(F.coalesce((F.size("v") == components) & fits, F.lit(False)))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    chosen = rows.filter("id is not null").withColumn("h", draw).orderBy("h", "v").limit(centroids).collect()
    if not chosen:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    at = _whole(np.array([r.v for r in sorted(chosen, key=lambda r: (r.h, r.v))], np.float64))
    count = len(at)
    drift, sums, state = np.zeros(count), np.zeros((count, components + 1), np.int64), None
    for number in range(rounds + 1):
        if number:
            new = np.where(sums[:, -1:] > 0, np.floor_divide(sums[:, :-1], np.maximum(sums[:, -1:], 1)), at)
            gone = np.sqrt(((new - at).astype(np.float64) ** 2).sum(1)) * (1 + _MARGIN)
            if not gone.any():
                break
            # Each cluster's own move and the largest move of any other centroid.
            others = np.array([np.delete(gone, c).max(initial=0) for c in range(count)])
            at, drift = new, drift + gone + others
        state = stored(first_round(rows, at, block) if state is None else next_round(state, at, drift), "centroids")
        moved = state.select(F.posexplode("moved")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        change = np.zeros(count * (components + 1), np.int64)
        for r in moved:
            change[r.pos] = r.n
        sums = sums + change.reshape(count, -1)
        if report is not None:
            report.append(state.agg(F.sum("scanned")).first()[0])
    members = _members(state, at)
    inertia = {r.cluster: r.n for r in members.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    facts = [(c, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()]
    # One row per centroid.
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
