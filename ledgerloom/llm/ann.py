"""Approximate nearest neighbours by collision counting over query-centred windows.

Vectors are scaled to length one (cosine order is then distance order) and projected on ``PROJECTIONS``
random directions; each projection of a block of vectors is a sorted array.  For a search radius r a
vector collides with the query on a direction if its projection lies within ``WIDTH / 2 * r`` of the
query's.  A vector within distance r collides on a known share of directions, so those that collide on
at least ``threshold`` directions are verified with the exact cosine on the original vectors.  Radii
grow (virtual rehashing: the same sorted arrays, wider windows) until the k-th verified neighbour lies
within the radius, so what is missed is only what a fair number of directions missed.

The work is dealt in blocks: every block of vectors meets every block of queries in one task of
bounded size, which returns k rows per query; the k best per query are kept at the end.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null id, take no part; only vectors of the query's dimension are compared; rows with the
query's own id are not its candidates; rows repeated under one id are candidates each, and have a list
each if they are queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.columns import pick
from ledgerloom.session import ship_package

PROJECTIONS = 48
#: Window width for radius 1, and the share of directions on which a candidate must collide.
WIDTH = 2.0
COLLISION_SHARE = 0.5
FIRST_RADIUS = 0.1
GROWTH = 1.25
BLOCK_VECTORS = 16384
BLOCK_QUERIES = 512


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.directions = np.random.default_rng(97).normal(size=(vectors.shape[1], PROJECTIONS))
        projected = (vectors / self.norms[:, None]) @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=0).T.copy()
        self.order = self.order.T.copy()
        self.threshold = max(1, int(np.ceil(COLLISION_SHARE * PROJECTIONS)))

    def search(self, vector: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k best verified vectors (equal cosines: smaller id first)."""
        norm = np.sqrt((vector * vector).sum())
        centre = (vector / norm) @ self.directions
        n = len(self.ids)
        count = np.zeros(n, np.int32)
        checked = self.ids == own
        free = n - int(checked.sum())
        low = high = np.array([np.searchsorted(row, c) for row, c in zip(self.sorted, centre)])
        found, scores = [], []
        best = -np.inf
        radius = FIRST_RADIUS
        while free:
            reach = WIDTH / 2 * radius
            new_low = np.array([np.searchsorted(row, c - reach, "left") for row, c in zip(self.sorted, centre)])
            new_high = np.array([np.searchsorted(row, c + reach, "right") for row, c in zip(self.sorted, centre)])
            new_low, new_high = np.minimum(new_low, low), np.maximum(new_high, high)
            added = [order[a:b] for order, a, b in zip(self.order, new_low, low)] + [order[a:b] for order, a, b in zip(self.order, high, new_high)]
            count += np.bincount(np.concatenate(added), minlength=n).astype(np.int32)
            low, high = new_low, new_high
            fresh = np.flatnonzero((count >= self.threshold) & ~checked)
            if len(fresh):
                checked[fresh] = True
                found.append(fresh)
                scores.append((self.vectors[fresh] * vector).sum(axis=1) / (self.norms[fresh] * norm))
                free -= len(fresh)
                every = np.concatenate(scores)
                if len(every) >= k:
                    best = np.partition(every, len(every) - k)[len(every) - k]
            # Distance of unit vectors from their cosine.
            if best > -np.inf and np.sqrt(max(0.0, 2 - 2 * best)) <= radius:
                break
            radius *= GROWTH
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        at, score = np.concatenate(found), np.concatenate(scores)
        top = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at[top]], score[top]


def _search_block(k: int):
    def run(key, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            index = Index(vectors["id"].to_numpy(np.int64), np.stack(vectors["v"].to_numpy()).astype(np.float64))
            for row, own, vector in zip(queries["row"].to_numpy(np.int64), queries["id"].to_numpy(np.int64), queries["v"]):
                ids, scores = index.search(np.asarray(vector, np.float64), int(own), k)
                out.append(pd.DataFrame({"row": np.full(len(ids), row), "query_id": np.full(len(ids), own), "vec_id": ids, "score": scores}))
        none = np.zeros(0, np.int64)
        return pd.concat(out) if out else pd.DataFrame({"row": none, "query_id": none, "vec_id": none, "score": np.zeros(0)})
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for (vec_id, embedding) rows of both sides."""
    ship_package(vectors.sparkSession)

    def side(df: DataFrame) -> DataFrame:
        rows = pick(df, {"vec_id": "long", "embedding": "array<double>"})
        return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
            F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.size("embedding").alias("dim"))

    base, asked = side(vectors), side(queries)
    sizes = [df.agg(F.count(F.lit(1))).first()[0] for df in (base, asked)]
    parts = max(1, -(-sizes[0] // BLOCK_VECTORS))
    asks = max(1, -(-sizes[1] // BLOCK_QUERIES))
    base = base.withColumn("b", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    asked = asked.withColumn("row", F.monotonically_increasing_id())  # a list for each query row, also of one id
    asked = asked.withColumn("q", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(asks))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    key = ["dim", "b", "q"]
    base, asked = (df.withColumn("b", F.col("b").cast("int")).withColumn("q", F.col("q").cast("int")) for df in (base, asked))
    found = base.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_search_block(k), "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
