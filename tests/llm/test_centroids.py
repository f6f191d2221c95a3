import hashlib

import numpy as np
import pytest

from ledgerloom.llm import centroids

COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def plain(rows, k=40, rounds=5, d=64, seed=2):
    """Every vector against every centroid in whole numbers, in each round."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    whole = [[int(np.floor(256 * x)) for x in v] for _, v in kept]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v, w) for (i, v), w in zip(kept, whole) if i is not None)
    at = [w for _, _, w in order[:k]]
    if not at:
        return []
    for number in range(rounds + 1):
        dist = [[sum((a - b) ** 2 for a, b in zip(w, c)) for c in at] for w in whole]
        own = [x.index(min(x)) for x in dist]
        if number < rounds:
            for c in range(len(at)):
                mine = [w for w, o in zip(whole, own) if o == c]
                if mine:
                    at[c] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = [sum(x[o] for x, o in zip(dist, own) if o == c) for c in range(len(at))]
    return [(i, o, x[o], inertia[o], sum(inertia), hashlib.sha256(",".join(map(str, at[o])).encode()).hexdigest()) for (i, _), o, x in zip(kept, own, dist)]


def shown(rows):
    return sorted(map(tuple, rows), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, ids int").repartition(3)
    return [tuple(r[c] for c in COLUMNS) for r in centroids.cluster(df, **more).collect()]


@pytest.mark.parametrize("spread", [1.0, 3.0, 1 << 14, 0.0])
def test_rows_are_those_of_the_plain_rounds(spark, spread):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(9, 8)) * spread
    rows = [(i, (middle[i % 9] + rng.normal(size=8) * spread / 3).tolist()) for i in range(300)]
    rows += [(0, rows[1][1]), (300, rows[2][1]), (None, rows[3][1]), (301, [0.0] * 8), (301, [-0.001] * 8), (302, None), (303, [1.0] * 7), (304, [None] + [1.0] * 7),
             (305, [float("nan")] * 8), (306, [float("inf")] * 8), (307, [])]
    report = []
    got = run(spark, rows, centroids=12, components=8, block=50, report=report)
    assert shown(got) == shown(plain(rows, 12, d=8))
    assert report[0] == len(got) and all(n <= report[0] for n in report)
    if spread == 1.0:
        assert sum(report[1:]) < 0.8 * (len(report) - 1) * report[0]  # most gaps hold


def test_small_tables(spark):
    assert run(spark, []) == [] and run(spark, [(None, [1.0] * 64)]) == []
    rows = [(i, [float(i % 3)] * 64) for i in range(7)]
    assert shown(run(spark, rows)) == shown(plain(rows))
    assert run(spark, [(1, [2e6] * 64), (2, [1.0] * 64)])[0][0] == 2  # too large for 64-bit distances


def test_bounds_never_hide_a_nearer_centroid():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-40, 40, (400, 5))
    at = vectors[:20].copy()
    block = centroids.Block(None, vectors, None, [])
    block.assign_all(at)
    drift = np.zeros(20)
    for _ in range(25):
        new = at + rng.integers(-2, 3, at.shape)
        gone = np.sqrt(((new - at) ** 2).sum(1))
        drift = drift + gone + np.array([np.delete(gone, c).max() for c in range(20)])
        at = new
        block.rescan(at, drift)
        assert (block.clusters == centroids.squared(vectors, at).argmin(1)).all()


def test_squared_distances_are_exact():
    big = np.array([[(1 << 27) - 1, -(1 << 27)], [3, -4]])
    assert centroids.squared(big, -big).tolist() == [[sum((int(a) + int(b)) ** 2 for a, b in zip(v, c)) for c in big] for v in big]
