import collections
import random
import zlib

import pytest

from ledgerloom.llm import sharding

COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "group_docs"]


def checked(spark, docs_of, rows, shards=16):
    """Laws of every result: whole rows, counts at most one apart, gapless slots."""
    df = sharding.shard_texts(docs_of(rows), shards)
    assert df.columns == COLUMNS
    got = df.collect()
    plain = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(plain, key=str)
    slots = collections.defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    return got


def split(got):
    """Number of shards of each group of two or more equal texts: {(size, crc): (documents, shards)}."""
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.size, r.text_crc32].append(r.shard)
    assert all(r.group_docs == len(groups[r.size, r.text_crc32]) for r in got)
    return {k: (len(v), len(set(v))) for k, v in groups.items() if len(v) > 1}


def test_equal_texts_meet_in_a_shard(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, f"single {i}") for i in range(700)]
    for g in range(150):
        rows += [(1000 + 10 * g + j, f"group {g}") for j in range(rng.choice([2, 2, 3, 5, 9]))]
    rows += [(5000 + i, "hot text") for i in range(600)]
    rng.shuffle(rows)
    found = split(checked(spark, docs_of, rows))
    quota = len(rows) // 16
    apart = {k: v for k, v in found.items() if v[1] > 1}
    hot = max(found.values())
    assert hot[0] == 600 and hot[1] <= -(-600 // quota) + 2  # a group larger than a shard fills one after the other
    assert len(apart) <= 3


def test_all_linked_leaves_little_room(spark, docs_of):
    rows = [(i, f"pair {i // 2}") for i in range(800)]
    found = split(checked(spark, docs_of, rows, 8))
    assert len(found) == 400 and sum(n > 1 for _, n in found.values()) <= 120  # 7 of 8 pairs start apart


def test_defined_cases(spark, docs_of):
    rows = [(None, None), (None, ""), (1, "a"), (1, "a"), (1, "b"), (2, "é" * 5), (3, None), (None, "x y" * 50_000)]
    got = checked(spark, docs_of, rows)
    assert sorted(r.group_docs for r in got) == [1, 1, 1, 2, 2, 3, 3, 3]
    assert checked(spark, docs_of, [(7, "one")])[0].shard == 0
    assert sharding.shard_texts(docs_of([(1, "a")]).limit(0)).collect() == []


@pytest.mark.parametrize("text", ["", "same text"])
def test_one_group_of_all(spark, docs_of, text):
    assert set(split(checked(spark, docs_of, [(i, text) for i in range(321)])).values()) == {(321, 16)}
