import collections
import hashlib
import math
import re
import zlib

import pytest

from ledgerloom.llm import resample


def plain(docs, target, percent=25, least=20, seed=7, buckets=10000):
    """Every definition in turn, one text at a time."""
    def features(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return len(words), [zlib.crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]
    s, t = (collections.Counter(b for text in side for b in features(text)[1]) for side in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        n, found = features(text)
        gain = [math.floor(1000 * math.log(float((t[b] + 1) * (all_s + buckets)) / float((s[b] + 1) * (all_t + buckets)))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    taking = [r for r in rows if r[5] >= least]
    taking.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(taking[:percent * len(taking) // 100], 1):
        r[4] = place
    return rows


def shown(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("head", [resample.HEAD_WORDS, 3])
def test_rows_are_those_of_the_plain_definition(spark, docs_of, head):
    rows = [(i, " ".join(f"Wort{(i * j * 7) % (5 + i % 90)}" for j in range(i % 60))) for i in range(200)]
    rows += [(300, "Ärger MIT Ümlaut x2 ÀB,cd-ef_gh " * 9), (301, "long " * 40000), (302, ""), (303, None), (304, "?! .. \x00"), (None, "null id " * 15),
             (None, "another null id " * 15), (305, "tie " * 30), (305, "tie " * 30), (-9, "a b c " * 10)]
    target = ["Wort3 Wort4 wort5", None, "", "ärger mit", "tie tie"]
    wanted = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = resample.resample(docs_of(rows), wanted, head_words=head, head_pairs=head, counted=40).collect()
    assert shown([r.doc_id, r.n_features, r.weight, r.score, r["rank"], r.n_words] for r in got) == shown(plain(rows, target))


def test_head_is_bounded_and_holds_exact_states(spark):
    texts = spark.createDataFrame([("The cat and the cat. " * 50,), ("the dog",), (None,)], "text string")
    head = resample.frequent(texts, head_words=2, head_pairs=1)
    assert head.states == {b"the": zlib.crc32(b"the "), b"cat": zlib.crc32(b"cat ")}
    assert head.pairs == {(b"the", b"cat"): zlib.crc32(b"the cat") % 10000}


def test_empty_sides(spark, docs_of):
    rows = [(i, f"some words of text {i} " * 8) for i in range(9)]
    none = spark.createDataFrame([], "text string")
    got = resample.resample(docs_of(rows), none).collect()
    assert shown([r.doc_id, r.n_features, r.weight, r.score, r["rank"], r.n_words] for r in got) == shown(plain(rows, []))
    assert resample.resample(docs_of(rows).limit(0), none).collect() == []
    nulls = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [(r.n_features, r.weight, r["rank"]) for r in resample.resample(nulls, none).collect()] == [(0, 0, None)]


def test_words_of_a_slice_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    from ledgerloom.llm.textops import batches
    column = pa.array([" ".join(f"wort{i * j % 9973}" for j in range(400)) for i in range(2500)])
    head = resample.Head({}, {})
    tracemalloc.start()
    for _, _, batch in batches(column, limit=resample.SLICE_BYTES):
        resample.feature_buckets(resample.Words(batch), head, resample.BUCKETS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert column.nbytes > 8 << 20 and peak < 40 << 20
