import collections
import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import fingerprint, mixing


def schedule(share, blocks):
    """Plain earliest-deadline-first with a new plan whenever a source runs out."""
    done, at, slot, worst = dict.fromkeys(blocks, 0), 0, {}, 0.0
    while any(done[k] < blocks[k] for k in blocks):
        active = sorted(k for k in blocks if done[k] < blocks[k])
        period = sum(share[k] for k in active)
        had, t = dict.fromkeys(active, 0), 0
        while all(done[k] + had[k] < blocks[k] for k in active):
            ready = [k for k in active if had[k] * period // share[k] <= t]
            k = min(ready, key=lambda k: (-(-(had[k] + 1) * period // share[k]), k))
            slot[k, done[k] + had[k]] = at + t
            had[k] += 1
            t += 1
            worst = max(worst, max(abs(had[k] - share[k] * t / period) for k in active))
        for k in active:
            done[k] += had[k]
        at += t
    return slot, worst


@pytest.mark.parametrize("targets", [None, {"hot": 5, "a": 3, "b": 1.5}])
def test_mix_is_the_edf_schedule(spark, targets):
    rows = [(i, None if i % 17 == 0 else ["a", "b", "hot", "hot", "c"][i % 5], (i * 37) % 90, "t") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_chars long, blocks string").withColumn("share", F.lit("x"))
    out = mixing.mix(docs, targets=targets, block_chars=500, quanta=50).collect()
    assert len(out) == len(rows)
    totals, share = collections.Counter(), {}
    for r in out:
        totals[r.source or ""] += r.n_chars
        share[r.source or ""] = r.share
    slot, worst = schedule(share, {k: max(1, -(-v // 500)) for k, v in totals.items()})
    assert worst < 1
    assert all(r._slot == slot[r.source or "", r.block] for r in out)
    starts = collections.Counter()
    for r in sorted(out, key=lambda r: r.doc_id):
        assert r._start == starts[r.source or ""]
        starts[r.source or ""] += r.n_chars
    sorted_rows = mixing.mixed(docs, targets=targets, block_chars=500, quanta=50)
    assert sorted_rows.columns == docs.columns and {r.share for r in sorted_rows.collect()} == {"x"}
    order = [r.doc_id for r in sorted_rows.collect()]
    assert order == [r.doc_id for r in sorted(out, key=lambda r: (r._slot, r._start, r.doc_id))]


def test_mix_defined_cases(spark):
    schema = "doc_id long, source string, n_chars long"
    odd = spark.createDataFrame([(None, "a", 5), (1, None, None), (2, "a", -3), (2, "a", -3), (-(1 << 60), "a", 4)], schema)
    out = mixing.mix(odd, block_chars=4).collect()
    assert len(out) == 5 and all(r._slot is not None for r in out)
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mixed(odd).columns == ["doc_id", "source", "n_chars"]
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    with pytest.raises(ValueError):
        mixing.mix(many)


def test_mix_keeps_the_given_targets_over_many_slots(spark):
    targets = {"a": 0.9992, "b": 0.0004, "c": 0.0004}
    rows = [(i, "a" if i < 8992 else "bc"[i % 2], 10) for i in range(9000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, n_chars long"), targets=targets, block_chars=10).collect()
    had = collections.Counter()
    for t, r in enumerate(sorted(out, key=lambda r: r._slot), 1):
        assert r._slot == t - 1
        had[r.source] += 1
        if t <= 7500:  # before any source runs out
            assert all(abs(had[k] - w * t) < 1 + 2 ** -20 for k, w in targets.items())


def test_queries_mix_any_number_of_sources(spark, tmp_path):
    from corpus_pipeline import mixed
    from ledgerloom.llm import catalog
    rows = [(i, "t", "en", f"host{i % 600}", 100_000 + 7 * (i % 600)) for i in range(2400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = catalog.queries()["op3_mixing"](spark, str(tmp_path)).collect()
    share = {r.source: r.share for r in out}
    slot, worst = schedule(share, collections.Counter({k: -(-4 * (100_000 + 7 * int(k[4:])) // mixing.BLOCK_CHARS) for k in share}))
    assert len(out) == 2400 and len(share) == 600 and worst < 1
    assert all(r.slot == slot[r.source, r.block] for r in out)
    order = [r.doc_id for r in mixed(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()]
    assert order == [r.doc_id for r in sorted(out, key=lambda r: (r.slot, r.chars_before, r.doc_id))]


def test_plan_is_the_edf_schedule():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 30)
        share = {k: rng.choice([1, 2, 3, rng.randrange(1, 1000)]) for k in range(n)}
        blocks = {k: rng.choice([1, 1, rng.randrange(1, 60)]) for k in range(n)}
        slot, _ = schedule(share, blocks)
        got, _ = mixing.schedule(list(share.values()), list(blocks.values()))
        assert {(k, c): x for k in range(n) for c, x in enumerate(got[k])} == slot


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _step(value, seed):
    return xxhash.xxh64(struct.pack("<q", value), seed=seed & (1 << 64) - 1).intdigest()


def sketch(text):
    words = [_signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    hashes = []
    if len(words) >= 5:
        for i in range(len(words) - 4):
            h = 42
            for w in words[i:i + 5]:
                h = _step(w, h)
            hashes.append(h)
    elif words:
        a = 0
        for w in words:
            a = _signed(_step(w, _step(a, 42)))
        hashes = [a & (1 << 64) - 1]
    kept = sorted({h for h in hashes if h >> 61 == 0})
    return kept or ([min(map(_signed, hashes)) & (1 << 64) - 1] if hashes else [])


def alike(a, b):
    return 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))


def check_report(docs):
    out = fingerprint.edit_report(docs).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect() if r.doc_id is not None), key=lambda r: (-r[0], r[1]))
    want = collections.Counter()
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        a, b, c = map(sketch, (text, edited, following))
        want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:016x}" for x in a), "".join(f"{x:016x}" for x in b),
             round(alike(a, b), 9), round(alike(a, c), 9)] += 1
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
                              for r in out if r.doc_id is not None)
    assert got == want
    return out


def test_fingerprints_match_brute_force(spark, docs_of):
    words = "the red fox jumps over a lazy dog while it rains in Ünderland today".split()
    rows = [(i * 97 % 1009 * 1000 ** (i % 3), " ".join(words[(i + j * j) % 13] for j in range(i % 40))) for i in range(120)]
    rows += [(7, "same id  one"), (7, "same id two"), (7, "same id two"), (-5, None), (1 << 62, "x"), (-(1 << 62), "Some 日本語 🙂 text here  too")]
    out = check_report(docs_of([*rows, (None, "lost one two three four five six")]))
    assert len(out) == 127
    lost = [r for r in out if r.doc_id is None]
    assert len(lost) == 1 and lost[0].near_next == 0.0


@pytest.mark.parametrize("rows", [[], [(3, "only one document of some words here")], [(1, ""), (2, None)]])
def test_fingerprint_small_tables(spark, docs_of, rows):
    out = check_report(docs_of(rows))
    assert len(out) == len(rows)


def test_sketches_merge(spark):
    text = " ".join(f"w{i}" for i in range(400))
    parts = spark.createDataFrame([(text, " ".join(text.split()[:200]), " ".join(text.split()[196:]))], "a string, b string, c string")
    for c in "abc":
        parts = fingerprint.with_sketch(parts, c, f"s{c}")
    r = parts.select((fingerprint.merged(F.col("sb"), F.col("sc")) == F.col("sa")).alias("same"),
                     fingerprint.containment(F.col("sb"), F.col("sa")).alias("inside")).first()
    assert r.same and r.inside == 1.0


def test_native_plans_hold_no_python(spark, docs_of):
    docs = docs_of([(1, "a b c", "en", "s")])
    for df in (fingerprint.edit_report(docs), mixing.mixed(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
