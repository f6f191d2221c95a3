import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import catalog, langid, lm, quality, toxicity
from ledgerloom.llm.textops import TextBatch


def batch(texts, lower=True):
    return TextBatch.of(pa.array(texts, pa.string()), lower)


# ------------------------------------------------------------------ byte work

@pytest.mark.parametrize("texts", [["a b  c", "", " x ", None, "é\tü\n\nz"], [], [""], [None, None]])
def test_words_and_hashes(texts):
    b = batch(texts)
    starts, ends, first = b.words()
    got = [b.data[s:e].tobytes().decode() for s, e in zip(starts, ends)]
    want = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    assert got == [w for ws in want for w in ws]
    assert np.diff(first).tolist() == [len(w) for w in want]
    h = b.span_hashes(starts, ends)
    assert len(set(h.tolist())) == len(set(got))
    alone = batch(["é x é"])
    assert len(set(alone.span_hashes(*alone.words()[:2]).tolist())) == 2


# ------------------------------------------------------------------ language

def test_language_held_out_accuracy(spark, sf01):
    out = catalog.queries()["op7_langid"](spark, sf01).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in out if r.held_out]
    assert len(out) == len(lang) and held
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in out)
    assert sum(r.rejected for r in out) <= 0.01 * len(out)


def test_language_defined_cases(spark, docs_of):
    base = [(i, f"the thing that was {i}" if i % 2 else f"les choses étaient là {i}", "en" if i % 2 else "fr", "s") for i in range(120)]
    docs = docs_of([*base, (500, None), (501, ""), (502, "123 !!"), (None, "the thing"), (504, "日本"), (505, "the thing " * 20000), (506, "les choses", None, None)])
    model = langid.train(docs)
    assert model.languages == ["en", "fr"]
    out = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(out) == 127
    for k in (500, 501, 502):
        assert (out[k].lang_pred, out[k].score, out[k].rejected) == ("und", 0.0, True)
    assert out[None].lang_pred == "en" and out[505].lang_pred == "en" and out[506].lang_pred == "fr" and out[504].lang_pred in ("en", "fr")
    empty = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    one = langid.train(docs.filter("lang = 'en'"))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs.filter("doc_id < 3"), one).collect()} == {("en", 1.0)}


def test_table_is_the_averaged_embedding():
    """Mean of folded rows equals the linear layer on the mean: a text's score does not depend on batching."""
    texts = ["the cat " * 5, "le chat là", "x"]
    model = langid.fit([f for t in texts for f in langid.bucket_counts(batch([t]))] * 30, ["en", "fr", "en"] * 30)
    together = langid.predict(model, pa.array(texts), batch(texts))[1]
    alone = [langid.predict(model, pa.array([t]), batch([t]))[1][0] for t in texts]
    assert np.allclose(together, alone)


# ------------------------------------------------------------------ toxicity

INSULTS = ["scumbag", "nitwit", "moron"]


def bag(i, toxic):
    rng = random.Random(i)
    words = [rng.choice("alpha beta gamma delta house river stone cloud window paper".split()) for _ in range(60)]
    for k in range(5, 60, 9):
        words[k] += rng.choice(".!?\n")
    if toxic:
        for _ in range(2):
            words[rng.randrange(60)] = rng.choice(INSULTS)
    return " ".join(words)


def test_toxicity_learns_and_locates(spark, docs_of):
    rows = [(i, bag(i, i % 4 == 0), "en", "s") for i in range(600)]
    docs = docs_of([*rows, (900, None), (901, ""), (902, "moron " * 30000), (None, "You moron. Fine day."), (903, rows[0][1]), (903, rows[0][1])])
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(400)] + [(901, 5, "x"), (None, 1, "x"), (77777, 1, "x")], "doc_id long, toxic int, score string")
    model = toxicity.train(docs.filter("doc_id < 400"), labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 606
    by = {r.doc_id: r for r in out}
    right = [(by[i].score >= 0.5) == (i % 4 == 0) for i in range(400, 600)]
    assert np.mean(right) >= 0.97
    assert by[902].score >= 0.5 and by[None].score > by[900].score
    assert by[900].score == by[901].score < 0.5 and by[900].worst_start is None
    assert (by[None].worst_start, by[None].worst_end) == (0, 9)
    text = {r[0]: r[1] for r in rows}
    for i in range(400, 600, 4):
        assert any(w in text[i][by[i].worst_start:by[i].worst_end] for w in INSULTS)
    flat = toxicity.train(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, flat).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_query_held_out(spark, sf01):
    out = catalog.queries()["op10_toxicity"](spark, sf01).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    assert len(out) == spark.read.parquet(f"{sf01}/documents.parquet").count()
    rows = [(r.score, label[r.doc_id]) for r in out if r.held_out and label.get(r.doc_id) is not None]
    toxic, clean = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean]) >= 0.9
    assert np.mean([s >= 0.5 for s in clean]) <= 0.02


# ------------------------------------------------------------------ quality

def test_quality_on_given_labels(spark, sf01):
    out = {r.doc_id: r for r in catalog.queries()["op2_quality"](spark, sf01).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf01}/labels.parquet").collect() if r.doc_id in out]
    assert np.mean([out[k].kept for k, v in labels if v == 1]) >= 0.99
    assert np.mean([out[k].kept for k, v in labels if v == 0]) <= 0.2


def plain_posterior(p, host, path, rate):
    """Hierarchical shrinkage in plain Python: (posterior log odds of the path's rate) per document."""
    def strength(groups):
        total = sum(n for n, _, _ in groups)
        v = sum(n * r * (1 - r) for n, _, r in groups) / total
        spread = sum(n * (g / n - r) ** 2 for n, g, r in groups)
        free = max(len(groups) - 1, 1)
        extra = (spread - v * free) / max(v * (total - sum(n * n for n, _, _ in groups) / total - free), 1e-9)
        s = quality.MOST_STRENGTH if extra <= 1 / quality.MOST_STRENGTH else 1 / min(extra, 1.0) - 1
        return max(min(s, quality.MOST_STRENGTH), quality.LEAST_STRENGTH)
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for x, h, q in zip(p, host, path):
        hosts[h].append(x)
        paths[h, q].append(x)
    hs = strength([(len(v), sum(v), rate) for v in hosts.values()])
    host_rate = {h: (sum(v) + hs * rate) / (len(v) + hs) for h, v in hosts.items()}
    ps = strength([(len(v), sum(v), host_rate[k[0]]) for k, v in paths.items()])
    out = []
    for x, h, q in zip(p, host, path):
        hr = (sum(hosts[h]) - x + hs * rate) / (len(hosts[h]) - 1 + hs)
        pr = (sum(paths[h, q]) - x + ps * hr) / (len(paths[h, q]) - 1 + ps)
        out.append((hr, pr))
    return out


def test_quality_shrinkage_matches_plain_python(spark, docs_of):
    rng = random.Random(1)
    def text(good):
        return " ".join(rng.choice("alpha beta gamma delta".split()) + ("" if good else "###") for _ in range(30))
    rows = []
    for i in range(400):
        host = ["big", "big", "junk", None][i % 4] if i < 390 else f"rare{i}"
        good = rng.random() < (0.2 if host == "junk" else 0.9)
        rows.append((i, text(good), "en" if i % 3 else None, host))
    docs = docs_of([*rows, (800, None, "en", "big"), (801, "", None, None), (None, "alpha beta", "fr", "big"), (5, rows[5][1], rows[5][2], rows[5][3])])
    labels = spark.createDataFrame([(i, 0 if "###" in rows[i][1] else 1) for i in range(0, 400, 2)] + [(801, 7), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.classify(docs, model, F.col("source"), F.col("lang")).collect()
    assert len(out) == 404
    p = [1 / (1 + math.exp(-(r._evidence + math.log(model.rate / (1 - model.rate))))) for r in out]
    want = plain_posterior(p, [r.source for r in out], [r.lang for r in out], model.rate)
    for r, (hr, pr) in zip(out, want):
        assert math.isclose(r._host_rate, min(max(hr, 1e-6), 1 - 1e-6), rel_tol=1e-9)
        assert math.isclose(r._path_rate, min(max(pr, 1e-6), 1 - 1e-6), rel_tol=1e-9)
    assert np.mean([r._kept == ("###" not in r.text) for r in out if r.doc_id is not None and r.doc_id < 400]) >= 0.98
    even = quality.train(docs, labels.filter("quality = 1"))
    assert all(r._kept and r._quality == 0.5 for r in quality.classify(docs.filter("doc_id < 9"), even, F.col("source"), F.col("lang")).collect())
    assert quality.classify(docs.limit(0), model, F.col("source"), F.col("lang")).count() == 0


# ------------------------------------------------------------------ language model

def brute_kneser_ney(train, score):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(low)) if w] + ["</s>"]
    one, two, seen = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        z = cut(t)
        one.update(z)
        for a, b in zip(["<s>"] + z, z):
            two[a, b] += 1
            seen[a] += 1
    n, v = sum(one.values()), len(one)
    left = collections.Counter(b for _, b in two)
    disc = lambda c: lm.discounts_of([sum(x == k for x in c) for k in (1, 2, 3, 4)])
    d2, d1 = disc(two.values()), disc(left.values())
    less = lambda c, d: 0 if c == 0 else d[min(c, 3) - 1]
    freed = collections.Counter()
    for (a, _), c in two.items():
        freed[a] += less(c, d2)
    gamma = sum(less(c, d1) for c in left.values()) / len(two) if two else 1.0

    def low_p(w):
        return (left[w] - less(left[w], d1)) / max(1, len(two)) + gamma / (v + 1)

    def p(a, w):
        if not seen[a]:
            return low_p(w)
        return (two[a, w] - less(two[a, w], d2)) / seen[a] + freed[a] / seen[a] * low_p(w)

    out = []
    for t in score:
        z = cut(t)
        out.append((len(z), sum(one[w] > 0 for w in z), sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in z),
                    sum(math.log10(p(a, w)) for a, w in zip(["<s>"] + z, z))))
    words = [*one, "unseen word"]
    assert math.isclose(sum(p("the", w) for w in words), 1) and math.isclose(sum(low_p(w) for w in words), 1)
    return n, out


def test_lm_matches_brute_force(spark, docs_of):
    rng = random.Random(4)
    words = ["the", "The", "a", "b", "CC", "é", "x1", *[f"w{i}" for i in range(300)]]
    texts = [" ".join(rng.choices(words, [200, 50, 80, 40, 20, 10, 5] + [1] * 300, k=rng.randrange(0, 60))) for _ in range(300)]
    texts += [None, "", "   \n", "the " * 3000, "zzz qqq the", "the a " * 300]
    docs = docs_of(list(enumerate(texts)) + [(None, "the lost"), (3, texts[3])])
    model = lm.train(docs.filter("doc_id % 10 <> 0").repartition(5))
    assert len(model.layout.hot)  # a frequent context is spread over shards
    rows = docs.select("doc_id", "text").collect()
    n, want = brute_kneser_ney([r.text for r in rows if r.doc_id is not None and r.doc_id % 10], [r.text for r in rows])
    got = lm.score(docs.select("doc_id", "text"), model).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    want = sorted(((r.doc_id, *w) for r, w in zip(rows, want)), key=key)
    assert model.tokens == n and len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9) and math.isclose(a[4], b[4], rel_tol=1e-9)


def test_lm_large_counts_and_no_training(spark, docs_of):
    docs = docs_of([(i, "a a a b") for i in range(400)])
    model = lm.train(docs)
    r = lm.score(docs_of([(1, "a b c")]), model).first()
    assert r.n_known == 3 and r.score < 0
    none = lm.train(docs.limit(0))
    assert (none.tokens, none.words) == (0, 0)
    r = lm.score(docs_of([(1, "a b c")]), none).first()
    assert r.score == 0 and r.base_score == 0 and r.n_known == 0
    assert lm.score(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        lm.mounted(spark, "hdfs://host/folder")


def test_lm_beats_base_on_held_out(spark, sf01):
    out = catalog.queries()["op5_lm"](spark, sf01).collect()
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert len(out) == 1000 and len({r.train_tokens for r in out}) == 1


# ------------------------------------------------------------------ scores against plain versions

TEXTS = ["The Cat sat, on the mat!", "é à", "", "12 34", "a", "Der Hund. Die Katze? Ja", "long " * 300, "mixed\tWORDS\nand lines"]


def test_language_scores_are_the_plain_average(spark, sf01):
    from ledgerloom.llm import langid
    model = langid.train(spark.read.parquet(f"{sf01}/documents.parquet"))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    for i, text in enumerate(TEXTS):
        data = bytes(langid._CLEAN[b] for b in bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
        rows = []
        for size in langid.GRAMS:
            for at in range(len(data) - size + 1):
                gram, code = data[at:at + size], size
                if all(b == 0x20 for b in gram):
                    continue
                for b in gram:
                    code = (code * 0x01000193 & 0xFFFFFFFF) ^ b
                rows.append(model.table[(code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - langid.BUCKET_BITS)].astype(float))
        if not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        z = sum(rows) / len(rows) / model.temperature if rows else np.zeros(len(model.languages))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i].lang_pred == model.languages[int(p.argmax())] and got[i].score == pytest.approx(p.max(), abs=1e-5)


def test_toxicity_scores_are_the_plain_noisy_or(spark, sf01):
    from ledgerloom.llm import toxicity
    from ledgerloom.llm.textops import TextBatch
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf01}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.limit(30).collect()] + [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    hashed = lambda w: int(TextBatch(np.frombuffer(w, np.uint8), np.array([0, len(w)])).span_hashes(np.array([0]), np.array([len(w)]))[0]) >> (64 - toxicity.BUCKET_BITS)
    for doc_id, text in rows:
        data = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
        sentences, words, word = [], [], b""
        for b in [*data, None]:
            inside = b is not None and toxicity._WORD[b] not in (0x20, *range(9, 14))
            if inside:
                word += bytes([toxicity._WORD[b]])
                continue
            words, word = (words + [word] if word else words), b""
            if b is None or toxicity._BREAK[b]:
                sentences, words = (sentences + [words] if words else sentences), []
        clean = 1.0
        for s in sentences:
            features = [hashed(w) for w in s] + [hashed(w[:n]) for n in toxicity.PREFIXES for w in s if len(w) > n]
            clean *= 1 - 1 / (1 + np.exp(-(sum(model.weights[f] for f in features) + model.bias)))
        odds = np.log(max(1 - clean, 1e-9)) - np.log(clean)
        assert got[doc_id].n_sentences == len(sentences)
        assert got[doc_id].score == pytest.approx(1 / (1 + np.exp(-(model.slope * odds + model.shift))), abs=1e-4)
