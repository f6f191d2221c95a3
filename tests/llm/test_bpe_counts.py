import base64
import hashlib

import numpy as np
import pytest
import tiktoken

from ledgerloom.llm import bpe, token_counts
from ledgerloom.llm.catalog import vocabulary


@pytest.fixture(scope="module")
def vocab():
    return vocabulary()


@pytest.fixture(scope="module")
def reference(vocab):
    ranks = dict(zip(vocab.keys, vocab.ids.tolist()))
    return tiktoken.Encoding("own", pat_str=vocab.pattern, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_perfect(vocab):
    h = vocab.hash
    found = h.find(vocab.keys)
    assert (found == np.arange(len(vocab.keys))).all()
    assert sorted(h.at.tolist()) == list(range(len(vocab.keys)))
    strange = [b"", b"qqzzqq", b"\xff\xfe"]
    assert all(at < 0 or vocab.keys[at] != k or k in vocab.keys for at, k in zip(h.find(strange), strange))


@pytest.mark.parametrize("text", ["", " ", "a", "aaaa" * 5000, "hello  world\n\n x", "ñandú 日本語 🙂🙂", "'s don't WE'LL 123456 \t\r\n", "<|endoftext|>", "\u0000x y",
                                  "é" * 3000 + " " * 3000])
def test_encode_and_decode_match_the_library(vocab, reference, text):
    e = bpe.Encoder(vocab)
    ids, begin = e.encode([text, "", text])
    want = reference.encode_ordinary(text)
    assert ids[begin[0]:begin[1]].tolist() == want and ids[begin[2]:begin[3]].tolist() == want and begin[1] == begin[2]
    back, at = e.decode(ids[:begin[1]])
    assert back.tobytes() == text.encode()


def test_merge_takes_the_lowest_rank_leftmost_first():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4}
    assert bpe.merge(b"aaab", ranks) == [2, 3]
    assert bpe.merge(b"aaa", ranks) == [2, 0]


def test_store_is_bounded_and_refilled(vocab, reference, monkeypatch):
    monkeypatch.setattr(bpe, "STORE_ENTRIES", 3)
    e = bpe.Encoder(vocab)
    for text in ("one two three four five", "six seven eight nine", "one two ten"):
        ids, _ = e.encode([text])
        assert ids.tolist() == reference.encode_ordinary(text)


def test_query_digests(spark, docs_of, vocab, reference):
    texts = {1: "Plain words, again and again.", 2: None, 3: "", 4: "x" * 40000 + " tail", 5: "Plain words, again and again."}
    docs = docs_of([(k, v) for k, v in texts.items()] + [(5, texts[5]), (None, "no id")])
    out = bpe.digests(docs, vocab).collect()
    assert len(out) == 7 and sum(r.doc_id == 5 for r in out) == 2
    for r in out:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(docs.limit(0), vocab).count() == 0


def test_round_trip_of_ids(spark, docs_of, vocab):
    docs = docs_of([(1, "Ça va? 日本 🙂"), (2, None)])
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, vocab), vocab).collect()}
    assert back == {1: "Ça va? 日本 🙂", 2: ""}


def test_rank_file_reader(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    v = bpe.Vocabulary.load(str(path), r"\S+|\s+")
    assert bpe.Encoder(v).encode(["ab"])[0].tolist() == [97, 98]


def test_histogram_and_limits(spark):
    lengths = [0, 0, 3, 3, 3, 7, 5000, 5000, 123456]
    df = spark.createDataFrame([(x, "c") for x in lengths], "n_tokens long, range string")
    hist = token_counts.histogram(df)
    rows = {r.n_tokens: r for r in hist.collect()}
    assert set(rows) == set(lengths)
    for limit, r in rows.items():
        assert r.n_docs == lengths.count(limit)
        assert r.docs_above == sum(x > limit for x in lengths) and r.tokens_above == sum(x for x in lengths if x > limit)
        assert r.docs_upto + r.docs_above == r.total_docs == len(lengths)
        assert r.truncated_tokens == sum(min(x, limit) for x in lengths)
    limits = spark.createDataFrame([(x,) for x in (0, 1, 3, 4096, 200000)], "limit long")
    for r in token_counts.at_limits(hist, limits).collect():
        assert r.truncated_tokens == sum(min(x, r.limit) for x in lengths) and r.docs_above == sum(x > r.limit for x in lengths)
    for q in (0.1, 0.5, 0.9, 1.0):
        k = int(np.ceil(q * len(lengths))) - 1
        assert token_counts.quantile(hist, q).first().n_tokens == sorted(lengths)[k]
    assert token_counts.histogram(df.limit(0)).count() == 0
    assert token_counts.at_limits(token_counts.histogram(df.filter("n_tokens > 3")), limits.filter("limit = 3")).first().truncated_tokens == 12
