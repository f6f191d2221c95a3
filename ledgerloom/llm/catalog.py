"""Registered queries of the package: one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import ann, bpe, centroids, fingerprint, langid, lm, mixing, ngram_join, oracles, quality, resample, sharding, token_counts, toxicity
from ledgerloom.llm.columns import crc_mod, pick, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> bpe.Vocabulary:
    """The production vocabulary and its pattern (public files, read on the driver)."""
    import public_tokenizers
    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and the bytes decoded from them, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text: its own evidence and the shrunken rates of its source and section."""
    docs = pick(table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string", "lang": "string", "source": "string"})
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return (quality.classify(docs, model, F.col("source"), F.col("lang"), carry=["doc_id", "source", "lang"])
            .withColumnsRenamed({"_evidence": "evidence", "_host_rate": "host_rate", "_path_rate": "path_rate", "_quality": "quality", "_kept": "kept"}))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot of every document's block in the mix of sources at tempered weights."""
    docs = pick(table(spark, sf_dir, "documents"), {"doc_id": "long", "lang": "string", "source": "string", "n_chars": "long"})
    return (mixing.mix(docs, most_sources=None).withColumnRenamed("_slot", "slot").withColumnRenamed("_start", "chars_before").drop("lang"))


@query
def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors by cosine of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


@query
def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text; documents whose id hashes to 0 of 10 are never learned."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(True))
    model = lm.train(docs.filter(~held_out))
    rows = pick(docs, {"doc_id": "long", "text": "string"}).withColumn("held_out", held_out)
    return (lm.score(rows, model, keep=("doc_id", "held_out"))
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"))


@query
def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every whole text and of its edited text, and how alike they are."""
    return fingerprint.edit_report(table(spark, sf_dir, "documents"))


@query
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text; documents whose id hashes to 1 of 3 are never learned."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(True))
    model = langid.train(docs.filter(~held_out))
    rows = pick(docs, {"doc_id": "long", "text": "string"}).withColumn("held_out", held_out)
    return langid.identify(rows, model, keep=("doc_id", "held_out"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by encoded length, with the sums that answer every context limit."""
    return token_counts.histogram(bpe.token_lengths(table(spark, sf_dir, "documents"), vocabulary()))


@query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; documents whose id hashes to 0 of 5 are never learned."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(True))
    model = toxicity.train(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    return (toxicity.score(docs, model)
            .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                    "n_sentences", "worst_start", "worst_end", "worst_score"))


@query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document: equal row counts, equal texts together."""
    return sharding.shard_texts(table(spark, sf_dir, "documents"))


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, squared distance and centroid digest of every vector of 64 components."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@query
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and draw of every document towards the benchmark's word features."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op12_centroids"] = oracles.centroids()
ORACLE["op13_resample"] = oracles.RESAMPLE


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
