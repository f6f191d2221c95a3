"""Document fingerprints: threshold-scaled sketches of word shingles, in SQL functions only.

A sketch keeps every five-word shingle hash whose top ``SCALE_BITS`` bits are zero, a fixed fraction
of all hashes whatever the text's length.  Sketches of parts merge by union, and the share of a
sketch that lies in another estimates containment even between very unequal documents.  A text none
of whose hashes falls below the threshold keeps its least hash instead (after a merge that stand-in
goes if the union has a hash below the threshold, and otherwise the least one stays).

Words are cut at white space (space, tab to carriage return) of the lower-cased text; one to four
words make one shingle.

Defined cases: null text is the empty text, whose sketch is empty; two empty sketches are alike (1),
an empty and a filled one are not (0); equal texts have equal sketches.  Rows sharing a doc_id follow
each other in text order.  A null doc_id has no place in the order: its next document is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.columns import pick
from ledgerloom.session import cut_lineage

SHINGLE_WORDS = 5
#: One hash in 2 ** SCALE_BITS is kept.
SCALE_BITS = 3
#: Documents of one block of ids are put in order together; blocks are linked by their first ones.
BLOCK_BITS = 8
GROUP_BITS = (16, 20)


def _kept(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - SCALE_BITS) == 0


def with_sketch(df: DataFrame, text: str, out: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """Add the sketch of a text column as a sorted array of hashes."""
    w, n, h = f"_{out}_words", f"_{out}_n", f"_{out}_hashes"
    df = df.withColumn(w, F.transform(F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda x: x != ""), lambda x: F.xxhash64(x)))
    df = df.withColumn(n, F.size(w))
    runs = F.transform(F.sequence(F.lit(0), F.col(n) - words), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(words)]))
    short = F.array(F.aggregate(F.col(w), F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
    df = df.withColumn(h, F.when(F.col(n) >= words, runs).when(F.col(n) > 0, short).otherwise(F.expr("cast(array() as array<bigint>)")))
    df = df.withColumn(out, F.sort_array(F.array_distinct(F.filter(h, _kept))))
    df = df.withColumn(out, F.when((F.size(out) == 0) & (F.col(n) > 0), F.array(F.array_min(h))).otherwise(F.col(out)))
    return df.drop(w, n, h)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two parts together."""
    both = F.sort_array(F.array_union(a, b))
    below = F.filter(both, _kept)
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the texts' shingle sets (0 to 1)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 for an empty first."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: Column) -> Column:
    """Sixteen hex digits per hash, in ascending order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def next_lower(keys: DataFrame, bits: tuple[int, ...] = GROUP_BITS) -> DataFrame:
    """(k, lower): for distinct whole numbers ``k`` the next lower one present; null for the least.

    Numbers are ordered within groups of ``2 ** bits[0]`` values, groups within larger groups, so no
    task orders more than a group; the last level has at most 2 ** 20 values for ids of 64 bits.
    """
    if not bits:
        return keys.withColumn("lower", F.lead("k").over(Window.orderBy(F.col("k").desc())))
    grouped = keys.withColumn("g", F.shiftright("k", bits[0]))
    tops = grouped.groupBy("g").agg(F.max("k").alias("top"))
    links = next_lower(tops.select(F.col("g").alias("k")), bits[1:])
    below = (links.join(tops.withColumnRenamed("g", "lower"), "lower").select(F.col("k").alias("g"), "top"))
    within = F.lead("k").over(Window.partitionBy("g").orderBy(F.col("k").desc()))
    return (grouped.withColumn("next", within).join(below, "g", "left")
            .select("k", F.coalesce("next", "top").alias("lower")))


def with_next(docs: DataFrame, sketch: str = "sketch") -> DataFrame:
    """Add next_text and next_sketch: the next document's in descending doc_id order, the first
    document's after the last one.  Texts are shuffled once, by block of ids."""
    placed = docs.filter("doc_id is not null").withColumn("block", F.shiftright("doc_id", BLOCK_BITS))
    order = Window.partitionBy("block").orderBy(F.col("doc_id").desc(), F.col("text"))
    inside = (with_sketch(placed, "text", sketch)
              .withColumn("_next_text", F.lead("text").over(order)).withColumn("_next_sketch", F.lead(sketch).over(order)))
    # First document of each block (greatest id, then least text), by partial aggregation.
    first = placed.groupBy("block").agg(F.min_by("text", F.struct(F.bitwise_not("doc_id"), F.col("text"))).alias("head"))
    blocks = cut_lineage(placed.select(F.col("block").alias("k")).distinct())
    # The least block is followed by the greatest one.
    after = next_lower(blocks).select(F.col("k").alias("block"), F.coalesce("lower", blocks.agg(F.max("k")).scalar()).alias("lower"))
    heads = with_sketch(first.withColumnRenamed("block", "lower").join(after, "lower"), "head", "head_sketch").select("block", "head", "head_sketch")
    joined = inside.join(heads, "block", "left")
    return joined.select("doc_id", "text", sketch, F.coalesce("_next_text", "head").alias("next_text"),
                         F.coalesce("_next_sketch", "head_sketch").alias("next_sketch"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, sketch of every whole text."""
    return with_sketch(pick(docs, {"doc_id": "long", "text": "string"}).withColumn("text", F.coalesce("text", F.lit(""))), "text", "sketch").drop("text")


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text whose second half is replaced by the next one's start."""
    docs = pick(docs, {"doc_id": "long", "text": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    lost = with_sketch(docs.filter("doc_id is null"), "text", "sketch").select(
        "doc_id", "text", "sketch", F.lit("").alias("next_text"), F.expr("cast(array() as array<bigint>)").alias("next_sketch"))
    rows = with_next(docs).unionByName(lost)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(next_text, cast(n_chars div 2 as int)))"))
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in_text"),
        containment(F.col("next_sketch"), F.col("sketch")).alias("next_in_text"))
