"""Token counts by an exact length histogram with suffix sums.

Documents are encoded (byte-level BPE of the package) and aggregated by their number of tokens, the
only shuffle and as small as the number of distinct lengths.  Suffix sums over lengths then answer,
for every context limit, how many documents and tokens lie above it and how many tokens remain when
each document is cut at the limit; prefix counts answer quantiles.  Nothing is sampled or bucketed.

Lengths are summed within ranges of ``2 ** RANGE_BITS`` lengths and ranges among themselves, so one
task holds a range, or one row per range.

Defined cases: null and empty texts have length 0 and count as documents; repeated rows count
repeatedly; an empty table gives an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.columns import pick
from ledgerloom.session import cut_lineage

RANGE_BITS = 12


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """n_tokens, n_docs and, for that length L as context limit:

    docs_above, tokens_above (documents longer than L), docs_upto, tokens_upto (L or shorter),
    truncated_tokens (all documents cut at L), total_docs, total_tokens.
    """
    counts = pick(lengths, {column: "long"}).groupBy(F.col(column).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    counts = cut_lineage(counts)  # one row per distinct length: the texts are encoded once
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("range", F.shiftright("n_tokens", RANGE_BITS))
    ranges = counts.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    ranges = ranges.select("range", F.coalesce(F.sum("d").over(later), zero).alias("d_later"), F.coalesce(F.sum("t").over(later), zero).alias("t_later"),
                           F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("range").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = (counts.withColumn("d_in", F.coalesce(F.sum("n_docs").over(inside), zero)).withColumn("t_in", F.coalesce(F.sum("tokens").over(inside), zero))
              .join(ranges, "range"))
    docs_above, tokens_above = F.col("d_in") + F.col("d_later"), F.col("t_in") + F.col("t_later")
    return counts.select(
        "n_tokens", "n_docs", docs_above.alias("docs_above"), tokens_above.alias("tokens_above"),
        (F.col("total_docs") - docs_above).alias("docs_upto"), (F.col("total_tokens") - tokens_above).alias("tokens_upto"),
        (F.col("total_tokens") - tokens_above + docs_above * F.col("n_tokens")).alias("truncated_tokens"), "total_docs", "total_tokens")


def at_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """limit, docs_above, tokens_above, truncated_tokens for any context limits (column ``limit``).

    The answers are read from the suffix sums of the longest length that is at most the limit.
    """
    marks = histogram.select(F.col("n_tokens").alias("at"), F.lit(0).alias("ask"), "docs_above", "tokens_above", "total_tokens")
    asks = pick(limits, {"limit": "long"}).distinct().select(F.col("limit").alias("at"), F.lit(1).alias("ask"))
    both = marks.unionByName(asks, allowMissingColumns=True)
    order = Window.orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    totals = histogram.agg(F.max("total_tokens").alias("t"), F.max("total_docs").alias("d"))
    both = both.select("at", "ask", *[F.last(c, ignorenulls=True).over(order).alias(c) for c in ("docs_above", "tokens_above")]).filter("ask = 1")
    zero = F.lit(0).cast("long")
    total_tokens, total_docs = F.coalesce(totals.select("t").scalar(), zero), F.coalesce(totals.select("d").scalar(), zero)
    docs_above, tokens_above = F.coalesce("docs_above", total_docs), F.coalesce("tokens_above", total_tokens)
    return both.select(F.col("at").alias("limit"), docs_above.alias("docs_above"), tokens_above.alias("tokens_above"),
                       (total_tokens - tokens_above + docs_above * F.col("at")).alias("truncated_tokens"))


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """One row: the least length that at least ``share`` of the documents do not exceed."""
    return histogram.filter(F.col("docs_upto") >= F.ceil(F.lit(float(share)) * F.col("total_docs"))).agg(F.min("n_tokens").alias("n_tokens"))
