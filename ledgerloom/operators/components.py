"""Connected components of an undirected edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds that the search may take (each at least halves the longest path).
ROUNDS = 60


def components(edges: DataFrame, base: str, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the least node that it is joined to.

    Large-star and small-star steps: each round sends every node's larger neighbours to its least
    one, then its smaller ones too, until nothing changes.  Each step partially aggregates by node, so
    a node of very many edges costs its edges once; the edges of each round are a written table
    under ``base`` (a shared folder)."""
    spark = edges.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = written(now, "edges")
    for number in range(rounds):
        each_way = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
        both = state.select(each_way).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # sorted joins: a broadcast in every round would pass through the driver
        large = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(least.hint("merge"), "a").select(F.explode(pair).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        state = written(small, f"edges-{number}")
        # one star per component exactly when no root is itself a member and no member has two roots
        sides = F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("member"), F.lit(0).alias("root")),
                                  F.struct(F.col("b").alias("x"), F.lit(0).alias("member"), F.lit(1).alias("root")))).alias("s")
        roles = state.select(sides).groupBy("s.x").agg(F.sum("s.member").alias("member"), F.max("s.root").alias("root"))
        if not roles.agg(F.max((F.col("member") + F.col("root")) > 1)).first()[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
