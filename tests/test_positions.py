from pyspark.sql import functions as F

from ledgerloom.operators.positions import with_position


def test_positions_are_the_sorted_ranks(spark):
    rows = spark.range(0, 5000, 1, 16).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("t"))
    got = sorted(with_position(rows, F.col("t").asc_nulls_last(), F.col("v").desc(), F.col("k")).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(5000))
    want = sorted(rows.collect(), key=lambda r: (r.t is None, r.t or "", -r.v, r.k))
    assert [r.k for r in got] == [r.k for r in want]


def test_positions_defined_cases(spark):
    rows = spark.createDataFrame([(None, "a"), (1, None), (1, None), (2, "b")], "k long, position string")
    assert sorted(r.n for r in with_position(rows, F.col("k"), out="n").collect()) == [0, 1, 2, 3]
    assert sorted(r.n for r in with_position(rows, out="n").collect()) == [0, 1, 2, 3]
    assert with_position(rows.limit(0), F.col("k"), out="n").collect() == []
