"""Nested views and steps over whole tables: how often and how wide rows are shuffled and kept."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from fixtures import SF001
from ledgerloom.operators import fulfilment as FU
from ledgerloom.session import kept
from ledgerloom.sources.tables import from_testdata


def test_pages_deal_their_lines_once_and_without_measures(spark):
    """The measures follow from the line: they are computed behind the last exchange."""
    lines = spark.createDataFrame([(i, i % 3, 7 - i) for i in range(7)], "id long, parent long, k long")
    pages = FU.paged(lines, "parent", ["k", "id"], 10, lambda df: df.withColumn("wide", F.col("k") * 2))
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "wide" not in plan[plan.index("Exchange hashpartitioning"):]
    got = {r["parent"]: [x["id"] for x in r["lines"]] for r in pages.collect()}
    assert got == {0: [6, 3, 0], 1: [4, 1], 2: [5, 2]}


def test_pages_of_short_long_and_null_parents(spark):
    lines = spark.range(40).select("id", F.when(F.col("id") < 25, 1).when(F.col("id") < 30, 2).cast("long").alias("parent"), (100 - F.col("id")).alias("k"))
    got = {(r["parent"], r["page"]): (r["first_line"], [x["id"] for x in r["lines"]]) for r in FU.paged(lines, "parent", ["k", "id"], 10).collect()}
    assert got == {(1, 0): (1, list(range(24, 14, -1))), (1, 1): (11, list(range(14, 4, -1))), (1, 2): (21, [4, 3, 2, 1, 0]),
                   (2, 0): (1, [29, 28, 27, 26, 25]), (None, 0): (1, list(range(39, 29, -1)))}


def test_steps_are_kept_compressed(spark, tmp_path):
    """A checkpoint of these rows holds 16 MB; written as a table they are far smaller, and the same."""
    rows = spark.range(500_000).select("id", F.lit(7).alias("a"), F.lit("text").alias("b"))
    step = kept(rows)
    assert "FileScan parquet" in step._jdf.queryExecution().executedPlan().toString()
    assert step.exceptAll(rows).isEmpty() and step.count() == 500_000
    twice = kept(rows.select("id", "id", F.lit(None).alias("none")))  # no table can hold these
    assert twice.count() == 500_000


def test_a_job_numbers_the_raw_lines_once(spark):
    """Lines and allocations are read from the tables kept for the job, not derived again for every use."""
    for name in ("shipment_header", "shipment_lines", "order_status_apply"):
        plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"lineitem\.parquet", plan), name
    assert from_testdata(spark, SF001)["export_order_items"].count() == E.queries()["line_measures"](spark, SF001).count()


def test_a_few_named_parties_are_not_dealt_with_all_rows(spark):
    """Rows that name few parties of many: only these are kept and broadcast, unnamed ones stay without a party."""
    rows = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("agent_id"))
    parties = spark.range(200_000).select("id", F.concat(F.lit("party "), F.col("id")).alias("name")).repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        got = FU._in_role(rows, parties, "agent_id", "agent", {"name": "name"})
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        names = {r["id"]: r["agent_name"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert names == {i: None if i % 3 == 0 else f"party {i % 2}" for i in range(100)}


def test_status_requests_are_joined_once(spark):
    """What orders hold is not joined again for each of the later steps, nor sorted in one task with them."""
    for name in ("order_status_sequence", "order_status_apply", "order_eligibility"):
        plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "events.parquet" not in plan and "orders.parquet" not in plan, name
