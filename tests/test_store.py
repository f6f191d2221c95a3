import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import store


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def rows_of(spark, path):
    return sorted(map(tuple, store.read(spark, path).collect()), key=str)


def test_writes_touch_only_their_ranges(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "id long, name string, is_active boolean"
    store.create(spark.createDataFrame([(i, f"n{i}", True) for i in range(100)] + [(None, "nobody", True)], schema), path, bits=4)
    want = {i: (i, f"n{i}", True) for i in range(100)}
    before = files(path)
    store.upsert_rows(spark, path, spark.createDataFrame([(3, "up", False), (1000, "new", True)], schema), ["name"], bits=4)
    want[3], want[1000] = (3, "up", True), (1000, "new", True)
    kept = files(path) & before
    assert kept == {f for f in before if "key_range=0" not in f} and len(files(path)) == len(before) + 1
    store.append_rows(spark, path, spark.createDataFrame([(200, "added", True)], schema), bits=4)
    store.insert_absent_rows(spark, path, spark.createDataFrame([(200, "late", True), (201, "first", True), (201, "second", True)], schema), bits=4, order=["name"])
    store.update_rows(spark, path, spark.createDataFrame([(50, "x"), (51, "x")], "id long, name string"), ["name"], bits=4, where=F.col("id") != 51)
    store.soft_delete_rows(spark, path, spark.createDataFrame([(60,), (999_999,)], "id long"), bits=4)
    want |= {200: (200, "added", True), 201: (201, "first", True), 50: (50, "x", True), 60: (60, "n60", False)}
    assert rows_of(spark, path) == sorted([*want.values(), (None, "nobody", True)], key=str)
    assert {f for f in before if "key_range=5" in f} <= files(path)
    # a range that loses all its rows stays empty, and can be filled again
    store.delete_rows(spark, path, spark.range(96, 100), bits=4)
    store.delete_rows(spark, path, spark.createDataFrame([], "id long"), bits=4)
    for i in range(96, 100):
        del want[i]
    assert rows_of(spark, path) == sorted([*want.values(), (None, "nobody", True)], key=str)
    store.append_rows(spark, path, spark.createDataFrame([(97, "back", True)], schema), bits=4)
    assert (97, "back", True) in rows_of(spark, path) and len(rows_of(spark, path)) == len(want) + 2
    with pytest.raises(ValueError):
        store.rewrite(spark, path, spark.range(1), lambda old: old.withColumn("id", F.col("id") + 1000), bits=4)


def test_audit_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "audit")
    events = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00"), (3, None)], "id long, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    store.append_audit(events, path, 1)
    store.append_audit(events.filter("id = 1"), path, "b2")
    first = files(path)
    store.append_audit(events, path, 1)
    assert sorted((r.id, r.batch_id) for r in store.read_audit(spark, path).collect()) == [(1, "1"), (1, "b2"), (2, "1"), (3, "1")]
    assert {f for f in first if "batch_id=b2" in f} <= files(path)
    day = store.read_audit(spark, path, "2024-01-02", "2024-01-02")
    assert [r.id for r in day.collect()] == [2]
    assert len(day.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_an_exchange(spark):
    from ledgerloom.operators.balances import order_balances
    from fixtures import item, ledger, order, payment
    t = ledger(spark, [order(i) for i in range(1, 40)], [item(i, 1 + i % 39, "2", "3") for i in range(200)], [payment(i, 1 + i % 20, "1.50") for i in range(60)])
    stored = store.bucketed(t, {"export_orders": "id", "export_order_items": "export_order_id", "order_payments": "export_order_id"}, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = order_balances(t.replace(**stored))
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, order_balances(t).collect()))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_reads_a_small_share(spark, tmp_path):
    path = str(tmp_path / "lookup")
    store.create_lookup(spark.range(0, 200_000, 1, 8).select((F.col("id") * 3).alias("id"), F.col("id").cast("string").alias("v")), path, rows=20_000)
    df = spark.read.parquet(path).filter("id = 300000")
    assert [r.v for r in df.collect()] == ["100000"]
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    assert leaf.metrics().apply("numOutputRows").value() <= 20_000
    assert spark.read.parquet(path).filter("id = 300001").collect() == []
