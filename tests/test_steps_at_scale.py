"""Steps of jobs over whole tables: what they shuffle, evaluate and leave behind."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from fixtures import SF001
from ledgerloom.operators import admission as G
from ledgerloom.operators import quality as Q
from ledgerloom.operators.running import number_all
from ledgerloom.plans import ingest as I
from ledgerloom.plans.catalog import REQUESTS
from ledgerloom.session import STEP_SETTINGS, kept, path_exists, release
from ledgerloom.sources.changes import changes
from ledgerloom.sources.tables import from_testdata


def _plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def _shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_step_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    name, = STEP_SETTINGS
    was = spark.conf.get(name)
    step = kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert _shuffle_files(spark) <= before
    assert spark.conf.get(name) == was
    assert {r["k"]: r["count"] for r in step.collect()} == {k: len(range(k, 1000, 7)) for k in range(7)}


def test_settings_come_back_after_a_failed_step(spark):
    name, = STEP_SETTINGS
    was = spark.conf.get(name)
    try:
        kept(spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x")))
    except Exception as error:
        assert "no" in str(error)
    assert spark.conf.get(name) == was


def test_a_rule_reads_its_field_once_and_compiles_its_errors(spark):
    rules = [Q.Rule("amount", "number", positive=True, min=2, max=50, dtype="decimal(12,3)"), Q.Rule("name", "text", min_len=2, max_len=4)]
    rows = spark.createDataFrame([(1, " 7 ", " ab "), (2, "x", "a"), (3, None, None), (4, "51", "abcde")], "request_id long, amount string, name string")
    checked = Q.judge(rows.select("*", F.rand().alias("r")).drop("r"), rules, ["request_id"])
    assert _plan(checked, "optimizedPlan").count("regexp_replace") == 2
    # the errors are an array of a projection of its own, below the one that filters it
    assert not re.search(r"filter\(array\(", _plan(checked, "optimizedPlan"))
    got = {r["request_id"]: (r["is_valid"], r["errors"]) for r in checked.collect()}
    assert got[1] == (True, "") and got[2] == (False, "amount:not a number;name:shorter than 2")
    assert got[3][1] == "amount:must be positive;amount:below 2;name:required" and got[4][1] == "amount:above 50;name:longer than 4"


def test_changes_do_not_shuffle_columns_that_are_not_read(spark):
    old = spark.createDataFrame([(1, "a", "wide one")], "id long, n string, w string")
    new = spark.createDataFrame([(1, "a", "other"), (2, None, "more")], "id long, n string, w string")
    found = changes(old, new, ["id"]).select("change", "id", "n")
    plan = _plan(found, "optimizedPlan")
    assert "_new_c1" in plan and "_new_c2" not in plan and "_old_c2" not in plan
    assert sorted(map(tuple, found.collect())) == [("inserted", 2, None), ("updated", 1, "a")]


def test_a_batch_is_numbered_in_small_blocks(spark):
    """Dense ids: no block is more than some thousands of them."""
    rows = spark.range(0, 40000, 1, 4).select(F.col("id").alias("k"))
    numbered = number_all(rows, ["k"], "n")
    assert numbered.filter("n <> k + 1").count() == 0
    assert re.search(r"shiftright\(\w+#\d+L, 14\)", _plan(numbered, "optimizedPlan"))


def test_lost_keys_are_written_before_they_meet_the_children(spark):
    t = {"child": spark.createDataFrame([(1, 5, None), (2, 6, 9), (3, None, 1)], "id long, a long, b long"),
         "parent": spark.createDataFrame([(5,), (1,)], "id long")}
    found = Q.all_orphans(t, [("child.a", "child", "a", "parent", False), ("child.b", "child", "b", "parent", True)])
    plan = _plan(found)
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan
    assert sorted(map(tuple, found.collect()), key=str) == [("child.a", 2, 6), ("child.a", 3, None), ("child.b", 2, 9)]


def test_request_structure_is_counted_in_steps(spark):
    boxes = spark.createDataFrame([(1, 0, "A"), (1, 1, "a"), (2, 0, "B"), (3, 0, "C")], "request_id long, container_index int, container_number string")
    loads = spark.createDataFrame([(1, 7, 0), (2, 7, 0), (2, 7, 0), (4, 7, 0)], "request_id long, export_order_item_id long, container_index int")
    found = Q.check_shipment_structure(boxes, loads)
    assert "Aggregate" not in _plan(found)
    assert {r["request_id"]: r["reason"] for r in found.collect()} == {
        1: "container numbers must be unique", 2: "a line may appear once per container", 3: "every container needs an allocation",
        4: "allocation references an unavailable container"}


def test_order_lines_number_the_raw_lines_once(spark):
    assert "lineitem" not in _plan(E.queries()["order_lines"](spark, SF001))


def test_contract_lines_are_judged_and_numbered_in_written_steps(spark):
    """The plan of the numbered lines held sixteen copies of what made them; a large request is numbered by chunks."""
    items = spark.range(5000).select(F.lit(1).cast("long").alias("request_id"), F.col("id").alias("item_index"), F.lit(7).cast("long").alias("product_id"),
                                     F.lit(1.5).cast("decimal(12,3)").alias("quantity"))
    more = spark.createDataFrame([(2, 4, 7, "0.5"), (2, 9, 7, "3"), (2, 1, 7, "2"), (3, 0, 7, "1"), (3, 1, 8, "1"), (3, 2, 9, "1")],
                                 "request_id long, item_index long, product_id long, q string")
    items = items.unionByName(more.withColumn("quantity", F.col("q").cast("decimal(12,3)")).drop("q"))
    products = spark.createDataFrame([(7, "a", 6, True), (8, "b", 6, False)], "id long, name string, u int, is_active boolean")
    lines, bad = I._order_items(items, products.select("*", F.col("u").cast("decimal(12,3)").alias("units_per_carton")))
    assert "Join" not in _plan(lines) and "Join" not in _plan(bad)
    assert sorted(map(tuple, bad.collect())) == [(3, "product inactive", 5), (3, "product unavailable", 5)]
    got = {(r["request_id"], r["item_index"]): (r["line_number"], r["carton_start"], r["carton_end"]) for r in lines.collect()}
    assert got == {(1, i): (i + 1, i + 1, i + 1) for i in range(5000)} | {(2, 1): (1, 1, 2), (2, 4): (2, None, None), (2, 9): (3, 3, 5)}


def test_rows_without_an_error_make_no_array_of_errors(spark):
    rules = [Q.Rule("amount", "number", positive=True, dtype="decimal(12,3)"), Q.Rule("name", "text", min_len=2)]
    rows = spark.createDataFrame([(1, "7", "ab"), (2, "x", "a")], "request_id long, amount string, name string")
    valid, rejected = Q.validate(rows, rules, keep=["request_id"])
    assert re.search(r"isnotnull\(coalesce\(.*\)\) THEN array\(", _plan(rejected, "optimizedPlan"))
    assert [r["request_id"] for r in valid.collect()] == [1]
    assert [(r["request_id"], len(r["errors"])) for r in rejected.collect()] == [(2, 2)]


def test_rejects_are_written_before_both_sides_of_the_structure_are_cut(spark, monkeypatch):
    """What the rules reject was worked out again for containers and allocations."""
    seen = {}
    monkeypatch.setattr(I, "_shipment_structure_rejects", lambda c, a: seen.update(c=_plan(c, "optimizedPlan"), a=_plan(a, "optimizedPlan"))
                        or c.select("request_id", F.lit("x").alias("reason"), F.lit(5).alias("step")).limit(0))
    requests = spark.createDataFrame([(1, "7", "8", "2024-01-01"), (2, "0", "8", "2024-01-01"), (3, "7", "8", "2024-01-01")],
                                     "request_id long, client_id string, customs_consignee_id string, shipment_date string")
    boxes = spark.createDataFrame([(1, 0, "A", "1"), (2, 0, "B", "1")], "request_id long, container_index int, container_number string, cbm string")
    loads = spark.createDataFrame([(r, 0, "5", "0", "1") for r in (1, 2, 3)], "request_id long, alloc_index long, export_order_item_id string, container_index string, quantity string")
    sv, cv, av, rejected = I._validate_shipments(requests, boxes, loads)
    assert seen["c"].count("Join") == 1 and seen["a"].count("Join") == 1
    assert [r["request_id"] for r in sv.collect()] == [1] and cv.count() == 2 and av.count() == 3
    assert sorted((r["request_id"], r["reason"]) for r in rejected.collect()) == [(2, "invalid shipment: client_id:must be positive"), (3, "a shipment needs a container")]


def test_earlier_requests_of_a_line_are_summed_in_one_exchange(spark):
    rows = spark.range(0, 300, 1, 3).select((F.col("id") % 5).alias("export_order_item_id"), F.col("id").alias("request_id"), F.col("id").alias("a"), F.lit(1).alias("b"))
    sums = {"a": "_a", "b": "_b"}
    one = G._earlier(rows, sums, False)
    assert _plan(one).count("Exchange hashpartitioning") == 1 and "Join" not in _plan(one)
    got = {r["request_id"]: (r["_a"], r["_b"]) for r in one.collect()}
    assert got == {i: (sum(range(i % 5, i, 5)), i // 5) for i in range(300)}
    assert got == {r["request_id"]: (r["_a"], r["_b"]) for r in G._earlier(rows, sums, True).collect()}


def test_a_released_step_leaves_no_files(spark):
    step = kept(spark.range(3))
    path = step._written
    assert path_exists(spark, path)
    release(step, spark.range(2))
    assert not path_exists(spark, path)


def test_shipment_requests_are_written_once_for_an_ingest(spark):
    t = from_testdata(spark, SF001, REQUESTS)
    assert "Join" not in _plan(t["shipment_requests"]) and "Aggregate" not in _plan(t["request_containers"])
    assert "lineitem" not in _plan(E.queries()["ingest_shipments"](spark, SF001))
