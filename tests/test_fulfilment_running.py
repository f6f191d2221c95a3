"""Carton ranges, contract numbers, allocation and the skew-safe running sum."""

import random
from decimal import Decimal as Dm

from pyspark.sql import functions as F

from fixtures import D, item, ledger, order
from ledgerloom.operators import fulfilment as FU
from ledgerloom.operators.running import number_all, number_rows, running_sum


def _ship(spark, scns=(None, "", "  ", "SC-9", "SC-9")):
    orders = [order(i + 1, scn=s, date=D(2024, 1, 10 - i)) for i, s in enumerate(scns)]
    items = [item(10 + i, i + 1, "10", "10", line=1) for i in range(len(scns))]
    shipments = [(500, "SHP-1", 1, 100, None, None, "draft", D(2024, 3, 1), 2024, 1, "USD"),
                 (501, "SHP-2", 1, 100, None, None, "cancelled", D(2024, 3, 1), 2024, 2, "USD")]
    containers = [(5001, 500, 1, "CN-A", "20FT", Dm("10")), (5002, 500, 2, "CN-B", "40HC", Dm("5.5"))]
    qs = ["2", "0.5", "3.75", "1"]
    allocs = [(60 + i, 500, 5001, 10 + i, i + 1, Dm(q)) for i, q in enumerate(qs)]
    allocs.append((70, 500, 5002, 14, 5, Dm("2")))
    allocs.append((71, 501, None, 10, 1, Dm("8")))  # cancelled shipment: not counted as allocated
    return ledger(spark, orders, items, shipments=shipments, containers=containers, allocations=allocs)


def test_carton_ranges_per_container(spark):
    t = _ship(spark)
    got = {r["id"]: (r["carton_start"], r["carton_end"]) for r in FU.shipment_cartons(t).collect()}
    assert [got[60], got[61], got[62], got[63]] == [(1, 2), (None, None), (3, 5), (6, 6)]
    assert got[70] == (1, 2)  # numbering restarts per container


def test_item_cartons(spark):
    t = ledger(spark, [order(1)], [item(1, 1, "2", "1", line=1), item(2, 1, "0.5", "1", line=2),
                                   item(3, 1, "3.75", "1", line=3), item(4, 1, "1", "1", line=4)])
    got = [(r["carton_start"], r["carton_end"]) for r in FU.item_cartons(t).orderBy("line_number").collect()]
    assert got == [(1, 2), (None, None), (3, 5), (6, 6)]


def test_contract_numbers_and_header(spark):
    t = _ship(spark)
    cn = {r["shipment_id"]: r["sales_contract_number"] for r in FU.contract_numbers(t).collect()}
    # blank numbers fall back to the invoice; duplicates collapse; first appearance order
    assert cn[500] == "INV-1, INV-2, INV-3, SC-9"
    h = {r["id"]: r for r in FU.shipment_header(t).collect()}
    assert h[500]["container_number"] == "CN-A, CN-B" and h[500]["container_type"] == "20FT, 40HC"
    assert h[500]["cbm"] == Dm("15.500") and h[501]["cbm"] == 0
    # contract list by contract date (latest contracts are earliest dated here)
    assert h[500]["sales_contract_number"].split(", ")[0] == "SC-9"


def test_allocated_and_available(spark):
    t = _ship(spark)
    alloc = {r["export_order_item_id"]: r["allocated_quantity"] for r in FU.allocated_qty(t).collect()}
    assert alloc[10] == Dm("2") and alloc[13] == Dm("1") and alloc[14] == Dm("2")
    assert FU.allocated_qty(t, exclude_shipment_id=500).count() == 0
    avail = {r["export_order_item_id"]: r["remaining_quantity"] for r in FU.available_lines(t, 1).collect()}
    assert avail[10] == Dm("8") and avail[14] == Dm("8")
    lst = {r["id"]: r for r in FU.shipment_list(t).collect()}
    assert lst[500]["contract_count"] == 5 and lst[500]["container_count"] == 2
    ol = {r["id"]: r for r in FU.order_list(t).collect()}
    assert ol[1]["shipped_quantity"] == Dm("2") and ol[1]["contracted_quantity"] == Dm("10")


def test_line_measures_samples(spark):
    t = ledger(spark, [order(1)], [item(1, 1, "2", "10", sample=True, net="3", customs="1.5"),
                                   item(2, 1, "2", "10", net="3", customs="1.5")])
    m = {r["id"]: r for r in FU.order_lines(t).collect()}
    assert m[1]["client_value"] == 0 and m[1]["customs_value"] == 0 and m[1]["total_net_weight"] == Dm("6")
    assert m[2]["client_value"] == Dm("20") and m[2]["customs_value"] == Dm("9")


def _brute(rows, exclusive=False):
    out, acc = {}, {}
    for k, o, v, rid in sorted(rows, key=lambda r: ((r[0] is not None, r[0]), r[1], r[3])):
        acc[k] = acc.get(k, 0) + v
        out[rid] = acc[k] - (v if exclusive else 0)
    return out


def test_running_sum_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for rid in range(3000):
        key = "hot" if rnd.random() < 0.4 else rnd.choice([None, "a", "b", "c", "d"])  # one hot key, NULL key
        rows.append((key, rnd.randint(0, 50), rnd.randint(-5, 9), rid))
    df = spark.createDataFrame(rows, "k string, o int, v int, rid int")
    for chunk in (None, [F.floor(F.col("o") / 7)], [F.lit(0)]):
        for exclusive in (False, True):
            got = running_sum(df, ["k"], ["o", "rid"], "v", "rs", chunk=chunk, exclusive=exclusive)
            assert {r["rid"]: r["rs"] for r in got.collect()} == _brute(rows, exclusive)


def test_number_all_is_the_request_order(spark):
    rows = [(i * 7919 % 5_000_011, i % 3) for i in range(4000)] + [(-5, 0), (1 << 40, 1)]
    df = spark.createDataFrame(rows, "request_id long, item_index int")
    got = {(r["request_id"], r["item_index"]): r["n"] for r in number_all(df, ["request_id", "item_index"], "n", bits=8).collect()}
    assert got == {r: i + 1 for i, r in enumerate(sorted(rows))}


def test_number_rows(spark):
    df = spark.createDataFrame([(1, 30), (1, 10), (2, 5), (1, 20)], "g int, o int")
    for chunk in (None, [F.lit(0)]):
        got = sorted((r["g"], r["o"], r["n"]) for r in number_rows(df, ["g"], ["o"], "n", chunk=chunk).collect())
        assert got == [(1, 10, 1), (1, 20, 2), (1, 30, 3), (2, 5, 1)]
