"""Validation, quality jobs, numbering, payment/allocation admission and state rules."""

from decimal import Decimal as Dm

from pyspark.sql import functions as F

from fixtures import SF001
from fixtures import D, item, ledger, order, payment
from ledgerloom.functions.text import seal_list, slug
from ledgerloom.operators import admission as G
from ledgerloom.operators import quality as Q


def test_seal_list_and_slug(spark):
    df = spark.createDataFrame([(None,), ("",), ("A1,, B2\nC3 ",), (",,",)], "v string")
    assert [r[0] for r in df.select(seal_list("v")).collect()] == [None, None, '["A1","B2","C3"]', "[]"]
    names = spark.createDataFrame([("My Photo (1).JPG",), ("...",), ("--x--",)], "n string")
    assert [r[0] for r in names.select(slug("n")).collect()] == ["my-photo-1", "product", "x"]


def test_validate_payments_rules(spark):
    raw = spark.createDataFrame([
        (1, "10", "12.50", "2024-01-15", "  ref "),
        (2, "", "", "2024-02-30", None),
        (3, "abc", "abc", "2024-2-3", "x" * 121),
        (4, "1.5", "-5", "", None),
    ], "request_id long, order_id string, amount string, payment_date string, reference_number string")
    out = {r["request_id"]: r for r in Q.validate_payments(raw).collect()}
    assert out[1]["is_valid"] and out[1]["amount"] == Dm("12.50") and out[1]["reference_number"] == "ref"
    assert out[2]["errors"] == "order_id:must be positive;amount:must be positive;payment_date:invalid date"
    assert out[3]["errors"] == ("order_id:not a number;amount:not a number;payment_date:invalid date;"
                                "reference_number:longer than 120")
    assert out[4]["errors"] == "order_id:not an integer;amount:must be positive;payment_date:invalid date"


def test_exclusive_and_unique(spark):
    df = spark.createDataFrame([(1, "GD1", "FI1"), (2, "GD", " "), (3, None, "FI")], "request_id long, gd string, fi string")
    valid, rejected = Q.validate(df, [Q.Rule("gd", "text", required=False, nullable=True)], keep=["request_id"],
                                 extra=[Q.exclusive("gd", "fi")])
    assert [r["request_id"] for r in rejected.collect()] == [1]
    users = spark.createDataFrame([(1, "A@x.test"), (2, "a@x.test"), (3, "b@x.test")], "id long, email string")
    target = spark.createDataFrame([(9, "B@X.TEST")], "id long, email string")
    dup = Q.unique_violations(users, ["email"], target=target, lower=["email"])
    assert sorted(r["id"] for r in dup.collect()) == [1, 2, 3]


def test_shipment_structure(spark):
    c = spark.createDataFrame([(1, 0, "CN1"), (1, 1, "cn1"), (2, 0, "A"), (3, 0, "A"), (3, 1, "B"),
                               (4, 0, "A"), (5, 0, "A")], "request_id long, container_index int, container_number string")
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 10, 3), (3, 10, 0), (4, 10, 0), (4, 10, 0), (5, 10, 0)],
                              "request_id long, export_order_item_id long, container_index int")
    got = {r["request_id"]: r["reason"] for r in Q.check_shipment_structure(c, a).collect()}
    assert got == {1: "container numbers must be unique", 2: "allocation references an unavailable container",
                   3: "every container needs an allocation", 4: "a line may appear once per container", 5: None}


def test_normalize_items_rejects_whole_order(spark):
    products = [(1, "S1", "P1", "d", "h", "Jar", Dm("6"), Dm("1"), None, Dm("1"), Dm("1"), True),
                (2, "S2", "P2", "d", "h", "Jar", Dm("0"), Dm("1"), None, Dm("1"), Dm("1"), True),
                (3, "S3", "P3", "d", "h", "Jar", Dm("4"), Dm("1"), None, Dm("1"), Dm("1"), False)]
    t = ledger(spark, products=products)
    items = spark.createDataFrame([(1, 1, Dm("99")), (1, 2, Dm("1")), (2, 1, Dm("1")), (3, 3, Dm("1")),
                                   (4, 7, Dm("1"))], "export_order_id long, product_id long, units_per_carton decimal(12,3)")
    out = {(r["export_order_id"], r["product_id"]): r for r in Q.normalize_items(items, t["products"]).collect()}
    assert out[(1, 1)]["units_per_carton"] == Dm("6") and out[(1, 1)]["request_rejected"]
    assert out[(1, 2)]["line_reason"] == "units per carton not set"
    assert not out[(2, 1)]["request_rejected"]
    assert out[(3, 3)]["line_reason"] == "product inactive" and out[(4, 7)]["line_reason"] == "product unavailable"


def test_assign_numbers(spark):
    new = spark.createDataFrame([(1, 2023), (2, 2024), (3, 2023), (4, 2025)], "id long, sequence_year int")
    existing = spark.createDataFrame([(2024, 999), (2024, 5)], "sequence_year int, sequence_number int")
    got = {r["id"]: r["invoice_number"] for r in G.assign_numbers(new, existing, "PX").collect()}
    assert got == {1: "PX-001/2023", 3: "PX-002/2023", 2: "PX-1000/2024", 4: "PX-001/2025"}


def _fold_payments(reqs, start):
    out, rem = {}, dict(start)
    for rid, oid, amt in sorted(reqs):
        if amt <= 0:
            out[rid] = "invalid_amount"
            continue
        if oid not in rem:
            out[rid] = "unknown_order"
            continue
        r = rem[oid]
        if r is None:
            out[rid] = "cancelled"
        elif r <= Dm("0.004"):
            out[rid] = "fully_paid"
        elif amt - r > Dm("0.004"):
            out[rid] = "exceeds"
        else:
            out[rid] = "accepted"
            rem[oid] = max(r - amt, Dm(0))
    return out


def test_admit_payments_fixture(spark):
    t = ledger(spark, [order(1), order(2, status="cancelled"), order(3, pct="100"), order(4)],
               [item(1, 1, "10", "10"), item(2, 2, "1", "1"), item(3, 3, "1", "5"), item(4, 4, "1", "10")],
               [payment(1, 1, "30.00")])
    req = spark.createDataFrame([(10, 1, Dm("50")), (11, 1, Dm("30")), (12, 1, Dm("20.004")), (13, 1, Dm("1")),
                                 (14, 2, Dm("1")), (15, 3, Dm("1")), (16, 9, Dm("1")), (17, 4, Dm("4")),
                                 (18, 4, Dm("6")), (19, 4, Dm("0")), (20, 9, Dm("-1"))],
                                "request_id long, order_id long, amount decimal(14,2)")
    got = {r["request_id"]: r["outcome"] for r in G.admit_payments(t, req).collect()}
    assert got == {10: "accepted", 11: "exceeds", 12: "accepted", 13: "fully_paid", 14: "cancelled",
                   15: "fully_paid", 16: "unknown_order", 17: "accepted", 18: "accepted",
                   19: "invalid_amount", 20: "invalid_amount"}


def test_admit_payments_matches_fold_sf0001(spark, t001):
    from ledgerloom.operators.balances import order_totals, with_balances
    req = t001["order_payments"].select(F.col("id").alias("request_id"), F.col("export_order_id").alias("order_id"),
                                        "amount")
    got = {r["request_id"]: r["outcome"] for r in G.admit_payments(t001, req, include_existing=False).collect()}
    bal = with_balances(order_totals(t001, ["id", "status", "advance_percentage"]), None).collect()
    start = {r["id"]: (None if r["status"] == "cancelled" else r["remaining_amount"]) for r in bal}
    reqs = [(r["request_id"], r["order_id"], r["amount"]) for r in req.collect()]
    assert got == _fold_payments(reqs, start)
    # property: accepted payments never exceed what was open (+ tolerance)
    acc = {}
    for rid, oid, amt in reqs:
        if got[rid] == "accepted":
            acc[oid] = acc.get(oid, Dm(0)) + amt
    for oid, total in acc.items():
        assert total <= start[oid] + Dm("0.004") * 10


def test_admit_shipments_matches_fold_sf0001(spark, t001):
    out = {r["request_id"]: r["reason"] for r in G.admit_shipments(t001, t001["shipment_requests"]).collect()}
    items = {r["id"]: r for r in t001["export_order_items"].select("id", "export_order_id", "quantity").collect()}
    orders = {r["id"]: r for r in t001["export_orders"].select("id", "client_id", "status").collect()}
    ship_ok = {r["id"] for r in t001["shipments"].filter("status <> 'cancelled'").collect()}
    left = {i: r["quantity"] for i, r in items.items()}
    for a in t001["shipment_allocations"].collect():
        if a["shipment_id"] in ship_ok:
            left[a["export_order_item_id"]] -= a["quantity"]
    reqs = {}
    for r in t001["shipment_requests"].collect():
        q = reqs.setdefault(r["request_id"], {"client": r["client_id"], "lines": {}})
        q["lines"][r["export_order_item_id"]] = q["lines"].get(r["export_order_item_id"], Dm(0)) + r["quantity"]
    expect = {}
    for rid in sorted(reqs):
        q = reqs[rid]
        reason = None
        if any(i not in items for i in q["lines"]):
            reason = "missing line"
        else:
            for i in sorted(q["lines"]):
                o = orders[items[i]["export_order_id"]]
                if o["client_id"] != q["client"]:
                    reason = "foreign client"
                elif o["status"] == "cancelled":
                    reason = "cancelled contract"
                elif q["lines"][i] > left[i] + Dm("0.0001"):
                    reason = "short"
                if reason:
                    break
        if reason is None:
            for i, v in q["lines"].items():
                left[i] -= v
        expect[rid] = reason
    assert out == expect


def test_order_status_rules(spark):
    shipments = [(500, "S", 1, 100, None, None, "cancelled", D(2024, 3, 1), 2024, 1, "USD"),
                 (501, "S", 1, 100, None, None, "draft", D(2024, 3, 1), 2024, 2, "USD")]
    allocs = [(1, 500, None, 11, 1, Dm("1")), (2, 501, None, 13, 1, Dm("1"))]
    t = ledger(spark, [order(1, status="cancelled"), order(2), order(3), order(4), order(5, status="draft")],
               [item(11, 2, "1", "1"), item(13, 3, "1", "1")], [payment(1, 4, "1")],
               shipments=shipments, allocations=allocs)
    req = spark.createDataFrame([(1, 1, "confirmed"), (2, 2, "cancelled"), (3, 3, "cancelled"), (4, 4, "cancelled"),
                                 (5, 5, "confirmed"), (6, 1, "cancelled")], "request_id long, order_id long, status string")
    got = {r["request_id"]: (r["accepted"], r["reason"], r["confirmed_at"] is not None)
           for r in G.apply_order_status(t, req, "2024-05-01 10:00:00").collect()}
    assert got[1] == (False, "a cancelled order cannot be reopened", False)
    assert got[2] == (True, None, False)               # only a cancelled-shipment allocation
    assert got[3] == (False, "active shipment allocations", False)
    assert got[4] == (False, "recorded payments", False)
    assert got[5] == (True, None, True) and got[6][0]  # first confirm stamps; cancelled -> cancelled ok
    dels = {r["order_id"]: r["reason"] for r in G.check_order_deletes(
        t, spark.createDataFrame([(2,), (4,), (5,)], "order_id long")).collect()}
    assert dels == {2: "has shipment allocations", 4: "has recorded payments", 5: None}
    edits = spark.createDataFrame([(1, 4, 2, Dm("0")), (2, 2, 1, Dm("0")), (3, 5, 1, Dm("0"))],
                                  "request_id long, order_id long, client_id long, advance_percentage decimal(5,2)")
    er = {r["request_id"]: r["reason"] for r in G.check_order_edits(t, edits).collect()}
    assert er == {1: "client fixed once paid", 2: "has shipment allocations", 3: None}


def test_master_data_rules(spark):
    parties = spark.createDataFrame([(1, "client", "Acme", "a@b.co"), (2, "vendor", "X", "nope")],
                                    "request_id long, party_type string, name string, email string")
    ok, bad = Q.validate(parties, [r for r in Q.PARTY_RULES if r.field in ("party_type", "name", "email")],
                         keep=["request_id"])
    assert [r["request_id"] for r in ok.collect()] == [1]
    assert Q.errors_text("errors") is not None
    errs = bad.select(Q.errors_text().alias("e")).collect()[0]["e"]
    assert errs == "party_type:not allowed;name:shorter than 2;email:invalid e-mail"
    filters = spark.createDataFrame([("2024-01-01", "", "", "", "USD"), ("x", "", "0", "lost", "")],
                                    "date_from string, date_to string, client_id string, status string, "
                                    "currency string")
    ok, bad = Q.validate(filters, Q.REPORT_FILTER_RULES)
    assert ok.count() == 1 and bad.count() == 1


def test_gate_pass_update(spark):
    from ledgerloom.plans.ingest import apply_gate_pass
    shipments = [(1, "S1", 1, 100, None, None, "draft", D(2024, 1, 1), 2024, 1, "USD"),
                 (2, "S2", 1, 100, None, None, "shipped", D(2024, 1, 1), 2024, 2, "USD")]
    t = ledger(spark, [order(1)], shipments=shipments)
    patches = spark.createDataFrame([(1, 1, "", "Truck Co", " ", "A1,, B2\nC3 "), (2, 2, None, "T", None, None),
                                     (3, 9, None, "T", None, None)],
                                    "request_id long, id long, clearing_agent_id string, transporter_name string, "
                                    "driver_name string, seal_numbers string")
    for c in ("transporter_contact", "transporter_phone", "truck_number", "driver_phone", "loading_address",
              "delivery_address"):
        patches = patches.withColumn(c, F.lit(None).cast("string"))
    out, rej = apply_gate_pass(t, patches, "shipments")
    assert {r["request_id"] for r in rej.collect()} == {2, 3}
    s1 = out["shipments"].filter("id = 1").collect()[0]
    assert s1["transporter_name"] == "Truck Co" and s1["driver_name"] is None
    assert s1["seal_numbers"] == '["A1","B2","C3"]' and s1["clearing_agent_id"] is None
    out2, rej2 = apply_gate_pass(t, patches.filter("request_id <> 3"), "export_orders")
    assert rej2.count() == 1  # order 2 does not exist
