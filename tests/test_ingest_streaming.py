"""Ingest jobs (I1, I3-I6) and the micro-batch payment stream."""

import os
import tempfile
from decimal import Decimal as Dm

from pyspark.sql import functions as F

from fixtures import D, item, ledger, order
from ledgerloom.plans import ingest as I
from ledgerloom.operators.admission import admit_payments

HDR = ("request_id long, client_id string, customs_consignee_id string, bank_account_id string, "
       "contract_date string, valid_until string, sales_contract_number string, advance_percentage string, "
       "currency string")
ITM = ("request_id long, item_index int, product_id string, quantity string, quantity_unit string, "
       "net_weight_per_carton string, gross_weight_per_carton string, client_price_per_carton string, "
       "customs_price_per_kg string, is_sample boolean")


def test_ingest_orders(spark):
    t = ledger(spark, [order(1, year=2024, seq=7)], [item(1, 1, "1", "1")])
    headers = spark.createDataFrame([
        (1, "1", "100", "1", "2024-03-01", None, "  ", "25", None),   # ok
        (6, "1", "100", "1", "2024-03-01", "", None, "25", None),     # a blank date is no date
        (7, "1", "100", "1", "2024-03-01", None, None, "25", None),   # no line
        (2, "1", "100", "2", "2024-03-02", None, None, "0", "EUR"),   # inactive bank account
        (3, "1", "100", "1", "2024-02-30", None, None, "0", "USD"),   # bad date
        (4, "1", "100", "1", "2024-03-04", None, "SC-1", "0", "USD"),  # inactive product on a line
        (5, "1", "100", "1", "2024-03-05", None, "SC-5", "10", "USD"),  # ok
    ], HDR)
    items = spark.createDataFrame([
        (1, 0, "1", "2.5", None, "1", "1.2", "10", "0.5", False), (1, 1, "1", "3", None, "1", "1.2", "10", "0.5", True),
        (2, 0, "1", "1", None, "1", "1", "1", "1", False), (3, 0, "1", "1", None, "1", "1", "1", "1", False),
        (4, 0, "2", "1", None, "1", "1", "1", "1", False),
        (6, 0, "1", "4", None, "1", "1", "1", "1", False), (5, 0, "1", "4", None, "1", "1", "1", "1", False),
    ], ITM)
    prods = [(1, "S1", "P1", "d", "h", "Jar", Dm("6"), Dm("1"), None, Dm("1"), Dm("1"), True),
             (2, "S2", "P2", "d", "h", "Jar", Dm("6"), Dm("1"), None, Dm("1"), Dm("1"), False)]
    t = t.replace(products=spark.createDataFrame(prods, t["products"].schema))
    out, rejected = I.ingest_orders(t, headers, items, "EXP", 2024)
    rej = {r["request_id"]: r["reason"] for r in rejected.collect()}
    assert set(rej) == {2, 3, 4, 6, 7} and rej[7] == "a contract needs a line" and "valid_until" in rej[6]
    assert rej[2] == "select an active bank account" and rej[4] == "product inactive"
    new = {r["id"]: r for r in out["export_orders"].filter("id > 1").collect()}
    assert [new[k]["invoice_number"] for k in sorted(new)] == ["EXP-008/2024", "EXP-009/2024"]
    assert new[2]["sales_contract_number"] is None and new[2]["currency"] == "USD"
    lines = out["export_order_items"].filter("export_order_id = 2").orderBy("line_number").collect()
    assert [(r["carton_start"], r["carton_end"], r["units_per_carton"]) for r in lines] == [
        (1, 2, Dm("6")), (3, 5, Dm("6"))]


def test_ingest_and_edit_shipments(spark):
    t = ledger(spark, [order(1), order(2, client=2), order(3, status="cancelled")],
               [item(10, 1, "10", "1"), item(20, 2, "10", "1"), item(30, 3, "10", "1")],
               shipments=[(500, "SHP-001/2024", 1, 100, None, None, "draft", D(2024, 3, 1), 2024, 1, "USD")],
               containers=[(5001, 500, 1, "OLD", "20FT", Dm("1"))],
               allocations=[(1, 500, 5001, 10, 1, Dm("4"))])
    req = spark.createDataFrame([
        (1, "1", "100", None, "2024-04-01", "GD-1", None, None),   # ok: 6 left on line 10
        (2, "1", "100", None, "2024-04-01", "GD", "FI", None),     # both numbers
        (3, "1", "100", None, "2024-04-01", None, None, None),     # foreign client line
        (4, "1", "100", None, "2024-04-01", None, None, None),     # short (after request 1)
    ], "request_id long, client_id string, customs_consignee_id string, also_notify_party_id string, "
       "shipment_date string, gd_number string, fi_number string, currency string")
    cont = spark.createDataFrame([(1, 0, "C1", "20FT", "10"), (1, 1, "C2", None, ""), (2, 0, "X", None, "1"),
                                  (3, 0, "Y", None, "1"), (4, 0, "Z", None, "1")],
                                 "request_id long, container_index int, container_number string, "
                                 "container_type string, cbm string")
    alloc = spark.createDataFrame([(1, 0, "10", "0", "2"), (1, 1, "10", "1", "4"), (2, 0, "10", "0", "1"),
                                   (3, 0, "20", "0", "1"), (4, 0, "10", "0", "1")],
                                  "request_id long, alloc_index int, export_order_item_id string, "
                                  "container_index string, quantity string")
    out, rejected = I.ingest_shipments(t, req, cont, alloc, 2024)
    rej = {r["request_id"]: r["reason"] for r in rejected.collect()}
    assert set(rej) == {2, 3, 4} and rej[3] == "foreign client" and rej[4] == "short"
    new = out["shipments"].filter("id > 500").collect()
    assert len(new) == 1 and new[0]["shipment_number"] == "SHP-002/2024" and new[0]["container_number"] == "C1"
    assert out["shipment_allocations"].filter(F.col("shipment_id") == new[0]["id"]).count() == 2
    # edit shipment 500: its own 4 are excluded from availability, so 10 may be allocated
    ereq = spark.createDataFrame([(9, 500, "1", "100", None, "2024-04-02", None, None, None)],
                                 "request_id long, shipment_id long, client_id string, customs_consignee_id string, "
                                 "also_notify_party_id string, shipment_date string, gd_number string, "
                                 "fi_number string, currency string")
    econt = spark.createDataFrame([(9, 0, "NEW", None, "3")], "request_id long, container_index int, "
                                  "container_number string, container_type string, cbm string")
    ealloc = spark.createDataFrame([(9, 0, "10", "0", "10")], "request_id long, alloc_index int, "
                                   "export_order_item_id string, container_index string, quantity string")
    out2, rej2 = I.apply_shipment_edits(t, ereq, econt, ealloc)
    assert rej2.count() == 0
    assert [r["container_number"] for r in out2["shipment_containers"].collect()] == ["NEW"]
    assert [r["quantity"] for r in out2["shipment_allocations"].collect()] == [Dm("10")]


def test_roles_and_products(spark):
    t = ledger(spark, [order(1)])
    roles = spark.createDataFrame([(1, "Auditor", "reads"), (2, "Viewer", None), (3, "X", None)],
                                  "request_id long, name string, description string")
    mapping = spark.createDataFrame([(1, 1), (1, 26)], "request_id long, permission_id long")
    out, rej = I.ingest_roles(t, roles, mapping)
    assert {r["request_id"] for r in rej.collect()} == {2, 3}
    assert out["role_permissions"].filter("role_id = 6").count() == 2
    out2 = I.replace_role_permissions(out, spark.createDataFrame([], "role_id long, permission_id long"),
                                      spark.createDataFrame([(6,)], "id long"))
    assert out2["role_permissions"].filter("role_id = 6").count() == 0
    rows = spark.createDataFrame([
        (1, "SKU-9", "Chili Jar", "Jar", "6", "12", "1", "1.2", "3", "not json"),
        (2, "SKU-1", "Dup", "Jar", "6", "12", "1", "1.2", "3", None),
        (3, None, "Z", "Jar", "6", "12", "1", "1.2", "3", None),
        (4, None, "Pouch Mix", "Crate", "6", "12", "1", "1.2", "3", None)],
        "request_id long, sku string, name string, package_type string, units_per_carton string, "
        "pieces_per_unit string, net_weight_per_carton string, gross_weight_per_carton string, "
        "default_client_price string, packaging_details string")
    pout, prej = I.ingest_products(t, rows)
    assert {r["request_id"] for r in prej.collect()} == {2, 3, 4}
    new = pout["products"].filter("name = 'Chili Jar'").collect()[0]
    assert new["packaging_details"] == '{"pieces_per_pack":0,"packs_per_carton":0}' and new["id"] == 2


def test_first_name_and_sku_win_and_products_update(spark):
    t = ledger(spark, [order(1)])
    roles = spark.createDataFrame([(2, "Auditor", None), (1, "Auditor", "first"), (3, "Clerk", None)], "request_id long, name string, description string")
    pairs = spark.createDataFrame([(1, 1), (1, 1), (2, 5)], "request_id long, permission_id long")
    out, rej = I.ingest_roles(t, roles, pairs)
    assert [r["request_id"] for r in rej.collect()] == [2]
    assert out["roles"].filter("name = 'Auditor'").collect()[0]["description"] == "first"
    assert out["role_permissions"].filter("role_id = 6").count() == 1
    base = ("Jar", "6", "12", "1", "1.2", "3")
    schema = ("request_id long, product_id long, sku string, name string, packaging_details string, description string, package_type string, "
              "units_per_carton string, pieces_per_unit string, net_weight_per_carton string, gross_weight_per_carton string, default_client_price string")
    new = spark.createDataFrame([(1, None, "N1", "First", '{"pieces_per_pack": -5}', "d", *base), (2, None, "N1", "Second", '{"pieces_per_pack": "abc"}', "d", *base),
                                 (3, None, "N1", "Third", '{"pieces_per_pack": "10", "packs_per_carton": 2.5}', "kept", *base),
                                 (4, None, "N1", "Fourth", None, "d", *base)], schema)
    made, rej = I.ingest_products(t, new.drop("product_id"))
    assert {r["request_id"] for r in rej.collect()} == {1, 2, 4}
    third = made["products"].filter("sku = 'N1'").collect()[0]
    assert third["packaging_details"] == '{"pieces_per_pack":10,"packs_per_carton":2.5}' and third["description"] == "kept"
    edits = spark.createDataFrame([(1, 2, "SKU-1", "Clash", None, "d", *base), (2, 2, "N2", "Mine", None, "d", *base), (3, 99, "N3", "None", None, "d", *base),
                                   (4, 2, "N2", "Mine again", None, "d", *base)], schema)
    done, rej = I.apply_product_edits(made, edits)
    assert {r["request_id"]: r["reason"] for r in rej.collect()} == {1: "sku already exists", 3: "product not found"}
    assert done["products"].filter("id = 2").collect()[0]["name"] == "Mine again" and done["products"].count() == 2


def test_contract_fields_survive_and_an_edit_cannot_empty_it(spark):
    t = ledger(spark, [order(1)], [item(1, 1, "1", "10")])
    header = spark.createDataFrame([(1, "1", "100", "1", "2024-03-01", "0", "USD", "CIF", "12.5", "Karachi", "Hamburg", "  ")],
                                   "request_id long, client_id string, customs_consignee_id string, bank_account_id string, contract_date string, "
                                   "advance_percentage string, currency string, payment_term string, freight_amount string, port_of_loading string, "
                                   "port_of_destination string, notes string")
    line = spark.createDataFrame([(1, 0, "1", "2", None, "1", "1", "1", "1", False, "Special")], ITM + ", description_override string")
    out, rej = I.ingest_orders(t, header, line, "EXP", 2024, created_by=7)
    assert rej.count() == 0
    row = out["export_orders"].filter("created_by = 7").collect()[0]
    assert (row["payment_term"], row["freight_amount"], row["port_of_loading"], row["port_of_destination"], row["notes"]) == (
        "CIF", Dm("12.50"), "Karachi", "Hamburg", None)
    assert out["export_order_items"].filter("description_override = 'Special'").count() == 1
    edits = header.select("*", F.lit(1).cast("long").alias("order_id"))
    edits = edits.unionByName(edits.withColumn("request_id", F.lit(2).cast("long")))
    two = line.unionByName(line.withColumn("request_id", F.lit(2).cast("long")).withColumn("quantity", F.lit("9")))
    same, rej = I.apply_order_edits(t, edits, two.limit(0))
    assert {r["reason"] for r in rej.collect()} == {"a contract needs a line"} and same["export_order_items"].count() == 1
    done, rej = I.apply_order_edits(t, edits, two)
    assert rej.count() == 0 and done["export_orders"].count() == 1
    assert [r["quantity"] for r in done["export_order_items"].collect()] == [Dm("9")]


def test_payment_stream_matches_batch(spark):
    t = ledger(spark, [order(1), order(2)], [item(1, 1, "10", "10"), item(2, 2, "1", "5")])
    base = tempfile.mkdtemp(prefix="ledgerloom-stream-")
    src, pay, outc = (os.path.join(base, n) for n in ("requests", "payments", "outcomes"))
    schema = "request_id bigint, order_id bigint, amount decimal(14,2), payment_date date, " \
             "reference_number string, created_by bigint"
    b1 = [(1, 1, Dm("60"), D(2024, 5, 1), None, 1), (2, 2, Dm("6"), D(2024, 5, 1), None, 1)]
    b2 = [(3, 1, Dm("50"), D(2024, 5, 2), None, 1), (4, 1, Dm("40"), D(2024, 5, 2), None, 1)]
    spark.createDataFrame(b1, schema).coalesce(1).write.parquet(os.path.join(src, "b1"))
    from ledgerloom.streaming.payments import start_payment_stream
    q = start_payment_stream(spark, t, os.path.join(src, "*"), pay, outc, os.path.join(base, "ckpt"),
                             available_now=True)
    q.awaitTermination()
    spark.createDataFrame(b2, schema).coalesce(1).write.parquet(os.path.join(src, "b2"))
    q = start_payment_stream(spark, t, os.path.join(src, "*"), pay, outc, os.path.join(base, "ckpt"),
                             available_now=True)
    q.awaitTermination()
    got = {r["request_id"]: r["outcome"] for r in spark.read.parquet(outc).collect()}
    batch = spark.createDataFrame(b1 + b2, schema)
    expect = {r["request_id"]: r["outcome"] for r in admit_payments(t, batch).collect()}
    assert got == expect == {1: "accepted", 2: "exceeds", 3: "exceeds", 4: "accepted"}
    assert spark.read.parquet(pay).count() == 2
    b3 = [(1, 1, Dm("1"), D(2024, 5, 3), None, 1), (5, 2, Dm("1"), D(2024, 5, 3), None, 1), (5, 2, Dm("1"), D(2024, 5, 3), None, 1)]
    spark.createDataFrame(b3, schema).coalesce(1).write.parquet(os.path.join(src, "b3"))
    start_payment_stream(spark, t, os.path.join(src, "*"), pay, outc, os.path.join(base, "ckpt"), available_now=True).awaitTermination()
    last = spark.read.parquet(outc).filter("request_id = 5 or outcome = 'duplicate_request'").collect()
    assert sorted((r["request_id"], r["outcome"]) for r in last) == [(1, "duplicate_request"), (5, "accepted")]
    assert sorted(r["id"] for r in spark.read.parquet(pay).collect()) == [1, 4, 5]


def test_apply_order_edits(spark):
    t = ledger(spark, [order(1), order(2, status="shipped"), order(3)],
               [item(1, 1, "1", "10"), item(2, 2, "1", "10"), item(3, 3, "1", "10")],
               [__import__("fixtures").payment(1, 3, "9.00")])
    hdr = spark.createDataFrame([
        (1, 1, "1", "100", "1", "2024-03-01", None, None, "0", "USD"),   # ok: items replaced
        (2, 2, "1", "100", "1", "2024-03-01", None, None, "0", "USD"),   # shipped: not editable
        (3, 3, "1", "100", "1", "2024-03-01", None, None, "0", "USD"),   # total 5 < received 9
    ], "request_id long, order_id long, " + HDR.split(", ", 1)[1])
    itm = spark.createDataFrame([(1, 0, "1", "4", None, "1", "1", "2", "0", False),
                                 (1, 1, "1", "1", None, "1", "1", "2", "0", True),
                                 (2, 0, "1", "1", None, "1", "1", "1", "0", False),
                                 (3, 0, "1", "1", None, "1", "1", "5", "0", False)], ITM)
    out, rej = I.apply_order_edits(t, hdr, itm)
    reasons = {r["request_id"]: r["reason"] for r in rej.collect()}
    assert set(reasons) == {2, 3} and reasons[3] == "received payments would exceed the total"
    lines = out["export_order_items"].filter("export_order_id = 1").orderBy("line_number").collect()
    assert [(r["quantity"], r["carton_start"], r["carton_end"]) for r in lines] == [
        (Dm("4"), 1, 4), (Dm("1"), 5, 5)]
    assert out["export_order_items"].filter("export_order_id = 3").count() == 1  # untouched


def test_load_conform_and_audit(spark, tmp_path):
    from ledgerloom.sources import store, tables
    raw = spark.createDataFrame([(1, "Acme", "client")], "ID long, name string, party_type string")
    c = tables.conform(raw, __import__("ledgerloom.sources.schemas", fromlist=["x"]).SCHEMAS["parties"])
    assert c.columns[0] == "id" and c.schema["is_active"].dataType.simpleString() == "boolean"
    root = str(tmp_path / "ledger")
    c.write.parquet(os.path.join(root, "parties"))
    with __import__("pytest").raises(FileNotFoundError):
        tables.load_tables(spark, root)
    t = tables.load_tables(spark, root, names=["parties", "roles"], optional=["roles"])
    assert list(t) == ["parties"] and t["parties"].collect()[0]["name"] == "Acme"
    assert tables.active(t["parties"].fillna({"is_active": True}), party_type="supplier").count() == 0
    assert tables.by_id(t["parties"], 1).count() == 1
    ev = spark.createDataFrame([(1, 5, "printed", "2024-01-02 10:00:00")],
                               "id long, user_id long, action_name string, created_at string") \
        .withColumn("created_at", F.to_timestamp("created_at"))
    store.append_audit(ev, os.path.join(root, "audit"), 1)
    store.append_audit(ev, os.path.join(root, "audit"), 2)
    back = spark.read.parquet(os.path.join(root, "audit"))
    assert back.count() == 2 and "event_date" in back.columns
