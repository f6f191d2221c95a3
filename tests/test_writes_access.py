"""Write-side operations, backfills and access data."""

from decimal import Decimal as Dm

from pyspark.sql import functions as F

from fixtures import D, ledger, order
from ledgerloom.operators import access as A
from ledgerloom.operators import backfill as B
from ledgerloom.sources import sinks


def _sorted(df, key="id"):
    return sorted(tuple(r) for r in df.orderBy(key).collect())


def test_upsert_insert_absent_idempotent(spark):
    tgt = spark.createDataFrame([(1, "a", True), (2, "b", True)], "id long, name string, is_active boolean")
    src = spark.createDataFrame([(2, "B", False), (3, "c", True)], "id long, name string, is_active boolean")
    once = sinks.upsert(tgt, src, ["id"], ["name"])
    assert _sorted(once) == [(1, "a", True), (2, "B", True), (3, "c", True)]
    assert _sorted(sinks.upsert(once, src, ["id"], ["name"])) == _sorted(once)
    ins = sinks.insert_absent(tgt, src, ["id"])
    assert _sorted(ins) == [(1, "a", True), (2, "b", True), (3, "c", True)]
    assert _sorted(sinks.insert_absent(ins, src, ["id"])) == _sorted(ins)


def test_update_soft_delete_replace_cascade(spark):
    tgt = spark.createDataFrame([(1, "a", True), (2, "b", True)], "id long, name string, is_active boolean")
    patch = spark.createDataFrame([(2, "z"), (9, "q")], "id long, name string")
    upd, rej = sinks.update_by_key(tgt, patch, ["id"], ["name"])
    assert _sorted(upd) == [(1, "a", True), (2, "z", True)] and [r["id"] for r in rej.collect()] == [9]
    sd = sinks.soft_delete(tgt, spark.createDataFrame([(1,)], "id long"))
    assert _sorted(sd) == [(1, "a", False), (2, "b", True)]
    child = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id long, parent long")
    new = spark.createDataFrame([(13, 2)], "id long, parent long")
    rep = sinks.replace_children(child, "parent", new, spark.createDataFrame([(1,), (2,)], "pid long"))
    assert _sorted(rep) == [(13, 2)]  # parent 1 emptied
    tables = {"shipments": spark.createDataFrame([(1,), (2,)], "id long"),
              "shipment_containers": spark.createDataFrame([(10, 1), (20, 2)], "id long, shipment_id long"),
              "shipment_allocations": spark.createDataFrame([(100, 1, 10), (200, 2, 20)],
                                                            "id long, shipment_id long, shipment_container_id long")}
    out = sinks.cascade_delete(tables, "shipments", spark.createDataFrame([(1,)], "id long"))
    assert [r["id"] for r in out["shipment_containers"].collect()] == [20]
    assert [r["id"] for r in out["shipment_allocations"].collect()] == [200]


def test_backfills_idempotent(spark):
    sh = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    cont = spark.createDataFrame([(11, 1, 1, "X", None, Dm("1"))],
                                 "id long, shipment_id long, line_number int, container_number string, "
                                 "container_type string, cbm decimal(12,3)")
    new = B.backfill_containers(sh, cont)
    assert sorted(r["container_number"] for r in new.collect()) == ["CONTAINER-2", "CONTAINER-3"]
    allc = cont.unionByName(new)
    assert B.backfill_containers(sh, allc).count() == 0
    al = spark.createDataFrame([(1, 1, None), (2, 2, None), (3, 1, 11)], "id long, shipment_id long, "
                               "shipment_container_id long")
    fixed = {r["id"]: r["shipment_container_id"] for r in B.backfill_allocation_containers(al, allc).collect()}
    assert fixed == {1: 11, 2: 20, 3: 11}
    prods = spark.createDataFrame([
        (1, "Carton", Dm("7"), Dm("3"), '{"pieces_per_pack": 10, "packs_per_carton": 6}'),
        (2, "Carton", Dm("7"), Dm("3"), '{"pieces_per_box": 12, "jars_per_carton": 4}'),
        (3, "Carton", Dm("7"), Dm("3"), None), (4, "Jar", Dm("7"), Dm("3"), None)],
        "id long, package_type string, units_per_carton decimal(12,3), pieces_per_unit decimal(12,3), "
        "packaging_details string")
    once = B.backfill_packing(prods)
    got = {r["id"]: (r["package_type"], r["pieces_per_unit"], r["units_per_carton"], r["packaging_details"])
           for r in once.collect()}
    assert got[1] == ("Jar", Dm("10"), Dm("6"), '{"pieces_per_pack":10,"packs_per_carton":6}')
    assert got[2] == ("Jar", Dm("12"), Dm("4"), '{"pieces_per_pack":12,"packs_per_carton":4}')
    assert got[3] == ("Jar", Dm("7"), Dm("3"), '{"pieces_per_pack":7,"packs_per_carton":3}')  # the swap
    assert got[4][0] == "Jar" and got[4][3] is None
    assert _sorted(B.backfill_packing(once).select(*prods.columns)) == _sorted(once.select(*prods.columns))
    orders = spark.createDataFrame([(1, None), (2, 5)], "id long, bank_account_id long")
    assert _sorted(B.backfill_bank_account(orders, 1)) == [(1, 1), (2, 5)]


def test_access_matrix_and_restrictions(spark):
    t = ledger(spark, [order(1)])
    m = {r["id"]: r for r in A.role_permissions_matrix(t).collect()}
    assert len(m[1]["permissions"]) == 31 and m[4]["permissions"][0] == "gate_pass.edit"
    empty = t.replace(role_permissions=t["role_permissions"].filter("role_id <> 5"))
    assert {r["id"]: r["permissions"] for r in A.role_permissions_matrix(empty).collect()}[5] == []
    df = spark.createDataFrame([(1, "INV", "draft", D(2024, 1, 1), "c", Dm("1"), Dm("2"), Dm("3"), Dm("9"))],
                               "id long, invoice_number string, status string, contract_date date, client_name string, "
                               "total_packages decimal(10,2), total_net_weight decimal(10,2), "
                               "total_gross_weight decimal(10,2), client_value decimal(10,2)")
    with __import__("pytest").raises(ValueError):
        A.restrict(df, "order_list", ["gate_pass.view"])
    lacking = [c for c in A.RESTRICTED_COLUMNS["order_list"] if c not in df.columns]
    assert "client_value" not in A.restrict(df, "order_list", ["gate_pass.view"], absent=lacking).columns
    assert "client_value" in A.restrict(df, "order_list", ["gate_pass.view", "documents.preview"]).columns
    assert "client_value" in A.restrict(df, "order_list", ["gate_pass.view", "orders.edit"]).columns
    nested = spark.createDataFrame([(1, [(1, "p", Dm("5"))])],
                                   "id long, items array<struct<id:long, product_name:string, client_value:decimal(10,2)>>")
    r = A.restrict(nested, "order_detail", ["gate_pass.view"], absent=A.RESTRICTED_COLUMNS["order_detail"])
    assert r.schema["items"].dataType.elementType.fieldNames() == ["id", "product_name"]


def test_document_authorization_and_seed(spark):
    t = ledger(spark, [order(1)])
    ev = spark.createDataFrame([
        (1, True, 1, 1, "printed", "sale_contract"),     # admin -> allowed
        (2, True, 1, 2, "printed", "sale_contract"),     # gate-pass role lacks documents.print -> denied
        (3, False, 1, 2, "printed", "gate_pass"),        # gate-pass role prints gate passes -> allowed
        (4, True, 1, 1, "previewed", "gate_pass"),       # shipping documents not from an order -> invalid
        (5, False, 1, 1, "shredded", "gate_pass"),       # bad action -> invalid
        (6, False, 1, 99, "previewed", "gate_pass")],    # unknown user
        "id long, on_order boolean, target_id long, user_id long, action_name string, document_type string")
    got = {r["id"]: r["outcome"] for r in A.authorize_document_actions(ev, t).collect()}
    assert got == {1: "allowed", 2: "denied", 3: "allowed", 4: "invalid", 5: "invalid", 6: "unauthenticated"}
    mapping = spark.createDataFrame([("Viewer", "reports.view"), ("Viewer", "users.view"), ("Administrator", "*")],
                                    "role_name string, permission_key string")
    seeded = A.seed_role_permissions(t, mapping)
    assert seeded.count() == t["role_permissions"].count() + 1
    assert A.seed_role_permissions(t.replace(role_permissions=seeded), mapping).count() == seeded.count()
    eff = A.user_permission_sets(t).collect()
    assert {r["user_id"] for r in eff} == {1, 2}
    assert A.users_with_roles(t, ordered=True).collect()[0]["role_name"] == "Administrator"
    assert F is not None
