"""Details of all shipments: what their lines carry through the shuffles, and how often they are dealt."""

from decimal import Decimal as Dm

import pytest

import __spark_entry__ as E
from fixtures import SF001, D, item, ledger, order
from ledgerloom.operators import access as A
from ledgerloom.operators import fulfilment as FU
from ledgerloom.plans.catalog import DEALT_LINES
from ledgerloom.plans.q_access import GATE_PASS_ONLY
from ledgerloom.sources.tables import from_testdata


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _shipment(spark, allocations):
    """Two contracts in two containers of one shipment."""
    orders = [order(1, scn="SC-1"), order(2)]
    items = [item(10, 1, "90", "10"), item(20, 2, "90", "10", sample=True)]
    shipments = [(500, "SHP-1", 1, 100, None, None, "draft", D(2024, 3, 1), 2024, 1, "USD")]
    containers = [(5001, 500, 1, "CN-A", "20FT", Dm("10")), (5002, 500, 2, "CN-B", "40HC", Dm("5.5"))]
    return ledger(spark, orders, items, shipments=shipments, containers=containers, allocations=allocations)


def _lines(n):
    """n lines in turn in two containers, one carton, none or two each."""
    return [(60 + k, 500, 5001 + k % 2, 10 + 10 * (k % 3 == 0), k, Dm(["1", "0.5", "2"][k % 3])) for k in range(n)]


def _ranges(t):
    return sorted((r.id, r.carton_start, r.carton_end) for r in FU.shipment_cartons(t).select("id", "carton_start", "carton_end").collect())


def _want(lines):
    """Ranges by hand: rows in (line, id) order within their container."""
    used, out = {}, []
    for i, _, box, _, _, q in sorted(lines, key=lambda r: (r[4], r[0])):
        before, n = used.get(box, 0), int(q)
        out.append((i, before + 1 if n else None, before + n if n else None))
        used[box] = before + n
    return sorted(out)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_cartons_of_small_and_large_containers(spark, monkeypatch, bits):
    """A container beyond one block is numbered by chunks, any other in one window; the ranges are the same."""
    monkeypatch.setattr(FU, "LINE_BLOCK_BITS", bits)
    lines = _lines(11)
    lines = [(*r[:2], 5001, *r[3:]) if r[4] < 8 else r for r in lines]
    assert _ranges(_shipment(spark, lines)) == _want(lines)


def test_cartons_of_repeated_and_missing_ids(spark):
    """Ranges belong to ids: rows of one id take all of its ranges, a row without an id still fills its container."""
    lines = [(60, 500, 5001, 10, 1, Dm("2")), (60, 500, 5001, 10, 2, Dm("3")), (None, 500, 5001, 10, 3, Dm("4")), (61, 500, 5001, 20, 4, Dm("1"))]
    assert _ranges(_shipment(spark, lines)) == [(60, 1, 2), (60, 1, 2), (60, 3, 5), (60, 3, 5), (61, 10, 10)]


def test_numbered_lines_stay_with_their_container(spark, no_broadcast):
    """One exchange of the allocations serves the numbering and the join with the containers."""
    plan = _plan(FU.shipment_cartons(_shipment(spark, _lines(5))))
    assert plan.count("Exchange hashpartitioning(shipment_container_id") == 1
    assert "hashpartitioning(id#" not in plan[plan.index("Window"):plan.index("Window") + 400]
    # allocations: by container, item and product; containers, items and products once; items and orders by contract
    assert plan.count("Exchange hashpartitioning") <= 8


def test_kept_items_meet_their_contracts_where_they_lie(spark, no_broadcast):
    t = from_testdata(spark, SF001, DEALT_LINES)
    i, o = t["export_order_items"], t["export_orders"].select("invoice_number", "id")
    joined = i.join(o, i["export_order_id"] == o["id"])
    assert "Exchange hashpartitioning(export_order_id" not in _plan(joined)
    plain = from_testdata(spark, SF001)["export_order_items"]
    assert i.columns == plain.columns and sorted(map(str, i.collect())) == sorted(map(str, plain.collect()))


def test_flattened_shipments_deal_only_what_they_show(spark):
    plan = _plan(E.queries()["shipment_detail_lines"](spark, SF001))
    assert not [c for c in ("p_name", "p_brand", "l_extendedprice", "client_price_per_carton") if c in plan]
    plan = _plan(E.queries()["shipment_detail_gate_pass"](spark, SF001))
    assert "p_name" in plan and not [c for c in ("p_brand", "p_type", "client_price_per_carton") if c in plan]


def test_details_with_some_fields_are_those_of_the_whole(spark):
    t = _shipment(spark, _lines(7))
    full = FU.shipment_detail(t).collect()
    some = FU.shipment_detail(t, fields=["id", "product_name", "carton_start"]).collect()
    assert [r.asDict(True) | {"items": [{k: x[k] for k in ("id", "product_name", "carton_start")} for x in r.asDict(True)["items"]]} for r in full] \
        == [r.asDict(True) for r in some]
    assert full[0].sales_contract_number == "INV-2, SC-1" and len(full[0]["items"]) == 7


def test_gate_pass_fields_are_those_of_the_restricted_view(spark):
    absent = ["transporter_name", "transporter_contact", "transporter_phone", "truck_number", "driver_name", "driver_phone", "loading_address",
              "delivery_address", "seal_numbers"]
    t = _shipment(spark, _lines(7))
    whole = A.restrict(FU.shipment_detail(t), "shipment_detail", GATE_PASS_ONLY, absent=absent)
    fields = A.item_fields("shipment_detail", GATE_PASS_ONLY)
    some = A.restrict(FU.shipment_detail(t, fields=fields), "shipment_detail", GATE_PASS_ONLY, absent=absent)
    assert some.schema == whole.schema and some.collect() == whole.collect()
    assert A.item_fields("shipment_detail", [*GATE_PASS_ONLY, "orders.edit"]) is None


def test_details_in_steps_leave_one_written_table_of_dealt_lines(spark, no_broadcast):
    """The last job of a detail held all shuffles of its lines at a time: joins, products and dealing."""
    t = _shipment(spark, _lines(7))
    for nested in (FU.shipment_detail, FU.order_detail):
        plan = _plan(nested(t, steps=True))
        assert "REPARTITION_BY_COL" not in plan and "hashpartitioning(product_id" not in plan and "dealt_lines" in plan
        assert nested(t, steps=True).orderBy("id").collect() == nested(t).orderBy("id").collect()
    assert "lineitem" not in _plan(E.queries()["order_detail"](spark, SF001)) + _plan(E.queries()["order_detail_gate_pass"](spark, SF001))


def test_order_gate_pass_fields_are_those_of_the_restricted_view(spark):
    t = _shipment(spark, _lines(7))
    fields = A.item_fields("order_detail", GATE_PASS_ONLY)
    absent = A.RESTRICTED_COLUMNS["order_detail"]
    for steps in (False, True):
        some = A.restrict(FU.order_detail(t, fields=fields, steps=steps), "order_detail", GATE_PASS_ONLY, absent=absent)
        whole = A.restrict(FU.order_detail(t), "order_detail", GATE_PASS_ONLY, absent=absent)
        assert some.columns == whole.columns and sorted(map(str, some.collect())) == sorted(map(str, whole.collect()))
    shown = FU.order_detail(t, fields=["id", "client_value"], steps=True).orderBy("id").collect()
    assert [[x.client_value for x in r["items"]] for r in shown] == [[x.client_value for x in r["items"]] for r in FU.order_detail(t).orderBy("id").collect()]
