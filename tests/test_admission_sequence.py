"""Order-dependent admission and keyed writes against plain sequential versions."""
import random
from decimal import Decimal as Dm

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import admission as G
from ledgerloom.sources import sinks
from tests.fixtures import D, item, ledger, order, payment


def fold(quantity, owner, held, requests):
    """requests: (request_id, client, {line: quantity}, shipment or None); held: {(shipment, line): quantity}."""
    held, out = dict(held), {}
    for rid, client, lines, ship in sorted(requests, key=lambda r: r[0]):
        reason = None
        if any(x not in quantity for x in lines):
            reason = "missing line"
        else:
            for x in sorted(lines):
                used = sum(q for (s, y), q in held.items() if y == x and s != ship)
                if owner[x][0] != client:
                    reason = "foreign client"
                elif owner[x][1] == "cancelled":
                    reason = "cancelled contract"
                elif lines[x] > quantity[x] - used:
                    reason = "short"
                if reason:
                    break
        out[rid] = reason
        if reason is None:
            if ship is not None:
                held = {k: v for k, v in held.items() if k[0] != ship}
            for x, q in lines.items():
                held[ship if ship is not None else -rid, x] = q
    return out


def decide(spark, t, requests, with_edits):
    rows = [(rid, c, x, Dm(q)) for rid, c, lines, _ in requests for x, q in lines.items()]
    df = spark.createDataFrame(rows, "request_id long, client_id long, export_order_item_id long, quantity decimal(12,3)")
    edits = spark.createDataFrame([(rid, s) for rid, _, _, s in requests if s is not None], "request_id long, shipment_id long") if with_edits else None
    return {r["request_id"]: r["reason"] for r in G.admit_shipments(t, df, edits=edits).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_allocations_and_edits_match_the_sequence(spark, seed):
    rng = random.Random(seed)
    orders = [order(o, client=1 + o % 2, status="cancelled" if o == 6 else "confirmed") for o in range(1, 8)]
    items = [item(o * 10 + k, o, str(rng.randint(3, 9)), "1", line=k) for o in range(1, 8) for k in (1, 2)]
    ships, allocs, n = [], [], 0
    for s in range(500, 508):
        client = 1 + s % 2
        ships.append((s, f"S{s}", client, 100, None, None, "draft", D(2024, 3, 1), 2024, s, "USD"))
        for x in rng.sample([i for i in items if 1 + i[1] % 2 == client and i[1] != 6], 2):
            n += 1
            allocs.append((n, s, None, x[0], 1, Dm(rng.randint(1, 2))))
    t = ledger(spark, orders, items, shipments=ships, allocations=allocs)
    lines = [i[0] for i in items] + [999]
    requests = []
    for rid in range(1, 61):
        ship = rng.choice([None, *range(500, 508)])
        client = rng.choice([1, 2]) if ship is None or rng.random() < 0.1 else 1 + ship % 2
        own = [x for x in lines if x == 999 or 1 + (x // 10) % 2 == client]
        pick = rng.sample(own if rng.random() < 0.85 else lines, rng.randint(1, 3))
        if 999 in pick and rng.random() < 0.8:
            pick = [x for x in pick if x != 999] or [own[0]]
        requests.append((rid, client, {x: rng.choice([1, 1, 2, 3, 6]) for x in pick}, ship))
    held = {}
    for _, s, _, x, _, q in allocs:
        held[s, x] = held.get((s, x), 0) + int(q)
    quantity = {i[0]: int(i[4]) for i in items}
    owner = {i[0]: (1 + i[1] % 2, "cancelled" if i[1] == 6 else "confirmed") for i in items}
    assert decide(spark, t, requests, True) == fold(quantity, owner, held, requests)
    plain = [(r, c, x, None) for r, c, x, _ in requests]
    assert decide(spark, t, plain, False) == fold(quantity, owner, held, plain)


def test_a_rejected_edit_keeps_its_cartons(spark):
    """Two edits of two shipments for the same ten cartons: only one may end with them."""
    t = ledger(spark, [order(1)], [item(11, 1, "10", "1")],
               shipments=[(s, f"S{s}", 1, 100, None, None, "draft", D(2024, 3, 1), 2024, s, "USD") for s in (500, 501)],
               allocations=[(1, 500, None, 11, 1, Dm("10"))])
    got = decide(spark, t, [(1, 1, {11: 11}, 500), (2, 1, {11: 10}, 501)], True)
    assert got == {1: "short", 2: "short"}
    got = decide(spark, t, [(1, 1, {11: 4}, 500), (2, 1, {11: 6}, 501), (3, 1, {11: 5}, 500)], True)
    assert got == {1: None, 2: None, 3: "short"}


def test_a_short_line_before_a_foreign_one_says_short(spark):
    t = ledger(spark, [order(1), order(2, client=2)], [item(11, 1, "5", "1"), item(21, 2, "5", "1")])
    assert decide(spark, t, [(1, 1, {11: 9, 21: 1}, None)], False) == {1: "short"}
    assert decide(spark, t, [(1, 1, {11: 4}, None), (2, 1, {11: 2, 21: 1}, None)], False) == {1: None, 2: "short"}


def test_payment_prefix_and_scan_match_the_sequence(spark):
    rng = random.Random(5)
    orders = [order(i, status="cancelled" if i == 9 else "confirmed", pct=str(rng.choice([0, 10, 100]))) for i in range(1, 10)]
    items = [item(i * 10, i, "10", "10") for i in range(1, 10)]
    t = ledger(spark, orders, items, [payment(1, 1, "30")])
    rows = [(i, rng.choice([*range(1, 10), 77]), Dm(rng.choice(["0", "-1", "10", "25.5", "60", "100", "99.99"]))) for i in range(1, 120)]
    req = spark.createDataFrame(rows, "request_id long, order_id long, amount decimal(14,2)")
    got = {r["request_id"]: (r["outcome"], r["remaining_after"]) for r in G.admit_payments(t, req).collect()}
    left = {o[0]: max(Dm(100) - Dm(100) * o[10] / 100 - (30 if o[0] == 1 else 0), Dm(0)) for o in orders}
    for rid, oid, amount in rows:
        if amount <= 0:
            want = "invalid_amount"
        elif oid == 77:
            want = "unknown_order"
        elif oid == 9:
            want = "cancelled"
        elif left[oid] <= Dm("0.004"):
            want = "fully_paid"
        elif amount - left[oid] > Dm("0.004"):
            want = "exceeds"
        else:
            want = "accepted"
            left[oid] = max(left[oid] - amount, Dm(0))
        assert got[rid][0] == want, (rid, oid, amount)
        if want in ("accepted", "exceeds", "fully_paid"):
            assert got[rid][1] == left[oid]


# ------------------------------------------------------------------ keyed writes

def sequential_upsert(target, rows, update):
    out = {r["id"]: dict(r) for r in target}
    for r in rows:
        if r["id"] in out:
            out[r["id"]].update({c: r[c] for c in update})
        else:
            out[r["id"]] = dict(r)
    return out


def test_repeated_keys_in_keyed_writes(spark):
    schema = "id long, name string, kind string, n int"
    target = [dict(id=i, name=f"t{i}", kind="old", n=0) for i in (1, 2, 3)]
    rows = [dict(id=2, name="a", kind="x", n=1), dict(id=9, name="b", kind="first", n=2), dict(id=2, name="c", kind="y", n=3),
            dict(id=9, name="d", kind="second", n=4), dict(id=9, name="e", kind="third", n=5)]
    mk = lambda rs: spark.createDataFrame([tuple(r.values()) for r in rs], schema)
    got = {r["id"]: r.asDict() for r in sinks.upsert(mk(target), mk(rows), ["id"], ["name", "n"], order=["n"]).collect()}
    assert got == sequential_upsert(target, rows, ["name", "n"])
    new = sinks.insert_absent(mk(target), mk(rows), ["id"], order=["n"]).collect()
    assert sorted((r["id"], r["name"]) for r in new) == [(1, "t1"), (2, "t2"), (3, "t3"), (9, "b")]
    out, missing = sinks.update_by_key(mk(target), mk(rows), ["id"], ["name"], order=["n"])
    assert sorted((r["id"], r["name"]) for r in out.collect()) == [(1, "t1"), (2, "c"), (3, "t3")]
    assert sorted(r["n"] for r in missing.collect()) == [2, 4, 5]
    nulls = mk([dict(id=None, name="x", kind="k", n=1), dict(id=None, name="x", kind="k", n=1)])
    assert sinks.insert_absent(mk(target), nulls, ["id"]).count() == 5


def test_cancelled_is_terminal_within_a_batch(spark):
    t = ledger(spark, [order(1), order(2), order(3), order(4, status="cancelled")], [item(11, 1, "1", "1")], [payment(1, 3, "1")],
               shipments=[(7, "S", 1, 100, None, None, "draft", D(2024, 3, 1), 2024, 1, "USD")])
    rows = [(1, 1, "cancelled"), (2, 1, "confirmed"), (3, 2, "confirmed"), (4, 2, "draft"), (5, 3, "cancelled"), (6, 3, "draft"),
            (7, 1, "cancelled"), (8, 4, "cancelled"), (9, 4, "draft"), (10, 77, "draft")]
    req = spark.createDataFrame(rows, "request_id long, order_id long, status string")
    got = {r["request_id"]: (r["accepted"], r["new_status"]) for r in G.apply_order_status(t, req, "2024-05-01 10:00:00").collect()}
    assert got == {1: (True, "cancelled"), 2: (False, "cancelled"), 3: (True, "confirmed"), 4: (True, "draft"), 5: (False, "confirmed"),
                   6: (True, "draft"), 7: (True, "cancelled"), 8: (True, "cancelled"), 9: (False, "cancelled"), 10: (False, None)}
    changed = {r["id"]: r["status"] for r in G.order_status_table(t, req, "2024-05-01 10:00:00").collect()}
    assert changed == {1: "cancelled", 2: "draft", 3: "draft", 4: "cancelled"}
    stamped = {r["id"] for r in G.order_status_table(t, req, "2024-05-01 10:00:00").filter(F.col("confirmed_at").isNotNull()).collect()}
    assert stamped == {2}
    ships = spark.createDataFrame([(1, 7, "ready_to_ship"), (2, 7, "cancelled"), (3, 7, "draft"), (4, 8, "draft")], "request_id long, shipment_id long, status string")
    got = {r["request_id"]: (r["accepted"], r["new_status"]) for r in G.apply_shipment_status(t, ships).collect()}
    assert got == {1: (True, "ready_to_ship"), 2: (True, "cancelled"), 3: (False, "cancelled"), 4: (False, None)}
    assert {r["id"]: r["status"] for r in G.shipment_status_table(t, ships).collect()} == {7: "cancelled"}
