"""Balance algebra, reports and statement on literal fixtures (FIXTURES part B)."""

from decimal import Decimal as Dm

from pyspark.sql import functions as F

from fixtures import D, item, ledger, order, payment
from ledgerloom.operators import reports as R
from ledgerloom.operators import statement as S
from ledgerloom.operators.balances import Filters, order_balances


def _bal(spark):
    orders = [order(1), order(2), order(3, pct="33.33"), order(4, pct="100"), order(5, pct="10"),
              order(6, pct="10"), order(7, pct="0"), order(8, status="cancelled")]
    items = [item(11, 2, "2", "5", sample=True),                      # only samples -> 0
             item(12, 3, "3", "10.0000"), item(13, 4, "1", "99.99"),
             item(14, 5, "10", "10"), item(15, 6, "10", "10"), item(16, 7, "1", "10.004"),
             item(17, 8, "1", "1")]
    payments = [payment(21, 5, "90.00"),   # exactly the remainder (100 - 10)
                payment(22, 6, "95.00"),   # above it
                payment(23, 7, "10.00")]   # leaves 0.004 unpaid
    return ledger(spark, orders, items, payments)


def test_order_balances(spark):
    b = {r["id"]: r for r in order_balances(_bal(spark)).collect()}
    assert b[1]["order_total"] == 0 and b[1]["remaining_amount"] == 0          # no items
    assert b[2]["order_total"] == 0                                            # samples only
    assert b[3]["opening_advance"] == Dm("10.00")                              # round(30 * 33.33%, 2) = 9.999
    assert b[4]["opening_advance"] == Dm("99.99") and b[4]["remaining_amount"] == 0
    assert b[5]["paid_amount"] == Dm("100") and b[5]["remaining_amount"] == 0
    assert b[6]["paid_amount"] == Dm("100") and b[6]["remaining_amount"] == 0  # clamped
    assert b[7]["remaining_amount"] == Dm("0.004")
    for r in b.values():                                                       # paid + remaining = total
        if r["opening_advance"] + r["additional_received"] <= r["order_total"]:
            assert r["paid_amount"] + r["remaining_amount"] == r["order_total"]


def test_filters_and_cancelled(spark):
    t = _bal(spark)
    assert R.executive_currency(t, Filters(status="cancelled")).count() == 0   # status=cancelled -> empty
    assert {r["currency"] for r in R.executive_currency(t, Filters(currency=" ")).collect()} == {"USD"}
    assert R.sales(t, Filters(client_id=2)).count() == 0
    assert R.sales(t, Filters(date_from="2024-01-11")).count() == 0
    assert R.sales(t, Filters(date_to="2024-01-10", date_from="2024-01-10")).count() == 7
    # 0.004 is not open, 0.0041 would be
    assert 7 not in [r["id"] for r in R.receivables(t, "2024-06-01").collect()]


def test_ageing_buckets(spark):
    asof = D(2024, 6, 1)
    offs = [-1, 0, 1, 30, 31, 60, 61, 90, 91]
    orders = [order(i + 1, valid=asof - __import__("datetime").timedelta(days=d)) for i, d in enumerate(offs)]
    orders.append(order(20, date=D(2024, 5, 2), valid=None))  # null valid_until -> contract date (30 days)
    items = [item(100 + o[0], o[0], "1", "10") for o in orders]
    t = ledger(spark, orders, items)
    got = {r["id"]: (r["days_outstanding"], r["aging_bucket"]) for r in R.receivables(t, asof).collect()}
    assert got[1] == (0, "Current") and got[2] == (0, "Current") and got[3] == (1, "1-30 days")
    assert got[4] == (30, "1-30 days") and got[5] == (31, "31-60 days") and got[6] == (60, "31-60 days")
    assert got[7] == (61, "61-90 days") and got[8] == (90, "61-90 days") and got[9] == (91, "Over 90 days")
    assert got[20] == (30, "1-30 days")


def test_statement_running_balance(spark):
    orders = [order(9, pct="10", currency="USD"), order(10, pct="0.001", currency="USD"),
              order(11, pct="50", currency="EUR", date=D(2024, 1, 5))]
    items = [item(1, 9, "10", "10"), item(2, 10, "1", "1"), item(3, 11, "2", "10")]
    pays = [payment(9, 9, "20.00", date=D(2024, 1, 10)), payment(10, 9, "5.00", date=D(2024, 1, 10))]
    t = ledger(spark, orders, items, pays)
    st = S.client_statement(t, 1).collect()
    ids = [r["id"] for r in st]
    # EUR order first (earlier date); same date: orders, then advances, then payments; ids compared as text
    assert ids == ["order-11", "advance-11", "order-10", "order-9", "advance-9", "payment-10", "payment-9"]
    assert "advance-10" not in ids  # 0.001% of 1 = 0.00 -> below 0.004
    last = {}
    for r in st:
        last[r["currency"]] = r["running_balance"]
    summary = {r["currency"]: r["closing_balance"] for r in S.statement_summary(t, 1).collect()}
    assert summary == last
    assert summary["USD"] == Dm("101") - Dm("10") - Dm("25")
    # reconciliation (H6): closing = Σ(total − advance − received), may be negative
    assert summary["EUR"] == Dm("10")


def test_ledger_nested_and_dashboard(spark):
    t = ledger(spark, [order(1, currency="USD"), order(2, currency="EUR"), order(3, client=3)],
               [item(1, 1, "1", "10"), item(2, 2, "1", "20")])
    nested = {r["id"]: r["balances"] for r in R.client_ledger_nested(t).collect()}
    assert set(nested) == {1, 2}                 # inactive client 3 absent
    assert nested[2] == []                       # client without orders -> []
    assert [b["currency"] for b in nested[1]] == ["EUR", "USD"]
    stats = R.order_stats(t).collect()[0]
    assert stats["total"] == 3 and stats["cancelled"] == 0
    assert R.master_counts(t).collect()[0]["clients"] == 2
    me = R.monthly_exports(t, "2024-06-15").collect()
    assert {r["month"] for r in me} == {"2024-01"}
    assert R.monthly_exports(t, "2024-07-01").count() == 0   # first day of February is the bound
    assert R.top_clients(t, k=1).collect()[0]["currency"] == "EUR"


def test_payment_history_union(spark):
    t = ledger(spark, [order(1, pct="30")], [item(1, 1, "10", "10")], [payment(5, 1, "1.00")])
    h = {r["id"]: r for r in R.payment_history(t).collect()}
    assert h["advance-1"]["reference_number"] == "Advance 30.00%"
    assert h["advance-1"]["amount"] == Dm("30.00") and h["payment-5"]["payment_type"] == "later_receipt"
    assert R.payment_history(t, Filters(date_from="2024-01-11")).select(F.col("id")).collect()[0][0] == "payment-5"


def test_bundles(spark):
    from ledgerloom.plans import bundles
    t = ledger(spark, [order(1, currency="USD"), order(2, currency="EUR", status="cancelled")],
               [item(1, 1, "1", "10"), item(2, 2, "1", "20")], [payment(1, 1, "2.00")])
    ex = bundles.executive(t)
    assert [r["currency"] for r in ex["currencySummary"].collect()] == ["USD"]
    assert ex["topClients"].count() == 1 and ex["monthlySales"].count() == 1
    bundles.release(ex)
    db = bundles.dashboard(t, "2024-03-01")
    assert db["stats"].collect()[0]["total"] == 2 and db["recentOrders"].count() == 2
    assert db["recentPayments"].collect()[0]["amount"] == Dm("2.00")
    bundles.release(db)
    st = bundles.client_statement(t, 1)
    assert st["party"].collect()[0]["name"] == "Acme" and st["transactions"].count() == 2
