"""Registered reports with the place of every row in the order that the ledger's screens show.

Places come from ``operators/positions.py``; the oracle numbers the rows in one window."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import access as A
from ledgerloom.operators import fulfilment as FU
from ledgerloom.operators import reports as R
from ledgerloom.operators.positions import with_position
from ledgerloom.plans.catalog import AS_OF, BAL, NBAL, D, ORACLE, register, with_ctes


def _place(order: str) -> str:
    return f"row_number() OVER (ORDER BY {order}) - 1 AS position"


def _ordered(name: str, of: str, columns: str, order: str):
    """Register ``name``: the rows of the query ``of`` with their place."""
    return register(name, f"SELECT {columns}, {_place(order)} FROM ({ORACLE[of]}) q")


@register("sales_ordered", with_ctes(
    f"SELECT id, client_name, contract_date, currency, {D('order_total')} AS order_total, {_place('contract_date DESC, id DESC')} FROM named_balances WHERE status <> 'cancelled'", *NBAL))
def q_sales_ordered(t):
    """T4: sales, newest first."""
    return with_position(R.sales(t).select("id", "client_name", "contract_date", "currency", "order_total"), F.col("contract_date").desc(), F.col("id").desc())


@_ordered("receivables_ordered", "receivables", "id, client_name, days_outstanding, aging_bucket, remaining_amount", "days_outstanding DESC, remaining_amount DESC, id")
def q_receivables_ordered(t):
    """Receivables, oldest and largest first."""
    rows = R.receivables(t, AS_OF).select("id", "client_name", "days_outstanding", "aging_bucket", "remaining_amount")
    return with_position(rows, F.col("days_outstanding").desc(), F.col("remaining_amount").desc(), F.col("id"))


@_ordered("payment_history_ordered", "payment_history", "id, payment_date, client_name, amount, payment_type", "payment_date DESC, id DESC")
def q_payment_history_ordered(t):
    """Payment history, newest first."""
    rows = R.payment_history(t).select("id", "payment_date", "client_name", "amount", "payment_type")
    return with_position(rows, F.col("payment_date").desc(), F.col("id").desc())


@register("ledger_orders_ordered", with_ctes(
    f"SELECT id, client_id, contract_date, {D('remaining_amount')} AS remaining_amount, {_place('client_id, contract_date DESC, id DESC')} FROM balances WHERE status <> 'cancelled'", *BAL))
def q_ledger_orders_ordered(t):
    """T5: every client's orders, newest first within the client."""
    return with_position(R.ledger_orders(t).select("id", "client_id", "contract_date", "remaining_amount"),
                         F.col("client_id"), F.col("contract_date").desc(), F.col("id").desc())


@_ordered("ledger_payments_ordered", "ledger_payments", "id, client_id, payment_date, amount", "client_id, payment_date DESC, id DESC")
def q_ledger_payments_ordered(t):
    """T5: every client's payments, newest first within the client."""
    return with_position(R.ledger_payments(t).select("id", "client_id", "payment_date", "amount"), F.col("client_id"), F.col("payment_date").desc(), F.col("id").desc())


@_ordered("order_list_ordered", "order_list", "id, invoice_number, client_name, client_value", "created_at DESC, id DESC")
def q_order_list_ordered(t):
    """The order list, newest first."""
    rows = FU.order_list(t).select("id", "invoice_number", "client_name", "client_value", "created_at")
    return with_position(rows, F.col("created_at").desc(), F.col("id").desc()).drop("created_at")


@_ordered("shipment_list_ordered", "shipment_list", "id, shipment_number, contract_count, total_packages", "created_at DESC, id DESC")
def q_shipment_list_ordered(t):
    """The shipment list, newest first."""
    rows = FU.shipment_list(t).select("id", "shipment_number", "contract_count", "total_packages", "created_at")
    return with_position(rows, F.col("created_at").desc(), F.col("id").desc()).drop("created_at")


@register("active_parties_ordered", with_ctes(f"SELECT id, party_type, name, {_place('party_type, name, id')} FROM parties WHERE is_active"))
def q_active_parties_ordered(t):
    """Every active party by type and name (all party lists at once)."""
    p = t["parties"].filter("is_active").select("id", "party_type", "name")
    return with_position(p, F.col("party_type"), F.col("name"), F.col("id"))


@register("active_masters_ordered", with_ctes(
    f"SELECT kind, id, name, {_place('kind, name, id')} FROM (SELECT 'account' AS kind, id, account_name AS name FROM bank_accounts WHERE is_active "
    "UNION ALL SELECT 'product', id, name FROM products WHERE is_active) m"))
def q_active_masters_ordered(t):
    """Active products and bank accounts by name."""
    rows = (t["bank_accounts"].filter("is_active").select(F.lit("account").alias("kind"), "id", F.col("account_name").alias("name"))
            .unionByName(t["products"].filter("is_active").select(F.lit("product").alias("kind"), "id", "name")))
    return with_position(rows, F.col("kind"), F.col("name"), F.col("id"))


@_ordered("users_with_roles_ordered", "users_with_roles", "id, name, role_name, is_active", "name, id")
def q_users_with_roles_ordered(t):
    """Users by name."""
    return with_position(A.users_with_roles(t).select("id", "name", "role_name", "is_active"), F.col("name"), F.col("id"))
