"""Registered queries of scans, filters, lists and report bundles that have no report of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ledgerloom.functions.text import blank_to_null, seal_list
from ledgerloom.operators import fulfilment as FU
from ledgerloom.operators import quality as Q
from ledgerloom.operators import reports as R
from ledgerloom.operators.balances import Filters
from ledgerloom.plans import bundles
from ledgerloom.plans.catalog import AS_OF, BAL, NBAL, D, register, with_ctes
from ledgerloom.plans.q_reports import _RECEIPTS, ADVANCE_BY
from ledgerloom.sources import tables

# Fixed parameters of the point lookups.
ORDER_ID, SHIPMENT_ID = 7, 105


@register("order_by_id", with_ctes(f"SELECT id, invoice_number, status FROM export_orders WHERE id = {ORDER_ID}"))
def q_order_by_id(t):
    """One order by its id (an equality filter on the scan)."""
    return tables.by_id(t["export_orders"], ORDER_ID).select("id", "invoice_number", "status")


@register("active_parties", with_ctes("SELECT id, name FROM parties WHERE is_active AND party_type = 'clearing_agent'"))
def q_active_parties(t):
    """Active parties of one type."""
    return tables.active(t["parties"], party_type="clearing_agent").select("id", "name")


@register("payment_history_filtered", with_ctes(
    f"""SELECT 'payment-' || CAST(receipt_id AS VARCHAR) AS id, payment_date, currency, {D('CAST(amount AS DECIMAL(20,2))')} AS amount, recorder AS recorded_by
      FROM receipts WHERE payment_date >= DATE '1996-01-01' AND currency = 'EUR' AND status = 'confirmed' AND client_id IN (SELECT id FROM parties)
    UNION ALL
    SELECT 'advance-' || CAST(id AS VARCHAR), contract_date, currency, {D('CAST(opening_advance AS DECIMAL(20,2))')}, '{ADVANCE_BY}'
      FROM named_balances WHERE opening_advance > 0.004 AND contract_date >= DATE '1996-01-01' AND currency = 'EUR' AND status = 'confirmed'""",
    *NBAL, extra={"receipts": _RECEIPTS}))
def q_payment_history_filtered(t):
    """Payment history from a date on, of one currency and one status."""
    f = Filters(date_from="1996-01-01", currency="EUR", status="confirmed")
    return R.payment_history(t, f).select("id", "payment_date", "currency", "amount", "recorded_by")


@register("allocated_qty_excluding", with_ctes(
    f"""SELECT export_order_item_id, {D('SUM(quantity)')} AS allocated_quantity FROM shipment_allocations
    WHERE shipment_id IN (SELECT id FROM shipments WHERE status <> 'cancelled' AND id <> {SHIPMENT_ID}) GROUP BY ALL"""))
def q_allocated_qty_excluding(t):
    """Allocated quantities as an edit of one shipment sees them."""
    return FU.allocated_qty(t, SHIPMENT_ID)


@register("unique_against_target", with_ctes(
    """SELECT id, lower(name) AS name, COUNT(*) OVER (PARTITION BY lower(name)) > 1 AS in_batch,
      lower(name) IN (SELECT lower(name) FROM parties WHERE party_type = 'client') AS in_target
    FROM (SELECT id, CASE id % 3 WHEN 0 THEN upper(name) WHEN 1 THEN name || ' & Co' ELSE 'Shared ' || CAST(CAST(floor(id / 4) AS BIGINT) AS VARCHAR) END AS name FROM parties) b
    QUALIFY in_batch OR in_target"""))
def q_unique_against_target(t):
    """V3: names of a batch that exist among the clients, or twice in the batch, whatever their case."""
    p = t["parties"]
    spelling = (F.when(F.col("id") % 3 == 0, F.upper("name")).when(F.col("id") % 3 == 1, F.concat("name", F.lit(" & Co")))
                .otherwise(F.concat(F.lit("Shared "), F.floor(F.col("id") / 4).cast("bigint").cast("string"))))
    batch = p.select("id", spelling.alias("name"))
    return Q.unique_violations(batch, ["name"], target=p.filter(F.col("party_type") == "client"), lower=["name"]).select("id", "name", "in_batch", "in_target")


_SEALS = "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat(' S', cast(id AS string), ',, T1 ') WHEN 3 THEN concat('A', chr(10), 'B') ELSE ' , ' END"


@register("seal_lists", with_ctes(
    f"""SELECT id, IF(raw IS NULL OR raw = '', NULL, IF(len(seals) = 0, '[]', '["' || array_to_string(seals, '","') || '"]')) AS seals, NULLIF(raw, '') AS raw
    FROM (SELECT id, raw, list_filter(list_transform(string_split(replace(raw, chr(10), ','), ','), lambda x: trim(x)), lambda x: x <> '') AS seals
      FROM (SELECT id, {_SEALS.replace('string', 'VARCHAR')} AS raw FROM shipments) s) q"""))
def q_seal_lists(t):
    """V7 (and F16): seal lists of the shipments from text in several spellings."""
    raw = t["shipments"].select("id", F.expr(_SEALS).alias("raw"))
    return raw.select("id", seal_list(F.col("raw")).alias("seals"), F.when(F.col("raw") != "", F.col("raw")).alias("raw"))


@register("blank_numbers", with_ctes(
    "SELECT id, CASE WHEN trim(sales_contract_number) <> '' THEN sales_contract_number END AS sales_contract_number FROM export_orders"))
def q_blank_numbers(t):
    """contract numbers with blank ones as NULL."""
    return t["export_orders"].select("id", blank_to_null("sales_contract_number").alias("sales_contract_number"))


def _parts(bundle: dict, columns: dict[str, tuple[str, str]]):
    """(part, key, value) of a bundle's tables: which text and which number of each."""
    rows = [bundle[name].select(F.lit(name).alias("part"), F.expr(key).cast("string").alias("key"), F.expr(value).cast("decimal(30,7)").alias("value"))
            for name, (key, value) in columns.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@register("executive_bundle", with_ctes(
    f"""SELECT part, key, {D('CAST(value AS DECIMAL(30,7))')} AS value FROM (
      SELECT 'currencySummary' AS part, currency AS key, SUM(remaining_amount) AS value FROM live GROUP BY ALL
      UNION ALL SELECT 'statusSummary', status, COUNT(*) FROM live GROUP BY ALL
      UNION ALL SELECT 'monthlySales', strftime(contract_date, '%Y-%m') || ' ' || currency, SUM(order_total) FROM live GROUP BY ALL
      UNION ALL (SELECT 'topClients', CAST(client_id AS VARCHAR) || ' ' || currency, SUM(order_total) AS total FROM live
        WHERE client_id IN (SELECT id FROM parties) GROUP BY client_id, currency ORDER BY total DESC, client_id, currency LIMIT 10))""",
    *BAL, extra={"live": "SELECT * FROM balances WHERE status <> 'cancelled'"}))
def q_executive_bundle(t):
    """R2: the four parts of the executive report over one balance relation."""
    return _parts(bundles.executive(t, keep=False), {"currencySummary": ("currency", "remaining_amount"), "statusSummary": ("status", "order_count"),
                                         "monthlySales": ("concat(month, ' ', currency)", "total_amount"),
                                         "topClients": ("concat(cast(client_id AS string), ' ', currency)", "total_amount")})


@register("dashboard_bundle", with_ctes(
    f"""SELECT part, key, {D('CAST(value AS DECIMAL(30,7))')} AS value FROM (
      SELECT 'stats' AS part, 'total' AS key, COUNT(*) AS value FROM export_orders
      UNION ALL SELECT 'financialSummary', currency, SUM(paid_amount) FROM balances WHERE status <> 'cancelled' GROUP BY ALL
      UNION ALL SELECT 'statusSummary', status, COUNT(*) FROM export_orders GROUP BY ALL
      UNION ALL SELECT 'monthlyExports', strftime(contract_date, '%Y-%m') || ' ' || currency, SUM(order_total) FROM balances
        WHERE status <> 'cancelled' AND contract_date >= date_trunc('month', DATE '{AS_OF}' - INTERVAL 5 MONTH) GROUP BY ALL
      UNION ALL (SELECT 'recentOrders', CAST(id AS VARCHAR), remaining_amount FROM named_balances ORDER BY contract_date DESC, id DESC LIMIT 6)
      UNION ALL (SELECT 'recentPayments', CAST(receipt_id AS VARCHAR), amount FROM receipts WHERE client_id IN (SELECT id FROM parties)
        ORDER BY payment_date DESC, receipt_id DESC LIMIT 5))""", *NBAL, extra={"receipts": _RECEIPTS}))
def q_dashboard_bundle(t):
    """The parts of the dashboard."""
    return _parts(bundles.dashboard(t, AS_OF, keep=False), {
        "stats": ("'total'", "total"), "financialSummary": ("currency", "paid_amount"), "statusSummary": ("status", "order_count"),
        "monthlyExports": ("concat(month, ' ', currency)", "total_amount"), "recentOrders": ("id", "remaining_amount"), "recentPayments": ("id", "amount")})
