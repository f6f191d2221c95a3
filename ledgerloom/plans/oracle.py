"""Independent DuckDB SQL for the oracle check.

Written by hand against the same domain views (``sources.testdata`` supplies the view CTEs); the
business logic below is SQL, not a rendering of the Spark plans.  Every decimal output is
converted to double through its text, as on the Spark side.
"""

from __future__ import annotations

from ledgerloom.sources.testdata import oracle_prelude


def D(expr: str) -> str:
    """Exact decimal -> double conversion (matches ``functions.money.exact_double``)."""
    return f"CAST(CAST({expr} AS VARCHAR) AS DOUBLE)"


# Shared CTEs.  Goods and receipts are one stream of amounts per order, summed once; an order's paid part
# is whatever of its total is not left, so only one of the two clamped amounts is computed.
SHARED_CTES = {
    "amounts": """
SELECT export_order_id AS oid, quantity * client_price_per_carton AS goods, NULL AS receipt FROM export_order_items WHERE NOT is_sample
UNION ALL
SELECT export_order_id, NULL, amount FROM order_payments""",
    "per_order": """
SELECT oid, SUM(goods) AS goods, SUM(receipt) AS received, COUNT(receipt) AS receipts FROM amounts GROUP BY oid""",
    "o_totals": """
SELECT id, client_id, invoice_number, contract_date, valid_until, status, currency, advance_percentage,
  port_of_destination, final_destination, CAST(IFNULL(goods, 0) AS DECIMAL(24,7)) AS order_total, IFNULL(received, 0) AS received
FROM export_orders LEFT JOIN per_order ON oid = id""",
    "o_payments": """
SELECT oid AS export_order_id, received AS additional_received FROM per_order WHERE receipts > 0""",
    "settled": """
SELECT *, ROUND(order_total * advance_percentage * CAST(0.01 AS DECIMAL(3,2)), 2) AS opening_advance FROM o_totals""",
    "open_part": """
SELECT *, CAST(order_total - opening_advance - received AS DECIMAL(30,7)) AS unpaid FROM settled""",
    "balances": """
SELECT * EXCLUDE (received, unpaid), received AS additional_received,
  CASE WHEN unpaid > 0 THEN unpaid ELSE 0 END AS remaining_amount,
  CAST(order_total AS DECIMAL(30,7)) - CASE WHEN unpaid > 0 THEN unpaid ELSE 0 END AS paid_amount
FROM open_part""",
    "named_balances": """
SELECT balances.*, names.name AS client_name FROM balances JOIN (SELECT id AS nid, name FROM parties) names ON nid = client_id""",
    "alloc_active": """
SELECT export_order_item_id, SUM(quantity) AS allocated_quantity FROM shipment_allocations
WHERE shipment_id IN (SELECT id FROM shipments WHERE status <> 'cancelled') GROUP BY ALL""",
}
NEEDS = {"per_order": ["amounts"], "o_totals": ["per_order"], "o_payments": ["per_order"], "settled": ["o_totals"], "open_part": ["settled"],
         "balances": ["open_part"], "named_balances": ["balances"]}


def _with_needs(names) -> list[str]:
    """The named CTEs and what they are built on, in order."""
    out: list[str] = []
    for name in names:
        out += [n for n in [*_with_needs(NEEDS.get(name, [])), name] if n not in out]
    return out


def with_ctes(select: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prelude (domain views) + shared CTEs by name + query-specific CTEs + the final SELECT."""
    parts = [f"{n} AS ({SHARED_CTES[n].strip()})" for n in _with_needs(names)]
    parts += [f"{n} AS ({s.strip()})" for n, s in (extra or {}).items()]
    prelude = oracle_prelude().rstrip()
    if parts:
        prelude += ",\n" + ",\n".join(parts)
    return prelude + "\n" + select.strip()


BAL = ("balances",)
NBAL = ("named_balances",)
