"""Tiny literal ledgers for unit tests (FIXTURES part B)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as Dm

from ledgerloom.sources.tables import Tables

D = dt.date

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

ORDERS = ("id bigint, invoice_number string, client_id bigint, customs_consignee_id bigint, bank_account_id bigint, "
          "clearing_agent_id bigint, status string, contract_date date, valid_until date, "
          "sales_contract_number string, advance_percentage decimal(5,2), currency string, sequence_year int, "
          "sequence_number int, port_of_destination string, final_destination string")
ITEMS = ("id bigint, export_order_id bigint, product_id bigint, line_number int, quantity decimal(12,3), "
         "quantity_unit string, units_per_carton decimal(12,3), net_weight_per_carton decimal(12,3), "
         "gross_weight_per_carton decimal(12,3), client_price_per_carton decimal(14,4), "
         "customs_price_per_kg decimal(14,4), is_sample boolean")
PAYMENTS = ("id bigint, export_order_id bigint, amount decimal(14,2), payment_date date, reference_number string, "
            "notes string, created_by bigint")
PARTIES = "id bigint, party_type string, name string, country string, contact_person string, phone string, " \
          "email string, address_line_1 string, city string, is_active boolean"
USERS = "id bigint, name string, email string, role_id bigint, is_active boolean"
SHIPMENTS = "id bigint, shipment_number string, client_id bigint, customs_consignee_id bigint, " \
            "also_notify_party_id bigint, clearing_agent_id bigint, status string, shipment_date date, " \
            "sequence_year int, sequence_number int, currency string"
CONTAINERS = "id bigint, shipment_id bigint, line_number int, container_number string, container_type string, " \
             "cbm decimal(12,3)"
ALLOCS = "id bigint, shipment_id bigint, shipment_container_id bigint, export_order_item_id bigint, " \
         "line_number int, quantity decimal(12,3)"
PRODUCTS = "id bigint, sku string, name string, description string, hs_code string, package_type string, " \
           "units_per_carton decimal(12,3), pieces_per_unit decimal(12,3), packaging_details string, " \
           "unit_weight_grams decimal(12,3), default_client_price decimal(14,4), is_active boolean"
BANKS = "id bigint, account_name string, currency string, is_active boolean"


def order(i, client=1, status="confirmed", date=D(2024, 1, 10), valid=None, pct="0", currency="USD", scn=None,
          bank=1, year=2024, seq=1):
    return (i, f"INV-{i}", client, 100, bank, None, status, date, valid, scn, Dm(pct), currency, year, seq, "Hamburg", None)


def item(i, order_id, qty, price, sample=False, product=1, line=1, net="1", gross="1.5", customs="0.5", units="6"):
    return (i, order_id, product, line, Dm(qty), "CTN", Dm(units), Dm(net), Dm(gross), Dm(price), Dm(customs), sample)


def payment(i, order_id, amount, date=D(2024, 2, 1), user=1):
    return (i, order_id, Dm(amount), date, f"R{i}", f"note {i}", user)


def ledger(spark, orders=(), items=(), payments=(), parties=None, users=None, shipments=(), containers=(),
           allocations=(), products=None, banks=None) -> Tables:
    mk = spark.createDataFrame
    parties = parties if parties is not None else [
        (1, "client", "Acme", "PK", "c1", "p1", None, "a1", "x", True),
        (2, "client", "Bolt", "AE", "c2", "p2", None, "a2", "y", True),
        (3, "client", "Dormant", "AE", "c3", "p3", None, "a3", "y", False),
        (100, "customs_consignee", "Cons", "PK", "c", "p", None, "a", "x", True),
    ]
    users = users if users is not None else [(1, "user-1", "u1@x.test", 1, True), (2, "user-2", "u2@x.test", 4, True)]
    products = products if products is not None else [
        (1, "SKU-1", "Mango Pickle", "d", "hs", "Jar", Dm("6"), Dm("12"), None, Dm("100"), Dm("10"), True)]
    banks = banks if banks is not None else [(1, "Main USD", "USD", True), (2, "Closed", "USD", False)]
    from ledgerloom.sources.testdata import PERMISSIONS, ROLES, role_permission_pairs
    perms = [(i + 1, k, m, a) for i, (k, m, a) in enumerate(PERMISSIONS)]
    return Tables(
        permissions=mk(perms, "id bigint, permission_key string, module_name string, action_name string"),
        roles=mk(ROLES, "id bigint, name string"),
        role_permissions=mk(role_permission_pairs(), "role_id bigint, permission_id bigint"),
        export_orders=mk(list(orders), ORDERS), export_order_items=mk(list(items), ITEMS),
        order_payments=mk(list(payments), PAYMENTS), parties=mk(parties, PARTIES), users=mk(users, USERS),
        shipments=mk(list(shipments), SHIPMENTS), shipment_containers=mk(list(containers), CONTAINERS),
        shipment_allocations=mk(list(allocations), ALLOCS), products=mk(products, PRODUCTS),
        bank_accounts=mk(banks, BANKS))
