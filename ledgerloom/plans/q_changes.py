"""Registered write pipelines: edits and ingests of whole batches as change rows and rejects.

Requests are one SQL text for both sides, over all rows of the given tables; what they do to the tables is
compared as change rows (``sources/changes.py``), one relation per query with a ``source`` column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import access as A
from ledgerloom.plans import ingest as I
from ledgerloom.plans.catalog import D, LINES, REQUESTS, register, with_ctes
from ledgerloom.plans.q_jobs import replay_parts
from ledgerloom.sources.changes import changes

_SECOND, _UNKNOWN = 2_000_000_000, 1_000_000_000


def _asked(t, sql: str, *tables: str) -> DataFrame:
    return t[tables[0]].sparkSession.sql(sql.format(**{n: "{" + n + "}" for n in tables}), **{n: t[n] for n in tables})


def _plain(sql: str, *tables: str) -> str:
    """The request text as the oracle reads it."""
    return sql.format(**{n: n for n in tables})


def _parts(**parts: DataFrame) -> DataFrame:
    """The parts under one another, told apart by ``source``; columns that a part lacks are NULL."""
    named = [df.select(F.lit(name).alias("source"), *df.columns) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def _rejected(df: DataFrame) -> DataFrame:
    return df.select(F.lit("rejected").alias("change"), F.col("request_id").alias("id"), "reason")


# ---------------------------------------------------------------- I2 contract edits

_EDIT_HEADER = """CAST(customs_consignee_id AS string) AS customs_consignee_id, CAST(bank_account_id AS string) AS bank_account_id,
  CAST(contract_date AS string) AS contract_date, CAST(valid_until AS string) AS valid_until,
  CASE id % 6 WHEN 0 THEN '  ' WHEN 1 THEN concat('ED-', CAST(id AS string)) ELSE sales_contract_number END AS sales_contract_number,
  CAST(CASE WHEN id % 5 = 0 THEN 100 - advance_percentage ELSE advance_percentage END AS string) AS advance_percentage"""
# Every contract; some once more later; some that do not exist.
EDIT_HEADERS = f"""
SELECT id AS request_id, id AS order_id, CAST(client_id + CASE WHEN id % 16 = 1 THEN 1 ELSE 0 END AS string) AS client_id, {_EDIT_HEADER},
  CASE WHEN id % 4 = 0 THEN 'CHF' ELSE currency END AS currency, port_of_destination FROM {{export_orders}}
UNION ALL
SELECT id + {_SECOND}, id, CAST(client_id AS string), {_EDIT_HEADER}, 'SEK', port_of_destination FROM {{export_orders}} WHERE id % 8 = 2
UNION ALL
SELECT id + {_UNKNOWN}, id + {_UNKNOWN}, CAST(client_id AS string), {_EDIT_HEADER}, currency, port_of_destination FROM {{export_orders}} WHERE id % 10 = 9"""
_EDIT_LINE = """line_number AS item_index, CAST(product_id AS string) AS product_id,
  CAST(CASE WHEN line_number % 2 = 0 THEN quantity * 2 ELSE quantity END AS string) AS quantity, quantity_unit,
  CAST(net_weight_per_carton AS string) AS net_weight_per_carton, CAST(gross_weight_per_carton AS string) AS gross_weight_per_carton,
  CAST(client_price_per_carton AS string) AS client_price_per_carton, CAST(customs_price_per_kg AS string) AS customs_price_per_kg, is_sample"""
EDIT_LINES = f"""
SELECT export_order_id AS request_id, {_EDIT_LINE} FROM {{export_order_items}}
UNION ALL
SELECT export_order_id + {_SECOND}, {_EDIT_LINE} FROM {{export_order_items}} WHERE export_order_id % 8 = 2
UNION ALL
SELECT export_order_id + {_UNKNOWN}, {_EDIT_LINE} FROM {{export_order_items}} WHERE export_order_id % 10 = 9"""

_ORDER_PARTS = {
    "asked": _plain(EDIT_HEADERS, "export_orders"),
    "asked_lines": f"""SELECT l.request_id, l.item_index, CAST(l.product_id AS BIGINT) AS product_id, CAST(l.quantity AS DECIMAL(12,3)) AS quantity,
        CAST(l.client_price_per_carton AS DECIMAL(14,4)) AS price, l.is_sample, p.units_per_carton AS units,
        CASE WHEN p.id IS NULL THEN 'product unavailable' WHEN NOT p.is_active THEN 'product inactive'
          WHEN COALESCE(p.units_per_carton, 0) = 0 THEN 'units per carton not set' END AS fault
      FROM ({_plain(EDIT_LINES, 'export_order_items')}) l LEFT JOIN products p ON p.id = CAST(l.product_id AS BIGINT)""",
    "line_facts": """SELECT request_id, MIN(fault) AS fault, bool_or(product_id = 0) AS nothing, CAST(SUM(CASE WHEN is_sample THEN 0 ELSE quantity * price END) AS DECIMAL(24,7)) AS total
      FROM asked_lines GROUP BY 1""",
    "sent": "SELECT DISTINCT i.export_order_id AS oid FROM shipment_allocations s JOIN export_order_items i ON i.id = s.export_order_item_id",
    "paid": "SELECT export_order_id AS oid, SUM(amount) AS got FROM order_payments GROUP BY 1",
    "judged": """SELECT a.*, CASE
        WHEN a.client_id = '0' OR a.bank_account_id IS NULL THEN 'invalid contract: ' || concat_ws(';',
          CASE WHEN a.client_id = '0' THEN 'client_id:must be positive' END, CASE WHEN a.bank_account_id IS NULL THEN 'bank_account_id:must be positive' END)
        WHEN f.nothing THEN 'invalid line: product_id:must be positive'
        WHEN f.request_id IS NULL THEN 'a contract needs a line'
        WHEN o.id IS NULL THEN 'order not found'
        WHEN o.status IN ('shipped', 'completed', 'cancelled') THEN 'shipped, completed or cancelled orders cannot be edited'
        WHEN a.order_id IN (SELECT oid FROM sent) THEN 'has shipment allocations'
        WHEN p.oid IS NOT NULL AND CAST(a.client_id AS BIGINT) <> o.client_id THEN 'client fixed once paid'
        WHEN ROUND(f.total * CAST(a.advance_percentage AS DECIMAL(5,2)) * CAST(0.01 AS DECIMAL(3,2)), 2) + COALESCE(p.got, 0) - f.total > 0.004
          THEN 'received payments would exceed the total'
        WHEN b.id IS NULL THEN 'select an active bank account'
        ELSE f.fault END AS reason
      FROM asked a LEFT JOIN line_facts f ON f.request_id = a.request_id LEFT JOIN export_orders o ON o.id = a.order_id
      LEFT JOIN paid p ON p.oid = a.order_id LEFT JOIN bank_accounts b ON b.is_active AND b.id = CAST(a.bank_account_id AS BIGINT)""",
    "standing": "SELECT * FROM judged WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY request_id DESC) = 1",
    "fresh": """SELECT s.order_id, l.*, CAST(SUM(CAST(floor(l.quantity) AS BIGINT)) OVER (PARTITION BY l.request_id ORDER BY l.item_index) AS BIGINT) AS upto,
        row_number() OVER (PARTITION BY l.request_id ORDER BY l.item_index) AS pos, row_number() OVER (ORDER BY l.request_id, l.item_index) AS n
      FROM standing s JOIN asked_lines l ON l.request_id = s.request_id""",
}


@register("apply_order_edits", with_ctes(
    f"""SELECT 'orders' AS source, 'updated' AS change, order_id AS id, CAST(client_id AS BIGINT) AS client_id, CAST(bank_account_id AS BIGINT) AS bank_account_id,
      CAST(contract_date AS DATE) AS contract_date, CAST(valid_until AS DATE) AS valid_until, NULLIF(trim(sales_contract_number), '') AS sales_contract_number,
      CAST(advance_percentage AS DOUBLE) AS advance_percentage, CAST(0 AS DOUBLE) AS freight_amount, currency, port_of_destination, CAST(NULL AS VARCHAR) AS final_destination,
      NULL AS export_order_id, NULL AS product_id, NULL AS line_number, NULL AS carton_start, NULL AS carton_end, CAST(NULL AS DOUBLE) AS quantity,
      CAST(NULL AS DOUBLE) AS units_per_carton, CAST(NULL AS DOUBLE) AS client_price_per_carton, NULL AS is_sample, NULL AS reason
    FROM standing
    UNION ALL BY NAME
    SELECT 'items' AS source, 'inserted' AS change, (SELECT MAX(id) FROM export_order_items) + n AS id, order_id AS export_order_id, product_id, CAST(pos AS INTEGER) AS line_number,
      IF(floor(quantity) = 0, NULL, upto - CAST(floor(quantity) AS BIGINT) + 1) AS carton_start, IF(floor(quantity) = 0, NULL, upto) AS carton_end,
      {D('quantity')} AS quantity, {D('units')} AS units_per_carton, {D('price')} AS client_price_per_carton, is_sample
    FROM fresh
    UNION ALL BY NAME
    SELECT 'items' AS source, 'deleted' AS change, id, export_order_id, product_id, line_number, {D('quantity')} AS quantity, {D('units_per_carton')} AS units_per_carton,
      {D('client_price_per_carton')} AS client_price_per_carton, is_sample
    FROM export_order_items WHERE export_order_id IN (SELECT order_id FROM standing)
    UNION ALL BY NAME
    SELECT 'requests' AS source, 'rejected' AS change, request_id AS id, reason FROM judged WHERE reason IS NOT NULL""", extra=_ORDER_PARTS), keep=LINES)
def q_apply_order_edits(t):
    """I2 (with G5 on proposed items, V4, S8, S11): every contract edited with all its lines, as change rows."""
    out, rejected = I.apply_order_edits(t, _asked(t, EDIT_HEADERS, "export_orders"), _asked(t, EDIT_LINES, "export_order_items"))
    orders = changes(t["export_orders"], out["export_orders"], ["id"]).select(
        "change", "id", "client_id", "bank_account_id", "contract_date", "valid_until", "sales_contract_number", "advance_percentage", "freight_amount",
        "currency", "port_of_destination", "final_destination")
    items = changes(t["export_order_items"], out["export_order_items"], ["id"]).select(
        "change", "id", "export_order_id", "product_id", "line_number", "carton_start", "carton_end", "quantity", "units_per_carton",
        "client_price_per_carton", "is_sample")
    return _parts(orders=orders, items=items, requests=_rejected(rejected))


# ---------------------------------------------------------------- I4 shipment edits

SHIP_HEADERS = """
SELECT id AS request_id, id AS shipment_id, CAST(client_id AS string) AS client_id, CAST(customs_consignee_id AS string) AS customs_consignee_id,
  CAST(also_notify_party_id AS string) AS also_notify_party_id, CAST(shipment_date AS string) AS shipment_date,
  CASE WHEN id % 4 = 0 THEN concat('GD ', CAST(id AS string)) ELSE ' ' END AS gd_number, CASE WHEN id % 12 = 0 THEN 'FI 7' END AS fi_number,
  CASE WHEN id % 2 = 0 THEN 'EUR' END AS currency FROM {shipments}"""
SHIP_CONTAINERS = """
SELECT shipment_id AS request_id, line_number AS container_index,
  CASE WHEN shipment_id % 17 = 0 THEN 'e-same' ELSE concat('E-', container_number) END AS container_number, container_type,
  CASE WHEN shipment_id % 23 = 0 AND line_number = 2 THEN '-1' ELSE '12.5' END AS cbm FROM {shipment_containers}"""
SHIP_ALLOCATIONS = """
SELECT shipment_id AS request_id, line_number AS alloc_index, CAST(export_order_item_id AS string) AS export_order_item_id,
  CAST(shipment_container_id % 10 AS string) AS container_index,
  CAST(CAST(quantity * CASE shipment_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.6 END AS decimal(12,3)) AS string) AS quantity FROM {shipment_allocations}"""

_SHIP_PARTS = {
    "heads": _plain(SHIP_HEADERS, "shipments"),
    "boxes": _plain(SHIP_CONTAINERS, "shipment_containers"),
    "loads": f"""SELECT request_id, alloc_index, CAST(export_order_item_id AS BIGINT) AS line, CAST(container_index AS INTEGER) AS container_index,
      CAST(quantity AS DECIMAL(12,3)) AS quantity FROM ({_plain(SHIP_ALLOCATIONS, 'shipment_allocations')}) a""",
    "early": """SELECT h.request_id, CASE
        WHEN s.status NOT IN ('draft', 'ready_to_ship') THEN 'only draft or ready-to-ship shipments can be edited'
        WHEN h.client_id = '0' OR (trim(h.gd_number) <> '' AND h.fi_number IS NOT NULL) THEN 'invalid shipment: ' || concat_ws(';',
          CASE WHEN h.client_id = '0' THEN 'client_id:must be positive' END,
          CASE WHEN trim(h.gd_number) <> '' AND h.fi_number IS NOT NULL THEN 'gd_number:select either a G.D. or an FI number' END)
        WHEN h.request_id IN (SELECT request_id FROM boxes WHERE cbm LIKE '-%') THEN 'invalid container: cbm:below 0'
        WHEN h.request_id IN (SELECT request_id FROM loads WHERE quantity <= 0) THEN 'invalid allocation: quantity:must be positive'
        WHEN h.request_id IN (SELECT request_id FROM boxes GROUP BY 1 HAVING COUNT(DISTINCT lower(container_number)) < COUNT(*)) THEN 'container numbers must be unique'
      END AS reason FROM heads h JOIN shipments s ON s.id = h.shipment_id""",
} | replay_parts("SELECT l.request_id, CAST(h.client_id AS BIGINT) AS client_id, h.shipment_id AS ship, l.line, l.quantity AS need FROM loads l "
                 "JOIN heads h ON h.request_id = l.request_id WHERE l.request_id IN (SELECT request_id FROM early WHERE reason IS NULL)") | {
    "won": "SELECT h.* FROM heads h JOIN play p ON p.request_id = h.request_id WHERE p.turn > 0 AND p.reason IS NULL",
    "new_boxes": """SELECT b.*, row_number() OVER (ORDER BY request_id, container_index) + (SELECT MAX(id) FROM shipment_containers) AS id,
        row_number() OVER (PARTITION BY request_id ORDER BY container_index) AS pos FROM boxes b WHERE request_id IN (SELECT request_id FROM won)""",
}


@register("apply_shipment_edits", with_ctes(
    f"""SELECT 'shipments' AS source, 'updated' AS change, w.shipment_id AS id, CAST(w.shipment_date AS DATE) AS shipment_date, NULLIF(trim(w.gd_number), '') AS gd_number,
      w.fi_number, COALESCE(w.currency, 'USD') AS currency, b.container_number, b.container_type, CAST(b.cbm AS DOUBLE) AS cbm, NULL AS shipment_id,
      NULL AS line_number, NULL AS shipment_container_id, NULL AS export_order_item_id, CAST(NULL AS DOUBLE) AS quantity, NULL AS reason
    FROM won w JOIN new_boxes b ON b.request_id = w.request_id AND b.pos = 1
    UNION ALL BY NAME
    SELECT 'containers' AS source, 'inserted' AS change, id, request_id AS shipment_id, CAST(pos AS INTEGER) AS line_number, container_number, container_type, CAST(cbm AS DOUBLE) AS cbm
    FROM new_boxes
    UNION ALL BY NAME
    SELECT 'containers' AS source, 'deleted' AS change, id, shipment_id, line_number, container_number, container_type, {D('cbm')} AS cbm
    FROM shipment_containers WHERE shipment_id IN (SELECT shipment_id FROM won)
    UNION ALL BY NAME
    SELECT 'allocations' AS source, 'inserted' AS change, (SELECT MAX(id) FROM shipment_allocations) + row_number() OVER (ORDER BY l.request_id, l.alloc_index) AS id,
      l.request_id AS shipment_id, CAST(row_number() OVER (PARTITION BY l.request_id ORDER BY l.alloc_index) AS INTEGER) AS line_number, b.id AS shipment_container_id,
      l.line AS export_order_item_id, {D('l.quantity')} AS quantity
    FROM loads l JOIN new_boxes b ON b.request_id = l.request_id AND b.container_index = l.container_index
    UNION ALL BY NAME
    SELECT 'allocations' AS source, 'deleted' AS change, id, shipment_id, line_number, shipment_container_id, export_order_item_id, {D('quantity')} AS quantity
    FROM shipment_allocations WHERE shipment_id IN (SELECT shipment_id FROM won)
    UNION ALL BY NAME
    SELECT 'requests' AS source, 'rejected' AS change, request_id AS id, reason
    FROM (SELECT request_id, reason FROM early UNION ALL SELECT request_id, reason FROM play WHERE turn > 0) r WHERE reason IS NOT NULL""",
    extra=_SHIP_PARTS).replace("WITH ", "WITH RECURSIVE ", 1), keep=LINES)
def q_apply_shipment_edits(t):
    """I4 (with V2, V6, G3, S11): every shipment edited with its containers and allocations, as change rows."""
    out, rejected = I.apply_shipment_edits(t, _asked(t, SHIP_HEADERS, "shipments"), _asked(t, SHIP_CONTAINERS, "shipment_containers"),
                                           _asked(t, SHIP_ALLOCATIONS, "shipment_allocations"))
    heads = changes(t["shipments"], out["shipments"], ["id"]).select(
        "change", "id", "shipment_date", "gd_number", "fi_number", "currency", "container_number", "container_type", "cbm")
    boxes = changes(t["shipment_containers"], out["shipment_containers"], ["id"]).select(
        "change", "id", "shipment_id", "line_number", "container_number", "container_type", "cbm")
    loads = changes(t["shipment_allocations"], out["shipment_allocations"], ["id"]).select(
        "change", "id", "shipment_id", "line_number", "shipment_container_id", "export_order_item_id", "quantity")
    return _parts(shipments=heads, containers=boxes, allocations=loads, requests=_rejected(rejected))


# ---------------------------------------------------------------- I5 roles

ROLE_REQUESTS = """
SELECT id AS request_id, CASE id % 7 WHEN 0 THEN 'Viewer' WHEN 1 THEN ' x ' ELSE concat(' Desk ', CAST(CAST(floor(id / 3) AS bigint) AS string)) END AS name,
  CASE WHEN id % 2 = 0 THEN concat(' for ', email) END AS description FROM {users}"""
ROLE_GRANTS = """
SELECT u.id AS request_id, u.id * k.k % 31 + 1 AS permission_id FROM {users} u
JOIN (SELECT 1 AS k, 1 AS one UNION ALL SELECT 2, 1 UNION ALL SELECT 32, 1) k ON k.one = 1"""

_ROLE_PARTS = {
    "asked": _plain(ROLE_REQUESTS, "users"),
    "judged": """SELECT request_id, trim(name) AS name, trim(description) AS description, CASE WHEN length(trim(name)) < 2 THEN 'invalid role: name:shorter than 2'
        WHEN trim(name) IN (SELECT name FROM roles) OR row_number() OVER (PARTITION BY trim(name) ORDER BY request_id) > 1 THEN 'role name already exists' END AS reason
      FROM asked""",
    "made": "SELECT *, (SELECT MAX(id) FROM roles) + row_number() OVER (ORDER BY request_id) AS id FROM judged WHERE reason IS NULL",
}


@register("ingest_roles", with_ctes(
    f"""SELECT 'roles' AS source, 'inserted' AS change, id, name, description, NULL AS permission_id, NULL AS reason FROM made
    UNION ALL BY NAME
    SELECT DISTINCT 'grants' AS source, 'inserted' AS change, m.id, g.permission_id
    FROM made m JOIN ({_plain(ROLE_GRANTS, 'users')}) g ON g.request_id = m.request_id
    UNION ALL BY NAME
    SELECT 'requests' AS source, 'rejected' AS change, request_id AS id, reason FROM judged WHERE reason IS NOT NULL""", extra=_ROLE_PARTS))
def q_ingest_roles(t):
    """A role with its permissions asked for by every user, as change rows."""
    out, rejected = I.ingest_roles(t, _asked(t, ROLE_REQUESTS, "users"), _asked(t, ROLE_GRANTS, "users"))
    roles = changes(t["roles"], out["roles"], ["id"]).select("change", "id", "name", "description")
    grants = changes(t["role_permissions"], out["role_permissions"], ["role_id", "permission_id"]).select(
        "change", F.col("role_id").alias("id"), "permission_id")
    return _parts(roles=roles, grants=grants, requests=_rejected(rejected))


@register("role_matrix_after_ingest", with_ctes(
    f"""SELECT r.id, r.name, COALESCE(array_to_string(list_sort(list_distinct(list(p.permission_key) FILTER (p.permission_key IS NOT NULL))), ','), '') AS permission_keys
    FROM (SELECT CAST(id AS BIGINT) AS id, name FROM roles UNION ALL SELECT id, name FROM made) r
    LEFT JOIN (SELECT CAST(role_id AS BIGINT) AS rid, permission_id FROM role_permissions UNION ALL
      SELECT m.id, g.permission_id FROM made m JOIN ({_plain(ROLE_GRANTS, 'users')}) g ON g.request_id = m.request_id) g ON g.rid = r.id
    LEFT JOIN permissions p ON p.id = g.permission_id GROUP BY r.id, r.name""", extra=_ROLE_PARTS))
def q_role_matrix_after_ingest(t):
    """A20 over roles made from the given users (I5): role -> sorted permission keys."""
    out, _ = I.ingest_roles(t, _asked(t, ROLE_REQUESTS, "users"), _asked(t, ROLE_GRANTS, "users"))
    return A.role_permissions_matrix(out).select("id", "name", "permission_keys")


# ---------------------------------------------------------------- I1, I3 with headers, lines and rejects

_NEW_PARTS = {k: v for k, v in _ORDER_PARTS.items() if k in ("asked", "asked_lines", "line_facts")} | {
    "judged": """SELECT a.*, CASE WHEN a.client_id = '0' OR a.bank_account_id IS NULL THEN 'invalid contract: ' || concat_ws(';',
          CASE WHEN a.client_id = '0' THEN 'client_id:must be positive' END, CASE WHEN a.bank_account_id IS NULL THEN 'bank_account_id:must be positive' END)
        WHEN f.nothing THEN 'invalid line: product_id:must be positive' WHEN f.request_id IS NULL THEN 'a contract needs a line'
        WHEN b.id IS NULL THEN 'select an active bank account' ELSE f.fault END AS reason
      FROM asked a LEFT JOIN line_facts f ON f.request_id = a.request_id LEFT JOIN bank_accounts b ON b.is_active AND b.id = CAST(a.bank_account_id AS BIGINT)""",
    "made": "SELECT *, row_number() OVER (ORDER BY request_id) AS n FROM judged WHERE reason IS NULL",
    "lines": """SELECT m.n AS parent, l.*, row_number() OVER (PARTITION BY l.request_id ORDER BY item_index) AS pos, row_number() OVER (ORDER BY l.request_id, item_index) AS n,
        CAST(SUM(CAST(floor(quantity) AS BIGINT)) OVER (PARTITION BY l.request_id ORDER BY item_index) AS BIGINT) AS upto
      FROM made m JOIN asked_lines l ON l.request_id = m.request_id""",
}


@register("ingest_orders_changes", with_ctes(
    f"""SELECT 'orders' AS source, 'inserted' AS change, (SELECT MAX(id) FROM export_orders) + n AS id, printf('NEW-%03d/2024', n) AS invoice_number, 'draft' AS status,
      CAST(1 AS BIGINT) AS created_by, CAST(client_id AS BIGINT) AS client_id, CAST(bank_account_id AS BIGINT) AS bank_account_id, CAST(contract_date AS DATE) AS contract_date,
      NULLIF(trim(sales_contract_number), '') AS sales_contract_number, CAST(advance_percentage AS DOUBLE) AS advance_percentage, currency, NULL AS export_order_id,
      NULL AS product_id, NULL AS line_number, NULL AS carton_start, NULL AS carton_end, CAST(NULL AS DOUBLE) AS quantity, CAST(NULL AS DOUBLE) AS units_per_carton, NULL AS reason
    FROM made
    UNION ALL BY NAME
    SELECT 'items' AS source, 'inserted' AS change, (SELECT MAX(id) FROM export_order_items) + n AS id, (SELECT MAX(id) FROM export_orders) + parent AS export_order_id, product_id,
      CAST(pos AS INTEGER) AS line_number, IF(floor(quantity) = 0, NULL, upto - CAST(floor(quantity) AS BIGINT) + 1) AS carton_start, IF(floor(quantity) = 0, NULL, upto) AS carton_end,
      {D('quantity')} AS quantity, {D('units')} AS units_per_carton FROM lines
    UNION ALL BY NAME
    SELECT 'requests' AS source, 'rejected' AS change, request_id AS id, reason FROM judged WHERE reason IS NOT NULL""", extra=_NEW_PARTS), keep=LINES)
def q_ingest_orders_changes(t):
    """I1 whole: every contract sent in as a new request; headers, lines with cartons, and rejects."""
    headers = _asked(t, EDIT_HEADERS, "export_orders").drop("order_id")
    out, rejected = I.ingest_orders(t, headers, _asked(t, EDIT_LINES, "export_order_items"), "NEW", 2024, created_by=1)
    orders = changes(t["export_orders"], out["export_orders"], ["id"]).select(
        "change", "id", "invoice_number", "status", "created_by", "client_id", "bank_account_id", "contract_date", "sales_contract_number", "advance_percentage", "currency")
    items = changes(t["export_order_items"], out["export_order_items"], ["id"]).select(
        "change", "id", "export_order_id", "product_id", "line_number", "carton_start", "carton_end", "quantity", "units_per_carton")
    return _parts(orders=orders, items=items, requests=_rejected(rejected))


_LOADED = """SELECT request_id, MAX(client_id) AS client_id FROM shipment_requests GROUP BY 1"""
_SHIP_FAULTS = """SELECT l.request_id, CASE WHEN l.client_id = 0 THEN 'invalid shipment: client_id:must be positive'
      WHEN b.request_id IS NULL THEN 'a shipment needs a container' WHEN b.numbers < b.boxes THEN 'container numbers must be unique'
      WHEN a.unknown THEN 'allocation references an unavailable container' WHEN a.twice THEN 'a line may appear once per container'
      WHEN a.used < b.boxes THEN 'every container needs an allocation' END AS reason
    FROM loaded l LEFT JOIN (SELECT request_id, COUNT(*) AS boxes, COUNT(DISTINCT lower(container_number)) AS numbers FROM request_containers GROUP BY 1) b ON b.request_id = l.request_id
    LEFT JOIN (SELECT request_id, bool_or(NOT there) AS unknown, bool_or(n > 1) AS twice, COUNT(DISTINCT container_index) FILTER (WHERE there) AS used FROM (
        SELECT request_id, container_index, export_order_item_id, COUNT(*) AS n,
          (request_id, container_index) IN (SELECT (request_id, container_index) FROM request_containers) AS there FROM shipment_requests GROUP BY 1, 2, 3) GROUP BY 1) a
      ON a.request_id = l.request_id"""


@register("ingest_shipments_changes", with_ctes(
    f"""SELECT 'shipments' AS source, 'inserted' AS change, (SELECT MAX(id) FROM shipments) + n AS id, printf('SHP-%03d/2024', n) AS shipment_number, 'draft' AS status, client_id,
      container_number, container_type, CAST(1.5 AS DOUBLE) AS cbm, NULL AS shipment_id, NULL AS line_number, NULL AS shipment_container_id, NULL AS export_order_item_id,
      CAST(NULL AS DOUBLE) AS quantity, NULL AS reason FROM made JOIN boxes USING (request_id) WHERE pos = 1
    UNION ALL BY NAME
    SELECT 'containers' AS source, 'inserted' AS change, box_id AS id, (SELECT MAX(id) FROM shipments) + n AS shipment_id, CAST(pos AS INTEGER) AS line_number, container_number,
      container_type, CAST(1.5 AS DOUBLE) AS cbm FROM made JOIN boxes USING (request_id)
    UNION ALL BY NAME
    SELECT 'allocations' AS source, 'inserted' AS change, (SELECT MAX(id) FROM shipment_allocations) + row_number() OVER (ORDER BY r.request_id, r.export_order_item_id) AS id,
      (SELECT MAX(id) FROM shipments) + m.n AS shipment_id, CAST(row_number() OVER (PARTITION BY r.request_id ORDER BY r.export_order_item_id) AS INTEGER) AS line_number,
      box_id AS shipment_container_id, r.export_order_item_id, {D('r.quantity')} AS quantity
    FROM shipment_requests r JOIN made m ON m.request_id = r.request_id JOIN boxes b ON b.request_id = r.request_id AND b.container_index = r.container_index
    UNION ALL BY NAME
    SELECT 'requests' AS source, 'rejected' AS change, request_id AS id, reason
    FROM (SELECT * FROM faults UNION ALL SELECT request_id, reason FROM play WHERE turn > 0) f WHERE reason IS NOT NULL""",
    extra={"loaded": _LOADED, "faults": _SHIP_FAULTS} | replay_parts(
        "SELECT request_id, client_id, CAST(NULL AS BIGINT) AS ship, export_order_item_id AS line, quantity AS need FROM shipment_requests "
        "WHERE request_id IN (SELECT request_id FROM faults WHERE reason IS NULL)") | {
        "made": "SELECT request_id, client_id, row_number() OVER (ORDER BY request_id) AS n FROM play WHERE turn > 0 AND reason IS NULL",
        "boxes": """SELECT request_id, container_index, container_number, CAST(NULL AS VARCHAR) AS container_type, row_number() OVER (PARTITION BY request_id ORDER BY container_index) AS pos,
            (SELECT MAX(id) FROM shipment_containers) + row_number() OVER (ORDER BY request_id, container_index) AS box_id
          FROM request_containers WHERE request_id IN (SELECT request_id FROM made)"""}).replace("WITH ", "WITH RECURSIVE ", 1), keep=REQUESTS)
def q_ingest_shipments_changes(t):
    """I3 whole: every shipment request; headers, containers, allocations with line numbers, and rejects."""
    r = t["shipment_requests"]
    requests = r.groupBy("request_id").agg(F.max("client_id").cast("string").alias("client_id")).withColumns({
        "customs_consignee_id": F.lit("1000000001"), "shipment_date": F.lit("2024-04-01"), "gd_number": F.lit("GD"), "currency": F.lit(None).cast("string")})
    boxes = t["request_containers"].withColumn("cbm", F.lit("1.5"))
    loads = r.select("request_id", F.col("export_order_item_id").alias("alloc_index"),
                     *[F.col(c).cast("string").alias(c) for c in ("export_order_item_id", "container_index", "quantity")])
    out, rejected = I.ingest_shipments(t, requests, boxes, loads, 2024, created_by=1)
    heads = changes(t["shipments"], out["shipments"], ["id"]).select("change", "id", "shipment_number", "status", "client_id", "container_number", "container_type", "cbm")
    made = changes(t["shipment_containers"], out["shipment_containers"], ["id"]).select(
        "change", "id", "shipment_id", "line_number", "container_number", "container_type", "cbm")
    packed = changes(t["shipment_allocations"], out["shipment_allocations"], ["id"]).select(
        "change", "id", "shipment_id", "line_number", "shipment_container_id", "export_order_item_id", "quantity")
    return _parts(shipments=heads, containers=made, allocations=packed, requests=_rejected(rejected))


# ---------------------------------------------------------------- I6 products

_PRODUCT_FIELDS = """CASE WHEN id % 10 = 3 THEN ' q' ELSE concat(name, ' II') END AS name, description, hs_code,
  CASE WHEN package_type = 'Carton' AND id % 3 > 0 THEN NULL ELSE package_type END AS package_type, CAST(units_per_carton AS string) AS units_per_carton,
  CAST(pieces_per_unit AS string) AS pieces_per_unit, CASE WHEN id % 4 = 0 THEN ' ' ELSE CAST(unit_weight_grams AS string) END AS unit_weight_grams,
  CAST(default_client_price AS string) AS default_client_price, packaging_details"""
PRODUCT_REQUESTS = f"""
SELECT id AS request_id, CASE id % 8 WHEN 0 THEN sku WHEN 1 THEN ' ' WHEN 2 THEN concat('NEW-', CAST(CAST(floor(id / 16) AS bigint) AS string))
  ELSE concat('N-', CAST(id AS string)) END AS sku, {_PRODUCT_FIELDS} FROM {{products}}"""
PRODUCT_EDITS = f"""
SELECT id * 2 AS request_id, id AS product_id, CASE id % 8 WHEN 0 THEN concat('SKU-', CAST(id + 1 AS string))
  WHEN 2 THEN concat('NEW-', CAST(CAST(floor(id / 16) AS bigint) AS string)) ELSE sku END AS sku, {_PRODUCT_FIELDS} FROM {{products}}
UNION ALL
SELECT id * 2 + 1, CASE WHEN id % 20 = 0 THEN -id ELSE id END, concat('LATER-', CAST(id AS string)), {_PRODUCT_FIELDS} FROM {{products}} WHERE id % 5 = 0"""


def _judged_products(asked: str) -> dict[str, str]:
    def count(key: str) -> str:
        return f"CAST(COALESCE(TRY_CAST(json_extract_string(CASE WHEN json_valid(packaging_details) THEN packaging_details END, '$.{key}') AS DECIMAL(12,3)), 0) AS BIGINT)"
    return {"asked": asked, "typed": f"""
      SELECT * EXCLUDE (sku, name, package_type, unit_weight_grams, packaging_details), NULLIF(trim(sku), '') AS sku, trim(name) AS name, COALESCE(package_type, 'Jar') AS package_type,
        CAST(COALESCE(NULLIF(trim(unit_weight_grams), ''), '0') AS DECIMAL(12,3)) AS unit_weight_grams,
        printf('{{"pieces_per_pack":%d,"packs_per_carton":%d}}', {count('pieces_per_pack')}, {count('packs_per_carton')}) AS packaging_details,
        concat_ws(';', CASE WHEN length(trim(name)) < 2 THEN 'name:shorter than 2' END, CASE WHEN package_type = 'Carton' THEN 'package_type:not allowed' END) AS faults
      FROM asked"""}


_PRODUCT_OUT = f"""sku, name, description, hs_code, package_type, {D('CAST(units_per_carton AS DECIMAL(12,3))')} AS units_per_carton,
  {D('CAST(pieces_per_unit AS DECIMAL(12,3))')} AS pieces_per_unit, {D('unit_weight_grams')} AS unit_weight_grams,
  {D('CAST(default_client_price AS DECIMAL(14,4))')} AS default_client_price, packaging_details"""
_PRODUCT_COLUMNS = ["sku", "name", "description", "hs_code", "package_type", "units_per_carton", "pieces_per_unit", "unit_weight_grams", "default_client_price",
                    "packaging_details", "is_active"]


@register("ingest_products", with_ctes(
    f"""SELECT 'products' AS source, 'inserted' AS change, (SELECT MAX(id) FROM products) + row_number() OVER (ORDER BY request_id) AS id, {_PRODUCT_OUT},
      TRUE AS is_active, NULL AS reason FROM judged WHERE reason IS NULL
    UNION ALL BY NAME
    SELECT 'requests' AS source, 'rejected' AS change, request_id AS id, reason FROM judged WHERE reason IS NOT NULL""",
    extra=_judged_products(_plain(PRODUCT_REQUESTS, "products")) | {"judged": """
      SELECT *, CASE WHEN faults <> '' THEN 'invalid product: ' || faults WHEN sku IN (SELECT sku FROM products)
        OR (sku IS NOT NULL AND row_number() OVER (PARTITION BY sku, faults = '' ORDER BY request_id) > 1) THEN 'sku already exists' END AS reason FROM typed"""}))
def q_ingest_products(t):
    """A successor of every product, as change rows."""
    out, rejected = I.ingest_products(t, _asked(t, PRODUCT_REQUESTS, "products"))
    rows = changes(t["products"], out["products"], ["id"]).select("change", "id", *_PRODUCT_COLUMNS)
    return _parts(products=rows, requests=_rejected(rejected))


@register("apply_product_edits", with_ctes(
    f"""SELECT 'products' AS source, 'updated' AS change, product_id AS id, {_PRODUCT_OUT},
      (SELECT is_active FROM products p WHERE p.id = product_id) AS is_active, NULL AS reason
    FROM judged WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY request_id DESC) = 1
    UNION ALL BY NAME
    SELECT 'requests' AS source, 'rejected' AS change, request_id AS id, reason FROM judged WHERE reason IS NOT NULL""",
    extra=_judged_products(_plain(PRODUCT_EDITS, "products")) | {
        "sound": "SELECT * FROM typed WHERE faults = '' AND product_id IN (SELECT id FROM products)",
        "judged": """SELECT t.*, CASE WHEN faults <> '' THEN 'invalid product: ' || faults WHEN product_id NOT IN (SELECT id FROM products) THEN 'product not found'
          WHEN EXISTS (SELECT 1 FROM products p WHERE p.sku = t.sku AND p.id <> t.product_id)
            OR product_id <> (SELECT arg_min(s.product_id, s.request_id) FROM sound s WHERE s.sku = t.sku) THEN 'sku already exists' END AS reason FROM typed t"""}))
def q_apply_product_edits(t):
    """I6 (update form): every product edited, some twice, some unknown, as change rows."""
    out, rejected = I.apply_product_edits(t, _asked(t, PRODUCT_EDITS, "products"))
    rows = changes(t["products"], out["products"], ["id"]).select("change", "id", *_PRODUCT_COLUMNS)
    return _parts(products=rows, requests=_rejected(rejected))
