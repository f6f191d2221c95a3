"""Domain views over the driver's TPC-H-like parquet tables.

Each view is written once, as SQL over ``{placeholder}`` table names.  Spark runs it through
``spark.sql(text, **dataframes)`` (the placeholders become the scanned DataFrames, so Catalyst still
prunes columns and pushes filters into the parquet scans); the DuckDB oracle inlines the very same
text as a CTE.  Literal braces are doubled because both sides format the template.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import STEP_SETTINGS, stored

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# (view name, SQL template).  Order = dependency order.
VIEWS: list[tuple[str, str]] = [
    ("export_orders", """
SELECT o_orderkey AS id,
  concat('INV-', cast(o_orderkey AS string)) AS invoice_number,
  o_custkey AS client_id,
  1000000000 + o_custkey % 10 AS customs_consignee_id,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey % 25 + 1 END AS bank_account_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 2000000000 + 4 * (1 + o_custkey % 2) ELSE NULL END AS clearing_agent_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'draft' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'in_production'
    WHEN 3 THEN 'ready_to_ship' WHEN 4 THEN 'shipped' WHEN 5 THEN 'completed' ELSE 'cancelled' END AS status,
  cast(o_orderdate AS date) AS contract_date,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL
    ELSE cast(cast(o_orderdate AS date) + INTERVAL 30 DAY AS date) END AS valid_until,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  '
    ELSE concat('SC-', cast(o_orderkey AS string)) END AS sales_contract_number,
  cast(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 10 WHEN '3' THEN 25
    WHEN '4' THEN 33.33 ELSE 100 END AS decimal(5,2)) AS advance_percentage,
  CASE o_orderstatus WHEN 'F' THEN 'USD' WHEN 'O' THEN 'EUR' ELSE 'GBP' END AS currency,
  concat('Port ', cast(o_custkey % 7 AS string)) AS port_of_destination,
  CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE concat('City ', cast(o_custkey % 11 AS string)) END AS final_destination,
  cast(year(o_orderdate) AS int) AS sequence_year,
  cast(o_orderkey % 997 + 1 AS int) AS sequence_number,
  cast(concat(cast(cast(o_orderdate AS date) AS string), ' 0', cast(o_orderkey % 9 AS string), ':15:00') AS timestamp) AS created_at
FROM {orders}"""),
    ("export_order_items", """
SELECT l_orderkey * 1000 + line_number AS id,
  l_orderkey AS export_order_id,
  l_partkey AS product_id,
  cast(line_number AS int) AS line_number,
  cast(CASE WHEN l_linenumber = 7 THEN l_quantity / 4 ELSE l_quantity END AS decimal(12,3)) AS quantity,
  'CTN' AS quantity_unit,
  cast(l_partkey % 12 + 1 AS decimal(12,3)) AS units_per_carton,
  cast(l_tax * 100 + 1 AS decimal(12,3)) AS net_weight_per_carton,
  cast(l_tax * 100 + 1.25 AS decimal(12,3)) AS gross_weight_per_carton,
  cast(cast(l_extendedprice AS decimal(14,2)) * cast(0.01 AS decimal(3,2)) AS decimal(14,4)) AS client_price_per_carton,
  cast(l_discount AS decimal(14,4)) AS customs_price_per_kg,
  (l_returnflag = 'A' AND l_linenumber = 1) AS is_sample,
  CASE WHEN l_partkey % 6 = 0 THEN concat('Special ', cast(l_partkey AS string)) END AS description_override,
  l_shipdate, l_returnflag, l_linestatus, l_linenumber
FROM (
  SELECT l_orderkey, l_partkey, l_quantity, l_tax, l_extendedprice, l_discount, l_returnflag,
    l_linestatus, l_linenumber, l_shipdate,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
      l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS line_number
  FROM {lineitem}) numbered"""),
    ("order_payments", """
SELECT event_id AS id,
  event_id - event_id % 10 AS export_order_id,
  cast(cast(value AS decimal(10,2)) * 97 AS decimal(14,2)) AS amount,
  cast(ts AS date) AS payment_date,
  concat('REF-', cast(event_id AS string)) AS reference_number,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('Note ', cast(user_id AS string)) END AS notes,
  user_id AS created_by
FROM {events}
WHERE event_type = 'purchase'"""),
    ("parties", """
SELECT c_custkey AS id, 'client' AS party_type, c_name AS name, n_name AS country,
  concat('Contact ', cast(c_custkey AS string)) AS contact_person,
  concat('+00-', cast(c_custkey AS string)) AS phone,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('c', cast(c_custkey AS string), '@example.test') END AS email,
  concat('Street ', cast(c_nationkey AS string)) AS address_line_1,
  n_name AS city,
  c_acctbal >= 0 AS is_active
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL
SELECT 1000000000 + s_suppkey, 'customs_consignee', s_name, n_name,
  concat('Contact ', cast(s_suppkey AS string)), concat('+00-', cast(s_suppkey AS string)),
  concat('s', cast(s_suppkey AS string), '@example.test'),
  concat('Street ', cast(s_nationkey AS string)), n_name, s_acctbal >= 0
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL
SELECT 2000000000 + s_suppkey, 'clearing_agent', concat('Agent ', s_name), n_name,
  concat('Agent contact ', cast(s_suppkey AS string)), concat('+00-9', cast(s_suppkey AS string)),
  CAST(NULL AS string),
  concat('Street ', cast(s_nationkey AS string)), n_name, s_suppkey % 8 <> 0
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
WHERE s_suppkey % 4 = 0"""),
    ("products", """
SELECT p_partkey AS id,
  concat('SKU-', cast(p_partkey AS string)) AS sku,
  p_name AS name,
  p_type AS description,
  concat('HS-', p_brand) AS hs_code,
  CASE p_size % 4 WHEN 0 THEN 'Carton' WHEN 1 THEN 'Jar' WHEN 2 THEN 'Pouch' ELSE 'Box' END AS package_type,
  cast(p_size % 13 AS decimal(12,3)) AS units_per_carton,
  cast(p_size AS decimal(12,3)) AS pieces_per_unit,
  CASE p_partkey % 5 WHEN 0 THEN NULL
    WHEN 1 THEN '{{"pieces_per_pack": 10, "packs_per_carton": 6}}'
    WHEN 2 THEN '{{"pieces_per_box": 12, "jars_per_carton": 4}}'
    WHEN 3 THEN '{{}}' ELSE 'not json' END AS packaging_details,
  cast(p_size * 25 AS decimal(12,3)) AS unit_weight_grams,
  cast(p_retailprice AS decimal(14,4)) AS default_client_price,
  CASE WHEN p_partkey % 3 = 0 THEN concat('/images/', cast(p_partkey AS string), '.jpg') END AS image_url,
  p_partkey % 11 <> 0 AS is_active
FROM {part}"""),
    ("allocation_source", """
SELECT i.id AS id,
  i.id AS export_order_item_id,
  o.client_id * 100 + (year(i.l_shipdate) - 1990) AS shipment_id,
  (o.client_id * 100 + (year(i.l_shipdate) - 1990)) * 10
    + CASE i.l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS shipment_container_id,
  cast(CASE WHEN i.l_linenumber % 2 = 0 THEN i.quantity ELSE i.quantity / 2 END AS decimal(12,3)) AS quantity
FROM {export_order_items} i JOIN {export_orders} o ON o.id = i.export_order_id
WHERE i.l_linestatus = 'F'"""),
    ("shipment_allocations", """
SELECT id, shipment_id, shipment_container_id, export_order_item_id,
  cast(row_number() OVER (PARTITION BY shipment_id ORDER BY id) AS int) AS line_number,
  quantity
FROM {allocation_source}"""),
    ("shipments", """
SELECT id,
  concat('SHP-', cast(id AS string)) AS shipment_number,
  cast(floor(id / 100) AS bigint) AS client_id,
  1000000000 + cast(floor(id / 100) AS bigint) % 10 AS customs_consignee_id,
  CASE WHEN id % 3 = 0 THEN 1000000000 + (cast(floor(id / 100) AS bigint) + 1) % 10 ELSE NULL END AS also_notify_party_id,
  CASE WHEN id % 4 = 0 THEN 2000000004 ELSE NULL END AS clearing_agent_id,
  CASE id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'ready_to_ship' WHEN 2 THEN 'shipped'
    WHEN 3 THEN 'completed' ELSE 'cancelled' END AS status,
  make_date(cast(1990 + id % 100 AS int), 6, 30) AS shipment_date,
  cast(1990 + id % 100 AS int) AS sequence_year,
  cast(id % 997 + 1 AS int) AS sequence_number,
  'USD' AS currency,
  CASE WHEN id % 6 = 0 THEN concat('["H', cast(id AS string), '"]') END AS seal_numbers,
  cast(concat(cast(make_date(cast(1990 + id % 100 AS int), 6, 30) AS string), ' 0', cast(id % 7 AS string), ':30:00') AS timestamp) AS created_at
FROM (SELECT DISTINCT shipment_id AS id FROM {allocation_source}) s"""),
    ("shipment_containers", """
SELECT id,
  cast(floor(id / 10) AS bigint) AS shipment_id,
  cast(id % 10 AS int) AS line_number,
  concat('CN-', cast(id AS string)) AS container_number,
  CASE WHEN id % 10 = 1 THEN '20FT' ELSE '40HC' END AS container_type,
  cast((id % 10) * 10.5 AS decimal(12,3)) AS cbm,
  CASE WHEN id % 2 = 0 THEN concat('["S', cast(id AS string), '"]') END AS seal_numbers
FROM (SELECT DISTINCT shipment_container_id AS id FROM {allocation_source}) c"""),
    ("legacy_containers", """
SELECT * FROM {shipment_containers} WHERE shipment_id % 7 <> 0"""),
    ("users", """
SELECT id,
  concat('user-', cast(id AS string)) AS name,
  concat('user', cast(id AS string), '@example.test') AS email,
  id % 5 + 1 AS role_id,
  id % 9 <> 0 AS is_active,
  CASE WHEN id % 4 > 0 THEN concat('+1-', cast(id AS string)) END AS phone,
  CASE WHEN id % 3 > 0 THEN cast(concat('2024-01-0', cast(id % 9 + 1 AS string), ' 08:00:00') AS timestamp) END AS last_login_at,
  cast(concat('2023-0', cast(id % 9 + 1 AS string), '-01 00:00:00') AS timestamp) AS created_at
FROM (SELECT DISTINCT user_id AS id FROM {events}) u"""),
    ("bank_accounts", """
SELECT cast(n_nationkey + 1 AS bigint) AS id,
  concat('ACCOUNT-', n_name) AS account_name,
  CASE n_regionkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency,
  n_nationkey % 6 <> 5 AS is_active,
  concat('Beneficiary ', n_name) AS beneficiary_name,
  concat('Bank of ', n_name) AS bank_name,
  CASE WHEN n_nationkey % 2 = 0 THEN 'Main branch' END AS branch_name,
  concat('00-', cast(n_nationkey AS string)) AS account_number,
  concat('IB', cast(n_nationkey * 1111 AS string)) AS iban,
  concat('SW', cast(n_nationkey AS string)) AS swift_code,
  CASE WHEN n_nationkey % 3 = 0 THEN concat('Correspondent ', n_name) END AS correspondent_bank,
  CASE WHEN n_nationkey % 3 = 0 THEN concat('C-', cast(n_nationkey AS string)) END AS correspondent_account,
  CASE WHEN n_nationkey % 3 = 0 THEN concat('CS', cast(n_nationkey AS string)) END AS correspondent_swift_code,
  CASE WHEN n_nationkey % 5 = 0 THEN 'Quote the invoice number' END AS instructions
FROM {nation}"""),
    ("document_events", """
SELECT event_id AS id,
  event_id % 2 = 0 AS on_order,
  event_id AS target_id,
  user_id,
  CASE event_type WHEN 'view' THEN 'previewed' WHEN 'click' THEN 'printed'
    WHEN 'purchase' THEN 'downloaded' ELSE 'shredded' END AS action_name,
  ts AS created_at,
  CASE WHEN event_id % 8 < 4 THEN 'sale_contract' WHEN event_id % 8 < 6 THEN 'gate_pass'
    ELSE 'client_packing_list' END AS document_type
FROM {events}"""),
    ("raw_payments", """
SELECT event_id AS request_id,
  cast(event_id - event_id % 10 AS string) AS order_id,
  CASE event_id % 10 WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN '-5'
    ELSE cast(cast(value AS decimal(10,2)) AS string) END AS amount,
  CASE event_id % 7 WHEN 1 THEN '2024-02-30' WHEN 2 THEN '2024-2-3' WHEN 3 THEN ''
    ELSE '2024-01-15' END AS payment_date,
  CASE WHEN event_id % 50 = 4 THEN repeat('x', 121) ELSE '  ref ' END AS reference_number
FROM {events}"""),
    ("shipment_requests", """
SELECT o.id * 100 + i.line_number % 3 + k.k * 10 AS request_id,
  CASE WHEN o.id % 17 = 0 THEN o.client_id + 1 ELSE o.client_id END AS client_id,
  i.id AS export_order_item_id,
  cast(i.line_number % 2 AS int) AS container_index,
  cast(i.quantity * CASE WHEN k.k = 0 THEN 0.5 ELSE 0.6 END AS decimal(12,3)) AS quantity
FROM {export_order_items} i
JOIN {export_orders} o ON o.id = i.export_order_id
JOIN (SELECT 0 AS k, 1 AS one UNION ALL SELECT 1 AS k, 1 AS one) k ON k.one = 1"""),
    ("request_containers", """
SELECT request_id, container_index,
  CASE WHEN request_id % 11 = 0 AND container_index = 1
    THEN concat('cn-', cast(request_id AS string), '-0')
    ELSE concat('CN-', cast(request_id AS string), '-', cast(container_index AS string)) END AS container_number
FROM (SELECT DISTINCT request_id, container_index FROM {shipment_requests}) r
WHERE NOT (request_id % 19 = 0 AND container_index = 1)
UNION ALL
SELECT DISTINCT request_id, 5, concat('CN-', cast(request_id AS string), '-5')
FROM {shipment_requests} WHERE request_id % 13 = 0"""),
]

# The permission catalogue (key, module, action), in catalogue order; id = position.
PERMISSIONS: list[tuple[str, str, str]] = [
    ("dashboard.view", "dashboard", "view"),
    ("orders.view", "orders", "view"),
    ("orders.create", "orders", "create"),
    ("orders.edit", "orders", "edit"),
    ("orders.delete", "orders", "delete"),
    ("orders.confirm", "orders", "confirm"),
    ("documents.preview", "documents", "preview"),
    ("documents.print", "documents", "print"),
    ("gate_pass.view", "gate_pass", "view"),
    ("gate_pass.edit", "gate_pass", "edit"),
    ("gate_pass.print", "gate_pass", "print"),
    ("products.view", "products", "view"),
    ("products.create", "products", "create"),
    ("products.edit", "products", "edit"),
    ("products.delete", "products", "delete"),
    ("parties.view", "parties", "view"),
    ("parties.create", "parties", "create"),
    ("parties.edit", "parties", "edit"),
    ("parties.delete", "parties", "delete"),
    ("bank_accounts.view", "bank_accounts", "view"),
    ("bank_accounts.create", "bank_accounts", "create"),
    ("bank_accounts.edit", "bank_accounts", "edit"),
    ("bank_accounts.delete", "bank_accounts", "delete"),
    ("ledger.view", "ledger", "view"),
    ("ledger.record_payment", "ledger", "record_payment"),
    ("reports.view", "reports", "view"),
    ("users.view", "users", "view"),
    ("users.create", "users", "create"),
    ("users.edit", "users", "edit"),
    ("roles.manage", "roles", "manage"),
    ("settings.manage", "settings", "manage"),
]

# System roles (id, name) and their permission keys; None = every key.
ROLES: list[tuple[int, str]] = [
    (1, "Administrator"),
    (2, "Documentation Officer"),
    (3, "Shipping Officer"),
    (4, "Gate Pass Officer"),
    (5, "Viewer"),
]
ROLE_KEYS: dict[int, list[str] | None] = {
    1: None,
    2: ["dashboard.view", "orders.view", "orders.create", "orders.edit",
        "documents.preview", "documents.print", "products.view", "parties.view", "parties.create",
        "bank_accounts.view", "bank_accounts.create", "bank_accounts.edit",
        "ledger.view", "ledger.record_payment", "reports.view"],
    3: ["dashboard.view", "orders.view", "orders.edit",
        "documents.preview", "documents.print", "products.view", "parties.view", "bank_accounts.view",
        "ledger.view", "reports.view"],
    4: ["orders.view", "gate_pass.view", "gate_pass.edit", "gate_pass.print"],
    5: ["dashboard.view", "orders.view", "documents.preview", "products.view", "parties.view",
        "bank_accounts.view", "ledger.view", "reports.view"],
}


def role_permission_pairs() -> list[tuple[int, int]]:
    ids = {key: i + 1 for i, (key, _, _) in enumerate(PERMISSIONS)}
    pairs = []
    for role_id, keys in ROLE_KEYS.items():
        for key in keys if keys is not None else [k for k, _, _ in PERMISSIONS]:
            pairs.append((role_id, ids[key]))
    return pairs


def _values_sql(rows, columns) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def constant_view_sql() -> list[tuple[str, str]]:
    """The fixed catalogue tables as SQL VALUES (oracle side)."""
    perms = [(i + 1, k, m, a) for i, (k, m, a) in enumerate(PERMISSIONS)]
    return [
        ("permissions", _values_sql(perms, ["id", "permission_key", "module_name", "action_name"])),
        ("roles", _values_sql(ROLES, ["id", "name"])),
        ("role_permissions", _values_sql(role_permission_pairs(), ["role_id", "permission_id"])),
    ]


def oracle_prelude() -> str:
    """WITH-clause that defines every domain view over the raw tables (DuckDB)."""
    names = {t: t for t in RAW_TABLES}
    names.update({v: v for v, _ in VIEWS})
    ctes = [f"{name} AS ({sql.format(**names).strip()})" for name, sql in VIEWS]
    ctes += [f"{name} AS ({sql})" for name, sql in constant_view_sql()]
    return "WITH " + ",\n".join(ctes) + "\n"


#: Views to write once: their names, or the column by which each one's rows lie (None: by none).
Keep = tuple[str, ...] | Mapping[str, str | None]


class LazyViews(dict):
    """Domain views built on first use (with their dependencies); each is a lazy query plan.

    Views named in ``keep`` are written once to the shared folder when they are first used, so that a job that
    needs them several times numbers and joins the raw rows once (a mapping names the column by which each lies)."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: Keep = ()):
        super().__init__()
        self._spark = spark
        self._sf_dir = sf_dir
        self._sql = dict(VIEWS)
        self._keep = keep

    def __missing__(self, name: str) -> DataFrame:
        spark = self._spark
        if name in RAW_TABLES:
            df = spark.read.parquet(os.path.join(self._sf_dir, f"{name}.parquet"))
        elif name in self._sql:
            sql = self._sql[name]
            df = spark.sql(sql, **{k: self[k] for k in _placeholders(sql)})
            if name in self._keep:
                df = stored(df, name, STEP_SETTINGS, self._keep[name] if isinstance(self._keep, Mapping) else None)
        elif name == "permissions":
            perms = [(i + 1, k, m, a) for i, (k, m, a) in enumerate(PERMISSIONS)]
            df = spark.createDataFrame(perms, "id bigint, permission_key string, module_name string, action_name string")
        elif name == "roles":
            df = spark.createDataFrame(ROLES, "id bigint, name string")
        elif name == "role_permissions":
            df = spark.createDataFrame(role_permission_pairs(), "role_id bigint, permission_id bigint")
        else:
            raise KeyError(name)
        self[name] = df
        return df

    def __contains__(self, name) -> bool:
        return dict.__contains__(self, name) or name in self._sql or name in RAW_TABLES \
            or name in ("permissions", "roles", "role_permissions")


def build_views(spark: SparkSession, sf_dir: str, keep: Keep = ()) -> LazyViews:
    """All domain views, planned lazily on first access; those in ``keep`` are then written once."""
    return LazyViews(spark, sf_dir, keep)


def _placeholders(sql: str) -> set[str]:
    import string
    return {field for _, field, _, _ in string.Formatter().parse(sql) if field}
