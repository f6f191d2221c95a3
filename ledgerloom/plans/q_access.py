"""Registered access queries (role matrix, effective permissions, restricted views, document checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import access as A
from ledgerloom.operators import fulfilment as FU
from ledgerloom.plans.catalog import DEALT_LINES, LINES, ORACLE, register, with_ctes
from ledgerloom.plans.q_fulfilment import _ORDER_PARTS, ORDER_LIST_SQL, stamped
from ledgerloom.sources.schemas import DOCUMENT_ACTIONS, ORDER_DOCUMENT_TYPES, SHIPMENT_DOCUMENT_TYPES

EFFECTIVE_SQL = """SELECT u.id AS user_id, p.permission_key
FROM users u JOIN role_permissions rp ON rp.role_id = u.role_id JOIN permissions p ON p.id = rp.permission_id
WHERE u.is_active"""


@register("role_permissions_matrix", with_ctes(
    """SELECT CAST(r.id AS BIGINT) AS id, r.name, COALESCE(k.permission_keys, '') AS permission_keys,
      COALESCE(u.n, 0) AS active_users
    FROM roles r
    LEFT JOIN (SELECT rp.role_id, string_agg(p.permission_key, ',' ORDER BY p.permission_key) AS permission_keys
               FROM role_permissions rp JOIN permissions p ON p.id = rp.permission_id GROUP BY rp.role_id) k
      ON k.role_id = r.id
    LEFT JOIN (SELECT role_id, COUNT(*) AS n FROM users WHERE is_active GROUP BY role_id) u ON u.role_id = r.id"""))
def q_role_permissions_matrix(t):
    """Role -> sorted permission keys, with active users per role."""
    return A.role_permissions_matrix(t).select("id", "name", "permission_keys", "active_users")


@register("effective_permissions", with_ctes(EFFECTIVE_SQL))
def q_effective_permissions(t):
    """(user, permission) pairs of active users."""
    return A.effective_permissions(t)


@register("users_with_roles", with_ctes(
    """SELECT * EXCLUDE (last_login_at, created_at), (SELECT name FROM roles WHERE roles.id = role_id) AS role_name,
      strftime(last_login_at, '%Y-%m-%d %H:%M:%S') AS last_login_at, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
    FROM users WHERE role_id IN (SELECT id FROM roles)"""))
def q_users_with_roles(t):
    """Users with role names."""
    return stamped(A.users_with_roles(t), "last_login_at", "created_at")


@register("gate_pass_users", with_ctes(
    f"""SELECT user_id,
      bool_or(permission_key = 'gate_pass.view') AND NOT bool_or(permission_key = 'documents.preview')
        AND NOT bool_or(permission_key = 'orders.edit') AS gate_pass_only,
      bool_or(permission_key IN ('orders.edit', 'gate_pass.edit')) AS can_edit_gate_pass
    FROM ({EFFECTIVE_SQL}) e GROUP BY user_id"""))
def q_gate_pass_users(t):
    """P7 predicate + V10 any-of check over every active user's permission set."""
    sets = A.user_permission_sets(t)
    return sets.select("user_id", A.gate_pass_only(F.col("permissions")).alias("gate_pass_only"),
                       A.has_any(F.col("permissions"), "orders.edit", "gate_pass.edit").alias("can_edit_gate_pass"))


@register("order_list_gate_pass", with_ctes(
    f"""SELECT id, invoice_number, status, contract_date, created_at, client_name, total_packages, total_net_weight,
      total_gross_weight FROM ({ORDER_LIST_SQL}) x""", "alloc_active", extra=_ORDER_PARTS))
def q_order_list_gate_pass(t):
    """The order list as a gate-pass-only user sees it."""
    return stamped(A.restrict(FU.order_list(t), "order_list", GATE_PASS_ONLY))


GATE_PASS_ONLY = ["orders.view", "gate_pass.view", "gate_pass.edit"]
# Columns of the gate pass that the given tables do not carry.
_NO_GATE_PASS = ["transporter_name", "transporter_contact", "transporter_phone", "truck_number", "driver_name", "driver_phone", "loading_address",
                 "delivery_address", "seal_numbers"]


@register("shipment_list_gate_pass", f"""SELECT id, shipment_number, status, shipment_date, client_name, contract_count, container_count, total_packages,
    total_net_weight, total_gross_weight FROM ({ORACLE['shipment_list']}) x""")
def q_shipment_list_gate_pass(t):
    """The shipment list as a gate-pass-only user sees it."""
    return A.restrict(FU.shipment_list(t), "shipment_list", GATE_PASS_ONLY)


# Each restricted detail is compared line by line; the names of all columns that are left go along.
_LINE_FIELDS = ["id", "product_id", "product_name", "description_override", "quantity", "quantity_unit", "units_per_carton", "is_sample",
                "product_unit_weight_grams", "product_pieces_per_unit", "product_package_type", "total_net_weight", "total_gross_weight"]
_SEEN = ["id", "invoice_number", "status", "contract_date", "client_name", "clearing_agent_id", "clearing_agent_name", "clearing_agent_phone", "clearing_agent_contact"]


def _detail_lines(df, columns: list[str], fields: list[str]):
    """Every line of a restricted detail, with the list of columns and of item fields that the view still has."""
    shown = F.lit(",".join(sorted(df.columns)))
    inside = F.lit(",".join(sorted(df.schema["items"].dataType.elementType.fieldNames())))
    rows = df.select(*[F.col(c).alias("order_" + c) for c in columns], shown.alias("columns"), inside.alias("fields"), F.explode("items").alias("i"))
    return rows.select(*["order_" + c for c in columns], "columns", "fields", *[F.col("i").getField(f).alias(f) for f in fields])


def _detail_sql(header: str, lines: str, parent: str, columns: list[str], fields: list[str], more: list[str]) -> str:
    return (f"SELECT {', '.join(f'h.{c} AS order_{c}' for c in columns)}, '{','.join(sorted([*columns, *more]))}' AS columns, '{','.join(sorted(fields))}' AS fields, "
            f"{', '.join('l.' + f for f in fields)} FROM ({ORACLE[header]}) h JOIN ({ORACLE[lines]}) l ON l.{parent} = h.id")


@register("order_detail_gate_pass", _detail_sql("order_header", "order_lines", "export_order_id", _SEEN, _LINE_FIELDS, ["items"]), keep=LINES)
def q_order_detail_gate_pass(t):
    """The order detail as a gate-pass-only user sees it, line by line."""
    full = FU.order_detail(t, fields=A.item_fields("order_detail", GATE_PASS_ONLY), steps=True)
    d = A.restrict(full, "order_detail", GATE_PASS_ONLY, absent=_NO_GATE_PASS)
    return _detail_lines(d, _SEEN, _LINE_FIELDS)


_SEEN_SHIPMENT = [*_SEEN, "shipment_number", "container_number", "container_type", "seal_numbers"]
_SHIPMENT_FIELDS = [*_LINE_FIELDS, "shipment_container_id", "container_number", "container_type"]


@register("shipment_detail_gate_pass", _detail_sql("shipment_header", "shipment_lines", "shipment_id", _SEEN_SHIPMENT, _SHIPMENT_FIELDS, ["items", "containers"]), keep=DEALT_LINES)
def q_shipment_detail_gate_pass(t):
    """The shipment detail as a gate-pass-only user sees it, line by line."""
    full = FU.shipment_detail(t, fields=A.item_fields("shipment_detail", GATE_PASS_ONLY))
    d = A.restrict(full, "shipment_detail", GATE_PASS_ONLY, absent=_NO_GATE_PASS)
    return _detail_lines(d, _SEEN_SHIPMENT, _SHIPMENT_FIELDS)


def _one_of(column: str, values) -> str:
    return f"list_contains([{', '.join(repr(v) for v in values)}], {column})"


# Per event: is its user active, is it well formed, does it come from the right place, may the user do it.
_JUDGED = f"""SELECT e.*, u.id IS NOT NULL AS known,
    {_one_of('action_name', DOCUMENT_ACTIONS)} AND IF(on_order, {_one_of('document_type', ORDER_DOCUMENT_TYPES)}, {_one_of('document_type', SHIPMENT_DOCUMENT_TYPES)}) AS sound,
    NOT (on_order AND document_type <> 'sale_contract') AS placed,
    list_has_any(held, IF(action_name = 'previewed', ['documents.preview', IF(document_type = 'gate_pass', 'gate_pass.view', '')],
      ['documents.print', IF(document_type = 'gate_pass', 'gate_pass.print', '')])) AS may
  FROM document_events e LEFT JOIN (SELECT id FROM users WHERE is_active) u ON u.id = e.user_id
  LEFT JOIN (SELECT user_id AS holder, list(permission_key) AS held FROM ({EFFECTIVE_SQL}) p GROUP BY 1) h ON holder = e.user_id"""


@register("document_authorization", with_ctes(
    """SELECT id, on_order, target_id, user_id, action_name, document_type,
      CASE WHEN NOT known THEN 'unauthenticated' WHEN NOT (sound AND placed) THEN 'invalid' WHEN may THEN 'allowed' ELSE 'denied' END AS outcome,
      CASE WHEN NOT known THEN 'unknown or inactive user' WHEN NOT sound THEN 'invalid action or document type'
        WHEN NOT placed THEN 'shipping documents come from a shipment' WHEN NOT COALESCE(may, FALSE) THEN 'missing permission' END AS reason
    FROM judged""", extra={"judged": _JUDGED}))
def q_document_authorization(t):
    """V9: document action authorisation for every document event."""
    return A.authorize_document_actions(t["document_events"], t)
