"""Access data.

Permission sets are bounded by the permission catalogue (a few dozen keys), so per-user
permission arrays and flags are small regardless of how many users or events there are.
Document events (which grow with the data) are only ever joined to one row per user.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.tables import with_optional
from ledgerloom.sources.schemas import DOCUMENT_ACTIONS, ORDER_DOCUMENT_TYPES, SHIPMENT_DOCUMENT_TYPES

GATE_PASS_VIEW = "gate_pass.view"
DOCS_PREVIEW = "documents.preview"
ORDERS_EDIT = "orders.edit"


def permissions_catalog(t) -> DataFrame:
    """The permission catalogue ordered by (module, action)."""
    return t["permissions"].orderBy("module_name", "action_name")


def role_permissions_matrix(t) -> DataFrame:
    """Role -> sorted permission keys ([] when none), with the number of active users holding it."""
    r, rp, p = t["roles"], t["role_permissions"], t["permissions"]
    keys = (rp.join(p, rp["permission_id"] == p["id"], "inner")
            .groupBy("role_id").agg(F.sort_array(F.collect_list("permission_key")).alias("permissions")))
    users = (t["users"].filter(F.col("is_active")).groupBy(F.col("role_id").alias("_urid"))
             .agg(F.count(F.lit(1)).alias("active_users")))
    return (r.join(keys, r["id"] == keys["role_id"], "left").drop("role_id")
            .join(users, r["id"] == users["_urid"], "left").drop("_urid")
            .withColumn("permissions", F.coalesce(F.col("permissions"), F.array().cast("array<string>")))
            .withColumn("permission_keys", F.array_join("permissions", ","))
            .withColumn("active_users", F.coalesce(F.col("active_users"), F.lit(0)))
            .orderBy("name"))


def effective_permissions(t) -> DataFrame:
    """(user_id, permission_key) for every active user (flat form)."""
    u = t["users"].filter(F.col("is_active")).select(F.col("id").alias("user_id"), "role_id")
    rp, p = t["role_permissions"], t["permissions"]
    return (u.join(rp, "role_id", "inner")
            .join(p, rp["permission_id"] == p["id"], "inner")
            .select("user_id", "permission_key"))


def user_permission_sets(t) -> DataFrame:
    """A21 (nested): active user -> sorted distinct permission keys (≤ catalogue size)."""
    return (effective_permissions(t).groupBy("user_id")
            .agg(F.sort_array(F.collect_set("permission_key")).alias("permissions")))


def has_any(perms: Column, *required: str) -> Column:
    """The permission array holds at least one of ``required``."""
    return F.arrays_overlap(perms, F.array(*[F.lit(r) for r in required]))


def has_all(perms: Column, *required: str) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(r) for r in required]), perms)) == 0


def gate_pass_only(perms: Column) -> Column:
    """P7 predicate: gate_pass.view without documents.preview and without orders.edit."""
    return (F.array_contains(perms, GATE_PASS_VIEW) & ~F.array_contains(perms, DOCS_PREVIEW)
            & ~F.array_contains(perms, ORDERS_EDIT))


# Column subsets a gate-pass-only user may see, per view.
RESTRICTED_COLUMNS = {
    "order_list": ["id", "invoice_number", "status", "contract_date", "created_at", "client_name",
                   "total_packages", "total_net_weight", "total_gross_weight"],
    "shipment_list": ["id", "shipment_number", "status", "shipment_date", "client_name", "contract_count",
                      "container_count", "total_packages", "total_net_weight", "total_gross_weight"],
    "order_detail": ["id", "invoice_number", "status", "contract_date", "client_name", "clearing_agent_id",
                     "clearing_agent_name", "clearing_agent_phone", "clearing_agent_contact", "transporter_name",
                     "transporter_contact", "transporter_phone", "truck_number", "driver_name", "driver_phone",
                     "loading_address", "delivery_address", "seal_numbers", "items"],
    "shipment_detail": ["id", "invoice_number", "shipment_number", "status", "contract_date", "client_name",
                        "container_number", "container_type", "containers", "clearing_agent_id",
                        "clearing_agent_name", "clearing_agent_phone", "clearing_agent_contact",
                        "transporter_name", "transporter_contact", "transporter_phone", "truck_number",
                        "driver_name", "driver_phone", "loading_address", "delivery_address", "seal_numbers",
                        "items"],
}
RESTRICTED_ITEM_FIELDS = {
    "order_detail": ["id", "product_id", "product_name", "description_override", "quantity", "quantity_unit",
                     "units_per_carton", "is_sample", "product_unit_weight_grams", "product_pieces_per_unit",
                     "product_package_type", "total_net_weight", "total_gross_weight"],
    "shipment_detail": ["id", "product_id", "product_name", "description_override", "quantity", "quantity_unit",
                        "units_per_carton", "is_sample", "product_unit_weight_grams", "product_pieces_per_unit",
                        "product_package_type", "total_net_weight", "total_gross_weight",
                        "shipment_container_id", "container_number", "container_type"],
}


def _restricted(permissions: Iterable[str]) -> bool:
    perms = set(permissions)
    return GATE_PASS_VIEW in perms and DOCS_PREVIEW not in perms and ORDERS_EDIT not in perms


def item_fields(view: str, permissions: Iterable[str]) -> list[str] | None:
    """The item fields of a view that a user with these permissions sees (None: all)."""
    return RESTRICTED_ITEM_FIELDS.get(view) if _restricted(permissions) else None


def restrict(df: DataFrame, view: str, permissions: Iterable[str], absent: Iterable[str] = ()) -> DataFrame:
    """A gate-pass-only user sees a column subset (nested items too); others see everything.

    A column of the subset that the table lacks raises, unless it is named in ``absent``."""
    if not _restricted(permissions):
        return df
    missing = set(RESTRICTED_COLUMNS[view]) - set(df.columns) - set(absent)
    if missing:
        raise ValueError(f"{view} lacks columns: {sorted(missing)}")
    keep = [c for c in RESTRICTED_COLUMNS[view] if c in df.columns]
    out = df.select(*keep)
    if "items" in keep and view in RESTRICTED_ITEM_FIELDS:
        fields = out.schema["items"].dataType.elementType.fieldNames()
        sub = [f for f in RESTRICTED_ITEM_FIELDS[view] if f in fields]
        out = out.withColumn("items", F.transform("items", lambda i: F.struct(*[i[f].alias(f) for f in sub])))
    return out


def users_with_roles(t, ordered: bool = False) -> DataFrame:
    """Users with their role name, by name."""
    u, r = with_optional(t["users"], "users", ["phone", "last_login_at", "created_at"]), t["roles"]
    return (u.join(r.select(F.col("id").alias("_rid"), F.col("name").alias("role_name")),
                   u["role_id"] == F.col("_rid"), "inner")
            .select("id", "name", "email", "phone", "is_active", "last_login_at", "created_at", "role_id", "role_name")
            .transform(lambda d: d.orderBy("name", "id") if ordered else d))


def _user_flags(t) -> DataFrame:
    """Per active user, the five permission flags document actions depend on (one row per user)."""
    ep = effective_permissions(t)
    k = F.col("permission_key")
    return ep.groupBy("user_id").agg(
        F.max(k == "documents.preview").alias("p_doc_preview"),
        F.max(k == "documents.print").alias("p_doc_print"),
        F.max(k == "gate_pass.view").alias("p_gp_view"),
        F.max(k == "gate_pass.print").alias("p_gp_print"))


def authorize_document_actions(events: DataFrame, t) -> DataFrame:
    """V9: document events -> allowed / denied / invalid with a reason.

    ``events``: id, on_order (bool), target_id, user_id, action_name, document_type."""
    flags = _user_flags(t)
    active = t["users"].filter(F.col("is_active")).select(F.col("id").alias("_auid"))
    e = (events.join(active, events["user_id"] == active["_auid"], "left")
         .join(flags.withColumnRenamed("user_id", "_fuid"), F.col("user_id") == F.col("_fuid"), "left"))
    action_ok = F.col("action_name").isin(DOCUMENT_ACTIONS)
    type_ok = F.when(F.col("on_order"), F.col("document_type").isin(ORDER_DOCUMENT_TYPES)) \
        .otherwise(F.col("document_type").isin(SHIPMENT_DOCUMENT_TYPES))
    is_print = F.col("action_name") != "previewed"
    docs = F.when(is_print, F.coalesce(F.col("p_doc_print"), F.lit(False))) \
        .otherwise(F.coalesce(F.col("p_doc_preview"), F.lit(False)))
    gate = F.when(is_print, F.coalesce(F.col("p_gp_print"), F.lit(False))) \
        .otherwise(F.coalesce(F.col("p_gp_view"), F.lit(False)))
    allowed = F.when(F.col("document_type") == "gate_pass", gate | docs).otherwise(docs)
    reason = (F.when(F.col("_auid").isNull(), "unknown or inactive user")
              .when(~action_ok | ~type_ok, "invalid action or document type")
              .when(F.col("on_order") & (F.col("document_type") != "sale_contract"),
                    "shipping documents come from a shipment")
              .when(~allowed, "missing permission"))
    outcome = (F.when(F.col("_auid").isNull(), "unauthenticated")
               .when(~action_ok | ~type_ok | (F.col("on_order") & (F.col("document_type") != "sale_contract")),
                     "invalid")
               .when(~allowed, "denied").otherwise("allowed"))
    return e.select("id", "on_order", "target_id", "user_id", "action_name", "document_type",
                    outcome.alias("outcome"), reason.alias("reason"))


def seed_role_permissions(t, mapping: DataFrame) -> DataFrame:
    """(role_name, permission_key | '*') mapping -> role_permissions with absent pairs inserted."""
    r = t["roles"].select(F.col("id").alias("role_id"), F.col("name").alias("role_name"))
    p = t["permissions"].select(F.col("id").alias("permission_id"), "permission_key")
    m = mapping.join(r, "role_name", "inner")
    exact = m.filter(F.col("permission_key") != "*").join(p, "permission_key", "inner")
    # '*' grants the whole catalogue: an equi-join on the wildcard (catalogue x wildcard roles, bounded)
    every = (m.filter(F.col("permission_key") == "*").withColumnRenamed("permission_key", "_all")
             .join(p.withColumn("_all", F.lit("*")), "_all", "inner"))
    pairs = exact.select("role_id", "permission_id").unionByName(every.select("role_id", "permission_id"))
    existing = t["role_permissions"]
    new = pairs.distinct().join(existing, ["role_id", "permission_id"], "left_anti")
    return existing.unionByName(new)
