"""Registered queries over stored tables: writes in place, audit log, buckets, lookups, schema versions, pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators import access as A
from ledgerloom.operators import fulfilment as FU
from ledgerloom.operators.balances import order_balances
from ledgerloom.plans.catalog import BAL, D, DEALT_LINES, ORACLE, register, with_ctes
from ledgerloom.plans.q_parts import ORDER_ID
from ledgerloom.plans.q_reports import BAL_COLS, BAL_MONEY
from ledgerloom.session import scratch_path
from ledgerloom.sources import schemas, store, tables


def _folder(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("persisted_writes", with_ctes(
    """SELECT id, CASE WHEN id % 9 = 0 AND party_type = 'client' AND is_active THEN 'Patched ' || id ELSE name END AS name, party_type, country,
      CASE WHEN id % 7 = 0 THEN FALSE ELSE is_active END AS is_active
    FROM (SELECT id, CASE WHEN id % 3 = 0 AND party_type = 'client' THEN upper(name) ELSE name END AS name, party_type, country,
            is_active OR (id % 3 = 0 AND party_type = 'client') AS is_active FROM parties
          UNION ALL SELECT id + 4000000000, name, party_type, country, is_active FROM parties
          UNION ALL SELECT id + 3000000000, 'New ' || name, party_type, country, TRUE FROM parties WHERE party_type = 'client') w"""))
def q_persisted_writes(t):
    """S5-S9 on a stored table, in place: append, upsert, insert-if-absent, keyed update, soft delete; then read back."""
    spark = t["parties"].sparkSession
    path = _folder(spark, "parties")
    p = t["parties"].select("id", "name", "party_type", "country", "is_active")
    clients = p.filter(F.col("party_type") == "client")
    store.create(p, path)
    store.append_rows(spark, path, p.withColumn("id", F.col("id") + 4000000000))
    renamed = clients.withColumns({"name": F.when(F.col("id") % 3 == 0, F.upper("name")).otherwise(F.col("name")),
                                   "is_active": F.col("is_active") | (F.col("id") % 3 == 0)})
    added = clients.withColumns({"id": F.col("id") + 3000000000, "name": F.concat(F.lit("New "), "name"), "is_active": F.lit(True)})
    store.upsert_rows(spark, path, renamed.unionByName(added), ["name", "is_active"])
    store.insert_absent_rows(spark, path, p.withColumn("name", F.lit("there already")))
    now = store.read(spark, path)
    patch = now.filter(F.col("party_type") == "client").select("id", F.concat(F.lit("Patched "), F.col("id").cast("string")).alias("name"))
    store.update_rows(spark, path, patch, ["name"], where=(F.col("id") % 9 == 0) & (F.col("party_type") == "client") & F.col("is_active"))
    store.soft_delete_rows(spark, path, store.read(spark, path).filter(F.col("id") % 7 == 0).select("id"))
    return store.read(spark, path)


@register("audit_append", with_ctes(
    """SELECT e.id, e.on_order, e.target_id, e.user_id, e.document_type, e.action_name, CAST(e.created_at AS DATE) AS event_date, CAST(e.id % 3 AS VARCHAR) AS batch_id
    FROM document_events e JOIN judged_events j ON j.id = e.id AND j.outcome = 'allowed'""",
    extra={"judged_events": "SELECT id, outcome FROM document_authorization_rows"}))
def q_audit_append(t):
    """S12 (after V9): allowed document actions appended in three batches, one of them twice; then read back."""
    events = t["document_events"]
    spark = events.sparkSession
    allowed = A.authorize_document_actions(events, t).filter(F.col("outcome") == "allowed").select(F.col("id").alias("_ok"))
    rows = (events.join(allowed, events["id"] == F.col("_ok"))
            .select("id", "on_order", "target_id", "user_id", "document_type", "action_name", "created_at", (F.col("id") % 3).alias("_batch")))
    path = _folder(spark, "audit")
    for batch in (0, 1, 2, 1):
        store.append_audit(rows.filter(F.col("_batch") == batch).drop("_batch"), path, batch)
    return store.read_audit(spark, path).drop("created_at")


# The judged events are the rows of the authorisation query itself.
ORACLE["audit_append"] = ORACLE["audit_append"].replace(
    "SELECT id, outcome FROM document_authorization_rows", "SELECT id, outcome FROM (" + ORACLE["document_authorization"] + ") d")


@register("order_balances_bucketed", with_ctes(f"SELECT {BAL_COLS}, {BAL_MONEY} FROM balances", *BAL))
def q_order_balances_bucketed(t):
    """S1 with A1-A3: balances of tables stored in buckets of the order id (no exchange below the joins)."""
    buckets = store.bucketed(t, {"export_orders": "id", "export_order_items": "export_order_id", "order_payments": "export_order_id"})
    return order_balances(t.replace(**buckets))


@register("order_by_id_stored", with_ctes(f"SELECT id, invoice_number, status, {D('advance_percentage')} AS advance_percentage FROM export_orders WHERE id = {ORDER_ID}"))
def q_order_by_id_stored(t):
    """One order by its id from a table laid out for lookups."""
    spark = t["export_orders"].sparkSession
    path = _folder(spark, "orders-by-id")
    store.create_lookup(t["export_orders"], path)
    return tables.by_id(spark.read.parquet(path), ORDER_ID).select("id", "invoice_number", "status", "advance_percentage")


#: Column names and order statuses of the first schema version.
V1_NAMES = {"number": "invoice_number", "advance": "advance_percentage"}
V1_STATUSES = [s for s in schemas.ORDER_STATUSES if s not in ("in_production", "ready_to_ship")]


@register("conform_orders", with_ctes(
    f"""SELECT id, invoice_number, client_id, status, contract_date, {D('CAST(advance_percentage AS DECIMAL(5,2))')} AS advance_percentage,
      IF(id % 2 = 0, NULL, currency) AS currency, IF(id % 2 = 0, NULL, final_destination) AS final_destination, CAST(NULL AS VARCHAR) AS vessel_name,
      CAST(IF(id % 2 = 0, 1, 2) AS INTEGER) AS version, IF(id % 2 = 0 AND status IN ('in_production', 'ready_to_ship'), 'status', '') AS outside_domain
    FROM export_orders"""))
def q_conform_orders(t):
    """S1 + S3: orders stored under two schema versions (renamed, missing and differently typed columns), read as one table."""
    o = t["export_orders"]
    spark = o.sparkSession
    path = _folder(spark, "orders-versions")
    old = o.filter(F.col("id") % 2 == 0).select(F.col("id").cast("string").alias("id"), F.col("invoice_number").alias("number"), "client_id", "status", "contract_date",
                                                F.col("advance_percentage").cast("double").alias("advance"))
    old.write.parquet(f"{path}/version=1")
    o.filter(F.col("id") % 2 != 0).write.parquet(f"{path}/version=2")
    every = tables.load_versions(spark, path, schemas.SCHEMAS["export_orders"], {1: V1_NAMES}, {1: {"status": V1_STATUSES}, 2: {"status": schemas.ORDER_STATUSES}})
    return every.select("id", "invoice_number", "client_id", "status", "contract_date", "advance_percentage", "currency", "final_destination", "vessel_name",
                        "version", "outside_domain")


@register("order_detail_pages", with_ctes(
    f"""SELECT h.id, invoice_number, CAST((pos - 1) // {FU.PAGE_LINES} AS INTEGER) AS page, pos, i.id AS line_id, {D('i.quantity')} AS quantity, goods.name AS product_name
    FROM export_orders h JOIN (SELECT *, row_number() OVER (PARTITION BY export_order_id ORDER BY line_number, id) AS pos FROM export_order_items
      WHERE product_id IN (SELECT id FROM products)) i ON i.export_order_id = h.id JOIN products goods ON goods.id = i.product_id
    WHERE h.client_id IN (SELECT id FROM parties) AND h.customs_consignee_id IN (SELECT id FROM parties)"""))
def q_order_detail_pages(t):
    """R6 in pages, flattened: every line with its page and place."""
    d = FU.order_detail_pages(t).select("id", "invoice_number", "page", "first_line", F.posexplode("lines").alias("at", "i"))
    return d.select("id", "invoice_number", "page", (F.col("first_line") + F.col("at")).cast("bigint").alias("pos"), F.col("i.id").alias("line_id"), "i.quantity", "i.product_name")


@register("shipment_detail_pages", with_ctes(
    f"""SELECT h.id, shipment_number, CAST((pos - 1) // {FU.PAGE_LINES} AS INTEGER) AS page, pos, a.id AS line_id, box.container_number, {D('a.quantity')} AS quantity,
      IF(floor(quantity) = 0, NULL, upto - CAST(floor(quantity) AS BIGINT) + 1) AS carton_start
    FROM shipments h JOIN (SELECT a.*, row_number() OVER (PARTITION BY a.shipment_id ORDER BY b.line_number, a.line_number, a.id) AS pos,
        CAST(SUM(CAST(floor(a.quantity) AS BIGINT)) OVER (PARTITION BY a.shipment_container_id ORDER BY a.line_number, a.id) AS BIGINT) AS upto
      FROM shipment_allocations a JOIN shipment_containers b ON b.id = a.shipment_container_id JOIN export_order_items i ON i.id = a.export_order_item_id
      JOIN products p ON p.id = i.product_id JOIN export_orders o ON o.id = i.export_order_id) a ON a.shipment_id = h.id
    JOIN shipment_containers box ON box.id = a.shipment_container_id
    WHERE h.client_id IN (SELECT id FROM parties) AND h.customs_consignee_id IN (SELECT id FROM parties)"""), keep=DEALT_LINES)
def q_shipment_detail_pages(t):
    """R7 in pages, flattened: every line with its page, place and cartons."""
    d = FU.shipment_detail_pages(t).select("id", "shipment_number", "page", "first_line", F.posexplode("lines").alias("at", "i"))
    return d.select("id", "shipment_number", "page", (F.col("first_line") + F.col("at")).cast("bigint").alias("pos"), F.col("i.id").alias("line_id"),
                    "i.container_number", "i.quantity", "i.carton_start")
