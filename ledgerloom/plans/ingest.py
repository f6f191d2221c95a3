"""Ingest jobs (I1-I6): batches of requests in, (new tables, rejected requests) out.

Each contract / shipment / role / product request is accepted or rejected whole.  Every step is a
DataFrame transformation over the whole batch; rejected request ids are collected as a DataFrame
(request_id, reason) and removed from the later steps with anti-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import blank_to_null, seal_list
from ledgerloom.operators import admission as G
from ledgerloom.operators import quality as Q
from ledgerloom.operators.backfill import packaging_errors, packaging_json
from ledgerloom.operators.fulfilment import numbered_cartons
from ledgerloom.operators.running import number_all, number_lines
from ledgerloom.session import kept, release
from ledgerloom.sources import sinks
from ledgerloom.sources.tables import Tables

ORDER_RULES, ITEM_RULES, SHIPMENT_RULES = Q.ORDER_RULES, Q.ITEM_RULES, Q.SHIPMENT_RULES
CONTAINER_RULES, ALLOCATION_RULES, PRODUCT_RULES = Q.CONTAINER_RULES, Q.ALLOCATION_RULES, Q.PRODUCT_RULES


def _complete(df: DataFrame, rules) -> DataFrame:
    """Optional fields that a request source does not carry are NULL; a required one must be there."""
    for r in rules:
        if r.field not in df.columns:
            if not (r.nullable or r.default is not None or (r.kind == "number" and not r.positive)):
                raise ValueError(f"missing request field: {r.field}")
            df = df.withColumn(r.field, F.lit(None).cast("string"))
    return df


def _childless(parents: DataFrame, children: DataFrame, reason: str, step: int) -> DataFrame:
    """Rejects of requests without a single child row."""
    return _rejects(parents.join(children.select("request_id").distinct(), "request_id", "left_anti"), reason, step)


def _rejects(df: DataFrame, reason, step: int = 0) -> DataFrame:
    """Rejected requests with a reason and the number of the step that found it."""
    r = F.lit(reason) if isinstance(reason, str) else reason
    return df.select("request_id", r.alias("reason"), F.lit(step).alias("step")).distinct()


def _drop(df: DataFrame, rejected: DataFrame) -> DataFrame:
    return df.join(rejected.select("request_id"), "request_id", "left_anti")


def _first_reason(rejected: DataFrame) -> DataFrame:
    """One row per rejected request: the reason of the earliest step (within a step the least text)."""
    return rejected.groupBy("request_id").agg(F.min_by("reason", F.struct("step", "reason")).alias("reason"))


def _new_ids(df: DataFrame, existing: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """Auto-increment: max(existing id) + running count in request order (numbered in blocks of ids)."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint")).alias("_mx"))
    return number_all(df, order, "_n").withColumn(out, (F.col("_n") + top.scalar()).cast("bigint")).drop("_n")


def _order_items(items: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V4 + W4: normalised items with line numbers and carton ranges; rejected requests (step 5).

    A request is rejected whole when any of its lines is.  The judged lines are written once: they tell both what
    is rejected and what is numbered."""
    judged = kept(Q.judge_items(items, products))
    bad = kept(_rejects(judged.filter(F.col("line_reason").isNotNull() & F.col("request_id").isNotNull()), F.col("line_reason"), 5))
    lines = kept(numbered_cartons(_drop(judged.drop("line_reason"), bad), "request_id", "item_index"))
    release(judged)
    return lines, bad


ITEM_COLUMNS = ["id", "export_order_id", "product_id", "line_number", "carton_start", "carton_end", "quantity",
                "quantity_unit", "units_per_carton", "net_weight_per_carton", "gross_weight_per_carton",
                "client_price_per_carton", "customs_price_per_kg", "is_sample", "description_override"]
ORDER_COLUMNS = [r.field for r in ORDER_RULES]


def _order_values(df: DataFrame) -> list:
    """Header columns as stored: blank texts become NULL."""
    texts = {r.field for r in ORDER_RULES if r.kind == "text"}
    return [blank_to_null(c).alias(c) if c in texts else F.col(c) for c in ORDER_COLUMNS]


def _judged_orders(headers: DataFrame, items: DataFrame, keep: list[str]):
    """Typed headers and items, and what the rules reject (steps 0-2)."""
    hv, hr = Q.validate(_complete(headers, ORDER_RULES), ORDER_RULES, keep=keep, once=True)
    iv, ir = Q.validate(_complete(items, ITEM_RULES), ITEM_RULES, keep=["request_id", "item_index"], once=True)
    rejected = (_rejects(hr, F.concat(F.lit("invalid contract: "), Q.errors_text()), 0)
                .unionByName(_rejects(ir, F.concat(F.lit("invalid line: "), Q.errors_text()), 1))
                .unionByName(_childless(headers, items, "a contract needs a line", 2)))
    return hv, iv, kept(rejected)  # read by every later step


def ingest_orders(t: Tables, headers: DataFrame, items: DataFrame, prefix: str, year: int,
                  created_by=None) -> tuple[Tables, DataFrame]:
    """Validate -> active bank account -> number -> normalise items -> cartons -> append.

    headers: request_id + ORDER_RULES fields; items: request_id, item_index + ITEM_RULES fields."""
    hv, iv, rejected = _judged_orders(headers, items, ["request_id"])
    hv = Q.check_bank_account(_drop(hv, rejected), t["bank_accounts"])
    rejected = rejected.unionByName(_rejects(hv.filter(~F.col("bank_account_ok")), "select an active bank account", 3))
    rejected = kept(rejected)  # step boundary: keeps later plans small and restartable
    hv = kept(_drop(hv.drop("bank_account_ok", "bank_reason"), rejected))
    # lines of the headers that stand; item normalisation decides the remaining rejects before any number is consumed
    lines, bad = _order_items(iv.join(hv.select("request_id"), "request_id", "left_semi"), t["products"])
    rejected = rejected.unionByName(bad)
    hv = _drop(hv, bad).withColumn("sequence_year", F.lit(year))
    numbered = G.assign_numbers(hv, t["export_orders"], prefix, order=["request_id"])
    numbered = kept(_new_ids(numbered, t["export_orders"], ["request_id"]))
    order_ids = numbered.select("request_id", F.col("id").alias("export_order_id"))
    # of a request sent in twice the lines of its first contract come first
    new_items = kept(_new_ids(lines.join(order_ids, "request_id"), t["export_order_items"], ["request_id", "item_index", "export_order_id"]))
    release(lines)
    new_orders = numbered.select("id", "invoice_number", "sequence_number", "sequence_year",
                                 F.lit(created_by).cast("bigint").alias("created_by"), F.lit("draft").alias("status"),
                                 *_order_values(numbered))
    out = t.replace(export_orders=sinks.append(t["export_orders"], new_orders),
                    export_order_items=sinks.append(t["export_order_items"], new_items.select(*ITEM_COLUMNS)))
    return out, _first_reason(rejected)


def apply_order_edits(t: Tables, headers: DataFrame, items: DataFrame) -> tuple[Tables, DataFrame]:
    """Eligibility -> active account -> header update -> replace items (headers carry order_id).

    Of several accepted edits of one order the last one stands."""
    hv, iv, rejected = _judged_orders(headers, items, ["request_id", "order_id"])
    hv = _drop(hv, rejected)
    elig = G.check_order_edits(t, hv.select("request_id", "order_id", "client_id", "advance_percentage"), items=iv)
    rejected = rejected.unionByName(_rejects(elig.filter(~F.col("accepted")), F.col("reason"), 3))
    hv = Q.check_bank_account(_drop(hv, rejected), t["bank_accounts"])
    rejected = rejected.unionByName(_rejects(hv.filter(~F.col("bank_account_ok")), "select an active bank account", 4))
    rejected = kept(rejected)
    hv = kept(_drop(hv.drop("bank_account_ok", "bank_reason"), rejected))
    lines, bad = _order_items(iv.join(hv.select("request_id"), "request_id", "left_semi"), t["products"])
    rejected = rejected.unionByName(bad)
    hv = kept(sinks.one_per_key(_drop(hv, bad), ["order_id"], ["request_id"]))
    edited = lines.join(hv.select("request_id", F.col("order_id").alias("export_order_id")), "request_id")
    new_items = kept(_new_ids(edited, t["export_order_items"], ["request_id", "item_index"]))
    release(lines)
    orders = t["export_orders"]
    for c, kind in hv.select(*_order_values(hv)).dtypes:
        if c not in orders.columns:
            orders = orders.withColumn(c, F.lit(None).cast(kind))
    patch = hv.select(F.col("order_id").alias("id"), *_order_values(hv))
    orders, _ = sinks.update_by_key(orders, patch, ["id"], ORDER_COLUMNS)
    items_out = sinks.replace_children(t["export_order_items"], "export_order_id", new_items.select(*ITEM_COLUMNS),
                                       hv.select("order_id"))
    return t.replace(export_orders=orders, export_order_items=items_out), _first_reason(rejected)


def _shipment_structure_rejects(containers: DataFrame, allocations: DataFrame) -> DataFrame:
    s = Q.check_shipment_structure(containers, allocations)
    return _rejects(s.filter(~F.col("is_valid")), F.col("reason"), 5)


def _validate_shipments(requests, containers, allocations):
    """Typed requests that stand, all sound containers and allocations (callers join them with requests that
    stand), and what the rules reject (steps 0-5)."""
    keep = [c for c in ("request_id", "shipment_id") if c in requests.columns]
    sv, sr = Q.validate(_complete(requests, SHIPMENT_RULES), SHIPMENT_RULES, keep=keep,
                        extra=[Q.exclusive("gd_number", "fi_number", "select either a G.D. or an FI number")], once=True)
    cv, cr = Q.validate(_complete(containers, CONTAINER_RULES), CONTAINER_RULES, keep=["request_id", "container_index"], once=True)
    av, ar = Q.validate(allocations, ALLOCATION_RULES, keep=["request_id", "alloc_index"], once=True)
    # the judged rows are written: who sent what is read from them
    sent, boxes, loads = (x.select("request_id").unionByName(y.select("request_id")) for x, y in ((sv, sr), (cv, cr), (av, ar)))
    rejected = (_rejects(sr, F.concat(F.lit("invalid shipment: "), Q.errors_text()), 0)
                .unionByName(_rejects(cr, F.concat(F.lit("invalid container: "), Q.errors_text()), 1))
                .unionByName(_rejects(ar, F.concat(F.lit("invalid allocation: "), Q.errors_text()), 2))
                .unionByName(_childless(sent, boxes, "a shipment needs a container", 3))
                .unionByName(_childless(sent, loads, "a shipment needs an allocation", 4)))
    rejected = kept(rejected)  # read by both sides of the structure
    rejected = kept(rejected.unionByName(_shipment_structure_rejects(
        _drop(cv, rejected), _drop(av, rejected).select("request_id", "export_order_item_id", "container_index"))))
    return kept(_drop(sv, rejected)), cv, av, rejected


def _structure_rows(t: Tables, ids: DataFrame, cv: DataFrame, av: DataFrame):
    """Containers (line = position) and allocations (line = position) of accepted requests.

    ids: request_id -> shipment_id."""
    placed = kept(number_lines(cv.join(ids, "request_id"), "request_id", "container_index", among=cv))
    cv = kept(_new_ids(placed, t["shipment_containers"], ["request_id", "container_index"]))
    release(placed)
    av = number_lines(av.join(ids.select("request_id"), "request_id", "left_semi"), "request_id", "alloc_index", among=av)
    cmap = cv.select("request_id", "container_index", F.col("id").alias("shipment_container_id"), "shipment_id")
    placed = kept(av.join(cmap, ["request_id", "container_index"]))
    av = kept(_new_ids(placed, t["shipment_allocations"], ["request_id", "alloc_index"]))
    release(placed)
    first = cv.filter(F.col("line_number") == 1).select("request_id", "container_number", "container_type", "cbm")
    containers = cv.select("id", "shipment_id", "line_number", "container_number", "container_type", "cbm")
    allocations = av.select("id", "shipment_id", "shipment_container_id", "export_order_item_id", "line_number",
                            "quantity")
    return containers, allocations, first


HEADER_COLUMNS = [r.field for r in SHIPMENT_RULES] + ["container_number", "container_type", "cbm"]


def _header_values() -> list:
    """Shipment columns as stored: blank texts become NULL."""
    texts = {r.field for r in SHIPMENT_RULES if r.kind == "text"} | {"container_type"}
    return [blank_to_null(c).alias(c) if c in texts else F.col(c) for c in HEADER_COLUMNS]


def ingest_shipments(t: Tables, requests: DataFrame, containers: DataFrame, allocations: DataFrame,
                     year: int, created_by=None) -> tuple[Tables, DataFrame]:
    """Validate (incl. G.D./FI exclusivity) -> structure -> admit allocations -> number ->
    header (first container copied) -> containers and allocations with line numbers -> append.

    requests: request_id + SHIPMENT_RULES fields; containers: request_id, container_index + CONTAINER_RULES;
    allocations: request_id, alloc_index + ALLOCATION_RULES."""
    sv, cv, av, rejected = _validate_shipments(requests, containers, allocations)
    admitted = G.admit_shipments(t, av.join(sv.select("request_id", "client_id"), "request_id"))
    rejected = kept(rejected.unionByName(
        _rejects(admitted.filter(F.col("outcome") != "accepted"), F.col("reason"), 6)))
    sv = _drop(sv, rejected).withColumn("sequence_year", F.lit(year))
    numbered = G.assign_numbers(sv, t["shipments"], "SHP", order=["request_id"], out="shipment_number")
    numbered = kept(_new_ids(numbered, t["shipments"], ["request_id"]))
    ids = numbered.select("request_id", F.col("id").alias("shipment_id"))
    new_c, new_a, first = _structure_rows(t, ids, cv, av)
    header = numbered.join(first, "request_id", "left").select(
        "id", "shipment_number", "sequence_number", "sequence_year", F.lit("draft").alias("status"),
        F.lit(created_by).cast("bigint").alias("created_by"), *_header_values())
    out = t.replace(shipments=sinks.append(t["shipments"], header),
                    shipment_containers=sinks.append(t["shipment_containers"], new_c),
                    shipment_allocations=sinks.append(t["shipment_allocations"], new_a))
    return out, _first_reason(rejected)


def apply_shipment_edits(t: Tables, requests: DataFrame, containers: DataFrame,
                         allocations: DataFrame) -> tuple[Tables, DataFrame]:
    """I4: draft/ready only -> validate/structure -> admission (a shipment's own quantities are free for
    its own edit alone) -> header update -> replace containers and allocations.  requests carry
    shipment_id; of several accepted edits of one shipment the last one stands."""
    s = t["shipments"].select(F.col("id").alias("_sid"), F.col("status").alias("_status"))
    st = requests.select("request_id", "shipment_id").join(s, F.col("shipment_id") == F.col("_sid"), "left")
    rejected = kept(_rejects(st.filter(F.col("_status").isNull() | ~F.col("_status").isin("draft", "ready_to_ship")),
                             "only draft or ready-to-ship shipments can be edited", -1))
    sv, cv, av, bad = _validate_shipments(_drop(requests, rejected), containers, allocations)
    rejected = rejected.unionByName(bad)
    admitted = G.admit_shipments(t, av.join(sv.select("request_id", "client_id"), "request_id"),
                                 edits=sv.select("request_id", "shipment_id"))
    rejected = kept(rejected.unionByName(
        _rejects(admitted.filter(F.col("outcome") != "accepted"), F.col("reason"), 6)))
    sv = kept(sinks.one_per_key(_drop(sv, rejected), ["shipment_id"], ["request_id"]))
    ids = sv.select("request_id", "shipment_id")
    new_c, new_a, first = _structure_rows(t, ids, cv, av)
    patch = sv.join(first, "request_id", "left").select(
        F.col("shipment_id").alias("id"), *_header_values())
    shipments = t["shipments"]
    for c, kind in patch.dtypes:
        if c not in shipments.columns:
            shipments = shipments.withColumn(c, F.lit(None).cast(kind))
    shipments, _ = sinks.update_by_key(shipments, patch, ["id"], HEADER_COLUMNS)
    replaced = sv.select("shipment_id")
    out = t.replace(shipments=shipments,
                    shipment_containers=sinks.replace_children(t["shipment_containers"], "shipment_id", new_c,
                                                               replaced),
                    shipment_allocations=sinks.replace_children(t["shipment_allocations"], "shipment_id", new_a,
                                                                replaced))
    return out, _first_reason(rejected)


def _taken(rows: DataFrame, key: str, target: DataFrame) -> DataFrame:
    """Rows whose key exists in the target or belongs to an earlier request of the batch."""
    first = rows.groupBy(F.col(key).alias("_fk")).agg(F.min("request_id").alias("_first"))
    known = target.select(F.col(key).alias("_tk")).distinct()
    j = rows.join(first, rows[key] == first["_fk"]).join(known, rows[key] == known["_tk"], "left")
    return j.filter(F.col("_tk").isNotNull() | (F.col("request_id") > F.col("_first"))).drop("_fk", "_first", "_tk")


def ingest_roles(t: Tables, roles: DataFrame, mapping: DataFrame) -> tuple[Tables, DataFrame]:
    """Roles (request_id, name, description) with permission ids (request_id, permission_id)."""
    rv, rr = Q.validate(_complete(roles, Q.ROLE_RULES), Q.ROLE_RULES, keep=["request_id"], once=True)
    rejected = _rejects(rr, F.concat(F.lit("invalid role: "), Q.errors_text()), 0)
    rejected = rejected.unionByName(_rejects(_taken(rv, "name", t["roles"]), "role name already exists", 1))
    rv = _new_ids(_drop(rv, rejected), t["roles"], ["request_id"])
    pairs = mapping.join(rv.select("request_id", F.col("id").alias("role_id")), "request_id") \
        .select("role_id", F.col("permission_id").cast("bigint"))
    out = t.replace(roles=sinks.append(t["roles"], rv.select("id", "name", "description")),
                    role_permissions=sinks.insert_absent(t["role_permissions"], pairs, ["role_id", "permission_id"]))
    return out, _first_reason(rejected)


def replace_role_permissions(t: Tables, mapping: DataFrame, role_ids: DataFrame) -> Tables:
    """I5 (replace form): the listed roles get exactly the given permission set (possibly empty)."""
    new = mapping.select(F.col("role_id").cast("bigint"), F.col("permission_id").cast("bigint")).distinct()
    return t.replace(role_permissions=sinks.replace_children(t["role_permissions"], "role_id", new, role_ids))


PRODUCT_COLUMNS = [r.field for r in PRODUCT_RULES] + ["packaging_details"]


def _judged_products(rows: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Typed product rows with canonical packaging JSON, and what the rules reject (step 0)."""
    if "packaging_details" not in rows.columns:
        rows = rows.withColumn("packaging_details", F.lit(None).cast("string"))
    errors = packaging_errors(F.col("packaging_details"))
    pv, pr = Q.validate(_complete(rows, PRODUCT_RULES), PRODUCT_RULES, keep=[*keep, "packaging_details"], extra=errors, once=True)
    texts = {r.field for r in PRODUCT_RULES if r.kind == "text" and r.field != "name"}
    pv = pv.select(*keep, *[blank_to_null(c).alias(c) if c in texts else F.col(c) for c in PRODUCT_COLUMNS[:-1]],
                   packaging_json(F.col("packaging_details")).alias("packaging_details"))
    return pv, _rejects(pr, F.concat(F.lit("invalid product: "), Q.errors_text()), 0)


def ingest_products(t: Tables, rows: DataFrame) -> tuple[Tables, DataFrame]:
    """Validate, tolerant packaging-JSON parse (re-serialised canonically), unique SKU, append."""
    pv, rejected = _judged_products(rows, ["request_id"])
    rejected = rejected.unionByName(_rejects(_taken(pv.filter("sku is not null"), "sku", t["products"]), "sku already exists", 1))
    pv = _new_ids(_drop(pv, rejected), t["products"], ["request_id"]).withColumn("is_active", F.lit(True))
    return t.replace(products=sinks.append(t["products"], pv.drop("request_id"))), _first_reason(rejected)


def apply_product_edits(t: Tables, rows: DataFrame) -> tuple[Tables, DataFrame]:
    """I6 (update form): rows carry product_id; every field is replaced.  A SKU of another product is
    refused, as is an unknown product; of several accepted edits of one product the last one stands."""
    pv, rejected = _judged_products(rows, ["request_id", "product_id"])
    p = t["products"].select(F.col("id").alias("_pid"))
    unknown = pv.join(p, pv["product_id"] == p["_pid"], "left_anti")
    rejected = rejected.unionByName(_rejects(unknown, "product not found", 1))
    owners = t["products"].filter("sku is not null").select(F.col("sku").alias("_sku"), F.col("id").alias("_owner"))
    asked = _drop(pv, rejected)
    clash = asked.join(owners, (asked["sku"] == owners["_sku"]) & (asked["product_id"] != owners["_owner"]), "left_semi")
    first = asked.filter("sku is not null").groupBy(F.col("sku").alias("_fs")).agg(F.min_by("product_id", "request_id").alias("_winner"))
    later = asked.join(first, (asked["sku"] == first["_fs"]) & (asked["product_id"] != first["_winner"]), "left_semi")
    rejected = rejected.unionByName(_rejects(clash.unionByName(later), "sku already exists", 2))
    products = t["products"]
    for c, kind in pv.dtypes:
        if c in PRODUCT_COLUMNS and c not in products.columns:
            products = products.withColumn(c, F.lit(None).cast(kind))
    patch = _drop(pv, rejected).withColumnRenamed("product_id", "id")
    products, _ = sinks.update_by_key(products, patch, ["id"], PRODUCT_COLUMNS, order=["request_id"])
    return t.replace(products=products), _first_reason(rejected)


GATE_PASS_COLUMNS = ["clearing_agent_id", "transporter_name", "transporter_contact", "transporter_phone",
                     "truck_number", "driver_name", "driver_phone", "loading_address", "delivery_address",
                     "seal_numbers"]


def apply_gate_pass(t: Tables, patches: DataFrame, target: str = "export_orders") -> tuple[Tables, DataFrame]:
    """S8 (gate pass): patches (request_id, id, gate-pass fields, seal_numbers text) -> updated table.

    Blank texts are stored as NULL and seal numbers as a JSON list.  Shipments accept the update
    only while not shipped/completed/cancelled; unknown ids and blocked rows come back rejected."""
    pv, pr = Q.validate(_complete(patches, Q.GATE_PASS_RULES), Q.GATE_PASS_RULES, keep=["request_id", "id", "seal_numbers"])
    rejected = _rejects(pr, F.concat(F.lit("invalid gate pass: "), Q.errors_text()))
    pv = _drop(pv, rejected)
    patch = pv.select("request_id", "id", "clearing_agent_id",
                      *[blank_to_null(c).alias(c) for c in GATE_PASS_COLUMNS[1:-1]],
                      seal_list(F.col("seal_numbers")).alias("seal_numbers"))
    table = t[target]
    for c in GATE_PASS_COLUMNS:
        if c not in table.columns:
            table = table.withColumn(c, F.lit(None).cast("bigint" if c.endswith("_id") else "string"))
    where = None
    if target == "shipments":
        where = ~F.col("status").isin("shipped", "completed", "cancelled")
    updated, missing = sinks.update_by_key(table, patch, ["id"], GATE_PASS_COLUMNS, where=where, order=["request_id"])
    rejected = rejected.unionByName(
        _rejects(patch.join(missing.select("id"), "id", "left_semi"), "not found or cannot be edited", 1))
    return t.replace(**{target: updated}), _first_reason(rejected)
