"""Fulfilment algebra.

Line-level facts (allocations, items) are aggregated to their parent key before they meet
headers, so each join is 1:1 or n:1 on a key and never multiplies detail rows.  Carton numbering is
a running sum per container / per order via the skew-safe ``running_sum``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import QTY_SUM, qty_eps
from ledgerloom.functions.ordering import sort_if
from ledgerloom.functions.text import contract_number_expr
from ledgerloom.operators.balances import line_value
from ledgerloom.sources.tables import with_optional
from ledgerloom.operators.running import LINE_BLOCK_BITS, beyond, by_size, id_block, number_rows, running_sum
from ledgerloom.session import STEP_SETTINGS, kept, release, stored

WEIGHT = "decimal(26,6)"
VALUE = "decimal(30,7)"
CUSTOMS = "decimal(38,10)"


def allocated_qty(t, exclude_shipment_id: int | None = None) -> DataFrame:
    """A10 (+P3): Σ allocated quantity per contract line over non-cancelled shipments."""
    s = t["shipments"].filter(F.col("status") != "cancelled")
    if exclude_shipment_id is not None:
        s = s.filter(F.col("id") != F.lit(exclude_shipment_id))
    s = s.select(F.col("id").alias("_sid"))
    a = t["shipment_allocations"]
    return (a.join(s, a["shipment_id"] == s["_sid"], "left_semi")
            .groupBy("export_order_item_id")
            .agg(F.sum("quantity").cast(QTY_SUM).alias("allocated_quantity")))


def _with_allocated(items: DataFrame, alloc: DataFrame) -> DataFrame:
    a = alloc.withColumnRenamed("export_order_item_id", "_aid")
    return (items.join(a, items["id"] == a["_aid"], "left").drop("_aid")
            .withColumn("allocated_quantity", F.coalesce(F.col("allocated_quantity"), F.lit(0).cast(QTY_SUM))))


def available_lines(t, client_id: int | None = None, exclude_shipment_id: int | None = None,
                    ordered: bool | None = None) -> DataFrame:
    """R5 (+P3, P5): open contract lines of non-cancelled contracts with quantity left > 0.0001."""
    o = t["export_orders"].filter(F.col("status") != "cancelled")
    if client_id is not None:
        o = o.filter(F.col("client_id") == F.lit(client_id))
    o = o.select(F.col("id").alias("contract_id"), "client_id", "invoice_number",
                 contract_number_expr().alias("contract_number"), "contract_date", "currency")
    p = t["products"].select(F.col("id").alias("_pid"), F.col("name").alias("product_name"))
    i = t["export_order_items"]
    lines = (i.join(o, i["export_order_id"] == o["contract_id"], "inner")
             .join(p, i["product_id"] == p["_pid"], "inner"))
    lines = _with_allocated(lines, allocated_qty(t, exclude_shipment_id))
    left = (F.col("quantity") - F.col("allocated_quantity"))
    out = (lines.filter(left > qty_eps())  # HAVING without GROUP BY = a filter on derived columns
            .select(F.col("id").alias("export_order_item_id"), "product_id",
                    F.col("quantity").alias("contract_quantity"), "quantity_unit", "units_per_carton",
                    "net_weight_per_carton", "gross_weight_per_carton", "client_price_per_carton",
                    "customs_price_per_kg", "is_sample", "product_name", "contract_id", "client_id",
                    "invoice_number", "contract_number", "contract_date", "currency", "allocated_quantity",
                    left.cast(QTY_SUM).alias("remaining_quantity"), "line_number"))
    return sort_if(out, client_id is not None if ordered is None else ordered,
                   "contract_date", "contract_id", "line_number")


def _party_names(t, role: str) -> DataFrame:
    return t["parties"].select(F.col("id").alias(f"_{role}_id"), F.col("name").alias(f"{role}_name"))


def order_list(t, ordered: bool = False) -> DataFrame:
    """A11 + T7: order roll-up (packages, weights, value, contracted, allocated incl. drafts)."""
    items = _with_allocated(t["export_order_items"], allocated_qty(t))
    q = F.col("quantity")
    per_order = items.groupBy("export_order_id").agg(
        F.sum(q).cast(QTY_SUM).alias("total_packages"),
        F.sum(q * F.col("net_weight_per_carton")).cast(WEIGHT).alias("total_net_weight"),
        F.sum(q * F.col("gross_weight_per_carton")).cast(WEIGHT).alias("total_gross_weight"),
        F.sum(line_value()).cast(VALUE).alias("client_value"),
        F.sum(q).cast(QTY_SUM).alias("contracted_quantity"),
        F.sum("allocated_quantity").cast(QTY_SUM).alias("shipped_quantity"))
    o = with_optional(t["export_orders"], "export_orders", ["created_at"]).select(
        "id", "invoice_number", "sales_contract_number", "status", "contract_date", "created_at", "currency", "client_id", "customs_consignee_id")
    c, cc = _party_names(t, "client"), _party_names(t, "customs_consignee")
    j = (o.join(c, o["client_id"] == c["_client_id"], "inner")
         .join(cc, o["customs_consignee_id"] == cc["_customs_consignee_id"], "inner")
         .join(per_order, o["id"] == per_order["export_order_id"], "left"))
    zero = {"total_packages": QTY_SUM, "total_net_weight": WEIGHT, "total_gross_weight": WEIGHT,
            "client_value": VALUE, "contracted_quantity": QTY_SUM, "shipped_quantity": QTY_SUM}
    out = j.select("id", "invoice_number", "sales_contract_number", "status", "contract_date", "created_at", "currency",
                   "client_name", "customs_consignee_name",
                   *[F.coalesce(F.col(k), F.lit(0).cast(v)).alias(k) for k, v in zero.items()])
    return sort_if(out, ordered, F.col("created_at").desc(), F.col("id").desc())


def shipment_list(t, ordered: bool = False) -> DataFrame:
    """A12 + T7: shipment roll-up with COUNT(DISTINCT contract) and container count."""
    a = t["shipment_allocations"]
    i = t["export_order_items"].select(F.col("id").alias("_iid"), "export_order_id", "net_weight_per_carton",
                                       "gross_weight_per_carton", "client_price_per_carton", "is_sample")
    q = a["quantity"]
    per_ship = (a.join(i, a["export_order_item_id"] == i["_iid"], "left")
                .groupBy("shipment_id")
                .agg(F.count_distinct("export_order_id").alias("contract_count"),
                     F.sum(q).cast(QTY_SUM).alias("total_packages"),
                     F.sum(q * F.col("net_weight_per_carton")).cast(WEIGHT).alias("total_net_weight"),
                     F.sum(q * F.col("gross_weight_per_carton")).cast(WEIGHT).alias("total_gross_weight"),
                     F.sum(F.when(F.col("is_sample") == F.lit(False), q * F.col("client_price_per_carton"))
                           .otherwise(F.lit(0))).cast(VALUE).alias("client_value")))
    containers = (t["shipment_containers"].groupBy(F.col("shipment_id").alias("_csid"))
                  .agg(F.count(F.lit(1)).alias("container_count")))
    s = with_optional(t["shipments"], "shipments", ["created_at"]).select(
        "id", "shipment_number", "status", "shipment_date", "created_at", "currency", "client_id")
    c = _party_names(t, "client")
    j = (s.join(c, s["client_id"] == c["_client_id"], "inner")
         .join(per_ship, s["id"] == per_ship["shipment_id"], "left")
         .join(containers, s["id"] == containers["_csid"], "left"))
    out = (j.select("id", "shipment_number", "status", "shipment_date", "created_at", "currency", "client_name",
                     F.coalesce("contract_count", F.lit(0)).alias("contract_count"),
                     F.coalesce("container_count", F.lit(0)).alias("container_count"),
                     F.coalesce("total_packages", F.lit(0).cast(QTY_SUM)).alias("total_packages"),
                     F.coalesce("total_net_weight", F.lit(0).cast(WEIGHT)).alias("total_net_weight"),
                     F.coalesce("total_gross_weight", F.lit(0).cast(WEIGHT)).alias("total_gross_weight"),
                     F.coalesce("client_value", F.lit(0).cast(VALUE)).alias("client_value")))
    return sort_if(out, ordered, F.col("created_at").desc(), F.col("id").desc())


#: Bank account columns of the order header, in the account's own names, and the header's where they differ.
BANK_COLUMNS = {"account_name": "bank_account_name", "beneficiary_name": "bank_beneficiary_name", "bank_name": "bank_name", "branch_name": "bank_branch_name",
                "account_number": "bank_account_number", "iban": "bank_iban", "swift_code": "bank_swift_code", "currency": "bank_currency",
                "correspondent_bank": "correspondent_bank", "correspondent_account": "correspondent_account",
                "correspondent_swift_code": "correspondent_swift_code", "instructions": "bank_instructions"}
_PLACE = {"name": "name", "address_line_1": "address", "city": "city", "country": "country"}
_CONTACT = {"name": "name", "phone": "phone", "contact_person": "contact"}


def _in_role(rows: DataFrame, parties: DataFrame, key: str, role: str, columns: dict, how: str = "left") -> DataFrame:
    """The rows with the columns of the party that ``key`` names, prefixed by its role.

    A few parties may be named by most rows, so only the named ones are joined: written once, their size is
    known to the planner, which broadcasts them when they are few instead of dealing all rows by a few keys."""
    if role != "client":  # every client has rows of its own: nothing to narrow
        parties = kept(parties.select("id", *columns).join(rows.select(F.col(key).alias("_named")).distinct(), F.col("id") == F.col("_named"), "left_semi"))
    p = parties.select(F.col("id").alias("_party"), *[F.col(c).alias(f"{role}_{n}") for c, n in columns.items()])
    return rows.join(p, F.col(key) == F.col("_party"), how).drop("_party")


def order_header(t) -> DataFrame:
    """Denormalised order header (client, consignee, clearing agent, bank account columns)."""
    p = t["parties"]
    accounts = with_optional(t["bank_accounts"], "bank_accounts", BANK_COLUMNS)
    accounts = accounts.select(F.col("id").alias("_account"), *[F.col(c).alias(n) for c, n in BANK_COLUMNS.items()])
    h = _in_role(t["export_orders"], p, "client_id", "client", _PLACE, "inner")
    h = _in_role(h, p, "customs_consignee_id", "customs_consignee", _PLACE, "inner")
    h = _in_role(h, p, "clearing_agent_id", "clearing_agent", _CONTACT)
    return h.join(accounts, F.col("bank_account_id") == F.col("_account"), "left").drop("_account")


def line_measures(df: DataFrame, qty: str = "quantity", with_remaining: bool = True) -> DataFrame:
    """Remaining, weights, units, client and customs value (samples are worth 0)."""
    q = F.col(qty)
    sample = F.col("is_sample") == F.lit(True)
    out = df
    if with_remaining:
        out = out.withColumn("remaining_quantity",
                             F.greatest(q - F.col("allocated_quantity"), F.lit(0)).cast(QTY_SUM))
    return (out.withColumn("total_net_weight", (q * F.col("net_weight_per_carton")).cast(WEIGHT))
            .withColumn("total_gross_weight", (q * F.col("gross_weight_per_carton")).cast(WEIGHT))
            .withColumn("total_units", (q * F.col("units_per_carton")).cast(WEIGHT))
            .withColumn("client_value", F.when(sample, F.lit(0))
                        .otherwise(q * F.col("client_price_per_carton")).cast(VALUE))
            .withColumn("customs_value", F.when(sample, F.lit(0))
                        .otherwise((q * F.col("net_weight_per_carton")).cast("decimal(23,6)")
                                   * F.col("customs_price_per_kg")).cast(CUSTOMS)))


def _product_columns(t) -> DataFrame:
    """Product columns of a line, under their names there."""
    p = with_optional(t["products"], "products", ["image_url", "packaging_details"])
    renamed = ("description", "unit_weight_grams", "pieces_per_unit", "package_type", "packaging_details", "image_url")
    return p.select(F.col("id").alias("_pid"), F.col("name").alias("product_name"), "hs_code", *[F.col(c).alias(f"product_{c}") for c in renamed])


#: What each measure of a line draws on.
MEASURES = {"remaining_quantity": ("quantity", "allocated_quantity"), "total_net_weight": ("quantity", "net_weight_per_carton"),
            "total_gross_weight": ("quantity", "gross_weight_per_carton"), "total_units": ("quantity", "units_per_carton"),
            "client_value": ("is_sample", "quantity", "client_price_per_carton"),
            "customs_value": ("is_sample", "quantity", "net_weight_per_carton", "customs_price_per_kg")}


def _step_of(rows: DataFrame, fields: list[str] | None, places: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The lines as a written step, and in their columns: of those that neither ``places`` nor the shown fields (all
    when None) draw on, only NULLs are left."""
    if fields is None:
        step = kept(rows)
        return step, step
    drawn = {*places, *fields, *[c for f in fields for c in MEASURES.get(f, ())]}
    step = kept(rows.select(*[c for c in rows.columns if c in drawn]))
    return step, step.select(*[F.col(c) if c in drawn else F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes])


def order_lines(t, ordered: bool = False, deal_by: str | None = None, measured: bool = True, steps: bool = False,
                fields: list[str] | None = None) -> DataFrame:
    """P12 + P10: items with product attributes, allocated quantity and line measures, by line.

    The joins go from narrow rows to wide ones: product texts come last, so lines are shuffled with them at most
    once, and that before the measures are computed (``deal_by``: the column by which they are dealt).  With
    ``steps`` they are written between the joins and in buckets of that column at last, so that the shuffles of one
    step go before the next; ``fields`` then names what is shown (all when None)."""
    i = with_optional(t["export_order_items"], "export_order_items", ["description_override", "carton_start", "carton_end"]).select(
        "id", "export_order_id", "product_id", "line_number", "carton_start", "carton_end", "quantity", "quantity_unit", "units_per_carton",
        "net_weight_per_carton", "gross_weight_per_carton", "client_price_per_carton", "customs_price_per_kg", "is_sample", "description_override")
    p = _product_columns(t)
    products = [c for c in p.columns if c != "_pid"]
    j = _with_allocated(i, allocated_qty(t))
    j = _with_products(j, p, [*i.columns, *products, "allocated_quantity"], deal_by, steps, fields, ("line_number",))
    return sort_if(line_measures(j) if measured else j, ordered, "export_order_id", "line_number")


def _with_products(rows: DataFrame, products: DataFrame, columns: list[str], deal_by: str | None, steps: bool,
                   fields: list[str] | None = None, places: tuple[str, ...] = ()) -> DataFrame:
    """The lines with their products' columns, dealt by ``deal_by``.

    ``steps``: lines are written before and after the join and dealt in a step of its own, so that what the caller
    joins them with is shuffled when these shuffles are gone."""
    def joined(df: DataFrame) -> DataFrame:
        return df.join(products, F.col("product_id") == F.col("_pid"), "inner").select(*columns)
    if not steps:
        return _dealt(joined(rows), deal_by)
    first, rows = _step_of(rows, fields, (*places, deal_by, "product_id"))
    second, rows = _step_of(joined(rows), fields, (*places, deal_by))
    release(first)
    rows = stored(_dealt(rows, deal_by), "dealt_lines", STEP_SETTINGS, by=deal_by)
    release(second)
    return rows


def shipment_measures(lines: DataFrame) -> DataFrame:
    """P11 on allocation lines; carton ranges come behind the measures."""
    out = line_measures(lines, with_remaining=False)
    ranges = [c for c in ("carton_start", "carton_end") if c in lines.columns]
    return out.select(*[c for c in out.columns if c not in ranges], *ranges)


def _dealt(rows: DataFrame, by: str | None) -> DataFrame:
    return rows if by is None else rows.repartition(F.col(by))


def shipment_lines(t, shipment_id: int | None = None, allocations: DataFrame | None = None, deal_by: str | None = None,
                   measured: bool = True, steps: bool = False) -> DataFrame:
    """P13 + P11: allocation lines with container, item, product and contract, by (container line, line).

    ``allocations`` may carry more columns than the table's own; they come last.  Joins go from narrow rows to
    wide ones, as in ``order_lines``, and ``steps`` are those of ``order_lines``."""
    own = t["shipment_allocations"].columns
    a = t["shipment_allocations"] if allocations is None else allocations
    if shipment_id is not None:
        a = a.filter(F.col("shipment_id") == F.lit(shipment_id))
    sc = t["shipment_containers"].select(F.col("id").alias("_scid"),
                                         F.col("line_number").alias("container_line_number"),
                                         "container_number", "container_type",
                                         F.col("cbm").alias("container_cbm"))
    i = with_optional(t["export_order_items"], "export_order_items", ["description_override"]).select(
        F.col("id").alias("_iid"), "export_order_id", "product_id", "quantity_unit", "units_per_carton", "net_weight_per_carton",
        "gross_weight_per_carton", "client_price_per_carton", "customs_price_per_kg", "is_sample", "description_override")
    p = _product_columns(t)
    o = t["export_orders"].select(F.col("id").alias("contract_id"),
                                  contract_number_expr().alias("contract_number"))
    j = a.join(sc, a["shipment_container_id"] == sc["_scid"], "inner")
    if shipment_id is None:  # all lines: contract items lie by contract, so they meet it before they are dealt by their id
        j = j.join(i.join(o, F.col("export_order_id") == F.col("contract_id"), "inner"), a["export_order_item_id"] == F.col("_iid"), "inner")
    else:
        j = j.join(i, a["export_order_item_id"] == i["_iid"], "inner").join(o, F.col("export_order_id") == o["contract_id"], "inner")
    hidden = {"_scid", "_iid", "_pid", "export_order_id"}
    more = [c for c in a.columns if c not in own]
    columns = [c for part in (own, sc.columns, i.columns, p.columns, o.columns) for c in part if c not in hidden]
    lines = _with_products(j, p, [*columns, *more], deal_by, steps)
    lines = shipment_measures(lines) if measured else lines
    return sort_if(lines, shipment_id is not None, "shipment_id", "container_line_number", "line_number")


def carton_ranges(lines: DataFrame, partition: str, order: list[str], qty: str = "quantity",
                  chunk: list | None = None) -> DataFrame:
    """carton_start = 1 + Σ floor(qty) of earlier lines in the partition; NULL when floor(qty)=0."""
    cartons = F.floor(F.col(qty)).cast("bigint")
    df = lines.withColumn("_cartons", cartons)
    df = running_sum(df, [partition], order, "_cartons", "_before", chunk=chunk, exclusive=True,
                     result_type="bigint")
    return _ranges(df)


def _ranges(df: DataFrame) -> DataFrame:
    has = F.col("_cartons") != 0
    return (df.withColumn("carton_start", F.when(has, F.col("_before") + 1))
            .withColumn("carton_end", F.when(has, F.col("_before") + F.col("_cartons")))
            .drop("_cartons", "_before"))


def _container_ranges(a: DataFrame) -> DataFrame:
    """W3 on whole allocation rows.  Containers of at most a block of lines are dealt once, by the container, which
    the join with the containers takes over; lines of larger ones are numbered by chunks."""
    return by_size(a, "shipment_container_id", lambda df: _window_ranges(df, "shipment_container_id", ["line_number", "id"]),
                   lambda df: carton_ranges(df, "shipment_container_id", ["line_number", "id"], chunk=[id_block("line_number", LINE_BLOCK_BITS)]), bits=LINE_BLOCK_BITS)


def _window_ranges(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Carton ranges in one window per key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = rows.withColumn("_cartons", F.floor(F.col("quantity")).cast("bigint"))
    return _ranges(df.withColumn("_before", F.coalesce(F.sum("_cartons").over(w), F.lit(0)).cast("bigint")))


def numbered_cartons(lines: DataFrame, key: str, order: str) -> DataFrame:
    """W5 + W4: line numbers and carton ranges within a key, in the order of a whole number."""
    def short(df: DataFrame) -> DataFrame:
        df = df.withColumn("line_number", F.row_number().over(Window.partitionBy(key).orderBy(order)))
        return _window_ranges(df, key, ["line_number"])

    def long(df: DataFrame) -> DataFrame:
        df = number_rows(df, [key], [order], "line_number", chunk=[id_block(order, LINE_BLOCK_BITS)])
        return carton_ranges(df, key, ["line_number"], chunk=[id_block("line_number", LINE_BLOCK_BITS)])
    return by_size(lines, key, short, long, bits=LINE_BLOCK_BITS)


def _allocation_ranges(a: DataFrame) -> DataFrame:
    """The allocations with the carton ranges of their id.  An id without a repeat keeps its own row's range; rows
    of a repeated id take every range of that id, and rows without an id none (they have no place in the lines)."""
    numbered = _container_ranges(a).filter(F.col("id").isNotNull())
    repeated = beyond(a.filter(F.col("id").isNotNull()), "id", 1, "_repeated")
    if repeated.isEmpty():
        return numbered
    some = numbered.join(repeated, F.col("id") == F.col("_repeated"), "left_semi")
    ranges = some.select(F.col("id").alias("_aid"), "carton_start", "carton_end")
    every = some.select(*a.columns).join(ranges, F.col("id") == F.col("_aid")).drop("_aid")
    return numbered.join(repeated, F.col("id") == F.col("_repeated"), "left_anti").unionByName(every)


def shipment_cartons(t, deal_by: str | None = None, measured: bool = True, steps: bool = False) -> DataFrame:
    """W3 on shipment lines: numbering restarts in every container, in allocation-line order."""
    return shipment_lines(t, allocations=_allocation_ranges(t["shipment_allocations"]), deal_by=deal_by, measured=measured, steps=steps)


def item_cartons(t) -> DataFrame:
    """Carton ranges of contract items per order, in line order."""
    i = t["export_order_items"].select("id", "export_order_id", "line_number", "quantity")
    return carton_ranges(i, "export_order_id", ["line_number", "id"], chunk=[id_block("line_number", LINE_BLOCK_BITS)])


def contract_numbers(t) -> DataFrame:
    """Distinct contract numbers per shipment in first-appearance (container line, line) order."""
    lines = shipment_lines(t).filter(F.col("contract_number").isNotNull() & (F.col("contract_number") != ""))
    first = (lines.groupBy("shipment_id", "contract_number")
             .agg(F.min(F.struct("container_line_number", "line_number")).alias("_first")))
    # one row per distinct contract of the shipment -> the list is bounded by the contracts it carries
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_first"), F.col("contract_number"))))
    return (first.groupBy("shipment_id")
            .agg(F.array_join(F.transform(ordered, lambda x: x["contract_number"]), ", ")
                 .alias("sales_contract_number")))


def _contract_lists(t) -> DataFrame:
    """Per shipment its distinct contract numbers, by contract date."""
    a = t["shipment_allocations"].select("shipment_id", "export_order_item_id")
    i = t["export_order_items"].select(F.col("id").alias("_iid"), "export_order_id")
    o = t["export_orders"].select(F.col("id").alias("_oid"), "contract_date",
                                  contract_number_expr().alias("_cn"))
    per_contract = (a.join(i, a["export_order_item_id"] == i["_iid"], "inner")
                    .join(o, F.col("export_order_id") == o["_oid"], "inner")
                    .groupBy("shipment_id", "_cn").agg(F.min("contract_date").alias("_d")))
    return per_contract.groupBy(F.col("shipment_id").alias("_ssid")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_cn"))), lambda x: x["_cn"]), ", ")
        .alias("sales_contract_number"))


def shipment_header(t, contracts: bool = True) -> DataFrame:
    """P9 + A13-A15, A17: shipment header with container list, distinct types, cbm, contract list
    (``contracts=False`` leaves the list out for callers that derive it from the lines)."""
    s = t["shipments"]
    sc = t["shipment_containers"]
    cont = sc.groupBy(F.col("shipment_id").alias("_sid")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "container_number"))),
                                 lambda x: x["container_number"]), ", ").alias("container_number"),
        F.array_join(F.array_sort(F.collect_set("container_type")), ", ").alias("container_type"),
        F.sum("cbm").cast("decimal(22,3)").alias("cbm"))
    p = t["parties"]
    head = _in_role(s.drop("container_number", "container_type", "cbm"), p, "client_id", "client", _PLACE, "inner")
    head = _in_role(head, p, "customs_consignee_id", "customs_consignee", _PLACE, "inner")
    head = _in_role(head, p, "also_notify_party_id", "also_notify_party", _PLACE)
    head = _in_role(head, p, "clearing_agent_id", "clearing_agent", _CONTACT)
    head = head.join(cont, head["id"] == cont["_sid"], "left")
    if contracts:
        lists = _contract_lists(t)
        head = head.join(lists, head["id"] == lists["_ssid"], "left").drop("_ssid")
    return (head
            .withColumn("cbm", F.coalesce(F.col("cbm"), F.lit(0).cast("decimal(22,3)")))
            .withColumn("invoice_number", F.col("shipment_number"))
            .withColumn("contract_date", F.col("shipment_date"))
            .drop("_sid"))


def shipment_containers_of(t, shipment_id: int | None = None) -> DataFrame:
    """Containers of a shipment (all when None) by line."""
    sc = with_optional(t["shipment_containers"], "shipment_containers", ["seal_numbers"])
    if shipment_id is not None:
        sc = sc.filter(F.col("shipment_id") == F.lit(shipment_id))
    return sort_if(sc.select("id", "shipment_id", "line_number", "container_number", "container_type", "cbm", "seal_numbers"),
                   shipment_id is not None, "shipment_id", "line_number")


#: Lines of one page of a nested view.
PAGE_LINES = 1000


def paged(lines: DataFrame, parent: str, order: list[str], page_lines: int = PAGE_LINES, measured=None) -> DataFrame:
    """(parent, page, first_line, lines): the parent's lines in order, at most ``page_lines`` in a row.

    Parents that fit one page need no numbers: their lines are dealt once, by parent.  Lines of larger ones are
    numbered by chunks, so neither a row nor a task holds more of a large parent than a page or a chunk; the last
    order column is a number that tells lines apart.  ``measured`` adds columns that follow from the line alone,
    after the lines are dealt, so that they are not shuffled."""
    measured = measured or (lambda df: df)
    sizes = lines.groupBy(F.col(parent).alias("_large")).agg(F.count(F.lit(1)).alias("_n"))
    large = kept(sizes.filter(F.col("_n") > page_lines).select("_large"))  # small: the planner sees its size
    some = not large.isEmpty()
    short = lines.join(large, F.col(parent).eqNullSafe(F.col("_large")), "left_anti") if some else lines
    short = measured(short.repartition(F.col(parent)))
    columns = [c for c in short.columns if c != parent and not c.startswith("_")]
    entry = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], F.struct(*columns).alias("line"))
    pages = short.groupBy(parent).agg(F.sort_array(F.collect_list(entry)).alias("_lines")).withColumn("page", F.lit(0))
    if some:
        long = lines.join(large, F.col(parent).eqNullSafe(F.col("_large")), "left_semi")
        numbered = measured(number_rows(long, [parent], order, "_place", chunk=[id_block(order[0], LINE_BLOCK_BITS)]))
        page = F.floor((F.col("_place") - 1) / page_lines).cast("int")
        entry = F.struct(F.col("_place"), F.struct(*columns).alias("line"))
        more = numbered.groupBy(parent, page.alias("page")).agg(F.sort_array(F.collect_list(entry)).alias("_lines"))
        pages = _page_rows(pages, parent, page_lines).unionByName(_page_rows(more, parent, page_lines))
        return pages
    return _page_rows(pages, parent, page_lines)


def _page_rows(pages: DataFrame, parent: str, page_lines: int) -> DataFrame:
    return pages.select(parent, "page", (F.col("page") * page_lines + 1).alias("first_line"), F.transform("_lines", lambda x: x["line"]).alias("lines"))


def order_detail_pages(t, page_lines: int = PAGE_LINES) -> DataFrame:
    """R6 in pages: (order, page) rows of at most ``page_lines`` lines, each with the order's number and names."""
    pages = paged(order_lines(t, measured=False), "export_order_id", ["line_number", "id"], page_lines, line_measures)
    h = order_header(t).select("id", "invoice_number", "client_name", "customs_consignee_name")
    return h.join(pages, h["id"] == pages["export_order_id"]).drop("export_order_id")


def shipment_detail_pages(t, page_lines: int = PAGE_LINES) -> DataFrame:
    """R7 in pages: (shipment, page) rows of at most ``page_lines`` lines with their carton ranges."""
    lines = shipment_cartons(t, measured=False).withColumn("_first", F.col("container_line_number") * (1 << 32) + F.col("line_number"))
    pages = paged(lines, "shipment_id", ["_first", "id"], page_lines, shipment_measures)
    h = shipment_header(t, contracts=False).select("id", "shipment_number", "client_name")
    return h.join(pages, h["id"] == pages["shipment_id"]).drop("shipment_id")


def order_detail(t, fields: list[str] | None = None, steps: bool = False) -> DataFrame:
    """Order header + nested lines (one row per order; the item list is the order's own lines).

    ``fields`` names the item fields to nest (all when None), as in ``shipment_detail``; for ``steps`` see ``order_lines``."""
    lines = order_lines(t, deal_by="export_order_id", steps=steps, fields=fields)
    item = F.struct(*[F.col(c) for c in lines.columns if c != "export_order_id" and (fields is None or c in fields)])
    nested = lines.groupBy("export_order_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("line_number").alias("_k"), item.alias("v"))))
        .alias("_items"))
    nested = nested.select("export_order_id", F.transform("_items", lambda x: x["v"]).alias("items"))
    h = order_header(t)
    return (h.join(nested, h["id"] == nested["export_order_id"], "left").drop("export_order_id")
            .withColumn("items", F.coalesce(F.col("items"), F.array())))


def shipment_detail(t, fields: list[str] | None = None, steps: bool = False) -> DataFrame:
    """Shipment header + containers[] + lines[] with carton ranges + first-appearance contract list.

    ``fields`` names the item fields to nest (all when None).  Nothing prunes the fields of a collected struct, so a
    caller that shows some of them says so here, and the lines are dealt without the others.  For ``steps``, of all fields, see ``order_lines``."""
    lines = shipment_cartons(t, deal_by="shipment_id", steps=steps)
    shown = [c for c in lines.columns if c != "shipment_id" and (fields is None or c in fields)]
    place = [F.col("container_line_number").alias("_a"), F.col("line_number").alias("_b")]
    nested = lines.groupBy(F.col("shipment_id").alias("_lsid")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(*place, F.struct(*shown).alias("v")))), lambda x: x["v"]).alias("items"),
        # a list of its own, which goes with the column if nobody reads that, unless the items carry the numbers
        *([] if "contract_number" in shown else [F.array_sort(F.collect_list(F.struct(*place, "contract_number"))).alias("_numbered")]))
    cont = shipment_containers_of(t)
    cnest = cont.groupBy(F.col("shipment_id").alias("_csid")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("line_number").alias("_a"),
                                                         F.struct(*cont.columns).alias("v")))),
                    lambda x: x["v"]).alias("containers"))
    h = shipment_header(t, contracts=False)
    # items are in (container line, line) order: their first appearances are the contract list
    carrier = "items" if "contract_number" in shown else "_numbered"
    numbers = F.array_distinct(F.filter(F.transform(carrier, lambda x: x["contract_number"]), lambda x: x.isNotNull() & (x != "")))
    return (h.join(nested, h["id"] == nested["_lsid"], "left")
            .join(cnest, h["id"] == cnest["_csid"], "left")
            .withColumn("sales_contract_number", F.coalesce(F.array_join(numbers, ", "), F.lit("")))
            .withColumn("items", F.coalesce(F.col("items"), F.array()))
            .withColumn("containers", F.coalesce(F.col("containers"), F.array()))
            .drop("_lsid", "_csid", "_numbered"))
