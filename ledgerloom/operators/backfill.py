"""Backfills (B1-B4).  Each is idempotent: running it on its own output changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import col_

NEW_CONTAINER_LINE = 0  # id of a backfilled container = shipment_id * 10 + this


def backfill_containers(shipments: DataFrame, containers: DataFrame) -> DataFrame:
    """B1: one container (line 1) for every shipment that has none; number = the shipment's own
    container number or CONTAINER-<id>."""
    has = containers.select(F.col("shipment_id").alias("_sid")).distinct()
    missing = shipments.join(has, shipments["id"] == has["_sid"], "left_anti")
    own = F.col("container_number") if "container_number" in shipments.columns else F.lit(None).cast("string")
    ctype = F.col("container_type") if "container_type" in shipments.columns else F.lit(None).cast("string")
    cbm = F.col("cbm") if "cbm" in shipments.columns else F.lit(None).cast("decimal(12,3)")
    seals = F.col("seal_numbers") if "seal_numbers" in shipments.columns else F.lit(None).cast("string")
    new = missing.select(
        (F.col("id") * 10 + NEW_CONTAINER_LINE).alias("id"),
        F.col("id").alias("shipment_id"),
        F.lit(1).alias("line_number"),
        F.coalesce(F.nullif(own, F.lit("")), F.concat(F.lit("CONTAINER-"), F.col("id").cast("string")))
        .alias("container_number"),
        ctype.alias("container_type"),
        cbm.cast("decimal(12,3)").alias("cbm"),
        seals.alias("seal_numbers"))
    carries = "seal_numbers" in {*containers.columns, *shipments.columns}
    return new if carries else new.drop("seal_numbers")


def backfill_allocation_containers(allocations: DataFrame, containers: DataFrame) -> DataFrame:
    """B2: allocations without a container point at their shipment's first container (MIN(id))."""
    first = containers.groupBy(F.col("shipment_id").alias("_fsid")).agg(F.min("id").alias("_first"))
    j = allocations.join(first, allocations["shipment_id"] == first["_fsid"], "left")
    return j.select(*[F.coalesce(F.col(c), F.col("_first")).alias(c) if c == "shipment_container_id" else F.col(c)
                      for c in allocations.columns])


def number_text(c: Column) -> Column:
    """A number as JSON would print it: integral values without decimals, no trailing zeros."""
    s = c.cast("decimal(20,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")


def backfill_packing(products: DataFrame) -> DataFrame:
    """Legacy 'Carton' products become 'Jar'.  pieces/pack = first non-null of pieces_per_pack,
    pieces_per_box, units_per_carton, 0; packs/carton = first of packs_per_carton, jars_per_carton,
    pieces_per_unit, 0.  pieces/pack is stored in pieces_per_unit and packs/carton in
    units_per_carton; the JSON is rewritten to the two canonical keys."""
    details = F.from_json(F.coalesce(F.col("packaging_details"), F.lit("{}")), "map<string,string>")
    # a JSON column cannot hold unparseable text: such rows are left as they are (not migrated)
    pick = lambda k: details.getItem(k).try_cast("decimal(12,3)")
    pieces = F.coalesce(pick("pieces_per_pack"), pick("pieces_per_box"), F.col("units_per_carton"),
                        F.lit(0).cast("decimal(12,3)")).cast("decimal(12,3)")
    packs = F.coalesce(pick("packs_per_carton"), pick("jars_per_carton"), F.col("pieces_per_unit"),
                       F.lit(0).cast("decimal(12,3)")).cast("decimal(12,3)")
    legacy = (F.col("package_type") == "Carton") & details.isNotNull()
    js = F.concat(F.lit('{"pieces_per_pack":'), number_text(pieces), F.lit(',"packs_per_carton":'),
                  number_text(packs), F.lit("}"))
    return products.select(
        *[c for c in products.columns if c not in ("package_type", "pieces_per_unit", "units_per_carton",
                                                   "packaging_details")],
        F.when(legacy, F.lit("Jar")).otherwise(F.col("package_type")).alias("package_type"),
        F.when(legacy, pieces).otherwise(F.col("pieces_per_unit")).alias("pieces_per_unit"),
        F.when(legacy, packs).otherwise(F.col("units_per_carton")).alias("units_per_carton"),
        F.when(legacy, js).otherwise(F.col("packaging_details")).alias("packaging_details"))


def backfill_bank_account(orders: DataFrame, default_account_id) -> DataFrame:
    """Orders without a bank account get the default one."""
    return orders.withColumn("bank_account_id", F.coalesce(F.col("bank_account_id"), F.lit(default_account_id)))


#: The two canonical keys of packaging details.
PACKAGING_KEYS = ("pieces_per_pack", "packs_per_carton")


def _packaging(c, key: str) -> tuple[Column, Column]:
    """(text, number) of a packaging key; text that is no JSON object has no keys, null counts as 0."""
    text = F.from_json(col_(c), "map<string,string>").getItem(key)
    trimmed = F.trim(text)
    return text, F.when(text.isNull() | (trimmed == ""), F.lit(0).cast("decimal(12,3)")).otherwise(trimmed.try_cast("decimal(12,3)"))


def packaging_errors(c) -> list[Column]:
    """Validation errors of packaging details: each number must be one, and not negative."""
    out = []
    for key in PACKAGING_KEYS:
        _, n = _packaging(c, key)
        for bad, reason in ((n.isNull(), "not a number"), (n < 0, "below 0")):
            out.append(F.when(bad, F.struct(F.lit(key).alias("field"), F.lit(reason).alias("reason"))))
    return out


def packaging_json(c) -> Column:
    """Canonical packaging JSON, numbers written as JSON would print them."""
    a, b = (number_text(_packaging(c, key)[1]) for key in PACKAGING_KEYS)
    return F.concat(F.lit(f'{{"{PACKAGING_KEYS[0]}":'), a, F.lit(f',"{PACKAGING_KEYS[1]}":'), b, F.lit("}"))
