"""Row validation and data-quality jobs.

Output contract: ``(valid_df, rejected_df)``; rejected rows carry ``errors: array<struct<field,
reason>>``.  Rules compile to Column expressions, so validation is one narrow projection per row
with no shuffle; uniqueness and referential checks pre-aggregate keys before joining back.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import js_trim
from ledgerloom.session import kept
from ledgerloom.sources.schemas import ORDER_STATUSES, PACKAGE_TYPES, PARTY_TYPES

DATE_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
EMAIL_RE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


#: Numbers are compared in this type before they take their own.
WIDE = "decimal(38,10)"


@dataclass(frozen=True)
class Rule:
    """One field rule.

    kind: 'id' (positive integer), 'number' (min/max/positive), 'date' (strict yyyy-MM-dd, untrimmed),
    'text' (trimmed, min/max length, default), 'enum' (domain, default), 'email', 'bool' (default).

    Numbers are read as text: blank and NULL count as 0, and bounds hold for the stored type, so a
    value that the type cannot hold (or rounds to 0 where it must be positive) is rejected.  NULL is
    accepted where ``nullable``; the empty text too where ``blank_null`` (it becomes NULL)."""

    field: str
    kind: str
    required: bool = True
    nullable: bool = False
    min: float | None = None
    max: float | None = None
    positive: bool = False
    integer: bool = False
    min_len: int | None = None
    max_len: int | None = None
    domain: Sequence[str] | None = None
    default: object = None
    dtype: str | None = None
    blank_null: bool = False


def _err(cond: Column, fld: str, reason: str) -> Column:
    return F.when(cond, F.struct(F.lit(fld).alias("field"), F.lit(reason).alias("reason")))


def _number(r: Rule, txt: Column) -> Column:
    """Numeric coercion: blank and NULL become 0; any other non-number is NULL (and rejected)."""
    raw = F.col(r.field).cast("string")
    num = F.when(raw.isNull() | (txt == ""), F.lit(0).cast(WIDE)).otherwise(txt.try_cast(WIDE))
    if r.default is not None:
        num = F.when(raw.isNull(), F.lit(r.default).cast(WIDE)).otherwise(num)
    return num


def _read_once(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows with every ruled field's trimmed text and number as columns of their own: a rule names them several
    times, and as expressions they would be trimmed and parsed again each time."""
    df = df.withColumns({f"_text_{r.field}": js_trim(F.col(r.field).cast("string")) for r in rules if r.kind != "date"})
    return df.withColumns({f"_number_{r.field}": _number(r, F.col(f"_text_{r.field}")) for r in rules if r.kind in ("id", "number")})


ERRORS = "array<struct<field:string,reason:string>>"


def _possible(errs: Sequence[Column]) -> Column:
    """The array of all possible errors, made only for rows that have one."""
    return F.when(F.coalesce(*errs).isNotNull(), F.array(*errs)) if errs else F.lit(None).cast(ERRORS)


def _found(possible: str) -> Column:
    """The errors that a row has.  What a lambda function filters is interpreted, not compiled, so only rows with an
    error are filtered; named twice, the array stays a step of its own (Spark merges a projection into the next one
    if that names it once)."""
    return F.when(F.col(possible).isNull(), F.array().cast(ERRORS)).otherwise(F.filter(possible, lambda x: x.isNotNull()))


def compile_rule(r: Rule) -> tuple[Column, list[Column]]:
    """Rule -> (coerced value, possible errors), over rows of ``_read_once``."""
    raw = F.col(r.field).cast("string")
    txt = F.col(f"_text_{r.field}")
    absent = raw.isNull()
    if r.blank_null:
        absent = absent | (raw == "")
    errs: list[Column] = []
    if r.kind in ("id", "number"):
        dtype = r.dtype or ("bigint" if r.kind == "id" else "decimal(14,2)")
        num = F.col(f"_number_{r.field}")
        value = typed = num.try_cast(dtype)
        if r.kind == "id" or r.integer:
            value = F.when(num == F.floor(num), typed)
        here = ~absent if r.nullable else F.lit(True)
        known = here & num.isNotNull()
        errs.append(_err(here & num.isNull(), r.field, "not a number"))
        if r.kind == "id" or r.integer:
            errs.append(_err(known & (num != F.floor(num)), r.field, "not an integer"))
        above = num > F.lit(str(r.max)).cast(WIDE) if r.max is not None else F.lit(False)
        errs.append(_err(known & typed.isNull() & ~above, r.field, "out of range"))
        if r.kind == "id" or r.positive:
            errs.append(_err(known & (F.coalesce(typed.cast(WIDE), num) <= 0), r.field, "must be positive"))
        if r.min is not None:
            errs.append(_err(known & (num < F.lit(str(r.min)).cast(WIDE)), r.field, f"below {r.min:g}"))
        if r.max is not None:
            errs.append(_err(known & above, r.field, f"above {r.max:g}"))
        return (F.when(~absent, value) if r.nullable else value), errs
    if r.kind == "date":
        parsed = raw.try_cast("date")
        bad = F.coalesce(~raw.rlike(DATE_RE), F.lit(True)) | parsed.isNull()
        if r.nullable:
            bad = ~absent & bad
        errs.append(_err(bad, r.field, "invalid date"))
        return F.when(~bad & ~absent, parsed), errs
    if r.kind == "bool":
        value = txt.try_cast("boolean")
        errs.append(_err(raw.isNotNull() & value.isNull(), r.field, "not a boolean"))
        return F.when(raw.isNull(), F.lit(bool(r.default))).otherwise(value), errs
    if r.kind in ("text", "email", "enum"):
        value = txt
        if r.default is not None:
            value = F.when(raw.isNull(), F.lit(r.default)).otherwise(value)
        if r.blank_null:
            value = F.when(~absent, value)
        if r.required and r.default is None and not r.nullable:
            errs.append(_err(raw.isNull(), r.field, "required"))
        if r.min_len is not None:
            errs.append(_err(F.length(value) < r.min_len, r.field, f"shorter than {r.min_len}"))
        if r.max_len is not None:
            errs.append(_err(F.length(value) > r.max_len, r.field, f"longer than {r.max_len}"))
        if r.kind == "email":
            errs.append(_err(~absent & ~txt.rlike(EMAIL_RE), r.field, "invalid e-mail"))
            value = F.lower(value)
        if r.kind == "enum":
            errs.append(_err(value.isNotNull() & ~value.isin(list(r.domain or [])), r.field, "not allowed"))
        return value, errs
    raise ValueError(f"unknown rule kind {r.kind}")


def exclusive(a: str, b: str, message: str = "choose one, not both") -> Column:
    """V2: two optional fields that must not both be filled."""
    fa = js_trim(F.col(a).cast("string"))
    fb = js_trim(F.col(b).cast("string"))
    return _err(F.coalesce(fa != "", F.lit(False)) & F.coalesce(fb != "", F.lit(False)), a, message)


def validate(df: DataFrame, rules: Sequence[Rule], keep: Iterable[str] = (), extra: Sequence[Column] = (), once: bool = False) \
        -> tuple[DataFrame, DataFrame]:
    """V1: apply rules; returns (valid, rejected) with coerced columns and an ``errors`` array.

    ``once``: the judged rows are kept in the shared folder, so that jobs which read both sides several times
    compile and evaluate the rules once."""
    values, errs = [], []
    for r in rules:
        v, e = compile_rule(r)
        values.append(v.alias(r.field))
        errs.extend(e)
    errs.extend(extra)
    checked = _read_once(df, rules).select(*[F.col(k) for k in keep], *values, _possible(errs).alias("errors"))
    checked = checked.withColumn("errors", _found("errors"))
    if once:
        checked = kept(checked)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def errors_text(col: str = "errors") -> Column:
    """Flat 'field:reason;field:reason' text of an errors array (for reports and oracle checks)."""
    return F.array_join(F.transform(F.col(col), lambda e: F.concat(e["field"], F.lit(":"), e["reason"])), ";")


def _texts(names: Iterable[str], max_len: int | None = None) -> list[Rule]:
    return [Rule(n, "text", required=False, nullable=True, max_len=max_len) for n in names]


# Payment request rules of the ledger.
PAYMENT_RULES = [
    Rule("order_id", "id"),
    Rule("amount", "number", positive=True, max=999999999999.99, dtype="decimal(14,2)"),
    Rule("payment_date", "date"),
    *_texts(["reference_number"], 120), *_texts(["notes"], 500),
]

# Request rules for the master data and report filters.
PARTY_RULES = [
    Rule("party_type", "enum", domain=PARTY_TYPES), Rule("name", "text", min_len=2),
    *_texts(["contact_person", "business_id", "phone"]),
    Rule("email", "email", required=False, nullable=True, blank_null=True),
    *_texts(["address_line_1", "address_line_2", "city", "state_region", "country", "postal_code"]),
]
BANK_ACCOUNT_RULES = [
    Rule("account_name", "text", min_len=2, max_len=120), Rule("beneficiary_name", "text", min_len=2, max_len=180),
    Rule("bank_name", "text", min_len=2, max_len=180), *_texts(["branch_name"], 180),
    *_texts(["account_number", "iban"], 100), *_texts(["swift_code"], 60),
    Rule("currency", "text", default="USD", min_len=3, max_len=10),
    *_texts(["correspondent_bank"], 180), *_texts(["correspondent_account"], 100),
    *_texts(["correspondent_swift_code"], 60), *_texts(["instructions"], 500),
]
USER_RULES = [
    Rule("name", "text", min_len=2, max_len=120), Rule("email", "email"), *_texts(["phone"], 40), Rule("role_id", "id"),
]
ROLE_RULES = [Rule("name", "text", min_len=2), *_texts(["description"])]
GATE_PASS_RULES = [
    Rule("clearing_agent_id", "id", nullable=True, blank_null=True),
    *_texts(["transporter_name", "transporter_contact", "transporter_phone", "truck_number", "driver_name",
             "driver_phone", "loading_address", "delivery_address"]),
]
REPORT_FILTER_RULES = [
    Rule("date_from", "date", nullable=True, blank_null=True), Rule("date_to", "date", nullable=True, blank_null=True),
    Rule("client_id", "id", nullable=True, blank_null=True),
    Rule("status", "enum", required=False, nullable=True, blank_null=True, domain=ORDER_STATUSES),
    *_texts(["currency"], 10),
]

# Contract, shipment and product request rules.
ORDER_RULES = [
    Rule("client_id", "id"), Rule("customs_consignee_id", "id"), Rule("bank_account_id", "id"),
    Rule("contract_date", "date"), Rule("valid_until", "date", nullable=True),
    *_texts(["sales_contract_number", "payment_term"]),
    Rule("advance_percentage", "number", min=0, max=100, dtype="decimal(5,2)"),
    Rule("freight_amount", "number", min=0, dtype="decimal(14,2)"), Rule("currency", "text", default="USD"),
    *_texts(["port_of_loading", "port_of_destination", "final_destination", "shipping_type", "shipped_per",
             "freight_term", "customer_instructions", "notes"]),
]
ITEM_RULES = [
    Rule("product_id", "id"), Rule("quantity", "number", positive=True, dtype="decimal(12,3)"),
    Rule("quantity_unit", "text", default="CTN"),
    Rule("net_weight_per_carton", "number", min=0, dtype="decimal(12,3)"),
    Rule("gross_weight_per_carton", "number", min=0, dtype="decimal(12,3)"),
    Rule("client_price_per_carton", "number", min=0, dtype="decimal(14,4)"),
    Rule("customs_price_per_kg", "number", min=0, dtype="decimal(14,4)"),
    Rule("is_sample", "bool", default=False), *_texts(["description_override"]),
]
SHIPMENT_RULES = [
    Rule("client_id", "id"), Rule("customs_consignee_id", "id"),
    Rule("also_notify_party_id", "id", nullable=True, blank_null=True), Rule("shipment_date", "date"),
    *_texts(["gd_number", "fi_number"], 120), Rule("currency", "text", default="USD"),
    *_texts(["port_of_loading", "port_of_destination", "final_destination", "shipping_type", "shipped_per"]),
    *_texts(["vessel_name"], 150), *_texts(["voyage_number", "bl_number"], 100),
    Rule("bl_date", "date", nullable=True, blank_null=True), *_texts(["freight_term", "notes"]),
]
CONTAINER_RULES = [
    Rule("container_number", "text", min_len=1, max_len=120), *_texts(["container_type"], 80),
    Rule("cbm", "number", min=0, dtype="decimal(12,3)"),
]
ALLOCATION_RULES = [
    Rule("export_order_item_id", "id"), Rule("container_index", "number", min=0, integer=True, dtype="int"),
    Rule("quantity", "number", positive=True, dtype="decimal(12,3)"),
]
PRODUCT_RULES = [
    *_texts(["sku"]), Rule("name", "text", min_len=2), *_texts(["description", "hs_code"]),
    Rule("package_type", "enum", domain=PACKAGE_TYPES, default="Jar"),
    Rule("units_per_carton", "number", min=0, dtype="decimal(12,3)"),
    Rule("pieces_per_unit", "number", min=0, dtype="decimal(12,3)"),
    Rule("unit_weight_grams", "number", min=0, dtype="decimal(12,3)"),
    Rule("net_weight_per_carton", "number", min=0, dtype="decimal(12,3)"),
    Rule("gross_weight_per_carton", "number", min=0, dtype="decimal(12,3)"),
    Rule("default_client_price", "number", min=0, dtype="decimal(14,4)"),
    Rule("default_customs_price_per_kg", "number", min=0, dtype="decimal(14,4)"), *_texts(["image_url"]),
]
RULE_SETS = {
    "payments": PAYMENT_RULES, "parties": PARTY_RULES, "bank_accounts": BANK_ACCOUNT_RULES, "users": USER_RULES,
    "roles": ROLE_RULES, "gate_pass": GATE_PASS_RULES, "report_filters": REPORT_FILTER_RULES, "orders": ORDER_RULES,
    "order_items": ITEM_RULES, "shipments": SHIPMENT_RULES, "containers": CONTAINER_RULES,
    "allocations": ALLOCATION_RULES, "products": PRODUCT_RULES,
}


def judge(raw: DataFrame, rules: Sequence[Rule], keep: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Every row with its coerced values, validity and error text (the report form of ``validate``)."""
    compiled = [(r.field, *compile_rule(r)) for r in rules]
    errs = [e for _, _, some in compiled for e in some] + list(extra)
    checked = _read_once(raw, rules).select(*keep, *[v.alias(n) for n, v, _ in compiled], _possible(errs).alias("errors"))
    checked = checked.withColumn("errors", _found("errors"))
    return checked.select(*keep, *[n for n, _, _ in compiled], (F.size("errors") == 0).alias("is_valid"), errors_text().alias("errors"))


def validate_payments(raw: DataFrame) -> DataFrame:
    """V1 on payment requests: every request with coerced values, validity flag and error text."""
    if "notes" not in raw.columns:
        raw = raw.withColumn("notes", F.lit(None).cast("string"))
    return judge(raw, PAYMENT_RULES, ["request_id"]).select(
        "request_id", "order_id", "amount", "payment_date", F.nullif(F.col("reference_number"), F.lit("")).alias("reference_number"),
        "is_valid", "errors")


def unique_violations(df: DataFrame, keys: Sequence[str], target: DataFrame | None = None,
                      lower: Sequence[str] = ()) -> DataFrame:
    """V3: rows whose key repeats within the batch, or already exists in ``target``.

    Keys are counted with a (partially aggregated) groupBy and joined back — no window over a key,
    so a hot key never lands whole in one task."""
    norm = df
    for k in lower:
        norm = norm.withColumn(k, F.lower(F.col(k)))
    counts = norm.groupBy(*keys).agg(F.count(F.lit(1)).alias("dup_count")).filter(F.col("dup_count") > 1)
    out = norm.join(counts, list(keys), "left").withColumn("in_batch", F.col("dup_count").isNotNull())
    if target is not None:
        t = target
        for k in lower:
            t = t.withColumn(k, F.lower(F.col(k)))
        existing = t.select(*keys).distinct().withColumn("_exists", F.lit(True))
        out = out.join(existing, list(keys), "left").withColumn("in_target", F.coalesce("_exists", F.lit(False)))
        out = out.drop("_exists").filter(F.col("in_batch") | F.col("in_target"))
    else:
        out = out.filter(F.col("in_batch"))
    return out


def judge_items(items: DataFrame, products: DataFrame) -> DataFrame:
    """V4 line by line: product must exist, be active, have units/carton ≠ 0 (``line_reason``); the master
    units/carton replaces the supplied one."""
    p = products.select(F.col("id").alias("_pid"), F.col("name").alias("_pname"),
                        F.col("units_per_carton").alias("_master_units"), F.col("is_active").alias("_pactive"))
    j = items.join(p, items["product_id"] == p["_pid"], "left")
    reason = (F.when(F.col("_pid").isNull(), "product unavailable")
              .when(~F.col("_pactive"), "product inactive")
              .when(F.coalesce(F.col("_master_units"), F.lit(0)) == 0, "units per carton not set"))
    return (j.withColumn("line_reason", reason)
            .withColumn("units_per_carton", F.coalesce(F.col("_master_units"), F.lit(0).cast("decimal(12,3)")))
            .drop("_pid", "_pname", "_master_units", "_pactive"))


def normalize_items(items: DataFrame, products: DataFrame, request_key: str = "export_order_id") -> DataFrame:
    """V4: the judged lines; a request is rejected whole when any of its lines is."""
    j = judge_items(items, products)
    bad = (j.filter(F.col("line_reason").isNotNull()).groupBy(F.col(request_key).alias("_rk"))
           .agg(F.count(F.lit(1)).alias("_bad_lines")))
    j = j.join(bad, j[request_key] == bad["_rk"], "left")
    return j.withColumn("request_rejected", F.col("_bad_lines").isNotNull()).drop("_rk", "_bad_lines")


def check_bank_account(orders: DataFrame, accounts: DataFrame, col: str = "bank_account_id") -> DataFrame:
    """V5: orders carrying an active bank account (flag + reason)."""
    active = accounts.filter(F.col("is_active")).select(F.col("id").alias("_baid"), F.lit(True).alias("_ok"))
    j = orders.join(active, orders[col] == active["_baid"], "left")
    return (j.withColumn("bank_account_ok", F.coalesce(F.col("_ok"), F.lit(False)))
            .withColumn("bank_reason", F.when(~F.col("bank_account_ok"), "select an active bank account"))
            .drop("_baid", "_ok"))


def check_shipment_structure(containers: DataFrame, allocations: DataFrame) -> DataFrame:
    """V6: per request — container numbers unique (case-insensitive); every allocation names an
    existing container index; (line, container) unique; every container used.

    ``containers``: request_id, container_index, container_number;
    ``allocations``: request_id, export_order_item_id, container_index."""
    c = containers.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.count_distinct(F.lower(F.col("container_number"))).alias("n_numbers"))
    known = containers.select("request_id", "container_index").distinct().withColumn("_known", F.lit(True))
    a = allocations.join(known, ["request_id", "container_index"], "left")
    per_pair = a.groupBy("request_id", "export_order_item_id", "container_index").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.coalesce("_known", F.lit(False))).alias("_k"))
    # steps in tasks of their own: one task would hold the pairs, the counts of both sides and their sorts at a time
    a_stats = kept(per_pair).groupBy("request_id").agg(
        F.count_if(~F.col("_k")).alias("unknown_refs"),
        F.count_if(F.col("_n") > 1).alias("repeated_pairs"),
        F.count_distinct(F.when(F.col("_k"), F.col("container_index"))).alias("used_containers"))
    j = kept(c).join(kept(a_stats), "request_id", "full")
    reason = (F.when(F.col("n_numbers") < F.col("n_containers"), "container numbers must be unique")
              .when(F.coalesce("unknown_refs", F.lit(0)) > 0, "allocation references an unavailable container")
              .when(F.coalesce("repeated_pairs", F.lit(0)) > 0, "a line may appear once per container")
              .when(F.coalesce("used_containers", F.lit(0)) < F.coalesce("n_containers", F.lit(0)),
                    "every container needs an allocation"))
    return j.select("request_id", reason.alias("reason"), reason.isNull().alias("is_valid"))


def orphans(child: DataFrame, fk: str, parent: DataFrame, parent_key: str = "id", nullable: bool = True,
            label: str | None = None, child_key: str = "id") -> DataFrame:
    """Child rows whose foreign key has no parent (NULL allowed when the FK is nullable)."""
    p = parent.select(F.col(parent_key).alias("_pk")).distinct()
    c = child.filter(F.col(fk).isNotNull()) if nullable else child
    out = c.join(p, c[fk] == p["_pk"], "left_anti")
    return out.select(F.lit(label or fk).alias("fk_name"), F.col(child_key).cast("bigint").alias("child_id"),
                      F.col(fk).cast("bigint").alias("fk_value"))


def all_orphans(t, keys: Iterable[tuple[str, str, str, str, bool]]) -> DataFrame:
    """J11 over many foreign keys (label, child, fk, parent, nullable) at once.

    Every child table is stacked as (key, child_id, parent, value), key and parent by their numbers.  The values
    and the parents' ids are one relation, reduced to one row per (parent, value) by every task before it is
    shuffled, which tells the values without a parent; only these go back to the children.  They are written first,
    so that the planner sees their size and few of them are broadcast: the children then are not shuffled.  A NULL
    in a key that must not be NULL is an orphan."""
    keys = list(keys)
    children, parents = {}, {}
    for number, (_, child, fk, parent, nullable) in enumerate(keys):
        children.setdefault(child, []).append((number, fk, parent, nullable))
        parents[parent] = t[parent]
    at = {parent: i for i, parent in enumerate(parents)}

    def stacked(child: str) -> DataFrame:
        refs = [F.struct(F.lit(number).alias("_key"), F.lit(at[parent]).alias("_parent"), F.col(fk).cast("bigint").alias("fk_value"),
                         F.lit(nullable).alias("_nullable")) for number, fk, parent, nullable in children[child]]
        rows = t[child].select(F.col("id").cast("bigint").alias("child_id"), F.explode(F.array(*refs)).alias("r")).select("child_id", "r.*")
        return rows.filter(F.col("fk_value").isNotNull() | ~F.col("_nullable")).drop("_nullable")

    refs = reduce(lambda a, b: a.unionByName(b), [stacked(c) for c in children])
    ids = reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(at[p]).alias("_in"), F.col("id").cast("bigint").alias("_id")) for p, df in parents.items()])
    # one relation of what is wanted and what is there, one row per key and side from each task
    wanted = refs.select(F.col("_parent").alias("_in"), F.col("fk_value").alias("_id"), F.lit(False).alias("_there"))
    seen = wanted.unionByName(ids.withColumn("_there", F.lit(True))).groupBy("_in", "_id").agg(F.max("_there").alias("_there"))
    lost = kept(seen.filter("not _there or _id is null").select("_in", F.col("_id").isNull().alias("_none"), F.coalesce("_id", F.lit(0)).alias("_value")))
    # an inner join on a unique side (a semi-join would be pushed below the union, into every child table)
    refs = refs.withColumns({"_isnull": F.col("fk_value").isNull(), "_at": F.coalesce("fk_value", F.lit(0))})
    labels = F.array(*[F.lit(label) for label, *_ in keys])
    return (refs.join(lost, (F.col("_parent") == F.col("_in")) & (F.col("_isnull") == F.col("_none")) & (F.col("_at") == F.col("_value")))
            .select(F.get(labels, F.col("_key")).alias("fk_name"), "child_id", "fk_value"))
