"""Reports over the balance relation.

All grouping is on low-cardinality keys or keys of the balance relation itself, so Spark's
partial (map-side) aggregation collapses hot keys before the shuffle.  Dimension joins
(parties, users) are plain equi-joins: AQE broadcasts them when runtime statistics show they
are small and falls back to a shuffle join otherwise.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import MONEY_SUM, money_eps
from ledgerloom.functions.ordering import sort_if
from ledgerloom.operators.balances import Filters, order_balances, order_filter, payment_filter
from ledgerloom.sources.schemas import ORDER_STATUSES


def _money_sums(df: DataFrame) -> list:
    return [F.count(F.lit(1)).alias("order_count"),
            F.sum("order_total").cast("decimal(30,7)").alias("total_amount"),
            F.sum("paid_amount").cast("decimal(30,7)").alias("paid_amount"),
            F.sum("remaining_amount").cast("decimal(30,7)").alias("remaining_amount")]


def executive_currency(t, f: Filters | None = None, balances: DataFrame | None = None) -> DataFrame:
    """A4: per-currency count, total, paid, remaining over filtered, non-cancelled orders."""
    b = order_filter(balances if balances is not None else order_balances(t), f)
    return b.groupBy("currency").agg(*_money_sums(b))


def financial_summary(t, balances: DataFrame | None = None) -> DataFrame:
    """A4 (dashboard form): no filters besides the cancellation exclusion."""
    return executive_currency(t, None, balances)


def executive_status(t, f: Filters | None = None, balances: DataFrame | None = None) -> DataFrame:
    """A5: order count per status over filtered orders."""
    b = order_filter(balances if balances is not None else t["export_orders"], f)
    return b.groupBy("status").agg(F.count(F.lit(1)).alias("order_count"))


def dashboard_status(t) -> DataFrame:
    """A5 (dashboard form): every order, cancelled included."""
    return t["export_orders"].groupBy("status").agg(F.count(F.lit(1)).alias("order_count"))


def month_key(col: str = "contract_date"):
    return F.date_format(F.col(col), "yyyy-MM").alias("month")


def monthly_sales(t, f: Filters | None = None, balances: DataFrame | None = None) -> DataFrame:
    """Σ order total per (yyyy-MM, currency)."""
    b = order_filter(balances if balances is not None else order_balances(t), f)
    return (b.groupBy(month_key(), F.col("currency"))
            .agg(F.sum("order_total").cast("decimal(30,7)").alias("total_amount")))


def months_back_start(as_of: date | str, months: int = 5):
    """First day of the month ``months`` before ``as_of``."""
    return F.trunc(F.add_months(F.lit(as_of).cast("date"), -months), "MM")


def monthly_exports(t, as_of: date | str, balances: DataFrame | None = None) -> DataFrame:
    """A6 from the first day of the month five months back; no upper bound."""
    b = balances if balances is not None else order_balances(t)
    b = b.filter((F.col("status") != "cancelled") & (F.col("contract_date") >= months_back_start(as_of)))
    return (b.groupBy(month_key(), F.col("currency"))
            .agg(F.sum("order_total").cast("decimal(30,7)").alias("total_amount")))


def order_stats(t) -> DataFrame:
    """Conditional counts over all orders (0, not NULL, on an empty table)."""
    s = F.col("status")
    return t["export_orders"].agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == "draft").alias("drafts"),
        F.count_if(s.isin("confirmed", "in_production", "ready_to_ship")).alias("active"),
        F.count_if(s == "ready_to_ship").alias("ready_to_ship"),
        F.count_if(s == "shipped").alias("shipped"),
        F.count_if(s == "completed").alias("completed"),
        F.count_if(s == "cancelled").alias("cancelled"))


def master_counts(t) -> DataFrame:
    """Active products, active clients, active users (three one-row aggregates side by side)."""
    one = F.lit(1).alias("_k")
    products = t["products"].agg(F.count_if(F.col("is_active")).alias("products")).select(one, "products")
    clients = t["parties"].agg(
        F.count_if(F.col("is_active") & (F.col("party_type") == "client")).alias("clients")).select(one, "clients")
    users = t["users"].agg(F.count_if(F.col("is_active")).alias("users")).select(one, "users")
    # three one-row aggregates side by side (equi-join on a constant key: 1 x 1 x 1 rows)
    return products.join(clients, "_k").join(users, "_k").drop("_k")


def _with_client_name(b: DataFrame, parties: DataFrame) -> DataFrame:
    p = parties.select(F.col("id").alias("_pid"), F.col("name").alias("client_name"))
    return b.join(p, b["client_id"] == p["_pid"], "inner").drop("_pid")


def top_clients(t, f: Filters | None = None, balances: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Top clients by total per currency (currencies are not converted); ties by key."""
    b = order_filter(balances if balances is not None else order_balances(t), f)
    agg = (b.groupBy("client_id", "currency")
           .agg(F.count(F.lit(1)).alias("order_count"),
                F.sum("order_total").cast("decimal(30,7)").alias("total_amount"),
                F.sum("remaining_amount").cast("decimal(30,7)").alias("remaining_amount")))
    named = _with_client_name(agg, t["parties"])
    return (named.orderBy(F.col("total_amount").desc(), F.col("client_id"), F.col("currency"))
            .limit(k)
            .select("client_id", "client_name", "currency", "order_count", "total_amount", "remaining_amount"))


def sales(t, f: Filters | None = None, balances: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """T4: every balance column plus client name, newest first."""
    b = order_filter(balances if balances is not None else order_balances(t), f)
    return sort_if(_with_client_name(b, t["parties"]), ordered, F.col("contract_date").desc(), F.col("id").desc())


AGING_BUCKETS = [(0, "Current"), (30, "1-30 days"), (60, "31-60 days"), (90, "61-90 days")]
# Ageing bucket labels, upper bounds inclusive; above the last bound: "Over 90 days".
OVER_90 = "Over 90 days"


def receivables(t, as_of: date | str, f: Filters | None = None,
                balances: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Open balances aged from valid_until (else contract date) to ``as_of``."""
    b = order_filter(balances if balances is not None else order_balances(t), f)
    b = _with_client_name(b, t["parties"]).filter(F.col("remaining_amount") > money_eps())
    days = F.datediff(F.lit(as_of).cast("date"), F.coalesce(F.col("valid_until"), F.col("contract_date")))
    bucket = F.when(days <= AGING_BUCKETS[0][0], AGING_BUCKETS[0][1])
    for bound, label in AGING_BUCKETS[1:]:
        bucket = bucket.when(days <= bound, label)
    out = (b.withColumn("days_outstanding", F.greatest(days, F.lit(0)))
           .withColumn("aging_bucket", bucket.otherwise(OVER_90)))
    return sort_if(out, ordered, F.col("days_outstanding").desc(), F.col("remaining_amount").desc(), F.col("id"))


def aging_summary(t, as_of: date | str, f: Filters | None = None) -> DataFrame:
    """Roll-up of R1 per bucket (test aid for the ageing edges)."""
    r = receivables(t, as_of, f)
    return r.groupBy("aging_bucket").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum("remaining_amount").cast("decimal(30,7)").alias("remaining_amount"))


def recent_orders(t, k: int = 6, balances: DataFrame | None = None) -> DataFrame:
    """Most recent orders, cancelled included."""
    b = balances if balances is not None else order_balances(t)
    b = _with_client_name(b, t["parties"])
    return (b.orderBy(F.col("contract_date").desc(), F.col("id").desc()).limit(k)
            .select("id", "invoice_number", "status", "contract_date", "currency", "order_total",
                    "paid_amount", "remaining_amount", "client_name"))


def _payments_enriched(t) -> DataFrame:
    """Payments with their order, client and recorder (three inner equi-joins)."""
    op = t["order_payments"]
    o = t["export_orders"].select(F.col("id").alias("order_id"), "invoice_number", "currency", "client_id",
                                  "status")
    u = t["users"].select(F.col("id").alias("_uid"), F.col("name").alias("recorded_by"))
    j = op.join(o, op["export_order_id"] == o["order_id"], "inner")
    return j.join(u, j["created_by"] == u["_uid"], "inner").drop("_uid")


def recent_payments(t, k: int = 5) -> DataFrame:
    """Most recent payments with order, client, recorder (cancelled orders included)."""
    j = _with_client_name(_payments_enriched(t), t["parties"])
    return (j.orderBy(F.col("payment_date").desc(), F.col("id").desc()).limit(k)
            .select("id", "payment_date", "amount", "reference_number", "order_id", "invoice_number",
                    "currency", "client_name", "recorded_by"))


def ledger_orders(t, client_id: int | None = None, balances: DataFrame | None = None) -> DataFrame:
    """T5 (orders): non-cancelled balances of a client (all clients when None), newest first."""
    b = balances if balances is not None else order_balances(t)
    b = b.filter(F.col("status") != "cancelled")
    if client_id is not None:
        b = b.filter(F.col("client_id") == F.lit(client_id))
    return sort_if(b, client_id is not None, F.col("contract_date").desc(), F.col("id").desc())


def ledger_payments(t, client_id: int | None = None) -> DataFrame:
    """T5 (payments): a client's payments newest first, without a status filter."""
    j = _payments_enriched(t)
    if client_id is not None:
        j = j.filter(F.col("client_id") == F.lit(client_id))
    out = j.select("id", "client_id", "order_id", "amount", "payment_date", "reference_number", "notes", "recorded_by")
    return sort_if(out, client_id is not None, F.col("payment_date").desc(), F.col("id").desc())


def client_ledger(t, balances: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Every active client with per-currency count/total/paid/remaining (NULL row when none)."""
    b = (balances if balances is not None else order_balances(t)).filter(F.col("status") != "cancelled")
    per = (b.groupBy("client_id", "currency")
           .agg(F.count(F.lit(1)).alias("order_count"),
                F.sum("order_total").cast("decimal(30,7)").alias("total_amount"),
                F.sum("paid_amount").cast("decimal(30,7)").alias("paid_amount"),
                F.sum("remaining_amount").cast("decimal(30,7)").alias("remaining_amount")))
    p = (t["parties"].filter((F.col("party_type") == "client") & F.col("is_active"))
         .select(F.col("id").alias("party_id"), F.col("name").alias("party_name"), "country"))
    out = p.join(per, p["party_id"] == per["client_id"], "left").drop("client_id")
    return sort_if(out, ordered, "party_name", "party_id", "currency")


def client_ledger_nested(t, balances: DataFrame | None = None) -> DataFrame:
    """Client -> balances[] (sorted by currency); clients without orders get []."""
    flat = client_ledger(t, balances)
    entry = F.when(F.col("currency").isNotNull() & (F.col("currency") != ""),
                   F.struct("currency", "order_count", "total_amount", "paid_amount", "remaining_amount"))
    # one row per (client, currency) -> the array per client is bounded by the currency domain
    return (flat.groupBy("party_id", "party_name", "country")
            .agg(F.array_sort(F.collect_list(entry)).alias("balances"))
            .withColumnRenamed("party_id", "id").withColumnRenamed("party_name", "name"))


def currencies(t) -> DataFrame:
    """Distinct non-empty currencies, sorted."""
    c = F.col("currency")
    return (t["export_orders"].select("currency").filter(c.isNotNull() & (c != "")).distinct()
            .orderBy("currency"))


def report_clients(t, ordered: bool = False) -> DataFrame:
    """A26 (clients): active clients by name."""
    return (t["parties"].filter((F.col("party_type") == "client") & F.col("is_active"))
            .select("id", "name").transform(lambda d: sort_if(d, ordered, "name", "id")))


def report_statuses(spark) -> DataFrame:
    """A26 (statuses): the fixed status domain."""
    return spark.createDataFrame([(s,) for s in ORDER_STATUSES], "status string")


def report_filters(t) -> dict[str, DataFrame]:
    """The three filter lists."""
    spark = t["export_orders"].sparkSession
    return {"clients": report_clients(t), "currencies": currencies(t), "statuses": report_statuses(spark)}


def payment_history(t, f: Filters | None = None, balances: DataFrame | None = None,
                    ordered: bool = False) -> DataFrame:
    """Calculated opening advances UNION ALL real receipts, filtered on payment date, newest first."""
    b = balances if balances is not None else order_balances(t)
    adv = (_with_client_name(b, t["parties"])
           .filter(F.col("opening_advance") > money_eps())
           .select(F.concat(F.lit("advance-"), F.col("id").cast("string")).alias("id"),
                   F.col("contract_date").alias("payment_date"), "client_id", "client_name",
                   F.col("id").alias("order_id"), "invoice_number", "status", "currency",
                   F.lit("opening_advance").alias("payment_type"),
                   F.col("opening_advance").cast(MONEY_SUM).alias("amount"),
                   F.concat(F.lit("Advance "), F.col("advance_percentage").cast("string"), F.lit("%"))
                   .alias("reference_number"),
                   F.lit("Calculated from export order").alias("notes"),
                   F.lit("Export order").alias("recorded_by")))
    pay = (_with_client_name(_payments_enriched(t), t["parties"])
           .select(F.concat(F.lit("payment-"), F.col("id").cast("string")).alias("id"),
                   "payment_date", "client_id", "client_name", "order_id", "invoice_number", "status",
                   "currency", F.lit("later_receipt").alias("payment_type"),
                   F.col("amount").cast(MONEY_SUM).alias("amount"), "reference_number",
                   "notes", "recorded_by"))
    hist = adv.unionByName(pay)
    return sort_if(payment_filter(hist, f), ordered, F.col("payment_date").desc(), F.col("id").desc())

