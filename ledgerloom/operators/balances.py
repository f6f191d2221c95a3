"""Order-balance algebra (A1-A3) and report filters.

Every financial report derives from ``order_balances``.  Items and payments are aggregated per
order *before* they meet the order header (partial aggregation map-side, one row per order after
the shuffle), so the joins are 1:1 on the order id and a hot order cannot fan out.  Both joins use
the same key, so the second one reuses the first one's hash partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import MONEY_SUM, TOTAL, money_eps, percent_of

HEADER = ["id", "client_id", "invoice_number", "contract_date", "valid_until", "status", "currency",
          "advance_percentage", "port_of_destination", "final_destination"]


def line_value() -> Column:
    """Client value of a line: quantity x price when the line is flagged non-sample, else 0."""
    return F.when(F.col("is_sample") == F.lit(False),
                  F.col("quantity") * F.col("client_price_per_carton")).otherwise(F.lit(0))


def item_totals(items: DataFrame) -> DataFrame:
    """Σ non-sample quantity x price per order (pre-aggregated; partial agg before the shuffle)."""
    return items.groupBy("export_order_id").agg(F.sum(line_value()).cast(TOTAL).alias("items_total"))


def order_totals(t, header: list[str] | None = None) -> DataFrame:
    """A1: every order with its total; an order without items totals 0."""
    cols = header or HEADER
    orders = t["export_orders"].select(*cols)
    totals = item_totals(t["export_order_items"])
    return (orders.join(totals, orders["id"] == totals["export_order_id"], "left")
            .select(*[orders[c] for c in cols],
                    F.coalesce(totals["items_total"], F.lit(0).cast(TOTAL)).cast(TOTAL).alias("order_total")))


def payment_totals(payments: DataFrame) -> DataFrame:
    """A2: Σ received amount per order."""
    return payments.groupBy("export_order_id").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY_SUM).alias("additional_received"))


def with_balances(totals: DataFrame, received: DataFrame | None) -> DataFrame:
    """A3 on top of A1: opening advance, received, clamped paid and remaining."""
    if received is None:
        df = totals.withColumn("additional_received", F.lit(0).cast(MONEY_SUM))
    else:
        df = (totals.join(received, totals["id"] == received["export_order_id"], "left")
              .drop(received["export_order_id"])
              .withColumn("additional_received",
                          F.coalesce(F.col("additional_received"), F.lit(0).cast(MONEY_SUM))))
    adv = percent_of(F.col("order_total"), F.col("advance_percentage"))
    df = df.withColumn("opening_advance", adv)
    unpaid = F.col("order_total") - F.col("opening_advance") - F.col("additional_received")
    return (df.withColumn("paid_amount",
                          F.least(F.col("order_total"),
                                  F.col("opening_advance") + F.col("additional_received")).cast(TOTAL))
            .withColumn("remaining_amount", F.greatest(unpaid, F.lit(0)).cast(TOTAL)))


def order_balances(t, header: list[str] | None = None) -> DataFrame:
    """A3: the balance relation every report reads."""
    return with_balances(order_totals(t, header), payment_totals(t["order_payments"]))


@dataclass(frozen=True)
class Filters:
    """Optional report filters; blank strings count as absent."""

    date_from: str | date | None = None
    date_to: str | date | None = None
    client_id: int | None = None
    status: str | None = None
    currency: str | None = None

    def present(self, name: str):
        value = getattr(self, name)
        if value is None or (isinstance(value, str) and not value.strip()):
            return None
        return value.strip() if isinstance(value, str) and name == "currency" else value


def _filter(df: DataFrame, f: Filters | None, date_col: str) -> DataFrame:
    f = f or Filters()
    cond = F.col("status") != F.lit("cancelled")
    if f.present("date_from") is not None:
        cond = cond & (F.col(date_col) >= F.lit(f.present("date_from")).cast("date"))
    if f.present("date_to") is not None:
        cond = cond & (F.col(date_col) <= F.lit(f.present("date_to")).cast("date"))
    if f.present("client_id") is not None:
        cond = cond & (F.col("client_id") == F.lit(int(f.present("client_id"))))
    if f.present("status") is not None:
        cond = cond & (F.col("status") == F.lit(f.present("status")))
    if f.present("currency") is not None:
        cond = cond & (F.col("currency") == F.lit(f.present("currency")))
    return df.filter(cond)


def order_filter(df: DataFrame, f: Filters | None = None) -> DataFrame:
    """Filters on contract_date / client / status / currency; cancelled always excluded."""
    return _filter(df, f, "contract_date")


def payment_filter(df: DataFrame, f: Filters | None = None) -> DataFrame:
    """The same filters on payment_date."""
    return _filter(df, f, "payment_date")


def remaining_open(df: DataFrame, column: str = "remaining_amount") -> DataFrame:
    """Money threshold (remaining > 0.004)."""
    return df.filter(F.col(column) > money_eps())
