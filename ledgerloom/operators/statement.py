"""Client statement.

Transactions = orders (debit) + opening advances above 0.004 (credit) + receipts (credit).  The
running balance per (client, currency) follows (date, kind, id-as-text); it is computed for every
client at once with the skew-safe running sum, so a client with a third of all transactions is
still spread over many tasks.  Closing balances are an order-independent aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import money_eps
from ledgerloom.operators.balances import order_balances
from ledgerloom.operators.running import running_sum

#: Characters of a transaction id that cut a hot day: its kind ("payment-") and the first four digits.
ID_PREFIX = 12

AMOUNT = "decimal(24,7)"
BALANCE = "decimal(30,7)"


def percent_text(pct: Column) -> Column:
    """A percentage printed like a JS number: 30.00 -> '30', 33.30 -> '33.3'."""
    return F.regexp_replace(F.regexp_replace(pct.cast("string"), "0+$", ""), "\\.$", "")


def statement_transactions(t, balances: DataFrame | None = None) -> DataFrame:
    """The three transaction kinds as one relation (no ordering yet).

    Order and advance rows come from one pass over the balances (an array of two rows per order,
    exploded), so the balance relation is computed once."""
    b = (balances if balances is not None else order_balances(t)).filter(F.col("status") != "cancelled")
    pct = percent_text(F.col("advance_percentage"))
    oid = F.col("id").cast("string")
    null_s = F.lit(None).cast("string")
    order_row = F.struct(F.concat(F.lit("order-"), oid).alias("id"), F.lit(1).alias("sort_order"),
                         F.lit("order").alias("type"), F.lit("Export order").alias("description"),
                         null_s.alias("reference_number"),
                         F.col("order_total").cast(AMOUNT).alias("debit"), F.lit(0).cast(AMOUNT).alias("credit"))
    advance_row = F.when(F.col("opening_advance") > money_eps(), F.struct(
        F.concat(F.lit("advance-"), oid).alias("id"), F.lit(2).alias("sort_order"),
        F.lit("opening_advance").alias("type"),
        F.concat(F.lit("Opening advance "), pct, F.lit("%")).alias("description"),
        F.concat(F.lit("Advance "), pct, F.lit("%")).alias("reference_number"),
        F.lit(0).cast(AMOUNT).alias("debit"), F.col("opening_advance").cast(AMOUNT).alias("credit")))
    rows = (b.select(F.col("contract_date").alias("date"), "client_id", F.col("id").alias("order_id"),
                     "invoice_number", "currency",
                     F.explode(F.array(order_row, advance_row)).alias("r"))
            .filter(F.col("r").isNotNull())  # advances at or below 0.004 are NULL entries
            .select(F.col("r.id").alias("id"), "date", F.col("r.sort_order").alias("sort_order"), "client_id",
                    "order_id", "invoice_number", "currency", F.col("r.type").alias("type"),
                    F.col("r.description").alias("description"), F.col("r.reference_number").alias("reference_number"),
                    null_s.alias("notes"), null_s.alias("recorded_by"), F.col("r.debit").alias("debit"), F.col("r.credit").alias("credit")))
    o = (t["export_orders"].filter(F.col("status") != "cancelled")
         .select(F.col("id").alias("_oid"), F.col("client_id"), "invoice_number", "currency"))
    u = t["users"].select(F.col("id").alias("_uid"), F.col("name").alias("recorded_by"))
    op = t["order_payments"]
    pays = (op.join(o, op["export_order_id"] == o["_oid"], "inner")
            .join(u, op["created_by"] == u["_uid"], "inner")
            .select(F.concat(F.lit("payment-"), op["id"].cast("string")).alias("id"),
                    F.col("payment_date").alias("date"), F.lit(3).alias("sort_order"), F.col("client_id"),
                    F.col("export_order_id").alias("order_id"), "invoice_number", "currency",
                    F.lit("payment").alias("type"), F.lit("Received payment").alias("description"),
                    "reference_number", "notes", "recorded_by",
                    F.lit(0).cast(AMOUNT).alias("debit"), F.col("amount").cast(AMOUNT).alias("credit")))
    return rows.unionByName(pays)


def client_statement(t, client_id: int | None = None, balances: DataFrame | None = None) -> DataFrame:
    """W1 + T6: transactions with the running balance per currency (all clients when None)."""
    tx = statement_transactions(t, balances)
    if client_id is not None:
        tx = tx.filter(F.col("client_id") == F.lit(client_id))
    tx = tx.withColumn("_delta", F.col("debit") - F.col("credit"))
    # chunks = (date, kind, leading part of the id): a hot client is cut into its days, a hot day into
    # runs of neighbouring ids
    out = running_sum(tx, ["client_id", "currency"], ["date", "sort_order", "id"], "_delta",
                      "running_balance", chunk=["date", "sort_order", F.left("id", F.lit(ID_PREFIX))], result_type=BALANCE)
    out = out.drop("_delta")
    # one client's statement is returned in statement order; the all-clients form stays unsorted
    # (a global sort of every transaction would be a full range shuffle for no consumer)
    return out.orderBy("date", "sort_order", "id") if client_id is not None else out


def statement_summary(t, client_id: int | None = None, balances: DataFrame | None = None) -> DataFrame:
    """Closing balance per (client, currency)."""
    tx = statement_transactions(t, balances)
    if client_id is not None:
        tx = tx.filter(F.col("client_id") == F.lit(client_id))
    return tx.groupBy("client_id", "currency").agg(
        F.sum(F.col("debit") - F.col("credit")).cast(BALANCE).alias("closing_balance"))


def statement_party(t, client_id: int) -> DataFrame:
    """R4 header: the party, which must be a client (inactive allowed); empty means not found."""
    p = t["parties"]
    return (p.filter((F.col("id") == F.lit(client_id)) & (F.col("party_type") == "client"))
            .select("id", "name", "contact_person", "phone", "email", "country"))


def statement_bundle(t, client_id: int) -> dict[str, DataFrame]:
    """Party, summary, transactions for one client."""
    b = order_balances(t)
    return {"party": statement_party(t, client_id),
            "summary": statement_summary(t, client_id, b),
            "transactions": client_statement(t, client_id, b)}
