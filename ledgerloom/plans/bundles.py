"""Report bundles (R2, R3, R4): several result sets over ONE shared balance relation.

The balance relation is persisted (memory, spilling to disk) only while a bundle is in use, so the
four executive aggregates or the seven dashboard sets do not recompute the order totals; call
``release(bundle)`` when done.  Cached blocks lost with an executor are recomputed from lineage.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import reports as R
from ledgerloom.operators import statement as S
from ledgerloom.operators.balances import Filters, order_balances, order_filter

_SHARED = "_shared"


def executive(t, f: Filters | None = None, keep: bool = True) -> dict[str, DataFrame]:
    """R2: currency summary, status summary, monthly sales, top clients — one balance computation.

    ``keep`` holds the balances until ``release``; without it every part derives them."""
    shared = order_filter(order_balances(t), f)
    if keep:
        shared = shared.persist(StorageLevel.MEMORY_AND_DISK)
    return {
        "currencySummary": R.executive_currency(t, None, shared),
        "statusSummary": R.executive_status(t, None, shared),
        "monthlySales": R.monthly_sales(t, None, shared),
        "topClients": R.top_clients(t, None, shared),
        _SHARED: shared,
    }


def dashboard(t, as_of, keep: bool = True) -> dict[str, object]:
    """Stats, financial summary, status summary, monthly exports, recent orders and payments."""
    shared = order_balances(t)
    if keep:
        shared = shared.persist(StorageLevel.MEMORY_AND_DISK)
    one = F.lit(1).alias("_k")
    counters = (R.order_stats(t).select(one, "*").join(R.master_counts(t).select(one, "*"), "_k")
                .drop("_k"))  # two one-row aggregates side by side
    return {
        "stats": counters,
        "financialSummary": R.financial_summary(t, shared),
        "statusSummary": R.dashboard_status(t),
        "monthlyExports": R.monthly_exports(t, as_of, shared),
        "recentOrders": R.recent_orders(t, balances=shared),
        "recentPayments": R.recent_payments(t),
        "generatedAt": datetime.now(timezone.utc).isoformat(),
        _SHARED: shared,
    }


def client_statement(t, client_id: int) -> dict[str, DataFrame]:
    """Party, summary and transactions for one client."""
    return S.statement_bundle(t, client_id)


def release(bundle: dict) -> None:
    """Drop the bundle's shared cached relation."""
    shared = bundle.get(_SHARED)
    if shared is not None:
        shared.unpersist()
