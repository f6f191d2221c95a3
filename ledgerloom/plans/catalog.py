"""Query catalogue: every registered query as (Spark builder, DuckDB oracle SQL or None).

Each builder takes (spark, sf_dir), derives the domain tables from the parquet files and returns
the result DataFrame with decimals converted to exact doubles.  Parameters that the ledger takes
from the request or the clock are fixed here so runs are reproducible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.money import to_output
from ledgerloom.plans.oracle import BAL, NBAL, D, with_ctes
from ledgerloom.sources.tables import Tables, from_testdata
from ledgerloom.sources.testdata import Keep

# Fixed parameters of the registered queries.
AS_OF = "2001-08-15"

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


#: Derived tables that a job over whole shipments and contracts needs several times: written once for the job.
LINES = ("export_order_items", "allocation_source")

#: The same for jobs over all shipment requests, which are read as headers, containers and allocations.
REQUESTS = (*LINES, "shipment_requests", "request_containers")

#: The same for jobs that join whole contract items with their contracts: the items are numbered by contract and stay so.
DEALT_LINES = {"export_order_items": "export_order_id", "allocation_source": None}


def register(name: str, sql: str | None = None, keep: Keep = ()):
    def deco(fn: Callable[[Tables], DataFrame]) -> Builder:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return to_output(fn(from_testdata(spark, sf_dir, keep)))
        build.__name__ = name
        build.__doc__ = fn.__doc__
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build
    return deco


def _load_modules() -> None:
    # Importing the modules registers their queries.
    from ledgerloom.plans import q_reports  # noqa: F401
    from ledgerloom.plans import q_fulfilment  # noqa: F401
    from ledgerloom.plans import q_access  # noqa: F401
    from ledgerloom.plans import q_jobs  # noqa: F401
    from ledgerloom.plans import q_validation  # noqa: F401
    from ledgerloom.plans import q_parts  # noqa: F401
    from ledgerloom.plans import q_ingest  # noqa: F401
    from ledgerloom.plans import q_changes  # noqa: F401
    from ledgerloom.plans import q_store  # noqa: F401
    from ledgerloom.plans import q_ordered  # noqa: F401


def queries() -> dict[str, Builder]:
    _load_modules()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_modules()
    return dict(ORACLE)


__all__ = ["AS_OF", "LINES", "REQUESTS", "DEALT_LINES", "BAL", "NBAL", "D", "ORACLE", "QUERIES", "register", "with_ctes", "queries", "oracle_sql"]
