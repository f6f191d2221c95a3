"""ledgerloom — trade-ledger analytics and data jobs on Spark DataFrames.

Sub-packages:
    sources    table schemas, test-data adapter, loaders and write-side sinks
    functions  column-expression helpers (exact money, text, dates, JSON)
    operators  relational building blocks (balances, reports, fulfilment, ...)
    plans      composite bundles, ingest jobs and the query catalogue
    streaming  micro-batch form of the payment admission job
"""

from ledgerloom.session import get_spark, checkpoint_dir  # noqa: F401
