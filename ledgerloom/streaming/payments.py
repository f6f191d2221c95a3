"""Payment requests as a stream (the ledger's record-a-payment entry point, micro-batched).

Each micro-batch is admitted with the batch job (G2) against the payments table as committed so
far, so later requests see the money accepted earlier — the order the ledger enforces with row
locks.  Accepted rows are appended to the payments table; every outcome is written to an outcome
table partitioned by batch id (overwritten per batch), which makes a replayed batch idempotent.
Progress and source offsets live in the query checkpoint in the shared folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.admission import admit_payments
from ledgerloom.session import checkpoint_dir, path_exists
from ledgerloom.sources.sinks import one_per_key

REQUEST_SCHEMA = "request_id bigint, order_id bigint, amount decimal(14,2), payment_date date, " \
                 "reference_number string, created_by bigint"


def admit_batch(spark: SparkSession, tables, payments_path: str, outcomes_path: str,
                batch: DataFrame, batch_id: int) -> None:
    """foreachBatch body: admit one micro-batch and commit its effects.

    Accepted payments and outcomes are written into the partition of this batch id with dynamic
    overwrite, and admission only reads payments of earlier batches — a replayed batch therefore
    rewrites exactly its own partitions with the same result.  A request's id becomes the payment's id: one
    that the table has already is refused (``duplicate_request``), and one that a batch delivers twice counts
    once."""
    t = dict(tables)
    if path_exists(spark, payments_path):
        committed = (spark.read.parquet(payments_path).filter(F.col("batch_id") < batch_id).drop("batch_id"))
        t["order_payments"] = t["order_payments"].unionByName(committed, allowMissingColumns=True)
    known = t["order_payments"].select(F.col("id").alias("_known")).distinct()
    repeated = batch.join(known, batch["request_id"] == known["_known"], "left_semi")
    fresh = one_per_key(batch.join(known, batch["request_id"] == known["_known"], "left_anti"), ["request_id"])
    admitted = admit_payments(t, fresh)
    none = F.lit(None).cast(dict(admitted.dtypes)["remaining_before"])
    out = admitted.unionByName(repeated.select("request_id", "order_id", "amount", F.lit("duplicate_request").alias("outcome"),
                                               none.alias("remaining_before"), none.alias("remaining_after")))
    out = out.withColumn("batch_id", F.lit(batch_id))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(outcomes_path))
    written = spark.read.parquet(outcomes_path).filter(F.col("batch_id") == batch_id)
    new = (written.filter(F.col("outcome") == "accepted").select("request_id")
           .join(fresh, "request_id")
           .select(F.col("request_id").alias("id"), F.col("order_id").alias("export_order_id"), "amount",
                   "payment_date", "reference_number", "created_by", F.lit(batch_id).alias("batch_id")))
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(payments_path))


def start_payment_stream(spark: SparkSession, tables, requests_path: str, payments_path: str,
                         outcomes_path: str, checkpoint: str | None = None,
                         available_now: bool = False) -> StreamingQuery:
    """Start the stream: parquet request files in ``requests_path`` -> admission -> tables."""
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), "streams", "payments")
    reader = spark.readStream.schema(REQUEST_SCHEMA).parquet(requests_path)
    writer = (reader.writeStream
              .foreachBatch(lambda df, bid: admit_batch(spark, tables, payments_path, outcomes_path, df, bid))
              .option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
