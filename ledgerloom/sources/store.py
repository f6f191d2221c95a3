"""Tables stored in the shared folder: written in place by copy-on-write, laid out for joins and lookups.

* ``create`` stores a table in partitions by range of its key (``RANGE_BITS`` neighbouring ids).  A write
  (S5-S9) reads only the ranges that its keys fall into, stages their new content, and overwrites just these
  partitions; files of other ranges are neither read nor touched.  The staged content is a written table of its
  own, so a write that was interrupted while it replaced partitions is repeated from there (``publish``) with
  the same result.  One writer at a time.
* ``append_audit`` (S12) writes a batch into partitions of (day, batch): a replayed batch overwrites itself.
* ``bucketed`` (S1) stores tables hashed by a common key into the same number of sorted buckets, so that joins
  and aggregations on that key need no exchange.
* ``create_lookup`` (S2) stores a table sorted by its key with statistics and Bloom filters, so that a lookup
  reads the few row groups that can hold it.

Defined cases: rows with a NULL key live in a range of their own; a range that loses its last row keeps a
marker that reads never return; an empty batch changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.running import id_block
from ledgerloom.session import scratch_path
from ledgerloom.sources import sinks

RANGE = "key_range"
RANGE_BITS = 20
_NO_KEY = -(1 << 62)
BUCKETS = 16
LOOKUP_ROWS = 100_000


def _range(key: str, bits: int) -> Column:
    return F.coalesce(id_block(key, bits), F.lit(_NO_KEY)).cast("bigint")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn(RANGE, F.col(RANGE).cast("bigint"))


def create(df: DataFrame, path: str, key: str = "id", bits: int = RANGE_BITS) -> None:
    """Store a new table."""
    df.withColumn(RANGE, _range(key, bits)).repartition(RANGE).write.partitionBy(RANGE).parquet(path)


def read(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """The table's rows."""
    return _stored(spark, path).filter(F.col(key).isNotNull() | (F.col(RANGE) == _NO_KEY)).drop(RANGE)


def rewrite(spark: SparkSession, path: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame], key: str = "id", bits: int = RANGE_BITS) -> None:
    """Replace the ranges that the keys of ``touched`` fall into by ``change`` of their rows.

    ``change`` may only add rows whose keys are in ``touched``.  The touched range numbers come to the driver:
    at most one per partition of the table and of the batch."""
    ranges = touched.select(_range(key, bits).alias(RANGE)).distinct()
    numbers = sorted(r[0] for r in ranges.collect())
    if not numbers:
        return
    old = _stored(spark, path).filter(F.col(RANGE).isin(numbers)).filter(F.col(key).isNotNull() | (F.col(RANGE) == _NO_KEY)).drop(RANGE)
    new = change(old).select(*old.columns).withColumn(RANGE, _range(key, bits))
    staged = scratch_path(spark, f"staged-{uuid.uuid4().hex}")
    new.write.parquet(staged)
    rows = spark.read.parquet(staged)
    found = {r[0] for r in rows.select(RANGE).distinct().collect()}
    if found - set(numbers):
        raise ValueError(f"rows outside the touched ranges: {sorted(found - set(numbers))[:5]}")
    empty = [n for n in numbers if n not in found and n != _NO_KEY]
    if empty:
        marks = spark.createDataFrame([(n,) for n in empty], f"{RANGE} bigint")
        rows.limit(0).unionByName(marks, allowMissingColumns=True).write.mode("append").parquet(staged)
    publish(spark, path, staged)


def publish(spark: SparkSession, path: str, staged: str) -> None:
    """Overwrite the partitions of the staged content, and no others."""
    (spark.read.parquet(staged).repartition(RANGE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(path))


def append_rows(spark: SparkSession, path: str, rows: DataFrame, key: str = "id", bits: int = RANGE_BITS) -> None:
    """S5."""
    rewrite(spark, path, rows, lambda old: sinks.append(old, rows), key, bits)


def upsert_rows(spark: SparkSession, path: str, rows: DataFrame, update_cols: Sequence[str], key: str = "id", bits: int = RANGE_BITS,
                order: Sequence[str] | None = None) -> None:
    """S6."""
    rewrite(spark, path, rows, lambda old: sinks.upsert(old, rows, [key], update_cols, order), key, bits)


def insert_absent_rows(spark: SparkSession, path: str, rows: DataFrame, key: str = "id", bits: int = RANGE_BITS, order: Sequence[str] | None = None) -> None:
    """S7."""
    rewrite(spark, path, rows, lambda old: sinks.insert_absent(old, rows, [key], order), key, bits)


def update_rows(spark: SparkSession, path: str, patch: DataFrame, cols: Sequence[str], key: str = "id", bits: int = RANGE_BITS, where: Column | None = None,
                order: Sequence[str] | None = None) -> None:
    """S8."""
    rewrite(spark, path, patch, lambda old: sinks.update_by_key(old, patch, [key], cols, where, order)[0], key, bits)


def soft_delete_rows(spark: SparkSession, path: str, ids: DataFrame, key: str = "id", bits: int = RANGE_BITS) -> None:
    """S9."""
    rewrite(spark, path, ids, lambda old: sinks.soft_delete(old, ids, key), key, bits)


def delete_rows(spark: SparkSession, path: str, ids: DataFrame, key: str = "id", bits: int = RANGE_BITS) -> None:
    """Rows with the given keys go (one step of S10)."""
    rewrite(spark, path, ids, lambda old: old.join(ids.select(key), key, "left_anti"), key, bits)


def append_audit(events: DataFrame, path: str, batch_id: int | str, ts_col: str = "created_at") -> None:
    """The batch's events in partitions of event day and batch; the same batch again replaces itself."""
    (events.withColumns({"event_date": F.to_date(F.col(ts_col)), "batch_id": F.lit(str(batch_id))})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch_id").parquet(path))


def read_audit(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Audit rows of the days from ``first_day`` to ``last_day``; other days' folders are not read."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(path)
    if first_day is not None:
        rows = rows.filter(F.col("event_date") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        rows = rows.filter(F.col("event_date") <= F.lit(last_day).cast("date"))
    return rows.withColumn("batch_id", F.col("batch_id").cast("string"))


def bucketed(tables: Mapping[str, DataFrame], keys: Mapping[str, str], buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """The named tables stored in the shared folder, each in ``buckets`` sorted buckets of its key.

    The tables are registered in the session's catalog under fresh names."""
    out = {}
    for name, key in keys.items():
        spark = tables[name].sparkSession
        stored_name = f"bucketed_{name}_{uuid.uuid4().hex}"
        (tables[name].repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
         .option("path", scratch_path(spark, stored_name)).saveAsTable(stored_name))
        out[name] = spark.table(stored_name)
    return out


def create_lookup(df: DataFrame, path: str, key: str = "id", rows: int = LOOKUP_ROWS) -> None:
    """Store a table for lookups: ranges of the key in files of at most ``rows`` rows, with Bloom filters."""
    (df.orderBy(key).write.option("maxRecordsPerFile", rows).option("parquet.bloom.filter.enabled", "true")
     .option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.page.row.count.limit", "1000").parquet(path))
