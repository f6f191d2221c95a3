"""Spark session helpers.

The cluster names a shared checkpoint folder in ``spark.checkpoint.dir``; jobs read it from the
session.  Only when it is unset (local tests) do we fall back to a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              driver_memory: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("ledgerloom")
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the session's setting; in local mode a scratch folder when unset (tests)."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss; never localCheckpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A written step reads its shuffles once: they go when it is written, not when the driver next collects garbage.
STEP_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def kept(df: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """The rows of a step, written once to the shared folder as Parquet: whole tables take several times as much
    in a checkpoint, which holds rows uncompressed.  Rows that Parquet cannot hold (repeated or no columns,
    columns without a type) are checkpointed.  ``settings`` of the session hold while the step is written."""
    names = [c.lower() for c in df.columns]
    if not names or len(set(names)) < len(names) or any("void" in kind for _, kind in df.dtypes):
        return cut_lineage(df)
    return stored(df, "step", STEP_SETTINGS | (settings or {}))


def stored(df: DataFrame, name: str, settings: dict[str, str] | None = None, by: str | None = None) -> DataFrame:
    """The rows as a written table of the shared folder.

    ``by`` names a column by which the rows lie already (the key of the window or join that made them): they are
    written in as many buckets of it as a shuffle has partitions, so that joins on it need not deal them again."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = scratch_path(spark, table)
    with _set(spark, settings or {}):
        if by is None:
            df.write.parquet(path)
        else:
            df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(table, format="parquet")
    if by is not None:
        return spark.table(table)
    rows = spark.read.schema(df.schema).parquet(path)
    rows._written = path
    return rows


def release(*steps: DataFrame) -> None:
    """Delete the files of kept steps that nothing reads any more: whatever was made of them is written itself."""
    for step in steps:
        path = getattr(step, "_written", None)
        if path is not None:
            jvm = step.sparkSession.sparkContext._jvm
            hpath = jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(step.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of one action."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate written table, under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), so that Python tasks can import it
    on workers that do not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_ledgerloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = checkpoint_dir(spark)  # a mounted shared folder if there is one; Spark serves the file either way
    folder = "/" + base[len("file:"):].lstrip("/") if base.startswith("file:") else base
    if "://" in folder:
        folder = tempfile.gettempdir()
    target = os.path.join(folder, f"package-{uuid.uuid4().hex}", "ledgerloom.zip")
    os.makedirs(os.path.dirname(target))
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(target)
    context._ledgerloom_shipped = True
