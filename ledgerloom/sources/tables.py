"""Table bundle, loaders and scan helpers."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import path_exists
from ledgerloom.sources import schemas
from ledgerloom.sources.testdata import Keep, build_views


class Tables(dict):
    """Name -> DataFrame bundle; attribute access for readability (``t.export_orders``).

    An optional ``source`` mapping supplies tables on first access (lazy test-data views)."""

    def __init__(self, *args, source=None, **kwargs):
        super().__init__(*args, **kwargs)
        self._source = source

    def __missing__(self, name: str) -> DataFrame:
        if self._source is None:
            raise KeyError(name)
        df = self._source[name]
        self[name] = df
        return df

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self[name]
        except KeyError as exc:  # pragma: no cover - programming error
            raise AttributeError(name) from exc

    def replace(self, **frames: DataFrame) -> "Tables":
        out = Tables(self, source=self._source)
        out.update(frames)
        return out


_VIEW_CACHE: dict[tuple[int, str], object] = {}


DOMAIN_MARKER = "_DOMAIN_TABLES"


class StoredViews(dict):
    """Domain tables stored as one parquet folder each (written by ``materialize_domain``)."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self._spark, self._path = spark, path

    def __missing__(self, name: str) -> DataFrame:
        df = self._spark.read.parquet(os.path.join(self._path, name))
        self[name] = df
        return df


def from_testdata(spark: SparkSession, sf_dir: str, keep: Keep = ()) -> Tables:
    """Domain tables for a data folder: stored domain tables when the folder holds them, else derived
    from the driver's raw parquet files (lazy plans, shared per session).

    Derived tables named in ``keep`` are written once for this bundle, which then is not shared: a later job
    reads the raw files as they are then."""
    if keep and not path_exists(spark, os.path.join(sf_dir, DOMAIN_MARKER)):
        return Tables(source=build_views(spark, sf_dir, keep))
    key = (id(spark), sf_dir.rstrip("/"))  # views hold the session, so the id stays unique
    views = _VIEW_CACHE.get(key)
    if views is None:
        if path_exists(spark, os.path.join(sf_dir, DOMAIN_MARKER)):
            views = StoredViews(spark, sf_dir)
        else:
            views = build_views(spark, sf_dir)
        _VIEW_CACHE[key] = views
    return Tables(source=views)


def materialize_domain(spark: SparkSession, sf_dir: str, out_dir: str) -> str:
    """Write every domain view derived from ``sf_dir`` to ``out_dir`` (one parquet folder each)."""
    from ledgerloom.sources.testdata import VIEWS
    views = build_views(spark, sf_dir)
    names = [n for n, _ in VIEWS] + ["permissions", "roles", "role_permissions"]
    for name in names:
        views[name].write.mode("overwrite").parquet(os.path.join(out_dir, name))
    spark.createDataFrame([(sf_dir,)], "source string").write.mode("overwrite") \
        .parquet(os.path.join(out_dir, DOMAIN_MARKER))
    return out_dir


def load_tables(spark: SparkSession, path: str, names: Iterable[str] | None = None,
                optional: Iterable[str] = ()) -> Tables:
    """One parquet folder per domain table, read with its declared schema and conformed (S3).

    An absent folder raises, unless the table is named in ``optional``."""
    out, spare = Tables(), set(optional)
    for name in names or schemas.SCHEMAS:
        target = os.path.join(path, name)
        if not path_exists(spark, target):
            if name in spare:
                continue
            raise FileNotFoundError(f"no folder for table {name}: {target}")
        df = spark.read.parquet(target)
        out[name] = conform(df, schemas.SCHEMAS[name]) if name in schemas.SCHEMAS else df
    return out


def load_jdbc_table(spark: SparkSession, url: str, table: str, name: str, partition_column: str | None = None,
                    lower: int | None = None, upper: int | None = None, partitions: int = 64,
                    properties: Mapping[str, str] | None = None) -> DataFrame:
    """S1 (optional source): one ledger table from a relational database, read in parallel ranges of
    a numeric key when given, and conformed to the declared schema."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", partitions))
    df = reader.load()
    return conform(df, schemas.SCHEMAS[name]) if name in schemas.SCHEMAS else df


def conform(df: DataFrame, schema: T.StructType, drop: Iterable[str] = ()) -> DataFrame:
    """S3: project onto a target schema; missing columns become typed NULLs.

    Columns that the schema does not declare raise, unless they are named in ``drop``."""
    present = {c.lower(): c for c in df.columns}
    extra = set(present) - {f.name.lower() for f in schema.fields} - {c.lower() for c in drop}
    if extra:
        raise ValueError(f"columns outside the schema: {sorted(extra)}")
    cols = []
    for field in schema.fields:
        src = present.get(field.name.lower())
        if src is None:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.col(src).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def load_versions(spark: SparkSession, path: str, schema: T.StructType, renames: Mapping[int, Mapping[str, str]] | None = None,
                  domains: Mapping[int, Mapping[str, Iterable[str]]] | None = None) -> DataFrame:
    """S1 + S3: a table whose folders ``version=N`` were written under different schema versions, as one table.

    Each version is read with the schema of its own files, its old column names are mapped (``renames``: version
    -> old name -> name) and its rows conformed to ``schema`` (missing columns NULL, other types cast).  Adds
    ``version`` and ``outside_domain``: the columns whose value the version's enum ``domains`` do not know."""
    parts = []
    for version in sorted(_versions(spark, path)):
        df = spark.read.option("mergeSchema", "true").parquet(os.path.join(path, f"version={version}"))
        df = df.withColumnsRenamed(dict((renames or {}).get(version, {})))
        known = (domains or {}).get(version, {})
        unknown = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(list(values)), F.lit(c)) for c, values in known.items()]
        outside = F.concat_ws(",", *unknown) if unknown else F.lit("")
        parts.append(conform(df, schema).withColumns({"version": F.lit(version), "outside_domain": outside}))
    if not parts:
        raise FileNotFoundError(f"no version folders in {path}")
    return reduce(lambda a, b: a.unionByName(b), parts)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ``version=N`` folders (listed through the path's file system)."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hpath)
    names = [s.getPath().getName() for s in listed]
    return [int(n.split("=", 1)[1]) for n in names if n.startswith("version=")]


def enum_violations(df: DataFrame, column: str, domain: Iterable[str]) -> DataFrame:
    """S3 (enum side): rows whose value lies outside an (extended) enum domain."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(domain)))


def by_id(df: DataFrame, id_value, key: str = "id") -> DataFrame:
    """Point lookup (pushes down to the parquet scan as an equality filter)."""
    return df.filter(F.col(key) == F.lit(id_value))


def active(df: DataFrame, order_col: str = "name", party_type: str | None = None,
           key: str = "id") -> DataFrame:
    """Active rows sorted by name; optional party type from the closed list (unknown -> empty)."""
    out = df.filter(F.col("is_active"))
    if party_type is not None:
        if party_type not in schemas.PARTY_TYPES:
            return out.limit(0)
        out = out.filter(F.col("party_type") == party_type)
    return out.orderBy(F.col(order_col), F.col(key))


def party_role(parties: DataFrame, prefix: str, cols: Mapping[str, str]) -> DataFrame:
    """The parties dimension in one role, columns renamed with a prefix."""
    return parties.select(F.col("id").alias(f"{prefix}_id"),
                          *[F.col(src).alias(dst) for src, dst in cols.items()])


def has_columns(df: DataFrame, names: Iterable[str]) -> bool:
    return all(n in df.columns for n in names)


def with_optional(df: DataFrame, table: str, names: Iterable[str]) -> DataFrame:
    """The table with the named columns of its declared schema; those it lacks are typed NULLs."""
    kinds = {f.name: f.dataType for f in schemas.SCHEMAS[table].fields}
    return df.withColumns({n: F.lit(None).cast(kinds[n]) for n in names if n not in df.columns})


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
