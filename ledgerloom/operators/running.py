"""Skew-safe running sums and row numbers.

A plain ``sum().over(partitionBy(key).orderBy(...))`` sends every row of a key to one task; one
client or container holding a third of the data would then sort a third of the data in one task.
Here each key is cut into *chunks* by a caller-supplied coarsening of the sort key that is monotone
along the order (e.g. the date, or a text prefix of the id).  Every chunk computes a local running
sum in its own window partition; chunk totals (one row per key and chunk — small) give an exclusive
offset per chunk, and an equi-join adds it back.  The chunk of a row is a pure function of the row,
so both branches agree no matter how often or where they are recomputed (no sampling, no
partition ids), and the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import kept


def _cols(items: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in items]


def _null_free(df: DataFrame, names: Sequence[str], prefix: str):
    """Each key -> (is-null flag, value with NULL replaced by a typed default).  Plain equality on the
    pair is null-safe equality on the key, and the window's hash partitioning on the same columns is
    reused by the join (no extra shuffle of the large side)."""
    cols = []
    types = dict(df.dtypes)
    for i, name in enumerate(names):
        t = types[name]
        if t.startswith(("decimal", "int", "bigint", "smallint", "tinyint", "double", "float")):
            default = F.lit(0).cast(t)
        elif t == "date":
            default = F.lit("1970-01-01").cast("date")
        elif t == "boolean":
            default = F.lit(False)
        else:
            default = F.lit("").cast(t)
        df = (df.withColumn(f"{prefix}n{i}", F.col(name).isNull())
              .withColumn(f"{prefix}v{i}", F.coalesce(F.col(name), default)))
        cols += [f"{prefix}n{i}", f"{prefix}v{i}"]
    return df, cols


#: Ids and positions are cut into blocks of this many bits for numbering and running sums.
ID_BLOCK_BITS = 20
LINE_BLOCK_BITS = 12


def id_block(column: Column | str, bits: int = ID_BLOCK_BITS) -> Column:
    """Chunk of a whole-number sort key: blocks of ``2 ** bits`` neighbouring values."""
    c = F.col(column) if isinstance(column, str) else column
    return F.shiftright(c.cast("bigint"), bits)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence, value: Column | str, out: str,
                chunk: Sequence | None = None, exclusive: bool = False,
                result_type: str | None = None) -> DataFrame:
    """Add ``out`` = Σ value over the rows of the same key up to and including this row.

    ``order`` must be a total order within a key; ``chunk`` (default: the first order column) must
    be non-decreasing along ``order``.  ``exclusive`` leaves out the row itself.

    Every key takes the same path: a window per (key, chunk), one partially aggregated total per
    (key, chunk), and the totals' own running sum per key as the chunk's offset.  The largest task is
    the largest chunk, or a key's chunk totals."""
    val = F.col(value) if isinstance(value, str) else value
    base, key_part = _null_free(df.withColumn("_rv", val), list(keys), "_k")
    chunk_names = []
    for i, expr in enumerate(_cols(chunk) if chunk is not None else _cols(order[:1])):
        base = base.withColumn(f"_c{i}", expr)
        chunk_names.append(f"_c{i}")
    base, chunk_part = _null_free(base, chunk_names, "_q")
    part = key_part + chunk_part
    local_w = (Window.partitionBy(*part).orderBy(*_cols(order))
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # explicit exchange on (key, chunk): an input already hash-partitioned by the key alone would
    # otherwise satisfy the window's clustering and keep a hot key in one task
    local = base.repartition(*part).withColumn("_local", F.sum("_rv").over(local_w))
    totals = base.groupBy(*part).agg(F.sum("_rv").alias("_ct"))
    chunk_order = []
    for flag, v in zip(chunk_part[::2], chunk_part[1::2]):
        chunk_order += [F.col(flag).desc(), F.col(v).asc()]  # NULL chunks first, like the row order
    chunk_w = Window.partitionBy(*key_part).orderBy(*chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_ct").over(chunk_w), F.lit(0))).drop("_ct")
    joined = local.join(offsets, part, "left")
    total = F.col("_local") + F.coalesce(F.col("_off"), F.lit(0))
    if exclusive:
        total = total - F.col("_rv")
    if result_type:
        total = total.cast(result_type)
    return joined.withColumn(out, total).drop("_rv", "_local", "_off", *chunk_names, *part)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "line_number",
                chunk: Sequence | None = None) -> DataFrame:
    """1-based row number within a key, skew-safe (running count; ``order`` must be total)."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, chunk=chunk, result_type="int")


def beyond(rows: DataFrame, key: str, most: int, name: str) -> DataFrame:
    """Values of ``key`` that more than ``most`` rows have; written, so the planner sees how few they are."""
    return kept(rows.groupBy(F.col(key).alias(name)).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(name))


def by_size(rows: DataFrame, key: str, short, long, bits: int = LINE_BLOCK_BITS, among: DataFrame | None = None) -> DataFrame:
    """The rows through ``short`` (one window per key) where a key has at most a block of rows, through ``long``
    (chunks) where it has more.  ``among``: rows that hold these and are cheaper to count."""
    large = beyond(rows if among is None else among, key, 1 << bits, "_large")
    if large.isEmpty():
        return short(rows)
    same = F.col(key).eqNullSafe(F.col("_large"))
    return short(rows.join(large, same, "left_anti")).unionByName(long(rows.join(large, same, "left_semi")))


def number_lines(rows: DataFrame, key: str, order: str, out: str = "line_number", among: DataFrame | None = None) -> DataFrame:
    """W5 by a whole-number order column: rows are dealt once, by the key; only keys of more than a block of rows
    are numbered by chunks."""
    return by_size(rows, key,
                   lambda df: df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(order))),
                   lambda df: number_rows(df, [key], [order], out, chunk=[id_block(order, LINE_BLOCK_BITS)]), among=among)


#: A whole batch is numbered in smaller blocks: one of 2 ** 20 dense ids, with several rows each, is a task of its own.
BATCH_BLOCK_BITS = 14

#: Levels of blocks above the first: block totals are summed within larger blocks, and so on, until the
#: last level has at most 2 ** (63 - bits - sum) blocks for ids of 64 bits.
NUMBER_LEVELS = (17, 17)


def number_all(df: DataFrame, order: Sequence[str], out: str, bits: int = BATCH_BLOCK_BITS, levels: Sequence[int] = NUMBER_LEVELS) -> DataFrame:
    """1-based row number over the whole batch in the given order, without a constant key.

    Rows are numbered within blocks of the first order column (a whole number), blocks within larger blocks and
    so on; ids that are scattered over all of 64 bits have few blocks left at the last level, which is the only
    window without a key.  NULLs of the first order column come first."""
    df = df.withColumn("_blk", id_block(order[0], bits))
    local = df.withColumn("_ln", F.row_number().over(Window.partitionBy("_blk").orderBy(*order)))
    # a row per block, read several times below: written, so that the plan holds what made the rows only once
    totals = kept(df.groupBy("_blk").agg(F.count(F.lit(1)).alias("_bn")))
    starts = _starts(totals, list(levels)).select(F.col("_blk").alias("_sb"), F.col("_start").alias("_so"))
    return (local.join(starts, F.col("_blk").eqNullSafe(F.col("_sb")))
            .withColumn(out, (F.col("_so") + F.col("_ln")).cast("bigint")).drop("_blk", "_sb", "_so", "_ln"))


def _starts(totals: DataFrame, levels: list[int]) -> DataFrame:
    """(_blk, _start): rows of all earlier blocks (_blk, _bn), by blocks of blocks."""
    before = lambda w: F.coalesce(F.sum("_bn").over(w.orderBy(F.col("_blk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not levels:
        return totals.select("_blk", before(Window.partitionBy()).alias("_start"))
    grouped = totals.withColumn("_up", id_block("_blk", levels[0]))
    above = grouped.groupBy(F.col("_up").alias("_blk")).agg(F.sum("_bn").alias("_bn"))
    offsets = _starts(above, levels[1:]).select(F.col("_blk").alias("_ub"), F.col("_start").alias("_us"))
    inside = grouped.withColumn("_in", before(Window.partitionBy("_up")))
    return inside.join(offsets, F.col("_up").eqNullSafe(F.col("_ub"))).select("_blk", (F.col("_in") + F.col("_us")).alias("_start"))
