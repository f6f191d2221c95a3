"""Positions of the rows of a sorted result, without one task that sees every row.

``orderBy`` deals ranges of the order to tasks.  Each task numbers its own rows while the sorted rows are
written once (to the shared folder); one count per task, summed up in order, gives each range its first
position.  The written table is what every later read sees, so positions stay the same when executors
are lost.

Defined cases: rows that are equal in every order column are numbered in any order; without order columns
the rows are numbered as they are read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import stored

_ROW_BITS = 33  # monotonically_increasing_id: the task's number above, the row's number within the task below


def with_position(df: DataFrame, *order: Column, out: str = "position") -> DataFrame:
    """Add ``out``: the number of rows before this one in the given order (from 0)."""
    row = "_position_row"
    ranged = df.orderBy(*order) if order else df
    written = stored(ranged.withColumn(row, F.monotonically_increasing_id()), "positions")
    task = F.shiftright(row, _ROW_BITS)
    # One row per writing task: a bounded table whatever the number of rows.
    counts = written.groupBy(task.alias("_position_task")).agg(F.count(F.lit(1)).alias("_position_rows"))
    before = Window.orderBy("_position_task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_position_task", F.coalesce(F.sum("_position_rows").over(before), F.lit(0)).alias("_position_first"))
    index = F.col(row).bitwiseAND((1 << _ROW_BITS) - 1)
    return (written.withColumn("_position_task", task).join(F.broadcast(firsts), "_position_task")
            .withColumn(out, F.col("_position_first") + index).drop("_position_task", "_position_first", row))
