"""Result ordering.

Bulk outputs (every order, every client, every line) are returned unsorted: a global sort is a full
range-partition shuffle, and consumers of a bulk table sort the slice they show.  Single-entity
forms and ``ordered=True`` apply the presentation order of the ledger's screens."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sort_if(df: DataFrame, ordered: bool, *cols) -> DataFrame:
    return df.orderBy(*cols) if ordered else df
