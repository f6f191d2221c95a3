"""Exact-decimal money and quantity discipline.

All arithmetic runs on decimals with explicit widths so no step silently drops scale (a
``decimal(37,7) * decimal(5,2)`` product would otherwise be cut to ``(38,6)``).  Results leave the
library as doubles converted through their decimal text, which is correctly rounded on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Storage types of the ledger (MySQL DDL widths) and the comparison tolerances.
QTY = "decimal(12,3)"
PRICE = "decimal(14,4)"
MONEY = "decimal(14,2)"
PERCENT = "decimal(5,2)"
TOTAL = "decimal(24,7)"        # sum of quantity x price, scale 7, headroom for any realistic total
MONEY_SUM = "decimal(20,2)"    # sums of stored money
QTY_SUM = "decimal(22,3)"      # sums of stored quantities
MONEY_EPS = "0.004"            # remaining/advance thresholds
QTY_EPS = "0.0001"             # quantity-left threshold


def dec(value: str, dtype: str) -> Column:
    """Decimal literal of an explicit type (never a double)."""
    return F.lit(value).cast(dtype)


def money_eps() -> Column:
    return dec(MONEY_EPS, "decimal(5,4)")


def qty_eps() -> Column:
    return dec(QTY_EPS, "decimal(5,4)")


def percent_of(total: Column, pct: Column) -> Column:
    """round(total * pct / 100, 2), exact: /100 is a multiplication by decimal 0.01."""
    return F.round(total.cast(TOTAL) * pct.cast(PERCENT) * dec("0.01", "decimal(3,2)"), 2).cast(MONEY_SUM)


def exact_double(c: Column) -> Column:
    """Decimal -> double through its decimal text (correctly rounded, engine independent)."""
    return c.cast("string").cast("double")


def sql_exact_double(expr: str) -> str:
    """The same conversion in oracle SQL."""
    return f"CAST(CAST({expr} AS VARCHAR) AS DOUBLE)"


def to_output(df: DataFrame) -> DataFrame:
    """Query boundary: every decimal column leaves as an exactly converted double."""
    from pyspark.sql.types import DecimalType
    return df.select(*[exact_double(F.col(f.name)).alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])
