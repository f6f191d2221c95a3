"""String column helpers (§2.9 string/array/null rows, V7, V8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """Strip all leading/trailing whitespace (SQL TRIM only strips spaces)."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def blank_to_null(c) -> Column:
    """'' or whitespace-only -> NULL, any other value kept as given."""
    c = col_(c)
    return F.when(js_trim(c) == "", F.lit(None).cast("string")).otherwise(c)


def contract_number_expr(sales_col: str = "sales_contract_number", invoice_col: str = "invoice_number") -> Column:
    """COALESCE(NULLIF(TRIM(sales_contract_number), ''), invoice_number)."""
    return F.coalesce(F.nullif(F.trim(F.col(sales_col)), F.lit("")), F.col(invoice_col))


def seal_list(c) -> Column:
    """V7: split on newline or comma, trim, drop empties, as a JSON array text; '' / NULL -> NULL."""
    c = col_(c)
    parts = F.filter(F.transform(F.split(c, r"\r?\n|,"), lambda x: js_trim(x)), lambda x: x != "")
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(F.to_json(parts))


def slug(c, default: str = "product") -> Column:
    """V8: drop the extension, non-alphanumeric runs -> '-', trim '-', lower case, default name."""
    c = col_(c)
    base = F.regexp_replace(c, r"\.[^./\\]*$", "")
    dashed = F.regexp_replace(base, r"[^A-Za-z0-9]+", "-")
    trimmed = F.lower(F.regexp_replace(dashed, r"^-+|-+$", ""))
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit(default))


def pad3(n) -> Column:
    """Zero-pad to at least three digits without truncating (1234 stays 1234)."""
    return F.format_string("%03d", col_(n))
