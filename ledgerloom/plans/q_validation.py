"""Registered validation queries: every rule set over raw request text derived from the orders table.

The raw text of a field is picked from a pool of good and bad spellings by the order's key, so each
rule set sees its rules broken in many combinations and the work grows with the table.  The oracle
states the rules again in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import quality as Q
from ledgerloom.plans.catalog import register, with_ctes

# Spellings by kind of field (None is NULL).
POOLS: dict[str, list[str | None]] = {
    "id": ["12", "12.0", "1e3", "7", "0", "-3", "", "  ", "abc", None, "2.5", " 9 ", "99999999999999999999"],
    "number": ["1.25", "4", "0", "0.0001", "", None, "x", "-1", "1000000000000", "100.5", " 7 "],
    "date": ["2024-01-15", "2023-12-31", "2024-02-30", "", " 2024-01-15 ", None, "15/01/2024"],
    "email": ["a@b.co", "", None, "nope", "A@B.CO", "x@y.zz"],
    "bool": ["true", "false", "maybe", None, "TRUE"],
}


def _pool(r: Q.Rule) -> list[str | None]:
    if r.kind == "enum":
        return [*r.domain[:2], "nope", "", None]
    if r.kind == "text":
        return ["some text", " padded ", "", "  ", None, "a", "z" * ((r.max_len or 20) + 1)]
    return POOLS[r.kind]


def _raw(rules: list[Q.Rule]) -> str:
    """SELECT of request_id and one text column per field; the same text on both sides."""
    columns = []
    for j, r in enumerate(rules):
        pool = _pool(r)
        # most fields are well formed most of the time, or no row would be valid
        usual = "2" if r.field == "fi_number" else "o_orderkey % 2"  # the blank one of two exclusive fields
        pick = f"CASE WHEN (o_orderkey * {2 * j + 3} + {j}) % {len(rules) + 3} = 0 THEN CAST(FLOOR(o_orderkey / {j + 2}) AS BIGINT) % {len(pool)} ELSE {usual} END"
        arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(pool))
        columns.append(f"CASE {pick} {arms} END AS {r.field}")
    return "SELECT o_orderkey AS request_id, " + ", ".join(columns)


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _rule_sql(r: Q.Rule) -> tuple[str, list[str]]:
    """(value, error texts or NULL) of a rule in DuckDB SQL."""
    x, t = r.field, _trim(r.field)
    absent = f"({x} IS NULL OR {x} = '')" if r.blank_null else f"({x} IS NULL)"
    say = lambda cond, what: f"CASE WHEN {cond} THEN '{r.field}:{what}' END"
    if r.kind in ("id", "number"):
        kind = (r.dtype or ("bigint" if r.kind == "id" else "decimal(14,2)")).upper()
        n = f"(CASE WHEN {x} IS NULL OR {t} = '' THEN CAST(0 AS DECIMAL(38,10)) ELSE TRY_CAST({t} AS DECIMAL(38,10)) END)"
        typed = f"TRY_CAST({n} AS {kind})"
        here = f"NOT {absent}" if r.nullable else "TRUE"
        known = f"{here} AND {n} IS NOT NULL"
        above = f"{n} > CAST('{r.max}' AS DECIMAL(38,10))" if r.max is not None else "FALSE"
        errors = [say(f"{here} AND {n} IS NULL", "not a number")]
        if r.kind == "id" or r.integer:
            errors.append(say(f"{known} AND {n} <> floor({n})", "not an integer"))
        errors.append(say(f"{known} AND {typed} IS NULL AND NOT ({above})", "out of range"))
        if r.kind == "id" or r.positive:
            errors.append(say(f"{known} AND COALESCE(CAST({typed} AS DECIMAL(38,10)), {n}) <= 0", "must be positive"))
        if r.min is not None:
            errors.append(say(f"{known} AND {n} < {r.min}", f"below {r.min:g}"))
        if r.max is not None:
            errors.append(say(f"{known} AND {above}", f"above {r.max:g}"))
        whole = f" AND {n} = floor({n})" if r.kind == "id" or r.integer else ""
        return f"CASE WHEN {here}{whole} THEN {typed} END", errors
    if r.kind == "date":
        good = f"COALESCE(regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND TRY_CAST({x} AS DATE) IS NOT NULL, FALSE)"
        return f"CASE WHEN {good} THEN TRY_CAST({x} AS DATE) END", [say(f"NOT {good}" + (f" AND NOT {absent}" if r.nullable else ""), "invalid date")]
    if r.kind == "bool":
        b = f"(CASE lower({t}) WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END)"
        return f"CASE WHEN {x} IS NULL THEN {bool(r.default)} ELSE {b} END", [say(f"{x} IS NOT NULL AND {b} IS NULL", "not a boolean")]
    value = t if r.default is None else f"COALESCE({t}, '{r.default}')"
    if r.blank_null:
        value = f"(CASE WHEN NOT {absent} THEN {value} END)"
    errors = []
    if r.required and r.default is None and not r.nullable:
        errors.append(say(f"{x} IS NULL", "required"))
    if r.min_len is not None:
        errors.append(say(f"length({value}) < {r.min_len}", f"shorter than {r.min_len}"))
    if r.max_len is not None:
        errors.append(say(f"length({value}) > {r.max_len}", f"longer than {r.max_len}"))
    if r.kind == "email":
        errors.append(say(f"NOT {absent} AND NOT regexp_matches({t}, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')", "invalid e-mail"))
        value = f"lower({value})"
    if r.kind == "enum":
        allowed = ", ".join(f"'{v}'" for v in r.domain)
        errors.append(say(f"{value} IS NOT NULL AND {value} NOT IN ({allowed})", "not allowed"))
    return value, errors


def _oracle(rules: list[Q.Rule], extra: list[str]) -> str:
    compiled = [_rule_sql(r) for r in rules]
    errors = ", ".join([e for _, some in compiled for e in some] + extra)
    values = " || '|' || ".join(f"COALESCE(CAST({v} AS VARCHAR), '~')" for v, _ in compiled)
    return (f"SELECT request_id, errors = '' AS is_valid, errors, coerced FROM (SELECT request_id, concat_ws(';', {errors}) AS errors, "
            f"{values} AS coerced FROM ({_raw(rules)} FROM orders) raw) judged")


def _register(name: str, rules: list[Q.Rule]) -> None:
    exclusive = name == "shipments"
    gd, fi = _trim("gd_number"), _trim("fi_number")
    extra = [f"CASE WHEN {gd} <> '' AND {fi} <> '' THEN 'gd_number:choose one, not both' END"] if exclusive else []

    @register(f"validate_raw_{name}", with_ctes(_oracle(rules, extra)))
    def build(t):
        raw = t["orders"].sparkSession.sql(_raw(rules) + " FROM {orders}", orders=t["orders"])
        checked = Q.judge(raw, rules, ["request_id"], [Q.exclusive("gd_number", "fi_number")] if exclusive else ())
        text = F.concat_ws("|", *[F.coalesce(F.col(r.field).cast("string"), F.lit("~")) for r in rules])
        return checked.select("request_id", "is_valid", "errors", text.alias("coerced"))

    build.__doc__ = f"V1 (and V2 where it applies): the {name} rules over raw request text."


for _name, _rules in Q.RULE_SETS.items():
    _register(_name, _rules)
