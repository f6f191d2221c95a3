"""Write-side table operations (S5-S11; ``store.py`` persists them and appends audit rows, S12).

Every operation is a pure DataFrame -> DataFrame transformation (keyed joins and unions) so it
can be planned, tested and retried; ``write_table`` persists a result into the shared table folder.
Keyed operations pre-select the narrow key columns before joining, and a key missing from a
patch is returned as a reject, never silently dropped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None, last: bool = True) -> DataFrame:
    """One row per key: the last (or first) in ``order``; without an order the greatest (least) row.

    Partially aggregated, so a key repeated in most of the rows costs one row per task.  Rows with a
    NULL key are all kept: a unique key does not bind them."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    rank = F.struct(*[F.col(f"`{c}`") for c in (order or [])], *[F.col(f"`{c}`") for c in rows.columns])
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    pick = F.max_by(whole, rank) if last else F.min_by(whole, rank)
    one = rows.filter(~missing).groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(pick.alias("_row"))
    return one.select("_row.*").unionByName(rows.filter(missing))


def append(target: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Target ∪ new rows (missing columns become NULL)."""
    return target.unionByName(new_rows, allowMissingColumns=True)


def upsert(target: DataFrame, src: DataFrame, keys: Sequence[str], update_cols: Sequence[str],
           order: Sequence[str] | None = None) -> DataFrame:
    """INSERT ... ON DUPLICATE KEY UPDATE: matched rows take ``update_cols`` from src, unmatched
    src rows are inserted, other target rows are kept.

    Source rows of one key apply one after the other in ``order`` (default: by their whole content): the
    first is inserted if the key is new, and the last one's ``update_cols`` stand."""
    last = one_per_key(src, keys, order)
    first = one_per_key(src, keys, order, last=False)
    s = last.select(*[F.col(c).alias(f"_s_{c}") for c in src.columns])
    rest = [c for c in src.columns if c not in keys and c not in update_cols]
    if rest:  # columns that only the insert sets come from the first row
        f = first.select(*[F.col(k).alias(f"_f_{k}") for k in keys], *[F.col(c).alias(f"_f_{c}") for c in rest])
        cond = F.lit(True)
        for k in keys:
            cond = cond & (F.col(f"_s_{k}") == F.col(f"_f_{k}"))
        null_key = " or ".join(f"_s_{k} is null" for k in keys)
        bound = s.filter(f"not ({null_key})").join(f, cond, "left")
        s = bound.select(*[F.col(f"_f_{c}").alias(f"_s_{c}") if c in rest else F.col(f"_s_{c}") for c in src.columns]).unionByName(s.filter(null_key))
    s = s.withColumn("_s_hit", F.lit(True))
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"_s_{k}")
        cond = c if cond is None else cond & c
    j = target.withColumn("_t_hit", F.lit(True)).join(s, cond, "full")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.coalesce(F.col(c), F.col(f"_s_{c}")).alias(c))
        elif c in update_cols and c in src.columns:
            out.append(F.when(F.col("_s_hit").isNotNull(), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
        elif c in src.columns:
            out.append(F.when(F.col("_t_hit").isNull(), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def insert_absent(target: DataFrame, src: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """INSERT IGNORE — add src rows whose key is not in target; of one key's rows the first in ``order``."""
    new = one_per_key(src, keys, order, last=False).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(new, allowMissingColumns=True)


def update_by_key(target: DataFrame, patch: DataFrame, keys: Sequence[str], cols: Sequence[str],
                  where=None, order: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Set ``cols`` from patch on matching keys (optionally only where ``where`` holds on the
    target row); returns (updated target, rejected patch rows: unknown key or blocked by ``where``).

    Of several patch rows of one key the last in ``order`` stands."""
    t = target.withColumn("_ok", F.lit(True) if where is None else where)
    one = one_per_key(patch, keys, order)
    p = one.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in cols]).withColumn("_p_hit", F.lit(True))
    j = t.join(p, list(keys), "left")
    apply = F.col("_p_hit").isNotNull() & F.coalesce(F.col("_ok"), F.lit(False))
    updated = j.select(*[F.when(apply, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                         for c in target.columns])
    ok_keys = t.filter(F.col("_ok")).select(*keys)
    rejected = patch.join(ok_keys, list(keys), "left_anti")
    return updated, rejected


def soft_delete(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """is_active = false for the given ids."""
    hit = ids.select(F.col(key).alias("_d")).distinct().withColumn("_del", F.lit(True))
    j = target.join(hit, target[key] == hit["_d"], "left")
    return j.select(*[F.when(F.col("_del").isNotNull(), F.lit(False)).otherwise(F.col(c)).alias(c)
                      if c == "is_active" else F.col(c) for c in target.columns])


# The foreign-key cascade graph (child table, child fk, parent table).
CASCADE = {
    "export_orders": [("export_order_items", "export_order_id"), ("document_audit_logs", "export_order_id")],
    "shipments": [("shipment_containers", "shipment_id"), ("shipment_allocations", "shipment_id"),
                  ("shipment_document_audit_logs", "shipment_id")],
    "shipment_containers": [("shipment_allocations", "shipment_container_id")],
}


def cascade_delete(tables: Mapping[str, DataFrame], root: str, ids: DataFrame, key: str = "id") -> dict:
    """Delete root rows and, following the cascade graph, their children (left_anti chains)."""
    out = dict(tables)
    pending = [(root, ids.select(F.col(key).alias("_del")).distinct())]
    while pending:
        table, dead = pending.pop()
        if table not in out:
            continue
        pk = key if table == root else "id"
        col = pk
        out[table] = out[table].join(dead, out[table][col] == dead["_del"], "left_anti")
        for child, fk in CASCADE.get(table, []):
            if child not in out:
                continue
            child_df = tables[child]
            doomed = child_df.join(dead, child_df[fk] == dead["_del"], "left_semi")
            out[child] = out[child].join(dead, out[child][fk] == dead["_del"], "left_anti")
            pending.append((child, doomed.select(F.col("id").alias("_del"))))
    return out


def replace_children(child: DataFrame, parent_key: str, new_rows: DataFrame, replaced_ids: DataFrame) -> DataFrame:
    """Drop every child of the replaced parents (explicit id list, so a parent may be emptied),
    then add the new set."""
    gone = replaced_ids.select(F.col(replaced_ids.columns[0]).alias("_rp")).distinct()
    kept = child.join(gone, child[parent_key] == gone["_rp"], "left_anti")
    return kept.unionByName(new_rows, allowMissingColumns=True)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist a table into the shared table folder (parquet)."""
    df.write.mode(mode).parquet(path)
