"""Schema versions, pages, numbering levels and one-pass orphans."""
import random
from decimal import Decimal as Dm

import pytest
from pyspark.sql import functions as F

from fixtures import item, ledger, order, payment
from ledgerloom.operators import fulfilment as FU
from ledgerloom.operators import quality as Q
from ledgerloom.operators.running import number_all
from ledgerloom.plans.q_jobs import FKS
from ledgerloom.sources import schemas, tables


def test_versions_become_one_table(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([("1", "A-1", "draft"), ("2", "A-2", "ready_to_ship")], "id string, number string, status string").write.parquet(f"{path}/version=1")
    spark.createDataFrame([(3, "A-3", "nonsense", "9.555")], "id long, invoice_number string, status string, freight_amount string").write.parquet(f"{path}/version=10")
    got = tables.load_versions(spark, path, schemas.SCHEMAS["export_orders"], {1: {"number": "invoice_number"}},
                               {1: {"status": ["draft"]}, 10: {"status": schemas.ORDER_STATUSES}})
    assert got.columns == [*schemas.SCHEMAS["export_orders"].fieldNames(), "version", "outside_domain"]
    assert sorted((r.id, r.invoice_number, r.freight_amount, r.version, r.outside_domain) for r in got.collect()) == [
        (1, "A-1", None, 1, ""), (2, "A-2", None, 1, "status"), (3, "A-3", Dm("9.56"), 10, "status")]
    with pytest.raises(FileNotFoundError):
        tables.load_versions(spark, f"{path}/version=1", schemas.SCHEMAS["export_orders"])
    spark.createDataFrame([(1, 2)], "id long, alien long").write.parquet(f"{path}/other/version=1")
    with pytest.raises(ValueError):
        tables.load_versions(spark, f"{path}/other", schemas.SCHEMAS["export_orders"])


def test_pages_are_bounded_and_complete(spark):
    lines = [item(i, 1 if i < 23 else 2, "1", "1", line=i) for i in range(30)]
    t = ledger(spark, [order(1), order(2), order(3)], lines)
    pages = FU.order_detail_pages(t, page_lines=10).collect()
    assert sorted((r.id, r.page, r.first_line, len(r.lines)) for r in pages) == [(1, 0, 1, 10), (1, 1, 11, 10), (1, 2, 21, 3), (2, 0, 1, 7)]
    assert [x.id for r in sorted(pages, key=lambda r: (r.id, r.page)) for x in r.lines] == list(range(30))


@pytest.mark.parametrize("levels", [(), (2,), (14, 14)])
def test_scattered_ids_are_numbered_in_order(spark, levels):
    rng = random.Random(1)
    ids = list({rng.randint(-(1 << 62), 1 << 62) for _ in range(500)}) + list(range(40)) + [None, None]
    rows = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id long, k int")
    got = {r.k: r.n for r in number_all(rows, ["id", "k"], "n", bits=3, levels=levels).collect()}
    want = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, k))
    assert [got[k] for k in want] == list(range(1, len(ids) + 1))


def test_orphans_of_all_keys_in_one_pass(spark, tmp_path):
    t = ledger(spark, [order(1), order(2, client=99, bank=None)], [item(i, 1 + i % 3, "1", "1", product=1 + i % 2) for i in range(30)], [payment(1, 1, "1"), payment(2, 9, "1", user=None)])
    t = t.replace(document_events=spark.createDataFrame([(1, 1, 1), (2, 7, None)], "id long, target_id long, user_id long"), legacy_containers=t["shipment_containers"])
    names = {n for _, child, _, parent, _ in FKS for n in (child, parent)}
    for name in names:
        t[name].write.parquet(str(tmp_path / name))
    stored = tables.Tables({n: spark.read.parquet(str(tmp_path / n)) for n in names})
    got = Q.all_orphans(stored, FKS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q.all_orphans(stored, FKS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 4 and "BroadcastExchange" not in plan
    one_by_one = None
    for label, child, fk, parent, nullable in FKS:
        part = Q.orphans(stored[child], fk, stored[parent], nullable=nullable, label=label)
        one_by_one = part if one_by_one is None else one_by_one.unionByName(part)
    assert sorted(map(str, got.collect())) == sorted(map(str, one_by_one.collect())) and got.count() > 20


def test_no_position_is_lost_when_a_report_is_ordered(spark):
    from ledgerloom.operators.positions import with_position
    t = ledger(spark, [order(i, client=1 + i % 2) for i in range(1, 9)], [item(i, i, "1", "1") for i in range(1, 9)])
    from ledgerloom.operators import reports as R
    got = with_position(R.sales(t).select("id", "contract_date"), F.col("contract_date").desc(), F.col("id").desc()).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.position)] == list(range(8, 0, -1))
