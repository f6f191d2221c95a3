"""Payment phases and allocation rounds: long contended orders and lines against plain sequential versions."""
import random
from decimal import Decimal as Dm

import pytest

from ledgerloom.operators import admission as G
from tests.fixtures import item, ledger, order


def replay(remaining, amounts):
    out = []
    for a in amounts:
        before = remaining
        outcome = "fully_paid" if remaining <= Dm("0.004") else "exceeds" if a - remaining > Dm("0.004") else "accepted"
        if outcome == "accepted":
            remaining = max(remaining - a, Dm(0))
        out.append((outcome, before, remaining))
    return out


def sequences(seed):
    rng = random.Random(seed)
    cents = lambda x: Dm(x) / 100
    return {
        1: [cents(rng.randint(1, 30_000)) for _ in range(400)],
        2: [x for k in range(60) for x in (Dm(1), Dm(1000 - k))],  # one acceptance after the other, each followed by a refusal
        3: [cents(1) for _ in range(300)] + [cents(10 ** rng.randint(0, 5)) for _ in range(100)],
        4: [Dm(1000)] + [cents(rng.randint(1, 9)) for _ in range(50)],
        5: [Dm(2) ** k for k in range(9, -1, -1)] * 3 + [cents(1)],
        6: [Dm(2000)] * 40,
    }


@pytest.mark.parametrize("fold", [1, 7, 512])
def test_payment_tails_match_the_sequence(spark, monkeypatch, fold):
    monkeypatch.setattr(G, "FOLD_REQUESTS", fold)
    asked = sequences(fold)
    t = ledger(spark, [order(o) for o in asked], [item(o, o, "100", "10.0001" if o % 2 else "9.99999", line=1) for o in asked])
    rows, n = [], 0
    for k in range(max(map(len, asked.values()))):
        for o, amounts in asked.items():
            if k < len(amounts):
                n += 1
                rows.append((n, o, amounts[k]))
    out = G.admit_payments(t, spark.createDataFrame(rows, "request_id long, order_id long, amount decimal(14,2)"), include_existing=False)
    got = {r.request_id: (r.outcome, r.remaining_before, r.remaining_after) for r in out.collect()}
    assert len(got) == n
    for o, amounts in asked.items():
        total = Dm(100) * (Dm("10.0001") if o % 2 else Dm("10.0000"))  # prices are stored with four decimals
        assert [got[i] for i, oo, _ in rows if oo == o] == replay(total, amounts), o


@pytest.mark.parametrize("seed", range(3))
def test_chained_lines_match_the_sequence(spark, seed):
    rng = random.Random(seed)
    lines = {x: rng.randint(5, 60) for x in range(11, 31)}
    t = ledger(spark, [order(o) for o in (1, 2)], [item(x, 1 + x % 2, str(q), "1", line=x) for x, q in lines.items()])
    asked = {}
    for rid in range(1, 240):
        # neighbouring lines chain every request to the others; line 11 is hot
        first = 11 if rid % 3 == 0 else rng.randint(11, 29)
        asked[rid] = {x: rng.choice([1, 1, 2, 7, 30]) for x in {first, first + 1, rng.randint(11, 30)}}
    left, want = dict(lines), {}
    for rid, need in asked.items():
        ok = all(q <= left[x] for x, q in need.items())
        want[rid] = "accepted" if ok else "rejected"
        if ok:
            for x, q in need.items():
                left[x] -= q
    df = spark.createDataFrame([(rid, 1, x, Dm(q)) for rid, need in asked.items() for x, q in need.items()],
                               "request_id long, client_id long, export_order_item_id long, quantity decimal(12,3)")
    out = G.admit_shipments(t, df).collect()
    assert {r.request_id: r.outcome for r in out} == want
    assert all((r.reason == "short") == (r.outcome == "rejected") for r in out)
