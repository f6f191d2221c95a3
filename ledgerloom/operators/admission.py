"""Admission and state rules as set-based batch jobs.

Each job takes a DataFrame of requests and returns one row per request with an outcome and a
reason.  Only payment and allocation admission are order-dependent; both resolve every
uncontended key with prefix sums and the contended ones in rounds of prefix sums, so no key and no chain
of keys is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import QTY_EPS, QTY_SUM, money_eps
from ledgerloom.functions.text import pad3
from ledgerloom.operators.balances import order_totals, payment_totals, with_balances
from ledgerloom.operators.running import LINE_BLOCK_BITS, beyond, id_block, number_rows, running_sum
from ledgerloom.session import kept, release
from ledgerloom.sources.sinks import update_by_key

STATE = "decimal(30,7)"


# ---------------------------------------------------------------- reference counts

def first_container(containers: DataFrame) -> DataFrame:
    """First container (MIN(id)) per shipment."""
    return containers.groupBy("shipment_id").agg(F.min("id").alias("container_id"))


def allocation_counts(t, active_only: bool = False) -> DataFrame:
    """Allocations per order (any shipment status, or only non-cancelled shipments)."""
    a = t["shipment_allocations"]
    if active_only:
        s = t["shipments"].filter(F.col("status") != "cancelled").select(F.col("id").alias("_sid"))
        a = a.join(s, a["shipment_id"] == s["_sid"], "left_semi")
    i = t["export_order_items"].select(F.col("id").alias("_iid"), "export_order_id")
    return (a.join(i, a["export_order_item_id"] == i["_iid"], "inner")
            .groupBy("export_order_id").agg(F.count(F.lit(1)).alias("allocation_count")))


def payment_counts(t) -> DataFrame:
    """Payments per order with their sum."""
    return t["order_payments"].groupBy("export_order_id").agg(
        F.count(F.lit(1)).alias("payment_count"), F.sum("amount").cast("decimal(20,2)").alias("additional_received"))


def account_usage(t) -> DataFrame:
    """Contracts per bank account."""
    return (t["export_orders"].filter(F.col("bank_account_id").isNotNull())
            .groupBy("bank_account_id").agg(F.count(F.lit(1)).alias("contract_count")))


def max_sequence(existing: DataFrame, year_col: str = "sequence_year", seq_col: str = "sequence_number") -> DataFrame:
    """Current max sequence per year."""
    if seq_col not in existing.columns:
        raise ValueError(f"missing column {seq_col}: numbering would start again")
    return existing.groupBy(F.col(year_col).alias("_year")).agg(F.max(seq_col).alias("_max_seq"))


def requested_per_line(requests: DataFrame, request_key: str = "request_id",
                       line_key: str = "export_order_item_id", qty: str = "quantity") -> DataFrame:
    """Requested quantity per (request, line), summed across containers."""
    return requests.groupBy(request_key, line_key).agg(F.sum(qty).cast(QTY_SUM).alias("requested"))


def revised_totals(items: DataFrame, request_key: str = "request_id") -> DataFrame:
    """Order total of a proposed item set per request (samples count 0)."""
    v = F.when(F.col("is_sample") == F.lit(False), F.col("quantity") * F.col("client_price_per_carton")) \
        .otherwise(F.lit(0))
    return items.groupBy(request_key).agg(F.sum(v).cast("decimal(24,7)").alias("revised_total"))


# ---------------------------------------------------------------- G1 numbering

def assign_numbers(new: DataFrame, existing: DataFrame, prefix: str, year_col: str = "sequence_year",
                   order: list[str] | None = None, out: str = "invoice_number") -> DataFrame:
    """G1: per year, continue after the current max: PREFIX-001/2024 (no truncation past 999)."""
    order = order or ["id"]
    mx = max_sequence(existing, year_col)
    numbered = number_rows(new, [year_col], order, "_rank",
                           chunk=[id_block(order[0])])
    j = numbered.join(mx, numbered[year_col] == mx["_year"], "left")
    seq = (F.coalesce(F.col("_max_seq"), F.lit(0)) + F.col("_rank")).cast("int")
    return (j.withColumn("sequence_number", seq)
            .withColumn(out, F.concat(F.lit(f"{prefix}-"), pad3(F.col("sequence_number")), F.lit("/"),
                                      F.col(year_col).cast("string")))
            .drop("_year", "_max_seq", "_rank"))


# ---------------------------------------------------------------- G2 payments

#: An order's undecided requests are folded in one row up to this number; longer tails are first cut in phases.
FOLD_REQUESTS = 512


def _fold_tails(tails: DataFrame) -> DataFrame:
    """The sequential payment rule over each order's requests in one row (at most ``FOLD_REQUESTS`` of them)."""
    zero = F.lit(0).cast(STATE)
    arrived = F.sort_array(F.collect_list(F.struct("request_id", "amount")))
    rows = tails.groupBy("order_id").agg(F.first("_r").alias("_r"), arrived.alias("_requests"))

    def step(acc, x):
        r = acc["r"]
        outcome = F.when(r <= money_eps(), "fully_paid").when(x["amount"] - r > money_eps(), "exceeds").otherwise("accepted")
        after = F.when(outcome == "accepted", F.greatest((r - x["amount"]).cast(STATE), zero)).otherwise(r)
        done = F.struct(x["request_id"].alias("request_id"), x["amount"].alias("amount"), outcome.alias("outcome"),
                        r.alias("remaining_before"), after.alias("remaining_after"))
        return F.struct(after.alias("r"), F.concat(acc["done"], F.array(done)).alias("done"))

    empty = F.array().cast("array<struct<request_id:bigint,amount:decimal(14,2),outcome:string,remaining_before:decimal(30,7),remaining_after:decimal(30,7)>>")
    folded = F.aggregate("_requests", F.struct(F.col("_r").alias("r"), empty.alias("done")), step)
    return rows.select("order_id", F.explode(folded["done"]).alias("d")).select("d.request_id", "order_id", *[f"d.{c}" for c in _OUTCOME[2:]])


_OUTCOME = ["request_id", "order_id", "amount", "outcome", "remaining_before", "remaining_after"]


def _payment_phase(tails: DataFrame) -> DataFrame:
    """One phase of long tails (order_id, request_id, amount, _r: what is left before the tail's first request).

    Let L < _r <= 2 L.  While more than L is left, every request of at most L is accepted, so what is left
    before a request is a prefix sum; the first larger request that fits ends the phase, as does the request
    that leaves L or less.  So what is left at least halves in a phase, however long the tail is, and each
    phase is prefix sums by chunks and one least request per order.  Adds the outcome columns (NULL: behind
    the phase) and _next, what is left then."""
    unit = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_r").cast("double"))) - 1).cast(STATE)
    # the logarithm is a double: at its edge the power may be one too high or too low
    unit = F.when(unit >= F.col("_r"), (unit / 2).cast(STATE)).when(unit * 2 < F.col("_r"), (unit * 2).cast(STATE)).otherwise(unit)
    rows = tails.withColumn("_unit", unit).withColumn("_small", F.col("amount") <= F.col("_unit"))
    rows = rows.withColumn("_taken", F.when(F.col("_small"), F.col("amount")).otherwise(F.lit(0)).cast("decimal(14,2)"))
    rows = running_sum(rows, ["order_id"], ["request_id"], "_taken", "_sum", chunk=[id_block("request_id")], exclusive=True, result_type=STATE)
    before = (F.col("_r") - F.col("_sum")).cast(STATE)
    fits = ~F.col("_small") & (F.col("amount") - before <= money_eps())
    ends = fits | (F.col("_small") & (before - F.col("amount") <= F.col("_unit")))
    rows = kept(rows.withColumn("_before", before).withColumn("_ends", ends))
    left = F.greatest((F.col("_before") - F.col("amount")).cast(STATE), F.lit(0).cast(STATE))
    last = rows.filter("_ends").groupBy(F.col("order_id").alias("_lo")).agg(F.min_by(F.struct("request_id", left.alias("left")), "request_id").alias("_last"))
    rows = rows.join(last, rows["order_id"] == last["_lo"], "left")
    inside = F.col("_last").isNull() | (F.col("request_id") <= F.col("_last.request_id"))
    accepted = F.col("_small") | (F.col("request_id") == F.col("_last.request_id"))
    return rows.select("request_id", "order_id", "amount", F.when(inside, F.when(accepted, "accepted").otherwise("exceeds")).alias("outcome"),
                       F.col("_before").alias("remaining_before"), F.when(F.coalesce(accepted, F.lit(False)), left).otherwise(F.col("_before")).alias("remaining_after"),
                       F.col("_last.left").alias("_next"))


def _settle_payments(tails: DataFrame) -> DataFrame:
    """Outcomes of the orders' tails (order_id, request_id, amount, _r), each in request order."""
    out = None
    while True:
        tails = tails.withColumn("_paid", F.col("_r") <= money_eps())
        sizes = tails.filter("not _paid").groupBy(F.col("order_id").alias("_so")).agg(F.count(F.lit(1)).alias("_n"))
        tails = kept(tails.join(sizes, tails["order_id"] == sizes["_so"], "left").drop("_so"))
        out = _union(out, tails.filter("_paid").select("request_id", "order_id", "amount", F.lit("fully_paid").alias("outcome"),
                                                      F.col("_r").alias("remaining_before"), F.col("_r").alias("remaining_after")))
        open_rows = tails.filter("not _paid")
        out = out.unionByName(_fold_tails(open_rows.filter(F.col("_n") <= FOLD_REQUESTS)).select(*_OUTCOME))
        long = open_rows.filter(F.col("_n") > FOLD_REQUESTS)
        if long.isEmpty():
            return out
        phase = kept(_payment_phase(long.select("order_id", "request_id", "amount", "_r")))
        out = out.unionByName(phase.filter("outcome is not null").select(*_OUTCOME))
        tails = phase.filter("outcome is null").select("order_id", "request_id", "amount", F.col("_next").alias("_r"))


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _of_orders(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of the given orders only (ids: order_id)."""
    wanted = ids.select(F.col("order_id").cast("bigint").alias("_want")).filter("_want is not null").distinct()
    return df.join(wanted, df[key] == wanted["_want"], "left_semi")


def requested_orders(t, requests: DataFrame):
    """The orders, items and payments that a batch of requests (order_id) touches, and nothing else."""
    return _with(t, export_orders=_of_orders(t["export_orders"], "id", requests),
                 export_order_items=_of_orders(t["export_order_items"], "export_order_id", requests),
                 order_payments=_of_orders(t["order_payments"], "export_order_id", requests))


def _with(t, **frames):
    """The table bundle (or plain dict) with some tables replaced."""
    return t.replace(**frames) if hasattr(t, "replace") else {**t, **frames}


def admit_payments(t, requests: DataFrame, include_existing: bool = True) -> DataFrame:
    """Payment requests (request_id = arrival order, order_id, amount) -> outcome per request.

    invalid_amount (≤ 0) / unknown_order / cancelled / fully_paid (remaining ≤ 0.004) /
    exceeds (amount − remaining > 0.004) / accepted (consumes).  Only the requested orders are read.
    An order's leading requests are accepted with a prefix sum as long as they all fit.  From the first
    that does not, long tails go through phases that at least halve what is left (``_payment_phase``), and
    what is then a short tail is folded in one row."""
    t = requested_orders(t, requests)
    totals = order_totals(t, ["id", "status", "advance_percentage"])
    bal = with_balances(totals, payment_totals(t["order_payments"]) if include_existing else None)
    start = bal.select(F.col("id").alias("_oid"), F.col("status").alias("_status"),
                       F.col("remaining_amount").cast(STATE).alias("_r0"))
    req = requests.select(F.col("request_id").cast("bigint").alias("request_id"),
                          F.col("order_id").cast("bigint").alias("order_id"),
                          F.col("amount").cast("decimal(14,2)").alias("amount"))
    j = req.join(start, req["order_id"] == start["_oid"], "left")
    # a request must carry a positive amount (validated before any order is looked at)
    bad_amount = F.col("amount").isNull() | (F.col("amount") <= 0)
    static = (j.filter(bad_amount | F.col("_oid").isNull() | (F.col("_status") == "cancelled"))
              .select("request_id", "order_id", "amount",
                      F.when(bad_amount, "invalid_amount").when(F.col("_oid").isNull(), "unknown_order")
                      .otherwise("cancelled").alias("outcome"),
                      F.col("_r0").alias("remaining_before"), F.col("_r0").alias("remaining_after")))
    live = j.filter(~bad_amount & F.col("_oid").isNotNull() & (F.col("_status") != "cancelled"))
    live = running_sum(live.select("request_id", "order_id", "amount", "_r0"), ["order_id"], ["request_id"], "amount",
                       "_before_sum", chunk=[id_block("request_id")], exclusive=True, result_type=STATE)
    before = F.col("_r0") - F.col("_before_sum")
    # the prefix sum is exact up to the first request that does not fit (or meets a paid order)
    # the batch with its prefix sums is read four times below: kept in the shared folder
    live = kept(live.withColumn("_fits", (before > money_eps()) & (F.col("amount") <= before)))
    first_bad = live.filter(~F.col("_fits")).groupBy(F.col("order_id").alias("_boid")).agg(F.min("request_id").alias("_bad"))
    live = live.join(first_bad, live["order_id"] == first_bad["_boid"], "left")
    in_prefix = F.col("_bad").isNull() | (F.col("request_id") < F.col("_bad"))
    easy = live.filter(in_prefix).select(
        "request_id", "order_id", "amount", F.lit("accepted").alias("outcome"), before.cast(STATE).alias("remaining_before"),
        (before - F.col("amount")).cast(STATE).alias("remaining_after"))
    # what the prefix left is the sum before the first request that does not fit
    left = live.filter(F.col("request_id") == F.col("_bad")).select(F.col("order_id").alias("_loid"), before.cast(STATE).alias("_left"))
    hard = live.filter(~in_prefix).select("request_id", "order_id", "amount")
    hard = hard.join(left.dropDuplicates(["_loid"]), hard["order_id"] == F.col("_loid"), "inner")
    tails = hard.select("order_id", "request_id", "amount", F.col("_left").alias("_r"))
    return static.unionByName(easy).unionByName(_settle_payments(tails))


# ---------------------------------------------------------------- G3 allocations

def _own_lines(t, edits: DataFrame, per_line: DataFrame) -> DataFrame:
    """(request_id, shipment_id, line, own) of edits (request_id, shipment_id): every line that the shipment
    holds now, with its quantity, or that any edit of it asks for (own 0)."""
    e = edits.select("request_id", F.col("shipment_id").alias("_esid")).filter("_esid is not null").distinct()
    a = t["shipment_allocations"].select(F.col("shipment_id").alias("_asid"), "export_order_item_id", F.col("quantity").cast(QTY_SUM).alias("_own"))
    ids = e.select("_esid").distinct()
    held = a.join(ids, a["_asid"] == ids["_esid"], "left_semi")
    asked = per_line.join(e, "request_id").select(F.col("_esid").alias("_asid"), "export_order_item_id", F.lit(0).cast(QTY_SUM).alias("_own"))
    lines = held.unionByName(asked).groupBy("_asid", "export_order_item_id").agg(F.sum("_own").cast(QTY_SUM).alias("own"))
    return (e.join(lines, e["_esid"] == lines["_asid"], "inner")
            .select("request_id", F.col("_esid").alias("shipment_id"), "export_order_item_id", "own"))


def admit_shipments(t, requests: DataFrame, exclude_shipment_id: int | None = None, edits: DataFrame | None = None) -> DataFrame:
    """Allocation requests (request_id, client_id, export_order_item_id, quantity, ...), each
    request all-or-nothing, decided in request_id order.

    Reasons, in the original's order (any missing line first, then line by line in id order: foreign
    client, cancelled contract, short).  ``edits`` (request_id, shipment_id) are requests that replace a
    shipment's allocations: its own quantities count as free for that request alone, and are given back
    only if it is accepted.

    Lines on which even the sum of all demands fits are decided at once; requests meeting on the other
    lines are decided in rounds (``_reserve``)."""
    from ledgerloom.operators.fulfilment import allocated_qty

    rq = F.col("requested")
    per_line = (requests.groupBy("request_id", "export_order_item_id")
                .agg(F.sum("quantity").cast(QTY_SUM).alias("requested"), F.max("client_id").alias("client_id")))
    if edits is not None:
        clients = per_line.groupBy("request_id").agg(F.max("client_id").alias("_client"))
        own = _own_lines(t, edits, per_line)
        per_line = (per_line.join(own, ["request_id", "export_order_item_id"], "full").join(clients, "request_id")
                    .select("request_id", "export_order_item_id", F.coalesce(rq, F.lit(0)).cast(QTY_SUM).alias("requested"),
                            F.col("_client").alias("client_id"), rq.isNotNull().alias("asked"), "shipment_id",
                            F.coalesce("own", F.lit(0)).cast(QTY_SUM).alias("own")))
    else:
        per_line = per_line.select("*", F.lit(True).alias("asked"), F.lit(None).cast("bigint").alias("shipment_id"), F.lit(0).cast(QTY_SUM).alias("own"))
    # the demands are read twice and, with their lines, three times below: kept in the shared folder
    per_line = kept(per_line)
    # only the lines that the batch names, with what is left of each
    named = per_line.select(F.col("export_order_item_id").alias("_want")).filter("_want is not null").distinct()
    items = t["export_order_items"].select(F.col("id").alias("_iid"), F.col("export_order_id").alias("_ioid"), F.col("quantity").alias("_qty"))
    items = items.join(named, items["_iid"] == named["_want"], "left_semi")
    orders = t["export_orders"].select(F.col("id").alias("_ooid"), F.col("client_id").alias("_oclient"), F.col("status").alias("_ostatus"))
    a = t["shipment_allocations"]
    alloc = allocated_qty(_with(t, shipment_allocations=a.join(named, a["export_order_item_id"] == named["_want"], "left_semi")),
                          exclude_shipment_id).withColumnRenamed("export_order_item_id", "_aiid")
    lines = (items.join(orders, items["_ioid"] == orders["_ooid"], "inner")
             .join(alloc, F.col("_iid") == F.col("_aiid"), "left")
             .select("_iid", "_oclient", "_ostatus",
                     (F.col("_qty") - F.coalesce(F.col("allocated_quantity"), F.lit(0))).cast(QTY_SUM).alias("_left")))
    j = kept(per_line.join(lines, per_line["export_order_item_id"] == lines["_iid"], "left"))
    release(per_line)
    rank = F.when(F.col("asked"), F.when(F.col("_iid").isNull(), 1).when(F.col("_oclient") != F.col("client_id"), 2)
                  .when(F.col("_ostatus") == "cancelled", 3))
    # per request: a missing line wins; otherwise the first failing line by id
    decided = j.withColumn("_rank", rank).groupBy("request_id").agg(
        F.max("client_id").alias("_rclient"), F.max(F.col("_rank") == 1).alias("_missing"),
        F.min(F.when(F.col("_rank").isNotNull(), F.struct("export_order_item_id", "_rank"))).alias("_first"))
    reason = (F.when(F.col("_missing"), "missing line").when(F.col("_first._rank") == 2, "foreign client")
              .when(F.col("_first._rank") == 3, "cancelled contract"))
    decided = decided.select("request_id", "_rclient", F.coalesce("_missing", F.lit(False)).alias("_missing"),
                             F.col("_first.export_order_item_id").alias("_first_bad"), reason.alias("_reason"))
    decided = kept(decided)
    # a rejected request still says "short" if one of its lines before the failing one is short then
    reaches = F.col("_reason").isNull() | (~F.col("_missing") & (F.col("export_order_item_id") < F.col("_first_bad")))
    # the demands that reach their line, written once: their sums tell which of them to scan
    reaching = kept(j.filter("_iid is not null").join(decided, "request_id").filter(reaches).select(
        F.col("_rclient").alias("client_id"), "request_id", "export_order_item_id", "shipment_id", "requested", "own", "_left", "_reason"))
    release(j)
    demand = reaching.groupBy(F.col("export_order_item_id").alias("_dl")).agg(
        F.sum(F.when(F.col("_reason").isNull(), rq).otherwise(F.lit(0))).alias("_sum"),
        F.max(F.when(F.col("_reason").isNotNull(), rq).otherwise(F.lit(0))).alias("_most"), F.max("_left").alias("_dleft"))
    tight = demand.filter(F.col("_sum") + F.col("_most") > F.col("_dleft") + F.lit(QTY_EPS).cast("decimal(5,4)")).select("_dl")
    rows = kept(reaching.join(tight, reaching["export_order_item_id"] == tight["_dl"], "left_semi").select(
        "client_id", "request_id", "export_order_item_id", "shipment_id",
        # quantities have at most 3 decimals: integer thousandths are exact
        (rq * 1000).cast("bigint").alias("requested"), (F.col("own") * 1000).cast("bigint").alias("own"),
        (F.col("_left") * 1000).cast("bigint").alias("left"), F.col("_reason").alias("static_reason")))
    release(reaching)
    scanned = _reserve(rows, edits is not None)
    in_scan = rows.select("request_id").distinct()
    rest = decided.join(in_scan, "request_id", "left_anti").select(
        "request_id", F.col("_rclient").alias("client_id"), F.when(F.col("_reason").isNull(), "accepted").otherwise("rejected").alias("outcome"),
        F.col("_reason").alias("reason"))
    return rest.unionByName(scanned)


def _reserve(rows: DataFrame, with_edits: bool) -> DataFrame:
    """(request_id, client_id, outcome, reason) of the requests of ``rows``, as if decided one after the other.

    Rows: request_id, client_id, export_order_item_id, shipment_id (edits), requested, own, left (whole
    thousandths), static_reason (the request is refused by a later line anyhow; it never consumes).

    Rounds: on each line, earlier undecided requests take at most the sum of their demands and give back at
    most the sum of what their shipments hold.  A request that fits on all its lines even if all of them take
    is accepted; one that is short on a line even if all of them give back is refused.  The first undecided
    request of all its lines is always decided, and so are all those ahead of the first that may not fit; the
    lines' sums are running sums by chunks of requests, so neither a line nor a chain of lines is one task."""
    # a line's requests are summed in one window, by chunks where there are many
    long_lines = not beyond(rows, "export_order_item_id", 1 << LINE_BLOCK_BITS, "_large").isEmpty()
    state, out, last = rows, None, ()
    while True:
        judged = kept(_judge_requests(state, with_edits, long_lines))
        release(*last)
        done = kept(judged.filter("outcome is not null").select("request_id", "client_id", "outcome", "reason").distinct())
        out = _union(out, done)
        if judged.filter("outcome is null").isEmpty():
            release(judged)
            return out
        state, last = _after_round(judged, with_edits, long_lines), (judged,)


def _earlier(rows: DataFrame, sums: dict[str, str], long_lines: bool) -> DataFrame:
    """The sums of the named columns over the earlier requests of the line (column -> name of its sum)."""
    if not long_lines:
        w = Window.partitionBy("export_order_item_id").orderBy("request_id").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({out: F.coalesce(F.sum(value).over(w), F.lit(0)).cast("bigint") for value, out in sums.items()})
    for value, out in sums.items():
        rows = running_sum(rows, ["export_order_item_id"], ["request_id"], value, out, chunk=[id_block("request_id")], exclusive=True, result_type="bigint")
    return rows


def _judge_requests(state: DataFrame, with_edits: bool, long_lines: bool) -> DataFrame:
    """The undecided rows with the outcome and reason of requests that are certain now (else NULL)."""
    line, need, own = "export_order_item_id", F.col("requested"), F.col("own")
    consumes = F.col("static_reason").isNull()
    if with_edits:
        # of one shipment's edits the first knows what the shipment holds; later ones wait, with the widest bounds
        turn = state.filter("shipment_id is not null").groupBy(F.col("shipment_id").alias("_ts")).agg(F.min("request_id").alias("_turn"))
        most = (state.filter("shipment_id is not null").groupBy(F.col("shipment_id").alias("_ms"), F.col(line).alias("_ml"))
                .agg(F.greatest(F.max("requested"), F.max("own")).alias("_most")))
        state = (state.join(turn, state["shipment_id"] == turn["_ts"], "left")
                 .join(most, (F.col("shipment_id") == F.col("_ms")) & (F.col(line) == F.col("_ml")), "left").drop("_ts", "_ms", "_ml"))
        waits = F.coalesce(F.col("request_id") > F.col("_turn"), F.lit(False))
        takes = F.when(consumes, F.when(waits, need).otherwise(F.greatest(need - own, F.lit(0))))
        gives = F.when(consumes, F.when(waits, F.col("_most")).otherwise(F.greatest(own - need, F.lit(0))))
    else:
        waits, takes, gives = F.lit(False), F.when(consumes, need), None
    state = state.withColumn("_waits", waits).withColumn("_takes", F.coalesce(takes, F.lit(0)).cast("bigint"))
    if gives is not None:
        state = state.withColumn("_gives", F.coalesce(gives, F.lit(0)).cast("bigint"))
    state = _earlier(state, {"_takes": "_taken"} | ({} if gives is None else {"_gives": "_given"}), long_lines)
    low, high = F.col("left") - F.col("_taken"), F.col("left")
    if gives is not None:
        high = high + F.col("_given")
    fits = (need == 0) | (need <= low + own)
    short = (need > 0) & (need > high + own)
    certain = state.groupBy(F.col("request_id").alias("_cr")).agg(
        F.max("_waits").alias("_w"), F.bool_and(fits).alias("_fits"), F.bool_or(short).alias("_short"), F.max("static_reason").alias("_static"))
    outcome = (F.when(F.col("_w"), F.lit(None)).when(F.col("_short"), "rejected")
               .when(F.col("_fits"), F.when(F.col("_static").isNull(), "accepted").otherwise("rejected")))
    certain = certain.select("_cr", outcome.alias("outcome"), F.when(F.col("_short"), "short").otherwise(F.col("_static")).alias("_why"))
    return (state.join(certain, state["request_id"] == certain["_cr"])
            .select("client_id", "request_id", line, "shipment_id", "requested", "own", "left", "static_reason", "outcome",
                    F.when(F.col("outcome").isNotNull(), F.col("_why")).alias("reason")))


def _after_round(judged: DataFrame, with_edits: bool, long_lines: bool) -> DataFrame:
    """The undecided rows with what is left of each line, and what shipments hold, before each request.

    A request may be decided ahead of earlier ones, so only later requests see what it took or gave."""
    accepted = F.coalesce(F.col("outcome") == "accepted", F.lit(False))
    spent = F.when(accepted, F.col("requested") - F.col("own")).otherwise(F.lit(0)).cast("bigint")
    rows = _earlier(judged.withColumn("_spends", spent), {"_spends": "_spent"}, long_lines).drop("_spends")
    taken = judged.filter("outcome = 'accepted'")
    rest = rows.filter("outcome is null").withColumn("left", F.col("left") - F.col("_spent")).drop("outcome", "reason", "_spent")
    if with_edits:
        held = taken.filter("shipment_id is not null").select(F.col("shipment_id").alias("_hs"), F.col("export_order_item_id").alias("_hl"), F.col("requested").alias("_held"))
        rest = (rest.join(held, (F.col("shipment_id") == F.col("_hs")) & (F.col("export_order_item_id") == F.col("_hl")), "left")
                .withColumn("own", F.coalesce("_held", "own")))
    return rest.select("client_id", "request_id", "export_order_item_id", "shipment_id", "requested", "own", "left", "static_reason")


# ---------------------------------------------------------------- G4-G9 state rules

def _first_cancel(rows: DataFrame, key: str) -> DataFrame:
    """Per key the first request that cancels it (rows flagged _cancels); everything later meets a
    cancelled record.  One row per key by partial aggregation, no ordered scan."""
    return (rows.filter("_cancels").groupBy(F.col(key).alias("_ck")).agg(F.min("request_id").alias("_cancelled_at")))


def apply_order_status(t, requests: DataFrame, now) -> DataFrame:
    """Requests (request_id, order_id, status), applied in request_id order to the stored orders.

    Cancelled is terminal: after the first accepted cancellation of an order, only further
    cancellations of it are accepted.  ``current_status`` is what the order had before the batch;
    ``new_status`` what it has after the request."""
    ids = requests.select("order_id")
    o = _of_orders(t["export_orders"], "id", ids)
    confirmed = o["confirmed_at"] if "confirmed_at" in o.columns else F.lit(None).cast("timestamp")
    o = o.select(F.col("id").alias("_oid"), F.col("status").alias("current_status"), confirmed.alias("confirmed_at"))
    near = _with(t, export_order_items=_of_orders(t["export_order_items"], "export_order_id", ids),
                 order_payments=_of_orders(t["order_payments"], "export_order_id", ids))
    active_alloc = allocation_counts(near, active_only=True).withColumnRenamed("export_order_id", "_aoid")
    pays = payment_counts(near).select(F.col("export_order_id").alias("_poid"), "payment_count")
    j = (requests.select("request_id", "order_id", "status").join(o, requests["order_id"] == o["_oid"], "left")
         .join(active_alloc, F.col("order_id") == F.col("_aoid"), "left")
         .join(pays, F.col("order_id") == F.col("_poid"), "left"))
    allocated, paid = F.coalesce("allocation_count", F.lit(0)) > 0, F.coalesce("payment_count", F.lit(0)) > 0
    j = j.withColumn("_cancels", F.col("_oid").isNotNull() & (F.col("status") == "cancelled") & ~allocated & ~paid
                     & (F.col("current_status") != "cancelled"))
    # what orders hold is joined once, in tasks of its own; the batch is read three times below
    j = kept(j)
    first = _first_cancel(j, "order_id")
    j = j.join(first, j["order_id"] == first["_ck"], "left")
    is_cancelled = (F.col("current_status") == "cancelled") | F.coalesce(F.col("request_id") > F.col("_cancelled_at"), F.lit(False))
    cancelling = (F.col("status") == "cancelled") & ~is_cancelled
    reason = (F.when(F.col("_oid").isNull(), "order not found")
              .when(is_cancelled & (F.col("status") != "cancelled"), "a cancelled order cannot be reopened")
              .when(cancelling & allocated, "active shipment allocations")
              .when(cancelling & paid, "recorded payments"))
    j = j.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).withColumn("_cancelled", is_cancelled)
    # a refused request leaves the order as the last accepted one made it
    before = _status_before(kept(j), "order_id")
    confirms = F.col("accepted") & (F.col("status") == "confirmed")
    return before.select("request_id", "order_id", F.col("status").alias("requested_status"), "current_status", "accepted", "reason",
                         F.when(F.col("_oid").isNull(), F.lit(None)).when(F.col("accepted"), F.col("status"))
                         .when(F.col("_cancelled"), F.lit("cancelled")).otherwise(F.coalesce("_before", "current_status")).alias("new_status"),
                         F.when(confirms & F.col("confirmed_at").isNull(), F.lit(now).cast("timestamp")).otherwise(F.col("confirmed_at")).alias("confirmed_at"))


def _status_before(rows: DataFrame, key: str) -> DataFrame:
    """Add _before: the status of the last accepted request of the key before this one.

    Windows per block of request ids, and the last accepted status of the earlier blocks."""
    rows = rows.withColumn("_blk", id_block("request_id")).withColumn("_set", F.when(F.col("accepted"), F.col("status")))
    inside = Window.partitionBy(key, "_blk").orderBy("request_id").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.filter("accepted").groupBy(F.col(key).alias("_ek"), F.col("_blk").alias("_eb")).agg(F.max_by("status", "request_id").alias("_end"))
    starts = rows.select(F.col(key).alias("_ek"), F.col("_blk").alias("_eb")).distinct().join(ends, ["_ek", "_eb"], "left")
    earlier = Window.partitionBy("_ek").orderBy("_eb").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_ek", "_eb", F.last("_end", ignorenulls=True).over(earlier).alias("_start"))
    rows = rows.withColumn("_in", F.last("_set", ignorenulls=True).over(inside))
    return (rows.join(starts, (F.col(key) == F.col("_ek")) & (F.col("_blk") == F.col("_eb")), "left")
            .withColumn("_before", F.coalesce("_in", "_start")))


def order_status_table(t, requests: DataFrame, now) -> DataFrame:
    """G4 (write): the orders after the batch, with the status of each order's last accepted request."""
    o = t["export_orders"]
    if "confirmed_at" not in o.columns:
        o = o.withColumn("confirmed_at", F.lit(None).cast("timestamp"))
    done = apply_order_status(t, requests, now).filter("accepted")
    patch = done.groupBy(F.col("order_id").alias("id")).agg(F.max_by("requested_status", "request_id").alias("status"),
                                                            F.max("confirmed_at").alias("confirmed_at"))
    return update_by_key(o, patch, ["id"], ["status", "confirmed_at"])[0]


def check_order_edits(t, requests: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Edit requests (request_id, order_id, client_id, advance_percentage [, proposed items]).

    Without proposed items the current items are kept (revised total = current total)."""
    t = requested_orders(t, requests)
    o = t["export_orders"].select(F.col("id").alias("_oid"), F.col("status").alias("_status"),
                                  F.col("client_id").alias("_client"))
    allocs = allocation_counts(t).withColumnRenamed("export_order_id", "_aoid")
    pays = payment_counts(t).withColumnRenamed("export_order_id", "_poid")
    if items is not None:
        rev = revised_totals(items).withColumnRenamed("request_id", "_rrid")
        rev_join = F.col("request_id") == F.col("_rrid")
    else:
        rev = order_totals(t, ["id"]).select(F.col("id").alias("_rrid"), F.col("order_total").alias("revised_total"))
        rev_join = F.col("order_id") == F.col("_rrid")
    j = (requests.join(o, requests["order_id"] == o["_oid"], "left")
         .join(allocs, F.col("order_id") == F.col("_aoid"), "left")
         .join(pays, F.col("order_id") == F.col("_poid"), "left")
         .join(rev, rev_join, "left"))
    total = F.coalesce(F.col("revised_total"), F.lit(0)).cast("decimal(24,7)")
    adv = F.round(total * F.col("advance_percentage").cast("decimal(5,2)") * F.lit("0.01").cast("decimal(3,2)"), 2)
    recv = F.coalesce(F.col("additional_received"), F.lit(0))
    reason = (F.when(F.col("_oid").isNull(), "order not found")
              .when(F.col("_status").isin("shipped", "completed", "cancelled"),
                    "shipped, completed or cancelled orders cannot be edited")
              .when(F.coalesce("allocation_count", F.lit(0)) > 0, "has shipment allocations")
              .when((F.coalesce("payment_count", F.lit(0)) > 0) & (F.col("client_id") != F.col("_client")),
                    "client fixed once paid")
              .when(adv + recv - total > money_eps(), "received payments would exceed the total"))
    return j.select("request_id", "order_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def check_order_deletes(t, ids: DataFrame) -> DataFrame:
    """Ids (order_id) -> deletable unless shipped/completed, allocated (any status) or paid."""
    t = requested_orders(t, ids)
    o = t["export_orders"].select(F.col("id").alias("_oid"), F.col("status").alias("_status"))
    allocs = allocation_counts(t).withColumnRenamed("export_order_id", "_aoid")
    pays = payment_counts(t).withColumnRenamed("export_order_id", "_poid")
    j = (ids.join(o, ids["order_id"] == o["_oid"], "left")
         .join(allocs, F.col("order_id") == F.col("_aoid"), "left")
         .join(pays, F.col("order_id") == F.col("_poid"), "left"))
    reason = (F.when(F.col("_oid").isNull(), "order not found")
              .when(F.col("_status").isin("shipped", "completed"), "shipped or completed")
              .when(F.coalesce("allocation_count", F.lit(0)) > 0, "has shipment allocations")
              .when(F.coalesce("payment_count", F.lit(0)) > 0, "has recorded payments"))
    return j.select("order_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def apply_shipment_status(t, requests: DataFrame) -> DataFrame:
    """Requests (request_id, shipment_id, status) in request_id order; cancelled is terminal, also
    within the batch, anything else allowed."""
    s = t["shipments"].select(F.col("id").alias("_sid"), F.col("status").alias("current_status"))
    j = requests.select("request_id", "shipment_id", "status").join(s, requests["shipment_id"] == s["_sid"], "left")
    j = j.withColumn("_cancels", F.col("_sid").isNotNull() & (F.col("status") == "cancelled"))
    first = _first_cancel(j, "shipment_id")
    j = j.join(first, j["shipment_id"] == first["_ck"], "left")
    is_cancelled = (F.col("current_status") == "cancelled") | F.coalesce(F.col("request_id") > F.col("_cancelled_at"), F.lit(False))
    reason = (F.when(F.col("_sid").isNull(), "shipment not found")
              .when(is_cancelled & (F.col("status") != "cancelled"), "a cancelled shipment cannot be reopened"))
    return j.select("request_id", "shipment_id", "current_status", F.col("status").alias("requested_status"),
                    reason.isNull().alias("accepted"), reason.alias("reason"),
                    F.when(reason.isNull(), F.col("status")).when(is_cancelled, F.lit("cancelled")).otherwise(F.col("current_status")).alias("new_status"))


def shipment_status_table(t, requests: DataFrame) -> DataFrame:
    """G7 (write): the shipments after the batch."""
    done = apply_shipment_status(t, requests).filter("accepted")
    patch = done.groupBy(F.col("shipment_id").alias("id")).agg(F.max_by("requested_status", "request_id").alias("status"))
    return update_by_key(t["shipments"], patch, ["id"], ["status"])[0]


def check_shipment_changes(shipments: DataFrame) -> DataFrame:
    """Per shipment — editable (draft/ready), gate pass editable (not shipped/completed/cancelled),
    deletable (not shipped/completed)."""
    s = F.col("status")
    return shipments.select("id", "status",
                            s.isin("draft", "ready_to_ship").alias("can_edit"),
                            (~s.isin("shipped", "completed", "cancelled")).alias("can_edit_gate_pass"),
                            (~s.isin("shipped", "completed")).alias("can_delete"))


def check_account_deletes(t, ids: DataFrame) -> DataFrame:
    """An account (account_id) cannot be deleted while any order uses it."""
    used = account_usage(t)
    j = ids.join(used, ids["account_id"] == used["bank_account_id"], "left")
    return j.select("account_id", F.coalesce("contract_count", F.lit(0)).alias("contract_count"),
                    (F.coalesce("contract_count", F.lit(0)) == 0).alias("accepted"))
