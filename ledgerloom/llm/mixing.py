"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in id order, are cut into blocks of about ``BLOCK_CHARS`` characters (a
document belongs to the block in which it starts).  Target weights become whole shares of a period, so
fine that rounding moves no source by more than 2 ** -20 of a block over all slots (``fine_quanta``);
block ``c`` (from 0) of a source with share w of a period W is released at slot floor(c W / w) and due
by slot ceil((c + 1) W / w).  Earliest deadline first over released blocks meets every deadline, so
after every slot each source has had its share to within less than one block.

When a source runs out the others go on: from that slot a new plan starts with the shares of the
sources that are left.  No document is dropped or repeated.

Documents are summed, numbered and given their slots by DataFrame and SQL functions only.  The plan
itself is sequential: the driver makes it from one row per source (``plan``), in a time that grows with
blocks x log(sources), and sends back the slots of each run of ``PLAN_BLOCKS`` blocks.

Defined cases: a null source is a source of its own; null or negative n_chars count as 0 characters; a
null doc_id is ordered by a hash of its other columns; equal ids are ordered by size; sources without
a given target get one quantum; an empty table gives an empty result; any number of sources is mixed
with ``most_sources=None`` (as the registered queries do); a caller who leaves it at ``MOST_SOURCES``
is told of more by a ``ValueError``.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_right
from collections.abc import Mapping, Sequence
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

BLOCK_CHARS = 1 << 17
#: Least number of quanta that the shares are rounded to, and the exponent of sizes where no targets are given.
QUANTA = 1000
TEMPER = 0.5
MOST_SOURCES = 256
#: Blocks in one row of the plan, and the most blocks of a plan that is broadcast (16 bytes each).
PLAN_BLOCKS = 1 << 10
BROADCAST_BLOCKS = 1 << 19
RESULT = ("_slot", "_start", "block", "share", "period")
#: Documents are numbered within chunks of ids, chunks within groups (see ``running_start``).
CHUNK_BITS = (10, 14, 20)


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


class Fresh:
    """Sources without a block in this phase, by falling share; the least number among the first few."""

    def __init__(self, shares: Sequence[int]):
        self.order = sorted(range(len(shares)), key=lambda i: -shares[i])
        self.place = [0] * len(shares)
        for at, i in enumerate(self.order):
            self.place[i] = at
        self.falling = [-shares[i] for i in self.order]
        self.none = len(shares)
        self.width = 1 << max(0, len(shares) - 1).bit_length()
        self.tree = [self.none] * self.width + self.order + [self.none] * (self.width - len(shares))
        for at in range(self.width - 1, 0, -1):
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])

    def put(self, i: int, there: bool) -> None:
        at = self.width + self.place[i]
        self.tree[at] = i if there else self.none
        while at > 1:
            at //= 2
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])

    def earliest(self, period: int) -> tuple[int, int] | None:
        """(deadline of the first block, number) of the source that is due first."""
        if self.tree[1] == self.none:
            return None
        at = 1
        while at < self.width:
            at = 2 * at if self.tree[2 * at] < self.none else 2 * at + 1
        due = -(period // self.falling[at - self.width])
        # All with a share of period / due or more are due by the same slot.
        low, high, least = self.width, self.width + bisect_right(self.falling, period // -due), self.none
        while low < high:
            if low & 1:
                least = min(least, self.tree[low])
                low += 1
            if high & 1:
                high -= 1
                least = min(least, self.tree[high])
            low //= 2
            high //= 2
        return due, least


def schedule(shares: Sequence[int], blocks: Sequence[int]) -> tuple[list[array], list[array]]:
    """Slot and period of each block of each source by earliest deadline first (ties: the first source)."""
    slots, periods = [array("q") for _ in shares], [array("q") for _ in shares]
    fresh, period, begin = Fresh(shares), sum(shares), 0
    had, used, waiting, ready = [0] * len(shares), [], [], []
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot - begin:
            i = heappop(waiting)[1]
            heappush(ready, (-(-(had[i] + 1) * period // shares[i]), i))
        first = fresh.earliest(period)
        if first is None or ready and ready[0] < first:
            i = heappop(ready)[1]
        else:
            i = first[1]
            fresh.put(i, False)
            used.append(i)
        slots[i].append(slot)
        periods[i].append(period)
        had[i] += 1
        if len(slots[i]) < blocks[i]:
            heappush(waiting, (had[i] * period // shares[i], i))
            continue
        # This source has run out: a new plan for the others.
        period, begin = period - shares[i], slot + 1
        for j in used:
            had[j] = 0
            if j != i:
                fresh.put(j, True)
        used, waiting, ready = [], [], []
    return slots, periods


def fine_quanta(sources: int, blocks: int, least: int) -> int:
    """Quanta by which rounding moves a source by 2 ** -20 blocks at most over all slots (2 ** 52 is all of a double)."""
    return max(least, min(blocks * (sources + 1) << 20, 1 << 52))


def plan(sources: Sequence[Row], quanta: int) -> list[tuple]:
    """(key, run, last, share, slots, periods) of sources (key, weight, blocks): a row for each run of blocks.

    Block ``last`` is repeated once, for documents without characters after the end of the last block.
    """
    sources = sorted(sources, key=lambda r: r["key"].encode())
    blocks = [r["blocks"] for r in sources]
    weight = math.fsum(r["weight"] for r in sources) or 1.0
    quanta = fine_quanta(len(sources), sum(blocks), quanta)
    shares = [max(round(r["weight"] / weight * quanta), 1) for r in sources]
    rows = []
    for r, share, slots, periods in zip(sources, shares, *schedule(shares, blocks)):
        slots.append(slots[-1])
        periods.append(periods[-1])
        for first in range(0, len(slots), PLAN_BLOCKS):
            part = slice(first, first + PLAN_BLOCKS)
            rows.append((r["key"], first // PLAN_BLOCKS, r["blocks"] - 1, share, slots[part].tolist(), periods[part].tolist()))
    return rows


def running_start(rows: DataFrame, key: str, place: str, value: str, out: str, bits: tuple[int, ...] = CHUNK_BITS) -> DataFrame:
    """Add the sum of ``value`` over the rows before this one of the same key, in ``place`` order.

    Rows are summed within chunks of ``2 ** bits[0]`` places, chunks within groups and so on, so that a
    key with most of the rows is spread over its chunks; every level is one shuffle, of partial sums
    above the first.  Rows of one place are ordered by value.
    """
    chunk = f"_{out}_chunk{len(bits)}"
    if not bits:
        return rows.withColumn(out, F.coalesce(F.sum(value).over(Window.partitionBy(key).orderBy(place, value).rowsBetween(Window.unboundedPreceding, -1)), _long(0)))
    rows = rows.withColumn(chunk, F.shiftright(place, bits[0]))
    sums = rows.groupBy(key, chunk).agg(F.sum(value).alias("_sum"))
    starts = running_start(sums, key, chunk, "_sum", "_before", bits[1:]).select(F.col(key).alias("_k"), F.col(chunk).alias("_c"), F.col("_before").alias("_offset"))
    order = Window.partitionBy(key, chunk).orderBy(place, value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum(value).over(order), _long(0)))
    return (rows.join(starts, (F.col(key) == F.col("_k")) & (F.col(chunk) == F.col("_c")))
            .withColumn(out, F.col(out) + F.col("_offset")).drop("_k", "_c", "_offset", chunk))


def mix(docs: DataFrame, targets: Mapping[str, float] | None = None, block_chars: int = BLOCK_CHARS, quanta: int = QUANTA,
        temper: float = TEMPER, most_sources: int | None = MOST_SOURCES) -> DataFrame:
    """The documents with _slot, _start, block, share and period; ``(_slot, _start, doc_id)`` is the mixed order.

    ``most_sources``: raise ``ValueError`` for more, None for any number.  ``targets``: weight by source; without it a source's weight is its size to the power ``temper``.
    Other columns of ``docs`` are carried along; those named like a result column give way to it.
    """
    rows = _placed(docs, targets, block_chars, quanta, temper, most_sources)
    kept = [c for c in docs.columns if c not in RESULT]
    return rows.select(*[F.col("_mix_row").getField(c).alias(c) for c in kept], *RESULT)


def _placed(docs: DataFrame, targets: Mapping[str, float] | None, block_chars: int, quanta: int, temper: float,
            most_sources: int | None) -> DataFrame:
    """_mix_row (the whole row, so that no column name can clash), _mix_id and the result columns."""
    order_id = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("source", "n_chars", *[c for c in ("lang",) if c in docs.columns]))
    key = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    size = F.greatest(F.coalesce(F.col("n_chars").cast("long"), _long(0)), _long(0))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_row"), key.alias("_mix_key"), size.alias("_mix_size"),
                       order_id.alias("_mix_place"), F.col("doc_id").alias("_mix_id"))
    totals = base.groupBy(F.col("_mix_key").alias("key")).agg(F.sum("_mix_size").alias("chars"))
    if targets is None:
        weight = F.pow(F.greatest(F.col("chars"), _long(1)).cast("double"), F.lit(temper))
    else:
        given = F.create_map(*[F.lit(x) for name, v in targets.items() for x in (f"s{name}", float(v))]) if targets else F.expr("cast(map() as map<string,double>)")
        weight = F.coalesce(F.element_at(given, F.col("key")), F.lit(0.0))
    whole = totals.withColumn("weight", weight)
    # One small row per source.
    sources = whole.select("key", "weight", F.greatest(F.ceil(F.col("chars") / block_chars), _long(1)).alias("blocks")).collect()
    if most_sources is not None and len(sources) > most_sources:
        raise ValueError(f"{len(sources)} sources; at most {most_sources} are allowed")
    runs = docs.sparkSession.createDataFrame(
        plan(sources, quanta), "_mix_plan string, _mix_run long, _mix_last long, share long, _mix_slots array<long>, _mix_periods array<long>", verifySchema=False)
    if sum(r["blocks"] for r in sources) <= BROADCAST_BLOCKS:
        runs = F.broadcast(runs)
    rows = running_start(base, "_mix_key", "_mix_place", "_mix_size", "_start")
    rows = rows.withColumn("_mix_block", F.floor(F.col("_start") / block_chars))
    rows = rows.join(runs, (F.col("_mix_key") == F.col("_mix_plan")) & (F.floor(F.col("_mix_block") / PLAN_BLOCKS) == F.col("_mix_run")))
    at = (F.col("_mix_block") % PLAN_BLOCKS).cast("int")
    return rows.select("_mix_row", "_mix_id", F.get("_mix_slots", at).alias("_slot"), "_start", F.least("_mix_block", "_mix_last").alias("block"), "share",
                       F.get("_mix_periods", at).alias("period"))


def mixed(docs: DataFrame, targets: Mapping[str, float] | None = None, block_chars: int = BLOCK_CHARS, quanta: int = QUANTA,
          temper: float = TEMPER, most_sources: int | None = MOST_SOURCES) -> DataFrame:
    """The same rows and columns, sorted in the mixed order."""
    rows = _placed(docs, targets, block_chars, quanta, temper, most_sources)
    return rows.orderBy("_slot", "_start", F.col("_mix_id").asc_nulls_last()).select(*[F.col("_mix_row").getField(c).alias(c) for c in docs.columns])
