"""Shards of equal row counts that keep linked documents together: balanced label propagation.

Documents of one group (here: equal texts) are linked to one another.  Linked documents start spread evenly
over the shards.  In each round every linked document looks at the shards of its group's members and wants
to move to the one that holds most of them, among the shards that can take the whole group; a group that
fits nowhere takes the shards with most seats for it (its members there and the room), as few as seat it.  A
shard has a quota: those that want to move in are taken by falling size of their groups, group by group, as
long as their number fits into the room.  Rounds end when nobody moves.  Documents without a link have no
wish: they fill what the linked ones leave, so that row counts are at most one apart (law ``rows``).

A group of any size is spread over many tasks: votes are counts that every task sums before they are
shuffled, and its shards go out to its members in as many copies as it has salts.  The driver holds a few numbers per shard.  Each round
is a written table of the shared folder.  Everything that touches rows is DataFrame and SQL functions.

When nearly all documents are linked there is no room to move through; the shards may then hold up to
``SLACK`` more during the rounds, and what is over the quota at the end (smallest groups first) is placed
with the documents without a link.

Texts are known by a 64-bit hash, their CRC-32 and their size.  Defined cases: a null text is the empty
text; rows with a null or repeated doc_id are documents each; a table with fewer rows than shards leaves
shards empty; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.columns import pick
from ledgerloom.operators.positions import stored, with_position

SHARDS = 16
ROUNDS = 12
#: Copies of a large group's votes, and the room beyond the quotas where no unlinked documents give room.
SALTS = 64
SLACK = 0.05
#: Steps of the order in which wishes are granted: sizes (powers of two), groups, members.
_SIZES, _GROUPS, _STEP_BITS = 40, 16, 10


def _numbers(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _per_shard(rows: DataFrame, shards: int) -> list[int]:
    """Rows of each shard: one small row per shard."""
    found = {r.shard: r.n for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _wishes(state: DataFrame, group: list[str], room: list[int], number: int) -> DataFrame:
    """Every linked document with the shard that it wants (its own: to stay) and its place in the order of moves."""
    shards = len(room)
    votes = state.groupBy(*group).agg(F.first("group_docs").alias("_docs"), F.array(*[F.count_if(F.col("shard") == s) for s in range(shards)]).alias("_votes"))
    # Equal votes are told apart by a hash of group and shard, so that a group's members agree.
    seats = [F.struct((F.get("_votes", F.lit(s)) + F.lit(int(room[s]))).alias("seats"), F.get("_votes", F.lit(s)).alias("votes"),
                      F.xxhash64(*group, F.lit(s)).alias("tie"), F.lit(s).alias("shard")) for s in range(shards)]
    votes = votes.withColumn("_seats", F.array(*seats))
    # One shard for all where there is one with seats enough: the one with most of the members.
    whole = F.array_max(F.transform(F.filter("_seats", lambda o: o["seats"] >= F.col("_docs")), lambda o: F.struct(o["votes"], o["tie"], o["shard"])))
    # A larger group takes the shards with most seats for it until all are seated.
    most_first = F.reverse(F.array_sort("_seats"))
    filled = F.aggregate(most_first, F.struct(F.lit(0).cast("long").alias("seats"), F.array().cast("array<int>").alias("shards")),
                         lambda a, o: F.when(a["seats"] >= F.col("_docs"), a).otherwise(
                             F.struct((a["seats"] + o["seats"]).alias("seats"), F.concat(a["shards"], F.array(o["shard"])).alias("shards"))))
    votes = votes.select(*group, "_docs", F.when(whole.isNotNull(), F.array(whole["shard"])).otherwise(filled["shards"]).alias("_homes"))
    copies = votes.select(*group, "_homes", F.explode(F.sequence(F.lit(0), (F.least("_docs", F.lit(SALTS)) - 1).cast("int"))).alias("salt"))
    # Members from outside spread over the group's shards by the room there.
    ends = F.transform("_homes", lambda s, i: F.aggregate(F.slice("_homes", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + F.get(_numbers(room), x)))
    draw = F.pmod(F.xxhash64("_row", F.lit(number), F.lit("home")), F.greatest(F.element_at("_ends", -1), F.lit(1).cast("long")))
    home = F.get("_homes", F.size(F.filter("_ends", lambda end: end <= F.col("_draw"))))
    wish = (state.join(copies, [*group, "salt"]).withColumn("_ends", ends).withColumn("_draw", draw)
            .withColumn("target", F.when(F.array_contains("_homes", F.col("shard")), F.col("shard")).otherwise(F.coalesce(home, F.col("shard")))))
    size = F.least(F.floor(F.log2(F.col("group_docs").cast("double"))).cast("int"), F.lit(_SIZES - 1))
    steps = F.lit(1 << _STEP_BITS)
    member = F.pmod(F.xxhash64("_row", F.lit(number)), F.least(F.col("group_docs"), steps))
    place = ((F.lit(_SIZES - 1) - size) * _GROUPS + F.pmod(F.xxhash64(*group, F.lit(number)), F.lit(_GROUPS))) * steps + member
    return wish.select(*state.columns, "target", F.when(F.col("target") != F.col("shard"), place).cast("int").alias("place"))


def _granted(wishes: DataFrame, room: list[int]) -> dict[int, int]:
    """The last place of those that may move to each shard (shards that nobody may move to are left out)."""
    asked = wishes.filter("target <> shard").groupBy("target", "place").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("target").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    fitting = asked.withColumn("total", F.sum("n").over(order)).filter(F.col("total") <= F.get(_numbers(room), F.col("target")))
    return {r.target: r.place for r in fitting.groupBy("target").agg(F.max("place").alias("place")).collect()}


def propagate(linked: DataFrame, group: list[str], limits: list[int], rounds: int) -> tuple[DataFrame, list[int]]:
    """Linked rows (with shard, group_docs, salt, _row) after the rounds, and the rows of each shard."""
    state, load, idle = linked, _per_shard(linked, len(limits)), 0
    for number in range(rounds):
        room = [max(limit - n, 0) for limit, n in zip(limits, load)]
        wishes = stored(_wishes(state, group, room, number), "shard-wishes")
        last = _granted(wishes, room)
        idle = 0 if last else idle + 1
        if idle == 2:
            break
        until = _numbers([last.get(s, -1) for s in range(len(limits))])
        moves = (F.col("target") != F.col("shard")) & (F.col("place") <= F.get(until, F.col("target")))
        state = wishes.withColumn("shard", F.when(moves, F.col("target")).otherwise(F.col("shard"))).drop("target", "place")
        load = _per_shard(state, len(limits))
    return state, load


def shard(rows: DataFrame, group: Sequence[str], shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """The rows with shard, slot (from 0 within the shard) and group_docs; ``group``: the columns that link rows.

    Rows with a null in a group column are linked to nothing.
    """
    group, carried = list(group), rows.columns
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    counts = rows.dropna(subset=group).groupBy(*group).agg(F.count(F.lit(1)).alias("group_docs")).filter("group_docs > 1")
    sized = stored(_with_counts(rows, counts, group), "shard-sized")
    linked, free = sized.filter("group_docs > 1"), sized.filter("group_docs = 1")
    total, singles = sized.count(), free.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    slack = -(-max(0, int(SLACK * total) - singles) // shards)
    start = with_position(linked.withColumn("salt", F.pmod(F.xxhash64("_row", F.lit(-1)), F.least("group_docs", F.lit(SALTS))).cast("int")))
    start = start.withColumn("shard", (F.col("position") % shards).cast("int")).drop("position")
    state, load = propagate(start, group, [q + slack for q in quotas], rounds)
    # Linked rows in order of shard, large groups first: what is over a shard's quota goes to the free ones.
    placed = with_position(state, F.col("shard"), F.col("group_docs").desc(), *map(F.col, group), F.col("_row"))
    firsts = [0, *accumulate(load)][:shards]
    placed = placed.withColumn("slot", F.col("position") - F.get(_numbers(firsts), F.col("shard"))).drop("position", "salt")
    stays = F.col("slot") < F.get(_numbers(quotas), F.col("shard"))
    kept = [min(n, q) for n, q in zip(load, quotas)]
    pool = with_position(free.select(*carried, "group_docs").unionByName(placed.filter(~stays).select(*carried, "group_docs")))
    ends = list(accumulate(q - k for q, k in zip(quotas, kept)))
    pool = pool.withColumn("shard", F.size(F.filter(_numbers(ends), lambda end: end <= F.col("position"))))
    before = _numbers([k - first for k, first in zip(kept, [0, *ends])])
    pool = pool.withColumn("slot", F.col("position") + F.get(before, F.col("shard"))).drop("position")
    columns = [*carried, "shard", "slot", "group_docs"]
    return placed.filter(stays).select(*columns).unionByName(pool.select(*columns))


def _with_counts(rows: DataFrame, counts: DataFrame, group: list[str]) -> DataFrame:
    """Add group_docs (1: linked to nothing) without bringing a large group's rows together.

    Rows are dealt by group and a salt; a group's count is copied to the salts that its rows have.
    """
    salt = F.pmod(F.xxhash64("_row", F.lit(-2)), F.lit(SALTS)).cast("int")
    salted = rows.withColumn("_salt", salt)
    present = salted.dropna(subset=group).select(*group, "_salt").distinct().join(counts, group)
    return salted.join(present, [*group, "_salt"], "left").withColumn("group_docs", F.coalesce("group_docs", F.lit(1).cast("long"))).drop("_salt")


def shard_texts(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_docs of every (doc_id, text); links: equal texts."""
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, {"doc_id": "long", "text": "string"}).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    out = shard(rows, ["text_hash", "text_crc32", "size"], shards, rounds)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "group_docs")
