"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns virtual nodes on a ring of 2**16 places. A key hashes to a place and goes to the first shard clockwise
that is not full. Keys arrive in the order of a hash of the key, so that the outcome depends on the rows alone, not on
their order or partitions. With capacities that add up to the number of rows the counts differ by one at most.

The arrival order makes a shard fill up at one moment, and at most as many moments exist as shards. They are found one
after another from histograms of arrival numbers (bounded by HISTOGRAM_CELLS a shard); the rows never leave their tasks.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphprep.llm.common import materialize, ranked

PLACES = 1 << 16
HISTOGRAM_CELLS = 1024
#: Arrival numbers that the driver may hold at once while it looks for the moment at which a shard is full.
DRIVER_ROWS = 50_000
#: Rows numbered by one task.
RANK_ROWS = 200_000


def ring_orders(shards: int, vnodes: int = 128, seed: int = 7) -> list[list[int]]:
    """For each place of the ring the shards in the order in which they are met clockwise."""
    taken: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at, turn = xxhash.xxh64_intdigest(f"{s}/{v}", seed) % PLACES, 0
            while at in taken:
                turn += 1
                at = xxhash.xxh64_intdigest(f"{s}/{v}/{turn}", seed) % PLACES
            taken[at] = s
    spots = sorted(taken)
    by_spot: list[list[int]] = []
    for i in range(len(spots)):
        order: list[int] = []
        for j in range(len(spots)):
            s = taken[spots[(i + j) % len(spots)]]
            if s not in order:
                order.append(s)
                if len(order) == shards:
                    break
        by_spot.append(order)
    return [by_spot[bisect.bisect_left(spots, place) % len(spots)] for place in range(PLACES)]


def assign(docs: DataFrame, shards: int = 8, vnodes: int = 128, seed: int = 7, capacities: list[int] | None = None) -> DataFrame:
    """Place every row of docs (doc_id, text) in a shard: rows (doc_id, size, text_crc32, arrival, shard, slot).

    capacities: most rows of each shard; by default as equal as can be, so that every shard ends up full and counts
    differ by one at most. Their sum must be at least the number of rows.
    A null text counts as empty (size 1, checksum 0); a null doc_id is a key like any other. Rows with equal doc_id
    share a place on the ring and differ in arrival; equal rows are numbered and interchangeable. Other columns of docs
    are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # Equal rows are counted before they are shuffled, then spread out again with a number each.
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    rows = materialize(rows.withColumn("_turn", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("_copy"))), "shard-rows")
    total = rows.count()
    if capacities is None:
        capacities = [total // shards + (s < total % shards) for s in range(shards)]
    if len(capacities) != shards or sum(capacities) < total:
        raise ValueError("capacities: one a shard, and room for all rows")
    bits = max(0, min(24, (max(1, total // RANK_ROWS)).bit_length()))
    part = F.shiftrightunsigned(F.col("_turn"), 64 - bits) if bits else F.lit(0).cast("long")
    order = ["_turn", "doc_id", "size", "text_crc32", "_copy"]
    rows = ranked(rows, [], order, part, "arrival")
    orders = ring_orders(shards, vnodes, seed)
    ring = spark.createDataFrame(list(enumerate(orders)), "_place int, _order array<int>")
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(PLACES)).cast("int")
    rows = materialize(rows.withColumn("_place", place).drop("_turn", "_copy"), "shard-arrivals")
    keyed = rows.join(F.broadcast(ring), "_place")  # the ring has PLACES rows whatever the input

    #: The arrival number from which on a shard takes no more rows.
    full_at = [0 if c == 0 else total for c in capacities]
    left = list(capacities)
    start = 0

    def shard_of() -> F.Column:
        ends = F.array(*[F.lit(x) for x in full_at])
        return F.element_at(F.filter("_order", lambda s: F.col("arrival") < F.element_at(ends, s + 1)), 1)

    open_shards = {s for s in range(shards) if capacities[s] > 0}
    while start < total and len(open_shards) > 1:
        lo, hi, before = start, total, dict.fromkeys(open_shards, 0)
        current = keyed.where(F.col("arrival") >= start).withColumn("_shard", shard_of())
        while True:
            span = current.where((F.col("arrival") >= lo) & (F.col("arrival") < hi))
            if hi - lo <= DRIVER_ROWS:
                moment = None
                for r in sorted(map(tuple, span.select("arrival", "_shard").collect())):
                    before[r[1]] += 1
                    if before[r[1]] == left[r[1]]:
                        moment = r[0]
                        break
                break
            width = -(-(hi - lo) // HISTOGRAM_CELLS)
            cells: dict[int, dict[int, int]] = {}
            for c, s, n in span.groupBy(((F.col("arrival") - lo) / width).cast("int").alias("c"), "_shard").count().collect():
                cells.setdefault(c, {})[s] = n
            moment, hit = None, None
            for c in sorted(cells):
                if any(before[s] + n >= left[s] for s, n in cells[c].items()):
                    hit = c
                    break
                for s, n in cells[c].items():
                    before[s] += n
            if hit is None:
                break
            lo, hi = lo + hit * width, min(hi, lo + (hit + 1) * width)
        if moment is None:  # capacities with room to spare: nobody fills up any more
            break
        full = next(s for s in sorted(open_shards) if before[s] == left[s])
        for s in open_shards:
            left[s] -= before[s]
        full_at[full] = moment + 1
        open_shards.discard(full)
        start = moment + 1
    placed = materialize(keyed.withColumn("shard", shard_of()).select("doc_id", "size", "text_crc32", "arrival", "shard"), "shard-placed")
    return ranked(placed, ["shard"], ["arrival"], F.floor(F.col("arrival") / RANK_ROWS), "slot")
