"""Packing of token sequences into fixed windows by linear grouping, configurations and best fit.

1. A histogram of piece lengths (at most `window` cells) goes to the driver. Lengths over window // SMALL_PART are large.
2. Linear grouping: the large pieces, longest first, are cut into groups of equal cardinality; every length counts as the
   longest of its group, so that only GROUPS sizes are left.
3. Configurations (how many pieces of each size share a window) are chosen by column generation: a simplex over the sizes
   and a knapsack for the next columns. The rounded-down solution is kept.
4. Each place of a configuration is given to an actual piece of its group by rank, which frees what rounding had added.
   The pieces of a group beyond its places, its shortest ones, join the small pieces.
5. Repair: windows that the actual pieces leave with more than a number of free tokens are opened again, and their pieces
   join the small ones too. The number is the one of FREE that needs the fewest windows, and of those the largest; windows
   that are exactly full always stay as configured.
6. The small pieces and those that joined them go by best fit, longest first, into what is left of the windows; then into
   new windows.

Steps 1 to 3, 5 and the plan of 6 work on counts by length and by space left, whatever the number of documents; the pieces
themselves are numbered and joined to the plan in parallel. The driver's arithmetic calls no threaded library routine.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphprep.llm.common import materialize, ranked

WINDOW = 2048
#: Pieces of at most this share of a window are small.
SMALL_PART = 6
GROUPS = 128
#: Column generation stops when no more than this share of the windows could be saved.
GAP = 5e-4
#: Columns taken from one knapsack table.
COLUMNS = 24
#: Free tokens beyond which the repair may open windows again; the first stands for any.
FREE = (1 << 62, 256, 128, 64, 48, 32, 24, 16, 12, 8, 6, 4, 3, 2, 1, 0)
#: Rows of one length that one task numbers.
RANK_ROWS = 10_000


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots, a row operation at a time."""
    n = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        top = k + int(np.argmax(np.abs(both[k:, k])))
        if top != k:
            both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        rows = np.flatnonzero(factor)
        both[rows] -= factor[rows, None] * both[k]
    return both[:, n:]


def _simplex(columns: np.ndarray, demand: np.ndarray, capacity: int, sizes: np.ndarray, most_columns: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation for: least number of windows that hold demand[g] pieces of each size. Gives columns and amounts.

    columns is diagonal: windows of one size each. Ends when GAP is reached, or after most_columns changes of the basis;
    the share of windows that could still be saved is then below the last knapsack's value less 1.
    """
    diagonal = columns.diagonal().astype(float)
    basis, inverse, amount = np.diag(diagonal), np.diag(1 / diagonal), demand / diagonal
    tables, changes = _Knapsack(sizes, capacity), 0
    while changes < most_columns:
        price = inverse.sum(axis=0)
        value, patterns = tables.best(price, COLUMNS)
        if value <= 1 + GAP:
            break
        for pattern in patterns:
            some = np.flatnonzero(pattern)
            if (price[some] * pattern[some]).sum() <= 1 + GAP / 2:
                continue
            direction = (inverse[:, some] * pattern[some]).sum(axis=1)
            ratio = np.where(direction > 1e-9, np.maximum(amount, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
            out = int(np.argmin(ratio))
            if not np.isfinite(ratio[out]):
                continue
            basis[:, out] = pattern
            move = ratio[out]
            amount = amount - move * direction
            amount[out] = move
            pivot = inverse[out] / direction[out]
            inverse -= direction[:, None] * pivot
            inverse[out] = pivot
            changes += 1
            if changes % 300 == 0:  # errors add up
                inverse = _inverse(basis)
                amount = (inverse * demand).sum(axis=1)
            price = inverse.sum(axis=0)
    return np.rint(basis).astype(np.int64), np.maximum(amount, 0)


class _Knapsack:
    """The configurations worth most. A table for each number of pieces, as few large pieces share a window; two tables make a whole window."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity, self.most = np.asarray(sizes), capacity, capacity // int(np.min(sizes))
        room = np.arange(capacity + 1)[None, :] - self.sizes[:, None]
        self.room = np.where(room >= 0, room, capacity + 1)

    def best(self, price: np.ndarray, many: int = 1) -> tuple[float, list[np.ndarray]]:
        """The largest value, and patterns of the largest ones for different ways to share the window."""
        price, space = np.maximum(price, 0), np.arange(self.capacity + 1)
        tables, picks = [np.zeros(self.capacity + 1)], [space * 0 - 1]
        for _ in range(-(-self.most // 2)):
            offers = np.append(tables[-1], -np.inf)[self.room]
            offers += price[:, None]
            pick = offers.argmax(axis=0)
            value = offers[pick, space]
            better = value > tables[-1]
            tables.append(np.where(better, value, tables[-1]))
            picks.append(np.where(better, pick, -1))
        half = len(tables) - 1
        total = tables[half] + tables[self.most - half][::-1]
        found: dict[bytes, np.ndarray] = {}
        for c in np.argsort(-total, kind="stable")[: 4 * many]:
            pattern = np.zeros(len(self.sizes))
            for table, left in ((half, int(c)), (self.most - half, self.capacity - int(c))):
                for t in range(table, 0, -1):
                    g = int(picks[t][left])
                    if g >= 0:
                        pattern[g] += 1
                        left -= int(self.sizes[g])
            found.setdefault(pattern.tobytes(), pattern)
            if len(found) >= many:
                break
        return float(total.max()), list(found.values())


def _knapsack(price: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration worth most."""
    value, patterns = _Knapsack(sizes, capacity).best(price)
    return value, patterns[0]


def group_large(lengths: list[int], counts: list[int], groups: int = GROUPS) -> list[tuple[int, int]]:
    """Linear grouping of pieces given as counts by length: (size, number) of each group, longest first. Groups may split a length."""
    total = sum(counts)
    groups = min(groups, total)
    out: list[tuple[int, int]] = []
    pairs = sorted(zip(lengths, counts, strict=True), reverse=True)
    i, used = 0, 0
    for g in range(groups):
        want = total * (g + 1) // groups - total * g // groups
        size, left = pairs[i][0], want
        while left:
            take = min(left, pairs[i][1] - used)
            left, used = left - take, used + take
            if used == pairs[i][1]:
                i, used = i + 1, 0
        if out and out[-1][0] == size:
            out[-1] = (size, out[-1][1] + want)
        else:
            out.append((size, want))
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations (pieces of each size) and how many windows use each; together at most counts."""
    if not sizes:
        return []
    s, need = np.array(sizes), np.array(counts, dtype=np.int64)
    start = np.diag([max(1, min(capacity // x, int(n))) for x, n in zip(sizes, counts, strict=True)])
    columns, amounts = _simplex(start, need.astype(float), capacity, s)
    found: dict[tuple[int, ...], int] = {}
    left = need.copy()
    for k in np.argsort(-amounts):
        n = int(amounts[k] + 1e-7)
        column = columns[:, k]
        n = min([n, *(int(left[g] // column[g]) for g in np.flatnonzero(column))])
        if n > 0:
            found[tuple(column.tolist())] = found.get(tuple(column.tolist()), 0) + n
            left -= n * column
    return [(list(c), n) for c, n in found.items()]


def plan_small(spaces: dict[int, int], lengths: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Best fit decreasing by counts. spaces: windows by space left; lengths: small pieces by length.

    Gives rules (length, first piece, space, first window, windows, pieces a window, used before) and how many new windows
    are taken; windows are numbered from 0 within their space, new ones have the space `capacity`. A rule puts pieces
    first, first + 1, ... into its windows one after another, `pieces a window` each, behind `used before` tokens.
    """
    # Cohorts of windows with the same space left now: (left, space at first, first window, windows, used).
    cohorts: list[tuple[int, int, int, int, int]] = sorted((s, s, 0, n, 0) for s, n in spaces.items() if s > 0 and n > 0)
    rules, new = [], 0
    for length in sorted(lengths, reverse=True):
        first, n = 0, lengths[length]
        while n:
            at = bisect_left(cohorts, (length,))
            if at == len(cohorts):
                each = capacity // length
                want = -(-n // each)
                insort(cohorts, (capacity, capacity, new, want, 0))
                new += want
                continue
            left, space, start, windows, used = cohorts.pop(at)
            each = min(left // length, n)
            take = min(windows, n // each)
            rules.append((length, first, space, start, take, each, used))
            first, n = first + take * each, n - take * each
            if windows > take:
                insort(cohorts, (left, space, start + take, windows - take, used))
            if left - each * length > 0:
                insort(cohorts, (left - each * length, space, start, take, used + each * length))
    return rules, new


@dataclass
class Plan:
    """places (first rank, end, pieces a window, first window or -1, place) of the large pieces by rank, longest first, -1: they
    go with the small ones; windows by configuration; spaces: these windows by free tokens; rest: what best fit gets, by length."""

    places: list[tuple[int, int, int, int, int]]
    windows: int
    spaces: dict[int, int]
    rest: dict[int, int]
    rules: list[tuple[int, int, int, int, int, int, int]]
    new: int


def plan_windows(counts: dict[int, int], window: int = WINDOW, groups: int = GROUPS) -> Plan:
    """Steps 2 to 6 for pieces given as counts by length."""
    small_most = window // SMALL_PART
    lengths = np.array(sorted((x for x in counts if x > small_most), reverse=True), dtype=np.int64)
    small = {x: n for x, n in counts.items() if x <= small_most}
    if not len(lengths):
        rules, new = plan_small({}, small, window)
        return Plan([], 0, {}, small, rules, new)
    numbers = np.array([counts[int(x)] for x in lengths])
    ends = np.cumsum(numbers)
    grouped = group_large(lengths.tolist(), numbers.tolist(), groups)
    sizes, needs = [g[0] for g in grouped], [g[1] for g in grouped]
    starts = [0, *np.cumsum(needs).tolist()]
    # Runs of windows of a configuration that hold the same actual lengths.
    taken, runs = [0] * len(sizes), []
    for column, n in configurations(sizes, needs, window):
        parts, cuts = [(starts[g] + taken[g], k) for g, k in enumerate(column) if k], [np.zeros(1, np.int64)]
        for a, k in parts:
            for j in range(k):
                inside = ends[(ends > a + j) & (ends < a + n * k)]
                cuts.append(-((a + j - inside) // k))
        first = np.unique(np.concatenate(cuts))
        first = first[first < n]
        held = np.stack([np.searchsorted(ends, a + first * k + j, side="right") for a, k in parts for j in range(k)])
        many = np.diff(np.append(first, n))
        free = window - lengths[held].sum(axis=0)
        runs += [(int(free[i]), int(first[i]), int(many[i]), held[:, i], parts) for i in range(len(first))]
        for g, k in enumerate(column):
            taken[g] += n * k
    beyond = np.zeros(len(lengths), np.int64)
    for g, t in enumerate(taken):
        ranks = np.clip(np.array([starts[g] + t, starts[g + 1]]), 0, None)
        beyond += np.maximum(0, np.minimum(ends, ranks[1]) - np.maximum(ends - numbers, ranks[0]))

    def fitted(most_free: int) -> tuple[list, int, dict[int, int], dict[int, int], int]:
        over, spaces, windows = beyond.copy(), {}, 0
        for free, _, many, held, _ in runs:
            if free > most_free:
                np.add.at(over, held, many)
            else:
                spaces[free], windows = spaces.get(free, 0) + many, windows + many
        rest = small | {int(x): int(n) for x, n in zip(lengths, over, strict=True) if n}
        rules, new = plan_small(spaces, rest, window)
        return rules, new, spaces, rest, windows

    tried = [(fitted(f), f) for f in FREE]
    (rules, new, spaces, rest, windows), most_free = min(tried, key=lambda x: x[0][1] + x[0][4])
    places, at = [], 0
    for free, first, many, _, parts in runs:
        order = 0
        for a, k in parts:
            places.append((a + first * k, a + (first + many) * k, k, at if free <= most_free else -1, order))
            order += k
        at += many if free <= most_free else 0
    places += [(starts[g] + t, starts[g + 1], 1, -1, 0) for g, t in enumerate(taken) if t < needs[g]]
    return Plan(sorted(places), windows, spaces, rest, rules, new)


def pack(pieces: DataFrame, window: int = WINDOW, groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...): windows of at most `window` tokens, as few as can be.

    Lengths are from 1 to window; (doc_id, piece) tells pieces apart, and repeated rows are numbered and all packed.
    Offsets in a sequence run from 0 without gaps. Columns named sequence_id or offset are replaced, columns whose names start
    with _pack or _rank are the operator's own and are left out. An empty table gives an empty result. Large pieces that share a length are interchangeable: which of
    them stands where follows from a hash of the row.
    """
    spark = pieces.sparkSession
    own = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset") and not c.lower().startswith(("_pack", "_rank"))]
    pieces = pieces.select(*own)
    rows = materialize(pieces.withColumn("_pack_turn", F.xxhash64("doc_id", "piece", "length")), "pack-pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most `window` rows
    if any(not 0 < x <= window for x in counts):
        raise ValueError("lengths must be from 1 to the window")
    salts = spark.createDataFrame([(x, 1 + n // RANK_ROWS) for x, n in counts.items()], "length long, _pack_parts int")
    rows = rows.withColumn("length", F.col("length").cast("long")).join(F.broadcast(salts), "length")
    numbered = materialize(ranked(rows, ["length"], ["_pack_turn", *[c for c in ("doc_id", "piece") if c in own]], F.pmod("_pack_turn", F.col("_pack_parts")), "_pack_rank").drop("_pack_turn", "_pack_parts"), "pack-numbered")

    small_most = window // SMALL_PART
    plan = plan_windows(counts, window, groups)
    ranges, windows, rules = plan.places, plan.windows, plan.rules
    # Ranks among the large pieces, longest first: of each length.
    before, spans = 0, []
    for x in sorted((x for x in counts if x > small_most), reverse=True):
        spans.append((x, before, before + counts[x]))
        before += counts[x]
    # What a length's pieces do, by their rank in it: rows (first rank, pieces a window or 1, window or -1, place, shift).
    # There are no more of them than lengths and ranges together.
    by_length, i = [], 0
    for x, a, b in spans:
        found, over = [], 0
        while i < len(ranges) and ranges[i][1] <= a:
            i += 1
        for lo, hi, k, w, order in ranges[i:]:
            if lo >= b:
                break
            first, last = max(lo, a), min(hi, b)
            found.append([first - a, k, w, order, over if w < 0 else first - lo])
            if w < 0:
                over += last - first
        by_length.append((x, [r[0] for r in found], found))

    def ruled(rows: DataFrame, table: list, rank: str) -> DataFrame:
        """Add _pack_rule: of the length's rules, in the order of their first rank, the last that starts at or before the rank."""
        lookup = spark.createDataFrame(table, "length long, _pack_firsts array<long>, _pack_rules array<array<long>>")
        rows = rows.join(F.broadcast(lookup), "length")
        rule = F.element_at("_pack_rules", F.size(F.filter("_pack_firsts", lambda x: x <= F.col(rank))))
        return rows.withColumn("_pack_rule", rule).drop("_pack_firsts", "_pack_rules")

    rule = lambda i: F.element_at("_pack_rule", i)
    within = F.col("_pack_rank") - rule(1) + rule(5)
    big = ruled(numbered.where(F.col("length") > small_most), by_length, "_pack_rank")
    over = big.where(rule(3) < 0).withColumn("_pack_rank", within).drop("_pack_rule")
    big = big.where(rule(3) >= 0).select(*own, (rule(3) + F.floor(within / rule(2))).cast("long").alias("sequence_id"), (rule(4) + within % rule(2)).cast("long").alias("_pack_pos"))
    big = materialize(big, "pack-large")

    # A window's large pieces are few (each over 1 / SMALL_PART of it): their offsets follow in the row.
    held = big.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("_pack_pos", "length"))).alias("_pack_in"), F.sum("length").alias("_pack_used"))
    held = materialize(held.withColumn("_pack_space", F.lit(window) - F.col("_pack_used")), "pack-windows")
    base = window  # the space of new windows; their sequence ids follow those of the configurations
    little = numbered.where(F.col("length") <= small_most).unionByName(over)
    small_rules: dict[int, list] = {}
    for r in rules:
        small_rules.setdefault(r[0], []).append(list(r[1:]))
    little = ruled(little, [(x, [r[0] for r in rs], rs) for x, rs in small_rules.items()], "_pack_rank")
    within = F.col("_pack_rank") - rule(1)
    little = little.withColumn("_pack_space", rule(2)).withColumn("_pack_window", (rule(3) + F.floor(within / rule(5))).cast("long")).withColumn("_pack_lead", rule(6) + (within % rule(5)) * F.col("length"))
    fresh = little.where(F.col("_pack_space") == base).select(*own, (F.lit(windows) + F.col("_pack_window")).cast("long").alias("sequence_id"), F.col("_pack_lead").cast("long").alias("offset"))
    if not windows:
        return fresh
    part = F.pmod(F.xxhash64("sequence_id"), F.lit(max(1, windows // RANK_ROWS + 1)))
    spots = ranked(held.select("sequence_id", "_pack_space"), ["_pack_space"], ["sequence_id"], part, "_pack_window")
    offsets_big = held.select("sequence_id", F.explode(F.transform("_pack_in", lambda x: F.struct(x["_pack_pos"].alias("_pack_pos"), F.aggregate(F.filter("_pack_in", lambda y: y["_pack_pos"] < x["_pack_pos"]), F.lit(0).cast("long"), lambda s, y: s + y["length"]).alias("offset")))).alias("o")).select("sequence_id", "o._pack_pos", "o.offset")
    done_big = big.join(offsets_big, ["sequence_id", "_pack_pos"]).select(*own, "sequence_id", "offset")
    filled = little.where(F.col("_pack_space") < base).join(spots, ["_pack_space", "_pack_window"]).select(*own, "sequence_id", (F.lit(window) - F.col("_pack_space") + F.col("_pack_lead")).cast("long").alias("offset"))
    return done_big.unionByName(filled).unionByName(fresh)
