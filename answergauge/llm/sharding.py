"""Sharding by minimax contiguous partition.

Rows with equal text are one atomic group (by the XXH64 of the text; texts that collide share a group, which keeps
every promise made here). The groups are one ordered sequence: first those that alone are at least the fair share of what
is left to deal out, the largest first (fewer than n, whatever the data), then all others by their hash. Shards are
contiguous runs of that sequence, cut so that the largest sizes are as small as can be, one after the other: a group of a
fair share or more sets the size of its shard whatever is cut, so it is a shard alone; for the rest, the smallest
capacity at which a greedy walk over the ordered groups fills at most the shards left is found by binary search, and the cuts
keep to that capacity. Of all such cuts (the walk's own leave the last shard with what is over) those nearest to equal
shares are taken.

The walk needs the running size at the cuts alone. The driver holds running sizes over a radix of the hash. First the
cells with more than 1 / HEAVY of a shard are divided until what they hold is spread or is one group, so that the bounds on
the capacity are close however large a group is; then each pass over the group table divides only the cells in which a
cut can still lie, found by a join with the table of these cells (LEAVES rows at most). A cell with one group can't be
divided further; when all cells in question have one group the search is exact. So the driver's state and the number of
passes don't depend on the number of rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Radix bits of the first pass, the most cells a later pass makes, and the part of a shard that makes a cell heavy.
FIRST_BITS, LEAVES, HEAVY = 14, 1 << 17, 64
#: Rows of a shard are numbered in so many cells that can be sorted apart.
SLOT_CELLS = 1024


def _walk(ends: list[int], atom: list[int], capacity: int, n: int, loose: bool) -> list[int] | None:
    """Where a greedy walk cuts, as sizes before the cut. ends: running size after each cell; atom: groups in the cell.

    Cells with several groups are not resolved: loose takes them to be divisible anywhere (a bound from above on
    where the walk gets), else they are taken to be indivisible (a bound from below). None: more than n shards.
    """
    at, cuts, total = 0, [], ends[-1] if ends else 0
    while at < total:
        if len(cuts) == n:
            return None
        reach = at + capacity
        k = bisect_right(ends, reach)
        to = ends[k - 1] if k else 0
        if loose and k < len(ends) and atom[k] > 1:
            to = reach
        if to <= at:
            return None
        at = to
        cuts.append(at)
    return cuts


def _least(ends: list[int], atom: list[int], n: int, low: int, high: int, loose: bool) -> int:
    """The least capacity in low..high at which the walk needs at most n shards; high is known to do."""
    while low < high:
        mid = (low + high) // 2
        if _walk(ends, atom, mid, n, loose) is not None:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(groups: DataFrame, n: int) -> tuple[list[int], int]:
    """The last hash of each shard and the capacity. groups: hash long (distinct), size long (at least 1)."""
    # A cell: (bits, first hash >> (64 - bits)); what it holds: size, groups, last hash.
    first = groups.groupBy(F.shiftright("hash", 64 - FIRST_BITS).alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("c"), F.max("hash").alias("h"))
    parts: dict[tuple[int, int], tuple[int, int, int]] = {(FIRST_BITS, r.p): (r.s, r.c, r.h) for r in first.collect()}
    total = sum(s for s, _, _ in parts.values())
    # Fewer than n * HEAVY cells can be heavy.
    while heavy := {k for k, (s, c, _) in parts.items() if c > 1 and s * n * HEAVY > total}:
        parts = _divide(groups, parts, heavy)
    while True:
        order = sorted(parts, key=lambda k: parts[k][2])
        ends, atom, at = [], [], 0
        for k in order:
            at += parts[k][0]
            ends.append(at)
            atom.append(parts[k][1])
        if not at:
            return [], 0
        # At this capacity the walk passes at least a fair share each time, even with indivisible cells.
        safe = -(-at // n) + max(parts[k][0] for k in order)
        low = _least(ends, atom, n, -(-at // n), safe, True)
        high = _least(ends, atom, n, low, safe, False)
        far = _walk(ends, atom, high, n, True) or []
        near = _walk(ends, atom, low, n, False) or _behind(ends, low, n)
        open_ = set()
        for k in range(n):
            a, b = (near[k] if k < len(near) else at), (far[k] if k < len(far) else at)
            i = bisect_right(ends, min(a, b))
            while i < len(ends) and (ends[i - 1] if i else 0) <= b:
                if atom[i] > 1:
                    open_.add(order[i])
                i += 1
        if not open_:
            if low < high:  # every cut is known at either capacity, so the least is found among whole groups
                high = _least(ends, [1] * len(ends), n, low, high, False)
            cuts, asked = _even(ends, atom, high, n)
            if not asked:
                return [parts[order[bisect_right(ends, c) - 1]][2] for c in cuts], high
            open_ = {order[i] for i in asked}
        parts = _divide(groups, parts, open_)


def _even(ends: list[int], atom: list[int], capacity: int, n: int) -> tuple[list[int], set[int]]:
    """Cuts that keep to the capacity and are as even as the groups allow; cells that have to be divided first.

    A walk from the end says how far each cut has to be at least. From the start on, each cut is the end of a group
    nearest to an equal share of what is left, but there at least.
    """
    total, asked = ends[-1], set()
    least = [total]
    for _ in range(n - 1):
        i = bisect_left(ends, least[-1] - capacity)  # the first cell that ends there or later
        if least[-1] <= capacity:
            least.append(0)
            continue
        if atom[i] > 1 and ends[i] > least[-1] - capacity:
            asked.add(i)
        least.append(ends[i])
    least.reverse()
    at, cuts = 0, []
    for k in range(n - 1):
        if at == total:
            break
        goal = at + (total - at) / (n - k)
        i = bisect_left(ends, goal)
        if atom[i] > 1:
            asked.add(i)
        before, after = (ends[i - 1] if i else 0), ends[i]
        cut = after if after - goal < goal - before and after <= at + capacity else before
        if cut <= at:
            i = bisect_right(ends, at)
            if atom[i] > 1:
                asked.add(i)
            cut = ends[i]
        at = max(cut, least[k])
        cuts.append(at)
    return (cuts if at == total else [*cuts, total]), asked


def _behind(ends: list[int], capacity: int, n: int) -> list[int]:
    """A bound from below on the cuts of n steps, for a capacity at which whole cells don't do."""
    at, cuts = 0, []
    for _ in range(n):
        k = bisect_right(ends, at + capacity)
        at = max(at, ends[k - 1] if k else 0)
        cuts.append(at)
    return cuts


def _divide(groups: DataFrame, parts: dict, cells: set[tuple[int, int]]) -> dict:
    """parts with the given cells divided, in one pass over the groups whatever the cells' widths."""
    more = max(1, min(12, (LEAVES // len(cells)).bit_length() - 1))
    left = {k: v for k, v in parts.items() if k not in cells}
    table = groups.sparkSession.createDataFrame(sorted(cells), "bits int, cell long")  # LEAVES rows at most
    widths = sorted({bits for bits, _ in cells})
    # Cells don't overlap, so a group is in one of them at most, of whichever width.
    places = F.explode(F.array(*[F.struct(F.lit(w).alias("bits"), F.shiftright("hash", 64 - w).alias("cell")) for w in widths]))
    placed = groups.select("hash", "size", places.alias("at")).select("hash", "size", "at.bits", "at.cell")
    within = placed.join(F.broadcast(table), ["bits", "cell"]).withColumn("to", F.least(F.lit(64), F.col("bits") + more))
    found = within.groupBy("to", F.expr("shiftright(hash, 64 - to)").alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("c"), F.max("hash").alias("h"))
    return left | {(r.to, r.p): (r.s, r.c, r.h) for r in found.collect()}


def plan_shards(groups: DataFrame, n: int) -> tuple[list[int], list[int], int]:
    """(hashes with a shard of their own, last hashes of the other shards, their capacity)."""
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    own: list[int] = []
    for r in groups.orderBy(F.desc("size"), "hash").limit(n - 1).collect():  # at most n - 1 groups can be that large
        if r["size"] * (n - len(own)) < total or n - len(own) < 2:
            break
        own.append(r.hash)
        total -= r["size"]
    rest = groups.where(~F.col("hash").isin(own)) if own else groups
    cuts, capacity = minimax_cuts(rest, n - len(own))
    return own, cuts, capacity


def _shard_of(own: list[int], cuts: list[int]) -> Column:
    col = F.lit(len(own) + max(0, len(cuts) - 1))
    for k in reversed(range(len(cuts) - 1)):
        col = F.when(F.col("hash") <= F.lit(cuts[k]), F.lit(len(own) + k)).otherwise(col)
    for k in reversed(range(len(own))):
        col = F.when(F.col("hash") == F.lit(own[k]), F.lit(k)).otherwise(col)
    return col.cast("int")


def shard_documents(docs: DataFrame, n: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, shard, slot for each row of docs; sizes of shards are as equal as whole groups allow.

    size: UTF-8 bytes of the text plus 1. A null text counts as an empty one (size 1, crc32 0, in the group of empty
    texts). slot: position in the shard, gapless from 0. Repeated rows each get a slot. A null
    id is an id like others. An empty table gives an empty result. More shards than groups leave shards empty. Other
    columns of docs are not looked at, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = store.cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("hash"),
        )
    )
    groups = store.cut(rows.groupBy("hash").agg(F.sum("size").alias("size")))
    own, cuts, _ = plan_shards(groups, n)
    placed = rows.withColumn("shard", _shard_of(own, cuts)).withColumn("cell", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(SLOT_CELLS)).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("rows"))  # n * SLOT_CELLS rows at most
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "hash")
    numbered = placed.withColumn("rank", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(first), ["shard", "cell"]).select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot")
    )
