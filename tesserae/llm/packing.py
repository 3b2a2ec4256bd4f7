"""Best-fit packing of documents into sequences by bin completion.

Lengths are counted in words plus one separator.  Documents longer than a
sequence are cut into full sequences and a rest; all pieces are packed, nothing is
truncated or dropped.  Pieces go to shards of about SHARD documents by hash (only
lengths move, never texts), and each shard is packed by itself.

Full sequences are bins of their own.  The rests are counted by length, of which there are fewer than
the capacity has words, and packed by length; documents take their places at the end.  Best-fit decreasing gives the
incumbent.  If its number of bins equals the lower bound (of the sum, or of the
long pieces that share no bin) it is optimal.  Otherwise bin completion
searches depth first: it takes the largest piece left, enumerates the fillings
of its bin by any number of pieces, fullest first, leaves out dominated ones (a longer piece
fits in place of one or two, or beside them; a piece that fills the bin alone dominates all else), and prunes branches whose waste so far means
that they can't beat the incumbent.  Packing is NP-hard, so the search has a budget: after STEPS lengths looked at in a shard
it ends with the incumbent.  That is some seconds a shard, and many times what 12 pieces of any lengths need.

Defined results: null text, and text without words, has length 1 (the separator).
Equal lengths go by doc_id, null last, then by piece.  Rows with null doc_id are packed too.
Repeated rows are packed each.  The empty table gives no bins.  A document of any length is cut whole.  Columns other than doc_id
and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD = 4096
STEPS = 3_000_000
SCHEMA = "bin_id string, doc_ids array<bigint>, pieces array<int>, lengths array<int>, used int"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the lengths in each bin, for sizes in descending order."""
    bins: list[list[int]] = []
    having: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    rooms = 0  # bit r: some bin has room r
    for s in sizes:
        fit = rooms >> s
        if not fit:
            bins.append([s])
            b, room = len(bins) - 1, capacity
        else:
            room = s + (fit & -fit).bit_length() - 1
            b = having[room].pop()
            if not having[room]:
                rooms ^= 1 << room
            bins[b].append(s)
        having[room - s].append(b)
        rooms |= 1 << (room - s)
    return bins


def least_bins(count: dict[int, int], capacity: int) -> int:
    """Lower bound on the bins for these numbers of pieces by length.

    The largest of three kinds: the sum's; that of long pieces, in bins of their own, and of what doesn't fit beside
    them; and those of the dual feasible functions floor((k + 1) x) / k, by which no more than k pieces longer than 1 / (k + 1) share a bin.
    """
    if not count:
        return 0
    size, n = (np.array(x, np.int64) for x in zip(*sorted(count.items())))
    over = 2 * size > capacity
    free, fill = np.where(over, (capacity - size) * n, 0), np.where(over, 0, size * n)
    k = np.r_[0, size[~over]]
    free = np.r_[0, np.cumsum(free)][np.searchsorted(size, capacity - k, "right")]
    short = np.r_[np.cumsum(fill[::-1])[::-1], 0][np.searchsorted(size, k)]
    best = max(-(-int((size * n).sum()) // capacity), int(n[over].sum() + np.maximum(0, -(-(short - free) // capacity)).max()))
    for parts in range(1, 33):
        whole, part = np.divmod((parts + 1) * size, capacity)
        twice = np.where(part == 0, parts * whole, (parts + 1) * whole)  # of parts * (parts + 1)
        best = max(best, -(-int((twice * n).sum()) // (parts * (parts + 1))))
    return best


class Budget:
    """Counts down the lengths that a search looks at."""

    def __init__(self, steps: int):
        self.left = steps


def fillings(count: dict[int, int], sizes: list[int], room: int, least: int, budget: Budget) -> Iterator[tuple[int, ...]]:
    """Multisets of the lengths (descending in sizes, count of each; zero for used ones) with least <= sum <= room, fullest first.

    A single piece, or two, that fill the room are found by looking up counts.  For the others the sums that the
    lengths from some place on can reach are kept as bits, so the depth-first search takes no step that doesn't end in a filling.
    """
    if count.get(room):
        yield (room,)
        return  # dominates every other filling
    budget.left -= len(sizes)
    have = [s for s in sizes if s <= room and count[s]]
    for x in reversed(have):  # two of about one length first: short pieces are worth more later
        y = room - x
        if x >= y and count.get(y) and (x != y or count[x] > 1):
            yield (x, y)
    mask = (2 << room) - 1
    reach = [1] * (len(have) + 1)
    for i in range(len(have) - 1, -1, -1):
        bits, s, n, step = reach[i + 1], have[i], min(count[have[i]], room // have[i]), 1
        while n:  # up to n copies, by doubling
            step = min(step, n)
            bits |= bits << step * s & mask
            n -= step
            step *= 2
        reach[i] = bits
    budget.left -= 2 * len(have)
    for total in range(room, least - 1, -1):
        if not reach[0] >> total & 1:
            continue
        items: list[int] = []  # places in `have`, ascending
        left, i = total, 0
        while True:
            if not left:
                if total < room or len(items) > 2:
                    yield tuple(have[k] for k in items)
                i = len(have)
            while i < len(have):  # the next length with which what is left can still be reached
                budget.left -= 1
                s = have[i]
                taken = 0
                for k in reversed(items):
                    if k != i:
                        break
                    taken += 1
                if s <= left and taken < count[s] and _reachable(reach[i + 1], s, min(count[s] - taken - 1, (left - s) // s), left - s):
                    break
                i += 1
            if i < len(have):
                items.append(i)
                left -= have[i]
            elif items:
                i = items.pop()
                left += have[i]
                i += 1
            else:
                break


def _reachable(bits: int, s: int, n: int, left: int) -> bool:
    """Whether up to n more of s and a sum in bits make `left`."""
    return any(bits >> (left - k * s) & 1 for k in range(n + 1))


def dominated(count: dict[int, int], present: int, items: tuple[int, ...], room: int) -> bool:
    """Whether a spare piece fits in beside the filling, or into it in place of one or two of its pieces, and fills no less.

    present: bit s for every length s that is left, those of the filling included.
    """
    mine = Counter(items)
    for s, n in mine.items():
        if count[s] == n:
            present ^= 1 << s  # none to spare
    slack = room - sum(items)
    some = (1 << slack) - 1
    if slack and (present >> 1 & some or any(present >> (x + 1) & some for x in mine)):
        return True
    return any(present >> (x + y) & (some << 1 | 1) for x in mine for y in mine if x > y or x == y and mine[x] > 1)


def pack(sizes: list[int], capacity: int, steps: int = STEPS) -> list[list[int]]:
    """The lengths in each bin for sizes in descending order, all of at most `capacity`."""
    best = best_fit(sizes, capacity)
    count = dict(Counter(sizes))
    bound = least_bins(count, capacity)
    if len(best) <= bound:
        return best
    total, budget, order = sum(sizes), Budget(steps), list(count)
    left, present = len(sizes), sum(1 << s for s in count)

    def put(items: tuple[int, ...], by: int) -> None:
        nonlocal left, present
        for s in items:
            count[s] += by
            present = present | 1 << s if count[s] else present & ~(1 << s)
        left += by * len(items)

    bins: list[tuple[int, ...]] = []  # the largest piece first
    waste, wasted = 0, []
    stack: list[Iterator[tuple[int, ...]]] = []

    def spare() -> int:
        """Waste that a packing in fewer bins than the incumbent may still have."""
        return (len(best) - 1) * capacity - total - waste

    def opened() -> Iterator[tuple[int, ...]]:
        first = present.bit_length() - 1
        put((first,), -1)
        bins.append((first,))
        room = capacity - first
        return iter([()]) if not present & ((2 << room) - 2) else fillings(dict(count), order, room, max(0, room - spare()), budget)

    stack.append(opened())
    while stack and budget.left > 0:
        first = bins[-1][:1]
        room = capacity - first[0]
        for items in stack[-1]:
            gap = room - sum(items)
            if gap > spare():
                continue  # the incumbent may have improved since
            budget.left -= len(items) ** 2
            if not dominated(count, present, items, room):
                break
            if budget.left <= 0:
                return best
        else:
            stack.pop()
            put(bins.pop(), 1)
            if wasted:
                waste -= wasted.pop()
                put(bins[-1][1:], 1)
                bins[-1] = bins[-1][:1]
            continue
        put(items, -1)
        bins[-1] = first + items
        if left:
            waste += gap
            wasted.append(gap)
            stack.append(opened())
            continue
        if len(bins) < len(best):
            best = [list(b) for b in bins]
            if len(best) <= bound:
                return best
        put(items, 1)
        bins[-1] = first
    return best


def n_words(text) -> F.Column:
    """Words between white space, as a column; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\t\n\x0B\f\r ]+"), lambda x: x != "")), F.lit(0))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, steps: int = STEPS) -> DataFrame:
    """One row for each sequence: bin_id, and doc_ids, pieces (number of the part of its document) and lengths in order, and their sum."""
    text = F.col("text").cast("string")
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.isNull(), 1).otherwise(n_words(text) + 1).alias("length"), F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), text)).alias("hash"))
    shards = max(1, round(docs.count() / shard))
    lengths = lengths.select("doc_id", "length", F.pmod("hash", F.lit(shards)).cast("int").alias("shard"))

    def packed(table: pa.Table) -> pa.Table:
        s, null = table["shard"][0].as_py(), np.asarray(table["doc_id"].combine_chunks().is_null())
        ids, size = table["doc_id"].fill_null(0).to_numpy(), table["length"].to_numpy().astype(np.int64)
        full, rest = size // capacity, size % capacity
        row = np.repeat(np.arange(len(size)), full)  # of full sequences, each a bin
        number = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
        short = np.flatnonzero(rest)
        short = short[np.lexsort((full[short], ids[short], null[short], -rest[short]))]
        bins = pack(rest[short].tolist(), capacity, steps)
        flat = np.array([x for b in bins for x in b], np.int64)
        took = np.argsort(-flat, kind="stable")  # pieces in order take the places of their length in order
        place = np.empty(len(flat), np.int64)
        place[took] = short
        row, number = np.r_[row, place], np.r_[number, full[place]]
        cut = pa.array(np.r_[0, np.cumsum(np.r_[np.ones(len(row) - len(place), np.int64), np.array([len(b) for b in bins], np.int64)])].astype(np.int32))
        length = np.where(number < full[row], capacity, rest[row]).astype(np.int32)
        return pa.table(
            {
                "bin_id": [f"{s}-{k}" for k in range(len(cut) - 1)],
                "doc_ids": pa.ListArray.from_arrays(cut, pa.array(ids[row], pa.int64(), mask=null[row])),
                "pieces": pa.ListArray.from_arrays(cut, pa.array(number.astype(np.int32))),
                "lengths": pa.ListArray.from_arrays(cut, pa.array(length)),
                "used": pa.array(np.add.reduceat(length, cut.to_numpy()[:-1]), pa.int32()),
            }
        )

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, much work: not to be coalesced
    spread = lengths.repartitionById(shards, F.col("shard")) if shards <= tasks else lengths.repartition(tasks, "shard")
    return spread.groupBy("shard").applyInArrow(packed, SCHEMA)
