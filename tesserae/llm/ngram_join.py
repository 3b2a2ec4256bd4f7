"""N-gram Jaccard self-join by parity sketches.

Every text is the set of its distinct word n-grams.  A text in size band j
(2**j <= |S| < 2**(j+1)) spreads its n-grams over K_j blocks by hash; the
sketch of a block is the XOR of 64-bit hashes of the block's n-grams, so one
n-gram flips bits of one block only and the number of blocks in which two
sketches differ never exceeds the symmetric difference of the sets.  If the
Jaccard index is at least t, the symmetric difference is at most
D = (1-t)/(1+t) * (|A|+|B|); among more than D blocks one is equal
(pigeonhole), so texts that share no block in any band need no comparison.

A text sends only its strong blocks (much information, by the frequencies of
their n-grams in all documents), as long as they are more than D; equal blocks
are equally strong, so nothing is lost: let A
be whichever of a pair uses the higher level of LEVELS.  It sends more than D
blocks of at least that strength, one of which equals B's block, and B sends
all blocks of that strength.  Blocks of frequent n-grams alone, which would
join texts that have nothing else in common, and empty blocks stay at home.

Documents with equal sets are one class, named by a 64-bit hash of the set (unequal sets with one
name: 6e-6 expected among 15 million); from here on one row stands for a class, however many copies
it has, and its size goes with it.

Blocks move as packed keys to hash shards.  At 0.7 a block holds two n-grams or
so, hence many unrelated texts share one block; a signature of 32 smallest hashes,
4 bits each, goes with the keys, and pairs of which fewer than agree(t) fields are equal are
left there.  This is the one step that isn't exact: agree(t) is the largest number with which
a pair at Jaccard t is lost with a probability under LOSS by the binomial distribution; at 0.7 it is 10 (23
fields are equal on average), and unrelated texts pass with 2e-5.  Below 0.3 or so it is 0 and nothing is left.  The classes of a block that such pairs chain name the
smallest name among them as their leader; chains of large blocks are walked, so that m classes that are
all alike cost m comparisons and no list of pairs.  First only parity sketches travel to the
leaders, about one bit for each n-gram, of which each n-gram flips one: their
Hamming distance, too, is at most the symmetric difference, so texts that are too far
apart part there, and those that chains of possible pairs still join name the smallest
among them as their new leader (groups of several tiles keep theirs).  Their texts travel to those leaders,
where all pairs are verified exactly, STRIP pairs at a time.  A pair is reported by the smallest leader
that both have, so no distinct() over pairs is needed.  Groups beyond TILE texts or GRAMS n-grams
are cut into tile pairs.

near_links() has one row for each document; its links are counted where pairs are verified, and
groups come from a spanning forest of each verified group, so that what leaves it grows with
the number of texts.  ngram_jaccard_join() lists the pairs of documents.

Defined results: null text, and text without words, has an empty set and is in
no pair.  Texts of fewer than n words are one n-gram.  Rows with null doc_id
are in no pair; near_links() gives them the class null and no links.  Repeated rows with one doc_id never pair with themselves; a pair
of doc_ids is reported once, with the highest index of any of their rows, and near_links() counts for each
row the other rows that are like it, of whatever doc_id.  Texts of any length are compared whole.  An empty table gives no pairs.
Columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.pack import by_shard, packed_runs, unpacked
from tesserae.llm.shared import checkpoint, tidy, tidy_group
from tesserae.llm.text import NOT_WORD, chunks, flat, fresh, gram_hashes, mix, pieces, rows_of, shards, word_hashes, words

N, T = 2, 0.7
CELLS = 1 << 20  # of the frequency sketch
SLICES = 32  # in which it is added up
FAN = 64  # tasks whose counts are added at a time
COUNTS = "slice int, task int, rows long, counts binary"
LEVELS = (30, 24, 20, 16, 14, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0)  # bits
TILE = 2048
GRAMS = 1 << 20  # n-grams of a tile
STRIP = 1 << 20  # pairs that are verified at a time
WALK = 128  # signatures in a block beyond which its chains are walked
KEYS = 1 << 20  # block keys that a shard works on at a time
U = np.uint64
NONE = np.iinfo(np.int64).min
LOSS = 1e-6  # of a pair at the threshold, by its signature


def gram_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of every row, as 48 bits (42 of hash, 6 of length), and the rows' offsets."""
    import pyarrow.compute as pc

    b, o = flat(pc.utf8_lower(col))
    s, e, wo = words(b, o, NOT_WORD)
    h = word_hashes(b, s, e)
    count = np.diff(wo)
    row = rows_of(wo)
    g = np.zeros(len(h), np.uint64)
    length = np.r_[0, np.cumsum(e - s)]  # of the words alone: the same for the same n-gram
    size = np.zeros(len(h), np.int64)
    m = len(h) - n + 1
    if m > 0:
        g[:m] = gram_hashes(h, n)
        size[:m] = length[n:] - length[:-n]
    keep = np.arange(len(h)) + n <= wo[1:][row]
    for r in np.flatnonzero((count > 0) & (count < n)):  # one short n-gram
        i = wo[r]
        g[i] = gram_hashes(h[i : wo[r + 1]], int(count[r]))[0] ^ U(0x5BD1E995)
        size[i], keep[i] = length[wo[r + 1]] - length[i], True
    g, row, size = g[keep], row[keep], size[keep]
    key = (row.astype(np.uint64) << U(48)) | ((g >> U(22)) << U(6)) | np.minimum(size // 2, 63).astype(np.uint64)
    key = np.sort(key)
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key & U((1 << 48) - 1), np.searchsorted(key >> U(48), np.arange(len(o)).astype(np.uint64))


def class_ids(grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The name of every row's set: a 64-bit hash, equal for equal sets."""
    total = np.r_[U(0), np.cumsum(mix(grams ^ U(0x6A09E667F3BCC908)), dtype=np.uint64)]
    with np.errstate(over="ignore"):
        name = mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64)).view(np.int64)
    return np.where(name == NONE, NONE + 1, name)


def _unseen(name: np.ndarray, off: np.ndarray, seen: set[int]) -> np.ndarray:
    """The rows with words whose set this task hasn't met; forgetting some of seen only lets copies through."""
    if len(seen) > 1 << 20:
        seen.clear()
    at = np.sort(np.unique(name, return_index=True)[1])
    at = at[[size > 0 and x not in seen for x, size in zip(name[at].tolist(), np.diff(off)[at].tolist())]] if len(at) else at
    seen.update(name[at].tolist())
    return at


def _rows_at(grams: np.ndarray, off: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of these rows, in ascending order."""
    size = np.diff(off)
    keep = np.zeros(len(size), bool)
    keep[at] = True
    return grams[np.repeat(keep, size)], np.r_[0, np.cumsum(size[at])]


def distance_bound(size: np.ndarray, hi: np.ndarray, t: float) -> np.ndarray:
    """Largest symmetric difference with a set of at most `hi` n-grams at Jaccard >= t."""
    return np.floor((1 - t) / (1 + t) * (size + np.minimum(hi, np.floor(size / t + 1e-9))) + 1e-9).astype(np.int64)


def _cells(grams: np.ndarray) -> np.ndarray:
    return ((grams >> U(6)) & U(CELLS - 1)).astype(np.int64)


def information(docs: DataFrame, n: int) -> np.ndarray:
    """Bits of information of an n-gram, log2(documents / documents that hold it), by cell of a one-row count sketch over all documents.

    Cells that n-grams share overestimate frequencies, which lowers strengths and
    nothing else.  The sketch has a fixed size: tasks send their counts in slices, which are added FAN tasks
    at a time, so that no group grows with the number of tasks, and one byte a cell comes back.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for a, b in chunks(batch.column(0)):
                total += np.bincount(_cells(gram_sets(batch.column(0).slice(a, b - a), n)[0]), minlength=CELLS)
        if rows:
            parts = np.split(total.astype("<u4"), SLICES)
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "task": pa.array([task] * SLICES, pa.int32()), "rows": [rows] * SLICES, "counts": [p.tobytes() for p in parts]})

    def add(table: pa.Table) -> pa.Table:
        rows, total = _added(table)
        return pa.table({"slice": table["slice"].slice(0, 1), "task": pa.array([table["task"][0].as_py() // FAN], pa.int32()), "rows": [rows], "counts": [total.astype("<u4").tobytes()]})

    def finish(table: pa.Table) -> pa.Table:
        rows, total = _added(table)
        bits = np.clip(np.round(np.log2(np.maximum(rows, 1) / np.maximum(total, 1))), 0, 40).astype(np.uint8)
        return pa.table({"slice": table["slice"].slice(0, 1), "bits": [bits.tobytes()]})

    counts = docs.select("text").mapInArrow(tidy(count), COUNTS).groupBy("slice", F.expr(f"task div {FAN}")).applyInArrow(tidy_group(add), COUNTS)
    got = counts.groupBy("slice").applyInArrow(tidy_group(finish), "slice int, bits binary").collect()
    return np.frombuffer(b"".join(r.bits for r in sorted(got, key=lambda r: r.slice)), np.uint8) if got else np.zeros(CELLS, np.uint8)


def _added(table: pa.Table) -> tuple[int, np.ndarray]:
    """The sums of the rows and of the counts, one row at a time: a group's counts lie in memory once."""
    rows, total = 0, np.zeros(CELLS // SLICES, np.int64)
    for n, x in zip(table["rows"], table["counts"]):
        rows += n.as_py()
        total += np.frombuffer(x.as_buffer(), "<u4")
    return rows, total


def block_keys(grams: np.ndarray, off: np.ndarray, t: float, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of the blocks that the rows send, and the row of each.

    A row sends its blocks in its own band and, if it may be the smaller of a
    pair, in the next one.
    """
    size = np.diff(off)
    band = np.frexp(np.maximum(size, 1))[1] - 1
    keys, rows = [], []
    c = (1 - t) / (1 + t)
    for up in range(int(np.ceil(-np.log2(t) - 1e-9)) + 1):
        j = band + up
        lo, hi = 2.0**j, 2.0 ** (j + 1) - 1
        r = np.flatnonzero((size > 0) & (size >= np.ceil(t * lo - 1e-9)))
        if not len(r):
            continue
        d = distance_bound(size, hi, t)
        k = np.ceil(1.3 * (np.floor(c * 2 * hi) + 1)).astype(np.int64) + 1
        k[2 * c * hi < 1] = 1  # no difference is allowed
        own = np.concatenate([np.arange(off[x], off[x + 1]) for x in r]) if len(r) < len(size) else np.arange(off[-1])
        row = np.repeat(r, size[r])
        g = mix((grams[own] >> U(6)) + U(0x2545F491))
        block = ((g >> U(40)).astype(np.int64) * k[row]) >> 24
        first = np.r_[0, np.cumsum(k[r])]
        place = np.zeros(len(size), np.int64)
        place[r] = first[:-1]
        slot = place[row] + block
        order = np.argsort(slot, kind="stable")
        cut = np.flatnonzero(np.r_[True, slot[order][1:] != slot[order][:-1]])
        x = np.zeros(first[-1], np.uint64)
        x[slot[order][cut]] = np.bitwise_xor.reduceat(mix(g ^ U(0x7F4A7C159E3779B9))[order], cut)
        strength = np.bincount(slot, weights=bits[_cells(grams[own])], minlength=first[-1])
        of = np.repeat(r, k[r])
        index = np.arange(first[-1]) - place[of]
        send = np.zeros(first[-1], bool)
        settled = np.zeros(len(size), bool)
        for level in LEVELS:
            strong = strength >= level
            enough = (np.bincount(of[strong], minlength=len(size)) > d) | (level == LEVELS[-1])
            now = enough & ~settled
            send |= strong & now[of]
            settled |= now
        with np.errstate(over="ignore"):
            salt = mix((j[of].astype(np.uint64) << U(40)) + index.astype(np.uint64) + U(1))
        keys.append(mix(x ^ salt)[send])
        rows.append(of[send])
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def signatures(grams: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row 32 times 4 bits: the smallest hash in each of 32 bins of its n-grams (0 in an empty bin)."""
    row = rows_of(off)
    h = mix((grams >> U(6)) ^ U(0x3C6EF372FE94F82B))
    least = np.full(32 * (len(off) - 1), U(2**64 - 1))
    np.minimum.at(least, row * 32 + (h & U(31)).astype(np.int64), h >> U(5))
    nibble = np.where(least == U(2**64 - 1), U(0), mix(least) & U(15)).reshape(-1, 2, 16)
    both = (nibble << (U(4) * np.arange(16, dtype=np.uint64))).sum(2, dtype=np.uint64)
    return both[:, 0], both[:, 1]


def agree(t: float) -> int:
    """Of 32 signature fields the largest number that all but LOSS of the pairs at Jaccard t reach; a field is equal by a common n-gram or by chance."""
    p = t + (1 - t) / 16
    lost, k = 0.0, 0
    while k < 32:
        lost += comb(32, k) * p**k * (1 - p) ** (32 - k)
        if lost >= LOSS:
            break
        k += 1
    return k


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of 16 fields of 4 bits are equal."""
    x = a ^ b
    x |= x >> U(2)
    x |= x >> U(1)
    return 16 - np.bitwise_count(x & U(0x1111111111111111)).astype(np.int64)


def _edges(table: pa.Table, least_agree: int) -> pa.Table:
    """(doc_id, leader) of the texts that share a block and, by their signatures, may be alike; the leader is the smallest of those that such pairs chain.

    Keys are worked on by KEYS or so at a time, by their last byte: equal ones stay together.
    """
    high, last = unpacked(table["p0"], np.uint32), unpacked(table["p1"], np.uint8)
    doc, lo, hi = unpacked(table["p3"], np.int64), unpacked(table["p4"], np.uint64), unpacked(table["p5"], np.uint64)
    run = np.repeat(np.arange(len(doc), dtype=np.int32), unpacked(table["p2"], np.uint32))
    place = np.empty(len(doc), np.int32)
    place[np.lexsort((doc, lo, hi))] = np.arange(len(doc), dtype=np.int32)  # rows by signature, then by document
    parts, found = min(256, 1 + len(high) // KEYS), []
    for k in range(parts):
        at = np.flatnonzero(last.astype(np.int16) % parts == k) if parts > 1 else slice(None)
        found.append(_edges_of((high[at].astype(np.uint64) << U(8)) | last[at], run[at], place, doc, lo, hi, least_agree))
    pair = np.concatenate(found)
    pair = np.unique(pair, axis=0) if len(pair) else pair
    return pa.table({"doc_id": pa.array(pair[:, 0], pa.int64()), "leader": pa.array(pair[:, 1], pa.int64())})


def _edges_of(key, run, place, doc, lo, hi, least_agree: int) -> np.ndarray:
    """_edges() of some keys: the row of each is run, and rows have a place in the order of signatures, a document and a signature."""
    order = np.lexsort((place[run], key))
    key, run = key[order], run[order]
    if not len(key):
        return np.zeros((0, 2), np.int64)
    once = np.r_[True, (key[1:] != key[:-1]) | (doc[run[1:]] != doc[run[:-1]])]
    key, run = key[once], run[once]
    block = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    copy = np.r_[False, (block[1:] == block[:-1]) & (lo[run[1:]] == lo[run[:-1]]) & (hi[run[1:]] == hi[run[:-1]])]
    head = np.flatnonzero(~copy)  # one row for each signature in a block
    of_head = np.cumsum(~copy) - 1
    inner = block[head]
    start = np.flatnonzero(np.r_[True, inner[1:] != inner[:-1]])
    count = np.diff(np.r_[start, len(head)])
    lo, hi = lo[run[head]], hi[run[head]]
    least = np.full(len(head), np.iinfo(np.int64).max)
    np.minimum.at(least, of_head, doc[run])
    use = np.bincount(of_head, minlength=len(head)) > 1
    for a, n in zip(start[count > WALK].tolist(), count[count > WALK].tolist()):
        for chain in _chains(lo[a : a + n], hi[a : a + n], least_agree):
            least[a + chain] = least[a + chain].min()
            use[a + chain] = True
    few = np.flatnonzero((count > 1) & (count <= WALK))
    upto = np.r_[0, np.cumsum(count[few] * (count[few] - 1) // 2)]
    at = 0
    while at < len(few):  # whole blocks, every signature with those before it, half a million pairs or one block at a time
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + (1 << 19), "right")) - 1)
        n = count[few[at:end]]
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        heads = np.repeat(start[few[at:end]], n) + rank
        i = np.repeat(heads, rank)
        j = np.repeat(heads - rank, rank) + (np.arange(len(i)) - np.repeat(np.cumsum(rank) - rank, rank))
        ok = _agree(lo[i], lo[j]) + _agree(hi[i], hi[j]) >= least_agree
        i, j = i[ok], j[ok]
        use[i] = use[j] = True
        while len(i):  # the smallest document of each chain
            low = np.minimum(least[i], least[j])
            change = (low < least[i]) | (low < least[j])
            if not change.any():
                break
            np.minimum.at(least, i, low)
            np.minimum.at(least, j, low)
        at = end
    use = use[of_head]
    return np.unique(np.stack([doc[run[use]], least[of_head[use]]], 1), axis=0)


def _chains(lo: np.ndarray, hi: np.ndarray, least_agree: int) -> Iterator[np.ndarray]:
    """The signatures of one block by chains of two and more; a signature is compared with those that no chain has yet."""
    free = np.arange(len(lo))
    while len(free):
        members, free = [int(free[0])], free[1:]
        for i in members:
            if not len(free):
                break
            ok = _agree(lo[free], lo[i]) + _agree(hi[free], hi[i]) >= least_agree
            members += free[ok].tolist()
            free = free[~ok]
        if len(members) > 1:
            yield np.array(members)


def parity_sketches(grams: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Of every row a sketch of 2**k >= size bits (256 at least), of which each n-gram flips one."""
    size = np.diff(off)
    width = 1 << np.maximum(8, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    start = np.r_[0, np.cumsum(width)]
    row = rows_of(off)
    at = start[row] + (mix((grams >> U(6)) + U(0x51ED270B)) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits(np.bincount(at, minlength=start[-1]).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [bits[i // 8 : j // 8] for i, j in zip(start[:-1].tolist(), start[1:].tolist())]


def _fold(bits: bytes, width: int) -> np.ndarray:
    """The sketch of fewer bits: halves cancel as the n-grams in them do."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, width // 64), 0)


def _close_roots(ids, size, bits, t: float) -> np.ndarray:
    """For every row the smallest identifier of the rows that chains of possible pairs join to it in this group; NONE if there are none.

    A pair is possible if its Hamming distance, which never exceeds the symmetric difference, allows Jaccard >= t.
    """
    n = len(size)
    size = size.astype(np.int64)
    width = np.array([8 * len(x) for x in bits])
    level = {w: (np.cumsum(width >= w) - 1, np.stack([_fold(x, w) for x in bits if len(x) * 8 >= w])) for w in np.unique(width).tolist()}
    root = np.full(n, NONE)
    free = np.ones(n, bool)
    for first in range(n):
        if not free[first]:
            continue
        free[first] = False
        members, at = [first], 0
        while at < len(members):
            i = members[at]
            at += 1
            j = np.flatnonzero(free & (size >= t * size[i] - 1e-9) & (size <= size[i] / t + 1e-9))
            for w, (of, x) in level.items():
                k = j[np.minimum(width[j], width[i]) == w] if w <= width[i] else j[:0]
                if len(k):
                    d = np.bitwise_count(x[of[k]] ^ x[of[i]]).sum(1)
                    k = k[d <= np.floor((1 - t) / (1 + t) * (size[i] + size[k]) + 1e-9)]
                    free[k] = False
                    members += k.tolist()
        if len(members) > 1:
            root[members] = ids[members].min()
    return root


def _groups(batches: Iterator[pa.RecordBatch], at_bytes: int = 16 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of (leader, ti, tj), of about this size or one group, and the groups' bounds."""
    names = ("leader", "ti", "tj")

    def cut(table):
        k = [table[c].to_numpy() for c in names]
        return np.r_[np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in k])]), len(k[0])]

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < at_bytes:
            continue
        table = pa.Table.from_batches(held)
        bounds = cut(table)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
            table = table.slice(bounds[-2])
        held, size = table.to_batches(), 0
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table)


def _to_leaders(rows: DataFrame, edges: DataFrame, classes: DataFrame, payload: list[str], named: bool = False) -> DataFrame:
    """A row of every class at each of its leaders (named: with the list of them and the class's weight), group by group; groups beyond TILE rows or GRAMS n-grams as pairs of tiles."""
    tiles = edges.join(classes, "node").groupBy("leader").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / GRAMS)).cast("int").alias("tiles"))
    per_node = edges.join(tiles.where("n > 1").select("leader", "tiles"), "leader").groupBy("node").agg(F.collect_list(F.struct("leader", "tiles")).alias("to"))
    if named:
        per_node = per_node.join(classes.select("node", "weight"), "node").withColumn("leaders", F.col("to.leader"))
    sent = rows.groupBy("node").agg(*(F.first(c).alias(c) for c in payload)).join(per_node, "node")
    payload = [*payload, *(["leaders", "weight"] if named else [])]
    sent = sent.select("node", *payload, F.explode("to").alias("to"))
    tile = F.pmod(F.xxhash64("node"), F.col("to.tiles")).cast("int")
    sent = sent.select("node", *payload, F.col("to.leader").alias("leader"), F.col("to.tiles").alias("tiles"), tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("to.tiles") - 1)).alias("other"))
    sent = sent.select("node", *payload, "leader", "tiles", "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"))
    return sent.repartition("leader", "ti", "tj").sortWithinPartitions("leader", "ti", "tj", "node")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """How many elements each set of left shares with each of right, STRIP numbers at a time.

    Elements in many sets of right are counted by a product of matrices, others by the list of the sets that have them.
    """
    m = len(right)
    a, b = np.concatenate(left), np.concatenate(right)
    of_a, of_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    order = np.argsort(b, kind="stable")
    b, of_b = b[order], of_b[order]
    at = np.searchsorted(b, a)
    n = np.searchsorted(b, a, "right") - at
    of_a, at, n = of_a[n > 0], at[n > 0], n[n > 0]
    often = n > max(16, m // 12)
    first, which = np.unique(at[often], return_inverse=True)
    number = np.zeros(len(at), np.int64)
    number[often] = which
    have = np.zeros(len(first), np.int64)
    have[which] = n[often]
    step = max(1, STRIP // m)
    for lo in range(0, len(left), step):
        hi = min(len(left), lo + step)
        s, e = np.searchsorted(of_a, [lo, hi])
        out = np.zeros((hi - lo) * m, np.float32)
        few = s + np.flatnonzero(~often[s:e])
        upto = np.r_[0, np.cumsum(n[few])]
        k = 0
        while k < len(few):
            end = max(k + 1, int(np.searchsorted(upto, upto[k] + STRIP, "right")) - 1)
            x = few[k:end]
            inside = np.arange(upto[end] - upto[k]) - np.repeat(upto[k:end] - upto[k], n[x])
            np.add.at(out, np.repeat((of_a[x] - lo) * m, n[x]) + of_b[np.repeat(at[x], n[x]) + inside], np.float32(1))
            k = end
        out = out.reshape(hi - lo, m)
        many = s + np.flatnonzero(often[s:e])
        wide = max(1, STRIP // m)
        for k in range(0, len(first), wide):
            f, h = first[k : k + wide], have[k : k + wide]
            r = np.zeros((len(f), m), np.float32)
            r[np.repeat(np.arange(len(f)), h), of_b[np.repeat(f, h) + np.arange(h.sum()) - np.repeat(np.cumsum(h) - h, h)]] = 1
            x = many[(number[many] >= k) & (number[many] < k + wide)]
            v = np.zeros((hi - lo, len(f)), np.float32)
            v[of_a[x] - lo, number[x] - k] = 1
            out += v @ r
        yield out


def _verify_group(nodes, sets, weight, leaders, tile, leader, ti, tj, t, pairs: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, peer, jaccard, links) of one group, all of which name this leader; their sets differ.

    pairs: every pair that this leader reports.  Otherwise the pairs of a spanning forest, and for each class, with NONE as its peer,
    the documents of the classes that it is like by pairs that this leader reports.
    """
    left, right = (np.flatnonzero(tile == x) for x in (ti, tj))
    size = np.array([len(s) for s in sets], np.float64)
    own = ti == tj
    less = [x[x < leader] for x in leaders]  # a leader below this one that both have reports a pair
    shared = _overlaps([less[i] for i in left], [less[i] for i in right]) if any(map(len, less)) and len(left) and len(right) else None
    if own and len(nodes) == 2:
        both = float(len(np.intersect1d(*sets, assume_unique=True)))
        common = iter([np.array([[size[0], both], [both, size[1]]], np.float32)])
    else:
        common = _overlaps([sets[i] for i in left], [sets[i] for i in right]) if len(left) and len(right) else iter(())
    label, links, lo = np.arange(len(nodes)), np.zeros(len(nodes), np.int64), 0
    forest: list[tuple[int, int, float]] = []
    for inter in common:
        x = left[lo : lo + len(inter)]
        inter = inter.astype(np.float64)
        jac = inter / (size[x][:, None] + size[right][None, :] - inter)
        like = jac >= t - 1e-12
        if own:
            like &= x[:, None] < right[None, :]
        if not pairs:
            for i in np.flatnonzero(like.any(1)).tolist():
                y = np.flatnonzero(like[i])
                other, at = np.unique(label[right[y]], return_index=True)
                for c, k in zip(other.tolist(), y[at].tolist()):
                    if c != label[x[i]]:
                        forest.append((x[i], right[k], jac[i, k]))
                        label[label == c] = label[x[i]]
        if shared is not None:
            like &= next(shared) == 0
        if pairs:
            i, j = np.nonzero(like)
            yield nodes[x[i]], nodes[right[j]], jac[i, j], np.zeros(len(i), np.int64)
        else:
            links[x] += like @ weight[right]
            links[right] += weight[x] @ like
        lo += len(inter)
    if forest:
        i, j, v = (np.array(k) for k in zip(*forest))
        yield nodes[i], nodes[j], v.astype(np.float64), np.zeros(len(i), np.int64)
    some = np.flatnonzero(links)
    if len(some):
        yield nodes[some], np.full(len(some), NONE), np.zeros(len(some)), links[some]


def _members(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, node, size) for every row: its class and the number of its n-grams; null and 0 for rows that are in no pair."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                g, off = gram_sets(batch.column(1).slice(a, b - a), n)
                ids = batch.column(0).slice(a, b - a)
                size = np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.diff(off), 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(class_ids(g, off), mask=size == 0), pa.array(size.astype(np.int32))], names=["doc_id", "node", "size"])

    return checkpoint(docs.mapInArrow(tidy(make), "doc_id long, node long, size int"))


def _verified(docs: DataFrame, n: int, t: float, pairs: bool) -> tuple[DataFrame, DataFrame]:
    """The members of all classes, and what _verify_group() says of all groups (null for NONE)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = _members(docs, n)
    classes = members.where("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.first("size").alias("size"))
    docs = docs.where("doc_id is not null and text is not null")
    parts, least_agree = shards(docs), agree(t)
    bits = docs.sparkSession.sparkContext.broadcast(information(docs, n))  # 1 MB at any scale

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def make(batch):
            col, at = batch.column(0), 0
            keys, rows, of_row = [], [], []
            for a, b in chunks(col):
                g, off = gram_sets(col.slice(a, b - a), n)
                name = class_ids(g, off)
                new = _unseen(name, off, seen)
                sets = _rows_at(g, off, new)
                k, r = block_keys(*sets, t, bits.value)
                order = np.argsort(r, kind="stable")
                keys.append(k[order])
                rows.append(r[order] + at)
                of_row.append((name[new], *signatures(*sets)))
                at += len(new)
            if at:
                yield packed_runs(np.concatenate(keys), np.concatenate(rows), [np.concatenate(x) for x in zip(*of_row)], parts)

        yield from pieces(batches, make)

    sent = docs.select("text").mapInArrow(tidy(sketch), "shard int, p0 binary, p1 binary, p2 binary, p3 binary, p4 binary, p5 binary")
    edges = by_shard(sent, parts).groupBy("shard").applyInArrow(tidy_group(lambda table: _edges(table, least_agree)), "doc_id long, leader long").withColumnRenamed("doc_id", "node")
    edges = checkpoint(edges.distinct())

    def firsts(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
        """make(texts, sets) of the texts whose sets are new to this task, under their names."""
        seen: set[int] = set()
        for batch in batches:
            for a, b in chunks(batch.column(0)):
                col = batch.column(0).slice(a, b - a)
                g, off = gram_sets(col, n)
                name = class_ids(g, off)
                new = _unseen(name, off, seen)
                yield pa.RecordBatch.from_pydict({"node": pa.array(name[new])} | make(col.take(pa.array(new)), *_rows_at(g, off, new)))

    def parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from firsts(batches, lambda col, g, off: {"size": pa.array(np.diff(off).astype(np.int32)), "bits": pa.array(parity_sketches(g, off), pa.binary())})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from firsts(batches, lambda col, g, off: {"text": col})

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in _groups(batches):
            ids, size, bits = table["node"].to_numpy(), table["size"].to_numpy(), table["bits"].to_pylist()
            root = np.concatenate([_close_roots(ids[a:b], size[a:b], bits[a:b], t) for a, b in zip(cut[:-1], cut[1:])])
            keep = root != NONE
            root = np.where(table["tiles"].to_numpy() > 1, table["leader"].to_numpy(), root)
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(root[keep])], names=["node", "leader"])

    sketches = docs.select("text").mapInArrow(tidy(parity), "node long, size int, bits binary")
    close = checkpoint(_to_leaders(sketches, edges, classes, ["size", "bits"]).mapInArrow(tidy(sieve), "node long, leader long").distinct())
    whole = docs.select("text").mapInArrow(tidy(texts), "node long, text string")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found):
            node, peer, jaccard, links = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(peer, mask=peer == NONE), pa.array(jaccard), pa.array(links)], names=["node", "peer", "jaccard", "links"])

        for table, cut in _groups(batches):
            lead, ti, tj = (table[c].to_numpy() for c in ("leader", "ti", "tj"))
            nodes, tile, weight = (table[c].to_numpy() for c in ("node", "tile", "weight"))
            leaders = [np.array(x) for x in table["leaders"].to_pylist()]
            col = table["text"].combine_chunks()
            sets: list[np.ndarray] = []
            for a, b in chunks(col):
                g, off = gram_sets(col.slice(a, b - a), n)
                sets += [g[off[i] : off[i + 1]] for i in range(b - a)]
            held, rows = [], 0
            for a, b in zip(cut[:-1], cut[1:]):
                for found in _verify_group(nodes[a:b], sets[a:b], weight[a:b], leaders[a:b], tile[a:b], lead[a], ti[a], tj[a], t, pairs):
                    held.append(found)
                    rows += len(found[0])
                    if rows > 100_000:
                        yield batch(held)
                        held, rows = [], 0
            if held:
                yield batch(held)

    found = _to_leaders(whole, close, classes, ["text"], named=True).mapInArrow(tidy(verify), "node long, peer long, jaccard double, links long")
    return members, found


def _joined(members: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of documents that join what pairs of classes, and being in one class, join: a class's smallest doc_id with its others and with the smallest ones of such classes."""
    members = members.where("node is not null").select("doc_id", "node").distinct()
    least = members.groupBy("node").agg(F.min("doc_id").alias("rep"))
    other = least.select(F.col("node").alias("peer"), F.col("rep").alias("peer_rep"))
    between = found.where("peer is not null").join(least, "node").join(other, "peer").where("rep <> peer_rep")
    between = between.select(F.least("rep", "peer_rep").alias("doc_id_a"), F.greatest("rep", "peer_rep").alias("doc_id_b"), "jaccard")
    within = members.join(least, "node").where("rep < doc_id").select(F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    return between.union(within).groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard"))


def ngram_jaccard_join(docs: DataFrame, n: int = N, t: float = T, expand: bool = True) -> DataFrame:
    """All pairs doc_id_a < doc_id_b whose n-gram sets have Jaccard index >= t, with the index.

    They grow with the square of a group's size.  expand=False gives, for clustering, pairs
    that join the same documents, about one for each.  The defined results are in the module's docstring.
    """
    members, found = _verified(docs, n, t, expand)
    if not expand:
        return _joined(members, found)
    members = members.where("node is not null").select("doc_id", "node").distinct()
    a, b = members.select(F.col("doc_id").alias("a"), "node"), members.select(F.col("doc_id").alias("b"), F.col("node").alias("peer"))
    within = members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", F.col("node").alias("peer"), F.lit(1.0).alias("jaccard"))
    both = found.select("node", "peer", "jaccard").union(within).join(a, "node").join(b, "peer").where("a < b or (a > b and node <> peer)")
    return both.groupBy(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).agg(F.max("jaccard").alias("jaccard"))


def near_links(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """(doc_id, class_id, links) for every row: the smallest doc_id of those that chains of pairs join to it, and the number of other rows with which its own Jaccard index is >= t."""
    members, found = _verified(docs, n, t, False)
    found = checkpoint(found)
    group = _components(_joined(members, found)).select("doc_id", F.col("group").alias("class_id"))
    weight = members.where("node is not null").groupBy("node").agg((F.count("*") - 1).alias("links"))
    links = weight.where("links > 0").union(found.where("peer is null").select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    out = members.select("doc_id", "node").join(group, "doc_id", "left").join(links, "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def near_groups(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """(doc_id, group) for every document in a near-duplicate group: connected components, named by the smallest doc_id."""
    return _components(ngram_jaccard_join(docs, n, t, expand=False))


def _components(pairs: DataFrame) -> DataFrame:
    """(doc_id, group) for every document in pairs.

    Alternates min-label and pointer jumping until nothing changes; each round
    is cut by checkpoint() in the shared checkpoint folder.
    """
    pairs = checkpoint(pairs.select("doc_id_a", "doc_id_b").distinct())
    both = pairs.select(F.col("doc_id_a").alias("doc_id"), F.col("doc_id_b").alias("peer")).union(pairs.select("doc_id_b", "doc_id_a"))
    label = checkpoint(both.groupBy("doc_id").agg(F.least(F.min("peer"), F.first("doc_id")).alias("group")))
    while True:
        of = label.select(F.col("doc_id").alias("peer"), F.col("group").alias("peer_group"))
        low = both.join(of, "peer").groupBy("doc_id").agg(F.min("peer_group").alias("near"))
        step = label.join(low, "doc_id").select("doc_id", "group", F.least("group", "near").alias("next"))
        jump = label.select(F.col("doc_id").alias("next"), F.col("group").alias("far"))
        new = checkpoint(step.join(jump, "next").select("doc_id", F.least("next", "far").alias("group"), (F.least("next", "far") < F.col("group")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        label = new.select("doc_id", "group")
        if not moved:
            return label


def drop_near_copies(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """The documents without those of a near-duplicate group other than the one with the smallest doc_id.

    Rows with null doc_id or null text stay.
    """
    gone = near_groups(docs, n, t).where(F.col("group") < F.col("doc_id")).select(F.col("doc_id").alias(gone_id := fresh(docs.columns, "gone")))
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
