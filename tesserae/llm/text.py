"""Vectorised text primitives over Arrow string columns.

A batch of texts is one flat byte buffer with row offsets.  Words, word hashes
and hashes of word n-grams are found with whole-buffer numpy passes, so that
the cost per byte is a few nanoseconds and no Python loop runs over words.

Null texts count as texts without words everywhere in this module.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PI, _QI = pow(_P, -1, 2**64), pow(_Q, -1, 2**64)
_tables: dict[int, np.ndarray] = {}

#: Bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All of ASCII but letters and digits separates normalised words.
NOT_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base & (2**64 - 1), np.uint64)
        p[0] = 1
        have = np.cumprod(p)
        if n <= 1 << 21:
            _tables[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is ''."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def chunks(col: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes, or one longer row."""
    o = flat(col)[1]
    a = 0
    while a < len(o) - 1:
        b = int(np.searchsorted(o, o[a] + size, "right")) - 1
        b = min(max(b, a + 1), len(o) - 1, a + 60_000)
        yield a, b
        a = b


def words(b: np.ndarray, o: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the offsets of the rows' words."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(o), np.int64)
    w = ~sep[b]
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    edge = o[1:-1]
    at = edge[edge < len(b)]
    s[at] = w[at]
    at = edge[edge > 0] - 1
    e[at] = w[at]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, o)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word."""
    with np.errstate(over="ignore"):
        c = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * powers(_P, len(b))[: len(b)], out=c[1:])
        return mix((c[ends] - c[starts]) * powers(_PI, len(b) + 1)[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words (of all rows as one; the caller drops runs that cross rows)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(_Q, len(h))[: len(h)], out=c[1:])
        return mix((c[n:] - c[:-n]) * powers(_QI, m)[:m])


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of every element under these offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shards(df, mb: int = 32) -> int:
    """How many shards to hash into: the session's shuffle partitions, or one for `mb` MB of estimated input, if more."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 56 else 0  # no estimate
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (mb << 20)), 1)


def pieces(batch_iter, make, at_bytes: int = 16 << 20):
    """Joins small record batches up to about `at_bytes`, or cuts larger ones into such, and calls make(batch) for each; all rows get there."""
    held, size = [], 0

    def whole(batches):
        for b in pa.Table.from_batches(batches).combine_chunks().to_batches():  # more than one where a column is beyond 2 GB
            yield from make(b)

    for batch in batch_iter:
        for part in cut(batch, at_bytes):
            if held and size + part.nbytes > at_bytes:
                yield from whole(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield from whole(held)


def cut(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in halves, quarters ... of at most this many bytes, or one row."""
    if batch.nbytes <= most or batch.num_rows < 2:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from cut(batch.slice(0, half), most)
        yield from cut(batch.slice(half), most)


def spread(table, key: str):
    """A table that is read in fewer parts than the cluster has cores (a small one, or one of few row groups), hashed over all of them by the key; others as they are.

    For tables only: asking a plan with shuffles how many parts it has would run it.
    """
    from pyspark.sql import functions as F

    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, F.xxhash64(key))


def quoted(name: str):
    """The column of this very name, dots and all."""
    from pyspark.sql import functions as F

    return F.col("`" + name.replace("`", "``") + "`")


def fresh(columns: list[str], name: str) -> str:
    """A column name like `name` that none of the columns has."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name += "_"
    return name
