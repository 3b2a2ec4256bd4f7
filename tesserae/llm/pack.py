"""Keys packed by hash shard: millions of them move through a shuffle as a few rows of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
PARTITIONS = 50_000


def packed(key: np.ndarray, payload: list[np.ndarray], n: int) -> pa.RecordBatch:
    """One row for each shard that occurs: the shard, and the payloads of its keys as bytes."""
    shard = (key % U(n)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cut = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)] if len(shard) else np.zeros(1, np.int64)
    cols: list[pa.Array] = [pa.array(shard[cut[:-1]], pa.int32())]
    for x in payload:
        data = np.ascontiguousarray(x[order])
        offs = (cut * data.itemsize).astype(np.int32)
        cols.append(pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offs), pa.py_buffer(data)]))
    return pa.RecordBatch.from_arrays(cols, names=["shard", *(f"p{i}" for i in range(len(payload)))])


def packed_runs(key: np.ndarray, row: np.ndarray, of_row: list[np.ndarray], n: int) -> pa.RecordBatch:
    """packed() of 40 bits of the keys, with what belongs to a row (ascending in `row`) once for each run of its keys in a shard: keys as p0 and p1, run lengths as p2, then of_row."""
    shard = (key % U(n)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    key, row, shard = key[order], row[order], shard[order]
    run = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.zeros(0, np.int64)
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(key) else np.zeros(0, np.int64)
    run_cut = np.r_[np.searchsorted(run, cut), len(run)]
    cut = np.r_[cut, len(key)]
    cols: list[pa.Array] = [pa.array(shard[cut[:-1]], pa.int32())]
    runs = [np.diff(np.r_[run, len(key)]).astype(np.uint32), *(x[row[run]] for x in of_row)]
    for x, bounds in [*((k, cut) for k in narrow(key)), *((x, run_cut) for x in runs)]:
        data = np.ascontiguousarray(x)
        cols.append(pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(data)]))
    return pa.RecordBatch.from_arrays(cols, names=["shard", *(f"p{i}" for i in range(len(cols) - 1))])


def narrow(key: np.ndarray) -> list[np.ndarray]:
    """40 bits of the keys; within a shard that is enough to tell blocks apart, as false matches are verified."""
    return [(key >> U(32)).astype(np.uint32), (key >> U(24)).astype(np.uint8)]


def widened(table: pa.Table) -> np.ndarray:
    return (unpacked(table["p0"], np.uint32).astype(np.uint64) << U(8)) | unpacked(table["p1"], np.uint8)


def unpacked(col: pa.ChunkedArray, dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in col]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def lists(flat: np.ndarray, cut: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row i has flat[cut[i]:cut[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat, kind))


def by_shard(df: DataFrame, shards: int) -> DataFrame:
    """Rows of packed() for groupBy("shard"): every shard in a partition of its own, where hashing their numbers would put several into some and none into others.

    More shards than PARTITIONS are left to hashing, by which many come into each partition.
    """
    return df.repartitionById(shards, F.col("shard")) if shards <= PARTITIONS else df
