"""What the operators share of the cluster: the folder in which lineage is cut, and the memory of Python workers."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the folder that the cluster names in spark.checkpoint.dir; where it is unset, a temporary one on a local master, as in tests, and an error on a cluster."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tesserae-test-"))
    return df.checkpoint()


@functools.cache
def _trim() -> Callable[[int], int]:
    libc = ctypes.CDLL(None)
    return getattr(libc, "malloc_trim", lambda n: 0)


def release() -> None:
    """Gives the memory that this worker has freed back to the machine; idle workers stay for the next stages and would keep it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, with a release() when the task is through."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def tidy_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f for applyInArrow, with a release() after each group."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            release()

    return run
