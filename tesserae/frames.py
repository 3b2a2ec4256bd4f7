"""Matrix sets as DataFrames, and row-local kernels on them.

A matrix set has an identifier and a matrix column of type array<double>
(row-major, length p*p), or struct<re:array<double>,im:array<double>> for complex
matrices.  Kernels run on Arrow batches: a batch decodes to one numpy stack without
copying row by row, and the results go back the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

REAL = T.ArrayType(T.DoubleType())
COMPLEX = T.StructType([T.StructField("re", REAL), T.StructField("im", REAL)])
_types = {"matrix": REAL, "vector": REAL, "complex": COMPLEX, "double": T.DoubleType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "ints": T.ArrayType(T.IntegerType())}


def decode(col: pa.Array, shape: tuple[int, ...] | None = None, fill: float = np.nan) -> np.ndarray:
    """A stack (n, p, p), or (n, *shape), of a matrix column; null rows are filled."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_struct(col.type):
        return decode(col.field("re"), shape, fill) + 1j * decode(col.field("im"), shape, 0)
    if not pa.types.is_list(col.type) and not pa.types.is_large_list(col.type):
        return col.to_numpy(zero_copy_only=False)
    values = col.flatten()
    values = np.asarray(values.to_numpy(zero_copy_only=False), dtype=float)
    n = len(col)
    if col.null_count:
        keep = np.asarray(col.is_valid())
        size = len(values) // max(int(keep.sum()), 1)
        out = np.full((n, size), fill)
        out[keep] = values.reshape(-1, size) if size else out[keep]
    else:
        out = values.reshape(n, -1) if n else values.reshape(0, 0)
    if shape is None:
        p = round(out.shape[1] ** 0.5)
        if p * p != out.shape[1]:
            raise ValueError(f"{out.shape[1]} values aren't a square matrix")
        shape = (p, p)
    return out.reshape(n, *shape)


def encode(x: np.ndarray, kind: str) -> pa.Array:
    """An Arrow column of one result for each row."""
    n = len(x)
    if kind in ("matrix", "vector", "ints"):
        flat = np.ascontiguousarray(np.real(x).reshape(n, -1))
        size = flat.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(flat.reshape(-1).astype(np.int32 if kind == "ints" else float)))
    if kind == "complex":
        x = np.asarray(x, complex)
        return pa.StructArray.from_arrays([encode(x.real, "matrix"), encode(x.imag, "matrix")], ["re", "im"])
    return pa.array(np.asarray(x).astype({"double": float, "boolean": bool, "int": np.int32}[kind]))


def apply(df: DataFrame, inputs: list[str], outputs: dict[str, str], f: Callable, keep: list[str] | None = None, shapes: dict | None = None) -> DataFrame:
    """df with new columns outputs {name: kind} = f(stack, ...) of the input columns.

    Only the kept columns and the inputs enter Python.  A null in any input gives nulls; f sees only rows without.
    """
    keep = df.columns if keep is None else keep
    cols = list(dict.fromkeys([*keep, *inputs]))
    shapes = shapes or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ok = np.logical_and.reduce([np.asarray(batch.column(c).is_valid()) for c in inputs]) if inputs else np.ones(batch.num_rows, bool)
            use = batch if ok.all() else batch.filter(pa.array(ok))
            if use.num_rows:
                out = f(*(decode(use.column(c), shapes.get(c)) for c in inputs))
                out = out if isinstance(out, tuple) else (out,)
                new = [encode(x, kind) for x, kind in zip(out, outputs.values())]
            else:
                new = [pa.nulls(0, pa.int32())] * len(outputs)
            if not ok.all():
                at = pa.array([int(k) if o else None for k, o in zip(np.cumsum(ok) - 1, ok)], pa.int64())
                new = [x.take(at) if len(x) else pa.nulls(batch.num_rows, x.type) for x in new]
            names = [*keep, *outputs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=names)

    fields = [df.schema[c] for c in keep] + [T.StructField(k, _types[v]) for k, v in outputs.items()]
    return df.select(*cols).mapInArrow(run, T.StructType(fields))


def to_numpy(df: DataFrame, matrix: str = "cov", order: str | None = None) -> np.ndarray:
    """The whole column as a stack on the driver; for small sets only."""
    df = df.orderBy(order) if order else df
    return decode(df.select(matrix).toArrow().column(0))


def from_numpy(spark, x: np.ndarray, matrix: str = "cov", **columns) -> DataFrame:
    """A matrix set with id 0, 1, ... and further columns."""
    kind = "complex" if np.iscomplexobj(x) else "matrix"
    table = pa.table({"id": pa.array(np.arange(len(x))), matrix: encode(x, kind), **{k: pa.array(v) for k, v in columns.items()}})
    return spark.createDataFrame(table)
