"""Structured Streaming: windowed covariances, and models that follow a stream."""

from __future__ import annotations

import math
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.frames import encode
from tesserae.kernels import distance as D
from tesserae.kernels import geometry as G
from tesserae.ml.artifacts import Potato, PotatoField
from tesserae.ml.base import metric_of
from tesserae.shared import shared_folder

#: Rows of a key that a task of keyed_means holds.
HELD_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A sample table as a stream."""
    import os

    schema = schema or spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    if os.path.isdir(f"{sf_dir}/{name}.parquet"):
        return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def read_events(spark: SparkSession, sf_dir: str, schema: T.StructType | None = None) -> DataFrame:
    """The events table as a stream; the zone-less timestamp becomes one that a watermark takes."""
    return read_table(spark, sf_dir, "events", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_covariance(df: DataFrame, ts: str, channels: list, by: list[str], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Population covariance of the channels (columns or expressions) in event-time windows; works on streams and on tables.

    Rows later than `late` behind the newest are dropped, on streams only, which must name it: without a watermark a window's state would never go.
    """
    if df.isStreaming and not late:
        raise ValueError("a stream needs `late`, after which windows are closed")
    cs = [F.col(c) if isinstance(c, str) else c for c in channels]
    names = [f"__c{i}" for i in range(len(cs))]
    df = df.withColumns(dict(zip(names, cs)))
    if late:
        df = df.withWatermark(ts, late)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.array(*(F.covar_pop(a, b) for a in names for b in names)).alias("cov"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "cov")


class OnlineModel:
    """A model that a stream keeps up to date through foreachBatch.

    The state moves only after a batch is done and remembers the batch's number, so a repeated batch changes nothing.  With a folder, which all
    executors share, the state and what emit() gives are written there after each batch, and a new object with the same folder goes
    on where the last one stopped, as the stream's own offsets do.
    """

    def __init__(self, model, order: str, col: str | list[str] = "cov", on_batch: Callable | None = None, folder: str | None = None):
        self.model, self.order, self.col, self.on_batch, self.folder, self.seen = model, order, col, on_batch, folder, -1

    def state(self) -> dict:
        return {"model": self.model}

    def restore(self, spark: SparkSession) -> OnlineModel:
        """Takes up the last state in the folder, if there is one."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            last = spark.read.parquet(f"{self.folder}/state").orderBy(F.desc("number")).first()
            if last and last.number > self.seen:
                vars(self).update(pickle.loads(bytes(last.state)), seen=last.number)
        return self

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.folder and self.seen < 0:
            self.restore(batch.sparkSession)
        if number <= self.seen:
            return
        out = self.apply(batch)
        if self.on_batch:
            self.on_batch(self.model, batch, number)
        if self.folder:
            spark = batch.sparkSession
            if out is not None:
                out.write.mode("overwrite").parquet(f"{self.folder}/out/batch={number}")
            row = spark.createDataFrame([(number, bytearray(pickle.dumps(self.state())))], "number long, state binary")
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/batch={number}")  # last: it says that the batch is done
        self.seen = number

    def apply(self, batch: DataFrame) -> DataFrame | None:
        """Moves the model by a batch and gives what is to be written of it."""
        raise NotImplementedError

    def run(self, stream: DataFrame, name: str | None = None) -> OnlineModel:
        """Takes all that is there now from the stream, batch by batch."""
        if self.folder and self.seen < 0:
            self.restore(stream.sparkSession)
        where = f"{self.folder or shared_folder(stream.sparkSession)}/offsets-{name or uuid.uuid4().hex}"
        stream.writeStream.foreachBatch(self).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
        return self


class OnlinePotato(OnlineModel):
    """Scores every row in event order, one by one, then moves the potato by alpha(t) with each accepted one.

    A potato field (col: its matrix columns) does so with each of its potatoes if the field accepts the row.  Rows come to the
    driver in order through an iterator, as each score depends on all rows before; scores of a batch are in `scores`, and in the folder.
    """

    def __init__(self, model: Potato | PotatoField, order: str, col: str | list[str] = "cov", alpha=0.01, on_batch=None, folder=None):
        super().__init__(model, order, col, on_batch, folder)
        self.alpha, self.t, self.scores = alpha, 0, []

    def state(self):
        return {"model": self.model, "t": self.t}

    def _rows(self, batch: DataFrame) -> Iterator:
        cols = [self.col] if isinstance(self.col, str) else self.col
        rows = batch.where(" and ".join(f"`{c}` is not null" for c in cols)).select(F.col(self.order).cast("long").alias("at"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(cols))).orderBy("at")
        for r in rows.toLocalIterator():
            yield r[0], [np.asarray(x, float).reshape(round(len(x) ** 0.5), -1) for x in r[1:]]

    def apply(self, batch):
        field = isinstance(self.model, PotatoField)
        potatoes = self.model.potatoes_ if field else [self.model]
        self.scores, at = [], []
        metrics = {m for p in potatoes for m in (metric_of(p.metric, "distance"), metric_of(p.metric, "mean"))}
        if metrics == {"riemann"} and all(np.shape(p.mean_) == (2, 2) and np.isrealobj(p.mean_) for p in potatoes):
            at = self._plain(batch, potatoes, field)
            return self._scored(batch, at)
        for when, xs in self._rows(batch):
            z = [(float(np.log(D.distance(x, p.mean_, metric_of(p.metric, "distance")))) - p.mu_) / p.sigma_ for x, p in zip(xs, potatoes)]
            accepted = self.model.p_value(z) > self.model.p_threshold if field else z[0] < self.model.threshold
            at.append(when)
            self.scores.append(z if field else z[0])
            self.t += 1
            if accepted:
                for x, p in zip(xs, potatoes):
                    p.update(x, self.alpha(self.t) if callable(self.alpha) else self.alpha)
        return self._scored(batch, at)

    def _scored(self, batch, at):
        if at:
            z = np.reshape(self.scores, (len(at), -1))
            return batch.sparkSession.createDataFrame(pa.table({"at": pa.array(at, pa.int64()), "z": encode(z, "vector")}))

    def _plain(self, batch, potatoes, field):
        """The same for real 2x2 matrices and the riemann metric, in plain numbers; moves the potatoes and gives the rows' places."""
        at, state = [], [[tuple(map(float, np.ravel(p.mean_))), float(p.mu_), float(p.sigma_)] for p in potatoes]
        cols = [self.col] if isinstance(self.col, str) else self.col
        rows = batch.where(" and ".join(f"`{c}` is not null" for c in cols)).select(F.col(self.order).cast("long").alias("at"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(cols))).orderBy("at")
        for r in rows.toLocalIterator(prefetchPartitions=True):
            alpha = self.alpha(self.t + 1) if callable(self.alpha) else self.alpha
            steps = [G.step2(s[0], x, alpha) for s, x in zip(state, r[1:])]
            logs = [math.log(d) if d > 0 else -math.inf for d, _ in steps]
            z = [(d - s[1]) / s[2] for d, s in zip(logs, state)]
            accepted = self.model.p_value(z) > self.model.p_threshold if field else z[0] < self.model.threshold
            at.append(r[0])
            self.scores.append(z if field else z[0])
            self.t += 1
            if accepted:
                for s, d, (_, mean) in zip(state, logs, steps):
                    s[0], s[1] = mean, (1 - alpha) * s[1] + alpha * d
                    s[2] = math.sqrt((1 - alpha) * s[2] ** 2 + alpha * (d - s[1]) ** 2)
        for p, (m, mu, sigma) in zip(potatoes, state):
            p.mean_, p.mu_, p.sigma_ = np.array(m).reshape(2, 2), mu, sigma
        return at


class OnlineWhitening(OnlineModel):
    """Whitening.partial_fit on every batch; what is written is the batch, whitened."""

    def apply(self, batch):
        self.model.partial_fit(batch.select(self.col), col=self.col)
        if self.folder and hasattr(self.model, "mean_"):
            return self.model.transform(batch, self.col)


def in_order(parts, folder: str, most: int | None = None) -> Iterator[list]:
    """Rows of (order, matrices) parts in the order, a list of flat matrices at a time; parts beyond `most` rows are sorted and kept in files, which are merged by blocks."""
    most = most or HELD_ROWS
    held, count, runs = [], 0, []

    def sorted_run():
        o, x = (np.concatenate(v) for v in zip(*held))
        at = np.argsort(o, kind="stable")
        return o[at], x[at]

    for o, values in parts:
        ok = np.asarray(values.notna())
        if ok.any():
            held.append((o[ok], np.stack([np.asarray(v, float) for v in values[ok]])))
            count += ok.sum()
        if count >= most:
            names = [f"{folder}/{len(runs)}-{k}.npy" for k in "ox"]
            for name, v in zip(names, sorted_run()):
                np.save(name, v)
            runs.append([*names, 0])
            held, count = [], 0
    last = sorted_run() if held else None
    sources = [[np.load(a, mmap_mode="r"), np.load(b, mmap_mode="r"), 0] for a, b, _ in runs] + ([[*last, 0]] if last else [])
    size = max(1, most // max(1, len(sources)))
    while sources:
        # up to the least of the blocks' last places all rows are at hand
        cut = min(s[0][min(s[2] + size, len(s[0])) - 1] for s in sources)
        blocks = []
        for s in sources:
            end = s[2] + int(np.searchsorted(s[0][s[2] : s[2] + size], cut, side="right"))
            blocks.append((np.array(s[0][s[2] : end]), np.array(s[1][s[2] : end])))
            s[2] = end
        sources = [s for s in sources if s[2] < len(s[0])]
        o, x = (np.concatenate(v) for v in zip(*blocks))
        yield x[np.argsort(o, kind="stable")].tolist()


def keyed_means(stream: DataFrame, key: str, order: str, col: str = "cov", alpha: float = 0.1) -> DataFrame:
    """An online geodesic mean for each key: after every trigger, (key, n, mean).  The state is one matrix a key, kept by Spark."""
    out = T.StructType([T.StructField(key, stream.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType()))])
    state = T.StructType([T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType()))])

    def step(k, frames, st):
        import pandas as pd

        n, m = st.get if st.exists else (0, None)
        with tempfile.TemporaryDirectory() as folder:
            for x in in_order(((np.asarray(f[order]), f[col]) for f in frames), folder):
                for v in x:
                    if m is None:
                        m = v
                    elif len(v) == 4 and v[1] == v[2]:
                        m = G.step2(m, v, alpha)[1]
                    else:
                        p = round(len(v) ** 0.5)
                        m = G.geodesic(np.reshape(m, (p, p)), np.reshape(v, (p, p)), alpha).ravel().tolist()
                    n += 1
        flat = None if m is None else [float(v) for v in m]
        st.update((n, flat))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [flat]})

    return stream.groupBy(key).applyInPandasWithState(step, out, state, "update", "NoTimeout")


def stream_name(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex[:8]}"


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now and gives the result as a table (in memory; for tests and small results)."""
    where = checkpoint or f"{shared_folder(df.sparkSession)}/offsets-{name}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
